"""Removal of byte strings that a document with a smaller id has too, by the tree of common
prefixes of a suffix array.

`scan` goes over the common prefixes of suffixes in order, with a stack, and puts out every
interval of suffixes that share a prefix and whose left neighbours differ: the maximal
repeats, each with all of its occurrences. `repeat_groups` is the operator on some texts.

Over a table no suffix array of all bytes is built. Suffixes are first brought together by
content:

1. Every window of 50 bytes has an anchor, the least hash among its 16-byte grams; equal
   windows have equal anchors. A chunk (a few MB of documents, by a hash of the row) asks
   about its anchors, eight bytes each, twice for those of several documents, and gets back
   those that another document has.
2. Stretches of windows with one such anchor are sent, as the bytes that they cover and the
   smallest id that has them in the chunk, to the anchor's bucket.
3. A bucket lays its distinct stretches end to end and brings together the suffixes that
   agree up to the window length, by hashes that are verified, or by prefix doubling should
   one fail. They are an interval of the tree.
   One whose left neighbours are all the same byte holds no maximal repeat, nor does any
   interval inside it, and is left at that; so is one whose stretches all have one smallest
   id. The others are sorted to the ends of their stretches, and the stack scan over their
   common prefixes gives the repeat groups with their smallest ids: each suffix gets the
   longest repeat that also is under a smaller id than its stretch's own. These lengths go
   back to the chunks that sent the stretch, and so does its own smallest id where it is
   smaller than what they said.
4. A chunk marks the windows of each document for which a smaller id is known.

Every window of 50 bytes is covered by the maximal repeat that has just its occurrences, so
groups of 50 bytes or more find all windows and nothing else. An anchor that more than HOT
asks name (a gram in very many texts) would crowd a bucket: its windows are spread by their
own hash instead, one by one. The comparison of windows is on bytes; the hashes only bring
them together, and name a stretch within one chunk.

Rows: a null text is empty, and a text shorter than a window loses nothing; equal ids don't
remove each other's bytes; a null id counts as larger than all others; the remaining bytes
may be no UTF-8 when a character is cut, so they are binary. Long texts are worked off in
parts that overlap by a window. Equal rows that are many are counted before they move. An
empty table gives an empty one, extra columns stay, but one named like the result (`into`),
which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keystrata.llm.common import U64, mix, read, texts
from keystrata.llm.substring import BASE, INVERSE, bucket_of, chunked, powers, restored, twice, within

WINDOW = 50
GRAM = 16
HOT = 4000
#: Bytes that are hashed at once.
PIECE = 1 << 20
#: Windows of one stretch.
STRETCH = 1000
LAST_ID = 2**63 - 1


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of an integer array in order, and each one's rank, by prefix doubling."""
    n = len(data)
    rank = np.unique(data, return_inverse=True)[1].astype(np.int64)
    k = 1
    order = np.argsort(rank, kind="stable")
    while n > 1:
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        s = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
        if rank[order[-1]] == n - 1:
            break
        k *= 2
    return order, rank


def common_prefixes(data: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """lcp[i]: how far suffixes order[i - 1] and order[i] agree."""
    n, h = len(data), 0
    lcp = np.zeros(n, np.int64)
    for i in range(n):
        r = rank[i]
        if r == 0:
            h = 0
            continue
        j = order[r - 1]
        while i + h < n and j + h < n and data[i + h] == data[j + h]:
            h += 1
        lcp[r] = h
        h = max(0, h - 1)
    return lcp


def scan(lcp: list[int], left: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(length, i, j): suffixes i to j - 1 in order share a prefix of that length, their
    neighbours share less, and their left neighbours differ. lcp[i] is what suffixes i - 1
    and i share; left[i] is a byte, or a number over 255 where a text begins."""
    # an interval: common length, its first place, and its left neighbour, None once two differ
    stack: list[list] = []

    def join(a, b):
        return a if a == b and a is not None and a < 256 else None

    n = len(left)
    for i in range(1, n + 1):
        h = lcp[i] if i < n else 0
        low, seen = i - 1, left[i - 1]
        while stack and stack[-1][0] > h:
            length, low, inner = stack.pop()
            seen = join(inner, seen)
            if length >= least and seen is None:
                yield length, low, i
        if stack and stack[-1][0] == h:
            stack[-1][2] = join(stack[-1][2], seen)
        elif h > 0:
            stack.append([h, low, seen])


def repeat_groups(parts: list[bytes], least: int = WINDOW) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(length, [(text, offset), ...]) of each maximal repeat of `least` bytes or more: the
    occurrences agree over the length and differ, or a text ends, on either side.

    Texts are separated by a symbol of their own each, so no repeat crosses them.
    """
    flat, starts = [], []
    for i, p in enumerate(parts):
        starts.append(len(flat))
        flat += [*p, 256 + i]
    if not flat:
        return
    data = np.array(flat, np.int64)
    order, rank = suffix_array(data)
    left = np.concatenate([[256], data[:-1]])[order].tolist()
    for length, i, j in scan(common_prefixes(data, order, rank).tolist(), left, least):
        at = np.sort(order[i:j])
        text = np.searchsorted(starts, at, side="right") - 1
        yield length, [(int(t), int(a - starts[t])) for t, a in zip(text, at, strict=True)]


def sums_of(data: bytes) -> np.ndarray:
    """Running sums of a polynomial in the bytes."""
    symbols = mix(np.arange(1, 257, dtype=U64) * U64(BASE))
    return np.concatenate([np.zeros(1, U64), np.cumsum(symbols[np.frombuffer(data, np.uint8)] * powers(BASE, len(data)))])


def named(sums: np.ndarray, inverse: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of the bytes from a's window to b's."""
    end = b + WINDOW
    return mix((sums[end] - sums[a]) * inverse[a] + (end - a).astype(U64) * U64(0xD6E8FEB86659FD93))


class Anchored:
    """Some texts end to end, and of every window its anchor."""

    def __init__(self, data: list[bytes]):
        self.bytes = b"".join(data)
        self.lengths = np.array([len(t) for t in data], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        n = len(self.bytes)
        self.sums = sums_of(self.bytes)
        self.inverse = powers(INVERSE, n + 1)
        if n < WINDOW:
            self.at, self.anchor = np.zeros(0, np.int64), np.zeros(0, U64)
            return
        m = mix((self.sums[GRAM:] - self.sums[:-GRAM]) * self.inverse[: n - GRAM + 1])
        for k in (1, 2, 4, 8, 16):
            m = np.minimum(m[:-k], m[k:])
        k = WINDOW - GRAM + 1 - 32
        m = np.minimum(m[:-k], m[k:])
        ends = np.repeat(self.starts[1:], self.lengths)[: len(m)]
        self.at = np.flatnonzero(np.arange(len(m)) + WINDOW <= ends)
        self.anchor = m[self.at]

    def anchors(self) -> np.ndarray:
        """The distinct anchors of each text, one text after the other."""
        if not len(self.at):
            return self.anchor
        new = np.concatenate([[True], (self.anchor[1:] != self.anchor[:-1]) | (np.diff(self.at) != 1)])
        text = np.searchsorted(self.starts, self.at[new], side="right")
        anchor = self.anchor[new]
        order = np.lexsort((anchor, text))
        t, a = text[order], anchor[order]
        return a[np.concatenate([[True], (t[1:] != t[:-1]) | (a[1:] != a[:-1])])]

    def stretches(self, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, last, anchor) window starts of the stretches; windows of hot anchors are
        stretches of their own, with a key of their own."""
        if not len(self.at):
            return self.at, self.at, self.anchor
        alone = within(self.anchor, hot)
        cut = np.concatenate([[True], (self.anchor[1:] != self.anchor[:-1]) | (np.diff(self.at) != 1) | alone[1:] | alone[:-1]])
        first = np.flatnonzero(cut)
        last = np.concatenate([first[1:], [len(cut)]]) - 1
        long = np.flatnonzero(last - first >= STRETCH)
        if len(long):
            more = np.concatenate([np.arange(first[i] + STRETCH, last[i] + 1, STRETCH) for i in long])
            first = np.sort(np.concatenate([first, more]))
            last = np.concatenate([first[1:], [len(cut)]]) - 1
        key = self.anchor[first].copy()
        a, b = self.at[first], self.at[last]
        own = alone[first]
        key[own] = self.named(a[own], b[own])
        return a, b, key

    def named(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return named(self.sums, self.inverse, a, b)


def parts(data: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(text, offset, bytes) of texts, some PIECE bytes at a time. A longer text comes in
    parts that overlap by what a window needs, so each of its windows is in one of them."""
    which, offset, held, size = [], [], [], 0
    for i, t in enumerate(data):
        for at in range(0, max(1, len(t) - WINDOW + 1), PIECE):
            part = t if len(t) <= PIECE else t[at : at + PIECE + WINDOW - 1]
            if size and size + len(part) > PIECE:
                yield np.array(which), np.array(offset), held
                which, offset, held, size = [], [], [], 0
            which.append(i)
            offset.append(at)
            held.append(part)
            size += len(part)
            if part is t:
                break
    if held:
        yield np.array(which), np.array(offset), held


def common(a: bytes, b: bytes) -> int:
    """How many bytes two strings begin with alike."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return n - ((int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])).bit_length() + 7) // 8


def ids_of(table: pa.Table) -> np.ndarray:
    return pa.compute.fill_null(table.column("id"), LAST_ID).to_numpy()


ANSWERS = "chunk bigint, hashes binary, hot binary, names binary, first binary, last binary, least binary"
#: Buckets of a partition, worked off one after the other.
SPLIT = 4
#: Runs of windows that are held against those who asked at once.
RUNS = 1 << 18
STRETCHES = "bucket int, chunk bigint, data binary, lengths binary, least binary"


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of a partition that is sorted by bucket, a bucket at a time."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        edges = np.flatnonzero(np.diff(b.column("bucket").to_numpy())) + 1
        start = 0
        for end in [*edges.tolist(), b.num_rows]:
            part = b.slice(start, end - start)
            if held and part.num_rows and held[0].column("bucket")[0] != part.column("bucket")[0]:
                yield pa.Table.from_batches(held)
                held = []
            if part.num_rows:
                held.append(part)
            start = end
    if held:
        yield pa.Table.from_batches(held)


def answer(chunks: np.ndarray, **columns: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    """A row of ANSWERS for each chunk, all in one batch: there are as many rows as chunks
    times buckets. columns: values, and the edges between rows."""
    n, made = len(chunks), {"chunk": pa.array(chunks, pa.int64())}
    for name in ("hashes", "hot", "names", "first", "last", "least"):
        if name not in columns:
            made[name] = pa.nulls(n, pa.binary())
            continue
        values, edges = columns[name]
        data = np.ascontiguousarray(values).tobytes()
        made[name] = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((edges * values.itemsize).astype(np.int32).tobytes()), pa.py_buffer(data)])
    return pa.RecordBatch.from_pydict(made)


def told(chunks: np.ndarray, arrays: list[np.ndarray], hot: int) -> Iterator[pa.RecordBatch]:
    """What a bucket answers: of each chunk's sorted array what the bucket has twice."""
    every, row = np.concatenate(arrays), np.repeat(np.arange(len(arrays)), list(map(len, arrays)))
    u, k = np.unique(every, return_counts=True)
    known, crowded = u[k > 1], u[k > hot]
    # an array is sorted; what it asks for twice is one answer
    use = within(every, known)
    use[1:] &= (every[1:] != every[:-1]) | (row[1:] != row[:-1])
    hit, row = every[use], row[use]
    full, at = np.unique(row, return_index=True)
    is_hot = within(hit, crowded)
    edges, hot_edges = np.append(at, len(hit)), np.concatenate([[0], np.cumsum(is_hot)])
    if len(full):
        yield answer(chunks[full], hashes=(hit, edges), hot=(hit[is_hot], hot_edges[edges]))


def answered(asks: DataFrame, n: int, hot: int) -> DataFrame:
    """Of each asked array, the anchors that are asked for twice, and which of them are hot."""

    def run(batches):
        for b in by_bucket(batches):
            yield from told(b.column("chunk").to_numpy(), [np.frombuffer(x, "<u8") for x in b.column("hashes").to_pylist()], hot)

    return asks.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, ANSWERS)


def gathered(table: pa.Table, column: str, kind: str) -> np.ndarray:
    parts = [np.frombuffer(x, kind) for x in table.column(column).to_pylist() if x]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def ranked(key: np.ndarray) -> np.ndarray:
    """Each key's rank, equal for equal keys."""
    order = np.argsort(key)
    s = key[order]
    rank = np.empty(len(key), np.uint32)
    rank[order[:1]] = 0
    rank[order[1:]] = np.cumsum(s[1:] != s[:-1], dtype=np.uint32)
    return rank


def window_order(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, same): the starts of the windows that lie before their place's end, by their
    first WINDOW bytes, and whether each agrees in these with the one before it. Prefix
    doubling from 8 bytes to 16, to 32 and, by an overlap, to the window's length."""
    n = len(data)
    room = ends - np.arange(n)
    rank = np.zeros(n, U64)
    for k in range(8):
        rank[: n - k] |= data[k:].astype(U64) << U64(56 - 8 * k)
    for step in (8, 16, WINDOW - 32):
        small = ranked(rank)
        rank = small.astype(U64) << U64(32)
        rank[: n - step] |= small[step:]
    at = np.flatnonzero(room >= WINDOW)
    order = np.argsort(rank[at])
    s = rank[at[order]]
    return at[order], np.concatenate([[False], s[1:] == s[:-1]])[: len(s)]


def repeated_windows(data: bytes, begins: np.ndarray, stops: np.ndarray, sums: np.ndarray, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, place, size): the starts of the windows that two places or more of the stretches
    have, those of one window together, the stretch of each, and how many each window has.
    Hashes bring them together and bytes are compared; should two windows have one hash, all
    are sorted by their bytes instead."""
    count = stops - begins - WINDOW + 1
    place = np.repeat(np.arange(len(begins), dtype=np.int32), count)
    at = np.arange(len(place)) + np.repeat(begins - np.cumsum(count) + count, count)
    h = (sums[at + WINDOW] - sums[at]) * inverse[at]
    order = np.argsort(h)
    h = h[order]
    same = np.concatenate([[False], h[1:] == h[:-1]])[: len(h)]
    two = np.flatnonzero(same)
    eight = np.ndarray(max(0, len(data) - 7), "<u8", data, 0, (1,))
    a, b = at[order[two]], at[order[two - 1]]
    if not all((eight[a + k] == eight[b + k]).all() for k in (*range(0, WINDOW - 8, 8), WINDOW - 8)):
        flat = np.frombuffer(data, np.uint8)
        found, same = window_order(flat, np.repeat(stops, stops - begins))
        # back to numbers of windows
        order = found - (begins - np.cumsum(count) + count)[np.searchsorted(begins, found, side="right") - 1]
    size = np.diff(np.append(np.flatnonzero(~same), len(order)))
    order, size = order[np.repeat(size > 1, size)], size[size > 1]
    return at[order], place[order], size


def given(lcp: list[int], left: list[int], ids: list[int]) -> Iterator[tuple[int, int]]:
    """(suffix, length): the stack scan, with the smallest id of each interval. A suffix is
    given the longest repeat whose occurrences have a smaller id than its own; shorter ones
    that it begins lie within that. Where the left neighbours are alike, the repeat one byte
    to the left says as much and more.

    What is open in an interval all has the interval's smallest id, so a suffix moves when
    that falls and not with every interval.
    """
    # an interval: length, left neighbour, smallest id, suffixes that have it, and those that
    # got a smaller one from it
    stack: list[list] = []

    def take(into: list, left: int | None, least: int, still: list[int]) -> None:
        into[1] = left if left == into[1] and left is not None and left < 256 else None
        if least < into[2]:
            into[4] += into[3]
            into[2:4] = least, still
        elif least > into[2]:
            into[4] += still
        elif len(still) > len(into[3]):
            still += into[3]
            into[3] = still
        else:
            into[3] += still

    n = len(ids)
    for i in range(1, n + 1):
        h = lcp[i] if i < n else 0
        node = left[i - 1], ids[i - 1], [i - 1]
        while stack and stack[-1][0] > h:
            top = stack.pop()
            take(top, *node)
            if top[1] is None:
                for k in top[4]:
                    yield k, top[0]
            node = top[1], top[2], top[3]
        if stack and stack[-1][0] == h:
            take(stack[-1], *node)
        elif h > 0:
            stack.append([h, *node, []])


def smaller_ids(data: bytes, begins: np.ndarray, stops: np.ndarray, own: np.ndarray, sums: np.ndarray | None = None, inverse: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first, last) of the windows of stretches that repeat groups give to a smaller
    id than their stretch's own one; first and last count from its start."""
    flat = np.frombuffer(data, np.uint8)
    if sums is None:
        sums, inverse = sums_of(data), powers(INVERSE, len(data) + 1)
    at, place, size = repeated_windows(data, begins, stops, sums, inverse)
    begin = np.cumsum(size) - size
    found: list[np.ndarray] = [np.zeros((0, 3), np.int64)]
    if len(size):
        starts = at == begins[place]
        left = flat[at - 1].astype(np.int64)
        diverse = np.minimum.reduceat(np.where(starts, -1, left), begin) != np.maximum.reduceat(np.where(starts, 256, left), begin)
        differ = np.minimum.reduceat(own[place], begin) != np.maximum.reduceat(own[place], begin)
        left[starts] = 256
        for g in np.flatnonzero(diverse & differ).tolist():
            p, a = place[begin[g] : begin[g] + size[g]], at[begin[g] : begin[g] + size[g]]
            rest = [data[x:z] for x, z in zip(a.tolist(), stops[p].tolist(), strict=True)]
            order = sorted(range(len(rest)), key=rest.__getitem__)
            lcp = [0, *[common(rest[x], rest[y]) for x, y in zip(order, order[1:], strict=False)]]
            hit = np.array(list(given(lcp, left[begin[g] : begin[g] + size[g]][order].tolist(), own[p][order].tolist())), np.int64).reshape(-1, 2)
            k = np.array(order)[hit[:, 0]]
            first = a[k] - begins[p[k]]
            found.append(np.stack([p[k], first, first + hit[:, 1] - WINDOW], 1))
    out = np.concatenate(found)
    return out[:, 0], out[:, 1], out[:, 2]


def least_ids(stretches: DataFrame, n: int) -> DataFrame:
    """For each chunk's stretches the windows whose smallest id lies elsewhere."""

    def run(batches):
        for b in by_bucket(batches):
            yield from bucket(b)

    def bucket(b: pa.Table) -> Iterator[pa.RecordBatch]:
        chunk, parts, lows = [], [], []
        for c, d, ls, low in zip(*[b.column(x).to_pylist() for x in ("chunk", "data", "lengths", "least")], strict=True):
            at = 0
            for k in np.frombuffer(ls, "<u2").tolist():
                parts.append(d[at : at + k])
                at += k
            low = np.frombuffer(low, "<i8")
            lows.append(low)
            chunk.append(np.full(len(low), c, np.int64))
        if not parts:
            return
        low, chunk = np.concatenate(lows), np.concatenate(chunk)
        index: dict[bytes, int] = {}
        which = np.array([index.setdefault(p, len(index)) for p in parts], np.int64)
        own = np.full(len(index), LAST_ID, np.int64)
        np.minimum.at(own, which, low)
        lengths = np.array(list(map(len, index)), np.int64)
        data = b"".join(index)
        del parts, index
        stops = np.cumsum(lengths)
        begins = stops - lengths
        sums, inverse = sums_of(data), powers(INVERSE, len(data) + 1)
        r_place, r_first, r_last = smaller_ids(data, begins, stops, own, sums, inverse)
        # an id below the stretch's own is below those of all who sent it, so the least one of
        # all may stand for it; and the stretch itself is a repeat of those who sent it
        r_id = np.full(len(r_place), -LAST_ID)
        r_place = np.concatenate([np.arange(len(own)), r_place])
        r_first = np.concatenate([np.zeros(len(own), np.int64), r_first])
        r_last = np.concatenate([lengths - WINDOW, r_last])
        r_id = np.concatenate([own, r_id])
        by = np.argsort(r_place, kind="stable")
        r_place, r_first, r_last, r_id = r_place[by], r_first[by], r_last[by], r_id[by]
        names = named(sums, inverse, begins, stops - WINDOW)
        runs_of = np.searchsorted(r_place, np.arange(len(lengths) + 1))
        order = np.lexsort((which, chunk))
        count = runs_of[which[order] + 1] - runs_of[which[order]]
        total = np.cumsum(count)
        cuts = np.unique(np.searchsorted(total, np.arange(0, total[-1], RUNS), side="right"))
        for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
            mine, k = order[a:z], count[a:z]
            asked = np.repeat(mine, k)
            first = np.repeat(runs_of[which[mine]], k)
            run_at = first + np.arange(len(first)) - np.repeat(np.cumsum(k) - k, k)
            use = r_id[run_at] < low[asked]
            if use.any():
                q = run_at[use]
                full, at = np.unique(chunk[asked[use]], return_index=True)
                edges = np.append(at, len(q))
                yield answer(full, names=(names[r_place[q]].astype("<u8"), edges), first=(r_first[q].astype("<u2"), edges), last=(r_last[q].astype("<u2"), edges), least=(r_id[q].astype("<i8"), edges))

    return stretches.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, ANSWERS)


def removed(docs: DataFrame, hot: int = HOT, into: str = "removal") -> DataFrame:
    """The columns of docs and `into`, a struct of kept, the remaining bytes, n_bytes,
    n_removed and spans, the removed byte intervals."""
    spread, n, chunks = chunked(docs)
    spread = spread.withColumn("id", F.col("row")["doc_id"].cast("bigint"))
    buckets = max(n * SPLIT, chunks // 2)

    def ask(table: pa.Table) -> pa.Table:
        found = twice(np.concatenate([Anchored(p).anchors() for _, _, p in parts(texts(table.column("text")))]))
        full, edges = np.unique(bucket_of(found, buckets), return_index=True)
        cuts = [*edges.tolist(), len(found)]
        packed = [found[a:z].astype("<u8").tobytes() for a, z in zip(cuts, cuts[1:], strict=False)]
        return pa.table({"bucket": pa.array(full, pa.int32()), "chunk": pa.array([table.column("chunk")[0].as_py()] * len(full), pa.int64()), "hashes": pa.array(packed, pa.binary())})

    def asked(data: list[bytes], ids: np.ndarray, known: np.ndarray, crowded: np.ndarray) -> Iterator[tuple]:
        """Of some parts of texts: texts, offsets, the parts, and first and last window, key
        and owner of the stretches that another document may have."""
        for which, offset, held in parts(data):
            x = Anchored(held)
            first, last, key = x.stretches(crowded)
            use = within(x.anchor[np.searchsorted(x.at, first)], known) if len(first) else np.zeros(0, bool)
            first, last, key = first[use], last[use], key[use]
            yield which, offset, x, first, last, key, ids[which[np.searchsorted(x.starts, first, side="right") - 1]]

    def send(table: pa.Table, answers: pa.Table) -> pa.Table:
        known, crowded = np.sort(gathered(answers, "hashes", "<u8")), np.sort(gathered(answers, "hot", "<u8"))
        names = ["bucket", "chunk", "data", "lengths", "least"]
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        best: dict[bytes, tuple[int, int]] = {}
        for _, _, x, first, last, key, owner in asked(texts(table.column("text")), ids_of(table), known, crowded) if len(known) else ():
            bucket = bucket_of(mix(key), buckets)
            for s, e, i, k in zip(first.tolist(), (last + WINDOW).tolist(), owner.tolist(), bucket.tolist(), strict=True):
                p = x.bytes[s:e]
                old = best.get(p)
                if old is None or i < old[0]:
                    best[p] = i, k
        by: dict[int, list[bytes]] = {}
        for p, (_, k) in best.items():
            by.setdefault(k, []).append(p)
        chunk = table.column("chunk")[0].as_py() if table.num_rows else 0
        rows = [(k, chunk, b"".join(ps), np.array([len(p) for p in ps], "<u2").tobytes(), np.array([best[p][0] for p in ps], "<i8").tobytes()) for k, ps in by.items()]
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        data, ids = texts(table.column("text")), ids_of(table)
        name, r_first, r_last, least = gathered(answers, "names", "<u8"), gathered(answers, "first", "<u2").astype(np.int64), gathered(answers, "last", "<u2").astype(np.int64), gathered(answers, "least", "<i8")
        order = np.argsort(name, kind="stable")
        name, r_first, r_last, least = name[order], r_first[order], r_last[order], least[order]
        # the least id of a stretch in the chunk itself, wherever in it it lies
        pieces = []
        for which, offset, x, first, last, _, owner in asked(data, ids, np.sort(gathered(answers, "hashes", "<u8")), np.sort(gathered(answers, "hot", "<u8"))):
            pieces.append((which, offset, first, last, owner, x.named(first, last), x.starts))
        every = np.concatenate([np.zeros(0, U64), *[p[5] for p in pieces]])
        names, inverse = np.unique(every, return_inverse=True)
        low = np.full(len(names), LAST_ID, np.int64)
        if len(every):
            np.minimum.at(low, inverse, np.concatenate([p[4] for p in pieces]))
        gone: dict[int, np.ndarray] = {}
        at = 0
        for which, offset, first, last, owner, _, starts in pieces:
            mine = inverse[at : at + len(first)]
            at += len(first)
            marks = np.zeros(int(starts[-1]) + 1, np.int32)
            whole = np.flatnonzero(low[mine] < owner)
            np.add.at(marks, first[whole], 1)
            np.add.at(marks, last[whole] + WINDOW, -1)
            lo, hi = np.searchsorted(name, names[mine], side="left"), np.searchsorted(name, names[mine], side="right")
            count = hi - lo
            s = np.repeat(np.arange(len(first)), count)
            q = np.repeat(lo, count) + np.arange(len(s)) - np.repeat(np.cumsum(count) - count, count)
            use = least[q] < owner[s] if len(q) else np.zeros(0, bool)
            np.add.at(marks, first[s[use]] + r_first[q[use]], 1)
            np.add.at(marks, first[s[use]] + r_last[q[use]] + WINDOW, -1)
            hit = np.cumsum(marks[:-1]) > 0
            for k in np.unique(np.searchsorted(starts, np.flatnonzero(hit), side="right") - 1).tolist():
                i, a = int(which[k]), int(offset[k])
                g = gone.setdefault(i, np.zeros(len(data[i]), bool))
                g[a : a + int(starts[k + 1] - starts[k])] |= hit[starts[k] : starts[k + 1]]
        kept, spans = [], []
        for i, t in enumerate(data):
            g = gone.get(i)
            if g is None:
                kept.append(t)
                spans.append([])
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[0], g.astype(np.int8), [0]]))).tolist()
            spans.append([{"start": u, "end": v} for u, v in zip(edges[::2], edges[1::2], strict=True)])
            kept.append(np.frombuffer(t, np.uint8)[~g].tobytes())
        sizes = [[len(t) for t in data], [len(t) - len(k) for t, k in zip(data, kept, strict=True)]]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        made = pa.StructArray.from_arrays([pa.array(kept, pa.binary()), pa.array(sizes[0], pa.int64()), pa.array(sizes[1], pa.int64()), pa.array(spans, kind)], names=["kept", "n_bytes", "n_removed", "spans"])
        return pa.table([table.column("row"), table.column("text"), table.column("copies"), made], names=["row", "text", "copies", "made"])

    anchors = answered(spread.groupBy("chunk").applyInArrow(ask, "bucket int, chunk bigint, hashes binary"), n, hot)
    stretches = spread.groupBy("chunk").cogroup(anchors.groupBy("chunk")).applyInArrow(send, STRETCHES)
    answers = anchors.unionByName(least_ids(stretches, n))
    schema = T.StructType([*[spread.schema[c] for c in ("row", "text", "copies")], *T.StructType.fromDDL("made struct<kept: binary, n_bytes: bigint, n_removed: bigint, spans: array<struct<start: int, end: int>>>").fields])
    return restored(spread.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, schema), docs, into)


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = removed(read(spark, sf_dir).select("doc_id", "text")).select("doc_id", "removal.*")
    return d.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS doc, doc_id, hex(coalesce(text, '')) AS bytes FROM documents),
b AS (SELECT doc, doc_id, pos, substr(bytes, 2 * pos - 1, 2) AS byte, CASE WHEN 2 * (pos + {WINDOW - 1}) <= length(bytes) THEN md5(substr(bytes, 2 * pos - 1, {2 * WINDOW})) END AS name
  FROM (SELECT *, unnest(range(1, length(bytes) // 2 + 1)) AS pos FROM d)),
again AS (SELECT doc, pos, byte, name IS NOT NULL AND coalesce(min(doc_id) OVER (PARTITION BY name) < doc_id, false) OR name IS NOT NULL AND doc_id IS NULL AND min(doc_id) OVER (PARTITION BY name) IS NOT NULL AS hit FROM b),
marked AS (SELECT doc, pos, byte, max(hit::INT) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM again),
runs AS (SELECT *, lag(gone, 1, 0) OVER (PARTITION BY doc ORDER BY pos) AS before FROM marked),
kept AS (SELECT doc, sum(gone)::BIGINT AS n_removed, sum((gone > before)::INT)::BIGINT AS n_spans, string_agg(byte, '' ORDER BY pos) FILTER (WHERE gone = 0) AS kept FROM runs GROUP BY doc)
SELECT doc_id, (length(bytes) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc = d.doc"""
