"""Byte-pair encoding as a streaming transducer with bounded lookahead, and its inverse.

Encoding. A text is cut into words by the vocabulary's word pattern, and each word's bytes
are merged by rank. What lies more than `lookahead` bytes to the right of a token can't
change it. That bound follows from the merge list: a merge at a token's end is lost only to
a stronger merge that takes its right part away, and that one only to a still stronger one,
so the longest chain of ever stronger merges, in bytes, suffices (`Vocabulary.lookahead`).
Every text goes through a `Transducer`, CHUNK characters at a time: it emits the tokens of
words that surely ended, and within a word with no end in sight those that end that far
before what it has seen, so it holds a chunk and a window of bytes however long a text or a
word is. The words of a piece of input that no memo entry covers are merged together; the
memo keeps those that came more than once and is bounded by its bytes.

Decoding. Token bytes go through an incremental UTF-8 machine that holds the one to three
bytes of an unfinished character; bytes that are no UTF-8 become U+FFFD.

Rows: a null text is encoded as the empty text (no tokens); null ids decode to the empty
text. Every row stands for itself, so repeated rows, ties and null ids of documents need
nothing special, an empty table gives an empty table, and columns named like an output are
replaced by it.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keystrata.llm.common import pieces, read, sha256

VOCABULARY = "byte_bpe_50k.json"
#: Bytes of a Python worker's memo, as estimated; a full one is emptied.
MEMO_BYTES = 32 << 20
#: What an entry takes besides its letters and ids.
ENTRY_BYTES = 200
#: Bytes of text whose words are merged together.
PIECE = 4 << 20
#: Characters, or tokens, that go through a machine at once.
CHUNK = 1 << 16
#: Bytes of a word above which it goes through the windowed merge.
LONG = 512
PAIR_MIX = 2654435769
#: An id that no token has.
PAD = 0xFFFF
#: The rank of a pair that no merge joins.
NONE = 1 << 30
#: Code points of Unicode's White_Space.
SPACE = "\t-\r \x85\xa0  -     　"

WHITE = frozenset(re.findall(f"[{SPACE}]", "".join(map(chr, range(0x3001)))))


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Letters and numbers of Unicode 16, which the vocabulary's library goes by, that Python's own
#: tables may not have yet.
NEWER = {
    "L": ((0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)),
    "N": ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)),
}


@cache
def classes() -> tuple[str, str]:
    """Letters and numbers as ranges of a pattern; worked out once and sent to the workers."""
    out = []
    for major in "LN":
        newer = {c for a, b in NEWER[major] for c in range(a, b + 1)}
        ranges: list[list[int]] = []
        for c in range(0x110000):
            if unicodedata.category(chr(c))[0] == major or c in newer:
                if ranges and ranges[-1][1] == c - 1:
                    ranges[-1][1] = c
                else:
                    ranges.append([c, c])
        out.append("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges))
    return out[0], out[1]


def _byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Token ids, token bytes and merges of a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        letters = _byte_letters()
        ids: dict[str, int] = d["model"]["vocab"]
        to_bytes = lambda t: bytes(letters[c] for c in t)
        self.special = {a["content"]: a["id"] for a in d["added_tokens"]}
        self.bytes: list[bytes] = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for t, i in ids.items():
            self.bytes[i] = to_bytes(t) if t not in self.special else t.encode()
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.of_byte = [0] * 256
        for t, i in ids.items():
            if len(t) == 1:
                self.of_byte[letters[t]] = i
        self.parts = [(ids[a], ids[b], ids[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in d["model"]["merges"])]
        if len(self.bytes) > 1 << 16:
            raise ValueError("more ids than two bytes hold")
        self.pair = {a << 16 | b: r for r, (a, b, _) in enumerate(self.parts)}.get
        self.merged = [c for _, _, c in self.parts]
        self._lookahead: int | None = None

    @property
    def lookahead(self) -> int:
        """Bytes after a token's end that can still change it.

        needs[r]: bytes right of the left part that decide whether merge r happens, which
        are its right part and what can take that part's end away before: merges of higher
        rank with that part, or with a token at the end of its derivation, at their left.
        """
        if self._lookahead is None:
            ranks: dict[int, list[int]] = {}
            most: dict[int, list[int]] = {}
            spine: dict[int, int] = {}

            def reach(token: int, below: int) -> int:
                i = bisect_left(ranks.get(token, ()), below)
                return most[token][i - 1] if i else 0

            for r, (a, b, c) in enumerate(self.parts):
                needs = len(self.bytes[b]) + max(reach(b, r), spine.get(b, 0))
                ranks.setdefault(a, []).append(r)
                m = most.setdefault(a, [])
                m.append(max(needs, m[-1] if m else 0))
                spine[c] = max(spine.get(c, 0), reach(b, r), spine.get(b, 0))
            self._lookahead = max([0, *[m[-1] for m in most.values()], *spine.values()])
        return self._lookahead

    def merge(self, word: bytes) -> list[int]:
        """The tokens of a whole word, by rank and then from the left."""
        if len(word) > 64:
            return self._merge_heap(word)
        pair, merged = self.pair, self.merged
        ids = [self.of_byte[b] for b in word]
        ranks = [pair(a << 16 | b, NONE) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (r := min(ranks)) != NONE:
            i = ranks.index(r)
            ids[i] = merged[r]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = pair(ids[i - 1] << 16 | ids[i], NONE)
            if i < len(ranks):
                ranks[i] = pair(ids[i] << 16 | ids[i + 1], NONE)
        return ids

    def _table(self) -> tuple[np.ndarray, np.ndarray, int, int]:
        """The pairs in an open-addressed hash table, with the longest probe."""
        if not hasattr(self, "_hashed"):
            bits = max(8, (4 * len(self.parts)).bit_length())
            keys, ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int64)
            longest = 1
            for r, (a, b, _) in enumerate(self.parts):
                k = a << 16 | b
                at, probe = (k * PAIR_MIX & 0xFFFFFFFF) >> (32 - bits), 1
                while keys[at] >= 0:
                    at, probe = (at + 1) & ((1 << bits) - 1), probe + 1
                keys[at], ranks[at], longest = k, r, max(longest, probe)
            self._hashed = keys, ranks, bits, longest
        return self._hashed

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys, ranks, bits, longest = self._table()
        k = a.astype(np.int64) << 16 | b
        at = (k * PAIR_MIX & 0xFFFFFFFF) >> (32 - bits)
        out = np.where(keys[at] == k, ranks[at], NONE)
        open_ = np.flatnonzero((out == NONE).ravel() & (keys[at] >= 0).ravel())
        flat, k1, at1 = out.reshape(-1), k.reshape(-1)[open_], at.reshape(-1)[open_]
        for _ in range(longest - 1):
            at1 = (at1 + 1) & ((1 << bits) - 1)
            hit = keys[at1] == k1
            flat[open_[hit]] = ranks[at1[hit]]
        return out

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """merge() of many words at once, as packed ids: each round merges the best pair of
        every word that still has one."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        of = np.array(self.of_byte, np.int32)
        merged = np.array(self.merged, np.int32)
        low = 0
        for width in (8, 16, 32):
            rows = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            if not len(rows):
                continue
            col = np.arange(width)
            ids = of[np.frombuffer(b"".join([words[i].ljust(width, b"\0") for i in rows.tolist()]), np.uint8).reshape(-1, width)]
            ids[col >= sizes[rows][:, None]] = PAD
            ranks = self._ranks(ids[:, :-1], ids[:, 1:])
            while len(rows):
                at = ranks.argmin(1)
                n = np.arange(len(rows))
                best = ranks[n, at]
                done = best == NONE
                if done.any():
                    end = ids[done]
                    keep = end != PAD
                    blob, ends = end[keep].astype("<i4").tobytes(), np.cumsum(keep.sum(1) * 4).tolist()
                    for i, a, b in zip(rows[done].tolist(), [0, *ends], ends, strict=False):
                        out[i] = blob[a:b]
                    go = ~done
                    rows, ids, ranks, at, best = rows[go], ids[go], ranks[go], at[go], best[go]
                    n = np.arange(len(rows))
                if not len(rows):
                    break
                ids[:, 1:-1] = np.where(col[1:-1] > at[:, None], ids[:, 2:], ids[:, 1:-1])
                ids[:, -1] = PAD
                ids[n, at] = merged[best]
                ranks[:, :-1] = np.where(col[:-2] > at[:, None], ranks[:, 1:], ranks[:, :-1])
                ranks[:, -1] = NONE
                right = np.minimum(at + 1, width - 1)
                ranks[n, np.minimum(at, width - 2)] = np.where(at < width - 1, self._ranks(ids[n, at], ids[n, right]), NONE)
                left = np.flatnonzero(at > 0)
                ranks[left, at[left] - 1] = self._ranks(ids[left, at[left] - 1], ids[left, at[left]])
        for i in np.flatnonzero(sizes > low).tolist():
            out[i] = array("i", self.merge(words[i])).tobytes()
        return out

    def _merge_heap(self, word: bytes) -> list[int]:
        pair = self.pair
        ids: list[int] = [self.of_byte[b] for b in word]
        n = len(ids)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pair(ids[i] << 16 | ids[i + 1], NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i] = self.merged[r]
            ids[j] = -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            for left in (prv[i], i):
                if left >= 0 and (right := nxt[left]) < n and (r := pair(ids[left] << 16 | ids[right], NONE)) != NONE:
                    heapq.heappush(heap, (r, left, ids[left], ids[right]))
        return [t for t in ids if t >= 0]


class WordMerger:
    """The merge of one word whose bytes come in pieces; holds a window of them."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.held = vocabulary, b""
        self.window = max(4096, 4 * vocabulary.lookahead)

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        for at in range(0, len(data), self.window):
            self.held += data[at : at + self.window]
            if len(self.held) >= self.window:
                out += self._stable()
        return out

    def _stable(self) -> list[int]:
        out, end, limit = [], 0, len(self.held) - self.v.lookahead
        for t in self.v.merge(self.held):
            if end + len(self.v.bytes[t]) > limit:
                break
            end += len(self.v.bytes[t])
            out.append(t)
        self.held = self.held[end:]
        return out

    def finish(self) -> list[int]:
        out, self.held = self.v.merge(self.held), b""
        return out


class Encoder:
    """What the transducers of a worker share: patterns, the vocabulary and the memo."""

    def __init__(self, vocabulary: Vocabulary, kinds: tuple[str, str] | None = None):
        self.v = vocabulary
        letter, number = kinds or classes()
        self.word = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{SPACE}{letter}{number}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
        #: Characters that go on in a word of their kind.
        self.kinds = [re.compile(f"[{x}]*") for x in (letter, number, f"^{SPACE}{letter}{number}")]
        # a space with a visible character after it always begins a word
        self.cut, self.odd = re.compile(rf" (?=[^{SPACE}])"), re.compile(rf" [{SPACE}]| \Z")
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None
        self.memo = _Memo(self)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as little-endian 32-bit words."""
        t = Transducer(self)
        out = [t.feed(text[at : at + CHUNK]) for at in range(0, len(text), CHUNK)]
        return b"".join([*out, t.finish()])

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """encode() of each text; their unknown words are merged together before."""
        once = self.learn(texts)
        for t in texts:
            yield self.encode(t)
        for k in once:
            self.memo.pop(k, None)
        self.memo.bound()

    def learn(self, texts: list[str]) -> list[str]:
        """Merge the words of the texts; those that came once only are returned."""
        seen: Counter[str] = Counter()
        for t in texts:
            for at in range(0, len(t), CHUNK):
                seen.update(self.parts(t[at : at + CHUNK])[1:])
        new = [k for k in seen if k not in self.memo and len(k) <= 64]
        if not new:
            return []
        found: list[list[str]] = []
        for w in self.word.findall(" " + " ".join(new)):
            if w[0] == " " and len(w) > 1 and w[1] not in WHITE:
                found.append([w])
            else:
                found[-1].append(w)
        if len(found) != len(new):  # no part would be one of its own, so this can't be
            raise AssertionError("word parts")
        words = list({w for f in found for w in f})
        ids = dict(zip(words, self.v.merge_many([w.encode() for w in words]), strict=True))
        for k, f in zip(new, found, strict=True):
            self.memo[k] = b"".join([ids[w] for w in f])
        return [k for k in new if seen[k] == 1]

    def merged(self, word: str) -> bytes:
        data = word.encode()
        if len(data) <= LONG:
            return array("i", self.v.merge(data)).tobytes()
        m = WordMerger(self.v)
        return array("i", m.feed(data) + m.finish()).tobytes()

    def parts(self, text: str) -> list[str]:
        return self.cut.split(text) if self.odd.search(text) else text.split(" ")

    def words(self, text: str) -> bytes:
        """Ids of characters that end where a word does. All parts but the first had a space
        before them, which begins their first word."""
        parts = self.parts(text)
        first = b"".join(map(self.merged, self.word.findall(parts[0])))
        return first + b"".join(map(self.memo.__getitem__, parts[1:]))


class _Memo(dict):
    """Ids of what follows a space up to the next one. Others are worked out, not kept."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, part: str) -> bytes:
        return b"".join(map(self.encoder.merged, self.encoder.word.findall(" " + part)))

    def bound(self) -> None:
        if len(self) * ENTRY_BYTES > MEMO_BYTES:
            self.clear()


class Transducer:
    """The encoder of one text that comes in chunks. Held at any time: a chunk, the
    characters since the last sure word end, and of a word with no end in sight only the
    window of its merge."""

    def __init__(self, encoder: Encoder):
        self.e, self.held, self.open, self.kind = encoder, "", None, None
        #: The longest end of the text so far that may begin a special token.
        self.tail = ""
        self.longest = max(map(len, encoder.v.special), default=0)

    def feed(self, chunk: str) -> bytes:
        """The ids that are certain by now and have not been given yet."""
        if not self.longest:
            return self._plain(chunk)
        chunk, out = self.tail + chunk, []
        parts = self.e.specials.split(chunk)
        for plain, special in zip(parts[::2], parts[1::2], strict=False):
            out += [self._plain(plain), self._end(), array("i", [self.e.v.special[special]]).tobytes()]
        rest = parts[-1]
        keep = next((k for k in range(min(len(rest), self.longest - 1), 0, -1) if any(s.startswith(rest[-k:]) for s in self.e.v.special)), 0)
        self.tail = rest[len(rest) - keep :]
        return b"".join([*out, self._plain(rest[: len(rest) - keep])])

    def finish(self) -> bytes:
        rest, self.tail = self.tail, ""
        return self._plain(rest) + self._end()

    def _plain(self, chunk: str) -> bytes:
        e, out = self.e, []
        held = self.held + chunk
        while True:
            if self.open is not None:
                run = self.kind.match(held).end()
                if run < len(held) - 1:  # the word ends here
                    out.append(array("i", self.open.feed(held[:run].encode()) + self.open.finish()).tobytes())
                    held, self.open = held[run:], None
                    continue
                keep = max(0, run - 1)
                out.append(array("i", self.open.feed(held[:keep].encode())).tobytes())
                held = held[keep:]
                break
            sure = held.rfind(" ")
            while sure > 0 and (sure + 1 == len(held) or held[sure + 1] in WHITE):
                sure = held.rfind(" ", 0, sure)
            if sure > 0:
                out.append(e.words(held[:sure]))
                held = held[sure:]
            if len(held) <= CHUNK:
                break
            done, last = 0, None
            for m in e.word.finditer(held):  # no sure end in a chunk: end words one by one
                if m.end() + 3 > len(held):
                    last = m
                    break
                out.append(e.merged(m.group()))
                done = m.end()
            held = held[done:]
            if last is None or len(held) <= LONG:
                break
            probe = held[1] if held[0] == " " else held[0]
            # a run of spaces is short of a word until it ends
            self.kind = next((k for k in e.kinds if k.match(probe).end()), None)
            if self.kind is None:
                break
            self.open = WordMerger(e.v)
            if held[0] == " ":
                out.append(array("i", self.open.feed(b" ")).tobytes())
                held = held[1:]
        self.held = held
        return b"".join(out)

    def _end(self) -> bytes:
        held, out = self.held, []
        if self.open is not None:
            run = self.kind.match(held).end()
            out.append(array("i", self.open.feed(held[:run].encode()) + self.open.finish()).tobytes())
            held, self.open = held[run:], None
        self.held = ""
        return b"".join([*out, self.e.words(held)])


class TextMachine:
    """Token bytes to text, holding the bytes of an unfinished character only."""

    def __init__(self, vocabulary: Vocabulary):
        self.bytes = vocabulary.bytes
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        return self.machine.decode(b"".join(map(self.bytes.__getitem__, ids)))

    def finish(self) -> str:
        out = self.machine.decode(b"", final=True)
        self.machine.reset()
        return out


_loaded: dict[str, Encoder] = {}


def encoder(path: str, kinds: tuple[str, str] | None = None) -> Encoder:
    """The worker's encoder for a vocabulary, with its memo."""
    if path not in _loaded:
        _loaded[path] = Encoder(Vocabulary(path), kinds)
    return _loaded[path]


def _tokens(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<i4")


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int32)))


def _mapped(df: DataFrame, column: str, keep: list[str], made: list[T.StructField], of_piece: Callable[[pa.Array], Iterator[list[pa.Array]]], cut: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> DataFrame:
    """The columns `keep` and those that of_piece makes from each piece of a column."""
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in cut(whole):
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(n)], *of_piece(b.column(n))], names=[*[f"k{i}" for i in range(n)], *[f"m{i}" for i in range(len(made))]])

    given = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{column}`").alias("_in"))
    schema = T.StructType([*[T.StructField(f"k{i}", df.schema[c].dataType) for i, c in enumerate(keep)], *[T.StructField(f"m{i}", f.dataType) for i, f in enumerate(made)]])
    return given.mapInArrow(run, schema).toDF(*keep, *[f.name for f in made])


def _text_pieces(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return pieces(b, "_in", PIECE)


def _list_pieces(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Cut by the number of ids, of which each is a few bytes of text."""
    sizes = pa.compute.fill_null(pa.compute.list_value_length(b.column("_in")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    edges = np.flatnonzero(np.diff(np.cumsum(sizes) // (PIECE // 4))) + 1
    start = 0
    for end in [*edges.tolist(), b.num_rows]:
        if end > start:
            yield b.slice(start, end - start)
        start = end


def _strings(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def _decoded(machine: TextMachine, ids: np.ndarray) -> Iterator[str]:
    for at in range(0, len(ids), CHUNK):
        yield machine.feed(ids[at : at + CHUNK].tolist())
    yield machine.finish()


IDS = T.StructField("ids", T.ArrayType(T.IntegerType()))


def encode(df: DataFrame, text: str = "text", ids: str = "ids", keep: list[str] | None = None, path: str | None = None) -> DataFrame:
    """The columns `keep` (default: all) and `ids`, array<int>."""
    path, kinds = path or vocabulary_path(), classes()

    def of_piece(column: pa.Array) -> list[pa.Array]:
        return [_lists([_tokens(x) for x in encoder(path, kinds).encode_all(_strings(column))])]

    return _mapped(df, text, [c for c in (df.columns if keep is None else keep) if c != ids], [T.StructField(ids, IDS.dataType)], of_piece, _text_pieces)


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", keep: list[str] | None = None, path: str | None = None) -> DataFrame:
    """The columns `keep` (default: all) and `text`."""
    path, kinds = path or vocabulary_path(), classes()

    def of_piece(column: pa.Array) -> list[pa.Array]:
        machine = TextMachine(encoder(path, kinds).v)
        return [pa.array(["" if x.values is None else "".join(_decoded(machine, x.values.to_numpy())) for x in column], pa.string())]

    return _mapped(df, ids, [c for c in (df.columns if keep is None else keep) if c != text], [T.StructField(text, T.StringType())], of_piece, _list_pieces)


def round_trip(df: DataFrame, text: str = "text", keep: list[str] | None = None, path: str | None = None) -> DataFrame:
    """The columns `keep` (default: all), `ids` and `decoded_sha256`, the digest of what the
    ids decode to: encode() and decode() of a document in one step, so that its ids need
    not go to another worker and its decoded text is never there as a whole."""
    path, kinds = path or vocabulary_path(), classes()

    def of_piece(column: pa.Array) -> list[pa.Array]:
        e = encoder(path, kinds)
        machine, arrays, digests = TextMachine(e.v), [], []
        for blob in e.encode_all(_strings(column)):
            arrays.append(_tokens(blob))
            digest = hashlib.sha256()
            for t in _decoded(machine, arrays[-1]):
                digest.update(t.encode())
            digests.append(digest.hexdigest())
        return [_lists(arrays), pa.array(digests, pa.string())]

    return _mapped(df, text, [c for c in (df.columns if keep is None else keep) if c not in ("ids", "decoded_sha256")], [IDS, T.StructField("decoded_sha256", T.StringType())], of_piece, _text_pieces)


def digests(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    done = round_trip(documents.select("doc_id", "text"), keep=["doc_id"], path=path)
    return done.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), sha256(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"), "decoded_sha256")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir))
