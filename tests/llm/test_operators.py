"""Each query against a brute-force version, on rows of every awkward kind."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from keystrata.llm import bpe, fingerprint, graph, near, sharding, simhash, suffix, urls
from keystrata.llm.registry import LLM_ORACLES, LLM_QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def same(df, want: list[tuple], columns: list[str]) -> None:
    assert Counter(tuple(r) for r in df.select(*columns).collect()) == Counter(want)


@pytest.mark.parametrize("name", sorted(LLM_QUERIES))
def test_empty_tables(spark, empty, name):
    assert LLM_QUERIES[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
@pytest.mark.parametrize("table", ["small", "given"])
def test_same_as_sql(spark, small, name, table):
    from compare import connect
    from compare import same as same_rows

    d = small if table == "small" else "/root/testdata/sf0.001"
    if table == "given":
        con = connect(d)
    else:
        import duckdb

        con = duckdb.connect()
        for t in ("documents", "pages"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    same_rows(LLM_QUERIES[name](spark, d), con, LLM_ORACLES[name])


def test_bpe_is_the_library(spark, small, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary_path())
    want = []
    for i, x, *_ in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha(t.decode(ids, skip_special_tokens=False).encode())))
    same(LLM_QUERIES["op1_bpe"](spark, small), want, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def test_bpe_stream_needs_no_more_than_its_lookahead(texts):
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(bpe.vocabulary_path()), bpe.encoder(bpe.vocabulary_path())
    assert 0 < e.v.lookahead < 1000
    for x in [*filter(None, texts), "ab" * 40_000, " " * 70_000 + "x", "=-" * 40_000]:
        want = t.encode(x, add_special_tokens=False).ids
        for n in (1, 7, 5000) if len(x) < 3000 else (5000,):
            m = bpe.Transducer(e)
            got = b"".join([*[m.feed(x[i : i + n]) for i in range(0, len(x), n)], m.finish()])
            assert np.frombuffer(got, "<i4").tolist() == want
    word = b"etaoinshrdlu" * 3000
    m = bpe.WordMerger(e.v)
    held = 0
    out = []
    for i in range(0, len(word), 1000):
        out += m.feed(word[i : i + 1000])
        held = max(held, len(m.held))
    assert out + m.finish() == e.v.merge(word) and held <= 2 * m.window


def test_bpe_on_random_strings():
    import random

    from tokenizers import Tokenizer

    t, e, r = Tokenizer.from_file(bpe.vocabulary_path()), bpe.encoder(bpe.vocabulary_path()), random.Random(1)
    # letters and numbers that only newer tables know among them
    letters = ["\ua7cb", "\U000105c0", "\U00010d40", "\U0001e5f1", "'", "s", "ll", "a", " ", "  ", "\n", "\xa0", "9", "é", "中", "!", "🙂", "<|endoftext|>", "<|endo", "\u0558", "\x1c"]
    for _ in range(5000):
        x, n = "".join(r.choice(letters) for _ in range(r.randint(1, 14))), r.randint(1, 4)
        want, m = t.encode(x, add_special_tokens=False).ids, bpe.Transducer(e)
        assert np.frombuffer(e.encode(x), "<i4").tolist() == want, x
        assert np.frombuffer(b"".join([*[m.feed(x[i : i + n]) for i in range(0, len(x), n)], m.finish()]), "<i4").tolist() == want, x


def test_bpe_columns_and_memo(spark, texts, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_BYTES", 0)
    d = spark.createDataFrame([(i, x, "kept", "gone") for i, x in enumerate(texts)], "doc_id bigint, text string, _in string, ids string")
    out = bpe.decode(bpe.encode(d)).collect()
    assert [(r.text or "") == r.decoded and r._in == "kept" for r in out] == [True] * len(texts)
    both = {r.doc_id: r for r in bpe.round_trip(d).collect()}
    assert all(both[r.doc_id].ids == r.ids and both[r.doc_id].decoded_sha256 == sha(r.decoded.encode()) for r in out)


def test_text_machine_on_broken_bytes():
    m = bpe.TextMachine(bpe.encoder(bpe.vocabulary_path()).v)
    ids = [m.bytes.index(bytes([b])) for b in b"\xe4\xb8a\xff\xf0\x9f\x99\x82"]
    assert "".join(m.feed([i]) for i in ids) + m.finish() == b"\xe4\xb8a\xff\xf0\x9f\x99\x82".decode("utf-8", "replace")


def test_shards(spark, small, rows):
    out = LLM_QUERIES["op2_sharding"](spark, small).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len((x or "").encode()) + 16, zlib.crc32((x or "").encode())) for i, x, *_ in rows)
    per = defaultdict(list)
    for r in out:
        per[r.shard].append(r.slot)
    counts = [len(per[s]) for s in range(40)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in per.values())


def test_shards_are_the_permuted_numbers(spark, small, rows):
    """Numbers, Feistel rounds and cycle walking in plain Python."""
    import math

    p = sharding.P
    said = [(i, len((x or "").encode()) + 16, zlib.crc32((x or "").encode())) for i, x, *_ in rows]
    bucket = lambda i, size, crc: ((i or 0) % p * 48271 + size * 16807 + crc) % p * 69621 % p % sharding.BUCKETS
    order = sorted(said, key=lambda r: (bucket(*r), r[0] is not None, r[0] or 0, r[1], r[2]))
    n = len(order)
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)

    def walked(v: int) -> int:
        left, right = v % a, v // a
        for k, (m, c) in enumerate(sharding.KEYS):
            y = ((right if k % 2 == 0 else left) * m + c) % p
            y = (y * y + c % 65537) % p
            if k % 2 == 0:
                left = (left + y) % a
            else:
                right = (right + y) % b
        v = left + right * a
        return v if v < n else walked(v)

    want = Counter((*r, walked(k) % 40, walked(k) // 40) for k, r in enumerate(order))
    got = LLM_QUERIES["op2_sharding"](spark, small).select("doc_id", "size", "text_crc32", "shard", "slot").collect()
    assert Counter(map(tuple, got)) == want


def test_shards_are_written_in_slot_order(spark, small, rows, tmp_path):
    sharding.write_shards(spark.read.parquet(f"{small}/documents.parquet"), str(tmp_path / "out"), 3)
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter((i, x) for i, x, *_ in rows)
    assert sorted((r.shard, r.slot) for r in out) == [(k % 3, k // 3) for s in range(3) for k in range(s, len(rows), 3)]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40, 1000, 5003])
def test_permutation(spark, n):
    from keystrata.llm.sharding import permuted

    d = permuted(spark.range(n).selectExpr("id", f"{n}L AS total"), "id", "total", "p")
    assert sorted(r.p for r in d.collect()) == list(range(n))


def brute_fp(t: str | None) -> int:
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x.encode()) for x in WORD.findall(t or "")]
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum((2 * sum(h >> b & 1 for h in hs) > len(hs)) << b for b in range(64))


def components(edges: list[tuple], nodes) -> dict:
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_simhash(spark, small, rows):
    fps = {i: brute_fp(x) for i, x, *_ in rows}
    ids = sorted(x for x in fps if x is not None)
    c = components([(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 2], ids)
    same(LLM_QUERIES["op3_simhash"](spark, small).filter("doc_id IS NOT NULL"), [(i, f"{fps[i]:016x}", c[i]) for i, *_ in rows if i is not None], ["doc_id", "fingerprint", "component_id"])


@pytest.mark.parametrize("crowd", [2, 64])
def test_links_are_all_pairs(spark, crowd):
    import random

    r = random.Random(3)
    xs = [r.getrandbits(64) for _ in range(60)]
    xs += [x ^ 1 << r.randrange(64) ^ (1 << r.randrange(64)) for x in xs for _ in range(3)] + [1 << i for i in range(40)] + [0]
    signed = sorted({x - (1 << 64) if x >> 63 else x for x in xs})
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    got = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp bigint"), crowd=crowd).collect()
    assert {(min(r), max(r)) for r in got} == want


def test_simhash_asks_are_not_broadcast(spark, tmp_path):
    # a file of some kB, of which the asks are some 33 times the rows
    spark.range(2000).selectExpr("xxhash64(id) AS fp").write.parquet(str(tmp_path / "fp"))
    plan = simhash.links(spark.read.parquet(str(tmp_path / "fp")))._jdf.queryExecution().sparkPlan().toString()
    met = [x for x in plan.split("\n") if "bit_count" in x]
    assert len(met) == 2 and all("SortMergeJoin" in x for x in met)


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(200, 200), (5, 5), (300, 299), (299, 300)]
    got = dict(graph.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect())
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 140), 100), 299: 299, 300: 299}


def test_urls(spark, small):
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in LLM_QUERIES["op4_urls"](spark, small).collect()}
    assert got[1] == ("sub.example.org", "/en/12", "example.org/en/1", "block")
    assert got[2] == ("example.org", "/es/a", "example.org/es/", "block")
    assert got[3][:3] == ("", "", None) and got[4][:3] == ("", "", None) and got[8][:3] == ("", "", None)
    assert got[5] == ("a.com", "/de/z", "com/de/", "block")
    assert got[6][3] == "block" and got[7] == ("Ünï.com", "/fr/x", "com/fr/", "allow")


def test_url_scores(spark):
    """Long, empty and odd URLs against the sum in plain Python, and a held-out third of the labels."""
    rows = [(1, "http://a.example/" + "x🙂é/" * 30_000), (2, "http://🙂🙂.example/\U0001f600?q"), (3, "http://a\nb/c\nd"), (4, "http:///"), (5, "http://h"), (6, ""), (7, None)]
    bias, w = urls.model()
    for r in urls.filtered(spark.createDataFrame(rows, "page_id bigint, url string")).collect():
        marks = urls.buckets(urls.marked(r.host, r.path))
        assert r.score == (bias * len(marks) + sum(w[k] for k in marks) if r.host or r.path else bias), r.page_id
        assert r.rule or r.verdict == ("block" if r.score > 0 else "allow")
    labels, right = urls.URL_LABELS, 0
    for k in range(3):
        urls.URL_LABELS = tuple(x for i, x in enumerate(labels) if i % 3 != k)
        urls.model.cache_clear()
        bias, w = urls.model()
        for h, p, y in labels[k::3]:
            marks = urls.buckets(urls.marked(h, p))
            right += (bias * len(marks) + sum(w[m] for m in marks) > 0) == bool(y)
    urls.URL_LABELS = labels
    urls.model.cache_clear()
    assert right / len(labels) > 0.85


def test_substring(spark, small, rows):
    words = [WORD.findall(x or "") for _, x, *_ in rows]
    n = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    want = []
    for (i, *_), w in zip(rows, words, strict=True):
        gone = {p for s in range(len(w) - 34) if n[tuple(w[s : s + 35])] > 1 for p in range(s, s + 35)}
        want.append((i, len(w), len(gone), sha(" ".join(x for p, x in enumerate(w) if p not in gone).encode())))
    same(LLM_QUERIES["op5_substring"](spark, small), want, ["doc_id", "n_words", "n_removed", "kept_sha256"])


@pytest.mark.parametrize("name", ["substring", "suffix"])
def test_removal_keeps_columns_and_counts_copies(spark, monkeypatch, name):
    from keystrata.llm import common, substring

    monkeypatch.setattr(common, "COPIES", 3)
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text, "c", 1, "r"), (2, "other words " + text, "c", 1, "r"), (3, None, None, None, None), *[(None, None, None, None, None)] * 9, *[(9, text, "c", 2, "x")] * 11, *[(10, "a text that is here ten times and has no repeat " * 2, "", 0, "")] * 10]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, chunk string, n_words int, `row` string").repartition(4)
    module = {"substring": substring, "suffix": suffix}[name]
    out = module.removed(docs)
    assert out.columns == [*docs.columns, "removal"]
    key = lambda r: tuple(r[c] for c in ("doc_id", "chunk", "n_words", "row"))
    assert Counter(map(key, out.collect())) == Counter((a, c, d, e) for a, _, c, d, e in rows)
    gone = {r.doc_id: r.removal.n_removed for r in out.collect()}
    if name == "substring":
        assert gone == {1: 50, 2: 50, 3: 0, None: 0, 9: 50, 10: 0}
    else:
        n = len(text)
        assert gone == {1: 0, 2: n, 3: 0, None: 0, 9: n, 10: 0}


@pytest.mark.parametrize("size", [64, 1000])
def test_long_texts_come_in_parts(spark, small, monkeypatch, size):
    monkeypatch.setattr(suffix, "PIECE", size)
    r = np.random.RandomState(1)
    data = [bytes(r.randint(97, 100, k, np.uint8)) for k in (0, 49, 50, 51, 700, 5000)]
    seen = set()
    for which, offset, held in suffix.parts(data):
        for i, at, part in zip(which.tolist(), offset.tolist(), held, strict=True):
            assert data[i][at : at + len(part)] == part
            for k in range(len(part) - 49):
                assert (i, at + k) not in seen
                seen.add((i, at + k))
    assert seen == {(i, k) for i, t in enumerate(data) for k in range(len(t) - 49)}


def test_a_bucket_answers_in_one_batch():
    # rows are chunks times buckets, so none may cost a batch of its own
    arrays = [np.array([c, 7000, 7000, 8000 + c // 2], "<u8") for c in range(500)]
    out = list(suffix.told(np.arange(500) + 10, arrays, hot=600))
    assert len(out) == 1
    rows = out[0].to_pylist()
    assert [r["chunk"] for r in rows] == list(range(10, 510))
    assert all(np.frombuffer(r["hashes"], "<u8").tolist() == [7000, 8000 + c // 2] for c, r in enumerate(rows))
    assert all(np.frombuffer(r["hot"], "<u8").tolist() == [7000] for r in rows)


def test_windows_with_one_hash_are_told_apart():
    import random

    r = random.Random(5)
    shared = bytes(r.randrange(256) for _ in range(70))
    parts = [bytes(r.randrange(256) for _ in range(k)) + shared for k in (3, 40, 90)] + [bytes(60)]
    data, stops = b"".join(parts), np.cumsum(list(map(len, parts)))
    begins = stops - np.array(list(map(len, parts)))
    sums, inverse = suffix.sums_of(data), suffix.powers(suffix.INVERSE, len(data) + 1)

    def windows(inverse):
        at, place, size = suffix.repeated_windows(data, begins, stops, sums, inverse)
        assert all(begins[p] <= a and a + suffix.WINDOW <= stops[p] for a, p in zip(at, place, strict=True))
        return {frozenset(g.tolist()) for g in np.split(at, np.cumsum(size)[:-1])}

    want = {frozenset(int(stops[p]) - 70 + k for p in range(3)) for k in range(21)} | {frozenset(range(int(begins[3]), int(begins[3]) + 11))}
    assert windows(inverse) == want
    assert windows(inverse * np.uint64(0)) == want


def test_near_copies_go_without_moving_texts(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = spark.createDataFrame([(1, "a copy of a text"), (2, "a copy of a text"), (3, "another")], "doc_id bigint, text string")
        out = near.deduplicated(d)
        plan = out._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
        assert sorted(x.doc_id for x in out.collect()) == [1, 3]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("alphabet", [2, 3, 8])
def test_smaller_ids_are_all_found(alphabet):
    """The repeat groups of a bucket against every window of its stretches."""
    r = np.random.RandomState(alphabet)
    for _ in range(20):
        base = [bytes(r.randint(97, 97 + alphabet, 70, np.uint8)) for _ in range(3)] + [b"a" * 120, b"ab" * 60]
        parts = list({b"".join(base[k][: r.randint(50, 130)] for k in r.randint(0, 5, 2)) for _ in range(12)})
        own = r.randint(0, 6, len(parts))
        lengths = np.array(list(map(len, parts)))
        stops = np.cumsum(lengths)
        first: dict[bytes, int] = {}
        for p, i in zip(parts, own.tolist(), strict=True):
            for k in range(len(p) - 49):
                first[p[k : k + 50]] = min(i, first.get(p[k : k + 50], i))
        want = [{k for k in range(len(p) - 49) if first[p[k : k + 50]] < i} for p, i in zip(parts, own.tolist(), strict=True)]
        got: list[set[int]] = [set() for _ in parts]
        for p, a, z in zip(*suffix.smaller_ids(b"".join(parts), stops - lengths, stops, own), strict=True):
            got[p] |= set(range(a, z + 1))
        assert got == want


def test_substring_hashes_and_buckets(spark, small, rows, monkeypatch):
    """First hashes that all agree within a bucket only make more candidates."""
    from keystrata.llm import substring

    monkeypatch.setattr(substring, "LOW", np.uint64(0))
    test_substring(spark, small, rows)
    a, b = np.array([1, 1, 2, 5], np.uint64), np.array([7, 8, 7, 9], np.uint32)
    assert substring.both_within(a, b, np.array([1, 1, 2, 9], np.uint64), np.array([8, 9, 6, 9], np.uint32)).tolist() == [False, True, False, False]


def test_maximal_repeats():
    import random

    r = random.Random(5)
    for _ in range(30):
        parts = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 25))) for _ in range(2)] + [b"abcabcab"]
        want = set()
        occ = defaultdict(set)
        for i, p in enumerate(parts):
            for a in range(len(p)):
                for b in range(a + 3, len(p) + 1):
                    occ[p[a:b]].add((i, a))
        for s, at in occ.items():
            left = {parts[i][a - 1] if a else (i, "start") for i, a in at}
            right = {parts[i][a + len(s)] if a + len(s) < len(parts[i]) else (i, "end") for i, a in at}
            if len(at) > 1 and len(left) > 1 and len(right) > 1:
                want.add((len(s), tuple(sorted(at))))
        assert {(n, tuple(sorted(at))) for n, at in suffix.repeat_groups(parts, 3)} == want


def test_quality(spark, small, rows):
    want = []
    for i, x, *_ in rows:
        t = x or ""
        w = WORD.findall(t)
        wins = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = Counter(wins)
        rep = len({p for k, s in enumerate(wins) if n[s] > 1 for p in (k, k + 1, k + 2)})
        lines = [y for y in t.split("\n") if WORD.search(y)]
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), rep, len(w) < 50 or 100 * rep > 50 * len(w)))
    d = LLM_QUERIES["op8_quality"](spark, small)
    same(d, want, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"])
    assert d.filter("kept AND base_failed").count() == 0


def test_mixing_meets_its_targets(spark, small):
    out = LLM_QUERIES["op7_mixing"](spark, small).collect()
    by = defaultdict(lambda: [0, 0, 0])
    for r in out:
        b = by[(r.source_size, r.target)]
        b[0] += r.taken
        b[1] = max(b[1], r.size)
        assert r.taken <= 3 * r.size
    for (size, target), (taken, most, _) in by.items():
        assert target <= 3 * size and abs(taken - target) <= most
    assert LLM_QUERIES["op7_mixing"](spark, small).exceptAll(spark.createDataFrame(out)).count() == 0


def test_language_held_out(spark):
    d = "/root/testdata/sf0.001"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    out = [r for r in LLM_QUERIES["op9_langid"](spark, d).collect() if r.held_out]
    assert out and sum(r.lang_pred == lang[r.doc_id] for r in out) / len(out) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)


def test_language_rows(spark, small):
    got = {r.doc_id: r for r in LLM_QUERIES["op9_langid"](spark, small).collect()}
    assert got[0].lang_pred == got[3].lang_pred == got[60].lang_pred == "und" and got[18].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_is_the_sum_over_segmentations(spark, small, rows):
    """Learning and predictions against enumeration, with few words to a text."""
    import math

    from keystrata.llm import langid

    sp, letters = langid.processor(langid.vocabulary_path()), re.compile(r"[^\W\d_]+")
    pieces = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    byte = {int(sp.id_to_piece(i)[3:-1], 16): i for i in range(sp.get_piece_size()) if sp.is_byte(i)}

    def ways(w: str):
        """Every segmentation as a list of lists of ids, one list for each piece."""
        if not w:
            yield []
        for k in range(1, len(w) + 1):
            first = [pieces[w[:k]]] if w[:k] in pieces else [byte[x] for x in w[0].encode()] if k == 1 else None
            if first is not None:
                for rest in ways(w[k:]):
                    yield first + rest

    docs = [(1, "the cat", "en"), (3, "der Hund", "de"), (4, "THE dog's", "en"), (5, "die katze", "de"), (6, "a 中é", "en"), (8, "of the", None), (9, None, "en"), (10, "12 %", "de"), (None, "x y", "fr")]
    docs += [(20 + i, t, None) for i, t in enumerate(("the", "hund katze", "der dog", "中", "", "_1"))]
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    teach = [(t or "", x) for i, t, x in docs if i is not None and x and not held(i)]
    counts = {x: Counter() for x in {x for _, x in teach}}
    for t, x in teach:
        for w in letters.findall(t.lower()):
            counts[x].update(sp.encode(w))
    counts = {x: c for x, c in counts.items() if c}
    size = sp.get_piece_size()

    def model(c):
        return {x: [(c[x][i] + langid.SMOOTH) / (sum(c[x].values()) + langid.SMOOTH * size) for i in range(size)] for x in c}

    p = model(counts)
    new = {x: Counter() for x in counts}
    for t, x in teach:
        for w in letters.findall(t.lower()):
            each = [(s, math.prod(p[x][i] for i in s)) for s in ways(langid.MARK + w)]
            total = sum(q for _, q in each)
            for s, q in each:
                for i in s:
                    new[x][i] += q / total
    learned = langid.learn(spark.createDataFrame(docs, "doc_id bigint, text string, lang string").repartition(3))
    assert {x: {i: round(n, 4) for i, n in enumerate(a) if n > 1e-5} for x, a in learned.items()} == {x: {i: round(n, 4) for i, n in c.items() if n > 1e-5} for x, c in new.items()}
    p = model({x: Counter({i: n for i, n in enumerate(a)}) for x, a in learned.items()})
    out = langid.predicted(spark.createDataFrame(docs, "doc_id bigint, text string, lang string"), learned).collect()
    said = {i: t for i, t, _ in docs}
    for r in out:
        words = letters.findall((said[r.doc_id] or "").lower())
        if not words:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        logs = {x: sum(math.log(sum(math.prod(p[x][i] for i in s) for s in ways(langid.MARK + w))) for w in words) for x in p}
        best = min(logs, key=lambda x: (-logs[x], x))
        assert r.lang_pred == best and abs(r.score - 1 / sum(math.exp(v - logs[best]) for v in logs.values())) < 1e-6


def test_rare_characters_teach():
    from keystrata.llm import langid

    path = langid.vocabulary_path()
    s, out = langid.Scorer(path, {"x": np.ones(langid.processor(path).get_piece_size()) * 1e6}), defaultdict(float)
    s.p[:] = 1e-12
    s.byte_p = [(1e-12,)] * 256
    s.expected("x", "\U00012345" * 64, 2, out)
    assert abs(sum(out.values()) - 2 * 4 * 64) < 1e-6


def test_all_segmentations_are_summed():
    from keystrata.llm import langid

    path = langid.vocabulary_path()
    size = langid.processor(path).get_piece_size()
    s = langid.Scorer(path, {"x": np.arange(size, dtype=float), "y": np.ones(size)})

    def total(w: str, i: int) -> float:
        if not w:
            return 1.0
        out = 0.0
        for k in range(len(w)):
            p = s.piece.get(w[k:]) or (s.spelt(w[-1]) if k == len(w) - 1 else None)
            out += total(w[:k], i) * p[i] if p else 0
        return out

    words = ["▁the", "▁eaü中", "▁tion", "▁🙂x", "▁"]
    for w, f in zip(words, s.forward(words), strict=True):
        assert np.allclose(f, [total(w, 0), total(w, 1)])
        assert np.allclose(np.log(f), s.chain(w))
    rare = "\U00012345" * 20
    s.learn({rare, "the"})
    assert np.allclose(np.frombuffer(s.known[rare]), s.chain("▁" + rare)) and np.isfinite(np.frombuffer(s.known[rare])).all()


def brute_sketch(t: str) -> set[int]:
    whole = (1 << 64) - 1

    def scrambled(h: int) -> int:
        for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            h = (h ^ h >> 33) * m & whole
        return h ^ h >> 33

    w = [xxhash.xxh64_intdigest(bytes(c + 32 if 65 <= c <= 90 else c for c in x.encode())) for x in WORD.findall(t)]
    k = min(5, len(w))
    hs = {scrambled(sum(h * pow(0x9E3779B97F4A7C15, j, 1 << 64) for j, h in enumerate(w[i : i + k])) + k & whole) for i in range(len(w) - k + 1)} if w else set()
    return {h for h in hs if h < (1 << 64) // fingerprint.SCALED} or ({min(hs)} if hs else set())


@pytest.mark.parametrize("part_bytes", [fingerprint.PART_BYTES, 600])
def test_fingerprints(spark, small, rows, part_bytes):
    def like(a: set, b: set) -> float:
        return round(len(a & b) / len(a | b) if a and b else float(a == b), 9)

    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    want = []
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        n = len(t) // 3
        e = t[: len(t) - n] + nxt[:n]
        one, two, three = brute_sketch(t), brute_sketch(e), brute_sketch(nxt)
        said = lambda s: "".join(f"{h:016x}" for h in sorted(s))
        want.append((i, len(t), sha(e.encode()), said(one), said(two), like(one, two), like(one, three)))
    d = fingerprint.edits(spark.read.parquet(f"{small}/documents.parquet"), part_bytes)
    got = d.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()
    assert Counter((*r[:5], round(r[5], 9), round(r[6], 9)) for r in got) == Counter(want)


def test_parts_of_a_hot_id(spark):
    """A third of all rows without an id, and many equal rows, over many parts."""
    rows = [(None, f"text {k % 70} of nobody " * 3) for k in range(200)] + [(k, f"text {k}") for k in range(200)] + [(7, "the same")] * 100
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    cuts = fingerprint.bounds(d, 20)
    assert 10 < len(cuts) < 20 and cuts == sorted(set(cuts)) and sum(c[0] for c in cuts) > 3
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    want = Counter()
    for k, (i, t) in enumerate(order):
        nxt, n = order[(k + 1) % len(order)][1], len(t) // 3
        want[i, sha((t[: len(t) - n] + nxt[:n]).encode())] += 1
    assert Counter((r.doc_id, r.edited_sha256) for r in fingerprint.edits(d, 50).collect()) == want


def test_sketches_merge(texts):
    a, b = texts[6].encode(), texts[16].encode()
    both = fingerprint.merged(fingerprint.sketch(a), fingerprint.sketch(b))
    assert set(fingerprint.sketch(a + b" " + b)) >= set(both)
    assert fingerprint.containment(fingerprint.sketch(a), both) == 1


def test_near_groups(spark, small):
    got = {r.doc_id: r.component_id for r in near.groups(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")).filter("doc_id IS NOT NULL").collect()}
    assert got[21] == got[18] == got[24] == 18 and got[0] == got[3] == got[6] == 0
    assert all(got[i] == i for i in (27, 45, 48, 66))


def test_crowded_near_groups(spark):
    import random

    r = random.Random(2)
    base = [r.choice("abcdefghij") + str(r.randrange(50)) for _ in range(400)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(4):
            w[r.randrange(400)] = f"edit{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(str(r.randrange(10**6)) for _ in range(100))) for i in range(20)]
    got = near.groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert all(r.component_id == (0 if r.doc_id < 1000 else r.doc_id) for r in got)


def test_crowded_values_lose_no_pair(spark):
    import random

    from pyspark.sql import functions as F

    r = random.Random(3)
    rows, want = [], set()
    for k in range(150):
        one = [7, *[r.randrange(1 << 20) for _ in range(15)]]
        # two bits apart in each segment but the crowded one, there in one bit or none
        two = [7 | 8 * (k % 2), *[x ^ sum(1 << b for b in r.sample(range(20), 2)) for x in one[1:]]]
        rows += [(2 * k, one), (2 * k + 1, two)]
        want.add((2 * k, 2 * k + 1))
    nodes = spark.createDataFrame([(i, i, x) for i, x in rows], "node bigint, comp bigint, segs array<int>")
    got = {(x.a, x.b) for x in near.candidates(nodes).collect()}
    assert want <= got
    # pairs of one component are left out, and no others
    some = nodes.withColumn("comp", F.expr("CASE WHEN node % 4 < 2 THEN -1 ELSE node END"))
    left = {(x.a, x.b) for x in near.candidates(some).collect()}
    assert {p for p in want if p[0] % 4 >= 2} <= left and not any(a % 4 < 2 and b % 4 < 2 for a, b in left)
    assert not near.candidates(nodes.withColumn("comp", F.lit(-1).cast("bigint"))).collect()


def test_segments_grow_with_the_corpus():
    assert near.shape(0) == near.shape(200_000) == (16, 20)
    p = 0.85**26 + 26 * 0.15 * 0.85**25
    assert near.shape(12_000_000).width == 26 and 1 - (1 - p) ** near.shape(12_000_000).segments >= 0.95
    assert all(0 <= x < 1 << 26 for x in near.fingerprint(near.shingles(b"one two three four five six"), near.shape(12_000_000)))


def test_near_duplicates_go_by_row(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [
        (1, text(1), "a"), (None, text(1), "b"),  # a null id is a copy of another
        (None, text(2), "a"), (None, text(3), "a"),  # clean ones without an id
        (2, text(4), "a"), (2, text(1), "a"),  # two texts under one id, the second a copy
        (3, text(5), "a"), (3, text(5), "a"), (3, text(5), "b"),  # equal rows, and one that differs elsewhere
        (None, text(6), "a"), (None, text(6), "a"), (None, text(6), "a"),  # copies without an id only
        (4, None, "a"), (5, "", "a"), (None, " ", "a"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    out = near.deduplicated(docs)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(1, text(1)), (None, text(2)), (None, text(3)), (2, text(4)), (3, text(5)), (None, text(6)), (4, None)], key=str)


def test_near_links_are_similar(spark, monkeypatch):
    import random

    r = random.Random(5)
    words = lambda n: [str(r.randrange(10**6)) for _ in range(n)]
    docs = []
    for k in range(60):
        base = words(200)
        # a replaced end of c words of 200: similarity (196 - c) / (196 + c)
        docs += [(10 * k, base), (10 * k + 1, base[: 200 - 8] + words(8)), (10 * k + 2, base[: 200 - 28] + words(28)), (10 * k + 3, base[: 200 - 50] + words(50))]
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in docs}
    want = {i: i for i in sets}
    for i in sets:
        for j in range(i - i % 10, i):
            if j in sets and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                want = {x: want[j] if y == want[i] else y for x, y in want.items()}
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id bigint, text string")
    got = {x.doc_id: x.component_id for x in near.groups(d).collect()}
    assert all(want[i] == want[c] for i, c in got.items())
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want)
    monkeypatch.setattr(near, "MANY", 0)
    assert {x.doc_id: x.component_id for x in near.groups(d).collect()} == got
