from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import corpus_pipeline
import pytest
from test_quality import brute as judged

from keystrata.llm import bpe
from keystrata.llm.common import Cut, read

D = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark):
    docs = read(spark, D)
    ids = {r.doc_id for r in docs.collect()}
    cut, kept = Cut(spark), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = cut(stage(spark, docs, D))
        assert docs.columns == columns
        rows = docs.collect()
        assert {r.doc_id for r in rows} <= ids
        kept.append(len(rows))
    assert kept[0] > kept[1] == kept[2] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, D).collect()
    assert len(last) == kept[3] and all(len(r.ids) == r.n_tokens for r in last)


def test_empty(spark, empty):
    assert corpus_pipeline.run(spark, empty).collect() == []


NAMES = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, h string, copies string, `row` int, kept string, removal int, node string, words int"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean texts, junk, exact and near copies, shared passages, nulls, repeated rows, and
    columns that have names of the inside."""
    r = random.Random(9)
    common = [f"w{k}" for k in range(60)]
    say = lambda n: " ".join(r.choice(common) if r.random() < 0.6 else f"x{r.randrange(10**6)}" for _ in range(n))
    texts = [(i, say(r.randrange(60, 200))) for i in range(60)]
    passage = say(50)
    texts += [(100 + i, say(60) + " " + passage + "\n " + say(60)) for i in range(5)]
    texts += [(120 + i, " ".join(f"{r.choice(common)}!!" for _ in range(120))) for i in range(8)]
    texts += [(140 + i, texts[i][1]) for i in range(5)] + [(None, texts[7][1]), (None, say(90)), (3, say(80)), (150, None), (151, ""), (152, "short")]
    for i in (10, 11, 12):
        w = texts[i][1].split(" ")
        w[len(w) // 2] = "edited"
        texts.append((160 + i, " ".join(w)))
    rows = [(i, t, "en", ["a", "b", None][k % 3], len(t or ""), k, "h", "c", k, "yes", 1, "n", 2) for k, (i, t) in enumerate(texts)]
    rows += [rows[20], rows[20]]
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, NAMES).repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = [(i, 1, 0) for i in range(50)] + [(120, 0, 0)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, rows


def near_copies(rows: list[tuple]) -> list[set[int]]:
    """Groups of places of rows, by the Jaccard similarity of 5-word shingles."""
    sets = []
    for row in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(row[1] or "")]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root = [root[j] if x == root[i] else x for x in root]
    return [{k for k, x in enumerate(root) if x == g} for g in set(root)]


def mix(rows: list[tuple]) -> Counter:
    """Rows and how often they are taken."""
    size = lambda t: len(WORD.findall(t or ""))
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    own = {s: sum(size(r[1]) for r in rows if r[3] == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    stopped: set = set()
    while True:
        left = sum(own.values()) - sum(3 * own[s] for s in stopped)
        level = left / max(1, sum(weight[s] for s in sources if s not in stopped))
        more = {s for s in sources if s not in stopped and level * weight[s] > 3 * own[s]}
        if not more:
            break
        stopped |= more
    out: Counter = Counter()
    for s in sources:
        target = 3 * own[s] if s in stopped else level * weight[s]
        whole = min(3, int(target // own[s])) if own[s] else 0
        rest = target - whole * own[s]
        md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
        hashed: dict[int, list] = {}
        for r in rows:
            if r[3] == s:
                hashed.setdefault(int(md5(f"{'null' if r[0] is None else r[0]}|{md5(r[1] or '')}")[:15], 16), []).append(r)
        before = 0
        for h in sorted(hashed):
            tied = sum(size(r[1]) for r in hashed[h])
            extra = whole < 3 and before + tied / 2 <= rest
            before += tied
            for r in hashed[h]:
                out[r] += whole + extra
    return +out


def test_each_stage_against_plain_python(spark, corpus):
    d, rows = corpus
    docs, cut = read(spark, d), Cut(spark)

    def run(k: int) -> list[tuple]:
        nonlocal docs
        docs = cut(corpus_pipeline.STAGES[k][1](spark, docs, d))
        return [tuple(r) for r in docs.collect()]

    verdicts = judged([(r[0], r[1]) for r in rows], set(range(50)))
    want = Counter(r for r, v in zip(rows, verdicts, strict=True) if v[2])
    got = run(0)
    assert Counter(got) == want and len(got) > 50 and not any(r[0] in range(120, 128) for r in got)

    order = lambda r: (r[0] is None, r[0] or 0)
    groups = near_copies(got)
    assert max(map(len, groups)) >= 3
    best = Counter(min(order(got[k]) for k in g) for g in groups)
    of = {k: i for i, g in enumerate(groups) for k in g}
    places = {r: k for k, r in enumerate(got)}
    stayed = run(1)
    assert Counter(map(order, stayed)) == best and len({of[places[r]] for r in stayed}) == len(stayed) == len(groups)

    words = [WORD.findall(r[1] or "") for r in stayed]
    n = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    want = Counter()
    for r, w in zip(stayed, words, strict=True):
        gone = {p for s in range(len(w) - 34) if n[tuple(w[s : s + 35])] > 1 for p in range(s, s + 35)}
        text = " ".join(x for p, x in enumerate(w) if p not in gone) if gone else r[1]
        want[(r[0], text, r[2], r[3], len(text) if gone else r[4], *r[5:])] += 1
    thinned = run(2)
    assert Counter(thinned) == want and sum(r[1] != q[1] for r, q in zip(sorted(thinned, key=order), sorted(stayed, key=order), strict=True)) >= 5

    taken = run(3)
    assert Counter(taken) == mix(thinned)

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary_path())
    want = Counter()
    for r in taken:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        want[(r[0], r[2], r[3], tuple(ids), len(ids), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    last = corpus_pipeline.STAGES[4][1](spark, docs, d)
    assert Counter((r.doc_id, r.lang, r.source, tuple(r.ids), r.n_tokens, r.decoded_sha256) for r in last.collect()) == want
