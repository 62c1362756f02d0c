"""Language identification by unigrams of vocabulary pieces, over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A word (a
run of letters, lower case, with the vocabulary's word mark before it) has, in a language, the sum of the
products of piece probabilities over all of its segmentations, which a forward pass over its
prefixes gives; a character that no piece has is spelt by its byte pieces. A text's log
probability is the sum over its words, and the language with the highest is predicted, the
first in code-point order of equals; the score is its share of the summed probabilities.

Learning. At most SAMPLE documents of each language, those with the smallest hash of their
id, are the fit's sample. Piece counts start from the vocabulary's own segmentation and then
come from ROUNDS of expectation over all segmentations (forward and backward); they are
summed in Spark by language and piece.

Rows: a text that is null or has no letter is `und` with score 0; so is every text where no
document teaches. A null lang teaches nothing; null ids hash as the empty string and are not
held out unless that falls so. Repeated rows are predicted alike; an empty table gives an
empty one. Extra columns are not read.
"""

from __future__ import annotations

import math
import re
import struct
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keystrata.llm.common import Cut, pieces, read

VOCABULARY = "piece_bpe_32k.model"
SAMPLE = 300
ROUNDS = 1
#: Up to so many sampled ids are broadcast; with more languages they are joined by a shuffle.
BROADCAST_IDS = 100_000
#: Added to every piece's count.
SMOOTH = 0.05
#: Words that a worker remembers, besides those of the piece it works on.
MEMO = 150_000
#: Words that are worked out together.
BLOCK = 20_000
#: Longer words are worked out one by one.
LONG = 24
UNKNOWN = "und"
MARK = "▁"
RUN = re.compile(r"[^\W\d_]+")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_processors: dict[str, object] = {}


def processor(path: str):
    if path not in _processors:
        import sentencepiece

        _processors[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _processors[path]


def alphabet(path: str) -> tuple[dict[str, int], list[int]]:
    """Ids of the text pieces, and the id of each byte's piece."""
    sp = processor(path)
    text, byte = {}, [0] * 256
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            byte[int(sp.id_to_piece(i)[3:-1], 16)] = i
        elif not sp.is_control(i) and not sp.is_unknown(i):
            text[sp.id_to_piece(i)] = i
    return text, byte


def words(text: str) -> list[str]:
    """The runs of letters, in lower case."""
    return RUN.findall(text.lower())


class Scorer:
    """Log probabilities of words in every language."""

    def __init__(self, path: str, counts: dict[str, np.ndarray]):
        self.langs = sorted(counts)
        self.text, self.byte = alphabet(path)
        self.longest = max(map(len, self.text))
        size = len(next(iter(counts.values())))
        p = np.array([(counts[x] + SMOOTH) / (counts[x].sum() + SMOOTH * size) for x in self.langs])
        self.p = p
        self.piece = {t: tuple(p[:, i].tolist()) for t, i in self.text.items()}
        self.byte_p = [tuple(p[:, i].tolist()) for i in self.byte]
        self.width = len(self.langs)
        #: Logarithms of words, eight bytes a language.
        self.known: dict[str, bytes] = {}
        self.pack = struct.Struct(f"<{self.width}d").pack

    @cached_property
    def matcher(self) -> ahocorasick.Automaton:
        """Finds every piece in a string."""
        out = ahocorasick.Automaton()
        for t, i in self.text.items():
            out.add_word(t, (len(t) << 32) + i)
        out.make_automaton()
        return out

    @cached_property
    def letters(self) -> np.ndarray:
        """Code points that are a piece."""
        return np.array(sorted(ord(t) for t in self.text if len(t) == 1), np.uint32)

    def spelt(self, c: str) -> tuple[float, ...]:
        out = (1.0,) * self.width
        for b in c.encode():
            out = tuple(a * x for a, x in zip(out, self.byte_p[b], strict=True))
        return out

    def forward(self, words: list[str]) -> np.ndarray:
        """The summed probabilities of short words, a row each: all words together, one end
        after the other, from the pieces that end there."""
        joined = "\n".join(words) + "\n"
        sizes = np.array([len(w) for w in words], np.int64)
        stops = np.cumsum(sizes + 1) - 1
        starts = stops - sizes
        found = np.fromiter(chain.from_iterable(self.matcher.iter(joined)), np.int64).reshape(-1, 2)
        ends, length, piece = found[:, 0] + 1, found[:, 1] >> 32, found[:, 1] & 0xFFFFFFFF
        # characters that are no piece are spelt in bytes
        codes = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        odd = np.flatnonzero(~np.isin(codes, self.letters) & (codes != 10))
        table = self.p.T
        if len(odd):
            kinds, which = np.unique(codes[odd], return_inverse=True)
            piece = np.concatenate([piece, len(table) + which])
            ends, length = np.concatenate([ends, odd + 1]), np.concatenate([length, np.ones(len(odd), np.int64)])
            table = np.concatenate([table, [self.spelt(chr(c)) for c in kinds.tolist()]])
        word = np.repeat(np.arange(len(words)), sizes + 1)
        at = ends - starts[word[ends - 1]]
        order = np.lexsort((ends, at))
        at, ends, length, piece = at[order], ends[order], length[order], piece[order]
        alpha = np.zeros((len(joined) + 1, self.width))
        alpha[starts] = 1
        edges = np.flatnonzero(np.diff(at, prepend=-1, append=-1))
        for x, z in zip(edges.tolist(), edges[1:].tolist(), strict=False):
            e = ends[x:z]
            first = np.flatnonzero(np.diff(e, prepend=-1))
            alpha[e[first]] = np.add.reduceat(alpha[e - length[x:z]] * table[piece[x:z]], first)
        return alpha[stops]

    def chain(self, w: str) -> list[float]:
        """forward() in logarithms, rescaled as it goes: for words of any length."""
        alpha: list[list[float]] = [[1.0] * self.width]
        shift = [0.0] * self.width
        for j in range(1, len(w) + 1):
            now = [0.0] * self.width
            for k in range(max(0, j - self.longest), j):
                p = self.piece.get(w[k:j])
                if p is None and k == j - 1:
                    p = self.spelt(w[k])
                if p is not None:
                    for i, a in enumerate(alpha[k - j]):
                        now[i] += a * p[i]
            alpha.append(now)
            alpha = alpha[-self.longest :]
            for i, a in enumerate(now):
                if a < 1e-100:
                    shift[i] += math.log(1e-100)
                    for v in alpha:
                        v[i] *= 1e100
        return [math.log(a) + s for a, s in zip(alpha[-1], shift, strict=True)]

    def learn(self, words: set[str]) -> None:
        """Work out the words that are not known; a full memo is emptied before."""
        if len(self.known) > MEMO:
            self.known.clear()
        new = [w for w in words if w not in self.known and len(w) < LONG]
        if not new:
            return
        f = np.concatenate([self.forward([MARK + w for w in new[at : at + BLOCK]]) for at in range(0, len(new), BLOCK)])
        with np.errstate(divide="ignore"):
            blob, size = np.log(f).astype("<f8").tobytes(), 8 * self.width
        for i, w in enumerate(new):
            self.known[w] = blob[size * i : size * (i + 1)]
        for i in np.flatnonzero(f.min(axis=1) <= 1e-250).tolist():
            self.known[new[i]] = self.pack(*self.chain(MARK + new[i]))

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        found = [words(t) if t is not None and self.langs else [] for t in texts]
        self.learn({w for ws in found for w in ws})
        return [self.summed(ws) if ws else (UNKNOWN, 0.0) for ws in found]

    def summed(self, found: list[str]) -> tuple[str, float]:
        get = self.known.get
        total = np.frombuffer(b"".join([get(w) or self.pack(*self.chain(MARK + w)) for w in found]), "<f8").reshape(-1, self.width).sum(0)
        best = int(total.argmax())
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())

    def expected(self, lang: str, w: str, times: int, out: dict[int, float]) -> None:
        """Add the word's expected piece counts in a language: forward and backward, in
        logarithms, as a long run of rare characters has no probability that a number holds."""
        i = self.langs.index(lang)
        n = len(w)
        edges: list[list[tuple[int, float, int]]] = [[] for _ in range(n + 1)]
        for j in range(1, n + 1):
            for k in range(max(0, j - self.longest), j):
                t = self.text.get(w[k:j])
                if t is not None:
                    edges[j].append((k, math.log(self.p[i, t]), t))
                elif k == j - 1:
                    edges[j].append((k, sum(math.log(self.byte_p[x][i]) for x in w[k].encode()), -1))
        f: list[float] = [0.0] + [-math.inf] * n
        b: list[float] = [-math.inf] * n + [0.0]
        for j in range(1, n + 1):
            f[j] = _sum([f[k] + p for k, p, _ in edges[j]])
        back: list[list[float]] = [[] for _ in range(n)]
        for j in range(n, 0, -1):
            if j < n:
                b[j] = _sum(back[j])
            for k, p, _ in edges[j]:
                back[k].append(p + b[j])
        for j in range(1, n + 1):
            for k, p, t in edges[j]:
                share = times * math.exp(f[k] + p + b[j] - f[n])
                if t >= 0:
                    out[t] += share
                else:
                    for x in w[k].encode():
                        out[self.byte[x]] += share


def _sum(logs: list[float]) -> float:
    """The logarithm of a sum."""
    most = max(logs)
    return most + math.log(sum(math.exp(x - most) for x in logs))


def held_out() -> Column:
    return F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 4 == 2


COUNTS = "lang string, piece int, n double"


def _summed(df: DataFrame, path: str) -> dict[str, np.ndarray]:
    """Piece counts by language: vocabulary times languages, whatever the rows."""
    size = processor(path).get_piece_size()
    out: dict[str, np.ndarray] = {}
    for r in df.groupBy("lang", "piece").agg(F.sum("n").alias("n")).orderBy("lang", "piece").collect():
        out.setdefault(r.lang, np.zeros(size))[r.piece] = round(r.n, 6)
    return out


def _emit(found: dict[str, dict[int, float]]) -> pa.RecordBatch:
    rows = [(x, t, n) for x, c in found.items() for t, n in c.items()]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([float(r[2]) for r in rows])], names=["lang", "piece", "n"])


def learn(docs: DataFrame, path: str | None = None, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Piece counts by language from the labelled documents that are not held out."""
    path = path or vocabulary_path()
    ids = docs.filter(F.col("lang").isNotNull() & ~held_out() & F.col("doc_id").isNotNull()).select("doc_id", "lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = ids.withColumn("_n", rank).filter(F.col("_n") <= SAMPLE).select("doc_id", "lang").distinct()
    chosen = F.broadcast(chosen) if chosen.count() <= BROADCAST_IDS else chosen
    sample = Cut(docs.sparkSession)(docs.select("doc_id", "lang", "text").join(chosen, ["doc_id", "lang"], "left_semi").select("lang", "text"))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(path)
        found: dict[str, dict[int, float]] = defaultdict(Counter)
        for b in batches:
            for x, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                for ids in sp.encode(words(t or ""), num_threads=1):
                    found[x].update(ids)
        yield _emit(found)

    counts = _summed(sample.mapInArrow(start, COUNTS), path)
    for _ in range(rounds if counts else 0):
        given = counts

        def again(batches: Iterator[pa.RecordBatch], given: dict[str, np.ndarray] = given) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(path, given)
            seen: dict[str, Counter[str]] = defaultdict(Counter)
            for b in batches:
                for x, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                    seen[x].update(words(t or ""))
            found: dict[str, dict[int, float]] = {x: defaultdict(float) for x in seen}
            for x, ws in seen.items():
                for w, n in ws.items():
                    for at in range(0, len(w), 64):  # one piece of 64 characters after the other
                        scorer.expected(x, (MARK if not at else "") + w[at : at + 64], n, found[x])
            yield _emit(found)

        counts = _summed(sample.mapInArrow(again, COUNTS), path)
    return counts


#: The worker's scorer, by the name of its model.
_scorers: dict[str, Scorer] = {}


def predicted(docs: DataFrame, counts: dict[str, np.ndarray], keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """The columns `keep`, lang_pred and score. The model is broadcast: vocabulary times
    languages."""
    path = path or vocabulary_path()
    model, name = docs.sparkSession.sparkContext.broadcast(counts), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorers.get(name)
        if scorer is None and model.value:
            _scorers.clear()
            scorer = _scorers[name] = Scorer(path, model.value)
        for whole in batches:
            for b in pieces(whole, "text"):
                given = b.column("text").to_pylist()
                out = scorer.predict_all(given) if scorer else [(UNKNOWN, 0.0)] * len(given)
                yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())], names=[*keep, "lang_pred", "score"])

    given = docs.select(*keep, "text")
    return given.mapInArrow(run, given.drop("text").schema.add("lang_pred", "string").add("score", "double"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir)
    return predicted(docs.withColumn("held_out", held_out()), learn(docs), ("doc_id", "held_out"))
