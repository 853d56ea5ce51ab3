"""Toxicity by maximum-scoring segments over token log-odds.

Words (runs outside BREAKS, lower-cased in A-Z) stand for tokens, and so do their beginnings of 5 to
8 characters, which catch inflected and compounded forms. Each token has its log-odds ratio between
toxic and other labelled documents with an informative Dirichlet prior, the counts of both together
(Monroe, Colaresi and Quinn 2008); tokens count once a document. Every token of the sample weighs,
for or against: its log-odds, shrunk smoothly by its z-score, so that what rests on a document or two
is near 0. A word weighs what its token furthest from 0 does, less a drift that keeps the expected
sum below zero; words that the sample hasn't got weigh the drift alone.

One linear pass (Ruzzo and Tompa 1999) finds all maximal-scoring segments of a whole text. Segment
scores follow an extreme-value law (Karlin and Altschul 1990), whose two parameters are fitted on
labelled documents that are not toxic; a segment is significant if its E-value is small. A logistic
curve over the best segment's bits, fitted on the labelled documents, makes the score.

Labels are learnt from at most MAX_TRAIN labelled ids, those with the smallest hashes of doc_id, in one
task; the driver gets and broadcasts the tokens' hashes and weights, 12 bytes for each token of the sample.

Defined results: null and wordless texts have no segments and get the score of none; repeated rows
give a row each; an id with several labels, and a text that several ids have, count once, as toxic if
any label says so; labels of unknown documents, null labels and other columns are ignored; if there is
no toxic or no other label, no token weighs and every score is the share of toxic labels.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.llm.arrow import in_arrow, learnt
from mnemora.sources.tables import table

MAX_TRAIN = 6000
#: The prior's share of all counts: each token has this share of its own count as prior.
PRIOR = 0.05
#: A log-odds of this z-score is halved; how sharply it shrinks below it.
Z_HALF, SHARP = 4.0, 8
DRIFT = 0.01
STEMS = (5, 6, 7, 8)
REJECT = 0.3
#: Most words of whom a worker remembers the weights.
SEEN = 150_000
_word = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; bytes.lower changes A-Z only."""
    return _word.findall((text or "").encode("utf-8", "surrogatepass").lower())


def tokens_of(word: bytes) -> list[int]:
    """The hashes of a word and of its beginnings."""
    w = word.decode("utf-8", "replace")
    return [xxhash.xxh3_64_intdigest(word), *(xxhash.xxh3_64_intdigest(w[:n] + "*") for n in STEMS if len(w) >= n)]


@dataclass
class Model:
    tokens: np.ndarray  # sorted hashes
    weights: np.ndarray
    lam: float
    k: float
    slope: float
    shift: float
    base: float
    seen: dict[bytes, float] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"seen": {}}

    def remember(self, words: set[bytes]) -> None:
        """Put the weights of words that aren't there into the table of bounded size."""
        new = [w for w in words if w not in self.seen]
        if not new:
            return
        if len(self.seen) + len(new) > SEEN:
            self.seen.clear()
            new = list(words)
        own = [tokens_of(w) for w in new]
        at = np.fromiter((t for ts in own for t in ts), np.uint64)
        k = np.minimum(np.searchsorted(self.tokens, at), len(self.tokens) - 1)
        x = np.where(self.tokens[k] == at, self.weights[k], 0.0)
        first = np.concatenate(([0], np.cumsum([len(ts) for ts in own])[:-1])).astype(np.int64)
        up, down = np.maximum.reduceat(x, first), np.minimum.reduceat(x, first)
        self.seen.update(zip(new, (np.where(up >= -down, up, down) - DRIFT).tolist()))

    def of_words(self, words: list[bytes]) -> np.ndarray:
        """The words' weights, in order."""
        self.remember(set(words))
        return np.fromiter(map(self.seen.__getitem__, words), np.float64, len(words))

    def bits(self, score: float, n: int) -> float:
        """Minus log2 of the E-value of a segment in a text of n words."""
        return (self.lam * score - math.log(self.k * max(n, 1))) / math.log(2)

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The calibrated score and the significant segments (start, end, bits)."""
        if not len(self.tokens):
            return self.base, []
        words = words_of(text)
        found = [(s, e, self.bits(x, len(words))) for s, e, x in maximal(self.of_words(words))]
        best = max((b for _, _, b in found), default=-10.0)
        return self.chance(best), [f for f in found if f[2] >= 3.3]

    def chance(self, best: float) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.slope * max(best, -10.0) + self.shift))))


def maximal(weights: np.ndarray) -> list[tuple[int, int, float]]:
    """Ruzzo and Tompa's scan: all maximal-scoring segments (start, end, score).

    Neighbours of positive weight always stand together, so the scan goes over their runs. Each part
    of the list has a link to the last one before it that starts lower, so the whole is linear.
    """
    total = np.concatenate(([0.0], np.cumsum(weights)))
    edge = np.diff(np.concatenate(([0], (weights > 0).view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    parts: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, link
    for s, e, low, high in zip(starts.tolist(), ends.tolist(), total[starts].tolist(), total[ends].tolist()):
        j = len(parts) - 1
        while True:
            while j >= 0 and parts[j][2] >= low:
                j = parts[j][4]
            if j < 0 or parts[j][3] >= high:
                parts.append((s, e, low, high, j))
                break
            s, low = parts[j][0], parts[j][2]
            j_next = parts[j][4]
            del parts[j:]
            j = j_next
    return [(s, e, high - low) for s, e, low, high, _ in parts]


def train(rows: list[tuple[str | None, int]]) -> Model:
    """A model from labelled texts; a repeated text counts once, as toxic if any of its labels says so."""
    labels: dict[str, int] = {}
    for t, y in rows:
        labels[t or ""] = max(int(y), labels.get(t or "", 0))
    texts = sorted(labels)
    y = np.array([labels[t] for t in texts], np.int64)
    base = float(y.mean()) if len(y) else 0.0
    none = Model(np.zeros(0, np.uint64), np.zeros(0), 1.0, 1.0, 1.0, 0.0, base)
    if len(set(y.tolist())) < 2:
        return none
    known: dict[bytes, int] = {}
    docs = [np.array([known.setdefault(w, len(known)) for w in words_of(t)], np.int64) for t in texts]
    if not known:
        return none
    own = [tokens_of(w) for w in known]
    tokens, at = np.unique(np.fromiter((t for ts in own for t in ts), np.uint64), return_inverse=True)
    first = np.concatenate(([0], np.cumsum([len(ts) for ts in own]))).astype(np.int64)
    count = np.zeros((2, len(tokens)))
    for d, own_y in zip(docs, y.tolist()):
        words = np.unique(d)
        if len(words):
            count[own_y][np.unique(np.concatenate([at[first[w] : first[w + 1]] for w in words.tolist()]))] += 1
    b, a = count
    prior = PRIOR * (a + b)
    mass = float(prior.sum())
    odds = np.log((a + prior) / (a.sum() + mass - a - prior + 1e-9)) - np.log((b + prior) / (b.sum() + mass - b - prior + 1e-9))
    z = np.abs(odds) / np.sqrt(1 / (a + prior) + 1 / (b + prior))
    m = Model(tokens, odds / (1 + (Z_HALF / np.maximum(z, 1e-9)) ** SHARP), 1.0, 1.0, 1.0, 0.0, base)
    x = m.weights[at]
    up, down = np.maximum.reduceat(x, first[:-1]), np.minimum.reduceat(x, first[:-1])
    each = np.where(up >= -down, up, down) - DRIFT
    best = np.array([max((x for *_, x in maximal(each[d])), default=0.0) for d in docs])
    size = np.array([max(len(d), 1) for d in docs])
    # the extreme-value law's parameters, by moments of the best scores less the length's share
    clean = (best - np.log(size))[(y == 0) & (best > 0)]
    if len(clean) > 20 and clean.std() > 0:
        m.lam = float(min(2.0, math.pi / (clean.std() * math.sqrt(6))))
        m.k = float(np.exp(np.clip(m.lam * (clean.mean() - 0.5772 / m.lam), -20, 5)))
    bits = np.array([max(m.bits(s, n), -10.0) if s else -10.0 for s, n in zip(best.tolist(), size.tolist())])
    m.slope, m.shift = logistic(bits, y.astype(float))
    return m


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and shift of a one-dimensional logistic fit by Newton's steps."""
    mu, sd = x.mean(), x.std() or 1.0
    z, w = np.stack([(x - mu) / sd, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        h = z.T * (p * (1 - p) + 1e-9) @ z + ridge * np.eye(2)
        step = np.linalg.solve(h, z.T @ (y - p) - ridge * w)
        w += step
        if abs(step).max() < 1e-9:
            break
    return float(w[0] / sd), float(w[1] - w[0] * mu / sd)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, mod: int, out: int, most: int) -> DataFrame:
    """(text, label) of at most `most` labelled ids, by the hash of doc_id, none of them held out.

    Of an id's or a text's several labels the largest counts; a text comes once.
    """
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % mod != out))
    rows = rows.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").groupBy("text").agg(F.max("label").alias("label"))


def fitted(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Model:
    return learnt(training_rows(docs, labels, "toxic", 4, 2, most), train)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, score and the significant segments as array<struct<s, e, bits>> in words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("bits", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            rows = [m.score(t.as_py()) for t in b.column(1)]
            spans = [[{"s": s, "e": e, "bits": x} for s, e, x in r[1]] for r in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "spans"])
        m.seen.clear()

    return docs.select(docs[id_col].alias("doc_id"), text_col).transform(in_arrow, run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double, spans array<struct<s:int,e:int,bits:double>>")


def drop_toxic(docs: DataFrame, model: Model, least: float = REJECT) -> DataFrame:
    """`docs` without the rows that score `least` or more; same columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            yield b.filter(pa.array([m.score(t.as_py())[0] < least for t in b.column(at)], pa.bool_()))
        m.seen.clear()  # a worker that waits for another task holds no table

    return docs.transform(in_arrow, run, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scored(docs, fitted(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"), F.size("spans").cast("long").alias("n_segments"))
