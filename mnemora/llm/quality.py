"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are its words as they are written (runs of letters and digits, and runs of other
characters that are no blanks), its pairs of neighbouring words, and, beside these lexical terms,
marks of how it is set: each word's shape, words equal to the one before, words seen before and lines
seen before. Every term has a place among 2^BITS columns, by its hash, so none is left out. Counts of
terms go through a logarithm, are weighed by inverse document frequency and projected on the leading
singular vectors of the labelled sample (by randomised subspace iteration, Halko, Martinsson and Tropp
2011, with a fixed seed). The labelled vectors are broadcast; every document's cosine products with all
of them are computed exactly, a block of documents at a time, and the K nearest vote with weights that
grow with their similarity.

Labels are learnt from at most MAX_TRAIN labelled ids, those with the smallest hashes of doc_id, in one
task, so what is broadcast is bounded: (2^BITS + MAX_TRAIN) x RANK numbers of 4 bytes.

Defined results: null and empty texts have no terms, and their score is the share of label 1; texts
with the same terms have the same score; of neighbours that are equally near at place K all vote;
repeated rows give a row each; an id with several labels, and a text that several ids have, count
once, with label 1 if any says so; null labels, labels of unknown documents and other columns are
ignored; without any label every score is 0.5.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.llm.arrow import in_arrow, learnt
from mnemora.llm.toxicity import training_rows
from mnemora.sources.tables import table

MAX_TRAIN = 4000
BITS = 16
RANK = 64
#: Vectors beyond RANK, and rounds, of the subspace iteration.
SPARE, ROUNDS = 16, 4
K = 25
POWER = 8.0
BLOCK = 256
#: Most words of whom a worker remembers the columns.
SEEN = 150_000
#: What the marks of setting weigh beside the lexical terms, whose joint length is 1.
MARKS = 2.0
_token = re.compile(r"[^\W_]+|[^\w\s]+|_+")


def _column(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


def _shape(word: str) -> str:
    """Small, capitalised, all capitals, digits, mixed or a mark, with the length up to 12."""
    kind = "a" if word.islower() else "A" if word.isupper() else "Aa" if word.istitle() else "9" if word.isdigit() else "x" if word.isalnum() else word[:3]
    return f"\x01{kind}{min(len(word), 12)}"


def terms(text: str | None, seen: dict[str, tuple[int, int, int]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The columns of a whole text's terms, and the logarithm of one more than their counts."""
    seen = {} if seen is None else seen
    words = _token.findall(text or "")
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    if len(seen) > SEEN:
        seen.clear()
    counts = Counter(words)
    for w in counts:
        if w not in seen:
            seen[w] = (_column(w), _column(_shape(w)), zlib.crc32(w.encode("utf-8", "surrogatepass")))
    n = len(words)
    own = np.fromiter((c for w in counts for c in seen[w][:2]), np.int64, 2 * len(counts)).reshape(-1, 2)
    times = np.fromiter(counts.values(), np.float64, len(counts))
    hashes = np.fromiter((seen[w][2] for w in words), np.uint64, n)
    pairs = ((hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ hashes[1:] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)).astype(np.int64)
    pair, pair_times = np.unique(pairs, return_counts=True)
    shape, at = np.unique(own[:, 1], return_inverse=True)
    lines = (text or "").split("\n")
    marks = [("\x02again", (hashes[1:] == hashes[:-1]).mean() if n > 1 else 0.0), ("\x02seen", 1 - len(counts) / n), ("\x02lines", 1 - len(set(lines)) / len(lines))]
    lexical = np.log1p(np.concatenate((times, pair_times)))
    set_ = np.sqrt(np.concatenate((np.bincount(at, times) / n, [x for _, x in marks]))) * (MARKS * float(np.linalg.norm(lexical)))
    cols = np.concatenate((own[:, 0], pair, shape, [_column(m) for m, _ in marks]))
    vals = np.concatenate((lexical, set_))
    cols, at = np.unique(cols, return_inverse=True)
    return cols, np.bincount(at, vals).astype(np.float32)


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray  # columns x rank
    vectors: np.ndarray  # labelled documents x rank, of length 1
    labels: np.ndarray
    base: float
    seen: dict = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"seen": {}}

    def vector(self, found: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The latent vector, of length 1, or of zeros if no term weighs."""
        cols, vals = found
        v = (vals * self.idf[cols]) @ self.axes[cols]
        return v / max(float(np.linalg.norm(v)), 1e-12)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The vote for label 1, each from the K nearest of all labelled vectors."""
        out = np.full(len(texts), self.base)
        if not len(self.labels):
            return out
        for a in range(0, len(texts), BLOCK):
            part = texts[a : a + BLOCK]
            sims = np.stack([self.vector(terms(t, self.seen)) for t in part]) @ self.vectors.T
            least = -np.partition(-sims, min(K, sims.shape[1]) - 1, axis=1)[:, min(K, sims.shape[1]) - 1]
            row, near = np.nonzero(sims >= np.maximum(least, 1e-6)[:, None])
            w = sims[row, near].astype(np.float64) ** POWER
            total = np.bincount(row, w, len(part))
            vote = np.bincount(row, w * self.labels[near], len(part)) / np.maximum(total, 1e-300)
            out[a : a + BLOCK][total > 0] = np.clip(vote[total > 0], 0.0, 1.0)
        return out


def leading(rows: list[tuple[np.ndarray, np.ndarray]], width: int, rank: int = RANK) -> np.ndarray:
    """The leading right singular vectors (width x at most rank) of sparse rows."""
    rng = np.random.default_rng(7)
    k = min(rank + SPARE, len(rows))
    v = rng.standard_normal((width, k)).astype(np.float32)
    for _ in range(ROUNDS):
        y = np.stack([vals @ v[cols] for cols, vals in rows])
        q, _ = np.linalg.qr(y.astype(np.float64))
        v = np.zeros((width, k), np.float32)
        for (cols, vals), r in zip(rows, q.astype(np.float32)):
            v[cols] += np.outer(vals, r)
    # v holds the rows' products with an orthonormal basis: its singular vectors are theirs
    own, s, _ = np.linalg.svd(v.astype(np.float64), full_matrices=False)
    keep = s[:rank] > 1e-9 * max(float(s[0]), 1e-300)
    return np.ascontiguousarray(own[:, :rank][:, keep], np.float32)


def train(rows: list[tuple[str | None, int]]) -> Model:
    """The model of labelled texts; a repeated text counts once, with label 1 if any of its labels is."""
    known: dict[str, int] = {}
    for t, y in rows:
        if t:
            known[t] = max(int(y), known.get(t, 0))
    texts = sorted(known)
    labels = np.array([known[t] for t in texts], np.float64)
    base = float(labels.mean()) if len(labels) else 0.5
    seen: dict = {}
    found = [terms(t, seen) for t in texts]
    df = np.zeros(1 << BITS)
    for cols, _ in found:
        df[cols] += 1
    idf = np.log1p(len(texts) / (1.0 + df)).astype(np.float32)
    m = Model(idf, np.zeros((1 << BITS, 0), np.float32), np.zeros((0, 0), np.float32), labels, base)
    if not texts:
        return m
    unit = []
    for cols, vals in found:
        x = vals * idf[cols]
        unit.append((cols, (x / max(float(np.linalg.norm(x)), 1e-12)).astype(np.float32)))
    m.axes = leading(unit, 1 << BITS)
    m.vectors = np.stack([m.vector(f) for f in found]).astype(np.float32)
    return m


def fitted(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Model:
    return learnt(training_rows(docs, labels, "quality", 3, 1, most), train)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for a in range(0, b.num_rows, BLOCK):
                part = b.slice(a, BLOCK)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(m.scores(part.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])
        m.seen.clear()  # a worker that waits for another task holds no table

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).transform(in_arrow, run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scored(docs, fitted(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
