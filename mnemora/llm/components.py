"""Connected components: in one task if there are few edges, else by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.llm.arrow import in_arrow
from mnemora.sources.tables import written

#: Most edges that one task takes: 16 bytes each, and some 100 more while they are joined.
ONE_TASK = 1_000_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges and, for each, the smallest node that edges join it to."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        # the roots of both ends are tied to the smaller one, then paths are shortened to one step
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        if (low == high).all():
            return nodes, nodes[label]
        np.minimum.at(label, high, low)
        while (label != label[label]).any():
            label = label[label]


def _at_once(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if held:
            nodes, root = roots(*(np.concatenate(c) for c in zip(*held)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(root, pa.int64())], ["node", "root"])

    return edges.select("a", "b").coalesce(1).transform(in_arrow, run, "node long, root long")


def components(edges: DataFrame, most_rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """(node, root) for each node of the edges (a, b): root is the smallest node it is joined to.

    Up to `one_task` edges are joined in one task, whose memory they bound. More go through rounds of
    a large star (a node's larger neighbours are tied to its smallest neighbour) and a small star (its
    smaller neighbours and itself are), after Kiveris et al. 2014. Minima combine on the map side, and
    each round's edges are written, so lineage stays short. A round more than `most_rounds` is an
    error, never a wrong result.
    """
    now = written(edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).where("a <> b").distinct(), "edges")
    if now.count() <= one_task:
        return _at_once(now)
    seen = None
    for _ in range(most_rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        now = written(small.union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            tops = now.select(F.col("b").alias("node")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(tops.select("node", F.col("node").alias("root")))
        seen = mark
    raise RuntimeError("the components did not settle")
