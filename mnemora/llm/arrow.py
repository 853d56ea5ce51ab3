"""Functions over Arrow batches, with batches of bounded size."""

from __future__ import annotations

import ctypes
import gc
import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_SIZE = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Most bytes of a batch that goes to a Python worker, unless the session has a setting of its own.
BYTES = "8m"


def free() -> None:
    """Give back what a task used: workers live on, and what they keep adds up over the stages of a job."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def in_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """`df.mapInArrow`, after the session's batches were bounded by bytes, so that long texts don't add up.

    A worker frees its memory when a task ends.
    """
    conf = df.sparkSession.conf
    if conf.get(_SIZE, None) is None:
        conf.set(_SIZE, BYTES)

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            free()

    return df.mapInArrow(tidy, schema)


def learnt(rows: DataFrame, train: Callable):
    """What `train` makes of the rows, a list of tuples: it runs in one task, and only the model comes to the driver.

    For samples that a parameter bounds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [row for b in batches for row in zip(*(c.to_pylist() for c in b.columns))]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(held))], pa.binary())], ["model"])

    made = rows.repartition(1).transform(in_arrow, run, "model binary").first()
    return pickle.loads(made.model) if made else train([])  # without a row there may be no task
