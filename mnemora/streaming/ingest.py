"""Requests as a stream: each request id counts once for ever, and each micro-batch is stored whole."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from mnemora.operators.ingest import REQUEST
from mnemora.plans.store import Store


def request_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """JSON lines of requests that arrive as files in a folder."""
    reader = spark.readStream.schema(REQUEST)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).json(path)


def ingest_stream(requests: DataFrame, store: Store, checkpoint: str, now: str | None = None) -> StreamingQuery:
    """Store a stream of requests; what has come is stored when the query ends.

    The store's ledger keeps the ids, so a restarted stream repeats none, and state doesn't grow with
    them. The stream's own id, which its checkpoint keeps, and a micro-batch's number name its part, so one
    that is run again is stored once, and other streams on the store have other names.
    """

    def store_batch(batch: DataFrame, number: int) -> None:
        own = json.loads(store.spark.read.text(f"{checkpoint}/metadata").first().value)["id"]
        store.add(batch, f"stream-{own}-{number:09d}", now)

    return requests.writeStream.foreachBatch(store_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
