"""A store over a folder: add requests, search, and read what is kept.

Each table is one folder with a part for each batch, so a reading is one scan however many batches
there are. A batch's parts are written first, under a name that no other writer has, and then a numbered
manifest entry that names them: readers take only what a manifest names, so an add is seen whole or not
at all. An entry is created only if its number is free. Of two writers at once one gets the number; the
other starts again from the ledger that it now sees, so no request is stored twice and none is lost.
"""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.operators import ingest
from mnemora.operators.index import SCHEMAS, Index, build, documents
from mnemora.operators.model import Model
from mnemora.plans.search import search
from mnemora.sources.tables import written

TABLES = {
    "ledger": "request_id string, user_id string, session_id string, completed_at string",
    "messages": "id long, request_id string, user_id string, session_id string, role string, content string, event_ts long, sequence int, created_at string",
    "facts": "fact_id long, user_id string, source_message_id long, fact_text string, created_at string",
}


class Store:
    def __init__(self, spark: SparkSession, path: str, model: Model | None = None, bonus: float = 0.0) -> None:
        if not 0 <= bonus <= 0.01:
            raise ValueError("the bonus must be between 0 and 0.01")
        self.spark, self.path, self.model, self.bonus = spark, path.rstrip("/"), model, bonus

    def _path(self, below: str):
        """The Hadoop path, and its file system."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{below}")
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest(self) -> tuple[int, list]:
        """The next free number, and the entries: batch, last_id (the last message's) and replaces."""
        at, fs = self._path("manifest")
        if not fs.exists(at):
            return 0, []
        numbers = [int(f.getPath().getName().split(".")[0]) for f in fs.listStatus(at)]
        rows = self.spark.read.schema("batch string, last_id long, replaces array<string>").json(f"{self.path}/manifest").collect()
        return max(numbers, default=-1) + 1, rows

    def _commit(self, number: int, batch: str, last_id: int, replaces: list[str] = []) -> bool:
        """Create the entry, unless its number was taken meanwhile."""
        at, fs = self._path(f"manifest/{number:012d}.json")
        try:
            out = fs.create(at, False)
        except Exception as e:
            if fs.exists(at):
                return False
            raise e
        out.writeBytes(json.dumps({"batch": batch, "last_id": last_id, "replaces": replaces}))
        out.close()
        return True

    @staticmethod
    def _live(rows: list) -> list[str]:
        gone = {b for r in rows for b in r.replaces or []}
        return sorted({r.batch for r in rows} - gone)

    def _read(self, name: str, batches: list[str]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], TABLES[name])
        paths = [f"{self.path}/{name}/batch={b}" for b in batches]
        return self.spark.read.schema(TABLES[name]).option("basePath", f"{self.path}/{name}").parquet(*paths)

    def read(self, name: str) -> DataFrame:
        return self._read(name, self._live(self._manifest()[1]))

    def add(self, requests: DataFrame, batch: str | None = None, now: str | None = None) -> DataFrame:
        """Store the valid requests that are new; returns an acknowledgement for each request given.

        A batch that is named again is not stored again; one without anything new is not stored at all.
        """
        now = now or datetime.now(UTC).isoformat().replace("+00:00", "Z")
        requests = written(ingest.valid(requests), "requests")
        ack = requests.select(F.lit(True).alias("success"), "request_id", "user_id", "session_id")
        name = batch or f"batch-{uuid.uuid4().hex}"
        while True:
            number, rows = self._manifest()
            if name in {r.batch for r in rows}:
                return ack
            new = written(ingest.new_requests(requests, self._read("ledger", self._live(rows))), "new")
            if new.isEmpty():
                return ack
            last = self._store(new, name, max((r.last_id for r in rows), default=0), now)
            if self._commit(number, name, last):
                return ack

    def _store(self, new: DataFrame, batch: str, last: int, now: str) -> int:
        """Write a batch's parts, over those of an attempt that no manifest names; returns the last message's id."""
        messages = written(ingest.messages_of(new, now, last + 1), "messages")
        facts = self.spark.createDataFrame([], TABLES["facts"])
        if self.model:
            facts = written(ingest.facts_of(messages, self.model.extract_facts(F.col("content"))).withColumn("created_at", F.lit(now)), "facts")
        index = build(documents(messages, ingest.contexts(messages), facts))
        ledger = new.select("request_id", "user_id", "session_id", F.lit(now).alias("completed_at"))
        for name, df in {"ledger": ledger, "messages": messages, "facts": facts, **index.tables()}.items():
            df.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")
        return last + messages.count()

    def compact(self) -> None:
        """Write all batches as one, which takes their place; what was there stays for its readers until `vacuum`."""
        number, rows = self._manifest()
        live = self._live(rows)
        if len(live) < 2:
            return
        batch = f"batch-{uuid.uuid4().hex}"
        for name, df in {**{n: self._read(n, live) for n in TABLES}, **self._index(live).tables()}.items():
            df.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")
        self._commit(number, batch, max(r.last_id for r in rows), live)  # if another add came first, nothing happens

    def vacuum(self) -> None:
        """Delete the parts of batches that others have replaced."""
        for b in {b for r in self._manifest()[1] for b in r.replaces or []}:
            for name in (*TABLES, *SCHEMAS):
                at, fs = self._path(f"{name}/batch={b}")
                fs.delete(at, True)

    def _index(self, batches: list[str]) -> Index:
        return Index.of_parts(*(self.spark.read.schema(SCHEMAS[n]).option("basePath", f"{self.path}/{n}").parquet(*(f"{self.path}/{n}/batch={b}" for b in batches)) for n in SCHEMAS))

    def index(self) -> Index:
        """The batches' indexes as one: their messages differ, so nothing is indexed again."""
        live = self._live(self._manifest()[1])
        return self._index(live) if live else build(documents(self.read("messages"), ingest.contexts(self.read("messages")), None))

    def search(self, queries: DataFrame, index: Index | None = None) -> DataFrame:
        return search(queries, index or self.index(), self.read("messages"), self.bonus, self.model)


def health() -> dict[str, str]:
    return {"status": "ok"}
