"""From message batches to the stored tables: ledger, messages, facts and neighbour contexts.

A request is a row (request_id, user_id, session_id, messages, arrival); messages is an
array<struct<role, content, timestamp>>. A request id counts once for ever, whoever sends it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.functions.text import stripped
from mnemora.sources.tables import written

MESSAGE = "struct<role:string,content:string,timestamp:bigint>"
#: More than the facts of one message: each takes 16 bytes at least in a row, which has less than 2^31.
MOST_FACTS = 1 << 27
REQUEST = f"request_id string, user_id string, session_id string, messages array<{MESSAGE}>, arrival long"


def checked(requests: DataFrame) -> DataFrame:
    """`requests` with stripped texts and a column `fault`: null, or what is wrong."""
    text = ["request_id", "user_id", "session_id"]
    clean = F.transform("messages", lambda m: F.struct(stripped(m["role"]).alias("role"), stripped(m["content"]).alias("content"), m["timestamp"].alias("timestamp")))
    out = requests.withColumns({c: stripped(F.col(c)) for c in text} | {"messages": clean})
    fault = F.when(F.coalesce(F.size("messages"), F.lit(0)) < 1, "messages")
    for c in text:
        fault = fault.when(F.coalesce(F.col(c), F.lit("")) == "", c)
    blank = F.exists("messages", lambda m: (F.coalesce(m["role"], F.lit("")) == "") | (F.coalesce(m["content"], F.lit("")) == ""))
    return out.withColumn("fault", fault.when(blank, "message"))


def valid(requests: DataFrame) -> DataFrame:
    return checked(requests).where("fault is null").drop("fault")


def new_requests(requests: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """The first arrival of each request id that isn't in the ledger yet."""
    fields = [c for c in requests.columns if c != "request_id"]
    first = requests.groupBy("request_id").agg(F.min_by(F.struct(*fields), "arrival").alias("r")).select("request_id", "r.*")
    return first if ledger is None else first.join(ledger.select("request_id"), "request_id", "left_anti")


def dense_ids(rows: DataFrame, order: list[str], to: str = "id", first: int = 1) -> DataFrame:
    """`rows` with ids from `first` on in the given total order.

    Rows are dealt out by ranges of the order; a range's ids start after all rows of those before it.
    Only the ranges' sizes meet in one place.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = written(dealt.withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(to, (F.col("_before") + F.col("_own") + F.lit(first - 1)).cast("long")).drop("_part", "_own", "_before")


def messages_of(requests: DataFrame, now: str, first: int = 1) -> DataFrame:
    """A row for each message: id, request_id, user_id, session_id, role, content, event_ts, sequence, created_at."""
    each = requests.select("arrival", "request_id", "user_id", "session_id", F.posexplode("messages").alias("sequence", "m"))
    ids = dense_ids(each, ["arrival", "request_id", "sequence"], first=first)
    return ids.select("id", "request_id", "user_id", "session_id", "m.role", "m.content", F.col("m.timestamp").alias("event_ts"), "sequence", F.lit(now).alias("created_at"))


def contexts(messages: DataFrame) -> DataFrame:
    """id, user_id and the text of each message with its neighbours in the same request."""
    batch = Window.partitionBy("request_id").orderBy("sequence")
    around = F.concat_ws("\n", F.lag("content").over(batch), F.col("content"), F.lead("content").over(batch))
    return messages.select("id", "user_id", around.alias("context"))


def facts_of(messages: DataFrame, facts: Column) -> DataFrame:
    """fact_id, user_id, source_message_id, fact_text of an array<string> column; repeats within a message count once.

    Ids rise with the message and the fact's place in it.
    """
    clean = F.array_distinct(F.filter(F.transform(facts, stripped), lambda x: x != ""))
    each = messages.select("id", "user_id", F.posexplode(clean).alias("at", "fact_text"))
    return each.select((F.col("id") * MOST_FACTS + F.col("at")).alias("fact_id"), "user_id", F.col("id").alias("source_message_id"), "fact_text")
