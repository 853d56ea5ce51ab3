"""The whole search, for many queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemora.operators import rank
from mnemora.operators.analyse import analysed, phrases
from mnemora.operators.index import Index
from mnemora.operators.model import MOST_TERMS, Model, allowed_order, strings
from mnemora.sources.tables import held

MOST_RESULTS = 100


def checked_queries(queries: DataFrame) -> DataFrame:
    """`queries` with top_k (100 if null) and a column fault: null or what is wrong."""
    q = queries.withColumn("top_k", F.coalesce("top_k", F.lit(MOST_RESULTS)))
    for c in ("query", "user_id"):
        q = q.withColumn(c, F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return q.withColumn("fault", F.when(empty("query"), "query").when(empty("user_id"), "user_id").when(~F.col("top_k").between(1, MOST_RESULTS), "top_k"))


def accepted(queries: DataFrame) -> DataFrame:
    """`queries` with stripped texts and top_k filled; an error if one of them is at fault."""
    checked = held(checked_queries(queries))
    bad = checked.where("fault is not null").orderBy("query_id").first()
    if bad:
        raise ValueError(f"query {bad.query_id}: {bad.fault} is missing or out of range")
    return checked.drop("fault")


def candidates(queries: DataFrame, index: Index, messages: DataFrame, bonus: float = 0.0, channels: list[tuple[str, str]] | None = None) -> DataFrame:
    """All fused candidates: query_id, message, same (a digest of the content), event_ts, rrf and score."""
    q = held(analysed(queries))
    ranks = rank.best(phrases(q), index, channels or rank.all_channels(), q)
    # at most nine pools for each query; which side is broadcast is settled by their size at run time
    own = messages.select(F.col("id").alias("message"), "content", "event_ts").join(rank.fused(ranks), "message").withColumn("same", rank.same(F.col("content"))).drop("content")
    return rank.with_time(own.join(q.select("query_id", "direction"), "query_id"), bonus)


def search(queries: DataFrame, index: Index, messages: DataFrame, bonus: float = 0.0, model: Model | None = None, channels: list[tuple[str, str]] | None = None) -> DataFrame:
    """(query_id, place, id, content, score, created_at): each query's results in order.

    `queries` has query_id, query, user_id, top_k (100 if null) and maybe options and corpus. With a
    model, its terms are added after stop words went, and its order puts the ids it names first.
    A query without text or user, or with another top_k than 1 to 100, is an error that names it.
    """
    queries = accepted(queries)
    queries = queries if "options" in queries.columns else queries.withColumn("options", F.lit(None).cast("array<string>"))
    if model:
        queries = queries.withColumn("planned", strings(model.plan_query(F.col("query"), F.col("options")), MOST_TERMS))
    kept = rank.distinct_contents(candidates(queries, index, messages, bonus, channels))
    kept = kept.withColumn("id", F.concat(F.lit("mem_"), F.col("message").cast("string")))
    own = messages.select(F.col("id").alias("message"), "content", "created_at")
    asked = queries.select("query_id", "query", "options", "top_k")
    if model:
        # a query has at most nine pools of candidates, so its list is bounded
        kept = kept.join(own, "message")
        lists = kept.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id", "content"))), lambda x: F.struct(x["id"].alias("id"), x["content"].alias("content"))).alias("offered"))
        lists = lists.join(asked.select("query_id", "query", "options"), "query_id")
        order = allowed_order(model.rank_candidates(F.col("query"), F.col("options"), F.col("offered")), F.transform("offered", lambda x: x["id"]))
        kept = kept.join(lists.select("query_id", order.alias("order")), "query_id")
        at = F.coalesce(F.nullif(F.array_position("order", F.col("id")), F.lit(0)), F.size("order") + 1)
        kept = kept.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(at, "place")))
    out = kept.join(asked.select("query_id", "top_k"), "query_id").where("place <= top_k")
    # contents are long, so only results get theirs
    out = out if model else out.join(own, "message")
    return out.select("query_id", F.col("place").cast("long").alias("place"), "id", "content", F.bround("score", 6).alias("score"), "created_at")


def baseline(queries: DataFrame, index: Index, messages: DataFrame) -> DataFrame:
    """The frozen earlier retriever: the raw channel alone, stop words and all, without fusion or removal of repeats."""
    q = analysed(accepted(queries)).withColumn("terms", F.col("raw")).withColumn("entities", F.array().cast("array<string>"))
    q = held(q.withColumn("pool", F.col("top_k")))
    best = rank.best(phrases(q), index, [("any", "raw")], q)
    own = messages.select(F.col("id").alias("message"), "content", "created_at").join(best, "message")
    return own.select("query_id", F.col("rank").cast("long").alias("place"), F.concat(F.lit("mem_"), F.col("message").cast("string")).alias("id"), "content", F.bround("score", 6).alias("score"), "created_at")
