"""Retrieval metrics over results and expected evidence."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.functions.text import casefold


def checked_depths(top_ks: list[int]) -> list[int]:
    """The distinct depths in order; all within 1 and 100."""
    found = sorted({int(k) for k in top_ks})
    if not found or found[0] < 1 or found[-1] > 100:
        raise ValueError("depths must be between 1 and 100")
    return found


def evidence_ranks(results: DataFrame, evidence: DataFrame, exact: bool = False) -> DataFrame:
    """`evidence` (query_id, at, text) with `rank`: the first place whose content holds it (or is it), or null."""
    hit = casefold(F.col("content")) == casefold(F.col("text")) if exact else casefold(F.col("content")).contains(casefold(F.col("text")))
    found = evidence.join(results.select("query_id", "place", "content"), "query_id").where(hit)
    return evidence.join(found.groupBy("query_id", "at").agg(F.min("place").alias("rank")), ["query_id", "at"], "left")


def by_case(ranks: DataFrame, top_ks: list[int]) -> DataFrame:
    """Per query: evidence items, the rank of the first listed item found, the best rank, and hits at each depth."""
    found = F.col("rank").isNotNull()
    hits = [F.count_if(F.coalesce(F.col("rank") <= k, F.lit(False))).alias(f"hits_{k}") for k in top_ks]
    return ranks.groupBy("query_id").agg(F.count(F.lit(1)).alias("items"), F.min_by(F.when(found, F.col("rank")), F.when(found, F.col("at"))).alias("listed"), F.min("rank").alias("best"), *hits)


def _share(a: Column, b: Column) -> Column:
    return F.bround(F.coalesce(a / F.when(b != 0, b), F.lit(0.0)), 4)


def summary(cases: DataFrame, top_ks: list[int]) -> DataFrame:
    """One row: cases, items, mrr (first listed), mrr_best, and recall, coverage and hit at each depth."""
    n, items = F.count(F.lit(1)), F.coalesce(F.sum("items"), F.lit(0))
    out = [n.alias("cases"), items.cast("long").alias("evidence_items"), _share(F.sum(F.coalesce(1 / F.col("listed"), F.lit(0.0))), n).alias("mrr"), _share(F.sum(F.coalesce(1 / F.col("best"), F.lit(0.0))), n).alias("mrr_best")]
    for k in top_ks:
        h = F.col(f"hits_{k}")
        out += [_share(F.sum(h).cast("double"), items).alias(f"recall_{k}"), _share(F.count_if(h == F.col("items")).cast("double"), n).alias(f"coverage_{k}"), _share(F.count_if(h > 0).cast("double"), n).alias(f"hit_{k}")]
    return cases.agg(*out)


def by_category(cases: DataFrame, category: str = "category") -> DataFrame:
    """Per category (`unknown` if missing): questions and hit_at_1, by the first listed item found."""
    return cases.groupBy(F.coalesce(F.col(category).cast("string"), F.lit("unknown")).alias("category")).agg(F.count(F.lit(1)).alias("questions"), _share(F.count_if(F.coalesce(F.col("listed") == 1, F.lit(False))).cast("double"), F.count(F.lit(1))).alias("hit_at_1"))


def compared(current: DataFrame, earlier: DataFrame, columns: list[str]) -> DataFrame:
    """One row: both summaries' columns and their differences."""
    a, b = current.select(*[F.col(c).alias(f"current_{c}") for c in columns]), earlier.select(*[F.col(c).alias(f"earlier_{c}") for c in columns])
    both = a.withColumn("one", F.lit(1)).join(b.withColumn("one", F.lit(1)), "one").drop("one")
    return both.select("*", *[F.bround(F.col(f"current_{c}") - F.col(f"earlier_{c}"), 4).alias(f"delta_{c}") for c in columns])


def timed(run, n: int) -> tuple[object, float]:
    """What `run` returns, and the milliseconds it took for each of n queries."""
    began = time.perf_counter()
    got = run()
    return got, round((time.perf_counter() - began) * 1000 / n, 3) if n else 0.0
