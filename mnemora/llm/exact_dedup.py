"""Exact deduplication with a heavy-hitter split.

Rows are compared by the SHA-256 of their text after lower-casing A-Z. A Misra-Gries summary
(`freqItems`, mergeable, at most 1/support entries) names the digests that may be frequent; their
exact counts are then taken. These winners, at most 1/support rows, are broadcast, so rows of a
large group are decided in the map stage and never meet in one task. All other digests go through
an ordinary aggregation with map-side combining, and only groups of two or more are joined back.

Everything is DataFrame operations.

Defined results: a null text counts as empty; of equal texts the largest id stays; rows that repeat
an id and a text share one verdict; a null id never is the one that stays unless its whole group
has null ids; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.llm.words import LOWER, UPPER, ascii_lower
from mnemora.sources.tables import table, without, written

#: A digest with at least this share of the rows is surely found by the summary.
SUPPORT = 0.001


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.sha2(ascii_lower(F.col(text_col)), 256).alias("text_sha256"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """Each row's doc_id, keep_id, group_size, kept and text_sha256."""
    rows = written(digests(docs, id_col, text_col), "digests")
    summary = rows.stat.freqItems(["text_sha256"], support)
    suspects = summary.select(F.explode("text_sha256_freqItems").alias("text_sha256"))
    group = [F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    # at most 1/support rows: the summary holds no more
    winners = rows.join(F.broadcast(suspects), "text_sha256").groupBy("text_sha256").agg(*group).where("group_size > 1")
    winners = written(winners, "winners").withColumn("heavy", F.lit(True))
    split = rows.join(F.broadcast(winners), "text_sha256", "left")
    heavy = split.where("heavy").drop("heavy")
    light = split.where("heavy is null").select("text_sha256", "doc_id")
    repeated = light.groupBy("text_sha256").agg(*group).where("group_size > 1")
    light = light.join(repeated, "text_sha256", "left").withColumns({"keep_id": F.coalesce("keep_id", "doc_id"), "group_size": F.coalesce("group_size", F.lit(1).cast("long"))})
    both = heavy.unionByName(light)
    return both.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """`docs` without the rows whose text another row with a larger id has; same columns."""
    gone = exact_groups(docs, id_col, text_col, support).where("not kept").select("doc_id", F.unhex("text_sha256"))
    return without(docs, gone, id_col, F.unhex(F.sha2(ascii_lower(docs[text_col]), 256)))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
