"""Inverted indexes as one table of postings with their statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.functions.porter import with_stem
from mnemora.functions.text import index_tokens
from mnemora.sources.tables import bounded, discard, written

#: The indexed texts; each has a plain and a stemmed index.
BASES = ("raw", "fact", "context")
#: Most tokens with their stems that are broadcast: some 100 bytes each.
MOST_STEMS = 1_000_000


@dataclass
class Index:
    """postings (corpus, idx, token, doc, message, user_id, pos, len), token_stats (corpus, idx, token, n) and stats (corpus, idx, n_docs, total_len, avg_len)."""

    postings: DataFrame
    token_stats: DataFrame
    stats: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        """What to write: each file of postings is sorted by index and token, so that scans for a few tokens skip row groups."""
        return {"postings": self.postings.select(_names("postings")).sortWithinPartitions("idx", "token"), "token_stats": self.token_stats.select(_names("token_stats")), "stats": self.stats.select(_names("stats"))}

    @staticmethod
    def of_parts(postings: DataFrame, token_stats: DataFrame, stats: DataFrame) -> Index:
        """One index of the tables of several, which have no document in common: counts add up."""
        token_stats = token_stats.groupBy("corpus", "idx", "token").agg(F.sum("n").alias("n"))
        return Index(postings, token_stats, stats.groupBy("corpus", "idx").agg(*_sizes()))


SCHEMAS = {
    "postings": "corpus string, token string, doc long, message long, user_id string, pos int, len int, idx string",
    "token_stats": "corpus string, idx string, token string, n long",
    "stats": "corpus string, idx string, n_docs long, total_len long, avg_len double",
}


def _names(table: str) -> list[str]:
    return [c.split()[0] for c in SCHEMAS[table].split(", ")]


def _sizes() -> list:
    return [F.sum("n_docs").alias("n_docs"), F.sum("total_len").alias("total_len"), (F.sum("total_len") / F.sum("n_docs")).alias("avg_len")]


def documents(messages: DataFrame, contexts: DataFrame, facts: DataFrame | None) -> DataFrame:
    """(idx, doc, message, user_id, content) of all texts to index; a column corpus is carried if messages have it."""
    corpus = [F.col("corpus") if "corpus" in messages.columns else F.lit("").alias("corpus")]
    own = messages.select(F.col("id").alias("message"), *corpus)
    raw = messages.select(F.lit("raw").alias("idx"), F.col("id").alias("doc"), F.col("id").alias("message"), "user_id", "content", *corpus)
    around = contexts.join(own, contexts["id"] == own["message"]).select(F.lit("context").alias("idx"), F.col("id").alias("doc"), "message", "user_id", F.col("context").alias("content"), "corpus")
    out = raw.unionByName(around)
    if facts is not None:
        told = facts.join(own, facts["source_message_id"] == own["message"])
        out = out.unionByName(told.select(F.lit("fact").alias("idx"), F.col("fact_id").alias("doc"), "message", "user_id", F.col("fact_text").alias("content"), "corpus"))
    return out


def build(docs: DataFrame) -> Index:
    """Plain and stemmed postings. Stems are made once for each distinct token and joined."""
    cut = docs.select("corpus", "idx", "doc", "message", "user_id", index_tokens(F.col("content")).alias("tokens"))
    cut = written(cut.withColumn("len", F.size("tokens")), "tokens")
    plain = cut.select("corpus", "idx", "doc", "message", "user_id", "len", F.posexplode("tokens").alias("pos", "token"))
    stems = written(with_stem(plain.select("token").distinct(), "token"), "stems")
    # a few rows for each word of the language: with them broadcast, the postings needn't be shuffled
    stemmed = plain.join(bounded(stems, MOST_STEMS), "token").withColumn("idx", F.concat("idx", F.lit("_porter"))).withColumn("token", F.col("stem")).drop("stem")
    columns = ["corpus", "idx", "token", "doc", "message", "user_id", "pos", "len"]
    postings = written(plain.select(columns).unionByName(stemmed.select(columns)).sortWithinPartitions("idx", "token", "doc"), "postings", dense=True)
    # texts are dealt out, not their far larger postings, and so that a task has some million tokens
    tasks = 1 + (cut.agg(F.sum("len")).first()[0] or 0) // 1_000_000
    held_by = cut.repartition(tasks, "idx", "doc").select("corpus", "idx", "doc", F.explode(F.array_distinct("tokens")).alias("token"))
    stems_by = held_by.join(bounded(stems, MOST_STEMS), "token").select("corpus", F.concat("idx", F.lit("_porter")).alias("to"), "idx", "doc", F.col("stem").alias("token")).groupBy("corpus", "idx", "doc", "token", "to").agg(F.lit(1))
    token_stats = held_by.select("corpus", "idx", "token").unionByName(stems_by.select("corpus", F.col("to").alias("idx"), "token")).groupBy("corpus", "idx", "token").agg(F.count(F.lit(1)).alias("n"))
    size = cut.groupBy("corpus", "idx").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("len").cast("long").alias("total_len"), F.avg("len").alias("avg_len"))
    both = size.unionByName(size.withColumn("idx", F.concat("idx", F.lit("_porter"))))
    index = Index(postings, written(token_stats, "token-stats"), written(both, "stats"))
    discard(cut, stems)
    return index
