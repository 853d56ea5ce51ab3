"""From queries to phrases: terms, entities, direction of time and pool size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.functions.text import STOP_WORDS, casefold, direction, index_tokens, pool_size, query_terms


def content_terms(raw: Column) -> Column:
    """Without stop words; all of them if nothing else is left."""
    kept = F.filter(raw, lambda t: ~casefold(t).isin(*STOP_WORDS))
    return F.when(F.size(kept) > 0, kept).otherwise(raw)


def distinct_terms(terms: Column) -> Column:
    """The first spelling of each case-folded term, in order; empty ones go."""
    folded = F.transform(terms, casefold)
    return F.filter(terms, lambda t, i: (casefold(t) != "") & (F.array_position(folded, casefold(t)) == i + 1))


def entity_terms(raw: Column) -> Column:
    """The first two terms after the first that are longer than a letter and start with a capital."""
    return F.slice(F.filter(raw, lambda t, i: (i > 0) & (F.length(t) > 1) & F.substring(t, 1, 1).rlike(r"^\p{Lu}")), 1, 2)


def analysed(queries: DataFrame) -> DataFrame:
    """`queries` (query_id, query, user_id, top_k, maybe corpus and planned) with raw, terms, entities, others, direction and pool."""
    q = queries if "corpus" in queries.columns else queries.withColumn("corpus", F.lit(""))
    q = q if "planned" in q.columns else q.withColumn("planned", F.array().cast("array<string>"))
    q = q.withColumn("raw", query_terms(F.col("query")))
    q = q.withColumn("terms", distinct_terms(F.concat(content_terms(F.col("raw")), F.coalesce("planned", F.array().cast("array<string>")))))
    q = q.withColumn("entities", entity_terms(F.col("raw")))
    keys = F.transform("entities", casefold)
    q = q.withColumn("others", F.filter("terms", lambda t: ~F.array_contains(keys, casefold(t))))
    return q.withColumns({"direction": direction(F.col("query")), "pool": pool_size(F.col("top_k"))})


def phrases(q: DataFrame) -> DataFrame:
    """(query_id, corpus, user_id, family, kind, no, tokens): `any` phrases, and those of which entity and content are needed."""
    key = ["query_id", "corpus", "user_id"]

    def part(rows: DataFrame, family: str, kind: str, terms: str) -> DataFrame:
        return rows.select(*key, F.lit(family).alias("family"), F.lit(kind).alias("kind"), F.posexplode(terms).alias("no", "term"))

    both = q.where((F.size("entities") > 0) & (F.size("others") > 0))
    out = part(q, "any", "term", "terms").unionByName(part(both, "both", "entity", "entities")).unionByName(part(both, "both", "content", "others"))
    return out.select(*key, "family", "kind", "no", index_tokens(F.replace("term", F.lit('"'), F.lit(""))).alias("tokens")).where(F.size("tokens") > 0)
