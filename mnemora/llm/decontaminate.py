"""Benchmark decontamination by a prefix-filtered set join.

A window (13 consecutive item words, or all of a shorter item) occurs in a document where the same
words stand consecutively. Containment must be complete, so the necessary prefix of a window's
shingles, ordered by rarity over all documents, is its single rarest one (shingles are of one word,
which also serves items of one word). Documents' words are joined with these prefix shingles; the
length bound (the document has as many words as the window) and the positional bound (the window
fits around the place where the shingle stands) cut candidates, and what is left is verified
exactly on the item-sized window. Explode, join, bounds and verification run in one stage: a word
that is no prefix shingle is never materialised or shuffled, and only hits leave the map side.

The benchmark's windows are broadcast in blocks of at most `block` windows each, so what is
broadcast is bounded whatever the benchmark's size; the documents are read once for each block. Hits
meet by id and digest of the text, not by a row number, so that neither a block's own reading nor a task
that is run again can part or mix rows. Everything is DataFrame operations.

Defined results: a null or wordless text has no words and no hits and isn't contaminated; null or
wordless items are ignored; repeated items count once; repeated document rows give a row each; a
null item_id is ignored; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemora.llm.words import BREAKS, LOWER, UPPER, spaced, words
from mnemora.sources.tables import bounded, table, text_digest, without, written

WINDOW = 13
#: Most windows in one broadcast: about 300 bytes each.
BLOCK = 200_000


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """The distinct windows: win array<string>, items array<string> that have it."""
    each = items.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), words(spaced(F.col("text"))).alias("ws")).where("size(ws) > 0")
    each = each.select("item_id", "ws", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("ws") - size + 1))).alias("i"))
    each = each.select(F.slice("ws", F.col("i"), F.lit(size)).alias("win"), "item_id")
    return each.groupBy("win").agg(F.sort_array(F.collect_set("item_id")).alias("items"))


def tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each document: its id, its text's digest and its words."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_digest(F.col(text_col)).alias("digest"), spaced(F.col(text_col)).alias("sp"))
    return rows.select("doc_id", "digest", words(F.col("sp")).alias("ws"))


def prefixes(docs: DataFrame, wins: DataFrame) -> DataFrame:
    """Each window with its rarest shingle over `docs` (as `tokens`) and the place of that in it."""
    vocabulary = wins.select(F.explode("win").alias("token")).distinct()
    counts = docs.select(F.explode("ws").alias("token")).join(bounded(vocabulary, 5 * BLOCK), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    places = wins.select("win", "items", F.posexplode("win").alias("offset", "token")).join(bounded(written(counts, "token-counts"), 5 * BLOCK), "token", "left")
    by_rarity = Window.partitionBy("win").orderBy(F.coalesce("n", F.lit(0)), "token", "offset")
    return places.withColumn("r", F.row_number().over(by_rarity)).where("r = 1").select("token", "offset", "win", F.size("win").alias("len"), "items")


def occurrences(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Per document row: doc_id, n_words, spans (places of windows as array<struct<s, e>>), items."""
    toks = tokens(docs, id_col, text_col)
    wins = written(windows(items, size), "windows")
    blocks = max(1, -(-wins.count() // block))
    pre = written(prefixes(toks, wins).withColumn("part", F.pmod(F.xxhash64("win"), F.lit(blocks))), "prefixes")
    # the empty word stands once at the end of each document and matches a row that keeps the document
    each = toks.select("doc_id", "digest", "ws", F.size("ws").alias("n_words"), F.posexplode(F.concat("ws", F.array(F.lit("")))).alias("pos", "token"))
    keep = docs.sparkSession.range(1).select(F.lit("").alias("token"), F.lit(0).alias("offset"), F.array().cast("array<string>").alias("win"), F.lit(0).alias("len"), F.lit(None).cast("array<string>").alias("items"))

    def part(i: int) -> DataFrame:
        own = pre.where(F.col("part") == i).drop("part")
        own = own.unionByName(keep) if i == 0 else own
        found = each.join(F.broadcast(own), "token")
        start = F.col("pos") - F.col("offset")
        fits = (start >= 0) & (start + F.col("len") <= F.col("n_words"))  # positional and length bounds
        found = found.where((F.col("len") == 0) | (fits & (F.slice("ws", F.greatest(start + 1, F.lit(1)), F.col("len")) == F.col("win"))))
        span = F.when(F.col("len") > 0, F.struct(start.alias("s"), (start + F.col("len")).alias("e")))
        return found.select("doc_id", "digest", "n_words", span.alias("span"), "items")

    found = reduce(DataFrame.unionByName, [part(i) for i in range(blocks)])
    each = found.groupBy("doc_id", "digest").agg(F.max("n_words").alias("n_words"), F.sort_array(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.count_if(F.col("span").isNull()).alias("rows"))
    # rows that repeat an id and a text were counted by the empty word and come back as often
    return each.withColumn("rows", F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int")))).drop("rows", "digest")


def covered(spans: str) -> F.Column:
    """How many words the sorted spans cover together."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["to"], x["s"]))).alias("n"), F.greatest(a["to"], x["e"]).alias("to"))
    return F.aggregate(spans, zero, step, lambda a: a["n"].cast("long"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, items and contaminated."""
    found = occurrences(docs, items, id_col, text_col, **kw)
    hit = found.select("doc_id", F.col("n_words").cast("long").alias("n_words"), covered("spans").alias("n_hit"), "items", "spans")
    return hit.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """`docs` without contaminated rows; same columns."""
    digest = text_digest(docs[text_col])
    rows = docs.select(F.struct(docs[id_col].alias("id"), digest.alias("digest")).alias("key"), docs[text_col].alias("text"))
    gone = contamination(rows, items, "key", "text", **kw).where("contaminated")
    return without(docs, gone.select("doc_id.id", "doc_id.digest"), id_col, digest)


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = "list_filter(string_split(regexp_replace(translate(coalesce(text, ''), '{u}', '{l}'), '{b}', ' ', 'g'), ' '), lambda x: x <> '')".format(u=UPPER, l=LOWER, b=BREAKS)
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
w AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + {WINDOW} - 1], ' ') AS win, least(len(ws), {WINDOW}) AS n
      FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(1, len(ws) - {WINDOW} + 1))) AS i FROM b WHERE len(ws) > 0)),
p AS (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM w) WHERE len(ws) >= n),
h AS (SELECT p.doc_id, p.i, p.n, w.item_id FROM p JOIN w ON w.n = p.n AND w.win = array_to_string(p.ws[p.i:p.i + p.n - 1], ' ')),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS j FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.ws) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
