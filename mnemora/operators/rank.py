"""Matching, BM25, fusion of channels and the final order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.functions.porter import with_stem
from mnemora.functions.text import MOST_POOL, casefold
from mnemora.operators.index import BASES, Index
from mnemora.sources.tables import BROADCAST_IDS, bounded, discard, held, text_digest, written

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Most tokens that a scan's filter names.
MOST_NAMES = 2000
#: Most tokens of phrases, by user and index, that are broadcast: some 100 bytes each.
MOST_PLACES = 1_000_000
#: Most phrases of queries that are broadcast at once, some 50 bytes each; the parts are read once for each such block.
MOST_ASKED = 2_000_000
#: Reciprocal rank fusion.
RRF = 60
#: (family, index): weight of a channel. Channels of weight 0 only add candidates.
WEIGHTS = {
    ("any", "raw"): 1.0, ("any", "raw_porter"): 1.0, ("any", "fact"): 1.0, ("any", "fact_porter"): 1.0, ("any", "context"): 0.5, ("any", "context_porter"): 0.5,
    ("both", "raw"): 0.0, ("both", "raw_porter"): 0.0, ("both", "context_porter"): 0.0,
}


def query_tokens(phrases: DataFrame, channels: list[tuple[str, str]]) -> DataFrame:
    """A row for each token of a phrase and each channel, in the index's form."""
    each = phrases.select("*", F.size("tokens").alias("width"), F.posexplode("tokens").alias("off", "plain"))
    each = with_stem(each, "plain")
    forms = F.array(*[F.struct(F.lit(f).alias("fam"), F.lit(i).alias("idx"), F.col("stem" if i.endswith("_porter") else "plain").alias("token")) for f, i in channels])
    return each.select("query_id", "corpus", "user_id", "family", "kind", "no", "width", "off", F.explode(forms).alias("f")).where("f.fam = family").select("query_id", "corpus", "user_id", "family", "kind", "no", "width", "off", "f.idx", "f.token")


def occurrences(tokens: DataFrame, postings: DataFrame, keys: list[str], on: list[str]) -> DataFrame:
    """Per phrase (keys) and document: how often the phrase's tokens stand one after the other (tf).

    One shuffle by phrase or query and document serves every grouping here and in bm25, as their keys hold
    it. A place of a document has one token, so each offset of a phrase is met once from a start.
    """
    found = postings.join(tokens, on).withColumn("start", F.col("pos") - F.col("off"))
    found = found.repartition(*[k for k in ("query_id", "phrase", "idx") if k in keys], "doc")
    doc = [*keys, "doc", "message", "len"]
    whole = found.groupBy(*doc, "width", "start").agg(F.count(F.lit(1)).alias("k")).where("k = width")
    return whole.groupBy(*doc).agg(F.count(F.lit(1)).alias("tf"))


def wanted(index: Index, tokens: DataFrame) -> DataFrame:
    """The postings of some tokens; up to MOST_NAMES are pushed to the scan, which skips row groups without them."""
    names = [r.token for r in tokens.select("token").distinct().limit(MOST_NAMES + 1).collect()]
    return index.postings if len(names) > MOST_NAMES else index.postings.where(F.col("token").isin(names))


def phrase_counts(tokens: DataFrame, index: Index, postings: DataFrame) -> DataFrame:
    """(corpus, idx, phrase, n): documents of all users that hold the phrase. Single tokens' counts are stored ones."""
    named = tokens.withColumn("phrase", F.collect_list("token").over(Window.partitionBy("query_id", "family", "kind", "no", "idx").orderBy("off").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    distinct = held(named.select("corpus", "idx", F.array_join("phrase", " ").alias("phrase"), "width", "off", "token").distinct())
    one = index.token_stats.join(distinct.where("width = 1"), ["corpus", "idx", "token"]).select("corpus", "idx", "phrase", "n")
    if distinct.where("width > 1").isEmpty():
        return one
    many = occurrences(distinct.where("width > 1"), postings, ["corpus", "idx", "phrase"], ["corpus", "idx", "token"])
    return one.unionByName(many.groupBy("corpus", "idx", "phrase").agg(F.countDistinct("doc").alias("n")))


def bm25(phrases: DataFrame, index: Index, channels: list[tuple[str, str]]) -> DataFrame:
    """(query_id, family, idx, doc, message, score) of a user's matching documents; a higher score is better.

    Statistics are of all users; only then is the match kept to the query's user.
    """
    return _scored(held(query_tokens(phrases, channels)), index)


def _scored(tokens: DataFrame, index: Index) -> DataFrame:
    postings = wanted(index, tokens)
    key = ["query_id", "corpus", "family", "kind", "no", "idx"]
    found = occurrences(tokens, postings, key, ["corpus", "idx", "token", "user_id"])
    names = tokens.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("off", "token"))), lambda x: x["token"]), " ").alias("phrase"))
    n = phrase_counts(tokens, index, postings)
    idf = names.join(n, ["corpus", "idx", "phrase"]).join(index.stats, ["corpus", "idx"])
    ratio = F.log((F.col("n_docs") - F.col("n") + F.lit(0.5)) / (F.col("n") + F.lit(0.5)))
    idf = held(idf.select(*key, F.when(ratio <= 0, F.lit(LEAST_IDF)).otherwise(ratio).alias("idf"), "avg_len"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    scored = found.join(idf, key).groupBy("query_id", "family", "idx", "doc", "message")
    scored = scored.agg(F.sum(part).alias("score"), F.bool_or(F.col("kind") == "entity").alias("e"), F.bool_or(F.col("kind") == "content").alias("c"))
    return scored.where("family = 'any' or (e and c)").drop("e", "c")


def best(phrases: DataFrame, index: Index, channels: list[tuple[str, str]], pools: DataFrame, few: int = 20_000) -> DataFrame:
    """The rows of `ranked(bm25(...), pools)`; for more than `few` tokens of queries by way of `_pruned`."""
    tokens = held(query_tokens(phrases, channels), few)
    if tokens.limit(few + 1).count() <= few:
        return ranked(_scored(tokens, index), pools)
    return _pruned(tokens, index, pools)


def _pruned(tokens: DataFrame, index: Index, pools: DataFrame) -> DataFrame:
    """The best of each channel, exactly, without a shuffle of each query's matching documents.

    What a phrase adds to a document's score is worked out once for all queries of a user, and these parts are
    dealt out by document; there they meet the queries and are summed up. A group is a query and channel, its
    bar the highest of its phrases' own pool-th best parts (a bit less, as they are counted in steps): a pool
    of documents reaches it, so scores below it go before the one shuffle by group. Groups that need entity and
    content have no bar, as what holds both isn't known before.
    """
    phrase = F.array_join(F.collect_list("token").over(Window.partitionBy("query_id", "family", "kind", "no", "idx").orderBy("off").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), " ")
    named = written(tokens.withColumn("phrase", phrase), "named")
    n = phrase_counts(tokens, index, index.postings)
    own = ["corpus", "user_id", "idx", "phrase"]
    lists = named.select(*own).distinct().join(n, ["corpus", "idx", "phrase"]).join(F.broadcast(index.stats), ["corpus", "idx"])
    ratio = F.log((F.col("n_docs") - F.col("n") + F.lit(0.5)) / (F.col("n") + F.lit(0.5)))
    lists = written(lists.select(*own, F.monotonically_increasing_id().alias("list"), F.when(ratio <= 0, F.lit(LEAST_IDF)).otherwise(ratio).alias("idf"), "avg_len"), "lists")

    on = ["corpus", "idx", "token", "user_id"]
    places = written(named.select(*own, "width", "off", "token").distinct().join(lists.select(*own, "list"), own).select(*on, "list", "width", "off"), "places")
    one = index.postings.join(bounded(places.where("width = 1").select(*on, "list"), MOST_PLACES), on).groupBy("list", "doc", "message", "len").agg(F.count(F.lit(1)).alias("tf"))
    if not places.where("width > 1").isEmpty():
        one = one.unionByName(occurrences(places.where("width > 1"), index.postings, ["list"], on))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    parts = one.join(bounded(lists.select("list", "idf", "avg_len"), BROADCAST_IDS), "list").select("list", "doc", "message", part.alias("part"))
    parts = written(parts.sortWithinPartitions("list", "doc"), "parts", dense=True)

    terms = named.where("off = 0").join(lists.select(*own, "list"), own).join(pools.select("query_id", "pool"), "query_id")
    groups = written(terms.select("query_id", "family", "idx", "pool").distinct().withColumn("group", F.monotonically_increasing_id()), "groups")
    terms = terms.drop("pool").join(groups, ["query_id", "family", "idx"]).select("group", "family", "kind", "no", "list", "pool")
    # steps of a 32nd of an octave: few for a list however long it is
    steps = parts.groupBy("list", F.floor(F.log2("part") * 32).alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("low"))
    steps = written(steps.withColumn("above", F.sum("n").over(Window.partitionBy("list").orderBy(F.desc("step")))), "steps")
    bars = terms.select("list", "pool").distinct().join(steps, "list").where("above >= pool").groupBy("list", "pool").agg(F.max("low").alias("bar"))
    terms = terms.join(steps.groupBy("list").agg(F.sum("n").alias("n")), "list").join(bars, ["list", "pool"], "left")
    bar = F.coalesce(F.max(F.when(F.col("family") == "any", F.col("bar"))).over(Window.partitionBy("group")), F.lit(0.0))
    # scores that are equal when rounded count as equal, so there is some room
    terms = written(terms.select("group", "list", "n", (F.col("kind") == "entity").alias("e"), (F.col("kind") == "content").alias("c"), (F.col("family") == "any").alias("any"), (bar - F.lit(1e-9) * (1 + bar)).alias("bar")), "terms")

    rows, matches = terms.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    blocks = 1 + rows // MOST_ASKED
    dealt = parts.repartition(1 + matches // blocks // 1_000_000, "doc")
    scored = None
    for b in range(blocks):
        asked = F.broadcast(terms.where(F.pmod(F.xxhash64("group"), F.lit(blocks)) == b).drop("n"))
        met = dealt.join(asked, "list").groupBy("group", "doc", "message")
        met = met.agg(F.sum("part").alias("score"), F.first("bar").alias("bar"), F.first("any").alias("any"), F.bool_or("e").alias("e"), F.bool_or("c").alias("c"))
        met = met.where("score >= bar and (any or (e and c))").select("group", "doc", "message", "score")
        scored = scored.unionByName(met) if scored else met
    scored = scored.join(bounded(groups, BROADCAST_IDS), "group")
    order = Window.partitionBy("group").orderBy(F.round("score", 12).desc(), F.col("message").desc(), F.col("doc").desc())
    out = scored.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= MOST_POOL) & (F.col("rank") <= F.col("pool")))
    out = written(out.select("query_id", "family", "idx", "doc", "message", "score", "pool", "rank"), "ranked")
    discard(named, lists, places, parts, groups, steps, terms)
    return out


def ranked(scores: DataFrame, pools: DataFrame) -> DataFrame:
    """The best of each channel, with their rank from 1: by score, then the newest message first.

    No pool is above MOST_POOL; naming that bound lets each task drop what can't be among the best before the shuffle.
    """
    order = Window.partitionBy("query_id", "family", "idx").orderBy(F.round("score", 12).desc(), F.col("message").desc(), F.col("doc").desc())
    return scores.join(pools.select("query_id", "pool"), "query_id").withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= MOST_POOL) & (F.col("rank") <= F.col("pool")))


def fused(ranks: DataFrame) -> DataFrame:
    """(query_id, message, rrf): sums of weight / (RRF + rank) over channels."""
    weight = F.lit(0.0)
    for (family, idx), w in WEIGHTS.items():
        weight = F.when((F.col("family") == family) & (F.col("idx") == idx), F.lit(w)).otherwise(weight)
    return ranks.groupBy("query_id", "message").agg(F.sum(weight / (RRF + F.col("rank"))).alias("rrf"))


def with_time(candidates: DataFrame, bonus: float) -> DataFrame:
    """score: rrf and, for queries with a direction, up to `bonus` by the event's place between the candidates' first and last."""
    mine = Window.partitionBy("query_id")
    lo, hi = F.min("event_ts").over(mine), F.max("event_ts").over(mine)
    place = (F.col("event_ts") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo"))
    place = F.when(F.col("direction") > 0, place).when(F.col("direction") < 0, 1 - place)
    return candidates.withColumns({"lo": lo, "hi": hi}).withColumn("score", F.col("rrf") + F.coalesce(F.lit(float(bonus)) * place, F.lit(0.0))).drop("lo", "hi")


def final_order(prefix: str = "") -> list:
    return [F.round("score", 12).desc(), F.coalesce("event_ts", F.lit(0)).desc(), F.concat(F.lit("mem_"), F.col("message").cast("string")).asc()]


def distinct_contents(candidates: DataFrame) -> DataFrame:
    """The best of each case-folded content (column `same`), with `place` from 1 in the final order."""
    best = Window.partitionBy("query_id", "same").orderBy(*final_order())
    kept = candidates.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*final_order())))


def same(content: Column) -> Column:
    """Equal for contents that count as the same; far shorter than they are."""
    return text_digest(casefold(content)).alias("same")


def all_channels() -> list[tuple[str, str]]:
    assert {i.removesuffix("_porter") for _, i in WEIGHTS} == set(BASES)
    return list(WEIGHTS)
