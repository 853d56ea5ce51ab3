"""The engine's queries over the shared tables, with SQL of the same meaning.

`conversations` stand for stored messages: a conversation is a request and a session, its id by 20
is the user, a message's time is missing for every seventh id. Everything runs over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemora.functions import text
from mnemora.functions.porter import stem_sql, with_stem
from mnemora.operators import analyse, evaluate, ingest, rank
from mnemora.operators.index import Index, build, documents
from mnemora.operators.model import RuleModel
from mnemora.plans import search as plan
from mnemora.sources import cases as sources
from mnemora.sources.tables import forgetting, table, written

NOW = "2026-01-01T00:00:00Z"
BONUS = 0.001
PLAIN = [("any", "raw"), ("any", "fact"), ("any", "context"), ("both", "raw")]
#: (query_id, query, user, top_k)
ASKED = [
    (1, "tion ther", 3, 10), (2, "the that", 5, 10), (3, "what is the current tion", 7, 10), (4, "que la von", 1, 13), (5, "Und der Die then", 2, 10), (6, '"than then" ble', 4, 10), (7, "zzzzqq", 0, 10),
    (8, "Where was the previous Tion Ble of Than", 9, 60), (9, "la que LA Que et", 11, 5), (10, "现在 tion", 13, 100), (11, "before the ther", 12, 10), (12, "???", 6, 10), (13, "is_the Ärger of", 8, 10), (14, "thered relations erings", 10, 10),
]


def asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, q, f"user:{u}", k) for i, q, u, k in ASKED], "query_id int, query string, user_id string, top_k int")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as requests, in order of arrival."""
    turn = F.struct("turn", F.col("role"), F.col("text").alias("content"), F.lit(None).cast("long").alias("timestamp"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("m"))
    messages = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"), x["timestamp"].alias("timestamp")))
    key = F.concat(F.lit("conv:"), F.col("conv_id").cast("string"))
    return rows.select(key.alias("request_id"), F.concat(F.lit("user:"), (F.col("conv_id") % 20).cast("string")).alias("user_id"), key.alias("session_id"), messages.alias("messages"), F.col("conv_id").alias("arrival"))


def twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request again later, by another user and with other messages."""
    first = requests(spark, sf_dir)
    again = first.withColumns({"user_id": F.lit("user:other"), "arrival": F.col("arrival") + 10**9, "messages": F.slice("messages", 1, 1)})
    return first.unionByName(again)


@lru_cache(maxsize=8)
def _store(app: str, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, Index]:
    spark = SparkSession.getActiveSession()
    found = ingest.messages_of(ingest.valid(requests(spark, sf_dir)), NOW)
    number = F.regexp_extract("request_id", r"(\d+)$", 1).cast("long")
    found = found.withColumn("event_ts", F.when(F.col("id") % 7 != 0, number * 1000 + F.col("sequence")))
    found = written(found, "messages")
    around = written(ingest.contexts(found), "contexts")
    facts = written(ingest.facts_of(found, RuleModel().extract_facts(F.col("content"))), "facts")
    return found, around, facts, build(documents(found, around, facts))


def store(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, Index]:
    """Messages, contexts, facts and the index, made once for a session and folder."""
    return _store(spark.sparkContext.applicationId, sf_dir)


def _sha(c: str) -> F.Column:
    return F.sha2(F.col(c), 256).alias(f"{c}_sha256")


def ingest_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir)[0].select("id", "request_id", "user_id", "role", _sha("content"), "event_ts", F.col("sequence").cast("long").alias("sequence"), "created_at")


def ingest_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = requests(spark, sf_dir).where("arrival % 5 = 0").select("request_id")
    return ingest.new_requests(twice(spark, sf_dir), ledger).select("request_id", "user_id", F.size("messages").cast("long").alias("n"))


def valid_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = requests(spark, sf_dir).withColumn("user_id", F.when(F.col("arrival") % 3 == 0, F.lit(" \t")).otherwise(F.col("user_id")))
    bad = bad.withColumn("messages", F.when(F.col("arrival") % 7 == 0, F.slice("messages", 1, 0)).otherwise(F.col("messages")))
    return ingest.checked(bad).select("request_id", "fault")


def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir)[1].select("id", "user_id", _sha("context"))


def fact_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir)[2].select("fact_id", "user_id", "source_message_id", "fact_text")


def tokenize_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = text.index_tokens(F.col("content"))
    return store(spark, sf_dir)[0].select("id", F.size(tokens).cast("long").alias("n"), F.array_join(tokens, " ").alias("tokens"))


def _analysed(spark: SparkSession, *columns: str) -> DataFrame:
    return analyse.analysed(asked(spark)).select("query_id", *[F.array_join(c, " ").alias(c) for c in columns])


def tokenize_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysed(spark, "raw")


def stopword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.filter("raw", lambda t: ~text.casefold(t).isin(*text.STOP_WORDS))
    return analyse.analysed(asked(spark)).select("query_id", F.array_join(kept, " ").alias("kept"))


def stopword_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyse.analysed(asked(spark)).select("query_id", F.array_join(analyse.content_terms(F.col("raw")), " ").alias("kept"))


def term_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysed(spark, "terms")


def entity_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysed(spark, "entities")


def structured_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysed(spark, "entities", "others").where("entities <> '' and others <> ''")


def temporal_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyse.analysed(asked(spark)).select("query_id", F.col("direction").cast("int").alias("direction"))


def pool_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1, 101).select(F.col("id").alias("top_k"), text.pool_size(F.col("id")).cast("long").alias("pool"))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir)[3].postings.select("idx", "token", "doc", "user_id", F.col("pos").cast("long").alias("pos"), F.col("len").cast("long").alias("len"))


def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir)[3].token_stats.select("idx", "token", "n")


def channel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir)[3].stats.select("idx", "n_docs", F.round("avg_len", 6).alias("avg_len"))


def stem_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = store(spark, sf_dir)[3].token_stats.where("idx not like '%porter'").select(F.col("token").alias("word")).distinct()
    return with_stem(words, "word").select("word", "stem")


def _channel(idx: str, family: str = "any") -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        index, q = store(spark, sf_dir)[3], analyse.analysed(asked(spark))
        best = rank.ranked(rank.bm25(analyse.phrases(q), index, [(family, idx)]), q)
        return best.select("query_id", F.col("rank").cast("long").alias("rank"), "doc", "message", F.round("score", 6).alias("score"))

    return run


def phrase_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned phrases of several words, over all users."""
    index = store(spark, sf_dir)[3]
    q = asked(spark).where("query_id <= 2").withColumn("planned", F.array(F.lit("la que"), F.lit("in the"), F.lit("of the of")))
    tokens = rank.query_tokens(analyse.phrases(analyse.analysed(q)), [("any", "raw")])
    found = rank.occurrences(tokens.where("width > 1").drop("user_id"), index.postings, ["query_id", "no"], ["corpus", "idx", "token"])
    return found.select("query_id", F.col("no").cast("long").alias("no"), "doc", "tf")


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, q = store(spark, sf_dir)[3], analyse.analysed(asked(spark))
    ranks = rank.ranked(rank.bm25(analyse.phrases(q), index, rank.all_channels()), q)
    return rank.fused(ranks).select("query_id", "message", F.round("rrf", 6).alias("rrf"))


def temporal_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages, _, _, index = store(spark, sf_dir)
    return plan.candidates(asked(spark), index, messages, BONUS).select("query_id", "message", F.round("score", 6).alias("score"))


def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The removal of repeated contents, over all documents as one query's candidates by language."""
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("query_id"), F.col("doc_id").alias("message"), F.col("text").alias("content"), F.lit(0.0).alias("score"), (F.col("doc_id") % 10).alias("event_ts"))
    best = Window.partitionBy("query_id", text.casefold(F.col("content"))).orderBy(*rank.final_order())
    return docs.withColumn("r", F.row_number().over(best)).where("r = 1").select("query_id", "message")


def final_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages, _, _, index = store(spark, sf_dir)
    kept = rank.distinct_contents(plan.candidates(asked(spark), index, messages, BONUS))
    return kept.select("query_id", F.col("place").cast("long").alias("place"), "message")


def search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: all channels, fusion, time, removal of repeats, order and limit."""
    messages, _, _, index = store(spark, sf_dir)
    return plan.search(asked(spark), index, messages, BONUS).select("query_id", "place", "id", "score", _sha("content"), "created_at")


def every_user(spark: SparkSession) -> DataFrame:
    users = spark.range(20).select(F.concat(F.lit("user:"), F.col("id").cast("string")).alias("user_id"), F.col("id"))
    q = asked(spark).where("query_id <= 6").select(F.col("query_id").alias("no"), "query", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("u"))
    return q.join(users, q["u"] == users["id"]).select((F.col("no") * 100 + F.col("u")).cast("int").alias("query_id"), "query", "user_id", F.lit(10).alias("top_k"))


def search_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six queries by each of 20 users at once."""
    messages, _, _, index = store(spark, sf_dir)
    return plan.search(every_user(spark), index, messages).select("query_id", "place", "id", "score")


def user_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages, _, _, index = store(spark, sf_dir)
    got = plan.search(every_user(spark), index, messages)
    got = got.join(messages.select(F.concat(F.lit("mem_"), F.col("id").cast("string")).alias("id"), "user_id"), "id")
    return got.groupBy("query_id").agg(F.count(F.lit(1)).alias("results"), F.countDistinct("user_id").alias("users"), F.min("user_id").alias("user_id"))


def _options(spark: SparkSession) -> DataFrame:
    return asked(spark).withColumn("options", F.array(F.lit(" la que "), F.lit("THER"), F.lit("")))


def model_plan_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mnemora.operators.model import MOST_TERMS, strings

    q = _options(spark).withColumn("planned", strings(RuleModel().plan_query(F.col("query"), F.col("options")), MOST_TERMS))
    return analyse.analysed(q).select("query_id", F.array_join("terms", "|").alias("terms"))


def model_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages, _, _, index = store(spark, sf_dir)
    return plan.search(_options(spark), index, messages, 0.0, RuleModel()).select("query_id", "place", "id", "score")


def baseline_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages, _, _, index = store(spark, sf_dir)
    return plan.baseline(asked(spark), index, messages).select("query_id", "place", "id", "score")


DEPTHS = [1, 3, 10]


def eval_cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Queries of the second message's second to fourth tokens; its start and the first message's are the evidence.

    Every conversation is a case whose second message has two tokens at least.
    """
    messages = store(spark, sf_dir)[0]
    number = F.regexp_extract("request_id", r"(\d+)$", 1).cast("int")
    mine = messages.where(F.col("sequence") <= 1).withColumn("query_id", number)
    tokens = text.index_tokens(F.col("content"))
    q = mine.where("sequence = 1").select("query_id", F.array_join(F.slice(tokens, 2, 3), " ").alias("query"), "user_id", F.lit(10).alias("top_k")).where("query <> ''")
    evidence = mine.select("query_id", (1 - F.col("sequence")).alias("at"), F.upper(F.substring("content", 1, 12)).alias("text"), (F.col("query_id") % 4).alias("category"))
    return q, evidence.join(q.select("query_id"), "query_id", "left_semi")


@lru_cache(maxsize=16)
def _ranks(app: str, sf_dir: str, earlier: bool) -> DataFrame:
    spark = SparkSession.getActiveSession()
    messages, _, _, index = store(spark, sf_dir)
    q, evidence = eval_cases(spark, sf_dir)
    got = plan.baseline(q, index, messages) if earlier else plan.search(q, index, messages)
    return written(evaluate.evidence_ranks(got, evidence), "ranks")


forgetting += [_store.cache_clear, _ranks.cache_clear]


def _summary(spark: SparkSession, sf_dir: str, earlier: bool = False) -> DataFrame:
    ranks = _ranks(spark.sparkContext.applicationId, sf_dir, earlier)
    return evaluate.summary(evaluate.by_case(ranks, DEPTHS), DEPTHS)


def _metrics(*columns: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _summary(spark, sf_dir).select("cases", "evidence_items", *columns)


def category_hit_at_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = _ranks(spark.sparkContext.applicationId, sf_dir, False)
    kinds = ranks.select("query_id", F.when(F.col("category") < 3, F.col("category")).alias("category")).distinct()
    return evaluate.by_category(evaluate.by_case(ranks, DEPTHS).join(kinds, "query_id"))


def compare_retrievers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.compared(_summary(spark, sf_dir), _summary(spark, sf_dir, True), ["recall_1", "hit_1", "mrr"])


DIALOGUES = [
    ("s1", '{"session_10":[{"speaker":"Milo","dia_id":"D10:1","text":"Jasmine tea."}],"session_2":[{"speaker":"Ana","dia_id":"D2:1","text":"Which tea?"},{"speaker":"Ana","text":"no id"}],"session_2_date_time":"May"}', ['{"question":"What tea?","evidence":["D10:1","D9:9"],"category":2}', '{"question":"","evidence":["D2:1"]}', '"odd"', '{"question":"Who?","evidence":["D2:1"]}']),
    ("s2", '{"session_1":[{"speaker":"Bela","dia_id":"D1:1","text":"Hike."}]}', ['{"question":"Where?","evidence":["D7:7"],"category":"x"}']),
]


def locomo_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(DIALOGUES, sources.DIALOGUE)
    order = Window.partitionBy("sample_id").orderBy("session", "key", "at")
    return sources.turns(sources.numbered(rows)).select("sample_id", F.row_number().over(order).cast("long").alias("n"), F.col("session").cast("long").alias("session"), "dia_id", "content")


def locomo_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.questions(sources.numbered(spark.createDataFrame(DIALOGUES, sources.DIALOGUE))).select("query_id", "query", "category", "text")


def evidence_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence that must be a whole result: each message's content, in the other case, as the first or second of two results."""
    messages = store(spark, sf_dir)[0].select(F.col("id").alias("query_id"), "content")
    both = F.array(F.struct((1 + F.col("query_id") % 2).alias("place"), F.upper("content").alias("content")), F.struct((2 - F.col("query_id") % 2).alias("place"), F.concat("content", F.lit(" and more")).alias("content")))
    results = messages.select("query_id", F.explode(both).alias("r")).select("query_id", "r.place", "r.content")
    return evaluate.evidence_ranks(results, messages.select("query_id", F.lit(0).alias("at"), F.col("content").alias("text")), exact=True).select("query_id", "at", "rank")


def _json_file(rows: DataFrame, name: str) -> str:
    """The rows as JSON array files in the shared folder: some thousand rows in each array, and one array in each file."""
    import uuid

    from mnemora.sources.tables import shared_dir

    at = f"{shared_dir(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    dealt = rows.select(F.to_json(F.struct(*rows.columns)).alias("j"), F.pmod(F.xxhash64(rows.columns[0]), F.lit(max(1, rows.count() // 1000))).alias("part"))
    arrays = dealt.groupBy("part").agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("j")), ","), F.lit("]")).alias("value")).select("value")
    arrays.write.option("maxRecordsPerFile", 1).option("lineSep", " ").text(at)
    return at


def dialogue_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations written as dialogue files of three sessions each, and read again by the source."""
    turn = F.struct("turn", F.struct(F.col("role").alias("speaker"), F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("dia_id"), "text").alias("t"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id", (F.col("turn") % 3).alias("session")).agg(F.transform(F.array_sort(F.collect_list(turn)), lambda x: x["t"]).alias("turns"))
    rows = rows.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("session_"), F.col("session").cast("string")), "turns"))).alias("conversation"))
    at = _json_file(rows.select(F.concat(F.lit("d"), F.col("conv_id").cast("string")).alias("sample_id"), "conversation"), "dialogues")
    found = sources.turns(sources.dialogues(spark, at)).where("role <> '' and content <> concat(role, ': ')")
    return found.select("sample_id", F.col("session").cast("long").alias("session"), F.split_part("dia_id", F.lit(":"), F.lit(2)).cast("long").alias("turn"), "dia_id", _sha("content"))


def case_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case of each conversation, written as files of cases and read again by the source."""
    rows = requests(spark, sf_dir).select(F.concat(F.lit("c"), F.col("arrival").cast("string")).alias("case_id"), "user_id", "session_id", "messages", F.lit("tea").alias("query"), F.array(F.lit("a"), F.lit("b")).alias("expected_evidence"))
    found = sources.cases(spark, _json_file(rows, "cases"))
    evidence = sources.evidence_of(found).groupBy("query_id").agg(F.count(F.lit(1)).alias("evidence"))
    made = sources.requests_of(found).join(found.select(F.concat(F.lit("offline:"), "case_id").alias("request_id"), "case_id"), "request_id")
    return made.join(evidence, made["case_id"] == evidence["query_id"]).select("case_id", "request_id", "user_id", F.size("messages").cast("long").alias("messages"), "evidence")


def question_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most one question of all samples, counted after those without text or evidence went."""
    return sources.questions(sources.numbered(spark.createDataFrame(DIALOGUES, sources.DIALOGUE)), 1).select("query_id").distinct()


def search_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each of some requests to search, and their number of results."""
    k = F.col("id")
    rows = spark.range(1, 131).select(k.alias("query_id"), F.when(k % 5 == 0, F.lit(" \t")).otherwise(F.lit("tea")).alias("query"), F.when(k % 7 == 0, F.lit("")).otherwise(F.lit("u")).alias("user_id"), F.when(k % 11 == 0, F.lit(None)).when(k % 3 == 0, F.lit(0)).otherwise(k).cast("int").alias("top_k"))
    return plan.checked_queries(rows).select("query_id", "fault", F.col("top_k").cast("long").alias("top_k"))


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same requests as a stream of files, each id counted once; what is stored is returned."""
    import uuid

    from mnemora.plans.store import Store
    from mnemora.sources.tables import shared_dir
    from mnemora.streaming.ingest import ingest_stream, request_stream

    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    twice(spark, sf_dir).repartition(8, "request_id").write.json(f"{at}/in")
    kept = Store(spark, f"{at}/store")
    ingest_stream(request_stream(spark, f"{at}/in"), kept, f"{at}/checkpoint", NOW).awaitTermination()
    return kept.read("messages").groupBy("request_id", "user_id").agg(F.count(F.lit(1)).alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        search_topk, ingest_flatten, ingest_idempotent, valid_requests, context_window, fact_ingest, tokenize_index, tokenize_query, stopword_filter, stopword_fallback, term_dedup, entity_terms, structured_query,
        temporal_direction, pool_size, postings, term_stats, channel_stats, stem_dictionary, phrase_match, rrf_fusion, temporal_bonus, content_dedup, final_rank, search_batch, user_isolation, model_plan_terms, model_rerank,
        baseline_topk, category_hit_at_1, compare_retrievers, locomo_flatten, locomo_questions, stream_ingest,
    )
} | {
    "bm25_raw": _channel("raw"), "bm25_context": _channel("context"), "bm25_fact": _channel("fact"), "bm25_raw_porter": _channel("raw_porter"), "bm25_context_porter": _channel("context_porter"), "bm25_fact_porter": _channel("fact_porter"), "bm25_entity_raw": _channel("raw", "both"),
    "bm25_entity_porter": _channel("raw_porter", "both"), "bm25_entity_context": _channel("context_porter", "both"), "evidence_exact": evidence_exact, "dialogue_files": dialogue_files, "case_files": case_files, "question_cap": question_cap, "search_requests": search_requests,
    "recall_at_k": _metrics("recall_1", "recall_3", "recall_10"), "coverage_at_k": _metrics("coverage_1", "coverage_3", "coverage_10"), "hit_at_k": _metrics("hit_1", "hit_3", "hit_10"), "mrr_listed_first": _metrics("mrr"), "mrr_standard": _metrics("mrr_best"),
}


# ---- the same in SQL ----


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_TOKENS = f"regexp_extract_all(regexp_replace(translate(lower({{0}}), {_q(text.MARKED)}, {_q(text.PLAIN)}), '\\p{{{{Mn}}}}', '', 'g'), '{text.TOKEN.replace('{', '{{').replace('}', '}}')}')"
_FOLD = "replace(lower({0}), 'ß', 'ss')"
_STOP = ", ".join(map(_q, text.STOP_WORDS))
_USERS = "SELECT CAST(no * 100 + u AS INTEGER) AS query_id, query, 'user:' || u AS user_id, 10 AS top_k, []::VARCHAR[] AS planned FROM asked JOIN (SELECT query_id AS no FROM asked WHERE query_id <= 6) ON no = query_id, range(20) t(u)"
_EVAL = "SELECT CAST(substr(request_id, 6) AS INTEGER) AS query_id, array_to_string(toks[2:4], ' ') AS query, user_id, 10 AS top_k, []::VARCHAR[] AS planned FROM (SELECT *, {t} AS toks FROM messages WHERE sequence = 1) WHERE array_to_string(toks[2:4], ' ') <> ''".format(t=_TOKENS.format("content"))
_PLANNED = "SELECT *, ['la que', 'THER'] AS planned FROM asked"


def _sql(select: str, queries: str = "SELECT *, []::VARCHAR[] AS planned FROM asked", bonus: float = 0.0, all_words: bool = False) -> str:
    """`select` over everything that a search makes; unused parts cost nothing.

    With all_words, stop words and repeated terms stay.
    """
    stop, once = ("false", "true") if all_words else (f"{_FOLD.format('t')} IN ({_STOP})", f"list_position(list_transform(all_terms, lambda x: {_FOLD.format('x')}), {_FOLD.format('t')}) = i")
    rows = ", ".join(f"({i}, {_q(q)}, 'user:{u}', {k})" for i, q, u, k in ASKED)
    w = "CASE idx WHEN 'context' THEN 0.5 WHEN 'context_porter' THEN 0.5 ELSE 1.0 END"
    return f"""
WITH asked(query_id, query, user_id, top_k) AS (VALUES {rows}),
m0 AS (SELECT conv_id, turn, role, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS content, row_number() OVER (ORDER BY conv_id, turn) AS id FROM conversations),
messages AS (SELECT id, 'conv:' || conv_id AS request_id, 'user:' || (conv_id % 20) AS user_id, role, content, CASE WHEN id % 7 <> 0 THEN conv_id * 1000 + turn END AS event_ts, turn AS sequence, '{NOW}' AS created_at FROM m0),
contexts AS (SELECT id, user_id, concat_ws(chr(10), lag(content) OVER b, content, lead(content) OVER b) AS context FROM messages WINDOW b AS (PARTITION BY request_id ORDER BY sequence)),
facts AS (SELECT id * {ingest.MOST_FACTS} + row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS fact_id, user_id, id AS source_message_id, f[i] AS fact_text FROM (
  SELECT id, user_id, f, unnest(generate_series(1, len(f))) AS i FROM (
    SELECT id, user_id, list_filter(list_transform(string_split(content, '.'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: length(s) >= 20) AS f FROM messages) WHERE len(f) > 0) WHERE list_position(f, f[i]) = i),
texts AS (SELECT 'raw' AS idx, id AS doc, id AS message, user_id, content FROM messages UNION ALL SELECT 'context', id, id, user_id, context FROM contexts UNION ALL SELECT 'fact', fact_id, source_message_id, user_id, fact_text FROM facts),
cut AS (SELECT idx, doc, message, user_id, {_TOKENS.format("content")} AS toks FROM texts),
plain AS (SELECT idx, doc, message, user_id, len(toks) AS len, unnest(toks) AS token, generate_subscripts(toks, 1) - 1 AS pos FROM cut),
stems AS ({stem_sql("plain", "token")}),
post AS (SELECT idx, token, doc, message, user_id, pos, len FROM plain UNION ALL SELECT idx || '_porter', stem, doc, message, user_id, pos, len FROM plain JOIN stems ON token = word),
tstats AS (SELECT idx, token, count(DISTINCT doc) AS n FROM post GROUP BY ALL),
s0 AS (SELECT idx, count(*) AS n_docs, avg(len(toks)) AS avg_len FROM cut GROUP BY idx),
stats AS (SELECT * FROM s0 UNION ALL SELECT idx || '_porter', n_docs, avg_len FROM s0),
q0 AS ({queries}),
q1 AS (SELECT *, regexp_extract_all(query, '{text.TERM}') AS raw FROM q0),
q2 AS (SELECT *, list_filter(raw, lambda t: NOT ({stop})) AS kept, CASE WHEN regexp_matches(query, '(?i){text.CURRENT_CUES}') THEN 1 WHEN regexp_matches(query, '(?i){text.FORMER_CUES}') THEN -1 ELSE 0 END AS direction FROM q1),
q3 AS (SELECT *, list_concat(CASE WHEN len(kept) > 0 THEN kept ELSE raw END, planned) AS all_terms, list_filter(raw, lambda t, i: i > 1 AND length(t) > 1 AND regexp_matches(t, '^\\p{{Lu}}'))[1:2] AS entities FROM q2),
q AS (SELECT *, list_filter(all_terms, lambda t, i: {_FOLD.format("t")} <> '' AND {once}) AS terms, least(greatest(top_k * 4, 50), 200) AS pool FROM q3),
qq AS (SELECT *, list_filter(terms, lambda t: NOT list_contains(list_transform(entities, lambda x: {_FOLD.format("x")}), {_FOLD.format("t")})) AS others FROM q),
p0 AS (SELECT query_id, user_id, 'any' AS family, 'term' AS kind, unnest(terms) AS term, generate_subscripts(terms, 1) AS no FROM qq
  UNION ALL SELECT query_id, user_id, 'both', 'entity', unnest(entities), generate_subscripts(entities, 1) FROM qq WHERE len(entities) > 0 AND len(others) > 0
  UNION ALL SELECT query_id, user_id, 'both', 'content', unnest(others), generate_subscripts(others, 1) FROM qq WHERE len(entities) > 0 AND len(others) > 0),
p1 AS (SELECT query_id, user_id, family, kind, no, {_TOKENS.format("replace(term, '\"', '')")} AS toks FROM p0),
ch(family, idx) AS (VALUES {", ".join(f"('{f}', '{i}')" for f, i in rank.WEIGHTS)}),
p2 AS (SELECT query_id, user_id, family, kind, no, len(toks) AS width, unnest(toks) AS tok, generate_subscripts(toks, 1) - 1 AS off FROM p1),
qstems AS ({stem_sql("p2", "tok")}),
p3 AS (SELECT p2.*, ch.idx, CASE WHEN ch.idx LIKE '%porter' THEN stem ELSE tok END AS token FROM p2 JOIN ch USING (family) JOIN qstems ON tok = word),
occ AS (SELECT query_id, p3.user_id AS asker, post.user_id, family, kind, no, idx, doc, message, len, count(*) AS tf FROM (
  SELECT p3.query_id, p3.user_id, family, kind, no, idx, doc, message, len, post.user_id AS u2, pos - off AS start FROM p3 JOIN post USING (idx, token) GROUP BY ALL HAVING count(DISTINCT off) = max(width)) p3 JOIN (SELECT DISTINCT message AS m2, user_id FROM post) post ON post.m2 = p3.message GROUP BY ALL),
dfs AS (SELECT query_id, family, kind, no, idx, count(DISTINCT doc) AS n FROM occ GROUP BY ALL),
idf AS (SELECT *, CASE WHEN ln((n_docs - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - n + 0.5) / (n + 0.5)) END AS idf FROM dfs JOIN stats USING (idx)),
bm AS (SELECT query_id, family, idx, doc, message, sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))) AS score, bool_or(kind = 'entity') AS e, bool_or(kind = 'content') AS c
  FROM occ JOIN idf USING (query_id, family, kind, no, idx) WHERE asker = user_id GROUP BY query_id, family, idx, doc, message),
rk AS (SELECT * FROM (SELECT bm.*, pool, row_number() OVER (PARTITION BY query_id, family, idx ORDER BY round(score, 12) DESC, message DESC, doc DESC) AS rank FROM bm JOIN q USING (query_id) WHERE family = 'any' OR (e AND c)) WHERE rank <= pool),
fu AS (SELECT query_id, message, sum(CASE family WHEN 'any' THEN {w} ELSE 0.0 END::DOUBLE / (60 + rank)) AS rrf FROM rk GROUP BY ALL),
ca0 AS (SELECT fu.*, m.content, m.created_at, m.event_ts, direction, top_k, min(event_ts) OVER (PARTITION BY query_id) AS lo, max(event_ts) OVER (PARTITION BY query_id) AS hi FROM fu JOIN messages m ON m.id = message JOIN q USING (query_id)),
ca AS (SELECT *, rrf + coalesce(CASE WHEN hi > lo THEN {bonus}::DOUBLE * CASE direction WHEN 1 THEN (event_ts - lo)::DOUBLE / (hi - lo) WHEN -1 THEN 1 - (event_ts - lo)::DOUBLE / (hi - lo) END END, 0) AS score FROM ca0),
de AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, coalesce(event_ts, 0) DESC, 'mem_' || message) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, {_FOLD.format("content")} ORDER BY round(score, 12) DESC, coalesce(event_ts, 0) DESC, 'mem_' || message) AS r FROM ca) WHERE r = 1),
se AS (SELECT query_id, place, 'mem_' || message AS id, content, round_even(score, 6) AS score, created_at FROM de WHERE place <= top_k),
ba AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, message DESC) AS place, message, score FROM (
  SELECT query_id, message, sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))) AS score FROM (
    SELECT o.*, t.n_docs, t.avg_len, CASE WHEN ln((n_docs - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - n + 0.5) / (n + 0.5)) END AS idf FROM (
      SELECT query_id, t.no, p.doc, p.message, p.len, count(*) AS tf, any_value(x.n) AS n FROM (
        SELECT query_id, user_id, i AS no, x[i] AS token FROM (SELECT query_id, user_id, x, unnest(generate_series(1, len(x))) AS i FROM (SELECT query_id, user_id, {_TOKENS.format("array_to_string(raw, ' ')")} AS x FROM q1))) t
      JOIN post p ON p.idx = 'raw' AND p.token = t.token AND p.user_id = t.user_id JOIN tstats x ON x.idx = 'raw' AND x.token = t.token GROUP BY ALL) o, (SELECT * FROM s0 WHERE idx = 'raw') t) GROUP BY ALL)),
bk AS (SELECT query_id, place, 'mem_' || message AS id, content, round_even(score, 6) AS score FROM ba JOIN messages ON id = message JOIN q USING (query_id) WHERE place <= top_k),
ev AS (SELECT CAST(substr(request_id, 6) AS INTEGER) AS query_id, 1 - sequence AS at_, upper(content[1:12]) AS txt FROM messages WHERE sequence <= 1 AND CAST(substr(request_id, 6) AS INTEGER) IN (SELECT query_id FROM q0)),
er AS (SELECT ev.query_id, at_, min(place) AS rank FROM ev LEFT JOIN se ON se.query_id = ev.query_id AND contains({_FOLD.format("content")}, {_FOLD.format("txt")}) GROUP BY ALL),
cs AS (SELECT query_id, count(*) AS items, arg_min(rank, at_) FILTER (rank IS NOT NULL) AS listed, min(rank) AS best, count(*) FILTER (rank <= 1) AS h1, count(*) FILTER (rank <= 3) AS h3, count(*) FILTER (rank <= 10) AS h10 FROM er GROUP BY query_id),
fr AS (SELECT ev.query_id, at_, min(place) AS rank FROM ev LEFT JOIN bk ON bk.query_id = ev.query_id AND contains({_FOLD.format("content")}, {_FOLD.format("txt")}) GROUP BY ALL),
fs AS (SELECT query_id, count(*) AS items, arg_min(rank, at_) FILTER (rank IS NOT NULL) AS listed, count(*) FILTER (rank <= 1) AS h1 FROM fr GROUP BY query_id)
{select}
"""


def _eval(select: str) -> str:
    return _sql(select, _EVAL)


_JOINED = "SELECT query_id, array_to_string({0}, ' ') AS {1} FROM qq"
_BM = "SELECT query_id, rank, doc, message, round(score, 6) AS score FROM rk WHERE family = '{1}' AND idx = '{0}'"
_N = "SELECT count(*) AS cases, CAST(sum(items) AS BIGINT) AS evidence_items, "
ORACLE_SQL: dict[str, str] = {
    "search_topk": _sql("SELECT query_id, place, id, score, sha256(content) AS content_sha256, created_at FROM se", bonus=BONUS),
    "ingest_flatten": _sql("SELECT id, request_id, user_id, role, sha256(content) AS content_sha256, event_ts, CAST(sequence AS BIGINT) AS sequence, created_at FROM messages"),
    "ingest_idempotent": "SELECT 'conv:' || conv_id AS request_id, 'user:' || (conv_id % 20) AS user_id, count(*) AS n FROM conversations WHERE conv_id % 5 <> 0 GROUP BY conv_id",
    "valid_requests": "SELECT 'conv:' || conv_id AS request_id, CASE WHEN conv_id % 7 = 0 THEN 'messages' WHEN conv_id % 3 = 0 THEN 'user_id' WHEN bool_or(trim(text) = '') THEN 'message' END AS fault FROM conversations GROUP BY conv_id",
    "context_window": _sql("SELECT id, user_id, sha256(context) AS context_sha256 FROM contexts"),
    "fact_ingest": _sql("SELECT fact_id, user_id, source_message_id, fact_text FROM facts"),
    "tokenize_index": _sql("SELECT doc AS id, len(toks) AS n, array_to_string(toks, ' ') AS tokens FROM cut WHERE idx = 'raw'"),
    "tokenize_query": _sql(_JOINED.format("raw", "raw")),
    "stopword_filter": _sql(_JOINED.format("kept", "kept")),
    "stopword_fallback": _sql("SELECT query_id, array_to_string(all_terms, ' ') AS kept FROM qq"),
    "term_dedup": _sql(_JOINED.format("terms", "terms")),
    "entity_terms": _sql(_JOINED.format("entities", "entities")),
    "structured_query": _sql("SELECT query_id, array_to_string(entities, ' ') AS entities, array_to_string(others, ' ') AS others FROM qq WHERE len(entities) > 0 AND len(others) > 0"),
    "temporal_direction": _sql("SELECT query_id, direction FROM qq"),
    "pool_size": "SELECT k AS top_k, least(greatest(k * 4, 50), 200) AS pool FROM range(1, 101) t(k)",
    "postings": _sql("SELECT idx, token, doc, user_id, pos, len FROM post"),
    "term_stats": _sql("SELECT idx, token, n FROM tstats"),
    "channel_stats": _sql("SELECT idx, n_docs, round(avg_len, 6) AS avg_len FROM stats"),
    "stem_dictionary": _sql("SELECT word, stem FROM stems"),
    "phrase_match": _sql("SELECT query_id, no - 1 AS no, doc, tf FROM occ JOIN (SELECT DISTINCT query_id AS q5, no AS n5, family AS f5 FROM p2 WHERE width > 1) ON q5 = query_id AND n5 = no AND f5 = family WHERE idx = 'raw' AND family = 'any'", "SELECT *, ['la que', 'in the', 'of the of'] AS planned FROM asked WHERE query_id <= 2"),
    "rrf_fusion": _sql("SELECT query_id, message, round(rrf, 6) AS rrf FROM fu"),
    "temporal_bonus": _sql("SELECT query_id, message, round(score, 6) AS score FROM ca", bonus=BONUS),
    "content_dedup": f"SELECT lang AS query_id, doc_id AS message FROM (SELECT *, row_number() OVER (PARTITION BY lang, {_FOLD.format('text')} ORDER BY doc_id % 10 DESC, 'mem_' || doc_id) AS r FROM documents) WHERE r = 1",
    "final_rank": _sql("SELECT query_id, place, message FROM de", bonus=BONUS),
    "search_batch": _sql("SELECT query_id, place, id, score FROM se", _USERS),
    "user_isolation": _sql("SELECT query_id, count(*) AS results, count(DISTINCT m.user_id) AS users, min(m.user_id) AS user_id FROM se JOIN messages m ON se.id = 'mem_' || m.id GROUP BY query_id", _USERS),
    "model_plan_terms": _sql("SELECT query_id, array_to_string(terms, '|') AS terms FROM qq", _PLANNED),
    "model_rerank": _sql("SELECT query_id, p AS place, 'mem_' || message AS id, round_even(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY length(content) DESC, 'mem_' || message) AS p FROM de) WHERE p <= top_k", _PLANNED),
    "baseline_topk": _sql("SELECT query_id, rank AS place, 'mem_' || message AS id, round_even(score, 6) AS score FROM rk WHERE family = 'any' AND idx = 'raw' AND rank <= (SELECT top_k FROM asked WHERE asked.query_id = rk.query_id)", all_words=True),
    "category_hit_at_1": _eval("SELECT CASE WHEN query_id % 4 < 3 THEN CAST(query_id % 4 AS VARCHAR) ELSE 'unknown' END AS category, count(*) AS questions, round_even(count(*) FILTER (listed = 1) / count(*), 4) AS hit_at_1 FROM cs GROUP BY 1"),
    "compare_retrievers": _eval(
        "SELECT *, round_even(current_recall_1 - earlier_recall_1, 4) AS delta_recall_1, round_even(current_hit_1 - earlier_hit_1, 4) AS delta_hit_1, round_even(current_mrr - earlier_mrr, 4) AS delta_mrr FROM (SELECT round_even(sum(h1) / sum(items), 4) AS current_recall_1, round_even(count(*) FILTER (h1 > 0) / count(*), 4) AS current_hit_1, round_even(sum(coalesce(1 / listed, 0)) / count(*), 4) AS current_mrr FROM cs), (SELECT round_even(sum(h1) / sum(items), 4) AS earlier_recall_1, round_even(count(*) FILTER (h1 > 0) / count(*), 4) AS earlier_hit_1, round_even(sum(coalesce(1 / listed, 0)) / count(*), 4) AS earlier_mrr FROM fs)"
    ),
    "locomo_flatten": "SELECT sample_id, CAST(n AS BIGINT) AS n, CAST(session AS BIGINT) AS session, dia_id, content FROM (VALUES ('s1', 1, 2, 'D2:1', 'Ana: Which tea?'), ('s1', 2, 10, 'D10:1', 'Milo: Jasmine tea.'), ('s2', 1, 1, 'D1:1', 'Bela: Hike.')) t(sample_id, n, session, dia_id, content)",
    "locomo_questions": "SELECT * FROM (VALUES ('s1:0', 'What tea?', '2', 'Milo: Jasmine tea.'), ('s1:3', 'Who?', 'unknown', 'Ana: Which tea?')) t(query_id, query, category, text)",
    "stream_ingest": "SELECT 'conv:' || conv_id AS request_id, 'user:' || (conv_id % 20) AS user_id, count(*) AS n FROM conversations GROUP BY conv_id",
    "bm25_raw": _sql(_BM.format("raw", "any")), "bm25_context": _sql(_BM.format("context", "any")), "bm25_fact": _sql(_BM.format("fact", "any")), "bm25_raw_porter": _sql(_BM.format("raw_porter", "any")), "bm25_context_porter": _sql(_BM.format("context_porter", "any")), "bm25_fact_porter": _sql(_BM.format("fact_porter", "any")), "bm25_entity_raw": _sql(_BM.format("raw", "both")),
    "bm25_entity_porter": _sql(_BM.format("raw_porter", "both")), "bm25_entity_context": _sql(_BM.format("context_porter", "both")),
    "evidence_exact": _sql("SELECT id AS query_id, 0 AS at, 1 + (id % 2) AS rank FROM messages"),
    "dialogue_files": "SELECT 'd' || conv_id AS sample_id, turn % 3 AS session, turn, conv_id || ':' || turn AS dia_id, sha256(role || ': ' || text) AS content_sha256 FROM conversations WHERE role <> '' AND text <> ''",
    "case_files": "SELECT 'c' || conv_id AS case_id, 'offline:c' || conv_id AS request_id, 'user:' || (conv_id % 20) AS user_id, count(*) AS messages, 2 AS evidence FROM conversations GROUP BY conv_id",
    "question_cap": "SELECT query_id FROM (VALUES ('s1:0')) t(query_id)",
    "search_requests": "SELECT k AS query_id, CASE WHEN k % 5 = 0 THEN 'query' WHEN k % 7 = 0 THEN 'user_id' WHEN k % 11 = 0 THEN NULL WHEN k % 3 = 0 OR k > 100 THEN 'top_k' END AS fault, CASE WHEN k % 11 = 0 THEN 100 WHEN k % 3 = 0 THEN 0 ELSE k END AS top_k FROM range(1, 131) t(k)",
    "recall_at_k": _eval(_N + ", ".join(f"round_even(sum(h{k}) / sum(items), 4) AS recall_{k}" for k in DEPTHS) + " FROM cs"),
    "coverage_at_k": _eval(_N + ", ".join(f"round_even(count(*) FILTER (h{k} = items) / count(*), 4) AS coverage_{k}" for k in DEPTHS) + " FROM cs"),
    "hit_at_k": _eval(_N + ", ".join(f"round_even(count(*) FILTER (h{k} > 0) / count(*), 4) AS hit_{k}" for k in DEPTHS) + " FROM cs"),
    "mrr_listed_first": _eval(_N + "round_even(sum(coalesce(1 / listed, 0)) / count(*), 4) AS mrr FROM cs"),
    "mrr_standard": _eval(_N + "round_even(sum(coalesce(1 / best, 0)) / count(*), 4) AS mrr_best FROM cs"),
}
