"""Sources of evaluation cases and conversations in JSON, and a sink for reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.operators.ingest import MESSAGE

CASE = f"case_id string, user_id string, session_id string, messages array<{MESSAGE}>, query string, expected_evidence array<string>"
REQUIRED = ("case_id", "user_id", "session_id", "messages", "query", "expected_evidence")


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of JSON array files; a file that holds no array, a broken one or more behind it is an error.

    Spark's reader takes a file's first value and is silent on the rest, so each file is parsed inside an
    object, whose last member is there only if the file is one value. It passes over files of no bytes.
    """
    whole = spark.read.text(path, wholetext=True)
    one = F.from_json(F.concat(F.lit('{"array":'), "value", F.lit(',"end":1}')), "array string, end int")["end"]
    if whole.where(~F.col("value").rlike(r"^\s*\[") | one.isNull()).limit(1).count():
        raise ValueError(f"{path} must hold a JSON array in each file")
    return spark.read.json(path, schema=schema, multiLine=True)


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases; missing fields or an empty list of evidence are an error that names the case."""
    rows = read_array(spark, path, CASE)
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED]))
    bad = rows.where((F.size(missing) > 0) | (F.size("expected_evidence") < 1)).select("case_id", F.array_join(missing, ", ").alias("missing")).first()
    if bad:
        raise ValueError(f"Case {bad.case_id} lacks {bad.missing or 'expected_evidence'}")
    return rows


def requests_of(rows: DataFrame) -> DataFrame:
    """A request for each case."""
    return rows.select(F.concat(F.lit("offline:"), "case_id").alias("request_id"), "user_id", "session_id", "messages", F.monotonically_increasing_id().alias("arrival"))


def evidence_of(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("case_id").alias("query_id"), F.posexplode("expected_evidence").alias("at", "text"))


#: Conversations by sessions under keys that aren't known before.
DIALOGUE = "sample_id string, conversation string, qa array<string>"
TURN = "struct<speaker:string,dia_id:string,text:string>"
QUESTION = "struct<question:string,evidence:array<string>,category:string>"


def dialogues(spark: SparkSession, path: str) -> DataFrame:
    return numbered(read_array(spark, path, DIALOGUE))


def numbered(rows: DataFrame) -> DataFrame:
    """With sample_no (the rows' order) and sample_id as text."""
    return rows.withColumn("sample_no", F.monotonically_increasing_id()).withColumn("sample_id", F.coalesce("sample_id", F.col("sample_no").cast("string")))


def turns(samples: DataFrame) -> DataFrame:
    """(sample_id, session, at, dia_id, role, content): turns by number of session; what has another shape is skipped."""
    each = samples.select("sample_id", F.explode(F.from_json("conversation", "map<string,string>")).alias("key", "value"))
    session = F.coalesce(F.nullif(F.regexp_extract("key", r"^session_(\d+)$", 1), F.lit("")).try_cast("int"), F.lit(-1))
    # a list's elements stay text at first, so that one of another shape does not spoil the others
    each = each.select("sample_id", session.alias("session"), "key", F.posexplode(F.from_json("value", "array<string>")).alias("at", "raw")).withColumn("t", F.from_json("raw", TURN))
    full = each.where("t.speaker is not null and t.dia_id is not null and t.text is not null")
    return full.select("sample_id", "session", "key", "at", F.col("t.dia_id").alias("dia_id"), F.col("t.speaker").alias("role"), F.concat_ws(": ", "t.speaker", "t.text").alias("content"))


def questions(samples: DataFrame, most: int | None = None) -> DataFrame:
    """(query_id, sample_id, query, category, at, text): questions with the evidence that turns resolve.

    Questions without text or resolvable evidence are skipped; `most` counts those that are left.
    """
    each = samples.select("sample_no", "sample_id", F.posexplode("qa").alias("no", "raw")).withColumn("q", F.from_json("raw", QUESTION)).where("coalesce(q.question, '') <> ''")
    item = each.select("sample_no", "sample_id", "no", F.col("q.question").alias("query"), F.coalesce("q.category", F.lit("unknown")).alias("category"), F.posexplode("q.evidence").alias("at", "dia_id"))
    last = turns(samples).groupBy("sample_id", "dia_id").agg(F.max_by("content", F.struct("session", "key", "at")).alias("text"))
    found = item.join(last, ["sample_id", "dia_id"]).withColumn("query_id", F.concat_ws(":", "sample_id", F.col("no").cast("string")))
    if most is not None:
        found = found.join(found.select("sample_no", "no", "query_id").distinct().orderBy("sample_no", "no").limit(most).select("query_id"), "query_id")
    return found.select("query_id", "sample_id", "query", "category", "at", "text")


def report(summary: DataFrame) -> str:
    """The one row of a summary as readable JSON."""
    return json.dumps(summary.first().asDict(recursive=True), ensure_ascii=False, indent=2)
