"""Many queries at once: the pruned ranking against the plain one."""

import random

import pytest
from pyspark.sql import functions as F

from mnemora.operators import analyse, ingest, rank
from mnemora.operators.index import build, documents
from mnemora.operators.model import RuleModel


@pytest.fixture(scope="module")
def made(spark):
    """Words from very common to rare, many equal documents, two users; some queries of several words, phrases and entities."""
    r = random.Random(7)
    words = [f"w{k}" for k in range(40)] + ["Ada", "Bo"]
    weights = [1 / (k + 1) for k in range(40)] + [0.2, 0.2]
    say = lambda n: " ".join(r.choices(words, weights, k=n))
    rows = [(k, f"r{k // 3}", f"u{k // 3 % 2}", "s", "user", say(r.randint(1, 6)) + ". " + say(12), k, k % 3, "now") for k in range(900)]
    messages = spark.createDataFrame(rows, "id long, request_id string, user_id string, session_id string, role string, content string, event_ts long, sequence int, created_at string")
    index = build(documents(messages, ingest.contexts(messages), ingest.facts_of(messages, RuleModel().extract_facts(F.col("content")))))
    asks = [(k, say(r.randint(1, 5)) + r.choice(["", " Ada", " Bo w1"]), f"u{k % 3}", r.choice([1, 3, 10, 60]), [[], ["w0 w1"], ["w2 w0 w1", "w9"]][k % 3]) for k in range(60)]
    return index, spark.createDataFrame(asks, "query_id int, query string, user_id string, top_k int, planned array<string>")


def rows(df):
    return sorted((r.query_id, r.family, r.idx, r["rank"], r.doc, r.message, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("small", [False, True])
def test_pruned_ranks_are_the_plain_ones(spark, made, small, monkeypatch):
    index, asks = made
    q = analyse.analysed(asks)
    q = q.withColumn("pool", F.col("top_k")) if small else q
    phrases, channels = analyse.phrases(q), rank.all_channels()
    want = rows(rank.ranked(rank.bm25(phrases, index, channels), q))
    assert {r[1] for r in want} == {"any", "both"}
    assert rows(rank.best(phrases, index, channels, q, few=1)) == want
    monkeypatch.setattr(rank, "MOST_ASKED", 300)
    assert rows(rank.best(phrases, index, channels, q, few=1)) == want


def test_token_counts_are_of_documents(made):
    index = made[0]
    plain = index.postings.groupBy("corpus", "idx", "token").agg(F.countDistinct("doc").alias("n"))
    assert sorted(map(tuple, index.token_stats.select(plain.columns).collect())) == sorted(map(tuple, plain.collect()))
