"""The engine's queries over small tables against brute force."""

import re

import pytest
from pyspark.sql import functions as F

from mnemora import queries
from mnemora.operators import ingest
from mnemora.operators.model import RuleModel
from mnemora.sources import cases as sources

TURNS = "conv_id long, turn long, role string, text string"


@pytest.fixture
def tables(spark, tmp_path):
    def make(conversations):
        rows = [(c, k, "user", t) for c, texts in conversations.items() for k, t in enumerate(texts)]
        spark.createDataFrame(rows, TURNS).coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
        return str(tmp_path)

    return make


def test_every_conversation_is_a_case(spark, tables):
    said = {c: [f"Opening{c} words about green tea", f"reply{c} mentions jasmine{c} harbour walks"] for c in range(11)}
    said[11] = ["Alone"]
    said[12] = ["Opening12 words", "one"]  # no second token, so no query
    sf = tables(said)
    q, evidence = queries.eval_cases(spark, sf)
    assert sorted((r.query_id, r.query, r.user_id) for r in q.collect()) == sorted((c, f"mentions jasmine{c} harbour", f"user:{c % 20}") for c in range(11))
    assert sorted((r.query_id, r["at"], r.text) for r in evidence.collect()) == sorted((c, 1 - k, said[c][k][:12].upper()) for c in range(11) for k in (0, 1))
    got = queries.QUERIES["recall_at_k"](spark, sf).first()
    # each user has but one conversation: both its messages are found, the reply first
    assert (got.cases, got.evidence_items, got.recall_1, got.recall_3) == (11, 22, 0.5, 1.0)
    kinds = {r.category: r.questions for r in queries.category_hit_at_1(spark, sf).collect()}
    assert kinds == {k: sum(str(c % 4) == k or (c % 4 == 3 and k == "unknown") for c in range(11)) for k in ("0", "1", "2", "unknown")}


def test_every_sentence_is_a_fact(spark, tables):
    long = ". ".join(f"Sentence number {i} is long enough" for i in range(7))
    said = {1: [f"{long}. Short. {long[:33]}.", "no long one. x."], 2: [long.replace("number", "numeral")]}
    sf = tables(said)
    want, at = [], 0
    for c, texts in said.items():
        for t in texts:
            at += 1
            want += [(at * 2**27 + k, f"user:{c}", at, x) for k, x in enumerate(dict.fromkeys(x for x in map(str.strip, re.split(r"\.", t)) if len(x) >= 20))]
    assert len(want) == 14
    assert sorted(map(tuple, queries.fact_ingest(spark, sf).collect())) == want
    assert {r.idx: r.n_docs for r in queries.channel_stats(spark, sf).collect()} == {f"{i}{p}": n for i, n in (("raw", 3), ("context", 3), ("fact", 14)) for p in ("", "_porter")}


def test_fact_ids_of_long_messages_differ(spark):
    """More facts than once had room between two messages' ids."""
    text = ".".join(f"{i:020d}" for i in range(5000))
    messages = spark.createDataFrame([(1, "u", text), (2, "u", text)], "id long, user_id string, content string")
    facts = ingest.facts_of(messages, RuleModel().extract_facts(F.col("content")))
    assert facts.select("fact_id").distinct().count() == facts.count() == 10_000


@pytest.fixture
def uncoalesced(spark):
    """Arrays of files come from several tasks, as they do from more input."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_every_case_is_read_from_several_files(spark, tables, uncoalesced):
    sf = tables({c: [f"Said in {c}"] for c in range(6000)})
    assert sorted(r.case_id for r in queries.case_files(spark, sf).collect()) == sorted(f"c{c}" for c in range(6000))


def test_every_turn_is_read_from_several_files(spark, tables, uncoalesced):
    sf = tables({c: ["One", "two"] for c in range(6000)})
    assert sorted(r.dia_id for r in queries.dialogue_files(spark, sf).collect()) == sorted(f"{c}:{k}" for c in range(6000) for k in (0, 1))


def test_only_one_array_in_a_file(spark, tmp_path):
    dialogue = '{"sample_id":"%s","conversation":{"session_1":[{"speaker":"Ana","dia_id":"D1:1","text":"[x] \\"]} y"}]}}'
    for k, text in enumerate((f"[{dialogue % 1}] [{dialogue % 2}]", f"[{dialogue % 1}] x", f"[{dialogue % 1}, {{", "{}")):
        (tmp_path / f"{k}.json").write_text(text)
        with pytest.raises(ValueError, match="must hold a JSON array"):
            sources.dialogues(spark, str(tmp_path / f"{k}.json"))
    (tmp_path / "one.json").write_text(f"\n [{dialogue % 1},\n{dialogue % 2}]\n")
    assert [r.content for r in sources.turns(sources.dialogues(spark, str(tmp_path / "one.json"))).collect()] == ['Ana: [x] "]} y'] * 2
