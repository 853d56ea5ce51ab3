"""Small stores with results derived by hand from ranks: sums of weight / (60 + rank) over the channels."""

import pytest
from pyspark.sql import functions as F

from mnemora.operators.ingest import REQUEST
from mnemora.operators.model import RuleModel
from mnemora.plans.store import Store


def add(spark, store, *batches, user="user-a"):
    rows = [(f"r-{user}-{i}", user, "s", [(m.get("role", "user"), m["content"], m.get("timestamp")) for m in b], i) for i, b in enumerate(batches)]
    store.add(spark.createDataFrame(rows, REQUEST), now="2026-01-01T00:00:00Z")


def ask(spark, store, query, top_k=10, user="user-a", **more):
    q = spark.createDataFrame([("q", query, user, top_k, more.get("options"))], "query_id string, query string, user_id string, top_k int, options array<string>")
    return [(r.id, r.score) for r in store.search(q).orderBy("place").collect()]


@pytest.fixture
def store(spark, tmp_path):
    return lambda **kw: Store(spark, str(tmp_path / "store"), **kw)


def test_newest_wins_for_current(spark, store):
    s = store(bonus=0.001)
    add(spark, s, [{"timestamp": 200, "content": "Noor's favourite colour is green."}], [{"timestamp": 100, "content": "Noor's favourite colour is blue."}])
    assert ask(spark, s, "What is Noor's current favourite colour?") == [("mem_1", 0.049387), ("mem_2", 0.049180)]
    s.bonus = 0.0
    assert ask(spark, s, "What is Noor's current favourite colour?") == [("mem_2", 0.049180), ("mem_1", 0.048387)]


def test_oldest_wins_for_before(spark, store):
    s = store(bonus=0.001)
    add(spark, s, [{"timestamp": 100, "content": "Noor's favourite colour is dark blue."}], [{"timestamp": 200, "content": "Noor's favourite colour is pale green."}])
    assert ask(spark, s, "Which colour was Noor's before?") == [("mem_1", 0.049387), ("mem_2", 0.049180)]


def test_stop_words_context_and_stems(spark, store):
    s = store()
    add(spark, s, [{"content": c} for c in ("Oskar is picking a route for the morning.", "He decides on the coastal path.", "Ines wants to paint tomorrow.")])
    assert ask(spark, s, "Which path did Oskar pick?") == [("mem_1", 0.048916), ("mem_2", 0.048652), ("mem_3", 0.015873)]
    assert ask(spark, s, "???") == []
    add(spark, s, [{"content": "Bruno repairs old radios."}], user="user-b")
    assert ask(spark, s, "What does Bruno repair?", user="user-b")[0][0] == "mem_4"
    assert ask(spark, s, "Bruno") == []


def test_entities_and_repeats(spark, store):
    s = store()
    add(spark, s, [{"content": "Tobias studied desert beetles."}, {"content": "Greta studied river beetles."}])
    assert ask(spark, s, "What did Tobias study?") == [("mem_1", 0.048916), ("mem_2", 0.032522)]
    add(spark, s, [{"content": "Tobias studied desert beetles."}])  # r-user-a-0 is known: nothing happens
    assert s.read("messages").count() == 2


def test_requests_count_once(spark, store):
    s = store()
    first = [{"timestamp": 500, "content": "Petra keeps bees behind the barn."}, {"role": "assistant", "content": "Petra sings in Porto."}]
    add(spark, s, first)
    add(spark, s, first)
    assert ask(spark, s, "bees", 100) == [("mem_1", 0.048916), ("mem_2", 0.016393)]


def test_model_hooks(spark, store):
    class Fake(RuleModel):
        def extract_facts(self, content):
            return F.when(content.contains("figs"), F.array(F.lit("Yusuf grows figs on the terrace."))).otherwise(F.array().cast("array<string>"))

        def plan_query(self, query, options):
            return F.array(F.lit("Yusuf"), F.lit("grows figs"))

    s = store(model=Fake())
    add(spark, s, [{"content": "Yusuf grows figs."}, {"content": "Yusuf likes repairing clocks."}])
    assert s.read("facts").count() == 1
    got = ask(spark, s, "Which fruit does Yusuf tend?", 2)
    assert got[0][0] == "mem_2"  # the stand-in puts the longest first
    assert {i for i, _ in got} == {"mem_1", "mem_2"}
