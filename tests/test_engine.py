"""Stemming and BM25 against SQLite's full-text index; evaluation, sources, streams and hooks."""

import json
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from mnemora.functions.porter import with_stem
from mnemora.operators import analyse, evaluate, ingest, model, rank
from mnemora.operators.index import build, documents
from mnemora.plans.search import checked_queries
from mnemora.plans.store import Store, health
from mnemora.sources import cases
from mnemora.streaming.ingest import ingest_stream, request_stream

WORDS = "caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption communism activate angulariti homologous effective bowdlerize probate rate cease controll roll relocated prefers choosing researched yes yellow employed agencies apology ies us as be a".split()


def fts(**columns):
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table plain using fts5(c)")
        db.execute("create virtual table porter using fts5(c, tokenize='porter unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("SQLite has no full-text index here")
    return db


def test_stems(spark):
    db = fts()
    db.executemany("insert into porter(rowid, c) values (?, ?)", list(enumerate(WORDS)))
    db.execute("create virtual table v using fts5vocab(porter, 'instance')")
    want = {WORDS[doc]: term for term, doc in db.execute("select term, doc from v")}
    got = dict(with_stem(spark.createDataFrame([(w,) for w in WORDS], "word string"), "word").collect())
    assert got == want


def test_bm25_is_that_of_a_full_text_index(spark):
    rng = random.Random(1)
    vocabulary = ["tea", "Teas", "drink", "drinking", "Café", "cafe", "milo", "prefers", "prefer", "日本", "green", "of"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 9))) or "x" for _ in range(60)]
    db = fts()
    for t in ("plain", "porter"):
        db.executemany(f"insert into {t}(rowid, c) values (?, ?)", list(enumerate(texts, 1)))
    rows = spark.createDataFrame([(f"r{i}", f"u{i % 3}", "s", [("user", t, None)], i) for i, t in enumerate(texts, 1)], ingest.REQUEST)
    messages = ingest.messages_of(rows, "now")
    index = build(documents(messages, ingest.contexts(messages), None))
    asked = [("a", ["tea"]), ("b", ["drinking", "prefer"]), ("c", ["café", "of", "日本"]), ("d", ["green tea", "milo"])]
    q = analyse.analysed(spark.createDataFrame([(i, "?", f"u{u}", 100, p) for i, p in asked for u in [1]], "query_id string, query string, user_id string, top_k int, planned array<string>"))
    got = rank.bm25(analyse.phrases(q), index, [("any", "raw"), ("any", "raw_porter")]).collect()
    found = {(r.query_id, r.idx, r.doc): r.score for r in got}
    want = {}
    for i, p in asked:
        for t, idx in (("plain", "raw"), ("porter", "raw_porter")):
            for doc, score in db.execute(f"select rowid, bm25({t}) from {t} where {t} match ?", (" OR ".join(f'"{x}"' for x in p),)):
                if doc % 3 == 1:
                    want[i, idx, doc] = -score
    assert found.keys() == want.keys()
    assert all(found[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_query_analysis(spark):
    q = spark.createDataFrame([("a", "What did Ravi and Ravi prefer, Now?"), ("b", "the of"), ("c", "What of Ravi Milo Ana"), ("d", "used to be 现在")], "query_id string, query string").withColumns({"user_id": F.lit("u"), "top_k": F.lit(13)})
    got = {r.query_id: r for r in analyse.analysed(q).collect()}
    assert (got["a"].terms, got["a"].entities, got["a"].others, got["a"].direction) == (["Ravi", "prefer", "Now"], ["Ravi", "Ravi"], ["prefer", "Now"], 1)
    assert got["b"].terms == ["the", "of"] and got["b"].pool == 52
    assert got["c"].entities == ["Ravi", "Milo"] and got["d"].direction == 1
    bad = checked_queries(spark.createDataFrame([(" ", "u", 1), ("q", "", 1), ("q", "u", 0), ("q", "u", None)], "query string, user_id string, top_k int"))
    assert [r.fault for r in bad.collect()] == ["query", "user_id", "top_k", None]


def test_requests_are_checked(spark):
    rows = [("r", "u", "s", [(" user ", "　hi\n", None)], 1), (" ", "u", "s", [("a", "b", 1)], 2), ("r", "u", "s", [], 3), ("r", "u", "s", [("a", "  ", 1)], 4), ("r", "u", None, [("a", "b", 1)], 5)]
    got = ingest.checked(spark.createDataFrame(rows, ingest.REQUEST)).orderBy("arrival").collect()
    assert [r.fault for r in got] == [None, "request_id", "messages", "message", "session_id"]
    assert got[0].messages[0] == ("user", "hi", None)


def test_dense_ids(spark):
    got = ingest.dense_ids(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7), ["k"], first=5).collect()
    assert sorted((r.k, r.id) for r in got) == [(k, k + 5) for k in range(1000)]


def test_evaluation(spark, tmp_path):
    rows = [{"case_id": "c", "user_id": "u", "session_id": "s", "messages": [{"role": "user", "content": "Lena restores violins."}], "query": "What does Lena restore?", "expected_evidence": ["lena RESTORES violins", "absent"]}]
    (tmp_path / "cases.json").write_text(json.dumps(rows))
    found = cases.cases(spark, str(tmp_path / "cases.json"))
    store = Store(spark, str(tmp_path / "store"))
    store.add(cases.requests_of(found))
    got = store.search(found.select(F.col("case_id").alias("query_id"), "query", "user_id", F.lit(10).alias("top_k")))
    ranks = evaluate.evidence_ranks(got, cases.evidence_of(found))
    one = evaluate.summary(evaluate.by_case(ranks, [1, 10]), [1, 10])
    assert one.first().asDict() == {"cases": 1, "evidence_items": 2, "mrr": 1.0, "mrr_best": 1.0, "recall_1": 0.5, "coverage_1": 0.0, "hit_1": 1.0, "recall_10": 0.5, "coverage_10": 0.0, "hit_10": 1.0}
    assert json.loads(cases.report(one))["mrr"] == 1.0
    assert evaluate.summary(evaluate.by_case(ranks.limit(0), [1]), [1]).first().recall_1 == 0.0
    for bad in ([0], [101], []):
        with pytest.raises(ValueError):
            evaluate.checked_depths(bad)
    assert evaluate.checked_depths([10, 1, 10]) == [1, 10]
    del rows[0]["expected_evidence"]
    (tmp_path / "bad.json").write_text(json.dumps(rows))
    with pytest.raises(ValueError, match="Case c lacks expected_evidence"):
        cases.cases(spark, str(tmp_path / "bad.json"))
    (tmp_path / "object.json").write_text("{}")
    with pytest.raises(ValueError, match="array"):
        cases.cases(spark, str(tmp_path / "object.json"))


def test_dialogues(spark, tmp_path):
    sample = {
        "conversation": {"session_2": [{"speaker": "A", "dia_id": "D2", "text": "Tea?"}, {"speaker": "A", "text": "x"}, "odd"], "session_1": [{"speaker": "B", "dia_id": "D1", "text": "Jasmine."}], "session_1_date_time": "May"},
        "qa": [{"question": "What?", "evidence": ["D1", "D9"], "category": 3}, {"question": "Q", "evidence": ["D9"]}, {"question": "Next?", "evidence": ["D2"]}],
    }
    (tmp_path / "d.json").write_text(json.dumps([sample]))
    rows = cases.dialogues(spark, str(tmp_path / "d.json"))
    assert [(r.session, r.role, r.content) for r in cases.turns(rows).orderBy("session").collect()] == [(1, "B", "B: Jasmine."), (2, "A", "A: Tea?")]
    assert [(r.query, r.category, r.text) for r in cases.questions(rows).orderBy("query_id").collect()] == [("What?", "3", "B: Jasmine."), ("Next?", "unknown", "A: Tea?")]
    assert cases.questions(rows, 1).select("query_id").distinct().count() == 1


def test_stream_counts_requests_once_across_restarts(spark, tmp_path):
    store, at = Store(spark, str(tmp_path / "store")), tmp_path / "in"
    at.mkdir()

    def send(name, *ids):
        (at / f"{name}.json").write_text("\n".join(json.dumps({"request_id": i, "user_id": "u", "session_id": "s", "messages": [{"role": "user", "content": f"tea {name}"}], "arrival": k}) for k, i in enumerate(ids)))

    def run():
        ingest_stream(request_stream(spark, str(at), 1), store, str(tmp_path / "checkpoint"), "now").awaitTermination()

    send("one", "a", "b", "a")
    run()
    send("two", "b", "c")
    run()
    got = sorted((r.request_id, r.content, r.id) for r in store.read("messages").collect())
    assert got == [("a", "tea one", 1), ("b", "tea one", 2), ("c", "tea two", 3)]
    assert health() == {"status": "ok"}


def requests_of(spark, *ids, user="u"):
    return spark.createDataFrame([(i, user, "s", [("user", f"tea of {i}", None)], k) for k, i in enumerate(ids)], ingest.REQUEST)


def test_two_streams_on_one_store(spark, tmp_path):
    """Each stream's first micro-batch has the same number, and both are stored."""
    store = Store(spark, str(tmp_path / "store"))
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.json").write_text(json.dumps({"request_id": name, "user_id": "u", "session_id": "s", "messages": [{"role": "user", "content": "tea"}], "arrival": 1}))
        ingest_stream(request_stream(spark, str(tmp_path / name)), store, str(tmp_path / f"checkpoint-{name}"), "now").awaitTermination()
    assert sorted((r.request_id, r.id) for r in store.read("messages").collect()) == [("one", 1), ("two", 2)]


def test_two_writers(spark, tmp_path, monkeypatch):
    """A writer that another one overtakes starts again: nothing is lost, stored twice or given an id twice."""
    first, second = Store(spark, str(tmp_path / "store")), Store(spark, str(tmp_path / "store"))
    whole, overtaken = first._store, []

    def slow(*args):
        if not overtaken:
            overtaken.append(second.add(requests_of(spark, "b", "c")))
        return whole(*args)

    monkeypatch.setattr(first, "_store", slow)
    first.add(requests_of(spark, "a", "b"))
    assert sorted((r.request_id, r.id) for r in second.read("messages").collect()) == [("a", 3), ("b", 1), ("c", 2)]
    q = spark.createDataFrame([("q", "tea", "u", None)], "query_id string, query string, user_id string, top_k int")
    before = sorted(first.search(q).collect())
    assert len(before) == 3
    second.compact()
    second.vacuum()
    assert sorted(first.search(q).collect()) == before and len(first._live(first._manifest()[1])) == 1
    first.add(requests_of(spark, "c", "d"))
    assert sorted((r.request_id, r.id) for r in first.read("messages").collect())[-1] == ("d", 4)
    for bad in ([("q", "tea", "u", 500)], [("q", " ", "u", 5)]):
        with pytest.raises(ValueError):
            first.search(spark.createDataFrame(bad, q.schema))


def test_hooks(spark):
    one = spark.createDataFrame([('{"terms": [" a ", "", 3, "b"]}', '{"terms": "x"}', "no json")], "a string, b string, c string")
    got = one.select(*[model.parsed(F.col(c), "terms").alias(c) for c in "abc"]).first()
    assert (got.a[:1], got.b, got.c) == (["a"], [], [])
    order = one.select(model.allowed_order(F.array(*map(F.lit, "xyxz")), F.array(*map(F.lit, "zx"))).alias("o")).first().o
    assert order == ["x", "z"]
    for bad in ({model.REQUIRED: "True"}, {model.BONUS: "0.02"}, {model.BONUS: "-1"}):
        with pytest.raises(ValueError):
            model.Settings.of(bad)
    assert model.Settings.of({}).model(str) is None and model.Settings.of({model.KEY: "k", model.REQUIRED: "true"}).model(str.upper) == "K"
    with pytest.raises(ValueError):
        Store(spark, "/tmp/none", bonus=0.1)
    assert model.SearchOnly(model.RuleModel()).extract_facts(F.lit("x")) is not None


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["query_id", "place", "id", "score", "content_sha256", "created_at"]
