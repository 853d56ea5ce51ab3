"""What the pipeline's stages drop and keep where ids are null or stand for several texts."""

import pytest

from mnemora.llm import decontaminate, exact_dedup, ngram_join
from mnemora.sources import tables

SCHEMA = "doc_id long, text string, _x int"
ITEM = " ".join(f"w{i}" for i in range(20))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1) for i, t in rows], SCHEMA)


def left(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


@pytest.fixture(params=[500_000, 0], ids=["broadcast", "shuffled"])
def most(request, monkeypatch):
    monkeypatch.setattr(tables, "BROADCAST_IDS", request.param)


def test_copies(spark, most):
    keep = [(None, "only here"), (None, None), (9, "Copied"), (5, "other text"), (8, "again")]
    assert left(exact_dedup.drop_copies(docs(spark, [*keep, (None, "cOPIED"), (5, "copied"), (5, "AGAIN")]))) == sorted(keep, key=str)


def test_contaminated(spark, most):
    bench = spark.createDataFrame([("a", ITEM)], "item_id string, text string")
    keep = [(None, "only here"), (None, None), (5, "other text"), (6, "")]
    assert left(decontaminate.drop_contaminated(docs(spark, [*keep, (None, ITEM), (5, f"x {ITEM}"), (5, ITEM)]), bench)) == sorted(keep, key=str)


def test_near_copies(spark, most):
    keep = [(None, "only here are these few words"), (3, ITEM), (5, "another text of six words here")]
    assert left(ngram_join.drop_near_copies(docs(spark, [*keep, (5, ITEM.upper())]))) == sorted(keep, key=str)
