import random

import pytest
from pyspark.sql import types as T

from stratafold.llm import decontamination as D

from . import duck

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("hash", T.StringType()), T.StructField("words", T.StringType())])
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])


def case(seed, vocabulary):
    r = random.Random(seed)
    word = lambda: r.choice(vocabulary)
    items = [(i, " ".join(word() for _ in range(r.choice([0, 3, 9, 10, 11, 25])))) for i in range(12)] + [(90, None), (91, "a"), (92, "a"), (93, "...")]
    docs = [(0, None, "h", None), (1, "", "", ""), (2, "a A a a a a a a a a a a a a", "x", None)]
    for i in range(3, 60):
        text = [word() for _ in range(r.randrange(60))]
        for _ in range(r.randrange(3)):
            at = r.randrange(len(text) + 1)
            text[at:at] = (r.choice(items)[1] or "").upper().split()
        docs.append((i, ", ".join(text), None, "y"))
    return [*docs, docs[5], (5, docs[6][1], None, None), (None, docs[7][1], None, None), (99, "the " * 20_000, None, None)], items


@pytest.mark.parametrize("seed,vocabulary", [(1, ["a", "b"]), (2, ["the", "of", "é", "x1", "zz"] + [f"w{i}" for i in range(40)]), (3, [f"v{i}" for i in range(400)])])
def test_equals_sql(spark, seed, vocabulary):
    docs, items = case(seed, vocabulary)
    docs, items = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    got, want = duck.spark_rows(D.report(docs, items)), duck.rows(D.OP4_SQL, documents=docs, benchmark=items)
    # rows of equal doc_id and text share one result; the SQL numbers rows, with the same outcome
    assert got == want
    bad = {dict(r)["doc_id"] for r in got if dict(r)["contaminated"]}
    kept = D.drop_contaminated(docs, items)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} | bad == {r.doc_id for r in docs.collect()}


def test_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(D, "SMALL_ROWS", 0)
    docs, items = case(2, ["p", "q", "r"])
    docs, items = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert duck.spark_rows(D.report(docs, items)) == duck.rows(D.OP4_SQL, documents=docs, benchmark=items)


def test_empty_sides(spark):
    docs, items = case(1, ["a", "b"])
    docs, items = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert D.report(docs.limit(0), items).collect() == []
    assert not any(r.contaminated for r in D.report(docs, items.limit(0)).collect())


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x red y blue z green w", None, None), (2, "red " + "f " * 30 + "blue green", None, None), (3, "green blue red", None, None), (4, "red a b c d e f blue", None, None), (4, "blue " + "g " * 19 + "green red", None, None)], DOCS)
    items = spark.createDataFrame([(1, "red blue green"), (2, "red blue green"), (3, "green"), (4, "green red blue")], ITEMS)
    out = {(r.doc_id, r.n_words): r for r in D.report(docs, items).collect()}
    assert {k: r.n_near_items for k, r in out.items()} == {(1, 7): 4, (2, 33): 1, (3, 3): 4, (4, 8): 0, (4, 22): 1}
    assert {k: r.n_items for k, r in out.items()} == {(1, 7): 1, (2, 33): 1, (3, 3): 1, (4, 8): 0, (4, 22): 1}


def test_a_term_repeated_all_through_a_long_text(spark):
    docs = spark.createDataFrame([(1, "a " * 20_000 + "b", None, None), (2, "b a", None, None)], DOCS)
    items = spark.createDataFrame([(1, "a b"), (2, "b")], ITEMS)
    assert {r.doc_id: (r.n_hit, r.n_items, r.n_near_items) for r in D.report(docs, items).collect()} == {1: (2, 2, 2), 2: (1, 1, 2)}
