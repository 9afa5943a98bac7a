import zlib

import numpy as np
from pyspark.sql import types as T

from stratafold.llm import toxicity

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("score", T.StringType())])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("toxic", T.IntegerType())])


def test_label_model_recovers_accuracies():
    r = np.random.default_rng(5)
    y = r.random(4000) < 0.3
    votes = np.stack([np.where(r.random(4000) < c, np.where(r.random(4000) < a, y, ~y).astype(int), -1) for a, c in ((0.95, 0.6), (0.9, 0.5), (0.8, 0.7), (0.9, 0.4), (0.85, 0.6))], 1)
    votes = np.concatenate([votes, votes[:, 2:3], votes[:, 2:3]], 1)  # the weakest voter thrice: correlated
    assert np.mean((toxicity.label_model(votes, 0.3) > 0.5) == y) > 0.9


def test_held_out_accuracy_and_columns(spark):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = toxicity.op6_toxicity(spark, d).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert len(out) == docs.count()
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    judged = [(r.predicted, labels[r.doc_id]) for r in out if r.held_out and labels.get(r.doc_id) is not None]
    toxic = [p for p, y in judged if y == 1]
    clean = [p for p, y in judged if y == 0]
    assert sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.01 * len(clean)


def test_defined_cases(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "!!!", None), (None, "a b c", None), (4, "word " * 50_000, ""), (4, "word", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert toxicity.train(docs, spark.createDataFrame([], LABELS)) is None
    out = toxicity.score(docs, None).collect()
    assert len(out) == 6 and all(r.score == 0 and r.predicted == 0 for r in out)
    given = [(i, "idiot scum trash" if i % 2 else "a fine day out") for i in range(200)]
    docs = spark.createDataFrame([(i, t, None) for i, t in given] + rows, SCHEMA)
    model = toxicity.train(docs, spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (3, None)], LABELS))
    got = {r.doc_id: r for r in toxicity.score(docs, model).filter("doc_id > 4").collect()}
    assert all(r.predicted == k % 2 for k, r in got.items())
    kept = toxicity.keep_clean(docs, model)
    assert kept.schema == docs.schema and sum(1 for r in kept.collect() if r.text == "idiot scum trash") == 0
    assert toxicity.score(spark.createDataFrame([], SCHEMA), model).collect() == []
