from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratafold.llm import mixing

from . import duck

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("target", T.StringType()), T.StructField("__shard", T.StringType()), T.StructField("shard", T.StringType())])


def corpus():
    rows = []
    for s, n in (("a", 400), ("b", 30), ("c", 1), ("é", 90), (None, 5), ("zero", 3)):
        for i in range(n):
            rows.append((len(rows), None if s == "zero" else "w " * (1 + (i * 31) % 97), s, "x", "y", "z"))
    return [*rows, (3, rows[3][1], "a", None, "", ""), (None, "one two", "b", None, "", ""), (7, "", "a", None, "", ""), (1000, "long " * 30_000, "b", "", "", "")]


def run(docs):
    monkeypatch = pytest.MonkeyPatch()
    with monkeypatch.context() as m:
        m.setattr(mixing, "documents", lambda *_: docs)
        return mixing.op3_mixing(docs.sparkSession, "")


@pytest.mark.parametrize("rows", [corpus(), [(1, "a b", None, None, "", "")], [(1, None, "s", None, "", "")], []], ids=["mixed", "one", "empty text", "no rows"])
def test_equals_sql(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    assert duck.spark_rows(run(docs)) == duck.rows(mixing.OP3_SQL, documents=docs)


def test_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SMALL_ROWS", 0)
    docs = spark.createDataFrame(corpus(), SCHEMA)
    assert duck.spark_rows(run(docs)) == duck.rows(mixing.OP3_SQL, documents=docs)


def test_rows_shards_and_reruns(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    out = mixing.mix(docs, 8, shard="to").collect()
    assert out[0].__fields__ == [*docs.columns, "to"] and mixing.mix(docs).columns == docs.columns
    got = {r.doc_id: r for r in run(docs).collect() if r.doc_id and r.doc_id > 7}
    by_doc = defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(str(r.to))
    assert {k: sorted(v) for k, v in by_doc.items() if k and k > 7} == {k: sorted(r.shards.split(",")) for k, r in got.items() if r.shards}
    assert all(r.taken == r.size * len(by_doc[k]) and len(by_doc[k]) <= 3 for k, r in got.items())
    assert sorted(map(repr, out)) == sorted(map(repr, mixing.mix(docs, 8, shard="to").collect()))


def test_a_partition_holds_runs_of_shards(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    for part in mixing.mix(docs, 8, shard="to").rdd.glom().collect():
        assert [r.to for r in part] == sorted(r.to for r in part)


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_tree_keeps_the_sums_of_sources_and_shards(spark, shards):
    quotas = {f"s{i}": (i * 37) % 300 for i in range(40)} | {"=": 5, "-": 768}
    out = mixing.splitting_tree(spark.createDataFrame(list(quotas.items()), "key string, quota long"), shards).collect()
    assert {r.key: sum(r.parts) for r in out} == quotas and all(len(r.parts) == shards and min(r.parts) >= 0 for r in out)
    load, total = [sum(r.parts[j] for r in out) for j in range(shards)], sum(quotas.values())
    assert load == [total * (j + 1) // shards - total * j // shards for j in range(shards)]


def test_draws_follow_the_hypergeometric_law(spark):
    good, bad, number = 60, 90, 50
    frame = spark.range(4000).select(mixing._hypergeometric(F.lit(good), F.lit(bad), F.lit(number), mixing._uniform("t", F.col("id").cast("string"))).alias("k"))
    k = np.array([r.k for r in frame.collect()])
    p = good / (good + bad)
    variance = number * p * (1 - p) * (good + bad - number) / (good + bad - 1)
    assert abs(k.mean() - number * p) < 4 * np.sqrt(variance / len(k)) and 0.9 < k.var() / variance < 1.1
    edges = spark.range(1).select(*[mixing._hypergeometric(F.lit(g), F.lit(b), F.lit(n), F.lit(u)) for g, b, n in ((0, 5, 3), (5, 0, 3), (4, 2, 6), (0, 0, 0)) for u in (0.0, 0.999)]).collect()[0]
    assert list(edges) == [0, 0, 3, 3, 4, 4, 0, 0]


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_every_draw_is_dealt_once(spark, shards):
    blocks = spark.createDataFrame([(s, f"{b:02x}", 1 + b % 3) for s in ("a", "b", None, "-") for b in range(64)], "source string, block string, draws int")
    out = mixing.deal(blocks, shards).collect()
    want = {(r.source, r.block): r.draws for r in blocks.collect()}
    assert {(r.source, r.block): len(r.shards) for r in out} == want
    load = Counter(x for r in out for x in r.shards)
    assert sorted(load) == list(range(shards)) and max(load.values()) - min(load.values()) <= 1
    parts = {r.key: r.parts for r in mixing.splitting_tree(blocks.selectExpr("coalesce('=' || source, '-') AS key", "draws").groupBy("key").agg(F.sum("draws").alias("quota")), shards).collect()}
    for source in ("a", "b", None, "-"):
        mine = Counter(x for r in out if r.source == source for x in r.shards)
        assert [mine[j] for j in range(shards)] == parts["-" if source is None else "=" + source]
