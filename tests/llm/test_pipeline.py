from collections import Counter

import corpus_pipeline

from . import duck
from .test_near_dup import brute


def test_stages_and_run(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, d)
        out.write.parquet(f"{tmp_path}/{name}")
        seen[name] = (docs, out := spark.read.parquet(f"{tmp_path}/{name}"))
        assert name == "sharding" or out.columns == columns
        docs = out
    before, after = ([(r.doc_id, r.text) for r in x.collect()] for x in seen["near-dedup"])
    assert sorted(r[0] for r in after) == [r[0] for r in brute(before) if r[3]]
    from stratafold.llm.decontamination import OP4_SQL

    before, after = seen["decontamination"]
    bad = {dict(r)["doc_id"] for r in duck.rows(OP4_SQL, documents=before, benchmark=spark.read.parquet(f"{d}/benchmark.parquet")) if dict(r)["contaminated"]}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - bad
    from stratafold.llm.mixing import OP3_SQL

    before, after = seen["mixing"]
    want = {dict(r)["doc_id"]: dict(r) for r in duck.rows(OP3_SQL, documents=before)}
    copies = Counter(r.doc_id for r in after.collect())
    assert all(copies[k] * v["size"] == v["taken"] for k, v in want.items())
    assert docs.count() == sum(copies.values())
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    before, after = ({r.doc_id for r in x.collect()} for x in seen["toxicity"])
    assert sum(labels.get(i) == 0 for i in before - after) <= 0.02 * len(before)
