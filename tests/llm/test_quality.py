import random
import re
from collections import Counter

from pyspark.sql import types as T

from stratafold.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("label", T.StringType())])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType())])


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    runs = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if runs[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in quality.SYMBOLS for c in text), dup, len(hit)


def texts():
    r = random.Random(3)
    out = [None, "", " \n\n\t", "é ü\x0bñ a", "a b c a b c", "x\nx\n \nx y\nx y\n", "one two", "# * $% &|<>", "z" * 100_000, "w v " * 40_000, "a b c d e"]
    for _ in range(60):
        out.append("".join(r.choice(["a", "b", "é ", " ", "\n", "c ", "#", "a b c ", "\r\n"]) for _ in range(r.randrange(200))))
    return out


def rows_of(frame):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in frame.collect())


def test_base_statistics(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(2, "a b c", ""), (None, "a b", "")]
    out = quality.score(spark.createDataFrame(rows, SCHEMA), None)
    assert rows_of(out) == sorted((-1 if i is None else i, *brute(t)) for i, t, _ in rows)
    for r in out.collect():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r.kept == (not r.base_failed)


def test_whole_table_and_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    out = quality.op1_quality(spark, d).collect()
    assert sorted(r.doc_id for r in out) == sorted(docs)
    assert all((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(docs[r.doc_id]) for r in out)
    frame = spark.read.parquet(f"{d}/documents.parquet")
    given = spark.read.parquet(f"{d}/labels.parquet")
    model = quality.train(frame, given.filter("doc_id % 2 = 0"))
    judged = [(r.quality >= 0.5, labels[r.doc_id]) for r in quality.score(frame, model).collect() if labels.get(r.doc_id) is not None and r.doc_id % 2]
    assert sum(a == b for a, b in judged) >= 0.95 * len(judged)


def test_without_labels_and_empty(spark):
    none = spark.createDataFrame([], LABELS)
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60)), None)], SCHEMA)
    assert quality.train(docs, none) is None
    assert quality.train(docs, spark.createDataFrame([(1, 1), (None, 0), (1, None)], LABELS)) is None
    assert [r.kept for r in quality.score(docs, None).collect()] == [True]
    assert quality.score(spark.createDataFrame([], SCHEMA), None).collect() == []
