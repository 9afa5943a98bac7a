import pytest
from pyspark.sql import types as T

from stratafold.llm import token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_tokens", T.StringType())])


def expected(text):
    from tokenizers import Tokenizer

    return len(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode(text or "", add_special_tokens=False).ids)


TEXTS = [None, "", "  \n\t ", "Hello, WORLD it's 2024!", "été é x y\u0085z", "a<|endoftext|>b <|startoftext|><|endoftext|>", "<|endoftext|", "x" * 5000, "we'll they'VE 'sup İstanbul 한국어 한 123 ٣", "word " * 3000, "\x0b\x0c a\x0bb\x1cc", "́ a ́b"]


@pytest.mark.parametrize("head", [1 << 19, 5, 0])
def test_equals_the_library(spark, head, monkeypatch):
    monkeypatch.setattr(token_counts, "HEAD_SIZE", head)
    rows = [(i, t, None) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], None), (None, "a b", "clash")]
    got = token_counts.count_tokens(spark.createDataFrame(rows, SCHEMA), public_tokenizers.path("word_bpe_49k.json"), 100).collect()
    want = sorted((-1 if i is None else i, len((t or "").encode()), expected(t), expected(t) > 100) for i, t, _ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want


def test_empty_table_and_real_texts(spark):
    assert token_counts.count_tokens(spark.createDataFrame([], SCHEMA), public_tokenizers.path("word_bpe_49k.json")).collect() == []
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert len(got) == len(texts) and all(r.n_tokens == expected(texts[r.doc_id]) for r in got)
