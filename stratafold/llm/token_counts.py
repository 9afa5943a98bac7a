"""Token counts: pieces are counted once per distinct pre-token, joined to per-document frequencies, and summed.

A pre-token is a run of the text between white space (space, tab, line feed, vertical tab, form feed, carriage return).
No token of the vocabulary spans those, so the pieces of a text are those of its pre-tokens; special strings, which hold
no white space, are handled inside a pre-token by the library. Pre-tokens are named by 64-bit hashes.

The commonest pre-tokens (HEAD_SIZE at most, a fixed bound) are broadcast with their piece counts and summed in the scan.
The others are joined by a shuffle, in which none is hot: each is rarer than every one of the head. No token id is kept.

Defined cases: an empty table gives no rows; a null text has no bytes and no tokens; rows with equal doc_id are counted
each; a text without white space is one pre-token; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .staging import documents, stage

#: Pre-tokens whose counts are broadcast, at most (12 bytes each).
HEAD_SIZE = 1 << 19
#: Bytes of text handled at once.
CHUNK = 12 << 20


def _strings(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    at = np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw[at].tobytes())).cast(pa.string())


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, raw, offsets in K.pieces(batches, "text", CHUNK):
        starts, ends, _ = K.spans(raw, offsets, K.SPACES)
        if len(starts):
            keys, first, times = np.unique(K.hashes(raw, starts, ends)[0], return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), _strings(raw, starts[first], ends[first]), pa.array(times.astype(np.int64))], ["key", "word", "times"])


def _counter(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda words: [len(x.ids) for x in tokenizer.encode_batch(words, add_special_tokens=False)]


def _piece_counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        count = _counter(path)
        for batch in batches:
            words = batch.column("word").to_pylist()
            pieces = [n for i in range(0, len(words), 2000) for n in count(words[i : i + 2000])]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("times"), pa.array(pieces, pa.int32())], ["key", "times", "pieces"])

    return run


def vocabulary(docs: DataFrame, path: str) -> DataFrame:
    """key, times, pieces of every distinct pre-token of column text."""
    seen = docs.select("text").mapInArrow(_distinct_words, "key long, word string, times long")
    return seen.groupBy("key", "word").agg(F.sum("times").alias("times")).mapInArrow(_piece_counts(path), "key long, times long, pieces int")


def _head(vocab: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Keys and piece counts of the commonest pre-tokens, and the level of commonness from which they are in the head."""
    level = F.floor(F.log2("times") * 8).cast("int")
    rows = vocab.groupBy(level.alias("level")).count().collect()
    total, cutoff = 0, 1 << 30
    for r in sorted(rows, key=lambda r: -r["level"]):
        total += r["count"]
        if total > HEAD_SIZE:
            break
        cutoff = r["level"]
    table = vocab.filter(level >= cutoff).select("key", "pieces").toArrow()
    keys = table.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], table.column("pieces").to_numpy()[order].astype(np.int64), cutoff


def _per_document(head):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, pieces = head.value
        for batch, raw, offsets in K.pieces(batches, "text", CHUNK):
            starts, ends, first = K.spans(raw, offsets, K.SPACES)
            seen, at = np.unique(K.hashes(raw, starts, ends)[0], return_inverse=True)
            place = np.minimum(np.searchsorted(keys, seen), max(len(keys) - 1, 0))
            known = keys[place] == seen if len(keys) else np.zeros(len(seen), bool)
            worth = np.where(known, pieces[place] if len(keys) else 0, 0)
            total = K.row_sums(worth[at], first)
            rest = np.flatnonzero(~known[at])
            row = np.searchsorted(first, rest, "right") - 1
            pair, times = np.unique(row * max(len(seen), 1) + at[rest], return_counts=True)
            begin = np.searchsorted(pair // max(len(seen), 1), np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(offsets)),
                    pa.array(total.astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(begin), pa.array(seen[pair % max(len(seen), 1)].view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(begin), pa.array(times.astype(np.int64))),
                ],
                ["doc_id", "n_bytes", "n_head", "keys", "times"],
            )

    return run


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; `path` names the tokenizer's file on every machine."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    vocab = stage(vocabulary(docs, path), "token-vocabulary")
    keys, pieces, cutoff = _head(vocab)
    head = spark.sparkContext.broadcast((keys, pieces))
    scanned = docs.mapInArrow(_per_document(head), "doc_id long, n_bytes long, n_head long, keys array<long>, times array<long>")
    slim = stage(scanned.withColumn("row", F.monotonically_increasing_id()), "token-rows")
    rare = vocab.filter(F.floor(F.log2("times") * 8).cast("int") < cutoff).select("key", "pieces")
    each = slim.select("row", F.explode(F.arrays_zip("keys", "times")).alias("x")).select("row", F.col("x.keys").alias("key"), F.col("x.times").alias("n"))
    tail = each.join(rare, "key").select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_bytes"), (F.col("n") * F.col("pieces")).alias("n"))
    both = slim.select("row", "doc_id", "n_bytes", F.col("n_head").alias("n")).unionByName(tail)
    out = both.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
