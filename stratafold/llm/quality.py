"""Quality rules: base statistics, and a calibrated logistic regression over hashed word and character n-grams.

The model is trained here from a bounded sample of labelled rows: SAMPLE of each class, the first by a hash of doc_id.
Three quarters are fitted, one quarter calibrates (Platt), weighted back to the classes' true shares. All rows are scored
in Arrow batches over their whole texts against the fixed threshold THRESHOLD.

Features, as shares of their kind in a text: hashed words and word pairs, and hashed 4-character runs.

Defined cases: an empty table gives no rows; a null or empty text has no words and fails the base rules; without labels
of both classes every text that passes the base rules is kept (score 1); rows with equal doc_id are scored each; rows
without a doc_id are scored too; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from . import linear
from .staging import documents

#: Labelled rows that the model sees, at most: of quality 0, of quality 1.
SAMPLE = (1500, 1500)
THRESHOLD = 0.5
MIN_WORDS = 50
#: Hashed features of each kind (words and pairs; characters).
WORD_BITS, CHAR_BITS = 16, 15
SIZE = (1 << WORD_BITS) + (1 << CHAR_BITS)
#: Scale of a kind's shares.
SCALE = 30.0
SYMBOLS = "#*$%&|<>"

_symbol = np.zeros(256, bool)
_symbol[list(SYMBOLS.encode())] = True
_not_newline = np.ones(256, bool)
_not_newline[10] = False


@dataclass
class Model:
    words: np.ndarray
    chars: np.ndarray
    bias: float
    slope: float
    offset: float


class _Text:
    """The words and features of one slice of rows."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw, self.offsets = raw, offsets
        self.starts, self.ends, self.first = K.spans(raw, offsets, K.SPACES)
        self.hash = K.hashes(raw, self.starts, self.ends)[0]
        self.n_words = np.diff(self.first)

    def word_features(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashed words and pairs, and each row's first: the pair that a row's last word would begin is left out by value -1."""
        h = self.hash
        pair = np.empty(len(h), np.int64)
        if len(h):
            joined = K.mix(h[:-1] * np.uint64(3) + h[1:])
            pair[:-1] = (joined >> np.uint64(64 - WORD_BITS)).astype(np.int64)
            last = self.first[1:][self.n_words > 0] - 1
            pair[last] = -1
        return (h >> np.uint64(64 - WORD_BITS)).astype(np.int64), pair

    def char_features(self) -> np.ndarray:
        """Hashed runs of 4 code points at each code point; -1 where a row has fewer left. Sets each row's first code point."""
        points = np.frombuffer(self.raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.uint64)
        self.char_offsets = np.concatenate([[0], np.cumsum((self.raw & 0xC0) != 0x80)])[self.offsets]
        out = np.full(len(points), -1, np.int64)
        if len(points) > 3:
            four = points[:-3].copy()
            for k in (1, 2, 3):
                four *= np.uint64(0x9E3779B97F4A7C15)
                four += points[k : len(points) - 3 + k]
            out[:-3] = (four * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - CHAR_BITS)).astype(np.int64)
        for k in (1, 2, 3):
            at = self.char_offsets[1:] - k
            out[at[at >= self.char_offsets[:-1]]] = -1
        return out

    def rows(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each row: its features and their scaled shares."""
        uni, pair = self.word_features()
        char = self.char_features()
        index, value = [], []
        for i in range(len(self.offsets) - 1):
            w = np.concatenate([uni[self.first[i] : self.first[i + 1]], pair[self.first[i] : self.first[i + 1]]])
            c = char[self.char_offsets[i] : self.char_offsets[i + 1]]
            wi, wn = np.unique(w[w >= 0], return_counts=True)
            ci, cn = np.unique(c[c >= 0], return_counts=True)
            index.append(np.concatenate([wi, ci + (1 << WORD_BITS)]).astype(np.int32))
            value.append(np.concatenate([wn / max(wn.sum(), 1), cn / max(cn.sum(), 1)]).astype(np.float32) * np.float32(SCALE))
        return index, value

    def logits(self, model: Model) -> np.ndarray:
        uni, pair = self.word_features()
        words = np.append(model.words, 0.0)  # -1 is worth nothing
        one = K.row_sums(words[uni] + words[pair], self.first)
        n = np.maximum(2 * self.n_words - (self.n_words > 0), 1)
        char = self.char_features()
        two = K.row_sums(np.append(model.chars, 0.0)[char], self.char_offsets)
        m = np.maximum(np.diff(self.char_offsets) - 3, 1)
        return SCALE * (one / n + two / m) + model.bias

    def base(self) -> dict[str, np.ndarray]:
        raw, offsets = self.raw, self.offsets
        line_start, line_end, line_first = K.spans(raw, offsets, _not_newline)
        worded = np.searchsorted(self.starts, line_end) > np.searchsorted(self.starts, line_start)
        line_row = np.searchsorted(line_first, np.arange(len(line_start)), "right") - 1
        s, e, row = line_start[worded], line_end[worded], line_row[worded]
        lines = np.bincount(row, minlength=len(offsets) - 1)
        _, once = np.unique(K.mix(K.hashes(raw, s, e)[0] + K.mix(row + 1)), return_index=True)
        distinct = np.bincount(row[once], minlength=len(offsets) - 1)
        return {
            "n_words": self.n_words,
            "word_chars": K.row_sums(K.code_points(raw, self.starts, self.ends), self.first),
            "n_symbols": K.row_sums(_symbol[raw], offsets),
            "n_dup_lines": lines - distinct,
            "n_repeat_words": K.row_sums(self._repeated(), self.first),
        }

    def _repeated(self) -> np.ndarray:
        """Words that lie in a 3-word window found twice or more in their row."""
        h = self.hash
        hit = np.zeros(len(h), bool)
        if len(h) < 3:
            return hit
        row = np.repeat(np.arange(len(self.first) - 1), self.n_words)
        whole = row[:-2] == row[2:]
        key = K.mix(K.mix(h[:-2] * np.uint64(3) + h[1:-1]) * np.uint64(5) + h[2:] + K.mix(row[:-2] + 1))
        at = np.flatnonzero(whole)
        _, back, times = np.unique(key[at], return_inverse=True, return_counts=True)
        at = at[times[back] > 1]
        for k in range(3):
            hit[at + k] = True
        return hit


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: tuple[int, int], keep=None) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, text, label of `per_class[label]` labelled documents of each class at most, and the classes' numbers of labels.

    The first by a hash of doc_id are taken, so that reruns agree; a doc_id with conflicting labels has the larger one.
    """
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    if keep is not None:
        given = given.filter(keep)
    given = given.groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["count"] for r in given.groupBy("label").count().collect()}
    parts = [given.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class[k]) for k in (0, 1)]
    sample = F.broadcast(parts[0].unionByName(parts[1]))  # sum(per_class) rows
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sample, "doc_id")
    # of rows with one doc_id the first by its text's hash, so that reruns agree
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    return found.withColumn("__n", rank).filter("__n = 1").drop("__n"), counts


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, raw, offsets in K.pieces(batches, "text"):
        index, value = _Text(raw, offsets).rows()
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([x.tobytes() for x in index], pa.binary()), pa.array([x.tobytes() for x in value], pa.binary())], ["doc_id", "label", "index", "value"])


def train(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = SAMPLE) -> Model | None:
    """The calibrated model; None without labels of both classes."""
    sample, counts = labelled_sample(docs, labels, "quality", per_class)
    found = sample.mapInArrow(_extract, "doc_id long, label int, index binary, value binary").toArrow()
    if not found.num_rows:
        return None
    order = np.argsort(found.column("doc_id").to_numpy(), kind="stable")
    y = found.column("label").to_numpy()[order].astype(float)
    index = [np.frombuffer(x, np.int32) for x in found.column("index").to_pylist()]
    value = [np.frombuffer(x, np.float32) for x in found.column("value").to_pylist()]
    index, value = [index[i] for i in order], [value[i] for i in order]
    if not 0 < y.sum() < len(y):
        return None
    rows = linear.Rows(np.concatenate([[0], np.cumsum([len(x) for x in index])]), np.concatenate(index), np.concatenate(value))
    share = np.array([counts[k] / max((y == k).sum(), 1) for k in (0, 1)])
    weight = share[y.astype(int)]
    spare = np.arange(len(y)) % 4 == 3
    if not (0 < y[spare].sum() < spare.sum() and 0 < y[~spare].sum() < (~spare).sum()):
        spare[:] = False
    fitted = np.flatnonzero(~spare)
    w, b = linear.fit(rows.take(fitted), y[fitted], np.ones(len(fitted)), SIZE)
    held = np.flatnonzero(spare) if spare.any() else fitted
    slope, offset = linear.platt(rows.take(held).dot(w) + b, y[held], weight[held])
    return Model(w[: 1 << WORD_BITS].astype(np.float32), w[1 << WORD_BITS :].astype(np.float32), b, slope, offset)


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the base statistics, base_failed, quality (calibrated probability) and kept of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offsets in K.pieces(batches, "text"):
            text = _Text(raw, offsets)
            base = text.base()
            m = shared.value
            p = np.ones(batch.num_rows) if m is None else linear.sigmoid(m.slope * text.logits(m) + m.offset)
            failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
            columns = {"doc_id": batch.column("doc_id")} | {k: pa.array(v.astype(np.int64)) for k, v in base.items()}
            columns |= {"base_failed": pa.array(failed), "quality": pa.array(p), "kept": pa.array(~failed & (p >= threshold))}
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality double, kept boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, train(docs, documents(spark, sf_dir, "labels")))
