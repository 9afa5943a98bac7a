"""Toxicity: weak supervision. Many voters, a generative label model over their votes, a linear classifier on its posteriors.

Voters. Features of a text are hashes of its words (A-Z folded, ASCII marks cut off) and of their first 4 to 8 bytes, each
at the levels "once", "twice" and "four times or more". Lexicon voters hold features that are many times commoner in toxic rows of a bounded labelled sample. They vote toxic on a hit. Absence voters vote clean where a block of lexicons has
no hit. Pattern voters look at capitals, marks, digits and repetition.

Label model. Votes (toxic, clean, abstain) are emitted by a hidden label. EM estimates each voter's emission table, that is
its accuracy and coverage, and then the correlation of every two voters given the label; a voter counts for 1 / (1 + sum of
its correlations), and EM runs again with those weights. The posteriors, not the labels, train a logistic regression over
the hashed features, which scores every row.

Labels are read only for rows with crc32(doc_id as text) mod 3 other than 1; lang, source, doc_id and labels are no inputs.

Defined cases: an empty table gives no rows; a null or empty text has no features and gets the bias's score; without
labels of both classes every score is 0; a null doc_id is not held out and has no label; rows with equal doc_id are scored
each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from . import linear
from .quality import labelled_sample
from .staging import documents

#: Labelled rows that the model sees, at most: clean, toxic.
SAMPLE = (3000, 1500)
THRESHOLD = 0.7
BITS = 20
PREFIXES = (4, 5, 6, 7, 8)
#: Numbers of occurrences at which a feature has a further level.
LEVELS = (1, 2, 4)
#: Least chi-square at which the classifier uses a feature.
TELLING = 8.0
L2 = 1e-4
#: Features that voters and classifier may use, at most.
KEPT_FEATURES = 30_000
LEXICONS, BLOCKS = 24, 6
#: Least log ratio of a lexicon feature's shares of toxic and clean rows; less where the rows are too few to show it.
LEXICON_RATIO = 4.0

_word = K.SPACES.copy()
_word[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in "'-_"]] = False  # ASCII marks end a word too


_MASK = (1 << BITS) - 1


def _bases(wanted: np.ndarray) -> np.ndarray:
    """Which features are wanted at some level; False at -1."""
    every = np.arange(1 << BITS)
    return np.append(np.any([wanted[_at_level(every, level)] for level in range(len(LEVELS))], axis=0), False)


def _at_level(feature: np.ndarray, level: int) -> np.ndarray:
    """The hashed name of a feature at a level; a bijection for each level."""
    return feature * (2 * 40503 * level + 1) + level * 7919 & _MASK


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


class _Text:
    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw, self.offsets = raw, offsets
        self.starts, self.ends, self.first = K.spans(raw, offsets, _word)
        every = K.hashes(raw, self.starts, self.ends, K.FOLD, PREFIXES)
        self.features = [np.where(h == 0, -1, (h >> np.uint64(64 - BITS)).astype(np.int64)) for h in every]
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def present(self, wanted: np.ndarray | None = None, bases: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, feature at a level), sorted; only those of `wanted` (which `bases` have at some level) if given."""
        pairs = []
        for f in self.features:
            ok = f >= 0 if wanted is None else bases[f]
            pair, times = np.unique(self.row[ok] << BITS | f[ok], return_counts=True)
            for level, least in enumerate(LEVELS):
                at = pair[times >= least]
                feature = _at_level(at & _MASK, level)
                pairs.append((at >> BITS << BITS | feature) if wanted is None else (at >> BITS << BITS | feature)[wanted[feature]])
        both = np.unique(np.concatenate(pairs))
        return both >> BITS, both & _MASK

    def patterns(self) -> np.ndarray:
        """Per row: shares of capitals, of marks and of digits among the bytes, and words for each distinct word."""
        size = np.maximum(np.diff(self.offsets), 1)
        raw = self.raw
        out = [K.row_sums(x, self.offsets) / size for x in ((raw >= 65) & (raw <= 90), np.isin(raw, np.frombuffer(b"#*$%&|<>!?", np.uint8)), (raw >= 48) & (raw <= 57))]
        words = np.unique(self.row << BITS | self.features[0])
        distinct = np.bincount(words >> BITS, minlength=len(size))
        return np.stack([*out, np.diff(self.first) / np.maximum(distinct, 1)], 1)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, raw, offsets in K.pieces(batches, "text"):
        text = _Text(raw, offsets)
        row, feature = text.present()
        begin = np.searchsorted(row, np.arange(batch.num_rows + 1))
        lists = [feature[begin[i] : begin[i + 1]].astype(np.int32).tobytes() for i in range(batch.num_rows)]
        marks = [x.tobytes() for x in text.patterns().astype(np.float64)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(lists, pa.binary()), pa.array(marks, pa.binary())], ["doc_id", "label", "features", "patterns"])


def voters(rows: linear.Rows, marks: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Votes of every voter on every row: 1 toxic, 0 clean, -1 abstain. One column for each voter."""
    n = len(rows)
    size = 1 << BITS
    of = np.repeat(np.arange(n), np.diff(rows.begin))
    toxic = np.bincount(rows.index, weights=label[of], minlength=size)
    clean = np.bincount(rows.index, minlength=size) - toxic
    n1, n0 = label.sum(), n - label.sum()
    ratio = np.log((toxic + 0.5) / (n1 + 1)) - np.log((clean + 0.5) / (n0 + 1))
    least = min(LEXICON_RATIO, np.log(8.5 / (n1 + 1)) - np.log(0.5 / (n0 + 1)) - 0.01)
    lexicon = np.flatnonzero((ratio > least) & (toxic >= 4))
    lexicon = lexicon[np.lexsort((lexicon, -toxic[lexicon]))][:KEPT_FEATURES]
    group = np.full(size, -1)
    group[lexicon] = np.arange(len(lexicon)) % LEXICONS
    hit = np.zeros((n, LEXICONS), bool)
    at = group[rows.index] >= 0
    hit[of[at], group[rows.index[at]]] = True
    votes = [np.where(hit, 1, -1)]
    step = LEXICONS // BLOCKS
    votes += [np.where(hit[:, k * step : (k + 1) * step].any(1), -1, 0)[:, None] for k in range(BLOCKS)]
    votes.append(np.where(hit.sum(1) >= 2, 1, -1)[:, None])
    votes.append(np.where(hit.any(1), -1, 0)[:, None])
    for k, limit in ((0, 0.3), (1, 0.05), (2, 0.1), (3, 4.0)):
        votes.append(np.where(marks[:, k] > limit, 0, -1)[:, None])
    return np.concatenate(votes, 1)


def label_model(votes: np.ndarray, prior: float, rounds: int = 25) -> np.ndarray:
    """Posterior probability of toxic for every row, from the votes alone and the classes' prior."""
    n, m = votes.shape
    one_hot = np.stack([votes == v for v in (-1, 0, 1)], 2).astype(float)
    weight = np.ones(m)
    toxic, clean = (votes == 1).sum(1), (votes == 0).sum(1)
    q = np.clip((toxic + 2 * prior) / (toxic + 0.25 * clean + 2), 0.02, 0.98)
    for again in range(2):
        for _ in range(rounds):
            emit = [(np.einsum("i,ijv->jv", w, one_hot) + 0.5) / (w.sum() + 1.5) for w in (1 - q, q)]
            score = np.einsum("ijv,jv,j->i", one_hot, np.log(emit[1]) - np.log(emit[0]), weight)
            q = linear.sigmoid(score + np.log(prior / (1 - prior)))
        if not again:
            # what is left of a vote when its mean given the hidden label is taken away, correlated with the other votes'
            signed = votes.astype(float)
            left = np.zeros_like(signed)
            for w in (1 - q, q):
                mean = (w[:, None] * signed).sum(0) / (w.sum() + 1e-9)
                left += w[:, None] * (signed - mean)
            norm = np.sqrt((left**2).sum(0)) + 1e-9
            related = np.abs((left / norm).T @ (left / norm))
            np.fill_diagonal(related, 0)
            weight = 1 / (1 + np.where(related > 0.1, related, 0).sum(1))
    return q


def train(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = SAMPLE) -> Model | None:
    """The classifier; None without labels of both classes among the rows that are not held out."""
    sample, counts = labelled_sample(docs, labels, "toxic", per_class, ~held_out(F.col("doc_id")))
    found = sample.mapInArrow(_extract, "doc_id long, label int, features binary, patterns binary").toArrow()
    label = found.column("label").to_numpy().astype(float) if found.num_rows else np.zeros(0)
    if not 0 < label.sum() < len(label):
        return None
    order = np.argsort(found.column("doc_id").to_numpy(), kind="stable")
    label = label[order]
    lists = [np.frombuffer(x, np.int32) for x in found.column("features").to_pylist()]
    lists = [lists[i] for i in order]
    marks = np.stack([np.frombuffer(x, np.float64) for x in found.column("patterns").to_pylist()])[order]
    index = np.concatenate(lists)
    rows = linear.Rows(np.concatenate([[0], np.cumsum([len(x) for x in lists])]), index, np.ones(len(index), np.float32))
    posterior = label_model(voters(rows, marks, label), float(np.clip(label.mean(), 0.02, 0.98)))
    return classifier(rows, posterior, label, (counts[0], counts[1]))


def classifier(rows: linear.Rows, posterior: np.ndarray, label: np.ndarray, counts: tuple[int, int]) -> Model:
    """A logistic regression on the posteriors, over the features that they tell most about."""
    size, n, index = 1 << BITS, len(rows), rows.index
    of = np.repeat(np.arange(n), np.diff(rows.begin))
    seen, hot = np.bincount(index, minlength=size), np.bincount(index, weights=posterior[of], minlength=size)
    share = posterior.mean()
    expected = seen * share
    tell = np.where(seen >= 3, (hot - expected) ** 2 / (expected * (1 - share) + 0.5), 0)
    chosen = np.zeros(size, bool)
    chosen[np.argsort(-tell, kind="stable")[:KEPT_FEATURES]] = True
    chosen &= tell >= TELLING
    keep = chosen[index]
    small = linear.Rows(np.concatenate([[0], np.cumsum(np.bincount(of[keep], minlength=n))]), index[keep], np.ones(int(keep.sum()), np.float32))
    weight = (np.array(counts) / np.maximum(np.bincount(label.astype(int), minlength=2), 1))[label.astype(int)]
    w, b = linear.fit(small, posterior, weight, size, l2=L2, steps=150, rate=0.05)
    return Model(w.astype(np.float32), b)


def _scored(texts: Iterator, model: Model | None):
    wanted = None if model is None else model.weights != 0
    bases = None if model is None else _bases(wanted)
    for batch, raw, offsets in texts:
        if model is None:
            yield batch, np.zeros(batch.num_rows)
            continue
        row, feature = _Text(raw, offsets).present(wanted, bases)
        yield batch, linear.sigmoid(np.bincount(row, weights=model.weights[feature], minlength=batch.num_rows) + model.bias)


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, p in _scored(K.pieces(batches, "text"), shared.value):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, with all their columns, whose score is below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, p in _scored(K.pieces(batches, "text"), shared.value):
            yield batch.filter(pa.array(p < threshold))

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, train(docs, documents(spark, sf_dir, "labels")))
