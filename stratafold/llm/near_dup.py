"""MinHash near-dedup: HyperMinHash sketches, banded registers, collision-corrected estimates, exact verification.

Documents are sets of 5-word shingles (A-Z folded). Linked are sets with 100 * |A and B| >= 85 * |A or B|; a component's
id is its least doc_id.

1. One pass over the texts gives a sketch of each set: REGISTERS buckets, each with the leading zeros of its least hash and
   MANTISSA bits after them. Documents with equal sets (a 128-bit fingerprint) form a class, shown by its least doc_id.
2. Empty registers borrow from others by a fixed random probing (optimal densification; a place whose probes are all empty
   borrows from the register that comes first in its own order of all); BANDS bands of ROWS registers are the buckets of
   candidates. A pair at the threshold shares none with a probability of 2e-7.
3. Every member of a bucket is compared with the bucket's least document: by the registers' estimate, from which expected
   accidental collisions are taken off, and then by the whole sets. That is linear in the bucket and joins true groups.
4. A bucket whose other members are still of several components is compared in tiles of TILE members: registers only, in
   memory, and only pairs of different components. What the estimate can't rule out is compared by the whole sets.
5. Components come from star contraction over the links (components.py).

The estimate rules a pair out only 5 standard deviations below the threshold. Copies are never expanded into pairs; no
sketch, link or component comes to the driver.

Defined cases: an empty table gives no rows; a null text, or one without words, has no shingles and links with nothing; a
text of fewer than 5 words is one shingle; rows with equal doc_id are one node; a row without doc_id takes its class's
component, or none, and always stays; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .components import stars
from .staging import discard, documents, small, stage

SHINGLE = 5
#: Links have 100 * intersection >= THRESHOLD * union.
THRESHOLD = 85
REGISTERS, MANTISSA = 512, 10
BANDS, ROWS = 48, 8
PROBES = 64
#: Standard deviations below the threshold at which an estimate rules a pair out.
MARGIN = 5.0
#: Members of a bucket that are compared in memory at once.
TILE = 1024
#: Rows of a table of document ids that may be broadcast.
SMALL_ROWS = 200_000

_probe = (K.mix(np.arange(PROBES * BANDS * ROWS, dtype=np.uint64) + np.uint64(77)) % np.uint64(REGISTERS)).astype(np.int64).reshape(PROBES, -1)
#: Each place's own order of the registers, for places whose probes are all empty.
_rank = K.mix(np.arange(BANDS * ROWS * REGISTERS, dtype=np.uint64) + np.uint64(0x5DEECE66D)).reshape(-1, REGISTERS)


def shingles(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingle hashes, sorted, and each row's first."""
    starts, ends, first = K.spans(raw, offsets, K.SPACES)
    return K.distinct(*K.windows(K.hashes(raw, starts, ends, K.FOLD)[0], first, SHINGLE))


def sketches(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Registers of each set: 0 for an empty bucket, else leading zeros + 1 and the complement of the mantissa, so that more is less."""
    n = len(begin) - 1
    row = np.repeat(np.arange(n), np.diff(begin))
    bits = REGISTERS.bit_length() - 1
    bucket = (values >> np.uint64(64 - bits)).astype(np.int64)
    rest = ((values << np.uint64(bits)) >> np.uint64(11)).astype(np.float64)  # 53 bits are exact
    fraction, exponent = np.frexp(rest)
    zeros = np.where(rest > 0, 53 - exponent, 53)
    mantissa = np.where(rest > 0, ((2 * fraction - 1) * (1 << MANTISSA)).astype(np.int64), 0)
    code = ((zeros + 1) << MANTISSA | ((1 << MANTISSA) - 1 - mantissa)).astype(np.uint16)
    out = np.zeros((n, REGISTERS), np.uint16)
    np.maximum.at(out.reshape(-1), row * REGISTERS + bucket, code)
    return out


def densified(registers: np.ndarray) -> np.ndarray:
    """The banded registers, with empty ones filled from the first bucket of their probing, or else of their order, that isn't empty."""
    width = BANDS * ROWS
    out = registers[:, :width].copy()
    row, column = np.nonzero(out == 0)
    for probe in _probe:
        if not len(row):
            break
        got = registers[row, probe[column]]
        full = got > 0
        out[row[full], column[full]] = got[full]
        row, column = row[~full], column[~full]
    cuts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1], [True]])) if len(row) else []
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        held = np.flatnonzero(registers[row[lo]])
        if len(held):
            out[row[lo], column[lo:hi]] = registers[row[lo], held[_rank[column[lo:hi][:, None], held].argmin(1)]]
    return out


def bands(registers: np.ndarray) -> np.ndarray:
    """Keys of each sketch's bands."""
    parts = densified(registers).reshape(len(registers), BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(ROWS):
        key = K.mix(key * np.uint64(31) + parts[:, :, k])
    return key


def estimated(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Which pairs of sketches may reach the threshold: sizes fit, and the corrected estimate is not MARGIN deviations below it."""
    seen = ((a | b) > 0).sum(1).astype(float)
    same = ((a == b) & (a > 0)).sum(1)
    ratio = np.minimum(n_a, n_b) / np.maximum(np.maximum(n_a, n_b), 1)
    by_chance = seen * 0.169919487 * 4 * ratio / (1 + ratio) ** 2 / (1 << MANTISSA)
    jaccard = (same - by_chance) / np.maximum(seen, 1)
    t = THRESHOLD / 100
    hidden = np.clip(1 - seen / np.maximum((n_a + n_b) / (1 + t), 1), 0, 1)
    slack = MARGIN * np.sqrt(t * (1 - t) / np.maximum(seen, 1) * hidden) + 2 / np.maximum(seen, 1)
    return (ratio * 100 >= THRESHOLD - 1e-9) & (jaccard >= t - slack)


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, raw, offsets in K.pieces(batches, "text"):
        values, begin = shingles(raw, offsets)
        n = np.diff(begin)
        prints = []
        for salt in (0x1234567, 0x89ABCDEF01):
            total = np.zeros(len(values) + 1, np.uint64)
            np.cumsum(K.mix(values ^ np.uint64(salt)), out=total[1:])
            prints.append((total[begin[1:]] - total[begin[:-1]]).view(np.int64))
        flat = sketches(values, begin)
        blobs = [flat[i].tobytes() if n[i] else None for i in range(len(n))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(prints[0]), pa.array(prints[1]), pa.array(blobs, pa.binary())], ["doc_id", "n", "print_a", "print_b", "registers"])


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.uint16).reshape(len(values), REGISTERS)


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 2000):
            part = batch.slice(i, 2000)
            keys = bands(_matrix(part.column("registers")))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(part.column("doc_id").to_numpy(zero_copy_only=False), BANDS))], ["key", "doc_id"])


def _estimate_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 2000):
            part = batch.slice(i, 2000)
            ok = estimated(_matrix(part.column("ra")), _matrix(part.column("rb")), part.column("na").to_numpy(), part.column("nb").to_numpy())
            yield part.select(["a", "b"]).filter(pa.array(ok))


def _verify_rows(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offsets in K.pieces(batches, "ta", 2 << 20):
            va, ba = shingles(raw, offsets)
            vb, bb = shingles(*K.text_column(batch, "tb"))
            na, nb = np.diff(ba), np.diff(bb)
            row = np.concatenate([np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)])
            value = np.concatenate([va, vb])
            order = np.lexsort((value, row))
            row, value = row[order], value[order]
            twice = (value[1:] == value[:-1]) & (row[1:] == row[:-1])
            both = np.bincount(row[1:][twice], minlength=len(na))
            ok = (both > 0) & (100 * both >= threshold * (na + nb - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, from batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        code = np.stack([batch.column(k).to_numpy() for k in keys], 1)
        cuts = np.concatenate([[0], np.flatnonzero((code[1:] != code[:-1]).any(1)) + 1, [batch.num_rows]])
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            name = tuple(code[lo])
            if held and name != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = name
    if held:
        yield pa.Table.from_batches(held)


def _tile_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of different components whose estimates may reach the threshold, each at the first band that it shares only."""
    for group in _groups(batches, ["key", "low", "high"]):
        group = group.combine_chunks()
        ids, label, n, side = (group.column(c).to_numpy() for c in ("doc_id", "component", "n", "side"))
        if label.min() == label.max():
            continue
        registers = _matrix(group.column("registers"))
        if group.column("low")[0].as_py() == group.column("high")[0].as_py():
            order = np.argsort(n, kind="stable")
            left = right = order
            inner = True
        else:
            left, right, inner = np.flatnonzero(side == 0), np.flatnonzero(side == 1), False
        key = np.int64(group.column("key")[0].as_py()).view(np.uint64)
        found = []
        for x, i in enumerate(left):
            j = right[x + 1 :] if inner else right
            j = j[(label[j] != label[i]) & (100 * np.minimum(n[j], n[i]) >= THRESHOLD * np.maximum(n[j], n[i]))]
            if len(j):
                j = j[estimated(registers[i][None, :], registers[j], n[i], n[j])]
                found.append(np.stack([np.full(len(j), i), j], 1))
        if not found:
            continue
        pairs = np.concatenate(found)
        if not len(pairs):
            continue
        used, at = np.unique(pairs, return_inverse=True)
        own = bands(registers[used])
        at = at.reshape(-1, 2)
        for lo in range(0, len(pairs), 20_000):
            a, b = own[at[lo : lo + 20_000, 0]], own[at[lo : lo + 20_000, 1]]
            first = (a == b).argmax(1)
            mine = a[np.arange(len(a)), first] == key
            p = pairs[lo : lo + 20_000][mine]
            yield pa.RecordBatch.from_arrays([pa.array(ids[p[:, 0]]), pa.array(ids[p[:, 1]])], ["a", "b"])


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are linked. Texts are read again, for the documents in pairs only."""
    wanted = small(stage(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "near-wanted"), SMALL_ROWS)
    texts = docs.join(wanted, "doc_id", "left_semi")
    one = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    two = one.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    return two.select("a", "b", "ta", "tb").mapInArrow(_verify_rows(THRESHOLD), "a long, b long")


def classes_and_components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n, print_a, print_b) of every document, and (print_a, print_b, component) of every class. Both staged."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = stage(docs.mapInArrow(_sketch_rows, "doc_id long, n long, print_a long, print_b long, registers binary"), "near-sketch")
    slim = stage(sketched.drop("registers"), "near-slim")
    classes = stage(slim.filter("n > 0 and doc_id is not null").groupBy("print_a", "print_b").agg(F.min("doc_id").alias("doc_id")), "near-class")
    shown = sketched.filter("n > 0").select("doc_id", "n", "registers").join(classes.select("doc_id").distinct(), "doc_id", "left_semi")
    reps = stage(shown, "near-reps")
    discard(sketched)

    keys = stage(reps.select("doc_id", "registers").mapInArrow(_band_rows, "key long, doc_id long"), "near-bands")
    buckets = keys.groupBy("key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last"), F.count("*").alias("members")).filter("hub <> last")
    members = stage(keys.join(buckets.drop("last"), "key").filter("doc_id <> hub"), "near-members")
    discard(keys)

    pairs = members.select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
    side = lambda x: reps.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("registers").alias(f"r{x}"))
    close = stage(pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "na", "nb", "ra", "rb").mapInArrow(_estimate_rows, "a long, b long"), "near-close")
    links = stage(_verified(docs, close), "near-links")
    joined = stars(links)

    label = joined.select(F.col("node").alias("doc_id"), "component")
    labelled = stage(members.join(label, "doc_id", "left").select("key", "doc_id", "members", F.coalesce("component", "doc_id").alias("component")), "near-labelled")
    several = labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("key")
    open_ = labelled.join(several, "key").withColumn("tiles", F.ceil(F.col("members") / TILE).cast("int"))
    mine = open_.withColumn("tile", F.pmod(F.xxhash64("doc_id"), "tiles").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = mine.select("key", "doc_id", "component", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), (F.col("tile") > F.col("other")).cast("int").alias("side"))
    filled = dealt.join(reps, "doc_id").select("key", "low", "high", "side", "doc_id", "component", "n", "registers")
    spread = filled.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    rest = stage(spread.mapInArrow(_tile_rows, "a long, b long"), "near-rest")
    more = stage(_verified(docs, rest), "near-more")

    final = stars(more.unionByName(joined.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    named = classes.join(final.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    out = stage(named.select("print_a", "print_b", F.coalesce("component", "doc_id").alias("component")), "near-components")
    discard(reps, members, close, links, labelled, rest, more, joined, final, classes)
    return slim, out


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of `docs`."""
    slim, named = classes_and_components(docs)
    out = slim.join(named, ["print_a", "print_b"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, that their components keep."""
    gone = small(stage(report(docs).filter("not kept").select(F.col("doc_id").alias("__id")).distinct(), "near-gone"), SMALL_ROWS)
    return docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")), "left_anti")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(documents(spark, sf_dir))
