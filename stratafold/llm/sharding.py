"""Sharding: minimax contiguous partition of ordered atomic groups.

Law `bytes`. A document's size is its text's UTF-8 bytes plus 1 (null counts as empty). Rows with equal texts form one
atomic group. Groups are ordered by a 64-bit hash of the text, but for those larger than an even share of what is left:
they leave the order, largest first, each to a shard of its own. (In the order such a group would set the capacity, and a
greedy pass would fill other shards up to it and leave the last ones empty, against the law.) The smallest capacity for
which a greedy pass over the rest needs no more than the shards left is found by binary search, and the greedy cuts for it
are the shards' bounds.

The order is never collected. The driver holds sums over segments of the key range; a segment is split further only
while a cut falls into it (see `search`), so a few passes over a slim table (key, size) give the exact capacity at any input
size, with 4096 + 16384 segments a pass at most for 8 shards. A cut is a key, so placing rows is a projection. Slots come
from cell counts and a window over small cells.

Defined cases: an empty table gives no rows; null texts count as empty ones; rows with equal doc_id each get a slot;
fewer groups than shards leave shards empty; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import documents, stage

#: Segments of a first pass, and the parts of a segment that is split, as bits of the key.
FIRST_BITS, MORE_BITS = 12, 10
#: Cells per group of rows with one key prefix, so that no group of copies is ordered in one task.
SALTS = 64
CELL_BITS = 10


@dataclass
class Segment:
    """Groups whose keys run from `low` to `high`; `shift` is the number of key bits below the level it was made at."""

    low: int
    high: int
    size: int
    shift: int

    @property
    def atomic(self) -> bool:
        return self.low == self.high


def greedy(sizes: list[int], capacity: int) -> list[int]:
    """Indices at which a greedy pass opens a new part; every size must be at most `capacity`."""
    cuts, load = [], 0
    for i, size in enumerate(sizes):
        if load and load + size > capacity:
            cuts.append(i)
            load = 0
        load += size
    return cuts


def smallest_capacity(sizes: list[int], parts: int) -> int:
    """The least capacity for which `greedy` makes `parts` parts at most."""
    if not sizes:
        return 0
    low, high = max(max(sizes), -(-sum(sizes) // parts)), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        if len(greedy(sizes, middle)) < parts:
            high = middle
        else:
            low = middle + 1
    return low


def relaxed(segments: list[Segment], capacity: int) -> tuple[list[int], list[int]]:
    """A greedy pass that may cut a segment of several groups anywhere: the indices that open a new part, and those cut inside.

    No true pass reaches further with `capacity`, so a capacity whose relaxed parts are too many is too small.
    """
    cuts, torn, load = [], [], 0
    for i, s in enumerate(segments):
        size = s.size
        if load + size > capacity:
            if s.atomic:
                if load:
                    cuts.append(i)
                load = 0
            else:
                size -= capacity - load
                full = -(-size // capacity)  # parts opened inside this segment
                (torn if capacity > load else cuts).append(i)
                torn += [i] * (full - 1)
                load, size = 0, size - (full - 1) * capacity
        load += size
    return cuts, torn


def lower_capacity(segments: list[Segment], parts: int) -> int:
    """The least capacity for which `relaxed` makes `parts` parts at most; no true capacity is less."""
    total = sum(s.size for s in segments)
    low, high = max(-(-total // parts), max((s.size for s in segments if s.atomic), default=0)), max(total, 1)
    while low < high:
        middle = (low + high) // 2
        if sum(map(len, relaxed(segments, middle))) < parts:
            high = middle
        else:
            low = middle + 1
    return low


def _segments(slim: DataFrame, ranges: list[tuple[int, int]], shift: int) -> list[Segment]:
    """Sums over the parts of `ranges` (all keys if empty) with equal bits above `shift`; their number is bounded by the level."""
    rows = slim
    if ranges:
        rows = slim.filter(" or ".join(f"key between {low} and {high}" for low, high in ranges))
    found = rows.groupBy(F.shiftright("key", shift).alias("part")).agg(F.sum("size").alias("size"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
    return [Segment(r["low"], r["high"], r["size"], shift) for r in found]


def _split(count: Callable[[list[tuple[int, int]], int], list[Segment]], segments: list[Segment], wanted: list[Segment]) -> list[Segment]:
    """`segments` with each of `wanted` replaced by its parts one level down."""
    chosen = {s.low for s in wanted}
    out = [s for s in segments if s.low not in chosen]
    for shift in sorted({s.shift for s in wanted}):
        out += count([(s.low, s.high) for s in wanted if s.shift == shift], max(0, shift - MORE_BITS))
    return sorted(out, key=lambda s: s.low)


def search(count: Callable[[list[tuple[int, int]], int], list[Segment]], parts: int) -> tuple[list[int], list[int]]:
    """Keys of the groups that get a part of their own, and the first keys of the other parts but the first.

    `count(ranges, shift)` sums the groups of key ranges by their bits above `shift`. The capacity is bounded from below by a
    relaxed pass, which may cut segments anywhere. Where its cuts fall between segments they are true cuts, and the bound is
    the answer. Else only the segments that it cuts (and those that a pass over whole segments cuts for its own capacity,
    the upper bound) are split: 2 * (parts - 1) at most, however the groups' sizes are spread.
    """
    segments = sorted(count([], 64 - FIRST_BITS), key=lambda s: s.low)
    alone: list[int] = []
    while segments:
        left = parts - len(alone)
        if left <= 1:
            return alone, []
        share = sum(s.size for s in segments) / left
        large = [s for s in segments if s.size > share]
        if own := [s for s in large if s.atomic]:
            most = max(own, key=lambda s: s.size)
            alone.append(most.low)
            segments.remove(most)
            continue
        wanted = [s for s in large if not s.atomic]
        if not wanted:
            low = lower_capacity(segments, left)
            cuts, torn = relaxed(segments, low)
            if not torn:
                return alone, [segments[i].low for i in cuts]
            high = smallest_capacity([s.size for s in segments], left)
            wanted = [segments[i] for i in sorted({*torn, *relaxed(segments, high)[1]})]
        segments = _split(count, segments, wanted)
    return alone, []


def plan(slim: DataFrame, parts: int) -> tuple[list[int], list[int]]:
    """`search` over the rows of `slim` (key, size); a pass brings (2 * parts) << MORE_BITS segments to the driver at most."""
    return search(lambda ranges, shift: _segments(slim, ranges, shift), parts)


def assign(docs: DataFrame, shards: int = 8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of `docs`."""
    content = F.coalesce(F.col(text), F.lit(""))
    slim = stage(docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(content).alias("key"), (F.octet_length(content) + F.lit(1)).cast("long").alias("size"), F.crc32(F.encode(content, "UTF-8")).cast("long").alias("text_crc32")), "shard-slim")
    alone, cuts = plan(slim.select("key", "size"), shards)
    placed = slim.withColumn("shard", _shard(alone, cuts)).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    placed = placed.withColumn("part", F.shiftright("key", 64 - CELL_BITS))
    cell = ["shard", "part", "salt"]
    # a row for each cell, SALTS << CELL_BITS at most beside the shards' own bounds
    before = Window.partitionBy("shard").orderBy("part", "salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(*cell).agg(F.count("*").alias("rows")).select(*cell, F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(*cell).orderBy("key", "doc_id", "size")
    slots = placed.join(offsets, cell).withColumn("slot", (F.col("offset") + F.row_number().over(inside) - 1).cast("long"))
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _shard(alone: list[int], cuts: list[int]) -> Column:
    key = F.col("key")
    rest = F.lit(len(alone))
    for cut in cuts:
        rest = rest + F.when(key >= F.lit(cut), 1).otherwise(0)
    out = None
    for i, value in enumerate(alone):
        out = F.when(key == F.lit(value), i) if out is None else out.when(key == F.lit(value), i)
    return (rest if out is None else out.otherwise(rest)).cast("int")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(documents(spark, sf_dir))
