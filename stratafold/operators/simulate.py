"""Seeded stochastic discs and fractures. Every number is a hash of keys, so results don't depend on partitions or retries."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from ..functions import special


def fisher_normals(rows: DataFrame, seed: int, *keys: str, mean: G.Vector | None = None, kappa="kappa") -> DataFrame:
    """`rows` with a normal nx, ny, nz drawn about mean_nx, mean_ny, mean_nz with concentration kappa, turned up.

    cos t = 1 + ln(u + (1 - u) exp(-2 kappa)) / kappa; kappa 0 is uniform on the hemisphere.
    """
    m = mean or G.vector("mean_nx", "mean_ny", "mean_nz")
    u, v = G.uniform(seed, *keys, 1), G.uniform(seed, *keys, 2)
    k = G.col(kappa) if not isinstance(kappa, (int, float)) else F.lit(float(kappa))
    safe = F.greatest(k, F.lit(1e-9))
    w = F.when(k <= 1e-9, 1 - 2 * u).otherwise(1 + F.log(F.greatest(u + (1 - u) * F.exp(-2 * safe), F.lit(1e-300))) / safe)
    w = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), w))
    s, turn = F.sqrt(1 - w * w), v * F.lit(2 * math.pi)
    a, b = G.basis(m)
    n = G.plus(G.scaled(m, w), G.plus(G.scaled(a, s * F.cos(turn)), G.scaled(b, s * F.sin(turn))))
    return rows.withColumns(dict(zip(("nx", "ny", "nz"), G.upper(n), strict=True)))


def radius(law: str, low: float, high: float, u: Column, exponent: float = 2.0, rate: float = 1.0) -> Column:
    """Radius of a truncated law by inverse distribution function, natively."""
    if law == "constant":
        return F.lit(float(low))
    if law == "uniform":
        return F.lit(float(low)) + u * float(high - low)
    if law == "power":
        a, b = low**-exponent, high**-exponent
        return F.pow(F.lit(a) - u * (a - b), -1.0 / exponent)
    if law == "exponential":
        return F.lit(float(low)) - F.log(1 - u * (1 - math.exp(-rate * (high - low)))) / rate
    raise ValueError(f"unknown size law {law!r}")


@F.pandas_udf(T.LongType())
def poisson_count(mean: pd.Series, key: pd.Series) -> pd.Series:
    """Poisson numbers, each from a generator seeded by the row's key."""
    return pd.Series([int(np.random.default_rng(abs(int(k))).poisson(max(float(m), 0.0))) for m, k in zip(mean, key, strict=True)], dtype="int64")


def legacy_network(spark: SparkSession, sets: list[dict], low: tuple, high: tuple, seed: int, realization: int = 0) -> DataFrame:
    """Uniform discs in a box: for each set N = max(1, round(p32 * V / (pi E[R^2]))). Sets are dicts set_id, p32, law, low, high, mean_dip_direction, mean_dip, kappa."""
    volume = math.prod(b - a for a, b in zip(low, high, strict=True))
    out = None
    for s in sets:
        p = {k: s[k] for k in ("exponent", "rate", "mu", "sigma") if k in s}
        n = max(1, round(s["p32"] * volume / (math.pi * special.size_moment(s["law"], s["low"], s["high"], 2, **p))))
        key = seed + 1000 * realization + 10_000 * s["set_id"]
        rows = spark.range(n).withColumns({"set_id": F.lit(s["set_id"]), "realization_id": F.lit(realization), "mean_dip_direction": F.lit(float(s["mean_dip_direction"])), "mean_dip": F.lit(float(s["mean_dip"])), "kappa": F.lit(float(s["kappa"]))})
        rows = rows.withColumns(dict(zip(("mean_nx", "mean_ny", "mean_nz"), G.plane_normal("mean_dip_direction", "mean_dip"), strict=True)))
        rows = fisher_normals(rows, key, "id")
        rows = rows.withColumns({f"c{a}": F.lit(float(lo)) + G.uniform(key, "id", 10 + i) * float(hi - lo) for i, (a, lo, hi) in enumerate(zip("xyz", low, high, strict=True))})
        rows = rows.withColumn("radius", radius(s["law"], s["low"], s["high"], G.uniform(key, "id", 3), s.get("exponent", 2.0), s.get("rate", 1.0)))
        rows = rows.select("realization_id", "set_id", F.col("id").alias("number"), "cx", "cy", "cz", "nx", "ny", "nz", "radius")
        out = rows if out is None else out.unionByName(rows)
    return out


def budgets(field: DataFrame, deducted: DataFrame, volume: float) -> DataFrame:
    """Area left for stochastic discs in each cell and set: target p32 * volume less what given discs take, and the excess where they take more."""
    d = deducted.groupBy("flat", "set_id").agg(F.sum("area").alias("taken"))
    j = field.join(d, ["flat", "set_id"], "left")
    target, taken = F.col("p32") * F.lit(float(volume)), F.coalesce("taken", F.lit(0.0))
    return j.select("flat", "set_id", target.alias("target_area"), taken.alias("taken_area"), F.greatest(F.lit(0.0), target - taken).alias("remaining_area"), F.greatest(F.lit(0.0), taken - target).alias("excess_area"))


def explicit_network(cells: DataFrame, models: DataFrame, cell: tuple, seed: int, realization: int = 0) -> DataFrame:
    """Discs of cells (flat, set_id, x, y, z, remaining_area) from set models (set_id, law power, low, high, exponent, mean normal, kappa, mean_area).

    Each cell and set has its own Poisson number of mean remaining_area / mean_area; centres are uniform in the cell.
    """
    j = cells.join(F.broadcast(models), "set_id")
    key = F.xxhash64(F.lit(seed), F.lit(realization), "flat", "set_id")
    j = j.withColumn("n", poisson_count(F.col("remaining_area") / F.col("mean_area"), key)).filter("n > 0")
    each = j.withColumn("number", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    k = (seed + 1_000_003 * realization, "flat", "set_id", "number")
    each = fisher_normals(each, k[0], *k[1:])
    u = G.uniform(*k, 3)
    low, high = F.pow("low", -F.col("exponent")), F.pow("high", -F.col("exponent"))
    each = each.withColumn("radius", F.pow(low - u * (low - high), F.lit(-1.0) / F.col("exponent")))
    each = each.withColumns({f"c{a}": F.col(a) + (G.uniform(*k, 10 + i) - 0.5) * float(c) for i, (a, c) in enumerate(zip("xyz", cell, strict=True))})
    return each.select(F.lit(realization).alias("realization_id"), "flat", "set_id", "number", "cx", "cy", "cz", "nx", "ny", "nz", "radius")


def realizations(make, numbers: list[int]) -> DataFrame:
    """The union of `make(number)` over realisation numbers, as one plan."""
    out = None
    for n in numbers:
        rows = make(n)
        out = rows if out is None else out.unionByName(rows)
    return out


def conditioned(observations: DataFrame, seed: int, r: float) -> DataFrame:
    """A disc through each observation (record_id, x, y, z, nx, ny, nz), its centre moved in the plane by r * sqrt(u)."""
    one = observations.dropDuplicates(["record_id"])
    u, v = G.basis(G.vector("nx", "ny", "nz"))
    away, turn = F.lit(float(r)) * F.sqrt(G.uniform(seed, "record_id", 1)), G.uniform(seed, "record_id", 2) * F.lit(2 * math.pi)
    moved = G.plus(G.vector("x", "y", "z"), G.plus(G.scaled(u, away * F.cos(turn)), G.scaled(v, away * F.sin(turn))))
    return one.select("record_id", *[c.alias(f"c{a}") for a, c in zip("xyz", moved, strict=True)], "nx", "ny", "nz", F.lit(float(r)).alias("radius"))


def along_hole(intervals: DataFrame, seed: int, realization: int = 0) -> DataFrame:
    """Fractures of intervals (interval_index, hole_id, from_depth, to_depth, spacing_m): Poisson numbers of mean length / spacing, depths uniform in [from, to)."""
    key = F.xxhash64(F.lit(seed), F.lit(realization), "interval_index")
    n = poisson_count((F.col("to_depth") - F.col("from_depth")) / F.col("spacing_m"), key)
    each = intervals.withColumn("n", n).filter("n > 0").withColumn("number", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    depth = F.col("from_depth") + G.uniform(seed + 1_000_003 * realization, "interval_index", "number", 5) * (F.col("to_depth") - F.col("from_depth"))
    return each.select(F.lit(realization).alias("realization_id"), "interval_index", "hole_id", "number", depth.alias("measured_depth"))


def choose_component(rows: DataFrame, shares: DataFrame, seed: int, *keys: str) -> DataFrame:
    """`rows` (with interval_index) and a component drawn by the interval's shares (interval_index, component, share); none where it has no shares."""
    table = shares.groupBy("interval_index").agg(F.array_sort(F.collect_list(F.struct("component", "share"))).alias("parts"), F.sum("share").alias("whole"))
    u = G.uniform(seed, "interval_index", *keys, 6)
    start = F.struct(F.lit(0.0).alias("c"), F.lit(None).cast("int").alias("pick"))

    def step(t, p):
        c = t["c"] + p["share"]
        return F.struct(c.alias("c"), F.when(t["pick"].isNull() & (u * F.col("whole") < c), p["component"]).otherwise(t["pick"]).cast("int").alias("pick"))

    return rows.join(table, "interval_index", "left").withColumn("component", F.aggregate("parts", start, step, lambda t: t["pick"])).drop("parts", "whole")
