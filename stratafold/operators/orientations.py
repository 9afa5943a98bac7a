"""Orientation statistics: Fisher means and concentrations, axial resultants, axial k-means."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G


def with_normals(rows: DataFrame) -> DataFrame:
    """Rows of full orientation with their unit normals nx, ny, nz."""
    full = rows.filter("dip_direction is not null and dip is not null")
    return full.withColumns(dict(zip(("nx", "ny", "nz"), G.plane_normal("dip_direction", "dip"), strict=True)))


def resultants(rows: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """n, and the sums sx, sy, sz of unit normals: a sum that machines can make in parts."""
    w = F.lit(1.0) if weight is None else weight
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(w).alias("weight"), *[F.sum(w * F.col(f"n{k}")).alias(f"s{k}") for k in "xyz"])


def kappa(n: Column, r: Column, method: str = "sets") -> Column:
    """Concentration from n normals with a resultant of length r.

    sets: (n-1)/(n-r), below 16 normals (n-2)/(n-r) * n/(n-1), kept in [0.1, 999]. plain: (n-1)/(n-r). best_fisher: by
    ranges of the mean resultant length.
    """
    rest = F.greatest(n - r, F.lit(1e-10))
    if method == "plain":
        return F.when(n - r < 1e-10, 1e10).otherwise((n - 1) / rest)
    if method == "best_fisher":
        m = r / n
        return F.when(m < 0.53, 2 * m + F.pow(m, 3) + 5 * F.pow(m, 5) / 6).when(m < 0.85, -0.4 + 1.39 * m + 0.43 / (1 - m)).otherwise(1 / (F.pow(m, 3) - 4 * m * m + 3 * m))
    value = F.when(n >= 16, (n - 1) / rest).otherwise((n - 2) / rest * (n / (n - 1)))
    return F.greatest(F.lit(0.1), F.least(F.lit(999.0), value))


def fisher(rows: DataFrame, keys: list[str], least: int = 3, method: str = "sets") -> DataFrame:
    """Mean dip direction and dip, and kappa, of each key with `least` full orientations or more."""
    g = resultants(with_normals(rows), keys).filter(F.col("n") >= least)
    s = G.vector("sx", "sy", "sz")
    r = G.length(s)
    direction, dip = G.orientation(s)
    return g.select(*keys, "n", r.alias("resultant"), direction.alias("mean_dip_direction"), dip.alias("mean_dip"), F.when(r < 1e-12, 1.0).otherwise(kappa(F.col("n"), r, method)).alias("kappa"))


def axial_resultant(rows: DataFrame, keys: list[str], order: str, weight: str | None = None) -> DataFrame:
    """Resultants of axes: each is turned to the side of its key's first one, then summed."""
    # the first axis by a partial aggregation, so that no key is ordered in one task
    ends = rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min_by(F.struct("nx", "ny", "nz"), order).alias("__first"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    rows = rows.join(ends, same).drop(*[f"__{k}" for k in keys])
    first = G.vector(*[F.col(f"__first.n{k}") for k in "xyz"])
    side = F.when(G.dot(first, G.vector("nx", "ny", "nz")) < 0, -1.0).otherwise(1.0)
    turned = rows.withColumn("__side", side)
    turned = turned.withColumns({f"n{k}": F.col(f"n{k}") * F.col("__side") for k in "xyz"})
    return resultants(turned, keys, F.col(weight) if weight else None)


def dip_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.filter("dip is not null").groupBy(*keys).agg(F.count("*").alias("n"), F.avg("dip").alias("mean_dip"), F.percentile("dip", F.lit(0.5)).alias("median_dip"), F.stddev_pop("dip").alias("std_dip"))


def distinct_axes(rows: DataFrame, order: str, digits: int = 9) -> DataFrame:
    """The first row of each axis, up to sign: the sign is made canonical, then equal axes meet."""
    x, y, z = (F.round(F.col(f"n{k}"), digits) for k in "xyz")
    down = (z < 0) | ((z == 0) & ((y < 0) | ((y == 0) & (x < 0))))
    key = F.struct(*[F.when(down, -c).otherwise(c) + 0.0 for c in (x, y, z)])
    return rows.groupBy(key.alias("axis")).agg(F.min_by(F.struct(*rows.columns), F.col(order)).alias("r")).select("r.*")


def assign_axes(rows: DataFrame, centers: list[tuple[float, float, float]]) -> DataFrame:
    """`rows` with cluster: the centre of least axial angle, ties to the earlier."""
    n = G.vector("nx", "ny", "nz")
    scores = F.array(*[F.struct(F.abs(G.dot(n, tuple(F.lit(float(x)) for x in c))).alias("s"), F.lit(-i).alias("i")) for i, c in enumerate(centers)])
    return rows.withColumn("cluster", -F.array_max(scores)["i"])


def axial_kmeans(rows: DataFrame, k: int, seed: int = 0, rounds: int = 30, tolerance: float = 1e-6) -> tuple[DataFrame, list[tuple[float, float, float]]]:
    """Clusters of axes (nx, ny, nz). Each round is one aggregation; only k centres come to the driver.

    Start: farthest-point picks from the k * 64 rows that a hash puts first. Clusters are numbered by mean dip direction.
    """
    pool = np.array([tuple(r) for r in rows.orderBy(F.xxhash64("nx", "ny", "nz", F.lit(seed))).select("nx", "ny", "nz").limit(64 * k).collect()])
    if not len(pool):
        return rows.withColumn("cluster", F.lit(None).cast("int")), []
    centers = [pool[0]]
    while len(centers) < min(k, len(pool)):
        centers.append(pool[int(np.argmin(np.max(np.abs(pool @ np.array(centers).T), axis=1)))])
    for _ in range(rounds):
        named = assign_axes(rows, [tuple(c) for c in centers])
        c = F.element_at(F.array(*[F.struct(*[F.lit(float(x)).alias(f"c{a}") for a, x in zip("xyz", v, strict=True)]) for v in centers]), F.col("cluster") + 1)
        side = F.when(c["cx"] * F.col("nx") + c["cy"] * F.col("ny") + c["cz"] * F.col("nz") < 0, -1.0).otherwise(1.0)
        sums = {r["cluster"]: np.array([r["sx"], r["sy"], r["sz"]]) for r in named.groupBy("cluster").agg(*[F.sum(side * F.col(f"n{a}")).alias(f"s{a}") for a in "xyz"]).collect()}
        moved = [sums[i] / max(np.linalg.norm(sums[i]), 1e-12) if i in sums else centers[i] for i in range(len(centers))]
        change = max(1 - abs(float(a @ b)) for a, b in zip(centers, moved, strict=True))
        centers = moved
        if change < tolerance:
            break
    up = [c if c[2] >= 0 else -c for c in centers]
    up.sort(key=lambda c: (np.degrees(np.arctan2(-c[0], -c[1])) % 360, np.degrees(np.arccos(min(1.0, c[2])))))
    final = [tuple(float(x) for x in c) for c in up]
    return assign_axes(rows, final), final


def ranked_pairs(models: DataFrame) -> DataFrame:
    """All pairs of models (set_id, nx, ny, nz) by axial angle; models are few."""
    a = models.select(F.col("set_id").alias("a"), *[F.col(f"n{k}").alias(f"a{k}") for k in "xyz"])
    b = models.select(F.col("set_id").alias("b"), *[F.col(f"n{k}").alias(f"b{k}") for k in "xyz"])
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", G.acute_angle(G.vector("ax", "ay", "az"), G.vector("bx", "by", "bz")).alias("angle"))


def axial_summary(normals: DataFrame, by: list[str], order: str) -> DataFrame:
    """Mean axis (turned up) and resultant share of the normals of each group, all turned to the side of the first by `order`.

    The first normals are found by a partial aggregation and joined, so that no group is ordered in one task.
    """
    first = normals.groupBy(*by).agg(F.min_by(F.struct("nx", "ny", "nz"), order).alias("__first"))
    j = normals.join(first, by)
    side = F.when(sum(F.col(f"n{k}") * F.col(f"__first.n{k}") for k in "xyz") < 0, -1.0).otherwise(1.0)
    g = j.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(side * F.col(f"n{k}")).alias(f"s{k}") for k in "xyz"])
    length = F.sqrt(sum(F.col(f"s{k}") * F.col(f"s{k}") for k in "xyz"))
    up = F.when(F.col("sz") < 0, -1.0).otherwise(1.0)
    return g.select(*by, "n", *[F.when(length > 1e-12, up * F.col(f"s{k}") / length).alias(f"mean_n{k}") for k in "xyz"], (length / F.col("n")).alias("resultant"))


def imported_sets(rows: DataFrame, roles: DataFrame, least: int = 3) -> DataFrame:
    """Counts of each imported set by the roles of its holes, and the orientation of the set in calibration holes.

    Holes without a role calibrate; rows without a set are left out; a set seen in validation only has zeros. Fewer than
    `least` full orientations give no mean and no kappa.
    """
    validates = F.coalesce(F.col("role") == "validation", F.lit(False))
    rows = rows.filter("set_id is not null").join(roles.select("hole_id", "role"), "hole_id", "left").withColumn("validates", validates)
    full = F.col("dip_direction").isNotNull()
    counts = []
    for name, mine in (("calibration", ~F.col("validates")), ("validation", F.col("validates"))):
        counts += [F.count_if(mine).alias(f"n_{name}"), F.count_if(mine & full).alias(f"full_{name}"), F.count_if(mine & ~full).alias(f"dip_only_{name}")]
    mean = fisher(rows.filter(~F.col("validates")), ["set_id"], least).drop("n", "resultant")
    return rows.groupBy("set_id").agg(*counts).join(mean, "set_id", "left")
