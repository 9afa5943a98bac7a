"""Voxel fields: grids, masks, domains, interpolation by constants, inverse distance and ordinary kriging, variograms.

Samples are many fewer than voxels in this data model. The native k-nearest join is for moderate sample sets; the kriging
and IDW kernels read voxels in Arrow batches against samples that are broadcast only up to MAX_SAMPLES.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G

#: Samples that may be sent to every task (32 bytes each).
MAX_SAMPLES = 200_000


def grid_shape(extent: tuple[float, float, float], cell: tuple[float, float, float]) -> tuple[int, int, int]:
    return tuple(max(1, int(np.ceil(e / c - 1e-9))) for e, c in zip(extent, cell, strict=True))


def voxels(spark: SparkSession, origin: tuple, cell: tuple, shape: tuple[int, int, int]) -> DataFrame:
    """flat, i, j, k and the centre x, y, z of every cell; flat = (i * ny + j) * nz + k."""
    nx, ny, nz = shape
    v = spark.range(nx * ny * nz).withColumnRenamed("id", "flat")
    i, j, k = F.expr(f"flat div {ny * nz}"), F.expr(f"(flat div {nz}) % {ny}"), F.expr(f"flat % {nz}")
    v = v.withColumns({"i": i.cast("int"), "j": j.cast("int"), "k": k.cast("int")})
    return v.withColumns({a: F.lit(float(o)) + (F.col(n) + 0.5) * float(c) for a, n, o, c in zip("xyz", "ijk", origin, cell, strict=True)})


def flat_of(x, y, z, origin: tuple, cell: tuple, shape: tuple[int, int, int]) -> Column:
    """Flat index of the cell that holds a point, NULL outside."""
    i, j, k = (G.cell_index(p, o, c, n) for p, o, c, n in zip((x, y, z), origin, cell, shape, strict=True))
    return (i.cast("long") * shape[1] + j) * shape[2] + k


def masked(rows: DataFrame, low: tuple, high: tuple, excavations: list[tuple[tuple, tuple]] = ()) -> DataFrame:
    """`rows` (x, y, z) with cell_state: OUTSIDE_MODEL, EXCAVATION or ACTIVE."""
    p = G.vector("x", "y", "z")
    out = F.lit(False)
    for a, b in excavations:
        out = out | G.inside_box(p, a, b)
    return rows.withColumn("cell_state", F.when(~G.inside_box(p, low, high), "OUTSIDE_MODEL").when(out, "EXCAVATION").otherwise("ACTIVE"))


def box_relation(box: tuple[G.Vector, G.Vector], low: tuple, high: tuple) -> Column:
    """2 if a box lies inside, 1 if it meets, 0 if it misses [low, high]."""
    (ax, ay, az), (bx, by, bz) = box
    full = G.inside_box((ax, ay, az), low, high) & G.inside_box((bx, by, bz), low, high)
    meets = F.lit(True)
    for a, b, lo, hi in zip((ax, ay, az), (bx, by, bz), low, high, strict=True):
        meets = meets & (a <= F.lit(float(hi))) & (b >= F.lit(float(lo)))
    return F.when(full, 2).when(meets, 1).otherwise(0)


def surface_elevation(points: DataFrame, triangles: DataFrame, key: str, cell: float = 50.0) -> DataFrame:
    """`key`, elevation: height of the first triangle (by tri_id) over each point. Both sides meet in square cells."""
    t = triangles.withColumns({"lx": F.least("x1", "x2", "x3"), "hx": F.greatest("x1", "x2", "x3"), "ly": F.least("y1", "y2", "y3"), "hy": F.greatest("y1", "y2", "y3")})
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    t = t.withColumn("gx", span("lx", "hx")).withColumn("gy", span("ly", "hy"))
    p = points.select(key, "x", "y").withColumns({"gx": F.floor(F.col("x") / cell), "gy": F.floor(F.col("y") / cell)})
    det = F.expr("(y2 - y3) * (x1 - x3) + (x3 - x2) * (y1 - y3)")
    j = p.join(t, ["gx", "gy"]).withColumn("det", det).filter(F.abs("det") > 1e-12)
    j = j.withColumns({"a": F.expr("((y2 - y3) * (x - x3) + (x3 - x2) * (y - y3)) / det"), "b": F.expr("((y3 - y1) * (x - x3) + (x1 - x3) * (y - y3)) / det")})
    hit = j.filter("a >= -1e-12 and b >= -1e-12 and a + b <= 1 + 1e-12")
    return hit.groupBy(key).agg(F.min_by(F.expr("a * z1 + b * z2 + (1 - a - b) * z3"), F.col("tri_id")).alias("elevation"))


def priority_domain(points: DataFrame, domains: DataFrame, key: str) -> DataFrame:
    """`key`, domain_id: the highest domain whose box (low_x.. high_z) holds the point, else 0. Domains are few."""
    inside = F.lit(True)
    for k in "xyz":
        inside = inside & (F.col(k) >= F.col(f"low_{k}")) & (F.col(k) <= F.col(f"high_{k}"))
    j = points.select(key, "x", "y", "z").join(F.broadcast(domains), inside, "left")
    return j.groupBy(key).agg(F.coalesce(F.max("domain_id"), F.lit(0)).alias("domain_id"))


def k_nearest(targets: DataFrame, samples: DataFrame, key: str, k: int, radius: float, scale: tuple = (1.0, 1.0, 1.0), same: list[str] = ()) -> DataFrame:
    """Target-sample pairs (key, sample_id, value, d) of the k nearest within a radius, ties to the lower id.

    Both sides meet in cubes of the radius's size, so only near pairs are made; `same` names columns that must agree. Of the
    samples at one place, which are equally far from every target, only the k of least id can be among the nearest.
    """
    cube = lambda c, s: F.floor(F.col(c) * F.lit(float(s)) / radius)
    t = targets.select(key, *same, *[F.col(c).alias(f"t{c}") for c in "xyz"], *[cube(c, s).alias(f"g{c}") for c, s in zip("xyz", scale, strict=True)])
    order = F.row_number().over(Window.partitionBy(*same, "x", "y", "z").orderBy("sample_id"))
    s_ = samples.select("sample_id", "value", *same, "x", "y", "z").withColumn("__order", order).filter(F.col("__order") <= k).drop("__order")
    for c, w in zip("xyz", scale, strict=True):
        s_ = s_.withColumn(f"g{c}", F.explode(F.array(*[cube(c, w) + d for d in (-1, 0, 1)])))
    # by a merge: the explosion doesn't show in the sizes by which a side is taken for small
    j = t.join(s_.hint("merge"), [*same, "gx", "gy", "gz"])
    d = F.sqrt(sum(((F.col(c) - F.col(f"t{c}")) * F.lit(float(w))) ** 2 for c, w in zip("xyz", scale, strict=True)))
    near = j.withColumn("d", d).filter(F.col("d") <= radius)
    rank = F.row_number().over(Window.partitionBy(key).orderBy("d", "sample_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select(key, "sample_id", "value", "d", "rank")


def idw(targets: DataFrame, samples: DataFrame, key: str, k: int = 8, radius: float = 50.0, power: float = 2.0, least: int = 1, same: list[str] = (), scale: tuple = (1.0, 1.0, 1.0)) -> DataFrame:
    """key, value, n_neighbours, nearest, confidence: a sample that is hit gives its value; fewer than `least` give none."""
    near = k_nearest(targets, samples, key, k, radius, scale, same)
    w = F.pow(F.greatest(F.col("d"), F.lit(1e-12)), -power)
    g = near.groupBy(key).agg(F.count("*").alias("n_neighbours"), F.min("d").alias("nearest"), F.min_by("value", F.struct("d", "sample_id")).alias("__hit"), (F.sum(w * F.col("value")) / F.sum(w)).alias("__mean"))
    value = F.when(F.col("n_neighbours") < least, None).when(F.col("nearest") <= 1e-12, F.col("__hit")).otherwise(F.col("__mean"))
    confidence = F.least(F.lit(1.0), F.col("n_neighbours") / F.lit(float(k))) / (1 + F.col("nearest"))
    return g.select(key, value.alias("value"), "n_neighbours", "nearest", F.when(value.isNotNull(), confidence).alias("confidence"))


def _nearest_rows(xyz: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances and indices of the k nearest samples of each row, ordered by (distance, index)."""
    d = np.zeros((len(at), len(xyz)))
    for c in range(3):
        d += (at[:, c, None] - xyz[None, :, c]) ** 2
    d = np.sqrt(d)
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(d, order, 1), order


def kriged(targets: DataFrame, samples: DataFrame, key: str, model: str, nugget: float, sill: float, reach: float, k: int = 8, least: int = 3, radius: float | None = None) -> DataFrame:
    """key, value, variance, n_neighbours by ordinary kriging over the k nearest samples.

    Samples at one place are averaged first. A target on a sample takes its value with variance 0; systems with the same
    neighbours are solved once for all their targets.
    """
    points = samples.groupBy("x", "y", "z").agg(F.avg("value").alias("value")).orderBy("x", "y", "z").limit(MAX_SAMPLES + 1).toPandas()
    if len(points) > MAX_SAMPLES:
        raise ValueError(f"more than {MAX_SAMPLES} places of samples: krige by blocks of the region")
    shared = targets.sparkSession.sparkContext.broadcast((points[["x", "y", "z"]].to_numpy(float), points["value"].to_numpy(float)))

    def gamma(h: np.ndarray) -> np.ndarray:
        x = h / reach
        shape = {"spherical": np.where(x >= 1, 1.0, 1.5 * x - 0.5 * x**3), "exponential": 1 - np.exp(-3 * x), "gaussian": 1 - np.exp(-3 * x * x)}[model]
        return np.where(h <= 0, 0.0, nugget + (sill - nugget) * shape)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        xyz, value = shared.value
        step = int(np.clip(2_000_000 // max(len(xyz), 1), 1, 512))  # distances held at once
        for whole in batches:
            for lo in range(0, len(whole), step):
                rows = whole.iloc[lo : lo + step]
                n = len(rows)
                out, variance, used = np.full(n, np.nan), np.full(n, np.nan), np.zeros(n, int)
                if len(xyz):
                    d, order = _nearest_rows(xyz, rows[["x", "y", "z"]].to_numpy(float), min(k, len(xyz)))
                    if radius is not None:
                        inside = d <= radius
                        order = np.where(inside, order, -1)
                        used = inside.sum(1)
                    else:
                        used = np.full(n, order.shape[1])
                    hit = (d[:, 0] <= 1e-9) & (used > 0)
                    out[hit], variance[hit] = value[order[hit, 0]], 0.0
                    for names in {tuple(o) for o in order[~hit & (used >= least)]}:
                        mine = np.flatnonzero((order == np.array(names)).all(1) & ~hit)
                        near = np.array([i for i in names if i >= 0])
                        m = len(near)
                        a = np.ones((m + 1, m + 1))
                        a[m, m] = 0
                        a[:m, :m] = gamma(np.sqrt(((xyz[near][:, None] - xyz[near][None]) ** 2).sum(2)))
                        b = np.ones((m + 1, len(mine)))
                        b[:m] = gamma(d[mine][:, :m]).T
                        try:
                            w = np.linalg.solve(a, b)
                            if not np.isfinite(w).all():
                                raise np.linalg.LinAlgError
                        except np.linalg.LinAlgError:
                            a[:m, :m] += 1e-10 * max(sill, 1.0) * np.eye(m)
                            w = np.linalg.pinv(a, hermitian=True) @ b
                        out[mine] = w[:m].T @ value[near]
                        variance[mine] = np.maximum((w * b).sum(0), 0.0)
                yield pd.DataFrame({key: rows[key].to_numpy(), "value": out, "variance": variance, "n_neighbours": used}).replace({np.nan: None})

    kind = dict(targets.dtypes)[key]
    return targets.select(key, "x", "y", "z").mapInPandas(run, f"{key} {kind}, value double, variance double, n_neighbours long")


def variogram_lags(samples: DataFrame, lags: int, furthest: float) -> DataFrame:
    """lag, n_pairs, distance, semivariance of pairs up to `furthest`, in equal right-closed lags; pairs at one place are dropped.

    Samples at one place are summed first (their number, mean and squared deviations give the sums over all their pairs);
    places meet in cubes of the furthest distance's size.
    """
    width = furthest / lags
    cube = lambda c: F.floor(F.col(c) / furthest)
    places = samples.groupBy("x", "y", "z").agg(F.count("*").alias("n"), F.count("value").alias("m"), F.coalesce(F.avg("value"), F.lit(0.0)).alias("v"), F.coalesce(F.var_pop("value"), F.lit(0.0)).alias("s"))
    a = places.select(*[F.col(c).alias(f"a{c}") for c in ("x", "y", "z", "n", "m", "v", "s")], *[cube(c).alias(f"g{c}") for c in "xyz"])
    b = places
    for c in "xyz":
        b = b.withColumn(f"g{c}", F.explode(F.array(*[cube(c) + d for d in (-1, 0, 1)])))
    # by a merge: the explosion doesn't show in the sizes by which a side is taken for small
    j = a.hint("merge").join(b, ["gx", "gy", "gz"]).filter(F.struct("ax", "ay", "az") < F.struct("x", "y", "z"))
    d = F.sqrt(sum((F.col(c) - F.col(f"a{c}")) ** 2 for c in "xyz"))
    j = j.withColumn("d", d).filter((F.col("d") > 1e-12) & (F.col("d") <= furthest))
    lag = F.greatest(F.ceil(F.col("d") / width - 1e-12) - 1, F.lit(0)).cast("int")
    pairs, known = F.col("an") * F.col("n"), F.col("am") * F.col("m")
    squares = known * (F.col("as") + F.col("s") + (F.col("av") - F.col("v")) ** 2)
    return j.groupBy(lag.alias("lag")).agg(F.sum(pairs).alias("n_pairs"), (F.sum(pairs * F.col("d")) / F.sum(pairs)).alias("distance"), F.when(F.sum(known) > 0, F.sum(squares) / F.sum(known) / 2).alias("semivariance"))


def fit_variogram(lags: DataFrame, model: str = "spherical") -> dict[str, float]:
    """nugget, sill, range by weighted least squares over the lags (a few rows): the range by search, the rest in closed form."""
    rows = [(r["distance"], r["semivariance"], r["n_pairs"]) for r in lags.collect()]
    if len(rows) < 3:
        raise ValueError("INSUFFICIENT_DATA: fewer than three lags")
    h, g, n = (np.array(x, float) for x in zip(*rows, strict=True))
    w, best = np.sqrt(n), None
    for reach in np.geomspace(max(h.min() * 0.5, 1e-9), 3 * h.max(), 200):
        x = h / reach
        s = {"spherical": np.where(x >= 1, 1.0, 1.5 * x - 0.5 * x**3), "exponential": 1 - np.exp(-3 * x), "gaussian": 1 - np.exp(-3 * x * x)}[model]
        for a in (np.stack([np.ones_like(s), s], 1), s[:, None], np.ones_like(s)[:, None]):
            c, *_ = np.linalg.lstsq(a * w[:, None] ** 0.5, g * w**0.5, rcond=None)
            if (c < 0).any():
                continue
            error = float((w * (a @ c - g) ** 2).sum())
            nugget, part = (c[0], c[1]) if len(c) == 2 else ((0.0, c[0]) if a is not None and np.allclose(a[:, 0], s) else (c[0], 0.0))
            if best is None or error < best[0] - 1e-15:
                best = (error, float(nugget), float(nugget + part), float(reach))
    return {"nugget": best[1], "sill": best[2], "range": best[3]}


def leave_one_hole_out(samples: DataFrame, value: str = "value", keys: list[str] = ()) -> DataFrame:
    """hole_id, n, observed, predicted: each hole's mean against the mean of all other holes' samples, from sums alone."""
    per = samples.groupBy(*keys, "hole_id").agg(F.count(value).alias("n"), F.sum(value).alias("s"))
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    others = F.sum("n").over(whole) - F.col("n")
    return per.select(*keys, "hole_id", "n", (F.col("s") / F.col("n")).alias("observed"), F.when(others > 0, (F.sum("s").over(whole) - F.col("s")) / others).alias("predicted"))


def constant_field(cells: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """Cells with their domain's value; without one, NO_DATA."""
    j = cells.join(F.broadcast(values), keys, "left")
    return j.withColumn("data_state", F.when(F.col("value").isNull(), "NO_DATA").when(F.col("value") == 0, "TRUE_ZERO").otherwise("MODELED_VALUE"))


def set_shares(field: DataFrame) -> DataFrame:
    """total over a cell's sets, and each set's share of it, of rows (flat, set_id, p32)."""
    total = F.sum("p32").over(Window.partitionBy("flat"))
    return field.withColumns({"p32_total": total, "set_probability": F.when(total > 0, F.col("p32") / total)})


def state_counts(cells: DataFrame) -> DataFrame:
    return cells.groupBy("cell_state").count().withColumnRenamed("count", "n_cells")


def value_at(points: DataFrame, field: DataFrame, origin: tuple, cell: tuple, shape: tuple[int, int, int], value: str = "value") -> DataFrame:
    """`points` (x, y, z) with the finite value of the cell that holds them, else NULL.

    The grid is half-open here: a point on its outer bounds has no value.
    """
    inside = F.lit(True)
    for a, o, c, n in zip("xyz", origin, cell, shape, strict=True):
        place = F.floor((F.col(a) - float(o)) / float(c))
        inside = inside & (place >= 0) & (place < n)
    flat = F.when(inside, flat_of(F.col("x"), F.col("y"), F.col("z"), origin, cell, shape))
    finite = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), F.col(value)).alias(value)
    return points.withColumn("flat", flat).join(field.select("flat", finite), "flat", "left").select(*points.columns, "flat", value)


def voxel_results(field: DataFrame, origin: tuple, cell: tuple, shape: tuple[int, int, int], area_scale: float = 1.0, p32_scale: float = 1.0) -> DataFrame:
    """Rows to export of the cells that aren't empty: i, j, k, the centre, p32, area and n_discs.

    `field` has flat, n_discs, area and p32, the last two perhaps as fixed-point numbers of the given scales; NULL is 0.
    """
    nx, ny, nz = shape
    n = F.coalesce("n_discs", F.lit(0)).cast("long")
    p32, area = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) / float(s) for c, s in (("p32", p32_scale), ("area", area_scale)))
    index = {"i": F.expr(f"flat div {ny * nz}"), "j": F.expr(f"(flat div {nz}) % {ny}"), "k": F.expr(f"flat % {nz}")}
    rows = field.filter((n != 0) | (p32 != 0)).select(*[c.cast("int").alias(a) for a, c in index.items()], n.alias("n_discs"), area.alias("area"), p32.alias("p32"))
    centre = [(F.lit(float(o)) + (F.col(a) + 0.5) * float(c)).alias(x) for x, a, o, c in zip("xyz", "ijk", origin, cell, strict=True)]
    return rows.select("i", "j", "k", *centre, "p32", "area", "n_discs")


def grid_metadata(spark: SparkSession, origin: tuple, cell: tuple, shape: tuple[int, int, int]) -> DataFrame:
    """The one row that goes with `voxel_results`: bounds, cell sizes and shape."""
    row = [*map(float, origin), *[float(o + c * n) for o, c, n in zip(origin, cell, shape, strict=True)], *map(float, cell), *map(int, shape)]
    names = [f"{a}_{end} double" for end in ("min", "max") for a in "xyz"] + [f"d{a} double" for a in "xyz"] + [f"n{a} int" for a in "xyz"]
    return spark.createDataFrame([tuple(row)], ", ".join(names))
