"""Drillholes: trajectories by minimum curvature, places at depth, pieces of a hole, domains along it, model bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G


def segments(collars: DataFrame, surveys: DataFrame) -> DataFrame:
    """hole_id, start, end and the arc of each piece between stations, with its start point x0, y0, z0.

    A station at depth 0 comes from the collar if the first lies deeper; the last holds to the final depth; a hole without
    stations is straight. Start points are prefix sums of the pieces' displacements.
    """
    stations = surveys.select("hole_id", "measured_depth", "azimuth", "dip")
    first = stations.groupBy("hole_id").agg(F.min("measured_depth").alias("m"))
    top = collars.join(first, "hole_id", "left").filter(F.col("m").isNull() | (F.col("m") > 1e-6)).select("hole_id", F.lit(0.0).alias("measured_depth"), "azimuth", "dip")
    w = Window.partitionBy("hole_id").orderBy("measured_depth")
    rows = stations.unionByName(top).join(collars.select("hole_id", "collar_x", "collar_y", "collar_z", "final_depth"), "hole_id")
    following = lambda c: F.lead(c).over(w)
    rows = rows.withColumns({"start": F.col("measured_depth"), "end": F.coalesce(following("measured_depth"), F.when(F.col("measured_depth") < F.col("final_depth") - 1e-6, F.col("final_depth"))), "azimuth2": F.coalesce(following("azimuth"), "azimuth"), "dip2": F.coalesce(following("dip"), "dip")})
    rows = rows.filter(F.col("end") - F.col("start") > 1e-10)
    u, v = G.hole_direction("azimuth", "dip"), G.hole_direction("azimuth2", "dip2")
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), G.dot(u, v)))
    rows = rows.withColumns({**{f"u{k}": c for k, c in zip("xyz", u, strict=True)}, **{f"v{k}": c for k, c in zip("xyz", v, strict=True)}, "bend": F.acos(cosine)})
    moved = displacement(F.lit(1.0))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"d{k}": c for k, c in zip("xyz", moved, strict=True)})
    starts = {f"{k}0": F.col(f"collar_{k}") + F.coalesce(F.sum(f"d{k}").over(before), F.lit(0.0)) for k in "xyz"}
    return rows.withColumns(starts).select("hole_id", "start", "end", "ux", "uy", "uz", "vx", "vy", "vz", "bend", "x0", "y0", "z0", "final_depth")


def displacement(fraction: Column) -> G.Vector:
    """Displacement along a piece's circular arc at a fraction of its length."""
    u, v = G.vector("ux", "uy", "uz"), G.vector("vx", "vy", "vz")
    span, bend = F.col("end") - F.col("start"), F.col("bend")
    straight = bend < 1e-10
    safe = F.when(straight, 1.0).otherwise(bend)
    across = G.scaled(G.minus(v, G.scaled(u, F.cos(safe))), F.lit(1.0) / F.sin(safe))
    arc = G.scaled(G.plus(G.scaled(u, F.sin(fraction * safe)), G.scaled(across, F.lit(1.0) - F.cos(fraction * safe))), span / safe)
    return tuple(F.when(straight, a * fraction * span).otherwise(b) for a, b in zip(u, arc, strict=True))


def trajectory(collars: DataFrame, surveys: DataFrame, step: float = 1.0) -> DataFrame:
    """hole_id, idx, measured_depth, x, y, z: points along each hole, each piece in ceil(length / step) equal parts."""
    pieces = segments(collars, surveys)
    n = F.greatest(F.lit(1), F.ceil((F.col("end") - F.col("start")) / step)).cast("int")
    first = F.when(F.col("start") <= 1e-6, 0).otherwise(1)
    each = pieces.withColumn("n", n).withColumn("k", F.explode(F.sequence(first, F.col("n"))))
    fraction = F.col("k") / F.col("n")
    d = displacement(fraction)
    points = each.select("hole_id", (F.col("start") + fraction * (F.col("end") - F.col("start"))).alias("measured_depth"), *[(F.col(f"{k}0") + c).alias(k) for k, c in zip("xyz", d, strict=True)])
    return points.withColumn("idx", F.row_number().over(Window.partitionBy("hole_id").orderBy("measured_depth")) - 1)


def tangential(collars: DataFrame, surveys: DataFrame) -> DataFrame:
    """hole_id, measured_depth, x, y, z at the pieces' ends, each piece straight along its first station."""
    pieces = segments(collars, surveys)
    through = Window.partitionBy("hole_id").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    moved = {k: F.sum(F.col(f"u{k}") * (F.col("end") - F.col("start"))).over(through) for k in "xyz"}
    first = {k: F.first(f"{k}0").over(through) for k in "xyz"}
    return pieces.select("hole_id", F.col("end").alias("measured_depth"), *[(first[k] + moved[k]).alias(k) for k in "xyz"])


def at_depth(rows: DataFrame, collars: DataFrame, surveys: DataFrame, depth: str = "depth") -> DataFrame:
    """`rows` (with hole_id) placed at their depth on the arcs: x, y, z; depths are clamped to the hole."""
    pieces = segments(collars, surveys)
    # rows meet the one piece that holds their depth; a hole has few pieces, so the join is on hole_id with a residual
    d = F.greatest(F.lit(0.0), F.least(F.col(depth), F.col("final_depth")))
    j = rows.join(pieces, "hole_id").filter((d >= F.col("start")) & ((d < F.col("end")) | ((d >= F.col("final_depth")) & (F.col("end") >= F.col("final_depth")))))
    moved = displacement((d - F.col("start")) / (F.col("end") - F.col("start")))
    return j.select(*rows.columns, *[(F.col(f"{k}0") + c).alias(k) for k, c in zip("xyz", moved, strict=True)])


def nearest_vertex(rows: DataFrame, points: DataFrame, key: list[str], depth: str = "depth") -> DataFrame:
    """`rows` at the trajectory point nearest in depth (ties: the earlier), found through buckets of one metre."""
    spread = rows.withColumn("__b", F.explode(F.array(*[F.floor(F.col(depth)) + k for k in (-1, 0, 1)])))
    p = points.withColumn("__b", F.floor("measured_depth"))
    near = spread.join(p, ["hole_id", "__b"]).groupBy("hole_id", *key, depth).agg(F.min_by(F.struct("idx", "x", "y", "z"), F.struct(F.abs(F.col("measured_depth") - F.col(depth)), "idx")).alias("p"))
    return near.select("hole_id", *key, depth, "p.idx", "p.x", "p.y", "p.z")


def direction_pieces(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """For intervals (hole_id, from_depth, to_depth): unit directions dx, dy, dz and lengths of the polyline's pieces inside."""
    w = Window.partitionBy("hole_id").orderBy("idx")
    lead = {f"{c}2": F.lead(c).over(w) for c in ("measured_depth", "x", "y", "z")}
    legs = points.withColumns(lead).filter(F.col("measured_depth2").isNotNull())
    j = legs.join(intervals.select("hole_id", "from_depth", "to_depth").distinct(), "hole_id").filter((F.col("measured_depth") < F.col("to_depth")) & (F.col("measured_depth2") > F.col("from_depth")))
    whole = F.col("measured_depth2") - F.col("measured_depth")
    part = (F.least("to_depth", "measured_depth2") - F.greatest("from_depth", "measured_depth")) / whole
    delta = tuple(F.col(f"{k}2") - F.col(k) for k in "xyz")
    size = G.length(delta)
    out = j.select("hole_id", "from_depth", "to_depth", F.col("idx").alias("leg"), (size * part).alias("length"), *[(c / size).alias(f"d{k}") for k, c in zip("xyz", delta, strict=True)])
    return out.filter("length > 1e-12")


def domain_at_depth(rows: DataFrame, domains: DataFrame, depth: str = "depth") -> DataFrame:
    """`rows` with domain_id: from <= depth < to; the hole's last interval includes its end; the first in order wins."""
    last = domains.withColumn("last", F.max("to_depth").over(Window.partitionBy("hole_id")))
    d = last.select(F.col("hole_id").alias("__h"), F.col("from_depth").alias("__f"), F.col("to_depth").alias("__t"), F.col("domain_id").alias("__d"), "last")
    inside = (F.col(depth) >= F.col("__f")) & ((F.col(depth) < F.col("__t")) | ((F.col(depth) == F.col("__t")) & (F.col("__t") == F.col("last"))))
    tagged = rows.withColumn("__row", F.monotonically_increasing_id())
    hit = tagged.join(d, (F.col("hole_id") == F.col("__h")) & inside, "left")
    kept = hit.withColumn("__n", F.row_number().over(Window.partitionBy("__row").orderBy("__f", "__t")))
    return kept.filter("__n = 1").select(*rows.columns, F.col("__d").alias("domain_id"))


def fixed_ranges(collars: DataFrame, domains: DataFrame | None, size: float = 10.0) -> DataFrame:
    """hole_id, from_depth, to_depth, is_last: equal intervals, cut again at domain bounds, the last one shorter."""
    marks = F.concat(F.transform(F.sequence(F.lit(0), F.ceil(F.col("final_depth") / size).cast("int") - 1), lambda i: i * F.lit(size)), F.array("final_depth"))
    cuts = collars.select("hole_id", "final_depth", F.explode(marks).alias("cut"))
    if domains is not None:
        more = domains.select("hole_id", F.explode(F.array("from_depth", "to_depth")).alias("cut")).join(collars.select("hole_id", "final_depth"), "hole_id")
        cuts = cuts.unionByName(more.filter((F.col("cut") > 0) & (F.col("cut") < F.col("final_depth"))).select("hole_id", "final_depth", "cut"))
    w = Window.partitionBy("hole_id").orderBy("cut")
    out = cuts.distinct().withColumn("to_depth", F.lead("cut").over(w)).filter("to_depth is not null")
    return out.select("hole_id", F.col("cut").alias("from_depth"), "to_depth", (F.col("to_depth") == F.col("final_depth")).alias("is_last"))


def split_by_domain(intervals: DataFrame, domains: DataFrame, ident: str, fallback: DataFrame | None = None) -> DataFrame:
    """Sub-intervals with a status: assigned, overlap_conflict, collar_fallback or unassigned."""
    j = intervals.select(ident, "hole_id", "from_depth", "to_depth")
    inner = j.join(domains.select("hole_id", F.explode(F.array("from_depth", "to_depth")).alias("cut")), "hole_id").filter((F.col("cut") > F.col("from_depth")) & (F.col("cut") < F.col("to_depth")))
    cuts = j.select("*", F.explode(F.array("from_depth", "to_depth")).alias("cut")).unionByName(inner.select(*j.columns, "cut")).distinct()
    w = Window.partitionBy(ident, "hole_id").orderBy("cut")
    parts = cuts.withColumn("end", F.lead("cut").over(w)).filter(F.col("end") > F.col("cut")).select(ident, "hole_id", F.col("cut").alias("sub_from"), F.col("end").alias("sub_to"))
    d = domains.select(F.col("hole_id").alias("__h"), F.col("from_depth").alias("__f"), F.col("to_depth").alias("__t"), "domain_id")
    covered = parts.join(d, (F.col("hole_id") == F.col("__h")) & (F.col("__f") < F.col("sub_to")) & (F.col("sub_from") < F.col("__t")), "left")
    out = covered.groupBy(ident, "hole_id", "sub_from", "sub_to").agg(F.count_distinct("domain_id").alias("n_domains"), F.min("domain_id").alias("domain_id"))
    status = F.when(F.col("n_domains") == 1, "assigned").when(F.col("n_domains") > 1, "overlap_conflict")
    if fallback is not None:
        out = out.join(fallback.select("hole_id", F.col("domain_id").alias("__fallback")), "hole_id", "left")
        return out.withColumn("status", F.coalesce(status, F.when(F.col("__fallback").isNotNull(), "collar_fallback"), F.lit("unassigned"))).withColumn("domain_id", F.when(F.col("n_domains") > 1, None).otherwise(F.coalesce("domain_id", "__fallback"))).drop("__fallback")
    return out.withColumn("status", F.coalesce(status, F.lit("unassigned"))).withColumn("domain_id", F.when(F.col("n_domains") > 1, None).otherwise(F.col("domain_id")))


def bounds(points: DataFrame, margin: float = 0.0) -> DataFrame:
    """One row: least and greatest x, y, z with a margin; an axis without extent gets half a metre on each side."""
    raw = points.agg(*[f(k).alias(f"{n}_{k}") for k in "xyz" for n, f in (("min", F.min), ("max", F.max))])
    flat = {k: F.when(F.col(f"max_{k}") - F.col(f"min_{k}") <= 0, 0.5).otherwise(0.0) for k in "xyz"}
    return raw.select(*[(F.col(f"min_{k}") - margin - flat[k]).alias(f"min_{k}") for k in "xyz"], *[(F.col(f"max_{k}") + margin + flat[k]).alias(f"max_{k}") for k in "xyz"])


def bounds_report(points: DataFrame, low: tuple, high: tuple) -> DataFrame:
    """One row: points outside a box, their holes, and the greatest exceedance at each face."""
    over = {f"{k}_low": F.greatest(F.lit(0.0), F.lit(float(a)) - F.col(k)) for k, a in zip("xyz", low, strict=True)} | {f"{k}_high": F.greatest(F.lit(0.0), F.col(k) - F.lit(float(b))) for k, b in zip("xyz", high, strict=True)}
    out = points.withColumns({f"__{n}": c for n, c in over.items()})
    outside = F.greatest(*[F.col(f"__{n}") for n in over]) > 0
    return out.agg(F.count_if(outside).alias("n_outside"), F.count_distinct(F.when(outside, F.col("hole_id"))).alias("n_holes"), *[F.max(f"__{n}").alias(f"over_{n}") for n in over])
