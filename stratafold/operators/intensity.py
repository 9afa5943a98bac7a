"""Fracture intensity: P10 along holes, P32 by Poisson likelihood, holdout roles and validation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from ..functions import special
from . import holes


def p10_intervals(fractures: DataFrame, collars: DataFrame, size: float = 10.0, set_ids: list[int] | None = None) -> DataFrame:
    """A row for each hole, interval and set, zeros too: counts, P10 and its state.

    Intervals are half-open; a hole's last one holds its end. Fractures find their interval by arithmetic, so the counts are
    one aggregation, and the scaffold of all intervals and sets is joined to them.
    """
    sets = fractures.sparkSession.createDataFrame([(int(s),) for s in set_ids], "set_id int") if set_ids else fractures.select(F.col("set_id").cast("int").alias("set_id")).filter("set_id is not null").distinct()
    ranges = holes.fixed_ranges(collars, None, size).withColumn("k", F.floor(F.col("from_depth") / size).cast("int"))
    inside = fractures.join(collars.select("hole_id", "final_depth"), "hole_id").filter((F.col("depth") >= 0) & (F.col("depth") <= F.col("final_depth")))
    last = F.ceil(F.col("final_depth") / size).cast("int") - 1
    place = F.least(F.floor(F.col("depth") / size).cast("int"), last)
    full = F.col("dip_direction").isNotNull()
    counts = inside.groupBy("hole_id", place.alias("k"), F.col("set_id").cast("int").alias("set_id")).agg(F.count("*").alias("n"), F.count_if(full).alias("n_full"), F.count_if(~full).alias("n_dip_only"))
    all_ = ranges.crossJoin(F.broadcast(sets))  # a hole's intervals times the few sets
    out = all_.join(counts, ["hole_id", "k", "set_id"], "left")
    n, span = F.coalesce("n", F.lit(0)), F.col("to_depth") - F.col("from_depth")
    return out.select("hole_id", "from_depth", "to_depth", "set_id", n.alias("n_fractures"), F.coalesce("n_full", F.lit(0)).alias("n_full"), F.coalesce("n_dip_only", F.lit(0)).alias("n_dip_only"), span.alias("sample_length"), F.when(span > 0, n / span).alias("p10"), F.when((n == 0) & (span > 0), "true_zero").otherwise("modeled_value").alias("data_state"))


def roles(holes_: DataFrame, fraction: float = 0.25, seed: int = 7, by: str | None = None, least: int = 1) -> DataFrame:
    """hole_id, role: whole holes split at random, for each stratum if given; at least `least` validate and one calibrates.

    The order is a multiplicative hash of the hole's number, so that SQL can repeat it.
    """
    key = F.pmod((F.col("hole_id") + seed) * F.lit(1103515245) + F.lit(12345), F.lit(2147483648))
    part = Window.partitionBy(by if by else F.lit(0))
    n = F.count("*").over(part)
    wanted = F.greatest(F.lit(least), F.least(F.bround(n * F.lit(fraction)).cast("long"), n - 1))
    place = F.row_number().over(part.orderBy(key, "hole_id"))
    return holes_.withColumn("role", F.when(place <= wanted, "validation").otherwise("calibration")).select("hole_id", *([by] if by else []), "role")


def with_role(rows: DataFrame, roles_: DataFrame, role: str) -> DataFrame:
    return rows.join(roles_.filter(F.col("role") == role).select("hole_id"), "hole_id", "left_semi")


@F.pandas_udf(T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]))
def _interval(count: pd.Series, effective: pd.Series) -> pd.DataFrame:
    rows = [special.poisson_interval(int(n), float(e)) if e and e > 0 else (None, None) for n, e in zip(count, effective, strict=True)]
    return pd.DataFrame(rows, columns=["low", "high"])


@F.pandas_udf(T.DoubleType())
def _exposure(kappa: pd.Series, cosine: pd.Series) -> pd.Series:
    out = pd.Series(0.0, index=kappa.index)
    for k, part in cosine.groupby(kappa):
        out[part.index] = special.exposure(float(k), part.to_numpy())
    return out


def effective_lengths(pieces: DataFrame, models: DataFrame) -> DataFrame:
    """Length-weighted exposure of pieces (hole_id, from_depth, to_depth, dx, dy, dz, length) for each set's model (set_id, nx, ny, nz, kappa).

    Pieces are first summed by direction, rounded to 1e-6, so the quadrature sees each direction of a hole once.
    """
    d = [F.round(F.col(f"d{k}"), 6).alias(f"d{k}") for k in "xyz"]
    few = pieces.groupBy("hole_id", "from_depth", "to_depth", *d).agg(F.sum("length").alias("length"))
    each = few.crossJoin(F.broadcast(models))  # a row for each set
    cosine = F.least(F.lit(1.0), F.abs(G.dot(G.vector("nx", "ny", "nz"), G.vector("dx", "dy", "dz"))))
    got = each.withColumn("exposure", _exposure(F.col("kappa"), cosine))
    return got.groupBy("hole_id", "from_depth", "to_depth", "set_id").agg(F.sum(F.col("length") * F.col("exposure")).alias("effective_length"), F.sum("length").alias("raw_length"))


def p32(intervals: DataFrame, effective: DataFrame, least_exposure: float = 0.05, keys: tuple[str, ...] = ("set_id",)) -> DataFrame:
    """P32 = fractures / effective length for each key, with standard error, 95 % interval and observability."""
    j = intervals.join(effective, ["hole_id", "from_depth", "to_depth", "set_id"])
    g = j.groupBy(*keys).agg(F.sum("n_fractures").alias("n"), F.sum("raw_length").alias("raw"), F.sum("effective_length").alias("eff"))
    seen = (F.col("raw") > 0) & (F.col("eff") / F.col("raw") >= least_exposure)
    g = g.withColumn("ci", _interval(F.col("n").cast("long"), F.col("eff")))
    return g.select(*keys, F.col("n").alias("n_fractures"), F.col("raw").alias("raw_length"), F.col("eff").alias("effective_length"), (F.col("eff") / F.col("raw")).alias("mean_exposure"), F.when(seen, F.col("n") / F.col("eff")).alias("p32"), F.when(seen, F.sqrt("n") / F.col("eff")).alias("standard_error"), F.when(seen, F.col("ci.low")).alias("ci95_low"), F.when(seen, F.col("ci.high")).alias("ci95_high"), F.when(seen, "ADEQUATE").otherwise("LOW_OBSERVABILITY").alias("observability"))


def spacing_p10(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Length-weighted P10 of spacing intervals (from_depth, to_depth, derived_p10)."""
    span = F.col("to_depth") - F.col("from_depth")
    return rows.groupBy(*keys).agg(F.sum(span).alias("total_length"), (F.sum(span * F.col("derived_p10")) / F.sum(span)).alias("p10"))


def validation_metrics(rows: DataFrame, observed: str = "observed", predicted: str = "predicted", by: list[str] | None = None) -> DataFrame:
    """Counts, MAE, RMSE, bias, R2 = 1 - SSE / SST and Pearson's r; NULL with fewer than two valid rows."""
    o, p = F.col(observed), F.col(predicted)
    ok = o.isNotNull() & p.isNotNull()
    e = F.when(ok, p - o)
    two = F.col("n_valid") >= 2
    sst = F.col("__var") * F.col("n_valid")
    g = rows.groupBy(*(by or [])).agg(F.count("*").alias("n_total"), F.count_if(ok).alias("n_valid"), F.avg(F.abs(e)).alias("__mae"), F.avg(e * e).alias("__mse"), F.avg(e).alias("__bias"), F.var_pop(F.when(ok, o)).alias("__var"), F.corr(F.when(ok, o), F.when(ok, p)).alias("__r"))
    return g.select(*(by or []), "n_total", "n_valid", F.when(two, F.col("__mae")).alias("mae"), F.when(two, F.sqrt("__mse")).alias("rmse"), F.when(two, F.col("__bias")).alias("bias"), F.when(two & (sst > 0), 1 - F.col("__mse") * F.col("n_valid") / sst).alias("r2"), F.when(two, F.col("__r")).alias("pearson"))


def jv_rqd(points: DataFrame) -> DataFrame:
    """Jv = sum of 1 / spacing of a point's sets and RQD = 110 - 2.5 Jv, 100 up to Jv 4 and 0 from Jv 44."""
    jv = F.sum(F.when(F.col("joint_spacing_m") > 0, F.lit(1.0) / F.col("joint_spacing_m")))
    g = points.groupBy("point_key").agg(jv.alias("jv"), F.count("*").alias("n_components"), F.bool_or(F.col("component_type") == "RANDOM_BACKGROUND").alias("has_random"))
    return g.withColumn("rqd", rqd_from_jv(F.col("jv")))


def rqd_from_jv(jv: Column) -> Column:
    return F.when(jv <= 4, 100.0).when(jv >= 44, 0.0).otherwise(F.lit(110.0) - F.lit(2.5) * jv)


def supported_p10(p10: DataFrame, supported: DataFrame) -> DataFrame:
    """P10 rows of a realization in which only the sets in `supported` were simulated: the others have no data, not zero."""
    known = F.coalesce("__supported", F.lit(False))
    out = p10.join(supported.select("set_id").distinct().withColumn("__supported", F.lit(True)), "set_id", "left")
    values = {c: F.when(known, F.col(c)) for c in ("n_fractures", "n_full", "n_dip_only", "p10")}
    return out.withColumns(values | {"data_state": F.when(known, F.col("data_state")).otherwise("no_data")}).select(*p10.columns)
