"""Assignments, synchronisation, staleness and reports: joins of what is with what was or was wanted."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G

# What each step of the workflow is built from.
STEPS = {"import": [], "clean": ["import"], "holdout": ["clean"], "joint_sets": ["holdout"], "domains": ["clean", "holdout"], "density": ["joint_sets", "domains"], "size": ["density"], "bounds": ["clean"], "voxel_grid": ["bounds"], "parameter_field": ["size", "voxel_grid"], "validation": ["parameter_field"], "explicit_dfn": ["parameter_field"], "second_voxelization": ["explicit_dfn"]}


def stale_steps(changed: str) -> list[str]:
    """The steps that a change makes stale, in the workflow's order."""
    out = {changed}
    for step, needs in STEPS.items():
        if out & set(needs):
            out.add(step)
    return [s for s in STEPS if s in out and s != changed]


def reassign(rows: DataFrame, assignments: DataFrame, keys: list[str], value: str = "set_id") -> tuple[DataFrame, DataFrame]:
    """`rows` with new values where an assignment (keys, value) names them; and the assignments that are unknown or given twice."""
    given = assignments.groupBy(*keys).agg(F.first(value).alias("__new"), F.count("*").alias("__n"))
    known = rows.select(*keys).distinct().withColumn("__known", F.lit(True))
    bad = given.join(known, keys, "left").filter(F.col("__known").isNull() | (F.col("__n") > 1))
    bad = bad.select(*keys, F.when(F.col("__known").isNull(), "unknown").otherwise("duplicate").alias("problem"))
    good = given.filter("__n = 1").drop("__n")
    out = rows.join(good, keys, "left").withColumn(value, F.coalesce("__new", value)).drop("__new")
    return out, bad


def synchronized(now: DataFrame, before: DataFrame, keys: list[str], values: list[str], by: str) -> DataFrame:
    """For each `by` (a parameter): rows added, removed and changed between two states; a parameter with none is still valid."""
    mark = lambda f, n: f.select(by, *keys, F.xxhash64(*values).alias(n))
    j = mark(now, "a").join(mark(before, "b"), [by, *keys], "full_outer")
    g = j.groupBy(by).agg(F.count_if(F.col("b").isNull()).alias("n_added"), F.count_if(F.col("a").isNull()).alias("n_removed"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).alias("n_changed"))
    return g.withColumn("stale", (F.col("n_added") + F.col("n_removed") + F.col("n_changed")) > 0)


def content_hash(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the number of rows and a hash of their contents that doesn't depend on their order."""
    one = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(columns)]), 256)
    parts = [F.sum(F.conv(F.substring(one, 1 + 8 * i, 8), 16, 10).cast("long")).alias(f"h{i}") for i in range(4)]
    return rows.agg(F.count("*").alias("n_rows"), *parts)


def supported_samples(samples: DataFrame, parts: DataFrame, ident: str) -> DataFrame:
    """Samples with why_excluded: partly unassigned, or across domains, by their sub-intervals (`holes.split_by_domain`); else NULL."""
    g = parts.groupBy(ident).agg(F.count_if(F.col("status") == "unassigned").alias("n_open"), F.count_distinct("domain_id").alias("n_domains"), F.count_if(F.col("status") == "overlap_conflict").alias("n_conflicts"))
    why = F.when(F.col("n_conflicts") > 0, "overlap_conflict").when(F.col("n_open") > 0, "partially_unassigned").when(F.col("n_domains") > 1, "crosses_domains")
    return samples.join(g, ident, "left").withColumn("why_excluded", why).drop("n_open", "n_domains", "n_conflicts")


def offsets(counts: DataFrame, by: str, order: str, count: str = "n") -> DataFrame:
    """Exclusive prefix sums of counts."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("first", F.coalesce(F.sum(count).over(w), F.lit(0)))


def expected_discs(field: DataFrame, volume: float, mean_squared_radius: Column | str = "mean_squared_radius", by: tuple[str, ...] = ("set_id",)) -> DataFrame:
    """Expected disc area p32 * V and number p32 * V / (pi E[R^2]) of each key, and bytes at 80 a disc."""
    area = F.sum(F.col("p32") * F.lit(float(volume)))
    n = F.sum(F.col("p32") * F.lit(float(volume)) / (F.lit(math.pi) * G.col(mean_squared_radius)))
    return field.groupBy(*by).agg(area.alias("expected_area"), n.alias("expected_count"), (n * 80).alias("expected_bytes"))


def diagnostics(observed: DataFrame, targets: DataFrame, generated: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each key that any side has: observed number, target P32, generated number and area; missing ones are 0 or NULL."""
    a = observed.groupBy(*keys).agg(F.count("*").alias("n_observed"))
    c = generated.groupBy(*keys).agg(F.count("*").alias("n_generated"), F.sum("area").alias("generated_area"))
    j = a.join(targets.select(*keys, "p32"), keys, "full_outer").join(c, keys, "full_outer")
    return j.select(*keys, F.coalesce("n_observed", F.lit(0)).alias("n_observed"), "p32", F.coalesce("n_generated", F.lit(0)).alias("n_generated"), F.coalesce("generated_area", F.lit(0.0)).alias("generated_area"))


def nearest_axis(rows: DataFrame, models: DataFrame, key: str) -> DataFrame:
    """`key`, set_id: the model axis of least angle to each row's normal, ties to the lower id. Models are few."""
    m = F.broadcast(models.select("set_id", *[F.col(f"n{k}").alias(f"m{k}") for k in "xyz"]))
    score = F.round(F.abs(G.dot(G.vector("nx", "ny", "nz"), G.vector("mx", "my", "mz"))), 12)
    return rows.select(key, "nx", "ny", "nz").crossJoin(m).groupBy(key).agg(F.max_by("set_id", F.struct(score, -F.col("set_id"))).alias("set_id"))


def exchangeable_sums(parts: list[DataFrame], keys: list[str], values: list[str]) -> DataFrame:
    """Sums of partial sums: chunks of a realisation add up in any order."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])


def with_size_model(rows: DataFrame, models: DataFrame) -> DataFrame:
    """`rows` (domain_id, set_id) with column model: the model of their domain and set, else that of the set in no domain.

    `models` has domain_id, set_id, unique together, and further columns, which become the fields of model.
    """
    fields = [c for c in models.columns if c not in ("domain_id", "set_id")]
    packed = models.select("domain_id", "set_id", F.struct(*fields).alias("__model"))
    own = packed.filter("domain_id is not null").withColumnRenamed("__model", "__own")
    common = packed.filter("domain_id is null").select("set_id", F.col("__model").alias("__common"))
    joined = rows.join(own, ["domain_id", "set_id"], "left").join(common, "set_id", "left")
    return joined.select(*[F.col(c) for c in rows.columns], F.coalesce("__own", "__common").alias("model"))


def size_model_problems(active: DataFrame, models: DataFrame, status: str = "status") -> DataFrame:
    """domain_id, set_id, problem of the active domains and sets that have no size model, or one that isn't resolved."""
    pairs = with_size_model(active.select("domain_id", "set_id").distinct(), models)
    unresolved = F.coalesce(F.col(f"model.{status}"), F.lit("UNRESOLVED")) == "UNRESOLVED"
    problem = F.when(F.col("model").isNull(), "MISSING_SIZE_MODEL").when(unresolved, "UNRESOLVED_SIZE_MODEL")
    return pairs.select("domain_id", "set_id", problem.alias("problem")).filter("problem is not null")
