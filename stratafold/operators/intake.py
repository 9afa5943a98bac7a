"""Records: standardising, classifying, signatures, quality issues and state changes, all as column rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# States of a record, missing-value marks, and the units of spacing.
FORMAL, EXCLUDED, PENDING = "FORMAL", "EXCLUDED", "PENDING"
MISSING = ["", "na", "n/a", "null", "none"]
UNIT_FACTORS = {"mm": 0.001, "cm": 0.01, "m": 1.0}
BASES = ["BOREHOLE_ALONG_HOLE", "TRUE_NORMAL", "SCANLINE_APPARENT"]


def blank_to_null(column: Column) -> Column:
    return F.when(F.lower(F.trim(column.cast("string"))).isin(MISSING), None).otherwise(column)


def number(column: Column) -> Column:
    """A finite number, else NULL."""
    x = column.try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def first_rule(*rules: tuple[Column, str | Column]) -> Column:
    """The reason of the first rule that a row breaks, NULL if none."""
    out = None
    for broken, reason in rules:
        reason = F.lit(reason) if isinstance(reason, str) else reason
        out = F.when(broken, reason) if out is None else out.when(broken, reason)
    return out


def latest_collars(collars: DataFrame, order: str | None = None) -> DataFrame:
    """One collar per hole: the last by `order` (or any, if the input has one each)."""
    good = collars.filter((F.col("final_depth") > 0) & F.col("collar_x").isNotNull() & F.col("collar_y").isNotNull() & F.col("collar_z").isNotNull())
    key = F.struct(F.col(order)) if order else F.struct("final_depth", "collar_x", "collar_y", "collar_z")
    cols = [c for c in good.columns if c != "hole_id"]
    return good.groupBy("hole_id").agg(F.max_by(F.struct(*cols), key).alias("c")).select("hole_id", *[f"c.{c}" for c in cols])


def with_state(rows: DataFrame, collars: DataFrame, *rules: tuple[Column, str | Column]) -> DataFrame:
    """`rows` with state and reason. Rules may use total_depth, the hole's depth; a hole without collar leaves a row pending."""
    depths = collars.select(F.col("hole_id").alias("__hole"), F.col("final_depth").alias("total_depth"))
    joined = rows.join(depths, F.col("hole_id") == F.col("__hole"), "left")
    reason = first_rule((F.col("hole_id").isNull(), "Missing required hole_id"), (F.col("total_depth").isNull(), "Collar is not available"), *rules)
    state = F.when(F.col("reason").isNull(), FORMAL).when(F.col("reason") == "Collar is not available", PENDING).otherwise(EXCLUDED)
    return joined.withColumn("reason", reason).withColumn("state", state).drop("__hole", "total_depth")


def classify_fractures(rows: DataFrame, collars: DataFrame) -> DataFrame:
    depth, dip, direction = F.col("depth"), F.col("dip"), F.col("dip_direction")
    rules = (
        (depth.isNull() | dip.isNull(), "Fracture depth/dip must be numeric"),
        ((depth < 0) | (depth > F.col("total_depth")), "Fracture depth exceeds borehole total depth"),
        ((dip < 0) | (dip > 90), "Dip is outside [0, 90]"),
        ((direction < 0) | (direction > 360), "Dip direction is outside [0, 360]"),
    )
    mode = F.when(direction.isNull(), "DIP_ONLY").otherwise("FULL_ORIENTATION")
    return with_state(rows, collars, *rules).withColumn("orientation_completeness", mode)


def classify_surveys(rows: DataFrame, collars: DataFrame) -> DataFrame:
    depth = F.col("measured_depth")
    again = F.row_number().over(Window.partitionBy("hole_id", "measured_depth").orderBy("azimuth", "dip")) > 1
    numeric = depth.isNull() | F.col("azimuth").isNull() | F.col("dip").isNull()
    return with_state(rows.withColumn("__again", again), collars, (numeric, "Survey depth/orientation must be numeric"), ((depth < 0) | (depth > F.col("total_depth")), "Survey depth exceeds valid range"), (F.col("__again"), "Duplicate survey station")).drop("__again")


def classify_intervals(rows: DataFrame, collars: DataFrame, *more: tuple[Column, str | Column]) -> DataFrame:
    """RQD, RMR, domain and scalar intervals; `more` has the rules of the value."""
    low, high = F.col("from_depth"), F.col("to_depth")
    outside = (low < 0) | (low >= high) | (high > F.col("total_depth"))
    return with_state(rows, collars, (low.isNull() | high.isNull(), "Interval depths must be numeric"), (outside, "Interval is outside borehole depth"), *more)


def standardize_spacing(rows: DataFrame) -> DataFrame:
    """Spacing in metres and P10 = 1 / spacing, from fracture_spacing, spacing_unit and measurement_basis."""
    unit = F.lower(F.trim(F.coalesce("spacing_unit", F.lit("cm"))))
    factor = F.element_at(F.create_map(*[F.lit(x) for kv in UNIT_FACTORS.items() for x in kv]), unit)
    metres = F.col("fracture_spacing") * factor
    basis = F.coalesce(F.upper(blank_to_null(F.col("measurement_basis"))), F.lit(BASES[0]))
    return rows.withColumns({"spacing_unit": unit, "measurement_basis": basis, "spacing_m": metres, "derived_p10": F.when(metres > 0, F.lit(1.0) / metres)})


def classify_spacing(rows: DataFrame, collars: DataFrame) -> DataFrame:
    more = (
        (F.col("fracture_spacing").isNull() | (F.col("fracture_spacing") <= 0), "fracture_spacing must be greater than zero"),
        (~F.col("spacing_unit").isin(list(UNIT_FACTORS)), "spacing_unit must be one of mm, cm, or m"),
        (~F.col("measurement_basis").isin(BASES), "measurement_basis is invalid for spacing observations"),
        (F.col("derived_p10").isNull(), "Unable to derive P10"),
    )
    return classify_intervals(rows, collars, *more)


def standardize_points(rows: DataFrame) -> DataFrame:
    """Orientation points: source kind from the id's prefix, point key, component type."""
    kind = F.when(F.substring("observation_id", 1, 1) == "P", "POINT_CLOUD").when(F.substring("observation_id", 1, 1) == "Z", "BOREHOLE_CAMERA")
    random = F.upper(F.trim("local_set_id")) == "RANDOM"
    return rows.withColumns({"source_kind": kind, "point_key": F.concat(kind, F.lit(":"), F.trim("point_id")), "component_type": F.when(random, "RANDOM_BACKGROUND").otherwise("LOCAL_DOMINANT_SET"), "orientation_status": F.when(random, "MISSING").otherwise("COMPLETE")})


def classify_points(rows: DataFrame) -> DataFrame:
    """State of standardised orientation points; cross-row rules follow in `point_conflicts`."""
    random, cloud = F.col("component_type") == "RANDOM_BACKGROUND", F.col("source_kind") == "POINT_CLOUD"
    bad_dip = F.col("dip").isNull() | ~F.col("dip").between(0, 90)
    bad_direction = F.col("dip_direction").isNull() | (F.col("dip_direction") < 0) | (F.col("dip_direction") >= 360)
    spacing, joints = F.col("joint_spacing_m"), F.col("joint_num")
    reason = first_rule(
        (F.trim(F.coalesce("observation_id", F.lit(""))) == "", "field observation_id is required"),
        (F.trim(F.coalesce("point_id", F.lit(""))) == "", "field point_id is required"),
        (F.col("x").isNull() | F.col("y").isNull() | F.col("z").isNull(), "fields x, y and z must be finite numbers"),
        (F.col("source_kind").isNull(), "field observation_id prefix must be P or Z"),
        (F.trim(F.coalesce("local_set_id", F.lit(""))) == "", "field local_set_id is required"),
        (cloud & random & (F.col("dip").isNotNull() | F.col("dip_direction").isNotNull()), "fields dip and dip_direction must be empty for RANDOM"),
        (cloud & ~random & bad_dip, "field dip must be in [0, 90] for point-cloud dominant sets"),
        (cloud & ~random & bad_direction, "field dip_direction must be in [0, 360) for point-cloud dominant sets"),
        (cloud & (spacing.isNull() | (spacing <= 0)), "field joint_spacing_m must be greater than zero for P records"),
        (cloud & (joints.isNull() | (joints <= 0)), "field joint_num must be a positive integer for P records"),
        (~cloud & random, "field local_set_id cannot be RANDOM for Z records"),
        (~cloud & bad_dip, "field dip must be in [0, 90] for Z records"),
        (~cloud & bad_direction, "field dip_direction must be in [0, 360) for Z records"),
        (~cloud & spacing.isNotNull(), "field joint_spacing_m must be empty for Z records"),
        (~cloud & joints.isNotNull(), "field joint_num must be empty for Z records"),
    )
    return rows.withColumn("reason", reason).withColumn("state", F.when(F.col("reason").isNull(), FORMAL).otherwise(EXCLUDED))


def point_conflicts(points: DataFrame) -> DataFrame:
    """Rules across points: unique observation ids, one place for a point key, one random component for a point."""
    by_id = Window.partitionBy("observation_id").orderBy("point_key", "local_set_id")
    by_key = Window.partitionBy("point_key").orderBy("observation_id")
    far = F.lit(False)
    for c in "xyz":
        far = far | (F.abs(F.col(c) - F.first(c).over(by_key)) > 1e-9)
    random = (F.col("component_type") == "RANDOM_BACKGROUND").cast("int")
    reason = first_rule((F.row_number().over(by_id) > 1, "duplicate observation_id"), (far, "inconsistent point coordinates"), ((random == 1) & (F.sum(random).over(by_key) > 1), "more than one RANDOM component"))
    return points.withColumn("conflict", reason)


def signature(rows: DataFrame, columns: list[str], salt: str = "") -> Column:
    """Content hash of the named columns in the order of their names; NULL is distinct from an empty text."""
    cells = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("\0"))) for c in sorted(columns)]
    return F.sha2(F.encode(F.concat_ws("\x1f", F.lit(salt), *cells), "UTF-8"), 256)


def first_of_each(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, and how many rows it stands for. One shuffle, sums made before it."""
    others = [c for c in rows.columns if c not in keys]
    best = F.min_by(F.struct(*others), F.struct(*order)).alias("r")
    return rows.groupBy(*keys).agg(best, F.count("*").alias("n_copies")).select(*keys, *[f"r.{c}" for c in others], "n_copies")


def new_rows(batch: DataFrame, existing: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """What a batch adds to the rows that exist: first of each key, not there yet."""
    return first_of_each(batch, keys, order).join(existing.select(*keys).distinct(), keys, "left_anti")


def supersede(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Replace mode: the old rows stay, excluded; the batch is added."""
    old = existing.withColumns({"state": F.lit(EXCLUDED), "reason": F.lit("Superseded")})
    return old.unionByName(batch, allowMissingColumns=True)


def merge_findings(stored: DataFrame, found: DataFrame) -> DataFrame:
    """issue_key, status: found issues are open (reopened if they were resolved), open ones that are gone are resolved."""
    s, f = stored.select("issue_key", F.col("status").alias("was")), found.select("issue_key").distinct().withColumn("here", F.lit(True))
    both = s.join(f, "issue_key", "full_outer")
    status = F.when(F.col("here") & F.col("was").isNull(), "NEW").when(F.col("here") & (F.col("was") == "RESOLVED"), "REOPENED").when(F.col("here").isNull() & (F.col("was") != "RESOLVED"), "RESOLVED").otherwise(F.col("was"))
    return both.select("issue_key", status.alias("status"))


def running_overlaps(intervals: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """Intervals that begin before the furthest end of the earlier ones of their hole, with that one's id."""
    earlier = Window.partitionBy(*keys).orderBy("from_depth", ident).rowsBetween(Window.unboundedPreceding, -1)
    furthest = F.max(F.struct("to_depth", ident)).over(earlier)
    return intervals.withColumn("f", furthest).filter(F.col("f.to_depth") > F.col("from_depth")).select(*intervals.columns, F.col(f"f.{ident}").alias("overlaps"), F.col("f.to_depth").alias("overlap_to"))


def adjacent_overlaps(intervals: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """The weaker rule: only the interval just before counts."""
    w = Window.partitionBy(*keys).orderBy("from_depth", ident)
    return intervals.withColumn("before", F.lag("to_depth").over(w)).filter(F.col("before") > F.col("from_depth"))


def not_increasing(stations: DataFrame) -> DataFrame:
    """Stations at or above the depth of the one before."""
    w = Window.partitionBy("hole_id").orderBy("measured_depth", "azimuth", "dip")
    return stations.withColumn("before", F.lag("measured_depth").over(w)).filter(F.col("measured_depth") <= F.col("before"))


def issues(rows: DataFrame, table: str, rules: dict[str, tuple[Column, str, Column | None]], ident: list[str]) -> DataFrame:
    """A row for each broken rule: table, rule, severity, key, suggested value. `rules` has name -> (broken, severity, suggestion)."""
    each = [F.when(broken, F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), (F.lit(None) if fix is None else fix).cast("double").alias("suggested"))) for name, (broken, severity, fix) in rules.items()]
    found = rows.select(F.concat_ws(":", *[F.col(c).cast("string") for c in ident]).alias("record_key"), F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("i"))
    return found.select(F.lit(table).alias("table_name"), "i.rule", "i.severity", "record_key", "i.suggested", F.sha2(F.concat_ws("|", F.lit(table), "i.rule", "record_key"), 256).alias("issue_key"))


def collar_issues(collars: DataFrame) -> DataFrame:
    again = collars.withColumn("n", F.row_number().over(Window.partitionBy("hole_id").orderBy("collar_x", "collar_y")))
    a, d = F.col("azimuth"), F.col("dip")
    return issues(again, "collars", {"duplicate_hole": (F.col("n") > 1, "ERROR", None), "depth_not_positive": (F.col("final_depth") <= 0, "ERROR", None), "azimuth_range": ((a < 0) | (a >= 360), "WARNING", F.pmod(a, F.lit(360.0))), "dip_range": ((d < -90) | (d > 90), "WARNING", F.greatest(F.lit(-90.0), F.least(F.lit(90.0), d)))}, ["hole_id"])


def survey_issues(surveys: DataFrame, collars: DataFrame) -> DataFrame:
    j = surveys.join(collars.select("hole_id", "final_depth"), "hole_id", "left")
    a, d, m = F.col("azimuth"), F.col("dip"), F.col("measured_depth")
    return issues(j, "surveys", {"unknown_hole": (F.col("final_depth").isNull(), "ERROR", None), "negative_depth": (m < 0, "ERROR", None), "depth_exceeds": (m > F.col("final_depth"), "ERROR", F.col("final_depth")), "azimuth_range": ((a < 0) | (a >= 360), "WARNING", F.pmod(a, F.lit(360.0))), "dip_range": ((d < -90) | (d > 90), "WARNING", F.greatest(F.lit(-90.0), F.least(F.lit(90.0), d)))}, ["hole_id", "measured_depth"])


def fracture_issues(fractures: DataFrame, collars: DataFrame) -> DataFrame:
    j = fractures.join(collars.select("hole_id", "final_depth"), "hole_id", "left")
    a, d = F.col("dip_direction"), F.col("dip")
    return issues(j, "fractures", {"unknown_hole": (F.col("final_depth").isNull(), "ERROR", None), "depth_exceeds": ((F.col("depth") < 0) | (F.col("depth") > F.col("final_depth")), "ERROR", None), "direction_range": ((a < 0) | (a >= 360), "WARNING", F.pmod(a, F.lit(360.0))), "dip_range": ((d < 0) | (d > 90), "ERROR", None), "direction_missing": (a.isNull(), "INFO", None)}, ["hole_id", "obs_id"])


def interval_issues(intervals: DataFrame, collars: DataFrame, ident: str, value_range: tuple[float, float] | None = None, value: str = "value") -> DataFrame:
    j = intervals.join(collars.select("hole_id", "final_depth"), "hole_id", "left")
    rules = {"unknown_hole": (F.col("final_depth").isNull(), "ERROR", None), "empty_interval": (F.col("from_depth") >= F.col("to_depth"), "ERROR", None), "depth_exceeds": (F.col("to_depth") > F.col("final_depth"), "ERROR", F.col("final_depth"))}
    if value_range:
        low, high = value_range
        rules["value_range"] = ((F.col(value) < low) | (F.col(value) > high), "WARNING", F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), F.col(value))))
    return issues(j, "intervals", rules, [ident])


def issue_report(found: DataFrame) -> DataFrame:
    return found.groupBy("table_name", "rule", "severity").agg(F.count("*").alias("n"))


def record_counts(rows: DataFrame, *by: str) -> DataFrame:
    count = lambda s: F.count_if(F.col("state") == s).alias(s.lower())
    return rows.groupBy(*by).agg(count(FORMAL), count(EXCLUDED), count(PENDING), F.count("*").alias("total"))


def can_complete(rows: DataFrame, found: DataFrame) -> DataFrame:
    """One row: whether the records may be closed: some rows, none pending, no error."""
    a = rows.agg(F.count("*").alias("n_rows"), F.count_if(F.col("state") == PENDING).alias("n_pending"))
    b = found.agg(F.count_if(F.col("severity") == "ERROR").alias("n_errors"))
    return a.crossJoin(b).withColumn("complete", (F.col("n_rows") > 0) & (F.col("n_pending") == 0) & (F.col("n_errors") == 0))


def coverage_errors(intervals: DataFrame, by: list[str], ident: str, tolerance: float = 1e-10) -> DataFrame:
    """Intervals that reach into the next one of their group by more than `tolerance`: `by`, ident, next_id, overlap."""
    order = Window.partitionBy(*by).orderBy("from_depth", "to_depth", ident)
    nexts = intervals.withColumns({"next_id": F.lead(ident).over(order), "overlap": F.col("to_depth") - F.lead("from_depth").over(order)})
    return nexts.filter(F.col("overlap") > tolerance).select(*by, ident, "next_id", "overlap")


def p32_of_spacing(rows: DataFrame, strict: bool = True) -> DataFrame:
    """`rows` (spacing_m, basis) with p32 = 1 / spacing, allowed for true normal spacings above 0 only.

    Other rows are an error; with `strict` off they have a null p32 and refused is true.
    """
    allowed = F.coalesce((F.col("basis") == "TRUE_NORMAL") & (F.col("spacing_m") > 0), F.lit(False))
    out = rows.withColumns({"refused": ~allowed, "p32": F.when(allowed, 1 / F.col("spacing_m"))})
    if strict and (n := out.filter("refused").count()):
        raise ValueError(f"{n} rows without a true normal spacing")
    return out
