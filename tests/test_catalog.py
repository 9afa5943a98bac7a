import duckdb
import pytest

import __spark_entry__ as entry
from stratafold.operators import fields, intake, state
from stratafold.plans import catalog
from stratafold.plans.views import TABLES

FOLDER = "/root/testdata/sf0.001"
CHEAP = ["p10_intervals", "record_counts", "classify_records", "merge_findings", "interval_overlaps", "jv_rqd", "orientation_roundtrip", "fisher_by_set", "trajectory_points", "domain_split", "stratified_holdout", "world_to_voxel", "variogram_lags", "sphere_pairs", "template_resolve", "size_moments", "joint_set_diagnostics", "synchronized_samples", "percolation", "generation_bounds", "axial_summary", "coverage_errors", "p32_of_spacing", "disc_neighbours", "imported_sets", "size_model_lookup", "size_model_problems", "field_at_points", "voxel_results", "supported_p10"]


def tidy(rows, names):
    cell = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    return sorted((tuple(cell(v) for _, v in sorted(zip(names, r), key=lambda x: x[0])) for r in rows), key=repr)


@pytest.mark.parametrize("name", CHEAP)
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    want = con.execute(catalog.ORACLES[name])
    names = [c[0] for c in want.description]
    got = catalog.QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(names)
    assert tidy([tuple(r) for r in got.collect()], got.columns) == tidy(want.fetchall(), names)


def test_spacing_without_a_basis_is_an_error(spark):
    rows = spark.createDataFrame([(0.5, "TRUE_NORMAL"), (0.5, None), (0.0, "TRUE_NORMAL")], "spacing_m double, basis string")
    assert [(r.p32, r.refused) for r in intake.p32_of_spacing(rows, strict=False).collect()] == [(2.0, False), (None, True), (None, True)]
    with pytest.raises(ValueError):
        intake.p32_of_spacing(rows)
    assert intake.p32_of_spacing(rows.limit(0)).collect() == []


def test_field_values_at_bounds(spark):
    points = spark.createDataFrame([(0.0, 0.0, 0.0), (9.9, 9.9, 9.9), (10.0, 1.0, 1.0), (-0.1, 1.0, 1.0), (1.0, 1.0, 9.0), (1.0, 9.0, 1.0), (None, 1.0, 1.0)], "x double, y double, z double")
    field = spark.createDataFrame([(0, 1.5), (7, 2.5), (1, float("nan")), (2, float("inf"))], "flat long, value double")
    got = {(r.x, r.y, r.z): r.value for r in fields.value_at(points, field, (0, 0, 0), (5, 5, 5), (2, 2, 2)).collect()}
    assert len(got) == 7 and {k: v for k, v in got.items() if v is not None} == {(0.0, 0.0, 0.0): 1.5, (9.9, 9.9, 9.9): 2.5}


def test_voxel_results_and_metadata(spark):
    field = spark.createDataFrame([(0, 2, 3e6, 400.0), (5, 0, None, None), (7, None, 1e6, 10.0), (6, 1, None, None)], "flat long, n_discs long, area double, p32 double")
    got = sorted(tuple(r) for r in fields.voxel_results(field, (0, 0, 0), (5, 5, 5), (2, 2, 2), 1e6, 1e3).collect())
    assert got == [(0, 0, 0, 2.5, 2.5, 2.5, 0.4, 3.0, 2), (1, 1, 0, 7.5, 7.5, 2.5, 0.0, 0.0, 1), (1, 1, 1, 7.5, 7.5, 7.5, 0.01, 1.0, 0)]
    meta = fields.grid_metadata(spark, (0, 0, 0), (5, 5, 5), (2, 2, 2)).first()
    assert (meta.x_min, meta.z_max, meta.dy, meta.nz) == (0.0, 10.0, 5.0, 2)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.ORACLES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_staleness_and_assignments(spark):
    assert state.stale_steps("parameter_field") == ["validation", "explicit_dfn", "second_voxelization"]
    assert "density" in state.stale_steps("domains") and "bounds" not in state.stale_steps("domains")
    rows = spark.createDataFrame([(1, 1), (2, 1)], "k int, set_id int")
    out, bad = state.reassign(rows, spark.createDataFrame([(1, 5), (3, 7), (2, 8), (2, 9)], "k int, set_id int"), ["k"])
    assert sorted(tuple(r) for r in out.select("k", "set_id").collect()) == [(1, 5), (2, 1)]
    assert sorted(tuple(r) for r in bad.collect()) == [(2, "duplicate"), (3, "unknown")]


def test_every_depth_and_set(spark):
    v = catalog.Views(spark, FOLDER)
    line = {}
    for p in catalog.QUERIES["trajectory_points"](spark, FOLDER).collect():
        line.setdefault(p.hole_id, []).append((p.measured_depth, p.idx))
    rows = v.fractures.select("hole_id", "depth", "dip_direction").collect()
    want = {(x.hole_id, x.depth, min((abs(m - x.depth), i) for m, i in line[x.hole_id])[1]) for x in rows if x.hole_id in line}
    got = [(x.hole_id, x.depth, x.idx) for x in catalog.QUERIES["nearest_vertex_all"](spark, FOLDER).collect()]
    assert set(got) == want and len(got) == len(want) and max(d for _, d, _ in want) == 100
    want = {(x.hole_id, x.depth) for x in rows if x.dip_direction is not None and x.hole_id in line}
    got = [(x.hole_id, x.depth) for x in catalog.QUERIES["conditioned_all"](spark, FOLDER).collect()]
    assert set(got) == want and len(got) == len(want)


def test_p32_of_all_discs(spark):
    cells = catalog.Views(spark, FOLDER)
    want = {}
    for x in catalog._areas(cells).collect():
        for key in ((x.flat, x.set_id), (x.flat, None)):
            area, n = want.get(key, (0.0, 0))
            want[key] = (area + x.area, n + 1)
    got = {(x.flat, x.set_id): x for x in catalog.QUERIES["voxel_p32_all"](spark, FOLDER).collect()}
    assert set(got) == set(want)
    for key, (area, n) in want.items():
        assert got[key].n_discs == n and got[key].area == pytest.approx(area, abs=1e-3) and got[key].p32 == pytest.approx(area / 125, abs=1e-3)
    inside = [d for d in cells.discs.collect() if all(d.radius <= c <= 100 - d.radius for c in (d.cx, d.cy, d.cz))]
    assert inside and sum(a for (_, s), (a, _) in want.items() if s is None) >= sum(3.14159 * d.radius**2 for d in inside)


@pytest.fixture(scope="module")
def flat_pairs(tmp_path_factory):
    """Folder whose part table has pairs of discs in one plane, at one place."""
    folder = tmp_path_factory.mktemp("flat")
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (p_partkey + k AS p_partkey) FROM '{FOLDER}/part.parquet', (SELECT unnest([0, 13000]) AS k)) TO '{folder}/part.parquet'")
    return folder


def same_as_sql(spark, name, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder if (folder / f'{t}.parquet').exists() else FOLDER}/{t}.parquet'")
    want = con.execute(catalog.ORACLES[name])
    names = [c[0] for c in want.description]
    got = catalog.QUERIES[name](spark, str(folder))
    assert sorted(got.columns) == sorted(names)
    rows = tidy(want.fetchall(), names)
    assert tidy([tuple(r) for r in got.collect()], got.columns) == rows
    return rows


@pytest.mark.parametrize("name", ["degree_stats", "disc_edges", "disc_neighbours", "inter_set_matrix"])
def test_discs_in_one_plane(spark, flat_pairs, name):
    assert same_as_sql(spark, name, flat_pairs)
    assert len(same_as_sql(spark, "coplanar_edges", flat_pairs)) > 10
