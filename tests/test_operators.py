import math
import random

import pytest
from pyspark.sql import functions as F

from stratafold.operators import discs as D
from stratafold.operators import fields, holes, intake, intensity, orientations
from stratafold.sources import tables


@pytest.fixture(scope="module")
def hole(spark):
    collars = spark.createDataFrame([(1, 0.0, 0.0, 20.0, 0.0, -90.0, 20.0)], "hole_id long, collar_x double, collar_y double, collar_z double, azimuth double, dip double, final_depth double")
    surveys = spark.createDataFrame([], "hole_id long, measured_depth double, azimuth double, dip double")
    fractures = spark.createDataFrame([(1, 5.0, 0.0, 0.0, 1), (1, 10.0, 0.0, 0.0, 1), (1, 20.0, 0.0, 0.0, 1)], "hole_id long, depth double, dip_direction double, dip double, set_id int")
    return collars, surveys, fractures


def test_p10_and_p32_of_a_vertical_hole(spark, hole):
    collars, surveys, fractures = hole
    p10 = intensity.p10_intervals(fractures, collars, 10.0, [1, 2])
    got = {(r.from_depth, r.set_id): (r.n_fractures, r.p10, r.data_state) for r in p10.collect()}
    assert got == {(0.0, 1): (1, 0.1, "modeled_value"), (10.0, 1): (2, 0.2, "modeled_value"), (0.0, 2): (0, 0.0, "true_zero"), (10.0, 2): (0, 0.0, "true_zero")}
    model = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1000.0)], "set_id int, nx double, ny double, nz double, kappa double")
    pieces = holes.direction_pieces(holes.trajectory(collars, surveys), p10.select("hole_id", "from_depth", "to_depth").distinct())
    r = intensity.p32(p10, intensity.effective_lengths(pieces, model)).first()
    assert 0.99 < r.mean_exposure <= 1 and abs(r.p32 - 0.15) < 0.005 and r.observability == "ADEQUATE" and r.ci95_low < r.p32 < r.ci95_high


def test_curved_hole_keeps_its_arc_length(spark):
    collars = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0, -90.0, 100.0)], "hole_id long, collar_x double, collar_y double, collar_z double, azimuth double, dip double, final_depth double")
    surveys = spark.createDataFrame([(1, 0.0, 0.0, -90.0), (1, 100.0, 90.0, 0.0)], "hole_id long, measured_depth double, azimuth double, dip double")
    p = sorted(holes.trajectory(collars, surveys, 1.0).collect(), key=lambda r: r.idx)
    radius = 100 / (math.pi / 2)
    assert len(p) == 101 and abs(p[-1].x - radius) < 1e-9 and abs(p[-1].z + radius) < 1e-9
    assert abs(sum(math.dist((a.x, a.y, a.z), (b.x, b.y, b.z)) for a, b in zip(p, p[1:])) - 100) < 0.01
    q = holes.at_depth(spark.createDataFrame([(1, 50.0)], "hole_id long, depth double"), collars, surveys).first()
    assert abs(q.x - p[50].x) < 1e-9 and abs(q.z - p[50].z) < 1e-9


def test_idw_and_kriging(spark):
    samples = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 2.0, 1), (2, 10.0, 0.0, 0.0, 8.0, 1), (3, 0.0, 0.0, 0.0, 99.0, 2)], "sample_id long, x double, y double, z double, value double, domain_id int")
    targets = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1), (2, 5.0, 0.0, 0.0, 1), (3, 5.0, 0.0, 0.0, 3)], "t long, x double, y double, z double, domain_id int")
    got = {r.t: r.value for r in fields.idw(targets, samples, "t", 8, 50.0, same=["domain_id"]).collect()}
    assert got == {1: 2.0, 2: 5.0}
    flat = spark.createDataFrame([(i, x, y, z, 7.5) for i, (x, y, z) in enumerate([(0.0, 0.0, 0.0), (10.0, 0.0, 0.0), (0.0, 10.0, 0.0), (0.0, 0.0, 10.0)])], "sample_id long, x double, y double, z double, value double")
    at = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 3.0, 3.0, 3.0)], "t long, x double, y double, z double")
    k = {r.t: r for r in fields.kriged(at, flat, "t", "spherical", 0.0, 1.0, 20.0).collect()}
    assert k[0].variance == 0 and abs(k[1].value - 7.5) < 1e-9 and k[1].variance >= 0
    assert {(r.t, r.value) for r in fields.kriged(at.repartition(3), flat, "t", "spherical", 0.0, 1.0, 20.0).collect()} == {(t, r.value) for t, r in k.items()}


def test_discs_in_cells(spark):
    schema = "ordinal long, cx double, cy double, cz double, radius double, dip_direction double, dip double, set_id int"
    two = D.with_boxes(spark.createDataFrame([(1, 1.0, 0.5, 0.5, 0.25, 0.0, 0.0, 1)], schema))
    got = sorted((r.flat, r.area) for r in D.voxel_areas(two, (0, 0, 0), (1, 1, 1), (2, 1, 1)).collect())
    assert len(got) == 2 and all(abs(a - math.pi * 0.0625 / 2) < 1e-9 for _, a in got)
    face = D.with_boxes(spark.createDataFrame([(1, 0.5, 0.5, 1.0, 0.25, 0.0, 0.0, 1)], schema))
    got = [(r.flat, r.area) for r in D.voxel_areas(face, (0, 0, 0), (1, 1, 1), (1, 1, 2)).collect()]
    assert len(got) == 1 and got[0][0] == 1 and abs(got[0][1] - math.pi * 0.0625) < 1e-9


def test_discs_that_touch(spark):
    schema = "ordinal long, cx double, cy double, cz double, radius double, dip_direction double, dip double, set_id int"
    rows = [(1, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 1), (2, 0.0, 0.0, 0.0, 1.0, 0.0, 90.0, 2), (3, 5.0, 5.0, 5.0, 1.0, 0.0, 0.0, 1), (4, 1.5, 0.0, 0.0, 1.0, 0.0, 0.0, 1), (5, 0.0, 0.0, 0.5, 1.0, 0.0, 0.0, 1)]
    links = D.edges(spark.createDataFrame(rows, schema), 2.0)
    got = {(r.a, r.b): round(r.contact, 9) for r in links.collect()}
    assert got == {(1, 2): 2.0, (1, 4): 0.0, (2, 4): 0.5, (2, 5): round(2 * math.sqrt(0.75), 9)}
    labels = {r.node: r.component for r in D.components(spark.createDataFrame([(i,) for i in range(1, 6)], "node long"), links).collect()}
    assert labels == {1: 1, 2: 1, 3: 3, 4: 1, 5: 1}


def test_percolation_needs_the_faces(spark):
    schema = "ordinal long, cx double, cy double, cz double, radius double, dip_direction double, dip double, set_id int"
    rows = [(1, 5.0, 5.0, 5.0, 6.0, 90.0, 0.0, 1), (2, 5.0, 50.0, 5.0, 6.0, 90.0, 0.0, 1), (3, 0.5, 5.0, 5.0, 1.0, 90.0, 0.0, 1), (4, 5.0, 5.0, 30.0, 40.0, 0.0, 0.0, 1), (5, 5.0, 5.0, 5.0, 6.0, 90.0, 90.0, 1)]
    d = spark.createDataFrame(rows, schema)
    labels = d.select(F.col("ordinal").alias("node"), F.col("ordinal").alias("component"))
    got = {r.component: (r.spans_x, r.spans_y, r.spans_z, r.spans_any) for r in D.percolation(D.with_boxes(d), labels, (0, 0, 0), (10, 10, 10)).collect()}
    # 2 lies beside the box, 4 above it, 3 touches one face, 5 stands across x
    assert got == {1: (True, True, False, True), 2: (False,) * 4, 3: (False,) * 4, 4: (False,) * 4, 5: (False, True, True, True)}


def test_records(spark, hole):
    collars = hole[0]
    rows = spark.createDataFrame([(1, 1, 0.0, 5.0), (2, 1, 5.0, 4.0), (3, 9, 0.0, 1.0), (4, None, 0.0, 1.0), (5, 1, 0.0, 25.0), (6, 1, None, 2.0)], "id int, hole_id long, from_depth double, to_depth double")
    got = {r.id: r.state for r in intake.classify_intervals(rows, collars).collect()}
    assert got == {1: "FORMAL", 2: "EXCLUDED", 3: "PENDING", 4: "EXCLUDED", 5: "EXCLUDED", 6: "EXCLUDED"}
    nested = spark.createDataFrame([(1, 1, 0.0, 100.0), (2, 1, 10.0, 20.0), (3, 1, 30.0, 40.0)], "id int, hole_id long, from_depth double, to_depth double")
    assert {r.id for r in intake.running_overlaps(nested, ["hole_id"], "id").collect()} == {2, 3}
    assert {r.id for r in intake.adjacent_overlaps(nested, ["hole_id"], "id").collect()} == {2}


def test_kmeans_finds_axes(spark):
    rows = [(i, d + (i % 5) * 0.5, p + (i % 3) * 0.5) for i, (d, p) in enumerate([(30.0, 60.0), (200.0, 20.0), (120.0, 85.0)] * 40)]
    f = orientations.with_normals(spark.createDataFrame(rows, "id int, dip_direction double, dip double"))
    out, centers = orientations.axial_kmeans(f, 3, 1)
    groups = {}
    for r in out.collect():
        groups.setdefault(r.id % 3, set()).add(r.cluster)
    assert len(centers) == 3 and sorted(len(g) for g in groups.values()) == [1, 1, 1] and len(set.union(*groups.values())) == 3


def test_sources(spark, tmp_path):
    (tmp_path / "c.csv").write_text("HoleName,East,North,RL,HoleLength,\nA,1,2,3,50,\nB,x,2,3,20,\n")
    c = tables.standard_table(tables.read_text_table(spark, str(tmp_path / "c.csv")), "collars")
    got = {r.hole_id: r for r in c.collect()}
    assert got["A"].collar_x == 1 and got["B"].collar_x is None and got["B"].original_values["East"] == "x"
    for table, fields in tables.ALIASES.items():
        for field, names in fields.items():
            assert all(tables.detect_mapping([n.upper(), "other"], table) == ({n.upper(): field}, []) for n in names)
    assert tables.detect_mapping(["Hole-ID", "East", "easting", "\ufeff AZ "], "collars") == ({"Hole-ID": "borehole_id", "\ufeff AZ ": "azimuth"}, ["collar_x"])
    head = ",".join(tables.DISC_COLUMNS)
    (tmp_path / "d.csv").write_text(f"{head}\na,1,2,3,10,20,5,fault,\nb,1,2,3,10,20,5,fault,2\n")
    assert [(r.structure_id, r.radius, r.domain_id) for r in tables.read_discs(spark, str(tmp_path / "d.csv")).collect()] == [("a", 5.0, None), ("b", 5.0, 2)]
    for line in ("a,1,x,3,10,20,5,fault,", "a,1,2,3,10,20,inf,fault,", "a,1,2,3,10,20,5,fault,k", "b,1,2,3,10,20,5,fault,1\nb,1,2,3,10,20,5,fault,1"):
        (tmp_path / "d2.csv").write_text(f"{head}\n{line}\n")
        with pytest.raises(ValueError):
            tables.read_discs(spark, str(tmp_path / "d2.csv"))
    (tmp_path / "bad.csv").write_text("a,\n1,2\n")
    with pytest.raises(ValueError):
        tables.read_text_table(spark, str(tmp_path / "bad.csv"))
    with pytest.raises(ValueError):
        tables.read_text_table(spark, "x.xlsx")
    (tmp_path / "w.las").write_text("~V\nVERS. 2.0 : v\n~W\nWELL. K1 : well\nNULL. -999.25 : null\n~C\nDEPT.M : depth\nGR.API : gamma\n~A\n1.0 50.5\n2.0 -999.25\n")
    assert [(r.well, r.depth, r.curve, r.value) for r in tables.read_las(spark, str(tmp_path / "w.las")).collect()] == [("K1", 1.0, "GR", 50.5)]
    tables.save_project({"collars": c.drop("original_values")}, str(tmp_path / "p"))
    assert tables.open_project(spark, str(tmp_path / "p"))["collars"].count() == 2
    tables.save_project({"collars": c.drop("original_values").limit(1)}, str(tmp_path / "p"))
    assert tables.open_project(spark, str(tmp_path / "p"))["collars"].count() == 1
    (tmp_path / "p" / "manifests" / "000000000002" / "_SUCCESS").unlink()
    good = spark.createDataFrame([("A", 0.0, 5.0, "rqd", 50.0, "%")], "hole_id string, from_depth double, to_depth double, parameter_name string, value double, unit string")
    assert tables.import_scalars(good, c, {"rqd": (0, 100)}).count() == 1
    with pytest.raises(ValueError):
        tables.import_scalars(good.withColumn("value", F.lit(float("inf"))), c)
    with pytest.raises(ValueError):
        tables.import_scalars(good.withColumnRenamed("hole_id", "h").selectExpr("'Z' as hole_id", "from_depth", "to_depth", "parameter_name", "value", "unit"), c)


def test_streamed_counts_equal_batch(spark):
    from stratafold.streaming import records

    path = "/root/testdata/sf0.001"
    schema = spark.read.parquet(f"{path}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(path)
    q = records.windowed_counts(stream, late="3650 days").writeStream.outputMode("complete").format("memory").queryName("counted").start()
    q.processAllAvailable()
    got = {(r.window_start, r.event_type): r.n for r in spark.table("counted").collect()}
    q.stop()
    assert got == {(r.window_start, r.event_type): r.n for r in records.windowed_counts(spark.read.parquet(f"{path}/events.parquet")).collect()}


def test_variogram_of_samples_at_shared_places(spark):
    rows = [(i, float(i * 7 % 5), float(i * 3 % 4), float(i % 2), None if i % 9 == 0 else float(i * 31 % 17)) for i in range(200)]
    got = fields.variogram_lags(spark.createDataFrame(rows, "sample_id long, x double, y double, z double, value double"), 4, 4.0)
    # the pairs of places are made, not those of samples
    assert len({r[1:4] for r in rows}) == 20
    want = {}
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            d = math.dist(a[1:4], b[1:4])
            if 0 < d <= 4:
                n, far, known = want.setdefault(max(math.ceil(d - 1e-12) - 1, 0), [0, 0.0, []])
                want[max(math.ceil(d - 1e-12) - 1, 0)][:2] = n + 1, far + d
                known += [] if None in (a[4], b[4]) else [(a[4] - b[4]) ** 2]
    got = {r.lag: (r.n_pairs, pytest.approx(r.distance), pytest.approx(r.semivariance)) for r in got.collect()}
    assert got == {k: (n, far / n, sum(known) / len(known) / 2) for k, (n, far, known) in want.items()}


def test_variogram_makes_pairs_of_places_only(spark):
    samples = spark.range(6000).selectExpr("id as sample_id", "cast(id % 3 as double) as x", "0d as y", "0d as z", "cast(id % 7 as double) as value")
    lags = fields.variogram_lags(samples, 2, 2.0)
    made = []
    rows = {r.lag: r.n_pairs for r in lags.collect()}
    plan = lags._jdf.queryExecution().executedPlan()
    stack = [plan]
    while stack:
        node = stack.pop()
        if "Join" in node.nodeName():
            made.append(node.metrics().apply("numOutputRows").value())
        if hasattr(node, "executedPlan") and "AdaptiveSparkPlan" in node.nodeName():
            stack.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            stack.append(node.plan())
        else:
            stack += [node.children().apply(i) for i in range(node.children().size())]
    assert rows == {0: 2 * 2000**2, 1: 2000**2} and made and max(made) < 100


def test_nearest_of_many_samples_at_a_place(spark):
    samples = spark.range(6000).selectExpr("id as sample_id", "cast(id % 3 as double) as x", "0d as y", "0d as z", "cast(id as double) as value", "cast(id % 2 as int) as set_id")
    targets = spark.createDataFrame([(1, 0.2, 0.0, 0.0, 0), (2, 1.5, 0.0, 0.0, 1), (3, 9.0, 0.0, 0.0, 1)], "t long, x double, y double, z double, set_id int")
    near = fields.k_nearest(targets, samples, "t", 4, 1.4, same=["set_id"])
    got = {(r.t, r.rank): r.sample_id for r in near.collect()}
    assert got == {(1, i + 1): 6 * i for i in range(4)} | {(2, i + 1): s for i, s in enumerate((1, 5, 7, 11))}
    # no exploded side is broadcast, and each place gives k samples at most
    plan = near._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" not in plan and "__order" in plan


def test_links_that_join_clusters(spark):
    r = random.Random(4)
    schema = "ordinal long, cx double, cy double, cz double, radius double, dip_direction double, dip double, set_id int"
    for n, side in ((400, 8), (700, 30), (2, 1)):
        spots = [[r.uniform(0, side) for _ in range(3)] for _ in range(n)]
        rows = [(i, *r.choice(spots[: n // 2 + 1]), r.choice([0.3, 1.0, 2.0]), float(r.randrange(0, 360, 30)), float(r.choice([0, 0, 30, 90])), 1) for i in range(n)]
        discs = spark.createDataFrame(rows, schema)
        nodes = discs.select(F.col("ordinal").alias("node"))
        for coplanar in (True, False):
            links = D.linked(discs, 2.0, coplanar)
            edges = D.edges(discs, 2.0, coplanar).collect()
            above = list(range(n))
            for e in edges:
                a, b = e.a, e.b
                while above[a] != a:
                    a = above[a]
                while above[b] != b:
                    b = above[b]
                above[max(a, b)] = min(a, b)
            want = {}
            for i in range(n):
                k = i
                while above[k] != k:
                    k = above[k]
                want[i] = k
            assert {x.node: x.component for x in D.components(nodes, links).collect()} == want


def test_a_dense_cluster_has_few_links(spark):
    schema = "ordinal long, cx double, cy double, cz double, radius double, dip_direction double, dip double, set_id int"
    discs = spark.createDataFrame([(i, 5.0, 5.0, 5.0, 1.0, float(i), 40.0, 1) for i in range(300)], schema)
    assert D.edges(discs, 10.0).count() == 300 * 299 // 2
    assert {(x.a, x.b) for x in D.linked(discs, 10.0).collect()} == {(0, i) for i in range(1, 300)}


def test_spheres_of_one_centre_are_paired_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 4)
    r = random.Random(2)
    spots = [[r.uniform(0, 6) for _ in range(3)] for _ in range(12)]
    rows = [(i, *r.choice(spots), r.uniform(0.1, 1.5)) for i in range(150)]
    pairs = D.near_pairs(spark.createDataFrame(rows, "ordinal long, cx double, cy double, cz double, radius double"), 2.0)
    got = [tuple(x) for x in pairs.collect()]
    want = {(*a, *b) for a in rows for b in rows if a[0] < b[0] and math.dist(a[1:4], b[1:4]) <= a[4] + b[4]}
    assert len(got) == len(want) and set(got) == want


def test_labels_join_clusters_not_their_discs(spark, monkeypatch):
    r = random.Random(6)
    schema = "ordinal long, cx double, cy double, cz double, radius double, dip_direction double, dip double, set_id int"
    spots = [[r.uniform(0, 12) for _ in range(3)] for _ in range(15)]
    rows = [(i, *r.choice(spots), r.choice([0.3, 1.0, 2.0]), float(r.randrange(360)), float(r.randrange(91)), 1) for i in range(600)]
    discs = spark.createDataFrame([*rows, (600, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 1)], schema)
    want = {x.node: x.component for x in D.components(discs.select(F.col("ordinal").alias("node")), D.edges(discs, 2.0)).collect()}
    counted, plain = [], D.components
    monkeypatch.setattr(D, "components", lambda nodes, links: counted.append(links.distinct().count()) or plain(nodes, links))
    assert {x.node: x.component for x in D.disc_labels(discs, 2.0).collect()} == want
    # a name for each cluster of a cube, and each place is in few cubes
    assert D.linked(discs, 2.0).count() > 1000 and counted[0] < 300
