import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratafold.functions import geometry as G
from stratafold.functions import special as S


def area(center, normal, radius, low, high):
    return S.disc_box_areas(*(np.atleast_2d(np.asarray(x, float)) for x in (center, normal)), np.array([radius], float), *(np.atleast_2d(np.asarray(x, float)) for x in (low, high)))[0]


def test_disc_box_area():
    up = (0, 0, 1)
    for high, want in ((2.0, math.pi), (0.0, math.pi / 2)):
        assert abs(area((0, 0, 0), up, 1, (-2, -2, -1), (high, 2, 1)) - want) < 1e-12
    assert abs(area((0, 0, 0), up, 1, (0, 0, -1), (2, 2, 1)) - math.pi / 4) < 1e-12
    assert area((0, 0, 0), up, 1, (5, 5, 5), (6, 6, 6)) == 0.0
    # inside the disc; beside its plane; in a face; a square cut off by chords
    assert abs(area((0, 0, 0), up, 9, (-1, -1, -1), (1, 2, 1)) - 6) < 1e-12
    assert area((0, 0, 0), up, 1, (-1, -1, 0.5), (1, 1, 1)) == 0.0
    assert abs(area((0, 0, 0), up, 1, (-1, -1, 0), (1, 1, 1)) - math.pi) < 1e-12
    # the plane holds an edge of the box: one line of two faces
    s = math.sqrt(0.5)
    assert abs(area((0, 0, 0), (s, s, 0), 1, (-9, 0, -9), (0, 9, 9)) - math.pi / 2) < 1e-12
    assert area((0, 0, 0), (s, s, 0), 1, (0, 0, -9), (9, 9, 9)) < 1e-12


def test_disc_area_is_conserved_over_cells():
    r = np.random.default_rng(3)
    cells = np.array([(i, j, k) for i in range(4) for j in range(4) for k in range(4)], float) * 2.5
    normals = [n / np.linalg.norm(n) for n in r.normal(size=(40, 3))] + [np.array(n, float) for n in ((1, 0, 0), (0, 1, 0), (0.6, 0.8, 0), (0, -0.6, 0.8))]
    for n in normals:
        center, radius = r.uniform(3, 7, 3), r.uniform(0.2, 2.9)
        areas = S.disc_box_areas(np.tile(center, (64, 1)), np.tile(n, (64, 1)), np.full(64, radius), cells, cells + 2.5)
        assert abs(areas.sum() - math.pi * radius**2) < 1e-9


def test_disc_area_against_sampled_points():
    r = np.random.default_rng(4)
    for _ in range(60):
        n = r.normal(size=3)
        n /= np.linalg.norm(n)
        u = np.cross(n, r.normal(size=3))
        u /= np.linalg.norm(u)
        c, radius, low = r.uniform(-1, 1, 3), r.uniform(0.3, 2), r.uniform(-2, 0, 3)
        high = low + r.uniform(0.2, 2.5, 3)
        rho, phi = radius * np.sqrt(r.random(40_000)), 2 * math.pi * r.random(40_000)
        points = c + np.outer(rho * np.cos(phi), u) + np.outer(rho * np.sin(phi), np.cross(n, u))
        share = ((points >= low) & (points <= high)).all(1).mean()
        assert abs(area(c, n, radius, low, high) / (math.pi * radius**2) - share) < 0.012


def test_quantiles_and_intervals():
    assert abs(S.normal_quantile(0.975) - 1.959963984540054) < 1e-9
    assert abs(S.chi2_quantile_even(0.95, 1) - 5.991464547107979) < 1e-8
    assert abs(S.chi2_quantile_even(0.5, 5) - 9.341817765591) < 1e-6
    low, high = S.poisson_interval(0, 10.0)
    assert low == 0 and abs(high - 0.3688879454113936) < 1e-8


def test_exposure():
    assert abs(S.exposure(1000.0, [1.0])[0] - 0.999) < 1e-4
    assert abs(S.exposure(0.0, [0.3])[0] - 0.5) < 1e-6
    r = np.random.default_rng(1)
    k, c = 8.0, 0.4
    w = 1 + np.log(r.random(400_000) * (1 - math.exp(-2 * k)) + math.exp(-2 * k)) / k
    f = r.random(400_000) * 2 * math.pi
    mc = np.abs(c * w + math.sqrt(1 - c * c) * np.sqrt(1 - w * w) * np.cos(f)).mean()
    assert abs(S.exposure(k, [c])[0] - mc) < 2e-3


@pytest.mark.parametrize("law,p", [("uniform", {}), ("power", {"exponent": 1.7}), ("exponential", {"rate": 0.6}), ("lognormal", {"mu": 0.3, "sigma": 0.6})])
def test_size_laws(law, p):
    u = (np.arange(20_000) + 0.5) / 20_000
    radii = S.sample_radius(law, 0.5, 4.0, u if law != "lognormal" else u[::20], **p)
    assert radii.min() >= 0.5 - 1e-9 and radii.max() <= 4.0 + 1e-9
    for order in (1, 2):
        assert abs(S.size_moment(law, 0.5, 4.0, order, **p) / np.mean(radii**order) - 1) < 5e-3
    a, b = S.class_thresholds(law, 0.5, 4.0, **p)
    area = radii**2
    assert abs(area[radii < a].sum() / area.sum() - 0.1) < 0.02 and abs(area[radii < b].sum() / area.sum() - 0.7) < 0.02
    assert abs(S.area_share(law, 0.5, 4.0, 4.0, **p) - 1) < 1e-9


def test_size_fit_prefers_the_law_that_made_the_sample():
    x = S.sample_radius("power", 0.5, 5.0, (np.arange(4000) + 0.5) / 4000, exponent=2.0)
    best = S.fit_sizes(len(x), x.sum(), np.log(x).sum(), (np.log(x) ** 2).sum(), x.min(), x.max())[0]
    assert best["law"] == "power" and abs(best["parameters"]["exponent"] - 2) < 0.05


def test_orientation_round_trip(spark):
    rows = [(d, p) for d in (0.0, 45.0, 90.0, 200.0, 359.0) for p in (0.0, 10.0, 60.0, 90.0)]
    frame = spark.createDataFrame(rows, "dd double, dip double")
    back = G.orientation(G.plane_normal("dd", "dip"))
    for r in frame.select("dd", "dip", back[0].alias("a"), back[1].alias("b")).collect():
        assert abs(r.b - r.dip) < 1e-6 and (r.dip == 0 or min(abs(r.a - r.dd), 360 - abs(r.a - r.dd)) < 1e-6 or (r.dip == 90 and abs(abs(r.a - r.dd) - 180) < 1e-6))
    assert spark.createDataFrame([(None, 5.0)], "dd double, dip double").select(G.plane_normal("dd", "dip")[0].alias("x")).first().x is None


def test_uniform_depends_on_keys_only(spark):
    f = spark.range(100)
    a = {r.id: r.u for r in f.repartition(1).select("id", G.uniform(5, "id", 1).alias("u")).collect()}
    b = {r.id: r.u for r in f.repartition(7).select("id", G.uniform(5, "id", 1).alias("u")).collect()}
    assert a == b and 0 <= min(a.values()) and max(a.values()) < 1 and abs(sum(a.values()) / 100 - 0.5) < 0.12


def test_polygon(spark):
    square = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), F.lit(1.0).alias("z")) for x, y in ((0, 0), (2, 0), (2, 3), (0, 3))])
    assert abs(spark.range(1).select(G.polygon_area(square).alias("a")).first().a - 6) < 1e-12
