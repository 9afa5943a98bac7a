"""Discs in space: bounding boxes, contacts, connected clusters, percolation, areas in voxels and their conservation."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import special

#: Discs of one centre that are paired together.
BLOCK = 256
#: Pairs of discs that are looked at together in `linked`.
MATRIX = 1 << 18
#: Pairs of discs found and not found yet that are looked at together there.
FRONT = 1 << 15


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a local folder if driver and executors are one process, else the warehouse."""
    alone = spark.sparkContext.master.split("[")[0] == "local"
    return (spark.conf.get("spark.checkpoint.dir", None) or ("file:///tmp/checkpoints" if alone else spark.conf.get("spark.sql.warehouse.dir"))).rstrip("/")


def written(frame: DataFrame, label: str) -> DataFrame:
    """Cuts the lineage by a table in the folder that all executors share."""
    path = f"{shared_folder(frame.sparkSession)}/{label}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def with_boxes(discs: DataFrame) -> DataFrame:
    """Discs with normals nx, ny, nz, area and the tight bounding box low_x.. high_z."""
    d = discs.withColumns(dict(zip(("nx", "ny", "nz"), G.plane_normal("dip_direction", "dip"), strict=True)))
    reach = G.disc_reach(G.vector("nx", "ny", "nz"), "radius")
    boxes = {f"low_{k}": F.col(f"c{k}") - r for k, r in zip("xyz", reach, strict=True)} | {f"high_{k}": F.col(f"c{k}") + r for k, r in zip("xyz", reach, strict=True)}
    return d.withColumns(boxes).withColumn("area", F.lit(np.pi) * F.col("radius") * F.col("radius"))


def near_pairs(discs: DataFrame, cell: float, ident: str = "ordinal") -> DataFrame:
    """Pairs a < b of discs whose bounding spheres meet, each once.

    Discs with one centre are taken together, BLOCK at most of similar radius. The boxes of blocks are spread over cubes; two
    blocks meet only in the cube that holds the low corner of their boxes' overlap, so no distinct is needed, and their
    discs are paired then.
    """
    cols = list(discs.columns)
    centre = ["cx", "cy", "cz"]
    place = F.row_number().over(Window.partitionBy(*centre).orderBy("radius", ident))
    numbered = discs.withColumn("block", F.floor((place - 1) / BLOCK))
    rest = [c for c in cols if c not in centre]
    blocks = numbered.groupBy(*centre, "block").agg(F.max("radius").alias("reach"), F.collect_list(F.struct(*rest)).alias("discs"))
    spread = blocks
    for k in "xyz":
        low, high = F.floor((F.col(f"c{k}") - F.col("reach")) / cell), F.floor((F.col(f"c{k}") + F.col("reach")) / cell)
        spread = spread.withColumn(f"g{k}", F.explode(F.sequence(low, high)))
    of = lambda side: spread.select(*[F.col(c).alias(f"{side}_{c}") for c in (*centre, "block", "reach", "discs")], "gx", "gy", "gz")
    one, two = (F.struct(*[f"{side}_{c}" for c in (*centre, "block")]) for side in "pq")
    # by a merge: neither the explosion nor the lists show in the sizes by which a side is taken for small
    j = of("p").hint("merge").join(of("q"), ["gx", "gy", "gz"]).filter(one <= two)
    owner = F.lit(True)
    for k in "xyz":
        corner = F.greatest(F.col(f"p_c{k}") - F.col("p_reach"), F.col(f"q_c{k}") - F.col("q_reach"))
        owner = owner & (F.col(f"g{k}") == F.floor(corner / cell))
    gap = sum((F.col(f"p_c{k}") - F.col(f"q_c{k}")) ** 2 for k in "xyz")
    j = j.withColumn("gap", gap).filter(owner & (F.col("gap") <= (F.col("p_reach") + F.col("q_reach")) ** 2))
    j = j.withColumn("alone", one == two).drop("gx", "gy", "gz", "p_reach", "q_reach", "p_block", "q_block").withColumn("p", F.explode("p_discs")).drop("p_discs").withColumn("q", F.explode("q_discs")).drop("q_discs")
    first, second = F.col(f"p.{ident}"), F.col(f"q.{ident}")
    j = j.filter((F.col("gap") <= (F.col("p.radius") + F.col("q.radius")) ** 2) & ((first < second) | (~F.col("alone") & (second < first))))
    at = lambda side, c: F.col(f"{side}_{c}" if c in centre else f"{side}.{c}")
    pick = lambda c, a, b: F.when(first < second, at(a, c)).otherwise(at(b, c))
    return j.select(*[pick(c, "p", "q").alias(f"a_{c}") for c in cols], *[pick(c, "q", "p").alias(f"b_{c}") for c in cols])


def with_contact(pairs: DataFrame) -> DataFrame:
    """Pairs (a_, b_ with normals) with contact: the length of the chord that the discs share, 0 without one.

    Worked out in steps of plain columns, so that no expression is repeated in the generated code. Parallel planes share none.
    """
    na, nb = G.vector("a_nx", "a_ny", "a_nz"), G.vector("b_nx", "b_ny", "b_nz")
    ca, cb = G.vector("a_cx", "a_cy", "a_cz"), G.vector("b_cx", "b_cy", "b_cz")
    line = G.cross(na, nb)
    out = pairs.withColumns({"__lx": line[0], "__ly": line[1], "__lz": line[2], "__c": G.dot(na, nb), "__ha": G.dot(na, ca), "__hb": G.dot(nb, cb)})
    out = out.withColumn("__s2", G.dot(*[G.vector("__lx", "__ly", "__lz")] * 2))
    out = out.withColumn("__ok", F.col("__s2") > 1e-18).withColumn("__size", F.when(F.col("__ok"), F.sqrt("__s2")).otherwise(1.0)).withColumn("__det", F.when(F.col("__ok"), 1 - F.col("__c") * F.col("__c")).otherwise(1.0))
    out = out.withColumns({f"__d{k}": F.col(f"__l{k}") / F.col("__size") for k in "xyz"} | {"__u": (F.col("__ha") - F.col("__hb") * F.col("__c")) / F.col("__det"), "__w": (F.col("__hb") - F.col("__ha") * F.col("__c")) / F.col("__det")})
    out = out.withColumns({f"__o{k}": F.col("__u") * F.col(f"a_n{k}") + F.col("__w") * F.col(f"b_n{k}") for k in "xyz"})
    point, d = G.vector("__ox", "__oy", "__oz"), G.vector("__dx", "__dy", "__dz")
    out = out.withColumns({"__ta": G.dot(G.minus(ca, point), d), "__tb": G.dot(G.minus(cb, point), d)})
    for s, c in (("a", ca), ("b", cb)):
        off = G.minus(c, G.plus(point, G.scaled(d, F.col(f"__t{s}"))))
        out = out.withColumn(f"__v{s}", F.col(f"{s}_radius") * F.col(f"{s}_radius") - G.dot(off, off))
        out = out.withColumn(f"__r{s}", F.sqrt(F.greatest(F.lit(0.0), F.col(f"__v{s}"))))
    has = F.col("__ok") & (F.col("__va") >= 0) & (F.col("__vb") >= 0)
    shared = F.least(F.col("__ta") + F.col("__ra"), F.col("__tb") + F.col("__rb")) - F.greatest(F.col("__ta") - F.col("__ra"), F.col("__tb") - F.col("__rb"))
    out = out.withColumn("contact", F.when(has, F.greatest(F.lit(0.0), shared)).otherwise(0.0))
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def coplanar_contact() -> Column:
    na, nb = G.vector("a_nx", "a_ny", "a_nz"), G.vector("b_nx", "b_ny", "b_nz")
    between = G.minus(G.vector("b_cx", "b_cy", "b_cz"), G.vector("a_cx", "a_cy", "a_cz"))
    parallel = G.dot(G.cross(na, nb), G.cross(na, nb)) <= 1e-18
    return parallel & (F.abs(G.dot(between, na)) <= 1e-9) & (G.length(between) <= F.col("a_radius") + F.col("b_radius"))


def edges(discs: DataFrame, cell: float, coplanar: bool = True) -> DataFrame:
    """a, b, set_a, set_b, contact: discs that touch, with the length of their chord; with `coplanar` also those that overlap in one plane, with contact 0."""
    slim = with_boxes(discs).select("ordinal", "set_id", "cx", "cy", "cz", "radius", "nx", "ny", "nz")
    pairs = with_contact(near_pairs(slim, cell)).withColumn("flat", coplanar_contact())
    # through a generator: a filter on contact would be pushed below the steps, and repeat all of them in one expression
    kept = F.filter(F.array(F.struct("contact", "flat")), lambda x: (x["contact"] > 1e-9) | (x["flat"] & F.lit(coplanar)))
    out = pairs.select(F.col("a_ordinal").alias("a"), F.col("b_ordinal").alias("b"), F.col("a_set_id").alias("set_a"), F.col("b_set_id").alias("set_b"), F.explode_outer(kept).alias("x"))
    return out.filter("x is not null").select("a", "b", "set_a", "set_b", "x.contact")


def _touching(d: np.ndarray, i: np.ndarray, j: np.ndarray, coplanar: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places in i and j of the pairs of discs that touch, by the steps of `with_contact` and `coplanar_contact`. Columns of d: centre, radius, normal."""
    gap = (d[i, None, 0] - d[None, j, 0]) ** 2 + (d[i, None, 1] - d[None, j, 1]) ** 2 + (d[i, None, 2] - d[None, j, 2]) ** 2
    p, q = np.nonzero(gap <= (d[i, None, 3] + d[None, j, 3]) ** 2)
    # a disc that doesn't reach the other's plane shares no chord; where planes are nearly parallel only the steps below decide
    one, two = d[i[p]], d[j[q]]
    far = one[:, :3] - two[:, :3]
    reach = (np.abs((far * one[:, 4:7]).sum(1)) <= two[:, 3] + 1e-5) & (np.abs((far * two[:, 4:7]).sum(1)) <= one[:, 3] + 1e-5)
    reach |= np.abs((one[:, 4:7] * two[:, 4:7]).sum(1)) > 1 - 1e-6
    p, q = p[reach], q[reach]
    # the lower row is a, as in the pairs
    a, b = np.minimum(i[p], j[q]), np.maximum(i[p], j[q])
    ca, cb, ra, rb, na, nb = d[a, 0:3].T, d[b, 0:3].T, d[a, 3], d[b, 3], d[a, 4:7].T, d[b, 4:7].T
    dot = lambda x, y: x[0] * y[0] + x[1] * y[1] + x[2] * y[2]
    line = np.stack([na[1] * nb[2] - na[2] * nb[1], na[2] * nb[0] - na[0] * nb[2], na[0] * nb[1] - na[1] * nb[0]])
    s2, c, ha, hb = dot(line, line), dot(na, nb), dot(na, ca), dot(nb, cb)
    ok = s2 > 1e-18
    size, det = np.sqrt(np.where(ok, s2, 1.0)), np.where(ok, 1 - c * c, 1.0)
    det = np.where(det == 0, 1.0, det)
    way, u, w = line / size, (ha - hb * c) / det, (hb - ha * c) / det
    point = u * na + w * nb
    ta, tb = dot(ca - point, way), dot(cb - point, way)
    offa, offb = ca - (point + way * ta), cb - (point + way * tb)
    va, vb = ra * ra - dot(offa, offa), rb * rb - dot(offb, offb)
    xa, xb = np.sqrt(np.maximum(va, 0)), np.sqrt(np.maximum(vb, 0))
    hit = ok & (va >= 0) & (vb >= 0) & (np.minimum(ta + xa, tb + xb) - np.maximum(ta - xa, tb - xb) > 1e-9)
    if coplanar:
        between = cb - ca
        hit |= ~ok & (np.abs(dot(between, na)) <= 1e-9) & (np.sqrt(dot(between, between)) <= ra + rb)
    return p[hit], q[hit]


def _forest(d: np.ndarray, coplanar: bool) -> np.ndarray:
    """For each disc a lesser or equal row of its cluster, the same for all of the cluster.

    A disc that is found is held against those not found yet only. Once such a search finds few, all that are left are
    held against one another.
    """
    root = np.arange(len(d))
    left = np.lexsort(d[:, :3].T)
    found = len(d)
    while len(left) and found > 8:
        cluster = front = left[:1]
        left = left[1:]
        while len(front) and len(left):
            # those found last come first, so that one disc of a centre brings all others there before they are searched for
            part, front = np.split(front, [max(1, FRONT // len(left))])
            away = sum(np.maximum(0, np.maximum(d[part, k].min() - d[left, k], d[left, k] - d[part, k].max())) ** 2 for k in range(3))
            near = np.flatnonzero(away <= ((d[part, 3].max() + d[left, 3]) * (1 + 1e-9)) ** 2)
            _, q = _touching(d, part, left[near], coplanar)
            hit = np.zeros(len(left), bool)
            hit[near[q]] = True
            front, cluster, left = np.concatenate([left[hit], front]), np.concatenate([cluster, left[hit]]), left[~hit]
        root[cluster] = cluster.min()
        found = len(cluster)
    while len(left) > 1:
        part = left[: max(1, MATRIX // len(left))]
        p, q = _touching(d, part, left, coplanar)
        a, b = part[p], left[q]
        while True:
            low = np.minimum(root[a], root[b])
            before = root.copy()
            for end in (root[a], root[b], a, b):
                np.minimum.at(root, end, low)
            if (root == before).all():
                break
        left = left[len(part) :]
    while (root[root] != root).any():
        root = root[root]
    return root


def clusters(discs: DataFrame, cell: float, coplanar: bool = True) -> DataFrame:
    """a, b: each disc b with the first disc a, itself perhaps, of its cluster in each cube that it reaches."""
    spread = with_boxes(discs).select("ordinal", "cx", "cy", "cz", "radius", "nx", "ny", "nz").filter("radius >= 0 and cx + cy + cz + nx + ny + nz is not null")
    for k in "xyz":
        low, high = F.floor((F.col(f"c{k}") - F.col("radius")) / cell), F.floor((F.col(f"c{k}") + F.col("radius")) / cell)
        spread = spread.withColumn(f"g{k}", F.explode(F.sequence(low, high)))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("ordinal")
        names = rows.column("ordinal").to_numpy()
        d = np.stack([rows.column(c).to_numpy() for c in ("cx", "cy", "cz", "radius", "nx", "ny", "nz")], 1)
        return pa.table({"a": names[_forest(d, coplanar)], "b": names})

    return spread.groupBy("gx", "gy", "gz").applyInArrow(run, "a long, b long")


def linked(discs: DataFrame, cell: float, coplanar: bool = True) -> DataFrame:
    """a, b: links that join the discs of every cluster, and no others; far fewer than `edges`, with the same components.

    Discs that touch share a cube; for each cube its clusters are worked out, and each disc is linked with its cluster's first.
    """
    return clusters(discs, cell, coplanar).filter("a <> b")


def disc_labels(discs: DataFrame, cell: float, coplanar: bool = True) -> DataFrame:
    """node, component (its least disc) of every disc, as `components` gives them for `linked`.

    The clusters of a cube are joined, not their discs: those that have a disc in common become one. A cluster is named
    by its least disc, so a component's least name is its least disc.
    """
    nodes = discs.select(F.col("ordinal").alias("node"))
    of = written(clusters(discs, cell, coplanar).groupBy("b").agg(F.collect_set("a").alias("a")).select("b", F.array_min("a").alias("a"), F.array_remove("a", F.array_min("a")).alias("more")), "clusters")
    links = of.select("a", F.explode("more").alias("b"))
    named = components(links.select(F.explode(F.array("a", "b")).alias("node")).distinct(), links)
    found = of.select("b", "a").join(named, F.col("a") == F.col("node"), "left").select("b", F.coalesce("component", "a").alias("component"))
    return nodes.join(found, F.col("node") == F.col("b"), "left").select("node", F.coalesce("component", "node").alias("component"))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node, component (its least node) of every node, by alternating large and small stars over written tables."""
    now = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "stars")
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("a", "b"), 20))).first())
    state = mark(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(down.select("a", F.col("m").alias("b"))).distinct()
        now = written(small, "stars")
        before, state = state, mark(now)
        if state == before:
            break
    named = now.select(F.col("a").alias("__a"), F.col("b").alias("__b"))
    return nodes.join(named, F.col("node") == F.col("__a"), "left").select("node", F.coalesce("__b", "node").alias("component"))


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("component").agg(F.count("*").alias("size"))


def degree_stats(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """One row: nodes, edges, mean and greatest degree, nodes without edges."""
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    d = nodes.join(ends, "node", "left").select(F.coalesce("degree", F.lit(0)).alias("degree"))
    return d.agg(F.count("*").alias("n_nodes"), (F.sum("degree") / 2).cast("long").alias("n_edges"), F.avg("degree").alias("mean_degree"), F.max("degree").alias("max_degree"), F.count_if(F.col("degree") == 0).alias("n_isolated"))


def inter_set_matrix(links: DataFrame) -> DataFrame:
    return links.groupBy(F.least("set_a", "set_b").alias("set_a"), F.greatest("set_a", "set_b").alias("set_b")).agg(F.count("*").alias("n_edges"))


def touches_face(axis: str, bound: float, ranges: dict[str, tuple[float, float]]) -> Column:
    """Whether a disc (c, n, radius) meets the rectangle of `ranges` in the plane axis = bound.

    The disc meets the plane in a chord around the foot of its centre, along the direction that lies in both planes; the
    chord is cut by the rectangle's two slabs. A disc parallel to the face has no chord.
    """
    u, v = (k for k in "xyz" if k != axis)
    n, nu, nv = F.col(f"n{axis}"), F.col(f"n{u}"), F.col(f"n{v}")
    flat = 1 - n * n
    slope = F.sqrt(F.when(flat > 1e-12, flat).otherwise(1.0))
    off = (F.lit(float(bound)) - F.col(f"c{axis}")) / slope
    low, high = -F.sqrt(F.greatest(F.lit(0.0), F.col("radius") ** 2 - off * off)), F.sqrt(F.greatest(F.lit(0.0), F.col("radius") ** 2 - off * off))
    hits = (flat > 1e-12) & (F.abs(off) <= F.col("radius"))
    for k, mine, d in ((u, nu, nv / slope), (v, nv, -nu / slope)):
        foot = F.col(f"c{k}") - off * n * mine / slope
        a, b = ((F.lit(float(x)) - foot) for x in ranges[k])
        moves = F.abs(d) > 1e-12
        step = F.when(moves, d).otherwise(1.0)
        low = F.when(moves, F.greatest(low, F.least(a / step, b / step))).otherwise(low)
        high = F.when(moves, F.least(high, F.greatest(a / step, b / step))).otherwise(high)
        hits = hits & (moves | ((a <= 0) & (b >= 0)))
    return hits & (high >= low)


def percolation(boxes: DataFrame, labels: DataFrame, low: tuple, high: tuple) -> DataFrame:
    """component, size, and whether its discs touch both opposite faces of a box in x, y, z, and in any of them."""
    ranges = {k: (float(a), float(b)) for k, a, b in zip("xyz", low, high, strict=True)}
    # the steps are worked out only where the disc's box meets the face's plane
    meets = lambda k, bound: (F.col(f"low_{k}") <= bound + 1e-6) & (F.col(f"high_{k}") >= bound - 1e-6)
    touch = {f"t{side}_{k}": F.when(meets(k, ranges[k][side]), touches_face(k, ranges[k][side], ranges)).otherwise(False) for k in "xyz" for side in (0, 1)}
    j = boxes.select("ordinal", *[c.alias(n) for n, c in touch.items()]).join(labels, F.col("ordinal") == F.col("node"))
    out = j.groupBy("component").agg(F.count("*").alias("size"), *[(F.bool_or(f"t0_{k}") & F.bool_or(f"t1_{k}")).alias(f"spans_{k}") for k in "xyz"])
    return out.withColumn("spans_any", F.col("spans_x") | F.col("spans_y") | F.col("spans_z"))


def voxel_candidates(boxes: DataFrame, origin: tuple, cell: tuple, shape: tuple[int, int, int]) -> DataFrame:
    """Each disc with each cell that its bounding box meets (i, j, k, flat): ranges of indices, no scan of the grid."""
    out = boxes
    for a, n, o, c, m in zip("xyz", "ijk", origin, cell, shape, strict=True):
        low = F.greatest(F.lit(0), F.floor((F.col(f"low_{a}") - o) / c).cast("int"))
        high = F.least(F.lit(m - 1), F.floor((F.col(f"high_{a}") - o) / c).cast("int"))
        out = out.withColumn(n, F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))))
    return out.withColumn("flat", (F.col("i").cast("long") * shape[1] + F.col("j")) * shape[2] + F.col("k"))


def voxel_areas(boxes: DataFrame, origin: tuple, cell: tuple, shape: tuple[int, int, int]) -> DataFrame:
    """ordinal, set_id, flat, area: positive areas of discs in cells.

    Discs inside a cell have all their area, cells beside the disc's plane none, both natively; the rest is exact polygon
    work in Arrow batches. A disc that lies in a face between two cells belongs to the higher one.
    """
    c = voxel_candidates(boxes, origin, cell, shape)
    for a, n, o, s in zip("xyz", "ijk", origin, cell, strict=True):
        c = c.withColumns({f"v{a}": F.lit(float(o)) + F.col(n) * float(s), f"w{a}": F.lit(float(o)) + (F.col(n) + 1) * float(s)})
    inside = F.lit(True)
    reach, side = F.lit(0.0), F.lit(0.0)
    face = F.lit(False)
    for a, o, s, m, n in zip("xyz", origin, cell, shape, "ijk", strict=True):
        inside = inside & (F.col(f"low_{a}") >= F.col(f"v{a}")) & (F.col(f"high_{a}") < F.col(f"w{a}"))
        half = float(s) / 2
        reach = reach + F.abs(F.col(f"n{a}")) * half
        side = side + F.col(f"n{a}") * (F.col(f"v{a}") + half - F.col(f"c{a}"))
        # in a face of its lower neighbour: the higher cell owns it, but at the grid's far bound
        flat_here = (F.abs(F.col(f"n{a}")) > 1 - 1e-12) & (F.abs(F.col(f"c{a}") - F.col(f"w{a}")) < 1e-9)
        face = face | (flat_here & (F.col(n) < m - 1))
    c = c.filter((F.abs(side) <= reach + 1e-12) & ~face)
    keep = ["ordinal", "set_id", "flat"]
    whole = c.filter(inside).select(*keep, "area")
    geometry = [f"c{a}" for a in "xyz"] + [f"n{a}" for a in "xyz"] + ["radius"] + [f"v{a}" for a in "xyz"] + [f"w{a}" for a in "xyz"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            g = rows[geometry].to_numpy(float)
            yield rows[keep].assign(area=special.disc_box_areas(g[:, 0:3], g[:, 3:6], g[:, 6], g[:, 7:10], g[:, 10:13]))

    part = c.filter(~inside).select(*keep, *geometry).mapInPandas(run, "ordinal long, set_id int, flat long, area double")
    return whole.unionByName(part).filter(F.col("area") > 1e-12)


def p32_rollup(areas: DataFrame, volume: float) -> DataFrame:
    """flat, set_id (NULL: all sets), area, n_discs, p32 by grouping sets."""
    out = areas.sparkSession.sql("SELECT flat, set_id, sum(area) AS area, count(*) AS n_discs FROM {areas} GROUP BY GROUPING SETS ((flat, set_id), (flat))", areas=areas)
    return out.withColumn("p32", F.col("area") / F.lit(float(volume)))


def conservation(boxes: DataFrame, areas: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """One row: errors of the summed areas against the discs' areas: greatest, median, 95th and 99th percentile, and how many exceed."""
    summed = areas.groupBy("ordinal").agg(F.sum("area").alias("summed"))
    e = boxes.select("ordinal", "area").join(summed, "ordinal", "left").select(F.abs(F.col("area") - F.coalesce("summed", F.lit(0.0))).alias("e"))
    q = F.percentile("e", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return e.agg(F.count("*").alias("n_discs"), F.max("e").alias("max_error"), q.alias("q"), F.count_if(F.col("e") > tolerance).alias("n_over")).select("n_discs", "max_error", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"), F.col("q")[2].alias("p99"), "n_over")


def plane_box_relation(boxes: DataFrame, low: tuple, high: tuple) -> DataFrame:
    """Discs with relation INSIDE, INTERSECTS or OUTSIDE of a box, by their bounding boxes and planes."""
    full, meets = F.lit(True), F.lit(True)
    reach, side = F.lit(0.0), F.lit(0.0)
    for a, lo, hi in zip("xyz", low, high, strict=True):
        full = full & (F.col(f"low_{a}") >= float(lo)) & (F.col(f"high_{a}") <= float(hi))
        meets = meets & (F.col(f"low_{a}") <= float(hi)) & (F.col(f"high_{a}") >= float(lo))
        reach = reach + F.abs(F.col(f"n{a}")) * float(hi - lo) / 2
        side = side + F.col(f"n{a}") * (F.lit(float(hi + lo) / 2) - F.col(f"c{a}"))
    return boxes.withColumn("relation", F.when(full, "INSIDE").when(meets & (F.abs(side) <= reach), "INTERSECTS").otherwise("OUTSIDE"))


def domain_set_metrics(field: DataFrame, predicted: str = "predicted", realized: str = "realized", by: tuple[str, ...] = ("set_id",)) -> DataFrame:
    """Bias, MAE, RMSE and percentiles of |error| of realised against predicted P32, and MAE of cells at the grid's edge and inside."""
    e = F.col(realized) - F.col(predicted)
    a = F.abs(e)
    return field.groupBy(*by).agg(F.count("*").alias("n"), F.avg(e).alias("bias"), F.avg(a).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.percentile(a, F.lit(0.5)).alias("p50"), F.percentile(a, F.lit(0.95)).alias("p95"), F.avg(F.when(F.col("is_edge"), a)).alias("mae_edge"), F.avg(F.when(~F.col("is_edge"), a)).alias("mae_interior"))


def resolve_templates(discs: DataFrame, templates: DataFrame) -> DataFrame:
    """ordinal, template_id: of the templates whose keys match (NULL matches all) the one of highest priority, then least id. Templates are few."""
    t = F.broadcast(templates.select("template_id", "priority", F.col("set_id").alias("t_set"), F.col("domain_id").alias("t_domain")))
    match = (F.col("t_set").isNull() | (F.col("t_set") == F.col("set_id"))) & (F.col("t_domain").isNull() | (F.col("t_domain") == F.col("domain_id")))
    return discs.join(t, match).groupBy("ordinal").agg(F.max_by("template_id", F.struct("priority", -F.col("template_id"))).alias("template_id"))


def neighbours(links: DataFrame) -> DataFrame:
    """node, neighbour: each link from both its ends."""
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).select(F.col("a").alias("node"), F.col("b").alias("neighbour"))


def generation_bounds(bounds: DataFrame, greatest_radius: Column, layers: int, cell: tuple) -> DataFrame:
    """Bounds min_x.. max_z moved out on every side by the greatest radius, or by `layers` cells if that is more."""
    moved = {}
    for k, c in zip("xyz", cell, strict=True):
        margin = F.greatest(greatest_radius, F.lit(float(layers * c)))
        moved |= {f"min_{k}": F.col(f"min_{k}") - margin, f"max_{k}": F.col(f"max_{k}") + margin}
    return bounds.withColumns(moved)
