"""Mixing sources to target weights: exact block quotas, dealt to output shards by a multivariate-hypergeometric splitting tree.

Sizes are words. Each source's target is its weight's share of all words, capped at MOST times its size, the excess reshared
by weight (water filling: targets are min(cap, level * weight)). Within a source, documents are permuted by a seeded MD5
of doc_id, and blocks are runs of that order with equal leading digits. A source whose target is k times its size and a
rest takes each block k times, and once more the blocks up to the rest; the block in which the rest ends is cut at the
document nearest to it. So what a source gives differs from its target by half a document at most.

Every draw (block, copy) goes to one output shard. The quota of a source is its number of draws; shards have room for equal
numbers of draws. The tree splits a source's quota between the left and right half of the shards, and so on down to single
shards, by hypergeometric draws from the room that is left there: all sources' vectors over the shards together follow the
multivariate hypergeometric law, and sources' and shards' sums are exact. Sources are first taken together by a hash, so
that a task handles a part of them (a sum of draws without replacement is split by the same law). A source's draws, in a
seeded permutation, are then dealt to its quotas in turn, so they are disjoint. `mix` deals rows to partitions by their
shard and shuffles them inside.

Native: DataFrame functions only. The cut is found by sums over cells of leading digits, two levels deep, so no source is
ordered in one task. Tables that are joined to the rows have a row per source or block and are broadcast only if counted
small.

Defined cases: an empty table gives no rows; a null text has size 0; the null source is one source, last in order; rows
with equal doc_id of a source are taken alike; a source without words has target 0; other columns, of any names, are carried
or ignored; fewer draws than shards leave shards empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import documents, small, stage

WEIGHTS = (5, 2, 1)
#: A source gives at most this many times its size.
MOST = 3
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"
#: Leading hex digits of the order that name a block, and a cell inside the block that is cut.
BLOCK_DIGITS, CELL_DIGITS = 2, 5
#: Parts of an output shard that are shuffled apart.
SALTS = 64
#: Rows of a per-source or per-block table that may be broadcast.
SMALL_ROWS = 200_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(doc_id: Column, seed: str) -> Column:
    return F.md5(F.encode(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))), "UTF-8"))


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target of a table with a row per source (source, source_size)."""
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(in_order) - 1) % len(WEIGHTS) + 1).cast("int")).cast("double")
    cap = (F.col("source_size") * MOST).cast("double")
    every = Window.partitionBy(F.lit(0))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    all_words = F.sum("source_size").over(every).cast("double")
    rows = sizes.withColumns({"weight": weight, "cap": cap})
    rows = rows.withColumn("level", (all_words - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # sources below their caps share one level: that of the first of them
    free = F.col("level") * F.col("weight") < F.col("cap")
    shared = F.max(F.when(free, F.col("level"))).over(every)
    return rows.select("source", "source_size", F.when(free, shared * F.col("weight")).otherwise(F.col("cap")).alias("target"))


def _cumulated(cells: DataFrame, by: str) -> DataFrame:
    """start and end: words of the source before and through each cell."""
    run = Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("size").over(run) + F.col("base")
    return cells.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))


def _cuts(slim: DataFrame, quota: DataFrame) -> DataFrame:
    """source, cut: documents up to `cut` in the order are taken once more than `whole` times. Sources without a cut are left out."""
    same = F.col("s.source").eqNullSafe(F.col("q.source"))

    def inside(rows: DataFrame, found: DataFrame, digits: int) -> DataFrame:
        """The rows of the cell in which each source's rest ends."""
        hit = F.col("s.source").eqNullSafe(F.col("q.source")) & (F.substring("s.order", 1, digits) == F.col("q.cell"))
        return rows.alias("s").join(small(found, SMALL_ROWS).alias("q"), hit).select("s.source", "s.order", "s.size", "q.rest", F.col("q.start").alias("base"))

    def level(rows: DataFrame, digits: int) -> DataFrame:
        cells = rows.groupBy("source", F.substring("order", 1, digits).alias("cell")).agg(F.sum("size").alias("size"), F.max("rest").alias("rest"), F.max("base").alias("base"))
        return stage(_cumulated(cells, "cell").filter("start < rest and end > rest").select("source", "cell", "start", "rest"), "mix-cell")

    first = slim.alias("s").join(quota.filter("rest > 0").alias("q"), same).select("s.source", "s.order", "s.size", "q.rest", F.lit(0).cast("long").alias("base"))
    block = level(first, BLOCK_DIGITS)
    part = inside(slim, block, BLOCK_DIGITS)
    cell = level(part, CELL_DIGITS)
    rows = inside(slim, cell, CELL_DIGITS).groupBy("source", "order").agg(F.sum("size").alias("size"), F.max("rest").alias("rest"), F.max("base").alias("base"))
    # the last document with words of: whole blocks, whole cells of the block that is cut, and documents of the cell that is cut
    last = _cumulated(rows, "order").filter("size > 0 and start + end <= 2 * rest").groupBy("source").agg(F.max("order").alias("cut"))
    for whole, digits in ((first, BLOCK_DIGITS), (part, CELL_DIGITS)):
        cells = whole.groupBy("source", F.substring("order", 1, digits).alias("cell")).agg(F.sum("size").alias("size"), F.max(F.when(F.col("size") > 0, F.col("order"))).alias("order"), F.max("rest").alias("rest"), F.max("base").alias("base"))
        last = last.unionByName(_cumulated(cells, "cell").filter("end <= rest").groupBy("source").agg(F.max("order").alias("cut")))
    return last.groupBy("source").agg(F.max("cut").alias("cut"))


def quotas(slim: DataFrame) -> DataFrame:
    """source, source_size, target, whole, cut: a row per source. Staged."""
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    quota = targets(sizes).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    quota = small(stage(quota.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "mix-quota"), SMALL_ROWS)
    cuts = _cuts(slim, quota)
    full = quota.alias("q").join(cuts.alias("c"), F.col("q.source").eqNullSafe(F.col("c.source")), "left")
    return stage(full.select("q.source", "q.source_size", "q.target", "q.whole", F.coalesce("c.cut", F.lit("")).alias("cut")), "mix-cuts")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from a hash of the parts."""
    digits = F.substring(F.md5(F.encode(F.concat_ws(":", *[F.lit(x) if isinstance(x, str) else x for x in parts]), "UTF-8")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**13))


def _hypergeometric(good: Column, bad: Column, number: Column, u: Column) -> Column:
    """How many of `number` draws without replacement are good: the least k whose cumulated probability exceeds u."""

    def drawn(x: Column) -> Column:
        low, high = F.greatest(x["number"] - x["bad"], F.lit(0)).cast("long"), F.least(x["number"], x["good"]).cast("long")
        later = F.slice(F.sequence(low, high), F.lit(2), (high - low).cast("int"))
        # log of P(k) / P(k - 1)
        ratio = lambda k: F.log((x["good"] - k + 1) * (x["number"] - k + 1) / (k * (x["bad"] - x["number"] + k)).cast("double"))
        zero = F.lit(0.0)
        most = F.aggregate(later, F.struct(zero.alias("log"), zero.alias("most")), lambda a, k: F.struct((a["log"] + ratio(k)).alias("log"), F.greatest(a["most"], a["log"] + ratio(k)).alias("most")), lambda a: a["most"])

        def searched(m: Column) -> Column:
            def total(a: Column, k: Column) -> Column:
                return F.struct((a["log"] + ratio(k)).alias("log"), (a["sum"] + F.exp(a["log"] + ratio(k) - m)).alias("sum"))

            every = F.aggregate(later, F.struct(zero.alias("log"), F.exp(-m).alias("sum")), total, lambda a: a["sum"])

            def step(goal: Column) -> Column:
                # the number of k whose cumulated weight is below the goal
                start = F.struct(zero.alias("log"), F.exp(-m).alias("sum"), low.alias("k"))
                return F.aggregate(later, start, lambda a, k: F.struct((a["log"] + ratio(k)).alias("log"), (a["sum"] + F.exp(a["log"] + ratio(k) - m)).alias("sum"), F.when(a["sum"] <= goal, k).otherwise(a["k"]).alias("k")), lambda a: a["k"])

            return _let(x["u"] * every, step)

        return _let(most, searched)

    return _let(F.struct(good.cast("long").alias("good"), bad.cast("long").alias("bad"), number.cast("long").alias("number"), u.alias("u")), drawn)


def _split(number: Column, room: Column, low: int, high: int, seed: str, key: Column) -> Column:
    """`number` draws as an array over the shards from `low` to `high`, by their room: a node of the tree and those below it."""
    if high - low == 1:
        return F.array(number.cast("long"))
    middle = (low + high) // 2
    left, right = (F.aggregate(F.slice(room, a + 1, b - a), F.lit(0).cast("long"), lambda x, y: x + y) for a, b in ((low, middle), (middle, high)))
    return _let(_hypergeometric(left, right, number, _uniform(f"{seed}/{low}-{high}", key)), lambda k: F.concat(_split(k, room, low, middle, seed, key), _split(number - k, room, middle, high, seed, key)))


def _dealt(items: Column, room: Column, shards: int, seed: str) -> Column:
    """Each of `items` (key, quota), in order, with its quota's parts: an array over the shards. They use up `room`."""

    def one(state: Column, x: Column) -> Column:
        return _let(_split(x["quota"], state["room"], 0, shards, seed, x["key"]), lambda parts: F.struct(F.zip_with(state["room"], parts, lambda a, b: a - b).alias("room"), F.concat(state["out"], F.array(F.struct(x["key"].alias("key"), parts.alias("parts")))).alias("out")))

    start = F.struct(room.alias("room"), F.array().cast("array<struct<key:string,parts:array<bigint>>>").alias("out"))
    return F.aggregate(items, start, one, lambda state: state["out"])


def splitting_tree(quotas: DataFrame, shards: int, seed: str = SEED) -> DataFrame:
    """key, parts: each key's quota as an array over the shards. `quotas` has key (a string that isn't null) and quota."""
    group = F.substring(F.md5(F.encode("key", "UTF-8")), 1, 1)
    items = quotas.groupBy(group.alias("group")).agg(F.array_sort(F.collect_list(F.struct("key", F.col("quota").cast("long").alias("quota")))).alias("items"), F.sum("quota").alias("quota"))
    top = items.agg(F.array_sort(F.collect_list(F.struct(F.col("group").alias("key"), "quota"))).alias("items"), F.coalesce(F.sum("quota"), F.lit(0)).cast("long").alias("all"))
    room = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")), lambda j: F.floor((j + 1) * F.col("all") / shards) - F.floor(j * F.col("all") / shards))
    # 16 groups at most
    top = F.broadcast(top.select(F.explode(_dealt(F.col("items"), room, shards, seed + "/top")).alias("x")).select(F.col("x.key").alias("group"), F.col("x.parts").alias("room")))
    return items.join(top, "group").select(F.explode(_dealt(F.col("items"), F.col("room"), shards, seed)).alias("x")).select("x.key", "x.parts")


def deal(blocks: DataFrame, shards: int, seed: str = SEED) -> DataFrame:
    """source, block, shards: the output shard of each draw of a block, by copy. `blocks` has source, block, draws (1000 of a source at most)."""
    # a null source is told from others by the first letter of its key
    rows = blocks.filter("draws > 0").withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")))
    parts = splitting_tree(rows.groupBy("key").agg(F.sum("draws").alias("quota")), shards, seed)
    draws = rows.select("key", "source", "block", F.explode(F.sequence(F.lit(1), "draws")).alias("copy"))
    order = F.md5(F.encode(F.concat_ws(":", F.lit(f"{seed}/draw"), "key", "block", F.col("copy").cast("string")), "UTF-8"))
    draws = draws.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(order, "block", "copy")))
    # the shard in whose run of the permutation the draw lies
    ends = F.transform("parts", lambda x, i: F.aggregate(F.slice("parts", F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, b: a + b))
    placed = draws.join(parts, "key").withColumn("shard", F.size(F.filter(ends, lambda e: e < F.col("place"))))
    by_copy = F.transform(F.array_sort(F.collect_list(F.struct("copy", "shard"))), lambda x: x["shard"])
    return placed.groupBy("source", "block").agg(by_copy.alias("shards"))


def plan(docs: DataFrame, shards: int = 8, seed: str = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The slim rows (doc_id, source, size, order), the sources' quotas, and the blocks' shards."""
    slim = stage(docs.select("doc_id", F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"), order_key(F.col("doc_id"), seed).alias("order")), "mix-slim")
    quota = quotas(slim)
    q = small(quota, SMALL_ROWS).alias("q")
    block = F.substring("s.order", 1, BLOCK_DIGITS)
    seen = slim.alias("s").join(q, F.col("s.source").eqNullSafe(F.col("q.source"))).groupBy("s.source", block.alias("block")).agg((F.max("q.whole") + F.max((F.col("s.order") <= F.col("q.cut")).cast("int"))).alias("draws"))
    dealt = stage(deal(stage(seen, "mix-blocks"), shards, seed), "mix-shards")
    return slim, quota, dealt


def decide(rows: DataFrame, quota: DataFrame, dealt: DataFrame) -> DataFrame:
    """`rows` (source, order and others) with source_size, target, shards (the output shard of each copy that the mix takes)."""
    q = small(quota, SMALL_ROWS).alias("q")
    b = small(dealt, SMALL_ROWS).alias("b")
    out = rows.alias("r").join(q, F.col("r.source").eqNullSafe(F.col("q.source")))
    out = out.join(b, F.col("r.source").eqNullSafe(F.col("b.source")) & (F.substring("r.order", 1, BLOCK_DIGITS) == F.col("b.block")), "left")
    copies = F.col("q.whole") + (F.col("r.order") <= F.col("q.cut")).cast("int")
    mine = F.slice(F.coalesce("b.shards", F.array().cast("array<int>")), F.lit(1), copies)
    return out.select("r.*", "q.source_size", "q.target", mine.alias("shards"))


def mix(docs: DataFrame, shards: int = 8, seed: str = SEED, shard: str | None = None) -> DataFrame:
    """The mixed rows: each row of `docs` once for each copy taken, with its columns, and with its output shard in a column `shard` if that is named.

    Rows are dealt to partitions by shard (and by SALTS parts of each, so that few shards don't mean few tasks) and are in a
    random order inside each.
    """
    _, quota, dealt = plan(docs, shards, seed)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("source").cast("string").alias("source"), order_key(F.col("doc_id"), seed).alias("order"))
    out = decide(rows, quota, dealt).select("row", F.posexplode("shards").alias("copy", "shard"))
    turn = F.xxhash64(F.lit(seed), "row.doc_id", "copy")
    out = out.repartition("shard", F.pmod(turn, F.lit(SALTS))).sortWithinPartitions("shard", turn)
    return out.select("row.*", *([F.col("shard").alias(shard)] if shard else []))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decide(*plan(documents(spark, sf_dir)))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).cast("long").alias("taken"), F.array_join(F.col("shards").cast("array<string>"), ",").alias("shards"))


def _sql_draw(rows: str, good: str, bad: str, number: str, u: str, name: str) -> str:
    """`rows` with a hypergeometric draw as column `name`, in SQL: the least k whose cumulated weight exceeds u times the sum of all."""
    rows = f"SELECT *, CAST(list_sum({good}) AS BIGINT) AS g, CAST(list_sum({bad}) AS BIGINT) AS b, CAST({number} AS BIGINT) AS n, {u} AS u FROM ({rows})"
    rows = f"SELECT *, list_transform(range(greatest(0, n - b), least(n, g) + 1), lambda k: -lgamma(k+1)-lgamma(g-k+1)-lgamma(n-k+1)-lgamma(b-n+k+1)) AS logs FROM ({rows})"
    rows = f"SELECT *, list_max(logs) AS m FROM ({rows})"
    rows = f"SELECT *, list_transform(logs, lambda w: exp(w - m)) AS ws FROM ({rows})"
    rows = f"SELECT *, u * list_sum(ws) AS goal FROM ({rows})"
    # the last of them counts only up to the rounding of the sums
    return f"SELECT * EXCLUDE (g, b, n, u, logs, m, ws, goal), greatest(0, n - b) + len(list_filter(range(1, len(ws)), lambda i: list_sum(ws[1:i]) <= goal)) AS {name} FROM ({rows})"


def _sql_walk(name: str, items: str, seed: str, shards: int = 8) -> str:
    """Recursive SQL: the items (part, i, key, quota, room) of each part in turn, each split down the tree over `shards`."""
    nodes, todo = [], [(0, shards)]
    while todo:
        low, high = todo.pop(0)
        if high - low > 1:
            nodes.append((low, high))
            todo += [(low, (low + high) // 2), ((low + high) // 2, high)]
    sql = f"SELECT w.part, x.i, x.key, w.room AS room, x.quota AS n_0_{shards} FROM {name} w JOIN {items} x ON x.part = w.part AND x.i = w.i + 1"
    for low, high in nodes:
        middle = (low + high) // 2
        u = f"CAST(CAST('0x' || substr(md5('{seed}/{low}-{high}:' || key), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0"
        sql = _sql_draw(sql, f"room[{low + 1}:{middle}]", f"room[{middle + 1}:{high}]", f"n_{low}_{high}", u, f"n_{low}_{middle}")
        sql = f"SELECT *, n_{low}_{high} - n_{low}_{middle} AS n_{middle}_{high} FROM ({sql})"
    parts = ", ".join(f"CAST(n_{j}_{j + 1} AS BIGINT)" for j in range(shards))
    left = ", ".join(f"room[{j + 1}] - CAST(n_{j}_{j + 1} AS BIGINT)" for j in range(shards))
    return f"{name} AS (SELECT DISTINCT part, CAST(0 AS BIGINT) AS i, '' AS key, CAST(room AS BIGINT[]) AS room, CAST([] AS BIGINT[]) AS parts FROM {items} UNION ALL SELECT part, i, key, [{left}], [{parts}] FROM ({sql}))"


OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rn FROM d GROUP BY source),
w AS (SELECT *, CAST(CASE (rn - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight, CAST(source_size * 3 AS DOUBLE) AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
        / sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, CASE WHEN level * weight < cap THEN max(CASE WHEN level * weight < cap THEN level END) OVER () * weight ELSE cap END AS target FROM l),
q AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS INTEGER) ELSE 0 END AS whole FROM t),
g AS (SELECT source, u, sum(size) AS size FROM d GROUP BY source, u),
c AS (SELECT source, u, CAST(sum(size) OVER (PARTITION BY source ORDER BY u ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e, CAST(size AS BIGINT) AS size FROM g),
x AS (SELECT c.source, max(u) AS cut FROM c JOIN q ON c.source IS NOT DISTINCT FROM q.source WHERE c.size > 0 AND c.e - c.size + c.e <= 2 * (q.target - q.whole * q.source_size) GROUP BY c.source),
o AS (SELECT d.doc_id, d.source, d.u, d.size, q.source_size, q.target, q.whole + CASE WHEN d.u <= x.cut THEN 1 ELSE 0 END AS copies
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source LEFT JOIN x ON d.source IS NOT DISTINCT FROM x.source),
b AS (SELECT coalesce('=' || source, '-') AS key, substr(u, 1, 2) AS block, max(copies) AS draws FROM o GROUP BY ALL HAVING max(copies) > 0),
k AS (SELECT substr(md5(key), 1, 1) AS part, key, CAST(sum(draws) AS BIGINT) AS quota FROM b GROUP BY ALL),
gi AS (SELECT 'all' AS part, row_number() OVER (ORDER BY part) AS i, part AS key, CAST(sum(quota) AS BIGINT) AS quota,
         (SELECT list(CAST((j + 1) * t // 8 - j * t // 8 AS BIGINT) ORDER BY j) FROM (SELECT unnest(range(8)) AS j, (SELECT sum(quota) FROM k) AS t)) AS room
       FROM k GROUP BY k.part),
""" + _sql_walk("gw", "gi", f"{SEED}/top") + r""",
ki AS (SELECT k.part, row_number() OVER (PARTITION BY k.part ORDER BY k.key) AS i, k.key, k.quota, gw.parts AS room FROM k JOIN gw ON gw.key = k.part AND gw.i > 0),
""" + _sql_walk("kw", "ki", SEED) + r""",
dr AS (SELECT key, block, copy, row_number() OVER (PARTITION BY key ORDER BY md5('mix-1/draw:' || key || ':' || block || ':' || copy), block, copy) AS place
       FROM (SELECT key, block, unnest(range(1, draws + 1)) AS copy FROM b)),
sh AS (SELECT dr.key, block, list(len(list_filter(range(1, 9), lambda e: list_sum(parts[1:e]) < place)) ORDER BY copy) AS shards FROM dr JOIN kw ON kw.key = dr.key AND kw.i > 0 GROUP BY ALL)
SELECT o.doc_id, o.size, o.source_size, o.target, CAST(o.size * o.copies AS BIGINT) AS taken, coalesce(array_to_string(sh.shards[1:o.copies], ','), '') AS shards
FROM o LEFT JOIN sh ON sh.key = coalesce('=' || o.source, '-') AND sh.block = substr(o.u, 1, 2)
"""
