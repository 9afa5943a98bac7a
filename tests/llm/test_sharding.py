import bisect
import random
import zlib

import pytest
from pyspark.sql import types as T

from stratafold.llm import sharding

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("shard", T.StringType())])


def brute(sizes, parts):
    capacity = max([*sizes, -(-sum(sizes) // parts)])
    while len(sharding.greedy(sizes, capacity)) >= parts:
        capacity += 1
    return capacity


def test_capacity_is_least():
    for sizes in ([1], [5, 1, 1, 1, 5], [2] * 17, [9, 1, 1, 8, 3, 3, 3], list(range(1, 30))):
        for parts in (1, 2, 3, 8):
            assert sharding.smallest_capacity(sizes, parts) == brute(sizes, parts)


def counter(groups):
    """What `search` asks of a table of groups (key -> size), counted here; notes the ranges and segments of a pass."""
    keys = sorted(groups)
    seen = []

    def count(ranges, shift):
        chosen = keys if not ranges else [k for low, high in ranges for k in keys[bisect.bisect_left(keys, low) : bisect.bisect_right(keys, high)]]
        parts = {}
        for k in chosen:
            p = parts.setdefault(k >> shift, [k, k, 0])
            p[1], p[2] = k, p[2] + groups[k]
        seen.append((len(ranges), len(parts)))
        return [sharding.Segment(*p, shift) for p in parts.values()]

    return count, seen


@pytest.mark.parametrize("share", [0, 2, 8, 11, 12, 12.49, 20, 33, 60])
@pytest.mark.parametrize("seed", [1, 2])
def test_hot_groups_keep_the_passes_small(share, seed):
    r = random.Random(seed)
    groups = {r.randrange(-(1 << 63), 1 << 63): r.randrange(1, 4000) for _ in range(60_000)}
    if share:
        total = sum(groups.values())
        groups[r.randrange(-(1 << 63), 1 << 63)] = int(total * share / (100 - share))
    count, seen = counter(groups)
    alone, cuts = sharding.search(count, 8)
    assert all(ranges <= 14 and parts <= 14 << sharding.MORE_BITS for ranges, parts in seen[1:]) and len(seen) < 25
    rest = [groups[k] for k in sorted(groups) if k not in alone]
    assert bool(alone) == (share > 12.5)
    assert [sorted(k for k in groups if k not in alone)[i] for i in sharding.greedy(rest, sharding.smallest_capacity(rest, 8 - len(alone)))] == cuts


def test_search_is_exact_on_small_orders():
    r = random.Random(5)
    for _ in range(400):
        groups = {r.randrange(-(1 << 63), 1 << 63): r.choice([1, 1, 2, 5, 40]) for _ in range(r.randrange(0, 60))}
        parts = r.randrange(1, 9)
        alone, cuts = sharding.search(counter(groups)[0], parts)
        keys = [k for k in sorted(groups) if k not in alone]
        loads = [sum(groups[k] for k in keys if (low is None or k >= low) and (high is None or k < high)) for low, high in zip([None, *cuts], [*cuts, None], strict=True)]
        if parts > len(alone):
            assert max(loads) == (brute([groups[k] for k in keys], parts - len(alone)) if keys else 0) and len(loads) <= parts - len(alone)


def check(spark, rows, shards=8):
    out = sharding.assign(spark.createDataFrame(rows, SCHEMA), shards).collect()
    assert len(out) == len(rows)
    by_text, slots = {}, {}
    texts = {r[0]: r[1] for r in rows}
    for r in out:
        text = (texts[r.doc_id] or "").encode()
        assert r.size == len(text) + 1 and r.text_crc32 == zlib.crc32(text) and r.law == "bytes" and r.grown_shard is None
        assert by_text.setdefault(text, r.shard) == r.shard
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(0 <= s < shards for s in slots) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    return out


def test_minimax_over_the_key_order(spark):
    rows = [(i, "w" * (i * 37 % 211), "x") for i in range(700)]
    out = check(spark, rows)
    loads, keys = {}, {}
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "xxhash64(text) k").collect()
    key = {r.doc_id: r.k for r in frame}
    for r in out:
        loads[r.shard] = loads.get(r.shard, 0) + r.size
        keys[key[r.doc_id]] = keys.get(key[r.doc_id], 0) + r.size
    sizes = [keys[k] for k in sorted(keys)]
    assert max(loads.values()) == brute(sizes, 8)


def test_hot_group_gets_its_own_shard(spark):
    rows = [(i, "same text" * 20, None) for i in range(300)] + [(1000 + i, f"text {i} " * 20, None) for i in range(600)]
    out = check(spark, rows)
    hot = {r.shard for r in out if r.doc_id < 300}
    assert len(hot) == 1 and all(r.shard not in hot for r in out if r.doc_id >= 300)
    rest = {}
    for r in out:
        if r.doc_id >= 300:
            rest[r.shard] = rest.get(r.shard, 0) + r.size
    assert len(rest) == 7 and max(rest.values()) < 1.1 * min(rest.values())


def test_nulls_repeats_and_empty_tables(spark):
    check(spark, [(1, None, None), (2, "", None), (3, "é", "y"), (4, "a" * 200_000, None)])
    assert check(spark, []) == []
    out = sharding.assign(spark.createDataFrame([(None, "a", ""), (7, "a", ""), (7, "a", "")], SCHEMA)).collect()
    assert sorted(r.slot for r in out) == [0, 1, 2]
