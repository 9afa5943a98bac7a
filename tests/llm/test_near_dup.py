import random
import re

import numpy as np
import pytest
from pyspark.sql import types as T

from stratafold.llm import components, near_dup as N

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("component", T.StringType()), T.StructField("key", T.StringType())])


def shingle_set(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows):
    """(doc_id, n, component, kept) by comparing all pairs that share a shingle."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    tried = set()
    for v in where.values():
        for k, i in enumerate(v):
            for j in v[:k]:
                if (i, j) not in tried:
                    tried.add((i, j))
                    both = len(sets[i] & sets[j])
                    if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                        parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed=1, groups=14, size=14):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["É", "Ü"]
    rows = []
    for g in range(groups):
        base = [r.choice(words) for _ in range(r.choice([4, 7, 8, 20, 60, 300, 1500]))]
        for _ in range(r.randrange(1, size)):
            text = list(base)
            for _ in range(int(r.random() * 0.04 * len(base)) + r.randrange(2)):
                text[r.randrange(len(text))] = r.choice(words)
            rows.append(" ".join(text).upper() if r.random() < 0.2 else "  ".join(text))
    return [(i * 7 % 100_003, t) for i, t in enumerate(r.sample(rows, len(rows)))]


def got(frame):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in frame.collect())


def frame_of(spark, rows):
    return spark.createDataFrame([(i, t, "c", "k") for i, t in rows], SCHEMA)


@pytest.mark.parametrize("tile", [1024, 3])
def test_equals_brute_force(spark, tile, monkeypatch):
    monkeypatch.setattr(N, "TILE", tile)
    rows = corpus()
    assert got(N.report(frame_of(spark, rows))) == brute(rows)


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a"), (5, "A"), (6, "a b"), (7, "x " * 50_000), (8, "x " * 40_000), (9, "b a")]
    assert got(N.report(frame_of(spark, rows))) == brute(rows)
    docs = spark.createDataFrame([(None, "a b c d e f", None, None), (3, "a b c d e f", None, None), (3, "a b c d e f", None, None), (None, "zz", None, None), (2, "A b c d e f", None, None)], SCHEMA)
    out = [(r.doc_id, r.component_id, r.kept) for r in N.report(docs).collect()]
    assert sorted(out, key=repr) == sorted([(None, 2, True), (3, 2, False), (3, 2, False), (None, None, True), (2, 2, True)], key=repr)
    kept = N.drop_near_copies(docs)
    assert kept.schema == docs.schema and sorted(map(repr, (r.doc_id for r in kept.collect()))) == ["2", "None", "None"]
    assert N.report(frame_of(spark, [])).collect() == []


def test_estimates_and_bands():
    r = np.random.default_rng(2)
    missed = 0
    for n in (7, 20, 100, 1000, 8000):
        for _ in range(40):
            common = K_random(r, int(n * 0.92))
            a, b = (np.unique(np.concatenate([common, K_random(r, n - len(common))])) for _ in range(2))
            s = N.sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            assert N.estimated(s[:1], s[1:], np.array([len(a)]), np.array([len(b)]))[0] or len(common) / (2 * n - len(common)) < 0.85
            keys = N.bands(s)
            missed += not (keys[0] == keys[1]).any() and len(common) / (2 * n - len(common)) >= 0.85
    assert missed == 0


def test_short_pairs_share_a_band():
    r = np.random.default_rng(6)
    missed = 0
    for k in range(6, 21):
        for _ in range(200):
            b = np.unique(K_random(r, k + 1))
            a = np.delete(b, r.integers(k + 1))
            keys = N.bands(N.sketches(np.concatenate([a, b]), np.array([0, k, 2 * k + 1])))
            missed += not (keys[0] == keys[1]).any()
    assert missed == 0


def test_short_pairs_equal_brute_force(spark):
    r = random.Random(8)
    rows = []
    for k in range(6, 21):
        for _ in range(12):
            words = [f"v{r.randrange(10**9)}" for _ in range(k + 5)]
            rows += [(len(rows), " ".join(words[:-1])), (len(rows) + 1, " ".join(words))]
    assert got(N.report(frame_of(spark, rows))) == brute(rows)


def K_random(r, n):
    return r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (7, 7)]
    random.Random(1).shuffle(chain)
    out = {r.node: r.component for r in components.stars(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(1, 41)}, 200: 100, 300: 100}
