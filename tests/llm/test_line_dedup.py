import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import types as T

from stratafold.llm import line_dedup as L

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("hash", T.StringType()), T.StructField("line", T.StringType())])
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def brute(texts, min_docs):
    """The lines to drop, from the definition."""
    mask = lambda t: L.VARIABLE if re.search("[0-9]", t) else t
    holders = defaultdict(set)
    for text in set(t for t in texts if t is not None):
        for line in text.split("\n"):
            if any(SPACE.split(line)):
                holders[line].add(text)
    parsed = {line: [mask(t) for t in SPACE.split(line) if t] for line in holders}
    leaf = {line: (len(t), *t[: L.LEADING]) for line, t in parsed.items()}
    leaf_texts = defaultdict(set)
    for line in holders:
        leaf_texts[leaf[line]] |= holders[line]
    live = [line for line in holders if len(leaf_texts[leaf[line]]) >= min_docs]
    count = Counter()
    for line in live:
        for place, t in enumerate(parsed[line]):
            if t != L.VARIABLE:
                count[leaf[line], place, t] += len(holders[line])
    template, shared = defaultdict(list), defaultdict(set)
    for line in live:
        n = len(parsed[line])
        fixed = [(p, t) for p, t in enumerate(parsed[line]) if t != L.VARIABLE and count[leaf[line], p, t] >= min_docs]
        if len(fixed) >= L.SIMILAR * n:
            template[line].append((leaf[line], "all", tuple(fixed)))
            words = sum(t != L.VARIABLE for t in parsed[line])
            fields = int(L.FIELDS * n)
            kept = max(math.ceil(L.SIMILAR * n), words - fields)
            if fields and len(fixed) >= kept:
                common = sorted(fixed, key=lambda x: (-count[leaf[line], *x], x[0]))[:kept]
                template[line].append((leaf[line], "wide", tuple(common)))
        for key in template[line]:
            shared[key] |= holders[line]
    return {line for line in template if any(len(shared[key]) >= min_docs for key in template[line])}


def corpus():
    r = random.Random(4)
    rows = []
    for i in range(60):
        lines = ["".join(r.choice("abcdef ") for _ in range(r.randrange(30))) for _ in range(r.randrange(6))]
        if r.random() < 0.6:
            lines.insert(r.randrange(len(lines) + 1), f"Page {i} of {r.randrange(90)} printed")
        if r.random() < 0.4:
            lines.append("All rights reserved by " + r.choice(["us", "them", "nobody", f"x{i}q"]))
        if r.random() < 0.3:
            lines.append("a b " + r.choice("cde"))
        rows.append((i, "\n".join(lines)))
    return [*rows, (70, None), (71, ""), (72, " \n\t\n"), *[(80 + i, "only copies\nhere now") for i in range(20)], (5, rows[5][1]), (None, rows[6][1]), (99, "x " * 30_000)]


def test_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "h", "l") for i, t in rows], SCHEMA)
    gone = brute([t for _, t in rows], 5)
    assert any("rights" in x for x in gone) and any("Page" in x for x in gone)
    want = sorted(repr((i, t if t is None or not any(x in gone for x in t.split("\n")) else "\n".join(x for x in t.split("\n") if x not in gone))) for i, t in rows)
    out = L.clean(docs, 5)
    assert out.columns == docs.columns and sorted(repr((r.doc_id, r.text)) for r in out.collect()) == want
    counts = sorted(repr((i, sum(1 for x in (t or "").split("\n") if any(SPACE.split(x))), sum(1 for x in (t or "").split("\n") if x in gone))) for i, t in rows)
    assert sorted(repr((r.doc_id, r.n_lines, r.n_dropped)) for r in L.report(docs, 5).collect()) == counts


def test_empty(spark):
    assert L.report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_fields_of_words_at_two_sizes(spark):
    """Values of fields that recur often enough to be constants don't split their template; prose stays."""
    for n in (400, 4000):
        r = random.Random(n)
        prose = lambda: "the man " + " ".join(f"word{chr(97 + r.randrange(26))}{chr(97 + r.randrange(26))}" for _ in range(6))  # noqa: B023, E731
        rows = [(i, f"Filed under cat{chr(97 + r.randrange(26))} by author{chr(97 + r.randrange(20))}{chr(97 + r.randrange(10))} in the archive\n{prose()}") for i in range(n)]
        out = L.report(spark.createDataFrame([(i, t, "h", "l") for i, t in rows], SCHEMA)).collect()
        assert len(out) == n and all((x.n_lines, x.n_dropped, x.n_templates) == (2, 1, 1) for x in out)


def test_without_broadcasts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t, "h", "l") for i, t in corpus()], SCHEMA)
    want = sorted(map(repr, L.report(docs, 5).collect()))
    monkeypatch.setattr(L, "SMALL_ROWS", 0)
    assert sorted(map(repr, L.report(docs, 5).collect())) == want
