r"""Benchmark decontamination: a positional inverted index of the training text, searched from the rarest test terms.

Words are maximal runs of ASCII letters and digits (A-Z lowered) and of characters beyond ASCII. A window is WINDOW
consecutive words of a benchmark item; an item of fewer words, but not none, is one window.

1. Every test term is counted in the training text; windows with a term that never occurs are out.
2. The index holds postings (term, document, position) of the rarest ANCHORS positions of each window.
3. Postings minus the term's offset in a window give starts. The lists are intersected from the rarest term on, by document
   and offset-adjusted position, and what is left is compared with the whole window in the text.
4. Proximity: a window is near in a document if SPAN consecutive words hold all its anchors' terms, in any order. Windows
   with the same terms are looked for once.

Native: DataFrame functions only. Postings are made where the documents are read and written once. Intersections are
joined by document, so that a frequent term is spread over them. Tables of test terms and anchors are broadcast only if
counted small in rows and bytes; else they are joined by shuffles.

Defined cases: a null text has no words; an empty table on either side finds nothing; rows with equal doc_id are searched
each (rows that also share their text share one result); items with equal texts are reported each; other columns are
ignored or carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import discard, documents, small, stage

WINDOW, ANCHORS = 10, 3
#: Words within which the anchors of a near window lie.
SPAN = 2 * WINDOW
#: Rows of a table of test terms, anchors or windows that may be broadcast.
SMALL_ROWS = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words as they are written."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BREAK), "")


def folded(word: Column) -> Column:
    """A-Z lowered. Lowering a whole ASCII word is the same, and cheaper than a translation."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, hash, words: rows with equal doc_id but other texts stay apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), words(F.col("text")).alias("words"))


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """window (its words joined by a space), size, item_ids: each distinct window once. Staged."""
    rows = items.select("item_id", F.transform(words(F.col("text")), folded).alias("w")).filter(F.size("w") > 0)
    last = F.greatest(F.size("w") - F.lit(window - 1), F.lit(1))
    each = rows.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), last), lambda i: F.slice("w", i, window))).alias("w"))
    out = each.groupBy(F.array_join("w", " ").alias("window")).agg(F.max(F.size("w")).alias("size"), F.collect_set(F.col("item_id").cast("string")).alias("item_ids"))
    return stage(out, "decontam-windows")


def anchors(docs: DataFrame, windows: DataFrame, number: int = ANCHORS) -> DataFrame:
    """window, size, term, offset, rank, number: the rarest positions of each window that can occur. Staged."""
    places = windows.select("window", "size", F.posexplode(F.split("window", " ")).alias("offset", "term"))
    terms = small(stage(places.select("term").distinct(), "decontam-terms"), SMALL_ROWS)
    seen = _keyed(docs).select(F.explode("words").alias("word")).select(folded(F.col("word")).alias("term")).join(terms, "term").groupBy("term").agg(F.count("*").alias("n"))
    counted = places.join(seen, "term", "left")
    order = Window.partitionBy("window").orderBy("n", "offset")
    whole = Window.partitionBy("window")
    ranked = counted.withColumns({"rank": F.row_number().over(order), "missing": F.max(F.col("n").isNull().cast("int")).over(whole)})
    ranked = ranked.filter((F.col("missing") == 0) & (F.col("rank") <= number))
    return stage(ranked.select("window", "size", "term", "offset", "rank", F.least("size", F.lit(number)).alias("number")), "decontam-anchors")


def index(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Postings (term, doc_id, hash, position) of the anchors' terms. Staged."""
    terms = small(stage(chosen.select("term").distinct(), "decontam-chosen"), SMALL_ROWS)
    each = _keyed(docs).select("doc_id", "hash", F.posexplode("words").alias("position", "word"))
    return stage(each.select("doc_id", "hash", "position", folded(F.col("word")).alias("term")).join(terms, "term"), "decontam-postings")


def _same_text(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.hash") == F.col(f"{b}.hash"))


def phrase_candidates(postings: DataFrame, chosen: DataFrame) -> DataFrame:
    """window, doc_id, hash, start: places where all anchors of a window stand at their offsets. `window` is its 64-bit hash. Staged."""
    table = stage(chosen.select(F.xxhash64("window").alias("window"), "term", "offset", "rank", "number"), "decontam-table")
    of_rank = lambda rank: small(stage(table.filter(F.col("rank") == rank).drop("rank"), "decontam-rank"), SMALL_ROWS)
    start = F.col("position") - F.col("offset")
    found = postings.join(of_rank(1), "term").select("window", "number", "doc_id", "hash", start.alias("start")).filter("start >= 0")
    top = chosen.agg(F.max("rank")).first()[0] or 0
    for rank in range(2, top + 1):
        want = found.filter(F.col("number") >= rank).join(of_rank(rank).drop("number"), "window").withColumn("at", F.col("start") + F.col("offset"))
        there = want.alias("w").join(postings.alias("p"), _same_text("w", "p") & (F.col("w.term") == F.col("p.term")) & (F.col("w.at") == F.col("p.position")), "left_semi")
        found = there.select("window", "number", "doc_id", "hash", "start").unionByName(found.filter(F.col("number") < rank))
        found = stage(found, "decontam-candidates")
    return found.drop("number")


def phrase_matches(docs: DataFrame, windows: DataFrame, candidates: DataFrame) -> DataFrame:
    """window, size, doc_id, hash, start: every occurrence of a window, once. Texts are read again for documents with candidates only."""
    named = small(stage(windows.select(F.xxhash64("window").alias("id"), "window", "size"), "decontam-named"), SMALL_ROWS)
    places = candidates.join(named.withColumnRenamed("window", "text"), F.col("window") == F.col("id")).select("doc_id", "hash", "start", "size", F.col("text").alias("window"))
    by_text = stage(places.groupBy("doc_id", "hash").agg(F.collect_set(F.struct("start", "size", "window")).alias("places")), "decontam-places")
    keys = small(stage(by_text.select("doc_id", "hash"), "decontam-keys"), SMALL_ROWS)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text")
    texts = texts.alias("t").join(keys.alias("k"), _same_text("t", "k"), "left_semi")
    both = texts.alias("t").join(by_text.alias("b"), _same_text("t", "b")).select("t.doc_id", "t.hash", words(F.col("t.text")).alias("words"), "b.places")
    there = F.filter("places", lambda x: F.array_join(F.transform(F.slice("words", x["start"] + 1, x["size"]), folded), " ") == x["window"])
    return both.select("doc_id", "hash", F.explode(there).alias("x")).select("x.window", "x.size", "doc_id", "hash", "x.start").distinct()


def proximity_matches(postings: DataFrame, chosen: DataFrame, span: int = SPAN) -> DataFrame:
    """terms, doc_id, hash: documents in which `span` consecutive words hold all of a window's anchors; see `anchor_terms`.

    Positions meet the places of the set's rarest term in buckets of `span`, so no list is crossed with another; a place
    has fewer than 2 * span positions of a term beside it.
    """
    sets = stage(anchor_terms(chosen).groupBy("terms").agg(F.min_by("term", "rank").alias("pivot")), "decontam-sets")
    pivots = postings.join(small(sets, SMALL_ROWS), F.col("term") == F.col("pivot")).select("terms", "pivot", "doc_id", "hash", F.col("position").alias("place"))
    others = F.array_remove(F.split("terms", " "), F.col("pivot"))
    alone = pivots.filter(F.size(others) == 0).select("terms", "doc_id", "hash")
    bucket = F.floor(F.col("place") / span)
    spread = pivots.select("terms", "doc_id", "hash", "place", F.explode(others).alias("term"), bucket.alias("bucket")).withColumn("bucket", F.explode(F.array(*[F.col("bucket") + d for d in (-1, 0, 1)])))
    other = postings.withColumn("bucket", F.floor(F.col("position") / span))
    same = _same_text("f", "o") & (F.col("f.term") == F.col("o.term")) & (F.col("f.bucket") == F.col("o.bucket"))
    near = spread.alias("f").join(other.alias("o"), same & (F.abs(F.col("position") - F.col("place")) < span)).select("terms", "f.doc_id", "f.hash", "place", "f.term", "position")
    beside = near.groupBy("terms", "doc_id", "hash", "place").agg(F.collect_set(F.struct("term", "position")).alias("beside"))
    # every term within one run of `span` words that holds the place: runs begin at a position beside it, or at the place
    starts = F.concat(F.filter(F.transform("beside", lambda x: x["position"]), lambda p: p <= F.col("place")), F.array("place"))
    number = F.size(F.split("terms", " ")) - 1
    held = lambda s: F.size(F.array_distinct(F.transform(F.filter("beside", lambda x: (x["position"] >= s) & (x["position"] < s + span)), lambda x: x["term"])))
    return alone.unionByName(beside.filter(F.exists(starts, lambda s: held(s) == number)).select("terms", "doc_id", "hash")).distinct()


def anchor_terms(chosen: DataFrame) -> DataFrame:
    """`chosen` with terms: the distinct terms of the window's anchors, sorted and joined by a space."""
    sets = chosen.groupBy("window").agg(F.array_join(F.array_sort(F.collect_set("term")), " ").alias("terms"))
    return chosen.join(sets, "window")


def search(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The distinct windows, their anchors, the postings, and the occurrences of windows."""
    windows = benchmark_windows(items, window)
    chosen = anchors(docs, windows)
    postings = index(docs, chosen)
    return windows, chosen, postings, phrase_matches(docs, windows, phrase_candidates(postings, chosen))


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW, span: int = SPAN) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items (items with a near window) of every row of `docs`."""
    windows, chosen, postings, matches = search(docs, items, window)
    matches = stage(matches, "decontam-matches")
    key = ["doc_id", "hash"]
    spans = matches.groupBy(*key, "start").agg(F.max(F.col("start") + F.col("size")).alias("end"))
    run = Window.partitionBy(*key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    covered = spans.withColumn("reached", F.coalesce(F.max("end").over(run), F.lit(0)))
    hits = covered.groupBy(*key).agg(F.sum(F.greatest(F.col("end") - F.greatest("start", "reached"), F.lit(0))).alias("n_hit"))
    ids = matches.select(*key, "window").distinct().join(small(windows, SMALL_ROWS), "window").select(*key, F.explode("item_ids").alias("item_id"))
    found = ids.groupBy(*key).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    near = stage(proximity_matches(postings, chosen, span), "decontam-near")
    named = anchor_terms(chosen).select("window", "terms").distinct().join(windows, "window").select("terms", F.explode("item_ids").alias("item_id")).distinct()
    near = near.join(small(stage(named, "decontam-item-terms"), SMALL_ROWS), "terms").groupBy(*key).agg(F.count_distinct("item_id").alias("n_near"))
    both = stage(_together(key, hits, found, near), "decontam-by-text")
    discard(matches, postings)
    none = F.array().cast("array<string>")
    rows = _keyed(docs).select(*key, F.size("words").alias("n_words")).alias("d")
    out = rows.join(both.alias("b"), _same_text("d", "b"), "left").select("d.*", "b.n_hit", "b.items", "b.n_near")
    n_hit, items_ = F.coalesce("n_hit", F.lit(0)), F.coalesce("items", none)
    return out.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.cast("long").alias("n_hit"),
        F.size(items_).cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join(items_, ","), "UTF-8"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near_items"),
    )


def _together(key: list[str], hits: DataFrame, found: DataFrame, near: DataFrame) -> DataFrame:
    """One row for each text with n_hit, items, n_near: the three tables have a row for each text at most."""
    none, no_items = F.lit(None).cast("long"), F.lit(None).cast("array<string>")
    rows = hits.select(*key, F.col("n_hit").cast("long").alias("n_hit"), no_items.alias("items"), none.alias("n_near"))
    rows = rows.unionByName(found.select(*key, none.alias("n_hit"), "items", none.alias("n_near")))
    rows = rows.unionByName(near.select(*key, none.alias("n_hit"), no_items.alias("items"), F.col("n_near").cast("long").alias("n_near")))
    return rows.groupBy(*key).agg(F.max("n_hit").alias("n_hit"), F.first("items", ignorenulls=True).alias("items"), F.max("n_near").alias("n_near"))


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of `docs`, with all their columns, in which no window occurs."""
    *_, matches = search(docs, items, window)
    bad = small(stage(matches.select(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash")).distinct(), "decontam-bad"), SMALL_ROWS)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash"))
    return docs.join(bad, same, "left_anti")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
bp AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, array_to_string(w[p:p + 9], ' ') AS g, least(len(w), 10) AS n FROM bp),
sizes AS (SELECT DISTINCT n FROM bw),
dp AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d),
dg AS (SELECT r, p, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM dp, sizes WHERE p + n - 1 <= len(w)),
m AS (SELECT dg.r, dg.p, dg.n, bw.item_id FROM dg JOIN bw ON dg.g = bw.g AND dg.n = bw.n),
h AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM m) GROUP BY r),
wp AS (SELECT g, unnest(string_split(g, ' ')) AS term, unnest(range(n)) AS off FROM (SELECT DISTINCT g, n FROM bw)),
tc AS (SELECT w[p] AS term, count(*) AS c FROM dp WHERE w[p] IN (SELECT term FROM wp) GROUP BY 1),
rk AS (SELECT g, wp.term, row_number() OVER (PARTITION BY g ORDER BY c, off) AS k, max(CASE WHEN c IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY g) AS missing FROM wp LEFT JOIN tc ON wp.term = tc.term),
an AS (SELECT g, list_sort(list(DISTINCT term)) AS t FROM rk WHERE missing = 0 AND k <= 3 GROUP BY g),
st AS (SELECT DISTINCT t, t[1] AS t1, coalesce(t[2], t[1]) AS t2, coalesce(t[3], t[1]) AS t3 FROM an),
ps AS (SELECT r, p, w[p] AS term FROM dp WHERE w[p] IN (SELECT unnest(t) FROM st)),
nr AS (SELECT DISTINCT st.t, a.r FROM st JOIN ps a ON a.term = st.t1 JOIN ps b ON b.r = a.r AND b.term = st.t2 AND abs(b.p - a.p) < 20
       JOIN ps c ON c.r = a.r AND c.term = st.t3 AND abs(c.p - a.p) < 20 AND abs(c.p - b.p) < 20),
ni AS (SELECT nr.r, count(DISTINCT bw.item_id) AS n_near FROM nr JOIN an ON an.t = nr.t JOIN bw ON bw.g = an.g GROUP BY nr.r),
i AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated, CAST(coalesce(ni.n_near, 0) AS BIGINT) AS n_near_items
FROM d LEFT JOIN h ON d.r = h.r LEFT JOIN i ON d.r = i.r LEFT JOIN ni ON d.r = ni.r
"""
