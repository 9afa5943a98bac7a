"""Line dedup: a log-template tree of fixed depth, and recurring templates.

A line's tokens are its runs between white space; a token with a digit is a variable. The tree has three levels: the number
of tokens, and the leading tokens (LEADING, variables masked). Inside a leaf a token is constant at its place if lines of
MIN_DOCS texts or more have it there, else variable; a line's template is its leaf and its constants by place. A template
whose constants are at least SIMILAR of its tokens and that lines of MIN_DOCS distinct texts share is recurring, and every
line of it is dropped. So the parse doesn't depend on the order of lines, and splits over machines.

Fields whose values are words become constants as the corpus grows, and would split their template into rare parts. So a
line has a wide template beside: of its tokens without a digit, the rarest at their places are taken as fields, FIELDS of
its tokens at most, and the others are its constants, again SIMILAR of its tokens at least. Lines of a wide template that
recurs are dropped as well, so a template is found at every size of the corpus if its words are commoner than its fields.

Documents with equal texts count once. Only leaves that MIN_DOCS texts share have their lines read again, as distinct lines
with counts; sums are made before they are shuffled, so a frequent line costs a row per task.

Defined cases: an empty table gives no rows; a null text has no lines; lines without tokens are never dropped; rows with
equal doc_id are cleaned each; a text whose every line is dropped becomes empty; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import documents, small, stage

MIN_DOCS = 8
LEADING = 2
SIMILAR = 0.5
#: Share of a line's tokens that may be fields of words, in whole tokens.
FIELDS = 0.25
#: Rows of a table of leaves, lines or documents that may be broadcast.
SMALL_ROWS = 500_000
SPACE = r"[\x20\x09-\x0D]+"
VARIABLE = "<*>"


def tokens(line: Column) -> Column:
    return F.array_remove(F.split(line, SPACE), "")


def masked(token: Column) -> Column:
    return F.when(token.rlike("[0-9]"), F.lit(VARIABLE)).otherwise(token)


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, hash, number, line, tokens, leaf of every line with a token."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), F.posexplode(F.split("text", "\n")).alias("number", "line"))
    rows = rows.withColumn("tokens", tokens(F.col("line"))).filter(F.size("tokens") > 0)
    lead = F.transform(F.slice("tokens", 1, LEADING), masked)
    return rows.withColumn("leaf", F.xxhash64(F.size("tokens"), F.array_join(lead, " ")))


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """The places (doc_id, hash, number, line_hash) of all lines, and the line_hash, template of the lines to drop. Both staged."""
    places = stage(_lines(docs).select("doc_id", "hash", "number", "leaf", F.xxhash64("line").alias("line_hash")), "line-places")
    shared = places.select("leaf", "hash").distinct().groupBy("leaf").count().filter(F.col("count") >= min_docs).select("leaf")
    shared = stage(shared, "line-leaves")
    held = places.join(small(shared, SMALL_ROWS), "leaf").select("leaf", "line_hash", "hash").distinct()
    weights = stage(held.groupBy("leaf", "line_hash").agg(F.count("*").alias("texts")), "line-weights")
    # one copy of each line of those leaves, read again
    texts = _lines(docs).join(small(shared, SMALL_ROWS), "leaf").select("leaf", F.xxhash64("line").alias("line_hash"), "line")
    one = texts.groupBy("leaf", "line_hash").agg(F.first("line").alias("line")).join(weights, ["leaf", "line_hash"])
    each = stage(one.select("leaf", "line_hash", "texts", F.posexplode(tokens(F.col("line"))).alias("place", "token")).withColumn("token", F.xxhash64(masked(F.col("token")))), "line-tokens")
    word = F.col("token") != F.xxhash64(F.lit(VARIABLE))
    constants = each.filter(word).groupBy("leaf", "place", "token").agg(F.sum("texts").alias("n")).filter(F.col("n") >= min_docs)
    constants = stage(constants, "line-constants")
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "place", "token"))).alias("ranked")  # a line's own tokens
    held = each.join(small(constants, SMALL_ROWS), ["leaf", "place", "token"])
    fixed = held.groupBy("leaf", "line_hash").agg(F.count("*").alias("fixed"), F.sum(F.shiftright(F.xxhash64("place", "token"), 16)).alias("content"), ranked)
    length = each.groupBy("leaf", "line_hash").agg(F.count("*").alias("length"), F.count_if(word).alias("words"))
    lines = fixed.join(length, ["leaf", "line_hash"]).filter(F.col("fixed") >= SIMILAR * F.col("length"))
    fields = F.floor(FIELDS * F.col("length"))
    kept = F.greatest(F.ceil(SIMILAR * F.col("length")), F.col("words") - fields).cast("int")
    wide = F.when((fields > 0) & (F.col("fixed") >= kept), F.xxhash64("leaf", F.slice("ranked", F.lit(1), kept)))
    both = F.array(F.struct(F.lit(0).alias("wide"), F.xxhash64("leaf", "content").alias("template")), F.struct(F.lit(1).alias("wide"), wide.alias("template")))
    lines = stage(lines.select("leaf", "line_hash", F.inline(both)).filter("template is not null"), "line-templates")
    seen = places.select("leaf", "line_hash", "hash").join(small(lines, SMALL_ROWS), ["leaf", "line_hash"]).select("template", "hash").distinct()
    often = seen.groupBy("template").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs)
    # a line is named by its wide template if that recurs
    found = lines.join(often, "template").groupBy("line_hash").agg(F.max(F.struct("wide", "template")).alias("found"))
    return places, stage(found.select("line_hash", "found.template"), "line-dropped")


def drops(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """The places of all lines, and doc_id, hash, numbers (of its lines to drop), templates of each text that has some."""
    places, lines = recurring_lines(docs, min_docs)
    hit = places.join(small(lines, SMALL_ROWS), "line_hash").select("doc_id", "hash", "number", "template").distinct()
    return places, hit.groupBy("doc_id", "hash").agg(F.array_sort(F.collect_set("number")).alias("numbers"), F.countDistinct("template").alias("templates"))


def clean(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """`docs` with the recurring lines taken out of column text."""
    _, hit = drops(docs, min_docs)
    hit = small(stage(hit.select(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash"), F.col("numbers").alias("__numbers")), "line-drops"), SMALL_ROWS)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash"))
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("__numbers", i))
    text = F.when(F.col("__numbers").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return docs.join(hit, same, "left").withColumn("text", text).select(*docs.columns)


def report(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines (with a token), n_dropped, n_templates of every row."""
    _, hit = drops(docs, min_docs)
    hit = hit.select(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash"), F.size("numbers").alias("dropped"), "templates")
    worded = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.length(F.regexp_replace(x, SPACE, "")) > 0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), worded.alias("n_lines"))
    out = rows.join(hit, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("hash") == F.col("__hash")), "left")
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.coalesce("dropped", F.lit(0)).cast("long").alias("n_dropped"), F.coalesce("templates", F.lit(0)).cast("long").alias("n_templates"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(documents(spark, sf_dir))
