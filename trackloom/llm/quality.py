"""Quality rules: lines that many documents of a host repeat go, and depleted documents are rejected.

DataFrame functions only.

Defined cases: a null text has no words and one empty line; a null source is a host of its own;
repeated rows count as documents of their own and each gets its row; an empty table gives an
empty result. Two lines are equal if their 64-bit hashes are, per host or per text; likewise
eight-word windows within a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import BROADCAST_ROWS, SPACE, SPACE_CHARS, join_counted, store

WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
#: A line is frequent on a host beyond both of these documents: a number and a share of the host's.
LINE_DOCUMENTS = 20
LINE_SHARE = 0.05
#: A document is depleted if frequent lines hold more than this share of its characters.
DEPLETED_SHARE = 0.5


def normal(line: Column) -> Column:
    return F.lower(F.btrim(line, F.lit(SPACE_CHARS)))


def repeated_words(windows: str) -> Column:
    """Words covered by windows whose hash occurs twice or more, by a sort of (hash, position)."""
    order = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    pairs = F.zip_with(order, F.slice(order, F.lit(2), F.greatest(F.size(order) - 1, F.lit(0))), lambda a, b: F.when(
        a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    at = F.sort_array(F.array_distinct(F.flatten(pairs)))
    steps = F.zip_with(at, F.slice(at, F.lit(2), F.greatest(F.size(at) - 1, F.lit(0))),
                       lambda p, q: F.least(F.coalesce(q - p, F.lit(WINDOW)), F.lit(WINDOW)))
    return F.aggregate(steps, F.lit(0), lambda a, s: a + s)


def measured(docs: DataFrame) -> DataFrame:
    """One narrow row per document: the base figures and (hash, characters) of each line with a word."""
    whole = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.col("source").alias("host"),
        F.array_remove(F.split(whole, f"{SPACE}+"), "").alias("words"),
        (F.length(whole) - F.length(F.regexp_replace(whole, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(whole, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE_CHARS))) > 0).alias("text_lines"))
    hashes = F.transform("words", lambda w: F.xxhash64(w))
    out = out.withColumn("hashes", hashes)
    windows = F.when(F.size("hashes") >= WINDOW, F.transform(
        F.sequence(F.lit(1), F.size("hashes") - WINDOW + 1), lambda i: F.xxhash64(F.slice("hashes", i, WINDOW)))
    ).otherwise(F.array().cast("array<bigint>"))
    out = out.select(
        "row", "doc_id", "host", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"), "n_symbols",
        (F.size("text_lines") - F.size(F.array_distinct("text_lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"),
        F.transform("text_lines", lambda x: F.struct(
            F.xxhash64(normal(x)).alias("line"), F.length(F.btrim(x, F.lit(SPACE_CHARS))).alias("chars"))).alias("lines"))
    repeats = F.size("windows") > F.size(F.array_distinct("windows"))
    return out.select(
        "row", "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.when(repeats, repeated_words("windows")).otherwise(0).cast("long").alias("n_repeat_words"), "lines",
        F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["chars"]).alias("line_chars"))


def frequent_lines(rows: DataFrame) -> DataFrame:
    """(host, line, n_docs, n_rows) of the lines in more documents of their host than both limits allow."""
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    lines = rows.select("host", F.explode(F.array_distinct(F.col("lines.line"))).alias("line"))
    counts = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") > LINE_DOCUMENTS)
    if hosts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        hosts = F.broadcast(hosts)
    same = F.expr("counts.host <=> hosts.host")
    return (counts.alias("counts").join(hosts.alias("hosts"), same)
            .where(F.col("n_docs") > LINE_SHARE * F.col("host_docs"))
            .select("counts.host", "line", "n_docs"))


def apply_rules(docs: DataFrame) -> DataFrame:
    """Base figures, the share of each document that frequent lines hold, and the verdict.

    Text is read once; what follows uses the stored narrow rows. Lines are counted with partial
    sums, so a line of a third of all documents is one row per task.
    """
    rows = store(measured(docs), "quality-rows")
    frequent = store(frequent_lines(rows), "quality-lines")
    number = frequent.count()
    lines = rows.select("row", "host", F.explode("lines").alias("l")).select(
        "row", F.coalesce("host", F.lit("")).alias("host"), F.col("host").isNull().alias("hostless"), "l.line", "l.chars")
    marks = frequent.select(F.coalesce("host", F.lit("")).alias("host"), F.col("host").isNull().alias("hostless"),
                            "line", "n_docs")
    keys = ["host", "hostless", "line"]
    if number <= BROADCAST_ROWS:
        met = lines.join(F.broadcast(marks.drop("n_docs")), keys)
    else:
        met = join_counted(lines, marks, keys, "n_docs", rows.count())
    removed = met.groupBy("row").agg(F.sum("chars").alias("removed_chars"), F.count(F.lit(1)).alias("n_removed"))
    share = F.coalesce(F.col("removed_chars"), F.lit(0)) / F.greatest(F.col("line_chars"), F.lit(1))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return rows.drop("lines").join(removed, "row", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_lines_removed"),
        failed.alias("base_failed"), (~failed & (share <= DEPLETED_SHARE)).alias("kept"))


def remove_lines(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """``docs`` with the lines of ``frequent`` cut from their texts; n_chars follows if present."""
    plain = F.struct(*[F.col(c) for c in docs.columns]).alias("doc")
    rows = store(docs.select(F.monotonically_increasing_id().alias("row"), plain), "quality-docs")
    parts = rows.select("row", F.coalesce("doc.source", F.lit("")).alias("host"), F.explode(F.array_distinct(
        F.transform(F.split(F.col("doc.text"), "\n"), lambda x: F.xxhash64(normal(x))))).alias("line"))
    marks = frequent.select(F.coalesce("host", F.lit("")).alias("host"), "line", "n_docs")
    hits = join_counted(parts, marks, ["host", "line"], "n_docs", parts.count())
    gone = hits.groupBy("row").agg(F.collect_set("line").alias("gone"))
    left = F.array_join(F.filter(F.split(F.col("doc.text"), "\n"), lambda x: ~F.array_contains(
        F.col("gone"), F.xxhash64(normal(x)))), "\n")
    text = F.when(F.col("gone").isNull(), F.col("doc.text")).otherwise(left)
    out = rows.join(gone, "row", "left").withColumn("new_text", text)
    new = {"text": F.col("new_text"), "n_chars": F.length("new_text").cast("long")}
    return out.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
