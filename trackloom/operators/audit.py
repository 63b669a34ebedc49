"""Integrity jobs: fingerprints, locks, assertions, text scans and manifests."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.scalars import d
from trackloom.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The credential pattern and the home-folder pattern.
SECRET_PATTERN = (r"(?i)(api[_-]?key|secret[_-]?key|access[_-]?token|password|private[_-]?key)"
                  r"\s*[:=]\s*[\"']?[A-Za-z0-9_+/.=-]{12,}")
HOME_PATTERN = r"(/home|/Users)/[^/\s,\"']+"
SIZE_LIMITS_MB = (50, 100)


def row_digest(columns: Sequence[str]) -> Column:
    """Order-independent addend: 60 bits of the md5 of a row's values. Each value carries its
    length, and NULL a sign of its own, so different rows have different texts."""
    values = [F.col(c).cast("string") for c in columns]
    text = F.concat(*[F.coalesce(F.concat(F.length(v), F.lit(":"), v), F.lit("~")) for v in values])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def fingerprint(df: DataFrame, columns: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Row count and additive digest; equal tables agree whatever their row order.

    Sums combine on the map side, so nothing is sorted or gathered; as decimals they
    do not overflow on any table size.
    """
    return df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(row_digest(columns).cast("decimal(28,0)")).cast("string").alias("digest"))


def matrix_digest(matrix: Column) -> Column:
    """sha-256 of the little-endian doubles of an array, missing ones as NaN; null for a null array."""

    @F.pandas_udf("string")
    def digest(rows: pd.Series) -> pd.Series:
        return rows.map(lambda v: None if v is None else hashlib.sha256(np.asarray(v, "<f8").tobytes()).hexdigest())

    return digest(F.transform(matrix, lambda v: v.cast("double")))


def exact_digest(df: DataFrame, columns: Sequence[str], width: int = 10_000) -> DataFrame:
    """sha-256 of a table as a multiset of rows, by a tree of hashes.

    Rows become (hash, count) pairs, which fall into buckets of about ``width`` by their
    hash; a bucket's hash is that of its sorted pairs, and buckets are hashed again in
    groups of ``width`` until one is left. Equal tables have equal trees however their rows
    are ordered or partitioned, and no task holds more than one bucket.
    """
    rows = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    pairs = df.select(F.sha2(rows, 256).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    pairs = materialize(pairs)
    parts = 1 + pairs.count() // width
    level = pairs.select(F.pmod(F.conv(F.substring("h", 1, 15), 16, 10).cast("long"), F.lit(parts)).alias("part"),
                         F.concat_ws(":", "h", "n").alias("own"))
    while True:
        done = level.groupBy("part").agg(F.sha2(F.concat_ws(",", F.sort_array(F.collect_list("own"))), 256).alias("own"))
        if parts == 1:
            return done.groupBy().agg(F.coalesce(F.max("own"), F.sha2(F.lit(""), 256)).alias("sha256"))
        named = F.concat_ws(":", F.lpad(F.col("part").cast("string"), 20, "0"), "own")
        level = done.select((F.col("part") / width).cast("long").alias("part"), named.alias("own"))
        parts = 1 + (parts - 1) // width


def lock_violations(artifacts: DataFrame, lock: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Artifacts whose hash differs from, or is absent in, the lock, and lock rows never met."""
    a = artifacts.select(*key, F.col(value).alias("found"))
    b = lock.select(*key, F.col(value).alias("locked"))
    both = a.join(b, list(key), "full")
    status = (F.when(F.col("locked").isNull(), "not_locked").when(F.col("found").isNull(), "missing_artifact")
              .when(F.col("found") != F.col("locked"), "hash_mismatch"))
    return both.withColumn("violation", status).where(F.col("violation").isNotNull())


def audit_rows(checks: DataFrame) -> DataFrame:
    """Pass flag per (section, requirement, expected, observed, tolerance) row.

    Numbers compare within the tolerance, other text exactly.
    """
    e, o = F.col("expected").try_cast("double"), F.col("observed").try_cast("double")
    close = F.abs(e - o) <= F.coalesce(F.col("tolerance"), d(0))
    return checks.withColumn("passed", F.coalesce(close, F.col("expected").eqNullSafe(F.col("observed"))))


def audit_status(rows: DataFrame) -> DataFrame:
    return rows.groupBy().agg(
        F.count(F.lit(1)).alias("checks"), F.count_if(~F.col("passed")).alias("failed"),
        F.when(F.bool_and("passed"), "PASS").otherwise("FAIL").alias("status"))


def metric_assertions(metrics: DataFrame, frozen: DataFrame, key: Sequence[str], value: str,
                      tolerance: float = 1e-6) -> DataFrame:
    """Frozen metric values against recomputed ones; missing or non-finite is a violation."""
    both = frozen.join(metrics.select(*key, F.col(value).alias("_now")), list(key), "left")
    ok = F.coalesce(~F.isnan("_now") & (F.abs(F.col("_now") - F.col(value)) <= d(tolerance)), F.lit(False))
    return both.groupBy().agg(F.count(F.lit(1)).alias("asserted"), F.count_if(~ok).alias("violations"))


def text_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per line, numbered from 1."""
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("_i", "line")).select(
        key, (F.col("_i") + 1).alias("line_number"), "line")


def phrase_scan(df: DataFrame, key: str, text: str, phrases: Sequence[str]) -> DataFrame:
    """Every (line, phrase) hit, case-insensitive, over whole texts."""
    low = F.lower("line")
    hits = F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(low, F.lower(p)))
    lines = text_lines(df, key, text)
    return lines.withColumn("phrase", F.explode(hits)).select(key, "line_number", "phrase", F.trim("line").alias("line"))


def sanitize_text(text: Column, root: str, datasets: Sequence[str] = ()) -> Column:
    """Project root, data folders below it and home folders replaced by placeholders."""
    out = F.replace(text, F.lit(root + "/"), F.lit("${PROJECT_ROOT}/"))
    out = F.replace(out, F.lit(root), F.lit("${PROJECT_ROOT}"))
    for name in datasets:
        out = F.replace(out, F.lit(f"${{PROJECT_ROOT}}/{name}/"), F.lit(f"${{DATA_ROOT}}/{name}/"))
    return F.regexp_replace(out, F.lit(HOME_PATTERN), F.lit("\\${USER_HOME}"))


def privacy_flags(text: Column) -> dict[str, Column]:
    return {"has_secret": text.rlike(SECRET_PATTERN), "has_home_path": text.rlike(HOME_PATTERN)}


URL = r"^[a-z]+://([^/?#]+)([^?#]*)"


def resolved(base: Column, target: Column) -> Column:
    """The path of ``target`` as seen from the page at path ``base``, dot segments applied."""
    whole = F.when(F.startswith(target, F.lit("/")), target).otherwise(
        F.concat(F.regexp_replace(base, "[^/]*$", ""), target))
    kept = F.aggregate(
        F.split(F.regexp_replace(whole, r"/\.?$", "/"), "/"), F.array().cast("array<string>"),
        lambda path, part: F.when(part == "..", F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(1))))
        .when(part == ".", path).otherwise(F.concat(path, F.array(part))))
    return F.array_join(kept, "/")


def relative_links(df: DataFrame, key: str, url: str, text: str, pattern: str) -> DataFrame:
    """(key, host, target): links within the page's host as full paths, without query and
    fragment; absolute and mail links drop out."""
    out = df.select(key, F.regexp_extract(url, URL, 1).alias("host"), F.regexp_extract(url, URL, 2).alias("_base"),
                    F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), 1)).alias("_t"))
    out = out.withColumn("_t", F.trim(F.regexp_replace("_t", "[?#].*$", "")))
    out = out.where((F.col("_t") != "") & ~F.contains("_t", F.lit("://")) & ~F.startswith("_t", F.lit("mailto:")))
    return out.select(key, "host", resolved(F.col("_base"), F.col("_t")).alias("target"))


def broken_links(links: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Targets that do not exist on their host, with the number of links to them.

    Links are counted per target first, so a target on a third of all pages is one row
    in the join.
    """
    counted = links.groupBy("host", "target").agg(F.count(F.lit(1)).alias("links"), F.min(key).alias(f"first_{key}"))
    return counted.join(known.select("host", "target").distinct(), ["host", "target"], "left_anti")


def manifest_summary(files: DataFrame, forbidden: Sequence[str]) -> DataFrame:
    """Per category: files, bytes, largest, size-limit and forbidden-extension counts."""
    mb = F.col("length") / d(1024 * 1024)
    ext = F.lower(F.regexp_extract("name", r"(\.[^.]+)$", 1))
    return files.groupBy("category").agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.max("length").alias("largest"),
        *[F.count_if(mb > d(m)).alias(f"over_{m}_mb") for m in SIZE_LIMITS_MB],
        F.count_if(ext.isin(*forbidden)).alias("forbidden"))
