"""Named queries with their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazy access to the Parquet tables of one directory."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every DOUBLE column to ``digits`` decimals, without negative zero."""
    return df.select(*[
        (F.round(c.name, digits) + F.lit(0.0)).alias(c.name)
        if c.dataType.typeName() in ("double", "float") else F.col(c.name)
        for c in df.schema.fields
    ])


def sql_rounded(sql: str, columns: str, digits: int = 6) -> str:
    cols = ", ".join(f"(round(CAST({c} AS DOUBLE), {digits}) + 0e0) AS {c}" for c in columns.split())
    return f"SELECT * REPLACE ({cols}) FROM ({sql}) rounded_source" if columns else sql


def query(name: str, sql: str | None = None, doubles: str = "", digits: int = 6):
    """Register ``fn(tables) -> DataFrame``; ``doubles`` names the oracle's DOUBLE columns."""

    def add(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return rounded(fn(Tables(spark, folder)), digits)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql_rounded(sql, doubles, digits)
        return fn

    return add
