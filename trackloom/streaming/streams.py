"""Causal operators as Structured Streaming queries over timed rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trackloom.functions.scalars import d


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Event files as a stream with an event-time column ``ts``."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_error(stream: DataFrame, groups: Sequence[str], y: str, p: str, size: str,
                   slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Error metrics per event-time window, final once the watermark passes its end."""
    e = F.col(p) - F.col(y)
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = stream.withWatermark("ts", delay).groupBy(w.alias("w"), *groups).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("signed_bias"),
        F.sqrt(F.avg(e * e)).alias("rmse"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *groups,
                      "n", "mae", "signed_bias", "rmse")


def drop_repeats(stream: DataFrame, keys: Sequence[str], delay: str) -> DataFrame:
    """Repeated rows within the watermark delay are dropped."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def on_sessions(stream: DataFrame, groups: Sequence[str], value: str, threshold: float, gap: str,
                delay: str = "1 hour") -> DataFrame:
    """Sessions of rows above a threshold, split by idle gaps.

    The condition names the event time, which keeps it above the watermark: quiet
    rows must move the watermark too, or the last session would never close.
    """
    above = F.when(F.col("ts").isNotNull(), F.col(value) > d(threshold)).otherwise(F.lit(False))
    hot = stream.withWatermark("ts", delay).where(above)
    out = hot.groupBy(F.session_window("ts", gap).alias("w"), *groups).agg(
        F.count(F.lit(1)).alias("n"), F.max(value).alias("peak"))
    return out.select(*groups, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", "peak")


def causal_context(stream: DataFrame, key: str, order: str, value: str, k: int, delay: str = "1 hour",
                   idle_hours: float | None = None) -> DataFrame:
    """Mean over the current and up to k previous values of a key, in event order.

    State is the last k values per key, so it does not grow with the stream, and it is
    kept for good unless ``idle_hours`` says after how much event time without rows a key
    is forgotten. Rows of a micro-batch are ordered before use.
    """
    schema = T.StructType([stream.schema[key], stream.schema[order], T.StructField("context_mean", T.DoubleType()),
                           T.StructField("context_size", T.IntegerType())])
    state_schema = T.StructType([T.StructField("last", T.ArrayType(T.DoubleType()))])

    def step(k_value, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(order)
        last = list(state.get[0]) if state.exists else []
        means, sizes = [], []
        for v in rows[value]:
            last = last[-k:] + [float(v)]
            means.append(sum(last) / len(last))
            sizes.append(len(last))
        state.update((last[-k:],))
        if idle_hours is not None:
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + int(idle_hours * 3_600_000))
        yield pd.DataFrame({key: rows[key], order: rows[order], "context_mean": means, "context_size": sizes})

    timed = stream.withWatermark("ts", delay)
    return timed.groupBy(key).applyInPandasWithState(step, schema, state_schema, "append", GroupStateTimeout.EventTimeTimeout)


def run_to_files(stream: DataFrame, folder: str) -> DataFrame:
    """Process all available input into Parquet under ``folder`` and return it."""
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
