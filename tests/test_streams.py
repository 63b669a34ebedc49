"""Streams over several micro-batches: idle keys, late rows, repeats and sessions."""

import time

from pyspark.sql import functions as F

from trackloom.streaming import streams as W

SHAPE = "k int, ts timestamp, i int, v double"


def stream_of(spark, folder, batches):
    """One file, and one micro-batch, per list of (k, seconds after a start, i, v)."""
    for rows in batches:
        df = spark.createDataFrame([(k, s, i, float(v)) for k, s, i, v in rows], "k int, s long, i int, v double")
        df.select("k", F.timestamp_seconds(F.col("s") + 10 ** 9).alias("ts"), "i", "v").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(1.1)
    return spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


DAY = 86_400
IDLE = [[(1, 0, 0, 2), (1, 10, 1, 4), (2, 0, 0, 1)], [(2, 5 * DAY, 1, 3)], [(2, 9 * DAY, 2, 5)], [(1, 9 * DAY + 60, 2, 6)]]


def test_a_key_that_pauses_keeps_its_context(spark, tmp_path):
    stream = stream_of(spark, tmp_path, IDLE)
    out = W.run_to_files(W.causal_context(stream, "k", "i", "v", 2), f"{tmp_path}/a")
    got = {(r["k"], r["i"]): (r["context_mean"], r["context_size"]) for r in out.collect()}
    assert got == {(1, 0): (2.0, 1), (1, 1): (3.0, 2), (1, 2): (4.0, 3), (2, 0): (1.0, 1), (2, 1): (2.0, 2), (2, 2): (3.0, 3)}


def test_a_key_is_forgotten_only_when_asked(spark, tmp_path):
    stream = stream_of(spark, tmp_path, IDLE)
    out = W.run_to_files(W.causal_context(stream, "k", "i", "v", 2, idle_hours=48), f"{tmp_path}/a")
    got = {(r["k"], r["i"]): r["context_size"] for r in out.collect()}
    assert got[1, 2] == 1


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    stream = stream_of(spark, tmp_path, [
        [(1, 100, 0, 1), (1, 200, 1, 3)], [(1, 2 * DAY, 2, 5)], [(1, 2 * DAY + 10, 6, 5)],
        [(1, 300, 3, 100), (1, 3 * DAY, 4, 7)], [(1, 9 * DAY, 5, 1)]])
    rows = stream.withColumn("y", F.lit(0.0))
    out = W.run_to_files(W.windowed_error(rows, ["k"], "y", "v", "1 hour"), f"{tmp_path}/a")
    got = sorted((r["window_start"].timestamp(), r["n"], r["mae"]) for r in out.collect())
    assert [g[1:] for g in got][:3] == [(2, 2.0), (2, 5.0), (1, 7.0)]


def test_repeats_across_batches_are_dropped(spark, tmp_path):
    stream = stream_of(spark, tmp_path, [[(1, 0, 0, 1), (1, 1, 1, 2)], [(1, 0, 0, 1), (1, 2, 2, 3)]])
    out = W.run_to_files(W.drop_repeats(stream, ["k", "i"], "1 hour"), f"{tmp_path}/a")
    assert sorted(r["i"] for r in out.collect()) == [0, 1, 2]


def test_sessions_span_batches_and_close_by_quiet_rows(spark, tmp_path):
    stream = stream_of(spark, tmp_path, [[(1, 0, 0, 9), (1, 60, 1, 8)], [(1, 120, 2, 9.5)], [(1, DAY, 3, 0)], [(1, 2 * DAY, 4, 0)]])
    out = W.run_to_files(W.on_sessions(stream, ["k"], "v", 5.0, "5 minutes"), f"{tmp_path}/a")
    assert [(r["n"], r["peak"]) for r in out.collect()] == [(3, 9.5)]
