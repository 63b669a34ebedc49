"""Runs, active intervals, segments and the block bootstrap over ordered positions."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.functions.scalars import FRAMES, d, frame_position_mm
from trackloom.operators.ordered import halo_blocks, longest_true_run, neighbour, quantile_columns
from trackloom.session import attach

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Positions of a group whose blocks are summed together; a start within them takes two bytes.
CHUNK = 1 << 16


def increments(df: DataFrame, groups: Sequence[str], index: str, x: str, value: str) -> DataFrame:
    """Index, x and value change from the previous row, with repeat flags."""
    near = neighbour(df, groups, index, [index, x, value], "_p_")
    step = F.abs(F.col(value) - F.col(f"_p_{value}"))
    return near.select(
        *groups, index, (F.col(index) - F.col(f"_p_{index}")).alias("index_increment"),
        (F.col(x) - F.col(f"_p_{x}")).alias("x_increment"), step.alias("value_change"),
        F.coalesce(step == 0, F.lit(False)).alias("duplicate"),
        F.coalesce(step < d(1e-6), F.lit(False)).alias("near_duplicate"))


def active_threshold(df: DataFrame, groups: Sequence[str], index: str, score: str) -> DataFrame:
    """Per group: max of the 20% range level and median + 8 scaled MADs of the lead-in.

    The lead-in is the first max(5, n // 10) rows.
    """
    stats = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.min(score).alias("lo"), F.max(score).alias("hi"))
    lead = attach(df, stats.select(*groups, "n"), groups).where(
        F.col(index) < F.greatest(F.lit(5).cast("long"), F.floor(F.col("n") / 10)))
    med = quantile_columns(lead, groups, score, {"med": 0.5})
    dev = attach(lead, med, groups).withColumn("_dev", F.abs(F.col(score) - F.col("med")))
    mad = quantile_columns(dev, groups, "_dev", {"mad": 0.5})
    spread = F.greatest(d(1.4826) * F.col("mad"), d(1e-12))
    level = F.greatest(F.col("lo") + d(0.20) * (F.col("hi") - F.col("lo")), F.col("med") + d(8) * spread)
    return stats.join(med, list(groups)).join(mad, list(groups)).select(
        *groups, "n", level.alias("threshold"))


def active_interval(df: DataFrame, groups: Sequence[str], index: str, score: str) -> DataFrame:
    """Longest run above the threshold as [start, stop); NULL when nothing is above."""
    level = active_threshold(df, groups, index, score)
    rows = attach(df, level, groups)
    run = longest_true_run(rows, groups, index, F.col(score) > F.col("threshold"))
    return level.join(run, list(groups), "left")


def final_segment(df: DataFrame, groups: Sequence[str], index: str, interval: DataFrame,
                  frames: int = FRAMES) -> DataFrame:
    """The last ``frames`` rows before the end of the active run, with their x."""
    rows = attach(df, interval.select(*groups, "stop"), groups)
    start = F.greatest(F.lit(0).cast("long"), F.col("stop") - frames)
    return rows.where((F.col(index) >= start) & (F.col(index) < F.col("stop"))).withColumn(
        "x_mm", frame_position_mm(F.col(index), F.col("stop")))


def exemplars(df: DataFrame, groups: Sequence[str], index: str) -> DataFrame:
    """First, middle and last row of each group by dense index."""
    n = df.groupBy(*groups).agg(F.max(index).alias("_last"))
    rows = attach(df, n, groups)
    kind = (F.when(F.col(index) == 0, "begin").when(F.col(index) == F.col("_last"), "end")
            .when(F.col(index) == F.floor(F.col("_last") / 2), "middle"))
    return rows.withColumn("kind", kind).where(F.col("kind").isNotNull()).drop("_last")


def boundary_exemplars(df: DataFrame, groups: Sequence[str], index: str, flag: Column) -> DataFrame:
    """Per group the first flagged row, or the first row where none is flagged."""
    names = [c for c in df.columns if c not in groups]
    order = F.struct((~F.coalesce(flag, F.lit(False))).alias("a"), F.col(index).alias("b"))
    best = df.groupBy(*groups).agg(F.min_by(F.struct(*names), order).alias("_r"))
    return best.select(*groups, "_r.*").withColumn("kind", F.lit("near_boundary"))


def block_hashes(draw: int, blocks: range) -> np.ndarray:
    """60 bits of a hash per block of a draw; modulo the choices, the block's uniform start."""
    digests = [hashlib.md5(f"{draw}_{j}".encode(), usedforsecurity=False).digest() for j in blocks]
    return (np.frombuffer(b"".join(digests), ">u8")[::2] >> 4).astype(np.int64)


def drawn_starts(plan: DataFrame, groups: Sequence[str], task_blocks: int) -> DataFrame:
    """(groups, _n, _tail, draw, _chunk, starts, last): the block starts of each draw by the chunk of
    positions they fall in, two bytes each within it. ``last`` is the start of a draw's last block.

    Groups that share a draw and a piece of it share its hashes.
    """
    kept = [*groups, "_n", "_tail", "draw"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hashes = None, None
        for batch in batches:
            at, chunks, starts, lasts, weight = [], [], [], [], 0
            names = ("draw", "_piece", "_k", "_choices")
            for i, (draw, piece, k, choices) in enumerate(zip(*(batch.column(c).to_pylist() for c in names), strict=True)):
                own = range(piece * task_blocks, min(k, (piece + 1) * task_blocks))
                if held != (draw, piece) or len(hashes) < len(own):
                    held, hashes = (draw, piece), block_hashes(draw, own)
                place = hashes[:len(own)] % choices
                tail = int(place[-1]) if own.stop == k else None
                place = np.sort(place[:-1] if own.stop == k else place)
                found, first = np.unique(place // CHUNK, return_index=True)
                pieces = dict(zip(found.tolist(), np.split((place % CHUNK).astype("<u2"), first[1:]), strict=True)) if len(place) else {}
                if tail is not None:
                    pieces.setdefault(tail // CHUNK, np.zeros(0, "<u2"))
                for c, part in pieces.items():
                    at.append(i)
                    chunks.append(c)
                    starts.append(part.tobytes())
                    lasts.append(tail % CHUNK if tail is not None and tail // CHUNK == c else None)
                weight += len(own)
                if weight >= 1 << 21 or i == batch.num_rows - 1:
                    out = batch.select(kept).take(pa.array(at, pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [*out.columns, pa.array(chunks, pa.int64()), pa.array(starts, pa.binary()), pa.array(lasts, pa.int32())],
                        [*kept, "_chunk", "starts", "last"])
                    at, chunks, starts, lasts, weight = [], [], [], [], 0

    schema = T.StructType([plan.schema[c] for c in kept]).add("_chunk", T.LongType()).add("starts", T.BinaryType()).add("last", T.IntegerType())
    return plan.select(*kept, "_piece", "_k", "_choices").mapInArrow(rows, schema)


def chunk_sums(groups: Sequence[str], index: str, diff: str, block: int) -> Callable:
    """For a cogroup of drawn starts and positions of a chunk: the sum of each draw's blocks there."""

    def sums(key: tuple, drawn: pa.Table, values: pa.Table) -> pa.Table:
        at = values.column(index).to_numpy() - key[-1].as_py() * CHUNK
        own, known = at >= 0, values.column(diff).is_valid().to_numpy()
        size = int(at.max()) + 1 if len(at) else 0
        line, ok = np.zeros(size + block), np.zeros(size + block, bool)
        line[at[own & known]] = values.column(diff).to_numpy()[own & known]
        ok[at[own & known]] = True
        m = min(size, CHUNK)
        tail = drawn.column("_tail")[0].as_py() if len(drawn) else 0
        full, cut, taken = np.zeros(m), np.zeros(m), np.zeros(m, np.int64)
        for k in range(block):
            full += line[k:k + m]
            take = ok[k:k + m] & (taken < tail)
            cut += np.where(take, line[k:k + m], 0.0)
            taken += take
        part = [float(full[np.frombuffer(s, "<u2")].sum()) + (0.0 if e is None else float(cut[e]))
                for s, e in zip(drawn.column("starts").to_pylist(), drawn.column("last").to_pylist(), strict=True)]
        return drawn.select([*groups, "_n", "draw"]).append_column("_part", pa.array(part, pa.float64()))

    return sums


def block_bootstrap(df: DataFrame, groups: Sequence[str], index: str, diff: str, block: int,
                    draws: int, task_blocks: int = 1 << 16) -> DataFrame:
    """Moving-block bootstrap of the mean of ``diff``: one row per (group, draw).

    A draw takes ceil(n / block) hashed block starts, the last one cut so that n rows are used.
    Missing values add nothing; the cut block takes the first known ones. Starts are made in pieces
    of ``task_blocks`` by many tasks and shuffled as two bytes each to the chunk of positions they
    fall in, where the sum of each possible block is built once. Nothing is broadcast.
    """
    df = df.select(*groups, F.col(index).cast("long").alias(index), F.col(diff).cast("double").alias(diff)).dropna(subset=list(groups))
    sizes = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    blocks = F.ceil(F.col("_n") / block)
    sizes = sizes.withColumns({"_k": blocks, "_tail": F.col("_n") - (blocks - 1) * block,
                               "_choices": F.col("_n") - F.least(F.lit(block).cast("long"), F.col("_n")) + 1})
    pieces = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_k") - 1) / task_blocks))
    plan = sizes.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    # A fixed partition count: adaptive execution would merge these few rows, which
    # stand for many, into one task.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plan = plan.withColumn("_piece", F.explode(pieces)).repartition(tasks, "draw", "_piece")
    plan = plan.sortWithinPartitions("draw", "_piece", F.desc("_k"))
    starts = drawn_starts(plan, groups, task_blocks)
    values = halo_blocks(df, groups, index, 0, block - 1, CHUNK).select(*groups, "_chunk", index, diff)
    schema = T.StructType([starts.schema[c] for c in (*groups, "_n", "draw")]).add("_part", T.DoubleType())
    parts = starts.groupBy(*groups, "_chunk").cogroup(values.groupBy(*groups, "_chunk")).applyInArrow(
        chunk_sums(groups, index, diff, block), schema)
    return parts.groupBy(*groups, "draw").agg((F.sum("_part") / F.first("_n")).alias("mean_difference"))


def bootstrap_interval(draws: DataFrame, groups: Sequence[str]) -> DataFrame:
    """2.5 and 97.5 percentiles; a group has as many rows as draws."""
    return draws.groupBy(*groups).agg(
        F.percentile("mean_difference", F.lit(0.025)).alias("ci_low"),
        F.percentile("mean_difference", F.lit(0.975)).alias("ci_high"))
