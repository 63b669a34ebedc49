"""Ordered-sequence operators that never put a whole group into one task.

Rows are cut into *blocks*: contiguous ranges of the ordering key, balanced from
a bounded sample. Windows run inside (group, block); what crosses a block edge
is a small per-block summary, combined by a window over at most a few thousand
blocks of a group. The cuts are literals in the plan, so a recomputed task sees
the same blocks as the first attempt.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.session import attach

BLOCK = "_blk"
ROWS_PER_BLOCK_CONF = "trackloom.rowsPerBlock"
DEFAULT_ROWS_PER_BLOCK = 1_000_000
MAX_BLOCKS = 4096
SAMPLE_PER_BLOCK = 100


def rows_per_block(spark: SparkSession) -> int:
    return int(spark.conf.get(ROWS_PER_BLOCK_CONF, str(DEFAULT_ROWS_PER_BLOCK)))


@dataclass(frozen=True)
class Blocked:
    """Rows with a block column; ``heavy`` lists the blocks holding one key value."""

    df: DataFrame
    single: bool
    heavy: tuple[int, ...] = ()


def _numeric(df: DataFrame, key: str) -> Column:
    """The key as a DOUBLE in the same order; wall-clock times without a zone."""
    if dict(df.dtypes)[key] != "timestamp_ntz":
        return F.col(key).cast("double")
    seconds = F.extract(F.lit("SECOND"), key).cast("double")
    days = F.datediff(key, F.lit("1970-01-01").cast("date"))
    return days * F.lit(86400.0) + F.hour(key) * 3600 + F.minute(key) * 60 + seconds


def _cuts(df: DataFrame, key: str, n: int, rows: int) -> tuple[list[float], set[float]]:
    parts = min(MAX_BLOCKS, math.ceil(n / rows))
    fraction = min(1.0, SAMPLE_PER_BLOCK * parts / n)
    sample = df.select(_numeric(df, key).alias("k"))
    if fraction < 1.0:
        sample = sample.sample(fraction, seed=7)
    probs = [i / parts for i in range(1, parts)]
    values = sample.agg(F.percentile_approx("k", probs, 20 * MAX_BLOCKS)).first()[0] or []
    heavy = {v for v, c in Counter(values).items() if c > 1}
    cuts = set(values) | {math.nextafter(v, math.inf) for v in heavy}
    return sorted(cuts), heavy


def _bucket(df: DataFrame, key: str, cuts: list[float], name: str) -> DataFrame:
    if not cuts:
        return df.withColumn(name, F.lit(0))
    keyed = df.withColumn("_key", _numeric(df, key))
    cutter = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="_key", outputCol=name,
                        handleInvalid="keep")
    return cutter.transform(keyed).withColumn(name, F.col(name).cast("int")).drop("_key")


def assign_blocks(df: DataFrame, keys: Sequence[str], rows: int | None = None,
                  groups: Sequence[str] = ()) -> Blocked:
    """Add the block column. ``keys`` must be non-null; later keys break ties.

    When the largest of ``groups`` fits one block, by a count, there is one block. A
    value of the first key that fills more than a block gets a block of its own,
    which the second key then cuts further.
    """
    rows = rows or rows_per_block(df.sparkSession)
    sizes = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_c"))
    n, largest = sizes.agg(F.coalesce(F.sum("_c"), F.lit(0)), F.coalesce(F.max("_c"), F.lit(0))).first()
    if largest <= rows:
        return Blocked(df.withColumn(BLOCK, F.lit(0)), True)
    cuts, heavy = _cuts(df, keys[0], n, rows)
    out = _bucket(df, keys[0], cuts, BLOCK)
    heavy_ids = tuple(cuts.index(v) + 1 for v in sorted(heavy))
    if heavy_ids and len(keys) > 1:
        ties = out.where(F.col(BLOCK).isin(*heavy_ids))
        m = ties.count()
        if m > rows:
            sub, _ = _cuts(ties, keys[1], m, rows)
            out = _bucket(out, keys[1], sub, "_sub")
            out = out.withColumn(BLOCK, F.col(BLOCK) * (len(sub) + 1) + F.when(
                F.col(BLOCK).isin(*heavy_ids), F.col("_sub")).otherwise(0)).drop("_sub")
            heavy_ids = ()
    return Blocked(out, False, heavy_ids)


def block_offsets(df: DataFrame, groups: Sequence[str], measure: Column, name: str) -> DataFrame:
    """Per (group, block): the sum of ``measure`` over the earlier blocks."""
    w = Window.partitionBy(*groups).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.groupBy(*groups, BLOCK).agg(measure.alias("_m"))
        .select(*groups, BLOCK, F.coalesce(F.sum("_m").over(w), F.lit(0)).alias(name))
    )


def dense_index(df: DataFrame, groups: Sequence[str], order: Sequence[str],
                name: str = "idx", reuse_blocks: bool = False) -> DataFrame:
    """0-based position of each row in its group; keeps the block column.

    ``reuse_blocks`` takes the block column already on ``df``.
    """
    blocked = Blocked(df, False) if reuse_blocks else assign_blocks(df, order, groups=groups)
    w = Window.partitionBy(*groups, BLOCK).orderBy(*order)
    out = blocked.df.withColumn("_rn", F.row_number().over(w).cast("long") - 1)
    if blocked.single:
        return out.withColumnRenamed("_rn", name)
    offsets = block_offsets(blocked.df, groups, F.count(F.lit(1)), "_off")
    return (
        attach(out, offsets, [*groups, BLOCK])
        .withColumn(name, F.col("_rn") + F.col("_off")).drop("_rn", "_off")
    )


def running_sum(df: DataFrame, groups: Sequence[str], order: Sequence[str], value: str,
                name: str) -> DataFrame:
    """Inclusive prefix sum along ``order``; uses the block column on ``df``."""
    w = Window.partitionBy(*groups, BLOCK).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    local = df.withColumn("_local", F.sum(value).over(w))
    offsets = block_offsets(df, groups, F.sum(value), "_off")
    return (
        attach(local, offsets, [*groups, BLOCK])
        .withColumn(name, F.col("_local") + F.col("_off")).drop("_local", "_off")
    )


def neighbour(df: DataFrame, groups: Sequence[str], order: str, columns: Sequence[str],
              prefix: str, forward: bool = False) -> DataFrame:
    """The previous (or next) row's ``columns``, NULL at the group edge.

    Inside a block this is lag/lead; the first row of a block takes the edge row
    of the nearest earlier block of its group.
    """
    payload = F.struct(*[F.col(c) for c in columns])
    pick = F.min_by if forward else F.max_by
    shift = F.lead if forward else F.lag
    edges = df.groupBy(*groups, BLOCK).agg(pick(payload, F.col(order)).alias("_edge"))
    edges = edges.select(*groups, BLOCK, shift("_edge").over(
        Window.partitionBy(*groups).orderBy(BLOCK)).alias("_carry"))
    local = df.withColumn("_near", shift(payload).over(
        Window.partitionBy(*groups, BLOCK).orderBy(order)))
    out = attach(local, edges, [*groups, BLOCK])
    near = F.coalesce("_near", "_carry")
    return out.withColumns({prefix + c: near[c] for c in columns}).drop("_near", "_carry")


def halo_blocks(df: DataFrame, groups: Sequence[str], index: str, before: int, after: int,
                size: int = 8192) -> DataFrame:
    """Chunks of ``size`` rows of a dense index, with the rows a frame reaches
    for copied from the neighbouring chunks. Window over (groups, _chunk) and
    keep ``_own`` rows."""
    first = F.floor((F.col(index) - after) / size)
    last = F.floor((F.col(index) + before) / size)
    out = df.withColumn("_chunk", F.explode(F.sequence(first, last)))
    return out.withColumn("_own", F.col("_chunk") == F.floor(F.col(index) / size))


def rolling(df: DataFrame, groups: Sequence[str], index: str, before: int, after: int,
            exprs: dict[str, Column]) -> DataFrame:
    """Row-frame aggregates ``[-before, +after]`` over a dense index, cut at the ends."""
    w = Window.partitionBy(*groups, "_chunk").orderBy(index).rowsBetween(-before, after)
    halo = halo_blocks(df, groups, index, before, after)
    out = halo.withColumns({k: e.over(w) for k, e in exprs.items()})
    return out.where("_own").drop("_chunk", "_own")


def true_runs(df: DataFrame, groups: Sequence[str], index: str, flag: Column) -> DataFrame:
    """Runs of consecutive true rows as half-open [start, stop) of a dense index."""
    true_rows = dense_index(df.where(flag), groups, [index], "_k", reuse_blocks=True)
    return (
        true_rows.withColumn("_island", F.col(index) - F.col("_k"))
        .groupBy(*groups, "_island")
        .agg(F.min(index).alias("start"), (F.max(index) + 1).alias("stop"),
             F.count(F.lit(1)).alias("run_length"))
        .drop("_island")
    )


def longest_true_run(df: DataFrame, groups: Sequence[str], index: str, flag: Column) -> DataFrame:
    """The longest run per group; the first one wins ties."""
    best = F.max(F.struct("run_length", (-F.col("start")).alias("s"), "stop"))
    return (
        true_runs(df, groups, index, flag).groupBy(*groups).agg(best.alias("b"))
        .select(*groups, (-F.col("b.s")).alias("start"), F.col("b.stop").alias("stop"),
                F.col("b.run_length").alias("run_length"))
    )


def exact_quantiles(df: DataFrame, groups: Sequence[str], value: str, probs: Sequence[float],
                    rows: int | None = None, discrete: bool = False) -> DataFrame:
    """Linear-interpolation quantiles, long form (groups, prob, quantile); ``discrete`` takes the
    least value that has the share ``prob`` of its group at or below it.

    Small groups (by a checked count) use the built-in ``percentile``. For larger
    ones only the blocks that hold the wanted order statistics are ranked.
    """
    data = df.select(*groups, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    blocked = assign_blocks(data, ["_v"], rows, groups)
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    if blocked.single:
        found = F.percentile("_v", wanted)
        if discrete:
            found = F.array(*[F.expr(f"percentile_disc({float(p)!r}D) WITHIN GROUP (ORDER BY _v)") for p in probs])
        picks = data.groupBy(*groups).agg(found.alias("_q"))
        pairs = F.arrays_zip(wanted.alias("prob"), F.col("_q").alias("quantile"))
        return picks.select(*groups, F.explode(pairs).alias("_p")).select(
            *groups, F.col("_p.prob").alias("prob"), F.col("_p.quantile"))
    by_group = Window.partitionBy(*groups)
    before = by_group.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    table = blocked.df.groupBy(*groups, BLOCK).agg(
        F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_min"))
    table = table.withColumns({
        "_off": F.coalesce(F.sum("_c").over(before), F.lit(0)), "_n": F.sum("_c").over(by_group)})
    at = F.col("prob") * (F.col("_n") - 1)
    if discrete:
        at = F.greatest(F.ceil(F.col("prob") * F.col("_n")) - 1, F.lit(0)).cast("double")
    spots = table.withColumn("prob", F.explode(wanted)).withColumn("_pos", at)
    spots = spots.withColumn("_k", F.explode(F.array_distinct(F.array(
        F.floor("_pos"), F.ceil("_pos")))))
    spots = spots.where((F.col("_k") >= F.col("_off")) & (F.col("_k") < F.col("_off") + F.col("_c")))
    is_heavy = F.col(BLOCK).isin(*blocked.heavy) if blocked.heavy else F.lit(False)
    known = spots.where(is_heavy).select(*groups, "prob", "_pos", "_k", F.col("_min").alias("_v"))
    open_spots = spots.where(~is_heavy)
    needed = open_spots.select(*groups, BLOCK, "_off").distinct()
    ranked = attach(blocked.df.where(~is_heavy), needed, [*groups, BLOCK], "inner").withColumn(
        "_k", F.col("_off") + F.row_number().over(
            Window.partitionBy(*groups, BLOCK).orderBy("_v")) - 1)
    found = attach(ranked, open_spots.select(*groups, BLOCK, "_k", "prob", "_pos"),
                   [*groups, BLOCK, "_k"], "inner").select(*groups, "prob", "_pos", "_k", "_v")
    lo, hi = F.min(F.struct("_k", "_v"))["_v"], F.max(F.struct("_k", "_v"))["_v"]
    part = F.first("_pos") - F.floor(F.first("_pos"))
    return found.unionByName(known).groupBy(*groups, "prob").agg(
        (lo + part * (hi - lo)).alias("quantile"))


def quantile_columns(df: DataFrame, groups: Sequence[str], value: str,
                     named: dict[str, float]) -> DataFrame:
    """``exact_quantiles`` with one column per named probability."""
    long = exact_quantiles(df, groups, value, list(named.values()))
    picks = [F.max(F.when(F.col("prob") == F.lit(float(p)), F.col("quantile"))).alias(n)
             for n, p in named.items()]
    return long.groupBy(*groups).agg(*picks)


def average_rank(df: DataFrame, groups: Sequence[str], value: str, name: str) -> DataFrame:
    """1-based rank with ties sharing their mean rank."""
    blocked = assign_blocks(df, [value], groups=groups)
    inside = Window.partitionBy(*groups, BLOCK)
    line = inside.orderBy(value)
    upto = F.count(F.lit(1)).over(line.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    local = (F.rank().over(line) + upto) / 2
    if blocked.single:
        return blocked.df.withColumn(name, local).drop(BLOCK)
    offsets = block_offsets(blocked.df, groups, F.count(F.lit(1)), "_off")
    is_heavy = F.col(BLOCK).isin(*blocked.heavy) if blocked.heavy else F.lit(False)
    light = attach(blocked.df.where(~is_heavy).withColumn("_local", local), offsets,
                   [*groups, BLOCK]).withColumn(name, F.col("_off") + F.col("_local"))
    light = light.drop("_off", "_local", BLOCK)
    if not blocked.heavy:
        return light
    counts = blocked.df.where(is_heavy).groupBy(*groups, BLOCK).agg(F.count(F.lit(1)).alias("_c"))
    spans = counts.join(offsets, [*groups, BLOCK])
    tied = attach(blocked.df.where(is_heavy), spans, [*groups, BLOCK]).withColumn(
        name, F.col("_off") + (F.col("_c") + 1) / 2).drop("_off", "_c", BLOCK)
    return light.unionByName(tied)


def largest_gap(df: DataFrame, groups: Sequence[str], x: str) -> DataFrame:
    """Largest distance between consecutive sorted values; NULL for one row."""
    values = df.where(F.col(x).isNotNull()).groupBy(*groups, x).agg(F.count(F.lit(1)).alias("_c"))
    blocked = assign_blocks(values, [x], groups=groups)
    inside = Window.partitionBy(*groups, BLOCK).orderBy(x)
    local = blocked.df.withColumn("_gap", F.col(x) - F.lag(x).over(inside))
    per_block = local.groupBy(*groups, BLOCK).agg(
        F.max("_gap").alias("_gap"), F.min(x).alias("_lo"), F.max(x).alias("_hi"),
        F.max("_c").alias("_c"))
    across = F.col("_lo") - F.lag("_hi").over(Window.partitionBy(*groups).orderBy(BLOCK))
    repeated = F.when(F.max("_c") > 1, F.lit(0.0))
    return per_block.withColumn("_edge", across).groupBy(*groups).agg(
        F.coalesce(F.greatest(F.max("_gap"), F.max("_edge")), repeated).alias("largest_gap"))
