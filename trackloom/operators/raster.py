"""Image cells in long form: frame statistics, hotspots, stencils and tile geometry.

A frame's cells fit one task (a camera frame has a fixed size), so windows over a
frame key are bounded; a track's cells are not and use the block quantiles.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.scalars import d
from trackloom.operators.ordered import quantile_columns
from trackloom.session import attach, settle

PERCENTILES = {"p05": .05, "p10": .10, "p25": .25, "p50": .50, "p75": .75, "p90": .90, "p95": .95,
               "p97": .97, "p99": .99}


def frame_context(cells: DataFrame, key: Sequence[str], percentiles: Sequence[str]) -> DataFrame:
    """Cells with their frame's percentiles and forward differences ``gx`` and ``gy``.

    Everything is windowed on the frame key, so a later groupBy on it needs no
    further shuffle.
    """
    w = Window.partitionBy(*key)
    across, down = w.orderBy("r", "c"), w.orderBy("c", "r")
    probs = F.array(*[F.lit(PERCENTILES[p]) for p in percentiles])
    out = cells.withColumns({
        "_p": F.percentile("v", probs).over(w),
        "gx": F.when(F.lag("r").over(across) == F.col("r"), F.col("v") - F.lag("v").over(across)),
        "gy": F.when(F.lag("c").over(down) == F.col("c"), F.col("v") - F.lag("v").over(down)),
    })
    return out.withColumns({p: F.col("_p")[i] for i, p in enumerate(percentiles)}).drop("_p")


def block_mean(cells: DataFrame, key: Sequence[str], height: int, width: int, grid: int) -> DataFrame:
    """Mean of each block of a grid x grid partition of the frame."""
    if height % grid or width % grid:
        raise ValueError(f"a {height}x{width} frame does not divide into a {grid}x{grid} grid")
    br = F.floor(F.col("r") / (height // grid)).cast("int")
    bc = F.floor(F.col("c") / (width // grid)).cast("int")
    return cells.groupBy(*key, br.alias("br"), bc.alias("bc")).agg(F.avg("v").alias("v"))


def robust_scaled(cells: DataFrame, key: Sequence[str]) -> DataFrame:
    """Per-frame (v - p50) / (p95 - p5 + 1e-6), and v - p10."""
    rows = frame_context(cells, key, ["p05", "p10", "p50", "p95"])
    scale = F.col("p95") - F.col("p05") + d(1e-6)
    return rows.select(*cells.columns, ((F.col("v") - F.col("p50")) / scale).alias("scaled"),
                       (F.col("v") - F.col("p10")).alias("above_background"))


def centred_crop(cells: DataFrame, centres: DataFrame, key: Sequence[str], height: int, width: int,
                 size: int) -> DataFrame:
    """size x size window around (cx, cy), zero outside the frame, with an edge flag."""
    x0 = F.bround("cx").cast("int") - size // 2
    y0 = F.bround("cy").cast("int") - size // 2
    at = centres.select(*key, x0.alias("x0"), y0.alias("y0")).withColumn(
        "edge", (F.col("x0") < 0) | (F.col("y0") < 0) | (F.col("x0") + size > width) | (F.col("y0") + size > height))
    grid = F.sequence(F.lit(0), F.lit(size * size - 1))
    roi = at.withColumn("_i", F.explode(grid)).select(
        *key, "edge", F.floor(F.col("_i") / size).cast("int").alias("rr"), (F.col("_i") % size).alias("rc"),
        (F.col("y0") + F.floor(F.col("_i") / size)).cast("int").alias("r"), (F.col("x0") + F.col("_i") % size).alias("c"))
    joined = roi.join(cells.select(*key, "r", "c", "v"), [*key, "r", "c"], "left")
    return joined.select(*key, "edge", "rr", "rc", F.coalesce("v", d(0)).alias("v"))


def isotherm_extents(cells: DataFrame, key: Sequence[str], levels: Sequence[float], pixel_mm: float) -> DataFrame:
    """Width of the columns holding a cell above each level; 0 for fewer than two columns."""
    columns = cells.groupBy(*key, "c").agg(F.max("v").alias("peak"))
    out = []
    for i, level in enumerate(levels):
        c = F.when(F.col("peak") > d(level), F.col("c"))
        out.append(F.when(F.count(c) > 1, (F.max(c) - F.min(c)) * d(pixel_mm)).otherwise(d(0)).alias(f"extent_{i}"))
    return columns.groupBy(*key).agg(*out)


def gaussian_taps(sigma: float, radius: int) -> list[float]:
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [v / sum(w) for v in w]


def padded(values: Column, radius: int) -> Column:
    """An array with ``radius`` mirrored entries on both sides, the edge entry not
    repeated. Put it in a column before a generator, so it is built once per row."""
    n = F.size(values)
    period = F.greatest(2 * (n - 1), F.lit(1))

    def at(i: Column) -> Column:
        j = F.pmod(i, period)
        return F.get(values, F.when(j < n, j).otherwise(period - j))

    return F.transform(F.sequence(F.lit(-radius), n - 1 + radius), at)


def weighted(pad: Column, taps: Sequence[float], i: Column) -> Column:
    """Kernel sum centred on entry i of the array that ``pad`` was made from."""
    weights = F.array(*[d(w) for w in taps])
    return F.aggregate(F.zip_with(F.slice(pad, i + 1, len(taps)), weights, lambda v, w: v * w),
                       d(0), lambda acc, v: acc + v)


def _blur_lines(cells: DataFrame, key: Sequence[str], line: str, along: str, value: str,
                taps: Sequence[float], name: str) -> DataFrame:
    """Convolve along one axis; each line of a frame becomes one array."""
    lines = cells.groupBy(*key, line).agg(
        F.array_sort(F.collect_list(F.struct(along, value))).alias("_line"))
    lines = lines.withColumn("_pad", padded(F.col(f"_line.{value}"), len(taps) // 2))
    at = F.transform("_line", lambda s, i: F.struct(
        s[along].alias(along), weighted(F.col("_pad"), taps, i).alias(name)))
    return lines.select(*key, line, F.explode(at).alias("_s")).select(
        *key, line, F.col("_s")[along].alias(along), F.col("_s")[name].alias(name))


def gaussian_blur(cells: DataFrame, key: Sequence[str], sigma: float, radius: int) -> DataFrame:
    """Separable Gaussian blur with mirrored edges: key, r, c, blurred."""
    taps = gaussian_taps(sigma, radius)
    rows = _blur_lines(cells, key, "r", "c", "v", taps, "_h")
    return _blur_lines(rows, key, "c", "r", "_h", taps, "blurred")


STRIP_NAMES = ("mean", "std", "median", "p05", "p25", "p75", "p95", "p95_p05", "gradient_energy",
               "edge_fraction", "laplacian_variance", "detail", "entropy", "mean_square")


def strip_vector(stats: DataFrame, key: Sequence[str], side: str, border: Column, boundary: Column) -> DataFrame:
    """33 values per sample: upstream, downstream (zeros if absent), two differences, flags."""
    values = F.array(*STRIP_NAMES)
    wide = stats.groupBy(*key).agg(
        F.max(F.when(F.col(side) == "up", values)).alias("_u"),
        F.max(F.when(F.col(side) == "down", values)).alias("_d"))
    zeros = F.array(*[d(0)] * len(STRIP_NAMES))
    down = F.coalesce("_d", zeros)
    gap = [F.when(F.col("_d").isNotNull(), F.col("_u")[i] - F.col("_d")[i]).otherwise(d(0)) for i in (0, 8)]
    return wide.select(*key, F.concat("_u", down, F.array(
        *gap, d(1), border.cast("double"), boundary.cast("double"))).alias("vector"))


def area_resize(cells: DataFrame, key: Sequence[str], height: int, width: int, out: int) -> DataFrame:
    """Area-weighted downsample to out x out cells."""

    def touched(axis: str, size: int) -> tuple[Column, float]:
        step = size / out
        first = F.floor(F.col(axis) / d(step))
        last = F.least(F.ceil((F.col(axis) + 1) / d(step)) - 1, F.lit(out - 1).cast("long"))
        return F.sequence(first, last), step

    rows, sr = touched("r", height)
    cols, sc = touched("c", width)
    long = cells.withColumn("orow", F.explode(rows)).withColumn("ocol", F.explode(cols))

    def overlap(axis: str, o: str, step: float) -> Column:
        return F.greatest(d(0), F.least(F.col(axis) + d(1), (F.col(o) + 1) * d(step))
                          - F.greatest(F.col(axis).cast("double"), F.col(o) * d(step)))

    w = overlap("r", "orow", sr) * overlap("c", "ocol", sc)
    return long.groupBy(*key, "orow", "ocol").agg((F.sum(w * F.col("v")) / F.sum(w)).alias("v"))


def source_inventory(cells: DataFrame, track: str, frame: str) -> DataFrame:
    """Value range, moments, percentiles, bad-value counts and degenerate fractions per track."""
    v = F.col("v")
    bad = F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    per_frame = cells.groupBy(track, frame).agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(F.isnan(v)).alias("nan"),
        F.count_if(F.abs(v) == F.lit(float("inf"))).alias("inf"),
        F.count_if(v == 0).alias("zero"), F.min(F.when(~bad, v)).alias("lo"), F.max(F.when(~bad, v)).alias("hi"))
    moments = cells.where(~bad).groupBy(track).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    base = per_frame.groupBy(track).agg(
        F.count(F.lit(1)).alias("frames"), F.sum("cells").alias("cells"), F.min("lo").alias("minimum"),
        F.max("hi").alias("maximum"), F.sum("nan").alias("nan_count"), F.sum("inf").alias("infinite_count"),
        (F.sum("zero") / F.sum("cells")).alias("zero_fraction"),
        F.avg((F.col("lo") == F.col("hi")).cast("double")).alias("constant_frame_fraction"))
    tails = quantile_columns(cells.where(~bad), [track], "v", {"p01": .01, "p50": .50, "p99": .99})
    edges = attach(cells, base.select(track, "minimum", "maximum"), [track]).groupBy(track).agg(
        F.avg((v == F.col("minimum")).cast("double")).alias("minimum_fraction"),
        F.avg((v == F.col("maximum")).cast("double")).alias("maximum_fraction"))
    return base.join(moments, track).join(tails, track).join(edges, track)


def pixelwise(cells: DataFrame, track: str) -> DataFrame:
    """Mean, median and std image over the frames of a track."""
    key = [track, "r", "c"]
    med = quantile_columns(cells, key, "v", {"median": 0.5})
    return cells.groupBy(*key).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std")).join(med, key)


def distribution_shift(features: DataFrame, track: str, names: Sequence[str]) -> DataFrame:
    """Per feature: between-track range of means against the mean within-track spread."""
    long = features.unpivot([track], list(names), "feature", "_v")
    pooled = long.groupBy("feature").agg(F.stddev_pop("_v").alias("pooled_std"))
    per = long.groupBy("feature", track).agg(F.avg("_v").alias("_m"), F.stddev_pop("_v").alias("_s"))
    gap = F.max("_m") - F.min("_m")
    out = per.groupBy("feature").agg(
        F.count(F.lit(1)).alias("tracks"), gap.alias("between_range"), F.avg("_s").alias("within_std"),
        (gap / F.greatest(F.avg("_s"), d(1e-12))).alias("ratio"))
    return out.join(pooled, "feature")


def tile_geometry(tiles: DataFrame, track: str, start: float = 20.0, end: float = 100.0) -> DataFrame:
    """Stage positions mapped linearly so the extreme tiles touch the window ends.

    Tiles carry width_px, px_mm and stage_x; adds field width, centre, xmin, xmax.
    """
    field = tiles.withColumn("_f", F.col("width_px") * F.col("px_mm"))
    stats = field.groupBy(track).agg(F.min("stage_x").alias("_lo"), F.max("stage_x").alias("_hi"))
    stats = stats.join(quantile_columns(field, [track], "_f", {"field_mm": 0.5}), track)
    half = F.col("field_mm") / 2
    slope = F.try_divide((d(end) - half) - (d(start) + half), F.col("_hi") - F.col("_lo"))
    stats = stats.withColumn("slope", slope).withColumn(
        "intercept", d(start) + half - F.col("slope") * F.col("_lo")).drop("_lo", "_hi")
    out = attach(tiles, stats, [track])
    centre = F.col("slope") * F.col("stage_x") + F.col("intercept")
    return out.withColumns({"centre": centre, "xmin": centre - half, "xmax": centre + half})


def plane_moments(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Least-squares plane z = a x + b y + c per group from centred sums (closed form)."""
    sxx, syy, sxy = F.var_pop("x"), F.var_pop("y"), F.covar_pop("x", "y")
    sxz, syz = F.covar_pop("x", "z"), F.covar_pop("y", "z")
    det = sxx * syy - sxy * sxy
    fit = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("kept"), F.avg("x").alias("_x"), F.avg("y").alias("_y"), F.avg("z").alias("_z"),
        F.try_divide(sxz * syy - syz * sxy, det).alias("a"), F.try_divide(syz * sxx - sxz * sxy, det).alias("b"))
    return fit.withColumn("c", F.col("_z") - F.col("a") * F.col("_x") - F.col("b") * F.col("_y")).drop("_x", "_y", "_z")


def robust_plane(df: DataFrame, groups: Sequence[str], rounds: int = 3, minimum: int = 100) -> DataFrame:
    """Plane refitted on the points whose residual lies in [p5, p95], three rounds.

    Groups under ``minimum`` valid points have no plane; a refit that would keep
    fewer stops there with the coefficients of that round.
    """
    valid = df.where(F.col("z").isNotNull())
    counts = valid.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= minimum)
    valid = attach(valid, counts.select(*groups), groups, "inner")
    bounds, plane = None, None
    for step in range(rounds):
        kept = valid
        if bounds is not None:
            res = F.col("z") - F.col("pa") * F.col("x") - F.col("pb") * F.col("y") - F.col("pc")
            kept = attach(valid, bounds, groups).where(res.between(F.col("lo"), F.col("hi")))
        new = plane_moments(kept, groups)
        if plane is not None:
            old = plane.select(*groups, *[F.col(c).alias("_" + c) for c in ("kept", "a", "b", "c", "_stop")])
            stop = F.col("__stop") | (F.col("kept") < minimum)
            new = new.join(old, list(groups)).select(
                *groups, *[F.when(stop, F.col("_" + c)).otherwise(F.col(c)).alias(c) for c in ("kept", "a", "b", "c")],
                stop.alias("_stop"))
        else:
            new = new.withColumn("_stop", F.lit(False))
        plane = settle(new)
        if step + 1 < rounds:
            fit = attach(valid, plane, groups)
            res = fit.withColumn("_res", F.col("z") - F.col("a") * F.col("x") - F.col("b") * F.col("y") - F.col("c"))
            tails = quantile_columns(res, groups, "_res", {"lo": .05, "hi": .95})
            bounds = tails.join(plane.select(*groups, F.col("a").alias("pa"), F.col("b").alias("pb"),
                                             F.col("c").alias("pc")), list(groups))
    return plane.drop("_stop")


def detrend(df: DataFrame, plane: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Subtract the plane; groups without one stay unchanged."""
    out = attach(df, plane.select(*groups, "a", "b", "c"), groups)
    level = F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("c")
    return out.withColumn("z_levelled", F.col("z") - F.coalesce(level, d(0))).drop("a", "b", "c")


def sheared_y(x: Column, y: Column, slope: Column, reference: Column, strength: float = 1.0) -> Column:
    return y - d(strength) * slope * (x - reference)
