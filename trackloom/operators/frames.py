"""Frames and tiles as arrays: statistics, hot regions, texture, scores and strip cuts.

A frame is one row with its cells in one array, row by row; null or NaN cells are missing. Every
statistic is computed over the frames of an Arrow batch at once, where the frame lies: no cell
becomes a row and nothing is shuffled. What compares frames joins whole frames by their index.

A tile is stored in blocks of rows, so a strip reads the blocks it touches, by an equi-join on
(tile, block), and what blocks contribute to a strip adds up.
"""

from __future__ import annotations

import math
import sys
import warnings
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.scalars import d

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Cells handled at once inside a task.
CELLS = 2_000_000
Kernel = Callable[[np.ndarray], dict[str, np.ndarray]]

SUMMARY = ("mean", "std", "low", "high", "p10", "p50", "p90", "p99", "contrast", "hot_fraction", "centroid_x", "centroid_y",
           "left_right", "up_down", "grad_x", "grad_y", "mean_excess")
SHAPE = ("fraction_p90", "fraction_p95", "fraction_p97", "fraction_p99", "equivalent_diameter", "major_axis", "minor_axis",
         "axis_ratio", "centroid_x", "centroid_y", "eigen_1", "eigen_2", "contrast", "mean_excess", "grad_x", "grad_y",
         "left_right", "up_down", "failure")
TEXTURE = ("mean", "std", "p05", "p25", "median", "p75", "p95", "p95_p05", "gradient_energy", "edge_fraction",
           "laplacian_variance", "detail", "entropy", "mean_square")


def stacked(column: pa.Array, height: int, width: int) -> np.ndarray:
    """(frames, height, width) of a list column."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if column.null_count or len(flat) != len(column) * height * width or (np.diff(column.offsets.to_numpy()) != height * width).any():
        raise ValueError(f"every frame must have {height} x {width} cells")
    return flat.reshape(-1, height, width)


def per_frame(df: DataFrame, key: Sequence[str], vector: str, height: int, width: int, names: Sequence[str], kernel: Kernel) -> DataFrame:
    """``key`` and the kernel's numbers for each frame, in one pass without a shuffle; numbers of
    frames without a cell they need are null."""
    step = max(1, CELLS // (height * width))
    doubles = F.transform(vector, lambda v: v.cast("double")).alias("_frame")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, step):
                part = batch.slice(low, step)
                with warnings.catch_warnings(), np.errstate(invalid="ignore", divide="ignore"):
                    warnings.simplefilter("ignore", RuntimeWarning)  # frames without a known cell
                    got = kernel(stacked(part.column("_frame"), height, width))
                values = [pa.array(got[n], pa.float64(), mask=np.isnan(got[n])) for n in names]
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in key], *values], names=[*key, *names])

    rows = df.select(*key, doubles)
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(scan, ", ".join([keys, *[f"{n} double" for n in names]]))


def order_statistics(x: np.ndarray, probs: Sequence[float]) -> np.ndarray:
    """(probabilities, frames) linearly interpolated quantiles of the known cells."""
    flat = x.reshape(len(x), -1)
    if len(flat) and np.isnan(flat).any():
        return np.nanquantile(flat, probs, axis=1)
    return np.quantile(flat, probs, axis=1) if len(flat) else np.zeros((len(probs), 0))


def _mean(x: np.ndarray) -> np.ndarray:
    return np.nanmean(x.reshape(len(x), -1), axis=1)


def _share(x: np.ndarray, level: np.ndarray) -> np.ndarray:
    return (x >= level[:, None, None]).sum((1, 2)) / (~np.isnan(x)).sum((1, 2))


def _common(x: np.ndarray, p10: np.ndarray) -> dict[str, np.ndarray]:
    """What the summary and the shape features share."""
    _, height, width = x.shape
    excess = np.maximum(x - p10[:, None, None], 0)
    return {"excess": excess, "contrast": np.nanmax(x, axis=(1, 2)) - p10, "mean_excess": _mean(excess),
            "left_right": _mean(x[:, :, :width // 2]) - _mean(x[:, :, width // 2:]),
            "up_down": _mean(x[:, :height // 2]) - _mean(x[:, height // 2:]),
            "grad_x": _mean(np.abs(np.diff(x, axis=2))), "grad_y": _mean(np.abs(np.diff(x, axis=1)))}


def summary(x: np.ndarray) -> dict[str, np.ndarray]:
    """Seventeen statistics."""
    _, height, width = x.shape
    p10, p50, p90, p95, p99 = order_statistics(x, (.10, .50, .90, .95, .99))
    out = _common(x, p10)
    excess = out.pop("excess")
    total = np.maximum(np.nansum(excess, axis=(1, 2)), 1)
    return out | {
        "mean": _mean(x), "std": np.nanstd(x, axis=(1, 2)), "low": np.nanmin(x, axis=(1, 2)), "high": np.nanmax(x, axis=(1, 2)),
        "p10": p10, "p50": p50, "p90": p90, "p99": p99, "hot_fraction": _share(x, p95),
        "centroid_x": np.nansum(excess * np.arange(width), axis=(1, 2)) / total / (width - 1),
        "centroid_y": np.nansum(excess * np.arange(height)[:, None], axis=(1, 2)) / total / (height - 1)}


def hot_centre(x: np.ndarray) -> dict[str, np.ndarray]:
    """Weighted centre of the cells at or above the frame's p95."""
    p95 = order_statistics(x, (.95,))[0][:, None, None]
    hot = x >= p95
    w = np.where(hot, np.maximum(x - p95, 0) + 1e-12, 0)
    total = w.sum((1, 2))
    return {"cx": (w * np.arange(x.shape[2])).sum((1, 2)) / total, "cy": (w * np.arange(x.shape[1])[:, None]).sum((1, 2)) / total,
            "hot_cells": hot.sum((1, 2)).astype(float)}


def shape(x: np.ndarray) -> dict[str, np.ndarray]:
    """Nineteen features of the hot region, from its second moments; zeros and ``failure`` 1 where
    nothing stands out."""
    _, height, width = x.shape
    p10, *levels = order_statistics(x, (.10, .90, .95, .97, .99))
    out = _common(x, p10)
    hot = x >= levels[1][:, None, None]
    w = np.where(hot, out.pop("excess"), 0)
    total, at_x, at_y = w.sum((1, 2)), np.arange(width), np.arange(height)[:, None]
    mx, my = (w * at_x).sum((1, 2)) / total, (w * at_y).sum((1, 2)) / total
    dx, dy = at_x - mx[:, None, None], at_y - my[:, None, None]
    xx, yy, xy = ((w * a * b).sum((1, 2)) / total for a, b in ((dx, dx), (dy, dy), (dx, dy)))
    mid, half = (xx + yy) / 2, np.sqrt(((xx - yy) / 2) ** 2 + xy * xy)
    major, minor = 2 * np.sqrt(np.maximum(mid + half, 0)), 2 * np.sqrt(np.maximum(mid - half, 0))
    out |= {f"fraction_p{p}": _share(x, v) for p, v in zip((90, 95, 97, 99), levels, strict=True)}
    out |= {"equivalent_diameter": 2 * np.sqrt(hot.sum((1, 2)) / math.pi) / width, "major_axis": major / width, "minor_axis": minor / width,
            "axis_ratio": major / np.maximum(minor, 1e-9), "centroid_x": mx / (width - 1), "centroid_y": my / (height - 1),
            "eigen_1": (mid + half) / (height * width), "eigen_2": (mid - half) / (height * width)}
    failed = ~(total > 0)
    return {k: np.where(failed, 0.0, v) for k, v in out.items()} | {"failure": failed.astype(float)}


def mirrored(size: int, shift: int) -> np.ndarray:
    """Where each of ``size`` places finds its neighbour at ``shift``; edges mirror without repeating."""
    period = max(2 * (size - 1), 1)
    at = (np.arange(size) + shift) % period
    return np.where(at < size, at, period - at)


def blur_matrix(size: int, sigma: float, radius: int) -> np.ndarray:
    """The Gaussian blur of a line with mirrored edges as a matrix."""
    taps = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    out = np.zeros((size, size))
    for shift, weight in zip(range(-radius, radius + 1), taps / taps.sum(), strict=True):
        out[np.arange(size), mirrored(size, shift)] += weight
    return out


def texture(x: np.ndarray) -> dict[str, np.ndarray]:
    """Fourteen texture statistics of strips whose values are grey levels in [0, 1]; the blur has
    sigma 3 and 25 taps."""
    n, height, width = x.shape
    left, right = x[:, :, mirrored(width, -1)], x[:, :, mirrored(width, 1)]
    up, down = x[:, mirrored(height, -1)], x[:, mirrored(height, 1)]
    gradient = np.diff(x, axis=2) if width > 1 else np.diff(x, axis=1)
    blurred = blur_matrix(height, 3.0, 12) @ x @ blur_matrix(width, 3.0, 12).T
    p05, p25, p50, p75, p95 = order_statistics(x, (.05, .25, .5, .75, .95))
    inside = (x >= 0) & (x <= 1)
    level = np.minimum(np.floor(np.where(inside, x, 0) * 32), 31).astype(np.int64) + 32 * np.arange(n)[:, None, None]
    counts = np.bincount(level[inside], minlength=32 * n).reshape(n, 32).astype(float)
    total = counts.sum(1)
    bits = np.where(counts > 0, counts * np.log2(np.where(counts > 0, counts, 1)), 0).sum(1)
    return {"mean": _mean(x), "std": np.nanstd(x, axis=(1, 2)), "p05": p05, "p25": p25, "median": p50, "p75": p75, "p95": p95,
            "p95_p05": p95 - p05, "gradient_energy": _mean(gradient ** 2),
            "edge_fraction": (np.abs(gradient) > 0.08).sum((1, 2)) / np.maximum((~np.isnan(gradient)).sum((1, 2)), 1),
            "laplacian_variance": np.nanvar(left + right + up + down - 4 * x, axis=(1, 2)), "detail": _mean(np.abs(x - blurred)),
            "entropy": np.where(total > 0, np.log2(np.where(total > 0, total, 1)) - bits / np.maximum(total, 1), 0.0),
            "mean_square": _mean(x ** 2)}


def frame_scores(df: DataFrame, key: Sequence[str], vector: str, height: int, width: int, prob: float = 0.995) -> DataFrame:
    """``score``: a high quantile of each frame's cells, the activity of the frame."""
    return per_frame(df, key, vector, height, width, ["score"], lambda x: {"score": order_statistics(x, (prob,))[0]})


def consecutive(df: DataFrame, track: str, index: str, vector: str, height: int, width: int) -> DataFrame:
    """Mean absolute change, correlation and repeat flags against the frame before, joined by index."""
    before = df.select(track, (F.col(index) + 1).alias(index), F.col(vector).alias("_before"))
    pairs = df.join(before, [track, index]).select(track, index, F.concat("_before", vector).alias("_both"))

    def compare(x: np.ndarray) -> dict[str, np.ndarray]:
        a, b = x[:, :height].reshape(len(x), -1), x[:, height:].reshape(len(x), -1)
        lost = np.isnan(a) | np.isnan(b)
        a, b = np.where(lost, np.nan, a), np.where(lost, np.nan, b)
        da, db = a - np.nanmean(a, 1)[:, None], b - np.nanmean(b, 1)[:, None]
        norm = np.sqrt(np.nansum(da * da, 1) * np.nansum(db * db, 1))
        return {"mean_abs_difference": np.nanmean(np.abs(b - a), 1), "correlation": np.nansum(da * db, 1) / np.maximum(norm, 1e-12)}

    out = per_frame(pairs, [track, index], "_both", 2 * height, width, ["mean_abs_difference", "correlation"], compare)
    return out.withColumns({"duplicate": F.col("mean_abs_difference") == 0, "near_duplicate": F.col("mean_abs_difference") < d(1e-6)})


# Tiles in row blocks, and the two strips beside a masked centre.


def tile_blocks(rows: DataFrame, tile: Sequence[str], row: str, pixels: str, size: int) -> DataFrame:
    """Tile rows gathered into blocks of ``size`` rows: (tile, block, lines), each line with its row."""
    block = F.floor(F.col(row) / size).cast("int").alias("block")
    lines = F.array_sort(F.collect_list(F.struct(F.col(row).cast("int").alias("row"), F.transform(pixels, lambda v: v.cast("double")).alias("pixels"))))
    return rows.groupBy(*tile, block).agg(lines.alias("lines"))


def strip_ranges(centre: Column, half: Column, context: Column, pixel: Column, length: Column) -> dict[str, Column]:
    """Masked and kept ranges [lo, hi) of pixels along an axis whose first pixel begins at 0. The
    mask is rounded outwards, the strips beside it inwards; all stay on the tile."""
    low = lambda c: F.least(F.greatest(c, F.lit(0)), length).cast("int")
    out_lo, out_hi = lambda e: low(F.floor(e / pixel)), lambda e: low(F.ceil(e / pixel))
    return {"mask_lo": out_lo(centre - half), "mask_hi": out_hi(centre + half),
            "up_lo": out_hi(centre - half - context), "up_hi": out_lo(centre - half),
            "down_lo": out_hi(centre + half), "down_hi": out_lo(centre + half + context)}


def strips_of(positions: DataFrame, key: Sequence[str], upstream_only: bool = False) -> DataFrame:
    """One row per position and kept strip (side, lo, hi) that holds a pixel; ``overlap`` says
    whether the strip reaches into the mask."""
    sides = [("up", "up_lo", "up_hi")] + ([] if upstream_only else [("down", "down_lo", "down_hi")])
    items = F.array(*[F.struct(F.lit(s).alias("side"), F.col(a).alias("lo"), F.col(b).alias("hi")) for s, a, b in sides])
    rows = positions.select(*key, "mask_lo", "mask_hi", F.explode(items).alias("_s")).select(*key, "mask_lo", "mask_hi", "_s.*")
    overlap = (F.col("lo") < F.col("mask_hi")) & (F.col("hi") > F.col("mask_lo"))
    return rows.where("hi > lo").withColumn("overlap", overlap).drop("mask_lo", "mask_hi")


def area_weights(low: int, high: int, out: int, first: int, number: int) -> np.ndarray:
    """(out, number): the share of each of ``number`` pixels from ``first`` in the ``out`` equal
    parts of [low, high)."""
    edges = low + (high - low) * np.arange(out + 1) / out
    at = first + np.arange(number)
    return np.maximum(np.minimum(edges[1:, None], at + 1) - np.maximum(edges[:-1, None], at), 0) * out / (high - low)


def cut_strips(strips: DataFrame, key: Sequence[str], blocks: DataFrame, tile: Sequence[str], size: int, width: int, out: int = 0) -> DataFrame:
    """Strips of tile rows [lo, hi) over the whole width: cells, their sum and sum of squares, and
    with ``out`` the area averages on an out x out grid as ``grid``, row by row.

    A strip is joined to the blocks it touches; each block adds its rows' part. ``key`` names a
    position and contains ``tile``; missing pixels make the sums they are in null.
    """
    touched = F.sequence(F.floor(F.col("lo") / size).cast("int"), F.floor((F.col("hi") - 1) / size).cast("int"))
    parts = strips.withColumn("block", F.explode(touched)).join(blocks, [*tile, "block"])
    parts = parts.select(*key, "side", "overlap", "lo", "hi", F.col("lines.row").alias("_rows"), F.flatten("lines.pixels").alias("_pixels"))
    names = [*key, "side", "overlap"]
    shown = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields if f.name in names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high = (batch.column(c).to_pylist() for c in ("lo", "hi"))
            rows, pixels = batch.column("_rows"), batch.column("_pixels")
            numbers, grids = [], []
            for i in range(batch.num_rows):
                at = rows[i].values.to_numpy()
                x = pixels[i].values.to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
                inside = (at >= low[i]) & (at < high[i])
                at, x = at[inside], x[inside]
                numbers.append((x.size, x.sum(), (x * x).sum()))
                if out:
                    down = np.concatenate([area_weights(low[i], high[i], out, r, 1) for r in at.tolist()], axis=1)
                    grids.append((down @ x @ area_weights(0, width, out, 0, width).T).ravel())
            columns = [pa.array([v[k] for v in numbers], t) for k, t in enumerate((pa.int64(), pa.float64(), pa.float64()))]
            flat = np.concatenate(grids) if grids else np.zeros(0)
            grid = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * out * out, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *columns, grid], names=[*names, "cells", "total", "squares", "grid"])

    found = parts.mapInArrow(scan, f"{shown}, cells long, total double, squares double, grid array<double>")
    zeros = F.array_repeat(d(0), out * out)
    added = F.aggregate(F.collect_list("grid"), zeros, lambda s, g: F.zip_with(s, g, lambda a, b: a + b))
    return found.groupBy(*names).agg(F.sum("cells").alias("cells"), F.sum("total").alias("total"), F.sum("squares").alias("squares"),
                                     *([added.alias("grid")] if out else []))


def raw_vector(cut: DataFrame, key: Sequence[str], out: int) -> DataFrame:
    """``vector``: the grids of the upstream and the downstream strip, zeros for one that is absent."""
    side = lambda s: F.coalesce(F.max(F.when(F.col("side") == s, F.col("grid"))), F.array_repeat(d(0), out * out))
    return cut.groupBy(*key).agg(F.concat(side("up"), side("down")).alias("vector"))


# Representations of a frame as vectors.

CONTEXTS = (1, 2, 4)


def block_average(x: np.ndarray, grid: int) -> np.ndarray:
    """(frames, grid * grid) means of equal blocks."""
    n, height, width = x.shape
    if height % grid or width % grid:
        raise ValueError(f"a {height}x{width} frame does not divide into a {grid}x{grid} grid")
    return _block_mean(x.reshape(n, grid, height // grid, grid, width // grid)).reshape(n, -1)


def _block_mean(x: np.ndarray) -> np.ndarray:
    return np.nanmean(x, axis=(2, 4))


def crops(x: np.ndarray, cx: np.ndarray, cy: np.ndarray, size: int) -> np.ndarray:
    """(frames, size, size) windows around the centres, zero outside the frame."""
    n, height, width = x.shape
    rows = (np.rint(np.nan_to_num(cy)).astype(int) - size // 2)[:, None] + np.arange(size)
    cols = (np.rint(np.nan_to_num(cx)).astype(int) - size // 2)[:, None] + np.arange(size)
    inside = ((rows >= 0) & (rows < height))[:, :, None] & ((cols >= 0) & (cols < width))[:, None, :]
    taken = x[np.arange(n)[:, None, None], np.clip(rows, 0, height - 1)[:, :, None], np.clip(cols, 0, width - 1)[:, None, :]]
    return np.where(inside, taken, 0.0)


def single_frame_vectors(df: DataFrame, key: Sequence[str], vector: str, height: int, width: int, grid: int, crop: int) -> DataFrame:
    """Six representations of each frame as array columns: block means of the frame, of the frame
    above its p10, and of the robustly scaled frame; crops of the first and the last around the hot centre;
    and the shape features. One pass, no shuffle; frames without a known cell have NaN."""
    step = max(1, CELLS // (height * width))
    rows = df.select(*key, F.transform(vector, lambda v: v.cast("double")).alias("_frame"))
    names = ("current_absolute", "current_background_subtracted", "current_robust_scaled", "hotspot_centered_absolute",
             "hotspot_centered_relative", "thermal_shape_features")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, step):
                part = batch.slice(low, step)
                x = stacked(part.column("_frame"), height, width)
                with warnings.catch_warnings(), np.errstate(invalid="ignore", divide="ignore"):
                    warnings.simplefilter("ignore", RuntimeWarning)
                    p05, p10, p50, p95 = (v[:, None, None] for v in order_statistics(x, (.05, .10, .50, .95)))
                    relative, hot, features = (x - p50) / (p95 - p05 + 1e-6), hot_centre(x), shape(x)
                    flat = lambda v: v.reshape(len(x), -1)
                    found = [block_average(x, grid), block_average(x - p10, grid), block_average(relative, grid),
                             flat(crops(x, hot["cx"], hot["cy"], crop)), flat(crops(relative, hot["cx"], hot["cy"], crop)),
                             np.stack([features[n] for n in SHAPE], axis=1)]
                arrays = [pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), pa.array(v.ravel())) for v in found]
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in key], *arrays], names=[*key, *names])

    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(scan, ", ".join([keys, *[f"{n} array<double>" for n in names]]))


def causal_vectors(df: DataFrame, lagged: str, frame: str) -> DataFrame:
    """Adds a vector per context length: the current scaled frame, the mean of the stack, current
    less oldest, and 1 if a frame is missing; and the frames used, oldest first. ``lagged`` is an array of
    (frame, scaled), the current one first, null where a lag has no frame; a missing one is replaced
    by the current."""
    at = lambda j: F.get(lagged, F.lit(j))
    value = lambda j: F.coalesce(at(j)["scaled"], at(0)["scaled"])
    for count in CONTEXTS:
        stack = [value(j) for j in range(count + 1)]
        mean = stack[0]
        for more in stack[1:]:
            mean = F.zip_with(mean, more, lambda a, b: a + b)
        mean = F.transform(mean, lambda v: v / (count + 1))  # noqa: B023
        gap = F.exists(F.slice(lagged, 2, count), lambda x: x.isNull())
        used = F.concat_ws(";", *[F.coalesce(at(j)[frame], at(0)[frame]).cast("string") for j in range(count, -1, -1)])
        df = df.withColumns({f"causal_context_prev{count}": F.concat(stack[0], mean, F.zip_with(stack[0], stack[-1], lambda a, b: a - b),
                                                                    F.array(gap.cast("double"))), f"_used{count}": used})
    return df


REPRESENTATIONS = {
    "current_absolute": (0, "none"), "current_background_subtracted": (0, "sample_local_p10_background"),
    "current_robust_scaled": (0, "sample_local_robust_p05_p50_p95"), "hotspot_centered_absolute": (0, "none"),
    "hotspot_centered_relative": (0, "sample_local_robust_p05_p50_p95"), "thermal_shape_features": (0, "none"),
    **{f"causal_context_prev{c}": (c, "sample_local_robust_p05_p50_p95") for c in CONTEXTS}}


def representations(df: DataFrame, track: str, index: str, frame: str, vector: str, height: int, width: int, grid: int, crop: int) -> DataFrame:
    """All nine representations of each frame. Contexts join frames by their index, one row per
    frame and lag; lags after the first frame of a track are missing."""
    single = single_frame_vectors(df, [track, index, frame], vector, height, width, grid, crop)
    far = max(CONTEXTS)
    shown = single.select(track, F.explode(F.sequence(F.lit(0), F.lit(far))).alias("lag"), index, frame, F.col("current_robust_scaled").alias("scaled"))
    near = shown.select(track, (F.col(index) + F.col("lag")).alias(index), "lag", frame, "scaled")
    gathered = near.groupBy(track, index).agg(F.map_from_entries(F.collect_list(F.struct("lag", F.struct(frame, "scaled")))).alias("_m"))
    lagged = F.transform(F.sequence(F.lit(0), F.lit(far)), lambda j: F.try_element_at("_m", j))
    rows = single.join(gathered, [track, index]).withColumn("_lagged", lagged).drop("_m")
    return causal_vectors(rows, "_lagged", frame).drop("_lagged")


def manifest(rows: DataFrame, key: Sequence[str], frame: str) -> DataFrame:
    """A provenance row per frame and representation: size, frames used, direction, normalisation,
    and the sum of the elements."""
    items = F.array(*[F.struct(
        F.lit(name).alias("representation_id"), F.size(name).alias("size"),
        F.lit("current_and_preceding_only" if count else "current_only").alias("context"),
        (F.col(f"_used{count}") if count else F.col(frame).cast("string")).alias("context_frames"), F.lit(kind).alias("normalization_id"),
        F.aggregate(name, d(0), lambda a, v: a + v).alias("total")) for name, (count, kind) in REPRESENTATIONS.items()])
    return rows.select(*key, F.explode(items).alias("_i")).select(*key, "_i.*")
