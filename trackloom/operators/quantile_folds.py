"""Linear quantile models of all folds, penalties and quantiles, fitted together.

Each model minimises the mean pinball loss plus alpha times the L1 norm of its standardised
coefficients, on the rows of all tracks but its held-out one, for the target less the fold's anchor:
the mean over the training tracks of their ratio median(target) / median(anchor feature), times
that feature. Missing features take the fold's training median and scales are the fold's.

The pinball loss is smoothed over a width that shrinks in steps; every step is one pass that sums
gradient and curvature of every model, and a damped Newton move on the driver. A move that raises
the smoothed loss is taken back and repeated with the curvature of a majorising parabola, which
cannot raise it. Rows are packed once into matrices of a track's rows; the pass holds one matrix of
models, and what tasks return is a few numbers per model. The best point by the true loss is kept.
Models without features are the order statistics themselves.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions.scalars import d
from trackloom.operators import metrics as M
from trackloom.operators.labels import training_folds
from trackloom.operators.ordered import exact_quantiles, quantile_columns
from trackloom.session import attach, materialize, pack

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Widths of the smoothing in standard deviations of the target, and passes at each.
WIDTHS, PASSES = tuple(0.5 * 0.3 ** k for k in range(9)), 4
#: The part of the width over which the corner of the penalty is smoothed.
SOFT = 0.1


def fold_anchors(df: DataFrame, track: str, y: str, anchor: str) -> dict:
    """Per held-out track the mean ratio median(y) / median(anchor) of the other tracks."""
    long = df.unpivot([track], [y, anchor], "_side", "_v")
    found: dict = {}
    for r in exact_quantiles(long, [track, "_side"], "_v", [0.5]).collect():
        found.setdefault(r[track], {})[r["_side"]] = r["quantile"]
    ratio = {t: m[y] / m[anchor] for t, m in found.items() if m.get(anchor)}
    return {t: sum(v for o, v in ratio.items() if o != t) / max(1, sum(o != t for o in ratio)) for t in sorted(found)}


def fold_scales(df: DataFrame, track: str, features: Sequence[str], tracks: Sequence) -> dict:
    """Per held-out track: training medians (where a feature has gaps), means and scales.

    Sums per track give every fold; only features with gaps are ranked per fold.
    """
    if not features:
        return {t: np.zeros((3, 0)) for t in tracks}
    known = {f: F.col(f).isNotNull() & ~F.isnan(f) for f in features}
    centre = [r or 0.0 for r in df.agg(*[F.avg(F.when(known[f], F.col(f))).alias(f) for f in features]).first()]
    shifted = {f: F.when(known[f], F.col(f) - d(c)) for f, c in zip(features, centre, strict=True)}
    aggs = [x for f in features for x in (F.count(shifted[f]), F.coalesce(F.sum(shifted[f]), d(0)), F.coalesce(F.sum(shifted[f] ** 2), d(0)))]
    per = {r[track]: np.array(r[1:], float) for r in df.groupBy(track).agg(
        F.count(F.lit(1)).cast("double"), *[a.alias(f"a{i}") for i, a in enumerate(aggs)]).collect()}
    gaps = [f for i, f in enumerate(features) if any(v[0] > v[1 + 3 * i] for v in per.values())]
    medians: dict = {}
    if gaps:
        long = training_folds(df, track, tracks).unpivot(["held_out"], gaps, "_f", "_v").where(F.col("_v").isNotNull() & ~F.isnan("_v"))
        for r in quantile_columns(long, ["held_out", "_f"], "_v", {"m": 0.5}).collect():
            medians[r["held_out"], r["_f"]] = r["m"]
    total, out = sum(per.values()), {}
    for t in tracks:
        rest = total - per[t]
        fill = np.array([medians.get((t, f), c) for f, c in zip(features, centre, strict=True)]) - centre
        lost = rest[0] - rest[1::3]
        mean = (rest[2::3] + lost * fill) / rest[0]
        spread = np.sqrt(np.maximum((rest[3::3] + lost * fill ** 2) / rest[0] - mean ** 2, 0))
        out[t] = np.stack([fill + centre, mean + centre, np.where(spread > 1e-12, spread, 1.0)])
    return out


class Batch:
    """The models of all folds and what a pass needs to know of each."""

    def __init__(self, anchors: dict, scales: dict, alphas: Sequence[float], quantiles: Sequence[float]):
        self.folds = list(anchors)
        self.anchors, self.scales = anchors, scales
        self.alpha = np.repeat(np.asarray(alphas, float), len(quantiles))
        self.q = np.tile(np.asarray(quantiles, float), len(alphas))

    def design(self, fold, x: np.ndarray) -> np.ndarray:
        """Standardised features, a row each, below a row of ones."""
        fill, mean, scale = (v[:, None] for v in self.scales[fold])
        return np.vstack([np.ones((1, x.shape[1])), (np.where(np.isfinite(x), x, fill) - mean) / scale])

    def sums(self, fold, line: np.ndarray, beta: np.ndarray, width: float) -> np.ndarray:
        """Of a block (target, anchor feature, features): a row of sums per model."""
        z, q = self.design(fold, line[2:]), self.q[:, None]
        upper = np.triu_indices(len(z))
        pairs = z[upper[0]] * z[upper[1]]
        r = (line[0] - self.anchors[fold] * line[1]) - beta @ z
        size = np.abs(r)
        total, far = r.sum(1, keepdims=True), size.sum(1, keepdims=True)
        loss = q * total + (far - total) / 2
        inside = (size <= width).astype(float)
        slope = (q - 0.5) * z.sum(1) + np.clip(r, -width, width) @ z.T / (2 * width)
        np.maximum(size, width, out=size)
        major = np.reciprocal(size) @ pairs.T / 2
        np.subtract(width, np.minimum(np.abs(r), width), out=size)
        smooth = far / 2 + (q - 0.5) * total + np.einsum("ij,ij->i", size, size)[:, None] / (4 * width)
        return np.hstack([loss, smooth, slope, inside @ pairs.T / (2 * width), major, np.full((len(q), 1), z.shape[1])])


def step_sums(blocks: DataFrame, batch: Batch, beta: dict, width: float) -> dict:
    """Fold: per model the summed pinball loss, smoothed loss, gradient and two curvatures, over
    packed rows (target, anchor feature, features) of the other tracks."""
    p = next(iter(beta.values())).shape[1]
    sent = blocks.sparkSession.sparkContext.broadcast((batch, beta))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, beta = sent.value
        sums: dict = {}
        for part in batches:
            for own, n, block in zip(*(part.column(c) for c in ("k", "n", "block")), strict=True):
                line = np.frombuffer(block.as_buffer()).reshape(-1, n.as_py())
                for k, fold in enumerate(batch.folds):
                    if k != own.as_py():
                        sums[k] = sums.get(k, 0) + batch.sums(fold, line, beta[fold], width)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.ravel() for s in sums.values()], pa.list_(pa.float64()))], ["k", "s"])

    partial = blocks.mapInArrow(reduce, "k int, s array<double>")
    entries = partial.select("k", F.posexplode("s").alias("i", "v")).groupBy("k", "i").agg(F.sum("v").alias("v"))
    size, out = 3 + p + p * (p + 1), {}
    for r in entries.collect():  # folds x models x a few numbers
        out.setdefault(r["k"], np.zeros(len(batch.q) * size))[r["i"]] = r["v"]
    return {batch.folds[k]: v.reshape(len(batch.q), size) for k, v in out.items()}


def fold_quantiles(rows: DataFrame, track: str, anchors: dict, quantiles: Sequence[float]) -> dict:
    """Per held-out track the quantiles of the training rows' target less anchor: models without features."""
    ratio = F.create_map(*[v for t, k in anchors.items() for v in (F.lit(t), d(k))])
    long = training_folds(rows, track, list(anchors)).select("held_out", (F.col("y") - ratio[F.col("held_out")] * F.col("_a")).alias("_r"))
    found = {(r["held_out"], r["prob"]): r["quantile"] for r in exact_quantiles(long, ["held_out"], "_r", quantiles, discrete=True).collect()}
    return {t: np.array([[found[t, float(q)]] for q in quantiles]) for t in anchors}


def _move(sums: np.ndarray, beta: np.ndarray, alpha: float, share: float, width: float) -> np.ndarray:
    """A Newton move whose curvature has ``share`` of the majorising parabola's."""
    p = len(beta)
    upper, n = np.triu_indices(p), sums[-1]
    m = len(upper[0])
    curve = np.zeros((p, p))
    curve[upper] = ((1 - share) * sums[2 + p:2 + p + m] + share * sums[2 + p + m:2 + p + 2 * m]) / n
    curve = curve + curve.T - np.diag(np.diag(curve))
    shrink = np.r_[0.0, alpha / (np.abs(beta[1:]) + SOFT * width)]
    pull = sums[2:2 + p] / n - shrink * beta
    return beta + np.linalg.solve(curve + np.diag(shrink + 1e-12), pull)


def fit_folds(df: DataFrame, track: str, anchor: str, features: Sequence[str], y: str, quantiles: Sequence[float],
              alphas: Sequence[float]) -> DataFrame:
    """(held_out, alpha, quantile, anchor_ratio, intercept, coefficients, medians, means, scales,
    loss): the models of every fold, with coefficients of the standardised features and the mean
    training pinball loss plus penalty. Rows without target or anchor take no part."""
    spark = df.sparkSession
    ok = F.col(y).isNotNull() & ~F.isnan(y) & F.col(anchor).isNotNull() & ~F.isnan(anchor)
    rows = df.where(ok).select(track, F.col(y).cast("double").alias("y"), F.col(anchor).cast("double").alias("_a"),
                               *[F.col(f).cast("double").alias(f) for f in features])
    rows = materialize(rows, spread=True)
    anchors = fold_anchors(rows, track, "y", "_a")
    scales = fold_scales(rows, track, features, list(anchors))
    batch = Batch(anchors, scales, alphas, quantiles)
    unit = rows.agg(F.stddev_pop("y")).first()[0] or 1.0
    models, p = len(batch.q), len(features) + 1
    blocks = pack(rows, ["y", "_a", *features], track, batch.folds)
    beta = {t: np.zeros((models, p)) for t in anchors}
    best = {(t, j): (math.inf, None) for t in anchors for j in range(models)}
    widths, passes = [w * unit for w in WIDTHS], PASSES
    if len(anchors) < 2:
        widths = []
    elif not features:  # the optimum is known, one pass gives its loss
        known = fold_quantiles(rows, track, anchors, quantiles)
        beta, widths, passes = {t: np.tile(v, (len(alphas), 1)) for t, v in known.items()}, widths[-1:], 0
    for width in widths:
        held: dict = {}
        share = {k: 0.02 for k in best}
        for turn in range(passes + 1):
            sums = step_sums(blocks, batch, beta, width)
            for (t, j), (least, _) in list(best.items()):
                s, b, alpha = sums[t][j], beta[t][j], batch.alpha[j]
                cost = alpha * np.abs(b[1:]).sum()
                if s[0] / s[-1] + cost < least:
                    best[t, j] = (s[0] / s[-1] + cost, b.copy())
                size = np.abs(b[1:])
                smooth = s[1] / s[-1] + alpha * (size - SOFT * width * np.log1p(size / (SOFT * width))).sum()
                if turn and smooth > held[t, j][0]:
                    share[t, j] = min(1.0, 8 * share[t, j])
                else:
                    held[t, j] = (smooth, b.copy(), s)
                    share[t, j] = max(0.02, share[t, j] / 4)
                beta[t][j] = _move(held[t, j][2], held[t, j][1], alpha, share[t, j], width)
    out = []
    for (t, j), (loss, b) in best.items():
        if b is not None:
            fill, mean, scale = scales[t]
            out.append((t, float(batch.alpha[j]), float(batch.q[j]), float(anchors[t]), float(b[0]), b[1:].tolist(),
                        fill.tolist(), mean.tolist(), scale.tolist(), float(loss)))
    kind = df.schema[track].dataType.simpleString()
    return spark.createDataFrame(out, f"held_out {kind}, alpha double, quantile double, anchor_ratio double, intercept double, "
                                 "coefficients array<double>, medians array<double>, means array<double>, scales array<double>, loss double")


def predict_held_out(df: DataFrame, models: DataFrame, track: str, anchor: str, features: Sequence[str],
                     names: Sequence[str]) -> DataFrame:
    """Each row of ``df`` once per penalty, with the sorted quantiles of the models that held its
    track out as columns ``names``."""
    per = models.groupBy("held_out", "alpha").agg(
        F.first("anchor_ratio").alias("_k"), F.first("medians").alias("_fill"), F.first("means").alias("_mu"),
        F.first("scales").alias("_sd"), F.array_sort(F.collect_list(F.struct("quantile", "intercept", "coefficients"))).alias("_m"))
    rows = attach(df, per.withColumnRenamed("held_out", track), [track], "inner")
    values = F.array(*[F.col(f).cast("double") for f in features]).cast("array<double>")
    z = F.transform(values, lambda v, i: (F.coalesce(F.nanvl(v, F.lit(None).cast("double")), F.get("_fill", i)) - F.get("_mu", i)) / F.get("_sd", i))
    dot = lambda m: F.aggregate(F.zip_with(m["coefficients"], F.col("_z"), lambda a, b: a * b), d(0), lambda s, v: s + v)
    fits = F.array_sort(F.transform("_m", lambda m: F.col("_k") * F.col(anchor) + m["intercept"] + dot(m)))
    rows = rows.withColumn("_z", z).withColumn("_q", fits)
    return rows.withColumns({c: F.col("_q")[i] for i, c in enumerate(names)}).drop("_k", "_fill", "_mu", "_sd", "_m", "_z", "_q")


def choose_alpha(scored: DataFrame, track: str, y: str, quantiles: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Per penalty: the mean over held-out tracks of their mean pinball loss, the root mean square
    of their level errors median(target) - median(middle quantile), and whether it is chosen
    (least pinball, the smaller penalty of equals)."""
    loss = sum((M.pinball(F.col(y), F.col(c), q) for c, q in zip(names, quantiles, strict=True)), d(0)) / len(names)
    per = scored.groupBy("alpha", track).agg(F.avg(loss).alias("pinball"))
    mean = per.groupBy("alpha").agg(F.count(F.lit(1)).alias("folds"), F.avg("pinball").alias("mean_pinball"))
    level = M.level_uncertainty(scored, ["alpha"], track, y, names[len(names) // 2]).drop("folds")
    out = materialize(mean.join(level, "alpha"))
    best = out.agg(F.min(F.struct("mean_pinball", "alpha"))["alpha"].alias("_b")).first()[0]
    return out.withColumn("chosen", F.coalesce(F.col("alpha") == F.lit(best).cast("double"), F.lit(False)))


def protocol(df: DataFrame, track: str, anchor: str, features: Sequence[str], y: str, quantiles: Sequence[float],
             alphas: Sequence[float], names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(penalties with their scores and the choice; held-out rows under the chosen penalty, their
    quantiles inflated by its level uncertainty)."""
    models = materialize(fit_folds(df, track, anchor, features, y, quantiles, alphas))
    known = df.where(F.col(y).isNotNull() & ~F.isnan(y) & F.col(anchor).isNotNull() & ~F.isnan(anchor))
    scored = materialize(predict_held_out(known, models, track, anchor, features, names))
    scores = materialize(choose_alpha(scored, track, y, quantiles, names))
    level = scores.where("chosen").select("alpha", "level_uncertainty")
    wide = attach(scored, level, ["alpha"], "inner")
    return scores, M.inflate_quantiles(wide, names, F.col("level_uncertainty"))
