"""Prediction scoring: error bundles, scopes, quantile scores, gains and rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.scalars import NORMAL_QUANTILES, QUANTILES, change, d, pinball, safe_corr
from trackloom.operators.ordered import average_rank, exact_quantiles, quantile_columns
from trackloom.session import attach, attach_one, materialize


def error_bundle(df: DataFrame, groups: Sequence[str], y: str, p: str,
                 reduced: bool = False) -> DataFrame:
    """Per group: n, MAE, RMSE, median/p90/max absolute error, bias, R2, correlations.

    R2 is NULL for a constant target, correlations also for a constant
    prediction or two rows. ``reduced`` keeps n, MAE, RMSE, median and bias. The
    input is written once, since moments, quantiles and ranks each pass over it.
    """
    df = materialize(df.select(*groups, y, p), spread=True)
    rows = df.withColumns({"_e": F.col(p) - F.col(y), "_ae": F.abs(F.col(p) - F.col(y))})
    aggs = [F.count(F.lit(1)).alias("n"), F.avg("_ae").alias("mae"),
            F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"),
            F.avg("_e").alias("signed_bias")]
    if reduced:
        tails = quantile_columns(rows, groups, "_ae", {"median_ae": 0.5})
        return rows.groupBy(*groups).agg(*aggs).join(tails, list(groups))
    ss = F.var_pop(y) * F.count(F.lit(1))
    aggs += [F.max("_ae").alias("max_ae"), safe_corr(y, p).alias("pearson"),
             F.when(F.min(y) < F.max(y), 1 - F.try_divide(
                 F.sum(F.col("_e") * F.col("_e")), ss)).alias("r_squared")]
    tails = quantile_columns(rows, groups, "_ae", {"median_ae": 0.5, "p90_ae": 0.9})
    return (
        rows.groupBy(*groups).agg(*aggs).join(tails, list(groups))
        .join(rank_correlation(df, groups, y, p), list(groups))
    )


def rank_correlation(df: DataFrame, groups: Sequence[str], y: str, p: str) -> DataFrame:
    """Spearman correlation per group with average ranks for ties."""
    ranked = average_rank(df.select(*groups, y, p), groups, y, "_ry")
    ranked = average_rank(ranked, groups, p, "_rp")
    return ranked.groupBy(*groups).agg(safe_corr("_ry", "_rp").alias("spearman"))


def with_scopes(df: DataFrame, track: str, name: str = "scope", label: str = "aggregate") -> DataFrame:
    """Each row twice: once for the whole and once for its track."""
    return df.withColumn(name, F.explode(F.array(F.lit(label), F.col(track).cast("string"))))


def pooled_and_unweighted(df: DataFrame, model: Sequence[str], track: str, y: str, p: str) -> DataFrame:
    """Pooled MAE and bias next to the unweighted mean over tracks."""
    rows = df.withColumns({"_e": F.col(p) - F.col(y)})
    per_track = rows.groupBy(*model, track).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.abs("_e")).alias("sae"), F.sum("_e").alias("se"))
    return per_track.groupBy(*model).agg(
        F.sum("n").alias("n"), (F.sum("sae") / F.sum("n")).alias("pooled_mae"),
        (F.sum("se") / F.sum("n")).alias("pooled_bias"),
        F.avg(F.col("sae") / F.col("n")).alias("unweighted_track_mae"),
        F.avg(F.col("se") / F.col("n")).alias("unweighted_track_bias"),
        F.count(F.lit(1)).alias("tracks"))


def against_baseline(folds: DataFrame, fold: str, model: str, mae: str, baseline: str) -> DataFrame:
    """Change of each fold's MAE against the baseline model of the same fold."""
    base = folds.where(F.col(model) == baseline).select(fold, F.col(mae).alias("baseline_mae"))
    absolute, relative = change(F.col(mae), F.col("baseline_mae"))
    return folds.join(base, fold, "left").withColumns(
        {"absolute_change": absolute, "relative_change": relative})


def improves_everywhere(changes: DataFrame, model: str) -> DataFrame:
    """Per model: better than the baseline on every fold."""
    return changes.groupBy(model).agg(
        F.count(F.lit(1)).alias("folds"),
        F.coalesce(F.bool_and(F.col("absolute_change") < 0), F.lit(False)).alias("improves_all_tracks"),
        F.avg("absolute_change").alias("mean_change"))


def subgroup_bundle(df: DataFrame, model: str, subgroups: dict[str, Column], y: str, p: str) -> DataFrame:
    """Error bundle per model and per value of each named subgroup; NULL groups drop out."""
    pairs = F.array(*[F.struct(F.lit(k).alias("subgroup_type"), c.cast("string").alias("subgroup_id"))
                      for k, c in subgroups.items()])
    long = df.withColumn("_s", F.explode(pairs)).where(F.col("_s.subgroup_id").isNotNull())
    long = long.select(model, y, p, "_s.subgroup_type", "_s.subgroup_id")
    return error_bundle(long, [model, "subgroup_type", "subgroup_id"], y, p)


def region_gain(df: DataFrame, key: Sequence[str], region: str, model: str, error: str,
                baseline: str, candidate: str) -> DataFrame:
    """Gain of a candidate over a baseline per region, with its share of the total. Rows
    outside all regions take no part.

    Models become columns by conditional sums, so no pivot over the rows is
    needed: each (key, model) holds one error.
    """
    wide = df.where(F.col(region).isNotNull()).groupBy(*key, region).agg(
        F.max(F.when(F.col(model) == baseline, F.col(error))).alias("b"),
        F.max(F.when(F.col(model) == candidate, F.col(error))).alias("c"))
    sums = wide.groupBy(region).agg(F.sum(F.col("b") - F.col("c")).alias("gain"),
                                    F.count(F.lit(1)).alias("n"))
    out = attach_one(sums, sums.groupBy().agg(F.sum("gain").alias("_total")))
    share = F.when(F.col("_total") > 0, F.try_divide(F.col("gain"), F.col("_total")))
    return out.withColumn("share", share).drop("_total")


def gain_concentration(regions: DataFrame) -> DataFrame:
    """Largest region share of the total gain; NULL unless the total is positive."""
    return regions.groupBy().agg(
        F.sum("gain").alias("total_gain"),
        F.when(F.sum("gain") > 0, F.try_divide(F.max("gain"), F.sum("gain"))).alias("concentration"))


def crps_weights(qs: Sequence[float] = QUANTILES) -> list[float]:
    """Trapezoid weights of the pinball losses, scaled by 2 / (q_max - q_min)."""
    w = [0.0] * len(qs)
    for i in range(len(qs) - 1):
        half = (qs[i + 1] - qs[i]) / 2
        w[i] += half
        w[i + 1] += half
    return [2 * v / (qs[-1] - qs[0]) for v in w]


def quantile_scores(df: DataFrame, groups: Sequence[str], y: str, quantiles: Sequence[str]) -> DataFrame:
    """Pinball per quantile and mean, grid CRPS, 90% coverage, interval width, calibration."""
    losses = [pinball(F.col(y), F.col(c), q) for c, q in zip(quantiles, QUANTILES)]
    tags = [f"q{int(q * 100):02d}" for q in QUANTILES]
    crps = sum((d(w) * loss for w, loss in zip(crps_weights(), losses)), d(0))
    lo, hi = F.col(quantiles[0]), F.col(quantiles[-1])
    inside = (F.col(y) >= lo) & (F.col(y) <= hi)
    aggs = [F.count(F.lit(1)).alias("n"),
            F.avg(sum(losses[1:], losses[0]) / len(losses)).alias("mean_pinball"),
            F.avg(crps).alias("crps"), F.avg(inside.cast("double")).alias("coverage90"),
            F.avg(hi - lo).alias("mean_interval_width")]
    aggs += [F.avg(loss).alias(f"pinball_{t}") for loss, t in zip(losses, tags)]
    aggs += [F.avg((F.col(y) <= F.col(c)).cast("double")).alias(f"calibration_{t}")
             for c, t in zip(quantiles, tags)]
    return df.groupBy(*groups).agg(*aggs)


def sorted_quantiles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Repair quantile crossing: each row's quantile columns in ascending order."""
    df = df.withColumn("_q", F.array_sort(F.array(*columns)))
    return df.withColumns({c: F.col("_q")[i] for i, c in enumerate(columns)}).drop("_q")


def inflate_quantiles(df: DataFrame, columns: Sequence[str], level: Column) -> DataFrame:
    """Fold a level uncertainty into five quantiles around their median, then re-sort."""
    mid = F.col(columns[len(columns) // 2])
    out = {}
    for c, z in zip(columns, NORMAL_QUANTILES):
        if z:
            spread = F.sqrt(F.pow(F.col(c) - mid, 2) + F.pow(d(z) * level, 2))
            out[c] = mid + d(1.0 if z > 0 else -1.0) * spread
    return sorted_quantiles(df.withColumns(out), columns)


def residual_quantiles(df: DataFrame, groups: Sequence[str], residual: str) -> DataFrame:
    """The five residual quantiles of an anchored model, one column each."""
    return quantile_columns(df, groups, residual, {f"q{int(q * 100):02d}": q for q in QUANTILES})


def level_uncertainty(df: DataFrame, model: Sequence[str], fold: str, y: str, p: str) -> DataFrame:
    """RMS over folds of median(target) - median(prediction)."""
    long = df.unpivot([*model, fold], [y, p], "_side", "_v")
    med = exact_quantiles(long, [*model, fold, "_side"], "_v", [0.5])
    per_fold = med.groupBy(*model, fold).agg(
        (F.max(F.when(F.col("_side") == y, F.col("quantile")))
         - F.max(F.when(F.col("_side") == p, F.col("quantile")))).alias("_e"))
    return per_fold.groupBy(*model).agg(
        F.count(F.lit(1)).alias("folds"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("level_uncertainty"))


def anchor_ratios(df: DataFrame, track: str, y: str, candidates: Sequence[str]) -> DataFrame:
    """Per candidate feature: mean over tracks of median(y)/median(feature) and its CV."""
    long = df.unpivot([track], [y, *candidates], "candidate", "_v")
    med = exact_quantiles(long, [track, "candidate"], "_v", [0.5])
    target = med.where(F.col("candidate") == y).select(track, F.col("quantile").alias("_y"))
    ratio = F.try_divide("_y", "quantile")
    per_track = med.where(F.col("candidate") != y).join(target, track).withColumn("ratio", ratio)
    return per_track.groupBy("candidate").agg(
        F.count("ratio").alias("tracks"), F.avg("ratio").alias("mean_ratio"),
        F.try_divide(F.stddev_pop("ratio"), F.avg("ratio")).alias("cv"))


def choose_anchor(ratios: DataFrame) -> DataFrame:
    """The candidate with the smallest CV (to twelve decimals); the name breaks ties."""
    return ratios.orderBy(F.round("cv", 12), "candidate").limit(1).select(
        F.col("candidate").alias("c_star"), F.col("mean_ratio").alias("k_star"), "cv")


def spread_check(df: DataFrame, model: str, y: str, p: str, limit: float = 0.75) -> DataFrame:
    """Population spread of predictions against the target's, flagged when far narrower."""
    per_model = df.groupBy(model).agg(
        F.stddev_pop(y).alias("target_std"), F.stddev_pop(p).alias("prediction_std"))
    ratio = F.try_divide("prediction_std", "target_std")
    return per_model.withColumn("spread_ratio", ratio).withColumn(
        "narrow", F.coalesce(ratio <= limit, F.lit(False)))


def primary_rule(baseline_mae: Column, candidate_mae: Column, baseline_bias: Column,
                 candidate_bias: Column, concentration: Column) -> dict[str, Column]:
    """Gain against max(0.003, 3%) with bias and region-concentration limits."""
    gain = baseline_mae - candidate_mae
    required = F.greatest(d(0.003), d(0.03) * baseline_mae)
    worse = F.abs(candidate_bias) - F.abs(baseline_bias)
    ok = (gain >= required) & (worse <= d(0.003)) & (
        concentration.isNull() | (concentration <= d(0.80)))
    return {"gain": gain, "required_gain": required, "bias_worsening": worse, "confirmed": ok}


def secondary_rule(first_mae: Column, second_mae: Column, first_bias: Column,
                   second_bias: Column) -> Column:
    return (first_mae - second_mae >= d(0.002)) & (F.abs(second_bias) - F.abs(first_bias) <= d(0.003))


def interval_rule(ci_low: Column, relative_gain: Column) -> Column:
    """Confirmed when the interval lies above zero and the gain is at least 5%."""
    return F.coalesce((ci_low > 0) & (relative_gain >= d(0.05)), F.lit(False))


def development_rule(changes: DataFrame, change_col: str, base_mae: str, reference: DataFrame | None = None) -> DataFrame:
    """All tracks improve, by 0.005 or 5% on average, none worse than 0.002. ``reference``, one row of
    baseline_reference_mae and candidate_reference_mae, adds that the error against an outside
    reference may not grow."""
    gain, base = -F.avg(change_col), F.avg(base_mae)
    out = changes.groupBy().agg(
        gain.alias("mean_gain"), F.try_divide(gain, base).alias("relative_gain"),
        F.bool_and(F.col(change_col) < 0).alias("all_improve"),
        F.bool_and(F.col(change_col) <= d(0.002)).alias("none_worse"),
    ).withColumn("success", F.col("all_improve") & F.col("none_worse") & (
        (F.col("mean_gain") >= d(0.005)) | (F.col("relative_gain") >= d(0.05))))
    if reference is None:
        return out
    kept = F.coalesce(F.col("candidate_reference_mae") <= F.col("baseline_reference_mae"), F.lit(False))
    return attach_one(out, reference).withColumn("reference_not_worse", kept).withColumn("success", F.col("success") & F.col("reference_not_worse"))


def status_from(df: DataFrame, improves: Column, everywhere: Column) -> DataFrame:
    """Status text from the aggregate gain and its consistency over tracks."""
    return df.withColumn("status", F.when(improves & everywhere, "consistent_improvement").when(
        improves, "aggregate_only").otherwise("no_improvement"))
