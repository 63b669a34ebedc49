"""Label eligibility, support policies and acceptance gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.scalars import d
from trackloom.operators.metrics import with_scopes
from trackloom.operators.ordered import assign_blocks, largest_gap, quantile_columns, running_sum
from trackloom.session import materialize


def histogram_json(df: DataFrame, groups: Sequence[str], reason: str, name: str) -> DataFrame:
    """Counts per reason as a JSON object with sorted keys (few distinct reasons)."""
    counts = df.where(F.col(reason).isNotNull()).groupBy(*groups, reason).agg(F.count(F.lit(1)).alias("_c"))
    entries = F.array_sort(F.collect_list(F.struct(F.col(reason).alias("key"), F.col("_c").alias("value"))))
    return counts.groupBy(*groups).agg(F.to_json(F.map_from_entries(entries)).alias(name))


def policy_summary(labels: DataFrame, track: str, policies: dict[str, Column], reason: str,
                   target: str, x: str) -> DataFrame:
    """Per policy, over all rows and per track: counts, reasons, target spread, x gaps."""
    flags = F.array(*[F.struct(F.lit(k).alias("policy"), c.alias("keep")) for k, c in policies.items()])
    why = F.when(~F.col("_f.keep"), F.when(F.col(reason) == "", "sensitivity_support_threshold").otherwise(F.col(reason)))
    long = labels.withColumn("_f", F.explode(flags)).select(
        track, F.col("_f.policy").alias("policy"), F.col("_f.keep").alias("keep"), why.alias("why"),
        F.col(target).alias("t"), F.col(x).alias("x"))
    key = ["policy", "scope"]
    long = with_scopes(long, track)
    kept = long.where("keep")
    t = F.when(F.col("keep"), F.col("t"))
    main = long.groupBy(*key).agg(
        F.count_if(F.col("keep")).alias("eligible"), F.count_if(~F.col("keep")).alias("excluded"),
        F.avg(F.col("keep").cast("double")).alias("eligible_fraction"), F.avg(t).alias("target_mean"),
        F.stddev_pop(t).alias("target_std"), F.min(t).alias("target_min"), F.max(t).alias("target_max"),
        F.min(F.when(F.col("keep"), F.col("x"))).alias("x_min"), F.max(F.when(F.col("keep"), F.col("x"))).alias("x_max"))
    med = quantile_columns(kept, key, "t", {"target_median": 0.5})
    gaps = largest_gap(kept, key, "x").withColumn("large_gap", F.col("largest_gap") > d(0.6))
    reasons = histogram_json(long, key, "why", "reasons")
    out = main.join(med, key, "left").join(gaps, key, "left").join(reasons, key, "left")
    return out.withColumns({"large_gap": F.coalesce("large_gap", F.lit(False)), "reasons": F.coalesce("reasons", F.lit("{}"))})


def cohort_summary(rows: DataFrame, group: str, eligible: Column, first: Column, second: Column) -> DataFrame:
    """Totals, eligible, available and common rows per group."""
    return rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(eligible).alias("eligible"),
        F.count_if(first).alias("first_available"), F.count_if(second).alias("second_available"),
        F.count_if(eligible & first & second).alias("common"),
        F.count_if(~eligible).alias("excluded"))


def cohort_exclusions(rows: DataFrame, group: str, reason: str, boundary: Column, border: Column) -> DataFrame:
    """Per group: rows, the distribution of exclusion reasons (an empty one is no exclusion) as JSON
    with sorted keys, and the boundary and border cases."""
    main = rows.groupBy(group).agg(F.count(F.lit(1)).alias("total"), F.count_if(boundary).alias("boundary_cases"),
                                   F.count_if(border).alias("border_cases"))
    return main.join(histogram_json(rows.withColumn("_w", F.coalesce(F.col(reason), F.lit(""))), [group], "_w", "reasons"), group)


def quality_gates() -> dict[str, Column]:
    """Ten acceptance gates over quality features; a missing feature fails its test."""
    ok = F.col("finite_prediction")
    sides = F.least("left_valid_fraction", "right_valid_fraction")
    missing = F.least("left_nearest_missing", "right_nearest_missing")
    slab, width, method = F.col("slab_valid_fraction"), F.col("width_sensitivity"), F.col("width_disagreement")

    def holds(c: Column) -> Column:
        return ok & F.coalesce(c, F.lit(False))

    return {
        "accept_all_finite": ok,
        "valid_ge_0p50": holds(slab >= d(.50)),
        "valid_ge_0p70": holds(slab >= d(.70)),
        "side_support_ge_0p50": holds(sides >= d(.50)),
        "agg_width_le_0p10": holds(width <= d(.10)),
        "method_width_le_0p15": holds(method <= d(.15)),
        "nan_distance_ge_0p02": holds(missing.isNull() | (missing >= d(.02))),
        "balanced_rule_v1": holds((slab >= d(.50)) & (width <= d(.15)) & (method <= d(.20))),
        "low_false_accept_rule_v1": holds((sides >= d(.70)) & (width <= d(.10)) & (method <= d(.15))),
        "high_yield_rule_v1": holds((slab >= d(.40)) | (method <= d(.25))),
    }


def apply_gates(features: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """One row per (feature row, gate) with ``accepted`` and the gate's rank."""
    flags = F.array(*[F.struct(F.lit(i).alias("gate_rank"), F.lit(k).alias("gate_id"), c.alias("accepted"))
                      for i, (k, c) in enumerate(gates.items())])
    return features.withColumn("_g", F.explode(flags)).select("*", "_g.*").drop("_g")


def gate_confusion(rows: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Confusion counts, precision, recalls, specificity and conditional geometry errors.

    Rows carry accepted, available, tier, left/right and ref_left/ref_right. Ratios
    with an empty base are NULL.
    """
    acc, av = F.col("accepted"), F.col("available")
    hit = acc & av & F.col("left").isNotNull()
    lerr, rerr = F.col("left") - F.col("ref_left"), F.col("right") - F.col("ref_right")
    werr, cerr = rerr - lerr, (lerr + rerr) / 2

    def ratio(num: Column, base: Column) -> Column:
        return F.try_divide(F.count_if(num).cast("double"), F.count_if(base).cast("double"))

    measurable, uncertain = F.col("tier") == "measurable", F.col("tier") == "uncertain"
    mae_w = F.avg(F.when(hit, F.abs(werr)))
    return rows.groupBy(*groups).agg(
        F.count_if(acc & av).alias("tp"), F.count_if(acc & ~av).alias("fp"),
        F.count_if(~acc & av).alias("fn"), F.count_if(~acc & ~av).alias("tn"),
        ratio(acc & av, acc).alias("precision"), ratio(acc & av, av).alias("recall"),
        ratio(acc & measurable, measurable).alias("measurable_recall"),
        ratio(acc & uncertain, uncertain).alias("uncertain_recall"),
        ratio(~acc & ~av, ~av).alias("specificity"), F.count_if(hit).alias("geometry_count"),
        F.avg(F.when(hit, F.abs(lerr))).alias("left_mae"), F.avg(F.when(hit, F.abs(rerr))).alias("right_mae"),
        mae_w.alias("width_mae"), F.avg(F.when(hit, werr)).alias("width_bias"),
        F.avg(F.when(hit, F.abs(cerr))).alias("centre_mae"), F.avg(F.when(hit, cerr)).alias("centre_bias"),
        F.max(F.when(hit, F.abs(werr))).alias("width_max"), F.max(F.when(hit, F.abs(cerr))).alias("centre_max"))


def gate_yield(rows: DataFrame) -> DataFrame:
    """Accepted share per gate with the rejection reasons."""
    reason = (F.when(F.col("accepted"), "accepted").when(~F.col("finite_prediction"), "nonfinite_boundary")
              .otherwise("objective_rule_failed"))
    main = rows.groupBy("gate_id").agg(
        F.count(F.lit(1)).alias("positions"), F.count_if(F.col("accepted")).alias("accepted_count"),
        F.avg(F.col("accepted").cast("double")).alias("accepted_fraction"))
    return main.join(histogram_json(rows.withColumn("_w", reason), ["gate_id"], "_w", "reasons"), "gate_id")


def gate_criteria(metrics: DataFrame, by_track: DataFrame, width_limit: float, centre_limit: float) -> DataFrame:
    """Pareto class, criteria flags and severe failure on any track."""
    severe = by_track.groupBy("gate_id").agg(
        F.bool_or(F.coalesce(F.col("recall"), F.lit(float("nan"))) < d(.50)).alias("severe_track_failure"))
    rec = F.coalesce("recall", d(0))
    pareto = (F.when(F.col("fp") <= 1, "low_false_accept").when(rec >= d(.7), "balanced_precision_recall")
              .otherwise("high_yield_riskier"))
    return metrics.join(severe, "gate_id").select(
        "gate_id", pareto.alias("pareto"), (F.col("fp") <= 1).alias("few_false_accepts"),
        (rec >= d(.70)).alias("recall_ok"), F.coalesce(F.col("width_mae") < d(width_limit), F.lit(False)).alias("width_improved"),
        F.coalesce(F.col("centre_mae") <= d(centre_limit), F.lit(False)).alias("centre_ok"), "severe_track_failure")


def best_gate(metrics: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Lexicographic choice: few false accepts, recall, precision + recall, width error;
    the earlier gate wins ties. Metrics carry gate_rank."""
    rec, prec = F.coalesce("recall", d(0)), F.coalesce("precision", d(0))
    key = F.struct((F.col("fp") <= 1).alias("a"), (rec >= d(.70)).alias("b"), (prec + rec).alias("c"),
                   (-F.coalesce("width_mae", d(99))).alias("e"), (-F.col("gate_rank")).alias("f"), F.col("gate_id"))
    return metrics.groupBy(*groups).agg(F.max(key)["gate_id"].alias("selected_gate"))


def recommended_gate(metrics: DataFrame) -> DataFrame:
    """Among gates meeting both criteria the most precise; otherwise the best precision + recall."""
    rec, prec = F.coalesce("recall", d(0)), F.coalesce("precision", d(0))
    meets = (F.col("fp") <= 1) & (rec >= d(.70))
    key = F.struct(meets.alias("m"), F.when(meets, prec).otherwise(prec + rec).alias("p"),
                   F.when(meets, rec).otherwise(d(0)).alias("r"),
                   F.when(meets, -F.coalesce("width_mae", d(99))).otherwise(d(0)).alias("w"),
                   (-F.col("gate_rank")).alias("o"), F.col("gate_id"))
    return metrics.groupBy().agg(F.max(key)["gate_id"].alias("recommended_gate"))


def tracks_of(rows: DataFrame, track: str) -> list:
    """The tracks of a table in order, the folds of whole-track validation."""
    return sorted(r[0] for r in rows.select(track).where(F.col(track).isNotNull()).distinct().collect())


def training_folds(rows: DataFrame, track: str, tracks: Sequence) -> DataFrame:
    """Each row once per fold it trains in (every fold but its own track's)."""
    folds = F.array_except(F.array(*[F.lit(v) for v in tracks]), F.array(F.col(track)))
    return rows.withColumn("held_out", F.explode(folds))


def error_cases(rows: DataFrame, fixed: Column | None = None) -> DataFrame:
    """False accepts, false rejects, accepted rows with large width or centre error, and rows that
    are ``fixed`` cases anyway."""
    acc, av = F.col("accepted"), F.col("available")
    lerr, rerr = F.col("left") - F.col("ref_left"), F.col("right") - F.col("ref_right")
    large = (F.abs(rerr - lerr) > d(.15)) | (F.abs((lerr + rerr) / 2) > d(.10))
    case = (F.when(acc & ~av, "false_accept").when(~acc & av, "false_reject")
            .when(acc & av & F.coalesce(large, F.lit(False)), "large_error"))
    case = case if fixed is None else F.coalesce(case, F.when(fixed, "fixed"))
    return rows.withColumn("case", case).where(F.col("case").isNotNull())


def stump_fit(rows: DataFrame, groups: Sequence[str], features: Sequence[str], label: str) -> DataFrame:
    """Single-split rule per group: feature, threshold and direction of least error.

    Counts per distinct feature value are summed along the value, so all
    thresholds are scored from one aggregate; the first feature, lowest threshold
    and upward direction win ties.
    """
    pairs = F.array(*[F.struct(F.lit(i).alias("feature_rank"), F.lit(n).alias("feature"),
                               F.coalesce(F.col(n).cast("double"), d(0)).alias("x")) for i, n in enumerate(features)])
    long = rows.withColumn("_p", F.explode(pairs)).select(*groups, F.col(label).alias("_y"), "_p.*")
    values = long.groupBy(*groups, "feature_rank", "feature", "x").agg(
        F.count_if(F.col("_y")).alias("pos"), F.count_if(~F.col("_y")).alias("neg"))
    values = materialize(values)
    key = [*groups, "feature_rank", "feature"]
    blocked = assign_blocks(values, ["x"], groups=key).df
    run = running_sum(running_sum(blocked, key, ["x"], "pos", "cp"), key, ["x"], "neg", "cn")
    totals = values.groupBy(*key).agg(F.sum("pos").alias("tp"), F.sum("neg").alias("tn"))
    run = run.join(totals, key)
    below_pos, below_neg = F.col("cp") - F.col("pos"), F.col("cn") - F.col("neg")
    up = below_pos + (F.col("tn") - below_neg)             # predict positive at x and above
    down = F.col("cn") + (F.col("tp") - F.col("cp"))       # predict positive at x and below
    n = (F.col("tp") + F.col("tn")).cast("double")
    options = F.array(F.struct((up / n).alias("loss"), "feature_rank", F.col("x").alias("threshold"),
                               F.lit(-1).alias("order"), "feature"),
                      F.struct((down / n).alias("loss"), "feature_rank", F.col("x").alias("threshold"),
                               F.lit(1).alias("order"), "feature"))
    best = run.withColumn("_o", F.explode(options)).groupBy(*groups).agg(F.min("_o").alias("b"))
    return best.select(*groups, "b.feature", "b.threshold", (-F.col("b.order")).alias("direction"), "b.loss")
