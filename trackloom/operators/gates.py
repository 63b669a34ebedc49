"""Acceptance gates held out by whole tracks: fixed rules, the rule chosen on the other tracks,
and two diagnostics fitted on them, a one-split tree and a logistic rule.

Both fits start from counts of equal values per track, which are partial sums; a fold's training
counts are the other tracks' counts. Rows are never copied per fold.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.functions.scalars import d
from trackloom.operators import labels as L
from trackloom.operators.ordered import assign_blocks, running_sum
from trackloom.session import attach, bounded, broadcast_if_small, materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Distinct rows whose gradient steps run on the driver; beyond, every step is a pass over them.
LOCAL_ROWS = 200_000


def values_of(features: Sequence[str]) -> list[Column]:
    """Features as doubles; a missing one counts as 0."""
    return [F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")), d(0)).alias(f) for f in features]


def fold_histograms(rows: DataFrame, track: str, features: Sequence[str], label: str) -> DataFrame:
    """(held_out, feature_rank, feature, x, pos, neg): counts per distinct value of each fold's
    training tracks, summed from the tracks' own counts."""
    pairs = F.array(*[F.struct(F.lit(i).alias("feature_rank"), F.lit(n).alias("feature"), v.alias("x"))
                      for i, (n, v) in enumerate(zip(features, values_of(features), strict=True))])
    long = rows.select(track, F.col(label).alias("_y"), F.explode(pairs).alias("_p")).select(track, "_y", "_p.*")
    own = materialize(long.groupBy(track, "feature_rank", "feature", "x").agg(
        F.count_if(F.col("_y")).alias("pos"), F.count_if(~F.col("_y")).alias("neg")))
    tracks = sorted(r[0] for r in own.select(track).distinct().collect())
    return L.training_folds(own, track, tracks).groupBy("held_out", "feature_rank", "feature", "x").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def stump_folds(rows: DataFrame, track: str, features: Sequence[str], label: str) -> DataFrame:
    """(held_out, feature, threshold, direction, loss): the split of least training error per
    fold, from running sums along the values; the first feature, lowest threshold and upward
    direction win ties."""
    values = materialize(fold_histograms(rows, track, features, label))
    key = ["held_out", "feature_rank", "feature"]
    blocked = assign_blocks(values, ["x"], groups=key).df
    run = running_sum(running_sum(blocked, key, ["x"], "pos", "cp"), key, ["x"], "neg", "cn")
    totals = values.groupBy(*key).agg(F.sum("pos").alias("tp"), F.sum("neg").alias("tn"))
    run = run.join(broadcast_if_small(totals), key)
    n = (F.col("tp") + F.col("tn")).cast("double")
    up = F.col("cp") - F.col("pos") + F.col("tn") - F.col("cn") + F.col("neg")
    down = F.col("cn") + F.col("tp") - F.col("cp")
    option = lambda wrong, order: F.struct((wrong / n).alias("loss"), "feature_rank", F.col("x").alias("threshold"),
                                           F.lit(order).alias("order"), "feature")
    best = run.select("held_out", F.explode(F.array(option(up, -1), option(down, 1))).alias("o")).groupBy("held_out").agg(F.min("o").alias("b"))
    return best.select("held_out", "b.feature", "b.threshold", (-F.col("b.order")).alias("direction"), "b.loss")


def _slopes(table: np.ndarray, tracks: np.ndarray, folds: list, means: dict, scales: dict, weights: dict) -> dict:
    """Fold: summed gradient of the logistic loss over its training rows, without the penalty.
    Columns of ``table``: features, label, number of rows."""
    out = {}
    for fold in folds:
        mine = table[tracks != fold]
        z = (mine[:, :-2] - means[fold]) / scales[fold]
        w = weights[fold]
        gap = (1 / (1 + np.exp(-np.clip(w[0] + z @ w[1:], -20, 20))) - mine[:, -2]) * mine[:, -1]
        out[fold] = np.r_[gap.sum(), gap @ z]
    return out


def logistic_folds(rows: DataFrame, track: str, features: Sequence[str], label: str, steps: int = 1000,
                   rate: float = 0.1, penalty: float = 0.05) -> DataFrame:
    """(held_out, intercept, coefficients, means, scales): fixed gradient steps of an L2 logistic
    rule per fold on its training rows, features standardised there and missing ones 0. All folds
    move together; equal rows are counted first, and the steps run on the counts."""
    spark, p = rows.sparkSession, len(features)
    counts = rows.select(track, *values_of(features), F.col(label).cast("double").alias("_y")).groupBy(track, *features, "_y").agg(
        F.count(F.lit(1)).cast("double").alias("_n"))
    counts = materialize(counts)
    centre = [r or 0.0 for r in counts.agg(*[F.avg(f) for f in features]).first()]
    sums = [x for f, c in zip(features, centre, strict=True) for x in (F.sum(F.col("_n") * (F.col(f) - c)), F.sum(F.col("_n") * (F.col(f) - c) ** 2))]
    per = {r[0]: np.array(r[1:], float) for r in counts.groupBy(track).agg(F.sum("_n"), *sums).collect()}
    folds = sorted(t for t in per if len(per) > 1)
    total, means, scales, size = sum(per.values()), {}, {}, {}
    for t in folds:
        rest = total - per[t]
        mean = rest[1::2] / rest[0]
        spread = np.sqrt(np.maximum(rest[2::2] / rest[0] - mean ** 2, 0))
        size[t], means[t], scales[t] = rest[0], mean + centre, np.where(spread > 1e-12, spread, 1.0)
    weights = {t: np.zeros(p + 1) for t in folds}
    names = [*features, "_y", "_n"]
    local = bounded(counts, LOCAL_ROWS)
    table = None if local is None else local.toPandas()
    place = {t: i for i, t in enumerate(folds)}

    def passed(current: dict) -> dict:
        sent = spark.sparkContext.broadcast(current)

        def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict = {}
            for batch in batches:
                found = _slopes(batch[names].to_numpy(float), batch[track].to_numpy(), folds, means, scales, sent.value)
                held = {t: held.get(t, 0) + v for t, v in found.items()}
            if held:
                yield pd.DataFrame({"k": [place[t] for t in held], "s": [v.tolist() for v in held.values()]})

        entries = counts.mapInPandas(reduce, "k int, s array<double>").select("k", F.posexplode("s").alias("i", "v"))
        out = {t: np.zeros(p + 1) for t in folds}
        for r in entries.groupBy("k", "i").agg(F.sum("v").alias("v")).collect():
            out[folds[r["k"]]][r["i"]] = r["v"]
        return out

    for _ in range(steps if folds else 0):
        slopes = passed(weights) if table is None else _slopes(
            table[names].to_numpy(float), table[track].to_numpy(), folds, means, scales, weights)
        weights = {t: w - rate * (slopes[t] / size[t] + penalty * np.r_[0.0, w[1:]]) for t, w in weights.items()}
    schema = T.StructType([T.StructField("held_out", rows.schema[track].dataType), T.StructField("intercept", T.DoubleType()),
                           *[T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("coefficients", "means", "scales")]])
    return spark.createDataFrame([(t, float(weights[t][0]), weights[t][1:].tolist(), means[t].tolist(), scales[t].tolist()) for t in folds], schema)


def held_out_gates(rows: DataFrame, track: str, gates: dict[str, Column], features: Sequence[str]) -> DataFrame:
    """Confusion of every rule on each held-out track: the fixed rules, the one chosen on the
    other tracks (``selected_gate``), and the fitted tree and logistic rule. Rows carry what
    ``gate_confusion`` needs, finite_prediction and the features."""
    judged = materialize(L.apply_gates(rows, gates))
    fixed = materialize(L.gate_confusion(judged, [track, "gate_id", "gate_rank"])).withColumnRenamed(track, "held_out")
    tracks = sorted(r[0] for r in fixed.select("held_out").distinct().collect())
    train = L.gate_confusion(L.training_folds(judged, track, tracks), ["held_out", "gate_id", "gate_rank"])
    chosen = L.best_gate(train, ["held_out"]).withColumnRenamed("selected_gate", "gate_id")
    chosen = chosen.join(fixed, ["held_out", "gate_id"]).drop("gate_rank").withColumnsRenamed({"gate_id": "selected_gate"}).withColumns(
        {"gate_id": F.lit("selected_shared_rule"), "role": F.lit("selected_on_other_tracks")})
    x = F.array(*values_of(features))
    stump = stump_folds(rows, track, features, "available").select(F.col("held_out").alias(track), "feature", "threshold", "direction")
    at = F.element_at(F.map_from_arrays(F.array(*[F.lit(f) for f in features]), x), F.col("feature"))
    tree = attach(rows, stump, [track], "inner").withColumn(
        "accepted", F.col("finite_prediction") & (F.col("direction") * at >= F.col("direction") * F.col("threshold")))
    fit = logistic_folds(rows, track, features, "available").withColumnRenamed("held_out", track)
    terms = F.transform(x, lambda v, i: (v - F.get("means", i)) / F.get("scales", i) * F.get("coefficients", i))
    score = F.col("intercept") + F.aggregate(terms, d(0), lambda a, v: a + v)
    logistic = attach(rows, fit, [track], "inner").withColumn("accepted", F.col("finite_prediction") & (score >= 0))
    none = F.lit(None).cast("string").alias("selected_gate")
    out = fixed.drop("gate_rank").select("*", none, F.lit("shared_fixed_rule").alias("role")).unionByName(chosen)
    for name, part in (("diagnostic_tree", tree), ("diagnostic_logistic", logistic)):
        found = L.gate_confusion(part, [track]).withColumnRenamed(track, "held_out")
        out = out.unionByName(found.select("*", F.lit(name).alias("gate_id"), none, F.lit("diagnostic_training_tracks").alias("role")))
    return out.withColumn("combined_mae", (F.col("left_mae") + F.col("right_mae")) / 2)
