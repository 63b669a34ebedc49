"""Queries: scoring of predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions.scalars import d, region
from trackloom.operators import metrics as M
from trackloom.plans import fixtures as X
from trackloom.plans.registry import query
from trackloom.session import attach, attach_one

BUNDLE = "mae rmse median_ae p90_ae max_ae signed_bias r_squared pearson spearman"


def bundle_sql(source: str, groups: str) -> str:
    """The error bundle over ``source(y, p, groups)``."""
    on = " AND ".join(f"a.{g.strip()} = s.{g.strip()}" for g in groups.split(","))
    return f"""
    , bundle_ranks AS (
      SELECT *, rank() OVER (PARTITION BY {groups} ORDER BY y) + (count(*) OVER (PARTITION BY {groups}, y) - 1) / 2e0 AS ry,
             rank() OVER (PARTITION BY {groups} ORDER BY p) + (count(*) OVER (PARTITION BY {groups}, p) - 1) / 2e0 AS rp
      FROM {source}),
    bundle AS (
      SELECT {groups}, count(*) AS n, avg(abs(p - y)) AS mae, sqrt(avg((p - y) * (p - y))) AS rmse,
        quantile_cont(abs(p - y), 0.5) AS median_ae, quantile_cont(abs(p - y), 0.9) AS p90_ae,
        max(abs(p - y)) AS max_ae, avg(p - y) AS signed_bias,
        CASE WHEN min(y) < max(y) THEN 1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*)) END AS r_squared,
        CASE WHEN count(*) > 2 AND min(y) < max(y) AND min(p) < max(p) THEN corr(y, p) END AS pearson,
        CASE WHEN count(*) > 2 AND min(ry) < max(ry) AND min(rp) < max(rp) THEN corr(ry, rp) END AS spearman
      FROM bundle_ranks GROUP BY {groups})
    """


@query("metrics_bundle", X.with_sql(X.PREDICTIONS) + bundle_sql("predictions", "model_id") + "SELECT * FROM bundle", BUNDLE)
def metrics_bundle(t):
    """A1: full error bundle per model."""
    return M.error_bundle(X.predictions(t), ["model_id"], "y", "p")


@query("metrics_reduced", X.with_sql(X.PREDICTIONS) + """
SELECT model_id, track_id, count(*) AS n, avg(abs(p - y)) AS mae, sqrt(avg((p - y) * (p - y))) AS rmse,
  avg(p - y) AS signed_bias, quantile_cont(abs(p - y), 0.5) AS median_ae
FROM predictions GROUP BY model_id, track_id""", "mae rmse signed_bias median_ae")
def metrics_reduced(t):
    """A2: reduced bundle per model and track."""
    return M.error_bundle(X.predictions(t), ["model_id", "track_id"], "y", "p", reduced=True)


@query("metrics_by_scope", X.with_sql(X.PREDICTIONS, """,
scoped AS (
  SELECT *, 'aggregate' AS scope FROM predictions UNION ALL
  SELECT *, CAST(track_id AS VARCHAR) FROM predictions)""") + bundle_sql("scoped", "model_id, scope") + "SELECT * FROM bundle", BUNDLE)
def metrics_by_scope(t):
    """A1/A3: full bundle over all rows and per track."""
    return M.error_bundle(M.with_scopes(X.predictions(t), "track_id"), ["model_id", "scope"], "y", "p")


# Tracks are longer than the 80 mm of the four regions, so x starts again at 20 after 100.
WRAPPED_SQL = "(20e0 + (x_mm - 20e0) % 80e0)"
REGION_SQL = f"""CASE WHEN {WRAPPED_SQL} < 20 THEN NULL WHEN {WRAPPED_SQL} < 40 THEN '20_40mm' WHEN {WRAPPED_SQL} < 60 THEN '40_60mm'
  WHEN {WRAPPED_SQL} < 80 THEN '60_80mm' WHEN {WRAPPED_SQL} < 100.1e0 THEN '80_100mm' END"""


def wrapped_region():
    return region(d(20) + (F.col("x_mm") - d(20)) % d(80))


@query("metrics_subgroup", X.with_sql(X.PREDICTIONS, f""",
grouped AS (
  SELECT model_id, y, p, 'x_region' AS subgroup_type, {REGION_SQL} AS subgroup_id FROM predictions
  UNION ALL
  SELECT model_id, y, p, 'tile_boundary', CASE WHEN x_mm - floor(x_mm / 5e0) * 5e0 < 1e0 THEN 'near' ELSE 'away' END FROM predictions),
kept AS (SELECT * FROM grouped WHERE subgroup_id IS NOT NULL)""") + bundle_sql("kept", "model_id, subgroup_type, subgroup_id") + "SELECT * FROM bundle", BUNDLE)
def metrics_subgroup(t):
    """Bundle per model by position region and by nearness to a tile edge."""
    x = F.col("x_mm")
    near = F.when(x - F.floor(x / d(5)) * d(5) < 1, "near").otherwise("away")
    return M.subgroup_bundle(X.predictions(t), "model_id",
                             {"x_region": wrapped_region(), "tile_boundary": near}, "y", "p")


@query("unweighted_vs_pooled", X.with_sql(X.PREDICTIONS, """,
per_track AS (SELECT model_id, track_id, avg(abs(p - y)) AS m, avg(p - y) AS b FROM predictions GROUP BY 1, 2),
pooled AS (SELECT model_id, count(*) AS n, avg(abs(p - y)) AS pooled_mae, avg(p - y) AS pooled_bias FROM predictions GROUP BY 1)
""") + """SELECT p.*, u.unweighted_track_mae, u.unweighted_track_bias, u.tracks FROM pooled p
JOIN (SELECT model_id, avg(m) AS unweighted_track_mae, avg(b) AS unweighted_track_bias, count(*) AS tracks FROM per_track GROUP BY 1) u
USING (model_id)""", "pooled_mae pooled_bias unweighted_track_mae unweighted_track_bias")
def unweighted_vs_pooled(t):
    """A3: pooled against unweighted-per-track error."""
    return M.pooled_and_unweighted(X.predictions(t), ["model_id"], "track_id", "y", "p")


FOLD_SQL = X.with_sql(X.PREDICTIONS, """,
folds AS (SELECT track_id, model_id, avg(abs(p - y)) AS mae FROM predictions GROUP BY 1, 2),
changes AS (SELECT f.*, b.mae AS baseline_mae, f.mae - b.mae AS absolute_change, (f.mae - b.mae) / b.mae AS relative_change
  FROM folds f LEFT JOIN (SELECT track_id, mae FROM folds WHERE model_id = 'track_mean') b USING (track_id))""")


def fold_changes(t):
    p = X.predictions(t)
    folds = p.groupBy("track_id", "model_id").agg(F.avg(F.abs(F.col("p") - F.col("y"))).alias("mae"))
    return M.against_baseline(folds, "track_id", "model_id", "mae", "track_mean")


@query("baseline_change", FOLD_SQL + "SELECT * FROM changes", "mae baseline_mae absolute_change relative_change")
def baseline_change(t):
    """Each fold's model against its fold's baseline."""
    return fold_changes(t)


@query("improves_every_track", FOLD_SQL + """SELECT model_id, count(*) AS folds,
  bool_and(absolute_change < 0) AS improves_all_tracks, avg(absolute_change) AS mean_change FROM changes GROUP BY 1""", "mean_change")
def improves_every_track(t):
    """A4: better than the baseline on every track."""
    return M.improves_everywhere(fold_changes(t), "model_id")


@query("development_rule", FOLD_SQL + """, r AS (SELECT -avg(absolute_change) AS mean_gain, -avg(absolute_change) / avg(baseline_mae) AS relative_gain,
  bool_and(absolute_change < 0) AS all_improve, bool_and(absolute_change <= 0.002e0) AS none_worse FROM changes WHERE model_id = 'previous')
SELECT *, all_improve AND none_worse AND (mean_gain >= 0.005e0 OR relative_gain >= 0.05e0) AS success FROM r""", "mean_gain relative_gain")
def development_rule(t):
    """Q3: development success rule over whole tracks."""
    return M.development_rule(fold_changes(t).where("model_id = 'previous'"), "absolute_change", "baseline_mae")


@query("development_rule_with_reference", FOLD_SQL + """, r AS (SELECT -avg(absolute_change) AS mean_gain, -avg(absolute_change) / avg(baseline_mae) AS relative_gain,
  bool_and(absolute_change < 0) AS all_improve, bool_and(absolute_change <= 0.002e0) AS none_worse FROM changes WHERE model_id = 'previous'),
h AS (SELECT avg(abs(p - o_totalprice / 5000e0)) FILTER (WHERE model_id = 'track_mean') AS baseline_reference_mae, avg(abs(p - o_totalprice / 5000e0)) FILTER (WHERE model_id = 'previous') AS candidate_reference_mae
  FROM predictions JOIN orders ON seg = o_orderkey AND track_id = o_custkey % 4)
SELECT r.*, h.*, candidate_reference_mae <= baseline_reference_mae AS reference_not_worse,
  all_improve AND none_worse AND (mean_gain >= 0.005e0 OR relative_gain >= 0.05e0) AND candidate_reference_mae <= baseline_reference_mae AS success FROM r, h""",
       "mean_gain relative_gain baseline_reference_mae candidate_reference_mae")
def development_rule_with_reference(t):
    """Q3: the development rule with the condition on the error against the outside reference."""
    ref = t.orders.select(F.col("o_orderkey").alias("seg"), (F.col("o_custkey") % 4).cast("int").alias("track_id"), (F.col("o_totalprice") / d(5000)).alias("ref"))
    gap = lambda m: F.avg(F.when(F.col("model_id") == m, F.abs(F.col("p") - F.col("ref"))))
    means = X.predictions(t).join(ref, ["seg", "track_id"]).agg(gap("track_mean").alias("baseline_reference_mae"), gap("previous").alias("candidate_reference_mae"))
    return M.development_rule(fold_changes(t).where("model_id = 'previous'"), "absolute_change", "baseline_mae", means)


@query("consistency_status", FOLD_SQL + """SELECT model_id, CASE WHEN avg(absolute_change) < 0 AND bool_and(absolute_change < 0) THEN 'consistent_improvement'
  WHEN avg(absolute_change) < 0 THEN 'aggregate_only' ELSE 'no_improvement' END AS status FROM changes GROUP BY 1""")
def consistency_status(t):
    """Q4: status from aggregate gain and per-track consistency."""
    flags = M.improves_everywhere(fold_changes(t), "model_id")
    return M.status_from(flags, F.col("mean_change") < 0, F.col("improves_all_tracks")).select("model_id", "status")


GAIN_SQL = X.with_sql(X.PREDICTIONS, f""",
errors AS (SELECT track_id, seg, {REGION_SQL} AS region, model_id, abs(p - y) AS ae FROM predictions WHERE {REGION_SQL} IS NOT NULL),
wide AS (SELECT track_id, seg, region, max(CASE WHEN model_id = 'track_mean' THEN ae END) - max(CASE WHEN model_id = 'previous' THEN ae END) AS g
  FROM errors GROUP BY 1, 2, 3),
gains AS (SELECT region, sum(g) AS gain, count(*) AS n FROM wide GROUP BY 1)""")


def region_gains(t, baseline="track_mean", candidate="previous"):
    e = X.predictions(t).withColumns({"region": wrapped_region(), "ae": F.abs(F.col("p") - F.col("y"))})
    return M.region_gain(e, ["track_id", "seg"], "region", "model_id", "ae", baseline, candidate)


@query("region_gain_share", GAIN_SQL + """SELECT *, CASE WHEN sum(gain) OVER () > 0 THEN gain / sum(gain) OVER () END AS share FROM gains""", "gain share")
def region_gain_share(t):
    """Gain per region and its share of the total."""
    return region_gains(t)


@query("primary_rule", GAIN_SQL + """,
conc AS (SELECT CASE WHEN sum(-gain) > 0 THEN max(-gain) / sum(-gain) END AS concentration FROM gains),
m AS (SELECT avg(abs(p - y)) FILTER (WHERE model_id = 'previous') AS bm, avg(abs(p - y)) FILTER (WHERE model_id = 'track_mean') AS cm,
        avg(p - y) FILTER (WHERE model_id = 'previous') AS bb, avg(p - y) FILTER (WHERE model_id = 'track_mean') AS cb FROM predictions)
SELECT bm - cm AS gain, greatest(0.003e0, 0.03e0 * bm) AS required_gain, abs(cb) - abs(bb) AS bias_worsening, concentration,
  (bm - cm >= greatest(0.003e0, 0.03e0 * bm) AND abs(cb) - abs(bb) <= 0.003e0 AND (concentration IS NULL OR concentration <= 0.8e0)) AS confirmed,
  (bm - cm >= 0.002e0 AND abs(cb) - abs(bb) <= 0.003e0) AS secondary
FROM m, conc""", "gain required_gain bias_worsening concentration")
def primary_rule(t):
    """Q1: predeclared gain, bias and concentration rule."""
    conc = M.gain_concentration(region_gains(t, "previous", "track_mean")).select("concentration")
    p = X.predictions(t)
    e = F.col("p") - F.col("y")
    def pick(model, value):
        return F.avg(F.when(F.col("model_id") == model, value))
    m = p.groupBy().agg(pick("previous", F.abs(e)).alias("bm"), pick("track_mean", F.abs(e)).alias("cm"),
                        pick("previous", e).alias("bb"), pick("track_mean", e).alias("cb"))
    one = attach_one(m, conc)
    rule = M.primary_rule(F.col("bm"), F.col("cm"), F.col("bb"), F.col("cb"), F.col("concentration"))
    return one.select("concentration", *[c.alias(k) for k, c in rule.items()],
                      M.secondary_rule(F.col("bm"), F.col("cm"), F.col("bb"), F.col("cb")).alias("secondary"))


@query("spread_check", X.with_sql(X.PREDICTIONS) + """SELECT model_id, stddev_pop(y) AS target_std, stddev_pop(p) AS prediction_std,
  stddev_pop(p) / stddev_pop(y) AS spread_ratio, stddev_pop(p) / stddev_pop(y) <= 0.75e0 AS narrow FROM predictions GROUP BY 1""",
  "target_std prediction_std spread_ratio")
def spread_check(t):
    """Prediction spread against target spread."""
    return M.spread_check(X.predictions(t), "model_id", "y", "p")


# Residual-quantile forecasts: previous value plus the track's residual quantiles.
QUANT_SQL = X.with_sql(X.PREDICTIONS, """,
base AS (SELECT track_id, seg, y, p, y - p AS res FROM predictions WHERE model_id = 'previous'),
rq AS (SELECT track_id, quantile_cont(res, 0.05) AS r05, quantile_cont(res, 0.25) AS r25, quantile_cont(res, 0.5) AS r50,
  quantile_cont(res, 0.75) AS r75, quantile_cont(res, 0.95) AS r95 FROM base GROUP BY 1),
forecasts AS (SELECT track_id, seg, y, p + r05 AS q05, p + r25 AS q25, p + r50 AS q50, p + r75 AS q75, p + r95 AS q95
  FROM base JOIN rq USING (track_id))""")
QCOLS = ["q05", "q25", "q50", "q75", "q95"]


def forecasts(t):
    base = X.predictions(t).where("model_id = 'previous'").withColumn("res", F.col("y") - F.col("p"))
    rq = M.residual_quantiles(base, ["track_id"], "res").select(
        "track_id", *[F.col(c).alias("r_" + c) for c in QCOLS])
    out = attach(base, rq, ["track_id"])
    return out.select("track_id", "seg", "y", *[(F.col("p") + F.col("r_" + c)).alias(c) for c in QCOLS])


@query("residual_quantiles", QUANT_SQL + "SELECT track_id, r05 AS q05, r25 AS q25, r50 AS q50, r75 AS q75, r95 AS q95 FROM rq", "q05 q25 q50 q75 q95")
def residual_quantiles(t):
    """Residual quantiles per track."""
    base = X.predictions(t).where("model_id = 'previous'").withColumn("res", F.col("y") - F.col("p"))
    return M.residual_quantiles(base, ["track_id"], "res")


def pin(q, c):
    return f"greatest({q}e0 * (y - {c}), ({q}e0 - 1e0) * (y - {c}))"


PINS = [(0.05, "q05"), (0.25, "q25"), (0.5, "q50"), (0.75, "q75"), (0.95, "q95")]
PIN = {c: pin(q, c) for q, c in PINS}
TRAPEZOIDS = " + ".join(
    f"({q1}e0 - {q0}e0) * ({PIN[a]} + {PIN[b]}) / 2" for (q0, a), (q1, b) in zip(PINS, PINS[1:]))
SCORES = f"""count(*) AS n, avg(({" + ".join(PIN.values())}) / 5e0) AS mean_pinball,
  avg(2 * ({TRAPEZOIDS}) / 0.9e0) AS crps,
  avg(CASE WHEN y >= q05 AND y <= q95 THEN 1e0 ELSE 0e0 END) AS coverage90, avg(q95 - q05) AS mean_interval_width,
  {", ".join(f"avg({p}) AS pinball_{c}" for c, p in PIN.items())},
  {", ".join(f"avg(CASE WHEN y <= {c} THEN 1e0 ELSE 0e0 END) AS calibration_{c}" for c in PIN)}"""
SCORE_COLS = "mean_pinball crps coverage90 mean_interval_width " + " ".join(f"pinball_{c} calibration_{c}" for _, c in PINS)


@query("pinball_crps", QUANT_SQL + f"SELECT track_id, {SCORES} FROM forecasts GROUP BY track_id", SCORE_COLS)
def pinball_crps(t):
    """Pinball, grid CRPS, coverage, width and calibration per track."""
    return M.quantile_scores(forecasts(t), ["track_id"], "y", QCOLS)


INFLATED = """, lvl AS (SELECT sqrt(avg(e * e)) AS s FROM (SELECT track_id, median(y) - median(q50) AS e FROM forecasts GROUP BY 1)),
raw AS (SELECT track_id, seg, y, list_sort([
  q50 - sqrt(power(q05 - q50, 2) + power(1.6448536269514722e0 * s, 2)), q50 - sqrt(power(q25 - q50, 2) + power(0.6744897501960817e0 * s, 2)), q50,
  q50 + sqrt(power(q75 - q50, 2) + power(0.6744897501960817e0 * s, 2)), q50 + sqrt(power(q95 - q50, 2) + power(1.6448536269514722e0 * s, 2))]) AS q FROM forecasts, lvl),
inflated AS (SELECT track_id, seg, y, q[1] AS q05, q[2] AS q25, q[3] AS q50, q[4] AS q75, q[5] AS q95 FROM raw)"""


@query("level_inflation", QUANT_SQL + INFLATED + f"SELECT track_id, {SCORES} FROM inflated GROUP BY track_id", SCORE_COLS)
def level_inflation(t):
    """Quantiles widened by the level uncertainty, re-sorted and scored."""
    f = forecasts(t)
    level = M.level_uncertainty(f.withColumn("m", F.lit(0)), ["m"], "track_id", "y", "q50").select("level_uncertainty")
    wide = M.inflate_quantiles(attach_one(f, level), QCOLS, F.col("level_uncertainty"))
    return M.quantile_scores(wide, ["track_id"], "y", QCOLS)


@query("level_uncertainty", X.with_sql(X.PREDICTIONS) + """SELECT model_id, count(*) AS folds, sqrt(avg(e * e)) AS level_uncertainty FROM (
  SELECT model_id, track_id, median(y) - median(p) AS e FROM predictions GROUP BY 1, 2) GROUP BY 1""", "level_uncertainty")
def level_uncertainty(t):
    """RMS over tracks of the median error."""
    return M.level_uncertainty(X.predictions(t), ["model_id"], "track_id", "y", "p")


ANCHOR_SQL = X.with_sql(X.REGRESSION, """,
med AS (SELECT track_id, median(y) AS my, median(f1) AS f1, median(f2) AS f2, median(f3) AS f3 FROM regression_rows GROUP BY 1),
ratios AS (SELECT 'f1' AS candidate, my / f1 AS r FROM med UNION ALL SELECT 'f2', my / f2 FROM med UNION ALL SELECT 'f3', my / f3 FROM med)
""")


@query("anchor_calibration", ANCHOR_SQL + """SELECT candidate, count(r) AS tracks, avg(r) AS mean_ratio, stddev_pop(r) / avg(r) AS cv
FROM ratios GROUP BY 1""", "mean_ratio cv")
def anchor_calibration(t):
    """Per-track median ratios, their mean and CV per candidate."""
    return M.anchor_ratios(X.regression_rows(t), "track_id", "y", ["f1", "f2", "f3"])


@query("anchor_choice", ANCHOR_SQL + """SELECT candidate AS c_star, avg(r) AS k_star, stddev_pop(r) / avg(r) AS cv FROM ratios
GROUP BY 1 ORDER BY round(stddev_pop(r) / avg(r), 12), 1 LIMIT 1""", "k_star cv")
def anchor_choice(t):
    """The candidate with the smallest CV."""
    return M.choose_anchor(M.anchor_ratios(X.regression_rows(t), "track_id", "y", ["f1", "f2", "f3"]))
