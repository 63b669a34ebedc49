"""Queries: models with whole-track validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import scalars as S
from trackloom.functions.scalars import d
from trackloom.operators import frames as FR
from trackloom.operators import joins as J
from trackloom.operators import labels as L
from trackloom.operators import metrics as M
from trackloom.operators import models as R
from trackloom.operators import nested as N
from trackloom.operators import ordered as O
from trackloom.operators import quantile_folds as QF
from trackloom.plans import fixtures as X
from trackloom.plans.registry import query
from trackloom.plans.scoring import BUNDLE, bundle_sql
from trackloom.session import attach, attach_one, materialize

POLY = ["x1", "x2", "x3"]
RIDGE_ALPHAS = (0.1, 1.0, 10.0, 100.0)


def poly_rows(t):
    """Regression rows with x = quantity and its powers."""
    rows = X.regression_rows(t)
    x1, x2, x3 = S.powers(F.col("f1"), 3)
    return rows.withColumns({"x1": x1, "x2": x2, "x3": x3}).drop("f1", "l_orderkey", "l_linenumber")


POLY_SQL = X.with_sql(X.REGRESSION, "poly AS (SELECT track_id, f1 AS x1, f1 * f1 AS x2, f1 * f1 * f1 AS x3, f2, f3, y FROM regression_rows)")


def moments_sql(name: str, source: str, groups: str, names: list[str], y: str) -> str:
    """Training means, scales and standardised covariances per group."""
    n = len(names)
    first = ", ".join([f"avg({v}) AS m{i}, stddev_pop({v}) AS s{i}, covar_pop({v}, {y}) AS cy{i}" for i, v in enumerate(names)]
                      + [f"covar_pop({names[i]}, {names[j]}) AS c{i}{j}" for i in range(n) for j in range(i + 1, n)])
    return f", {name} AS (SELECT {groups}, CAST(count(*) AS DOUBLE) AS n, avg({y}) AS my, {first} FROM {source} GROUP BY {groups})"


def det3(m: list[list[str]]) -> str:
    (a, b, c), (e, f, g), (h, i, j) = m
    return f"(({a}) * (({f}) * ({j}) - ({g}) * ({i})) - ({b}) * (({e}) * ({j}) - ({g}) * ({h})) + ({c}) * (({e}) * ({i}) - ({f}) * ({h})))"


def solve3_sql(use: list[str], alpha: str) -> list[str]:
    """Raw coefficients k0..k2 by Cramer's rule; use[i] is a SQL condition for feature i."""
    def g(i, j):
        a, b = min(i, j), max(i, j)
        if i == j:
            return f"CASE WHEN {use[i]} THEN n + {alpha} ELSE 1e0 END"
        return f"CASE WHEN {use[a]} AND {use[b]} THEN n * c{a}{b} / (s{a} * s{b}) ELSE 0e0 END"
    rhs = [f"CASE WHEN {use[i]} THEN n * cy{i} / s{i} ELSE 0e0 END" for i in range(3)]
    base = [[g(i, j) for j in range(3)] for i in range(3)]
    out = []
    for k in range(3):
        m = [[rhs[i] if j == k else base[i][j] for j in range(3)] for i in range(3)]
        out.append(f"{det3(m)} / {det3(base)} / s{k}")
    return out


def solve2_sql(alpha: str) -> tuple[str, str]:
    det = f"((n + {alpha}) * (n + {alpha}) - (n * c01 / (s0 * s1)) * (n * c01 / (s0 * s1)))"
    k0 = f"((n * cy0 / s0) * (n + {alpha}) - (n * cy1 / s1) * (n * c01 / (s0 * s1))) / {det} / s0"
    k1 = f"((n * cy1 / s1) * (n + {alpha}) - (n * cy0 / s0) * (n * c01 / (s0 * s1))) / {det} / s1"
    return k0, k1


K0, K1 = solve2_sql("10e0")
HELD = "held AS (SELECT unnest([0, 1, 2, 3]) AS held_out), train AS (SELECT h.held_out, p.* FROM poly p JOIN held h ON p.track_id <> h.held_out)"
RIDGE_SQL = POLY_SQL + ", " + HELD + moments_sql("mom", "train", "held_out", ["f2", "f3"], "y") + f""", fit AS (SELECT held_out, n, my, m0, m1, {K0} AS k0, {K1} AS k1 FROM mom),
coefs AS (SELECT held_out, 'free' AS intercept_rule, my - k0 * m0 - k1 * m1 AS b0, k0, k1 FROM fit UNION ALL
  SELECT held_out, 'penalised', n * my / (n + 10e0) - k0 * m0 - k1 * m1, k0, k1 FROM fit)"""


def two_feature_models(t):
    rows = poly_rows(t).select("track_id", "f2", "f3", "y")
    c = R.feature_centres(rows, ["f2", "f3"])
    train = R.leave_one_out(R.moments(rows, ["track_id"], ["f2", "f3"], "y", c), "track_id")
    specs = R.with_specs(train, [{"spec_id": "both", "use": [0, 1], "alpha": 10.0}])
    free = R.ridge_models(specs, 2, c, False).withColumn("intercept_rule", F.lit("free"))
    pen = R.ridge_models(specs, 2, c, True, 1e-8).withColumn("intercept_rule", F.lit("penalised"))
    return rows, free.unionByName(pen)


@query("ridge_fit", RIDGE_SQL + "SELECT * FROM coefs", "b0 k0 k1")
def ridge_fit(t):
    """M2/M3: both ridge conventions per held-out track."""
    _, models = two_feature_models(t)
    b = F.col("beta")
    return models.select("held_out", "intercept_rule", b[0].alias("b0"), b[1].alias("k0"), b[2].alias("k1"))


@query("ridge_loto", RIDGE_SQL + """, scored AS (SELECT intercept_rule, CAST(track_id AS VARCHAR) AS scope, y, b0 + k0 * f2 + k1 * f3 AS p FROM poly JOIN coefs ON track_id = held_out),
both_scopes AS (SELECT * FROM scored UNION ALL SELECT intercept_rule, 'aggregate', y, p FROM scored)""" + bundle_sql("both_scopes", "intercept_rule, scope") + "SELECT * FROM bundle", BUNDLE)
def ridge_loto(t):
    """M2/M3/M4: out-of-fold metrics over all rows and per track."""
    rows, models = two_feature_models(t)
    scored = R.score_held_out(rows, models.drop("use", "alpha", "complexity", "spec_id"), "track_id", ["f2", "f3"])
    return M.error_bundle(M.with_scopes(scored, "track_id"), ["intercept_rule", "scope"], "y", "p")


GRID = [{"spec_id": f"poly_degree_{g}_ridge_{a:g}", "use": list(range(g)), "alpha": a, "complexity": g}
        for g in (1, 2, 3) for a in RIDGE_ALPHAS]
GRID_SQL = ", ".join(f"('{s['spec_id']}', {s['complexity']}, {s['alpha']}e0)" for s in GRID)
C3 = solve3_sql(["degree >= 1", "degree >= 2", "degree >= 3"], "alpha")
NESTED_SQL = POLY_SQL + """, tracks AS (SELECT unnest([0, 1, 2, 3]) AS h), pairs AS (SELECT a.h AS outer_, b.h AS inner_ FROM tracks a JOIN tracks b ON a.h <> b.h),
train AS (SELECT outer_, inner_, p.* FROM poly p JOIN pairs ON p.track_id <> outer_ AND p.track_id <> inner_)""" + moments_sql("mom", "train", "outer_, inner_", POLY, "y") + f""",
grid(spec_id, degree, alpha) AS (VALUES {GRID_SQL}),
fit AS (SELECT outer_, inner_, spec_id, degree, alpha, n * my / (n + alpha) AS a0, m0, m1, m2, {C3[0]} AS k0, {C3[1]} AS k1, {C3[2]} AS k2 FROM mom CROSS JOIN grid),
inner_scores AS (SELECT outer_, inner_, spec_id, degree, alpha, avg(abs(a0 + k0 * (x1 - m0) + k1 * (x2 - m1) + k2 * (x3 - m2) - y)) AS mae FROM fit JOIN poly ON track_id = inner_ GROUP BY 1, 2, 3, 4, 5),
mean_scores AS (SELECT outer_, spec_id, degree, alpha, avg(mae) AS inner_mae FROM inner_scores GROUP BY 1, 2, 3, 4)"""


@query("nested_selection", NESTED_SQL + """SELECT outer_ AS held_out, spec_id, inner_mae FROM (SELECT *, row_number() OVER (PARTITION BY outer_ ORDER BY inner_mae, degree, alpha) AS rn FROM mean_scores) WHERE rn = 1""", "inner_mae")
def nested_selection(t):
    """Nested whole-track choice of degree and penalty."""
    chosen, _ = R.nested_choice(poly_rows(t), "track_id", POLY, "y", GRID)
    return chosen


@query("nested_scores", NESTED_SQL + "SELECT outer_ AS held_out, spec_id, alpha, degree AS complexity, inner_mae FROM mean_scores", "alpha inner_mae")
def nested_scores(t):
    """M4: inner score of every candidate."""
    _, scores = R.nested_choice(poly_rows(t), "track_id", POLY, "y", GRID)
    return scores.withColumnRenamed("outer", "held_out")


@query("alpha_lock", NESTED_SQL + """SELECT outer_ AS held_out, 'low' AS rule, min_by(alpha, (round(inner_mae, 4), alpha)) AS alpha FROM mean_scores WHERE degree = 1 GROUP BY 1
UNION ALL SELECT outer_, 'high', min_by(alpha, (round(inner_mae, 4), -alpha)) FROM mean_scores WHERE degree = 1 GROUP BY 1""", "alpha")
def alpha_lock(t):
    """Smallest penalty on ties when selecting, largest when locking (four decimals)."""
    _, scores = R.nested_choice(poly_rows(t), "track_id", POLY, "y", GRID)
    rows = scores.where("complexity = 1").withColumn("r", F.round("inner_mae", 4))
    low = F.min(F.struct("r", "alpha"))["alpha"]
    high = -F.min(F.struct("r", (-F.col("alpha")).alias("alpha")))["alpha"]
    picks = rows.groupBy(F.col("outer").alias("held_out")).agg(low.alias("low"), high.alias("high"))
    return picks.unpivot(["held_out"], ["low", "high"], "rule", "alpha")


# Families over one joint pass: features are x, x^2, f2, f3.
JOINT = ["x1", "x2", "f2", "f3"]
FAMILIES = [{"spec_id": "training_mean", "use": []}, {"spec_id": "x_only", "use": [0, 1], "alpha": 1.0},
            {"spec_id": "summary_ridge", "use": [2, 3], "alpha": 10.0}, {"spec_id": "summary_plus_x", "use": [0, 2, 3], "alpha": 10.0}]


def family_models(rows):
    c = R.feature_centres(rows, JOINT)
    train = R.leave_one_out(R.moments(rows, ["track_id"], JOINT, "y", c), "track_id")
    return R.ridge_models(R.with_specs(train, FAMILIES), 4, c, True, 1e-8)


def family_fit_sql(name: str, names: list[str], alpha: float) -> str:
    return moments_sql(f"mom_{name}", "train", "policy, held_out", names, "y")


FX0, FX1 = solve2_sql("1e0")
FS0, FS1 = solve2_sql("10e0")
FP = solve3_sql(["true", "true", "true"], "10e0")
FAMILY_SQL = POLY_SQL + """, policies AS (SELECT 'all_rows' AS policy, * FROM poly UNION ALL SELECT 'taxed_rows', * FROM poly WHERE f3 >= 0.03e0),
held AS (SELECT unnest([0, 1, 2, 3]) AS held_out), train AS (SELECT h.held_out, p.* FROM policies p JOIN held h ON p.track_id <> h.held_out)""" + family_fit_sql("x", ["x1", "x2"], 1) + family_fit_sql("s", ["f2", "f3"], 10) + family_fit_sql("p", ["x1", "f2", "f3"], 10) + f""",
fx AS (SELECT policy, held_out, n * my / (n + 1e0) AS a0, m0, m1, {FX0} AS k0, {FX1} AS k1 FROM mom_x), fs AS (SELECT policy, held_out, n * my / (n + 10e0) AS a0, m0, m1, {FS0} AS k0, {FS1} AS k1 FROM mom_s),
fp AS (SELECT policy, held_out, n * my / (n + 10e0) AS a0, m0, m1, m2, {FP[0]} AS k0, {FP[1]} AS k1, {FP[2]} AS k2 FROM mom_p),
oof AS (SELECT p.policy, track_id, 'training_mean' AS spec_id, y, my AS p FROM policies p JOIN mom_x m ON p.policy = m.policy AND track_id = held_out UNION ALL
  SELECT p.policy, track_id, 'x_only', y, a0 + k0 * (x1 - m0) + k1 * (x2 - m1) FROM policies p JOIN fx m ON p.policy = m.policy AND track_id = held_out UNION ALL
  SELECT p.policy, track_id, 'summary_ridge', y, a0 + k0 * (f2 - m0) + k1 * (f3 - m1) FROM policies p JOIN fs m ON p.policy = m.policy AND track_id = held_out UNION ALL
  SELECT p.policy, track_id, 'summary_plus_x', y, a0 + k0 * (x1 - m0) + k1 * (f2 - m1) + k2 * (f3 - m2) FROM policies p JOIN fp m ON p.policy = m.policy AND track_id = held_out)"""


@query("family_grid", FAMILY_SQL + "SELECT policy, spec_id, track_id, count(*) AS n, avg(abs(p - y)) AS mae, sqrt(avg((p - y) * (p - y))) AS rmse, avg(p - y) AS signed_bias FROM oof GROUP BY 1, 2, 3", "mae rmse signed_bias")
def family_grid(t):
    """Families by policies by folds from one moment pass each."""
    rows = poly_rows(t)
    out = None
    for policy, part in (("all_rows", rows), ("taxed_rows", rows.where(F.col("f3") >= d(0.03)))):
        scored = R.score_held_out(part, family_models(part), "track_id", JOINT).withColumn("policy", F.lit(policy))
        out = scored if out is None else out.unionByName(scored)
    e = F.col("p") - F.col("y")
    return out.groupBy("policy", "spec_id", "track_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("signed_bias"))


RB0, RB1 = solve2_sql("1e0")
RC0, RC1 = solve2_sql("10e0")
RESIDUAL_SQL = POLY_SQL + ", " + HELD + moments_sql("mb", "train", "held_out", ["x1", "x2"], "y") + f""", base AS (SELECT held_out, n * my / (n + 1e0) - m0 * ({RB0}) - m1 * ({RB1}) AS b0, {RB0} AS b1, {RB1} AS b2 FROM mb),
resid AS (SELECT t.held_out, f2, f3, y - (b0 + b1 * x1 + b2 * x2) AS r FROM train t JOIN base b ON t.held_out = b.held_out)""" + moments_sql("mr", "resid", "held_out", ["f2", "f3"], "r") + f""",
corr_ AS (SELECT held_out, n * my / (n + 10e0) - m0 * ({RC0}) - m1 * ({RC1}) AS c0, {RC0} AS c1, {RC1} AS c2 FROM mr),
scored AS (SELECT track_id, y, b0 + b1 * x1 + b2 * x2 AS base_p, c0 + c1 * f2 + c2 * f3 AS correction FROM poly JOIN base b ON track_id = b.held_out JOIN corr_ c ON track_id = c.held_out)"""


@query("residual_model", RESIDUAL_SQL + """SELECT track_id, avg(abs(base_p - y)) AS base_mae, avg(abs(base_p + correction - y)) AS combined_mae, avg(abs(correction)) AS mean_correction,
  avg(CASE WHEN abs(correction) > 0.001e0 THEN 1e0 ELSE 0e0 END) AS moved_fraction, 1 - sum(power(y - base_p - correction, 2)) / sum(power(y - base_p, 2)) AS variance_explained FROM scored GROUP BY 1""",
       "base_mae combined_mae mean_correction moved_fraction variance_explained")
def residual_model(t):
    """M5: baseline on x, ridge of the residual, both from one pass."""
    rows = poly_rows(t)
    c = R.feature_centres(rows, JOINT)
    train = R.leave_one_out(R.moments(rows, ["track_id"], JOINT, "y", c), "track_id")
    models = R.residual_models(R.with_specs(train, [{"spec_id": "residual", "use": [2, 3], "alpha": 10.0}]), 4, c, [0, 1], 1.0)
    scored = R.score_held_out(rows, models.drop("use", "alpha", "complexity"), "track_id", JOINT).withColumn("b", R.linear("base_beta", JOINT))
    corr, y = F.col("p") - F.col("b"), F.col("y")
    return scored.groupBy("track_id").agg(
        F.avg(F.abs(F.col("b") - y)).alias("base_mae"), F.avg(F.abs(F.col("p") - y)).alias("combined_mae"),
        F.avg(F.abs(corr)).alias("mean_correction"), F.avg((F.abs(corr) > d(0.001)).cast("double")).alias("moved_fraction"),
        (1 - F.sum((y - F.col("p")) ** 2) / F.sum((y - F.col("b")) ** 2)).alias("variance_explained"))


@query("lag_diagnostic", X.with_sql(X.POSITIONS, """lagged AS (SELECT l.lag, a.track_id, a.y, b.y AS f FROM positions a CROSS JOIN (SELECT unnest(range(-5, 6)) AS lag) l JOIN positions b ON b.track_id = a.track_id AND b.seg = a.seg + l.lag WHERE l.lag <> 0),
held AS (SELECT unnest([0, 1, 2, 3]) AS held_out), fit AS (SELECT lag, held_out, CAST(count(*) AS DOUBLE) AS n, avg(y) AS my, avg(f) AS mf, stddev_pop(f) AS s, covar_pop(f, y) AS c FROM lagged JOIN held ON track_id <> held_out GROUP BY 1, 2)""") +
       """SELECT l.lag, track_id, count(*) AS n, avg(abs(n * my / (n + 10e0) + n * c / s / (n + 10e0) * (f - mf) / s - y)) AS mae FROM lagged l JOIN fit ON l.lag = fit.lag AND track_id = held_out GROUP BY 1, 2""", "mae")
def lag_diagnostic(t):
    """Symmetric lag models per held-out track, one pass over the lag panel."""
    panel = J.lag_panel(X.positions(t), ["track_id"], "seg", "y", [v for v in range(-5, 6) if v])
    panel = materialize(panel.select("lag", "track_id", "y", "shifted"))
    c = R.feature_centres(panel, ["shifted"])
    per = R.moments(panel, ["lag", "track_id"], ["shifted"], "y", c)
    cols = [k for k in per.columns if k.startswith("_m")]
    total = per.groupBy("lag").agg(*[F.sum(k).alias("t" + k) for k in cols])
    train = per.join(total, "lag").select("lag", F.col("track_id"), *[(F.col("t" + k) - F.col(k)).alias(k) for k in cols])
    models = R.ridge_models(R.with_specs(train, [{"spec_id": "lag", "use": [0], "alpha": 10.0}]), 1, c, True, 1e-8)
    scored = attach(panel, models.select("lag", "track_id", "beta"), ["lag", "track_id"], "inner").withColumn("p", R.linear("beta", ["shifted"]))
    return scored.groupBy("lag", "track_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("p") - F.col("y"))).alias("mae"))


@query("feature_scaler", X.with_sql(X.POSITIONS) + """, wide AS (SELECT e.user_id % 4 AS g, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS v, CAST(user_id AS DOUBLE) AS u, 1e0 AS one FROM events e),
held AS (SELECT unnest([0, 1, 2, 3]) AS held_out), long AS (SELECT held_out, 'v' AS feature, v AS x FROM wide JOIN held ON g <> held_out UNION ALL SELECT held_out, 'u', u FROM wide JOIN held ON g <> held_out UNION ALL SELECT held_out, 'one', one FROM wide JOIN held ON g <> held_out),
med AS (SELECT held_out, feature, median(x) AS median FROM long GROUP BY 1, 2)
SELECT l.held_out, l.feature, any_value(median) AS median, avg(coalesce(x, median)) AS mean, CASE WHEN stddev_pop(coalesce(x, median)) < 1e-12 THEN 1e0 ELSE stddev_pop(coalesce(x, median)) END AS scale
FROM long l JOIN med m ON l.held_out = m.held_out AND l.feature = m.feature GROUP BY 1, 2""", "median mean scale")
def feature_scaler(t):
    """Medians, means and floored scales per training fold."""
    wide = t.events.select((F.col("user_id") % 4).cast("int").alias("g"), F.when(F.col("event_type") != "error", F.col("value")).alias("v"),
                           F.col("user_id").cast("double").alias("u"), F.lit(1.0).alias("one"))
    return R.scaler(L.training_folds(wide, "g", L.tracks_of(wide, "g")), ["held_out"], ["v", "u", "one"], 1e-12)


@query("frozen_scoring", X.with_sql(X.POSITIONS, """s AS (SELECT avg(value) AS m, stddev_pop(value) AS sd, median(value) AS med FROM events)""") + """
SELECT model_id, count(*) AS n, avg(p) AS mean_p, avg(abs(p - y)) AS mae FROM (
  SELECT 'mean' AS model_id, y, m AS p FROM all_positions, s UNION ALL
  SELECT 'linear', y, m + 2e0 * ((CASE WHEN event_type = 'error' THEN med ELSE y END) - m) / sd FROM all_positions, s) GROUP BY 1""", "mean_p mae")
def frozen_scoring(t):
    """Artifacts with imputation, scaling and a zero-feature model."""
    stats = t.events.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"))
    stats = attach_one(stats, O.quantile_columns(t.events.withColumn("g", F.lit(0)), ["g"], "value", {"med": 0.5}).drop("g"))
    empty, none = F.array().cast("array<double>"), F.array().cast("array<string>")
    linear = F.struct(F.lit("linear").alias("model_id"), F.col("m").alias("intercept"), F.array(F.lit("v")).alias("feature_names"), F.array("med").alias("medians"),
                      F.array("m").alias("means"), F.array("sd").alias("scales"), F.array(d(2)).alias("coefficients"))
    mean = F.struct(F.lit("mean").alias("model_id"), F.col("m").alias("intercept"), none.alias("feature_names"), empty.alias("medians"),
                    empty.alias("means"), empty.alias("scales"), empty.alias("coefficients"))
    cohorts = t.events.select((F.col("user_id") % 4).cast("int").alias("cohort")).distinct()
    artifacts = attach_one(cohorts, stats).select("cohort", F.explode(F.array(linear, mean)).alias("x")).select("cohort", "x.*")
    rows = X.all_positions(t).select("y", F.col("track_id").alias("cohort"), F.create_map(
        F.lit("v"), F.when(F.col("event_type") != "error", F.col("y"))).alias("features"))
    return R.score_artifacts(rows, artifacts, "cohort").groupBy("model_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg(F.abs(F.col("p") - F.col("y"))).alias("mae"))


@query("human_reference_errors", X.with_sql(X.PREDICTIONS) + """SELECT model_id, count(*) AS n, avg(abs(p - o_totalprice / 5000e0)) AS reference_mae, avg(p - o_totalprice / 5000e0) AS reference_bias
FROM predictions JOIN orders ON seg = o_orderkey AND track_id = o_custkey % 4 GROUP BY 1""", "reference_mae reference_bias")
def human_reference_errors(t):
    """Predictor errors against an outside reference where one exists."""
    ref = t.orders.select(F.col("o_orderkey").alias("seg"), (F.col("o_custkey") % 4).cast("int").alias("track_id"), (F.col("o_totalprice") / d(5000)).alias("ref"))
    e = F.col("p") - F.col("ref")
    return X.predictions(t).join(ref, ["seg", "track_id"]).groupBy("model_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("reference_mae"), F.avg(e).alias("reference_bias"))


@query("representation_manifest", """WITH f AS (SELECT vec_id AS frame, CAST(label % 3 AS INT) AS track_id, coalesce(lag(vec_id) OVER (PARTITION BY label % 3 ORDER BY vec_id), vec_id) AS prev FROM embeddings)
SELECT frame, track_id, representation_id, size, context, CASE WHEN size = 128 THEN prev || ';' || frame ELSE CAST(frame AS VARCHAR) END AS context_frames FROM f CROSS JOIN
  (VALUES ('current_absolute', 64, 'current_only'), ('current_background_subtracted', 64, 'current_only'), ('causal_context_prev1', 128, 'current_and_preceding_only')) r(representation_id, size, context)""")
def representation_manifest(t):
    """One provenance row per frame and representation."""
    rows = O.dense_index(vectors(t).select("vec_id", "track_id"), ["track_id"], ["vec_id"], "idx").join(
        vectors(t).select("vec_id", "embedding"), "vec_id").select("vec_id", "track_id", "idx", "embedding")
    prev = rows.select("track_id", (F.col("idx") + 1).alias("idx"), F.col("vec_id").alias("prev_id"), F.col("embedding").alias("prev_embedding"))
    rows = rows.join(prev, ["track_id", "idx"], "left")
    e = F.col("embedding")
    parts = {"current_absolute": (e, "current_only"),
             "current_background_subtracted": (F.transform(e, lambda v: v - F.array_min(e)), "current_only"),
             "causal_context_prev1": (F.concat(F.coalesce("prev_embedding", e), e), "current_and_preceding_only")}
    out = R.representation_catalogue(rows, parts)
    used = F.when(F.col("context") == "current_only", F.col("vec_id").cast("string")).otherwise(
        F.concat_ws(";", F.coalesce("prev_id", "vec_id").cast("string"), F.col("vec_id").cast("string")))
    return out.select(F.col("vec_id").alias("frame"), "track_id", "representation_id", "size", "context", used.alias("context_frames"))


CATALOGUE_SQL = X.with_sql(X.CELLS, """
fp AS (SELECT frame, quantile_cont(v, 0.05) AS p05, quantile_cont(v, 0.10) AS p10, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.9) AS p90, quantile_cont(v, 0.95) AS p95, quantile_cont(v, 0.97) AS p97, quantile_cont(v, 0.99) AS p99 FROM cells GROUP BY 1),
c AS (SELECT c.*, p05, p10, p50, p90, p95, p97, p99, (v - p50) / (p95 - p05 + 1e-6) AS s, greatest(v - p10, 0e0) AS e, CASE WHEN v >= p95 THEN greatest(v - p95, 0e0) + 1e-12 ELSE 0e0 END AS h, CASE WHEN v >= p95 THEN greatest(v - p10, 0e0) ELSE 0e0 END AS w,
  v - lag(v) OVER (PARTITION BY c.frame, r ORDER BY c) AS gx, v - lag(v) OVER (PARTITION BY c.frame, c ORDER BY r) AS gy FROM cells c JOIN fp USING (frame)),
hot AS (SELECT frame, CAST(round_even(sum(h * c) / sum(h), 0) AS INT) - 2 AS x0, CAST(round_even(sum(h * r) / sum(h), 0) AS INT) - 2 AS y0, sum(w * c) / sum(w) AS mx, sum(w * r) / sum(w) AS my FROM c GROUP BY 1),
roi AS (SELECT frame, sum(v) AS a, sum(s) AS r FROM c JOIN hot USING (frame) WHERE r >= y0 AND r < y0 + 4 AND c >= x0 AND c < x0 + 4 GROUP BY 1),
m AS (SELECT frame, any_value(mx) AS mx, any_value(my) AS my, sum(w * (c - mx) * (c - mx)) / sum(w) AS xx, sum(w * (r - my) * (r - my)) / sum(w) AS yy, sum(w * (c - mx) * (r - my)) / sum(w) AS xy,
  avg(CASE WHEN v >= p90 THEN 1e0 ELSE 0e0 END) + avg(CASE WHEN v >= p95 THEN 1e0 ELSE 0e0 END) + avg(CASE WHEN v >= p97 THEN 1e0 ELSE 0e0 END) + avg(CASE WHEN v >= p99 THEN 1e0 ELSE 0e0 END) AS f, count(*) FILTER (WHERE v >= p95) AS n,
  max(v) - max(p10) + avg(e) + avg(abs(gx)) + avg(abs(gy)) + avg(v) FILTER (WHERE c < 4) - avg(v) FILTER (WHERE c >= 4) + avg(v) FILTER (WHERE r < 4) - avg(v) FILTER (WHERE r >= 4) AS rest FROM c JOIN hot USING (frame) GROUP BY 1),
g AS (SELECT *, (xx + yy) / 2 + sqrt(power((xx - yy) / 2, 2) + xy * xy) AS e1, (xx + yy) / 2 - sqrt(power((xx - yy) / 2, 2) + xy * xy) AS e2 FROM m),
sums AS (SELECT frame, any_value(track_id) AS track_id, sum(v) AS a, sum(v - p10) AS b, sum(s) AS s FROM c GROUP BY 1),
o AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY frame) - 1 AS idx FROM sums),
ctx AS (SELECT k, o.frame, o.track_id, any_value(o.s) AS s, avg(coalesce(p.s, o.s)) AS mean, max(CASE WHEN j = k THEN coalesce(p.s, o.s) END) AS oldest, max(CASE WHEN p.frame IS NULL THEN 1e0 ELSE 0e0 END) AS gap,
  string_agg(CAST(coalesce(p.frame, o.frame) AS VARCHAR), ';' ORDER BY j DESC) AS used FROM o CROSS JOIN (VALUES (1), (2), (4)) t(k) CROSS JOIN range(0, 5) u(j) LEFT JOIN o p ON p.track_id = o.track_id AND p.idx = o.idx - j WHERE j <= k GROUP BY 1, 2, 3)""") + """
SELECT frame, track_id, 'current_absolute' AS representation_id, 64 AS size, 'current_only' AS context, CAST(frame AS VARCHAR) AS context_frames, 'none' AS normalization_id, a AS total FROM sums
UNION ALL SELECT frame, track_id, 'current_background_subtracted', 64, 'current_only', CAST(frame AS VARCHAR), 'sample_local_p10_background', b FROM sums
UNION ALL SELECT frame, track_id, 'current_robust_scaled', 64, 'current_only', CAST(frame AS VARCHAR), 'sample_local_robust_p05_p50_p95', s FROM sums
UNION ALL SELECT frame, track_id, 'hotspot_centered_absolute', 16, 'current_only', CAST(frame AS VARCHAR), 'none', r.a FROM roi r JOIN sums USING (frame)
UNION ALL SELECT frame, track_id, 'hotspot_centered_relative', 16, 'current_only', CAST(frame AS VARCHAR), 'sample_local_robust_p05_p50_p95', r.r FROM roi r JOIN sums USING (frame)
UNION ALL SELECT frame, track_id, 'thermal_shape_features', 19, 'current_only', CAST(frame AS VARCHAR), 'none', f + 2 * sqrt(n / pi()) / 8e0 + 2 * sqrt(greatest(e1, 0e0)) / 8e0 + 2 * sqrt(greatest(e2, 0e0)) / 8e0
  + 2 * sqrt(greatest(e1, 0e0)) / greatest(2 * sqrt(greatest(e2, 0e0)), 1e-9) + mx / 7e0 + my / 7e0 + e1 / 64e0 + e2 / 64e0 + rest FROM g JOIN sums USING (frame)
UNION ALL SELECT frame, track_id, 'causal_context_prev' || k, 193, 'current_and_preceding_only', used, 'sample_local_robust_p05_p50_p95', s + mean + s - oldest + gap FROM ctx"""


def catalogue(t):
    """Every frame with its nine representations."""
    places = O.dense_index(X.frames(t).select("track_id", "frame"), ["track_id"], ["frame"], "idx").select("frame", "idx")
    rows = X.frames(t).join(places, "frame")
    return FR.representations(rows, "track_id", "idx", "frame", "embedding", 8, 8, 8, 4)


@query("representation_catalogue", CATALOGUE_SQL, "total", 5)
def representation_catalogue(t):
    """Nine representations of each frame with their provenance, contents checked by their sums."""
    return FR.manifest(catalogue(t), ["frame", "track_id"], "frame")


@query("representation_residuals")
def representation_residuals(t):
    """The residual grid over all nine representations, locked choices on all and on later frames."""
    rows = catalogue(t)
    x, e = d(20) + (F.col("idx") + d(0.5)) * d(0.2), F.col("current_absolute")
    target = F.aggregate(F.transform(e, lambda v, i: v * v * (i % 8)), d(0), lambda a, v: a + v) + x / 50
    powers = F.array(x, x * x, x * x * x)
    chosen, table = residual_results(rows.withColumns({"powers": powers, "y": target}), {"all_rows": F.lit(True), "later_rows": F.col("idx") >= 20},
                                     list(FR.REPRESENTATIONS), RIDGE_ALPHAS)
    return table.join(chosen, "held_out")


def vectors(t):
    return t.embeddings.select("vec_id", (F.col("label") % 3).cast("int").alias("track_id"), "embedding")


@query("pca_scores")
def pca_scores(t):
    """Two principal scores of the standardised vectors."""
    rows = attach_one(vectors(t), R.pca(vectors(t), "track_id", "embedding", 2))
    s = F.col("scores")
    return R.project(rows, "embedding").select("vec_id", "track_id", s[0].alias("pc1"), s[1].alias("pc2"))


@query("pca_total_variance", """WITH v AS (SELECT i, stddev_pop(CAST(embedding[i] AS DOUBLE)) AS s FROM embeddings, range(1, 65) t(i) GROUP BY 1)
SELECT CAST(count(*) AS INT) AS components, CAST(sum(CASE WHEN s < 1e-8 THEN 0 ELSE 1 END) AS DOUBLE) AS total_variance FROM v""", "total_variance")
def pca_total_variance(t):
    """The variances of all components add up to the number of varying entries."""
    axes = R.pca(vectors(t), "track_id", "embedding", 64)
    return axes.select(F.size("variances").alias("components"), F.aggregate("variances", d(0), lambda a, v: a + v).alias("total_variance"))


@query("pca_held_out")
def pca_held_out(t):
    """Ten components of the training tracks, spread of the held-out projections."""
    axes = R.pca_leave_one_out(vectors(t), "track_id", "embedding", 10).withColumnRenamed("held_out", "track_id")
    rows = R.project(attach(vectors(t), axes, ["track_id"]), "embedding")
    return rows.select("track_id", F.posexplode("scores").alias("component", "s")).groupBy("track_id", "component").agg(
        F.avg("s").alias("mean_score"), F.stddev_pop("s").alias("score_std"))


@query("profile_components")
def profile_components(t):
    """Three functional components of profiles resampled to 16 points on [0, 1]."""
    step = F.sequence(F.lit(0), F.lit(15))
    at = F.transform(step, lambda k: k * d(63.0 / 15.0))
    e = F.col("embedding")
    line = F.transform(at, lambda u: F.get(e, F.floor(u).cast("int")).cast("double") * (1 - (u - F.floor(u)))
                       + F.coalesce(F.get(e, F.floor(u).cast("int") + 1).cast("double"), d(0)) * (u - F.floor(u)))
    rows = vectors(t).select("vec_id", "track_id", line.alias("line"))
    axes = R.pca(rows, "track_id", "line", 3)
    s = F.col("scores")
    return R.project(attach_one(rows, axes), "line").select("vec_id", s[0].alias("c1"), s[1].alias("c2"), s[2].alias("c3"))


@query("quantile_fit")
def quantile_fit(t):
    """M8: five linear quantile models with an L1 penalty."""
    rows = X.regression_rows(t).select("f1", "f2", "f3", "y")
    fit = R.quantile_fit(rows, ["f1", "f2", "f3"], "y", S.QUANTILES, 0.01)
    b = F.col("coefficients")
    return fit.select("quantile", "intercept", b[0].alias("b1"), b[1].alias("b2"), b[2].alias("b3"), "loss")


@query("anchored_quantiles")
def anchored_quantiles(t):
    """M9: anchor ratio times a feature plus residual quantile models, inflated and scored."""
    rows = X.regression_rows(t).select("track_id", "f1", "f2", "f3", "y")
    k = M.choose_anchor(M.anchor_ratios(rows, "track_id", "y", ["f1"])).select("k_star")
    rows = materialize(attach_one(rows, k).withColumn("anchor", F.col("k_star") * F.col("f1")).withColumn("res", F.col("y") - F.col("anchor")))
    names = ["q05", "q25", "q50", "q75", "q95"]
    fit = R.quantile_fit(rows, ["f2", "f3"], "res", S.QUANTILES, 0.01)
    q = R.quantile_predict(rows, fit, ["f2", "f3"], names, F.col("anchor"))
    level = M.level_uncertainty(q.withColumn("m", F.lit(0)), ["m"], "track_id", "y", "q50").select("level_uncertainty")
    wide = M.inflate_quantiles(attach_one(q, level), names, F.col("level_uncertainty"))
    return M.quantile_scores(wide, ["track_id"], "y", names)


# Vectors with principal components: one moment pass serves every fold, component count and penalty.
PAIR_ALPHAS = (1.0, 100.0, 1e4, 1e5)
PAIR_FAMILIES = [N.Family("pca", (1, 2)), N.Family("pca_plus_scalar", (1, 2), True, "pca"), N.Family("scalar", None, True)]
_G = "(c02 / (s0 * s2) + sg * c12 / (s1 * s2)) / sqrt(2e0)"
_U = "(cy0 / s0 + sg * cy1 / s1) / sqrt(2e0)"
_L = "(n * (1e0 + abs(c01) / (s0 * s1)) + alpha)"
_DET = f"({_L} * (n + alpha) - n * {_G} * n * {_G})"
_T = f"((n * {_U} * (n + alpha) - n * {_G} * n * cy2 / s2) / {_DET})"
P0, P1 = solve2_sql("alpha")
Q3 = solve3_sql(["true", "true", "true"], "alpha")
#: Family, components, and the raw coefficients; the first axis of two values is (1, sign of their covariance).
PAIR_FITS = [
    ("pca", 1, f"n * {_U} / {_L} / sqrt(2e0) / s0", f"sg * n * {_U} / {_L} / sqrt(2e0) / s1", "0e0"), ("pca", 2, P0, P1, "0e0"),
    ("pca_plus_scalar", 1, f"{_T} / sqrt(2e0) / s0", f"sg * {_T} / sqrt(2e0) / s1", f"({_L} * n * cy2 / s2 - n * {_G} * n * {_U}) / {_DET} / s2"),
    ("pca_plus_scalar", 2, *Q3), ("scalar", 0, "0e0", "0e0", "n * cy2 / s2 / (n + alpha) / s2")]
PAIR_SQL = X.with_sql(X.REGRESSION, """policies AS (SELECT 'all_rows' AS policy, * FROM regression_rows UNION ALL SELECT 'taxed_rows', * FROM regression_rows WHERE f3 >= 0.03e0),
tracks AS (SELECT DISTINCT track_id AS h FROM regression_rows),
folds AS (SELECT policy, a.h AS outer_, b.h AS inner_ FROM (VALUES ('all_rows'), ('taxed_rows')) v(policy), tracks a, tracks b),
train AS (SELECT f.policy, outer_, inner_, f1, f2, f3, y FROM policies p JOIN folds f ON p.policy = f.policy AND track_id <> outer_ AND track_id <> inner_)""") + moments_sql(
    "mom", "train", "policy, outer_, inner_", ["f1", "f2", "f3"], "y") + f""",
grid AS (SELECT *, CASE WHEN c01 >= 0 THEN 1e0 ELSE -1e0 END AS sg FROM mom, (VALUES {", ".join(f"({a!r}::DOUBLE)" for a in PAIR_ALPHAS)}) g(alpha)),
raw_fits AS ({" UNION ALL ".join(f"SELECT policy, outer_, inner_, '{f}' AS family, {c} AS components, alpha, my, m0, m1, m2, {k0} AS k0, {k1} AS k1, {k2} AS k2 FROM grid" for f, c, k0, k1, k2 in PAIR_FITS)}),
fits AS (SELECT *, my - k0 * m0 - k1 * m1 - k2 * m2 AS a0 FROM raw_fits),
inner_mae AS (SELECT outer_, inner_, family, components, alpha, avg(abs(a0 + k0 * f1 + k1 * f2 + k2 * f3 - y)) AS mae FROM fits JOIN regression_rows ON track_id = inner_
  WHERE policy = 'all_rows' AND outer_ <> inner_ GROUP BY 1, 2, 3, 4, 5),
candidates AS (SELECT outer_, family, components, alpha, avg(mae) AS inner_mae FROM inner_mae GROUP BY 1, 2, 3, 4),
chosen AS (SELECT * FROM candidates QUALIFY row_number() OVER (PARTITION BY outer_, family ORDER BY inner_mae, components, alpha) = 1),
"""


def pair_rows(t):
    return X.regression_rows(t).select("track_id", F.array("f1", "f2").alias("vector"), F.array("f3").alias("extra"), "f3", "y")


def pair_scores(t):
    return N.inner_scores(pair_rows(t), "track_id", "vector", "extra", "y", PAIR_FAMILIES, PAIR_ALPHAS)


@query("nested_pair_scores", PAIR_SQL.rstrip().rstrip(",") + " SELECT outer_ AS held_out, family, components, alpha, inner_mae FROM candidates", "alpha inner_mae")
def nested_pair_scores(t):
    """M4/M7: inner score of every component count and penalty on two-value vectors, alone and with a scalar."""
    return pair_scores(t)


@query("nested_pair_selection", PAIR_SQL + """scored AS (SELECT p.policy, p.track_id, c.family, y, a0 + k0 * f1 + k1 * f2 + k2 * f3 AS p FROM policies p JOIN chosen c ON c.outer_ = p.track_id
  JOIN fits f ON f.policy = p.policy AND f.outer_ = p.track_id AND f.inner_ = p.track_id AND f.family = c.family AND f.components = c.components AND f.alpha = c.alpha),
errors AS (SELECT policy, track_id, family, count(*) AS n, avg(abs(p - y)) AS mae, sqrt(avg((p - y) * (p - y))) AS rmse, avg(p - y) AS signed_bias FROM scored GROUP BY 1, 2, 3)
SELECT e.policy, e.track_id AS held_out, e.family, c.components, c.alpha, c.inner_mae, e.n, e.mae, e.rmse, e.signed_bias, CASE WHEN e.family = 'pca_plus_scalar' THEN 'pca' END AS partner,
  e.mae - q.mae AS change_vs_partner, (e.mae - q.mae) / q.mae AS relative_change_vs_partner
FROM errors e JOIN chosen c ON c.outer_ = e.track_id AND c.family = e.family LEFT JOIN errors q ON e.family = 'pca_plus_scalar' AND q.family = 'pca' AND q.policy = e.policy AND q.track_id = e.track_id""",
       "alpha inner_mae mae rmse signed_bias change_vs_partner relative_change_vs_partner")
def nested_pair_selection(t):
    """Choice on all rows, locked and refitted per policy, scored held out, against the partner family."""
    rows = materialize(pair_rows(t))
    chosen = materialize(N.chosen_specs(N.inner_scores(rows, "track_id", "vector", "extra", "y", PAIR_FAMILIES, PAIR_ALPHAS)))
    out = None
    for policy, part in (("all_rows", rows), ("taxed_rows", rows.where(F.col("f3") >= d(0.03)))):
        scored = N.refit_held_out(part, "track_id", "vector", "extra", "y", PAIR_FAMILIES, chosen).withColumn("policy", F.lit(policy))
        out = scored if out is None else out.unionByName(scored)
    table = N.fold_table(out, ["policy"], "track_id", "y", PAIR_FAMILIES).withColumnRenamed("track_id", "held_out")
    return table.join(chosen, ["held_out", "family"])


VECTOR_ALPHAS = (0.1, 1.0, 10.0, 100.0)
VECTOR_COMPONENTS = (10, 20, 40, 80)
VECTOR_FAMILIES = [
    N.Family("training_mean", None), N.Family("summary_ridge", None, True), N.Family("vector_ridge", ()), N.Family("pca_ridge", VECTOR_COMPONENTS),
    N.Family("vector_plus_summary_ridge", (), True, "vector_ridge"), N.Family("pca_plus_summary_ridge", VECTOR_COMPONENTS, True, "pca_ridge")]


def vector_rows(t):
    e = F.col("embedding")
    total = F.aggregate(e, d(0), lambda a, v: a + v)
    halves = [F.aggregate(F.slice(e, i, 32), d(0), lambda a, v: a + v) for i in (1, 33)]
    squares = F.aggregate(F.transform(e, lambda v, i: v * v * (i % 8)), d(0), lambda a, v: a + v)
    summary = F.array(F.array_max(e).cast("double"), F.array_min(e).cast("double"), total, halves[0] - halves[1])
    return vectors(t).select("vec_id", "track_id", F.transform(e, lambda v: v.cast("double")).alias("vector"), summary.alias("extra"),
                             (squares + total).alias("y"))


@query("nested_vector_selection")
def nested_vector_selection(t):
    """Components and penalty chosen in nested folds on 64-value vectors, refitted and scored held out."""
    rows = materialize(vector_rows(t))
    chosen = materialize(N.chosen_specs(N.inner_scores(rows, "track_id", "vector", "extra", "y", VECTOR_FAMILIES, VECTOR_ALPHAS)))
    scored = N.refit_held_out(rows, "track_id", "vector", "extra", "y", VECTOR_FAMILIES, chosen)
    table = N.fold_table(scored, [], "track_id", "y", VECTOR_FAMILIES).withColumnRenamed("track_id", "held_out")
    return table.join(chosen, ["held_out", "family"])


# Residual grid: the baseline on powers of f1, the representations (f2) and (f2, f3), three alphas.
RES_ALPHAS = (1.0, 100.0, 10000.0)


def base_sql(name: str, source: str, keys: str, grid: str) -> str:
    """Ridges on powers of f1 per ``keys`` and (degree, a) in ``grid``: b0 and k1..k3 with a penalised intercept."""
    k = solve3_sql(["degree >= 1", "degree >= 2", "degree >= 3"], "a")
    return moments_sql(f"{name}_m", source, keys, ["x1", "x2", "x3"], "y") + f""", {name}_k AS (SELECT *, {k[0]} AS k1, {k[1]} AS k2, {k[2]} AS k3 FROM {name}_m JOIN {grid}),
{name} AS (SELECT *, n * my / (n + a) - k1 * m0 - k2 * m1 - k3 * m2 AS b0 FROM {name}_k)"""


def correction_sql(name: str, source: str, keys: str, grid: str) -> str:
    """Ridges of r on f2 (size 1) or f2 and f3 (size 2) per ``keys`` and (size, alpha) in ``grid``."""
    c0, c1 = solve2_sql("alpha")
    return moments_sql(f"{name}_m", source, keys, ["f2", "f3"], "r") + f""", {name}_k AS (SELECT *, CASE WHEN size = 1 THEN n * cy0 / s0 / (n + alpha) / s0 ELSE {c0} END AS c1, CASE WHEN size = 1 THEN 0e0 ELSE {c1} END AS c2 FROM {name}_m JOIN {grid}),
{name} AS (SELECT *, n * my / (n + alpha) - c1 * m0 - c2 * m1 AS c0 FROM {name}_k)"""


_ALPHAS = ", ".join(f"({a!r}::DOUBLE)" for a in RES_ALPHAS)
RES_SQL = POLY_SQL + f""", policies AS (SELECT 'all_rows' AS policy, * FROM poly UNION ALL SELECT 'taxed_rows', * FROM poly WHERE f3 >= 0.03e0),
tr AS (SELECT DISTINCT track_id AS h FROM poly), al(alpha) AS (VALUES {_ALPHAS}), degrees(degree) AS (VALUES (1), (2), (3)), sizes(size) AS (VALUES (1), (2)),
pairs AS (SELECT a.h AS o, b.h AS i FROM tr a JOIN tr b ON a.h <> b.h), train AS (SELECT o, i, p.* FROM poly p JOIN pairs ON track_id <> o AND track_id <> i),
bg AS (SELECT degree, alpha AS a FROM degrees, al)""" + base_sql("xb", "train", "o, i", "bg ON true") + """,
x_mae AS (SELECT o, degree, a, avg(mae) AS mae FROM (SELECT o, i, degree, a, avg(abs(b0 + k1 * x1 + k2 * x2 + k3 * x3 - y)) AS mae FROM xb JOIN poly ON track_id = i GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
x_best AS (SELECT o, degree, a FROM x_mae QUALIFY row_number() OVER (PARTITION BY o ORDER BY mae, degree, a) = 1), one AS (SELECT 2 AS degree, 1e0 AS a)""" + base_sql("ib", "train", "o, i", "one ON true") + """,
ir AS (SELECT t.o, t.i, f2, f3, y - (b0 + k1 * x1 + k2 * x2 + k3 * x3) AS r FROM train t JOIN ib ON t.o = ib.o AND t.i = ib.i), cg AS (SELECT size, alpha FROM sizes, al)""" + correction_sql("ic", "ir", "o, i", "cg ON true") + """,
candidates AS (SELECT o, size, alpha, avg(mae) AS inner_mae FROM (SELECT ic.o, ic.i, size, alpha, avg(abs(b0 + k1 * x1 + k2 * x2 + k3 * x3 + c0 + c1 * f2 + c2 * f3 - y)) AS mae
  FROM ic JOIN ib ON ic.o = ib.o AND ic.i = ib.i JOIN poly ON track_id = ic.i GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
best AS (SELECT c.o, size, alpha, inner_mae, degree, a AS x_alpha FROM candidates c JOIN x_best b ON c.o = b.o QUALIFY row_number() OVER (PARTITION BY c.o ORDER BY inner_mae, size, alpha) = 1),
full_train AS (SELECT h AS o, p.* FROM policies p JOIN tr ON track_id <> h)""" + base_sql("fb", "full_train", "policy, o", "(SELECT o AS bo, degree, x_alpha AS a FROM best) ON o = bo") + """,
fr AS (SELECT t.policy, t.o, f2, f3, y, y - (b0 + k1 * x1 + k2 * x2 + k3 * x3) AS r FROM full_train t JOIN fb ON t.o = fb.o AND t.policy = fb.policy)""" + correction_sql(
    "fc", "fr", "policy, o", "(SELECT o AS bo, size, alpha FROM best) ON o = bo") + correction_sql(
    "ft", "(SELECT policy, o, f2, f3, y AS r FROM fr)", "policy, o", "(SELECT o AS bo, size, alpha FROM best) ON o = bo") + """,
scored AS (SELECT p.policy, track_id, y, b0 + k1 * x1 + k2 * x2 + k3 * x3 AS xp, ft.c0 + ft.c1 * f2 + ft.c2 * f3 AS tp, fc.c0 + fc.c1 * f2 + fc.c2 * f3 AS c
  FROM policies p JOIN fb ON fb.o = track_id AND fb.policy = p.policy JOIN fc ON fc.o = track_id AND fc.policy = p.policy JOIN ft ON ft.o = track_id AND ft.policy = p.policy),
e AS (SELECT policy, track_id, count(*) AS n, avg(abs(xp - y)) AS x_only_mae, avg(abs(tp - y)) AS thermal_only_mae, avg(abs(xp + c - y)) AS combined_mae, sqrt(avg(power(xp + c - y, 2))) AS combined_rmse,
  avg(xp + c - y) AS combined_bias, corr(y - xp, c) AS residual_correlation, 1 - sum(power(y - xp - c, 2)) / greatest(sum(power(y - xp, 2)), 1e-12) AS residual_variance_explained,
  avg(CASE WHEN abs(c) > 0.02e0 THEN 1e0 ELSE 0e0 END) AS above_0p02, avg(CASE WHEN abs(c) > 0.05e0 THEN 1e0 ELSE 0e0 END) AS above_0p05, avg(CASE WHEN abs(c) > 0.10e0 THEN 1e0 ELSE 0e0 END) AS above_0p10 FROM scored GROUP BY 1, 2)"""
RES_OUT = "x_only_mae thermal_only_mae combined_mae combined_rmse combined_bias residual_correlation residual_variance_explained above_0p02 above_0p05 above_0p10 mae_change relative_mae_change"


def residual_rows(t):
    return poly_rows(t).select("track_id", F.array("x1", "x2", "x3").alias("powers"), F.array("f2").alias("one"), F.array("f2", "f3").alias("two"), "f3", "y")


def residual_results(rows, policies, representations, alphas):
    """(choice, errors per policy and held-out track) of the residual grid."""
    rows = materialize(rows)
    chosen, _ = N.residual_choice(rows, "track_id", "y", "powers", representations, alphas)
    out = None
    for policy, keep in policies.items():
        part = N.residual_held_out(rows.where(keep), "track_id", "y", "powers", chosen).withColumn("policy", F.lit(policy))
        out = part if out is None else out.unionByName(part)
    return chosen, N.residual_table(out, ["policy", "track_id"]).withColumnRenamed("track_id", "held_out")


@query("residual_grid", RES_SQL + """SELECT policy, track_id AS held_out, CASE size WHEN 1 THEN 'one' ELSE 'two' END AS representation, alpha, inner_mae, degree, x_alpha, e.* EXCLUDE (policy, track_id),
  combined_mae - x_only_mae AS mae_change, (combined_mae - x_only_mae) / x_only_mae AS relative_mae_change FROM e JOIN best ON o = track_id""", "alpha inner_mae x_alpha " + RES_OUT)
def residual_grid(t):
    """Representation, penalties and degree chosen in nested folds, locked, refitted per policy, three predictions held out."""
    policies = {"all_rows": F.lit(True), "taxed_rows": F.col("f3") >= d(0.03)}
    chosen, table = residual_results(residual_rows(t), policies, ["one", "two"], RES_ALPHAS)
    return table.join(chosen, "held_out")


QUANTILE_NAMES = ["q05", "q25", "q50", "q75", "q95"]
QUANTILE_ALPHAS = (1e-4, 1e-3, 1e-2)


def quantile_rows(t):
    """Regression rows with gaps in one feature."""
    gap = (F.col("l_orderkey") + F.col("l_linenumber")) % 11 == 0
    return X.regression_rows(t).select("track_id", "f1", F.when(~gap, F.col("f2")).alias("f2"), "f3", "y")


@query("quantile_protocol")
def quantile_protocol(t):
    """Penalty by held-out pinball, an anchor per fold, level error of held-out folds, inflated held-out scores."""
    scores, wide = QF.protocol(quantile_rows(t), "track_id", "f1", ["f2", "f3"], "y", S.QUANTILES, QUANTILE_ALPHAS, QUANTILE_NAMES)
    table = M.quantile_scores(wide, ["track_id", "alpha"], "y", QUANTILE_NAMES)
    return table.join(scores.where("chosen").select("alpha", F.col("mean_pinball").alias("selection_pinball"), "level_uncertainty"), "alpha")


INTERCEPT_SQL = X.with_sql(X.REGRESSION, f"""r AS (SELECT track_id, median(y) / median(f1) AS ratio FROM regression_rows GROUP BY 1),
k AS (SELECT a.track_id AS held_out, avg(b.ratio) AS k FROM r a JOIN r b ON a.track_id <> b.track_id GROUP BY 1),
train AS (SELECT held_out, y - k * f1 AS res FROM regression_rows JOIN k ON track_id <> held_out),
qs AS (SELECT unnest([{", ".join(f"{q}::DOUBLE" for q in S.QUANTILES)}]) AS q),
b AS ({" UNION ALL ".join(f"SELECT held_out, {q}::DOUBLE AS q, quantile_disc(res, {q}) AS b FROM train GROUP BY 1" for q in S.QUANTILES)}),
l AS (SELECT b.held_out, b.q, avg(CASE WHEN res > b THEN b.q * (res - b) ELSE (b.q - 1) * (res - b) END) AS loss FROM b JOIN train t ON b.held_out = t.held_out GROUP BY 1, 2),
h AS (SELECT held_out, b.q, avg(CASE WHEN y > k * f1 + b THEN b.q * (y - k * f1 - b) ELSE (b.q - 1) * (y - k * f1 - b) END) AS held_out_pinball FROM b JOIN k USING (held_out)
  JOIN regression_rows ON track_id = held_out GROUP BY 1, 2)""")


@query("quantile_intercepts", INTERCEPT_SQL + "SELECT held_out, q AS quantile, k AS anchor_ratio, loss, held_out_pinball FROM l JOIN k USING (held_out) JOIN h USING (held_out, q)",
       "anchor_ratio loss held_out_pinball", 4)
def quantile_intercepts(t):
    """M8/M9: without features the fit is the residual quantile of each fold, in training and held-out loss."""
    rows = X.regression_rows(t).select("track_id", "f1", "y")
    models = materialize(QF.fit_folds(rows, "track_id", "f1", [], "y", S.QUANTILES, (0.0,)))
    scored = QF.predict_held_out(rows, models, "track_id", "f1", [], QUANTILE_NAMES)
    losses = [F.avg(M.pinball(F.col("y"), F.col(c), q)).alias(c) for c, q in zip(QUANTILE_NAMES, S.QUANTILES)]
    at = F.create_map(*[v for c, q in zip(QUANTILE_NAMES, S.QUANTILES) for v in (F.lit(c), d(q))])
    held = scored.groupBy(F.col("track_id").alias("held_out")).agg(*losses).unpivot(["held_out"], QUANTILE_NAMES, "name", "held_out_pinball")
    held = held.withColumn("quantile", at[F.col("name")]).drop("name")
    return models.select("held_out", "quantile", "anchor_ratio", "loss").join(held, ["held_out", "quantile"])


LEVEL_SQL = INTERCEPT_SQL + """, mid AS (SELECT held_out, b FROM b WHERE q = 0.5e0),
m AS (SELECT held_out, median(y) - median(k * f1 + b) AS e FROM mid JOIN k USING (held_out) JOIN regression_rows ON track_id = held_out GROUP BY 1),
p AS (SELECT held_out, avg(held_out_pinball) AS pinball FROM h GROUP BY 1)
SELECT count(*) AS folds, avg(pinball) AS mean_pinball, sqrt(avg(e * e)) AS level_uncertainty FROM m JOIN p USING (held_out)"""


@query("level_uncertainty_held_out", LEVEL_SQL, "mean_pinball level_uncertainty", 4)
def level_uncertainty_held_out(t):
    """Level errors of models that held the track out."""
    rows = X.regression_rows(t).select("track_id", "f1", "y")
    models = materialize(QF.fit_folds(rows, "track_id", "f1", [], "y", S.QUANTILES, (0.0,)))
    scored = QF.predict_held_out(rows, models, "track_id", "f1", [], QUANTILE_NAMES)
    return QF.choose_alpha(scored, "track_id", "y", S.QUANTILES, QUANTILE_NAMES).select("folds", "mean_pinball", "level_uncertainty")


GATE_FEATURES = ["n_chars", "tox", "log_chars", "source_number"]
_Z = range(len(GATE_FEATURES))
_LOGIT = "WITH RECURSIVE " + X.GATE_ROWS + """, src AS (SELECT quality, n_chars, CAST(toxic AS DOUBLE) AS tox, ln(n_chars + 1e0) AS log_chars, CAST(substr(source, 4) AS DOUBLE) AS source_number
  FROM gate_rows WHERE quality IS NOT NULL),
st AS (SELECT """ + ", ".join(f"avg({f}) AS m{i}, CASE WHEN stddev_pop({f}) = 0 THEN 1e0 ELSE stddev_pop({f}) END AS s{i}" for i, f in enumerate(GATE_FEATURES)) + """ FROM src),
z AS MATERIALIZED (SELECT """ + ", ".join(f"({f} - m{i}) / s{i} AS z{i}" for i, f in enumerate(GATE_FEATURES)) + """, CAST(quality AS DOUBLE) AS y FROM src, st),
w AS (SELECT 0 AS k, 0e0 AS a, """ + ", ".join(f"0e0 AS b{i}" for i in _Z) + """ UNION ALL
  SELECT any_value(k) + 1, any_value(a) - 0.1e0 * avg(g), """ + ", ".join(f"any_value(b{i}) - 0.1e0 * (avg(g * z{i}) + 0.05e0 * any_value(b{i}))" for i in _Z) + """
  FROM (SELECT *, 1e0 / (1e0 + exp(-greatest(-20e0, least(20e0, a + """ + " + ".join(f"b{i} * z{i}" for i in _Z) + """)))) - y AS g FROM w, z WHERE k < 1000) GROUP BY k)
"""


@query("logistic_gate", _LOGIT + "SELECT a AS intercept, b0 AS b1, b1 AS b2, b2 AS b3, b3 AS b4 FROM w WHERE k = 1000", "intercept b1 b2 b3 b4")
def logistic_gate(t):
    """A thousand gradient steps of the regularised logistic gate on four features."""
    rows = X.gate_rows(t).where("quality IS NOT NULL").select(
        "n_chars", F.col("toxic").cast("double").alias("tox"), F.log(F.col("n_chars") + 1).alias("log_chars"),
        F.substring("source", 4, 9).cast("double").alias("source_number"), "quality")
    fit = R.logistic_fit(rows, GATE_FEATURES, "quality")
    return fit.select("intercept", *[F.col("coefficients")[i].alias(f"b{i + 1}") for i in _Z])


@query("ridge_vector_loto")
def ridge_vector_loto(t):
    """M2/M3/M6: whole-track ridge of the target on 64-value vectors with gaps, scored held out."""
    rows = t.embeddings.select(
        F.col("vec_id"), (F.col("label") % 3).cast("int").alias("track_id"), F.col("label").cast("double").alias("y"),
        F.transform("embedding", lambda v, i: F.when((F.col("vec_id") + i) % 23 > 0, v.cast("double"))).alias("v"))
    rows = materialize(rows)
    scored = R.score_vector_ridge(rows, R.vector_ridge(rows, "track_id", "v", "y", 10.0), "track_id", "v")
    return M.error_bundle(M.with_scopes(scored, "track_id").withColumn("model_id", F.lit("vector_ridge")), ["model_id", "scope"], "y", "p")


FK0, FK1 = solve2_sql("10e0")
FLAG_SQL = X.with_sql(X.POSITIONS, X.PROBES, """rolled AS (SELECT track_id, seg, x_mm, y, avg(y) OVER (PARTITION BY track_id ORDER BY seg ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS roll FROM positions),
bw AS (SELECT p.*, q.x_mm AS bx, q.seg AS bk FROM probes p ASOF LEFT JOIN positions q ON p.track_id = q.track_id AND p.x_req >= q.x_mm),
fw AS (SELECT p.probe_id, q.x_mm AS ax, q.seg AS ak FROM probes p ASOF LEFT JOIN positions q ON p.track_id = q.track_id AND p.x_req <= q.x_mm),
near AS (SELECT b.track_id, probe_id, x_req, CASE WHEN x_req - bx <= ax - x_req THEN bk ELSE ak END AS seg FROM bw b JOIN fw USING (probe_id) WHERE bk IS NOT NULL AND ak IS NOT NULL),
samples AS (SELECT n.track_id, x_req AS x, roll, y FROM near n JOIN rolled r ON n.track_id = r.track_id AND n.seg = r.seg),
held AS (SELECT unnest([0, 1, 2, 3]) AS held_out), train AS (SELECT held_out, s.* FROM samples s JOIN held ON track_id <> held_out)""") + moments_sql("mom", "train", "held_out", ["x", "roll"], "y") + f""",
fit AS (SELECT held_out, my, m0, m1, {FK0} AS k0, {FK1} AS k1 FROM mom),
scored AS (SELECT 'training_mean' AS spec_id, CAST(track_id AS VARCHAR) AS scope, y, my AS p FROM samples JOIN fit ON track_id = held_out UNION ALL
  SELECT 'ridge', CAST(track_id AS VARCHAR), y, my + k0 * (x - m0) + k1 * (roll - m1) FROM samples JOIN fit ON track_id = held_out),
scoped AS (SELECT * FROM scored UNION ALL SELECT spec_id, 'aggregate', y, p FROM scored)""" + bundle_sql("scoped", "spec_id, scope") + "SELECT * FROM bundle"


@query("flagship_cross_validation", FLAG_SQL, BUNDLE)
def flagship_cross_validation(t):
    """J6 + W1 + M1/M3 + A1: probes at their nearest position, whole-track ridge, metrics by track."""
    index = O.dense_index(X.positions(t, blocks=True), ["track_id"], ["seg"], "pos", reuse_blocks=True)
    roll = O.rolling(index, ["track_id"], "pos", 10, 10, {"roll": F.avg("y")}).select("track_id", "seg", "y", "roll")
    near = J.nearest_position(X.probes(t), X.positions(t), ["track_id"], "x_req", "x_mm", "seg", "probe_id")
    near = near.where("selected_index IS NOT NULL").select("track_id", F.col("selected_index").alias("seg"), F.col("x_req").alias("x"))
    samples = materialize(near.join(roll, ["track_id", "seg"]).select("track_id", "x", "roll", "y"))
    c = R.feature_centres(samples, ["x", "roll"])
    train = R.leave_one_out(R.moments(samples, ["track_id"], ["x", "roll"], "y", c), "track_id")
    specs = [{"spec_id": "training_mean", "use": []}, {"spec_id": "ridge", "use": [0, 1], "alpha": 10.0}]
    models = R.ridge_models(R.with_specs(train, specs), 2, c).drop("use", "alpha", "complexity")
    scored = R.score_held_out(samples, models, "track_id", ["x", "roll"])
    return M.error_bundle(M.with_scopes(scored, "track_id"), ["spec_id", "scope"], "y", "p")
