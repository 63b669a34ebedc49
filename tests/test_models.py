"""Fits against numpy and brute force."""

import hashlib
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackloom.operators import metrics as M
from trackloom.operators import models as R
from trackloom.operators import sequence as Q
from trackloom.operators.labels import stump_fit


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(11)
    n = 240
    a, b = rng.normal(5, 2, n), rng.normal(-1, 0.5, n)
    return pd.DataFrame({"track": np.repeat([8, 10, 14], n // 3), "a": a, "b": b, "y": 1.5 * a - 2 * b + rng.normal(0, 0.3, n)})


def ridge_numpy(x, y, alpha, penalise):
    mean, scale = x.mean(0), x.std(0)
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    pen = alpha * np.eye(z.shape[1])
    if not penalise:
        pen[0, 0] = 0
    coef = np.linalg.solve(z.T @ z + pen, z.T @ y)
    return lambda v: np.column_stack([np.ones(len(v)), (v - mean) / scale]) @ coef


@pytest.mark.parametrize("penalise", [True, False])
@pytest.mark.parametrize("alpha", [0.0, 10.0, 1e9])
def test_ridge_matches_numpy(spark, pdf, alpha, penalise):
    df = spark.createDataFrame(pdf)
    c = R.feature_centres(df, ["a", "b"])
    train = R.leave_one_out(R.moments(df, ["track"], ["a", "b"], "y", c), "track")
    models = R.ridge_models(R.with_specs(train, [{"spec_id": "s", "use": [0, 1], "alpha": alpha}]), 2, c, penalise)
    got = R.score_held_out(df, models.drop("use", "alpha", "complexity"), "track", ["a", "b"]).toPandas()
    for t in (8, 10, 14):
        tr, va = pdf[pdf.track != t], pdf[pdf.track == t]
        want = ridge_numpy(tr[["a", "b"]].to_numpy(), tr.y.to_numpy(), alpha, penalise)(va[["a", "b"]].to_numpy())
        own = got[got.track == t].sort_values("a")
        assert np.allclose(own.p, want[np.argsort(va.a.to_numpy())], atol=1e-8)
        if alpha == 1e9 and not penalise:
            assert np.allclose(own.p, tr.y.mean(), atol=1e-4)


def test_residual_moments_match_two_fits(spark, pdf):
    df = spark.createDataFrame(pdf)
    c = R.feature_centres(df, ["a", "b"])
    train = R.leave_one_out(R.moments(df, ["track"], ["a", "b"], "y", c), "track")
    m = R.residual_models(R.with_specs(train, [{"spec_id": "r", "use": [1], "alpha": 5.0}]), 2, c, [0], 1.0).toPandas()
    for _, r in m.iterrows():
        tr = pdf[pdf.track != r.held_out]
        base = ridge_numpy(tr[["a"]].to_numpy(), tr.y.to_numpy(), 1.0, True)
        res = tr.y.to_numpy() - base(tr[["a"]].to_numpy())
        corr = ridge_numpy(tr[["b"]].to_numpy(), res, 5.0, True)
        v = tr[["a", "b"]].to_numpy()[:5]
        assert np.allclose(r.beta[0] + v @ np.array(r.beta[1:]), base(v[:, :1]) + corr(v[:, 1:]))


def test_nested_tie_rules(spark, pdf):
    df = spark.createDataFrame(pdf.assign(a=0.0))
    specs = [{"spec_id": f"a{v:g}", "use": [0], "alpha": v} for v in (1.0, 10.0)]
    low, _ = R.nested_choice(df, "track", ["a"], "y", specs, penalise_intercept=False)
    high, _ = R.nested_choice(df, "track", ["a"], "y", specs, penalise_intercept=False, largest_alpha=True)
    assert {r["spec_id"] for r in low.collect()} == {"a1"} and {r["spec_id"] for r in high.collect()} == {"a10"}


def pinball(y, p, q):
    u = y - p
    return np.mean(np.maximum(q * u, (q - 1) * u))


def test_quantile_fit_reaches_the_exact_optimum(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=40)
    y = 2 + 0.8 * x + rng.standard_t(3, 40)
    z = (x - x.mean()) / x.std()
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    alpha, qs = 0.01, (0.05, 0.5, 0.95)
    fit = {r["quantile"]: r for r in R.quantile_fit(df, ["x"], "y", qs, alpha, steps=250).collect()}
    for q in qs:
        lines = [(y[i], 0.0) for i in range(40)]
        for i, j in itertools.combinations(range(40), 2):
            b = (y[i] - y[j]) / (z[i] - z[j])
            lines.append((y[i] - b * z[i], b))
        exact = min(pinball(y, a + b * z, q) + alpha * abs(b) for a, b in lines)
        got = pinball(y, fit[q]["intercept"] + fit[q]["coefficients"][0] * z, q) + alpha * abs(fit[q]["coefficients"][0])
        assert exact - 1e-12 <= got <= exact + 1e-3
        assert fit[q]["loss"] == pytest.approx(got)


def test_logistic_steps_match_numpy(spark, pdf):
    y = (pdf.y > pdf.y.median()).astype(float).to_numpy()
    z = ((pdf[["a", "b"]] - pdf[["a", "b"]].mean()) / pdf[["a", "b"]].std(ddof=0)).to_numpy()
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(w[0] + z @ w[1:], -20, 20)))
        w -= 0.1 * (np.r_[np.mean(p - y), z.T @ (p - y) / len(y)] + 0.05 * np.r_[0, w[1:]])
    row = R.logistic_fit(spark.createDataFrame(pdf.assign(l=y)), ["a", "b"], "l", steps=30).first()
    assert np.allclose([row["intercept"], *row["coefficients"]], w)


def test_logistic_rows_beyond_the_bound_give_the_same(spark, pdf, monkeypatch):
    df = spark.createDataFrame(pdf.assign(l=(pdf.y > 0).astype(float)))
    near = R.logistic_fit(df, ["a", "b"], "l", steps=5).first()
    monkeypatch.setattr(R, "bounded", lambda *a: None)
    far = R.logistic_fit(df, ["a", "b"], "l", steps=5).first()
    assert np.allclose([near["intercept"], *near["coefficients"]], [far["intercept"], *far["coefficients"]])


def test_fits_refuse_missing_values(spark, pdf):
    holes = spark.createDataFrame(pdf.assign(a=pdf.a.where(pdf.index != 3)))
    for fit in (lambda: R.logistic_fit(holes, ["a"], "y"), lambda: R.quantile_fit(holes, ["a"], "y", [0.5], 0.1)):
        with pytest.raises(ValueError):
            fit()


def test_moments_leave_out_incomplete_rows(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0), (0, None, 5.0), (0, 3.0, float("nan")), (0, 2.0, 4.0)], "k int, a double, y double")
    row = R.moments(df, ["k"], ["a"], "y", [0.0]).first()
    assert [row[f"_m{i}"] for i in range(6)] == [2.0, 3.0, 6.0, 5.0, 10.0, 20.0]


@pytest.mark.parametrize("width", [5, 400])
def test_vector_ridge_imputes_per_fold_whatever_the_partitions(spark, width):
    rng = np.random.default_rng(3)
    x = rng.normal(1500, 2, (60, width))
    y = x[:, :3].sum(1) + rng.normal(size=60)
    holes = rng.random((60, width)) < (0.1 if width == 5 else 0.0)
    x[holes] = np.nan
    rows = [(i, i % 3, [None if np.isnan(v) else float(v) for v in x[i]], float(y[i])) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, track int, v array<double>, y double")
    for parts in (1, 8):
        models = R.vector_ridge(df.repartition(parts), "track", "v", "y", 7.0)
        got = {r["id"]: r["p"] for r in R.score_vector_ridge(df, models, "track", "v").collect()}
        for held in range(3):
            train, test = np.arange(60) % 3 != held, np.arange(60) % 3 == held
            med = np.nanmedian(x[train], axis=0)
            a, b = np.where(np.isnan(x[train]), med, x[train]), np.where(np.isnan(x[test]), med, x[test])
            mean, std = a.mean(0), a.std(0)
            z = (a - mean) / std
            coef = np.linalg.solve(z.T @ z + 7.0 * np.eye(width), z.T @ (y[train] - y[train].mean()))
            want = y[train].mean() + (b - mean) / std @ coef
            assert np.allclose([got[i] for i in np.flatnonzero(test)], want, atol=1e-6)


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(80, 5)) @ rng.normal(size=(5, 5))
    df = spark.createDataFrame([(int(i), int(i % 3), [float(v) for v in r]) for i, r in enumerate(x)], "id int, track int, v array<double>")
    row = R.pca(df, "track", "v", 2).first()
    z = (x - x.mean(0)) / x.std(0)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    assert np.allclose(row["variances"], s[:2] ** 2 / 80)
    for got, want in zip(row["axes"], vt[:2]):
        assert np.allclose(got, want * np.sign(want[np.abs(want).argmax()]))
    loo = R.pca_leave_one_out(df, "track", "v", 2).where("held_out = 0").first()
    part = x[np.arange(80) % 3 != 0]
    assert np.allclose(loo["mean"], part.mean(0)) and np.allclose(loo["scale"], part.std(0))


def test_frozen_scoring_imputes_and_zero_feature_model(spark):
    art = spark.createDataFrame(
        [("c", "m0", 3.0, [], [], [], [], []), ("c", "m1", 1.0, ["a"], [2.0], [1.0], [2.0], [4.0])],
        "cohort string, model_id string, intercept double, feature_names array<string>, medians array<double>, means array<double>, scales array<double>, coefficients array<double>")
    rows = spark.createDataFrame([("c", 1, {"a": 5.0}), ("c", 2, {"a": float("nan")}), ("c", 3, {})], "cohort string, id int, features map<string,double>")
    got = {(r["model_id"], r["id"]): r["p"] for r in R.score_artifacts(rows, art, "cohort").collect()}
    assert got == {("m0", 1): 3.0, ("m0", 2): 3.0, ("m0", 3): 3.0, ("m1", 1): 9.0, ("m1", 2): 3.0, ("m1", 3): 3.0}


def test_constant_prediction_has_no_correlation(spark):
    df = spark.createDataFrame([(1, float(i), 2.0) for i in range(5)], "g int, y double, p double")
    row = M.error_bundle(df, ["g"], "y", "p").first()
    assert row["pearson"] is None and row["spearman"] is None and row["r_squared"] == pytest.approx(0.0)


def test_crossed_quantiles_are_sorted_and_inflated(spark):
    df = spark.createDataFrame([(5.0, 3.0, 4.0, 1.0, 2.0)], "a double, b double, c double, d double, e double")
    cols = ["a", "b", "c", "d", "e"]
    assert list(M.sorted_quantiles(df, cols).first()) == [1.0, 2.0, 3.0, 4.0, 5.0]
    flat = spark.createDataFrame([(1.0,) * 5], "a double, b double, c double, d double, e double")
    row = M.inflate_quantiles(flat, cols, F.lit(0.1)).first()
    assert row["e"] == pytest.approx(1 + 0.16448536269514722) and row["c"] == 1.0


def test_bootstrap_with_one_block_has_no_spread(spark):
    df = spark.createDataFrame([(1, i, float(i * i)) for i in range(30)], "g int, pos long, diff double")
    draws = Q.block_bootstrap(df, ["g"], "pos", "diff", 30, 50)
    values = [r["mean_difference"] for r in draws.collect()]
    assert values == pytest.approx([sum(i * i for i in range(30)) / 30] * 50)


def test_bootstrap_pieces_do_not_change_draws(spark):
    df = spark.createDataFrame([(1, i, float(i % 7)) for i in range(95)], "g int, pos long, diff double")
    a = {r["draw"]: r["mean_difference"] for r in Q.block_bootstrap(df, ["g"], "pos", "diff", 10, 40).collect()}
    b = {r["draw"]: r["mean_difference"] for r in Q.block_bootstrap(df, ["g"], "pos", "diff", 10, 40, task_blocks=2).collect()}
    assert a == pytest.approx(b)


def test_bootstrap_across_chunks_broadcasts_nothing(spark):
    """Blocks that cross a chunk's edge, missing values and a null group, against direct sums."""
    n, block = 66_001, 10
    value = [None if i % 13 == 5 else float(i % 97) for i in range(n)]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(value)] + [(None, 0, 5.0)], "g int, pos long, diff double")
    draws = Q.block_bootstrap(df, ["g"], "pos", "diff", block, 3, task_blocks=3000)
    assert "Broadcast" not in draws._jdf.queryExecution().executedPlan().toString()
    k, want = -(-n // block), {}
    for draw in range(3):
        starts = [int(hashlib.md5(f"{draw}_{j}".encode()).hexdigest()[:15], 16) % (n - block + 1) for j in range(k)]
        assert max(starts) >= 1 << 16
        total = sum(v or 0.0 for s in starts[:-1] for v in value[s:s + block])
        cut = [v for v in value[starts[-1]:starts[-1] + block] if v is not None][:n - (k - 1) * block]
        want[1, draw] = (total + sum(cut)) / n
    assert {(r["g"], r["draw"]): r["mean_difference"] for r in draws.collect()} == pytest.approx(want)


def test_folds_without_features_take_the_order_statistics(spark):
    """Losses of the exact quantiles of each fold's residuals, the anchor taken off."""
    from trackloom.operators import quantile_folds as QF

    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"t": np.repeat([1, 2, 3], 70), "a": rng.uniform(1, 2, 210)})
    pdf["y"] = 3 * pdf["a"] + rng.exponential(1, 210) * pdf["t"]
    ratio = pdf.groupby("t")["y"].median() / pdf.groupby("t")["a"].median()
    got = {(r["held_out"], r["quantile"]): r for r in QF.fit_folds(spark.createDataFrame(pdf), "t", "a", [], "y", [0.05, 0.5, 0.93], (0.0,)).collect()}
    assert len(got) == 9
    for (t, q), row in got.items():
        own = pdf[pdf["t"] != t]
        r = np.sort(own["y"] - ratio.drop(t).mean() * own["a"])
        b = r[math.ceil(q * len(r)) - 1]
        assert row["intercept"] == pytest.approx(b, abs=1e-12) and row["coefficients"] == []
        assert row["loss"] == pytest.approx(np.maximum(q * (r - b), (q - 1) * (r - b)).mean(), abs=1e-12)


def test_discrete_quantiles_in_blocks(spark, small_blocks):
    from trackloom.operators.ordered import exact_quantiles

    v = np.random.default_rng(6).integers(0, 90, 400)
    df = spark.createDataFrame([(1, float(x)) for x in v], "g int, v double")
    got = {r["prob"]: r["quantile"] for r in exact_quantiles(df, ["g"], "v", [0.0, 0.05, 0.333, 1.0], discrete=True).collect()}
    assert got == {p: np.sort(v)[max(math.ceil(p * 400) - 1, 0)] for p in got} and len(got) == 4


def test_packed_rows_keep_every_row_in_its_fold(spark):
    from trackloom.session import pack

    rows = [(i % 3, float(i), None if i % 7 == 0 else i / 2) for i in range(9001)]
    blocks = pack(spark.createDataFrame(rows, "t int, a double, b double"), ["a", "b"], "t", [2, 0, 1]).collect()
    lines = {k: np.concatenate([np.frombuffer(r["block"]).reshape(2, r["n"]) for r in blocks if r["k"] == k], axis=1) for k in range(3)}
    for k, t in enumerate([2, 0, 1]):
        got = lines[k][:, np.argsort(lines[k][0])]
        want = np.array([[a, np.nan if b is None else b] for x, a, b in rows if x == t]).T
        assert np.array_equal(got, want, equal_nan=True)


def test_stump_first_best_wins(spark):
    df = spark.createDataFrame([(1, 0.1, 9.0, False), (1, 0.2, 9.0, False), (1, 0.3, 9.0, True), (1, 0.4, 9.0, True)], "g int, u double, w double, ok boolean")
    row = stump_fit(df, ["g"], ["u", "w"], "ok").first()
    assert (row["feature"], row["threshold"], row["direction"], row["loss"]) == ("u", 0.3, 1, 0.0)


def test_nested_vector_selection_against_direct_fits(spark):
    """Choice, refit and held-out errors against decompositions of each fold's own rows."""
    from trackloom.operators import nested as N

    rng = np.random.default_rng(11)
    rows = []
    for i in range(120):
        v = rng.normal(size=6) * [3, 2, 1, 1, .5, .1] + [0, 5, 0, 0, 0, 100]
        e = rng.normal(size=2)
        rows.append((i % 4, v.tolist(), e.tolist(), float(v[0] - v[1] + .3 * v[4] + e[0] + rng.normal() + (i % 4))))
    bad = [(0, [float("nan")] * 6, [0.0, 0.0], 1.0), (1, [0.0] * 6, [0.0, None], 1.0), (2, [0.0] * 6, [0.0, 0.0], None)]
    df = spark.createDataFrame(rows + bad, "g int, v array<double>, e array<double>, y double")
    families = [N.Family("mean", None), N.Family("pca", (1, 3, 9)), N.Family("both", (2, 4), True, "pca"), N.Family("whole", ())]
    alphas = (0.1, 5.0, 300.0)

    def direct(train, test, spec):
        x = [np.array([r[1] for r in part], float) for part in (train, test)]
        extra = [np.array([r[2] for r in part], float) for part in (train, test)]
        scale = lambda a: tuple((b - a[0].mean(0)) / a[0].std(0) for b in a)
        x, extra = scale(x), scale(extra)
        parts = [np.zeros((len(part), 0)) for part in (train, test)]
        if spec.components is not None:
            axes = np.linalg.svd(x[0], full_matrices=False)[2][:spec.components or 6]
            parts = [a @ axes.T for a in x]
        if spec.extra:
            parts = [np.column_stack(z) for z in zip(parts, extra)]
        y = np.array([r[3] for r in train])
        beta = np.linalg.solve(parts[0].T @ parts[0] + spec.alpha * np.eye(parts[0].shape[1]), parts[0].T @ (y - y.mean()))
        return y.mean() + parts[1] @ beta

    errors = lambda train, test, s: np.abs(direct(train, test, s) - [r[3] for r in test]).mean()
    specs = N.specs_of(families, alphas)
    want, held = {}, {}
    for outer in range(4):
        rest = [r for r in rows if r[0] != outer]
        for f in families:
            mine = [s for s in specs if s.family == f.name]
            scored = [(np.mean([errors([r for r in rest if r[0] != i], [r for r in rest if r[0] == i], s) for i in range(4) if i != outer]),
                       s.components or 0, s.alpha, s) for s in mine]
            best = min(scored, key=lambda x: (round(x[0], 9), *x[1:3]))
            want[outer, f.name] = (*best[1:3], round(best[0], 6))
            held[outer, f.name] = round(errors(rest, [r for r in rows if r[0] == outer], best[3]), 6)
    chosen = N.chosen_specs(N.inner_scores(df, "g", "v", "e", "y", families, alphas).withColumn("inner_mae", F.round("inner_mae", 9)))
    got = {(r["held_out"], r["family"]): (r["components"], r["alpha"], round(r["inner_mae"], 6)) for r in chosen.collect()}
    assert got == want
    table = N.fold_table(N.refit_held_out(df, "g", "v", "e", "y", families, chosen), [], "g", "y", families).collect()
    assert {(r["g"], r["family"]): round(r["mae"], 6) for r in table} == held
    both = [r for r in table if r["family"] == "both"]
    assert all(abs(r["change_vs_partner"] - (held[r["g"], "both"] - held[r["g"], "pca"])) < 2e-6 for r in both)
    empty = N.inner_scores(df.limit(0), "g", "v", "e", "y", families, alphas)
    assert empty.collect() == [] and N.chosen_specs(empty).collect() == []


def test_quantile_folds_reach_the_exact_optimum(spark):
    """Losses against all corners of the piecewise linear objective; anchors, gaps, predictions
    and the choice of the penalty against numpy."""
    from trackloom.operators import quantile_folds as QF

    rng = np.random.default_rng(5)
    rows = [(i % 3, float(rng.uniform(1, 4)), None if i % 7 == 0 else float(rng.normal()), 0.0) for i in range(36)]
    rows = [(g, a, x, float(2.5 * a + (x or 0.2) + rng.standard_t(2) + .2 * g)) for g, a, x, _ in rows]
    df = spark.createDataFrame([*rows, (1, 2.0, 1.0, None), (2, None, 1.0, 3.0)], "g int, a double, x double, y double")
    quantiles, alphas, names = (.05, .25, .5, .75, .95), (1e-3, 0.1), ["q05", "q25", "q50", "q75", "q95"]
    models = {(r["held_out"], r["alpha"], r["quantile"]): r for r in QF.fit_folds(df, "g", "a", ["x"], "y", quantiles, alphas).collect()}
    g, a, y = (np.array([r[i] for r in rows], float) for i in (0, 1, 3))
    x = np.array([np.nan if r[2] is None else r[2] for r in rows])
    ratio = {t: np.median(y[g == t]) / np.median(a[g == t]) for t in range(3)}
    held = {}
    for t in range(3):
        k = np.mean([v for o, v in ratio.items() if o != t])
        fill = np.nanmedian(x[g != t])
        full = np.where(np.isnan(x), fill, x)
        mean, sd = full[g != t].mean(), full[g != t].std()
        z, r = (full[g != t] - mean) / sd, (y - k * a)[g != t]
        for alpha in alphas:
            held[t, alpha] = []
            for q in quantiles:
                got = models[t, alpha, q]
                assert np.allclose([got["anchor_ratio"], got["medians"][0], got["means"][0], got["scales"][0]], [k, fill, mean, sd])

                def objective(b, s):
                    e = r - b - s * z
                    return np.maximum(q * e, (q - 1) * e).mean() + alpha * abs(s)

                corners = [(v, 0.0) for v in r]
                for i, j in itertools.combinations(range(len(r)), 2):
                    if z[i] != z[j]:
                        s = (r[i] - r[j]) / (z[i] - z[j])
                        corners.append((r[i] - s * z[i], s))
                best = min(objective(*c) for c in corners)
                assert best - 1e-9 <= got["loss"] <= best * (1 + 2e-3) + 1e-9
                held[t, alpha].append(k * a[g == t] + got["intercept"] + got["coefficients"][0] * (full[g == t] - mean) / sd)
    scores, wide = QF.protocol(df, "g", "a", ["x"], "y", quantiles, alphas, names)
    want = {}
    for alpha in alphas:
        losses, level = [], []
        for t in range(3):
            fits = np.sort(np.stack(held[t, alpha]), axis=0)
            e = y[g == t] - fits
            losses.append(np.mean([np.maximum(q * e[i], (q - 1) * e[i]).mean() for i, q in enumerate(quantiles)]))
            level.append(np.median(y[g == t]) - np.median(fits[2]))
        want[alpha] = (np.mean(losses), np.sqrt(np.mean(np.square(level))))
    for r in scores.collect():
        assert np.allclose([r["mean_pinball"], r["level_uncertainty"]], want[r["alpha"]], atol=1e-9)
        assert r["chosen"] == (r["alpha"] == min(alphas, key=lambda v: want[v][0]))
    assert wide.count() == len(rows) and wide.where("q05 <= q25 and q25 <= q50 and q50 <= q75 and q75 <= q95").count() == len(rows)


def test_gate_fits_per_fold(spark, monkeypatch):
    """Logistic steps on counts and in passes against numpy; stumps against single fits."""
    from trackloom.operators import gates as G
    from trackloom.operators.labels import training_folds

    rng = np.random.default_rng(9)
    rows = [(i % 3, float(rng.integers(0, 6)), None if i % 9 == 0 else float(rng.normal()), bool(rng.random() < .4 + .1 * (i % 3)))
            for i in range(90)]
    df = spark.createDataFrame(rows, "g int, a double, b double, ok boolean")
    local = {r["held_out"]: r for r in G.logistic_folds(df, "g", ["a", "b"], "ok", steps=25).collect()}
    monkeypatch.setattr(G, "LOCAL_ROWS", 1)
    passed = {r["held_out"]: r for r in G.logistic_folds(df, "g", ["a", "b"], "ok", steps=25).collect()}
    for t in range(3):
        x = np.array([[r[1], r[2] or 0.0] for r in rows if r[0] != t])
        y = np.array([r[3] for r in rows if r[0] != t], float)
        z, w = (x - x.mean(0)) / x.std(0), np.zeros(3)
        for _ in range(25):
            gap = 1 / (1 + np.exp(-np.clip(w[0] + z @ w[1:], -20, 20))) - y
            w = w - .1 * (np.r_[gap.mean(), z.T @ gap / len(y)] + .05 * np.r_[0, w[1:]])
        for got in (local[t], passed[t]):
            assert np.allclose([got["intercept"], *got["coefficients"]], w, atol=1e-9)
    single = stump_fit(training_folds(df, "g", range(3)), ["held_out"], ["a", "b"], "ok")
    rows_of = lambda d: sorted(map(tuple, d.select("held_out", "feature", "threshold", "direction", "loss").collect()))
    assert rows_of(G.stump_folds(df, "g", ["a", "b"], "ok")) == rows_of(single)
