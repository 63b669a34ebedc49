"""Profiles and raster stencils against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackloom.operators import profiles as P
from trackloom.operators import raster as R

Y = np.linspace(0.05, 1.85, 60)


def frame(spark, z, y=Y):
    rows = [(1, i, float(a), None if np.isnan(b) else float(b)) for i, (a, b) in enumerate(zip(y, z))]
    return spark.createDataFrame(rows, "k int, iy int, y_mm double, z double")


def smooth_numpy(z, sigma=2.0):
    r = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    w /= w.sum()
    ok = np.isfinite(z)

    def blur(v):
        return np.convolve(np.pad(v, r, mode="symmetric"), w, mode="valid")

    num, den = blur(np.where(ok, z, 0)), blur(ok.astype(float))
    out = np.full(len(z), np.nan)
    if ok.sum() >= 5:
        out[den > 0.25] = num[den > 0.25] / den[den > 0.25]
    return out


@pytest.mark.parametrize("n", [60, 9, 5])
def test_smooth_matches_numpy(spark, n):
    rng = np.random.default_rng(n)
    z = rng.normal(size=n)
    z[rng.random(n) < (0.3 if n == 60 else 0.0)] = np.nan
    got = P.smooth(frame(spark, z, Y[:n]), ["k"]).toPandas().sort_values("iy")["smooth"].to_numpy(float)
    assert np.allclose(got, smooth_numpy(z), equal_nan=True)


def test_fewer_than_five_valid_rows_give_nothing(spark):
    z = np.full(60, np.nan)
    z[10:14] = 1.0
    assert P.smooth(frame(spark, z), ["k"]).where("smooth IS NOT NULL").isEmpty()
    assert P.edge_finder(frame(spark, z), ["k"]).first()["status"] == "insufficient_finite_profile"


def test_profiles_are_dealt_over_tasks_by_their_rows(spark, monkeypatch):
    """However small their bytes are; the edges stay the same."""
    z = np.random.default_rng(5).normal(size=60)
    one = frame(spark, z).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(39)))).withColumnRenamed("k", "t").withColumn("k", F.col("x") * 40)
    want = {tuple(r) for r in P.edge_finder(one, ["k"]).collect()}
    monkeypatch.setattr(P, "TASK_ROWS", 200)
    assert P.smooth(one, ["k"]).rdd.getNumPartitions() == 12
    edges = P.edge_finder(one, ["k"], 2400)
    assert edges.rdd.getNumPartitions() == 12 and {tuple(r) for r in edges.collect()} == want
    runs = P.window_profiles(one, ["t"], "k", [25, 50], 80, 2400)
    assert runs.rdd.getNumPartitions() == 12 and runs.count() == 2 * 2400
    assert P.side_detrend(one, ["k"], 2, 2400).rdd.getNumPartitions() == 12


def test_edges_of_a_bump(spark):
    z = 0.1 / (1 + np.exp(-(Y - 0.7) / 0.02)) - 0.1 / (1 + np.exp(-(Y - 1.2) / 0.02))
    row = P.edge_finder(frame(spark, z), ["k"]).first()
    s = smooth_numpy(z)
    g = np.gradient(s, Y)
    left = Y[(Y >= 0.5) & (Y <= 0.975)][np.argmax(g[(Y >= 0.5) & (Y <= 0.975)])]
    right = Y[(Y >= 0.975) & (Y <= 1.45)][np.argmin(g[(Y >= 0.975) & (Y <= 1.45)])]
    assert (row["status"], row["left"], row["right"]) == ("ok", pytest.approx(left), pytest.approx(right))
    assert row["width"] == pytest.approx(right - left)


def test_gap_fill_and_gradient_match_numpy(spark):
    z = np.sin(Y * 4)
    z[20:50] = np.nan
    got = P.filled_gradient(P.smooth(frame(spark, z), ["k"]), ["k"]).toPandas().sort_values("iy")
    s = smooth_numpy(z)
    ok = np.isfinite(s)
    filled = np.interp(Y, Y[ok], s[ok])
    assert np.allclose(got["filled"], filled) and np.allclose(got["gradient"], np.gradient(filled, Y))


def test_band_statistics(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(size=60)
    z[:4] = np.nan
    row = P.band_statistics(frame(spark, z), ["k"]).first()
    band = z[(Y >= 0.05) & (Y <= 0.45)]
    clean = band[np.isfinite(band)]
    assert row["left_baseline"] == pytest.approx(np.median(clean))
    assert row["left_noise"] == pytest.approx(1.4826 * np.median(abs(clean - np.median(clean))))
    assert row["left_valid_fraction"] == pytest.approx(np.isfinite(band).mean())


def test_valid_run_label_edges_and_rejections(spark):
    v = np.where((Y > 0.6) & (Y < 1.3), 1.0, 0.0)
    rows = [(1, i, float(y), float(a)) for i, (y, a) in enumerate(zip(Y, v))]
    rows += [(2, i, float(y), 1.0) for i, y in enumerate(Y)]                       # no contrast
    rows += [(3, i, float(y), 1.0 if y < 0.7 else 0.0) for i, y in enumerate(Y)]   # touches the start
    df = spark.createDataFrame(rows, "k int, iy int, y_mm double, v double")
    got = {r["k"]: r for r in P.valid_run_labels(df, ["k"]).collect()}
    assert got[1]["eligible"] and 0.6 < got[1]["width"] < 0.8
    s = np.convolve(v, np.ones(5) / 5, mode="same")
    thr = 0.5 * sum(np.percentile(s, [10, 90]))
    i = np.flatnonzero(s > thr)[0]
    assert got[1]["left"] == pytest.approx(Y[i - 1] + (thr - s[i - 1]) / (s[i] - s[i - 1]) * (Y[i] - Y[i - 1]))
    assert not got[2]["eligible"] and not got[3]["eligible"] and got[3]["width"] is None


def test_blur_matches_numpy(spark):
    rng = np.random.default_rng(5)
    a = rng.random((6, 9))
    cells = spark.createDataFrame([(1, r, c, float(a[r, c])) for r in range(6) for c in range(9)], "k int, r int, c int, v double")
    got = R.gaussian_blur(cells, ["k"], 3.0, 12).toPandas().sort_values(["r", "c"])["blurred"].to_numpy().reshape(6, 9)
    w = np.array(R.gaussian_taps(3.0, 12))

    def mirror(i, n):
        j = i % (2 * (n - 1))
        return j if j < n else 2 * (n - 1) - j

    h = np.array([[sum(w[k] * a[r, mirror(c + k - 12, 9)] for k in range(25)) for c in range(9)] for r in range(6)])
    want = np.array([[sum(w[k] * h[mirror(r + k - 12, 6), c] for k in range(25)) for c in range(9)] for r in range(6)])
    assert np.allclose(got, want)


def test_block_mean_must_divide(spark):
    cells = spark.createDataFrame([(1, 0, 0, 1.0)], "k int, r int, c int, v double")
    with pytest.raises(ValueError):
        R.block_mean(cells, ["k"], 7, 8, 4)


def test_robust_plane_recovers_plane_and_skips_small_groups(spark):
    rng = np.random.default_rng(2)
    x, y = rng.random(400) * 50, rng.random(400) * 2
    z = 0.3 * x - 1.5 * y + 4 + rng.normal(0, 0.01, 400)
    z[:15] += 30
    pdf = pd.DataFrame({"g": 1, "x": x, "y": y, "z": z})
    pdf = pd.concat([pdf, pdf.head(50).assign(g=2)])
    df = spark.createDataFrame(pdf)
    plane = R.robust_plane(df, ["g"])
    row = plane.first()
    assert plane.count() == 1 and row["a"] == pytest.approx(0.3, abs=1e-3) and row["b"] == pytest.approx(-1.5, abs=1e-2)
    flat = R.detrend(df, plane, ["g"])
    assert flat.where("g = 2").agg(F.max(F.abs(F.col("z_levelled") - F.col("z")))).first()[0] == 0


def test_crop_pads_with_zero_and_flags_the_edge(spark):
    cells = spark.createDataFrame([(1, r, c, 1.0) for r in range(8) for c in range(8)], "frame int, r int, c int, v double")
    centres = spark.createDataFrame([(1, 0.5, 4.5)], "frame int, cx double, cy double")
    out = R.centred_crop(cells, centres, ["frame"], 8, 8, 4)
    assert out.count() == 16 and out.agg(F.sum("v")).first()[0] == 8.0 and out.first()["edge"]


def test_frame_kernels_with_missing_cells(spark):
    """Array statistics against loops over the known cells of each frame."""
    import warnings

    from trackloom.operators import frames as FR

    rng = np.random.default_rng(4)
    x = rng.normal(size=(7, 4, 6))
    x[1, 2, 3] = x[1, 0, 0] = np.nan
    x[2] = 3.0
    x[3] = np.nan
    rows = [(i, [None if np.isnan(v) and v_i % 2 else float(v) for v_i, v in enumerate(f.ravel())]) for i, f in enumerate(x)]
    df = spark.createDataFrame(rows, "k int, f array<double>")
    got = {r["k"]: r for r in FR.per_frame(df, ["k"], "f", 4, 6, FR.SUMMARY, FR.summary).collect()}
    scores = {r["k"]: r["score"] for r in FR.frame_scores(df, ["k"], "f", 4, 6).collect()}
    centres = {r["k"]: r for r in FR.per_frame(df, ["k"], "f", 4, 6, ["cx", "cy", "hot_cells"], FR.hot_centre).collect()}
    for i, f in enumerate(x):
        known = f[~np.isnan(f)]
        if not len(known):
            assert got[i]["mean"] is None and scores[i] is None and centres[i]["cx"] is None
            continue
        p10, p95 = np.quantile(known, [.1, .95])
        assert np.allclose([got[i]["mean"], got[i]["std"], got[i]["p10"], got[i]["high"]], [known.mean(), known.std(), p10, known.max()])
        assert np.isclose(got[i]["hot_fraction"], (known >= p95).mean()) and np.isclose(scores[i], np.quantile(known, .995))
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            assert np.isclose(got[i]["grad_x"], np.nanmean(np.abs(f[:, 1:] - f[:, :-1])))
        w = {(r, c): max(f[r, c] - p95, 0) + 1e-12 for r in range(4) for c in range(6) if f[r, c] >= p95}
        assert np.isclose(centres[i]["cx"], sum(v * c for (_, c), v in w.items()) / sum(w.values())) and centres[i]["hot_cells"] == len(w)
    shape = {r["k"]: r for r in FR.per_frame(df, ["k"], "f", 4, 6, FR.SHAPE, FR.shape).collect()}
    assert shape[2]["failure"] == shape[3]["failure"] == 1.0 and shape[2]["major_axis"] == 0.0 and shape[0]["failure"] == 0.0
    indexed = df.selectExpr("0 AS t", "k AS idx", "f")
    pairs = {r["idx"]: r for r in FR.consecutive(indexed, "t", "idx", "f", 4, 6).collect()}
    ok = ~np.isnan(x[1])
    assert np.isclose(pairs[1]["mean_abs_difference"], np.abs(x[1] - x[0])[ok].mean())
    assert np.isclose(pairs[1]["correlation"], np.corrcoef(x[1][ok], x[0][ok])[0, 1]) and pairs[3]["mean_abs_difference"] is None
    assert FR.per_frame(df.limit(0), ["k"], "f", 4, 6, FR.SUMMARY, FR.summary).collect() == []
    with pytest.raises(Exception, match="must have 4 x 5 cells"):
        FR.per_frame(df, ["k"], "f", 4, 5, FR.SUMMARY, FR.summary).collect()


def test_strips_are_cut_from_row_blocks(spark):
    """Ranges beside the mask, sums and area averages against the whole tile in numpy."""
    from pyspark.sql import functions as F

    from trackloom.functions.scalars import d
    from trackloom.operators import frames as FR

    rng = np.random.default_rng(6)
    image = rng.normal(size=(37, 5))
    rows = spark.createDataFrame([("a", r, line.tolist()) for r, line in enumerate(image)], "tile string, r int, pixels array<float>")
    at = spark.createDataFrame([("a", i, i * 0.35) for i in range(9)], "tile string, position int, x double").withColumns(
        FR.strip_ranges(F.col("x"), d(.4), d(1.0), d(.1), F.lit(37)))
    strips = FR.strips_of(at, ["tile", "position"])
    cut = FR.cut_strips(strips, ["tile", "position"], FR.tile_blocks(rows, ["tile"], "r", "pixels", 6), ["tile"], 6, 5, 4)
    want = {(r["position"], r["side"]): (r["lo"], r["hi"]) for r in strips.collect()}
    got = {(r["position"], r["side"]): r for r in cut.collect()}
    assert got.keys() == want.keys() and not any(r["overlap"] for r in got.values()) and (0, "up") not in got
    image = image.astype(np.float32).astype(float)
    fine = lambda a, n: np.repeat(np.repeat(a, n, axis=0), n, axis=1)
    for key, (lo, hi) in want.items():
        part = image[lo:hi]
        assert got[key]["cells"] == part.size and np.isclose(got[key]["total"], part.sum()) and np.isclose(got[key]["squares"], (part ** 2).sum())
        whole = fine(part, 4)  # every pixel 4 x 4 times, so quarters of the strip are whole pixels
        means = whole.reshape(4, hi - lo, 4, 5).mean(axis=(1, 3))
        assert np.allclose(got[key]["grid"], means.ravel())
    vectors = {r["position"]: r["vector"] for r in FR.raw_vector(cut, ["tile", "position"], 4).collect()}
    assert all(len(v) == 32 for v in vectors.values()) and vectors[0][:16] == [0.0] * 16
    assert {r["side"] for r in FR.strips_of(at, ["tile", "position"], upstream_only=True).collect()} == {"up"}
