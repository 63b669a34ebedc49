"""Block-cut operators against pandas, with one group and one value holding most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackloom.operators import ordered as O


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    n = 1500
    g = np.where(rng.random(n) < 0.7, 1, rng.integers(2, 5, n))
    v = np.where(rng.random(n) < 0.4, 7.25, np.round(rng.normal(0, 10, n), 2))
    return pd.DataFrame({"g": g, "id": np.arange(n), "v": v, "ok": rng.random(n) < 0.6})


@pytest.fixture
def df(spark, rows, small_blocks):
    return spark.createDataFrame(rows)


def test_blocks_are_ordered_and_heavy_values_isolated(df):
    blocked = O.assign_blocks(df, ["v"])
    assert not blocked.single and blocked.heavy
    spans = blocked.df.groupBy(O.BLOCK).agg(F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy(O.BLOCK).collect()
    assert len(spans) > 5
    assert all(a["hi"] < b["lo"] for a, b in zip(spans, spans[1:]))
    heavy = [r for r in spans if r[O.BLOCK] in blocked.heavy]
    assert heavy and all(r["lo"] == r["hi"] for r in heavy)


def test_dense_index_breaks_ties_with_the_second_key(df, rows):
    got = O.dense_index(df, ["g"], ["v", "id"]).toPandas().sort_values("id")
    want = rows.sort_values(["v", "id"]).groupby("g").cumcount().sort_index()
    assert (got["idx"].to_numpy() == want.to_numpy()).all()


def test_exact_quantiles(df, rows):
    probs = [0.0, 0.05, 0.37, 0.5, 0.9, 1.0]
    got = {(r["g"], r["prob"]): r["quantile"] for r in O.exact_quantiles(df, ["g"], "v", probs).collect()}
    for g, part in rows.groupby("g"):
        for p in probs:
            assert got[(g, p)] == pytest.approx(np.quantile(part.v, p), abs=1e-12)


def test_average_rank(df, rows):
    got = O.average_rank(df, ["g"], "v", "r").toPandas().sort_values("id")
    want = rows.groupby("g").v.rank()
    assert np.allclose(got["r"], want)


def test_running_sum_and_neighbour(df, rows):
    indexed = O.dense_index(df, ["g"], ["id"])
    run = O.running_sum(indexed, ["g"], ["idx"], "v", "s").toPandas().sort_values("id")
    assert np.allclose(run["s"], rows.groupby("g").v.cumsum())
    near = O.neighbour(indexed, ["g"], "idx", ["v"], "p_").toPandas().sort_values("id")
    assert np.allclose(near["p_v"], rows.groupby("g").v.shift(1), equal_nan=True)
    after = O.neighbour(indexed, ["g"], "idx", ["v"], "n_", forward=True).toPandas().sort_values("id")
    assert np.allclose(after["n_v"], rows.groupby("g").v.shift(-1), equal_nan=True)


def test_rolling_crosses_chunks(spark, rows):
    df = spark.createDataFrame(rows.assign(idx=rows.groupby("g").cumcount()))
    halo = O.halo_blocks(df, ["g"], "idx", 3, 2, size=10)
    assert halo.where("_own").count() == len(rows)
    got = O.rolling(df, ["g"], "idx", 10, 10, {"m": F.avg("v")}).toPandas().sort_values("id")
    want = rows.groupby("g").v.transform(lambda s: s.rolling(21, center=True, min_periods=1).mean())
    assert np.allclose(got["m"], want)


def test_longest_run_first_wins(df, rows):
    indexed = O.dense_index(df, ["g"], ["id"])
    got = {r["g"]: (r["start"], r["stop"]) for r in O.longest_true_run(indexed, ["g"], "idx", F.col("ok")).collect()}
    for g, part in rows.groupby("g"):
        best, start = (0, 0), None
        for i, v in enumerate([*part.ok, False]):
            if v and start is None:
                start = i
            if not v and start is not None:
                if i - start > best[1] - best[0]:
                    best = (start, i)
                start = None
        assert got[g] == best


def test_largest_gap(df, rows, spark):
    got = {r["g"]: r["largest_gap"] for r in O.largest_gap(df, ["g"], "v").collect()}
    for g, part in rows.groupby("g"):
        assert got[g] == pytest.approx(np.diff(np.sort(part.v)).max())
    one = spark.createDataFrame([(1, 2.0), (2, 3.0), (2, 3.0)], "g int, v double")
    assert {r["g"]: r["largest_gap"] for r in O.largest_gap(one, ["g"], "v").collect()} == {1: None, 2: 0.0}
