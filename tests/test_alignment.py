"""Hand cases of the alignment joins."""

import pytest
from pyspark.sql import functions as F

from trackloom.operators import joins as J


@pytest.fixture
def points(spark):
    return spark.createDataFrame([(1, i, 20.0 + 0.5 * i) for i in range(10)] + [(2, 0, 5.0)], "track_id int, seg int, x double")


def probe(spark, *xs, track=1):
    return spark.createDataFrame([(track, i, float(x)) for i, x in enumerate(xs)], "track_id int, pid int, xq double")


def test_nearest_tie_takes_lower_index_and_ends_are_inside(spark, points):
    out = J.nearest_position(probe(spark, 20.25, 20.0, 24.5, 24.51, 19.99, 22.3), points, ["track_id"], "xq", "x", "seg", "pid")
    got = {r["pid"]: r["selected_index"] for r in out.collect()}
    assert got == {0: 0, 1: 0, 2: 9, 3: None, 4: None, 5: 5}


def test_nearest_with_many_probes_at_one_place(spark, points, small_blocks):
    out = J.nearest_position(probe(spark, *[21.2] * 400, 20.6), points, ["track_id"], "xq", "x", "seg", "pid")
    picks = {r["selected_index"] for r in out.collect()}
    assert picks == {2, 1} and out.count() == 401


def test_window_clips_and_falls_back_to_nearest(spark, points):
    got = {r["pid"]: (r["index_start"], r["index_end"]) for r in J.window_lookup(
        probe(spark, 21.0, 20.1, 20.2, 24.5), points, ["track_id"], "xq", "x", "seg", 0.05, "pid").collect()}
    assert got == {0: (2, 3), 1: (0, 1), 2: (0, 1), 3: (9, 10)}
    wide = J.window_lookup(probe(spark, 24.4), points, ["track_id"], "xq", "x", "seg", 0.5, "pid").first()
    assert (wide["index_start"], wide["index_end"], wide["x_end"]) == (8, 10, 24.5)


def test_tiles_at_bin_edges_ties_and_context(spark):
    tiles = spark.createDataFrame([(3, 0, 20.0, 27.5, 0.0075), (2, 1, 25.0, 32.5, 0.0075), (1, 2, 30.0, 37.5, 0.0075)],
                                  "tile_id int, tile_order int, xmin double, xmax double, px_mm double")
    xs = spark.createDataFrame([(i, x) for i, x in enumerate([20.0, 25.0, 26.25, 31.25, 37.5, 40.0])], "sid int, x double")
    out = J.best_tiles(xs, tiles, ["sid"], "x", 1.4, 1000, 2.5).withColumn("o", J.tile_outcome())
    got = {r["sid"]: (r["mapped"]["tile_id"] if r["mapped"] else None, r["o"]) for r in out.collect()}
    assert got[0] == (3, "context_not_supported")
    assert got[1] == (3, "available")
    assert got[4] == (1, "context_not_supported")
    assert got[5] == (None, "outside_tiles")
    assert got[2][0] in (2, 3) and got[3][0] in (1, 2)


def test_equal_edges_take_the_first_tile_in_order(spark):
    tiles = spark.createDataFrame([(7, 1, 20.0, 30.0, 0.01), (8, 0, 20.0, 30.0, 0.01)],
                                  "tile_id int, tile_order int, xmin double, xmax double, px_mm double")
    xs = spark.createDataFrame([(0, 25.0)], "sid int, x double")
    assert J.best_tiles(xs, tiles, ["sid"], "x", 0.0, 1000, 2.5).first()["mapped"]["tile_id"] == 8


def test_causal_context_pads_gaps(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 1, 3.0), (1, 3, 5.0)], "g int, i int, v double")
    got = {(r["i"], r["previous_count"]): (r["context_mean"], r["context_change"], r["padded"])
           for r in J.causal_context(df, ["g"], "i", "v").collect()}
    assert got[(1, 1)] == (2.0, 2.0, False)
    assert got[(3, 1)] == (5.0, 0.0, True)
    assert got[(3, 2)] == (pytest.approx(13 / 3), 2.0, True)
    assert got[(0, 4)] == (1.0, 0.0, True)


def test_table_diff_tolerance_and_one_ulp(spark):
    a = spark.createDataFrame([(1, 1.0, "a/b"), (2, 1.0, "x"), (3, None, None), (4, 2.0, "y")], "k int, v double, p string")
    b = spark.createDataFrame([(1, 1.0000000000000002, "a\\b"), (2, 1.0 + 1e-6, "x"), (3, None, ""), (5, 2.0, "y")], "k int, v double, p string")
    got = {(r["k"], r["field"], r["category"]) for r in J.table_diff(a, b, ["k"], tolerance={"v": 1e-9}, paths=["p"]).collect()}
    assert got == {(2, "v", "tolerance"), (4, "row", "missing_right"), (5, "row", "missing_left")}
    assert {r["field"] for r in J.table_diff(a, b, ["k"], exact=["v"]).where("k = 1").collect()} == {"v"}


def test_multiset_gap_counts_repeats(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "i int")
    b = spark.createDataFrame([(1,), (2,), (3,)], "i int")
    assert tuple(J.multiset_gap(a, b).first()) == (1, 1, False)
    assert J.multiset_gap(a, a).first()["equal"]


def test_tolerance_join_across_cell_edge(spark):
    a = spark.createDataFrame([(1, 0.0999999), (1, 0.15)], "g int, x double")
    b = spark.createDataFrame([(1, 0.1000001), (1, 0.2)], "g int, y double")
    assert J.tolerance_join(a, b, ["g"], "x", "y", 1e-6, 0.1).count() == 1
    assert J.tolerance_join(a, b, ["g"], "x", "y", 1e-8, 0.1).count() == 0


def test_fold_roles_have_no_leak(spark):
    df = spark.createDataFrame([(t, i) for t in (8, 10, 14) for i in range(3)], "track int, i int")
    roles = J.fold_roles(df, "track", [8, 10, 14])
    assert roles.count() == 27 and roles.where("role = 'validation'").count() == 9
    assert J.role_leaks(roles, "track").where("leak").isEmpty()
    assert not J.role_leaks(roles.unionByName(roles.withColumn("role", F.lit("train"))), "track").where("leak").isEmpty()
