"""Every registered query against its SQL, once as one block and once cut into blocks."""

import math

import pytest

import __spark_entry__ as entry
from tests.conftest import FOLDER

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
BLOCKED = ["metrics_by_scope", "level_uncertainty", "nearest_position", "window_lookup", "rolling_mean", "increments",
           "largest_gap", "spearman_rank", "longest_run_span", "on_interval", "block_bootstrap", "plane_detrend",
           "anchor_calibration", "source_inventory", "causal_context"]


def clean(v):
    return "NaN" if isinstance(v, float) and math.isnan(v) else v


def compare(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted((tuple(clean(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in ORACLES:
        assert got
        return
    cur = duck.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(clean(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    compare(spark, duck, name)


@pytest.mark.parametrize("name", BLOCKED)
def test_query_in_blocks(spark, duck, small_blocks, name):
    compare(spark, duck, name)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
