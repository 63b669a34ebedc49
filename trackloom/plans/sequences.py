"""Queries: ordered positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import scalars as S
from trackloom.functions.scalars import d
from trackloom.operators import metrics as M
from trackloom.operators import ordered as O
from trackloom.operators import sequence as Q
from trackloom.plans import fixtures as X
from trackloom.plans.registry import query
from trackloom.session import materialize


def indexed(t):
    """Positions with a dense index over the kept rows."""
    return O.dense_index(X.positions(t, blocks=True), ["track_id"], ["seg"], "pos", reuse_blocks=True)


@query("rolling_mean", X.with_sql(X.POSITIONS) + """SELECT track_id, seg, avg(y) OVER (PARTITION BY track_id ORDER BY seg
  ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS roll FROM positions""", "roll")
def rolling_mean(t):
    """Centred +-10 row mean, cut at the ends."""
    return O.rolling(indexed(t), ["track_id"], "pos", 10, 10, {"roll": F.avg("y")}).select("track_id", "seg", "roll")


@query("increments", X.with_sql(X.POSITIONS) + """SELECT track_id, seg, seg - lag(seg) OVER w AS index_increment, x_mm - lag(x_mm) OVER w AS x_increment,
  abs(y - lag(y) OVER w) AS value_change, coalesce(abs(y - lag(y) OVER w) = 0, false) AS duplicate, coalesce(abs(y - lag(y) OVER w) < 1e-6, false) AS near_duplicate
FROM positions WINDOW w AS (PARTITION BY track_id ORDER BY seg)""", "x_increment value_change")
def increments(t):
    """Change from the previous row and repeat flags."""
    return Q.increments(X.positions(t, blocks=True), ["track_id"], "seg", "x_mm", "y")


@query("expected_index", X.with_sql(X.POSITIONS) + """SELECT track_id, count(*) AS n, count(*) FILTER (WHERE event_id <> seg + start) AS violations FROM positions
JOIN (SELECT track_id, min(event_id) AS start FROM all_positions GROUP BY 1) USING (track_id) GROUP BY 1""")
def expected_index(t):
    """Raw index must equal segment index plus the start."""
    from trackloom.session import attach
    every = X.all_positions(t)
    start = every.groupBy("track_id").agg(F.min("event_id").alias("start"))
    rows = attach(every.where("event_type <> 'error'"), start, ["track_id"])
    return rows.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(
        F.col("event_id") != F.col("seg") + F.col("start")).alias("violations"))


@query("largest_gap", X.with_sql(X.POSITIONS) + """SELECT track_id, max(g) AS largest_gap, max(g) > 0.6e0 AS large_gap FROM (
  SELECT track_id, x_mm - lag(x_mm) OVER (PARTITION BY track_id ORDER BY x_mm) AS g FROM positions) GROUP BY 1""", "largest_gap")
def largest_gap(t):
    """Largest gap in sorted x per track."""
    gaps = O.largest_gap(X.positions(t), ["track_id"], "x_mm")
    return gaps.withColumn("large_gap", F.col("largest_gap") > d(0.6))


@query("spearman_rank", """WITH r AS (SELECT CAST(l_suppkey % 4 AS INT) AS track_id, l_quantity, l_discount,
  rank() OVER (PARTITION BY l_suppkey % 4 ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey % 4, l_quantity) - 1) / 2e0 AS ra,
  rank() OVER (PARTITION BY l_suppkey % 4 ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_suppkey % 4, l_extendedprice) - 1) / 2e0 AS rb FROM lineitem)
SELECT track_id, corr(ra, rb) AS spearman FROM r GROUP BY 1""", "spearman")
def spearman_rank(t):
    """Rank correlation with average ranks."""
    rows = t.lineitem.select((F.col("l_suppkey") % 4).cast("int").alias("track_id"), "l_quantity", "l_extendedprice")
    return M.rank_correlation(rows, ["track_id"], "l_quantity", "l_extendedprice")


RUN_SQL = X.with_sql(X.POSITIONS, """
marked AS (SELECT track_id, seg, row_number() OVER (PARTITION BY track_id ORDER BY seg) - row_number() OVER (PARTITION BY track_id, y < 60e0 ORDER BY seg) AS island,
  y < 60e0 AS flag FROM all_positions),
runs AS (SELECT track_id, min(seg) AS start, max(seg) + 1 AS stop, count(*) AS run_length FROM marked WHERE flag GROUP BY track_id, island)""")


@query("longest_run", RUN_SQL + "SELECT track_id, max(run_length) AS longest FROM runs GROUP BY 1")
def longest_run(t):
    """Length of the longest true run."""
    runs = O.true_runs(X.all_positions(t), ["track_id"], "seg", F.col("y") < 60)
    return runs.groupBy("track_id").agg(F.max("run_length").alias("longest"))


@query("longest_run_span", RUN_SQL + """SELECT track_id, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, run_length FROM (
  SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY run_length DESC, start) AS rn FROM runs) WHERE rn = 1""")
def longest_run_span(t):
    """Span of the longest true run, first on ties."""
    return O.longest_true_run(X.all_positions(t), ["track_id"], "seg", F.col("y") < 60)


# The activity score of a position is its event value.
def active_sql() -> str:
    """The active interval of a CTE ``scores`` (track_id, frame, score, idx)."""
    return """
sized AS (SELECT *, count(*) OVER (PARTITION BY track_id) AS n, min(score) OVER (PARTITION BY track_id) AS lo, max(score) OVER (PARTITION BY track_id) AS hi FROM scores),
lead_in AS (SELECT * FROM sized WHERE idx < greatest(5, CAST(floor(n / 10e0) AS BIGINT))),
med AS (SELECT track_id, median(score) AS med FROM lead_in GROUP BY 1),
mad AS (SELECT track_id, median(abs(score - med)) AS mad FROM lead_in JOIN med USING (track_id) GROUP BY 1),
level AS (SELECT s.track_id, any_value(n) AS n, greatest(any_value(lo) + 0.2e0 * (any_value(hi) - any_value(lo)), any_value(med) + 8e0 * greatest(1.4826e0 * any_value(mad), 1e-12)) AS threshold
  FROM sized s JOIN med USING (track_id) JOIN mad USING (track_id) GROUP BY 1),
flags AS (SELECT s.track_id, idx, idx - row_number() OVER (PARTITION BY s.track_id ORDER BY idx) AS island FROM scores s JOIN level l ON s.track_id = l.track_id AND score > threshold),
spans AS (SELECT track_id, min(idx) AS start, max(idx) + 1 AS stop, count(*) AS run_length FROM flags GROUP BY track_id, island),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY run_length DESC, start) AS rn FROM spans) WHERE rn = 1),
active AS (SELECT l.track_id, n, threshold, start, stop, run_length FROM level l LEFT JOIN best b USING (track_id))
"""


ACTIVE_SQL = X.with_sql(X.POSITIONS, "scores AS (SELECT track_id, event_id AS frame, y AS score, seg AS idx FROM all_positions)," + active_sql())


def scores(t):
    return X.all_positions(t).select("track_id", F.col("event_id").alias("frame"), F.col("y").alias("score"),
                                     F.col("seg").cast("long").alias("idx"), O.BLOCK)


@query("on_interval", ACTIVE_SQL + "SELECT * FROM active", "threshold")
def on_interval(t):
    """Active interval from ordered scores."""
    return Q.active_interval(scores(t), ["track_id"], "idx", "score")


@query("final_segment", ACTIVE_SQL + """SELECT s.track_id, frame, idx, 100e0 - ((stop - idx) - 0.5e0) * 0.2e0 AS x_mm FROM scores s JOIN active a USING (track_id)
WHERE idx >= greatest(0, stop - 400) AND idx < stop""", "x_mm")
def final_segment(t):
    """The last 400 frames before the end of the run and their x."""
    rows = scores(t)
    interval = Q.active_interval(rows, ["track_id"], "idx", "score")
    return Q.final_segment(rows, ["track_id"], "idx", interval).select("track_id", "frame", "idx", "x_mm")


@query("grid_bins", X.with_sql(X.PROBES) + """SELECT track_id, CAST(floor((x_req - 20e0) / 0.2e0) AS BIGINT) AS bin, count(*) AS n,
  20e0 + 0.2e0 * (CAST(floor((x_req - 20e0) / 0.2e0) AS BIGINT) + 0.5e0) AS bin_centre FROM probes GROUP BY 1, 2""", "bin_centre")
def grid_bins(t):
    """Half-open membership on the 0.2 mm grid."""
    b = S.grid_bin(F.col("x_req"))
    return X.probes(t).groupBy("track_id", b.alias("bin")).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "bin_centre", S.position_mm(F.col("bin")))


@query("exemplars", X.with_sql(X.POSITIONS) + """, n AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY seg) - 1 AS pos, count(*) OVER (PARTITION BY track_id) - 1 AS last FROM positions)
SELECT track_id, seg, y, CASE WHEN pos = 0 THEN 'begin' WHEN pos = last THEN 'end' ELSE 'middle' END AS kind FROM n
WHERE pos = 0 OR pos = last OR pos = CAST(floor(last / 2e0) AS BIGINT)""", "y")
def exemplars(t):
    """Begin, middle and end rows per track."""
    return Q.exemplars(indexed(t), ["track_id"], "pos").select("track_id", "seg", "y", "kind")


@query("boundary_exemplars", X.with_sql(X.POSITIONS) + """SELECT track_id, seg, y, 'near_boundary' AS kind FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY y <= 95e0, seg) AS rn FROM positions) WHERE rn = 1""", "y")
def boundary_exemplars(t):
    """The first boundary case per track."""
    return Q.boundary_exemplars(X.positions(t).select("track_id", "seg", "y"), ["track_id"], "seg", F.col("y") > 95)


@query("monotonic_check", X.with_sql(X.POSITIONS) + """SELECT track_id, count(*) AS n, count(DISTINCT seg) AS distinct_index, coalesce(bool_and(x_mm > px), true) AS strictly_increasing
FROM (SELECT *, lag(x_mm) OVER (PARTITION BY track_id ORDER BY seg) AS px FROM positions) GROUP BY 1""")
def monotonic_check(t):
    """Row counts, uniqueness and strictly increasing x."""
    near = O.neighbour(X.positions(t, blocks=True), ["track_id"], "seg", ["x_mm"], "p_")
    return near.groupBy("track_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("seg").alias("distinct_index"),
        F.coalesce(F.bool_and(F.col("x_mm") > F.col("p_x_mm")), F.lit(True)).alias("strictly_increasing"))


BOOT_SQL = X.with_sql(X.PREDICTIONS, """
paired AS (SELECT track_id, seg, row_number() OVER (PARTITION BY track_id ORDER BY seg) - 1 AS pos,
  max(CASE WHEN model_id = 'track_mean' THEN abs(p - y) END) - max(CASE WHEN model_id = 'previous' THEN abs(p - y) END) AS diff,
  max(CASE WHEN model_id = 'track_mean' THEN abs(p - y) END) AS base FROM predictions GROUP BY 1, 2),
sized AS (SELECT track_id, count(*) AS n, CAST(ceil(count(*) / 25e0) AS BIGINT) AS k FROM paired GROUP BY 1),
upto AS (SELECT track_id, pos, sum(diff) OVER (PARTITION BY track_id ORDER BY pos) - diff AS before FROM paired
  UNION ALL SELECT track_id, count(*), sum(diff) FROM paired GROUP BY 1),
draw_list AS (SELECT unnest(range(0, 2000)) AS draw),
plan AS (SELECT track_id, n, k, draw, unnest(range(0, k)) AS j FROM sized CROSS JOIN draw_list),
starts AS (SELECT *, CAST(concat('0x', substr(md5(draw || '_' || j), 1, 15)) AS BIGINT) % (n - 25 + 1) AS s,
  CASE WHEN j = k - 1 THEN n - (k - 1) * 25 ELSE 25 END AS len FROM plan),
draws AS (SELECT s.track_id, draw, sum(b.before - a.before) / any_value(n) AS mean_difference FROM starts s
  JOIN upto a ON a.track_id = s.track_id AND a.pos = s.s JOIN upto b ON b.track_id = s.track_id AND b.pos = s.s + s.len GROUP BY 1, 2),
ci AS (SELECT track_id, quantile_cont(mean_difference, 0.025) AS ci_low, quantile_cont(mean_difference, 0.975) AS ci_high FROM draws GROUP BY 1),
point AS (SELECT track_id, avg(diff) AS gain, avg(diff) / avg(base) AS relative_gain FROM paired GROUP BY 1)""")


def paired_errors(t):
    """track_id, seg, dense pos, error difference of the two models."""
    e = F.abs(F.col("p") - F.col("y"))
    rows = X.predictions(t, blocks=True).groupBy("track_id", "seg", O.BLOCK).agg(
        F.max(F.when(F.col("model_id") == "track_mean", e)).alias("base"),
        F.max(F.when(F.col("model_id") == "previous", e)).alias("other"))
    rows = rows.withColumn("diff", F.col("base") - F.col("other"))
    return materialize(O.dense_index(rows, ["track_id"], ["seg"], "pos", reuse_blocks=True))


@query("block_bootstrap", BOOT_SQL + "SELECT * FROM ci", "ci_low ci_high")
def block_bootstrap(t):
    """95% interval of the paired error difference, 2000 draws of 25-row blocks."""
    draws = Q.block_bootstrap(paired_errors(t), ["track_id"], "pos", "diff", 25, 2000)
    return Q.bootstrap_interval(draws, ["track_id"])


@query("interval_rule", BOOT_SQL + "SELECT *, ci_low > 0 AND relative_gain >= 0.05e0 AS confirmed FROM ci JOIN point USING (track_id)", "ci_low ci_high gain relative_gain")
def interval_rule(t):
    """Q2: confirmed when the interval is above zero and the gain is at least 5%."""
    rows = paired_errors(t)
    ci = Q.bootstrap_interval(Q.block_bootstrap(rows, ["track_id"], "pos", "diff", 25, 2000), ["track_id"])
    point = rows.groupBy("track_id").agg(F.avg("diff").alias("gain"), (F.avg("diff") / F.avg("base")).alias("relative_gain"))
    return ci.join(point, "track_id").withColumn("confirmed", M.interval_rule(F.col("ci_low"), F.col("relative_gain")))
