"""Queries: height profiles, labels and acceptance gates.

Columns of the height grid are the vectors of a track in id order, 40 um apart;
a cell is missing where |v| > 0.1.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import scalars as S
from trackloom.functions.scalars import d
from trackloom.operators import gates as G
from trackloom.operators import labels as L
from trackloom.operators import metrics as M
from trackloom.operators import ordered as O
from trackloom.operators import profiles as P

from trackloom.plans import fixtures as X
from trackloom.plans.registry import query
from trackloom.session import materialize

POS = ["track_id", "x_um"]
RUN = ["track_id", "x_um", "run"]
AGG_RUNS = ["25", "50", "100"]
ALTERNATES = ["25", "control_c", "control_d"]


def column_index(t):
    ids = t.embeddings.select("vec_id", (F.col("label") % 3).cast("int").alias("track_id"))
    return O.dense_index(ids, ["track_id"], ["vec_id"], "idx").select(
        "vec_id", "track_id", "idx", (F.col("idx") * 40).alias("x_um"))


def height_columns(t):
    at = column_index(t).select("vec_id", "x_um")
    cells = t.embeddings.select("vec_id", (F.col("label") % 3).cast("int").alias("track_id"), "embedding").join(at, "vec_id")
    v = F.col("v0").cast("double")
    return cells.select("track_id", "x_um", F.posexplode("embedding").alias("iy", "v0")).select(
        "track_id", "x_um", "iy", (d(0.05) + F.col("iy") * d(1.80) / d(63)).alias("y_mm"), F.when(F.abs(v) <= d(0.1), v).alias("z"))


def cell_count(t) -> int:
    """The cells of the height grid, about: what its operators spread their rows by."""
    return max(0, t.embeddings.agg(F.sum(F.size("embedding"))).first()[0] or 0)


def run_profiles(t, cells):
    """Window medians at three half widths and the two control levellings, five rows a cell."""
    runs = P.window_profiles(height_columns(t), ["track_id"], "x_um", [25, 50, 100], rows=cells)
    runs = runs.withColumn("run", F.col("run").cast("string"))
    c = P.side_detrend(runs.where("run = '50'"), RUN, 2, cells).withColumn("run", F.lit("control_c"))
    l = P.side_detrend(runs.where("run = '25'"), RUN, 1, cells).withColumn("run", F.lit("control_d"))
    return runs.unionByName(c).unionByName(l)


COLUMNS_SQL = """
col_index AS (SELECT vec_id, CAST(label % 3 AS INT) AS track_id, row_number() OVER (PARTITION BY label % 3 ORDER BY vec_id) - 1 AS idx FROM embeddings),
height_columns AS (SELECT c.track_id, c.idx * 40 AS x_um, CAST(i - 1 AS INT) AS iy, 0.05e0 + (i - 1) * 1.80e0 / 63e0 AS y_mm,
  CASE WHEN abs(CAST(embedding[i] AS DOUBLE)) <= 0.1e0 THEN CAST(embedding[i] AS DOUBLE) END AS z FROM embeddings e JOIN col_index c USING (vec_id), range(1, 65) t(i)),
agg_runs AS (
  SELECT track_id, x_um, iy, y_mm, '25' AS run, median(z) OVER (PARTITION BY track_id, iy ORDER BY x_um RANGE BETWEEN 25 PRECEDING AND 25 FOLLOWING) AS z FROM height_columns UNION ALL
  SELECT track_id, x_um, iy, y_mm, '50', median(z) OVER (PARTITION BY track_id, iy ORDER BY x_um RANGE BETWEEN 50 PRECEDING AND 50 FOLLOWING) FROM height_columns UNION ALL
  SELECT track_id, x_um, iy, y_mm, '100', median(z) OVER (PARTITION BY track_id, iy ORDER BY x_um RANGE BETWEEN 100 PRECEDING AND 100 FOLLOWING) FROM height_columns)"""

# Side-band fits in centred form: line for control_d, parabola for control_c.
CONTROLS_SQL = """
sided AS (SELECT * FROM agg_runs WHERE z IS NOT NULL AND (y_mm BETWEEN 0.05e0 AND 0.45e0 OR y_mm BETWEEN 1.50e0 AND 1.85e0)),
side_mean AS (SELECT track_id, x_um, run, avg(y_mm) AS y0, avg(z) AS z0, count(*) AS n FROM sided GROUP BY 1, 2, 3),
side_mom AS (SELECT s.track_id, s.x_um, s.run, any_value(y0) AS y0, any_value(z0) AS z0, any_value(n) AS n, sum(power(y_mm - y0, 2)) AS s2, sum(power(y_mm - y0, 3)) AS s3, sum(power(y_mm - y0, 4)) AS s4,
  sum((y_mm - y0) * (z - z0)) AS t1, sum((y_mm - y0) * (y_mm - y0) * (z - z0)) AS t2 FROM sided s JOIN side_mean m ON s.track_id = m.track_id AND s.x_um = m.x_um AND s.run = m.run GROUP BY 1, 2, 3),
side_fit AS (SELECT *, CASE WHEN s2 <> 0 THEN t1 / s2 END AS k1, CASE WHEN s2 * (s4 - s2 * s2 / n) - s3 * s3 <> 0 THEN (t1 * (s4 - s2 * s2 / n) - t2 * s3) / (s2 * (s4 - s2 * s2 / n) - s3 * s3) END AS b,
  CASE WHEN s2 * (s4 - s2 * s2 / n) - s3 * s3 <> 0 THEN (t2 * s2 - t1 * s3) / (s2 * (s4 - s2 * s2 / n) - s3 * s3) END AS c FROM side_mom),
run_profiles AS (SELECT * FROM agg_runs UNION ALL
  SELECT a.track_id, a.x_um, iy, y_mm, 'control_c', z - (z0 + b * (y_mm - y0) + c * ((y_mm - y0) * (y_mm - y0) - s2 / n)) FROM agg_runs a LEFT JOIN side_fit f ON a.track_id = f.track_id AND a.x_um = f.x_um AND a.run = f.run WHERE a.run = '50' UNION ALL
  SELECT a.track_id, a.x_um, iy, y_mm, 'control_d', z - (z0 + k1 * (y_mm - y0)) FROM agg_runs a LEFT JOIN side_fit f ON a.track_id = f.track_id AND a.x_um = f.x_um AND a.run = f.run WHERE a.run = '25')"""

EDGES_SQL = """
taps AS (SELECT k, exp(-0.5e0 * power(k / 2e0, 2)) / sum(exp(-0.5e0 * power(k / 2e0, 2))) OVER () AS w FROM (SELECT unnest(range(-8, 9)) AS k)),
blended AS (SELECT p.track_id, p.x_um, p.run, p.iy, sum(w * coalesce(q.z, 0e0)) AS num, sum(CASE WHEN q.z IS NULL THEN 0e0 ELSE w END) AS den FROM run_profiles p CROSS JOIN taps
  JOIN run_profiles q ON p.track_id = q.track_id AND p.x_um = q.x_um AND p.run = q.run AND q.iy = CASE WHEN p.iy + k < 0 THEN -(p.iy + k) - 1 WHEN p.iy + k > 63 THEN 127 - p.iy - k ELSE p.iy + k END GROUP BY 1, 2, 3, 4),
smoothed AS (SELECT p.*, CASE WHEN count(z) OVER (PARTITION BY p.track_id, p.x_um, p.run) >= 5 AND den > 0.25e0 THEN num / den END AS smooth
  FROM run_profiles p JOIN blended b ON p.track_id = b.track_id AND p.x_um = b.x_um AND p.run = b.run AND p.iy = b.iy),
bracket AS (SELECT *, last_value(CASE WHEN smooth IS NOT NULL THEN y_mm END IGNORE NULLS) OVER up AS ya, last_value(smooth IGNORE NULLS) OVER up AS fa,
  first_value(CASE WHEN smooth IS NOT NULL THEN y_mm END IGNORE NULLS) OVER dn AS yb, first_value(smooth IGNORE NULLS) OVER dn AS fb FROM smoothed
  WINDOW up AS (PARTITION BY track_id, x_um, run ORDER BY iy ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), dn AS (PARTITION BY track_id, x_um, run ORDER BY iy ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT *, coalesce(smooth, fa + (y_mm - ya) * (fb - fa) / (yb - ya), fa, fb) AS f FROM bracket),
steps AS (SELECT *, lag(f) OVER w AS fp, lead(f) OVER w AS fn, y_mm - lag(y_mm) OVER w AS hs, lead(y_mm) OVER w - y_mm AS hd FROM filled WINDOW w AS (PARTITION BY track_id, x_um, run ORDER BY iy)),
graded AS (SELECT *, coalesce((hs * hs * fn + (hd * hd - hs * hs) * f - hd * hd * fp) / (hs * hd * (hs + hd)), (fn - f) / hd, (f - fp) / hs) AS g FROM steps),
picks AS (SELECT track_id, x_um, run, count(z) AS finite_count, count(smooth) AS ok,
  max({'g': round(g, 9), 'i': -iy, 'y': y_mm, 'z': z}) FILTER (WHERE y_mm BETWEEN 0.5e0 AND 0.975e0) AS l, min({'g': round(g, 9), 'i': iy, 'y': y_mm, 'z': z}) FILTER (WHERE y_mm BETWEEN 0.975e0 AND 1.45e0) AS r FROM graded GROUP BY 1, 2, 3),
judged AS (SELECT *, CASE WHEN ok < 20 THEN 'insufficient_finite_profile' WHEN r.i <= -l.i THEN 'boundaries_cross' ELSE 'ok' END AS status FROM picks),
edges AS (SELECT track_id, x_um, run, finite_count, status, CASE WHEN status = 'ok' THEN l.y END AS left_, CASE WHEN status = 'ok' THEN r.y END AS right_,
  CASE WHEN status = 'ok' THEN abs(l.g) END AS left_gradient, CASE WHEN status = 'ok' THEN abs(r.g) END AS right_gradient, CASE WHEN status = 'ok' THEN l.z END AS left_height, CASE WHEN status = 'ok' THEN r.z END AS right_height FROM judged)"""

WITH_COLUMNS = X.with_sql(COLUMNS_SQL)
WITH_EDGES = X.with_sql(COLUMNS_SQL, CONTROLS_SQL, EDGES_SQL)


def edges(t):
    cells = cell_count(t)
    return P.edge_finder(run_profiles(t, cells), RUN, 5 * cells)


@query("profile_median", WITH_COLUMNS + "SELECT track_id, x_um, iy, run, z FROM agg_runs", "z")
def profile_median(t):
    """Median profile over a window of columns, three half widths."""
    runs = P.window_profiles(height_columns(t), ["track_id"], "x_um", [25, 50, 100], rows=cell_count(t))
    return runs.select("track_id", "x_um", "iy", F.col("run").cast("string").alias("run"), "z")


SMOOTH_SQL = X.with_sql(X.PROFILES, "run_profiles AS (SELECT vec_id AS track_id, 0 AS x_um, 'raw' AS run, iy, y_mm, z FROM profiles)", EDGES_SQL)


@query("smooth_profile", SMOOTH_SQL + "SELECT track_id AS vec_id, iy, smooth, f AS filled, g AS gradient FROM graded", "smooth filled gradient")
def smooth_profile(t):
    """Missing-aware smoothing, gap fill and gradient."""
    rows = P.filled_gradient(P.smooth(X.profiles(t), ["vec_id"], cell_count(t)), ["vec_id"])
    return rows.select("vec_id", "iy", "smooth", "filled", "gradient")


@query("edge_finder", WITH_EDGES + """SELECT track_id, x_um, run, finite_count, status, left_ AS "left", right_ AS "right", right_ - left_ AS width, (left_ + right_) / 2 AS centre,
  left_gradient, right_gradient, left_height, right_height FROM edges""", '"left" "right" width centre left_gradient right_gradient left_height right_height')
def edge_finder(t):
    """Edges of every profile run with their status."""
    return edges(t)


BANDS_SQL = """
base_profiles AS (SELECT track_id, x_um, iy, y_mm, z FROM run_profiles WHERE run = '100'),
banded AS (SELECT *, CASE WHEN y_mm BETWEEN 0.05e0 AND 0.45e0 THEN 'left' WHEN y_mm BETWEEN 1.5e0 AND 1.85e0 THEN 'right' END AS side FROM base_profiles),
bmed AS (SELECT track_id, x_um, side, median(z) AS med FROM banded WHERE side IS NOT NULL GROUP BY 1, 2, 3),
bmad AS (SELECT b.track_id, b.x_um, b.side, any_value(med) AS med, 1.4826e0 * median(abs(z - med)) AS mad, avg(CASE WHEN z IS NULL THEN 0e0 ELSE 1e0 END) AS vf, count(z) AS vc
  FROM banded b JOIN bmed m ON b.track_id = m.track_id AND b.x_um = m.x_um AND b.side = m.side GROUP BY 1, 2, 3),
whole AS (SELECT track_id, x_um, avg(CASE WHEN z IS NULL THEN 0e0 ELSE 1e0 END) AS valid_fraction, avg(CASE WHEN z IS NULL THEN 0e0 ELSE 1e0 END) FILTER (WHERE y_mm BETWEEN 0.5e0 AND 1.45e0) AS central_valid_fraction FROM base_profiles GROUP BY 1, 2),
bands AS (SELECT w.*, l.med AS left_baseline, l.mad AS left_noise, l.vf AS left_valid_fraction, l.vc AS left_valid_count, r.med AS right_baseline, r.mad AS right_noise, r.vf AS right_valid_fraction, r.vc AS right_valid_count
  FROM whole w JOIN bmad l ON w.track_id = l.track_id AND w.x_um = l.x_um AND l.side = 'left' JOIN bmad r ON w.track_id = r.track_id AND w.x_um = r.x_um AND r.side = 'right')"""


def base_profiles(t, cells):
    runs = P.window_profiles(height_columns(t), ["track_id"], "x_um", [100], rows=cells)
    return runs.drop("run")


@query("side_baseline", X.with_sql(COLUMNS_SQL, "run_profiles AS (SELECT * FROM agg_runs)", BANDS_SQL) + "SELECT * FROM bands",
       "valid_fraction central_valid_fraction left_baseline left_noise left_valid_fraction right_baseline right_noise right_valid_fraction")
def side_baseline(t):
    """Side-band baseline, noise and valid fractions."""
    cells = cell_count(t)
    return P.band_statistics(base_profiles(t, cells), POS, cells)


SUPPORT_SQL = """
spots AS (SELECT track_id, x_um, 'left' AS side, left_ AS spot FROM edges WHERE status = 'ok' AND run = '100' UNION ALL SELECT track_id, x_um, 'right', right_ FROM edges WHERE status = 'ok' AND run = '100'),
stepped AS (SELECT *, y_mm - lag(y_mm) OVER (PARTITION BY track_id, x_um ORDER BY iy) AS dy FROM base_profiles),
dys AS (SELECT track_id, x_um, median(dy) AS dy FROM stepped GROUP BY 1, 2),
around AS (SELECT s.track_id, s.x_um, side, iy, z IS NOT NULL AS ok, abs(y_mm - spot) AS dist, y_mm >= spot - 0.1e0 AND y_mm <= spot + 0.1e0 AS near FROM spots s JOIN base_profiles b ON s.track_id = b.track_id AND s.x_um = b.x_um),
isl AS (SELECT *, row_number() OVER (PARTITION BY track_id, x_um, side, near ORDER BY iy) - row_number() OVER (PARTITION BY track_id, x_um, side, near, ok ORDER BY iy) AS k FROM around),
lens AS (SELECT track_id, x_um, side, ok, count(*) AS len FROM isl WHERE near GROUP BY track_id, x_um, side, ok, k),
support AS (SELECT l.track_id, l.x_um, l.side, coalesce(max(len) FILTER (WHERE ok), 0) * any_value(dy) AS longest_valid_mm, coalesce(max(len) FILTER (WHERE NOT ok), 0) * any_value(dy) AS longest_gap_mm,
  CAST(coalesce(sum(len) FILTER (WHERE ok), 0) AS BIGINT) AS support_count FROM lens l JOIN dys d ON l.track_id = d.track_id AND l.x_um = d.x_um GROUP BY 1, 2, 3),
missing AS (SELECT track_id, x_um, side, min(dist) FILTER (WHERE NOT ok) AS nearest_missing_mm FROM around GROUP BY 1, 2, 3),
edge_support AS (SELECT s.*, m.nearest_missing_mm FROM support s JOIN missing m ON s.track_id = m.track_id AND s.x_um = m.x_um AND s.side = m.side)"""


@query("edge_support", WITH_EDGES + "," + BANDS_SQL + "," + SUPPORT_SQL + "SELECT * FROM edge_support", "longest_valid_mm longest_gap_mm nearest_missing_mm")
def edge_support(t):
    """Support next to each edge and distance to missing rows."""
    cells = cell_count(t)
    base = base_profiles(t, cells)
    return P.edge_support(base, P.edge_finder(base, POS, cells), POS, rows=cells)


SPREAD_SQL = """
wc AS (SELECT *, right_ - left_ AS w, (left_ + right_) / 2 AS c FROM edges),
spread AS (SELECT track_id, x_um,
  CASE WHEN count(w) FILTER (WHERE run = '100') > 0 AND count(w) FILTER (WHERE run IN ('25', '50', '100')) >= 2 THEN max(w) FILTER (WHERE run IN ('25', '50', '100')) - min(w) FILTER (WHERE run IN ('25', '50', '100')) END AS width_sensitivity,
  greatest(max(w) FILTER (WHERE run IN ('25', 'control_c', 'control_d')) - max(w) FILTER (WHERE run = '100'), max(w) FILTER (WHERE run = '100') - min(w) FILTER (WHERE run IN ('25', 'control_c', 'control_d'))) AS width_disagreement,
  CASE WHEN count(c) FILTER (WHERE run = '100') > 0 AND count(c) FILTER (WHERE run IN ('25', '50', '100')) >= 2 THEN max(c) FILTER (WHERE run IN ('25', '50', '100')) - min(c) FILTER (WHERE run IN ('25', '50', '100')) END AS centre_sensitivity,
  greatest(max(c) FILTER (WHERE run IN ('25', 'control_c', 'control_d')) - max(c) FILTER (WHERE run = '100'), max(c) FILTER (WHERE run = '100') - min(c) FILTER (WHERE run IN ('25', 'control_c', 'control_d'))) AS centre_disagreement
  FROM wc GROUP BY 1, 2)"""


@query("run_spread", WITH_EDGES + "," + SPREAD_SQL + "SELECT * FROM spread", "width_sensitivity width_disagreement centre_sensitivity centre_disagreement")
def run_spread(t):
    """Spread over aggregation widths and distance from the alternates."""
    return P.run_spread(edges(t), POS, "run", "100", AGG_RUNS, ALTERNATES)


@query("run_spread_sides", WITH_EDGES + "," + SPREAD_SQL.replace("right_ - left_ AS w, (left_ + right_) / 2 AS c", "left_ AS w, right_ AS c").replace(
    "width_", "left_").replace("centre_", "right_") + "SELECT * FROM spread", "left_sensitivity left_disagreement right_sensitivity right_disagreement")
def run_spread_sides(t):
    """Spread and disagreement of the left and right boundary."""
    return P.run_spread(edges(t), POS, "run", "100", AGG_RUNS, ALTERNATES, ("left", "right"))


def base_edges(t):
    cells = cell_count(t)
    e = P.edge_finder(base_profiles(t, cells), POS, cells)
    return e.withColumn("idx", (F.col("x_um") / 40).cast("long"))


BASE_EDGE_SQL = X.with_sql(COLUMNS_SQL, "run_profiles AS (SELECT * FROM agg_runs WHERE run = '100')", EDGES_SQL)


@query("neighbour_continuity", BASE_EDGE_SQL + """, w AS (SELECT track_id, x_um // 40 AS idx, right_ - left_ AS w FROM edges),
n AS (SELECT a.track_id, a.idx, a.w, p.w AS pw, q.w AS qw FROM w a LEFT JOIN w p ON a.track_id = p.track_id AND p.idx = a.idx - 1 LEFT JOIN w q ON a.track_id = q.track_id AND q.idx = a.idx + 1),
trio AS (SELECT *, list_filter([w, pw, qw], lambda x: x IS NOT NULL) AS l FROM n)
SELECT track_id, idx, CAST((pw IS NOT NULL)::INT + (qw IS NOT NULL)::INT AS INT) AS neighbours,
  CASE WHEN w IS NOT NULL AND coalesce(pw, qw) IS NOT NULL THEN (coalesce(abs(w - pw), 0e0) + coalesce(abs(w - qw), 0e0)) / ((pw IS NOT NULL)::INT + (qw IS NOT NULL)::INT) END AS neighbour_difference,
  CASE WHEN len(l) >= 2 THEN list_median(list_transform(l, lambda x: abs(x - list_median(l)))) END AS neighbourhood_mad FROM trio""", "neighbour_difference neighbourhood_mad")
def neighbour_continuity(t):
    """Continuity with the adjacent positions."""
    return P.neighbour_continuity(base_edges(t).select("track_id", "idx", "width"), ["track_id"], "idx", "width")


@query("neighbour_continuity_centre", BASE_EDGE_SQL + """, w AS (SELECT track_id, x_um // 40 AS idx, (left_ + right_) / 2 AS w FROM edges),
n AS (SELECT a.track_id, a.idx, a.w, p.w AS pw, q.w AS qw FROM w a LEFT JOIN w p ON a.track_id = p.track_id AND p.idx = a.idx - 1 LEFT JOIN w q ON a.track_id = q.track_id AND q.idx = a.idx + 1),
trio AS (SELECT *, list_filter([w, pw, qw], lambda x: x IS NOT NULL) AS l FROM n)
SELECT track_id, idx, CAST((pw IS NOT NULL)::INT + (qw IS NOT NULL)::INT AS INT) AS neighbours,
  CASE WHEN w IS NOT NULL AND coalesce(pw, qw) IS NOT NULL THEN (coalesce(abs(w - pw), 0e0) + coalesce(abs(w - qw), 0e0)) / ((pw IS NOT NULL)::INT + (qw IS NOT NULL)::INT) END AS neighbour_difference,
  CASE WHEN len(l) >= 2 THEN list_median(list_transform(l, lambda x: abs(x - list_median(l)))) END AS neighbourhood_mad FROM trio""", "neighbour_difference neighbourhood_mad")
def neighbour_continuity_centre(t):
    """Continuity of the centre with the adjacent positions."""
    return P.neighbour_continuity(base_edges(t).select("track_id", "idx", "centre"), ["track_id"], "idx", "centre")


@query("repeated_value_cap", BASE_EDGE_SQL + """, k AS (SELECT track_id, x_um, round(right_ - left_, 6) AS k FROM edges), c AS (SELECT k, count(*) AS n FROM k WHERE k IS NOT NULL GROUP BY 1)
SELECT track_id, x_um, coalesce(n, 0) AS repeat_count, coalesce(k.k = (SELECT max(k) FROM c) AND n >= 3, false) AS cap_flag, (SELECT max(k) FROM c) - k.k AS cap_distance FROM k LEFT JOIN c ON k.k = c.k""", "cap_distance")
def repeated_value_cap(t):
    """Repeated widths and the apparent cap."""
    return P.repeated_values(base_edges(t), "width").select("track_id", "x_um", "repeat_count", "cap_flag", "cap_distance")


@query("valid_run_label", X.with_sql("""
idx AS (SELECT vec_id, CAST(label % 3 AS INT) AS track_id, row_number() OVER (PARTITION BY label % 3 ORDER BY vec_id) - 1 AS idx, embedding FROM embeddings),
fr AS (SELECT track_id, CAST(floor(idx / 2e0) AS BIGINT) AS bin, CAST(i - 1 AS INT) AS iy, 0.05e0 + (i - 1) * 1.80e0 / 63e0 AS y_mm, avg(CASE WHEN embedding[i] > 0 THEN 1e0 ELSE 0e0 END) AS v0 FROM idx, range(1, 65) t(i) GROUP BY 1, 2, 3, 4),
sm AS (SELECT *, sum(v0) OVER (PARTITION BY track_id, bin ORDER BY iy ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5e0 AS v FROM fr),
lev AS (SELECT track_id, bin, quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.9) AS p90 FROM sm GROUP BY 1, 2),
ab AS (SELECT s.*, p90 - p10 AS contrast, (p10 + p90) / 2 AS thr, v > (p10 + p90) / 2 AS above, lag(v) OVER w AS pv, lag(y_mm) OVER w AS py, lead(v) OVER w AS nv, lead(y_mm) OVER w AS ny FROM sm s JOIN lev USING (track_id, bin) WINDOW w AS (PARTITION BY track_id, bin ORDER BY iy)),
isl AS (SELECT *, row_number() OVER (PARTITION BY track_id, bin ORDER BY iy) - row_number() OVER (PARTITION BY track_id, bin, above ORDER BY iy) AS k FROM ab),
runs AS (SELECT track_id, bin, min(iy) AS s, max(iy) AS e, count(*) AS len FROM isl WHERE above GROUP BY track_id, bin, k),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id, bin ORDER BY len DESC, s) AS rn FROM runs) WHERE rn = 1),
cut AS (SELECT b.track_id, b.bin, s, e, coalesce(l.py + (l.thr - l.pv) / (l.v - l.pv) * (l.y_mm - l.py), l.y_mm) AS yl, coalesce(r.y_mm + (r.thr - r.v) / (r.nv - r.v) * (r.ny - r.y_mm), r.y_mm) AS yr
  FROM best b JOIN ab l ON b.track_id = l.track_id AND b.bin = l.bin AND l.iy = b.s JOIN ab r ON b.track_id = r.track_id AND b.bin = r.bin AND r.iy = b.e),
judged AS (SELECT l.track_id, l.bin, p90 - p10 AS contrast, coalesce(p90 - p10 >= 0.4e0 AND s >= 3 AND e <= 60 AND yr - yl >= 0.2e0 AND yr - yl <= 1.8e0, false) AS eligible, yl, yr FROM lev l LEFT JOIN cut USING (track_id, bin))""")
 + """SELECT track_id, bin, contrast, eligible, CASE WHEN eligible THEN yr - yl END AS width, CASE WHEN eligible THEN yl END AS "left", CASE WHEN eligible THEN yr END AS "right" FROM judged""", 'contrast width "left" "right"')
def valid_run_label(t):
    """Label from the longest valid run of each bin."""
    cells = t.embeddings.select("vec_id", F.posexplode("embedding").alias("iy", "v0")).join(column_index(t), "vec_id")
    y = d(0.05) + F.col("iy") * d(1.80) / d(63)
    fractions = cells.groupBy("track_id", F.floor(F.col("idx") / 2).alias("bin"), "iy", y.alias("y_mm")).agg(
        F.avg((F.col("v0") > 0).cast("double")).alias("v"))
    return P.valid_run_labels(fractions, ["track_id", "bin"])


RELIEF_SQL = X.with_sql(COLUMNS_SQL, CONTROLS_SQL) + """, dz AS (SELECT track_id, x_um, iy, y_mm, z FROM run_profiles WHERE run = 'control_d' AND z IS NOT NULL),
sl AS (SELECT *, (lead(y_mm) OVER w - y_mm) * (lead(z) OVER w + z) / 2 AS s FROM dz WINDOW w AS (PARTITION BY track_id, x_um ORDER BY iy)),
relief AS (SELECT track_id, x_um, quantile_cont(z, 0.9) AS relief_p90, sum(s) AS area FROM sl GROUP BY 1, 2)"""


def relief(t):
    cells = cell_count(t)
    runs = P.window_profiles(height_columns(t), ["track_id"], "x_um", [25], rows=cells).drop("run")
    return P.relief_and_area(runs, POS, cells)


@query("relief_and_area", RELIEF_SQL + "SELECT * FROM relief", "relief_p90 area")
def relief_and_area(t):
    """Peak relief and area after the margin detrend."""
    return relief(t)


@query("relief_anchor", RELIEF_SQL + """, e AS (SELECT track_id, x_um, relief_p90, area, CAST(x_um AS DOUBLE) / 1000 AS extent, CAST(x_um AS DOUBLE) / 1000 * (CAST(x_um AS DOUBLE) / 1000) AS extent_sq FROM relief),
m AS (SELECT track_id, median(relief_p90) AS y, median(extent) AS a, median(extent_sq) AS b FROM e GROUP BY 1),
r AS (SELECT 'extent' AS candidate, y / a AS q FROM m UNION ALL SELECT 'extent_sq', y / b FROM m)
SELECT candidate, count(q) AS tracks, avg(q) AS mean_ratio, stddev_pop(q) / avg(q) AS cv FROM r GROUP BY 1""", "mean_ratio cv")
def relief_anchor(t):
    """Anchors of the relief on a feature and its square."""
    e = F.col("x_um").cast("double") / 1000
    rows = relief(t).withColumns({"extent": e, "extent_sq": e * e})
    return M.anchor_ratios(rows, "track_id", "relief_p90", ["extent", "extent_sq"])


@query("area_anchor", RELIEF_SQL + """, m AS (SELECT track_id, median(area) AS y, median(CAST(x_um AS DOUBLE) / 1000 * (CAST(x_um AS DOUBLE) / 1000)) AS b FROM relief GROUP BY 1)
SELECT 'extent_sq' AS candidate, count(y / b) AS tracks, avg(y / b) AS mean_ratio, stddev_pop(y / b) / avg(y / b) AS cv FROM m""", "mean_ratio cv")
def area_anchor(t):
    """The area's anchor on the squared extent."""
    e = F.col("x_um").cast("double") / 1000
    return M.anchor_ratios(relief(t).withColumn("extent_sq", e * e), "track_id", "area", ["extent_sq"])


@query("contour_roughness", X.with_sql(X.POSITIONS, """
s AS (SELECT *, avg(y) OVER (PARTITION BY track_id ORDER BY seg ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS s2, avg(y) OVER (PARTITION BY track_id ORDER BY seg ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING) AS s10 FROM positions),
l AS (SELECT track_id, regr_slope(y, x_mm) AS k, regr_intercept(y, x_mm) AS c FROM positions GROUP BY 1)""") + """
SELECT s.track_id, row_number() OVER (PARTITION BY s.track_id ORDER BY seg) - 1 AS pos, stddev_pop(y - s2) OVER (PARTITION BY s.track_id ORDER BY seg ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS roughness,
  stddev_pop(s2 - s10) OVER (PARTITION BY s.track_id ORDER BY seg ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING) AS waviness, abs(y - (c + k * x_mm)) AS deviation FROM s JOIN l ON s.track_id = l.track_id""", "roughness waviness deviation")
def contour_roughness(t):
    """Edge roughness, waviness and deviation from the track line."""
    rows = O.dense_index(X.positions(t, blocks=True), ["track_id"], ["seg"], "pos", reuse_blocks=True)
    return P.contour_roughness(rows.drop(O.BLOCK), ["track_id"], "pos", "y", "x_mm")


# Labels from the edges, references from the labels table.
FEATURE_SQL = WITH_EDGES + "," + BANDS_SQL + "," + SUPPORT_SQL + "," + SPREAD_SQL + """,
slab AS (SELECT track_id, x_um, sum(ok) OVER w / sum(n) OVER w AS slab_valid_fraction FROM (SELECT track_id, x_um, CAST(count(z) AS DOUBLE) AS ok, count(*) AS n FROM height_columns GROUP BY 1, 2)
  WINDOW w AS (PARTITION BY track_id ORDER BY x_um RANGE BETWEEN 100 PRECEDING AND 100 FOLLOWING)),
features AS (SELECT c.vec_id, e.track_id, e.x_um, e.status, e.status = 'ok' AS finite_prediction, left_, right_, slab_valid_fraction, valid_fraction, left_valid_fraction, right_valid_fraction,
    l.nearest_missing_mm AS left_nearest_missing, r.nearest_missing_mm AS right_nearest_missing, width_sensitivity, width_disagreement, least(left_ - 0.5e0, 1.45e0 - right_) AS limit_distance
  FROM edges e JOIN col_index c ON e.track_id = c.track_id AND e.x_um = c.idx * 40 JOIN bands b ON e.track_id = b.track_id AND e.x_um = b.x_um JOIN slab s ON e.track_id = s.track_id AND e.x_um = s.x_um
  JOIN spread sp ON e.track_id = sp.track_id AND e.x_um = sp.x_um LEFT JOIN edge_support l ON e.track_id = l.track_id AND e.x_um = l.x_um AND l.side = 'left'
  LEFT JOIN edge_support r ON e.track_id = r.track_id AND e.x_um = r.x_um AND r.side = 'right' WHERE e.run = '100')"""
FEATURES = "slab_valid_fraction valid_fraction left_valid_fraction right_valid_fraction left_nearest_missing right_nearest_missing width_sensitivity width_disagreement limit_distance"


def quality_features(t):
    """Every position's base edges with the quality features the gates use."""
    cells = cell_count(t)
    runs = materialize(run_profiles(t, cells))
    found = materialize(P.edge_finder(runs, RUN, 5 * cells))
    base = runs.where("run = '100'").drop("run")
    own = found.where("run = '100'").drop("run")
    support = P.edge_support(base, own, POS, rows=cells).groupBy(*POS).agg(
        *[F.max(F.when(F.col("side") == s, F.col("nearest_missing_mm"))).alias(f"{s}_nearest_missing") for s in ("left", "right")])
    bands = P.band_statistics(base, POS, cells).select(*POS, "valid_fraction", "left_valid_fraction", "right_valid_fraction")
    spread = P.run_spread(found, POS, "run", "100", AGG_RUNS, ALTERNATES).select(*POS, "width_sensitivity", "width_disagreement")
    slab = P.slab_valid_fraction(height_columns(t), ["track_id"], "x_um", 100)
    rows = own.join(bands, POS).join(slab, POS).join(spread, POS).join(support, POS, "left").join(
        column_index(t).select("vec_id", *POS), POS)
    return rows.withColumns({
        "finite_prediction": F.col("status") == "ok",
        "limit_distance": F.least(F.col("left") - d(P.CENTRAL[0]), d(P.CENTRAL[1]) - F.col("right"))})


@query("quality_features", FEATURE_SQL + """SELECT vec_id, track_id, x_um, status, finite_prediction, left_ AS "left", right_ AS "right", slab_valid_fraction, valid_fraction, left_valid_fraction, right_valid_fraction,
  left_nearest_missing, right_nearest_missing, width_sensitivity, width_disagreement, limit_distance FROM features""", '"left" "right" ' + FEATURES)
def quality_feature_table(t):
    """The feature table of the label build."""
    return quality_features(t).select("vec_id", *POS, "status", "finite_prediction", "left", "right", *FEATURES.split())


LABEL_SQL = FEATURE_SQL + """, labels_built AS (SELECT vec_id, track_id, x_um / 1000e0 AS x_mm, right_ - left_ AS width, CASE WHEN NOT finite_prediction THEN 'estimator_nonfinite' WHEN NOT right_ > left_ THEN 'invalid_boundary_order'
    WHEN coalesce(tox = 1, false) THEN 'estimator_exclusion' ELSE '' END AS reason, slab_valid_fraction AS loc, left_valid_fraction AS lv, right_valid_fraction AS rv
  FROM features f LEFT JOIN (SELECT doc_id, toxic AS tox FROM labels) t ON f.vec_id = t.doc_id)"""


def built_labels(t):
    rows = quality_features(t).join(t.labels.select(F.col("doc_id").alias("vec_id"), "toxic"), "vec_id", "left")
    reason = S.eligibility_reason(F.col("finite_prediction"), F.col("right") > F.col("left"), F.coalesce(F.col("toxic") == 1, F.lit(False)))
    return materialize(rows.withColumns({"reason": reason, "x_mm": F.col("x_um") / d(1000)}))


@query("eligibility", LABEL_SQL + "SELECT track_id, reason, count(*) AS n, avg(width) AS mean_width FROM labels_built GROUP BY 1, 2", "mean_width")
def eligibility(t):
    """First failing eligibility rule, counted."""
    return built_labels(t).groupBy("track_id", "reason").agg(F.count(F.lit(1)).alias("n"), F.avg("width").alias("mean_width"))


@query("policy_summary", LABEL_SQL + """, flags AS (SELECT *, unnest([{'policy': 'all_finite_height_estimator_v1', 'keep': reason = ''}, {'policy': 'local_valid_ge_0p50', 'keep': reason = '' AND loc >= 0.5e0},
    {'policy': 'side_support_ge_0p50', 'keep': reason = '' AND lv >= 0.5e0 AND rv >= 0.5e0}, {'policy': 'local_and_side_support_ge_0p50', 'keep': reason = '' AND loc >= 0.5e0 AND lv >= 0.5e0 AND rv >= 0.5e0}]) AS f FROM labels_built),
scoped AS (SELECT f.policy AS policy, f.keep AS keep, 'aggregate' AS scope, width, x_mm, reason FROM flags UNION ALL SELECT f.policy, f.keep, CAST(track_id AS VARCHAR), width, x_mm, reason FROM flags),
gaps AS (SELECT policy, scope, max(g) AS largest_gap FROM (SELECT policy, scope, x_mm - lag(x_mm) OVER (PARTITION BY policy, scope ORDER BY x_mm) AS g FROM scoped WHERE keep) GROUP BY 1, 2),
why AS (SELECT policy, scope, CASE WHEN reason = '' THEN 'sensitivity_support_threshold' ELSE reason END AS why, count(*) AS n FROM scoped WHERE NOT keep GROUP BY 1, 2, 3),
hist AS (SELECT policy, scope, '{' || string_agg('"' || why || '":' || n, ',' ORDER BY why) || '}' AS reasons FROM why GROUP BY 1, 2)
SELECT s.policy, s.scope, count(*) FILTER (WHERE keep) AS eligible, count(*) FILTER (WHERE NOT keep) AS excluded, avg(CASE WHEN keep THEN 1e0 ELSE 0e0 END) AS eligible_fraction, avg(width) FILTER (WHERE keep) AS target_mean,
  stddev_pop(width) FILTER (WHERE keep) AS target_std, min(width) FILTER (WHERE keep) AS target_min, max(width) FILTER (WHERE keep) AS target_max, min(x_mm) FILTER (WHERE keep) AS x_min, max(x_mm) FILTER (WHERE keep) AS x_max,
  median(width) FILTER (WHERE keep) AS target_median, any_value(largest_gap) AS largest_gap, coalesce(any_value(largest_gap) > 0.6e0, false) AS large_gap, coalesce(any_value(reasons), '{}') AS reasons
FROM scoped s LEFT JOIN gaps g ON s.policy = g.policy AND s.scope = g.scope LEFT JOIN hist h ON s.policy = h.policy AND s.scope = h.scope GROUP BY 1, 2""",
       "eligible_fraction target_mean target_std target_min target_max x_min x_max target_median largest_gap")
def policy_summary(t):
    """Four support policies over all rows and per track."""
    policies = S.support_policies(F.col("reason") == "", F.col("slab_valid_fraction"), F.col("left_valid_fraction"), F.col("right_valid_fraction"))
    return L.policy_summary(built_labels(t), "track_id", policies, "reason", "width", "x_mm")


@query("cohort_exclusions", LABEL_SQL + """, c AS (SELECT *, least(x_mm - 20e0, 100e0 - x_mm) < 1e0 AS border, abs(x_mm - 0.2e0 * round(x_mm / 0.2e0)) < 0.021e0 AS boundary FROM labels_built),
h AS (SELECT track_id, '{' || string_agg('"' || reason || '":' || n, ',' ORDER BY reason) || '}' AS reasons FROM (SELECT track_id, reason, count(*) AS n FROM c GROUP BY 1, 2) GROUP BY 1)
SELECT c.track_id, count(*) AS total, any_value(reasons) AS reasons, count(*) FILTER (WHERE boundary) AS boundary_cases, count(*) FILTER (WHERE border) AS border_cases FROM c JOIN h USING (track_id) GROUP BY 1""")
def cohort_exclusions(t):
    """Exclusion distribution, boundary and border cases per track."""
    x = F.col("x_mm")
    rows = built_labels(t)
    border, boundary = F.least(x - d(20), d(100) - x) < d(1), F.abs(x - d(0.2) * F.round(x / d(0.2))) < d(0.021)
    return L.cohort_exclusions(rows, "track_id", "reason", boundary, border)


@query("cohort_summary", X.with_sql(X.GATE_ROWS) + """SELECT track_id, count(*) AS total, count(*) FILTER (WHERE n_chars >= 500) AS eligible, count(quality) AS first_available, count(*) FILTER (WHERE coalesce(toxic = 0, false)) AS second_available,
  count(*) FILTER (WHERE n_chars >= 500 AND quality IS NOT NULL AND toxic = 0) AS common, count(*) FILTER (WHERE n_chars < 500) AS excluded FROM gate_rows GROUP BY 1""")
def cohort_summary(t):
    """Cohort totals per group."""
    return L.cohort_summary(X.gate_rows(t), "track_id", F.col("n_chars") >= 500, F.col("quality").isNotNull(),
                            F.coalesce(F.col("toxic") == 0, F.lit(False)))


# Gates against the labelled positions.
GATE_LIST = [
    ("accept_all_finite", "true"), ("valid_ge_0p50", "slab_valid_fraction >= 0.5e0"), ("valid_ge_0p70", "slab_valid_fraction >= 0.7e0"),
    ("side_support_ge_0p50", "least(left_valid_fraction, right_valid_fraction) >= 0.5e0"), ("agg_width_le_0p10", "width_sensitivity <= 0.1e0"),
    ("method_width_le_0p15", "width_disagreement <= 0.15e0"), ("nan_distance_ge_0p02", "coalesce(least(left_nearest_missing, right_nearest_missing), 1e0) >= 0.02e0"),
    ("balanced_rule_v1", "slab_valid_fraction >= 0.5e0 AND width_sensitivity <= 0.15e0 AND width_disagreement <= 0.2e0"),
    ("low_false_accept_rule_v1", "least(left_valid_fraction, right_valid_fraction) >= 0.7e0 AND width_sensitivity <= 0.1e0 AND width_disagreement <= 0.15e0"),
    ("high_yield_rule_v1", "(slab_valid_fraction >= 0.4e0 OR width_disagreement <= 0.25e0)")]
GATES_SQL = FEATURE_SQL + ", gated AS (SELECT *, unnest([" + ", ".join(
    f"{{'r': {i}, 'id': '{g}', 'acc': finite_prediction AND coalesce({c}, false)}}" for i, (g, c) in enumerate(GATE_LIST)) + """]) AS g FROM features),
judged_rows AS (SELECT vec_id, track_id, g.r AS gate_rank, g.id AS gate_id, g.acc AS accepted, finite_prediction, quality = 1 AS available, CASE WHEN quality = 1 AND toxic = 0 THEN 'measurable' WHEN quality = 1 THEN 'uncertain' ELSE 'unmeasurable' END AS tier,
  left_, right_, 0.6e0 + (doc_id % 7) * 0.02e0 AS rl, 1.2e0 + (doc_id % 5) * 0.02e0 AS rr FROM gated JOIN labels ON vec_id = doc_id)"""
CONF = "precision recall measurable_recall uncertain_recall specificity left_mae right_mae width_mae width_bias centre_mae centre_bias width_max centre_max"


def confusion_sql(source: str, groups: str) -> str:
    hit = "FILTER (WHERE accepted AND available AND left_ IS NOT NULL)"
    w, c = "((right_ - rr) - (left_ - rl))", "(((left_ - rl) + (right_ - rr)) / 2)"
    def rate(a, b):
        return f"CASE WHEN count(*) FILTER (WHERE {b}) > 0 THEN CAST(count(*) FILTER (WHERE {a}) AS DOUBLE) / count(*) FILTER (WHERE {b}) END"
    return f"""SELECT {groups}, count(*) FILTER (WHERE accepted AND available) AS tp, count(*) FILTER (WHERE accepted AND NOT available) AS fp,
      count(*) FILTER (WHERE NOT accepted AND available) AS fn, count(*) FILTER (WHERE NOT accepted AND NOT available) AS tn,
      {rate('accepted AND available', 'accepted')} AS precision, {rate('accepted AND available', 'available')} AS recall,
      {rate("accepted AND tier = 'measurable'", "tier = 'measurable'")} AS measurable_recall, {rate("accepted AND tier = 'uncertain'", "tier = 'uncertain'")} AS uncertain_recall,
      {rate('NOT accepted AND NOT available', 'NOT available')} AS specificity, count(*) {hit} AS geometry_count,
      avg(abs(left_ - rl)) {hit} AS left_mae, avg(abs(right_ - rr)) {hit} AS right_mae, avg(abs({w})) {hit} AS width_mae, avg({w}) {hit} AS width_bias,
      avg(abs({c})) {hit} AS centre_mae, avg({c}) {hit} AS centre_bias, max(abs({w})) {hit} AS width_max, max(abs({c})) {hit} AS centre_max FROM {source} GROUP BY {groups}"""


def judged_features(t):
    refs = t.labels.select(
        F.col("doc_id").alias("vec_id"), (F.col("quality") == 1).alias("available"),
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "measurable").when(F.col("quality") == 1, "uncertain").otherwise("unmeasurable").alias("tier"),
        (d(0.6) + (F.col("doc_id") % 7) * d(0.02)).alias("ref_left"), (d(1.2) + (F.col("doc_id") % 5) * d(0.02)).alias("ref_right"))
    return quality_features(t).join(refs, "vec_id")


def judged_rows(t):
    return L.apply_gates(materialize(judged_features(t)), L.quality_gates())


SCOPED = ", scoped AS (SELECT *, 'aggregate' AS scope FROM judged_rows UNION ALL SELECT *, CAST(track_id AS VARCHAR) FROM judged_rows) "


@query("gate_confusion", GATES_SQL + SCOPED + "SELECT *, (left_mae + right_mae) / 2 AS combined_mae FROM (" + confusion_sql("scoped", "gate_id, scope") + ")", CONF + " combined_mae")
def gate_confusion(t):
    """Confusion and conditional geometry errors of ten gates, all and per track."""
    out = L.gate_confusion(M.with_scopes(judged_rows(t), "track_id"), ["gate_id", "scope"])
    return out.withColumn("combined_mae", (F.col("left_mae") + F.col("right_mae")) / 2)


@query("gate_yield", GATES_SQL + """, every AS (SELECT g.id AS gate_id, g.acc AS accepted, CASE WHEN g.acc THEN 'accepted' WHEN NOT finite_prediction THEN 'nonfinite_boundary' ELSE 'objective_rule_failed' END AS why FROM gated),
h AS (SELECT gate_id, '{' || string_agg('"' || why || '":' || n, ',' ORDER BY why) || '}' AS reasons FROM (SELECT gate_id, why, count(*) AS n FROM every GROUP BY 1, 2) GROUP BY 1)
SELECT gate_id, count(*) AS positions, count(*) FILTER (WHERE accepted) AS accepted_count, avg(CASE WHEN accepted THEN 1e0 ELSE 0e0 END) AS accepted_fraction, any_value(reasons) AS reasons FROM every JOIN h USING (gate_id) GROUP BY 1""", "accepted_fraction")
def gate_yield(t):
    """Yield over all positions."""
    return L.gate_yield(L.apply_gates(materialize(quality_features(t)), L.quality_gates()))


AGG_METRICS = ", agg AS (" + confusion_sql("judged_rows", "gate_id, gate_rank") + "), tracks AS (" + confusion_sql("judged_rows", "gate_id, track_id") + ") "


@query("gate_criteria", GATES_SQL + AGG_METRICS + """SELECT a.gate_id, CASE WHEN fp <= 1 THEN 'low_false_accept' WHEN coalesce(recall, 0) >= 0.7e0 THEN 'balanced_precision_recall' ELSE 'high_yield_riskier' END AS pareto,
  fp <= 1 AS few_false_accepts, coalesce(recall, 0) >= 0.7e0 AS recall_ok, coalesce(width_mae < 0.0997296e0, false) AS width_improved, coalesce(centre_mae <= 0.0642573e0, false) AS centre_ok, s.severe AS severe_track_failure
FROM agg a JOIN (SELECT gate_id, bool_or(coalesce(recall < 0.5e0, false)) AS severe FROM tracks GROUP BY 1) s ON a.gate_id = s.gate_id""")
def gate_criteria(t):
    """Pareto class, criteria and severe track failure."""
    rows = judged_rows(t)
    return L.gate_criteria(L.gate_confusion(rows, ["gate_id", "gate_rank"]), L.gate_confusion(rows, ["gate_id", "track_id"]), 0.0997296, 0.0642573)


@query("recommended_gate", GATES_SQL + AGG_METRICS + """SELECT gate_id AS recommended_gate FROM (SELECT *, fp <= 1 AND coalesce(recall, 0) >= 0.7e0 AS m FROM agg)
ORDER BY m DESC, CASE WHEN m THEN coalesce(precision, 0) ELSE coalesce(precision, 0) + coalesce(recall, 0) END DESC, CASE WHEN m THEN coalesce(recall, 0) ELSE 0 END DESC, CASE WHEN m THEN -coalesce(width_mae, 99) ELSE 0 END DESC, gate_rank LIMIT 1""")
def recommended_gate(t):
    """The recommended gate."""
    return L.recommended_gate(L.gate_confusion(judged_rows(t), ["gate_id", "gate_rank"]))


STUMP = ["slab_valid_fraction", "width_sensitivity", "width_disagreement", "limit_distance"]
_W = range(len(STUMP))
LOTO_SQL = "WITH RECURSIVE " + GATES_SQL.lstrip().removeprefix("WITH") + """, held AS (SELECT DISTINCT track_id AS held_out FROM judged_rows),
train_rows AS (SELECT j.*, f.held_out FROM judged_rows j JOIN held f ON j.track_id <> f.held_out),
tm AS (""" + confusion_sql("train_rows", "held_out, gate_id, gate_rank") + """),
chosen AS (SELECT held_out, gate_id FROM (SELECT *, row_number() OVER (PARTITION BY held_out ORDER BY fp <= 1 DESC, coalesce(recall, 0) >= 0.7e0 DESC, coalesce(precision, 0) + coalesce(recall, 0) DESC, coalesce(width_mae, 99), gate_rank) AS rn FROM tm) WHERE rn = 1),
tests AS (""" + confusion_sql("judged_rows", "track_id, gate_id") + """),
one AS (SELECT j.*, """ + ", ".join(f"round(coalesce(f.{c}, 0e0), 9) AS v{i}" for i, c in enumerate(STUMP)) + """ FROM judged_rows j JOIN features f USING (vec_id) WHERE j.gate_rank = 0),
tr AS MATERIALIZED (SELECT held_out, one.* FROM one JOIN held ON track_id <> held_out),
long AS (""" + " UNION ALL ".join(f"SELECT held_out, {i} AS fr, v{i} AS x, available AS y FROM tr" for i in _W) + """),
cuts AS (SELECT DISTINCT held_out, fr, x AS threshold FROM long),
losses AS (SELECT c.held_out, c.fr, c.threshold, d.dir, avg(CASE WHEN (d.dir * l.x >= d.dir * c.threshold) <> l.y THEN 1e0 ELSE 0e0 END) AS loss
  FROM cuts c JOIN long l ON c.held_out = l.held_out AND c.fr = l.fr CROSS JOIN (VALUES (1), (-1)) d(dir) GROUP BY 1, 2, 3, 4),
split AS (SELECT * FROM losses QUALIFY row_number() OVER (PARTITION BY held_out ORDER BY loss, fr, threshold, dir DESC) = 1),
tree_rows AS (SELECT one.* REPLACE (finite_prediction AND dir * CASE fr """ + " ".join(f"WHEN {i} THEN v{i}" for i in _W) + """ END >= dir * threshold AS accepted) FROM one JOIN split ON track_id = held_out),
st AS (SELECT held_out, """ + ", ".join(f"avg(v{i}) AS m{i}, CASE WHEN stddev_pop(v{i}) < 1e-12 THEN 1e0 ELSE stddev_pop(v{i}) END AS s{i}" for i in _W) + """ FROM tr GROUP BY 1),
z AS MATERIALIZED (SELECT held_out AS h, """ + ", ".join(f"(v{i} - m{i}) / s{i} AS z{i}" for i in _W) + """, CASE WHEN available THEN 1e0 ELSE 0e0 END AS y FROM tr JOIN st USING (held_out)),
w AS (SELECT 0 AS k, held_out AS h, 0e0 AS a, """ + ", ".join(f"0e0 AS b{i}" for i in _W) + """ FROM held UNION ALL
  SELECT any_value(k) + 1, h, any_value(a) - 0.1e0 * avg(g), """ + ", ".join(f"any_value(b{i}) - 0.1e0 * (avg(g * z{i}) + 0.05e0 * any_value(b{i}))" for i in _W) + """
  FROM (SELECT w.*, """ + ", ".join(f"z{i}" for i in _W) + ", 1e0 / (1e0 + exp(-greatest(-20e0, least(20e0, a + " + " + ".join(f"b{i} * z{i}" for i in _W) + """)))) - y AS g FROM w JOIN z ON w.h = z.h WHERE k < 1000) GROUP BY h),
logistic_rows AS (SELECT one.* REPLACE (finite_prediction AND a + """ + " + ".join(f"b{i} * (v{i} - m{i}) / s{i}" for i in _W) + """ >= 0 AS accepted) FROM one JOIN st ON track_id = st.held_out JOIN w ON w.h = st.held_out AND w.k = 1000),
tree_tests AS (""" + confusion_sql("tree_rows", "track_id") + """), logistic_tests AS (""" + confusion_sql("logistic_rows", "track_id") + """),
every AS (SELECT track_id AS held_out, gate_id, CAST(NULL AS VARCHAR) AS selected_gate, 'shared_fixed_rule' AS role, * EXCLUDE (track_id, gate_id) FROM tests
  UNION ALL SELECT c.held_out, 'selected_shared_rule', c.gate_id, 'selected_on_other_tracks', t.* EXCLUDE (track_id, gate_id) FROM chosen c JOIN tests t ON c.held_out = t.track_id AND c.gate_id = t.gate_id
  UNION ALL SELECT track_id, 'diagnostic_tree', NULL, 'diagnostic_training_tracks', * EXCLUDE (track_id) FROM tree_tests
  UNION ALL SELECT track_id, 'diagnostic_logistic', NULL, 'diagnostic_training_tracks', * EXCLUDE (track_id) FROM logistic_tests)
SELECT *, (left_mae + right_mae) / 2 AS combined_mae FROM every"""


@query("gate_loto", LOTO_SQL, CONF + " combined_mae")
def gate_loto(t):
    """Fixed rules, the rule chosen on the other tracks, and the tree and logistic rule fitted there, on each held-out track."""
    rows = materialize(judged_features(t).withColumns({f"v_{c}": F.round(F.coalesce(F.col(c), d(0)), 9) for c in STUMP}))
    return G.held_out_gates(rows, "track_id", L.quality_gates(), [f"v_{c}" for c in STUMP])


@query("gate_yield_by_track", GATES_SQL + """SELECT g.id AS gate_id, track_id, count(*) AS positions, count(*) FILTER (WHERE g.acc) AS accepted_count, avg(CASE WHEN g.acc THEN 1e0 ELSE 0e0 END) AS accepted_fraction FROM gated GROUP BY 1, 2""", "accepted_fraction")
def gate_yield_by_track(t):
    """Accepted positions of each gate per track."""
    rows = L.apply_gates(materialize(quality_features(t)), L.quality_gates())
    return rows.groupBy("gate_id", "track_id").agg(
        F.count(F.lit(1)).alias("positions"), F.count_if(F.col("accepted")).alias("accepted_count"),
        F.avg(F.col("accepted").cast("double")).alias("accepted_fraction"))


@query("error_cases", GATES_SQL + """SELECT gate_id, vec_id, kind AS "case" FROM (SELECT *, CASE WHEN accepted AND NOT available THEN 'false_accept' WHEN NOT accepted AND available THEN 'false_reject'
  WHEN accepted AND available AND coalesce(abs((right_ - rr) - (left_ - rl)) > 0.15e0 OR abs(((left_ - rl) + (right_ - rr)) / 2) > 0.1e0, false) THEN 'large_error' END AS kind FROM judged_rows) WHERE kind IS NOT NULL""")
def error_cases(t):
    """False accepts, false rejects and large errors."""
    return L.error_cases(judged_rows(t)).select("gate_id", "vec_id", "case")


@query("error_cases_with_fixed", GATES_SQL + """SELECT gate_id, vec_id, coalesce(kind, 'fixed') AS "case" FROM (SELECT *, CASE WHEN accepted AND NOT available THEN 'false_accept' WHEN NOT accepted AND available THEN 'false_reject'
  WHEN accepted AND available AND coalesce(abs((right_ - rr) - (left_ - rl)) > 0.15e0 OR abs(((left_ - rl) + (right_ - rr)) / 2) > 0.1e0, false) THEN 'large_error' END AS kind FROM judged_rows) WHERE kind IS NOT NULL OR vec_id % 17 = 0""")
def error_cases_with_fixed(t):
    """Error cases together with fixed ids."""
    return L.error_cases(judged_rows(t), F.col("vec_id") % 17 == 0).select("gate_id", "vec_id", "case")


STUMP_SQL = FEATURE_SQL + ", rows_ AS (SELECT f.track_id, quality = 1 AS y, h.held_out, " + ", ".join(f"round(coalesce({c}, 0e0), 9) AS {c}" for c in STUMP) + """ FROM features f JOIN labels ON vec_id = doc_id CROSS JOIN (VALUES (0), (1), (2)) h(held_out) WHERE f.track_id <> h.held_out),
long AS (""" + " UNION ALL ".join(f"SELECT held_out, {i} AS fr, '{c}' AS feature, {c} AS x, y FROM rows_" for i, c in enumerate(STUMP)) + """),
cuts AS (SELECT DISTINCT held_out, fr, feature, x AS threshold FROM long),
losses AS (SELECT c.held_out, c.fr, c.feature, c.threshold, d.dir, avg(CASE WHEN (d.dir * l.x >= d.dir * c.threshold) <> l.y THEN 1e0 ELSE 0e0 END) AS loss
  FROM cuts c JOIN long l ON c.held_out = l.held_out AND c.fr = l.fr CROSS JOIN (VALUES (1), (-1)) d(dir) GROUP BY 1, 2, 3, 4, 5)
SELECT held_out, feature, threshold, CAST(dir AS INT) AS direction, loss FROM (SELECT *, row_number() OVER (PARTITION BY held_out ORDER BY loss, fr, threshold, dir DESC) AS rn FROM losses) WHERE rn = 1"""


@query("stump", STUMP_SQL, "threshold loss")
def stump(t):
    """Best single split per training fold."""
    rows = judged_features(t)
    rows = rows.select("track_id", "available", *[F.round(F.coalesce(F.col(c), d(0)), 9).alias(c) for c in STUMP])
    return G.stump_folds(rows, "track_id", STUMP, "available")
