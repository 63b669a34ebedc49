"""Queries: image cells, tiles and surfaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions.scalars import CONTEXT_MM, MASK_HALF_MM, THERMAL_PIXEL_MM, d
from trackloom.operators import frames as FR
from trackloom.operators import raster as R
from trackloom.operators import sequence as Q
from trackloom.operators.ordered import dense_index
from trackloom.plans import fixtures as X
from trackloom.plans.registry import query
from trackloom.plans.sequences import active_sql
from trackloom.session import attach

PCT_SQL = X.with_sql(X.CELLS, """
fp AS (SELECT frame, quantile_cont(v, 0.05) AS p05, quantile_cont(v, 0.10) AS p10, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.9) AS p90,
  quantile_cont(v, 0.95) AS p95, quantile_cont(v, 0.97) AS p97, quantile_cont(v, 0.99) AS p99 FROM cells GROUP BY 1),
ctx AS (SELECT *, v - lag(v) OVER (PARTITION BY frame, r ORDER BY c) AS gx, v - lag(v) OVER (PARTITION BY frame, c ORDER BY r) AS gy,
  greatest(v - p10, 0e0) AS e FROM cells JOIN fp USING (frame))""")
SUMMARY = "mean std low high p10 p50 p90 p99 contrast hot_fraction centroid_x centroid_y left_right up_down grad_x grad_y mean_excess"
SUMMARY_SQL = PCT_SQL + """, summary AS (SELECT frame, track_id, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS low, max(v) AS high, max(p10) AS p10, max(p50) AS p50, max(p90) AS p90,
  max(p99) AS p99, max(v) - max(p10) AS contrast, avg(CASE WHEN v >= p95 THEN 1e0 ELSE 0e0 END) AS hot_fraction,
  sum(e * c) / greatest(sum(e), 1e0) / 7e0 AS centroid_x, sum(e * r) / greatest(sum(e), 1e0) / 7e0 AS centroid_y,
  avg(v) FILTER (WHERE c < 4) - avg(v) FILTER (WHERE c >= 4) AS left_right, avg(v) FILTER (WHERE r < 4) - avg(v) FILTER (WHERE r >= 4) AS up_down,
  avg(abs(gx)) AS grad_x, avg(abs(gy)) AS grad_y, avg(e) AS mean_excess FROM ctx GROUP BY 1, 2)
"""
KEY = ["frame", "track_id"]


def summaries(t):
    return FR.per_frame(X.frames(t), KEY, "embedding", 8, 8, FR.SUMMARY, FR.summary)


def hotspots(t, key):
    found = FR.per_frame(X.frames(t), key, "embedding", 8, 8, ["cx", "cy", "hot_cells"], FR.hot_centre)
    return found.withColumn("hot_cells", F.col("hot_cells").cast("long"))


@query("frame_summary", SUMMARY_SQL + "SELECT * FROM summary", SUMMARY)
def frame_summary(t):
    """Seventeen statistics per frame."""
    return summaries(t)


@query("frame_shift", SUMMARY_SQL + ", long AS (UNPIVOT (SELECT * EXCLUDE (frame) FROM summary) ON COLUMNS(* EXCLUDE (track_id)) INTO NAME feature VALUE x)," + """
per AS (SELECT feature, track_id, avg(x) AS m, stddev_pop(x) AS s FROM long GROUP BY 1, 2), pooled AS (SELECT feature, stddev_pop(x) AS pooled_std FROM long GROUP BY 1)
SELECT feature, count(*) AS tracks, max(m) - min(m) AS between_range, avg(s) AS within_std, (max(m) - min(m)) / greatest(avg(s), 1e-12) AS ratio, any_value(pooled_std) AS pooled_std
FROM per JOIN pooled USING (feature) GROUP BY 1""", "between_range within_std ratio pooled_std")
def frame_shift(t):
    """Distribution shift of frame features between tracks."""
    return R.distribution_shift(summaries(t), "track_id", SUMMARY.split())


@query("block_mean", X.with_sql(X.CELLS) + """SELECT frame, CAST(floor(r / 2e0) AS INT) AS br, CAST(floor(c / 2e0) AS INT) AS bc, avg(v) AS v FROM cells GROUP BY 1, 2, 3""", "v")
def block_mean(t):
    """R2: block means on a grid."""
    return R.block_mean(X.cells(t), ["frame"], 8, 8, 4)


@query("robust_scaled", PCT_SQL + """SELECT frame, r, c, (v - p50) / (p95 - p05 + 1e-6) AS scaled, v - p10 AS above_background FROM ctx""", "scaled above_background")
def robust_scaled(t):
    """Robust per-frame scaling and background subtraction."""
    return R.robust_scaled(X.cells(t).drop("track_id"), ["frame"]).drop("v")


HOT_SQL = PCT_SQL + """, hot AS (SELECT frame, sum((greatest(v - p95, 0e0) + 1e-12) * c) / sum(greatest(v - p95, 0e0) + 1e-12) AS cx,
  sum((greatest(v - p95, 0e0) + 1e-12) * r) / sum(greatest(v - p95, 0e0) + 1e-12) AS cy, count(*) AS hot_cells FROM ctx WHERE v >= p95 GROUP BY 1)"""


@query("hotspot", HOT_SQL + "SELECT * FROM hot", "cx cy")
def hotspot(t):
    """Weighted hotspot centroid."""
    return hotspots(t, ["frame"])


@query("centred_crop", HOT_SQL + """, roi AS (SELECT frame, CAST(round_even(cx, 0) AS INT) - 2 AS x0, CAST(round_even(cy, 0) AS INT) - 2 AS y0, i FROM hot CROSS JOIN (SELECT unnest(range(0, 16)) AS i))
SELECT a.frame, CAST(i // 4 AS INT) AS rr, CAST(i % 4 AS INT) AS rc, x0 < 0 OR y0 < 0 OR x0 + 4 > 8 OR y0 + 4 > 8 AS edge, coalesce(v, 0e0) AS v
FROM roi a LEFT JOIN cells b ON a.frame = b.frame AND b.r = y0 + i // 4 AND b.c = x0 + i % 4""", "v")
def centred_crop(t):
    """Zero-padded window around the hotspot."""
    return R.centred_crop(X.cells(t), hotspots(t, ["frame"]), ["frame"], 8, 8, 4)


SHAPE = ("fraction_p90 fraction_p95 fraction_p97 fraction_p99 equivalent_diameter major_axis minor_axis axis_ratio centroid_x centroid_y "
         "eigen_1 eigen_2 contrast mean_excess grad_x grad_y left_right up_down failure")


@query("shape_moments", PCT_SQL + """,
w AS (SELECT *, CASE WHEN v >= p95 THEN e ELSE 0e0 END AS w FROM ctx),
c0 AS (SELECT frame, sum(w * c) / sum(w) AS mx, sum(w * r) / sum(w) AS my FROM w GROUP BY 1),
m AS (SELECT frame, any_value(mx) AS mx, any_value(my) AS my, sum(w * (c - mx) * (c - mx)) / sum(w) AS xx, sum(w * (r - my) * (r - my)) / sum(w) AS yy, sum(w * (c - mx) * (r - my)) / sum(w) AS xy,
  avg(CASE WHEN v >= p90 THEN 1e0 ELSE 0e0 END) AS f90, avg(CASE WHEN v >= p95 THEN 1e0 ELSE 0e0 END) AS f95, avg(CASE WHEN v >= p97 THEN 1e0 ELSE 0e0 END) AS f97, avg(CASE WHEN v >= p99 THEN 1e0 ELSE 0e0 END) AS f99,
  count(*) FILTER (WHERE v >= p95) AS hot, max(v) - max(p10) AS contrast, avg(e) AS mean_excess, avg(abs(gx)) AS grad_x, avg(abs(gy)) AS grad_y,
  avg(v) FILTER (WHERE c < 4) - avg(v) FILTER (WHERE c >= 4) AS left_right, avg(v) FILTER (WHERE r < 4) - avg(v) FILTER (WHERE r >= 4) AS up_down FROM w JOIN c0 USING (frame) GROUP BY 1),
g AS (SELECT *, (xx + yy) / 2 + sqrt(power((xx - yy) / 2, 2) + xy * xy) AS e1, (xx + yy) / 2 - sqrt(power((xx - yy) / 2, 2) + xy * xy) AS e2 FROM m)
SELECT frame, f90 AS fraction_p90, f95 AS fraction_p95, f97 AS fraction_p97, f99 AS fraction_p99, 2 * sqrt(hot / pi()) / 8e0 AS equivalent_diameter,
  2 * sqrt(greatest(e1, 0e0)) / 8e0 AS major_axis, 2 * sqrt(greatest(e2, 0e0)) / 8e0 AS minor_axis, 2 * sqrt(greatest(e1, 0e0)) / greatest(2 * sqrt(greatest(e2, 0e0)), 1e-9) AS axis_ratio,
  mx / 7e0 AS centroid_x, my / 7e0 AS centroid_y, e1 / 64e0 AS eigen_1, e2 / 64e0 AS eigen_2, contrast, mean_excess, grad_x, grad_y, left_right, up_down, 0e0 AS failure FROM g""", SHAPE)
def shape_moments(t):
    """Nineteen shape features from second moments."""
    return FR.per_frame(X.frames(t), ["frame"], "embedding", 8, 8, FR.SHAPE, FR.shape)


LEVELS = (0.05, 0.10, 0.15, 0.20, 0.30)


@query("isotherm_extent", X.with_sql(X.CELLS, "peaks AS (SELECT frame, track_id, c, max(v) AS peak FROM cells GROUP BY 1, 2, 3)") + "SELECT frame, track_id, " + ", ".join(
    f"CASE WHEN count(*) FILTER (WHERE peak > {lv}e0) > 1 THEN (max(c) FILTER (WHERE peak > {lv}e0) - min(c) FILTER (WHERE peak > {lv}e0)) * 0.014e0 ELSE 0e0 END AS extent_{i}"
    for i, lv in enumerate(LEVELS)) + " FROM peaks GROUP BY 1, 2", "extent_0 extent_1 extent_2 extent_3 extent_4")
def isotherm_extent(t):
    """Column extent above five levels."""
    return R.isotherm_extents(X.cells(t), KEY, LEVELS, THERMAL_PIXEL_MM)


# Strips: grey level v + 0.5; the left half of a frame is upstream, the right half downstream.
STRIP_SQL = X.with_sql(X.CELLS, """
strips AS (SELECT frame, CASE WHEN c < 4 THEN 'up' ELSE 'down' END AS side, r, CASE WHEN c < 4 THEN c ELSE c - 4 END AS c, v + 0.5e0 AS v FROM cells),
taps AS (SELECT k, exp(-0.5e0 * power(k / 3e0, 2)) / sum(exp(-0.5e0 * power(k / 3e0, 2))) OVER () AS w FROM (SELECT unnest(range(-12, 13)) AS k)),
hpass AS (SELECT a.frame, a.side, a.r, a.c, sum(t.w * b.v) AS h FROM strips a CROSS JOIN taps t JOIN strips b ON a.frame = b.frame AND a.side = b.side AND a.r = b.r
  AND b.c = CASE WHEN ((a.c + t.k) % 6 + 6) % 6 < 4 THEN ((a.c + t.k) % 6 + 6) % 6 ELSE 6 - ((a.c + t.k) % 6 + 6) % 6 END GROUP BY 1, 2, 3, 4),
blur AS (SELECT a.frame, a.side, a.r, a.c, sum(t.w * b.h) AS g FROM strips a CROSS JOIN taps t JOIN hpass b ON a.frame = b.frame AND a.side = b.side AND a.c = b.c
  AND b.r = CASE WHEN ((a.r + t.k) % 14 + 14) % 14 < 8 THEN ((a.r + t.k) % 14 + 14) % 14 ELSE 14 - ((a.r + t.k) % 14 + 14) % 14 END GROUP BY 1, 2, 3, 4),
near AS (SELECT *, v - lag(v) OVER rw AS gx, coalesce(lag(v) OVER rw, lead(v) OVER rw) + coalesce(lead(v) OVER rw, lag(v) OVER rw)
    + coalesce(lag(v) OVER cw, lead(v) OVER cw) + coalesce(lead(v) OVER cw, lag(v) OVER cw) - 4 * v AS lap
  FROM strips JOIN blur USING (frame, side, r, c) WINDOW rw AS (PARTITION BY frame, side, r ORDER BY c), cw AS (PARTITION BY frame, side, c ORDER BY r)),
hist AS (SELECT frame, side, least(CAST(floor(v * 32) AS BIGINT), 31) AS b, count(*) AS n FROM strips WHERE v >= 0 AND v <= 1 GROUP BY 1, 2, 3),
ent AS (SELECT frame, side, -sum((n / t) * log2(n / t)) AS entropy FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY frame, side) AS DOUBLE) AS t FROM hist) GROUP BY 1, 2),
stats AS (SELECT frame, side, avg(v) AS mean, stddev_pop(v) AS std, median(v) AS median, quantile_cont(v, 0.05) AS p05, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.75) AS p75,
  quantile_cont(v, 0.95) AS p95, quantile_cont(v, 0.95) - quantile_cont(v, 0.05) AS p95_p05, avg(gx * gx) AS gradient_energy, avg(CASE WHEN abs(gx) > 0.08e0 THEN 1e0 WHEN gx IS NOT NULL THEN 0e0 END) AS edge_fraction,
  var_pop(lap) AS laplacian_variance, avg(abs(v - g)) AS detail, any_value(entropy) AS entropy, avg(v * v) AS mean_square FROM near JOIN ent USING (frame, side) GROUP BY 1, 2)""")
STRIP = " ".join(R.STRIP_NAMES)


def textures(t):
    """Both half strips of each frame, cut out of its array."""
    grey = lambda low: F.filter(F.transform("embedding", lambda v: v.cast("double") + d(0.5)), lambda _, i: (i % 8 >= low) & (i % 8 < low + 4))
    sides = F.array(*[F.struct(F.lit(n).alias("side"), grey(low).alias("cells")) for n, low in (("up", 0), ("down", 4))])
    rows = X.frames(t).select("frame", F.explode(sides).alias("s")).select("frame", "s.*")
    return FR.per_frame(rows, ["frame", "side"], "cells", 8, 4, FR.TEXTURE, FR.texture)


@query("strip_stats", STRIP_SQL + "SELECT * FROM stats", STRIP)
def strip_stats(t):
    """Fourteen texture statistics per strip."""
    return textures(t)


@query("strip_vector", STRIP_SQL + """, arr AS (SELECT frame, side, [mean, std, median, p05, p25, p75, p95, p95_p05, gradient_energy, edge_fraction, laplacian_variance, detail, entropy, mean_square] AS a FROM stats),
vec AS (SELECT u.frame, u.a || w.a || [u.a[1] - w.a[1], u.a[9] - w.a[9], 1e0, 0e0, 1e0] AS v FROM arr u JOIN arr w ON u.frame = w.frame AND u.side = 'up' AND w.side = 'down')
SELECT frame, CAST(i - 1 AS INT) AS position, v[i] AS value FROM vec, range(1, 34) t(i)""", "value")
def strip_vector(t):
    """The 33-value sample vector, one row per entry."""
    vec = R.strip_vector(textures(t), ["frame"], "side", F.lit(False), F.lit(True))
    return vec.select("frame", F.posexplode("vector").alias("position", "value"))


@query("area_resize", X.with_sql(X.CELLS) + """, o AS (SELECT unnest(range(0, 3)) AS k),
w AS (SELECT frame, i.k AS orow, j.k AS ocol, v, greatest(0e0, least(r + 1, (i.k + 1) * 8 / 3e0) - greatest(r, i.k * 8 / 3e0)) * greatest(0e0, least(c + 1, (j.k + 1) * 8 / 3e0) - greatest(c, j.k * 8 / 3e0)) AS w
  FROM cells CROSS JOIN o i CROSS JOIN o j)
SELECT frame, orow, ocol, sum(w * v) / sum(w) AS v FROM w WHERE w > 0 GROUP BY 1, 2, 3""", "v")
def area_resize(t):
    """Area-weighted downsample."""
    return R.area_resize(X.cells(t), ["frame"], 8, 8, 3)


def indexed_frames(t):
    """Frames with their place in the track; only ids are ordered."""
    places = dense_index(X.frames(t).select("track_id", "frame"), ["track_id"], ["frame"], "idx").select("frame", "idx")
    return X.frames(t).join(places, "frame")


@query("consecutive_frames", X.with_sql(X.CELLS, """
ic AS (SELECT *, dense_rank() OVER (PARTITION BY track_id ORDER BY frame) - 1 AS idx FROM cells)""") + """
SELECT a.track_id, a.idx, avg(abs(a.v - b.v)) AS mean_abs_difference, covar_pop(a.v, b.v) / (stddev_pop(a.v) * stddev_pop(b.v)) AS correlation,
  avg(abs(a.v - b.v)) = 0 AS duplicate, avg(abs(a.v - b.v)) < 1e-6 AS near_duplicate
FROM ic a JOIN ic b ON a.track_id = b.track_id AND a.idx = b.idx + 1 AND a.r = b.r AND a.c = b.c GROUP BY 1, 2""", "mean_abs_difference correlation")
def consecutive_frames(t):
    """Change and correlation against the previous frame."""
    return FR.consecutive(indexed_frames(t), "track_id", "idx", "embedding", 8, 8)


@query("hotspot_displacement", HOT_SQL + """, ordered AS (SELECT track_id, frame, cx, cy, row_number() OVER (PARTITION BY track_id ORDER BY frame) - 1 AS idx FROM hot JOIN (SELECT DISTINCT frame, track_id FROM cells) USING (frame))
SELECT track_id, idx, sqrt(power(cx - lag(cx) OVER w, 2) + power(cy - lag(cy) OVER w, 2)) AS displacement FROM ordered WINDOW w AS (PARTITION BY track_id ORDER BY idx)""", "displacement")
def hotspot_displacement(t):
    """Hotspot movement between consecutive frames."""
    from trackloom.operators.ordered import neighbour
    hot = dense_index(hotspots(t, KEY), ["track_id"], ["frame"], "idx")
    near = neighbour(hot, ["track_id"], "idx", ["cx", "cy"], "p_")
    gap = F.sqrt(F.pow(F.col("cx") - F.col("p_cx"), 2) + F.pow(F.col("cy") - F.col("p_cy"), 2))
    return near.select("track_id", "idx", gap.alias("displacement"))


# The activity of a frame is the p99.5 of its cells.
SCORE_SQL = X.with_sql(X.CELLS, "frame_scores AS (SELECT frame, track_id, quantile_cont(v, 0.995) AS score FROM cells GROUP BY 1, 2)")


@query("frame_score", SCORE_SQL + "SELECT frame, track_id, score FROM frame_scores", "score")
def frame_score(t):
    """The p99.5 score of every frame."""
    return FR.frame_scores(X.frames(t), KEY, "embedding", 8, 8)


@query("on_interval_frames", SCORE_SQL + ", scores AS (SELECT track_id, frame, score, row_number() OVER (PARTITION BY track_id ORDER BY frame) - 1 AS idx FROM frame_scores)," + active_sql()
       + "SELECT * FROM active", "threshold")
def on_interval_frames(t):
    """Active interval of each track from its frames' scores."""
    scores = FR.frame_scores(X.frames(t), KEY, "embedding", 8, 8)
    return Q.active_interval(dense_index(scores, ["track_id"], ["frame"], "idx"), ["track_id"], "idx", "score")


# Tiles of 40 vectors as pixel rows of 0.05 mm, ten positions a tile; strips are cut along the rows.
TILE_ROWS, TILE_PX, BLOCK_ROWS = 40, 0.05, 8
CUT_SQL = X.with_sql(f"""placed_rows AS (SELECT CAST(label % 3 AS INT) AS track_id, embedding, row_number() OVER (PARTITION BY label % 3 ORDER BY vec_id) - 1 AS idx FROM embeddings),
tile_rows AS (SELECT track_id, CAST(idx // {TILE_ROWS} AS INT) AS tile_id, CAST(idx % {TILE_ROWS} AS INT) AS r, embedding FROM placed_rows),
tile_sizes AS (SELECT track_id, tile_id, max(r) + 1 AS n FROM tile_rows GROUP BY 1, 2),
px AS (SELECT track_id, tile_id, CAST(k AS INT) AS position, (k + 0.5e0) * 0.2e0 AS x, n FROM tile_sizes, range(0, 10) t(k)),
ranges AS (SELECT *, least(greatest(CAST(floor((x - 0.4e0) / 0.05e0) AS INT), 0), n) AS mask_lo, least(greatest(CAST(ceil((x + 0.4e0) / 0.05e0) AS INT), 0), n) AS mask_hi,
  least(greatest(CAST(ceil((x - 0.4e0 - 1e0) / 0.05e0) AS INT), 0), n) AS up_lo, least(greatest(CAST(floor((x + 0.4e0 + 1e0) / 0.05e0) AS INT), 0), n) AS down_hi FROM px),
strips AS (SELECT track_id, tile_id, position, 'up' AS side, up_lo AS lo, mask_lo AS hi FROM ranges WHERE mask_lo > up_lo
  UNION ALL SELECT track_id, tile_id, position, 'down', mask_hi, down_hi FROM ranges WHERE down_hi > mask_hi),
strip_cells AS (SELECT s.*, r, CAST(c - 1 AS INT) AS c, CAST(embedding[c] AS DOUBLE) + 0.5e0 AS v FROM strips s JOIN tile_rows t ON s.track_id = t.track_id AND s.tile_id = t.tile_id AND r >= lo AND r < hi, range(1, 65) u(c))""")
POSITION = ["track_id", "tile_id", "position"]


def strip_inputs(t):
    """(positions with their ranges, tile rows in blocks)."""
    grey = F.transform("embedding", lambda v: v.cast("double") + d(0.5))
    rows = indexed_frames(t).select("track_id", F.floor(F.col("idx") / TILE_ROWS).cast("int").alias("tile_id"),
                                    (F.col("idx") % TILE_ROWS).cast("int").alias("r"), grey.alias("pixels"))
    tiles = rows.groupBy("track_id", "tile_id").agg((F.max("r") + 1).alias("n"))
    at = tiles.withColumn("position", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("x", (F.col("position") + d(0.5)) * d(0.2))
    ranges = FR.strip_ranges(F.col("x"), d(MASK_HALF_MM), d(CONTEXT_MM), d(TILE_PX), F.col("n"))
    return at.withColumns(ranges), FR.tile_blocks(rows, ["track_id", "tile_id"], "r", "pixels", BLOCK_ROWS)


@query("strip_cut", CUT_SQL + "SELECT track_id, tile_id, position, side, false AS overlap, count(*) AS cells, sum(v) AS total, sum(v * v) AS squares FROM strip_cells GROUP BY 1, 2, 3, 4", "total squares")
def strip_cut(t):
    """The cells of both strips beside the masked centre of each position, read from row blocks."""
    positions, blocks = strip_inputs(t)
    return FR.cut_strips(FR.strips_of(positions, POSITION), POSITION, blocks, ["track_id", "tile_id"], BLOCK_ROWS, 64)


@query("raw_strip_vector", CUT_SQL + """, o AS (SELECT unnest(range(0, 16)) AS k),
wr AS (SELECT DISTINCT track_id, tile_id, position, side, lo, hi, r, k AS orow, greatest(0e0, least(r + 1, lo + (k + 1) * (hi - lo) / 16e0) - greatest(r, lo + k * (hi - lo) / 16e0)) * 16e0 / (hi - lo) AS w FROM strip_cells, o),
wide AS (SELECT s.track_id, s.tile_id, s.position, s.side, orow, CAST(floor(c / 4) AS INT) AS ocol, sum(w * v) / 4e0 AS v FROM strip_cells s JOIN wr USING (track_id, tile_id, position, side, r) WHERE w > 0 GROUP BY 1, 2, 3, 4, 5, 6),
spots AS (SELECT DISTINCT track_id, tile_id, position FROM strips)
SELECT p.track_id, p.tile_id, p.position, CAST(i AS INT) AS entry, coalesce(v, 0e0) AS value FROM spots p CROSS JOIN range(0, 512) e(i) LEFT JOIN wide w ON w.track_id = p.track_id AND w.tile_id = p.tile_id AND w.position = p.position
  AND w.side = CASE WHEN i < 256 THEN 'up' ELSE 'down' END AND w.orow = (i % 256) // 16 AND w.ocol = i % 16""", "value")
def raw_strip_vector(t):
    """The 2 x 16 x 16 area averages of both strips, one row per entry."""
    positions, blocks = strip_inputs(t)
    cut = FR.cut_strips(FR.strips_of(positions, POSITION), POSITION, blocks, ["track_id", "tile_id"], BLOCK_ROWS, 64, 16)
    return FR.raw_vector(cut, POSITION, 16).select(*POSITION, F.posexplode("vector").alias("entry", "value"))


@query("source_inventory", X.with_sql(X.CELLS, """
pf AS (SELECT track_id, frame, min(v) = max(v) AS constant FROM cells GROUP BY 1, 2),
edges AS (SELECT track_id, min(v) AS lo, max(v) AS hi FROM cells GROUP BY 1)""") + """
SELECT c.track_id, count(DISTINCT frame) AS frames, count(*) AS cells, min(v) AS minimum, max(v) AS maximum, count(*) FILTER (WHERE isnan(v)) AS nan_count, count(*) FILTER (WHERE isinf(v)) AS infinite_count,
  avg(CASE WHEN v = 0 THEN 1e0 ELSE 0e0 END) AS zero_fraction, (SELECT avg(CASE WHEN constant THEN 1e0 ELSE 0e0 END) FROM pf WHERE pf.track_id = c.track_id) AS constant_frame_fraction,
  avg(v) AS mean, stddev_pop(v) AS std, quantile_cont(v, 0.01) AS p01, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.99) AS p99,
  avg(CASE WHEN v = lo THEN 1e0 ELSE 0e0 END) AS minimum_fraction, avg(CASE WHEN v = hi THEN 1e0 ELSE 0e0 END) AS maximum_fraction
FROM cells c JOIN edges e ON c.track_id = e.track_id GROUP BY 1""", "minimum maximum zero_fraction constant_frame_fraction mean std p01 p50 p99 minimum_fraction maximum_fraction")
def source_inventory(t):
    """A10: source inventory per track."""
    return R.source_inventory(X.cells(t), "track_id", "frame")


@query("pixelwise_image", X.with_sql(X.CELLS) + "SELECT track_id, r, c, avg(v) AS mean, stddev_pop(v) AS std, median(v) AS median FROM cells GROUP BY 1, 2, 3", "mean std median")
def pixelwise_image(t):
    """Mean, median and std image per track."""
    return R.pixelwise(X.cells(t), "track_id")


# Tile metadata from parts: stage position from the price, pixel size from the part size.
@query("tile_geometry", """WITH tiles AS (SELECT p_brand AS track_id, p_partkey AS tile_id, 1024 AS width_px, 0.005e0 + p_size / 10000e0 AS px_mm, -p_retailprice AS stage_x FROM part),
s AS (SELECT track_id, median(width_px * px_mm) AS field_mm, min(stage_x) AS lo, max(stage_x) AS hi FROM tiles GROUP BY 1),
g AS (SELECT *, ((100 - field_mm / 2) - (20 + field_mm / 2)) / (hi - lo) AS slope, 20 + field_mm / 2 - ((100 - field_mm / 2) - (20 + field_mm / 2)) / (hi - lo) * lo AS intercept FROM s)
SELECT t.track_id, tile_id, field_mm, slope * stage_x + intercept AS centre, slope * stage_x + intercept - field_mm / 2 AS xmin, slope * stage_x + intercept + field_mm / 2 AS xmax
FROM tiles t JOIN g ON t.track_id = g.track_id""", "field_mm centre xmin xmax")
def tile_geometry(t):
    """Endpoint-linear stage geometry."""
    tiles = t.part.select(F.col("p_brand").alias("track_id"), F.col("p_partkey").alias("tile_id"), F.lit(1024).alias("width_px"),
                          (d(0.005) + F.col("p_size") / d(10000)).alias("px_mm"), (-F.col("p_retailprice")).alias("stage_x"))
    return R.tile_geometry(tiles, "track_id").select("track_id", "tile_id", "field_mm", "centre", "xmin", "xmax")


def _plane(n: int) -> str:
    """One least-squares round over kept{n}, residual limits in lim{n}."""
    return f""", mom{n} AS (SELECT track_id, count(*) AS kept, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz FROM kept{n} GROUP BY 1),
ab{n} AS (SELECT *, (xz * yy - yz * xy) / (xx * yy - xy * xy) AS a, (yz * xx - xz * xy) / (xx * yy - xy * xy) AS b FROM mom{n}),
fit{n} AS (SELECT track_id, kept, a, b, mz - a * mx - b * my AS c FROM ab{n}),
res{n} AS (SELECT s.track_id, x, y, z, z - a * x - b * y - c AS res FROM surface s JOIN fit{n} USING (track_id)),
lim{n} AS (SELECT track_id, quantile_cont(res, 0.05) AS lo, quantile_cont(res, 0.95) AS hi FROM res{n} GROUP BY 1),
kept{n + 1} AS (SELECT r.track_id, x, y, z FROM res{n} r JOIN lim{n} USING (track_id) WHERE res >= lo AND res <= hi)"""


PLANE_SQL = X.with_sql(X.SURFACE, "kept0 AS (SELECT track_id, x, y, z FROM surface)") + _plane(0) + _plane(1) + _plane(2)


@query("plane_detrend", PLANE_SQL + "SELECT track_id, kept, a, b, c FROM fit2", "a b c", 4)
def plane_detrend(t):
    """Robust plane, three rounds."""
    return R.robust_plane(X.surface(t), ["track_id"])


@query("levelled_surface", PLANE_SQL + """SELECT s.track_id, count(*) AS n, avg(abs(z - (a * x + b * y + c))) AS mean_abs_height, max(z - (a * x + b * y + c)) AS peak,
  avg(y - 0.01e0 * (x - 25e0)) AS mean_sheared_y FROM surface s JOIN fit2 f USING (track_id) GROUP BY 1""", "mean_abs_height peak mean_sheared_y", 3)
def levelled_surface(t):
    """Heights above the plane and the shear-corrected y."""
    s = X.surface(t)
    level = R.detrend(s, R.robust_plane(s, ["track_id"]), ["track_id"])
    y = R.sheared_y(F.col("x"), F.col("y"), d(0.01), d(25))
    return level.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs("z_levelled")).alias("mean_abs_height"),
                                         F.max("z_levelled").alias("peak"), F.avg(y).alias("mean_sheared_y"))
