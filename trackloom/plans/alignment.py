"""Queries: joins, set comparison and neighbour context."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import scalars as S
from trackloom.functions.scalars import d
from trackloom.operators import joins as J
from trackloom.operators import labels as L
from trackloom.plans import fixtures as X
from trackloom.plans.registry import query
from trackloom.session import attach_one

SIDES_SQL = X.with_sql(X.POSITIONS, X.PROBES, """
backward AS (SELECT p.*, q.x_mm AS bx, q.seg AS bk FROM probes p ASOF LEFT JOIN positions q ON p.track_id = q.track_id AND p.x_req >= q.x_mm),
forward AS (SELECT p.*, q.x_mm AS ax, q.seg AS ak FROM probes p ASOF LEFT JOIN positions q ON p.track_id = q.track_id AND p.x_req <= q.x_mm),
both_sides AS (SELECT b.*, f.ax, f.ak FROM backward b JOIN forward f USING (probe_id))""")


@query("nearest_position", SIDES_SQL + """SELECT probe_id, track_id, x_req,
  CASE WHEN bk IS NULL OR ak IS NULL THEN NULL WHEN x_req - bx <= ax - x_req THEN bx ELSE ax END AS selected_x,
  CASE WHEN bk IS NULL OR ak IS NULL THEN NULL WHEN x_req - bx <= ax - x_req THEN bk ELSE ak END AS selected_index,
  CASE WHEN bk IS NULL OR ak IS NULL THEN NULL WHEN x_req - bx <= ax - x_req THEN abs(bx - x_req) ELSE abs(ax - x_req) END AS coordinate_error
FROM both_sides""", "x_req selected_x coordinate_error")
def nearest_position(t):
    """Nearest position per probe, never outside the support."""
    return J.nearest_position(X.probes(t), X.positions(t), ["track_id"], "x_req", "x_mm", "seg", "probe_id")


@query("window_lookup", SIDES_SQL + """,
hits AS (SELECT p.probe_id, min(q.seg) AS k0, max(q.seg) AS k1, min(q.x_mm) AS x0, max(q.x_mm) AS x1 FROM probes p JOIN positions q
  ON p.track_id = q.track_id AND q.x_mm BETWEEN p.x_req - 0.15e0 AND p.x_req + 0.15e0 GROUP BY 1),
picked AS (SELECT *, bk IS NOT NULL AND ak IS NOT NULL AS inside, CASE WHEN bk IS NULL OR ak IS NULL THEN NULL WHEN x_req - bx <= ax - x_req THEN bx ELSE ax END AS nx,
  CASE WHEN bk IS NULL OR ak IS NULL THEN NULL WHEN x_req - bx <= ax - x_req THEN bk ELSE ak END AS nk FROM both_sides LEFT JOIN hits USING (probe_id))
SELECT track_id, probe_id, x_req, nx AS selected_x, abs(nx - x_req) AS coordinate_error,
  CASE WHEN inside THEN coalesce(k0, nk) END AS index_start, CASE WHEN inside THEN coalesce(k1, nk) + 1 END AS index_end,
  CASE WHEN inside THEN coalesce(x0, nx) END AS x_start, CASE WHEN inside THEN coalesce(x1, nx) END AS x_end,
  CASE WHEN NOT inside THEN 'outside_support' WHEN k0 IS NOT NULL THEN 'window' ELSE 'nearest' END AS status
FROM picked""", "x_req selected_x coordinate_error x_start x_end")
def window_lookup(t):
    """Index range of the positions in a window around each probe."""
    return J.window_lookup(X.probes(t), X.positions(t), ["track_id"], "x_req", "x_mm", "seg", 0.15, "probe_id")


TILE_SQL = X.with_sql(X.POSITIONS, X.TILES, """
cand AS (SELECT p.track_id, seg, x_mm, tile_id, tile_order, (x_mm - xmin) / px_mm AS u,
    least((x_mm - xmin) / px_mm, 1023e0 - (x_mm - xmin) / px_mm) AS edge,
    xmin <= x_mm - 1.4e0 AND xmax >= x_mm + 1.4e0 AS wide
  FROM positions p JOIN tiles t ON xmin <= x_mm AND xmax >= x_mm AND p.track_id = t.track_id),
mapped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id, seg ORDER BY edge DESC, tile_order) AS rn FROM cand) WHERE rn = 1),
context AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id, seg ORDER BY edge DESC, tile_order) AS rn FROM cand WHERE wide) WHERE rn = 1),
placed AS (SELECT p.track_id, p.seg, p.x_mm, m.tile_id, m.u, m.edge, c.tile_id AS context_tile, c.u AS context_u,
    CASE WHEN m.tile_id IS NULL THEN 'outside_tiles' WHEN c.tile_id IS NULL THEN 'context_not_supported' ELSE 'available' END AS outcome
  FROM positions p LEFT JOIN mapped m USING (track_id, seg) LEFT JOIN context c USING (track_id, seg))""")


def placed(t):
    samples = X.positions(t).select("track_id", "seg", "x_mm")
    return J.best_tiles(samples, X.tiles(t), ["track_id", "seg"], "x_mm",
                        S.MASK_HALF_MM + S.CONTEXT_MM, 1024, 2.5, groups=["track_id"])


@query("interval_best_tile", TILE_SQL + "SELECT track_id, seg, x_mm, tile_id, u, edge FROM placed", "x_mm u edge")
def interval_best_tile(t):
    """The containing tile farthest from its edge, with the local pixel."""
    return placed(t).select("track_id", "seg", "x_mm", "mapped.tile_id", "mapped.u", "mapped.edge")


@query("context_support", TILE_SQL + "SELECT track_id, seg, tile_id, context_tile, outcome FROM placed")
def context_support(t):
    """Mapping and context outcome per position."""
    return placed(t).select("track_id", "seg", "mapped.tile_id", F.col("context.tile_id").alias("context_tile"),
                            J.tile_outcome().alias("outcome"))


@query("pixel_directions", TILE_SQL + """SELECT track_id, seg, tile_id, (x_mm - xmin) / px_mm AS increasing_px, (xmax - x_mm) / px_mm AS decreasing_px, CASE WHEN tile_id % 2 = 0 THEN (x_mm - xmin) / px_mm ELSE (xmax - x_mm) / px_mm END AS own_px
FROM (SELECT track_id, seg, x_mm, tile_id FROM placed WHERE tile_id IS NOT NULL) JOIN (SELECT tile_id, xmin, xmax, px_mm FROM tiles) USING (tile_id)""", "increasing_px decreasing_px own_px")
def pixel_directions(t):
    """The pixel of a position along increasing, decreasing and its tile's own direction."""
    at = placed(t).where("mapped IS NOT NULL").select("track_id", "seg", "x_mm", "mapped.tile_id").where("tile_id IS NOT NULL")
    at = at.join(X.tiles(t).drop("track_id"), "tile_id")
    px = lambda way: S.pixel_position(F.col("x_mm"), F.col("xmin"), F.col("xmax"), F.col("px_mm"), way)
    return at.select("track_id", "seg", "tile_id", px(F.lit(True)).alias("increasing_px"), px(F.lit(False)).alias("decreasing_px"),
                     px(F.col("tile_id") % 2 == 0).alias("own_px"))


@query("strip_bounds", TILE_SQL + """, px AS (SELECT *, (x_mm - xmin) / px_mm AS u0 FROM placed JOIN (SELECT tile_id AS context_tile, xmin, px_mm FROM tiles) USING (context_tile)),
b AS (SELECT track_id, seg, xmin, px_mm, x_mm,
  greatest(0, CAST(floor((x_mm - 0.4e0 - xmin) / px_mm) AS BIGINT)) AS mask_lo, least(1024, CAST(ceil((x_mm + 0.4e0 - xmin) / px_mm) AS BIGINT)) AS mask_hi,
  greatest(0, CAST(ceil((x_mm - 0.4e0 - 1e0 - xmin) / px_mm) AS BIGINT)) AS up_lo, least(1024, CAST(floor((x_mm - 0.4e0 - xmin) / px_mm) AS BIGINT)) AS up_hi,
  greatest(0, CAST(ceil((x_mm + 0.4e0 - xmin) / px_mm) AS BIGINT)) AS down_lo, least(1024, CAST(floor((x_mm + 0.4e0 + 1e0 - xmin) / px_mm) AS BIGINT)) AS down_hi FROM px)
SELECT track_id, seg, mask_lo, mask_hi, up_lo, up_hi, down_lo, down_hi, up_hi > mask_lo OR down_lo < mask_hi AS overlap,
  (x_mm - 20e0) / px_mm AS mosaic_px, up_lo || ':' || up_hi AS up_text FROM b""", "mosaic_px")
def strip_bounds(t):
    """Masked and kept pixel ranges around each position, overlap asserted."""
    at = placed(t).where("context IS NOT NULL").select("track_id", "seg", "x_mm", "context.tile_id")
    at = at.join(X.tiles(t).drop("track_id"), "tile_id")
    x, m, c = F.col("x_mm"), d(S.MASK_HALF_MM), d(S.CONTEXT_MM)

    def px(e):
        return S.pixel_position(e, F.col("xmin"), F.col("xmax"), F.col("px_mm"), F.lit(True))

    size = F.lit(1024)
    mask = S.pixel_bounds(px(x - m), px(x + m), size, False)
    up = S.pixel_bounds(px(x - m - c), px(x - m), size, True)
    down = S.pixel_bounds(px(x + m), px(x + m + c), size, True)
    return at.select(
        "track_id", "seg", mask[0].alias("mask_lo"), mask[1].alias("mask_hi"), up[0].alias("up_lo"),
        up[1].alias("up_hi"), down[0].alias("down_lo"), down[1].alias("down_hi"),
        ((up[1] > mask[0]) | (down[0] < mask[1])).alias("overlap"),
        S.mosaic_pixel(x, F.col("px_mm")).alias("mosaic_px"), S.bounds_text(up[0], up[1]).alias("up_text"))


@query("neighbour_status", X.with_sql(X.POSITIONS) + """SELECT a.track_id, a.seg AS centre_index, a.seg + o.k AS seg,
  CASE WHEN b.seg IS NULL THEN 'missing_frame' WHEN b.event_type = 'error' THEN 'outside_coverage' ELSE 'queryable' END AS query_status, b.y
FROM all_positions a CROSS JOIN (VALUES (-1), (0), (1)) o(k) LEFT JOIN all_positions b ON b.track_id = a.track_id AND b.seg = a.seg + o.k""", "y")
def neighbour_status(t):
    """Previous, own and next frame with their status."""
    rows = X.all_positions(t).withColumn("covered", F.col("event_type") != "error")
    return J.neighbour_status(rows, ["track_id"], "seg", "covered", ["y"])


LAGS = list(range(-5, 6))


@query("lag_panel", X.with_sql(X.POSITIONS) + """SELECT a.track_id, l.lag, l.lag > 0 AS future, count(*) AS n, avg(abs(a.y - b.y)) AS mae
FROM positions a CROSS JOIN (SELECT unnest(range(-5, 6)) AS lag) l JOIN positions b ON b.track_id = a.track_id AND b.seg = a.seg + l.lag
GROUP BY 1, 2, 3""", "mae")
def lag_panel(t):
    """Error of the value at each lag, gaps dropped."""
    panel = J.lag_panel(X.positions(t), ["track_id"], "seg", "y", LAGS)
    return panel.groupBy("track_id", "lag", "future").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("y") - F.col("shifted"))).alias("mae"))


@query("best_lag", X.with_sql(X.POSITIONS, """
lagged AS (SELECT a.track_id, l.lag, avg(abs(a.y - b.y)) AS mae
FROM positions a CROSS JOIN (SELECT unnest([-5, -4, -3, -2, -1, 1, 2, 3, 4, 5]) AS lag) l JOIN positions b ON b.track_id = a.track_id AND b.seg = a.seg + l.lag
GROUP BY 1, 2),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY round(mae, 9), lag) AS rn FROM lagged) WHERE rn = 1)""")
+ "SELECT track_id, lag, mae, (SELECT count(DISTINCT lag) FROM best) = 1 AS consistent FROM best", "mae")
def best_lag(t):
    """T4: best non-zero lag per track and whether all tracks agree."""
    panel = J.lag_panel(X.positions(t), ["track_id"], "seg", "y", [v for v in LAGS if v])
    mae = F.round(F.avg(F.abs(F.col("y") - F.col("shifted"))), 9)  # +k and -k pair the same rows
    scores = panel.groupBy("track_id", "lag").agg(mae.alias("mae"))
    best = scores.groupBy("track_id").agg(F.min(F.struct("mae", "lag")).alias("b"))
    agree = best.groupBy().agg((F.countDistinct("b.lag") == 1).alias("consistent"))
    return attach_one(best.select("track_id", "b.lag", "b.mae"), agree)


@query("causal_context", X.with_sql(X.POSITIONS, """
steps AS (SELECT a.track_id, a.seg, k.k AS previous_count, o.o, a.y, b.y AS other FROM positions a CROSS JOIN (VALUES (1), (2), (4)) k(k)
  CROSS JOIN (SELECT unnest(range(0, 5)) AS o) o LEFT JOIN positions b ON b.track_id = a.track_id AND b.seg = a.seg - o.o WHERE o.o <= k.k)""")
+ """SELECT track_id, seg, previous_count, avg(coalesce(other, y)) AS context_mean,
  max(y) - max(CASE WHEN o = previous_count THEN coalesce(other, y) END) AS context_change, bool_or(other IS NULL) AS padded
FROM steps GROUP BY 1, 2, 3""", "context_mean context_change")
def causal_context(t):
    """Current and preceding positions, missing ones padded and flagged."""
    return J.causal_context(X.positions(t), ["track_id"], "seg", "y")


@query("tolerance_match", X.with_sql(X.POSITIONS) + """SELECT track_id, count(*) AS pairs, max(abs(a.x_mm - b.x2)) < 1e-6 AS within
FROM positions a JOIN (SELECT track_id, seg, 20.1e0 + seg / 5e0 AS x2 FROM all_positions) b USING (track_id, seg) WHERE abs(a.x_mm - b.x2) < 1e-6 GROUP BY 1""")
def tolerance_match(t):
    """Rows of the same track within 1e-6 mm."""
    other = X.all_positions(t).select("track_id", (d(20.1) + F.col("seg") / d(5)).alias("x2"))
    pairs = J.tolerance_join(X.positions(t), other, ["track_id"], "x_mm", "x2", 1e-6, 0.01)
    return pairs.groupBy("track_id").agg(
        F.count(F.lit(1)).alias("pairs"), (F.max(F.abs(F.col("x_mm") - F.col("x2"))) < 1e-6).alias("within"))


@query("rounded_key_merge", X.with_sql(X.POSITIONS) + """SELECT a.track_id, count(*) AS rows_matched, sum(a.y * b.y) AS cross_sum
FROM positions a JOIN (SELECT track_id, seg, y, CAST(round((20.1e0 + seg / 5e0) * 10000e0) AS BIGINT) AS k FROM all_positions) b
ON a.track_id = b.track_id AND CAST(round(a.x_mm * 10000e0) AS BIGINT) = b.k GROUP BY 1""", "cross_sum", 4)
def rounded_key_merge(t):
    """Merge on x rounded to four decimals through an integer key."""
    a = X.positions(t).withColumn("k", S.fixed_key(F.col("x_mm"), 4))
    b = X.all_positions(t).select("track_id", F.col("y").alias("y2"),
                                  S.fixed_key(d(20.1) + F.col("seg") / d(5), 4).alias("k"))
    return a.join(b, ["track_id", "k"]).groupBy("track_id").agg(
        F.count(F.lit(1)).alias("rows_matched"), F.sum(F.col("y") * F.col("y2")).alias("cross_sum"))


@query("reference_override", """WITH pilot AS (SELECT c_custkey AS k, c_acctbal / 1000e0 AS l, c_acctbal / 1000e0 + 1e0 + c_nationkey / 10e0 AS r FROM customer),
repeated AS (SELECT o_custkey AS k, min(o_totalprice) / 10000e0 AS l, max(o_totalprice) / 10000e0 AS r FROM orders GROUP BY 1),
adjud AS (SELECT s_suppkey AS k, s_acctbal / 1000e0 AS l, s_acctbal / 1000e0 + 1.5e0 AS r FROM supplier)
SELECT p.k AS sample_id, CASE WHEN a.k IS NOT NULL THEN 'adjudication_1' ELSE 'pilot_1' END AS reference_source,
  CASE WHEN a.k IS NOT NULL THEN a.r - a.l ELSE p.r - p.l END AS width, CASE WHEN a.k IS NOT NULL THEN (a.l + a.r) / 2 ELSE (p.l + p.r) / 2 END AS centre,
  abs((p.r - p.l) - (q.r - q.l)) AS repeat_difference,
  CASE WHEN q.k IS NULL THEN 'not_repeated' WHEN abs((p.r - p.l) - (q.r - q.l)) <= 0.05e0 THEN 'stable' ELSE 'ambiguous' END AS stability
FROM pilot p LEFT JOIN repeated q ON p.k = q.k LEFT JOIN adjud a ON p.k = a.k""", "width centre repeat_difference")
def reference_override(t):
    """Three-way reference join, the adjudicated value wins."""
    bal = F.col("c_acctbal") / d(1000)
    pilot = t.customer.select(F.col("c_custkey").alias("sample_id"), bal.alias("left"),
                              (bal + 1 + F.col("c_nationkey") / d(10)).alias("right"))
    repeat = t.orders.groupBy(F.col("o_custkey").alias("sample_id")).agg(
        (F.min("o_totalprice") / d(10000)).alias("left"), (F.max("o_totalprice") / d(10000)).alias("right"))
    sbal = F.col("s_acctbal") / d(1000)
    adjud = t.supplier.select(F.col("s_suppkey").alias("sample_id"), sbal.alias("left"), (sbal + d(1.5)).alias("right"))
    return J.override_references(pilot, repeat, adjud, "sample_id")


@query("validated_mapping", """SELECT count(*) AS n, count(*) FILTER (WHERE o.o_orderkey IS NULL) AS missing_order,
  count(*) FILTER (WHERE p.p_partkey IS NULL) AS missing_part,
  count(*) FILTER (WHERE abs(l.l_extendedprice - l.l_quantity * p.p_retailprice) > 1e-9) AS price_mismatch
FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey LEFT JOIN part p ON l.l_partkey = p.p_partkey""")
def validated_mapping(t):
    """Rows must exist in both maps with equal values; violations are counted."""
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.lit(True).alias("has_o"))
    p = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_retailprice", F.lit(True).alias("has_p"))
    rows = t.lineitem.join(o, "l_orderkey", "left").join(p, "l_partkey", "left")
    gap = F.abs(F.col("l_extendedprice") - F.col("l_quantity") * F.col("p_retailprice")) > d(1e-9)
    return rows.groupBy().agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("has_o").isNull()).alias("missing_order"),
        F.count_if(F.col("has_p").isNull()).alias("missing_part"), F.count_if(gap).alias("price_mismatch"))


@query("label_feature_join", """SELECT d.lang, l.quality, count(*) AS n, avg(d.n_chars) AS mean_chars
FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY 1, 2""", "mean_chars")
def label_feature_join(t):
    """Labels joined to features on their key."""
    return t.labels.join(t.documents.select("doc_id", "lang", "n_chars"), "doc_id").groupBy("lang", "quality").agg(
        F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("mean_chars"))


@query("cohort_intersection", """SELECT d.lang, count(*) AS n FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
AND d.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1""")
def cohort_intersection(t):
    """Cohort as a chain of semi and anti joins."""
    good = t.labels.where("quality = 1").select("doc_id")
    bad = t.labels.where("toxic = 1").select("doc_id")
    return t.documents.select("doc_id", "lang").join(good, "doc_id", "left_semi").join(
        bad, "doc_id", "left_anti").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("frame_fetch_bounds", X.with_sql(X.POSITIONS) + """SELECT p.track_id, count(*) AS requested, count(e.vec_id) AS found, count(*) - count(e.vec_id) AS out_of_bounds
FROM positions p LEFT JOIN embeddings e ON p.seg = e.vec_id GROUP BY 1""")
def frame_fetch_bounds(t):
    """Frames fetched by raw index, out-of-range requests counted."""
    frames = t.embeddings.select(F.col("vec_id").alias("seg"), F.lit(1).alias("hit"))
    return X.positions(t).join(frames, "seg", "left").groupBy("track_id").agg(
        F.count(F.lit(1)).alias("requested"), F.count("hit").alias("found"),
        (F.count(F.lit(1)) - F.count("hit")).alias("out_of_bounds"))


@query("flag_merge", X.with_sql(X.PREDICTIONS, X.TILES, """
flags AS (SELECT CAST(floor(xmin / 5e0) AS BIGINT) AS k, tile_id FROM tiles)""") + """
SELECT model_id, tile_id IS NOT NULL AS tile_known, count(*) AS n, avg(abs(p - y)) AS mae
FROM predictions LEFT JOIN flags ON CAST(floor(x_mm / 5e0) AS BIGINT) = k GROUP BY 1, 2""", "mae")
def flag_merge(t):
    """Predictions with an optional manifest flag."""
    flags = X.tiles(t).select(F.floor(F.col("xmin") / d(5)).alias("k"), "tile_id")
    rows = X.predictions(t).withColumn("k", F.floor(F.col("x_mm") / d(5))).join(flags, "k", "left")
    return rows.groupBy("model_id", F.col("tile_id").isNotNull().alias("tile_known")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("p") - F.col("y"))).alias("mae"))


DIFF_SQL = """WITH a AS (SELECT doc_id, lang, source, CAST(n_chars AS DOUBLE) AS n_chars FROM documents),
b AS (SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'unknown' ELSE d.lang END AS lang, replace(d.source, 'src', 'src\\') AS source,
  CAST(length(d.text) AS DOUBLE) AS n_chars FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
j AS (SELECT a.doc_id AS ka, b.doc_id AS kb, a.lang AS la, b.lang AS lb, a.source AS sa, b.source AS sb, a.n_chars AS na, b.n_chars AS nb
  FROM a FULL JOIN b ON a.doc_id = b.doc_id),
diffs AS (
  SELECT coalesce(ka, kb) AS doc_id, 'row' AS field, 'missing_right' AS category, NULL AS expected, NULL AS observed FROM j WHERE kb IS NULL UNION ALL
  SELECT ka, 'lang', 'exact', la, lb FROM j WHERE ka IS NOT NULL AND kb IS NOT NULL AND la IS DISTINCT FROM lb UNION ALL
  SELECT ka, 'n_chars', 'tolerance', CAST(na AS VARCHAR), CAST(nb AS VARCHAR) FROM j WHERE ka IS NOT NULL AND kb IS NOT NULL AND NOT (abs(na - nb) <= 1e-9) UNION ALL
  SELECT ka, 'source', 'path', sa, sb FROM j WHERE ka IS NOT NULL AND kb IS NOT NULL AND replace(sa, '\\', '/') <> replace(sb, '\\', '/'))
"""


def document_diff(t):
    a = t.documents.select("doc_id", "lang", "source", F.col("n_chars").cast("double").alias("n_chars"))
    b = t.documents.join(t.labels, "doc_id").select(
        "doc_id", F.when(F.col("toxic") == 1, "unknown").otherwise(F.col("lang")).alias("lang"),
        F.replace("source", F.lit("src"), F.lit("src\\")).alias("source"),
        F.length("text").cast("double").alias("n_chars"))
    return J.table_diff(a, b, ["doc_id"], exact=["lang"], tolerance={"n_chars": 1e-9}, paths=["source"])


@query("table_diff", DIFF_SQL + "SELECT field, category, count(*) AS mismatches FROM diffs GROUP BY 1, 2")
def table_diff(t):
    """Key-aligned comparison with exact, tolerance and path rules."""
    return J.diff_summary(document_diff(t))


@query("first_mismatches", DIFF_SQL + "SELECT doc_id, field, category FROM diffs ORDER BY doc_id, field, category LIMIT 50")
def first_mismatches(t):
    """T5: the first fifty mismatches in key order."""
    return J.first_mismatches(document_diff(t), ["doc_id"]).select("doc_id", "field", "category")


@query("frame_equality", X.with_sql(X.POSITIONS) + """SELECT count(*) FILTER (WHERE a.seg IS NULL OR b.seg IS NULL OR NOT abs(a.x_mm - b.x2) <= 1e-9) AS violations,
  count(*) FILTER (WHERE a.seg IS NULL OR b.seg IS NULL OR NOT abs(a.x_mm - b.x2) <= 1e-9) = 0 AS equal FROM positions a
FULL JOIN (SELECT track_id, seg, 20.1e0 + seg / 5e0 AS x2 FROM positions) b ON a.track_id = b.track_id AND a.seg = b.seg""")
def frame_equality(t):
    """Two computations of one table agree to 1e-9."""
    a = X.positions(t).select("track_id", "seg", "x_mm")
    b = a.select("track_id", "seg", (d(20.1) + F.col("seg") / d(5)).alias("x_mm"))
    diff = J.table_diff(a, b, ["track_id", "seg"], tolerance={"x_mm": 1e-9})
    return diff.groupBy().agg(F.count(F.lit(1)).alias("violations"), (F.count(F.lit(1)) == 0).alias("equal"))


FOLDS_SQL = X.with_sql(X.POSITIONS) + """, roles AS (SELECT f.fold, p.track_id, p.seg, CASE WHEN p.track_id = f.fold THEN 'validation' ELSE 'train' END AS role
FROM positions p CROSS JOIN (VALUES (0), (1), (2), (3)) f(fold)) """


def position_roles(t):
    tracks = L.tracks_of(t.events.select((F.col("user_id") % 4).cast("int").alias("track_id")), "track_id")
    return J.fold_roles(X.positions(t), "track_id", tracks)


@query("fold_roles", FOLDS_SQL + "SELECT fold, role, count(*) AS n FROM roles GROUP BY 1, 2")
def fold_roles(t):
    """Whole-track folds."""
    return position_roles(t).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"))


@query("split_leakage", FOLDS_SQL + "SELECT fold, track_id, count(DISTINCT role) AS roles, count(*) AS n, count(DISTINCT role) > 1 AS leak FROM roles GROUP BY 1, 2")
def split_leakage(t):
    """Q10: no track in both roles of a fold."""
    return J.role_leaks(position_roles(t), "track_id")


@query("row_concat", """SELECT kind, count(*) AS n, count(v) AS with_value, count(balance) AS with_balance FROM (
  SELECT 'customer' AS kind, c_custkey AS k, NULL AS v, c_acctbal AS balance FROM customer UNION ALL
  SELECT 'part', p_partkey, p_retailprice, NULL FROM part) GROUP BY 1""")
def row_concat(t):
    """Concatenation with the union of columns."""
    a = t.customer.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance"))
    b = t.part.select(F.lit("part").alias("kind"), F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("v"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.count("v").alias("with_value"), F.count("balance").alias("with_balance"))


@query("ordered_id_equality", """WITH a AS (SELECT l_orderkey AS id FROM lineitem), b AS (SELECT o_orderkey AS id FROM orders)
SELECT *, only_left = 0 AND only_right = 0 AS equal FROM (SELECT (SELECT count(*) FROM (SELECT id FROM a EXCEPT ALL SELECT id FROM b)) AS only_left,
(SELECT count(*) FROM (SELECT id FROM b EXCEPT ALL SELECT id FROM a)) AS only_right)""")
def ordered_id_equality(t):
    """Equality of two id lists with multiplicity."""
    return J.multiset_gap(t.lineitem.select(F.col("l_orderkey").alias("id")), t.orders.select(F.col("o_orderkey").alias("id")))


@query("set_equality", """WITH a AS (SELECT DISTINCT l_suppkey AS id FROM lineitem), b AS (SELECT DISTINCT s_suppkey AS id FROM supplier)
SELECT *, only_left = 0 AND only_right = 0 AS equal FROM (SELECT (SELECT count(*) FROM (SELECT id FROM a EXCEPT SELECT id FROM b)) AS only_left,
(SELECT count(*) FROM (SELECT id FROM b EXCEPT SELECT id FROM a)) AS only_right)""")
def set_equality(t):
    """Equality of two id sets."""
    return J.multiset_gap(t.lineitem.select(F.col("l_suppkey").alias("id")).distinct(),
                          t.supplier.select(F.col("s_suppkey").alias("id")).distinct())


@query("prediction_consistency", X.with_sql(X.PREDICTIONS) + """SELECT count(*) AS samples, count(*) FILTER (WHERE n <> m) AS duplicate_rows,
  count(*) FILTER (WHERE lo <> hi) AS target_conflicts, max(m) - min(m) AS model_count_range FROM (
  SELECT track_id, seg, count(*) AS n, count(DISTINCT model_id) AS m, min(y) AS lo, max(y) AS hi FROM predictions GROUP BY 1, 2)""")
def prediction_consistency(t):
    """Same ids and targets across models, no duplicates."""
    return J.prediction_consistency(X.predictions(t), ["track_id", "seg"], "model_id", "y")
