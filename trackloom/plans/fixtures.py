"""Domain tables derived from the given Parquet tables, in Spark and as SQL text.

Each Spark function and the SQL of the same name give equal rows. Positions are
rows of ``events`` in time order per track, with a missing index where an error
event was; the other tables are named in their functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions.scalars import d, position_mm
from trackloom.operators.ordered import BLOCK, dense_index, neighbour
from trackloom.plans.registry import Tables
from trackloom.session import attach


def all_positions(t: Tables) -> DataFrame:
    """track_id, seg, event_id, event_type, y for every event; keeps the block column."""
    events = t.events.select(
        (F.col("user_id") % 4).cast("int").alias("track_id"), "ts", "event_id", "event_type",
        F.col("value").alias("y"))
    return dense_index(events, ["track_id"], ["ts", "event_id"], "seg").drop("ts").withColumn(
        "seg", F.col("seg").cast("int"))


def positions(t: Tables, blocks: bool = False) -> DataFrame:
    """Positions with gaps and their x; error events are the missing indices."""
    out = all_positions(t).where(F.col("event_type") != "error").withColumn(
        "x_mm", position_mm(F.col("seg")))
    return out if blocks else out.drop(BLOCK)


POSITIONS = """
all_positions AS (
  SELECT CAST(user_id % 4 AS INT) AS track_id,
         CAST(row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) - 1 AS INT) AS seg,
         event_id, event_type, value AS y
  FROM events),
positions AS (
  SELECT *, 20e0 + 0.2e0 * (seg + 0.5e0) AS x_mm FROM all_positions WHERE event_type <> 'error')
"""


def predictions(t: Tables, blocks: bool = False) -> DataFrame:
    """Two models per position, long form: the track mean and the previous value."""
    pos = positions(t, blocks=True)
    near = neighbour(pos, ["track_id"], "seg", ["y"], "prev_")
    means = pos.groupBy("track_id").agg(F.avg("y").alias("track_mean"))
    wide = attach(near, means, ["track_id"]).withColumn("previous", F.coalesce("prev_y", "y"))
    keep = ["track_id", "seg", "x_mm", "y"] + ([BLOCK] if blocks else [])
    return wide.unpivot(keep, ["track_mean", "previous"], "model_id", "p")


PREDICTIONS = POSITIONS + """,
predictions AS (
  SELECT track_id, seg, x_mm, y, 'track_mean' AS model_id, avg(y) OVER (PARTITION BY track_id) AS p FROM positions
  UNION ALL
  SELECT track_id, seg, x_mm, y, 'previous', lag(y, 1, y) OVER (PARTITION BY track_id ORDER BY seg) FROM positions)
"""


def tiles(t: Tables) -> DataFrame:
    """Image tiles of four tracks, one per supplier, in reversed physical order."""
    key = F.col("s_suppkey")
    xmin = d(15.0) + d(5.0) * key
    return t.supplier.select(
        (key % 4).cast("int").alias("track_id"), key.alias("tile_id"), (-key).alias("tile_order"), xmin.alias("xmin"),
        (xmin + d(7.5)).alias("xmax"), d(7.5 / 1024).alias("px_mm"))


TILES = """
tiles AS (
  SELECT CAST(s_suppkey % 4 AS INT) AS track_id, s_suppkey AS tile_id, -s_suppkey AS tile_order, 15e0 + 5e0 * s_suppkey AS xmin,
         15e0 + 5e0 * s_suppkey + 7.5e0 AS xmax, CAST(0.00732421875 AS DOUBLE) AS px_mm
  FROM supplier)
"""


def probes(t: Tables) -> DataFrame:
    """Requested positions, one per order."""
    return t.orders.select(
        F.col("o_orderkey").alias("probe_id"), (F.col("o_custkey") % 4).cast("int").alias("track_id"),
        (d(20.0) + F.col("o_totalprice") / d(1000.0)).alias("x_req"))


PROBES = """
probes AS (
  SELECT o_orderkey AS probe_id, CAST(o_custkey % 4 AS INT) AS track_id,
         20e0 + o_totalprice / 1000e0 AS x_req FROM orders)
"""


def gate_rows(t: Tables) -> DataFrame:
    """Documents as samples, their labels as a partial 0/1 reference."""
    docs = t.documents.select(
        F.col("doc_id").alias("sample_id"), F.col("lang").alias("track_id"), "source",
        F.col("n_chars").cast("double").alias("n_chars"))
    refs = t.labels.select(F.col("doc_id").alias("sample_id"), "quality", "toxic")
    return docs.join(refs, "sample_id", "left")


GATE_ROWS = """
gate_rows AS (
  SELECT d.doc_id AS sample_id, d.lang AS track_id, d.source, CAST(d.n_chars AS DOUBLE) AS n_chars,
         l.quality, l.toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
"""


def frames(t: Tables) -> DataFrame:
    """Each vector as an 8x8 frame in one array."""
    return t.embeddings.select(F.col("vec_id").alias("frame"), (F.col("label") % 3).cast("int").alias("track_id"), "embedding")


def cells(t: Tables) -> DataFrame:
    """Each vector as an 8x8 frame in long form."""
    return t.embeddings.select(
        F.col("vec_id").alias("frame"), (F.col("label") % 3).cast("int").alias("track_id"),
        F.posexplode("embedding").alias("i", "v0")).select(
        "frame", "track_id", F.floor(F.col("i") / 8).cast("int").alias("r"),
        (F.col("i") % 8).cast("int").alias("c"), F.col("v0").cast("double").alias("v"))


CELLS = """
cells AS (
  SELECT vec_id AS frame, CAST(label % 3 AS INT) AS track_id, CAST(floor((i - 1) / 8) AS INT) AS r,
         CAST((i - 1) % 8 AS INT) AS c, CAST(embedding[i] AS DOUBLE) AS v
  FROM embeddings, range(1, 65) t(i))
"""


def profiles(t: Tables) -> DataFrame:
    """Each vector as a height profile, missing where |v| > 0.2."""
    v = F.col("v0").cast("double")
    return t.embeddings.select(
        "vec_id", (F.col("label") % 3).cast("int").alias("track_id"),
        F.posexplode("embedding").alias("iy", "v0")).select(
        "vec_id", "track_id", "iy", (d(0.05) + F.col("iy") * d(1.80) / d(63)).alias("y_mm"),
        F.when(F.abs(v) <= d(0.2), v).alias("z"))


PROFILES = """
profiles AS (
  SELECT vec_id, CAST(label % 3 AS INT) AS track_id, CAST(i - 1 AS INT) AS iy,
         0.05e0 + (i - 1) * 1.80e0 / 63e0 AS y_mm,
         CASE WHEN abs(CAST(embedding[i] AS DOUBLE)) <= 0.2e0 THEN CAST(embedding[i] AS DOUBLE) END AS z
  FROM embeddings, range(1, 65) t(i))
"""


def surface(t: Tables) -> DataFrame:
    """Scattered height points per track."""
    return t.lineitem.select(
        (F.col("l_suppkey") % 4).cast("int").alias("track_id"), F.col("l_orderkey"), "l_linenumber",
        F.col("l_quantity").alias("x"), (F.col("l_tax") * 100).alias("y"),
        F.col("l_extendedprice").alias("z"))


SURFACE = """
surface AS (
  SELECT CAST(l_suppkey % 4 AS INT) AS track_id, l_orderkey, l_linenumber, l_quantity AS x, l_tax * 100 AS y,
         l_extendedprice AS z FROM lineitem)
"""


def regression_rows(t: Tables) -> DataFrame:
    """Grouped regression rows: three features and a target."""
    return t.lineitem.select(
        (F.col("l_suppkey") % 4).cast("int").alias("track_id"), "l_orderkey", "l_linenumber",
        F.col("l_quantity").alias("f1"), F.col("l_discount").alias("f2"), F.col("l_tax").alias("f3"),
        (F.col("l_extendedprice") / d(10000)).alias("y"))


REGRESSION = """
regression_rows AS (
  SELECT CAST(l_suppkey % 4 AS INT) AS track_id, l_orderkey, l_linenumber, l_quantity AS f1, l_discount AS f2,
         l_tax AS f3, l_extendedprice / 10000e0 AS y FROM lineitem)
"""


def with_sql(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip().strip(",").strip() for p in parts) + "\n"
