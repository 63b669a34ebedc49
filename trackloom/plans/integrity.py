"""Queries: integrity checks, text scans, sources and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trackloom.functions import scalars as S
from trackloom.functions.scalars import d
from trackloom.operators import audit as A
from trackloom.operators import ordered as O
from trackloom.plans import fixtures as X
from trackloom.plans.registry import query
from trackloom.sources import readers as IO
from trackloom.session import attach_one, checkpoint_dir
from trackloom.streaming import streams as W

def digest_sql(*columns: str) -> str:
    """The row digest of the columns: each value with its length, NULL as a sign of its own."""
    parts = ", ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '~')" for c in columns)
    return f"CAST(concat('0x', substr(md5(concat({parts})), 1, 15)) AS BIGINT)"


def scratch(t) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(t.spark)}/trackloom-{uuid.uuid4().hex}"


@query("table_hash", f"""SELECT lang, count(*) AS rows, CAST(sum({digest_sql("doc_id", "lang", "source", "n_chars", "text")}) AS VARCHAR) AS digest FROM documents GROUP BY 1""")
def table_hash(t):
    """Q7: order-independent table fingerprint."""
    return A.fingerprint(t.documents, ["doc_id", "lang", "source", "n_chars", "text"], ["lang"])


@query("immutability_check", """SELECT count(*) AS rows_before, count(*) AS rows_after, true AS unchanged FROM events""")
def immutability_check(t):
    """Q5: the fingerprint of a table before a job, against that of the stored table after it."""
    cols = ["event_id", "user_id", "event_type", "props"]
    a = A.fingerprint(t.events, cols).withColumnsRenamed({"rows": "rows_before", "digest": "h0"})
    path = f"{scratch(t)}/events"
    t.events.write.parquet(path)
    before = a.first()
    stored = t.spark.read.parquet(path)
    stored.groupBy("event_type").agg(F.avg("value")).write.format("noop").mode("overwrite").save()
    b = A.fingerprint(t.spark.read.parquet(path), cols).withColumnsRenamed({"rows": "rows_after", "digest": "h1"})
    return b.withColumns({"rows_before": F.lit(before["rows_before"]), "h0": F.lit(before["h0"])}).select(
        "rows_before", "rows_after", (F.col("h0") == F.col("h1")).alias("unchanged"))


@query("lock_violations", f"""WITH a AS (SELECT doc_id, {digest_sql("text")} AS h FROM documents), b AS (SELECT doc_id, {digest_sql("trim(text)")} AS h FROM documents JOIN labels USING (doc_id))
SELECT violation, count(*) AS n FROM (SELECT CASE WHEN b.h IS NULL THEN 'not_locked' WHEN a.h IS NULL THEN 'missing_artifact' WHEN a.h <> b.h THEN 'hash_mismatch' END AS violation
FROM a FULL JOIN b USING (doc_id)) WHERE violation IS NOT NULL GROUP BY 1""")
def lock_violations(t):
    """Q6: artifact hashes against a lock."""
    a = t.documents.select("doc_id", A.row_digest(["text"]).alias("h"))
    b = t.documents.join(t.labels.select("doc_id"), "doc_id").withColumn("text", F.trim("text"))
    return A.lock_violations(a, b.select("doc_id", A.row_digest(["text"]).alias("h")), ["doc_id"], "h").groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


def audit_table(t):
    per = t.documents.groupBy("lang").agg(F.sum("n_chars").alias("e"), F.sum(F.length("text")).alias("o"),
                                          F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("u"))
    checks = F.array(F.struct(F.lit("length").alias("section"), F.col("e").cast("string").alias("expected"), F.col("o").cast("string").alias("observed"), d(0.5).alias("tolerance")),
                     F.struct(F.lit("unique").alias("section"), F.col("n").cast("string").alias("expected"), F.col("u").cast("string").alias("observed"), d(0).alias("tolerance")))
    return A.audit_rows(per.select(F.col("lang").alias("requirement"), F.explode(checks).alias("c")).select("requirement", "c.*"))


AUDIT_SQL = """WITH per AS (SELECT lang, sum(n_chars) AS e, sum(length(text)) AS o, count(*) AS n, count(DISTINCT doc_id) AS u FROM documents GROUP BY 1),
checks AS (SELECT lang AS requirement, 'length' AS section, CAST(e AS VARCHAR) AS expected, CAST(o AS VARCHAR) AS observed, abs(e - o) <= 0.5e0 AS passed FROM per
  UNION ALL SELECT lang, 'unique', CAST(n AS VARCHAR), CAST(u AS VARCHAR), n = u FROM per)"""


@query("audit_rows", AUDIT_SQL + "SELECT * FROM checks")
def audit_rows(t):
    """Audit rows with pass flags."""
    return audit_table(t).drop("tolerance")


@query("audit_status", AUDIT_SQL + "SELECT count(*) AS checks, count(*) FILTER (WHERE NOT passed) AS failed, CASE WHEN bool_and(passed) THEN 'PASS' ELSE 'FAIL' END AS status FROM checks")
def audit_status(t):
    """Q8: overall status."""
    return A.audit_status(audit_table(t))


@query("metric_assertions", """WITH m AS (SELECT l_returnflag AS k, avg(l_quantity) AS v FROM lineitem GROUP BY 1), f AS (SELECT l_returnflag AS k, round(avg(l_quantity), 5) AS v FROM lineitem GROUP BY 1)
SELECT count(*) AS asserted, count(*) FILTER (WHERE NOT coalesce(abs(m.v - f.v) <= 1e-6, false)) AS violations FROM f LEFT JOIN m ON f.k = m.k""")
def metric_assertions(t):
    """Q9: recomputed metrics against frozen values."""
    m = t.lineitem.groupBy(F.col("l_returnflag").alias("k")).agg(F.avg("l_quantity").alias("v"))
    return A.metric_assertions(m, m.withColumn("v", F.round("v", 5)), ["k"], "v")


PHRASES = ["the", "ment", "sch", "password"]


@query("phrase_scan", """WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_number FROM documents),
p AS (SELECT unnest(['the', 'ment', 'sch', 'password']) AS phrase)
SELECT phrase, count(*) AS hits, count(DISTINCT doc_id) AS docs, CAST(max(line_number) AS INT) AS last_line FROM lines JOIN p ON contains(lower(line), phrase) GROUP BY 1""")
def phrase_scan(t):
    """Q11: phrase hits per line over whole texts."""
    return A.phrase_scan(t.documents, "doc_id", "text", PHRASES).groupBy("phrase").agg(
        F.count(F.lit(1)).alias("hits"), F.countDistinct("doc_id").alias("docs"), F.max("line_number").alias("last_line"))


SECRET_SQL = A.SECRET_PATTERN.replace("'", "''")
HOME_SQL = A.HOME_PATTERN.replace("'", "''")


@query("secret_scan", f"""SELECT source, count(*) AS n, count(*) FILTER (WHERE regexp_matches(text, '{SECRET_SQL}')) AS secrets, count(*) FILTER (WHERE regexp_matches(text, '{HOME_SQL}')) AS home_paths FROM documents GROUP BY 1""")
def secret_scan(t):
    """Q12: credential and home-path scan."""
    flags = A.privacy_flags(F.col("text"))
    return t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(flags["has_secret"]).alias("secrets"),
                                             F.count_if(flags["has_home_path"]).alias("home_paths"))


@query("sanitize_paths", f"""WITH s AS (SELECT page_id, 'see ' || '/home/' || split_part(url, '/', 3) || '/work and /data/run/x ' || substr(url, 1, 0) || url AS raw FROM pages)
SELECT page_id, regexp_replace(replace(replace(raw, '/data/run/', '${{PROJECT_ROOT}}/'), '/data/run', '${{PROJECT_ROOT}}'), '{HOME_SQL}', '${{USER_HOME}}', 'g') AS clean FROM s""")
def sanitize_paths(t):
    """Q12: absolute paths rewritten to placeholders."""
    host = F.get(F.split("url", "/"), F.lit(2))
    raw = F.concat(F.lit("see /home/"), host, F.lit("/work and /data/run/x "), F.col("url"))
    return t.pages.select("page_id", A.sanitize_text(raw, "/data/run").alias("clean"))


@query("matrix_hash")
def matrix_hash(t):
    """Q7: the digest of each frame's values as bytes."""
    return t.embeddings.select("vec_id", A.matrix_digest(F.col("embedding")).alias("sha256"))


@query("file_tree_hashes")
def file_tree_hashes(t):
    """Tree hashes of the given tables' files, in ranges of 64 KB that are read apart."""
    files = IO.list_files(t.spark, t.folder, "*.parquet")
    return IO.tree_hashes(files.select("path", "length"), 64 << 10).withColumn("name", IO.file_name(F.col("path"))).drop("path")


DATASETS = ("thermal", "sem", "height")
DATA_ROOT_SQL = "replace(replace(raw, '/data/run/', '${PROJECT_ROOT}/'), '/data/run', '${PROJECT_ROOT}')"
for _name in DATASETS:
    DATA_ROOT_SQL = f"replace({DATA_ROOT_SQL}, '${{PROJECT_ROOT}}/{_name}/', '${{DATA_ROOT}}/{_name}/')"


@query("sanitize_data_paths", f"""WITH s AS (SELECT page_id, '/data/run/' || CASE page_id % 4 WHEN 0 THEN 'thermal' WHEN 1 THEN 'sem' WHEN 2 THEN 'height' ELSE 'code' END || '/f' || page_id || ' of ' || url AS raw FROM pages)
SELECT page_id, regexp_replace({DATA_ROOT_SQL}, '{HOME_SQL}', '${{USER_HOME}}', 'g') AS clean FROM s""")
def sanitize_data_paths(t):
    """Q12: data folders below the project root rewritten to the data root."""
    folder = F.element_at(F.array(*[F.lit(n) for n in (*DATASETS, "code")]), (F.col("page_id") % 4 + 1).cast("int"))
    raw = F.concat(F.lit("/data/run/"), folder, F.lit("/f"), F.col("page_id").cast("string"), F.lit(" of "), F.col("url"))
    return t.pages.select("page_id", A.sanitize_text(raw, "/data/run", DATASETS).alias("clean"))


@query("table_exact_digest", """WITH p AS (SELECT sha256('{"s_suppkey":' || s_suppkey || ',"s_nationkey":' || s_nationkey || '}') AS h, count(*) AS n FROM supplier GROUP BY 1),
k AS (SELECT 1 + count(*) // 7 AS parts FROM p), l0 AS (SELECT CAST('0x' || substr(h, 1, 15) AS BIGINT) % parts AS part, h || ':' || n AS own FROM p, k),
d0 AS (SELECT part, sha256(string_agg(own, ',' ORDER BY own)) AS own FROM l0 GROUP BY 1),
d1 AS (SELECT part // 7 AS part, sha256(string_agg(lpad(CAST(part AS VARCHAR), 20, '0') || ':' || own, ',' ORDER BY lpad(CAST(part AS VARCHAR), 20, '0'))) AS own FROM d0 GROUP BY 1),
d2 AS (SELECT part // 7 AS part, sha256(string_agg(lpad(CAST(part AS VARCHAR), 20, '0') || ':' || own, ',' ORDER BY lpad(CAST(part AS VARCHAR), 20, '0'))) AS own FROM d1 GROUP BY 1),
d3 AS (SELECT part // 7 AS part, sha256(string_agg(lpad(CAST(part AS VARCHAR), 20, '0') || ':' || own, ',' ORDER BY lpad(CAST(part AS VARCHAR), 20, '0'))) AS own FROM d2 GROUP BY 1),
d4 AS (SELECT part // 7 AS part, sha256(string_agg(lpad(CAST(part AS VARCHAR), 20, '0') || ':' || own, ',' ORDER BY lpad(CAST(part AS VARCHAR), 20, '0'))) AS own FROM d3 GROUP BY 1)
SELECT own AS sha256 FROM (SELECT 0 AS l, max(own) AS own, count(*) AS c FROM d0 UNION ALL SELECT 1, max(own), count(*) FROM d1 UNION ALL SELECT 2, max(own), count(*) FROM d2
  UNION ALL SELECT 3, max(own), count(*) FROM d3 UNION ALL SELECT 4, max(own), count(*) FROM d4) WHERE c = 1 ORDER BY l LIMIT 1""")
def table_exact_digest(t):
    """Q7: a digest of a whole table as a tree of hashes, here of width seven."""
    return A.exact_digest(t.supplier.select("s_suppkey", "s_nationkey"), ["s_suppkey", "s_nationkey"], 7)


@query("broken_links", r"""WITH links AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)([^?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://([^/?#]+)([^?#]*)', 2) AS base,
  unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS t FROM pages), rel AS (SELECT *, trim(regexp_replace(t, '[?#].*$', '')) AS r FROM links),
whole AS (SELECT page_id, host, regexp_replace(CASE WHEN starts_with(r, '/') THEN r ELSE regexp_replace(base, '[^/]*$', '') || r END, '/\.?$', '/') AS p
  FROM rel WHERE r <> '' AND NOT contains(r, '://') AND NOT starts_with(r, 'mailto:')),
kept AS (SELECT page_id, host, array_to_string(list_reduce(list_transform(string_split(p, '/'), lambda s: [s]), lambda a, s: CASE WHEN s[1] = '..' THEN a[1:greatest(len(a) - 1, 1)] WHEN s[1] = '.' THEN a ELSE list_concat(a, s) END), '/') AS target FROM whole),
known AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]+)([^?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://([^/?#]+)([^?#]*)', 2) AS target FROM pages)
SELECT host, target, count(*) AS links, min(page_id) AS first_page_id FROM kept ANTI JOIN known USING (host, target) GROUP BY 1, 2""")
def broken_links(t):
    """Q13: links within a host to pages that do not exist there."""
    links = A.relative_links(t.pages, "page_id", "url", "html", r'href="([^"]+)"')
    known = t.pages.select(F.regexp_extract("url", A.URL, 1).alias("host"), F.regexp_extract("url", A.URL, 2).alias("target"))
    return A.broken_links(links, known, "page_id")


@query("file_manifest")
def file_manifest(t):
    """The table files with size and content hash."""
    return IO.content_hashes(t.spark, t.folder, "*.parquet")


@query("manifest_summary", """SELECT lang AS category, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes, max(n_chars) AS largest, count(*) FILTER (WHERE n_chars > 52428800) AS over_50_mb, count(*) FILTER (WHERE n_chars > 104857600) AS over_100_mb,
  count(*) FILTER (WHERE lower(regexp_extract(source || '.' || lang, '(\\.[^.]+)$', 1)) IN ('.mat', '.fr')) AS forbidden FROM documents GROUP BY 1""".replace("\\\\", "\\"))
def manifest_summary(t):
    """Q14: sizes, limits and forbidden extensions per category."""
    files = t.documents.select(F.col("lang").alias("category"), F.concat("source", F.lit("."), "lang").alias("name"), F.col("n_chars").alias("length"))
    return A.manifest_summary(files, [".mat", ".fr"])


# Sources.


@query("natural_order", """SELECT n, array_to_string(list_transform(regexp_extract_all(lower(n), '(\\d+|\\D+)'), lambda p: CASE WHEN regexp_matches(p, '^\\d+$') THEN lpad(p, 20, '0') ELSE p END), '') AS sort_key FROM (
SELECT c_name AS n FROM customer UNION ALL SELECT s_name FROM supplier)""".replace("\\\\", "\\"))
def natural_order(t):
    """Natural sort key."""
    names = t.customer.select(F.col("c_name").alias("n")).unionByName(t.supplier.select(F.col("s_name").alias("n")))
    return names.select("n", S.natural_key(F.col("n")).alias("sort_key"))


@query("track_files", """SELECT CAST(regexp_extract(s_name, '([0-9]+)', 1) AS INT) AS track_id, min(s_name || '.MAT') AS path FROM supplier GROUP BY 1""")
def track_files(t):
    """First file per exact track token."""
    files = t.supplier.select(F.concat("s_name", F.lit(".MAT")).alias("name"), F.concat("s_name", F.lit(".MAT")).alias("path"))
    return IO.find_track_files(files, [".mat"])


@query("tile_listing", """SELECT p_brand, count(*) AS tiles, count(DISTINCT p_partkey) AS distinct_tiles, min(p_partkey) AS first_tile, max(p_partkey) AS last_tile,
  min(p_partkey) = 1 AND max(p_partkey) = count(*) AND count(DISTINCT p_partkey) = count(*) AS contiguous FROM part GROUP BY 1 UNION ALL
SELECT 'supplier', count(*), count(DISTINCT s_suppkey), min(s_suppkey), max(s_suppkey), min(s_suppkey) = 1 AND max(s_suppkey) = count(*) AND count(DISTINCT s_suppkey) = count(*) FROM supplier""")
def tile_listing(t):
    """Unique and contiguous tile ids."""
    tiles = t.part.select("p_brand", "p_partkey").unionByName(t.supplier.select(F.lit("supplier").alias("p_brand"), F.col("s_suppkey").alias("p_partkey")))
    return IO.tile_listing(tiles, "p_brand", "p_partkey")


@query("tag_values", """SELECT p_partkey, CAST(p_size AS DOUBLE) / 1000 AS px_mm, -p_retailprice AS stage_x, CAST(NULL AS DOUBLE) AS stage_y FROM part""", "px_mm stage_x stage_y")
def tag_values(t):
    """Numbers read from an image text tag."""
    tag = F.concat(F.lit("image pixel size = "), F.col("p_size").cast("string"), F.lit(" um\nStage at X="), (-F.col("p_retailprice")).cast("decimal(12,2)").cast("string"), F.lit(" mm"))
    rows = t.part.select("p_partkey", tag.alias("tag"))
    return rows.select("p_partkey", (S.tag_value(F.col("tag"), "Image Pixel Size") / 1000).alias("px_mm"),
                       S.tag_value(F.col("tag"), "Stage at X").alias("stage_x"), S.tag_value(F.col("tag"), "Stage at Y").alias("stage_y"))


@query("tile_metadata_audit", """WITH m AS (SELECT p_brand AS track_id, p_partkey AS tile_id, p_retailprice AS stage_x, md5(p_name) AS h, p_size BETWEEN 1 AND 50 AS size_ok, lag(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS prev FROM part)
SELECT track_id, count(*) AS tiles, bool_and(size_ok) AS sizes_ok, coalesce(bool_and(stage_x < prev), true) AS strictly_decreasing, count(DISTINCT h) AS distinct_hashes, count(DISTINCT h) = count(*) AS hashes_unique FROM m GROUP BY 1""")
def tile_metadata_audit(t):
    """Dimensions, strictly decreasing stage x and distinct hashes."""
    rows = t.part.select(F.col("p_brand").alias("track_id"), F.col("p_partkey").alias("tile_id"), F.col("p_retailprice").alias("stage_x"),
                         F.md5("p_name").alias("h"), F.col("p_size").between(1, 50).alias("size_ok"))
    near = O.neighbour(O.assign_blocks(rows, ["tile_id"], groups=["track_id"]).df, ["track_id"], "tile_id", ["stage_x"], "p_")
    return near.groupBy("track_id").agg(
        F.count(F.lit(1)).alias("tiles"), F.bool_and("size_ok").alias("sizes_ok"),
        F.coalesce(F.bool_and(F.col("stage_x") < F.col("p_stage_x")), F.lit(True)).alias("strictly_decreasing"),
        F.countDistinct("h").alias("distinct_hashes"), (F.countDistinct("h") == F.count(F.lit(1))).alias("hashes_unique"))


def height_text(t) -> str:
    """Text height files, one folder per track, written from the profiles."""
    folder = scratch(t)
    cells = X.profiles(t).select("track_id", F.concat_ws("\t", (F.col("vec_id") * 0.5).cast("decimal(12,3)").cast("string"),
                                 F.col("iy").cast("string"), F.coalesce((F.col("z") * 1e6).cast("decimal(14,3)").cast("string"), F.lit("Bad"))).alias("value"))
    head = cells.select("track_id").distinct().select("track_id", F.explode(F.array(
        F.lit("X Size\t500"), F.lit("Y Size\t64"), F.lit("Pixel_size\t0.5"), F.lit("RAW_DATA\t3\t64"))).alias("value"))
    head.unionByName(cells).write.partitionBy("track_id").text(folder)
    return folder


@query("height_text_grid", X.with_sql(X.PROFILES) + """SELECT track_id, count(*) AS cells, count(z) AS valid, min(100e0 - vec_id * 0.5e0) AS x_first, max(100e0 - vec_id * 0.5e0) AS x_last, avg(round(z * 1e6, 3) * 1e-6) AS mean_z
FROM profiles WHERE 100e0 - vec_id * 0.5e0 BETWEEN 20 AND 100 GROUP BY 1""", "x_first x_last mean_z")
def height_text_grid(t):
    """Text height files parsed by each line's own tokens, cropped to the window."""
    lines = t.spark.read.text(height_text(t))
    cells = IO.height_cells(lines, ["track_id"])
    return cells.groupBy("track_id").agg(F.count(F.lit(1)).alias("cells"), F.count("z_mm").alias("valid"),
                                         F.min("x_mm").alias("x_first"), F.max("x_mm").alias("x_last"), F.avg("z_mm").alias("mean_z"))


@query("height_text_header", X.with_sql(X.PROFILES) + "SELECT DISTINCT track_id, 500 AS x_size, 64 AS y_size, 0.5e0 AS pixel_mm FROM profiles", "pixel_mm")
def height_text_header(t):
    """S3: header sizes of text height files."""
    return IO.height_header(t.spark.read.text(height_text(t)), ["track_id"])


@query("height_text_columns", X.with_sql(X.PROFILES) + "SELECT count(*) AS cells, count(z) AS valid, avg(round(z * 1e6, 3)) AS mean_z FROM profiles", "mean_z", 3)
def height_text_columns(t):
    """The same files as a tab-separated table with Bad as missing."""
    rows = IO.read_height_columns(t.spark, height_text(t))
    return rows.groupBy().agg(F.count(F.lit(1)).alias("cells"), F.count("z").alias("valid"), F.avg("z").alias("mean_z"))


@query("csv_round_trip", X.with_sql(X.POSITIONS) + "SELECT track_id, count(*) AS n, sum(y) AS total, count(*) FILTER (WHERE event_type = 'click') AS clicks FROM positions WHERE track_id IN (1, 3) GROUP BY 1", "total", 4)
def csv_round_trip(t):
    """Rows written as CSV and scanned back with a schema and a track filter."""
    folder = scratch(t)
    p = X.positions(t).select("track_id", "seg", "y", "event_type")
    IO.write_rows([p.drop("event_type").where("event_type <> 'click'"), p.where("event_type = 'click'")], folder)
    rows = IO.read_table(t.spark, folder, "track_id int, seg int, y double, event_type string", [1, 3])
    return rows.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("total"), F.count("event_type").alias("clicks"))


@query("levelled_scan", X.with_sql(X.SURFACE) + "SELECT track_id, 'raw' AS method_id, count(*) AS n, avg(z) AS mean_z FROM surface WHERE track_id = 2 GROUP BY 1", "mean_z")
def levelled_scan(t):
    """Partitioned grids read back for one track and method."""
    folder = scratch(t)
    s = X.surface(t).select("track_id", "x", "y", "z")
    IO.write_levelled(s.withColumn("method_id", F.lit("raw")).unionByName(s.withColumn("method_id", F.lit("halved")).withColumn("z", F.col("z") / 2)), folder)
    rows = IO.read_levelled(t.spark, folder, 2, "raw")
    return rows.groupBy("track_id", "method_id").agg(F.count(F.lit(1)).alias("n"), F.avg("z").alias("mean_z"))


@query("artifact_round_trip", """SELECT 'model_' || l_returnflag AS model_id, avg(l_quantity) AS intercept, 2 AS features FROM lineitem GROUP BY 1""", "intercept")
def artifact_round_trip(t):
    """Model artifacts written and read as JSON."""
    folder = scratch(t)
    t.lineitem.groupBy(F.concat(F.lit("model_"), "l_returnflag").alias("model_id")).agg(
        F.avg("l_quantity").alias("intercept"), F.array(F.avg("l_tax"), F.avg("l_discount")).alias("coefficients")).write.json(folder)
    rows = t.spark.read.json(folder)
    return rows.select("model_id", "intercept", F.size("coefficients").alias("features"))


@query("config_rules", """SELECT 'r' || s_suppkey AS track, 'missing:axis' AS problem FROM supplier WHERE s_acctbal < 0 UNION ALL
SELECT 'r' || s_suppkey, 'not_allowed:direction' FROM supplier WHERE s_acctbal > 5000""")
def config_rules(t):
    """Required and allowed keys of per-track configs."""
    entry = F.struct(F.concat(F.lit("r"), F.col("s_suppkey").cast("string")).alias("key"), F.create_map(
        F.lit("axis"), F.when(F.col("s_acctbal") >= 0, "horizontal"), F.lit("direction"),
        F.when(F.col("s_acctbal") > 5000, "sideways").otherwise("left_to_right")).alias("value"))
    config = t.supplier.select(F.map_from_entries(F.array(entry)).alias("tracks"))
    return IO.config_problems(config, "tracks", ["axis", "direction"], {"direction": ["left_to_right", "right_to_left"]})


@query("review_history", """SELECT CAST(o_custkey % 4 AS INT) AS track_id, o_orderstatus, count(*) AS n FROM orders WHERE o_custkey % 4 = 3 GROUP BY 1, 2""")
def review_history(t):
    """One track's rows from every review table under a pattern."""
    folder = scratch(t)
    rows = t.orders.select((F.col("o_custkey") % 4).cast("int").alias("track_id"), F.col("o_orderstatus").alias("st"), "o_orderstatus", "o_orderkey")
    rows.write.partitionBy("st").csv(folder, header=True)
    found = IO.review_history(t.spark, f"{folder}/*/*.csv", "track_id int, o_orderstatus string, o_orderkey long", 3)
    return found.groupBy("track_id", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("typed_values", """WITH raw AS (SELECT item_id, regexp_extract(text, '([A-Za-z]+)', 1) AS word FROM benchmark UNION ALL SELECT doc_id, CASE WHEN toxic = 1 THEN ' Yes ' WHEN quality = 1 THEN '1.5' ELSE 'Bad' END FROM labels)
SELECT word, count(*) AS n, coalesce(lower(trim(word)) IN ('true', '1', 'yes'), false) AS truth, CASE WHEN word = '1.5' THEN 1.5e0 END AS value, CASE WHEN word = '1.5' THEN 1.5e0 ELSE 0e0 END AS with_default FROM raw GROUP BY 1""", "value with_default")
def typed_values(t):
    """Text to boolean and finite number."""
    a = t.benchmark.select(F.regexp_extract("text", "([A-Za-z]+)", 1).alias("word"))
    b = t.labels.select(F.when(F.col("toxic") == 1, " Yes ").when(F.col("quality") == 1, "1.5").otherwise("Bad").alias("word"))
    w = F.col("word")
    return a.unionByName(b).groupBy("word").agg(F.count(F.lit(1)).alias("n")).select(
        "word", "n", S.truth(w).alias("truth"), S.finite_number(w).alias("value"), S.finite_number(w, 0.0).alias("with_default"))


@query("sample_ids", X.with_sql(X.POSITIONS) + "SELECT 'T' || track_id || '_F' || lpad(CAST(seg AS VARCHAR), CAST(greatest(3, length(CAST(seg AS VARCHAR))) AS INT), '0') AS sample_id, track_id, seg, x_mm, x_mm * x_mm AS x_sq FROM positions", "x_mm x_sq")
def sample_ids(t):
    """Sample ids and position features."""
    x, x2 = S.powers(F.col("x_mm"), 2)
    return X.positions(t).select(S.sample_id(F.col("track_id"), F.col("seg")).alias("sample_id"), "track_id", "seg", x.alias("x_mm"), x2.alias("x_sq"))


@query("counts_by_key", "SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2")
def counts_by_key(t):
    """Counts by key."""
    return t.documents.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))


# Streams over the events, in event time; a single run over all available files.
STREAM_SQL = """WITH ev AS (SELECT CAST(user_id % 4 AS INT) AS track_id, event_id, user_id, event_type, ts, value FROM events), mx AS (SELECT max(ts) AS top FROM ev)"""


def event_rows(t):
    s = W.event_stream(t.spark, f"{t.folder}/events*.parquet")
    return s.select((F.col("user_id") % 4).cast("int").alias("track_id"), "event_id", "user_id", "event_type", "ts", "value")


@query("stream_tumbling_error", STREAM_SQL + """, w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, track_id, value - 50e0 AS e FROM ev)
SELECT CAST(epoch(window_start) AS BIGINT) AS start_s, track_id, count(*) AS n, avg(abs(e)) AS mae, avg(-e) AS signed_bias, sqrt(avg(e * e)) AS rmse FROM w, mx WHERE window_start + INTERVAL 6 HOUR <= top - INTERVAL 1 HOUR GROUP BY 1, 2""", "mae signed_bias rmse")
def stream_tumbling_error(t):
    """Tumbling error monitor, windows final after the watermark."""
    s = W.windowed_error(event_rows(t).withColumn("p", d(50)), ["track_id"], "value", "p", "6 hours")
    out = W.run_to_files(s, scratch(t))
    return out.select(F.unix_seconds("window_start").alias("start_s"), "track_id", "n", "mae", "signed_bias", "rmse")


@query("stream_sliding_error", STREAM_SQL + """, w AS (SELECT time_bucket(INTERVAL 3 HOUR, ts) - INTERVAL 3 HOUR * k AS window_start, value - 50e0 AS e FROM ev, (VALUES (0), (1)) s(k))
SELECT CAST(epoch(window_start) AS BIGINT) AS start_s, count(*) AS n, avg(abs(e)) AS mae FROM w, mx WHERE window_start + INTERVAL 6 HOUR <= top - INTERVAL 1 HOUR GROUP BY 1""", "mae")
def stream_sliding_error(t):
    """Sliding error monitor."""
    s = W.windowed_error(event_rows(t).withColumn("p", d(50)), [], "value", "p", "6 hours", "3 hours")
    return W.run_to_files(s, scratch(t)).select(F.unix_seconds("window_start").alias("start_s"), "n", "mae")


@query("stream_dedup", "SELECT DISTINCT user_id, event_type, value FROM events", "value")
def stream_dedup(t):
    """Repeats dropped within the watermark."""
    s = W.drop_repeats(event_rows(t), ["user_id", "event_type", "value"], "30 days")
    return W.run_to_files(s, scratch(t)).select("user_id", "event_type", "value")


@query("stream_on_session", STREAM_SQL + """, hot AS (SELECT track_id, ts, value, CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 MINUTE THEN 1 WHEN lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM ev WHERE value > 80 WINDOW w AS (PARTITION BY track_id ORDER BY ts)),
ses AS (SELECT *, sum(fresh) OVER (PARTITION BY track_id ORDER BY ts) AS k FROM hot)
SELECT track_id, CAST(epoch_us(min(ts)) AS BIGINT) AS start_us, count(*) AS n, max(value) AS peak FROM ses, mx GROUP BY track_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= any_value(top) - INTERVAL 1 HOUR""", "peak")
def stream_on_session(t):
    """Activity sessions above a threshold."""
    s = W.on_sessions(event_rows(t), ["track_id"], "value", 80.0, "30 minutes")
    return W.run_to_files(s, scratch(t)).select("track_id", F.unix_micros("session_start").alias("start_us"), "n", "peak")


@query("stream_causal_context", """SELECT user_id, event_id, avg(value) OVER w AS context_mean, CAST(count(*) OVER w AS INT) AS context_size FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""", "context_mean")
def stream_causal_context(t):
    """Mean over the current and four previous values per key, kept as state."""
    s = W.causal_context(event_rows(t), "user_id", "event_id", "value", 4)
    return W.run_to_files(s, scratch(t))
