"""Scalars, readers, integrity helpers."""

import pytest
from pyspark.sql import functions as F

from trackloom.functions import scalars as S
from trackloom.operators import audit as A
from trackloom.session import attach, bounded
from trackloom.sources import readers as IO


def test_truth_and_finite(spark):
    df = spark.createDataFrame([(v,) for v in (" TRUE ", "1", "yes", "no", "", None, "Bad", "nan", "inf", "2.5")], "c string")
    got = [(r[0], r[1]) for r in df.select(S.truth(F.col("c")), S.finite_number(F.col("c"))).collect()]
    assert [g[0] for g in got] == [True, True, True] + [False] * 7
    assert [g[1] for g in got] == [None, 1.0, None, None, None, None, None, None, None, 2.5]


def test_natural_order(spark):
    df = spark.createDataFrame([(v,) for v in ("tile10", "tile2", "tile1", "Tile3")], "c string")
    assert [r[0] for r in df.orderBy(S.natural_key(F.col("c"))).collect()] == ["tile1", "tile2", "Tile3", "tile10"]


def test_pixel_bounds_round_outward_and_inward(spark):
    row = spark.range(1).select(*S.pixel_bounds(F.lit(10.4), F.lit(2.6), F.lit(9), False),
                                *S.pixel_bounds(F.lit(10.4), F.lit(2.6), F.lit(20), True)).first()
    assert tuple(row) == (2, 9, 3, 10)


def test_regions_keep_the_last_edge(spark):
    df = spark.createDataFrame([(v,) for v in (20.0, 39.99, 40.0, 100.0, 100.1, 19.9)], "x double")
    assert [r[0] for r in df.select(S.region(F.col("x"))).collect()] == ["20_40mm", "20_40mm", "40_60mm", "80_100mm", None, None]


def test_sample_id_and_frame_position(spark):
    row = spark.range(1).select(S.sample_id(F.lit(8), F.lit(13)), S.frame_position_mm(F.lit(399), F.lit(400))).first()
    assert row[0] == "T8_F013" and row[1] == pytest.approx(99.9)


def test_track_files_match_whole_tokens(spark):
    files = spark.createDataFrame([(f"/d/{n}", n, 1) for n in ("Thermal_18.mat", "Thermal_8.mat", "Thermal_8b10.mat", "x_8.txt")], "path string, name string, length long")
    got = {r["track_id"]: r["path"] for r in IO.find_track_files(files, [".mat"]).collect()}
    assert got == {18: "/d/Thermal_18.mat", 8: "/d/Thermal_8.mat", 10: "/d/Thermal_8b10.mat"}


def test_height_text(spark, tmp_path):
    (tmp_path / "Heightmap_8.ASC").write_text("X Size\t3\nY Size\t2\nPixel_size\t0.5\nRAW_DATA\t3\t2\n0.0\t0.0\t1000\n0.0\t0.5\tBad\n10.0\t0.0\t-2000\n90.0\t0.5\t5\n")
    lines = IO.read_height_text(spark, str(tmp_path))
    assert tuple(IO.height_header(lines, ["file"]).first())[1:] == (3, 2, 0.5)
    cells = {(r["x_mm"], r["y_mm"]): r["z_mm"] for r in IO.height_cells(lines, ["file"]).collect()}
    assert cells == {(100.0, 0.0): pytest.approx(1e-3), (100.0, 0.5): None, (90.0, 0.0): pytest.approx(-2e-3)}
    assert IO.height_cells(lines, ["file"], crop=False).count() == 4
    assert IO.read_height_columns(spark, str(tmp_path)).count() == 4


def test_empty_mapping_and_empty_output_are_errors(spark, tmp_path):
    path = str(tmp_path / "m")
    IO.write_rows([spark.createDataFrame([(8, 0, 5)], "track_id int, a int, b int"), spark.createDataFrame([(8, 1)], "track_id int, c int")], path)
    assert IO.read_table(spark, path, "track_id int, a int, b int, c int").count() == 2
    assert IO.read_mapping(spark, path, 8, "track_id int, a int, b int, c int").count() == 2
    with pytest.raises(KeyError):
        IO.read_mapping(spark, path, 9, "track_id int, a int, b int, c int")
    with pytest.raises(RuntimeError):
        IO.write_rows([spark.range(0)], str(tmp_path / "n"))


def test_levelled_scan_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "lev")
    cells = spark.createDataFrame([(1, "a", 0.5), (2, "a", 1.5), (2, "b", 2.5)], "track_id int, method_id string, z double")
    IO.write_levelled(cells, path)
    out = IO.read_levelled(spark, path, 2, "b")
    assert [r["z"] for r in out.collect()] == [2.5]
    assert "PartitionFilters: [isnotnull(track_id" in out._jdf.queryExecution().toString()


def test_secret_and_path_rules(spark):
    df = spark.createDataFrame([("password = abcdefghijkl1",), ("password = short",), ("see /home/ann/x and /Users/bob, ok",)], "t string")
    flags = A.privacy_flags(F.col("t"))
    assert [tuple(r) for r in df.select(flags["has_secret"], flags["has_home_path"]).collect()] == [(True, False), (False, False), (False, True)]
    assert df.select(A.sanitize_text(F.col("t"), "/srv/p")).collect()[2][0] == "see ${USER_HOME}/x and ${USER_HOME}, ok"


def test_fingerprint_ignores_order_and_sees_changes(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "k int, v string")
    b = a.orderBy(F.desc("k")).repartition(3)
    c = a.replace("x", "z")
    digests = [A.fingerprint(d, ["k", "v"]).first()["digest"] for d in (a, b, c)]
    assert digests[0] == digests[1] != digests[2]
    assert A.exact_digest(a, ["k", "v"]).first()[0] == A.exact_digest(b, ["k", "v"]).first()[0]
    assert A.exact_digest(a, ["k"]).first()[0] != A.exact_digest(a, ["k", "v"]).first()[0]
    big = spark.range(5000).select((F.col("id") % 700).alias("k"), F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("v"))
    deep = A.exact_digest(big, ["k", "v"], width=16).first()[0]
    assert deep == A.exact_digest(big.repartition(5).orderBy("v"), ["k", "v"], width=16).first()[0]
    assert deep != A.exact_digest(big.union(big.limit(1)), ["k", "v"], width=16).first()[0]


def test_digest_keeps_values_apart(spark):
    rows = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ("", None), (None, ""), ("1:a", "")], "a string, b string")
    assert rows.select(A.row_digest(["a", "b"]).alias("h")).distinct().count() == 5


def test_links_resolve_within_their_host(spark):
    pages = spark.createDataFrame([
        (1, "http://h/a/x.html", '<a href="../b.html">'), (2, "http://h/b.html", '<a href="a/./x.html?q#f"><a href="c">'),
        (3, "http://g/c", '<a href="/b.html"><a href="http://h/no"><a href="mailto:x"><a href="#top">')], "id int, url string, html string")
    links = A.relative_links(pages, "id", "url", "html", 'href="([^"]+)"')
    assert sorted(map(tuple, links.collect())) == [(1, "h", "/b.html"), (2, "h", "/a/x.html"), (2, "h", "/c"), (3, "g", "/b.html")]
    known = pages.select(F.regexp_extract("url", A.URL, 1).alias("host"), F.regexp_extract("url", A.URL, 2).alias("target"))
    assert sorted(r["target"] for r in A.broken_links(links, known, "id").collect()) == ["/b.html", "/c"]


def test_phrase_scan_reports_line_numbers(spark):
    df = spark.createDataFrame([(1, "ok\nThe Official rule\nofficial and OFFICIAL threshold")], "id int, text string")
    got = {(r["line_number"], r["phrase"]) for r in A.phrase_scan(df, "id", "text", ["official rule", "official"]).collect()}
    assert got == {(2, "official rule"), (2, "official"), (3, "official")}


def test_attach_falls_back_to_a_shuffle_join(spark):
    df, side = spark.range(100).withColumnRenamed("id", "k"), spark.range(100).selectExpr("id AS k", "id * 2 AS v")
    assert bounded(side, 10) is None
    assert attach(df, side, ["k"], max_rows=10).agg(F.sum("v")).first()[0] == attach(df, side, ["k"]).agg(F.sum("v")).first()[0] == 9900


def test_config_rules(spark):
    config = spark.createDataFrame([({"8": {"axis": "horizontal", "direction": "up"}, "10": {"direction": "left_to_right"}},)], "tracks map<string,map<string,string>>")
    got = {tuple(r) for r in IO.config_problems(config, "tracks", ["axis"], {"direction": ["left_to_right"]}).collect()}
    assert got == {("8", "not_allowed:direction"), ("10", "missing:axis")}


def test_files_are_hashed_in_ranges(spark, tmp_path):
    """Tree hashes and matrix digests against hashlib."""
    import hashlib

    import numpy as np

    from trackloom.operators import audit as A
    from trackloom.sources import readers as IO

    contents = {"a.bin": bytes(range(256)) * 1000, "b.bin": b"", "c.bin": b"x" * 100, "d.bin": b"y" * 1000}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    files = IO.list_files(spark, str(tmp_path)).select("path", "length")  # Spark lists no empty file
    files = files.unionByName(spark.createDataFrame([(f"file:{tmp_path}/b.bin", 0)], "path string, length long"))
    got = {r["path"].split("/")[-1]: (r["ranges"], r["sha256"]) for r in IO.tree_hashes(files, 100).collect()}
    for name, data in contents.items():
        parts = [data[i:i + 100] for i in range(0, len(data), 100)] or [b""]
        whole = "".join(hashlib.sha256(p).hexdigest() for p in parts)
        assert got[name] == (len(parts), hashlib.sha256(whole.encode()).hexdigest())
    rows = spark.createDataFrame([(1, [1.0, None, -0.5]), (2, []), (3, None)], "k int, m array<float>")
    digests = {r["k"]: r["h"] for r in rows.select("k", A.matrix_digest(F.col("m")).alias("h")).collect()}
    assert digests == {1: hashlib.sha256(np.array([1.0, np.nan, -0.5], "<f8").tobytes()).hexdigest(), 2: hashlib.sha256(b"").hexdigest(), 3: None}


def test_manifest_reads_files_as_streams(spark, tmp_path):
    """Content hashes against hashlib, of files longer than Spark's binary source may read as one value."""
    import hashlib
    import shutil

    from trackloom.plans.catalog import QUERIES

    contents = {"a.parquet": b"x", "b b%20c#d.parquet": bytes(range(256)) * 1000 + b"end", "é.parquet": b"\xef\xbb\xbf\r\n" * 70_000, "deep/f.parquet": b"y" * (1 << 17)}
    for name, data in contents.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    shutil.copy(tmp_path / "a.parquet", tmp_path / "deep" / "a.parquet")
    (tmp_path / "other.txt").write_bytes(b"z")
    want = sorted((name.split("/")[-1], len(data), hashlib.sha256(data).hexdigest()) for name, data in [*contents.items(), ("deep/a.parquet", b"x")])
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        for _ in range(2):
            assert sorted(map(tuple, QUERIES["file_manifest"](spark, str(tmp_path)).collect())) == want
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_manifest_leaves_out_what_the_session_ignores(spark, tmp_path):
    """A file that fails its checksum while it is read: an error, or no row."""
    from trackloom.plans.catalog import QUERIES

    for name in ("a", "b"):
        (tmp_path / f"{name}.parquet").write_bytes(name.encode() * 1000)
    (tmp_path / ".b.parquet.crc").write_bytes(b"crc\0" + (512).to_bytes(4, "big") + bytes(8))
    with pytest.raises(Exception, match="(?i)checksum"):
        QUERIES["file_manifest"](spark, str(tmp_path)).collect()
    spark.conf.set("spark.sql.files.ignoreCorruptFiles", "true")
    try:
        rows = QUERIES["file_manifest"](spark, str(tmp_path))
        assert [r["name"] for r in rows.collect()] == ["a.parquet"]
        assert rows._jdf.queryExecution().executedPlan().toString().count("UDF(") == 1
    finally:
        spark.conf.unset("spark.sql.files.ignoreCorruptFiles")
