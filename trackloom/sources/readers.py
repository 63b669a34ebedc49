"""Scans: files by track, text height grids, CSV/JSON tables, locks and file hashes."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.functions.scalars import HEIGHT_PIXEL_MM, HEIGHT_UNIT_MM, X_END_MM, X_START_MM, d, natural_key
from trackloom.sources.digests import with_sha256

cloudpickle.register_pickle_by_value(sys.modules[__name__])

POSITION_SCHEMA = T.StructType([
    T.StructField("track_id", T.IntegerType()), T.StructField("segment_frame_index", T.IntegerType()),
    T.StructField("raw_frame_index", T.IntegerType()), T.StructField("x_mm_center", T.DoubleType()),
    T.StructField("x_bin_left_mm", T.DoubleType()), T.StructField("x_bin_right_mm", T.DoubleType()),
    T.StructField("thermal_file", T.StringType()), T.StructField("mapping_status", T.StringType())])

HEIGHT_SCHEMA = T.StructType([
    T.StructField("track_id", T.IntegerType()), T.StructField("height_x_index", T.IntegerType()),
    T.StructField("x_local_mm", T.DoubleType()), T.StructField("x_actual_mm", T.DoubleType()),
    T.StructField("valid_fraction", T.DoubleType()), T.StructField("heightmap_file", T.StringType()),
    T.StructField("mapping_status", T.StringType())])


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, name, length of every file below a folder, without reading contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", pattern).load(folder)
    return files.select("path", file_name(F.col("path")).alias("name"), "length")


def find_track_files(files: DataFrame, suffixes: Sequence[str], tokens: str = r"(?:^|[^0-9])([0-9]+)(?=[^0-9]|$)") -> DataFrame:
    """First file per track in natural order; the track id is a whole number token of
    the name, so track 8 never takes a file of track 18."""
    low = F.lower("name")
    wanted = files.where(F.exists(F.array(*[F.lit(s) for s in suffixes]), lambda s: F.endswith(low, s)))
    ids = F.array_distinct(F.regexp_extract_all("name", F.lit(tokens), 1).cast("array<int>"))
    best = F.min(F.struct(natural_key(F.col("name")).alias("k"), "path"))
    return wanted.withColumn("track_id", F.explode(ids)).groupBy("track_id").agg(best["path"].alias("path"))


def content_hashes(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """sha-256 per file; one file per task at most, as many tasks as files. Files are read as streams, so
    neither their length nor a task's memory bounds them."""
    return with_sha256(list_files(spark, folder, pattern)).select("name", "length", "sha256")


#: Bytes of a file that one task hashes at once.
RANGE_BYTES = 64 << 20


def range_hashes(files: DataFrame, size: int = RANGE_BYTES) -> DataFrame:
    """(path, length, part, sha256) of every range of ``size`` bytes of every file in ``files``
    (path, length). Ranges are rows dealt over the cluster, so a file of any size is hashed by many
    tasks, each with a piece of it in memory; an empty file has one empty range."""
    last = F.greatest(F.ceil(F.col("length") / size) - 1, F.lit(0))
    rows = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = []
            for path, part in zip(batch.column("path").to_pylist(), batch.column("part").to_pylist(), strict=True):
                system, name = pafs.FileSystem.from_uri(path)
                done, wanted = hashlib.sha256(), size
                with system.open_input_file(name) as file:
                    file.seek(part * size)
                    while wanted and (piece := file.read(min(wanted, 4 << 20))):
                        done.update(piece)
                        wanted -= len(piece)
                hashes.append(done.hexdigest())
            yield batch.append_column("sha256", pa.array(hashes))

    spread = rows.repartition(F.xxhash64("path", "part"))
    return spread.mapInArrow(read, "path string, length long, part long, sha256 string")


def tree_hashes(files: DataFrame, size: int = RANGE_BYTES) -> DataFrame:
    """(path, length, ranges, sha256): the hash of a file is that of its ranges' hashes, joined in
    order. A file of n ranges gathers n short strings."""
    parts = F.array_sort(F.collect_list(F.struct("part", "sha256")))
    return range_hashes(files, size).groupBy("path", "length").agg(
        F.count(F.lit(1)).alias("ranges"), F.sha2(F.concat_ws("", F.transform(parts, lambda p: p["sha256"])), 256).alias("sha256"))


def height_header(lines: DataFrame, key: Sequence[str]) -> DataFrame:
    """x size, y size and pixel size from the header lines of text height files."""
    parts = F.split(F.trim("value"), r"\s+")
    first, second = F.lower(F.get(parts, F.lit(0))), F.lower(F.get(parts, F.lit(1)))

    def size(axis: str) -> Column:
        hit = (first == axis) & (second == "size")
        return F.max(F.when(hit, F.get(parts, F.lit(2)).try_cast("double").cast("int")))

    pixel = F.max(F.when(first == "pixel_size", F.element_at(parts, -1).try_cast("double")))
    return lines.groupBy(*key).agg(size("x").alias("x_size"), size("y").alias("y_size"),
                                   F.coalesce(pixel, d(HEIGHT_PIXEL_MM)).alias("pixel_mm"))


def height_cells(lines: DataFrame, key: Sequence[str], crop: bool = True) -> DataFrame:
    """Cells of text height files: key, x_local_mm, x_mm, y_mm, z_mm (NULL for Bad).

    A data line is recognised by its own tokens (two coordinates and a height), so
    splits of one file can be parsed in any order. x runs backwards from 100 mm.
    """
    parts = F.split(F.trim("value"), r"\s+")
    x, y = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    z = F.get(parts, F.lit(2))
    rows = lines.select(*key, x.alias("x_local_mm"), (d(X_END_MM) - x).alias("x_mm"), y.alias("y_mm"),
                        z.alias("_z")).where("x_local_mm IS NOT NULL AND y_mm IS NOT NULL AND _z IS NOT NULL")
    ok = (F.lower("_z") == "bad") | F.col("_z").try_cast("double").isNotNull()
    rows = rows.where(ok).withColumn("z_mm", F.col("_z").try_cast("double") * d(HEIGHT_UNIT_MM)).drop("_z")
    return rows.where(F.col("x_mm").between(d(X_START_MM), d(X_END_MM))) if crop else rows


def read_height_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text height files with their file name."""
    return spark.read.text(path).select("value", file_name(F.col("_metadata.file_path")).alias("file"))


def read_height_columns(spark: SparkSession, path: str) -> DataFrame:
    """The same files as a tab-separated table with Bad as NULL; header lines drop out."""
    raw = spark.read.csv(path, sep="\t", nullValue="Bad", schema="x string, y string, z double", mode="PERMISSIVE")
    rows = raw.withColumns({"x": F.col("x").try_cast("double"), "y": F.col("y").try_cast("double")})
    return rows.where("x IS NOT NULL AND y IS NOT NULL")


def read_table(spark: SparkSession, path: str, schema: T.StructType | str, tracks: Sequence[int] | None = None) -> DataFrame:
    """CSV with a declared schema; NaN and 'Bad' are NULL; optional track filter."""
    out = spark.read.csv(path, header=True, schema=schema, nullValue="", nanValue="NaN")
    doubles = [f.name for f in out.schema.fields if isinstance(f.dataType, T.DoubleType)]
    out = out.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in doubles}) if doubles else out
    return out.where(F.col("track_id").isin(*tracks)) if tracks is not None else out


def read_mapping(spark: SparkSession, path: str, track: int, schema: T.StructType = POSITION_SCHEMA) -> DataFrame:
    """A frozen mapping of one track; no rows is an error."""
    out = read_table(spark, path, schema, [track])
    if out.isEmpty():
        raise KeyError(f"no mapping rows for track {track}")
    return out


def write_rows(parts: Sequence[DataFrame], path: str, fmt: str = "csv") -> None:
    """Concatenate with the ordered union of columns and write; empty output is an error."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    if out.isEmpty():
        raise RuntimeError(f"required output is empty: {path}")
    writer = out.write.mode("errorifexists")
    writer.csv(path, header=True) if fmt == "csv" else writer.format(fmt).save(path)


def write_levelled(cells: DataFrame, path: str) -> None:
    """Levelled grids, one folder per (track, method), so a read prunes to its own."""
    cells.repartition("track_id", "method_id").write.mode("errorifexists").partitionBy("track_id", "method_id").parquet(path)


def read_levelled(spark: SparkSession, path: str, track: int, method: str) -> DataFrame:
    return spark.read.parquet(path).where((F.col("track_id") == track) & (F.col("method_id") == method))


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """JSON model artifacts, one object per file."""
    return spark.read.json(path, multiLine=True)


def config_problems(config: DataFrame, tracks_field: str, required: Sequence[str], allowed: dict[str, Sequence[str]]) -> DataFrame:
    """Missing or disallowed keys of each track of a nested config (map of structs or maps)."""
    per = config.select(F.explode(F.map_entries(tracks_field)).alias("_e")).select(
        F.col("_e.key").alias("track"), F.col("_e.value").alias("_v"))
    rules = [F.when(F.col("_v")[k].isNull(), F.concat(F.lit("missing:"), F.lit(k))) for k in required]
    rules += [F.when(F.col("_v")[k].isNotNull() & ~F.col("_v")[k].isin(*v), F.concat(F.lit("not_allowed:"), F.lit(k)))
              for k, v in allowed.items()]
    return per.select("track", F.explode(F.array_compact(F.array(*rules))).alias("problem"))


def review_history(spark: SparkSession, pattern: str, schema: str, track: int) -> DataFrame:
    """Rows of one track from every review table under a pattern, with their file."""
    out = spark.read.csv(pattern, header=True, schema=schema)
    return out.select("*", file_name(F.col("_metadata.file_path")).alias("source_file")).where(F.col("track_id") == track)


def tile_listing(tiles: DataFrame, track: str, tile: str) -> DataFrame:
    """Tile ids per track: unique, contiguous from 1."""
    return tiles.groupBy(track).agg(
        F.count(F.lit(1)).alias("tiles"), F.countDistinct(tile).alias("distinct_tiles"), F.min(tile).alias("first_tile"),
        F.max(tile).alias("last_tile")).withColumn(
        "contiguous", (F.col("first_tile") == 1) & (F.col("last_tile") == F.col("tiles")) & (F.col("distinct_tiles") == F.col("tiles")))
