"""Session settings, durable materialisation and size-checked broadcasts."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BROADCAST_ROWS = 50_000
#: What a broadcast or local table may weigh beside its bound of rows.
BROADCAST_BYTES = 64 << 20
SALTS = 16
#: Rows of a packed block at least.
PACK_ROWS = 4096


def build_session(master: str, app: str = "trackloom", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; clusters pass their own."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names, or a temporary one where it names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="trackloom-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame, spread: bool = False) -> DataFrame:
    """Write ``df`` as Parquet below the checkpoint folder and read it back, so later passes
    read the columns they need instead of recomputing, and the loss of an executor loses nothing.

    ``spread`` rewrites a table of fewer files than half the task slots, as from one small
    file, over all of them: for tables that many passes will read.
    """
    spark = df.sparkSession
    base = f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(base)
    out = spark.read.schema(df.schema).parquet(base)
    slots = spark.sparkContext.defaultParallelism
    if spread and 2 * len(out.inputFiles()) <= slots:
        out.repartition(slots).write.parquet(f"{base}-spread")
        out = spark.read.schema(df.schema).parquet(f"{base}-spread")
    return out


def pack(df: DataFrame, names: Sequence[str], track: str | None = None, folds: Sequence = (None,)) -> DataFrame:
    """(k, n, block): the DOUBLE columns ``names`` of ``df`` as blocks of at least PACK_ROWS rows, or
    what a task has left, written for many passes. A block is a matrix with a row a column of
    ``df``; it holds rows of the k-th of ``folds`` alone. A pass so decodes no single row."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {k: [] for k in range(len(folds))}

        def flush(k: int) -> pa.RecordBatch:
            line, held[k] = np.concatenate(held[k], axis=1), []
            return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([line.shape[1]], pa.int32()),
                                               pa.array([np.ascontiguousarray(line).tobytes()], pa.binary())], ["k", "n", "block"])

        for batch in batches:
            line = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names])
            key = None if track is None else batch.column(track).to_pandas().to_numpy()
            for k, fold in enumerate(folds):
                part = line if track is None else line[:, key == fold]
                if part.shape[1]:
                    held[k].append(part)
                if sum(x.shape[1] for x in held[k]) >= PACK_ROWS:
                    yield flush(k)
        yield from (flush(k) for k in held if held[k])

    rows = df.select(*names, *([] if track is None else [track])).mapInArrow(blocks, "k int, n int, block binary")
    base = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    # Small row groups: Parquet is read a batch of rows at a time, and these rows are large.
    rows.write.option("parquet.block.size", 8 << 20).parquet(base)
    return df.sparkSession.read.schema("k int, n int, block binary").parquet(base)


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row: 8 a value, the length of strings, 8 an array element."""
    parts = [F.lit(0).cast("long")]
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("array", "map"):
            parts.append(F.greatest(F.size(f.name), F.lit(1)).cast("long") * 8)
        elif kind in ("string", "binary"):
            parts.append(F.coalesce(F.octet_length(f.name), F.lit(0)).cast("long") + 8)
        else:
            parts.append(F.lit(8 if kind != "struct" else 64).cast("long"))
    return sum(parts[1:], parts[0])


def is_small(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` is within both bounds, by one aggregate over at most ``max_rows + 1`` rows."""
    rows, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(row_bytes(df))).first()
    return rows <= max_rows and (size or 0) <= BROADCAST_BYTES


def broadcast_if_small(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows and BROADCAST_BYTES;
    unhinted otherwise, for a shuffle join."""
    return F.broadcast(df) if is_small(df, max_rows) else df


def bounded(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame | None:
    """``df`` as a local table if it has at most ``max_rows`` rows and BROADCAST_BYTES, else None.

    Rows of plain numbers are bounded by their number alone, so the aggregate behind ``df``
    runs once; rows with arrays or text are weighed before any of them is fetched.
    """
    wide = any(f.dataType.typeName() in ("array", "map", "struct", "string", "binary") for f in df.schema.fields)
    if wide and not is_small(df, max_rows):
        return None
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return None
    return df.sparkSession.createDataFrame(rows, df.schema)


def settle(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Compute ``df`` once: as a local table when small, else in the checkpoint folder."""
    local = bounded(df, max_rows)
    return materialize(df) if local is None else local


def attach(df: DataFrame, side: DataFrame, on: Sequence[str], how: str = "left",
           max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join a summary table back to its rows.

    The summary is broadcast when its row count has been checked. A larger one is
    copied to each salt of a shuffle join, so the rows of a hot key spread over
    several tasks.
    """
    local = bounded(side, max_rows)
    if local is not None:
        return df.join(F.broadcast(local), list(on), how)
    plain = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(SALTS)).cast("int"))
    copies = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def attach_one(df: DataFrame, side: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row as literals."""
    row = side.first()
    return df.withColumns({
        f.name: F.lit(row[f.name]).cast(f.dataType) for f in side.schema.fields
    })
