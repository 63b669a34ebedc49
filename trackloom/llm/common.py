"""Helpers the text operators share: durable tables, hot-key joins, native array folds."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.session import checkpoint_dir

#: A key above this share of all rows is hot, so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 1e-4
#: Rows of a narrow side (a few dozen bytes each) that may be broadcast after a count.
BROADCAST_ROWS = 200_000
#: ASCII white space that separates words and is stripped from lines (a fixed value).
SPACE = r"[ \t-\r]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Bytes of words kept as they are; ASCII capitals become small and all else a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Bytes of text handled at once inside a Python task.
SLICE_BYTES = 4 << 20
#: Bytes of an Arrow batch on its way to a Python task; a row is never cut.
ARROW_BYTES = 8 << 20
ARROW_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: later passes neither
    recompute it nor depend on the executors that made it. ``codec`` is the session's if not given."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def map_arrow(rows: DataFrame, scan: Callable, schema: str) -> DataFrame:
    """``rows.mapInArrow`` in batches of about ARROW_BYTES. Rows of text would else come by the
    default of 64 MB, of which the JVM and the Python task hold several copies. The session's
    setting is lowered where it is larger. A task ends by ``give_back``."""
    conf = rows.sparkSession.conf
    now = conf.get(ARROW_SETTING, "64m").strip().lower()
    units = {"b": 0, "k": 10, "m": 20, "g": 30, "t": 40}
    number = now.removesuffix("b") if now[-2:-1] in units else now
    size = int(number.rstrip("bkmgt")) << units.get(number[-1:], 0)
    if size <= 0 or size > ARROW_BYTES:
        conf.set(ARROW_SETTING, f"{ARROW_BYTES}b")

    def whole(batches):
        yield from scan(batches)
        give_back()

    return rows.mapInArrow(whole, schema)


def give_back() -> None:
    """Freed memory goes back to the machine. Python workers live on from stage to stage, and what one
    stage left in their heap would be added to what the next needs."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def word_list(text: bytes) -> list[bytes]:
    """Lower-case words of ASCII letters, digits and any character beyond ASCII."""
    return text.translate(WORD_BYTES).split()


def text_slices(batches: Iterator[pa.RecordBatch], column: str,
                size_limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Record batches cut to about ``size_limit`` bytes of text, with their texts as bytes (null: empty)."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start, held = 0, 0
        for i, size in enumerate(sizes):
            held += size
            if held >= size_limit or i + 1 == len(sizes):
                part = batch.slice(start, i + 1 - start)
                texts = part.column(column).cast(pa.large_binary()).to_pylist()
                yield part, [t or b"" for t in texts]
                start, held = i + 1, 0


def join_counted(rows: DataFrame, side: DataFrame, on: Sequence[str], count: str, total: int,
                 how: str = "inner") -> DataFrame:
    """Join ``rows`` to ``side``, one row per key with the key's number of ``rows`` in ``count``.

    A key of more than HOT_SHARE of the ``total`` rows is hot; at most 1 / HOT_SHARE keys can be.
    Its rows are dealt over salts by a hash of the whole row, as many as keep a salt below that
    share, and its side row is copied to each salt. Only the hot keys' salt numbers are broadcast,
    a bounded table at any size. Rows must differ in some column to be dealt apart. ``count`` is
    dropped; ``how`` is inner or left.
    """
    limit = max(1000, int(total * HOT_SHARE))
    keys = list(on)
    spread = F.when(F.col(count) > limit, F.ceil(F.col(count) / limit).cast("int"))
    heads = side.where(F.col(count) > limit).select(*keys, spread.alias("_salts"))
    salt = F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("_salts")).cast("int"), F.lit(0))
    salted = rows.join(F.broadcast(heads), keys, "left").withColumn("_salt", salt).drop("_salts")
    copies = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(spread, F.lit(1)) - 1)))
    return salted.join(copies.drop(count), [*keys, "_salt"], how).drop("_salt")


def running_sums(steps: Column, width: int = 128) -> Column:
    """Inclusive running sums of an int array. Folding whole arrays copies the sums so far at
    every step, so blocks of ``width`` are folded first: n * (width + n / width) copies."""
    pair = lambda total, sums: F.struct(total.alias("total"), sums.alias("sums"))
    none = F.array().cast("array<int>")

    def block(state: Column, at: Column) -> Column:
        inner = F.aggregate(
            F.slice(steps, at, F.lit(width)), pair(state["total"], none),
            lambda s, x: pair(s["total"] + x, F.concat(s["sums"], F.array(s["total"] + x))))
        return F.aggregate(F.array(inner), state, lambda s, i: pair(
            i["total"], F.concat(s["sums"], F.array(i["sums"]))))

    starts = F.sequence(F.lit(1), F.greatest(F.size(steps), F.lit(1)), F.lit(width))
    start = pair(F.lit(0), F.array().cast("array<array<int>>"))
    return F.flatten(F.aggregate(starts, start, block, lambda s: s["sums"]))


def empty_like(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
