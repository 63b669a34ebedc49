"""Reversible incremental line dedup: cuckoo filters by shard over exact reference counts.

A line's key is the line stripped of ASCII white space with A-Z in lower case; keys of at least
MIN_CHARS code points count. A key held by at least MIN_DOCS documents is heavy: its lines go,
except in the document of the largest id. ``LineIndex`` keeps

* ``refs``: one row per (key, document), appended by ``insert`` and cut by ``delete``;
* ``counts``: the exact number of documents and the largest id of each key;
* ``filters``: one cuckoo filter per shard of keys, holding the heavy keys. A key enters when its
  count reaches MIN_DOCS and leaves when a deletion takes it below, so decisions are reversible.

The filters spare the exact join most lines: only lines whose key may be heavy are shuffled.
They are sent to the tasks while all of them together stay under FILTER_BYTES; beyond, every
reference goes to the exact join, with the same result.

Defined cases: a null or empty text is one empty line; a null id is smaller than any other, and
if all holders have null ids none loses the line; repeated rows count as documents of their own,
and rows with the keeper's id all keep the line; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import SPACE_CHARS, join_counted, map_arrow, store, text_slices

MIN_CHARS = 40
MIN_DOCS = 5
#: Heavy keys for which one shard is made; a shard is one group in one task.
SHARD_KEYS = 400_000
FILTER_BYTES = 48 << 20
SLOTS, KICKS = 4, 400
STRIP = SPACE_CHARS.encode()
KEY = ["h1", "h2"]
FILTER_SCHEMA = "shard int, buckets long, slots binary, stash array<long>, full boolean"
#: Share of its slots up to which a shard takes keys; beyond, it is made anew from the exact counts.
MOST_LOAD = 0.85


def keyed_lines(text: bytes) -> Iterator[tuple[int, bytes]]:
    """(line number, 16-byte key) of the lines whose key is long enough."""
    for at, line in enumerate(text.split(b"\n")):
        if len(line) >= MIN_CHARS:
            key = line.strip(STRIP).lower()
            if len(key) >= MIN_CHARS and (len(key) >= 4 * MIN_CHARS or len(key.decode()) >= MIN_CHARS):
                yield at, xxhash.xxh3_128_digest(key)


def as_pairs(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), dtype="<i8").reshape(-1, 2)


class CuckooFilter:
    """Four 16-bit fingerprints a bucket, two buckets a key; keys that find no place are kept whole."""

    def __init__(self, buckets: int, slots: np.ndarray | None = None, stash: set[int] | None = None):
        self.buckets = buckets
        self.slots = np.zeros((buckets, SLOTS), np.uint16) if slots is None else slots
        self.stash = stash or set()

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        return cls(1 << max(4, int(2 * keys / SLOTS).bit_length()))

    def places(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = pairs.astype(np.uint64, copy=False)
        mark = (h[:, 1] & np.uint64(0xFFFF)).astype(np.int64)
        mark[mark == 0] = 1
        first = ((h[:, 0] >> np.uint64(20)) & np.uint64(self.buckets - 1)).astype(np.int64)
        return mark, first, first ^ self.turn(mark)

    def turn(self, mark):
        return (mark * 0x5BD1E995) & (self.buckets - 1)

    def insert(self, pairs: np.ndarray) -> None:
        for key, mark, one, two in zip(pairs[:, 0].tolist(), *(x.tolist() for x in self.places(pairs)), strict=True):
            if not (self._put(one, mark) or self._put(two, mark) or self._kick(two, mark)):
                self.stash.add(key)

    def _put(self, bucket: int, mark: int) -> bool:
        row = self.slots[bucket]
        for i in range(SLOTS):
            if row[i] == 0:
                row[i] = mark
                return True
        return False

    def _kick(self, bucket: int, mark: int) -> bool:
        trail = []
        for step in range(KICKS):
            slot = step % SLOTS
            trail.append((bucket, slot, int(self.slots[bucket, slot])))
            self.slots[bucket, slot], mark = mark, trail[-1][2]
            bucket ^= int(self.turn(mark))
            if self._put(bucket, mark):
                return True
        for bucket, slot, old in reversed(trail):
            self.slots[bucket, slot] = old
        return False

    def delete(self, pairs: np.ndarray) -> None:
        for key, mark, one, two in zip(pairs[:, 0].tolist(), *(x.tolist() for x in self.places(pairs)), strict=True):
            if key in self.stash:
                self.stash.remove(key)
                continue
            for bucket in (one, two):
                held = np.flatnonzero(self.slots[bucket] == mark)
                if len(held):
                    self.slots[bucket, held[0]] = 0
                    break

    def contains(self, pairs: np.ndarray) -> np.ndarray:
        mark, one, two = self.places(pairs)
        found = (self.slots[one] == mark[:, None]).any(1) | (self.slots[two] == mark[:, None]).any(1)
        return found | np.isin(pairs[:, 0], list(self.stash)) if self.stash else found

    def takes(self, keys: int) -> bool:
        """Whether so many more keys leave the load within MOST_LOAD, with none of them in the stash yet."""
        return not self.stash and np.count_nonzero(self.slots) + keys <= MOST_LOAD * self.slots.size

    def row(self, shard: int, full: bool = False) -> dict:
        return {"shard": shard, "buckets": self.buckets, "slots": self.slots.tobytes(), "stash": sorted(self.stash), "full": full}

    @classmethod
    def of(cls, row) -> CuckooFilter:
        slots = np.frombuffer(row["slots"], np.uint16).reshape(-1, SLOTS).copy()
        return cls(int(row["buckets"]), slots, {int(x) for x in row["stash"]})


def references(docs: DataFrame) -> DataFrame:
    """(h1, h2, doc_id) for every key of every document, once a document."""
    def scan(batches):
        for part, texts in text_slices(batches, "text"):
            keys, rows = [], []
            for at, text in enumerate(texts):
                own = {k for _, k in keyed_lines(text)}
                keys.extend(own)
                rows.extend([at] * len(own))
            pairs = as_pairs(keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), part.column("doc_id").take(pa.array(rows, pa.int64()))],
                names=[*KEY, "doc_id"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), scan, f"h1 long, h2 long, doc_id {kind}")


def summed(refs: DataFrame) -> DataFrame:
    return refs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))


def update_filters(filters: DataFrame, changes: DataFrame, shards: int) -> DataFrame:
    """Apply ``changes`` (h1, h2, enters) to the filters, shard by shard. A shard too full for its
    changes is returned as it was, marked ``full``."""
    def one(key, held: pd.DataFrame, change: pd.DataFrame) -> pd.DataFrame:
        table = CuckooFilter.of(held.iloc[0]) if len(held) else CuckooFilter.sized(max(len(change), SHARD_KEYS // 8))
        more = int(change.enters.sum()) if len(change) else 0
        if len(held) and more and not table.takes(more):
            return pd.DataFrame([table.row(int(key[0]), True)])
        for enters, act in ((False, table.delete), (True, table.insert)):
            part = change.loc[change.enters == enters, KEY].sort_values(KEY)
            if len(part):
                act(part.to_numpy(np.int64))
        return pd.DataFrame([table.row(int(key[0]))])

    sharded = changes.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))
    return filters.groupBy("shard").cogroup(sharded.groupBy("shard")).applyInPandas(one, FILTER_SCHEMA)


def built_filters(counts: DataFrame, shards: int, only: DataFrame | None = None) -> DataFrame:
    """The filters of all shards, or of those in ``only``, from the exact counts."""
    heavy = counts.where(F.col("n_docs") >= MIN_DOCS).select(*KEY, F.lit(True).alias("enters"))
    if only is not None:
        heavy = heavy.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int")).join(only, "shard", "left_semi").drop("shard")
    return update_filters(counts.sparkSession.createDataFrame([], FILTER_SCHEMA), heavy, shards)


@dataclass(frozen=True)
class LineIndex:
    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int

    @classmethod
    def build(cls, docs: DataFrame) -> LineIndex:
        refs = store(references(docs), "line-refs")
        counts = store(summed(refs), "line-counts")
        shards = 1 + counts.where(F.col("n_docs") >= MIN_DOCS).count() // SHARD_KEYS
        return cls(refs, counts, store(built_filters(counts, shards), "line-filters"), shards)

    def insert(self, docs: DataFrame) -> LineIndex:
        """Add documents; the tables of this index stay as they are."""
        new = store(references(docs), "line-refs")
        more = summed(new).select(*KEY, F.col("n_docs").alias("n_new"), F.col("keeper").alias("k_new"))
        both = self.counts.join(more, KEY, "full")
        old, add = F.coalesce("n_docs", F.lit(0)), F.coalesce("n_new", F.lit(0))
        counts = store(both.select(*KEY, (old + add).alias("n_docs"), F.greatest("keeper", "k_new").alias("keeper"),
                                   ((old < MIN_DOCS) & (old + add >= MIN_DOCS)).alias("enters")), "line-counts")
        refs, exact = self.refs.unionByName(new), counts.drop("enters")
        shards = 1 + exact.where(F.col("n_docs") >= MIN_DOCS).count() // SHARD_KEYS
        if shards > 2 * self.shards:  # more shards, all made anew
            return LineIndex(refs, exact, store(built_filters(exact, shards), "line-filters"), shards)
        filters = store(update_filters(self.filters, counts.where("enters").select(*KEY, "enters"), self.shards), "line-filters")
        full = filters.where("full").select("shard")
        if full.limit(1).count():
            anew = built_filters(exact, self.shards, full)
            filters = store(filters.where("NOT full").unionByName(anew), "line-filters")
        return LineIndex(refs, exact, filters, self.shards)

    def delete(self, ids: DataFrame) -> LineIndex:
        """Take out the documents whose ``doc_id`` is in ``ids``."""
        gone = ids.select("doc_id").distinct()
        refs = store(self.refs.join(gone, "doc_id", "left_anti"), "line-refs")
        touched = store(self.refs.join(gone, "doc_id", "left_semi").select(*KEY).distinct(), "line-touched")
        again = summed(refs.join(touched, KEY, "left_semi"))
        counts = store(self.counts.join(touched, KEY, "left_anti").unionByName(again), "line-counts")
        was = self.counts.join(touched, KEY, "left_semi").where(F.col("n_docs") >= MIN_DOCS).select(*KEY)
        leaves = was.join(counts.where(F.col("n_docs") >= MIN_DOCS), KEY, "left_anti")
        changes = leaves.withColumn("enters", F.lit(False))
        filters = store(update_filters(self.filters, changes, self.shards), "line-filters")
        return LineIndex(refs, counts, filters, self.shards)

    def dedup(self, docs: DataFrame) -> DataFrame:
        """``docs`` with the lines that go cut from ``text``, plus ``n_lines`` and ``n_dropped``."""
        spark = docs.sparkSession
        spot = [F.col("doc_id"), F.xxhash64("text").alias("hash")]
        size = self.filters.agg(F.sum(F.length("slots") + 8 * F.size("stash"))).first()[0] or 0
        kept = None
        if size <= FILTER_BYTES:
            kept = spark.sparkContext.broadcast([r.asDict() for r in self.filters.collect()])
        shards = self.shards

        def probe(batches):
            tables = None if kept is None else {r["shard"]: CuckooFilter.of(r) for r in kept.value}
            for part, texts in text_slices(batches, "text"):
                keys, rows, lines = [], [], []
                for at, text in enumerate(texts):
                    for line, key in keyed_lines(text):
                        keys.append(key)
                        rows.append(at)
                        lines.append(line)
                pairs, rows, lines = as_pairs(keys), np.array(rows, np.int64), np.array(lines, np.int32)
                if tables is not None:
                    may, shard = np.zeros(len(rows), bool), pairs[:, 0] % shards
                    for s, table in tables.items():
                        mine = np.flatnonzero(shard == s)
                        may[mine] = table.contains(pairs[mine])
                    pairs, rows, lines = pairs[may], rows[may], lines[may]
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(at), part.column("hash").take(at), pa.array(lines),
                     pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["doc_id", "hash", "line", *KEY])

        kind = docs.schema["doc_id"].dataType.simpleString()
        probes = map_arrow(docs.select(*spot, "text"), probe, f"doc_id {kind}, hash long, line int, h1 long, h2 long")
        heavy = self.counts.where(F.col("n_docs") >= MIN_DOCS)
        total = heavy.agg(F.sum("n_docs")).first()[0] or 0
        hits = join_counted(probes, heavy, KEY, "n_docs", total).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        drops = hits.groupBy("doc_id", "hash").agg(F.collect_set("line").alias("drops"))
        others = [c for c in docs.columns if c != "text"]
        rows = docs.select(*spot, F.col("text"), F.struct(*others).alias("doc")).alias("d")
        same = F.expr("d.hash = x.hash AND d.doc_id <=> x.doc_id")
        rows = rows.join(drops.alias("x"), same, "left").select("d.doc", "d.text", "x.drops")

        def cut(batches):
            for part, texts in text_slices(batches, "text"):
                out, total, gone = [], [], []
                for text, drop in zip(texts, part.column("drops").to_pylist(), strict=True):
                    total.append(text.count(b"\n") + 1)
                    gone.append(len(drop or ()))
                    if drop:
                        drop = set(drop)
                        text = b"\n".join(x for i, x in enumerate(text.split(b"\n")) if i not in drop)
                    out.append(text)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), pa.array(out, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()),
                     pa.array(gone, pa.int64())], names=["doc", "text", "n_lines", "n_dropped"])

        doc = rows.schema["doc"].dataType.simpleString()
        done = map_arrow(rows, cut, f"doc {doc}, text string, n_lines long, n_dropped long")
        columns = [F.col("text") if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns
                   if c not in ("n_lines", "n_dropped")]
        return done.select(*columns, "n_lines", "n_dropped")


def report(docs: DataFrame) -> DataFrame:
    """Per document: lines, dropped lines and the digest of the kept text."""
    docs = docs.select("doc_id", "text")
    return LineIndex.build(docs).dedup(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def clean(docs: DataFrame) -> DataFrame:
    """``docs``, same columns, without the lines that go; ``n_chars`` follows the text."""
    done = LineIndex.build(docs).dedup(docs)
    new = {"n_chars": F.length("text").cast("long").alias("n_chars")}
    return done.select(*[new.get(c, F.col(f"`{c}`")) for c in docs.columns])
