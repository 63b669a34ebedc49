"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned, verified, removed.

Words are those of ``word_list``. Every WINDOW consecutive words of a benchmark item are a
window; an item of fewer words is one window. A document word inside an occurrence of a window
is hit.

The items are cut into blocks of at most BLOCK_BYTES of text, by a hash of the item. Each block's
windows are broadcast in turn and the documents scanned once per block, so the broadcast never
exceeds its bound; an ordinary benchmark is one block. Rolling hashes propose windows and the
words themselves confirm them.

Defined cases: a null or empty text has no words and no hits; items without words are ignored,
a null item id reads as an empty string, equal ids count once; repeated documents are scanned
each; other columns pass through, save those named like an output.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import map_arrow, store, text_slices, word_list

WINDOW = 10
BLOCK_BYTES, PIECE_WORDS = 16 << 20, 50_000
BASE = np.uint64(0x9E3779B97F4A7C15)
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
FOUND = "doc_id {id}, text string, doc {doc}, n_words long, spans array<struct<start:int,end:int>>, items array<string>"


class Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


class Windows:
    """The windows of one block of items, by length: sorted hashes beside the places of the
    windows in one row of word numbers, some 20 bytes a word."""

    def __init__(self, items: list[tuple[str, bytes]]):
        self.words, self.names = Vocabulary(), [name for name, _ in items]
        lists = [np.array([self.words.setdefault(w, len(self.words)) for w in word_list(text)], np.int32) for _, text in items]
        self.ids = np.concatenate([*lists, np.zeros(WINDOW, np.int32)])
        self.ends = np.cumsum([len(x) for x in lists])
        sizes = np.array([min(WINDOW, len(x)) for x in lists])
        self.by_size = {}
        for size in np.unique(sizes[sizes > 0]).tolist():
            at = np.concatenate([np.arange(self.ends[i] - len(lists[i]), self.ends[i] - size + 1) for i in np.flatnonzero(sizes == size).tolist()])
            hashes = self.rolled(self.ids, at, size)
            order = np.argsort(hashes, kind="stable")
            self.by_size[size] = (hashes[order], at[order].astype(np.int32))

    @staticmethod
    def rolled(ids: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        total = np.zeros(len(at), np.uint64)
        for j in range(size):
            total = total * BASE + ids[at + j].astype(np.uint64) + np.uint64(1)
        return total ^ (total >> np.uint64(32))

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        ids = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        unknown = np.concatenate([[0], np.cumsum(ids < 0)])
        spans, owners = [], []
        for size, (hashes, places) in self.by_size.items():
            if len(ids) < size:
                continue
            at = np.flatnonzero(unknown[size:] == unknown[:-size])
            if not len(at):
                continue
            hashed = self.rolled(ids, at, size)
            low, high = np.searchsorted(hashes, hashed), np.searchsorted(hashes, hashed, side="right")
            for i, a, b in zip(*(x[high > low].tolist() for x in (at, low, high)), strict=True):
                same = np.ones(b - a, bool)
                for j in range(size):
                    same &= self.ids[places[a:b] + j] == ids[i + j]
                if same.any():
                    spans.append((i, i + size))
                    owners.append(places[a:b][same])
        found = np.unique(np.searchsorted(self.ends, np.concatenate(owners), side="right")) if owners else ()
        return spans, {self.names[i] for i in found}


def pieces_of(items: DataFrame) -> DataFrame:
    """(item_id, text) once each, items of more than PIECE_WORDS words in pieces that overlap by all
    but one word of a window, so that every window is in one."""
    rows = items.where(F.length("text") > 0).select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")

    def cut(batches):
        for part, texts in text_slices(batches, "text"):
            rows, out = [], []
            for at, text in enumerate(texts):
                words = word_list(text)
                for low in range(0, max(1, len(words) - WINDOW + 1), PIECE_WORDS):
                    rows.append(at)
                    out.append(b" ".join(words[low:low + PIECE_WORDS + WINDOW - 1]))
            yield pa.RecordBatch.from_arrays(
                [part.column("item_id").take(pa.array(rows, pa.int64())), pa.array(out, pa.binary()).cast(pa.string())], names=["item_id", "text"])

    return map_arrow(rows.distinct(), cut, "item_id string, text string").where(F.length("text") > 0).distinct()


def blocks_of(pieces: DataFrame) -> tuple[DataFrame, int]:
    """(``pieces`` with their block, number of blocks): as many blocks as keep each within BLOCK_BYTES."""
    size = pieces.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    number = 1 + 2 * size // BLOCK_BYTES
    while True:
        rows = pieces.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(number)))
        largest = rows.groupBy("block").agg(F.sum(F.octet_length("text")).alias("n"), F.count(F.lit(1)).alias("rows")).agg(F.max("n"), F.max("rows")).first()
        if (largest[0] or 0) <= BLOCK_BYTES or largest[1] == 1:
            return rows, number
        number *= 2


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def find(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text, doc, n_words, spans, items): hit word spans and the items hit; ``doc`` holds the
    other columns."""
    spark = docs.sparkSession
    pieces, blocks = blocks_of(store(pieces_of(items), "decontam-items"))
    kind, others = docs.schema["doc_id"].dataType.simpleString(), [c for c in docs.columns if c not in ("doc_id", "text")]
    doc = F.struct(*others) if others else F.struct(F.lit(0).alias("none"))
    rows = docs.select("doc_id", "text", doc.alias("doc"), F.lit(0).cast("long").alias("n_words"),
                       F.array().cast("array<struct<start:int,end:int>>").alias("spans"),
                       F.array().cast("array<string>").alias("items"))
    shape = FOUND.format(id=kind, doc=rows.schema["doc"].dataType.simpleString())
    for block in range(blocks):
        mine = pieces.where(F.col("block") == block).select("item_id", "text").collect()
        sent = spark.sparkContext.broadcast(sorted((r[0], r[1].encode()) for r in mine))

        def scan(batches, sent=sent):
            windows = Windows(sent.value)
            for part, texts in text_slices(batches, "text"):
                before = zip(part.column("spans").to_pylist(), part.column("items").to_pylist(), strict=True)
                numbers, spans, names = [], [], []
                for text, (old, held) in zip(texts, before, strict=True):
                    words = word_list(text)
                    found, owners = windows.scan(words)
                    numbers.append(len(words))
                    spans.append([{"start": a, "end": b} for a, b in merged(
                        found + [(s["start"], s["end"]) for s in old])])
                    names.append(sorted(owners | set(held)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text"), part.column("doc"), pa.array(numbers, pa.int64()),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                     pa.array(names, pa.list_(pa.string()))],
                    names=["doc_id", "text", "doc", "n_words", "spans", "items"])

        rows = map_arrow(rows, scan, shape)
        if block + 1 < blocks:
            rows = store(rows, "decontam")
    return rows


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document: words, hit words, items hit and their digest."""
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return find(docs.select("doc_id", "text"), items).select(
        "doc_id", "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"), (hits > 0).alias("contaminated"))


def remove_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a window."""
    kept = find(docs, items).where(F.size("spans") == 0)
    return kept.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"doc.`{c}`") for c in docs.columns])


def remove_spans(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` with the hit words, and the signs between them, cut from their texts."""
    found = find(docs, items)

    def cut(batches):
        for part, texts in text_slices(batches, "text"):
            out = []
            for text, spans in zip(texts, part.column("spans").to_pylist(), strict=True):
                if spans:
                    at = [m.span() for m in WORD.finditer(text)]
                    left, kept = 0, []
                    for s in spans:
                        kept.append(text[left:at[s["start"]][0]])
                        left = at[s["end"] - 1][1]
                    text = b"".join([*kept, text[left:]])
                out.append(text)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(out, pa.binary()).cast(pa.string()), part.column("doc")],
                names=["doc_id", "text", "doc"])

    kinds = [f"{c} {found.schema[c].dataType.simpleString()}" for c in ("doc_id", "text", "doc")]
    done = map_arrow(found, cut, ", ".join(kinds))
    new = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long").alias("n_chars")}
    return done.select(*[new.get(c, F.col(f"doc.`{c}`")) for c in docs.columns])


def items_digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(set(names))).encode()).hexdigest()
