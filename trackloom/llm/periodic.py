"""Periodic runs of words by a dictionary of basic factors.

A run of period q is a stretch of words, each equal to the one q before it, of at least 2 q words
and ``least`` words in all, that no neighbour extends; q is its smallest period. Every text is
taken whole.

The dictionary names the factors of 1, 2, 4, 8, ... words by pairs of names of half the length, so
equal factors have equal names. A run of period q repeats a factor of the power of two L with
L <= q < 2 L at distance q. The later occurrences of a factor within 2 L words form a few
arithmetic progressions: chains of equal steps from one occurrence to the next. The distances to
the ends of each progression are the proposed periods. A proposal grows in both directions by
comparing names of falling lengths, and equal stretches keep their smallest period.

A slice of texts is one sequence of word numbers, texts set apart by numbers of their own, so all
steps are array operations. A factor found once in a slice keeps a name of its own and is not looked
at again, so long levels cost as much as the slice repeats itself; a text alone needs about
100 bytes for each of its words. No shuffle.

Defined cases: null and empty texts have no word and no run; a null id plants no repetition; equal
rows give equal results; ties between longest runs go to the smaller start, then the smaller
period; other columns pass through ``detect`` and ``collapse``, those named like an output are
replaced.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import text_slices

LEAST = 12
RUN = "struct<start:long,length:long,period:long>"


class Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        return at


def basic_factors(symbols: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Names of the factors of 1, 2, 4, ... symbols at every place, as long as any factor repeats,
    and the places of repeated factors. All other places have names that no second place has."""
    n = len(symbols)
    levels, repeats, size = [], [], 1
    places, names = np.arange(n, dtype=np.int64), symbols.astype(np.int64)
    while len(places):
        _, name, count = np.unique(names, return_inverse=True, return_counts=True)
        again = count[name] > 1
        places, name = places[again], name[again]
        if not len(places):
            break
        level = np.arange(n, 2 * n, dtype=np.int32)
        level[places] = name
        levels.append(level)
        repeats.append(places)
        # a factor of twice the length can only repeat where both halves do
        places = places[places + size < n]
        places = places[level[places + size] < n]
        names = level[places].astype(np.int64) * n + level[places + size]
        size *= 2
    return levels, repeats


def proposals(levels: list[np.ndarray], repeats: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) pairs: two ends of progressions of occurrences of one factor."""
    found = [np.zeros((0, 2), np.int64)]
    for k, (level, places) in enumerate(zip(levels, repeats, strict=True)):
        size, m = 1 << k, len(places)
        at = places[np.argsort(level[places], kind="stable")]
        gap = np.zeros(m, np.int64)  # to the next occurrence; 0 behind the last
        gap[:-1] = np.where(level[at[1:]] == level[at[:-1]], at[1:] - at[:-1], 0)
        # where the chain of equal steps that begins here ends
        alike = np.append((gap[1:] == gap[:-1]) & (gap[1:] > 0), False)
        stops = np.flatnonzero(~alike)
        last = stops[np.searchsorted(stops, np.arange(m))] + (gap > 0)
        start = now = np.flatnonzero((gap > 0) & (gap < 2 * size))
        while len(start):
            for target in (now + 1, last[now]):
                step = at[target] - at[start]
                fits = (step >= size) & (step < 2 * size)
                found.append(np.stack([step, at[start]], 1)[fits])
            now = last[now]
            alive = (gap[now] > 0) & (at[now] - at[start] < 2 * size)
            start, now = start[alive], now[alive]
    rows = np.unique(np.concatenate(found), axis=0)
    # a place just behind another of the same period leads to the same run
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1] + 1)
    return rows[fresh, 1], rows[fresh, 0]


def extended(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, back: bool) -> np.ndarray:
    """How many symbols from i and j on (or before them, if ``back``) are equal; i < j. No equal
    stretch is twice as long as the longest factor named."""
    n, out = len(levels[0]), np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        size = 1 << k
        a, b = (i - out - size, j - out - size) if back else (i + out, j + out)
        fits = np.flatnonzero((a >= 0) & (b < n))
        fits = fits[levels[k][a[fits]] == levels[k][b[fits]]]
        out[fits] += size
    return out


def find_runs(symbols: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(start, length, period) of all runs, by start, then period."""
    none = np.zeros((0, 3), np.int64)
    levels, repeats = basic_factors(symbols)
    if not levels:
        return none
    place, period = proposals(levels, repeats)
    right = extended(levels, place, place + period, False)
    left = extended(levels, place, place + period, True)
    start, length = place - left, left + right + period
    long = length >= np.maximum(least, 2 * period)
    rows = np.stack([start, length, period], 1)[long]
    if not len(rows):
        return none
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    rows = rows[fresh]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def dropped(runs: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in a run behind its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change)[:n] > 0


def slice_runs(texts: list[list[bytes]], least: int) -> list[np.ndarray]:
    """The runs of each list of words."""
    numbers = Numbers()
    sizes = np.array([len(w) + 1 for w in texts], np.int64)
    flat = np.zeros(int(sizes.sum()), np.int64)
    ends = np.cumsum(sizes)
    for words, begin in zip(texts, (ends - sizes).tolist(), strict=True):
        flat[begin:begin + len(words)] = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    flat[ends - 1] = len(numbers) + np.arange(len(texts))  # no run crosses a border
    rows = find_runs(flat, least)
    owner = np.searchsorted(ends, rows[:, 0], side="right")
    rows[:, 0] -= (ends - sizes)[owner]
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [rows[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def _mapped(docs: DataFrame, outputs: dict[str, str], make: Callable, least: int) -> DataFrame:
    """``docs`` plus ``outputs``; ``make`` gives their values for a row from its words and runs."""
    others = [c for c in docs.columns if c not in outputs and c != "text"]
    rows = docs.select("text", F.struct(F.lit(0).alias("_"), *others).alias("doc"))
    kinds = rows.limit(0).select(*[F.lit(None).cast(t).alias(c) for c, t in outputs.items()]).schema

    def scan(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(kinds)
        for part, texts in text_slices(batches, "text"):
            words = [t.split() for t in texts]
            values = [make(w, r) for w, r in zip(words, slice_runs(words, least), strict=True)]
            columns = [pa.array([v[i] for v in values], f.type) for i, f in enumerate(schema)]
            yield pa.RecordBatch.from_arrays([part.column("text"), part.column("doc"), *columns], names=["text", "doc", *outputs])

    types = ", ".join(f"`{c}` {t}" for c, t in outputs.items())
    done = rows.mapInArrow(scan, f"text string, doc {rows.schema['doc'].dataType.simpleString()}, {types}")
    kept = [F.col("text") if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns if c not in outputs]
    return done.select(*kept, *outputs)


def _structs(runs: np.ndarray) -> list[dict]:
    return [{"start": s, "length": n, "period": p} for s, n, p in runs.tolist()]


def detect(docs: DataFrame, least: int = LEAST, output: str = "runs") -> DataFrame:
    """``docs`` plus ``output``, the runs of each text by start, then period (places in words)."""
    return _mapped(docs, {output: f"array<{RUN}>"}, lambda words, runs: (_structs(runs),), least)


def collapse(docs: DataFrame, least: int = LEAST, output: str = "collapsed") -> DataFrame:
    """``docs`` plus ``output``: the words that no run repeats, joined by one space."""
    def make(words, runs):
        gone = dropped(runs, len(words)).tolist()
        return (b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode(),)

    return _mapped(docs, {output: "string"}, make, least)


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """One document in ten is made periodic from some word on, as the query's contract says."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def report(docs: DataFrame) -> DataFrame:
    """Per document of the planted table: its runs, the longest one, and digests."""
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def scan(batches):
        for part, texts in text_slices(batches, "text"):
            ids = part.column("doc_id").to_pylist()
            words = [planted(t.split(), i) for t, i in zip(texts, ids, strict=True)]
            out = []
            for i, w, runs in zip(ids, words, slice_runs(words, LEAST), strict=True):
                top = (None,) * 4
                if len(runs):
                    start, length, period = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist()
                    top = (start, length, period, 1000 * length // period)
                    gone = dropped(runs, len(w)).tolist()
                    w = [x for x, g in zip(w, gone, strict=True) if not g]
                lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs.tolist())
                out.append((i, len(runs), *top, sha(lines.encode()), sha(b" ".join(w)), _structs(runs)))
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs"]
    types = ["long"] * 6 + ["string"] * 2 + [f"array<{RUN}>"]
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        scan, ", ".join(f"{c} {t}" for c, t in zip(names, types, strict=True)))
