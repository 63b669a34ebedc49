"""Filter interaction audit: path counting over the lattice of filter subsets.

Filters are applied one after the other, so the state of an audit is the subset of filters applied
so far. A document is alive in a state if it fails none of its filters, and an edge from state S
by filter f removes the documents alive in S that fail f. Every row is reduced to the subset of
filters it fails; counts per part and subset are all that the lattice needs.

Forward counts say how many orders reach a state, backward counts how many leave it. The removals
of a filter summed over all orders are its edges' removals, each times the forward count of its
start and the backward count of its end. The steps of one order are read from the same edges.

Filters: A under ``MIN_WORDS`` words; B fewer distinct words than half of all; C more than 2 % of
the code points are ASCII capitals; D holds a sign of ``SIGNS``; E has the text of a row of
a smaller id, table-wide.

Scale: one pass over the texts leaves a narrow row per document. Copies are found by a 128-bit
digest of the text: the least id per digest is a partial aggregate, and only digests of several
rows are joined back, hot ones over salts. The lattice works on at most 32 rows per part.

Defined cases: a null text is empty; empty texts are equal texts; two texts are equal if their
digests are; rows that share the least id of their text all pass E, and a row without an id passes
E and makes no other fail; of several labels of an id the largest counts; a null source is the
part "". Very long texts are read whole, one at a time. An empty table has no part and no row.
Further columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import join_counted, store, text_slices

LETTERS = "ABCDE"
MIN_WORDS = 200
SIGNS = b"#$%&*|"
CAPITALS = bytes(range(65, 91))
#: Bytes that continue a code point of UTF-8.
CONTINUATIONS = bytes(range(128, 192))
COPY = LETTERS.index("E")


def failed_alone(text: bytes) -> int:
    """The subset of A to D that a text fails, as bits."""
    words = text.split()
    points = len(text) - count_of(text, CONTINUATIONS)
    fails = (len(words) < MIN_WORDS, 2 * len(set(words)) < len(words), 50 * count_of(text, CAPITALS) > points,
             count_of(text, SIGNS) > 0)
    return sum(1 << i for i, bad in enumerate(fails) if bad)


def count_of(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def judged(docs: DataFrame) -> DataFrame:
    """(id, part, f1, f2, alone): a digest of the text and the filters a row fails by itself."""
    part = F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part")

    def scan(batches):
        for rows, texts in text_slices(batches, "text"):
            digests = np.array([np.frombuffer(xxhash.xxh3_128_digest(t), "<i8") for t in texts], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [rows.column("id"), rows.column("part"), pa.array(digests[:, 0]), pa.array(digests[:, 1]),
                 pa.array([failed_alone(t) for t in texts], pa.int32())], names=["id", "part", "f1", "f2", "alone"])

    return docs.select(F.col("doc_id").cast("long").alias("id"), part, "text").mapInArrow(
        scan, "id long, part string, f1 long, f2 long, alone int")


def failures(docs: DataFrame) -> DataFrame:
    """(id, part, mask) once per row of ``docs``: the filters it fails as bits."""
    rows = store(judged(docs), "audit-rows")
    known = rows.where("id IS NOT NULL")
    copies = known.groupBy("f1", "f2").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = F.when(F.col("id") > F.col("least"), 1 << COPY).otherwise(0)
    met = join_counted(rows, copies, ["f1", "f2"], "n", rows.count(), "left")
    return met.select("id", "part", F.col("alone").bitwiseOR(later).alias("mask"))


def counted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of a part that fail exactly the filters of mask."""
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), "quality", "toxic").where("id IS NOT NULL")
    marks = marks.groupBy("id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return failures(docs).join(marks, "id", "left").groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), count(F.col("quality") == 1).alias("good"), count(F.col("toxic") == 1).alias("toxic"))


def path_counts(filters: int) -> tuple[list[int], list[int]]:
    """For every state, the orders that reach it from the empty state, and those that leave it
    for the full one."""
    states = 1 << filters
    forward, backward = [0] * states, [0] * states
    forward[0] = backward[-1] = 1
    for state in range(1, states):
        forward[state] = sum(forward[state ^ (1 << f)] for f in range(filters) if state >> f & 1)
    for state in range(states - 2, -1, -1):
        backward[state] = sum(backward[state | 1 << f] for f in range(filters) if not state >> f & 1)
    return forward, backward


def edge_list(filters: int) -> list[tuple[int, int, int]]:
    """(state, filter, paths): every edge with the number of orders that go over it."""
    forward, backward = path_counts(filters)
    return [(s, f, forward[s] * backward[s | 1 << f]) for s in range(1 << filters) for f in range(filters) if not s >> f & 1]


def edges(counts: DataFrame, filters: int = len(LETTERS)) -> DataFrame:
    """Per part and edge (state, filter): what the step keeps, removes and would have removed."""
    steps = F.array(*[F.struct(F.lit(s).alias("state"), F.lit(f).alias("filter"), F.lit(p).alias("paths"))
                      for s, f, p in edge_list(filters)])
    rows = counts.select("*", F.explode(steps).alias("e")).select("part", "mask", "n", "good", "toxic", "e.*")
    bit = F.expr("shiftleft(1, `filter`)")
    fails, met = F.col("mask").bitwiseAND(bit) != 0, F.col("mask").bitwiseAND(F.col("state")) != 0
    total = lambda c, n="n": F.sum(F.when(c, F.col(n)).otherwise(0)).cast("long")
    return rows.groupBy("part", "state", "filter", "paths").agg(
        total(~fails & ~met).alias("kept"), total(fails & ~met).alias("removed"), total(fails & met).alias("redundant"),
        total(F.col("mask") == bit).alias("unique_fails"), total(fails & ~met, "good").alias("good_lost"),
        total(fails & ~met, "toxic").alias("toxic_lost"))


def order_steps(letters: str = LETTERS) -> list[tuple[str, int, int, int]]:
    """(order, step, state before it, filter) of all orders."""
    out = []
    for order in permutations(range(len(letters))):
        state = 0
        for step, f in enumerate(order, 1):
            out.append(("".join(letters[i] for i in order), step, state, f))
            state |= 1 << f
    return out


def shapley_sums(found: DataFrame) -> DataFrame:
    weighted: Column = F.sum(F.col("removed") * F.col("paths")).cast("long")
    return found.groupBy("part", "filter").agg(weighted.alias("shapley"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step."""
    found = store(edges(counted(docs, labels)), "audit-edges")
    steps = docs.sparkSession.createDataFrame(order_steps(), "filter_order string, step int, state int, filter int")
    return found.join(shapley_sums(found), ["part", "filter"]).join(F.broadcast(steps), ["state", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
