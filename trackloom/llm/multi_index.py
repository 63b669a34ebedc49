"""Approximate nearest neighbours by an inverted multi-index, largest inner product first.

Vectors are cut into two halves, each quantised to one of K centroids of its own, so a vector lies
in one of K x K cells. A query sorts the centroids of each half by distance, minus the inner
product, and visits cells by the summed distance with a heap: the pair popped offers its two
neighbours in the sorted lists. It stops when the cells visited hold as many vectors as ``needed``
asks for. Entries are ranked by their exact inner products, all those of a region that holds a
visited cell: the further ones cost less than leaving them out.

Fit. Centroids come from k-means on at most SAMPLE_ROWS vectors, those of the least hashes, in one
task. How many vectors a query must visit is measured: for PROBES queries the exact neighbours are
found among all vectors, and the visits that reach the share RECALL of all of them are asked of
every query. So the recall holds at any size; on vectors without any structure that is a large
part of the table. Everything else covers all rows.

Scale. Equal vectors are one entry with its least ids, as many as a result can use, chosen by a
window with a limit before the shuffle; queries with equal vectors are searched once. Neighbouring
cells are joined to regions of about REGION_ROWS entries, larger cells are cut. A query is sent to
a region once, however many of its cells it visits. A region's entries stream into a task ahead
of its queries, which follow in batches; regions of many queries are copied once per QUERY_ROWS
of them. A task holds one region and one batch, and writes the best of a region for each query.
No pair of query and entry is ever a row beyond those. The codebooks and the cells' sizes and
regions (at most MOST_CENTROIDS squared) are broadcast.

Scores are sums of double products in the order of the components. Entries within 1e-9 of the last
place of a region are scored that way before the cut, so ties go to the smaller id.

Defined cases: rows without an id, and vectors that are null, empty, zero or hold null or
non-finite components take no part; nor do vectors of another length than the most frequent one
(the smaller of equally frequent). Of several rows of one id the least vector counts. Fewer
candidates than asked for are all returned, if the visit reached them; an empty table gives no
row. Further columns are ignored; there are no texts.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.llm.common import join_counted, store

NEIGHBOURS = 20
SAMPLE_ROWS, STEPS = 20_000, 12
#: Vectors a cell holds on average, and most centroids of a half.
CELL_ROWS, MOST_CENTROIDS = 64, 1024
REGION_ROWS, QUERY_ROWS = 8192, 100_000
PROBES, RECALL = 100, 0.96
#: Queries multiplied with a region at once.
CHUNK = 512


# ---- rows ----

def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != math.inf))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def vectors_of(table: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, h1, h2, vector): one usable vector per id, all of one length, with a 128-bit hash."""
    kind = "array<float>" if table.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    rows = table.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast(kind).alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vector")))
    rows = store(rows.groupBy("id").agg(F.min("vector").alias("vector")), "ann-rows")
    lengths = rows.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), "length").limit(1).collect()
    length = lengths[0]["length"] if lengths else 0
    return rows.where(F.size("vector") == length).select(
        "id", F.xxhash64(F.lit(1), "vector").alias("h1"), F.xxhash64(F.lit(2), "vector").alias("h2"), "vector")


def entries_of(rows: DataFrame, k: int) -> DataFrame:
    """(h1, h2, ids, vector) once per different vector, with its k + 1 least ids."""
    least = rows.withColumn("place", F.row_number().over(W.partitionBy("h1", "h2").orderBy("id"))).where(F.col("place") <= k + 1)
    return least.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("vector").alias("vector"))


def kind_of(rows: DataFrame) -> str:
    return rows.schema["vector"].dataType.simpleString()


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


# ---- codebooks ----

def k_means(points: np.ndarray, k: int, steps: int = STEPS) -> np.ndarray:
    """Centroids by Lloyd's steps from rows spread over the order of the first component."""
    if not points.shape[1]:  # vectors of one component have nothing in their first half
        return points[:1]
    order = np.lexsort(points.T[::-1])
    centres = points[order[np.linspace(0, len(points) - 1, k).astype(int)]]
    for _ in range(steps):
        near = nearest(points, centres)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    weight = (centres ** 2).sum(1)
    return np.concatenate([np.zeros(0, np.int64)] + [
        (weight - 2 * points[i:i + 4096] @ centres.T).argmin(1) for i in range(0, len(points), 4096)])


def fit(entries: DataFrame, total: int) -> list[np.ndarray]:
    """The two codebooks, from a bounded sample in one task."""
    size = min(MOST_CENTROIDS, max(1, math.isqrt(max(0, total - 1) // CELL_ROWS) + 1))
    sample = entries.orderBy("h1", "h2").limit(SAMPLE_ROWS).select("vector")

    def one(group: pd.DataFrame) -> pd.DataFrame:
        points = np.array(group["vector"].tolist(), np.float64)
        half = points.shape[1] // 2
        books = [k_means(part, min(size, len(points))) for part in (points[:, :half], points[:, half:])]
        return pd.DataFrame({"half": [h for h, b in enumerate(books) for _ in b], "at": [i for b in books for i in range(len(b))],
                             "centre": [c.tolist() for b in books for c in b]})

    found = sample.groupBy().applyInPandas(one, "half int, at int, centre array<double>").collect()
    found.sort(key=lambda r: (r["half"], r["at"]))
    return [np.array([r["centre"] for r in found if r["half"] == h], np.float64) for h in (0, 1)]


def assigned(entries: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``entries`` plus their cell."""
    sent = entries.sparkSession.sparkContext.broadcast(books)

    def scan(batches):
        first, second = sent.value
        half = first.shape[1]
        for part in batches:
            points = matrix(part.column("vector"))
            cell = np.zeros(0, np.int64)
            if len(points):
                cell = nearest(points[:, :half], first) * len(second) + nearest(points[:, half:], second)
            yield part.append_column("cell", pa.array(cell.astype(np.int32)))

    return entries.mapInArrow(scan, f"h1 long, h2 long, ids array<long>, vector {kind_of(entries)}, cell int")


# ---- visits ----

def visit(query: np.ndarray, books: list[np.ndarray], sizes: np.ndarray, needed: int) -> list[int]:
    """Cells by summed distance until they hold ``needed`` entries or none is left."""
    half = books[0].shape[1]
    far = [-(books[0] @ query[:half]), -(books[1] @ query[half:])]
    order = [np.argsort(f, kind="stable") for f in far]
    (a, b), (n, m) = (f[o] for f, o in zip(far, order, strict=True)), map(len, far)
    heap, seen, cells = [(a[0] + b[0], 0, 0)], {(0, 0)}, []
    while heap and needed > 0:
        _, i, j = heapq.heappop(heap)
        cell = int(order[0][i]) * m + int(order[1][j])
        if sizes[cell]:
            cells.append(cell)
            needed -= int(sizes[cell])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < n and y < m and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (a[x] + b[y], x, y))
    return cells


def exact(entries: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """(query, score, id, cell): the k + 1 nearest entries of a bounded set of queries, by a scan."""
    points = np.array([v for _, v in queries], np.float64)
    sent = entries.sparkSession.sparkContext.broadcast(([i for i, _ in queries], points))

    def scan(batches):
        names, points = sent.value
        for part in batches:
            if not part.num_rows:
                continue
            scores = points @ matrix(part.column("vector")).T
            ids, cells = part.column("ids").to_pylist(), part.column("cell").to_pylist()
            top = np.argsort(-scores, axis=1, kind="stable")[:, :k + 1]
            out = [(names[q], float(scores[q, i]), ids[i][0], cells[i]) for q in range(len(names)) for i in top[q].tolist()]
            types = (pa.int64(), pa.float64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["query", "score", "id", "cell"])

    best = W.partitionBy("query").orderBy(F.desc("score"), "id")
    rows = entries.select("ids", "cell", "vector").mapInArrow(scan, "query long, score double, id long, cell int")
    return rows.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).drop("place")


def visits_needed(entries: DataFrame, queries: DataFrame, books: list[np.ndarray], sizes: np.ndarray, k: int) -> int:
    """How many entries queries must visit to meet the share RECALL of their exact neighbours."""
    asked = [(r["id"], r["vector"]) for r in queries.orderBy(F.xxhash64("id"), "id").limit(PROBES).select("id", "vector").collect()]
    if not asked:
        return 0
    cells: dict[int, list[int]] = {i: [] for i, _ in asked}
    for r in exact(entries, asked, k).collect():
        if r["id"] != r["query"]:
            cells[r["query"]].append(r["cell"])
    costs = []
    for i, vector in asked:
        way = visit(np.array(vector), books, sizes, int(sizes.sum()))
        cost = dict(zip(way, np.cumsum(sizes[way]).tolist(), strict=True))
        costs.extend(cost[c] for c in cells[i])
    costs.sort()
    return costs[min(len(costs) - 1, math.ceil(RECALL * len(costs)))] if costs else int(sizes.sum())


def regions_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every cell the number of its first region and into how many it is cut."""
    first, parts = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    now, filled = 0, 0
    for cell, size in enumerate(sizes.tolist()):
        if filled and filled + size > REGION_ROWS:
            now, filled = now + 1, 0
        first[cell], parts[cell] = now, max(1, -(-size // REGION_ROWS))
        now, filled = now + int(parts[cell]) - 1, size if parts[cell] == 1 else REGION_ROWS
    return first, parts


def probes(queries: DataFrame, books: list[np.ndarray], sizes: np.ndarray, needed: int) -> DataFrame:
    """(h1, h2, region, vector): each query vector once per region that holds a cell it visits."""
    first, parts = regions_of(sizes)
    sent = queries.sparkSession.sparkContext.broadcast((books, sizes, first, parts))

    def scan(batches):
        books, sizes, first, parts = sent.value
        for part in batches:
            points = matrix(part.column("vector"))
            for low in range(0, len(points), CHUNK):
                ways = []
                for point in points[low:low + CHUNK]:
                    cells = np.array(visit(point, books, sizes, needed), np.int64)
                    spread = np.repeat(first[cells], parts[cells])
                    turn = np.arange(len(spread)) - np.repeat(np.cumsum(parts[cells]) - parts[cells], parts[cells])
                    ways.append(np.unique(spread + turn))
                at = pa.array(np.repeat(np.arange(len(ways)) + low, [len(w) for w in ways]))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c).take(at) for c in ("h1", "h2")], pa.array(np.concatenate(ways)), part.column("vector").take(at)],
                    names=["h1", "h2", "region", "vector"])

    return queries.select("h1", "h2", "vector").mapInArrow(scan, f"h1 long, h2 long, region long, vector {kind_of(queries)}")


def placed(entries: DataFrame, sizes: np.ndarray) -> DataFrame:
    """``entries`` with their region."""
    first, parts = regions_of(sizes)
    sent = entries.sparkSession.sparkContext.broadcast((first, parts))

    def scan(batches):
        first, parts = sent.value
        for part in batches:
            cell = part.column("cell").to_numpy()
            own = part.column("h1").to_numpy().astype(np.uint64) % parts[cell].astype(np.uint64)
            yield part.drop_columns(["cell"]).append_column("region", pa.array(first[cell] + own.astype(np.int64)))

    return entries.mapInArrow(scan, f"h1 long, h2 long, ids array<long>, vector {kind_of(entries)}, region long")


# ---- ranking ----

def ordered_scores(query: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Inner products summed in the order of the components."""
    total = np.zeros(len(points))
    for c in range(points.shape[1]):
        total += points[:, c] * query[c]
    return total


def best_of(queries: np.ndarray, points: np.ndarray, ids: list[list[int]], k: int) -> list[list[tuple[float, int]]]:
    """The k + 1 best (score, id) of one region for each query."""
    scores = queries @ points.T
    keep = min(k + 1, len(points))
    last = np.partition(scores, len(points) - keep, axis=1)[:, len(points) - keep]
    slack = 1e-9 * np.sqrt((queries ** 2).sum(1)) * np.sqrt((points ** 2).sum(1).max())
    out = []
    for q, query in enumerate(queries):
        near = np.flatnonzero(scores[q] >= last[q] - slack[q])
        pairs = [(s, i) for s, e in zip(ordered_scores(query, points[near]).tolist(), near.tolist(), strict=True) for i in ids[e]]
        pairs.sort(key=lambda p: (-p[0], p[1]))
        out.append(pairs[:k + 1])
    return out


def ranked(entries: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(h1, h2, score, id): the best of every region a query visits."""
    load = asked.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("copies"))
    copies = entries.join(load, "region").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    mine = F.pmod(F.col("h1"), F.col("copies")).cast("int")
    none = F.lit(None).cast("array<long>")
    streams = copies.select("region", "copy", F.lit(0).alias("kind"), "h1", "h2", "ids", "vector").unionByName(
        asked.join(load, "region").select("region", mine.alias("copy"), F.lit(1).alias("kind"), "h1", "h2", none.alias("ids"), "vector"))
    streams = streams.repartition("region", "copy").sortWithinPartitions("region", "copy", "kind")

    def scan(batches):
        task, held, points, ids = None, [], None, []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("region", "copy", "kind")], 1)
            cuts = np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                if low == high:
                    continue
                region, copy, kind = keys[low].tolist()
                part = batch.slice(low, high - low)
                if (region, copy) != task:
                    task, held, points, ids = (region, copy), [], None, []
                if kind == 0:
                    held.append(matrix(part.column("vector")))
                    ids.extend(part.column("ids").to_pylist())
                    continue
                if points is None:
                    points, held = np.concatenate(held), []
                asked = matrix(part.column("vector"))
                for at in range(0, len(asked), CHUNK):
                    found = best_of(asked[at:at + CHUNK], points, ids, k)
                    rows = pa.array(np.repeat(np.arange(len(found)) + at, [len(f) for f in found]))
                    flat = [p for f in found for p in f]
                    yield pa.RecordBatch.from_arrays(
                        [*[part.column(c).take(rows) for c in ("h1", "h2")], pa.array([s for s, _ in flat], pa.float64()),
                         pa.array([i for _, i in flat], pa.int64())], names=["h1", "h2", "score", "id"])

    return streams.mapInArrow(scan, "h1 long, h2 long, score double, id long")


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def search(table: DataFrame, asks: Column, k: int = NEIGHBOURS, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row of which ``asks``, a
    condition on ``id``, holds, among all other rows."""
    rows = vectors_of(table, id_column, vector)
    entries = store(entries_of(rows, k), "ann-entries")
    total = entries.count()
    queries = store(rows.where(asks), "ann-queries")
    if not total or not queries.limit(1).count():
        return empty(table.sparkSession)
    books = fit(entries, total)
    entries = store(assigned(entries, books), "ann-cells")
    sizes = np.zeros(len(books[0]) * len(books[1]), np.int64)
    for r in entries.groupBy("cell").count().collect():
        sizes[r["cell"]] = r["count"]
    needed = visits_needed(entries, queries, books, sizes, k)
    different = queries.groupBy("h1", "h2").agg(F.first("vector").alias("vector"), F.count(F.lit(1)).alias("n"))
    asked = store(probes(different, books, sizes, needed), "ann-probes")
    order = W.partitionBy("h1", "h2").orderBy(F.desc("score"), "id")
    best = ranked(placed(entries, sizes), asked, k).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    found = best.groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("found"))
    found = store(found.join(different.select("h1", "h2", "n"), ["h1", "h2"]), "ann-found")
    mine = join_counted(queries.select("id", "h1", "h2"), found, ["h1", "h2"], "n", rows.count())
    others = F.slice(F.filter("found", lambda f: f["id"] != F.col("id")), 1, k)
    return mine.select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "f")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("f.id").alias("vec_id"), F.col("f.score").alias("score"))


def report(table: DataFrame) -> DataFrame:
    return search(table, F.col("id") % 20 == 0)
