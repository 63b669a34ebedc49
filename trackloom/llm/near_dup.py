"""Near duplicates by DartMinHash: weighted signatures, banded joining, exact verification.

A document is the multiset of its five-word shingles (a shorter one has one shingle of all its
words), words as in ``word_list``. Two documents are near duplicates if the weighted Jaccard
similarity of their multisets, sum of minima over sum of maxima, is THRESHOLD or more; a class
is a connected component of such links among documents that share a band.

Every shingle owns a random set of darts in the plane of weight and time, derived from hashes
alone, so equal shingles of different documents own equal darts. A dart below the document's
weight for the shingle is a hit and fills the coordinate it names; the earliest dart per
coordinate is the signature. Two documents agree in a coordinate with the probability of their
weighted similarity. Time is cut into cells that double; a document takes cells until its
coordinates are full, so the work is about K log K darts whatever its length.

With ROWS = 6 and BANDS = 30 a pair at similarity 0.8 shares a band with probability 0.9999.

Exact copies (equal words) are one node. In each bucket the members are first compared to the
least one only. Buckets that end in several components are compared again around a pivot of their
own, and after that the members outside a bucket's largest component meet those of its other
components. So every pair that shares a band is either in one class or was compared, by texts or,
in the last step, first by size and a parity sketch of all shingles: pairs that these prove to be
below the threshold are not written. Sketches tell most from about 4,000 shingles down; longer
documents are compared by texts. Families of near copies become components in the linear steps; the
last one tests as many pairs of sketches as a bucket has members, times those outside its largest
component, over as many tasks as that takes.

Defined cases: documents without words (null, empty, only signs) are each a class of their own;
rows with a null id keep a null class; rows with one id are one node, their class is that of the
id; other columns pass through ``keep_first``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import BROADCAST_ROWS, join_counted, map_arrow, store, text_slices, word_list
from trackloom.llm.graph import components

SHINGLE = 5
THRESHOLD = 0.8
ROWS, BANDS = 6, 30
COORDINATES = ROWS * BANDS
#: Bits of a document's parity sketch, and pairs of sketches that one task compares in a bucket.
BITS, CROSS_PAIRS = 2048, 4_000_000
SEED = 0x9E3779B97F4A7C15
#: Length of the first time cell; the next ones end at 2, 4, 8, ... times this.
FIRST_CELL = 1 / 64
#: Distinct words whose hashes a task remembers.
WORD_CACHE = 200_000
#: Bytes of text sketched at once: an entry of a few dozen bytes per word and dart is held.
SKETCH_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * (1.0 / (1 << 53))


def salt(*parts: int) -> np.uint64:
    x = SEED
    for p in parts:
        x = (x * 0xD1342543DE82EF95 + p + 1) & 0xFFFFFFFFFFFFFFFF
    return np.uint64(x)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(words: list[bytes], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and how often each occurs."""
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(h))
    total = np.zeros(len(h) - size + 1 if size else 0, np.uint64)
    for j in range(size):
        total = total * np.uint64(0x100000001B3) + mix(h[j:len(h) - size + 1 + j] + np.uint64(j))
    return np.unique(mix(total), return_counts=True)


@lru_cache(maxsize=256)
def poisson_table(mean: float) -> np.ndarray:
    top = int(mean + 12 * math.sqrt(mean) + 24)
    log = [i * math.log(mean) - mean - math.lgamma(i + 1) for i in range(top)]
    return np.cumsum(np.exp(log))


def signatures(keys: np.ndarray, weights: np.ndarray, owner: np.ndarray, docs: int) -> np.ndarray:
    """(docs, COORDINATES) signatures; ``keys`` and ``weights`` are the shingles of all documents
    and ``owner`` their document. Every document has a shingle."""
    first = np.full(docs * COORDINATES, np.inf)
    names = np.zeros(docs * COORDINATES, np.uint64)
    open_docs = np.ones(docs, bool)
    cell = 0
    while True:
        begin, length = (0.0, FIRST_CELL) if cell == 0 else (FIRST_CELL * 2 ** (cell - 1),) * 2
        live = np.flatnonzero(open_docs[owner])
        if not len(live):
            return names.reshape(docs, COORDINATES)
        k, w, o = keys[live], weights[live], owner[live]
        region = 0
        while True:
            low, span = (0.0, 1.0) if region == 0 else (2.0 ** (region - 1),) * 2
            inside = np.arange(len(k)) if region == 0 else np.flatnonzero(w > low)
            if not len(inside):
                break
            seed = mix(k[inside] ^ salt(region, cell))
            table = poisson_table(span * length)
            draw = unit(seed)
            some = np.flatnonzero(draw >= table[0])
            number = np.searchsorted(table, draw[some], side="right")
            at = np.repeat(some, number)
            turn = np.arange(len(at)) - np.repeat(np.cumsum(number) - number, number)
            dart = mix(seed[at] + salt(7) * (turn + 1).astype(np.uint64))
            hit = low + span * unit(mix(dart ^ salt(11))) <= w[inside[at]]
            at, dart = at[hit], dart[hit]
            time = begin + length * unit(mix(dart ^ salt(13)))
            slot = o[inside[at]] * COORDINATES + (dart % np.uint64(COORDINATES)).astype(np.int64)
            np.minimum.at(first, slot, time)
            best = time == first[slot]
            names[slot[best]] = dart[best]
            region += 1
        open_docs = ~np.isfinite(first.reshape(docs, COORDINATES)).all(1)
        cell += 1


def band_keys(names: np.ndarray) -> np.ndarray:
    parts = names.reshape(len(names), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * np.uint64(SEED), parts.shape[:2])
    for j in range(ROWS):
        key = mix(key ^ parts[:, :, j]) + np.uint64(j)
    return key


def parity_bits(keys: np.ndarray, counts: np.ndarray, owner: np.ndarray, docs: int) -> np.ndarray:
    """(docs, BITS / 64) sketches: every copy of a shingle turns one bit of its document's."""
    copies = np.repeat(np.arange(len(keys)), counts)
    turn = np.arange(len(copies)) - np.repeat(np.cumsum(counts) - counts, counts)
    place = mix(keys[copies] ^ mix(turn.astype(np.uint64) + salt(17))) % np.uint64(BITS)
    odd = np.bincount(owner[copies] * BITS + place.astype(np.int64), minlength=docs * BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(docs, BITS), axis=1).view(np.int64)


def sketched(docs: DataFrame) -> DataFrame:
    """(id, f1, f2, bands, bits, size): a digest of the words, the band keys, the parity sketch and
    the number of shingles; nulls where there is no word."""
    def scan(batches):
        hashes = WordHashes()
        for part, texts in text_slices(batches, "text", SKETCH_BYTES):
            words = [word_list(t) for t in texts]
            full = [i for i, w in enumerate(words) if w]
            print_of = {i: xxhash.xxh3_128_digest(b" ".join(words[i])) for i in full}
            own = [shingles(words[i], hashes) for i in full]
            signed, bits = np.zeros((0, BANDS), np.int64), np.zeros((0, 1), np.int64)
            if full:
                keys, counts = (np.concatenate([o[x] for o in own]) for x in (0, 1))
                owner = np.repeat(np.arange(len(full)), [len(k) for k, _ in own])
                signed = band_keys(signatures(keys, counts.astype(np.float64), owner, len(full))).astype(np.int64)
                bits = parity_bits(keys, counts, owner, len(full))
            weight = {i: int(c.sum()) for i, (_, c) in zip(full, own, strict=True)}
            row_of = {i: r for r, i in enumerate(full)}
            digest = [np.frombuffer(print_of[i], "<i8").tolist() if i in print_of else (None, None) for i in range(len(texts))]
            lists = lambda table: pa.array(
                [table[row_of[i]] if i in row_of else None for i in range(len(texts))], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array([d[0] for d in digest], pa.int64()), pa.array([d[1] for d in digest], pa.int64()),
                 lists(signed), lists(bits), pa.array([weight.get(i) for i in range(len(texts))], pa.int64())],
                names=["id", "f1", "f2", "bands", "bits", "size"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), scan,
                     "id long, f1 long, f2 long, bands array<long>, bits array<long>, size long")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two shingle multisets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    return shared / (int(a[1].sum()) + int(b[1].sum()) - shared)


def possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` that may reach THRESHOLD by their sketches; texts of the others never move."""
    sketch = lambda end, name: nodes.select(F.col("id").alias(end), F.struct("bits", "size").alias(name))
    targets = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")).join(sketch("b", "y"), "b")
    both = join_counted(pairs.join(sketch("a", "x"), "a"), targets, ["b"], "n", pairs.count())
    return store(both.where(alike("x", "y")).select("a", "b"), "near-pairs")


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose texts reach THRESHOLD; ``b`` may be shared by many pairs."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    texts = store(docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids, "id", "left_semi"), "near-texts")
    if texts.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        texts = store(texts.dropDuplicates(["id"]), "near-texts")
    degree = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    targets = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")).join(degree, "b")
    with_a = pairs.join(texts.select(F.col("id").alias("a"), "text"), "a")
    both = join_counted(with_a, targets, ["b"], "n", pairs.count())

    def scan(batches):
        hashes, kept = WordHashes(), {}
        for part, texts in text_slices(batches, "text"):
            others = part.column("text_b").cast(pa.large_binary())
            a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
            good = []
            for i, text in enumerate(texts):
                if b[i] not in kept:
                    kept.clear()
                    kept[b[i]] = shingles(word_list(others[i].as_py() or b""), hashes)
                good.append(similarity(shingles(word_list(text), hashes), kept[b[i]]) >= THRESHOLD)
            yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return map_arrow(both.select("a", "b", "text", "text_b"), scan, "a long, b long")


def if_few(ids: DataFrame) -> DataFrame:
    """The stored ``ids`` with a broadcast hint if a count allows it."""
    return F.broadcast(ids) if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else ids


def nodes_of(rows: DataFrame, copied: DataFrame) -> DataFrame:
    """One of the ``rows`` of each id that is not ``copied``. Rows are wide: only those of repeated ids
    are shuffled for it, and all are written again only where the ids to leave out are many."""
    twice = store(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "near-twice")
    out = store(copied.unionByName(twice), "near-out")
    once = if_few(out)
    several = store(rows.join(if_few(twice), "id", "left_semi").join(copied, "id", "left_anti").dropDuplicates(["id"]), "near-several")
    nodes = rows.join(once, "id", "left_anti").unionByName(several)
    return store(nodes, "near-nodes") if once is out else nodes


def classes(docs: DataFrame) -> DataFrame:
    """(id, class_id) once per row of ``docs``; the class is the least id of the component."""
    rows = store(sketched(docs), "near-sketches")
    worded = rows.where("f1 IS NOT NULL AND id IS NOT NULL")
    copies = worded.groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    total = worded.count()
    several = store(copies.where("n > 1"), "near-copies")
    copied = store(join_counted(worded.select("id", "f1", "f2"), several, ["f1", "f2"], "n", total).where("id <> rep")
                   .select("id", "rep").distinct(), "near-copied")
    nodes = nodes_of(worded.select("id", "bands", "bits", "size"), copied.select("id"))
    bands = nodes.select("id", F.explode("bands").alias("key"))
    buckets = store(bands.groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
                    .where("n > 1"), "near-buckets")
    members = store(join_counted(bands, buckets, ["key"], "n", BANDS * total), "near-members")
    # sketches of documents that meet no other never move
    met = store(members.select("id").distinct(), "near-ids")
    nodes = store(nodes.join(if_few(met), "id", "left_semi"), "near-nodes")
    stars = members.where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b")).distinct()
    labels = store(components(store(verified(possible(store(stars, "near-pairs"), nodes), docs), "near-links")), "near-labels")
    for pairs_of in (pivot_pairs, cross_pairs):
        mixed = store(mixed_rows(members, labels, BANDS * total).join(nodes, "id"), "near-mixed")
        pairs = store(pairs_of(mixed, BANDS * total, [alike, met_first]), "near-pairs")
        if pairs_of is pivot_pairs:
            pairs = possible(pairs, nodes)
        if not pairs.limit(1).count():
            continue
        labels = store(merged(labels, store(verified(pairs, docs), "near-links")), "near-labels")
    # copies follow their representative
    mates = copied.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("rep", "id")
    mates = mates.join(labels, "id", "left").select(F.col("id").alias("rep"), F.coalesce("label", "id").alias("label"), "n")
    followed = join_counted(copied, mates, ["rep"], "n", total).select("id", "label")
    # an id that is a node and, by another row, a copy: both classes meet in the least label
    named = labels.unionByName(followed).groupBy("id").agg(F.min("label").alias("label"))
    return rows.select("id").join(named, "id", "left").select("id", F.coalesce("label", "id").alias("class_id"))


def mixed_rows(members: DataFrame, labels: DataFrame, total: int) -> DataFrame:
    """(key, id, label) of the buckets that hold several components, without their least members:
    those were compared to all others."""
    tagged = members.join(labels, "id", "left").select("key", "id", "least", F.coalesce("label", "id").alias("label"))
    tagged = store(tagged, "near-tagged")
    mixed = tagged.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    mixed = mixed.where("n > 2 AND lo <> hi").select("key", "n")
    rows = join_counted(tagged, mixed, ["key"], "n", total)
    return store(rows.where("id <> least").select("key", "id", "label"), "near-mixed")


def alike(a: str, b: str, key: Column | None = None) -> Column:
    """Whether two documents may reach THRESHOLD. What one holds and the other does not is at most
    (1 - t) / (1 + t) of both sizes then, and no fewer than the bits in which the sketches differ; the
    smaller is at least t of the larger. No pair at the threshold is passed over."""
    words = F.zip_with(f"{a}.bits", f"{b}.bits", lambda x, y: F.bit_count(x.bitwiseXOR(y)))  # unrolled, it is too long to compile
    apart = F.aggregate(words, F.lit(0), lambda total, n: total + n)
    sizes = [F.col(f"{x}.size") for x in (a, b)]
    near = F.least(*sizes) >= THRESHOLD * F.greatest(*sizes) - 1e-6
    return near & (apart <= (1 - THRESHOLD) / (1 + THRESHOLD) * (sizes[0] + sizes[1]) + 1e-6)


def met_first(a: str, b: str, key: Column) -> Column:
    """Whether ``key`` is the first band that two documents share, so a pair is met once."""
    return F.get(F.array_intersect(f"{a}.bands", f"{b}.bands"), F.lit(0)) == key


def pivot_pairs(rows: DataFrame, total: int, _: Sequence = ()) -> DataFrame:
    """Each member of a mixed bucket with the bucket's pivot, where their components differ. The
    pivot has the least id after xor with the key, so buckets of the same members differ in it: a
    family whose members are not all near its least one meets many others of its own."""
    turned = F.col("id").bitwiseXOR(F.col("key"))
    pivots = rows.groupBy("key").agg(F.min(turned).alias("pivot"), F.count(F.lit(1)).alias("n"))
    pivots = pivots.where("n > 1").select("key", F.col("pivot").bitwiseXOR(F.col("key")).alias("pivot"), "n")
    met = join_counted(rows, pivots, ["key"], "n", total).where("id <> pivot")
    pairs = met.select(F.greatest("id", "pivot").alias("a"), F.least("id", "pivot").alias("b"), "id", "label", "pivot")
    pairs = pairs.dropDuplicates(["a", "b"])
    other = rows.select(F.col("id").alias("pivot"), F.col("label").alias("other")).distinct()
    uses = pairs.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).join(other, "pivot")
    return join_counted(pairs, uses, ["pivot"], "n", total).where("label <> other").select("a", "b")


def cross_pairs(rows: DataFrame, total: int, conditions: Sequence = ()) -> DataFrame:
    """In each mixed bucket, the members outside its largest component with all members of other
    components: what the stars left open. ``conditions`` on the two rows narrow the join itself.
    A bucket of many such pairs is dealt over salts: the outside members by a hash, the others to
    each salt."""
    sizes = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("size"))
    outside = F.col("n") - F.col("most")
    top = sizes.groupBy("key").agg(F.max_by("label", F.struct("size", "label")).alias("top"), F.max("size").alias("most"),
                                   F.sum("size").alias("n")).withColumn(
        "salts", F.greatest(F.lit(1), F.least(outside, F.ceil(outside * F.col("n") / CROSS_PAIRS))).cast("int")).drop("most")
    rows = store(join_counted(rows, top, ["key"], "n", total), "near-mixed")
    met = F.expr("x.key = y.key AND x.salt = y.salt AND x.label <> y.label AND (y.label = y.top OR x.id < y.id)")
    for condition in conditions:
        met = met & condition("x", "y", F.col("x.key"))
    left = rows.where("label <> top").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    right = rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    pairs = left.alias("x").join(right.alias("y"), met)
    return pairs.select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b")).distinct()


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (id, label) after further links: these are drawn between labels, whose components
    are found apart, and every id follows its label."""
    ends = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    known = labels.unionByName(ends.join(labels, "id", "left_anti").select("id", F.col("id").alias("label")))
    known = store(known, "near-known")
    uses = lambda end: links.groupBy(end).agg(F.count(F.lit(1)).alias("n")).withColumnRenamed(end, "id").join(known, "id")
    total = links.count()
    drawn = links
    for end in ("a", "b"):
        side = uses(end).select(F.col("id").alias(end), F.col("label").alias(f"l{end}"), "n")
        drawn = join_counted(drawn, side, [end], "n", total)
    joined = components(drawn.select(F.col("la").alias("a"), F.col("lb").alias("b")).where("a <> b").distinct())
    sizes = known.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    moves = joined.select(F.col("id").alias("label"), F.col("label").alias("to")).join(sizes, "label")
    moved = join_counted(known, moves, ["label"], "n", known.count(), "left")
    return moved.select("id", F.coalesce("to", "label").alias("label"))


def report(docs: DataFrame) -> DataFrame:
    return classes(docs).select(F.col("id").alias("doc_id"), "class_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents whose class has a smaller id; null ids stay."""
    later = classes(docs).where("id <> class_id").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(later, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])
