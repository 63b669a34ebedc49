"""Substring dedup by paragraph MinHash banding.

Shared passages often stand inside longer lines, so paragraphs are cut by content: a text falls
into parts at . ! ? and line ends (parts of more than LONG_PART words also after words whose hash
says so), and a paragraph ends after a part of at least FULL_PART words or whose hash says so. A
passage is therefore cut alike wherever it stands, save its first and last paragraph.

Equal paragraphs (64-bit hash of their words, as in ``word_list``) are counted with partial sums
and become one node. Nodes are banded: BANDS keys of one MinHash each over five-word shingles, so
at Jaccard 0.8 a pair meets with probability 0.998. Members of a bucket are compared to its least
node by exact Jaccard similarity; buckets that end in several components are compared around a
pivot, then across components, as in ``near_dup``. So every pair that shares a band is in one class
or was compared, first by sketches (``alike``), which pass over no pair at the threshold, then by words.
Classes are connected components.

A paragraph of a class found in several documents is shared; its keeper is the smallest doc_id of
the class. Paragraphs at the ends of a passage merge with their surroundings, so equal windows of
WINDOW words are joined too. The least hashes of every SPREAD windows in a row are anchors, thus
any run of WINDOW + SPREAD - 1 = 19 equal words has one: a passage of 51 words with one changed word
or of 60 with two always has. Around anchors found in several documents, up to REACH words to
either side, all windows are counted; those in several documents are shared, their keeper is the
smallest doc_id. That extends a match word by word and stops at the word where texts part.

Shared words, with gaps of up to GAP_CHARS characters, are a passage if RUN_WORDS of them or more
are kept by other documents, in which case it is removed, or by the document itself.

Defined cases: null or empty texts have no paragraph; a null id is never a keeper unless all are
null, and such documents are not reported; rows of one id are one document; a passage that only
repeats inside one document stays; long texts are cut like others; further columns pass through.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import BROADCAST_ROWS, WORD_BYTES, join_counted, store, text_slices, word_list
from trackloom.llm.graph import components
from trackloom.llm.near_dup import SHINGLE, THRESHOLD, WordHashes, cross_pairs, if_few, mix, mixed_rows, pivot_pairs, salt, shingles, similarity
from trackloom.llm.toxicity import SENTENCES

FULL_PART, LONG_PART = 8, 24
RUN_WORDS = 25
WINDOW, SPREAD, REACH = 8, 12, 60
GAP_CHARS = 40
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def bands_for(jaccard: float, rows: int, wanted: float) -> int:
    """The fewest bands that reach the wanted recall."""
    return math.ceil(math.log(1 - wanted) / math.log(1 - jaccard ** rows))


BANDS = bands_for(THRESHOLD, 1, 0.998)
KEYS = [f"k{i}" for i in range(BANDS)]
#: A bitmap of the shingles in two words, and their number.
SKETCH = ["s0", "s1", "size"]


def parts(text: bytes, hashes: WordHashes):
    """(end offset, words) of the parts of a text that have words."""
    start = 0
    for part in text.translate(SENTENCES).split(b"\n"):
        words = part.split()
        end = start + len(part) + 1
        if len(words) > LONG_PART:
            held = []
            for m in WORD.finditer(part):
                held.append(m.group())
                if hashes[m.group()] % 12 == 0:
                    yield start + m.end(), held
                    held = []
            if held:
                yield end, held
        elif words:
            yield end, words
        start = end


def paragraphs(text: bytes, hashes: WordHashes) -> list[tuple[int, int, list[bytes]]]:
    """(start, end, words) in bytes, in order."""
    out, start, held = [], 0, []
    for end, words in parts(text, hashes):
        held.extend(words)
        if len(words) >= FULL_PART or xxhash.xxh64_intdigest(b" ".join(words), 3) % 3 == 0:
            out.append((start, min(end, len(text)), held))
            start, held = end, []
    if held:
        out.append((start, len(text), held))
    return out


def name_of(words: list[bytes]) -> int:
    """The node of a paragraph: a signed 64-bit hash of its words."""
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63)


def min_keys(lists: list[list[bytes]], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(paragraphs, BANDS) band keys, and the SKETCH of each paragraph; all have SHINGLE words or more.
    The shingles of all paragraphs are made at once: as in ``shingles``, but not yet distinct, which
    neither a least key nor a bitmap needs."""
    every, inside, owner = window_hashes(lists, hashes, SHINGLE)
    every, owner = every[inside], owner[:len(inside)][inside]
    starts = np.searchsorted(owner, np.arange(len(lists)))
    keys = np.stack([mix(np.minimum.reduceat(mix(every ^ salt(band, 31)), starts) + salt(band, 37))
                     for band in range(BANDS)], axis=1).astype(np.int64)
    spot = mix(every ^ salt(41))
    bit, upper = np.uint64(1) << (spot & np.uint64(63)), (spot >> np.uint64(6)) & np.uint64(1) == 1
    words = [np.bitwise_or.reduceat(np.where(half, bit, np.uint64(0)), starts).view(np.int64) for half in (~upper, upper)]
    every = every[np.lexsort((every, owner))]
    fresh = np.r_[True, every[1:] != every[:-1]]
    fresh[starts] = True
    return keys, np.stack([*words, np.add.reduceat(fresh.astype(np.int64), starts)], axis=1)


def named(docs: DataFrame) -> DataFrame:
    """(fp, doc, k0..., SKETCH): the paragraphs of SHINGLE words or more of each document, once each."""
    def scan(batches):
        hashes = WordHashes()
        for part, texts in text_slices(batches, "text"):
            rows, names, lists = [], [], []
            for at, text in enumerate(texts):
                seen = {name_of(w): w for _, _, w in paragraphs(text, hashes) if len(w) >= SHINGLE}
                rows.extend([at] * len(seen))
                names.extend(seen)
                lists.extend(seen.values())
            keys, sketch = min_keys(lists, hashes) if lists else (np.zeros((0, BANDS), np.int64), np.zeros((0, 3), np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), part.column("doc").take(pa.array(rows, pa.int64())),
                 *[pa.array(keys[:, i]) for i in range(BANDS)], *[pa.array(sketch[:, i]) for i in range(len(SKETCH))]],
                names=["fp", "doc", *KEYS, *SKETCH])

    shape = ", ".join(["fp long", "doc long", *[f"{k} long" for k in [*KEYS, *SKETCH]]])
    return docs.select(F.col("doc_id").cast("long").alias("doc"), "text").mapInArrow(scan, shape)


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` of nodes whose shingle sets reach THRESHOLD."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    places = store(nodes.join(wanted, "fp", "left_semi").select("fp", F.col("keeper").alias("doc")), "passage-places")
    ids = places.select("doc").distinct()
    if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)

    def scan(batches):
        hashes = WordHashes()
        for part, texts in text_slices(batches, "text"):
            names, words = [], []
            for text in texts:
                own = {name_of(w): w for _, _, w in paragraphs(text, hashes) if len(w) >= SHINGLE}
                names.extend(own)
                words.extend(b" ".join(w) for w in own.values())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array(words, pa.binary())], names=["fp", "words"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").join(ids, "doc", "left_semi")
    found = found.select("text").mapInArrow(scan, "fp long, words binary")
    found = store(found.join(if_few(places.select("fp")), "fp", "left_semi").groupBy("fp").agg(F.min("words").alias("words")), "passage-words")
    degree = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    targets = found.select(F.col("fp").alias("b"), F.col("words").alias("words_b")).join(degree, "b")
    both = join_counted(pairs.join(found.select(F.col("fp").alias("a"), "words"), "a"), targets, ["b"], "n", pairs.count())

    def compare(batches):
        hashes = WordHashes()
        for part, texts in text_slices(batches, "words"):
            others = part.column("words_b").to_pylist()
            good = []
            for one, two in zip(texts, others, strict=True):
                a, b = shingles(one.split(), hashes)[0], shingles(two.split(), hashes)[0]
                good.append(similarity((a, np.ones(len(a), int)), (b, np.ones(len(b), int))) >= THRESHOLD)
            yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "words", "words_b").mapInArrow(compare, "a long, b long")


def bucketed(bands: DataFrame, total: int, name: str) -> DataFrame:
    """(key, id, least) of the buckets with several nodes."""
    buckets = store(bands.groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1"), name)
    return store(join_counted(bands, buckets, ["key"], "n", total), name)


def stars_of(members: DataFrame) -> DataFrame:
    return members.where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b")).distinct()


def alike(a: str, b: str, key: Column | None = None) -> Column:
    """Whether two bitmaps leave THRESHOLD possible: no pair differs in more bits than shingles, and at
    the threshold in at most (1 - t) / (1 + t) of the shingles of both."""
    apart = [F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in SKETCH[:2]]
    most = (1 - THRESHOLD) / (1 + THRESHOLD) * (F.col(f"{a}.size") + F.col(f"{b}.size")) + 1e-6
    return apart[0] + apart[1] <= most


def possible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` that may reach THRESHOLD by their sketches (id, SKETCH); words of the
    others never move."""
    ids = store(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "passage-ids")
    own = store(sketches.join(if_few(ids), "id", "left_semi"), "passage-sketches")
    side = lambda end, name: own.select(F.col("id").alias(end), F.struct(*SKETCH).alias(name))
    targets = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")).join(side("b", "y"), "b")
    both = join_counted(pairs.join(side("a", "x"), "a"), targets, ["b"], "n", pairs.count())
    return store(both.where(alike("x", "y")).select("a", "b"), "passage-pairs")


def near_classes(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, label) of the nodes that are near another."""
    total = BANDS * nodes.count()
    keys = lambda df: df.select("id", F.explode(F.array(*KEYS)).alias("key"))
    plain = nodes.select(F.col("fp").alias("id"), *KEYS)
    members = bucketed(keys(plain), total, "passage-bands")
    sketched = set(SKETCH) <= set(nodes.columns)
    narrow = nodes.select(F.col("fp").alias("id"), *SKETCH) if sketched else plain.select("id")
    stars = store(stars_of(members), "passage-pairs")
    links = store(verified(possible(stars, narrow) if sketched else stars, nodes, docs), "passage-links")
    labels = components(links)
    for pairs_of in (pivot_pairs, cross_pairs):
        mixed = store(mixed_rows(members, labels, total).join(narrow, "id"), "passage-mixed")
        pairs = store(pairs_of(mixed, total, [alike] if sketched else []), "passage-pairs")
        if sketched and pairs_of is pivot_pairs:  # cross_pairs meets the sketches itself
            pairs = possible(pairs, narrow)
        if pairs.limit(1).count():
            links = links.unionByName(store(verified(pairs, nodes, docs), "passage-links"))
            labels = components(links)
    return labels


def shared_paragraphs(docs: DataFrame) -> DataFrame:
    """(fp, class_id, keeper, n): the paragraphs whose class is in several documents; n counts the
    documents of the paragraph itself."""
    grouped = named(docs).where("doc IS NOT NULL").groupBy("fp").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc").alias("keeper"), F.max("doc").alias("last"),
        *[F.min(k).alias(k) for k in [*KEYS, *SKETCH]])
    nodes = store(grouped, "passage-nodes")
    labels = near_classes(nodes, docs)
    near = nodes.select("fp", "n", "keeper", "last").join(labels.select(F.col("id").alias("fp"), "label"), "fp")
    classes = near.groupBy("label").agg(F.min("keeper").alias("keeper"), F.max("last").alias("last"), F.count(F.lit(1)).alias("size"))
    close = join_counted(near.select("fp", "n", "label"), classes.where("keeper <> last"), ["label"], "size", nodes.count())
    close = close.select("fp", F.col("label").alias("class_id"), "keeper", "n")
    alone = nodes.where("keeper <> last").join(labels.select(F.col("id").alias("fp")), "fp", "left_anti")
    return store(alone.select("fp", F.col("fp").alias("class_id"), "keeper", "n").unionByName(close), "passage-shared")


def window_hashes(lists: list[list[bytes]], hashes: WordHashes, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of ``width`` words of word lists laid end to end: their hashes, whether they lie in
    one list, and the list of each word."""
    counts = [len(words) for words in lists]
    h = np.fromiter((hashes[w] for words in lists for w in words), np.uint64, sum(counts))
    size = max(len(h) - width + 1, 0)
    total = np.zeros(size, np.uint64)
    for j in range(width):
        total = total * np.uint64(0x100000001B3) + mix(h[j:size + j] + np.uint64(j))
    owner = np.repeat(np.arange(len(lists)), counts)
    return mix(total), owner[:size] == owner[width - 1:][:size], owner


def anchors(names: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Where the windows stand that are least among SPREAD windows of their text in a row."""
    chosen = np.zeros(len(names), bool)
    size = len(names) - SPREAD + 1
    if size > 0:
        whole = np.ones(size, bool)
        least = names[:size].copy()
        for j in range(SPREAD):
            whole &= inside[j:size + j]
            np.minimum(least, names[j:size + j], out=least)
        for j in range(SPREAD):
            chosen[j:size + j] |= whole & (names[j:size + j] == least)
    return np.flatnonzero(chosen)


def code_points(text: bytes) -> np.ndarray:
    """The code points before each byte."""
    return np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])


def repeated(rows: DataFrame, name: str) -> DataFrame:
    """The stored ``rows`` (h, doc, ...) whose h is in several documents, with the least as keeper."""
    groups = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("keeper"), F.max("doc").alias("last"))
    groups = store(groups.where("keeper <> last").select("h", "keeper", "n"), name)
    return join_counted(rows, groups, ["h"], "n", rows.count())


def shared_windows(docs: DataFrame) -> DataFrame:
    """(doc, keeper, place, span): the windows found in several documents. ``place`` holds the first of
    their WINDOW words above its code point in 32 bits, ``span`` the number of code points: rows are
    many, so they are narrow."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").where("doc_id IS NOT NULL")

    def pick(batches):
        hashes = WordHashes()
        for part, texts in text_slices(batches, "text"):
            names, inside, owner = window_hashes([word_list(t) for t in texts], hashes)
            at = anchors(names, inside)
            rows = owner[at]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[at].view(np.int64)), part.column("doc").take(pa.array(rows)),
                 pa.array((at - np.searchsorted(owner, rows)).astype(np.int32))], names=["h", "doc", "pos"])

    seeds = repeated(store(texts.mapInArrow(pick, "h long, doc long, pos int"), "passage-anchors"), "passage-seeds")
    places = store(seeds.groupBy("doc").agg(F.collect_set("pos").alias("places")), "passage-spots")
    ids = places.select("doc")
    if places.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)

    def around(batches):
        hashes = WordHashes()
        for part, texts in text_slices(batches, "text"):
            cells, rows = [], []
            for at, (text, spots) in enumerate(zip(texts, part.column("places").to_pylist(), strict=True)):
                names, _, _ = window_hashes([word_list(text)], hashes)
                size = len(names)
                spots = np.array(spots, np.int64)
                edges = np.bincount(np.clip(spots - REACH, 0, size), minlength=size + 1) - np.bincount(
                    np.minimum(spots + WINDOW + REACH, size), minlength=size + 1)
                first = np.flatnonzero(np.cumsum(edges)[:size] > 0)
                held = np.frombuffer(b" " + text.translate(WORD_BYTES) + b" ", np.uint8) != 32
                turns = np.flatnonzero(held[1:] != held[:-1])
                points = code_points(text)
                start = points[turns[::2]][first]
                cells.append(np.stack([names[first].view(np.int64), first << 32 | start, points[turns[1::2]][first + WINDOW - 1] - start]))
                rows.append(np.full(len(first), at))
            table = np.concatenate(cells, axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(table[0]), part.column("doc").take(pa.array(np.concatenate(rows))),
                 pa.array(table[1]), pa.array(table[2].astype(np.int32))], names=["h", "doc", "place", "span"])

    found = texts.join(ids, "doc", "left_semi").join(places, "doc")
    windows = store(found.mapInArrow(around, "h long, doc long, place long, span int"), "passage-windows", "zstd")
    return repeated(windows, "passage-repeats").drop("h")


def spans_of(doc: int, first: np.ndarray, last: np.ndarray, start: np.ndarray, end: np.ndarray,
             keeper: np.ndarray) -> list[tuple[int, int, bool, int, int, int]]:
    """(start, end, kept, first word, end word, shared words) of the passages of one document."""
    size = int(last.max())
    begin, finish = np.full(size, np.iinfo(np.int64).max), np.zeros(size + 1, np.int64)
    np.minimum.at(begin, first, start)
    np.maximum.at(finish, last, end)

    def covered(rows: np.ndarray) -> np.ndarray:
        steps = np.bincount(first[rows], minlength=size + 1) - np.bincount(last[rows], minlength=size + 1)
        return np.cumsum(steps)[:size] > 0

    def runs(mask: np.ndarray, counted: np.ndarray, kept: bool, cuts: list) -> list:
        turns = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
        out = []
        for i, j in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
            # a removed passage beside the run ends it where no window does
            low = max([c[1] for c in cuts if c[4] <= i], default=0)
            high = min([c[0] for c in cuts if c[3] >= j], default=None)
            a = low if begin[i] == np.iinfo(np.int64).max else max(int(begin[i]), low)
            b = int(finish[j]) or high
            b = b if high is None else min(b, high)
            if out and a - out[-1][1] <= GAP_CHARS:
                a, i = out[-1][0], out.pop()[3]
            out.append((a, b, kept, i, j))
        sums = np.concatenate([[0], np.cumsum(counted)])
        return [(*r, int(sums[r[4]] - sums[r[3]])) for r in out if sums[r[4]] - sums[r[3]] >= RUN_WORDS]

    other, own = covered(keeper != doc), covered(keeper == doc)
    gone = runs(other, other, False, [])
    left = other | own
    for r in gone:
        left[r[3]:r[4]] = False
    return sorted(gone + runs(left, own & left, True, gone))


def passages(docs: DataFrame) -> DataFrame:
    """(doc_id, spans, class_ids, kept_in, shared_words, removed_words): one row per document with a
    shared passage. ``spans`` are (start, end, kept) in code points; ``class_ids`` are those of its
    shared paragraphs; ``kept_in`` are the documents that keep the passages."""
    shared = shared_paragraphs(docs)

    def place(batches):
        hashes = WordHashes()
        for part, texts in text_slices(batches, "text"):
            rows, cells = [], []
            for at, text in enumerate(texts):
                points, first = code_points(text).tolist(), 0
                for start, end, words in paragraphs(text, hashes):
                    cells.append((name_of(words), first, first + len(words), points[start], points[end]))
                    first += len(words)
                    rows.append(at)
            columns = list(zip(*cells, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [part.column("doc").take(pa.array(rows, pa.int64())), pa.array(columns[0], pa.int64()),
                 *[pa.array(c, pa.int32()) for c in columns[1:]]], names=["doc", "fp", "first", "last", "start", "end"])

    units = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").where("doc_id IS NOT NULL").mapInArrow(
        place, "doc long, fp long, first int, last int, start int, end int")
    total = shared.agg(F.sum("n")).first()[0] or 0
    marked = join_counted(units, shared, ["fp"], "n", total).drop("fp")
    cell, window = F.struct("first", "last", "start", "end", "keeper", "class_id"), F.struct("place", "span", "keeper")
    marked = marked.select("doc", cell.alias("cell")).unionByName(
        shared_windows(docs).select("doc", window.alias("window")), allowMissingColumns=True)
    per_doc = marked.groupBy("doc").agg(F.collect_set("cell").alias("cells"), F.collect_set("window").alias("windows"))

    def columns(lists, count):
        """The fields of lists of structs laid end to end, and where each list ends."""
        cells = lists.flatten()
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        return [cells.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(count)], np.cumsum(sizes).tolist()

    def runs(batches):
        for batch in batches:
            ids, spans, classes, keepers, total, gone = [], [], [], [], [], []
            units, ends = columns(batch.column("cells"), 6)
            (place, span, near), stops = columns(batch.column("windows"), 3)
            words, point = place >> 32, place & 0xFFFFFFFF
            windows = [words, words + WINDOW, point, point + span, near]
            for k, doc in enumerate(batch.column("doc").to_pylist()):
                mine, other = (slice(x[k - 1] if k else 0, x[k]) for x in (ends, stops))
                first, last, start, end, keeper = (np.concatenate([a[mine], b[other]]) for a, b in zip(units, windows))
                found = spans_of(doc, first, last, start, end, keeper)
                if found:
                    inside = np.zeros(len(first), bool)
                    for _, _, kept, i, j, _ in found:
                        inside |= (first >= i) & (last <= j) & ((keeper == doc) == kept)
                    ids.append(doc)
                    spans.append([{"start": r[0], "end": r[1], "kept": r[2]} for r in found])
                    classes.append(np.unique(units[5][mine][inside[:ends[k] - mine.start]]).tolist())
                    keepers.append(np.unique(keeper[inside]).tolist())
                    total.append(sum(r[5] for r in found))
                    gone.append(sum(r[5] for r in found if not r[2]))
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kept", pa.bool_())]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(spans, span), pa.array(classes, pa.list_(pa.int64())),
                 pa.array(keepers, pa.list_(pa.int64())), pa.array(total, pa.int64()), pa.array(gone, pa.int64())],
                names=["doc_id", "spans", "class_ids", "kept_in", "shared_words", "removed_words"])

    return per_doc.mapInArrow(
        runs, "doc_id long, spans array<struct<start:int,end:int,kept:boolean>>, class_ids array<long>, "
              "kept_in array<long>, shared_words long, removed_words long")


def report(docs: DataFrame) -> DataFrame:
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"], F.when(
        s["kept"], "kept").otherwise("removed"))), ",")
    return passages(docs.select("doc_id", "text")).select(
        "doc_id", F.size("spans").cast("long").alias("n_passages"), "shared_words", "removed_words", "kept_in",
        spans.alias("spans"))


def remove(docs: DataFrame) -> DataFrame:
    """``docs`` without the passages that another document keeps; ``n_chars`` follows the text."""
    found = passages(docs).select("doc_id", F.filter("spans", lambda s: ~s["kept"]).alias("gone"))
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("doc")).join(
        found.withColumnRenamed("doc_id", "_doc"), F.expr("CAST(doc_id AS BIGINT) = _doc"), "left").select("doc", "text", "gone")

    def cut(batches):
        for part, texts in text_slices(batches, "text"):
            out = []
            for text, gone in zip(texts, part.column("gone").to_pylist(), strict=True):
                if gone:
                    whole, left, kept = text.decode(), 0, []
                    for s in gone:
                        kept.append(whole[left:s["start"]])
                        left = s["end"]
                    text = ("".join(kept) + whole[left:]).encode()
                out.append(text)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc"), pa.array(out, pa.binary()).cast(pa.string())], names=["doc", "cut"])

    done = rows.mapInArrow(cut, f"doc {rows.schema['doc'].dataType.simpleString()}, cut string")
    new = {"text": F.col("cut").alias("text"), "n_chars": F.length("cut").cast("long").alias("n_chars")}
    return done.select(*[new.get(c, F.col(f"doc.`{c}`")) for c in docs.columns])
