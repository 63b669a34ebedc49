"""What the passage operator moves and how it sketches paragraphs."""

import random

import numpy as np
from pyspark.sql import functions as F

from trackloom.llm import substring_dedup as sd
from trackloom.llm.near_dup import WordHashes, mix, salt, shingles


def test_sketches_of_many_paragraphs_at_once_are_those_of_each(monkeypatch):
    rng = random.Random(5)
    lists = [[b"w%d" % rng.randrange(9) for _ in range(rng.choice([5, 6, 12, 40]))] for _ in range(300)]
    hashes = WordHashes()
    want = []
    for words in lists:
        own = shingles(words, hashes)[0]
        spot = [int(x) for x in mix(own ^ salt(41))]
        halves = [0, 0]
        for x in spot:
            halves[x >> 6 & 1] |= 1 << (x & 63)
        keys = [int(mix(np.array([mix(own ^ salt(band, 31)).min()]) + salt(band, 37))[0]) for band in range(sd.BANDS)]
        want.append((keys, [*halves, len(own)]))

    def one_by_one(*_):
        raise AssertionError("a paragraph was sketched by itself")

    monkeypatch.setattr(sd, "shingles", one_by_one)
    keys, sketch = sd.min_keys(lists, hashes)
    assert [(a, b) for a, b in zip(keys.view(np.uint64).tolist(), sketch.view(np.uint64).tolist())] == want


def test_words_of_pairs_that_sketches_rule_out_never_move(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"u{i}" for i in range(400)]
    base = rng.choices(words, k=24)
    texts = [" ".join([*base[:23], rng.choice(words)]) + "." for _ in range(4)]
    texts += [" ".join(rng.choices(words, k=24)) + "." for _ in range(8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    same = [F.lit(band).cast("long").alias(k) for band, k in enumerate(sd.KEYS)]  # one bucket holds all
    nodes = sd.named(docs).select("fp", F.col("doc").alias("keeper"), *same, *sd.SKETCH).cache()
    moved, plain = [], sd.verified

    def counted(pairs, *rest):
        moved.append(pairs.count())
        return plain(pairs, *rest)

    monkeypatch.setattr(sd, "verified", counted)
    labels = {r["id"]: r["label"] for r in sd.near_classes(nodes, docs).collect()}
    near = [sd.name_of(t[:-1].encode().split()) for t in texts[:4]]
    assert set(labels) == set(near) and set(labels.values()) == {min(near)}
    assert sum(moved) <= 6  # pairs of the four near ones; the stars alone were eleven


def test_windows_carry_their_place_in_few_columns(spark):
    run = " ".join(f"s{i}" for i in range(40))
    docs = spark.createDataFrame([(3, f"é a b, {run} x"), (7, f"{run}  y z")], "doc_id long, text string")
    rows = sd.shared_windows(docs)
    assert set(rows.columns) == {"doc", "keeper", "place", "span"}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = [(r["doc"], r["place"] >> 32, r["place"] & 0xFFFFFFFF, r["span"], r["keeper"]) for r in rows.collect()]
    assert len(found) == 2 * 33 and {x[4] for x in found} == {3}
    for doc, first, start, span, _ in found:
        assert texts[doc][start:start + span].split() == [f"s{first - (3 if doc == 3 else 0) + j}" for j in range(8)]
