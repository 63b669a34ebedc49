"""Toxicity by multiple-instance learning: sentence scores meet in a noisy-or.

A document is a bag of sentences (cut at . ! ? and line ends). A sentence's score is the
logistic of a bias plus the weights of its distinct words and word beginnings; the document's is
one minus the product of one minus its sentences' scores. Only document labels are known: the
log-likelihood of the noisy-or is what is fitted, and the sentence scores that come of it locate
the offending sentences.

The fit uses at most SAMPLE_ROWS labelled documents of each class, those of the smallest hash of
their id, one row of an id, weighted to the true class sizes, in one task; rows with crc32(doc_id) mod 5 = 0 are
held out. Every document is scored over its whole text. The model is at most FEATURES weights and
is broadcast.

Defined cases: null or empty texts have no sentence and score 0; several labels of an id give
1 if any is 1, null labels and those without a document are ignored; of an id's rows the text of
the smallest hash is learned from, and all are scored; very long texts are scored whole, one at a time; without labels of both classes all scores are 0 or, if
all labels are 1, 1; other columns pass through ``keep_clean``.
"""

from __future__ import annotations

import math
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import give_back, map_arrow, text_slices

SAMPLE_ROWS = 3000
FEATURES = 6000
#: Documents of the sample that a feature must be in.
LEAST_DOCUMENTS = 4
#: Lengths in bytes of the word beginnings used as features beside whole words.
BEGINNINGS = (3, 4, 5, 6, 7)
STEPS, RATE, DECAY = 250, 0.15, 2e-4
THRESHOLD = 0.5
WORD_CACHE = 100_000
#: Words of the sample whose features are made at once.
CHUNK = 100_000
SENTENCES = bytes(10 if b in b".!?\n" else b + 32 if 65 <= b <= 90 else
                  b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def sentences(text: bytes) -> list[set[bytes]]:
    """The distinct words of each sentence that has any."""
    bags = [set(s.split()) for s in text.translate(SENTENCES).split(b"\n")]
    return [b for b in bags if b]


def features(word: bytes) -> list[bytes]:
    return [b"=" + word, *[word[:n] for n in BEGINNINGS if len(word) >= n]]


class Numbers(dict):
    def __missing__(self, key: bytes) -> int:
        at = self[key] = len(self)
        return at


def distinct(owner: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different (owner, item) pairs by owner."""
    both = np.unique(owner.astype(np.int64) << 32 | item.astype(np.int64))
    return both >> 32, both & 0xFFFFFFFF


def spread(owner: np.ndarray, item: np.ndarray, first: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, entry) for every entry of ``flat`` in [first[item], first[item + 1])."""
    sizes = first[item + 1] - first[item]
    turn = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.repeat(owner, sizes), flat[np.repeat(first[item], sizes) + turn]


def slices(owner: np.ndarray) -> list[slice]:
    """About CHUNK entries each, never cutting an owner; ``owner`` ascends."""
    cuts = np.unique(np.searchsorted(owner, owner[np.arange(0, len(owner), CHUNK)])).tolist() if len(owner) else [0]
    return [slice(i, j) for i, j in zip(cuts, [*cuts[1:], len(owner)], strict=True)]


def numbered(texts: list[bytes]) -> tuple[Numbers, np.ndarray, np.ndarray, np.ndarray]:
    """(words, document of each sentence, sentence of each entry, word of each entry)."""
    number, words_of, sentence_of, owner = Numbers(), array("i"), array("i"), array("i")
    for d, text in enumerate(texts):
        for part in text.translate(SENTENCES).split(b"\n"):
            if words := set(part.split()):
                words_of.extend(map(number.__getitem__, words))
                sentence_of.extend([len(owner)] * len(words))
                owner.append(d)
    return number, *(np.frombuffer(x, np.int32) if len(x) else np.zeros(0, np.int32) for x in (owner, sentence_of, words_of))


def fit(texts: list[bytes], labels: np.ndarray, weights: np.ndarray) -> dict[bytes, float]:
    """Feature weights, the bias under b"": gradient steps (Adam) on the noisy-or likelihood. Words
    and features are numbers, and what has an entry per word is made in slices."""
    if not labels.any() or labels.all():
        return {b"": 40.0 if len(labels) and labels.all() else -math.inf}
    number, owner, sentence_of, words_of = numbered(texts)
    feature, flat, first = Numbers(), array("i"), array("i", [0])
    for word in number:
        flat.extend(map(feature.__getitem__, features(word)))
        first.append(len(flat))
    flat, first = np.frombuffer(flat, np.int32) if len(flat) else np.zeros(0, np.int32), np.array(first, np.int64)
    toxic = labels.astype(int)
    total = [int((toxic == v).sum()) for v in (0, 1)]
    held = np.zeros((2, len(feature)), np.int64)
    for mine in slices(document := owner[sentence_of]):
        bag, found = distinct(*spread(*distinct(document[mine], words_of[mine]), first, flat))
        for v in (0, 1):
            held[v] += np.bincount(found[toxic[bag] == v], minlength=len(feature))
    often = np.flatnonzero(held.sum(0) >= LEAST_DOCUMENTS).tolist()
    names = list(feature)
    odds = {}
    for i in often:
        n0, n1 = held[:, i].tolist()
        odds[names[i]] = n1 / total[1] * math.log((n1 + .5) / (total[1] + 1) * (total[0] + 1) / (n0 + .5))
    chosen = sorted(odds, key=lambda f: (-odds[f], f))[:FEATURES]
    place = {f: i for i, f in enumerate(chosen)}
    at_of = np.full(len(feature), -1, np.int32)
    at_of[[feature[f] for f in chosen]] = np.arange(len(chosen))
    kept = at_of[flat] >= 0
    first, flat = np.concatenate([[0], np.cumsum(kept)])[first], at_of[flat[kept]]
    del names, odds, number, feature, held, kept, document
    parts = [distinct(*spread(sentence_of[mine], words_of[mine], first, flat)) for mine in slices(sentence_of)]
    rows, at = (np.concatenate([p[i] for p in parts] or [np.zeros(0, np.int64)]) for i in (0, 1))
    sentence = len(owner)
    del parts, words_of, sentence_of
    theta = np.zeros(len(chosen) + 1)
    theta[-1] = -6.0
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    y, scale = labels.astype(float), weights / weights.sum()
    for step in range(1, STEPS + 1):
        z = theta[-1] + np.bincount(rows, theta[at], sentence)
        total = np.bincount(owner, np.logaddexp(0, z), len(texts))
        pull = np.where(y > 0, -1.0 / np.expm1(np.clip(total, 1e-9, 50)), 1.0) * scale
        slope_z = pull[owner] / (1 + np.exp(-np.clip(z, -50, 50)))
        slope = np.append(np.bincount(at, slope_z[rows], len(chosen)), slope_z.sum())
        slope[:-1] += DECAY * theta[:-1]
        mean = 0.9 * mean + 0.1 * slope
        square = 0.999 * square + 0.001 * slope ** 2
        theta -= RATE * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.999 ** step)) + 1e-8)
    return {b"": float(theta[-1])} | {f: float(theta[i]) for f, i in place.items() if abs(theta[i]) > 1e-6}


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def train(docs: DataFrame, labels: DataFrame) -> dict[bytes, float]:
    """The model from the labelled documents that are not held out."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(fold(F.col("doc_id")) != 0).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    parts = [known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS) for label in (0, 1)]
    sample = parts[0].unionByName(parts[1])
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(
        F.min_by("text", F.xxhash64("text")).alias("text"))

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "text"])
        label = group["toxic"].to_numpy(np.int64)
        share = {v: sizes.get(v, 0) / max(1, int((label == v).sum())) for v in (0, 1)}
        weight = np.array([share[v] for v in label], float)
        model = fit([(t or "").encode() for t in group["text"]], label, weight)
        give_back()
        return pd.DataFrame({"feature": [f.hex() for f in model], "weight": list(model.values())})

    found = rows.groupBy().applyInPandas(one, "feature string, weight double").collect()
    return {bytes.fromhex(r["feature"]): r["weight"] for r in found} or {b"": -math.inf}


class WordWeights(dict):
    def __init__(self, model: dict[bytes, float]):
        super().__init__()
        self.model, self.bias = model, model[b""]

    def __missing__(self, word: bytes) -> tuple[tuple[bytes, float], ...]:
        if len(self) >= WORD_CACHE:
            self.clear()
        found = self[word] = tuple((f, self.model[f]) for f in features(word) if f in self.model)
        return found

    def logits(self, bags: list[set[bytes]]) -> list[float]:
        """The logit of each sentence; a feature that several words share counts once."""
        out = []
        for bag in bags:
            met: dict[bytes, float] = {}
            for pairs in map(self.__getitem__, bag):
                if pairs:
                    met.update(pairs)
            out.append(self.bias + sum(met.values()))
        return out


def noisy_or(logits: list[float]) -> float:
    total = sum(math.log1p(math.exp(z)) if z < 30 else z for z in logits if z > -700)
    return -math.expm1(-total)


def score(docs: DataFrame, model: dict[bytes, float], locate: bool = False) -> DataFrame:
    """``docs`` plus ``score``; with ``locate`` also ``offending``, the numbers of the sentences
    (those with a word, from 0) that score THRESHOLD or more alone."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    outs = ("score", "offending")
    others = [c for c in docs.columns if c != "text" and c not in outs]
    rows = docs.select("text", F.struct(F.lit(0).alias("_"), *others).alias("doc"))

    def scan(batches):
        weights = WordWeights(sent.value)
        for part, texts in text_slices(batches, "text"):
            scores, bad = [], []
            for text in texts:
                logits = weights.logits(sentences(text))
                scores.append(min(1.0, max(0.0, noisy_or(logits))))
                bad.append([i for i, z in enumerate(logits) if z >= 0])
            yield pa.RecordBatch.from_arrays(
                [part.column("text"), part.column("doc"), pa.array(scores, pa.float64()), pa.array(bad, pa.list_(pa.int32()))],
                names=["text", "doc", *outs])

    done = map_arrow(rows, scan, f"text string, doc {rows.schema['doc'].dataType.simpleString()}, score double, offending array<int>")
    columns = [F.col("text") if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns if c not in outs]
    return done.select(*columns, "score", *(["offending"] if locate else []))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), train(docs, labels), locate=True)
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "offending")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that score THRESHOLD or more."""
    others = [f"`{c}`" for c in docs.columns if c != "text"]
    scored = score(docs.select("text", F.struct(F.lit(0).alias("_"), *others).alias("row")), train(docs, labels))
    return scored.where(F.col("score") < THRESHOLD).select(*["text" if c == "text" else f"row.`{c}`" for c in docs.columns])
