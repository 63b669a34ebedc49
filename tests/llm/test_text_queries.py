"""The text queries against their SQL, and those without SQL against brute force."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import FOLDER
from trackloom.llm import chat, decontam, line_dedup, near_dup, pieces, pii, quality, substring_dedup, toxicity, warc
from trackloom.llm.graph import components
from trackloom.llm.queries import ORACLES, QUERIES


def rows_of(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    cur = duck.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in cur.fetchall()), key=repr)
    assert rows_of(df) == want


# ---- odd tables ----

LONG = "Very long words stand here again and again. " * 3000
ODD = [
    (1, None, "en", None, None), (2, "", None, "a", 0), (None, "A text without an id, 4 times over.", "en", "a", 3),
    (3, LONG, "en", "b", len(LONG)), (3, LONG, "en", "b", len(LONG)), (4, "\n\n \t\n", "", "", 5),
    (5, "a.b@c.de 1.2.3.4 ▁▁ <|end|> é漢🙂", "en", "a", 1), (6, "." * 500 + "\n" + "1" * 5000, "de", "b", 1),
    (7, "x" * 20000, "en", "b", 1)]
SHAPE = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns named like the operators' own.
CLASH = ["pii", "tokens", "score", "offending", "n_lines", "n_dropped", "spans", "items", "row", "key", "id", "hash", "line",
         "words", "doc", "n", "label", "h1", "bands"]


def odd(spark, clash=False):
    df = spark.createDataFrame(ODD, SHAPE)
    return df.withColumns({c: F.lit("clash") for c in CLASH}) if clash else df


def labels_of(spark):
    return spark.createDataFrame([(1, 0, 1), (2, 1, 0), (None, 1, 1), (3, None, None), (3, 1, 0), (7, 0, 1)],
                                 "doc_id long, quality int, toxic int")


def bench_of(spark, rows=((1, "very long words stand here"), (None, "nothing"), (2, None), (3, "..."))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


OPERATORS = {
    "pii": lambda s, d: pii.detect(d), "pii_report": lambda s, d: pii.report(d), "lines": lambda s, d: line_dedup.clean(d),
    "line_report": lambda s, d: line_dedup.report(d), "near": lambda s, d: near_dup.keep_first(d),
    "near_report": lambda s, d: near_dup.report(d), "decontam": lambda s, d: decontam.remove_documents(d, bench_of(s)),
    "decontam_spans": lambda s, d: decontam.remove_spans(d, bench_of(s)),
    "decontam_report": lambda s, d: decontam.report(d, bench_of(s)), "toxic": lambda s, d: toxicity.keep_clean(d, labels_of(s)),
    "toxic_report": lambda s, d: toxicity.report(d, labels_of(s)), "pieces": lambda s, d: pieces.decode(pieces.encode(d)),
    "piece_report": lambda s, d: pieces.report(d), "quality": lambda s, d: quality.apply_rules(d),
    "quality_lines": lambda s, d: quality.remove_lines(d, s.createDataFrame([], "host string, line long, n_docs long")),
    "passages": lambda s, d: substring_dedup.report(d), "passage_texts": lambda s, d: substring_dedup.remove(d)}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_odd_and_empty_tables(spark, name):
    run = OPERATORS[name]
    plain = run(spark, odd(spark)).collect()
    if not name.startswith(("near", "toxic", "decontam", "pass")):
        assert len(plain) == len(ODD)
    assert len(run(spark, odd(spark, clash=True)).collect()) == len(plain)
    empty = spark.createDataFrame([], SHAPE)
    assert run(spark, empty).collect() == []


@pytest.mark.parametrize("run", ["lines", "near", "decontam", "toxic"])
def test_stages_return_the_columns_of_documents(spark, run):
    wide = odd(spark, clash=True).where("doc_id IS NOT NULL")
    assert OPERATORS[run](spark, wide).columns == wide.columns


# ---- personal data ----

def base_spans(text):
    """The contract's rules by Python's re."""
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15)]
    return [(k, m.start(), m.end()) for k, p, ok in rules for m in re.finditer(p, text) if ok(m.group())]


def test_base_spans_by_brute_force(spark):
    random.seed(3)
    bits = ["a.b@c.de", "x@y", "@", "é", "1.2.3.4", "999.1.1.1.2.3.4", "1.1.1.1.1.1.1.1", "4111 1111 1111 1111",
            "4111-1111-1111-1112", "5500005555555559123", "+1 (212) 555-0100", "+49 30 12345678", "+1", "00", " ", "-", ".",
            "漢🙂", "\n", "a%b@c-d.e.f", "12345678901234567890", "001.002.003.255", "1.2.3.256", "a@b.c@d.e"]
    texts = ["".join(random.choice(bits) + random.choice(["", " ", "  "]) for _ in range(random.randint(1, 30))) for _ in range(300)]
    texts += ["1" * 3000, "1 " * 3000, "a" * 3000 + "@b.c", "+1" + " (" * 3000 + "2", "9.9." * 2000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in pii.detect(docs).collect():
        got = [(s["kind"], s["start"], s["end"]) for s in row["pii"] if s["kind"] in {k.name for k in pii.BASE}]
        assert got == base_spans(texts[row["doc_id"]]), texts[row["doc_id"]]


def test_added_kinds_need_a_checksum_or_context(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00 here", "DE89 3704 0044 0532 0130 01", "my SSN is 123-45-6789", "123-45-6789",
             "visa card 378282246310005", "378282246310005", "x378282246310005 card"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [s["kind"] for s in r["pii"]] for r in pii.detect(docs).collect()}
    assert got == {0: ["iban"], 1: [], 2: ["ssn"], 3: [], 4: ["short_card"], 5: [], 6: []}


# ---- lines ----

def test_ibans_before_capitals_digits_and_each_other(spark):
    iban, short, other = "DE89 3704 0044 0532 0130 00", "NO9386011117947", "GB29 NWBK 6016 1331 9268 19"
    texts = [f"Pay {iban} BIC COBADEFF", f"{iban} Please", f"é {iban} 12 times", f"{iban} {other}", f"{short} {iban} X",
             f"{other}, {short}", f"x{iban}", f"{iban}x", f"{iban[:-1]}1 BIC"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [r["text"][s["start"]:s["end"]] for s in r["pii"] if s["kind"] == "iban"] for r in pii.detect(df).collect()}
    assert [got[i] for i in range(len(texts))] == [
        [iban], [iban], [iban], [iban, other], [short, iban], [other, short], [], [], []]


def brute_lines(docs):
    keys = lambda t: [x.strip(" \t\n\x0b\x0c\r").encode().lower().decode() for x in (t or "").split("\n")]
    holders = {}
    for i, t in docs:
        for k in {k for k in keys(t) if len(k) >= 40}:
            holders.setdefault(k, []).append(i)
    return {i: "\n".join(x for x, k in zip((t or "").split("\n"), keys(t), strict=True)
                         if len(holders.get(k, ())) < 5 or i == max(holders[k])) for i, t in docs}


def line_docs(seed, ids):
    rng = random.Random(seed)
    pool = [f"Line number {i} of the common pool, long enough é" for i in range(25)] + ["short", "", "  "]
    return [(i, "\n".join(rng.choice([x, x.upper(), f"\t{x} "]) for x in rng.choices(pool, k=rng.randint(1, 9)))) for i in ids]


def test_line_index_inserts_and_deletes_reversibly(spark):
    first, more = line_docs(1, range(40)), line_docs(2, range(100, 140))
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    texts = lambda index, rows: {r["doc_id"]: r["text"] for r in index.dedup(frame(rows)).collect()}
    index = line_dedup.LineIndex.build(frame(first))
    assert texts(index, first) == brute_lines(first)
    both = index.insert(frame(more))
    assert texts(both, first + more) == brute_lines(first + more)
    back = both.delete(frame(more))
    assert texts(back, first) == brute_lines(first)
    assert sorted(map(tuple, back.counts.collect())) == sorted(map(tuple, index.counts.collect()))


def test_line_index_without_filters_gives_the_same(spark, monkeypatch):
    docs = spark.createDataFrame(line_docs(5, range(60)), "doc_id long, text string")
    want = rows_of(line_dedup.report(docs))
    monkeypatch.setattr(line_dedup, "FILTER_BYTES", 0)
    assert rows_of(line_dedup.report(docs)) == want


def test_cuckoo_filter_keeps_all_keys_and_forgets_deleted_ones():
    keys = np.random.default_rng(1).integers(-2 ** 63, 2 ** 63, (3000, 2))
    table = line_dedup.CuckooFilter(1 << 9)  # over capacity, so some keys are kept whole
    table.insert(keys)
    assert table.contains(keys).all() and table.stash
    table = line_dedup.CuckooFilter.sized(3000)
    table.insert(keys)
    table = line_dedup.CuckooFilter.of(table.row(0))
    table.delete(keys[:1500])
    assert table.contains(keys[1500:]).all() and table.contains(keys[:1500]).mean() < 0.01


# ---- chat ----

def test_chat_round_trip_of_control_strings(spark):
    rng = random.Random(2)
    bits = ["<|", "<\\|", "<\\\\|", "[INST]", "[/INST]", "<<SYS>>", "</s>", "<s>", "|>", "\\", "<", "[", "end|>\n", "é", "🙂", "ok", ""]
    turns = []
    for conv in range(60):
        for turn in range(rng.randint(1, 12)):
            turns.append((conv, turn, rng.choice(["user", "assistant", "assistant", "<|end|>", None]),
                          rng.choice(["".join(rng.choices(bits, k=rng.randint(0, 8))), None])))
    turns += [(None, None, "user", "a"), (99, 0, "assistant", "x"), (99, 0, "assistant", "x")]
    turns += [(100, i, "assistant" if i % 3 else "user", f"turn {i} <|") for i in range(1500)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    done = chat.format_conversations(df).withColumns({
        "turns": chat.read_turns(F.col("formatted")), "loss": chat.masked_text(F.col("formatted"), F.col("loss_spans"))})
    for r in done.collect():
        own = sorted([(t if t is not None else -1, role or "", text or "") for c, t, role, text in turns if c == r["conv_id"]])
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(x[1], x[2]) for x in own]
        assert r["loss"] == "".join(x[2] for x in own if x[1] == "assistant")
        assert r["n_blocks"] == 1 + sum(a[1] != b[1] for a, b in zip(own, own[1:]))


# ---- WARC ----

def test_warc_files_hold_frames_that_validate(spark, tmp_path):
    import zstandard

    body = "<html>" + "word " * 400
    pages = [(i, f"http://h/{i}", body + str(i % 7)) for i in range(60)]
    pages += [(None, None, None), (90, "http://x/\r\nA: b", "é漢"), (91, None, ""), (91, None, ""), (92, None, "q" * 3_000_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    manifest = warc.write_archives(df.repartition(3), f"file://{tmp_path}/out")
    got = warc.read_archives(manifest).collect()
    assert len(got) == len(pages) == sum(r["records"] for r in manifest.collect())
    html = {p[0]: (p[2] or "").encode() for p in pages}
    first = {}
    for i in sorted(html, key=lambda i: (i is None, i)):
        first.setdefault(html[i], i)
    for r in got:
        keeper = first[html[r["page_id"]]]
        assert r["payload_digest"] == warc.digest(html[r["page_id"]]) and r["payload_bytes"] == len(html[r["page_id"]])
        assert (r["record_type"], r["refers_to"]) == (("response", None) if keeper == r["page_id"] else ("revisit", keeper))
        assert r["payload"] == (html[r["page_id"]] if keeper == r["page_id"] else None)
    path = manifest.first()["path"].removeprefix("file://")
    data = open(path, "rb").read()
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_FRAME
    import io
    with pytest.raises((warc.Broken, zstandard.ZstdError)):
        list(warc.frames(io.BytesIO(data[:-5])))


def test_warc_records_with_wrong_fields_are_refused():
    good = warc.record(1, "http://a/", b"payload", None)
    assert warc.parsed(good)["payload"] == b"payload"
    for bad in (good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"payload", b"pbyload", 1), good[:-1], good + b"x",
                good.replace(b"WARC-Date", b"Date"), good.replace(b"\r\nContent-Length: ", b"\r\nContent-Length: 1", 1)):
        with pytest.raises(warc.Broken):
            warc.parsed(bad)


# ---- decontamination ----

def test_windows_in_blocks_equal_one_block_and_spans_go(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 12, 25])))) for i in range(12, 40)]
    items = [(i, t) for i, t in items if len(t.split()) > 1]
    docs = [(i, " ".join(rng.choices(words, k=60)) + ". " + rng.choice(items)[1].upper() + "! tail é") for i in range(30)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    one = rows_of(decontam.report(d, b))
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 300)
    assert rows_of(decontam.report(d, b)) == one
    monkeypatch.undo()
    left = {r["doc_id"]: r["text"] for r in decontam.remove_spans(d, b).collect()}
    hit = {r["doc_id"]: (r["n_words"], r["n_hit"]) for r in decontam.report(d, b).collect()}
    for i, text in left.items():
        assert len(text.split(" ")) and len(re.findall(r"[0-9A-Za-zé]+", text)) == hit[i][0] - hit[i][1]
    kept = {r["doc_id"] for r in decontam.remove_documents(d, b).collect()}
    assert kept == {i for i, (_, n) in hit.items() if n == 0}


# ---- near duplicates ----

def multiset(text):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute_classes(docs, alike):
    parent = {i: i for i, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {i: multiset(t) for i, t in docs}
    for (a, _), (b, _) in combinations(docs, 2):
        if sets[a] and sets[b] and alike(sets[a], sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i, _ in docs}


def weighted(a, b):
    return sum((a & b).values()) / sum((a | b).values()) >= 0.8


def near_docs():
    rng = random.Random(7)
    words = [f"v{i}" for i in range(400)]
    docs = []
    for group in range(12):
        base = rng.choices(words, k=rng.choice([3, 6, 40, 120, 400]))
        for copy in range(rng.choice([1, 2, 6, 25])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                text[rng.randrange(len(text))] = rng.choice(words)
            docs.append(" ".join(text) + rng.choice(["", ".", "!!"]))
    docs += ["", None, "...", "", "the the the the the the the " * 20, "the the the the the the the " * 19]
    rng.shuffle(docs)
    return list(enumerate(docs))


def test_near_duplicate_classes_by_brute_force(spark):
    docs = near_docs()
    want = brute_classes(docs, weighted)
    got = {r["doc_id"]: r["class_id"] for r in near_dup.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want
    kept = {r["doc_id"] for r in near_dup.keep_first(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert kept == set(want.values())


def test_sketches_of_documents_that_meet_no_other_do_not_move(spark, monkeypatch):
    words = lambda n, seed: " ".join(f"w{seed}x{i}" for i in range(n))
    docs = [(i, words(60, i)) for i in range(30)] + [(40, words(200, 99)), (41, words(199, 99)), (42, words(60, 3)), (43, words(50, 77)), (43, words(50, 78))]
    kept, plain = {}, near_dup.store

    def store(df, name):
        kept.setdefault(name, []).append(plain(df, name))
        return kept[name][-1]

    monkeypatch.setattr(near_dup, "store", store)
    got = near_dup.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == {i: {41: 40, 42: 3}.get(i, i) for i, _ in docs} and len(got) == len(docs)
    assert sorted(r["id"] for t in kept["near-nodes"] for r in t.collect()) == [40, 41]


def test_near_duplicates_of_the_tables_by_brute_force(spark, duck):
    docs = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    got = {r["doc_id"]: r["class_id"] for r in QUERIES["op6_near_dup"](spark, FOLDER).collect()}
    assert got == brute_classes(docs, weighted)


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(5)
    keys = near_dup.mix(np.arange(300, dtype=np.uint64))
    a, b = rng.integers(1, 9, 300).astype(float), rng.integers(1, 9, 300).astype(float)
    real = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    shares = []
    for turn in range(20):
        k = near_dup.mix(keys + np.uint64(turn * 1000))
        s = near_dup.signatures(np.concatenate([k, k]), np.concatenate([a, b]), np.repeat([0, 1], 300), 2)
        shares.append((s[0] == s[1]).mean())
    assert abs(np.mean(shares) - real) < 0.03


def test_components_of_chains_and_stars(spark):
    rng = random.Random(9)
    ids = rng.sample(range(1000), 200)
    links = list(zip(ids[:60], ids[1:61])) + [(ids[70], x) for x in ids[71:120]] + [(x, x) for x in ids[150:152]]
    got = {r["id"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{x: min(ids[:61]) for x in ids[:61]}, **{x: min(ids[70:120]) for x in ids[70:120]}}


# ---- toxicity ----

def test_toxicity_held_out_accuracy_and_places(spark, duck):
    rng = random.Random(1)
    plain, bad = [f"n{i}" for i in range(300)], ["grook", "snarf", "blegh"]
    docs, labels = [], []
    for i in range(1500):
        sentences = [" ".join(rng.choices(plain, k=8)) for _ in range(rng.choice([1, 5, 60]))]
        toxic = int(i % 6 == 0)
        if toxic:
            at = rng.randrange(len(sentences))
            sentences[at] += " " + rng.choice(bad) + rng.choice(["", "ing", "ed"])
        docs.append((i, ". ".join(sentences)))
        labels.append((i, 1, toxic))
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.report(d, y).collect()
    held = [r for r in got if r["held_out"]]
    assert 200 < len(held) < 400
    assert np.mean([r["predicted"] == labels[r["doc_id"]][2] for r in held]) > 0.97
    found = [(r["doc_id"], r["offending"]) for r in held if labels[r["doc_id"]][2] and r["predicted"]]
    right = sum(any(b in docs[i][1].split(". ")[s] for b in bad for s in places) for i, places in found)
    assert right >= 0.95 * len(found)


def test_noisy_or():
    assert toxicity.noisy_or([]) == 0.0
    p = [0.2, 0.5, 0.01]
    assert math.isclose(toxicity.noisy_or([math.log(x / (1 - x)) for x in p]), 1 - 0.8 * 0.5 * 0.99)


# ---- passages ----

def test_passages_are_found_inside_lines_and_clean_documents_stay(spark):
    rng = random.Random(6)
    words = [f"u{i}" for i in range(3000)]
    prose = lambda n: ". ".join(" ".join(rng.choices(words, k=rng.randint(4, 14))) for _ in range(n))
    shared = [prose(9) + "." for _ in range(3)]
    docs = []
    for i in range(60):
        text = prose(6) + " and " + (shared[i % 3] + " then " if i < 24 else "") + prose(6)
        docs.append((i, text))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r for r in substring_dedup.report(df).collect()}
    assert set(got) == set(range(24))
    assert all((got[i]["removed_words"] == 0) == (i < 3) for i in got)
    left = {r["doc_id"]: r["text"] for r in substring_dedup.remove(df).collect()}
    for i, text in docs:
        if 3 <= i < 24:
            assert 0.5 * len(shared[i % 3]) < len(text) - len(left[i]) <= len(shared[i % 3]) + 60
        else:
            assert left[i] == text


def test_near_paragraph_classes_by_brute_force(spark):
    rng = random.Random(8)
    words = [f"u{i}" for i in range(500)]
    texts = []
    for group in range(30):
        base = rng.choices(words, k=24)
        for copy in range(rng.choice([1, 3, 8])):
            text = list(base)
            if copy:
                text[rng.choice([0, 1, 22, 23])] = rng.choice(words)
            texts.append(" ".join(text) + ".")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = substring_dedup.named(docs).groupBy("fp").agg(F.min("doc").alias("keeper"), *[F.min(k).alias(k) for k in substring_dedup.KEYS])
    labels = {r["id"]: r["label"] for r in substring_dedup.near_classes(nodes.cache(), docs).collect()}
    name = [substring_dedup.name_of(t[:-1].encode().split()) for t in texts]
    unlike = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.8
    want = brute_classes(list(enumerate(texts)), unlike)
    groups = lambda of: {frozenset(i for i in range(len(texts)) if of(i) == c) for c in {of(i) for i in range(len(texts))}}
    assert groups(lambda i: labels.get(name[i], name[i])) == groups(lambda i: want[i])


def test_short_passages_at_any_offset_are_found_with_an_edit(spark):
    rng = random.Random(12)
    words = [f"u{i}" for i in range(3000)]
    prose = lambda n: rng.choices(words, k=n)
    dotted = lambda ws: "".join(w + (". " if rng.random() < 0.1 else " ") for w in ws)
    docs, where = [], {}
    for case in range(120):
        size, edits = rng.choice([(51, 0), (51, 1), (55, 1), (60, 1), (60, 2)])
        passage = prose(size)
        copy = list(passage)
        for at in {0: [], 1: [rng.randrange(8, size - 8)], 2: [rng.randrange(9, 25), rng.randrange(34, 51)]}[edits]:
            copy[at] = "edited"
        for doc, said in ((2 * case, passage), (2 * case + 1, copy)):
            head = dotted(prose(rng.randint(0, 80)))
            text = dotted(said)
            docs.append((doc, head + text + dotted(prose(rng.randint(0, 80)))))
            where[doc] = (len(head), len(head) + len(text.rstrip(". ")))
    docs += [(1000 + i, dotted(prose(200))) for i in range(40)]
    got = {r["doc_id"]: r for r in substring_dedup.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert set(got) == set(where)
    for doc, (start, end) in where.items():
        spans = [s.split(":") for s in got[doc]["spans"].split(",")]
        assert len(spans) == 1 and spans[0][2] == ("removed" if doc % 2 else "kept")
        assert got[doc]["kept_in"] == [doc - doc % 2]
        assert abs(int(spans[0][0]) - start) <= 2 and abs(int(spans[0][1]) - end) <= 2


def test_every_run_of_equal_words_has_an_anchor():
    rng = random.Random(13)
    prose = lambda n: [b"w%d" % rng.randrange(300) for _ in range(n)]
    hashes = near_dup.WordHashes()
    size = substring_dedup.WINDOW + substring_dedup.SPREAD - 1
    for _ in range(100):
        run, found = prose(size), []
        for _ in range(2):
            names, inside, _ = substring_dedup.window_hashes([prose(rng.randrange(9)), prose(rng.randrange(50)) + run + prose(30)], hashes)
            found.append(set(names[substring_dedup.anchors(names, inside)].tolist()))
        own, _, _ = substring_dedup.window_hashes([run], hashes)
        assert set(own.tolist()) & found[0] & found[1]


def test_pairs_that_share_one_band_of_a_mixed_bucket_are_compared(spark):
    rng = random.Random(21)
    words = [f"u{i}" for i in range(500)]
    base = rng.choices(words, k=20)
    near = [*base[:-1], "other"]
    name = lambda w: substring_dedup.name_of([x.encode() for x in w])
    strange = next(w for w in iter(lambda: rng.choices(words, k=20), None) if name(w) < min(name(base), name(near)))
    texts = [strange, base, near]
    docs = spark.createDataFrame([(i, " ".join(w) + ".") for i, w in enumerate(texts)], "doc_id long, text string")
    # all three meet in the first band only, around the unlike one
    rows = [(name(w), i, *[7 if band == 0 else 100 * i + band for band in range(substring_dedup.BANDS)]) for i, w in enumerate(texts)]
    nodes = spark.createDataFrame(rows, ", ".join(["fp long", "keeper long", *[f"{k} long" for k in substring_dedup.KEYS]]))
    labels = {r["id"]: r["label"] for r in substring_dedup.near_classes(nodes, docs).collect()}
    assert labels == dict.fromkeys([name(base), name(near)], min(name(base), name(near)))
    sketches = substring_dedup.named(docs).select("fp", *substring_dedup.SKETCH)
    again = substring_dedup.near_classes(nodes.join(sketches, "fp"), docs)
    assert {r["id"]: r["label"] for r in again.collect()} == labels


# ---- pieces ----

def test_pieces_equal_the_library_and_decode_losslessly():
    import sentencepiece

    model = open(pieces.VOCABULARY, "rb").read()
    vocab, library = pieces.vocabulary(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    rng = random.Random(3)
    texts = ["", " ", "Hello  world\n\tfoo é漢🙂 ", "a" * 200 + " " * 70, "▁x ▁▁", "<0x0A> <s>", "\x00\x01"]
    texts += ["".join(rng.choices("the and ing é漢\n.,  12▁", k=rng.randint(1, 90))) for _ in range(200)]
    raw, names = [t.encode() for t in texts], [str(i) for i in range(len(texts))]
    seen = []
    for seed, rate in ((1, 0.0), (1, 0.3), (1, 0.3), (2, 0.3)):
        ids, sizes = pieces.encode_texts(vocab, raw, names, seed, rate)
        own = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
        assert [pieces.decode_ids(vocab, x) for x in own] == raw
        lists = pa.array([None, *own, []], pa.list_(pa.int32()))
        assert pieces.decode_lists(vocab, lists) == [b"", *raw, b""]
        assert pieces.decode_lists(vocab, lists.slice(3, 5)) == raw[2:7]
        if rate == 0:
            assert all(x == library.encode(t) for x, t in zip(own, texts, strict=True) if "▁" not in t)
        seen.append(own)
    assert seen[1] == seen[2] and seen[1] != seen[3] and seen[0] != seen[1]


def test_arrays_and_heap_segment_alike():
    vocab = pieces.vocabulary(open(pieces.VOCABULARY, "rb").read())
    rng = random.Random(4)
    chunks = ["▁" * rng.randint(0, 3) + "".join(rng.choices("thingoner漢é", k=rng.randint(1, 20))) for _ in range(300)]
    keys = near_dup.mix(np.arange(len(chunks), dtype=np.uint64))
    for rate in (0.0, 0.1, 0.7, 1.0):
        flat, first, sizes = pieces.segment(vocab, chunks, keys, rate)
        got = [flat[a:a + n].tolist() for a, n in zip(first, sizes, strict=True)]
        assert got == [pieces.segment_long(vocab, c, int(k), rate) for c, k in zip(chunks, keys, strict=True)]


def test_each_occurrence_has_its_own_dropout():
    vocab = pieces.vocabulary(open(pieces.VOCABULARY, "rb").read())
    text = " ".join(["the"] * 4000 + ["international"] * 4000)
    whole = pieces.encode_texts(vocab, [text.encode()], ["7"], 5, 0.1)[0].tolist()
    assert pieces.decode_ids(vocab, whole) == text.encode()
    spelled = [bytes(vocab.bytes_of[i]) for i in whole]
    groups = []
    for piece in spelled:
        if piece.startswith(b" "):
            groups.append([])
        groups[-1].append(piece)
    ways = [len({tuple(g) for g in groups if b"".join(g) == word}) for word in (b" the", b" international")]
    assert ways[1] > 16
    # each occurrence by itself gives the same pieces
    rng = random.Random(4)
    words = ["the", "international", "ing", "a", "é漢", "unbelievable", "x" * 40]
    chunks = [pieces.MARK + rng.choice(words) for _ in range(600)]
    start = np.uint64(pieces.xxhash.xxh64_intdigest(b"9", 3))
    keys = pieces.mix(start + pieces.mix(np.arange(600, dtype=np.uint64)))
    want = [x for c, k in zip(chunks, keys.tolist()) for x in pieces.segment_long(vocab, c, k, 0.3)]
    got = pieces.encode_texts(vocab, ["".join(chunks)[1:].replace(pieces.MARK, " ").encode()], ["9"], 3, 0.3)[0].tolist()
    assert got == want
    # a word of one candidate is split at the rate
    pair = next(n for n in vocab.ids if len(n) == 2 and n[0] == pieces.MARK != n[1] and vocab.candidates(n).shape[1] == 1)
    ids, _ = pieces.encode_texts(vocab, [" ".join([pair[1]] * 40000).encode()], ["1"], 5, 0.1)
    assert abs((len(ids) - 40000) / 40000 - 0.1) < 0.01


def test_piece_report_is_lossless(spark):
    assert {r["lossless"] for r in QUERIES["op9_pieces"](spark, FOLDER).collect()} == {True}


# ---- quality ----

def test_frequent_lines_of_a_host_deplete_documents(spark):
    line = "This very line stands in most documents of the host"
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    docs = [(i, f"{line}\n{line} \n{own(i)}" if i < 50 else own(i), "h" if i < 60 else "k") for i in range(100)]
    docs += [(200 + i, f"{line}\n{line}\n{line}\nand " + " ".join(f"q{i}x{j}" for j in range(3)), "h") for i in range(5)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality.apply_rules(df).collect()}
    assert all(got[i]["n_lines_removed"] == (2 if i < 50 else 0) for i in range(100))
    assert all(got[i]["kept"] for i in range(100)) and not any(got[200 + i]["kept"] for i in range(5))
    frequent = quality.frequent_lines(quality.measured(df))
    left = {r["doc_id"]: r["text"] for r in quality.remove_lines(df, frequent).collect()}
    assert left[3] == own(3) and left[99] == own(99)


# ---- the pipeline ----

def test_pipeline_runs_and_tolerates_odd_rows(spark, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path)
    odd(spark, clash=True).withColumn("doc_id", F.coalesce("doc_id", F.lit(50))).write.parquet(f"{folder}/documents.parquet")
    labels_of(spark).write.parquet(f"{folder}/labels.parquet")
    bench_of(spark, ((1, "nothing like it"),)).write.parquet(f"{folder}/benchmark.parquet")
    got = corpus_pipeline.run(spark, folder).collect()
    assert got and all(r["lossless"] for r in got)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, FOLDER)
        if name != "pieces":
            assert docs.columns == before.columns
    assert 0 < docs.count() < before.count() + 1


def test_digest_of_items():
    assert decontam.items_digest(["2", "10"]) == hashlib.sha256(b"10,2").hexdigest()
