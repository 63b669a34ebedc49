"""Filter audit, periodic runs and the multi-index against brute force."""

import hashlib
import random
import zlib
from itertools import permutations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_text_queries import CLASH, LONG, ODD, SHAPE, labels_of, odd
from trackloom.llm import filter_audit, multi_index, periodic
from trackloom.llm.queries import QUERIES

# ---- filter audit ----


def fails(text, ids_of, doc_id):
    words = [w for w in (text or "").encode().split()]
    t = text or ""
    out = set()
    out |= {"A"} if len(words) < 200 else set()
    out |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
    out |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t) else set()
    out |= {"D"} if set(t) & set("#$%&*|") else set()
    out |= {"E"} if doc_id is not None and any(i < doc_id for i in ids_of.get(t, ())) else set()
    return out


def brute_audit(docs, labels):
    ids_of = {}
    for i, t, _ in docs:
        if i is not None:
            ids_of.setdefault(t or "", []).append(i)
    marks = {}
    for i, quality, toxic in labels:
        q, x = marks.get(i, (0, 0))
        marks[i] = (max(q, quality or 0), max(x, toxic or 0))
    rows = [(s or "", fails(t, ids_of, i), marks.get(i, (0, 0)) if i is not None else (0, 0)) for i, t, s in docs]
    out, removed_by = {}, {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            alive = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in alive if f in r[1]]
                kept = [r for r in alive if f not in r[1]]
                bad = [r for r in mine if f in r[1]]
                out[part, "".join(order), step] = [
                    len(kept), len(gone), len(bad) - len(gone), sum(r[1] == {f} for r in mine),
                    sum(r[2][0] for r in gone), sum(r[2][1] for r in gone)]
                removed_by[part, f] = removed_by.get((part, f), 0) + len(gone)
                alive = kept
    return {k: (*v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit_rows(df):
    return {(r["part"], r["filter_order"], r["step"]): (
        r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"])
        for r in df.collect()}


def test_audit_by_brute_force(spark):
    rng = random.Random(4)
    bits = ["word ", "Big ", "x# ", "漢字 ", "\x1cz ", "q\x85r "]
    texts = ["".join(rng.choice(bits[:rng.randint(1, 6)]) + f"w{rng.randint(0, rng.choice([3, 900]))} " for _ in range(rng.randint(0, 260)))
             for _ in range(40)] + [None, ""]
    docs = [(rng.choice([i, i, i // 2, None]), rng.choice(texts), rng.choice(["a", "b", None, ""])) for i in range(150)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 150, 2)] + [(4, 1, 1), (None, 1, 1)]
    got = audit_rows(filter_audit.report(spark.createDataFrame(docs, "doc_id long, text string, source string"),
                                         spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert got == brute_audit(docs, labels)


def test_path_counts_cover_all_orders():
    forward, backward = filter_audit.path_counts(5)
    assert forward[-1] == backward[0] == 120
    for size in range(5):
        assert sum(p for s, _, p in filter_audit.edge_list(5) if bin(s).count("1") == size) == 120


# ---- periodic runs ----


def brute_runs(words, least):
    out = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def test_all_short_words_have_their_runs():
    for letters, longest in (2, 10), (3, 7):
        for n in range(1, longest + 1):
            for word in product(range(letters), repeat=n):
                assert [tuple(r) for r in periodic.find_runs(np.array(word), 2).tolist()] == brute_runs(word, 2), word


def repetitive(rng, depth):
    if not depth:
        return [rng.randrange(3) for _ in range(rng.randint(1, 5))]
    base, out = repetitive(rng, depth - 1), []
    for _ in range(rng.randint(1, 3)):
        out += rng.choice([base * rng.randint(1, 4), base[:rng.randint(0, len(base))], repetitive(rng, depth - 1)])
    return out


def test_nested_repetitions_have_their_runs():
    rng = random.Random(8)
    for _ in range(600):
        word = repetitive(rng, rng.randint(1, 4))[:300]
        for least in (2, 12):
            assert [tuple(r) for r in periodic.find_runs(np.array(word), least).tolist()] == brute_runs(word, least), word


def brute_report(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words, 12)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_of_documents_by_brute_force(spark):
    from tests.conftest import FOLDER

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("length(text) < 6000")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: tuple(r)[1:8] for r in periodic.report(docs).collect()}
    assert got == {i: brute_report(i, t) for i, t in texts.items()}
    assert sum(v[0] > 0 for v in got.values()) > 10
    assert QUERIES["op12_periodic_runs"](spark, FOLDER).count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()


def test_runs_and_collapsed_texts(spark):
    docs = spark.createDataFrame([(1, "a b " * 6 + "c"), (2, "x " * 11), (3, "é " * 12), (4, None)], "doc_id long, text string")
    runs = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in periodic.detect(docs).collect()}
    assert runs == {1: [(0, 12, 2)], 2: [], 3: [(0, 12, 1)], 4: []}
    texts = {r["doc_id"]: r["collapsed"] for r in periodic.collapse(docs).collect()}
    assert texts == {1: "a b c", 2: " ".join("x" * 11), 3: "é", 4: ""}


# ---- nearest neighbours ----


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def brute_nearest(rows, k):
    rows = [(i, v) for i, v in rows if i is not None and v]
    out = set()
    for q, x in rows:
        if q % 20 == 0:
            scored = []
            for i, y in rows:
                if i != q:
                    total = 0.0
                    for a, b in zip(x, y, strict=True):
                        total += a * b
                    scored.append((-total, i))
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)}
    return out


def test_few_vectors_ties_and_copies_are_exact(spark):
    rng = random.Random(2)
    rows = [(i, [float(rng.randint(-1, 1)) for _ in range(4)] or None) for i in range(300)]
    rows = [(i, v if any(v) else [1.0, 0.0, 0.0, 0.0]) for i, v in rows] + [(i, [1.0, 2.0, 0.0, -1.0]) for i in range(300, 420)]
    bad = [(None, [1.0] * 4), (1000, None), (1020, []), (1040, [0.0] * 4), (1060, [1.0, None, 0.0, 0.0]),
           (1080, [float("nan")] * 4), (1100, [float("inf"), 0.0, 0.0, 0.0]), (1120, [1.0, 2.0])]
    got = {tuple(r) for r in multi_index.report(table(spark, rows + bad + rows[:7])).collect()}
    want = brute_nearest(rows, 20)
    assert {r[0] for r in got} == {r[0] for r in want}
    assert len(got & want) >= 0.9 * len(want)
    few = rows[:15]
    assert {tuple(r) for r in multi_index.report(table(spark, few)).collect()} == brute_nearest(few, 20)


def test_no_vectors(spark):
    assert multi_index.report(table(spark, [])).collect() == []
    assert multi_index.report(table(spark, [(1, [1.0])])).collect() == []
    assert multi_index.report(table(spark, [(20, [1.0])])).collect() == []


def test_one_component_and_clashing_columns(spark):
    rows = [(i, [float(i + 1)]) for i in range(60)]
    wide = table(spark, rows).withColumns({c: F.lit("clash") for c in ["id", "vector", "ids", "cell", "score", "rank", "h1", *CLASH]})
    assert {tuple(r) for r in multi_index.report(wide).collect()} == brute_nearest(rows, 20)


@pytest.mark.parametrize("structured", [True, False])
def test_recall_and_regions(spark, monkeypatch, structured):
    monkeypatch.setattr(multi_index, "REGION_ROWS", 200)
    monkeypatch.setattr(multi_index, "QUERY_ROWS", 50)
    rng = np.random.default_rng(1)
    points = rng.normal(size=(4000, 16))
    if structured:
        points = rng.normal(size=(60, 16))[rng.integers(0, 60, 4000)] * 4 + 0.3 * points
    visited = []
    plain = multi_index.visits_needed
    monkeypatch.setattr(multi_index, "visits_needed", lambda *a: visited.append(plain(*a)) or visited[-1])
    got = {}
    for r in multi_index.report(table(spark, list(enumerate(points.tolist())))).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    found = 0
    for q in range(0, 4000, 20):
        scores = points @ points[q]
        scores[q] = -np.inf
        found += len(got[q] & set(np.argsort(-scores)[:20].tolist()))
    assert found / 4000 >= 0.9
    assert not structured or visited[0] < 1200


def test_cells_are_visited_by_distance():
    rng = np.random.default_rng(3)
    books = [rng.normal(size=(5, 3)), rng.normal(size=(4, 2))]
    sizes = rng.integers(0, 3, 20)
    query = rng.normal(size=5)
    total = {c: -(books[0][c // 4] @ query[:3]) - books[1][c % 4] @ query[3:] for c in range(20) if sizes[c]}
    assert multi_index.visit(query, books, sizes, 1000) == sorted(total, key=total.get)


def test_large_cells_are_cut():
    sizes = np.array([10, 20_000, 5, 8000, 300, 0, 100])
    first, parts = multi_index.regions_of(sizes)
    held = {}
    for cell, size in enumerate(sizes.tolist()):
        for r in range(parts[cell]):
            held.setdefault(int(first[cell]) + r, []).append(-(-size // int(parts[cell])))
    assert all(sum(v) <= multi_index.REGION_ROWS for v in held.values()) and parts[1] == 3


# ---- odd tables ----

OPERATORS = {
    "audit": lambda s, d: filter_audit.report(d, labels_of(s)), "runs": lambda s, d: periodic.detect(d),
    "collapse": lambda s, d: periodic.collapse(d), "run_report": lambda s, d: periodic.report(d)}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_odd_and_empty_tables(spark, name):
    run = OPERATORS[name]
    plain = run(spark, odd(spark)).collect()
    assert len(plain) == (len(ODD) if name != "audit" else 600 * len({r[3] or "" for r in ODD}))
    assert len(run(spark, odd(spark, clash=True)).collect()) == len(plain)
    assert run(spark, spark.createDataFrame([], SHAPE)).collect() == []


def test_very_long_texts_repeat(spark):
    docs = spark.createDataFrame([(3, LONG)], "doc_id long, text string")
    assert [tuple(x) for x in periodic.detect(docs).first()["runs"]] == [(0, 24000, 8)]


# ---- earlier operators, mended ----

IBAN, SHORT, OTHER = "DE89 3704 0044 0532 0130 00", "NO9386011117947", "GB29 NWBK 6016 1331 9268 19"


def test_account_numbers_by_sql(spark):
    import duckdb

    from trackloom.llm import pii, queries

    texts = [f"Pay {IBAN} BIC COBADEFF", f"é {IBAN} 12 times", f"{IBAN} {OTHER}", f"{SHORT} {IBAN} X bank", f"{OTHER}, {SHORT}", f"x{IBAN}",
             f"{IBAN}x", f"{IBAN[:-1]}1 BIC", IBAN, "", None, f"my account {IBAN}"]
    rows = list(enumerate(texts))
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    found = con.execute(queries.pii_sql())
    names = [c[0] for c in found.description]
    want = sorted(tuple(r[names.index(c)] for c in ("doc_id", "spans", "scores")) for r in found.fetchall())
    got = pii.report(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "spans", "scores").collect()
    assert sorted(map(tuple, got)) == want and sum("iban" in r[1] for r in want) == 7


def test_many_account_heads_take_linear_time(spark):
    import time

    from trackloom.llm import pii

    def seconds(n):
        df = spark.createDataFrame([(1, "AB12 CDEF GHIJ KLMN, " * n)], "doc_id long, text string")
        best = []
        for _ in range(2):
            start = time.time()
            assert pii.report(df).first()["spans"] == ""
            best.append(time.time() - start)
        return min(best)

    seconds(10)
    assert seconds(16_000) < 3 * seconds(4_000) + 5


def test_filters_grow_with_inserted_documents(spark, monkeypatch):
    from trackloom.llm import line_dedup

    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 64)
    rng = random.Random(3)
    line = lambda i: f"line number {i} that is long enough to be a key of its own"

    def batch(first, last, base):
        return [(base + k, "\n".join(line(i) for i in range(first, last))) for k in range(6)]

    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    rows = batch(0, 50, 0)
    index = line_dedup.LineIndex.build(frame(rows))
    shards = index.shards
    for step in range(1, 4):
        more = batch(50 * step, 50 * step + 50 * step, 100 * step)
        rows += more
        index = index.insert(frame(more))
        tables = [line_dedup.CuckooFilter.of(r) for r in index.filters.collect()]
        assert not any(t.stash for t in tables)
        assert all(np.count_nonzero(t.slots) <= line_dedup.MOST_LOAD * t.slots.size for t in tables)
    assert index.shards > shards
    fresh = line_dedup.LineIndex.build(frame(rows))
    docs = frame(rows + [(9000, "\n".join(line(rng.randrange(400)) for _ in range(30)))])
    result = lambda x: sorted(map(tuple, x.dedup(docs).select("doc_id", "text", "n_dropped").collect()))
    assert result(index) == result(fresh)


def test_large_items_are_cut_and_blocks_stay_bounded(spark, monkeypatch):
    from trackloom.llm import decontam

    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(40)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 3, 9, 10, 200])))) for i in range(30)]
    items += [items[5], (5, items[7][1]), (None, items[8][1]), (99, None)]
    docs = []
    for i in range(60):
        own = [word() for _ in range(rng.randint(0, 60))]
        source = rng.choice(items)[1] or ""
        cut = source.split()[rng.randint(0, 5):][:rng.randint(0, 40)]
        docs.append((i, " ".join(own + cut + [word() for _ in range(5)])))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(tuple, decontam.report(d, b).collect()))
    monkeypatch.setattr(decontam, "PIECE_WORDS", 16)
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 600)
    pieces, number = decontam.blocks_of(decontam.pieces_of(b))
    assert number > 3 and pieces.groupBy("block").agg(F.sum(F.octet_length("text")).alias("n")).agg(F.max("n")).first()[0] <= 600
    assert sorted(map(tuple, decontam.report(d, b).collect())) == want
