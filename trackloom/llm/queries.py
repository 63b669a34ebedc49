"""Named queries of the text operators with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import (
    chat, decontam, filter_audit, line_dedup, multi_index, near_dup, periodic, pieces, pii, quality, substring_dedup, toxicity, warc)
from trackloom.llm.common import read_table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


SPACES = r"[\x20\x09-\x0D]+"
STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
LUHN = f"""list_sum([CASE WHEN i % 2 = 1 THEN v WHEN v > 4 THEN 2 * v - 9 ELSE 2 * v END
    for v, i in list_transform(string_split(reverse({DIGITS}), ''), lambda x: CAST(x AS INT))]) % 10 = 0"""
MOD97 = """list_reduce(list_concat([CAST(0 AS BIGINT)], list_transform(string_split(
    substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4), ''),
    lambda c: CAST(ascii(c) - CASE WHEN ascii(c) >= 65 THEN 55 ELSE 48 END AS BIGINT))),
    lambda a, d: CASE WHEN d > 9 THEN (a * 100 + d) % 97 ELSE (a * 10 + d) % 97 END) = 1"""
#: kind: the plain pattern, what makes a match a candidate, what makes a candidate valid.
PII_SQL = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true", "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "true",
           "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 "
           "OR TRY_CAST(p AS HUGEINT) > 255)) = 0"),
    "card": (r"[0-9]([\x20-]?[0-9])+", f"length({DIGITS}) BETWEEN 16 AND 19", LUHN),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "true", f"length({DIGITS}) BETWEEN 8 AND 15"),
    "iban": (r"(?:^|[^A-Za-z0-9])[A-Z]{2}[0-9]{2}", "true", "true"),
    "short_card": (r"[0-9]([\x20-]?[0-9])+", f"length({DIGITS}) BETWEEN 13 AND 15", LUHN),
    "ssn": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "NOT regexp_matches(p, '[0-9]$') AND NOT regexp_matches(n, '^[0-9]')",
            "NOT regexp_matches(m, '^(000|666|9)')"),
}


#: Whether the first n characters of ``tail`` are a confirmed account number that ends there.
ACCOUNT = f"""regexp_matches(substr(tail, n, 2), '^[A-Z0-9]([^A-Za-z0-9]|$)') AND length(replace(substr(tail, 1, n), ' ', '')) >= 15
    AND {MOD97.replace("replace(m,", "replace(substr(tail, 1, n),")}"""
def accounts_sql(at: int, kind: pii.Kind, heads: str) -> str:
    """Heads with the longest confirmed beginning of their bodies; of overlapping ones the first."""
    return f"""
        SELECT id, k, kind, s, e, round(prior + CASE WHEN regexp_matches(lower(before || ' ' || after), words) THEN context ELSE 0 END, 2) AS score
        FROM (SELECT *, s + n AS e, substr(tail, n + 1, {pii.CONTEXT}) AS after, max(s + n) OVER (PARTITION BY id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past
            FROM (SELECT *, list_max(list_filter(range(15, length(regexp_extract(tail, '^[A-Z]{{2}}[0-9]{{2}}( ?[A-Z0-9]){{11,30}}')) + 1), lambda n: {ACCOUNT})) AS n
                FROM (SELECT id, t, {at} AS k, 'iban' AS kind, {kind.prior + kind.checked} AS prior, {kind.context} AS context, '{kind.words}' AS words, e - 4 AS s, substr(t, e - 3, 105) AS tail,
                    substr(t, greatest(e - 4 - {pii.CONTEXT}, before_at) + 1, e - 4 - greatest(e - 4 - {pii.CONTEXT}, before_at)) AS before FROM ({heads})))
            WHERE n IS NOT NULL)
        WHERE (past IS NULL OR past <= s) AND NOT regexp_matches(after, '^[A-Za-z0-9]')"""


def pii_sql() -> str:
    parts = []
    for at, kind in enumerate(pii.BASE + pii.ADDED):
        pattern, candidate, ok = PII_SQL[kind.name]
        if kind.body:
            heads = f"""SELECT *, coalesce(lag(e) OVER (PARTITION BY id ORDER BY s), 0) AS before_at FROM (SELECT id, t, CAST(list_sum(list_transform(g[1:i], lambda x: length(x)))
                + coalesce(list_sum(list_transform(m[1:i], lambda x: length(x))), 0) AS BIGINT) AS e, e - 4 AS s
                FROM (SELECT id, t, regexp_extract_all(t, '{pattern}') AS m, regexp_split_to_array(t, '{pattern}') AS g FROM d), unnest(range(1, len(m) + 1)) u(i))"""
            parts.append(accounts_sql(at, kind, heads))
            continue
        alone = "NOT regexp_matches(before, '[A-Za-z0-9]$') AND NOT regexp_matches(after, '^[A-Za-z0-9]')"
        parts.append(f"""
        SELECT id, {at} AS k, '{kind.name}' AS kind, s, e, round({kind.prior + kind.checked} + CASE WHEN
            regexp_matches(lower(before || ' ' || after), '{kind.words}') THEN {kind.context} ELSE 0 END, 2) AS score
        FROM (SELECT *, substr(t, greatest(s - {pii.CONTEXT}, before_at) + 1, s - greatest(s - {pii.CONTEXT}, before_at))
                AS before, substr(t, e + 1, least({pii.CONTEXT}, after_at - e)) AS after
            FROM (SELECT *, coalesce(lag(e) OVER w, 0) AS before_at, coalesce(lead(s) OVER w, length(t)) AS after_at
                FROM (SELECT *, substr(t, s, 1) AS p, substr(t, e + 1, 1) AS n FROM (SELECT id, t, m[i] AS m,
                        CAST(list_sum(list_transform(g[1:i], lambda x: length(x)))
                            + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s,
                        s + length(m[i]) AS e
                    FROM (SELECT id, t, regexp_extract_all(t, '{pattern}') AS m, regexp_split_to_array(t, '{pattern}') AS g
                        FROM d), unnest(range(1, len(m) + 1)) u(i)))
                WHERE {candidate} WINDOW w AS (PARTITION BY id ORDER BY s)))
        WHERE {ok}{' AND ' + alone if kind.alone else ''}""")
    names = [k.name for k in pii.BASE]
    count = ", ".join(f"count(*) FILTER (kind = '{n}') AS n_{n}" for n in names)
    return f"""
    WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
    f AS (SELECT *, kind || ':' || s || ':' || e AS span FROM ({' UNION ALL '.join(parts)}) WHERE score >= {pii.THRESHOLD})
    SELECT doc_id, {count}, sha256(coalesce(string_agg(span, ',' ORDER BY k, s) FILTER (k < {len(names)}), '')) AS base_sha256,
        coalesce(string_agg(span, ',' ORDER BY k, s), '') AS spans,
        coalesce(string_agg(CAST(score AS VARCHAR), ',' ORDER BY k, s), '') AS scores
    FROM d LEFT JOIN f USING (id) GROUP BY id, doc_id"""


@query("op1_pii", pii_sql())
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return pii.report(read_table(spark, folder, "documents"))


QUALITY_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, source, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACES}'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {STRIP}) <> '') AS l FROM documents),
wins AS (SELECT id, i, array_to_string(w[i:i+7], ' ') AS k FROM d, unnest(range(1, greatest(len(w) - 6, 1))) u(i)),
dups AS (SELECT id, i FROM wins QUALIFY count(*) OVER (PARTITION BY id, k) > 1),
reps AS (SELECT id, CAST(sum(c) AS BIGINT) AS n FROM (SELECT id, least(8, coalesce(lead(i) OVER (PARTITION BY id ORDER BY i) - i, 8)) AS c
    FROM dups) GROUP BY id),
lines AS (SELECT id, source, lower(trim(x, {STRIP})) AS k, length(trim(x, {STRIP})) AS c FROM d, unnest(l) u(x)),
hosts AS (SELECT source, count(*) AS n FROM d GROUP BY source),
freq AS (SELECT lines.source, k FROM lines JOIN hosts ON lines.source IS NOT DISTINCT FROM hosts.source
    GROUP BY lines.source, k, n HAVING count(DISTINCT id) > {quality.LINE_DOCUMENTS} AND count(DISTINCT id) > {quality.LINE_SHARE} * n),
cut AS (SELECT id, sum(c) AS total, sum(c) FILTER (freq.k IS NOT NULL) AS gone, count(freq.k) AS n
    FROM lines LEFT JOIN freq ON lines.source IS NOT DISTINCT FROM freq.source AND lines.k = freq.k GROUP BY id)
SELECT doc_id, len(w) AS n_words, coalesce(CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT), 0) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(reps.n, 0) AS n_repeat_words,
    coalesce(cut.n, 0) AS n_lines_removed,
    (len(w) < {quality.MIN_WORDS} OR 100 * coalesce(reps.n, 0) > {quality.REPEAT_PERCENT} * len(w)) AS base_failed,
    NOT base_failed AND coalesce(gone, 0) <= {quality.DEPLETED_SHARE} * greatest(coalesce(total, 0), 1) AS kept
FROM d LEFT JOIN reps USING (id) LEFT JOIN cut USING (id)"""


@query("op10_quality", QUALITY_SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return quality.apply_rules(read_table(spark, folder, "documents"))


LINES_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT id, doc_id, i, l[i] AS line, translate(trim(l[i], {STRIP}),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM d, unnest(range(1, len(l) + 1)) u(i)),
heavy AS (SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= {line_dedup.MIN_CHARS} GROUP BY k
    HAVING count(DISTINCT id) >= {line_dedup.MIN_DOCS})
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(keeper) FILTER (keeper <> doc_id) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM lines LEFT JOIN heavy USING (k) GROUP BY id"""


@query("op2_lines", LINES_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.report(read_table(spark, folder, "documents"))


@query("op6_near_dup")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.report(read_table(spark, folder, "documents"))


WORDS_SQL = """list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"""
BENCH_SQL = f"""
WITH items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {WORDS_SQL} AS w FROM benchmark),
wins AS (SELECT DISTINCT item, least(len(w), {decontam.WINDOW}) AS size, array_to_string(w[i:i + least(len(w), {decontam.WINDOW}) - 1], ' ') AS k
    FROM items, unnest(range(1, greatest(len(w) - {decontam.WINDOW} + 2, 2))) u(i) WHERE len(w) > 0),
d AS (SELECT row_number() OVER () AS id, doc_id, {WORDS_SQL} AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM wins),
grams AS (SELECT id, i, size, array_to_string(w[i:i + size - 1], ' ') AS k FROM d, sizes, unnest(range(1, greatest(len(w) - size + 2, 1))) u(i)),
hits AS (SELECT id, i, size, item FROM grams JOIN wins USING (size, k)),
words AS (SELECT id, count(DISTINCT j) AS n FROM hits, unnest(range(i, i + size)) u(j) GROUP BY id),
found AS (SELECT id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT id, item FROM hits) GROUP BY id)
SELECT doc_id, len(w) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (id) LEFT JOIN found USING (id)"""


@query("op5_decontamination", BENCH_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.report(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


@query("op7_toxicity")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.report(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


CONTROL = r"[<\[](\\*)(\||/?s>|/?INST\]|</?SYS>>)"
CHAT_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
r AS (SELECT *, row_number() OVER w AS i, lag(role) OVER w IS DISTINCT FROM role AS opens FROM t
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = '{chat.LEARNED}'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = '{chat.LEARNED}'), '')) AS loss_sha256,
    CAST(sum(length(text) + len(regexp_extract_all(text, '{CONTROL}')) + CASE WHEN opens THEN
        {len(chat.START + chat.SAYS + chat.END)} + length(role) + len(regexp_extract_all(role, '{CONTROL}'))
        ELSE {len(chat.AND)} END) AS BIGINT) AS formatted_chars,
    count(*) FILTER (opens) AS n_blocks
FROM r GROUP BY conv_id"""


@query("op3_chat", CHAT_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    turns = read_table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]").alias("text")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(
        F.col("id") == 0, "user").otherwise("assistant").alias("role"), said)
    return chat.report(turns.unionByName(more))


BITS = "array_to_string(list_transform(string_split(sha1(h), ''), lambda x: lpad(CAST(bin(('0x' || x)::INT) AS VARCHAR), 4, '0')), '')"
BASE32 = """array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
    + 16 * CAST(substr(bits, 5 * k + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * k + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * k + 3, 1) AS INT)
    + 2 * CAST(substr(bits, 5 * k + 4, 1) AS INT) + CAST(substr(bits, 5 * k + 5, 1) AS INT), 1)), '')"""
WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h) AS payload_bytes, {BITS} AS bits, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, {BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to FROM q"""


@query("op4_warc", WARC_SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return warc.report(read_table(spark, folder, "pages"))


@query("op9_pieces")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.report(read_table(spark, folder, "documents"))


@query("op8_passages")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.report(read_table(spark, folder, "documents"))


#: Every order of the filters applied row by row to the counts of failed subsets.
AUDIT_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACES}'), lambda x: x <> '') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, (len(w) < 200) AS a, (100 * len(list_distinct(w)) < 50 * len(w)) AS b,
    (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t)) AS c,
    regexp_matches(t, '[#$%&*|]') AS d, coalesce(d.doc_id > least, false) AS e, coalesce(quality = 1, false) AS good,
    coalesce(toxic = 1, false) AS bad FROM d JOIN firsts USING (t) LEFT JOIN l USING (doc_id)),
g AS (SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END
    || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS fails, count(*) AS n,
    count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM m GROUP BY ALL),
o AS (SELECT '' AS o UNION ALL SELECT o || x FROM o, unnest(['A', 'B', 'C', 'D', 'E']) u(x) WHERE NOT contains(o, x)),
s AS (SELECT o AS filter_order, step, substr(o, step, 1) AS x, substr(o, 1, step - 1) AS past FROM o, unnest(range(1, 6)) u(step)
    WHERE length(o) = 5),
r AS (SELECT part, filter_order, step, x, n, good, bad, fails, contains(fails, x) AS hit,
    (past <> '' AND regexp_matches(fails, '[' || CASE past WHEN '' THEN '-' ELSE past END || ']')) AS gone FROM g, s),
f AS (SELECT part, filter_order, CAST(step AS INT) AS step, x, coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0) AS kept,
    coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (hit AND gone), 0) AS redundant,
    coalesce(sum(n) FILTER (fails = x), 0) AS unique_fails, coalesce(sum(good) FILTER (hit AND NOT gone), 0) AS good_lost,
    coalesce(sum(bad) FILTER (hit AND NOT gone), 0) AS toxic_lost FROM r GROUP BY part, filter_order, step, x)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
    CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM f"""


@query("op11_filter_audit", AUDIT_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.report(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


@query("op12_periodic_runs")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return periodic.report(read_table(spark, folder, "documents"))


@query("op13_neighbours")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return multi_index.report(read_table(spark, folder, "embeddings"))
