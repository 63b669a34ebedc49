"""Personal data: patterns propose spans, checksums confirm them, context words move the score.

DataFrame functions only. Offsets count code points, ends are exclusive.

Defined cases: a null or empty text has no spans; repeated rows and repeated ids are scored
row by row; other columns pass through unless named like an output; texts of any length are
scanned whole, every pattern in linear time (a match starts where its run starts, or where the
match before ended; account numbers are tried on at most 64 code points from each head); of
overlapping matches of a kind the first one stays; an empty table has no row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import running_sums

#: Code points on either side of a match, up to the next match of its kind, searched for context words.
CONTEXT = 40
#: A span is kept from this score on.
THRESHOLD = 0.5


@dataclass(frozen=True)
class Kind:
    """A kind of span. Score: ``prior``, plus ``checked`` where its validator confirms the
    match, plus ``context`` where one of the ``words`` stands near. ``required`` kinds drop
    matches that their validator rejects; ``alone`` ones need a non-alphanumeric neighbour. Where there is
    a ``body``, ``pattern`` matches only the head, its first group is the body and what follows it, and
    the longest valid beginning of the body is the span."""

    name: str
    pattern: str
    hint: str | None
    prior: float
    checked: float
    context: float
    words: str
    alone: bool = False
    body: str | None = None


LOCAL, DOMAIN = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
#: The four base kinds in the order of the result (patterns are fixed values; possessive
#: repeats and the run starts change no match). Their prior alone reaches the threshold.
BASE = (
    Kind("email", rf"(?:(?<!{LOCAL})|\G){LOCAL}++@{DOMAIN}++(?:\.{DOMAIN}++)++", "@", 0.9, 0.0, 0.1,
         "mail|contact|write"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", ".", 0.5, 0.2, 0.3, "ip|host|server|address"),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])", None, 0.5, 0.4, 0.1,
         "card|visa|credit|payment"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", 0.5, 0.2, 0.3, "phone|tel|call|mobile|fax"),
)
#: What the method adds: these need a checksum or a context word.
ADDED = (
    Kind("iban", r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+[\s\S]{0,41}))[A-Z]{2}[0-9]{2}", None, 0.1, 0.6, 0.3,
         "iban|account|bank", True, r"^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+"),
    Kind("short_card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,14}+(?![ -]?[0-9])", None, 0.0, 0.3, 0.4,
         "card|visa|credit|payment", True),
    Kind("ssn", r"(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])", "-", 0.3, 0.0, 0.4, "ssn|social|security", True),
)


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn checksum of a string of digits."""
    def step(s, c):
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.struct((s["sum"] + F.when(s["odd"], twice).otherwise(d)).alias("sum"), (~s["odd"]).alias("odd"))

    start = F.struct(F.lit(0).alias("sum"), F.lit(False).alias("odd"))
    return F.aggregate(F.split(F.reverse(digits), ""), start, step, lambda s: s["sum"] % 10 == 0)


def mod97(account: Column) -> Column:
    """ISO 7064 mod 97-10 of an account number, spaces ignored."""
    bare = F.regexp_replace(account, " ", "")
    turned = F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))

    def step(r, c):
        n = F.ascii(c)
        return F.when(n >= 65, (r * 100 + n - 55) % 97).otherwise((r * 10 + n - 48) % 97).cast("int")

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def valid_length(body: str, tail: Column) -> Column:
    """The length of the longest beginning of ``tail`` that is a whole, confirmed account number, or null."""
    most = F.length(F.regexp_extract(tail, body, 0))
    return F.array_max(F.filter(F.sequence(F.lit(15), F.greatest(most, F.lit(15))), lambda n: (
        (n <= most) & tail.substr(n, F.lit(2)).rlike("^[A-Z0-9](?![A-Za-z0-9])")
        & (F.length(F.regexp_replace(tail.substr(F.lit(1), n), " ", "")) >= 15) & mod97(tail.substr(F.lit(1), n)))))


def grown(spans: Column, tails: Column, kind: Kind) -> Column:
    """Spans of heads made as long as their valid bodies; of overlapping ones the first stays.
    ``tails`` are the texts from each head on, so no text is walked through per span."""
    sized = F.zip_with(spans, tails, lambda s, t: F.struct(s.alias("s"), t.alias("t"), valid_length(kind.body, t).alias("n")))
    long = F.transform(F.filter(sized, lambda x: x["n"].isNotNull()), lambda x: F.struct(
        x["s"]["kind"].alias("kind"), x["s"]["start"].alias("start"), (x["s"]["start"] + x["n"]).alias("end"),
        x["t"].substr(F.lit(1), x["n"]).alias("m"), x["s"]["before"].alias("before"),
        x["t"].substr(x["n"] + 1, F.lit(CONTEXT)).alias("after")))
    none = F.filter(long, lambda s: F.lit(False))
    return F.aggregate(long, F.struct(none.alias("kept"), F.lit(0).alias("end")), lambda k, s: F.when(
        k["end"] > s["start"], k).otherwise(F.struct(F.concat(k["kept"], F.array(s)).alias("kept"), s["end"].alias("end"))),
        lambda k: k["kept"])


def small_part(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+", "")
    return (F.length(bare) <= 3) & (F.concat(F.lit("0"), F.substring(bare, 1, 3)).cast("int") <= 255)


def valid(kind: str, text: Column) -> Column:
    digits = digits_of(text)
    return {
        "email": lambda: F.lit(True),
        "ip": lambda: F.forall(F.split(text, r"\."), small_part),
        "card": lambda: F.length(digits).between(16, 19) & luhn(digits),
        "phone": lambda: F.length(digits).between(8, 15),
        "short_card": lambda: F.length(digits).between(13, 15) & luhn(digits),
        "ssn": lambda: ~text.rlike("^(000|666|9)"),
    }[kind]()


def detect(docs: DataFrame, text: str = "text", output: str = "pii") -> DataFrame:
    """Add ``output``, an array of (kind, start, end, score), by kind as listed above, then start."""
    kinds = BASE + ADDED
    whole = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<string>")

    def found(kind: Kind) -> Column:
        matches = F.regexp_extract_all(whole, F.lit(kind.pattern), F.lit(0))
        return matches if kind.hint is None else F.when(F.contains(whole, F.lit(kind.hint)), matches).otherwise(none)

    def gaps(kind: Kind) -> Column:
        at = F.col(f"_match_{kind.name}")
        return F.when(F.size(at) > 0, F.split(whole, kind.pattern, -1)).otherwise(none)

    def located(kind: Kind) -> Column:
        match, gap = F.col(f"_match_{kind.name}"), F.col(f"_gap_{kind.name}")
        before = F.slice(gap, F.lit(1), F.size(match))
        after = F.slice(gap, F.lit(2), F.size(match))
        pieces = F.zip_with(match, before, lambda m, g: F.struct(m.alias("m"), g.alias("before")))
        pieces = F.zip_with(pieces, after, lambda p, g: F.struct(
            p["m"].alias("m"), F.substring(p["before"], -CONTEXT, CONTEXT).alias("before"),
            F.substring(g, 1, CONTEXT).alias("after")))
        ends = running_sums(F.zip_with(match, before, lambda m, g: F.length(m) + F.length(g)))
        spans = F.zip_with(pieces, ends, lambda p, e: F.struct(
            F.lit(kind.name).alias("kind"), (e - F.length(p["m"])).alias("start"), e.alias("end"),
            p["m"].alias("m"), p["before"].alias("before"), p["after"].alias("after")))
        spans = grown(spans, F.col(f"_tail_{kind.name}"), kind) if kind.body else F.filter(spans, lambda s: valid(kind.name, s["m"]))
        if kind.alone:
            spans = F.filter(spans, lambda s: ~s["before"].rlike("[A-Za-z0-9]$") & ~s["after"].rlike("^[A-Za-z0-9]"))
        near = lambda s: F.lower(F.concat_ws(" ", s["before"], s["after"])).rlike(kind.words)
        return F.transform(spans, lambda s: F.struct(
            s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
            F.round(F.lit(kind.prior + kind.checked) + F.when(near(s), kind.context).otherwise(0.0), 2).alias("score")))

    empty = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    kept = [c for c in docs.columns if c != output]
    out = docs.withColumns({f"_match_{k.name}": found(k) for k in kinds})
    out = out.withColumns({f"_gap_{k.name}": gaps(k) for k in kinds})
    out = out.withColumns({f"_tail_{k.name}": F.regexp_extract_all(whole, F.lit(k.pattern), F.lit(1)) for k in kinds if k.body})
    per_kind = [F.when(F.size(f"_match_{k.name}") > 0, located(k)).otherwise(empty) for k in kinds]
    spans = F.filter(F.concat(*per_kind), lambda s: s["score"] >= THRESHOLD)
    return out.select(*kept, spans.alias(output))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """Per document: the counts of the base kinds, a digest of the base spans, all spans and their scores."""
    found = detect(docs.select("doc_id", "text"))
    names = [k.name for k in BASE]
    of = lambda name: F.filter("pii", lambda s: s["kind"] == name)
    base = F.filter("pii", lambda s: s["kind"].isin(names))
    return found.select(
        "doc_id", *[F.size(of(n)).cast("long").alias(f"n_{n}") for n in names],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda s: s["score"].cast("string")), ",").alias("scores"))
