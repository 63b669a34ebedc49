"""Chat formatting as a relation: sorted turn structs, merged, concatenated by Spark expressions.

The template writes each run of turns of one role as one block::

    <|start|>ROLE<|says|>TEXT<|and|>TEXT<|end|>

(and a line end), so the turns of a merged block can be told apart again. Control strings inside
roles and texts are escaped by one more backslash after their first sign, which is undone exactly.
The loss mask is the list of code point spans that hold assistant texts.

Turns are sorted and merged first per TURNS turn numbers, then per conversation, so no task sorts
a long conversation at once; the formatted conversation itself is one value.

Defined cases: null texts and roles are empty; null turns come first; equal turn numbers are
ordered by role and text, and all stay; a null conv_id is a conversation; an empty table has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import running_sums

TURNS = 512
#: The template (fixed values of this format).
START, SAYS, AND, END = "<|start|>", "<|says|>", "<|and|>", "<|end|>\n"
#: What follows the first sign of a control string of common chat templates: <| <s> </s> [INST] [/INST] <<SYS>> <</SYS>>.
CONTROL = r"\||/?s>|/?INST\]|</?SYS>>"
LEARNED = "assistant"
BLOCKS = "array<struct<role:string,texts:array<string>>>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)(?={CONTROL})", r"$1$2\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)\\(?={CONTROL})", "$1$2")


def merged(left: Column, right: Column) -> Column:
    """Two lists of blocks in a row; blocks of one role that meet become one."""
    last, first = F.element_at(left, -1), F.get(right, F.lit(0))
    joint = F.array(F.struct(last["role"].alias("role"), F.concat(last["texts"], first["texts"]).alias("texts")))
    some = (F.size(left) > 0) & (F.size(right) > 0)
    return F.when(some & (F.get(left, F.size(left) - 1)["role"] == first["role"]), F.concat(
        F.slice(left, F.lit(1), F.size(left) - 1), joint, F.slice(right, F.lit(2), F.greatest(F.size(right) - 1, F.lit(0))))
    ).otherwise(F.concat(left, right))


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans, n_blocks) from rows of (conv_id, turn, role, text)."""
    empty = F.array().cast(BLOCKS)
    rows = turns.select("conv_id", F.floor(F.col("turn") / TURNS).alias("part"), F.struct(
        F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    single = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.array(
        F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts"))))
    parts = rows.groupBy("conv_id", "part").agg(single.alias("turns"))
    parts = parts.select("conv_id", F.struct("part", F.aggregate("turns", empty, merged).alias("blocks")).alias("p"))
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list("p")).alias("parts"))
    blocks = whole.select("conv_id", F.aggregate("parts", empty, lambda s, p: merged(s, p["blocks"])).alias("blocks"))
    safe = blocks.select("conv_id", F.transform("blocks", lambda b: F.struct(
        escaped(b["role"]).alias("role"), (b["role"] == LEARNED).alias("loss"),
        F.transform(b["texts"], escaped).alias("texts"))).alias("blocks"))
    formatted = F.array_join(F.transform("blocks", lambda b: F.concat(
        F.lit(START), b["role"], F.lit(SAYS), F.array_join(b["texts"], AND), F.lit(END))), "")
    # lengths of what stands before each text, of the text, and of the end, block by block
    head = lambda b: F.length(b["role"]) + len(START) + len(SAYS)
    piece = lambda size, loss: F.struct(size.cast("int").alias("size"), loss.alias("loss"))
    pieces = F.flatten(F.transform("blocks", lambda b: F.concat(
        F.flatten(F.transform(b["texts"], lambda t, i: F.array(
            piece(F.when(i == 0, head(b)).otherwise(F.lit(len(AND))), F.lit(False)), piece(F.length(t), b["loss"])))),
        F.array(piece(F.lit(len(END)), F.lit(False))))))
    out = safe.select("conv_id", formatted.alias("formatted"), pieces.alias("pieces"), F.size("blocks").cast("long").alias("n_blocks"))
    ends = running_sums(F.transform("pieces", lambda p: p["size"]))
    spans = F.zip_with("pieces", ends, lambda p, e: F.struct(
        (e - p["size"]).alias("start"), e.alias("end"), p["loss"].alias("loss")))
    return out.select("conv_id", "formatted", F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"))).alias("loss_spans"), "n_blocks")


def read_turns(formatted: Column) -> Column:
    """The array of (role, text) that a formatted conversation holds."""
    body = lambda b: F.substring(b, F.length(F.substring_index(b, SAYS, 1)) + len(SAYS) + 1,
                                 F.length(b) - F.length(F.substring_index(b, SAYS, 1)) - len(SAYS) - len(END))
    blocks = F.filter(F.split(formatted, r"<\|start\|>"), lambda b: b != "")
    return F.flatten(F.transform(blocks, lambda b: F.transform(F.split(body(b), r"<\|and\|>"), lambda t: F.struct(
        unescaped(F.substring_index(b, SAYS, 1)).alias("role"), unescaped(t).alias("text")))))


def masked_text(formatted: Column, spans: Column, group: int = 64) -> Column:
    """The text under the mask, unescaped. Groups of spans are cut out first, as a span's place in
    a string is found by walking to it."""
    groups = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(spans), F.lit(1)), F.lit(group)),
                                  lambda at: F.slice(spans, at, F.lit(group))), lambda g: F.size(g) > 0)

    def cut(g: Column) -> Column:
        first, last = F.get(g, F.lit(0))["start"], F.get(g, F.size(g) - 1)["end"]
        part = F.array(F.substring(formatted, first + 1, last - first))
        return F.get(F.transform(part, lambda p: F.array_join(F.transform(g, lambda s: unescaped(
            F.substring(p, s["start"] - first + 1, s["end"] - s["start"]))), "")), F.lit(0))

    return F.array_join(F.transform(groups, cut), "")


def report(turns: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted text and its mask: turns, masked text, lengths."""
    done = format_conversations(turns).withColumns({
        "turns": read_turns(F.col("formatted")), "loss": masked_text(F.col("formatted"), F.col("loss_spans"))})
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(listed, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "n_blocks")
