"""Quotations in conversations: linked to the messages they come from, and taken out.

A line's quote level is the number of ``>`` before its text. Neighbouring lines of one level are
a passage. Passages are normalised (gaps to one space, ASCII case folded) and hashed, whole, by
paragraph and by line, and so are the unquoted passages of every message. A quoted piece belongs to
the first message of the conversation that holds it unquoted, if that comes before the quoting
one. A message answers the message of which it quotes the most characters at its shallowest
linked level (the latest on a tie).

The result is every message without its quotes (nor the line "... wrote:" right before one), with
the turn it answers, its depth, and its thread: the first turn its answers lead back to. Rows come
ordered by conversation, thread and turn, so every message follows the one it answers; a message
that quotes nothing is a thread of its own at its turn.

All is DataFrame work. Originals are one row per piece and conversation before they are joined,
so a line that fills a conversation joins once per quotation; threads are followed by doubling;
no conversation is ever gathered, the order is a range partition over thread and turn.

Defined cases: a null text stays null and an empty one empty. Messages with a null conversation
or turn keep no links. Rows that repeat a conversation and turn are one message for links (its
first text decides nothing; pieces of all of them count). Quotes of nothing known are removed,
counted in ``quotes`` and not in ``linked``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factspan.session import stage

MARK = r"^[ \t]*>[ \t>]*"


def _levels(lines: Column) -> Column:
    """(level, text) of every line."""
    mark = lambda x: F.regexp_extract(x, f"({MARK})", 1)
    return F.transform(
        lines,
        lambda x: F.struct(
            F.length(F.regexp_replace(mark(x), "[^>]", "")).alias("level"),
            F.when(x.rlike(MARK), F.regexp_replace(x, MARK, "")).otherwise(x).alias("text"),
        ),
    )


def _passages(lines: Column) -> Column:
    """(level, lines) of the runs of equal level."""
    count = F.size(lines)
    starts = F.filter(
        F.sequence(F.lit(1), count),
        lambda i: (i == 1) | (F.element_at(lines, i)["level"] != F.try_element_at(lines, F.greatest(i - 1, F.lit(1)))["level"]),
    )
    ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(count + 1))
    return F.transform(
        starts,
        lambda s, n: F.struct(
            F.element_at(lines, s)["level"].alias("level"),
            F.transform(F.slice(lines, s, F.element_at(ends, n + 1) - s), lambda x: x["text"]).alias("lines"),
        ),
    )


def _normal(text: Column) -> Column:
    folded = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(folded, r"[ \t\r\n]+", " "))


def _pieces(lines: Column) -> Column:
    """Normalised distinct pieces of a passage: itself, its paragraphs and its lines."""
    whole = F.array_join(lines, "\n")
    parts = F.concat(F.array(whole), F.split(whole, r"\n[ \t\r]*\n"), lines)
    return F.filter(F.array_distinct(F.transform(parts, _normal)), lambda x: x != "")


def _own_text(lines: Column) -> Column:
    """Unquoted lines, without the attribution right before a quote and without blank edges."""
    count = F.size(lines)
    kept = F.filter(
        lines,
        lambda x, i: (x["level"] == 0)
        & ~(x["text"].rlike(r"wrote:[ \t\r]*$") & (F.coalesce(F.try_element_at(lines, F.least(i + 2, count))["level"], F.lit(0)) > 0)),
    )
    return F.regexp_replace(F.array_join(F.transform(kept, lambda x: x["text"]), "\n"), r"^([ \t\r]*\n)+|(\n[ \t\r]*)+$", "")


def _threads(answers: DataFrame) -> DataFrame:
    """(conv, turn, thread, depth) of answering messages, by doubling along (conv, turn, to)."""
    ahead = stage(answers.select("conv", "turn", F.col("to").alias("thread"), F.lit(1).cast("long").alias("depth")), "threads")
    while True:
        other = ahead.select(
            "conv", F.col("turn").alias("thread"), F.col("thread").alias("next"), F.col("depth").alias("more")
        )
        moved = stage(ahead.join(other, ["conv", "thread"], "left"), "threads")
        going = not moved.where("next is not null").isEmpty()
        ahead = moved.select(
            "conv", "turn", F.coalesce("next", "thread").alias("thread"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
        )
        if not going:
            return ahead


def link(
    messages: DataFrame,
    *,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """(conv_id, turn, role, text, reply_to, thread, depth, quotes, linked), one row per message."""
    cut = F.split(F.col("raw"), r"\r?\n")
    rows = messages.select(
        F.col(conversation).alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("raw")
    ).withColumn("quoting", F.col("raw").rlike(f"(?m){MARK}"))
    plain = rows.where(~F.coalesce("quoting", F.lit(False)))
    parsed = rows.where("quoting").withColumn("lines", _levels(cut))

    keyed = "conv is not null and turn is not null"
    quoted = stage(
        parsed.where(keyed)
        .select("conv", "turn", F.explode(F.filter(_passages(F.col("lines")), lambda p: p["level"] > 0)).alias("passage"))
        .select("conv", "turn", F.col("passage.level").alias("level"), F.explode(_pieces(F.col("passage.lines"))).alias("piece"))
        .select("conv", "turn", "level", F.md5("piece").alias("hash"), F.length("piece").alias("chars"))
        .distinct(),
        "quoted",
    )
    # only conversations that quote have originals to offer
    quoters = quoted.select("conv").distinct()
    blank = F.transform(cut, lambda x: F.struct(F.lit(0).alias("level"), x.alias("text")))
    offered = plain.where(keyed).withColumn("lines", blank).unionByName(parsed.where(keyed))
    originals = (
        offered.join(quoters, "conv", "left_semi")
        .select("conv", "turn", F.explode(F.filter(_passages(F.col("lines")), lambda p: p["level"] == 0)).alias("passage"))
        .select("conv", "turn", F.explode(_pieces(F.col("passage.lines"))).alias("piece"))
        .groupBy("conv", F.md5("piece").alias("hash")).agg(F.min("turn").alias("origin"))
    )
    links = stage(quoted.join(originals, ["conv", "hash"]).where("origin < turn"), "quote_links")
    weights = links.groupBy("conv", "turn", "level", "origin").agg(F.sum("chars").alias("chars"))
    best = F.max(F.struct(-F.col("level"), F.col("chars"), F.col("origin").alias("to"))).alias("best")
    answers = stage(weights.groupBy("conv", "turn").agg(best).select("conv", "turn", F.col("best.to").alias("to")), "answers")
    counted = (
        quoted.join(links.select("conv", "turn", "level", "hash", F.lit(1).alias("hit")), ["conv", "turn", "level", "hash"], "left")
        .groupBy("conv", "turn").agg(F.count("*").alias("quotes"), F.count("hit").alias("linked"))
    )
    marks = stage(
        counted.join(answers, ["conv", "turn"], "left").join(_threads(answers), ["conv", "turn"], "left"), "marks"
    ).withColumnsRenamed({"conv": "c", "turn": "t"})

    nothing = plain.select("conv", "turn", "role", F.col("raw").alias("text"))
    cleaned = parsed.select("conv", "turn", "role", _own_text(F.col("lines")).alias("text"))
    every = nothing.unionByName(cleaned).join(marks, (F.col("conv") == F.col("c")) & (F.col("turn") == F.col("t")), "left")
    zero = F.lit(0).cast("long")
    return (
        every.select(
            F.col("conv").alias("conv_id"), "turn", "role", "text", F.col("to").alias("reply_to"),
            F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", zero).alias("depth"),
            F.coalesce("quotes", zero).alias("quotes"), F.coalesce("linked", zero).alias("linked"),
        )
        .repartitionByRange("conv_id", "thread", "turn")
        .sortWithinPartitions("conv_id", "thread", "turn")
    )
