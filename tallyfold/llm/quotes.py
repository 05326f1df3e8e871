"""Quotation linking: nested quotes of messages, the messages they come from, and reply order.

Lines that begin with quote marks form passages, runs of one quote level. Their normalised lines
are hashed and linked to the latest earlier message of the conversation that says the line itself; a
passage comes from the message that most of its lines are linked to. A message replies to
the source of its outermost linked passage. Only conversations with quotes are taken apart, links
are one ordered pass per line hash instead of pairs, and reply chains are shortened by pointer
jumping, so neither long conversations nor lines that everyone repeats gather in one task as pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import pick, saved

MARKS = r"^\s*(?:>\s?)+"
#: Lines that announce a quote, in four languages.
ANNOUNCES = r"(?i)^.{0,200}\b(?:wrote|a écrit|schrieb|escribió)\s*:\s*$"


def normalised(line: Column) -> Column:
    """Lower case, one space for white space, nothing but letters and digits at the ends."""
    text = F.regexp_replace(F.lower(line), r"\s+", " ")
    return F.regexp_replace(text, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), r"[^>]", ""))


def own_text(text: Column) -> Column:
    """The text without quoted lines and the lines that announce them; texts without quotes as they are."""
    lines = F.split(text, "\r?\n")
    kept = F.filter(
        lines,
        lambda x, i: ~x.rlike(MARKS) & ~(x.rlike(ANNOUNCES) & F.coalesce(F.get(lines, i + 1).rlike(MARKS), F.lit(False))),
    )
    rest = F.regexp_replace(F.array_join(kept, "\n"), r"^\s+|\s+$", "")
    return F.when(text.rlike("(?m)" + MARKS), rest).otherwise(text)


def passages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, passage, level, source, lines, linked: each quoted passage and where it comes from.

    ``source`` is the turn most of the passage's lines are linked to, the latest of equals, null
    where no earlier message says any of them. Lines without letters or digits are not linked.
    Messages that repeat conv_id and turn count as one; rows with a null in either have no passages.
    """
    rows = pick(messages, "conv_id", "turn", "text").where("conv_id is not null and turn is not null and text is not null")
    quoting = rows.where(F.col("text").rlike("(?m)" + MARKS)).select("conv_id").distinct()
    told = rows.join(quoting, "conv_id", "left_semi").distinct()
    lines = told.select("conv_id", "turn", F.xxhash64("text").alias("copy"), F.posexplode(F.split("text", "\r?\n")).alias("at", "line"))
    lines = lines.select("conv_id", "turn", "copy", "at", level(F.col("line")).alias("level"), normalised(F.regexp_replace("line", MARKS, "")).alias("said"))
    inside = Window.partitionBy("conv_id", "turn", "copy").orderBy("at")
    turned = F.when(F.col("level") != F.coalesce(F.lag("level").over(inside), F.lit(-1)), 1).otherwise(0)
    lines = lines.withColumn("turned", turned).withColumn("passage", F.sum("turned").over(inside))
    # Each line in the order of turns: quoted ones look back to the latest own line of the same words.
    seen = Window.partitionBy("conv_id", "hash").orderBy("turn", F.col("level") == 0).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hashed = lines.where("said <> ''").withColumn("hash", F.sha2("said", 256))
    linked = hashed.withColumn("from", F.last(F.when(F.col("level") == 0, F.col("turn")), ignorenulls=True).over(seen)).where("level > 0")
    votes = linked.groupBy("conv_id", "turn", "copy", "passage", "level", "from").agg(F.count("*").alias("n"))
    best = votes.groupBy("conv_id", "turn", "copy", "passage", "level").agg(
        F.max(F.when(F.col("from").isNotNull(), F.struct("n", "from"))).alias("best"), F.sum("n").alias("lines")
    )
    return best.select(
        "conv_id", "turn", "passage", "level", F.col("best.from").alias("source"), "lines", F.coalesce("best.n", F.lit(0)).cast("long").alias("linked")
    )


def replies(found: DataFrame) -> DataFrame:
    """conv_id, turn, parent, root, depth of the messages that reply to another."""
    w = Window.partitionBy("conv_id", "turn").orderBy("level", F.desc("linked"), F.desc("source"))
    first = found.where("source is not null").withColumn("k", F.row_number().over(w)).where("k = 1")
    state = saved(first.select("conv_id", "turn", F.col("source").alias("parent"), F.col("source").alias("root"), F.lit(1).cast("long").alias("depth")), "replies")
    while True:
        # Parents are earlier turns, so the jumps end; each doubles the length that is known.
        ahead = state.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        new = saved(state.join(ahead, ["conv_id", "root"], "left"), "replies")
        if not new.where("next is not null").limit(1).count():
            return state
        state = new.select(
            "conv_id", "turn", "parent", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")
        )


def reply_ordered(messages: DataFrame) -> DataFrame:
    """Per message: conv_id, turn, role, text (without quotes), n_quotes, n_linked, parent_turn, thread_turn, depth, position.

    Threads begin at messages that reply to none; ordering a conversation by thread_turn and
    position gives each reply after what it answers. One row for each row of ``messages``;
    rows that share conv_id and turn share their links. Null text stays null; rows with a null
    conv_id or turn are threads of their own. Other columns are ignored; no messages give no rows.
    """
    found = saved(passages(messages), "passages")
    counts = found.groupBy("conv_id", "turn").agg(F.count("*").alias("n_quotes"), F.count("source").alias("n_linked"))
    links = replies(found)
    rows = pick(messages, "conv_id", "turn", "role", "text").withColumn("text", own_text(F.col("text")))
    full = rows.join(counts, ["conv_id", "turn"], "left").join(links, ["conv_id", "turn"], "left")
    full = full.select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.col("parent").alias("parent_turn"),
        F.coalesce("root", "turn").alias("thread_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
    )
    # Replies come after what they answer, as turns rise along each chain.
    order = Window.partitionBy("conv_id", "thread_turn").orderBy("turn", "role", "text")
    return full.withColumn("position", F.row_number().over(order).cast("long"))
