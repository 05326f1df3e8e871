"""Turn positions, items and residency spans from a session log.

Everything is ordered by line number. One scan per session gives each row the number of turns
and compactions before it; that count is the forward as-of (the next turn pays) and the
backward as-of (the boundary turn of a compaction), so neither needs a range join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfold.plans import scan

SESSION_TURN = ["session_id", "turn_index"]
SESSION_ITEM = ["session_id", "item_id"]


def _one(flag: str) -> Column:
    return F.col(flag).cast("int").cast("bigint")


PLACED = ["turns_before", "comps_before", "n_turns", "n_comps", "prev_model"]


def place(log: DataFrame) -> DataFrame:
    """Log rows with the turns and compactions before them, session totals and the last model.

    A binding that counted them while it numbered the lines hands them in as they are.
    """
    if set(PLACED) <= set(log.columns):
        return log
    return scan.scan_session(
        log,
        ["session_id"],
        "line",
        counts={"turns_before": _one("is_turn"), "comps_before": _one("is_compaction")},
        totals={"n_turns": _one("is_turn"), "n_comps": _one("is_compaction")},
        lasts={"prev_model": F.col("model")},
    )


NOT_OF_TURN = [
    "is_turn", "is_injection", "is_change", "is_compaction", "item_id", "kind", "identity", "category",
    "size_tokens", "basis", "confidence", "cause", "pinned", "trigger", "tier", "detail",
    "pre_tokens", "post_tokens", "cumulative_tokens",
]


def turns(placed: DataFrame) -> DataFrame:
    return (
        placed.filter("is_turn").withColumn("turn_index", F.col("turns_before")).drop(*NOT_OF_TURN)
    )


def injections(placed: DataFrame) -> DataFrame:
    """Injections that some turn pays for; one after the last turn is never paid and is dropped."""
    return (
        placed.filter(F.col("is_injection") & (F.col("turns_before") < F.col("n_turns")))
        .withColumn("turn_index", F.col("turns_before"))
        .withColumn("comp_index", F.col("comps_before"))
    )


def compactions(placed: DataFrame) -> DataFrame:
    """Compactions with the turn they close after; 0 when no turn came before."""
    return (
        placed.filter(F.col("is_compaction") & (F.col("n_turns") > 0))
        .withColumn("comp_index", F.col("comps_before"))
        .withColumn("boundary_turn", F.greatest(F.col("turns_before") - 1, F.lit(0)))
    )


def items(inj: DataFrame) -> DataFrame:
    """One row per (session, item): the largest size, with the attributes of its first record."""
    record = F.struct("kind", "identity", "category", "size_tokens", "basis", "confidence")
    best = F.max_by(record, F.struct(F.col("size_tokens"), -F.col("line")))
    return (
        inj.groupBy(*SESSION_ITEM)
        .agg(
            best.alias("best"),
            F.count(F.lit(1)).alias("loads"),
            F.min(F.when(F.col("turn_index") == 0, F.col("line"))).alias("zero_line"),
            F.min(F.when(F.col("pinned"), F.col("comp_index"))).alias("pinned_from"),
        )
        .select(*SESSION_ITEM, "best.*", "loads", "zero_line", "pinned_from")
    )


def survivor_runs(survivors: DataFrame) -> DataFrame:
    """(session, item, comp_index) survivals -> the last compaction of each unbroken run."""
    over = W.partitionBy(*SESSION_ITEM).orderBy("comp_index")
    grouped = survivors.select(*SESSION_ITEM, "comp_index").distinct().withColumn(
        "island", F.col("comp_index") - F.row_number().over(over)
    )
    ends = W.partitionBy(*SESSION_ITEM, "island")
    return grouped.withColumn("run_end", F.max("comp_index").over(ends)).drop("island")


def preserved_items(inj: DataFrame, preserved: DataFrame) -> DataFrame:
    """Items that survive a compaction: one of their earlier injections is in its preserved list."""
    hit = inj.select("session_id", "item_id", F.col("uuid"), F.col("comp_index").alias("from_index"))
    return (
        preserved.join(hit, ["session_id", "uuid"], "inner")
        .filter(F.col("from_index") <= F.col("comp_index"))
        .select(*SESSION_ITEM, "comp_index")
        .distinct()
    )


def spans(
    inj: DataFrame, item_rows: DataFrame, comps: DataFrame, survivors: DataFrame | None = None
) -> DataFrame:
    """Islands of residency: injections up to the first compaction that evicts the item.

    Injections of an item between two compactions share their fate, so they are folded first;
    an item kept by its pinned injection survives every later compaction, and listed survivals
    are followed to the end of their run. Zero-length spans are kept.
    """
    folded = inj.groupBy(*SESSION_ITEM, "comp_index").agg(
        F.min("line").alias("opened_line"),
        F.min("turn_index").alias("first_turn"),
        F.count(F.lit(1)).alias("injections"),
        F.min_by("uuid", "line").alias("opened_uuid"),
        F.max("n_turns").alias("n_turns"),
        F.max("n_comps").alias("n_comps"),
    )
    candidate = F.col("comp_index")
    if survivors is not None:
        folded = folded.join(survivor_runs(survivors), [*SESSION_ITEM, "comp_index"], "left")
        candidate = F.coalesce(F.col("run_end") + 1, candidate)
    kept = F.coalesce(F.col("pinned_from") <= F.col("comp_index"), F.lit(False))
    evict = F.when(~kept & (candidate < F.col("n_comps")), candidate)
    fated = folded.join(item_rows, SESSION_ITEM, "inner").withColumn("evict_index", evict)
    carried = ["kind", "identity", "category", "size_tokens", "zero_line", "n_turns"]
    opened = fated.groupBy(*SESSION_ITEM, "evict_index").agg(
        F.min("opened_line").alias("opened_line"),
        F.min("first_turn").alias("first_turn"),
        F.sum("injections").alias("injections"),
        F.min_by("opened_uuid", "opened_line").alias("opened_uuid"),
        *[F.any_value(c).alias(c) for c in carried],
    )
    ends = comps.select(
        "session_id", F.col("comp_index").alias("evict_index"), F.col("boundary_turn").alias("last_turn")
    )
    end = F.coalesce(F.col("last_turn"), F.col("n_turns") - 1)
    return opened.join(ends, ["session_id", "evict_index"], "left").select(
        *SESSION_ITEM,
        "first_turn",
        "last_turn",
        F.when(F.col("evict_index").isNull(), "session_end").otherwise("evicted").alias("end_reason"),
        end.alias("end_turn"),
        F.greatest(F.lit(0), end - F.col("first_turn") + 1).alias("turns_held"),
        (end < F.col("first_turn")).alias("empty_span"),
        "opened_line",
        "opened_uuid",
        "injections",
        "zero_line",
        "kind",
        "identity",
        "category",
        "size_tokens",
        "n_turns",
    )


def held(span_rows: DataFrame) -> DataFrame:
    """Spans that hold some turn, with the first and last of their turns in ``start`` and ``end_turn``.

    Two spans of an item can only meet on turn 0 (a compaction before any turn); the later one
    then starts at turn 1, so their turns are unique without a distinct.
    """
    start = F.when(
        (F.col("first_turn") == 0) & (F.col("opened_line") > F.col("zero_line")), F.lit(1).cast("bigint")
    ).otherwise(F.col("first_turn"))
    return span_rows.withColumn("start", start).filter(F.col("end_turn") >= F.col("start"))


def resident(span_rows: DataFrame) -> DataFrame:
    """One row per (session, turn, item) in which the item was resident."""
    return held(span_rows).select(
        *SESSION_ITEM,
        "kind",
        "identity",
        "category",
        "size_tokens",
        "opened_line",
        "first_turn",
        F.explode(F.sequence("start", "end_turn")).alias("turn_index"),
    )
