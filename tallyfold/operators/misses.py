"""Cache misses by cause, each with its sentence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.functions import fixed
from tallyfold.operators.residency import SESSION_TURN

COLUMNS = [*SESSION_TURN, "item_id", "cause", "detail", "confidence"]


def ineligible(book: DataFrame) -> DataFrame:
    """Resident items below the minimum, on every turn they were held."""
    text = F.concat(
        F.col("size_tokens").cast("string"), F.lit(" tokens is below the "), F.col("t.threshold").cast("string"),
        F.lit("-token minimum cacheable prefix on "), F.col("t.model"), F.lit(" — billed at full rate every turn"),
    )
    return book.filter((F.col("row") == "res") & (F.col("lane") == "uncached")).select(
        *SESSION_TURN, "item_id", F.lit("never_eligible").alias("cause"), text.alias("detail"),
        F.col("lane_confidence").alias("confidence"),
    )


def invalidated(book: DataFrame) -> DataFrame:
    return book.filter((F.col("row") == "res") & (F.col("lane_reason") == "reload_forced")).select(
        *SESSION_TURN, "item_id", F.lit("invalidated").alias("cause"), F.col("t.detail").alias("detail"),
        F.col("lane_confidence").alias("confidence"),
    )


def evicted(span_rows: DataFrame) -> DataFrame:
    return span_rows.filter(F.col("end_reason") == "evicted").select(
        "session_id", F.col("last_turn").cast("bigint").alias("turn_index"), "item_id", F.lit("evicted").alias("cause"),
        F.lit("left the conversation at a compaction boundary").alias("detail"), F.lit("high").alias("confidence"),
    )


def lookback(book: DataFrame, boundaries: DataFrame, limit: int = fixed.MAX_LOOKBACK_BLOCKS) -> DataFrame:
    """Carried items on a turn without reads that added more blocks than a breakpoint looks back."""
    n = F.col("n_injections").cast("string")
    text = F.concat(
        n, F.lit(f" content blocks were added, past the {limit}-block lookback a cache breakpoint walks"
                 " — the prior entry could not be found"),
    )
    quiet = (
        (F.col("row") == "res") & (F.col("turn_index") > 0) & F.col("t.trigger").isNull()
        & (F.col("t.read_tokens") == 0) & (F.col("n_injections") > limit)
        & (F.col("first_turn") < F.col("turn_index"))
    )
    return book.filter(quiet).join(boundaries.select(*SESSION_TURN), SESSION_TURN, "left_anti").select(
        *SESSION_TURN, "item_id", F.lit("lookback_miss").alias("cause"), text.alias("detail"),
        F.lit("low").alias("confidence"),
    )


def all_misses(book: DataFrame, span_rows: DataFrame, boundaries: DataFrame, limit: int) -> DataFrame:
    return (
        ineligible(book).unionByName(invalidated(book)).unionByName(evicted(span_rows))
        .unionByName(lookback(book, boundaries, limit))
    )


def by_cause(misses: DataFrame) -> DataFrame:
    """Counts over the four causes, zero counts included."""
    counts = misses.agg(*[F.count_if(F.col("cause") == c).alias(c) for c in fixed.MISS_CAUSES])
    rows = F.array(*[F.struct(F.lit(c).alias("cause"), F.col(c).alias("misses")) for c in fixed.MISS_CAUSES])
    return counts.select(F.explode(rows).alias("r")).select("r.*")
