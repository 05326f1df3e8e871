"""Turn-level operators: dedup, windows of a write, parent links and session selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.plans import grouped
from tallyfold.sources.rates import CacheMultipliers


def ttl_label() -> Column:
    """5m or 1h when only that window was written, unknown for any other write, NULL for none."""
    five, hour = F.col("write_5m") > 0, F.col("write_1h") > 0
    return (
        F.when(five & ~hour, "5m")
        .when(hour & ~five, "1h")
        .when(five | hour | (F.col("write_unknown") > 0), "unknown")
    )


def write_windows(turn_rows: DataFrame, cache: CacheMultipliers) -> DataFrame:
    """One row per written window with the multiplier and confidence ceiling it is priced at."""
    none = F.lit(None).cast("string")
    windows = F.array(
        *[
            F.struct(
                F.lit(name).alias("ttl_window"), F.col(col).alias("tokens"),
                F.lit(mult).cast("bigint").alias("multiplier_millionths"), cap.alias("confidence_cap"),
            )
            for name, col, mult, cap in (
                ("5m", "write_5m", cache.write_5m, none),
                ("1h", "write_1h", cache.write_1h, none),
                ("unknown", "write_unknown", cache.unknown, F.lit(cache.unknown_confidence)),
            )
        ]
    )
    return (
        turn_rows.select("session_id", "turn_index", F.explode(windows).alias("w"))
        .select("session_id", "turn_index", "w.*")
        .filter("tokens > 0")
    )


def unpriceable(turn_models: DataFrame, rates: DataFrame) -> DataFrame:
    """Sessions with a model that has no rate, with their unpriced turns and models."""
    counted = turn_models.groupBy("session_id", "model").agg(F.count(F.lit(1)).alias("n"))
    return (
        counted.join(rates.select("model"), "model", "left_anti")
        .groupBy("session_id")
        .agg(F.sum("n").alias("turns"), F.array_join(F.array_sort(F.collect_set("model")), ",").alias("unpriced_models"))
    )


def first_wins(
    rows: DataFrame, key: Sequence[str], order: Sequence[str], keep: Sequence[str]
) -> DataFrame:
    """The first copy of each key. An aggregate, not a window: copies fold before the shuffle."""
    first = F.min_by(F.struct(*order, *keep), F.struct(*order)).alias("first")
    return rows.groupBy(*key).agg(first).select(*key, "first.*")


def with_replays(turn_rows: DataFrame) -> DataFrame:
    """The turns in file 0 and a replay of every 17th in file 1, every second one altered."""
    columns = [
        "session_id", "uuid", "line", "input_tokens", "write_5m", "write_1h", "write_unknown", "read_tokens", "output_tokens",
    ]
    first = turn_rows.select(*columns).withColumn("file_rank", F.lit(0))
    again = (
        turn_rows.filter("uuid % 17 = 0").select(*columns)
        .withColumn("output_tokens", F.col("output_tokens") + F.when(F.col("uuid") % 34 == 0, 1).otherwise(0))
        .withColumn("file_rank", F.lit(1))
    )
    return first.unionByName(again)


def usage_copies(rows: DataFrame, key: Sequence[str], order: Sequence[str], usage: Sequence[str]) -> DataFrame:
    """Copies folded to one row per (key, usage) with their number and first position."""
    return rows.groupBy(*key, *usage).agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct(*order)).alias("at")
    )


def dedup_accounting(rows: DataFrame, key: Sequence[str], order: Sequence[str], usage: Sequence[str]) -> DataFrame:
    """input = kept + dropped, and the copies whose usage differs from the first copy's.

    Equal copies fold on the map side, so a key with very many copies stays small; the first
    copy's usage carries the position of the whole key.
    """
    folded = usage_copies(rows, key, order, usage)
    per_key = folded.groupBy(*key).agg(
        F.sum("copies").alias("copies"), F.min_by("copies", "at").alias("like_first")
    )
    return per_key.agg(
        F.sum("copies").alias("input_count"),
        F.count(F.lit(1)).alias("kept"),
        (F.sum("copies") - F.count(F.lit(1))).alias("dropped"),
        F.sum(F.col("copies") - F.col("like_first")).alias("conflicts"),
    )


def conflicts_by_session(rows: DataFrame, key: Sequence[str], order: Sequence[str], usage: Sequence[str]) -> DataFrame:
    """session_id, conflicts: exchanges that appear again with other token counts, by the session of their first copy."""
    folded = rows.groupBy(*key, *usage).agg(F.min(F.struct(*order, "session_id")).alias("at"))
    per_key = folded.groupBy(*key).agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("kinds"))
    return per_key.groupBy(F.col("at.session_id").alias("session_id")).agg(F.count_if(F.col("kinds") > 1).alias("conflicts"))


def parent_links(turn_rows: DataFrame) -> DataFrame:
    known = turn_rows.select("session_id", F.col("uuid").alias("parent_uuid"))
    claimed = F.when(F.col("claimed") != F.col("uuid"), F.col("claimed"))
    return turn_rows.select("session_id", "uuid", claimed.alias("claim")).join(
        known.withColumnRenamed("session_id", "_s"),
        (F.col("session_id") == F.col("_s")) & (F.col("claim") == F.col("parent_uuid")),
        "left",
    ).select("session_id", "uuid", "parent_uuid")


def zip_boundaries(comps: DataFrame) -> DataFrame:
    """Compaction records joined to their boundaries by position, with equal numbers asserted."""
    records = comps.select("session_id", "comp_index", "line", "uuid")
    bounds = comps.select("session_id", "comp_index", "boundary_turn")
    both = records.join(bounds, ["session_id", "comp_index"], "full_outer")
    missing = F.col("line").isNull() | F.col("boundary_turn").isNull()
    refuse = F.raise_error(F.lit("compaction records and boundaries differ in number")).cast("bigint")
    return both.withColumn("boundary_turn", F.when(missing, refuse).otherwise(F.col("boundary_turn")))


def zipped(left: DataFrame, right: DataFrame, key: str, left_order: Sequence[Column], right_order: Sequence[Column], refuse: str) -> DataFrame:
    """The k-th row of ``left`` beside the k-th of ``right`` within each key, from two sources; different numbers are an error.

    Orders must be total. Columns but the key must differ in name.
    """
    a = grouped.spread_rank(left, [key], left_order, "place")
    b = grouped.spread_rank(right, [key], right_order, "place")
    both = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), [key, "place"], "full_outer")
    odd = F.col("_a").isNull() | F.col("_b").isNull()
    message = F.concat(F.lit(f"{refuse}: {key} "), F.col(key).cast("string"), F.lit(" at "), F.col("place").cast("string"))
    return both.withColumn("place", F.when(odd, F.raise_error(message).cast("bigint")).otherwise(F.col("place"))).drop("_a", "_b")


def exclude(sessions: DataFrame, excluded: DataFrame) -> DataFrame:
    return sessions.join(excluded, "session_id", "left_anti")


def newest(sessions: DataFrame, n: int) -> DataFrame:
    """The n most recently modified sessions; the number is the feature, so it is a top-k."""
    top = sessions.orderBy(F.desc("modified"), F.desc("session_id")).limit(n)
    ranked = top.agg(
        F.sort_array(F.collect_list(F.struct("modified", "session_id")), asc=False).alias("all")
    )
    return ranked.select(F.posexplode("all").alias("at", "s")).select(
        "s.session_id", (F.col("at") + 1).cast("bigint").alias("newest_rank")
    )
