"""Reconciliation and quality gates; a gate returns rows and never changes a figure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.functions import fixed
from tallyfold.operators.residency import SESSION_TURN


def with_remainder(facts: DataFrame, turn_rows: DataFrame) -> DataFrame:
    """The facts plus one unattributed row per session, without a component or a target."""
    charged = turn_rows.select("session_id", F.col("total_micros").alias("cost_micros"))
    split = facts.select("session_id", (-F.col("cost_micros")).alias("cost_micros"))
    none = F.lit(None).cast("string")
    rest = (
        charged.unionByName(split).groupBy("session_id").agg(F.sum("cost_micros").alias("cost_micros"))
        .filter("cost_micros <> 0")
        .select("session_id", F.lit("unattributed").alias("target_kind"), none.alias("component"), "cost_micros")
    )
    return facts.unionByName(rest, allowMissingColumns=True)


def row_constraints(facts: DataFrame, lane_rows: DataFrame, event_rows: DataFrame) -> DataFrame:
    """Rows checked and rows that break an enumeration or an invariant, per table."""
    f = F.col
    bad_fact = (
        ~f("target_kind").isin(*fixed.TARGET_KINDS)
        | ((f("target_kind") == "unattributed") != f("component").isNull())
        | ((f("target_kind") == "unattributed") & f("target_id").isNotNull())
        | (f("target_kind").isin("item", "invalidation_event") & f("target_id").isNull())
        | ((f("component") == "output") & (f("target_kind") == "item"))
        | ~f("basis").isin(*fixed.BASIS) | ~f("confidence").isin(*fixed.CONFIDENCE)
    )
    bad_lane = (
        ~f("lane").isin(*fixed.LANES) | ~f("lane_reason").isin(*fixed.LANE_REASONS)
        | ((f("lane") == "uncached") & (f("threshold").isNull() | (f("size_tokens") >= f("threshold"))))
    )
    bad_event = ~f("tier").isin(*fixed.TIERS) | ~f("trigger").isin(*fixed.TRIGGERS) | (f("forced_micros") < 0)

    def count(rows, name, bad):
        return rows.agg(
            F.count(F.lit(1)).alias("checked"), F.count_if(F.coalesce(bad, F.lit(False))).alias("violations")
        ).select(F.lit(name).alias("tbl"), "checked", "violations")

    return (
        count(facts, "attribution", bad_fact)
        .unionByName(count(lane_rows, "cache_lane", bad_lane))
        .unionByName(count(event_rows, "invalidation_event", bad_event))
    )


def duplicate_ledger(turn_rows: DataFrame) -> DataFrame:
    per_turn = turn_rows.groupBy(*SESSION_TURN).agg(F.count(F.lit(1)).alias("n"))
    return per_turn.agg(
        F.sum("n").alias("turns"), F.count(F.lit(1)).alias("distinct_turns"),
        (F.sum("n") - F.count(F.lit(1))).alias("duplicates"),
    )


def policy_mix(results: DataFrame) -> DataFrame:
    per = results.groupBy("policy").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(
        F.count(F.lit(1)).alias("policies"), (F.count(F.lit(1)) == 1).alias("single_policy"), F.sum("n").alias("rows")
    )


def attribution_items(facts: DataFrame, item_rows: DataFrame) -> DataFrame:
    """Item facts with the item's attributes; a fact without its item is an error."""
    mine = facts.filter("target_kind = 'item'").select(
        "session_id", F.col("target_id").alias("item_id"), "component", "cost_micros"
    )
    known = item_rows.select("session_id", "item_id", "category")
    refuse = F.raise_error(F.concat(F.lit("attribution to an unknown item "), F.col("item_id"))).cast("string")
    return mine.join(known, ["session_id", "item_id"], "left").withColumn(
        "category", F.coalesce(F.col("category"), F.when(F.col("category").isNull(), refuse))
    )


def conservation(before: DataFrame, after: DataFrame, cost: str, name: str) -> DataFrame:
    """Total of a measure before and after a grouping, and whether they are equal."""
    a = before.agg(F.coalesce(F.sum(cost), F.lit(0)).cast("bigint").alias("v"))
    b = after.agg(F.coalesce(F.sum(cost), F.lit(0)).cast("bigint").alias("v"))
    return a.select(
        F.lit(name).alias("grouping"), F.col("v").alias("before"), b.select("v").scalar().alias("after")
    ).withColumn("conserved", F.col("before") == F.col("after"))
