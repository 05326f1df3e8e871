"""Traces of single figures and of the total, read off the fact table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfold.functions import fixed, money
from tallyfold.operators.rollups import name_of, rank_of

TURNS_SHOWN = 10


def figure_id() -> Column:
    return F.concat(F.col("component"), F.lit(":"), F.coalesce("target_id", F.lit("session")))


def figure_traces(facts: DataFrame, turn_rows: DataFrame, wanted: str) -> DataFrame:
    """Figures with exactly the wanted id, else those whose id holds it.

    Whether an exact one exists is decided by a sum in the same aggregate, not by a first job.
    The first turns come from a row_number filter, which Spark limits before its shuffle.
    """
    held = facts.withColumn("figure_id", figure_id()).filter(F.contains("figure_id", F.lit(wanted)))
    per = held.groupBy("figure_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("cost_micros").alias("total_micros"),
        F.max(rank_of(F.col("confidence"), fixed.CONFIDENCE)).alias("r"),
    )
    exact = per.agg(F.count_if(F.col("figure_id") == wanted).alias("n"))
    per = per.filter((F.col("figure_id") == wanted) | (exact.scalar() == 0))
    order = W.partitionBy("figure_id").orderBy("session_id", "turn_index")
    first = (
        held.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= TURNS_SHOWN)
        .groupBy("figure_id")
        .agg(F.array_sort(F.collect_list(F.struct("rn", "session_id", "turn_index", "cost_micros"))).alias("turns"))
    )
    total = turn_rows.agg(F.sum("total_micros").alias("total"))
    text = F.transform(
        F.col("turns"),
        lambda t: F.concat(
            t["session_id"].cast("string"), F.lit(":"), t["turn_index"].cast("string"), F.lit("="), t["cost_micros"].cast("string")
        ),
    )
    return per.join(first, "figure_id", "inner").select(
        "figure_id", "rows", "total_micros",
        money.share_of(F.col("total_micros"), total.scalar()).alias("share"),
        name_of(F.col("r"), fixed.CONFIDENCE).alias("confidence"),
        F.array_join(text, " ").alias("first_turns"),
    )


def one_figure(facts: DataFrame, wanted: str) -> DataFrame:
    """The facts of the one figure that is meant: exactly this id, else the only one that holds the text.

    None, or several, is an error that names some of them.
    """
    held = facts.withColumn("figure_id", figure_id()).filter(F.contains("figure_id", F.lit(wanted)))
    ids = held.groupBy("figure_id").agg(F.count(F.lit(1)).alias("n"))
    names = ids.orderBy("figure_id").limit(TURNS_SHOWN).agg(F.array_join(F.array_sort(F.collect_list("figure_id")), ", ").alias("v"))
    counts = ids.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("figure_id") == wanted).alias("exact"))
    n, exact = counts.select("n").scalar(), counts.select("exact").scalar()
    several = F.concat(F.lit(f"{wanted!r} matches "), n.cast("string"), F.lit(" figures: "), names.scalar())
    means = F.when(exact > 0, F.col("figure_id") == wanted).when(n > 1, F.raise_error(several).cast("boolean")).otherwise(F.lit(True))
    return held.filter(means)


def source_refs(figure: DataFrame) -> DataFrame:
    """figure_id, ref, facts: the distinct records behind a figure, each with the number of its facts that rest on it."""
    refs = F.explode(F.array_compact(F.array("item_ref", "turn_ref"))).alias("ref")
    return figure.select("figure_id", refs).groupBy("figure_id", "ref").agg(F.count(F.lit(1)).alias("facts"))


def total_trace(turn_rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Charges by component, and the part of the writes no item or change explains."""
    direct = facts.agg(F.sum(F.when(F.col("component") == "direct", F.col("cost_micros")).otherwise(0)).alias("d"))
    return turn_rows.agg(
        F.sum("fresh_micros").alias("fresh_input"), F.sum("write_micros").alias("cache_write"),
        F.sum("read_micros").alias("cache_read"), F.sum("output_micros").alias("output"),
        F.sum("total_micros").alias("total"),
    ).withColumn("write_gap", F.col("cache_write") - direct.scalar())
