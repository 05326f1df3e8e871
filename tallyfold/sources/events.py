"""The events table read as session logs.

Each user is a session; purchases are turns, views and clicks bring files into the context,
signups change the prompt prefix, errors are compactions. Line numbers are positions by
(ts, event_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.functions import paths
from tallyfold.operators.residency import PLACED
from tallyfold.plans import scan
from tallyfold.sources.rates import RateTable

RATES = RateTable(
    models=(
        ("m-small", 1_000_000, 5_000_000, 400),
        ("m-mid", 3_000_000, 15_000_000, 100),
        ("m-large", 5_000_000, 25_000_000, None),
    ),
    origin="explicit",
    priced_on="2024-01-01",
)


TURN = "purchase"
COMPACTION = "error"


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def session_log(spark: SparkSession, sf_dir: str, before: str | None = None) -> DataFrame:
    """Log rows of all sessions; ``before`` keeps only earlier events (a stored state)."""
    events = raw_events(spark, sf_dir)
    if before is not None:
        events = events.filter(F.col("ts") < F.lit(before).cast("timestamp"))
    return log_of(events)


def model_of(k: Column, session: Column) -> Column:
    return F.when(k % 10 == 0, "m-mid").when(session % 2 == 0, "m-large").otherwise("m-small")


def turn_models(events: DataFrame) -> DataFrame:
    """session_id and model of every turn; needs no order, so nothing is shuffled."""
    k, session = F.get_json_object("props", "$.k").cast("bigint"), F.col("user_id")
    return events.where(F.col("event_type") == TURN).select(session.alias("session_id"), model_of(k, session).alias("model"))


def log_of(events: DataFrame) -> DataFrame:
    """Log rows of the sessions that the events belong to, which must be all events of these sessions; they come placed."""
    turns = (F.col("event_type") == TURN).cast("int").cast("bigint")
    comps = (F.col("event_type") == COMPACTION).cast("int").cast("bigint")
    lined = scan.numbered_scan(
        events.select(
            F.col("user_id").alias("session_id"),
            "event_id",
            "ts",
            "event_type",
            F.col("value"),
            F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        ),
        "session_id",
        "ts",
        "event_id",
        counts={"turns_before": turns, "comps_before": comps},
        totals={"n_turns": turns, "n_comps": comps},
        lasts={"prev_model": F.when(F.col("event_type") == TURN, model_of(F.col("k"), F.col("session_id")))},
    )
    k = F.col("k")
    kind = F.col("event_type")
    turn = kind == TURN
    inj = kind.isin("view", "click")
    chg = kind == "signup"
    comp = kind == COMPACTION
    zero = F.lit(0).cast("bigint")
    identity = F.concat(
        F.lit("/repo/d"),
        (k % 4).cast("string"),
        F.lit("/f"),
        (k % 20).cast("string"),
        F.when(k % 3 == 0, ".py").when(k % 3 == 1, ".md").otherwise(".json"),
    )
    edited = k % 6 == 0

    def of_turn(value):
        return F.when(turn, value.cast("bigint"))

    return lined.select(
        "session_id",
        "line",
        "ts",
        "k",
        F.col("event_id").alias("uuid"),
        turn.alias("is_turn"),
        inj.alias("is_injection"),
        chg.alias("is_change"),
        comp.alias("is_compaction"),
        F.when(turn, model_of(k, F.col("session_id"))).alias("model"),
        of_turn(F.col("event_id") - k).alias("claimed"),
        of_turn(k * 7).alias("input_tokens"),
        of_turn(F.when(k % 2 == 0, k * 11).otherwise(zero)).alias("write_5m"),
        of_turn(F.when(k % 5 == 0, k * 5).otherwise(zero)).alias("write_1h"),
        of_turn(F.when(k % 7 == 0, k * 3).otherwise(zero)).alias("write_unknown"),
        of_turn(F.when(k % 4 != 0, k * 100).otherwise(zero)).alias("read_tokens"),
        of_turn(k * 2).alias("output_tokens"),
        F.when(turn, k % 13 == 0).alias("is_sidechain"),
        F.when(inj, F.concat(F.lit("file:"), identity)).alias("item_id"),
        F.when(inj, "file").alias("kind"),
        F.when(inj, identity).alias("identity"),
        F.when(inj, paths.category(identity, F.lit("file"))).alias("category"),
        F.when(inj, F.lit(1) + F.floor(F.col("value") * 10).cast("bigint")).alias("size_tokens"),
        F.when(kind == "view", "measured").when(kind == "click", "estimated").alias("basis"),
        F.when(kind == "view", "medium").when(kind == "click", "low").alias("confidence"),
        F.when(kind == "view", "tool_result").when(kind == "click", "at_mention").alias("cause"),
        (inj & (F.col("event_id") % 5 == 0)).alias("pinned"),
        F.when(chg, F.when(edited, "instruction_changed").otherwise("tool_set_changed")).alias("trigger"),
        F.when(chg, F.when(edited, "system").otherwise("tools")).alias("tier"),
        F.when(
            chg,
            F.when(edited, F.lit("instruction file '/repo/CLAUDE.md' changed")).otherwise(
                F.concat(F.lit("MCP server 's"), (k % 5).cast("string"), F.lit("' added (1 tool)"))
            ),
        ).alias("detail"),
        F.when(comp, k * 1000).alias("pre_tokens"),
        F.when(comp, k * 100).alias("post_tokens"),
        F.when(comp, k * 1500).alias("cumulative_tokens"),
        *PLACED,
    )
