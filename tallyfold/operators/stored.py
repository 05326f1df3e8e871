"""Stored results: written tables with an index, freshness, restored-row checks and incremental runs.

A result is stored per session under a key of five parts: session, coverage fingerprint, policy,
fingerprint of the rates and version of the code. Any part that differs is a miss.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.operators import ledger
from tallyfold.session import stored
from tallyfold.sources.rates import RateTable

#: Raised by hand whenever the code gives other figures.
VERSION = "2"
SEPARATOR = "|"


def fingerprints(events: DataFrame) -> DataFrame:
    """Records and last id per session; counts fold before the shuffle."""
    return events.groupBy(F.col("user_id").alias("session_id")).agg(
        F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.max("event_id").cast("string")).alias("print")
    )


def freshness(now: DataFrame, stored: DataFrame) -> DataFrame:
    was = stored.withColumnRenamed("print", "was")
    state = F.when(F.col("was").isNull(), "absent").when(F.col("was") == F.col("print"), "current").otherwise("stale")
    return now.join(was, "session_id", "left").select("session_id", state.alias("state"))


def to_recompute(now: DataFrame, stored: DataFrame) -> DataFrame:
    return now.join(stored, ["session_id", "print"], "left_anti").select("session_id")


KEY = ["session_id", "print", "policy", "rate_print", "version"]


@dataclass(frozen=True)
class Results:
    """The written tables: observed charges, derived attributions, and the index of results."""

    charge: DataFrame
    attribution: DataFrame
    index: DataFrame


def keyed(prints: DataFrame, policy: str, rates: RateTable) -> DataFrame:
    """session_id and print with the rest of the key and the id of the result."""
    return prints.select(
        "session_id", "print", F.lit(policy).alias("policy"), F.lit(rates.fingerprint).alias("rate_print"), F.lit(VERSION).alias("version"),
        F.concat_ws(SEPARATOR, F.col("session_id").cast("string"), F.lit(policy), "print").alias("result_id"),
    )


def write_results(model: ledger.Model, prints: DataFrame, policy: str, rates: RateTable) -> Results:
    """Write the tables below the shared folder; an over-attributed session or a bad row fails the write."""
    keys = keyed(prints, policy, rates)
    charge = stored(
        model.turns.select(
            "session_id", "turn_index", "model", "fresh_micros", "write_micros", "read_micros", "output_micros", "total_micros"
        ), "charge",
    )
    refuse = F.raise_error(F.concat(F.lit("negative attribution in session "), F.col("session_id").cast("string"))).cast("bigint")
    cost = F.when(F.col("cost_micros") < 0, refuse).otherwise(F.col("cost_micros"))
    facts = stored(model.attributions.withColumn("cost_micros", cost).withColumn("policy", F.lit(policy)), "attribution")
    through = charge.groupBy("session_id").agg(F.count(F.lit(1)).alias("through_turn"))
    index = stored(ledger.reconcile(charge, facts).join(through, "session_id").join(keys, "session_id"), "result")
    return Results(charge, facts, index)


def restored(results: Results) -> DataFrame:
    """session_id, fault: which equation of a stored result its stored rows break, NULL when none.

    The attributions give the attributed amount, this and the remainder give the charges, and the charges
    give the total. A result that breaks one must not be served.
    """
    split = results.attribution.groupBy("session_id").agg(F.sum("cost_micros").alias("split"))
    seen = results.charge.groupBy("session_id").agg(F.sum("total_micros").alias("seen"))
    zero = F.lit(0).cast("bigint")
    both = results.index.join(split, "session_id", "left").join(seen, "session_id", "left")
    got, observed = F.coalesce("split", zero), F.coalesce("seen", zero)
    fault = (
        F.when(got != F.col("attributed_micros"), "attributed")
        .when(got + F.col("unattributed_micros") != observed, "remainder")
        .when(observed != F.col("total_micros"), "total")
    )
    return both.select("session_id", fault.alias("fault"))


def served(results: Results, keys: DataFrame) -> DataFrame:
    """The index rows that may be served for ``keys``: equal in all five parts and sound by their own rows."""
    sound = restored(results).filter("fault IS NULL").select("session_id")
    return results.index.join(keys.select(*KEY), KEY, "left_semi").join(sound, "session_id", "left_semi")
