"""The rows of a finished run as normalised tables, one row per fact, each session's rows whole.

Every table has session_id. Money is in whole micro-dollars, times are UTC text to the second, and what a
session's charges are not explained by is a row of its own, so that the attributions add up to the charges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfold.functions import fixed
from tallyfold.operators import ledger, residency
from tallyfold.operators.turns import ttl_label
from tallyfold.plans import grouped
from tallyfold.session import stored

RESULT = "analysis_result"
REMAINDER = "unattributed"
SEPARATOR = "|"
SAMPLES = 5

#: Tables and columns as they are stored; fixed.
TABLES = {
    "session": "session_id string, project_path string, transcript_path string, started_at string, ended_at string, producing_version string, is_complete boolean",
    "turn": "session_id string, turn_id string, ordinal bigint, message_id string, request_id string, model string, cache_ttl string, is_sidechain boolean, parent_turn_id string",
    "charge": "session_id string, turn_id string, component string, tokens bigint, cost_micros bigint",
    "context_item": "session_id string, item_id string, kind string, identity string, project_path string, category string, size_tokens bigint",
    "injection": "session_id string, injection_id string, turn_id string, item_id string, cause string, tool_use_id string, size_tokens bigint",
    "residency_span": "session_id string, span_id string, injection_id string, item_id string, first_turn bigint, last_turn bigint, end_reason string",
    "cache_lane": "session_id string, turn_id string, item_id string, lane string, lane_reason string",
    "invalidation_event": "session_id string, event_id string, turn_id string, tier string, trigger string, detail string, forced_reload_micros bigint",
    "attribution": "session_id string, attribution_id string, turn_id string, target_kind string, target_id string, component string, cost_micros bigint, basis string, confidence string, source_refs string",
    "analysis_result": "session_id string, result_id string, fingerprint string, covered_through_turn bigint, producing_version string, tool_version string, computed_at string, pricing_fingerprint string",
    "ingest_diagnostic": "session_id string, kind string, count bigint, sample string",
}


def _of(column: str, values: tuple[str, ...]) -> str:
    return f"{column} in ({', '.join(repr(v) for v in values)})"


#: What every row of a table must say; a row that does not is refused with its whole commit.
CHECKS = {
    "session": "session_id is not null and is_complete is not null",
    "turn": "turn_id is not null and ordinal >= 0 and model is not null and is_sidechain is not null and (cache_ttl is null or cache_ttl in ('5m', '1h', 'unknown'))",
    "charge": "turn_id is not null and component in ('fresh_input', 'cache_write', 'cache_read', 'output') and tokens >= 0 and cost_micros >= 0",
    "context_item": "item_id is not null and kind is not null and identity is not null and category is not null and size_tokens >= 0",
    "injection": "injection_id is not null and turn_id is not null and item_id is not null and cause is not null and size_tokens >= 0",
    # A compaction before a span's first turn leaves it empty: its last turn is the one before.
    "residency_span": "injection_id is not null and first_turn >= 0 and (last_turn is null or last_turn >= first_turn - 1) and end_reason in ('evicted', 'invalidated', 'session_end', 'unknown')",
    "cache_lane": f"turn_id is not null and item_id is not null and {_of('lane', fixed.LANES)} and {_of('lane_reason', fixed.LANE_REASONS)}",
    "invalidation_event": f"turn_id is not null and {_of('tier', fixed.TIERS)} and {_of('trigger', fixed.TRIGGERS)} and detail is not null and forced_reload_micros >= 0",
    "attribution": f"""{_of('target_kind', fixed.TARGET_KINDS)} and (target_kind = 'unattributed') = (component is null) and not (target_kind = 'unattributed' and target_id is not null)
      and not (target_kind in ('item', 'invalidation_event') and target_id is null) and not coalesce(component = 'output' and target_kind = 'item', false)
      and cost_micros >= 0 and {_of('basis', fixed.BASIS)} and {_of('confidence', fixed.CONFIDENCE)} and source_refs is not null""",
    "analysis_result": "result_id is not null and fingerprint is not null and covered_through_turn >= 0 and pricing_fingerprint is not null and computed_at is not null",
    "ingest_diagnostic": "kind is not null and count >= 0",
}


def iso(moment: Column) -> Column:
    """A moment as UTC text to the second, which sorts as time does; the session's zone is UTC."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _name(column: str) -> Column:
    return F.col(column).cast("string")


def unpaid(placed: DataFrame) -> DataFrame:
    """session_id, kind, count, sample: injections after the last turn, which no turn pays for, with the first of them."""
    rows = placed.where(F.col("is_injection") & (F.col("n_turns") > 0) & (F.col("turns_before") == F.col("n_turns"))).select("session_id", "line")
    first = rows.withColumn("place", F.row_number().over(W.partitionBy("session_id").orderBy("line"))).where(F.col("place") <= SAMPLES)
    lines = F.transform(F.array_sort(F.collect_list("line")), lambda x: F.concat(F.lit("line "), x.cast("string"), F.lit(": never paid for")))
    samples = first.groupBy("session_id").agg(F.array_join(lines, "\n").alias("sample"))
    return rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("count")).join(samples, "session_id").withColumn("kind", F.lit("unpaid_injection"))


def tables(model: ledger.Model, keys: DataFrame, sessions: DataFrame, computed_at: str, diagnostics: DataFrame | None = None) -> dict[str, DataFrame]:
    """The rows of each table for the sessions that the model has turns of.

    ``keys`` has session_id, print, policy, rate_print, version and result_id; ``sessions`` session_id, project_path, transcript_path,
    producing_version and is_complete; turns may have message_id, request_id and claimed, the turn they say they follow.
    """
    turns = model.turns
    for optional in ("message_id", "request_id", "claimed"):
        if optional not in turns.columns:
            turns = turns.withColumn(optional, F.lit(None).cast("string"))
    seen = turns.groupBy("session_id").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("n"))
    session = seen.join(sessions, "session_id", "left")
    ids = turns.select("session_id", "turn_index", _name("uuid").alias("turn_id"))
    parents = turns.select("session_id", _name("uuid").alias("parent_turn_id"))
    named = turns.withColumn("parent_turn_id", F.when(_name("claimed") != _name("uuid"), _name("claimed")))
    linked = named.join(parents.withColumn("known", F.lit(True)), ["session_id", "parent_turn_id"], "left")
    components = F.array(
        *[
            F.struct(F.lit(name).alias("component"), F.col(tokens).alias("tokens"), F.col(micros).alias("cost_micros"))
            for name, tokens, micros in (
                ("fresh_input", "input_tokens", "fresh_micros"), ("cache_write", "write_tokens", "write_micros"),
                ("cache_read", "read_tokens", "read_micros"), ("output", "output_tokens", "output_micros"),
            )
        ]
    )
    book = model.ledger
    project = sessions.select("session_id", "project_path")
    lanes = book.filter((F.col("row") == "res") & F.col("lane").isNotNull())
    events = book.filter((F.col("row") == "turn") & F.col("t.trigger").isNotNull())
    return {
        "session": session.select(
            "session_id", "project_path", "transcript_path", iso(F.col("started")).alias("started_at"), iso(F.col("ended")).alias("ended_at"),
            "producing_version", F.coalesce("is_complete", F.lit(False)).alias("is_complete"),
        ),
        "turn": linked.select(
            "session_id", _name("uuid").alias("turn_id"), F.col("turn_index").alias("ordinal"), "message_id", "request_id", "model",
            ttl_label().alias("cache_ttl"), "is_sidechain", F.when(F.col("known"), F.col("parent_turn_id")).alias("parent_turn_id"),
        ),
        "charge": turns.select("session_id", _name("uuid").alias("turn_id"), F.explode(components).alias("c")).select("session_id", "turn_id", "c.*"),
        "context_item": model.items.join(project, "session_id", "left").select("session_id", "item_id", "kind", "identity", "project_path", "category", "size_tokens"),
        "injection": model.injections.join(ids, residency.SESSION_TURN).select(
            "session_id", _name("uuid").alias("injection_id"), "turn_id", "item_id", "cause", F.lit(None).cast("string").alias("tool_use_id"), "size_tokens"
        ),
        "residency_span": model.spans.select(
            "session_id", F.concat_ws(SEPARATOR, _name("session_id"), F.concat_ws("@", "item_id", _name("first_turn"), _name("opened_line"))).alias("span_id"),
            _name("opened_uuid").alias("injection_id"), "item_id", "first_turn", "last_turn", "end_reason",
        ),
        "cache_lane": lanes.select("session_id", F.col("t.uuid").cast("string").alias("turn_id"), "item_id", "lane", "lane_reason"),
        "invalidation_event": events.select(
            "session_id", F.concat_ws(":", F.lit("inval"), _name("session_id"), _name("turn_index")).alias("event_id"), F.col("t.uuid").cast("string").alias("turn_id"),
            F.col("t.tier").alias("tier"), F.col("t.trigger").alias("trigger"), F.col("t.detail").alias("detail"), F.col("forced_micros").alias("forced_reload_micros"),
        ),
        "attribution": _attributions(model, keys),
        RESULT: keys.join(seen, "session_id").join(sessions.select("session_id", "producing_version"), "session_id", "left").select(
            "session_id", "result_id", F.col("print").alias("fingerprint"), F.col("n").alias("covered_through_turn"), "producing_version",
            F.col("version").alias("tool_version"), F.lit(computed_at).alias("computed_at"), F.col("rate_print").alias("pricing_fingerprint"),
        ),
        "ingest_diagnostic": (unpaid(model.placed) if diagnostics is None else diagnostics).select("session_id", "kind", "count", "sample"),
    }


def _attributions(model: ledger.Model, keys: DataFrame) -> DataFrame:
    """The facts numbered within their session, and the remainder after them."""
    order = [F.col(c) for c in ("turn_index", "component", "target_kind", "target_id", "item_ref")]
    facts = grouped.spread_rank(model.attributions, ["session_id"], order, "number")
    refs = F.to_json(F.array_compact(F.array("item_ref", "turn_ref")))
    rows = facts.select(
        "session_id", (F.col("number") - 1).alias("number"), F.split("turn_ref", "@")[0].alias("turn_id"), "target_kind", "target_id", "component", "cost_micros",
        "basis", "confidence", refs.alias("source_refs"),
    )
    counts = model.attributions.groupBy("session_id").agg(F.count(F.lit(1)).alias("number"))
    rest = ledger.reconcile(model.turns, model.attributions).where("unattributed_micros <> 0").join(counts, "session_id", "left")
    none = F.lit(None).cast("string")
    reason = F.to_json(F.array(F.concat(F.lit("reconciliation of session "), _name("session_id"))))
    remainder = rest.select(
        "session_id", F.coalesce("number", F.lit(0)).alias("number"), none.alias("turn_id"), F.lit(REMAINDER).alias("target_kind"), none.alias("target_id"), none.alias("component"),
        F.col("unattributed_micros").alias("cost_micros"), F.lit("exact").alias("basis"), F.lit("high").alias("confidence"), reason.alias("source_refs"),
    )
    both = rows.unionByName(remainder).join(keys.select("session_id", "result_id"), "session_id")
    return both.withColumn("attribution_id", F.concat_ws(SEPARATOR, "result_id", F.format_string("%06d", "number"))).drop("number", "result_id")
