"""Stored-result queries: written tables, freshness, restored rows and incremental runs of the events binding."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfold.catalog.ev import model
from tallyfold.catalog.ev_sql import ev_sql
from tallyfold.catalog.registry import query
from tallyfold.operators import stored as st
from tallyfold.sources import events
from tallyfold.store import files

POLICY = "proportional"
BEFORE = "2024-01-20 00:00:00"
PRINTS = f"""
now AS (SELECT user_id AS session_id, count(*) || ':' || max(event_id) AS print FROM events GROUP BY 1),
old AS (SELECT user_id AS session_id, count(*) || ':' || max(event_id) AS print FROM events WHERE ts < TIMESTAMP '{BEFORE}' GROUP BY 1)
"""

_stores: dict[tuple, st.Results] = {}


def _log_prints(spark, sf, before=None):
    raw = events.raw_events(spark, sf)
    return st.fingerprints(raw if before is None else raw.filter(F.col("ts") < F.lit(before).cast("timestamp")))


def store(spark, sf, before=None) -> st.Results:
    """The result tables of a run over all events, or over those before a date; written once."""
    key = (spark.sparkContext.applicationId, files.stamp(spark, f"{sf}/events.parquet"), sf, before)
    if key not in _stores:
        _stores[key] = st.write_results(model(spark, sf, POLICY, before), _log_prints(spark, sf, before), POLICY, events.RATES)
    return _stores[key]


@query("s17_stored_results", ev_sql("""
SELECT session_id, session_id || '|proportional|' || n.print AS result_id, CAST(total_micros AS BIGINT) AS total_micros, CAST(attributed_micros AS BIGINT) AS attributed_micros,
 CAST(unattributed_micros AS BIGINT) AS unattributed_micros, n_turns AS through_turn
FROM rec JOIN nt USING (session_id) JOIN (SELECT user_id AS session_id, count(*) || ':' || max(event_id) AS print FROM events GROUP BY 1) n USING (session_id)"""))
def s17(spark, sf):
    """The index, read back from the written table."""
    return store(spark, sf).index.select("session_id", "result_id", "total_micros", "attributed_micros", "unattributed_micros", "through_turn")


@query("s17_stored_attributions", ev_sql("""
SELECT session_id, turn_index, target_kind, target_id, component, CAST(cost_micros AS BIGINT) AS cost_micros, basis, confidence FROM att"""))
def s17_rows(spark, sf):
    """The facts, read back from the written table."""
    return store(spark, sf).attribution.select("session_id", "turn_index", "target_kind", "target_id", "component", "cost_micros", "basis", "confidence")


@query("s17_stored_charges", ev_sql("""
SELECT session_id, turn_index, fresh_micros, write_micros, read_micros, output_micros, total_micros FROM turns"""))
def s17_charges(spark, sf):
    return store(spark, sf).charge.select("session_id", "turn_index", "fresh_micros", "write_micros", "read_micros", "output_micros", "total_micros")


@query("s19_freshness_check", "WITH " + PRINTS + """
, had AS (SELECT DISTINCT user_id AS session_id FROM events WHERE event_type = 'purchase' AND ts < TIMESTAMP '""" + BEFORE + """')
SELECT n.session_id, CASE WHEN h.session_id IS NULL THEN 'absent' WHEN o.print = n.print THEN 'current' ELSE 'stale' END AS state
FROM now n LEFT JOIN old o USING (session_id) LEFT JOIN had h USING (session_id)""")
def s19(spark, sf):
    """Today's logs against the index that an earlier run has written."""
    return st.freshness(_log_prints(spark, sf), store(spark, sf, BEFORE).index.select("session_id", "print"))


@query("s24_coverage_note", ev_sql("""
SELECT session_id, 'covers turns 1-' || n_turns || '; session is now at ' || total AS note
FROM nt JOIN (SELECT user_id AS session_id, count(*) AS total FROM events WHERE event_type = 'purchase' GROUP BY 1) USING (session_id)""", before=BEFORE))
def s24(spark, sf):
    """What a stored result covers, beside where its session is now."""
    now = model(spark, sf).turns.groupBy("session_id").agg(F.count(F.lit(1)).alias("total"))
    note = F.concat(F.lit("covers turns 1-"), F.col("through_turn").cast("string"), F.lit("; session is now at "), F.col("total").cast("string"))
    return store(spark, sf, BEFORE).index.join(now, "session_id").select("session_id", note.alias("note"))


@query("r3_restored_row_check", ev_sql("""
SELECT session_id, CASE WHEN attributed_micros + unattributed_micros <> total_micros THEN 'remainder' END AS fault FROM rec"""))
def r3(spark, sf):
    """The three equations of each stored result over its stored rows."""
    return st.restored(store(spark, sf))


@query("r3_tampered_rows", ev_sql("""
SELECT session_id, CASE WHEN session_id % 3 = 0 AND attributed_micros > 0 THEN 'attributed' WHEN session_id % 3 = 1 THEN 'remainder' END AS fault FROM rec"""))
def r3_tampered(spark, sf):
    """The same check on broken tables: attributions of some sessions and charges of others are a micro too high."""
    good = store(spark, sf)
    first = good.attribution.groupBy("session_id").agg(F.min(F.struct("turn_index", "component", "target_id", "item_ref", "cost_micros")).alias("f"))
    hit = first.filter("session_id % 3 = 0").select(
        "session_id", F.col("f.turn_index").alias("turn_index"), F.col("f.component").alias("component"), F.lit(1).cast("bigint").alias("cost_micros")
    )
    facts = good.attribution.select("session_id", "turn_index", "component", "cost_micros").unionByName(hit)
    high = F.when((F.col("session_id") % 3 == 1) & (F.col("turn_index") == 0), 1).otherwise(0)
    charge = good.charge.withColumn("total_micros", F.col("total_micros") + high)
    return st.restored(st.Results(charge, facts, good.index))
