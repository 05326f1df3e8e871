"""The merged store of the events binding: its eleven tables, and runs that bring it up to date."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyfold.catalog.ev_sql import ev_sql
from tallyfold.catalog.registry import query
from tallyfold.operators import result_tables, runs
from tallyfold.operators import stored as st
from tallyfold.session import shared_dir
from tallyfold.sources import events
from tallyfold.store import files
from tallyfold.store.merged import MergedStore, restored, stored_results

POLICY = "proportional"
BEFORE, AFTER = "2024-01-20 00:00:00", "2024-03-01 00:00:00"
PRINT = events.RATES.fingerprint

_stores: dict[tuple, MergedStore] = {}


def fresh_store(spark) -> MergedStore:
    return MergedStore(spark, f"{shared_dir(spark).rstrip('/')}/results-{uuid.uuid4().hex}")


def full(spark, sf) -> MergedStore:
    """A store that was filled by two runs, of the log before a date and of all of it; made once for each state of the input."""
    key = (spark.sparkContext.applicationId, files.stamp(spark, f"{sf}/events.parquet"), sf)
    if key not in _stores:
        store, raw = fresh_store(spark), events.raw_events(spark, sf)
        runs.run(store, raw.where(f"ts < TIMESTAMP '{BEFORE}'"), POLICY, events.RATES, BEFORE)
        runs.run(store, raw, POLICY, events.RATES, AFTER)
        _stores[key] = store
    return _stores[key]


def rows(spark, sf, table):
    """A table's rows in use, without where they lie."""
    return full(spark, sf).read(table, POLICY).drop("commit", "policy", "bucket")


SID = "CAST(session_id AS VARCHAR) AS session_id"
INFO = """
, info AS (SELECT user_id AS session_id, count(*) || ':' || max(event_id) AS print, string_agg(DISTINCT CASE WHEN event_type = 'purchase' THEN '2.' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 3) END, ','
 ORDER BY CASE WHEN event_type = 'purchase' THEN '2.' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 3) END) AS versions FROM events GROUP BY 1)
"""

TWINS = {
    "session": INFO + f"""
SELECT {SID}, '/repo' AS project_path, CAST(NULL AS VARCHAR) AS transcript_path, strftime(min(ts), '%Y-%m-%dT%H:%M:%SZ') AS started_at, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS ended_at,
 any_value(versions) AS producing_version, TRUE AS is_complete FROM turns JOIN info USING (session_id) GROUP BY session_id""",
    "turn": f"""
SELECT CAST(t.session_id AS VARCHAR) AS session_id, CAST(t.uuid AS VARCHAR) AS turn_id, t.turn_index AS ordinal, CAST(NULL AS VARCHAR) AS message_id, CAST(NULL AS VARCHAR) AS request_id, t.model,
 CASE WHEN t.write_5m > 0 AND t.write_1h = 0 THEN '5m' WHEN t.write_1h > 0 AND t.write_5m = 0 THEN '1h' WHEN t.write_tokens > 0 THEN 'unknown' END AS cache_ttl, t.is_sidechain, CAST(p.uuid AS VARCHAR) AS parent_turn_id
 FROM turns t LEFT JOIN turns p ON p.session_id = t.session_id AND p.uuid = t.uuid - t.k AND p.uuid <> t.uuid""",
    "charge": f"""
SELECT {SID}, CAST(uuid AS VARCHAR) AS turn_id, component, CAST(tokens AS BIGINT) AS tokens, CAST(micros AS BIGINT) AS cost_micros FROM (
 SELECT session_id, uuid, 'fresh_input' AS component, input_tokens AS tokens, fresh_micros AS micros FROM turns UNION ALL SELECT session_id, uuid, 'cache_write', write_tokens, write_micros FROM turns
 UNION ALL SELECT session_id, uuid, 'cache_read', read_tokens, read_micros FROM turns UNION ALL SELECT session_id, uuid, 'output', output_tokens, output_micros FROM turns)""",
    "context_item": f"SELECT {SID}, item_id, kind, identity, '/repo' AS project_path, category, size_tokens FROM item",
    "injection": f"""
SELECT CAST(i.session_id AS VARCHAR) AS session_id, CAST(i.uuid AS VARCHAR) AS injection_id, CAST(t.uuid AS VARCHAR) AS turn_id, item_id, cause, CAST(NULL AS VARCHAR) AS tool_use_id, size_tokens
 FROM inj i JOIN turns t USING (session_id, turn_index)""",
    "residency_span": """
SELECT CAST(s.session_id AS VARCHAR) AS session_id, s.session_id || '|' || s.item_id || '@' || s.first_turn || '@' || s.opened_line AS span_id, CAST(i.uuid AS VARCHAR) AS injection_id, s.item_id, s.first_turn, s.last_turn, s.end_reason
 FROM span s JOIN inj i ON i.session_id = s.session_id AND i.item_id = s.item_id AND i.line = s.opened_line""",
    "cache_lane": f"SELECT {SID}, CAST(uuid AS VARCHAR) AS turn_id, item_id, lane, lane_reason FROM lane JOIN (SELECT session_id, turn_index, uuid FROM turns) USING (session_id, turn_index)",
    "invalidation_event": f"""
SELECT {SID}, event_id, CAST(uuid AS VARCHAR) AS turn_id, tier, "trigger", detail, forced_micros AS forced_reload_micros FROM event JOIN (SELECT session_id, turn_index, uuid FROM turns) USING (session_id, turn_index)""",
    "attribution": INFO + f"""
, numbered AS (SELECT a.*, t.uuid, t.uuid || '@line' || t.line AS turn_ref, row_number() OVER (PARTITION BY session_id ORDER BY turn_index, component, target_kind, target_id NULLS FIRST, item_ref NULLS FIRST) - 1 AS n
 FROM att a JOIN (SELECT session_id, turn_index, uuid, line FROM turns) t USING (session_id, turn_index)),
rest AS (SELECT r.session_id, unattributed_micros, (SELECT count(*) FROM att a WHERE a.session_id = r.session_id) AS n FROM rec r WHERE unattributed_micros <> 0)
SELECT {SID}, session_id || '|{POLICY}|' || print || '|' || printf('%06d', n) AS attribution_id, CAST(uuid AS VARCHAR) AS turn_id, target_kind, target_id, component, CAST(cost_micros AS BIGINT) AS cost_micros, basis, confidence,
 CASE WHEN item_ref IS NULL THEN '["' || turn_ref || '"]' ELSE '["' || item_ref || '","' || turn_ref || '"]' END AS source_refs FROM numbered JOIN info USING (session_id)
UNION ALL SELECT CAST(session_id AS VARCHAR), session_id || '|{POLICY}|' || print || '|' || printf('%06d', n), NULL, 'unattributed', NULL, NULL, CAST(unattributed_micros AS BIGINT), 'exact', 'high', '["reconciliation of session ' || session_id || '"]'
 FROM rest JOIN info USING (session_id)""",
    "analysis_result": INFO + f"""
SELECT {SID}, session_id || '|{POLICY}|' || print AS result_id, print AS fingerprint, n_turns AS covered_through_turn, versions AS producing_version, '{st.VERSION}' AS tool_version,
 CASE WHEN (SELECT count(*) || ':' || max(event_id) FROM events e WHERE e.user_id = session_id AND ts < TIMESTAMP '{BEFORE}') = print
  AND (SELECT max(ts) FROM events e WHERE e.user_id = session_id) <= TIMESTAMP '{BEFORE}' - INTERVAL 5 MINUTE THEN '{BEFORE.replace(" ", "T")}Z' ELSE '{AFTER.replace(" ", "T")}Z' END AS computed_at, '{PRINT}' AS pricing_fingerprint
 FROM nt JOIN info USING (session_id)""",
    "ingest_diagnostic": f"""
, lost AS (SELECT e.session_id, e.line, row_number() OVER (PARTITION BY e.session_id ORDER BY e.line) AS rn FROM ev e JOIN (SELECT session_id, max(line) AS last_line FROM turns0 GROUP BY 1) m USING (session_id)
 WHERE event_type IN ('view', 'click') AND line > last_line)
SELECT {SID}, 'unpaid_injection' AS kind, count(*) AS count, string_agg('line ' || line || ': never paid for', chr(10) ORDER BY line) FILTER (rn <= 5) AS sample FROM lost GROUP BY session_id""",
}


def _register(name, sql):
    @query(f"s17_table_{name}", ev_sql(sql))
    def read(spark, sf):
        return rows(spark, sf, name)


for _name in result_tables.TABLES:
    _register(_name, TWINS[_name])


STATES = f"""
, s AS (SELECT user_id AS session_id, count(*) || ':' || max(event_id) AS print, max(ts) AS last, count(*) FILTER (event_type = 'purchase') AS n FROM events GROUP BY 1),
old AS (SELECT user_id AS session_id, count(*) || ':' || max(event_id) AS print FROM events WHERE ts < TIMESTAMP '{BEFORE}' GROUP BY 1),
origin AS (SELECT s.session_id, CASE WHEN old.print = s.print AND last <= TIMESTAMP '{BEFORE}' - INTERVAL 5 MINUTE THEN 'stored' ELSE 'computed' END AS origin, last FROM s LEFT JOIN old USING (session_id) WHERE n > 0)
"""


@query("s20_incremental_run", ev_sql(STATES + """
SELECT session_id, CAST(total_micros AS BIGINT) AS total_micros, CAST(attributed_micros AS BIGINT) AS attributed_micros, origin FROM rec JOIN origin USING (session_id)"""))
def s20(spark, sf):
    """A run over a log that has grown: what the run before stored is served, the rest computed and stored."""
    store, raw = fresh_store(spark), events.raw_events(spark, sf)
    runs.run(store, raw.where(f"ts < TIMESTAMP '{BEFORE}'"), POLICY, events.RATES, BEFORE)
    return runs.run(store, raw, POLICY, events.RATES, AFTER)


@query("s20_second_run", ev_sql(STATES + """
SELECT session_id, CAST(total_micros AS BIGINT) AS total_micros, CASE WHEN last > (SELECT max(ts) FROM events) - INTERVAL 5 MINUTE THEN 'computed' ELSE 'stored' END AS origin FROM rec JOIN origin USING (session_id)"""))
def s20_second(spark, sf):
    """One more run over an unchanged log computes only what may still grow at the time of its last record."""
    now = str(events.raw_events(spark, sf).agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()[0])
    return runs.run(full(spark, sf), events.raw_events(spark, sf), POLICY, events.RATES, now).select("session_id", "total_micros", "origin")


@query("s24_stored_results", ev_sql("""
SELECT CAST(r.session_id AS VARCHAR) AS session_id, CAST(total_micros AS BIGINT) AS total_micros, CAST(attributed_micros AS BIGINT) AS attributed_micros, CAST(unattributed_micros AS BIGINT) AS unattributed_micros,
 (SELECT count(*) FROM att a WHERE a.session_id = r.session_id) + CASE WHEN unattributed_micros <> 0 THEN 1 ELSE 0 END AS attributions FROM rec r"""))
def s24_results(spark, sf):
    """What each stored result concludes, from its own rows."""
    return stored_results(full(spark, sf), POLICY).select("session_id", "total_micros", "attributed_micros", "unattributed_micros", "attributions")


@query("r3_merged_store", ev_sql("SELECT CAST(session_id AS VARCHAR) AS session_id, CASE WHEN attributed_micros + unattributed_micros <> total_micros THEN 'total' END AS fault FROM rec"))
def r3_merged(spark, sf):
    store = full(spark, sf)
    return restored(*[store.read(t, POLICY) for t in ("charge", "turn", "attribution", "analysis_result")]).select("session_id", "fault")
