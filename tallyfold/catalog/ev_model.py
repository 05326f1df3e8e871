"""Queries on lanes, misses, prefix changes, splits and reconciliation of the events binding."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfold.catalog.ev import long, model
from tallyfold.catalog.ev_sql import ev_sql
from tallyfold.catalog.registry import query
from tallyfold.functions import fixed
from tallyfold.operators import changes as ch
from tallyfold.operators import checks
from tallyfold.operators import ledger as lg
from tallyfold.operators import misses as ms
from tallyfold.operators import rollups as ro
from tallyfold.operators import traces

LOOKBACK = 5


@query("m1_lane_classification", ev_sql("SELECT session_id, turn_index, item_id, model, lane, lane_reason, size_tokens FROM lane"))
def m1(spark, sf):
    return model(spark, sf).lanes.select("session_id", "turn_index", "item_id", "model", "lane", "lane_reason", "size_tokens")


@query("m2_lane_confidence", ev_sql("SELECT session_id, turn_index, item_id, lane, lane_confidence FROM lane"))
def m2(spark, sf):
    return model(spark, sf).lanes.select("session_id", "turn_index", "item_id", "lane", "lane_confidence")


@query("f18_confidence_cap", ev_sql("""
SELECT model, lane, lane_confidence, threshold IS NULL AS unknown_threshold, count(*) AS n FROM lane GROUP BY ALL"""))
def f18(spark, sf):
    return model(spark, sf).lanes.groupBy(
        "model", "lane", "lane_confidence", F.col("threshold").isNull().alias("unknown_threshold")
    ).agg(F.count(F.lit(1)).alias("n"))


MISS_SQL = f"""
, added AS (SELECT session_id, turn_index, count(*) AS blocks FROM inj GROUP BY ALL),
miss AS (
SELECT session_id, turn_index, item_id, 'never_eligible' AS cause, size_tokens || ' tokens is below the ' || threshold ||
 '-token minimum cacheable prefix on ' || model || ' — billed at full rate every turn' AS detail, lane_confidence AS confidence
 FROM lane WHERE lane = 'uncached'
UNION ALL SELECT l.session_id, l.turn_index, item_id, 'invalidated', e.detail, lane_confidence FROM lane l JOIN event e USING (session_id, turn_index)
 WHERE lane_reason = 'reload_forced'
UNION ALL SELECT session_id, last_turn, item_id, 'evicted', 'left the conversation at a compaction boundary', 'high' FROM span WHERE end_reason = 'evicted'
UNION ALL SELECT r.session_id, r.turn_index, r.item_id, 'lookback_miss', a.blocks || ' content blocks were added, past the {LOOKBACK}-block lookback a cache breakpoint walks — the prior entry could not be found', 'low'
 FROM res r JOIN turns t USING (session_id, turn_index) JOIN added a USING (session_id, turn_index)
 WHERE r.turn_index > 0 AND t.read_tokens = 0 AND a.blocks > {LOOKBACK} AND r.first_turn < r.turn_index
 AND (r.session_id, r.turn_index) NOT IN (SELECT (session_id, turn_index) FROM event)
 AND (r.session_id, r.turn_index) NOT IN (SELECT (session_id, boundary_turn) FROM comp))
"""


@query("m3_never_eligible_and_invalidated", ev_sql(MISS_SQL + "SELECT * FROM miss WHERE cause IN ('never_eligible', 'invalidated')"))
def m3(spark, sf):
    book = model(spark, sf).ledger
    return ms.ineligible(book).unionByName(ms.invalidated(book))


@query("m4_evicted_miss", ev_sql(MISS_SQL + "SELECT * FROM miss WHERE cause = 'evicted'"))
def m4(spark, sf):
    return ms.evicted(model(spark, sf).spans)


@query("m5_lookback_miss", ev_sql(MISS_SQL + "SELECT * FROM miss WHERE cause = 'lookback_miss'"))
def m5(spark, sf):
    m = model(spark, sf)
    return ms.lookback(m.ledger, lg.boundary_marks(m.compactions), LOOKBACK)


@query("a25_misses_by_cause", ev_sql(MISS_SQL + """
SELECT c.cause, count(m.cause) AS misses FROM (VALUES ('evicted'), ('invalidated'), ('never_eligible'), ('lookback_miss')) c(cause)
LEFT JOIN miss m USING (cause) GROUP BY 1"""))
def a25(spark, sf):
    m = model(spark, sf)
    return ms.by_cause(ms.all_misses(m.ledger, m.spans, lg.boundary_marks(m.compactions), LOOKBACK))


@query("m6_prefix_changes", ev_sql('SELECT session_id, turn_index, line, tier, "trigger", detail FROM chg'))
def m6(spark, sf):
    return model(spark, sf).changes.select("session_id", "turn_index", "line", "tier", "trigger", "detail")


DELTA_SQL = """
WITH ev AS (SELECT user_id AS session_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id,
 date_trunc('day', ts) AS d FROM events WHERE event_type = 'signup'),
nm AS (SELECT session_id, d, CASE WHEN k % 4 = 3 THEN 'tool' || k ELSE 'mcp__s' || (k % 3) || '__t' || k END AS name,
 CASE WHEN k % 2 = 0 THEN 'added' ELSE 'removed' END AS verb FROM ev),
srv AS (SELECT session_id, d, verb, split_part(name, '__', 2) AS server, count(*) AS n FROM nm WHERE name LIKE 'mcp\\_\\_%' ESCAPE '\\' GROUP BY ALL),
srv_text AS (SELECT session_id, d, verb, string_agg('MCP server ''' || server || ''' ' || verb || ' (' || n || CASE WHEN n = 1 THEN ' tool)' ELSE ' tools)' END, '; ' ORDER BY server) AS txt FROM srv GROUP BY ALL),
pl AS (SELECT session_id, d, verb, name, row_number() OVER (PARTITION BY session_id, d, verb ORDER BY name) AS rn,
 count(*) OVER (PARTITION BY session_id, d, verb) AS n FROM nm WHERE name NOT LIKE 'mcp\\_\\_%' ESCAPE '\\'),
pl_text AS (SELECT session_id, d, verb, CASE WHEN any_value(n) = 1 THEN 'tool ' ELSE 'tools ' END || verb || ': ' ||
 string_agg(name, ', ' ORDER BY rn) FILTER (rn <= 3) || CASE WHEN any_value(n) > 3 THEN ' +' || (any_value(n) - 3) || ' more' ELSE '' END AS txt FROM pl GROUP BY session_id, d, verb),
verbs AS (SELECT session_id, d, verb, concat_ws('; ', s.txt, p.txt) AS txt FROM srv_text s FULL JOIN pl_text p USING (session_id, d, verb))
"""


def _deltas(spark, sf):
    """Names added (even k) and removed (odd k) per session and day, as a delta would list them."""
    from tallyfold.sources import events

    k = F.get_json_object("props", "$.k").cast("bigint")
    name = F.when(k % 4 == 3, F.concat(F.lit("tool"), k.cast("string"))).otherwise(
        F.concat(F.lit("mcp__s"), (k % 3).cast("string"), F.lit("__t"), k.cast("string"))
    )
    named = events.raw_events(spark, sf).filter("event_type = 'signup'").select(
        F.col("user_id").alias("session_id"), F.date_format("ts", "yyyy-MM-dd").alias("day"), name.alias("name"), (k % 2 == 0).alias("added")
    )
    return named.groupBy("session_id", "day").agg(
        F.array_sort(F.collect_list(F.when(F.col("added"), F.col("name")))).alias("added"),
        F.array_sort(F.collect_list(F.when(~F.col("added"), F.col("name")))).alias("removed"),
    )


@query("m7_change_description", DELTA_SQL + """
SELECT session_id, strftime(d, '%Y-%m-%d') AS day, string_agg(txt, '; ' ORDER BY verb) AS detail FROM verbs GROUP BY ALL""")
def m7(spark, sf):
    return _deltas(spark, sf).select("session_id", "day", ch.describe_tool_change(F.col("added"), F.col("removed")).alias("detail"))


@query("m8b_instruction_change_description", DELTA_SQL + """
SELECT session_id, strftime(d, '%Y-%m-%d') AS day, 'skill listing changed (' || count(*) || ' skills: ' ||
 array_to_string(list_slice(list(name ORDER BY name), 1, 3), ', ') || ')' AS detail FROM nm GROUP BY ALL""")
def m8b(spark, sf):
    return _deltas(spark, sf).select("session_id", "day", ch.describe_listing(F.concat("added", "removed")).alias("detail"))


@query("f14_mcp_server", """
WITH nm AS (SELECT CASE WHEN k % 4 = 3 THEN 'tool' || k ELSE 'mcp__s' || (k % 3) || '__t' || k END AS name
 FROM (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'signup'))
SELECT CASE WHEN name LIKE 'mcp%' THEN split_part(name, '__', 2) END AS server, count(*) AS n FROM nm GROUP BY 1""")
def f14(spark, sf):
    names = _deltas(spark, sf).select(F.explode(F.concat("added", "removed")).alias("name"))
    return names.groupBy(ch.mcp_server(F.col("name")).alias("server")).agg(F.count(F.lit(1)).alias("n"))


@query("m8_one_event_per_turn", ev_sql('SELECT session_id, turn_index, event_id, tier, "trigger", detail, items_reloaded FROM event'))
def m8(spark, sf):
    return model(spark, sf).events.select(
        "session_id", "turn_index", "event_id", "tier", "trigger", "detail", "items_reloaded"
    )


@query("f16_invalidated_tiers", ev_sql("""
SELECT tier, CASE tier WHEN 'tools' THEN 'tools,system,messages' ELSE 'system,messages' END AS tiers, count(*) AS events FROM event GROUP BY tier"""))
def f16(spark, sf):
    return model(spark, sf).marks.groupBy("tier").agg(F.count(F.lit(1)).alias("events")).withColumn(
        "tiers", F.array_join(ch.invalidated_tiers(F.col("tier")), ",")
    )


@query("m9_forced_reload_cost", ev_sql("SELECT session_id, turn_index, forced_micros, basis, confidence FROM event"))
def m9(spark, sf):
    return model(spark, sf).events.select("session_id", "turn_index", "forced_micros", "basis", "confidence")


@query("j10_forced_reload_join", ev_sql("""
SELECT t.session_id, t.turn_index, t.write_micros - coalesce(e.forced_micros, 0) AS remaining FROM turns t LEFT JOIN event e USING (session_id, turn_index)"""))
def j10(spark, sf):
    return model(spark, sf).ledger.filter("row = 'turn'").select(
        "session_id", "turn_index", (F.col("t.write_micros") - F.col("forced_micros")).alias("remaining")
    )


@query("a30_invalidation_section", ev_sql("""
SELECT "trigger", count(*) AS events, CAST(sum(forced_micros) AS BIGINT) AS forced_micros, CAST(sum(items_reloaded) AS BIGINT) AS items_reloaded FROM event GROUP BY 1"""))
def a30(spark, sf):
    return model(spark, sf).events.groupBy("trigger").agg(
        F.count(F.lit(1)).alias("events"), F.sum("forced_micros").alias("forced_micros"), F.sum("items_reloaded").alias("items_reloaded")
    )


@query("m10_direct_split", ev_sql("SELECT session_id, turn_index, item_id, pos AS line, share FROM pool WHERE pool = 'direct'"))
def m10(spark, sf):
    book = model(spark, sf).ledger
    return book.filter((F.col("row") == "inj") & (F.col("t.write_micros") - F.col("forced_micros") > 0)).select(
        "session_id", "turn_index", "item_id", F.col("pos").alias("line"), "share"
    )


@query("m11_uncached_split", ev_sql("SELECT session_id, turn_index, item_id, share FROM pool WHERE pool = 'uncached'"))
def m11(spark, sf):
    book = model(spark, sf).ledger
    return book.filter((F.col("pool") == "uncached") & (F.col("t.fresh_micros") > 0)).select("session_id", "turn_index", "item_id", "share")


@query("m12_carry_split", ev_sql("SELECT session_id, turn_index, item_id, share FROM pool WHERE pool = 'cached'"))
def m12(spark, sf):
    return model(spark, sf).ledger.filter(F.col("pool") == "cached").select("session_id", "turn_index", "item_id", "share")


@query("j9_pool_lane_join", ev_sql("""
SELECT t.session_id, t.turn_index, t.read_micros AS pool, count(l.item_id) AS members FROM turns t LEFT JOIN lane l
ON l.session_id = t.session_id AND l.turn_index = t.turn_index AND l.lane = 'cached' WHERE t.read_micros > 0 GROUP BY ALL"""))
def j9(spark, sf):
    """Read pools with their cached members; a pool without members stays unattributed."""
    return model(spark, sf).ledger.filter((F.col("row") == "turn") & (F.col("t.read_micros") > 0)).select(
        "session_id", "turn_index", F.col("t.read_micros").alias("pool"), F.col("n_cached").alias("members")
    )


@query("m13_exclusive_policy", ev_sql("SELECT session_id, turn_index, item_id, share FROM pool WHERE pool = 'cached'", policy="exclusive"))
def m13(spark, sf):
    return model(spark, sf, "exclusive").ledger.filter(F.col("pool") == "cached").select("session_id", "turn_index", "item_id", "share")


@query("m14_output_and_overhead", ev_sql("""
SELECT session_id, turn_index, component, cost_micros, basis, confidence FROM att WHERE target_kind = 'prompt'"""))
def m14(spark, sf):
    return model(spark, sf).attributions.filter("target_kind = 'prompt'").select(
        "session_id", "turn_index", "component", "cost_micros", "basis", "confidence"
    )


@query("u2_attribution_union", ev_sql("""
SELECT a.session_id, a.turn_index, target_kind, target_id, component, cost_micros, basis, confidence,
 t.uuid || '@line' || t.line AS turn_ref, item_ref FROM att a JOIN turns0 t USING (session_id, turn_index)"""))
def u2(spark, sf):
    return model(spark, sf).attributions


@query("u3_remainder_row", ev_sql("""
SELECT session_id, target_kind, component, CAST(sum(cost_micros) AS BIGINT) AS cost_micros FROM (
SELECT session_id, target_kind, component, cost_micros FROM att UNION ALL SELECT session_id, 'unattributed', NULL, unattributed_micros FROM rec WHERE unattributed_micros <> 0)
GROUP BY ALL"""))
def u3(spark, sf):
    m = model(spark, sf)
    facts = m.attributions.select("session_id", "target_kind", "component", "cost_micros")
    return checks.with_remainder(facts, m.turns).groupBy("session_id", "target_kind", "component").agg(
        F.sum("cost_micros").alias("cost_micros")
    )


@query("r1_session_reconciliation", ev_sql("""
SELECT session_id, CAST(total_micros AS BIGINT) AS total_micros, CAST(attributed_micros AS BIGINT) AS attributed_micros, CAST(unattributed_micros AS BIGINT) AS unattributed_micros FROM rec"""))
def r1(spark, sf):
    m = model(spark, sf)
    return lg.reconcile(m.turns, m.attributions)


@query("r1_session_reconciliation_exclusive", ev_sql("""
SELECT session_id, CAST(total_micros AS BIGINT) AS total_micros, CAST(attributed_micros AS BIGINT) AS attributed_micros, CAST(unattributed_micros AS BIGINT) AS unattributed_micros FROM rec""", policy="exclusive"))
def r1x(spark, sf):
    m = model(spark, sf, "exclusive")
    return lg.reconcile(m.turns, m.attributions)


@query("r5_row_constraints", ev_sql("""
SELECT 'attribution' AS tbl, count(*) AS checked, count(*) FILTER (component = 'output' AND target_kind = 'item') AS violations FROM att
UNION ALL SELECT 'cache_lane', count(*), count(*) FILTER (lane = 'uncached' AND (threshold IS NULL OR size_tokens >= threshold)) FROM lane
UNION ALL SELECT 'invalidation_event', count(*), count(*) FILTER (forced_micros < 0) FROM event"""))
def r5(spark, sf):
    m = model(spark, sf)
    return checks.row_constraints(m.attributions, m.lanes, m.events)


@query("r5_tampered_rows", ev_sql("""
SELECT 'attribution' AS tbl, count(*) AS checked, count(*) FILTER (component = 'output' AND turn_index % 5 = 0) AS violations FROM att
UNION ALL SELECT 'cache_lane', count(*), count(*) FILTER (lane = 'uncached' AND turn_index % 3 = 0) FROM lane
UNION ALL SELECT 'invalidation_event', count(*), count(*) FILTER (forced_micros > 0) FROM event"""))
def r5_tampered(spark, sf):
    """The constraints on broken rows: outputs charged to items, lanes above their threshold, negative reloads."""
    m = model(spark, sf)
    moved = F.when((F.col("component") == "output") & (F.col("turn_index") % 5 == 0), "item").otherwise(F.col("target_kind"))
    large = F.when(F.col("turn_index") % 3 == 0, F.col("threshold")).otherwise(F.col("size_tokens"))
    facts = m.attributions.withColumn("target_kind", moved)
    lanes = m.lanes.withColumn("size_tokens", F.when(F.col("lane") == "uncached", large).otherwise(F.col("size_tokens")))
    return checks.row_constraints(facts, lanes, m.events.withColumn("forced_micros", -F.col("forced_micros")))


@query("r6_duplicate_write_ledger", ev_sql("""
SELECT count(*) AS turns, count(DISTINCT (session_id, turn_index)) AS distinct_turns, count(*) - count(DISTINCT (session_id, turn_index)) AS duplicates FROM turns"""))
def r6(spark, sf):
    return checks.duplicate_ledger(model(spark, sf).turns)


@query("r6_tampered_turns", ev_sql("""
SELECT count(*) + count(*) FILTER (turn_index % 10 = 0) AS turns, count(*) AS distinct_turns, count(*) FILTER (turn_index % 10 = 0) AS duplicates FROM turns"""))
def r6_tampered(spark, sf):
    """The duplicate check where every tenth turn is written twice."""
    turns = model(spark, sf).turns
    return checks.duplicate_ledger(turns.unionByName(turns.filter("turn_index % 10 = 0")))


@query("r7_single_policy", ev_sql("""
SELECT CAST(1 AS BIGINT) AS policies, count(*) > 0 AS single_policy, count(*) AS rows FROM rec"""))
def r7_single(spark, sf):
    m = model(spark, sf)
    return checks.policy_mix(lg.reconcile(m.turns, m.attributions).withColumn("policy", F.lit("proportional")))


@query("r7_policy_mix", ev_sql("""
SELECT CAST(2 AS BIGINT) AS policies, FALSE AS single_policy, 2 * count(*) AS rows FROM rec"""))
def r7(spark, sf):
    """Two runs under different policies must not be rolled up together; the check says so."""
    parts = []
    for policy in fixed.POLICIES:
        m = model(spark, sf, policy)
        parts.append(lg.reconcile(m.turns, m.attributions).withColumn("policy", F.lit(policy)))
    return checks.policy_mix(parts[0].unionByName(parts[1]))


@query("m16_figure_trace", ev_sql("""
, fig AS (SELECT *, component || ':' || coalesce(target_id, 'session') AS figure_id FROM att),
hit AS (SELECT * FROM fig WHERE figure_id LIKE 'carry:file:/repo/d1/%'),
rk AS (SELECT *, row_number() OVER (PARTITION BY figure_id ORDER BY session_id, turn_index) AS rn FROM hit)
SELECT figure_id, count(*) AS rows, CAST(sum(cost_micros) AS BIGINT) AS total_micros, CAST(sum(cost_micros) AS DOUBLE) / (SELECT total FROM tot) AS share,
 CASE max(CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence,
 string_agg(session_id || ':' || turn_index || '=' || cost_micros, ' ' ORDER BY rn) FILTER (rn <= 10) AS first_turns FROM rk GROUP BY 1"""))
def m16(spark, sf):
    """Every figure whose id holds the wanted text; an exact id wins over a substring."""
    m = model(spark, sf)
    return traces.figure_traces(m.attributions, m.turns, "carry:file:/repo/d1/")


ONE = "carry:file:/repo/d1/f1.md"


@query("m16_source_records", ev_sql(f"""
, fig AS (SELECT a.*, t.uuid || '@line' || t.line AS turn_ref FROM att a JOIN (SELECT session_id, turn_index, uuid, line FROM turns) t USING (session_id, turn_index)
 WHERE component || ':' || coalesce(target_id, 'session') = '{ONE}')
SELECT '{ONE}' AS figure_id, ref, count(*) AS facts FROM (SELECT item_ref AS ref FROM fig WHERE item_ref IS NOT NULL UNION ALL SELECT turn_ref FROM fig) GROUP BY ref"""))
def m16_refs(spark, sf):
    """The records behind one figure, which is named by its id."""
    return traces.source_refs(traces.one_figure(model(spark, sf).attributions, ONE))


@query("m17_total_trace", ev_sql("""
SELECT CAST(sum(fresh_micros) AS BIGINT) AS fresh_input, CAST(sum(write_micros) AS BIGINT) AS cache_write, CAST(sum(read_micros) AS BIGINT) AS cache_read,
CAST(sum(output_micros) AS BIGINT) AS output, CAST(sum(total_micros) AS BIGINT) AS total,
CAST(sum(write_micros) - (SELECT sum(cost_micros) FROM att WHERE component = 'direct') AS BIGINT) AS write_gap FROM turns"""))
def m17(spark, sf):
    m = model(spark, sf)
    return traces.total_trace(m.turns, m.attributions)


@query("a11_lane_rollup", ev_sql("""
, never AS (SELECT session_id, item_id, string_agg(DISTINCT model, ',' ORDER BY model) AS never_cacheable_on FROM lane WHERE lane = 'uncached' GROUP BY ALL),
unk AS (SELECT session_id, item_id, string_agg(DISTINCT model, ',' ORDER BY model) AS threshold_unknown_on FROM lane WHERE threshold IS NULL GROUP BY ALL)
SELECT l.session_id, l.item_id, CAST(cached_turns AS BIGINT) AS cached_turns, CAST(uncached_turns AS BIGINT) AS uncached_turns, CAST(loading_turns AS BIGINT) AS loading_turns,
CAST(cached_token_turns AS BIGINT) AS cached_token_turns, CAST(uncached_token_turns AS BIGINT) AS uncached_token_turns, CAST(loading_token_turns AS BIGINT) AS loading_token_turns,
coalesce(never_cacheable_on, '') AS never_cacheable_on, coalesce(threshold_unknown_on, '') AS threshold_unknown_on
FROM laneroll l LEFT JOIN never USING (session_id, item_id) LEFT JOIN unk USING (session_id, item_id)""", ranks=True))
def a11(spark, sf):
    rows = model(spark, sf).session_items
    lanes = [f"{lane}_{w}" for w in ("turns", "token_turns") for lane in fixed.LANES]
    return rows.filter(F.col("cached_turns") + F.col("uncached_turns") + F.col("loading_turns") > 0).select(
        "session_id", "item_id", *long(*lanes),
        F.array_join(F.array_sort("never_cacheable_on"), ",").alias("never_cacheable_on"),
        F.array_join(F.array_sort("threshold_unknown_on"), ",").alias("threshold_unknown_on"),
    )


@query("j14_cross_session_item_join", ev_sql("""
SELECT i.category, a.component, count(*) AS rows, CAST(sum(a.cost_micros) AS BIGINT) AS cost_micros FROM att a JOIN item i
ON i.session_id = a.session_id AND i.item_id = a.target_id WHERE a.target_kind = 'item' GROUP BY ALL"""))
def j14(spark, sf):
    m = model(spark, sf)
    return checks.attribution_items(m.attributions, m.items).groupBy("category", "component").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("cost_micros").alias("cost_micros")
    )
