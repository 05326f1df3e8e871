"""Queries on turns, items, spans and joins of the events binding."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfold.catalog.ev import long, model
from tallyfold.catalog.ev_sql import ev_sql
from tallyfold.catalog.registry import query
from tallyfold.functions import money, paths
from tallyfold.operators import ledger as lg
from tallyfold.operators import residency as res
from tallyfold.operators import turns as tn
from tallyfold.plans import scan
from tallyfold.sources import events


@query("p5_turn_pricing", ev_sql("""
SELECT session_id, turn_index, fresh_micros, write_micros, read_micros, output_micros, total_micros, confidence_cap FROM turns"""))
def p5(spark, sf):
    return model(spark, sf).turns.select(
        "session_id", "turn_index", *long("fresh_micros", "write_micros", "read_micros", "output_micros", "total_micros"),
        "confidence_cap",
    )


@query("p7_prompt_size", ev_sql("SELECT session_id, turn_index, prompt_tokens FROM turns"))
def p7(spark, sf):
    return model(spark, sf).turns.select("session_id", "turn_index", "prompt_tokens")


@query("p8_ttl_label", ev_sql("""
SELECT session_id, turn_index, CASE WHEN write_5m > 0 AND write_1h = 0 THEN '5m' WHEN write_1h > 0 AND write_5m = 0 THEN '1h'
  WHEN write_tokens > 0 THEN 'unknown' END AS ttl FROM turns"""))
def p8(spark, sf):
    return model(spark, sf).turns.select("session_id", "turn_index", tn.ttl_label().alias("ttl"))


@query("p34_write_multiplier_by_window", ev_sql("""
SELECT session_id, turn_index, '5m' AS ttl_window, write_5m AS tokens, CAST(1250000 AS BIGINT) AS multiplier_millionths, CAST(NULL AS VARCHAR) AS confidence_cap
FROM turns WHERE write_5m > 0 UNION ALL
SELECT session_id, turn_index, '1h', write_1h, 2000000, NULL FROM turns WHERE write_1h > 0 UNION ALL
SELECT session_id, turn_index, 'unknown', write_unknown, 1250000, 'low' FROM turns WHERE write_unknown > 0"""))
def p34(spark, sf):
    return tn.write_windows(model(spark, sf).turns, events.RATES.cache)


@query("j1_rate_lookup", ev_sql("SELECT session_id, turn_index, model, CAST(input_rate AS BIGINT) AS input_rate, CAST(output_rate AS BIGINT) AS output_rate FROM turns"))
def j1(spark, sf):
    return model(spark, sf).turns.select("session_id", "turn_index", "model", "input_rate", "output_rate")


@query("p35_threshold_lookup", ev_sql("""
SELECT model, CAST(any_value(threshold) AS BIGINT) AS threshold, any_value(threshold) IS NULL AS unknown_threshold, count(*) AS turns FROM turns GROUP BY model"""))
def p35(spark, sf):
    return (
        model(spark, sf).turns.groupBy("model")
        .agg(F.any_value("threshold").alias("threshold"), F.count(F.lit(1)).alias("turns"))
        .withColumn("unknown_threshold", F.col("threshold").isNull())
    )


@query("p4_unpriceable_session_filter", ev_sql("""
SELECT session_id, count(*) AS turns, string_agg(DISTINCT model, ',' ORDER BY model) AS unpriced_models
FROM turns WHERE model = 'm-mid' GROUP BY session_id"""))
def p4(spark, sf):
    """Sessions that a sweep drops by name when the table has no rate for one of their models."""
    return tn.unpriceable(model(spark, sf).turns.select("session_id", "model"), events.RATES.frame(spark).filter("model <> 'm-mid'"))


@query("p4_sweep_goes_on", ev_sql("""
SELECT session_id, CASE WHEN count(*) FILTER (model = 'm-mid') = 0 THEN CAST(sum(total_micros) AS BIGINT) END AS total_micros,
 string_agg(DISTINCT model, ',') FILTER (model = 'm-mid') AS unpriced_models FROM turns GROUP BY session_id"""))
def p4_sweep(spark, sf):
    """Cost of every session by a table that lacks a model: sessions with such turns are named and have no cost, the others are priced."""
    few = replace(events.RATES, models=tuple(m for m in events.RATES.models if m[0] != "m-mid"))
    turns = model(spark, sf).turns.drop("input_rate", "output_rate", "threshold")
    skipped = tn.unpriceable(turns.select("session_id", "model"), few.frame(spark))
    paid = lg.priced(turns.join(skipped.select("session_id"), "session_id", "left_anti"), few)
    totals = paid.groupBy("session_id").agg(F.sum("total_micros").alias("total_micros"))
    none = F.lit(None)
    return totals.withColumn("unpriced_models", none.cast("string")).unionByName(skipped.select("session_id", none.cast("bigint").alias("total_micros"), "unpriced_models"))


@query("p13_model_id_normalisation", ev_sql("""
SELECT 'anthropic/' || model || '-20240101[1m]' AS model, model AS priced_model, count(*) AS turns FROM turns GROUP BY model"""))
def p13(spark, sf):
    from tallyfold.sources.rates import resolve_models

    spelled = model(spark, sf).turns.select(
        F.concat(F.lit("anthropic/"), "model", F.lit("-20240101[1m]")).alias("model")
    )
    counted = spelled.groupBy("model").agg(F.count(F.lit(1)).alias("turns"))
    return resolve_models(counted, events.RATES.frame(spark)).join(counted, "model")


@query("w2_turn_ordinals", ev_sql("SELECT session_id, line, turn_index FROM turns"))
def w2(spark, sf):
    return model(spark, sf).turns.select("session_id", "line", "turn_index")


@query("w3_model_switch", ev_sql("""
SELECT session_id, turn_index, prev_model, model FROM turns WHERE turn_index >= 1 AND prev_model <> model"""))
def w3(spark, sf):
    return model(spark, sf).turns.filter(
        (F.col("turn_index") >= 1) & ~F.col("model").eqNullSafe(F.col("prev_model"))
    ).select("session_id", "turn_index", "prev_model", "model")


@query("j2_forward_asof", ev_sql("SELECT session_id, line, turn_index FROM inj"))
def j2(spark, sf):
    return model(spark, sf).injections.select("session_id", "line", "turn_index")


@query("j3_backward_asof", ev_sql("SELECT session_id, line, comp_index, boundary_turn FROM comp"))
def j3(spark, sf):
    return model(spark, sf).compactions.select("session_id", "line", "comp_index", *long("boundary_turn"))


@query("j6_attachment_paying_turn", ev_sql("""
SELECT e.session_id, e.line, min(t.turn_index) AS turn_index FROM ev e JOIN turns0 t ON t.session_id = e.session_id AND t.line > e.line
WHERE e.event_type = 'signup' GROUP BY ALL"""))
def j6(spark, sf):
    return (
        model(spark, sf).placed.filter(F.col("is_change") & (F.col("turns_before") < F.col("n_turns")))
        .select("session_id", "line", F.col("turns_before").alias("turn_index"))
    )


@query("a3_item_consolidation", ev_sql("SELECT session_id, item_id, size_tokens, basis, confidence, category FROM item"))
def a3(spark, sf):
    return model(spark, sf).items.select("session_id", "item_id", "size_tokens", "basis", "confidence", "category")


@query("a4_load_count", ev_sql("SELECT session_id, item_id, loads FROM loads"))
def a4(spark, sf):
    return model(spark, sf).items.select("session_id", "item_id", "loads")


@query("j5_survivor_semi_join", ev_sql("""
SELECT i.session_id, i.item_id, min(c.comp_index) AS from_index, max(c.comp_index) AS to_index, count(*) AS survived
FROM (SELECT DISTINCT session_id, item_id FROM inj) i JOIN comp c USING (session_id)
WHERE EXISTS (SELECT 1 FROM inj p WHERE p.session_id = i.session_id AND p.item_id = i.item_id AND p.pinned AND p.line < c.line)
GROUP BY ALL"""))
def j5(spark, sf):
    """The run of compactions each item survives.

    A pinned injection is on the list of every later compaction of its session, so the first one
    decides; the run is kept as an interval and never unfolded into (item, compaction) pairs.
    """
    last = F.col("n_comps") - 1
    return (
        model(spark, sf).injections.filter("pinned").groupBy(*res.SESSION_ITEM)
        .agg(F.min("comp_index").alias("from_index"), F.max("n_comps").alias("n_comps"))
        .filter(F.col("from_index") <= last)
        .select(*res.SESSION_ITEM, "from_index", last.alias("to_index"), (last - F.col("from_index") + 1).alias("survived"))
    )


@query("w4_residency_islands", ev_sql("""
SELECT session_id, item_id, first_turn, last_turn, end_reason, injections, opened_line, empty_span FROM span"""))
def w4(spark, sf):
    return model(spark, sf).spans.select(
        "session_id", "item_id", *long("first_turn", "last_turn"), "end_reason", *long("injections", "opened_line"), "empty_span"
    )


@query("w7_span_order", ev_sql("""
SELECT session_id, item_id, opened_line, row_number() OVER (PARTITION BY session_id ORDER BY opened_line) AS span_no FROM span"""))
def w7(spark, sf):
    m = model(spark, sf)
    spans = m.spans.select("session_id", "item_id", "opened_line")
    run = scan.scan_session(spans, ["session_id"], "opened_line", counts={"before": F.lit(1).cast("bigint")})
    return run.select("session_id", "item_id", "opened_line", (F.col("before") + 1).alias("span_no"))


@query("a5_turns_resident", ev_sql("""
SELECT session_id, item_id, CAST(sum(turns_held) AS BIGINT) AS turns_resident FROM span GROUP BY ALL"""))
def a5(spark, sf):
    return model(spark, sf).spans.groupBy(*res.SESSION_ITEM).agg(
        F.sum("turns_held").cast("bigint").alias("turns_resident")
    )


@query("a6_residual_drop", ev_sql("""
SELECT session_id, max(cumulative_tokens - greatest(0, pre_tokens - post_tokens)) AS residual FROM comp GROUP BY 1
HAVING max(cumulative_tokens - greatest(0, pre_tokens - post_tokens)) > 0"""))
def a6(spark, sf):
    dropped = F.greatest(F.lit(0), F.col("pre_tokens") - F.col("post_tokens"))
    return (
        model(spark, sf).compactions.groupBy("session_id")
        .agg(F.max(F.col("cumulative_tokens") - dropped).alias("residual"))
        .filter("residual > 0")
    )


@query("f17_dropped_tokens", ev_sql("SELECT session_id, line, greatest(0, pre_tokens - post_tokens) AS dropped_tokens FROM comp"))
def f17(spark, sf):
    return model(spark, sf).compactions.select(
        "session_id", "line", F.greatest(F.lit(0), F.col("pre_tokens") - F.col("post_tokens")).cast("bigint").alias("dropped_tokens")
    )


@query("j4_interval_stab", ev_sql("SELECT session_id, turn_index, item_id, size_tokens, pos FROM res"))
def j4(spark, sf):
    return res.resident(model(spark, sf).spans).select(
        "session_id", "turn_index", "item_id", "size_tokens", F.col("opened_line").alias("pos")
    )


@query("j13_opening_injection", ev_sql("""
SELECT s.session_id, s.item_id, s.opened_line, i.uuid AS opened_uuid FROM span s JOIN inj i
ON i.session_id = s.session_id AND i.item_id = s.item_id AND i.line = s.opened_line"""))
def j13(spark, sf):
    return model(spark, sf).spans.select("session_id", "item_id", "opened_line", "opened_uuid")


@query("j12_positional_zip", ev_sql("""
SELECT session_id, comp_index, line, boundary_turn, uuid FROM comp"""))
def j12(spark, sf):
    """k-th compaction record with the k-th boundary; both are numbered by the same scan."""
    return tn.zip_boundaries(model(spark, sf).compactions).select("session_id", "comp_index", "line", *long("boundary_turn"), "uuid")


@query("j12_zip_of_two_sources", ev_sql("""
SELECT session_id, comp_index + 1 AS place, uuid AS event_id, boundary_turn FROM comp"""))
def j12_sources(spark, sf):
    """The k-th error event of a session, from the table itself, beside its k-th boundary, from the scanned log."""
    m = model(spark, sf)
    raw = events.raw_events(spark, sf).where("event_type = 'error'").select(F.col("user_id").alias("session_id"), "ts", "event_id")
    raw = raw.join(m.turns.select("session_id").distinct(), "session_id", "left_semi")
    bounds = m.compactions.select("session_id", "line", "boundary_turn")
    both = tn.zipped(raw, bounds, "session_id", [F.col("ts"), F.col("event_id")], [F.col("line")], "compaction records and boundaries differ in number")
    return both.select("session_id", "place", "event_id", *long("boundary_turn"))


@query("u1_event_union", ev_sql("""
SELECT session_id, line, kind FROM (
SELECT session_id, line, 'injection' AS kind FROM inj UNION ALL SELECT session_id, line, 'compaction' FROM comp)"""))
def u1(spark, sf):
    m = model(spark, sf)
    return m.injections.select("session_id", "line", F.lit("injection").alias("kind")).unionByName(
        m.compactions.select("session_id", "line", F.lit("compaction").alias("kind"))
    )


@query("p9_category_classification", ev_sql("""
SELECT category, count(*) AS injections, count(DISTINCT item_id) AS items FROM inj GROUP BY 1"""))
def p9(spark, sf):
    rows = model(spark, sf).injections.select(
        "item_id", paths.category(F.col("identity"), F.col("kind")).alias("category")
    )
    per_item = rows.groupBy("category", "item_id").agg(F.count(F.lit(1)).alias("n"))
    return per_item.groupBy("category").agg(F.sum("n").alias("injections"), F.count(F.lit(1)).alias("items"))


@query("p12_item_identification", ev_sql("""
SELECT session_id, line, kind, identity, cause FROM inj"""))
def p12(spark, sf):
    return model(spark, sf).injections.select("session_id", "line", "kind", "identity", "cause")


@query("m15_sidechain_rollup", ev_sql("""
SELECT session_id, count(*) FILTER (is_sidechain) AS sidechain_turns, CAST(sum(CASE WHEN is_sidechain THEN total_micros ELSE 0 END) AS BIGINT) AS sidechain_micros,
CAST(sum(total_micros) AS BIGINT) AS total_micros FROM turns GROUP BY 1"""))
def m15(spark, sf):
    return model(spark, sf).turns.groupBy("session_id").agg(
        F.count_if("is_sidechain").alias("sidechain_turns"),
        F.sum(F.when(F.col("is_sidechain"), F.col("total_micros")).otherwise(0)).cast("bigint").alias("sidechain_micros"),
        F.sum("total_micros").alias("total_micros"),
    )


DUP_SQL = """
, copies AS (SELECT *, 0 AS file_rank FROM turns UNION ALL
 SELECT * REPLACE (CASE WHEN uuid % 34 = 0 THEN output_tokens + 1 ELSE output_tokens END AS output_tokens), 1 FROM turns WHERE uuid % 17 = 0)
"""


@query("a1_first_wins_dedup", ev_sql(DUP_SQL + """
SELECT session_id, uuid, line, output_tokens, CAST(file_rank AS BIGINT) AS file_rank FROM (
SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY file_rank, line) AS rn FROM copies) WHERE rn = 1"""))
def a1(spark, sf):
    copies = tn.with_replays(model(spark, sf).turns)
    kept = tn.first_wins(copies, ["uuid"], ["file_rank", "line"], ["session_id", "output_tokens"])
    return kept.select("session_id", "uuid", "line", "output_tokens", F.col("file_rank").cast("bigint").alias("file_rank"))


@query("a2_dedup_accounting", ev_sql(DUP_SQL + """
SELECT count(*) AS input_count, count(*) FILTER (rn = 1) AS kept, count(*) FILTER (rn > 1) AS dropped,
count(*) FILTER (rn > 1 AND output_tokens <> first_output) AS conflicts FROM (
SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY file_rank, line) AS rn,
 first_value(output_tokens) OVER (PARTITION BY uuid ORDER BY file_rank, line) AS first_output FROM copies)"""))
def a2(spark, sf):
    copies = tn.with_replays(model(spark, sf).turns)
    usage = ["input_tokens", "write_5m", "write_1h", "write_unknown", "read_tokens", "output_tokens"]
    return tn.dedup_accounting(copies, ["uuid"], ["file_rank", "line"], usage)


@query("j11_parent_turn", ev_sql("""
SELECT t.session_id, t.uuid, p.uuid AS parent_uuid FROM turns t LEFT JOIN turns p
ON p.session_id = t.session_id AND p.uuid = t.uuid - t.k AND p.uuid <> t.uuid"""))
def j11(spark, sf):
    """A parent link is kept only when it names another turn of the same session."""
    turns = model(spark, sf).turns.select("session_id", "uuid", (F.col("uuid") - F.col("k")).alias("claimed"))
    return tn.parent_links(turns)


@query("u4_missing_ids", """
WITH known AS (SELECT DISTINCT user_id AS session_id FROM events)
SELECT session_id FROM (SELECT DISTINCT c_custkey % 997 AS session_id FROM customer) WHERE session_id NOT IN (SELECT session_id FROM known)""")
def u4(spark, sf):
    wanted = spark.read.parquet(f"{sf}/customer.parquet").select((F.col("c_custkey") % 997).alias("session_id"))
    known = events.raw_events(spark, sf).select(F.col("user_id").alias("session_id"))
    return wanted.distinct().join(known, "session_id", "left_anti")


SELECT_SQL = """
WITH s AS (SELECT user_id AS session_id, max(ts) AS modified FROM events GROUP BY 1),
x AS (SELECT * FROM s WHERE session_id % 7 <> 3)
SELECT session_id, row_number() OVER (ORDER BY modified DESC, session_id DESC) AS newest_rank FROM x
QUALIFY newest_rank <= 20"""


@query("p1_session_selection", SELECT_SQL)
def p1(spark, sf):
    sessions = events.raw_events(spark, sf).groupBy(F.col("user_id").alias("session_id")).agg(F.max("ts").alias("modified"))
    excluded = sessions.filter("session_id % 7 = 3").select("session_id")
    return tn.newest(tn.exclude(sessions, excluded), 20)


@query("k6_latest_sessions", """
SELECT user_id AS session_id, row_number() OVER (ORDER BY max(ts) DESC, user_id DESC) AS newest_rank FROM events GROUP BY user_id
QUALIFY newest_rank <= 5""")
def k6(spark, sf):
    sessions = events.raw_events(spark, sf).groupBy(F.col("user_id").alias("session_id")).agg(F.max("ts").alias("modified"))
    return tn.newest(sessions, 5)


@query("j8_exclusion_anti_join", ev_sql("""
SELECT session_id, total_micros, attributed_micros, unattributed_micros FROM (SELECT session_id, CAST(total_micros AS BIGINT) AS total_micros,
CAST(attributed_micros AS BIGINT) AS attributed_micros, CAST(unattributed_micros AS BIGINT) AS unattributed_micros FROM rec) WHERE session_id % 50 <> 7"""))
def j8(spark, sf):
    m = model(spark, sf)
    excluded = events.raw_events(spark, sf).filter("user_id % 50 = 7").select(F.col("user_id").alias("session_id")).distinct()
    return tn.exclude(lg.reconcile(m.turns, m.attributions), excluded)
