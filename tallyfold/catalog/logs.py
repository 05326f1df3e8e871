"""Ingest queries on JSON-lines logs derived from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfold.catalog import derived
from tallyfold.catalog.ev_sql import ev_sql
from tallyfold.catalog.registry import query
from tallyfold.operators import anchors, ledger, sizing
from tallyfold.sources import events, logs

# DuckDB side: the same facts straight from the event columns, never through JSON text.
FX = """
, base AS (SELECT *, 2 * line - 1 AS bl, CASE WHEN event_id % 17 = 0 THEN 2 ELSE 1 END AS copies FROM ident),
ln AS (SELECT *, bl + c AS fl FROM base, (VALUES (0), (1)) v(c) WHERE c < copies),
kindof AS (SELECT *, CASE event_type WHEN 'purchase' THEN CASE WHEN k IN (11, 15) THEN 'ignored' WHEN k IN (1, 2, 3, 4, 10, 14, 16) THEN 'malformed' ELSE 'turn' END
 WHEN 'view' THEN 'result' WHEN 'click' THEN CASE WHEN k % 6 = 5 THEN 'ignored' ELSE 'attachment' END WHEN 'signup' THEN CASE WHEN k % 4 = 3 THEN 'plain' ELSE 'noise' END
 ELSE CASE WHEN k % 5 <= 1 THEN 'compaction' WHEN k % 5 = 2 THEN 'malformed' WHEN k % 5 = 3 THEN 'unparseable_json' WHEN k % 10 = 9 THEN 'missing_type' ELSE 'not_an_object' END END AS rec,
 1 + CAST(floor(value * 10) AS BIGINT) AS size FROM ln)
"""


def fx(select: str) -> str:
    return ev_sql(FX + select)


@query("s1_jsonl_scan_line_numbers", fx("""
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY fl) AS line, rec IN ('unparseable_json') AS broken FROM kindof"""))
def s1(spark, sf):
    lines = derived.scanned_tree(spark, sf)
    return lines.select("session_id", "line", (F.col("value") == '{"type": "user", ').alias("broken"))


@query("s2_record_routing", fx("""
SELECT CASE WHEN rec IN ('unparseable_json', 'not_an_object', 'missing_type') THEN rec WHEN event_type = 'purchase' THEN 'assistant' WHEN event_type = 'view' OR rec = 'plain' THEN 'user'
 WHEN event_type = 'click' THEN 'attachment' WHEN event_type = 'error' THEN 'system' ELSE 'ignored' END AS route, count(*) AS n FROM kindof GROUP BY 1"""))
def s2(spark, sf):
    return derived.routed_lines(spark, sf).groupBy("route").agg(F.count(F.lit(1)).alias("n"))


@query("s3_corrupt_record_capture", fx("""
, d AS (SELECT session_id, fl, CASE rec WHEN 'malformed' THEN 'malformed_record' ELSE rec END AS kind, row_number() OVER (PARTITION BY session_id, rec ORDER BY fl) AS rn FROM kindof
 WHERE rec IN ('malformed', 'unparseable_json', 'not_an_object', 'missing_type'))
SELECT session_id, kind, count(*) AS count, string_agg(fl, ',' ORDER BY fl) FILTER (rn <= 5) AS lines FROM d GROUP BY ALL"""))
def s3(spark, sf):
    found = logs.diagnostics(logs.damage(derived.routed_lines(spark, sf), "session_id"), "session_id")
    return found.select("session_id", "kind", "count", F.array_join(F.transform("sample_lines", lambda x: x.cast("string")), ",").alias("lines"))


TURN = "FROM kindof JOIN turns0 t ON t.uuid = kindof.event_id WHERE rec = 'turn'"


@query("s4_turn_extraction", fx(f"SELECT kindof.session_id, fl AS line, CAST(event_id AS VARCHAR) AS uuid, model, 'm' || event_id AS message_id, 'r' || event_id AS request_id, is_sidechain {TURN}"))
def s4(spark, sf):
    return logs.assistant_records(derived.routed_lines(spark, sf)).filter("outcome = 'turn'").select(
        "session_id", "line", "uuid", "model", "message_id", "request_id", "is_sidechain"
    )


@query("s5_usage_extraction", fx(f"SELECT kindof.session_id, fl AS line, input_tokens, write_5m, write_1h, write_unknown, read_tokens, output_tokens {TURN}"))
def s5(spark, sf):
    return logs.assistant_records(derived.routed_lines(spark, sf)).filter("outcome = 'turn'").select(
        "session_id", "line", "input_tokens", "write_5m", "write_1h", "write_unknown", "read_tokens", "output_tokens"
    )


@query("s6_rollup_identity_check", fx("SELECT session_id, fl AS line FROM kindof WHERE event_type = 'purchase' AND k = 10"))
def s6(spark, sf):
    return logs.assistant_records(derived.routed_lines(spark, sf)).filter("why LIKE 'the iterations%'").select("session_id", "line")


@query("f12_strict_token_int", fx("SELECT k, count(*) AS n FROM kindof WHERE event_type = 'purchase' AND k IN (1, 2, 3, 4) GROUP BY 1"))
def f12(spark, sf):
    bad = logs.assistant_records(derived.routed_lines(spark, sf)).filter("why LIKE 'a token count%'")
    k = F.regexp_extract("value", '"output_tokens":(\\d+)', 1).cast("bigint") / 2
    return bad.groupBy(k.cast("bigint").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("p3_synthetic_model_filter", fx("""
SELECT CASE k WHEN 14 THEN 'malformed' ELSE 'ignored' END AS outcome, count(*) AS n FROM kindof WHERE event_type = 'purchase' AND k IN (14, 15) GROUP BY 1"""))
def p3(spark, sf):
    rows = logs.assistant_records(derived.routed_lines(spark, sf)).filter("model = '<synthetic>'")
    return rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("s26_tool_use_ids", fx("SELECT session_id, fl AS line, 't' || event_id AS ids FROM kindof WHERE event_type = 'purchase'"))
def s26(spark, sf):
    rows = logs.assistant_records(derived.routed_lines(spark, sf))
    return rows.select("session_id", "line", F.array_join("tool_use_ids", ",").alias("ids"))


@query("a28_version_span", fx("""
SELECT session_id, count(DISTINCT k % 3) AS versions, count(DISTINCT k % 3) > 1 AS spans FROM kindof WHERE event_type = 'purchase' GROUP BY 1"""))
def a28(spark, sf):
    rows = logs.assistant_records(derived.routed_lines(spark, sf))
    return rows.groupBy("session_id").agg(F.size(F.collect_set("version")).cast("bigint").alias("versions")).withColumn(
        "spans", F.col("versions") > 1
    )


@query("s7_tool_result_extraction", fx("""
SELECT session_id, fl AS line, 't' || event_id AS tool_use_id, 'Read' AS tool_name, CAST(CASE WHEN k % 8 = 5 THEN 0 ELSE 4 END AS BIGINT) AS text_length FROM kindof WHERE rec = 'result'"""))
def s7(spark, sf):
    return logs.tool_results(derived.routed_lines(spark, sf)).select("session_id", "line", "tool_use_id", "tool_name", "text_length")


@query("p12_logged_item_identification", fx("""
SELECT session_id, fl AS line, CASE WHEN k % 8 IN (3, 4, 5) THEN NULL ELSE identity END AS identity FROM kindof WHERE rec = 'result'"""))
def p12(spark, sf):
    return logs.tool_results(derived.routed_lines(spark, sf)).select("session_id", "line", "identity")


SIZES = fx("""
SELECT session_id, fl AS line, CAST(CASE k % 8 WHEN 0 THEN size WHEN 1 THEN size WHEN 2 THEN (k + k % 7) // 4 WHEN 3 THEN k // 4 WHEN 4 THEN k // 4
 WHEN 5 THEN CASE WHEN has_turn THEN least(CAST(ceil((k + 1) * 40 * 600 / 750.0) AS BIGINT), 1600) END WHEN 6 THEN 1 ELSE 1 END AS BIGINT) AS tokens,
 CASE k % 8 WHEN 1 THEN 'exact' WHEN 5 THEN CASE WHEN has_turn THEN 'measured' ELSE 'estimated' END ELSE 'estimated' END AS basis,
 CASE k % 8 WHEN 1 THEN 'high' WHEN 5 THEN CASE WHEN has_turn THEN 'medium' ELSE 'low' END ELSE 'low' END AS confidence FROM (
 SELECT *, session_id IN (SELECT session_id FROM kindof WHERE rec = 'turn') AS has_turn FROM kindof) WHERE rec = 'result'""")

CAPS = {"m-small": 1600, "m-mid": 1600, "m-large": 1600}


def _sized(spark, sf):
    rows = derived.routed_lines(spark, sf)
    turns = logs.deduplicated(logs.assistant_records(rows).filter("outcome = 'turn'"), "session_id")
    first = turns.groupBy("session_id").agg(F.min_by("model", "line").alias("sizing_model"))
    results = logs.typed_results(rows, "session_id").join(first, "session_id", "left")
    return sizing.tool_result_sizes(results, ["session_id", "line"], "sizing_model", CAPS)


@query("p14_token_size_ladder", SIZES)
def p14(spark, sf):
    return _sized(spark, sf).select("session_id", "line", "q.tokens", "q.basis", "q.confidence")


def _shape(name: str, n: int, method: str):
    sql = fx(f"SELECT session_id, fl AS line, {method} AS method FROM kindof WHERE rec = 'result' AND k % 8 = {n}")

    @query(name, sql)
    def run(spark, sf):
        return _sized(spark, sf).filter(_SHAPES[n]).select("session_id", "line", "q.method")


_SHAPES = {
    0: "is_variant_null(try_variant_get(payload, '$.file')) = false AND try_variant_get(payload, '$.file') IS NOT NULL",
    1: "q.basis = 'exact'",
    2: "try_variant_get(payload, '$.stdout') IS NOT NULL",
    7: "try_variant_get(payload, '$.n') IS NOT NULL",
}
EST = "'character-based estimate (NOT a measurement): ' || "
_shape("p29_recorded_count_tier", 1, "'count recorded in the tool result (' || size || ' tokens)'")
_shape("p30_read_result_sizing", 0, EST + "(size * 4) || ' chars of file.content of ' || identity || ' / 4; 3 of ' || (k % 5 + 1) || ' lines (' || CASE WHEN 3 >= k % 5 + 1 THEN 'whole file' ELSE 'PARTIAL read' END || ')'")
_shape("p31_shell_result_sizing", 2, EST + "(k + k % 7) || ' chars of shell stdout + stderr / 4 (interrupted)'")


@query("p32_generic_sizing", fx("""
SELECT k % 8 AS shape, CAST(sum(1) AS BIGINT) AS tokens, count(*) AS n FROM kindof WHERE rec = 'result' AND k % 8 >= 6 GROUP BY 1"""))
def p32(spark, sf):
    shape = F.when(F.expr("try_variant_get(payload, '$.n') IS NOT NULL"), 7).when(F.expr("try_variant_get(payload, '$.nested') IS NOT NULL"), 6)
    rows = _sized(spark, sf).withColumn("shape", shape.cast("bigint")).filter("shape IS NOT NULL")
    return rows.groupBy("shape").agg(F.sum("q.tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))


@query("p17_image_sizing", fx("""
SELECT session_id, fl AS line, (k + 1) * 40 AS width, CAST(600 AS BIGINT) AS height, least(CAST(ceil((k + 1) * 40 * 600 / 750.0) AS BIGINT), 1600) AS tokens FROM kindof WHERE rec = 'result' AND k % 8 = 5"""))
def p17(spark, sf):
    results = logs.tool_results(derived.routed_lines(spark, sf)).filter(F.size("content_walk.images") > 0)
    blobs = results.select("session_id", "line", F.explode("content_walk.images").alias("i")).select(
        "session_id", "line", "i.decoded", "i.width", "i.height", F.lit("m-small").alias("model")
    )
    sized = sizing.sized_images(blobs, ["session_id", "line"], "model", CAPS)
    return sized.select("session_id", "line", "width", "height", "q.tokens")


@query("p33_multi_image_result", fx("""
SELECT session_id, CAST(sum(least(CAST(ceil((k + 1) * 40 * 600 / 750.0) AS BIGINT), 1600)) AS BIGINT) AS tokens, count(*) AS images FROM kindof WHERE rec = 'result' AND k % 8 = 5 GROUP BY 1"""))
def p33(spark, sf):
    """All images of a session combined as the parts of one quantity."""
    results = logs.tool_results(derived.routed_lines(spark, sf)).filter(F.size("content_walk.images") > 0)
    blobs = results.select("session_id", F.explode("content_walk.images").alias("i")).select("session_id", "i.decoded", "i.width", "i.height", F.lit("m-small").alias("model"))
    sized = sizing.sized_images(blobs, ["session_id"], "model", CAPS).select("session_id", "q.tokens", "q.basis", "q.confidence")
    counts = sized.groupBy("session_id").agg(F.count(F.lit(1)).alias("images"))
    return sizing.combine(sized, ["session_id"]).select("session_id", "tokens").join(counts, "session_id")


@query("f9_nested_text_length", fx("""
SELECT k % 8 AS shape, CAST(sum(CASE k % 8 WHEN 0 THEN size * 4 WHEN 4 THEN k ELSE 0 END) AS BIGINT) AS chars FROM kindof WHERE rec = 'result' AND k % 8 NOT IN (3) GROUP BY 1"""))
def f9(spark, sf):
    return _walks(spark, sf, "content_chars")


def _walks(spark, sf, field):
    """Walk totals per payload shape; the shape comes back from the event number."""
    rows = logs.tool_results(derived.routed_lines(spark, sf)).filter(F.col("payload_walk.json_chars") > 0)
    known = events.raw_events(spark, sf).select(
        F.col("event_id").cast("string").alias("uuid"), (F.get_json_object("props", "$.k").cast("bigint") % 8).alias("shape")
    )
    return rows.join(known, "uuid").groupBy("shape").agg(F.sum(f"payload_walk.{field}").alias("chars"))


@query("f10_text_characters", fx("""
SELECT k % 8 AS shape, CAST(sum(CASE k % 8 WHEN 4 THEN k WHEN 6 THEN 5 ELSE 0 END) AS BIGINT) AS chars FROM kindof WHERE rec = 'result' AND k % 8 NOT IN (3) GROUP BY 1"""))
def f10(spark, sf):
    return _walks(spark, sf, "text_chars")


@query("f11_image_block_finder", fx("SELECT session_id, fl AS line, 'toolUseResult[0]' AS place, 'image/png' AS media_type FROM kindof WHERE rec = 'result' AND k % 8 = 5"))
def f11(spark, sf):
    rows = logs.tool_results(derived.routed_lines(spark, sf))
    return rows.select("session_id", "line", F.explode("content_walk.images").alias("i")).select("session_id", "line", "i.place", "i.media_type")


ATT = "FROM kindof WHERE rec = 'attachment'"
ATT_LEN = "CASE k % 6 WHEN 0 THEN size * 4 WHEN 1 THEN k WHEN 2 THEN CASE WHEN k % 4 = 0 THEN 0 ELSE 15 + k END ELSE 0 END"


@query("s8_attachment_extraction", fx(f"""
SELECT session_id, fl AS line, CASE k % 6 WHEN 0 THEN 'file' WHEN 1 THEN 'edited_text_file' WHEN 2 THEN 'skill_listing' WHEN 3 THEN 'deferred_tools_delta' ELSE 'directory' END AS attachment_type,
 CASE WHEN k % 6 <= 1 THEN identity WHEN k % 6 = 4 THEN '/repo' END AS identity, CAST({ATT_LEN} AS BIGINT) AS text_length {ATT}"""))
def s8(spark, sf):
    return logs.attachments(derived.routed_lines(spark, sf)).select("session_id", "line", "attachment_type", "identity", "text_length")


@query("f13_first_present_string", fx(f"SELECT CASE WHEN k % 6 <= 1 THEN identity WHEN k % 6 = 4 THEN '/repo' END AS identity, count(*) AS n {ATT} GROUP BY 1"))
def f13(spark, sf):
    return logs.attachments(derived.routed_lines(spark, sf)).groupBy("identity").agg(F.count(F.lit(1)).alias("n"))


@query("p16_attachment_sizing", fx(f"""
SELECT session_id, fl AS line, CAST(CASE WHEN {ATT_LEN} > 0 THEN ({ATT_LEN}) // 4 WHEN k % 6 = 3 THEN (k + 1) * 12 END AS BIGINT) AS tokens {ATT}"""))
def p16(spark, sf):
    rows = logs.attachments(derived.routed_lines(spark, sf))
    q = sizing.attachment_size(F.col("attachment_type"), F.col("text_length"), F.col("added_lines"))
    return rows.select("session_id", "line", q.alias("q")).select("session_id", "line", "q.tokens")


SKILLS = fx("""
SELECT session_id, fl AS line, name, CAST(CASE WHEN k % 4 = 0 THEN 1 WHEN name = 'a' THEN 6 + k ELSE 9 END AS BIGINT) AS chars, CASE name WHEN 'a' THEN 'unstated' ELSE 'plugin' END AS origin, k % 4 <> 0 AS measured
FROM kindof, (VALUES ('a'), ('b:c')) v(name) WHERE rec = 'attachment' AND k % 6 = 2""")


@query("a21_listing_split", SKILLS)
def a21(spark, sf):
    rows = logs.attachments(derived.routed_lines(spark, sf)).filter("attachment_type = 'skill_listing'")
    return logs.listed_skills(rows, ["session_id", "line"]).select("session_id", "line", "name", "chars", "origin", "measured")


@query("f15_skill_origin", fx("""
SELECT name, CASE name WHEN 'a' THEN 'unstated' ELSE 'plugin' END AS origin, CASE name WHEN 'a' THEN NULL ELSE 'b' END AS plugin, count(*) AS n
FROM kindof, (VALUES ('a'), ('b:c')) v(name) WHERE rec = 'attachment' AND k % 6 = 2 GROUP BY 1"""))
def f15(spark, sf):
    rows = logs.attachments(derived.routed_lines(spark, sf)).filter("attachment_type = 'skill_listing'")
    return logs.listed_skills(rows, ["session_id", "line"]).groupBy("name", "origin", "plugin").agg(F.count(F.lit(1)).alias("n"))


@query("s9_compaction_extraction", fx("""
, lg AS (SELECT session_id, line, lag(event_id, 1) OVER w AS p1, lag(event_id, 2) OVER w AS p2 FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY line))
SELECT x.session_id, fl AS line, 1000 * k AS pre_tokens, 100 * k AS post_tokens, 1500 * k AS cumulative_tokens,
 CASE WHEN p2 IS NULL AND p1 IS NULL THEN 'none' WHEN p2 IS NULL THEN 'none,' || p1 ELSE p2 || ',' || p1 END AS preserved FROM kindof x JOIN lg USING (session_id, line) WHERE rec = 'compaction'"""))
def s9(spark, sf):
    rows = logs.compactions(derived.routed_lines(spark, sf)).filter("outcome = 'compaction'")
    return rows.select("session_id", "line", "pre_tokens", "post_tokens", "cumulative_tokens", F.array_join("preserved", ",").alias("preserved"))


def _reports(spark, sf):
    v = F.col("v")
    text = F.try_variant_get(v, "$.message.content[0].text", "string")
    rows = derived.routed_lines(spark, sf).filter("route = 'user'").filter(F.try_variant_get(v, "$.isMeta", "boolean"))
    keyed = rows.select(F.concat_ws(":", "session_id", "line").alias("key"), text.alias("text"))
    return keyed.filter(anchors.looks_like_report(F.col("text")))


@query("s22_anchor_scan", fx("SELECT session_id || ':' || fl AS key FROM kindof WHERE rec = 'plain'"))
def s22(spark, sf):
    return _reports(spark, sf).select("key")


@query("m18_anchor_report_parse", fx("""
SELECT session_id || ':' || fl AS key, label, CAST(tokens AS BIGINT) AS tokens, CAST(step AS BIGINT) AS step, approximate, 'Categories' AS section FROM (
SELECT session_id, fl, 'System prompt' AS label, k * 1000 + 500 AS tokens, 100 AS step, TRUE AS approximate FROM kindof WHERE rec = 'plain'
UNION ALL SELECT session_id, fl, 'Messages', k * 10, 1, FALSE FROM kindof WHERE rec = 'plain')"""))
def m18(spark, sf):
    return anchors.parse_reports(_reports(spark, sf), "key", "text").select("key", "label", "tokens", "step", "approximate", "section")


@query("s10_session_listing", fx("""
SELECT session_id, count(*) FILTER (rec NOT IN ('unparseable_json', 'not_an_object')) AS record_count,
 (SELECT 'Session ' || arg_max(b.k, b.fl) || ' of the user' FROM kindof b WHERE b.session_id = a.session_id AND b.event_type = 'signup' AND b.k % 4 = 0) AS title FROM kindof a GROUP BY 1"""))
def s10(spark, sf):
    rows = logs.routed(derived.scanned_tree(spark, sf))
    return logs.listing(rows, None, ["session_id"], F.current_timestamp()).select("session_id", "record_count", "title")


@query("s11_sidechain_attach", fx("""
SELECT session_id, count(*) + count(*) FILTER (event_type = 'purchase' AND k % 13 = 0) AS record_count FROM kindof WHERE rec NOT IN ('unparseable_json', 'not_an_object') GROUP BY 1"""))
def s11(spark, sf):
    """Sidechain lines count towards the session's records (here: its sidechain turns again)."""
    rows = logs.routed(derived.scanned_tree(spark, sf))
    side = rows.filter(F.try_variant_get("v", "$.isSidechain", "boolean")).withColumn("path", F.concat("path", F.lit("/subagents/a.jsonl")))
    return logs.listing(rows, side, ["session_id"], F.current_timestamp()).select("session_id", "record_count")


@query("s12_coverage_fingerprint", fx("""
, u AS (SELECT session_id, fl, CASE WHEN event_type IN ('purchase', 'view', 'click') OR rec IN ('plain', 'compaction') THEN CAST(event_id AS VARCHAR) WHEN rec = 'missing_type' THEN 'x' END AS uuid, rec FROM kindof)
SELECT session_id, count(*) FILTER (rec NOT IN ('unparseable_json', 'not_an_object')) || ':' || arg_max(uuid, fl) FILTER (uuid IS NOT NULL) AS print FROM u GROUP BY 1"""))
def s12(spark, sf):
    """Records, last id and bytes; the bytes depend on the JSON text, so the check leaves them out."""
    rows = logs.routed(derived.scanned_tree(spark, sf))
    got = logs.listing(rows, None, ["session_id"], F.current_timestamp())
    return got.select("session_id", F.regexp_replace("fingerprint", ":[^:]*$", "").alias("print"))


@query("r1_logged_sessions_reconciled", fx("""
SELECT t.session_id, CAST(sum(total_micros) AS BIGINT) AS total_micros, count(*) AS turns FROM turns t JOIN (SELECT DISTINCT event_id FROM kindof WHERE rec = 'turn') x ON x.event_id = t.uuid GROUP BY 1"""))
def r1(spark, sf):
    """From log text to reconciled sessions: replays dropped, items sized, costs split exactly."""
    parsed = logs.parse(derived.routed_lines(spark, sf), "session_id")
    m = ledger.build(logs.canonical(parsed, "session_id", caps=CAPS), events.RATES, survivors_of=logs.survivors_of)
    turns = m.turns.groupBy("session_id").agg(F.count(F.lit(1)).alias("turns"))
    checked = ledger.reconcile(m.turns, m.attributions).filter("unattributed_micros >= 0")
    return checked.join(turns, "session_id").select("session_id", "total_micros", "turns")
