"""Report queries of the events binding: totals, rollups, series, rankings and gates."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfold.catalog.ev import long, model, rollup
from tallyfold.catalog.ev_sql import ev_sql
from tallyfold.catalog.registry import query
from tallyfold.functions import fixed, money, paths
from tallyfold.operators import checks, notes, report
from tallyfold.operators import ledger as lg
from tallyfold.operators import residency as res
from tallyfold.operators import rollups as ro
from tallyfold.operators import turns as tn
from tallyfold.plans import grouped


@query("a7_session_totals", ev_sql("""
SELECT CAST(t.total AS BIGINT) AS cost_micros, CAST(t.attributed AS BIGINT) AS attributed_micros, CAST(t.unattributed AS BIGINT) AS unattributed_micros,
CAST(t.attributed AS DOUBLE) / t.total AS attributed_share, CAST(t.unattributed AS DOUBLE) / t.total AS unattributed_share,
CAST(sum(input_tokens) AS BIGINT) AS fresh_input, CAST(sum(write_tokens) AS BIGINT) AS cache_write, CAST(sum(read_tokens) AS BIGINT) AS cache_read, CAST(sum(output_tokens) AS BIGINT) AS output
FROM turns, tot t GROUP BY ALL"""))
def a7(spark, sf):
    m = model(spark, sf)
    return report.totals(m.turns, m.attributions)


@query("a8_charge_components", ev_sql("""
SELECT component, CAST(tokens AS BIGINT) AS tokens, CAST(cost AS BIGINT) AS cost_micros, CAST(cost AS DOUBLE) / (SELECT total FROM tot) AS share FROM (
SELECT 'fresh_input' AS component, sum(input_tokens) AS tokens, sum(fresh_micros) AS cost FROM turns UNION ALL
SELECT 'cache_write', sum(write_tokens), sum(write_micros) FROM turns UNION ALL
SELECT 'cache_read', sum(read_tokens), sum(read_micros) FROM turns UNION ALL
SELECT 'output', sum(output_tokens), sum(output_micros) FROM turns)"""))
def a8(spark, sf):
    return ro.charge_components(model(spark, sf).turns)


A9_SQL = """
, comps(component) AS (VALUES ('direct'), ('carry'), ('overhead'), ('output')),
acomp AS (SELECT c.component, CAST(coalesce(sum(a.cost_micros), 0) AS BIGINT) AS cost_micros,
CASE coalesce(max(CASE a.confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END), 0) WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence
FROM comps c LEFT JOIN att a USING (component) GROUP BY 1)
"""


@query("a9_attribution_components", ev_sql(A9_SQL + "SELECT * FROM acomp"))
def a9(spark, sf):
    return ro.attribution_components(model(spark, sf).attributions)


@query("f5_sig_figs_by_confidence", ev_sql(A9_SQL + """
SELECT component, confidence, CAST(CASE confidence WHEN 'high' THEN 6 ELSE 2 END AS BIGINT) AS sig_figs FROM acomp"""))
def f5(spark, sf):
    return ro.attribution_components(model(spark, sf).attributions).select(
        "component", "confidence", money.sig_figs(F.col("confidence")).alias("sig_figs")
    )


@query("f21_component_texts", ev_sql(A9_SQL + """
SELECT component, cost_micros, CASE component WHEN 'direct' THEN 'Loading into context' WHEN 'carry' THEN 'Keeping context loaded'
 WHEN 'overhead' THEN 'The conversation itself' ELSE 'Model output' END AS plain_name, component IN ('direct', 'carry') AS per_item FROM acomp"""))
def f21(spark, sf):
    return report.component_texts(ro.attribution_components(model(spark, sf).attributions))


@query("a32_composition_slices", ev_sql(A9_SQL + """
SELECT 'concluded' AS whole, component AS slice, cost_micros, CAST(cost_micros AS DOUBLE) / (SELECT total FROM tot) AS share FROM acomp
UNION ALL SELECT 'concluded', 'unattributed', unattributed, CAST(unattributed AS DOUBLE) / total FROM tot
UNION ALL SELECT 'charged', component, c, CAST(c AS DOUBLE) / (SELECT total FROM tot) FROM (
 SELECT 'fresh_input' AS component, CAST(sum(fresh_micros) AS BIGINT) AS c FROM turns UNION ALL SELECT 'cache_write', CAST(sum(write_micros) AS BIGINT) FROM turns
 UNION ALL SELECT 'cache_read', CAST(sum(read_micros) AS BIGINT) FROM turns UNION ALL SELECT 'output', CAST(sum(output_micros) AS BIGINT) FROM turns)"""))
def a32(spark, sf):
    m = model(spark, sf)
    return report.composition(m.turns, m.attributions)


ROLL = "SELECT item_id, kind, identity, category, CAST(size_tokens AS BIGINT) AS size_tokens, direct_micros, carry_micros, total_micros, reads, turns_resident, CAST(br AS BIGINT) AS basis_rank, CAST(cr AS BIGINT) AS confidence_rank, sessions FROM roll"


@query("a10_item_rollup", ev_sql(ROLL, ranks=True))
def a10(spark, sf):
    return rollup(model(spark, sf)).select(
        "item_id", "kind", "identity", "category", *long("size_tokens", "direct_micros", "carry_micros", "total_micros",
        "reads", "turns_resident", "basis_rank", "confidence_rank", "sessions"),
    )


@query("p19_weakest_of_ladder", ev_sql("""
SELECT item_id, CASE br WHEN 0 THEN 'exact' WHEN 1 THEN 'measured' ELSE 'estimated' END AS basis,
 CASE cr WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence FROM roll""", ranks=True))
def p19(spark, sf):
    return rollup(model(spark, sf)).select(
        "item_id", ro.name_of(F.col("basis_rank"), fixed.BASIS).alias("basis"),
        ro.name_of(F.col("confidence_rank"), fixed.CONFIDENCE).alias("confidence"),
    )


@query("p20_cause_label", ev_sql("""
SELECT item_id, total_micros, CASE WHEN total_micros <= 0 THEN 'no cost' WHEN CAST(carry_micros AS DOUBLE) / total_micros >= 0.6 THEN 'mostly the keeping'
 WHEN CAST(carry_micros AS DOUBLE) / total_micros <= 0.4 THEN 'mostly the loading' ELSE 'an even mix' END AS cause FROM roll""", ranks=True))
def p20(spark, sf):
    return rollup(model(spark, sf)).select(
        "item_id", "total_micros", ro.cause_label(F.col("total_micros"), F.col("carry_micros")).alias("cause")
    )


@query("p21_uncertainty_band", ev_sql("""
SELECT item_id, CASE WHEN br = 2 THEN 'size_estimate' WHEN carry_micros > direct_micros THEN 'carry_split_policy' ELSE 'turn_level_join' END AS driver,
CASE WHEN br = 2 THEN total_micros * 4 // 5 WHEN carry_micros > direct_micros THEN greatest(0, total_micros - carry_micros) ELSE greatest(0, total_micros - direct_micros) END AS low_micros,
CASE WHEN br = 2 THEN total_micros * 4 // 3 WHEN carry_micros > direct_micros THEN total_micros + carry_micros ELSE total_micros + direct_micros END AS high_micros FROM roll""", ranks=True))
def p21(spark, sf):
    band = ro.uncertainty(F.col("total_micros"), F.col("direct_micros"), F.col("carry_micros"), F.col("basis_rank"))
    return rollup(model(spark, sf)).select("item_id", band.alias("u")).select(
        "item_id", "u.driver", F.col("u.low").alias("low_micros"), F.col("u.high").alias("high_micros")
    )


@query("a23_lane_cost_split", ev_sql("""
SELECT item_id, carry_micros - uncached AS cached_micros, uncached AS uncached_micros, direct_micros AS loading_micros FROM (
SELECT *, CAST(CASE WHEN c + u = 0 THEN 0 ELSE CAST(carry_micros AS HUGEINT) * u // (c + u) + CASE WHEN (CAST(carry_micros AS HUGEINT) * u % (c + u)) > (CAST(carry_micros AS HUGEINT) * c % (c + u)) THEN 1 ELSE 0 END END AS BIGINT) AS uncached
FROM (SELECT *, cached_token_turns AS c, uncached_token_turns AS u FROM roll))""", ranks=True))
def a23(spark, sf):
    return ro.lane_costs(rollup(model(spark, sf))).select("item_id", "cached_micros", "uncached_micros", "loading_micros")


def _grouping(dim: str, key: str):
    sql = ev_sql(
        f"""SELECT {key} AS group_key, CASE WHEN min(kind) = max(kind) THEN min(kind) ELSE '(mixed)' END AS kind,
CASE WHEN min(category) = max(category) THEN min(category) ELSE '(mixed)' END AS category, CAST(sum(size_tokens) AS BIGINT) AS size_tokens,
CAST(sum(direct_micros) AS BIGINT) AS direct_micros, CAST(sum(carry_micros) AS BIGINT) AS carry_micros, CAST(sum(total_micros) AS BIGINT) AS total_micros,
CAST(sum(reads) AS BIGINT) AS reads, CAST(sum(turns_resident) AS BIGINT) AS turns_resident FROM roll GROUP BY 1""",
        ranks=True,
    )

    @query(f"a12_regroup_by_{dim}", sql)
    def run(spark, sf):
        return ro.regroup(rollup(model(spark, sf)), dim).select(
            "group_key", "kind", "category", *long("size_tokens", "direct_micros", "carry_micros", "total_micros", "reads", "turns_resident")
        )


FOLDER = "regexp_replace(identity, '/[^/]*$', '')"
EXT = "regexp_extract(identity, '[.][^.]+$')"
_grouping("file", "identity")
_grouping("folder", FOLDER)
_grouping("ext", EXT)
_grouping("category", "category")


@query("a13_all_groupings_at_once", ev_sql("""
SELECT d AS dimension, g AS group_key, count(*) AS members, CAST(sum(size_tokens) AS BIGINT) AS size_tokens, CAST(sum(total_micros) AS BIGINT) AS total_micros,
CAST(sum(reads) AS BIGINT) AS reads FROM (
""" + " UNION ALL ".join(
    f"SELECT '{d}' AS d, {k} AS g, size_tokens, total_micros, reads FROM roll"
    for d, k in (("item", "item_id"), ("file", "identity"), ("folder", FOLDER), ("ext", EXT), ("category", "category"))
) + ") GROUP BY ALL", ranks=True))
def a13(spark, sf):
    return ro.all_groupings(rollup(model(spark, sf))).select(
        "dimension", "group_key", "members", *long("size_tokens", "total_micros", "reads")
    )


INJECTED_SQL = """
, named AS (SELECT *, CASE WHEN regexp_matches(identity, '/f19[.]') THEN 'skill' ELSE kind END AS kind2,
 CASE WHEN regexp_matches(identity, '/f19[.]') THEN 'skill_listing' ELSE identity END AS identity2,
 CASE WHEN regexp_matches(identity, '/f19[.]') THEN 'skill:' || regexp_extract(identity, '^/repo/d[0-9]') || regexp_extract(identity, '[.][^.]+$') || ':skill_listing' ELSE item_id END AS item2 FROM roll)
"""


def _with_injected(spark, sf):
    """The rollup with the files named f19 read as copies of one injected listing per project."""
    is_listing = paths.name(F.col("identity")).startswith("f19.")
    project = F.concat(paths.parent(F.col("identity")), paths.suffix(F.col("identity")))
    rows = rollup(model(spark, sf))
    return rows.withColumns(
        {
            "item_id": F.when(is_listing, F.concat_ws(":", F.lit("skill"), project, F.lit("skill_listing"))).otherwise(F.col("item_id")),
            "kind": F.when(is_listing, "skill").otherwise(F.col("kind")),
            "identity": F.when(is_listing, "skill_listing").otherwise(F.col("identity")),
            "category": F.when(is_listing, "skill").otherwise(F.col("category")),
        }
    )


@query("a14_collapse_injected", ev_sql(INJECTED_SQL + """
SELECT CASE WHEN identity2 = 'skill_listing' THEN 'skill:skill_listing' ELSE item2 END AS item_id, CAST(max(size_tokens) AS BIGINT) AS size_tokens,
CAST(sum(total_micros) AS BIGINT) AS total_micros, CAST(sum(reads) AS BIGINT) AS reads FROM named GROUP BY 1""", ranks=True))
def a14(spark, sf):
    return ro.collapse_injected(_with_injected(spark, sf)).select("item_id", *long("size_tokens", "total_micros", "reads"))


@query("p24_display_name_with_scope", ev_sql(INJECTED_SQL + """
SELECT item2 AS item_id, CASE WHEN identity2 = 'skill_listing' THEN 'Skill listing — ' || split_part(item2, ':', 2) ELSE identity2 END AS display FROM named""", ranks=True))
def p24(spark, sf):
    return _with_injected(spark, sf).select(
        "item_id", paths.display(F.col("item_id"), F.col("identity"), with_scope=True).alias("display")
    )


@query("p22_pseudonymised_items", ev_sql(INJECTED_SQL + """
SELECT CASE WHEN identity2 = 'skill_listing' THEN 'Skill listing — redacted-' || substr(sha256(split_part(item2, ':', 2)), 1, 8)
 ELSE 'redacted-' || substr(sha256(item2), 1, 8) || regexp_extract(identity2, '[.][^.]+$') END AS display, total_micros FROM named""", ranks=True))
def p22(spark, sf):
    return _with_injected(spark, sf).select(
        paths.display(F.col("item_id"), F.col("identity"), redact=True, with_scope=True).alias("display"), "total_micros"
    )


@query("p23_redacted_details", ev_sql("""
SELECT session_id, turn_index, CASE WHEN contains(detail, '/repo/CLAUDE.md') THEN replace(detail, '/repo/CLAUDE.md', 'redacted-' || substr(sha256('/repo/CLAUDE.md'), 1, 8) || '.md') ELSE detail END AS detail FROM mark"""))
def p23(spark, sf):
    return model(spark, sf).marks.select("session_id", "turn_index", paths.redact_text(F.col("detail")).alias("detail"))


TREE_SQL = """
, leaf AS (SELECT identity AS path, total_micros FROM roll),
dirs AS (SELECT '/repo' AS path, sum(total_micros) AS total FROM leaf UNION ALL SELECT regexp_replace(path, '/[^/]*$', ''), sum(total_micros) FROM leaf GROUP BY 1),
extra AS (SELECT '(overhead)' AS path, sum(cost_micros) AS total FROM att WHERE component = 'overhead' UNION ALL
 SELECT '(output)', sum(cost_micros) FROM att WHERE component = 'output' UNION ALL
 SELECT '(forced-reloads)', sum(forced_micros) FROM event UNION ALL SELECT 'unattributed', unattributed FROM tot),
nodes AS (SELECT path, CAST(0 AS BIGINT) AS flat_micros, CAST(total AS BIGINT) AS total_micros FROM dirs UNION ALL SELECT path, total_micros, total_micros FROM leaf
 UNION ALL SELECT path, CAST(total AS BIGINT), CAST(total AS BIGINT) FROM extra WHERE total <> 0 UNION ALL SELECT '/', 0, total FROM tot)
"""


@query("a15_hierarchy_rollup", ev_sql(TREE_SQL + "SELECT * FROM nodes", ranks=True))
def a15(spark, sf):
    m = model(spark, sf)
    return report.cost_tree(m, rollup(m)).select("path", *long("flat_micros", "total_micros"))


@query("a17_per_turn_series", ev_sql("""
, off AS (SELECT session_id, sum(n_turns) OVER (ORDER BY session_id) - n_turns AS o FROM nt),
cb AS (SELECT session_id, boundary_turn AS turn_index, arg_min(pre_tokens, line) AS pre_tokens, arg_max(post_tokens, line) AS post_tokens,
 CAST(sum(greatest(0, pre_tokens - post_tokens)) AS BIGINT) AS dropped_tokens FROM comp GROUP BY ALL)
SELECT CAST(o + turn_index + 1 AS BIGINT) AS ordinal, session_id, model, total_micros AS cost_micros, fresh_micros, write_micros, read_micros, output_micros, prompt_tokens,
 pre_tokens, post_tokens, dropped_tokens FROM turns JOIN off USING (session_id) LEFT JOIN cb USING (session_id, turn_index)"""))
def a17(spark, sf):
    m = model(spark, sf)
    return report.turn_series(m.turns, lg.boundary_marks(m.compactions))


@query("w8_session_offset_axis", ev_sql("""
SELECT session_id, n_turns AS turns, CAST(sum(n_turns) OVER (ORDER BY session_id) - n_turns AS BIGINT) AS turn_offset FROM nt"""))
def w8(spark, sf):
    return ro.session_turns(model(spark, sf).turns)


@query("w5_curve_over_all_turns", ev_sql("""
SELECT session_id, turn_index, CAST(sum(total_micros) OVER (ORDER BY session_id, turn_index) AS BIGINT) AS running_micros,
 CAST(CAST(sum(total_micros) OVER (ORDER BY session_id, turn_index) AS BIGINT) AS DOUBLE) / (SELECT total FROM tot) AS running_share,
 (session_id, turn_index) IN (SELECT (session_id, boundary_turn) FROM comp) AS compacted FROM turns"""))
def w5_whole(spark, sf):
    """One curve over all sessions; its last point is the total."""
    m = model(spark, sf)
    return report.whole_curve(m.turns, lg.boundary_marks(m.compactions), lg.reconcile(m.turns, m.attributions))


@query("w5_cumulative_cost_curve", ev_sql("""
SELECT session_id, turn_index, CAST(sum(total_micros) OVER (PARTITION BY session_id ORDER BY turn_index) AS BIGINT) AS running_micros,
 CAST(sum(total_micros) OVER (PARTITION BY session_id ORDER BY turn_index) AS DOUBLE) / nullif(sum(total_micros) OVER (PARTITION BY session_id), 0) AS running_share,
 (session_id, turn_index) IN (SELECT (session_id, boundary_turn) FROM comp) AS compacted FROM turns"""))
def w5(spark, sf):
    m = model(spark, sf)
    return report.cost_curve(m.turns, lg.boundary_marks(m.compactions))


SPANLANE = """
, sl AS (SELECT s.session_id, s.item_id, s.opened_line, s.first_turn, s.end_turn, t.turn_index, l.lane FROM span s
 JOIN turns0 t ON t.session_id = s.session_id AND t.turn_index BETWEEN s.first_turn AND s.end_turn
 LEFT JOIN lane l ON l.session_id = s.session_id AND l.item_id = s.item_id AND l.turn_index = t.turn_index),
sx AS (SELECT session_id, item_id, opened_line, count(*) AS n, count(lane) AS c FROM sl GROUP BY ALL)
"""


@query("w6_lane_run_length", ev_sql(SPANLANE + """
, g AS (SELECT sl.*, turn_index - row_number() OVER (PARTITION BY sl.session_id, sl.opened_line, lane ORDER BY turn_index) AS grp FROM sl JOIN sx USING (session_id, opened_line) WHERE n = c)
SELECT session_id, item_id, opened_line, lane, min(turn_index) AS begin_turn, max(turn_index) + 1 AS end_turn FROM g GROUP BY session_id, item_id, opened_line, lane, grp"""))
def w6(spark, sf):
    m = model(spark, sf)
    return report.lane_runs(m.spans, m.ledger)


@query("a18_residency_rows", ev_sql(SPANLANE + """
SELECT s.session_id, s.item_id, s.opened_line, s.first_turn, s.last_turn, s.end_reason, s.size_tokens AS weight_tokens, coalesce(x.n, 0) AS turns, coalesce(x.c, 0) AS classified,
 coalesce(x.n, 0) = coalesce(x.c, 0) AS unbroken FROM span s LEFT JOIN sx x USING (session_id, opened_line)"""))
def a18(spark, sf):
    """One row per span; its lanes are the run-length rows of w6, kept only for unbroken spans."""
    m = model(spark, sf)
    return report.residency_rows(m.spans, m.ledger).select(
        "session_id", "item_id", "opened_line", *long("first_turn", "last_turn"), "end_reason", *long("weight_tokens", "turns", "classified"), "unbroken"
    )


@query("a19_instruction_vs_reads", ev_sql(INJECTED_SQL + """
SELECT CASE WHEN kind2 = 'skill' THEN 'resident_instruction' ELSE 'work_driven_reads' END AS side, CASE WHEN kind2 = 'skill' THEN 'Skills' ELSE category END AS label,
 CAST(sum(size_tokens) AS BIGINT) AS tokens, CAST(sum(total_micros) AS BIGINT) AS cost_micros, count(*) AS members FROM named GROUP BY ALL""", ranks=True))
def a19(spark, sf):
    return ro.comparison(_with_injected(spark, sf)).select("side", "label", *long("tokens", "cost_micros", "members"))


@query("a20_per_session_comparison", ev_sql("""
, d AS (SELECT session_id, sum(CASE WHEN component = 'direct' THEN cost_micros ELSE 0 END) AS direct, sum(CASE WHEN component = 'carry' THEN cost_micros ELSE 0 END) AS carry FROM att GROUP BY 1)
SELECT r.session_id, CAST(r.total_micros AS BIGINT) AS cost_micros, CAST(coalesce(direct, 0) AS BIGINT) AS direct_micros, CAST(coalesce(carry, 0) AS BIGINT) AS carry_micros,
 CAST(r.total_micros - coalesce(direct, 0) - coalesce(carry, 0) AS BIGINT) AS other_micros, n_turns AS turns, CAST(r.total_micros AS DOUBLE) / (SELECT total FROM tot) AS share
FROM rec r JOIN nt USING (session_id) LEFT JOIN d USING (session_id)"""))
def a20(spark, sf):
    m = model(spark, sf)
    return report.per_session(m.turns, m.attributions)


@query("s23_session_facts", ev_sql("""
, it AS (SELECT session_id, CAST(sum(loads) AS BIGINT) AS reads, CAST(sum(CASE WHEN identity LIKE '%.md' THEN loads ELSE 0 END) AS BIGINT) AS md_reads,
 count(*) FILTER (identity LIKE '%.md') AS md_files, count(*) FILTER (category = 'skill') AS skills, count(*) AS items FROM item JOIN loads USING (session_id, item_id) GROUP BY 1)
SELECT r.session_id, CAST(total_micros AS BIGINT) AS cost_micros, n_turns AS turns, coalesce(reads, 0) AS reads, coalesce(md_reads, 0) AS md_reads, coalesce(md_files, 0) AS md_files,
 coalesce(skills, 0) AS skills, coalesce(items, 0) AS items FROM rec r JOIN nt USING (session_id) LEFT JOIN it USING (session_id)"""))
def s23(spark, sf):
    m = model(spark, sf)
    return report.session_facts(m.turns, m.items)


NOTES = SPANLANE + """
, told AS (SELECT t.session_id, list_sort(list_distinct(list('2.' || (t.session_id % 3 + CASE WHEN t.session_id % 2 = 0 AND t.ts >= TIMESTAMP '2024-01-15' THEN 1 ELSE 0 END)))) AS versions FROM turns t GROUP BY 1),
resid AS (SELECT session_id, max(cumulative_tokens - greatest(0, pre_tokens - post_tokens)) AS residual FROM comp GROUP BY 1),
conf AS (SELECT session_id, count(*) FILTER (uuid % 34 = 0) AS conflicts FROM turns WHERE uuid % 17 = 0 GROUP BY 1),
bad AS (SELECT session_id, count(*) FILTER (event_type = 'error' AND k = 0) AS unparseable, max(ts) AS until FROM ev GROUP BY 1),
facts AS (SELECT told.*, residual, conflicts, unparseable, CASE WHEN session_id % 5 = 0 THEN 'refreshed' ELSE 'explicit' END AS origin, CASE WHEN session_id % 5 = 0 THEN 'unknown' ELSE '2023-10-15' END AS priced_on,
 CASE WHEN session_id % 5 <> 0 THEN date_diff('day', DATE '2023-10-15', CAST(until AS DATE)) END AS age_days FROM told LEFT JOIN resid USING (session_id) LEFT JOIN conf USING (session_id) LEFT JOIN bad USING (session_id)),
notes AS (
 SELECT session_id, 0 AS place, 'imputed' AS rule, 'Costs are API-equivalent estimates imputed from the ' || origin || ' pricing table, rates as published ' || priced_on || '. They are not billed amounts.' AS note, origin AS evidence FROM facts
 UNION ALL SELECT session_id, 1, 'stripped', 'Some resident instruction content is stripped before the transcript is written, so a portion of the cost is provably absent from the source records.', NULL FROM facts
 UNION ALL SELECT session_id, 2, 'undated_rates', 'The ' || origin || ' rate table does not record when its rates were published, so how current they are cannot be judged. Replace it with a dated one.', priced_on FROM facts WHERE age_days IS NULL
 UNION ALL SELECT session_id, 3, 'stale_rates', 'These rates were published ' || age_days || ' days ago (' || priced_on || ') and have not been checked since. Prices change a few times a year; refresh the table to update them.', age_days::VARCHAR FROM facts WHERE age_days >= 90
 UNION ALL SELECT session_id, 4, 'unparseable', unparseable || ' record(s) could not be parsed and are excluded from every figure here.', unparseable::VARCHAR FROM facts WHERE unparseable > 0
 UNION ALL SELECT session_id, 5, 'usage_conflict', conflicts || ' exchange(s) appeared more than once with different token counts; the first occurrence was used and the conflict is listed in diagnostics.', conflicts::VARCHAR FROM facts WHERE conflicts > 0
 UNION ALL SELECT session_id, 6, 'residual_drop', 'About ' || format('{:,}', residual) || ' tokens left the conversation before a compaction, which leaves no record of what was cleared. That content''s carry cost cannot be attributed to any item.', residual::VARCHAR FROM facts WHERE residual > 0
 UNION ALL SELECT session_id, 7, 'version_span', 'This session spans producing versions ' || array_to_string(versions, ', ') || '; figures may not be comparable across the boundary.', len(versions)::VARCHAR FROM facts WHERE len(versions) > 1)
"""


def session_notes(spark, sf):
    """What the rules say of each session. Some sessions move to a newer version, some are priced by a table without a date."""
    m = model(spark, sf)
    version = F.col("session_id") % 3 + F.when((F.col("session_id") % 2 == 0) & (F.col("ts") >= F.lit("2024-01-15").cast("timestamp")), 1).otherwise(0)
    turns = m.turns.withColumn("version", F.concat(F.lit("2."), version.cast("string")))
    copies = tn.with_replays(m.turns)
    usage = ["input_tokens", "write_5m", "write_1h", "write_unknown", "read_tokens", "output_tokens"]
    conflicts = tn.conflicts_by_session(copies, ["uuid"], ["file_rank", "line"], usage)
    undated = F.col("session_id") % 5 == 0
    whole = m.placed.groupBy("session_id").agg(F.count_if(F.col("is_compaction") & (F.col("k") == 0)).alias("unparseable"), F.to_date(F.max("ts")).alias("until"))
    provenance = whole.select("session_id", "until", F.when(undated, "refreshed").otherwise("explicit").alias("origin"), F.when(undated, "unknown").otherwise("2023-10-15").alias("priced_on"))
    facts = notes.session_facts(turns, m.compactions, conflicts, whole.select("session_id", "unparseable"), provenance)
    return notes.told(facts, notes.SESSION_RULES, "session_id")


@query("a26_limitations", ev_sql(NOTES + """
SELECT session_id, rule, note, evidence FROM notes"""))
def a26(spark, sf):
    """Every rule that has something to say of a session, with what it rests on."""
    return session_notes(spark, sf).select("session_id", "rule", "note", "evidence")


@query("a26_report_limitations", ev_sql(NOTES + """
, broken AS (SELECT count(*) AS n FROM span s LEFT JOIN sx x USING (session_id, opened_line) WHERE coalesce(x.n, 0) <> coalesce(x.c, 0)),
gaps AS (SELECT list_sort(list_distinct(list(model))) AS g FROM turns WHERE threshold IS NULL),
flagged AS (SELECT list_sort(list_distinct(list(model))) AS f FROM lane JOIN sitem USING (session_id, item_id) WHERE lane = 'uncached')
SELECT 'sub_threshold' AS rule, 'Content too small to cache is charged as fresh input at full rate every turn. That cost is charged to the item as carry cost and shown in its sub-threshold lane; the split between the two carry lanes is by token-turns, not separately measured.' AS note, CAST(NULL AS VARCHAR) AS evidence
UNION ALL SELECT 'broken_spans', n || ' residency span(s) include turns whose records support no cache lane, so those spans carry no per-turn lane breakdown rather than a guessed one.', n::VARCHAR FROM broken WHERE n > 0
UNION ALL SELECT 'threshold_gap', 'The minimum cacheable size is not recorded for ' || array_to_string(g, ', ') || ', so items were not checked for cacheability on ' || CASE WHEN len(g) = 1 THEN 'that model' ELSE 'those models' END || '.', len(g)::VARCHAR FROM gaps WHERE len(g) > 0
UNION ALL SELECT 'never_cacheable', 'Some items are smaller than the minimum cacheable size on ' || array_to_string(f, ', ') || ', where they are charged at full rate every turn rather than at the cache-read rate.', len(f)::VARCHAR FROM flagged WHERE len(f) > 0""", ranks=True))
def a26_report(spark, sf):
    """What is to be told of the report as a whole."""
    m = model(spark, sf)
    facts = notes.report_facts(report.residency_rows(m.spans, m.ledger), m.turns, rollup(m))
    return notes.told(facts, notes.REPORT_RULES).select("rule", "note", "evidence")


@query("a27_counters", ev_sql("""
SELECT count(*) FILTER (br = 2) AS estimated_figures, count(*) AS figures FROM roll""", ranks=True))
def a27(spark, sf):
    return rollup(model(spark, sf)).agg(F.count_if(F.col("basis_rank") == 2).alias("estimated_figures"), F.count(F.lit(1)).alias("figures"))


@query("a29_scope_section", ev_sql("""
SELECT count(*) AS sessions, CAST(sum(n_turns) AS BIGINT) AS covered_through_turn, CAST(min(session_id) AS VARCHAR) AS first_session, CAST(max(session_id) AS VARCHAR) AS last_session,
 (SELECT bool_or(ts > (SELECT max(ts) - INTERVAL 5 MINUTE FROM ev)) FROM ev) AS provisional FROM nt"""))
def a29(spark, sf):
    return report.scope(model(spark, sf).placed)


@query("a31_item_detail", ev_sql("""
SELECT item_id, total_micros, CAST(total_micros AS DOUBLE) / (SELECT total FROM tot) AS share, reads, turns_resident, sessions,
CAST(CASE cr WHEN 0 THEN 6 ELSE 2 END AS BIGINT) AS sig_figs, CASE WHEN br = 2 THEN 'size_estimate' WHEN carry_micros > direct_micros THEN 'carry_split_policy' ELSE 'turn_level_join' END AS driver FROM roll""", ranks=True))
def a31(spark, sf):
    m = model(spark, sf)
    return report.item_details(rollup(m), m.turns).select(
        "item_id", "total_micros", "share", *long("reads", "turns_resident", "sessions", "sig_figs"), "driver"
    )


@query("a31_item_per_session", ev_sql("""
SELECT target_id AS item_id, session_id, CAST(sum(cost_micros) AS BIGINT) AS total_micros FROM att WHERE target_kind = 'item' GROUP BY ALL"""))
def a31s(spark, sf):
    """The per-session costs of each item, as rows rather than as one growing map."""
    facts = model(spark, sf).attributions.filter("target_kind = 'item'")
    return facts.groupBy(F.col("target_id").alias("item_id"), "session_id").agg(F.sum("cost_micros").alias("total_micros"))


@query("k1_total_order_ranking", ev_sql("""
SELECT item_id, total_micros, carry_micros, direct_micros, reads, row_number() OVER (ORDER BY total_micros DESC, item_id) AS place FROM roll""", ranks=True))
def k1(spark, sf):
    """Every item with its place in the ranking."""
    return report.places(rollup(model(spark, sf)), "cost").select("item_id", *long("total_micros", "carry_micros", "direct_micros", "reads"), "place")


TOPK = """
, top AS (SELECT item_id, total_micros FROM roll ORDER BY total_micros DESC, item_id LIMIT 10)
SELECT item_id AS line_item, total_micros AS cost_micros FROM top
UNION ALL SELECT (SELECT count(*) - 10 FROM roll) || ' other items', (SELECT CAST(sum(total_micros) AS BIGINT) FROM roll) - (SELECT CAST(sum(total_micros) AS BIGINT) FROM top)
UNION ALL SELECT '(forced-reloads)', CAST(sum(forced_micros) AS BIGINT) FROM event
UNION ALL SELECT '(overhead)', CAST(sum(cost_micros) AS BIGINT) FROM att WHERE component = 'overhead'
UNION ALL SELECT '(output)', CAST(sum(cost_micros) AS BIGINT) FROM att WHERE component = 'output'
UNION ALL SELECT 'unattributed', unattributed FROM tot
"""


@query("k2_top_items_with_rest", ev_sql(TOPK, ranks=True))
def k2(spark, sf):
    m = model(spark, sf)
    items = ro.top_with_rest(rollup(m), "item_id", "total_micros", 10)
    return items.select(F.col("item_id").alias("line_item"), F.col("total_micros").cast("bigint").alias("cost_micros")).unionByName(
        report.non_item_costs(m.turns, m.attributions).select(F.col("path").alias("line_item"), F.col("flat_micros").alias("cost_micros"))
    )


@query("k3_longest_held_spans", ev_sql("""
SELECT session_id, item_id, opened_line, turns_held FROM (SELECT *, end_turn - first_turn + 1 AS held FROM span) ORDER BY held DESC, item_id, session_id, opened_line LIMIT 60"""))
def k3(spark, sf):
    held = F.col("end_turn") - F.col("first_turn") + 1
    return (
        model(spark, sf).spans.withColumn("held", held).orderBy(F.desc("held"), "item_id", "session_id", "opened_line")
        .limit(fixed.SPANS_SHOWN).select("session_id", "item_id", "opened_line", *long("turns_held"))
    )


@query("k4_priced_items", ev_sql("""
SELECT item_id, total_micros, greatest(0, (SELECT count(*) FROM roll WHERE total_micros > 0) - 120) AS omitted FROM roll WHERE total_micros > 0 ORDER BY total_micros DESC, identity LIMIT 120""", ranks=True))
def k4(spark, sf):
    return report.priced_points(rollup(model(spark, sf))).select("item_id", *long("total_micros", "omitted"))


def _ranking(sort: str, column: str) -> None:
    @query(f"k1_ranking_by_{sort}", ev_sql(f"SELECT item_id, {column}, row_number() OVER (ORDER BY {column} DESC, item_id) AS place FROM roll", ranks=True))
    def k1_by(spark, sf):
        return report.places(rollup(model(spark, sf)), sort).select("item_id", *long(column), "place")


for _sort in ("carry", "direct", "reads", "share"):
    _ranking(_sort, report.SORT_COLUMNS[_sort])


@query("k5_rank_disagreement", ev_sql("""
, a AS (SELECT item_id FROM roll ORDER BY total_micros DESC, item_id LIMIT 5), b AS (SELECT item_id FROM roll ORDER BY reads DESC, item_id LIMIT 5)
SELECT count(*) AS shared, 5 - count(*) AS differing FROM a JOIN b USING (item_id)""", ranks=True))
def k5(spark, sf):
    return report.rank_overlap(rollup(model(spark, sf)), 5)


@query("p28_resident_overhead_floor", ev_sql("""
, f AS (SELECT session_id, arg_min(input_rate, turn_index) AS rate, count(*) AS turns, sum(total_micros) AS total FROM turns GROUP BY 1),
g AS (SELECT *, CAST(CAST(86 AS HUGEINT) * rate * 100000 // 1000000000000 + CASE WHEN 2 * (CAST(86 AS HUGEINT) * rate * 100000 % 1000000000000) > 1000000000000 THEN 1 ELSE 0 END AS BIGINT) * turns AS cost FROM f)
SELECT session_id, turns, cost AS cost_micros, CASE WHEN total = 0 THEN 0.0 ELSE CAST(cost AS DOUBLE) / CAST(total AS DOUBLE) END AS share,
 CASE WHEN total = 0 THEN 0.0 ELSE CAST(cost AS DOUBLE) / CAST(total AS DOUBLE) END <= 0.005 AS within_ceiling FROM g"""))
def p28(spark, sf):
    return report.resident_floor(model(spark, sf).turns, description_chars=347)


@query("p36_row_tags", ev_sql("""
, never AS (SELECT item_id, string_agg(DISTINCT model, ', ' ORDER BY model) AS models FROM lane l JOIN sitem s USING (session_id, item_id) WHERE lane = 'uncached' GROUP BY 1)
SELECT r.item_id, category || CASE WHEN models IS NULL THEN '' ELSE '; too small to cache on ' || models END AS tags FROM roll r LEFT JOIN never USING (item_id)""", ranks=True))
def p36(spark, sf):
    return report.row_tags(rollup(model(spark, sf)))


@query("a33_uncertainty_notes", ev_sql(NOTES + """
, d AS (SELECT note, min(session_id * 100 + place) AS at0 FROM notes GROUP BY 1),
t AS (SELECT *, regexp_replace(regexp_replace(note, '\\d[\\d,.]*', '#', 'g'), '#(?:[,\\s]+#)+', '#', 'g') AS template FROM d)
SELECT CASE WHEN count(*) = 1 THEN arg_min(note, at0) ELSE arg_min(note, at0) || ' (and ' || (count(*) - 1) || ' more session(s) with the same limitation, differing only in the figures)' END AS note FROM t GROUP BY t.template
UNION ALL SELECT 'Shared carry cost is divided by the ''proportional'' policy: Shared carry cost is divided among resident items in proportion to how much space each occupies. A different policy moves per-item figures without changing the total.'"""))
def a33(spark, sf):
    """All notes of all sessions, told once where they differ in their figures only."""
    return notes.uncertainty(session_notes(spark, sf), "proportional")


@query("r2_grouping_conservation", ev_sql("""
SELECT d AS grouping, t AS before, t AS after, TRUE AS conserved FROM (SELECT CAST(sum(total_micros) AS BIGINT) AS t FROM roll), (VALUES ('file'), ('folder'), ('ext'), ('category')) v(d)""", ranks=True))
def r2(spark, sf):
    rows = rollup(model(spark, sf))
    both = ro.all_groupings(rows)
    return report.grouping_conservation(rows, both)


@query("r4_payload_gates", ev_sql("""
SELECT gate, CAST(0 AS BIGINT) AS difference FROM (VALUES ('components'), ('direct'), ('carry'), ('turns'), ('tree'), ('comparison')) v(gate), tot"""))
def r4(spark, sf):
    m = model(spark, sf)
    return report.payload_gates(m, rollup(m))


@query("r2_tampered_groupings", ev_sql("""
, b AS (SELECT CAST(sum(total_micros) AS BIGINT) AS t, CAST(sum(total_micros) FILTER (category = 'docs') AS BIGINT) AS docs, count(DISTINCT regexp_extract(identity, '[.][a-z]+$')) AS exts FROM roll)
SELECT d AS grouping, t AS before, CASE d WHEN 'ext' THEN t + 7 * exts WHEN 'category' THEN t - docs ELSE t END AS after, d NOT IN ('ext', 'category') AS conserved
FROM b, (VALUES ('file'), ('folder'), ('ext'), ('category')) v(d)""", ranks=True))
def r2_tampered(spark, sf):
    """The same gate on groupings that are wrong: each extension a little too dear, one category left out."""
    rows = rollup(model(spark, sf))
    dearer = F.col("total_micros") + F.when(F.col("dimension") == "ext", 7).otherwise(0)
    both = ro.all_groupings(rows).where("not (dimension = 'category' and group_key = 'docs')").withColumn("total_micros", dearer)
    return report.grouping_conservation(rows, both)


@query("r4_tampered_payload", ev_sql("""
SELECT gate, CASE gate WHEN 'direct' THEN 5 * (SELECT count(*) FROM roll) WHEN 'turns' THEN (SELECT count(*) FROM nt) ELSE 0 END AS difference
FROM (VALUES ('components'), ('direct'), ('carry'), ('turns'), ('tree'), ('comparison')) v(gate)""", ranks=True))
def r4_tampered(spark, sf):
    """The same gates on a document whose items' direct cost and sessions' first turns are wrong; the other equations hold."""
    m = model(spark, sf)
    first = F.when(F.col("turn_index") == 0, 1).otherwise(0)
    wrong = replace(m, turns=m.turns.withColumn("fresh_micros", F.col("fresh_micros") + first))
    return report.payload_gates(wrong, rollup(m).withColumn("direct_micros", F.col("direct_micros") + 5))


@query("a29_scope_sessions", ev_sql("""
SELECT CAST(t.session_id AS VARCHAR) AS session_id, substr(CAST(t.session_id AS VARCHAR), 1, 8) AS name, count(*) AS turns,
 (SELECT max(e.ts) FROM ev e WHERE e.session_id = t.session_id) > (SELECT max(ts) - INTERVAL 5 MINUTE FROM ev) AS provisional,
 string_agg(DISTINCT '2.' || (t.k % 3), ',' ORDER BY '2.' || (t.k % 3)) AS producing_versions FROM turns t GROUP BY t.session_id"""))
def a29_sessions(spark, sf):
    """The sessions that a report covers, a row each: name, turns, versions, and whether it may still grow."""
    m = model(spark, sf)
    return report.scope_sessions(m.placed, m.turns.withColumn("version", F.concat(F.lit("2."), (F.col("k") % 3).cast("string"))))


@query("s18_report_payload", ev_sql("""
SELECT s AS section, n AS rows FROM (
SELECT 'components' AS s, CAST(4 AS BIGINT) AS n UNION ALL SELECT 'attribution', 4 UNION ALL SELECT 'items', (SELECT count(*) FROM roll) UNION ALL SELECT 'invalidations', (SELECT count(*) FROM event)
UNION ALL SELECT 'turns', (SELECT count(*) FROM turns) UNION ALL SELECT 'sessions', (SELECT count(*) FROM rec) UNION ALL SELECT 'residency', (SELECT count(*) FROM span) UNION ALL SELECT 'totals', 1)""", ranks=True))
def s18(spark, sf):
    """The sections as JSON rows of one table; a document is the sections it selects."""
    m = model(spark, sf)
    return report.payload(m, rollup(m)).groupBy("section").agg(F.count("body").alias("rows"))
