"""DuckDB text of the events binding, written from the sequential definitions.

It pairs every injection with every later compaction and every span with every turn, which is
what the definitions say and what the Spark plans avoid; it serves as the independent check.
"""


def cost(tokens: str, rate: str, mult: int = 1_000_000) -> str:
    x = f"(CAST({tokens} AS HUGEINT) * {rate} * {mult})"
    return (
        f"CAST(({x} // 1000000000000) + CASE WHEN 2 * ({x} % 1000000000000) > 1000000000000 OR "
        f"(2 * ({x} % 1000000000000) = 1000000000000 AND ({x} // 1000000000000) % 2 = 1) "
        f"THEN 1 ELSE 0 END AS BIGINT)"
    )


BASE = f"""
ev AS (SELECT user_id AS session_id, event_id, ts, event_type, value,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line FROM events),
rates(model, input_rate, output_rate, threshold) AS (VALUES
  ('m-small', 1000000, 5000000, 400), ('m-mid', 3000000, 15000000, 100),
  ('m-large', 5000000, 25000000, NULL)),
turns0 AS (SELECT session_id, line, ts, k, event_id AS uuid,
  row_number() OVER (PARTITION BY session_id ORDER BY line) - 1 AS turn_index,
  CASE WHEN k % 10 = 0 THEN 'm-mid' WHEN session_id % 2 = 0 THEN 'm-large' ELSE 'm-small' END AS model,
  7 * k AS input_tokens, CASE WHEN k % 2 = 0 THEN 11 * k ELSE 0 END AS write_5m,
  CASE WHEN k % 5 = 0 THEN 5 * k ELSE 0 END AS write_1h,
  CASE WHEN k % 7 = 0 THEN 3 * k ELSE 0 END AS write_unknown,
  CASE WHEN k % 4 <> 0 THEN 100 * k ELSE 0 END AS read_tokens, 2 * k AS output_tokens,
  k % 13 = 0 AS is_sidechain FROM ev WHERE event_type = 'purchase'),
turns1 AS (SELECT t.*, r.input_rate, r.output_rate, r.threshold,
  write_5m + write_1h + write_unknown AS write_tokens,
  input_tokens + write_5m + write_1h + write_unknown + read_tokens AS prompt_tokens,
  {cost('input_tokens', 'input_rate')} AS fresh_micros,
  {cost('write_5m', 'input_rate', 1250000)} + {cost('write_1h', 'input_rate', 2000000)}
    + {cost('write_unknown', 'input_rate', 1250000)} AS write_micros,
  {cost('read_tokens', 'input_rate', 100000)} AS read_micros,
  {cost('output_tokens', 'output_rate')} AS output_micros,
  CASE WHEN write_unknown > 0 THEN 'low' END AS confidence_cap,
  lag(t.model) OVER (PARTITION BY session_id ORDER BY turn_index) AS prev_model
  FROM turns0 t JOIN rates r ON t.model = r.model),
turns AS (SELECT *, fresh_micros + write_micros + read_micros + output_micros AS total_micros FROM turns1),
nt AS (SELECT session_id, count(*) AS n_turns FROM turns0 GROUP BY 1),
ident AS (SELECT *, '/repo/d' || (k % 4) || '/f' || (k % 20) ||
  CASE k % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.md' ELSE '.json' END AS identity FROM ev),
inj AS (SELECT e.session_id, e.line, e.event_id AS uuid, 'file' AS kind, e.identity, 'file:' || e.identity AS item_id,
  CASE e.k % 3 WHEN 0 THEN 'source' WHEN 1 THEN 'docs' ELSE 'other' END AS category,
  1 + CAST(floor(e.value * 10) AS BIGINT) AS size_tokens,
  CASE e.event_type WHEN 'view' THEN 'measured' ELSE 'estimated' END AS basis,
  CASE e.event_type WHEN 'view' THEN 'medium' ELSE 'low' END AS confidence,
  CASE e.event_type WHEN 'view' THEN 'tool_result' ELSE 'at_mention' END AS cause,
  e.event_id % 5 = 0 AS pinned, min(t.turn_index) AS turn_index
  FROM ident e JOIN turns0 t ON t.session_id = e.session_id AND t.line > e.line
  WHERE e.event_type IN ('view', 'click') GROUP BY ALL),
comp AS (SELECT e.session_id, e.line, e.event_id AS uuid, 1000 * e.k AS pre_tokens, 100 * e.k AS post_tokens,
  1500 * e.k AS cumulative_tokens,
  row_number() OVER (PARTITION BY e.session_id ORDER BY e.line) - 1 AS comp_index,
  coalesce((SELECT max(t.turn_index) FROM turns0 t WHERE t.session_id = e.session_id AND t.line < e.line), 0)
    AS boundary_turn
  FROM ev e JOIN nt USING (session_id) WHERE e.event_type = 'error'),
item AS (SELECT session_id, item_id, kind, identity, category, size_tokens, basis, confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id, item_id ORDER BY size_tokens DESC, line) AS rn FROM inj)
  WHERE rn = 1),
loads AS (SELECT session_id, item_id, count(*) AS loads FROM inj GROUP BY ALL),
evicts AS (SELECT i.session_id, i.item_id, c.line AS comp_line, c.boundary_turn
  FROM (SELECT DISTINCT session_id, item_id FROM inj) i JOIN comp c USING (session_id)
  WHERE NOT EXISTS (SELECT 1 FROM inj p WHERE p.session_id = i.session_id AND p.item_id = i.item_id
    AND p.pinned AND p.line < c.line)),
inj_end AS (SELECT i.session_id, i.item_id, i.line, i.turn_index, i.uuid, min(e.comp_line) AS comp_line
  FROM inj i LEFT JOIN evicts e ON e.session_id = i.session_id AND e.item_id = i.item_id
    AND e.comp_line > i.line GROUP BY ALL),
span0 AS (SELECT session_id, item_id, comp_line, min(line) AS opened_line, min(turn_index) AS first_turn,
  count(*) AS injections FROM inj_end GROUP BY ALL),
span AS (SELECT s.session_id, s.item_id, s.first_turn, c.boundary_turn AS last_turn,
  CASE WHEN c.line IS NULL THEN 'session_end' ELSE 'evicted' END AS end_reason,
  coalesce(c.boundary_turn, nt.n_turns - 1) AS end_turn,
  greatest(0, coalesce(c.boundary_turn, nt.n_turns - 1) - s.first_turn + 1) AS turns_held,
  coalesce(c.boundary_turn, nt.n_turns - 1) < s.first_turn AS empty_span,
  s.opened_line, s.injections, m.kind, m.identity, m.category, m.size_tokens
  FROM span0 s JOIN nt USING (session_id) JOIN item m USING (session_id, item_id)
  LEFT JOIN comp c ON c.session_id = s.session_id AND c.line = s.comp_line),
res AS (SELECT s.session_id, t.turn_index, s.item_id, any_value(s.size_tokens) AS size_tokens,
  min(s.opened_line) AS pos, min(s.first_turn) AS first_turn
  FROM span s JOIN turns0 t ON t.session_id = s.session_id AND t.turn_index BETWEEN s.first_turn AND s.end_turn
  GROUP BY ALL),
chg AS (SELECT session_id, turn_index, line, uuid, 0 AS seniority, 'tools' AS tier, 'model_switched' AS "trigger",
  'model switched from ' || prev_model || ' to ' || model AS detail FROM turns
  WHERE turn_index >= 1 AND prev_model <> model
  UNION ALL
  SELECT e.session_id, min(t.turn_index), e.line, e.event_id, 1, CASE WHEN e.k % 6 = 0 THEN 'system' ELSE 'tools' END,
  CASE WHEN e.k % 6 = 0 THEN 'instruction_changed' ELSE 'tool_set_changed' END,
  CASE WHEN e.k % 6 = 0 THEN 'instruction file ''/repo/CLAUDE.md'' changed'
    ELSE 'MCP server ''s' || (e.k % 5) || ''' added (1 tool)' END
  FROM ev e JOIN turns0 t ON t.session_id = e.session_id AND t.line > e.line
  WHERE e.event_type = 'signup' GROUP BY e.session_id, e.line, e.event_id, e.k HAVING min(t.turn_index) >= 1),
chg_first AS (SELECT session_id, turn_index, detail, min(seniority * 1000000000 + line) AS at FROM chg GROUP BY ALL),
mark AS (SELECT c.session_id, c.turn_index,
  CASE min(CASE "trigger" WHEN 'model_switched' THEN 0 WHEN 'tool_set_changed' THEN 1 ELSE 2 END)
    WHEN 0 THEN 'model_switched' WHEN 1 THEN 'tool_set_changed' ELSE 'instruction_changed' END AS "trigger",
  CASE WHEN min(CASE "trigger" WHEN 'model_switched' THEN 0 WHEN 'tool_set_changed' THEN 1 ELSE 2 END) = 2
    THEN 'system' ELSE 'tools' END AS tier, count(*) AS n_changes,
  (SELECT string_agg(f.detail, '; ' ORDER BY f.at) FROM chg_first f
    WHERE f.session_id = c.session_id AND f.turn_index = c.turn_index) AS detail
  FROM chg c GROUP BY c.session_id, c.turn_index),
arrive AS (SELECT session_id, turn_index, sum(size_tokens) AS arrived_tokens, count(*) AS n_injections
  FROM inj GROUP BY ALL),
resx AS (SELECT r.*, t.model, t.threshold, t.input_tokens, t.write_tokens, t.read_tokens,
  (r.session_id, r.turn_index, r.item_id) IN (SELECT (session_id, turn_index, item_id) FROM inj) AS injected,
  (r.session_id, r.turn_index) IN (SELECT (session_id, turn_index) FROM mark) AS changed,
  coalesce(r.size_tokens < t.threshold, FALSE) AS below
  FROM res r JOIN turns t USING (session_id, turn_index)),
resy AS (SELECT *, sum(CASE WHEN below THEN size_tokens ELSE 0 END) OVER (PARTITION BY session_id, turn_index) AS demand,
  CASE WHEN below THEN 'uncached' WHEN (injected OR changed) AND write_tokens > 0 THEN 'loading'
    WHEN read_tokens > 0 THEN 'cached' END AS lane FROM resx),
lane AS (SELECT session_id, turn_index, item_id, model, lane, size_tokens, threshold, pos, demand,
  CASE lane WHEN 'uncached' THEN 'below_minimum' WHEN 'loading'
    THEN CASE WHEN changed THEN 'reload_forced' ELSE 'first_load' END ELSE 'cacheable' END AS lane_reason,
  CASE lane WHEN 'uncached' THEN CASE WHEN demand > 0 AND input_tokens >= demand THEN 'high' ELSE 'low' END
    WHEN 'loading' THEN CASE WHEN threshold IS NULL THEN 'low' ELSE 'high' END
    ELSE CASE WHEN injected OR changed OR threshold IS NULL THEN 'low' ELSE 'high' END END AS lane_confidence
  FROM resy WHERE lane IS NOT NULL),
reload AS (SELECT session_id, turn_index, sum(size_tokens) AS reloaded_tokens, count(*) AS n_reloaded
  FROM resx WHERE first_turn < turn_index AND NOT injected GROUP BY ALL),
event0 AS (SELECT m.*, t.write_micros, t.write_tokens, t.confidence_cap, coalesce(r.n_reloaded, 0) AS items_reloaded,
  least(t.write_tokens - coalesce(a.arrived_tokens, 0), coalesce(r.reloaded_tokens, 0)) AS excess
  FROM mark m JOIN turns t USING (session_id, turn_index) LEFT JOIN arrive a USING (session_id, turn_index)
  LEFT JOIN reload r USING (session_id, turn_index)),
event AS (SELECT session_id, turn_index, 'inval:' || session_id || ':' || turn_index AS event_id, tier, "trigger",
  detail, items_reloaded, n_changes,
  CASE WHEN write_tokens > 0 AND write_micros > 0 AND excess > 0
    THEN CAST(CAST(write_micros AS HUGEINT) * excess // write_tokens AS BIGINT) ELSE 0 END AS forced_micros,
  CASE WHEN write_tokens > 0 AND write_micros > 0 AND excess > 0 THEN 'estimated' ELSE 'measured' END AS basis,
  CASE WHEN NOT (write_tokens > 0 AND write_micros > 0) THEN 'high' WHEN excess <= 0 THEN 'medium'
    ELSE coalesce(confidence_cap, 'low') END AS confidence FROM event0),
below AS (SELECT l.session_id, l.turn_index, sum(l.size_tokens) AS tokens FROM lane l WHERE lane = 'uncached' GROUP BY ALL),
fresh AS (SELECT t.session_id, t.turn_index, least({cost('b.tokens', 't.input_rate')}, t.fresh_micros) AS pool
  FROM below b JOIN turns t USING (session_id, turn_index) WHERE t.fresh_micros > 0),
pool0 AS (
  SELECT i.session_id, i.turn_index, 'direct' AS pool, i.item_id, i.line AS pos, i.size_tokens AS w,
    t.write_micros - coalesce(e.forced_micros, 0) AS amount, coalesce(t.confidence_cap, 'medium') AS confidence,
    i.uuid || '@line' || i.line AS item_ref
  FROM inj i JOIN turns t USING (session_id, turn_index) LEFT JOIN event e USING (session_id, turn_index)
  WHERE t.write_micros - coalesce(e.forced_micros, 0) > 0
  UNION ALL
  SELECT l.session_id, l.turn_index, 'uncached', l.item_id, l.pos, l.size_tokens, f.pool, 'medium', NULL
  FROM lane l JOIN fresh f USING (session_id, turn_index) WHERE l.lane = 'uncached'
  UNION ALL
  SELECT l.session_id, l.turn_index, 'cached', l.item_id, l.pos, l.size_tokens, t.read_micros, 'medium', NULL
  FROM lane l JOIN turns t USING (session_id, turn_index) WHERE l.lane = 'cached'),
pool1 AS (SELECT *, CAST(amount AS HUGEINT) * w // sum(w) OVER p AS fl, CAST(amount AS HUGEINT) * w % sum(w) OVER p AS rm,
  count(*) OVER p AS members FROM pool0 WINDOW p AS (PARTITION BY session_id, turn_index, pool)),
pool2 AS (SELECT *, amount - sum(fl) OVER (PARTITION BY session_id, turn_index, pool) AS spare,
  row_number() OVER (PARTITION BY session_id, turn_index, pool ORDER BY rm DESC, pos) AS rn FROM pool1),
pool AS (SELECT session_id, turn_index, pool, item_id, pos, w, amount, confidence, item_ref, members,
  CAST(fl + CASE WHEN rn <= spare THEN 1 ELSE 0 END AS BIGINT) AS share FROM pool2),
att AS (
  SELECT session_id, turn_index, 'item' AS target_kind, item_id AS target_id,
    CASE pool WHEN 'direct' THEN 'direct' ELSE 'carry' END AS component, share AS cost_micros,
    'measured' AS basis, confidence, item_ref FROM pool WHERE share <> 0
  UNION ALL
  SELECT session_id, turn_index, 'prompt', NULL, 'output', output_micros, 'exact', 'high', NULL FROM turns WHERE output_micros <> 0
  UNION ALL
  SELECT t.session_id, t.turn_index, 'prompt', NULL, 'overhead', t.fresh_micros - coalesce(f.pool, 0), 'exact', 'high', NULL
  FROM turns t LEFT JOIN fresh f USING (session_id, turn_index) WHERE t.fresh_micros - coalesce(f.pool, 0) > 0
  UNION ALL
  SELECT session_id, turn_index, 'invalidation_event', event_id, 'direct', forced_micros, basis, confidence, NULL
  FROM event WHERE forced_micros > 0),
rec AS (SELECT t.session_id, t.total_micros, coalesce(a.attributed, 0) AS attributed_micros,
  t.total_micros - coalesce(a.attributed, 0) AS unattributed_micros
  FROM (SELECT session_id, sum(total_micros) AS total_micros FROM turns GROUP BY 1) t
  LEFT JOIN (SELECT session_id, sum(cost_micros) AS attributed FROM att GROUP BY 1) a USING (session_id)),
tot AS (SELECT CAST(sum(total_micros) AS BIGINT) AS total, CAST(sum(attributed_micros) AS BIGINT) AS attributed,
  CAST(sum(unattributed_micros) AS BIGINT) AS unattributed FROM rec)
"""

RANKS = """
basis_rank(basis, br) AS (VALUES ('exact', 0), ('measured', 1), ('estimated', 2)),
conf_rank(confidence, cr) AS (VALUES ('high', 0), ('medium', 1), ('low', 2)),
laneroll AS (SELECT session_id, item_id,
  sum(CASE WHEN lane = 'cached' THEN 1 ELSE 0 END) AS cached_turns,
  sum(CASE WHEN lane = 'uncached' THEN 1 ELSE 0 END) AS uncached_turns,
  sum(CASE WHEN lane = 'loading' THEN 1 ELSE 0 END) AS loading_turns,
  sum(CASE WHEN lane = 'cached' THEN size_tokens ELSE 0 END) AS cached_token_turns,
  sum(CASE WHEN lane = 'uncached' THEN size_tokens ELSE 0 END) AS uncached_token_turns,
  sum(CASE WHEN lane = 'loading' THEN size_tokens ELSE 0 END) AS loading_token_turns FROM lane GROUP BY ALL),
sitem AS (SELECT a.session_id, a.target_id AS item_id,
  sum(CASE WHEN component = 'direct' THEN cost_micros ELSE 0 END) AS direct,
  sum(CASE WHEN component = 'carry' THEN cost_micros ELSE 0 END) AS carry,
  max(br) AS br, max(cr) AS cr FROM att a JOIN basis_rank USING (basis) JOIN conf_rank USING (confidence)
  WHERE target_kind = 'item' GROUP BY ALL),
roll AS (SELECT s.item_id, any_value(i.kind) AS kind, any_value(i.identity) AS identity, any_value(i.category) AS category,
  max(i.size_tokens) AS size_tokens, CAST(sum(s.direct) AS BIGINT) AS direct_micros, CAST(sum(s.carry) AS BIGINT) AS carry_micros,
  CAST(sum(s.direct + s.carry) AS BIGINT) AS total_micros, CAST(sum(l.loads) AS BIGINT) AS reads,
  CAST(sum(h.held) AS BIGINT) AS turns_resident,
  greatest(max(s.br), arg_min(b.br, s.session_id)) AS br, greatest(max(s.cr), arg_min(c.cr, s.session_id)) AS cr,
  count(*) AS sessions, CAST(sum(coalesce(cached_token_turns, 0)) AS BIGINT) AS cached_token_turns,
  CAST(sum(coalesce(uncached_token_turns, 0)) AS BIGINT) AS uncached_token_turns
  FROM sitem s JOIN item i USING (session_id, item_id) JOIN loads l USING (session_id, item_id)
  JOIN (SELECT session_id, item_id, sum(turns_held) AS held FROM span GROUP BY ALL) h USING (session_id, item_id)
  LEFT JOIN laneroll g USING (session_id, item_id)
  JOIN basis_rank b ON b.basis = i.basis JOIN conf_rank c ON c.confidence = i.confidence GROUP BY s.item_id)
"""


def ev_sql(select: str, ranks: bool = False, policy: str = "proportional", before: str | None = None) -> str:
    text = BASE + ("," + RANKS if ranks else "")
    if policy == "exclusive":
        text = text.replace(
            "pool AS (SELECT session_id, turn_index, pool, item_id, pos, w, amount, confidence, item_ref, members,",
            "pool AS (SELECT session_id, turn_index, pool, item_id, pos, w, amount, confidence, item_ref, members, "
            "CASE WHEN pool = 'cached' AND members > 1 THEN 0 ELSE",
        ).replace("THEN 1 ELSE 0 END AS BIGINT) AS share FROM pool2", "THEN 1 ELSE 0 END AS BIGINT) END AS share FROM pool2")
    if before is not None:
        text = text.replace("AS line FROM events)", f"AS line FROM events WHERE ts < TIMESTAMP '{before}')")
    return "WITH " + text.strip() + "\n" + select.strip()
