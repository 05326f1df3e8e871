"""Report sections: each is a table; the document is their JSON rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfold.functions import fixed, money
from tallyfold.functions.money import cost_micros, share_of
from tallyfold.operators import checks
from tallyfold.operators import ledger as lg
from tallyfold.operators import residency as res
from tallyfold.operators import rollups as ro
from tallyfold.plans import grouped, scan


def totals(turn_rows: DataFrame, facts: DataFrame) -> DataFrame:
    split = facts.agg(F.coalesce(F.sum("cost_micros"), F.lit(0)).cast("bigint").alias("a"))
    return (
        turn_rows.agg(
            F.sum("total_micros").alias("cost_micros"), F.sum("input_tokens").alias("fresh_input"),
            F.sum("write_tokens").alias("cache_write"), F.sum("read_tokens").alias("cache_read"),
            F.sum("output_tokens").alias("output"),
        )
        .withColumn("attributed_micros", split.scalar())
        .withColumn("unattributed_micros", F.col("cost_micros") - F.col("attributed_micros"))
        .withColumn("attributed_share", share_of(F.col("attributed_micros"), F.col("cost_micros")))
        .withColumn("unattributed_share", share_of(F.col("unattributed_micros"), F.col("cost_micros")))
    )


# Plain names of the attribution components.
PLAIN_NAMES = {
    "direct": "Loading into context",
    "carry": "Keeping context loaded",
    "overhead": "The conversation itself",
    "output": "Model output",
}


def component_texts(components: DataFrame) -> DataFrame:
    plain = F.lit(None).cast("string")
    for key, text in PLAIN_NAMES.items():
        plain = F.when(F.col("component") == key, text).otherwise(plain)
    return components.select(
        "component", "cost_micros", plain.alias("plain_name"), F.col("component").isin("direct", "carry").alias("per_item")
    )


def composition(turn_rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Two views of one whole: what was charged, and what was concluded with the remainder."""
    concluded = ro.attribution_components(facts).select(F.col("component").alias("slice"), "cost_micros")
    rest = totals(turn_rows, facts).select(F.lit("unattributed").alias("slice"), F.col("unattributed_micros").alias("cost_micros"))
    charged = ro.charge_components(turn_rows).select(F.col("component").alias("slice"), "cost_micros")
    total = turn_rows.agg(F.sum("total_micros").alias("t"))
    both = (
        concluded.unionByName(rest).withColumn("whole", F.lit("concluded"))
        .unionByName(charged.withColumn("whole", F.lit("charged")))
    )
    return both.select("whole", "slice", "cost_micros", share_of(F.col("cost_micros"), total.scalar()).alias("share"))


def non_item_costs(turn_rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Forced reloads, overhead, output and the remainder, as leaves of the whole."""
    kinds = {
        "(forced-reloads)": F.col("target_kind") == "invalidation_event",
        "(overhead)": F.col("component") == "overhead",
        "(output)": F.col("component") == "output",
    }
    sums = facts.agg(
        *[F.sum(F.when(cond, F.col("cost_micros")).otherwise(0)).alias(f"c{i}") for i, cond in enumerate(kinds.values())],
        F.sum("cost_micros").alias("attributed"),
    )
    total = turn_rows.agg(F.sum("total_micros").alias("t"))
    leaves = [
        F.struct(F.lit(path).alias("path"), F.col(f"c{i}").cast("bigint").alias("flat_micros"))
        for i, path in enumerate(kinds)
    ]
    rest = F.struct(F.lit("unattributed").alias("path"), (F.col("total") - F.col("attributed")).cast("bigint").alias("flat_micros"))
    return (
        sums.withColumn("total", total.scalar())
        .select(F.explode(F.array(*leaves, rest)).alias("n")).select("n.*")
        .filter("flat_micros <> 0")
    )


def cost_tree(m: lg.Model, rollup: DataFrame) -> DataFrame:
    return ro.tree(rollup, non_item_costs(m.turns, m.attributions))


def turn_series(turn_rows: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Every turn with its ordinal over all sessions in id order, and its merged compaction."""
    offsets = ro.session_turns(turn_rows).select("session_id", "turn_offset")
    return (
        turn_rows.join(offsets, "session_id", "inner")
        .join(boundaries, res.SESSION_TURN, "left")
        .select(
            (F.col("turn_offset") + F.col("turn_index") + 1).alias("ordinal"), "session_id", "model",
            F.col("total_micros").alias("cost_micros"), "fresh_micros", "write_micros", "read_micros", "output_micros",
            "prompt_tokens", "pre_tokens", "post_tokens", F.col("dropped_tokens").cast("bigint").alias("dropped_tokens"),
        )
    )


def cost_curve(turn_rows: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Running cost per session; the last point is the session total."""
    numbered = turn_rows.select("session_id", "turn_index", (F.col("turn_index") + 1).alias("n"), "total_micros")
    run = scan.scan_session(
        numbered, ["session_id"], "n",
        counts={"before": F.col("total_micros")}, totals={"whole": F.col("total_micros")},
    )
    running = F.col("before") + F.col("total_micros")
    return run.join(boundaries.select(*res.SESSION_TURN, F.lit(True).alias("hit")), res.SESSION_TURN, "left").select(
        "session_id", "turn_index", running.cast("bigint").alias("running_micros"),
        F.when(F.col("whole") != 0, running.cast("double") / F.col("whole").cast("double")).alias("running_share"),
        F.coalesce("hit", F.lit(False)).alias("compacted"),
    )


def whole_curve(turn_rows: DataFrame, boundaries: DataFrame, results: DataFrame) -> DataFrame:
    """Running cost over the turns of all sessions, in the order of their ids; it must end at the total that the results give.

    ``results`` has total_micros; turns that do not add up to it are an error.
    """
    numbered = turn_rows.select(*res.SESSION_TURN, F.struct(*res.SESSION_TURN).alias("at"), "total_micros")
    run = grouped.running_offsets(numbered, "at", "total_micros", "before")
    charged = turn_rows.agg(F.sum("total_micros").alias("t")).scalar()
    total = results.agg(F.sum("total_micros").alias("t")).scalar()
    refuse = F.raise_error(F.lit("the turns do not add up to the total of the results")).cast("bigint")
    running = F.when(charged.eqNullSafe(total), F.col("before") + F.col("total_micros")).otherwise(refuse)
    return run.join(boundaries.select(*res.SESSION_TURN, F.lit(True).alias("hit")), res.SESSION_TURN, "left").select(
        *res.SESSION_TURN, running.alias("running_micros"), money.share_of(running, total).alias("running_share"), F.coalesce("hit", F.lit(False)).alias("compacted")
    )


def span_lanes(span_rows: DataFrame, book: DataFrame) -> DataFrame:
    """(span, turn, lane): the ledger's resident rows carry the opening line of their span."""
    return book.filter("row = 'res'").select("session_id", "turn_index", "item_id", F.col("pos").alias("opened_line"), "lane")


SPAN = ["session_id", "opened_line"]


def residency_rows(span_rows: DataFrame, book: DataFrame) -> DataFrame:
    """Spans with their turns and how many of them have a lane; equal means unbroken.

    A span that begins on turn 0 behind another span of its item shares that turn's lane.
    """
    counted = span_lanes(span_rows, book).groupBy(*SPAN).agg(
        F.count(F.lit(1)).alias("seen"), F.count("lane").alias("have")
    )
    shadow = (F.col("first_turn") == 0) & (F.col("opened_line") > F.col("zero_line")) & (F.col("turns_held") > 0)
    first = book.filter("row = 'res' AND turn_index = 0").select(
        "session_id", "item_id", F.when(F.col("lane").isNotNull(), 1).otherwise(0).alias("zero_lane")
    )
    zero = F.lit(0).cast("bigint")
    joined = span_rows.join(counted, SPAN, "left").join(first, res.SESSION_ITEM, "left")
    extra = F.when(shadow, 1).otherwise(0)
    extra_have = F.when(shadow, F.coalesce("zero_lane", F.lit(0))).otherwise(0)
    turns = F.coalesce("seen", zero) + extra
    have = F.coalesce("have", zero) + extra_have
    return joined.select(
        "session_id", "item_id", "opened_line", "first_turn", "last_turn", "end_reason",
        F.col("size_tokens").alias("weight_tokens"), turns.alias("turns"), have.alias("classified"),
        (turns == have).alias("unbroken"),
    )


def lane_runs(span_rows: DataFrame, book: DataFrame) -> DataFrame:
    """Runs of equal lanes per unbroken span, as (lane, begin, end).

    A turn starts a run when the lane of the turn before it differs; runs are the turns between
    two starts, found with a window over (span), whose rows are single turns of one item.
    """
    whole = residency_rows(span_rows, book).filter("unbroken AND turns > 0").select(*SPAN, "item_id", "first_turn")
    lanes = span_lanes(span_rows, book).drop("item_id")
    zero = book.filter("row = 'res' AND turn_index = 0").select("session_id", "item_id", F.col("lane").alias("lane0"))
    rows = lanes.join(whole, SPAN, "inner")
    shadows = (
        whole.join(span_rows.select(*SPAN, "zero_line"), SPAN, "inner")
        .filter((F.col("first_turn") == 0) & (F.col("opened_line") > F.col("zero_line")))
        .join(zero, res.SESSION_ITEM, "inner")
        .select(*SPAN, "item_id", F.lit(0).cast("bigint").alias("turn_index"), F.col("lane0").alias("lane"))
    )
    rows = rows.select(*SPAN, "item_id", "turn_index", "lane").unionByName(shadows)
    numbered = grouped.with_rank(rows, [*SPAN, "lane"], [F.col("turn_index")], "rn")
    return (
        numbered.groupBy(*SPAN, "item_id", "lane", (F.col("turn_index") - F.col("rn")).alias("island"))
        .agg(F.min("turn_index").alias("begin_turn"), (F.max("turn_index") + 1).alias("end_turn"))
        .drop("island")
    )


def per_session(turn_rows: DataFrame, facts: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    charged = turn_rows.select("session_id", F.col("total_micros").alias("cost"), zero.alias("direct"), zero.alias("carry"), F.lit(1).alias("turn"))
    split = facts.filter(F.col("component").isin("direct", "carry")).select(
        "session_id", zero.alias("cost"),
        F.when(F.col("component") == "direct", F.col("cost_micros")).otherwise(zero).alias("direct"),
        F.when(F.col("component") == "carry", F.col("cost_micros")).otherwise(zero).alias("carry"),
        F.lit(0).alias("turn"),
    )
    total = turn_rows.agg(F.sum("total_micros").alias("t"))
    return (
        charged.unionByName(split).groupBy("session_id")
        .agg(
            F.sum("cost").alias("cost_micros"), F.sum("direct").alias("direct_micros"),
            F.sum("carry").alias("carry_micros"), F.sum("turn").alias("turns"),
        )
        .withColumn("other_micros", F.col("cost_micros") - F.col("direct_micros") - F.col("carry_micros"))
        .withColumn("share", share_of(F.col("cost_micros"), total.scalar()))
    )


def session_facts(turn_rows: DataFrame, item_rows: DataFrame) -> DataFrame:
    from tallyfold.functions import paths

    md = paths.suffix(F.col("identity")) == ".md"
    skill = (F.col("category") == "skill") & paths.injected_name(F.col("identity")).isNull()
    per_item = item_rows.groupBy("session_id").agg(
        F.sum("loads").alias("reads"), F.sum(F.when(md, F.col("loads")).otherwise(0)).alias("md_reads"),
        F.count_if(md).alias("md_files"), F.count_if(skill).alias("skills"), F.count(F.lit(1)).alias("items"),
    )
    cost = turn_rows.groupBy("session_id").agg(F.sum("total_micros").alias("cost_micros"), F.count(F.lit(1)).alias("turns"))
    zero = F.lit(0).cast("bigint")
    return cost.join(per_item, "session_id", "left").select(
        "session_id", "cost_micros", "turns",
        *[F.coalesce(c, zero).alias(c) for c in ("reads", "md_reads", "md_files", "skills", "items")],
    )


def note_template(note):
    """Text with figures and lists of figures replaced by one mark."""
    return F.regexp_replace(F.regexp_replace(note, r"\d[\d,.]*", "#"), r"#(?:[,\s]+#)+", "#")


def collapse_notes(notes: DataFrame, order: str) -> DataFrame:
    """Exact copies once, then one line per template: the first text and how many more."""
    distinct = notes.groupBy("note").agg(F.min(order).alias("at"))
    per = distinct.groupBy(note_template(F.col("note")).alias("template")).agg(
        F.min_by("note", "at").alias("first"), F.count(F.lit(1)).alias("n")
    )
    more = F.concat(
        F.col("first"), F.lit(" (and "), (F.col("n") - 1).cast("string"),
        F.lit(" more session(s) with the same limitation, differing only in the figures)"),
    )
    return per.select("template", F.when(F.col("n") == 1, F.col("first")).otherwise(more).alias("note"), "n")


def scope(placed: DataFrame) -> DataFrame:
    """Sessions covered, turns covered, and whether any session is still in progress."""
    per = placed.groupBy("session_id").agg(
        F.sum(F.col("is_turn").cast("bigint")).alias("turns"), F.max("ts").alias("last_ts")
    )
    newest = placed.agg(F.max("ts").alias("ts"))
    live = F.col("last_ts") > (newest.scalar() - F.expr(f"INTERVAL {fixed.IN_PROGRESS_MINUTES} MINUTES"))
    return per.filter("turns > 0").agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("turns").alias("covered_through_turn"),
        F.min("session_id").cast("string").alias("first_session"), F.max("session_id").cast("string").alias("last_session"),
        F.bool_or(live).alias("provisional"),
    )


def scope_sessions(placed: DataFrame, turns: DataFrame) -> DataFrame:
    """session_id, name, turns, provisional, producing_versions of every session with turns; ``turns`` has version."""
    last = placed.groupBy("session_id").agg(F.max("ts").alias("last_ts"))
    live = F.col("last_ts") > (placed.agg(F.max("ts")).scalar() - F.expr(f"INTERVAL {fixed.IN_PROGRESS_MINUTES} MINUTES"))
    per = turns.groupBy("session_id").agg(F.count(F.lit(1)).alias("turns"), F.array_join(F.array_sort(F.collect_set("version")), ",").alias("producing_versions"))
    name = F.col("session_id").cast("string")
    return per.join(last, "session_id").select(name.alias("session_id"), F.substring(name, 1, 8).alias("name"), "turns", live.alias("provisional"), "producing_versions")


def item_details(rollup: DataFrame, turn_rows: DataFrame) -> DataFrame:
    total = turn_rows.agg(F.sum("total_micros").alias("t"))
    band = ro.uncertainty(F.col("total_micros"), F.col("direct_micros"), F.col("carry_micros"), F.col("basis_rank"))
    return (
        ro.lane_costs(rollup)
        .withColumn("confidence", ro.name_of(F.col("confidence_rank"), fixed.CONFIDENCE))
        .withColumn("basis", ro.name_of(F.col("basis_rank"), fixed.BASIS))
        .withColumn("share", share_of(F.col("total_micros"), total.scalar()))
        .withColumn("sig_figs", money.sig_figs(F.col("confidence")))
        .withColumn("u", band)
        .withColumns({"driver": F.col("u.driver"), "low_micros": F.col("u.low"), "high_micros": F.col("u.high")})
        .drop("u")
    )


SORT_COLUMNS = {"cost": "total_micros", "share": "total_micros", "carry": "carry_micros", "direct": "direct_micros", "reads": "reads"}


def ranked(rollup: DataFrame, sort: str) -> DataFrame:
    """Rows in a total order: the measure downwards, the item id breaking ties."""
    if sort not in SORT_COLUMNS:
        raise ValueError(f"unknown sort {sort!r}; known: {fixed.SORTS}")
    return rollup.orderBy(F.desc(SORT_COLUMNS[sort]), "item_id")


def places(rollup: DataFrame, sort: str) -> DataFrame:
    """All rows with their place in the total order, numbered slice by slice."""
    if sort not in SORT_COLUMNS:
        raise ValueError(f"unknown sort {sort!r}; known: {fixed.SORTS}")
    return grouped.spread_rank(rollup, [], [F.desc(SORT_COLUMNS[sort]), F.col("item_id")], "place")


def priced_points(rollup: DataFrame) -> DataFrame:
    """The 120 costliest priced items by cost then name, with how many were left out."""
    paid = rollup.filter("total_micros > 0")
    n = paid.agg(F.count(F.lit(1)).alias("n"))
    return paid.orderBy(F.desc("total_micros"), "identity").limit(fixed.POINTS_SHOWN).withColumn(
        "omitted", F.greatest(F.lit(0), n.scalar() - fixed.POINTS_SHOWN)
    )


def rank_overlap(rollup: DataFrame, k: int) -> DataFrame:
    by_cost = ranked(rollup, "cost").select("item_id").limit(k)
    by_reads = ranked(rollup, "reads").select("item_id").limit(k)
    shared = by_cost.join(by_reads, "item_id", "inner").agg(F.count(F.lit(1)).alias("shared"))
    return shared.select("shared", (F.lit(k) - F.col("shared")).alias("differing"))


def resident_floor(turn_rows: DataFrame, description_chars: int) -> DataFrame:
    """Least cost of a resident description: its tokens at the read rate on every turn."""
    tokens = description_chars // fixed.CHARS_PER_TOKEN
    per = turn_rows.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("turns"), F.sum("total_micros").alias("total"),
        F.min_by("input_rate", "turn_index").alias("rate"),
    )
    cost = cost_micros(F.lit(tokens), F.col("rate"), F.lit(100_000)) * F.col("turns")
    share = share_of(F.col("cost_micros"), F.col("total"))
    return per.withColumn("cost_micros", cost).select(
        "session_id", "turns", "cost_micros", share.alias("share"), (share <= fixed.OVERHEAD_CEILING).alias("within_ceiling")
    )


def row_tags(rollup: DataFrame) -> DataFrame:
    small = F.when(
        F.size("never_cacheable_on") > 0, F.concat(F.lit("too small to cache on "), F.array_join("never_cacheable_on", ", "))
    )
    return rollup.select("item_id", F.array_join(F.array_compact(F.array(F.col("category"), small)), "; ").alias("tags"))


def grouping_conservation(rollup: DataFrame, groupings: DataFrame) -> DataFrame:
    before = rollup.agg(F.sum("total_micros").alias("t"))
    return (
        groupings.filter("dimension <> 'item'").groupBy("dimension").agg(F.sum("total_micros").cast("bigint").alias("after"))
        .select(
            F.col("dimension").alias("grouping"), before.scalar().cast("bigint").alias("before"), "after",
        )
        .withColumn("conserved", F.col("before") == F.col("after"))
    )


def payload_gates(m: lg.Model, rollup: DataFrame) -> DataFrame:
    """Every equation the document must satisfy, with the difference found (0 passes)."""
    facts = m.attributions.agg(
        *[F.sum(F.when(F.col("component") == c, F.col("cost_micros")).otherwise(0)).alias(c) for c in fixed.COMPONENTS],
        F.sum(F.when(F.col("target_kind") == "invalidation_event", F.col("cost_micros")).otherwise(0)).alias("reload"),
        F.sum("cost_micros").alias("attributed"),
    ).withColumn("gate_row", F.lit(1))
    total = m.turns.agg(F.sum("total_micros").alias("t"))
    items = rollup.agg(
        F.sum("direct_micros").alias("d"), F.sum("carry_micros").alias("c"), F.sum("total_micros").alias("t")
    ).withColumn("gate_row", F.lit(1))
    nodes = cost_tree(m, rollup)
    below = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("path")).agg(F.sum("total_micros").alias("below"))
    broken = nodes.join(below, "path", "left").agg(
        F.coalesce(F.sum(F.abs(F.col("total_micros") - F.col("flat_micros") - F.coalesce("below", F.lit(0)))), F.lit(0)).alias("b")
    )
    sides = ro.comparison(rollup).agg(F.sum("cost_micros").alias("s"))
    concluded = sum((F.col(c) for c in fixed.COMPONENTS), F.lit(0))
    series = m.turns.agg(F.sum(F.col("fresh_micros") + F.col("write_micros") + F.col("read_micros") + F.col("output_micros")).alias("t"))
    joined = facts.join(items, "gate_row", "inner")
    gates = {
        "components": concluded - F.col("attributed"),
        "direct": F.col("d") + F.col("reload") - F.col("direct"),
        "carry": F.col("c") - F.col("carry"),
        "turns": series.scalar() - total.scalar(),
        "tree": broken.scalar(),
        "comparison": sides.scalar() - F.col("t"),
    }
    rows = F.array(*[F.struct(F.lit(g).alias("gate"), v.cast("bigint").alias("difference")) for g, v in gates.items()])
    return joined.select(F.explode(rows).alias("r")).select("r.*")


def payload(m: lg.Model, rollup: DataFrame) -> DataFrame:
    """(section, body): every section's rows as JSON."""
    sections = {
        "totals": totals(m.turns, m.attributions),
        "components": ro.charge_components(m.turns),
        "attribution": ro.attribution_components(m.attributions),
        "items": item_details(rollup, m.turns),
        "invalidations": m.events,
        "turns": turn_series(m.turns, lg.boundary_marks(m.compactions)),
        "residency": residency_rows(m.spans, m.ledger),
        "sessions": per_session(m.turns, m.attributions),
    }
    out = None
    for name, rows in sections.items():
        body = rows.select(F.lit(name).alias("section"), F.to_json(F.struct(*rows.columns)).alias("body"))
        out = body if out is None else out.unionByName(body)
    return out
