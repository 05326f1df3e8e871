"""The attribution core: charges, prefix changes, cache lanes and exact splits.

Turns, injections and resident items are stacked into one ledger keyed by (session, turn). That
key spreads even one very long session over all tasks, and one shuffle by it serves every step:
lane classification, forced reloads, and the three largest-remainder splits.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions import fixed
from tallyfold.functions.money import cost_micros
from tallyfold.operators import residency as res
from tallyfold.operators import rollups
from tallyfold.plans import grouped, sizing
from tallyfold.session import stored
from tallyfold.sources.rates import RateTable

KEY = res.SESSION_TURN
#: What the ledger is dealt by: a block of turns of one session goes to one task.
DEAL = ["session_id", "block"]
SHORT = 2**31 - 1


def priced(turn_rows: DataFrame, rates: RateTable) -> DataFrame:
    """The four observed charges of each turn; an unknown model fails.

    Every write window is rounded on its own and the results are added.
    """
    cache = rates.cache
    table = rates.dimension(turn_rows.sparkSession)
    joined = turn_rows.join(table, "model", "left")
    refuse = F.raise_error(F.concat(F.lit("no rate for model "), F.col("model"))).cast("bigint")
    rate = F.when(F.col("input_rate").isNull(), refuse).otherwise(F.col("input_rate"))

    def at(tokens: str, multiplier: int | None = None) -> Column:
        times = None if multiplier is None else F.lit(multiplier)
        return cost_micros(F.col(tokens), rate, times)

    write_tokens = F.col("write_5m") + F.col("write_1h") + F.col("write_unknown")
    return joined.withColumns(
        {
            "write_tokens": write_tokens,
            "prompt_tokens": F.col("input_tokens") + write_tokens + F.col("read_tokens"),
            "fresh_micros": at("input_tokens"),
            "write_micros": at("write_5m", cache.write_5m)
            + at("write_1h", cache.write_1h)
            + at("write_unknown", cache.unknown),
            "read_micros": at("read_tokens", cache.read),
            "output_micros": cost_micros(F.col("output_tokens"), F.col("output_rate")),
            "confidence_cap": F.when(F.col("write_unknown") > 0, F.lit(cache.unknown_confidence)),
        }
    ).withColumn(
        "total_micros",
        F.col("fresh_micros") + F.col("write_micros") + F.col("read_micros") + F.col("output_micros"),
    )


def prefix_changes(placed: DataFrame) -> DataFrame:
    """Every change in front of the messages, on the turn that follows it (from turn 1 on)."""
    switched = res.turns(placed).filter(
        (F.col("turn_index") >= 1) & ~F.col("model").eqNullSafe(F.col("prev_model"))
    )
    switches = switched.select(
        *KEY,
        "line",
        "uuid",
        F.lit(0).alias("seniority"),
        F.lit("tools").alias("tier"),
        F.lit("model_switched").alias("trigger"),
        F.format_string("model switched from %s to %s", "prev_model", "model").alias("detail"),
    )
    others = placed.filter(
        F.col("is_change") & (F.col("turns_before") >= 1) & (F.col("turns_before") < F.col("n_turns"))
    ).select(
        "session_id",
        F.col("turns_before").alias("turn_index"),
        "line",
        "uuid",
        F.lit(1).alias("seniority"),
        "tier",
        "trigger",
        "detail",
    )
    return switches.unionByName(others)


def trigger_rank(trigger: Column) -> Column:
    rank = F.lit(len(fixed.TRIGGERS))
    for i, name in reversed(list(enumerate(fixed.TRIGGERS))):
        rank = F.when(trigger == name, i).otherwise(rank)
    return rank


def change_marks(changes: DataFrame) -> DataFrame:
    """One row per changed turn: the most severe trigger, and the distinct sentences in order.

    The sentences are made distinct before they are gathered, so what is gathered is one text.
    """
    distinct = changes.groupBy(*KEY, "detail").agg(
        F.min(F.struct("seniority", "line")).alias("at"),
        F.min(F.struct(trigger_rank(F.col("trigger")).alias("rank"), "trigger", "tier")).alias("top"),
        F.count(F.lit(1)).alias("n"),
    )
    return distinct.groupBy(*KEY).agg(
        F.min("top").alias("top"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("at", "detail"))), lambda s: s["detail"]), "; "
        ).alias("detail"),
        F.sum("n").alias("n_changes"),
    ).select(*KEY, "top.trigger", "top.tier", "detail", "n_changes")


def boundary_marks(comps: DataFrame) -> DataFrame:
    """Compactions merged per boundary turn: first size before, last size after, dropped summed."""
    return comps.groupBy("session_id", F.col("boundary_turn").alias("turn_index")).agg(
        F.count(F.lit(1)).alias("n_boundaries"),
        F.min_by("pre_tokens", "line").alias("pre_tokens"),
        F.max_by("post_tokens", "line").alias("post_tokens"),
        F.sum(F.greatest(F.lit(0), F.col("pre_tokens") - F.col("post_tokens"))).alias("dropped_tokens"),
    )


@dataclass(frozen=True)
class Model:
    """The stages of one attribution run. With ``keep`` the log, items and spans are written, the ledger and the facts when first used."""

    placed: DataFrame
    turns: DataFrame
    injections: DataFrame
    compactions: DataFrame
    items: DataFrame
    spans: DataFrame
    changes: DataFrame
    marks: DataFrame
    book: DataFrame
    charges: DataFrame
    keep: bool = False

    @cached_property
    def ledger(self) -> DataFrame:
        return stored(self.book, "ledger") if self.keep else self.book

    @cached_property
    def session_items(self) -> DataFrame:
        """Costs and lanes per (session, item), of which there are far fewer than ledger rows."""
        sums = rollups.session_items(self.charges)
        return stored(sums, "session-items") if self.keep else sums

    @property
    def lanes(self) -> DataFrame:
        return lanes(self.ledger)

    @cached_property
    def attributions(self) -> DataFrame:
        facts = attributions(self.ledger)
        return stored(facts, "attribution") if self.keep else facts

    @property
    def events(self) -> DataFrame:
        return events(self.ledger)


def build(
    log: DataFrame,
    rates: RateTable,
    policy: str = "proportional",
    survivors_of=None,
    keep: bool = False,
) -> Model:
    if policy not in fixed.POLICIES:
        raise ValueError(f"unknown policy {policy!r}; known: {fixed.POLICIES}")
    placed = res.place(log)
    if keep:
        placed = stored(placed, "placed")
    inj = res.injections(placed)
    comps = res.compactions(placed)
    item_rows = res.items(inj)
    if keep:
        item_rows = stored(item_rows, "items")
    survivors = survivors_of(inj, comps) if survivors_of else None
    span_rows = res.spans(inj, item_rows, comps, survivors)
    if keep:
        span_rows = stored(span_rows, "spans")
    turn_rows = priced(res.turns(placed), rates)
    changes = prefix_changes(placed)
    marks = change_marks(changes)
    # The row count of what was written comes from the files' footers.
    parts = sizing.ledger_parts(placed.count()) if keep else None
    held = res.held(span_rows)
    book = ledger(turn_rows.join(marks, KEY, "left"), inj, held, None, policy, parts)
    charges = ledger(turn_rows, inj, held, changes, policy, parts)
    return Model(placed, turn_rows, inj, comps, item_rows, span_rows, changes, marks, book, charges, keep)


TURN_FACTS = [
    "model", "input_rate", "threshold", "input_tokens", "write_tokens", "read_tokens",
    "fresh_micros", "write_micros", "read_micros", "output_micros", "total_micros",
    "confidence_cap", "uuid", "line", "trigger", "tier", "detail",
]
#: What the split of the charges reads of a turn, and what the sums per item read of it.
SPLIT_FACTS = [
    "model", "input_rate", "threshold", "input_tokens", "write_tokens", "read_tokens",
    "fresh_micros", "write_micros", "read_micros", "confidence_cap",
]
ITEM_FACTS = ["model", "threshold", "confidence_cap"]


def ledger(
    turn_rows: DataFrame, inj: DataFrame, held: DataFrame, changes: DataFrame | None, policy: str, parts: int | None = None
) -> DataFrame:
    """One row per turn, injection and resident item, with lanes, pools and shares filled in.

    Without ``changes``, the turns carry the marks of their changes, and every row all facts of its turn. With them, only
    injections and resident items are returned, with the few facts that sums per item read: the changes are stacked
    with the other rows, so no mark is made, and the rows that are sorted stay narrow. A span travels once per block of
    turns, and becomes a row per turn in the task that has the block. ``parts`` is the number of tasks that the blocks
    are dealt to; without it the number is left to Spark.
    """
    narrow = changes is not None
    stacked = (
        turn_rows.select(*KEY, F.lit("turn").alias("row"), F.struct(*(SPLIT_FACTS if narrow else TURN_FACTS)).alias("t"))
        .unionByName(
            inj.select(
                *KEY, F.lit("inj").alias("row"), "item_id", "size_tokens",
                F.col("line").alias("pos"), F.col("uuid").alias("inj_uuid"),
            ),
            allowMissingColumns=True,
        )
        .unionByName(
            _by_block(held).select(
                *KEY, "until", F.lit("res").alias("row"), "item_id", "size_tokens",
                F.col("opened_line").alias("pos"), "first_turn",
            ),
            allowMissingColumns=True,
        )
    )
    if narrow:
        stacked = stacked.unionByName(changes.select(*KEY, F.lit("chg").alias("row")), allowMissingColumns=True)
    stacked = stacked.withColumn("block", sizing.block_of(F.col("turn_index")))
    stacked = stacked.repartition(parts, *DEAL) if parts else stacked.repartition(*DEAL)
    turns_of = F.sequence("turn_index", F.coalesce("until", "turn_index"))
    stacked = stacked.select(
        *[c for c in stacked.columns if c not in ("turn_index", "until")], F.explode(turns_of).alias("turn_index")
    )
    at_turn = [*DEAL, "turn_index"]
    is_inj, is_res = F.col("row") == "inj", F.col("row") == "res"
    size = F.col("size_tokens")
    zero = F.lit(0).cast("bigint")
    # 1. what the turn brings, spread to all of its rows. The finer groups come first: rows sorted by them lie sorted
    # for the coarser ones, so this and the sums below share one sort, and the rank and the given another.
    spread = grouped.with_totals(
        stacked, [*at_turn, "item_id"], _injected=F.max(F.when(is_inj, 1).otherwise(0))
    )
    spread = grouped.with_totals(
        spread, at_turn,
        _t=F.first("t", ignorenulls=True),
        arrived_tokens=F.sum(F.when(is_inj, size).otherwise(zero)),
        n_injections=F.count(F.when(is_inj, 1)),
        _n_changes=F.count(F.when(F.col("row") == "chg", 1)),
    )
    spread = spread.drop("t").withColumnRenamed("_t", "t")
    t = F.col("t")
    injected = F.col("_injected") == 1
    changed = F.col("_n_changes") > 0 if narrow else t["trigger"].isNotNull()
    known = t["threshold"].isNotNull()
    below = is_res & F.coalesce(size < t["threshold"], F.lit(False))
    older = is_res & (F.col("first_turn") < F.col("turn_index")) & ~injected
    # 2. the lane of each resident item
    fresh_copy = (injected | changed) & (t["write_tokens"] > 0)
    lane = (
        F.when(below, "uncached")
        .when(is_res & fresh_copy, "loading")
        .when(is_res & (t["read_tokens"] > 0), "cached")
    )
    classed = spread.withColumn("lane", lane)
    sums = grouped.with_totals(
        classed, at_turn,
        below_tokens=F.sum(F.when(below, size).otherwise(zero)),
        cached_tokens=F.sum(F.when(F.col("lane") == "cached", size).otherwise(zero)),
        n_cached=F.count(F.when(F.col("lane") == "cached", 1)),
        reloaded_tokens=F.sum(F.when(older, size).otherwise(zero)),
        n_reloaded=F.count(F.when(older, 1)),
    )
    lane = F.col("lane")
    capped = F.when(known, F.lit("high")).otherwise("low")
    supported = (F.col("below_tokens") > 0) & (t["input_tokens"] >= F.col("below_tokens"))
    confidence = (
        F.when(lane == "uncached", F.when(supported, "high").otherwise("low"))
        .when(lane == "loading", capped)
        .when(lane == "cached", F.when(injected | changed, "low").otherwise(capped))
    )
    reason = (
        F.when(lane == "uncached", "below_minimum")
        .when(lane == "loading", F.when(changed, "reload_forced").otherwise("first_load"))
        .when(lane == "cached", "cacheable")
    )
    # 3. the part of a write that only a prefix change explains
    writes = (t["write_tokens"] > 0) & (t["write_micros"] > 0)
    excess = F.least(t["write_tokens"] - F.col("arrived_tokens"), F.col("reloaded_tokens"))
    reload_micros = F.when(
        writes & (excess > 0),
        F.call_function(
            "div", t["write_micros"].cast("decimal(19,0)") * excess.cast("decimal(19,0)"),
            t["write_tokens"].cast("decimal(19,0)"),
        ),
    ).otherwise(zero)
    forced = F.when(changed, reload_micros).otherwise(zero)
    forced_basis = F.when(writes & (excess > 0), "estimated").otherwise("measured")
    forced_confidence = (
        F.when(~writes, "high")
        .when(excess <= 0, "medium")
        .otherwise(F.coalesce(t["confidence_cap"], F.lit("low")))
    )
    # 4. pools and their weights
    below_cost = cost_micros(F.col("below_tokens"), t["input_rate"])
    fresh_part = F.when(
        (F.col("below_tokens") > 0) & (t["fresh_micros"] > 0), F.least(below_cost, t["fresh_micros"])
    ).otherwise(zero)
    pooled = sums.withColumns(
        {
            "lane_reason": reason,
            "lane_confidence": confidence,
            "injected": injected,
            "forced_micros": forced,
            "forced_basis": F.when(changed, forced_basis),
            "forced_confidence": F.when(changed, forced_confidence),
            "fresh_attributed": fresh_part,
            "pool": F.when(is_inj, "direct").otherwise(F.coalesce(lane, F.lit("none"))),
        }
    )
    if policy == "exclusive":
        read_pool = F.when(F.col("n_cached") == 1, t["read_micros"]).otherwise(zero)
    else:
        read_pool = t["read_micros"]
    if narrow:
        pooled = pooled.filter(is_inj | is_res)
    pool = F.col("pool")
    amount = (
        F.when(pool == "direct", F.greatest(zero, t["write_micros"] - F.col("forced_micros")))
        .when(pool == "uncached", F.col("fresh_attributed"))
        .when(pool == "cached", read_pool)
        .otherwise(zero)
    )
    total = (
        F.when(pool == "direct", F.col("arrived_tokens"))
        .when(pool == "uncached", F.col("below_tokens"))
        .when(pool == "cached", F.col("cached_tokens"))
        .otherwise(F.lit(1))
    )
    weight, whole = F.coalesce(size, zero), F.greatest(F.col("_total"), F.lit(1))
    product = F.col("_amount").cast("decimal(19,0)") * weight.cast("decimal(19,0)")
    # Factors of 31 bits are multiplied as whole numbers, which is exact as well and far cheaper than decimals.
    short = F.abs(F.col("_amount")).between(0, SHORT) & F.abs(weight).between(0, SHORT)
    quick = F.col("_amount") * weight
    cutp = pooled.withColumns({"_amount": amount, "_total": total})
    if narrow:
        cutp = cutp.withColumn("t", F.struct(*[t[name].alias(name) for name in ITEM_FACTS]))
    cutp = cutp.withColumns(
        {
            "_floor": F.when(short, F.call_function("div", quick, whole)).otherwise(
                F.call_function("div", product, whole.cast("decimal(19,0)"))
            ),
            "_rest": F.when(short, quick % whole).otherwise((product % whole.cast("decimal(19,0)")).cast("bigint")),
        }
    )
    ranked = grouped.with_rank(
        cutp, [*at_turn, "pool"], [F.col("_rest").desc(), F.col("pos"), F.col("row")], "_rank"
    )
    given = grouped.with_totals(ranked, [*at_turn, "pool"], _given=F.sum("_floor"))
    share = F.col("_floor") + F.when(F.col("_rank") <= F.col("_amount") - F.col("_given"), 1).otherwise(0)
    return given.withColumn(
        "share", F.when(pool.isin("direct", "uncached", "cached"), share.cast("bigint")).otherwise(zero)
    ).drop("_injected", "_n_changes", "_amount", "_total", "_floor", "_rest", "_given", "_rank", *([] if narrow else ["block"]))


def _by_block(held: DataFrame) -> DataFrame:
    """Spans cut into the blocks that they reach into, each from ``turn_index`` to ``until``."""
    first = F.col("block") * sizing.BLOCK_TURNS
    blocks = F.sequence(sizing.block_of(F.col("start")), sizing.block_of(F.col("end_turn")))
    return held.withColumn("block", F.explode(blocks)).withColumns(
        {
            "turn_index": F.greatest("start", first),
            "until": F.least(F.col("end_turn"), first + (sizing.BLOCK_TURNS - 1)),
        }
    )


def lanes(book: DataFrame) -> DataFrame:
    return book.filter((F.col("row") == "res") & F.col("lane").isNotNull()).select(
        *KEY, "item_id", F.col("t.model").alias("model"), "lane", "lane_reason", "size_tokens",
        F.col("t.threshold").alias("threshold"), "lane_confidence", "pos", "share",
    )


def events(book: DataFrame) -> DataFrame:
    """One invalidation event per changed turn."""
    return book.filter((F.col("row") == "turn") & F.col("t.trigger").isNotNull()).select(
        *KEY,
        F.concat_ws(":", F.lit("inval"), F.col("session_id"), F.col("turn_index")).alias("event_id"),
        F.col("t.tier").alias("tier"),
        F.col("t.trigger").alias("trigger"),
        F.col("t.detail").alias("detail"),
        "forced_micros",
        F.col("n_reloaded").alias("items_reloaded"),
        F.col("forced_basis").alias("basis"),
        F.col("forced_confidence").alias("confidence"),
    )


def source_ref(uuid: Column, line: Column) -> Column:
    return F.concat(uuid.cast("string"), F.lit("@line"), line.cast("string"))


def attributions(book: DataFrame) -> DataFrame:
    """The central fact: who is charged what, on which turn. Zero rows are not written."""
    t = F.col("t")
    turn_ref = source_ref(t["uuid"], t["line"])

    def fact(target, target_id, component, cost, basis, confidence, item_ref=None):
        return F.struct(
            F.lit(target).alias("target_kind"),
            target_id.cast("string").alias("target_id"),
            F.lit(component).alias("component"),
            cost.cast("bigint").alias("cost_micros"),
            basis.alias("basis"),
            confidence.alias("confidence"),
            turn_ref.alias("turn_ref"),
            (F.lit(None) if item_ref is None else item_ref).cast("string").alias("item_ref"),
        )

    none = F.lit(None).cast("string")
    event_id = F.concat_ws(":", F.lit("inval"), F.col("session_id"), F.col("turn_index"))
    exact, high, measured = F.lit("exact"), F.lit("high"), F.lit("measured")
    overhead = t["fresh_micros"] - F.col("fresh_attributed")
    of_turn = F.array(
        fact("prompt", none, "output", t["output_micros"], exact, high),
        fact("prompt", none, "overhead", overhead, exact, high),
        fact(
            "invalidation_event", event_id, "direct", F.col("forced_micros"),
            F.coalesce("forced_basis", measured), F.coalesce("forced_confidence", high),
        ),
    )
    of_inj = F.array(
        fact(
            "item", F.col("item_id"), "direct", F.col("share"), measured,
            F.coalesce(t["confidence_cap"], F.lit("medium")), source_ref(F.col("inj_uuid"), F.col("pos")),
        )
    )
    of_res = F.array(
        fact("item", F.col("item_id"), "carry", F.col("share"), measured, F.lit("medium"))
    )
    facts = F.when(F.col("row") == "turn", of_turn).when(F.col("row") == "inj", of_inj).otherwise(of_res)
    return (
        book.select(*KEY, F.explode(facts).alias("f"))
        .select(*KEY, "f.*")
        .filter(F.col("cost_micros") != 0)
    )


def reconcile(turn_rows: DataFrame, facts: DataFrame, strict: bool = True) -> DataFrame:
    """Per session: total = attributed + unattributed, in integers; over-attribution is an error."""
    charged = turn_rows.select("session_id", "total_micros", F.lit(0).cast("bigint").alias("cost"))
    split = facts.select(
        "session_id", F.lit(0).cast("bigint").alias("total_micros"), F.col("cost_micros").alias("cost")
    )
    out = (
        charged.unionByName(split)
        .groupBy("session_id")
        .agg(F.sum("total_micros").alias("total_micros"), F.sum("cost").alias("attributed_micros"))
        .withColumn("unattributed_micros", F.col("total_micros") - F.col("attributed_micros"))
    )
    if not strict:
        return out
    refuse = F.raise_error(
        F.concat(F.lit("over-attributed session "), F.col("session_id").cast("string"))
    ).cast("bigint")
    return out.withColumn(
        "unattributed_micros",
        F.when(F.col("unattributed_micros") < 0, refuse).otherwise(F.col("unattributed_micros")),
    )
