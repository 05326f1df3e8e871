"""Rollups over the attribution ledger: items, groupings, hierarchy, series and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions import fixed, money, paths
from tallyfold.operators.residency import SESSION_ITEM
from tallyfold.plans import grouped


def rank_of(value: Column, ladder: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in ladder]), value) - 1


def name_of(rank: Column, ladder: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in ladder]), (rank + 1).cast("int"))


def session_items(book: DataFrame) -> DataFrame:
    """Per (session, item): costs and lane token-turns, from the narrow ledger.

    A block of turns lies in one task, so it is summed there, by model, before anything is shuffled.
    """
    is_inj, is_res = F.col("row") == "inj", F.col("row") == "res"
    size, share = F.col("size_tokens"), F.col("share")
    zero = F.lit(0).cast("bigint")
    cap = rank_of(F.coalesce(F.col("t.confidence_cap"), F.lit("medium")), fixed.CONFIDENCE)
    lane_sums = {
        f"{lane}_{what}": F.when(is_res & (F.col("lane") == lane), value).otherwise(zero)
        for lane in fixed.LANES
        for what, value in (("turns", F.lit(1).cast("bigint")), ("token_turns", size))
    }
    sums = {
        "direct_micros": F.when(is_inj, share).otherwise(zero),
        "carry_micros": F.when(is_res, share).otherwise(zero),
        "rows": (share != 0).cast("int").cast("bigint"),
        **lane_sums,
    }
    unknown = is_res & F.col("lane").isNotNull() & F.col("t.threshold").isNull()
    blocks = book.filter(is_inj | is_res).groupBy("session_id", "block", "item_id", F.col("t.model").alias("model")).agg(
        *[F.sum(value).alias(name) for name, value in sums.items()],
        F.max(F.when(share != 0, F.when(is_inj, cap).otherwise(1))).alias("confidence_rank"),
        F.max(F.when(unknown, 1)).alias("unknown"),
    )
    return blocks.groupBy(*SESSION_ITEM).agg(
        *[F.sum(name).alias(name) for name in sums],
        F.max("confidence_rank").alias("confidence_rank"),
        F.collect_set(F.when(F.col("uncached_turns") > 0, F.col("model"))).alias("never_cacheable_on"),
        F.collect_set(F.when(F.col("unknown") == 1, F.col("model"))).alias("threshold_unknown_on"),
    )


def item_rollup(session_rows: DataFrame, item_rows: DataFrame, span_rows: DataFrame) -> DataFrame:
    """One row per item over all sessions in which it was charged something, from the rows of ``session_items``.

    The three inputs share the key (session, item); only the second, pre-aggregated step
    shuffles on the item.
    """
    charged = session_rows.filter("rows > 0")
    held = span_rows.groupBy(*SESSION_ITEM).agg(F.sum("turns_held").alias("turns_resident"))
    known = item_rows.select(
        *SESSION_ITEM, "kind", "identity", "category", "size_tokens", "loads",
        rank_of(F.col("basis"), fixed.BASIS).alias("item_basis"),
        rank_of(F.col("confidence"), fixed.CONFIDENCE).alias("item_confidence"),
    )
    per_session = charged.join(known, SESSION_ITEM, "inner").join(held, SESSION_ITEM, "inner")
    total = F.sum("direct_micros") + F.sum("carry_micros")
    return per_session.groupBy("item_id").agg(
        F.any_value("kind").alias("kind"),
        F.any_value("identity").alias("identity"),
        F.any_value("category").alias("category"),
        F.max("size_tokens").alias("size_tokens"),
        F.sum("direct_micros").alias("direct_micros"),
        F.sum("carry_micros").alias("carry_micros"),
        total.alias("total_micros"),
        F.sum("loads").alias("reads"),
        F.sum("turns_resident").alias("turns_resident"),
        F.greatest(F.lit(1), F.min_by("item_basis", "session_id")).cast("bigint").alias("basis_rank"),
        F.greatest(F.max("confidence_rank"), F.min_by("item_confidence", "session_id"))
        .cast("bigint")
        .alias("confidence_rank"),
        F.count(F.lit(1)).alias("sessions"),
        F.sum("cached_token_turns").alias("cached_token_turns"),
        F.sum("uncached_token_turns").alias("uncached_token_turns"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("never_cacheable_on")))).alias(
            "never_cacheable_on"
        ),
    )


def group_key(dimension: str) -> Column:
    kind = F.concat(F.lit("("), F.col("kind"), F.lit(")"))
    identity = F.col("identity")
    if dimension == "item":
        return F.col("item_id")
    if dimension == "file":
        return identity
    if dimension == "category":
        return F.col("category")
    if dimension == "folder":
        up = paths.parent(identity)
        return F.when(up.isin(".", "/"), kind).otherwise(up)
    if dimension == "ext":
        ext = paths.suffix(identity)
        return F.when(ext == "", kind).otherwise(ext)
    raise ValueError(f"unknown grouping {dimension!r}; known: {fixed.GROUPINGS}")


def _same_or_mixed(name: str) -> Column:
    return F.when(F.min(name) == F.max(name), F.min(name)).otherwise("(mixed)").alias(name)


ADDITIVE = [
    "direct_micros", "carry_micros", "total_micros", "reads", "turns_resident",
    "cached_token_turns", "uncached_token_turns",
]


def _merged(size: Column) -> list[Column]:
    return [
        _same_or_mixed("kind"),
        _same_or_mixed("category"),
        size.alias("size_tokens"),
        *[F.sum(c).alias(c) for c in ADDITIVE],
        F.max("basis_rank").alias("basis_rank"),
        F.max("confidence_rank").alias("confidence_rank"),
    ]


def regroup(rollup: DataFrame, dimension: str) -> DataFrame:
    """Rows merged by one dimension; sizes add, differing kinds and categories become (mixed)."""
    keyed = rollup.withColumn("group_key", group_key(dimension))
    return keyed.groupBy("group_key").agg(*_merged(F.sum("size_tokens")))


def all_groupings(rollup: DataFrame) -> DataFrame:
    """All five dimensions in one pass (one Expand, one shuffle)."""
    keyed = rollup.select(
        "kind", "size_tokens", "basis_rank", "confidence_rank", *ADDITIVE,
        *[group_key(d).alias(f"k_{d}") for d in fixed.GROUPINGS],
    )
    keys = [f"k_{d}" for d in fixed.GROUPINGS]
    grouped_rows = keyed.groupingSets([[k] for k in keys], *keys).agg(
        F.grouping_id(*keys).alias("gid"),
        F.count(F.lit(1)).alias("members"),
        F.sum("size_tokens").alias("size_tokens"),
        *[F.sum(c).alias(c) for c in ADDITIVE],
    )
    bits = {(1 << len(keys)) - 1 - (1 << (len(keys) - 1 - i)): d for i, d in enumerate(fixed.GROUPINGS)}
    dimension = F.lit(None).cast("string")
    for gid, d in bits.items():
        dimension = F.when(F.col("gid") == gid, d).otherwise(dimension)
    return grouped_rows.select(
        dimension.alias("dimension"), F.coalesce(*keys).alias("group_key"), "members", "size_tokens", *ADDITIVE
    )


def collapse_injected(rollup: DataFrame) -> DataFrame:
    """Copies of one injected text over projects become one row (sizes take the maximum)."""
    collapsible = paths.injected_name(F.col("identity")).isNotNull()
    key = F.when(collapsible, F.concat_ws(":", "kind", "identity")).otherwise(F.col("item_id"))
    return (
        rollup.withColumn("collapse_key", key)
        .groupBy("collapse_key")
        .agg(F.min("identity").alias("identity"), *_merged(F.max("size_tokens")))
        .withColumnRenamed("collapse_key", "item_id")
    )


def uncertainty(total: Column, direct: Column, carry: Column, basis_rank: Column) -> Column:
    """STRUCT<driver, low, high>: what makes a figure uncertain, and how far it may move."""
    few, many = fixed.CHARS_PER_TOKEN_RANGE
    est = fixed.CHARS_PER_TOKEN

    def band(driver: str, low: Column, high: Column) -> Column:
        return F.struct(
            F.lit(driver).alias("driver"), low.cast("bigint").alias("low"), high.cast("bigint").alias("high")
        )

    zero = F.lit(0).cast("bigint")
    return (
        F.when(
            basis_rank == 2,
            band(
                "size_estimate",
                F.call_function("div", total * est, F.lit(many)),
                F.call_function("div", total * est, F.lit(few)),
            ),
        )
        .when(
            carry > direct,
            band("carry_split_policy", F.greatest(zero, total - carry), total + carry),
        )
        .otherwise(band("turn_level_join", F.greatest(zero, total - direct), total + direct))
    )


def cause_label(total: Column, carry: Column) -> Column:
    kept = carry.cast("double") / total.cast("double")
    return (
        F.when(total <= 0, "no cost")
        .when(kept >= fixed.HELD_SHARE, "mostly the keeping")
        .when(kept <= fixed.READ_SHARE, "mostly the loading")
        .otherwise("an even mix")
    )


def lane_costs(rollup: DataFrame) -> DataFrame:
    """Carry cost split over the cached and uncached lanes by token-turns, to the unit."""
    carry = F.col("carry_micros")
    both = F.col("cached_token_turns") + F.col("uncached_token_turns")
    refuse = F.raise_error(F.concat(F.lit("carry without a lane: "), F.col("item_id"))).cast("bigint")
    d19 = "decimal(19,0)"

    def whole(w: str) -> Column:
        return F.call_function(
            "div", carry.cast(d19) * F.col(w).cast(d19), F.greatest(both, F.lit(1)).cast(d19)
        )

    def rest(w: str) -> Column:
        return (carry.cast(d19) * F.col(w).cast(d19)) % F.greatest(both, F.lit(1)).cast(d19)

    spare = carry - whole("cached_token_turns") - whole("uncached_token_turns")
    first = rest("cached_token_turns") >= rest("uncached_token_turns")
    cached = whole("cached_token_turns") + F.when((spare > 0) & first, spare).otherwise(0)
    cached = F.when(both == 0, F.when(carry == 0, F.lit(0).cast("bigint")).otherwise(refuse)).otherwise(cached)
    return rollup.withColumns(
        {
            "cached_micros": cached.cast("bigint"),
            "uncached_micros": (carry - cached).cast("bigint"),
            "loading_micros": F.col("direct_micros"),
        }
    )


def directories(leaves: DataFrame) -> DataFrame:
    """(path, depth, total_micros, items) of every ancestor directory of the leaves' identities."""
    return (
        leaves.select(F.posexplode(paths.ancestors(F.col("identity"))).alias("at", "path"), "total_micros")
        .groupBy("path", "at")
        .agg(F.sum("total_micros").alias("total_micros"), F.count(F.lit(1)).alias("items"))
        .select("path", (F.col("at") + 1).cast("bigint").alias("depth"), "total_micros", "items")
    )


def parent_path(path: Column) -> Column:
    up = F.regexp_replace(path, r"/[^/]*$", "")
    return F.when(up == "", "/").otherwise(up)


def tree(leaves: DataFrame, extra: DataFrame) -> DataFrame:
    """All nodes: directories, item leaves, the fixed non-item leaves and the root.

    ``extra`` holds (path, flat_micros) of overhead, output, forced reloads and the remainder.
    A directory's own cost is zero; ``total_micros`` covers everything below a node.
    """
    dirs = directories(leaves).select("path", "depth", F.lit(0).cast("bigint").alias("flat_micros"), "total_micros")
    depth = F.size(paths.parts(F.col("identity"))).cast("bigint")
    tips = leaves.select(
        F.col("identity").alias("path"), depth.alias("depth"),
        F.col("total_micros").alias("flat_micros"), "total_micros",
    )
    others = extra.select(
        "path", F.lit(1).cast("bigint").alias("depth"), "flat_micros", F.col("flat_micros").alias("total_micros")
    ).filter("flat_micros <> 0")
    top = (
        tips.select("total_micros").unionByName(others.select("total_micros"))
        .agg(F.sum("total_micros").alias("total_micros"))
        .select(
            F.lit("/").alias("path"), F.lit(0).cast("bigint").alias("depth"),
            F.lit(0).cast("bigint").alias("flat_micros"), "total_micros",
        )
    )
    up = F.when(F.col("depth") == 0, F.lit(None).cast("string")).when(
        F.col("path").startswith("/"), parent_path(F.col("path"))
    ).otherwise("/")
    return dirs.unionByName(tips).unionByName(others).unionByName(top).withColumn("parent", up)


def compressed_directories(leaves: DataFrame) -> DataFrame:
    """Directories after folding each one whose only child is another directory into that child.

    A directory folds when it has one child and that child is a directory. A kept directory is
    named by its path from the nearest kept ancestor down; that ancestor is found by exploding
    its prefixes and joining, so no recursion over the tree is needed.
    """
    dirs = directories(leaves)
    children = (
        dirs.filter("depth > 1").select(parent_path(F.col("path")).alias("path"), F.lit(1).alias("dir_child"))
        .unionByName(
            leaves.select(parent_path(F.col("identity")).alias("path"), F.lit(0).alias("dir_child"))
        )
        .groupBy("path")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("dir_child").alias("n_dirs"))
    )
    flagged = dirs.join(children, "path", "inner").withColumn(
        "folds", (F.col("n") == 1) & (F.col("n_dirs") == 1)
    )
    kept = flagged.filter(~F.col("folds"))
    above = kept.select(
        F.col("path").alias("node"), F.explode(paths.ancestors(F.col("path"))).alias("path")
    )
    nearest = (
        above.join(kept.select("path", "depth"), "path", "inner")
        .groupBy("node")
        .agg(F.max_by("path", "depth").alias("kept_parent"), F.max("depth").alias("kept_depth"))
        .withColumnRenamed("node", "path")
    )
    base = F.coalesce(F.col("kept_depth"), F.lit(0)).cast("int")
    segments = paths.parts(F.col("path"))
    return kept.join(nearest, "path", "left").select(
        "path",
        F.coalesce("kept_parent", F.lit("/")).alias("parent"),
        F.array_join(F.slice(segments, base + 1, F.size(segments)), "/").alias("name"),
        "total_micros",
    )


def comparison_side(kind: Column, identity: Column, category: Column) -> Column:
    label = F.lit(None).cast("string")
    for key, text in fixed.INSTRUCTION_LABELS.items():
        label = F.when(kind == key, text).otherwise(label)

    def side(name: str, text: Column) -> Column:
        return F.struct(F.lit(name).alias("side"), text.alias("label"))

    return (
        F.when(label.isNotNull(), side("resident_instruction", label))
        .when(kind != "file", side("unassigned", F.concat(kind, F.lit(" content"))))
        .when(
            F.lower(paths.name(identity)).isin(*fixed.INSTRUCTION_NAMES),
            side("resident_instruction", F.lit(fixed.INSTRUCTION_LABELS["instruction_file"])),
        )
        .when(category == "skill", side("resident_instruction", F.lit(fixed.INSTRUCTION_LABELS["skill"])))
        .otherwise(side("work_driven_reads", category))
    )


def comparison(rollup: DataFrame) -> DataFrame:
    sided = rollup.withColumn(
        "s", comparison_side(F.col("kind"), F.col("identity"), F.col("category"))
    )
    return sided.groupBy(F.col("s.side").alias("side"), F.col("s.label").alias("label")).agg(
        F.sum("size_tokens").alias("tokens"), F.sum("total_micros").alias("cost_micros"),
        F.count(F.lit(1)).alias("members"),
    )


def charge_components(turn_rows: DataFrame) -> DataFrame:
    """Tokens and micros per charge component: one aggregate, then four rows."""
    sums = turn_rows.agg(
        F.sum("input_tokens").alias("t0"), F.sum("fresh_micros").alias("m0"),
        F.sum("write_tokens").alias("t1"), F.sum("write_micros").alias("m1"),
        F.sum("read_tokens").alias("t2"), F.sum("read_micros").alias("m2"),
        F.sum("output_tokens").alias("t3"), F.sum("output_micros").alias("m3"),
        F.sum("total_micros").alias("total"),
    )
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("component"), F.col(f"t{i}").alias("tokens"), F.col(f"m{i}").alias("cost_micros"))
            for i, c in enumerate(fixed.CHARGE_COMPONENTS)
        ]
    )
    return sums.select(F.explode(rows).alias("c"), "total").select(
        "c.*", money.share_of(F.col("c.cost_micros"), F.col("total")).alias("share")
    )


def attribution_components(facts: DataFrame) -> DataFrame:
    """Micros and weakest confidence per attribution component, zero rows kept."""
    sums = facts.agg(
        *[
            F.coalesce(F.sum(F.when(F.col("component") == c, F.col("cost_micros"))), F.lit(0)).alias(f"m{i}")
            for i, c in enumerate(fixed.COMPONENTS)
        ],
        *[
            F.coalesce(
                F.max(F.when(F.col("component") == c, rank_of(F.col("confidence"), fixed.CONFIDENCE))), F.lit(0)
            ).alias(f"r{i}")
            for i, c in enumerate(fixed.COMPONENTS)
        ],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("component"), F.col(f"m{i}").cast("bigint").alias("cost_micros"),
                name_of(F.col(f"r{i}"), fixed.CONFIDENCE).alias("confidence"),
            )
            for i, c in enumerate(fixed.COMPONENTS)
        ]
    )
    return sums.select(F.explode(rows).alias("c")).select("c.*")


def session_turns(turn_rows: DataFrame) -> DataFrame:
    """Per session its turn count and the number of turns in all smaller session ids."""
    counts = turn_rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("turns"))
    return grouped.running_offsets(counts, "session_id", "turns", "turn_offset")


def top_with_rest(rows: DataFrame, key: str, cost: str, k: int) -> DataFrame:
    """The k costliest rows and one row for all others; together they sum to the input."""
    best = rows.orderBy(F.desc(cost), key).limit(k)
    sums = rows.agg(F.sum(cost).alias("all_cost"), F.count(F.lit(1)).alias("all_rows"))
    mine = best.agg(F.coalesce(F.sum(cost), F.lit(0)).alias("top_cost"), F.count(F.lit(1)).alias("top_rows"))
    rest = sums.select(
        F.format_string("%d other items", (F.col("all_rows") - mine.select("top_rows").scalar())).alias(key),
        (F.col("all_cost") - mine.select("top_cost").scalar()).alias(cost),
    )
    return best.select(F.col(key), F.col(cost)).unionByName(rest)
