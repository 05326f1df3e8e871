"""Limitations: what a reader must be told beside the figures, as rules over one row of facts for each session.

A rule is a name, a condition and a text. All rules are looked at in one pass over the facts; a rule whose condition is not
true says nothing. What a rule rests on travels with its note as ``evidence``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions import fixed
from tallyfold.operators import report


@dataclass(frozen=True)
class Rule:
    """``text`` and ``evidence`` are SQL over the facts, ``when`` a SQL condition."""

    name: str
    when: str
    text: str
    evidence: str = "null"


#: The sentences, in the order in which they are told.
SESSION_RULES = (
    Rule("imputed", "true", "concat('Costs are API-equivalent estimates imputed from the ', origin, ' pricing table, rates as published ', priced_on, '. They are not billed amounts.')", "origin"),
    Rule("stripped", "true", "'Some resident instruction content is stripped before the transcript is written, so a portion of the cost is provably absent from the source records.'"),
    Rule(
        "undated_rates", "age_days is null",
        "concat('The ', origin, ' rate table does not record when its rates were published, so how current they are cannot be judged. Replace it with a dated one.')", "priced_on",
    ),
    Rule(
        "stale_rates", f"age_days >= {fixed.STALE_AFTER_DAYS}",
        "concat('These rates were published ', age_days, ' days ago (', priced_on, ') and have not been checked since. Prices change a few times a year; refresh the table to update them.')", "age_days",
    ),
    Rule("unparseable", "unparseable > 0", "concat(unparseable, ' record(s) could not be parsed and are excluded from every figure here.')", "unparseable"),
    Rule(
        "usage_conflict", "conflicts > 0",
        "concat(conflicts, ' exchange(s) appeared more than once with different token counts; the first occurrence was used and the conflict is listed in diagnostics.')", "conflicts",
    ),
    Rule(
        "residual_drop", "residual > 0",
        "concat('About ', format_number(residual, 0), ' tokens left the conversation before a compaction, which leaves no record of what was cleared."
        " That content''s carry cost cannot be attributed to any item.')", "residual",
    ),
    Rule("version_span", "size(versions) > 1", "concat('This session spans producing versions ', array_join(versions, ', '), '; figures may not be comparable across the boundary.')", "size(versions)"),
)
REPORT_RULES = (
    Rule(
        "sub_threshold", "true",
        "'Content too small to cache is charged as fresh input at full rate every turn. That cost is charged to the item as carry cost and shown in its sub-threshold lane;"
        " the split between the two carry lanes is by token-turns, not separately measured.'",
    ),
    Rule(
        "broken_spans", "broken_spans > 0",
        "concat(broken_spans, ' residency span(s) include turns whose records support no cache lane, so those spans carry no per-turn lane breakdown rather than a guessed one.')", "broken_spans",
    ),
    Rule(
        "threshold_gap", "size(gaps) > 0",
        "concat('The minimum cacheable size is not recorded for ', array_join(gaps, ', '), ', so items were not checked for cacheability on ', if(size(gaps) = 1, 'that model', 'those models'), '.')", "size(gaps)",
    ),
    Rule(
        "never_cacheable", "size(flagged) > 0",
        "concat('Some items are smaller than the minimum cacheable size on ', array_join(flagged, ', '), ', where they are charged at full rate every turn rather than at the cache-read rate.')", "size(flagged)",
    ),
)


def told(facts: DataFrame, rules: tuple[Rule, ...], *keys: str) -> DataFrame:
    """keys, rule, place (of the rule), note, evidence: what the rules say of each row of facts, from one pass."""
    said = [
        F.when(
            F.expr(r.when),
            F.struct(F.lit(r.name).alias("rule"), F.lit(k).cast("bigint").alias("place"), F.expr(r.text).alias("note"), F.expr(r.evidence).cast("string").alias("evidence")),
        )
        for k, r in enumerate(rules)
    ]
    return facts.select(*keys, F.explode(F.array_compact(F.array(*said))).alias("n")).select(*keys, "n.*")


def session_facts(turns: DataFrame, comps: DataFrame, conflicts: DataFrame, unparseable: DataFrame, provenance: DataFrame) -> DataFrame:
    """One row for each session with turns; ``turns`` has version, ``provenance`` origin, priced_on and until (the day the rates are judged on)."""
    versions = turns.groupBy("session_id").agg(F.array_sort(F.collect_set("version")).alias("versions"))
    dropped = F.greatest(F.lit(0), F.col("pre_tokens") - F.col("post_tokens"))
    residual = comps.groupBy("session_id").agg(F.max(F.col("cumulative_tokens") - dropped).alias("residual"))
    dated = provenance.withColumn("age_days", F.datediff("until", F.col("priced_on").try_cast("date")))
    out = versions
    for part in (residual, conflicts, unparseable, dated):
        out = out.join(part, "session_id", "left")
    return out


def uncertainty(notes: DataFrame, policy: str) -> DataFrame:
    """All sessions' notes, one line for those that differ in their figures only, and how shared cost is divided."""
    collapsed = report.collapse_notes(notes.withColumn("at", F.struct("session_id", "place")), "at").select("note")
    text = f"Shared carry cost is divided by the '{policy}' policy: {fixed.POLICY_TEXT[policy]} A different policy moves per-item figures without changing the total."
    return collapsed.unionByName(notes.agg(F.count(F.lit(1))).select(F.lit(text).alias("note")))


def report_facts(spans: DataFrame, turns: DataFrame, rollup: DataFrame) -> DataFrame:
    """One row: spans without a lane breakdown, models without a threshold, models on which some item can never be cached."""

    def models(rows: DataFrame, column: Column, name: str) -> DataFrame:
        return rows.agg(F.array_sort(F.collect_set(column)).alias(name))

    broken = spans.agg(F.count_if(~F.col("unbroken")).alias("broken_spans"))
    gaps = models(turns, F.when(F.col("threshold").isNull(), F.col("model")), "gaps")
    flagged = models(rollup.select(F.explode("never_cacheable_on").alias("model")), F.col("model"), "flagged")
    return broken.select("broken_spans", gaps.select("gaps").scalar().alias("gaps"), flagged.select("flagged").scalar().alias("flagged"))
