"""Ground-truth context reports: recognition, parsing, and comparison with computed sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfold.functions import fixed

# Shapes of headings, separators and figures in a context report.
SECTION = r"^#{2,4}\s*(.+?)\s*$"
SEPARATOR = r"^[\s:|-]+$"
PERCENT = r"\(\s*\d+(?:\.\d+)?\s*%\s*\)\s*$"
FIGURE = r"^([~≈]?)\s*(\d{1,3}(?:,\d{3})*(?:\.\d+)?|\d+(?:\.\d+)?)\s*([kKmM]?)\s*(?:tokens?)?$"
LABELLED = r"^([^|]{1,80}?)\s*[:—-]?\s+([~≈]?\s*[\d,.]+\s*[kKmM]?)\s*(?:tokens?)?$"


def looks_like_report(text: Column) -> Column:
    """Names the report's command, or at least two of its known labels."""
    low = F.lower(text)
    labels = sum((F.contains(low, F.lit(label)).cast("int") for label in fixed.CONTEXT_LABELS), F.lit(0))
    return F.contains(low, F.lit("/context")) | (labels >= 2)


def _bare(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, PERCENT, ""))


def figure(text: Column) -> Column:
    """STRUCT<tokens, step, approximate> of '2.9k', '~1,200 tokens' and the like; NULL otherwise."""
    bare = _bare(text)
    number = F.regexp_replace(F.regexp_extract(bare, FIGURE, 2), ",", "")
    mark = F.lower(F.regexp_extract(bare, FIGURE, 3))
    times = F.when(mark == "k", 1_000).when(mark == "m", 1_000_000).otherwise(1)
    decimals = F.length(F.regexp_extract(number, r"\.(\d+)$", 1))
    step = F.greatest(F.lit(1), F.floor(times / F.pow(F.lit(10.0), decimals))).cast("bigint")
    tokens = F.bround(number.cast("double") * times, 0).cast("bigint")
    return F.when(
        bare.rlike(FIGURE),
        F.struct(tokens.alias("tokens"), step.alias("step"), (F.regexp_extract(bare, FIGURE, 1) != "").alias("approximate")),
    )


def parse_reports(reports: DataFrame, key: str, text: str) -> DataFrame:
    """One row per labelled figure of each report, with the section it stands under.

    A report's lines stay on the row they came from: the section of a line is the last heading
    before it, taken with a fold over the line array, so no shuffle is needed.
    """
    lines = F.transform(F.split(F.col(text), r"\r\n|\r|\n"), lambda s: F.trim(s))
    folded = F.aggregate(
        lines,
        F.struct(
            F.lit(None).cast("string").alias("section"), F.lit(0).alias("n"),
            F.array().cast("array<struct<n:int,section:string,line:string>>").alias("rows"),
        ),
        lambda acc, line: F.struct(
            F.when(line.rlike(SECTION), F.regexp_extract(line, SECTION, 1)).otherwise(acc["section"]).alias("section"),
            (acc["n"] + 1).alias("n"),
            F.when((line == "") | line.startswith("#"), acc["rows"]).otherwise(
                F.array_append(acc["rows"], F.struct((acc["n"] + 1).alias("n"), acc["section"].alias("section"), line.alias("line")))
            ).alias("rows"),
        ),
        lambda acc: acc["rows"],
    )
    rows = reports.select(key, F.explode(folded).alias("r")).select(key, "r.*")
    line = F.col("line")
    cells = F.filter(F.transform(F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c)), lambda c: c != "")
    named = rows.withColumn("is_row", line.startswith("|")).withColumn("cells", cells)
    heads = F.slice(F.col("cells"), F.lit(1), F.greatest(F.size("cells") - 1, F.lit(0)))
    longest = F.aggregate(heads, F.lit(""), lambda a, c: F.when(F.length(c) > F.length(a), c).otherwise(a))
    stripped = F.rtrim(_bare(line), F.lit(":"))
    row_figure = F.when((F.size("cells") >= 2) & ~line.rlike(SEPARATOR), figure(F.try_element_at(F.col("cells"), F.lit(-1))))
    label = F.trim(F.trim(F.regexp_extract(stripped, LABELLED, 1)), F.lit(":"))
    label = F.trim(label)
    line_figure = F.when(label.rlike(r"\p{L}"), figure(F.regexp_extract(stripped, LABELLED, 2)))
    out = named.select(
        key, F.col("n").cast("bigint").alias("source_line"), "section",
        F.when(F.col("is_row"), longest).otherwise(label).alias("label"),
        F.when(F.col("is_row"), row_figure).otherwise(line_figure).alias("f"),
    )
    return out.filter("f IS NOT NULL").select(
        key, "source_line", "section", "label", "f.tokens", "f.step", "f.approximate"
    )


def empty_reports(reports: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """Recognised reports without any figure: the format changed, and that is an error to show."""
    return reports.join(entries.select(key), key, "left_anti")


def tolerance(tokens: Column, step: Column, approximate: Column) -> Column:
    relative = F.ceil(F.lit(fixed.ANCHOR_TOLERANCE) * tokens)
    half = F.floor(step / 2).cast("bigint")
    shown = F.when(approximate, F.greatest(half, F.ceil(F.lit(0.1) * tokens))).otherwise(half)
    return F.greatest(relative, shown, F.lit(0)).cast("bigint")


def match(anchors: DataFrame, computed: DataFrame, key: str) -> DataFrame:
    """Every anchor and every computed label once: exact label first, then without case.

    A computed label is used by the first anchor that reaches it; the others and all leftovers
    are reported as unmatched on their side.
    """
    a = anchors.withColumn("low", F.lower("label"))
    c = computed.select(key, F.col("label").alias("computed_label"), F.col("tokens").alias("computed_tokens"))
    exact = a.join(c, (a[key] == c[key]) & (a["label"] == c["computed_label"]), "left").select(
        a["*"], "computed_label", "computed_tokens"
    )
    hit = exact.filter("computed_label IS NOT NULL")
    miss = exact.filter("computed_label IS NULL").drop("computed_label", "computed_tokens")
    loose = c.withColumn("low", F.lower("computed_label")).groupBy(key, "low").agg(
        F.max_by("computed_label", "computed_label").alias("computed_label"),
        F.max_by("computed_tokens", "computed_label").alias("computed_tokens"),
    )
    folded = miss.join(loose, [key, "low"], "left").select(*miss.columns, "computed_label", "computed_tokens")
    tried = hit.select(*folded.columns).unionByName(folded)
    first = tried.filter("computed_label IS NOT NULL").groupBy(key, "computed_label").agg(F.min("position").alias("position"))
    used = first.withColumn("wins", F.lit(True))
    decided = tried.join(used, [key, "computed_label", "position"], "left")
    won = F.coalesce("wins", F.lit(False))
    sides = decided.select(
        key, "label", F.col("tokens").alias("anchor_tokens"), "step", "approximate",
        F.when(won, F.col("computed_tokens")).alias("computed_tokens"),
        F.when(won, "matched").otherwise("anchor_only").alias("status"),
    )
    leftovers = c.join(first, [key, "computed_label"], "left_anti").select(
        key, F.col("computed_label").alias("label"), "computed_tokens", F.lit("computed_only").alias("status")
    )
    delta = F.col("computed_tokens") - F.col("anchor_tokens")
    allowed = tolerance(F.col("anchor_tokens"), F.col("step"), F.col("approximate"))
    return sides.unionByName(leftovers, allowMissingColumns=True).select(
        key, "label", "status", "anchor_tokens", "computed_tokens", delta.alias("delta"),
        F.when(F.col("status") == "matched", allowed).alias("tolerance"),
        F.when(
            F.col("status") == "matched",
            F.when(F.col("anchor_tokens") == 0, F.when(delta == 0, F.lit(0.0)).otherwise(F.lit(float("inf"))))
            .otherwise(delta.cast("double") / F.col("anchor_tokens").cast("double")),
        ).alias("relative_delta"),
        F.when(F.col("status") == "matched", F.abs(delta) <= allowed).alias("agrees"),
    )


def agreement(matched: DataFrame, key: str) -> DataFrame:
    """A report agrees when nothing disagrees and no anchor is left unmatched."""
    return matched.groupBy(key).agg(
        F.count_if(F.col("status") == "matched").alias("matched"),
        F.count_if(F.col("status") == "anchor_only").alias("anchor_only"),
        F.count_if(F.col("status") == "computed_only").alias("computed_only"),
        F.count_if(~F.col("agrees")).alias("disagreements"),
    ).withColumn("agrees", (F.col("disagreements") == 0) & (F.col("anchor_only") == 0))
