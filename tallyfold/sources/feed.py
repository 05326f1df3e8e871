"""An external feed of per-token rates: its rows, the merge onto a rate table, and drift of cache multipliers.

The merge can only add or update rates: models that the feed doesn't carry stay, and thresholds,
which no feed publishes, are kept. Multipliers that the feed implies are reported, never applied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Micro-dollars per million tokens in a dollar per token.
SCALE = 10**12


def per_million(per_token: Column) -> Column:
    """USD per token (DECIMAL) as whole micros per million tokens; a finer rate is an error."""
    exact = per_token.cast("decimal(24,15)") * F.lit(SCALE).cast("decimal(13,0)")
    whole = exact.cast("bigint")
    refuse = F.raise_error(F.concat(F.lit("rate is finer than a micro per million tokens: "), per_token.cast("string"))).cast("bigint")
    return F.when(exact != whole, refuse).otherwise(whole)


def model_id(raw: Column) -> Column:
    """The id without what stands before its last slash and then before its last point."""
    return F.regexp_replace(F.regexp_replace(raw, "^.+/", ""), r"^.+\.", "")


def fetched(feed: DataFrame, provider: str) -> DataFrame:
    """model, input_rate, output_rate, write_rate, read_rate of one provider's rows.

    Rows without an input or output rate are left out; of rows that give one model the greatest raw id counts.
    """
    rows = feed.filter((F.col("provider") == provider) & F.col("input_per_token").isNotNull() & F.col("output_per_token").isNotNull())
    rates = rows.select(
        model_id(F.col("raw_id")).alias("model"), "raw_id",
        *[per_million(F.col(f"{n}_per_token")).alias(f"{n}_rate") for n in ("input", "output", "write", "read")],
    )
    best = rates.groupBy("model").agg(F.max(F.struct("raw_id", "input_rate", "output_rate", "write_rate", "read_rate")).alias("r"))
    return best.select("model", "r.input_rate", "r.output_rate", "r.write_rate", "r.read_rate")


def merged(rates: DataFrame, current: DataFrame) -> DataFrame:
    """The table after the refresh, with what became of each model and whether it lacks a threshold by being new."""
    new = rates.select("model", F.col("input_rate").alias("i"), F.col("output_rate").alias("o"))
    both = current.join(new, "model", "full_outer")
    same = (F.col("i") == F.col("input_rate")) & (F.col("o") == F.col("output_rate"))
    status = (
        F.when(F.col("i").isNull(), "missing").when(F.col("input_rate").isNull(), "added").when(same, "unchanged").otherwise("updated")
    )
    return both.select(
        "model", F.coalesce("i", "input_rate").alias("input_rate"), F.coalesce("o", "output_rate").alias("output_rate"),
        "threshold", status.alias("status"), (status == "added").alias("needs_threshold"),
    )


def drift(rates: DataFrame, current: DataFrame, read: int, write: int) -> DataFrame:
    """model, kind, implied, configured where the feed's cache rates imply another multiplier, in thousandths.

    ``read`` and ``write`` are the configured multipliers in millionths.
    """
    known = rates.join(current.select("model"), "model", "left_semi").filter("input_rate <> 0")
    kinds = [("read", "read_rate", read), ("write_5m", "write_rate", write)]
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("rate"), F.lit(m).alias("m")) for k, c, m in kinds])
    each = known.select("model", "input_rate", F.explode(rows).alias("r")).select("model", "input_rate", "r.*").filter("rate IS NOT NULL")
    implied = F.bround(F.col("rate").cast("decimal(19,0)") * 1000 / F.col("input_rate").cast("decimal(19,0)"), 0).cast("bigint")
    configured = F.bround(F.col("m").cast("decimal(10,0)") / 1000, 0).cast("bigint")
    return each.select("model", "kind", implied.alias("implied"), configured.alias("configured")).filter("implied <> configured")
