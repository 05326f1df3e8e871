"""Exact integer micro-dollar arithmetic as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.plans import grouped


def _dec(col: Column, digits: int) -> Column:
    return col.cast(f"decimal({digits},0)")


def cost_micros(tokens: Column, rate: Column, multiplier: Column | None = None) -> Column:
    """Cost of ``tokens`` at ``rate`` micros per million tokens; a negative input is an error.

    ``multiplier`` is an integer number of millionths (1.25 is 1250000). The product is exact, 38
    digits with 12 behind the point, and is rounded once, halves to the even neighbour.
    """
    bad = (tokens < 0) | (rate < 0)
    millionth = F.lit("0.000001").cast("decimal(7,6)")
    exact = _dec(tokens, 15) * (_dec(rate, 11) * millionth).cast("decimal(12,6)")
    if multiplier is not None:
        exact = exact * (_dec(multiplier, 9) * millionth).cast("decimal(9,6)")
    refuse = F.raise_error(F.lit("token count and rate must not be negative")).cast("bigint")
    return F.when(bad, refuse).otherwise(F.bround(exact, 0).cast("bigint"))


def usd_to_micros(usd: Column) -> Column:
    return F.bround(usd.cast("decimal(30,10)") * F.lit(1_000_000).cast("decimal(8,0)"), 0).cast("bigint")


def allocate(
    df: DataFrame,
    keys: Sequence[str],
    pool: str,
    weight: str,
    position: Sequence[Column],
    out: str = "share",
) -> DataFrame:
    """Largest-remainder split of each group's ``pool`` over its rows' ``weight``.

    Floors first, then one unit each to the largest discarded fractions; ``position`` breaks
    ties and must be unique in the group. All-zero weights mean an even split and a negative
    pool is split by magnitude. The shares of a group always sum to its pool.
    """
    keys = list(keys)
    named = df.withColumn("_w", F.col(weight).cast("bigint"))
    summed = grouped.with_totals(
        named, keys, _sum_w=F.sum("_w"), _n=F.count(F.lit(1)), _min_w=F.min("_w")
    )
    even = F.col("_sum_w") == 0
    w = F.when(even, F.lit(1)).otherwise(F.col("_w"))
    total = F.when(even, F.col("_n")).otherwise(F.col("_sum_w"))
    product = _dec(F.abs(F.col(pool)), 19) * _dec(w, 19)
    refuse = F.raise_error(F.lit("weights must not be negative")).cast("bigint")
    parts = summed.withColumns(
        {
            "_floor": F.when(F.col("_min_w") < 0, refuse).otherwise(
                F.call_function("div", product, _dec(total, 19))
            ),
            "_rest": (product % _dec(total, 19)).cast("bigint"),
        }
    )
    parts = grouped.with_totals(parts, keys, _given=F.sum("_floor"))
    ranked = grouped.with_rank(parts, keys, [F.col("_rest").desc(), *position], "_rank")
    left = F.abs(F.col(pool)) - F.col("_given")
    share = F.col("_floor") + F.when(F.col("_rank") <= left, 1).otherwise(0)
    return ranked.withColumn(out, (F.signum(F.col(pool)).cast("bigint") * share).cast("bigint")).drop(
        "_w", "_sum_w", "_n", "_min_w", "_floor", "_rest", "_given", "_rank"
    )


def sig_figs(confidence: Column) -> Column:
    """Significant figures a figure may show: six when its confidence is high, else two."""
    return F.when(confidence == "high", 6).otherwise(2).cast("bigint")


def _exponent(micros: Column) -> Column:
    """floor(log10(dollars)) of a positive amount, from its digit count."""
    return F.length(micros.cast("string")) - F.lit(7)


def _let(value: Column, then) -> Column:
    """Evaluate ``value`` once and hand it on; display text is long, so it is built in steps."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _half_even_units(micros: Column, unit: Column) -> Column:
    """Nearest multiple of ``unit``, halves to the even one."""
    whole, rest = F.call_function("div", micros, unit), micros % unit
    up = (rest * 2 > unit) | ((rest * 2 == unit) & (whole % 2 == 1))
    return (whole + up.cast("bigint")) * unit


def _pow10(exponent: Column) -> Column:
    return F.pow(F.lit(10.0), exponent).cast("bigint")


def _dollars(micros: Column) -> Column:
    return micros.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(8,0)")


def format_micros(micros: Column, figures: Column) -> Column:
    """Dollars with no more digits than ``figures`` supports, never finer than a cent.

    First to the places behind the point that the figures leave (two at most), then, when they
    do not even reach the point, to the digits left of it.
    """
    size = F.abs(micros)
    spare = _let(size, lambda s: figures - 1 - _exponent(s))
    decimals = _let(spare, lambda s: F.greatest(F.lit(0), F.least(F.lit(2), s)))
    plan = F.struct(
        size.alias("size"), decimals.alias("decimals"), _pow10(F.lit(6) - decimals).alias("unit"),
        _let(spare, lambda s: _pow10(F.greatest(F.lit(6), F.lit(6) - s))).alias("step"),
    )
    near = _let(
        plan,
        lambda p: F.struct(
            _half_even_units(p["size"], p["unit"]).alias("first"), p["step"].alias("step"), p["decimals"].alias("decimals")
        ),
    )
    shown = _let(
        near,
        lambda n: F.struct(
            F.when(n["step"] > 1_000_000, _half_even_units(n["first"], n["step"])).otherwise(n["first"]).alias("value"),
            n["decimals"].alias("decimals"),
        ),
    )
    text = _let(
        shown,
        lambda n: F.when(n["decimals"] == 0, F.format_number(_dollars(n["value"]), 0))
        .when(n["decimals"] == 1, F.format_number(_dollars(n["value"]), 1))
        .otherwise(F.format_number(_dollars(n["value"]), 2)),
    )
    sign = F.when(micros < 0, "-").otherwise("")
    return (
        F.when(micros == 0, "$0.00")
        .when(size < 5000, F.concat(sign, F.lit("<$0.01")))
        .otherwise(F.concat(sign, F.lit("$"), text))
    )


def axis_label(micros: Column) -> Column:
    """Scale mark: whole amounts in full, sub-dollar amounts to their leading digit."""
    size = F.abs(micros)
    sign = F.when(micros < 0, "-").otherwise("")
    plain = _dollars(size).cast("decimal(25,6)").cast("string")
    full = F.regexp_replace(F.rtrim(plain, F.lit("0")), r"\.$", "")
    places = F.lit(7) - F.length(size.cast("string"))
    lead = _let(
        F.struct(size.alias("size"), _pow10(F.greatest(F.lit(0), F.lit(6) - places)).alias("unit")),
        lambda p: _dollars(_half_even_units(p["size"], p["unit"])).cast("decimal(25,6)").cast("string"),
    )
    return (
        F.when(micros == 0, "$0")
        .when(size >= 1_000_000, F.concat(sign, F.lit("$"), full))
        .otherwise(F.concat(sign, F.lit("$"), F.substr(lead, F.lit(1), places + F.lit(2))))
    )


def format_share(share: Column) -> Column:
    """Percent with one place, rounded from the exact binary value; '<0.1%' below a thousandth.

    Percentages from 0.1 to 100 are whole multiples of 2**-56, so the rounding is done on integers.
    """
    percent = share * 100
    unit = F.lit(2**56).cast("decimal(18,0)")
    tenths = _let(
        (percent * F.lit(float(2**56))).cast("bigint").cast("decimal(19,0)") * F.lit(10).cast("decimal(2,0)"),
        lambda m: F.call_function("div", m, unit)
        + F.when(
            ((m % unit) * 2 > unit) | (((m % unit) * 2 == unit) & (F.call_function("div", m, unit) % 2 == 1)), 1
        ).otherwise(0),
    )
    exact = F.concat(
        F.call_function("div", tenths, F.lit(10)).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("%")
    )
    return (
        F.when((share > 0) & (share < 0.001), "<0.1%")
        .when((share > 0) & (percent <= 100), exact)
        .otherwise(F.format_string("%.1f%%", percent))
    )


def share_of(part: Column, total: Column) -> Column:
    """Part of a whole as DOUBLE; 0.0 when the whole is zero."""
    return F.when(total == 0, F.lit(0.0)).otherwise(part.cast("double") / total.cast("double"))
