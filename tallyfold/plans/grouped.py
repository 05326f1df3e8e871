"""Totals and ranks per group, and offsets over a whole table.

Groups given to the windows here are small by their key: a turn of a session, a pool of a turn,
an order. What runs over a whole session or table goes through ``plans.scan`` or ``offsets``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfold.session import stored


def with_totals(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Add one column per aggregate, holding its value over the row's group."""
    over = W.partitionBy(*keys)
    return df.withColumns({name: agg.over(over) for name, agg in aggs.items()})


def with_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Add the 1-based position of each row in its group; ``order`` must be total."""
    over = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(over).cast("bigint"))


def sliced(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``df`` in slices of about equal size along ``order``, written once with their number, ``_slice``.

    Spark samples the bounds, so neither a hot key nor a burst in time makes a slice large.
    """
    return stored(df.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id()), "slices")


def spread_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Positions in a group without giving the group to one task; ``order`` must be total.

    Each slice numbers its own rows; the numbers of the slices before it are added from one row
    per (group, slice).
    """
    placed = sliced(df, [*[F.col(k) for k in keys], *order])
    local = W.partitionBy(*keys, "_slice").orderBy(*order)
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*keys, "_slice")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(*keys, "_slice", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    )
    return (
        placed.withColumn("_local", F.row_number().over(local))
        .join(offsets, [*keys, "_slice"], "inner")
        .withColumn(name, (F.col("_local") + F.col("_before")).cast("bigint"))
        .drop("_slice", "_local", "_before")
    )


def running_offsets(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Sum of ``value`` over all rows with a smaller ``order``, which may be of any ordered type.

    Only one row per slice, as many as there are shuffle partitions, is summed in one place.
    """
    placed = sliced(df, [F.col(order)])
    inside = W.partitionBy("_slice").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    across = W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    slices = (
        placed.groupBy("_slice")
        .agg(F.sum(value).alias("_sum"))
        .select("_slice", F.coalesce(F.sum("_sum").over(across), F.lit(0)).alias("_base"))
    )
    return (
        placed.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(slices, "_slice", "inner")
        .withColumn(name, (F.col("_inside") + F.col("_base")).cast("bigint"))
        .drop("_slice", "_inside", "_base")
    )
