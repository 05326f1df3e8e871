"""Ordered scans over a session: line numbers, running counts and last-seen values.

The line number is dense within a session (1, 2, 3, ...), so cutting it into segments of equal
length gives balanced pieces whatever the skew. Every scan is a window per segment and a carry
from the segments before, of which there is one row each.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfold.plans import grouped, sizing
from tallyfold.session import stored


def number_lines(df: DataFrame, key: str, ts: str, tie: str, name: str = "line") -> DataFrame:
    """1-based position of each row in its session by (ts, tie), of any ordered types; rows are written once."""
    return grouped.spread_rank(df, [key], [F.col(ts), F.col(tie)], name)


def numbered_scan(
    df: DataFrame,
    key: str,
    ts: str,
    tie: str,
    counts: Mapping[str, Column],
    totals: Mapping[str, Column],
    lasts: Mapping[str, Column],
    name: str = "line",
) -> DataFrame:
    """``number_lines`` and ``scan_session`` at once: a session that one task may scan is numbered and scanned by one ordered pass.

    Sessions of more than ``segmentRows`` rows are found by a count first; they alone are sliced and cut into segments.
    """
    rows = sizing.segment_rows(df.sparkSession)
    whole = df.filter(F.col(key).isNotNull())
    sizes = whole.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    hot = stored(sizes.filter(F.col("_rows") > rows).select(key), "hot")
    n_hot = hot.count()
    if n_hot:
        hot = sizing.bounded_broadcast(hot, n_hot)
        lined = number_lines(whole.join(hot, key, "left_semi"), key, ts, tie, name)
        cut = scan_session(lined, [key], name, counts, totals, lasts, rows)
        whole = whole.join(hot, key, "left_anti")
    to_here = W.partitionBy(key).orderBy(ts, tie)
    before = to_here.rowsBetween(W.unboundedPreceding, -1)
    over_all = to_here.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    zero = F.lit(0).cast("bigint")
    passed = whole.withColumns(
        {
            name: F.row_number().over(to_here).cast("bigint"),
            **{n: F.coalesce(F.sum(c).over(before), zero) for n, c in counts.items()},
            **{n: F.coalesce(F.sum(c).over(over_all), zero) for n, c in totals.items()},
            **{n: F.last(c, ignorenulls=True).over(before) for n, c in lasts.items()},
        }
    )
    return passed.unionByName(cut) if n_hot else passed


def scan_session(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    counts: Mapping[str, Column] | None = None,
    totals: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Running values strictly before each row, and totals over the group; ``order`` is a dense line number or close to it.

    ``counts``: name -> integer column summed over the earlier rows.
    ``totals``: name -> integer column summed over the whole group.
    ``lasts``: name -> column whose last non-null earlier value is taken.
    """
    counts, totals, lasts = dict(counts or {}), dict(totals or {}), dict(lasts or {})
    keys = list(keys)
    zero = F.lit(0).cast("bigint")
    rows = rows or sizing.segment_rows(df.sparkSession)
    cut = df.withColumn("_seg", sizing.segment_of(F.col(order), rows))
    parts = [*keys, "_seg"]
    local = W.partitionBy(*parts).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy(*keys).orderBy("_seg").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    at = F.col(order)
    summary = cut.groupBy(*parts).agg(
        *[F.sum(c).alias(f"_c_{n}") for n, c in counts.items()],
        *[F.sum(c).alias(f"_t_{n}") for n, c in totals.items()],
        *[F.max_by(c, F.when(c.isNotNull(), at)).alias(f"_l_{n}") for n, c in lasts.items()],
    )
    carry = summary.select(
        *parts,
        *[F.coalesce(F.sum(f"_c_{n}").over(before), zero).alias(f"_c_{n}") for n in counts],
        *[F.coalesce(F.sum(f"_t_{n}").over(whole), zero).alias(f"_t_{n}") for n in totals],
        *[F.last(f"_l_{n}", ignorenulls=True).over(before).alias(f"_l_{n}") for n in lasts],
    )
    inside = cut.withColumns(
        {
            **{f"_ci_{n}": F.coalesce(F.sum(c).over(local), zero) for n, c in counts.items()},
            **{f"_li_{n}": F.last(c, ignorenulls=True).over(local) for n, c in lasts.items()},
        }
    )
    joined = inside.join(carry, parts, "inner").withColumns(
        {
            **{n: F.col(f"_ci_{n}") + F.col(f"_c_{n}") for n in counts},
            **{n: F.col(f"_t_{n}") for n in totals},
            **{n: F.coalesce(F.col(f"_li_{n}"), F.col(f"_l_{n}")) for n in lasts},
        }
    )
    helpers = ["_seg"]
    helpers += [f"_{p}_{n}" for n in counts for p in ("c", "ci")]
    helpers += [f"_{p}_{n}" for n in lasts for p in ("l", "li")]
    helpers += [f"_t_{n}" for n in totals]
    return joined.drop(*helpers)
