"""The events binding: the stages of one run, shared by the queries that need them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.operators import ledger, rollups
from tallyfold.sources import events
from tallyfold.store import files

_plans: dict[tuple, ledger.Model] = {}


def model(
    spark: SparkSession, sf: str, policy: str = "proportional", before: str | None = None
) -> ledger.Model:
    """The run's tables. The scanned log, the ledger, the facts and the sums per item are written once, when first used."""
    key = (spark.sparkContext.applicationId, files.stamp(spark, f"{sf}/events.parquet"), sf, policy, before)
    if key not in _plans:
        log = events.session_log(spark, sf, before)
        _plans[key] = ledger.build(log, events.RATES, policy, keep=True)
    return _plans[key]


def rollup(m: ledger.Model) -> DataFrame:
    return rollups.item_rollup(m.session_items, m.items, m.spans)


def long(*names: str) -> list[Column]:
    return [F.col(n).cast("bigint").alias(n) for n in names]
