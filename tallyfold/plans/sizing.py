"""Sizes that plans are cut by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT_ROWS = 1_000_000
BROADCAST_ROWS = 100_000
#: Log rows whose ledger one task holds while it sorts.
LEDGER_ROWS = 25_000
#: Turns of a session that are dealt to a task together.
BLOCK_TURNS = 64

SEGMENT_KEY = "tallyfold.segmentRows"


def segment_rows(spark: SparkSession) -> int:
    """Rows of a session that one task scans; more are cut into segments."""
    return int(spark.conf.get(SEGMENT_KEY, str(SEGMENT_ROWS)))


def ledger_parts(rows: int) -> int:
    """Tasks for the ledger of a log of ``rows`` rows; what one of them holds does not grow with the log."""
    return max(1, -(-rows // LEDGER_ROWS))


def block_of(turn: Column) -> Column:
    """Block number of a turn."""
    return F.call_function("div", turn, F.lit(BLOCK_TURNS).cast("bigint"))


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast only when the row count, known to the caller, is small; else leave it to AQE."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def segment_of(line: Column, rows: int) -> Column:
    """Segment number of a 1-based dense position: never more than ``rows`` rows per segment."""
    return F.floor((line - F.lit(1)) / F.lit(rows)).cast("bigint")
