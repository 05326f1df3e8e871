"""Small helpers of the training-data operators: column picking and written intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Hashable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.session import shared_dir


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder of the cluster."""
    return f"{shared_dir(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends there."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, by their exact spelling.

    Other columns, also ones whose names differ only in case or occur twice, are left out. Of
    two columns of exactly one name the first is taken. A missing column is an error.
    """
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return plain.select(*(F.col(f"c{df.columns.index(n)}").alias(n) for n in names))


def framed(df: DataFrame, **names: str) -> tuple[DataFrame, list[str]]:
    """``df`` with all columns renamed by place, so that none clash, and these names in order.

    ``names`` gives new names to columns by their exact spelling, the first of each.
    """
    own = [f"c{i}" for i in range(len(df.columns))]
    for old, new in names.items():
        own[df.columns.index(old)] = new
    return df.toDF(*own), own


#: Rows and bytes of a batch that goes to a Python worker at once.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Batches of texts, of which some are very long, are kept small, so that a worker's memory is; Spark's own bound is rows alone."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Vocabulary files above this size are not broadcast.
MAX_VOCABULARY_BYTES = 64 << 20


def read_vocabulary(path: str) -> bytes:
    """A vocabulary file's bytes, read on the driver; too large a file is an error."""
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return data


#: What an operator keeps in this Python worker. Spark gives a worker to the tasks of all operators, one after the other.
_KEPT: dict[Hashable, object] = {}


def kept(key: Hashable, make: Callable[[], object]) -> object:
    """What ``make`` gives, kept for later tasks of this Python worker; what was kept under other keys goes."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def cleared() -> None:
    """Drops what an operator before has kept in this Python worker; tasks that build tables of their own begin with it."""
    _KEPT.clear()


class Memo:
    """A bounded memo of two generations: what was asked for lately stays."""

    def __init__(self, most: int, longest: int = 64) -> None:
        self.new, self.old, self.half, self.longest = {}, {}, most // 2, longest

    def get(self, key):
        got = self.new.get(key)
        if got is None and self.old:
            got = self.old.get(key)
            if got is not None:
                self.put(key, got)
        return got

    def put(self, key, value) -> None:
        if len(key) <= self.longest:
            if len(self.new) >= self.half:
                self.old, self.new = self.new, {}
            self.new[key] = value
