"""Running figures over arriving log events."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.operators import ledger, runs
from tallyfold.session import shared_dir, stored
from tallyfold.sources import events
from tallyfold.sources.rates import RateTable
from tallyfold.store.merged import MergedStore

CHARGES = ["fresh_micros", "write_micros", "read_micros", "output_micros", "total_micros"]


def arriving(log: DataFrame, order: str, files: int, per_batch: int = 1) -> DataFrame:
    """A stream of rows that come in ``files`` files in their order, ``per_batch`` of them at a time."""
    path = f"{shared_dir(log.sparkSession)}/arriving-{uuid.uuid4().hex}"
    log.repartitionByRange(files, order).write.parquet(path)
    return log.sparkSession.readStream.schema(log.schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def in_order(arrivals: Sequence[DataFrame], job: Callable[[DataFrame], None]) -> None:
    """Rows that come in a known order: each arrival is appended to a folder when ``job`` has taken the one before.

    ``job`` gets the folder as a stream, takes what has come since its last run, as its checkpoint says, and ends; so every
    arrival is also a restart. Files of one arrival may come in any order, files of two never do.
    """
    spark = arrivals[0].sparkSession
    path = f"{shared_dir(spark)}/arriving-{uuid.uuid4().hex}"
    for rows in arrivals:
        rows.write.mode("append").parquet(path)
        job(spark.readStream.schema(rows.schema).parquet(path))


def running_cost(turns: DataFrame) -> DataFrame:
    """The observed charges and turns of each session; only these sums are state. An unknown model is an error."""
    priced = ledger.priced(turns, events.RATES)
    return priced.groupBy("session_id").agg(*[F.sum(c).alias(c) for c in CHARGES], F.count(F.lit(1)).alias("turns"))


def deduplicated(stream: DataFrame, key: str, ts: str, late: str) -> DataFrame:
    """The first row of each key; a key is forgotten once ``late`` has passed, so state stays bounded."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def new_base(spark: SparkSession) -> str:
    """A new folder for a job's state and what it writes."""
    return f"{shared_dir(spark)}/running-{uuid.uuid4().hex}"


def take(result: DataFrame, base: str, write: Callable[[DataFrame, int], None], mode: str = "update") -> None:
    """Hands all that has arrived to ``write``, batch by batch; a batch that was not finished is handed over again."""
    job = result.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(write)
    job.trigger(availableNow=True).start().awaitTermination()


def run_available(result: DataFrame, spark: SparkSession, mode: str = "update", base: str | None = None) -> DataFrame:
    """Process all that has arrived, batch by batch; the rows of each batch with its number, ``batch``.

    A batch writes its own folder anew, so a repeated batch changes nothing.
    """
    base = base or new_base(spark)
    take(result, base, lambda rows, batch: rows.write.mode("overwrite").parquet(f"{base}/table/batch={batch}"), mode)
    return spark.read.parquet(f"{base}/table")


def latest(table: DataFrame, key: str) -> DataFrame:
    """The row of each key from the last batch that changed it."""
    values = [c for c in table.columns if c not in (key, "batch")]
    return table.groupBy(key).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(key, "v.*")


def split_late(rows: DataFrame, batch: int, base: str, ts: str, delay: str) -> None:
    """Writes a batch's rows as ``on_time`` or, where they are behind the watermark, as ``late``; none vanishes.

    The watermark is the latest time of the batches before less ``delay``, kept in one row for each batch.
    """
    spark = rows.sparkSession
    rows.agg(F.max(ts).alias("latest")).withColumn("of", F.lit(batch)).write.mode("overwrite").parquet(f"{base}/marks/batch={batch}")
    before = spark.read.parquet(f"{base}/marks").where(F.col("of") < batch).agg(F.max("latest")).first()[0]
    behind = F.lit(False) if before is None else F.coalesce(F.col(ts) < F.lit(before) - F.expr(f"INTERVAL {delay}"), F.lit(False))
    rows.where(behind).write.mode("overwrite").parquet(f"{base}/late/batch={batch}")
    rows.where(~behind).write.mode("overwrite").parquet(f"{base}/on_time/batch={batch}")


def liveness(stream: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """key, started, last, records, provisional: the windows of activity of each key, as they grow and when they close.

    A window is provisional while a record within ``gap`` of its last one may still come. It is closed when a later record
    opens the next one, or when the watermark passes that time and a timer fires; its last row says so. State is one window a key.
    """
    wide = int(pd.Timedelta(gap).total_seconds() * 1000)

    def step(name: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = []
        started, last, n = state.get if state.exists else (None, None, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(name[0], pd.Timestamp(started, unit="us"), pd.Timestamp(last, unit="us"), n, False)], columns=columns)
            return
        times = sorted(int(t.value // 1000) for batch in batches for t in batch[ts])
        for t in times:
            if n and t > last + wide * 1000:
                rows.append((name[0], pd.Timestamp(started, unit="us"), pd.Timestamp(last, unit="us"), n, False))
                started, n = None, 0
            started, last, n = started if n else t, t if not n else max(last, t), n + 1
        rows.append((name[0], pd.Timestamp(started, unit="us"), pd.Timestamp(last, unit="us"), n, True))
        state.update((started, last, n))
        state.setTimeoutTimestamp(max(last // 1000 + wide, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=columns)

    columns = [key, "started", "last", "records", "provisional"]
    out = f"{key} long, started timestamp, last timestamp, records long, provisional boolean"
    named = stream.select(key, ts).withWatermark(ts, late)
    return named.groupBy(key).applyInPandasWithState(step, out, "started long, last long, records long", "update", "EventTimeTimeout")


def grow(store: MergedStore, rows: DataFrame, batch: int, base: str, policy: str, rates: RateTable, name: str) -> None:
    """Takes a segment of a growing log into the store: its sessions, and those that were open before, are computed anew from all their records.

    The segment is kept in a folder of its own, so a repeated batch finds the same records and changes nothing.
    """
    spark = store.spark
    rows.write.mode("overwrite").parquet(f"{base}/log/batch={batch}")
    log = spark.read.parquet(f"{base}/log").where(F.col("batch") <= batch)
    now = log.agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()[0]
    if now is None:
        return
    touched = log.where(F.col("batch") == batch).select(F.col("user_id").alias("session_id"))
    open_before = store.read("session", policy).where("not is_complete").select(F.col("session_id").cast("bigint").alias("session_id"))
    runs.run(store, log.drop("batch"), policy, rates, now, only=touched.union(open_before), stream=name, batch=batch, keep_open=True)


def queue_entries(lines: DataFrame) -> DataFrame:
    """session_id, transcript_path, readable of queue lines, blank ones left out; what is no JSON object is not readable."""
    v = F.try_parse_json(F.trim("value"))
    rows = lines.where(F.trim("value") != "").select(v.alias("v"))
    readable = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    text = [F.coalesce(F.try_variant_get("v", f"$.{c}", "string"), F.lit("")).alias(c) for c in ("session_id", "transcript_path")]
    return rows.select(*[F.when(readable, c).alias(n) for c, n in zip(text, ("session_id", "transcript_path"), strict=True)], readable.alias("readable"))


def work_queue(store: MergedStore, lines: DataFrame, batch: int, base: str, log: DataFrame, policy: str, rates: RateTable, now: str, name: str) -> None:
    """Computes and stores the sessions of a batch of queue lines; counts what could not be read or has no records."""
    entries = stored(queue_entries(lines), "queue-entries")
    asked = entries.where("readable").select(F.col("session_id").try_cast("bigint").alias("session_id"), F.col("session_id").alias("name"))
    known = log.select(F.col("user_id").alias("session_id")).distinct().withColumn("known", F.lit(True))
    found = asked.join(known, "session_id", "left")
    counts = found.agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("known").isNull()).alias("without_records"), F.count_distinct(F.when(F.col("known"), F.col("session_id"))).alias("sessions"))
    counts = counts.crossJoin(entries.agg(F.count_if(~F.col("readable")).alias("unreadable")))  # one row each
    counts.write.mode("overwrite").parquet(f"{base}/counts/batch={batch}")
    runs.run(store, log, policy, rates, now, only=found.where("known").select("session_id"), stream=name, batch=batch, keep_open=True)
