"""Streaming queries over the events table, which arrives in several batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.catalog.ev_sql import ev_sql
from tallyfold.catalog.registry import query
from tallyfold.catalog.results import AFTER, POLICY, fresh_store
from tallyfold.operators import residency as res
from tallyfold.sources import events
from tallyfold.store import files
from tallyfold.store.merged import MergedStore, stored_results
from tallyfold.streaming import live

BATCHES = 4


@query("t2_running_cost", ev_sql("""
SELECT session_id, CAST(sum(fresh_micros) AS BIGINT) AS fresh_micros, CAST(sum(write_micros) AS BIGINT) AS write_micros, CAST(sum(read_micros) AS BIGINT) AS read_micros,
 CAST(sum(output_micros) AS BIGINT) AS output_micros, CAST(sum(total_micros) AS BIGINT) AS total_micros, count(*) AS turns FROM turns GROUP BY 1"""))
def t2(spark, sf):
    """Charges of each session kept up to date over four batches; equal to the batch run at the end."""
    log = events.session_log(spark, sf).filter("is_turn").drop(*res.NOT_OF_TURN)
    table = live.run_available(live.running_cost(live.arriving(log, "ts", BATCHES)), spark)
    return live.latest(table, "session_id")


SEGMENTS = ("2024-01-09", "2024-01-17", "2024-01-25")
DAY = "CASE " + " ".join(f"WHEN ts < TIMESTAMP '{d}' THEN {k}" for k, d in enumerate(SEGMENTS)) + f" ELSE {len(SEGMENTS)} END"


def segments(rows: DataFrame, number: str = DAY) -> list[DataFrame]:
    """The rows by the segment that they come with, in order."""
    return [rows.where(F.expr(number) == k) for k in range(len(SEGMENTS) + 1)]


@query("t4_streaming_dedup", """
SELECT event_type, count(*) AS events, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1""")
def t4(spark, sf):
    """Events of which some arrive again within the day, once each; segments come in the order of their days."""
    raw = events.raw_events(spark, sf).select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    again = raw.filter("event_id % 17 = 0").withColumn("ts", F.expr("ts + INTERVAL 5 HOURS"))
    base = live.new_base(spark)
    live.in_order(segments(raw.unionByName(again)), lambda s: live.run_available(live.deduplicated(s, "event_id", "ts", "1 day"), spark, "append", base))
    return spark.read.parquet(f"{base}/table").groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("event_id").alias("ids"))


#: Some records come with the segment after their own.
ARRIVES = f"LEAST({len(SEGMENTS)}, {DAY} + CASE WHEN event_id % 23 = 0 THEN 1 ELSE 0 END)"
DELAY = "2 DAYS"
_grown: dict[tuple, tuple[MergedStore, str]] = {}


def grown(spark, sf) -> tuple[MergedStore, str]:
    """A store fed by a growing log of four segments, and the folder of what came on time and late; made once for each state of the input."""
    key = (spark.sparkContext.applicationId, files.stamp(spark, f"{sf}/events.parquet"), sf)
    if key not in _grown:
        store, base = fresh_store(spark), live.new_base(spark)

        def segment(rows: DataFrame, batch: int) -> None:
            live.split_late(rows, batch, base, "ts", DELAY)
            live.grow(store, rows, batch, base, POLICY, events.RATES, "log")

        live.in_order(segments(events.raw_events(spark, sf), ARRIVES), lambda s: live.take(s, base, segment, "append"))
        _grown[key] = (store, base)
    return _grown[key]


ARRIVED = f"""
, arr AS (SELECT user_id AS session_id, ts, {ARRIVES} AS batch FROM events),
latest AS (SELECT b.batch, max(a.ts) AS latest FROM (SELECT DISTINCT batch FROM arr) b JOIN arr a ON a.batch <= b.batch GROUP BY 1),
sess AS (SELECT session_id, max(batch) AS last_batch, max(ts) AS last FROM arr GROUP BY 1)
"""


@query("t1_growing_logs", ev_sql(ARRIVED + f"""
SELECT r.session_id, CAST(total_micros AS BIGINT) AS total_micros, CAST(attributed_micros AS BIGINT) AS attributed_micros, n_turns AS covered_through_turn,
 CAST(last_batch + CASE WHEN last_batch < {len(SEGMENTS)} AND last > latest - INTERVAL 5 MINUTE THEN 1 ELSE 0 END AS BIGINT) AS written_by
 FROM rec r JOIN nt USING (session_id) JOIN sess USING (session_id) JOIN latest ON batch = last_batch"""))
def t1(spark, sf):
    """Results over a growing log, with the segment that last wrote each session: the last that has records of it, or found it closed."""
    store, _ = grown(spark, sf)
    out = stored_results(store, POLICY)
    return out.select(
        F.col("session_id").cast("bigint").alias("session_id"), "total_micros", "attributed_micros", "covered_through_turn",
        (F.substring("commit", 1, 10).cast("bigint") - 1).alias("written_by"),
    )


@query("t6_late_arrival", ev_sql(ARRIVED + f"""
, marks AS (SELECT batch, max(ts) AS own FROM arr GROUP BY 1),
wm AS (SELECT b.batch, max(m.own) - INTERVAL {DELAY} AS mark FROM marks b LEFT JOIN marks m ON m.batch < b.batch GROUP BY 1),
n AS (SELECT session_id, count(*) FILTER (coalesce(ts >= mark, TRUE)) AS on_time, count(*) FILTER (ts < mark) AS late FROM arr JOIN wm USING (batch) GROUP BY 1)
SELECT n.session_id, on_time, late, CAST(total_micros AS BIGINT) AS total_micros FROM n LEFT JOIN rec USING (session_id)"""))
def t6(spark, sf):
    """Records on time and behind the watermark; sessions with late ones were computed again, so their totals are those of all records."""
    store, base = grown(spark, sf)
    kinds = [spark.read.parquet(f"{base}/{k}").select(F.col("user_id").alias("session_id"), F.lit(k).alias("kind")) for k in ("on_time", "late")]
    counts = kinds[0].union(kinds[1]).groupBy("session_id").agg(F.count_if(F.col("kind") == "on_time").alias("on_time"), F.count_if(F.col("kind") == "late").alias("late"))
    totals = stored_results(store, POLICY).select(F.col("session_id").cast("bigint").alias("session_id"), "total_micros")
    return counts.join(totals, "session_id", "left")


GAP, PATIENCE = "12 hours", "1 day"


@query("t3_liveness", f"""
WITH e AS (SELECT user_id AS session_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL {GAP} THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
i AS (SELECT *, sum(opens) OVER (PARTITION BY session_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island, sum(opens) OVER (PARTITION BY session_id) AS last_island FROM e)
SELECT session_id, strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%f') AS started, strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%f') AS last, count(*) AS records,
 island = any_value(last_island) AND max(ts) + INTERVAL {GAP} >= (SELECT max(ts) - INTERVAL {PATIENCE} FROM events) AS provisional FROM i GROUP BY session_id, island""")
def t3(spark, sf):
    """Each session's windows of activity; the last word on a window says whether it is closed."""
    raw = events.raw_events(spark, sf).select(F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"))
    base = live.new_base(spark)
    live.in_order(segments(raw), lambda s: live.run_available(live.liveness(s, "session_id", "ts", GAP, PATIENCE), spark, "update", base))
    said = spark.read.parquet(f"{base}/table")
    # A window's last row is from the last batch, and within it the one with the most records, closed before open.
    last = said.groupBy("session_id", "started").agg(F.max(F.struct("batch", "records", (~F.col("provisional")).alias("closed"), "last")).alias("v"))
    text = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    return last.select(
        "session_id", F.date_format("started", text).alias("started"), F.date_format("v.last", text).alias("last"), "v.records", (~F.col("v.closed")).alias("provisional")
    )


QUEUED = 3


def queue_lines(spark, sf) -> list[DataFrame]:
    """Queue lines made of the customers, in three arrivals: some are blank, cut off or no object."""
    key = F.col("c_custkey")
    line = F.to_json(F.struct((key % 997).cast("string").alias("session_id"), F.lit("").alias("transcript_path"), F.lit("session_end").alias("reason")))
    text = F.when(key % 49 == 0, " ").when(key % 50 == 0, F.expr("substr(line, 1, 12)")).when(key % 53 == 0, F.concat(F.lit("["), F.col("line"), F.lit("]"))).otherwise(F.col("line"))
    rows = spark.read.parquet(f"{sf}/customer.parquet").withColumn("line", line).select((key % QUEUED).alias("k"), text.alias("value"))
    return [rows.where(F.col("k") == k).select("value") for k in range(QUEUED)]


_queued: dict[tuple, tuple[MergedStore, str]] = {}


def queued(spark, sf) -> tuple[MergedStore, str]:
    key = (spark.sparkContext.applicationId, files.stamp(spark, f"{sf}/events.parquet"), files.stamp(spark, f"{sf}/customer.parquet"), sf)
    if key not in _queued:
        store, base, log = fresh_store(spark), live.new_base(spark), events.raw_events(spark, sf)

        def work(lines: DataFrame, batch: int) -> None:
            live.work_queue(store, lines, batch, base, log, POLICY, events.RATES, AFTER, "queue")

        live.in_order(queue_lines(spark, sf), lambda s: live.take(s, base, work, "append"))
        _queued[key] = (store, base)
    return _queued[key]


LINES = f"""
lines AS (SELECT c_custkey % {QUEUED} AS batch, c_custkey % 997 AS session_id, CASE WHEN c_custkey % 49 = 0 THEN 'blank' WHEN c_custkey % 50 = 0 OR c_custkey % 53 = 0 THEN 'bad' ELSE 'good' END AS kind FROM customer)
"""


@query("t5_queue_driven", ev_sql("," + LINES + """
SELECT session_id, CAST(total_micros AS BIGINT) AS total_micros, CAST(attributed_micros AS BIGINT) AS attributed_micros, CAST(unattributed_micros AS BIGINT) AS unattributed_micros
FROM rec WHERE session_id IN (SELECT session_id FROM lines WHERE kind = 'good')"""))
def t5(spark, sf):
    """Results of the sessions that the queue named, as stored by three batches of its lines."""
    store, _ = queued(spark, sf)
    out = stored_results(store, POLICY)
    return out.select(F.col("session_id").cast("bigint").alias("session_id"), "total_micros", "attributed_micros", "unattributed_micros")


@query("t5_queue_counts", "WITH " + LINES + """
SELECT batch, count(*) FILTER (kind = 'good') AS entries, count(*) FILTER (kind = 'good' AND session_id NOT IN (SELECT user_id FROM events)) AS without_records,
 count(DISTINCT session_id) FILTER (kind = 'good' AND session_id IN (SELECT user_id FROM events)) AS sessions, count(*) FILTER (kind = 'bad') AS unreadable FROM lines GROUP BY 1""")
def t5_counts(spark, sf):
    """What each batch of the queue held; blank lines count as nothing."""
    _, base = queued(spark, sf)
    return spark.read.parquet(f"{base}/counts").withColumn("batch", F.col("batch").cast("bigint"))
