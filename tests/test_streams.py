"""Streams: segments come in order, no row vanishes, repeated batches change nothing, and the end equals the batch run."""

import datetime as dt

from pyspark.sql import functions as F

from tallyfold.operators import runs
from tallyfold.session import shared_dir
from tallyfold.sources import events as ev
from tallyfold.store.merged import MergedStore, stored_results
from tallyfold.streaming import live
from tests.helpers import event_rows, events

ROWS = event_rows(4, 4, 20)
PARTS = [ROWS[:30], ROWS[30:55], ROWS[55:]]


def test_segments_arrive_in_order_and_each_key_once(spark):
    rows = events(spark, ROWS + [(i, t + dt.timedelta(hours=3), u, k, v, p) for i, t, u, k, v, p in ROWS[::3]])
    # The segments' files are written as they come, many to a segment; a file's name or time says nothing.
    cut = ["2024-01-01 12:00:00", "2024-01-02 06:00:00"]
    parts = [rows.where(f"ts < '{cut[0]}'"), rows.where(f"ts >= '{cut[0]}' and ts < '{cut[1]}'"), rows.where(f"ts >= '{cut[1]}'")]
    for _ in range(2):
        base = live.new_base(spark)
        live.in_order([p.repartition(3) for p in parts], lambda s, base=base: live.run_available(live.deduplicated(s, "event_id", "ts", "6 hours"), spark, "append", base))
        got = spark.read.parquet(f"{base}/table")
        assert sorted(r.event_id for r in got.select("event_id").collect()) == [r[0] for r in ROWS]


def test_late_rows_go_to_a_table_of_their_own(spark):
    late = ROWS[3:6]
    parts = [[r for r in ROWS[:40] if r not in late], [*ROWS[40:], *late]]
    base = live.new_base(spark)
    live.in_order([events(spark, p) for p in parts], lambda s: live.take(s, base, lambda rows, b: live.split_late(rows, b, base, "ts", "6 HOURS"), "append"))
    ids = {k: sorted(r.event_id for r in spark.read.parquet(f"{base}/{k}").collect()) for k in ("on_time", "late")}
    assert ids["late"] == [r[0] for r in late] and sorted(ids["late"] + ids["on_time"]) == [r[0] for r in ROWS]
    live.split_late(events(spark, parts[1]), 1, base, "ts", "6 HOURS")
    assert spark.read.parquet(f"{base}/late").count() == 3


def commits(store):
    return {r.session_id: r.commit for r in store.read("analysis_result").select("session_id", "commit").collect()}


def figures(store):
    return sorted(map(tuple, stored_results(store).select("session_id", "total_micros", "attributed_micros", "covered_through_turn", "fingerprint").collect()))


def test_growing_log_rewrites_touched_sessions_only(spark):
    store, base = MergedStore(spark, f"{shared_dir(spark)}/grow-{dt.datetime.now().timestamp()}", buckets=2), live.new_base(spark)
    alone = [(500, ROWS[-1][1] + dt.timedelta(days=1), 2, "purchase", 1.0, '{"k": 12}')]
    seen = []
    for batch, part in enumerate([ROWS[:50], ROWS[50:], alone]):
        live.grow(store, events(spark, part), batch, base, "proportional", ev.RATES, "log")
        seen.append(commits(store))
    open_before = {str(max(ROWS, key=lambda r: r[1])[2])}
    assert {s for s in seen[1] if seen[2][s] != seen[1][s]} == {"2"} | open_before
    whole = MergedStore(spark, f"{store.root}-whole", buckets=2)
    runs.run(whole, events(spark, ROWS + alone), "proportional", ev.RATES, "2030-01-01 00:00:00")
    assert figures(store) == figures(whole)
    before, head = figures(store), store.head()
    live.grow(store, events(spark, alone), 2, base, "proportional", ev.RATES, "log")
    assert store.head() == head and figures(store) == before
    flags = {r.session_id: r.is_complete for r in store.read("session").collect()}
    assert flags == {str(s): s != 2 for s in range(4)}


def test_queue_stores_what_it_names_and_counts_the_rest(spark):
    store, base, log = MergedStore(spark, f"{shared_dir(spark)}/queue-{dt.datetime.now().timestamp()}", buckets=2), live.new_base(spark), events(spark, ROWS)
    lines = ['{"session_id": "1"}', "", "  ", '{"session_id": "1", "reason": "x"}', "not json", '["1"]', '{"session_id": "77"}', '{"session_id": "abc"}', '{"session_id": 3}', "{}"]
    batch = spark.createDataFrame([(x,) for x in lines], "value string")
    for _ in range(2):
        live.work_queue(store, batch, 0, base, log, "proportional", ev.RATES, "2030-01-01 00:00:00", "queue")
        assert set(commits(store)) == {"1", "3"} and store.head().version == 1
        counts = spark.read.parquet(f"{base}/counts").collect()
        assert [(r.entries, r.without_records, r.sessions, r.unreadable) for r in counts] == [(6, 3, 2, 2)]


def test_a_closing_window_flips_the_flag(spark):
    at = dt.datetime(2024, 1, 1)
    hours = [[(1, 0), (1, 1), (2, 1)], [(1, 2), (2, 30)], [(2, 60)]]
    base = live.new_base(spark)
    parts = [spark.createDataFrame([(u, at + dt.timedelta(hours=h)) for u, h in p], "session_id long, ts timestamp") for p in hours]
    live.in_order(parts, lambda s: live.run_available(live.liveness(s, "session_id", "ts", "4 hours", "1 hour"), spark, "update", base))
    said = spark.read.parquet(f"{base}/table")
    first = said.where((F.col("session_id") == 1)).orderBy("batch", "records", F.desc("provisional")).collect()
    assert [(r.records, r.provisional) for r in first] == [(2, True), (3, True), (3, False)]
    last = said.groupBy("session_id", "started").agg(F.max(F.struct("batch", "records", (~F.col("provisional")).alias("closed"))).alias("v")).collect()
    assert {(r.session_id, r.started.day, r.v.records, r.v.closed) for r in last} == {(1, 1, 3, True), (2, 1, 1, True), (2, 2, 1, True), (2, 3, 1, False)}
