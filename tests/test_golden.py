"""The published five-turn example, rebuilt as log rows."""

import time
import uuid

import pytest
from pyspark.sql import functions as F

from tallyfold.operators import ledger
from tallyfold.plans import grouped, scan, sizing
from tallyfold.session import shared_dir
from tallyfold.sources import events
from tallyfold.sources.rates import RateTable

RATES = RateTable(models=(("m", 5_000_000, 25_000_000, None),))
SCHEMA = (
    "session_id string, line bigint, uuid string, is_turn boolean, is_injection boolean, is_change boolean, "
    "is_compaction boolean, model string, input_tokens bigint, write_5m bigint, write_1h bigint, write_unknown bigint, "
    "read_tokens bigint, output_tokens bigint, is_sidechain boolean, item_id string, kind string, identity string, "
    "category string, size_tokens bigint, basis string, confidence string, cause string, trigger string, tier string, "
    "detail string, pre_tokens bigint, post_tokens bigint, cumulative_tokens bigint, pinned boolean"
)


def row(line, **kw):
    base = dict.fromkeys([c.split()[0] for c in SCHEMA.split(", ")])
    flags = {f: False for f in ("is_turn", "is_injection", "is_change", "is_compaction", "pinned")}
    return {**base, **flags, "session_id": "s", "line": line, "uuid": f"u{line}", **kw}


def turn(line, inp, write, read, out):
    return row(line, is_turn=True, model="m", input_tokens=inp, write_5m=write, write_1h=0, write_unknown=0,
               read_tokens=read, output_tokens=out, is_sidechain=False)


def item(line, path, size):
    return row(line, is_injection=True, item_id=f"file:{path}", kind="file", identity=path, category="source",
               size_tokens=size, basis="estimated", confidence="low", cause="tool_result")


ROWS = [
    turn(1, 1000, 0, 0, 200), item(2, "/repo/src/a.py", 1000), turn(3, 0, 1000, 0, 100), item(4, "/repo/docs/b.md", 2000),
    turn(5, 0, 2000, 1000, 100), turn(6, 0, 0, 1000, 100),
    row(7, is_compaction=True, pre_tokens=10, post_tokens=1, cumulative_tokens=9), turn(8, 0, 0, 2000, 40),
]


@pytest.mark.parametrize("policy,attributed", [("proportional", 38250), ("exclusive", 37750)])
@pytest.mark.parametrize("segment", [2, 1_000_000])
def test_split(spark, policy, attributed, segment):
    log = spark.createDataFrame(ROWS, SCHEMA)
    spark.conf.set(sizing.SEGMENT_KEY, segment)
    try:
        m = ledger.build(log, RATES, policy)
    finally:
        spark.conf.unset(sizing.SEGMENT_KEY)
    rec = ledger.reconcile(m.turns, m.attributions).collect()[0]
    assert (rec.total_micros, rec.attributed_micros) == (39250, attributed)
    got = {
        (r.target_id, r.component): r.c
        for r in m.attributions.groupBy("target_id", "component").agg(F.sum("cost_micros").alias("c")).collect()
    }
    assert got[None, "overhead"] == 5000 and got[None, "output"] == 13500
    assert got["file:/repo/src/a.py", "direct"] == 6250 and got["file:/repo/docs/b.md", "direct"] == 12500
    if policy == "proportional":
        assert got["file:/repo/src/a.py", "carry"] == 667 and got["file:/repo/docs/b.md", "carry"] == 333


def test_segments_give_equal_scans(spark):
    df = spark.range(1, 400).select(
        (F.col("id") % 3).cast("string").alias("s"), F.col("id").alias("tie"), (F.col("id") % 5 == 0).cast("bigint").alias("t"),
        F.when(F.col("id") % 7 == 0, F.col("id").cast("string")).alias("m"),
    ).withColumn("ts", F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, tie div 40)"))
    lined = scan.number_lines(df, "s", "ts", "tie")
    rows = sorted((r.s, r.tie, r.line) for r in lined.collect())
    want = {s: sorted(k for k in range(1, 400) if k % 3 == int(s)) for s in "012"}
    assert rows == sorted((s, k, i + 1) for s, ks in want.items() for i, k in enumerate(ks))
    args = {"counts": {"c": F.col("t")}, "totals": {"n": F.col("t")}, "lasts": {"l": F.col("m")}}
    whole = scan.scan_session(lined, ["s"], "line", rows=10_000, **args)
    cut = scan.scan_session(lined, ["s"], "line", rows=16, **args)
    cols = ["s", "line", "c", "n", "l"]
    assert sorted(map(str, whole.select(*cols).collect())) == sorted(map(str, cut.select(*cols).collect()))


def test_one_hot_session_in_small_segments(spark):
    """A session with nine tenths of all rows gives the same figures cut into segments of 100 rows."""
    raw = events.raw_events(spark, "/root/testdata/sf0.001")
    path = stored_path(raw.withColumn("user_id", F.when(F.col("event_id") % 10 < 9, 1).otherwise(F.col("user_id")).cast("bigint")))
    found = []
    for rows in (1_000_000, 100):
        spark.conf.set(sizing.SEGMENT_KEY, rows)
        try:
            began = time.time()
            m = ledger.build(events.session_log(spark, path), events.RATES)
            rec = ledger.reconcile(m.turns, m.attributions)
            assert time.time() - began < 30
        finally:
            spark.conf.unset(sizing.SEGMENT_KEY)
        found.append(sorted(map(tuple, rec.collect())))
    assert found[0] == found[1] and len(found[0]) > 1


def stored_path(df):
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/events.parquet")
    return path


def test_places_and_offsets_over_slices(spark):
    df = spark.range(0, 300).select((F.col("id") * 7 % 300).alias("v"), F.concat(F.lit("s"), (F.col("id") * 7 % 300)).alias("name"))
    ranked = grouped.spread_rank(df, [], [F.desc("v")], "place")
    assert sorted((r.v, r.place) for r in ranked.collect()) == [(v, 300 - v) for v in range(300)]
    offsets = {r.name: r.o for r in grouped.running_offsets(df, "name", "v", "o").collect()}
    total = 0
    for name in sorted(offsets):
        assert offsets[name] == total
        total += int(name[1:])
