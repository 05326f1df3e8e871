"""What one task holds does not grow with the input."""

from pyspark.sql import functions as F

from tallyfold.catalog import derived
from tallyfold.functions import paths
from tallyfold.operators import ledger, residency, rollups
from tallyfold.plans import sizing
from tallyfold.session import TARGET, TARGET_SIZE, stored
from tallyfold.sources import discover, events
from tests import helpers


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def build(spark, users):
    return ledger.build(events.log_of(helpers.events(spark, helpers.event_rows(3, users, 40))), events.RATES, keep=True)


def test_ledger_is_dealt_by_rows(spark, monkeypatch):
    """F8-F12: the ledger's tasks follow the rows of the log, and its windows need two sorts, not five."""
    monkeypatch.setattr(sizing, "LEDGER_ROWS", 50)
    few, many = build(spark, 5), build(spark, 10)
    assert "REPARTITION_BY_NUM" in plan(few.book)
    assert few.book.rdd.getNumPartitions() == 4
    assert many.book.rdd.getNumPartitions() == 8
    book = plan(many.book)
    above = book[: book.index("REPARTITION_BY_NUM")]
    assert above.count("Window [") == 5
    assert above.count("Sort [") == 2


def test_merged_partitions_stay_small(spark):
    """F8-F12: Spark merges shuffle partitions to a small size, and a session's own size stands."""
    before = spark.conf.get(TARGET)
    try:
        spark.conf.unset(TARGET)
        stored(spark.range(3).toDF("n"), "some")
        assert spark.conf.get(TARGET) == TARGET_SIZE
        spark.conf.set(TARGET, "32m")
        stored(spark.range(3).toDF("n"), "some")
        assert spark.conf.get(TARGET) == "32m"
    finally:
        spark.conf.set(TARGET, before)


def test_models_without_rate_need_no_order(spark):
    """F1-F5, F15: sessions without a rate are found from the records as they lie, with the models of the ordered log."""
    raw = helpers.events(spark, helpers.event_rows(5, 4, 30))
    models = events.turn_models(raw)
    assert "Exchange" not in plan(models)
    log = events.log_of(raw).where("is_turn").select("session_id", "model")
    assert sorted(map(tuple, models.collect())) == sorted(map(tuple, log.collect()))


def test_files_of_the_derived_logs_do_not_follow_sessions(spark, tmp_path):
    """many sessions share a file; lines keep their numbers and a log its own bytes."""
    rows = helpers.event_rows(7, 60, 5)
    helpers.events(spark, rows).write.parquet(f"{tmp_path}/events.parquet")
    got = derived.scanned_tree(spark, str(tmp_path)).cache()
    assert got.select("path").distinct().count() < 20
    want = derived.log_lines(spark, str(tmp_path)).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value") + 1).alias("b"))
    files = got.groupBy("session_id", "path").agg(F.max("file_bytes").alias("b"), F.count(F.lit(1)).alias("n"), F.max("line").alias("last"))
    seen = files.groupBy("session_id").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.max("last").alias("last"))
    assert sorted((r.session_id, r.n, r.b) for r in seen.collect()) == sorted((r.session_id, r.n, r.b) for r in want.collect())
    assert seen.where("n <> last").count() == 0


def test_folders_are_scanned_once(spark, tmp_path):
    """sizes and times come with the lines; a file of blank lines stays in the tree and has no records."""
    home = tmp_path / "projects" / "p"
    home.mkdir(parents=True)
    (home / "a.jsonl").write_text('{"type":"user","uuid":"u"}\n\n')
    (home / "b.jsonl").write_text(" \n\n")
    facts = discover.file_facts(spark, str(tmp_path))
    assert plan(facts).count("FileScan") == 1
    assert sorted((r.session_id, r.bytes, r.records, r.last_uuid) for r in facts.collect()) == [("a", 28, 1, "u"), ("b", 3, 0, None)]


def test_short_sessions_are_placed_by_one_pass(spark):
    """lines, turns and compactions before a row come from one shuffle and one sort, and equal those of sessions cut into segments."""
    raw = helpers.events(spark, helpers.event_rows(11, 3, 50) + [(k, None, None, "view", 1.0, '{"k": 1}') for k in (900, 901)])
    whole = events.log_of(raw)
    text = plan(whole)
    assert text.count("Exchange ") == 1 and text.count("Sort [") == 1
    spark.conf.set(sizing.SEGMENT_KEY, 49)
    try:
        cut = residency.place(events.log_of(raw))
    finally:
        spark.conf.unset(sizing.SEGMENT_KEY)
    old = residency.place(whole.drop(*residency.PLACED))
    columns = whole.columns
    rows = sorted(map(str, whole.collect()))
    assert len(rows) == 150
    assert rows == sorted(map(str, cut.select(columns).collect())) == sorted(map(str, old.select(columns).collect()))


def test_only_hot_sessions_are_cut(spark):
    """a session above the bound is cut into segments, the others keep their one pass."""
    rows = helpers.event_rows(12, 1, 200) + [(k + 1000, t, 7, *rest) for k, t, _, *rest in helpers.event_rows(13, 1, 20)]
    raw = helpers.events(spark, rows)
    spark.conf.set(sizing.SEGMENT_KEY, 60)
    try:
        mixed = events.log_of(raw)
    finally:
        spark.conf.unset(sizing.SEGMENT_KEY)
    want = events.log_of(raw)
    assert sorted(map(str, mixed.collect())) == sorted(map(str, want.collect())) and want.count() == 220


def test_category_lowers_the_path_once(spark):
    """the category alone equals that of the rule with its reason, without lowering the path for every rule."""
    paths_of = [
        "/repo/CLAUDE.md", "/r/Skills/x.py", "a/SKILL.MD", "/x/specs/y.md", "/x/.Specify/y", "/x/y.PY", "b.Md", "/x/", ".", "", None, "/x/.py", "c.json", "/A/B/./",
    ]
    kinds = ["file", "skill", "tool_schema", "mcp_schema", "system_prompt", "conversation", None]
    df = spark.createDataFrame([(p, k) for p in paths_of for k in kinds], "p string, k string")
    both = df.select(paths.category(F.col("p"), F.col("k")).alias("got"), paths.category_rule(F.col("p"), F.col("k"))["category"].alias("want"), "p", "k")
    assert [r for r in both.collect() if r.got != r.want] == []
    assert plan(both.select("got")).count("lower(") == 1


def test_sums_per_item_come_from_a_narrow_ledger(spark, monkeypatch):
    """costs per item need no mark, no wide turn facts and one row a span and block in the shuffle; the figures are those of the ledger."""
    monkeypatch.setattr(sizing, "BLOCK_TURNS", 3)
    m = build(spark, 4)
    text = plan(m.session_items) + plan(m.charges)
    narrow = plan(rollups.session_items(m.charges))
    assert "detail" not in narrow and "collect_list" not in narrow and "parquet" in text
    shuffled = narrow[narrow.index("REPARTITION_BY_NUM"):]
    assert "sequence(turn_index" not in shuffled
    items = [F.sum(F.when(F.col("row") == row, F.col("share")).otherwise(0)).alias(name) for row, name in (("inj", "direct_micros"), ("res", "carry_micros"))]
    lanes = [
        F.sum(F.when((F.col("row") == "res") & (F.col("lane") == lane), F.col("size_tokens")).otherwise(0)).alias(f"{lane}_token_turns")
        for lane in ("cached", "uncached", "loading")
    ]
    names = ["session_id", "item_id", "direct_micros", "carry_micros", "cached_token_turns", "uncached_token_turns", "loading_token_turns"]
    want = m.ledger.where("row <> 'turn'").groupBy("session_id", "item_id").agg(*items, *lanes)
    got = sorted(map(tuple, m.session_items.select(names).collect()))
    assert got == sorted(map(tuple, want.select(names).collect())) and sum(r[2] + r[3] for r in got) > 0
    held = m.ledger.where("row = 'res'").select("session_id", "turn_index", "item_id")
    resident = residency.resident(m.spans).select("session_id", "turn_index", "item_id")
    assert sorted(map(tuple, held.collect())) == sorted(map(tuple, resident.collect()))


def test_splits_beyond_31_bits_stay_exact(spark):
    """large charges and sizes leave the quick product for the exact one."""
    big = 3_000_000_000
    turn = spark.sql(
        f"select 1L as session_id, 0L as turn_index, 'm' as model, 1L as input_rate, cast(null as bigint) as threshold, 0L as input_tokens, 5L as write_tokens, 0L as read_tokens, "
        f"0L as fresh_micros, {big}L as write_micros, 0L as read_micros, cast(null as string) as confidence_cap"
    )
    inj = spark.sql(f"select 1L as session_id, 0L as turn_index, n as item_id, s as size_tokens, p as line, 'u' as uuid from values ('a', {big}L, 1L), ('b', {2 * big + 1}L, 2L) as v(n, s, p)")
    held = spark.sql("select 1L as session_id, 'a' as item_id, 1L as size_tokens, 1L as opened_line, 0L as first_turn, 0L as start, 0L as end_turn where false")
    changes = spark.sql("select 1L as session_id, 0L as turn_index where false")
    rows = {r.item_id: r.share for r in ledger.ledger(turn, inj, held, changes, "proportional").collect()}
    assert sum(rows.values()) == big and rows["a"] == big * big // (3 * big + 1) + (1 if (big * big) % (3 * big + 1) > (big * (2 * big + 1)) % (3 * big + 1) else 0)
