"""The merged store: commits are whole or not there, and only touched sessions are written."""

import pytest
from pyspark.sql import functions as F

from tallyfold.operators import result_tables, runs
from tallyfold.session import shared_dir
from tallyfold.sources import events as ev
from tallyfold.sources.rates import RateTable
from tallyfold.store import files
from tallyfold.store.merged import Conflict, MergedStore, stored_results
from tests.helpers import event_rows, events

NOW = "2030-01-01 00:00:00"
ROWS = event_rows(1, 5, 24)


@pytest.fixture
def store(spark, request):
    return MergedStore(spark, f"{shared_dir(spark)}/store-{request.node.name}", buckets=3)


def run(store, rows, policy="proportional", rates=ev.RATES, **options):
    out = runs.run(store, events(store.spark, rows), policy, rates, NOW, **options)
    return {r.session_id: r.origin for r in out.collect()}


def state(store):
    return {t: sorted(map(repr, store.read(t).drop("commit").collect())) for t in result_tables.TABLES}


def commits(store):
    return {r.session_id: r.commit for r in store.read("analysis_result").select("session_id", "commit").collect()}


def test_second_run_computes_nothing_and_growth_only_what_grew(spark, store):
    first = run(store, ROWS)
    assert set(first.values()) == {"computed"} and len(first) == 5
    before, at = state(store), commits(store)
    assert set(run(store, ROWS).values()) == {"stored"} and state(store) == before and store.head().version == 1
    more = [*ROWS, (900, ROWS[-1][1], 2, "purchase", 1.0, '{"k": 14}'), (901, ROWS[-1][1], 3, "view", 1.0, '{"k": 3}')]
    assert run(store, more) == {0: "stored", 1: "stored", 2: "computed", 3: "computed", 4: "stored"}
    now = commits(store)
    assert {s for s in at if now[s] != at[s]} == {"2", "3"}
    # What the store holds after the two runs is what one run over the whole log gives.
    other = MergedStore(spark, f"{store.root}-other", buckets=3)
    run(other, more)
    assert state(other) == state(store)
    assert set(run(store, more, policy="exclusive").values()) == {"computed"}
    assert stored_results(store).groupBy("policy").count().count() == 2
    whole = state(store)
    assert len(store.compact().commits) == 1 and state(store) == whole
    assert store.vacuum() and not store.vacuum() and state(store) == whole


def test_a_run_that_ends_between_two_tables_leaves_the_old_state(spark, store):
    run(store, ROWS[:60])
    before, head = state(store), store.head()
    model, keys, sessions = parts(spark, ROWS)
    tables = result_tables.tables(model, keys, sessions, NOW)
    dies = F.raise_error(F.lit("the machine is gone")).cast("string")
    with pytest.raises(Exception, match="the machine is gone"):
        store.commit({**tables, "cache_lane": tables["cache_lane"].withColumn("lane", dies)}, "proportional")
    assert store.head() == head and state(store) == before
    left = files.names(spark, f"{store.root}/charge")
    assert len(left) == 2 and store.vacuum() and len(files.names(spark, f"{store.root}/charge")) == 1
    store.commit(tables, "proportional")
    assert state(store) != before


def parts(spark, rows):
    from tallyfold.operators import ledger
    from tallyfold.operators import stored as st

    raw = events(spark, rows)
    model = ledger.build(ev.log_of(raw), ev.RATES, keep=True)
    sessions = runs.sessions_of(raw, NOW)
    return model, st.keyed(sessions, "proportional", ev.RATES), sessions


def test_bad_rows_and_results_that_do_not_add_up_are_refused(spark, store):
    model, keys, sessions = parts(spark, ROWS[:60])
    tables = result_tables.tables(model, keys, sessions, NOW)
    bad = {
        "charge": ("cost_micros", F.lit(-1)), "cache_lane": ("lane", F.lit("warm")), "turn": ("cache_ttl", F.lit("2h")),
        "attribution": ("component", F.when(F.col("target_kind") == "item", "output").otherwise(F.col("component"))), "context_item": ("size_tokens", F.lit(-3)),
    }
    for table, (column, value) in bad.items():
        with pytest.raises(Exception, match=f"a row of {table} breaks its rules"):
            store.commit({**tables, table: tables[table].withColumn(column, value)}, "proportional")
    more = tables["attribution"].withColumn("cost_micros", F.col("cost_micros") + F.when(F.col("component") == "output", 1).otherwise(0))
    with pytest.raises(ValueError, match="does not add up: total"):
        store.commit({**tables, "attribution": more}, "proportional")
    fewer = tables["turn"].where("ordinal > 0")
    with pytest.raises(ValueError, match="turns"):
        store.commit({**tables, "turn": fewer}, "proportional")
    assert store.head().version == 0


def test_replayed_batches_and_racing_runs(spark, store):
    run(store, ROWS[:60], stream="queue", batch=0)
    before, head = state(store), store.head()
    assert head.batches == {"queue": 0}
    model, keys, sessions = parts(spark, ROWS)
    tables = result_tables.tables(model, keys, sessions, NOW)
    assert store.commit(tables, "proportional", "queue", 0) == head and state(store) == before
    late = MergedStore(spark, store.root, buckets=3)
    late.head = lambda: head  # read before the other run's commit
    store.commit(runs.empty(store), "proportional")
    with pytest.raises(Conflict):
        late.commit(tables, "proportional")
    assert state(store) == before


def test_sessions_without_a_rate_are_named_and_the_run_goes_on(spark, store):
    few = RateTable(models=tuple(m for m in ev.RATES.models if m[0] != "m-small"), origin="explicit", priced_on="2024-01-01")
    got = run(store, ROWS, rates=few)
    assert set(got.values()) == {"computed", "skipped"} and len(got) == 5
    assert set(commits(store)) == {str(s) for s, o in got.items() if o == "computed"}


def test_sessions_that_may_still_grow_are_not_served(spark, store):
    last = max(r[1] for r in ROWS)
    out = runs.run(store, events(spark, ROWS), "proportional", ev.RATES, str(last))
    open_one = {r[2] for r in ROWS if r[1] == last}.pop()
    assert {r.origin for r in out.collect()} == {"computed"}
    assert str(open_one) not in commits(store) and len(commits(store)) == 4
    again = {r.session_id: r.origin for r in runs.run(store, events(spark, ROWS), "proportional", ev.RATES, str(last)).collect()}
    assert {s for s, o in again.items() if o == "computed"} == {open_one}
    runs.run(store, events(spark, ROWS), "proportional", ev.RATES, str(last), keep_open=True)
    flags = {r.session_id: r.is_complete for r in store.read("session").collect()}
    assert flags == {str(s): s != open_one for s in range(5)}


def test_empty_store_and_empty_log(spark, store):
    assert store.head().commits == () and store.read("turn").count() == 0 and stored_results(store).count() == 0
    assert run(store, []) == {} and store.head().version == 0
