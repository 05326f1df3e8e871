"""Runs that bring a merged store up to its log: only sessions whose stored result may not be served are computed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.operators import ledger, result_tables
from tallyfold.operators import stored as st
from tallyfold.operators import turns as tn
from tallyfold.session import stored
from tallyfold.sources import events
from tallyfold.sources.rates import RateTable
from tallyfold.store.merged import MergedStore, restored, stored_results

#: A session whose last record is younger than this may still grow.
OPEN_FOR = "INTERVAL 5 MINUTES"
VERSIONS = 3


def sessions_of(raw: DataFrame, now: str) -> DataFrame:
    """session_id, print, is_complete and the rest of what is known of each session, from one pass over the records."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    version = F.when(F.col("event_type") == "purchase", F.concat(F.lit("2."), (k % VERSIONS).cast("string")))
    return raw.groupBy(F.col("user_id").alias("session_id")).agg(
        F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.max("event_id").cast("string")).alias("print"),
        (F.max("ts") <= F.expr(f"TIMESTAMP '{now}' - {OPEN_FOR}")).alias("is_complete"),
        F.count_if(F.col("event_type") == "purchase").alias("n_turns"),
        # A session has a handful of versions; the set is folded before the shuffle.
        F.array_join(F.array_sort(F.collect_set(version)), ",").alias("producing_version"),
        F.lit("/repo").alias("project_path"), F.lit(None).cast("string").alias("transcript_path"),
    )


def servable(store: MergedStore, keys: DataFrame, policy: str) -> DataFrame:
    """Sessions whose stored result is equal in all parts of the key, belongs to a finished session and adds up by its own rows."""
    head = store.head()
    if not head.commits:
        return keys.select(F.col("session_id").cast("string")).where("false")
    key = keys.select(F.col("session_id").cast("string"), F.col("print").alias("fingerprint"), F.col("rate_print").alias("pricing_fingerprint"), F.col("version").alias("tool_version"))
    result = store.read(result_tables.RESULT, policy, head)
    done = store.read("session", policy, head).where("is_complete").select("session_id")
    same = result.join(key, key.columns, "left_semi").join(done, "session_id", "left_semi")
    tables = [store.read(t, policy, head) for t in ("charge", "turn", "attribution")]
    sound = restored(*tables, result).where("fault is null").select("session_id")
    return same.select("session_id").join(sound, "session_id", "left_semi")


def run(store: MergedStore, raw: DataFrame, policy: str, rates: RateTable, now: str, only: DataFrame | None = None, stream: str | None = None, batch: int = 0, keep_open: bool = False) -> DataFrame:
    """session_id, origin: stored, computed, or skipped where no rate is known for one of its models.

    ``only`` limits the run to some sessions. Sessions that may still grow are computed and, unless ``keep_open``, not
    stored; they are never served. Records of sessions that are served are not read past their fingerprint. A batch
    of a stream that is in the store already is not computed again.
    """
    if only is not None:
        raw = raw.join(only.select(F.col("session_id").alias("user_id")).distinct(), "user_id", "left_semi")
    known = stored(sessions_of(raw, now), "run-sessions")
    keys = st.keyed(known, policy, rates)
    kept = servable(store, keys, policy).withColumn("kept", F.lit(True))
    state = known.join(kept, known["session_id"].cast("string") == kept["session_id"], "left").select(known["*"], F.coalesce("kept", F.lit(False)).alias("kept"))
    state = stored(state.withColumn("kept", F.col("kept") & F.col("is_complete")), "run-state")
    wanted = state.where("not kept and n_turns > 0").select(F.col("session_id").alias("user_id"))
    totals = stored_results(store, policy).select(F.col("session_id").cast("bigint").alias("session_id"), "total_micros", "attributed_micros")
    served = state.where("kept").select("session_id", F.lit("stored").alias("origin")).join(totals, "session_id")
    served = served.select("session_id", "total_micros", "attributed_micros", "origin")
    if not wanted.limit(1).count():
        if stream is not None:
            store.commit(empty(store), policy, stream, batch)
        return served
    # Models without a rate are found before the records are ordered, so only sessions that will be computed are.
    due = raw.join(wanted, "user_id", "left_semi")
    skipped = stored(tn.unpriceable(events.turn_models(due), rates.dimension(store.spark)), "run-skipped")
    priceable = due.join(skipped.select(F.col("session_id").alias("user_id")), "user_id", "left_anti")
    model = ledger.build(events.log_of(priceable), rates, policy, keep=True)
    final = state.where("not kept") if keep_open else state.where("not kept and is_complete")
    finished = final.select("session_id")
    served = stored(served, "run-served")  # before the commit changes what the store says
    computed = model.turns.select("session_id").distinct()
    if computed.join(finished, "session_id", "left_semi").limit(1).count():
        parts = result_tables.tables(model, keys, state, now.replace(" ", "T") + "Z")
        if not keep_open:
            parts = {name: rows.join(finished, "session_id", "left_semi") for name, rows in parts.items()}
        store.commit(parts, policy, stream, batch)
    elif stream is not None:
        store.commit(empty(store), policy, stream, batch)
    left_out = skipped.select("session_id", F.lit("skipped").alias("origin"))
    done = ledger.reconcile(model.turns, model.attributions).select("session_id", "total_micros", "attributed_micros", F.lit("computed").alias("origin"))
    return served.unionByName(done).unionByName(left_out, allowMissingColumns=True)


def empty(store: MergedStore) -> dict[str, DataFrame]:
    return {name: store.spark.createDataFrame([], ddl) for name, ddl in result_tables.TABLES.items()}
