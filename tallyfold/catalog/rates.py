"""Rate-table queries: the table's use, its fingerprint and its age against the turns it prices."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from tallyfold.catalog.ev import model
from tallyfold.catalog.ev_sql import cost, ev_sql
from tallyfold.catalog.registry import query
from tallyfold.functions import fixed
from tallyfold.operators import ledger
from tallyfold.operators import stored as st
from tallyfold.session import shared_dir
from tallyfold.sources import events, rates
from tallyfold.store import files


@query("s21_rate_fingerprint", """
SELECT user_id AS session_id, substr(sha256('cache:1/10/5/4/2/5/4/low|m-large:5000000/25000000/None|m-mid:3000000/15000000/100|m-small:1000000/5000000/400'), 1, 16) AS rate_print
FROM events GROUP BY 1""")
def s21(spark, sf):
    """The rate part of each session's key: a digest of the whole table, of models and multipliers in use or not."""
    return st.keyed(st.fingerprints(events.raw_events(spark, sf)), "proportional", events.RATES).select("session_id", "rate_print")


@query("p27_stale_rates_flag", f"""
SELECT user_id AS session_id, CAST(date_diff('day', DATE '2023-10-15', CAST(max(ts) AS DATE)) AS BIGINT) AS age_days,
 date_diff('day', DATE '2023-10-15', CAST(max(ts) AS DATE)) >= {fixed.STALE_AFTER_DAYS} AS stale FROM events GROUP BY 1""")
def p27(spark, sf):
    """Age of a table published on a fixed day at the end of each session."""
    last = events.raw_events(spark, sf).groupBy(F.col("user_id").alias("session_id")).agg(F.to_date(F.max("ts")).alias("d"))
    age = F.datediff("d", F.lit("2023-10-15").cast("date")).cast("bigint")
    return last.select("session_id", age.alias("age_days"), (age >= fixed.STALE_AFTER_DAYS).alias("stale"))


#: Date and factor on all rates of each layer's file.
FILES = {rates.EXPLICIT: ("2024-01-01", 1), rates.REFRESHED: ("2023-11-20", 2), rates.BUNDLED: ("2023-05-01", 3)}


def rate_files(spark) -> dict[str, str]:
    """The three files, written anew: the table in use, and two that differ from it in every rate."""
    base = f"{shared_dir(spark).rstrip('/')}/rates-{uuid.uuid4().hex}"
    for origin, (day, times) in FILES.items():
        models = tuple((m, i * times, o * times, floor) for m, i, o, floor in events.RATES.models)
        files.create(spark, f"{base}/{origin}.toml", rates.text_of(replace(events.RATES, models=models, priced_on=day)))
    return {origin: f"{base}/{origin}.toml" for origin in FILES}


LAYER_VALUES = ", ".join(f"({k}, '{origin}', '{day}', {times}, {k == 0})" for k, (origin, (day, times)) in enumerate(FILES.items()))


@query("s14_rate_layers", ev_sql(f"""
SELECT CAST(l.layer AS BIGINT) AS layer, l.origin, l.priced_on, r.model, CAST(input_rate * times AS BIGINT) AS input_rate, CAST(output_rate * times AS BIGINT) AS output_rate, CAST(threshold AS BIGINT) AS threshold, l.in_use,
 (SELECT count(*) FROM turns t WHERE t.model = r.model) AS turns FROM rates r, (VALUES {LAYER_VALUES}) l(layer, origin, priced_on, times, in_use)"""))
def s14(spark, sf):
    """Every layer's rows as read from its file, with the turns that each model has."""
    path = rate_files(spark)
    rows = rates.layer_rows(spark, rates.layers(spark, path[rates.BUNDLED], path[rates.REFRESHED], path[rates.EXPLICIT]))
    turns = model(spark, sf).turns.groupBy("model").agg(F.count(F.lit(1)).alias("turns"))
    return rows.join(turns, "model", "left").withColumn("turns", F.coalesce("turns", F.lit(0).cast("bigint")))


def _total(times: int) -> str:
    i, o = f"(input_rate * {times})", f"(output_rate * {times})"
    parts = [cost("input_tokens", i), cost("write_5m", i, 1250000), cost("write_1h", i, 2000000), cost("write_unknown", i, 1250000), cost("read_tokens", i, 100000), cost("output_tokens", o)]
    return " + ".join(parts)


@query("s25_layered_rates", ev_sql(" UNION ALL ".join(
    f"SELECT session_id, CAST(sum({_total(times)}) AS BIGINT) AS total_micros, '{origin}' AS origin, '{day}' AS priced_on FROM turns GROUP BY 1" for origin, (day, times) in FILES.items())))
def s25(spark, sf):
    """Each session's cost by the layer in use where all three files are there, where no table is named, and where none was refreshed."""
    path, turns = rate_files(spark), model(spark, sf).turns
    plain = turns.drop("input_rate", "output_rate", "threshold")
    out = None
    for options in ({"refreshed": path[rates.REFRESHED], "explicit": path[rates.EXPLICIT]}, {"refreshed": path[rates.REFRESHED]}, {"refreshed": f"{path[rates.REFRESHED]}.none"}):
        used = rates.layers(spark, path[rates.BUNDLED], **options)[0]
        totals = ledger.priced(plain, used).groupBy("session_id").agg(F.sum("total_micros").alias("total_micros"))
        rows = rates.with_provenance(totals, used).select("session_id", "total_micros", "origin", "priced_on")
        out = rows if out is None else out.unionByName(rows)
    return out
