"""Limitation rules, rate layers from files, and session listing on a real tree of folders."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tallyfold.operators import notes
from tallyfold.session import shared_dir
from tallyfold.sources import discover, rates
from tallyfold.sources.events import RATES
from tallyfold.store import files

FACTS = "session_id long, versions array<string>, residual long, conflicts long, unparseable long, origin string, priced_on string, age_days int"


def said(spark, *row):
    return {r.rule: r.note for r in notes.told(spark.createDataFrame([row], FACTS), notes.SESSION_RULES, "session_id").collect()}


def test_every_rule_speaks_where_it_must_and_is_silent_elsewhere(spark):
    quiet = said(spark, 1, ["2.0"], 0, 0, 0, "bundled", "2024-01-01", 89)
    assert set(quiet) == {"imputed", "stripped"} and "bundled pricing table, rates as published 2024-01-01" in quiet["imputed"]
    loud = said(spark, 1, ["2.0", "2.1"], 1234567, 2, 3, "refreshed", "2024-01-01", 90)
    assert set(loud) == {"imputed", "stripped", "stale_rates", "unparseable", "usage_conflict", "residual_drop", "version_span"}
    assert loud["residual_drop"].startswith("About 1,234,567 tokens") and "2.0, 2.1" in loud["version_span"] and "90 days ago" in loud["stale_rates"]
    bare = said(spark, 1, [], None, None, None, "explicit", "unknown", None)
    assert set(bare) == {"imputed", "stripped", "undated_rates"}
    whole = "broken_spans long, gaps array<string>, flagged array<string>"
    for facts, rules in (((0, [], []), {"sub_threshold"}), ((1, ["a"], ["b", "c"]), {"sub_threshold", "broken_spans", "threshold_gap", "never_cacheable"})):
        got = {r.rule: r.note for r in notes.told(spark.createDataFrame([facts], whole), notes.REPORT_RULES).collect()}
        assert set(got) == rules
    assert "for a, so items were not checked for cacheability on that model." in got["threshold_gap"]


def test_notes_that_differ_in_figures_are_told_once(spark):
    rows = [(s, ["2.0"], 10 * s, 0, 0, "bundled", "2024-01-01", 5) for s in (1, 2, 3)]
    out = notes.uncertainty(notes.told(spark.createDataFrame(rows, FACTS), notes.SESSION_RULES, "session_id"), "exclusive")
    told = sorted(r.note for r in out.collect())
    assert len(told) == 4 and told[0].startswith("About 10 tokens") and told[0].endswith("(and 2 more session(s) with the same limitation, differing only in the figures)")
    assert any("'exclusive' policy" in t for t in told)


def test_layers_and_refused_files(spark):
    base = f"{shared_dir(spark)}/rates-{dt.datetime.now().timestamp()}"
    text = rates.text_of(RATES)
    for name in ("bundled", "refreshed", "explicit"):
        files.create(spark, f"{base}/{name}.toml", text.replace("2024-01-01", f"2024-01-0{len(name) - 5}"))
    at = {n: f"{base}/{n}.toml" for n in ("bundled", "refreshed", "explicit")}
    assert sorted(rates.load(spark, at["bundled"]).models) == sorted(RATES.models) and rates.load(spark, at["bundled"]).fingerprint == RATES.fingerprint
    used = rates.layers(spark, **at)
    assert [(t.origin, t.priced_on) for t in used] == [("explicit", "2024-01-03"), ("refreshed", "2024-01-04"), ("bundled", "2024-01-02")]
    assert [t.origin for t in rates.layers(spark, at["bundled"], refreshed=f"{base}/none.toml")] == ["bundled"]
    rows = rates.layer_rows(spark, used).collect()
    assert len(rows) == 9 and {r.origin for r in rows if r.in_use} == {"explicit"}
    with pytest.raises(Exception, match="none.toml"):
        rates.layers(spark, at["bundled"], explicit=f"{base}/none.toml")
    for cut, missing in (("schema_version = 1", "schema_version"), ("[cache]", "cache"), ('input_usd_per_mtok = 1', "input_usd_per_mtok"), ("write_multiplier_1h", "write_multiplier_1h")):
        with pytest.raises(ValueError, match=missing):
            rates.table_of(text.replace(cut, "[other]" if cut == "[cache]" else f"was_{cut}".replace("was_[", "[was_"), 1), "x.toml")
    with pytest.raises(ValueError, match="no model"):
        rates.table_of(text.split("\n[models")[0] + "\n[models]\n", "x.toml")


def put(path, lines, at):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + ("\n" if lines else ""))
    os.utime(path, (at, at))


def test_listing_of_a_tree(spark, tmp_path):
    p = f"{tmp_path}/projects"
    put(f"{p}/-repo-a/s1.jsonl", ['{"type":"user","uuid":"u1"}', "", '{"type":"ai-title","aiTitle":"  A   name "}', "{broken", "[1]", '{"uuid":"u2"}', '{"type":"custom-title","customTitle":"Own né"}', '{"uuid":""}'], 1000)
    put(f"{p}/-repo-a/s1/subagents/a.jsonl", ['{"uuid":"x"}', '{"type":"ai-title","aiTitle":"Not this"}'], 5000)
    put(f"{p}/-repo-a/s1/subagents/b.jsonl", [""], 400)
    put(f"{p}/-repo-a/s1/notes/c.jsonl", ['{"uuid":"x"}'], 9000)
    put(f"{p}/-repo-b/s2.jsonl", ['{"type":"user"}'] * 3, 5000)
    put(f"{p}/-repo-b/s3.jsonl", [""], 200)
    put(f"{p}/-repo-b/s5.jsonl", [], 7000)  # Spark's readers pass over files without a byte
    put(f"{p}/-repo-b/s4/subagents/a.jsonl", ['{"uuid":"y"}'], 7000)
    put(f"{p}/-repo-b/readme.txt", ["no log"], 7000)
    now = F.lit(dt.datetime.fromtimestamp(5200, dt.UTC)).cast("timestamp")
    rows = {r.session_id: r for r in discover.newest_first(discover.sessions(spark, str(tmp_path), now)).collect()}
    assert set(rows) == {"s1", "s2", "s3"}
    size = sum(os.path.getsize(f"{p}/-repo-a/{f}") for f in ("s1.jsonl", "s1/subagents/a.jsonl", "s1/subagents/b.jsonl"))
    one = rows["s1"]
    assert (one.record_count, one.bytes, one.title, one.subagent_files, one.subagent_records) == (7, size, "Own né", 2, 2)
    assert one.fingerprint == f"7:u2:{size}" and rows["s3"].fingerprint == "0:-:1" and rows["s2"].fingerprint.startswith("3:-:")
    assert [s for s, _ in sorted(rows.items(), key=lambda r: r[1].place)] == ["s2", "s1", "s3"]
    assert {s: r.in_progress for s, r in rows.items()} == {"s1": True, "s2": True, "s3": False}
    assert discover.sessions(spark, f"{tmp_path}/none", now).count() == 0
