"""Session listing on a tree of log files that is written from the events: a main file a session, purchases of some turns beside it."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.catalog.registry import query
from tallyfold.session import shared_dir
from tallyfold.sources import discover, events
from tallyfold.store import files

#: The text of an event's line, said alike by both engines.
LINE = """CASE WHEN event_type = 'signup' THEN concat('{"type":"ai-title","aiTitle":" Work on   item ', k, ' of the long list of things that are still to be done"}')
 WHEN event_type = 'error' AND k % 3 = 0 THEN '[1,2]' WHEN event_type = 'error' AND k % 3 = 1 THEN '{"type": "user", ' WHEN event_type = 'click' AND k % 10 = 0 THEN ''
 WHEN event_type = 'error' THEN '{"type":"system"}' ELSE concat('{"type":"user","uuid":"e', event_id, '","text":"é', event_type, '"}') END"""
FILE = "CASE WHEN event_type = 'purchase' AND k % 13 = 0 THEN concat('/subagents/agent-', k % 2, '.jsonl') ELSE '.jsonl' END"

_trees: dict[tuple, str] = {}


def write_tree(spark, sf) -> str:
    """The tree's root below the shared folder; a file's time is that of its last event. A file is one stream of lines, written by one task."""
    key = (spark.sparkContext.applicationId, files.stamp(spark, f"{sf}/events.parquet"), sf)
    if key in _trees:
        return _trees[key]
    root = f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}"
    folder = root.removeprefix("file://").removeprefix("file:")
    raw = events.raw_events(spark, sf).withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    path = F.concat(F.lit("/projects/p"), (F.col("user_id") % 3).cast("string"), F.lit("/s"), F.col("user_id").cast("string"), F.expr(FILE))
    rows = raw.select(path.alias("path"), "ts", "event_id", F.expr(LINE).alias("line"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, out, last = None, None, None

        def done() -> None:
            if out is not None:
                out.close()
                at = pd.Timestamp(last).value
                os.utime(folder + name, ns=(at, at))

        for batch in batches:
            for p, ts, line in batch[["path", "ts", "line"]].itertuples(index=False):
                if p != name:
                    done()
                    os.makedirs(os.path.dirname(folder + p), exist_ok=True)
                    name, out = p, open(folder + p, "wb")
                out.write(line.encode() + b"\n")
                last = ts
        done()
        yield pd.DataFrame({"n": [1]})

    rows.repartition("path").sortWithinPartitions("path", "ts", "event_id").mapInPandas(write, "n int").count()
    _trees[key] = root
    return root


def listing(spark, sf) -> DataFrame:
    """The listing as of the last change in the tree."""
    return discover.sessions(spark, write_tree(spark, sf))


TREE = f"""
WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
ln AS (SELECT user_id, event_id, ts, event_type, k, {LINE} AS line, {FILE} AS file FROM e),
x AS (SELECT *, file <> '.jsonl' AS side, line <> '' AND NOT (event_type = 'error' AND k % 3 < 2) AS ok FROM ln),
f AS (SELECT user_id, file, side, count(*) FILTER (ok) AS records, sum(strlen(line) + 1) AS bytes, epoch_us(max(ts)) // 1000 AS modified,
 arg_max('e' || event_id, (ts, event_id)) FILTER (ok AND event_type NOT IN ('signup', 'error')) AS last_uuid, arg_max(k, (ts, event_id)) FILTER (event_type = 'signup') AS title_k FROM x GROUP BY 1, 2, 3),
s AS (SELECT 's' || user_id AS session_id, 'p' || (user_id % 3) AS project_dir, CAST(sum(records) AS BIGINT) AS record_count, CAST(sum(bytes) AS BIGINT) AS bytes, max(modified) AS modified_ms,
 max(last_uuid) FILTER (NOT side) AS last_uuid, max(title_k) FILTER (NOT side) AS title_k, count(*) FILTER (side) AS subagent_files, CAST(coalesce(sum(records) FILTER (side), 0) AS BIGINT) AS subagent_records,
 count(*) FILTER (NOT side) AS mains FROM f GROUP BY user_id)
"""
TITLE = "CASE WHEN title_k IS NOT NULL THEN regexp_replace(substr('Work on item ' || title_k || ' of the long list of things that are still to be done', 1, 60), ' [^ ]*$', '') || '…' END"


@query("s10_listing_of_folders", TREE + f"""
SELECT session_id, project_dir, record_count, bytes, modified_ms, modified_ms > (SELECT max(modified_ms) FROM s) - 300000 AS in_progress, {TITLE} AS title,
 row_number() OVER (ORDER BY modified_ms DESC, project_dir || '/' || session_id || '.jsonl' DESC) AS place FROM s WHERE mains > 0""")
def s10(spark, sf):
    """Every session of the tree, newest first, with size, time of the last change, liveness and name."""
    rows = discover.newest_first(listing(spark, sf))
    return rows.select("session_id", "project_dir", "record_count", "bytes", F.unix_millis("modified_at").alias("modified_ms"), "in_progress", "title", "place")


@query("s11_sidechain_files", TREE + """
SELECT session_id, subagent_files, subagent_records, record_count, bytes FROM s WHERE mains > 0""")
def s11(spark, sf):
    """What the files of sidechains add to their session."""
    return listing(spark, sf).select("session_id", "subagent_files", "subagent_records", "record_count", "bytes")


@query("s12_fingerprint_of_files", TREE + """
SELECT session_id, record_count || ':' || coalesce(last_uuid, '-') || ':' || bytes AS fingerprint FROM s WHERE mains > 0""")
def s12(spark, sf):
    """Records, last id of the main file, and bytes of all files."""
    return listing(spark, sf).select("session_id", "fingerprint")
