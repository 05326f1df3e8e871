"""Sessions of a tree of logs: ``projects/<project>/<session>.jsonl`` with ``<session>/subagents/*.jsonl`` beside it.

Sizes, times, records, last id and title come from one scan over all files; they are
folded to a file and then to its session, so nothing is read twice and no session is gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.functions import fixed
from tallyfold.operators.sizing import vstr
from tallyfold.plans import grouped
from tallyfold.session import stored
from tallyfold.sources import logs
from tallyfold.store import files as fs

MAIN = r"/projects/([^/]+)/([^/]+)\.jsonl$"
SIDE = r"/projects/([^/]+)/([^/]+)/subagents/[^/]+\.jsonl$"
SESSION = ["project_dir", "session_id"]


def _placed(rows: DataFrame) -> DataFrame:
    """The rows of main and sidechain files with project_dir, session_id and side; other files of the tree are left out."""
    path = F.col("path")
    side = path.rlike(SIDE)

    def part(k: int) -> Column:
        return F.when(side, F.regexp_extract(path, SIDE, k)).otherwise(F.regexp_extract(path, MAIN, k))

    named = rows.withColumns({"side": side, "project_dir": part(1), "session_id": part(2)})
    return named.where(side | path.rlike(MAIN))


def _plain(path: str) -> Column:
    """A path without its scheme, as both readers name it."""
    return F.regexp_replace(path, r"^file:/+", "/")


def log_files(spark: SparkSession, root: str) -> DataFrame:
    """path, bytes, modified_at, project_dir, session_id, side of every log file; contents are not read.

    Files without a byte, over which Spark's readers pass, are left out; a file of blank lines has no records.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl")
    found = reader.load(f"{root}/projects").select(_plain("path").alias("path"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified_at"))
    return _placed(found)


def file_facts(spark: SparkSession, root: str) -> DataFrame:
    """What ``log_files`` says, with records, last_uuid, title: well-formed records of each file, and the last id and title among them.

    Sizes and times come with the lines, so the tree is listed and read once.
    """
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(f"{root}/projects")
    # A blank line is no record, but its file is one of the tree; as an empty list it stays among the lines.
    value = F.when(F.regexp_replace("value", r"^\s+|\s+$", "") == "", F.lit("[]")).otherwise(F.col("value"))
    lines = text.select(
        value.alias("value"), _plain("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"),
        F.col("_metadata.file_modification_time").alias("modified_at"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("mid"),
    )
    rows = logs.routed(lines)
    ok = ~F.col("route").isin("unparseable_json", "not_an_object")
    # The numbers of a task's rows rise, and a task reads a block from its beginning: this is the order in a file.
    at = F.struct("block", "mid")
    uuid, title = F.when(ok, vstr(F.col("v"), "$.uuid")), F.when(ok, logs.collapse_space(logs.record_title(F.col("v"), F.col("kind"))))
    named = rows.select("path", "bytes", "modified_at", ok.alias("ok"), at.alias("at"), uuid.alias("uuid"), title.alias("title"))
    return _placed(named.groupBy("path").agg(
        F.max("bytes").alias("bytes"), F.max("modified_at").alias("modified_at"),
        F.count_if("ok").alias("records"), F.max_by("uuid", F.when(F.col("uuid") != "", F.col("at"))).alias("last_uuid"),
        F.max_by("title", F.when(F.col("title") != "", F.col("at"))).alias("title"),
    ))


_LISTING = "project_dir string, session_id string, path string, record_count bigint, bytes bigint, modified_at timestamp, in_progress boolean, title string, subagent_files bigint, subagent_records bigint, fingerprint string"


def sessions(spark: SparkSession, root: str, now: Column | None = None) -> DataFrame:
    """One row for each session that has a main file; its sidechain files count towards records, bytes and the time of the last change.

    The name of the main file, which must not be of no bytes, is the session's id. A tree that is not there has no sessions.
    Without ``now`` the listing is as of the last change in the tree.
    """
    if not fs.exists(spark, f"{root}/projects"):
        return spark.createDataFrame([], _LISTING)
    zero = F.lit(0).cast("bigint")
    known = stored(file_facts(spark, root), "file-facts")
    if now is None:
        now = F.lit(known.agg(F.max("modified_at")).first()[0])
    main = ~F.col("side")
    per = known.groupBy(*SESSION).agg(
        F.max(F.when(main, F.col("path"))).alias("path"), F.sum("records").alias("record_count"), F.sum("bytes").alias("bytes"), F.max("modified_at").alias("modified_at"),
        F.max(F.when(main, F.col("last_uuid"))).alias("last_uuid"), F.max(F.when(main, F.col("title"))).alias("title"),
        F.count_if("side").alias("subagent_files"), F.coalesce(F.sum(F.when(F.col("side"), F.col("records"))), zero).alias("subagent_records"),
    )
    return per.where("path is not null").select(
        *SESSION, "path", "record_count", "bytes", "modified_at",
        (F.col("modified_at") > now - F.expr(f"INTERVAL {fixed.IN_PROGRESS_MINUTES} MINUTES")).alias("in_progress"), logs.clip_title(F.col("title")).alias("title"),
        "subagent_files", "subagent_records", F.concat_ws(":", F.col("record_count").cast("string"), F.coalesce("last_uuid", F.lit("-")), F.col("bytes").cast("string")).alias("fingerprint"),
    )


def newest_first(listed: DataFrame) -> DataFrame:
    """The listing with each session's place, from 1: the last changed first, then by path from the end."""
    return grouped.spread_rank(listed, [], [F.col("modified_at").desc(), F.col("path").desc()], "place")
