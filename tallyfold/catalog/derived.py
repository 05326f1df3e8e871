"""Session logs as JSON lines, derived from the events table.

Every event becomes one line of the log format, so that ingest runs on data that grows with the
tables: purchases become assistant records (some damaged), views tool results of every payload
shape, clicks attachments, signups noise and titles, errors compactions or broken lines. Every
17th event is written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.session import shared_dir
from tallyfold.sources import events, logs
from tallyfold.store import files

_trees: dict[tuple, str] = {}

# A PNG header of (k + 1) * 40 by 600 pixels, as base64 text.
PNG = "base64(unhex(concat('89504E470D0A1A0A0000000D49484452', lpad(hex((k + 1) * 40), 8, '0'), lpad(hex(600), 8, '0'))))"

PURCHASE = """concat('{"type":"assistant","uuid":"', uuid, '","sessionId":"', session_id, '","version":"2.', k % 3, '","isSidechain":', k % 13 = 0,
 ',"requestId":"r', uuid, '","message":{"id":"m', uuid, '"', CASE WHEN k = 16 THEN '' WHEN k IN (14, 15) THEN ',"model":"<synthetic>"' ELSE concat(',"model":"', model, '"') END,
 ',"content":[{"type":"text","text":"x"},{"type":"tool_use","id":"t', uuid, '"}]', CASE WHEN k = 11 THEN '' ELSE concat(',"usage":{"input_tokens":',
 CASE k WHEN 1 THEN '-1' WHEN 2 THEN 'true' WHEN 3 THEN '2.5' WHEN 4 THEN '"x"' WHEN 8 THEN '56.0' WHEN 15 THEN '0' ELSE string(7 * k) END,
 CASE WHEN k = 15 THEN '' ELSE concat(',"cache_creation":{"ephemeral_5m_input_tokens":', write_5m, ',"ephemeral_1h_input_tokens":', write_1h,
 '},"cache_creation_input_tokens":', write_5m + write_1h + write_unknown, ',"cache_read_input_tokens":', read_tokens, ',"output_tokens":', output_tokens,
 CASE WHEN k = 10 THEN ',"iterations":[{"output_tokens":1}]' WHEN k % 3 = 0 THEN concat(',"iterations":[{"output_tokens":', k, '},{"output_tokens":', k, '}]') ELSE '' END) END, '}') END, '}}')"""

VIEW = """concat('{"type":"user","uuid":"', uuid, '","sessionId":"', session_id, '","toolName":"Read","toolUseResult":', CASE k % 8
 WHEN 0 THEN concat('{"file":{"filePath":"', identity, '","content":"', repeat('x', int(size_tokens * 4)), '","numLines":3,"totalLines":', k % 5 + 1, '}}')
 WHEN 1 THEN concat('{"filePath":"', identity, '","result_tokens":', size_tokens, '}')
 WHEN 2 THEN concat('{"file_path":"', identity, '","stdout":"', repeat('o', int(k)), '","stderr":"', repeat('e', int(k % 7)), '","interrupted":true}')
 WHEN 3 THEN concat('"', repeat('s', int(k)), '"') WHEN 4 THEN concat('[{"type":"text","text":"', repeat('t', int(k)), '"}]') WHEN 5 THEN '{"isImage":true}'
 WHEN 6 THEN concat('{"filePath":"', identity, '","nested":{"text":"abc","more":[{"text":"de"}]}}') ELSE concat('{"filePath":"', identity, '","n":', k, '}') END,
 ',"message":{"content":[{"type":"tool_result","tool_use_id":"t', uuid, '","content":', CASE WHEN k % 8 = 5 THEN concat('[{"type":"image","source":{"media_type":"image/png","data":"', """ + PNG + """, '"}}]')
 ELSE '[{"type":"text","text":"seen"}]' END, '}]}}')"""

CLICK = """concat('{"type":"attachment","uuid":"', uuid, '","sessionId":"', session_id, '","cwd":"/repo","attachment":', CASE k % 6
 WHEN 0 THEN concat('{"type":"file","displayPath":"', identity, '","content":"', repeat('c', int(size_tokens * 4)), '"}')
 WHEN 1 THEN concat('{"type":"edited_text_file","filename":"', identity, '","snippet":"', repeat('s', int(k)), '"}')
 WHEN 2 THEN concat('{"type":"skill_listing","names":["a","b:c"],"content":"', CASE WHEN k % 4 = 0 THEN '' ELSE concat('- a: ', repeat('y', int(k)), ' - b:c: zz') END, '"}')
 WHEN 3 THEN concat('{"type":"deferred_tools_delta","addedNames":["mcp__s__', k, '","plain"],"removedNames":[],"addedLines":', k + 1, '}')
 WHEN 4 THEN '{"type":"directory","path":"/repo"}' ELSE '{"type":"unlisted_thing"}' END, '}')"""

SIGNUP = """CASE k % 4 WHEN 0 THEN concat('{"type":"ai-title","aiTitle":"Session   ', k, ' of the user"}') WHEN 1 THEN '{"type":"wibble"}' WHEN 2 THEN '{"type":"queue-operation"}'
 ELSE concat('{"type":"user","uuid":"', uuid, '","isMeta":true,"message":{"content":[{"type":"text","text":"## Context Usage\\\\n### Categories\\\\n| Category | Tokens |\\\\n|---|---|\\\\n| System prompt | ~', k, '.5k (2%) |\\\\nMessages: ', k * 10, ' tokens"}]}}') END"""

ERROR = """CASE WHEN k % 5 <= 1 THEN concat('{"type":"system","subtype":"compact_boundary","uuid":"', uuid, '","compactMetadata":{"trigger":"auto","preTokens":', 1000 * k, ',"postTokens":', 100 * k,
 ',"cumulativeDroppedTokens":', 1500 * k, ',"preservedMessages":{"uuids":["', coalesce(prev1, 'none'), '","', coalesce(prev2, 'none'), '"],"allUuids":["', coalesce(prev2, 'none'), '"]}}}')
 WHEN k % 5 = 2 THEN '{"type":"system","subtype":"compact_boundary"}' WHEN k % 5 = 3 THEN '{"type": "user", ' WHEN k % 10 = 9 THEN '{"uuid":"x"}' ELSE '[1,2]' END"""


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, line, value): the log text of every session."""
    base = events.session_log(spark, sf_dir)
    earlier = "lag(string(uuid), {n}) OVER (PARTITION BY session_id ORDER BY line)"
    rows = base.withColumns({f"prev{n}": F.expr(earlier.format(n=n)) for n in (1, 2)})
    text = (
        F.when(F.col("is_turn"), F.expr(PURCHASE)).when(F.col("cause") == "tool_result", F.expr(VIEW))
        .when(F.col("is_injection"), F.expr(CLICK)).when(F.col("is_change"), F.expr(SIGNUP)).otherwise(F.expr(ERROR))
    )
    copies = F.when(F.col("uuid") % 17 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "session_id", text.alias("value"), F.col("line").alias("base_line"), F.explode(copies).alias("copy")
    ).select("session_id", (F.col("base_line") * 2 - 1 + F.col("copy")).cast("bigint").alias("line"), "value",
             F.concat(F.col("session_id").cast("string"), F.lit(".jsonl")).alias("path"))


def routed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.routed(log_lines(spark, sf_dir))


def write_tree(spark: SparkSession, sf_dir: str) -> str:
    """Write the derived logs below the shared folder, once per application and input.

    A file holds the lines of many sessions, each after its session and a tab, so that there are as many files as tasks and
    not as sessions. A session's lines may spread over several part files in line order (range partitioning), so
    that one very long session is not one task's work.
    """
    key = (spark.sparkContext.applicationId, files.stamp(spark, f"{sf_dir}/events.parquet"), sf_dir)
    if key not in _trees:
        root = f"{shared_dir(spark)}/logs-{spark.sparkContext.applicationId}-{len(_trees)}"
        (
            log_lines(spark, sf_dir)
            .withColumn("project", F.concat(F.lit("p"), (F.col("session_id") % 3).cast("string")))
            .repartitionByRange("project", "session_id", "line")
            .sortWithinPartitions("project", "session_id", "line")
            .select("project", F.concat_ws("\t", F.col("session_id").cast("string"), "value").alias("value"))
            .write.partitionBy("project").mode("overwrite").text(f"{root}/projects")
        )
        _trees[key] = root
    return _trees[key]


def scanned_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written logs read back as lines numbered per session."""
    root = write_tree(spark, sf_dir)
    scanned = logs.scan_lines(spark, f"{root}/projects/*/part-*")
    session = F.substring_index("value", "\t", 1).cast("bigint")
    named = scanned.withColumns({"log": session, "value": F.expr("substr(value, instr(value, '\t') + 1)")})
    return logs.number_lines(named, F.col("log"), shared=True).withColumnRenamed("log", "session_id")
