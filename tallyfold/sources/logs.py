"""JSON-lines session logs: scan with line numbers, routing, typed records, session listing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfold.functions import fixed, paths
from tallyfold.operators import changes as ch
from tallyfold.operators import sizing as sz
from tallyfold.operators import turns as tn
from tallyfold.operators.sizing import first_string, is_array, is_object, strict_int, vstr, vtype
from tallyfold.session import cut, stored

# --- scan -----------------------------------------------------------------------------------

LAYOUT = r"projects/([^/]+)/([^/]+?)(?:\.jsonl$|/)"
SIDECHAIN = r"/subagents/[^/]+\.jsonl$"


def scan_lines(spark: SparkSession, glob: str | list[str]) -> DataFrame:
    """Every line of the matching files with its file's facts and its place in its split."""
    return spark.read.text(glob).select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_size").alias("file_bytes"),
        F.col("_metadata.file_modification_time").alias("modified_at"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("mid"),
    )


def number_lines(scanned: DataFrame, log: Column, shared: bool = False) -> DataFrame:
    """Line numbers from 1 within each log, blank lines counted.

    A file may be ``shared`` by several logs, the lines of each in one stretch; ``file_bytes`` is then the size of the
    log's own lines in the file.

    A log may be one file or several read in path order. Rows of one split are consecutive in
    their task, so only the number of lines per split is aggregated and summed up; the lines
    themselves are never sorted or gathered, whatever the size of a file.
    """
    # Both sides below must see the same split of the files, so the scan is written once.
    keyed = stored(scanned.withColumn("log", log), "scan")
    before = W.partitionBy("log").orderBy("path", "block").rowsBetween(W.unboundedPreceding, -1)
    splits = (
        keyed.groupBy("log", "path", "block")
        .agg(F.min("mid").alias("first_mid"), F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value") + 1).alias("size"))
        .select(
            "log", "path", "block", "first_mid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"),
            *([F.sum("size").over(W.partitionBy("log", "path")).alias("file_bytes")] if shared else []),
        )
    )
    if shared:
        keyed = keyed.drop("file_bytes")
    return (
        keyed.join(splits, ["log", "path", "block"], "inner")
        .withColumn("line", (F.col("mid") - F.col("first_mid") + F.col("earlier") + 1).cast("bigint"))
        .drop("mid", "first_mid", "earlier")
    )


# --- routing --------------------------------------------------------------------------------


def routed(lines: DataFrame) -> DataFrame:
    """Parse each line once and say what it is: a record type, noise, or a kind of damage."""
    text = F.regexp_replace("value", r"^\s+|\s+$", "")
    parsed = lines.withColumn("text", text).filter("text <> ''").withColumn("v", F.try_parse_json("text"))
    kind = vstr(F.col("v"), "$.type")
    route = (
        F.when(F.col("v").isNull(), "unparseable_json")
        .when(~F.col("text").startswith("{"), "not_an_object")
        .when(kind.isNull(), "missing_type")
        .when(kind.isin(*fixed.CONVERSATION_TYPES), kind)
        .otherwise("ignored")
    )
    return parsed.withColumns({"kind": kind, "route": route}).drop("text")


def _items(v: Column, path: str) -> Column:
    """The array at a path as ARRAY<VARIANT>; empty for anything that is not an array."""
    return F.when(is_array(v, path), F.try_variant_get(v, path, "array<variant>")).otherwise(
        F.array().cast("array<variant>")
    )


def _strings(v: Column, path: str) -> Column:
    return F.filter(F.transform(_items(v, path), lambda e: vstr(e)), lambda s: s.isNotNull())


def tool_use_ids(v: Column) -> Column:
    blocks = F.filter(_items(v, "$.message.content"), lambda b: F.try_variant_get(b, "$.type", "string") == "tool_use")
    return F.filter(F.transform(blocks, lambda b: vstr(b, "$.id")), lambda s: s.isNotNull())


TOKEN_PATHS = {
    "input_tokens": "$.message.usage.input_tokens",
    "five": "$.message.usage.cache_creation.ephemeral_5m_input_tokens",
    "hour": "$.message.usage.cache_creation.ephemeral_1h_input_tokens",
    "flat": "$.message.usage.cache_creation_input_tokens",
    "read_tokens": "$.message.usage.cache_read_input_tokens",
    "output_tokens": "$.message.usage.output_tokens",
}


def assistant_records(rows: DataFrame) -> DataFrame:
    """Assistant records with their usage and an outcome: turn, ignored or malformed."""
    return _as_assistant(rows.filter("route = 'assistant'"))


def _as_assistant(rows: DataFrame) -> DataFrame:
    """Every row read as an assistant record."""
    v = F.col("v")
    counts = {name: strict_int(v, path) for name, path in TOKEN_PATHS.items()}
    steps = F.transform(
        F.filter(_items(v, "$.message.usage.iterations"), lambda e: vtype(e).startswith("OBJECT")),
        lambda e: strict_int(e, "$.output_tokens"),
    )
    staged = rows.withColumns(
        {
            "has_usage": is_object(v, "$.message") & is_object(v, "$.message.usage"),
            "model": F.coalesce(vstr(v, "$.message.model"), vstr(v, "$.model")),
            "c": F.struct(*[c.alias(n) for n, c in counts.items()]),
            "steps": steps,
        }
    )
    bad = F.exists("steps", lambda s: s["bad"])
    for name in TOKEN_PATHS:
        bad = bad | F.col(f"c.{name}.bad")
    zero = F.lit(0).cast("bigint")
    summed = F.aggregate("steps", zero, lambda a, s: a + s["value"])
    five, hour, flat = (F.col(f"c.{n}.value") for n in ("five", "hour", "flat"))
    unknown = F.greatest(zero, flat - five - hour)
    billed = F.col("c.input_tokens.value") + five + hour + unknown + F.col("c.read_tokens.value") + F.col("c.output_tokens.value")
    synthetic = F.col("model") == fixed.SYNTHETIC_MODEL
    unlike = (summed != 0) & (summed != F.col("c.output_tokens.value"))
    why = (
        F.when(F.col("model").isNull(), "the record has usage but no model, so it cannot be priced")
        .when(bad, "a token count is not a non-negative whole number")
        .when(unlike, "the iterations do not add up to the output tokens")
        .when(synthetic & (billed != 0), "a synthetic record carries usage")
    )
    outcome = (
        F.when(~F.col("has_usage"), "ignored").when(why.isNotNull(), "malformed").when(synthetic, "ignored").otherwise("turn")
    )
    return staged.withColumns(
        {
            "outcome": outcome,
            "why": F.when(F.col("has_usage"), why),
            "uuid": vstr(v, "$.uuid"),
            "message_id": F.coalesce(vstr(v, "$.message.id"), vstr(v, "$.messageId")),
            "request_id": vstr(v, "$.requestId"),
            "input_tokens": F.col("c.input_tokens.value"),
            "write_5m": five,
            "write_1h": hour,
            "write_unknown": unknown,
            "read_tokens": F.col("c.read_tokens.value"),
            "output_tokens": F.col("c.output_tokens.value"),
            "is_sidechain": F.coalesce(F.try_variant_get(v, "$.isSidechain", "boolean"), F.lit(False)),
            "parent_uuid": vstr(v, "$.parentUuid"),
            "version": vstr(v, "$.version"),
            "timestamp": vstr(v, "$.timestamp"),
            "tool_use_ids": tool_use_ids(v),
        }
    ).drop("c", "steps")


def tool_results(rows: DataFrame) -> DataFrame:
    """User records that carry a tool result: its id, its payload and its visible text length."""
    v = F.col("v")
    block = F.filter(_items(v, "$.message.content"), lambda b: F.try_variant_get(b, "$.type", "string") == "tool_result")
    first = F.try_element_at(block, F.lit(1))
    staged = rows.filter("route = 'user'").withColumns(
        {
            "block": first,
            "payload": F.try_variant_get(v, "$.toolUseResult", "variant"),
            "block_id": vstr(first, "$.tool_use_id"),
            "content": F.try_variant_get(first, "$.content", "variant"),
        }
    )
    present = F.col("payload").isNotNull() & (vtype(F.col("payload")) != "VOID")
    kept = staged.filter(F.col("block_id").isNotNull() | present)
    content_text = F.when(vtype(F.col("content")) == "STRING", F.length(F.try_variant_get("content", "$", "string")))
    return kept.withColumns(
        {"payload_walk": sz.walked(F.col("payload")), "content_walk": sz.walked(F.col("content"))}
    ).withColumns(
        {
            "uuid": F.coalesce(vstr(v, "$.uuid"), F.concat(F.lit("line:"), F.col("line").cast("string"))),
            "tool_use_id": F.coalesce(F.col("block_id"), vstr(v, "$.sourceToolUseID")),
            "tool_name": vstr(v, "$.toolName"),
            "cwd": vstr(v, "$.cwd"),
            "text_length": F.coalesce(content_text, F.col("content_walk.content_chars"), F.lit(0)).cast("bigint"),
            "identity": first_string(v, ["$.toolUseResult.file.filePath", "$.toolUseResult.filePath", "$.toolUseResult.file_path"]),
        }
    ).drop("block", "block_id")


def attachments(rows: DataFrame) -> DataFrame:
    """Attachment records of the content types, with identity, text length and listed names."""
    v = F.col("v")
    kind = vstr(v, "$.attachment.type")
    kept = rows.filter("route = 'attachment'").withColumn("attachment_type", kind).filter(
        F.col("attachment_type").isin(*fixed.CONTENT_ATTACHMENTS)
    )
    fields = ("text", "content", "snippet", "prompt")

    def chars(field: str) -> Column:
        path = f"$.attachment.{field}"
        plain = F.when(vtype(v, path) == "STRING", F.length(F.try_variant_get(v, path, "string")))
        return F.coalesce(plain, F.col(f"w_{field}.content_chars"), F.lit(0))

    walked = kept.withColumns(
        {f"w_{f}": sz.walked(F.try_variant_get(v, f"$.attachment.{f}", "variant")) for f in fields}
    )
    added_lines = F.when(vtype(v, "$.attachment.addedLines") == "BIGINT", F.try_variant_get(v, "$.attachment.addedLines", "bigint"))
    return walked.withColumns(
        {
            "uuid": F.coalesce(vstr(v, "$.uuid"), F.concat(F.lit("line:"), F.col("line").cast("string"))),
            "cwd": vstr(v, "$.cwd"),
            "identity": first_string(v, ["$.attachment.displayPath", "$.attachment.filename", "$.attachment.path", "$.attachment.agentType"]),
            "text_length": sum((chars(f) for f in fields), F.lit(0)).cast("bigint"),
            "added_lines": added_lines,
            "names": _strings(v, "$.attachment.names"),
            "added_names": _strings(v, "$.attachment.addedNames"),
            "removed_names": _strings(v, "$.attachment.removedNames"),
            "listing": F.when(vtype(v, "$.attachment.content") == "STRING", F.try_variant_get(v, "$.attachment.content", "string")),
        }
    ).drop(*[f"w_{f}" for f in fields])


def compactions(rows: DataFrame) -> DataFrame:
    """Compaction boundaries with their sizes and the union of the preserved ids."""
    return _as_boundary(rows.filter(_is_boundary()))


def _is_boundary() -> Column:
    return (F.col("route") == "system") & (vstr(F.col("v"), "$.subtype") == "compact_boundary")


def _as_boundary(rows: DataFrame) -> DataFrame:
    """Every row read as a compaction boundary."""
    v = F.col("v")
    pre, post, total = (
        strict_int(v, f"$.compactMetadata.{n}") for n in ("preTokens", "postTokens", "cumulativeDroppedTokens")
    )
    base = "$.compactMetadata.preservedMessages"
    return rows.withColumns(
        {
            "has_metadata": is_object(v, "$.compactMetadata"),
            "p": F.struct(pre.alias("pre"), post.alias("post"), total.alias("total")),
            "preserved": F.array_union(_strings(v, f"{base}.allUuids"), _strings(v, f"{base}.uuids")),
            "uuid": F.coalesce(vstr(v, "$.uuid"), F.concat(F.lit("line:"), F.col("line").cast("string"))),
        }
    ).withColumns(
        {
            "outcome": F.when(
                ~F.col("has_metadata") | F.col("p.pre.bad") | F.col("p.post.bad") | F.col("p.total.bad"), "malformed"
            ).otherwise("compaction"),
            "pre_tokens": F.col("p.pre.value"),
            "post_tokens": F.col("p.post.value"),
            "cumulative_tokens": F.col("p.total.value"),
        }
    ).drop("p")


# --- diagnostics ----------------------------------------------------------------------------


def damage(rows: DataFrame, log: str) -> DataFrame:
    """Every line that could not be used, with its kind and reason, from one pass in which each line is parsed once.

    What is said of a line is written before it is filtered: a filter that Spark moves below the parsing repeats
    the parsing for each place where it names a parsed value.
    """
    where = F.concat(F.element_at(F.split(F.col("path"), "/"), -1), F.lit(":"), F.col("line").cast("string"))
    broken = F.col("route").isin("unparseable_json", "not_an_object", "missing_type")
    turn = F.col("route") == "assistant"
    read = _as_assistant(rows.withColumn("of", F.when(broken, "line").when(turn, "turn").when(_is_boundary(), "boundary")))
    read = _as_boundary(read.select(log, "line", "path", "route", "v", "of", F.col("outcome").alias("turn_outcome"), "why"))
    bad_turn = (F.col("of") == "turn") & (F.col("turn_outcome") == "malformed")
    bad_boundary = (F.col("of") == "boundary") & (F.col("outcome") == "malformed")
    sample = (
        F.when(bad_turn, F.concat(where, F.lit(": "), F.col("why")))
        .when(bad_boundary, F.concat(where, F.lit(": the boundary has no usable metadata")))
        .otherwise(where)
    )
    kind = F.when(F.col("of") == "line", F.col("route")).when(bad_turn | bad_boundary, "malformed_record")
    said = stored(read.select(log, "line", kind.alias("kind"), F.when(kind.isNotNull(), sample).alias("sample")), "damage")
    return said.filter("kind IS NOT NULL")


def diagnostics(found: DataFrame, log: str) -> DataFrame:
    """Count and first samples per log and kind.

    The count folds on the map side; the samples come from a row_number filter, which Spark
    limits to five rows per group in every task before it shuffles.
    """
    counted = found.groupBy(log, "kind").agg(F.count(F.lit(1)).alias("count"))
    order = W.partitionBy(log, "kind").orderBy("line")
    first = (
        found.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= fixed.SAMPLES_SHOWN)
        .groupBy(log, "kind")
        .agg(F.array_sort(F.collect_list(F.struct("rn", "line", "sample"))).alias("s"))
        .select(log, "kind", F.transform("s", lambda r: r["sample"]).alias("samples"), F.transform("s", lambda r: r["line"]).alias("sample_lines"))
    )
    return counted.join(first, [log, "kind"], "inner")


# --- listing --------------------------------------------------------------------------------


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clip_title(text: Column) -> Column:
    head = F.substring(text, 1, fixed.TITLE_LENGTH)
    cut = F.regexp_replace(head, " [^ ]*$", "")
    cut = F.when(cut == "", head).otherwise(cut)
    return F.when(F.length(text) <= fixed.TITLE_LENGTH, text).otherwise(F.concat(cut, F.lit("…")))


def last_titles(rows: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """The last non-blank title of each session, with its spaces collapsed and clipped."""
    clean = rows.select(key, order, collapse_space(F.col(text)).alias("t")).filter("t <> ''")
    return clean.groupBy(key).agg(clip_title(F.max_by("t", order)).alias("title"))


def record_title(v: Column, kind: Column) -> Column:
    named = first_string(v, ["$.customTitle", "$.aiTitle", "$.title"])
    return F.when(kind.isin(*fixed.TITLE_TYPES), named)


def display_name(session: Column, title: Column) -> Column:
    short = F.substring(session, 1, fixed.SHORT_ID_LENGTH)
    return F.when(title.isNull(), short).otherwise(F.concat(title, F.lit(" ("), short, F.lit(")")))


def id_summaries(rows: DataFrame, key: str, value: str, shown: int = 6) -> DataFrame:
    """Distinct ids of a group in words: all of them, or the first six and how many more."""
    ids = rows.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("ids"))
    n = F.size("ids")
    head = F.array_join(F.slice("ids", 1, shown), ", ")
    text = F.concat(n.cast("string"), F.lit(" sessions ("), head, F.lit(", and "), (n - shown).cast("string"), F.lit(" more)"))
    spread = F.concat(n.cast("string"), F.lit(" versions from "), F.element_at("ids", 1), F.lit(" to "), F.element_at("ids", -1))
    everything = F.array_join("ids", ", ")
    return ids.select(
        key, F.when(n <= shown, everything).otherwise(text).alias("ids"),
        F.when(n <= shown, everything).otherwise(spread).alias("versions"),
    )


def fingerprint(records: Column, last_uuid: Column, size: Column) -> Column:
    return F.concat_ws(":", records.cast("string"), F.coalesce(last_uuid, F.lit("-")), size.cast("string"))


def listing(rows: DataFrame, extra: DataFrame | None, keys: list[str], now: Column) -> DataFrame:
    """One row per session: records, size, last change, coverage fingerprint, title, liveness.

    ``rows`` are routed lines of main logs, ``extra`` those of sidechain files; the latter count
    towards records and bytes only. Sizes are summed over distinct files.
    """
    obj = ~F.col("route").isin("unparseable_json", "not_an_object")
    v = F.col("v")
    main = rows.withColumns(
        {"uuid": F.when(obj, vstr(v, "$.uuid")), "title": collapse_space(F.when(obj, record_title(v, F.col("kind"))))}
    )
    title_at = F.when(F.col("title") != "", F.col("line"))
    per = main.groupBy(*keys).agg(
        F.count_if(obj).alias("main_records"),
        F.max_by("uuid", F.when(F.col("uuid").isNotNull(), F.col("line"))).alias("last_uuid"),
        clip_title(F.max_by("title", title_at)).alias("title"),
    )
    everything = rows.select(*keys, "path", "file_bytes", "modified_at", obj.alias("is_record"), F.lit(0).alias("side"))
    if extra is not None:
        everything = everything.unionByName(
            extra.select(*keys, "path", "file_bytes", "modified_at", obj.alias("is_record"), F.lit(1).alias("side"))
        )
    files = everything.groupBy(*keys, "path").agg(
        F.max("file_bytes").alias("file_bytes"), F.max("modified_at").alias("modified_at"),
        F.count_if("is_record").alias("records"), F.max("side").alias("side"),
    )
    sums = files.groupBy(*keys).agg(
        F.sum("records").alias("record_count"), F.sum("file_bytes").alias("bytes"),
        F.max("modified_at").alias("modified_at"), F.sum("side").alias("sidechain_files"),
    )
    return per.join(sums, keys, "inner").select(
        *keys, "record_count", "bytes", "modified_at", "last_uuid", "title", "sidechain_files",
        fingerprint(F.col("record_count"), F.col("last_uuid"), F.col("bytes")).alias("fingerprint"),
        (F.col("modified_at") > now - F.expr(f"INTERVAL {fixed.IN_PROGRESS_MINUTES} MINUTES")).alias("in_progress"),
    )


# --- from records to the session log --------------------------------------------------------


@dataclass(frozen=True)
class Parsed:
    """Typed records of a set of logs, ready for attribution."""

    turns: DataFrame
    results: DataFrame
    attachments: DataFrame
    compactions: DataFrame
    damage: DataFrame


def parse(rows: DataFrame, log: str) -> Parsed:
    """Typed records, each kind written once: what follows reads columns, not JSON."""
    keep = [log, "path", "line"]
    turns = assistant_records(rows).filter("outcome = 'turn'").select(
        *keep, "uuid", "message_id", "request_id", "version", "timestamp", *TURN_COLUMNS
    )
    bounds = compactions(rows).filter("outcome = 'compaction'").select(
        *keep, "uuid", "pre_tokens", "post_tokens", "cumulative_tokens", "preserved"
    )
    return Parsed(
        turns=cut(turns), results=typed_results(rows, log),
        attachments=cut(attachments(rows).drop("v", "value", "kind", "route")),
        compactions=cut(bounds), damage=damage(rows, log),
    )


def typed_results(rows: DataFrame, log: str) -> DataFrame:
    return cut(
        tool_results(rows).select(
            log, "path", "line", "uuid", "tool_use_id", "tool_name", "payload", "content", "payload_walk", "content_walk",
            "text_length", "identity", "cwd",
        )
    )


TURN_COLUMNS = [
    "model", "input_tokens", "write_5m", "write_1h", "write_unknown", "read_tokens", "output_tokens", "is_sidechain",
]


def deduplicated(turns: DataFrame, log: str, corpus: bool = False) -> DataFrame:
    """The first copy of every exchange, within a log or over the corpus."""
    own = F.concat(F.element_at(F.split(F.col("path"), "/"), -1), F.lit(":"), F.col("line").cast("string"))
    named = turns.withColumn("uuid", F.coalesce("uuid", own)).withColumns(
        {"k1": F.coalesce("message_id", "uuid"), "k2": F.coalesce("request_id", "uuid")}
    )
    key = ["k1", "k2"] if corpus else [log, "k1", "k2"]
    keep = ["uuid", "version", "timestamp", *TURN_COLUMNS] + ([log] if corpus else [])
    order = ["path", "line"] if corpus else ["line"]
    return tn.first_wins(named, key, order, keep)


def canonical(parsed: Parsed, log: str, project: Column | None = None, caps: dict[str, int] | None = None) -> DataFrame:
    """Session log rows of parsed logs: kept turns, sized injections, changes and compactions.

    Images are sized for the model of the log's first turn. An attachment may be both content
    and a change of the prompt prefix, and then carries both sets of columns on its one row.
    """
    project = F.lit(None).cast("string") if project is None else project
    kept = deduplicated(parsed.turns, log)
    first_model = kept.groupBy(log).agg(F.min_by("model", "line").alias("sizing_model"))
    no, yes = F.lit(False), F.lit(True)
    turns = kept.select(
        F.col(log).alias("session_id"), "line", "uuid", yes.alias("is_turn"), no.alias("is_injection"),
        no.alias("is_change"), no.alias("is_compaction"), *TURN_COLUMNS,
    )
    results = parsed.results.withColumn("project", project).join(first_model, log, "left")
    sized = sz.tool_result_sizes(results, [log, "line"], "sizing_model", caps)

    def item(kind: Column, identity: Column, cwd: Column) -> dict[str, Column]:
        full = paths.absolute_identity(identity, kind, cwd, F.col("project"))
        return {
            "kind": kind, "identity": full, "item_id": paths.item_id(full, kind, F.col("project")),
            "category": paths.category(full, kind), "size_tokens": F.col("q.tokens"), "basis": F.col("q.basis"),
            "confidence": F.col("q.confidence"),
        }

    held = F.coalesce((F.col("q.tokens") > 0) & F.col("item_id").isNotNull(), no)
    from_results = (
        sized.withColumns(item(F.lit("file"), F.col("identity"), F.col("cwd")))
        .withColumns({"is_injection": held, "cause": F.lit("tool_result")})
        .filter("is_injection")
        .select(
            F.col(log).alias("session_id"), "line", "uuid", no.alias("is_turn"), "is_injection", no.alias("is_change"),
            no.alias("is_compaction"), "item_id", "kind", "identity", "category", "size_tokens", "basis", "confidence", "cause",
        )
    )
    kind = F.col("attachment_type")
    is_file = kind.isin(*fixed.FILE_ATTACHMENTS)
    item_kind = F.when(is_file, "file")
    for name, its in fixed.INJECTED_KINDS.items():
        item_kind = F.when(kind == name, its).otherwise(item_kind)
    cause = F.when(kind == "file", "at_mention").when(is_file, "attachment").otherwise(kind)
    tool_change = kind.isin(*fixed.TOOL_CHANGES)
    edit = ch.describe_edit(F.col("raw_identity"), paths.category(F.col("raw_identity"), F.lit("file")))
    detail = (
        F.when(tool_change, ch.describe_tool_change(F.col("added_names"), F.col("removed_names")))
        .when(kind == "skill_listing", ch.describe_listing(F.col("names")))
        .when(kind == "edited_text_file", edit)
    )
    attached = (
        parsed.attachments.withColumn("project", project)
        .withColumn("q", sz.attachment_size(kind, F.col("text_length"), F.col("added_lines")))
        .withColumn("raw_identity", F.col("identity"))
        .withColumn("named", F.when(is_file, F.col("identity")).when(item_kind.isNotNull(), kind))
        .withColumns(item(item_kind, F.col("named"), F.col("cwd")))
        .withColumns({"is_injection": held, "cause": cause, "detail": detail})
        .withColumns(
            {
                "is_change": F.col("detail").isNotNull(),
                "trigger": F.when(tool_change, "tool_set_changed").otherwise("instruction_changed"),
                "tier": F.when(tool_change, "tools").otherwise("system"),
            }
        )
        .filter("is_injection OR is_change")
        .select(
            F.col(log).alias("session_id"), "line", "uuid", no.alias("is_turn"), "is_injection", "is_change",
            no.alias("is_compaction"), "item_id", "kind", "identity", "category", "size_tokens", "basis", "confidence",
            "cause", "trigger", "tier", "detail",
        )
    )
    bounds = parsed.compactions.select(
        F.col(log).alias("session_id"), "line", "uuid", no.alias("is_turn"), no.alias("is_injection"),
        no.alias("is_change"), yes.alias("is_compaction"), "pre_tokens", "post_tokens", "cumulative_tokens", "preserved",
    )
    out = turns
    for part in (from_results, attached, bounds):
        out = out.unionByName(part, allowMissingColumns=True)
    return cut(out.withColumn("pinned", no))


def survivors_of(inj: DataFrame, comps: DataFrame) -> DataFrame:
    """The items each compaction kept, from its preserved list."""
    from tallyfold.operators.residency import preserved_items

    listed = comps.select("session_id", "comp_index", F.explode("preserved").alias("uuid"))
    return preserved_items(inj, listed)


def listed_skills(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Characters of each listed skill, from the place of its entry to the next one.

    When any name has no entry, no part is measured and all weigh the same.
    """
    entry = rows.select(*keys, "listing", F.posexplode("names").alias("at", "name"))
    located = entry.withColumn(
        "start", F.expr("locate(concat('- ', name, ': '), coalesce(listing, ''))")
    )
    over = W.partitionBy(*keys)
    placed = located.withColumns(
        {
            "missing": F.max(F.when(F.col("start") == 0, 1).otherwise(0)).over(over),
            "next": F.lead("start").over(over.orderBy("start", "at")),
        }
    )
    end = F.coalesce(F.col("next"), F.length("listing") + 1)
    plugin = F.contains("name", F.lit(":"))
    return placed.select(
        *keys, "at", "name",
        F.when(F.col("missing") == 1, 1).otherwise(F.greatest(F.lit(1), end - F.col("start"))).cast("bigint").alias("chars"),
        F.when(plugin, "plugin").otherwise("unstated").alias("origin"),
        F.when(plugin, F.split_part("name", F.lit(":"), F.lit(1))).alias("plugin"),
        (F.col("missing") == 0).alias("measured"),
    )
