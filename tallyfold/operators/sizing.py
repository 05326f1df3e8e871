"""Token sizes: a ladder from recorded counts over pixels to character estimates.

Every size is a STRUCT<tokens, basis, confidence, method>; NULL tokens means withheld.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions import fixed
from tallyfold.functions.nested import walk
from tallyfold.operators.rollups import name_of, rank_of


def char_tokens(chars: Column) -> Column:
    return F.call_function("div", chars.cast("bigint"), F.lit(fixed.CHARS_PER_TOKEN).cast("bigint"))


def quantity(tokens: Column, basis: str, confidence: str, method: Column) -> Column:
    return F.struct(
        tokens.cast("bigint").alias("tokens"), F.lit(basis).alias("basis"),
        F.lit(confidence).alias("confidence"), method.alias("method"),
    )


def estimate(chars: Column, what: Column, tail: Column | None = None) -> Column:
    text = F.concat(
        F.lit("character-based estimate (NOT a measurement): "), chars.cast("string"), F.lit(" chars of "), what,
        F.lit(f" / {fixed.CHARS_PER_TOKEN}"), F.lit("") if tail is None else tail,
    )
    return quantity(char_tokens(chars), "estimated", "low", text)


def withheld(reason: Column) -> Column:
    return quantity(F.lit(None), "estimated", "low", F.concat(F.lit("withheld: "), reason))


def combine(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum of parts with the weakest basis and confidence; one withheld part withholds all."""
    any_missing = F.bool_or(F.col("tokens").isNull())
    out = parts.groupBy(*keys).agg(
        any_missing.alias("missing"), F.sum("tokens").alias("sum"),
        F.max(rank_of(F.col("basis"), fixed.BASIS)).alias("b"),
        F.max(rank_of(F.col("confidence"), fixed.CONFIDENCE)).alias("c"),
    )
    return out.select(
        *keys, F.when(~F.col("missing"), F.col("sum")).alias("tokens"),
        F.when(F.col("missing"), "estimated").otherwise(name_of(F.col("b"), fixed.BASIS)).alias("basis"),
        F.when(F.col("missing"), "low").otherwise(name_of(F.col("c"), fixed.CONFIDENCE)).alias("confidence"),
    )


# --- VARIANT access -------------------------------------------------------------------------


def vtype(v: Column, path: str = "$") -> Column:
    """Type name at a path; NULL when absent, VOID for a JSON null."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def vstr(v: Column, path: str = "$") -> Column:
    """The non-empty string at a path; NULL for anything else."""
    return F.when(vtype(v, path) == "STRING", F.nullif(F.try_variant_get(v, path, "string"), F.lit("")))


def is_object(v: Column, path: str = "$") -> Column:
    return F.coalesce(vtype(v, path).startswith("OBJECT"), F.lit(False))


def is_array(v: Column, path: str = "$") -> Column:
    return F.coalesce(vtype(v, path).startswith("ARRAY"), F.lit(False))


def first_string(v: Column, paths: Sequence[str]) -> Column:
    return F.coalesce(*[vstr(v, p) for p in paths])


def strict_int(v: Column, path: str) -> Column:
    """STRUCT<value, bad>: a token count; booleans, text, fractions and negative integers are bad."""
    kind = F.coalesce(vtype(v, path), F.lit("VOID"))
    number = F.try_variant_get(v, path, "double")
    whole = F.try_variant_get(v, path, "bigint")
    zero = F.lit(0).cast("bigint")
    floating = kind.isin("DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    ok = (kind == "VOID") | ((kind == "BIGINT") & (whole >= 0)) | (floating & (number == F.floor(number)))
    value = F.when(kind == "VOID", zero).when(kind == "BIGINT", whole).otherwise(number.cast("bigint"))
    return F.struct(F.when(ok, value).alias("value"), (~ok).alias("bad"))


def recorded_count(v: Column) -> Column:
    """First of the recorded-count keys that holds a non-negative integer; booleans do not count."""
    tries = []
    for key in fixed.RECORDED_TOKEN_KEYS:
        path = f"$.{key}"
        whole = F.try_variant_get(v, path, "bigint")
        tries.append(F.when((vtype(v, path) == "BIGINT") & (whole >= 0), whole))
    return F.coalesce(*tries)


# --- images ---------------------------------------------------------------------------------

def plain_model(model: Column) -> Column:
    """Lower case, without a bracketed context and without a trailing date."""
    low = F.substring_index(F.lower(F.trim(model)), "[", 1)
    return F.regexp_replace(low, r"-\d{8}$", "")


def image_cap(model: Column, caps: dict[str, int] | None = None) -> Column:
    name = plain_model(model)
    table = fixed.IMAGE_CAPS | (caps or {})
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[name].cast("bigint")


def image_tokens(width: Column, height: Column, cap: Column) -> Column:
    raw = F.ceil(width * height / F.lit(fixed.PIXELS_PER_IMAGE_TOKEN)).cast("bigint")
    return F.least(raw, cap)


def sized_images(blobs: DataFrame, keys: Sequence[str], model: str, caps: dict[str, int] | None = None) -> DataFrame:
    """One size per image block (decoded, width, height); an unknown model or an unreadable image withholds it."""
    measured = blobs.withColumn("cap", image_cap(F.col(model), caps))
    tokens = image_tokens(F.col("width"), F.col("height"), F.col("cap"))
    why = (
        F.when(~F.col("decoded"), "the image payload could not be decoded, so it cannot be sized")
        .when(F.col("width").isNull(), "pixel dimensions are not readable from the header")
        .when(F.col("cap").isNull(), "no per-image token cap for the model")
    )
    size_text = F.concat(
        F.lit("image "), F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"), F.lit("px")
    )
    q = F.when(why.isNull(), quantity(tokens, "measured", "medium", size_text)).otherwise(withheld(why))
    return measured.select(*keys, "width", "height", q.alias("q"))


# --- the ladder -----------------------------------------------------------------------------


def read_result(payload: Column, text_length: Column) -> Column:
    lines, total = F.try_variant_get(payload, "$.file.numLines", "bigint"), F.try_variant_get(payload, "$.file.totalLines", "bigint")
    whole = F.when(lines >= total, "whole file").otherwise("PARTIAL read")
    tail = F.coalesce(
        F.when(
            lines.isNotNull() & total.isNotNull(),
            F.concat(F.lit("; "), lines.cast("string"), F.lit(" of "), total.cast("string"), F.lit(" lines ("), whole, F.lit(")")),
        ),
        F.when(lines.isNotNull(), F.concat(F.lit("; "), lines.cast("string"), F.lit(" lines read, total unknown"))),
        F.lit(""),
    )
    content = F.try_variant_get(payload, "$.file.content", "string")
    is_text = vtype(payload, "$.file.content") == "STRING"
    path = F.coalesce(vstr(payload, "$.file.filePath"), F.lit("a Read"))
    return (
        F.when(is_text, estimate(F.length(content), F.concat(F.lit("file.content of "), path), tail))
        .when(
            text_length > 0,
            estimate(text_length, F.lit("the rendered Read result"), F.concat(F.lit("; file.content absent from the payload"), tail)),
        )
        .otherwise(withheld(F.concat(F.lit("Read result carries neither file.content nor rendered text"), tail)))
    )


def shell_result(payload: Column) -> Column:
    def chars(path: str) -> Column:
        return F.when(vtype(payload, path) == "STRING", F.length(F.try_variant_get(payload, path, "string"))).otherwise(0)

    def says(path: str, text: str) -> Column:
        return F.when(F.try_variant_get(payload, path, "boolean"), text)

    notes = F.concat_ws(", ", says("$.interrupted", "interrupted"), says("$.noOutputExpected", "no output expected"))
    tail = F.when(notes != "", F.concat(F.lit(" ("), notes, F.lit(")"))).otherwise("")
    return estimate(chars("$.stdout") + chars("$.stderr"), F.lit("shell stdout + stderr"), tail)


def ladder(payload: Column, walked: Column, tool: Column, text_length: Column) -> Column:
    """Size of a payload without image blocks, by its shape."""
    name = F.coalesce(tool, F.lit("tool"))
    rendered = estimate(text_length, F.concat(F.lit("the rendered "), name, F.lit(" result")))
    nothing = quantity(F.lit(0), "estimated", "low", F.concat(F.lit("no content observed in the "), name, F.lit(" result")))
    fallback = F.when(text_length > 0, rendered).otherwise(nothing)
    generic = (
        F.when(walked["text_chars"] > 0, estimate(walked["text_chars"], F.concat(name, F.lit(" result text fields"))))
        .when(text_length > 0, rendered)
        .otherwise(estimate(walked["json_chars"], F.concat(F.lit("the serialised "), name, F.lit(" result payload"))))
    )
    count = recorded_count(payload)
    kind = F.coalesce(vtype(payload), F.lit("VOID"))
    has_shell = vtype(payload, "$.stdout").isNotNull() | vtype(payload, "$.stderr").isNotNull()
    flagged = F.coalesce(F.try_variant_get(payload, "$.isImage", "boolean"), F.lit(False))
    return (
        F.when(
            count.isNotNull(),
            quantity(count, "exact", "high", F.concat(F.lit("count recorded in the tool result ("), count.cast("string"), F.lit(" tokens)"))),
        )
        .when(
            flagged,
            withheld(F.lit("the result is marked as an image but carries no decodable image payload, and an image must "
                           "never be sized from its character count")),
        )
        .when(kind == "STRING", estimate(F.length(F.try_variant_get(payload, "$", "string")), F.lit("bare-string tool result")))
        .when(is_object(payload, "$.file"), read_result(payload, text_length))
        .when(kind.startswith("OBJECT") & has_shell, shell_result(payload))
        .when(kind.startswith("OBJECT"), generic)
        .when(
            kind.startswith("ARRAY") & (walked["text_chars"] > 0),
            estimate(walked["text_chars"], F.concat(name, F.lit(" result content"))),
        )
        .otherwise(fallback)
    )


def tool_result_sizes(results: DataFrame, keys: Sequence[str], model: str, caps: dict[str, int] | None = None) -> DataFrame:
    """Sizes of tool results: the payload first, the message content where it is withheld.

    Image blocks leave the row, are sized one by one, and come back combined with the text
    beside them; a recorded count needs none of this.
    """
    keys = list(keys)

    def one(column: str, walked: str) -> DataFrame:
        rows = results.withColumn("w", F.col(walked)).filter(
            (F.size("w.images") > 0) & recorded_count(F.col(column)).isNull()
        )
        blobs = rows.select(*keys, F.col(model).alias("model"), F.explode("w.images").alias("i")).select(*keys, "model", "i.*")
        sized = sized_images(blobs, keys, "model", caps).select(*keys, "q.tokens", "q.basis", "q.confidence")
        texts = rows.filter("w.text_chars > 0").select(
            *keys, char_tokens(F.col("w.text_chars")).alias("tokens"), F.lit("estimated").alias("basis"), F.lit("low").alias("confidence")
        )
        return combine(sized.unionByName(texts), keys)

    pictured = one("payload", "payload_walk").select(*keys, F.struct("tokens", "basis", "confidence", F.lit("images").alias("method")).alias("pi"))
    in_content = one("content", "content_walk").select(*keys, F.struct("tokens", "basis", "confidence", F.lit("images").alias("method")).alias("ci"))
    tool, length = F.col("tool_name"), F.col("text_length")
    joined = results.join(pictured, keys, "left").join(in_content, keys, "left")
    first = F.coalesce("pi", ladder(F.col("payload"), F.col("payload_walk"), tool, length))
    second = F.coalesce("ci", ladder(F.col("content"), F.col("content_walk"), tool, length))
    staged = joined.withColumns({"first": first, "second": second})
    use_second = F.col("first.tokens").isNull() & F.col("content").isNotNull() & F.col("second.tokens").isNotNull()
    return staged.withColumn("q", F.when(use_second, F.col("second")).otherwise(F.col("first"))).drop("first", "second", "pi", "ci")


def attachment_size(kind: Column, text_length: Column, added_lines: Column) -> Column:
    schema = added_lines * fixed.TOKENS_PER_SCHEMA_LINE
    return (
        F.when(text_length > 0, estimate(text_length, F.concat(kind, F.lit(" attachment"))))
        .when(
            added_lines > 0,
            quantity(
                schema, "estimated", "low",
                F.concat(
                    added_lines.cast("string"), F.lit(f" schema lines x {fixed.TOKENS_PER_SCHEMA_LINE} tokens/line "
                                                       "(declared estimate: no published lines-to-tokens rate exists)"),
                ),
            ),
        )
        .otherwise(quantity(F.lit(None), "estimated", "low", F.concat(kind, F.lit(" attachment carries no measurable size"))))
    )


def walked(v: Column) -> Column:
    """The nested walk of a VARIANT, skipped (NULL text) where there is nothing nested."""
    nested = vtype(v).startswith("OBJECT") | vtype(v).startswith("ARRAY")
    return walk(F.when(nested, F.to_json(v)))
