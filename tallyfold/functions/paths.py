"""Path parts, categories, identities and pseudonyms as Column expressions (POSIX rules)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyfold.functions import fixed

SUFFIX = r"^.+([.][^.]+)$"


def parts(path: Column) -> Column:
    """Segments with empty and '.' ones removed; a leading root is not a segment here."""
    return F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))


def is_rooted(path: Column) -> Column:
    return path.startswith("/")


def name(path: Column) -> Column:
    return F.coalesce(F.try_element_at(parts(path), F.lit(-1)), F.lit(""))


def suffix(path: Column) -> Column:
    """Last dot and what follows, if at least one character stands on each side."""
    return F.regexp_extract(name(path), SUFFIX, 1)


def parent(path: Column) -> Column:
    """Directory part; '.' for a bare name and '/' directly under the root."""
    segments = parts(path)
    head = F.array_join(F.slice(segments, F.lit(1), F.greatest(F.size(segments) - 1, F.lit(0))), "/")
    return F.when(is_rooted(path), F.concat(F.lit("/"), head)).otherwise(
        F.when(head == "", ".").otherwise(head)
    )


def category_rule(identity: Column, kind: Column) -> Column:
    """STRUCT<category, reason>: the first rule that holds."""
    base = name(identity)
    lowered = F.lower(base)
    lower_parts = F.transform(parts(identity), lambda s: F.lower(s))
    ext = F.lower(suffix(identity))

    def says(category: str, reason: Column) -> Column:
        return F.struct(F.lit(category).alias("category"), reason.alias("reason"))

    return (
        F.when(kind.isin("tool_schema", "mcp_schema"), says("schema", F.concat(F.lit("item kind is "), kind)))
        .when(kind == "skill", says("skill", F.lit("item kind is skill")))
        .when(
            kind == "system_prompt",
            says("docs", F.lit("the base instructions are instruction content")),
        )
        .when(kind == "conversation", says("other", F.lit("conversation content is not a file")))
        .when(
            lowered.isin(*fixed.INSTRUCTION_NAMES),
            says("docs", F.concat(base, F.lit(" is an instruction file"))),
        )
        .when(
            F.array_contains(lower_parts, "skills") | (lowered == "skill.md"),
            says("skill", F.lit("path is inside a skills directory")),
        )
        .when(
            F.array_contains(lower_parts, "specs") | F.array_contains(lower_parts, ".specify"),
            says("spec", F.lit("path is inside a specs directory")),
        )
        .when(
            ext.isin(*fixed.SOURCE_SUFFIXES),
            says("source", F.concat(ext, F.lit(" is a source extension"))),
        )
        .when(
            ext.isin(*fixed.DOC_SUFFIXES),
            says("docs", F.concat(ext, F.lit(" is a documentation extension"))),
        )
        .otherwise(says("other", F.lit("no category rule matched")))
    )


def category(identity: Column, kind: Column) -> Column:
    """The category of ``category_rule`` alone: the path is lowered and cut once, not again for each rule."""

    def rule(segments: Column) -> Column:
        base = F.coalesce(F.try_element_at(segments, F.lit(-1)), F.lit(""))
        ext = F.regexp_extract(base, SUFFIX, 1)
        return (
            F.when(kind.isin("tool_schema", "mcp_schema"), "schema")
            .when(kind == "skill", "skill")
            .when(kind == "system_prompt", "docs")
            .when(kind == "conversation", "other")
            .when(base.isin(*fixed.INSTRUCTION_NAMES), "docs")
            .when(F.array_contains(segments, "skills") | (base == "skill.md"), "skill")
            .when(F.array_contains(segments, "specs") | F.array_contains(segments, ".specify"), "spec")
            .when(ext.isin(*fixed.SOURCE_SUFFIXES), "source")
            .when(ext.isin(*fixed.DOC_SUFFIXES), "docs")
            .otherwise("other")
        )

    return F.element_at(F.transform(F.array(parts(F.lower(identity))), rule), 1)


def is_absolute(path: Column) -> Column:
    return path.startswith("/") | path.startswith("\\") | ((F.length(path) > 2) & (F.substring(path, 2, 1) == ":"))


def _fold_dots(path: Column) -> Column:
    """Lexical removal of '.', '' and 'x/..' from a path."""
    rooted = is_rooted(path)
    empty = F.array().cast("array<string>")

    def step(acc: Column, seg: Column) -> Column:
        popped = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        stuck = (F.size(acc) == 0) | (F.try_element_at(acc, F.lit(-1)) == "..")
        return (
            F.when((seg == "") | (seg == "."), acc)
            .when((seg == "..") & ~stuck, popped)
            .when((seg == "..") & rooted, acc)
            .otherwise(F.array_append(acc, seg))
        )

    joined = F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/")
    return F.when(rooted, F.concat(F.lit("/"), joined)).otherwise(
        F.when(joined == "", ".").otherwise(joined)
    )


def absolute_identity(identity: Column, kind: Column, cwd: Column, project: Column) -> Column:
    """A relative file path joined to its working directory, else to the project."""
    base = F.coalesce(F.nullif(cwd, F.lit("")), F.nullif(project, F.lit("")))
    joined = F.concat(F.rtrim(F.replace(base, F.lit("\\"), F.lit("/")), F.lit("/")), F.lit("/"), F.replace(identity, F.lit("\\"), F.lit("/")))
    keep = (kind != "file") | is_absolute(identity) | base.isNull()
    return F.when(keep, identity).otherwise(_fold_dots(joined))


def item_id(identity: Column, kind: Column, project: Column) -> Column:
    scope = F.coalesce(F.nullif(project, F.lit("")), F.lit("-"))
    return F.when(is_absolute(identity), F.concat_ws(":", kind, identity)).otherwise(
        F.concat_ws(":", kind, scope, identity)
    )


def encode_project(path: Column) -> Column:
    return F.regexp_replace(path, "[^a-zA-Z0-9]", "-")


def pseudonym(text: Column) -> Column:
    return F.concat(F.lit("redacted-"), F.substring(F.sha2(text, 256), 1, 8))


def injected_name(identity: Column) -> Column:
    """Plain name of an injected item, NULL for everything else."""
    out = F.lit(None).cast("string")
    for key, plain in fixed.INJECTED_NAMES.items():
        out = F.when(identity == key, plain).otherwise(out)
    return out


def display(item: Column, identity: Column, redact: bool = False, with_scope: bool = False) -> Column:
    plain = injected_name(identity)
    split = F.split(item, ":", 3)
    scope = F.when(
        F.size(split) == 3,
        F.when(split[1] == "-", "(project not recorded)").otherwise(split[1]),
    )
    if redact:
        other = F.concat(pseudonym(item), suffix(identity))
        scope = pseudonym(scope)
    else:
        other = identity
    named = plain
    if with_scope:
        named = F.when(scope.isNull(), plain).otherwise(F.concat(plain, F.lit(" — "), scope))
    return F.when(plain.isNotNull(), named).otherwise(other)


def redact_text(text: Column) -> Column:
    """Replace every run of non-space, non-quote characters holding a '/' by its pseudonym.

    The text is cut at spaces and quotes, the pieces with a '/' are replaced, and the cuts are
    put back; the separators are kept by cutting in front of and behind each of them.
    """
    tokens = F.split(text, r"(?<=[\s'\"])|(?=[\s'\"])")
    fixed_up = F.transform(
        tokens,
        lambda t: F.when(F.contains(t, F.lit("/")), F.concat(pseudonym(t), suffix(t))).otherwise(t),
    )
    return F.array_join(fixed_up, "")


def ancestors(path: Column) -> Column:
    """Every directory prefix of a rooted path from the outermost in, without the root itself."""
    segments = parts(path)
    depth = F.size(segments) - 1
    return F.when(
        depth >= 1,
        F.transform(
            F.sequence(F.lit(1), F.greatest(depth, F.lit(1))),
            lambda d: F.concat(F.lit("/"), F.array_join(F.slice(segments, F.lit(1), d), "/")),
        ),
    ).otherwise(F.array().cast("array<string>"))
