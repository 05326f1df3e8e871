"""Descriptions of prefix changes, from the names a delta lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyfold.functions import fixed


def mcp_server(tool: Column) -> Column:
    """Server part of mcp__server__tool; NULL when the name has no server."""
    server = F.regexp_extract(tool, "^mcp__(.+?)__", 1)
    return F.when(server != "", server)


def describe_names(names: Column, verb: str) -> Column:
    """Servers with their tool counts in order, then up to three plain tools; NULL for no names."""
    servers = F.transform(F.filter(names, lambda n: mcp_server(n).isNotNull()), mcp_server)
    plain = F.array_sort(F.filter(names, lambda n: mcp_server(n).isNull()))
    per_server = F.transform(
        F.array_sort(F.array_distinct(servers)),
        lambda s: F.concat(
            F.lit("MCP server '"), s, F.lit(f"' {verb} ("),
            F.size(F.filter(servers, lambda o: o == s)).cast("string"),
            F.when(F.size(F.filter(servers, lambda o: o == s)) == 1, " tool)").otherwise(" tools)"),
        ),
    )
    shown = F.array_join(F.slice(plain, 1, fixed.NAMES_SHOWN), ", ")
    extra = F.size(plain) - fixed.NAMES_SHOWN
    shown = F.when(extra > 0, F.concat(shown, F.lit(" +"), extra.cast("string"), F.lit(" more"))).otherwise(shown)
    loose = F.concat(
        F.when(F.size(plain) == 1, f"tool {verb}: ").otherwise(f"tools {verb}: "), shown
    )
    texts = F.concat(per_server, F.when(F.size(plain) > 0, F.array(loose)).otherwise(F.array().cast("array<string>")))
    return F.when(F.size(names) > 0, F.array_join(texts, "; "))


def describe_tool_change(added: Column, removed: Column) -> Column:
    """NULL when nothing was added or removed."""
    text = F.concat_ws("; ", describe_names(added, "added"), describe_names(removed, "removed"))
    return F.when(text != "", text)


def describe_listing(names: Column) -> Column:
    shown = F.array_join(F.slice(F.array_sort(names), 1, fixed.NAMES_SHOWN), ", ")
    shown = F.when(F.size(names) > 0, shown).otherwise("unnamed")
    return F.concat(
        F.lit("skill listing changed ("), F.size(names).cast("string"), F.lit(" skills: "), shown, F.lit(")")
    )


def describe_edit(identity: Column, category: Column) -> Column:
    """Only documents and skills are part of the prompt prefix; other edits change nothing."""
    return F.when(
        category.isin("docs", "skill"), F.concat(F.lit("instruction file '"), identity, F.lit("' changed"))
    )


def invalidated_tiers(tier: Column) -> Column:
    """The tier and all tiers after it."""
    tiers = F.array(*[F.lit(t) for t in fixed.TIERS])
    at = F.array_position(tiers, tier).cast("int")
    return F.slice(tiers, at, F.lit(len(fixed.TIERS)))
