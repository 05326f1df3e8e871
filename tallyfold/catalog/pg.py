"""Path queries on pages: parts, categories, identities, projects and the folder tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfold.catalog.registry import query, table
from tallyfold.functions import paths
from tallyfold.operators import projects
from tallyfold.operators import rollups as ro

PATHS = """
WITH pg AS (SELECT page_id, '/' || rtrim(regexp_extract(url, '^https?://([^?#]*)', 1), '/') AS path, length(html) AS chars, html FROM pages),
pp AS (SELECT *, string_split(substr(path, 2), '/') AS seg FROM pg),
px AS (SELECT *, seg[-1] AS name, regexp_extract(seg[-1], '^.+([.][^.]+)$', 1) AS suffix, seg[1] AS host, seg[2] AS lang, seg[3] AS num FROM pp)
"""


def page_paths(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id",
        F.concat(F.lit("/"), F.rtrim(F.regexp_extract("url", "^https?://([^?#]*)", 1), F.lit("/"))).alias("path"),
        F.length("html").cast("bigint").alias("chars"),
    )


@query("f6_path_parts", PATHS + """
SELECT page_id, name, suffix, CASE WHEN len(seg) = 1 THEN '/' ELSE regexp_replace(path, '/[^/]*$', '') END AS parent, CAST(len(seg) AS BIGINT) AS depth FROM px""")
def f6(spark, sf):
    p = F.col("path")
    return page_paths(spark, sf).select(
        "page_id", paths.name(p).alias("name"), paths.suffix(p).alias("suffix"), paths.parent(p).alias("parent"),
        F.size(paths.parts(p)).cast("bigint").alias("depth"),
    )


RENAMED_SQL = PATHS + """
, rn AS (SELECT *, CASE page_id % 9 WHEN 0 THEN path || '/CLAUDE.md' WHEN 1 THEN path || '/skills/a/b.txt' WHEN 2 THEN path || '/specs/plan.py' WHEN 3 THEN path || '/m.TSX'
 WHEN 4 THEN path || '/notes.RST' WHEN 5 THEN path || '/SKILL.md' WHEN 6 THEN path || '/.specify/x' WHEN 7 THEN path || '/a.tar.gz' ELSE path || '/.bashrc' END AS identity,
 CASE WHEN page_id % 11 = 0 THEN 'tool_schema' WHEN page_id % 11 = 1 THEN 'skill' WHEN page_id % 11 = 2 THEN 'system_prompt' WHEN page_id % 11 = 3 THEN 'conversation' ELSE 'file' END AS kind FROM px)
"""


def _renamed(spark, sf):
    i, p = F.col("page_id"), F.col("path")
    tails = ["/CLAUDE.md", "/skills/a/b.txt", "/specs/plan.py", "/m.TSX", "/notes.RST", "/SKILL.md", "/.specify/x", "/a.tar.gz"]
    tail = F.lit("/.bashrc")
    for n, t in enumerate(tails):
        tail = F.when(i % 9 == n, t).otherwise(tail)
    kind = (
        F.when(i % 11 == 0, "tool_schema").when(i % 11 == 1, "skill").when(i % 11 == 2, "system_prompt")
        .when(i % 11 == 3, "conversation").otherwise("file")
    )
    return page_paths(spark, sf).select("page_id", "chars", F.concat(p, tail).alias("identity"), kind.alias("kind"))


@query("p9_category_rules", RENAMED_SQL + """
SELECT page_id, CASE WHEN kind = 'tool_schema' THEN 'schema' WHEN kind = 'skill' THEN 'skill' WHEN kind = 'system_prompt' THEN 'docs' WHEN kind = 'conversation' THEN 'other'
 ELSE CASE page_id % 9 WHEN 0 THEN 'docs' WHEN 1 THEN 'skill' WHEN 2 THEN 'spec' WHEN 3 THEN 'source' WHEN 4 THEN 'docs' WHEN 5 THEN 'skill' WHEN 6 THEN 'spec' ELSE 'other' END END AS category,
CASE WHEN kind = 'tool_schema' THEN 'item kind is tool_schema' WHEN kind = 'skill' THEN 'item kind is skill' WHEN kind = 'system_prompt' THEN 'the base instructions are instruction content'
 WHEN kind = 'conversation' THEN 'conversation content is not a file' ELSE CASE page_id % 9 WHEN 0 THEN 'CLAUDE.md is an instruction file' WHEN 1 THEN 'path is inside a skills directory'
 WHEN 2 THEN 'path is inside a specs directory' WHEN 3 THEN '.tsx is a source extension' WHEN 4 THEN '.rst is a documentation extension' WHEN 5 THEN 'path is inside a skills directory'
 WHEN 6 THEN 'path is inside a specs directory' ELSE 'no category rule matched' END END AS reason FROM rn""")
def p9(spark, sf):
    return _renamed(spark, sf).select("page_id", paths.category_rule(F.col("identity"), F.col("kind")).alias("c")).select("page_id", "c.*")


IDENT_SQL = PATHS + """
, idn AS (SELECT *, CASE page_id % 4 WHEN 0 THEN path WHEN 1 THEN '../' || lang || '/' || num WHEN 2 THEN './a//' || lang || '/../' || num ELSE 'C:\\' || num END AS raw,
 CASE WHEN page_id % 5 <> 0 THEN '/' || host END AS cwd, CASE WHEN page_id % 3 <> 0 THEN '/proj/p' || (page_id % 3) END AS project FROM px),
idx AS (SELECT *, coalesce(cwd, project) AS base FROM idn),
idy AS (SELECT *, CASE WHEN page_id % 4 IN (0, 3) OR base IS NULL THEN raw WHEN page_id % 4 = 1 THEN CASE WHEN cwd IS NOT NULL THEN '/' || lang || '/' || num ELSE '/proj/' || lang || '/' || num END
 ELSE base || '/a/' || num END AS identity FROM idx)
"""


def _identities(spark, sf):
    i, p = F.col("page_id"), F.col("path")
    seg = paths.parts(p)
    lang, num = F.element_at(seg, 2), F.element_at(seg, 3)
    raw = (
        F.when(i % 4 == 0, p).when(i % 4 == 1, F.concat(F.lit("../"), lang, F.lit("/"), num))
        .when(i % 4 == 2, F.concat(F.lit("./a//"), lang, F.lit("/../"), num)).otherwise(F.concat(F.lit("C:\\"), num))
    )
    return page_paths(spark, sf).select(
        "page_id", raw.alias("raw"), F.when(i % 5 != 0, F.concat(F.lit("/"), F.element_at(seg, 1))).alias("cwd"),
        F.when(i % 3 != 0, F.concat(F.lit("/proj/p"), (i % 3).cast("string"))).alias("project"),
    )


@query("p10_absolute_identity", IDENT_SQL + "SELECT page_id, identity FROM idy")
def p10(spark, sf):
    return _identities(spark, sf).select(
        "page_id", paths.absolute_identity(F.col("raw"), F.lit("file"), F.col("cwd"), F.col("project")).alias("identity")
    )


@query("p11_scoped_item_id", IDENT_SQL + """
SELECT page_id, CASE WHEN identity LIKE '/%' OR identity LIKE 'C:%' THEN 'file:' || identity ELSE 'file:' || coalesce(project, '-') || ':' || identity END AS item_id FROM idy""")
def p11(spark, sf):
    identity = paths.absolute_identity(F.col("raw"), F.lit("file"), F.col("cwd"), F.col("project"))
    return _identities(spark, sf).select("page_id", paths.item_id(identity, F.lit("file"), F.col("project")).alias("item_id"))


@query("p2_nearest_ancestor_project", PATHS + """
, pr AS (SELECT DISTINCT '/' || host AS project FROM px WHERE page_id % 3 = 0 UNION SELECT DISTINCT '/' || host || '/' || lang FROM px WHERE page_id % 4 = 0)
SELECT page_id, path, CASE WHEN '/' || host || '/' || lang IN (SELECT project FROM pr) THEN '/' || host || '/' || lang WHEN '/' || host IN (SELECT project FROM pr) THEN '/' || host END AS project FROM px""")
def p2(spark, sf):
    rows = page_paths(spark, sf).select("page_id", "path")
    up = paths.ancestors(F.col("path"))
    known = rows.filter("page_id % 3 = 0").select(F.element_at(up, 1).alias("project")).unionByName(
        rows.filter("page_id % 4 = 0").select(F.element_at(up, 2).alias("project"))
    )
    return projects.nearest_project(rows, "page_id", "path", known.distinct())


@query("p25_project_dir_encode", PATHS + "SELECT page_id, regexp_replace(path, '[^a-zA-Z0-9]', '-', 'g') AS encoded FROM px")
def p25(spark, sf):
    return page_paths(spark, sf).select("page_id", paths.encode_project(F.col("path")).alias("encoded"))


@query("p26_project_dir_decode", PATHS + """
, dir AS (SELECT DISTINCT d FROM (SELECT '/' || host || '/' || lang AS d FROM px UNION ALL SELECT replace('/' || host || '/' || lang, '.', '-') FROM px WHERE page_id % 7 = 0)),
en AS (SELECT regexp_replace(d, '[^a-zA-Z0-9]', '-', 'g') AS encoded, count(*) AS candidates, min(d) AS only_one FROM dir GROUP BY 1)
SELECT n.encoded, coalesce(candidates, 0) AS candidates, CASE WHEN candidates = 1 THEN only_one END AS directory FROM (
SELECT DISTINCT regexp_replace('/' || host || '/' || lang || CASE WHEN page_id % 13 = 0 THEN '/gone' ELSE '' END, '[^a-zA-Z0-9]', '-', 'g') AS encoded FROM px) n LEFT JOIN en ON en.encoded = n.encoded""")
def p26(spark, sf):
    rows = page_paths(spark, sf)
    directory = F.element_at(paths.ancestors(F.col("path")), 2)
    known = rows.select(directory.alias("directory")).unionByName(
        rows.filter("page_id % 7 = 0").select(F.replace(directory, F.lit("."), F.lit("-")).alias("directory"))
    )
    asked = F.concat(directory, F.when(F.col("page_id") % 13 == 0, "/gone").otherwise(""))
    return projects.decode_projects(rows.select(paths.encode_project(asked).alias("encoded")).distinct(), known)


@query("p22_pseudonymise_paths", PATHS + "SELECT page_id, 'redacted-' || substr(sha256('file:' || path), 1, 8) || suffix AS display FROM px")
def p22(spark, sf):
    p = F.col("path")
    return page_paths(spark, sf).select(
        "page_id", paths.display(F.concat(F.lit("file:"), p), p, redact=True).alias("display")
    )


@query("p23_redact_paths_in_text", PATHS + """
, tok AS (SELECT page_id, regexp_extract_all(html, '[\\s''"]+|[^\\s''"]+') AS ts FROM px)
SELECT page_id, sha256(array_to_string(list_transform(ts, lambda t: CASE WHEN contains(t, '/') THEN 'redacted-' || substr(sha256(t), 1, 8) ||
 regexp_extract(coalesce(list_filter(string_split(t, '/'), lambda s: s <> '' AND s <> '.')[-1], ''), '^.+([.][^.]+)$', 1) ELSE t END), '')) AS digest FROM tok""")
def p23(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", F.sha2(paths.redact_text(F.col("html")), 256).alias("digest")
    )


@query("a12_pages_by_folder", PATHS + """
SELECT CASE WHEN len(seg) = 1 THEN '(file)' ELSE regexp_replace(path, '/[^/]*$', '') END AS group_key, count(*) AS members, CAST(sum(chars) AS BIGINT) AS total_micros FROM px GROUP BY 1""")
def a12(spark, sf):
    rows = page_paths(spark, sf).select(F.lit("file").alias("kind"), F.col("path").alias("identity"), F.col("chars").alias("total_micros"))
    return rows.groupBy(ro.group_key("folder").alias("group_key")).agg(
        F.count(F.lit(1)).alias("members"), F.sum("total_micros").alias("total_micros")
    )


@query("a15_pages_tree", PATHS + """
SELECT '/' || host AS path, CAST(1 AS BIGINT) AS depth, CAST(sum(chars) AS BIGINT) AS total_micros, count(*) AS items FROM px GROUP BY ALL
UNION ALL SELECT '/' || host || '/' || lang, 2, CAST(sum(chars) AS BIGINT), count(*) FROM px GROUP BY ALL""")
def a15(spark, sf):
    leaves = page_paths(spark, sf).select(F.col("path").alias("identity"), F.col("chars").alias("total_micros"))
    return ro.directories(leaves)


@query("a16_chain_compression", PATHS + """
, h AS (SELECT host, count(DISTINCT lang) AS langs, sum(chars) AS t FROM px GROUP BY 1), hl AS (SELECT host, lang, sum(chars) AS t FROM px GROUP BY ALL)
SELECT '/' || host AS path, '/' AS parent, host AS name, CAST(t AS BIGINT) AS total_micros FROM h WHERE langs > 1
UNION ALL SELECT '/' || host || '/' || lang, CASE WHEN langs > 1 THEN '/' || host ELSE '/' END, CASE WHEN langs > 1 THEN lang ELSE host || '/' || lang END, CAST(hl.t AS BIGINT) FROM hl JOIN h USING (host)""")
def a16(spark, sf):
    leaves = page_paths(spark, sf).select(F.col("path").alias("identity"), F.col("chars").alias("total_micros"))
    return ro.compressed_directories(leaves)
