"""Text queries on documents: sizes, titles, note templates and copies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfold.catalog.registry import query, table
from tallyfold.operators import report, sizing
from tallyfold.operators import turns as tn
from tallyfold.sources import logs


def docs(spark, sf):
    return table(spark, sf, "documents")


def lines(spark, sf):
    """Every line of every document with its position."""
    return docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "note")).filter("note <> ''")


@query("p15_char_estimate", "SELECT doc_id, length(text) // 4 AS tokens FROM documents")
def p15(spark, sf):
    return docs(spark, sf).select("doc_id", sizing.char_tokens(F.length("text")).alias("tokens"))


LINES = """
WITH ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS note, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
l2 AS (SELECT * FROM ln WHERE note <> '')
"""


@query("a24_note_template_collapse", LINES + """
, d AS (SELECT note, min(doc_id * 100000 + pos) AS at0 FROM l2 GROUP BY 1),
t AS (SELECT *, regexp_replace(regexp_replace(note, '\\d[\\d,.]*', '#', 'g'), '#(?:[,\\s]+#)+', '#', 'g') AS template FROM d)
SELECT sha256(template) AS template, count(*) AS n, sha256(CASE WHEN count(*) = 1 THEN arg_min(note, at0) ELSE arg_min(note, at0) || ' (and ' || (count(*) - 1) || ' more session(s) with the same limitation, differing only in the figures)' END) AS note FROM t GROUP BY t.template""")
def a24(spark, sf):
    notes = lines(spark, sf).withColumn("pos", F.struct("doc_id", "at"))
    return report.collapse_notes(notes, "pos").select(
        F.sha2("template", 256).alias("template"), "n", F.sha2("note", 256).alias("note")
    )


@query("f22_order_preserving_distinct", LINES + """
SELECT min(p).doc_id AS first_doc, min(p).pos AS first_line, sha256(note) AS note
FROM (SELECT note, {'doc_id': doc_id, 'pos': CAST(pos AS BIGINT)} AS p FROM l2) GROUP BY note""")
def f22(spark, sf):
    first = lines(spark, sf).groupBy("note").agg(F.min(F.struct("doc_id", "at")).alias("first"))
    return first.select(
        F.col("first.doc_id").alias("first_doc"), (F.col("first.at") + 1).cast("bigint").alias("first_line"), F.sha2("note", 256).alias("note")
    )


@query("a1_document_copies", "SELECT min(doc_id) AS doc_id, count(*) AS copies, sha256(text) AS digest FROM documents GROUP BY text")
def a1(spark, sf):
    """First copy of each text; copies fold by a digest of the whole text before the shuffle."""
    hashed = docs(spark, sf).select("doc_id", F.sha2("text", 256).alias("digest"))
    first = tn.first_wins(hashed, ["digest"], ["doc_id"], [])
    counted = hashed.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"))
    return first.join(counted, "digest", "inner")


@query("s13_session_title", """
WITH t AS (SELECT source, arg_max(trim(regexp_replace(text, '\\s+', ' ', 'g')), doc_id) AS title FROM documents WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '' GROUP BY 1)
SELECT source, CASE WHEN length(title) <= 60 THEN title ELSE regexp_replace(substr(title, 1, 60), ' [^ ]*$', '') || '…' END AS title FROM t""")
def s13(spark, sf):
    """The last title of each source wins; it is clipped on a word boundary."""
    return logs.last_titles(docs(spark, sf), "source", "text", "doc_id")


@query("f7_session_display_name", """
WITH t AS (SELECT source, arg_max(trim(regexp_replace(text, '\\s+', ' ', 'g')), doc_id) AS title FROM documents WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '' GROUP BY 1)
SELECT source, CASE WHEN length(title) <= 60 THEN title ELSE regexp_replace(substr(title, 1, 60), ' [^ ]*$', '') || '…' END || ' (' || substr(sha256(source), 1, 8) || ')' AS name FROM t""")
def f7(spark, sf):
    titled = logs.last_titles(docs(spark, sf), "source", "text", "doc_id")
    return titled.select("source", logs.display_name(F.sha2("source", 256), F.col("title")).alias("name"))


@query("f8_id_summaries", """
WITH g AS (SELECT lang, list(DISTINCT source ORDER BY source) AS ids FROM documents GROUP BY 1)
SELECT lang, CASE WHEN len(ids) <= 6 THEN array_to_string(ids, ', ') ELSE len(ids) || ' sessions (' || array_to_string(ids[1:6], ', ') || ', and ' || (len(ids) - 6) || ' more)' END AS ids,
CASE WHEN len(ids) <= 6 THEN array_to_string(ids, ', ') ELSE len(ids) || ' versions from ' || ids[1] || ' to ' || ids[-1] END AS versions FROM g""")
def f8(spark, sf):
    return logs.id_summaries(docs(spark, sf), "lang", "source")
