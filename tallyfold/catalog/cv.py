"""Size and anchor queries on conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfold.catalog.registry import query, table
from tallyfold.operators import anchors, sizing


def _computed(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id", F.col("role").alias("label")).agg(
        F.sum(sizing.char_tokens(F.length("text"))).alias("tokens")
    )


def _anchors(spark, sf):
    """Reported sizes: rounded to hundreds, in capitals on even conversations, one label missing."""
    c = F.col("conv_id")
    position = F.when(F.col("label") == "system", 0).when(F.col("label") == "user", 1).otherwise(2)
    return _computed(spark, sf).filter(~((c % 7 == 0) & (F.col("label") == "user"))).select(
        "conv_id", F.when(c % 2 == 0, F.upper("label")).otherwise(F.col("label")).alias("label"),
        (F.floor((F.col("tokens") + 50) / 100) * 100).cast("bigint").alias("tokens"),
        F.lit(100).cast("bigint").alias("step"), (c % 3 == 0).alias("approximate"), position.alias("position"),
    ).unionByName(
        table(spark, sf, "conversations").filter("turn = 0 AND conv_id % 11 = 0").select(
            "conv_id", F.lit("free space").alias("label"), F.lit(1000).cast("bigint").alias("tokens"),
            F.lit(100).cast("bigint").alias("step"), F.lit(False).alias("approximate"), F.lit(9).alias("position"),
        )
    )


ANCHOR_SQL = """
WITH c AS (SELECT conv_id, role AS label, CAST(sum(length(text) // 4) AS BIGINT) AS tokens FROM conversations GROUP BY ALL),
a AS (SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN upper(label) ELSE label END AS label, label AS low, (tokens + 50) // 100 * 100 AS tokens, conv_id % 3 = 0 AS approximate FROM c WHERE NOT (conv_id % 7 = 0 AND label = 'user')
 UNION ALL SELECT conv_id, 'free space', 'free space', 1000, FALSE FROM conversations WHERE turn = 0 AND conv_id % 11 = 0),
m AS (SELECT a.conv_id, a.label, CASE WHEN c.label IS NULL THEN 'anchor_only' ELSE 'matched' END AS status, a.tokens AS anchor_tokens, c.tokens AS computed_tokens, c.tokens - a.tokens AS delta,
 CASE WHEN c.label IS NOT NULL THEN CAST(greatest(ceil(CAST(0.05 AS DOUBLE) * a.tokens), CASE WHEN approximate THEN greatest(50, ceil(CAST(0.1 AS DOUBLE) * a.tokens)) ELSE 50 END) AS BIGINT) END AS tolerance
 FROM a LEFT JOIN c ON c.conv_id = a.conv_id AND c.label = a.low
 UNION ALL SELECT c.conv_id, c.label, 'computed_only', NULL, c.tokens, NULL, NULL FROM c WHERE (c.conv_id, c.label) NOT IN (SELECT (conv_id, low) FROM a))
"""


@query("j7_anchor_reconciliation", ANCHOR_SQL + "SELECT conv_id, label, status, anchor_tokens, computed_tokens, delta FROM m")
def j7(spark, sf):
    return anchors.match(_anchors(spark, sf), _computed(spark, sf), "conv_id").select(
        "conv_id", "label", "status", "anchor_tokens", "computed_tokens", "delta"
    )


@query("m19_anchor_tolerance", ANCHOR_SQL + """
SELECT conv_id, label, tolerance, CASE WHEN anchor_tokens = 0 THEN CASE WHEN delta = 0 THEN 0.0::DOUBLE ELSE 'inf'::DOUBLE END ELSE CAST(delta AS DOUBLE) / anchor_tokens END AS relative_delta, abs(delta) <= tolerance AS agrees
FROM m WHERE status = 'matched'""")
def m19(spark, sf):
    return anchors.match(_anchors(spark, sf), _computed(spark, sf), "conv_id").filter("status = 'matched'").select(
        "conv_id", "label", "tolerance", "relative_delta", "agrees"
    )


@query("u5_unmatched_labels", ANCHOR_SQL + """
SELECT conv_id, count(*) FILTER (status = 'matched') AS matched, count(*) FILTER (status = 'anchor_only') AS anchor_only, count(*) FILTER (status = 'computed_only') AS computed_only,
 count(*) FILTER (abs(delta) > tolerance) AS disagreements, count(*) FILTER (abs(delta) > tolerance) = 0 AND count(*) FILTER (status = 'anchor_only') = 0 AS agrees FROM m GROUP BY 1""")
def u5(spark, sf):
    return anchors.agreement(anchors.match(_anchors(spark, sf), _computed(spark, sf), "conv_id"), "conv_id")


@query("p18_combine_quantities", """
SELECT conv_id, CASE WHEN bool_or(role = 'system' AND conv_id % 5 = 0) THEN NULL ELSE CAST(sum(length(text) // 4) AS BIGINT) END AS tokens,
 CASE WHEN bool_or(role = 'system' AND conv_id % 5 = 0) OR bool_or(role = 'user') THEN 'estimated' WHEN bool_or(role = 'assistant') THEN 'measured' ELSE 'exact' END AS basis,
 CASE WHEN bool_or(role = 'system' AND conv_id % 5 = 0) OR bool_or(role = 'user') THEN 'low' WHEN bool_or(role = 'assistant') THEN 'medium' ELSE 'high' END AS confidence
FROM conversations GROUP BY 1""")
def p18(spark, sf):
    role = F.col("role")
    withheld = (role == "system") & (F.col("conv_id") % 5 == 0)
    parts = table(spark, sf, "conversations").select(
        "conv_id", F.when(~withheld, sizing.char_tokens(F.length("text"))).alias("tokens"),
        F.when(role == "user", "estimated").when(role == "assistant", "measured").otherwise("exact").alias("basis"),
        F.when(role == "user", "low").when(role == "assistant", "medium").otherwise("high").alias("confidence"),
    )
    return sizing.combine(parts, ["conv_id"])
