"""Feed queries: parts are a provider's price list, suppliers the table in use."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfold.catalog.registry import query, table
from tallyfold.sources import feed as fd
from tallyfold.sources.rates import CacheMultipliers

SQL = """
WITH c AS (SELECT p_partkey AS p, CAST(round(p_retailprice * 100) AS BIGINT) AS c FROM part),
f AS (SELECT 'm-' || p AS model, 10 * c AS input_rate, 50 * c AS output_rate, CASE WHEN p % 13 = 0 THEN 15 * c WHEN p % 3 = 0 THEN NULL ELSE CAST(12.5 * c AS BIGINT) END AS write_rate,
 CASE WHEN p % 7 = 0 THEN 2 * c ELSE c END AS read_rate FROM c WHERE p % 5 <> 4 AND p % 11 <> 0 AND c % 2 = 0),
cur AS (SELECT 'm-' || p AS model, 10 * c + s_suppkey % 2 AS input_rate, 50 * c AS output_rate, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE CAST(512 AS BIGINT) END AS threshold
 FROM supplier JOIN c ON p = 3 * s_suppkey)
"""


def price_list(spark, sf):
    """Raw rows: some ids with a vendor before them, some of another provider, some without an output rate."""
    p, cents = F.col("p_partkey"), F.round(F.col("p_retailprice") * 100).cast("bigint")
    unit = F.lit("0.000000000001").cast("decimal(13,12)")

    def rate(times):
        return (times.cast("decimal(12,0)") * unit).cast("decimal(24,15)")

    raw = F.concat(F.when(p % 3 == 0, "vendor/").when(p % 3 == 1, "eu.vendor.").otherwise(""), F.lit("m-"), p.cast("string"))
    write = F.when(p % 13 == 0, 15 * cents).when(p % 3 != 0, (cents * 25 / 2).cast("bigint"))
    return table(spark, sf, "part").filter(cents % 2 == 0).select(
        raw.alias("raw_id"), F.when(p % 5 == 4, "other").otherwise("vendor").alias("provider"), rate(10 * cents).alias("input_per_token"),
        F.when(p % 11 != 0, rate(50 * cents)).alias("output_per_token"), rate(write).alias("write_per_token"),
        rate(F.when(p % 7 == 0, 2 * cents).otherwise(cents)).alias("read_per_token"),
    )


def in_use(spark, sf):
    cents = F.round(F.col("p_retailprice") * 100).cast("bigint")
    s = F.col("s_suppkey")
    return table(spark, sf, "supplier").join(table(spark, sf, "part"), F.col("p_partkey") == 3 * s).select(
        F.concat(F.lit("m-"), F.col("p_partkey").cast("string")).alias("model"), (10 * cents + s % 2).alias("input_rate"),
        (50 * cents).alias("output_rate"), F.when(s % 4 != 0, 512).cast("bigint").alias("threshold"),
    )


@query("f19_per_million_rates", SQL + "SELECT * FROM f")
def f19(spark, sf):
    return fd.fetched(price_list(spark, sf), "vendor")


@query("s15_feed_merge", SQL + """
SELECT coalesce(f.model, cur.model) AS model, coalesce(f.input_rate, cur.input_rate) AS input_rate, coalesce(f.output_rate, cur.output_rate) AS output_rate, threshold,
 CASE WHEN f.model IS NULL THEN 'missing' WHEN cur.model IS NULL THEN 'added' WHEN f.input_rate = cur.input_rate AND f.output_rate = cur.output_rate THEN 'unchanged' ELSE 'updated' END AS status,
 cur.model IS NULL AS needs_threshold FROM f FULL OUTER JOIN cur ON f.model = cur.model""")
def s15(spark, sf):
    return fd.merged(fd.fetched(price_list(spark, sf), "vendor"), in_use(spark, sf))


@query("s16_multiplier_drift", SQL + """
SELECT model, kind, implied, configured FROM (
 SELECT model, 'read' AS kind, CAST(round(1000.0 * read_rate / f.input_rate) AS BIGINT) AS implied, CAST(100 AS BIGINT) AS configured FROM f SEMI JOIN cur USING (model)
 UNION ALL SELECT model, 'write_5m', CAST(round(1000.0 * write_rate / f.input_rate) AS BIGINT), 1250 FROM f SEMI JOIN cur USING (model) WHERE write_rate IS NOT NULL) WHERE implied <> configured""")
def s16(spark, sf):
    cache = CacheMultipliers()
    return fd.drift(fd.fetched(price_list(spark, sf), "vendor"), in_use(spark, sf), cache.read, cache.write_5m)
