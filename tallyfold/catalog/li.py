"""Money queries on orders and lineitem: exact cost, allocation and display."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfold.catalog.ev_sql import cost
from tallyfold.catalog.registry import query, table
from tallyfold.functions import money
from tallyfold.operators import checks
from tallyfold.operators import rollups as ro


def _lines(spark, sf):
    return table(spark, sf, "lineitem")


@query("p6_exact_cost", f"""
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) * l_partkey AS tokens, CAST(round(l_extendedprice * 100) AS BIGINT) AS rate FROM lineitem)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, {cost('tokens', 'rate', 100000)} AS read_micros, {cost('tokens', 'rate', 1250000)} AS write_micros FROM x""")
def p6(spark, sf):
    tokens = F.col("l_quantity").cast("bigint") * F.col("l_partkey")
    rate = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return _lines(spark, sf).select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_partkey", "l_suppkey",
        money.cost_micros(tokens, rate, F.lit(100_000)).alias("read_micros"),
        money.cost_micros(tokens, rate, F.lit(1_250_000)).alias("write_micros"),
    )


ALLOC_SQL = """
WITH x AS (SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_returnflag, l.l_linestatus, CAST(l.l_quantity AS BIGINT) AS w, CAST(round(o.o_totalprice * 100) AS BIGINT) AS pool
 FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
y AS (SELECT *, CAST(pool AS HUGEINT) * w // sum(w) OVER p AS fl, CAST(pool AS HUGEINT) * w % sum(w) OVER p AS rm FROM x WINDOW p AS (PARTITION BY l_orderkey)),
z AS (SELECT *, pool - sum(fl) OVER (PARTITION BY l_orderkey) AS spare, row_number() OVER (PARTITION BY l_orderkey ORDER BY rm DESC, l_linenumber, l_partkey, l_suppkey) AS rn FROM y),
s AS (SELECT *, CAST(fl + CASE WHEN rn <= spare THEN 1 ELSE 0 END AS BIGINT) AS share FROM z)
"""


def shares(spark, sf):
    """Each order's price in cents over its lines' quantities."""
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("pool")
    )
    lines = _lines(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus",
        F.col("l_quantity").cast("bigint").alias("w"),
    )
    position = [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]
    return money.allocate(lines.join(orders, "l_orderkey", "inner"), ["l_orderkey"], "pool", "w", position)


@query("w1_largest_remainder", ALLOC_SQL + "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, w, share FROM s")
def w1(spark, sf):
    return shares(spark, sf).select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_partkey", "l_suppkey", "w", "share"
    )


@query("r2_allocation_conservation", ALLOC_SQL + """
SELECT 'orders' AS grouping, (SELECT CAST(sum(p) AS BIGINT) FROM (SELECT any_value(pool) AS p FROM x GROUP BY l_orderkey)) AS before, CAST(sum(share) AS BIGINT) AS after, TRUE AS conserved FROM s""")
def r2(spark, sf):
    split = shares(spark, sf)
    pools = split.groupBy("l_orderkey").agg(F.any_value("pool").alias("share"))
    return checks.conservation(pools, split, "share", "orders")


@query("a22_parts_merge", ALLOC_SQL + """
SELECT l_returnflag || ':' || l_linestatus AS part, l_returnflag AS plugin, CAST(sum(share) AS BIGINT) AS cost_micros, count(*) AS rows,
 CAST(sum(CAST(sum(share) AS BIGINT)) OVER (PARTITION BY l_returnflag) AS BIGINT) AS plugin_micros FROM s GROUP BY l_returnflag, l_linestatus""")
def a22(spark, sf):
    """Costs allocated over parts, then merged by part name over all items, with plugin subtotals."""
    parts = (
        shares(spark, sf).groupBy(F.concat_ws(":", "l_returnflag", "l_linestatus").alias("part"))
        .agg(F.sum("share").alias("cost_micros"), F.count(F.lit(1)).alias("rows"))
        .withColumn("plugin", F.split_part("part", F.lit(":"), F.lit(1)))
    )
    subtotals = parts.groupBy("plugin").agg(F.sum("cost_micros").alias("plugin_micros"))
    return parts.join(subtotals, "plugin", "inner")


@query("k2_top_orders_with_rest", """
WITH x AS (SELECT o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders), t AS (SELECT * FROM x ORDER BY c DESC, k LIMIT 20)
SELECT CAST(k AS VARCHAR) AS order_key, c AS cents FROM t UNION ALL SELECT (SELECT count(*) - 20 FROM x) || ' other items', CAST((SELECT sum(c) FROM x) - (SELECT sum(c) FROM t) AS BIGINT)""")
def k2(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("n"), F.col("o_orderkey").cast("string").alias("order_key"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"),
    )
    return ro.top_with_rest(rows, "order_key", "cents", 20)


@query("f1_usd_to_micros", """
SELECT l_orderkey, l_partkey, l_suppkey, CAST(q + CASE WHEN 2 * r > 1000 OR (2 * r = 1000 AND q % 2 = 1) THEN 1 ELSE 0 END AS BIGINT) AS micros FROM (
SELECT *, c // 1000 AS q, c % 1000 AS r FROM (SELECT l_orderkey, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS c FROM lineitem))""")
def f1(spark, sf):
    """Prices scaled to 1e-9 dollars per cent, so that halves of a micro-dollar occur."""
    usd = F.round(F.col("l_extendedprice") * 100).cast("decimal(18,0)") * F.expr("0.000000001BD")
    return _lines(spark, sf).select("l_orderkey", "l_partkey", "l_suppkey", money.usd_to_micros(usd).alias("micros"))


MICROS = "CAST(round(o_totalprice * 100) AS BIGINT) * (CASE o_orderkey % 6 WHEN 0 THEN 10000 WHEN 1 THEN 1000 WHEN 2 THEN 10 WHEN 3 THEN -100 WHEN 4 THEN 1000000 ELSE 0 END) // (CASE WHEN o_orderkey % 12 = 2 THEN 10000 ELSE 1 END)"


def _half(x: str, u: str) -> str:
    return f"(({x} // {u}) + CASE WHEN 2 * ({x} % {u}) > {u} OR (2 * ({x} % {u}) = {u} AND ({x} // {u}) % 2 = 1) THEN 1 ELSE 0 END) * {u}"


@query("f2_format_micros", f"""
WITH a AS (SELECT o_orderkey, {MICROS} AS m, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 6 END AS sig FROM orders),
b AS (SELECT *, abs(m) AS s, length(CAST(abs(m) AS VARCHAR)) - 7 AS e FROM a),
c AS (SELECT *, greatest(0, least(2, sig - 1 - e)) AS d, CAST(pow(10, 6 - greatest(0, least(2, sig - 1 - e))) AS BIGINT) AS u,
 CAST(pow(10, greatest(6, 6 - (sig - 1 - e))) AS BIGINT) AS u2 FROM b),
f AS (SELECT *, {_half('s', 'u')} AS r1 FROM c),
g AS (SELECT *, CASE WHEN sig - 1 - e < 0 THEN {_half('r1', 'u2')} ELSE r1 END AS r FROM f)
SELECT o_orderkey, m AS micros, CASE WHEN m = 0 THEN '$0.00' WHEN s < 5000 THEN CASE WHEN m < 0 THEN '-' ELSE '' END || '<$0.01'
 ELSE CASE WHEN m < 0 THEN '-' ELSE '' END || '$' || format('{{:,}}', r // 1000000) || CASE d WHEN 0 THEN '' WHEN 1 THEN '.' || (r % 1000000 // 100000) ELSE '.' || lpad(CAST(r % 1000000 // 10000 AS VARCHAR), 2, '0') END END AS shown FROM g""")
def f2(spark, sf):
    return _amounts(spark, sf).select(
        "o_orderkey", "micros",
        money.format_micros(F.col("micros"), F.when(F.col("o_orderkey") % 2 == 0, 2).otherwise(6)).alias("shown"),
    )


def _amounts(spark, sf):
    """Signed amounts from fractions of a cent to millions of dollars."""
    k = F.col("o_orderkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    times = (
        F.when(k % 6 == 0, 10_000).when(k % 6 == 1, 1_000).when(k % 6 == 2, 10).when(k % 6 == 3, -100)
        .when(k % 6 == 4, 1_000_000).otherwise(0)
    ).cast("bigint")
    by = F.when(k % 12 == 2, 10_000).otherwise(1).cast("bigint")
    return table(spark, sf, "orders").select("o_orderkey", F.call_function("div", cents * times, by).alias("micros"))


@query("f3_axis_label", f"""
WITH a AS (SELECT o_orderkey, {MICROS} AS m FROM orders), b AS (SELECT *, abs(m) AS s FROM a),
c AS (SELECT *, 7 - length(CAST(s AS VARCHAR)) AS p FROM b), f AS (SELECT *, CAST(pow(10, greatest(0, 6 - p)) AS BIGINT) AS u FROM c),
g AS (SELECT *, {_half('s', 'u')} AS r FROM f)
SELECT o_orderkey, m AS micros, CASE WHEN m = 0 THEN '$0' WHEN s >= 1000000 THEN CASE WHEN m < 0 THEN '-' ELSE '' END || '$' || (s // 1000000) ||
 CASE WHEN s % 1000000 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(s % 1000000 AS VARCHAR), 6, '0'), '0') END
 ELSE CASE WHEN m < 0 THEN '-' ELSE '' END || '$' || (r // 1000000) || '.' || substr(lpad(CAST(r % 1000000 AS VARCHAR), 6, '0'), 1, p) END AS label FROM g""")
def f3(spark, sf):
    return _amounts(spark, sf).select("o_orderkey", "micros", money.axis_label(F.col("micros")).alias("label"))


@query("f4_share_text", """
SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN s >= 0.001 OR s <= 0 THEN printf('%.1f', s * 100) || '%' ELSE '<0.1%' END AS text FROM (
SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_quantity AS DOUBLE) * l_discount / (l_linenumber * 40) AS s FROM lineitem)""")
def f4(spark, sf):
    share = F.col("l_quantity") * F.col("l_discount") / (F.col("l_linenumber") * 40)
    return _lines(spark, sf).select("l_orderkey", "l_partkey", "l_suppkey", money.format_share(share).alias("text"))
