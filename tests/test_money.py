from pyspark.sql import functions as F

from tallyfold.functions import money

CASES = [
    (100, [1, 1, 1]), (1, [1] * 7), (999999, [3, 5, 7, 11, 13]), (7, [1000000, 1, 1]), (0, [5, 5]), (13, [0, 0, 0]),
    (1649000000, [984, 51100, 24300, 3, 1]), (10, [1, 1, 1]), (90, [1, 2]), (-500, [1000, 2000]),
]


def test_shares_sum_to_the_pool(spark):
    rows = [(g, p, w, i) for g, (p, ws) in enumerate(CASES) for i, w in enumerate(ws)]
    df = spark.createDataFrame(rows, "g int, pool bigint, w bigint, pos int")
    got = {(r.g, r.pos): r.share for r in money.allocate(df, ["g"], "pool", "w", [F.col("pos")]).collect()}
    for g, (pool, ws) in enumerate(CASES):
        assert sum(got[g, i] for i in range(len(ws))) == pool
    assert [got[7, i] for i in range(3)] == [4, 3, 3]
    assert [got[8, i] for i in range(2)] == [30, 60]
    assert [got[9, i] for i in range(2)] == [-167, -333]
    assert [got[5, i] for i in range(3)] == [5, 4, 4]


def test_half_even_cost(spark):
    df = spark.createDataFrame([(1, 500000), (3, 500000), (5, 500000), (7, 500000)], "t bigint, r bigint")
    assert [r[0] for r in df.orderBy("t").select(money.cost_micros(F.col("t"), F.col("r"))).collect()] == [0, 2, 2, 4]


def test_costs_equal_exact_rounding(spark):
    from decimal import ROUND_HALF_EVEN, Decimal

    rows = [(t, r, m) for t in (0, 1, 7, 999_999, 123_456_789_012) for r in (0, 1, 500_000, 6_250_001, 75_000_000) for m in (100_000, 1_250_000, 2_000_000, 999_999)]
    df = spark.createDataFrame(rows, "t bigint, r bigint, m bigint")
    for x in df.select("*", money.cost_micros(F.col("t"), F.col("r"), F.col("m")).alias("c"), money.cost_micros(F.col("t"), F.col("r")).alias("p")).collect():
        exact = Decimal(x.t) * x.r / 10**6
        assert x.p == int(exact.quantize(Decimal(1), ROUND_HALF_EVEN))
        assert x.c == int((exact * x.m / 10**6).quantize(Decimal(1), ROUND_HALF_EVEN))
