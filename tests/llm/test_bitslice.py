from fractions import Fraction

import numpy as np
import pytest

from tallyfold.llm import bitslice as bs


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "u") for i, v in rows], "vec_id long, embedding array<double>, n int, `VEC_ID` string")


def plain(rows, k):
    """x, sums and the covariance in whole numbers, one entry at a time."""
    use = [(i, [int(np.floor(64 * c)) + 1_000_000 for c in v]) for i, v in rows if v and None not in v and np.isfinite(v).all()]
    d, n = len(use[0][1]), len(use)
    sums = [sum(x[j] for _, x in use) for j in range(d)]
    product = [[sum((n * x[a] - sums[a]) * (n * x[b] - sums[b]) for _, x in use) for b in range(d)] for a in range(d)]  # n^3 times the covariance
    v = np.array([[float(Fraction(p, n**3)) for p in line] for line in product])
    e, w = np.linalg.eigh(v)
    e, w = e[::-1], w[:, ::-1]
    out = {}
    for i, x in use:
        off = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums, strict=True)])
        out.setdefault(i, []).append((sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), off @ w[:, :k] / np.sqrt(e[:k])))
    return n, e, np.trace(v), out


@pytest.mark.parametrize("spread", [0.3, 4000.0])
def test_against_whole_numbers(spark, spread):
    rng = np.random.default_rng(1)
    turn = rng.standard_normal((9, 9))
    rows = [(k, [float(c) for c in spread * (rng.standard_normal(9) @ turn)]) for k in range(700)]
    n, e, trace, want = plain(rows, 4)
    got = {}
    for r in bs.whitened(frame(spark, rows).repartition(5), 4).collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    assert len(got) == 700 and all(sorted(g) == [1, 2, 3, 4] for g in got.values())
    sign = [np.sign(got[0][c].whitened * want[0][0][1][c - 1]) for c in range(1, 5)]
    for i, ((deviation, z),) in want.items():
        for c in range(1, 5):
            r = got[i][c]
            assert r.n == n and int(r.deviation) == deviation and abs(r.explained - e[c - 1] / trace) < 1e-9
            assert abs(sign[c - 1] * r.whitened - z[c - 1]) < 1e-6 and r.identity_error < 1e-9


def test_planes_give_exact_products():
    rng = np.random.default_rng(2)
    for top in (1, 2, 300, 1 << 40, 1 << 62):
        y = rng.integers(0, top, (333, 7)).astype(np.uint64)
        y[:, 3] = 0
        into = np.zeros((128 // bs.LIMB + 1, 7, 7), np.int64)
        bs.scatter(y[:100], into)
        bs.scatter(y[100:], into)
        got = sum(into[k].astype(object) << bs.LIMB * k for k in range(len(into)))
        whole = y.astype(object)
        assert (np.triu(got) == np.triu(whole.T @ whole)).all() and not np.tril(got, -1).any()
    assert sum(len(bs.planes(np.zeros((0, 3), np.uint64))[k]) for k in (0, 1)) == 0


def test_hostile_rows(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(1, None), (2, []), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, 2.0, 3.0])]
    good = [(None, [0.0, 0.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [-40.0, 1e-300]), (9, [3.0, 1.0])]
    got = bs.whitened(frame(spark, bad + good))
    rows = got.collect()
    assert len(rows) == 2 * len(good) and {r.n for r in rows} == {5} and {r.component for r in rows} == {1, 2}
    assert sorted(str(r.vec_id) for r in rows) == sorted(str(i) for i, _ in good for _ in range(2))
    assert all(r.identity_error < 1e-4 for r in rows)
    same = {(r.component, r.whitened, r.deviation) for r in rows if r.vec_id == 7}
    assert len(same) == 2
    # Entries beyond 2^55 are set to it; beside them the other direction has no spread that doubles can tell.
    far = bs.whitened(frame(spark, [*good, (10, [1e300, 0.0])])).collect()
    assert len(far) == 6 and {r.component for r in far} == {1} and all(r.identity_error < 1e-4 for r in far)
    for few in ([], bad[:5], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3):
        empty = bs.whitened(frame(spark, few))
        assert empty.count() == 0 and empty.columns == got.columns


def test_dimensions_without_spread_have_no_component(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(a), 5.0, float(b), -float(a)]) for k, (a, b) in enumerate(np.round(rng.standard_normal((50, 2)) * 64) / 64)]
    got = bs.whitened(frame(spark, rows)).collect()
    assert {r.component for r in got} == {1, 2} and all(r.identity_error < 1e-9 for r in got)
    assert abs(sum({r.component: r.explained for r in got}.values()) - 1) < 1e-9
