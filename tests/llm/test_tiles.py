import numpy as np
import pytest

from tallyfold.llm import tiles
from tallyfold.llm.common import saved

from .helpers import rows_of

SMALL = tiles.Settings(cell_rows=60, most_cells=5, block=16)


def plain(rows, threshold):
    """Links of all pairs, one by one."""
    use = {}
    for k, (_, v, label) in enumerate(rows):
        if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v):
            x = np.asarray(v, float)
            x = x / np.abs(x).max()
            use[k] = x / np.linalg.norm(x)
    near = {k: set() for k in range(len(rows))}
    for a in use:
        for b in use:
            if a != b and rows[a][2] == rows[b][2] and len(use[a]) == len(use[b]) and use[a] @ use[b] >= threshold:
                near[a].add(b)
    out, done = {}, set()
    for k in range(len(rows)):
        if k in done:
            continue
        group, todo = set(), [k]
        while todo:
            x = todo.pop()
            if x not in group:
                group.add(x)
                todo += near[x]
        done |= group
        least = min((rows[x][0] for x in group if rows[x][0] is not None), default=None)
        for x in group:
            out[x] = (rows[x][0], len(near[x]), least, rows[x][0] == least)
    return sorted(out.values(), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, x, 1, "u", "w") for i, v, x in rows], "vec_id long, embedding array<float>, label int, node int, key string, `LABEL` string")


def made(seed, loose, near):
    rng = np.random.default_rng(seed)
    v = [x for x in rng.standard_normal((loose, 12))]
    for k in range(near):  # chains of near vectors, many pairs about the threshold
        base = v[k % 5] if k % 3 else v[-1]
        v.append(base / np.linalg.norm(base) + 0.055 * rng.standard_normal(12))
    return [[float(x) for x in np.float32(x)] for x in v]


@pytest.mark.parametrize("settings", [tiles.Settings(), SMALL])
def test_against_all_pairs(spark, settings):
    v = made(3, 260, 140)
    rows = [(k, x, k % 2) for k, x in enumerate(v)] + [(1000 + k, v[k], k % 2) for k in range(40)] + [(2000 + k, v[8], 0) for k in range(90)]
    want = plain(rows, 0.98)
    assert sum(n for _, n, _, _ in want) > 8000 and len({c for _, _, c, _ in want}) < len(want)
    got = tiles.near_duplicates(frame(spark, rows), settings=settings)
    assert rows_of(got, "vec_id", "n_links", "component_id", "kept") == want


def test_hostile_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (2, [3.0, 0.01], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1)]
    rows += [(7, [1.0, None], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [], 1), (None, [1.0, 0.0], 1), (11, [1e30, -1e30], 1), (11, [1e30, -1e30], 1)]
    rows += [(12, [1.0, 0.0, 0.0], 1), (None, [0.0, -1.0], 1), (-5, [-1.0, 0.0], 2), (2, [3.0, 0.01], 1)]
    assert rows_of(tiles.near_duplicates(frame(spark, rows)), "vec_id", "n_links", "component_id", "kept") == plain(rows, 0.98)
    assert tiles.near_duplicates(frame(spark, [])).count() == 0
    assert tiles.near_duplicates(frame(spark, [(None, None, None)])).collect()[0].kept is True


def test_bounds_hold_and_few_pairs_are_computed_in_full():
    rng = np.random.default_rng(9)
    u = tiles.unit(rng.standard_normal((300, 1500)) * np.exp(rng.standard_normal((300, 1))))
    u[150:] = tiles.unit(u[:150] + 0.004 * rng.standard_normal((150, 1500)))
    q, scale, error, length = tiles.quantised(u)
    off = np.abs(u @ u.T - tiles.products(q, q) * scale[:, None] * scale[None, :])
    assert (off <= error[:, None] + length[:, None] * error[None, :] + tiles.SLACK).all()
    assert (tiles.products(q, q) == q.astype(int) @ q.astype(int).T).all()
    for threshold in (0.5, 0.98, 0.99):
        found, full = tiles.linked((u, q, scale, error, length), (u, q, scale, error, length), threshold, strip=64, pairs=100)
        assert (found == (u @ u.T >= threshold)).all() and full < 2000


def test_neighbouring_cells_meet_once():
    rng = np.random.default_rng(4)
    pivots = tiles.unit(rng.standard_normal((6, 3)))
    u = tiles.unit(rng.standard_normal((400, 3)))
    met = np.zeros((400, 400), int)
    cells = list(tiles.cells_of(u, pivots, 0.2))
    for _, rows, own in cells:
        met[np.ix_(rows[own], rows)] += 1
        met[np.ix_(rows[~own], rows[own])] += 1
    apart = np.linalg.norm(u[:, None] - u[None, :], axis=2)
    assert (met[apart <= 0.2] == 1).all() and (met <= 1).all()
    assert sum(len(rows) for _, rows, _ in cells) < 1100


def test_rows_are_spread_over_tiles_of_bounded_size(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in v], 1) for k, v in enumerate(np.float32(rng.standard_normal((900, 4))))]
    nodes = tiles._rows(frame(spark, rows), "vec_id", "embedding", "label").selectExpr("key", "label", "vector", "1L as copies", "vec_id as least", "4 as d")
    s = tiles.Settings(cell_rows=400, block=64)
    routed = tiles._routed(saved(nodes, "n"), tiles._pivots(nodes, 0.2, s), 0.2)
    sizes = [r["count"] for r in tiles._tiles(routed, s).groupBy(*tiles.TILE).count().collect()]
    assert len(sizes) > 40 and max(sizes) < 4 * 64
