import sys

import numpy as np
import pandas as pd

from tallyfold.llm import nn_descent


def plain(rows, every, k):
    use = [(i, np.asarray(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    x = np.stack([v / np.linalg.norm(v) for _, v in use])
    ids = np.array([i for i, _ in use])
    out = []
    for a in np.flatnonzero(ids % every == 0):
        s = x @ x[a]
        order = [b for b in np.lexsort((ids, -s.round(12))) if b != a][:k]
        out.append((ids[a], [ids[b] for b in order], [s[b] for b in order]))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "u") for i, v in rows], "vec_id long, embedding array<float>, node int, unit string")


def test_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(rng.standard_normal((3000, 24)).astype(np.float32))]
    rows += [(5000 + k, [float(x) for x in np.float32(rows[7][1]) + np.float32(1e-2) * rng.standard_normal(24).astype(np.float32)]) for k in range(400)]
    want = {q: (set(ids), scores) for q, ids, scores in plain(rows, 50, 5)}
    got = {}
    for r in nn_descent.nearest(frame(spark, rows), 50, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    vector = {i: np.asarray(v, float) for i, v in rows}
    hits = 0
    for q, (ids, _) in want.items():
        own = sorted(got[q])
        assert [k for k, _, _ in own] == [1, 2, 3, 4, 5]
        for _, i, s in own:
            a, b = vector[q], vector[i]
            assert abs(s - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12
        assert own == sorted(own, key=lambda x: (-x[2], x[1]))
        hits += len(ids & {i for _, i, _ in own})
    assert hits / (5 * len(want)) >= 0.9


def test_small_and_hostile_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [1.0, 1.0]), (1, [2.0, 0.0]), (2, [3.0, 0.0]), (2, [3.0, 0.0]), (100, None), (150, [0.0, 0.0])]
    rows += [(200, [1.0, None]), (250, [nan, 1.0]), (300, [inf, 1.0]), (350, []), (None, [1.0, 0.0]), (3, [1e30, -1e30]), (400, [1.0, 0.0, 0.0])]
    got = {}
    for r in nn_descent.nearest(frame(spark, rows), 50, 3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert {q: [i for _, i in sorted(x)] for q, x in got.items()} == {0: [1, 2, 2], 50: [0, 1, 2]}
    assert nn_descent.nearest(frame(spark, []), 50, 5).count() == 0
    assert nn_descent.nearest(frame(spark, [(0, [1.0])]), 50, 5).count() == 0


def test_equal_and_nearly_equal_thirds(spark):
    rng = np.random.default_rng(5)
    made = lambda n: rng.standard_normal((n, 24)).astype(np.float32)
    one, two = made(2)
    # Equal ones come first by place with their ids falling; the nearly equal ones are closer than half precision.
    equal = [(9000 - k, [float(x) for x in one]) for k in range(700)]
    nearly = [(20_000 + k, [float(x) for x in two + np.float32(1e-4) * made(1)[0]]) for k in range(700)]
    rows = equal + nearly + [(k, [float(x) for x in v]) for k, v in enumerate(made(700))]
    got = {}
    for r in nn_descent.nearest(frame(spark, rows), 50, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    hits, total = {}, {}
    for q, ids, _ in plain(rows, 50, 5):
        own = [i for _, i in sorted(got[q])]
        if 8000 < q <= 9000:
            assert own == [i for i in range(8301, 8307) if i != q][:5]
        kind = q // 10_000
        hits[kind] = hits.get(kind, 0) + len(set(ids) & set(own))
        total[kind] = total.get(kind, 0) + 5
    assert all(hits[kind] / total[kind] >= 0.9 for kind in total), (hits, total)


def test_groups_are_scored_together():
    rng = np.random.default_rng(9)
    sizes = rng.integers(1, 41, 600)
    x = rng.standard_normal((sizes.sum(), 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = pd.DataFrame({"at": np.repeat(np.arange(600), sizes), "node": rng.integers(0, 9000, len(x)), "unit": [v.tobytes() for v in x]})
    rows["new"], rows["worst"] = rng.random(len(x)) < 0.5, np.where(rng.random(len(x)) < 0.5, -8.0, -1.5)
    batches = [rows.iloc[k : k + 1000] for k in range(0, len(rows), 1000)]
    calls, got = 0, []

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        for part, cuts in nn_descent._groups(iter(batches), ["at"], 30):
            got.append(nn_descent._pairs(part["node"].to_numpy(), nn_descent.unit(part["unit"]), cuts, 4, part["new"].to_numpy(), part["worst"].to_numpy()))
    finally:
        sys.setprofile(None)
    want = []
    for _, group in rows.groupby("at"):
        for at in range(0, len(group), 30):
            g = group.iloc[at : at + 30].reset_index(drop=True)
            v = np.stack([np.frombuffer(u, np.float32) for u in g["unit"]]).astype(float)
            for a in range(len(g)):
                scores = [(-((v[a] - v[b]) ** 2).sum(), g.node[b]) for b in range(len(g)) if g.node[a] != g.node[b] and (g.new[a] or g.new[b])]
                want += [(g.node[a], b, s) for s, b in sorted(scores, reverse=True)[:4] if s > g.worst[a]]
    got = pd.concat(got)
    got, want = sorted(zip(got.src, got.dst, got.score)), sorted(want)
    assert [r[:2] for r in got] == [r[:2] for r in want] and np.allclose([r[2] for r in got], [r[2] for r in want], atol=1e-6)
    # Fewer calls than a frame for each group takes.
    assert calls < 60 * 600


def test_a_hop_scores_what_it_reaches_once(spark):
    points = pd.DataFrame({"node": range(6), "unit": [np.float32([np.cos(a), np.sin(a)]).tobytes() for a in np.arange(6) / 10]})
    links = spark.createDataFrame([(k, [j for j in (k - 1, k + 1, k + 2) if 0 <= j < 6]) for k in range(6)], "node long, near array<long>")
    units = spark.createDataFrame(points).selectExpr("node", "unit", "cast(node % 2 as int) as bucket")
    own = [(0, 7, bytes(points.unit[0]), [1], [-1.0], [False], [1, 2], 1), (1, 8, bytes(points.unit[5]), [], [], [], [], 0)]

    def merge(state, found):
        out = state.copy()
        out["node"] = [np.concatenate([np.empty(0, np.int64), *found.node[found["query"] == q]]) for q in state["query"]]
        out["score"] = [np.concatenate([np.empty(0, np.float32), *found.score[found["query"] == q]]) for q in state["query"]]
        return out

    # The parts of the state are those that the scored rows are dealt by.
    part = {r[0]: r[1] for r in spark.createDataFrame([(7,), (8,)], "q long").select("q", nn_descent._by("q", 2)).collect()}
    state = spark.createDataFrame([(part[r[1]], *r[1:]) for r in own], nn_descent.STATE)
    scored = {r["query"]: sorted(zip(r["node"], r["score"])) for r in nn_descent._hop(state, links, units, 2, 2, merge).collect()}
    assert scored[8] == [] and [n for n, _ in scored[7]] == [0, 2, 3, 4]
    assert all(abs(s - (2 * np.cos(n / 10) - 2)) < 1e-6 for n, s in scored[7])
