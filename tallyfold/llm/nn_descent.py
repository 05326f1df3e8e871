"""Nearest neighbours by cosine: an NN-descent graph, and greedy search in it.

The graph starts from blocks of vectors that lie on the same sides of random hyperplanes. Each
round of NN-descent joins neighbours with neighbours: a vector's sampled neighbours, forward and
backward, meet at it and learn of each other where that betters their lists. Rounds end
when few lists change. A search then holds, per query, its best scored vectors; each hop expands
its best ones not expanded yet by a join with the graph, until no query has any left. What is reached goes to
the buckets that hold the vectors, a list for each query and bucket, and comes back with scores. What fell out of a query's
best before is scored again when it is reached again, which costs less than keeping all ids, and falls out again.

Equal vectors are one node of the graph and are told apart by vec_id at the end. Blocks, samples, buckets and parts of the queries are
bounded, so a group of nearly equal ones can't make a task large; all state lives in written tables. The graph is approximate (recall is measured in the tests); the
scores that are returned are computed from the original vectors in double precision. Before that a score is the squared distance
of the unit vectors, negative, which tells vectors apart whose cosines are equal in single precision.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import pick, saved


@dataclass(frozen=True)
class Settings:
    """degree: neighbours kept; sample: of these met in a round, each way; told: what one meeting tells a vector at most.

    beam: vectors that a query holds; width: of these expanded in a hop; exact: ordered in double precision at least.
    """

    degree: int = 32
    sample: int = 20
    told: int = 16
    rounds: int = 4
    least_change: float = 0.02
    trees: int = 8
    block: int = 2048
    beam: int = 512
    width: int = 192
    exact: int = 192
    seed: int = 7


def unit(batch: pd.Series) -> np.ndarray:
    """Rows of unit length from byte strings of single precision, in which vectors travel."""
    return np.frombuffer(b"".join(batch), np.float32).reshape(len(batch), -1)


def vectors(table: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """row (a number), node (a hash of the vector, one for equal ones), vec_id, v (double), unit (bytes), written.

    Rows that are null, empty, zero, of another dimension than most rows', or hold null or
    non-finite components take no part. Rows that share an id are vectors of their own.
    """
    rows = pick(table, id_column, column).toDF("vec_id", "v")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = rows.where("vec_id is not null and v is not null and size(v) > 0").where(~odd).where(F.exists("v", lambda x: x != 0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            units = []
            for v in batch["v"]:
                v = np.asarray(v, float)
                v = v / np.abs(v).max()
                units.append((v / np.linalg.norm(v)).astype(np.float32).tobytes())
            batch["unit"] = pd.Series(units, dtype=object, index=batch.index)
            yield batch

    out = saved(rows.mapInPandas(run, "vec_id long, v array<double>, unit binary").withColumns({"row": F.monotonically_increasing_id(), "node": F.xxhash64("v")}), "vectors")
    common = out.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return out if common is None else out.where(F.size("v") == common.d)


def _best(rows: DataFrame, degree: int) -> DataFrame:
    """src, dst, score, new: each source's best, a pair once. A pair known before is not new."""
    once = rows.groupBy("src", "dst").agg(F.max("score").alias("score"), F.min("new").alias("new"))
    w = Window.partitionBy("src").orderBy(F.desc("score"), "dst")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= degree).drop("rank")


def _blocks(points: DataFrame, dimension: int, count: int, s: Settings) -> DataFrame:
    """First edges: the best of each vector's block, for each set of hyperplanes."""
    bits = int(math.log2(max(1, count / s.block)))
    planes = np.random.default_rng(s.seed).standard_normal((s.trees, dimension, bits)).astype(np.float32)

    def sides(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = unit(batch["unit"]) if len(batch) else np.empty((0, dimension), np.float32)
            for t in range(s.trees):
                key = ((x @ planes[t]) > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(x), np.int64)
                yield pd.DataFrame({"tree": t, "side": key, "node": batch["node"], "unit": batch["unit"]})

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, cuts in _groups(batches, ["tree", "side", "salt"], s.block):
            yield _pairs(rows["node"].to_numpy(), unit(rows["unit"]), cuts, s.told)

    placed = points.select("node", "unit").mapInPandas(sides, "tree int, side long, node long, unit binary")
    # A side that holds a large share of all vectors is spread over tasks, by other halves in each tree; blocks are cut from these.
    placed = placed.withColumn("salt", F.lit(0) if bits < 3 else F.pmod(F.xxhash64("node", "tree"), F.lit(2)).cast("int"))
    placed = placed.repartition("tree", "side", "salt").sortWithinPartitions("tree", "side", "salt", F.xxhash64("node", "tree"))
    return placed.mapInPandas(meet, "src long, dst long, score float").withColumn("new", F.lit(True))


def _groups(batches: Iterator[pd.DataFrame], keys: list[str], most: int) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows of sorted batches, and where the groups of equal keys in them begin and end; groups are cut at ``most`` rows."""
    held: pd.DataFrame | None = None
    for batch in batches:
        if held is not None:
            batch = pd.concat([held, batch], ignore_index=True)
        if not len(batch):
            continue
        k = batch[keys].to_numpy()
        starts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist()]
        cuts = [at for start, end in zip(starts, starts[1:]) for at in range(start, end, most)]
        # The last group may go on in the next batch.
        cuts += range(starts[-1], len(batch), most)
        if len(cuts) > 1:
            yield batch.iloc[: cuts[-1]], np.array(cuts)
        held = batch.iloc[cuts[-1] :]
    if held is not None and len(held):
        yield held, np.array([0, len(held)])


#: Scores that are held at once.
SCORES = 1 << 17


def _pairs(
    node: np.ndarray, x: np.ndarray, cuts: np.ndarray, told: int, new: np.ndarray | None = None, least: np.ndarray | None = None
) -> pd.DataFrame:
    """For each vector of a group the ``told`` best others, above its worst neighbour where that is given; many groups are scored at once."""
    out = []
    new = np.ones(len(node), bool) if new is None else new
    least = np.full(len(node), -9.0) if least is None else least
    starts, sizes = cuts[:-1], np.diff(cuts)
    step = max(1, SCORES // int(sizes.max()) ** 2)
    for at in range(0, len(starts), step):
        size = sizes[at : at + step, None]
        place = np.arange(size.max())
        row = np.minimum(starts[at : at + step, None] + place, len(node) - 1)
        own = place < size
        v = x[row].astype(np.float64)
        length = np.einsum("gij,gij->gi", v, v)
        score = 2 * (v @ v.transpose(0, 2, 1)) - length[:, :, None] - length[:, None, :]
        n, is_new = node[row], new[row]
        good = score > least[row][:, :, None]
        good &= (own[:, :, None] & own[:, None, :]) & (is_new[:, :, None] | is_new[:, None, :]) & (n[:, :, None] != n[:, None, :])
        many = good.sum(axis=2) > told
        if many.any():
            some = np.where(good[many], score[many], -9)
            top = np.zeros(some.shape, bool)
            np.put_along_axis(top, np.argpartition(-some, told - 1, axis=1)[:, :told], True, axis=1)
            good[many] = top
        g, a, b = np.nonzero(good)
        out.append(pd.DataFrame({"src": n[g, a], "dst": n[g, b], "score": score[g, a, b].astype(np.float32)}))
    return pd.concat(out, ignore_index=True)


def graph(points: DataFrame, settings: Settings | None = None) -> DataFrame:
    """src, dst, score, new: each vector's approximate nearest others."""
    s = settings or Settings()
    first = points.select(F.size("v").alias("d")).first()
    count = points.count()
    edges = saved(_best(_blocks(points, first.d if first else 1, count, s), s.degree), "edges")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, cuts in _groups(batches, ["at"], 4 * s.sample):
            yield _pairs(rows["node"].to_numpy(), unit(rows["unit"]), cuts, s.told, rows["new"].to_numpy(), rows["worst"].to_numpy())

    for k in range(s.rounds):
        # The sample: new ones first, then the best.
        w = Window.partitionBy("src").orderBy(F.desc("new"), F.desc("score"), "dst")
        ranked = edges.withColumn("rank", F.row_number().over(w))
        forward = ranked.where(F.col("rank") <= s.sample)
        back = forward.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "new")
        some = Window.partitionBy("src").orderBy(F.xxhash64("dst", F.lit(k)))
        back = back.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= s.sample)
        meetings = forward.select(F.col("src").alias("at"), F.col("dst").alias("node"), "new")
        meetings = meetings.union(back.select("src", "dst", "new")).groupBy("at", "node").agg(F.max("new").alias("new"))
        worst = edges.groupBy("src").agg(F.when(F.count("*") >= s.degree, F.min("score")).otherwise(-8.0).cast("float").alias("worst"))
        own = points.select("node", "unit").join(worst.withColumnRenamed("src", "node"), "node", "left").fillna(-8.0, ["worst"])
        met = meetings.join(own, "node").repartition("at").sortWithinPartitions("at")
        told = met.select("at", "node", "unit", "new", "worst").mapInPandas(meet, "src long, dst long, score float").withColumn("new", F.lit(True))
        known = ranked.select("src", "dst", "score", (F.col("new") & (F.col("rank") > s.sample)).alias("new"))
        edges = saved(_best(known.union(told), s.degree), "edges")
        if edges.where("new").count() < s.least_change * count * s.degree:
            break
    return edges


def cosine(a: str, b: str) -> Column:
    """Cosine of two arrays of doubles."""

    def dot(x: str, y: str) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda t, z: t + z)

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


#: Parts over which the queries of one node are spread, and the least number of parts of all queries and of buckets of vectors.
SPREAD = 16
#: Queries of a part, and vectors of a bucket.
PART, BUCKET = 256, 16_384


def _by(key: str, count: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(count)).cast("int")


def _lists(rows: pd.DataFrame, column: str) -> dict[int, list[np.ndarray]]:
    """The arrays of ``column`` for each query."""
    out: dict[int, list[np.ndarray]] = {}
    for query, values in zip(rows["query"].tolist(), rows[column]):
        out.setdefault(query, []).append(values)
    return out


#: What a search holds: its best vectors, those of them that are not expanded yet, those to expand now, and how many may be the nearest.
STATE = "part int, query long, unit binary, node array<long>, score array<float>, open array<boolean>, next array<long>, few int"


def _hop(state: DataFrame, links: DataFrame, units: DataFrame, parts: int, buckets: int, merge: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """The state after each query's ``next`` were expanded and what they reach was scored."""

    def unheld(own: pd.DataFrame, reached: pd.DataFrame) -> pd.DataFrame:
        near, out = _lists(reached, "near"), []
        for query, u, held in zip(own["query"].tolist(), own["unit"], own["node"]):
            if query in near:
                found = np.setdiff1d(np.concatenate(near[query]), [query, *held])
                bucket = bucket_of(found)
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
                out += [(int(bucket[order[a]]), query, u, found[order[a:b]]) for a, b in zip(cuts, cuts[1:])]
        return pd.DataFrame(out, columns=["bucket", "query", "unit", "node"])

    def bucket_of(nodes: np.ndarray) -> np.ndarray:
        return (nodes % buckets).astype(np.int32)

    def scores(asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return pd.DataFrame(columns=["query", "node", "score"], dtype=object)
        order = np.argsort(own["node"].to_numpy())
        nodes, x, q = own["node"].to_numpy()[order], unit(own["unit"])[order], unit(asked["unit"])
        ends = np.cumsum([len(a) for a in asked["node"]])
        at = np.searchsorted(nodes, np.concatenate(asked["node"].tolist()))
        of = np.repeat(np.arange(len(asked)), np.diff(ends, prepend=0))
        out = np.empty(len(at), np.float32)
        for k in range(0, len(at), BUCKET):
            apart = q[of[k : k + BUCKET]] - x[at[k : k + BUCKET]]
            out[k : k + BUCKET] = -np.einsum("ij,ij->i", apart, apart)
        return pd.DataFrame({"query": asked["query"], "node": asked["node"], "score": np.split(out, ends[:-1])})

    def dealt(rows: DataFrame, key: str, count: int) -> GroupedData:
        # Columns of their own, as both sides come from the state.
        return rows.toDF(*rows.columns).repartition(count, key).groupBy(key)

    reached = state.select("part", "query", F.explode("next").alias("node")).join(links, "node").select("part", "query", "near")
    asked = dealt(state.select("part", "query", "unit", "node"), "part", parts).cogroup(dealt(reached, "part", parts))
    asked = asked.applyInPandas(unheld, "bucket int, query long, unit binary, node array<long>")
    scored = dealt(asked, "bucket", buckets).cogroup(dealt(units, "bucket", buckets))
    scored = scored.applyInPandas(scores, "query long, node array<long>, score array<float>").withColumn("part", _by("query", parts))
    return dealt(state, "part", parts).cogroup(dealt(scored, "part", parts)).applyInPandas(merge, STATE)


def search(rows: DataFrame, points: DataFrame, edges: DataFrame, queries: DataFrame, k: int, settings: Settings | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each query, its own row left out.

    ``rows`` are all vectors, ``points`` one of each node; ``queries`` are some of the rows. Equal scores go to
    the smaller vec_id. A query without other vectors gives no rows.
    """
    s = settings or Settings()
    both = edges.select("src", "dst").union(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "score")
        .withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("score"), "dst")))
        .where(F.col("rank") <= s.degree)
        .select("src", "dst")
    )
    links = saved(both.groupBy(F.col("src").alias("node")).agg(F.collect_set("dst").alias("near")), "search-graph")
    buckets = max(SPREAD, -(-points.count() // BUCKET))
    units = points.select("node", "unit", F.pmod("node", F.lit(buckets)).cast("int").alias("bucket"))
    asked = saved(queries.select("node").distinct().join(units, "node").select(F.col("node").alias("query"), "unit"), "queries")
    parts = max(SPREAD, -(-asked.count() // PART))
    first = points.select(F.size("v").alias("d")).first()
    dimension = first.d if first else 1

    def merge(own: pd.DataFrame, scored: pd.DataFrame) -> pd.DataFrame:
        nodes, scores, out = _lists(scored, "node"), _lists(scored, "score"), []
        for row in own.itertuples(index=False):
            found = nodes.get(row.query, [])
            node = np.concatenate([row.node, *found])
            score = np.concatenate([row.score, *scores.get(row.query, [])])
            fresh = np.concatenate([row.open, np.ones(len(node) - len(row.node), bool)]).astype(bool)
            order, few = np.lexsort((node, -score)), 0
            if len(order):
                kth = float(score[order[min(k, len(order)) - 1]])
                # The units are rounded by 2^-24 of their length, the sum of squares by as much for each component.
                error = math.sqrt(-kth) * 2.0**-20 + 2.0**-40 - kth * (4 * (dimension + 2) * 2.0**-24)
                few = max(s.exact, 4 * k, np.count_nonzero(score >= kth - error))
                order = order[: max(s.beam, few)]
            node, score, fresh = node[order], score[order], fresh[order]
            turn = np.flatnonzero(fresh[: s.beam])[: s.width]
            fresh[turn] = False
            out.append((row.part, row.query, row.unit, node, score, fresh, node[turn], few))
        return pd.DataFrame(out, columns=list(own.columns))

    start = asked.select(
        _by("query", parts).alias("part"), "query", "unit", F.expr("cast(array() as array<long>)").alias("node"),
        F.expr("cast(array() as array<float>)").alias("score"), F.expr("cast(array() as array<boolean>)").alias("open"),
        F.array("query").alias("next"), F.lit(0).alias("few"),
    )
    state = saved(start, "search")
    while state.where("size(next) > 0").limit(1).count():
        state = saved(_hop(state, links, units, parts, buckets, merge), "search")
    # Single precision chose these; double precision on the original vectors orders them and all that rounding can't tell from the k-th.
    few = state.select("query", F.explode(F.slice("node", F.lit(1), F.col("few"))).alias("node")).union(asked.select("query", F.col("query").alias("node")))
    a = points.select(F.col("node").alias("query"), F.col("v").alias("a"))
    exact = few.join(a, "query").join(points.select("node", F.col("v").alias("b")), "node").select("query", "node", cosine("a", "b").alias("score"))
    # Of equal vectors the k + 1 of smallest vec_id can be among the nearest, the query's own row being one.
    least = Window.partitionBy("node").orderBy("vec_id", "row")
    members = rows.select("node", "vec_id", "row").withColumn("place", F.row_number().over(least)).where(F.col("place") <= k + 1).drop("place")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    top = exact.join(members, "node").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    top = saved(top.select("query", "place", "vec_id", "row", "score"), "nearest").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    own = queries.select(F.col("node").alias("query"), F.col("vec_id").alias("query_id"), F.col("row").alias("query_row"))
    own = own.withColumn("part", F.pmod(F.xxhash64("query_row"), F.lit(SPREAD)).cast("int"))
    out = own.join(top, ["query", "part"]).where("query_row <> row")
    rank = Window.partitionBy("query_row").orderBy("place")
    return out.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(table: DataFrame, every: int, k: int, settings: Settings | None = None) -> DataFrame:
    """The ``k`` nearest of each row whose vec_id is divisible by ``every``, against all rows of ``table``."""
    rows = vectors(table)
    points = saved(rows.select("node", "v", "unit").dropDuplicates(["node"]), "points")
    edges = graph(points, settings)
    return search(rows, points, edges, rows.where(F.col("vec_id") % every == 0), k, settings)
