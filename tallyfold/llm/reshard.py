"""Resharding that moves the fewest bytes: a minimum-cost flow from old shard sizes to new capacities.

Rows stand on a line inside their old shard, ordered by a hash. The flow says how many bytes
each old shard keeps and how many go to which other shard; each such amount is a stretch of the
line, and its ends are found from byte histograms that are refined where an end falls. Only
histograms, shard sizes and the few rows above a 64th of a shard reach the driver; their number
depends on the numbers of shards and bins, not on the rows. Files of shards that lose rows are
rewritten, moved rows are written to their new shard, all else stays where it is.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import fresh_path, saved

#: Bits of the line that one histogram resolves, and how many histograms refine each other.
BIN_BITS, LEVELS, LINE_BITS = 10, 4, 63
#: A row above this share of a shard is placed by itself.
HEAVY_SHARE = 64


def min_cost_flow(supply: dict[int, int], capacity: dict[int, int], cost) -> dict[tuple[int, int], int]:
    """Bytes from each old to each new shard at the least total of cost(old, new) * bytes.

    Successive shortest paths with potentials; costs are not negative, the capacities hold the supplies.
    """
    olds, news = sorted(supply), sorted(capacity)
    flow: dict[tuple[int, int], int] = {}
    left, room = dict(supply), dict(capacity)
    up, down = dict.fromkeys(olds, 0), dict.fromkeys(news, 0)
    while any(left.values()):
        dist = {("o", i): 0 for i in olds if left[i]}
        back: dict = {}
        heap = [(0, n) for n in dist]
        heapq.heapify(heap)
        closed = set()
        while heap:
            d, node = heapq.heappop(heap)
            if node in closed:
                continue
            closed.add(node)
            side, i = node
            if side == "o":
                steps = [(("n", j), cost(i, j) + up[i] - down[j]) for j in news]
            else:
                steps = [(("o", k), down[i] - up[k] - cost(k, i)) for k in olds if flow.get((k, i))]
            for nxt, w in steps:
                if d + w < dist.get(nxt, float("inf")):
                    dist[nxt] = d + w
                    back[nxt] = node
                    heapq.heappush(heap, (d + w, nxt))
        far = max(dist.values())
        ends = [j for j in news if room[j] and ("n", j) in dist]
        end = min(ends, key=lambda j: (dist["n", j] + down[j], j))
        for i in olds:
            up[i] += dist.get(("o", i), far)
        for j in news:
            down[j] += dist.get(("n", j), far)
        path, node = [], ("n", end)
        while node in back:
            path.append((back[node], node))
            node = back[node]
        amount = min(left[node[1]], room[end], *(flow[b[1], a[1]] for a, b in path if a[0] == "n"))
        for a, b in path:
            if a[0] == "o":
                flow[a[1], b[1]] = flow.get((a[1], b[1]), 0) + amount
            else:
                flow[b[1], a[1]] -= amount
        left[node[1]] -= amount
        room[end] -= amount
    return {k: v for k, v in flow.items() if v}


@dataclass
class Plan:
    """Where the stretches of each old shard's line go, and the rows placed by themselves."""

    shards: int
    transfers: dict[tuple[int, int], int]
    stretches: dict[int, list[tuple[int, int]]] = field(default_factory=dict)  # old: (end on the line, new)
    heavy: dict[tuple[int, int, int], int] = field(default_factory=dict)  # (old, place, size): new
    heavy_size: int = 0

    @property
    def losing(self) -> set[int]:
        """Old shards that keep less than all of their rows."""
        moved = {i for (i, j) in self.transfers if i != j}
        return moved | {old for (old, _, _), new in self.heavy.items() if old != new}


def level(weights: list[float], taken: list[int], amount: int) -> list[int]:
    """Whole capacities that hold ``amount``, so that taken + capacity is as even by weight as can be."""
    order = sorted(range(len(weights)), key=lambda k: taken[k] / weights[k])
    share, k = 0.0, 0
    total, weight = amount, 0.0
    for k in order:
        if weight and (total / weight) <= taken[k] / weights[k]:
            break
        total += taken[k]
        weight += weights[k]
    share = total / weight
    room = [max(0.0, share * w - t) for w, t in zip(weights, taken, strict=True)]
    out = [int(r) for r in room]
    for k in sorted(range(len(out)), key=lambda k: -(room[k] - out[k]))[: amount - sum(out)]:
        out[k] += 1
    out[order[0]] += amount - sum(out)
    return out


def measures() -> list[Column]:
    """size, text_crc32 and at, a row's place on the line of its shard: 63 bits of a hash.

    Null text has no bytes and the checksum of an empty text; null ids are hashed as nulls.
    """
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    at = F.xxhash64("doc_id", crc).bitwiseAND(F.lit((1 << LINE_BITS) - 1))
    return [size.alias("size"), crc.alias("text_crc32"), at.alias("at")]


def narrow(docs: DataFrame) -> DataFrame:
    """doc_id, old, size, text_crc32, at of rows with doc_id (long), text and old."""
    return docs.select("doc_id", "old", *measures())


def solve(rows: DataFrame, shards: int, weights: list[float] | None = None, cost=None) -> Plan:
    """The plan for rows of ``narrow`` (written: they are read several times).

    ``weights`` are the new shards' relative capacities, equal if left out; ``cost`` is the cost of
    a byte from an old to a new shard, 1 where they differ if left out. Old shards that have no new
    one of their number are emptied. No rows: an empty plan.
    """
    weights = weights or [1.0] * shards
    cost = cost or (lambda i, j: int(i != j))
    sizes = {r.old: (r.size, r.n) for r in rows.groupBy("old").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}
    total = sum(s for s, _ in sizes.values())
    plan = Plan(shards, {}, heavy_size=max(1, total // (shards * HEAVY_SHARE)))
    heavy = rows.where(F.col("size") > plan.heavy_size).groupBy("old", "at", "size").agg(F.count("*").alias("n")).collect()
    heavy = sorted(((r.size * r.n, r.old, r["at"], r.size) for r in heavy), reverse=True)
    goal = [total * w / sum(weights) for w in weights]
    taken = [0] * shards
    for load, old, at, size in heavy:
        new = old if old < shards and taken[old] + load <= goal[old] else min(range(shards), key=lambda k: (taken[k] + load) / weights[k])
        plan.heavy[old, at, size] = new
        taken[new] += load
    supply = {old: s for old, (s, _) in sizes.items()}
    for load, old, _, _ in heavy:
        supply[old] -= load
    if not sum(supply.values()):
        return plan
    room = level(weights, taken, sum(supply.values()))
    plan.transfers = min_cost_flow({k: v for k, v in supply.items() if v}, dict(enumerate(room)), cost)
    light = rows.where(F.col("size") <= plan.heavy_size)
    goals: dict[int, list[tuple[int, int]]] = {}
    for old in supply:
        go = sorted(((j, v) for (i, j), v in plan.transfers.items() if i == old), key=lambda x: (x[0] != old, x[0]))
        upto = 0
        for new, v in go:
            upto += v
            goals.setdefault(old, []).append((upto, new))
    ends = _cuts(light, {(old, upto) for old, g in goals.items() for upto, _ in g[:-1]})
    for old, g in goals.items():
        plan.stretches[old] = [(ends[old, upto], new) for upto, new in g[:-1]] + [(1 << LINE_BITS, g[-1][1])]
    return plan


def _cuts(light: DataFrame, wanted: set[tuple[int, int]]) -> dict[tuple[int, int], int]:
    """For each (old, bytes) the place below which the line of the shard holds about so many bytes."""
    # (old, bytes) -> first place of the stretch looked at, and bytes before it
    at = {w: (0, 0) for w in wanted}
    out: dict[tuple[int, int], int] = {}
    for k in range(LEVELS):
        if not at:
            break
        shift = LINE_BITS - BIN_BITS * (k + 1)
        stretch = 1 << (shift + BIN_BITS)
        heads = sorted({(old, start) for (old, _), (start, _) in at.items()})
        heads_df = light.sparkSession.createDataFrame(heads, "old int, start long")
        own = light.withColumn("start", F.col("at").bitwiseAND(F.lit(-stretch)))
        found: dict[tuple[int, int], dict[int, tuple[int, int]]] = {}
        for r in own.join(F.broadcast(heads_df), ["old", "start"]).groupBy("old", "start", F.shiftright("at", shift).alias("bin")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect():
            found.setdefault((r.old, r.start), {})[r.bin] = (r.size, r.n)
        ahead = {}
        for (old, goal), (start, before) in at.items():
            bins = found.get((old, start), {})
            for b in sorted(bins):
                size, n = bins[b]
                if before + size < goal:
                    before += size
                    continue
                if n > 1 and k < LEVELS - 1:
                    ahead[old, goal] = (b << shift, before)
                else:  # the end nearer to the goal
                    out[old, goal] = (b << shift) if goal - before < before + size - goal else (b + 1) << shift
                break
            else:
                out[old, goal] = start + stretch
        at = ahead
    return out


def new_shard(plan: Plan, df: DataFrame) -> DataFrame:
    """``df``, rows with the columns of ``narrow``, with their new shard."""
    chosen = F.col("old")
    first = True
    for old, stretches in sorted(plan.stretches.items()):
        to = F.lit(stretches[-1][1])
        for end, new in reversed(stretches[:-1]):
            to = F.when(F.col("at") < F.lit(end), F.lit(new)).otherwise(to)
        chosen = F.when(F.col("old") == old, to) if first else chosen.when(F.col("old") == old, to)
        first = False
    if not plan.heavy:
        return df.withColumn("shard", chosen.cast("int"))
    rows = [(old, at, size, new) for (old, at, size), new in plan.heavy.items()]
    heavy = df.sparkSession.createDataFrame(rows, "old int, at long, size long, own int")
    return df.join(F.broadcast(heavy), ["old", "at", "size"], "left").withColumn("shard", F.coalesce("own", chosen).cast("int")).drop("own")


def rewrite(docs: DataFrame, plan: Plan, path: str) -> DataFrame:
    """Writes the affected files below ``path``; all rows in their new layout, read back.

    ``docs`` has doc_id, text and old. Returns doc_id, text, shard. Shards that lose rows are
    written anew, moved rows go to new files of their shard; rows of other shards stay in their
    old files and are read from there.
    """
    losing = sorted(plan.losing)
    if not losing:
        return docs.select("doc_id", "text", F.col("old").alias("shard"))
    hit = new_shard(plan, docs.where(F.col("old").isin(losing)).select("doc_id", "text", "old", *measures()))
    hit.select("doc_id", "text", "shard").write.partitionBy("shard").parquet(path)
    moved = docs.sparkSession.read.schema("doc_id long, text string, shard int").parquet(path)
    still = docs.where(~F.col("old").isin(losing)).select("doc_id", "text", F.col("old").alias("shard"))
    return moved.unionByName(still)


def slots(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, size, text_crc32, shard, at; written) with a gapless slot in each shard.

    Rows are counted by stretch of the line, so no task holds a whole shard.
    """
    shift = LINE_BITS - BIN_BITS
    binned = rows.withColumn("bin", F.shiftright("at", shift))
    counts = binned.groupBy("shard", "bin").agg(F.count("*").alias("n")).collect()
    before, last = [], {}
    for r in sorted(counts, key=lambda r: (r.shard, r.bin)):
        before.append((r.shard, r.bin, last.get(r.shard, 0)))
        last[r.shard] = last.get(r.shard, 0) + r.n
    starts = rows.sparkSession.createDataFrame(before, "shard int, bin long, start long")
    w = Window.partitionBy("shard", "bin").orderBy("at", "doc_id", "size", "text_crc32")
    numbered = binned.withColumn("k", F.row_number().over(w))
    return numbered.join(F.broadcast(starts), ["shard", "bin"]).withColumn("slot", F.col("start") + F.col("k") - 1).drop("bin", "start", "k")


def reshard(docs: DataFrame, shards: int, weights: list[float] | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, old): doc_id, size, text_crc32, shard, slot, after the move.

    Repeated rows move together; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = saved(narrow(docs), "reshard-sizes")
    plan = solve(rows, shards, weights)
    laid = rewrite(docs, plan, fresh_path(spark, "reshard-files"))
    back = narrow(laid.withColumnRenamed("shard", "old")).withColumnRenamed("old", "shard")
    return slots(saved(back, "reshard-rows")).select("doc_id", "size", "text_crc32", "shard", "slot")
