"""Near duplicates among embeddings: int8 tile products with rigorous error bounds.

A unit vector u is kept as ``scale * q`` with whole q from -127 to 127 and the exact length of what that leaves
out, ``error = |u - scale * q|``. For two vectors the product of the int8 parts is off by at most
``error_a + |scale_a * q_a| * error_b``. A tile is the product of two blocks of one label; a pair whose bound stays below
the threshold is done with, one whose bound stays above it is a link, and only the others are computed from
the original vectors in double precision. A tile gives back a count for each vector and a spanning forest of its
links, so what leaves it grows with its vectors, not with its pairs.

Equal vectors are one node with a number of copies. Large labels are cut into the cells of pivots: two vectors at most
``reach`` apart either share a cell or both lie within ``reach`` of the plane between their two pivots, so a
vector goes to its own cell and, of each such neighbour, to one of the two. Cells are cut into blocks by a hash
and a tile holds two blocks, however large a cell or a label is.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import pick, saved
from tallyfold.llm.jaccard import components
from tallyfold.plans.sizing import bounded_broadcast

#: Rounding of the double-precision sums that bounds are made of; far above what it can be.
SLACK = 1e-9
#: Products of int8 rows of this length are exact in single precision: 1,024 * 127 * 127 < 2 ** 24.
EXACT_LENGTH = 1024


@dataclass(frozen=True)
class Settings:
    """cell_rows: vectors of a label that one pivot stands for; most_cells: pivots at most; block: vectors of a block; block_bytes: its bytes."""

    cell_rows: int = 4096
    most_cells: int = 256
    block: int = 4096
    block_bytes: int = 32 << 20


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; dividing by the largest entry first keeps the squares finite."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def quantised(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """q (int8), scale, error, length of each row of ``u``: error bounds |u - scale * q|, length |scale * q|."""
    scale = np.abs(u).max(axis=1) / 127
    q = np.rint(u / scale[:, None])
    left = u - scale[:, None] * q
    error = np.sqrt(np.einsum("ij,ij->i", left, left))
    length = scale * np.sqrt(np.einsum("ij,ij->i", q, q))
    return q.astype(np.int8), scale, error, length


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact products of int8 rows, by single-precision matrix products of stretches that can't round."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], EXACT_LENGTH):
        out += a[:, at : at + EXACT_LENGTH].astype(np.float32) @ b[:, at : at + EXACT_LENGTH].astype(np.float32).T
    return out


def linked(rows: tuple, columns: tuple, threshold: float, strip: int = 256, pairs: int = 1 << 16) -> tuple[np.ndarray, int]:
    """Which row has a cosine of at least ``threshold`` with which column, and the number of pairs computed in full.

    Either side is (unit vectors, q, scale, error, length).
    """
    u, q, scale, error, length = rows
    w, p, scale_w, error_w, _ = columns
    out = np.zeros((len(u), len(w)), bool)
    recomputed = 0
    for at in range(0, len(u), strip):
        s = slice(at, at + strip)
        near = products(q[s], p) * scale[s, None] * scale_w[None, :]
        bound = error[s, None] + length[s, None] * error_w[None, :] + SLACK
        out[s] = near - bound >= threshold
        i, j = np.nonzero((near + bound >= threshold) & ~out[s])
        recomputed += len(i)
        for k in range(0, len(i), pairs):
            x, y = i[k : k + pairs] + at, j[k : k + pairs]
            out[x, y] = np.einsum("ij,ij->i", u[x], w[y]) >= threshold
    return out, recomputed


def forest(links: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The connected groups of rows and columns of a matrix of links, those of one row and no column left out."""
    rows, columns = links.any(axis=1), np.ones(links.shape[1], bool)
    groups = []
    for start in np.flatnonzero(rows):
        if not rows[start]:
            continue
        rows[start] = False
        front, mine, theirs = np.array([start]), [np.array([start])], []
        while len(front):
            found = np.flatnonzero(links[front].any(axis=0) & columns)
            columns[found] = False
            theirs.append(found)
            front = np.flatnonzero(links[:, found].any(axis=1) & rows) if len(found) else found
            rows[front] = False
            mine.append(front)
        groups.append((np.concatenate(mine), np.concatenate(theirs)))
    return groups


def _rows(table: DataFrame, id_column: str, column: str, label: str) -> DataFrame:
    """vec_id, label, key (128 bits of label and vector; null where the row links with nothing), vector (bytes of doubles), written."""
    rows = pick(table, id_column, column, label).toDF("vec_id", "v", "label")
    v = F.col("v").cast("array<double>")
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), v.alias("v"))
    usable = F.col("label").isNotNull() & F.col("v").isNotNull() & ~odd & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("v", F.when(usable, F.col("v")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            data = [None if v is None else np.asarray(v, np.float64).tobytes() for v in batch["v"]]
            keys = [
                None if d is None else hashlib.blake2b(d, digest_size=16, key=hashlib.blake2b(label.encode(), digest_size=32).digest()).digest()
                for d, label in zip(data, batch["label"], strict=True)
            ]
            yield pd.DataFrame({"vec_id": batch["vec_id"].astype("Int64"), "label": batch["label"], "key": keys, "vector": data}, index=batch.index)

    return saved(rows.mapInPandas(run, "vec_id long, label string, key binary, vector binary"), "tile-rows")


def _stack(vectors: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)


def _pivots(nodes: DataFrame, reach: float, s: Settings) -> np.ndarray:
    """Unit vectors at pairwise distances above ``reach`` from those of smallest key, at most ``most_cells``; few rows, whatever the input."""
    sizes = nodes.groupBy("label", "d").count()
    most = sizes.groupBy("d").agg(F.max("count").alias("most"), F.sum("count").alias("n")).orderBy(F.desc("n"), "d").first()
    cells = 1 if most is None else min(s.most_cells, math.ceil(most.most / s.cell_rows))
    if cells < 2:
        return np.empty((0, 0))
    got = unit(_stack(pd.Series([bytes(r.vector) for r in nodes.where(F.col("d") == most.d).orderBy("key").limit(4 * cells).collect()])))
    chosen: list[np.ndarray] = []
    for x in got:
        if len(chosen) < cells and all(np.linalg.norm(x - c) > reach for c in chosen):
            chosen.append(x)
    return np.stack(chosen) if len(chosen) > 1 else np.empty((0, 0))


def cells_of(u: np.ndarray, pivots: np.ndarray, reach: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(cell, rows, own): the rows of ``u`` that each cell compares, and which of them are its own.

    Of a row's two cells, own and neighbouring, one compares the pair: the smaller where their sum is even.
    """
    if not len(pivots):
        yield 0, np.arange(len(u)), np.ones(len(u), bool)
        return
    apart = np.maximum(0, 2 - 2 * (u @ pivots.T))
    own = apart.argmin(axis=1)
    between = np.sqrt(np.maximum(1e-300, 2 - 2 * (pivots @ pivots.T)))
    beyond = (apart - apart[np.arange(len(u)), own][:, None]) / (2 * between[own])
    for cell in range(len(pivots)):
        takes = np.where((own + cell) % 2 == 0, cell < own, cell > own)
        rows = np.flatnonzero((own == cell) | (takes & (beyond[:, cell] <= reach + 1e-6)))
        if len(rows):
            yield cell, rows, own[rows] == cell


def _routed(nodes: DataFrame, pivots: np.ndarray, reach: float) -> DataFrame:
    """label, d, cell, own, node, copies, vector, q, scale, error, length: a row for each cell that compares the node; written.

    ``node`` sorts by the smallest vec_id of its copies, null ids last, and then by the key.
    """
    sent = nodes.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, part in batch.groupby("d"):
                u = unit(_stack(part["vector"]))
                q, scale, error, length = quantised(u)
                named = zip(part["least"].isna(), part["least"].fillna(0).astype("int64"), part["key"], strict=True)
                node = [struct.pack(">BQ", none, least + (1 << 63)) + key for none, least, key in named]
                part = part[["label", "d", "copies", "vector"]].assign(node=node, q=[x.tobytes() for x in q], scale=scale, error=error, length=length)
                centres = sent.value if sent.value.shape[1] == d else np.empty((0, 0))
                for cell, rows, own in cells_of(u, centres, reach):
                    yield part.iloc[rows].assign(cell=cell, own=own)

    schema = "label string, d int, copies long, vector binary, node binary, q binary, scale double, error double, length double, cell int, own boolean"
    return saved(nodes.select("key", "label", "d", "copies", "vector", "least").mapInPandas(run, schema), "tile-cells")


CELL = ["label", "d", "cell"]
TILE = [*CELL, "row", "column"]
#: What a vector is in a tile: a row, a column, or both.
ROW, COLUMN, BOTH = 0, 1, 2


def _tiles(routed: DataFrame, s: Settings) -> DataFrame:
    """The routed rows once for each tile that holds them, spread by tile.

    A cell of one block each is one tile. Else own block i meets own blocks from i on and all blocks of neighbours.
    """
    size = F.least(F.lit(s.block), F.greatest(F.lit(64), (F.lit(s.block_bytes) / (9 * F.col("d"))).cast("int")))
    sizes = routed.groupBy(*CELL).agg(F.count_if("own").alias("own"), F.count_if(~F.col("own")).alias("others"))
    sizes = saved(sizes.select(*CELL, F.ceil(F.col("own") / size).alias("mine"), F.ceil(F.col("others") / size).alias("theirs")), "tile-counts")
    # Cells of several blocks are few: each holds more than a block of rows.
    large = sizes.where("mine > 1 or theirs > 1")
    n = sizes.agg(F.sum(F.expr("mine * (mine + 1) div 2 + mine * theirs")).alias("tiles"), F.count_if(F.expr("mine > 1 or theirs > 1")).alias("large")).first()
    placed = routed.join(bounded_broadcast(large, n.large), CELL, "left").withColumn("block", F.xxhash64("node"))
    many = f"""case when mine is null then array(struct(0L as row, 0L as column, if(own, {BOTH}, {COLUMN}) as side))
      when own then concat(
        transform(sequence(0L, pmod(block, mine)), k -> struct(k as row, pmod(block, mine) as column, if(k = pmod(block, mine), {BOTH}, {COLUMN}) as side)),
        transform(filter(sequence(0L, mine + theirs - 1), k -> k > pmod(block, mine)), k -> struct(pmod(block, mine) as row, k as column, {ROW} as side)))
      else transform(filter(sequence(0L, mine - 1), k -> k >= 0), k -> struct(k as row, mine + pmod(block, greatest(theirs, 1L)) as column, {COLUMN} as side)) end"""
    placed = placed.where("mine is null or mine > 0").withColumn("t", F.explode(F.expr(many)))
    placed = placed.select(*CELL, "t.row", "t.column", "t.side", "node", "copies", "vector", "q", "scale", "error", "length")
    # A tile is much work for few bytes; a stated number of partitions is kept as it is.
    shuffles = int(routed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(max(shuffles, min(n.tiles or 0, 100_000)), *TILE)


def _meet(threshold: float):
    """A tile's rows to node, links (copies of other vectors linked with it) and, in other rows, node, other of a spanning forest."""

    def run(tile: pd.DataFrame) -> pd.DataFrame:
        tile = tile.reset_index(drop=True)
        u = unit(_stack(tile["vector"]))
        q = np.frombuffer(b"".join(tile["q"]), np.int8).reshape(len(tile), -1)
        parts = (u, q, tile["scale"].to_numpy(), tile["error"].to_numpy(), tile["length"].to_numpy())
        side, copies = tile["side"].to_numpy(), tile["copies"].to_numpy()
        i, j = np.flatnonzero(side != COLUMN), np.flatnonzero(side != ROW)
        found, _ = linked(tuple(x[i] for x in parts), tuple(x[j] for x in parts), threshold)
        same = (i[:, None] == j[None, :]) if len(i) and (side == BOTH).any() else None
        if same is not None:
            found |= same
        links = np.zeros(len(tile), np.int64)
        links[i] = found @ copies[j]
        links[i[side[i] == BOTH]] -= copies[i[side[i] == BOTH]]
        only = side[j] == COLUMN
        links[j[only]] = copies[i] @ found[:, only]
        nodes = tile["node"].to_numpy()
        out = [(nodes[k], None, int(links[k])) for k in np.flatnonzero(links)]
        for mine, theirs in forest(found):
            group = np.unique(np.concatenate([i[mine], j[theirs]]))
            out += [(nodes[group[0]], nodes[k], 0) for k in group[1:]]
        return pd.DataFrame(out, columns=["node", "other", "links"])

    return run


def _least(node: str) -> Column:
    """The smallest vec_id that a node's name begins with; null where it has none."""
    number = F.conv(F.hex(F.substring(node, 2, 8)), 16, 10).cast("decimal(20,0)") - F.lit(str(1 << 63)).cast("decimal(20,0)")
    return F.when(F.substring(node, 1, 1) == F.lit(b"\x00"), number.cast("long"))


def near_duplicates(
    table: DataFrame, threshold: float = 0.98, *, id_column: str = "vec_id", column: str = "embedding", label: str = "label", settings: Settings | None = None
) -> DataFrame:
    """vec_id, n_links (other rows linked directly), component_id (smallest vec_id that links reach, its own included), kept.

    Rows link when their labels are equal and not null and the cosine of their vectors is at least ``threshold``
    in double precision; vectors of different dimension don't. One row for each row of ``table``. Vectors that are
    null, empty, zero or hold null or non-finite components, and rows without a label, link with nothing. Rows that
    share an id are rows of their own; a null id is a component's id only where no other is there. ``kept`` says that
    the row's id is the component's. Other columns are ignored; an empty table gives no rows.
    """
    s = settings or Settings()
    if not 0 < threshold <= 1:
        raise ValueError("a threshold above 0 and at most 1 is needed")
    reach = math.sqrt(2 - 2 * threshold)
    rows = _rows(table, id_column, column, label)
    nodes = rows.where("key is not null").groupBy("key").agg(
        F.first("label").alias("label"), F.first("vector").alias("vector"), F.count("*").alias("copies"), F.min("vec_id").alias("least")
    )
    nodes = saved(nodes.withColumn("d", (F.octet_length("vector") / 8).cast("int")), "tile-nodes")
    tiles = _tiles(_routed(nodes, _pivots(nodes, reach, s), reach), s)
    met = saved(tiles.groupBy(*TILE).applyInPandas(_meet(threshold), "node binary, other binary, links long"), "tile-links")
    groups = components(met.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    key = F.substring("node", 10, 16).alias("key")
    links = met.where("other is null").groupBy(key).agg(F.sum("links").alias("links"))
    groups = groups.select(key, _least("component").alias("component_id"))
    known = nodes.select("key", "copies", "least").join(links, "key", "left").join(groups, "key", "left")
    known = known.select(
        "key",
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component_id", "least").alias("component_id"),
    )
    out = rows.where("key is not null").select("vec_id", "key").join(known, "key").select("vec_id", "n_links", "component_id")
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
