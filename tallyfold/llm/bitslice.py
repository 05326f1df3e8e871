"""Embedding whitening by bit-sliced scatter: exact integer cross-products from AND and population counts.

An entry c becomes the whole number x = floor(64 * c) + 1,000,000. A first pass takes the number of rows and,
for each dimension, sum, least and largest x. A second pass shifts each dimension by its least x, packs every
bit of the shifted numbers across rows into words of 64 rows, and counts the ones that two planes share: the
sum of y_i * y_j is the sum over planes p of i and q of j of 2^(p + q) * popcount(plane_p AND plane_q). These sums
are whole numbers, and so is n * sum(x_i * x_j) - S_i * S_j, n^2 times the covariance; only then the eigenvectors are
taken in double precision. A third pass whitens the rows and gathers the covariance of what came out.

The driver holds one matrix of dimensions, whatever the number of rows; no row leaves its task unsummed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import pick

SCALE, SHIFT = 64, 1_000_000
#: Larger entries are set to this size, so that x and its differences fit 64 bits.
LARGEST = 2.0**55
#: Rows whose planes are packed at once; a multiple of 64.
CHUNK = 1 << 15
#: The powers of two of one limb: a limb's sum over a chunk stays below 2^24 * 2^15 * 64.
LIMB = 24
#: Vectors of more dimensions are refused: their matrix would not be small.
MOST_DIMENSIONS = 8192
#: Components of a smaller share of the largest eigenvalue than this times their number are directions without spread.
RANK = 2.0**-52


def whole(vectors: np.ndarray) -> np.ndarray:
    """x of each entry."""
    return np.floor(np.clip(np.asarray(vectors, np.float64), -LARGEST, LARGEST) * SCALE).astype(np.int64) + SHIFT


def planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(dimension, bit, words): the bit planes of whole numbers, each packed over the rows; planes of zeros are left out."""
    rows = np.zeros((-len(y) % 64 + len(y), y.shape[1]), np.uint64)
    rows[: len(y)] = y
    dimension, bit, words = [], [], []
    for b in range(int(rows.max(initial=0)).bit_length()):
        ones = (rows >> np.uint64(b) & np.uint64(1)).astype(np.uint8)
        used = np.flatnonzero(ones.any(axis=0))
        dimension.append(used)
        bit.append(np.full(len(used), b))
        words.append(np.packbits(ones[:, used].T, axis=1).view(np.uint64))
    if not words:
        return np.zeros(0, int), np.zeros(0, int), np.zeros((0, len(rows) // 64), np.uint64)
    return np.concatenate(dimension), np.concatenate(bit), np.concatenate(words)


def scatter(y: np.ndarray, into: np.ndarray) -> None:
    """Adds the cross-products of the whole numbers ``y`` to ``into``: limb, dimension, dimension (the first not above the second)."""
    dimension, bit, words = planes(y)
    for k in range(len(words)):
        shared = np.bitwise_count(words[k] & words[k:]).sum(axis=1, dtype=np.int64)
        power = bit[k] + bit[k:]
        # Two planes of different bits of one dimension meet once here and twice in the product.
        twice = (dimension[k:] == dimension[k]) & (bit[k:] != bit[k])
        low, high = np.minimum(dimension[k], dimension[k:]), np.maximum(dimension[k], dimension[k:])
        np.add.at(into, (power // LIMB, low, high), shared * (1 << (power % LIMB) + twice))


@dataclass(frozen=True)
class Fit:
    """n; sums by dimension; product: n^2 times the covariance, whole numbers; values, falling, and their unit vectors as columns; trace."""

    n: int
    sums: list[int]
    least: list[int]
    product: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def usable(column: Column) -> Column:
    """Whether a vector has entries and none of them is null, NaN or infinite."""
    odd = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return column.isNotNull() & (F.size(column) > 0) & ~odd


def fit_rows(table: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, int]:
    """vec_id, v (doubles) of the rows that take part, and the dimension, that of most rows."""
    rows = pick(table, id_column, column).toDF("vec_id", "v")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v")).where(usable(F.col("v")))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return rows, 0
    if common.d > MOST_DIMENSIONS:
        raise ValueError(f"{common.d} dimensions are more than {MOST_DIMENSIONS}")
    return rows.where(F.size("v") == common.d), common.d


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, len(batch), CHUNK):
            yield whole(np.stack(batch["v"].to_numpy()[at : at + CHUNK]))


def _sums(rows: DataFrame, d: int) -> tuple[int, list[int], list[int]]:
    """n, sum and least x of each dimension."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums, least = 0, [0] * d, None
        for x in _chunks(batches):
            n += len(x)
            # Halves of the numbers can't overflow in a chunk.
            high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            sums = [s + (int(h) << 32) + int(w) for s, h, w in zip(sums, high, low, strict=True)]
            least = x.min(axis=0) if least is None else np.minimum(least, x.min(axis=0))
        if n:
            yield pd.DataFrame({"i": range(d), "n": n, "total": [str(s) for s in sums], "least": least})

    parts = rows.select("v").mapInPandas(run, "i int, n long, total string, least long")
    got = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.min("least").alias("least")).orderBy("i").collect()
    return (got[0].n if got else 0), [int(r.total) for r in got], [r.least for r in got]


def _scatter(rows: DataFrame, least: list[int]) -> np.ndarray:
    """The sums of products of x less its least, whole numbers without bounds."""
    d, low = len(least), np.array(least, np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        into = np.zeros((128 // LIMB + 1, d, d), np.int64)
        chunks = 0

        def out() -> pd.DataFrame:
            limb, i, j = np.nonzero(into)
            return pd.DataFrame({"limb": limb, "i": i, "j": j, "part": into[limb, i, j]})

        for x in _chunks(batches):
            scatter((x - low).astype(np.uint64), into)
            chunks += 1
            if chunks == 1 << 16:
                yield out()
                into[:], chunks = 0, 0
        yield out()

    parts = rows.select("v").mapInPandas(run, "limb int, i int, j int, part long")
    sums = parts.groupBy("limb", "i", "j").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part"))
    out = np.zeros((d, d), object)
    for r in sums.toLocalIterator():
        out[r.i, r.j] += int(r.part) << LIMB * r.limb
    return np.triu(out) + np.triu(out, 1).T


def fit(rows: DataFrame, d: int) -> Fit | None:
    """Exact sums and products of all rows and the eigenvectors of their covariance; None without rows."""
    n, sums, least = _sums(rows, d)
    if not n:
        return None
    shifted = np.array([s - n * m for s, m in zip(sums, least, strict=True)], object)
    # Shifting a dimension changes no centred product.
    product = n * _scatter(rows, least) - np.outer(shifted, shifted)
    covariance = np.array([[int(v) / (n * n) for v in line] for line in product], float).reshape(d, d)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")
    trace = int(sum(product[k, k] for k in range(d))) / (n * n)
    return Fit(n, sums, least, product, values[order], vectors[:, order], trace)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """The sum over dimensions of (n * x - S)^2 of each row, exact."""
    s = np.array(sums, object)
    low, high = int(x.min(initial=0)), int(x.max(initial=0))
    reach = max(max(abs(n * high - t), abs(n * low - t)) for t in sums)
    if reach * reach * len(sums) < 1 << 63 and max(abs(n * high), abs(n * low), *map(abs, sums)) < 1 << 63:
        off = n * x - np.array(sums, np.int64)
        return [int(v) for v in (off * off).sum(axis=1)]
    return [int((line * line).sum()) for line in (n * x.astype(object) - s)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n, from whole quotients and remainders, so that nothing cancels."""
    quotient = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n / n for s in sums])
    return (x - quotient).astype(np.float64) - rest


def whitened(table: DataFrame, components: int = 32, *, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation (decimal), whitened, explained, identity_error, for each row and component.

    Rows that are null, empty or hold null or non-finite entries take no part, nor do rows of another dimension than most
    rows'. Null ids and repeated rows are kept. Directions without spread have no component, so a table of equal vectors, of one or of
    none gives no rows. Entries beyond 2^55 count as 2^55; a deviation of more than 38 digits is null. Other columns are ignored. ``identity_error`` is taken from the whitened rows.
    """
    rows, d = fit_rows(table, id_column, column)
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double"
    model = fit(rows, d) if d else None
    spark = table.sparkSession
    kept = 0 if model is None else int((model.values > max(0.0, model.values[0]) * RANK * d).sum())
    k = min(components, kept)
    if not k:
        return spark.createDataFrame([], schema).withColumn("identity_error", F.lit(None).cast("double"))
    weights = model.vectors[:, :k] / np.sqrt(model.values[:k])
    explained = model.values[:k] / model.trace
    sent = spark.sparkContext.broadcast((model.n, model.sums, weights))

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums, w = sent.value
        count, mean, square = 0, np.zeros(k), np.zeros((k, k))
        for x in _chunks(batches):
            z = centred(x, n, sums) @ w
            own, apart = z.mean(axis=0), z.mean(axis=0) - mean
            square += (z - own).T @ (z - own) + np.outer(apart, apart) * (count * len(z) / (count + len(z)))
            mean += apart * (len(z) / (count + len(z)))
            count += len(z)
        if count:
            i, j = np.triu_indices(k)
            yield pd.DataFrame({"i": i, "j": j, "n": count, "square": square[i, j], "a": count * mean[i], "b": count * mean[j], "ab": count * mean[i] * mean[j]})

    parts = rows.select("v").mapInPandas(gather, "i int, j int, n long, square double, a double, b double, ab double")
    sums = [F.sum(c).alias(c) for c in ("n", "square", "a", "b", "ab")]
    got = parts.groupBy("i", "j").agg(*sums).collect()
    error = max(abs((r.square + r.ab) / r.n - r.a * r.b / r.n**2 - (r.i == r.j)) for r in got)

    def whiten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums, w = sent.value
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.iloc[at : at + 2048]
                x = whole(np.stack(part["v"].to_numpy()))
                z = centred(x, n, sums) @ w
                off = deviations(x, n, sums)
                yield pd.DataFrame(
                    {
                        "vec_id": part["vec_id"].astype("Int64").repeat(k).array,
                        "deviation": [str(v) if v < 10**38 else None for v in off for _ in range(k)],
                        "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(part)),
                        "whitened": z.reshape(-1),
                        "explained": np.tile(explained, len(part)),
                    }
                )

    out = rows.mapInPandas(whiten, "vec_id long, deviation string, component int, whitened double, explained double")
    return out.select(
        "vec_id", "component", F.lit(model.n).cast("long").alias("n"), F.col("deviation").cast("decimal(38,0)").alias("deviation"),
        "whitened", "explained", F.lit(float(error)).alias("identity_error"),
    )
