"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The alphabet is the word. For every pattern length there is one shift table over blocks of
``block`` words: a block that occurs in no pattern lets the search skip ahead by the whole
pattern length less the block, other blocks by their smallest distance from a pattern's end.
Where the shift is zero, the bucket of that last block is asked for patterns that begin with
the words standing there, and these are compared directly.

Documents are searched row by row, so no text is shuffled and frequent passages cost no more
than rare ones. Patterns are broadcast in blocks of items of a stated size; more items mean
more passes, each of which adds to the hits of the one before.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.llm.common import cleared, pick, saved

#: Bytes that belong to a word after lower-casing A-Z: 0-9, a-z and everything outside ASCII.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text; none for null."""
    return text.translate(_TABLE).split() if text else []


class WuManber:
    """Search tables for word patterns, each with the ids of the items that hold it."""

    def __init__(self, patterns: dict[tuple[bytes, ...], frozenset[str]], block: int = 2) -> None:
        self.groups = []
        lengths: dict[int, list[tuple[bytes, ...]]] = {}
        for p in patterns:
            lengths.setdefault(len(p), []).append(p)
        for m, group in sorted(lengths.items()):
            b = min(block, m)
            shift: dict[bytes, int] = {}
            buckets: dict[bytes, dict[bytes, list]] = {}
            for p in group:
                for end in range(b, m + 1):
                    key = b" ".join(p[end - b : end])
                    shift[key] = min(shift.get(key, m), m - end)
                buckets.setdefault(b" ".join(p[m - b :]), {}).setdefault(b" ".join(p[:b]), []).append(
                    (list(p), patterns[p])
                )
            self.groups.append((m, b, shift, buckets))

    def search(self, text: list[bytes], hit: bytearray) -> set[str]:
        """Marks the words of ``text`` inside occurrences in ``hit``; the ids that occur."""
        found: set[str] = set()
        n = len(text)
        for m, b, shift, buckets in self.groups:
            free, at = m - b + 1, m
            step = shift.get
            while at <= n:
                last = text[at - 2] + b" " + text[at - 1] if b == 2 else b" ".join(text[at - b : at])
                skip = step(last, free)
                if skip:
                    at += skip
                    continue
                bucket = buckets[last]
                tests = bucket.get(b" ".join(text[at - m : at - m + b]))
                if tests:
                    here = text[at - m : at]
                    for pattern, ids in tests:
                        if pattern == here:
                            found |= ids
                            hit[at - m : at] = b"\x01" * m
                at += 1
        return found


def windows(item: list[bytes], width: int) -> Iterator[tuple[bytes, ...]]:
    """All runs of ``width`` words; the whole item where it has fewer, none where it has none."""
    if item and len(item) < width:
        yield tuple(item)
    for k in range(len(item) - width + 1):
        yield tuple(item[k : k + width])


def _items(benchmark: DataFrame, pass_bytes: int) -> tuple[DataFrame, int]:
    """item_id, text of the items that mark anything, and the number of passes that they need."""
    items = pick(benchmark, "item_id", "text").where("item_id is not null and text is not null")
    items = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return items, max(1, math.ceil(total / pass_bytes))


def _patterns(items: DataFrame, k: int, passes: int, width: int) -> dict[tuple[bytes, ...], frozenset[str]]:
    """The windows of the items of pass ``k`` with the ids of the items that hold them."""
    patterns: dict[tuple[bytes, ...], set[str]] = {}
    for row in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).collect():
        for w in windows(words(bytes(row.text)), width):
            patterns.setdefault(w, set()).add(row.item_id)
    return {p: frozenset(i) for p, i in patterns.items()}


_FOUND = [
    T.StructField("doc_id", T.LongType()),
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("hits", T.BinaryType()),
    T.StructField("items", T.ArrayType(T.StringType())),
]


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, *, width: int = 13, block: int = 2, pass_bytes: int = 16 << 20
) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, hits (a byte for each word, 1 inside an occurrence), items (sorted ids).

    One row for each row of ``docs``, repeated rows and null ids included. Null or empty text
    has no words. Benchmark rows with a null id or without words mark nothing; rows of one id
    count as one item. An empty benchmark marks nothing. Other columns of either table are
    ignored. ``pass_bytes`` bounds the item text that one pass broadcasts.
    """
    spark = docs.sparkSession
    items, passes = _items(benchmark, pass_bytes)
    state = pick(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("binary").alias("text"),
        F.lit(None).cast("binary").alias("hits"),
        F.expr("cast(array() as array<string>)").alias("items"),
    )
    for k in range(passes):
        last = k == passes - 1
        sent = spark.sparkContext.broadcast(_patterns(items, k, passes, width))

        def search(batches: Iterator[pd.DataFrame], sent=sent, last=last) -> Iterator[pd.DataFrame]:
            cleared()
            tables = WuManber(sent.value, block)
            for batch in batches:
                rows = []
                for text, before, known in zip(batch["text"], batch["hits"], batch["items"], strict=True):
                    own = words(text)
                    hit = bytearray(before) if before is not None else bytearray(len(own))
                    found = tables.search(own, hit)
                    rows.append((len(own), hit.count(1), bytes(hit), sorted(found.union(known))))
                out = pd.DataFrame(rows, columns=["n_words", "n_hit", "hits", "items"], index=batch.index)
                out["doc_id"] = batch["doc_id"].astype("Int64")
                if not last:
                    out["text"] = batch["text"]
                yield out

        schema = T.StructType(_FOUND if last else [*_FOUND, T.StructField("text", T.BinaryType())])
        state = state.mapInPandas(search, schema)
        if passes > 1:
            state = saved(state, "decontamination")
    return state


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A document is contaminated when at least one word is hit and the hit words are at least a
    twentieth of its words.
    """
    return find_contamination(docs, benchmark, **options).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        F.expr("n_hit > 0 and 20 * n_hit >= n_words").alias("contaminated"),
    )


def _marks(texts: pd.Series, hits: pd.Series, tables: WuManber) -> list[bytearray]:
    """The hits of each text after one pass, from those before."""
    out = []
    for t, before in zip(texts, hits, strict=True):
        own = words(t)
        hit = bytearray(before) if before is not None else bytearray(len(own))
        tables.search(own, hit)
        out.append(hit)
    return out


def _searcher(sent: Broadcast, block: int) -> Callable[..., Column]:
    """hits of a text after one pass, from the text and its hits before."""

    @F.pandas_udf("binary")
    def search(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        cleared()
        tables = WuManber(sent.value, block)
        for texts, hits in batches:
            yield pd.Series([bytes(h) for h in _marks(texts, hits, tables)], dtype=object)

    return search


def _judge(sent: Broadcast, block: int) -> Callable[..., Column]:
    """Whether the rule accuses a text after the last pass; one Python worker a task does both."""

    @F.pandas_udf("boolean")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        cleared()
        tables = WuManber(sent.value, block)
        for texts, hits in batches:
            yield pd.Series([h.count(1) > 0 and 20 * h.count(1) >= len(h) for h in _marks(texts, hits, tables)], dtype=bool)

    return judge


def clean(rows: DataFrame, benchmark: DataFrame, *, text: str = "text", width: int = 13, block: int = 2, pass_bytes: int = 16 << 20) -> DataFrame:
    """The rows of ``rows``, with all their columns, that the contamination rule does not accuse; names must not clash.

    Only the text and the hits so far travel to Python; rows stay where they are and none is shuffled.
    """
    items, passes = _items(benchmark, pass_bytes)
    marked = rows.withColumn("_hits", F.lit(None).cast("binary"))
    for k in range(passes):
        sent = rows.sparkSession.sparkContext.broadcast(_patterns(items, k, passes, width))
        given = (F.col(text).cast("binary"), F.col("_hits"))
        if k == passes - 1:
            return marked.where(~_judge(sent, block)(*given)).drop("_hits")
        marked = saved(marked.withColumn("_hits", _searcher(sent, block)(*given)), "decontamination")
