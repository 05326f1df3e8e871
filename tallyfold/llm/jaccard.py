"""Similarity join on word shingles by token-combination prefixes: components of near copies.

A document's set holds the 64-bit hashes of its distinct shingles. Documents with one set are
one node (the node id is a 64-bit digest of the set). Then

1. A first sieve in the order of hash values: of a linked pair, both sets have shared tokens
   among a certain share of their smallest tokens. Sets without enough such tokens are alone.
2. The rest is ordered by document frequency, rarest first. Two sets that overlap enough share
   at least k tokens of their prefixes extended by k - 1. Rare tokens of the extended prefix
   are index keys by themselves; of frequent tokens (above ``frequent_df``) each combination of
   two is a key. Either kind finds every pair that shares two prefix tokens.
3. All sets of a key are verified against the key's leader, the set with the smallest share of
   tokens of its own, and the links give first components. Only pairs of one leader's sets in different
   components, whose overlaps with the leader and token buckets still allow enough overlap, are verified after that. So no link between
   components is lost, and pairs inside a component found already are never made. A pair is met once for each leader
   that both sets have, however many keys they share.

Intersections are exact on the hashes. Everything but hashing runs as joins and aggregates.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import cleared, pick, saved

#: Sets up to so many are sent to all executors as 8-byte keys (64 MB); more are joined by shuffle.
BROADCAST_KEYS = 4_000_000
#: One more token of the sieve's prefix is asked for with each so many tokens of a set.
SIEVE = 20
#: Bytes of text that are hashed at once, and places in a word that have random numbers of their own.
PIECE, PLACES = 1 << 15, 64
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def least_overlap(size: int, percent: int) -> int:
    """The smallest intersection that a set of ``size`` has with any set linked to it."""
    return -(-percent * size // 100)


class Shingler:
    """Sorted 64-bit hashes of the distinct shingles of texts.

    A word's hash is the sum of random numbers, one for each byte and its place in the word, so
    the words of many texts are hashed by a few passes over their bytes.
    """

    def __init__(self, width: int = 5) -> None:
        self.width = width
        self.space = np.zeros(256, bool)
        self.space[[0x20, *range(0x09, 0x0E)]] = True
        self.numbers = np.random.default_rng(6).integers(0, 1 << 64, (PLACES, 256), np.uint64)
        self.numbers[:, 65:91] = self.numbers[:, 97:123]
        self.numbers[:, self.space] = 0

    def _words(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of ``data``, which ends with a space, and where they begin."""
        raw = np.frombuffer(data, np.uint8)
        space = self.space[raw]
        edges = np.flatnonzero(np.diff(space, prepend=True))
        begin = edges[0::2]
        if not len(begin):
            return np.empty(0, np.uint64), begin
        raw = raw[begin[0] :]
        place = np.arange(len(raw)) - np.repeat(begin - begin[0], np.diff(begin, append=len(data)))
        number = self.numbers.reshape(-1).take((place % PLACES << 8) | raw)
        if (edges[1::2] - begin).max() > PLACES:
            # Beyond the table's places its numbers come again, times a power of an odd number.
            number *= np.uint64(0xD6E8FEB86659FD93) ** (place // PLACES).astype(np.uint64)
        return np.add.reduceat(number, begin - begin[0]), begin

    def _mixed(self, h: np.ndarray, width: int) -> np.ndarray:
        """Hashes of each ``width`` words that follow one another."""
        out = np.full(max(0, len(h) - width + 1), width, np.uint64)
        for k in range(width):
            out ^= h[k : k + len(out)]
            out *= np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
        return out.view(np.int64)

    def _together(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        data = b" ".join([*texts, b""])
        # A long text is cut where a word ends.
        cuts, hashes, begins = [0], [], []
        while cuts[-1] < len(data):
            end = SPACE.search(data, min(cuts[-1] + 2 * PIECE, len(data)) - 1).end()
            h, begin = self._words(data[cuts[-1] : end])
            hashes.append(h)
            begins.append(begin + cuts[-1])
            cuts.append(end)
        h, begin = np.concatenate(hashes), np.concatenate(begins)
        mixed = self._mixed(h, self.width)
        start = 0
        for end in np.searchsorted(begin, np.cumsum([len(t) + 1 for t in texts])).tolist():
            n = end - start
            s = np.sort(mixed[start : end - self.width + 1] if n >= self.width else self._mixed(h[start:end], n) if n else mixed[:0])
            yield s[np.diff(s, prepend=s[:1] - 1) != 0]
            start = end

    def __call__(self, texts: Iterable[bytes | None]) -> Iterator[np.ndarray]:
        """The sets of the texts, in order."""
        held, size = [], 0
        for text in texts:
            held.append(text or b"")
            size += len(held[-1])
            if size >= PIECE:
                yield from self._together(held)
                held, size = [], 0
        if held:
            yield from self._together(held)


def _hashed(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, key (of the row's id and text), n, node, prefix (of the sieve)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cleared()
        shingle = Shingler(width)
        for batch in batches:
            rows = []
            for s in shingle(batch["text"]):
                n = len(s)
                head = s[: n - least_overlap(n, percent) + 1 + n // SIEVE] if n else s
                node = xxhash.xxh3_64_intdigest(s.tobytes())
                rows.append((n, node - (1 << 64) if node >> 63 else node, head))
            out = pd.DataFrame(rows, columns=["n", "node", "prefix"], index=batch.index)
            out["doc_id"], out["key"] = batch["doc_id"].astype("Int64"), batch["key"]
            yield out

    return _texts(docs).mapInPandas(run, "doc_id long, key long, n long, node long, prefix array<long>")


def _texts(docs: DataFrame) -> DataFrame:
    return pick(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("key"), F.col("text").cast("binary").alias("text")
    )


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """node, n, tokens, parity (a bit for each of 1024 buckets: whether it holds an odd number of tokens) of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cleared()
        shingle = Shingler(width)
        for batch in batches:
            sets = list(shingle(batch["text"]))
            parity = [np.packbits(np.bincount(s & 1023, minlength=1024).astype(np.uint8) & 1).view(np.int64) for s in sets]
            yield pd.DataFrame({"node": batch["node"], "n": [len(s) for s in sets], "tokens": sets, "parity": parity}, index=batch.index)

    return docs.mapInPandas(run, "node long, n long, tokens array<long>, parity array<long>")


def _sieve(hashed: DataFrame, percent: int) -> DataFrame:
    """node, key: one row of each set that may have a link."""
    nodes = hashed.where("n > 1").groupBy("node").agg(F.count("*").alias("copies"), F.min("key").alias("key"), F.first("n").alias("n"))
    tokens = hashed.where("n > 1").select("node", F.explode("prefix").alias("token"))
    w = Window.partitionBy("token")
    shared = tokens.select("node", (F.min("node").over(w) != F.max("node").over(w)).alias("shared")).where("shared")
    counts = shared.groupBy("node").agg(F.count("*").alias("shared"))
    # A partner has at least least_overlap(n) tokens and so extends its own prefix by a part of that.
    need = F.expr(f"1 + (({percent} * n + 99) div 100) div {SIEVE}")
    return counts.join(nodes, "node").where(F.col("shared") >= F.col("copies") * need).select("node", "key")


def _postings(sets: DataFrame, percent: int, frequent_df: int) -> DataFrame:
    """key, node, share (of its tokens, those that no other set has)."""
    tokens = sets.select("node", "n", F.explode("tokens").alias("token"))
    w = Window.partitionBy("token")
    tokens = tokens.withColumn("df", F.count("*").over(w)).where("df > 1")
    ordered = tokens.groupBy("node").agg(F.first("n").alias("n"), F.count("*").alias("shared"), F.sort_array(F.collect_list(F.struct("df", "token"))).alias("tokens"))
    ordered = ordered.where(f"100 * shared >= {percent} * n").withColumn("own", F.col("n") - F.col("shared"))
    # The prefix for one shared token and its extension for two, less the tokens that nobody shares, which come first.
    reach = F.expr(f"cast(n - ({percent} * n + 99) div 100 + 2 - own as int)")
    ordered = ordered.withColumn("reach", reach).where("reach > 0")
    ordered = ordered.withColumn("head", F.slice("tokens", F.lit(1), F.col("reach"))).drop("tokens")
    single = F.expr(f"transform(filter(head, t -> t.df <= {frequent_df}), t -> t.token)")
    ordered = ordered.withColumn("many", F.expr(f"transform(filter(head, t -> t.df > {frequent_df}), t -> t.token)"))
    pairs = F.expr("flatten(transform(many, (a, i) -> transform(slice(many, i + 2, size(many)), b -> xxhash64(a, b))))")
    return ordered.select(F.explode(F.concat(single, pairs)).alias("key"), "node", (F.col("own") / F.col("n")).alias("share"))


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, na, nb (sizes of both sets), common (size of the intersection)."""
    a = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    b = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", F.size(F.array_intersect("ta", "tb")).alias("common"))


def _met(star: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: the sets of one leader that are in different components and may be similar enough, of which one is not in the leader's."""
    to = found.withColumnRenamed("component", "to")
    rest = star.join(to.withColumnRenamed("node", "a"), "a", "left").join(found.withColumnRenamed("node", "b"), "b", "left")
    rest = rest.select("b", F.col("a").alias("node"), F.col("na").alias("n"), "common", F.coalesce("to", "a").alias("to"), F.coalesce("component", "b").alias("head"))
    far = rest.where("to <> head")
    # Without sets outside of its component a leader has no pairs.
    rest = rest.join(far.select("b").distinct(), "b").join(sets.select("node", "parity"), "node")
    a = rest.where("to <> head").selectExpr("b as lead", "node as a", "n as na", "common as oa", "to as ca", "parity as pa")
    b = rest.selectExpr("b as lead", "node as b", "n as nb", "common as ob", "to as cb", "to <> head as also", "parity as pb")
    # What two sets can share at most, inside and outside of the leader's.
    most = "(least(oa, ob) + least(na - oa, nb - ob))"
    enough = f"100 * {most} >= {percent} * (na + nb - {most})"
    # Buckets of odd difference hold at least a token that only one of the sets has.
    apart = " + ".join(f"bit_count(pa[{k}] ^ pb[{k}])" for k in range(16))
    close = f"100 * (na + nb - ({apart})) >= {percent} * (na + nb + ({apart}))"
    return a.join(b, "lead").where(f"ca <> cb and (not also or a < b) and {enough} and {close}").select("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of an undirected graph of links a, b.

    Every round passes the smallest component known to the neighbours and then to what
    points at them; rounds are written, so their plans don't grow.
    """
    edges = saved(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    state = saved(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "components")
    while True:
        near = edges.join(state.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        met = state.join(near, "node", "left").select("node", F.least("component", "near").alias("to"), F.col("component").alias("before"))
        ahead = state.select(F.col("node").alias("to"), F.col("component").alias("next"))
        new = saved(met.join(ahead, "to", "left").select("node", F.least("to", "next").alias("component"), "before"), "components")
        if not new.where("component <> before").limit(1).count():
            return new.select("node", "component")
        state = new.select("node", "component")


def near_copies(docs: DataFrame, *, percent: int = 80, width: int = 5, frequent_df: int = 1024) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id.

    Documents link when 100 * intersection >= percent * union of their shingle sets; the
    component is the smallest doc_id that links reach, the document's own included. One row for each row of
    ``docs``. Documents without words (or null text) have the empty set and stay alone; with
    fewer words than ``width`` the whole sequence is the one shingle. Rows that repeat an id are
    documents of their own. A null id is never a component's id unless no other is there. Other
    columns are ignored; an empty table gives no rows.
    """
    hashed = saved(_hashed(docs, width, percent), "shingles")
    active = saved(_sieve(hashed, percent), "sieve")
    if active.count() <= BROADCAST_KEYS:
        rows = _texts(docs).join(F.broadcast(active), "key")
    else:
        rows = _texts(docs).join(active, "key")
    sets = saved(_sets(rows, width).dropDuplicates(["node"]), "sets")
    postings = saved(_postings(sets, percent, frequent_df), "postings")
    lead = postings.groupBy("key").agg(F.min(F.struct("share", "node")).alias("lead"), F.count("*").alias("size"))
    lead = lead.where("size > 1").select("key", F.col("lead.node").alias("lead"))
    star = postings.join(lead, "key").where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct()
    star = saved(_overlaps(star, sets), "star")
    similar = f"100 * common >= {percent} * (na + nb - common)"
    links = star.where(similar).select("a", "b")
    met = _overlaps(_met(star, components(links), sets, percent), sets)
    links = links.union(saved(met.where(similar).select("a", "b"), "cross"))
    found = components(links)

    own = hashed.select("doc_id", "n", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = own.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    full = own.where("n > 0").join(ids, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = hashed.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.union(alone)
