"""Toxicity scores from a learned lexicon, its misspellings, and the context of each hit.

Learning reads a bounded sample of labelled rows. Words and word beginnings (stems) that occur
in toxic documents far more often than chance allows become the lexicon, a trie. A Levenshtein automaton for a
text's word, intersected with the trie, finds the terms within ``max_edits`` edits;
words whose ordinary neighbours are too often innocent are matched exactly only. Every hit is
weighed by a window around it: quotation marks, reply lines and words that report speech make it
a quotation, words that address the reader make it abuse. A logistic regression over sums of these weights gives
the score. Scoring is row by row; only the lexicon and the weights are broadcast.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm.common import Memo, cleared, pick, saved

_WORD = re.compile(r"[^\W_]+")
_QUOTES = re.compile(r"[\"“”«»„‟]")
#: Words that report what another said, and words that address the reader, in four languages.
REPORTING = frozenset("said says wrote writes called quote quoted quoting reported word dit écrit sagte schrieb dijo escribió".split())
ADDRESSING = frozenset("you your yours you're tu te toi vous votre du dich dein ihr euch tú ti usted ustedes eres".split())
STEMS = range(4, 8)
FEATURES = 7
TRAIN_TASKS = 24


@dataclass(frozen=True)
class Settings:
    """``train_rows`` bounds the labelled rows that are learned from, and by them the lexicon, which holds every term above the threshold."""

    train_rows: int = 20_000
    least_documents: int = 3
    least_precision: float = 0.6
    max_edits: int = 1
    shortest_misspelled: int = 5
    window: int = 8


class Automaton:
    """The Levenshtein automaton of a word, its states as bits.

    A state holds, for each number of edits, the lengths of the word's beginnings that what was
    read so far may stand for with so many edits.
    """

    def __init__(self, word: str, edits: int) -> None:
        self.edits, self.full, self.end = edits, (2 << len(word)) - 1, 1 << len(word)
        self.letters: dict[str, int] = {}
        for i, c in enumerate(word):
            self.letters[c] = self.letters.get(c, 0) | 1 << i

    def start(self) -> tuple[int, ...]:
        return tuple((2 << e) - 1 & self.full for e in range(self.edits + 1))

    def step(self, state: tuple[int, ...], letter: str) -> tuple[int, ...] | None:
        """The state after one more letter; None if no word within reach can follow."""
        same = self.letters.get(letter, 0)
        less, new = 0, 0
        out = []
        for e, now in enumerate(state):
            new = (now & same) << 1 | (less | less << 1 | new << 1 if e else 0)
            out.append(new & self.full)
            less = now
        return tuple(out) if out[-1] else None

    def distance(self, state: tuple[int, ...]) -> int | None:
        return next((e for e, now in enumerate(state) if now & self.end), None)


class Lexicon:
    """Words and stems with weights; words as a trie for misspellings."""

    def __init__(self, terms: list[tuple[str, bool, float]], settings: Settings, exact_only: frozenset[str] = frozenset()) -> None:
        self.settings = settings
        self.words = {t: w for t, stem, w in terms if not stem}
        self.stems = {t: w for t, stem, w in terms if stem}
        # Terms and reversed terms; one edit leaves one half of a term as it is, by which a walk may enter.
        self.tries: tuple[dict, dict] = ({}, {})
        self.halves: dict[int, tuple[set[str], set[str]]] = {}
        for t in self.words:
            if len(t) >= settings.shortest_misspelled and t not in exact_only:
                for trie, letters in zip(self.tries, (t, t[::-1]), strict=True):
                    for c in letters:
                        trie = trie.setdefault(c, {})
                    trie[""] = t
                heads, tails = self.halves.setdefault(len(t), (set(), set()))
                heads.add(t[: len(t) // 2])
                tails.add(t[len(t) // 2 :][::-1])
        self.memo = Memo(100_000)
        self.innocent: set[str] = set()

    def misspelled(self, word: str) -> list[tuple[int, str]]:
        """(edits, term) for the terms within reach of the word: the automaton and a trie walked together.

        With one edit the walk goes down the halves of terms that the word begins or ends with and
        branches below them only; with more it begins at the root.
        """
        s = self.settings
        if len(word) + s.max_edits < s.shortest_misspelled:
            return []
        if s.max_edits != 1:
            return sorted(self._walk(word, 0, {""}))
        found: set[tuple[int, str]] = set()
        for side, letters in enumerate((word, word[::-1])):
            entries = set()
            for size in range(len(word) - 1, len(word) + 2):
                ends = self.halves.get(size)
                if ends:
                    half = letters[: size // 2 if side == 0 else size - size // 2]
                    if half in ends[side]:
                        entries.add(half)
            if entries:
                found |= self._walk(letters, side, entries)
        return sorted(found)

    def _walk(self, letters: str, side: int, entries: set[str]) -> set[tuple[int, str]]:
        automaton = Automaton(letters, self.settings.max_edits)
        found, stack = set(), []
        for entry in entries:
            node, state = self.tries[side], automaton.start()
            for c in entry:
                node, state = node[c], automaton.step(state, c)
            stack.append((node, state))
        while stack:
            node, state = stack.pop()
            for letter, child in node.items():
                if letter == "":
                    d = automaton.distance(state)
                    if d is not None:
                        found.add((d, child))
                elif (after := automaton.step(state, letter)) is not None:
                    stack.append((child, after))
        return found

    def hits(self, words: list[str]) -> bool:
        """Whether any of the words is in the lexicon or near it; innocent ones are remembered, a bounded number."""
        new = set(words) - self.innocent
        if not new:
            return False
        bad = [w for w in new if self.look_up(w)]
        # Both bounds hold its bytes below some 15 MB; a long word is looked up each time, which is quick.
        if len(self.innocent) > 100_000:
            self.innocent.clear()
        self.innocent.update(w for w in new.difference(bad) if len(w) <= 32)
        return bool(bad)

    def look_up(self, word: str) -> tuple[float, int, str] | tuple[()]:
        """Weight, kind (0 word, 1 stem, 2 misspelling) and term of a word; nothing where it is innocent."""
        got = self.memo.get(word)
        if got is None:
            got = self._look_up(word)
            if got:
                self.memo.put(word, got)
        return got

    def _look_up(self, word: str) -> tuple[float, int, str] | tuple[()]:
        if word in self.words:
            return (self.words[word], 0, word)
        for k in reversed(STEMS):
            if k < len(word) and word[:k] in self.stems:
                return (self.stems[word[:k]], 1, word[:k])
        near = self.misspelled(word)
        return (self.words[near[0][1]], 2, near[0][1]) if near else ()


def quoted(text: str, at: int) -> bool:
    """Whether a place in a text stands in quotation marks opened on its line, or in a reply line."""
    start = text.rfind("\n", 0, at) + 1
    if text[start:at].lstrip()[:1] == ">":
        return True
    marks = _QUOTES.findall(text, start, at)
    end = text.find("\n", at)
    return len(marks) % 2 == 1 and bool(_QUOTES.search(text, at, end if end >= 0 else len(text)))


def features(lexicon: Lexicon, text: str | None) -> list[float]:
    """Sums of weighed hits by kind, the strongest hit, hits a word, quoted hits, different terms."""
    out = [0.0] * FEATURES
    low = text.lower() if text else ""
    words = _WORD.findall(low)
    if not lexicon.hits(words):
        return out
    look = lexicon.look_up
    terms, hits, width = set(), 0, lexicon.settings.window
    for k, m in enumerate(_WORD.finditer(low)):
        hit = look(m[0])
        if not hit:
            continue
        weight, kind, term = hit
        near = words[max(0, k - width) : k + width + 1]
        in_quotes = quoted(low, m.start())
        context = 1.0 + 0.5 * (not ADDRESSING.isdisjoint(near)) - 0.7 * in_quotes - 0.3 * (not REPORTING.isdisjoint(near))
        weighed = weight * max(0.1, context)
        out[kind] += weighed
        out[3] = max(out[3], weighed)
        out[5] += in_quotes
        hits += 1
        terms.add(term)
    out[4] = 100.0 * hits / len(words)
    out[6] = float(len(terms))
    return [math.log1p(x) for x in out]


@dataclass
class Model:
    lexicon: list[tuple[str, bool, float]] = field(default_factory=list)
    exact_only: frozenset[str] = frozenset()
    weights: tuple[float, ...] = ()
    settings: Settings = field(default_factory=Settings)

    def score(self, x: list[float]) -> float:
        """Between 0 and 1; 0 where nothing toxic was learned from."""
        if not self.weights:
            return 0.0
        z = self.weights[-1] + sum(w * v for w, v in zip(self.weights, x, strict=False))
        return 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, z))))


def _terms(rows: DataFrame, least: int) -> DataFrame:
    """term, stem, bad, good: documents that hold each word or beginning, by label. Counts are summed per batch first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cleared()
        for batch in batches:
            counts = (Counter(), Counter())
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                words = set(_WORD.findall(text.lower())) if text else set()
                stems = {(w[:k], True) for w in words for k in STEMS if k < len(w)}
                counts[bool(toxic)].update(stems)
                counts[bool(toxic)].update((w, False) for w in words)
            keys = list(counts[0].keys() | counts[1].keys())
            yield pd.DataFrame(
                {"term": [k[0] for k in keys], "stem": [k[1] for k in keys], "bad": [counts[1][k] for k in keys], "good": [counts[0][k] for k in keys]}
            )

    sums = rows.mapInPandas(run, "term string, stem boolean, bad long, good long")
    return sums.groupBy("term", "stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where(f"bad + good >= {least}")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights and intercept of a ridge logistic regression by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(labelled: DataFrame, settings: Settings | None = None) -> Model:
    """A model from rows of text and toxic (0 or 1), at most ``settings.train_rows`` of them.

    The caller bounds the rows (see ``sample``). Rows with a null label are left out, null texts
    count as empty. Without toxic or without other rows the model scores everything 0.
    """
    settings = settings or Settings()
    rows = pick(labelled, "text", "toxic").where("toxic is not null").limit(settings.train_rows)
    # Of near copies few are learned from, so that their rare words don't look toxic: copies mostly share
    # the three words of the smallest hash. A limit leaves one partition; the rows are dealt out again.
    triple = "xxhash64(w[i], get(w, i + 1), get(w, i + 2))"
    least = F.expr(f"array_min(transform(sequence(0, greatest(size(w) - 3, 0)), i -> {triple}))")
    rows = rows.withColumn("w", F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+")).withColumn("copies", least)
    rows = rows.dropDuplicates(["copies", "toxic"]).drop("copies", "w")
    rows = saved(rows.repartition(TRAIN_TASKS, F.xxhash64("text")), "toxicity-rows")
    n = {r.toxic: r["count"] for r in rows.groupBy((F.col("toxic") > 0).alias("toxic")).count().collect()}
    bad, good = n.get(True, 0), n.get(False, 0)
    if not bad or not good:
        return Model(settings=settings)
    terms = saved(_terms(rows, settings.least_documents), "toxicity-terms")
    # The log-likelihood ratio of a term against chance; over so many terms the threshold keeps about one chance hit.
    share = bad / (bad + good)
    ratio = 2 * (
        F.col("bad") * F.log(F.greatest(F.col("bad"), F.lit(1e-9)) / ((F.col("bad") + F.col("good")) * share))
        + F.col("good") * F.log(F.greatest(F.col("good"), F.lit(1e-9)) / ((F.col("bad") + F.col("good")) * (1 - share)))
    )
    weight = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    least = 2 * math.log(max(2, terms.count()))
    chosen = (
        terms.where(F.col("bad") >= settings.least_precision * (F.col("bad") + F.col("good")))
        .select("term", "stem", weight.alias("weight"), ratio.alias("ratio"))
        .where((F.col("weight") > 0) & (F.col("ratio") >= least))
        .orderBy(F.desc("ratio"), "term", "stem")
        .collect()
    )
    lexicon = [(r.term, r.stem, r.weight) for r in chosen]
    spark = labelled.sparkSession
    sent = spark.sparkContext.broadcast((lexicon, settings))

    def neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cleared()
        own = Lexicon(*sent.value)
        for batch in batches:
            out = []
            for term, b, g in batch[["term", "bad", "good"]].itertuples(index=False):
                hit = own.look_up(term)
                if hit and hit[1] == 2:
                    out.append((hit[2], b, g))
            yield pd.DataFrame(out, columns=["term", "bad", "good"])

    near = terms.where("not stem").select("term", "bad", "good").mapInPandas(neighbours, "term string, bad long, good long")
    innocent = near.groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where("good > bad").collect()
    model = Model(lexicon, frozenset(r.term for r in innocent), (), settings)
    sent_model = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cleared()
        m = sent_model.value
        own = Lexicon(m.lexicon, m.settings, m.exact_only)
        for batch in batches:
            yield pd.DataFrame({"x": [features(own, t) for t in batch["text"]], "y": (batch["toxic"] > 0).astype(float)})

    got = rows.mapInPandas(measure, "x array<double>, y double").collect()
    x, y = np.array([r.x for r in got], float).reshape(-1, FEATURES), np.array([r.y for r in got])
    order = np.lexsort((*x.T, y))  # the sums' order, and so the weights, don't depend on the partitions
    model.weights = tuple(fit_logistic(x[order], y[order]))
    return model


def sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """text, toxic of at most ``rows`` labelled documents, chosen by a hash of the id.

    A document with several labels is toxic if one says so; labels of unknown documents and null ids are left out.
    """
    chosen = pick(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return pick(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row of ``docs`` from its whole text; null text counts as empty.

    Repeated rows and null ids are kept, other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cleared()
        m = sent.value
        own = Lexicon(m.lexicon, m.settings, m.exact_only)
        for batch in batches:
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"].astype("Int64"), "score": [m.score(features(own, t)) for t in batch["text"]]}, index=batch.index
            )

    texts = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInPandas(run, "doc_id long, score double")


def score_of(model: Model, spark: SparkSession, text: Column) -> Column:
    """The score as a column beside the row: only the text travels to Python, and no row is shuffled."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cleared()
        m = sent.value
        own = Lexicon(m.lexicon, m.settings, m.exact_only)
        for texts in batches:
            yield pd.Series([m.score(features(own, t)) for t in texts], dtype=float)

    return run(text)


#: The fold that is held out of learning, of four by the checksum of the id's text.
HELD_OUT = 2
LEAST_SCORE = 0.3


def fold():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))


def held_out_scores(docs: DataFrame, labels: DataFrame, text_of_labels: DataFrame | None = None, settings: Settings | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted, learned from labels outside the held-out fold.

    ``text_of_labels`` holds the texts to learn from, ``docs`` if left out. A null id is not held out.
    """
    settings = settings or Settings()
    known = pick(labels, "doc_id", "toxic").where(fold() != HELD_OUT)
    model = train(sample(text_of_labels if text_of_labels is not None else docs, known, settings.train_rows), settings)
    out = scores(docs, model)
    held = F.coalesce(fold() == HELD_OUT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted"))
