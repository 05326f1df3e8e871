"""Token counts of a unigram vocabulary: the best path's length, without the path.

An Aho-Corasick automaton names every vocabulary piece that ends at each character. The program
over end positions carries two numbers, the best score of a path to there and the number of its
pieces. Ties go as in the tokenizers library: of equally good last pieces the longest wins, a
later start replaces an earlier one only by a higher score. A character that no one-character
piece covers may be taken as unknown, at the lowest score of the vocabulary less 10, and counts
as its UTF-8 bytes where the vocabulary has byte pieces, else a run of unknowns as one.

Spaces become word marks; a mark is put before a text that doesn't begin with one. No piece holds a mark after
another character (this is checked), so each word is solved by itself, as part of the same best
path, and words are kept in a bounded memo per Python worker. That needs scores that are whole numbers,
for which sums don't depend on their order; the scores in the file are.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import Memo, pick, read_vocabulary

MARK = "▁"
#: Fixed value: how far below the lowest score an unknown character scores.
UNKNOWN_PENALTY = 10.0
_WORDS = regex.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall


def vocabulary(model: bytes) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file in the order of their ids."""
    m = sentencepiece.SentencePieceProcessor(model_proto=model)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size())]


class Counter:
    """Counts the pieces of the best path."""

    def __init__(self, pieces: list[tuple[str, float]], memo: int = 400_000) -> None:
        if any(MARK in p.lstrip(MARK) for p, _ in pieces):
            raise ValueError("a piece reaches over a word's start")
        if any(s != int(s) for _, s in pieces):
            raise ValueError("scores are not whole numbers")
        names = {p for p, _ in pieces}
        self.bytes_known = all(f"<0x{b:02X}>" in names for b in range(256))
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.single = {p for p in names if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for p, s in dict(reversed(pieces)).items():
            self.automaton.add_word(p, (len(p), s))
        self.automaton.make_automaton()
        self.memo = Memo(memo)

    def best(self, text: str) -> tuple[float, int]:
        """Best score and number of pieces of one word."""
        size = len(text)
        score: list[float | None] = [None] * (size + 1)
        count = [0] * (size + 1)
        strange = [False] * (size + 1)  # whether the best path ends in an unknown character
        score[0] = 0.0
        single = self.single

        def unknowns(upto: int) -> None:
            # Ends at which no piece ended, and unknown characters, come in the order of their ends.
            c = text[upto - 1]
            if c in single:
                return
            s = score[upto - 1] + self.unknown
            if score[upto] is None or s > score[upto]:
                n = len(c.encode(errors="replace")) if self.bytes_known else 0 if strange[upto - 1] else 1
                score[upto], count[upto], strange[upto] = s, count[upto - 1] + n, True

        done = 0
        for end, (width, own) in self.automaton.iter(text):
            end += 1
            while done < end - 1:
                done += 1
                unknowns(done)
            start = end - width
            s = score[start] + own
            if score[end] is None or s > score[end]:
                score[end], count[end], strange[end] = s, count[start] + 1, False
        while done < size:
            done += 1
            unknowns(done)
        return score[size], count[size]

    def count(self, text: str) -> int:
        """Number of pieces of a text; none for an empty one."""
        if not text:
            return 0
        marked = text.replace(" ", MARK)
        if not marked.startswith(MARK):
            marked = MARK + marked
        total, get = 0, self.memo.get
        for w in _WORDS(marked):
            n = get(w)
            if n is None:
                n = self.best(w)[1]
                self.memo.put(w, n)
            total += n
        return total


_COUNTERS: dict[int, Counter] = {}


def counter(model: bytes) -> Counter:
    """The counter of a file's bytes, kept for the life of the Python worker."""
    key = hash(model)
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = Counter(vocabulary(model))
    return _COUNTERS[key]


def token_counts(docs: DataFrame, model_file: str) -> DataFrame:
    """Per document: doc_id, n_tokens.

    One row for each row of ``docs``, repeated rows and null ids included; null and empty text
    have no tokens. Columns other than doc_id and text are ignored. Texts are read whole, in any length.
    """
    sent = docs.sparkSession.sparkContext.broadcast(read_vocabulary(model_file))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = counter(sent.value)
        for batch in batches:
            counts = [own.count(t) if t else 0 for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_tokens": counts}, index=batch.index)

    texts = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInPandas(run, "doc_id long, n_tokens long")
