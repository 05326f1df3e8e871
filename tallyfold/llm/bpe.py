"""Byte-level BPE encoding by dynamic programming over prefixes, and decoding.

Every prefix of a piece of text has exactly one possible last token. The program walks the
piece once with an automaton over the vocabulary that names all tokens ending at a byte; of
these, that token is kept whose predecessor, the last token of the shorter prefix, may stand
next to it. Two tokens may stand next to each other when merging their joint bytes would not
join something across the border before it gives the two tokens. Back-pointers then yield the ids.

Text is first split as the vocabulary file says: special tokens, then the byte-level pattern.
Results of pieces are kept in a bounded memo per Python worker.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import Memo, kept, pick, read_vocabulary

#: The splitting pattern of byte-level BPE files.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space at which a text must not be cut: white space stands before it and it is not the last of its run.
_UNCUT = regex.compile(r"\s (?:\s|$)")
NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable ones for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


#: Ids, and the bytes that they decode to where those are not the text's own.
Encoded = str | tuple[str, bytes]


class Codec:
    """Encoder and decoder of one byte-level BPE file."""

    def __init__(self, file: str, memo: int = 280_000) -> None:
        spec = json.loads(file)
        model, letters = spec["model"], byte_letters()
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("not a byte-level BPE file")
        if spec["pre_tokenizer"].get("add_prefix_space") or not spec["pre_tokenizer"].get("use_regex", True):
            raise ValueError("only the standard splitting is supported")
        raw = {t: bytes(letters[c] for c in t) for t in model["vocab"] if all(c in letters for c in t)}
        ids = model["vocab"]
        self.special = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in spec.get("added_tokens", [])):
            raise ValueError("added tokens with their own white space rules are not supported")
        names = sorted(self.special, key=len, reverse=True)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.pieces = regex.compile(PIECES).findall

        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        # The two parts of each token, and the rank at which they are merged: one tuple serves both.
        self.rank, parts = {}, {}
        for r, (a, b) in enumerate(merges):
            pair = (ids[a], ids[b])
            self.rank[pair] = r
            parts.setdefault(ids[a + b], pair)
        self.bytes_of = {ids[t]: raw[t] for t in raw} | {i: s.encode() for s, i in self.special.items()}
        # The edges of a token while it is merged, flat: token, rank at which it is merged away, ..., outermost last.
        known = [*ids.values(), *self.special.values()]
        self.left = {t: self._edge(t, parts, 0) for t in known}
        self.right = {t: self._edge(t, parts, 1) for t in known}
        self.tokens = ahocorasick.Automaton()
        for t, b in raw.items():
            if len(b) == 1 or (ids[t] in parts and self.fits(*parts[ids[t]], own=self.rank[parts[ids[t]]])):
                self.tokens.add_word(b.decode("latin-1"), (ids[t], len(b)))
        self.tokens.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.words, self.chunks = Memo(memo), Memo(memo)

    def _edge(self, token: int, parts: dict, side: int) -> tuple[int, ...]:
        edge, gone = [], NEVER
        while True:
            edge += (gone, token)
            if token not in parts:
                return tuple(edge[::-1])
            gone = self.rank[parts[token]]
            token = parts[token][side]

    def fits(self, a: int, b: int, own: int = NEVER) -> bool:
        """Whether ``a`` and ``b`` stay apart (until rank ``own``) when their bytes are merged together.

        Walks the right edge of ``a`` and the left edge of ``b`` through the ranks. A pair of
        edges that exist at the same time and may merge before either is merged away joins the
        border; of equal ranks the left merge comes first.
        """
        right, left, i, j = self.right[a], self.left[b], 0, 0
        while True:
            x_gone, y_gone = right[i + 1], left[j + 1]
            r = self.rank.get((right[i], left[j]), NEVER)
            if r < x_gone and r <= y_gone and r < own:
                return False
            if x_gone == y_gone == NEVER:
                return True
            if x_gone <= y_gone:
                i += 2
            else:
                j += 2

    def piece(self, text: bytes) -> list[int]:
        """Ids of one piece."""
        size = len(text)
        token_at, start_of = [0] * (size + 1), [-1] * (size + 1)
        known = self.pairs.get
        for end, (token, width) in self.tokens.iter(text.decode("latin-1")):
            end += 1
            if start_of[end] >= 0:
                continue
            start = end - width
            if start:
                key = token_at[start] << 32 | token
                ok = known(key)
                if ok is None:
                    if len(self.pairs) >= 500_000:
                        self.pairs.clear()
                    ok = self.pairs[key] = self.fits(token_at[start], token)
                if not ok:
                    continue
            token_at[end], start_of[end] = token, start
        out = []
        while size:
            out.append(token_at[size])
            size = start_of[size]
        return out[::-1]

    def chunk(self, text: str) -> Encoded:
        """Comma-joined ids, with the bytes they decode to unless these are the text's own; kept in the memo."""
        got, pieces = [], self.pieces(text)
        for p in pieces:
            own = self.words.get(p)
            if own is None:
                raw = p.encode()
                ids = self.piece(raw)
                own, back = ",".join(map(str, ids)), b"".join([self.bytes_of[i] for i in ids])
                if back != raw:
                    own = (own, back)
                self.words.put(p, own)
            got.append(own)
        if len(got) > 1:
            if all([type(g) is str for g in got]):
                own = ",".join(got)
            else:
                full = [(g, p.encode()) if type(g) is str else g for g, p in zip(got, pieces, strict=True)]
                own = (",".join([g[0] for g in full]), b"".join([g[1] for g in full]))
            self.chunks.put(text, own)
        return own

    def encode(self, text: str) -> tuple[str, int, str]:
        """Comma-joined ids of a text, their number, and the text that they decode to."""
        ids, back, whole = [], [], True
        words, chunks = self.words, self.chunks
        parts = self.split_special.split(text) if self.split_special else [text]
        for k, part in enumerate(parts):
            if k % 2:
                ids.append(str(self.special[part]))
                back.append(part)
            elif part:
                for c in self.cut(part):
                    got = words.get(c) or chunks.get(c) or self.chunk(c)
                    if type(got) is str:
                        ids.append(got)
                        back.append(c)
                    else:
                        whole = False
                        ids.append(got[0])
                        back.append(got[1])
        if whole:
            decoded = "".join(back)
        else:
            decoded = b"".join([b.encode() if type(b) is str else b for b in back]).decode(errors="replace")
        joined = ",".join(ids)
        return joined, joined.count(",") + 1 if joined else 0, decoded

    @staticmethod
    def cut(text: str) -> list[str]:
        """Cuts before single spaces; no piece of the pattern reaches over such a cut."""
        if _UNCUT.search(text):
            return [text]
        head, *rest = text.split(" ")
        return [*([head] if head else []), *(" " + r for r in rest)]


def codec(file: str) -> Codec:
    """The codec of a file's text, kept in the Python worker until a task of another operator comes."""
    return kept(("bpe", len(file), hash(file)), lambda: Codec(file))


_ENCODED = "doc_id long, n_tokens long, ids string, decoded string"


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids (decimal, comma-joined), decoded.

    One row for each row of ``docs``; null text counts as empty: no tokens, two empty strings.
    Repeated rows and null ids are kept; columns other than doc_id and text are ignored.
    ``vocabulary`` is the path of a tokenizers file, read once on the driver.
    """
    sent = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary).decode())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(sent.value)
        for batch in batches:
            rows = [own.encode(t) if t else ("", 0, "") for t in batch["text"]]
            out = pd.DataFrame(rows, columns=["ids", "n_tokens", "decoded"], index=batch.index)
            out["doc_id"] = batch["doc_id"].astype("Int64")
            yield out

    return _texts(docs).mapInPandas(run, _ENCODED)


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """As ``encode``, with ids and decoded text as SHA-256 digests taken in the same pass."""
    sent = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary).decode())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(sent.value)
        for batch in batches:
            rows = []
            for t in batch["text"]:
                ids, n, back = own.encode(t) if t else ("", 0, "")
                rows.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"], index=batch.index)
            out["doc_id"] = batch["doc_id"].astype("Int64")
            yield out

    return _texts(docs).mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _texts(docs: DataFrame) -> DataFrame:
    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
