import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer, models, pre_tokenizers

from tallyfold.llm import bpe, unigram

from .helpers import docs

LETTERS = "aaab ee  \n\t'sst.,!é漢字🙂 　x1２٣\r\x00\x85 ﬁ‍▁<s>"


def texts():
    rnd = random.Random(1)
    hard = ["", "<|endoftext|>", "a<|endoftext|> b", "a   b", "\n  x", "  ", "a  ", "a" * 50, "  a\n\n b", "don't  we'll", "▁x", "<s>x</s>"]
    return hard + ["".join(rnd.choice(LETTERS) for _ in range(rnd.randint(1, 60))) for _ in range(1500)] + ["long wörd 123 " * 4000]


def test_bpe_equals_library_and_round_trips(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = list(enumerate(texts())) + [(None, "no id"), (0, "again"), (7000, None)]
    plain = Tokenizer.from_file(path)
    want = []
    for i, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids
        back = plain.decode(ids, skip_special_tokens=False)
        assert back == (t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    got = [tuple(r) for r in bpe.digests(docs(spark, rows), path).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    full = bpe.encode(docs(spark, [(1, "a b"), (2, None)]), path).orderBy("doc_id").collect()
    assert (full[0].decoded, full[1].ids, full[1].n_tokens) == ("a b", "", 0)
    assert bpe.digests(docs(spark, []), path).count() == 0


def test_every_whole_token_is_its_own_encoding():
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = bpe.Codec(open(path, encoding="utf-8").read())
    rnd = random.Random(2)
    for t in rnd.sample(sorted(own.bytes_of), 3000):
        if t in own.special.values():
            continue
        assert b"".join(own.bytes_of[i] for i in own.piece(own.bytes_of[t])) == own.bytes_of[t]


def test_unigram_counts_equal_library(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = unigram.vocabulary(open(path, "rb").read())
    plain = Tokenizer(models.Unigram(pieces, 0, True))
    plain.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)
    rows = list(enumerate(texts())) + [(None, "no id"), (7000, None)]
    want = [(i, len(plain.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    got = [(r.doc_id, r.n_tokens) for r in unigram.token_counts(docs(spark, rows), path).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert unigram.token_counts(docs(spark, []), path).count() == 0


def test_unigram_ties_and_unknowns_equal_library():
    rnd = random.Random(5)
    for _ in range(60):
        pieces = [("<unk>", 0.0), *{p: None for p in ("".join(rnd.choice("ab▁") for _ in range(rnd.randint(1, 4))) for _ in range(12)) if "▁" not in p.lstrip("▁")}]
        vocab = [pieces[0], *((p, float(-rnd.randint(1, 3))) for p in pieces[1:])]
        plain = Tokenizer(models.Unigram(vocab, 0, False))
        plain.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)
        own = unigram.Counter(vocab)
        for _ in range(60):
            t = "".join(rnd.choice("aab cb") for _ in range(rnd.randint(1, 9))).strip()
            words = t.split(" ")
            # the library joins unknowns over word borders; words are solved one by one here
            if t and len(words) == 1:
                assert own.count(t) == len(plain.encode(t).ids), (vocab, t)
