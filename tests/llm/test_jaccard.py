import collections
import random
import re
import sys

from tallyfold.llm import jaccard

from .helpers import docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def plain(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    top = list(range(len(rows)))

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                top[root(a)] = root(b)
    least = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)].append(i)
    return sorted(((i, len(sets[k]), min(least[root(k)], default=None)) for k, (i, _) in enumerate(rows)), key=repr)


def made():
    rnd = random.Random(4)
    word = lambda: rnd.choice("abcdefghijklmnopqrstuvwxyz") + rnd.choice("aeiou") + rnd.choice("lmnr")
    text = lambda n: [word() for _ in range(n)]
    rows, passage = [], text(40)
    for base in range(6):
        t = text(rnd.choice([6, 30, 80, 150]))
        for _ in range(25):
            c = list(t)
            for _ in range(rnd.choice([0, 1, 1, 2, 3])):
                k = rnd.randrange(len(c))
                c[k : k + 1] = [[word()], [], [c[k], word()]][rnd.randrange(3)]
            rows.append(" ".join(c))
    rows += [" ".join(passage + text(n)) for n in (0, 2, 4, 6, 8, 8, 9, 10, 10, 60, 60)]
    rows += [" ".join(text(n) + passage) for n in (3, 5, 9, 40)]
    rows += ["", None, "  \n", "One two", "one TWO", "two one", "one", "one", "a b c d e", "A B c d e", "x " * 20000 + "end", "x " * 20000]
    rnd.shuffle(rows)
    return [(3 * k + 1, t) for k, t in enumerate(rows)] + [(None, rows[3]), (4, rows[9]), (4, rows[9])]


def test_equals_all_pairs(spark):
    rows = made()
    want = plain(rows)
    # A low bound for frequent tokens: combinations of two take part.
    for frequent in (1024, 3):
        found = jaccard.near_copies(docs(spark, rows), frequent_df=frequent)
        got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()), key=repr)
        assert got == want


def test_empty(spark):
    assert jaccard.near_copies(docs(spark, [])).count() == 0
    got = jaccard.near_copies(docs(spark, [(5, None), (6, "")])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(5, 0, 5), (6, 0, 6)]


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(0, 40)] + [(101, 100)], "a long, b long")
    got = {r.node: r.component for r in jaccard.components(links).collect()}
    assert set(got.values()) == {0, 100} and got[40] == 0 and got[101] == 100


def test_words_are_hashed_by_passes_over_many_texts():
    rnd = random.Random(6)
    piece = lambda: rnd.choice([b" ", b"\t", b"\n\x0b", b"a", b"B", b"b", b"\x85", b"\xc2\xa0", b"q" * 64, b"Q" * 65])
    texts = [b"".join(piece() for _ in range(n)) for n in [0, 1, 3, 9, 40] * 40 + [60_000]]
    texts += [None, b" " * 70_000, b"x" * 70_000, b"x" * 70_001, b"x" * 90 + b"y" + b"x" * 69_910, b"one two", b"two one"]
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        got = list(jaccard.Shingler()(texts))
    finally:
        sys.setprofile(None)
    seen, words = {}, 0
    for text, s in zip(texts, got, strict=True):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or b"").lower())
        words += len(w)
        want = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
        assert len(want) == len(s) and (s[1:] > s[:-1]).all()
        assert seen.setdefault(want, s.tobytes()) == s.tobytes()
    assert len(set(seen.values())) == len(seen)
    # A few calls for each text, none for a word.
    assert calls < words


def test_far_variants_of_a_large_cluster(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("aeioulmnr") for _ in range(5))
    base = [word() for _ in range(120)]
    rows = []
    for edits in [0, 1, 1, 2, 2, 3] * 12 + [5, 6, 7, 8, 9] * 8:
        text = list(base)
        for k in rnd.sample(range(120), edits):
            text[k] = word()
        rows.append((len(rows), " ".join(text)))
    want = plain(rows)
    for frequent in (1024, 20):
        found = jaccard.near_copies(docs(spark, rows), frequent_df=frequent)
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()), key=repr) == want
    # Leader 1; 2 and 3 are in its component, 4 to 6 are not. What 4 shares with it leaves room for a link with 3 and 5 only.
    star = spark.createDataFrame([(n, 1, 100, 100, c) for n, c in [(2, 95), (3, 90), (4, 83), (5, 80), (6, 40)]], "a long, b long, na long, nb long, common int")
    found = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "node long, component long")
    sets = spark.createDataFrame([(n, [0] * 16) for n in range(1, 7)], "node long, parity array<long>")
    assert sorted(jaccard._met(star, found, sets, 80).collect()) == [(4, 3), (4, 5), (5, 3)]
