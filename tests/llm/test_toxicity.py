import random
import zlib

import pytest

from tallyfold.llm import toxicity

from .helpers import docs


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("most", [1, 2])
def test_automaton_and_trie_find_all_within_reach(most):
    rnd = random.Random(8)
    make = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randint(4, 8)))
    terms = sorted({make() for _ in range(40)})
    settings = toxicity.Settings(max_edits=most, shortest_misspelled=5)
    lexicon = toxicity.Lexicon([(t, False, 1.0) for t in terms], settings)
    for _ in range(300):
        w = make()
        if w in lexicon.words:
            continue
        want = sorted((edits(w, t), t) for t in terms if len(t) >= 5 and edits(w, t) <= most)
        assert lexicon.misspelled(w) == want


def made():
    rnd = random.Random(9)
    plain = ["".join(rnd.choice("bcdfgklmnprst") + rnd.choice("aeiou") for _ in range(3)) for _ in range(120)]
    bad = ["zorquax", "vilgrump", "skizzle"]
    rows, labels = [], []
    for k in range(400):
        words = [rnd.choice(plain) for _ in range(rnd.randint(5, 60))]
        toxic = k % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(bad))
        rows.append((k, " ".join(words).capitalize() + "."))
        labels.append((k, int(toxic)))
    return rows, labels, plain


def test_held_out_accuracy_and_hostile_rows(spark):
    rows, labels, plain = made()
    extra = [(1000, None), (1001, ""), (None, "zorquax zorquax skizzle"), (1002, "you zorquav vilgrunp " + plain[0]), (1003, "word " * 30000), (1004, rows[0][1]), (1004, rows[0][1])]
    frame = spark.createDataFrame([(*x, "d") for x in labels + [(None, 1), (5000, 1), (3, None)]], "doc_id long, toxic int, TOXIC string")
    got = toxicity.held_out_scores(docs(spark, rows + extra), frame).collect()
    assert len(got) == len(rows) + len(extra)
    by = {r.doc_id: r for r in got}
    for k, toxic in labels:
        assert by[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2)
        assert 0 <= by[k].score <= 1 and by[k].predicted == int(by[k].score >= 0.3)
        if by[k].held_out:
            assert by[k].predicted == toxic
    assert by[1000].predicted == by[1001].predicted == by[1003].predicted == 0
    assert by[None].predicted == 1 and by[1002].predicted == 1  # misspelled terms


def test_quotation_scores_below_abuse(spark):
    rows, labels, _ = made()
    frame = spark.createDataFrame([(t, x) for (_, t), (_, x) in zip(rows, labels, strict=True)], "text string, toxic int")
    model = toxicity.train(frame)
    lexicon = toxicity.Lexicon(model.lexicon, model.settings, model.exact_only)
    score = lambda t: model.score(toxicity.features(lexicon, t))
    assert score('they wrote "zorquax" in the report') < score("you are a zorquax in the report")
    assert toxicity.quoted('a "b c" d', 3) and not toxicity.quoted('a "b c" d', 8) and toxicity.quoted("x\n> y", 4)


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.held_out_scores(docs(spark, [(1, "zorquax")]), none).collect()
    assert [(r.doc_id, r.score, r.predicted) for r in got] == [(1, 0.0, 0)]
    assert toxicity.held_out_scores(docs(spark, []), none).count() == 0
