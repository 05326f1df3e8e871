import hashlib
import random
import re

from tallyfold.llm import wu_manber

from .helpers import docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def plain(rows, items, width=13):
    out = []
    windows = {}
    for item, text in items:
        if item is None or text is None:
            continue
        w = WORD.findall(text.translate(LOWER))
        for p in [w] if 0 < len(w) < width else [w[k : k + width] for k in range(len(w) - width + 1)]:
            windows.setdefault(tuple(p), set()).add(str(item))
    for i, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        hit, ids = set(), set()
        for p, names in windows.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit.update(range(k, k + len(p)))
                    ids |= names
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(ids), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def made():
    rnd = random.Random(3)
    word = lambda: rnd.choice(["a", "b", "the", "Cé", "dog", "7"])
    items = [(k, " ".join(word() for _ in range(rnd.choice([1, 2, 5, 12, 13, 14, 30])))) for k in range(12)]
    items += [(0, items[5][1]), (None, "lost item"), (50, None), (51, " ... "), (52, items[3][1])]
    rows = [(k, " ".join(word() for _ in range(rnd.randint(0, 80)))) for k in range(60)]
    rows += [(100 + k, f"{rows[k][1]}, {items[k % 12][1].upper()}! {rows[k + 1][1]}") for k in range(20)]
    rows += [(None, items[4][1]), (1, rows[1][1]), (1, rows[1][1]), (200, None), (201, ""), (202, "x " * 30000 + items[6][1])]
    return rows, items


def test_equals_plain_search(spark):
    rows, items = made()
    bench = spark.createDataFrame([(i, t, "q") for i, t in items], "item_id long, text string, hits string")
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = plain(rows, items)
    # 300 bytes a pass: several passes, each adding to the hits before
    for options in ({}, {"pass_bytes": 300}):
        found = wu_manber.contamination(docs(spark, rows), bench, **options)
        got = sorted((tuple(r[c] for c in names) for r in found.collect()), key=repr)
        assert got == want


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    got = wu_manber.contamination(docs(spark, [(1, "one two")]), bench).collect()
    assert [(r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in got] == [(1, 2, 0, False)]
    assert wu_manber.contamination(docs(spark, []), bench).count() == 0


def test_clean_rows_keep_their_columns_whatever_the_passes(spark):
    items = [(k, " ".join(f"w{k}x{j}" for j in range(20))) for k in range(9)]
    texts = [(0, "nothing here"), (1, items[3][1]), (2, "a " * 400 + items[4][1]), (3, None), (4, ""), (None, items[8][1]), (5, items[0][1] + " and " + items[7][1])]
    rows = spark.createDataFrame([(i, t, "kept") for i, t in texts], "doc_id long, text string, other string")
    marks = spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 20, 200):
        got = wu_manber.clean(rows, marks, pass_bytes=size)
        assert got.columns == rows.columns and sorted(tuple(r) for r in got.collect() if r.doc_id is not None) == [(0, "nothing here", "kept"), (2, texts[2][1], "kept"), (3, None, "kept"), (4, "", "kept")]
        assert got.where("doc_id is null").count() == 0
