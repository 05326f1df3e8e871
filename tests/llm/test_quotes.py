import re

from tallyfold.llm import quotes

ROWS = [
    (1, 0, "user", "Hello there.\nHow are you?"),
    (1, 1, "assistant", "> hello   THERE!\n> unknown line\nHi! Fine."),
    (1, 2, "user", "On Monday, Bob wrote:\n>> Hello there.\n> hi! fine.\nGood"),
    (1, 3, "user", "new topic\nok"),
    (1, 4, "u", "> new topic\n\nok"),
    (1, 5, "u", "> Nobody said this"),
    (1, 6, None, None),
    (1, 7, "u", "> ok\nlatest of the equal ones"),
    (1, 7, "u", "> ok\nlatest of the equal ones"),
    (None, 1, "x", "> Hello there."),
    (2, None, "x", "> Hello there."),
    (2, 0, "x", "> Hello there.\n" + "long line\n" * 5000),
    (2, 1, "x", "> long line"),
    (3, 0, "x", ""),
    (3, 1, "x", "no quotes > here  "),
]


def plain(rows):
    """Parent, depth and thread by following each message's passages one by one."""
    said, out = {}, {}
    level = lambda x: len(re.sub(r"[^>]", "", re.match(r"^\s*(?:>\s?)*", x)[0]))
    norm = lambda x: re.sub(r"^[\W_]+|[\W_]+$", "", re.sub(r"\s+", " ", re.sub(r"^\s*(?:>\s?)+", "", x).lower()))
    seen = {}
    for c, t, _, text in sorted({r for r in rows if None not in (r[0], r[1], r[3])}, key=lambda r: r[:2]):
        runs, before = [], None
        for line in text.split("\n"):
            n = level(line)
            if n != before:
                runs.append((n, []))
                before = n
            runs[-1][1].append(norm(line))
        best = []
        count = linked = 0
        for n, lines in runs:
            if n and any(lines):
                count += 1
                votes = {}
                for x in lines:
                    f = max((u for (cc, u), s in said.items() if cc == c and u < t and x and x in s), default=None)
                    if f is not None:
                        votes[f] = votes.get(f, 0) + 1
                if votes:
                    source = max(votes, key=lambda f: (votes[f], f))
                    linked += 1
                    best.append((n, -votes[source], -source))
        said.setdefault((c, t), set()).update(x for n, lines in runs if not n for x in lines if x)
        seen[c, t] = (count, linked, -min(best)[2] if best else None)
    for (c, t), (count, linked, parent) in seen.items():
        root, depth = t, 0
        while seen[c, root][2] is not None:
            root, depth = seen[c, root][2], depth + 1
        out[c, t] = (count, linked, parent, root, depth)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", 1) for r in rows], "conv_id long, turn long, role string, text string, source string, level int")


def test_equals_plain_linking(spark):
    want = plain(ROWS)
    got = quotes.reply_ordered(frame(spark, ROWS)).collect()
    assert len(got) == len(ROWS)
    for r in got:
        own = want.get((r.conv_id, r.turn), (0, 0, None, r.turn, 0))
        assert (r.n_quotes, r.n_linked, r.parent_turn, r.thread_turn, r.depth) == own
    text = {(r.conv_id, r.turn): r.text for r in got}
    assert text[1, 1] == "Hi! Fine." and text[1, 2] == "Good" and text[1, 5] == "" and text[1, 6] is None
    assert text[3, 1] == "no quotes > here  "
    thread = [r.turn for r in sorted(got, key=lambda r: r.position) if (r.conv_id, r.thread_turn) == (1, 0)]
    assert thread == [0, 1, 2]


def test_long_reply_chain_and_empty(spark):
    rows = [(1, k, "u", f"> says {k - 1}\nsays {k}") for k in range(40)]
    got = {r.turn: (r.thread_turn, r.depth, r.position) for r in quotes.reply_ordered(frame(spark, rows)).collect()}
    assert got == {k: (0, k, k + 1) for k in range(40)}
    assert quotes.reply_ordered(frame(spark, [])).count() == 0
