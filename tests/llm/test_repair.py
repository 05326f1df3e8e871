import hashlib
import random
import re
import zlib

import pytest

from tallyfold.llm import repair as rp

PATTERN = re.compile(r"(s?(ua)+)?")


def every_way(rows):
    """The cheapest edits by trying all: price and letters, and the repaired rows."""
    best = [3 * len(rows) + 1, None, None]

    def go(at, price, letters, out):
        if price > best[0]:
            return
        if at == len(rows):
            if PATTERN.fullmatch("".join(r[:1] for r, _ in out)) and (price, letters) < (best[0], best[1] or "Z"):
                best[:] = [price, letters, list(out)]
        else:
            role, text, fault = rows[at]
            go(at + 1, price + 3, letters + "D", out)
            if fault not in ("blank", "duplicate"):
                more = int(fault == "truncated")
                go(at + 1, price + more, letters + "K", [*out, (role or "?", text)])
                for new in ("user", "assistant"):
                    go(at + 1, price + 2 + more, letters + "R", [*out, (new, text)])
        if not letters.endswith("II"):
            for new in ("user", "assistant"):
                go(at, price + 2, letters + "I", [*out, (new, "")])

    go(0, 0, "", [])
    return best


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        was = role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        own += [((turn is not None, turn or 0), was, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {c: [x[2:] for x in sorted(own, key=lambda x: x[:2])] for c, own in out.items()}


def plain(rows):
    out = []
    for conv, own in damaged(rows).items():
        seen, faults, marked = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
        for _, role, text in own:
            rest = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not rest else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            marked.append((role, text, fault))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        firsts = [r[:1] for _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:], strict=False))
        cost, audit, kept = every_way(marked) if marked else (0, "", [])
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out.append((conv, gaps, *faults.values(), illegal, cost, audit, sha))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, position int")


def got(spark, rows, **options):
    table = frame(spark, rows)
    return sorted((tuple(r) for r in rp.repair(table, rp.damaged(table), **options).collect()), key=repr)


def made(seed, conversations, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(conversations):
        role = rng.choice(["system", "user", "assistant"])
        for t in range(rng.randrange(1, longest)):
            text = rng.choice(["Yes.", "No!", "Why? ", "And so", "", " \n", "All right.\t", "Ünd."]) + str(rng.randrange(3)) * rng.randrange(2)
            rows.append((c, t + rng.randrange(2) if rng.random() > 0.1 else None, role, text + rng.choice(["", ".", "!"])))
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else {"user": "assistant"}.get(role, "user")
    return rows


@pytest.mark.parametrize("segment", [512, 2])
def test_against_every_way(spark, segment):
    rows = made(segment, 120, 7)
    want = plain(rows)
    assert len({w[7] for w in want}) > 30 and sum(w[1] for w in want) > 0
    assert got(spark, rows, segment_rows=segment) == want


def test_hostile_rows(spark):
    rows = [(None, None, None, None), (None, 0, "user", "A."), (None, 1, "assistant", "B."), (1, 0, "", "Text."), (1, 1, "Tool", "More."), (2, 3, "user", "A."), (2, 3, "user", "A."), (2, 3, "agent", "B.")]
    rows += [(3, None, "user", "long " * 60_000 + "."), (3, -2, "assistant", "ende?"), (4, 1, "assistant", "\U0001f600."), (5, 9, "user", "x")]
    rows += [(c, 0, "user", "A.") for c in range(100, 160)]  # some of these lose their only row
    want = plain(rows)
    assert any(w[6] == 0 and w[7] == "" and w[0] and w[0] >= 100 for w in want)
    assert got(spark, rows) == want
    assert got(spark, []) == []


def test_long_conversation_in_segments(spark):
    rng = random.Random(3)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant", "user", "system"]), f"Turn {t}" + rng.choice([".", "", "!"])) for t in range(900)]
    one = got(spark, rows, segment_rows=5000)
    assert got(spark, rows, segment_rows=100) == got(spark, rows, segment_rows=7) == one


def test_both_heaps_find_what_one_would():
    rng = random.Random(5)
    for _ in range(150):
        rows = "".join(rng.choice("sua?") + rng.choice("-----tbd") for _ in range(rng.randrange(0, 14)))
        for begin in rp.PLACES:
            known = {begin: (0, "")}  # all ways, row by row, the least of each place kept
            for at in range(len(rows) // 2 + 1):
                for _ in range(3):
                    for p, w in list(known.items()):
                        for to, after, price, letter in rp._forward(rows, at, p):
                            if to == at and (w[0] + price, w[1] + letter) < known.get(after, (10**9, "")):
                                known[after] = (w[0] + price, w[1] + letter)
                if 2 * at < len(rows):
                    new = {}
                    for p, w in known.items():
                        for to, after, price, letter in rp._forward(rows, at, p):
                            if to == at + 1 and (w[0] + price, w[1] + letter) < new.get(after, (10**9, "")):
                                new[after] = (w[0] + price, w[1] + letter)
                    known = new
            for e in rp.PLACES:
                assert rp.cheapest(rows, begin, (e,)) == known.get(e)


def test_whole_tables_are_repaired_too(spark):
    table = frame(spark, [(1, 0, "user", "A."), (1, 1, "user", "B.")])
    r = rp.repair(table, rp.whole(table)).collect()[0]
    assert (r.cost, r.audit, r.illegal) == (2, "KR", 1)
    assert list(rp.repaired_roles(iter(["user", "user"]), "KR")) == [("user", True), ("assistant", True)]
