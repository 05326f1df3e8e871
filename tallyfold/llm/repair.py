"""Conversation structure repair: bidirectional Dijkstra over the edit lattice.

A conversation's roles must read ``(s?(ua)+)?`` by their initials. A state of the lattice is a number of rows
dealt with and a place in that pattern; keeping, changing the role of, deleting or inserting a row is an edge with a
price and a letter. One heap grows from the beginning, one from the end; when no cheaper crossing is possible
all crossings of the least price are looked at and the one whose letters, put together, come first wins.
Equal-priced ways between the same states never begin one with the other, so the least beginning and the least end
make the least whole.

Rows become one letter each for the search. A conversation is cut into segments of a stated number of rows; a
segment's answer is its cheapest way from each place to each place, and a conversation's answer the fold over them,
so no conversation is a task's whole memory. Texts are read once more, in order, by a stream that hashes what is kept.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import Memo, pick, saved
from tallyfold.plans.grouped import spread_rank

#: Places in the pattern: at the beginning, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
PLACES = range(4)
ENDS = (START, ASSISTANT)
#: place, initial of the next row, place after it.
STEPS = ((START, "s", SYSTEM), (START, "u", USER), (SYSTEM, "u", USER), (USER, "a", ASSISTANT), (ASSISTANT, "u", USER))
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
TRUNCATED = 1
#: Faults as a row's second letter; a row without one, or that is truncated, may stay.
FAULTS = {"blank": "b", "duplicate": "d", "truncated": "t"}
SOUND = "-"
SEGMENT_ROWS = 512

Way = tuple[int, str]


def _forward(rows: str, at: int, place: int) -> Iterator[tuple[int, int, int, str]]:
    """Edges out of a state: rows dealt with, place, price, letter. ``rows`` has two letters a row: initial and fault."""
    for before, initial, after in STEPS:
        if before == place and initial != "s":
            yield at, after, INSERT, "I"
    if 2 * at == len(rows):
        return
    own, fault = rows[2 * at], rows[2 * at + 1]
    yield at + 1, place, DELETE, "D"
    if fault in "bd":
        return
    more = TRUNCATED if fault == "t" else 0
    for before, initial, after in STEPS:
        if before == place:
            if initial == own:
                yield at + 1, after, KEEP + more, "K"
            elif initial != "s":
                yield at + 1, after, REROLE + more, "R"


def _lattice(rows: str) -> tuple[dict, dict]:
    """Edges out of and into each state."""
    out: dict[tuple[int, int], list] = {}
    into: dict[tuple[int, int], list] = {}
    for at in range(len(rows) // 2 + 1):
        for place in PLACES:
            for to, after, price, letter in _forward(rows, at, place):
                out.setdefault((at, place), []).append(((to, after), price, letter))
                into.setdefault((to, after), []).append(((at, place), price, letter))
    return out, into


def cheapest(rows: str, begin: int, ends: tuple[int, ...], lattice: tuple[dict, dict] | None = None) -> Way | None:
    """Price and letters of the cheapest way from ``begin`` before the rows to one of ``ends`` after them, the first by its letters."""
    out, into = lattice or _lattice(rows)
    n = len(rows) // 2
    # A free edge deals with a row, so among equal prices states are settled in the order of their rows.
    heaps = [[(0, 0, "", (0, begin))], [(0, 0, "", (n, e)) for e in ends]]
    settled: list[dict[tuple[int, int], Way]] = [{}, {}]
    best: int | None = None
    while heaps[0] and heaps[1]:
        if best is not None and heaps[0][0][0] + heaps[1][0][0] > best:
            break
        side = 0 if (heaps[0][0][0], len(heaps[0])) <= (heaps[1][0][0], len(heaps[1])) else 1
        price, _, letters, state = heapq.heappop(heaps[side])
        if state in settled[side]:
            continue
        settled[side][state] = (price, letters)
        other = settled[1 - side].get(state)
        if other is not None and (best is None or price + other[0] < best):
            best = price + other[0]
        for to, more, letter in (out, into)[side].get(state, ()):
            if to in settled[side]:
                continue
            far = settled[1 - side].get(to)
            if far is not None and (best is None or price + more + far[0] < best):
                best = price + more + far[0]
            dealt = to[0] if side == 0 else n - to[0]
            heapq.heappush(heaps[side], (price + more, dealt, letters + letter if side == 0 else letter + letters, to))
    if best is None:
        return None
    ahead, back = settled
    ways = [a[1] + back[s][1] for s, a in ahead.items() if s in back and a[0] + back[s][0] == best]
    for s, a in ahead.items():
        ways += [a[1] + letter + back[to][1] for to, price, letter in out.get(s, ()) if to in back and a[0] + price + back[to][0] == best]
    return best, min(ways)


def ways(rows: str) -> dict[tuple[int, int], Way]:
    """The cheapest way of a segment from each place to each place that it can lead to."""
    lattice = _lattice(rows)
    found = {(b, e): cheapest(rows, b, (e,), lattice) for b in PLACES for e in PLACES}
    return {k: w for k, w in found.items() if w is not None}


def chained(before: dict[int, Way], segment: dict[tuple[int, int], Way]) -> dict[int, Way]:
    """The cheapest ways from the beginning to each place, one segment further."""
    after: dict[int, Way] = {}
    for (b, e), (price, letters) in segment.items():
        if b in before:
            way = (before[b][0] + price, before[b][1] + letters)
            if e not in after or way < after[e]:
                after[e] = way
    return after


def repaired_roles(roles: Iterator[str], audit: str) -> Iterator[tuple[str, bool]]:
    """Role and whether a row of the conversation stands behind it, for each row of the repaired one; ``roles`` of all rows in order."""
    place = START
    for letter in audit:
        role = next(roles) if letter != "I" else ""
        if letter == "D":
            continue
        if letter != "K":
            role = "assistant" if place == USER else "user"
        place = SYSTEM if role[:1] == "s" else USER if role[:1] == "u" else ASSISTANT
        yield role, letter != "I"


CONVERSATION = ["none", "conv"]
#: What is blank; the characters that end a sentence.
BLANK, ENDING = r"[\x20\x09-\x0D]", ".!?"


def damaged(table: DataFrame) -> DataFrame:
    """none, conv, turn, role, text, was_role, was_text, copy of the rows after damage; nulls in role and text are one space."""
    space = F.lit(" ")
    rows = pick(table, "conv_id", "turn", "role", "text").select(
        F.col("conv_id").isNull().alias("none"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", space).alias("was_role"), F.coalesce("text", space).alias("was_text"),
    )
    name = F.concat(F.when(F.col("none"), space).otherwise(F.col("conv").cast("string")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = rows.withColumn("kind", (F.crc32(name.cast("binary")) % 20).cast("int")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("was_text", ENDING, "")).otherwise(F.col("was_text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("was_role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return rows.select(*CONVERSATION, "turn", role.alias("role"), text.alias("text"), "was_role", "was_text", copies)


def whole(table: DataFrame) -> DataFrame:
    """The rows of ``table`` in the columns of ``damaged``, without damage."""
    space = F.lit(" ")
    rows = pick(table, "conv_id", "turn", "role", "text")
    return rows.select(
        F.col("conv_id").isNull().alias("none"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), F.coalesce("role", space).alias("was_role"),
        F.coalesce("text", space).alias("was_text"), F.lit(0).alias("copy"),
    )


def _faults(rows: DataFrame) -> DataFrame:
    """The rows with position (from 1) and fault; rows of one turn stand by role and text as they were. Written."""
    order = [F.col("turn").asc_nulls_first(), F.col("was_role"), F.col("was_text"), F.col("copy")]
    placed = spread_rank(rows, CONVERSATION, order, "position").drop("was_role", "was_text", "copy")
    # 256 bits name a row's content; what stands first in its conversation is found with a partial aggregate.
    placed = saved(placed.withColumn("content", F.sha2(F.concat_ws("\u0000", "role", "text"), 256)), "repair-rows")
    first = placed.groupBy(*CONVERSATION, "content").agg(F.min("position").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    repeats = placed.select(*CONVERSATION, "content", "position").join(first, [*CONVERSATION, "content"]).where("position > first")
    rest = F.regexp_replace("text", BLANK, "")
    end = F.substring(rest, -1, 1)
    fault = F.when(F.length(rest) == 0, FAULTS["blank"]).when(F.col("again"), FAULTS["duplicate"]).when(~end.isin(*ENDING), FAULTS["truncated"]).otherwise(SOUND)
    joined = placed.drop("content").join(repeats.select(*CONVERSATION, "position", F.lit(True).alias("again")), [*CONVERSATION, "position"], "left")
    return saved(joined.withColumn("again", F.coalesce("again", F.lit(False))).withColumn("fault", fault).drop("again"), "repair-faults")


def initial(role: Column) -> Column:
    """s, u, a, or ? for every other beginning of a role, none included."""
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise(F.lit("?"))


def _segments(rows: DataFrame, most: int) -> DataFrame:
    """none, conv, segment, rows (two letters each): at most ``most`` rows are put together."""
    letters = F.concat(initial(F.col("role")), F.col("fault"))
    cut = rows.select(*CONVERSATION, ((F.col("position") - 1) / most).cast("long").alias("segment"), "position", letters.alias("letters"))
    held = F.sort_array(F.collect_list(F.struct("position", "letters")))
    return cut.groupBy(*CONVERSATION, "segment").agg(F.array_join(F.transform(held, lambda x: x["letters"]), "").alias("rows"))


class _Conversation:
    """The fold over a conversation's segments."""

    def __init__(self) -> None:
        self.ways: dict[int, Way] = {START: (0, "")}
        self.faults = dict.fromkeys(FAULTS.values(), 0)
        self.illegal, self.last = 0, ""

    def add(self, rows: str, segment: dict[tuple[int, int], Way]) -> None:
        self.ways = chained(self.ways, segment)
        initials = self.last + rows[::2]
        self.illegal += sum(initials[k : k + 2] not in ("su", "ua", "au") for k in range(len(initials) - 1))
        self.last = initials[-1:]
        for f in self.faults:
            self.faults[f] += rows[1::2].count(f)

    def done(self) -> tuple[int, int, int, int, int, str]:
        cost, audit = min(self.ways[e] for e in ENDS if e in self.ways)
        return *self.faults.values(), self.illegal, cost, audit


_AUDIT = "none boolean, conv long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _audits(segments: DataFrame) -> DataFrame:
    """The faults and the cheapest edits of each conversation; segments come in order, one at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo, whole_memo = Memo(50_000, 64), Memo(200_000, 64)
        held, key, only = None, None, None

        def solved(rows: str) -> dict[tuple[int, int], Way]:
            got = memo.get(rows)
            if got is None:
                got = ways(rows)
                memo.put(rows, got)
            return got

        def finish() -> tuple:
            nonlocal held
            if held is None:  # one segment: only ways from the beginning to an end matter
                got = whole_memo.get(only)
                if got is None:
                    held = _Conversation()
                    held.add(only, {(START, ASSISTANT): cheapest(only, START, ENDS)})
                    got = held.done()
                    whole_memo.put(only, got)
                return *key, *got
            if only is not None:
                held.add(only, solved(only))
            return *key, *held.done()

        for batch in batches:
            out = []
            for none, conv, rows in batch[["none", "conv", "rows"]].itertuples(index=False):
                if (none, conv) != key:
                    if key is not None:
                        out.append(finish())
                    held, key, only = None, (none, conv), rows
                else:
                    held = held or _Conversation()
                    held.add(only, solved(only))
                    only = rows
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _AUDIT.split(", ")])
        if key is not None:
            yield pd.DataFrame([finish()], columns=[c.split()[0] for c in _AUDIT.split(", ")])

    ordered = segments.repartition(*CONVERSATION).sortWithinPartitions(*CONVERSATION, "segment")
    return ordered.mapInPandas(run, _AUDIT)


def _texts(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """none, conv, repaired_sha256: each conversation's texts stream past its edits, which come first."""
    edits = audits.select(*CONVERSATION, F.lit(0).cast("long").alias("position"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = edits.unionByName(rows.select(*CONVERSATION, "position", "role", "text"))
    both = both.repartition(*CONVERSATION).sortWithinPartitions(*CONVERSATION, "position")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, out = None, []
        digest, audit, at, place, some = hashlib.sha256(), "", 0, START, False

        def put(letter: str, role: str, text: str) -> None:
            nonlocal place, some
            if letter != "K":
                role = "assistant" if place == USER else "user"
            place = SYSTEM if role[:1] == "s" else USER if role[:1] == "u" else ASSISTANT
            digest.update(f"{chr(10) if some else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            some = True

        def inserted() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                put("I", "", "")
                at += 1

        def finish() -> None:
            inserted()
            out.append((*key, digest.hexdigest()))

        for batch in batches:
            for none, conv, position, role, text in batch[[*CONVERSATION, "position", "role", "text"]].itertuples(index=False):
                if position == 0:
                    if key is not None:
                        finish()
                    key, audit, at, place, some, digest = (none, conv), text, 0, START, False, hashlib.sha256()
                    continue
                inserted()
                if audit[at] != "D":
                    put(audit[at], role, text)
                at += 1
            yield pd.DataFrame(out, columns=[*CONVERSATION, "repaired_sha256"])
            out = []
        if key is not None:
            finish()
            yield pd.DataFrame(out, columns=[*CONVERSATION, "repaired_sha256"])

    return both.mapInPandas(run, "none boolean, conv long, repaired_sha256 string")


def repair(table: DataFrame, rows: DataFrame, *, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for each conv_id of ``table``.

    ``rows`` are the rows to be repaired (``damaged`` or ``whole`` of the table). Rows stand by turn, nulls first, those of one
    turn by role and text; a null role or text is one space, and a role that does not begin with s, u or a cannot be kept.
    Null conv_ids are one conversation. A conversation without rows has zeros, no edits and the digest of
    nothing. Repeated rows are duplicates. Other columns are ignored; an empty table gives no rows.
    """
    faults = _faults(rows)
    audits = saved(_audits(_segments(faults, segment_rows)), "repair-audits")
    hashes = _texts(faults, audits)
    turns = faults.groupBy(*CONVERSATION, "turn").agg(F.lit(1).alias("one")).groupBy(*CONVERSATION)
    gaps = turns.agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    ids = pick(table, "conv_id").select(F.col("conv_id").isNull().alias("none"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv")).distinct()
    out = ids.join(audits, CONVERSATION, "left").join(hashes, CONVERSATION, "left").join(gaps, CONVERSATION, "left")
    zero = F.lit(0).cast("long")
    numbers = [F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(
        F.when(~F.col("none"), F.col("conv")).alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
