"""Conversation repair against brute force."""

import hashlib
import random
import re
import zlib
from functools import cache
from itertools import product

import pytest
import xxhash

from repolith.llm import conversations as C

BLANK = " \t\n\x0b\f\r"


def brute_edits(rows):
    """(cost, audit, lines) of rows (role, text, fault), by the cheapest and then ASCII-least string of edits, tried forward."""

    @cache
    def best(i, state):
        found = []
        if i == len(rows):
            if state in (0, 3):
                found.append((0, "", ()))
        else:
            role, text, fault = rows[i]
            found.append((2, "D", (i + 1, state, None)))
            if fault not in ("blank", "duplicate"):
                harm = 5 * (fault == "truncated")
                for cost, edit, new in ((0, "K", role), (1, "R", "user"), (1, "R", "assistant")):
                    to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((state, new[:1]))
                    if to is not None:
                        found.append((cost + harm, edit, (i + 1, to, f"{new}:{text}")))
        return found

    # Backwards over rows; within a row, inserting leads to states of the same row, so costs are settled from the cheapest on.
    after = {}
    for i in range(len(rows), -1, -1):
        now = {}
        for state in range(4):
            for cost, edit, go in best(i, state):
                if go == ():
                    way = (cost, edit, ())
                elif go[1] not in after:
                    continue
                else:
                    rest = after[go[1]]
                    way = (cost + rest[0], edit + rest[1], ((go[2],) if go[2] is not None else ()) + rest[2])
                now[state] = min(now.get(state, way), way)
        for _ in range(4):
            for state, to, role in ((0, 2, "user"), (1, 2, "user"), (3, 2, "user"), (2, 3, "assistant")):
                if to in now:
                    way = (now[to][0] + 5, "I" + now[to][1], (role + ":",) + now[to][2])
                    now[state] = min(now.get(state, way), way)
        after = now
    return after[0]


def brute(given, damaged=True):
    out = {}
    for conv in {r[0] for r in given}:
        rows = []
        for c, turn, role, text in given:
            if c != conv:
                continue
            role, text = (" " if x is None else x for x in (role, text))
            h = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20 if damaged else 9
            if h == 1:
                text = ""
            if h == 2:
                text = re.sub("[.!?]", "", text)
            if h == 4:
                role = "user"
            rows += [(turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
        digest = lambda r: (as_long(xxhash.xxh64_intdigest(r[2].encode(), 0)), r[2])
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][: C.HEAD].encode(), digest(r)))
        seen, marked = set(), []
        for turn, role, text in rows:
            bare = text.rstrip(BLANK)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = {t for t, _, _ in rows if t is not None}
        initials = [r[:1] for r, _, _ in marked]
        cost, audit, lines = brute_edits(tuple(marked))
        n = lambda f: sum(x[2] == f for x in marked)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (gaps, n("blank"), n("duplicate"), n("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def as_long(x):
    return x - (1 << 64) if x >> 63 else x


def frame(spark, rows):
    return spark.createDataFrame([(*r, 5, "x") for r in rows], "conv_id long, turn long, role string, text string, part int, lines string").repartition(3)


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def repaired(given, part_bytes=C.PART):
    messages, report = C.repair(given, part_bytes)
    said = {r["conv"]: r["repaired_sha256"] for r in C.digests(messages).collect()}
    none = hashlib.sha256(b"").hexdigest()
    return {r["conv_id"]: (*(r[c] for c in COLUMNS), said.get(C.NO_ID if r["conv_id"] is None else r["conv_id"], none)) for r in report.collect()}


def test_all_short_conversations():
    """Every row of up to four messages of four roles, each finished or not."""
    kinds = [(r, t, f) for r in ("system", "user", "assistant", "tool") for t, f in (("x.", ""), ("x", "truncated"))]
    for n in range(4):
        for rows in product(kinds, repeat=n):
            messages, out, state = [(r[:1], 5.0 * (f != "")) for r, _, f in rows], "", 0
            for inserted, edit, state in C.walk(messages, 0, C.END):
                out += "I" * len(inserted) + edit
            assert (C.fold(messages, C.END)[0], out + "I" * len(C.closing(state))) == brute_edits(rows)[:2]


ROLES = ["user", "assistant", "system", "tool", "", None, "assistant", "user"]


def some(rng, conv, n, turns):
    return [(conv, rng.choice([None, *range(turns)] if rng.random() < 0.1 else range(turns)), rng.choice(ROLES), rng.choice(["Well.", "well", " \t", None, "", "a ", "Long " * 30 + rng.choice("abc"), f"{rng.randrange(99)}!\n"])) for _ in range(n)]


@pytest.mark.parametrize("part_bytes", [C.PART, 300])
def test_odd_conversations(spark, part_bytes):
    """With small ranges, conversations lie in several segments."""
    rng = random.Random(5)
    rows = [x for conv in [*range(60), None] for x in some(rng, conv, rng.randrange(9), 12)] + some(rng, 99, 400, 300) + [(98, 3, "user", "Same.")] * 50
    want = brute(rows, damaged=False)
    assert repaired(frame(spark, rows), part_bytes) == want


def test_one_conversation_over_all_ranges(spark):
    rng = random.Random(6)
    rows = [(7, i, rng.choice(["user", "assistant"] if i % 97 else ROLES), rng.choice(["Yes.", f"no {i}", f"{i}?"])) for i in range(1500)]
    assert repaired(frame(spark, rows), 600) == brute(rows, damaged=False)


def test_edges(spark):
    assert repaired(frame(spark, [])) == {}
    long = "word " * 400_000
    rows = [(1, 0, "user", long + "."), (1, 1, "assistant", long), (2, None, None, None), (3, 5, "user", " "), (4, 1, "system", "Be kind.")]
    assert repaired(frame(spark, rows)) == brute(rows, damaged=False)


def test_query(spark, sf):
    given = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = {r["conv_id"]: (*(r[c] for c in COLUMNS), r["repaired_sha256"]) for r in C.op11_conversation_repair(spark, sf).collect()}
    assert out == brute(given) and len({len(x[6]) for x in out.values()}) > 3
