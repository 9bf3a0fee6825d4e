"""Conversation repair against an exhaustive search, on short conversations, and against itself in small blocks."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from turnlattice.llm import turn_repair
from turnlattice.llm.turn_repair import FIRST, edits

SCHEMA = "conv_id long, turn long, role string, text string, place string, block string"


def code(kind, fault=0):
    return chr(FIRST + 4 * "sua?".index(kind) + fault)


def search(rows):
    """(cost, edits, lines) of the least of all edit strings; rows: (role, text, fault)."""
    best = None

    def go(i, initials, cost, audit, lines):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            best = min(best or (cost, audit, lines), (cost, audit, lines))
        if not re.fullmatch("s?(ua)*u?", initials):
            return
        if i < len(rows):
            role, text, fault = rows[i]
            go(i + 1, initials, cost + 3, audit + "D", lines)
            if fault not in ("blank", "duplicate"):
                more = cost + (fault == "truncated")
                go(i + 1, initials + role[:1] if role else initials + "?", more, audit + "K", [*lines, f"{role}:{text}"])
                for to in ("user", "assistant"):
                    go(i + 1, initials + to[0], more + 2, audit + "R", [*lines, f"{to}:{text}"])
        if len(audit) < 2 * len(rows) + 2:
            for to in ("user", "assistant"):
                go(i, initials + to[0], cost + 2, audit + "I", [*lines, f"{to}:"])

    limit = 3 * len(rows)  # deleting all
    best = (limit, "D" * len(rows), [])
    go(0, "", 0, "", [])
    return best


def test_edits_are_the_least():
    for n in range(4):
        for kinds in itertools.product("sua?", repeat=n):
            for faults in itertools.product((0, 1, 3), repeat=n):
                named = [(k, "", {0: None, 1: "blank", 3: "truncated"}[f]) for k, f in zip(kinds, faults, strict=True)]
                cost, audit, _ = search(named)
                found = edits("".join(map(code, kinds, faults)))
                assert (found[0], "".join(found[1])) == (cost, audit), named
                assert len(found[1]) == n


def expected(original):
    """{conv_id: row} by plain Python from the rows as they are before damage."""
    show = lambda x: " " if x is None else str(x)
    out = {}
    for conv in {r[0] for r in original}:
        rows = []
        for _, turn, role, text in (r[:4] for r in original if r[0] == conv):
            role, text, kind = show(role), show(text), zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            rows += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        told, seen = [], set()
        for _, role, text in rows:
            bare = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
            told.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else None if bare[-1] in ".!?" else "truncated"))
            seen.add((role, text))
        cost, audit, lines = search(told)
        known = [t for t, _, _ in rows if t is not None]
        faults = Counter(f for _, _, f in told)
        bad = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(told, told[1:], strict=False))
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out[conv] = (conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], bad, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations(n=80, seed=1):
    rnd = random.Random(seed)
    texts = ["Yes.", "no", "Why?", "", " \t\n", None, "ok!  ", "a ", "End. \n", "x" * 3000 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "auditor"]
    rows = []
    for conv in [*range(n), None]:
        turns = sorted(rnd.sample(range(12), rnd.randint(1, 5)))
        rows += [(conv, t if rnd.random() < 0.9 else None, rnd.choice(roles), rnd.choice(texts)) for t in turns]
    rows += [(7, 3, "user", "twice."), (7, 3, "user", "twice."), (8, 100, "assistant", "b."), (8, 100, "assistant", "a.")]
    dropped = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return [*rows, (dropped, 0, "user", "gone.")]


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("block", [12, 1])
def test_against_search(spark, monkeypatch, block):
    monkeypatch.setattr(turn_repair, "BLOCK", block)
    rows = conversations(seed=block)
    out = turn_repair.repairs(table(spark, rows), turn_repair.damaged(table(spark, rows)))
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    found = {r.conv_id: tuple(r) for r in out.collect()}
    want = expected(rows)
    assert found == want
    nothing = found[rows[-1][0]]
    assert nothing[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert turn_repair.repairs(empty, turn_repair.damaged(empty)).count() == 0


def test_one_very_long_conversation(spark, monkeypatch):
    """Most rows are of one conversation, many of them alike: its rows go to several tasks, and the pieces fit."""
    monkeypatch.setattr(turn_repair, "BLOCK", 5)
    rnd = random.Random(5)
    rows = [(1, i // 2, rnd.choice(["user", "assistant", "user", "system"]), rnd.choice(["Same.", f"Text {i}.", "cut", ""])) for i in range(3000)]
    rows += [(1, 5000, "user", "Again.")] * 500 + [(c, t, "user", "Hi.") for c in range(2, 40) for t in range(3)]
    docs = table(spark, rows)
    placed = turn_repair.placed(docs)
    parts = placed.groupBy("conv_id").agg(turn_repair.F.count_distinct(turn_repair.F.shiftright("place", 33)).alias("n"))
    assert {r.conv_id: r.n for r in parts.collect()}[1] > 1
    plans = turn_repair.planned(placed)
    ordered = sorted((r for r in placed.collect() if r.conv_id == 1), key=lambda r: r.place)
    assert [(r.turn, r.role, r.text) for r in ordered] == sorted((r[1:4] for r in rows if r[0] == 1))
    codes, seen = "", set()
    for r in ordered:
        fault = 1 if not r.text.strip() else 2 if (r.role, r.text) in seen else 0 if r.text[-1] in ".!?" else 3
        seen.add((r.role, r.text))
        codes += code(r.role[0], fault)
    cost, letters = edits(codes)
    told = plans.filter("audit is not null and conv_id = 1").first()
    assert (told.cost, told.audit) == (cost, "".join(letters))
    for whole in (False, True):
        made = sorted((r for r in turn_repair.turns(placed, plans, whole).collect() if r.conv_id == 1), key=lambda r: (r.place, r.step))
        assert re.fullmatch("s?(ua)+", "".join(r.role[0] for r in made))
        assert [r.edit for r in made] == [x for x in told.audit if x != "D"]
        assert all(r.text == "" for r in made if r.edit == "I")
    digest = {r.conv_id: r.sha256 for r in turn_repair.digests(turn_repair.turns(placed, plans, True)).collect()}
    assert digest[1] == hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in made).encode()).hexdigest()
