"""Conversation repair against a plain table of cheapest repairs, row by row."""

import hashlib
import random
import re
import zlib

import pytest

from papertide.llm import conversation_repair as repair

SPACE = " \t\n\x0b\f\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        name = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def all_faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        body = text.strip(SPACE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def plain_repair(initials, faults):
    """Row by row: the least (cost, audit) that leaves an output in each state of the pattern s?(ua)+ or empty."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    free = {"": "u", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "")}

    def inserted(table):
        for _ in range(3):
            for state, (cost, audit) in list(table.items()):
                way = (cost + 2, audit + "I")
                table[free[state]] = min(table.get(free[state], way), way)
        return table

    for initial, fault in zip(initials, faults, strict=True):
        onward = {}

        def put(state, way):
            onward[state] = min(onward.get(state, way), way)

        for state, (cost, audit) in inserted(best).items():
            put(state, (cost + 3, audit + "D"))
            if fault not in ("blank", "duplicate"):
                extra = 1 if fault else 0
                put(free[state], (cost + 2 + extra, audit + "R"))
                if initial in after[state]:
                    put(after[state][initial], (cost + extra, audit + "K"))
        best = onward
    return min(way for state, way in inserted(best).items() if state in ("", "a"))


def brute(rows):
    out = []
    order = lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode())
    after = damage(rows)
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in after if r[0] == conv), key=order)
        faults, initials = all_faults(mine), [r[2][:1] for r in mine]
        cost, audit = plain_repair(initials, faults)
        turns = {r[1] for r in mine} - {None}
        lines, at, last = [], 0, ""
        for edit in audit:
            row = mine[at] if edit != "I" else None
            at += edit != "I"
            if edit != "D":
                role = row[2] if edit == "K" else "assistant" if last == "u" else "user"
                lines.append(f"{role}:{row[3] if row else ''}")
                last = role[:1]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, copies int").repartition(3)
    return sorted((tuple(r) for r in repair.repair_report(table).collect()), key=repr)


def mixed(seed, n, longest):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "why", "Is it?  \n", "", " \t", "a. b", "…", "ok .", None, "x" * 3000 + "."]
    rows = []
    for conv in range(n):
        turn = 0
        for _ in range(rng.randint(1, longest)):
            turn += rng.choice([1, 1, 1, 0, 2])
            rows.append((rng.choice([conv, conv, conv, conv, None]), rng.choice([turn] * 9 + [None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), rng.choice(texts) if rng.random() < 0.5 else f"Line {rng.randint(0, 40)}{rng.choice(['.', '', '!'])}"))
    return rows


def test_ways_against_a_plain_table():
    rng = random.Random(5)
    code = {None: repair.SOUND, "truncated": repair.TRUNCATED, "blank": repair.VOID, "duplicate": repair.VOID}
    for _ in range(3000):
        n = rng.randint(0, 9)
        initials, faults = [rng.choice("suuaaat ") for _ in range(n)], [rng.choice([None, None, None, "truncated", "blank", "duplicate"]) for _ in range(n)]
        want = plain_repair(initials, faults)
        assert repair.cheapest(initials, [code[f] for f in faults]) == want
        cut = sorted(rng.sample(range(n + 1), min(2, n + 1)))
        pieces = [range(a, b) for a, b in zip([0, *cut], [*cut, n], strict=True)]
        told = [[(s, e, c, a) for s in range(4) for e, (c, a) in repair.ways([initials[i] for i in p], [code[faults[i]] for i in p], s, set(range(4))).items()] for p in pieces]
        assert repair.joined(told) == want


@pytest.mark.parametrize("segment", [1024, 3])
def test_mixtures(spark, segment, monkeypatch):
    rows = mixed(1, 60, 9) + mixed(2, 2, 150)
    monkeypatch.setattr(repair, "SEGMENT", segment)
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, 1, "user", "same.")] * 30 + [(2, None, None, None)] * 2 + [(3, 5, "system", "Hi.")] + [(None, None, "user", "q?"), (None, 2, "assistant", "a.")] + [(4, t, "user", "Is this the same?") for t in range(200)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_lines(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Well?"), (1, 2, "assistant", "Yes."), (2, 0, "assistant", "No.")]
    lines = repair.repaired_lines(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted(tuple(r) for r in lines) == [(1, 0, "user", "Hi."), (1, 1, "assistant", ""), (1, 2, "user", "Well?"), (1, 3, "assistant", "Yes."), (2, 0, "user", ""), (2, 1, "assistant", "No.")]
