"""Conversation repair against a plain search over all edits."""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache

import pytest
from conftest import MIDDLE

from logscope.llm import conversations as c

_SCHEMA = "conv_id long, turn long, role string, text string, conv string, same int, copies int"


def brute(rows):
    """The contract word by word for one conversation's rows ``(turn, role, text)`` after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("B" if not bare else "D" if (role, text) in seen else
                      "T" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(None)
    def best(i, state, inserted):
        """``(cost, audit, roles)`` from turn ``i`` on; roles only name what each edit yields."""
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if inserted < 3:
            for role in ("user", "assistant"):
                to = step.get((state, role[0]))
                if to:
                    cost, audit, made = best(i, to, inserted + 1)
                    found.append((cost + 2, "I" + audit, (f"{role}:", *made)))
        if i < len(rows):
            _, own, text = rows[i]
            cost, audit, made = best(i + 1, state, 0)
            found.append((cost + 3, "D" + audit, made))
            if faults[i] not in ("B", "D"):
                extra = 1 if faults[i] == "T" else 0
                for letter, price, role in (("K", 0, own), ("R", 2, "user"), ("R", 2, "assistant")):
                    to = step.get((state, role[:1]))
                    if to:
                        cost, audit, made = best(i + 1, to, 0)
                        found.append((cost + price + extra, letter + audit, (f"{role}:{text}", *made)))
        return min(found) if found else (10**9, "", ())

    for i in range(len(rows), 0, -20):  # from the end on, so that no call goes deep
        for state in ("", "s", "u", "a"):
            best(i, state, 0)
    cost, audit, made = best(0, "", 0)
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            "blank": faults.count("B"), "duplicate": faults.count("D"), "truncated": faults.count("T"),
            "illegal": illegal, "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(made).encode()).hexdigest()}


def damage(rows):
    """``{conv: rows after damage}``."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def check(found, rows):
    want = damage(rows)
    got = {r.conv_id: r.asDict() for r in found.collect()}
    assert set(got) == set(want)
    for conv, own in want.items():
        assert {"conv_id": conv, **brute(own)} == got[conv], own


def repair(spark, rows, **sizes):
    talks = spark.createDataFrame([(*r, "x", 1, 5) for r in rows], _SCHEMA)
    return c.repaired(c.damaged(c.turns_of(talks)), **sizes).withColumnRenamed("conv", "conv_id")


@pytest.fixture(scope="module")
def awkward(rng):
    roles = ["system", "user", "user", "assistant", "assistant", "tool", "", None, "User"]
    texts = ["Yes.", "No!", "And so", "", " \n", None, "Why? ", "x.\ny", "é…", "w" * 5000 + "."]
    rows = [(conv, rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts))
            for conv in [None, *range(60)] for _ in range(rng.randint(1, 9))]
    return rows + rows[:40]


@pytest.mark.parametrize("sizes", [{}, {"segment_turns": 1}, {"segment_turns": 3}, {"segment_chars": 10}])
def test_same_as_search_over_all_edits(spark, awkward, sizes):
    check(repair(spark, awkward, **sizes), awkward)


def test_one_conversation_over_many_tasks(spark, rng):
    rows = [(7, i, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", f"No {i}."]))
            for i in range(900)] + [(8, 1, "user", "Hi.")]
    check(repair(spark, rows, segment_turns=50), rows)


def test_equal_rows(spark):
    rows = [(1, 2, "user", "Same.")] * 300 + [(1, 3, "assistant", "Good.")]
    check(repair(spark, rows), rows)


def test_empty(spark):
    assert repair(spark, []).collect() == []


def test_query_on_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{MIDDLE}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    check(c.op13(spark, MIDDLE), rows)


def test_checkpoints_and_matrices_agree(rng):
    for _ in range(200):
        codes = [rng.randint(0, 8) for _ in range(rng.randint(0, 40))]
        at = rng.randint(0, len(codes))
        whole = c.END
        for code in reversed(codes):
            whole = c.costs_before(code, whole)
        assert c.through(c.matrix(codes[:at]), c.through(c.matrix(codes[at:]), c.END)) == whole
        prices = {"D": 3, "I": 2, "R": 2, "K": 0}
        paid, state = 0, 0
        for i, edit, state in c.tight_edits(codes, 0, c.END):
            paid += prices[edit] + (1 if edit in "KR" and 4 <= codes[i] < 8 else 0)
        assert paid + c.END[state] == whole[0]
