"""Conversation repair against every sequence of edits, and blocks against whole
conversations."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from touchline.llm import conversation_repair as R

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string, conv string, pos int, live string, kind int, report string"
AFTER = {"": "su", "s": "u", "su": "a", "u": "a", "a": "u"}


def plain(turns):
    """The report of the contract, by all sequences of edits."""
    body = [t.strip(" \t\n\v\f\r") for _, _, t in turns]
    fault, seen = [], set()
    for (_, role, text), b in zip(turns, body):
        fault.append("blank" if not b else "duplicate" if (role, text) in seen else "" if b[-1] in ".!?" else "truncated")
        seen.add((role, text))

    def step(state, initial):
        # state: initials so far, as far as they matter
        return {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}[state].get(initial)

    @lru_cache(None)
    def best(i, state, inserts):
        ways = [(0, "", ())] if i == len(turns) and state in ("", "a") else []

        def add(cost, letter, line, rest):
            if rest is not None:
                ways.append((cost + rest[0], letter + rest[1], ((line,) if line is not None else ()) + rest[2]))

        for role in ("user", "assistant"):
            to = step(state, role[0])
            if to and inserts < 3:
                add(3, "I", role + ":", best(i, to, inserts + 1))
        if i < len(turns):
            _, role, text = turns[i]
            add(4, "D", None, best(i + 1, state, 0))
            if fault[i] in ("", "truncated"):
                more = 3 * (fault[i] == "truncated")
                if step(state, role[:1]):
                    add(more, "K", f"{role}:{text}", best(i + 1, step(state, role[:1]), 0))
                for new in ("user", "assistant"):
                    if step(state, new[0]):
                        add(3 + more, "R", f"{new}:{text}", best(i + 1, step(state, new[0]), 0))
        return min(ways, key=lambda w: w[:2]) if ways else None

    cost, audit, lines = best(0, "", 0)
    numbers = {t for t, _, _ in turns if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:])]
    return (
        max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *(fault.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def damaged(rows):
    """{id: turns after damage, in order} of (id, turn, role, text) rows."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        tell = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{tell(conv)}:{tell(turn)}".encode()) % 20
        role, text = tell(role), tell(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        here = out[conv]
        if kind:
            here.extend([(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1))
    for turns in out.values():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, f"{t[1]}:{t[2]}"))
    return out


def check(docs):
    rows = [tuple(r)[:4] for r in docs.select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in R.repair_report(R.damage(docs)).collect()}
    assert got == {c: plain(t) for c, t in damaged(rows).items()}
    return got


def awkward(seed=1, n=60):
    rnd = random.Random(seed)
    texts = ["a.", "b", "", None, " \t\n", "c!", "d?\n", "é.", "word " * 3000, "e.", "f.", "x.", "y!"]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", None, "", "USER"]
    rows = [
        (rnd.choice([1, 2, 3, 4, 5, 6, 7, None, n + i]), rnd.choice([None, 0, 1, 2, 3, 7, 20]), rnd.choice(roles), rnd.choice(texts))
        for i in range(n)
    ]
    return [(*r, "c", 1, "l", 2, "r") for r in rows + rows[:9]]


def test_whole_table(spark):
    got = check(spark.read.parquet(f"{SF}/conversations.parquet"))
    assert all(sum(r[i] for r in got.values()) for i in range(6))


@pytest.mark.parametrize("rows", [awkward(), awkward(2, 90), []])
def test_awkward_rows(spark, rows):
    check(spark.createDataFrame(rows, SCHEMA))


def test_blocks_give_what_whole_conversations_give():
    rnd = random.Random(7)
    for _ in range(400):
        n = rnd.randint(1, 9)
        turns = [(i, rnd.choice(["system", "user", "assistant", "tool"]), rnd.choice(["a.", "b", "", "c!", "d", "e."])) for i in range(n)]
        want, kept = R.repair(turns)
        assert tuple(want.values()) == plain(turns)
        fault = R.faults(turns, R.repeated(turns))
        edge = [0, *sorted(rnd.sample(range(1, n + 1), rnd.randint(0, min(3, n)))), n]
        ways = [R.block_ways(turns[a:z], fault[a:z]) for a, z in zip(edge, edge[1:])]
        after, plan = [c for c, _ in R._END], []
        for cost, order, _ in reversed(ways):
            to, after = R.chosen(cost, order, after)
            plan.append(to)
        report, rows = R.Report(), []
        for (a, z), (cost, _, audits), to in zip(zip(edge, edge[1:]), ways, reversed(plan)):
            way = 4 * report.state + to[report.state]
            rows += report.add(turns[a:z], fault[a:z], cost[way], audits[way])
        rows += report.add([], "", *R._END[report.state])
        assert (report.row(), rows) == (want, kept)


def test_a_conversation_of_most_rows(spark):
    """Cut into blocks over several tasks; one turn repeated very often."""
    rnd = random.Random(3)
    rows = [(1, i // 2, rnd.choice(["user", "assistant"]), rnd.choice(["thanks.", f"{i}.", f"{i}"])) for i in range(3000)]
    rows += [(1, None, "user", "thanks.")] * 900 + [(c, t, "user", "a.") for c in range(2, 40) for t in range(3)]
    docs = spark.createDataFrame([(*r, "c", 1, "l", 2, "r") for r in rows], SCHEMA)
    got = {r.conv_id: tuple(r)[1:] for r in R.repair_report(R.damage(docs)).collect()}
    want = {c: tuple(R.repair(t)[0].values()) for c, t in damaged(rows).items()}
    assert got == want
    turns = R.repaired_turns(R.damage(docs)).orderBy("conv_id", F.col("pos").asc_nulls_last(), "number").collect()
    lines = defaultdict(list)
    for r in turns:
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    for conv, report in got.items():
        assert hashlib.sha256("\n".join(lines[conv]).encode()).hexdigest() == report[-1]
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines[conv]))
