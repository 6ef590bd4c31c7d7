"""Operator 12: conversation structure repair by scalar big-integer weights.

A conversation's turns are taken by turn number (nulls first; turns of one
number by their `role:text`). Each has at most one fault, the first of: blank (no
character but white space), duplicate (role and text seen earlier), truncated
(its last such character is not one of `.!?`). Edits are Keep (0), Rerole to user
or assistant (3), Delete (4; required for blank and duplicate turns) and Insert of
an empty user or assistant turn (3) anywhere; a truncated turn that stays costs 3
more. The cheapest edits that give role initials `(s?(ua)+)?` are applied; of
equally cheap ones those whose audit (the edits' initials in order) is least in
ASCII order.

* Weights. A way to the end is one integer: its cost in the high digits, then one
  octal digit for each letter of its audit (D I K R as 1 2 3 4) in a field of
  fixed width, zeros at the end. Putting an edit before it shifts the letters by
  one digit. The smaller integer is the cheaper way, or the one whose audit is
  less, also if it is a prefix. So a plain minimum over the DAG of (turn, state),
  from the end, decides everything. States: nothing yet, after s, after u, after a.
* At scale. Turns are dealt by ranges of (conversation, turn), so that a
  conversation of a third of all rows is spread over many tasks. A conversation
  that lies whole in one task and has at most BLOCK turns is decided there. The
  others (the first and last of a task, and long ones) are cut into blocks of
  BLOCK turns or BLOCK_BYTES: each block finds the least way from each state to
  each state, 16 numbers and the order of their audits. Two ways through a block
  hold as many D, K and R and end in one of them, so neither audit is a prefix of
  the other, and the block alone tells which is less. Their blocks are chained by
  a scan of those few numbers, then the blocks are edited in order. SHA-256 is
  sequential: a conversation's hash is one stream over its blocks, held one block
  at a time.
* Earlier copies of a turn in other blocks are found by a map-side combined
  minimum, also if a third of all rows repeat one turn.

Cases: null role and text count as one space (so is a null id or turn number in
`damage`); null ids are one conversation; rows that repeat id and turn are turns
each; a row marked as not live keeps its conversation in the result only; a
conversation without rows gives zeros, an empty audit and the hash of nothing; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from touchline.llm.common import staged

BLOCK = 512
BLOCK_BYTES = 1 << 22
_PREFIX = 128  # characters of `role:text` that deal out the turns of one number
_SPACES = " \t\n\v\f\r"
_LETTERS = str.maketrans("1234", "DIKR")
_D, _I, _K, _R = 1, 2, 3, 4
_KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})  # state after a kept turn, by its initial
_NEXT = (2, 2, 3, 2)  # state after a reroled or inserted turn
_ROLE = ("user", "user", "assistant", "user")  # its role
_LEGAL = {"su", "ua", "au"}
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

Turn = tuple[int | None, str, str]


def damage(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, live): by crc32(`id:turn`) % 20, 0 drops a row
    (live is false), 1 empties its text, 2 takes out `[.!?]`, 3 repeats it, 4
    makes its role user."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(told(id_col), F.lit(":"), told(turn_col)).cast("binary")) % 20
    rows = turns.select(
        F.col(id_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), kind.alias("kind"),
        told(role_col).alias("role"), told(text_col).alias("text"),
    )
    k = F.col("kind")
    live = F.when(k == 0, F.array(F.lit(False))).when(k == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(F.lit(True)))
    return rows.select(
        "conv", "turn",
        F.when(k == 0, F.lit("")).when(k == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when((k == 0) | (k == 1), F.lit("")).when(k == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(live).alias("live"),
    )


def as_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, live) of a table without damage."""
    space = F.lit(" ")
    return turns.select(
        F.col(id_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), space).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), space).alias("text"), F.lit(True).alias("live"),
    )


# --- one conversation or block ----------------------------------------------------
def faults(turns: list[Turn], copies: set[int]) -> str:
    """A letter a turn: b, d, t or - for none; copies: places of turns whose role
    and text were seen earlier."""
    out = []
    for i, (_, _, text) in enumerate(turns):
        body = text.rstrip(_SPACES)
        out.append("b" if not body else "d" if i in copies else "-" if body[-1] in ".!?" else "t")
    return "".join(out)


def repeated(turns: list[Turn]) -> set[int]:
    seen, out = set(), set()
    for i, turn in enumerate(turns):
        if turn[1:] in seen:
            out.add(i)
        seen.add(turn[1:])
    return out


class Weights:
    """Ways to the end as integers with room for `letters` letters; None: no way."""

    def __init__(self, letters: int) -> None:
        self.width = 3 * letters
        self.mask = (1 << self.width) - 1

    def before(self, letter: int, cost: int, way: int | None) -> int | None:
        if way is None:
            return None
        low = way & self.mask
        return way - low + (cost << self.width) + (letter << self.width - 3) + (low >> 3)

    def least(self, *ways: int | None) -> int | None:
        return min((w for w in ways if w is not None), default=None)

    def inserted(self, ways: list) -> list:
        """With up to two inserts in front: more lead back to a state passed."""
        one = [self.least(w, self.before(_I, 3, ways[_NEXT[q]])) for q, w in enumerate(ways)]
        return [self.least(w, self.before(_I, 3, one[_NEXT[q]])) for q, w in enumerate(ways)]

    def through(self, turns: list[Turn], fault: str, ways: list) -> list:
        """The least way from each state over the turns and on by `ways`."""
        for (_, role, _), f in zip(reversed(turns), reversed(fault)):
            new, more = [], 3 if f == "t" else 0
            for q in range(4):
                way = self.before(_D, 4, ways[q])
                if f in "-t":
                    to = _KEEP[q].get(role[:1])
                    keep = None if to is None else self.before(_K, more, ways[to])
                    way = self.least(way, keep, self.before(_R, 3 + more, ways[_NEXT[q]]))
                new.append(way)
            ways = self.inserted(new)
        return ways

    def told(self, way: int) -> tuple[int, str]:
        """Its cost and audit."""
        audit = f"{way & self.mask:o}".zfill(self.width // 3) if self.width else ""
        return way >> self.width, audit.rstrip("0").translate(_LETTERS)


def edited(turns: list[Turn], audit: str, state: int) -> tuple[list[tuple[str, str]], int]:
    """(role, text) of the repaired turns, and the state after them."""
    out, at = [], 0
    for letter in audit:
        if letter == "I":
            out.append((_ROLE[state], ""))
            state = _NEXT[state]
            continue
        _, role, text = turns[at]
        at += 1
        if letter == "K":
            out.append((role, text))
            state = _KEEP[state][role[:1]]
        elif letter == "R":
            out.append((_ROLE[state], text))
            state = _NEXT[state]
    return out, state


class Report:
    """What is told of a conversation, its blocks taken in order."""

    def __init__(self) -> None:
        self.count = dict.fromkeys(COUNTS, 0)
        self.low = self.high = self.last_role = None
        self.distinct, self.state = 0, 0
        self.audit: list[str] = []
        self.hash, self.begun = hashlib.sha256(), False

    def add(self, turns: list[Turn], fault: str, cost: int, audit: str) -> list[tuple[str, str]]:
        for turn, role, _ in turns:
            if self.last_role is not None and self.last_role + role[:1] not in _LEGAL:
                self.count["illegal"] += 1
            self.last_role = role[:1]
            if turn is not None and turn != self.high:
                self.low = turn if self.low is None else self.low
                self.high = turn
                self.distinct += 1
        for name, letter in (("blank", "b"), ("duplicate", "d"), ("truncated", "t")):
            self.count[name] += fault.count(letter)
        self.count["cost"] += cost
        self.audit.append(audit)
        rows, self.state = edited(turns, audit, self.state)
        for role, text in rows:
            if self.begun:
                self.hash.update(b"\n")
            self.begun = True
            self.hash.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        return rows

    def row(self) -> dict:
        if self.low is not None:
            self.count["gaps"] = self.high - self.low + 1 - self.distinct
        return {**self.count, "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}


def repair(turns: list[Turn]) -> tuple[dict, list[tuple[str, str]]]:
    """The report and the repaired turns of one whole conversation, in order."""
    report = Report()
    if not turns:
        return report.row(), []
    fault = faults(turns, repeated(turns))
    weights = Weights(3 * len(turns) + 2)
    ways = weights.through(turns, fault, weights.inserted([0, None, None, 0]))
    rows = report.add(turns, fault, *weights.told(ways[0]))
    return report.row(), rows


def block_ways(turns: list[Turn], fault: str) -> tuple[list[int], list[int], list[str]]:
    """Of the least way from each state to each (state * 4 + state): cost (-1:
    none), order of its audit among those of its first state, audit."""
    weights = Weights(3 * len(turns) + 2)
    cost, order, audits = [-1] * 16, [0] * 16, [""] * 16
    for to in range(4):
        ways = weights.through(turns, fault, [0 if q == to else None for q in range(4)])
        for q, way in enumerate(ways):
            if way is not None:
                cost[4 * q + to], audits[4 * q + to] = weights.told(way)
    for q in range(4):
        for i, to in enumerate(sorted(range(4), key=lambda t: audits[4 * q + t])):
            order[4 * q + to] = i
    return cost, order, audits


_END = ((0, ""), (6, "II"), (3, "I"), (0, ""))  # cost and audit of the inserts at a conversation's end, by state


def chosen(cost: list[int], order: list[int], after: list[int]) -> tuple[list[int], list[int]]:
    """The state that each state goes to through a block, and its cost to the
    end; after: costs to the end behind the block."""
    to, total = [], []
    for q in range(4):
        best = min((cost[4 * q + t] + after[t], order[4 * q + t], t) for t in range(4) if cost[4 * q + t] >= 0)
        to.append(best[2])
        total.append(best[0])
    return to, total


# --- over a table -----------------------------------------------------------------
_REPORT = ", ".join(f"{c}:bigint" for c in COUNTS) + ", audit:string, repaired_sha256:string"
_TURNS = "array<struct<role:string, text:string>>"
_REPORT_TYPE = pa.struct([*((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
_TURNS_TYPE = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_ROWS_TYPE = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))


def _batched(rows: Iterator[dict], schema: pa.Schema, many: int = 256) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += r.get("bytes", 0)
        if len(held) == many or size > BLOCK_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _shaped(rows: list[tuple[str, str]], with_turns: bool) -> list[dict] | None:
    return [{"role": r, "text": t} for r, t in rows] if with_turns else None


def _split(turns: DataFrame, conv_type: pa.DataType, with_turns: bool) -> DataFrame:
    """Whole conversations decided, and the blocks of the others."""
    schema = pa.schema([
        ("conv", conv_type), ("pos", pa.int64()), ("report", _REPORT_TYPE), ("turns", _TURNS_TYPE), ("rows", _ROWS_TYPE),
    ])

    def split(batches):
        def rows():
            pos = TaskContext.get().partitionId() << 33
            conv, held, size, opened, any_run = None, [], 0, True, False

            def block():
                nonlocal pos, held, size
                out = {"conv": conv, "pos": pos, "rows": [{"turn": a, "role": b, "text": c} for a, b, c in held], "bytes": size}
                pos, held, size = pos + 1, [], 0
                return out

            def whole():
                nonlocal pos
                report, kept = repair(held)
                pos += 1
                return {"conv": conv, "pos": pos - 1, "report": report, "turns": _shaped(kept, with_turns), "bytes": size}

            for b in batches:
                for c, turn, role, text, live in zip(*(b.column(i).to_pylist() for i in range(5))):
                    if not any_run or c != conv:
                        if any_run:
                            yield block() if opened else whole()
                        # the first run of a task may have begun in another task
                        conv, held, size, opened, any_run = c, [], 0, not any_run, True
                    if len(held) == BLOCK or size > BLOCK_BYTES:
                        opened = True
                        yield block()
                    if live:
                        held.append((turn, role, text))
                        size += len(role) + len(text)
            if any_run:  # and the last may go on in another one
                yield block()

        yield from _batched(rows(), schema)

    line = F.concat("role", F.lit(":"), "text")
    dealt = turns.repartitionByRange("conv", "turn", F.substring(line, 1, _PREFIX)).sortWithinPartitions("conv", "turn", line)
    kind = turns.schema["conv"].dataType.simpleString()
    rows = "array<struct<turn:bigint, role:string, text:string>>"
    return staged(
        dealt.mapInArrow(split, f"conv {kind}, pos long, report struct<{_REPORT}>, turns {_TURNS}, rows {rows}"), "turn-blocks"
    )


def _chained(blocks: DataFrame, conv_type: pa.DataType, with_turns: bool) -> DataFrame:
    """(conv, pos, report, turns) of the conversations in several blocks."""
    kind = blocks.schema["conv"].dataType.simpleString()
    said = blocks.select("conv", "pos", F.posexplode("rows").alias("i", "row"))
    said = said.select(
        "conv", "pos", "i", F.xxhash64("row.role", "row.text").alias("k1"), F.xxhash64("row.text", F.lit(0), "row.role").alias("k2")
    )
    first = said.groupBy("conv", "k1", "k2").agg(F.min(F.struct("pos", "i")).alias("first"), F.count(F.lit(1)).alias("n"))
    first = first.where("n > 1").select(F.col("conv").alias("c"), F.col("k1").alias("h1"), F.col("k2").alias("h2"), "first")
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2"))
    copies = said.join(first, same).where(F.struct("pos", "i") != F.col("first"))
    copies = copies.groupBy("pos").agg(F.collect_list("i").alias("copies"))  # at most BLOCK of a block

    def ways(batches):
        def rows():
            for b in batches:
                for r in b.to_pylist():
                    turns = [(x["turn"], x["role"], x["text"]) for x in r["rows"]]
                    fault = faults(turns, set(r["copies"] or ()))
                    cost, order, audits = block_ways(turns, fault)
                    yield {**{k: r[k] for k in ("conv", "pos", "rows")}, "fault": fault, "cost": cost, "order": order, "audits": audits, "bytes": sum(len(x[2]) for x in turns)}

        numbers = pa.list_(pa.int64())
        yield from _batched(rows(), pa.schema([
            ("conv", conv_type), ("pos", pa.int64()), ("rows", _ROWS_TYPE), ("fault", pa.string()), ("cost", numbers),
            ("order", numbers), ("audits", pa.list_(pa.string())),
        ]))

    row_type = blocks.schema["rows"].dataType.simpleString()
    found = staged(
        blocks.select("conv", "pos", "rows").join(copies, "pos", "left").select("conv", "pos", "rows", "copies").mapInArrow(
            ways, f"conv {kind}, pos long, rows {row_type}, fault string, cost array<long>, order array<long>, audits array<string>"
        ),
        "turn-ways",
    )

    def back(batches):
        def rows():
            conv, begun, after = None, False, []
            for b in batches:
                for c, pos, cost, order in zip(*(b.column(i).to_pylist() for i in range(4))):
                    if not begun or c != conv:
                        conv, begun, after = c, True, [x for x, _ in _END]
                    to, after = chosen(cost, order, after)
                    yield {"pos": pos, "to": to}

        yield from _batched(rows(), pa.schema([("pos", pa.int64()), ("to", pa.list_(pa.int64()))]), 4096)

    scan = found.select("conv", "pos", "cost", "order").repartition("conv").sortWithinPartitions("conv", F.desc("pos"))
    plan = staged(scan.mapInArrow(back, "pos long, to array<long>"), "turn-plan")

    def forth(batches):
        def rows():
            conv, report = None, None

            def end():
                cost, audit = _END[report.state]
                kept = report.add([], "", cost, audit)
                return {"conv": conv, "pos": None, "report": report.row(), "turns": _shaped(kept, with_turns)}

            for b in batches:
                for r in b.to_pylist():
                    if report is None or r["conv"] != conv:
                        if report is not None:
                            yield end()
                        conv, report = r["conv"], Report()
                    way = 4 * report.state + r["to"][report.state]
                    turns = [(x["turn"], x["role"], x["text"]) for x in r["rows"]]
                    kept = report.add(turns, r["fault"], r["cost"][way], r["audits"][way])
                    if with_turns:
                        yield {"conv": conv, "pos": r["pos"], "turns": _shaped(kept, True), "bytes": sum(len(x[1]) for x in kept)}
            if report is not None:
                yield end()

        yield from _batched(rows(), pa.schema([("conv", conv_type), ("pos", pa.int64()), ("report", _REPORT_TYPE), ("turns", _TURNS_TYPE)]))

    ordered = found.drop("order").join(plan, "pos").repartition("conv").sortWithinPartitions("conv", "pos")
    return ordered.mapInArrow(forth, f"conv {kind}, pos long, report struct<{_REPORT}>, turns {_TURNS}")


def repaired(turns: DataFrame, with_turns: bool = False) -> DataFrame:
    """(conv, pos, report, turns) from (conv, turn, role, text, live) rows:
    `report` on one row of each conversation, and, if asked for, the repaired
    turns in order of pos (null last)."""
    conv_type = turns.sparkSession.createDataFrame([], turns.select("conv").schema).toArrow().schema.field("conv").type
    parts = _split(turns, conv_type, with_turns)
    done = parts.where("report IS NOT NULL").select("conv", "pos", "report", "turns")
    rest = _chained(parts.where("report IS NULL"), conv_type, with_turns)
    return done.unionByName(rest)


def repair_report(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row a conversation: faults, cost, audit and hash of the repaired turns."""
    found = repaired(turns).where("report IS NOT NULL")
    return found.select(F.col("conv").alias(id_col), *[F.col(f"report.{c}") for c in (*COUNTS, "audit", "repaired_sha256")])


def repaired_turns(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, pos, number, role, text): the repaired turns, in order of pos (null
    last) and number."""
    found = repaired(turns, with_turns=True).where("turns IS NOT NULL")
    rows = found.select(F.col("conv").alias(id_col), "pos", F.posexplode("turns").alias("number", "t"))
    return rows.select(id_col, "pos", "number", "t.role", "t.text")
