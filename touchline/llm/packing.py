"""Operator 4: packing documents into windows by minimum bin slack.

A document's ids are cut into full windows and a remainder. How many
remainders there are of each length is all that the plan needs: at most
`window` counts, whatever the size of the corpus. The plan repeats: take the
longest remaining length, find by a bitset subset-sum over the counts the
multiset of remaining lengths that fills the window closest to its capacity,
backtrack it into counts, and use it as many times as the counts allow. If a
gap is left, one more remainder is cut to fill it and its rest goes back among
the lengths; only the last window can keep a gap, and it is cut at powers of
two, so that no sequence is padded.

Spark then gives each remainder its rank among those of its length (two-level:
count per input split, then rank inside it, so a length that holds a third of
all rows is spread over the splits) and each task looks its pieces up in the
plan, which holds a few entries a step.

Cases: null text counts as empty (one end id); every id is in exactly one
piece; very long texts become full windows; repeated rows and null ids are
packed each on their own (rows are told apart by a staged row number); an
empty table gives no piece; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from touchline.llm.common import staged
from touchline.llm.tokens import ID_BYTES, slices, token_ids


def best_fill(counts: dict[int, int], gap: int) -> dict[int, int]:
    """The multiset of lengths whose sum is closest to `gap` from below, as
    counts. Bit i of `reach` is set if sum i can be had from the lengths so
    far; a length's count is split in powers of two; the search ends as soon
    as the gap itself is reached."""
    mask = (1 << (gap + 1)) - 1
    goal = 1 << gap
    reach = 1
    steps: list[tuple[int, int, int]] = []  # (length, copies, reach before)
    for length in sorted((x for x in counts if x <= gap), reverse=True):
        left = min(counts[length], gap // length)
        copies = 1
        while left > 0 and not reach & goal:
            take = min(copies, left)
            steps.append((length, take, reach))
            reach |= (reach << (take * length)) & mask
            left -= take
            copies *= 2
        if reach & goal:
            break
    total = reach.bit_length() - 1
    out: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            out[length] = out.get(length, 0) + take
            total -= take * length
    return out


@dataclass
class Plan:
    """Where the remainders go. An entry: the `count` remainders of length
    `origin` from rank `rank` on have their ids sub..sub+length in sequence
    first + (j + r) // k at offset offset + (j + r) % k * length (r: 0, 1, ...)."""

    window: int
    sequences: int = 0
    entries: list[tuple[int, int, int, int, int, int, int, int, int]] = field(default_factory=list)

    def add(self, lot, length: int, j: int, k: int, first: int, offset: int) -> None:
        origin, sub, rank, count = lot
        self.entries.append((origin, sub, rank, count, length, j, k, first, offset))


def _take(pool: deque, n: int) -> list[tuple[int, int, int, int]]:
    """n remainders from a pool of lots (origin, sub, rank, count)."""
    out = []
    while n:
        origin, sub, rank, count = pool.popleft()
        use = min(n, count)
        out.append((origin, sub, rank, use))
        if use < count:
            pool.appendleft((origin, sub, rank + use, count - use))
        n -= use
    return out


def make_plan(histogram: dict[int, int], window: int) -> Plan:
    """The plan for `histogram`: number of remainders by length (< window)."""
    plan = Plan(window)
    counts = {x: c for x, c in histogram.items() if c > 0 and x > 0}
    pools: dict[int, deque] = defaultdict(deque)
    for x, c in counts.items():
        pools[x].append((x, 0, 0, c))

    def use(length: int, n: int) -> list[tuple[int, int, int, int]]:
        counts[length] -= n
        if not counts[length]:
            del counts[length]
        return _take(pools[length], n)

    while counts:
        seed = max(counts)
        counts[seed] -= 1
        pattern = best_fill({x: c for x, c in counts.items() if c}, window - seed)
        counts[seed] += 1
        pattern[seed] = pattern.get(seed, 0) + 1
        gap = window - sum(x * k for x, k in pattern.items())
        need = dict(pattern)
        cut = max((x for x, c in counts.items() if gap and c > pattern.get(x, 0)), default=0)
        if cut:
            need[cut] = need.get(cut, 0) + 1
        times = 1 if gap and not cut else min(counts[x] // k for x, k in need.items())
        if gap and not cut:
            _last(plan, [(lot, x) for x, k in pattern.items() for lot in use(x, k)])
            continue
        offset = 0
        for x, k in pattern.items():
            j = 0
            for lot in use(x, k * times):
                plan.add(lot, x, j, k, plan.sequences, offset)
                j += lot[3]
            offset += k * x
        if cut:
            j = 0
            for lot in use(cut, times):
                plan.add(lot, gap, j, 1, plan.sequences, offset)
                j += lot[3]
                pools[cut - gap].append((lot[0], lot[1] + gap, lot[2], lot[3]))
            counts[cut - gap] = counts.get(cut - gap, 0) + times
        plan.sequences += times
    return plan


def _last(plan: Plan, lots: list) -> None:
    """The last window: its ids, one remainder after the other, are cut into
    sequences whose lengths are powers of two."""
    single = [((o, s, r + i, 1), x) for (o, s, r, c), x in lots for i in range(c)]
    total = sum(x for _, x in single)
    sizes = [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
    room, offset = sizes.pop(0), 0
    for (origin, sub, rank, _), x in single:
        while x:
            part = min(x, room - offset)
            plan.add((origin, sub, rank, 1), part, 0, 1, plan.sequences, offset)
            sub, x, offset = sub + part, x - part, offset + part
            if offset == room:
                plan.sequences += 1
                room, offset = (sizes.pop(0) if sizes else 0), 0


class PlanLookup:
    """The entries sorted by (origin, sub, rank); ranks of one (origin, sub)
    are disjoint ranges, so a piece's place is one binary search."""

    def __init__(self, plan: Plan) -> None:
        e = np.array(sorted(plan.entries), dtype=np.int64).reshape(-1, 9)
        self.e = e
        self.starts: dict[tuple[int, int], tuple[int, int]] = {}
        if len(e):
            new = np.flatnonzero(np.any(e[1:, :2] != e[:-1, :2], axis=1)) + 1
            edges = [0, *new.tolist(), len(e)]
            for a, b in zip(edges, edges[1:]):
                self.starts[(int(e[a, 0]), int(e[a, 1]))] = (a, b)
        self.rank = np.ascontiguousarray(e[:, 2])

    def pieces(self, origin: int, rank: int) -> Iterator[tuple[int, int, int, int]]:
        """(sub, length, sequence, offset) of each piece of one remainder."""
        sub = 0
        while sub < origin:
            a, b = self.starts[(origin, sub)]
            i = a + int(np.searchsorted(self.rank[a:b], rank, side="right")) - 1
            _, _, first_rank, _, length, j, k, first, offset = self.e[i].tolist()
            j += rank - first_rank
            yield sub, length, first + j // k, offset + j % k * length
            sub += length


def _ranks(lengths: DataFrame, window: int) -> DataFrame:
    """(row, rank, before): rank of the row's remainder among those of its
    length, full windows of all rows before it."""
    rows = lengths.select(
        "row", F.shiftright("row", 33).alias("split"),
        (F.col("n_tokens") % window).alias("rest"), F.floor(F.col("n_tokens") / window).alias("full"),
    )
    by_split = rows.groupBy("split").agg(F.sum("full").alias("n"))
    earlier = Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    by_split = by_split.select("split", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("full_before"))
    by_rest = rows.groupBy("rest", "split").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("rest").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    by_rest = by_rest.select("rest", "split", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rank_before"))
    inside = Window.partitionBy("split").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    among = Window.partitionBy("split", "rest").orderBy("row")
    ranked = rows.select(
        "*", F.coalesce(F.sum("full").over(inside), F.lit(0)).alias("full_here"),
    ).withColumn("rank_here", F.row_number().over(among) - 1)
    return ranked.join(by_split, "split").join(by_rest, ["rest", "split"]).select(
        "row", (F.col("rank_here") + F.col("rank_before")).alias("rank"),
        (F.col("full_here") + F.col("full_before")).alias("before"),
    )


def id_width(tokenizer_path: str, end_id: int) -> int:
    """Bytes that each id of the vocabulary and the end take: 2 or 4."""
    largest = max([end_id, *Tokenizer.from_file(tokenizer_path).get_vocab(with_added_tokens=True).values()])
    return 2 if largest < 1 << 16 else ID_BYTES


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 1,
    window: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: id, start, length, doc_tokens, sequence_id, offset,
    ids (binary, little-endian unsigned 32-bit)."""
    width = id_width(tokenizer_path, end_id)
    tokens = staged(token_ids(docs, tokenizer_path, id_col, text_col, end_id, width=width), "pack-ids")
    lengths = tokens.select("row", "n_tokens")
    rest = (F.col("n_tokens") % window).alias("rest")
    # at most `window` rows
    hist = {r["rest"]: r["n"] for r in lengths.groupBy(rest).agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = make_plan(hist, window)
    sequences, lookup = plan.sequences, PlanLookup(plan)
    placed = tokens.join(_ranks(lengths, window), "row").select("id", "n_tokens", "ids", "rank", "before")

    def cut(batches):
        for b in slices(batches):
            out = [[] for _ in range(7)]
            for id_, n, ids, rank, before in zip(*(c.to_pylist() for c in b.columns)):
                wide = np.frombuffer(ids, dtype=f"<u{width}").astype("<u4")
                full = n // window
                pieces = [(i * window, window, sequences + before + i, 0) for i in range(full)]
                if n % window:
                    pieces += [(full * window + s, x, q, o) for s, x, q, o in lookup.pieces(n % window, rank)]
                for start, length, seq, offset in pieces:
                    row = (id_, start, length, n, seq, offset, wide[start : start + length].tobytes())
                    for c, v in zip(out, row):
                        c.append(v)
            kinds = [b.schema.field(0).type, *[pa.int64()] * 5, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    names = [id_col, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    kind = placed.schema["id"].dataType.simpleString()
    return placed.mapInArrow(
        cut, f"`{id_col}` {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    )
