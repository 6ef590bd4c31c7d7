"""Operator 11: phrase collocations by direct-address tiling.

A text is lower-cased (A-Z), split at `[.,;:!?\\x0A-\\x0D]` into pieces and those
at spaces and tabs into words. Per language (null: `und`) every contiguous run
of two or three words inside a piece is counted. A phrase that occurs at least
`least` times is a candidate; it is cut in two in each possible way, and the cut
with the lowest score floor(1000000 * a * a / (l * r)) counts.

* Words are counted first; the most frequent HEAD of all (language, word) have
  their rank as a number. A pair of two such words lies in one of
  (HEAD / SIDE)**2 tiles of SIDE x SIDE cells, addressed directly: a tile that a
  batch fills well enough is an array that np.bincount adds to. All other pairs,
  and those of thin tiles, are sorted coordinate lists (COO) of 64-bit word keys
  that are merged as they grow.
* The next level is the same step again: the frequent pairs are ranked, and a
  pair's number and the next word's number address a tile of triples.
* A phrase can't be more frequent than its parts, so a run is counted only
  if its parts pass a bit map (MAP_BITS bits) of the frequent ones. A false pass
  costs work, never a wrong result: candidates are told by their exact counts.
* HEAD and MAP_BITS bound what a task is sent whatever the corpus. What a task
  has counted is summed by Spark over all tasks (map-side combined).
* Ranks are cut to `top` in two steps, first in SALTS parts of a language, so
  that a language with a third of all candidates is not one task.

Words are told apart by 64-bit hashes (with their language), phrases by those of
their parts. Scores are exact: products are decimals of 38 digits.

Cases: null text counts as empty; a text of any length is read in segments that
carry the last words on, so no phrase is lost at a segment's end; equal rows
count each; ties are ordered by the phrase's bytes; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from touchline.llm.common import _LOWER, hasher, mix64, staged

HEAD = 4096
SIDE = 1024
FILL = 16  # a tile is an array once a batch holds a pair for each FILL cells
MAP_BITS = 26
SALTS = 64
_SEG = 1 << 20  # bytes hashed at a time
_HOLD = 1 << 18  # entries of a list that a task holds before it gives them out
_BATCH = 1 << 16  # rows of an output batch
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SEPARATOR = np.zeros(256, dtype=np.uint8)
_SEPARATOR[[0x20, 0x09]] = 1
_SEPARATOR[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The key of the phrase made of two parts."""
    return mix64(left * _MIX + right)


class Words:
    """The words of a segment: keys, whether a word starts a piece, the row of
    each, and how many of them at the front were already given."""

    def __init__(self, data: bytes, ends: np.ndarray, salts: np.ndarray) -> None:
        buf = _LOWER[np.frombuffer(data, dtype=np.uint8)]
        kind = _SEPARATOR[buf]
        inside = np.zeros(len(buf) + 2, dtype=np.int8)
        inside[1:-1] = kind == 0
        step = np.diff(inside)
        self.buf, self.start, self.end = buf, np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.row = np.searchsorted(ends, self.start, side="right")
        breaks = np.cumsum(kind == 2)[self.start] if len(self.start) else self.start
        self.first = np.r_[True, breaks[1:] != breaks[:-1]][: len(breaks)]
        h = hasher()
        raw = h.ranges(h.prefix(buf), self.start, self.end)
        self.keys = mix64(raw + salts[self.row]) if len(raw) else raw
        self.given = 0

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()


def segments(batches: Iterator[pa.RecordBatch], carry: int) -> Iterator[tuple[Words, pa.RecordBatch, int]]:
    """(words, batch, number of the first row) over (salt, text, ...) batches:
    short texts together, long ones in parts, each with the last `carry` words
    of the part before at its front."""

    def long(text: bytes, salt: np.ndarray) -> Iterator[Words]:
        at, keys, first = 0, np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
        broken = True
        while at < len(text):
            end = min(len(text), at + _SEG)
            while end < len(text) and not _SEPARATOR[text[end]]:
                end += 1
            w = Words(text[at:end], np.array([end - at + 1]), salt)
            head = _SEPARATOR[np.frombuffer(text[at : at + int(w.start[0])] if len(w.start) else text[at:end], dtype=np.uint8)]
            broken = broken or bool((head == 2).any())
            if len(w.keys):
                w.first[0] = broken
                tail = _SEPARATOR[np.frombuffer(text[at + int(w.end[-1]) : end], dtype=np.uint8)]
                broken = bool((tail == 2).any())
                w.given = len(keys)
                w.keys, w.first = np.r_[keys, w.keys], np.r_[first, w.first]
                keys, first = w.keys[len(w.keys) - carry :] if carry else keys, w.first[len(w.first) - carry :] if carry else first
                yield w
            at = end

    for b in batches:
        salts = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        texts, ends, size, begin = [], [], 0, 0
        for i in range(b.num_rows + 1):
            data = b.column(1)[i].as_py().encode("utf-8", "surrogatepass") if i < b.num_rows else b""
            if texts and (i == b.num_rows or size + len(data) > _SEG):
                yield Words(b"\n".join(texts), np.array(ends), salts[begin:i]), b, begin
                texts, ends, size, begin = [], [], 0, i
            if len(data) > _SEG:
                for w in long(data, salts[i : i + 1]):
                    yield w, b, i
                begin = i + 1
            elif i < b.num_rows:
                texts.append(data)
                size += len(data) + 1
                ends.append(size)


class Coo:
    """A growing list of coordinates with counts, kept sorted and merged. One
    key is one coordinate; `more` follows from it."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray, *more: np.ndarray) -> None:
        if len(keys):
            self.parts.append((keys, counts, *more))
            self.size += len(keys)

    def merged(self) -> tuple[np.ndarray, ...]:
        """(keys, counts, ...), each key once, sorted."""
        keys, counts, *more = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        pick = order[at]
        out = (keys[at], np.add.reduceat(counts[order], at), *(m[pick] for m in more))
        self.parts, self.size = [out], len(at)
        return out

    def full(self) -> bool:
        """Whether it is still too long once merged."""
        if self.size > 2 * _HOLD:
            self.merged()
            return self.size > _HOLD
        return False

    def take(self) -> Iterator[tuple[np.ndarray, ...]]:
        if self.parts:
            out = self.merged()
            self.parts, self.size = [], 0
            for at in range(0, len(out[0]), _BATCH):
                yield tuple(x[at : at + _BATCH] for x in out)


class Ranked:
    """The most frequent units by rank, and the bit map of all frequent ones."""

    def __init__(self, keys: np.ndarray, bits: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.bits = keys, bits
        self.sorted, self.rank = keys[order], order

    def frequent(self, keys: np.ndarray) -> np.ndarray:
        bit = keys >> np.uint64(64 - MAP_BITS)
        return (self.bits[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)

    def number(self, keys: np.ndarray) -> np.ndarray:
        """The rank, or HEAD of a unit outside the ranked ones."""
        if not len(self.sorted):
            return np.full(len(keys), HEAD)
        at = np.minimum(np.searchsorted(self.sorted, keys), len(self.sorted) - 1)
        return np.where(self.sorted[at] == keys, self.rank[at], HEAD)


class Tiles:
    """Counts of (left unit, next word) pairs."""

    def __init__(self, left: Ranked, word: Ranked) -> None:
        self.left, self.word = left, word
        self.dense: dict[int, np.ndarray] = {}
        self.sparse = Coo()

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        a, b = self.left.number(left), self.word.number(right)
        both = (a < HEAD) & (b < HEAD)
        tile = np.where(both, (a // SIDE) * (HEAD // SIDE) + b // SIDE, -1)
        cell = (a % SIDE) * SIDE + b % SIDE
        filled = np.bincount(tile[both], minlength=(HEAD // SIDE) ** 2)
        thin = ~both
        for t in np.flatnonzero(filled):
            here = tile == t
            if t not in self.dense and filled[t] * FILL < SIDE * SIDE:
                thin |= here
                continue
            # a cell's count in one task stays far below 2**31 words
            table = self.dense.setdefault(int(t), np.zeros(SIDE * SIDE, dtype=np.int32))
            table += np.bincount(cell[here], minlength=SIDE * SIDE).astype(np.int32)
        left, right = left[thin], right[thin]
        self.sparse.add(joined(left, right), np.ones(len(left), dtype=np.int64), left, right)

    def cells(self) -> Iterator[tuple[np.ndarray, ...]]:
        """(count, left, right) of the dense tiles."""
        for t, table in self.dense.items():
            at = np.flatnonzero(table)
            for i in range(0, len(at), _BATCH):
                some = at[i : i + _BATCH]
                a = (t // (HEAD // SIDE)) * SIDE + some // SIDE
                b = (t % (HEAD // SIDE)) * SIDE + some % SIDE
                yield table[some].astype(np.int64), self.left.keys[a], self.word.keys[b]


def _record(rows: tuple[np.ndarray, ...], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for x in rows], names
    )


def _words(texts: DataFrame) -> DataFrame:
    """(lang, key, word, f) of all words."""

    def count(batches):
        coo = Coo()

        def given():
            for keys, counts, lang, word in coo.take():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lang, pa.string()), pa.array(keys.view(np.int64)), pa.array(word, pa.binary()).cast(pa.string()), pa.array(counts)],
                    ["lang", "key", "word", "n"],
                )

        for w, b, begin in segments(batches, 0):
            keys, at, counts = np.unique(w.keys, return_index=True, return_counts=True)
            if len(keys):
                lang = np.empty(len(keys), dtype=object)
                word = np.empty(len(keys), dtype=object)
                names = b.column(2).slice(begin, int(w.row.max()) + 1).to_pylist()
                lang[:] = [names[r] for r in w.row[at].tolist()]
                word[:] = [w.word(i) for i in at.tolist()]
                coo.add(keys, counts, lang, word)
            if coo.full():
                yield from given()
        yield from given()

    rows = texts.mapInArrow(count, "lang string, key long, word string, n long")
    return staged(rows.groupBy("lang", "key", "word").agg(F.sum("n").alias("f")), "phrase-words")


def _phrases(texts: DataFrame, left: Ranked, word: Ranked, level: int, least: int) -> DataFrame:
    """(left, right, f) of the frequent phrases of level + 1 words: keys of all
    but the last word and of the last word."""
    sent = texts.sparkSession.sparkContext.broadcast((left, word))

    def count(batches):
        names = ["n", "left", "right"]
        units, words = sent.value
        tiles = Tiles(units, words)
        for w, _, _ in segments(batches, level):
            n = len(w.keys) - level
            if n <= 0:
                continue
            here = np.arange(n) + level >= w.given
            for i in range(1, level + 1):
                here &= ~w.first[i : i + n]
            unit = w.keys if level == 1 else joined(w.keys[:-1], w.keys[1:])
            often = units.frequent(unit)
            here &= often[:n] & often[1 : n + 1]  # all but the last word, all but the first
            tiles.add(unit[:n][here], w.keys[level:][here])
            if tiles.sparse.full():
                for _, *rows in tiles.sparse.take():
                    yield _record(rows, names)
        for _, *rows in tiles.sparse.take():
            yield _record(rows, names)
        for rows in tiles.cells():
            yield _record(rows, names)

    # a task's rows are summed already: they are dealt out as they are
    rows = texts.mapInArrow(count, "n long, left long, right long").repartition("left", "right")
    return rows.groupBy("left", "right").agg(F.sum("n").alias("f")).where(F.col("f") >= least)


def _with_key(rows: DataFrame, left: str, right: str, name: str) -> DataFrame:
    """The rows with the key of the phrase of two parts."""
    names = [*rows.columns, name]
    at = [names.index(c) for c in (left, right)]

    def add(batches):
        for b in batches:
            a, z = (b.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in at)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(joined(a, z).view(np.int64))], names)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(add, f"{kinds}, {name} long")


def _ranked(frequent: DataFrame) -> Ranked:
    """At most HEAD units by frequency, and the bit map: at most 2**MAP_BITS bits."""
    top = frequent.orderBy(F.desc("f"), "key").limit(HEAD).select("key").toArrow()
    slot, bit = F.shiftrightunsigned("key", 64 - MAP_BITS + 6), f"shiftrightunsigned(key, {64 - MAP_BITS}) & 63L"
    slots = frequent.groupBy(slot.alias("slot")).agg(F.expr(f"bit_or(shiftleft(1L, cast({bit} as int)))").alias("bits")).toArrow()
    bits = np.zeros(1 << (MAP_BITS - 6), dtype=np.uint64)
    bits[slots.column("slot").to_numpy()] = slots.column("bits").to_numpy().view(np.uint64)
    return Ranked(top.column("key").to_numpy().astype(np.int64).view(np.uint64), bits)


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (l * r)), exactly."""
    wide = lambda c: f"cast({c} as decimal(19,0))"
    return F.expr(f"(({wide(a)} * {wide(a)}) * cast(1000000 as decimal(7,0))) div ({wide(left)} * {wide(right)})")


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, top: int = 2000,
    cover: tuple[int, int] = (50, 100),
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of each
    language by score, a (descending) and phrase. A pair of words goes if a
    candidate of three words that holds it has at least cover[0] / cover[1]
    of its occurrences."""
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    texts = docs.select(
        F.xxhash64(lang).alias("salt"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), lang.alias("lang")
    )
    words = _words(texts)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    words = words.where(F.col("f") >= least)
    word_rank = _ranked(words)
    pairs = _phrases(texts.select("salt", "text"), word_rank, word_rank, 1, least)
    pairs = staged(_with_key(pairs, "left", "right", "key"), "phrase-pairs")
    triples = staged(_phrases(texts.select("salt", "text"), _ranked(pairs), word_rank, 2, least), "phrase-triples")
    front = pairs.select(F.col("key").alias("left"), F.col("left").alias("w1"), F.col("right").alias("w2"), F.col("f").alias("f12"))
    triples = staged(_with_key(triples.join(front, "left"), "w2", "right", "tail"), "phrase-triples")

    def word(number: int) -> DataFrame:
        return words.select(
            F.col("key").alias(f"w{number}"), F.col("word").alias(f"word{number}"), F.col("f").alias(f"f{number}"),
            *([F.col("lang")] if number == 1 else []),
        )

    both = pairs.select("key", F.col("left").alias("w1"), F.col("right").alias("w2"), F.col("f").alias("a"))
    held = triples.select(F.explode(F.array_distinct(F.array("left", "tail"))).alias("key"), F.col("f").alias("longer"))
    held = held.groupBy("key").agg(F.max("longer").alias("longer"))
    both = both.join(held, "key", "left").where(
        F.col("longer").isNull() | (F.col("longer") * cover[1] < F.col("a") * cover[0])
    )
    both = both.join(word(1), "w1").join(word(2), "w2").select(
        "lang", F.concat_ws(" ", "word1", "word2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"),
        _score("a", "f1", "f2").alias("score"),
    )
    back = pairs.select(F.col("key").alias("tail"), F.col("f").alias("f23"))
    three = triples.withColumnsRenamed({"right": "w3", "f": "a"}).join(back, "tail")
    three = three.join(word(1), "w1").join(word(2), "w2").join(word(3), "w3")
    cut = lambda k, left, right: F.struct(
        _score("a", left, right).alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r")
    )
    three = three.withColumn("cut", F.least(cut(1, "f1", "f23"), cut(2, "f12", "f3"))).select(
        "lang", F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), "a", "cut.l", "cut.r", "cut.score"
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    found = both.unionByName(three).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
    some = some.where(F.col("rank") <= top).drop("salt", "rank")
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    best = best.where(F.col("rank") <= top).join(totals, "lang")
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
