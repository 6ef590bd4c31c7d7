"""Operator 10: removal of repeated passages with a logarithmic family of
sparse suffix arrays.

Every byte that a `length`-byte string covers goes, if that string also starts
anywhere else in the input; matches do not cross documents, and strings are
judged on the input.

Sampled suffixes. Sorting all suffixes of a corpus would move it hundreds of
times over. Each window of `length` bytes is given to one suffix: the one that
starts at the window's smallest k-gram hash, the leftmost of equal ones. The
choice depends on the window's bytes alone, so equal windows choose suffixes
that start with the same k-gram, at the same offset. About one suffix in
(length - k + 2) / 2 bytes is kept. The windows of one suffix are consecutive;
their bytes together are its cell.

Family. A batch of documents gets a suffix array: the table of its suffixes by
k-gram hash (any order serves that puts equal prefixes side by side) and cell,
equal cells counted. It is merge-scanned against itself and each level of the
family for k-grams that both have. Then it joins the family as level 0; as long
as there are two levels of one number they are merged into one of the next, so
n batches are held in at most log2(n) + 1 levels and each suffix is rewritten
that often.

Judgement. A cell that occurs twice is repeated as a whole. Where a k-gram has
different cells, the cells' bytes are fetched (one copy of each cell) and
windows of equal offset are compared by hash: within a task for most k-grams,
by a distributed count for those with more than HOT_CELLS cells. Each document
gets the union of its repeated windows.

Exact copies of a document are one text to the index: a task gives the suffixes
of a text at most twice, and a document is known by 80 bits of hashes of its
text, so that a text that a third of all rows hold costs two sets a task.

Cases: null text counts as empty; texts shorter than `length` bytes lose
nothing; rows that repeat count each (so each is a repetition of the other);
very long texts are sampled in tiles of TILE window starts (a window lies in
one tile); null ids are rows like others; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from touchline.llm.common import discard, hasher, mix64, staged, staged_at, text_or_empty
from touchline.llm.tokens import slices

K_GRAM = 32
TILE = 1 << 20
HOT_CELLS = 20_000
_CELL = np.uint64(0xA0761D6478BD642F)
_OFFSET = np.uint64(0xE7037ED1A0B428DB)


# --- sampled suffixes -------------------------------------------------------------
def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values: from block starts and block ends."""
    n = len(x)
    blocks = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    blocks[:n] = x
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def _sample_tile(buf: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(key, cell, start, before, windows) of the suffixes of one tile: hash of
    the k-gram, hash of the cell, first window's start, bytes of the cell
    before the k-gram, number of windows."""
    h = hasher()
    prefix = h.prefix(buf)
    n = len(buf) - k + 1
    at = np.arange(n)
    gram = h.ranges(prefix, at, at + k)
    # smallest upper half, then leftmost
    low = np.uint64(0xFFFFFFFF)
    chosen = (_sliding_min((gram & ~low) | at.astype(np.uint64), length - k + 1) & low).astype(np.int64)
    start = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
    windows = np.diff(np.r_[start, len(chosen)])
    place = chosen[start]
    before = place - start
    cell = mix64(h.ranges(prefix, start, start + windows - 1 + length) * _CELL + before.astype(np.uint64))
    return gram[place], cell, start, before, windows


def sample(data: bytes, length: int, k: int) -> list[tuple[np.ndarray, ...]]:
    out = []
    buf = np.frombuffer(data, dtype=np.uint8)
    for a in range(0, len(buf) - length + 1, TILE):
        key, cell, start, before, windows = _sample_tile(buf[a : a + TILE + length - 1], length, k)
        out.append((key, cell, start + a, before, windows))
    return out


def _known(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).alias("id"), text.alias("text")).select(
        "id", "text", F.xxhash64("text").alias("doc"),
        F.pmod(F.xxhash64("text", F.lit("tag")), F.lit(1 << 16)).cast("int").alias("tag"),
    )


def _entries(docs: DataFrame, length: int, k: int) -> DataFrame:
    """(key, cell, doc, tag, start, before, windows); a text that a task meets
    often is given twice."""
    fields = ["key", "cell", "doc", "tag", "start", "before", "windows"]

    def emit(batches):
        seen, again = set(), set()
        for b in slices(batches, 64):
            cols: list[list[np.ndarray]] = [[] for _ in fields]
            for doc, tag, text in zip(*(c.to_pylist() for c in b.columns)):
                if (doc, tag) in again:  # twice is as good as often
                    continue
                (again if (doc, tag) in seen else seen).add((doc, tag))
                data = text.encode("utf-8", "surrogatepass")
                for key, cell, start, before, windows in sample(data, length, k):
                    n = len(key)
                    for c, v in zip(cols, (
                        key.view(np.int64), cell.view(np.int64), np.full(n, doc, np.int64), np.full(n, tag, np.int32),
                        start, before.astype(np.int32), windows.astype(np.int32),
                    )):
                        c.append(v)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], fields)

    return docs.select("doc", "tag", "text").mapInArrow(
        emit, "key long, cell long, doc long, tag int, start long, before int, windows int"
    )


# --- the family -------------------------------------------------------------------
class SuffixFamily:
    """Batches of documents, indexed in levels of sparse suffix arrays."""

    def __init__(self, spark: SparkSession, length: int = 200, k: int = K_GRAM) -> None:
        if not 0 < k <= length:
            raise ValueError("k must be between 1 and the length")
        self.spark, self.length, self.k = spark, length, k
        self.levels: dict[int, tuple[DataFrame, str]] = {}
        self.entries: list[DataFrame] = []
        self.shared: list[DataFrame] = []

    @staticmethod
    def _array(rows: DataFrame) -> DataFrame:
        """Cells in the order of the keys, equal ones counted, with the place
        of one of them."""
        place = F.struct("doc", "tag", "start", "before", "windows")
        cells = rows.groupBy("key", "cell").agg(F.sum("n").alias("n"), F.min(place).alias("p"))
        return cells.select("key", "cell", "n", "p.*").sortWithinPartitions("key", "cell")

    def add(self, docs: DataFrame) -> None:
        """docs: (id, text, doc, tag) as `_known` gives them."""
        entries = staged(_entries(docs, self.length, self.k), "suffix-entries")
        self.entries.append(entries)
        new, path = staged_at(self._array(entries.withColumn("n", F.lit(1).cast("long"))), "suffix-level")
        # merge-scan: keys that the batch has twice, or that a level has too
        found = new.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key")
        for level, _ in self.levels.values():
            found = found.unionByName(new.select("key").join(level.select("key"), "key", "left_semi"))
        self.shared.append(staged(found.distinct(), "suffix-shared"))
        number = 0
        while number in self.levels:
            old, old_path = self.levels.pop(number)
            merged, merged_path = staged_at(self._array(new.unionByName(old)), "suffix-level")
            discard(self.spark, path)
            discard(self.spark, old_path)
            new, path, number = merged, merged_path, number + 1
        self.levels[number] = (new, path)

    def _union(self, frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def repeated(self, docs: DataFrame) -> DataFrame:
        """(doc, tag, spans) of the texts with repeated windows: spans are
        start * 2**16 + length, each at most a cell long."""
        keys = self._union(self.shared).distinct()
        cells = self._union([level for level, _ in self.levels.values()]).join(keys, "key", "left_semi")
        if len(self.levels) > 1:
            cells = self._array(cells)
        cells = staged(cells, "suffix-cells")
        span = (F.shiftleft(F.col("start"), 16) + F.col("windows") - 1 + self.length).alias("span")
        whole = self._union(self.entries).join(
            cells.where("n > 1").select("key", "cell"), ["key", "cell"], "left_semi"
        ).select("doc", "tag", span)
        parts = self._partial(cells, docs)
        return whole.unionByName(parts).groupBy("doc", "tag").agg(F.collect_set("span").alias("spans"))

    def _partial(self, cells: DataFrame, docs: DataFrame) -> DataFrame:
        """Spans of the cells that occur once, but share windows with another
        cell of their k-gram."""
        length = self.length
        many = cells.groupBy("key").agg(F.count(F.lit(1)).alias("cells")).where("cells > 1")
        asked = cells.join(many, "key").select(
            "doc", "tag",
            F.struct("key", (F.col("n") > 1).alias("done"), (F.col("cells") > HOT_CELLS).alias("hot"), "start", "before", "windows").alias("c"),
        )
        # one document of each text; a text has at most as many cells as bytes
        asked = asked.groupBy("doc", "tag").agg(F.collect_list("c").alias("cells"))
        first = docs.groupBy("doc", "tag").agg(F.min("id").alias("first"))
        asked = asked.join(first, ["doc", "tag"])
        texts = docs.join(asked, ["doc", "tag"]).where(F.col("id").eqNullSafe(F.col("first")))
        texts = texts.select("doc", "tag", "text", "cells")
        fields = ["key", "done", "hot", "doc", "tag", "start", "before", "windows", "bytes"]

        def fetch(batches):
            for b in slices(batches, 32):
                cols: list[list] = [[] for _ in fields]
                for doc, tag, text, cells_ in zip(*(c.to_pylist() for c in b.columns)):
                    data = text.encode("utf-8", "surrogatepass")
                    for c in cells_:
                        s, w = c["start"], c["windows"]
                        row = (c["key"], c["done"], c["hot"], doc, tag, s, c["before"], w, data[s : s + w - 1 + length])
                        for col, v in zip(cols, row):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], fields)

        kinds = [pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        spec = "key long, done boolean, hot boolean, doc long, tag int, start long, before int, windows int, bytes binary"
        cut = staged(texts.mapInArrow(fetch, spec), "suffix-bytes")

        def compare(batches):
            for rows in _by_key(batches):
                owner, offset, code = _window_codes(rows, length)
                order = np.argsort(code, kind="stable")
                same = code[order][1:] == code[order][:-1]
                twice = np.zeros(len(code), dtype=bool)
                twice[order] = np.r_[same, False] | np.r_[False, same]
                twice &= ~rows.column(1).to_numpy(zero_copy_only=False)[owner]
                yield _spans(rows, owner[twice], offset[twice], length)

        spans = "doc long, tag int, span long"
        cool = cut.where("NOT hot").repartition("key").sortWithinPartitions("key").mapInArrow(compare, spans)

        def windows(batches):
            for b in slices(batches):
                owner, offset, code = _window_codes(b, length)
                done = b.column(1).to_numpy(zero_copy_only=False)[owner]
                start = b.column(5).to_numpy()[owner] + offset
                yield pa.RecordBatch.from_arrays(
                    [pa.array(code.view(np.int64)), pa.array(done), b.column(3).take(pa.array(owner)),
                     b.column(4).take(pa.array(owner)), pa.array((start << 16) + length)],
                    ["code", "done", "doc", "tag", "span"],
                )

        single = cut.where("hot").mapInArrow(windows, "code long, done boolean, doc long, tag int, span long")
        twice = single.groupBy("code").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("code")
        hot = single.where("NOT done").join(twice, "code", "left_semi").select("doc", "tag", "span")
        return cool.unionByName(hot)


def _by_key(batches: Iterator[pa.RecordBatch], rows: int = 8192) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, regrouped so that a key's rows come together."""
    held: list[pa.RecordBatch] = []
    for b in slices(batches, rows):
        key = b.column(0).to_numpy()
        new = np.flatnonzero(key[1:] != key[:-1])
        cut = int(new[-1]) + 1 if len(new) else 0
        if held and (cut or key[0] != held[-1].column(0)[-1].as_py()):
            if key[0] != held[-1].column(0)[-1].as_py() and not cut:
                yield _one(held)
                held = [b]
                continue
            yield _one([*held, b.slice(0, cut)])
            held = []
        elif cut:
            yield b.slice(0, cut)
        held.append(b.slice(cut))
    if held:
        yield _one(held)


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _window_codes(rows: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, window of the row, hash of key, offset and bytes) of all windows."""
    key = rows.column(0).to_numpy().view(np.uint64)
    before, windows = rows.column(6).to_numpy().astype(np.int64), rows.column(7).to_numpy().astype(np.int64)
    buf = np.frombuffer(b"".join(rows.column(8).to_pylist()), dtype=np.uint8)
    base = np.r_[0, np.cumsum(windows - 1 + length)][:-1]
    owner = np.repeat(np.arange(len(windows)), windows)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    start = base[owner] + offset
    h = hasher()
    code = h.ranges(h.prefix(buf), start, start + length)
    code = mix64(code ^ mix64(key[owner] + (before[owner] - offset).astype(np.uint64) * _OFFSET))
    return owner, offset, code


def _spans(rows: pa.RecordBatch, owner: np.ndarray, offset: np.ndarray, length: int) -> pa.RecordBatch:
    """Runs of consecutive windows of a row as (doc, tag, span)."""
    if len(owner):
        new = np.r_[True, (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1)]
        first = np.flatnonzero(new)
        run = np.diff(np.r_[first, len(owner)])
        owner, offset = owner[first], offset[first]
    else:
        run = owner
    start = rows.column(5).to_numpy()[owner] + offset
    pick = pa.array(owner, pa.int64())
    return pa.RecordBatch.from_arrays(
        [rows.column(3).take(pick), rows.column(4).take(pick), pa.array((start << 16) + run - 1 + length)],
        ["doc", "tag", "span"],
    )


def without(data: bytes, spans: list[int]) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes outside the union of the spans, and that union."""
    if not spans:
        return data, []
    s = np.sort(np.array(spans, dtype=np.int64))
    start, end = s >> 16, (s >> 16) + (s & 0xFFFF)
    reach = np.maximum.accumulate(end)
    new = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
    a, b = start[new], reach[np.r_[new[1:] - 1, len(s) - 1]]
    kept, at = [], 0
    for x, y in zip(a.tolist(), b.tolist()):
        kept.append(data[at:x])
        at = y
    kept.append(data[at:])
    return b"".join(kept), list(zip(a.tolist(), b.tolist()))


def suffix_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 200,
    batches: int = 4,
) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept (binary,
    the remaining bytes), kept_sha256. The documents enter the family in
    `batches` batches by the hash of their texts."""
    spark = docs.sparkSession
    known = _known(docs, id_col, text_col)
    family = SuffixFamily(spark, length)
    for i in range(batches):
        family.add(known.where(F.pmod("doc", F.lit(batches)) == i))
    spans = staged(family.repeated(known), "suffix-spans")
    rows = known.join(spans, ["doc", "tag"], "left").select("id", "text", "spans")
    kind = rows.schema["id"].dataType.simpleString()

    def cut(batches_):
        for b in slices(batches_, 64):
            out: list[list] = [[] for _ in range(5)]
            for text, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                data = text.encode("utf-8", "surrogatepass")
                kept, gone = without(data, found or [])
                row = (len(data), len(data) - len(kept), len(gone), kept, hashlib.sha256(kept).hexdigest())
                for c, v in zip(out, row):
                    c.append(v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(out, types)]], names)

    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]
    return rows.mapInArrow(
        cut, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
    )
