"""Operator 13: SimHash near-duplicates by pivot distance tables.

A text is lower-cased (A-Z) and cut into words; each run of `k` words, joined by
single spaces, is hashed (XXH64, seed 42), repeats included; a text of fewer words
is one run. A bit of the 64-bit fingerprint is 1 if it is set in over half of the
hashes. Fingerprints that differ in at most `most` bits are linked; a document's
component is the smallest id that links lead to.

* Equal fingerprints are one row first (map-side combined), however many
  documents share one.
* Who meets. The 64 bits are cut into `parts` parts. Two fingerprints that differ
  in at most `most` bits are equal in at least parts - most parts, so each choice
  of so many parts is a key, and a pair is met under some key. With 6 parts and 4
  bits there are 15 keys of 21 bits; `parts=7` (35 keys of 27 bits) suits some
  hundred million fingerprints and more. The choice changes the work only.
* Under a key. The Hamming distances of its fingerprints to PIVOTS fixed
  reference fingerprints are the pivot table. By the triangle inequality no
  coordinate of a pair within `most` bits differs by more than `most`. The rows
  are sorted by their first coordinate, so that a row meets only a range of the
  others; each further coordinate discards pairs of the rest; the survivors are
  verified by their exact distance.
* Large keys are dealt by hash into tiles of about TILE fingerprints, and each pair
  of tiles is a row of its own: no task holds more than two tiles, whatever the
  key. Pairs are never given out: what a batch has verified is reduced to a
  spanning star of each group it found, at most one row a fingerprint.

Cases: null, empty and blank texts have no run and the fingerprint zero, which is
linked like any other; a text of any length is hashed in segments; rows that
repeat an id are rows each; a null id is never the smallest id unless all of its
component are null; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from touchline.llm.common import connected_components, mix64, staged, text_or_empty
from touchline.llm.tokens import slices

SEED = 42
PIVOTS = 32
TILE = 8192
_SEG = 1 << 20  # bytes cut into words at a time
_RUNS = 1 << 15  # hashes whose bits are counted at a time
_PAIRS = 1 << 21  # pairs looked at at a time
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SPACES = b" \t\n\v\f\r"
_REFERENCES = mix64(np.arange(1, PIVOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def run_hashes(text: str, k: int) -> Iterator[np.ndarray]:
    """The hashes of the runs of k words, some at a time."""
    data, at, held, given = text.encode("utf-8", "surrogatepass"), 0, [], False
    digest = xxhash.xxh64_intdigest
    while at < len(data):
        end = min(len(data), at + _SEG)
        while end < len(data) and data[end] not in _SPACES:
            end += 1
        words = held + data[at:end].translate(_LOWER).split()
        at = end
        if len(words) < k:
            held = words
            continue
        line = b" ".join(words)
        stop = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        first = np.r_[0, stop[: len(words) - k]].tolist()
        last = (stop[k - 1 :] - 1).tolist()
        for i in range(0, len(first), _RUNS):
            yield np.array([digest(line[a:b], SEED) for a, b in zip(first[i : i + _RUNS], last[i : i + _RUNS])], dtype=np.uint64)
        given, held = True, words[len(words) - k + 1 :]
    if held and not given:
        yield np.array([digest(b" ".join(held), SEED)], dtype=np.uint64)


def fingerprint(text: str | None, k: int) -> int:
    """As a signed 64-bit number."""
    ones, n = np.zeros(64, dtype=np.int64), 0
    for h in run_hashes(text or "", k):
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4) -> DataFrame:
    """(id, fp) of each row."""

    def told(batches):
        for b in slices(batches, 64):
            fps = [fingerprint(t, k) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(told, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def block_keys(fp: Column, parts: int, most: int) -> Column:
    """An array of (number, bits): the bits of each choice of parts - most parts."""
    edge = [round(64 * i / parts) for i in range(parts + 1)]
    masks = [sum(1 << b for i in some for b in range(edge[i], edge[i + 1])) for some in combinations(range(parts), parts - most)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.array(*[
        F.struct(F.lit(i).alias("number"), fp.bitwiseAND(F.lit(m).cast("long")).alias("bits")) for i, m in enumerate(signed)
    ])


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """A row of distances to the references for each fingerprint."""
    return np.bitwise_count(fps[:, None] ^ _REFERENCES[None, :]).astype(np.int8)


def _met(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) for all j in [low[i], high[i]), some at a time."""
    many = np.maximum(high - low, 0)
    total = np.cumsum(many)
    at = 0
    while at < len(many):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + _PAIRS, side="right")))
        here = many[at:to]
        i = np.repeat(np.arange(at, to), here)
        yield i, np.arange(len(i)) - np.repeat(np.cumsum(here) - here, here) + np.repeat(low[at:to], here)
        at = to


def near_pairs(a: np.ndarray, ga: np.ndarray, b: np.ndarray | None, gb: np.ndarray | None, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints of all pairs within `most` bits among the rows of a (with
    themselves) or of a and b that are of one group (ga, gb)."""
    # group and first coordinate in one number: a range of it is a group's rows
    # whose first coordinate is near enough
    da = pivot_table(a)
    ka = ga.astype(np.int64) * 256 + da[:, 0]
    order = np.argsort(ka, kind="stable")
    a, da, ka = a[order], da[order], ka[order]
    if b is None:
        b, db, low, high = a, da, np.arange(1, len(a) + 1), np.searchsorted(ka, ka + most, side="right")
    else:
        db = pivot_table(b)
        kb = gb.astype(np.int64) * 256 + db[:, 0]
        order = np.argsort(kb, kind="stable")
        b, db, kb = b[order], db[order], kb[order]
        near = np.maximum(ka - most, ka - ka % 256)
        low, high = np.searchsorted(kb, near), np.searchsorted(kb, ka + most, side="right")
    found = []
    for i, j in _met(low, high):
        for c in range(1, PIVOTS):
            keep = np.abs(da[i, c] - db[j, c]) <= most
            i, j = i[keep], j[keep]
        keep = np.bitwise_count(a[i] ^ b[j]) <= most
        found.append((a[i[keep]], b[j[keep]]))
    none = np.zeros(0, dtype=np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (none, none)


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The groups of a list of links as links to their smallest member."""
    names, at = np.unique(np.r_[a, b], return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(names))
    while True:
        new = low.copy()
        least = np.minimum(low[x], low[y])
        for side in (low[x], low[y], x, y):
            np.minimum.at(new, side, least)
        new = new[new]
        if np.array_equal(new, low):
            break
        low = new
    other = low != np.arange(len(names))
    return names[other], names[low[other]]


def _links(fps: DataFrame, parts: int, most: int) -> DataFrame:
    """(a, b): links that connect what is connected."""
    keyed = fps.select("fp", F.explode(block_keys(F.col("fp"), parts, most)).alias("k")).select("fp", "k.number", "k.bits")
    sizes = keyed.groupBy("number", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    rows = keyed.join(sizes, ["number", "bits"]).withColumn("tiles", tiles)
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    # a tile has about TILE rows: the hash deals the rows of a key out evenly
    blocks = rows.groupBy("number", "bits", "tiles", "tile").agg(F.collect_list("fp").alias("fps"))
    blocks = staged(blocks, "simhash-tiles")
    large = blocks.where("tiles > 1")
    left = large.withColumn("other", F.explode(F.expr("sequence(tile + 1, tiles)"))).where("other < tiles")
    right = large.select("number", "bits", F.col("tile").alias("other"), F.col("fps").alias("others"))
    across = left.join(right, ["number", "bits", "other"]).select("fps", "others")

    def within(batches):
        for b in slices(batches, 1024):
            for some in _filled(b):
                yield _starred(*near_pairs(*_flat(some.column(0)), None, None, most))

    def between(batches):
        for b in slices(batches, 1):
            yield _starred(*near_pairs(*_flat(b.column(0)), *_flat(b.column(1)), most))

    kind = "a long, b long"
    inner = blocks.select("fps").mapInArrow(within, kind)
    return staged(inner.unionByName(across.mapInArrow(between, kind)).distinct(), "simhash-links")


def _filled(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of lists with about TILE values each, one list at least."""
    end = b.column(0).offsets.to_numpy()
    at = 0
    while at < b.num_rows:
        to = max(at + 1, int(np.searchsorted(end, end[at] + TILE, side="right")) - 1)
        yield b.slice(at, to - at)
        at = to


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of some lists, and the number of each one's list."""
    many = np.diff(lists.offsets.to_numpy())
    return lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.repeat(np.arange(len(many)), many)


def _starred(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    a, b = stars(a, b)
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, most: int = 4, parts: int = 6
) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id."""
    if not 0 <= most < parts <= 16:
        raise ValueError("parts must be more than most, and at most 16")
    rows = staged(fingerprints(docs, id_col, text_col, k), "simhash-rows")
    fps = staged(rows.groupBy("fp").agg(F.min("id").alias("id")), "simhash-fps")
    part = connected_components(_links(fps, parts, most))
    fps = fps.join(part.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "id", F.coalesce("component", "fp").alias("component")
    )
    least = fps.groupBy("component").agg(F.min("id").alias("component_id"))
    fps = fps.join(least, "component").select("fp", "component_id")
    return rows.join(fps, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
