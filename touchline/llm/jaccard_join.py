"""Operator 6: n-gram Jaccard join as a blocked sparse matrix product.

The incidence matrix has a row for each document and a column for each hashed
word n-gram. The overlaps of all pairs are its product with its transpose; the
work is to compute only the entries that can be links.

* Rows. Documents with the same set of n-grams are one row (a class), known by
  a signature of its set. Rows are blocked by size: sizes differ by at most
  the threshold within a link, so a block meets only itself and the next one.
* Columns. For a link, the two sets must share a column among the first
  n - ceil(t * n) + 1 of each, in any one order of the columns. The order is
  rare columns first; how common a column is comes from hashed count tables of
  fixed size over all documents (a hint: it changes the work, never the result).
  A pair is met in its first common column; all its common columns are from
  there on, so what the two rows have left there bounds its overlap. A meeting
  whose bound is below what the sizes demand is discarded.
* Product. In each column each row meets one row of its block and one of the
  block below (the one with the column nearest to its front, so with the fewest
  columns of its own), not all of them. These candidates are checked exactly,
  and rows that are linked become one component. Then only rows of different
  components can still add something: in each column, rows outside the column's
  largest component meet all rows of other components. No pair that could join
  two components is left out, and a column that very many near copies share
  costs about as many pairs as it has rows.
* Check. The columns are cut into CELLS blocks by hash. A pair's overlap is at
  most the sum over blocks of the smaller row's count there; pairs below the
  bound that their sizes demand are discarded on these counts alone. For the
  others the blocks' overlaps are accumulated from the full sets, and the pair is
  given up as soon as what is left cannot reach the bound.

Components come from alternating star contraction over the links.

Cases: null and empty texts, and texts of white space, have an empty set, link
with nothing, and are their own component; a text of fewer than k words has one
n-gram, all its words; equal sets are linked; rows that repeat an id are rows
each; a null id is never the smallest id unless all of its component are null;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from touchline.llm.common import connected_components, mix64, shingle_hashes, staged, word_hashes
from touchline.llm.tokens import slices

CELLS = 64
HINT_BITS = 24  # columns of the count table: 16 MB as the hint each task gets
HINT_LEAST = 8  # the least count of a common column ...
HINT_NOISE = 4  # ... and how many times the mean count it must have


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The distinct n-grams of a text, sorted."""
    return np.unique(shingle_hashes(word_hashes(text or ""), k))


def signature(grams: np.ndarray) -> int:
    """64 bits that stand for the whole set."""
    a = int(np.sum(mix64(grams ^ np.uint64(0x51ED270B9F3A6C15)), dtype=np.uint64))
    b = int(np.bitwise_xor.reduce(mix64(grams + np.uint64(0x2545F4914F6CDD1D)))) if len(grams) else 0
    mixed = mix64(np.array([a ^ (b * 0x9E3779B97F4A7C15 + len(grams)) % (1 << 64)], dtype=np.uint64))
    return int(mixed.view(np.int64)[0])


def _common_columns(docs: DataFrame, k: int) -> np.ndarray:
    """How common each hashed column is, as the logarithm of its count; 0 for
    the others. A split reports the columns that it has seen more than once; a
    column is common if the sum of its reports stands out from the mean."""
    bits = HINT_BITS

    def count(batches):
        table = np.zeros(1 << bits, dtype=np.int32)
        for b in slices(batches):
            for text in b.column(0).to_pylist():
                np.add.at(table, (shingle_set(text, k) >> np.uint64(64 - bits)).astype(np.int64), 1)
        often = np.flatnonzero(table >= 2)
        yield pa.RecordBatch.from_arrays([pa.array(often), pa.array(table[often].astype(np.int64))], ["c", "n"])

    rows = docs.select("text").mapInArrow(count, "c long, n long").groupBy("c").agg(F.sum("n").alias("n"))
    rows = staged(rows, "jaccard-columns")
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    level = np.zeros(1 << bits, dtype=np.uint8)
    common = rows.where(F.col("n") >= max(HINT_LEAST, HINT_NOISE * total / (1 << bits)))
    for c, n in common.toLocalIterator():  # at most 2 ** HINT_BITS / HINT_NOISE rows of two numbers
        level[c] = int(n).bit_length()
    return level


def _sets(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(id, node, n, cells, prefix) of each row: signature, size, counts of the
    set by block of columns, and the first columns."""
    level, bits = _common_columns(docs, k), HINT_BITS

    def build(batches):
        for b in slices(batches):
            node, size, cells, prefix = [], [], [], []
            for text in b.column(1).to_pylist():
                grams = shingle_set(text, k)
                n = len(grams)
                node.append(signature(grams))
                size.append(n)
                cells.append(np.bincount((grams >> np.uint64(58)).astype(np.int64), minlength=CELLS).astype("<u4").tobytes())
                if n:
                    first = n - -(-num * n // den) + 1
                    rare = np.lexsort((grams, level[(grams >> np.uint64(64 - bits)).astype(np.int64)]))[:first]
                    grams = grams[rare]
                prefix.append(grams.view(np.int64))
            ends = np.cumsum([0, *map(len, prefix)])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(cells, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(prefix) if prefix else [], pa.int64())),
                ],
                ["id", "node", "n", "cells", "prefix"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return staged(
        docs.select("id", "text").mapInArrow(build, f"id {kind}, node long, n long, cells binary, prefix array<long>"),
        "jaccard-sets",
    )


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold, exactly."""

    def bound(batches):
        for b in slices(batches, 4096):
            na, nb = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            ca, cb = (np.frombuffer(b"".join(b.column(i).to_pylist()), dtype="<u4").reshape(-1, CELLS) for i in (4, 5))
            most = np.minimum(ca, cb).sum(axis=1, dtype=np.int64)
            # overlap / (na + nb - overlap) >= num / den
            keep = (num + den) * most >= num * (na + nb)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep))

    small = classes.select("node", "n", "cells")
    a, b = (small.toDF(s, "n" + s, "c" + s) for s in ("a", "b"))
    open_ = pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "ca", "cb")
    open_ = staged(open_.mapInArrow(bound, "a long, b long"), "jaccard-open")

    # the full sets of the rows still in question, from the text of one document each
    asked = open_.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = classes.join(asked, "node", "left_semi").select("id")
    texts = docs.join(wanted.withColumnRenamed("id", "w"), F.col("id").eqNullSafe(F.col("w")), "left_semi")

    def full(batches):
        for x in slices(batches):
            sets = [shingle_set(t, k) for t in x.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([signature(s) for s in sets], pa.int64()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())],
                ["node", "grams"],
            )

    sets = texts.select("text").mapInArrow(full, "node long, grams binary").dropDuplicates(["node"])
    sets = staged(sets.join(asked, "node", "left_semi"), "jaccard-full")

    def product(batches):
        for x in slices(batches):
            keep = [_linked(p, q, num, den) for p, q in zip(x.column(2).to_pylist(), x.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = open_.join(sets.toDF("a", "ga"), "a").join(sets.toDF("b", "gb"), "b").select("a", "b", "ga", "gb")
    return staged(both.mapInArrow(product, "a long, b long"), "jaccard-links")


def _linked(p: bytes, q: bytes, num: int, den: int) -> bool:
    a, b = np.frombuffer(p, dtype="<u8"), np.frombuffer(q, dtype="<u8")
    need = -(-num * (len(a) + len(b)) // (num + den))
    have, blocks = 0, 8
    cut = np.arange(1, blocks, dtype=np.uint64) << np.uint64(61)
    ea, eb = ([0, *np.searchsorted(x, cut).tolist(), len(x)] for x in (a, b))
    for i in range(blocks):
        have += len(np.intersect1d(a[ea[i] : ea[i + 1]], b[eb[i] : eb[i + 1]], assume_unique=True))
        if have + min(len(a) - ea[i + 1], len(b) - eb[i + 1]) < need:
            return False
    return have >= need


def jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 5,
    threshold: tuple[int, int] = (80, 100),
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the smallest id
    that links lead to, its own included)."""
    num, den = threshold
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sets = _sets(docs, k, num, den)
    classes = staged(
        sets.where("n > 0").groupBy("node").agg(
            F.min("id").alias("id"), F.first("n").alias("n"), F.first("cells").alias("cells"),
            F.first("prefix").alias("prefix"),
        ),
        "jaccard-classes",
    )
    # block of a row: sizes of a link are in the same block or in neighbours
    block = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num))).cast("int")
    entries = classes.select(F.posexplode("prefix").alias("pos", "col"), "node", "n", block.alias("block"))
    shared = entries.groupBy("col").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi")
    shared = staged(entries.join(shared.select("col"), "col", "left_semi"), "jaccard-entries")

    def close():
        """Sizes of a link, and enough columns left from the common one on."""
        n, m = F.col("n"), F.col("m")
        left = F.least(n - F.col("pos"), m - F.col("at"))
        return (n * num <= m * den) & (m * num <= n * den) & (left * (num + den) >= (n + m) * num)

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()

    pivot = shared.groupBy("col", "block").agg(F.min(F.struct("pos", "n", "node")).alias("p"))
    pivot = pivot.select(
        "col", F.explode(F.array("block", F.col("block") + 1)).alias("block"),
        F.col("p.n").alias("m"), F.col("p.pos").alias("at"), F.col("p.node").alias("other"),
    )
    first = shared.join(pivot, ["col", "block"]).where((F.col("node") != F.col("other")) & close())
    first = staged(ordered(first), "jaccard-pairs")
    links = _verified(first, classes, docs, k, num, den)

    part = connected_components(links)
    known = shared.join(part, "node", "left").select(
        "col", "pos", "node", "n", "block", F.coalesce("component", "node").alias("component")
    )
    known = staged(known, "jaccard-known")
    sizes = known.groupBy("col", "component").agg(F.count(F.lit(1)).alias("rows"))
    mixed = sizes.groupBy("col").agg(
        F.max(F.struct("rows", "component")).getField("component").alias("main"), F.count(F.lit(1)).alias("parts")
    ).where("parts > 1")
    rest = known.join(mixed, "col")
    outside = rest.where("component != main").select(
        "col", "pos", "node", "n", "component",
        F.explode(F.array("block", F.col("block") - 1, F.col("block") + 1)).alias("block"),
    )
    other = rest.select(
        "col", "block", F.col("node").alias("other"), F.col("n").alias("m"), F.col("pos").alias("at"),
        F.col("component").alias("to"),
    )
    second = outside.join(other, ["col", "block"]).where((F.col("component") != F.col("to")) & close())
    second = staged(ordered(second).join(first, ["a", "b"], "left_anti"), "jaccard-pairs")
    links = links.unionByName(_verified(second, classes, docs, k, num, den))

    part = connected_components(links)
    whole = classes.select("node", "id").join(part, "node", "left").select(
        "node", "id", F.coalesce("component", "node").alias("component")
    )
    least = whole.groupBy("component").agg(F.min("id").alias("component_id"))
    whole = whole.join(least, "component").select("node", "component_id")
    empty = F.col("n") == 0
    return sets.select("id", "node", "n").join(whole, "node", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(empty, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )
