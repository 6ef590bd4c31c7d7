"""Helpers shared by the operators: staged tables, connected components and
vectorised hashing of words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from touchline.session import checkpoint_dir

# The white space of every contract: space and U+0009..U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset a local session (tests) gets a
    temporary folder; a cluster session must name a shared one."""
    path = checkpoint_dir(spark)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return checkpoint_dir(spark, default="file://" + tempfile.mkdtemp(prefix="touchline-shared-"))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/touchline-{name}-{uuid.uuid4().hex}"


# The tables staged inside the current `settled`.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write `df` as a Parquet table in the shared folder and read it back;
    also its path.

    Cuts lineage (a lost executor costs a re-read, not a recomputation), gives
    the planner true sizes, and fixes values such as row numbers. The write's
    shuffle files are removed when it ends: nothing reads them again.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    if _made.get() is not None:
        _made.get().append(path)
    return spark.read.schema(df.schema).parquet(path), path


def staged(df: DataFrame, name: str) -> DataFrame:
    """`staged_at` without the path. The tables live until the owner of the
    shared folder clears it."""
    return staged_at(df, name)[0]


def settled(spark: SparkSession, build: Callable[[], DataFrame], name: str) -> DataFrame:
    """`staged` of what `build` returns; the tables that it staged on the way go,
    as nothing reads them any more."""
    token = _made.set([])
    try:
        out, path = staged_at(build(), name)
        made = _made.get()
    finally:
        _made.reset(token)
    for p in made:
        if p != path:
            discard(spark, p)
    if _made.get() is not None:
        _made.get().append(path)
    return out


def discard(spark: SparkSession, path: str) -> None:
    """Removes a staged table that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long")


def free_name(name: str, columns: list[str]) -> str:
    """`name`, or with underscores in front if a column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name = "_" + name
    return name


def document_key(id_col: str, text_col: str) -> Column:
    """A document as a value: its id (nulls last) and 80 bits of hashes of its
    text. Rows that repeat id and text have the same key; any others differ."""
    text = text_or_empty(text_col)
    return F.struct(
        F.col(id_col).isNull().alias("no"), F.col(id_col).alias("id"), F.xxhash64(text).alias("doc"),
        F.pmod(F.xxhash64(text, F.lit("tag")), F.lit(1 << 16)).cast("int").alias("tag"),
    )


def join_by_key(docs: DataFrame, keys: DataFrame, key: str, how: str, id_col: str, text_col: str) -> DataFrame:
    """`docs` joined with `keys` on the struct column `key` of document_key.
    Anti and semi joins with few keys are broadcast by their size."""
    doc, tag, number = (free_name(c, docs.columns) for c in ("__doc", "__tag", "__id"))
    side = keys.select(
        F.col(f"{key}.doc").alias(doc), F.col(f"{key}.tag").alias(tag), F.col(f"{key}.id").alias(number),
        *[F.col(c) for c in keys.columns if c != key],
    )
    own = document_key(id_col, text_col)
    on = (own["doc"] == F.col(doc)) & (own["tag"] == F.col(tag)) & F.col(id_col).eqNullSafe(F.col(number))
    out = docs.join(side, on, how)
    return out if how in ("left_anti", "left_semi") else out.drop(doc, tag, number)


# --- connected components -------------------------------------------------------
def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an undirected edge list; component
    is the smallest node that can be reached.

    Alternating large-star and small-star steps: each is one map-side combined
    min per node and one join, so a hub with very many neighbours is a partial
    aggregate and a splittable join, never a group held by one task. Edges
    only shrink; each round is staged, and the loop ends when a round changes
    nothing (number and sum of hashes of the edges).
    """
    u, v = F.col(a), F.col(b)
    cur = edges.where(u.isNotNull() & v.isNotNull() & (u != v)).select(
        F.greatest(u, v).alias("u"), F.least(u, v).alias("v")
    ).distinct()
    cur, path = staged_at(cur, "cc")
    mark = None
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour is linked to the smallest node around
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        # small star: the node and its smaller neighbours are linked to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        old = path
        cur, path = staged_at(small.where("u != v").distinct(), "cc")
        discard(edges.sparkSession, old)
        new = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(new) == mark:
            break
        mark = tuple(new)
    leaves = cur.groupBy("u").agg(F.min("v").alias("component"))
    roots = cur.select(F.col("v").alias("u"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots).select(F.col("u").alias("node"), "component")


# --- words as 64-bit hashes -----------------------------------------------------
_SEG = 1 << 19  # bytes hashed at a time: bounds memory (also of the power tables), also for very long texts
_BASE = 0x9E3779B97F4A7C15 | 1
_M64 = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class ByteHasher:
    """Hashes of byte ranges by prefix sums of a polynomial modulo 2**64 over
    a random byte table, finalised by `mix64`. Equal ranges get equal hashes
    whatever their place."""

    def __init__(self) -> None:
        self.table = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
        self.pow = _powers(_BASE, 1 << 16)
        self.inv = _powers(pow(_BASE, -1, 1 << 64), 1 << 16)

    def _grow(self, n: int) -> None:
        if n > len(self.pow):
            size = 1 << (n - 1).bit_length()
            self.pow = _powers(_BASE, size)
            self.inv = _powers(pow(_BASE, -1, 1 << 64), size)

    def prefix(self, buf: np.ndarray) -> np.ndarray:
        self._grow(len(buf) + 1)
        out = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum(self.table[buf] * self.pow[: len(buf)], dtype=np.uint64, out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = (end - start).astype(np.uint64)
        return mix64((prefix[end] - prefix[start]) * self.inv[start] + length * np.uint64(0x9FB21C651E98DF25))


_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_hasher: ByteHasher | None = None


def hasher() -> ByteHasher:
    global _hasher
    if _hasher is None:
        _hasher = ByteHasher()
    return _hasher


def _segments(data: bytes) -> Iterator[bytes]:
    """Pieces of about _SEG bytes, cut at white space where there is any."""
    at = 0
    while len(data) - at > _SEG:
        end = at + _SEG
        while end < len(data) and not _IS_SPACE[data[end]]:
            end += 1
        yield data[at:end]
        at = end
    yield data[at:]


def word_hashes(text: str) -> np.ndarray:
    """One uint64 for each word of the text, A-Z lower-cased."""
    h = hasher()
    out = []
    for seg in _segments(text.encode("utf-8", "surrogatepass")):
        buf = _LOWER[np.frombuffer(seg, dtype=np.uint8)]
        inside = np.zeros(len(buf) + 2, dtype=np.int8)
        inside[1:-1] = ~_IS_SPACE[buf]
        step = np.diff(inside)
        start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        if len(start):
            out.append(h.ranges(h.prefix(buf), start, end))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; a shorter text is one run; none is none."""
    if not len(words):
        return words
    k_here = min(k, len(words))
    n = len(words) - k_here + 1
    acc = np.full(n, np.uint64(k_here), dtype=np.uint64)
    for i in range(k_here):
        acc = mix64(acc * np.uint64(_BASE) + words[i : i + n])
    return acc
