"""Operator 7: token-id files with a minimal perfect hash index.

Shards. The documents are range-partitioned and sorted by id; each task
encodes its range and writes one shard: the raw ids (little-endian unsigned, 2
bytes each, or 4 for larger vocabularies), then the directory (a null flag, the
id and the number of ids of each record), then a footer. A shard is written under a temporary name and renamed,
so a task that is run again leaves one whole file.

Index. The keys (non-null ids) are dealt by hash into parts of some ten
thousand keys. Each part is one file with a minimal perfect hash over its keys
(levels of bit arrays: a key that is alone at its place of a level is settled
there; its slot is the number of bits set before it) and one entry a slot: a
fingerprint of the key, its shard, the number of its record, how many records
share the id, the offset and the number of the ids. A lookup is a hash, a few
bit tests, one entry and one read at an offset, whatever the number of
documents.

Files are reached through pyarrow's file systems, so the folder may be in any
store they know. Nothing but one manifest row a shard leaves the tasks.

Cases: null text counts as empty (only the end id); rows that repeat an id are
adjacent records of one shard, and the index knows how many; null ids sort
first, are written, and can be scanned but not looked up; an unknown key is
told by its fingerprint and left out; an empty table makes no shard; other
columns are ignored.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from touchline.llm.common import mix64, new_path, staged
from touchline.llm.tokens import ID_BYTES, crc32, encoder, slices

MAGIC = b"TOKS0001"
FOOTER = "<8sQQQQ"  # magic, bytes an id, records, ids, start of the directory
DIRECTORY = np.dtype([("null", "u1"), ("id", "<i8"), ("n", "<u4")])
ENTRY = np.dtype([
    ("fp", "<u4"), ("shard", "<u4"), ("record", "<u4"), ("records", "<u4"), ("offset", "<u8"), ("n", "<u4"),
])
KEYS_PER_PART = 20_000
READ_AHEAD = 4 << 20  # bytes read at once while records follow each other


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def _publish(fs: pafs.FileSystem, temporary: str, final: str) -> None:
    if fs.get_file_info(final).type != pafs.FileType.NotFound:
        fs.delete_file(final)  # of an earlier attempt with the same rows
    fs.move(temporary, final)


# --- shards -----------------------------------------------------------------------
def write_shards(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, shards: int | None = None,
    id_col: str = "doc_id", text_col: str = "text", width: int = 2,
) -> DataFrame:
    """Writes the shards under `path`, `width` bytes an id; returns the
    manifest, one row a shard: shard, file, width, records, ids, base (ids of
    all shards before)."""
    if width not in (2, ID_BYTES):
        raise ValueError("width must be 2 or 4")
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(shards, F.col("id").asc_nulls_first())
    rows = rows.sortWithinPartitions(F.col("id").asc_nulls_first(), F.col("text").asc_nulls_first())

    def write(batches):
        enc = encoder(tokenizer_path)
        tail = int(end_id).to_bytes(ID_BYTES, "little")
        first = next(batches, None)
        if first is None:
            return
        shard = TaskContext.get().partitionId()
        fs, folder = _fs(path)
        fs.create_dir(folder, recursive=True)
        name = f"shard-{shard:06d}.tok"
        temporary = posixpath.join(folder, f"_{name}-{uuid.uuid4().hex}")
        directory, ids = [], 0

        def every():
            yield first
            yield from batches

        with fs.open_output_stream(temporary, buffer_size=1 << 20) as out:
            for b in slices(every()):
                part = np.zeros(b.num_rows, dtype=DIRECTORY)
                keys = b.column(0)
                part["null"] = keys.is_null().to_numpy(zero_copy_only=False)
                part["id"] = keys.fill_null(0).to_numpy(zero_copy_only=False)
                for i, text in enumerate(b.column(1).to_pylist()):
                    data = enc.encode(text) + tail
                    part["n"][i] = len(data) // ID_BYTES
                    out.write(_narrow(data, width))
                ids += int(part["n"].sum(dtype=np.int64))
                directory.append(part)
            table = np.concatenate(directory) if directory else np.zeros(0, dtype=DIRECTORY)
            out.write(table.tobytes())
            out.write(struct.pack(FOOTER, MAGIC, width, len(table), ids, ids * width))
        if len(table):
            _publish(fs, temporary, posixpath.join(folder, name))
            yield pa.RecordBatch.from_pydict(
                {"shard": [shard], "file": [f"{path}/{name}"], "width": [width], "records": [len(table)], "ids": [ids]},
                schema=pa.schema([("shard", pa.int64()), ("file", pa.string()), ("width", pa.int64()),
                                  ("records", pa.int64()), ("ids", pa.int64())]),
            )
        else:
            fs.delete_file(temporary)

    manifest = staged(rows.mapInArrow(write, "shard long, file string, width long, records long, ids long"), "tok-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    return manifest.select("*", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))


def _narrow(data: bytes, width: int) -> bytes:
    """32-bit ids with `width` bytes each."""
    if width == ID_BYTES:
        return data
    ids = np.frombuffer(data, dtype="<u4")
    if len(ids) and int(ids.max()) >> 16:
        raise ValueError("an id needs more than 16 bits: write with width=4")
    return ids.astype("<u2").tobytes()


def _wide(data: bytes, width: int) -> bytes:
    """The 32-bit form of stored ids."""
    return data if width == ID_BYTES else np.frombuffer(data, dtype="<u2").astype("<u4").tobytes()


def read_directory(file: str) -> np.ndarray:
    """The directory of one shard, without its ids."""
    fs, path = _fs(file)
    with fs.open_input_file(path) as f:
        size = f.size()
        magic, _, records, _, start = struct.unpack(FOOTER, f.read_at(struct.calcsize(FOOTER), size - struct.calcsize(FOOTER)))
        if magic != MAGIC:
            raise ValueError(f"{file} is no token shard")
        return np.frombuffer(f.read_at(records * DIRECTORY.itemsize, start), dtype=DIRECTORY)


def directory(manifest: DataFrame) -> DataFrame:
    """(id, shard, record, n, offset) of every record, read from the shards."""
    shards = manifest.select("shard", "file").repartition(F.col("shard"))

    def read(batches):
        for b in batches:
            for shard, file in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                d = read_directory(file)
                offset = np.cumsum(d["n"], dtype=np.int64) - d["n"]
                for at in range(0, len(d), 1 << 16):
                    x = d[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(x["id"].astype(np.int64), mask=x["null"].astype(bool)),
                            pa.array(np.full(len(x), shard, dtype=np.int64)),
                            pa.array(np.arange(at, at + len(x), dtype=np.int64)),
                            pa.array(x["n"].astype(np.int64)),
                            pa.array(offset[at : at + len(x)]),
                        ],
                        ["id", "shard", "record", "n", "offset"],
                    )

    return shards.mapInArrow(read, "id long, shard long, record long, n long, offset long")


# --- minimal perfect hash -----------------------------------------------------------
class PerfectHash:
    """Minimal perfect hash of distinct uint64 keys: `levels` bit arrays; keys
    that are the same number (so never alone) go to `rest`, searched last."""

    GAMMA, LEVELS = 2.0, 40

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray) -> None:
        self.levels, self.rest = levels, rest
        self.ranks, total = [], 0
        for bits in levels:
            count = np.cumsum(bits, dtype=np.int64)
            self.ranks.append(count - bits + total)
            total += int(count[-1]) if len(count) else 0
        self.settled = total

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix64(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        levels = []
        while len(keys) and len(levels) < cls.LEVELS:
            size = max(8, int(cls.GAMMA * len(keys)))
            place = cls._place(keys, len(levels), size)
            alone = np.bincount(place, minlength=size) == 1
            levels.append(alone.astype(np.uint8))
            keys = keys[~alone[place]]
        return cls(levels, np.sort(keys))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; some slot or -1 for a key that is not in it."""
        out = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.arange(len(keys))
        for level, (bits, rank) in enumerate(zip(self.levels, self.ranks)):
            place = self._place(keys[open_], level, len(bits))
            hit = bits[place] == 1
            out[open_[hit]] = rank[place[hit]]
            open_ = open_[~hit]
        if len(open_) and len(self.rest):
            at = np.searchsorted(self.rest, keys[open_])
            hit = (at < len(self.rest)) & (self.rest[np.minimum(at, len(self.rest) - 1)] == keys[open_])
            out[open_[hit]] = self.settled + at[hit]
        return out

    def dump(self) -> bytes:
        parts = [struct.pack("<II", len(self.levels), len(self.rest)), self.rest.astype("<u8").tobytes()]
        for bits in self.levels:
            parts += [struct.pack("<Q", len(bits)), np.packbits(bits).tobytes()]
        return b"".join(parts)

    @classmethod
    def load(cls, data: bytes) -> "PerfectHash":
        n, rest = struct.unpack_from("<II", data)
        at = 8 + rest * 8
        tail, levels = np.frombuffer(data[8:at], dtype="<u8"), []
        for _ in range(n):
            (size,) = struct.unpack_from("<Q", data, at)
            packed = np.frombuffer(data, dtype=np.uint8, count=(size + 7) // 8, offset=at + 8)
            levels.append(np.unpackbits(packed)[:size])
            at += 8 + len(packed)
        return cls(levels, tail)


# --- index --------------------------------------------------------------------------
def _hashes(key: Column, parts: int) -> list[Column]:
    h = F.xxhash64(key)
    return [F.pmod(F.xxhash64(key, F.lit("part")), F.lit(parts)).alias("part"), h.alias("h"),
            F.xxhash64(key, F.lit("fingerprint")).alias("fp")]


def _fingerprint(fp: pd.Series) -> np.ndarray:
    return (fp.to_numpy(dtype=np.int64).view(np.uint64) >> np.uint64(32)).astype(np.uint32)


def _part_file(path: str, part: int) -> str:
    return f"{path}/index-{part:06d}.mph"


def write_index(manifest: DataFrame, path: str, keys_per_part: int = KEYS_PER_PART) -> int:
    """Writes the index files under `path`; returns the number of parts. Ids
    that repeat are one key: their records follow each other."""
    entries = staged(
        directory(manifest).where("id IS NOT NULL").groupBy("id").agg(
            F.min_by(F.struct("shard", "record", "offset", "n"), "record").alias("e"),
            F.count(F.lit(1)).alias("records"),
        ),
        "tok-entries",
    )
    parts = max(1, -(-entries.count() // keys_per_part))
    dealt = entries.select(*_hashes(F.col("id"), parts), "e.shard", "e.record", "e.offset", "e.n", "records")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = pdf["h"].to_numpy(dtype=np.int64).view(np.uint64)
        order = np.argsort(keys, kind="stable")  # the same file from any attempt
        pdf, keys = pdf.iloc[order], keys[order]
        ph = PerfectHash.build(keys)
        slot = ph.slots(keys)
        same = np.flatnonzero(keys[1:] == keys[:-1]) + 1
        for i in same:  # keys with one hash: next places of the sorted rest
            slot[i] = slot[i - 1] + 1
        table = np.zeros(len(keys), dtype=ENTRY)
        for name in ("shard", "record", "records", "offset", "n"):
            table[name][slot] = pdf[name].to_numpy()
        table["fp"][slot] = _fingerprint(pdf["fp"])
        part = int(pdf["part"].iloc[0])
        body = ph.dump()
        fs, folder = _fs(path)
        fs.create_dir(folder, recursive=True)
        final = _fs(_part_file(path, part))[1]
        temporary = posixpath.join(folder, f"_index-{part}-{uuid.uuid4().hex}")
        with fs.open_output_stream(temporary) as out:
            out.write(struct.pack("<8sQQ", MAGIC, len(body), len(table)) + body + table.tobytes())
        _publish(fs, temporary, final)
        return pd.DataFrame({"part": [part], "keys": [len(table)]})

    built = dealt.groupBy("part").applyInPandas(build, "part long, keys long")
    built.agg(F.sum("keys")).first()
    return parts


def _load_part(path: str, part: int) -> tuple[PerfectHash, np.ndarray]:
    fs, file = _fs(_part_file(path, part))
    with fs.open_input_file(file) as f:
        data = f.read()
    _, body, n = struct.unpack_from("<8sQQ", data)
    at = 24 + body
    return PerfectHash.load(data[24:at]), np.frombuffer(data, dtype=ENTRY, count=n, offset=at)


def lookup(keys: DataFrame, path: str, parts: int, key_col: str = "id") -> DataFrame:
    """(id, shard, record, records, offset, n) of each key that the index knows."""
    wanted = keys.select(F.col(key_col).cast("long").alias("id")).where("id IS NOT NULL").distinct()
    wanted = wanted.select("id", *_hashes(F.col("id"), parts))

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        ph, table = _load_part(path, int(pdf["part"].iloc[0]))
        slot = ph.slots(pdf["h"].to_numpy(dtype=np.int64).view(np.uint64))
        found = slot >= 0
        fp = _fingerprint(pdf["fp"])
        for _ in range(len(ph.rest)):  # keys with one hash: the entry with the key's fingerprint
            off = found & (table["fp"][np.maximum(slot, 0)] != fp) & (slot >= ph.settled) & (slot + 1 < len(table))
            if not off.any():
                break
            slot = np.where(off, slot + 1, slot)
        entry = table[np.maximum(slot, 0)]
        found &= entry["fp"] == fp
        out = {"id": pdf["id"].to_numpy()[found]}
        for name in ("shard", "record", "records", "offset", "n"):
            out[name] = entry[name][found].astype(np.int64)
        return pd.DataFrame(out)

    return wanted.groupBy("part").applyInPandas(
        find, "id long, shard long, record long, records long, offset long, n long"
    )


def get(path: str, key_hashes: tuple[int, int, int], files: dict[int, tuple[str, int]]) -> bytes | None:
    """The ids of one key (32-bit form), by (part, h, fp) as `_hashes` gives
    them: one index entry and one read at an offset. files: file and width by
    shard."""
    part, h, fp = key_hashes
    pdf = pd.DataFrame({"h": [h], "fp": [fp]})
    ph, table = _load_part(path, part)
    slot = int(ph.slots(pdf["h"].to_numpy(dtype=np.int64).view(np.uint64))[0])
    if slot < 0 or table["fp"][slot] != _fingerprint(pdf["fp"])[0]:
        return None
    e = table[slot]
    name, width = files[int(e["shard"])]
    fs, file = _fs(name)
    with fs.open_input_file(file) as f:
        return _wide(f.read_at(int(e["n"]) * width, int(e["offset"]) * width), width)


def _read_records(f, offset: np.ndarray, n: np.ndarray, width: int) -> Iterator[bytes]:
    """The ids at each (offset, n), ascending, in 32-bit form; records that
    follow each other are read together, READ_AHEAD bytes at a time."""
    at, data = 0, b""
    for o, k in zip((offset * width).tolist(), (n * width).tolist()):
        if o < at or o + k > at + len(data):
            at, data = o, f.read_at(max(k, READ_AHEAD), o)
        yield _wide(data[o - at : o - at + k], width)


def read_located(located: DataFrame, manifest: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) for rows (id, shard, record, records,
    offset, n), read from the shards; `records` adjacent records a row."""
    files = manifest.select(F.col("shard").alias("s"), "file", "width", "base")
    rows = located.join(files, F.col("shard") == F.col("s")).drop("s")
    rows = rows.repartition("shard").sortWithinPartitions("shard", "offset")

    def read(batches):
        shard, f, sizes = None, None, None
        for b in slices(batches, 4096):
            x = b.to_pandas()
            out = []
            for s, group in x.groupby("shard", sort=False):
                if s != shard:
                    if f is not None:
                        f.close()
                    file = group["file"].iloc[0]
                    fs, path = _fs(file)
                    shard, f, sizes = s, fs.open_input_file(path), None
                many = group["records"].to_numpy()
                if (many > 1).any():
                    if sizes is None:
                        sizes = read_directory(group["file"].iloc[0])["n"].astype(np.int64)
                    group = group.loc[group.index.repeat(many)]
                    turn = np.concatenate([np.arange(m) for m in many])
                    n = sizes[group["record"].to_numpy() + turn]
                    whole = np.cumsum(n) - n
                    first = np.repeat(whole[turn == 0], many)
                    offset = group["offset"].to_numpy() + whole - first
                else:
                    n, offset = group["n"].to_numpy(), group["offset"].to_numpy()
                crc = [crc32(d) for d in _read_records(f, offset, n, int(group["width"].iloc[0]))]
                out.append(pd.DataFrame({
                    "id": group["id"].to_numpy(), "start": group["base"].to_numpy() + offset,
                    "n_tokens": n, "ids_crc32": np.array(crc, dtype=np.int64),
                }))
            if out:
                table = pd.concat(out)
                yield pa.RecordBatch.from_pandas(table, schema=schema, preserve_index=False)
        if f is not None:
            f.close()

    schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    cols = ["id", "shard", "record", "records", "offset", "n", "file", "width", "base"]
    return rows.select(cols).mapInArrow(read, "id long, start long, n_tokens long, ids_crc32 long")


class TokenFiles:
    """Token files under `path`: `write`, then `read_back` or `lookup`."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.path = path or new_path(spark, "tokens")
        self.manifest: DataFrame | None = None
        self.parts = 0

    def write(self, docs: DataFrame, tokenizer_path: str, end_id: int = 0, **options) -> "TokenFiles":
        self.manifest = staged(write_shards(docs, self.path, tokenizer_path, end_id, **options), "tok-manifest")
        self.parts = write_index(self.manifest, self.path)
        return self

    def lookup(self, keys: DataFrame, key_col: str = "id") -> DataFrame:
        return lookup(keys, self.path, self.parts, key_col)

    def read_back(self, keys: DataFrame, key_col: str = "doc_id") -> DataFrame:
        """Every record whose id is among `keys` (looked up in the index), and
        the records without an id (scanned)."""
        nulls = directory(self.manifest).where("id IS NULL").withColumn("records", F.lit(1).cast("long"))
        located = self.lookup(keys, key_col).unionByName(
            nulls.select("id", "shard", "record", "records", "offset", "n")
        )
        return read_located(located, self.manifest)
