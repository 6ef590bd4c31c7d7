"""Encoding whole texts with the tokenizers library, fast enough for a corpus.

The library encodes pre-tokens independently of each other, and no pre-token
of the two vocabularies used here reaches past the start of a run of white
space (byte-level: one space may lead a pre-token; word vocabulary: white
space is dropped). So a text is cut at white space, each chunk is encoded by
the library, and the ids are joined; a worker keeps the chunks it has seen
lately in a bounded store. A chunk of plain letters, with or without commas and
full stops behind them, is given to the library's BPE model directly; any
other chunk goes through its whole pipeline. Texts with white space other than
space, tab, LF and CR, or with an added token's string, are encoded whole.
"""

from __future__ import annotations

import ctypes
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

# One id as it is stored and summed: little-endian unsigned 32 bits.
ID_BYTES = 4
_CHUNK_STORE = 250_000  # chunks in each of the two generations of a worker's store
_LONG_CHUNK = 64  # longer chunks are encoded each time
_LONG_TAIL = 3
_ODD_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
_ODD_ASCII = re.compile("[\x0b\x0c\x1c-\x1f]")
_BYTE_LEVEL = re.compile(r" ?\S+|\s+(?!\S)|\s+")
# White space that the byte-level split by lines and spaces can't take: runs,
# tabs and returns (and any at a text's ends).
_UNEVEN = ("  ", "\t", "\r", "\n\n", " \n", "\n ")


def _byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the
    others for code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(other)}}


class _Chunks(dict):
    """Ids by chunk, in two generations: what was used lately survives."""

    def __init__(self, learn) -> None:
        super().__init__()
        self.learn, self.old = learn, {}

    def __missing__(self, chunk: str) -> bytes:
        if len(chunk) > _LONG_CHUNK:
            return self.learn(chunk)
        got = self.old.get(chunk)
        if got is None:
            got = self.learn(chunk)
        if len(self) >= _CHUNK_STORE:
            self.old = dict(self)
            self.clear()
        self[chunk] = got
        return got


class ChunkEncoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as fh:
            spec = json.load(fh)
        self.lower = spec["pre_tokenizer"]["type"] != "ByteLevel"
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        self.alphabet = _byte_alphabet()
        self.as_bytes = [i.to_bytes(ID_BYTES, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.tails: dict[str, bytes] = {"": b""}
        # chunks at the start of a line, and (byte-level) chunks led by a space
        self.store = _Chunks(lambda chunk: self._learn(chunk, ""))
        self.after_space = _Chunks(lambda chunk: self._learn(chunk, " "))

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, chunk: str, lead: str) -> bytes:
        core = chunk.rstrip(",.")
        plain = core.isalpha() and (core.isascii() or max(core) <= "\xff")
        if not plain or len(chunk) - len(core) > _LONG_TAIL:
            return self._whole(lead + chunk)
        if len(core) < len(chunk):
            tail = chunk[len(core) :]
            if tail not in self.tails:
                self.tails[tail] = self._whole(tail)
            return (self.after_space if lead else self.store)[core] + self.tails[tail]
        piece = core.lower() if self.lower else core
        if not piece.isascii():
            piece = "".join(map(self.alphabet.__getitem__, piece.encode()))
        if lead:
            piece = self.alphabet[0x20] + piece
        table = self.as_bytes
        return b"".join([table[t.id] for t in self.model.tokenize(piece)])

    def _even(self, text: str) -> bytes:
        """A byte-level text whose white space is single spaces and single
        newlines between other characters."""
        first, rest = self.store.__getitem__, self.after_space.__getitem__
        newline, out = first("\n"), []
        for line in text.split("\n"):
            words = line.split(" ")
            out.append(first(words[0]))
            out.extend(map(rest, words[1:]))
            out.append(newline)
        out.pop()
        return b"".join(out)

    def _piece(self, text: str) -> bytes:
        if self.lower:
            return b"".join(map(self.store.__getitem__, text.split()))
        if not (text[0].isspace() or text[-1].isspace() or any(x in text for x in _UNEVEN)):
            return self._even(text)
        return b"".join([
            self.after_space[c[1:]] if c[0] == " " and len(c) > 1 and c[1] != " " else self.store[c]
            for c in _BYTE_LEVEL.findall(text)
        ])

    def encode(self, text: str | None) -> bytes:
        """The ids of the whole text, 4 bytes each."""
        if not text:
            return b""
        odd = _ODD_ASCII if text.isascii() else _ODD_SPACE
        if odd.search(text) or ("<" in text and self.special.search(text)):
            return self._whole(text)
        out = []
        # pieces that end before a space, so that a very long text needs no
        # list of all its chunks
        at, n = 0, len(text)
        while at < n:
            end = n
            if n - at > 1 << 20:
                end = text.find(" ", at + (1 << 20))
                while 0 < end and (end + 1 >= n or text[end + 1].isspace() or text[end - 1].isspace()):
                    end = text.find(" ", end + 1)
                end = n if end < 0 else end
            out.append(self._piece(text if end - at == n else text[at:end]))
            at = end
        return b"".join(out)


_encoders: dict[str, ChunkEncoder] = {}
_encoding = False  # whether the task at hand encodes


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder. It lasts until a task that doesn't encode reads `slices`."""
    global _encoding
    _encoding = True
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


_SLICE_BYTES = 4 << 20


def _give_back() -> None:
    """Memory that the worker has freed goes back to the system: workers wait
    between tasks, and beside those of other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim is not None:
        trim(0)


def slices(
    batches: Iterator[pa.RecordBatch], rows: int = 256, most: int = _SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Small batches: at most `rows` rows, and no more text once they hold
    `most` bytes, so that several very long texts are not in work at a time. A task
    that didn't ask for an encoder lets those of earlier tasks go."""
    global _encoding
    if not _encoding:
        _encoders.clear()
    for batch in batches:
        texts = [c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_large_string(c.type)]
        size = np.zeros(batch.num_rows, dtype=np.int64)
        for c in texts:
            size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        upto = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            before = upto[at - 1] if at else 0
            end = int(np.searchsorted(upto, before + most, side="right"))
            end = min(max(end, at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, end - at)
            at = end
    batch, _encoding = None, False
    _give_back()


def token_ids(
    docs: DataFrame, path: str, id_col: str, text_col: str, end_id: int | None, width: int = ID_BYTES
) -> DataFrame:
    """(row, id, n_tokens, ids): `ids` binary, `width` bytes an id (2 for
    vocabularies of at most 65,536), with `end_id` appended if given. `row`
    numbers the rows; it is fixed once staged."""
    source = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")
    )
    tail = b"" if end_id is None else int(end_id).to_bytes(ID_BYTES, "little")

    def encode(batches):
        enc = encoder(path)
        for b in slices(batches):
            ids = [enc.encode(t) + tail for t in b.column(2).to_pylist()]
            n = pa.array([len(x) // ID_BYTES for x in ids], pa.int64())
            if width != ID_BYTES:
                ids = [np.frombuffer(x, dtype="<u4").astype(f"<u{width}").tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), n, pa.array(ids, pa.binary())], ["row", "id", "n_tokens", "ids"]
            )

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(encode, f"row long, id {kind}, n_tokens long, ids binary")


def token_lengths(docs: DataFrame, path: str, text_col: str) -> DataFrame:
    """(n_tokens) of each row."""

    def count(batches):
        enc = encoder(path)
        for b in slices(batches):
            n = [len(enc.encode(t)) // ID_BYTES for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], ["n_tokens"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(count, "n_tokens long")
