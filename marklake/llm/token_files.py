"""Token ids of documents in binary files whose document boundaries are Elias-Fano encoded.

A file holds the ids of its documents end to end, two bytes each where the vocabulary allows, and behind them two
Elias-Fano sequences: the ends of the documents among the ids, and the documents' ids. Each takes 2 + log2(range / n)
bits a number; a select structure over its unary part (a 32-bit sample for every 64th number, explicit places where 64
numbers lie far apart) finds any number by reading at most 2 KB, so no table of 64-bit offsets exists anywhere.

Layout: magic, ids, ends, document ids, then a footer of lengths and the magic again. Files are written through
`pyarrow.fs`, so a checkpoint folder may be a mounted one or an object store that it knows; a name is never used twice,
and only files named in the stored manifest count, so that a repeated task leaves nothing double.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marklake.llm.common import begin_task, kept_by, new_folder, stored
from marklake.llm.tokenizing import library_ids

MAGIC = b"TOKENS01"
_EVERY, _FAR, _CHUNK = 64, 16384, 1 << 16
_ENCODERS: dict[str, Callable[[str], np.ndarray]] = kept_by("token-files")


class EliasFano:
    """Ascending numbers from 0 to 2^64 - 1, repeats allowed, with random access."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray, far: np.ndarray, places: np.ndarray):
        self.n, self.bits, self.low, self.high, self.samples, self.far, self.places = n, bits, low, high, samples, far, places

    def __len__(self) -> int:
        return self.n

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.ascontiguousarray(values, np.uint64)
        n = len(values)
        if n and (values[1:] < values[:-1]).any():
            raise ValueError("the numbers must ascend")
        bits = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
        low = [np.zeros(0, np.uint8)]
        for i in range(0, n if bits else 0, _CHUNK):  # whole bytes: a chunk is a multiple of eight numbers
            each = np.unpackbits(values[i : i + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            low.append(np.packbits(each[:, :bits], bitorder="little"))
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        length = int(ones[-1]) + 1 if n else 0
        if length >= 1 << 32:
            raise ValueError("too many numbers for one file")
        high = np.zeros(length, np.uint8)
        high[ones] = 1
        samples = ones[::_EVERY].astype(np.uint32)
        last = np.append(ones[_EVERY - 1 :: _EVERY], ones[-1:] if n % _EVERY else [])
        far = np.flatnonzero(last - samples > _FAR).astype(np.uint32)
        padded = np.append(ones, np.zeros(-n % _EVERY, np.int64)).reshape(-1, _EVERY)
        return cls(n, bits, np.concatenate(low), np.packbits(high, bitorder="little"), samples, far, padded[far].astype(np.uint32))

    def _lows(self, a: int, b: int) -> np.ndarray:
        if not self.bits:
            return np.zeros(b - a, np.uint64)
        first, last = a * self.bits, b * self.bits
        held = np.unpackbits(self.low[first // 8 : (last + 7) // 8], bitorder="little")[first % 8 :][: last - first]
        out = np.zeros((b - a, 64), np.uint8)
        out[:, : self.bits] = held.reshape(b - a, self.bits)
        return np.packbits(out, axis=1, bitorder="little").view(np.uint64).ravel()

    def _ones(self, block: int) -> np.ndarray:
        """Places of the ones of one block of 64 numbers."""
        size = min(_EVERY, self.n - block * _EVERY)
        at = int(np.searchsorted(self.far, block))
        if at < len(self.far) and self.far[at] == block:
            return self.places[at, :size].astype(np.int64)
        start = int(self.samples[block])
        held = np.unpackbits(self.high[start // 8 : (start + _FAR) // 8 + 1], bitorder="little")
        ones = np.flatnonzero(held)
        return start // 8 * 8 + ones[ones >= start % 8][:size]

    def between(self, a: int, b: int) -> np.ndarray:
        """The numbers a to b - 1."""
        if a >= b:
            return np.zeros(0, np.uint64)
        blocks = range(a // _EVERY, (b - 1) // _EVERY + 1)
        if len(blocks) > 8:  # in one go, from one sample to the next
            start = int(self.samples[blocks[0]])
            end = int(self.samples[blocks[-1] + 1]) if blocks[-1] + 1 < len(self.samples) else len(self.high) * 8
            ones = start // 8 * 8 + np.flatnonzero(np.unpackbits(self.high[start // 8 : (end + 7) // 8], bitorder="little"))
            ones = ones[ones >= start]
        else:
            ones = np.concatenate([self._ones(k) for k in blocks])
        skip = a - blocks[0] * _EVERY
        ones = ones[skip : skip + b - a] - np.arange(a, b)
        return ones.astype(np.uint64) << np.uint64(self.bits) | self._lows(a, b)

    def select(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.between(i, i + 1)[0])

    def below(self, value: int) -> int:
        """How many numbers are smaller than `value`."""
        a, b = 0, self.n
        while a < b:
            mid = (a + b) // 2
            a, b = (mid + 1, b) if self.select(mid) < value else (a, mid)
        return a

    def to_bytes(self) -> bytes:
        parts = [self.low, self.high, self.samples, self.far, self.places]
        return struct.pack("<7Q", self.n, self.bits, *(len(x) for x in parts)) + b"".join(x.tobytes() for x in parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, bits, *lengths = struct.unpack_from("<7Q", data)
        at, parts = 56, []
        for many, kind, each in zip(lengths, ("u1", "u1", "<u4", "<u4", "<u4"), (1, 1, 1, 1, _EVERY)):
            parts.append(np.frombuffer(data, kind, many * each, at))
            at += parts[-1].nbytes
        return cls(n, bits, *parts[:4], parts[4].reshape(-1, _EVERY))


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address and the path in it."""
    where = urlparse(path)
    return (fs.LocalFileSystem(), where.path) if where.scheme in ("", "file") else fs.FileSystem.from_uri(path)


class TokenWriter:
    """One file in the making. Documents come in ascending order of their ids, null ids first."""

    def __init__(self, path: str, width: int):
        system, inner = opened(path)
        self.path, self.kind = path, np.dtype(f"<u{width}")
        self.out = system.open_output_stream(inner)
        self.out.write(MAGIC)
        self.tokens, self.nulls, self.waiting = 0, 0, 0
        self.held: list[np.ndarray] = []
        self.lengths: list[int] = []
        self.keys: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if doc_id is None:
            self.nulls += 1
        else:
            self.keys.append(doc_id)
        if len(ids) and int(ids.max()) > np.iinfo(self.kind).max:
            raise ValueError("an id needs more bytes than the file gives it")
        self.held.append(ids)
        self.lengths.append(len(ids))
        self.tokens += len(ids)
        self.waiting += len(ids)
        if self.waiting >= 1 << 20:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            self.out.write(np.concatenate(self.held).astype(self.kind).tobytes())
            self.held, self.waiting = [], 0

    def close(self) -> None:
        self._flush()
        ends = EliasFano.of(np.cumsum(np.array(self.lengths, np.int64)).astype(np.uint64)).to_bytes()
        first = self.keys[0] if self.keys else 0
        keys = EliasFano.of(np.array([k - first for k in self.keys], np.uint64)).to_bytes()
        footer = {"width": self.kind.itemsize, "tokens": self.tokens, "nulls": self.nulls, "first": first, "ends": len(ends), "keys": len(keys)}
        footer = json.dumps(footer).encode()
        self.out.write(ends + keys + footer + struct.pack("<I", len(footer)) + MAGIC)
        self.out.close()


class TokenFile:
    """A finished file: any document's ids by its place, any token's document by its place."""

    def __init__(self, path: str):
        system, inner = opened(path)
        self.file = system.open_input_file(inner)
        size = self.file.size()
        tail = self.file.read_at(len(MAGIC) + 4, size - len(MAGIC) - 4)
        if tail[4:] != MAGIC or self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{path} is no whole token file")
        (length,) = struct.unpack("<I", tail[:4])
        at = size - len(MAGIC) - 4 - length
        self.footer = json.loads(self.file.read_at(length, at))
        self.kind, self.tokens = np.dtype(f"<u{self.footer['width']}"), self.footer["tokens"]
        self.keys = EliasFano.from_bytes(self.file.read_at(self.footer["keys"], at - self.footer["keys"]))
        at -= self.footer["keys"] + self.footer["ends"]
        self.ends = EliasFano.from_bytes(self.file.read_at(self.footer["ends"], at))

    def __len__(self) -> int:
        return len(self.ends)

    def starting_before(self, token: int) -> int:
        """How many documents start before the given place among the ids."""
        return 0 if token <= 0 else min(self.ends.below(token) + 1, len(self))

    def offsets(self, a: int, b: int) -> np.ndarray:
        """Where documents a to b - 1 start, and where the last of them ends."""
        ends = self.ends.between(max(a - 1, 0), b).astype(np.int64)
        return ends if a else np.concatenate([[0], ends])

    def ids(self, start: int, end: int) -> np.ndarray:
        each = self.kind.itemsize
        return np.frombuffer(self.file.read_at((end - start) * each, len(MAGIC) + start * each), self.kind)

    def document(self, i: int) -> np.ndarray:
        start, end = self.offsets(i, i + 1)
        return self.ids(int(start), int(end))

    def names(self, a: int, b: int) -> list[int | None]:
        """The documents' ids."""
        nulls, first = self.footer["nulls"], self.footer["first"]
        known = self.keys.between(max(a - nulls, 0), max(b - nulls, 0))
        return [None] * max(min(b, nulls) - a, 0) + [int(k) + first for k in known]

    def close(self) -> None:
        self.file.close()


def _written(folder: str, vocabulary: str, end: int, width: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task("token-files")
        if vocabulary not in _ENCODERS:
            _ENCODERS[vocabulary] = library_ids(public_tokenizers.path(vocabulary))
        encode, last = _ENCODERS[vocabulary], np.array([end], np.uint32)
        part, number, writer = TaskContext.get().partitionId(), 0, None

        def closed() -> pa.RecordBatch:
            writer.close()
            row = {"part": part, "number": number, "file": writer.path, "docs": len(writer.lengths), "tokens": writer.tokens}
            return pa.RecordBatch.from_pylist([row])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                if writer is None:
                    writer = TokenWriter(f"{folder}/{uuid.uuid4().hex}.tokens", width)
                writer.add(doc_id, np.concatenate([encode(text.as_py() or ""), last]))
                if writer.tokens >= most:
                    yield closed()
                    writer, number = None, number + 1
        if writer is not None:
            yield closed()

    return run


def write_token_files(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end: int = 0, width: int = 2, most: int = 1 << 25) -> DataFrame:
    """Write the ids of all documents, each followed by `end`, and return the stored manifest: one row per file with
    (part, number, file, docs, tokens, start), where `start` counts the ids of all files before it.

    Documents lie in ascending order of doc_id, null ids first, over all files in the order of (part, number). Repeated
    rows are documents of their own; those of one doc_id lie in the order of their text's hash, so that they may be many
    tasks' work. A null or empty text is `end` alone. A file ends with the document that brings it to `most` ids; a very
    long text is one document of one file. `width` is an id's bytes: a larger id stops the job. Other columns are not
    read. An empty table gives no files.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "token-files")
    system, inner = opened(folder)
    system.create_dir(inner, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    files = stored(ordered.mapInArrow(_written(folder, vocabulary, end, width, most), "part long, number long, file string, docs long, tokens long"), "token-manifest")
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return files.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _read(piece: int, digest: bool, step: int = 1 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task("token-files")
        for batch in batches:
            for row in batch.to_pylist():
                file = TokenFile(row["file"])
                a, b = file.starting_before(row["from"]), file.starting_before(row["from"] + piece)
                while a < b:
                    first = int(file.offsets(a, a + 1)[0])
                    c = min(max(file.starting_before(first + step), a + 1), b)
                    places = file.offsets(a, c)
                    ids = file.ids(first, int(places[-1])).astype("<u4")
                    cuts, names = (places - first).tolist(), file.names(a, c)
                    if digest:
                        data = memoryview(ids).cast("B")
                        what = pa.array([zlib.crc32(data[4 * s : 4 * e]) for s, e in zip(cuts, cuts[1:])], pa.int64())
                    else:
                        what = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int64)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names, pa.int64()), pa.array(places[:-1] + row["start"]), pa.array(np.diff(places)), what],
                        names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"],
                    )
                    a = c
                file.close()

    return run


def read_token_files(manifest: DataFrame, digest: bool = False, piece: int = 1 << 23) -> DataFrame:
    """The documents of a manifest's files: (doc_id, start, n_tokens, ids), or with `digest` the unsigned crc32 of the
    ids as little-endian 32-bit numbers instead of them. Tasks read runs of about `piece` ids, found by the boundaries."""
    runs = manifest.select("file", "start", F.explode(F.sequence(F.lit(0), F.greatest("tokens", F.lit(1)) - 1, F.lit(piece))).alias("from"))
    tasks = 8 * manifest.sparkSession.sparkContext.defaultParallelism
    what = "ids_crc32 long" if digest else "ids array<long>"
    return runs.repartition(tasks).mapInArrow(_read(piece, digest), f"doc_id long, start long, n_tokens long, {what}")
