"""Runs of words as 64-bit hashes, and a filter of the runs that are wanted: what a map stage can tell without a join.

The filter is a Bloom filter of bitmaps that Spark builds and merges; a task tests it on whole arrays of hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from marklake.session import BROADCAST_LIMIT_BYTES

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_PROBES, _BITS_EACH, _PAGE = 4, 16, 32768  # a page is one bitmap of Spark's


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_KEPT = 1 << 16  # numbers; longer texts make their own


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_UP, _DOWN = _powers(_KEPT)


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words of a text, which single spaces part."""
    data = np.frombuffer(text.encode(), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    gap = np.flatnonzero(data == 32)
    starts, ends = np.append(0, gap + 1), np.append(gap, len(data))
    up, down = (_UP[: len(data)], _DOWN) if len(data) <= _KEPT else _powers(len(data))
    total = np.append(np.uint64(0), np.cumsum((data + np.uint64(1)) * up))
    starts, ends = starts[ends > starts], ends[ends > starts]
    return _mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def run_hashes(words: np.ndarray, n: int, bits: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the distinct runs of n words; with the bytes of a filter, of those it may hold: only they are sorted."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        total = _mix(total + words[k : len(words) - n + 1 + k])
    return np.unique(total if bits is None else _passed(total, bits))


def _probed(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Places of each hash in a filter of so many bits, one row a probe."""
    step = _mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    return np.stack([(hashes + np.uint64(k) * step) % np.uint64(bits) for k in range(_PROBES)])


def _passed(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The hashes whose places are all set, probe by probe: each tests what the one before has left."""
    step = None
    for k in range(_PROBES):
        if k:
            step = _mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
        at = (hashes if step is None else hashes + np.uint64(k) * step) % np.uint64(8 * len(bits))
        hashes = hashes[(bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).view(bool)]
    return hashes


def hashed_runs(df: DataFrame, words: str, lengths: list[int] | str, out: str = "run", wanted=None) -> DataFrame:
    """Each row once per distinct run of its text `words`, of the given lengths or of that in a column; the text goes. With
    `wanted`, a filter from `run_filter`, only for runs that it may hold."""
    kept = [c for c in df.columns if c != words]
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField(out, T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if wanted is None else np.frombuffer(wanted.value, np.uint8)
        for batch in batches:
            found, counts = [], []
            sizes = batch.column(lengths).to_pylist() if isinstance(lengths, str) else [lengths] * batch.num_rows
            for text, size in zip(batch.column(words).to_pylist(), sizes):
                w = word_hashes(text or "")
                h = np.concatenate([run_hashes(w, n, bits) for n in ([size] if isinstance(size, int) else size)])
                found.append(h)
                counts.append(len(h))
            rows = pa.array(np.repeat(np.arange(len(counts)), counts))
            hashes = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in kept), pa.array(hashes)], schema=arrow)

    return df.mapInArrow(run, schema)


def run_filter(runs: DataFrame, column: str = "run"):
    """A filter of the hashes in a column, as a broadcast value. Its size follows their number up to the limit of what is
    broadcast; beyond that it lets more through, never less."""
    spark = runs.sparkSession
    n = runs.agg(F.approx_count_distinct(column)).first()[0]
    bits = min(BROADCAST_LIMIT_BYTES * 8, max(1, -(-n * _BITS_EACH // _PAGE)) * _PAGE)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_probed(batch.column(0).to_numpy().view(np.uint64), bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at // _PAGE), pa.array(at % _PAGE)], names=["page", "bit"])

    pages = runs.select(column).mapInArrow(places, "page long, bit long").groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))
    whole = bytearray(bits // 8)
    for row in pages.collect():  # as many pages as the limit allows
        whole[row["page"] * _PAGE // 8 : (row["page"] + 1) * _PAGE // 8] = row["bits"]
    return spark.sparkContext.broadcast(bytes(whole))
