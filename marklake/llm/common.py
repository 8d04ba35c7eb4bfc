"""What the operators share: stored intermediate tables, word hashes in numpy, places of a text in a batch."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marklake.functions.text import let  # noqa: F401 - for the operators
from marklake.session import ensure_checkpoint_dir

SMALLEST = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder's address under the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder once and read it from there: lineage ends, a lost executor costs only its tasks."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*frames: DataFrame) -> None:
    """Remove stored tables that nothing reads any more."""
    for df in frames:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def posix_folder(spark: SparkSession, name: str) -> str:
    """A new shared folder that workers can open and map: the checkpoint folder must be mounted on every machine."""
    where = urlparse(path := new_folder(spark, name))
    if where.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need a checkpoint folder that is mounted on all machines, not {path}")
    return where.path


def id_key(column: str = "doc_id") -> Column:
    """Ids as a key that joins: null ids are one id below all others."""
    return F.coalesce(F.col(column).cast("long"), F.lit(SMALLEST))


def numbered(df: DataFrame, group: list[str], order: list[str], buckets: int = 256) -> DataFrame:
    """`_rank`: a gapless number from 0 within each group, without ever sorting a whole group in one task.

    Rows are hashed into buckets; a bucket's numbers start behind those of the buckets before it. Rows equal in
    every order column are interchangeable. `df` is read twice: pass a stored table.
    """
    from pyspark.sql import Window

    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = df.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    within = Window.partitionBy(*group, "_bucket").orderBy(*order)
    return (
        df.withColumn("_place", F.row_number().over(within) - 1)
        .join(counts, [*group, "_bucket"])
        .withColumn("_rank", F.col("_place") + F.col("_from"))
        .drop("_bucket", "_place", "_from")
    )


# ---- what a worker process keeps ---------------------------------------------------------------------------------

_KEPT: dict[str, dict] = {}


def kept_by(owner: str) -> dict:
    """Where an operator keeps encoders, caches or mapped files of a worker process from task to task."""
    return _KEPT.setdefault(owner, {})


def begin_task(owner: str = "") -> None:
    """Spark uses a worker process again for other stages: what other operators have kept in it goes first."""
    for name, kept in _KEPT.items():
        if name != owner and kept:
            kept.clear()
            gc.collect()


# ---- words in numpy ---------------------------------------------------------------------------------------------

BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_LETTER = LOWER.astype(np.uint64) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_CHUNK = 1 << 18  # bytes of text whose work arrays (about 100 times as much) a worker holds at once


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    up = down = _powers(_BASE, 1)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(cls.up):
            cls.up, cls.down = _powers(_BASE, n), _powers(_INVERSE, n)
        return cls.up[:n], cls.down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of a splittable generator: equal numbers stay equal, others are scattered."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 places where they start; a null text is empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    buffers = texts.buffers()
    starts = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[starts[0] : starts[-1]], starts - starts[0]


def pieces(starts: np.ndarray, size: int = _CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about `size` bytes, so that work arrays stay small; one long text is a run of its own."""
    i, n = 0, len(starts) - 1
    while i < n:
        j = max(int(np.searchsorted(starts, starts[i] + size, "right")) - 1, i + 1)
        yield i, j
        i = j


def word_hashes(data: np.ndarray, starts: np.ndarray, prefix: int = 0, gaps: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts laid end to end, and how many words each text has.

    A-Z is lowered; words end at `gaps`, by default ASCII white space. With `prefix`, only that many first bytes of a
    word are hashed, and longer words are told from words that end there.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(starts) - 1, np.int64)
    gap = gaps[LOWER][data]
    first = ~gap
    first[1:] &= gap[:-1]
    edges = starts[:-1][np.diff(starts) > 0]
    first[edges] = ~gap[edges]
    last = ~gap
    last[:-1] &= gap[1:] | first[1:]
    a, b = np.flatnonzero(first), np.flatnonzero(last)
    up, down = _Powers.upto(n)
    total = _LETTER[data]
    total *= up
    total = np.cumsum(total, out=total)
    if prefix:
        cut = np.minimum(b, a + prefix - 1)
        longer = b > cut
        b = cut
    h = total[b]
    h[a > 0] -= total[a[a > 0] - 1]
    h = mix(h * down[a] + (b - a).astype(np.uint64))
    if prefix:
        h = np.where(longer, mix(h + np.uint64(prefix)), h)
    bounds = np.searchsorted(a, starts)
    return h, np.diff(bounds)


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words of each text, in text order, and how many each text has.

    A text of fewer words has its whole sequence as its one shingle; a text without words has none.
    """
    ends = np.cumsum(counts)
    out_counts = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    if not len(words):
        return words, out_counts
    total = np.zeros(len(words), np.uint64)
    factor = 1
    for k in range(width):
        factor = factor * 0xD1342543DE82EF95 % 2**64
        total[: max(len(words) - k, 0)] += words[k:] * np.uint64(factor)
    doc = np.repeat(np.arange(len(counts)), counts)
    left = ends[doc] - np.arange(len(words))
    keep = left >= width
    h = mix(total)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        at = ends[short] - counts[short]
        keep[at] = True
        for i, s in zip(at, short):
            x = int(counts[s])
            for w in words[i : i + counts[s]].tolist():
                x = int(mix(np.array([(x * 31 + w) % 2**64], np.uint64))[0])
            h[i] = x
    return h[keep], out_counts


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
