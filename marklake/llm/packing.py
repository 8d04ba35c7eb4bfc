"""Documents packed into sequences of a fixed number of tokens by linear grouping, then best fit.

Only the histogram of piece lengths (at most one row per length up to the capacity) reaches the driver, where the plan
is made: large lengths are cut into groups of equal cardinality and rounded up to their group's largest; patterns over
these few sizes are chosen one after another, each around the largest size left and filled as fully as a subset-sum
over the sizes allows, and used as often as the demand lasts; the slots then take actual pieces, longest first, which
frees what rounding up had added; small lengths go to the tightest sequences that hold them. The plan says, for runs
of numbered pieces of one length, in which run of sequences and at which offset they lie; each piece finds its place
from its number within its length.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marklake.llm.common import begin_task, kept_by, numbered, stored
from marklake.llm.tokenizing import library_ids

_ENCODERS: dict[tuple[str, bool], Callable[[str], np.ndarray]] = kept_by("packing")


def _cut(vocabulary: str, end: int, capacity: int, added: bool):
    last = struct.pack("<I", end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task("packing")
        if (vocabulary, added) not in _ENCODERS:
            _ENCODERS[vocabulary, added] = library_ids(public_tokenizers.path(vocabulary), added)
        encode = _ENCODERS[vocabulary, added]
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = encode(text.as_py() or "").astype("<u4", copy=False).tobytes() + last
                n = len(ids) // 4
                start, size = 0, (n - 1) % capacity + 1
                for piece in range((n + capacity - 1) // capacity):
                    for column, value in zip(rows, (doc_id, piece, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]))):
                        column.append(value)
                    start, size = start + size, capacity
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(rows, types)], names=["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return run


def token_pieces(docs: DataFrame, vocabulary: str, end: int, capacity: int, added: bool = True) -> DataFrame:
    """Documents as runs of at most `capacity` ids; all but a document's first run are full."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_cut(vocabulary, end, capacity, added), "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Plan:
    """Runs of pieces placed so far: (length, first piece, how many, first sequence, offset)."""

    def __init__(self, histogram: dict[int, int], capacity: int, groups: int, small: int):
        self.capacity = capacity
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.used = dict.fromkeys(histogram, 0)
        self.sequences = 0
        self.free: list[tuple[int, int, int]] = []  # (room, first sequence, how many), ascending
        large = {x: n for x, n in histogram.items() if x > small}
        full = large.pop(capacity, 0)
        if full:
            self.place(capacity, full, self.open(full), 0)
        self.fill_patterns(self.grouped(large, groups))
        for x in sorted((x for x in histogram if x <= small), reverse=True):
            self.best_fit(x, histogram[x])

    def open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def place(self, length: int, n: int, sequence: int, offset: int) -> None:
        self.runs.append((length, self.used[length], n, sequence, offset))
        self.used[length] += n

    @staticmethod
    def grouped(large: dict[int, int], groups: int) -> list[list[list[int]]]:
        """Runs [length, count] of each group, longest first; all groups but the last hold equally many pieces."""
        total = sum(large.values())
        per = max(1, -(-total // groups))
        out: list[list[list[int]]] = []
        room = 0
        for x in sorted(large, reverse=True):
            n = large[x]
            while n:
                if not room:
                    out.append([])
                    room = per
                take = min(n, room)
                out[-1].append([x, take])
                n, room = n - take, room - take
        return out

    def pattern(self, sizes: list[int], left: list[int]) -> list[int]:
        """Groups whose sizes fill a sequence best, the first group that has pieces left among them."""
        first = next(g for g, n in enumerate(left) if n)
        room = self.capacity - sizes[first]
        reach, steps = 1, []
        mask = (1 << (room + 1)) - 1
        for g in range(first, len(sizes)):
            for _ in range(min(left[g] - (g == first), room // sizes[g])):
                steps.append((g, reach))
                grown = reach | reach << sizes[g] & mask
                if grown == reach:
                    steps.pop()
                    break
                reach = grown
            if reach >> room & 1:
                break
        at, chosen = reach.bit_length() - 1, [first]
        for g, before in reversed(steps):
            if not before >> at & 1:
                chosen.append(g)
                at -= sizes[g]
        return chosen

    def fill_patterns(self, groups: list[list[list[int]]]) -> None:
        sizes = [runs[0][0] for runs in groups]
        left = [sum(n for _, n in runs) for runs in groups]
        while any(left):
            chosen = self.pattern(sizes, left)
            times = min(left[g] // chosen.count(g) for g in set(chosen))
            sequence = self.open(times)
            for g in set(chosen):
                left[g] -= times * chosen.count(g)
            slots = []
            for g in chosen:  # each slot takes the group's next pieces, one per sequence
                need, taken = times, []
                while need:
                    run = groups[g][0]
                    take = min(need, run[1])
                    taken.append([run[0], take])
                    run[1] -= take
                    need -= take
                    if not run[1]:
                        groups[g].pop(0)
                slots.append(taken)
            done = 0
            while done < times:  # sequences that hold the same lengths go together
                n = min(s[0][1] for s in slots)
                offset = 0
                for s in slots:
                    self.place(s[0][0], n, sequence + done, offset)
                    offset += s[0][0]
                    s[0][1] -= n
                    if not s[0][1]:
                        s.pop(0)
                if offset < self.capacity:
                    insort(self.free, (self.capacity - offset, sequence + done, n))
                done += n

    def best_fit(self, length: int, n: int) -> None:
        while n:
            i = bisect_left(self.free, (length, -1, 0))
            if i == len(self.free):
                each = self.capacity // length
                many = -(-n // each)
                self.free.append((self.capacity, self.open(many), many))
            room, sequence, many = self.free.pop(i)
            take = min(n, many)
            self.place(length, take, sequence, self.capacity - room)
            if take < many:
                insort(self.free, (room, sequence + take, many - take))
            if room > length:
                insort(self.free, (room - length, sequence, take))
            n -= take


def plan(histogram: dict[int, int], capacity: int, groups: int = 512, small: int = 256) -> list[tuple[int, int, int, int, int]]:
    """(length, first piece, how many, first sequence, offset) for all pieces of a histogram of lengths up to `capacity`."""
    return sorted(_Plan(histogram, capacity, groups, small).runs)


def _placed(runs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, sequence, offset = runs.value
        for batch in batches:
            rank = batch.column("_rank").to_numpy()
            i = np.searchsorted(keys, batch.column("length").to_numpy() << 48 | rank, "right") - 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            arrays = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(sequence[i] + rank - first[i]), pa.array(offset[i])], names=[*names, "sequence_id", "offset"]
            )

    return run


def packed_sequences(
    docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end: int = 0, capacity: int = 2048, groups: int = 512, small: int = 256,
    added: bool = True,
) -> DataFrame:
    """Where each piece of each document lies: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    A document is its text's ids and `end`; a null or empty text is `end` alone. Only documents of over `capacity` ids
    are cut. Repeated rows are documents of their own, null ids are allowed, other columns are not read, and an empty
    table gives no rows. Strings of the vocabulary's added tokens (<|endoftext|>) get those tokens' ids, as by the library's
    default settings, unless `added` is False. A very long text is encoded whole in its task. Sequences are numbered from 0 and filled without gaps from offset 0.
    """
    rows = stored(token_pieces(docs, vocabulary, end, capacity, added), "token-pieces")
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = np.array(plan(histogram, capacity, groups, small), np.int64).reshape(-1, 5)
    places = docs.sparkSession.sparkContext.broadcast((runs[:, 0] << 48 | runs[:, 1], runs[:, 1], runs[:, 3], runs[:, 4]))
    ranked = numbered(rows, ["length"], ["doc_id", "piece", "start", "ids_crc32"])
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank").mapInArrow(
        _placed(places), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
