"""Near-duplicates by a chosen-path set similarity join over word shingles, with exact confirmation.

Equal shingle sets are one set from the start. Each of several independent trees puts a set in a node by one minwise
token. Rows stream by, sorted by node: a node of few sets is compared exhaustively by size and sketch, a larger one is
branched by further minwise tokens that the node's path chooses, more of them at each level. A row has as many children
as keep 1.6 nodes per level common to a pair at the threshold, but one only where it is clearly like its node's centre,
so that rows of copies never multiply. There are as many trees as lose at most a thousandth of the pairs at the threshold
whose nodes stay large to the last level (`loss` computes it for ideal min-hashes and rows with all their children).

The sketch holds two bits of each of 128 min-hashes; how many may differ follows from the threshold: a pair at it
differs in more with a chance of at most 1e-7 (`apart`). A node of few sets gives one row for each set that is like
another one in it, never its pairs (of up to eight sets each pair); a larger one a row for each set that is like one of
its four first ones. The groups so connected then get their full sets, each set once, and are compared exactly in their
task: a set with all its candidates at once, likest ones first, pairs that are connected already not at all. A group too
large for a task is compared node by node, and around each centre in parts, and what is linked there is joined by components.

Branching gives a row that is like its centre one child a level and leaves large nodes at the last level, so it may part
two sets for good. An exact check follows for those: in the large first nodes of all trees, each set is compared with all
sets that are not in its component yet, block by block, a pair in the first of the nodes it shares, and what the sketch
leaves is confirmed on full sets. So two sets that share a first node of any tree are always compared. Sets of the largest
component of a node are not compared with each other, so a node of copies costs its size; one of unlike sets is quadratic.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marklake.llm.common import SMALLEST, as_long, begin_task, forget, id_key, mix, pieces, shingle_hashes, stored, text_buffer, word_hashes
from marklake.llm.components import components

TOKENS, SMALL, MINS = 64, 4096, 128
LEVELS = (1, 1, 2, 2, 4, 4, 8)  # tokens by which each level branches
KEPT, LOSS, MISS, MOST_TREES = 1.6, 0.001, 1e-7, 256
CENTRES = 4
BLOCK = 16  # parts of a group's size that meet in a task as sketches
GROUP_SETS, GROUP_SHINGLES = 4096, 1 << 22
SPLIT = 50_000
BROADCAST_ROWS = 1_000_000  # rows of about 64 bytes that may go to every executor
_RNG = np.random.default_rng(20240917)
_FLIP = _RNG.integers(0, 2**64, MINS, dtype=np.uint64)
_TIMES = _RNG.integers(0, 2**64, MINS, dtype=np.uint64) | np.uint64(1)
_EVEN = np.uint64(0x5555555555555555)
_SKETCH = ["q0", "q1", "q2", "q3"]


def rate(percent: int, tokens: int) -> float:
    """Children of a row that is branched by so many tokens: KEPT of them are common to a pair at the threshold."""
    return KEPT / (percent / 100) ** tokens


def loss(percent: int, trees: int) -> float:
    """Chance that a pair at the threshold shares no node of the last level if all its nodes are branched.

    Given how many of the 64 tokens agree, common nodes are a branching process that dies out on its own in each tree.
    """
    p, total = percent / 100, 0.0
    for m in range(TOKENS + 1):
        agree, out = m / TOKENS, 0.0
        for k in reversed(LEVELS[1:]):
            many = rate(percent, k)
            child = 1 - agree**k + agree**k * out
            out = child ** int(many) * (1 + (many - int(many)) * (child - 1))
        total += comb(TOKENS, m) * p**m * (1 - p) ** (TOKENS - m) * (1 - agree + agree * out) ** trees
    return total


def trees_for(percent: int) -> int:
    """The fewest trees, eight at least, with a loss of at most LOSS; at most MOST_TREES, which at low thresholds lose more."""
    return next((t for t in range(8, MOST_TREES) if loss(percent, t) <= LOSS), MOST_TREES)


def apart(percent: int) -> int:
    """How many min-hashes may differ in their two bits: a pair at the threshold differs in more with a chance of at most MISS.

    The bits differ where the min-hashes do, in three of four cases, independently of each other.
    """
    q = (1 - percent / 100) * 3 / 4
    more, k = 0.0, MINS
    while k and (more := more + comb(MINS, k) * q**k * (1 - q) ** (MINS - k)) <= MISS:
        k -= 1
    return k


def _sets(data: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and how many."""
    h, counts = shingle_hashes(*word_hashes(data, starts), width)
    doc, ends = np.repeat(np.arange(len(counts)), counts), np.cumsum(counts)
    for i, j in zip(ends - counts, ends):
        h[i:j].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=len(counts)).astype(np.int64)


def _set_ids(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 128-bit hash of each set, as 16 bytes."""
    out = np.empty((len(at), 2), np.uint64)
    for k in range(2):
        out[:, k] = np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D * (k + 1) % 2**64)), at)
    return mix(out).view(np.uint8).reshape(-1, 16)


def _signed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        for batch in batches:
            data, starts = text_buffer(batch.column("text"))
            for i, j in pieces(starts):
                h, counts = _sets(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i], width)
                full = np.flatnonzero(counts)
                ids, tokens = np.zeros((j - i, 16), np.uint8), np.zeros((j - i, TOKENS), np.uint32)
                bits = np.zeros((j - i, MINS, 2), bool)
                if len(full):
                    at = (np.cumsum(counts) - counts)[full]
                    ids[full] = _set_ids(h, at)
                    values = np.empty_like(h)
                    for k in range(MINS):
                        np.multiply(np.bitwise_xor(h, _FLIP[k], out=values), _TIMES[k], out=values)
                        least = np.minimum.reduceat(values, at) >> np.uint64(32)
                        bits[full, k, 0], bits[full, k, 1] = least & np.uint64(1), least & np.uint64(2)
                        if k < TOKENS:
                            tokens[full, k] = least
                sketch = np.packbits(bits.reshape(j - i, 2 * MINS), axis=1).view(np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[i:j],
                        batch.column("text_hash")[i:j],
                        pa.array(counts),
                        pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), j - i, [None, pa.py_buffer(ids.tobytes())]).cast(pa.binary()),
                        pa.FixedSizeListArray.from_arrays(pa.array(tokens.view(np.int32).ravel()), TOKENS).cast(pa.list_(pa.int32())),
                        *(pa.array(as_long(np.ascontiguousarray(sketch[:, k]))) for k in range(4)),
                    ],
                    names=["doc_id", "text_hash", "n", "s", "tokens", *_SKETCH],
                )

    return run


def _shingled(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        for batch in batches:
            data, starts = text_buffer(batch.column("text"))
            for i, j in pieces(starts):
                h, counts = _sets(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i], width)
                full = np.flatnonzero(counts)
                if not len(full):
                    continue
                at = (np.cumsum(counts) - counts)[full]
                ends = np.append(at, len(h)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(full), [None, pa.py_buffer(_set_ids(h, at).tobytes())]).cast(pa.binary()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(as_long(h))),
                    ],
                    names=["s", "shingles"],
                )

    return run


# ---- rows of nodes and groups ------------------------------------------------------------------------------------


class _Rows:
    """Sets as rows of a node or group: size, sketch and name."""

    def __init__(self, batch: pa.RecordBatch | pa.Table):
        column = lambda c: batch.column(c).to_numpy()
        self.n, self.sketch = column("n"), np.stack([column(q) for q in _SKETCH], 1).view(np.uint64)

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """In how many min-hashes the sketches differ; `a` and `b` are places that broadcast."""
        total = 0
        for k in range(4):
            x = self.sketch[a, k] ^ self.sketch[b, k]
            total = total + np.bitwise_count((x | x >> np.uint64(1)) & _EVEN).astype(np.int16)
        return total

    def sized(self, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        n, m = self.n[a], self.n[b]
        return np.minimum(n, m) * 100 >= np.maximum(n, m) * percent


def _linked(rows: _Rows, places: np.ndarray, percent: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Each of the places that is like another one, with the first of those it is connected with."""
    k = len(places)
    like = np.zeros((k, k), bool)
    for i in range(0, k, 256):
        a, b = places[i : i + 256, None], places[None, :]
        like[i : i + 256] = rows.sized(a, b, percent) & (rows.differ(a, b) <= most)
    label = np.arange(k, dtype=np.int32)
    while True:
        least = np.concatenate([np.where(like[i : i + 256], label[None, :], np.int32(k)).min(1) for i in range(0, k, 256)])
        least = least[least]
        if (least == label).all():
            break
        label = least
    other = np.flatnonzero(label != np.arange(k))
    return places[other], places[label[other]]


_OUT = pa.schema([("node", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("near", pa.bool_())])


def _compared(percent: int, most: int, small: int, last: bool):
    """Rows sorted by node to edges (a, b) of small nodes, and to rows without b that have to be branched."""

    likely = round((1 - percent / 100) / 4 * 3 / 4 * MINS)  # in what a pair three quarters of the way to equality differs

    def out(node: pa.Array, a: pa.Array, b: pa.Array | None, near: np.ndarray | None = None) -> pa.RecordBatch:
        near = pa.nulls(len(a), pa.bool_()) if near is None else pa.array(near)
        return pa.RecordBatch.from_arrays([node, a, pa.nulls(len(a), pa.binary()) if b is None else b, near], schema=_OUT)

    def edges(table: pa.Table, starts: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Edges within runs of at most `small` rows."""
        rows, size = _Rows(table), ends - starts
        run = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(run)) + np.repeat(starts - np.r_[0, np.cumsum(size)[:-1]], size)
        few = (size >= 2) & (size <= 8)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        left = place[few[run]]
        end = ends[run][few[run]]
        for step in range(1, 8):
            a = left[left + step < end]
            keep = rows.sized(a, a + step, percent)
            a = a[keep]
            a = a[rows.differ(a, a + step) <= most]
            found.append((a + step, a))
        for i in np.flatnonzero(size > 8):
            found.append(_linked(rows, np.arange(starts[i], ends[i]), percent, most))
        a, b = (np.concatenate(c) for c in zip(*found))
        if len(a):
            names = table.column("s").combine_chunks()
            yield out(table.column("node").combine_chunks().take(pa.array(a)), names.take(pa.array(a)), names.take(pa.array(b)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        held: list[pa.RecordBatch] = []  # rows of the node that may go on in the next batch
        large: int | None = None  # a node that has turned out large, and its centres
        centres: pa.Table | None = None

        def finished(table: pa.Table, closed: bool) -> Iterator[pa.RecordBatch]:
            """What the table's nodes give; the last one is kept unless `closed`."""
            nonlocal held, large, centres
            node = table.column("node").to_numpy()
            starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            ends = np.r_[starts[1:], len(node)]
            held = []
            if not closed:
                tail = table.slice(starts[-1])
                starts, ends = starts[:-1], ends[:-1]
                if tail.num_rows > small:
                    large, centres = int(node[-1]), tail.slice(0, CENTRES)
                    yield from opened(tail, centres)
                else:
                    held = tail.to_batches()
            fits = ends - starts <= small
            for i in np.flatnonzero(~fits):
                part = table.slice(starts[i], ends[i] - starts[i])
                yield from opened(part, part.slice(0, CENTRES))
            if fits.any():
                yield from edges(table, starts[fits], ends[fits])

        def opened(part: pa.Table, stars: pa.Table) -> Iterator[pa.RecordBatch]:
            """Rows of a large node: each that is like one of the centres is connected with it, and all are branched; what
            no token has parted by the last level is compared in blocks."""
            both = pa.concat_tables([stars, part])
            rows, k = _Rows(both), stars.num_rows
            x, c = np.arange(k, both.num_rows)[:, None], np.arange(k)[None, :]
            gap = np.where(rows.sized(x, c, percent), rows.differ(x, c), MINS)
            like, near = gap <= most, (gap <= likely).any(1)
            names = both.column("s").combine_chunks()
            a = np.flatnonzero(like.any(1))
            if len(a):
                yield out(pa.nulls(len(a), pa.int64()), names.take(pa.array(a + k)), names.take(pa.array(like.argmax(1)[a])))
            for i in range(0, part.num_rows, small):
                block = part.slice(i, small)
                if last:
                    yield from edges(block, np.array([0]), np.array([block.num_rows]))
                else:
                    yield out(block.column("node").combine_chunks(), block.column("s").combine_chunks(), None, near[i : i + small])

        for batch in batches:
            if batch.num_rows and large is not None:
                same = int(np.searchsorted(batch.column("node").to_numpy(), large, "right"))
                if same:
                    yield from opened(pa.Table.from_batches([batch.slice(0, same)]), centres)
                batch = batch.slice(same)
                if batch.num_rows:
                    large = centres = None
            if batch.num_rows:
                yield from finished(pa.Table.from_batches([*held, batch]), False)
        if held:
            yield from finished(pa.Table.from_batches(held), True)

    return run


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """Equal values as equal small numbers."""
    return column.combine_chunks().dictionary_encode().indices.to_numpy()


def _joined(table: pa.Table, percent: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sets of one group that are linked, each with the first of its component: confirmed on full sets. Sets of one label
    are connected from the start; a group of two sides is compared across them."""
    rows, k = _Rows(table), table.num_rows
    shingles = table.column("shingles").combine_chunks()
    flat = shingles.flatten().dictionary_encode().indices.to_numpy()
    starts = np.cumsum(rows.n) - rows.n
    label, side = _numbers(table.column("label")), table.column("side").to_numpy()
    root = np.unique(label, return_index=True)[1][np.unique(label, return_inverse=True)[1]]
    held = np.zeros(flat.max() + 1, bool)  # which shingles the set has that others are compared with

    def linked(x: int, y: np.ndarray) -> np.ndarray:
        """Those of the sets y that are linked with the set x."""
        own = flat[starts[x] : starts[x] + rows.n[x]]
        held[own] = True
        cuts, both = np.append(0, np.cumsum(rows.n[y])), np.empty(len(y), np.int64)
        for i, j in pieces(cuts):
            at = np.arange(cuts[j] - cuts[i]) + np.repeat(starts[y[i:j]] - cuts[i:j] + cuts[i], rows.n[y[i:j]])
            both[i:j] = np.add.reduceat(held[flat[at]], cuts[i:j] - cuts[i], dtype=np.int64)
        held[own] = False
        return y[100 * both >= percent * (rows.n[x] + rows.n[y] - both)]

    likely = round((1 - percent / 100) * 3 / 4 * MINS)  # in what a pair at the threshold differs
    for known, upto in ((-1, likely), (likely, most)):  # likest pairs first: what they connect is not compared any more
        for i in range(0, k, 256):
            a, b = np.arange(i, min(i + 256, k))[:, None], np.arange(i, k)[None, :]
            gap = rows.differ(a, b)
            like = (gap > known) & (gap <= upto) & rows.sized(a, b, percent) & (a < b) & (root[a] != root[b]) & ((side[a] == 0) | (side[a] != side[b]))
            for x in i + np.flatnonzero(like.any(1)):
                y = i + np.flatnonzero(like[x - i])
                y = y[root[y] != root[x]]
                if len(y) and len(y := linked(x, y)):
                    of = np.arange(k)
                    of[root[y]] = of[root[x]] = min(root[x], root[y].min())
                    root = of[root]
    other = np.flatnonzero(root != np.arange(k))
    return other, root[other]


def _confirmed(percent: int, most: int):
    """Full sets sorted by group to links (a, b)."""

    def links(table: pa.Table) -> pa.RecordBatch:
        a, b = _joined(table, percent, most)
        names = table.column("s").combine_chunks()
        return pa.RecordBatch.from_arrays([names.take(pa.array(a)), names.take(pa.array(b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch])
            group = table.column("g").to_numpy()
            cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)]
            for i, j in zip(cuts[:-2], cuts[1:-1]):
                yield links(table.slice(i, j - i))
            held = table.slice(cuts[-2]).to_batches()
        if held:
            yield links(pa.Table.from_batches(held))

    return run


_MET = pa.schema([("node", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("side", pa.int32()), ("s", pa.binary()), ("label", pa.binary())])


def _met(percent: int, most: int):
    """Rows sorted by pair of blocks to those that are like a row of another label, once for each pair of parts where one is.
    A pair that shares the node of an earlier tree is left to that one."""

    def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.sort_by("n")
        rows, label = _Rows(table), _numbers(table.column("label"))
        part, side = table.column("part").to_numpy(), table.column("side").to_numpy()
        tree = int(table.column("tree")[0].as_py())
        firsts = table.column("firsts").combine_chunks().flatten().to_numpy().reshape(len(side), tree)
        one = side[0] == 0  # a block with itself
        left = np.arange(len(side)) if one else np.flatnonzero(side == 1)
        right = left if one else np.flatnonzero(side == 2)
        n, wide = rows.n[right], int(part.max()) + 1
        seen: list[np.ndarray] = []
        for i in range(0, len(left), 256):
            a = left[i : i + 256]
            low = np.searchsorted(n * 100, rows.n[a[0]] * percent)
            high = np.searchsorted(n * percent, rows.n[a[-1]] * 100, "right")
            for j in range(low, high, 8192):
                b = right[j : min(j + 8192, high)]
                like = (label[a][:, None] != label[b][None, :]) & rows.sized(a[:, None], b[None, :], percent)
                like &= rows.differ(a[:, None], b[None, :]) <= most
                x, y = np.nonzero(like)
                x, y = a[x], b[y]
                keep = x < y if one else slice(None)
                x, y = x[keep], y[keep]
                for t in range(tree):
                    keep = firsts[x, t] != firsts[y, t]
                    x, y = x[keep], y[keep]
                if len(x):
                    pair = np.minimum(part[x], part[y]) * wide + np.maximum(part[x], part[y])
                    seen.append(np.unique(np.stack([np.r_[pair, pair], np.r_[x, y]]), axis=1))
        if not seen:
            return
        pair, row = np.unique(np.concatenate(seen, 1), axis=1)
        low, high = pair // wide, pair % wide
        each = table.select(["node", "s", "label"]).take(pa.array(row))
        at = np.where(low == high, 0, np.where(part[row] == low, 1, 2)).astype(np.int32)
        columns = [each.column("node"), pa.array(low), pa.array(high), pa.array(at), each.column("s"), each.column("label")]
        yield from pa.Table.from_arrays(columns, schema=_MET).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch])
            pair = table.column("pair").to_numpy()
            cuts = [0, *(np.flatnonzero(pair[1:] != pair[:-1]) + 1).tolist(), len(pair)]
            for i, j in zip(cuts[:-2], cuts[1:-1]):
                yield from found(table.slice(i, j - i))
            held = table.slice(cuts[-2]).to_batches()
        if held:
            yield from found(pa.Table.from_batches(held))

    return run


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _hinted(keys: DataFrame) -> DataFrame:
    """A stored table of keys, to be broadcast where it has few rows: what it is joined with stays where it is."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


class _Join:
    """One run of the join: the documents, their sets, and which sets are connected."""

    def __init__(self, docs: DataFrame, width: int, percent: int, small: int, group_sets: int, group_shingles: int):
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        hashed = self.docs.select("doc_id", _text_hash().alias("text_hash"), "text")
        self.width, self.percent, self.small = width, percent, small
        self.group_sets, self.group_shingles = group_sets, group_shingles
        self.trees, self.apart = trees_for(percent), apart(percent)
        kinds = "doc_id long, text_hash long, n long, s binary, tokens array<int>, " + ", ".join(f"{q} long" for q in _SKETCH)
        self.signed = stored(hashed.mapInArrow(_signed(width), kinds), "near-signed")
        self.rows = self.signed.select("doc_id", "text_hash", "n", "s")
        first_level = F.slice("tokens", 1, min(self.trees, TOKENS)).alias("tokens")
        self.sets = stored(self.distinct(self.signed.where("n > 0").select("doc_id", "s", "n", first_level, *_SKETCH)), "near-sets")
        self.labels: DataFrame | None = None
        self.crowds: DataFrame | None = None
        self.crowded: DataFrame | None = None
        self.tables = [self.signed, self.sets]

    @staticmethod
    def distinct(signed: DataFrame) -> DataFrame:
        """Each set once, with the least id (k) of its documents."""
        return signed.groupBy("s").agg(*(F.first(c).alias(c) for c in ("n", "tokens", *_SKETCH)), F.min(id_key()).alias("k"))

    def compared(self, rows: DataFrame, most: int, last: bool) -> DataFrame:
        """Edges and rest of one level's rows (node, s, n, sketch), of which a node has at most `most`. Of a node of very
        many rows several tasks take a part each: it is branched anyhow."""
        rows, crowds = rows.select("node", "s", "n", *_SKETCH).withColumn("part", F.lit(0).cast("long")), None
        if most > SPLIT:
            crowds = rows.groupBy("node").agg(F.count("*").alias("rows")).where(F.col("rows") > SPLIT)
            crowds = stored(crowds, "near-crowds")
            if not crowds.isEmpty():
                share = F.ceil(F.col("rows") / SPLIT)
                part = F.when(F.col("rows").isNotNull(), F.pmod(F.xxhash64("s"), share)).otherwise(F.col("part"))
                rows = rows.join(_hinted(crowds), "node", "left").withColumn("part", part).drop("rows")
        placed = rows.repartition("node", "part").sortWithinPartitions("node", "s").select("node", "s", "n", *_SKETCH)
        out = stored(placed.mapInArrow(_compared(self.percent, self.apart, self.small, last), "node long, a binary, b binary, near boolean"), "near-edges")
        if crowds is not None:
            forget(crowds)
        return out

    def branched(self, rest: DataFrame, tokens: int) -> DataFrame:
        """The children of each row, each by as many distinct tokens, which the path chooses."""

        def child(i: Column) -> Column:
            start = F.pmod(F.xxhash64("node", i, F.lit(1)), F.lit(TOKENS))
            step = F.pmod(F.xxhash64("node", i, F.lit(2)), F.lit(TOKENS // 2)) * 2 + 1
            at = lambda j: F.pmod(start + j * step, F.lit(TOKENS)).cast("int")
            return F.xxhash64("node", i, F.transform(F.sequence(F.lit(0), F.lit(tokens - 1)), lambda j: F.struct(at(j), F.get("tokens", at(j)))))

        many = rate(self.percent, tokens)
        more = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(10_000)) < round((many - int(many)) * 10_000)
        last = F.when(F.col("near"), 0).otherwise(F.lit(int(many)) - 1 + more.cast("int"))
        rows = rest.select("node", F.col("a").alias("s"), "near").join(self.crowded, "s")
        return rows.select(F.explode(F.transform(F.sequence(F.lit(0), last), child)).alias("node"), "s", "n", *_SKETCH)

    def of_names(self, names: DataFrame) -> DataFrame:
        """The sets of these names (s), with all their tokens."""
        names = stored(names.distinct(), "near-names")
        out = stored(self.distinct(self.signed.where("n > 0").join(_hinted(names), "s", "left_semi")), "near-crowded")
        forget(names)
        return out

    def firsts(self) -> Column:
        """The nodes of the first level, one of each of the trees."""
        return F.transform(F.sequence(F.lit(0), F.lit(self.trees - 1)), lambda t: F.xxhash64(t, F.get("tokens", F.pmod(t, F.lit(TOKENS)))))

    def edges(self) -> list[DataFrame]:
        """(node, a, b) of all levels: the sets that likeness connects in each small node, and, without node, with a large one's centre."""
        rows, found = self.sets.select(F.explode(self.firsts()).alias("node"), "s", "n", *_SKETCH), []
        for level, _ in enumerate(LEVELS):
            most = rows.count() if level else self.sets.count()
            out = self.compared(rows, most, level == len(LEVELS) - 1)
            if level:
                forget(rows)
            found.append(out.where("b IS NOT NULL"))
            rest = out.where("b IS NULL")
            if level == len(LEVELS) - 1 or rest.isEmpty():
                break
            if level == 0:  # all levels below, and the exact check, read the sets of the large nodes alone
                self.crowds = rest.select("node", F.col("a").alias("s"))
                self.crowded = self.of_names(self.crowds.select("s"))
                self.tables.append(self.crowded)
            rows = stored(self.branched(rest, LEVELS[level + 1]), "near-branched")
        self.tables += found
        return found

    def confirmed(self, groups: DataFrame, members: DataFrame) -> DataFrame:
        """(a, b): what is linked in groups (g, side, s, label), by full sets. `members` (k) are documents that hold all their sets."""
        keys = stored(members.select("k").distinct(), "near-keys")
        texts = self.docs.withColumn("k", id_key()).join(_hinted(keys), "k", "left_semi").select("text")
        full = texts.mapInArrow(_shingled(self.width), "s binary, shingles array<long>").groupBy("s").agg(F.first("shingles").alias("shingles"))
        whole = groups.join(self.sets.select("s", "n", *_SKETCH), "s").join(full, "s")
        sorted_groups = whole.repartition("g").sortWithinPartitions("g", "s").select("g", "side", "s", "label", "n", *_SKETCH, "shingles")
        links = stored(sorted_groups.mapInArrow(_confirmed(self.percent, self.apart), "a binary, b binary"), "near-links")
        forget(keys)
        return links

    def linked(self, found: list[DataFrame]) -> None:
        """Labels of the sets that the edges connect, as far as full sets confirm it."""
        edges = found[0]
        for more in found[1:]:
            edges = edges.unionByName(more)
        if edges.isEmpty():
            return
        of = components(edges.select("a", "b")).select(F.col("a").alias("s"), F.col("b").alias("root"))
        members = of.unionByName(of.select(F.col("root").alias("s"), "root").distinct())
        members = stored(members.join(self.sets.select("s", "n", "k"), "s"), "near-members")
        weight = members.groupBy("root").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
        small = (F.col("sets") <= self.group_sets) & (F.col("shingles") <= self.group_shingles)
        weight = stored(weight.select("root", small.alias("fits")), "near-weights")
        groups = members.join(weight.where("fits"), "root").select(F.xxhash64("root").alias("g"), "s")
        if not weight.where("NOT fits").isEmpty():  # what a node has connected, and the sets near one centre in parts that all hold it
            wide = members.join(weight.where("NOT fits"), "root", "left_semi").select(F.col("s").alias("a"))
            own = stored(edges.join(wide, "a", "left_semi").distinct(), "near-own")
            stars = own.where("node IS NULL")
            parts = stars.groupBy("b").agg(F.ceil(F.count("*") / self.group_sets).alias("parts"))
            stars = stars.join(parts, "b").select(F.xxhash64("b", F.pmod(F.xxhash64("a"), F.col("parts"))).alias("g"), "a", "b")
            within = own.where("node IS NOT NULL").select(F.xxhash64("node", "b").alias("g"), "a", "b")
            groups = groups.unionByName(stars.unionByName(within).select("g", F.explode(F.array("a", "b")).alias("s")).distinct())
        groups = stored(groups.select("g", F.lit(0).alias("side"), "s", F.col("s").alias("label")), "near-groups")
        links = self.confirmed(groups, members)
        if not links.isEmpty():
            self.labels = components(links)
        forget(members, weight, groups, links)

    def parted(self) -> None:
        """The exact check of what branching may have parted: in large nodes of the first level, sets of different components."""
        sets = self.crowded.select("s", "n", *_SKETCH, self.firsts().alias("firsts"))
        rows = self.crowds.join(sets, "s").withColumn("tree", F.array_position("firsts", F.col("node")).cast("int") - 1)
        rows = rows.withColumn("firsts", F.slice("firsts", F.lit(1), F.col("tree")))  # the nodes of the trees before
        if self.labels is not None:
            rows = rows.join(self.labels.select(F.col("a").alias("s"), F.col("b").alias("label")), "s", "left")
        else:
            rows = rows.withColumn("label", F.lit(None).cast("binary"))
        rows = stored(rows.withColumn("label", F.coalesce("label", "s")), "near-crowds")
        kinds = rows.groupBy("node", "label").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
        most = F.max_by(F.struct("label", "sets", "shingles"), F.struct("sets", "label")).alias("most")
        nodes = kinds.groupBy("node").agg(F.sum("sets").alias("sets"), F.sum("shingles").alias("shingles"), most).where("sets > most.sets")
        half = lambda sets, shingles: F.ceil(F.greatest(sets * 2 / self.group_sets, shingles * 2 / self.group_shingles))
        other = half(F.col("sets") - F.col("most.sets"), F.col("shingles") - F.col("most.shingles"))
        nodes = nodes.select("node", F.col("most.label").alias("first"), other.alias("others"), half(F.col("most.sets"), F.col("most.shingles")).alias("own"))
        nodes = stored(nodes, "near-crowded")
        if not nodes.isEmpty():
            # Parts and blocks of the largest component come after those of the others, and meet none of their own.
            blocks, is_first = F.ceil(F.col("others") / BLOCK), F.col("label") == F.col("first")
            inner = F.pmod(F.xxhash64("s"), F.when(is_first, F.col("own")).otherwise(F.col("others")))
            rest = rows.join(nodes, "node").withColumn("part", inner + F.when(is_first, blocks * BLOCK).otherwise(0))
            rest = rest.withColumn("block", F.floor(F.col("part") / BLOCK)).withColumn("blocks", blocks)
            last = blocks + F.ceil(F.col("own") / BLOCK) - 1
            before = F.transform(F.sequence(F.lit(0).cast("long"), F.least(F.col("block"), F.col("blocks") - 1)), lambda i: F.struct(i.alias("i"), F.col("block").alias("j")))
            after = F.transform(F.sequence(F.col("block"), last), lambda j: F.struct(F.col("block").alias("i"), j.alias("j")))
            of = F.when(is_first, before).otherwise(F.array_union(before, after))
            pairs = rest.select("node", F.explode(of).alias("of"), "block", "part", "s", "label", "n", *_SKETCH, "tree", "firsts")
            pairs = pairs.withColumn("pair", F.xxhash64("node", "of.i", "of.j"))
            pairs = pairs.withColumn("side", F.when(F.col("of.i") == F.col("of.j"), 0).when(F.col("block") == F.col("of.i"), 1).otherwise(2))
            placed = pairs.repartition("pair").sortWithinPartitions("pair", "s").select("pair", "node", "side", "part", "s", "label", "n", *_SKETCH, "tree", "firsts")
            met = placed.mapInArrow(_met(self.percent, self.apart), "node long, low long, high long, side int, s binary, label binary")
            met = stored(met, "near-met")
            if not met.isEmpty():
                groups = met.select(F.xxhash64("node", "low", "high").alias("g"), "side", "s", "label")
                links = self.confirmed(groups, met.select("s").distinct().join(self.crowded.select("s", "k"), "s"))
                if not links.isEmpty():
                    self.labels = components(links if self.labels is None else self.labels.unionByName(links))
                forget(links)
            forget(met)
        forget(rows, nodes)

    def run(self) -> None:
        found = self.edges()
        self.linked(found)
        if self.crowds is not None:
            self.parted()
        forget(*self.tables[2:])


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, small: int = SMALL, group_sets: int = GROUP_SETS, group_shingles: int = GROUP_SHINGLES
) -> DataFrame:
    """One row per document: (doc_id, n_shingles, component_id, kept).

    A-Z is lowered and words are runs of other characters than ASCII white space. A document's set is its distinct
    runs of `width` words, or its whole sequence where it has fewer. Documents are linked where
    100 * intersection >= percent * union; component_id is the smallest doc_id reachable and `kept` marks it.
    Texts that are null or hold no word have an empty set, are linked with nothing and kept. Rows that repeat an id
    are documents of their own. A null id is never a component's smallest unless all its ids are null. An empty table
    gives no rows. Other columns are not read. A very long text is hashed in its task, at about 60 bytes a byte. Nodes of
    up to `small` sets are compared exhaustively; groups of up to `group_sets` sets with `group_shingles` shingles get
    their full sets at once, larger ones in parts.
    """
    out = _grouped(docs, width, percent, small, group_sets, group_shingles).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _grouped(docs: DataFrame, width: int, percent: int, small: int = SMALL, group_sets: int = GROUP_SETS, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, root): `root` names the component also where ids are null or repeat."""
    join = _Join(docs, width, percent, small, group_sets, group_shingles)
    join.run()
    rows = join.rows.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "s")
    filled = rows.where("n_shingles > 0")
    by_set = filled.groupBy("s").agg(F.min("doc_id").alias("least"))
    if join.labels is None:
        rooted = by_set.withColumn("root", F.col("s"))
    else:
        labels = join.labels.select(F.col("a").alias("s"), F.col("b").alias("root"))
        rooted = by_set.join(labels, "s", "left").withColumn("root", F.coalesce("root", "s"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_set = rooted.join(least, "root").select("s", "component_id", "root")
    single = rows.where("n_shingles = 0").withColumn("component_id", F.col("doc_id")).withColumn("root", F.lit(None).cast("binary"))
    return filled.join(of_set, "s").drop("s").unionByName(single.drop("s"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs`, with their own columns, of one document of each group: the one of the smallest id.

    Documents without words are groups of their own. Of rows that repeat the id and the text one stays, whatever
    their other columns hold; of repeated ids with other texts of one group, one stays too.
    """
    grouped = stored(_grouped(docs, width, percent).select("doc_id", "text_hash", "root", "component_id"), "near-groups")
    kept = grouped.where(F.col("root").isNotNull() & F.col("doc_id").eqNullSafe(F.col("component_id")))
    # Rarely more than one row of a group has the smallest id: the text of the least hash stands for it.
    chosen = kept.groupBy("root").agg(F.min("text_hash").alias("text_hash"), F.first("doc_id").alias("doc_id"), F.count("*").alias("rows"))
    chosen = stored(chosen.withColumn("k", id_key()).select("k", "text_hash", "rows"), "near-chosen")
    tag = "_".join(["", *docs.columns])
    k, h = f"k{tag}", f"h{tag}"  # longer than, so unlike, any column
    keyed = docs.withColumn(k, F.coalesce(F.col("doc_id").cast("long"), F.lit(SMALLEST))).withColumn(h, _text_hash())
    dropped = grouped.where("root IS NOT NULL").withColumn("k", id_key()).join(chosen, ["k", "text_hash"], "left_anti").select(F.col("k").alias(k), F.col("text_hash").alias(h)).distinct()
    left = keyed.join(_hinted(stored(dropped, "near-dropped")), [k, h], "left_anti")
    if chosen.where("rows > 1").isEmpty():
        return left.select(docs.columns)
    again = chosen.where("rows > 1").select(F.col("k").alias(k), F.col("text_hash").alias(h)).distinct()
    once = left.join(again, [k, h], "left_anti")
    return once.unionByName(left.join(again, [k, h], "left_semi").dropDuplicates([k, h])).select(docs.columns)
