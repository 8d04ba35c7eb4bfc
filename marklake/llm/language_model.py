"""An interpolated modified Kneser-Ney bigram model, counted in Spark, held in memory-mapped sorted arrays.

Training words are hashed to 64 bits. The vocabulary is cut into shards by hash; a shard is a sorted array of hashes, a
word's id its place in all shards laid end to end. A second pass counts bigrams as (id, id) keys: workers count what
they read, the counts of a key meet in its shard by its hash, so that neither a frequent word nor a frequent context is
one task's, and each shard becomes a sorted array of keys with counts. The tasks that write shards also sum, per word,
the followers with one, two or more occurrences (for its weight as a context) and the words that it follows (for the
lower order), which Spark adds up by id. Scoring maps these arrays and looks up each text's tokens by binary search.
The files lie in the shared checkpoint folder, under names that a repeated task replaces with the same content.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marklake.llm.common import as_long, begin_task, kept_by, mix, pieces, posix_folder, stored, text_buffer, word_hashes

END = np.uint64(0xE27D1B5C0F3A9647)
_MB = 1 << 20
_OPEN: dict[str, np.ndarray] = kept_by("language model")


def _save(path: str, array: np.ndarray) -> None:
    """Write under another name, then rename: readers see whole files, repeated tasks agree."""
    mine = f"{path}.{uuid.uuid4().hex}"
    with open(mine, "wb") as out:
        np.save(out, array)
    os.replace(mine, path)


def _mapped(folder: str, name: str) -> np.ndarray:
    path = f"{folder}/{name}.npy"
    if path not in _OPEN:
        for other in [p for p in _OPEN if not p.startswith(folder)]:
            del _OPEN[other]
        _OPEN[path] = np.load(path, mmap_mode="r") if os.path.exists(path) else np.zeros((0, 4) if name.startswith("weights") else 0)
    return _OPEN[path]


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def tokens_of(texts: pa.Array, size: int = _MB) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, last, token hashes with an end after each text, tokens per text) for runs of texts."""
    begin_task("language model")
    data, starts = text_buffer(texts)
    for i, j in pieces(starts, size):
        words, counts = word_hashes(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i])
        yield i, j, np.insert(words, np.cumsum(counts), END), counts + 1


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, tokens, _ in tokens_of(batch.column("text")):
            h, n = np.unique(tokens, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(as_long(h)), pa.array(n)], names=["h", "c"])


def _columns(batches: Iterator[pa.RecordBatch], names: list[str]) -> list[np.ndarray]:
    parts = [[b.column(n).to_numpy(zero_copy_only=False) for n in names] for b in batches]
    return [np.concatenate(c) if parts else np.zeros(0, np.int64) for c in (zip(*parts) if parts else [[]] * len(names))]


def _write_words(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, h, c = _columns(batches, ["shard", "h", "c"])
        h = h.astype(np.int64).view(np.uint64)
        for s in np.unique(shard):
            mine = shard == s
            order = np.argsort(h[mine])
            _save(f"{folder}/words-{s}.npy", h[mine][order])
            _save(f"{folder}/counts-{s}.npy", c[mine][order])
            yield pa.RecordBatch.from_arrays([pa.array([int(s)]), pa.array([int(mine.sum())])], names=["shard", "n"])

    return run


class _Words:
    """The vocabulary's shards as a worker sees them."""

    def __init__(self, folder: str, starts: np.ndarray):
        self.folder, self.starts, self.shards = folder, starts, len(starts) - 1

    def ids(self, tokens: np.ndarray) -> np.ndarray:
        """Ids of distinct token hashes; -1 where training never saw them."""
        out = np.full(len(tokens), -1, np.int64)
        shard = _shard(tokens, self.shards)
        for s in np.unique(shard):
            known = _mapped(self.folder, f"words-{s}")
            if len(known):
                mine = np.flatnonzero(shard == s)
                at = np.minimum(np.searchsorted(known, tokens[mine]), len(known) - 1)
                hit = known[at] == tokens[mine]
                out[mine[hit]] = self.starts[s] + at[hit]
        return out

    def values(self, name: str, ids: np.ndarray, width: int) -> np.ndarray:
        """Rows of the arrays that lie beside the words, for ascending known ids."""
        out = np.zeros((len(ids), width))
        bounds = np.searchsorted(ids, self.starts)
        for s in np.flatnonzero(np.diff(bounds)):
            part = _mapped(self.folder, f"{name}-{s}")
            rows = part[ids[bounds[s] : bounds[s + 1]] - self.starts[s]]
            out[bounds[s] : bounds[s + 1]] = rows.reshape(-1, width)
        return out


def _contexts(ids: np.ndarray, counts: np.ndarray, begin: int) -> np.ndarray:
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[np.cumsum(counts) - counts] = begin
    return before


def _count_pairs(folder: str, starts: np.ndarray, shards: int, hold: int):
    words, begin = _Words(folder, starts), int(starts[-1])

    def out(keys: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        k, c = _summed(np.concatenate(keys), np.concatenate(counts))
        shard = _shard(mix(k), shards)
        order = np.argsort(shard, kind="stable")
        k, c = k[order], c[order].astype(np.uint32)
        found, at = np.unique(shard[order], return_index=True)
        ends = np.append(at[1:], len(k))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(found),
                pa.array([k[a:b].tobytes() for a, b in zip(at, ends)], pa.binary()),
                pa.array([c[a:b].tobytes() for a, b in zip(at, ends)], pa.binary()),
            ],
            names=["shard", "keys", "counts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for batch in batches:
            for _, _, tokens, n in tokens_of(batch.column("text")):
                distinct, back = np.unique(tokens, return_inverse=True)
                ids = words.ids(distinct)[back]
                k, c = np.unique(_contexts(ids, n, begin).astype(np.uint64) << np.uint64(32) | ids.astype(np.uint64), return_counts=True)
                keys.append(k)
                counts.append(c)
                held += len(k)
                if held >= hold:
                    yield out(keys, counts)
                    keys, counts, held = [], [], 0
        if held:
            yield out(keys, counts)

    return run


def _write_pairs(folder: str):
    def stats(kind: int, ids, a, b, c, d) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(ids), kind, np.int32)), *(pa.array(np.asarray(x, np.int64)) for x in (ids, a, b, c, d))],
            names=["kind", "id", "a", "b", "c", "d"],
        )

    def one(shard: int, keys: list[bytes], counts: list[bytes]) -> Iterator[pa.RecordBatch]:
        k, c = _summed(np.frombuffer(b"".join(keys), np.uint64), np.frombuffer(b"".join(counts), np.uint32).astype(np.int64))
        _save(f"{folder}/pairs-{shard}.npy", k)
        _save(f"{folder}/times-{shard}.npy", c.astype(np.uint32))
        left = (k >> np.uint64(32)).astype(np.int64)
        at = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1]]))
        ones, twos = (np.add.reduceat((c == x).astype(np.int64), at) for x in (1, 2))
        more = np.diff(np.append(at, len(k))) - ones - twos
        yield stats(0, left[at], np.add.reduceat(c, at), ones, twos, more)
        right, n = np.unique(k & np.uint64(2**32 - 1), return_counts=True)
        zero = np.zeros(len(n), np.int64)
        yield stats(1, right.astype(np.int64), n, zero, zero, zero)
        yield stats(2, [0], *([(c == x).sum()] for x in (1, 2, 3, 4)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: dict[int, list[bytes]] = {}
        counts: dict[int, list[bytes]] = {}
        for batch in batches:
            for s, k, c in zip(*(batch.column(x).to_pylist() for x in ("shard", "keys", "counts"))):
                keys.setdefault(s, []).append(k)
                counts.setdefault(s, []).append(c)
        for s in sorted(keys):
            yield from one(s, keys.pop(s), counts.pop(s))

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """What is taken from counts of one, two, three and more; halves of the count where the corpus is too small to tell."""
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0
    raw = [k - (k + 1) * y * b / a if a and b else k / 2 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))


def _write_weights(folder: str, starts: np.ndarray, low: tuple, high: tuple, types: int, spread: float):
    """Beside each word: lower-order probability, its context's total and the weight that its context passes down."""
    words = int(starts[-1])
    low, high = np.array([0.0, *low]), np.array(high)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, ids, *sums = _columns(batches, ["kind", "id", "a", "b", "c", "d"])
        shard = np.searchsorted(starts, ids, "right") - 1
        for s in np.unique(shard):
            out = np.zeros((starts[s + 1] - starts[s], 4))
            for k in (0, 1):
                mine = (shard == s) & (kind == k)
                at, (a, b, c, d) = ids[mine] - starts[s], (x[mine] for x in sums)
                if k:
                    out[at, 0] = (a - low[np.minimum(a, 3)]) / types + spread / (words + 1)
                else:
                    out[at, 1] = a
                    out[at, 2] = (high[0] * b + high[1] * c + high[2] * d) / a
            _save(f"{folder}/weights-{s}.npy", out)
            yield pa.RecordBatch.from_arrays([pa.array([int(s)])], names=["shard"])

    return run


class Model:
    """What a worker needs to score: where the arrays lie, and a few numbers."""

    def __init__(self, folder: str, starts: np.ndarray, shards: int, total: int, high: tuple, spread: float, begin: tuple[float, float]):
        self.folder, self.starts, self.shards, self.total = folder, starts, shards, total
        self.high, self.spread, self.begin = np.array([0.0, *high]), spread, begin

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of distinct bigram keys; 0 where training never saw them."""
        out = np.zeros(len(keys), np.int64)
        shard = _shard(mix(keys), self.shards)
        order = np.argsort(shard, kind="stable")
        found, at = np.unique(shard[order], return_index=True)
        for s, a, b in zip(found, at, np.append(at[1:], len(order))):
            known = _mapped(self.folder, f"pairs-{s}")
            if len(known):
                mine = order[a:b]
                place = np.minimum(np.searchsorted(known, keys[mine]), len(known) - 1)
                hit = known[place] == keys[mine]
                out[mine[hit]] = _mapped(self.folder, f"times-{s}")[place[hit]]
        return out

    def log_probabilities(self, tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per token: seen in training or not, log10 of the base and of the model."""
        words = _Words(self.folder, self.starts)
        size = int(self.starts[-1])
        distinct, back = np.unique(tokens, return_inverse=True)
        ids = words.ids(distinct)
        order = np.argsort(ids, kind="stable")
        known = order[ids[order] >= 0]
        # One row more than there are distinct tokens: the begin of a text as a context.
        seen, lower, total, passed = np.zeros(len(ids)), np.full(len(ids), self.spread / (size + 1)), np.zeros(len(ids) + 1), np.ones(len(ids) + 1)
        seen[known] = words.values("counts", ids[known], 1)[:, 0]
        weights = words.values("weights", ids[known], 4)
        lower[known] = weights[:, 0]
        total[known] = weights[:, 1]
        passed[known] = np.where(weights[:, 1] > 0, weights[:, 2], 1.0)
        total[-1], passed[-1] = self.begin
        context = _contexts(back, counts, len(ids))
        all_ids = np.append(ids, size)
        left, right = all_ids[context], ids[back]
        both = np.flatnonzero((left >= 0) & (right >= 0))
        keys, again = np.unique(left[both].astype(np.uint64) << np.uint64(32) | right[both].astype(np.uint64), return_inverse=True)
        pair = np.zeros(len(tokens))
        pair[both] = self.pair_counts(keys)[again]
        share = (pair - self.high[np.minimum(pair, 3).astype(np.int64)]) / np.maximum(total[context], 1)
        model = np.log10(share + passed[context] * lower[back])
        base = np.log10((seen + 0.5) / (self.total + 0.5 * (size + 1)))
        return seen[back] > 0, base[back], model


def train(docs: DataFrame, words_per_shard: int = 500_000, pairs_per_shard: int = 3_000_000, hold: int = 2_000_000) -> Model:
    """Count the model over all whole texts of `docs`."""
    spark = docs.sparkSession
    texts = docs.select(F.col("text").cast("string").alias("text"))
    folder = posix_folder(spark, "language-model")
    os.makedirs(folder, exist_ok=True)
    counted = stored(texts.mapInArrow(_count_words, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "lm-words")
    size, total = counted.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    shards = max(8, -(-size // words_per_shard))
    place = F.pmod(F.shiftrightunsigned("h", 40), F.lit(shards))
    written = counted.select(place.alias("shard"), "h", "c").repartition(shards, "shard").mapInArrow(_write_words(folder), "shard long, n long")
    sizes = dict.fromkeys(range(shards), 0) | {r["shard"]: r["n"] for r in written.collect()}
    starts = np.concatenate([[0], np.cumsum([sizes[s] for s in range(shards)])]).astype(np.int64)

    pair_shards = max(8, -(-total // pairs_per_shard))
    pairs = texts.mapInArrow(_count_pairs(folder, starts, pair_shards, hold), "shard long, keys binary, counts binary")
    sums = pairs.repartition(pair_shards, "shard").mapInArrow(_write_pairs(folder), "kind int, id long, a long, b long, c long, d long")
    stats = stored(sums.groupBy("kind", "id").agg(*[F.sum(x).alias(x) for x in "abcd"]), "lm-sums")
    high = discounts(*(stats.where("kind = 2").select(*"abcd").first() or (0, 0, 0, 0)))
    follows = F.col("kind") == 1
    few = stats.where(follows).agg(*[F.count(F.when(F.col("a") == k, 1)) for k in (1, 2, 3, 4)], F.count("*"), F.coalesce(F.sum("a"), F.lit(0))).first()
    low = discounts(*few[:4])
    types = few[5]
    spread = (low[0] * few[0] + low[1] * few[1] + low[2] * (few[4] - few[0] - few[1])) / types if types else 1.0
    first = stats.where((F.col("kind") == 0) & (F.col("id") == int(starts[-1]))).select(*"abcd").first()
    begin = (float(first[0]), float(np.dot(high, first[1:])) / first[0]) if first else (0.0, 1.0)
    bounds = F.array(*[F.lit(int(x)) for x in starts[1:]])
    of_words = stats.where((F.col("kind") < 2) & (F.col("id") < int(starts[-1])))
    part = F.size(F.filter(bounds, lambda b: b <= F.col("id")))
    of_words.repartition(shards, part).mapInArrow(_write_weights(folder, starts, low, high, types, spread), "shard long").count()
    return Model(folder, starts, pair_shards, total, high, spread, begin)


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, tokens, counts in tokens_of(batch.column("text")):
                at = np.cumsum(counts) - counts
                seen, base, score = model.log_probabilities(tokens, counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[i:j], batch.column("held_out")[i:j], pa.array(counts),
                        pa.array(np.add.reduceat(seen.astype(np.int64), at)), pa.array(np.full(j - i, model.total, np.int64)),
                        pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(score, at)),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def held_out() -> Column:
    """A document is held out if the CRC-32 of its id as text leaves 1 when divided by 5; a null id is the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 1


def scored_documents(docs: DataFrame) -> DataFrame:
    """Score every whole text by a model of the texts that are not held out.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10). Tokens are words (A-Z
    lowered, split at ASCII white space) and one end; a null text is its end alone. The model gives each context a
    distribution over the training vocabulary and one class for all other words. Every row has its row, repeated and
    null ids too; other columns are not read. Without training documents every token has probability one; an empty
    table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", held_out())
    model = train(docs.where(~F.col("held_out")))
    return docs.mapInArrow(
        _scored(model), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
