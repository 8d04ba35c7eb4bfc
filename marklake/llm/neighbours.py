"""Nearest vectors by inner product through a hierarchical k-means tree, searched best bin first.

The tree is grown on a bounded sample, every vector is put in a leaf. A query opens nodes of the tree from a priority
queue, nearest centre first, and visits leaves in that order; how many is calibrated on the sample: visits widen until
the leaves hold the wanted share of the true neighbours of sampled queries. Leaves are cut into blocks of bounded size
and so are the queries that visit them, so a value that a third of all vectors share is many tasks' work. Each pair of
blocks is one matrix product, of which k rows a query leave.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marklake.llm.common import stored


def _lifted(x: np.ndarray, largest: float) -> np.ndarray:
    """One more component gives all vectors one length, so that nearest by distance is nearest by inner product."""
    return np.hstack([x, np.sqrt(np.maximum(largest**2 - (x * x).sum(1), 0))[:, None]])


class Tree:
    """Centres of all nodes in one array; `children[i]` are a node's children, a node without them is a leaf."""

    def __init__(self, sample: np.ndarray, largest: float, branching: int, leaf: int, seed: int = 7):
        self.largest, self.branching = largest, branching
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self._grow(_lifted(sample, largest), leaf, np.random.default_rng(seed))
        self.points = np.array(self.centres)
        self.leaves = np.array([i for i, c in enumerate(self.children) if not c])
        self.leaf_number = {int(n): k for k, n in enumerate(self.leaves)}

    def _grow(self, x: np.ndarray, leaf: int, draw: np.random.Generator) -> int:
        me = len(self.centres)
        self.centres.append(x.mean(0) if len(x) else np.zeros(x.shape[1]))
        self.children.append([])
        if len(x) > leaf:
            groups = self._means(x, min(self.branching, -(-len(x) // leaf)), draw)
            if len(groups) > 1:
                self.children[me] = [self._grow(x[g], leaf, draw) for g in groups]
        return me

    @staticmethod
    def _means(x: np.ndarray, k: int, draw: np.random.Generator, rounds: int = 12) -> list[np.ndarray]:
        centres = x[draw.choice(len(x), k, replace=False)]
        own = np.zeros(len(x), np.int64)
        for _ in range(rounds):
            own = ((centres * centres).sum(1)[None, :] - 2 * x @ centres.T).argmin(1)
            centres = np.array([x[own == c].mean(0) if (own == c).any() else x[draw.integers(len(x))] for c in range(k)])
        return [g for g in (np.flatnonzero(own == c) for c in range(k)) if len(g)]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf number of each vector: at every node to the nearest child."""
        x, out = _lifted(x, self.largest), np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            below = self.children[node]
            if not below:
                out[rows] = self.leaf_number[node]
            elif len(rows):
                c = self.points[below]
                near = ((c * c).sum(1)[None, :] - 2 * x[rows] @ c.T).argmin(1)
                todo += [(child, rows[near == k]) for k, child in enumerate(below)]
        return out

    def visits(self, query: np.ndarray, leaves: int, sizes: np.ndarray, least: int) -> list[int]:
        """Leaf numbers in best-bin-first order: at least `leaves` of them and at least `least` vectors."""
        q, found, held = np.append(query, 0.0), [], 0
        queue = [(0.0, 0)]
        while queue and (len(found) < leaves or held < least):
            _, node = heapq.heappop(queue)
            below = self.children[node]
            if below:
                gaps = self.points[below] - q
                for gap, child in zip((gaps * gaps).sum(1), below):
                    heapq.heappush(queue, (float(gap), child))
            else:
                k = self.leaf_number[node]
                found.append(k)
                held += int(sizes[k])
        return found


def calibrate(tree: Tree, sample: np.ndarray, k: int, recall: float, queries: int) -> int:
    """The fewest leaf visits that hold `recall` of the k nearest sampled vectors of sampled queries."""
    if len(tree.leaves) < 2 or len(sample) < 2:
        return len(tree.leaves)
    asked = np.arange(0, len(sample), max(1, len(sample) // queries))
    leaf, k = tree.assign(sample), min(k, len(sample) - 1)
    hits = np.zeros(len(tree.leaves))
    none = np.zeros(len(tree.leaves), np.int64)
    for i in asked:
        score = sample @ sample[i]
        score[i] = -np.inf
        near = leaf[np.argpartition(-score, k - 1)[:k]]
        place = np.empty(len(tree.leaves), np.int64)
        place[tree.visits(sample[i], len(tree.leaves), none, 0)] = np.arange(len(tree.leaves))
        hits += np.bincount(place[near], minlength=len(hits))
    share = np.cumsum(hits) / (len(asked) * k)
    return int(np.searchsorted(share, recall)) + 1


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def usable(vector: Column) -> Column:
    """Not null, not empty, not zero, without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _assigned(tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = tree.value.assign(_matrix(batch.column("v")))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=["vec_id", "v", "leaf"])

    return run


def _visiting(tree, visits: int, sizes: np.ndarray, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaves = [tree.value.visits(q, visits, sizes, least) for q in _matrix(batch.column("v"))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves, pa.list_(pa.int64()))], names=["vec_id", "v", "leaves"])

    return run


def _block(k: int):
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        ids = vectors.column("vec_id").to_numpy()
        out: list[list[np.ndarray]] = [[], [], []]
        if len(ids) and queries.num_rows:
            x, q = _matrix(vectors.column("v").combine_chunks()), _matrix(queries.column("v").combine_chunks())
            rough = q @ x.T
            for row, query, me in zip(rough, q, queries.column("vec_id").to_numpy()):
                row = np.where(ids == me, -np.inf, row)
                least = np.partition(row, -k)[-k] if len(row) > k else -np.inf
                # Products within rounding of the last place are measured again, each by itself, before ties are cut.
                near = np.flatnonzero((row >= least - 1e-9 * (1 + abs(least))) & (row > -np.inf)) if least > -np.inf else np.flatnonzero(row > -np.inf)
                exact = (x[near] * query).sum(1)
                top = np.lexsort((ids[near], -exact))[:k]
                out[0].append(np.full(len(top), me))
                out[1].append(ids[near][top])
                out[2].append(exact[top])
        joined = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table({"query_id": pa.array(joined[0].astype(np.int64)), "vec_id": pa.array(joined[1].astype(np.int64)), "score": pa.array(joined[2])})

    return run


def nearest(
    vectors: DataFrame, every: int = 20, k: int = 20, recall: float = 0.97, sample: int = 20_000, branching: int = 8, leaf: int = 32, block: int = 4096
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each vector whose id `every` divides, by inner product.

    Reads vec_id and embedding. Rows that take no part: null ids; vectors that are null, empty, zero, or hold null or
    non-finite components; vectors of another length than the usable one of the smallest id. Candidates are all rows
    but those with the query's id; a repeated query id is asked once, with its least vector. Ties go to the smaller
    vec_id. An empty table gives no rows. The tree is fitted on the `sample` vectors whose ids hash lowest.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    length = rows.agg(F.min_by(F.size("v"), "vec_id")).first()[0] or 0
    rows = rows.where(F.size("v") == length)
    norm = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x)
    largest = float(np.sqrt(rows.agg(F.max(norm)).first()[0] or 0.0))
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    fitted = _matrix(chosen.column("v").combine_chunks()).reshape(-1, max(length, 1))
    own = Tree(fitted, largest, branching, leaf)
    visits = calibrate(own, fitted, k, recall, 300)
    tree = spark.sparkContext.broadcast(own)

    kind = dict(rows.dtypes)["v"]
    placed = stored(rows.mapInArrow(_assigned(tree), f"vec_id long, v {kind}, leaf long"), "leaf-vectors")
    sizes = np.zeros(len(own.leaves), np.int64)
    for r in placed.groupBy("leaf").agg(F.count("*").alias("n")).collect():  # at most one row per leaf
        sizes[r["leaf"]] = r["n"]
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = stored(asked.mapInArrow(_visiting(tree, visits, sizes, 4 * k), f"vec_id long, v {kind}, leaves array<long>"), "leaf-queries")
    asking = asked.select("vec_id", "v", F.explode("leaves").alias("leaf"))
    per_leaf = {r["leaf"]: r["n"] for r in asking.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    cuts = spark.createDataFrame(
        [(i, max(1, -(-int(n) // block)), max(1, -(-per_leaf.get(i, 1) // block))) for i, n in enumerate(sizes)], "leaf long, vb int, qb int"
    )

    def spread(df: DataFrame, mine: str, other: str) -> DataFrame:
        """Rows in one of their own blocks and copied to each block of the other side."""
        df = df.join(F.broadcast(cuts), "leaf").withColumn(mine, F.pmod(F.xxhash64("vec_id", F.lit(mine)), F.col(mine)).cast("int"))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).select("leaf", "vb", "qb", "vec_id", "v")

    keys = ["leaf", "vb", "qb"]
    found = (
        spread(asking, "qb", "vb").groupBy(*keys).cogroup(spread(placed, "vb", "qb").groupBy(*keys))
        .applyInArrow(_block(k), "query_id long, vec_id long, score double")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
