"""Hard negatives by a multiway tree of hyperplanes whose split points know how far the subtrees beside them lie.

Vectors get one more component that gives all the same length; anchors get none there. Then a score is a distance: the
higher the one, the shorter the other, and a window of scores is an annulus around the anchor. A node has several split
points, and a vector goes to the nearest of them. Each split point stores the least and largest distance to the vectors
of every sibling's subtree (and of its own). From an anchor's distance to a split point and that range follows how near
and how far those vectors can be to the anchor: a subtree whose interval does not meet an annulus that is still wanted
is never opened. Leaves are compared exactly, so nothing is lost.

The upper tree is grown on a bounded sample, every vector is put into a leaf of it and counts in its ranges. A leaf is
cut into blocks of bounded size, and each block grows its own tree of the same kind in its task, so that the depth
follows the table. Vectors of one label that are equal are one point, which carries the smallest ids that can be asked
for; equal anchors are one question. What an anchor may still want is first bounded by the sample, then by what a task
has found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marklake.llm.common import begin_task, stored

SLACK = 1e-9  # of the largest squared distance: what rounding may add to one
NOTHING = -(2**63)


class Space:
    """Squared distances of vectors lifted to one length, from exact inner products."""

    def __init__(self, longest: int):
        self.longest = float(longest)

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.longest - (x * x).sum(1), 0.0))

    def between(self, p: np.ndarray, x: np.ndarray, lift: np.ndarray) -> np.ndarray:
        """Distances of vectors to split points, one row a vector."""
        return np.sqrt(np.maximum(2 * self.longest - 2 * (x @ p.T + np.outer(lift, self.lift(p))), 0.0))

    def asked(self, q: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Distances of anchors to split points, one row an anchor."""
        return np.sqrt(np.maximum((q * q).sum(1)[:, None] + self.longest - 2 * (q @ p.T), 0.0))

    def radius(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance that a score is; `score` holds a row of scores for each anchor."""
        return np.sqrt(np.maximum(((q * q).sum(1) + self.longest)[:, None] - 2 * score, 0.0))

    @property
    def slack(self) -> float:
        return 2 * np.sqrt(SLACK * self.longest) + 1e-6


class Node:
    """Split points, the nodes below them, and `least` and `most`: row i, column j hold the range of split point i to subtree j."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.below: list[Node | None] = [None] * len(points)
        self.least = np.full((len(points), len(points)), np.inf)
        self.most = np.full((len(points), len(points)), -np.inf)
        self.number, self.leaf = -1, [-1] * len(points)
        self.rows: list[np.ndarray] = []

    def meets(self, space: Space, q: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Which subtrees may hold something wanted by each anchor: within one of its annuli from `near` to `far`."""
        gap = space.asked(q, self.points)
        low = np.maximum(gap[:, :, None] - self.most, self.least - gap[:, :, None]).max(1)
        high = (gap[:, :, None] + self.most).min(1)
        wanted = (low[:, :, None] <= far[:, None, :] + space.slack) & (high[:, :, None] >= near[:, None, :] - space.slack)
        return wanted.any(2)


def split(x: np.ndarray, many: int, draw: np.random.Generator) -> np.ndarray:
    """Split points far from each other, out of a few random ones: each the one farthest from those before it."""
    few = x[draw.choice(len(x), min(len(x), 3 * many), replace=False)]
    few = np.unique(few, axis=0)
    chosen = [0]
    gap = ((few - few[0]) ** 2).sum(1)
    while len(chosen) < min(many, len(few)):
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((few - few[chosen[-1]]) ** 2).sum(1))
    return few[chosen]


def grow(space: Space, x: np.ndarray, many: int, leaf: int, draw: np.random.Generator, rows: np.ndarray | None = None) -> Node | None:
    """A tree over all of `x` with its ranges; `rows` are the leaf's own, None where there is nothing to split."""
    rows = np.arange(len(x)) if rows is None else rows
    if len(rows) <= leaf:
        return None
    points = split(x[rows], many, draw)
    if len(points) < 2:
        return None
    node, gap = Node(points), space.between(points, x[rows], space.lift(x[rows]))
    own = gap.argmin(1)
    for j in range(len(points)):
        held = own == j
        node.rows.append(rows[held])
        if held.any():
            node.least[:, j], node.most[:, j] = gap[held].min(0), gap[held].max(0)
            if not held.all():
                node.below[j] = grow(space, x, many, leaf, draw, rows[held])
    return node


class Upper:
    """The tree of the sample: nodes and leaves have numbers, and ranges are filled in from the whole table."""

    def __init__(self, space: Space, root: Node | None):
        self.space, self.root = space, root
        self.nodes: list[Node] = []
        self.leaves = 0
        if root is None:
            self.leaves = 1
        else:
            self._name(root)

    def _name(self, node: Node) -> None:
        node.number, node.rows = len(self.nodes), []
        self.nodes.append(node)
        node.least[:], node.most[:] = np.inf, -np.inf
        for j, child in enumerate(node.below):
            if child is None:
                node.leaf[j], self.leaves = self.leaves, self.leaves + 1
            else:
                self._name(child)

    def assign(self, x: np.ndarray, see: Callable[[Node, np.ndarray, np.ndarray], None] | None = None) -> np.ndarray:
        """The leaf of each vector; `see` is told every node's distances and choices."""
        out, lift = np.zeros(len(x), np.int64), self.space.lift(x)
        todo = [(self.root, np.arange(len(x)))] if self.root is not None else []
        while todo:
            node, rows = todo.pop()
            gap = self.space.between(node.points, x[rows], lift[rows])
            own = gap.argmin(1)
            if see:
                see(node, gap, own)
            for j, child in enumerate(node.below):
                held = rows[own == j]
                if child is None:
                    out[held] = node.leaf[j]
                elif len(held):
                    todo.append((child, held))
        return out

    def open(self, q: np.ndarray, near: np.ndarray, far: np.ndarray) -> list[list[int]]:
        """Leaves that may hold something wanted, for each anchor."""
        if self.root is None:
            return [[0]] * len(q)
        out: list[list[int]] = [[] for _ in range(len(q))]
        todo = [(self.root, np.arange(len(q)))]
        while todo:
            node, rows = todo.pop()
            wanted = node.meets(self.space, q[rows], near[rows], far[rows])
            for j, child in enumerate(node.below):
                held = rows[wanted[:, j]]
                if child is not None and len(held):
                    todo.append((child, held))
                elif child is None:
                    for i in held:
                        out[i].append(node.leaf[j])
        return out


def _matrix(column: pa.Array | pa.ChunkedArray, length: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def kth(scores: np.ndarray, ok: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest score of each row among those that count, the least number where there are fewer."""
    held = np.where(ok, scores, NOTHING)
    return np.partition(held, -k, axis=1)[:, -k] if held.shape[1] >= k else np.full(len(held), NOTHING)


class Wanted:
    """What anchors ask for: `k` best scores of the same label, or of other labels in each of their windows."""

    def __init__(self, labels: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        self.labels, self.low, self.high, self.k, self.same = labels, low, high, k, same  # a row of windows for each anchor

    def of(self, rows: np.ndarray) -> Wanted:
        return Wanted(self.labels[rows], self.low[rows], self.high[rows], self.k, self.same)

    def fits(self, scores: np.ndarray, labels: np.ndarray, w: int) -> np.ndarray:
        return ((self.labels[:, None] == labels) == self.same) & (scores >= self.low[:, w, None]) & (scores <= self.high[:, w, None])

    def raise_by(self, scores: np.ndarray, labels: np.ndarray, counts: np.ndarray | None = None) -> None:
        """Let `low` be at least the k-th best of what was met, which only that or better can now improve."""
        for w in range(self.low.shape[1]):
            self.low[:, w] = np.maximum(self.low[:, w], kth(scores, self.fits(scores, labels, w), self.k))

    def annuli(self, space: Space, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From and to which distance; an empty window is nowhere."""
        none = self.low > self.high
        near = space.radius(q, self.high.astype(np.float64))
        far = space.radius(q, np.maximum(self.low, -4 * space.longest).astype(np.float64))
        return np.where(none, np.inf, near), np.where(none, -np.inf, far)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: as doubles where none can pass 2^53, else as 64-bit numbers, which stops
    the job where one could pass them."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if most < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if most >= 2**56:
        raise ValueError("a hundredfold of inner products would not fit 64 bits")
    return q @ x.T


def search(space: Space, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, wanted: Wanted, many: int, leaf: int) -> tuple[tuple[np.ndarray, ...], int]:
    """All points of a block that are among the k best of an anchor's window there: (anchor, window, point, score), and
    how many products were formed. Ties beyond the k-th are cut by id."""
    f, fq = x.astype(np.float64), q.astype(np.float64)
    root = grow(space, f, many, leaf, np.random.default_rng(11))
    found: list[tuple[np.ndarray, ...]] = []
    formed = 0

    def compare(rows: np.ndarray, points: np.ndarray) -> None:
        nonlocal formed
        mine = wanted.of(rows)
        scores = products(q[rows], x[points])
        formed += scores.size
        mine.raise_by(scores, labels[points])
        wanted.low[rows] = mine.low
        for w in range(mine.low.shape[1]):
            i, j = np.nonzero(mine.fits(scores, labels[points], w))
            if len(i):
                found.append((rows[i], np.full(len(i), w), points[j], scores[i, j]))

    home = np.full(len(q), -1)  # first to the leaf around each anchor, for bounds that close other subtrees
    todo: list[tuple[Node | None, np.ndarray, np.ndarray]] = [(root, np.arange(len(q)), np.arange(len(x)))]
    while todo:
        node, rows, points = todo.pop()
        if node is None:
            if len(points) and len(rows):
                home[rows] = points[0]
                compare(rows, points)
            continue
        own = space.asked(fq[rows], node.points).argmin(1)
        todo += [(node.below[j], rows[own == j], node.rows[j]) for j in np.unique(own)]
    todo = [(root, np.arange(len(q)), np.arange(len(x)))]
    while todo:
        node, rows, points = todo.pop()
        if node is None:
            if len(points):
                rows = rows[home[rows] != points[0]]
                if len(rows):
                    compare(rows, points)
            continue
        near, far = wanted.of(rows).annuli(space, fq[rows])
        meets = node.meets(space, fq[rows], near, far)
        for j in range(len(node.points)):
            held = rows[meets[:, j]]
            if len(held) and len(node.rows[j]):
                todo.append((node.below[j], held, node.rows[j]))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4)), formed
    a, w, p, s = (np.concatenate(c) for c in zip(*found))
    keep = s >= wanted.low[a, w]
    a, w, p, s = a[keep], w[keep], p[keep], s[keep]
    order = np.lexsort((ids[p], -s, w, a))
    a, w, p, s = a[order], w[order], p[order], s[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (w[1:] != w[:-1])])
    place = np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)]))
    keep = place < wanted.k
    return (a[keep], w[keep], p[keep], s[keep]), formed


# ---- on Spark ---------------------------------------------------------------------------------------------------


def _assigned(upper, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task("hard-negatives")
        for batch in batches:
            if batch.num_rows:
                leaf = upper.value.assign(_matrix(batch.column("v"), length).astype(np.float64))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=[*batch.schema.names, "leaf"])

    return run


def _ranges(upper, length: int):
    """One row for each pair of a split point and a subtree that a task's vectors met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = [np.full(n.least.shape, np.inf) for n in upper.value.nodes]
        most = [np.full(n.most.shape, -np.inf) for n in upper.value.nodes]

        def see(node: Node, gap: np.ndarray, own: np.ndarray) -> None:
            for j in np.unique(own):
                held = gap[own == j]
                least[node.number][:, j] = np.minimum(least[node.number][:, j], held.min(0))
                most[node.number][:, j] = np.maximum(most[node.number][:, j], held.max(0))

        for batch in batches:
            if batch.num_rows:
                upper.value.assign(_matrix(batch.column("v"), length).astype(np.float64), see)
        for number, (a, b) in enumerate(zip(least, most)):
            i, j = np.nonzero(np.isfinite(a))
            yield pa.RecordBatch.from_pydict({"node": np.full(len(i), number), "i": i, "j": j, "least": a[i, j], "most": b[i, j]})

    return run


def _windows(scores: list[list[int]] | None, many: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """A row of windows for each anchor: all scores, or a percentage of each given score; unused ones are empty."""
    if scores is None:
        return np.full((many, 1), NOTHING), np.full((many, 1), 2**62)
    wide = max([1, *map(len, scores)])
    lows, highs = np.ones((many, wide), np.int64), np.zeros((many, wide), np.int64)
    for i, row in enumerate(scores):
        for w, s in enumerate(row):
            if s >= 0:
                lows[i, w], highs[i, w] = -(-low * s // 100), high * s // 100
    return lows, highs


def _opening(upper, sample, length: int, k: int, low: int, high: int, same: bool, step: int = 256):
    """Leaves that each anchor has to open, and the least scores that can still count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task("hard-negatives")
        known, labels = sample.value
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                q = _matrix(batch.column("v"), length)
                given = None if same else batch.column("scores").to_pylist()
                lows, highs = _windows(given, len(q), low, high)
                wanted = Wanted(batch.column("label").to_numpy(), lows, highs, k, same)
                wanted.raise_by(products(q, known), labels)
                leaves = upper.value.open(q.astype(np.float64), *wanted.annuli(upper.value.space, q.astype(np.float64)))
                scores = pa.array(given or [[0]] * len(q), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("point"), batch.column("label"), batch.column("v"), scores, *(pa.array(x.tolist(), pa.list_(pa.int64())) for x in (wanted.low, wanted.high)), pa.array(leaves, pa.list_(pa.int64()))],
                    names=["point", "label", "v", "scores", "low", "high", "leaves"],
                )

    return run


def _block(space: Space, length: int, k: int, same: bool, many: int, leaf: int):
    def run(questions: pa.Table, points: pa.Table) -> pa.Table:
        kinds = pa.schema([("point", pa.binary()), ("window", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.int64())])
        if not questions.num_rows or not points.num_rows:
            return kinds.empty_table()
        x, q = _matrix(points.column("v"), length), _matrix(questions.column("v"), length)
        ids = points.column("ids").combine_chunks()
        first = ids.values.to_numpy()[ids.offsets.to_numpy()[:-1]]
        scores = questions.column("scores").to_pylist()
        wide = max(map(len, scores))
        low, high = np.ones((len(q), wide), np.int64), np.zeros((len(q), wide), np.int64)
        for name, out in (("low", low), ("high", high)):
            for i, row in enumerate(questions.column(name).to_pylist()):
                out[i, : min(len(row), wide)] = row[:wide]
        wanted = Wanted(questions.column("label").to_numpy(), low, high, k, same)
        (a, w, p, s), _ = search(space, x, first, points.column("label").to_numpy(), q, wanted, many, leaf)
        window = np.array([scores[i][j] for i, j in zip(a, w)], np.int64)
        keys = questions.column("point").combine_chunks()
        return pa.Table.from_arrays([keys.take(pa.array(a)), pa.array(window), ids.take(pa.array(p)), pa.array(s)], schema=kinds)

    return run


class Index:
    """All points in the leaves of one tree, as a stored table, and what the driver knows of them."""

    def __init__(self, points: DataFrame, sample: int, many: int, leaf: int, block: int):
        spark = points.sparkSession
        self.many, self.leaf, self.block = many, leaf, block
        norm = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x)
        count, self.length, longest = points.agg(F.count("*"), F.max(F.size("v")), F.max(norm)).first()
        self.length, self.space = self.length or 1, Space(longest or 0.0)
        chosen = points.orderBy(F.xxhash64("point"), "point").limit(sample).select("v", "label").toArrow()
        known = _matrix(chosen.column("v"), self.length)
        full = max(leaf, len(known) * block // max(count, 1))
        upper = Upper(self.space, grow(self.space, known.astype(np.float64), many, full, np.random.default_rng(7)))
        self.sample = spark.sparkContext.broadcast((known, chosen.column("label").to_numpy()))
        kinds = "point binary, label long, v array<long>, ids array<long>, leaf long"
        bare = spark.sparkContext.broadcast(upper)
        self.points = stored(points.select("point", "label", "v", "ids").mapInArrow(_assigned(bare, self.length), kinds), "tree-points")
        met = self.points.select("v").mapInArrow(_ranges(bare, self.length), "node long, i long, j long, least double, most double")
        for r in met.groupBy("node", "i", "j").agg(F.min("least").alias("least"), F.max("most").alias("most")).collect():  # the tree's size
            upper.nodes[r["node"]].least[r["i"], r["j"]] = r["least"]
            upper.nodes[r["node"]].most[r["i"], r["j"]] = r["most"]
        self.upper = spark.sparkContext.broadcast(upper)
        self.held = np.zeros(upper.leaves, np.int64)
        for r in self.points.groupBy("leaf").agg(F.count("*").alias("n")).collect():
            self.held[r["leaf"]] = r["n"]

    def best(self, questions: DataFrame, k: int, low: int = 0, high: int = 0) -> DataFrame:
        """(point, window, ids, score): per block at most the k best points of each question, of its own label; with a
        column `scores`, of other labels within `low` to `high` percent of each of these."""
        spark, same = questions.sparkSession, "scores" not in questions.columns
        columns = ["point", "label", "v"] + ["scores"] * (not same)
        kinds = "point binary, label long, v array<long>, scores array<long>, low array<long>, high array<long>, leaves array<long>"
        asked = stored(questions.select(columns).mapInArrow(_opening(self.upper, self.sample, self.length, k, low, high, same), kinds), "tree-questions")
        asking = asked.withColumn("leaf", F.explode("leaves")).drop("leaves")
        opened = {r["leaf"]: r["n"] for r in asking.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
        cuts = spark.createDataFrame(
            [(i, max(1, -(-int(n) // self.block)), max(1, -(-opened.get(i, 1) // self.block))) for i, n in enumerate(self.held)], "leaf long, vb int, qb int"
        )

        def spread(df: DataFrame, mine: str, other: str) -> DataFrame:
            df = df.join(F.broadcast(cuts), "leaf").withColumn(mine, F.pmod(F.xxhash64("point", F.lit(mine)), F.col(mine)).cast("int"))
            return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))

        keys = ["leaf", "vb", "qb"]
        return (
            spread(asking, "qb", "vb").groupBy(*keys).cogroup(spread(self.points, "vb", "qb").groupBy(*keys))
            .applyInArrow(_block(self.space, self.length, k, same, self.many, self.leaf), "point binary, window long, ids array<long>, score long")
        )


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best ids of each key, ties to the smaller id."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    each = found.select(*keys, F.explode("ids").alias("id"), "score")
    return each.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def hard_negatives(
    vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    sample: int = 20_000, many: int = 8, leaf: int = 64, block: int = 4096,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where `anchor` holds.

    Reads vec_id, label and v, an array of whole numbers. A score is the inner product with the anchor, ties go to the
    smaller vec_id. Positives are an anchor's first rows of its label but itself; each brings the first rows of other
    labels whose score is from `low` to `high` percent of its own. Rows with a null id, label, vector or component take
    no part, nor vectors that are empty or of another length than that of the smallest id; of rows with one id the
    least (label, v) counts. An anchor without positives, and a positive without negatives, has no rows; so has an empty
    table. Products of which a hundredfold does not fit 64 bits stop the job. The tree is fitted on the `sample` points
    whose hashes are lowest; all rows are in it. A block is at most about `block` points by `block` anchors.
    """
    whole = F.coalesce(F.forall("v", lambda x: x.isNotNull()), F.lit(False))
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("v").cast("array<long>").alias("v"),
        F.coalesce(anchor, F.lit(False)).alias("asks"),
    ).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & whole & (F.size("v") > 0))
    length = rows.agg(F.min_by(F.size("v"), "vec_id")).first()[0] or 0
    one = rows.where(F.size("v") == length).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x"), F.max("asks").alias("asks"))
    name = F.unhex(F.md5(F.concat_ws(",", F.col("x.label").cast("string"), F.col("x.v").cast("array<string>"))))
    one = stored(one.select("vec_id", "x.label", "x.v", "asks", name.alias("point")), "vectors")

    nth = Window.partitionBy("point").orderBy("vec_id")
    few = one.withColumn("place", F.row_number().over(nth)).where(F.col("place") <= max(positives + 1, negatives))
    points = few.groupBy("point").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    index = Index(stored(points, "points"), sample, many, leaf, block)

    anchors = one.where("asks").select(F.col("vec_id").alias("anchor_id"), "point")
    questions = index.points.join(anchors.select("point").distinct(), "point", "leftsemi").select("point", "label", "v")
    nearest = _first(index.best(questions, positives + 1), ["point"], positives + 1)
    nearest = stored(nearest.groupBy("point").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("best")), "positives")
    scored = questions.join(nearest.select("point", F.array_distinct(F.col("best.score")).alias("scores")), "point")
    below = _first(index.best(scored, negatives, low, high), ["point", "window"], negatives)

    others = F.slice(F.filter("best", lambda b: b.id != F.col("anchor_id")), 1, positives)
    pairs = anchors.join(nearest, "point").select("anchor_id", "point", F.explode(others).alias("p"))
    pairs = pairs.select("anchor_id", "point", F.col("p.id").alias("positive_id"), F.col("p.score").alias("window"))
    return pairs.join(below, ["point", "window"]).select(
        "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        F.col("window").alias("positive_score"), F.col("score").alias("negative_score"),
    )
