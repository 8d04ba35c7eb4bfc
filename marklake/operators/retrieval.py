"""Curriculum corpus and exact vector retrieval."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from marklake.functions.numeric import fmt_float, round_even
from marklake.session import checkpointed

QUERY_CELL, VECTOR_CELL = 1024, 4096  # at least so many rows a block
BLOCKS, BLOCK_FLOATS = 8, 1 << 22  # blocks to a side, until one holds so many numbers


# --- corpus -----------------------------------------------------------------------------


def _entry(df: DataFrame, kind: str, content: Column, metadata: dict[str, str]) -> DataFrame:
    pairs = reduce(lambda acc, kv: [*acc, F.lit(kv[0]), F.col(kv[1]).cast("string")], metadata.items(), [])
    return df.select(
        F.col("id").cast("string").alias("document_id"),
        F.lit(kind).alias("document_type"),
        F.trim(content).alias("content"),
        F.create_map(*pairs).alias("metadata"),
    )


def corpus(subjects, chapters, topics, questions, answers, rubrics) -> DataFrame:
    """One retrieval row per curriculum entity, with the text template of its type."""
    c = F.col
    parts = [
        _entry(
            subjects, "Subject", F.concat(F.lit("Subject: "), c("name"), F.lit(" ("), c("code"), F.lit("). "), F.coalesce(c("description"), F.lit(""))),
            {"id": "id", "name": "name", "code": "code"},
        ),
        _entry(
            chapters, "Chapter", F.concat(F.lit("Chapter: "), c("name"), F.lit(". "), F.coalesce(c("description"), F.lit(""))),
            {"id": "id", "subject_id": "subject_id", "name": "name"},
        ),
        _entry(
            topics, "Topic", F.concat(F.lit("Topic: "), c("name"), F.lit(". Objectives: "), F.array_join("learning_objectives", "; ")),
            {"id": "id", "chapter_id": "chapter_id", "name": "name"},
        ),
        _entry(
            questions, "Question",
            F.concat(F.lit("Question: "), c("question_text"), F.lit(" (Difficulty: "), c("difficulty"), F.lit(", Marks: "), fmt_float(c("marks")), F.lit(")")),
            {"id": "id", "topic_id": "topic_id", "marks": "marks", "difficulty": "difficulty"},
        ),
        _entry(answers, "ReferenceAnswer", F.concat(F.lit("Reference Answer: "), c("answer_text")), {"id": "id", "question_id": "question_id"}),
        _entry(
            rubrics, "Rubric", F.concat(F.lit("Rubric for Question: "), c("title")),
            {"id": "id", "question_id": "question_id", "criteria": "criteria"},
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


def curriculum_tree(subjects, chapters, topics, questions, subject_id=None) -> DataFrame:
    """Subject -> chapter -> topic -> question, optionally below one subject."""
    s = subjects if subject_id is None else subjects.filter(F.col("subject_id") == subject_id)
    return (
        s.select("subject_id")
        .join(chapters.select("subject_id", "chapter_id"), "subject_id")
        .join(topics.select("chapter_id", "topic_id"), "chapter_id")
        .join(questions.select("topic_id", "question_id"), "topic_id")
    )


def rubric_criteria(rubrics: DataFrame, criteria: DataFrame) -> DataFrame:
    """The rubric of each question with its criteria."""
    return rubrics.select("question_id", "rubric_id").join(criteria, "rubric_id")


# --- exact nearest neighbours ---------------------------------------------------------------

CELLS = 2048  # at most so many centres
_ROUNDING = 1e-6  # scores are compared at six places


def _unit(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(array), -1)
    norms = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    return rows, norms


def _divided(rows: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return np.divide(rows, norms[:, None], out=np.zeros_like(rows), where=norms[:, None] > 0)


def _directions(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return _divided(*_unit(column))


class _Cells:
    """Centres of cells; from the whole table how many vectors each holds and how far the farthest is from its centre, as an
    angle. Cells that lie together make a block of about `size` vectors."""

    def __init__(self, centres: np.ndarray):
        self.centres = centres
        self.held, self.radius = np.zeros(len(centres), np.int64), np.full(len(centres), -1.0)
        self.block = np.zeros(len(centres), np.int32)

    def angles(self, directions: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(directions @ self.centres.T, -1.0, 1.0))

    def group(self, size: int) -> None:
        """Halve the cells, by which of two far ones is nearer, until each half holds at most `size` vectors or is one cell."""
        left, done = [np.arange(len(self.centres))], 0
        while left:
            own = left.pop()
            if len(own) == 1 or self.held[own].sum() <= size:
                self.block[own], done = done, done + 1
                continue
            a = (self.centres[own] @ self.centres[own[0]]).argmin()
            b = (self.centres[own] @ self.centres[own[a]]).argmin()
            own = own[np.argsort(self.centres[own] @ (self.centres[own[a]] - self.centres[own[b]]), kind="stable")]
            middle = np.searchsorted(np.cumsum(self.held[own]), self.held[own].sum() / 2) + 1
            left += [own[: min(middle, len(own) - 1)], own[min(middle, len(own) - 1) :]]
        order = np.argsort(self.block, kind="stable")
        self.order, self.starts = order, np.flatnonzero(np.r_[True, np.diff(self.block[order]) > 0])

    def per_block(self, values: np.ndarray, of) -> np.ndarray:
        """Values per cell, in the last place, as one per block."""
        return of.reduceat(values[..., self.order], self.starts, axis=-1)

    def best(self, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least angle to a centre of each block, and the most that a score can be in it: an angle is at least the
        centre's, less the radius."""
        angles = self.angles(directions)
        most = np.maximum(np.cos(np.minimum(np.maximum(angles - self.radius, 0.0), np.pi)), 0.0)
        return self.per_block(angles, np.minimum), self.per_block(np.where(self.held > 0, most, -1.0), np.maximum)


def _placed(cells):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                angle = cells.value.angles(_directions(batch.column("embedding")))
                own = angle.argmin(1)
                known = _unit(batch.column("embedding"))[1] > 0  # without a direction the score is 0 anyway
                gap = np.where(known, angle[np.arange(len(own)), own], 0.0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(gap)], names=[*batch.schema.names, "_cell", "_gap"])

    return run


def _visits(cells, k: int, first: bool):
    """Blocks that a query has to look into: the nearest ones that hold k vectors, then all that can still hold a better
    one than its k-th so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = cells.value.per_block(cells.value.held, np.add)
        for whole in batches:
            for batch in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                near, most = cells.value.best(_directions(batch.column("embedding")))
                if first:
                    near = np.where(held > 0, near, np.inf)
                    order = np.argsort(near, axis=1, kind="stable")
                    enough = (np.cumsum(held[order], axis=1) - held[order] < k) & (held[order] > 0)
                    lists = [row[keep].tolist() for row, keep in zip(order, enough)]
                    kth = pa.nulls(batch.num_rows, pa.float64())
                else:
                    kth = batch.column("_kth")
                    least = np.array([-1.0 if x is None else x for x in kth.to_pylist()])
                    wanted = (most + _ROUNDING >= least[:, None]) & (held > 0)
                    for row, seen in zip(wanted, batch.column("_blocks").to_pylist()):
                        row[seen] = False
                    lists = [np.flatnonzero(row).tolist() for row in wanted]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("query_id"), batch.column("embedding"), kth, pa.array(lists, pa.list_(pa.int32()))], names=["query_id", "embedding", "_kth", "_blocks"]
                )

    return run


def _best_so_far(best: tuple, row: np.ndarray, place: np.ndarray, score: np.ndarray) -> None:
    """Put new pairs among the k best of each row: higher scores first, then lower places."""
    scores, places = best
    k = scores.shape[1]
    touched = np.unique(row)
    rows = np.r_[np.repeat(touched, k), row]
    values, at = np.r_[scores[touched].ravel(), score], np.r_[places[touched].ravel(), place]
    order = np.lexsort((at, -values, rows))
    rows, values, at = rows[order], values[order], at[order]
    starts = np.flatnonzero(np.r_[True, np.diff(rows) > 0])
    keep = (starts[:, None] + np.arange(k)).ravel()
    scores[touched], places[touched] = values[keep].reshape(-1, k), at[keep].reshape(-1, k)


_QUERIES, _VECTORS, _FIRST, _PAIRS = 512, 8192, 1024, 1 << 17  # rows of one product, of the first one, pairs scored at once


def _block_topk(k: int, keys: list[str], schema: pa.Schema):
    """The k best vectors of each query, without those under its `_kth`. Products in single precision leave out what its
    error cannot bring to the k-th score; the rest is scored in double precision."""

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        if not queries.num_rows or not vectors.num_rows:
            return schema.empty_table()
        vectors = vectors.take(pc.sort_indices(vectors, sort_keys=[(c, "ascending") for c in keys]))
        q, qn = _unit(queries.column("embedding"))
        v, vn = _unit(vectors.column("embedding"))
        kth = np.nan_to_num(queries.column("_kth").combine_chunks().to_numpy(zero_copy_only=False).astype(np.float64), nan=-1.0)
        qs, vs = _divided(q, qn).astype(np.float32), _divided(v, vn).astype(np.float32)
        margin = _ROUNDING + (q.shape[1] + 8) * 2.0**-22
        ids, places, scores = [], [], []

        def rounded(dots: np.ndarray, scale: np.ndarray) -> np.ndarray:
            return np.round(np.clip(np.divide(dots, scale, out=np.zeros_like(scale), where=scale > 0), 0.0, 1.0), 6)

        for i in range(0, len(q), _QUERIES):
            own = np.flatnonzero(qn[i : i + _QUERIES] > 0) + i
            if not len(own):
                continue
            best = np.full((len(own), k), -2.0), np.full((len(own), k), len(v), np.int64)
            j = 0
            while j < len(v):
                end = min(len(v), j + (_VECTORS if j else _FIRST))
                # Places rise, so a score that only equals the k-th here comes too late.
                local, floor = best[0][:, -1], kth[own]
                least = np.maximum(local, floor)
                near = np.maximum(qs[own] @ vs[j:end].T, 0.0) >= (least - margin).astype(np.float32)[:, None]
                if np.count_nonzero(near) <= 8 * k * len(own):
                    row, place = np.nonzero(near)
                    score = np.concatenate(
                        [rounded(np.einsum("ij,ij->i", q[own[a]], v[b + j]), qn[own[a]] * vn[b + j]) for a, b in ((row[s : s + _PAIRS], place[s : s + _PAIRS]) for s in range(0, len(row), _PAIRS))]
                        or [np.zeros(0)]
                    )
                    keep = (score >= floor[row]) & (score > local[row])
                    row, place, score = row[keep], place[keep], score[keep]
                else:  # many candidates: all scores, of which the k best of each row, the lower place of equal ones
                    shown = rounded(q[own] @ v[j:end].T, np.outer(qn[own], vn[j:end]))
                    shown[(shown < floor[:, None]) | (shown <= local[:, None])] = -1.0
                    place = np.argsort(-shown, axis=1, kind="stable")[:, :k]
                    row, score = np.repeat(np.arange(len(own)), place.shape[1]), np.take_along_axis(shown, place, axis=1).ravel()
                    place = place.ravel()
                    keep = score >= 0
                    row, place, score = row[keep], place[keep], score[keep]
                if len(row):
                    _best_so_far(best, row, place + j, score)
                j = end
            row, column = np.nonzero(best[0] >= 0)
            ids.append(own[row])
            places.append(best[1][row, column])
            scores.append(best[0][row, column])
        if not ids:
            return schema.empty_table()
        documents = vectors.select(keys).take(pa.array(np.concatenate(places)))
        columns = [queries.column("query_id").take(pa.array(np.concatenate(ids))), *documents.columns, pa.array(np.concatenate(scores))]
        return pa.Table.from_arrays(columns, names=schema.names).cast(schema)

    return run


class Neighbours:
    """Vectors in cells by nearness, ready for exact searches.

    Documents are told apart by `keys`, of any type; ties go to the lower key. Cells have at most CELLS centres, drawn by
    a hash of the keys; cells that lie together make blocks of an eighth of the vectors, of BLOCK_FLOATS numbers at most, and
    so are queries that visit a block cut. A cell of more vectors is several parts. A pair of blocks is a product in one
    task, of which k rows per query leave: so a query moves once per block, not once per cell, and there are as many
    blocks however many vectors there are, until the largest ones are full.
    """

    def __init__(self, vectors: DataFrame, keys: list[str]):
        self.spark, self.keys = vectors.sparkSession, keys
        rows = vectors.filter(F.size("embedding") > 0).select(*keys, "embedding")
        n = rows.count()
        chosen = rows.filter(F.exists("embedding", lambda x: x != 0)).orderBy(F.xxhash64(*keys), *keys).limit(min(CELLS, max(1, math.ceil(n / 512))))
        centres = _directions(chosen.select("embedding").toArrow().column(0)) if n else np.zeros((0, 1))
        cells = _Cells(centres if len(centres) else np.zeros((1, max(1, rows.agg(F.max(F.size("embedding"))).first()[0] or 1))))
        types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        shared = self.spark.sparkContext.broadcast(cells)
        self.placed = checkpointed(rows.mapInArrow(_placed(shared), f"{types}, _cell int, _gap double"))
        for r in self.placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.max("_gap").alias("radius")).collect():  # one row per centre
            cells.held[r["_cell"]], cells.radius[r["_cell"]] = r["n"], r["radius"]
        self.most = BLOCK_FLOATS // cells.centres.shape[1] + 1
        self.size = self._side(n, VECTOR_CELL)
        cells.group(self.size)
        self.cells, self.held, self.block = self.spark.sparkContext.broadcast(cells), cells.held, cells.block

    def _side(self, n: int, least: int) -> int:
        return min(max(math.ceil(n / BLOCKS), least), max(self.most, least))

    def _met(self, asked: DataFrame, k: int) -> DataFrame:
        """The k best documents of each query in each block that it visits."""
        asking = asked.select("query_id", "embedding", "_kth", F.explode("_blocks").alias("_block"))
        many = {r["_block"]: r["n"] for r in asking.groupBy("_block").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per block
        side = self._side(max(many.values(), default=1), QUERY_CELL)
        held = np.bincount(self.block, self.held)
        cuts = [(int(b), max(1, math.ceil(int(held[b]) / self.size)), max(1, math.ceil(n / side))) for b, n in many.items()]
        cuts = self.spark.createDataFrame(cuts, "_block int, _v int, _q int")
        blocks = self.spark.createDataFrame([(i, int(b)) for i, b in enumerate(self.block)], "_cell int, _block int")

        def cut(df: DataFrame, by: list[str], mine: str, other: str) -> DataFrame:
            df = df.join(F.broadcast(cuts), "_block").withColumn(mine, F.pmod(F.xxhash64(*by), F.col(mine)).cast("int"))
            return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))

        at = ["_block", "_q", "_v"]
        kinds = {f.name: f.dataType for f in self.placed.schema} | {f.name: f.dataType for f in asked.schema}
        out = T.StructType([T.StructField(c, kinds[c]) for c in ("query_id", *self.keys)] + [T.StructField("score", T.DoubleType())])
        q, v = cut(asking, ["query_id"], "_q", "_v"), cut(self.placed.drop("_gap").join(F.broadcast(blocks), "_cell").drop("_cell"), self.keys, "_v", "_q")
        return q.groupBy(*at).cogroup(v.groupBy(*at)).applyInArrow(_block_topk(k, self.keys, to_arrow_schema(out)), out)

    def _top(self, found: DataFrame, k: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), *self.keys))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k)

    def search(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """(query_id, keys, score, rank), and how many of all cells each query looked into: (query_id, visited, cells)."""
        asked = queries.select("query_id", "embedding").filter(F.size("embedding") > 0)
        types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema) + ", _kth double, _blocks array<int>"
        once = checkpointed(asked.mapInArrow(_visits(self.cells, k, True), types))
        first = checkpointed(self._top(self._met(once, k), k).drop("rank"))
        kth = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("_kth"))
        bounded = once.drop("_kth").join(kth, "query_id", "left").mapInArrow(_visits(self.cells, k, False), types)
        more = checkpointed(bounded)
        sizes = F.array(*[F.lit(int(n)) for n in np.bincount(self.block, self.held > 0)])
        looked = lambda df: df.select("query_id", F.aggregate("_blocks", F.lit(0), lambda n, b: n + F.get(sizes, b)).alias("n"))
        visited = looked(once).unionByName(looked(more)).groupBy("query_id").agg(F.sum("n").alias("visited"))
        visited = visited.withColumn("cells", F.lit(int((self.held > 0).sum())).cast("bigint"))
        return self._top(first.unionByName(self._met(more, k)), k), visited


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 5, keys: list[str] | None = None) -> DataFrame:
    """C8 + F3: exact cosine top-k per query, scores to six places, ties by document id (`keys`, by default document_id).

    A query first looks into the block around it, then into those alone that have a cell whose centre and radius let it
    hold a better document than its k-th. Queries without a direction give no rows; ids may be of any type.
    """
    return Neighbours(vectors, keys or ["document_id"]).search(queries, k)[0]


def retrieve(queries: DataFrame, vectors: DataFrame, k: int = 5, keys: list[str] | None = None) -> DataFrame:
    """Ranked documents with type, content and metadata, scores to four places; blank queries give none. Where ids are
    told apart by their type only, as in `corpus`, `keys` are document_type and document_id."""
    asked = queries.filter(F.trim(F.coalesce("query_text", F.lit(""))) != "")
    keys = keys or ["document_id"]
    hits = nearest(asked, vectors, k, keys)
    docs = vectors.drop("embedding")
    return hits.join(docs, keys).withColumn("score", round_even(F.col("score"), 4))


# --- context -------------------------------------------------------------------------------------

# Words of the query that narrow retrieval, and of the content kept then.
INTENT_FILTERS = [
    (["photo", "science", "plant"], ["photo", "science", "plant", "nutrition"]),
    (["array", "linked", "stack", "queue", "tree", "graph", "dsa"], ["dsa", "structure", "array", "linked", "algorithm"]),
]
STRUCTURE_WORDS = ["array", "linked list", "stack", "queue", "tree", "graph", "pointer", "node", "dsa", "algorithm"]
STRUCTURE_HINTS = ["dsa", "structure", "algo", "computer"]
MISMATCH_SUBJECT = "Data Structures & Algorithms"
MISMATCH_CHAPTER = "Linear & Non-Linear Data Structures"
TYPE_PREFIXES = {
    "subject": ("Subject", "Subject: "),
    "chapter": ("Chapter", "Chapter: "),
    "topic": ("Topic", "Topic: "),
    "question": ("Question", "Question: "),
    "reference_answer": ("ReferenceAnswer", "Reference Answer: "),
    "rubric": ("Rubric", "Rubric for Question: "),
}


def _any_word(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def narrow_by_intent(hits: DataFrame, filters=INTENT_FILTERS) -> DataFrame:
    """Keep documents that fit the query's domain, unless none of them does.

    ``hits``: query_id, query_text, document_id, document_type, content, score.
    ``filters`` is a parameter: (query words, content words), the first match applies.
    """
    q, c = F.lower("query_text"), F.lower("content")
    wanted = F.lit(None).cast("boolean")
    for query_words, content_words in reversed(filters):
        wanted = F.when(_any_word(q, query_words), _any_word(c, content_words)).otherwise(wanted)
    staged = hits.withColumn("_fits", wanted)
    some = F.max(F.coalesce("_fits", F.lit(False))).over(Window.partitionBy("query_id"))
    return staged.withColumn("_some", some).filter(F.col("_fits").isNull() | F.col("_fits") | ~F.col("_some")).drop("_fits", "_some")


def first_per_type(hits: DataFrame) -> DataFrame:
    """The best document of each type per query, one column per type."""
    rank = F.row_number().over(Window.partitionBy("query_id", "document_type").orderBy(F.col("score").desc(), "document_id"))
    top = hits.withColumn("_r", rank).filter("_r = 1")
    return top.groupBy("query_id").agg(
        *[F.coalesce(F.max(F.when(F.col("document_type") == t, F.col("content"))), F.lit("")).alias(n) for n, (t, _) in TYPE_PREFIXES.items()]
    )


def rubric_titles(hits: DataFrame) -> DataFrame:
    """Rubrics of a query, once per title, best first (one row each)."""
    once = hits.filter("document_type = 'Rubric'").groupBy("query_id", F.col("content").alias("title")).agg(F.max("score").alias("score"))
    return once


def curriculum_context(hits: DataFrame, hints: DataFrame) -> DataFrame:
    """Curriculum context per question, replaced where the subject hint contradicts it.

    ``hints``: query_id, query_text, subject_hint. Questions without hits take their
    hint as subject.
    """
    best = hits.groupBy("query_id").agg(F.max("score").alias("retrieval_score"))
    typed = first_per_type(narrow_by_intent(hits))
    bare = [F.regexp_replace(n, "^" + prefix, "").alias(n) for n, (_, prefix) in TYPE_PREFIXES.items()]
    joined = hints.join(best, "query_id", "left").join(typed.select("query_id", *bare), "query_id", "left")
    hint, asked = F.lower("subject_hint"), F.lower("query_text")
    given = F.coalesce("subject_hint", F.lit("")) != ""
    science = F.contains(F.lower(F.coalesce("subject", F.lit(""))), F.lit("science"))
    mismatch = F.when(given, _any_word(hint, STRUCTURE_HINTS) & science).otherwise(_any_word(asked, STRUCTURE_WORDS) & science)
    none = F.col("retrieval_score").isNull()
    blank = F.trim(F.coalesce("query_text", F.lit(""))) == ""
    clean = F.when(given & (hint != "general"), F.col("subject_hint")).otherwise(MISMATCH_SUBJECT)

    def pick(name: str, mismatched: Column, unfound: Column) -> Column:
        return (
            F.when(blank, "").when(none, F.when(given, unfound).otherwise("")).when(mismatch, mismatched).otherwise(F.coalesce(F.col(name), F.lit("")))
        ).alias(name)

    empty = F.lit("")
    return joined.select(
        "query_id",
        pick("subject", clean, F.col("subject_hint")),
        pick("chapter", F.lit(MISMATCH_CHAPTER), F.concat("subject_hint", F.lit(" Core"))),
        pick("topic", F.lit(MISMATCH_SUBJECT), F.col("subject_hint")),
        pick("reference_answer", empty, empty),
        pick("rubric", empty, empty),
        F.when(blank, 0.0).otherwise(F.coalesce("retrieval_score", F.lit(0.0))).alias("retrieval_score"),
    )
