"""Evidence for value points in answers (H8-H12, C4, A4 shape, H36 probes).

Schemes arrive in their document form, one row per question with its value points
as an array, so an answer's text goes to a task once for all its value points.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marklake.functions import text as TX
from marklake.functions.matching import some_rows
from marklake.functions.numeric import round_even
from marklake.functions.phrases import fold_all, folded_phrase, scheme
from marklake.functions.text import let
from marklake.operators import marks as M
from marklake.schemas import require
from marklake.functions.scan import null_safe_join
from marklake.session import checkpointed

SEMANTIC_THRESHOLD = 0.68

_EVIDENCE = T.StructType(
    [
        T.StructField("answer_id", T.LongType()),
        T.StructField("question_id", T.StringType()),
        T.StructField("value_point_id", T.StringType()),
        T.StructField("matched", T.BooleanType()),
        T.StructField("span_start", T.IntegerType()),
        T.StructField("span_end", T.IntegerType()),
        T.StructField("method", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("uncalibrated", T.BooleanType()),
        T.StructField("reason", T.StringType()),
    ]
)
_ARROW = pa.schema(
    [
        ("answer_id", pa.int64()), ("question_id", pa.string()), ("value_point_id", pa.string()), ("matched", pa.bool_()),
        ("span_start", pa.int32()), ("span_end", pa.int32()), ("method", pa.string()), ("score", pa.float64()),
        ("uncalibrated", pa.bool_()), ("reason", pa.string()),
    ]
)


ERROR = "ERROR"


def _matched(guarded: bool):
    def one(text: str, folded: str, source: np.ndarray, points: str, numbers: list[dict]) -> Iterator[tuple]:
        ready = scheme(points)
        for p, (span, reason) in zip(ready.points, ready.answered(text, folded, source)):
            yield p["id"], span is not None, *(span or (None, None)), p["match_mode"], 1.0 if span else 0.0, False, reason
        for n in numbers:
            span = next(((s["start"], s["end"]) for s in n["spans"] if not n["unit"] or _holds(s["behind"], n["unit"])), None)
            yield n["id"], span is not None, *(span or (None, None)), "NUMERIC", 1.0 if span else 0.0, False, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("answer_id", "question_id", "answer_text", "points", "numbers")
        for ids, questions, texts, points, spans in (some for batch in batches for some in some_rows(*map(batch.column, names))):
            rows: list[tuple] = []
            texts, points = texts.to_pylist(), points.dictionary_encode()
            which, schemes = points.indices.to_pylist(), points.dictionary.to_pylist()
            keys = zip(ids.to_pylist(), questions.to_pylist())
            for key, text, (folded, source), k, numbers in zip(keys, texts, fold_all(texts), which, spans.to_pylist()):
                try:
                    rows += [(*key, *row) for row in one(text, folded, source, schemes[k], numbers or [])]
                except Exception as error:
                    if not guarded:
                        raise
                    rows.append((*key, None, False, None, None, ERROR, 0.0, False, f"{type(error).__name__}: {error}"[:500]))
            columns = zip(*rows) if rows else ([] for _ in _ARROW)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

    return run


@lru_cache(maxsize=65536)
def _holds(text: str, unit: str) -> bool:
    """A unit stands in the few characters behind a number, whatever its case, accents and spacing."""
    held, wanted = folded_phrase(text), folded_phrase(unit)
    return bool(wanted) and (wanted in held or wanted.replace(" ", "") in held.replace(" ", ""))


@lru_cache(maxsize=1)
def _other_digits() -> tuple[str, str]:
    """Decimal digits of other scripts, and the digits that they are."""
    found = [c for c in map(chr, range(128, 0x20000)) if c.isdecimal()]
    return "".join(found), "".join(str(int(c)) for c in found)


_NUMBER, _BEHIND = r"(-?\d+(?:\.\d+)?)", r"(?=((?s:.{0,12})))"


def near_numbers(text: Column, point: Column) -> Column:
    """Spans of the numbers within tolerance, in order, each with the 12 characters behind it: (start, end, behind).

    A value point "x = 5" wants that subject's value; the subject has no left boundary, so "2x = 5" satisfies "x". Where
    no unit is wanted the first span is enough.
    """
    subject = F.when(F.contains(point["text"], F.lit("=")), TX.strip(F.substring_index(point["text"], "=", 1)))
    quoted = F.concat(F.lit(r"\Q"), F.replace(subject, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    equals = r"[\s\x1c-\x1f]*=[\s\x1c-\x1f]*"
    pattern = F.when(subject != "", F.concat(F.lit("(?iuU)"), quoted, F.lit(equals + _NUMBER + _BEHIND))).otherwise("(?U)" + _NUMBER + _BEHIND)

    def spans(m: Column) -> Column:
        size = F.size(m["whole"])
        near = F.filter(
            F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>")),
            lambda k: F.abs(_number(F.element_at(m["number"], k)) - point["expected_value"]) <= F.coalesce(point["tolerance"], F.lit(0.0)),
        )
        wanted = F.when(F.coalesce(point["unit"], F.lit("")) == "", F.slice(near, 1, 1)).otherwise(near)
        return F.transform(wanted, lambda k: let(_before(m, k), lambda start: F.struct(
            start.alias("start"), (start + F.length(F.element_at(m["whole"], k))).alias("end"), F.element_at(m["behind"], k).alias("behind"),
        )))

    return let(
        F.struct(
            F.regexp_extract_all(text, pattern, F.lit(0)).alias("whole"), F.regexp_extract_all(text, pattern, F.lit(1)).alias("number"),
            F.regexp_extract_all(text, pattern, F.lit(2)).alias("behind"), F.split(text, pattern, -1).alias("between"),
        ),
        spans,
    )


def _number(text: Column) -> Column:
    return F.translate(text, *_other_digits()).try_cast("double")


def _before(m: Column, k: Column) -> Column:
    """Where the k-th match starts: all that stands before it."""
    total = lambda parts: F.aggregate(parts, F.lit(0), lambda n, part: n + F.length(part))
    return total(F.slice(m["between"], F.lit(1), k)) + total(F.slice(m["whole"], F.lit(1), k - 1))


def _checked_points(schemes: DataFrame) -> DataFrame:
    """NUMERIC needs an expected value: stop rather than match something weaker."""
    bad = F.exists("value_points", lambda p: (p["match_mode"] == "NUMERIC") & p["expected_value"].isNull())
    return require(schemes, ~bad, F.concat("question_id", F.lit(": NUMERIC match_mode requires expected_value")))


def text_evidence(answers: DataFrame, schemes: DataFrame, guarded: bool = False) -> DataFrame:
    """Evidence rows for EXACT, STEP and NUMERIC value points: phrases by automata, numbers by expressions.

    ``answers``: answer_id, question_id, answer_text. ``schemes``: question_id,
    value_points. The scheme is a dimension, broadcast by Catalyst when its size
    allows; a question with very many answers is then no heavier than another. ``guarded``:
    an answer that stops matching gives one row of method ERROR with the reason instead.
    """
    mode = lambda p: F.coalesce(p["match_mode"], F.lit("EXACT"))
    worded = F.transform(
        F.filter("value_points", lambda p: ~mode(p).isin("SEMANTIC", "NUMERIC")),
        lambda p: F.struct(p["id"].alias("id"), p["text"].alias("text"), p["acceptable_variants"].alias("acceptable_variants"), mode(p).alias("match_mode")),
    )
    staged = _checked_points(schemes).select(
        F.col("question_id").cast("string").alias("question_id"), F.to_json(worded).alias("points"),
        F.filter("value_points", lambda p: mode(p) == "NUMERIC").alias("numeric"),
    )
    numbers = F.transform("numeric", lambda p: F.struct(p["id"].alias("id"), p["unit"].alias("unit"), near_numbers(F.col("answer_text"), p).alias("spans")))
    work = answers.select(
        F.col("answer_id").cast("bigint").alias("answer_id"), F.col("question_id").cast("string").alias("question_id"),
        F.coalesce("answer_text", F.lit("")).alias("answer_text"),
    ).join(staged, "question_id")
    return work.select("answer_id", "question_id", "answer_text", "points", numbers.alias("numbers")).mapInArrow(_matched(guarded), _EVIDENCE)


def scheme_rows(schemes: DataFrame) -> DataFrame:
    """A4: one row per value point, modes defaulted, in scheme order."""
    q = ["question_id", "question_number", "question_text", "max_marks"]
    p = F.col("p")
    return schemes.select(*q, F.posexplode("value_points").alias("position", "p")).select(
        F.col("question_id").cast("string").alias("question_id"),
        F.col("question_number").cast("string").alias("question_number"),
        "question_text",
        "max_marks",
        "position",
        p["id"].alias("value_point_id"),
        p["text"].alias("text"),
        p["marks"].alias("marks"),
        F.coalesce(p["match_mode"], F.lit("EXACT")).alias("match_mode"),
        p["group_id"].alias("group_id"),
        F.nullif(p["group_rule"], F.lit("")).alias("group_rule"),
        p["group_n"].alias("group_n"),
    )


# --- vectors -------------------------------------------------------------------------------


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


@F.arrow_udf(T.DoubleType())
def cosine(a: pa.Array, b: pa.Array) -> pa.Array:
    """Cosine clipped to [0, 1]; a zero norm gives 0."""
    x, y = _matrix(a), _matrix(b)
    norms = np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1))
    dots = (x * y).sum(axis=1)
    return pa.array(np.clip(np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0), 0.0, 1.0))


def semantic_evidence(sentences: DataFrame, point_vectors: DataFrame, answers: DataFrame) -> DataFrame:
    """The best sentence per semantic value point; always uncalibrated.

    ``sentences``: answer_id, question_id, start, end, embedding. ``point_vectors``:
    question_id, value_point_id, embedding. A value point or sentence without its
    vector stops the job. Each answer meets only the value points of its question.
    """
    points = require(point_vectors, F.col("embedding").isNotNull(), F.concat("value_point_id", F.lit(": SEMANTIC match needs a vector")))
    spoken = require(sentences, F.col("embedding").isNotNull(), "a sentence has no vector")
    s = spoken.select("answer_id", "question_id", "start", "end", F.col("embedding").alias("_s"))
    v = points.select("question_id", "value_point_id", F.col("embedding").alias("_v"))
    scored = s.join(v, "question_id").withColumn("_cos", cosine("_s", "_v"))
    best = scored.groupBy("answer_id", "question_id", "value_point_id").agg(
        F.max("_cos").alias("_score"),
        F.max_by(F.struct("start", "end"), F.struct(F.col("_cos"), (-F.col("start")).alias("first"))).alias("_span"),
    )
    wanted = answers.select("answer_id", "question_id").join(points.select("question_id", "value_point_id"), "question_id")
    joined = wanted.join(best, ["answer_id", "question_id", "value_point_id"], "left")
    score = F.coalesce("_score", F.lit(0.0))
    hit = score >= SEMANTIC_THRESHOLD
    return joined.select(
        "answer_id",
        "question_id",
        "value_point_id",
        hit.alias("matched"),
        F.when(hit, F.col("_span.start")).alias("span_start"),
        F.when(hit, F.col("_span.end")).alias("span_end"),
        F.lit("SEMANTIC").alias("method"),
        round_even(score, 4).alias("score"),
        F.lit(True).alias("uncalibrated"),
        F.lit(None).cast("string").alias("reason"),
    )


CONCEPT_THRESHOLD = 0.70


def concept_similarity(concepts: DataFrame, segments: DataFrame) -> DataFrame:
    """The best segment of the answer per expected concept.

    ``concepts``: answer_id, question_id, position, concept, embedding (of the question
    the answer belongs to); ``segments``: answer_id, embedding.
    """
    c = concepts.select("answer_id", "position", "concept", F.col("embedding").alias("_c"))
    s = segments.select("answer_id", F.col("embedding").alias("_s"))
    return (
        c.join(s, "answer_id", "left")
        .withColumn("_sim", F.when(F.col("_s").isNotNull(), cosine("_c", F.coalesce("_s", "_c"))))
        .groupBy("answer_id", "position", "concept")
        .agg(F.coalesce(F.max("_sim"), F.lit(0.0)).alias("similarity"))
    )


ANSWERS_AT_ONCE = 1024


def _similarities(keys: tuple, answers: pa.Table, concepts: pa.Table) -> pa.Table:
    """Answers of one part with the best of their segments for each concept of their question: one matrix product."""
    concepts = concepts.sort_by([("position", "ascending"), ("concept", "ascending")])
    told = concepts.column("embedding").to_pylist()
    owner, spoken = [], []
    for i, segments in enumerate(answers.column("segments").to_pylist()):
        own = [x for x in segments or () if x is not None]
        owner += [i] * len(own)
        spoken += own
    best = np.zeros((len(answers), len(told)))
    if spoken and told:
        width = len(spoken[0])
        c, x = np.array([t if t is not None else [0.0] * width for t in told], np.float64), np.array(spoken, np.float64)
        unit = lambda m: np.divide(m, n := np.sqrt((m * m).sum(1))[:, None], out=np.zeros_like(m), where=n > 0)
        cos = np.clip(unit(x) @ unit(c).T, 0.0, 1.0)
        owner = np.array(owner)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        best[owner[first]] = np.maximum.reduceat(cos, first)
    ids = pa.array(np.tile(np.arange(len(told)), len(answers)))
    names = [concepts.column(c).combine_chunks().take(ids) for c in ("position", "concept")]
    ends = pa.array(np.arange(len(answers) + 1, dtype=np.int32) * len(told), pa.int32())
    listed = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([*names, pa.array(best.ravel())], names=["position", "concept", "similarity"]))
    return answers.drop_columns(["question_id", "part", "segments"]).append_column("_c", listed)


def semantic_evaluation_by_question(answers: DataFrame, concepts: DataFrame) -> DataFrame:
    """H15 where the concepts belong to the question: as `semantic_evaluation`, without a row per answer and concept.

    ``answers``: answer_id, question_id, answer_text, reference_text, answer_vector, reference_vector, segments (vectors
    of the answer's segments). ``concepts``: question_id, position, concept, embedding. A question's concepts go once to
    each part of its answers; lists of similarities are made where they are read, and not moved.
    """
    told = answers.select("answer_id", "question_id", *_texts(), cosine("answer_vector", "reference_vector").alias("_sim"), "segments")
    told = checkpointed(told)
    parts = told.groupBy("question_id").agg(F.ceil(F.count(F.lit(1)) / ANSWERS_AT_ONCE).alias("parts"))
    part = F.pmod(F.xxhash64("answer_id"), F.col("parts"))
    dealt = null_safe_join(told, parts, ["question_id"], "left").withColumn("part", part).drop("parts")
    each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part")
    wanted = concepts.select("question_id", F.col("position").cast("int").alias("position"), "concept", "embedding").join(parts, "question_id")
    wanted = wanted.select("question_id", each, "position", "concept", "embedding")
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in told.schema if f.name not in ("question_id", "segments"))
    whole = dealt.groupBy("question_id", "part").cogroup(wanted.groupBy("question_id", "part"))
    whole = whole.applyInArrow(_similarities, f"{kept}, _c array<struct<position:int,concept:string,similarity:double>>")
    return _evaluated(whole)


def _texts() -> list[Column]:
    """What H15 reads of the texts."""
    student, reference = F.trim("answer_text"), F.trim("reference_text")
    blank, no_key = F.coalesce(student, F.lit("")) == "", F.coalesce(reference, F.lit("")) == ""
    short = (F.length(student) < 10) | (F.length(reference) < 10)
    return [blank.alias("_blank"), no_key.alias("_no_key"), short.alias("_short")]


def semantic_evaluation(answers: DataFrame, similarities: DataFrame) -> DataFrame:
    """Whole-answer similarity, matched and missing concepts, confidence.

    ``answers``: answer_id, answer_text, reference_text, answer_vector, reference_vector.
    """
    item = F.struct("position", "concept", "similarity")
    listed = similarities.groupBy("answer_id").agg(F.sort_array(F.collect_list(item)).alias("_c"))
    told = answers.select("answer_id", *_texts(), cosine("answer_vector", "reference_vector").alias("_sim"))
    return _evaluated(told.join(listed, "answer_id", "left"))


def _evaluated(whole: DataFrame) -> DataFrame:
    concepts = F.coalesce("_c", F.array().cast("array<struct<position:int,concept:string,similarity:double>>"))

    def names(test) -> Column:
        return F.transform(F.filter(concepts, test), lambda c: c["concept"])

    nothing = F.array().cast("array<string>")
    blank, no_key = F.col("_blank"), F.col("_no_key")
    matched = F.when(blank | no_key, nothing).otherwise(names(lambda c: c["similarity"] >= CONCEPT_THRESHOLD))
    missing = (
        F.when(blank, names(lambda c: F.lit(True))).when(no_key, nothing).otherwise(names(lambda c: c["similarity"] < CONCEPT_THRESHOLD))
    )
    staged = whole.select(
        "answer_id",
        "_blank",
        "_no_key",
        "_short",
        "_sim",
        (F.size(concepts) > 0).alias("_any"),
        matched.alias("matched_semantic_concepts"),
        missing.alias("missing_semantic_concepts"),
    )

    def listing(c: str) -> Column:
        return F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise("None")

    told = F.concat(
        F.lit("Semantic similarity with the reference answer is "), F.format_string("%.2f", round_even(F.col("_sim"), 2)), F.lit("."),
        F.when(
            F.col("_any"),
            F.concat(F.lit(" Matched concepts: "), listing("matched_semantic_concepts"), F.lit(". Missing concepts: "), listing("missing_semantic_concepts"), F.lit(".")),
        ).otherwise(""),
    )
    return staged.select(
        "answer_id",
        F.when(F.col("_blank") | F.col("_no_key"), 0.0).otherwise(round_even(F.col("_sim"), 4)).alias("semantic_similarity"),
        F.when(F.col("_blank"), 1.0).when(F.col("_no_key"), 0.5).when(F.col("_short"), 0.75).otherwise(0.95).alias("semantic_confidence"),
        "matched_semantic_concepts",
        "missing_semantic_concepts",
        F.when(F.col("_blank"), "Student answer is empty or missing. No semantic match found.")
        .when(F.col("_no_key"), "Reference answer is empty. Semantic evaluation cannot be performed.")
        .otherwise(told)
        .alias("explanation"),
    )


# --- answers to questions ---------------------------------------------------------------------


def resolve_questions(answers: DataFrame, questions: DataFrame, synthetic: Column | None = None) -> DataFrame:
    """C4: the question each answer label refers to.

    Keys tried in order: the label, question_ -> q, q -> question_, question_1, the
    exam's first entry. Only the distinct labels of an exam are resolved; answers then
    meet the small result by equality. ``questions``: exam_id, question_key, position.
    ``synthetic`` names the key used by exams that have no question at all.
    """
    label = F.col("label")
    keys = F.array(label, F.replace(label, F.lit("question_"), F.lit("q")), F.replace(label, F.lit("q"), F.lit("question_")), F.lit("question_1"))
    labels = checkpointed(answers.select("exam_id", "label").distinct())
    tried = labels.select("exam_id", "label", F.posexplode(keys).alias("priority", "question_key"))
    hits = (
        tried.join(questions.select("exam_id", "question_key"), ["exam_id", "question_key"])
        .groupBy("exam_id", "label")
        .agg(F.min_by("question_key", "priority").alias("_hit"))
    )
    first = questions.groupBy("exam_id").agg(F.min_by("question_key", "position").alias("_first"))
    resolved = null_safe_join(labels, hits, ["exam_id", "label"], "left").join(first, "exam_id", "left")
    key = F.coalesce("_hit", "_first", *([synthetic] if synthetic is not None else []))
    return null_safe_join(answers, resolved.select("exam_id", "label", key.alias("question_key")), ["exam_id", "label"], "left")


def exam_question_marks(questions: DataFrame, exams: DataFrame) -> DataFrame:
    """Explicit marks when any question of the exam has them, else an even share of the total."""
    shape = questions.groupBy("exam_id").agg(F.count("marks").alias("_given"), F.count(F.lit(1)).alias("_n"))
    joined = questions.join(shape, "exam_id").join(exams.select("exam_id", "exam_total_marks"), "exam_id")
    even = round_even(F.col("exam_total_marks") / F.col("_n"), 2)
    return joined.filter((F.col("_given") == 0) | F.col("marks").isNotNull()).select(
        "exam_id", "question_key", F.when(F.col("_given") > 0, F.col("marks")).otherwise(even).alias("question_marks")
    )


# --- adversarial probes -----------------------------------------------------------------------

# The two probe answers that do not depend on the scheme.
_OFF_TOPIC = (
    "Newton's first law states that an object at rest remains at rest unless acted upon by an external force."
)
_PARAPHRASE = (
    "The candidate has explained the underlying idea correctly in their own words, without reusing any of the "
    "phrasing from the textbook or the marking scheme."
)


def build_probes(schemes: DataFrame) -> DataFrame:
    """Nine probe answers per question: (question_id, kind, answer_text, max_allowed)."""
    terms = F.transform("value_points", lambda p: p["text"])
    joined = F.array_join(terms, ", ")
    correct = F.concat(F.array_join(terms, ". "), F.lit("."))
    damaged = correct
    for clean, seen in (("l", "1"), ("O", "0"), ("S", "5"), ("rn", "m"), (", ", " "), (".", "")):
        damaged = F.replace(damaged, F.lit(clean), F.lit(seen))
    zero = F.lit(0.0)
    probes = [
        ("KEYWORD_SALAD", F.array_join(terms, " "), zero),
        ("NEGATED", F.concat(F.lit("This process does not involve "), joined, F.lit(".")), zero),
        ("QUESTION_COPIED", F.concat("question_text", F.lit(" "), joined, F.lit(".")), zero),
        ("BLANK", F.lit(""), zero),
        ("WHITESPACE_ONLY", F.lit("   \n\t  "), zero),
        ("OFF_TOPIC_SAME_SUBJECT", F.lit(_OFF_TOPIC), zero),
        ("PARAPHRASE_NO_SCHEME_TERMS", F.lit(_PARAPHRASE), zero),
        ("CORRECT_OCR_CORRUPTED", damaged, F.col("max_marks")),
        ("CORRECT_CONTROL", correct, F.col("max_marks")),
    ]
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), a.alias("answer_text"), m.alias("max_allowed")) for k, a, m in probes])
    return schemes.select(F.col("question_id").cast("string").alias("question_id"), F.explode(rows).alias("p")).select("question_id", "p.*")


def run_probes(schemes: DataFrame) -> DataFrame:
    """Probes through matching and marks; the control must score, the others must not exceed."""
    probes = build_probes(schemes).withColumn("answer_id", F.xxhash64("question_id", "kind"))
    marks = M.score_answers(probes, scheme_rows(schemes), text_evidence(probes, schemes))
    scored = probes.join(marks.select("answer_id", "question_id", "total", "max_marks"), ["answer_id", "question_id"])
    passed = F.when(F.col("kind") == "CORRECT_CONTROL", F.col("total") > 0).otherwise(F.col("total") <= F.col("max_allowed") + 1e-9)
    return scored.select("question_id", "kind", F.col("total").alias("scored"), "max_allowed", "max_marks", passed.alias("passed"))
