"""Student feedback from rubric outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marklake.functions import lexicon as X
from marklake.functions import text as TX
from marklake.functions.numeric import fmt_fixed, fmt_float

NO_STRENGTH = "Attempted all questions and displayed initial understanding of the prompt structures."
NO_WEAKNESS = "No major conceptual gaps identified in the evaluated responses."
NO_IMPROVEMENT = "Continue to practice advanced questions to build upon your current mastery."
DEFAULT_TOPICS = ["Core Concepts From This Exam", "Answer Structure And Explanation", "Question-Specific Terminology"]


def keep_first(items: DataFrame, keys: list[str], item: str, order: str, limit: int) -> DataFrame:
    """First of each text (case and spacing folded), the first n per key.

    Repeats are reduced map-side to their smallest place (a number or a struct). The rank
    then keeps n rows per key and task.
    """
    bound = TX.bind_columns(items, _fold=F.lower(TX.collapse(F.col(item))), _text=F.trim(item))
    once = bound.filter("_fold <> ''").groupBy(*keys, "_fold", "_text").agg(F.min(order).alias("_at"))
    same = F.row_number().over(Window.partitionBy(*keys, "_fold").orderBy("_at", "_text"))
    first = once.withColumn("_same", same).filter("_same = 1")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_at", "_text"))
    return first.withColumn("rank", rank).filter(F.col("rank") <= limit).select(*keys, "rank", F.col("_text").alias(item))


def topic_title(concept: Column) -> Column:
    """Title of a concept; two acronyms stay in capitals."""
    word = lambda w: F.when(w.isin("dna", "co2"), F.upper(w)).otherwise(TX.capitalize(w))
    return F.array_join(F.transform(F.split(concept, " "), word), " ")


def _lookup(concept: Column, table: dict[str, str], default: Column) -> Column:
    return F.coalesce(*[F.when(concept == k, F.lit(v)) for k, v in table.items()], default)


# Fixed topics come before every question.
_FIRST = -(2**63)


def _place(question_order: Column, section: int, i: Column) -> Column:
    """Where an item stands: by question, missing concepts (0) before rubric points (1), then as listed."""
    return F.struct(question_order.cast("bigint").alias("question"), F.lit(section).alias("section"), i.cast("bigint").alias("i"))


def rubric_rows(questions: DataFrame, keys: list[str]) -> DataFrame:
    """One row per rubric point with a usable concept. ``questions``: keys, question_number,
    question_order, rubric_points."""
    p = F.col("p")
    points = questions.select(*keys, "question_number", "question_order", F.posexplode("rubric_points").alias("_i", "p")).select(
        *keys,
        "question_number",
        _place(F.col("question_order"), 1, F.col("_i")).alias("place"),
        p["description"].alias("_d"),
        p["allocated_marks"].alias("allocated_marks"),
        p["marks_awarded"].alias("marks_awarded"),
        p["met"].alias("met"),
    )
    named = TX.bind_columns(points, concept=TX.normalize_concept(F.col("_d"))).drop("_d")
    return TX.bind_columns(named.filter(TX.is_valid_normalized(F.col("concept"))), title=topic_title(F.col("concept")))


# Kind of feedback item -> how many are kept per submission.
LIMITS = {"strengths": 3, "weaknesses": 3, "improvements": 3, "study_recommendations": 4}


def _prefixed(text: Column) -> Column:
    return F.concat(F.lit("Q"), F.col("question_number"), F.lit(": "), text)


def _items(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind, text, place): all feedback a rubric row gives rise to, in one pass."""
    title = F.col("title")
    strong = F.col("met") | (F.col("marks_awarded") >= F.col("allocated_marks") * 0.8)
    weak = ~F.col("met") & (F.col("marks_awarded") < F.col("allocated_marks") * 0.5)
    praise = F.concat(F.lit("Explained "), title, F.lit(" with clear connection to the question."))
    lack = F.concat(F.lit("Needs a clearer explanation of how "), title, F.lit(" works in this answer."))
    revise = _lookup(
        F.col("concept"), X.CONCEPT_INSTRUCTIONS, F.concat(F.lit("Revise "), title, F.lit(" and explain its role using one complete sentence."))
    )

    def item(kind: str, holds: Column, text: Column, place: Column) -> Column:
        return F.when(holds, F.struct(F.lit(kind).alias("kind"), text.alias("text"), place.alias("place")))

    made = F.array_compact(
        F.array(
            item("strengths", strong, _prefixed(praise), F.col("place")),
            item("weaknesses", weak, _prefixed(lack), F.col("place")),
            item("improvements", ~F.col("met"), _prefixed(revise), F.col("place")),
            item("study_recommendations", ~F.col("met"), title, F.col("place")),
        )
    )
    fixed = F.transform(
        F.when(~F.col("met") & (F.col("concept") == "photosynthesis"), TX.strings(X.PHOTOSYNTHESIS_TOPICS)).otherwise(TX.no_strings()),
        lambda t, i: F.struct(F.lit("study_recommendations").alias("kind"), t.alias("text"), _place(F.lit(_FIRST), 0, i).alias("place")),
    )
    return rows.select(*keys, F.explode(F.concat(made, fixed)).alias("_x")).select(*keys, "_x.*")


def _missing_items(questions: DataFrame, keys: list[str]) -> DataFrame:
    """Study topics from the missing concepts of each question."""
    concept = TX.normalize_concept(F.col("_c"))
    rows = questions.select(*keys, "question_order", F.posexplode("missing_concepts").alias("_i", "_c")).select(
        *keys, concept.alias("concept"), _place(F.col("question_order"), 0, F.col("_i")).alias("place")
    )
    rows = rows.filter(TX.is_valid_normalized(F.col("concept")))
    fixed = F.when(F.col("concept") == "photosynthesis", TX.strings(X.PHOTOSYNTHESIS_TOPICS)).otherwise(TX.no_strings())
    own = F.struct(F.lit("study_recommendations").alias("kind"), topic_title(F.col("concept")).alias("text"), F.col("place").alias("place"))
    topics = F.transform(
        fixed, lambda t, i: F.struct(F.lit("study_recommendations").alias("kind"), t.alias("text"), _place(F.lit(_FIRST), 0, i).alias("place"))
    )
    return rows.select(*keys, F.explode(F.concat(F.array(own), topics)).alias("_x")).select(*keys, "_x.*")


def submission_feedback(questions: DataFrame, totals: DataFrame, keys: list[str], limits: dict[str, int] = LIMITS) -> DataFrame:
    """Strengths, weaknesses, improvements, study topics and summary per submission.

    ``totals``: keys, total_score, max_possible. ``questions`` may carry missing_concepts.
    All four lists come from one keep-first pass over (submission, kind). The questions of a key are brought together
    once, before they become texts: no later step moves them.
    """
    questions = questions.repartition(*keys)
    items = _items(rubric_rows(questions, keys), keys)
    if "missing_concepts" in questions.columns:
        items = items.unionByName(_missing_items(questions, keys))
    kept = keep_first(items, [*keys, "kind"], "text", "place", max(limits.values()))

    def gathered(kind: str) -> Column:
        item = F.when((F.col("kind") == kind) & (F.col("rank") <= limits[kind]), F.struct("rank", "text"))
        return F.transform(F.sort_array(F.collect_list(item)), lambda s: s["text"]).alias(kind)

    lists = kept.groupBy(*keys).agg(*[gathered(k) for k in limits])
    out = totals.join(lists, keys, "left")
    defaults = {
        "strengths": [NO_STRENGTH],
        "weaknesses": [NO_WEAKNESS],
        "improvements": [NO_IMPROVEMENT],
        "study_recommendations": DEFAULT_TOPICS,
    }
    filled = {k: F.when(F.size(k) > 0, F.col(k)).otherwise(TX.strings(v)) for k, v in defaults.items()}
    return out.withColumns(filled).withColumn("summary", summary_text())


def summary_text() -> Column:
    total, top = F.col("total_score"), F.col("max_possible")
    pct = F.when(top > 0, total / top * 100).otherwise(0.0)
    strong = F.when(
        ~F.contains(F.get("strengths", F.lit(0)), F.lit("Attempted all questions")),
        F.concat(F.lit("The submission shows strong performance in several areas, especially "), F.array_join("strengths", ", "), F.lit(". ")),
    ).otherwise("The response displays initial familiarity with the subject, but could benefit from broader concept coverage. ")
    weak = F.when(
        ~F.contains(F.get("weaknesses", F.lit(0)), F.lit("No major conceptual gaps")),
        F.concat(F.lit("Next, focus on these areas: "), F.array_join("weaknesses", ", "), F.lit(".")),
    ).otherwise("Excellent job adhering to the grading rubric guidelines!")
    head = F.concat(
        F.lit("Student achieved a score of "), fmt_float(total), F.lit("/"), fmt_float(top), F.lit(" ("), fmt_fixed(pct, 1), F.lit("%). ")
    )
    return F.concat(head, strong, weak)


def autonomous_feedback(base: DataFrame, questions: DataFrame, keys: list[str]) -> DataFrame:
    """H27 in autonomous mode: "Covered ..." strengths follow, four at most; its own summary.

    ``base`` is ``submission_feedback``; ``questions`` also carry matched_keywords and
    concept_coverage.
    """
    concepts = TX.filter_concepts(F.coalesce("matched_keywords", TX.no_strings()))
    covered = (
        questions.withColumn("_k", concepts)
        .filter(F.size("_k") > 0)
        .select(
            *keys,
            F.col("question_order").alias("place"),
            F.concat(F.lit("Q"), F.col("question_number"), F.lit(": Covered "), F.array_join(F.slice("_k", 1, 3), ", "), F.lit(".")).alias("text"),
        )
    )
    first = covered.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("place", "text"))).filter("_r <= 4")
    listed = first.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "text"))), lambda s: s["text"]).alias("_covered"))
    coverage = questions.groupBy(*keys).agg(F.avg(F.coalesce("concept_coverage", F.lit(0.0))).alias("_cov"))
    joined = base.join(listed, keys, "left").join(coverage, keys, "left")
    strengths = F.slice(F.array_distinct(F.concat("strengths", F.coalesce("_covered", TX.no_strings()))), 1, 4)
    summary = F.concat(
        F.lit("Autonomous evaluation awarded "), fmt_float(F.col("total_score")), F.lit("/"), fmt_float(F.col("max_possible")),
        F.lit(". Average concept coverage was "), fmt_fixed(F.col("_cov"), 1), F.lit("%."),
    )
    return joined.withColumn("strengths", strengths).withColumn("summary", summary).drop("_covered", "_cov")


def question_feedback(found: Column, missing: Column, marks: Column, max_marks: Column) -> dict[str, Column]:
    """H27 for one question of the autonomous path (found and missing are filtered concepts)."""
    share = F.when(max_marks != 0, marks / max_marks).otherwise(0.0)
    top = lambda c: F.array_join(F.slice(c, 1, 3), ", ")

    def listing(*options: Column, default: str) -> Column:
        kept = F.array_compact(F.array(*options))
        return F.when(F.size(kept) > 0, F.slice(kept, 1, 3)).otherwise(F.array(F.lit(default)))

    has_found, has_missing = F.size(found) > 0, F.size(missing) > 0
    strengths = listing(
        F.when(has_found, F.concat(F.lit("You explained "), top(found), F.lit(" clearly in relation to the question."))),
        F.when(share >= 0.75, F.lit("The answer shows strong conceptual understanding.")).when(
            share >= 0.4, F.lit("The answer shows partial understanding of the question.")
        ),
        default="The response attempts to address the question.",
    )
    weaknesses = listing(
        F.when(has_missing, F.concat(F.lit("The answer needs clearer explanation of "), top(missing), F.lit("."))),
        default="No major missing concept was detected.",
    )
    instruct = lambda c: _lookup(
        c, X.CONCEPT_INSTRUCTIONS, F.concat(F.lit("Explain the role of "), TX.title_words(c), F.lit(" in the answer, not just the term."))
    )
    advice = F.concat(
        F.transform(F.slice(missing, 1, 3), instruct),
        F.when(share < 0.5, F.array(F.lit("Add clearer explanations and connect ideas directly to the question."))).otherwise(TX.no_strings()),
    )
    improvements = F.when(F.size(advice) > 0, F.slice(advice, 1, 3)).otherwise(
        F.array(F.lit("Continue adding precise terminology and complete reasoning."))
    )
    source = F.when(has_missing, F.slice(missing, 1, 4)).otherwise(F.slice(found, 1, 4))
    topics = F.transform(source, lambda c: _lookup(c, X.STUDY_TOPICS, TX.title_words(c)))
    return {
        "strengths": strengths,
        "weaknesses": weaknesses,
        "improvements": improvements,
        "study_recommendations": F.when(F.size(topics) > 0, topics).otherwise(F.array(F.lit("Core Concepts From This Question"))),
    }
