"""From segmented answers to question and submission evaluations, and value-point grading.

Each function is one lineage of the operators in this package. The three points where
results are worth keeping (answers, question evaluations, submission evaluations) are
its inputs and outputs, so a job can write and re-read a table at each of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marklake.functions import text as TX
from marklake.functions.numeric import fmt_float, percent, rounded
from marklake.operators import autonomous as AU
from marklake.operators import confidence as C
from marklake.operators import contamination as CT
from marklake.operators import evidence as E
from marklake.operators import feedback as FB
from marklake.operators import learning as L
from marklake.operators import marks as M

ANSWER = ["submission_id", "label", "question_order", "answer_text", "question_text", "ocr_confidence"]


def _with_question_id(questions: DataFrame) -> DataFrame:
    return questions.withColumn("question_id", F.concat_ws("|", F.col("exam_id").cast("string"), "question_key"))


def _finish(scored: DataFrame, discrepancies: Column) -> DataFrame:
    """Explanation, bias and confidence of scored answers."""
    explained = AU.explain(scored)
    bias = TX.bias_scan(F.col("answer_text"), F.col("criteria_feedback"))
    staged = TX.bind_columns(explained, bias_score=bias["bias_score"], bias_free=bias["verified_bias_free"], n_discrepancies=discrepancies)
    parts = C.question_confidence(
        F.col("ocr_confidence"), F.coalesce("concept_coverage", F.lit(0.0)), F.col("semantic_alignment"), F.col("explainability"),
        F.col("bias_score"), F.col("n_discrepancies"),
    )
    breakdown = F.struct(*[c.alias(n) for n, c in parts.items()])
    staged = TX.bind_columns(staged, confidence_breakdown=breakdown)
    return staged.withColumn("confidence", F.col("confidence_breakdown.overall_confidence"))


def evaluate_with_key(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Rubric scoring against an answer key: one row per answered question.

    ``answers``: submission_id, exam_id, label, question_order, answer_text,
    ocr_confidence. ``questions``: exam_id, question_key, position, question_text,
    answer_key. Answers of exams without questions are left out.
    """
    resolved = E.resolve_questions(answers, questions).filter("question_key IS NOT NULL")
    keyed = _with_question_id(resolved).drop("question_key", "exam_id")
    rubrics = AU.generate_rubrics(_with_question_id(questions)).select("question_id", "question_text", "max_score", "criteria")
    scored = AU.score_with_rubric(keyed, rubrics, ANSWER)
    met = F.filter("rubric_points", lambda p: p["met"])
    unmet = F.filter("rubric_points", lambda p: ~p["met"])
    heads = lambda points: F.transform(points, lambda p: p["description"])
    details = F.transform(
        "rubric_points",
        lambda p: F.concat(p["criterion_id"], F.lit("("), fmt_float(p["marks_awarded"]), F.lit("/"), fmt_float(p["allocated_marks"]), F.lit(")")),
    )
    expected = TX.expected_concepts(F.col("question_text"), F.col("domain"))
    staged = TX.bind_columns(
        scored,
        domain=TX.infer_domain(F.col("question_text"), F.lit("")),
        terms=TX.keywords(TX.sanitize(F.col("answer_text"))),
        matched_keywords=heads(met),
        missing_concepts=heads(unmet),
        criteria_feedback=F.concat(F.lit("Criteria details: "), F.array_join(details, ", "), F.lit(".")),
    )
    staged = TX.bind_columns(staged, expected=expected)
    aligned = F.when(F.size("expected") > 0, TX.lexical_alignment(F.col("expected"), F.col("terms"))).otherwise(0.5)
    awarded = F.transform("rubric_points", lambda p: p["marks_awarded"])
    checks = C.marking_check(F.col("score_awarded"), F.col("max_marks"), awarded)
    answer_bias = TX.bias_scan(F.col("answer_text"), F.lit(""))
    staged = TX.bind_columns(
        staged,
        semantic_alignment=aligned,
        concept_coverage=percent(F.size("matched_keywords"), F.size("rubric_points")),
        confidence=answer_bias["bias_score"],
        n_issues=F.size(checks["issues"]),
    )
    return _finish(staged, F.col("n_issues")).withColumn("evaluation_mode", F.lit("ANSWER_KEY")).drop("domain", "terms", "expected", "n_issues")


def evaluate_autonomously(answers: DataFrame, questions: DataFrame, exams: DataFrame) -> DataFrame:
    """Scoring without a key; OR questions are read as the alternative the answer fits.

    ``questions`` come from ``parse_questions`` (exam_id, question_key, position,
    question_text, marks, alternatives); ``exams``: exam_id, subject, exam_total_marks.
    An exam without questions gets one synthetic question per label.
    """
    counts = answers.groupBy("submission_id").agg(F.count(F.lit(1)).alias("_n"))
    resolved = E.resolve_questions(answers, questions).join(exams.select("exam_id", "subject", "exam_total_marks"), "exam_id").join(counts, "submission_id")
    details = questions.select("exam_id", "question_key", "question_text", "marks", "alternatives")
    joined = resolved.join(details, ["exam_id", "question_key"], "left")
    synthetic = F.concat(F.lit("Evaluate student answer for "), F.col("subject"), F.lit(" ("), F.col("label"), F.lit(")"))
    none = F.array().cast("array<struct<label:string,text:string>>")
    staged = joined.withColumn("max_marks", F.coalesce("marks", F.col("exam_total_marks") / F.col("_n"))).withColumn(
        "question_text", F.coalesce("question_text", synthetic)
    )
    staged = staged.withColumn("alternatives", F.coalesce("alternatives", none)).withColumn("question_key", F.coalesce("question_key", F.col("label")))
    chosen = AU.choose_alternatives(staged).withColumn("question_text", F.trim("resolved_text"))
    wanted = [*ANSWER, "subject", "max_marks", "chosen_label"]
    scored = AU.score_autonomously(chosen.select(*wanted))
    return _finish(scored, F.lit(0)).withColumn("evaluation_mode", F.lit("AI_AUTONOMOUS")).drop("sanitized", "domain", "expected", "terms")


def submission_evaluations(questions: DataFrame) -> DataFrame:
    """Totals, confidence, status, fairness and feedback per submission."""
    key = ["submission_id"]
    q = questions.withColumn("question_number", F.replace("label", F.lit("question_"), F.lit("")))
    sums = q.groupBy(*key).agg(
        F.sum("score_awarded").alias("total_score"),
        F.sum("max_marks").alias("max_possible"),
        F.avg("confidence").alias("_conf"),
        F.max("ocr_confidence").alias("_ocr"),
        F.sum("n_discrepancies").alias("_issues"),
        F.min("bias_score").alias("fairness_score"),
        F.bool_and("bias_free").alias("fairness_verified"),
        F.avg(F.coalesce("concept_coverage", F.lit(0.0))).alias("_cov"),
        F.max("evaluation_mode").alias("evaluation_mode"),
    )
    totals = rounded(sums, total_score=2)
    totals = totals.withColumn("confidence_score", C.overall_confidence(F.col("_ocr"), F.col("_conf"), F.col("_issues")))
    totals = rounded(totals.withColumn("concept_coverage", F.when(F.col("evaluation_mode") == "AI_AUTONOMOUS", F.col("_cov"))), concept_coverage=2)
    totals = totals.withColumn("status", C.completion_status(F.col("confidence_score"))).drop("_conf", "_ocr", "_issues", "_cov")
    told = FB.submission_feedback(q, totals, key)
    auto = FB.autonomous_feedback(told.select(*key, "total_score", "max_possible", "strengths"), q, key).select(
        *key, F.col("strengths").alias("_s"), F.col("summary").alias("_t")
    )
    both = told.join(auto, key)
    is_auto = F.col("evaluation_mode") == "AI_AUTONOMOUS"
    return (
        both.withColumn("strengths", F.when(is_auto, F.col("_s")).otherwise(F.col("strengths")))
        .withColumn("summary", F.when(is_auto, F.col("_t")).otherwise(F.col("summary")))
        .drop("_s", "_t")
    )


def submission_analytics(questions: DataFrame, semantic: bool = False) -> DataFrame:
    """Learning analytics of evaluated questions; without context all fall in the default topic."""
    none = TX.no_strings()
    q = questions
    defaults = {"topic_context": F.lit(None).cast("string"), "has_semantic": F.lit(semantic), "matched_semantic": none, "missing_semantic": none}
    for name, value in defaults.items():
        if name not in q.columns:
            q = q.withColumn(name, value)
    return L.analyze(q, ["submission_id"], "question_order")


def with_curriculum(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """C15 in the lineage: each evaluated question takes the topic and chapter that retrieval found for its text.

    ``contexts``: question_text, topic, chapter, retrieval_score, one row per text. A question without context, or whose
    context names no topic, stays in the default one.
    """
    found = contexts.select("question_text", F.nullif("topic", F.lit("")).alias("topic_context"), F.nullif("chapter", F.lit("")).alias("chapter_context"), "retrieval_score")
    return questions.join(found, "question_text", "left")


def cross_check(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """C11 in the lineage: two evaluations of the same answered questions, and whether a human has to look at them."""
    keys = ["submission_id", "label"]
    other = secondary.select(
        *keys, F.col("score_awarded").alias("score"), F.col("confidence").alias("secondary_confidence"), F.col("missing_concepts").alias("secondary_missing")
    )
    return C.verify(primary.select(*keys, "score_awarded", "confidence", "missing_concepts"), other, keys)


def grade_by_value_points(regions: DataFrame, schemes: DataFrame, paper: DataFrame | None = None) -> DataFrame:
    """Deterministic grading of regions: outcome, total and maximum per region.

    ``regions`` come from ``segment_scripts`` (with text); only routable regions that a
    scheme covers are matched and scored. ``paper`` holds the printed questions
    (question_number, question_text, part_header, instruction): scored questions whose
    scheme entry does not fit them are flagged, none where no paper was read.
    """
    marked = regions.withColumn("has_flags", F.col("contains_struck_out"))
    heads = schemes.select("question_number", F.col("question_id").cast("string").alias("question_id"), "max_marks")
    outcomes = M.region_outcomes(marked, heads).withColumn("answer_id", F.xxhash64("script_id", "region_no"))
    answers = outcomes.filter("outcome = 'scored'").select("answer_id", "question_id", F.col("text").alias("answer_text"))
    totals = M.score_answers(answers, E.scheme_rows(schemes), E.text_evidence(answers, schemes)).select("answer_id", "total", "uncalibrated")
    out = outcomes.join(totals, "answer_id", "left")
    if paper is None:
        out = out.withColumn("flagged", F.lit(False))
    else:
        wrong = scheme_checks(schemes, paper).filter("flagged").select("question_number", F.lit(True).alias("flagged"))
        out = out.join(wrong, "question_number", "left").withColumn("flagged", F.coalesce("flagged", F.lit(False)))
    return out.select(
        "script_id", "region_no", "question_number", "status", "outcome", "reason", "total", "max_marks", "uncalibrated", "flagged", "first_page", "last_page", "has_flags"
    )


def scheme_checks(schemes: DataFrame, paper: DataFrame) -> DataFrame:
    """C10 for a scheme in its document form: one row per scheme question, variants counted as its words too."""
    texts = F.flatten(F.transform("value_points", lambda p: F.concat(F.array(p["text"]), F.coalesce(p["acceptable_variants"], TX.no_strings()))))
    entries = schemes.select("question_number", "question_text", texts.alias("value_texts"), "max_marks")
    return CT.check_scheme_against_paper(entries, paper, ["question_number"])


def coverage_notes(outcomes: DataFrame, pages: DataFrame, checks: DataFrame | None = None, low: float = 0.7) -> DataFrame:
    """What was not marked, or not safely, as rows (script_id, note, detail); a run over many scripts has one set each.

    ``outcomes`` come from ``grade_by_value_points``; ``pages``: script_id, page_number, confidence, error (null where the
    page was transcribed). ``checks`` are those of the scheme against the paper, null where no paper was read. Notes about
    the scheme as a whole have no script.
    """
    on = F.concat(F.lit("Q"), F.coalesce("question_number", F.lit("?")), F.lit(" on page(s) "), F.concat_ws(" to ", F.col("first_page").cast("string"), F.when(F.col("last_page") > F.col("first_page"), F.col("last_page").cast("string"))))
    note = lambda df, name, detail: df.select("script_id", F.lit(name).alias("note"), detail.alias("detail"))
    routed, page = outcomes.filter("outcome = 'routed'"), F.concat(F.lit("page "), F.col("page_number").cast("string"), F.lit(": "))
    parts = [
        note(pages.filter("error IS NOT NULL"), "page not transcribed", F.concat(page, "error")),
        note(routed, "routed to a human, not marked", F.concat(on, F.lit(": "), "reason")),
        note(outcomes.filter("outcome = 'no_scheme'"), "no entry in the scheme: not scored, and not scored as zero", F.concat(F.lit("Q"), "question_number")),
        note(routed.filter("has_flags"), "non-text or struck-out content", on),
        note(pages.filter(F.col("error").isNull() & (F.col("confidence") < low)), "low self-reported legibility", F.concat(page, F.format_number("confidence", 2))),
    ]
    if checks is None:
        parts.append(note(outcomes.select("script_id").distinct(), "the paper could not be checked against the scheme", F.lit("paper not read")))
    else:
        wrong = checks.filter("flagged").withColumn("script_id", F.lit(None).cast(dict(outcomes.dtypes)["script_id"]))
        parts.append(note(wrong, "scheme entry does not match the paper: its marks are not defensible", F.concat(F.lit("Q"), "question_number")))
    return reduce(DataFrame.unionByName, parts)
