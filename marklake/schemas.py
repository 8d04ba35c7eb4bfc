"""Declared schemas of the stored documents, and the invariants checked on read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, D, L, I, B = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.BooleanType()


def struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def array(t) -> T.ArrayType:
    return T.ArrayType(t)


STATUSES = ("UPLOADED", "PROCESSING", "OCR_COMPLETE", "EVALUATING", "COMPLETED", "FAILED")

EXAM = struct(
    id=S, teacher_id=S, title=S, subject=S, total_marks=I, question_paper_url=S, answer_key_url=S,
    evaluation_mode=S, status=S, results_published=B, published_at=T.TimestampType(),
    created_at=T.TimestampType(), updated_at=T.TimestampType(),
)
SUBMISSION = struct(
    id=S, exam_id=S, student_name=S, student_roll_number=S, answer_sheet_path=S, ocr_output_path=S,
    evaluation_output_path=S, report_path=S, status=S, ocr_status=S, evaluation_status=S,
    obtained_marks=D, total_marks=D, ocr_confidence=D, evaluation_confidence=D, error_message=S,
    created_at=T.TimestampType(), updated_at=T.TimestampType(),
)
AUDIT_LOG = struct(id=S, user_id=S, action=S, ip_address=S, timestamp=T.TimestampType())

OCR_LINE = struct(text=S, confidence=D, bounding_box=array(array(D)))
OCR_OUTPUT = struct(submission_id=S, confidence=D, text=S, lines=array(OCR_LINE))

TRANSCRIPT_LINE = struct(text=S, confidence=D, bbox=array(D), script=S, struck_through=B)
TRANSCRIPTION = struct(
    page_number=I, page_confidence=D, provider=S, model_id=S, prompt_version=S, page_sha256=S,
    extraction_sha256=S, rasterize_version=S, raw_response_sha256=S, warnings=array(S), lines=array(TRANSCRIPT_LINE),
)

VALUE_POINT = struct(
    id=S, text=S, marks=D, acceptable_variants=array(S), match_mode=S, group_id=S, group_rule=S,
    group_n=I, expected_value=D, tolerance=D, unit=S,
)
SCHEME_QUESTION = struct(id=S, question_number=S, question_text=S, max_marks=D, value_points=array(VALUE_POINT))
SCHEME = struct(questions=array(SCHEME_QUESTION))

RUBRIC_POINT = struct(criterion_id=S, description=S, allocated_marks=D, marks_awarded=D, met=B)
EVIDENCE_ITEM = struct(concept=S, matched_text=S, confidence=D)
EXPLAINABILITY = struct(
    coverage_percentage=D, evidence=array(EVIDENCE_ITEM), reasoning=array(S), missing_reasoning=array(S)
)
SEMANTIC = struct(
    semantic_similarity=D, semantic_confidence=D, matched_semantic_concepts=array(S),
    missing_semantic_concepts=array(S), explanation=S,
)
CURRICULUM = struct(
    subject=S, chapter=S, topic=S, reference_answer=S, rubric=S, rubric_criteria=array(S), retrieval_score=D
)
CONFIDENCE = struct(
    overall_confidence=D, ocr_confidence=D, concept_coverage_score=D, semantic_alignment_score=D,
    explainability_score=D, fairness_score=D,
)
VERIFICATION = struct(
    status=S, score_difference=D, confidence_difference=D, root_cause=S, review_required=B, reason=S
)
SECONDARY = struct(score=D, confidence=D, matched_concepts=array(S), missing_concepts=array(S), reasoning=S, model=S)
QUESTION_EVALUATION = struct(
    question_number=S, max_marks=D, score_awarded=D, student_answer_extracted=S, criteria_feedback=S,
    matched_keywords=array(S), rubric_points=array(RUBRIC_POINT), confidence=D, concept_coverage=D,
    missing_concepts=array(S), evaluation_mode=S, difficulty=S, expected_depth=S, explainability=EXPLAINABILITY,
    confidence_breakdown=CONFIDENCE, verification=VERIFICATION, semantic_evaluation=SEMANTIC, curriculum_context=CURRICULUM,
)
LEARNING = struct(
    mastered_topics=array(S), weak_topics=array(S),
    knowledge_gaps=array(struct(topic=S, missing_concepts=array(S), severity=S)),
    recommendations=array(S), overall_mastery=D,
)
SUBMISSION_EVALUATION = struct(
    submission_id=S, total_score=D, max_possible=D, status=S, confidence_score=D, evaluation_mode=S,
    concept_coverage=D, questions=array(QUESTION_EVALUATION), fairness_verified=B, fairness_score=D,
    strengths=array(S), weaknesses=array(S), improvements=array(S), study_recommendations=array(S), summary=S,
    learning_analytics=LEARNING,
)
OBSERVATION = struct(
    script_id=S, question_number=S, max_marks=D, human_mark=D, engine_mark_A=D, engine_mark_B=D, subject=S,
    question_type=S, second_human_mark=D, ocr_confidence=D,
)


def require(df: DataFrame, rule: Column, message: str | Column) -> DataFrame:
    """Fail the job on the first row that breaks a rule; the rows pass through unchanged.

    The check sits in a filter on the row itself, so the optimizer cannot prune it
    away with an unused column.
    """
    message = message if isinstance(message, Column) else F.lit(message)
    broken = F.raise_error(message).cast("boolean")
    return df.filter(F.when(F.coalesce(rule, F.lit(False)), F.lit(True)).otherwise(broken))


def checked_submissions(df: DataFrame) -> DataFrame:
    rule = F.col("status").isin(*STATUSES)
    return require(df, rule, F.concat(F.lit("unknown submission status "), F.coalesce("status", F.lit("NULL"))))


def checked_value_points(vps: DataFrame) -> DataFrame:
    """Scheme invariants: marks, group rule and N, maximum marks."""
    vps = require(vps, F.col("marks") >= 0, F.concat("value_point_id", F.lit(": marks cannot be negative")))
    vps = require(
        vps,
        (F.coalesce("group_rule", F.lit("")) != "ANY_N") | (F.coalesce("group_n", F.lit(0)) > 0),
        F.concat("value_point_id", F.lit(": ANY_N group requires group_n")),
    )
    vps = require(
        vps,
        F.col("group_id").isNull() | (F.col("group_id") == "") | F.col("group_rule").isNotNull(),
        F.concat("value_point_id", F.lit(": group_id set without group_rule")),
    )
    return require(vps, F.col("max_marks") > 0, F.concat("question_id", F.lit(": max_marks must be positive")))


def checked_evidence(evidence: DataFrame) -> DataFrame:
    """A match must point at text, and its span must be ordered."""
    spanned = ~F.col("matched") | F.col("span_start").isNotNull()
    ordered = F.col("span_start").isNull() | ((F.col("span_start") >= 0) & (F.col("span_end") >= F.col("span_start")))
    evidence = require(evidence, spanned, F.concat("value_point_id", F.lit(": matched without an evidence span")))
    return require(evidence, ordered, F.concat("value_point_id", F.lit(": invalid evidence span")))


def checked_curriculum(df: DataFrame, required: list[str], positive: list[str] = ()) -> DataFrame:
    """Ids and names non-blank after trim, marks above zero."""
    for name in required:
        df = require(df, F.trim(F.col(name)) != "", f"{name} cannot be empty or whitespace")
    for name in positive:
        df = require(df, F.col(name) > 0, f"{name} must be greater than zero")
    return df
