"""Totals, confidence and cross-checks of evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marklake.functions.numeric import as_ratio, clamp, fmt_fixed, fmt_float, round_even
from marklake.operators.dashboards import normalize_score

# Signal weights and penalties of the question confidence.
WEIGHTS = {"concept": 0.30, "semantic": 0.25, "explainability": 0.20, "ocr": 0.15, "fairness": 0.10}
DISCREPANCY_PENALTY, MAX_PENALTY = 0.05, 0.25
REVIEW_BELOW = 0.70


def submission_totals(questions: DataFrame) -> DataFrame:
    """D15. The per-question breakdown is ``score_breakdown``, one row per question."""
    score, top = F.sum("score_awarded"), F.sum("max_marks")
    return questions.groupBy("submission_id").agg(
        round_even(score, 2).alias("total_score"),
        round_even(top, 2).alias("max_possible"),
        normalize_score(score, top).alias("normalized_score"),
    )


def score_breakdown(questions: DataFrame) -> DataFrame:
    """The score map as rows (a submission's map is not folded into one value)."""
    return questions.groupBy("submission_id", "question_number").agg(F.sum("score_awarded").alias("score"))


def overall_confidence(ocr: Column, grading: Column, n_discrepancies: Column) -> Column:
    """D16"""
    return round_even(clamp(ocr * 0.4 + grading * 0.6 - n_discrepancies * 0.10), 2)


def completion_status(confidence: Column) -> Column:
    return F.when(confidence >= REVIEW_BELOW, "COMPLETED").otherwise("PENDING_REVIEW")


def submission_confidence(questions: DataFrame) -> DataFrame:
    """D16 from question rows with ocr_confidence and n_discrepancies."""
    value = overall_confidence(F.max("ocr_confidence"), F.avg("confidence"), F.sum("n_discrepancies"))
    return (
        questions.groupBy("submission_id")
        .agg(value.alias("confidence_score"))
        .withColumn("status", completion_status(F.col("confidence_score")))
    )


def submission_fairness(questions: DataFrame) -> DataFrame:
    """D18"""
    return questions.groupBy("submission_id").agg(
        F.least(F.lit(1.0), F.min("bias_score")).alias("fairness_score"),
        F.bool_and("bias_free").alias("fairness_verified"),
        round_even(F.avg(F.coalesce("concept_coverage", F.lit(0.0))), 2).alias("concept_coverage"),
    )


def explainability_signal(result: Column) -> Column:
    """Coverage x mean evidence x (1 - missing penalty); 0.5 when nothing was explained."""
    confidences = F.transform(result["evidence"], lambda e: clamp(e["confidence"]))
    total = F.aggregate(confidences, F.lit(0.0), lambda acc, c: acc + c)
    evidence = F.when(F.size(confidences) > 0, total / F.size(confidences)).otherwise(0.5)
    penalty = F.least(F.size(result["missing_reasoning"]) * 0.05, F.lit(0.50))
    return F.when(result.isNull(), 0.5).otherwise(
        clamp(as_ratio(result["coverage_percentage"]) * evidence * (1.0 - penalty))
    )


def question_confidence(
    ocr: Column, coverage: Column, semantic: Column, explained: Column, fairness: Column, discrepancies: Column
) -> dict[str, Column]:
    """The overall value and its five parts."""
    parts = {
        "concept": as_ratio(coverage),
        "semantic": clamp(semantic),
        "explainability": explainability_signal(explained),
        "ocr": clamp(ocr),
        "fairness": clamp(fairness),
    }
    weighted = None
    for name in ("concept", "semantic", "explainability", "ocr", "fairness"):
        term = parts[name] * WEIGHTS[name]
        weighted = term if weighted is None else weighted + term
    overall = clamp(weighted - F.least(discrepancies * DISCREPANCY_PENALTY, F.lit(MAX_PENALTY)))
    return {
        "overall_confidence": round_even(overall, 4),
        "ocr_confidence": round_even(parts["ocr"], 4),
        "concept_coverage_score": round_even(parts["concept"], 4),
        "semantic_alignment_score": round_even(parts["semantic"], 4),
        "explainability_score": round_even(parts["explainability"], 4),
        "fairness_score": round_even(parts["fairness"], 4),
    }


def _folded(concepts: Column) -> Column:
    return F.transform(F.coalesce(concepts, F.array().cast("array<string>")), lambda c: F.trim(F.lower(c)))


def verify(primary: DataFrame, secondary: DataFrame, keys: list[str]) -> DataFrame:
    """C11: status, cause and reason of the gap between two evaluations of one question."""
    joined = primary.join(secondary, keys)
    score_gap = F.abs(F.col("score_awarded") - F.col("score"))
    conf_gap = F.abs(F.col("confidence") - F.col("secondary_confidence"))
    mine, theirs = _folded(F.col("missing_concepts")), _folded(F.col("secondary_missing"))
    differ = (F.size(F.array_except(mine, theirs)) > 0) | (F.size(F.array_except(theirs, mine)) > 0)
    staged = joined.select(*keys, score_gap.alias("_s"), conf_gap.alias("_c"), differ.alias("_d"))
    s, c = F.col("_s"), F.col("_c")
    status = F.when(s > 2.0, "MAJOR_DISAGREEMENT").when(s > 0.5, "MODERATE_DISAGREEMENT").when(c > 0.30, "LOW_CONFIDENCE").otherwise("PASS")
    st = F.col("status")
    cause = (
        F.when(st == "PASS", "NONE")
        .when(st == "LOW_CONFIDENCE", "CONFIDENCE_INCONSISTENCY")
        .when(F.col("_d"), "MISSING_CONCEPT_DIFFERENCE")
        .otherwise("SEMANTIC_INTERPRETATION")
    )
    reason = (
        F.when(st == "PASS", F.lit("Evaluations are aligned."))
        .when(
            st == "LOW_CONFIDENCE",
            F.concat(F.lit("Confidence gap of "), fmt_fixed(c, 2), F.lit(" detected between primary and secondary engines.")),
        )
        .when(
            st == "MODERATE_DISAGREEMENT",
            F.concat(F.lit("Moderate score difference of "), fmt_fixed(s, 2), F.lit(" marks detected. Likely due to "), F.col("root_cause"), F.lit(".")),
        )
        .otherwise(F.concat(F.lit("Major score difference of "), fmt_fixed(s, 2), F.lit(" marks detected. Immediate review required.")))
    )
    return (
        staged.withColumn("status", status)
        .withColumn("root_cause", cause)
        .select(
            *keys,
            "status",
            round_even(s, 4).alias("score_difference"),
            round_even(c, 4).alias("confidence_difference"),
            "root_cause",
            st.isin("MAJOR_DISAGREEMENT", "LOW_CONFIDENCE").alias("review_required"),
            reason.alias("reason"),
        )
    )


def marking_check(score: Column, max_score: Column, awarded: Column) -> dict[str, Column]:
    """Issues of a score against its maximum and its rubric points."""
    total = F.aggregate(awarded, F.lit(0.0), lambda acc, x: acc + x)
    over = F.when(
        score > max_score,
        F.concat(F.lit("Score awarded ("), fmt_float(score), F.lit(") exceeds maximum allowed marks ("), fmt_float(max_score), F.lit(").")),
    )
    negative = F.when(score < 0, F.concat(F.lit("Score awarded ("), fmt_float(score), F.lit(") is negative.")))
    mismatch = F.when(
        F.abs(score - total) > 0.01,
        F.concat(F.lit("Total score ("), fmt_float(score), F.lit(") does not match the sum of rubric items ("), fmt_float(total), F.lit(").")),
    )
    issues = F.array_compact(F.array(over, negative, mismatch))
    return {
        "verified": F.size(issues) == 0,
        "fairness_score": round_even(F.greatest(F.lit(0.0), 1.0 - F.size(issues) * 0.25), 2),
        "issues": issues,
    }
