"""Registered queries: whole grading runs over the transcripts.

Question evaluations are read several times downstream, so they are kept once in the
shared checkpoint folder, where a product run would write its table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from marklake.operators import autonomous as AU
from marklake.operators import evaluate as EV
from marklake.operators import marks as M
from marklake.operators import retrieval as R
from marklake.operators import segment as S
from marklake.plans import evidence_queries as EQ
from marklake.plans import views as V
from marklake.plans.common import Catalog
from marklake.session import checkpointed

query = Catalog()

N_EXAMS = 5


def _answers(spark, d):
    """Answers per label of every script; a script's exam follows from its number."""
    labelled = S.label_answers(V.transcript_lines(spark, d))
    number = F.regexp_extract("question_id", r"question_(\d+)", 1)
    return labelled.select(
        F.col("script_id").alias("submission_id"),
        (F.col("script_id") % N_EXAMS).alias("exam_id"),
        F.col("question_id").alias("label"),
        F.coalesce(F.nullif(number, F.lit("")).cast("bigint"), F.lit(0)).alias("question_order"),
        "answer_text",
        F.lit(0.9).alias("ocr_confidence"),
    )


def _questions(spark, d):
    """Benchmark items as the questions of five exams, numbered in item order."""
    b = V.table(spark, d, "benchmark")
    return b.select(
        (F.col("item_id") % N_EXAMS).alias("exam_id"),
        F.concat(F.lit("question_"), (F.floor(F.col("item_id") / N_EXAMS) + 1).cast("string")).alias("question_key"),
        F.col("item_id").alias("position"),
        F.concat("text", F.lit(" [5 marks]")).alias("question_text"),
        F.col("text").alias("answer_key"),
    )


def _exams(spark, d):
    q = _questions(spark, d).select("exam_id").distinct()
    return q.select("exam_id", F.lit("General").alias("subject"), F.lit(40.0).alias("exam_total_marks"))


@query("graded_with_answer_key")
def graded_with_answer_key(spark, d):
    out = EV.submission_evaluations(checkpointed(EV.evaluate_with_key(_answers(spark, d), _questions(spark, d))))
    return out.select("submission_id", "total_score", "max_possible", "confidence_score", "status", "fairness_score", "fairness_verified", "summary")


@query("graded_autonomously")
def graded_autonomously(spark, d):
    questions = AU.or_alternatives(_questions(spark, d).withColumn("marks", F.lit(5.0)))
    out = EV.submission_evaluations(checkpointed(EV.evaluate_autonomously(_answers(spark, d), questions, _exams(spark, d))))
    return out.select("submission_id", "total_score", "max_possible", "confidence_score", "concept_coverage", "status", "summary")


@query("graded_cross_checked")
def graded_cross_checked(spark, d):
    """The same answers with and without the key."""
    questions = AU.or_alternatives(_questions(spark, d).withColumn("marks", F.lit(5.0)))
    return EV.cross_check(EV.evaluate_with_key(_answers(spark, d), _questions(spark, d)), EV.evaluate_autonomously(_answers(spark, d), questions, _exams(spark, d)))


@query("graded_topics")
def graded_topics(spark, d):
    """Mastery per topic of the curriculum that retrieval finds for each question; a question's vector is that of its item's id."""
    items = V.table(spark, d, "benchmark").select("item_id", F.concat("text", F.lit(" [5 marks]")).alias("question_text"))
    hits, queries = EQ.typed_hits(spark, d, items.select(F.col("item_id").alias("query_id")))
    asked = queries.join(items, queries["query_id"] == items["item_id"])
    hints = asked.select("query_id", F.col("question_text").alias("query_text"), F.when(F.col("item_id") % 2 == 0, "History").otherwise("").alias("subject_hint"))
    found = R.curriculum_context(hits.drop("query_text").join(hints.select("query_id", "query_text"), "query_id"), hints)
    contexts = found.join(items, found["query_id"] == items["item_id"]).select("question_text", "topic", "chapter", "retrieval_score")
    out = EV.with_curriculum(EV.evaluate_with_key(_answers(spark, d), _questions(spark, d)), contexts)
    return out.groupBy("topic_context", "chapter_context").agg(
        F.count(F.lit(1)).alias("n_answers"), F.round(F.sum("score_awarded") / F.sum("max_marks"), 4).alias("mastery")
    )


def _paper(spark, d):
    """The printed paper of the scheme: some questions reworded, some missing."""
    return EQ.schemes(spark, d).select(
        "question_number",
        F.when(F.col("question_number").cast("int") % 4 == 0, F.lit("Describe something else altogether")).otherwise(F.col("question_text")).alias("question_text"),
        F.lit(None).cast("string").alias("part_header"), F.lit(None).cast("string").alias("instruction"),
    ).filter("question_number % 9 <> 0")


@query("graded_by_value_points")
def graded_by_value_points(spark, d):
    rows = EV.grade_by_value_points(S.segment_scripts(V.transcript_lines(spark, d)), EQ.schemes(spark, d), _paper(spark, d))
    return M.grading_coverage(rows)


@query("d31_coverage_notes")
def d31_coverage_notes(spark, d):
    lines = V.transcript_lines(spark, d)
    rows = checkpointed(EV.grade_by_value_points(S.segment_scripts(lines), EQ.schemes(spark, d), _paper(spark, d)))
    pages = lines.groupBy("script_id", "page_number").agg(F.round(F.avg("confidence"), 2).alias("confidence"))
    pages = pages.withColumn("error", F.when(F.col("page_number") % 11 == 10, "the provider gave no text"))
    return EV.coverage_notes(rows, pages, EV.scheme_checks(EQ.schemes(spark, d), _paper(spark, d)))
