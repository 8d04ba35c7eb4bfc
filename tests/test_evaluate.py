from pyspark.sql import functions as F

from marklake.operators import autonomous as AU
from marklake.operators import evaluate as EV
from marklake.operators import segment as S
from marklake.session import checkpointed
from tests_support import QUESTIONS, SCHEMES, SCHEME

LINES = "script_id bigint, page_number bigint, line_idx bigint, text string, confidence double, struck_through boolean"


def answers(spark, rows):
    return spark.createDataFrame(rows, "submission_id bigint, exam_id bigint, label string, question_order bigint, answer_text string, ocr_confidence double")


def test_with_key_end_to_end(spark):
    q = spark.createDataFrame(QUESTIONS, "exam_id bigint, question_key string, position bigint, question_text string, answer_key string")
    rows = [
        (1, 1, "question_1", 1, "Copper conducts electricity well. Copper resists corrosion strongly.", 1.0),
        (1, 1, "q2", 2, "no idea, mail me at a@b.org", 1.0),
        (2, 9, "question_1", 1, "an exam without questions", 1.0),
    ]
    ev = checkpointed(EV.evaluate_with_key(answers(spark, rows), q))
    got = {(r.submission_id, r.label): r for r in ev.collect()}
    assert set(got) == {(1, "question_1"), (1, "q2")}
    full, none = got[(1, "question_1")], got[(1, "q2")]
    assert full.score_awarded == full.max_marks == 4.0 and full.concept_coverage == 100.0
    assert full.criteria_feedback == "Criteria details: crit_1(2.0/2.0), crit_2(2.0/2.0)."
    assert none.score_awarded == 0.0 and none.bias_score == 0.8 and not none.bias_free
    sub = EV.submission_evaluations(ev).first()
    assert (sub.total_score, sub.max_possible, sub.fairness_score, sub.fairness_verified) == (4.0, 9.0, 0.8, False)
    assert sub.evaluation_mode == "ANSWER_KEY" and sub.concept_coverage is None
    assert sub.summary.startswith("Student achieved a score of 4.0/9.0 (44.4%).")
    assert EV.submission_analytics(ev).first().overall_mastery == 0.4444


def test_autonomous_end_to_end(spark):
    q = spark.createDataFrame(
        [(1, "question_1", 0, "Explain photosynthesis OR Explain gravity and mass", 5.0)],
        "exam_id bigint, question_key string, position bigint, question_text string, marks double",
    )
    exams = spark.createDataFrame([(1, "Physics", 10.0), (2, "Physics", 10.0)], "exam_id bigint, subject string, exam_total_marks double")
    rows = [(1, 1, "question_1", 1, "Gravity pulls every mass, explain more", 1.0), (2, 2, "question_7", 7, "force and energy", 1.0)]
    ev = checkpointed(EV.evaluate_autonomously(answers(spark, rows), AU.or_alternatives(q), exams))
    got = {r.submission_id: r for r in ev.collect()}
    assert "gravity" in got[1].matched_keywords and "photosynthesis" not in got[1].missing_concepts
    assert got[2].question_text == "Evaluate student answer for Physics (question_7)" and got[2].max_marks == 10.0
    sub = {r.submission_id: r for r in EV.submission_evaluations(ev).collect()}
    assert sub[1].summary.startswith("Autonomous evaluation awarded") and any("Covered" in s for s in sub[1].strengths)


def test_value_point_flow_has_three_outcomes(spark):
    lines = [
        (1, 0, 0, "1. The metal is mercury", 0.9, False),
        (1, 0, 1, "9. Not in the scheme", 0.9, False),
        (1, 0, 2, "2. coins", 0.9, True),
    ]
    regions = S.segment_scripts(spark.createDataFrame(lines, LINES))
    got = {r.question_number: r for r in EV.grade_by_value_points(regions, spark.createDataFrame(SCHEMES, SCHEME)).collect()}
    # The descending "2" is struck out; the region in front of it shares the doubt about order.
    assert got["1"].outcome == "scored" and got["1"].total == 1.0
    assert got["9"].outcome == "routed" and got["2"].outcome == "routed" and got["2"].total is None


def test_scheme_is_checked_against_the_paper_and_notes_say_what_is_missing(spark):
    lines = [
        (1, 0, 0, "1. The metal is mercury", 0.9, False),
        (1, 0, 1, "2. coins and water pipes", 0.5, False),
        (1, 1, 0, "8. Not in the scheme", 0.5, False),
    ]
    regions = S.segment_scripts(spark.createDataFrame(lines, LINES))
    schemes = spark.createDataFrame(SCHEMES, SCHEME)
    paper = spark.createDataFrame(
        [("1", "Which metal is liquid at room temperature?", None, None), ("2", "Who wrote the national anthem?", None, None)],
        "question_number string, question_text string, part_header string, instruction string",
    )
    rows = EV.grade_by_value_points(regions, schemes, paper)
    got = {r.question_number: r for r in rows.collect()}
    assert not got["1"].flagged and got["2"].flagged and got["2"].total == 3.0 and got["8"].outcome == "no_scheme"
    assert not any(r.flagged for r in EV.grade_by_value_points(regions, schemes).collect())
    pages = spark.createDataFrame([(1, 0, 0.65, None), (1, 1, 0.5, None), (1, 2, None, "timed out")], "script_id bigint, page_number bigint, confidence double, error string")
    notes = {(r.script_id, r.note.split(":")[0], r.detail) for r in EV.coverage_notes(rows, pages, EV.scheme_checks(schemes, paper)).collect()}
    assert (1, "page not transcribed", "page 2: timed out") in notes and (1, "low self-reported legibility", "page 1: 0.50") in notes
    assert (1, "no entry in the scheme", "Q8") in notes and (None, "scheme entry does not match the paper", "Q2") in notes
    assert not any(n == "scheme entry does not match the paper" and d == "Q1" for _, n, d in notes)
    unread = {r.note for r in EV.coverage_notes(rows, pages).collect()}
    assert "the paper could not be checked against the scheme" in unread


def test_context_and_cross_check_in_the_lineage(spark):
    q = spark.createDataFrame(QUESTIONS, "exam_id bigint, question_key string, position bigint, question_text string, answer_key string")
    rows = [(1, 1, "question_1", 1, "Copper conducts electricity well. Copper resists corrosion strongly.", 1.0), (1, 1, "q2", 2, "no idea", 1.0)]
    ev = checkpointed(EV.evaluate_with_key(answers(spark, rows), q))
    contexts = spark.createDataFrame([(QUESTIONS[0][3], "Metals", "Conductors", 0.8)], "question_text string, topic string, chapter string, retrieval_score double")
    told = EV.with_curriculum(ev, contexts)
    assert {r.label: r.topic_context for r in told.collect()} == {"question_1": "Metals", "q2": None}
    topics = EV.submission_analytics(told).first()
    assert "Metals" in str(topics)
    checked = {r.label: r.status for r in EV.cross_check(ev, ev.withColumn("score_awarded", F.when(F.col("label") == "q2", 4.5).otherwise(F.col("score_awarded")))).collect()}
    assert checked == {"question_1": "PASS", "q2": "MAJOR_DISAGREEMENT"}
