"""Registered queries for dashboards, lists and predicates, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from marklake.operators import dashboards as D
from marklake.plans import views as V
from marklake.plans.common import Catalog
from marklake.plans.views import r, with_views

query = Catalog()


def _both(spark, d):
    return V.submissions(spark, d), V.exams(spark, d)


_HIST = """count(*) FILTER (WHERE {c} AND p >= 90) AS score_90_100,
 count(*) FILTER (WHERE {c} AND p >= 80 AND p < 90) AS score_80_89,
 count(*) FILTER (WHERE {c} AND p >= 70 AND p < 80) AS score_70_79,
 count(*) FILTER (WHERE {c} AND p >= 60 AND p < 70) AS score_60_69,
 count(*) FILTER (WHERE {b}) AS score_below_60"""
_DASH = _HIST.format(c="status='COMPLETED'", b="status='COMPLETED' AND (p IS NULL OR p < 60)")
_CLASS = _HIST.format(c="status='COMPLETED'", b="status='COMPLETED' AND p < 60")
_COHORT = _HIST.format(c="true", b="p < 60")
_PCT = "CASE WHEN obtained_marks IS NOT NULL AND total_marks > 0 THEN obtained_marks/total_marks*100.0::DOUBLE END AS p"
_MODE = """CASE WHEN coalesce(document_mode, evaluation_mode) IN ('AI_AUTONOMOUS','ANSWER_KEY')
 THEN coalesce(document_mode, evaluation_mode)
 WHEN answer_key_url IS NOT NULL THEN 'ANSWER_KEY' ELSE 'AI_AUTONOMOUS' END AS mode"""
_EXAM = f"""count(submission_id) AS submission_count,
 {r("coalesce(avg(obtained_marks) FILTER (WHERE status='COMPLETED'), 0)")} AS average_score,
 coalesce(max(obtained_marks) FILTER (WHERE status='COMPLETED'), 0) AS top_score,
 coalesce(min(obtained_marks) FILTER (WHERE status='COMPLETED'), 0) AS lowest_score,
 {r("CASE WHEN count(submission_id) > 0 THEN count(*) FILTER (WHERE status='COMPLETED') / count(submission_id)::DOUBLE * 100 ELSE 0 END")} AS completion_rate"""


@query(
    "exam_analytics_with_histogram",
    with_views(
        "exams subs",
        f"""SELECT exam_id, title, {_EXAM}, {_DASH}
 FROM (SELECT e.exam_id, title, s.* EXCLUDE (exam_id), {_PCT} FROM exams e LEFT JOIN subs s ON e.exam_id = s.exam_id)
 GROUP BY exam_id, title""",
    ),
)
def exam_analytics_with_histogram(spark, d):
    subs, exams = _both(spark, d)
    return D.exam_analytics(subs, exams, D.dashboard_histogram())


@query(
    "a1_read_entities",
    with_views(
        "exams subs",
        """SELECT status, count(*) AS n, count(obtained_marks) AS n_marked, min(exam_id) AS first_exam, max(exam_id) AS last_exam
 FROM subs GROUP BY status""",
    ),
)
def a1_read_entities(spark, d):
    from marklake.schemas import checked_submissions

    return (
        checked_submissions(V.submissions(spark, d))
        .groupBy("status")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count("obtained_marks").alias("n_marked"),
            F.min("exam_id").alias("first_exam"),
            F.max("exam_id").alias("last_exam"),
        )
    )


@query("b1_filtered_submissions", with_views("subs", "SELECT submission_id, student_name FROM subs WHERE exam_id = 199705 AND status = 'COMPLETED'"))
def b1_filtered_submissions(spark, d):
    return D.filter_submissions(V.submissions(spark, d), 199705, "COMPLETED").select("submission_id", "student_name")


@query("b2_visible_exams", with_views("exams", "SELECT exam_id, title FROM exams WHERE teacher_id = 2"))
def b2_visible_exams(spark, d):
    return D.visible_exams(V.exams(spark, d), 2).select("exam_id", "title")


@query(
    "b3_student_view",
    with_views(
        "exams subs",
        """SELECT s.submission_id, e.title FROM subs s JOIN exams e ON s.exam_id = e.exam_id
 WHERE e.results_published AND s.student_name ILIKE 'customer#00000_1%'""",
    ),
)
def b3_student_view(spark, d):
    subs, exams = _both(spark, d)
    return D.published_for_student(subs, exams, "customer#00000_1%").select("submission_id", "title")


@query(
    "b4_access_decisions",
    with_views(
        "exams subs",
        """SELECT q.submission_id, q.viewer_role, CASE WHEN s.submission_id IS NULL THEN 'SUBMISSION_NOT_FOUND'
 WHEN e.exam_id IS NULL THEN 'EXAM_NOT_FOUND' WHEN q.viewer_role IN ('TEACHER','ADMIN') THEN 'ALLOW'
 WHEN lower(s.student_name) <> lower(q.viewer_name) THEN 'ACCESS_DENIED'
 WHEN NOT e.results_published THEN 'RESULTS_UNPUBLISHED' ELSE 'ALLOW' END AS access_decision
 FROM (SELECT l_orderkey + CASE WHEN l_tax = 0 THEN 1000000000 ELSE 0 END AS submission_id,
   CASE l_returnflag WHEN 'A' THEN 'TEACHER' WHEN 'R' THEN 'STUDENT' ELSE 'STUDENT' END AS viewer_role,
   CASE WHEN l_linestatus = 'F' THEN upper(c_name) ELSE 'somebody' END AS viewer_name
   FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey) q
 LEFT JOIN subs s ON q.submission_id = s.submission_id LEFT JOIN exams e ON s.exam_id = e.exam_id
   AND e.subject <> 'Maths'""",
    ),
)
def b4_access_decisions(spark, d):
    subs, exams = _both(spark, d)
    li, orders, cust = (V.table(spark, d, t) for t in ("lineitem", "orders", "customer"))
    requests = (
        li.join(orders, li.l_orderkey == orders.o_orderkey)
        .join(cust, orders.o_custkey == cust.c_custkey)
        .select(
            (F.col("l_orderkey") + F.when(F.col("l_tax") == 0, 1000000000).otherwise(0)).alias("submission_id"),
            F.when(F.col("l_returnflag") == "A", "TEACHER").otherwise("STUDENT").alias("viewer_role"),
            F.when(F.col("l_linestatus") == "F", F.upper("c_name")).otherwise("somebody").alias("viewer_name"),
        )
    )
    out = D.access_decision(requests, subs, exams.filter("subject <> 'Maths'"))
    return out.select("submission_id", "viewer_role", "access_decision")


_G = """CASE WHEN {x} = floor({x}) THEN {x}::BIGINT::VARCHAR ELSE regexp_replace(rtrim(format('{{:.4f}}', {x}), '0'), '\\.$', '') END"""


@query(
    "b5_score_text",
    with_views(
        "subs",
        f"""SELECT submission_id, CASE WHEN obtained_marks IS NULL AND t IS NULL THEN 'Not scored'
 WHEN t IS NULL THEN {_G.format(x="obtained_marks")} WHEN obtained_marks IS NULL THEN '0/' || {_G.format(x="t")}
 ELSE {_G.format(x="obtained_marks")} || '/' || {_G.format(x="t")} END AS score_text
 FROM (SELECT submission_id, obtained_marks, CASE WHEN status <> 'FAILED' THEN total_marks END AS t FROM subs)""",
    ),
)
def b5_score_text(spark, d):
    total = F.when(F.col("status") != "FAILED", F.col("total_marks"))
    return V.submissions(spark, d).select("submission_id", D.score_text(F.col("obtained_marks"), total).alias("score_text"))


@query(
    "b6_letter_grades",
    with_views(
        "docs",
        """SELECT grade, count(*) AS n FROM (SELECT CASE WHEN p>=90 THEN 'A+' WHEN p>=80 THEN 'A' WHEN p>=70 THEN 'B'
 WHEN p>=60 THEN 'C' WHEN p>=50 THEN 'D' ELSE 'F' END AS grade FROM (SELECT total_score/max_possible*100.0::DOUBLE AS p FROM docs)) GROUP BY grade""",
    ),
)
def b6_letter_grades(spark, d):
    pct = F.col("total_score") / F.col("max_possible") * 100.0
    return V.evaluation_documents(spark, d).groupBy(D.letter_grade(pct).alias("grade")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "b7_exam_modes",
    with_views(
        "exams",
        """SELECT exam_id, coalesce(evaluation_mode, CASE WHEN answer_key_url IS NOT NULL THEN 'ANSWER_KEY' ELSE 'AI_AUTONOMOUS' END) AS created_mode,
 CASE WHEN exam_id % 2 = 0 AND exam_id % 5 <> 0 THEN CASE WHEN exam_id % 4 = 0 THEN 'ANSWER_KEY' ELSE 'AI_AUTONOMOUS' END
  ELSE coalesce(CASE WHEN exam_id % 5 = 0 THEN 'ANSWER_KEY' END, evaluation_mode) END AS patched_mode FROM exams""",
    ),
)
def b7_exam_modes(spark, d):
    exams = V.exams(spark, d)
    e = F.col("exam_id")
    patches = exams.select(
        "exam_id",
        (e % 2 == 0).alias("has_key_patch"),
        F.when(e % 4 == 0, "new.pdf").alias("new_key"),
        F.when(e % 5 == 0, "ANSWER_KEY").alias("new_mode"),
    )
    created = exams.select("exam_id", D.exam_mode(F.col("evaluation_mode"), F.col("answer_key_url")).alias("created_mode"))
    patched = D.patch_exam_mode(exams, patches).select("exam_id", F.col("evaluation_mode").alias("patched_mode"))
    return created.join(patched, "exam_id")


@query(
    "b8_normalized_scores",
    with_views(
        "docs",
        f"""SELECT submission_id, CASE WHEN max_possible - 60 <= 0 THEN 0 ELSE
 {r("greatest(0, least(100, total_score / (max_possible - 60) * 100))")} END AS normalized FROM docs""",
    ),
)
def b8_normalized_scores(spark, d):
    return V.evaluation_documents(spark, d).select(
        "submission_id", D.normalize_score(F.col("total_score"), F.col("max_possible") - 60).alias("normalized")
    )


def _status(df):
    return df.withColumn("status", F.when(F.col("confidence_score") >= 0.75, "COMPLETED").otherwise("PENDING_REVIEW"))


@query(
    "b9_review_queue",
    with_views(
        "docs",
        """SELECT submission_id, CASE WHEN confidence_score < 0.70 THEN 'Low AI Confidence' ELSE 'Fairness Check Warning' END AS reason,
 confidence_score FROM docs WHERE confidence_score < 0.70 OR NOT fairness_verified OR confidence_score < 0.75""",
    ),
)
def b9_review_queue(spark, d):
    return D.review_queue(_status(V.evaluation_documents(spark, d)))


@query(
    "b10_needs_review_view",
    with_views(
        "exams subs",
        """SELECT s.submission_id FROM subs s LEFT JOIN exams e ON s.exam_id = e.exam_id
 WHERE (contains(lower(student_name), 'bio') OR contains(lower(student_roll_number), 'bio') OR contains(lower(title), 'bio')
 OR contains(lower(subject), 'bio')) AND e.subject = 'Biology' AND (coalesce(evaluation_confidence, 0.85) < 0.85 OR status <> 'COMPLETED')""",
    ),
)
def b10_needs_review_view(spark, d):
    subs, exams = _both(spark, d)
    return D.needs_review_view(subs, exams, "Bio", "Biology").select("submission_id")


@query("b12_question_bank_search", "SELECT item_id AS question_id, text AS question_text FROM benchmark WHERE contains(lower(text), 'the') ORDER BY item_id LIMIT 5")
def b12_question_bank_search(spark, d):
    bank = V.table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question_text"))
    return D.search_question_bank(bank, "THE", 5)


@query(
    "b13_report_metrics",
    with_views(
        "qe docs",
        f"""SELECT submission_id, {_G.format(x="total_score")} || '/' || {_G.format(x="max_possible")} AS score_text, {r("p", 1)} AS percentage,
 CASE WHEN p>=90 THEN 'A+' WHEN p>=80 THEN 'A' WHEN p>=70 THEN 'B' WHEN p>=60 THEN 'C' WHEN p>=50 THEN 'D' ELSE 'F' END AS grade,
 {r("confidence_score*100", 1)} AS confidence_pct, {r("coalesce(CASE WHEN submission_id % 3 = 0 THEN 50 END, mean_coverage, p)", 1)} AS coverage_pct,
 {r("fairness_score*100", 1)} AS fairness_pct
 FROM (SELECT d.*, m.mean_coverage, total_score/max_possible*100.0::DOUBLE AS p FROM docs d
  LEFT JOIN (SELECT submission_id, avg(concept_coverage) AS mean_coverage FROM qe GROUP BY 1) m USING (submission_id))""",
    ),
)
def b13_report_metrics(spark, d):
    evals = V.evaluation_documents(spark, d).withColumn("concept_coverage", F.when(F.col("submission_id") % 3 == 0, 50.0))
    cover = V.question_evaluations(spark, d).groupBy("submission_id").agg(F.avg("concept_coverage").alias("mean_coverage"))
    return D.report_metrics(evals, cover)


@query(
    "b13_question_rows",
    with_views(
        "qe",
        f"""SELECT submission_id, question_number, max_marks, score_awarded, format('{{:.2f}}', confidence*100) || '%' AS confidence_text,
 {r("score_awarded/max_marks*100")} AS percentage, concept_coverage FROM qe""",
    ),
)
def b13_question_rows(spark, d):
    return D.question_report_rows(V.question_evaluations(spark, d))


@query(
    "b13_report_card",
    with_views(
        "docs",
        f"""SELECT submission_id, total_score, max_possible, format('{{:.1f}}', total_score/max_possible*100) || '%' AS percentage_text,
 format('{{:.2f}}', confidence_score*100) || '%' AS confidence_text, format('{{:.2f}}', fairness_score*100) || '%' AS fairness_text,
 {r("total_score/max_possible*100")} AS score_percentage FROM docs""",
    ),
)
def b13_report_card(spark, d):
    return D.report_card(V.evaluation_documents(spark, d))


@query(
    "c1_published_submissions",
    with_views("exams subs", "SELECT s.submission_id, e.title, e.subject FROM subs s JOIN exams e ON s.exam_id = e.exam_id WHERE e.results_published"),
)
def c1_published_submissions(spark, d):
    subs, exams = _both(spark, d)
    return D.published_for_student(subs, exams, "%").select("submission_id", "title", "subject")


@query(
    "c2_exam_titles",
    with_views(
        "exams subs",
        """SELECT s.submission_id, coalesce(e.title, 'Unknown Exam') AS exam_title FROM subs s LEFT JOIN exams e
 ON s.exam_id = e.exam_id AND e.subject <> 'Maths'""",
    ),
)
def c2_exam_titles(spark, d):
    subs, exams = _both(spark, d)
    return D.with_exam_title(subs, exams.filter("subject <> 'Maths'")).select("submission_id", "exam_title")


@query(
    "c3_submissions_of_visible_exams",
    with_views("exams subs", "SELECT submission_id FROM subs WHERE exam_id IN (SELECT exam_id FROM exams WHERE teacher_id = 1)"),
)
def c3_submissions_of_visible_exams(spark, d):
    subs, exams = _both(spark, d)
    return D.submissions_of(subs, D.visible_exams(exams, 1)).select("submission_id")


@query(
    "d1_teacher_overview",
    with_views(
        "exams subs",
        f"""SELECT teacher_id, count(DISTINCT exam_id) AS total_exams, count(submission_id) AS total_submissions,
 count(*) FILTER (WHERE status='COMPLETED') AS evaluated_submissions,
 {r("coalesce(avg(obtained_marks) FILTER (WHERE status='COMPLETED'),0)")} AS average_score,
 {r("coalesce(avg(evaluation_confidence) FILTER (WHERE status='COMPLETED'),0)", 4)} AS average_confidence,
 count(DISTINCT exam_id) FILTER (WHERE results_published) AS published_exams_count,
 count(DISTINCT exam_id) FILTER (WHERE NOT results_published) AS unpublished_exams_count,
 {r("coalesce(avg(obtained_marks) FILTER (WHERE status='COMPLETED'),0)")} AS average_student_score,
 {r("count(DISTINCT exam_id) FILTER (WHERE results_published) / count(DISTINCT exam_id)::DOUBLE * 100")} AS result_publication_rate,
 count(*) FILTER (WHERE status='COMPLETED' AND mode='AI_AUTONOMOUS') AS autonomous_evaluations,
 count(*) FILTER (WHERE status='COMPLETED' AND mode='ANSWER_KEY') AS answer_key_evaluations
 FROM (SELECT e.*, s.* EXCLUDE (exam_id), {_MODE} FROM exams e LEFT JOIN subs s ON e.exam_id = s.exam_id)
 GROUP BY GROUPING SETS ((teacher_id), ())""",
    ),
)
def d1_teacher_overview(spark, d):
    return D.teacher_overview(*_both(spark, d))


@query(
    "d2_exam_analytics",
    with_views(
        "exams subs",
        f"""SELECT e.exam_id, title, {_EXAM} FROM exams e LEFT JOIN subs s ON e.exam_id = s.exam_id GROUP BY e.exam_id, title""",
    ),
)
def d2_exam_analytics(spark, d):
    subs, exams = _both(spark, d)
    return D.exam_analytics(subs, exams)


_MON = f"""count(*) AS total_submissions, count(*) FILTER (WHERE status='COMPLETED') AS completed_submissions,
 count(*) FILTER (WHERE status='FAILED') AS failed_submissions,
 {r("coalesce(avg(obtained_marks) FILTER (WHERE status='COMPLETED'),0)")} AS average_score,
 {r("coalesce(avg(evaluation_confidence) FILTER (WHERE status='COMPLETED'),0)", 4)} AS average_confidence,
 count(*) FILTER (WHERE status='COMPLETED' AND mode='AI_AUTONOMOUS') AS autonomous_evaluations,
 count(*) FILTER (WHERE status='COMPLETED' AND mode='ANSWER_KEY') AS answer_key_evaluations, {_DASH},
 count(*) FILTER (WHERE status='COMPLETED' AND coalesce(evaluation_confidence,0) >= 0.85) AS high_confidence_85_plus,
 count(*) FILTER (WHERE status='COMPLETED' AND coalesce(evaluation_confidence,0) >= 0.70 AND coalesce(evaluation_confidence,0) < 0.85) AS medium_confidence_70_84,
 count(*) FILTER (WHERE status='COMPLETED' AND coalesce(evaluation_confidence,0) < 0.70) AS low_confidence_below_70,
 {r("coalesce(avg(fairness_score) FILTER (WHERE status='COMPLETED'),1)")} AS average_fairness_score,
 {r("CASE WHEN count(*) FILTER (WHERE status='COMPLETED') = 0 THEN 100 ELSE (count(*) FILTER (WHERE status='COMPLETED') - count(*) FILTER (WHERE status='COMPLETED' AND NOT fairness_verified)) / (count(*) FILTER (WHERE status='COMPLETED'))::DOUBLE * 100 END")} AS bias_free_rate,
 count(*) FILTER (WHERE status='COMPLETED' AND NOT fairness_verified) AS flagged_submissions_count"""
_MON_FROM = f"""FROM (SELECT s.*, e.evaluation_mode, e.answer_key_url, e.teacher_id, {_PCT}, {_MODE} FROM subs s JOIN exams e ON s.exam_id = e.exam_id)"""


@query("d3_monitoring_teacher", with_views("exams subs", f"SELECT {_MON} {_MON_FROM} WHERE teacher_id = 3"))
def d3_monitoring_teacher(spark, d):
    return D.monitoring(*_both(spark, d), user_id=3)


@query("d3_monitoring_admin", with_views("exams subs", f"SELECT {_MON} {_MON_FROM}"))
def d3_monitoring_admin(spark, d):
    return D.monitoring(*_both(spark, d), is_admin=True)


@query(
    "d4_histograms_class_variant",
    with_views("subs", f"SELECT exam_id, {_CLASS} FROM (SELECT *, {_PCT} FROM subs) GROUP BY exam_id"),
)
def d4_histograms_class_variant(spark, d):
    return V.submissions(spark, d).groupBy("exam_id").agg(*D.class_histogram())


@query(
    "d5_confidence_histogram",
    with_views(
        "subs",
        """SELECT exam_id, count(*) FILTER (WHERE c >= 0.85) AS high_confidence_85_plus, count(*) FILTER (WHERE c >= 0.70 AND c < 0.85) AS medium_confidence_70_84,
 count(*) FILTER (WHERE c < 0.70) AS low_confidence_below_70
 FROM (SELECT exam_id, CASE WHEN status='COMPLETED' THEN coalesce(evaluation_confidence,0) END AS c FROM subs) GROUP BY exam_id""",
    ),
)
def d5_confidence_histogram(spark, d):
    return V.submissions(spark, d).groupBy("exam_id").agg(*D.confidence_histogram())


@query(
    "d6_fairness_metrics",
    with_views(
        "subs",
        f"""SELECT exam_id, {r("coalesce(avg(fairness_score),1)")} AS average_fairness_score,
 {r("CASE WHEN count(*) FILTER (WHERE status IS NOT NULL)=0 THEN 100 ELSE (count(status)-count(*) FILTER (WHERE NOT fairness_verified))/count(status)::DOUBLE*100 END")} AS bias_free_rate,
 count(*) FILTER (WHERE NOT fairness_verified) AS flagged_submissions_count
 FROM (SELECT exam_id, CASE WHEN status='COMPLETED' THEN status END AS status, CASE WHEN status='COMPLETED' THEN fairness_score END AS fairness_score,
  CASE WHEN status='COMPLETED' THEN fairness_verified END AS fairness_verified FROM subs) GROUP BY exam_id""",
    ),
)
def d6_fairness_metrics(spark, d):
    return V.submissions(spark, d).groupBy("exam_id").agg(*D.fairness_metrics())


@query(
    "d7_mode_counts",
    with_views(
        "exams subs",
        f"""SELECT exam_id, count(*) FILTER (WHERE status='COMPLETED' AND mode='AI_AUTONOMOUS') AS autonomous_evaluations,
 count(*) FILTER (WHERE status='COMPLETED' AND mode='ANSWER_KEY') AS answer_key_evaluations
 FROM (SELECT s.*, {_MODE} FROM subs s JOIN exams e ON s.exam_id = e.exam_id) GROUP BY exam_id""",
    ),
)
def d7_mode_counts(spark, d):
    subs, exams = _both(spark, d)
    joined = subs.join(exams.select("exam_id", "evaluation_mode", "answer_key_url"), "exam_id")
    return joined.groupBy("exam_id").agg(*D.mode_counts())


@query(
    "d8_class_analytics",
    with_views(
        "exams subs",
        f"""SELECT exam_id, title, {_EXAM}, count(*) FILTER (WHERE status='COMPLETED') AS completed_submissions,
 {r("CASE WHEN count(*) FILTER (WHERE status='COMPLETED')=0 THEN 0 ELSE count(*) FILTER (WHERE status='COMPLETED' AND obtained_marks/total_marks >= 0.5)/(count(*) FILTER (WHERE status='COMPLETED'))::DOUBLE*100 END")} AS pass_rate, {_CLASS}
 FROM (SELECT e.exam_id, title, s.* EXCLUDE (exam_id), {_PCT} FROM exams e LEFT JOIN subs s ON e.exam_id = s.exam_id) GROUP BY exam_id, title""",
    ),
)
def d8_class_analytics(spark, d):
    return D.class_analytics(*_both(spark, d))


@query(
    "d8_class_student_scores",
    with_views(
        "subs",
        """SELECT exam_id, submission_id, student_name, student_roll_number, obtained_marks, total_marks, status FROM subs
 WHERE status='COMPLETED' AND obtained_marks IS NOT NULL""",
    ),
)
def d8_class_student_scores(spark, d):
    return D.class_student_scores(*_both(spark, d))


@query(
    "d9_cohort_analytics",
    with_views(
        "subs docs",
        f"""SELECT exam_id, count(*) AS total_submissions, {r("avg(p)")} AS class_average,
 {r("greatest(max(total_score),0)")} AS highest_score, {r("min(total_score)")} AS lowest_score, {_COHORT}
 FROM (SELECT exam_id, d.*, CASE WHEN d.max_possible > 0 THEN d.total_score/d.max_possible*100.0::DOUBLE ELSE 0 END AS p
  FROM docs d JOIN subs USING (submission_id)) GROUP BY exam_id""",
    ),
)
def d9_cohort_analytics(spark, d):
    subs = V.submissions(spark, d).filter("has_document")
    evals = subs.select("exam_id", F.col("obtained_marks").alias("total_score"), F.col("total_marks").alias("max_possible"))
    return D.cohort_analytics(evals, ["exam_id"])


@query(
    "d14_student_overview",
    with_views(
        "exams subs",
        f"""SELECT min(student_name) AS student_name, count(*) AS total_exams, {r("coalesce(avg(obtained_marks) FILTER (WHERE status='COMPLETED'),0)")} AS average_score
 FROM subs s JOIN exams e ON s.exam_id = e.exam_id WHERE results_published GROUP BY lower(student_name)""",
    ),
)
def d14_student_overview(spark, d):
    return D.student_overview(*_both(spark, d))


@query(
    "d14_student_reports",
    with_views(
        "exams subs",
        """SELECT student_name, submission_id, s.exam_id, title AS exam_title, obtained_marks, total_marks, status
 FROM subs s JOIN exams e ON s.exam_id = e.exam_id WHERE results_published""",
    ),
)
def d14_student_reports(spark, d):
    return D.student_reports(*_both(spark, d))


@query(
    "f1_submission_page",
    with_views("subs", "SELECT submission_id, student_name FROM subs WHERE status='COMPLETED' ORDER BY updated_at DESC, submission_id LIMIT 50 OFFSET 100"),
)
def f1_submission_page(spark, d):
    return D.submission_page(V.submissions(spark, d), 100, 50, status="COMPLETED").select("submission_id", "student_name")


@query("f1_submission_count", with_views("subs", "SELECT count(*) AS total FROM subs WHERE status='COMPLETED'"))
def f1_submission_count(spark, d):
    return D.submission_count(V.submissions(spark, d), status="COMPLETED")


@query(
    "f2_latest_reports",
    with_views(
        "exams subs",
        f"""SELECT s.submission_id, coalesce(title,'Unknown Exam') AS exam_title, CASE WHEN obtained_marks IS NULL THEN 'Not scored'
 ELSE {_G.format(x="obtained_marks")} || '/' || {_G.format(x="total_marks")} END AS score
 FROM (SELECT * FROM subs WHERE status='COMPLETED' ORDER BY updated_at DESC, submission_id LIMIT 100) s LEFT JOIN exams e ON s.exam_id=e.exam_id""",
    ),
)
def f2_latest_reports(spark, d):
    return D.latest_reports(*_both(spark, d)).select("submission_id", "exam_title", "score")
