"""Cohort dashboards, review queues and lists (D1-D9, D14, B*, C1-C4, F1-F2).

Per-exam and per-teacher figures are conditional aggregates: Spark combines on
the map side, so an exam holding a third of all rows still sends one row per task.
Student lists stay tables; they are never folded into one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marklake.functions.numeric import clamp, fmt_fixed, fmt_g, percent, round_even

COMPLETED, FAILED = "COMPLETED", "FAILED"
SCORE_BRACKETS = ("90-100", "80-89", "70-79", "60-69", "below_60")
CONFIDENCE_BRACKETS = ("high_confidence_85_plus", "medium_confidence_70_84", "low_confidence_below_70")
MODES = ("AI_AUTONOMOUS", "ANSWER_KEY")


# --- predicates and labels ---------------------------------------------------


def filter_submissions(subs: DataFrame, exam_id=None, status: str | None = None) -> DataFrame:
    """B1: optional equality filters, pushed to the scan."""
    if exam_id is not None:
        subs = subs.filter(F.col("exam_id") == exam_id)
    if status is not None:
        subs = subs.filter(F.col("status") == status)
    return subs


def visible_exams(exams: DataFrame, user_id, is_admin: bool = False) -> DataFrame:
    """B2: an admin sees every exam, a teacher their own."""
    return exams if is_admin else exams.filter(F.col("teacher_id") == user_id)


def published_for_student(subs: DataFrame, exams: DataFrame, name: str | Column) -> DataFrame:
    """B3 + C1: published exams only; the name is an ILIKE pattern on purpose."""
    pattern = name if isinstance(name, Column) else F.lit(name)
    return subs.join(exams.filter("results_published"), "exam_id").filter(F.ilike("student_name", pattern))


def access_decision(requests: DataFrame, subs: DataFrame, exams: DataFrame) -> DataFrame:
    """First rule that applies, for (viewer_role, viewer_name, submission_id) rows."""
    s = subs.select("submission_id", "exam_id", "student_name").withColumn("_sub", F.lit(True))
    e = exams.select("exam_id", "results_published").withColumn("_exam", F.lit(True))
    decision = (
        F.when(F.col("_sub").isNull(), "SUBMISSION_NOT_FOUND")
        .when(F.col("_exam").isNull(), "EXAM_NOT_FOUND")
        .when(F.col("viewer_role").isin("TEACHER", "ADMIN"), "ALLOW")
        .when(F.lower("student_name") != F.lower("viewer_name"), "ACCESS_DENIED")
        .when(~F.col("results_published"), "RESULTS_UNPUBLISHED")
        .otherwise("ALLOW")
    )
    return (
        requests.join(s, "submission_id", "left")
        .join(e, "exam_id", "left")
        .select(*[requests[c] for c in requests.columns], decision.alias("access_decision"))
    )


def score_text(obtained: Column, total: Column) -> Column:
    """B5"""
    return (
        F.when(obtained.isNull() & total.isNull(), F.lit("Not scored"))
        .when(total.isNull(), fmt_g(obtained))
        .when(obtained.isNull(), F.concat(F.lit("0/"), fmt_g(total)))
        .otherwise(F.concat(fmt_g(obtained), F.lit("/"), fmt_g(total)))
    )


def letter_grade(pct: Column) -> Column:
    """B6"""
    return (
        F.when(pct >= 90, "A+").when(pct >= 80, "A").when(pct >= 70, "B").when(pct >= 60, "C").when(pct >= 50, "D")
    ).otherwise("F")


def exam_mode(explicit: Column, key: Column) -> Column:
    """The given mode, else by presence of an answer key."""
    given = F.when(explicit != "", explicit)
    return F.coalesce(given, F.when(F.coalesce(key, F.lit("")) != "", "ANSWER_KEY").otherwise("AI_AUTONOMOUS"))


def patch_exam_mode(exams: DataFrame, patches: DataFrame) -> DataFrame:
    """A patch naming the key re-derives the mode unless it also names one.

    ``patches``: exam_id, has_key_patch, new_key, new_mode. One patch per exam.
    """
    joined = exams.join(patches, "exam_id", "left")
    key = F.when(F.coalesce("has_key_patch", F.lit(False)), F.col("new_key")).otherwise(F.col("answer_key_url"))
    rederive = F.coalesce("has_key_patch", F.lit(False)) & F.col("new_mode").isNull()
    mode = F.when(rederive, exam_mode(F.lit(None).cast("string"), F.col("new_key"))).otherwise(
        F.coalesce("new_mode", "evaluation_mode")
    )
    return joined.select("exam_id", key.alias("answer_key_url"), mode.alias("evaluation_mode"))


def normalize_score(raw: Column, maximum: Column, scale: float = 100.0) -> Column:
    """B8"""
    return F.when(maximum <= 0, F.lit(0.0)).otherwise(round_even(clamp(raw / maximum * scale, 0.0, scale), 2))


def review_queue(evals: DataFrame) -> DataFrame:
    """B9"""
    low = F.col("confidence_score") < 0.70
    return evals.filter(low | ~F.col("fairness_verified") | (F.col("status") == "PENDING_REVIEW")).select(
        "submission_id",
        F.when(low, "Low AI Confidence").otherwise("Fairness Check Warning").alias("reason"),
        "confidence_score",
    )


def needs_review_view(
    subs: DataFrame, exams: DataFrame, query: str = "", subject: str = "All", view: str = "needs_review"
) -> DataFrame:
    """Search box, subject filter and review state. The query is plain text, not a pattern."""
    joined = subs.join(exams.select("exam_id", "title", "subject"), "exam_id", "left")
    needle = F.lit(query.lower())
    found = F.lit(False)
    for name in ("student_name", "student_roll_number", "title", "subject"):
        found = found | F.contains(F.lower(F.coalesce(F.col(name), F.lit(""))), needle)
    needs = (F.coalesce("evaluation_confidence", F.lit(0.85)) < 0.85) | (F.col("status") != COMPLETED)
    out = joined.filter(found)
    if subject != "All":
        out = out.filter(F.col("subject") == subject)
    if view == "needs_review":
        out = out.filter(needs)
    elif view == "verified":
        out = out.filter(~needs)
    return out


def search_question_bank(questions: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """Case-insensitive substring; the first n in id order."""
    hit = F.contains(F.lower("question_text"), F.lit(query.lower()))
    return questions.filter(hit).orderBy("question_id").limit(limit)


# --- brackets ------------------------------------------------------------------


def score_bracket(pct: Column) -> Column:
    return (
        F.when(pct >= 90, SCORE_BRACKETS[0])
        .when(pct >= 80, SCORE_BRACKETS[1])
        .when(pct >= 70, SCORE_BRACKETS[2])
        .when(pct >= 60, SCORE_BRACKETS[3])
        .otherwise(SCORE_BRACKETS[4])
    )


def _counts(bracket: Column, names: tuple[str, ...], prefix: str) -> list[Column]:
    return [F.count_if(bracket == n).alias(prefix + n.replace("-", "_")) for n in names]


def _scored_pct() -> Column:
    usable = F.col("obtained_marks").isNotNull() & (F.col("total_marks") > 0)
    return F.when(usable, F.col("obtained_marks") / F.col("total_marks") * 100.0)


def dashboard_histogram() -> list[Column]:
    """D4, dashboard variant: rows without a usable percentage fall in below_60."""
    done = F.col("status") == COMPLETED
    return _counts(F.when(done, score_bracket(_scored_pct())), SCORE_BRACKETS, "score_")


def class_histogram() -> list[Column]:
    """D4, class variant: rows without a usable percentage are left out."""
    pct = _scored_pct()
    done = (F.col("status") == COMPLETED) & pct.isNotNull()
    return _counts(F.when(done, score_bracket(pct)), SCORE_BRACKETS, "score_")


def cohort_histogram() -> list[Column]:
    """D4, cohort variant over evaluation documents: a maximum of 0 counts as 0 %."""
    pct = percent(F.col("total_score"), F.col("max_possible"))
    return _counts(score_bracket(pct), SCORE_BRACKETS, "score_")


def confidence_histogram() -> list[Column]:
    """D5"""
    conf = F.coalesce("evaluation_confidence", F.lit(0.0))
    bracket = (
        F.when(conf >= 0.85, CONFIDENCE_BRACKETS[0]).when(conf >= 0.70, CONFIDENCE_BRACKETS[1])
    ).otherwise(CONFIDENCE_BRACKETS[2])
    return _counts(F.when(F.col("status") == COMPLETED, bracket), CONFIDENCE_BRACKETS, "")


def resolved_mode() -> Column:
    """Document mode, then exam mode, then presence of a key."""
    first = F.coalesce(
        F.when(F.col("document_mode") != "", F.col("document_mode")), F.col("evaluation_mode")
    )
    fallback = F.when(F.coalesce("answer_key_url", F.lit("")) != "", MODES[1]).otherwise(MODES[0])
    return F.when(first.isin(*MODES), first).otherwise(fallback)


def mode_counts() -> list[Column]:
    done = F.col("status") == COMPLETED
    return [
        F.count_if(done & (resolved_mode() == MODES[0])).alias("autonomous_evaluations"),
        F.count_if(done & (resolved_mode() == MODES[1])).alias("answer_key_evaluations"),
    ]


def fairness_metrics() -> list[Column]:
    """D6. Absent documents carry no score; absent fields in a document mean 1.0 and verified."""
    done = F.col("status") == COMPLETED
    present = done & F.col("has_document")
    flagged = F.count_if(present & ~F.coalesce("fairness_verified", F.lit(True)))
    completed = F.count_if(done)
    mean = F.avg(F.when(present, F.coalesce("fairness_score", F.lit(1.0))))
    rate = F.when(completed > 0, (completed - flagged) / completed * 100.0).otherwise(F.lit(100.0))
    return [
        round_even(F.coalesce(mean, F.lit(1.0)), 2).alias("average_fairness_score"),
        round_even(rate, 2).alias("bias_free_rate"),
        flagged.alias("flagged_submissions_count"),
    ]


def _done(name: str) -> Column:
    return F.when(F.col("status") == COMPLETED, F.col(name))


def _zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


# --- aggregates ------------------------------------------------------------------


def teacher_overview(subs: DataFrame, exams: DataFrame) -> DataFrame:
    """D1 for every teacher, plus the admin row (teacher_id NULL, all exams).

    Submissions are summed by exam and document mode before they meet the exams, so
    no exam, however large, crosses the join as rows. Exams without submissions count.
    """
    summed = subs.groupBy("exam_id", "document_mode").agg(
        F.count("submission_id").alias("n"),
        F.count_if(F.col("status") == COMPLETED).alias("done"),
        F.sum(_done("obtained_marks")).alias("s_marks"),
        F.count(_done("obtained_marks")).alias("n_marks"),
        F.sum(_done("evaluation_confidence")).alias("s_conf"),
        F.count(_done("evaluation_confidence")).alias("n_conf"),
    )
    cells = exams.select("exam_id", "teacher_id", "results_published", "evaluation_mode", "answer_key_url").join(summed, "exam_id", "left")
    by_exam = cells.groupBy("exam_id", "teacher_id", "results_published").agg(
        *[F.sum(c).alias(c) for c in ("n", "done", "s_marks", "n_marks", "s_conf", "n_conf")],
        *[F.sum(F.when(resolved_mode() == m, F.col("done"))).alias(m) for m in MODES],
    )
    exams_n, pub = F.count(F.lit(1)), F.count_if("results_published")
    avg_marks = round_even(_zero(F.sum("s_marks") / F.nullif(F.sum("n_marks"), F.lit(0))), 2)
    avg_conf = round_even(_zero(F.sum("s_conf") / F.nullif(F.sum("n_conf"), F.lit(0))), 4)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return by_exam.groupingSets([["teacher_id"], []], "teacher_id").agg(
        exams_n.alias("total_exams"),
        total("n").alias("total_submissions"),
        total("done").alias("evaluated_submissions"),
        avg_marks.alias("average_score"),
        avg_conf.alias("average_confidence"),
        pub.alias("published_exams_count"),
        (exams_n - pub).alias("unpublished_exams_count"),
        avg_marks.alias("average_student_score"),
        round_even(pub / exams_n * 100.0, 2).alias("result_publication_rate"),
        total(MODES[0]).alias("autonomous_evaluations"),
        total(MODES[1]).alias("answer_key_evaluations"),
    )


def overview_metrics(subs: DataFrame, exams: DataFrame, user_id=None, is_admin: bool = False) -> DataFrame:
    """D1 for one viewer: one row, all zeros when they have no exams."""
    scope = visible_exams(exams, user_id, is_admin).withColumn("teacher_id", F.lit(0))
    rows = teacher_overview(subs, scope).filter(F.col("teacher_id").isNull())
    names = [c for c in rows.columns if c != "teacher_id"]
    return rows.agg(*[F.coalesce(F.max(c), F.lit(0)).cast(rows.schema[c].dataType).alias(c) for c in names])


def exam_aggregates() -> list[Column]:
    """Over the submissions of an exam."""
    total, done = F.count("submission_id"), F.count_if(F.col("status") == COMPLETED)
    return [
        total.alias("submission_count"),
        round_even(_zero(F.avg(_done("obtained_marks"))), 2).alias("average_score"),
        _zero(F.max(_done("obtained_marks"))).alias("top_score"),
        _zero(F.min(_done("obtained_marks"))).alias("lowest_score"),
        round_even(percent(done, total), 2).alias("completion_rate"),
    ]


def exam_analytics(subs: DataFrame, exams: DataFrame, extra: list[Column] | None = None) -> DataFrame:
    """D2 (+ any further conditional aggregates) for every exam in one pass.

    Submissions are aggregated first; the exams then meet one row each, and an exam
    without submissions gets zeros.
    """
    figures = subs.groupBy("exam_id").agg(*exam_aggregates(), *(extra or []))
    return exams.select("exam_id", "title").join(figures, "exam_id", "left").na.fill(0)


def class_analytics(subs: DataFrame, exams: DataFrame) -> DataFrame:
    """D2 with pass rate and the class histogram. Students: ``class_student_scores``."""
    done = F.col("status") == COMPLETED
    completed = F.count_if(done)
    passed = F.count_if(
        done & (F.col("total_marks") != 0) & (F.col("obtained_marks") / F.col("total_marks") >= 0.50)
    )
    pass_rate = round_even(percent(passed, completed), 2).alias("pass_rate")
    return exam_analytics(subs, exams, [completed.alias("completed_submissions"), pass_rate, *class_histogram()])


def class_student_scores(subs: DataFrame, exams: DataFrame) -> DataFrame:
    """The student list, one row each."""
    return (
        subs.filter((F.col("status") == COMPLETED) & F.col("obtained_marks").isNotNull())
        .join(exams.select("exam_id"), "exam_id", "left_semi")
        .select("exam_id", "submission_id", "student_name", "student_roll_number", "obtained_marks", "total_marks", "status")
    )


def monitoring(subs: DataFrame, exams: DataFrame, user_id=None, is_admin: bool = False) -> DataFrame:
    """D3-D7 in one scan of the submissions joined to the visible exams."""
    scope = visible_exams(exams, user_id, is_admin).select("exam_id", "evaluation_mode", "answer_key_url")
    return subs.join(scope, "exam_id").agg(*monitoring_aggregates())


def monitoring_aggregates() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total_submissions"),
        F.count_if(F.col("status") == COMPLETED).alias("completed_submissions"),
        F.count_if(F.col("status") == FAILED).alias("failed_submissions"),
        round_even(_zero(F.avg(_done("obtained_marks"))), 2).alias("average_score"),
        round_even(_zero(F.avg(_done("evaluation_confidence"))), 4).alias("average_confidence"),
        *mode_counts(),
        *dashboard_histogram(),
        *confidence_histogram(),
        *fairness_metrics(),
    ]


def cohort_analytics(evals: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of percentages; the highest total floors at zero."""
    pct = percent(F.col("total_score"), F.col("max_possible"))
    return evals.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_submissions"),
        round_even(F.avg(pct), 2).alias("class_average"),
        round_even(F.greatest(F.max("total_score"), F.lit(0.0)), 2).alias("highest_score"),
        round_even(F.min("total_score"), 2).alias("lowest_score"),
        *cohort_histogram(),
    )


def student_overview(subs: DataFrame, exams: DataFrame) -> DataFrame:
    """D14 for every student: all published rows count, the mean is over completed ones. Names are one whatever their case."""
    return (
        subs.join(exams.filter("results_published").select("exam_id"), "exam_id", "left_semi")
        .groupBy(F.lower("student_name").alias("_name"))
        .agg(
            F.min("student_name").alias("student_name"),
            F.count(F.lit(1)).alias("total_exams"),
            round_even(_zero(F.avg(_done("obtained_marks"))), 2).alias("average_score"),
        )
        .drop("_name")
    )


def student_reports(subs: DataFrame, exams: DataFrame) -> DataFrame:
    """The report list of each student, one row per published submission (C2 title)."""
    return with_exam_title(subs, exams.filter("results_published"), how="inner").select(
        "student_name", "submission_id", "exam_id", "exam_title", "obtained_marks", "total_marks", "status"
    )


def with_exam_title(subs: DataFrame, exams: DataFrame, how: str = "left") -> DataFrame:
    """C2"""
    titled = subs.join(exams.select("exam_id", F.col("title").alias("_title")), "exam_id", how)
    return titled.withColumn("exam_title", F.coalesce("_title", F.lit("Unknown Exam"))).drop("_title")


def submissions_of(subs: DataFrame, exams: DataFrame) -> DataFrame:
    """The submissions of visible exams."""
    return subs.join(exams.select("exam_id"), "exam_id", "left_semi")


# --- lists -------------------------------------------------------------------


def submission_page(subs: DataFrame, skip: int, limit: int, exam_id=None, status=None) -> DataFrame:
    """one page, newest first; the id settles equal times."""
    rows = filter_submissions(subs, exam_id, status)
    return rows.orderBy(F.col("updated_at").desc(), F.col("submission_id")).offset(skip).limit(limit)


def submission_count(subs: DataFrame, exam_id=None, status=None) -> DataFrame:
    """the filtered count shown beside the page."""
    return filter_submissions(subs, exam_id, status).agg(F.count(F.lit(1)).alias("total"))


def latest_reports(subs: DataFrame, exams: DataFrame, limit: int = 100) -> DataFrame:
    """top-k before the title join, so only k rows meet the exams."""
    newest = (
        subs.filter(F.col("status") == COMPLETED)
        .orderBy(F.col("updated_at").desc(), F.col("submission_id"))
        .limit(limit)
    )
    return with_exam_title(newest, exams).withColumn(
        "score", score_text(F.col("obtained_marks"), F.col("total_marks"))
    )


# --- document projections (B13) ------------------------------------------------


def report_metrics(evals: DataFrame, question_coverage: DataFrame) -> DataFrame:
    """Coverage falls back from submission, to mean of questions, to percentage.

    ``question_coverage``: submission_id, mean_coverage (pre-aggregated).
    """
    pct = percent(F.col("total_score"), F.col("max_possible"))
    coverage = F.coalesce(F.col("concept_coverage"), F.col("mean_coverage"), pct)
    return evals.join(question_coverage, "submission_id", "left").select(
        "submission_id",
        F.concat(fmt_g(F.col("total_score")), F.lit("/"), fmt_g(F.col("max_possible"))).alias("score_text"),
        round_even(pct, 1).alias("percentage"),
        letter_grade(pct).alias("grade"),
        round_even(F.coalesce("confidence_score", F.lit(0.0)) * 100, 1).alias("confidence_pct"),
        round_even(coverage, 1).alias("coverage_pct"),
        round_even(F.coalesce("fairness_score", F.lit(0.0)) * 100, 1).alias("fairness_pct"),
    )


def question_report_rows(questions: DataFrame) -> DataFrame:
    """Per-question rows of the report card and the student dashboard."""
    pct = percent(F.col("score_awarded"), F.col("max_marks"))
    return questions.select(
        "submission_id",
        "question_number",
        "max_marks",
        "score_awarded",
        F.concat(fmt_fixed(F.col("confidence") * 100, 2), F.lit("%")).alias("confidence_text"),
        round_even(pct, 2).alias("percentage"),
        "concept_coverage",
    )


def report_card(evals: DataFrame) -> DataFrame:
    """The summary block of a report card."""
    pct = percent(F.col("total_score"), F.col("max_possible"))
    return evals.select(
        "submission_id",
        "total_score",
        "max_possible",
        F.concat(fmt_fixed(pct, 1), F.lit("%")).alias("percentage_text"),
        F.concat(fmt_fixed(F.col("confidence_score") * 100, 2), F.lit("%")).alias("confidence_text"),
        F.concat(fmt_fixed(F.col("fairness_score") * 100, 2), F.lit("%")).alias("fairness_text"),
        round_even(pct, 2).alias("score_percentage"),
    )


# The topics shown when a document holds no recommendation.
DEFAULT_STUDY_TOPICS = [
    "Core Concepts From This Exam",
    "Answer Structure And Explanation",
    "Question-Specific Terminology",
]


def study_plan(docs: DataFrame, most: int = 6) -> DataFrame:
    """Topics and practice items, the first `most` of each, from the lists of a document."""
    topics = F.when(F.size("study_recommendations") > 0, F.col("study_recommendations")).otherwise(
        F.array(*[F.lit(t) for t in DEFAULT_STUDY_TOPICS])
    )
    practice = F.when(F.size("improvements") > 0, F.col("improvements")).otherwise(
        F.coalesce("weaknesses", F.array().cast("array<string>"))
    )
    return docs.select(
        "submission_id", F.slice(topics, 1, most).alias("study_topics"), F.slice(practice, 1, most).alias("practice_focus")
    )
