"""Registered queries: readers, writers, change application and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from marklake.plans import views as V
from marklake.plans.common import Catalog
from marklake.plans.evidence_queries import MARKS_SQL
from marklake.plans.views import r, with_views
from marklake.sources import readers as RD
from marklake.sources import writers as W
from marklake.streaming import jobs as J
from marklake.session import ensure_checkpoint_dir

query = Catalog()


def workspace(spark) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"


# --- readers ------------------------------------------------------------------------------


@query(
    "a2_ocr_lines",
    """SELECT event_id AS page_id, CASE WHEN event_id % 5 <> 0 THEN round(value)/512.0::DOUBLE ELSE 1.0 END AS confidence, event_type AS text, CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE (event_id % 700)::DOUBLE END AS top_y,
 CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE (user_id % 90)::DOUBLE END AS left_x FROM events""",
)
def a2_ocr_lines(spark, d):
    i = F.col("event_id")
    corner = F.array((F.col("user_id") % 90).cast("double"), (i % 700).cast("double"))
    line = F.struct(
        F.col("event_type").alias("text"),
        F.when(i % 5 != 0, F.round("value") / 512.0).alias("confidence"),
        F.when(i % 3 != 0, F.array(corner, corner)).alias("bounding_box"),
    )
    raw = V.table(spark, d, "events").select(i.alias("page_id"), F.to_json(F.struct(F.array(line).alias("lines"))).alias("value"))
    return RD.parse_ocr_output(raw).select("page_id", "confidence", "text", "top_y", "left_x")


def _documents_json(spark, d):
    """Evaluation documents as stored text; every 17th is cut short."""
    docs = V.evaluation_documents(spark, d)
    value = F.to_json(F.struct("submission_id", "total_score", "max_possible", "fairness_score", "fairness_verified", F.lit("AI_AUTONOMOUS").alias("evaluation_mode"), F.array(F.lit("a"), F.lit("b")).alias("strengths")))
    broken = F.expr("substring(value, 1, 40)")
    return docs.select("submission_id", value.alias("value")).withColumn("value", F.when(F.col("submission_id") % 17 == 0, broken).otherwise(F.col("value")))


@query(
    "a3_submission_reviews",
    with_views(
        "subs",
        """SELECT submission_id, student_name AS student, coalesce(obtained_marks, 0) AS score, coalesce(evaluation_confidence, 0) AS confidence, 0 AS n_questions,
 CASE WHEN has_document AND submission_id % 17 <> 0 THEN fairness_score END AS neutrality_score, CASE WHEN has_document AND submission_id % 17 <> 0 THEN CASE WHEN fairness_verified THEN 'PASSED' ELSE 'FLAGGED' END END AS fairness_status FROM subs""",
    ),
)
def a3_submission_reviews(spark, d):
    parsed = RD.parse_evaluations(_documents_json(spark, d))
    return RD.submission_reviews(V.submissions(spark, d), parsed).withColumn("n_questions", F.col("n_questions").cast("int"))


@query(
    "a5_observations",
    with_views("obs", "SELECT script_id::VARCHAR AS script_id, question_number::VARCHAR AS question_number, human_mark, engine_mark_a, engine_mark_b, subject, 'unknown' AS question_type FROM obs"),
)
def a5_observations(spark, d):
    o = V.observations(spark, d)
    row = F.to_json(
        F.struct(
            F.col("script_id").cast("string").alias("script_id"), F.col("question_number").cast("string").alias("question_number"), "max_marks", "human_mark",
            F.col("engine_mark_a").alias("engine_mark_A"), F.col("engine_mark_b").alias("engine_mark_B"), "subject",
        )
    )
    lines = o.select(F.explode(F.array(row, F.lit("  "))).alias("value"))  # blank lines are skipped
    return RD.parse_observations(lines).select("script_id", "question_number", "human_mark", "engine_mark_a", "engine_mark_b", "subject", "question_type")


@query(
    "a6_transcription_lines",
    with_views("tlines", "SELECT script_id, page_number, min(confidence) OVER (PARTITION BY script_id, page_number) AS page_confidence, text, confidence, struck_through FROM tlines"),
)
def a6_transcription_lines(spark, d):
    lines = V.transcript_lines(spark, d)
    pages = lines.groupBy("script_id", "page_number").agg(
        F.min("confidence").alias("page_confidence"), F.sort_array(F.collect_list(F.struct("line_idx", "text", "confidence", "struck_through"))).alias("lines")
    )
    page = F.struct("page_number", "page_confidence", F.lit("m").alias("model_id"), F.lit("p").alias("prompt_version"), F.lit("h").alias("page_sha256"), "lines")
    raw = pages.select("script_id", F.when(F.col("script_id") % 2 == 0, F.to_json(page)).otherwise(F.to_json(F.array(page))).alias("value"))
    out = RD.parse_transcriptions(raw)
    return out.select("script_id", F.col("page_number").cast("bigint").alias("page_number"), "page_confidence", "text", "confidence", "struck_through")


@query(
    "a8_transcription_responses",
    """SELECT page_id, CASE k WHEN 0 THEN 'response carried no text payload' WHEN 1 THEN 'response is not valid JSON' WHEN 2 THEN 'response has no ''lines'' key' WHEN 3 THEN '''lines'' is not a list' WHEN 4 THEN 'a line has no ''text''' WHEN 5 THEN 'a legibility is not a number'
 WHEN 6 THEN 'a legibility is outside [0, 1]' END AS reject_reason, CASE WHEN k = 7 THEN 'BLANK_PAGE: no lines transcribed' WHEN k = 8 THEN 'line 1: unusable bbox|line 1: marked struck through by the candidate' WHEN k > 8 THEN '' END AS warnings, CASE WHEN k >= 8 THEN 0.5::DOUBLE END AS page_confidence FROM (SELECT page_id, page_id % 12 AS k FROM pages)""",
)
def a8_transcription_responses(spark, d):
    k = F.col("page_id") % 12
    cases = ["  ", '{"lines": [', '{"text": 1}', '{"lines": "none"}', '{"lines": [{"legibility": 0.5}]}', '{"lines": [{"text": "a", "legibility": "high"}]}', '{"lines": [{"text": "a", "legibility": 1.5}]}', '{"lines": []}', '{"lines": [{"text": "a", "legibility": 0.5, "bbox": [1, 2], "struck_through": true}]}']
    url = F.to_json(F.struct(F.array(F.struct(F.col("url").alias("text"), F.lit(0.5).alias("legibility"), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("bbox"))).alias("lines")))
    value = F.coalesce(*[F.when(k == i, F.lit(c)) for i, c in enumerate(cases)], url)
    raw = V.table(spark, d, "pages").select("page_id", value.alias("value"))
    out = RD.parse_transcription_responses(raw)
    return out.select("page_id", "reject_reason", F.array_join("warnings", "|").alias("warnings"), "page_confidence")


@query(
    "a8_scoring_responses",
    with_views(
        "qe",
        f"""SELECT submission_id, question_number, CASE WHEN k = 0 THEN 'not valid JSON' WHEN k = 1 THEN 'score is not a number' END AS reject_reason, CASE WHEN k > 1 THEN least(max_marks, score_awarded * 2) END AS score_awarded,
 CASE WHEN k > 1 THEN CASE WHEN k = 2 THEN 0.95 ELSE least(1, confidence * 1.25::DOUBLE) END END AS confidence,
 CASE WHEN k > 1 THEN {r("CASE WHEN concept_missing THEN 0 ELSE 2/3.0::DOUBLE*100 END")} END AS concept_coverage FROM (SELECT *, submission_id % 11 AS k FROM qe)""",
    ),
)
def a8_scoring_responses(spark, d):
    q = V.question_evaluations(spark, d)
    k = F.col("submission_id") % 11
    missing = F.size(F.concat("missing_semantic", "missing_concepts")) == 2
    body = F.struct(
        (F.col("score_awarded") * 2).alias("score_awarded"),
        F.when(k != 2, F.col("confidence") * 1.25).alias("confidence"),
        F.when(missing, F.array().cast("array<string>")).otherwise(F.array(F.lit(" a "), F.lit("b"), F.lit(""))).alias("matched_concepts"),
        F.array(F.lit("c")).alias("missing_concepts"),
    )
    fenced = F.concat(F.lit("```json\n"), F.to_json(body), F.lit("\n```"))
    value = F.when(k == 0, F.lit("I cannot grade this")).when(k == 1, F.lit('{"score_awarded": "none"}')).when(k > 6, fenced).otherwise(F.to_json(body))
    out = RD.parse_scoring_responses(q.select("submission_id", "question_number", "max_marks", value.alias("value")))
    return out.select("submission_id", "question_number", "reject_reason", "score_awarded", "confidence", "concept_coverage")


def _requests(spark, d):
    p = V.table(spark, d, "pages")
    key = RD.cache_key(F.sha2("url", 256), F.lit("vision/1"), F.lit("prompt/2"))
    return p.select("page_id", "url", key.alias("cache_key"))


@query(
    "a12_cache_split",
    """WITH q AS (SELECT page_id, url, sha256(url) || '__vision_1__prompt_2' AS k FROM pages) SELECT page_id, k AS cache_key, CASE WHEN k IN (SELECT k FROM q WHERE url LIKE 'https:%') THEN 'HIT' ELSE 'MISS' END AS outcome FROM q""",
)
def a12_cache_split(spark, d):
    asked = _requests(spark, d)
    cache = asked.filter("url LIKE 'https:%'").select("cache_key").distinct()
    hits = asked.join(RD.cache_hits(asked, cache), "cache_key", "left_semi").select("page_id", "cache_key", F.lit("HIT").alias("outcome"))
    return hits.unionByName(RD.cache_misses(asked, cache).select("page_id", "cache_key", F.lit("MISS").alias("outcome")))


@query(
    "a13_upload_manifest",
    """SELECT page_id, CASE WHEN n = '' THEN 'Filename is empty.' WHEN e NOT IN ('.pdf','.png','.jpg','.jpeg') THEN 'File type ''' || e || ''' is not allowed. Allowed types: .pdf, .png, .jpg, .jpeg'
 WHEN s > 20971520 THEN 'File size (' || format('{:.1f}', s/1048576.0::DOUBLE) || ' MB) exceeds the maximum allowed size of 20 MB.' END AS reject_reason
 FROM (SELECT page_id, CASE page_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'page.html' WHEN 2 THEN 'Scan.PDF' WHEN 3 THEN 'noext' ELSE 'p.jpeg' END AS n, CASE page_id % 6 WHEN 1 THEN '.html' WHEN 2 THEN '.pdf' WHEN 3 THEN '' ELSE '.jpeg' END AS e, length(html)*3000 AS s FROM pages)""",
)
def a13_upload_manifest(spark, d):
    k = F.col("page_id") % 6
    name = F.when(k == 0, "").when(k == 1, "page.html").when(k == 2, "Scan.PDF").when(k == 3, "noext").otherwise("p.jpeg")
    files = V.table(spark, d, "pages").select("page_id", name.alias("file_name"), (F.length("html") * 3000).alias("file_size"))
    return RD.validate_uploads(files).select("page_id", "reject_reason")


# --- writers and changes ---------------------------------------------------------------------


@query(
    "a9_written_documents",
    with_views("subs", "SELECT exam_id, count(*) AS n, sum(obtained_marks) AS total FROM subs WHERE has_document GROUP BY exam_id"),
)
def a9_written_documents(spark, d):
    docs = V.submissions(spark, d).filter("has_document").select("exam_id", "submission_id", "obtained_marks", "total_marks")
    path = W.write_documents(docs, workspace(spark), "evaluation_outputs")
    back = spark.read.schema("submission_id bigint, obtained_marks double, total_marks double, exam_id bigint").json(path)
    return back.groupBy("exam_id").agg(F.count(F.lit(1)).alias("n"), F.sum("obtained_marks").alias("total"))


@query(
    "a10_written_results",
    with_views("qe", "SELECT 'value-point-engine/0.1.0-demo' AS prov_scorer, count(*) AS n, sum(score_awarded) AS total FROM qe"),
)
def a10_written_results(spark, d):
    from marklake.operators.marks import ENGINE_VERSION

    rows = V.question_evaluations(spark, d).select("submission_id", "question_number", "score_awarded", F.lit("raw").alias("lines"))
    path = W.write_results(rows, workspace(spark), scorer=ENGINE_VERSION, scheme="s1")
    back = spark.read.parquet(path)
    return back.groupBy("prov_scorer").agg(F.count(F.lit(1)).alias("n"), F.sum("score_awarded").alias("total"))


@query(
    "a11_patched_submissions",
    """WITH p AS (SELECT user_id, arg_max(s, event_id) FILTER (WHERE s IS NOT NULL) AS s, arg_max(m, event_id) FILTER (WHERE m IS NOT NULL) AS m FROM (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' END AS s, CASE WHEN value > 250 THEN value END AS m FROM events) GROUP BY 1)
 SELECT c_custkey AS submission_id, coalesce(s, 'UPLOADED') AS status, coalesce(m, c_acctbal) AS obtained_marks FROM customer LEFT JOIN p ON user_id = c_custkey""",
)
def a11_patched_submissions(spark, d):
    base = V.table(spark, d, "customer").select(F.col("c_custkey").alias("submission_id"), F.lit("UPLOADED").alias("status"), F.col("c_acctbal").alias("obtained_marks"))
    status = F.when(F.col("event_type") == "purchase", "COMPLETED").when(F.col("event_type") == "error", "FAILED")
    patches = V.table(spark, d, "events").select(F.col("user_id").alias("submission_id"), "event_id", status.alias("status"), F.when(F.col("value") > 250, F.col("value")).alias("obtained_marks"))
    return W.apply_patches(base, patches, "submission_id", ["status", "obtained_marks"], "event_id")


@query(
    "a11_published_exams",
    with_views(
        "exams",
        """SELECT exam_id, CASE WHEN l.k IS NOT NULL THEN p ELSE results_published END AS results_published, CASE WHEN p THEN stamp END AS published_at FROM exams LEFT JOIN (
 SELECT 199300 + user_id AS k, arg_max(event_type = 'signup', event_id) AS p, arg_max(event_id, event_id) AS stamp FROM events WHERE event_type IN ('signup','view') GROUP BY 1) l ON l.k = exam_id""",
    ),
)
def a11_published_exams(spark, d):
    log = V.table(spark, d, "events").filter("event_type IN ('signup', 'view')").select(
        (F.col("user_id") + 199300).alias("exam_id"), "event_id", (F.col("event_type") == "signup").alias("publish"), F.col("event_id").alias("at")
    )
    exams = V.exams(spark, d).withColumn("published_at", F.lit(None).cast("bigint"))
    return W.apply_publication(exams, log, "event_id").select("exam_id", "results_published", "published_at")


@query(
    "a14_after_deletes",
    with_views("exams subs", "SELECT submission_id FROM subs WHERE exam_id NOT IN (SELECT exam_id FROM exams WHERE subject = 'Maths') AND submission_id NOT IN (SELECT event_id FROM events WHERE event_type = 'error')"),
)
def a14_after_deletes(spark, d):
    exams = V.exams(spark, d)
    gone = V.table(spark, d, "events").filter("event_type = 'error'").select(F.col("event_id").alias("submission_id"))
    return W.apply_deletes(exams, V.submissions(spark, d), exams.filter("subject = 'Maths'"), gone)[1].select("submission_id")


# --- streams -------------------------------------------------------------------------------------


def _stream(spark, d, name):
    """A table as a stream: one file, or a folder of files. Spark takes a path of one file only as a pattern."""
    return J.file_stream(spark, V.table(spark, d, name).schema, d, f"{{{name}}}.parquet")


@query(
    "s1_incremental_grading",
    f"""SELECT doc_id, CASE WHEN bad THEN 'FAILED' ELSE 'COMPLETED' END AS status, CASE WHEN NOT bad THEN total END AS total, CASE WHEN bad THEN 'Evaluation failed. Please try again.' END AS error_message
 FROM (SELECT doc_id, length(trim(text, e' \\t\\n\\r')) < 40 AS bad FROM documents) LEFT JOIN ({MARKS_SQL}) ON answer_id = doc_id""",
)
def s1_incremental_grading(spark, d):
    """Documents arrive as answers to the benchmark's questions and are graded by its value points."""
    from marklake.functions.text import strip
    from marklake.operators import evidence as E
    from marklake.operators import marks as M
    from marklake.plans.evidence_queries import schemes
    from marklake.session import checkpointed

    base = workspace(spark)
    bad = F.length(strip(F.col("text"))) < 40
    scheme = schemes(spark, d)
    n = scheme.count()

    def grade(batch):
        answers = batch.select(F.col("doc_id").alias("answer_id"), (F.col("doc_id") % n).cast("string").alias("question_id"), F.col("text").alias("answer_text"))
        evidence = checkpointed(E.text_evidence(answers, scheme, guarded=True))
        marks = M.score_answers(answers, E.scheme_rows(scheme), evidence.filter(F.col("method") != E.ERROR)).select("answer_id", "total")
        errors = evidence.filter(F.col("method") == E.ERROR).select("answer_id", F.col("reason").alias("error_message"))
        return batch.join(marks.join(errors, "answer_id", "left").withColumnRenamed("answer_id", "doc_id"), "doc_id", "left")

    J.run_available(_stream(spark, d, "documents"), J.grade_increment(grade, bad, f"{base}/sink", "doc_id"), f"{base}/state")
    return J.graded(spark, f"{base}/sink").select("doc_id", "status", "total", "error_message")


_STATUS = "CASE event_type WHEN 'signup' THEN 'UPLOADED' WHEN 'view' THEN 'PROCESSING' WHEN 'click' THEN 'OCR_COMPLETE' WHEN 'purchase' THEN CASE WHEN value > 400 THEN 'COMPLETED' ELSE 'EVALUATING' END ELSE 'FAILED' END"


def _lifecycle_events(events):
    t = F.col("event_type")
    status = (
        F.when(t == "signup", "UPLOADED").when(t == "view", "PROCESSING").when(t == "click", "OCR_COMPLETE")
        .when((t == "purchase") & (F.col("value") > 400), "COMPLETED").when(t == "purchase", "EVALUATING").otherwise("FAILED")
    )
    return events.select("event_id", F.col("user_id").alias("submission_id"), status.alias("status"), "ts")


_EVENTS = f"(SELECT event_id, user_id AS submission_id, {_STATUS} AS status, ts FROM events)"
_OWN = "CASE WHEN {1} IS NOT NULL AND ({0} IS NULL OR {1} >= {0}) THEN 'COMPLETED' WHEN {0} IS NOT NULL THEN 'PROCESSING' END"

_LIFE = f"""SELECT submission_id, CASE WHEN lf IS NOT NULL AND tc IS NULL AND (ls IS NULL OR lf >= ls) THEN 'FAILED' WHEN f > 0 THEN ['UPLOADED','PROCESSING','OCR_COMPLETE','EVALUATING','COMPLETED'][f] END AS status,
 {_OWN.format("tp", "tq")} AS ocr_status, {_OWN.format("te", "tc")} AS evaluation_status, f AS furthest_stage, n_stage_events, n_failures FROM (
 SELECT submission_id, max(rk)::BIGINT AS f, count(*) FILTER (WHERE rk > 0) AS n_stage_events, count(*) FILTER (WHERE status='FAILED') AS n_failures, max(ts) FILTER (WHERE status='FAILED') AS lf, max(ts) FILTER (WHERE rk > 0) AS ls,
  max(ts) FILTER (WHERE status='PROCESSING') AS tp, max(ts) FILTER (WHERE status='OCR_COMPLETE') AS tq, max(ts) FILTER (WHERE status='EVALUATING') AS te, max(ts) FILTER (WHERE status='COMPLETED') AS tc FROM (
 SELECT *, coalesce(list_position(['UPLOADED','PROCESSING','OCR_COMPLETE','EVALUATING','COMPLETED'], status), 0) AS rk FROM {_EVENTS}) GROUP BY 1)"""

_ILLEGAL = f"""SELECT submission_id, event_id, status, previous FROM (
 SELECT *, list_position(['UPLOADED','PROCESSING','OCR_COMPLETE','EVALUATING','COMPLETED'], status) AS rk, list_position(['UPLOADED','PROCESSING','OCR_COMPLETE','EVALUATING','COMPLETED'], previous) AS pk
 FROM (SELECT *, lag(status) OVER (PARTITION BY submission_id ORDER BY ts, event_id) AS previous FROM {_EVENTS}))
 WHERE NOT coalesce(CASE WHEN previous IS NULL THEN status = 'UPLOADED' WHEN previous = 'COMPLETED' THEN false WHEN status = 'FAILED' THEN true WHEN previous = 'FAILED' THEN status = 'PROCESSING' ELSE rk = pk OR rk = pk + 1 END, false)"""


@query("s2_lifecycle_batch", _LIFE)
def s2_lifecycle_batch(spark, d):
    return J.lifecycle(_lifecycle_events(V.table(spark, d, "events")))


@query("s2_illegal_batch", _ILLEGAL)
def s2_illegal_batch(spark, d):
    return J.illegal_transitions(_lifecycle_events(V.table(spark, d, "events"))).drop("ts")


def _lifecycle_sink(spark, d):
    base = workspace(spark)
    stream = J.once(_lifecycle_events(_stream(spark, d, "events")))
    J.run_available(stream, J.merge_lifecycle(f"{base}/sink"), f"{base}/state")
    return f"{base}/sink"


@query("s2_lifecycle_stream", _LIFE)
def s2_lifecycle_stream(spark, d):
    return J.current_lifecycle(spark, _lifecycle_sink(spark, d))


@query("s2_illegal_stream", _ILLEGAL)
def s2_illegal_stream(spark, d):
    return J.rejected_events(spark, _lifecycle_sink(spark, d)).drop("ts")


def _logins(events):
    return events.filter("event_type IN ('error', 'purchase')").select("event_id", "user_id", "ts", (F.col("event_type") == "purchase").alias("success"))


_LOCKOUT = """WITH RECURSIVE a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY told, event_id) AS rn FROM (SELECT user_id, event_id, epoch_us(ts) AS told, event_type = 'purchase' AS ok FROM events WHERE event_type IN ('error', 'purchase'))),
 f(user_id, rn, event_id, n, until, outcome) AS (
 SELECT user_id, 0::BIGINT, NULL::BIGINT, 0::BIGINT, 0::BIGINT, NULL::VARCHAR FROM a WHERE rn = 1
 UNION ALL SELECT a.user_id, a.rn, a.event_id, CASE WHEN f.until > a.told THEN f.n WHEN a.ok THEN 0 ELSE f.n + 1 END,
  CASE WHEN f.until > a.told THEN f.until WHEN a.ok THEN 0 WHEN f.n + 1 >= 5 THEN a.told + 900000000 ELSE f.until END,
  CASE WHEN f.until > a.told THEN 'LOCKED' WHEN a.ok THEN 'SUCCESS' WHEN f.n + 1 >= 5 THEN 'WRONG_PASSWORD_LOCKS' ELSE 'WRONG_PASSWORD' END
 FROM f JOIN a ON a.user_id = f.user_id AND a.rn = f.rn + 1)
SELECT user_id, event_id, outcome, n AS failed_attempts FROM f WHERE rn > 0"""


@query("s3_lockout_batch", _LOCKOUT)
def s3_lockout_batch(spark, d):
    return J.lockout_batch(_logins(V.table(spark, d, "events")))


@query("s3_lockout_stream", _LOCKOUT)
def s3_lockout_stream(spark, d):
    base = workspace(spark)
    out = J.lockout_stream(_logins(_stream(spark, d, "events")))
    J.run_available(out, lambda batch, n: batch.write.mode("overwrite").parquet(f"{base}/out/batch={n}"), f"{base}/state")
    return spark.read.parquet(f"{base}/out").drop("batch")


@query(
    "s4_live_dashboard",
    with_views(
        "",
        """SELECT exam_id, count(*) AS total_submissions, count(*) FILTER (WHERE s='F') AS completed_submissions, count(*) FILTER (WHERE s='P') AS failed_submissions, count(*) FILTER (WHERE s='F' AND m >= 90) AS score_90_100,
 count(*) FILTER (WHERE s='F' AND m < 60) AS score_below_60 FROM (SELECT (year(o_orderdate)*100+month(o_orderdate))::BIGINT AS exam_id, o_orderstatus AS s, (o_custkey % 101)::DOUBLE AS m FROM orders) GROUP BY 1""",
    ),
)
def s4_live_dashboard(spark, d):
    base = workspace(spark)
    o = _stream(spark, d, "orders")
    rows = o.select(
        (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("bigint").alias("exam_id"),
        F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "PROCESSING").otherwise("FAILED").alias("status"),
        (F.col("o_custkey") % 101).cast("double").alias("obtained_marks"),
        F.lit(100.0).alias("total_marks"),
        F.lit(0.9).alias("evaluation_confidence"),
        F.lit(None).cast("string").alias("document_mode"),
        F.lit(None).cast("string").alias("evaluation_mode"),
        F.lit(None).cast("string").alias("answer_key_url"),
        F.lit(False).alias("has_document"),
        F.lit(1.0).alias("fairness_score"),
        F.lit(True).alias("fairness_verified"),
    )
    J.run_available(J.live_dashboard(rows), lambda batch, n: batch.write.mode("overwrite").parquet(f"{base}/out"), f"{base}/state", "complete")
    return spark.read.parquet(f"{base}/out").select("exam_id", "total_submissions", "completed_submissions", "failed_submissions", "score_90_100", "score_below_60")
