"""Registered queries: learning analytics, mark arithmetic, agreement statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from marklake.operators import audit as A
from marklake.operators import confidence as C
from marklake.operators import learning as L
from marklake.operators import marks as M
from marklake.plans import views as V
from marklake.plans.common import Catalog
from marklake.plans.views import r, with_views
from marklake.session import checkpointed

query = Catalog()

_BY_SUBMISSION, _BY_STUDENT = "question_order", "history_order"


def _student_questions(spark, d):
    owner = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("submission_id"), F.col("o_custkey").alias("student_id"))
    pooled = F.col("submission_id") * 100 + F.col("question_order")
    return V.question_evaluations(spark, d).join(owner, "submission_id").withColumn("history_order", pooled)


def _learning_ctes(key: str) -> str:
    source = "qe" if key == "submission_id" else "(SELECT qe.*, o_custkey AS student_id FROM qe JOIN orders ON submission_id = o_orderkey)"
    seen = "question_order" if key == "submission_id" else "submission_id * 100 + question_order"
    status = "CASE WHEN mastery_score >= 0.8 THEN 'MASTERED' WHEN mastery_score >= 0.5 THEN 'DEVELOPING' WHEN mastery_score >= 0.3 THEN 'WEAK' ELSE 'CRITICAL' END AS status"
    return f"""m AS (SELECT *, {status} FROM (SELECT {key}, topic,
 {r("greatest(0, least(1, sum(score_awarded)/sum(max_marks)))", 4)} AS mastery_score, {r("avg(confidence)", 4)} AS confidence, min({seen}) AS first_seen
 FROM {source} GROUP BY {key}, topic)),
 g AS (SELECT *, CASE WHEN missing_count/expected_count::DOUBLE >= 0.6 THEN 'HIGH' WHEN missing_count/expected_count::DOUBLE >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS severity
 FROM (SELECT {key}, topic, count(*) FILTER (WHERE missing) AS missing_count, count(*) AS expected_count,
  list_sort(list(concept) FILTER (WHERE missing)) AS missing_concepts, min(seen) AS first_seen
  FROM (SELECT {key}, topic, concept, bool_or(concept_missing) AS missing, min({seen}) AS seen FROM {source} GROUP BY {key}, topic, concept)
  GROUP BY {key}, topic) WHERE missing_count > 0),
 rec AS (SELECT {key}, rec, row_number() OVER (PARTITION BY {key} ORDER BY kind, first_seen, rec) AS position FROM (
  SELECT {key}, CASE status WHEN 'CRITICAL' THEN 1 WHEN 'WEAK' THEN 2 ELSE 3 END AS kind, first_seen,
   CASE status WHEN 'CRITICAL' THEN 'Prioritize re-learning the core components of ''' || topic || ''' as performance is critical.'
    WHEN 'WEAK' THEN 'Review and practice questions under the topic ''' || topic || ''' to build foundation.'
    ELSE 'Reinforce your understanding of ''' || topic || ''' with target exercises to achieve full mastery.' END AS rec FROM m WHERE status <> 'MASTERED'
  UNION ALL SELECT {key}, 4, first_seen, CASE severity WHEN 'HIGH' THEN 'Focus on key missing concepts in ''' || topic || ''': ' || array_to_string(missing_concepts[1:3], ', ') || '.'
    ELSE 'Study specific details of ' || array_to_string(missing_concepts[1:2], ', ') || ' in ''' || topic || '''.' END FROM g WHERE severity <> 'LOW')),
 adv AS (SELECT {key}, position, rec FROM rec WHERE position <= 5 UNION ALL SELECT DISTINCT {key}, 1, '{L.PRAISE}' FROM m WHERE {key} NOT IN (SELECT {key} FROM rec))"""


def _mastery_sql(key: str) -> str:
    return with_views("qe", f"SELECT {key}, topic, mastery_score, confidence, status FROM m", _learning_ctes(key))


def _gaps_sql(key: str) -> str:
    return with_views("qe", f"SELECT {key}, topic, array_to_string(missing_concepts, ', ') AS missing_concepts, severity FROM g", _learning_ctes(key))


def _advice_sql(key: str) -> str:
    return with_views("qe", f"SELECT {key}, position, rec AS recommendation FROM adv", _learning_ctes(key))


def _analysis_sql(key: str) -> str:
    return with_views(
        "qe",
        f"""SELECT s.*, a.recommendations, coalesce(k.gap_topics, '') AS gap_topics FROM (SELECT {key},
 {r("list_reduce(list_prepend(0.0::DOUBLE, list(mastery_score ORDER BY first_seen, topic)), lambda x, y: x + y) / count(*)", 4)} AS overall_mastery,
 coalesce(string_agg(topic, ' | ' ORDER BY first_seen, topic) FILTER (WHERE status='MASTERED'), '') AS mastered_topics,
 coalesce(string_agg(topic, ' | ' ORDER BY first_seen, topic) FILTER (WHERE status IN ('WEAK','CRITICAL')), '') AS weak_topics FROM m GROUP BY {key}) s
 JOIN (SELECT {key}, string_agg(rec, ' | ' ORDER BY position) AS recommendations FROM adv GROUP BY {key}) a USING ({key})
 LEFT JOIN (SELECT {key}, string_agg(topic || ':' || severity, ' | ' ORDER BY first_seen, topic) AS gap_topics FROM g GROUP BY {key}) k USING ({key})""",
        _learning_ctes(key),
    )


def _flat_analysis(df, key):
    gap_text = F.transform("knowledge_gaps", lambda g: F.concat(g["topic"], F.lit(":"), g["severity"]))
    return df.select(
        key,
        "overall_mastery",
        F.array_join("mastered_topics", " | ").alias("mastered_topics"),
        F.array_join("weak_topics", " | ").alias("weak_topics"),
        F.array_join("recommendations", " | ").alias("recommendations"),
        F.coalesce(F.array_join(gap_text, " | "), F.lit("")).alias("gap_topics"),
    )


@query("d10_topic_mastery", _mastery_sql("submission_id"))
def d10_topic_mastery(spark, d):
    return L.topic_mastery(V.question_evaluations(spark, d), ["submission_id"], _BY_SUBMISSION).drop("first_seen")


@query("d11_knowledge_gaps", _gaps_sql("submission_id"))
def d11_knowledge_gaps(spark, d):
    gaps = L.knowledge_gaps(V.question_evaluations(spark, d), ["submission_id"], _BY_SUBMISSION)
    return gaps.select("submission_id", "topic", F.array_join("missing_concepts", ", ").alias("missing_concepts"), "severity")


@query("d12_submission_analytics", _analysis_sql("submission_id"))
def d12_submission_analytics(spark, d):
    return _flat_analysis(L.analyze(V.question_evaluations(spark, d), ["submission_id"], _BY_SUBMISSION), "submission_id")


@query("d13_student_history", _analysis_sql("student_id"))
def d13_student_history(spark, d):
    return _flat_analysis(L.analyze(_student_questions(spark, d), ["student_id"], _BY_STUDENT), "student_id")


@query("h32_recommendations", _advice_sql("student_id"))
def h32_recommendations(spark, d):
    q = _student_questions(spark, d)
    mastery = checkpointed(L.topic_mastery(q, ["student_id"], _BY_STUDENT))
    return L.recommendations(mastery, L.knowledge_gaps(q, ["student_id"], _BY_STUDENT), ["student_id"]).withColumn(
        "position", F.col("position").cast("bigint")
    )


# --- marks --------------------------------------------------------------------

_RANKED = """ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id, group_id, matched ORDER BY marks DESC, value_point_id) AS rk,
 row_number() OVER (PARTITION BY question_id, group_id ORDER BY marks DESC, value_point_id) AS ra FROM vpm),
 grp AS (SELECT question_id, group_id, max(max_marks) AS mm, bool_or(uncalibrated) AS unc, CASE WHEN max(group_rule) = 'ANY_N'
  THEN least(coalesce(sum(marks) FILTER (WHERE matched AND rk <= group_n), 0), coalesce(sum(marks) FILTER (WHERE ra <= group_n), 0))
  ELSE coalesce(sum(marks) FILTER (WHERE matched), 0) END AS t FROM ranked GROUP BY question_id, group_id)"""


@query(
    "d17_question_marks",
    with_views(
        "vpm",
        f"""SELECT question_id, sum(t) AS uncapped, {r("greatest(0, least(max(mm), sum(t)))", 4)} AS total, max(mm) AS max_marks,
 bool_or(unc) AS uncalibrated FROM grp GROUP BY question_id""",
        _RANKED,
    ),
)
def d17_question_marks(spark, d):
    return M.question_marks(V.value_point_matches(spark, d), ["question_id"])


@query(
    "e7_award_lines",
    with_views(
        "vpm",
        """SELECT question_id, value_point_id, CASE WHEN matched AND NOT (coalesce(group_rule,'')='ANY_N' AND rk > group_n) THEN marks ELSE 0 END AS awarded,
 CASE WHEN group_rule='ANY_N' AND matched AND rk > group_n THEN 'matched, but outside the best ' || group_n || ' for this group'
 WHEN matched THEN 'evidence found by EXACT' ELSE 'no supporting evidence found in the answer' END AS reason FROM ranked""",
        _RANKED,
    ),
)
def e7_award_lines(spark, d):
    points = (
        V.value_point_matches(spark, d)
        .withColumn("method", F.lit("EXACT"))
        .withColumn("reason", F.lit(None).cast("string"))
    )
    return M.award_lines(points, ["question_id"], "value_point_id").select("question_id", "value_point_id", "awarded", "reason")


@query(
    "c14_evidence_integrity",
    with_views("vpm", "SELECT question_id, count(*) AS n_evidence, count(*) FILTER (WHERE matched) AS n_matched FROM vpm GROUP BY question_id"),
)
def c14_evidence_integrity(spark, d):
    scheme = V.value_point_matches(spark, d).select("question_id", "value_point_id").distinct()
    checked = M.reject_unknown_value_points(V.value_point_matches(spark, d), scheme)
    return checked.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_evidence"), F.count_if("matched").alias("n_matched"))


# --- scores and confidence per submission ----------------------------------------


@query(
    "d15_submission_totals",
    with_views(
        "qe",
        f"""SELECT submission_id, {r("sum(score_awarded)")} AS total_score, {r("sum(max_marks)")} AS max_possible,
 {r("greatest(0, least(100, sum(score_awarded)/sum(max_marks)*100))")} AS normalized_score FROM qe GROUP BY submission_id""",
    ),
)
def d15_submission_totals(spark, d):
    return C.submission_totals(V.question_evaluations(spark, d))


@query(
    "d15_score_breakdown",
    with_views("qe", "SELECT submission_id, question_number, sum(score_awarded) AS score FROM qe GROUP BY 1, 2"),
)
def d15_score_breakdown(spark, d):
    return C.score_breakdown(V.question_evaluations(spark, d))


@query(
    "d16_submission_confidence",
    with_views(
        "qe",
        f"""SELECT submission_id, c AS confidence_score, CASE WHEN c >= 0.70 THEN 'COMPLETED' ELSE 'PENDING_REVIEW' END AS status FROM (
 SELECT submission_id, {r("greatest(0, least(1, 0.9::DOUBLE*0.4::DOUBLE + avg(confidence)*0.6::DOUBLE - count(*) FILTER (WHERE NOT bias_free)*0.1::DOUBLE))")} AS c FROM qe GROUP BY 1)""",
    ),
)
def d16_submission_confidence(spark, d):
    q = V.question_evaluations(spark, d).withColumn("n_discrepancies", F.when(F.col("bias_free"), 0).otherwise(1)).withColumn("ocr_confidence", F.lit(0.9))
    return C.submission_confidence(q)


@query(
    "d18_submission_fairness",
    with_views(
        "qe",
        f"""SELECT submission_id, least(1, min(bias_score)) AS fairness_score, bool_and(bias_free) AS fairness_verified,
 {r("avg(coalesce(concept_coverage, 0))")} AS concept_coverage FROM qe GROUP BY 1""",
    ),
)
def d18_submission_fairness(spark, d):
    return C.submission_fairness(V.question_evaluations(spark, d))


@query(
    "c11_verification",
    with_views(
        "qe",
        f"""SELECT submission_id, question_number, status, {r("sd", 4)} AS score_difference, {r("cd", 4)} AS confidence_difference,
 CASE WHEN status='PASS' THEN 'NONE' WHEN status='LOW_CONFIDENCE' THEN 'CONFIDENCE_INCONSISTENCY' WHEN diff THEN 'MISSING_CONCEPT_DIFFERENCE' ELSE 'SEMANTIC_INTERPRETATION' END AS root_cause,
 status IN ('MAJOR_DISAGREEMENT','LOW_CONFIDENCE') AS review_required,
 CASE status WHEN 'PASS' THEN 'Evaluations are aligned.' WHEN 'LOW_CONFIDENCE' THEN 'Confidence gap of ' || format('{{:.2f}}', cd) || ' detected between primary and secondary engines.'
 WHEN 'MODERATE_DISAGREEMENT' THEN 'Moderate score difference of ' || format('{{:.2f}}', sd) || ' marks detected. Likely due to ' || CASE WHEN diff THEN 'MISSING_CONCEPT_DIFFERENCE' ELSE 'SEMANTIC_INTERPRETATION' END || '.'
 ELSE 'Major score difference of ' || format('{{:.2f}}', sd) || ' marks detected. Immediate review required.' END AS reason
 FROM (SELECT *, CASE WHEN sd > 2 THEN 'MAJOR_DISAGREEMENT' WHEN sd > 0.5 THEN 'MODERATE_DISAGREEMENT' WHEN cd > 0.30 THEN 'LOW_CONFIDENCE' ELSE 'PASS' END AS status
  FROM (SELECT *, abs(score_awarded - s2) AS sd, abs(confidence - c2) AS cd, concept_missing AND question_number LIKE '%2-%' AS diff
   FROM (SELECT *, CASE WHEN bias_free THEN score_awarded + CASE WHEN concept_missing THEN 1 ELSE 0 END ELSE score_awarded - 2.5 END AS s2,
     CASE WHEN max_marks > 25 THEN confidence - 0.375 ELSE confidence END AS c2 FROM qe)))""",
    ),
)
def c11_verification(spark, d):
    q = V.question_evaluations(spark, d)
    missing = F.when(F.size("missing_concepts") > 0, F.col("missing_concepts")).otherwise(F.array().cast("array<string>"))
    primary = q.select("submission_id", "question_number", "score_awarded", "confidence", missing.alias("missing_concepts"))
    shifted = F.when(F.col("question_number").like("%2-%"), F.array().cast("array<string>")).otherwise(
        F.transform(missing, lambda c: F.concat(F.lit(" "), F.upper(c)))
    )
    secondary = q.select(
        "submission_id",
        "question_number",
        F.when(F.col("bias_free"), F.col("score_awarded") + F.when(F.size(missing) > 0, 1).otherwise(0))
        .otherwise(F.col("score_awarded") - 2.5)
        .alias("score"),
        F.when(F.col("max_marks") > 25, F.col("confidence") - 0.375).otherwise(F.col("confidence")).alias("secondary_confidence"),
        shifted.alias("secondary_missing"),
    )
    return C.verify(primary, secondary, ["submission_id", "question_number"])


@query(
    "h25_question_confidence",
    with_views(
        "qe",
        f"""SELECT submission_id, question_number, {r("greatest(0, least(1, c*0.30::DOUBLE + s*0.25::DOUBLE + x*0.20::DOUBLE + 0.9*0.15::DOUBLE + bias_score*0.10::DOUBLE - least(d*0.05::DOUBLE, 0.25::DOUBLE)))", 4)} AS overall_confidence,
 {r("c", 4)} AS concept_coverage_score, {r("s", 4)} AS semantic_alignment_score, {r("x", 4)} AS explainability_score, 0.9::DOUBLE AS ocr_confidence, {r("bias_score", 4)} AS fairness_score
 FROM (SELECT *, CASE WHEN has_semantic THEN greatest(0, least(1, c * confidence * (1.0::DOUBLE - CASE WHEN concept_missing THEN 0.05::DOUBLE ELSE 0 END))) ELSE 0.5 END AS x
  FROM (SELECT *, CASE WHEN coalesce(concept_coverage,0) > 1 THEN concept_coverage/100.0::DOUBLE ELSE coalesce(concept_coverage,0) END AS c, score_awarded/max_marks AS s,
   CASE WHEN bias_free THEN 0 ELSE 7 END AS d FROM qe))""",
    ),
)
def h25_question_confidence(spark, d):
    missing = F.when(F.size("missing_semantic") > 0, F.array(F.lit("not discussed"))).otherwise(F.array().cast("array<string>"))
    explained = F.struct(
        F.coalesce("concept_coverage", F.lit(0.0)).alias("coverage_percentage"),
        F.array(F.struct(F.col("confidence"))).alias("evidence"),
        missing.alias("missing_reasoning"),
    )
    q = V.question_evaluations(spark, d).select(
        "submission_id",
        "question_number",
        F.lit(0.9).alias("ocr"),
        F.coalesce("concept_coverage", F.lit(0.0)).alias("coverage"),
        (F.col("score_awarded") / F.col("max_marks")).alias("semantic"),
        F.when(F.col("has_semantic"), explained).alias("explainability"),
        F.col("bias_score").alias("fairness"),
        F.when(F.col("bias_free"), 0).otherwise(7).alias("discrepancies"),
    )
    b = C.question_confidence(
        F.col("ocr"), F.col("coverage"), F.col("semantic"), F.col("explainability"), F.col("fairness"), F.col("discrepancies")
    )
    return q.select("submission_id", "question_number", *[x.alias(k) for k, x in b.items()])


# --- agreement -----------------------------------------------------------------


def _stats(where: str, engine: str, group: str = "", source: str = "obs", extra: str = "") -> str:
    """Agreement statistics in SQL; kappa from the level histograms (confusion-matrix form)."""
    keys = f"{group}, " if group else ""
    by = f"GROUP BY {group}" if group else ""
    on = f"USING ({group})" if group else "ON true"
    return f"""p AS (SELECT {keys}human_mark AS h, {engine} AS e, max_marks FROM {source} WHERE {engine} IS NOT NULL {where}),
 hh AS (SELECT {keys}round_even(h*2,0) AS l, count(*) AS c FROM p GROUP BY ALL), ee AS (SELECT {keys}round_even(e*2,0) AS l, count(*) AS c FROM p GROUP BY ALL),
 den AS (SELECT {('hh.' + group + ', ') if group else ''}sum(hh.c*ee.c*(hh.l-ee.l)*(hh.l-ee.l)) AS den FROM hh JOIN ee {on} {('GROUP BY hh.' + group) if group else ''}),
 agg AS (SELECT {keys}count(*) AS n, avg(CASE WHEN abs(h-e) < 1e-9 THEN 1.0::DOUBLE ELSE 0 END) AS exact_agreement, avg(CASE WHEN abs(h-e) <= 1+1e-9 THEN 1.0::DOUBLE ELSE 0 END) AS within_one,
 sum(abs(h-e))/count(*) AS mae, avg(abs(h-e)/max_marks) AS mae_fraction, sum(e-h)/count(*) AS directional_bias, sum((h-e)*(h-e)*4) AS num,
 greatest(max(h),max(e)) > least(min(h),min(e)) AS spread FROM p {by}),
 st AS (SELECT agg.* EXCLUDE (num, spread), CASE WHEN spread AND den <> 0 THEN 1 - num*n/den END AS qwk FROM agg JOIN den {on})"""


_R6 = ("exact_agreement", "within_one", "mae", "mae_fraction", "qwk", "directional_bias")


def _r6(columns=_R6) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


def _round6(df, columns=_R6):
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df


@query("d20_agreement_arm_a", with_views("obs", f"SELECT n, {_r6()} FROM st", _stats("", "engine_mark_a")))
def d20_agreement_arm_a(spark, d):
    return _round6(A.agreement(V.observations(spark, d), "engine_mark_a"))


@query("d21_kappa_by_subject", with_views("obs", f"SELECT subject, n, {_r6()} FROM st", _stats("", "engine_mark_b", "subject")))
def d21_kappa_by_subject(spark, d):
    return _round6(A.agreement(V.observations(spark, d), "engine_mark_b", ["subject"]))


@query(
    "d22_error_decomposition",
    with_views(
        "obs",
        """SELECT n, m AS marking_error_marks, greatest(0, b-m) AS ocr_induced_marks, round(m/(m+greatest(0,b-m)), 9) AS marking_share,
 round(greatest(0,b-m)/(m+greatest(0,b-m)), 9) AS ocr_share FROM (SELECT count(*) AS n, sum(abs(human_mark-engine_mark_a)) AS m, sum(abs(human_mark-engine_mark_b)) AS b
 FROM obs WHERE engine_mark_a IS NOT NULL AND engine_mark_b IS NOT NULL)""",
    ),
)
def d22_error_decomposition(spark, d):
    out = A.decomposition(V.observations(spark, d))
    return out.withColumn("marking_share", F.round("marking_share", 9)).withColumn("ocr_share", F.round("ocr_share", 9))


_NO_FRAC = tuple(c for c in _R6 if c != "mae_fraction")


@query("d23_human_ceiling", with_views("obs", f"SELECT n, {_r6(_NO_FRAC)} FROM st", _stats("", "second_human_mark")))
def d23_human_ceiling(spark, d):
    return _round6(A.human_ceiling(V.observations(spark, d)), _NO_FRAC)


def _decile(x: str) -> str:
    return f"least(floor(greatest(0, least(1, {x}/max_marks))*10)*10, 90)::BIGINT"


@query(
    "d24_mark_distribution",
    with_views(
        "obs",
        f"""SELECT decile || '-' || (decile+10) || '%' AS decile, count(*) FILTER (WHERE who='human') AS human, count(*) FILTER (WHERE who='engine') AS engine
 FROM (SELECT 'human' AS who, {_decile('human_mark')} AS decile FROM obs UNION ALL SELECT 'engine', {_decile('engine_mark_b')} FROM obs WHERE engine_mark_b IS NOT NULL) GROUP BY decile""",
    ),
)
def d24_mark_distribution(spark, d):
    return A.mark_distribution(V.observations(spark, d), "engine_mark_b")


@query(
    "d25_breakdown",
    with_views(
        "obs",
        """SELECT CASE grouping(subject, question_type, question_number) WHEN 7 THEN 'OVERALL' WHEN 3 THEN 'SUBJECT' WHEN 5 THEN 'TYPE' ELSE 'QUESTION' END AS breakdown,
 subject, question_type, question_number, count(*) AS n, round(avg((abs(g)<1e-9)::INT), 6) AS exact_agreement, round(avg((abs(g)<=1+1e-9)::INT), 6) AS within_one,
 round(avg(abs(g)), 6) AS mae, round(avg(abs(g)/max_marks), 6) AS mae_fraction,
 round(1 - sum(4*g*g)/(sum(4*h*h)+sum(4*e*e)-2*sum(2*h)*sum(2*e)/count(*)), 6) AS qwk, round(avg(g), 6) AS directional_bias
 FROM (SELECT *, engine_mark_a - human_mark AS g, human_mark AS h, engine_mark_a AS e FROM obs)
 GROUP BY GROUPING SETS ((), (subject), (question_type), (question_number))""",
    ),
)
def d25_breakdown(spark, d):
    return _round6(A.breakdown(V.observations(spark, d), "engine_mark_a"))


_RESAMPLES, _SEED = 200, 20260815


@query(
    "d26_cluster_bootstrap",
    with_views(
        "obs",
        f"""SELECT u.statistic, round(u.value, 6) AS value, round(lo.value, 6) AS low, round(hi.value, 6) AS high, (SELECT n FROM cnt) AS n_clusters, (SELECT count(*) FROM obs) AS n_observations
 FROM pt u LEFT JOIN rk lo ON lo.statistic = u.statistic AND lo.i = floor(0.025000000000000022*lo.valid)
 LEFT JOIN rk hi ON hi.statistic = u.statistic AND hi.i = least(hi.valid-1, floor(0.975*hi.valid))""",
        f"""scr AS (SELECT script_id, row_number() OVER (ORDER BY script_id) - 1 AS idx, count(*) AS n, sum((abs(g)<1e-9)::INT) AS x, sum((abs(g)<=1+1e-9)::INT) AS w, sum(abs(g)) AS a,
  sum(g) AS b, sum(abs(g)/max_marks) AS f, sum(2*h) AS sh, sum(2*e) AS se, sum(4*h*h) AS shh, sum(4*e*e) AS see, sum(4*g*g) AS sgg
  FROM (SELECT *, engine_mark_a - human_mark AS g, human_mark AS h, engine_mark_a AS e FROM obs) GROUP BY script_id),
 cnt AS (SELECT count(*) AS n FROM scr),
 drawn AS (SELECT b, ('0x' || substr(md5('{_SEED}-' || b || '-' || i), 1, 8))::BIGINT % (SELECT n FROM cnt) AS idx
  FROM range({_RESAMPLES}) t(b), range((SELECT n FROM cnt)) s(i)),
 tot AS (SELECT drawn.b AS rs, sum(n) AS n, sum(x) AS x, sum(w) AS w, sum(a) AS a, sum(scr.b) AS b, sum(f) AS f, sum(sh) AS sh, sum(se) AS se, sum(shh) AS shh, sum(see) AS see, sum(sgg) AS sgg
  FROM drawn JOIN scr USING (idx) GROUP BY drawn.b UNION ALL SELECT -1, sum(n), sum(x), sum(w), sum(a), sum(b), sum(f), sum(sh), sum(se), sum(shh), sum(see), sum(sgg) FROM scr),
 vals AS (SELECT rs, unnest(['exact_agreement','within_one','mae','mae_fraction','qwk','directional_bias']) AS statistic,
  unnest([x/n::DOUBLE, w/n::DOUBLE, a/n, f/n, 1 - sgg/(shh+see-2*sh*se/n), b/n]) AS value FROM tot),
 pt AS (SELECT statistic, value FROM vals WHERE rs = -1),
 rk AS (SELECT statistic, value, row_number() OVER (PARTITION BY statistic ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY statistic) AS valid FROM vals WHERE rs >= 0)""",
    ),
)
def d26_cluster_bootstrap(spark, d):
    return _round6(A.cluster_bootstrap(V.observations(spark, d), "engine_mark_a", _RESAMPLES, seed=_SEED), ("value", "low", "high"))


def _weighted_sql(key: str) -> str:
    """D26 by weights, per value of a key (or over all, for an empty one)."""
    k, by = (f"{key}, ", f"USING ({key}, statistic)") if key else ("", "USING (statistic)")
    sums = ", ".join(f"sum({{w}}{c}) AS {c}" for c in ("n", "x", "w1", "a", "b", "f", "sh", "se", "shh", "see", "sgg"))
    stats = "[x/n::DOUBLE, w1/n::DOUBLE, a/n, f/n, 1 - sgg/(shh+see-2*sh*se/n), b/n]"
    weight = " + ".join(f"(u >= {t})::INT" for t in A._POISSON)
    return with_views(
        "obs",
        f"""SELECT {k}statistic, round(value, 6) AS value, round(low, 6) AS low, round(high, 6) AS high, n_clusters, n_observations FROM pt LEFT JOIN bd {by}""",
        f"""scr AS (SELECT {k}script_id, count(*) AS n, sum((abs(g)<1e-9)::INT) AS x, sum((abs(g)<=1+1e-9)::INT) AS w1, sum(abs(g)) AS a,
  sum(g) AS b, sum(abs(g)/max_marks) AS f, sum(2*h) AS sh, sum(2*e) AS se, sum(4*h*h) AS shh, sum(4*e*e) AS see, sum(4*g*g) AS sgg, count(*) AS n_rows,
  md5('{_SEED}-' || script_id) AS m FROM (SELECT *, engine_mark_a - human_mark AS g, human_mark AS h, engine_mark_a AS e FROM obs) GROUP BY {k}script_id),
 hs AS (SELECT *, ('0x' || substr(m, 1, 8))::BIGINT % {A._PRIME} AS h1, ('0x' || substr(m, 9, 8))::BIGINT % {A._PRIME - 1} + 1 AS h2 FROM scr),
 dr AS (SELECT *, {weight} AS wt FROM (SELECT hs.*, rs, (h1 + rs * h2) % {A._PRIME} AS u FROM hs, range({_RESAMPLES}) t(rs))),
 tot AS (SELECT {k}rs, {sums.format(w="wt*")} FROM dr WHERE wt > 0 GROUP BY {k}rs),
 al AS (SELECT {k}{sums.format(w="")}, count(*) AS n_clusters, sum(n_rows)::BIGINT AS n_observations FROM scr {"GROUP BY " + key if key else ""}),
 pt AS (SELECT {k}n_clusters, n_observations, unnest({list(A.STATISTICS)}) AS statistic, unnest({stats}) AS value FROM al),
 vals AS (SELECT {k}unnest({list(A.STATISTICS)}) AS statistic, unnest({stats}) AS value FROM tot),
 rk AS (SELECT {k}statistic, value, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY {k}statistic) AS valid FROM vals WHERE value IS NOT NULL AND NOT isnan(value) WINDOW w AS (PARTITION BY {k}statistic ORDER BY value)),
 bd AS (SELECT {k}statistic, max(value) FILTER (i = floor(0.025000000000000022*valid) AND valid >= {_RESAMPLES}*0.5) AS low, max(value) FILTER (i = least(valid-1, floor(0.975*valid)) AND valid >= {_RESAMPLES}*0.5) AS high FROM rk GROUP BY {k}statistic)""",
    )


@query("d26_weighted_bootstrap", _weighted_sql(""))
def d26_weighted_bootstrap(spark, d):
    return _round6(A.weighted_bootstrap(V.observations(spark, d), "engine_mark_a", [], _RESAMPLES, seed=_SEED), ("value", "low", "high"))


@query("d26_intervals_by_subject", _weighted_sql("subject"))
def d26_intervals_by_subject(spark, d):
    return _round6(A.weighted_bootstrap(V.observations(spark, d), "engine_mark_a", ["subject"], _RESAMPLES, seed=_SEED), ("value", "low", "high"))


@query("d26_intervals_by_type", _weighted_sql("question_type"))
def d26_intervals_by_type(spark, d):
    return _round6(A.weighted_bootstrap(V.observations(spark, d), "engine_mark_a", ["question_type"], _RESAMPLES, seed=_SEED), ("value", "low", "high"))


@query(
    "d28_outliers",
    with_views(
        "subs",
        """SELECT submission_id, student_id, obtained_marks, round(z, 6) AS modified_z FROM (SELECT *, 0.6745*abs(obtained_marks-med)/mad AS z FROM (
 SELECT *, median(abs(obtained_marks-med)) OVER (PARTITION BY student_id) AS mad, count(*) OVER (PARTITION BY student_id) AS n FROM (
 SELECT submission_id, student_id, obtained_marks, median(obtained_marks) OVER (PARTITION BY student_id) AS med FROM subs WHERE obtained_marks IS NOT NULL)) WHERE n >= 3 AND mad > 0) WHERE z > 3.5""",
    ),
)
def d28_outliers(spark, d):
    scores = V.submissions(spark, d).select("submission_id", "student_id", "obtained_marks").filter("obtained_marks is not null")
    out = A.outliers(scores, ["student_id"], "obtained_marks")
    return out.select("submission_id", "student_id", "obtained_marks", F.round("modified_z", 6).alias("modified_z"))


@query(
    "d28_exam_medians",
    with_views("subs", "SELECT exam_id, count(obtained_marks) AS n, median(obtained_marks) AS median FROM subs WHERE obtained_marks IS NOT NULL GROUP BY exam_id"),
)
def d28_exam_medians(spark, d):
    from marklake.functions.scan import exact_median

    return exact_median(V.submissions(spark, d), ["exam_id"], "obtained_marks")


@query(
    "d29_history_consistency",
    with_views(
        "subs",
        """SELECT submission_id, student_id, past_n, round(z, 6) AS z_score, coalesce(z <= 3, true) AS consistent FROM (
 SELECT *, CASE WHEN past_n >= 3 AND spread > 0 THEN abs(past_n*coalesce(obtained_marks,0) - s)/sqrt(spread) END AS z FROM (
 SELECT *, greatest(0, past_n*ss - s*s) AS spread FROM (
 SELECT submission_id, student_id, obtained_marks, count(obtained_marks) OVER w AS past_n, sum(obtained_marks) OVER w AS s, sum(obtained_marks*obtained_marks) OVER w AS ss
 FROM subs WINDOW w AS (PARTITION BY student_id ORDER BY updated_at, submission_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))))""",
    ),
)
def d29_history_consistency(spark, d):
    subs = V.submissions(spark, d).select("submission_id", "student_id", "exam_id", "updated_at", "obtained_marks")
    out = A.history_consistency(subs, ["student_id"], "exam_id", ["updated_at", "submission_id"], "obtained_marks")
    return out.select("submission_id", "student_id", F.col("past_n").cast("bigint").alias("past_n"), F.round("z_score", 6).alias("z_score"), "consistent")


@query(
    "c12_failure_ratchet",
    """SELECT user_id, event_type, change FROM (
 SELECT DISTINCT user_id, event_type, 'NEW_FAILURE' AS change FROM events WHERE value > 400 AND (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM events WHERE value BETWEEN 200 AND 260)
 UNION ALL SELECT DISTINCT user_id, event_type, 'FIXED' FROM events WHERE value BETWEEN 200 AND 260 AND (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM events WHERE value > 400))""",
)
def c12_failure_ratchet(spark, d):
    e = V.table(spark, d, "events")
    return A.ratchet(e.filter("value > 400"), e.filter("value BETWEEN 200 AND 260"), ["user_id", "event_type"])
