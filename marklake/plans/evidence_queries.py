"""Registered queries: evidence, autonomous scoring, explanations, feedback, retrieval."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marklake.functions import text as TX
from marklake.operators import autonomous as AU
from marklake.operators import evidence as E
from marklake.operators import feedback as FB
from marklake.operators import marks as M
from marklake.operators import retrieval as R
from marklake.plans import text_queries as TQ
from marklake.plans import views as V
from marklake.plans.common import Catalog
from marklake.plans.views import r, with_views
from marklake.session import checkpointed, spread

query = Catalog()


def schemes(spark, d):
    """Benchmark items as scheme questions; their sentences are the value points."""
    b = V.table(spark, d, "benchmark")
    sentences = F.filter(F.transform(F.split("text", r"[.\n]+"), TX.strip), lambda s: s != "")
    none = F.lit(None).cast("string")

    def point(s, i):
        grouped = i < 3
        return F.struct(
            F.concat(F.col("item_id").cast("string"), F.lit("."), (i + 1).cast("string")).alias("id"),
            s.alias("text"),
            F.when(i % 2 == 0, 1.0).otherwise(1.5).alias("marks"),
            F.array(F.array_join(F.slice(F.split(s, " "), 1, 3), " ")).alias("acceptable_variants"),
            F.when(i % 3 == 1, "STEP").otherwise("EXACT").alias("match_mode"),
            F.when(grouped, "g").alias("group_id"),
            F.when(grouped, "ANY_N").alias("group_rule"),
            F.when(grouped, 2).alias("group_n"),
            F.lit(None).cast("double").alias("expected_value"),
            F.lit(None).cast("double").alias("tolerance"),
            none.alias("unit"),
        )

    number = F.struct(
        F.concat(F.col("item_id").cast("string"), F.lit(".n")).alias("id"),
        F.lit("count").alias("text"),
        F.lit(0.5).alias("marks"),
        F.array().cast("array<string>").alias("acceptable_variants"),
        F.lit("NUMERIC").alias("match_mode"),
        none.alias("group_id"),
        none.alias("group_rule"),
        F.lit(None).cast("int").alias("group_n"),
        F.lit(5.0).alias("expected_value"),
        F.lit(3.0).alias("tolerance"),
        none.alias("unit"),
    )
    return b.select(
        F.col("item_id").cast("string").alias("question_id"),
        (F.col("item_id") + 1).cast("string").alias("question_number"),
        F.substring_index("text", ".", 1).alias("question_text"),
        F.lit(5.0).alias("max_marks"),
        F.concat(F.transform(sentences, point), F.array(number)).alias("value_points"),
    )


def answers(spark, d):
    return TQ.paired(spark, d).select("answer_id", F.col("item_id").cast("string").alias("question_id"), "answer_text")


_W = r"[\pL\pN_]"
_FOLD = "trim(regexp_replace(strip_accents(lower({})), '[^\\pL\\pN_]+', ' ', 'g'))"
_SCATTERED = "'evidence scattered - no single supporting passage'"
_FEW = "'insufficient evidence: matched ' || {0} || ' of ' || {1} || ' required content words (N_vp=' || {2} || ', M=ceil(' || {2} || '*0.4))'"

# Folding keeps each folded character's place; a phrase is sought in the folded text, then run together; failing that,
# the window that holds most of its content words. Options of a point: its text, then the first three words of it.
TEXT_EVIDENCE_SQL = f"""WITH {TQ.PAIRED},
 said AS (SELECT item_id, generate_subscripts(s, 1) AS i, unnest(s) AS text FROM (SELECT item_id, list_filter(list_transform(string_split_regex(text, '[.\\n]+'), lambda x: trim(x, e' \\t\\n\\r')), lambda x: x <> '') AS s FROM benchmark)),
 point AS (SELECT item_id, item_id || '.' || i AS vp, CASE WHEN i % 3 = 2 THEN 'STEP' ELSE 'EXACT' END AS mode, text, array_to_string(string_split(text, ' ')[1:3], ' ') AS variant FROM said),
 opt AS (SELECT item_id, vp, 1 AS o, text AS phrase FROM point UNION ALL SELECT item_id, vp, 2, variant FROM point WHERE variant <> text),
 opts AS (SELECT *, {_FOLD.format("phrase")} AS needle, len(list_filter(w, lambda x: length(x) > 1)) AS n, list_distinct(list_transform(list_filter(w, lambda x: length(x) > 1), lambda x: lower(x))) AS wanted,
   greatest(3 * length(phrase), 150) AS lim FROM (SELECT *, regexp_extract_all(phrase, '{_W}+') AS w FROM opt)),
 need AS (SELECT *, CASE WHEN n = 0 THEN 1 ELSE greatest(1, ceil(n * 0.4)::BIGINT) END AS req FROM opts),
 folded AS (SELECT answer_id, item_id, answer_text, keep, array_to_string(list_transform(keep, lambda i: m[i]), '') AS f, list_filter(keep, lambda i: m[i] <> ' ') AS kept
   FROM (SELECT *, list_filter(range(1, len(m) + 1), lambda i: NOT (m[i] = ' ' AND (i = 1 OR m[i - 1] = ' '))) AS keep
     FROM (SELECT answer_id, item_id, answer_text, list_transform(string_split(answer_text, ''), lambda c: CASE WHEN regexp_matches(c, '{_W}') THEN strip_accents(lower(c)) ELSE ' ' END) AS m FROM pr))),
 sought AS (SELECT a.answer_id, a.answer_text, k.*, instr(rtrim(a.f), needle) AS pos, instr(replace(a.f, ' ', ''), replace(needle, ' ', '')) AS sq, a.keep, a.kept FROM folded a JOIN need k USING (item_id)),
 spans AS (SELECT *, CASE WHEN needle = '' THEN NULL WHEN pos > 0 THEN keep[pos] WHEN sq > 0 THEN kept[sq] END AS a,
   CASE WHEN needle = '' THEN NULL WHEN pos > 0 THEN keep[pos + length(needle) - 1] WHEN sq > 0 THEN kept[sq + length(replace(needle, ' ', '')) - 1] END AS b FROM sought),
 leg1 AS (SELECT * EXCLUDE (keep, kept), CASE WHEN a IS NULL THEN NULL WHEN b - a + 1 > lim THEN {_SCATTERED} WHEN got < req THEN {_FEW.format("got", "req", "n")} END AS why
   FROM (SELECT *, len(regexp_extract_all(substring(answer_text, a, b - a + 1), '{_W}+')) AS got FROM spans)),
 token AS (SELECT answer_id, item_id, unnest(w) AS word, unnest(list_transform(range(1, len(w) + 1), lambda i: list_sum(list_transform(g[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0)::BIGINT)) AS st
   FROM (SELECT answer_id, item_id, regexp_extract_all(lower(answer_text), '{_W}+') AS w, string_split_regex(lower(answer_text), '{_W}+') AS g FROM pr)),
 hit AS (SELECT t.answer_id, k.vp, k.o, k.lim, t.st, t.st + length(t.word) AS en, t.word FROM token t JOIN (SELECT item_id, vp, o, lim, unnest(wanted) AS word FROM need) k USING (item_id, word)),
 edge AS (SELECT l.answer_id, l.vp, l.o, l.st, count(DISTINCT r.word) AS many FROM hit l JOIN hit r ON r.answer_id = l.answer_id AND r.vp = l.vp AND r.o = l.o AND r.st >= l.st AND r.en - l.st <= l.lim GROUP BY ALL),
 best AS (SELECT answer_id, vp, o, max(many) AS many, arg_min(st, (-many, st)) AS st FROM edge GROUP BY answer_id, vp, o),
 firsts AS (SELECT b.answer_id, b.vp, b.o, b.many, b.st, h.word, min(h.en) AS en FROM best b JOIN hit h ON h.answer_id = b.answer_id AND h.vp = b.vp AND h.o = b.o AND h.st >= b.st GROUP BY ALL),
 win AS (SELECT * EXCLUDE (ends), ends[many] AS en FROM (SELECT answer_id, vp, o, many, st, list_sort(list(en)) AS ends FROM firsts GROUP BY ALL)),
 met AS (SELECT answer_id, vp, o, count(DISTINCT word) AS words FROM hit GROUP BY ALL),
 sides AS (SELECT l.*, w.many, w.st, w.en, m.words FROM leg1 l LEFT JOIN win w USING (answer_id, vp, o) LEFT JOIN met m USING (answer_id, vp, o)),
 pair AS (SELECT x.answer_id, x.item_id, x.vp, CASE WHEN x.a IS NOT NULL AND x.why IS NULL THEN [x.a - 1, x.b] WHEN y.a IS NOT NULL AND y.why IS NULL THEN [y.a - 1, y.b]
     WHEN x.many >= x.req THEN [x.st, x.en] WHEN y.many >= y.req THEN [y.st, y.en] END AS span,
   coalesce(y.why, x.why) AS r1, x.words AS w1, x.many AS m1, x.req AS q1, x.n AS n1, y.words AS w2, y.many AS m2, y.req AS q2, y.n AS n2
   FROM sides x LEFT JOIN sides y ON y.answer_id = x.answer_id AND y.vp = x.vp AND y.o = 2 WHERE x.o = 1),
 told AS (SELECT *, CASE WHEN w1 IS NULL THEN r1 WHEN w1 >= q1 THEN {_SCATTERED} ELSE coalesce(r1, {_FEW.format("m1", "q1", "n1")}) END AS r2 FROM pair),
 num AS (SELECT answer_id, item_id, w, g, list_filter(range(1, len(w) + 1), lambda i: abs(w[i]::DOUBLE - 5) <= 3)[1] AS k FROM (SELECT *, regexp_extract_all(answer_text, '-?\\d+(?:\\.\\d+)?') AS w, string_split_regex(answer_text, '-?\\d+(?:\\.\\d+)?') AS g FROM pr)),
 numbers AS (SELECT *, list_sum(list_transform(g[1:k], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(w[1:k - 1], lambda x: length(x))), 0)::BIGINT AS st FROM num)
SELECT t.answer_id, t.item_id::VARCHAR AS question_id, t.vp AS value_point_id, span IS NOT NULL AS matched, span[1]::INTEGER AS span_start, span[2]::INTEGER AS span_end, p.mode AS method, CASE WHEN span IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS score, false AS uncalibrated,
 CASE WHEN span IS NULL THEN coalesce(CASE WHEN w2 IS NULL THEN r2 WHEN w2 >= q2 THEN {_SCATTERED} ELSE coalesce(r2, {_FEW.format("m2", "q2", "n2")}) END, 'no supporting evidence found in the answer') END AS reason
FROM told t JOIN point p ON p.vp = t.vp
UNION ALL SELECT answer_id, item_id::VARCHAR, item_id || '.n', k IS NOT NULL, CASE WHEN k IS NOT NULL THEN st END::INTEGER, CASE WHEN k IS NOT NULL THEN st + length(w[k]) END::INTEGER, 'NUMERIC', CASE WHEN k IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE, false, NULL FROM numbers"""


@query("h8_h11_text_evidence", TEXT_EVIDENCE_SQL)
def h8_h11_text_evidence(spark, d):
    from marklake.schemas import checked_evidence

    return checked_evidence(E.text_evidence(answers(spark, d), schemes(spark, d)))


# The first three points of a question are a group of which the best two count; a question has five marks.
MARKS_SQL = f"""WITH ev AS ({TEXT_EVIDENCE_SQL}),
 valued AS (SELECT *, CASE WHEN method = 'NUMERIC' THEN NULL ELSE split_part(value_point_id, '.', 2)::INT END AS i FROM ev),
 worth AS (SELECT *, CASE WHEN i IS NULL THEN 0.5 WHEN i % 2 = 1 THEN 1.0 ELSE 1.5 END::DOUBLE AS marks, coalesce(i <= 3, false) AS grouped FROM valued),
 won AS (SELECT answer_id, question_id, coalesce(sum(marks) FILTER (WHERE matched AND NOT grouped), 0) + coalesce(list_sum(list_sort(list(marks) FILTER (WHERE matched AND grouped), 'DESC')[1:2]), 0) AS uncapped FROM worth GROUP BY 1, 2)
SELECT answer_id, question_id, uncapped::DOUBLE AS uncapped, least(uncapped, 5.0)::DOUBLE AS total, 5.0::DOUBLE AS max_marks, false AS uncalibrated, 'value-point-engine/0.1.0-demo' AS engine_version FROM won"""


@query("d17_marks_from_evidence", MARKS_SQL)
def d17_marks_from_evidence(spark, d):
    s, a = schemes(spark, d), answers(spark, d)
    return M.score_answers(a, E.scheme_rows(s), checkpointed(E.text_evidence(a, s)))


@query("h37_mark_derivations")
def h37_mark_derivations(spark, d):
    s, a = schemes(spark, d), answers(spark, d)
    points = checkpointed(M.join_evidence(a, E.scheme_rows(s), E.text_evidence(a, s)))
    return M.derivations(points, M.question_marks(points, ["answer_id", "question_id"]), a)


@query("h36_adversarial_probes")
def h36_adversarial_probes(spark, d):
    return E.run_probes(schemes(spark, d))


@query(
    "a4_scheme_rows",
    """SELECT question_id, position, value_point_id, text, marks, match_mode, group_id FROM (
 SELECT item_id::VARCHAR AS question_id, i - 1 AS position, item_id || '.' || i AS value_point_id, s[i] AS text, CASE WHEN i % 2 = 1 THEN 1.0::DOUBLE ELSE 1.5::DOUBLE END AS marks, CASE WHEN i % 3 = 2 THEN 'STEP' ELSE 'EXACT' END AS match_mode, CASE WHEN i <= 3 THEN 'g' END AS group_id
 FROM (SELECT item_id, list_filter(list_transform(string_split_regex(text, '[.\\n]+'), lambda x: trim(x, e' \\t\\n\\r')), lambda x: x <> '') AS s FROM benchmark) q, range(1, 200) t(i) WHERE i <= len(s)
 UNION ALL SELECT item_id::VARCHAR, len(list_filter(list_transform(string_split_regex(text, '[.\\n]+'), lambda x: trim(x, e' \\t\\n\\r')), lambda x: x <> '')), item_id || '.n', 'count', 0.5::DOUBLE, 'NUMERIC', NULL FROM benchmark)""",
)
def a4_scheme_rows(spark, d):
    from marklake.schemas import checked_value_points
    from marklake.sources.readers import parse_schemes

    raw = schemes(spark, d).select(
        F.to_json(F.struct(F.array(F.struct(F.col("question_id").alias("id"), "question_number", "question_text", "max_marks", "value_points")).alias("questions"))).alias("value")
    )
    rows = checked_value_points(E.scheme_rows(parse_schemes(raw)))
    return rows.select("question_id", F.col("position").cast("bigint").alias("position"), "value_point_id", "text", "marks", "match_mode", "group_id")


_VEC = """vec AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
 edge AS (SELECT label, min(vec_id) AS lo, max(vec_id) AS hi FROM vec GROUP BY label),
 vp AS (SELECT v.label, v.vec_id, v.e FROM vec v JOIN edge USING (label) WHERE v.vec_id IN (lo, hi) OR v.vec_id % 50 = 0)"""


def _vectors(spark, d):
    return V.table(spark, d, "embeddings")


def _edge_vectors(spark, d):
    """Vectors that stand for value points: of each label the first, the last and every fiftieth."""
    v = _vectors(spark, d)
    edge = v.groupBy("label").agg(F.min("vec_id").alias("lo"), F.max("vec_id").alias("hi"))
    return v.join(edge, "label").filter((F.col("vec_id") == F.col("lo")) | (F.col("vec_id") == F.col("hi")) | (F.col("vec_id") % 50 == 0))


@query(
    "h12_semantic_evidence",
    f"""WITH {_VEC}, s AS (SELECT vec_id // 5 AS answer_id, label AS question_id, (vec_id % 5 * 10)::INT AS st, e FROM vec),
 c AS (SELECT answer_id, question_id, vp.vec_id::VARCHAR AS value_point_id, st, greatest(0, least(1, list_cosine_similarity(s.e, vp.e))) AS cs FROM s JOIN vp ON vp.label = s.question_id),
 b AS (SELECT *, row_number() OVER (PARTITION BY answer_id, question_id, value_point_id ORDER BY cs DESC, st) AS rn FROM c)
 SELECT answer_id, question_id, value_point_id, cs >= 0.68 AS matched, CASE WHEN cs >= 0.68 THEN st END AS span_start, CASE WHEN cs >= 0.68 THEN st + 9 END AS span_end, {r('cs', 4)} AS score FROM b WHERE rn = 1""",
)
def h12_semantic_evidence(spark, d):
    v = _vectors(spark, d)
    start = (F.col("vec_id") % 5 * 10).cast("int")
    sentences = v.select(
        F.floor(F.col("vec_id") / 5).alias("answer_id"), F.col("label").alias("question_id"), start.alias("start"), (start + 9).alias("end"), "embedding"
    )
    points = _edge_vectors(spark, d).select(F.col("label").alias("question_id"), F.col("vec_id").cast("string").alias("value_point_id"), "embedding")
    out = E.semantic_evidence(sentences, points, sentences.select("answer_id", "question_id").distinct())
    return out.select("answer_id", "question_id", "value_point_id", "matched", "span_start", "span_end", "score")


@query(
    "h14_cosine",
    f"WITH {_VEC} SELECT v.vec_id, p.vec_id AS other_id, round(greatest(0, least(1, list_cosine_similarity(v.e, p.e))), 6) AS similarity FROM vec v JOIN vp p USING (label)",
)
def h14_cosine(spark, d):
    edge = _edge_vectors(spark, d).select("label", F.col("vec_id").alias("other_id"), F.col("embedding").alias("_o"))
    pairs = _vectors(spark, d).join(edge, "label")
    return pairs.select("vec_id", "other_id", F.round(E.cosine("embedding", "_o"), 6).alias("similarity"))


@query(
    "h15_semantic_evaluation",
    f"""WITH {_VEC}, a AS (SELECT v.vec_id AS answer_id, d.text AS t, b.text AS ref, v.e, p.e AS re, v.label FROM vec v JOIN edge USING (label) JOIN vec p ON p.vec_id = edge.lo JOIN documents d ON d.doc_id = v.vec_id % (SELECT count(*) FROM documents) JOIN benchmark b ON b.item_id = v.vec_id % (SELECT count(*) FROM benchmark)),
 s AS (SELECT a.answer_id, vp.vec_id AS c, list_cosine_similarity(vp.e, a.e) AS m FROM a JOIN vp USING (label)),
 g AS (SELECT answer_id, string_agg('c' || c, ', ' ORDER BY c) FILTER (WHERE m >= 0.70) AS ma, string_agg('c' || c, ', ' ORDER BY c) FILTER (WHERE m < 0.70) AS mi FROM s GROUP BY 1)
 SELECT answer_id, {r("greatest(0, least(1, list_cosine_similarity(e, re)))", 4)} AS semantic_similarity, CASE WHEN length(trim(t)) < 10 OR length(trim(ref)) < 10 THEN 0.75 ELSE 0.95 END::DOUBLE AS semantic_confidence,
 coalesce(ma, '') AS matched, coalesce(mi, '') AS missing FROM a JOIN g USING (answer_id)""",
)
def h15_semantic_evaluation(spark, d):
    v, docs, bench = _vectors(spark, d), V.table(spark, d, "documents"), V.table(spark, d, "benchmark")
    n_docs, n_items = docs.agg(F.count(F.lit(1))).scalar(), bench.agg(F.count(F.lit(1))).scalar()
    edge = _edge_vectors(spark, d)
    reference = edge.filter("vec_id = lo").select("label", F.col("embedding").alias("reference_vector"))
    rows = (
        v.join(reference, "label")
        .withColumn("doc_id", F.col("vec_id") % n_docs)
        .withColumn("item_id", F.col("vec_id") % n_items)
        .join(docs.select("doc_id", F.col("text").alias("answer_text")), "doc_id")
        .join(bench.select("item_id", F.col("text").alias("reference_text")), "item_id")
        .select(
            F.col("vec_id").alias("answer_id"), F.col("label").alias("question_id"), "answer_text", "reference_text",
            F.col("embedding").alias("answer_vector"), "reference_vector", F.array("embedding").alias("segments"),
        )
    )
    concepts = edge.select(
        F.col("label").alias("question_id"), F.col("vec_id").cast("int").alias("position"), F.concat(F.lit("c"), F.col("vec_id").cast("string")).alias("concept"), "embedding"
    )
    out = E.semantic_evaluation_by_question(rows, concepts)
    return out.select(
        "answer_id", "semantic_similarity", "semantic_confidence", F.array_join("matched_semantic_concepts", ", ").alias("matched"),
        F.array_join("missing_semantic_concepts", ", ").alias("missing"),
    )


# --- answers to questions -------------------------------------------------------------------

_LABELS = """lab AS (SELECT DISTINCT l_orderkey AS answer_id, (year(o_orderdate)*100 + month(o_orderdate))::BIGINT AS exam_id, CASE l_linenumber % 3 WHEN 0 THEN 'question_' || l_linenumber WHEN 1 THEN 'q' || l_linenumber ELSE 'part_' || l_linenumber END AS label FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 que AS (SELECT exam_id, CASE WHEN exam_id % 2 = 0 THEN 'question_' ELSE 'q' END || n AS question_key, n AS position FROM (SELECT DISTINCT (year(o_orderdate)*100 + month(o_orderdate))::BIGINT AS exam_id FROM orders WHERE month(o_orderdate) <> 7) e, (SELECT unnest([1, 3, 4, 6]) AS n) k WHERE exam_id % 5 <> 0 OR n > 1)"""


def _labels(spark, d):
    li, orders = V.table(spark, d, "lineitem"), V.table(spark, d, "orders")
    n = F.col("l_linenumber").cast("string")
    label = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("question_"), n)).when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("q"), n)).otherwise(F.concat(F.lit("part_"), n))
    exam = (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("bigint")
    moved = (
        li.select("l_orderkey", "l_linenumber")
        .repartition("l_orderkey")
        .join(orders.select("o_orderkey", exam.alias("exam_id")), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(F.col("l_orderkey").alias("answer_id"), "exam_id", "l_linenumber")
    )
    # Few rows repeat another: an order's rows are told apart in their order, as a hash table of them all would fill a task.
    # Each line number has its own label.
    own = Window.partitionBy("answer_id", "exam_id").orderBy("l_linenumber")
    told = moved.withColumn("_first", F.row_number().over(own) == 1).withColumn("_before", F.lag("l_linenumber").over(own))
    return told.filter(F.col("_first") | ~F.col("l_linenumber").eqNullSafe(F.col("_before"))).select("answer_id", "exam_id", label.alias("label"))


def _exam_questions(spark, d):
    exams = V.exams(spark, d).filter("exam_id % 100 <> 7")  # July exams have no question context
    n = F.explode(F.array(*[F.lit(i) for i in (1, 3, 4, 6)]))
    q = exams.select("exam_id", n.alias("position")).filter("exam_id % 5 <> 0 OR position > 1")
    key = F.concat(F.when(F.col("exam_id") % 2 == 0, "question_").otherwise("q"), F.col("position").cast("string"))
    return q.select("exam_id", key.alias("question_key"), F.col("position").cast("bigint").alias("position"))


@query(
    "c4_resolved_questions",
    f"""WITH {_LABELS} SELECT answer_id, lab.exam_id, label, coalesce(k1.question_key, k2.question_key, k3.question_key, k4.question_key, f.k, 'synthetic') AS question_key FROM lab
 LEFT JOIN que k1 ON k1.exam_id = lab.exam_id AND k1.question_key = label LEFT JOIN que k2 ON k2.exam_id = lab.exam_id AND k2.question_key = replace(label, 'question_', 'q')
 LEFT JOIN que k3 ON k3.exam_id = lab.exam_id AND k3.question_key = replace(label, 'q', 'question_') LEFT JOIN que k4 ON k4.exam_id = lab.exam_id AND k4.question_key = 'question_1'
 LEFT JOIN (SELECT exam_id, arg_min(question_key, position) AS k FROM que GROUP BY 1) f ON f.exam_id = lab.exam_id""",
)
def c4_resolved_questions(spark, d):
    return E.resolve_questions(_labels(spark, d), _exam_questions(spark, d), F.lit("synthetic")).select("answer_id", "exam_id", "label", "question_key")


@query(
    "e13_exam_question_marks",
    f"""WITH {_LABELS}, m AS (SELECT *, CASE WHEN exam_id % 3 = 0 AND position > 1 THEN position / 2.0::DOUBLE END AS marks FROM que)
 SELECT exam_id, question_key, CASE WHEN g > 0 THEN marks ELSE {r('100.0::DOUBLE / n')} END AS question_marks FROM (SELECT *, count(marks) OVER (PARTITION BY exam_id) AS g, count(*) OVER (PARTITION BY exam_id) AS n FROM m) WHERE g = 0 OR marks IS NOT NULL""",
)
def e13_exam_question_marks(spark, d):
    q = _exam_questions(spark, d).withColumn("marks", F.when((F.col("exam_id") % 3 == 0) & (F.col("position") > 1), F.col("position") / 2.0))
    return E.exam_question_marks(q, V.exams(spark, d))


# --- autonomous scoring -----------------------------------------------------------------------


def _autonomous_input(spark, d):
    p = TQ.paired(spark, d)
    return p.withColumn("subject", F.lit("")).withColumn("max_marks", (F.col("answer_id") % 8 + 1).cast("double"))


@query("h5_concept_coverage")
def h5_concept_coverage(spark, d):
    out = AU.concept_coverage(AU.prepare_answers(_autonomous_input(spark, d)))
    return out.select(
        "answer_id", F.array_join("expected", "|").alias("expected"), F.array_join("concepts_found", "|").alias("found"),
        F.array_join("concepts_missing", "|").alias("missing"), "coverage_percentage",
    )


@query("h20_autonomous_scores")
def h20_autonomous_scores(spark, d):
    return AU.score_autonomously(_autonomous_input(spark, d)).select(
        "answer_id", "max_marks", "score_awarded", "confidence", "concept_coverage", "difficulty", "expected_depth", "criteria_feedback"
    )


@query("h26_explanations")
def h26_explanations(spark, d):
    out = AU.explain(AU.score_autonomously(_autonomous_input(spark, d)))
    x = F.col("explainability")
    return out.select(
        "answer_id", x["coverage_percentage"].alias("coverage_percentage"), F.to_json(x["evidence"]).alias("evidence"),
        F.array_join(x["reasoning"], "|").alias("reasoning"), F.array_join(x["missing_reasoning"], "|").alias("missing_reasoning"),
    )


@query("h27_question_feedback")
def h27_question_feedback(spark, d):
    s = AU.score_autonomously(_autonomous_input(spark, d))
    fb = FB.question_feedback(F.col("matched_keywords"), F.col("missing_concepts"), F.col("score_awarded"), F.col("max_marks"))
    return s.select("answer_id", *[F.array_join(c, "|").alias(n) for n, c in fb.items()])


# --- feedback -----------------------------------------------------------------------------------


def _rubric_questions(spark, d):
    q = V.question_evaluations(spark, d).transform(spread)
    met = F.col("score_awarded") >= F.col("max_marks") * 0.6
    point = F.struct(
        F.lit("c1").alias("criterion_id"),
        F.concat(F.lit("Coverage of expected concept: "), F.col("concept_text")).alias("description"),
        F.col("max_marks").alias("allocated_marks"),
        F.col("score_awarded").alias("marks_awarded"),
        met.alias("met"),
    )
    return q.select("submission_id", "question_number", "question_order", F.array(point).alias("rubric_points"), "matched_keywords", "missing_concepts", "concept_coverage")


_TITLE = "array_to_string(list_transform(string_split(concept_text, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


def _fb(kind: str, cond: str, text: str) -> str:
    return f"""{kind} AS (SELECT submission_id, string_agg(t, '|' ORDER BY place, t) AS v, string_agg(t, ', ' ORDER BY place, t) AS c FROM (SELECT *, row_number() OVER (PARTITION BY submission_id ORDER BY place, t) AS rn FROM (
 SELECT submission_id, t, min(place) AS place FROM (SELECT submission_id, question_order*1000 AS place, {text} AS t FROM f WHERE {cond}) GROUP BY 1, 2)) WHERE rn <= {4 if kind == 'tp' else 3} GROUP BY 1)"""


@query(
    "h27_submission_feedback",
    with_views(
        "qe docs",
        f"""SELECT d.submission_id, coalesce(st.v, '{FB.NO_STRENGTH}') AS strengths, coalesce(wk.v, '{FB.NO_WEAKNESS}') AS weaknesses, coalesce(im.v, '{FB.NO_IMPROVEMENT}') AS improvements, coalesce(tp.v, '{"|".join(FB.DEFAULT_TOPICS)}') AS study_recommendations,
 'Student achieved a score of ' || total_score || '/' || max_possible || ' (' || format('{{:.1f}}', total_score/max_possible*100) || '%). ' || CASE WHEN st.v IS NOT NULL THEN 'The submission shows strong performance in several areas, especially ' || st.c || '. ' ELSE 'The response displays initial familiarity with the subject, but could benefit from broader concept coverage. ' END
 || CASE WHEN wk.v IS NOT NULL THEN 'Next, focus on these areas: ' || wk.c || '.' ELSE 'Excellent job adhering to the grading rubric guidelines!' END AS summary
 FROM docs d LEFT JOIN st USING (submission_id) LEFT JOIN wk USING (submission_id) LEFT JOIN im USING (submission_id) LEFT JOIN tp USING (submission_id)""",
        f"""f AS (SELECT *, score_awarded >= max_marks*0.6::DOUBLE AS met, {_TITLE} AS title FROM qe),
 {_fb('st', "met OR score_awarded >= max_marks*0.8::DOUBLE", "'Q' || question_number || ': Explained ' || title || ' with clear connection to the question.'")},
 {_fb('wk', "NOT met AND score_awarded < max_marks*0.5::DOUBLE", "'Q' || question_number || ': Needs a clearer explanation of how ' || title || ' works in this answer.'")},
 {_fb('im', "NOT met", "'Q' || question_number || ': Revise ' || title || ' and explain its role using one complete sentence.'")},
 {_fb('tp', "NOT met", "title")}""",
    ),
)
def h27_submission_feedback(spark, d):
    totals = V.evaluation_documents(spark, d).select("submission_id", "total_score", "max_possible")
    out = FB.submission_feedback(_rubric_questions(spark, d).drop("missing_concepts"), totals, ["submission_id"])
    lists = [F.array_join(n, "|").alias(n) for n in ("strengths", "weaknesses", "improvements", "study_recommendations")]
    return out.select("submission_id", *lists, "summary")


@query("h27_autonomous_feedback")
def h27_autonomous_feedback(spark, d):
    totals = V.evaluation_documents(spark, d).select("submission_id", "total_score", "max_possible")
    q = _rubric_questions(spark, d)
    out = FB.autonomous_feedback(FB.submission_feedback(q, totals, ["submission_id"]), q, ["submission_id"])
    return out.select("submission_id", F.array_join("strengths", "|").alias("strengths"), F.array_join("study_recommendations", "|").alias("study_recommendations"), "summary")


@query(
    "b13_study_plan",
    with_views(
        "qe",
        """SELECT submission_id, CASE WHEN len(t) > 0 THEN array_to_string(t[1:6], '|') ELSE 'Core Concepts From This Exam|Answer Structure And Explanation|Question-Specific Terminology' END AS study_topics, array_to_string(CASE WHEN len(i) > 0 THEN i ELSE w END[1:6], '|') AS practice_focus FROM (
 SELECT submission_id, list_sort(coalesce(list(DISTINCT concept_text) FILTER (WHERE concept_missing), [])) AS t, list_sort(coalesce(list(DISTINCT concept) FILTER (WHERE max_marks > 30), [])) AS i, list_sort(coalesce(list(DISTINCT topic) FILTER (WHERE NOT bias_free), [])) AS w FROM qe GROUP BY 1)""",
    ),
)
def b13_study_plan(spark, d):
    from marklake.operators.dashboards import study_plan
    from marklake.operators.learning import topic_name

    q = V.question_evaluations(spark, d)
    brand = F.coalesce(F.get("missing_semantic", F.lit(0)), F.get("matched_semantic", F.lit(0)))
    concept = F.when(F.col("has_semantic"), brand).otherwise(F.col("concept_text"))
    docs = q.groupBy("submission_id").agg(
        F.sort_array(F.collect_set(F.when(F.size("missing_concepts") > 0, F.col("concept_text")))).alias("study_recommendations"),
        F.sort_array(F.collect_set(F.when(F.col("max_marks") > 30, concept))).alias("improvements"),
        F.sort_array(F.collect_set(F.when(~F.col("bias_free"), topic_name(F.col("topic_context"))))).alias("weaknesses"),
    )
    return study_plan(docs).select("submission_id", F.array_join("study_topics", "|").alias("study_topics"), F.array_join("practice_focus", "|").alias("practice_focus"))


# --- retrieval -----------------------------------------------------------------------------------


def _curriculum(spark, d):
    t = lambda n: V.table(spark, d, n)
    subjects = t("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.concat(F.lit("S"), F.col("r_regionkey").cast("string")).alias("code"), F.lower("r_name").alias("description"))
    chapters = t("nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("subject_id"), F.col("n_name").alias("name"), F.lit("").alias("description"))
    topics = t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("chapter_id"), F.col("s_name").alias("name"), F.array(F.lit("state"), F.lower("s_name")).alias("learning_objectives"))
    questions = t("part").select(
        F.col("p_partkey").alias("id"), (F.col("p_partkey") % 7).alias("topic_id"), F.col("p_name").alias("question_text"), F.lower("p_type").alias("difficulty"), F.col("p_size").cast("double").alias("marks")
    )
    answers_ = t("documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("question_id"), F.col("text").alias("answer_text"))
    rubrics = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("question_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("criteria"))
    return subjects, chapters, topics, questions, answers_, rubrics


@query(
    "a7_curriculum_corpus",
    """SELECT document_id, document_type, trim(content) AS content, k AS metadata_keys FROM (
 SELECT r_regionkey::VARCHAR AS document_id, 'Subject' AS document_type, 'Subject: ' || r_name || ' (S' || r_regionkey || '). ' || lower(r_name) AS content, 'code,id,name' AS k FROM region
 UNION ALL SELECT n_nationkey::VARCHAR, 'Chapter', 'Chapter: ' || n_name || '. ', 'id,name,subject_id' FROM nation UNION ALL SELECT s_suppkey::VARCHAR, 'Topic', 'Topic: ' || s_name || '. Objectives: state; ' || lower(s_name), 'chapter_id,id,name' FROM supplier
 UNION ALL SELECT p_partkey::VARCHAR, 'Question', 'Question: ' || p_name || ' (Difficulty: ' || lower(p_type) || ', Marks: ' || p_size::DOUBLE || ')', 'difficulty,id,marks,topic_id' FROM part
 UNION ALL SELECT doc_id::VARCHAR, 'ReferenceAnswer', 'Reference Answer: ' || text, 'id,question_id' FROM documents UNION ALL SELECT c_custkey::VARCHAR, 'Rubric', 'Rubric for Question: ' || c_name, 'criteria,id,question_id' FROM customer)""",
)
def a7_curriculum_corpus(spark, d):
    c = R.corpus(*_curriculum(spark, d))
    return c.select("document_id", "document_type", "content", F.array_join(F.sort_array(F.map_keys("metadata")), ",").alias("metadata_keys"))


@query(
    "c7_curriculum_tree",
    "SELECT r_regionkey AS subject_id, n_nationkey AS chapter_id, s_suppkey AS topic_id, l_partkey AS question_id FROM region JOIN nation ON r_regionkey = n_regionkey JOIN supplier ON s_nationkey = n_nationkey JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) ON l_suppkey = s_suppkey",
)
def c7_curriculum_tree(spark, d):
    t = lambda n: V.table(spark, d, n)
    return R.curriculum_tree(
        t("region").select(F.col("r_regionkey").alias("subject_id")),
        t("nation").select(F.col("n_regionkey").alias("subject_id"), F.col("n_nationkey").alias("chapter_id")),
        t("supplier").select(F.col("s_nationkey").alias("chapter_id"), F.col("s_suppkey").alias("topic_id")),
        t("lineitem").select(F.col("l_suppkey").alias("topic_id"), F.col("l_partkey").alias("question_id")).distinct(),
    )


@query(
    "c8_nearest_vectors",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)
 SELECT query_id, document_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS rank FROM (
 SELECT q.vec_id AS query_id, v.vec_id AS document_id, round(greatest(0, least(1, list_cosine_similarity(q.e, v.e))), 6) AS score FROM v q, v)) WHERE rank <= 5""",
)
def c8_nearest_vectors(spark, d):
    v = _vectors(spark, d)
    out = R.nearest(v.select(F.col("vec_id").alias("query_id"), "embedding"), v.select(F.col("vec_id").alias("document_id"), "embedding"), 5)
    return out.withColumn("rank", F.col("rank").cast("bigint"))


_TYPES = ["Subject", "Chapter", "Topic", "Question", "ReferenceAnswer", "Rubric"]


def typed_hits(spark, d, asked=None):
    """Hits of every vector as a query, or of those alone whose id is in `asked` (query_id)."""
    v = _vectors(spark, d)
    kind = F.array(*[F.lit(t) for t in _TYPES])[(F.col("vec_id") % 6).cast("int")]
    docs = v.select(F.col("vec_id").alias("document_id"), "embedding", kind.alias("document_type"), F.concat(F.lit("text "), F.col("vec_id").cast("string")).alias("content"))
    queries = v.select(F.col("vec_id").alias("query_id"), "embedding", F.when(F.col("label") % 3 == 0, "the array of plant data").otherwise("what is it").alias("query_text"))
    if asked is not None:
        queries = queries.join(asked, "query_id", "left_semi")
    return R.retrieve(queries, docs, 20), queries


@query(
    "e8_first_per_type",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS rank FROM (
 SELECT q.vec_id AS query_id, v.vec_id AS document_id, round(greatest(0, least(1, list_cosine_similarity(q.e, v.e))), 6) AS score FROM v q, v)) WHERE rank <= 20),
 f AS (SELECT query_id, document_id % 6 AS k, 'text ' || document_id AS content, row_number() OVER (PARTITION BY query_id, document_id % 6 ORDER BY CAST(format('{:.4f}', score) AS DOUBLE) DESC, document_id) AS rn FROM h)
 SELECT query_id, coalesce(max(content) FILTER (WHERE k=0), '') AS subject, coalesce(max(content) FILTER (WHERE k=1), '') AS chapter, coalesce(max(content) FILTER (WHERE k=2), '') AS topic, coalesce(max(content) FILTER (WHERE k=3), '') AS question,
 coalesce(max(content) FILTER (WHERE k=4), '') AS reference_answer, coalesce(max(content) FILTER (WHERE k=5), '') AS rubric FROM f WHERE rn = 1 GROUP BY 1""",
)
def e8_first_per_type(spark, d):
    return R.first_per_type(typed_hits(spark, d)[0])


@query("c15_curriculum_context")
def c15_curriculum_context(spark, d):
    hits, queries = typed_hits(spark, d)
    science = F.when(F.col("document_id") % 4 == 0, F.lit("science")).otherwise(F.lit("structure"))
    hits = hits.withColumn("content", F.concat("content", F.lit(" "), science)).join(queries.select("query_id", "query_text"), "query_id")
    hints = queries.select("query_id", "query_text", F.when(F.col("query_id") % 2 == 0, "DSA").otherwise("").alias("subject_hint"))
    return R.curriculum_context(hits, hints)
