"""Registered queries: text expressions, contamination and privacy sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from marklake.functions import lexicon as X
from marklake.functions import text as TX
from marklake.functions.matching import word_error_rate
from marklake.operators import autonomous as AU
from marklake.operators import confidence as C
from marklake.operators import contamination as CT
from marklake.operators import feedback as FB
from marklake.plans import segment_queries as SQ
from marklake.plans import views as V
from marklake.plans.common import Catalog
from marklake.plans.views import r, with_views
from marklake.session import spread

query = Catalog()


def _in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _first_each(expr: str) -> str:
    """Keep-first distinct of a list in SQL."""
    return f"list_reduce(list_prepend(['']::VARCHAR[], list_transform({expr}, lambda d: [d])), lambda acc, d: CASE WHEN list_contains(acc, d[1]) THEN acc ELSE list_concat(acc, d) END)[2:]"


_REFUSED = _in(TX._REFUSED)


def _norm(t: str) -> str:
    return f"trim(regexp_replace(regexp_replace(translate(regexp_replace(trim({t}, e' \\t\\n\\r'), '^coverage of expected concept:\\s*', ''), '_-', '  '), '[^a-z0-9+ ]+', ' ', 'g'), '\\s+', ' ', 'g'))"


def _words_sql(t: str) -> str:
    return f"regexp_extract_all({t}, '[\\p{{L}}\\p{{N}}_]+')"


def _ascii_words(t: str) -> str:
    """Letters outside ASCII become "_", so ASCII word boundaries agree with Unicode ones."""
    return f"regexp_replace(regexp_replace(lower({t}), '[^\\x00-\\x7F\\p{{L}}\\p{{N}}]', ' ', 'g'), '[^\\x00-\\x7F]', '_', 'g')"


def _keywords_sql(t: str, limit: int | None = None) -> str:
    found = f"regexp_extract_all({_ascii_words(t)}, '\\b[a-zA-Z][a-zA-Z0-9+\\-]{{2,}}\\b')"
    kept = f"list_filter({found}, lambda w: w NOT IN {_in(X.CONCEPT_STOPWORDS)})"
    inner = _norm("trim(w, '-')")
    valid = f"list_filter(list_transform({kept}, lambda w: {inner}), lambda w: length(w) >= 3 AND w NOT IN {_REFUSED})"
    return f"({_first_each(valid)})" + (f"[1:{limit}]" if limit else "")


def docs(spark, d):
    return spread(V.table(spark, d, "documents"))


def paired(spark, d):
    """Each document as the answer to one benchmark item taken as the question."""
    bench = V.table(spark, d, "benchmark")
    n = bench.agg(F.count(F.lit(1))).scalar()
    questions = bench.select("item_id", F.col("text").alias("question_text"))
    return (
        V.table(spark, d, "documents")
        .select(F.col("doc_id").alias("answer_id"), F.col("text").alias("answer_text"), (F.col("doc_id") % n).alias("item_id"))
        .transform(spread)
        .join(questions, "item_id")
    )


PAIRED = "pr AS (SELECT doc_id AS answer_id, d.text AS answer_text, item_id, b.text AS question_text FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark))"


@query("h1_normalized_concepts", f"SELECT doc_id, {_norm('lower(text)')} AS concept FROM documents")
def h1_normalized_concepts(spark, d):
    return docs(spark, d).select("doc_id", TX.normalize_concept(F.col("text")).alias("concept"))


_PHRASES = "string_split_regex(text, '[.,]')"


@query(
    "h2_filtered_concepts",
    f"""SELECT doc_id, array_to_string(({_first_each(f"list_filter(list_transform({_PHRASES}, lambda w: {_norm('lower(w)')}), lambda w: length(w) >= 3 AND w NOT IN {_REFUSED})")})[1:10], '|') AS concepts FROM documents""",
)
def h2_filtered_concepts(spark, d):
    phrases = F.split("text", "[.,]")
    return docs(spark, d).select("doc_id", F.array_join(TX.filter_concepts(phrases, 10), "|").alias("concepts"))


@query("h3_keywords", f"SELECT doc_id, array_to_string({_keywords_sql('text', 12)}, '|') AS keywords FROM documents")
def h3_keywords(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(TX.keywords(F.col("text"), 12), "|").alias("keywords"))


def _domain_sql(q: str) -> str:
    hits = ", ".join(
        f"{{'n': len(list_filter({_list(t)}, lambda c: contains(lower({q}), c))), 'rank': {-i}, 'domain': '{dom}'}}"
        for i, (dom, t) in enumerate(X.DOMAIN_CONCEPTS.items())
    )
    return f"(SELECT CASE WHEN best.n > 0 THEN best.domain ELSE '' END FROM (SELECT list_max([{hits}]) AS best))"


def _expected_sql(q: str, dom: str) -> str:
    terms = "CASE " + " ".join(f"WHEN {dom} = '{k}' THEN {_list(sorted(v))}" for k, v in X.DOMAIN_CONCEPTS.items()) + " ELSE []::VARCHAR[] END"
    expanded = f"flatten(list_transform(list_filter({terms}, lambda c: contains(lower({q}), c)), lambda c: CASE WHEN c = 'photosynthesis' THEN {_list(X.CONCEPT_EXPANSIONS['photosynthesis'])} ELSE [c] END))"
    merged = f"list_concat({expanded}, {_keywords_sql(q)})"
    return f"({_first_each(f'list_filter(list_transform({merged}, lambda w: {_norm("w")}), lambda w: length(w) >= 3 AND w NOT IN {_REFUSED})')})"


@query(
    "h4_expected_concepts",
    f"""WITH q AS (SELECT doc_id, text, {_domain_sql('text')} AS domain FROM documents)
 SELECT doc_id, domain, array_to_string({_expected_sql('text', 'domain')}, '|') AS concepts FROM q""",
)
def h4_expected_concepts(spark, d):
    q = docs(spark, d).withColumn("domain", TX.infer_domain(F.col("text"), F.lit("")))
    return q.select("doc_id", "domain", F.array_join(TX.expected_concepts(F.col("text"), F.col("domain")), "|").alias("concepts"))


_SANITIZE = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({t}, '\\bstudent\\s*name\\s*[:\\-]\\s*[A-Za-z .]+?(\\s+(?:roll|id)\\b|$)', ' \\1', 'gi'), '\\bname\\s*[:\\-]\\s*[A-Za-z .]+?(\\s+(?:roll|id)\\b|$)', ' \\1', 'gi'), '\\broll\\s*(?:no\\.?|number)?\\s*[:\\-]?\\s*[A-Za-z0-9_\\-/]+', ' ', 'gi'), '\\bid\\s*[:\\-]\\s*[A-Za-z0-9_\\-/]+', ' ', 'gi'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}', ' ', 'gi')"


def _sanitize_sql(t: str) -> str:
    toks = f"string_split_regex(trim(regexp_replace({_SANITIZE.format(t=t)}, '\\s+', ' ', 'g')), ' ')"
    return f"array_to_string(list_filter({toks}, lambda w: w <> '' AND lower(trim(w, '.,:;!?()[]{{}}')) NOT IN {_in(X.PROTECTED_TERMS)}), ' ')"


@query("h7_sanitized_text", f"SELECT doc_id, {_sanitize_sql('text')} AS sanitized FROM documents")
def h7_sanitized_text(spark, d):
    return docs(spark, d).select("doc_id", TX.sanitize(F.col("text")).alias("sanitized"))


@query(
    "h6_lexical_alignment",
    f"""WITH {PAIRED}, s AS (SELECT answer_id, {_sanitize_sql('answer_text')} AS a, question_text AS q, {_domain_sql('question_text')} AS dom FROM pr),
 t AS (SELECT answer_id, {_expected_sql('q', 'dom')} AS e, {_keywords_sql('a')} AS k FROM s)
 SELECT answer_id, {r("least(1.0::DOUBLE, len(list_intersect(e, k))/len(e)::DOUBLE + CASE WHEN len(k) >= greatest(3, len(e)//2) THEN 0.1::DOUBLE ELSE 0 END)")} AS alignment FROM t""",
)
def h6_lexical_alignment(spark, d):
    p = AU.prepare_answers(paired(spark, d).withColumn("subject", F.lit("")).withColumn("max_marks", F.lit(5.0)))
    return p.select("answer_id", TX.lexical_alignment(F.col("expected"), F.col("terms")).alias("alignment"))


_WHITE = "[\\t-\\r\\x{85}\\p{Z}]"
_SEG = f"""(SELECT CASE WHEN len(kept) > 0 THEN kept WHEN whole <> '' THEN [whole] ELSE []::VARCHAR[] END
 FROM (SELECT list_filter(list_transform(string_split_regex(text, '[.!?;\\n]+'), lambda s: regexp_replace(s, '^{_WHITE}+|{_WHITE}+$', '', 'g')), lambda s: length(s) >= 3 AND NOT regexp_full_match(s, '\\p{{Nd}}+')) AS kept,
 regexp_replace(text, '^{_WHITE}+|{_WHITE}+$', '', 'g') AS whole))"""


@query("h13_segments", f"SELECT doc_id, len(s) AS n, array_to_string(s, '|') AS segments FROM (SELECT doc_id, {_SEG} AS s FROM documents)")
def h13_segments(spark, d):
    s = docs(spark, d).withColumn("_s", TX.segments(F.col("text")))
    return s.select("doc_id", F.size("_s").cast("bigint").alias("n"), F.array_join("_s", "|").alias("segments"))


@query(
    "f4_longest_segments",
    f"""SELECT d.doc_id, coalesce(string_agg(x.seg, '|' ORDER BY length(x.seg) DESC, x.i), '') AS segments FROM documents d LEFT JOIN (
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(seg) DESC, i) AS rn FROM (
 SELECT doc_id, unnest(s) AS seg, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, {_SEG} AS s FROM documents))) WHERE rn <= 3) x ON x.doc_id = d.doc_id GROUP BY d.doc_id""",
)
def f4_longest_segments(spark, d):
    out = docs(spark, d).select("doc_id", F.array_join(TX.longest_first(TX.segments(F.col("text")), 3), "|").alias("segments"))
    return out


@query(
    "h13_sentence_spans",
    """SELECT doc_id, a::INT AS span_start, (a + length(p))::INT AS span_end, trim(p, e' \\t\\n\\r') AS sentence FROM (
 SELECT *, coalesce(sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM (
 SELECT doc_id, unnest(s) AS p, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?]+\\s+|\\n+)', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS s FROM documents)))
 WHERE i % 2 = 1 AND length(trim(p, e' \\t\\n\\r')) > 0""",
)
def h13_sentence_spans(spark, d):
    s = docs(spark, d).select("doc_id", F.explode(TX.sentence_spans(F.col("text"))).alias("s"))
    return s.select("doc_id", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), F.col("s.piece").alias("sentence"))


# --- rubric chain --------------------------------------------------------------------------

_RUBRIC = """qs AS (SELECT item_id, text || CASE item_id % 3 WHEN 0 THEN ' [7 marks]' WHEN 1 THEN ' (2.5 m)' ELSE '' END AS question_text, text AS answer_key FROM benchmark),
 it AS (SELECT item_id, coalesce(try_cast(nullif(regexp_extract(question_text, '[\\[(]\\s*(\\d+(?:\\.\\d+)?)\\s*(?:marks?|m)\\s*[\\])]', 1, 'i'), '') AS DOUBLE), 5.0::DOUBLE) AS max_score,
  list_filter(list_transform(string_split_regex(answer_key, '\\n+\\s*(?:-|\\d+\\.)\\s*'), lambda s: trim(s, e' \\t\\n\\r')), lambda s: s <> '') AS points,
  list_filter(list_transform(string_split_regex(regexp_replace(answer_key, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\x01|\\n+'), lambda s: trim(s, e' \\t\\n\\r')), lambda s: s <> '') AS sents FROM qs),
 ks AS (SELECT item_id, max_score, (list_filter(CASE WHEN len(points) > 1 THEN points ELSE sents END, lambda c: length(c) > 0)) AS items FROM it),
 cr AS (SELECT item_id, max_score, i, items[i] AS description, CASE WHEN i < len(items) THEN each ELSE {rest} END AS allocated FROM (SELECT *, {each} AS each, unnest(range(1, len(items) + 1)) AS i FROM ks) x)""".format(
    each=r("max_score/len(items)"),
    rest=r("max_score - list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(1, len(items)), lambda z: each)), lambda p, q: p + q)"),
)


def _rubrics(spark, d):
    i = F.col("item_id")
    suffix = F.when(i % 3 == 0, " [7 marks]").when(i % 3 == 1, " (2.5 m)").otherwise("")
    q = V.table(spark, d, "benchmark").select(i.alias("question_id"), F.concat("text", suffix).alias("question_text"), F.col("text").alias("answer_key"))
    return AU.generate_rubrics(q)


@query(
    "h16_generated_rubrics",
    f"WITH {_RUBRIC} SELECT item_id AS question_id, max_score, 'crit_' || i AS criterion_id, description, allocated AS allocated_marks FROM cr",
)
def h16_generated_rubrics(spark, d):
    c = F.col("c")
    return _rubrics(spark, d).select("question_id", "max_score", F.explode("criteria").alias("c")).select(
        "question_id", "max_score", c["criterion_id"].alias("criterion_id"), c["description"].alias("description"), c["allocated_marks"].alias("allocated_marks")
    )


_CREDIT = f"""{_RUBRIC}, {PAIRED},
 tw AS (SELECT answer_id, item_id, i, allocated, max_score, lower(answer_text) AS a, {_words_sql('lower(description)')} AS w FROM pr JOIN cr USING (item_id)),
 tk AS (SELECT *, list_filter(w, lambda x: regexp_full_match(x, '[a-zA-Z]{{5,}}') AND x NOT IN {_in(X.RUBRIC_COMMON_WORDS)}) AS kt,
  list_filter(list_distinct(w), lambda x: x NOT IN {_in(X.RUBRIC_FUNCTION_WORDS)}) AS uq, list_transform(range(0, (len(w)//3)::BIGINT), lambda z: array_to_string(w[z*3+1:z*3+3], ' ')) AS ch FROM tw),
 rt AS (SELECT *, CASE WHEN len(kt) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(kt, lambda x: contains(a, x)))/len(kt)::DOUBLE END AS kr,
  CASE WHEN len(w) < 3 THEN 1.0::DOUBLE ELSE len(list_filter(ch, lambda x: contains(a, x)))/len(ch)::DOUBLE*0.4::DOUBLE + CASE WHEN len(uq) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(uq, lambda x: contains(a, x)))/len(uq)::DOUBLE END*0.6::DOUBLE END AS cov FROM tk),
 aw AS (SELECT *, CASE WHEN greatest(kr, cov) >= 0.75 THEN allocated WHEN greatest(kr, cov) >= 0.35 THEN round_even(allocated*greatest(kr, cov)*2, 0)/2 ELSE 0 END AS awarded FROM rt)"""


def _rubric_scores(spark, d):
    answers = paired(spark, d).select("answer_id", F.col("item_id").alias("question_id"), "answer_text")
    return AU.score_with_rubric(answers, _rubrics(spark, d).drop("question_text", "answer_key", "max_marks"), ["answer_id", "question_id"])


@query("h17_h18_criterion_ratios", f"WITH {_CREDIT} SELECT answer_id, 'crit_' || i AS criterion_id, round(kr, 9) AS keyword_ratio, round(cov, 9) AS coverage FROM aw")
def h17_h18_criterion_ratios(spark, d):
    rub = _rubrics(spark, d).select(F.col("question_id").alias("item_id"), F.explode("criteria").alias("c"))
    joined = paired(spark, d).join(rub, "item_id")
    desc, text = F.col("c.description"), F.col("answer_text")
    return joined.select(
        "answer_id",
        F.col("c.criterion_id").alias("criterion_id"),
        F.round(TX.keyword_ratio(desc, text), 9).alias("keyword_ratio"),
        F.round(TX.phrase_coverage(desc, text), 9).alias("coverage"),
    )


@query(
    "h19_partial_credit",
    f"""WITH {_CREDIT} SELECT answer_id, item_id AS question_id, {r("least(list_reduce(list_prepend(0.0::DOUBLE, list(awarded ORDER BY i)), lambda p, q: p + q), max(max_score))")} AS score_awarded, max(max_score) AS max_marks,
 string_agg(CASE WHEN greatest(kr,cov) >= 0.75 OR (greatest(kr,cov) >= 0.35 AND awarded >= allocated*0.5) THEN '1' ELSE '0' END, '' ORDER BY i) AS met FROM aw GROUP BY answer_id, item_id""",
)
def h19_partial_credit(spark, d):
    met = F.array_join(F.transform("rubric_points", lambda p: F.when(p["met"], "1").otherwise("0")), "")
    return _rubric_scores(spark, d).select("answer_id", "question_id", "score_awarded", "max_marks", met.alias("met"))


@query(
    "h24_marking_check",
    with_views(
        "qe",
        f"""SELECT submission_id, question_number, NOT (over_ OR neg OR mis) AS verified, 1.0::DOUBLE - 0.25::DOUBLE*(over_::INT + neg::INT + mis::INT) AS fairness_score,
 concat_ws('|', CASE WHEN over_ THEN 'Score awarded (' || s || ') exceeds maximum allowed marks (' || max_marks || ').' END, CASE WHEN neg THEN 'Score awarded (' || s || ') is negative.' END,
 CASE WHEN mis THEN 'Total score (' || s || ') does not match the sum of rubric items (' || score_awarded || ').' END) AS issues
 FROM (SELECT *, s > max_marks AS over_, s < 0 AS neg, abs(s - score_awarded) > 0.01 AS mis FROM (SELECT *, CASE WHEN bias_free THEN score_awarded ELSE score_awarded*2 - 12 END AS s FROM qe))""",
    ),
)
def h24_marking_check(spark, d):
    q = V.question_evaluations(spark, d).withColumn("s", F.when(F.col("bias_free"), F.col("score_awarded")).otherwise(F.col("score_awarded") * 2 - 12))
    out = C.marking_check(F.col("s"), F.col("max_marks"), F.array("score_awarded"))
    return q.select("submission_id", "question_number", out["verified"].alias("verified"), out["fairness_score"].alias("fairness_score"), F.array_join(out["issues"], "|").alias("issues"))


# --- question understanding ----------------------------------------------------------------


def _class_sql(t: str, classes, default: str) -> str:
    whens = " ".join("WHEN " + " OR ".join(f"contains(lower({t}), '{n}')" for n in ns) + f" THEN '{k}'" for k, ns in classes)
    return f"CASE {whens} ELSE '{default}' END"


_PK = f"{_first_each(f'''list_filter({_words_sql('lower(text)')}, lambda w: regexp_full_match(w, '[a-z]{{3,}}') AND w NOT IN {_in(X.PROMPT_STOPWORDS)})''')}"
_CAP = "lambda w: upper(w[1]) || lower(w[2:])"


@query(
    "h21_question_understanding",
    f"""SELECT doc_id, answer_type, prompt_type, CASE WHEN len(named) > 0 THEN array_to_string(named, '|') WHEN len(k) > 0 THEN array_to_string(list_transform(k[1:2], {_CAP}), '|') ELSE 'General' END AS topics,
 CASE prompt_type {" ".join(f"WHEN '{k}' THEN '{t}'" for k, t in X.INTENT_TEXTS.items())} END || array_to_string(k[1:3], ', ') || '.' AS intent, difficulty, expected_depth
 FROM (SELECT doc_id, {_class_sql('text', X.ANSWER_TYPES, 'DESCRIPTIVE')} AS answer_type, {_class_sql('text', X.PROMPT_TYPES, 'explanation')} AS prompt_type, {_PK} AS k,
 list_filter([{", ".join("CASE WHEN " + " OR ".join(f"contains(lower(text), '{n}')" for n in ns) + f" THEN '{t}' END" for t, ns in X.TOPIC_INDICATORS)}], lambda t: t IS NOT NULL) AS named,
 CASE WHEN doc_id % 9 <= 2 THEN 'EASY' WHEN doc_id % 9 <= 5 THEN 'MEDIUM' ELSE 'HARD' END AS difficulty, CASE WHEN doc_id % 9 <= 2 THEN 'brief' WHEN doc_id % 9 <= 5 THEN 'conceptual' ELSE 'detailed' END AS expected_depth FROM documents)""",
)
def h21_question_understanding(spark, d):
    t, marks = F.col("text"), F.col("doc_id") % 9
    q = docs(spark, d).withColumn("k", TX.prompt_keywords(t)).withColumn("prompt_type", TX.prompt_type(t))
    return q.select(
        "doc_id",
        TX.answer_type(t).alias("answer_type"),
        "prompt_type",
        F.array_join(TX.prompt_topics(t, F.col("k")), "|").alias("topics"),
        TX.prompt_intent(F.col("prompt_type"), F.col("k")).alias("intent"),
        TX.difficulty(marks).alias("difficulty"),
        TX.expected_depth(marks).alias("expected_depth"),
    )


@query("h22_parsed_questions")
def h22_parsed_questions(spark, d):
    c = V.table(spark, d, "conversations")
    paper = c.select(
        F.col("conv_id").alias("paper_id"),
        F.concat(F.lit("Q"), F.col("turn").cast("string"), F.lit(". "), F.replace("text", F.lit("."), F.lit(" OR ")), F.when(F.col("turn") % 2 == 0, " [4 marks]").otherwise("")).alias("t"),
        "turn",
    )
    whole = paper.groupBy("paper_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "t"))), lambda s: s["t"]), " ").alias("paper_text"))
    out = AU.parse_questions(whole.withColumn("total_marks", F.lit(30.0)))
    return out.select("paper_id", "question_key", "question_text", "marks", F.size("alternatives").alias("n_alternatives"))


@query(
    "h22_marks_and_or",
    """SELECT doc_id, try_cast(nullif(regexp_extract(t, '[\\[(]\\s*(\\d+(?:\\.\\d+)?)\\s*(?:marks?|m)\\s*[\\])]', 1, 'i'), '') AS DOUBLE) AS marks,
 regexp_matches(t, '(?:^|\\n)\\s*OR\\s*(?:\\n|$)', 'i') OR regexp_matches(t, '(?is)\\bEither\\b.{5,}\\bor\\b') OR regexp_matches(t, '(?:^|\\n)\\s*(?:Attempt\\s+)?Any[\\s-]One(?:\\s+of\\s+the\\s+following)?[\\s:]*(?:\\n|$)', 'i')
 OR regexp_matches(t, '\\s+(?:OR|Either|Any[\\s-]?One)\\s+', 'i') AS has_or FROM (SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN ' (3 Marks]' WHEN 1 THEN chr(10) || 'OR' || chr(10) || ' two' ELSE '' END AS t FROM documents)""",
)
def h22_marks_and_or(spark, d):
    extra = F.when(F.col("doc_id") % 4 == 0, " (3 Marks]").when(F.col("doc_id") % 4 == 1, "\nOR\n two").otherwise("")
    t = F.concat("text", extra)
    return docs(spark, d).select("doc_id", TX.marks_in_text(t).alias("marks"), TX.has_or_structure(t).alias("has_or"))


@query(
    "e9_chosen_alternatives",
    f"""WITH {PAIRED}, al AS (SELECT b.item_id, j, CASE j WHEN 1 THEN b.text ELSE c.text END AS t FROM benchmark b JOIN benchmark c ON c.item_id = (b.item_id + 1) % (SELECT count(*) FROM benchmark), range(1, 3) r(j) WHERE b.item_id % 5 <> 0),
 ov AS (SELECT answer_id, j, {{w}} AS aw, {{v}} AS bw FROM pr JOIN al USING (item_id)),
 sc AS (SELECT answer_id, j, CASE WHEN len(aw) = 0 OR len(bw) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(aw, bw))/least(len(aw), len(bw))::DOUBLE END AS s FROM ov)
 SELECT answer_id, chosen_label, round(match_score, 9) AS match_score FROM (SELECT answer_id, CASE j WHEN 1 THEN 'q_optA' ELSE 'q_optB' END AS chosen_label, s AS match_score FROM (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY s DESC, j) AS rn FROM sc) WHERE rn = 1
 UNION ALL SELECT answer_id, 'q', 1.0::DOUBLE FROM pr WHERE item_id % 5 = 0)""".format(
        w=f"list_distinct(list_filter({_words_sql('lower(t)')}, lambda x: regexp_full_match(x, '[a-z]{{4,}}')))",
        v=f"list_distinct(list_filter({_words_sql('lower(answer_text)')}, lambda x: regexp_full_match(x, '[a-z]{{4,}}')))",
    ),
)
def e9_chosen_alternatives(spark, d):
    bench = V.table(spark, d, "benchmark")
    n = bench.agg(F.count(F.lit(1))).scalar()
    other = bench.select((F.pmod(F.col("item_id") - 1 + n, n)).alias("item_id"), F.col("text").alias("_other"))
    alts = F.array(
        F.struct(F.lit("q_optA").alias("label"), F.col("question_text").alias("text")), F.struct(F.lit("q_optB").alias("label"), F.col("_other").alias("text"))
    )
    none = F.array().cast("array<struct<label:string,text:string>>")
    p = paired(spark, d).join(other, "item_id").withColumn("question_key", F.lit("q"))
    p = p.withColumn("alternatives", F.when(F.col("item_id") % 5 == 0, none).otherwise(alts))
    return AU.choose_alternatives(p).select("answer_id", "chosen_label", F.round("match_score", 9).alias("match_score"))


# --- fairness, privacy ------------------------------------------------------------------------


@query(
    "h23_bias_scan",
    f"""SELECT doc_id, len(v) = 0 AS verified_bias_free, {r("greatest(0, 1.0::DOUBLE - (CASE WHEN em THEN 0.20::DOUBLE ELSE 0.0 END + len(ri)*0.10::DOUBLE + len(ne)*0.15::DOUBLE))")} AS bias_score, array_to_string(v, '|') AS violations FROM (
 SELECT *, list_concat(CASE WHEN em THEN ['Student email was not anonymized in transcription.'] ELSE [] END, list_transform(ri, lambda t: 'Anonymization risk: student metadata trigger ''' || t || ''' detected in text.'),
  list_transform(ne, lambda t: 'Neatness neutrality violation: feedback references handwriting/neatness using term ''' || t || '''.')) AS v FROM (
 SELECT doc_id, regexp_matches(lower(text), '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9-.]+') AS em, list_filter({_list(X.IDENTITY_TRIGGERS)}, lambda t: contains(lower(text), t)) AS ri,
 list_filter({_list(X.NEATNESS_TRIGGERS)}, lambda t: contains(lower(fb), t)) AS ne FROM (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN 'Bad handwriting, messy' WHEN 1 THEN 'Illegible' ELSE text END AS fb FROM documents)))""",
)
def h23_bias_scan(spark, d):
    feedback = F.when(F.col("doc_id") % 4 == 0, "Bad handwriting, messy").when(F.col("doc_id") % 4 == 1, "Illegible").otherwise(F.col("text"))
    b = TX.bias_scan(F.col("text"), feedback)
    return docs(spark, d).select("doc_id", b["verified_bias_free"].alias("verified_bias_free"), b["bias_score"].alias("bias_score"), F.array_join(b["violations"], "|").alias("violations"))


_LOG = """'UPLOAD student_roll_number=CS' || o_custkey || ' student_name=' || replace(c_name, '#', ' ') || ' stage=ocr, file cs' || o_custkey || '_' || md5(o_orderkey::VARCHAR)[1:8] || '.pdf for PHY' || (1000 + o_orderkey) || ' Bearer t' || md5(c_name) || ' eyJhbGciOi.' || md5(c_name)[1:9] || '.' || md5(c_name)[10:20] || ' /v1?page=2&refresh_token=' || o_custkey || '&x=1'"""


@query(
    "h28_redacted_logs",
    f"""SELECT o_orderkey AS line_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t,
 '(student_roll_number\\s*[=:]\\s*)(\\S+)', '\\1[REDACTED]', 'gi'), '(student_name\\s*[=:]\\s*)([^,=]+?)(\\s+\\w+\\s*[=:]|,|$)', '\\1[REDACTED]\\3', 'gi'), '\\b[A-Za-z0-9]+_[0-9a-f]{{6,}}\\.(pdf|png|jpe?g|json)\\b', '[REDACTED].\\1', 'gi'),
 '\\b[A-Z]{{2,4}}\\d{{3,10}}\\b', '[REDACTED]', 'g'), '\\beyJ[A-Za-z0-9_-]{{4,}}\\.[A-Za-z0-9_-]{{4,}}\\.[A-Za-z0-9_-]{{4,}}', '[REDACTED]', 'g'), '(Bearer\\s+)[A-Za-z0-9._\\-]+', '\\1[REDACTED]', 'gi'),
 '([?&](?:token|key|api_key|apikey|access_token|refresh_token|id_token|auth|authorization|secret|password|signature|sig)=)[^&\\s]+', '\\1[REDACTED]', 'gi') AS line
 FROM (SELECT o_orderkey, {_LOG} AS t FROM orders JOIN customer ON o_custkey = c_custkey)""",
)
def h28_redacted_logs(spark, d):
    orders, cust = V.table(spark, d, "orders"), V.table(spark, d, "customer")
    md5 = lambda c: F.md5(F.col(c).cast("string").cast("binary"))
    s = lambda c: F.col(c).cast("string")
    line = F.concat(
        F.lit("UPLOAD student_roll_number=CS"), s("o_custkey"), F.lit(" student_name="), F.replace("c_name", F.lit("#"), F.lit(" ")), F.lit(" stage=ocr, file cs"),
        s("o_custkey"), F.lit("_"), F.substring(md5("o_orderkey"), 1, 8), F.lit(".pdf for PHY"), (F.col("o_orderkey") + 1000).cast("string"), F.lit(" Bearer t"), md5("c_name"),
        F.lit(" eyJhbGciOi."), F.substring(md5("c_name"), 1, 9), F.lit("."), F.substring(md5("c_name"), 10, 11), F.lit(" /v1?page=2&refresh_token="), s("o_custkey"), F.lit("&x=1"),
    )
    logs = orders.join(cust, orders.o_custkey == cust.c_custkey).select(F.col("o_orderkey").alias("line_id"), line.alias("raw"))
    return logs.select("line_id", TX.redact(F.col("raw")).alias("line"))


@query("h28_redacted_documents")
def h28_redacted_documents(spark, d):
    return docs(spark, d).select("doc_id", TX.redact(F.col("text")).alias("text"))


_FILES = """fl AS (SELECT o_orderkey, 'store/' || o_orderkey || '/CS' || o_custkey || '_' || md5(o_orderkey::VARCHAR)[1:8] AS path, 'CS' || lpad(o_custkey::VARCHAR, 4, '0') || '_' || md5(o_orderkey::VARCHAR)[1:8] AS stem,
 o_orderpriority || ' answer by cs' || lpad(((o_custkey * 7) % 2000)::VARCHAR, 4, '0') || '; see PHY' || o_orderkey || '.' AS content FROM orders)"""


def _files(spark, d):
    o = V.table(spark, d, "orders")
    tag = F.substring(F.md5(F.col("o_orderkey").cast("string").cast("binary")), 1, 8)
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey")
    return o.select(
        F.concat(F.lit("store/"), key, F.lit("/CS"), cust.cast("string"), F.lit("_"), tag).alias("path"),
        F.concat(F.lit("CS"), F.lpad(cust.cast("string"), 4, "0"), F.lit("_"), tag).alias("stem"),
        F.concat(F.col("o_orderpriority"), F.lit(" answer by cs"), F.lpad(((cust * 7) % 2000).cast("string"), 4, "0"), F.lit("; see PHY"), key, F.lit(".")).alias("content"),
        F.lit(".PDF").alias("suffix"),
    )


def _tok(t: str) -> str:
    return f"list_filter(string_split_regex({t}, '[^A-Za-z0-9]+'), lambda x: regexp_full_match(x, '[A-Za-z]{{2,4}}[0-9]{{2,10}}'))"


@query(
    "c13_surviving_identifiers",
    f"""WITH {_FILES}, kn AS (SELECT lower('CS' || lpad(c_custkey::VARCHAR, 4, '0')) AS token FROM customer WHERE c_mktsegment = 'MACHINERY'),
 fd AS (SELECT path, 'filename' AS place, lower(unnest({_tok('stem')})) AS token FROM fl UNION SELECT path, 'content', lower(unnest({_tok('content')})) FROM fl)
 SELECT path, place, string_agg(token, ', ' ORDER BY token) AS tokens FROM fd WHERE token IN (SELECT token FROM kn) GROUP BY 1, 2""",
)
def c13_surviving_identifiers(spark, d):
    known = V.table(spark, d, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.concat(F.lit("CS"), F.lpad(F.col("c_custkey").cast("string"), 4, "0")).alias("token"))
    return CT.surviving_identifiers(_files(spark, d), known)


@query(
    "h29_pseudonyms",
    f"WITH {_FILES} SELECT path, 'S_' || sha256('a secret|' || path)[1:16] || '.pdf' AS new_name, array_to_string(list_sort(list_distinct({_tok('stem')})), ',') AS roll_tokens FROM fl",
)
def h29_pseudonyms(spark, d):
    return CT.pseudonyms(_files(spark, d), "a secret").withColumn("roll_tokens", F.array_join("roll_tokens", ","))


# --- headers, quality -----------------------------------------------------------------------------


@query(
    "h30_line_headers",
    with_views(
        "tlines",
        """SELECT script_id, line_idx, regexp_matches(trim(text), '^(?:Part|Section|Group|Block)\\s*[-:\\s]*[A-Z0-9]+\\s*$', 'i') AS is_section, CASE WHEN regexp_matches(trim(text), '^(?:Part|Section|Group|Block)\\s*[-:\\s]*[A-Z0-9]+\\s*$', 'i') THEN NULL
 ELSE coalesce(nullif(regexp_extract(trim(text), '^(?:Part\\s+[A-Z]\\s*)?(?:Q\\.?\\s*)?(\\d{1,3})\\s*[.)]?\\s*$', 1, 'i'), ''), nullif(regexp_extract(trim(text), '^(?:Part\\s+[A-Z]\\s*)?(?:Q\\.?\\s*)?(\\d{1,3})\\s*[.)]\\s*(?:.*)$', 1, 'i'), '')) END AS number FROM tlines""",
    ),
)
def h30_line_headers(spark, d):
    t = F.col("text")
    return V.transcript_lines(spark, d).select("script_id", "line_idx", TX.is_section_header(t).alias("is_section"), TX.question_header(t).alias("number"))


@query("h33_char_error_rate", "SELECT p_partkey, round(levenshtein(p_name, translate(p_name || ' x', 'lote', '1073'))/length(p_name)::DOUBLE, 9) AS cer FROM part")
def h33_char_error_rate(spark, d):
    damaged = F.translate(F.concat("p_name", F.lit(" x")), "lote", "1073")
    return V.table(spark, d, "part").select("p_partkey", F.round(TX.char_error_rate(F.col("p_name"), damaged), 9).alias("cer"))


@F.pandas_udf(T.DoubleType())
def wer(reference, hypothesis):
    return reference.combine(hypothesis, word_error_rate)


@query("h33_word_error_rate")
def h33_word_error_rate(spark, d):
    c = V.table(spark, d, "conversations")
    return c.select("conv_id", "turn", wer("text", F.translate("text", "lS", "15")).alias("wer"))


@query(
    "h34_text_quality",
    f"""WITH s AS (SELECT doc_id, trim(text, e' \\t\\n\\r') AS t FROM documents), c AS (SELECT doc_id, max(n) AS m FROM (SELECT doc_id, ch, count(*) AS n FROM (SELECT doc_id, unnest(string_split(t, '')) AS ch FROM s) GROUP BY 1, 2) GROUP BY 1)
 SELECT doc_id, CASE WHEN length(t) = 0 THEN 0 WHEN length(t) < 3 THEN 0.4 WHEN q < 0.5 THEN 0.45 WHEN m/length(t)::DOUBLE > 0.6 THEN 0.5 ELSE {r("least(0.92::DOUBLE, 0.75::DOUBLE + q*0.15::DOUBLE)", 3)} END::DOUBLE AS quality
 FROM (SELECT doc_id, t, m, length(regexp_replace(t, '[^\\p{{L}}\\p{{N}}\\s]', '', 'g'))/length(t)::DOUBLE AS q FROM s LEFT JOIN c USING (doc_id))""",
)
def h34_text_quality(spark, d):
    return docs(spark, d).select("doc_id", TX.text_quality(F.col("text")).alias("quality"))


@query("h35_content_hashes")
def h35_content_hashes(spark, d):
    from marklake.operators.marks import content_sha256, with_provenance

    lines = V.transcript_lines(spark, d)
    hashed = lines.select("script_id", "line_idx", content_sha256("text", "confidence").alias("extraction_sha256"))
    stamped = with_provenance(hashed, segmentation="segmentation/1.0.0")
    return stamped.select("script_id", "line_idx", "extraction_sha256", F.col("provenance.scorer").alias("scorer"), F.col("provenance.segmentation").alias("segmentation"))


# --- contamination ------------------------------------------------------------------------------------


@query(
    "c9_lifted_phrases",
    """WITH p AS (SELECT item_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS t FROM (SELECT item_id, unnest(string_split_regex(text, '[.\\n]')) AS text FROM benchmark)),
 a AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS t FROM documents)
 SELECT DISTINCT p.t AS phrase_id, doc_id AS answer_id FROM p JOIN a ON contains(a.t, p.t) WHERE len(list_filter(string_split(p.t, ' '), lambda w: length(w) > 1)) >= 3""",
)
def c9_lifted_phrases(spark, d):
    b = V.table(spark, d, "benchmark").select(F.explode(F.split("text", "[.\n]")).alias("phrase_text"))
    phrases = b.select(CT.plain(F.col("phrase_text")).alias("phrase_id"), "phrase_text").dropDuplicates(["phrase_id"])
    return CT.lifted_phrases(phrases, docs(spark, d).select(F.col("doc_id").alias("answer_id"), F.col("text").alias("answer_text")))


@query(
    "c9_lifted_passages",
    """WITH p AS (SELECT item_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS t FROM benchmark), a AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS t FROM documents)
 SELECT item_id AS phrase_id, doc_id AS answer_id FROM p JOIN a ON contains(a.t, p.t) WHERE len(list_filter(string_split(p.t, ' '), lambda w: length(w) > 1)) >= 3""",
)
def c9_lifted_passages(spark, d):
    b = V.table(spark, d, "benchmark").select(F.col("item_id").alias("phrase_id"), F.col("text").alias("phrase_text"))
    return CT.lifted_phrases(b, docs(spark, d).select(F.col("doc_id").alias("answer_id"), F.col("text").alias("answer_text")))


def _singular(t: str) -> str:
    toks = f"list_filter(list_transform(regexp_extract_all(lower({t}), '[A-Za-z][A-Za-z0-9\\-]*'), lambda w: trim(w, '-')), lambda w: length(w) >= 3 AND w NOT IN {_in(X.PAPER_STOPWORDS)})"
    return f"list_transform({toks}, lambda w: CASE WHEN length(w) > 4 AND w LIKE '%ies' THEN w[:-4] || 'y' WHEN length(w) > 3 AND w LIKE '%es' AND w NOT LIKE '%ses' THEN w[:-3] WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:-2] ELSE w END)"


@query(
    "c10_scheme_against_paper",
    "WITH pq AS ("
    + SQ.query.oracles["e11_paper_questions"]
    + f"""), sch AS (SELECT c.paper_id, n::VARCHAR AS question_number, b.text AS question_text, v.text AS vt, n::DOUBLE AS max_marks FROM (SELECT DISTINCT conv_id AS paper_id FROM conversations) c, range(1, 6) r(n),
  benchmark b, benchmark v WHERE b.item_id = (c.paper_id + n) % (SELECT count(*) FROM benchmark) AND v.item_id = (c.paper_id + n + 7) % (SELECT count(*) FROM benchmark)),
 j AS (SELECT s.*, p.question_text AS asked, p.part_header, list_distinct({_singular("coalesce(p.question_text, '')")}) AS pw, list_distinct({_singular('s.question_text')}) AS own, list_concat({_singular('s.question_text')}, {_singular('s.vt')}) AS vocab
  FROM sch s LEFT JOIN pq p ON s.paper_id = p.paper_id AND s.question_number = p.question_number),
 k AS (SELECT *, list_filter(pw, lambda w: NOT list_contains(vocab, w)) AS ms, list_filter(own, lambda w: NOT list_contains(pw, w)) AS un FROM j)
 SELECT paper_id, question_number, true AS ran, asked IS NOT NULL AS in_paper, CASE WHEN asked IS NOT NULL THEN round(o, 9) END AS overlap, CASE WHEN asked IS NOT NULL THEN len(ms) END AS n_missing, CASE WHEN asked IS NOT NULL THEN array_to_string(list_sort(un), ' ') END AS unasked,
 asked IS NOT NULL AND part_header IS NOT NULL AND max_marks NOT IN (3, 2) AS marks_mismatch, asked IS NULL OR o < 0.5 OR (part_header IS NOT NULL AND max_marks NOT IN (3, 2)) AS flagged
 FROM (SELECT *, CASE WHEN len(pw) > 0 THEN (len(pw)-len(ms))/len(pw)::DOUBLE ELSE 0 END AS o FROM k)""",
)
def c10_scheme_against_paper(spark, d):
    papers = V.table(spark, d, "conversations").select(F.col("conv_id").alias("paper_id")).distinct()
    bench = V.table(spark, d, "benchmark")
    n = bench.agg(F.count(F.lit(1))).scalar()
    entries = papers.select("paper_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("n"))
    asked = entries.withColumn("_q", (F.col("paper_id") + F.col("n")) % n).withColumn("_v", (F.col("paper_id") + F.col("n") + 7) % n)
    texts = asked.join(bench.select(F.col("item_id").alias("_q"), F.col("text").alias("question_text")), "_q").join(
        bench.select(F.col("item_id").alias("_v"), F.col("text").alias("_vt")), "_v"
    )
    scheme = texts.select("paper_id", F.col("n").cast("string").alias("question_number"), "question_text", F.array("_vt").alias("value_texts"), F.col("n").cast("double").alias("max_marks"))
    from marklake.operators.segment import paper_questions

    out = CT.check_scheme_against_paper(scheme, paper_questions(SQ.paper_lines(spark, d)), ["paper_id", "question_number"])
    return out.select(
        "paper_id", "question_number", "ran", "in_paper", F.round("overlap", 9).alias("overlap"), F.size("missing_from_scheme").cast("bigint").alias("_n"),
        F.array_join("unasked_by_paper", " ").alias("unasked"), "marks_mismatch", "flagged",
    ).withColumn("n_missing", F.when(F.col("in_paper"), F.col("_n"))).drop("_n")


@query(
    "e12_keep_first",
    """SELECT user_id, rank, item FROM (SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY first) AS rank FROM (
 SELECT user_id, arg_min(trim(t), event_id) AS item, min(event_id) AS first FROM (SELECT user_id, event_id, CASE event_id % 3 WHEN 0 THEN ' ' || upper(event_type) || '  Done' ELSE event_type || ' done ' END AS t FROM events) GROUP BY user_id, regexp_replace(lower(trim(t)), '\\s+', ' ', 'g'))) WHERE rank <= 3""",
)
def e12_keep_first(spark, d):
    t = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), F.upper("event_type"), F.lit("  Done"))).otherwise(F.concat("event_type", F.lit(" done ")))
    items = V.table(spark, d, "events").select("user_id", "event_id", t.alias("item"))
    return FB.keep_first(items, ["user_id"], "item", "event_id", 3).withColumn("rank", F.col("rank").cast("bigint"))
