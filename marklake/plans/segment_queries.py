"""Registered queries: segmentation, recognition output, papers."""

from __future__ import annotations

from pyspark.sql import functions as F

from marklake.operators import marks as M
from marklake.operators import ocr_select as O
from marklake.operators import segment as S
from marklake.plans import views as V
from marklake.plans.common import Catalog
from marklake.plans.views import with_views

query = Catalog()

_REGIONS = """k AS (SELECT *, CASE WHEN is_section THEN 'section' WHEN is_header THEN 'header' ELSE 'plain' END AS kind FROM tlines),
 b AS (SELECT *, kind = 'header' OR (kind = 'plain' AND coalesce(lag(kind) OVER (PARTITION BY script_id ORDER BY line_idx), 'section') = 'section') AS opens FROM k),
 n AS (SELECT *, sum(opens::INT) OVER (PARTITION BY script_id ORDER BY line_idx)::BIGINT AS region_no FROM b),
 g AS (SELECT script_id, region_no, coalesce(max(CASE WHEN is_header THEN header_number END), 'UNMAPPED') AS question_number, min(page_number) AS first_page, max(page_number) AS last_page,
  count(DISTINCT page_number) AS n_pages, count(*) AS n_lines, min(confidence) AS confidence, bool_or(struck_through) AS contains_struck_out FROM n WHERE NOT is_section GROUP BY 1, 2),
 s AS (SELECT *, CASE WHEN question_number = 'UNMAPPED' THEN 'UNMAPPED_REGION' WHEN row_number() OVER (PARTITION BY script_id, question_number ORDER BY region_no) > 1 THEN 'AMBIGUOUS_MAPPING'
  WHEN n_pages > 1 THEN 'SPANS_PAGES' ELSE 'OK' END AS st, try_cast(question_number AS BIGINT) AS num FROM g),
 o AS (SELECT *, coalesce(num < max(num) OVER (PARTITION BY script_id ORDER BY region_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS down FROM s),
 regions AS (SELECT o.* EXCLUDE (st, num, down), CASE WHEN st = 'OK' AND (down OR coalesce(lead(down) OVER (PARTITION BY script_id ORDER BY region_no), false)) THEN 'OUT_OF_ORDER' ELSE st END AS status FROM o)"""


@query("e1_segmented_regions", with_views("tlines", "SELECT * FROM regions", _REGIONS))
def e1_segmented_regions(spark, d):
    return S.segment_scripts(V.transcript_lines(spark, d), with_text=False)


@query("e2_region_status_counts", with_views("tlines", "SELECT status, count(*) AS n FROM regions GROUP BY status", _REGIONS))
def e2_region_status_counts(spark, d):
    return S.segment_scripts(V.transcript_lines(spark, d), with_text=False).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("h31_region_texts")
def h31_region_texts(spark, d):
    return S.segment_scripts(V.transcript_lines(spark, d)).select("script_id", "region_no", "question_number", "text", "status")


@query(
    "c6_missing_questions",
    with_views(
        "tlines",
        """SELECT s.script_id, e.question_number, 'MISSING_QUESTION_NUMBER' AS status FROM (SELECT DISTINCT script_id FROM tlines) s, (SELECT unnest(['1','2','3','4','5','6','7']) AS question_number) e
 WHERE NOT EXISTS (SELECT 1 FROM regions r WHERE r.script_id = s.script_id AND r.question_number = e.question_number)""",
        _REGIONS,
    ),
)
def c6_missing_questions(spark, d):
    lines = V.transcript_lines(spark, d)
    regions = S.segment_scripts(lines, with_text=False)
    return S.missing_questions(regions, lines.select("script_id").distinct(), [str(i) for i in range(1, 8)])


@query(
    "b11_routable_regions",
    with_views(
        "tlines",
        "SELECT script_id, region_no, status IN ('OK','SPANS_PAGES') AND NOT contains_struck_out AS routable FROM regions",
        _REGIONS,
    ),
)
def b11_routable_regions(spark, d):
    regions = S.segment_scripts(V.transcript_lines(spark, d), with_text=False)
    return regions.select("script_id", "region_no", S.is_routable(F.col("status"), F.col("contains_struck_out")).alias("routable"))


def _scheme_numbers(spark, d):
    return V.table(spark, d, "benchmark").select(
        (F.col("item_id") * 2 + 1).cast("string").alias("question_number"), F.col("item_id").alias("question_id"), F.lit(5.0).alias("max_marks")
    )


_OUT = (
    _REGIONS
    + """, outc AS (SELECT r.*, q.item_id, CASE WHEN NOT (status IN ('OK','SPANS_PAGES') AND NOT contains_struck_out) THEN 'routed' WHEN q.item_id IS NULL THEN 'no_scheme' ELSE 'scored' END AS outcome
 FROM regions r LEFT JOIN benchmark q ON r.question_number = (q.item_id*2+1)::VARCHAR)"""
)


def _outcomes(spark, d):
    regions = S.segment_scripts(V.transcript_lines(spark, d), with_text=False).withColumn("has_flags", F.col("contains_struck_out"))
    return M.region_outcomes(regions, _scheme_numbers(spark, d))


@query(
    "c5_region_outcomes",
    with_views(
        "tlines",
        """SELECT script_id, region_no, outcome, CASE WHEN outcome = 'routed' THEN CASE WHEN contains_struck_out THEN 'CONTAINS_STRUCK_OUT' ELSE 'segmentation status ' || status END END AS reason FROM outc""",
        _OUT,
    ),
)
def c5_region_outcomes(spark, d):
    return _outcomes(spark, d).select("script_id", "region_no", "outcome", "reason")


@query(
    "d31_grading_coverage",
    with_views(
        "tlines",
        """SELECT script_id, count(*) FILTER (WHERE outcome='scored') AS n_scored, count(*) FILTER (WHERE outcome='routed') AS n_routed, count(*) FILTER (WHERE outcome='no_scheme') AS n_no_scheme,
 count(*) FILTER (WHERE outcome='scored' AND n_lines > 1) AS n_flagged, coalesce(sum(n_lines/2.0::DOUBLE) FILTER (WHERE outcome='scored'), 0) AS total_awarded,
 coalesce(sum(5.0::DOUBLE) FILTER (WHERE outcome='scored'), 0) AS total_possible FROM outc GROUP BY script_id""",
        _OUT,
    ),
)
def d31_grading_coverage(spark, d):
    rows = _outcomes(spark, d).withColumn("total", F.col("n_lines") / 2.0).withColumn("flagged", F.col("n_lines") > 1)
    return M.grading_coverage(rows)


@query("e6_nested_label_answers")
def e6_nested_label_answers(spark, d):
    lines = V.transcript_lines(spark, d)
    labelled = F.when(F.col("line_idx") % 4 == 1, F.concat(F.lit("(a) "), F.col("text"))).when(
        F.col("line_idx") % 4 == 3, F.concat(F.lit("(ii) "), F.col("text"))
    )
    return S.label_answers(lines.withColumn("text", F.coalesce(labelled, F.col("text"))))


@query(
    "d30_region_content_flags",
    with_views(
        "tlines",
        f"""SELECT script_id, region_no, {", ".join(f"coalesce(CASE WHEN count({f}) > 0 THEN bool_or({f}) ELSE any_value(a_{f}) END, false) AS {f}" for f in S.CONTENT_FLAGS)}
 FROM (SELECT DISTINCT script_id, region_no, page_number FROM n WHERE NOT is_section) rp LEFT JOIN pf USING (script_id, page_number) LEFT JOIN af USING (script_id) GROUP BY 1, 2""",
        _REGIONS
        + f""", pf AS (SELECT script_id, page_number, bool_or(length(text) % 3 = 0) AS contains_diagram, bool_or(length(text) % 7 = 0) AS contains_table, bool_or(length(text) % 13 = 0) AS contains_equation,
  bool_or(struck_through) AS contains_struck_out, bool_or(length(text) % 17 = 0) AS non_latin_script FROM tlines WHERE page_number <> 1 GROUP BY 1, 2),
 af AS (SELECT script_id, {", ".join(f"bool_or({f}) AS a_{f}" for f in S.CONTENT_FLAGS)} FROM pf GROUP BY 1)""",
    ),
)
def d30_region_content_flags(spark, d):
    lines = V.transcript_lines(spark, d)
    n = F.length("text")
    page_flags = (
        lines.filter("page_number <> 1")  # pages that were never classified fall back to the script
        .groupBy("script_id", "page_number")
        .agg(
            F.max(n % 3 == 0).alias("contains_diagram"),
            F.max(n % 7 == 0).alias("contains_table"),
            F.max(n % 13 == 0).alias("contains_equation"),
            F.max("struck_through").alias("contains_struck_out"),
            F.max(n % 17 == 0).alias("non_latin_script"),
        )
    )
    pages = S.number_regions(lines).select("script_id", "region_no", "page_number").distinct()
    return S.region_content_flags(pages, page_flags)


@query(
    "d19_script_confidence",
    with_views(
        "tlines",
        """SELECT script_id, avg(m) AS mean_confidence, min(c) AS lowest_confidence, min(c) IS NULL OR min(c) < 0.80 AS below_floor
 FROM (SELECT script_id, page_number, avg(confidence) AS m, min(confidence) AS c FROM tlines GROUP BY 1, 2) GROUP BY 1""",
    ),
)
def d19_script_confidence(spark, d):
    return O.script_confidence(O.page_confidence(V.transcript_lines(spark, d), ["script_id", "page_number"]))


@query(
    "d27_engine_vote",
    with_views(
        "eouts",
        """SELECT page_id, engine, output_id, confidence, line_count FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY line_count > 0 DESC,
 CASE WHEN line_count > 0 THEN confidence END DESC, CASE WHEN line_count > 0 THEN line_count END DESC, output_id) AS rn FROM eouts) WHERE rn = 1""",
    ),
)
def d27_engine_vote(spark, d):
    return O.vote(V.engine_outputs(spark, d), ["page_id"], "output_id")


_ENGINES = ["click", "view", "purchase", "signup"]


@query(
    "e10_engine_fallback",
    with_views(
        "eouts",
        """SELECT p.page_id, p.bucket, coalesce(a.engine, CASE WHEN b.confidence IS NULL OR b.confidence < 0.70 THEN f.engine END, CASE WHEN b.line_count > 0 THEN b.engine END) AS engine,
 CASE WHEN a.engine IS NOT NULL THEN a.confidence WHEN (b.confidence IS NULL OR b.confidence < 0.70) AND f.engine IS NOT NULL THEN f.confidence WHEN b.line_count > 0 THEN b.confidence END AS confidence,
 CASE WHEN a.engine IS NOT NULL THEN 'ACCEPTED' WHEN (b.confidence IS NULL OR b.confidence < 0.70) AND f.engine IS NOT NULL THEN 'FALLBACK' WHEN b.line_count > 0 THEN 'FALLBACK' ELSE 'FAILED' END AS outcome
 FROM (SELECT DISTINCT page_id, bucket FROM e) p
 LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, bucket ORDER BY pl, output_id) AS rn FROM e WHERE pl > 0 AND confidence >= 0.70 AND text_length >= 10) WHERE rn = 1) a ON p.page_id = a.page_id AND p.bucket = a.bucket
 LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, bucket ORDER BY confidence DESC, pl, output_id) AS rn FROM e WHERE pl > 0) WHERE rn = 1) b ON p.page_id = b.page_id AND p.bucket = b.bucket
 LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, bucket ORDER BY output_id DESC) AS rn FROM e WHERE engine = 'error' AND line_count > 0) WHERE rn = 1) f ON p.page_id = f.page_id AND p.bucket = f.bucket""",
        "e AS (SELECT *, coalesce(list_position(['click','view','purchase','signup'], engine), 0) AS pl, output_id % 16 AS bucket FROM eouts)",
    ),
)
def e10_engine_fallback(spark, d):
    outputs = V.engine_outputs(spark, d).withColumn("bucket", F.col("output_id") % 16)
    return O.route(outputs, ["page_id", "bucket"], _ENGINES, last_resort="error")


def _benchmark(spark, d):
    return V.engine_outputs(spark, d).select(
        "engine",
        F.col("page_id").alias("case"),
        "output_id",
        F.col("confidence").alias("cer"),
        (F.col("confidence") / 2).alias("wer"),
        (1.0 - F.col("confidence")).alias("confidence"),
        F.when(F.col("output_id") % 9 == 0, "failed").alias("error"),
    )


@query(
    "d32_benchmark_summary",
    with_views("eouts", "SELECT engine, avg(confidence) AS avg_cer, avg(confidence/2) AS avg_wer, avg(1.0::DOUBLE-confidence) AS avg_confidence FROM eouts WHERE output_id % 9 <> 0 GROUP BY engine"),
)
def d32_benchmark_summary(spark, d):
    return O.benchmark_summary(_benchmark(spark, d))


@query(
    "d32_benchmark_matrix",
    with_views(
        "eouts",
        f"""SELECT page_id AS "case", {", ".join(f"coalesce(max(CASE WHEN engine = '{e}' THEN cell END), 'N/A') AS {e}" for e in [*_ENGINES, "error"])} FROM (
 SELECT page_id, engine, CASE WHEN output_id % 9 <> 0 THEN 'CER=' || format('{{:.2f}}', floor(confidence*100+0.5)/100) ELSE 'ERROR' END AS cell, row_number() OVER (PARTITION BY page_id, engine ORDER BY output_id) AS rn FROM eouts) WHERE rn = 1 GROUP BY 1""",
    ),
)
def d32_benchmark_matrix(spark, d):
    return O.benchmark_matrix(_benchmark(spark, d), [*_ENGINES, "error"], "output_id")


_BOXES = """boxes AS (SELECT user_id AS page_id, event_id AS region_id, event_type AS text, round(value)/512.0::DOUBLE AS confidence, ((event_id*7919) % 6000)::DOUBLE AS top_y, ((event_id*31) % 800)::DOUBLE AS left_x FROM events)"""


def _boxes(spark, d):
    e = V.table(spark, d, "events")
    top = ((F.col("event_id") * 7919) % 6000).cast("double")
    left = ((F.col("event_id") * 31) % 800).cast("double")
    return e.select(
        F.col("user_id").alias("page_id"),
        F.col("event_id").alias("region_id"),
        F.col("event_type").alias("text"),
        (F.round("value") / 512.0).alias("confidence"),
        top.alias("top_y"),
        left.alias("left_x"),
        left.alias("x0"),
        top.alias("y0"),
        (left + 50).alias("x1"),
        (top + 12).alias("y1"),
    )


@query(
    "e4_visual_lines",
    f"""WITH {_BOXES}, s AS (SELECT *, coalesce(abs(top_y - lag(top_y) OVER (PARTITION BY page_id ORDER BY top_y, region_id)) > 20, false) AS opens FROM boxes),
 l AS (SELECT *, sum(opens::INT) OVER (PARTITION BY page_id ORDER BY top_y, region_id)::BIGINT AS line_no FROM s)
 SELECT page_id, line_no, string_agg(text, ' ' ORDER BY left_x, top_y, region_id) AS text, avg(confidence) AS confidence, min(left_x) AS x0, min(top_y) AS y0, max(left_x+50) AS x1, max(top_y+12) AS y1 FROM l GROUP BY 1, 2""",
)
def e4_visual_lines(spark, d):
    return S.visual_lines(_boxes(spark, d))


@query(
    "e5_word_lines",
    """SELECT user_id AS page_id, event_id % 3 AS block_num, event_id % 7 AS line_num, string_agg(event_type, ' ' ORDER BY (event_id*31) % 800, event_id) AS text, round(avg((event_id % 102 - 1)/100.0::DOUBLE), 9) AS confidence,
 min(((event_id*31) % 800)::DOUBLE) AS x0, min((event_id % 7)::DOUBLE) AS y0, max(((event_id*31) % 800 + 40)::DOUBLE) AS x1, max((event_id % 7 + 10)::DOUBLE) AS y1
 FROM events WHERE event_id % 102 <> 0 AND event_id % 11 <> 0 GROUP BY 1, 2, 3""",
)
def e5_word_lines(spark, d):
    e, i = V.table(spark, d, "events"), F.col("event_id")
    words = e.select(
        F.col("user_id").alias("page_id"),
        i.alias("word_id"),
        (i % 3).alias("block_num"),
        (i % 7).alias("line_num"),
        F.when(i % 11 != 0, F.concat(F.lit(" "), F.col("event_type"))).otherwise("  ").alias("text"),
        (i % 102 - 1).cast("double").alias("conf"),
        ((i * 31) % 800).cast("double").alias("left"),
        (i % 7).cast("double").alias("top"),
        F.lit(40.0).alias("width"),
        F.lit(10.0).alias("height"),
    )
    return S.word_lines(words).withColumn("confidence", F.round("confidence", 9))


def paper_lines(spark, d):
    c = V.table(spark, d, "conversations")
    head = (
        F.when(F.col("role") == "user", F.concat(((F.col("conv_id") * 7 + F.col("turn") * 5) % 4 + 1).cast("string"), F.lit(". ")))
        .when(F.col("role") == "system", F.lit("Part - B - (3*2=6 Marks)\nAnswer any two questions\n"))
        .when(F.col("turn") % 4 == 3, F.lit("Answer any three questions now\n"))
        .otherwise("")
    )
    lines = F.posexplode(F.split(F.concat(head, F.col("text")), "\n"))
    return c.select(F.col("conv_id").alias("paper_id"), F.col("turn").alias("block"), lines.alias("line_idx", "text"))


@query(
    "e11_paper_questions",
    r"""WITH l AS (SELECT paper_id, block, i AS line_idx, ls[i] AS text FROM (SELECT conv_id AS paper_id, turn AS block, string_split(
  CASE WHEN role='user' THEN ((conv_id*7+turn*5)%4+1)::VARCHAR || '. ' WHEN role='system' THEN 'Part - B - (3*2=6 Marks)' || chr(10) || 'Answer any two questions' || chr(10)
  WHEN turn%4=3 THEN 'Answer any three questions now' || chr(10) ELSE '' END || text, chr(10)) AS ls FROM conversations) x, range(1, 40000) t(i) WHERE i <= len(ls)),
 k AS (SELECT *, CASE WHEN text LIKE 'Part - B - (%' THEN 'part' WHEN regexp_matches(text, '^\s*Answer any (two|three) questions') THEN 'instruction' WHEN regexp_matches(text, '^\s*\d{1,2}\s*[.)]\s+\S') THEN 'start' ELSE 'text' END AS kind FROM l),
 n AS (SELECT *, sum((kind IN ('part','start'))::INT) OVER w AS seg, last_value(CASE WHEN kind='part' THEN text END IGNORE NULLS) OVER w AS part_header, last_value(CASE WHEN kind='instruction' THEN trim(text) END IGNORE NULLS) OVER w AS instruction
  FROM k WINDOW w AS (PARTITION BY paper_id ORDER BY block, line_idx ROWS UNBOUNDED PRECEDING)),
 st AS (SELECT *, regexp_extract(text, '^\s*(\d{1,2})', 1) AS qn, trim(regexp_extract(text, '^\s*\d{1,2}\s*[.)]\s+(\S.*)$', 1), e' \t\r') AS rest FROM n WHERE kind='start'),
 f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, qn ORDER BY seg) AS rn FROM st) WHERE rn = 1),
 c AS (SELECT st.paper_id, st.qn, string_agg(trim(n.text, e' \t\r'), ' ' ORDER BY n.seg, n.block, n.line_idx) AS more FROM st JOIN n ON n.paper_id=st.paper_id AND n.seg=st.seg AND n.kind='text' AND trim(n.text, e' \t\r') <> '' GROUP BY 1, 2)
 SELECT f.paper_id, f.qn AS question_number, rest || coalesce(' ' || more, '') AS question_text, CASE WHEN part_header IS NOT NULL THEN 'B' END AS part, part_header, instruction FROM f LEFT JOIN c ON f.paper_id=c.paper_id AND f.qn=c.qn""",
)
def e11_paper_questions(spark, d):
    return S.paper_questions(paper_lines(spark, d))
