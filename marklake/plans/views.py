"""Assessment-shaped views over the given tables, in Spark and in SQL.

Marks are multiples of one half and confidences multiples of 1/32, so that sums
are exact in any order and two engines can be compared to the last digit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMPLETED, PROCESSING, FAILED = "COMPLETED", "PROCESSING", "FAILED"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exams(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.year("o_orderdate") * 100 + F.month("o_orderdate")
    ids = table(spark, sf_dir, "orders").select(month.cast("bigint").alias("exam_id")).distinct()
    e = F.col("exam_id")
    return ids.select(
        e,
        (e % 5).alias("teacher_id"),
        F.concat(F.lit("Exam "), e.cast("string")).alias("title"),
        F.when(e % 3 == 0, "Physics").when(e % 3 == 1, "Biology").otherwise("Maths").alias("subject"),
        (e % 2 == 0).alias("results_published"),
        F.when(e % 3 == 0, F.concat(F.lit("key_"), e.cast("string"))).alias("answer_key_url"),
        F.when(e % 7 == 0, "ANSWER_KEY").when(e % 7 == 1, "AI_AUTONOMOUS").alias("evaluation_mode"),
        F.lit(100.0).alias("exam_total_marks"),
    )


def question_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part")
    share = (F.col("l_partkey") * 31 + F.col("l_suppkey") * 17 + F.col("l_linenumber") * 7) % 101
    tenths = F.round(F.col("l_tax") * 100).cast("bigint")
    missing = F.col("l_returnflag") == "R"
    return li.join(part, li.l_partkey == part.p_partkey).select(
        F.col("l_orderkey").alias("submission_id"),
        F.concat_ws(
            "-",
            F.lpad(F.col("l_linenumber").cast("string"), 2, "0"),
            F.lpad(F.col("l_partkey").cast("string"), 9, "0"),
            F.lpad(F.col("l_suppkey").cast("string"), 9, "0"),
            F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"),
        ).alias("question_number"),
        F.col("l_linenumber").cast("bigint").alias("question_order"),
        F.col("l_quantity").alias("max_marks"),
        (F.floor(F.col("l_quantity") * share / 50.0) / 2.0).alias("score_awarded"),
        (1.0 - F.round(F.col("l_discount") * 100) / 32.0).alias("confidence"),
        (1.0 - (tenths % 4) / 16.0).alias("bias_score"),
        (tenths % 4 < 3).alias("bias_free"),
        F.when(
            F.col("p_size") % 7 != 0, F.concat(F.col("p_type"), F.lit(". Objectives: "), F.col("p_name"))
        ).alias("topic_context"),
        (F.col("l_linestatus") == "F").alias("has_semantic"),
        F.when(missing, F.array()).otherwise(F.array("p_brand")).cast("array<string>").alias("matched_semantic"),
        F.when(missing, F.array("p_brand")).otherwise(F.array()).cast("array<string>").alias("missing_semantic"),
        F.when(missing, F.array()).otherwise(F.array("p_name")).cast("array<string>").alias("matched_keywords"),
        F.when(missing, F.array("p_name")).otherwise(F.array()).cast("array<string>").alias("missing_concepts"),
        F.when(F.col("l_linenumber") != 4, F.round(F.col("l_discount") * 100) * 8).alias("concept_coverage"),
        F.col("p_name").alias("concept_text"),
    )


def evaluation_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stored evaluation document of a submission says at its top level."""
    qe = question_evaluations(spark, sf_dir)
    return qe.groupBy("submission_id").agg(
        F.sum("score_awarded").alias("total_score"),
        F.sum("max_marks").alias("max_possible"),
        F.avg("confidence").alias("confidence_score"),
        F.min("bias_score").alias("fairness_score"),
        F.bool_and("bias_free").alias("fairness_verified"),
    )


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    docs = evaluation_documents(spark, sf_dir)
    mode = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "ANSWER_KEY")
        .when(F.col("o_orderpriority") == "2-HIGH", "AI_AUTONOMOUS")
        .when(F.col("o_orderpriority") == "5-LOW", "UNSUPPORTED")
    )
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(docs, orders.o_orderkey == docs.submission_id, "left")
        .select(
            F.col("o_orderkey").alias("submission_id"),
            (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("bigint").alias("exam_id"),
            F.col("o_custkey").alias("student_id"),
            F.col("c_name").alias("student_name"),
            F.concat(F.lit("CS"), F.col("o_custkey").cast("string")).alias("student_roll_number"),
            F.when(F.col("o_orderstatus") == "F", COMPLETED)
            .when(F.col("o_orderstatus") == "O", PROCESSING)
            .otherwise(FAILED)
            .alias("status"),
            F.col("total_score").alias("obtained_marks"),
            F.col("max_possible").alias("total_marks"),
            F.col("confidence_score").alias("evaluation_confidence"),
            "fairness_score",
            "fairness_verified",
            F.when(docs.submission_id.isNotNull(), mode).alias("document_mode"),
            docs.submission_id.isNotNull().alias("has_document"),
            F.col("o_orderdate").alias("updated_at"),
        )
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    line = F.col("l_linenumber")
    return li.select(
        F.col("l_orderkey").alias("script_id"),
        line.cast("bigint").alias("question_number"),
        F.lit(10.0).alias("max_marks"),
        (F.round(F.col("l_tax") * 100) + 0.0).alias("human_mark"),
        (F.round(F.col("l_discount") * 100) + 0.0).alias("engine_mark_a"),
        F.when(F.col("l_partkey") % 3 != 0, ((F.col("l_partkey") + line) % 11).cast("double")).alias("engine_mark_b"),
        F.col("l_returnflag").alias("subject"),
        F.col("l_linestatus").alias("question_type"),
        F.when(F.col("l_suppkey") % 2 == 0, ((F.col("l_suppkey") + line) % 9).cast("double")).alias(
            "second_human_mark"
        ),
    )


def value_point_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer per order; return flags A and R are ANY_N groups, N stands alone."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("question_id"),
        F.concat_ws(
            "-",
            F.lpad(F.col("l_linenumber").cast("string"), 2, "0"),
            F.lpad(F.col("l_partkey").cast("string"), 9, "0"),
            F.lpad(F.col("l_suppkey").cast("string"), 9, "0"),
            F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"),
        ).alias("value_point_id"),
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("group_id"),
        F.when(F.col("l_returnflag") == "A", "ANY_N").when(F.col("l_returnflag") == "R", "ALL").alias("group_rule"),
        F.when(F.col("l_returnflag") == "A", 2).cast("int").alias("group_n"),
        F.col("l_quantity").alias("marks"),
        (F.col("l_linestatus") == "F").alias("matched"),
        (F.round(F.col("l_tax") * 100) == 0).alias("uncalibrated"),
        F.lit(80.0).alias("max_marks"),
    )


def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns carry a question header, system turns are section headers."""
    c = table(spark, sf_dir, "conversations")
    number = (F.col("conv_id") * 7 + F.col("turn") * 5) % 6 + 1
    one_line = F.translate("text", "\n", " ")
    return c.select(
        F.col("conv_id").alias("script_id"),
        F.floor(F.col("turn") / 3.0).cast("bigint").alias("page_number"),
        F.col("turn").alias("line_idx"),
        F.when(F.col("role") == "user", F.concat(number.cast("string"), F.lit(". "), one_line))
        .when(F.col("role") == "system", F.lit("Part B"))
        .otherwise(one_line)
        .alias("text"),
        F.when(F.length("text") % 5 != 0, 1.0 - (F.length("text") % 32) / 64.0).alias("confidence"),
        (F.length("text") % 11 == 0).alias("struck_through"),
    )


def engine_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("page_id"),
        F.col("event_type").alias("engine"),
        F.col("event_id").alias("output_id"),
        (F.round(F.col("value")) / 512.0).alias("confidence"),
        (F.col("event_id") % 40).alias("line_count"),
        (F.col("event_id") % 23).alias("text_length"),
    )


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", F.col("user_id"), F.col("event_type").alias("action")
    )


# --- the same views as SQL ---------------------------------------------------

_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "exams": (
        (),
        """SELECT exam_id, exam_id % 5 AS teacher_id, 'Exam ' || exam_id AS title,
        CASE exam_id % 3 WHEN 0 THEN 'Physics' WHEN 1 THEN 'Biology' ELSE 'Maths' END AS subject,
        exam_id % 2 = 0 AS results_published,
        CASE WHEN exam_id % 3 = 0 THEN 'key_' || exam_id END AS answer_key_url,
        CASE exam_id % 7 WHEN 0 THEN 'ANSWER_KEY' WHEN 1 THEN 'AI_AUTONOMOUS' END AS evaluation_mode,
        100.0::DOUBLE AS exam_total_marks
        FROM (SELECT DISTINCT (year(o_orderdate)*100 + month(o_orderdate))::BIGINT AS exam_id FROM orders)""",
    ),
    "qe": (
        (),
        """SELECT l_orderkey AS submission_id,
        concat_ws('-', lpad(l_linenumber::VARCHAR, 2, '0'), lpad(l_partkey::VARCHAR, 9, '0'),
                  lpad(l_suppkey::VARCHAR, 9, '0'), round(l_extendedprice*100)::BIGINT::VARCHAR) AS question_number,
        l_linenumber::BIGINT AS question_order, l_quantity AS max_marks,
        floor(l_quantity * ((l_partkey*31 + l_suppkey*17 + l_linenumber*7) % 101) / 50.0::DOUBLE) / 2.0::DOUBLE AS score_awarded,
        1.0::DOUBLE - round(l_discount*100) / 32.0::DOUBLE AS confidence,
        1.0::DOUBLE - (round(l_tax*100)::BIGINT % 4) / 16.0::DOUBLE AS bias_score,
        round(l_tax*100)::BIGINT % 4 < 3 AS bias_free,
        CASE WHEN p_size % 7 <> 0 THEN p_type || '. Objectives: ' || p_name END AS topic_context,
        CASE WHEN p_size % 7 <> 0 THEN p_type ELSE 'General Topic' END AS topic,
        l_linestatus = 'F' AS has_semantic, l_returnflag = 'R' AS concept_missing,
        CASE WHEN l_linestatus = 'F' THEN p_brand ELSE p_name END AS concept,
        CASE WHEN l_linenumber <> 4 THEN round(l_discount*100) * 8 END AS concept_coverage,
        p_name AS concept_text
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    ),
    "docs": (
        ("qe",),
        """SELECT submission_id, sum(score_awarded) AS total_score, sum(max_marks) AS max_possible,
        avg(confidence) AS confidence_score, min(bias_score) AS fairness_score, bool_and(bias_free) AS fairness_verified
        FROM qe GROUP BY submission_id""",
    ),
    "subs": (
        ("docs",),
        """SELECT o_orderkey AS submission_id, (year(o_orderdate)*100 + month(o_orderdate))::BIGINT AS exam_id,
        o_custkey AS student_id, c_name AS student_name, 'CS' || o_custkey AS student_roll_number,
        CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'PROCESSING' ELSE 'FAILED' END AS status,
        total_score AS obtained_marks, max_possible AS total_marks, confidence_score AS evaluation_confidence,
        fairness_score, fairness_verified,
        CASE WHEN d.submission_id IS NOT NULL THEN CASE o_orderpriority WHEN '1-URGENT' THEN 'ANSWER_KEY'
             WHEN '2-HIGH' THEN 'AI_AUTONOMOUS' WHEN '5-LOW' THEN 'UNSUPPORTED' END END AS document_mode,
        d.submission_id IS NOT NULL AS has_document, o_orderdate AS updated_at
        FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN docs d ON o_orderkey = d.submission_id""",
    ),
    "obs": (
        (),
        """SELECT l_orderkey AS script_id, l_linenumber::BIGINT AS question_number, 10.0::DOUBLE AS max_marks,
        round(l_tax*100) + 0.0::DOUBLE AS human_mark, round(l_discount*100) + 0.0::DOUBLE AS engine_mark_a,
        CASE WHEN l_partkey % 3 <> 0 THEN ((l_partkey + l_linenumber) % 11)::DOUBLE END AS engine_mark_b,
        l_returnflag AS subject, l_linestatus AS question_type,
        CASE WHEN l_suppkey % 2 = 0 THEN ((l_suppkey + l_linenumber) % 9)::DOUBLE END AS second_human_mark
        FROM lineitem""",
    ),
    "vpm": (
        (),
        """SELECT l_orderkey AS question_id,
        concat_ws('-', lpad(l_linenumber::VARCHAR, 2, '0'), lpad(l_partkey::VARCHAR, 9, '0'),
                  lpad(l_suppkey::VARCHAR, 9, '0'), round(l_extendedprice*100)::BIGINT::VARCHAR) AS value_point_id,
        CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS group_id,
        CASE l_returnflag WHEN 'A' THEN 'ANY_N' WHEN 'R' THEN 'ALL' END AS group_rule,
        CASE WHEN l_returnflag = 'A' THEN 2 END AS group_n, l_quantity AS marks, l_linestatus = 'F' AS matched,
        round(l_tax*100) = 0 AS uncalibrated, 80.0::DOUBLE AS max_marks FROM lineitem""",
    ),
    "tlines": (
        (),
        """SELECT conv_id AS script_id, floor(turn / 3.0)::BIGINT AS page_number, turn AS line_idx,
        CASE role WHEN 'user' THEN ((conv_id*7 + turn*5) % 6 + 1)::VARCHAR || '. ' || replace(text, chr(10), ' ') WHEN 'system' THEN 'Part B' ELSE replace(text, chr(10), ' ') END AS text,
        role = 'user' AS is_header, role = 'system' AS is_section,
        ((conv_id*7 + turn*5) % 6 + 1)::VARCHAR AS header_number,
        CASE WHEN length(text) % 5 <> 0 THEN 1.0::DOUBLE - (length(text) % 32) / 64.0::DOUBLE END AS confidence,
        length(text) % 11 = 0 AS struck_through FROM conversations""",
    ),
    "eouts": (
        (),
        """SELECT user_id AS page_id, event_type AS engine, event_id AS output_id, round(value) / 512.0::DOUBLE AS confidence,
        event_id % 40 AS line_count, event_id % 23 AS text_length FROM events""",
    ),
}


def with_views(names: str, body: str, extra: str = "") -> str:
    """Prefix a SQL body with the views it names (and those they need)."""
    ordered: list[str] = []

    def need(name: str) -> None:
        for dep in _SQL[name][0]:
            need(dep)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        need(name)
    parts = [f"{n} AS ({_SQL[n][1]})" for n in ordered]
    if extra:
        parts.append(extra)
    return "WITH " + ",\n".join(parts) + "\n" + body if parts else body


def r(expr: str, places: int = 2) -> str:
    """SQL: round half-even on the exact binary value."""
    return f"CAST(format('{{:.{places}f}}', CAST({expr} AS DOUBLE)) AS DOUBLE)"
