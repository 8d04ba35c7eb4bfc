"""Readers of stored documents (A2-A8, A12, A13). Every reader declares its schema.

``read_*`` takes a path; ``parse_*`` takes a frame with the raw text in ``value``, so
the same rules serve files, tables and streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marklake import schemas as SC
from marklake.functions.numeric import clamp, round_even
from marklake.functions.text import strip
from marklake.schemas import require


def read_entities(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A1 from files."""
    return spark.read.schema(schema).parquet(path)


def read_entities_jdbc(spark: SparkSession, url: str, table: str, column: str, lower, upper, partitions: int) -> DataFrame:
    """A1 from a database, read in ranges of a column."""
    return spark.read.jdbc(url, table, column=column, lowerBound=lower, upperBound=upper, numPartitions=partitions)


def _texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as rows; one document per file."""
    return spark.read.text(path, wholetext=True)


# --- OCR output ---------------------------------------------------------------------------


def parse_ocr_output(raw: DataFrame) -> DataFrame:
    """A2: lines of OCR documents; absent confidence is 1.0, position the first polygon point or 0."""
    doc = raw.withColumn("_d", F.from_json("value", SC.OCR_OUTPUT))
    keep = [c for c in raw.columns if c != "value"]
    line = F.col("l")
    first = F.get(line["bounding_box"], F.lit(0))
    return doc.select(*keep, F.coalesce("_d.confidence", F.lit(1.0)).alias("document_confidence"), F.posexplode("_d.lines").alias("line_idx", "l")).select(
        *keep,
        "document_confidence",
        "line_idx",
        F.coalesce(line["text"], F.lit("")).alias("text"),
        F.coalesce(line["confidence"], F.lit(1.0)).alias("confidence"),
        F.coalesce(F.get(first, F.lit(1)), F.lit(0.0)).alias("top_y"),
        F.coalesce(F.get(first, F.lit(0)), F.lit(0.0)).alias("left_x"),
    )


def read_ocr_output(spark: SparkSession, path: str) -> DataFrame:
    return parse_ocr_output(_texts(spark, path))


# --- evaluation documents --------------------------------------------------------------------


def parse_evaluations(raw: DataFrame) -> DataFrame:
    """A3: top-level fields of evaluation documents; a missing or corrupt one gives defaults.

    ``raw``: submission_id, value (NULL where no document is stored).
    """
    corrupt = "_corrupt_record"
    schema = T.StructType([*SC.SUBMISSION_EVALUATION.fields, T.StructField(corrupt, T.StringType())])
    parsed = raw.withColumn("_d", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}))
    usable = F.col("value").isNotNull() & F.col("_d").isNotNull() & F.col(f"_d.{corrupt}").isNull()
    d = F.when(usable, F.col("_d"))
    none = F.array().cast("array<string>")
    return parsed.select(
        *[c for c in raw.columns if c != "value"],
        usable.alias("has_document"),
        F.coalesce(d["fairness_score"], F.lit(1.0)).alias("fairness_score"),
        F.coalesce(d["fairness_verified"], F.lit(True)).alias("fairness_verified"),
        d["evaluation_mode"].alias("document_mode"),
        F.coalesce(d["strengths"], none).alias("strengths"),
        F.coalesce(d["weaknesses"], none).alias("weaknesses"),
        F.coalesce(d["improvements"], none).alias("improvements"),
        F.coalesce(d["study_recommendations"], none).alias("study_recommendations"),
        F.coalesce(d["summary"], F.lit("")).alias("summary"),
        F.coalesce(d["questions"], F.array().cast(T.ArrayType(SC.QUESTION_EVALUATION))).alias("questions"),
    )


def submission_reviews(submissions: DataFrame, documents: DataFrame) -> DataFrame:
    """A3: every submission with its document's fields, defaults where there is none."""
    joined = submissions.select("submission_id", "student_name", "obtained_marks", "evaluation_confidence").join(documents, "submission_id", "left")
    return joined.select(
        "submission_id",
        F.col("student_name").alias("student"),
        F.coalesce("obtained_marks", F.lit(0.0)).alias("score"),
        F.coalesce("evaluation_confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce(F.size("questions"), F.lit(0)).alias("n_questions"),
        F.when(F.col("has_document"), F.col("fairness_score")).alias("neutrality_score"),
        F.when(F.col("has_document"), F.when(F.col("fairness_verified"), "PASSED").otherwise("FLAGGED")).alias("fairness_status"),
    )


def explode_questions(documents: DataFrame) -> DataFrame:
    """The question rows of evaluation documents; a question's mode defaults to its document's."""
    rows = documents.select("submission_id", "document_mode", F.explode("questions").alias("q")).select("submission_id", "document_mode", "q.*")
    return rows.withColumn("evaluation_mode", F.coalesce("evaluation_mode", "document_mode")).drop("document_mode")


# --- marking schemes ---------------------------------------------------------------------------


def parse_schemes(raw: DataFrame) -> DataFrame:
    """A4: one row per scheme question; the document is an object with questions, or a bare list."""
    bare = F.startswith(strip(F.col("value")), F.lit("["))
    listed = F.from_json("value", T.ArrayType(SC.SCHEME_QUESTION))
    questions = F.when(bare, listed).otherwise(F.from_json("value", SC.SCHEME)["questions"])
    checked = require(raw.withColumn("_q", questions), F.col("_q").isNotNull(), "a marking scheme could not be read")
    q = F.col("q")
    rows = checked.select(F.explode("_q").alias("q")).select(
        q["id"].alias("question_id"),
        q["question_number"].cast("string").alias("question_number"),
        q["question_text"].alias("question_text"),
        q["max_marks"].alias("max_marks"),
        q["value_points"].alias("value_points"),
    )
    return require(rows, F.size("value_points") > 0, F.concat("question_id", F.lit(": a question needs at least one value point")))


def read_schemes(spark: SparkSession, path: str) -> DataFrame:
    return parse_schemes(_texts(spark, path))


# --- observations --------------------------------------------------------------------------------


def _observed(raw: DataFrame) -> tuple[DataFrame, Column]:
    """Lines that are not blank, parsed, and whether a line is whole."""
    rows = raw.filter(strip(F.col("value")) != "")
    parsed = rows.withColumn("_o", F.from_json("value", SC.OBSERVATION, {"mode": "PERMISSIVE"}))
    whole = F.col("_o").isNotNull()
    for name in ("script_id", "question_number", "max_marks", "human_mark"):
        whole = whole & F.col(f"_o.{name}").isNotNull()
    for name in ("engine_mark_A", "engine_mark_B", "second_human_mark", "ocr_confidence"):
        # A value that is there but is no number is bad, not missing.
        whole = whole & (F.col(f"_o.{name}").isNotNull() | F.get_json_object("value", f"$.{name}").isNull())
    return parsed, F.coalesce(whole, F.lit(False))


def parse_observations(raw: DataFrame) -> DataFrame:
    """A5: blank lines are skipped; any other line that does not parse stops the job."""
    parsed, whole = _observed(raw)
    checked = require(parsed, whole, F.concat(F.lit("bad observation: "), F.col("value")))
    return _observations(checked, [c for c in raw.columns if c != "value"])


def _observations(parsed: DataFrame, kept: list[str]) -> DataFrame:
    o = F.col("_o")
    return parsed.select(
        *kept,
        o["script_id"].alias("script_id"),
        o["question_number"].alias("question_number"),
        o["max_marks"].alias("max_marks"),
        o["human_mark"].alias("human_mark"),
        o["engine_mark_A"].alias("engine_mark_a"),
        o["engine_mark_B"].alias("engine_mark_b"),
        F.coalesce(o["subject"], F.lit("unknown")).alias("subject"),
        F.coalesce(o["question_type"], F.lit("unknown")).alias("question_type"),
        o["second_human_mark"].alias("second_human_mark"),
        o["ocr_confidence"].alias("ocr_confidence"),
    )


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of the lines that do not parse, numbered from 1.

    Lines are counted per split of a file, and what the splits before it hold is added up from one row per split, so a
    file of any length is read in parallel. Rows keep the order of their split, which the running number follows.
    """
    at = ["_metadata.file_path", "_metadata.file_block_start"]
    raw = spark.read.text(path).select("value", F.col(at[0]).alias("file"), F.col(at[1]).alias("block"), F.monotonically_increasing_id().alias("at"))
    splits = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    parsed, whole = _observed(raw)
    return parsed.filter(~whole).join(splits, ["file", "block"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "value")


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """A5: the first line that does not parse stops the job with its file and number.

    Counting lines is a second pass that keeps one row per split.
    """
    parsed, whole = _observed(spark.read.text(path))
    good = _observations(parsed.filter(whole), [])
    first = bad_lines(spark, path).agg(F.min(F.struct("file", "line", "value")).alias("b")).filter("b is not null")
    said = F.concat(F.lit("bad observation: "), F.col("b.file"), F.lit(", line "), F.col("b.line").cast("string"), F.lit(": "), F.col("b.value"))
    stopped = first.filter(F.raise_error(said).cast("boolean"))  # a filter, which no reader of fewer columns prunes
    return good.unionByName(stopped.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in good.schema]))


# --- transcriptions --------------------------------------------------------------------------------


DEFAULT_PROVIDER = "gemini_vision"  # Fixed value: the provider of records that name none.


def parse_transcriptions(raw: DataFrame) -> DataFrame:
    """Line rows with page provenance, from one page object or a list of pages."""
    bare = F.startswith(strip(F.col("value")), F.lit("["))
    pages = F.when(bare, F.from_json("value", T.ArrayType(SC.TRANSCRIPTION))).otherwise(F.array(F.from_json("value", SC.TRANSCRIPTION)))
    keep = [c for c in raw.columns if c != "value"]
    page = F.col("p")
    rows = raw.select(*keep, F.explode(pages).alias("p")).select(
        *keep,
        F.coalesce(page["page_number"], F.lit(1)).alias("page_number"),
        page["page_confidence"].alias("page_confidence"),
        F.coalesce(page["provider"], F.lit(DEFAULT_PROVIDER)).alias("provider"),
        page["model_id"].alias("model_id"),
        page["prompt_version"].alias("prompt_version"),
        page["page_sha256"].alias("page_sha256"),
        F.posexplode(page["lines"]).alias("line_idx", "l"),
    )
    line = F.col("l")
    return rows.select(
        *[c for c in rows.columns if c != "l"],
        line["text"].alias("text"),
        line["confidence"].alias("confidence"),
        line["bbox"].alias("bbox"),
        line["script"].alias("script"),
        F.coalesce(line["struck_through"], F.lit(False)).alias("struck_through"),
    )


def read_transcriptions(spark: SparkSession, path: str) -> DataFrame:
    return parse_transcriptions(_texts(spark, path))


# --- stored model responses ---------------------------------------------------------------------------


def strip_fence(text: Column) -> Column:
    """Contents of a Markdown code fence around the whole text, else the text itself."""
    bare = strip(text)
    inner = F.regexp_extract(bare, r"(?is)^```(?:json)?\s*(.*?)\s*```$", 1)
    return F.when(F.rlike(bare, F.lit(r"(?is)^```(?:json)?\s*(.*?)\s*```$")), strip(inner)).otherwise(bare)


def parse_transcription_responses(raw: DataFrame) -> DataFrame:
    """Transcription responses, good and rejected (``reject_reason``), in one frame.

    ``raw``: page_id, value. A bad bounding box is a warning; no lines at all is a
    BLANK_PAGE warning. Split with ``accepted`` and ``quarantined``.
    """
    v = F.try_parse_json("value")
    staged = raw.withColumn("_v", v).withColumn("_lines", F.try_variant_get("_v", "$.lines", "array<variant>"))
    has_lines = F.try_variant_get("_v", "$.lines", "variant").isNotNull()
    line = F.transform(
        "_lines",
        lambda l: F.struct(
            F.try_variant_get(l, "$.text", "string").alias("text"),
            F.try_variant_get(l, "$.legibility", "double").alias("confidence"),
            F.try_variant_get(l, "$.legibility", "string").alias("_said"),
            F.try_variant_get(l, "$.bbox", "array<double>").alias("bbox"),
            F.try_variant_get(l, "$.bbox", "string").isNotNull().alias("_boxed"),
            F.coalesce(F.try_variant_get(l, "$.struck_through", "boolean"), F.lit(False)).alias("struck_through"),
        ),
    )
    staged = staged.withColumn("lines", line)
    reason = (
        F.when(strip(F.coalesce("value", F.lit(""))) == "", "response carried no text payload")
        .when(F.col("_v").isNull(), "response is not valid JSON")
        .when(~has_lines, "response has no 'lines' key")
        .when(F.col("_lines").isNull(), "'lines' is not a list")
        .when(F.exists("lines", lambda x: x["text"].isNull()), "a line has no 'text'")
        .when(F.exists("lines", lambda x: x["_said"].isNotNull() & x["confidence"].isNull()), "a legibility is not a number")
        .when(F.exists("lines", lambda x: (x["confidence"] < 0.0) | (x["confidence"] > 1.0)), "a legibility is outside [0, 1]")
    )
    usable_box = lambda x: F.coalesce(F.size(x["bbox"]) == 4, F.lit(False)) & ~F.exists(x["bbox"], lambda b: b.isNull())
    warnings = F.flatten(
        F.transform(
            "lines",
            lambda x, i: F.array_compact(
                F.array(
                    F.when(x["_boxed"] & ~usable_box(x), F.concat(F.lit("line "), (i + 1).cast("string"), F.lit(": unusable bbox"))),
                    F.when(x["struck_through"], F.concat(F.lit("line "), (i + 1).cast("string"), F.lit(": marked struck through by the candidate"))),
                )
            ),
        )
    )
    blank = F.array(F.lit("BLANK_PAGE: no lines transcribed"))
    clean = F.transform(
        "lines",
        lambda x: F.struct(
            x["text"].alias("text"), x["confidence"].alias("confidence"), F.when(usable_box(x), x["bbox"]).alias("bbox"), x["struck_through"].alias("struck_through")
        ),
    )
    good = F.col("reject_reason").isNull()
    return (
        staged.withColumn("reject_reason", reason)
        .withColumn("warnings", F.when(good, F.when(F.size("lines") == 0, blank).otherwise(warnings)))
        .withColumn("page_confidence", F.when(good, F.array_min(F.transform("lines", lambda x: x["confidence"]))))
        .withColumn("lines", F.when(good, clean))
        .drop("value", "_v", "_lines")
    )


def parse_scoring_responses(raw: DataFrame) -> DataFrame:
    """Scoring responses; ``raw``: ids, max_marks, value.

    The score is clamped to the marks, confidence to [0, 1] (absent: 0.95), coverage
    is matched over matched and missing.
    """
    v = F.try_parse_json(strip_fence(F.coalesce("value", F.lit(""))))
    staged = raw.withColumn("_v", v)
    number = lambda path: F.try_variant_get("_v", path, "double")
    spoken = lambda path: F.try_variant_get("_v", path, "string")
    listed = lambda path: F.filter(
        F.transform(F.coalesce(F.try_variant_get("_v", path, "array<string>"), F.array().cast("array<string>")), strip), lambda c: c != ""
    )
    is_object = F.coalesce(F.startswith(F.schema_of_variant("_v"), F.lit("OBJECT")), F.lit(False))
    reason = (
        F.when(strip(F.coalesce("value", F.lit(""))) == "", "empty response")
        .when(F.col("_v").isNull(), "not valid JSON")
        .when(~is_object, "not an object")
        .when(spoken("$.score_awarded").isNotNull() & number("$.score_awarded").isNull(), "score is not a number")
        .when(spoken("$.confidence").isNotNull() & number("$.confidence").isNull(), "confidence is not a number")
    )
    staged = (
        staged.withColumn("reject_reason", reason)
        .withColumn("matched_concepts", listed("$.matched_concepts"))
        .withColumn("missing_concepts", listed("$.missing_concepts"))
    )
    good = F.col("reject_reason").isNull()
    total = F.size("matched_concepts") + F.size("missing_concepts")
    share = F.size("matched_concepts") / F.greatest(F.lit(1), total) * 100.0
    return staged.select(
        *[c for c in raw.columns if c != "value"],
        F.when(good, clamp(F.coalesce(number("$.score_awarded"), F.lit(0.0)), F.lit(0.0), F.col("max_marks"))).alias("score_awarded"),
        F.when(good, clamp(F.coalesce(number("$.confidence"), F.lit(0.95)))).alias("confidence"),
        F.when(good, round_even(share, 2)).alias("concept_coverage"),
        F.when(good, F.col("matched_concepts")).alias("matched_concepts"),
        F.when(good, F.col("missing_concepts")).alias("missing_concepts"),
        "reject_reason",
    )


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.filter("reject_reason IS NULL").drop("reject_reason")


def quarantined(parsed: DataFrame) -> DataFrame:
    return parsed.filter("reject_reason IS NOT NULL")


# --- extraction cache ------------------------------------------------------------------------------------


def cache_key(page_sha256: Column, model_id: Column, prompt_version: Column) -> Column:
    clean = lambda c: F.translate(c, "/", "_")
    return F.concat(page_sha256, F.lit("__"), clean(model_id), F.lit("__"), clean(prompt_version))


def cache_hits(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Stored extractions of the requested pages (both hold ``cache_key``)."""
    return cache.join(requests.select("cache_key").distinct(), "cache_key", "left_semi")


def cache_misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    return requests.join(cache.select("cache_key"), "cache_key", "left_anti")


def replay(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """A12 offline: every page must come from the cache, or the job stops."""
    stored = cache.withColumn("_hit", F.lit(True))
    joined = requests.join(stored, "cache_key", "left")
    return require(joined, F.col("_hit"), F.concat(F.lit("no stored extraction for "), F.col("cache_key"))).drop("_hit")


# --- upload manifests --------------------------------------------------------------------------------------

ALLOWED_EXTENSIONS = [".pdf", ".png", ".jpg", ".jpeg"]
MAX_FILE_BYTES = 20 * 1024 * 1024


def list_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Names and sizes of uploaded files; the contents are not read."""
    return spark.read.format("binaryFile").load(path).select(F.substring_index("path", "/", -1).alias("file_name"), F.col("length").alias("file_size"))


def file_extension(name: Column) -> Column:
    base = F.substring_index(name, "/", -1)
    return F.lower(F.regexp_extract(base, r"^.+(\.[^.]*)$", 1))


def validate_uploads(files: DataFrame) -> DataFrame:
    """NULL reason means valid."""
    ext = file_extension(F.col("file_name"))
    mb = F.format_string("%.1f", round_even(F.col("file_size") / float(1024 * 1024), 1))
    reason = (
        F.when(F.coalesce("file_name", F.lit("")) == "", "Filename is empty.")
        .when(~ext.isin(*ALLOWED_EXTENSIONS), F.concat(F.lit("File type '"), ext, F.lit(f"' is not allowed. Allowed types: {', '.join(ALLOWED_EXTENSIONS)}")))
        .when(F.col("file_size") > MAX_FILE_BYTES, F.concat(F.lit("File size ("), mb, F.lit(" MB) exceeds the maximum allowed size of 20 MB.")))
    )
    return files.withColumn("reject_reason", reason)
