"""Transcripts to answers.

Order-dependent steps run page by page (``functions.scan``), so a very long script
is spread over tasks by its pages. Only the lines of one region meet in one row.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marklake.functions import lexicon as X
from marklake.functions.matching import some_rows
from marklake.functions.scan import before, following, previous
from marklake.functions.text import collapse, is_section_header, question_header, strip
from marklake.session import checkpointed

UNMAPPED = "UNMAPPED"
ROUTABLE = ("OK", "SPANS_PAGES")


# --- line rejoining ------------------------------------------------------------------

_LAST_WORD = re.compile(r"[A-Za-z]+$")
_FIRST_WORD = re.compile(r"^[a-z]+\b")
_COMPLETE = frozenset(X.LINE_END_WORDS)
_PREFIXES = frozenset(X.LINE_JOIN_PREFIXES)


def rejoin(lines) -> str:
    """H31 for one region: mend words that a line end cut in two."""
    text, tail_start = "", 0
    for raw in lines:
        piece = raw.strip()
        if not piece:
            continue
        tail = text[tail_start:]
        if not text:
            text = piece
        elif tail.endswith("-"):
            text = text[:-1] + piece
        elif _continues(tail, piece):
            text += piece
        else:
            tail_start = len(text) + 1
            text += " " + piece
    return text


def _continues(tail: str, piece: str) -> bool:
    last, first = _LAST_WORD.search(tail), _FIRST_WORD.match(piece)
    if not last or not first or last.group().isupper():
        return False
    stem = last.group().lower()
    return stem not in _COMPLETE and (len(first.group()) <= 3 or stem in _PREFIXES)


@F.arrow_udf(T.StringType())
def rejoin_lines(lines: pa.Array) -> pa.Array:
    return pa.concat_arrays([pa.array(map(rejoin, some.to_pylist()), pa.string()) for (some,) in some_rows(lines)])


# --- regions ---------------------------------------------------------------------------


def _line_kinds(lines: DataFrame) -> DataFrame:
    header = question_header(F.col("text"))
    return lines.withColumn("header", header).withColumn(
        "kind",
        F.when(is_section_header(F.col("text")), "section").when(F.col("header").isNotNull(), "header").otherwise("plain"),
    )


def number_regions(lines: DataFrame) -> DataFrame:
    """Each kept line with the number of its region in the script.

    A header opens a region; so does plain text at the start or after a section
    header. Section headers are dropped only after the count has passed them.
    """
    order = ["page_number", "line_idx"]
    kinds = previous(_line_kinds(lines), ["script_id"], "page_number", order, "_before", F.col("kind"))
    opens = (F.col("kind") == "header") | ((F.col("kind") == "plain") & (F.coalesce("_before", F.lit("section")) == "section"))
    staged = kinds.withColumn("_opens", F.when(opens, 1).otherwise(0))
    counted = before(staged, ["script_id"], "page_number", order, {"_earlier": ("sum", F.col("_opens"))})
    region = F.coalesce("_earlier", F.lit(0)) + F.col("_opens")
    return counted.withColumn("region_no", region.cast("bigint")).filter("kind <> 'section'").drop("_before", "_opens", "_earlier")


def segment_scripts(lines: DataFrame, with_text: bool = True) -> DataFrame:
    """Regions with pages, confidence (minimum of the known), flags and status."""
    numbered = number_regions(lines)
    gathered = [
        F.max("header").alias("_number"),
        F.min("page_number").alias("first_page"),
        F.max("page_number").alias("last_page"),
        F.countDistinct("page_number").alias("n_pages"),
        F.count(F.lit(1)).alias("n_lines"),
        F.min("confidence").alias("confidence"),
        F.max("struck_through").alias("contains_struck_out"),
    ]
    if with_text:
        texts = F.transform(
            F.sort_array(F.collect_list(F.struct("page_number", "line_idx", "text"))), lambda s: s["text"]
        )
        gathered.append(texts.alias("_texts"))
    regions = numbered.groupBy("script_id", "region_no").agg(*gathered)
    regions = regions.withColumn("question_number", F.coalesce("_number", F.lit(UNMAPPED))).drop("_number")
    if with_text:
        regions = regions.withColumn("text", rejoin_lines("_texts")).drop("_texts")
    return order_status(checkpointed(regions))


def order_status(regions: DataFrame) -> DataFrame:
    """E2 + E3: status of each region.

    A region is out of order when a higher number came before it; the region in
    front of it shares the doubt. Only regions that are otherwise OK are marked. The
    regions are read several times here, so callers hand in a stored table.
    """
    number = F.col("question_number").try_cast("bigint")
    first = regions.groupBy("script_id", "question_number").agg(F.min("region_no").alias("_first_no"))
    status = (
        F.when(F.col("question_number") == UNMAPPED, "UNMAPPED_REGION")
        .when(F.col("region_no") > F.col("_first_no"), "AMBIGUOUS_MAPPING")
        .when(F.col("n_pages") > 1, "SPANS_PAGES")
        .otherwise("OK")
    )
    staged = regions.join(first, ["script_id", "question_number"]).select(*regions.columns, status.alias("status"), number.alias("_number"))
    order = ["region_no"]
    highest = before(staged, ["script_id"], "first_page", order, {"_highest": ("max", F.col("_number"))})
    descending = F.coalesce(F.col("_number") < F.col("_highest"), F.lit(False))
    marked = following(highest.withColumn("_down", descending), ["script_id"], "first_page", order, "_next_down", F.col("_down"))
    doubtful = (F.col("status") == "OK") & (F.col("_down") | F.coalesce("_next_down", F.lit(False)))
    return marked.withColumn("status", F.when(doubtful, "OUT_OF_ORDER").otherwise(F.col("status"))).drop(
        "_number", "_highest", "_down", "_next_down"
    )


def missing_questions(regions: DataFrame, scripts: DataFrame, expected: list[str]) -> DataFrame:
    """(script, number) rows for expected questions that a script lacks."""
    wanted = scripts.select("script_id", F.explode(F.array(*[F.lit(n) for n in expected])).alias("question_number"))
    found = regions.select("script_id", "question_number")
    return wanted.join(found, ["script_id", "question_number"], "left_anti").withColumn(
        "status", F.lit("MISSING_QUESTION_NUMBER")
    )


def with_missing(regions: DataFrame, scripts: DataFrame, expected: list[str]) -> DataFrame:
    return regions.unionByName(missing_questions(regions, scripts, expected), allowMissingColumns=True)


def is_routable(status: Column, has_flags: Column) -> Column:
    """B11"""
    return status.isin(*ROUTABLE) & ~has_flags


CONTENT_FLAGS = (
    "contains_diagram", "contains_table", "contains_equation", "contains_struck_out", "non_latin_script",
)


def region_content_flags(region_pages: DataFrame, page_flags: DataFrame) -> DataFrame:
    """OR of the flags of a region's pages; with no page on file, of all pages of the script.

    ``region_pages``: script_id, region_no, page_number.
    """
    whole = page_flags.groupBy("script_id").agg(*[F.max(f).alias(f"_all_{f}") for f in CONTENT_FLAGS])
    own = (
        region_pages.join(page_flags.withColumn("_hit", F.lit(1)), ["script_id", "page_number"], "left")
        .groupBy("script_id", "region_no")
        .agg(F.count("_hit").alias("_hits"), *[F.max(f).alias(f) for f in CONTENT_FLAGS])
    )
    joined = own.join(whole, "script_id", "left")
    chosen = [
        F.coalesce(F.when(F.col("_hits") > 0, F.col(f)).otherwise(F.col(f"_all_{f}")), F.lit(False)).alias(f)
        for f in CONTENT_FLAGS
    ]
    return joined.select("script_id", "region_no", *chosen)


# --- OCR output to lines -------------------------------------------------------------------


def visual_lines(regions: DataFrame, gap: float = 20.0, band: float = 500.0) -> DataFrame:
    """Boxes sorted from top; a step of more than ``gap`` to the box before starts a line.

    ``regions``: page_id, region_id, text, confidence, top_y, left_x, x0, y0, x1, y1.
    Pages are scanned in horizontal bands.
    """
    order = ["top_y", "region_id"]
    banded = regions.withColumn("_band", F.floor(F.col("top_y") / band))
    seen = previous(banded, ["page_id"], "_band", order, "_y", F.col("top_y"))
    opens = F.when(F.col("_y").isNotNull() & (F.abs(F.col("top_y") - F.col("_y")) > gap), 1).otherwise(0)
    counted = before(seen.withColumn("_opens", opens), ["page_id"], "_band", order, {"_earlier": ("sum", F.col("_opens"))})
    lined = counted.withColumn("line_no", (F.coalesce("_earlier", F.lit(0)) + F.col("_opens")).cast("bigint"))
    words = F.transform(F.sort_array(F.collect_list(F.struct("left_x", "top_y", "region_id", "text"))), lambda s: s["text"])
    return lined.groupBy("page_id", "line_no").agg(
        F.array_join(words, " ").alias("text"),
        F.avg("confidence").alias("confidence"),
        F.min("x0").alias("x0"),
        F.min("y0").alias("y0"),
        F.max("x1").alias("x1"),
        F.max("y1").alias("y1"),
    )


def word_lines(words: DataFrame) -> DataFrame:
    """E5: recognised words to lines by block and line number.

    ``words``: page_id, word_id, block_num, line_num, text, conf, left, top, width, height.
    """
    kept = words.withColumn("text", strip(F.col("text"))).filter((F.col("text") != "") & (F.col("conf") != -1))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("left", "word_id", "text"))), lambda s: s["text"])
    return kept.groupBy("page_id", "block_num", "line_num").agg(
        F.array_join(ordered, " ").alias("text"),
        F.avg(F.col("conf") / 100.0).alias("confidence"),
        F.min("left").alias("x0"),
        F.min("top").alias("y0"),
        F.max(F.col("left") + F.col("width")).alias("x1"),
        F.max(F.col("top") + F.col("height")).alias("y1"),
    )


# --- nested labels -------------------------------------------------------------------------


def label_answers(lines: DataFrame) -> DataFrame:
    """Answers per nested label (question_1_a), with the whole text as question_1 as a fallback.

    The label in force depends only on the labels since the last main number. Those
    few labels are folded in order; text lines are not, they look their label up.
    """
    order = ["page_number", "line_idx"]
    raw = strip(F.col("text"))
    main = F.coalesce(
        F.nullif(F.regexp_extract(raw, r"(?i)^\s*(?:Q|Question|Q\.)\s*(\d+)", 1), F.lit("")),
        F.nullif(F.regexp_extract(raw, r"^\s*(\d+)\s*[.)]", 1), F.lit("")),
    )
    sub = F.nullif(F.regexp_extract(raw, r"^\s*\(([a-zA-Z])\)", 1), F.lit(""))
    roman = F.nullif(F.regexp_extract(raw, r"^\s*\(([ivxIVX]+)\)", 1), F.lit(""))
    staged = lines.select(
        "script_id",
        "page_number",
        "line_idx",
        raw.alias("text"),
        F.coalesce(
            F.when(main.isNotNull(), F.struct(F.lit("main").alias("kind"), main.alias("value"))),
            F.when(sub.isNotNull(), F.struct(F.lit("sub").alias("kind"), F.lower(sub).alias("value"))),
            F.when(roman.isNotNull(), F.struct(F.lit("roman").alias("kind"), F.lower(roman).alias("value"))),
        ).alias("label"),
    )
    is_main = F.when(F.coalesce(F.col("label.kind") == "main", F.lit(False)), 1).otherwise(0)
    is_label = F.when(F.col("label").isNotNull(), 1).otherwise(0)
    counted = before(
        staged, ["script_id"], "page_number", order, {"_mains": ("sum", is_main), "_labels": ("sum", is_label)}
    )
    counted = counted.withColumn("main_no", F.coalesce("_mains", F.lit(0)) + is_main).withColumn(
        "label_no", F.coalesce("_labels", F.lit(0)) + is_label
    )
    labels = (
        counted.filter("label is not null")
        .groupBy("script_id", "main_no")
        .agg(F.sort_array(F.collect_list(F.struct("label_no", F.col("label.kind").alias("kind"), F.col("label.value").alias("value")))).alias("_l"))
    )

    def step(acc: Column, x: Column) -> Column:
        inside = F.contains(acc["now"], F.lit("question_"))
        for_sub = F.regexp_replace(F.regexp_replace(acc["now"], r"_[a-zA-Z]$", ""), r"_[ivxIVX]+$", "")
        for_roman = F.regexp_replace(acc["now"], r"_[ivxIVX]+$", "")
        base = F.when(x["kind"] == "sub", for_sub).otherwise(for_roman)
        now = F.when((x["kind"] == "main") | ~inside, F.concat(F.lit("question_"), x["value"])).otherwise(
            F.concat(base, F.lit("_"), x["value"])
        )
        return F.struct(now.alias("now"), F.concat(acc["all"], F.array(F.struct(x["label_no"].alias("label_no"), now.alias("question_id")))).alias("all"))

    start = F.struct(F.lit("header").alias("now"), F.array().cast("array<struct<label_no:bigint,question_id:string>>").alias("all"))
    resolved = checkpointed(
        labels.select("script_id", F.explode(F.aggregate("_l", start, step)["all"]).alias("_r")).select("script_id", "_r.*")
    )
    has_labels = resolved.select("script_id").distinct().withColumn("_labelled", F.lit(True))
    labelled = (
        counted.withColumn("label_no", F.col("label_no").cast("bigint"))
        .join(resolved, ["script_id", "label_no"], "left")
        .join(has_labels, "script_id", "left")
    )
    whole = F.when(F.col("_labelled").isNull() & (F.col("text") != ""), F.lit("question_1"))
    line_texts = F.transform(F.sort_array(F.collect_list(F.struct("page_number", "line_idx", "text"))), lambda s: s["text"])
    joined = F.array_join(line_texts, " ")
    return (
        labelled.withColumn("question_id", F.coalesce("question_id", whole))
        .filter("question_id IS NOT NULL")
        .groupBy("script_id", "question_id")
        .agg(joined.alias("_text"), F.max("_labelled").alias("_labelled"))
        .select("script_id", "question_id", F.when(F.col("_labelled"), collapse(F.col("_text"))).otherwise(F.trim("_text")).alias("answer_text"))
    )


# --- question papers ---------------------------------------------------------------------------

PART_HEADER = r"(?i)^\s*Part\s*[-–]?\s*([A-Z])\s*[-–]\s*\((\d+)\s*[*x×]\s*(\d+)\s*=\s*(\d+)\s*Marks?\)"
_INSTRUCTION = r"(?i)^\s*(Answer\s+(?:any\s+)?\w+\s+questions?.*)$"
_START = r"^\s*(\d{1,2})\s*[.)]\s+(\S.*)$"


def paper_questions(lines: DataFrame) -> DataFrame:
    """Questions of each paper from its text lines (paper_id, block, line_idx, text).

    ``block`` follows the line order (a page, say). Part header and instruction carry
    forward; the first definition of a number gives its text, and text that follows
    any later definition still joins it.
    """
    t = F.col("text")
    order = ["block", "line_idx"]
    kind = (
        F.when(F.rlike(t, F.lit(PART_HEADER)), "part")
        .when(F.rlike(t, F.lit(_INSTRUCTION)), "instruction")
        .when(F.rlike(t, F.lit(_START)), "start")
        .otherwise("text")
    )
    at = [F.col("block"), F.col("line_idx")]
    staged = lines.withColumn("_kind", kind)
    opens = F.when(F.col("_kind").isin("part", "start"), 1).otherwise(0)
    part = F.when(F.col("_kind") == "part", F.struct(*at, F.upper(F.regexp_extract(t, PART_HEADER, 1)).alias("part"), strip(t).alias("part_header")))
    told = F.when(F.col("_kind") == "instruction", F.struct(*at, strip(F.regexp_extract(t, _INSTRUCTION, 1)).alias("instruction")))
    scanned = before(
        staged, ["paper_id"], "block", order, {"_n": ("sum", opens), "_part": ("max", part), "_told": ("max", told)}
    ).withColumn("_segment", F.coalesce("_n", F.lit(0)) + opens)
    starts = scanned.filter("_kind = 'start'").select(
        "paper_id",
        "_segment",
        F.regexp_extract(t, _START, 1).alias("question_number"),
        strip(F.regexp_extract(t, _START, 2)).alias("_rest"),
        F.col("_part.part").alias("part"),
        F.col("_part.part_header").alias("part_header"),
        F.col("_told.instruction").alias("instruction"),
    )
    starts = checkpointed(starts)
    body = F.struct("_segment", "_rest", "part", "part_header", "instruction")
    first = starts.groupBy("paper_id", "question_number").agg(F.min(body).alias("_b")).select("paper_id", "question_number", "_b.*")
    more = scanned.filter((F.col("_kind") == "text") & (strip(t) != "")).select("paper_id", "_segment", *at, strip(t).alias("_line"))
    pieces = starts.select("paper_id", "_segment", "question_number").join(more, ["paper_id", "_segment"])
    continued = pieces.groupBy("paper_id", "question_number").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_segment", "block", "line_idx", "_line"))), lambda s: s["_line"]), " ").alias("_more")
    )
    return (
        first.join(continued, ["paper_id", "question_number"], "left")
        .select("paper_id", "question_number", F.concat_ws(" ", "_rest", "_more").alias("question_text"), "part", "part_header", "instruction")
    )
