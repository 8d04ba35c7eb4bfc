"""Deterministic mark arithmetic on evidence.

``scheme``: question_id, question_number, question_text, max_marks, value_point_id,
position, text, marks, group_id, group_rule, group_n.
``evidence``: answer_id, question_id, value_point_id, matched, span_start, span_end,
method, score, uncalibrated, reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marklake.functions.numeric import clamp, fmt_g, round_even
from marklake.schemas import require

# Version, disclaimer and reasons written on every mark.
ENGINE_VERSION = "value-point-engine/0.1.0-demo"
DISCLAIMER = "SUGGESTED MARKS - NOT VALIDATED AGAINST HUMAN EXAMINERS"
NO_ATTEMPT = "no match attempted for this value point"
NO_EVIDENCE = "no supporting evidence found in the answer"


def reject_unknown_value_points(evidence: DataFrame, scheme: DataFrame) -> DataFrame:
    """C14: evidence for an id that the scheme does not hold stops the job."""
    known = scheme.select("question_id", "value_point_id").withColumn("_known", F.lit(True))
    checked = evidence.join(known, ["question_id", "value_point_id"], "left")
    message = F.concat("question_id", F.lit(": evidence for unknown value point "), "value_point_id")
    return require(checked, F.col("_known"), message).drop("_known")


def question_marks(points: DataFrame, keys: list[str]) -> DataFrame:
    """Total per key from rows (keys, group_id, group_rule, group_n, marks, matched, max_marks).

    The best N of an ANY_N group depends only on how many points of each value
    matched, so rows are first counted by value. What is ordered per group is its
    few distinct mark values, however many rows it has; ties need no ordering.
    """
    group = [*keys, "group_id"]
    by_value = points.groupBy(*group, "marks").agg(
        F.count_if("matched").alias("_matched"),
        F.count(F.lit(1)).alias("_members"),
        F.min("group_rule").alias("_rule"),
        F.max("group_rule").alias("_rule_hi"),
        F.min("group_n").alias("_n"),
        F.max("group_n").alias("_n_hi"),
        F.max("uncalibrated").alias("_unc"),
        F.max("max_marks").alias("_max"),
    )
    higher = Window.partitionBy(*group).orderBy(F.col("marks").desc()).rowsBetween(Window.unboundedPreceding, -1)

    def best(count: str) -> Column:
        taken = F.coalesce(F.sum(count).over(higher), F.lit(0))
        left = F.greatest(F.lit(0), F.coalesce("_n", F.lit(0)) - taken)
        return F.least(F.col(count), left) * F.col("marks")

    whole = Window.partitionBy(*group)
    consistent = F.min("_rule").over(whole).eqNullSafe(F.max("_rule_hi").over(whole)) & F.min("_n").over(whole).eqNullSafe(
        F.max("_n_hi").over(whole)
    )
    staged = by_value.select(
        "*", best("_matched").alias("_best"), best("_members").alias("_cap"), consistent.alias("_same")
    )
    staged = require(staged, F.col("_same") | F.col("group_id").isNull(), "members of one group disagree on rule or N")
    is_any = F.max("_rule") == "ANY_N"
    group_total = F.when(is_any, F.least(F.sum("_best"), F.sum("_cap"))).otherwise(F.sum(F.col("_matched") * F.col("marks")))
    groups = staged.groupBy(*group).agg(group_total.alias("_total"), F.max("_unc").alias("_unc"), F.max("_max").alias("_max"))
    uncapped = F.sum("_total")
    return groups.groupBy(*keys).agg(
        uncapped.alias("uncapped"),
        round_even(clamp(uncapped, 0.0, F.max("_max")), 4).alias("total"),
        F.max("_max").alias("max_marks"),
        F.max("_unc").alias("uncalibrated"),
    )


def award_lines(points: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Each value point with the mark it brought; surplus matches of a group stay, with a reason.

    A window partition here is the value points of one group of one scheme question.
    """
    ranked = Window.partitionBy(*keys, "group_id", "matched").orderBy(F.col("marks").desc(), F.col(position))
    rank = F.row_number().over(ranked)
    any_n = F.coalesce("group_rule", F.lit("")) == "ANY_N"
    surplus = any_n & F.col("matched") & (F.col("_rank") > F.col("group_n"))
    awarded = F.when(F.col("matched") & ~surplus, F.col("marks")).otherwise(0.0)
    reason = (
        F.when(surplus, F.concat(F.lit("matched, but outside the best "), F.col("group_n").cast("string"), F.lit(" for this group")))
        .when(F.col("matched"), F.concat(F.lit("evidence found by "), F.col("method")))
        .otherwise(F.coalesce("reason", F.lit(NO_EVIDENCE)))
    )
    return (
        points.withColumn("_rank", rank)
        .withColumn("awarded", awarded)
        .withColumn("reason", reason)
        .withColumn("surplus", surplus)
        .drop("_rank")
    )


def join_evidence(answers: DataFrame, scheme: DataFrame, evidence: DataFrame) -> DataFrame:
    """Every value point of each answered question, with its evidence or 'no match attempted'.

    The evidence is checked against the scheme first. Scheme rows are a dimension;
    Catalyst broadcasts them when their size allows.
    """
    checked = reject_unknown_value_points(evidence, scheme)
    pairs = answers.select("answer_id", "question_id").join(scheme, "question_id")
    joined = pairs.join(checked, ["answer_id", "question_id", "value_point_id"], "left")
    attempted = F.col("matched").isNotNull()
    return (
        joined.withColumn("method", F.when(attempted, F.col("method")).otherwise("none"))
        .withColumn("reason", F.when(attempted, F.col("reason")).otherwise(F.lit(NO_ATTEMPT)))
        .withColumn("attempted", attempted)
        .withColumn("matched", F.coalesce("matched", F.lit(False)))
        .withColumn("uncalibrated", F.coalesce("uncalibrated", F.lit(False)))
    )


def score_answers(answers: DataFrame, scheme: DataFrame, evidence: DataFrame) -> DataFrame:
    """The `marks` table: one row per answer."""
    points = join_evidence(answers, scheme, evidence)
    return question_marks(points, ["answer_id", "question_id"]).withColumn("engine_version", F.lit(ENGINE_VERSION))


_RULE = "-" * 66


def derivations(points: DataFrame, marks: DataFrame, answers: DataFrame, quote_width: int | None = None, text_width: int | None = None) -> DataFrame:
    """The written derivation of each mark, with evidence quotes; whole ones, or cut to the given widths.

    ``points`` is the stored result of ``join_evidence`` (it is read three times);
    ``answers`` also holds answer_text.
    """
    keys = ["answer_id", "question_id"]
    lines = award_lines(points, keys, "position").join(answers.select(*keys, "answer_text"), keys)
    raw = F.trim(F.expr("substring(answer_text, span_start + 1, span_end - span_start)"))
    quote = raw if quote_width is None else F.when(F.length(raw) > quote_width, F.concat(F.substring(raw, 1, quote_width - 3), F.lit("..."))).otherwise(raw)
    head = F.format_string(
        "  %s %-8s %-38s %s/%s",
        F.when(F.col("matched"), "[X]").otherwise("[ ]"),
        F.col("value_point_id"),
        F.col("text") if text_width is None else F.substring("text", 1, text_width),
        fmt_g(F.col("awarded")),
        fmt_g(F.col("marks")),
    )
    spanned = F.col("span_start").isNotNull()
    shown = F.when(F.length(quote) > 0, F.concat(F.lit('  "'), quote, F.lit('"'))).otherwise("")
    detail = F.when(
        spanned,
        F.concat(F.lit("        evidence: chars "), F.col("span_start"), F.lit("-"), F.col("span_end"), shown),
    ).otherwise(F.concat(F.lit("        "), F.col("reason")))
    text = F.concat_ws(
        "\n",
        head,
        detail,
        F.when(F.col("surplus"), F.concat(F.lit("        "), F.col("reason"))),
        F.when(F.col("uncalibrated"), F.lit("        [UNCALIBRATED threshold - cannot route to AUTO]")),
    )
    body = lines.withColumn("_text", text)
    first = Window.partitionBy(*keys, "group_id")
    body = body.withColumn("_place", F.when(F.col("group_id").isNull(), F.lit(-1)).otherwise(F.min("position").over(first)))
    per_line = body.select(*keys, "_place", F.lit(0).alias("_kind"), F.col("position").alias("_at"), F.col("_text"))
    n_matched = F.count_if("matched")
    selected = F.sum("awarded")
    n = F.max("group_n")
    ordered = F.array_sort(F.collect_list("marks"), lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0))
    allocation = F.aggregate(F.slice(ordered, F.lit(1), F.greatest(n, F.lit(0))), F.lit(0.0), lambda acc, x: acc + x)
    size = F.count(F.lit(1))
    any_text = F.concat(
        F.lit("  ANY "), n, F.lit(" OF "), size, F.lit(" (group "), F.col("group_id"), F.lit("): "), n_matched,
        F.lit(" matched, best "), F.least(n.cast("bigint"), n_matched), F.lit(" counted = "), fmt_g(selected),
        F.when(allocation < selected, F.concat(F.lit(", capped at group allocation "), fmt_g(allocation))).otherwise(""),
    )
    all_text = F.concat(
        F.lit("  ALL (group "), F.col("group_id"), F.lit("): every point required, "), n_matched, F.lit("/"), size,
        F.lit(" matched = "), fmt_g(selected),
    )
    summaries = (
        body.filter("group_id is not null")
        .groupBy(*keys, "group_id", "_place")
        .agg(F.when(F.max("group_rule") == "ANY_N", any_text).otherwise(all_text).alias("_text"))
        .select(*keys, "_place", F.lit(1).alias("_kind"), F.lit(0).cast("int").alias("_at"), "_text")
    )
    sections = (
        per_line.unionByName(summaries)
        .groupBy(*keys)
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_place", "_kind", "_at", "_text"))), lambda s: s["_text"]), "\n").alias("_sections"))
    )
    facts = points.groupBy(*keys).agg(
        F.max("attempted").alias("_had"), F.max("question_number").alias("question_number"), F.max("question_text").alias("question_text")
    )
    empty = "  No evidence was submitted for any value point.\n  Nothing to credit - this is a zero by rule, not by failure."
    derivation = F.concat_ws(
        "\n",
        F.lit(_RULE),
        F.concat(F.lit("Q"), F.col("question_number"), F.lit("  ["), fmt_g(F.col("max_marks")), F.lit(" marks]  "), F.col("question_text")),
        F.lit(_RULE),
        F.when(F.col("_had"), F.col("_sections")).otherwise(F.lit(empty)),
        F.lit(_RULE),
        F.when(
            F.col("uncapped") > F.col("max_marks"),
            F.concat(F.lit("  Sum of awarded points "), fmt_g(F.col("uncapped")), F.lit(" exceeds the question maximum; capped at "), fmt_g(F.col("max_marks")), F.lit(".")),
        ),
        F.concat(F.lit("  TOTAL: "), fmt_g(F.col("total")), F.lit(" / "), fmt_g(F.col("max_marks"))),
        F.lit(f"  engine: {ENGINE_VERSION}"),
        F.when(
            F.col("uncalibrated"),
            F.lit("  NOTE: at least one match used an UNCALIBRATED threshold. This question cannot be routed to AUTO."),
        ),
        F.lit(f"  {DISCLAIMER}"),
        F.lit(_RULE),
    )
    return (
        marks.join(sections, keys).join(facts, keys).select(*keys, "total", "max_marks", derivation.alias("derivation"))
    )


# --- outcome per region --------------------------------------------------------


def region_outcomes(regions: DataFrame, scheme_questions: DataFrame) -> DataFrame:
    """Routed, no_scheme or scored. A region without scheme entry is not a zero.

    ``regions``: script_id, question_number, status, has_flags. ``scheme_questions``:
    question_number, question_id, max_marks.
    """
    routable = F.col("status").isin("OK", "SPANS_PAGES") & ~F.col("has_flags")
    joined = regions.join(scheme_questions, "question_number", "left")
    outcome = F.when(~routable, "routed").when(F.col("question_id").isNull(), "no_scheme").otherwise("scored")
    reason = F.when(
        ~routable,
        F.when(F.col("has_flags"), F.lit("CONTAINS_STRUCK_OUT")).otherwise(F.concat(F.lit("segmentation status "), F.col("status"))),
    )
    return joined.withColumn("outcome", outcome).withColumn("reason", reason)


def grading_coverage(outcomes: DataFrame) -> DataFrame:
    """Counts and totals per script, over rows of ``region_outcomes`` with total/flagged."""
    scored = F.col("outcome") == "scored"
    return outcomes.groupBy("script_id").agg(
        F.count_if(scored).alias("n_scored"),
        F.count_if(F.col("outcome") == "routed").alias("n_routed"),
        F.count_if(F.col("outcome") == "no_scheme").alias("n_no_scheme"),
        F.count_if(scored & F.col("flagged")).alias("n_flagged"),
        F.coalesce(F.sum(F.when(scored, F.col("total"))), F.lit(0.0)).alias("total_awarded"),
        F.coalesce(F.sum(F.when(scored, F.col("max_marks"))), F.lit(0.0)).alias("total_possible"),
    )


def content_sha256(*columns: str | Column) -> Column:
    """A stable content hash for replay comparison."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def with_provenance(results: DataFrame, **versions: str) -> DataFrame:
    """Versions stamped on each result row."""
    fields = {"scorer": ENGINE_VERSION, **versions}
    return results.withColumn("provenance", F.struct(*[F.lit(v).alias(k) for k, v in fields.items()]))
