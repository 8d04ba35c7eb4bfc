"""Learning analytics (D10-D13, H32): topic mastery, knowledge gaps, advice.

Every operator takes grouping keys, so the same plan serves one submission or the
pooled history of a student. ``order`` is the column that gives the order in which
questions were answered (a number keeps the aggregation hash-based); topics keep
their first-seen order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marklake.functions.numeric import clamp, ratio, rounded
from marklake.session import checkpointed

DEFAULT_TOPIC = "General Topic"
PRAISE = (
    "Excellent work! Review advanced materials or explore topics beyond this curriculum to expand knowledge."
)
MAX_RECOMMENDATIONS = 5


def topic_name(context: Column) -> Column:
    """Text before ". Objectives:"; no context means the default topic."""
    head = F.trim(F.substring_index(context, ". Objectives:", 1))
    return F.when(F.coalesce(context, F.lit("")) == "", F.lit(DEFAULT_TOPIC)).otherwise(head)


def mastery_status(score: Column) -> Column:
    return (
        F.when(score >= 0.80, "MASTERED").when(score >= 0.50, "DEVELOPING").when(score >= 0.30, "WEAK")
    ).otherwise("CRITICAL")


def topic_mastery(questions: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key and topic."""
    totals = (
        questions.withColumn("topic", topic_name(F.col("topic_context")))
        .groupBy(*keys, "topic")
        .agg(
            F.sum("score_awarded").alias("_awarded"),
            F.sum("max_marks").alias("_max"),
            F.avg("confidence").alias("_conf"),
            F.min(order).alias("first_seen"),
        )
    )
    score = clamp(ratio(F.col("_awarded"), F.col("_max"), 0.0))
    scored = totals.select(*keys, "topic", score.alias("mastery_score"), F.col("_conf").alias("confidence"), "first_seen")
    return rounded(scored, mastery_score=4, confidence=4).withColumn("status", mastery_status(F.col("mastery_score")))


def _concept_rows(questions: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, topic, concept, missing): the semantic result where present, else keywords."""
    matched = F.when(F.col("has_semantic"), F.col("matched_semantic")).otherwise(F.col("matched_keywords"))
    missing = F.when(F.col("has_semantic"), F.col("missing_semantic")).otherwise(F.col("missing_concepts"))
    tagged = F.concat(
        F.transform(F.coalesce(matched, F.array()), lambda c: F.struct(c.alias("concept"), F.lit(False).alias("missing"))),
        F.transform(F.coalesce(missing, F.array()), lambda c: F.struct(c.alias("concept"), F.lit(True).alias("missing"))),
    )
    return questions.select(
        *keys, topic_name(F.col("topic_context")).alias("topic"), F.col(order).alias("_seen"), F.explode(tagged).alias("_c")
    ).select(*keys, "topic", "_seen", "_c.concept", "_c.missing")


def knowledge_gaps(questions: DataFrame, keys: list[str], order: str) -> DataFrame:
    """A concept missing once stays missing, even if matched elsewhere.

    Concepts are reduced to one row each before they are gathered, so the gathered
    list is as long as the topic's vocabulary, not as long as the history.
    """
    concepts = _concept_rows(questions, keys, order).groupBy(*keys, "topic", "concept").agg(
        F.max("missing").alias("missing"), F.min("_seen").alias("_seen")
    )
    share = F.col("missing_count") / F.col("expected_count")
    severity = F.when(share >= 0.60, "HIGH").when(share >= 0.30, "MEDIUM").otherwise("LOW")
    return (
        concepts.groupBy(*keys, "topic")
        .agg(
            F.count_if("missing").alias("missing_count"),
            F.count(F.lit(1)).alias("expected_count"),
            F.sort_array(F.collect_list(F.when(F.col("missing"), F.col("concept")))).alias("missing_concepts"),
            F.min("_seen").alias("first_seen"),
        )
        .filter("missing_count > 0")
        .withColumn("severity", severity)
    )


def recommendations(mastery: DataFrame, gaps: DataFrame, keys: list[str], most: int = MAX_RECOMMENDATIONS) -> DataFrame:
    """(keys, position, recommendation), the first `most` per key; praise where there is nothing to advise."""
    top = checkpointed(ranked_advice(mastery, gaps, keys, most))
    praised = mastery.select(*keys).distinct().join(top.filter("position = 1").select(*keys), keys, "left_anti")
    return top.unionByName(praised.select(*keys, F.lit(1).alias("position"), F.lit(PRAISE).alias("recommendation")))


def ranked_advice(mastery: DataFrame, gaps: DataFrame, keys: list[str], most: int = MAX_RECOMMENDATIONS) -> DataFrame:
    """The advice of each key that has any, the best `most`. The rank drops the rest map-side."""
    topic = F.col("topic")
    status = F.col("status")
    kinds = F.when(status == "CRITICAL", 1).when(status == "WEAK", 2).otherwise(3)
    text = (
        F.when(status == "CRITICAL", F.concat(F.lit("Prioritize re-learning the core components of '"), topic, F.lit("' as performance is critical.")))
        .when(status == "WEAK", F.concat(F.lit("Review and practice questions under the topic '"), topic, F.lit("' to build foundation.")))
        .when(status == "DEVELOPING", F.concat(F.lit("Reinforce your understanding of '"), topic, F.lit("' with target exercises to achieve full mastery.")))
    )
    # Unneeded rows leave through explode: a filter would be pushed into, and repeat, the rounding.
    item = F.struct(kinds.alias("kind"), F.col("first_seen"), text.alias("recommendation"))
    from_topics = mastery.select(
        *keys, F.explode(F.when(status != "MASTERED", F.array(item)).otherwise(F.array_repeat(item, 0))).alias("_r")
    ).select(*keys, "_r.*")

    def listed(n: int) -> Column:
        return F.array_join(F.slice("missing_concepts", 1, n), ", ")

    advice = F.when(
        F.col("severity") == "HIGH", F.concat(F.lit("Focus on key missing concepts in '"), topic, F.lit("': "), listed(3), F.lit("."))
    ).when(F.col("severity") == "MEDIUM", F.concat(F.lit("Study specific details of "), listed(2), F.lit(" in '"), topic, F.lit("'.")))
    from_gaps = gaps.select(*keys, F.lit(4).alias("kind"), "first_seen", advice.alias("recommendation")).filter("recommendation is not null")
    # A key has at most two rows a topic: they move once, and neither the rank nor what gathers a key's advice moves them again.
    first = from_topics.unionByName(from_gaps).repartition(*keys).groupBy(*keys, "recommendation").agg(F.min(F.struct("kind", "first_seen")).alias("_rank"))
    position = F.row_number().over(Window.partitionBy(*keys).orderBy("_rank", "recommendation"))
    return first.withColumn("position", position).filter(F.col("position") <= most).select(*keys, "position", "recommendation")


def analyze(questions: DataFrame, keys: list[str], order: str) -> DataFrame:
    """D12 with keys = submission, D13 with keys = student: one row per key.

    Mastery and gaps are read twice each, so both are stored: two passes over the
    questions instead of four.
    """
    mastery = checkpointed(topic_mastery(questions, keys, order))
    gaps = checkpointed(knowledge_gaps(questions, keys, order))

    def topics(*statuses: str) -> Column:
        hit = F.when(F.col("status").isin(*statuses), F.struct("first_seen", "topic"))
        return F.transform(F.sort_array(F.collect_list(hit)), lambda s: s["topic"])

    # Summed in first-seen order: the mean of few decimals often sits on a rounding tie.
    scores = F.transform(F.sort_array(F.collect_list(F.struct("first_seen", "topic", "mastery_score"))), lambda s: s["mastery_score"])
    mean = F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + x) / F.count(F.lit(1))
    summary = mastery.groupBy(*keys).agg(
        mean.alias("_mean"),
        topics("MASTERED").alias("mastered_topics"),
        topics("WEAK", "CRITICAL").alias("weak_topics"),
    )
    advice = ranked_advice(mastery, gaps, keys).groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("position", "recommendation"))), lambda s: s["recommendation"]).alias("recommendations")
    )
    gap_list = gaps.groupBy(*keys).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("first_seen", "topic", "missing_concepts", "severity"))),
            lambda s: F.struct(s["topic"].alias("topic"), s["missing_concepts"].alias("missing_concepts"), s["severity"].alias("severity")),
        ).alias("knowledge_gaps")
    )
    summary = rounded(summary.withColumnRenamed("_mean", "overall_mastery"), overall_mastery=4)
    praised = F.coalesce("recommendations", F.array(F.lit(PRAISE)))
    return summary.join(advice, keys, "left").join(gap_list, keys, "left").withColumn("recommendations", praised)
