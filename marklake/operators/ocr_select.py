"""Choosing and rating recognition output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONFIDENCE_FLOOR = 0.80
ACCEPT_CONFIDENCE, ACCEPT_LENGTH = 0.70, 10


def vote(outputs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Best non-empty output by confidence, then lines, then order; the first when all are empty."""
    filled = F.col("line_count") > 0
    rank = F.struct(
        filled, F.when(filled, F.col("confidence")), F.when(filled, F.col("line_count")), (-F.col(order)).alias("o")
    )
    chosen = F.max_by(F.struct("engine", order, "confidence", "line_count"), rank)
    return outputs.groupBy(*keys).agg(chosen.alias("_best")).select(*keys, "_best.*")


def engine_priority(engine: Column, engines: list[str]) -> Column:
    return F.array_position(F.array(*[F.lit(e) for e in engines]), engine)


def route(outputs: DataFrame, keys: list[str], engines: list[str], last_resort: str | None = None) -> DataFrame:
    """First acceptable engine in order; else the last resort; else the most confident with lines.

    Without any of these the page has no engine and fails.
    """
    place = engine_priority(F.col("engine"), engines)
    local = place > 0
    accepted = local & (F.col("confidence") >= ACCEPT_CONFIDENCE) & (F.col("text_length") >= ACCEPT_LENGTH)
    item = F.struct("engine", "confidence", "line_count")
    first = F.min_by(F.when(accepted, item), F.when(accepted, F.struct(place.alias("p"), F.col("output_id"))))
    best = F.max_by(F.when(local, item), F.when(local, F.struct(F.col("confidence"), (-place).alias("p"), (-F.col("output_id")).alias("o"))))
    resort = (F.col("engine") == F.lit(last_resort)) & (F.col("line_count") > 0)
    final = F.max_by(F.when(resort, item), F.when(resort, F.col("output_id")))
    staged = outputs.groupBy(*keys).agg(first.alias("_first"), best.alias("_best"), final.alias("_final"))
    weak = F.col("_best").isNull() | (F.col("_best.confidence") < ACCEPT_CONFIDENCE)
    chosen = F.coalesce(
        F.col("_first"), F.when(weak, F.col("_final")), F.when(F.col("_best.line_count") > 0, F.col("_best"))
    )
    outcome = F.when(F.col("_first").isNotNull(), "ACCEPTED").when(F.col("_c").isNotNull(), "FALLBACK").otherwise("FAILED")
    return staged.withColumn("_c", chosen).select(*keys, "_c.engine", "_c.confidence", outcome.alias("outcome"))


def page_confidence(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over lines; minimum of the known; how many are known."""
    return lines.groupBy(*keys).agg(
        F.avg("confidence").alias("mean_confidence"),
        F.min("confidence").alias("page_confidence"),
        F.count("confidence").alias("n_known"),
        F.count(F.lit(1)).alias("n_lines"),
    )


def script_confidence(pages: DataFrame) -> DataFrame:
    """Mean over pages with lines, lowest known page, and the floor test.

    A script of which nothing is known is below the floor.
    """
    lowest = F.min("page_confidence")
    return pages.groupBy("script_id").agg(
        F.avg(F.when(F.col("n_lines") > 0, F.col("mean_confidence"))).alias("mean_confidence"),
        lowest.alias("lowest_confidence"),
        (lowest.isNull() | (lowest < CONFIDENCE_FLOOR)).alias("below_floor"),
    )


def benchmark_summary(results: DataFrame) -> DataFrame:
    """Means per engine, errors left out."""
    return results.filter("error is null").groupBy("engine").agg(
        F.avg("cer").alias("avg_cer"), F.avg("wer").alias("avg_wer"), F.avg("confidence").alias("avg_confidence")
    )


def benchmark_matrix(results: DataFrame, engines: list[str], order: str) -> DataFrame:
    """Case x engine, from the first result of each pair."""
    cell = F.when(F.col("error").isNull(), F.format_string("CER=%.2f", F.col("cer"))).otherwise("ERROR")
    first = results.groupBy("case", "engine").agg(F.min_by(cell, F.col(order)).alias("cell"))
    return first.groupBy("case").pivot("engine", engines).agg(F.max("cell")).na.fill("N/A", engines)
