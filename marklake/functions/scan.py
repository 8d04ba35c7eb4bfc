"""Ordered scans and exact order statistics that do not put one key in one task.

A plain window sends all rows of a key to one task. Here a key is cut into chunks
along its order (pages of a script, months of a history): rows are scanned inside
chunks, and only one summary row per chunk is scanned across chunks. The summaries are
kept in the checkpoint folder: joined back lazily, each scan would run its input twice,
and a chain of scans would double again at every step.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marklake.session import checkpointed

_FUNCS = {"sum": F.sum, "max": F.max, "min": F.min}


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys of which a NULL meets a NULL; the keys come once, from the left."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def before(
    df: DataFrame, keys: list[str], chunk: str, order: list, measures: dict[str, tuple[str, Column]]
) -> DataFrame:
    """Add, per measure, the aggregate of all rows strictly before this one in its key.

    ``measures``: new name -> (function of sum/max/min, expression). ``chunk`` must
    follow the order: every row of chunk c comes before every row of chunk c+1.
    The result is NULL where no row precedes.
    """
    staged = df
    for name, (_, expr) in measures.items():
        staged = staged.withColumn(f"_v_{name}", expr)
    totals = staged.groupBy(*keys, chunk).agg(
        *[_FUNCS[f](f"_v_{n}").alias(f"_t_{n}") for n, (f, _) in measures.items()]
    )
    across = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, chunk, *[_FUNCS[f](f"_t_{n}").over(across).alias(f"_o_{n}") for n, (f, _) in measures.items()]
    )
    within = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = null_safe_join(staged, checkpointed(offsets), [*keys, chunk])
    out = [F.col(c) for c in df.columns]
    for n, (f, _) in measures.items():
        local, offset = _FUNCS[f](f"_v_{n}").over(within), F.col(f"_o_{n}")
        if f == "sum":
            both = F.coalesce(local + offset, local, offset)
        else:
            both = F.greatest(local, offset) if f == "max" else F.least(local, offset)
        out.append(both.alias(n))
    return joined.select(*out)


def _neighbour(df: DataFrame, keys: list[str], chunk: str, order: list, name: str, expr: Column, ahead: bool) -> DataFrame:
    staged = df.withColumn("_v", expr)
    inner = Window.partitionBy(*keys, chunk).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(chunk)
    step = F.lead if ahead else F.lag
    pick = F.min_by if ahead else F.max_by
    edge = staged.groupBy(*keys, chunk).agg(pick("_v", F.struct(*order)).alias("_edge"))
    edges = edge.select(*keys, chunk, step("_edge").over(across).alias("_other"))
    at_edge = step(F.lit(True)).over(inner).isNull()
    value = F.when(at_edge, F.col("_other")).otherwise(step("_v").over(inner))
    return null_safe_join(staged, checkpointed(edges), [*keys, chunk]).withColumn(name, value).select(*df.columns, name)


def following(df: DataFrame, keys: list[str], chunk: str, order: list, name: str, expr: Column) -> DataFrame:
    """Add the value of ``expr`` on the next row of the key (lead), chunk by chunk."""
    return _neighbour(df, keys, chunk, order, name, expr, True)


def previous(df: DataFrame, keys: list[str], chunk: str, order: list, name: str, expr: Column) -> DataFrame:
    """Add the value of ``expr`` on the row before (lag), chunk by chunk."""
    return _neighbour(df, keys, chunk, order, name, expr, False)


@F.arrow_udf(T.LongType())
def ordered_bits(value: pa.Array) -> pa.Array:
    """The bits of a double as a number that is ordered as the doubles are."""
    bits = (value.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0).view(np.int64)
    return pa.array(np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits), mask=value.is_null().to_numpy(zero_copy_only=False))


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, _v, _c): how often each value occurs, kept once for the passes that follow."""
    v = F.col(value)
    return checkpointed(df.filter(v.isNotNull()).groupBy(*keys, v.alias("_v")).agg(F.count(F.lit(1)).alias("_c")))


def exact_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact median per key: (keys, n, median)."""
    return median_of_counts(value_counts(df, keys, value), keys)


def median_of_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Exact median from counted values (keys, _v, _c).

    Values are counted first, so ties cost nothing. The middle ranks are then found digit by
    digit of the values' bits: counts per first digit, whatever their spread, name the one or
    two digits that hold them, counts per second digit below these again, and only the at most
    2^20 values that agree in both are ordered. No task holds a whole key.
    """
    digits = counts.withColumn("_k", ordered_bits(F.col("_v").cast("double")))
    digits = digits.withColumn("_d1", F.shiftright("_k", 40)).withColumn("_d2", F.shiftright("_k", 20).bitwiseAND(F.lit((1 << 20) - 1))).drop("_k")
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)

    def middle(rows: DataFrame, of: list[str], digit: str) -> DataFrame:
        """Of counts per digit, those that hold a middle rank, with what comes before them."""
        across = Window.partitionBy(*of).orderBy(digit).rowsBetween(Window.unboundedPreceding, -1)
        start = F.col("_base") + F.coalesce(F.sum("_bc").over(across), F.lit(0))
        placed = rows.withColumn("_start", start)
        end = F.col("_start") + F.col("_bc")
        holds = ((F.col("_start") <= low) & (low < end)) | ((F.col("_start") <= high) & (high < end))
        return placed.filter(holds).select(*of, digit, "n", F.col("_start").alias("_base"))

    first = digits.groupBy(*keys, "_d1").agg(F.sum("_c").alias("_bc")).withColumn("n", F.sum("_bc").over(Window.partitionBy(*keys)))
    first = middle(first.withColumn("_base", F.lit(0).cast("bigint")), keys, "_d1")
    below = null_safe_join(digits, first, [*keys, "_d1"])
    second = below.groupBy(*keys, "_d1", "_d2").agg(F.sum("_c").alias("_bc"), F.max("n").alias("n"), F.max("_base").alias("_base"))
    second = middle(second, [*keys, "_d1"], "_d2")
    within = Window.partitionBy(*keys, "_d1", "_d2").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = null_safe_join(digits, second, [*keys, "_d1", "_d2"]).withColumn("_start", F.col("_base") + F.coalesce(F.sum("_c").over(within), F.lit(0)))
    end = F.col("_start") + F.col("_c")
    at_low = (F.col("_start") <= low) & (low < end)
    at_high = (F.col("_start") <= high) & (high < end)
    return ranked.groupBy(*keys).agg(
        F.max("n").alias("n"),
        ((F.max(F.when(at_low, F.col("_v"))) + F.max(F.when(at_high, F.col("_v")))) / 2.0).alias("median"),
    )
