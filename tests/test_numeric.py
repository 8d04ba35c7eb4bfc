import random

from pyspark.sql import functions as F

from marklake.functions.numeric import as_ratio, clamp, fmt_g, percent, round_even


def test_round_even_equals_python_round(spark):
    rng = random.Random(3)
    values = [2.675, 0.125, 2.5, 3.5, 1.005, 0.015, 0.025, -2.675, 0.0, 1e6 + 0.125]
    values += [rng.uniform(0, 100) for _ in range(300)] + [rng.randrange(100000) / 1000 for _ in range(700)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", *[round_even(F.col("v"), n).alias(f"r{n}") for n in (0, 1, 2, 4)]).collect()
    for row in got:
        for n in (0, 1, 2, 4):
            assert row[f"r{n}"] == round(row.v, n), (row.v, n)


def test_fmt_g_equals_python(spark):
    values = [0.0, 1.0, 1.5, 100.0, 2.25, 12.3456, 99999.5, 0.5, 120.0, 1000.25, 0.0625]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", fmt_g(F.col("v")).alias("g")).collect()
    assert [r.g for r in rows] == [f"{v:g}" for v in values]


def test_null_and_ratio_rules(spark):
    row = spark.range(1).select(
        clamp(F.lit(None).cast("double")).alias("a"),
        as_ratio(F.lit(1.0)).alias("b"),
        as_ratio(F.lit(1.01)).alias("c"),
        percent(F.lit(1.0), F.lit(0.0)).alias("d"),
        round_even(F.lit(None).cast("double"), 2).alias("e"),
    ).first()
    assert row.a is None and row.b == 1.0 and row.c == 0.0101 and row.d == 0.0 and row.e is None
