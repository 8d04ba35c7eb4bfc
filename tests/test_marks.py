import random

import pytest
from pyspark.sql import functions as F

from marklake.operators import marks as M

POINTS = "question_id string, value_point_id string, position int, group_id string, group_rule string, group_n int, marks double, matched boolean, uncalibrated boolean, max_marks double"


def by_hand(points):
    total = 0.0
    groups = {}
    for p in points:
        groups.setdefault(p["group_id"], []).append(p)
    for gid, members in groups.items():
        hits = sorted((p["marks"] for p in members if p["matched"]), reverse=True)
        if gid is not None and members[0]["group_rule"] == "ANY_N":
            n = members[0]["group_n"]
            best = sorted((p["marks"] for p in members), reverse=True)[:n]
            total += min(sum(hits[:n]), sum(best))
        else:
            total += sum(hits)
    return total


def random_points(seed):
    rng = random.Random(seed)
    rows = []
    for q in range(60):
        rules = {g: rng.choice(["ANY_N", "ALL"]) for g in "ab"}
        sizes = {g: rng.randint(1, 3) for g in "ab"}
        for i in range(rng.randint(1, 9)):
            g = rng.choice([None, "a", "b"])
            rows.append(
                dict(
                    question_id=f"q{q}", value_point_id=f"{q}.{i}", position=i, group_id=g, group_rule=rules.get(g),
                    group_n=sizes[g] if g and rules[g] == "ANY_N" else None, marks=rng.choice([0.5, 1.0, 1.0, 2.0]),
                    matched=rng.random() < 0.6, uncalibrated=False, max_marks=4.0,
                )
            )
    return rows


def test_totals_equal_hand_computation(spark):
    rows = random_points(11)
    got = {r.question_id: r for r in M.question_marks(spark.createDataFrame(rows, POINTS), ["question_id"]).collect()}
    for q in {r["question_id"] for r in rows}:
        want = by_hand([r for r in rows if r["question_id"] == q])
        assert got[q].uncapped == want and got[q].total == min(4.0, want)


def test_award_lines_add_up_and_surplus_is_kept(spark):
    rows = random_points(12)
    df = spark.createDataFrame(rows, POINTS).withColumn("method", F.lit("EXACT")).withColumn("reason", F.lit(None).cast("string"))
    lines = M.award_lines(df, ["question_id"], "position").collect()
    assert len(lines) == len(rows)
    for q in {r["question_id"] for r in rows}:
        assert sum(x.awarded for x in lines if x.question_id == q) == by_hand([r for r in rows if r["question_id"] == q])
    assert any(x.surplus and "outside the best" in x.reason for x in lines)


def test_ties_go_to_scheme_order(spark):
    rows = [dict(question_id="q", value_point_id=str(i), position=i, group_id="g", group_rule="ANY_N", group_n=2, marks=1.0, matched=True, uncalibrated=False, max_marks=5.0) for i in range(4)]
    df = spark.createDataFrame(rows, POINTS).withColumn("method", F.lit("EXACT")).withColumn("reason", F.lit(None).cast("string"))
    won = [r.value_point_id for r in M.award_lines(df, ["question_id"], "position").orderBy("position").collect() if r.awarded > 0]
    assert won == ["0", "1"]


def test_conflicting_group_members_are_rejected(spark):
    base = dict(question_id="q", group_id="g", group_rule="ANY_N", marks=1.0, matched=True, uncalibrated=False, max_marks=5.0)
    rows = [dict(base, value_point_id="a", position=0, group_n=1), dict(base, value_point_id="b", position=1, group_n=2)]
    with pytest.raises(Exception, match="disagree"):
        M.question_marks(spark.createDataFrame(rows, POINTS), ["question_id"]).collect()


def test_unknown_value_point_stops_the_job(spark):
    scheme = spark.createDataFrame([("q", "1")], "question_id string, value_point_id string")
    evidence = spark.createDataFrame([("q", "1", True), ("q", "9", False)], "question_id string, value_point_id string, matched boolean")
    with pytest.raises(Exception, match="unknown value point 9"):
        M.reject_unknown_value_points(evidence, scheme).count()


def test_region_outcomes_three_ways(spark):
    regions = spark.createDataFrame(
        [(1, "1", "OK", False), (1, "2", "OK", False), (1, "3", "OUT_OF_ORDER", False), (1, "4", "SPANS_PAGES", True)],
        "script_id int, question_number string, status string, has_flags boolean",
    )
    scheme = spark.createDataFrame([("1", "q1", 5.0)], "question_number string, question_id string, max_marks double")
    got = {r.question_number: r.outcome for r in M.region_outcomes(regions, scheme).collect()}
    assert got == {"1": "scored", "2": "no_scheme", "3": "routed", "4": "routed"}
