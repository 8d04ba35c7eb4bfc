"""Inputs beyond what used to be cut off, and NULL keys, chunks and labels."""

import pytest
from pyspark.sql import functions as F

from marklake.functions import scan
from marklake.functions import text as TX
from marklake.operators import audit as A
from marklake.operators import autonomous as AU
from marklake.operators import evidence as E
from marklake.operators import feedback as FB
from marklake.session import ensure_checkpoint_dir, remove_checkpoints


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first()["x"]


def word(i):
    return "w" + "abcdefghij"[i // 100] + "abcdefghij"[i // 10 % 10] + "abcdefghij"[i % 10]


def test_all_keywords_and_concepts_count(spark):
    text = " ".join(word(i) for i in range(300))
    assert one(spark, text, TX.keywords(F.col("t")))[-1] == word(299)
    assert len(one(spark, text, TX.expected_concepts(F.col("t"), F.lit("")))) == 300
    assert len(one(spark, text, TX.keywords(F.col("t"), 12))) == 12


def test_all_points_of_a_key_become_criteria(spark):
    key = "\n- ".join(["", *[f"point {i}" for i in range(9)], "pH"])
    assert one(spark, key, TX.rubric_descriptions(F.col("t")))[-2:] == ["point 8", "pH"]
    assert len(one(spark, key, TX.rubric_descriptions(F.col("t"), 5, 6))) == 5


def test_all_segments_stay_in_order(spark):
    text = ". ".join(f"segment {i}" for i in range(150))
    segments = one(spark, text, TX.capped_segments(TX.segments(F.col("t"))))
    assert segments == [f"segment {i}" for i in range(150)]
    assert len(one(spark, text, TX.capped_segments(TX.segments(F.col("t")), 100))) == 100


def test_either_and_or_far_apart(spark):
    assert one(spark, "Either " + "describe it " * 60 + "or draw it", TX.has_or_structure(F.col("t")))


def test_labels_of_many_alternatives_differ(spark):
    labels = spark.range(800).select(AU.option_letters(F.col("id")).alias("x")).collect()
    got = [r.x for r in labels]
    assert got[:2] + got[25:29] + [got[701], got[702]] == ["A", "B", "Z", "AA", "AB", "AC", "ZZ", "AAA"]
    assert len(set(got)) == 800


def test_missing_concepts_keep_their_order(spark):
    missing = ["x"] * 500 + ["zebra"] + [f"apple {i}" for i in range(501, 521)]
    point = "array<struct<description:string,allocated_marks:double,marks_awarded:double,met:boolean>>"
    q = spark.createDataFrame(
        [(1, "1", 1, missing, [("rubric one", 1.0, 0.0, False)]), (1, "2", 2, ["later"], [])],
        f"id int, question_number string, question_order int, missing_concepts array<string>, rubric_points {point}",
    )
    out = FB.submission_feedback(q, spark.createDataFrame([(1, 0.0, 1.0)], "id int, total_score double, max_possible double"), ["id"]).first()
    assert out["study_recommendations"] == ["Zebra", "Apple 501", "Apple 502", "Apple 503"]


def test_scans_keep_rows_with_null_chunk_and_key(spark):
    rows = spark.createDataFrame([(1, None, 1, 5), (1, 2, 2, 7), (None, 1, 3, 9), (None, 1, 4, 1)], "k int, c int, i int, v int")
    got = scan.before(rows, ["k"], "c", ["i"], {"s": ("sum", F.col("v"))}).select("i", "s").collect()
    assert dict(got) == {1: None, 2: 5, 3: None, 4: 9}
    assert dict(scan.previous(rows, ["k"], "c", ["i"], "p", F.col("v")).select("i", "p").collect()) == {1: None, 2: 5, 3: None, 4: 9}


def test_outliers_of_null_keys_and_of_one_huge_value(spark):
    values = [(k, float(v)) for k in (1, None) for v in [*range(100), 10**12]]
    found = A.outliers(spark.createDataFrame(values, "k int, v double"), ["k"], "v").select("k", "v", "median").collect()
    assert sorted(map(tuple, found), key=str) == [(1, 1e12, 50.0), (None, 1e12, 50.0)]


def test_history_of_large_scores(spark):
    rows = [(1, i, 1e8 + 0.1) for i in range(6)] + [(1, 6, 1e8 + 0.2), (1, 7, 1e8 + 0.2)]
    got = A.history_consistency(spark.createDataFrame(rows, "k int, i int, v double"), ["k"], "i", ["i"], "v")
    assert got.where("i = 7").first()["z_score"] == pytest.approx(2.449, abs=1e-3)


def test_answers_without_a_label_get_the_first_question(spark):
    answers = spark.createDataFrame([(1, None), (1, "q2"), (None, "q2")], "exam_id int, label string")
    questions = spark.createDataFrame([(1, "question_1", 1), (1, "question_2", 2)], "exam_id int, question_key string, position int")
    got = E.resolve_questions(answers, questions).select("exam_id", "label", "question_key").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, None, "question_1"), (1, "q2", "question_2"), (None, "q2", None)], key=str)


def test_checkpoints_can_be_removed(spark):
    frame = scan.checkpointed(spark.range(3))
    path = ensure_checkpoint_dir(spark)
    assert frame.count() == 3 and frame.inputFiles()[0].startswith("file:") and path
    assert callable(remove_checkpoints)


def test_a_submission_that_stops_grading_fails_alone(spark, tmp_path):
    from marklake.streaming import jobs as J

    rows = spark.range(40).select(F.col("id"), F.when(F.col("id") == 3, "").otherwise("answer").alias("text"))

    def grade(batch):
        poison = F.when(F.col("id").isin(17, 18), F.raise_error(F.lit("no such question")).cast("long"))
        return batch.withColumn("marks", F.coalesce(poison, F.col("id")))

    J.grade_increment(grade, F.col("text") == "", str(tmp_path), "id")(rows, 0)
    out = J.graded(spark, str(tmp_path)).collect()
    failed = {r.id: r.error_message for r in out if r.status == "FAILED"}
    assert set(failed) == {3, 17, 18} and "no such question" in failed[17]
    assert sorted(r.id for r in out if r.status == "COMPLETED") == [i for i in range(40) if i not in failed]


def test_a_batch_counts_once_whatever_stopped_it_before(spark, tmp_path):
    from marklake.streaming import commits
    from marklake.streaming import jobs as J

    rows, calls = spark.range(8).withColumn("text", F.lit("answer")), []

    def grade(batch):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("No space left on device")  # not the submissions' fault
        poison = F.when(F.lit(len(calls) == 1) & (F.col("id") == 5), F.raise_error(F.lit("a passing error")).cast("long"))
        return batch.withColumn("marks", F.coalesce(poison, F.col("id")))

    handle = J.grade_increment(grade, F.col("text") == "", str(tmp_path), "id")
    try:
        handle(rows, 0)
        raise AssertionError("the disk's error must stop the batch")
    except OSError:
        assert not commits.known(spark, str(tmp_path), 0)
    handle(rows, 0)
    handle(rows, 0)
    assert sorted(r.id for r in J.graded(spark, str(tmp_path)).filter("status = 'COMPLETED'").collect()) == list(range(8))
    handle(spark.range(8, 10).withColumn("text", F.lit("answer")), 1)
    assert J.graded(spark, str(tmp_path)).count() == 10


def test_rows_that_fail_in_matching_fail_alone(spark, tmp_path):
    from marklake.operators import evidence as E
    from marklake.streaming import jobs as J
    from tests_support import SCHEME, vp

    schemes = spark.createDataFrame([("q", "1", "?", 1.0, [vp("a", "river")]), ("broken", "2", "?", 1.0, [vp("b", None)])], SCHEME)
    rows = spark.createDataFrame([(1, "q", "the river"), (2, "broken", "the river"), (3, "q", "no")], "answer_id bigint, question_id string, answer_text string")

    def grade(batch):
        evidence = E.text_evidence(batch, schemes, guarded=True)
        return batch.join(evidence.groupBy("answer_id").agg(F.count_if("matched").alias("n"), F.max(F.when(F.col("method") == E.ERROR, F.col("reason"))).alias("error_message")), "answer_id")

    J.grade_increment(grade, F.col("answer_text") == "", str(tmp_path), "answer_id")(rows, 0)
    got = {r.answer_id: (r.status, r.n) for r in J.graded(spark, str(tmp_path)).collect()}
    assert got == {1: ("COMPLETED", 1), 2: ("FAILED", 0), 3: ("COMPLETED", 0)}


def test_lifecycle_rewrites_only_touched_buckets(spark, tmp_path):
    from marklake.streaming import commits
    from marklake.streaming import jobs as J

    kind = "event_id bigint, submission_id bigint, status string, ts bigint"
    first = [(i, i, "UPLOADED", 1) for i in range(40)] + [(100 + i, i, "PROCESSING", 2) for i in range(40)]
    second = [(200, 3, "OCR_COMPLETE", 3), (201, 4, "FAILED", 3), (202, 5, "COMPLETED", 3), (203, 77, "EVALUATING", 3)]
    third = [(300, 4, "PROCESSING", 4), (301, 3, "EVALUATING", 5), (302, 3, "COMPLETED", 6), (303, 3, "FAILED", 7)]
    handle, sink = J.merge_lifecycle(str(tmp_path), 8), str(tmp_path)
    for n, rows in enumerate((first, second, second, third)):
        frame = spark.createDataFrame(rows, kind).withColumn("ts", F.timestamp_seconds("ts"))
        handle(frame, min(n, 1) if n < 3 else 2)  # the second batch runs twice
    whole = spark.createDataFrame(first + second + third, kind).withColumn("ts", F.timestamp_seconds("ts"))
    order = lambda d: sorted(map(tuple, d.collect()), key=str)
    assert order(J.current_lifecycle(spark, sink)) == order(J.lifecycle(whole))
    assert order(J.rejected_events(spark, sink)) == order(J.illegal_transitions(whole))
    assert {r.event_id for r in J.illegal_transitions(whole).collect()} == {202, 203, 303}
    state = {r.submission_id: tuple(r)[1:4] for r in J.current_lifecycle(spark, sink).collect()}
    assert state[3] == ("COMPLETED", "COMPLETED", "COMPLETED") and state[4] == ("PROCESSING", "PROCESSING", None)
    one, two = (commits.manifest(spark, sink, n)["buckets"] for n in (0, 1))
    assert sum(one.get(b) != two[b] for b in two) <= 4 < len(two)


def test_labels_are_told_apart_without_a_table_of_them_all(spark):
    from marklake.plans import evidence_queries as EQ

    labels = EQ._labels(spark, "/root/testdata/sf0.001")
    assert "Aggregate" not in labels._jdf.queryExecution().sparkPlan().toString()
    li, orders = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("lineitem", "orders"))
    numbers = li.join(orders, li.l_orderkey == orders.o_orderkey).select("l_orderkey", "l_linenumber")
    assert numbers.count() > labels.count() == labels.distinct().count() == numbers.distinct().count()
