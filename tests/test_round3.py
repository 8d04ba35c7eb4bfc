"""Findings of the third round."""

import math

import duckdb
import numpy as np
from compare import run_pair

from marklake.operators import audit as A
from marklake.operators import feedback as FB
from marklake.operators import retrieval as R
from marklake.plans import evidence_queries as EQ
from marklake.plans import registry


def agrees(spark, folder, name, **tables):
    """The query and its SQL over small tables, given as lists of rows and a schema each."""
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    ok, note, _ = run_pair(spark, con, name, registry.QUERIES[name], registry.ORACLES[name], str(folder))
    assert ok, note


# Texts without a segment of three characters stand for themselves; white space is that of Unicode.
TEXTS = [(1, "Re."), (2, " 12. "), (3, " \n "), (4, None), (5, ""), (6, "12345"), (7, " A. "), (8, "one two.  ab. x y z　; 678"), (9, "same. size. here")]


def test_text_without_segments_is_its_own_segment(spark, tmp_path):
    agrees(spark, tmp_path, "h13_segments", documents=(TEXTS, "doc_id long, text string"))


def test_longest_segments_of_text_without_any(spark, tmp_path):
    agrees(spark, tmp_path, "f4_longest_segments", documents=(TEXTS, "doc_id long, text string"))


def test_increments_of_a_table_in_a_folder_of_files(spark, tmp_path):
    texts = [(i, f"The count is {i} and the passage number {i} has quite some words. " * (i % 3)) for i in range(40)]
    items = [(i, f"passage number {i} has some words.\nThe count is {i}.") for i in range(5)]
    agrees(spark, tmp_path, "s1_incremental_grading", documents=(texts, "doc_id long, text string"), benchmark=(items, "item_id long, text string"))


def test_equal_scores_deviate_by_nothing_and_a_tie_with_the_threshold_is_consistent(spark):
    """The mean of all scores is no score itself; the distance of three deviations is met exactly."""
    equal = [(1, i, 71.5) for i in range(3)] + [(1, 3, 20.0), (1, 4, 1.0)]
    # of (0, 0, 0, 0, 10) the mean is 2 and the deviation 4: 14 lies three deviations off, 14.5 more
    tie = [(k, i, v) for k, last in ((2, 14.0), (3, 14.5)) for i, v in enumerate([0.0, 0.0, 0.0, 0.0, 10.0, last])]
    ones = [(4, i, v) for i, v in enumerate([0.5, 0.5, 1.0, 1.0, 1.0, 1.0, 2.0])]
    rows = [(k, i // 2, i, v) for k, i, v in equal + tie + ones]
    out = A.history_consistency(spark.createDataFrame(rows, "k int, c int, i int, v double"), ["k"], "c", ["i"], "v").collect()
    got = {(r.k, r.i): (r.z_score, r.consistent) for r in out}
    assert got[(1, 3)] == (None, True)
    assert got[(2, 5)] == (3.0, True) and got[(3, 5)][1] is False
    assert got[(4, 6)] == (7.0 / math.sqrt(2.0), False)


def test_a_query_moves_once_per_block_and_ties_go_to_the_lower_id(spark, monkeypatch):
    """Directions without clusters, thousands of equal vectors, opposite ones (score 0) and one without a direction."""
    monkeypatch.setattr(R, "VECTOR_CELL", 900)
    draw = np.random.default_rng(8)
    v = draw.normal(size=(6000, 16)).round(3)
    v[1000:3500] = v[0]
    v[5990:] = -v[0]
    v[40] = 0.0
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in draw.permutation(6000).tolist()], "document_id int, embedding array<double>").repartition(4)
    asked = [0, 1, 40, 1200, 3600, 5995]
    queries = df.filter(df.document_id.isin(asked)).withColumnRenamed("document_id", "query_id")
    space = R.Neighbours(df, ["document_id"])
    assert len(set(space.block.tolist())) < len(space.block) <= 12
    got = {}
    for r in space.search(queries, 20)[0].collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.document_id, r.score))
    norm = np.linalg.norm(v, axis=1)
    assert set(got) == set(asked) - {40}
    for i in got:
        score = np.round(np.clip(np.divide(v @ v[i], norm * norm[i], out=np.zeros(6000), where=norm > 0), 0, 1), 6)
        want = np.lexsort((np.arange(6000), -score))[:20]
        assert [(d, s) for _, d, s in sorted(got[i])] == [(int(j), score[j]) for j in want]


def test_only_the_questions_asked_are_searched(spark):
    folder = "/root/testdata/sf0.001"
    asked = spark.createDataFrame([(i,) for i in (3, 50, 7)], "query_id long")
    some, queries = EQ.typed_hits(spark, folder, asked)
    every, _ = EQ.typed_hits(spark, folder)
    rows = lambda df: sorted((r.query_id, r.document_id, r.score) for r in df.collect())
    assert queries.count() == 3 and rows(some) == rows(every.join(asked, "query_id", "left_semi"))


def test_feedback_moves_the_questions_of_a_submission_once(spark):
    point = "array<struct<criterion_id:string,description:string,allocated_marks:double,marks_awarded:double,met:boolean>>"
    rows = [(s, f"{i}", i, [("c", f"Coverage of expected concept: cell wall {i % 3}", 4.0, float(i % 5), i % 2 == 0)]) for s in range(4) for i in range(9)]
    questions = spark.createDataFrame(rows, f"submission_id long, question_number string, question_order long, rubric_points {point}")
    totals = spark.createDataFrame([(s, 10.0, 36.0) for s in range(4)], "submission_id long, total_score double, max_possible double")
    out = FB.submission_feedback(questions, totals, ["submission_id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2
    assert all(len(r.strengths) == 3 for r in out.collect())
