import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marklake import schemas as SC
from marklake.operators import contamination as CT
from marklake.operators import dashboards as D
from marklake.operators import learning as L
from marklake.operators import retrieval as R
from marklake.sources import readers as RD
from marklake.sources import writers as W
from marklake.streaming import jobs as J


def raw(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_observations_fail_fast(spark):
    good = json.dumps({"script_id": "s", "question_number": "1", "max_marks": 5, "human_mark": 3, "engine_mark_A": None})
    row = RD.parse_observations(raw(spark, good, "", "   ")).collect()
    assert len(row) == 1 and row[0].subject == "unknown" and row[0].engine_mark_a is None
    for bad in ("{", json.dumps({"script_id": "s"}), good.replace("null", '"x"')):
        with pytest.raises(Exception, match="bad observation"):
            RD.parse_observations(raw(spark, good, bad)).collect()


def test_schemes_accept_both_forms(spark):
    q = {"id": "q", "question_number": 1, "question_text": "t", "max_marks": 2, "value_points": [{"id": "v", "text": "x", "marks": 2}]}
    for doc in ({"questions": [q]}, [q]):
        row = RD.parse_schemes(raw(spark, json.dumps(doc))).first()
        assert row.question_number == "1" and row.value_points[0].match_mode is None
    with pytest.raises(Exception, match="at least one value point"):
        RD.parse_schemes(raw(spark, json.dumps([dict(q, value_points=[])]))).collect()


def test_scheme_invariants(spark):
    base = dict(question_id="q", value_point_id="v", marks=1.0, group_id=None, group_rule=None, group_n=None, max_marks=2.0)
    schema = "question_id string, value_point_id string, marks double, group_id string, group_rule string, group_n int, max_marks double"
    SC.checked_value_points(spark.createDataFrame([base], schema)).collect()
    for change, said in (({"marks": -1.0}, "negative"), ({"group_id": "g", "group_rule": "ANY_N"}, "group_n"), ({"group_id": "g"}, "without group_rule"), ({"max_marks": 0.0}, "positive")):
        with pytest.raises(Exception, match=said):
            SC.checked_value_points(spark.createDataFrame([dict(base, **change)], schema)).collect()


def test_evidence_invariants(spark):
    schema = "value_point_id string, matched boolean, span_start int, span_end int"
    for row in (("v", True, None, None), ("v", True, 5, 2)):
        with pytest.raises(Exception):
            SC.checked_evidence(spark.createDataFrame([row], schema)).collect()


def test_replay_needs_every_page(spark):
    asked, cache = spark.createDataFrame([("a",), ("b",)], "cache_key string"), spark.createDataFrame([("a", 1)], "cache_key string, x int")
    assert RD.cache_misses(asked, cache).first().cache_key == "b"
    with pytest.raises(Exception, match="no stored extraction for b"):
        RD.replay(asked, cache).collect()


def test_fence(spark):
    cases = {"```json\n{\"a\": 1}\n```": '{"a": 1}', "```\n[1]\n```": "[1]", " {} ": "{}", "x ```json\n{}\n```": "x ```json\n{}\n```"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", RD.strip_fence(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in rows} == cases


def test_transcription_files(spark, tmp_path):
    page = {"model_id": "m", "prompt_version": "p", "page_sha256": "h", "extraction_sha256": "e", "lines": [{"text": "a"}, {"text": "b", "confidence": 0.5, "bbox": [0, 0, 1, 1], "struck_through": True}]}
    (tmp_path / "one.json").write_text(json.dumps(page, indent=2))
    (tmp_path / "two.json").write_text(json.dumps([page, dict(page, page_number=2)]))
    rows = RD.read_transcriptions(spark, str(tmp_path)).collect()
    assert len(rows) == 6 and sum(r.struck_through for r in rows) == 3 and {r.page_number for r in rows} == {1, 2}
    assert any(r.confidence is None for r in rows)  # unknown stays unknown


def test_upload_listing_reads_no_content(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"x" * 10)
    (tmp_path / "b.exe").write_bytes(b"x")
    got = {r.file_name: r.reject_reason for r in RD.validate_uploads(RD.list_uploads(spark, str(tmp_path))).collect()}
    assert got["a.PDF"] is None and "'.exe' is not allowed" in got["b.exe"]


def test_patches_skip_nulls(spark):
    base = spark.createDataFrame([(1, "UPLOADED", None), (2, "UPLOADED", 3.0)], "id int, status string, marks double")
    log = spark.createDataFrame([(1, 1, "PROCESSING", 5.0), (1, 2, "COMPLETED", None)], "id int, seq int, status string, marks double")
    got = {r.id: (r.status, r.marks) for r in W.apply_patches(base, log, "id", ["status", "marks"], "seq").collect()}
    assert got == {1: ("COMPLETED", 5.0), 2: ("UPLOADED", 3.0)}


# --- dashboards on edge rows ----------------------------------------------------------------

SUBS = "exam_id int, submission_id int, status string, obtained_marks double, total_marks double, evaluation_confidence double, document_mode string, has_document boolean, fairness_score double, fairness_verified boolean"
EXAMS = "exam_id int, teacher_id int, title string, results_published boolean, evaluation_mode string, answer_key_url string"


def edge(spark):
    subs = [
        (1, 1, "COMPLETED", 9.0, 10.0, 0.85, None, True, 1.0, True),
        (1, 2, "COMPLETED", None, 10.0, None, None, False, None, None),
        (1, 3, "COMPLETED", 5.0, 0.0, 0.7, "ANSWER_KEY", True, 0.5, False),
        (1, 4, "FAILED", 8.0, 10.0, 0.9, None, False, None, None),
    ]
    exams = [(1, 7, "A", True, None, None), (2, 7, "Empty", False, None, "k")]
    return spark.createDataFrame(subs, SUBS), spark.createDataFrame(exams, EXAMS)


def test_histogram_variants_differ(spark):
    subs, exams = edge(spark)
    dash = subs.agg(*D.dashboard_histogram()).first()
    cls = subs.agg(*D.class_histogram()).first()
    assert (dash.score_90_100, dash.score_below_60) == (1, 2) and (cls.score_90_100, cls.score_below_60) == (1, 0)
    docs = spark.createDataFrame([(5.0, 0.0), (8.0, 10.0)], "total_score double, max_possible double")
    cohort = docs.agg(*D.cohort_histogram()).first()
    assert (cohort.score_80_89, cohort.score_below_60) == (1, 1)


def test_exam_without_submissions_and_nobody(spark):
    subs, exams = edge(spark)
    rows = {r.exam_id: r for r in D.exam_analytics(subs, exams).collect()}
    assert (rows[2].submission_count, rows[2].average_score, rows[2].completion_rate) == (0, 0.0, 0.0)
    assert (rows[1].average_score, rows[1].top_score, rows[1].lowest_score, rows[1].completion_rate) == (7.0, 9.0, 5.0, 75.0)
    none = D.overview_metrics(subs, exams, user_id=99).first()
    assert none.total_exams == 0 and none.average_score == 0.0 and none.result_publication_rate == 0.0
    mine = D.overview_metrics(subs, exams, user_id=7).first()
    assert (mine.total_exams, mine.total_submissions, mine.autonomous_evaluations, mine.answer_key_evaluations) == (2, 4, 2, 1)
    empty = D.monitoring(subs, exams, user_id=99).first()
    assert empty.bias_free_rate == 100.0 and empty.average_fairness_score == 1.0
    m = D.monitoring(subs, exams, is_admin=True).first()
    assert m.flagged_submissions_count == 1 and m.average_fairness_score == 0.75 and m.low_confidence_below_70 == 1


def test_mastery_boundaries(spark):
    cols = "k int, o bigint, topic_context string, score_awarded double, max_marks double, confidence double, has_semantic boolean, matched_semantic array<string>, missing_semantic array<string>, matched_keywords array<string>, missing_concepts array<string>"
    rows = [(1, i, c, s, 10.0, 1.0, False, [], [], ["x"], ["y"] if s < 5 else []) for i, (c, s) in enumerate([(None, 8.0), ("T. Objectives: a", 5.0), ("U", 3.0), ("V", 2.9)])]
    q = spark.createDataFrame(rows, cols)
    got = {r.topic: r.status for r in L.topic_mastery(q, ["k"], "o").collect()}
    assert got == {"General Topic": "MASTERED", "T": "DEVELOPING", "U": "WEAK", "V": "CRITICAL"}
    a = L.analyze(q, ["k"], "o").first()
    assert a.overall_mastery == round((0.8 + 0.5 + 0.3 + 0.29) / 4, 4) and a.weak_topics == ["U", "V"]
    assert a.recommendations[0].startswith("Prioritize re-learning the core components of 'V'")
    praise = L.analyze(q.filter("o = 0"), ["k"], "o").first()
    assert praise.recommendations == [L.PRAISE]


# --- retrieval, contamination ------------------------------------------------------------------


def test_a_bad_observation_is_named_by_file_and_line(spark, tmp_path):
    good = '{"script_id": "s%d", "question_number": "1", "max_marks": 5, "human_mark": 2}'
    for name, bad in (("a", []), ("b", [1503, 1700])):
        lines = [good % i if i % 7 else "" for i in range(2000)]
        for at in bad:
            lines[at - 1] = '{"script_id": 3'
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + "\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9k")
    try:
        assert RD.read_observations(spark, f"{tmp_path}/a.jsonl").count() == sum(1 for i in range(2000) if i % 7)
        found = [(r.file.rsplit("/", 1)[1], r.line) for r in RD.bad_lines(spark, str(tmp_path)).orderBy("file", "line").collect()]
        assert found == [("b.jsonl", 1503), ("b.jsonl", 1700)]
        with pytest.raises(Exception, match=r"b.jsonl, line 1503: "):
            RD.read_observations(spark, str(tmp_path)).count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_nearest_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(R, "QUERY_CELL", 7)
    monkeypatch.setattr(R, "VECTOR_CELL", 11)
    rng = random.Random(3)
    vecs = [(i, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(5)]) for i in range(60)] + [(99, [0.0] * 5)]
    df = spark.createDataFrame(vecs, "document_id bigint, embedding array<float>")
    got = {}
    for r in R.nearest(df.withColumnRenamed("document_id", "query_id"), df, 4).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.document_id, r.score))

    def cos(a, b):
        n = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return round(min(1.0, max(0.0, sum(x * y for x, y in zip(a, b)) / n)), 6) if n else 0.0

    for i, v in vecs:
        if not any(v):
            assert i not in got  # a query without direction gives no rows
            continue
        want = sorted(((-cos(v, w), j) for j, w in vecs))[:4]
        assert [(d, -s) for s, d in want] == [(d, s) for _, d, s in sorted(got[i])]


def test_cells_are_skipped_and_ids_may_be_text(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(R, "CELLS", 40)
    draw = np.random.default_rng(6)
    middle = draw.normal(size=(30, 8))
    v = middle[draw.integers(0, 30, 21_000)] + draw.normal(scale=0.05, size=(21_000, 8))
    rows = [("Topic" if i % 2 else "Question", str(i // 2), [float(x) for x in v[i]]) for i in range(21_000)]
    vectors = spark.createDataFrame(rows, "document_type string, document_id string, embedding array<double>").repartition(4)
    queries = spark.createDataFrame([(f"q{i}", [float(x) for x in v[i]]) for i in range(0, 3000, 100)] + [("none", [0.0] * 8)], "query_id string, embedding array<double>")
    found, visited = R.Neighbours(vectors, ["document_type", "document_id"]).search(queries, 6)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.document_type, r.document_id, r.score))
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    assert "none" not in got and len(got) == 30
    for i in range(0, 3000, 100):
        score = np.round(np.clip(unit @ unit[i], 0, 1), 6)
        want = sorted((-s, rows[j][0], rows[j][1]) for j, s in enumerate(score) if s >= np.sort(score)[-6])[:6]
        assert [(t, d, -s) for s, t, d in want] == [(t, d, s) for _, t, d, s in sorted(got[f"q{i}"])]
    share = [(r.visited, r.cells) for r in visited.filter("query_id <> 'none'").collect()]
    assert sum(x for x, _ in share) < 0.5 * sum(n for _, n in share)
    by_type = R.retrieve(queries.withColumn("query_text", F.lit("x")), vectors, 2, ["document_type", "document_id"])
    assert by_type.count() == 60


def test_lifts_equal_plain_containment(spark):
    rng = random.Random(12)
    words = ["of", "a", "net", "cat", "concat", "sat", "on", "mat", "tree"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    answers = [(i, text(rng.randint(0, 40)) + "!") for i in range(60)]
    phrases = [(i, text(rng.randint(2, 6))) for i in range(80)] + [(900, "cat sat on"), (901, "Of, the")]
    a = spark.createDataFrame(answers, "answer_id int, answer_text string")
    p = spark.createDataFrame(phrases, "phrase_id int, phrase_text string")
    got = {(r.phrase_id, r.answer_id) for r in CT.lifted_phrases(p, a).collect()}
    norm = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
    want = {(i, j) for i, t in phrases for j, s in answers if sum(len(w) > 1 for w in norm(t).split()) >= 3 and norm(t) in norm(s)}
    assert got == want and want


def test_pseudonyms_are_stable_and_distinct(spark):
    files = spark.createDataFrame([(f"p/{i}", f"CS{i:03d}_x", ".PDF") for i in range(200)], "path string, stem string, suffix string")
    m = CT.pseudonyms(files, "secret")
    assert CT.colliding_pseudonyms(m).count() == 0
    first = m.orderBy("path").first()
    assert first.roll_tokens == ["CS000"] and first.new_name.endswith(".pdf") and "CS" not in first.new_name
    assert first.new_name == CT.pseudonyms(files.repartition(5), "secret").orderBy("path").first().new_name


def test_context_prefers_hint_over_mismatch(spark):
    hits = spark.createDataFrame([(1, "stack and queue", 5, "Subject", "Subject: Science (S). x", 0.9)], "query_id int, query_text string, document_id int, document_type string, content string, score double")
    hints = spark.createDataFrame([(1, "stack and queue", "DSA"), (2, "anything", "History"), (3, " ", "X")], "query_id int, query_text string, subject_hint string")
    got = {r.query_id: r for r in R.curriculum_context(hits, hints).collect()}
    assert got[1].subject == "DSA" and got[1].topic == R.MISMATCH_SUBJECT and got[1].retrieval_score == 0.9
    assert got[2].chapter == "History Core" and got[3].subject == ""


# --- streams -------------------------------------------------------------------------------------


def replay_logins(rows):
    state, out = {}, []
    for event_id, user, ts, ok in sorted(rows, key=lambda r: (r[2], r[0])):
        n, until = state.get(user, (0, None))
        if until is not None and until > ts:
            out.append((event_id, "LOCKED", n))
            continue
        if ok:
            n, until, said = 0, None, "SUCCESS"
        else:
            n += 1
            said = "WRONG_PASSWORD"
            if n >= 5:
                until, said = ts + pd.Timedelta(minutes=15), "WRONG_PASSWORD_LOCKS"
        state[user] = (n, until)
        out.append((event_id, said, n))
    return sorted(out)


def test_lockout_batch_and_stream_equal_replay(spark, tmp_path):
    rng = random.Random(7)
    start = pd.Timestamp("2024-01-01")
    rows = [(i, rng.randint(0, 3), start + pd.Timedelta(seconds=rng.randint(0, 20000)), rng.random() < 0.15) for i in range(600)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["event_id", "user_id", "ts", "success"]))
    want = replay_logins(rows)
    flat = lambda d: sorted((r.event_id, r.outcome, r.failed_attempts) for r in d.collect())
    assert flat(J.lockout_batch(df)) == want
    assert any(o == "LOCKED" for _, o, _ in want) and any(o == "WRONG_PASSWORD_LOCKS" and n > 5 for _, o, n in want)
    for part, sub in enumerate(range(0, 20001, 5000)):  # files arrive in time order
        low, high = start + pd.Timedelta(seconds=sub), start + pd.Timedelta(seconds=sub + 5000)
        df.filter((F.col("ts") >= F.lit(low)) & (F.col("ts") < F.lit(high))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = J.file_stream(spark, df.schema, str(tmp_path / "in"), "*.parquet", files_per_batch=1)
    J.run_available(J.lockout_stream(stream), lambda b, n: b.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={n}")), str(tmp_path / "state"))
    assert flat(spark.read.parquet(str(tmp_path / "out"))) == want


def test_graded_increment_survives_a_second_run(spark, tmp_path):
    batch = spark.createDataFrame([(1, "good"), (2, "")], "id int, text string")
    handle = J.grade_increment(lambda d: d, F.col("text") == "", str(tmp_path), "id")
    handle(batch, 0)
    handle(batch, 0)  # the same micro-batch again
    out = {r.id: (r.status, r.error_message) for r in J.graded(spark, str(tmp_path)).collect()}
    assert out == {1: ("COMPLETED", None), 2: ("FAILED", J.GENERIC_FAILURE)}


def test_a_user_who_only_fails_is_many_tasks_work(spark):
    rng = random.Random(9)
    start = pd.Timestamp("2024-01-01")
    rows = [(i, 1, start + pd.Timedelta(seconds=37 * i + rng.randint(0, 30)), False) for i in range(4000)]
    rows += [(9000 + i, 2, start + pd.Timedelta(seconds=rng.randint(0, 10**6)), rng.random() < 0.3) for i in range(1500)]
    rows += [(20000 + i, None, start + pd.Timedelta(hours=i), False) for i in range(7)]
    df = spark.createDataFrame([(i, u, t.to_pydatetime(), ok) for i, u, t, ok in rows], "event_id bigint, user_id bigint, ts timestamp, success boolean")
    got = J.lockout_batch(df, hours=1)
    assert sorted((r.event_id, r.outcome, r.failed_attempts) for r in got.collect()) == replay_logins(rows)
    assert J.lockout_batch(df.limit(0)).count() == 0
