import random
import statistics

from pyspark.sql import functions as F

from marklake.functions.scan import before, exact_median, following, previous
from marklake.operators import audit as A

OBS = "script_id bigint, question_number bigint, max_marks double, human_mark double, engine_mark_a double, engine_mark_b double, subject string, question_type string, second_human_mark double"


def observations(rng, scripts, per=4):
    return [
        (s, q, 10.0, float(rng.randint(0, 20)) / 2, rng.choice([None, float(rng.randint(0, 20)) / 2]), None, rng.choice("ab"), "t", None)
        for s in range(scripts)
        for q in range(per)
    ]


def kappa(pairs):
    h, e = [int(2 * x) for x, _ in pairs], [int(2 * y) for _, y in pairs]
    levels = range(min(h + e), max(h + e) + 1)
    if len(levels) < 2:
        return None
    num = sum((a - b) ** 2 for a, b in zip(h, e))
    den = sum(h.count(i) * e.count(j) * (i - j) ** 2 for i in levels for j in levels) / len(h)
    return None if den == 0 else 1 - num / den


def test_agreement_equals_definitions(spark):
    rows = observations(random.Random(2), 30)
    r = A.agreement(spark.createDataFrame(rows, OBS), "engine_mark_a").first()
    pairs = [(x[3], x[4]) for x in rows if x[4] is not None]
    assert r.n == len(pairs)
    assert abs(r.mae - sum(abs(h - e) for h, e in pairs) / len(pairs)) < 1e-12
    assert abs(r.directional_bias - sum(e - h for h, e in pairs) / len(pairs)) < 1e-12
    assert abs(r.exact_agreement - sum(h == e for h, e in pairs) / len(pairs)) < 1e-12
    assert abs(r.qwk - kappa(pairs)) < 1e-12


def test_not_computable_is_null(spark):
    df = spark.createDataFrame([(1, 1, 10.0, 5.0, 5.0, None, "a", "t", None), (2, 1, 10.0, 5.0, 5.0, None, "a", "t", None)], OBS)
    one_level = A.agreement(df, "engine_mark_a").first()
    assert one_level.qwk is None and one_level.exact_agreement == 1.0
    nothing = A.agreement(df, "engine_mark_b").first()
    assert nothing.n == 0 and nothing.mae is None
    assert A.human_ceiling(df).first().exact_agreement is None
    assert A.decomposition(df).first().marking_share is None


def test_uniform_bias_is_found(spark):
    rows = [(s, 1, 10.0, 6.0 + s % 3, 5.5 + s % 3, 5.0, "a", "t", None) for s in range(30)]
    df = spark.createDataFrame(rows, OBS)
    got = {r.statistic: r for r in A.cluster_bootstrap(df, "engine_mark_a", resamples=50).collect()}
    bias = got["directional_bias"]
    assert bias.value == bias.low == bias.high == -0.5 and bias.n_clusters == 30
    d = A.decomposition(df).first()
    assert d.marking_error_marks == 15.0 and d.ocr_induced_marks >= 0.0


def test_one_script_has_no_interval(spark):
    df = spark.createDataFrame([(1, q, 10.0, 5.0, 4.0, None, "a", "t", None) for q in range(5)], OBS)
    r = {x.statistic: x for x in A.cluster_bootstrap(df, "engine_mark_a", resamples=20).collect()}["mae"]
    assert r.value == 1.0 and r.low is None and r.high is None


def test_bootstrap_is_reproducible(spark):
    df = spark.createDataFrame(observations(random.Random(6), 25), OBS)
    one = sorted(map(tuple, A.cluster_bootstrap(df, "engine_mark_a", resamples=40).collect()))
    assert one == sorted(map(tuple, A.cluster_bootstrap(df.repartition(7), "engine_mark_a", resamples=40).collect()))


def test_digests_of_numbers_at_once_are_those_of_each():
    import hashlib

    for head in ("20260815-7-", "x" * 47 + "-", "x" * 60):  # one block, one that the longest numbers overrun, more than one
        for low, high in ((0, 12), (9_990, 10_020), (99_999_990, 100_000_020)):
            want = [int(hashlib.md5(f"{head}{k}".encode()).hexdigest()[:8], 16) for k in range(low, high)]
            assert A.first_words(head, low, high).tolist() == want


def test_draws_that_meet_blocks_of_scripts_give_the_same_and_are_no_rows(spark, monkeypatch):
    df = spark.createDataFrame(observations(random.Random(26), 90), OBS)
    whole = sorted(map(tuple, A.cluster_bootstrap(df, "engine_mark_a", resamples=30).collect()))
    monkeypatch.setattr(A, "BROADCAST_LIMIT_BYTES", 0)
    monkeypatch.setattr(A, "_DRAWS", 16)  # several parts of each resample
    parted = sorted(map(tuple, A.cluster_bootstrap(df, "engine_mark_a", resamples=30).collect()))
    for a, b in zip(whole, parted, strict=True):
        assert all(x == y or abs(x - y) < 1e-12 for x, y in zip(a, b, strict=True))
    monkeypatch.undo()
    drawn = A.packed_draws(spark, 70_000, 3, 1).collect()
    assert len(drawn) == 3 * 2 and sum(len(r.offsets) for r in drawn) == 2 * 3 * 70_000


def test_exact_median_equals_statistics(spark):
    rng = random.Random(9)
    rows = [(k, rng.choice([rng.uniform(0, 100), float(rng.randint(0, 5)), 3.0])) for k in range(12) for _ in range(rng.randint(1, 400))]
    got = {r.k: (r.n, r.median) for r in exact_median(spark.createDataFrame(rows, "k int, v double"), ["k"], "v").collect()}
    for k in range(12):
        values = [v for q, v in rows if q == k]
        assert got[k] == (len(values), statistics.median(values))


def test_outliers_rules(spark):
    rows = [(1, v) for v in (10.0, 11.0, 12.0, 11.0, 10.0, 90.0)] + [(2, 5.0), (2, 50.0)] + [(3, 1.0)] * 5 + [(3, 9.0)]
    got = [(r.k, r.v) for r in A.outliers(spark.createDataFrame(rows, "k int, v double"), ["k"], "v").collect()]
    assert got == [(1, 90.0)]  # two scores are too few; a MAD of zero gives none


def test_scans_equal_loops(spark):
    rng = random.Random(1)
    rows = [(k, i // 7, i, rng.choice([None, rng.randint(-5, 5)])) for k in range(5) for i in range(rng.randint(1, 40))]
    df = spark.createDataFrame(rows, "k int, c int, i int, v int")
    out = before(df, ["k"], "c", ["i"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))})
    out = following(previous(out, ["k"], "c", ["i"], "p", F.col("v")), ["k"], "c", ["i"], "n", F.col("v"))
    got = {(r.k, r.i): (r.s, r.m, r.p, r.n) for r in out.collect()}
    for k in range(5):
        mine = [r for r in rows if r[0] == k]
        for at, r in enumerate(mine):
            past = [x[3] for x in mine[:at] if x[3] is not None]
            want = (sum(past) if past else None, max(past, default=None), mine[at - 1][3] if at else None, mine[at + 1][3] if at + 1 < len(mine) else None)
            assert got[(k, r[2])] == want


def test_history_consistency(spark):
    rows = [(1, i // 4, i, v) for i, v in enumerate([10.0, 12.0, 11.0, 11.5, 40.0, 12.0])] + [(2, 0, i, 5.0) for i in range(4)]
    got = {(r.k, r.i): r.consistent for r in A.history_consistency(spark.createDataFrame(rows, "k int, c int, i int, v double"), ["k"], "c", ["i"], "v").collect()}
    assert got[(1, 4)] is False and got[(1, 2)] is True and all(got[(2, i)] for i in range(4))
