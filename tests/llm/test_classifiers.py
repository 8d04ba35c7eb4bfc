"""Quality and toxicity: held-out accuracy, the site arithmetic against plain Python, odd rows."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marklake.llm import quality as Q
from marklake.llm.linear import fit, sigmoid
from marklake.llm.toxicity import _tallied, toxicity, without_toxic

SF = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, p double, host string"
ODD = [(None, None), (1, ""), (1, "again"), (1, "again"), (2, "word " * 30_000), (3, " \n\t"), (4, "é😀 中文")]


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    taught = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    return docs, labels.where(taught), labels.where(~taught)


def odd(spark):
    return spark.createDataFrame([(k, t, None if k == 1 else "en", None if k == 4 else "a", 0, 0.5, "h") for k, t in ODD], SCHEMA)


def test_toxicity_held_out(tables):
    docs, taught, held = tables
    out = toxicity(docs, taught)
    got = out.join(held, "doc_id").groupBy("toxic", "rejected").count().collect()
    n = {(r.toxic, r.rejected): r["count"] for r in got}
    assert out.count() == docs.count()
    assert n[1, True] >= 0.93 * (n[1, True] + n.get((1, False), 0))
    assert n.get((0, True), 0) <= 0.005 * n[0, False]


def test_quality_held_out(tables):
    docs, taught, held = tables
    out = Q.quality(docs, taught)
    n = {(r.quality, r.rejected): r["count"] for r in out.join(held, "doc_id").groupBy("quality", "rejected").count().collect()}
    assert out.count() == docs.count()
    assert n[0, True] >= 0.95 * (n[0, True] + n.get((0, False), 0))
    assert n.get((1, True), 0) <= 0.002 * n[1, False]


def test_site_posteriors_are_the_formula(spark):
    rows = [("a", "x", 0.1), ("a", "x", 0.9), ("a", "y", 0.2), ("b", None, 0.3), ("b", None, 0.05), (None, "x", 0.5), (None, "x", 0.7)]
    sites, rate, under = Q.site_rates(spark.createDataFrame(rows, "host string, path string, p double"))
    sites = {(r.host, r.path): r for r in sites.collect()}
    assert rate == pytest.approx(sum(p for _, _, p in rows) / len(rows))
    for (h, q), r in sites.items():
        mine, theirs = [p for a, b, p in rows if (a, b) == (h, q)], [p for a, _, p in rows if a == h]
        assert (r.n, r.host_n) == (len(mine), len(theirs)) and r.s == pytest.approx(sum(mine)) and r.host_s == pytest.approx(sum(theirs))
        p = mine[0]
        host = (sum(theirs) - p + r.kappa * rate) / (len(theirs) - 1 + r.kappa)
        site = (sum(mine) - p + under * host) / (len(mine) - 1 + under)
        odds = p / (1 - p) * site / (1 - site) * (1 - rate) / rate
        one = spark.createDataFrame([(r.n, r.s, r.host_n, r.host_s, r.kappa, p)], "n long, s double, host_n long, host_s double, kappa double, p double")
        got = one.select(Q.posterior(F.struct("n", "s", "host_n", "host_s", "kappa"), F.col("p"), rate, under)).first()[0]
        assert got == pytest.approx(odds / (1 + odds))


def test_a_bad_site_weighs_on_its_documents_and_small_sites_stay_near_the_rate(spark):
    groups = [(100, 30.0, 0.1), (100, 5.0, 0.1), (100, 4.0, 0.1), (100, 3.0, 0.1)]
    kappa = Q.strength(spark.createDataFrame(groups, "n long, s double, parent double"), least=0.0)
    assert 0 < kappa < 20
    same = [(100, 10.0, 0.1)] * 5
    assert Q.strength(spark.createDataFrame(same, "n long, s double, parent double")) == 1e4


def test_odd_rows_and_no_labels(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for table in (labels, labels.limit(0)):
        for f in (toxicity, Q.quality):
            got = f(odd(spark), table).collect()
            assert sorted((r.doc_id for r in got), key=str) == sorted((k for k, _ in ODD), key=str)
            assert f(odd(spark).limit(0), table).count() == 0
    kept = without_toxic(odd(spark), labels.limit(0))
    assert kept.columns == odd(spark).columns and kept.count() == len(ODD)
    assert Q.without_poor(odd(spark), labels.limit(0)).count() == len(ODD)


def test_newton_steps_reach_the_minimum():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(500, 3))
    y = (draw.random(500) < sigmoid(x @ [2.0, -1.0, 0.0] + 0.5)).astype(float)
    w = fit(x, y, decay=0.0)
    assert np.abs(np.hstack([x, np.ones((500, 1))]).T @ (sigmoid(x @ w[:3] + w[3]) - y)).max() < 1e-4


def test_a_task_holds_the_work_arrays_of_a_few_texts():
    words = [f"word{i * 7919 % 50021:x}" for i in range(50_000)]
    texts = [" ".join(words[k * 37 % 40_000 :][:500]) for k in range(800)]
    judged = {c: pa.array([1] * len(texts), pa.int32()) for c in ("low_quality", "toxic")}
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts, **judged})
    tracemalloc.start()
    try:
        assert sum(1 for _ in _tallied(list(judged))(iter([batch])))
        assert tracemalloc.get_traced_memory()[1] < 40e6  # 3.6 MB of texts; runs of 1 MB took 73 MB
    finally:
        tracemalloc.stop()
