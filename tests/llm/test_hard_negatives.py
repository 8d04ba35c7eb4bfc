"""Hard negatives against all pairs in plain numpy, and how much the ranges leave out."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from marklake.llm.hard_negatives import Space, Wanted, hard_negatives, products, search
from marklake.llm.queries import ORACLES, QUERIES

NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def plain(rows, every, positives=5, negatives=3, low=50, high=95):
    rows = {i: (label, np.array(v, object)) for i, label, v in sorted(rows, key=lambda r: (r[0], -r[1], [-x for x in r[2]]))}
    out = []
    for a in (i for i in rows if i % every == 0):
        score = {i: int(v @ rows[a][1]) for i, (_, v) in rows.items() if i != a}
        first = sorted((-s, i) for i, s in score.items() if rows[i][0] == rows[a][0])[:positives]
        for p, i in first:
            fits = sorted((-s, j) for j, s in score.items() if rows[j][0] != rows[a][0] and low * -p <= 100 * s <= high * -p)[:negatives]
            out += [(a, i, k + 1, j, -p, -s) for k, (s, j) in enumerate(fits)]
    return sorted(out)


def got(df):
    return sorted(tuple(r[n] for n in NAMES) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 3, 4) for r in rows], "vec_id long, label long, v array<long>, point string, place int, window int").repartition(4)


def clustered(draw, n, length, centres=12):
    middle = draw.normal(0, 200, (centres, length))
    return np.floor(middle[draw.integers(0, centres, n)] + draw.normal(0, 25, (n, length))).astype(int)


def test_all_pairs_give_the_same(spark):
    draw = np.random.default_rng(2)
    v = clustered(draw, 700, 6)
    v[100:260] = v[100]  # copies, some of another label
    rows = [(int(i), int(draw.integers(0, 3)), v[i].tolist()) for i in range(700)]
    asked = F.col("vec_id") % 10 == 0
    want = plain(rows, 10)
    assert len(want) > 300
    assert got(hard_negatives(frame(spark, rows), asked, sample=200, many=4, leaf=8, block=40)) == want
    assert got(hard_negatives(frame(spark, rows), asked)) == want
    assert got(hard_negatives(frame(spark, rows), asked, 2, 7, 20, 100, sample=50, leaf=4, block=100)) == plain(rows, 10, 2, 7, 20, 100)


def test_odd_rows(spark):
    rows = [(0, 1, [3, 4]), (10, 1, [3, 4]), (20, 2, [0, 0]), (11, 1, [5, 5]), (12, 2, [2, 2]), (13, 2, [2, 2]), (14, 1, [-9, 1]), (15, 3, [3, 1]), (-10, 2, [1, 1])]
    odd = [(0, 1, [3, 4]), (None, 1, [1, 1]), (30, None, [1, 1]), (40, 1, None), (50, 1, [1, None]), (60, 1, []), (70, 1, [1, 2, 3]), (11, 2, [9, 9])]
    assert got(hard_negatives(frame(spark, rows + odd), F.col("vec_id") % 10 == 0)) == plain(rows, 10)
    assert got(hard_negatives(frame(spark, [(0, 1, [1])]), F.col("vec_id") % 10 == 0)) == []
    assert got(hard_negatives(frame(spark, []), F.col("vec_id") % 10 == 0)) == []
    big = [(0, 1, [2**27, 5]), (1, 1, [2**27 - 9, 2**10]), (2, 2, [2**26, 7]), (3, 2, [2**26, 8])]
    assert got(hard_negatives(frame(spark, big), F.col("vec_id") == 0)) == plain(big, 10)
    with pytest.raises(ValueError):
        products(np.array([[2**40]]), np.array([[2**40]]))


def test_ranges_leave_subtrees_out():
    draw = np.random.default_rng(4)
    v, labels = clustered(draw, 4000, 8, 40), draw.integers(0, 5, 4000)
    q = v[:200]
    space = Space(float((v.astype(float) ** 2).sum(1).max()))
    found, formed = search(space, v, np.arange(4000), labels, q, Wanted(labels[:200], np.full((200, 1), -(2**63)), np.full((200, 1), 2**62), 6, True), 8, 64)
    assert formed < 0.35 * q.shape[0] * v.shape[0]
    score = q @ v.T
    for i in range(200):
        mine = np.where(labels == labels[i], score[i], -(2**62))
        assert sorted(found[3][found[0] == i], reverse=True) == sorted(mine, reverse=True)[:6]


def test_given_vectors_and_their_sql(spark):
    path = "/root/testdata/sf0.01"
    want = duckdb.query_df(duckdb.sql(f"SELECT * FROM '{path}/embeddings.parquet'").df(), "embeddings", ORACLES["op13_gnat_negatives"])
    mine = got(QUERIES["op13_gnat_negatives"](spark, path))
    assert mine == sorted(want.project(", ".join(NAMES)).fetchall()) and mine
