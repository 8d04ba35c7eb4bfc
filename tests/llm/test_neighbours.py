"""The tree search against all inner products."""

import math

import numpy as np

from marklake.llm.neighbours import Tree, calibrate, nearest

SCHEMA = "vec_id long, embedding array<float>, leaf string, v int"


def frame(spark, rows):
    return spark.createDataFrame([(k, v, "x", 1) for k, v in rows], SCHEMA)


def brute(ids, x, every, k):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        score = np.array([math.fsum(a) for a in x * x[i]])
        order = np.lexsort((ids, -score))
        out[int(ids[i])] = [(int(ids[j]), score[j]) for j in order if ids[j] != ids[i]][:k]
    return out


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_recall_over_the_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    pdf = df.toPandas()
    ids, x = pdf.vec_id.to_numpy(), np.stack(pdf.embedding).astype(float)
    got, want = by_query(nearest(df).collect()), brute(ids, x, 20, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want) >= 0.9 * 20 * len(want)
    exact = {int(a): v for a, v in zip(ids, x)}
    for q, found in got.items():
        assert all(abs(s - float((exact[q] * exact[a]).sum())) < 1e-12 for a, s in found)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))


def test_rows_that_take_no_part_ties_and_repeats(spark):
    good = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (1, [-1.0, 0.0]), (20, [0.0, 0.5])]
    bad = [(40, None), (60, [0.0, 0.0]), (80, [1.0, None]), (100, [float("nan"), 1.0]), (120, [float("inf"), 1.0]), (140, []), (None, [1.0, 1.0]), (160, [1.0, 1.0, 1.0])]
    got = by_query(nearest(frame(spark, good + bad), k=3).collect())
    assert got == {0: [(2, 1.0), (3, 1.0), (20, 0.5)], 20: [(0, 0.0), (1, 0.0), (2, 0.0)]}
    assert [a for a, _ in by_query(nearest(frame(spark, good[:5])).collect())[0]] == [2, 3, 20, 1]
    assert nearest(frame(spark, [])).count() == 0 and nearest(frame(spark, bad)).count() == 0


def test_one_vector_in_most_rows_is_cut_into_blocks(spark):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(1, 900)] + [(0, [1.0, 0.1, 0.0])] + [(1000 + i, [0.0, 1.0, float(i)]) for i in range(1, 40)]
    got = by_query(nearest(frame(spark, rows), block=50).collect())
    assert [a for a, _ in got[0]] == list(range(1, 21))
    assert [a for a, _ in got[20]] == list(range(20))


def test_calibration_widens_with_the_recall_asked_for():
    x = np.random.default_rng(1).normal(size=(2000, 8))
    tree = Tree(x, float(np.sqrt((x * x).sum(1).max())), 8, 32)
    visits = [calibrate(tree, x, 20, r, 100) for r in (0.5, 0.9, 1.0)]
    assert visits == sorted(visits) and 0 < visits[0] < visits[2] <= len(tree.leaves)
    assert set(tree.assign(x)) <= set(range(len(tree.leaves)))
