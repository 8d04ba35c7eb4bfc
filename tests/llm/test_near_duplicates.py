"""The similarity join against brute force over all pairs."""

import random
import re

from marklake.llm.near_duplicates import LEVELS, LOSS, TOKENS, apart, loss, near_duplicates, rate, trees_for

SCHEMA = "doc_id long, text string, s string, node long"


def brute(rows, width, percent):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least.setdefault(find(i), []).append(k)
    return sorted(((k, len(sets[i]), min((x for x in least[find(i)] if x is not None), default=None)) for i, (k, _) in enumerate(rows)), key=str)


def found(spark, rows, width, percent):
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], SCHEMA)
    out = near_duplicates(df, width, percent).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str)


def test_random_copies_and_edges_of_the_threshold(spark):
    draw = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows, base = [], []
    for i in range(260):
        if base and draw.random() < 0.75:
            w = list(draw.choice(base[-12:]))
            for _ in range(draw.randint(0, 6)):
                w[draw.randrange(len(w))] = draw.choice(words)
        else:
            w = draw.choices(words, k=draw.randint(1, 140))
            base.append(w)
        rows.append((1000 - i, (" " if i % 2 else "\n").join(w).upper() if i % 3 else "  ".join(w)))
    rows += [(2, None), (3, ""), (4, " \t\n"), (None, "a b"), (5, "A  b"), (6, "a b c"), (7, "a b"), (1000, rows[0][1])]
    for width, percent in ((3, 85), (5, 80)):
        assert found(spark, rows, width, percent) == brute(rows, width, percent)


def test_a_large_group_of_near_copies_is_one_component(spark):
    draw = random.Random(6)
    base = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(160):  # about 0.85 between two copies: many pairs fall just short
        w = list(base)
        for _ in range(2):
            w[draw.randrange(120)] = f"x{draw.random()}"
        rows.append((i, " ".join(w)))
    assert found(spark, rows, 3, 85) == brute(rows, 3, 85)


def test_short_texts_that_share_a_passage_are_told_apart(spark):
    draw = random.Random(7)
    rows = [(i, "all these words are common to every text here " * 3 + " ".join(f"u{draw.randrange(10**6)}" for _ in range(8))) for i in range(150)]
    rows += [(1000 + i, t.replace("u", "u", 1)) for i, t in rows[:20]]
    assert found(spark, rows, 3, 85) == brute(rows, 3, 85)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert found(spark, rows, 3, 85) == brute(rows, 3, 85)


def test_trees_follow_the_threshold():
    draw = random.Random(3)

    def shared(agree):
        nodes = int(draw.random() < agree)
        for k in LEVELS[1:]:
            many = [int(rate(80, k)) + (draw.random() < rate(80, k) % 1) for _ in range(nodes)]
            nodes = min(sum(draw.random() < agree**k for n in many for _ in range(n)), 50)
        return nodes

    lost = 0
    for _ in range(2000):  # a simulation of pairs at 80 % whose nodes are large to the end
        agree = sum(draw.random() < 0.8 for _ in range(TOKENS)) / TOKENS
        lost += not any(shared(agree) for _ in range(4))
    assert abs(loss(80, 4) - lost / 2000) < 0.03
    for percent in range(70, 101):
        assert loss(percent, trees_for(percent)) <= LOSS


def family(draw, n, pairs, common, own):
    """Texts of single-word shingles just under a similarity, and how many of them have a partner exactly at it."""
    shared = [f"c{i}" for i in range(common)]
    texts = [[f"u{i}_{j}" for j in range(own)] for i in range(n)]
    for i in range(pairs):
        texts[2 * i + 1][0] = texts[2 * i][0]
    rows = [(i, " ".join(draw.sample(shared + t, common + own))) for i, t in enumerate(texts)]
    draw.shuffle(rows)
    return rows


def test_pairs_at_the_threshold_in_a_family_just_under_it_with_small_nodes_branched(spark):
    draw = random.Random(9)
    rows = family(draw, 400, 150, 71, 10)  # 72 of 90 words in a pair, 71 of 91 between others
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df, 1, 80, small=64, group_sets=100).collect()), key=str)
    want = brute(rows, 1, 80)
    assert set(got) - set(want) <= {(k, n, k) for k, n, _ in got}  # a link may be missed, none is made up
    assert len(set(want) - set(got)) <= 0.04 * 150


def test_the_sketch_follows_the_threshold(spark):
    assert apart(100) == 0 and apart(85) < apart(80) < 48
    rows = family(random.Random(10), 120, 60, 0, 60)
    for i, (k, t) in enumerate(rows):  # 40 of 80 words in a pair, none between others
        w = t.split()
        rows[i] = (k, " ".join([f"p{k // 2}_{j}" for j in range(40)] + [x for x in w if not x.endswith("_0")][:20]))
    assert found(spark, rows, 1, 50) == brute(rows, 1, 50)


def test_very_long_texts_and_groups_node_by_node(spark):
    draw = random.Random(12)
    base = [f"z{i}" for i in range(30_000)]
    rows = [(i, " ".join(base[: 29_000 + 500 * i])) for i in range(3)] + [(9, " ".join(draw.sample(base, 20_000)))]
    for i in range(60):
        w = [f"y{j}" for j in range(200)]
        w[draw.randrange(200)] = f"x{i}"
        rows.append((100 + i, " ".join(w)))
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df, 3, 85, small=16, group_sets=10).collect()), key=str)
    assert got == brute(rows, 3, 85)


def test_recall_in_a_family_of_thousands_just_under_the_threshold(spark):
    draw = random.Random(13)
    rows = family(draw, 3000, 300, 63, 10)  # 64 of 82 words in a pair, 63 of 83 between others
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], SCHEMA)
    got = {r.doc_id: r.component_id for r in near_duplicates(df, 1, 78, small=256).collect()}
    assert all(got[2 * i] == got[2 * i + 1] == 2 * i or got[2 * i] == 2 * i for i in range(300))
    assert sum(got[2 * i] == got[2 * i + 1] for i in range(300)) >= 0.9 * 300
    assert all(got[i] == i for i in range(600, 3000))


def exact(spark, rows, width, percent, **limits):
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df, width, percent, **limits).collect()), key=str)
    assert got == brute(rows, width, percent)


def test_no_pair_is_lost_in_a_family_whose_nodes_stay_large(spark):
    exact(spark, family(random.Random(21), 500, 200, 71, 10), 1, 80, small=16, group_sets=64)


def test_a_row_like_its_centre_keeps_its_links_to_rows_that_are_not(spark):
    draw = random.Random(22)
    base = [f"c{i}" for i in range(100)]
    copies = [[*base, f"k{i}"] for i in range(120)]  # linked with each other
    # 86 of the words of one copy and its own word: 87 of 101 with that one, 86 of 102 with the others
    ring = [[*draw.sample(base, 86), f"k{i}"] for i in range(0, 120, 4)]
    rows = [(i, " ".join(draw.sample(t, len(t)))) for i, t in enumerate(copies + ring)]
    exact(spark, rows, 1, 86, small=8, group_sets=32)


def test_one_of_each_keeps_no_row_that_is_linked_with_its_centre_s_copies(spark, monkeypatch):
    from marklake.llm import near_duplicates as N

    grouped = N._grouped
    monkeypatch.setattr(N, "_grouped", lambda docs, width, percent: grouped(docs, width, percent, 8, 32))
    draw = random.Random(23)
    base = [f"c{i}" for i in range(100)]
    texts = [[*base, f"k{i}"] for i in range(60)] + [[*draw.sample(base, 86), f"k{i}"] for i in range(0, 60, 4)]
    rows = [(i, " ".join(draw.sample(t, len(t)))) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], SCHEMA)
    want = sorted(k for k, _, least in brute(rows, 1, 86) if k == least)
    assert sorted(r.doc_id for r in N.one_of_each(df, 1, 86).collect()) == want


def apart_in_first_trees(draw, trees):
    """Copies that are linked with each other, and rows linked with one of them that share no node of the first trees with it."""
    import numpy as np
    from marklake.llm import near_duplicates as N

    base = [f"c{i}" for i in range(100)]
    h = np.concatenate([N._sets(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]), 1)[0] for w in base])
    least = {base[int((((h ^ N._FLIP[t]) * N._TIMES[t]) >> np.uint64(32)).argmin())] for t in range(trees)}
    copies = [[*base, f"k{i}"] for i in range(120)]
    others = [w for w in base if w not in least]
    ring = [[*draw.sample(others, 86), f"k{i}"] for i in range(0, 120, 4)]
    return [(i, " ".join(draw.sample(t, len(t)))) for i, t in enumerate(copies + ring)]


def test_a_link_is_found_in_the_large_nodes_of_any_tree(spark):
    exact(spark, apart_in_first_trees(random.Random(24), 4), 1, 86, small=8, group_sets=32)


def test_levels_below_the_first_read_the_sets_of_large_nodes_alone(spark):
    from marklake.llm.near_duplicates import _Join

    draw = random.Random(25)
    rows = family(draw, 60, 0, 71, 10) + [(1000 + i, " ".join(f"s{i}_{j}" for j in range(20))) for i in range(300)]
    join = _Join(spark.createDataFrame([(k, t, "x", 1) for k, t in rows], SCHEMA), 1, 80, 16, 64, 1 << 22)
    join.edges()
    assert join.sets.count() == 360 and 0 < join.crowded.count() <= 60


def test_a_node_of_very_many_rows_is_dealt_over_tasks(spark, monkeypatch):
    from marklake.llm import near_duplicates as N

    monkeypatch.setattr(N, "SPLIT", 50)
    exact(spark, family(random.Random(26), 200, 60, 71, 10), 1, 80, small=16, group_sets=64)


def test_texts_are_not_shuffled_to_meet_few_keys(spark, monkeypatch):
    from marklake.llm import near_duplicates as N

    plans, stored = [], N.stored

    def kept(df, name):
        if name == "near-links":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, name)

    monkeypatch.setattr(N, "stored", kept)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        exact(spark, family(random.Random(27), 40, 10, 71, 10), 1, 80)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert plans and all("BroadcastHashJoin [k#" in p and "SortMergeJoin [k#" not in p for p in plans)
