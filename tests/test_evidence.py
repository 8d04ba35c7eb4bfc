import random
import re

import pytest
from pyspark.sql import functions as F

from marklake.functions.matching import FUZZY_RATIO, Spelling, ratio, word_edits, word_error_rate, words_around
from marklake.functions.phrases import Scheme, densest_window, fold_all
from marklake.operators import evidence as E
from marklake.operators import marks as M
from plain_matching import Answer, fold, numeric_evidence, phrase_evidence
from tests_support import SCHEME, SCHEMES, vp

ANSWERS = [
    (1, "r", "The liquid metal is mercury.", 1.0),
    (2, "r", "It is Hg, of course.", 1.0),
    (3, "r", "Iron melts only in a furnace.", 0.0),
    (4, "g", "Copper makes electric wires, water pipes and coins.", 3.0),
    (5, "g", "It is found in coins.", 1.5),
    (6, "g", "Copper is a reddish metal.", 0.0),
    (7, "n", "3y + 1 = 13, so 3y = 12. Then y = 12/3, so y = 4.", 3.0),
    (8, "n", "3y + 1 = 13 gives 3y = 12 and y = 12/3, therefore y = 5.", 2.0),
    (9, "n", "", 0.0),
    (10, "d", "Strong muscles move the wings; hollow bones keep it light and air gives lift.", 4.0),
    (11, "d", "Wings give an upward push.", 2.0),
    (12, "d", "Birds are animals with feathers.", 0.0),
]


@pytest.fixture(scope="module")
def frames(spark):
    answers = spark.createDataFrame([a[:3] for a in ANSWERS], "answer_id bigint, question_id string, answer_text string")
    return answers, spark.createDataFrame(SCHEMES, SCHEME)


def test_twelve_marks_end_to_end(frames):
    answers, schemes = frames
    got = {r.answer_id: r.total for r in M.score_answers(answers, E.scheme_rows(schemes), E.text_evidence(answers, schemes)).collect()}
    assert got == {a[0]: a[3] for a in ANSWERS}


def test_evidence_points_into_the_original_text(frames):
    answers, schemes = frames
    rows = E.text_evidence(answers, schemes).join(answers, ["answer_id", "question_id"]).filter("matched").collect()
    assert rows
    for r in rows:
        assert 0 <= r.span_start < r.span_end <= len(r.answer_text)


def test_derivation_names_cap_and_quotes(frames):
    answers, schemes = frames
    points = M.join_evidence(answers, E.scheme_rows(schemes), E.text_evidence(answers, schemes))
    got = {r.answer_id: r.derivation for r in M.derivations(points, M.question_marks(points, ["answer_id", "question_id"]), answers).collect()}
    assert "ANY 2 OF 3 (group u): 3 matched, best 2 counted = 3" in got[4]
    assert "matched, but outside the best 2 for this group" in got[4]
    assert '"mercury"' in got[1] and "TOTAL: 1 / 1" in got[1]
    assert "TOTAL: 0 / 3" in got[9]
    cut = {r.answer_id: r.derivation for r in M.derivations(points, M.question_marks(points, ["answer_id", "question_id"]), answers, 6, 4).collect()}
    assert "electric wires" in got[4] and "electric wires" not in cut[4] and '"mer..."' in cut[1]


def test_probes_report_known_weakness(frames):
    got = {(r.question_id, r.kind): r for r in E.run_probes(frames[1]).collect()}
    assert len(got) == 36
    assert got[("r", "NEGATED")].scored == 1.0 and not got[("r", "NEGATED")].passed  # presence, not assertion
    for q in "rgnd":
        assert got[(q, "BLANK")].passed and got[(q, "CORRECT_CONTROL")].passed and got[(q, "OFF_TOPIC_SAME_SUBJECT")].passed


def test_numeric_without_value_stops(spark, frames):
    bad = spark.createDataFrame([("r", "1", "q", 1.0, [vp("x", "y = 1", mode="NUMERIC")])], SCHEME)
    with pytest.raises(Exception, match="expected_value"):
        E.text_evidence(frames[0], bad).collect()


def test_fold_keeps_offsets():
    text = "  Çafé—NOIR,\n x²"
    folded, source = fold(text)
    assert folded == "cafe noir x2"
    assert text[source[folded.index("noir")]] == "N" and len(source) == len(folded)


def test_run_together_words_match():
    answer = "It needs cellularenergy now"
    span, _ = phrase_evidence(Answer(answer), "cellular energy", ())
    assert answer[span[0] : span[1]] == "cellularenergy"


def test_numeric_rules():
    assert numeric_evidence("2x = 15 - 5, x = 7", "x = 5", 5.0, 0.0, None) is None
    assert numeric_evidence("2x = 5", "x = 5", 5.0, 0.0, None) is not None  # no left boundary, kept on purpose
    assert numeric_evidence("g is 9.8 m/s", "g", 9.81, 0.05, "m/s") is not None
    assert numeric_evidence("g is 9.8 kg", "g", 9.81, 0.05, "m/s") is None


def brute_window(hits, limit):
    best, span = 0, None
    for i in range(len(hits)):
        for j in range(i, len(hits)):
            if hits[j][1] - hits[i][0] <= limit:
                n = len({h[2] for h in hits[i : j + 1]})
                if n > best:
                    best, span = n, (hits[i][0], hits[j][1])
    return best, span


def test_window_equals_all_windows():
    rng = random.Random(5)
    for _ in range(400):
        at, hits = 0, []
        for _ in range(rng.randint(0, 12)):
            at += rng.randint(1, 30)
            word = rng.choice(["aa", "bbb", "cccc", "d" * 40])
            hits.append((at, at + len(word), word))
            at += len(word)
        limit = rng.randint(5, 90)
        assert densest_window(hits, limit) == brute_window(hits, limit)


def test_phrase_evidence_on_random_text():
    """A whole phrase is always found; words that are absent never are."""
    rng = random.Random(8)
    vocabulary = ["river", "stone", "light", "green", "winter", "cloud", "grass", "bread"]
    for _ in range(200):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 60))]
        at = rng.randrange(len(words) - 2)
        phrase = " ".join(words[at : at + 3])
        text = ", ".join(words).upper()
        span, reason = phrase_evidence(Answer(text), phrase, ())
        assert span and reason is None
        assert set(re.findall(r"\w+", text[span[0] : span[1]].lower())) >= set(phrase.split())
        assert phrase_evidence(Answer(text), "volcano lava ash", ())[0] is None


def test_scattered_words_are_not_evidence():
    text = "alpha " + "x" * 400 + " beta " + "y" * 400 + " gamma delta"
    span, reason = phrase_evidence(Answer(text), "alpha beta gamma epsilon zeta eta", ())
    assert span is None and reason == "evidence scattered - no single supporting passage"
    span, reason = phrase_evidence(Answer("only alpha here"), "alpha beta gamma delta epsilon zeta", ())
    assert span is None and reason.startswith("insufficient evidence: matched 1 of 3")


def test_small_helpers():
    assert ratio("photosynthesis", "photosynthesys") > 0.88
    assert word_error_rate("a b c d", "a x c") == 0.5 and word_error_rate("", "") == 0.0 and word_error_rate("", "a") == 1.0
    assert words_around("one two three four five", 8, 13) == "three four"


def test_semantic_needs_vectors(spark):
    s = spark.createDataFrame([(1, "q", 0, 5, [1.0, 0.0]), (1, "q", 6, 9, [0.6, 0.8])], "answer_id bigint, question_id string, start int, end int, embedding array<double>")
    good = spark.createDataFrame([("q", "v", [0.0, 1.0])], "question_id string, value_point_id string, embedding array<double>")
    row = E.semantic_evidence(s, good, s.select("answer_id", "question_id").distinct()).first()
    assert row.matched and (row.span_start, row.span_end) == (6, 9) and row.score == 0.8 and row.uncalibrated
    none = good.withColumn("embedding", F.lit(None).cast("array<double>"))
    with pytest.raises(Exception, match="needs a vector"):
        E.semantic_evidence(s, none, s.select("answer_id", "question_id").distinct()).collect()


def test_semantic_evaluation_of_blank_texts(spark):
    rows = [(1, "", "key text here"), (2, "an answer text", " "), (3, "short", "key text here")]
    a = spark.createDataFrame([(*r, [1.0, 0.0], [1.0, 0.0]) for r in rows], "answer_id bigint, answer_text string, reference_text string, answer_vector array<double>, reference_vector array<double>")
    sims = spark.createDataFrame([(i, 0, "c", 0.9) for i in (1, 2, 3)], "answer_id bigint, position int, concept string, similarity double")
    got = {r.answer_id: r for r in E.semantic_evaluation(a, sims).collect()}
    assert (got[1].semantic_confidence, got[1].missing_semantic_concepts) == (1.0, ["c"])
    assert (got[2].semantic_confidence, got[2].missing_semantic_concepts) == (0.5, [])
    assert (got[3].semantic_confidence, got[3].matched_semantic_concepts, got[3].semantic_similarity) == (0.75, ["c"], 1.0)


def spoken(rng):
    """Text with accents, ligatures, odd spaces and joined words."""
    parts = ["river", "Stone", "lïght", "GREEN", "winter", "ﬁeld", "café", "x²", "½", "—", "...", "İz", "straße", " ", "\t", "\u00a0", "_", "a", "9.8", "日本", "é"]
    return "".join(rng.choice(parts) + rng.choice([" ", "", ", ", "\n", "  "]) for _ in range(rng.randint(0, 60)))


def test_folding_equals_plain_python():
    rng = random.Random(11)
    texts = [spoken(rng) for _ in range(500)] + ["", " ", "…", "ﷺ x", "\u0301a", "  . "]
    for text, (folded, source) in zip(texts, fold_all(texts)):
        assert (folded, source.tolist()) == fold(text)


def test_schemes_equal_plain_python():
    rng = random.Random(12)
    for _ in range(300):
        text = spoken(rng)
        points = [{"text": spoken(rng)[: rng.randint(0, 40)], "acceptable_variants": [spoken(rng)[: rng.randint(0, 15)] for _ in range(rng.randint(0, 2))]} for _ in range(6)]
        points += [{"text": text[3:40]}, {"text": " ".join(text.split()[:3])}, {"text": ""}]
        ((folded, source),) = fold_all([text])
        answer = Answer(text)
        assert Scheme(points).answered(text, folded, source) == [phrase_evidence(answer, p["text"], p.get("acceptable_variants")) for p in points]


def test_numbers_equal_plain_python(spark):
    rng = random.Random(13)
    pieces = ["x = ", "2x=", "X  =\u00a0", "y", " 5", "-5.5", "4.99", "٥", " m/s", "M/S", " µm", " kg", "\n", "\\E.", "1.2.3", "7", "(a) = 5", "  "]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(120)] + [None, ""]
    points = [vp(f"p{i}", t, mode="NUMERIC", value=v, tol=tol, unit=u) for i, (t, v, tol, u) in enumerate([
        ("x = 5", 5.0, None, None), ("y=5", 5.0, 1.0, ""), ("count", 5.0, 0.5, None), ("speed", 5.0, 2.5, "m/s"), ("len", 5.0, 3.0, "μm"),
        ("\\E. = 7", 7.0, 0.0, None), ("(a) = 5", 5.0, 0.0, None), (" = 5", 5.0, 0.0, "k g"),
    ])]
    schemes = spark.createDataFrame([("q", "1", "?", 1.0, points)], SCHEME)
    answers = spark.createDataFrame([(i, "q", t) for i, t in enumerate(texts)], "answer_id bigint, question_id string, answer_text string")
    got = {(r.answer_id, r.value_point_id): (r.span_start, r.span_end) if r.matched else None for r in E.text_evidence(answers, schemes).collect()}
    want = {(i, p[0]): numeric_evidence(t or "", p[1], p[8], p[9], p[10]) for i, t in enumerate(texts) for p in points}
    assert got == want and sum(v is not None for v in want.values()) > 60


def test_word_edits_equal_the_table():
    rng = random.Random(14)
    for _ in range(300):
        ref, hyp = (rng.choices("abcde", k=rng.randint(0, 90)) for _ in range(2))
        row = list(range(len(hyp) + 1))
        for i, word in enumerate(ref, 1):
            corner, row[0] = row[0], i
            for j, other in enumerate(hyp, 1):
                corner, row[j] = row[j], corner if word == other else 1 + min(corner, row[j], row[j - 1])
        assert word_edits(ref, hyp) == row[-1]


def test_possible_words_hold_all_near_ones():
    rng = random.Random(15)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(0, 12))) for _ in range(150)] + ["a" * 300, "a" * 299 + "b", "b" * 300]
    words += [w[:3] + rng.choice("xy") + w[3:] for w in words]
    spelling = Spelling()
    numbers = spelling.number(words)
    possible = spelling.possible(numbers, numbers)
    near = [[ratio(a, b) >= FUZZY_RATIO for b in words] for a in words]
    assert all(not near[i][j] or possible[i][j] or not words[i] for i in range(len(words)) for j in range(len(words)))
    assert possible.sum() < 3 * sum(map(sum, near))


def test_concepts_of_a_question_meet_its_answers_in_parts_without_pairs(spark, monkeypatch):
    monkeypatch.setattr(E, "ANSWERS_AT_ONCE", 3)
    rng = random.Random(17)
    vector = lambda: [rng.uniform(-1, 1) for _ in range(3)]
    kinds = "answer_id bigint, question_id string, answer_text string, reference_text string, answer_vector array<double>, reference_vector array<double>, segments array<array<double>>"
    rows = [(i, rng.choice(["q", "r", "s", None]), rng.choice(["", "a text to be read"]), rng.choice([" ", "key text here"]), vector(), vector(), [vector() for _ in range(rng.randint(0, 3))]) for i in range(40)]
    a = spark.createDataFrame(rows, kinds)
    points = [(q, i, f"{q}{i}", vector() if i else [0.0, 0.0, 0.0]) for q in "qr" for i in (10, 9, 0, 1)]
    c = spark.createDataFrame(points, "question_id string, position int, concept string, embedding array<double>")
    pairs = a.select("answer_id", "question_id").join(c, "question_id")
    want = E.semantic_evaluation(a, E.concept_similarity(pairs, a.select("answer_id", F.explode("segments").alias("embedding"))))
    got = E.semantic_evaluation_by_question(a, c)
    assert sorted(got.collect()) == sorted(want.collect())
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString().split("FlatMapCoGroupsInArrow")[0]


def test_matching_holds_the_values_of_some_rows():
    import json
    import tracemalloc

    import pyarrow as pa

    points = json.dumps([{"id": f"v{k}", "text": f"word{k} other{k}", "acceptable_variants": [], "match_mode": "EXACT"} for k in range(30)])
    text = " ".join(f"word{k} other{k}" for k in range(0, 60, 2)) + " filling" * 60
    none = pa.array([[]], pa.list_(pa.struct([("id", pa.string()), ("unit", pa.string()), ("spans", pa.list_(pa.string()))])))

    def batch(n):
        columns = [pa.array(range(n)), pa.array(["q"] * n), pa.array([text] * n), pa.array([points] * n), none.take(pa.array([0] * n))]
        return pa.RecordBatch.from_arrays(columns, names=["answer_id", "question_id", "answer_text", "points", "numbers"])

    run = E._matched(False)
    assert sum(out.num_rows for out in run(iter([batch(3)]))) == 90
    tracemalloc.start()
    try:
        assert sum(out.num_rows for out in run(iter([batch(3000)]))) == 90_000
        assert tracemalloc.get_traced_memory()[1] < 45e6
    finally:
        tracemalloc.stop()
