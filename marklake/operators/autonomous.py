"""Scoring without an answer key, rubric scoring, and explanations."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marklake.functions import lexicon as X
from marklake.functions import text as TX
from marklake.functions.matching import Snippets, Spelling, some_rows
from marklake.functions.numeric import clamp, round_even, rounded
from marklake.schemas import EVIDENCE_ITEM, require

AUTO_PREFIX = "Coverage of expected concept: "


def _near_concepts(concepts: pa.Array, tokens: pa.Array) -> pa.Array:
    rows = [(w or [], t or []) for w, t in zip(concepts.to_pylist(), tokens.to_pylist())]
    asked, said = {c for w, t in rows if t for c in w}, {x for w, t in rows if w for x in t}
    spelling = Spelling()
    if len(asked) * len(said) <= 2 * sum(len(w) * len(t) for w, t in rows):  # rows share words: each pair once for all
        near = spelling.near(sorted(asked), sorted(said))
        out = [[c for c in wanted if c in near and not near[c].isdisjoint(have)] if have else [] for wanted, have in rows]
    else:
        out = []
        for wanted, have in rows:
            of = spelling.near(wanted, have) if wanted and have else {}
            out.append([c for c in wanted if c in of])
    return pa.array(out, pa.list_(pa.string()))


@F.arrow_udf(T.ArrayType(T.StringType()))
def fuzzy_present(concepts: pa.Array, tokens: pa.Array) -> pa.Array:
    """Concepts with a token of near-equal spelling (the only leg that needs Python)."""
    return pa.concat_arrays([_near_concepts(*some) for some in some_rows(concepts, tokens)])


def prepare_answers(answers: DataFrame) -> DataFrame:
    """Expected concepts of the question and terms of the sanitised answer.

    ``answers``: question_text, answer_text, subject, max_marks and any ids.
    """
    cleaned = TX.bind_columns(
        answers, sanitized=TX.sanitize(F.col("answer_text")), domain=TX.infer_domain(F.col("question_text"), F.col("subject"))
    )
    return TX.bind_columns(
        cleaned,
        expected=TX.expected_concepts(F.col("question_text"), F.col("domain")),
        terms=TX.keywords(F.col("sanitized")),
    )


def concept_coverage(prepared: DataFrame) -> DataFrame:
    """H5: found and missing concepts, coverage in percent.

    Substring, token and synonym tests run in the JVM; only concepts they leave
    open, for rows that have any, reach the fuzzy test.
    """
    prepared = TX.bind_columns(prepared, _low=F.lower("sanitized"))
    lowered = F.col("_low")

    def synonym(c: Column) -> Column:
        hits = [F.when(c == k, TX.contains_any(lowered, v)) for k, v in X.SYNONYMS.items()]
        return F.coalesce(*hits, F.lit(False))

    plain = F.filter("expected", lambda c: F.contains(lowered, c) | F.array_contains(F.col("terms"), c) | synonym(c))
    staged = TX.bind_columns(prepared, _plain=plain)
    open_ = F.array_except("expected", "_plain")
    staged = TX.bind_columns(staged, _open=open_, _tokens=F.when(F.size(open_) > 0, F.col("terms")))
    staged = staged.withColumn("_near", fuzzy_present("_open", "_tokens"))
    found = F.array_intersect("expected", F.array_union("_plain", "_near"))  # keeps the order of the expected ones
    staged = staged.withColumn("concepts_found", found).withColumn("concepts_missing", F.array_except("expected", "concepts_found"))
    share = F.when(F.size("expected") > 0, F.size("concepts_found") / F.size("expected") * 100.0).otherwise(0.0)
    return rounded(staged.withColumn("coverage_percentage", share), coverage_percentage=2).drop("_plain", "_open", "_tokens", "_near", "_low")


def score_autonomously(answers: DataFrame) -> DataFrame:
    """H20 with H5, H6, H21: marks, coverage, confidence and rubric rows per answer.

    Questions must give at least one expected concept, and marks must be positive.
    """
    valid = require(answers, F.trim(F.coalesce("question_text", F.lit(""))) != "", "question text is required")
    valid = require(valid, F.col("max_marks") > 0, "maximum marks must be greater than zero")
    prepared = require(prepare_answers(valid), F.size("expected") > 0, "no expected concepts in question text")
    covered = concept_coverage(prepared)
    depth = TX.expected_depth(F.col("max_marks"))
    n_words = F.size(TX.words(F.col("sanitized")))
    threshold = F.coalesce(*[F.when(F.col("expected_depth") == k, F.lit(v)) for k, v in X.DEPTH_WORDS.items()])
    negations = TX.let(
        F.lower("sanitized"), lambda low: F.size(F.filter(TX.strings(X.CONTRADICTION_TERMS), lambda t: F.contains(low, t)))
    )
    staged = (
        covered.withColumn("expected_depth", depth)
        .withColumn("difficulty", TX.difficulty(F.col("max_marks")))
        .withColumn("_sem", TX.lexical_alignment(F.col("expected"), F.col("terms")))
        .withColumn("_depth", F.least(F.lit(1.0), n_words / threshold))
        .withColumn("_penalty", F.when(negations >= 2, 0.15).otherwise(0.0))
        .withColumn("_cov", F.col("coverage_percentage") / 100.0)
    )
    staged = rounded(staged, _depth=2)
    base = F.col("_cov") * 0.60 + F.col("_sem") * 0.25 + F.col("_depth") * 0.15
    share = clamp(F.greatest(F.col("_cov"), base) - F.col("_penalty"))
    marks = F.rint(F.col("max_marks") * share * 2) / 2
    blank = F.col("sanitized") == ""
    staged = staged.withColumn("_marks", clamp(marks, F.lit(0.0), F.col("max_marks"))).withColumn(
        "_conf", (F.col("_sem") + F.col("_cov") + F.col("_depth")) / 3.0
    )
    staged = rounded(staged, _marks=2, _conf=2)
    found = F.when(blank, TX.no_strings()).otherwise(TX.filter_concepts(F.col("concepts_found")))
    missing = F.when(blank, F.col("expected")).otherwise(TX.filter_concepts(F.col("concepts_missing")))
    return (
        staged.withColumn("score_awarded", F.when(blank, 0.0).otherwise(F.col("_marks")))
        .withColumn("confidence", F.when(blank, 0.95).otherwise(F.col("_conf")))
        .withColumn("concept_coverage", F.when(blank, 0.0).otherwise(F.col("coverage_percentage")))
        .withColumn("semantic_alignment", F.col("_sem"))
        .withColumn("matched_keywords", found)
        .withColumn("missing_concepts", missing)
        .withColumn("rubric_points", concept_rubric(F.col("expected"), F.col("matched_keywords"), F.col("max_marks")))
        .withColumn(
            "criteria_feedback",
            F.when(blank, "No answer content was available for evaluation.").otherwise(
                F.format_string(
                    "Autonomous evaluation found %d covered concept(s) and %d missing concept(s).",
                    F.size("matched_keywords"),
                    F.size("missing_concepts"),
                )
            ),
        )
        .drop("_sem", "_depth", "_penalty", "_cov", "_marks", "_conf", "concepts_found", "concepts_missing", "coverage_percentage")
    )


def concept_rubric(expected: Column, found: Column, max_marks: Column) -> Column:
    """An even share per concept, all or nothing; the last takes the remainder."""
    n = F.size(expected)

    def last_share(each: Column) -> Column:
        spent = F.aggregate(F.array_repeat(each, n), F.lit(0.0), lambda acc, x: acc + x)
        rest = TX.let(max_marks - spent, lambda x: round_even(x, 2))
        return TX.let(each + rest, lambda x: round_even(x, 2))

    def points(s: Column) -> Column:
        return F.transform(expected, lambda concept, i: point(s, concept, i))

    def point(s: Column, concept: Column, i: Column) -> Column:
        share = F.when(i == n - 1, s["last"]).otherwise(s["each"])
        met = F.array_contains(s["found"], concept)
        return F.struct(
            F.concat(F.lit("auto_concept_"), (i + 1).cast("string")).alias("criterion_id"),
            F.concat(F.lit(AUTO_PREFIX), concept).alias("description"),
            share.alias("allocated_marks"),
            F.when(met, share).otherwise(0.0).alias("marks_awarded"),
            met.alias("met"),
        )

    each = TX.let(max_marks / n, lambda x: round_even(x, 2))
    bound = TX.let(each, lambda e: F.struct(e.alias("each"), last_share(e).alias("last")))
    return TX.let(F.struct(bound["each"].alias("each"), bound["last"].alias("last"), found.alias("found")), points)


def generate_rubrics(questions: DataFrame, limit: int | None = None, shortest: int = 1) -> DataFrame:
    """(…, max_score, criteria) from question_text and answer_key. Run on questions, not answers.

    All criteria of at least `shortest` characters, or the first `limit` of them.
    """
    staged = questions.withColumn("max_score", F.coalesce(TX.marks_in_prompt(F.col("question_text")), F.lit(5.0))).withColumn(
        "_items", TX.rubric_descriptions(F.col("answer_key"), limit, shortest)
    )

    def listed(s: Column) -> Column:
        return F.transform(
            s["items"],
            lambda d, i: F.struct(
                F.concat(F.lit("crit_"), (i + 1).cast("string")).alias("criterion_id"),
                d.alias("description"),
                F.get(s["marks"], i).alias("allocated_marks"),
            ),
        )

    shares = TX.split_evenly(F.size("_items"), F.col("max_score"))
    criteria = TX.let(F.struct(F.col("_items").alias("items"), shares.alias("marks")), listed)
    return staged.withColumn("criteria", criteria).drop("_items")


def score_with_rubric(answers: DataFrame, rubrics: DataFrame, keys: list[str]) -> DataFrame:
    """Rubric rows and the score per answer; rubrics join by question_id."""

    def point(c: Column, text: Column) -> Column:
        ratio = F.greatest(TX.keyword_ratio(c["description"], text), TX.phrase_coverage(c["description"], text))
        return TX.let(ratio, lambda r: credited(c, r))

    def credited(c: Column, ratio: Column) -> Column:
        awarded = TX.partial_credit(c["allocated_marks"], ratio)
        return F.struct(
            c["criterion_id"].alias("criterion_id"),
            c["description"].alias("description"),
            c["allocated_marks"].alias("allocated_marks"),
            awarded.alias("marks_awarded"),
            TX.criterion_met(c["allocated_marks"], awarded, ratio).alias("met"),
        )

    points = TX.let(F.lower("answer_text"), lambda low: F.transform("criteria", lambda c: point(c, low)))
    staged = answers.join(rubrics, "question_id").withColumn("rubric_points", points)
    total = F.aggregate("rubric_points", F.lit(0.0), lambda acc, p: acc + p["marks_awarded"])
    scored = staged.withColumn("score_awarded", F.least(total, F.col("max_score")))
    return rounded(scored, score_awarded=2).select(*keys, "score_awarded", F.col("max_score").alias("max_marks"), "rubric_points")


# --- OR questions -------------------------------------------------------------------------


def choose_alternatives(answers: DataFrame) -> DataFrame:
    """The alternative of an OR question that an answer fits best; the first on ties.

    ``answers``: question_key, question_text, alternatives (label, text; empty for a
    plain question), answer_text.
    """
    scored = F.transform(
        "alternatives",
        lambda a, i: F.struct(
            TX.keyword_overlap(a["text"], F.col("answer_text")).alias("score"), (-i).alias("rank"), a["label"].alias("label"), a["text"].alias("text")
        ),
    )
    staged = answers.withColumn("_best", F.array_max(scored))
    plain = F.size("alternatives") == 0
    return staged.select(
        *answers.columns,
        F.when(plain, F.col("question_text")).otherwise(F.col("_best.text")).alias("resolved_text"),
        F.when(plain, F.col("question_key")).otherwise(F.col("_best.label")).alias("chosen_label"),
        F.when(plain, 1.0).otherwise(F.col("_best.score")).alias("match_score"),
    )


def option_letters(i: Column) -> Column:
    """A to Z, then AA, AB and so on, for alternatives numbered from 0."""
    letter = lambda n: F.char(F.lit(65) + n % 26)
    two, three = F.floor(i / 26) - 1, F.floor((F.floor(i / 26) - 1) / 26) - 1
    return F.concat(
        F.when(three >= 0, letter(three)).otherwise(""), F.when(two >= 0, letter(two)).otherwise(""), letter(i)
    )


def or_alternatives(questions: DataFrame) -> DataFrame:
    """Attach the alternatives of OR questions (empty for the others)."""
    rebuilt = F.regexp_replace("question_text", "(?i) OR ", "\nOR\n")
    split_source = F.when(F.contains(F.upper(rebuilt), F.lit("\nOR\n")), rebuilt).otherwise(F.col("question_text"))
    staged = questions.withColumn("_or", TX.has_or_structure(F.col("question_text")) | TX.has_or_structure(rebuilt)).withColumn(
        "_parts", TX.split_alternatives(split_source)
    )
    item = F.transform(
        "_parts",
        lambda p, i: F.struct(
            F.concat(F.col("question_key"), F.lit("_opt"), option_letters(i)).alias("label"), p.alias("text")
        ),
    )
    none = F.array().cast("array<struct<label:string,text:string>>")
    return staged.withColumn("alternatives", F.when(F.col("_or") & (F.size("_parts") >= 2), item).otherwise(none)).drop("_or", "_parts")


_BOUNDARY = r"(?iU)\b(?:Q|Question)\s*\.?\s*(\d+)\b|(?:^|\s)(\d+)[.\\)]\s+"


def parse_questions(papers: DataFrame) -> DataFrame:
    """Questions of a paper given as one text: paper_id, paper_text, total_marks.

    Boundaries split the text; marks come from the question or are an even share.
    A number that appears twice keeps its place and takes the later text.
    """
    whole = papers.withColumn("_t", TX.collapse(F.col("paper_text")))
    marked = F.regexp_replace("_t", _BOUNDARY, "\u0001$0")
    staged = whole.withColumn("_p", F.split(marked, "\u0001"))
    exploded = staged.select("paper_id", "total_marks", "_t", F.size("_p").alias("_n"), F.posexplode("_p").alias("_i", "_piece"))
    number = F.coalesce(
        F.nullif(F.regexp_extract("_piece", _BOUNDARY, 1), F.lit("")), F.nullif(F.regexp_extract("_piece", _BOUNDARY, 2), F.lit(""))
    )
    single = F.col("_n") == 1
    rows = exploded.filter(single | (F.col("_i") > 0)).select(
        "paper_id",
        "total_marks",
        F.col("_i").alias("position"),
        F.when(single, "question_1").otherwise(F.concat(F.lit("question_"), number)).alias("question_key"),
        F.trim(F.when(single, F.col("_t")).otherwise(F.col("_piece"))).alias("question_text"),
    )
    kept = rows.groupBy("paper_id", "question_key").agg(
        F.min("position").alias("position"), F.max("total_marks").alias("total_marks"), F.max_by("question_text", "position").alias("question_text")
    )
    counts = kept.groupBy("paper_id").agg(F.count(F.lit(1)).alias("_n"))
    share = kept.join(counts, "paper_id").withColumn("_share", F.col("total_marks") / F.col("_n"))
    out = rounded(share, _share=2).withColumn("marks", F.coalesce(TX.marks_in_text(F.col("question_text")), F.col("_share")))
    return or_alternatives(out.select("paper_id", "question_key", "position", "question_text", "marks"))


# --- explanations ------------------------------------------------------------------------------

_ITEM = pa.list_(pa.struct([("concept", pa.string()), ("matched_text", pa.string()), ("confidence", pa.float64())]))


def _snippets(answer: pa.Array, concepts: pa.Array, criteria: pa.Array, confidence: pa.Array) -> pa.Array:
    out, spelling = [], Spelling()
    for text, wanted, terms, base in zip(*(a.to_pylist() for a in (answer, concepts, criteria, confidence))):
        found: dict[str, dict] = {}
        if (text or "").strip():
            finder = Snippets(text, X.SYNONYMS, spelling)

            def keep(term: str) -> bool:
                snippet, sure = finder.find(term, base)
                if snippet:
                    found.setdefault(term, {"concept": term, "matched_text": snippet, "confidence": round(sure, 2)})
                return bool(snippet)

            for concept in wanted or ():
                keep(concept)
            for options in terms or ():
                any(keep(t) for t in options)
        out.append(list(found.values()))
    return pa.array(out, _ITEM)


@F.arrow_udf(T.ArrayType(EVIDENCE_ITEM))
def evidence_snippets(answer: pa.Array, concepts: pa.Array, criteria: pa.Array, confidence: pa.Array) -> pa.Array:
    """One snippet per matched concept, one per met criterion (its first term found), keep-first."""
    return pa.concat_arrays([_snippets(*some) for some in some_rows(answer, concepts, criteria, confidence)])


def explain(evaluations: DataFrame) -> DataFrame:
    """Add the explainability struct.

    ``evaluations``: answer_text, rubric_points, matched_keywords, missing_concepts,
    confidence. Texts and percentages are expressions; snippets are found per row.
    """
    matched = F.coalesce("matched_keywords", TX.no_strings())
    missing = F.coalesce("missing_concepts", TX.no_strings())
    met = F.filter("rubric_points", lambda p: p["met"])
    terms = F.transform(met, lambda p: TX.key_terms(p["description"], X.EVIDENCE_COMMON_WORDS))
    normal = F.filter(F.transform(matched, TX.normalize_concept), lambda c: c != "")
    bare = lambda p: F.lower(F.regexp_replace(TX.strip(p["description"]), r"(?i)^Coverage of expected concept:\s*", ""))
    described = TX.let(
        F.transform(matched, lambda c: F.lower(c)),
        lambda known: F.filter(F.transform(met, bare), lambda t: (t != "") & ~F.array_contains(known, t)),
    )
    said = F.concat(
        F.transform(matched, lambda c: F.concat(F.lit("Student correctly identified "), c, F.lit(" as a key factor."))),
        F.transform(described, lambda t: F.concat(F.lit("Student explained "), t, F.lit(" involvement."))),
    )
    reasoning = TX.let(
        said,
        lambda all_: TX.let(
            F.transform(all_, lambda t: F.lower(t)),
            lambda low: F.filter(all_, lambda t, i: F.array_position(low, F.lower(t)) == i + 1),
        ),
    )
    total = F.size(matched) + F.size(missing)
    coverage = F.when(total > 0, F.size(matched) / total * 100.0).otherwise(0.0)
    bound = TX.bind_columns(evaluations, _wanted=normal, _terms=terms, _base=F.col("confidence"), _said=F.col("answer_text"))
    staged = (
        bound.withColumn("_evidence", evidence_snippets("_said", "_wanted", "_terms", "_base"))
        .withColumn("_reasoning", reasoning)
        .withColumn("_not", F.transform(missing, lambda c: F.concat(TX.title_words(c), F.lit(" was not discussed."))))
        .withColumn("_coverage", coverage)
    )
    return rounded(staged, _coverage=2).withColumn(
        "explainability",
        F.struct(
            F.col("_coverage").alias("coverage_percentage"),
            F.col("_evidence").alias("evidence"),
            F.col("_reasoning").alias("reasoning"),
            F.col("_not").alias("missing_reasoning"),
        ),
    ).drop("_wanted", "_terms", "_base", "_said", "_evidence", "_reasoning", "_not", "_coverage")
