"""Text expressions.

All are Column -> Column and stay inside the JVM. Word boundaries follow Unicode,
so patterns carry the (?U) flag or name their character classes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marklake.functions import lexicon as X
from marklake.functions.numeric import round_even

WORD = r"[\p{L}\p{N}_]+"


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else no_strings()


def no_strings() -> Column:
    return F.array().cast("array<string>")


def let(value: Column, body) -> Column:
    """Name a costly value once inside an expression: body(value).

    A column made by withColumn and read inside a lambda is no substitute: the
    optimizer may move its expression into the lambda, to run once per element.
    """
    return F.transform(F.array(value), body)[0]


def bind_columns(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later steps see as plain attributes.

    withColumn alone lets the optimizer copy an expression into its readers, even into
    a lambda or the arguments of a Python function. The output of a generator is not
    copied; here it yields exactly one row per input row.
    """
    packed = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return df.select("*", F.inline(packed))


def collapse(text: Column) -> Column:
    """All whitespace runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"))


def contains_any(text: Column, needles) -> Column:
    """True when any plain needle occurs; one pass over the text."""
    quoted = "|".join(_quote(n) for n in needles)
    return F.rlike(text, F.lit(quoted))


def _quote(text: str) -> str:
    return "".join("\\" + c if not (c.isalnum() or c == " ") else c for c in text)


def capitalize(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substr(word, F.lit(2))))


def title_words(text: Column) -> Column:
    return F.array_join(F.transform(F.filter(F.split(text, " "), lambda w: w != ""), capitalize), " ")


# --- concepts ----------------------------------------------------------------------


def normalize_concept(text: Column) -> Column:
    """H1"""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"^\s*coverage of expected concept:\s*", "")
    return F.trim(F.regexp_replace(bare, r"[^a-z0-9+]+", " "))


_REFUSED = sorted(
    {*X.CONCEPT_STOPWORDS, *X.CONCEPT_BLACKLIST, *X.GENERIC_LABELS, *[w.replace("_", " ") for w in X.CONCEPT_BLACKLIST]}
)


def is_valid_normalized(concept: Column) -> Column:
    return (F.length(concept) >= 3) & ~concept.isin(*_REFUSED)


def filter_concepts(concepts: Column, limit: int | None = None) -> Column:
    """H2: normalised, valid, keep-first distinct, first n."""
    normal = F.transform(concepts, normalize_concept)
    kept = F.array_distinct(F.filter(normal, is_valid_normalized))
    return kept if limit is None else F.slice(kept, 1, limit)


def keywords(text: Column, limit: int | None = None) -> Column:
    """H3: the first `limit` keywords, or all."""
    found = F.regexp_extract_all(
        F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)(\b[a-zA-Z][a-zA-Z0-9+\-]{2,}\b)")
    )
    kept = F.filter(F.array_distinct(found), lambda w: ~w.isin(*X.CONCEPT_STOPWORDS))  # a text says most of its words often
    bare = lambda w: normalize_concept(F.regexp_replace(w, r"^-+|-+$", ""))
    normal = F.transform(kept, lambda w: F.when(F.contains(w, F.lit("-")), bare(w)).otherwise(w))  # no other sign is left to fold
    distinct = F.array_distinct(F.filter(normal, is_valid_normalized))
    return distinct if limit is None else F.slice(distinct, 1, limit)


def infer_domain(question: Column, subject: Column) -> Column:
    """Domain named by the subject, else the domain with most hits (the first on ties)."""
    subject = F.lower(F.coalesce(subject, F.lit("")))
    named = F.coalesce(*[F.when(F.contains(subject, F.lit(d)), F.lit(d)) for d in X.DOMAIN_CONCEPTS])

    def best(low: Column) -> Column:
        hits = [
            F.struct(F.size(F.filter(strings(terms), lambda t: F.contains(low, t))).alias("n"), F.lit(-i).alias("rank"), F.lit(d).alias("domain"))
            for i, (d, terms) in enumerate(X.DOMAIN_CONCEPTS.items())
        ]
        return F.array_max(F.array(*hits))

    winner = let(F.lower(F.coalesce(question, F.lit(""))), best)
    return let(F.struct(named.alias("named"), winner.alias("w")), lambda s: F.coalesce(s["named"], F.when(s["w"]["n"] > 0, s["w"]["domain"]), F.lit("")))


def expected_concepts(question: Column, domain: Column, limit: int | None = None) -> Column:
    """H4: domain terms of the question (alphabetical) with expansions, then keywords; the first `limit`, or all.

    ``domain`` comes from ``infer_domain`` in an earlier step.
    """
    of_domain = reduce(
        lambda acc, d: F.when(domain == d, strings(sorted(X.DOMAIN_CONCEPTS[d]))).otherwise(acc), X.DOMAIN_CONCEPTS, no_strings()
    )

    def expand(term: Column) -> Column:
        return reduce(
            lambda acc, c: F.when(term == c, strings([c, *X.CONCEPT_EXPANSIONS[c]])).otherwise(acc), X.CONCEPT_EXPANSIONS, F.array(term)
        )

    named = F.flatten(F.transform(let(F.lower(question), lambda low: F.filter(of_domain, lambda t: F.contains(low, t))), expand))
    return filter_concepts(F.concat(F.array_distinct(named), keywords(question, limit)), limit)


def lexical_alignment(expected: Column, answer_terms: Column) -> Column:
    """H6 from expected concepts and the answer's keywords."""
    n = F.size(expected)
    overlap = F.size(F.array_intersect(expected, answer_terms)) / n
    bonus = F.when(F.size(answer_terms) >= F.greatest(F.lit(3), F.floor(n / 2)), 0.1).otherwise(0.0)
    return F.when(n > 0, round_even(F.least(F.lit(1.0), overlap + bonus), 2)).otherwise(0.0)


def sanitize(text: Column) -> Column:
    """H7: identity patterns out, then protected words out."""
    cleaned = F.coalesce(text, F.lit(""))
    low = F.lower(cleaned)

    def without(t: Column, pattern: str) -> Column:
        return F.regexp_replace(t, "(?iU)" + pattern, " ")

    def guarded(pattern: str, sign: str):  # what replacement leaves holds no sign that the text does not
        return lambda t: F.when(F.contains(low, F.lit(sign)), without(t, pattern)).otherwise(t)

    for pattern, sign in zip(X.IDENTITY_PATTERNS, X.IDENTITY_SIGNS, strict=True):
        cleaned = without(cleaned, pattern) if sign is None else let(cleaned, guarded(pattern, sign))
    tokens = F.split(collapse(cleaned), " ")
    bare = lambda t: F.lower(F.regexp_replace(t, r"^[.,:;!?()\[\]{}]+|[.,:;!?()\[\]{}]+$", ""))
    refused = lambda t: (t == "") | bare(t).isin(*X.PROTECTED_TERMS)

    def allowed(s: Column) -> Column:
        return F.when(F.size(s["out"]) == 0, s["all"]).otherwise(F.filter(s["all"], lambda t: ~F.array_contains(s["out"], t)))

    # Each distinct token is looked at once; most texts hold none to take out.
    told = let(tokens, lambda all_: F.struct(all_.alias("all"), F.filter(F.array_distinct(all_), refused).alias("out")))
    return F.array_join(let(told, allowed), " ")


# --- sentences and segments -----------------------------------------------------------


def segments(text: Column) -> Column:
    """Phrases of three or more characters that are not a bare number."""
    raw = F.transform(F.split(text, r"[.!?;\n]+"), strip)
    kept = F.filter(raw, lambda s: (F.length(s) >= 3) & ~F.rlike(s, F.lit(r"^\p{Nd}+$")))
    return F.when(F.size(kept) > 0, kept).otherwise(
        F.when(F.length(strip(text)) > 0, F.array(strip(text))).otherwise(no_strings())
    )


def longest_first(items: Column, limit: int | None = None) -> Column:
    """longest first, equal lengths in their given order; optional cap."""
    placed = F.transform(items, lambda s, i: F.struct((-F.length(s)).alias("l"), i.alias("i"), s.alias("s")))
    ordered = F.transform(F.sort_array(placed), lambda s: s["s"])
    return ordered if limit is None else F.slice(ordered, 1, limit)


def capped_segments(segs: Column, cap: int | None = None) -> Column:
    """All segments as they come; with a cap, the longest ones where there are more."""
    return segs if cap is None else F.when(F.size(segs) > cap, longest_first(segs, cap)).otherwise(segs)


def sentence_spans(text: Column) -> Column:
    """Sentences as structs (start, end) into the text, blank ones left out.

    Separators keep their place in the fold: text and separator pieces alternate,
    and their running length gives the offsets.
    """
    marked = F.regexp_replace(text, r"([.!?]+\s+|\n+)", "\u0001$1\u0001")
    pieces = F.split(marked, "\u0001")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,piece:string>>").alias("out"), F.lit(0).alias("i"))
    folded = F.aggregate(
        pieces,
        start,
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p)).alias("at"),
            F.when(
                (acc["i"] % 2 == 0) & (F.length(strip(p)) > 0),
                F.concat(
                    acc["out"],
                    F.array(F.struct(acc["at"].alias("start"), (acc["at"] + F.length(p)).alias("end"), strip(p).alias("piece"))),
                ),
            )
            .otherwise(acc["out"])
            .alias("out"),
            (acc["i"] + 1).alias("i"),
        ),
    )
    return folded["out"]


# --- rubric from an answer key ---------------------------------------------------------


def marks_in_prompt(question: Column) -> Column:
    """H16: "[5 marks]" or "(5m)"; NULL when absent."""
    square = F.regexp_extract(question, r"(?i)\[\s*(\d+(?:\.\d+)?)\s*(?:marks?|m)\s*\]", 1)
    round_ = F.regexp_extract(question, r"(?i)\(\s*(\d+(?:\.\d+)?)\s*(?:marks?|m)\s*\)", 1)
    first_is_square = (square != "") & (
        (round_ == "") | (F.regexp_instr(question, F.lit(r"(?i)\[\s*\d+(?:\.\d+)?\s*(?:marks?|m)\s*\]")) < F.regexp_instr(question, F.lit(r"(?i)\(\s*\d+(?:\.\d+)?\s*(?:marks?|m)\s*\)")))
    )
    return F.when(first_is_square, square).when(round_ != "", round_).cast("double")


def marks_in_text(text: Column) -> Column:
    """Either bracket may close; NULL when absent."""
    found = F.regexp_extract(text, r"(?i)[\[(]\s*(\d+(?:\.\d+)?)\s*(?:marks?|m)\s*[\])]", 1)
    return F.when(found != "", found.cast("double"))


def split_evenly(n: Column, total: Column) -> Column:
    """Marks per item, two decimals; the last item takes what is left."""

    def shares(each: Column) -> Column:
        others = F.array_repeat(each, F.greatest(n - 1, F.lit(0)))
        rest = total - F.aggregate(others, F.lit(0.0), lambda acc, x: acc + x)
        return F.concat(others, F.array(let(rest, lambda x: round_even(x, 2))))

    return let(let(total / n, lambda x: round_even(x, 2)), shares)


def rubric_descriptions(key: Column, limit: int | None = None, shortest: int = 1) -> Column:
    """List points when there are several, else sentences; all of at least `shortest` characters, or the first `limit`."""

    def pieces(pattern: str) -> Column:
        return F.filter(F.transform(F.split(key, pattern), strip), lambda s: s != "")

    def choose(s: Column) -> Column:
        raw = F.when(F.size(s["p"]) > 1, s["p"]).when(F.size(s["s"]) > 0, s["s"]).otherwise(F.array(key))
        kept = F.filter(raw, lambda c: F.length(c) >= shortest)
        kept = kept if limit is None else F.slice(kept, 1, limit)
        return let(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(F.array(F.lit("Fulfill the core requirements of the answer key."))))

    points, sentences = pieces(r"\n+\s*(?:-|\d+\.)\s*"), pieces(r"(?<=[.!?])\s+|\n+")
    return let(F.struct(points.alias("p"), sentences.alias("s")), choose)


def key_terms(description: Column, common) -> Column:
    long_words = F.filter(words(F.lower(description)), lambda w: F.rlike(w, F.lit(r"^[a-zA-Z]{5,}$")))
    return F.filter(long_words, lambda w: ~w.isin(*common))


def keyword_ratio(description: Column, answer: Column) -> Column:
    """Share of the criterion's long words found in the answer; none to look for is 1."""
    return let(
        F.struct(key_terms(description, X.RUBRIC_COMMON_WORDS).alias("t"), F.lower(answer).alias("a")),
        lambda s: F.when(
            F.size(s["t"]) > 0, F.size(F.filter(s["t"], lambda w: F.contains(s["a"], w))) / F.size(s["t"])
        ).otherwise(1.0),
    )


def phrase_coverage(description: Column, answer: Column) -> Column:
    """0.4 x three-word chunks found + 0.6 x distinct words found; short criteria are 1."""

    def score(s: Column) -> Column:
        w, lowered = s["w"], s["a"]
        n = F.floor(F.size(w) / 3).cast("int")
        chunks = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(w, (i - 1) * 3 + 1, 3), " "))
        unique = F.filter(F.array_distinct(w), lambda x: ~x.isin(*X.RUBRIC_FUNCTION_WORDS))
        chunk_part = F.size(F.filter(chunks, lambda c: F.contains(lowered, c))) / n
        word_part = F.when(
            F.size(unique) > 0, F.size(F.filter(unique, lambda x: F.contains(lowered, x))) / F.size(unique)
        ).otherwise(1.0)
        return F.when(F.size(w) < 3, 1.0).otherwise(chunk_part * 0.4 + word_part * 0.6)

    return let(F.struct(words(F.lower(description)).alias("w"), F.lower(answer).alias("a")), score)


def partial_credit(allocated: Column, met_ratio: Column) -> Column:
    """Marks for one criterion."""
    return F.when(met_ratio >= 0.75, allocated).when(met_ratio >= 0.35, F.rint(allocated * met_ratio * 2) / 2).otherwise(0.0)


def criterion_met(allocated: Column, awarded: Column, met_ratio: Column) -> Column:
    return (met_ratio >= 0.75) | ((met_ratio >= 0.35) & (awarded >= allocated * 0.5))


# --- question understanding ------------------------------------------------------------


def first_class(text: Column, classes, default: str) -> Column:
    lowered = F.lower(text)
    return F.coalesce(*[F.when(contains_any(lowered, needles), F.lit(name)) for name, needles in classes], F.lit(default))


def answer_type(question: Column) -> Column:
    """H21, evaluator's classes."""
    return first_class(question, X.ANSWER_TYPES, "DESCRIPTIVE")


def prompt_type(question: Column) -> Column:
    """H21, prompt classes."""
    return first_class(question, X.PROMPT_TYPES, "explanation")


def difficulty(marks: Column) -> Column:
    return F.when(marks <= 2, "EASY").when(marks <= 5, "MEDIUM").otherwise("HARD")


def expected_depth(marks: Column) -> Column:
    return F.when(marks <= 2, "brief").when(marks <= 5, "conceptual").otherwise("detailed")


def prompt_keywords(question: Column) -> Column:
    long_words = F.filter(words(F.lower(question)), lambda w: F.rlike(w, F.lit(r"^[a-z]{3,}$")))
    return F.array_distinct(F.filter(long_words, lambda w: ~w.isin(*X.PROMPT_STOPWORDS)))


def prompt_topics(question: Column, kws: Column) -> Column:
    lowered = F.lower(question)
    named = F.array_compact(F.array(*[F.when(contains_any(lowered, needles), F.lit(t)) for t, needles in X.TOPIC_INDICATORS]))
    return (
        F.when(F.size(named) > 0, named)
        .when(F.size(kws) > 0, F.transform(F.slice(kws, 1, 2), capitalize))
        .otherwise(F.array(F.lit("General")))
    )


def prompt_intent(kind: Column, kws: Column) -> Column:
    head = F.coalesce(*[F.when(kind == k, F.lit(t)) for k, t in X.INTENT_TEXTS.items()])
    return F.concat(head, F.array_join(F.slice(kws, 1, 3), ", "), F.lit("."))


def has_or_structure(text: Column) -> Column:
    """H22"""
    patterns = (
        r"(?iU)(?:^|\n)\s*OR\s*(?:\n|$)",
        r"(?isU)\bEither\b.{5,}\bor\b",
        r"(?iU)(?:^|\n)\s*(?:Attempt\s+)?Any[\s-]One(?:\s+of\s+the\s+following)?[\s:]*(?:\n|$)",
        r"(?iU)\s+(?:OR|Either|Any[\s-]?One)\s+",
    )
    return reduce(lambda a, b: a | b, [F.rlike(text, F.lit(p)) for p in patterns])


def split_alternatives(text: Column) -> Column:
    """By a stand-alone OR line, else inline OR, else inline Either / Any One."""
    patterns = (
        r"(?iU)\n\s*(?:OR|Either|Any[\s-]?One(?:\s+of\s+the\s+following)?)\s*\n",
        r"(?iU)\s+OR\s+",
        r"(?iU)\s+(?:Either|Any[\s-]?One)\s+",
    )
    out = F.array(strip(text))
    for pattern in reversed(patterns):
        parts = F.split(text, pattern)
        kept = F.filter(F.transform(parts, strip), lambda s: s != "")
        out = F.when(F.size(parts) >= 2, kept).otherwise(out)
    return out


def keyword_overlap(a: Column, b: Column) -> Column:
    """Shared words of four or more letters over the smaller set."""

    def bag(text: Column) -> Column:
        return F.array_distinct(F.filter(words(F.lower(text)), lambda w: F.rlike(w, F.lit(r"^[a-z]{4,}$"))))

    return let(
        F.struct(bag(a).alias("a"), bag(b).alias("b")),
        lambda s: F.when((F.size(s["a"]) == 0) | (F.size(s["b"]) == 0), 0.0).otherwise(
            F.size(F.array_intersect(s["a"], s["b"])) / F.least(F.size(s["a"]), F.size(s["b"]))
        ),
    )


# --- fairness and privacy ----------------------------------------------------------------


def bias_scan(answer: Column, feedback: Column) -> dict[str, Column]:
    """H23"""
    a, f = F.lower(F.coalesce(answer, F.lit(""))), F.lower(F.coalesce(feedback, F.lit("")))
    email = F.rlike(a, F.lit(X.BIAS_EMAIL))
    risks = let(a, lambda low: F.filter(strings(X.IDENTITY_TRIGGERS), lambda t: F.contains(low, t)))
    neat = let(f, lambda low: F.filter(strings(X.NEATNESS_TRIGGERS), lambda t: F.contains(low, t)))
    violations = F.concat(
        F.when(email, F.array(F.lit("Student email was not anonymized in transcription."))).otherwise(no_strings()),
        F.transform(risks, lambda t: F.concat(F.lit("Anonymization risk: student metadata trigger '"), t, F.lit("' detected in text."))),
        F.transform(
            neat,
            lambda t: F.concat(F.lit("Neatness neutrality violation: feedback references handwriting/neatness using term '"), t, F.lit("'.")),
        ),
    )
    penalty = F.when(email, 0.20).otherwise(0.0) + F.size(risks) * 0.10 + F.size(neat) * 0.15
    return {
        "verified_bias_free": F.size(violations) == 0,
        "bias_score": round_even(F.greatest(F.lit(0.0), 1.0 - penalty), 2),
        "violations": violations,
    }


def redact(text: Column) -> Column:
    """Ordered rules."""
    for pattern, replacement, ignore_case in X.REDACTION_RULES:
        text = F.regexp_replace(text, ("(?iU)" if ignore_case else "(?U)") + pattern, replacement)
    return text


def roll_tokens(text: Column) -> Column:
    """Identifier tokens; edges are alphanumeric look-arounds, since "_" must end a token."""
    return F.regexp_extract_all(text, F.lit(f"({X.ROLL_TOKEN})"))


# --- headers and quality -------------------------------------------------------------------


def is_section_header(text: Column) -> Column:
    """H30"""
    return F.rlike(strip(text), F.lit(r"(?i)^(?:Part|Section|Group|Block)\s*[-:\s]*[A-Z0-9]+\s*$"))


def question_header(text: Column) -> Column:
    """The question number a line starts with, or NULL."""
    raw = strip(text)
    bare = F.regexp_extract(raw, r"(?i)^(?:Part\s+[A-Z]\s*)?(?:Q\.?\s*)?(\d{1,3})\s*[.)]?\s*$", 1)
    start = F.regexp_extract(raw, r"(?i)^(?:Part\s+[A-Z]\s*)?(?:Q\.?\s*)?(\d{1,3})\s*[.)]\s*(?:.*)$", 1)
    return F.when(is_section_header(text), F.lit(None)).when(bare != "", bare).when(start != "", start)


def char_error_rate(reference: Column, hypothesis: Column) -> Column:
    """H33 (CER)"""
    ref, hyp = strip(reference), strip(hypothesis)
    n = F.length(ref)
    return F.when(n > 0, F.levenshtein(ref, hyp) / n).otherwise(F.when(F.length(hyp) > 0, 1.0).otherwise(0.0))


def text_quality(text: Column) -> Column:
    """H34"""
    s = strip(F.coalesce(text, F.lit("")))
    n = F.length(s)
    clean = F.length(F.regexp_replace(s, r"(?U)[^\p{L}\p{N}\s]", "")) / n
    # The share of the most frequent character, counted once per distinct one.
    run = let(s, lambda t: F.array_max(F.transform(F.array_remove(F.array_distinct(F.split(t, "")), ""), lambda c: F.length(t) - F.length(F.replace(t, c, F.lit(""))))))
    return (
        F.when(n == 0, 0.0)
        .when(n < 3, 0.4)
        .when(clean < 0.5, 0.45)
        .when(run / n > 0.6, 0.50)
        .otherwise(round_even(F.least(F.lit(0.92), 0.75 + clean * 0.15), 3))
    )


def singular_words(text: Column) -> Column:
    """Content words, crudely singular, in order (repeats kept)."""
    raw = F.regexp_extract_all(F.lower(text), F.lit(r"([A-Za-z][A-Za-z0-9\-]*)"))
    bare = F.transform(raw, lambda w: F.regexp_replace(w, r"^-+|-+$", ""))
    kept = F.filter(bare, lambda w: (F.length(w) >= 3) & ~w.isin(*X.PAPER_STOPWORDS))

    def singular(w: Column) -> Column:
        n = F.length(w)
        return (
            F.when((n > 4) & w.endswith("ies"), F.concat(F.left(w, n - 3), F.lit("y")))
            .when((n > 3) & w.endswith("es") & ~w.endswith("ses"), F.left(w, n - 2))
            .when((n > 3) & w.endswith("s") & ~w.endswith("ss"), F.left(w, n - 1))
            .otherwise(w)
        )

    return F.transform(kept, singular)


