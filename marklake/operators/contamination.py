"""Contamination and privacy sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marklake.functions import runs as R
from marklake.functions import text as TX
from marklake.operators.segment import PART_HEADER
from marklake.session import checkpointed

MIN_CONTENT_WORDS = 3
OVERLAP_FLOOR = 0.5


def plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "))


def lifted_phrases(phrases: DataFrame, answers: DataFrame) -> DataFrame:
    """(phrase_id, answer_id) where the phrase occurs in the answer, plain text compared.

    Containment may begin and end inside a word, so only the words between the first
    and last are certain to be words of the answer. Each phrase is looked up by one
    run of up to three such inner words: the one that fewest answers hold. Answers
    turn only those of their runs into rows that a filter of all phrases' runs lets
    through; these are stored once, counted, and met by the rarest run of each phrase,
    so a phrase is never joined on a run that every answer has while a rarer one
    exists. Each candidate pair is then tested on the full text.
    """
    p = phrases.select("phrase_id", plain(F.col("phrase_text")).alias("phrase")).withColumn("_w", F.split("phrase", " "))
    content = F.size(F.filter("_w", lambda w: F.length(w) > 1))
    p = p.filter(content >= MIN_CONTENT_WORDS)
    inner = F.array_join(F.slice("_w", F.lit(2), F.size("_w") - 2), " ")
    staged = p.select("phrase_id", "phrase", F.least(F.lit(3), F.size("_w") - 2).alias("n"), inner.alias("_inner"))
    runs = checkpointed(R.hashed_runs(staged, "_inner", "n"))

    a = answers.select("answer_id", plain(F.col("answer_text")).alias("plain_text"))
    held = checkpointed(R.hashed_runs(a, "plain_text", [1, 2, 3], wanted=R.run_filter(runs)))
    spread = held.groupBy("run").agg(F.count(F.lit(1)).alias("_answers"))
    rarest = (
        runs.join(spread, "run", "left")
        .groupBy("phrase_id", "phrase")
        .agg(F.min(F.struct(F.coalesce("_answers", F.lit(0)).alias("c"), F.col("run"))).alias("_k"))
        .filter("_k.c > 0")  # a run that no answer holds rules the phrase out
        .select("phrase_id", "phrase", F.col("_k.run").alias("run"))
    )
    pairs = held.join(rarest, "run").select("phrase_id", "phrase", "answer_id").distinct()
    return pairs.join(a, "answer_id").filter(F.contains("plain_text", F.col("phrase"))).select("phrase_id", "answer_id")


def check_scheme_against_paper(scheme: DataFrame, paper: DataFrame, keys: list[str], paper_read: Column | None = None) -> DataFrame:
    """What the paper asks and the scheme lacks, and the reverse; mark allocation.

    ``scheme``: keys, question_text, value_texts (points and variants), max_marks.
    ``paper``: keys, question_text, part_header, instruction. Where ``paper_read`` is
    false nothing is compared and nothing is flagged.
    """
    p = paper.select(*keys, F.col("question_text").alias("_asked"), "part_header", "instruction")
    joined = scheme.join(p, keys, "left")
    staged = (
        joined.withColumn("_paper", F.array_distinct(TX.singular_words(F.coalesce("_asked", F.lit("")))))
        .withColumn("_own", F.array_distinct(TX.singular_words(F.col("question_text"))))
        .withColumn("_vocab", F.array_union("_own", F.flatten(F.transform("value_texts", TX.singular_words))))
    )
    ran = paper_read if paper_read is not None else F.lit(True)
    present = F.col("_asked").isNotNull()
    missing = F.array_except("_paper", "_vocab")
    overlap = F.when(F.size("_paper") > 0, (F.size("_paper") - F.size(missing)) / F.size("_paper")).otherwise(0.0)
    factors = [F.nullif(F.regexp_extract("part_header", PART_HEADER, i), F.lit("")).cast("double") for i in (2, 3)]
    wrong_marks = F.coalesce((F.col("max_marks") != factors[0]) & (F.col("max_marks") != factors[1]), F.lit(False))
    flagged = ran & (~present | (overlap < OVERLAP_FLOOR) | wrong_marks)
    return staged.select(
        *keys,
        ran.alias("ran"),
        present.alias("in_paper"),
        F.when(ran & present, overlap).alias("overlap"),
        F.when(ran & present, missing).alias("missing_from_scheme"),
        F.when(ran & present, F.sort_array(F.array_except("_own", "_paper"))).alias("unasked_by_paper"),
        (ran & present & wrong_marks).alias("marks_mismatch"),
        flagged.alias("flagged"),
        F.when(~ran, F.lit("paper not read")).when(~present, F.lit("the paper has no such question, but the scheme defines one")).alias("reason"),
    )


def surviving_identifiers(files: DataFrame, tokens: DataFrame) -> DataFrame:
    """Files whose name or text still holds a known token, case ignored.

    ``files``: path, stem, content. ``tokens``: token.
    """
    known = tokens.select(F.lower("token").alias("token")).distinct()
    found = files.select(
        "path",
        F.explode(
            F.concat(
                F.transform(F.array_distinct(F.transform(TX.roll_tokens(F.col("stem")), lambda t: F.lower(t))), lambda t: F.struct(F.lit("filename").alias("place"), t.alias("token"))),
                F.transform(
                    F.array_distinct(F.transform(TX.roll_tokens(F.coalesce("content", F.lit(""))), lambda t: F.lower(t))),
                    lambda t: F.struct(F.lit("content").alias("place"), t.alias("token")),
                ),
            )
        ).alias("_f"),
    ).select("path", "_f.*")
    return found.join(known, "token", "left_semi").groupBy("path", "place").agg(
        F.array_join(F.sort_array(F.collect_set("token")), ", ").alias("tokens")
    )


def pseudonyms(files: DataFrame, secret: str) -> DataFrame:
    """Opaque names and the private mapping.

    The id is a keyed hash of the path, so a replay after a lost executor gives the
    same name; it reveals neither order nor content. ``files``: path, stem, suffix.
    """
    opaque = F.concat(F.lit("S_"), F.substring(F.sha2(F.concat(F.lit(secret + "|"), F.col("path")), 256), 1, 16))
    return files.select(
        "path",
        F.concat(opaque, F.lower("suffix")).alias("new_name"),
        F.sort_array(F.array_distinct(TX.roll_tokens(F.col("stem")))).alias("roll_tokens"),
    )


def colliding_pseudonyms(mapping: DataFrame) -> DataFrame:
    """Names given twice (expected: none; checked before a mapping is used)."""
    n = F.count(F.lit(1)).over(Window.partitionBy("new_name"))
    return mapping.withColumn("_n", n).filter("_n > 1").drop("_n")
