"""Edited texts against plain Python; likeness against the true share of five-word shingles."""

import hashlib
import re

from marklake.llm.fingerprints import fingerprints_with_edits

SCHEMA = "doc_id long, text string, k long, a string, cut long"


def frame(spark, rows):
    return spark.createDataFrame([(k, t, 1, "x", 2) for k, t in rows], SCHEMA)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def share(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    order = sorted(rows, reverse=True)
    got = {r.doc_id: r for r in fingerprints_with_edits(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    errors = []
    for (k, text), (_, after) in zip(order, order[1:] + order[:1]):
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        r = got[k]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        errors += [abs(r.near_edited - share(text, edited)), abs(r.near_next - share(text, after))]
    assert max(errors) < 0.2 and sum(errors) / len(errors) < 0.03
    by_text = {}
    for k, text in rows:
        assert by_text.setdefault(text, got[k].fingerprint) == got[k].fingerprint


def test_odd_rows(spark):
    rows = [(5, "one"), (5, "one"), (5, "other words stand here for once"), (4, None), (3, ""), (None, "last of all"), (2, "é😀 " * 4000)]
    got = fingerprints_with_edits(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert sorted(r.fingerprint == "" for r in got) == [False] * 5 + [True] * 2
    ones = [r for r in got if r.doc_id == 5 and r.n_chars == 3]
    assert ones[0] == ones[1]
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    last = next(r for r in got if r.doc_id is None)  # followed by the first, of which the least text stands
    assert last.edited_sha256 == hashlib.sha256(b"last of " + b"one").hexdigest()


def test_one_row_and_empty_table(spark):
    (row,) = fingerprints_with_edits(frame(spark, [(1, "abcdef")])).collect()
    assert row.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and row.near_next == 1.0
    assert fingerprints_with_edits(frame(spark, [])).count() == 0
