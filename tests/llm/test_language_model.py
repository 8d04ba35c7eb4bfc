"""The model against a plain one in Python, and as a distribution."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from marklake.llm.language_model import discounts, scored_documents

SCHEMA = "doc_id long, text string, h string, c long, shard long"


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def plain(rows):
    out = {k: zlib.crc32(("" if k is None else str(k)).encode()) % 5 == 1 for k, _ in rows}
    pairs, words = Counter(), Counter()
    for k, t in rows:
        if not out[k]:
            w = tokens(t)
            words.update(w)
            pairs.update(zip(["begin", *w], w))
    n, v = sum(words.values()), len(words)
    high = (0, *discounts(*(sum(c == i for c in pairs.values()) for i in (1, 2, 3, 4))))
    follows = Counter(b for _, b in pairs)
    low = (0, *discounts(*(sum(c == i for c in follows.values()) for i in (1, 2, 3, 4))))
    total, passed = Counter(), defaultdict(float)
    for (a, _), c in pairs.items():
        total[a] += c
        passed[a] += high[min(c, 3)]
    spread = sum(low[min(c, 3)] for c in follows.values()) / len(pairs) if pairs else 1

    def p(a, b):
        lower = spread / (v + 1) + ((follows[b] - low[min(follows[b], 3)]) / len(pairs) if pairs else 0)
        if not total[a]:
            return lower
        c = pairs[a, b]
        return (c - high[min(c, 3)]) / total[a] + passed[a] / total[a] * lower

    for a in list(total)[:50]:
        assert sum(p(a, b) for b in words) + p(a, "unseen") == pytest.approx(1)
    result = []
    for k, t in rows:
        w = tokens(t)
        base = sum(math.log10((words[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        score = sum(math.log10(p(a, b)) for a, b in zip(["begin", *w], w))
        result.append((k, out[k], len(w), sum(words[x] > 0 for x in w), n, pytest.approx(base, abs=1e-9, rel=1e-9), pytest.approx(score, abs=1e-9, rel=1e-9)))
    return result


def check(spark, rows):
    df = spark.createDataFrame([(k, t, "x", 1, 2) for k, t in rows], SCHEMA).coalesce(2)
    got = sorted((tuple(r) for r in scored_documents(df).collect()), key=str)
    for mine, theirs in zip(got, sorted(plain(rows), key=lambda r: str((*r[:5], r[5].expected, r[6].expected))), strict=True):
        assert mine == theirs


def test_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows)


def test_odd_rows(spark):
    check(spark, [(1, None), (2, ""), (3, "A a\tB"), (None, "x"), (4, "a \x85b c É é"), (3, "A a\tB"), (5, "word " * 30_000)])
    check(spark, [(5, "a b"), (6, "q")])


def test_no_training_rows_and_empty_table(spark):
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 1)
    check(spark, [(held, "a b")])
    check(spark, [])
