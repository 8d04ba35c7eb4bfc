"""Logistic models over hashed and dense features, fitted with numpy on a bounded sample of labelled documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marklake.llm.common import BLANK, word_hashes

# Letters, digits and bytes above ASCII are words to the classifiers; all else parts them.
NO_LETTER = np.array([not (chr(b).isalnum() if b < 128 else True) for b in range(256)])
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_LINE = np.array([b == 10 for b in range(256)])
DENSE = ("upper", "digits", "marks", "letters per word", "log words", "distinct words", "word as before", "words per line", "distinct lines")


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def word_features(data: np.ndarray, starts: np.ndarray, prefixes: tuple[int, ...] = (4, 5, 6, 7, 8, 10)) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of all words and their first bytes; prefixes stand for the stems of inflected words."""
    out = []
    for k in (0, *prefixes):
        h, counts = word_hashes(data, starts, k, NO_LETTER)
        out.append(h + np.uint64(k))
    return np.tile(np.repeat(np.arange(len(counts)), counts), len(out)), np.concatenate(out)


def _per_text(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[starts[1:]] - total[starts[:-1]]


def _distinct(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    doc = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return np.bincount(doc[new], minlength=len(counts))


def dense_features(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How a text is written, in the order of DENSE; all zero for an empty one."""
    size = np.maximum(np.diff(starts), 1)
    words, counts = word_hashes(data, starts)
    lines, line_counts = word_hashes(data, starts, 0, _LINE)
    doc = np.repeat(np.arange(len(counts)), counts)
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    n, m = np.maximum(counts, 1), np.maximum(line_counts, 1)
    letters = size - _per_text(BLANK[data], starts)
    return np.stack(
        [
            _per_text(_UPPER[data], starts) / size, _per_text(_DIGIT[data], starts) / size,
            _per_text((NO_LETTER & ~BLANK)[data], starts) / size, np.log1p(letters / n), np.log1p(counts),
            _distinct(words, counts) / n, np.bincount(doc[again], minlength=len(counts)) / n, np.log1p(counts / m), _distinct(lines, line_counts) / m,
        ],
        1,
    )


def fit(x: np.ndarray, y: np.ndarray, decay: float = 1e-3, steps: int = 25) -> np.ndarray:
    """Weights of a logistic model with an intercept last, by Newton steps on a dense matrix."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), decay * max(len(x), 1))
    penalty[-1] = 1e-9
    for _ in range(steps):
        p = sigmoid(x @ w)
        gradient = x.T @ (p - y) + penalty * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, columns: list[str], per_class: int) -> DataFrame:
    """At most `per_class` labelled ids per value of each column, chosen by a hash of the id, with their texts.

    Labels with a null id or value, and repeated ids of a label table, are left out or taken once.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("int").alias(c) for c in columns]).dropna()
    ids = ids.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in columns])
    parts = [ids.where(F.col(c) == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in columns for v in (0, 1)]
    chosen = parts[0]
    for part in parts[1:]:
        chosen = chosen.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Bounded by 2 * per_class rows of a few numbers per column.
    return texts.join(F.broadcast(chosen.distinct()), "doc_id")

