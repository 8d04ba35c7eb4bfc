"""Row helpers of the Arrow tasks: fuzzy words, word errors, snippets.

Nothing here knows Spark; each helper works on the text of one row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa

FUZZY_RATIO = 0.88
_AT_ONCE = 1 << 22


def some_rows(*columns: pa.Array, most: int = _AT_ONCE) -> Iterator[tuple[pa.Array, ...]]:
    """Columns of a batch in runs of rows of at most `most` bytes, or of one row: as Python values they take many times that."""
    n = len(columns[0])
    if n > 1 and sum(c.nbytes for c in columns) > most:
        yield from some_rows(*(c[: n // 2] for c in columns), most=most)
        yield from some_rows(*(c[n // 2 :] for c in columns), most=most)
    else:
        yield columns


class Spelling:
    """Words as vectors of how often they hold each letter, to tell for many pairs at once which can be near-equal.

    The ratio of matching blocks is at most twice the letters in common over all letters; letters share bins, which only
    raises that bound. One for some rows: it keeps every word it has met.
    """

    BINS = 64

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.letters = np.zeros((1024, self.BINS), np.uint8)
        self.lengths, self.held = np.zeros(1024, np.int32), np.zeros(1024, np.uint64)

    def number(self, words: list[str]) -> np.ndarray:
        for word in words:
            if word not in self.numbers:
                n = self.numbers[word] = len(self.numbers)
                if n == len(self.lengths):
                    self.letters, self.lengths, self.held = (np.concatenate([a, np.zeros_like(a)]) for a in (self.letters, self.lengths, self.held))
                codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), "<u4") % self.BINS
                self.letters[n], self.lengths[n] = np.minimum(np.bincount(codes, minlength=self.BINS), 255), len(word)
                self.held[n] = np.packbits(self.letters[n] > 0).view(np.uint64)[0]
        return np.fromiter((self.numbers[w] for w in words), np.int64, len(words))

    def possible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which words of `b` each word of `a` can be near-equal to, by their numbers."""
        x, y = self.lengths[a][:, None], self.lengths[b][None, :]
        total = x + y
        out = (2.0 * np.minimum(x, y) >= FUZZY_RATIO * total) & (total > 0)
        # A letter that the other word lacks has no partner; few pairs are left to count by letter.
        p, q = self.held[a][:, None], self.held[b][None, :]
        most = np.minimum(x - np.bitwise_count(p & ~q), y - np.bitwise_count(q & ~p))
        out &= 2.0 * most >= FUZZY_RATIO * total - 1e-9
        i, j = np.nonzero(out)
        common = np.minimum(self.letters[a[i]], self.letters[b[j]]).sum(1, dtype=np.int32)
        long = np.maximum(x[i, 0], y[0, j]) > 255
        out[i, j] = long | (2.0 * common >= FUZZY_RATIO * total[i, j] - 1e-9)
        return out

    def near(self, words: list[str], others: list[str]) -> dict[str, set[str]]:
        """The near-equal ones among the others, of each word that has any."""
        a, b, found = self.number(words), self.number(others), {}
        step = max(1, (1 << 20) // max(1, len(b)))
        for at in range(0, len(a), step):
            for i, j in zip(*(x.tolist() for x in np.nonzero(self.possible(a[at : at + step], b)))):
                if ratio(words[at + i], others[j]) >= FUZZY_RATIO:
                    found.setdefault(words[at + i], set()).add(others[j])
        return found


@lru_cache(1 << 14)
def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def word_edits(reference: list[str], hypothesis: list[str]) -> int:
    """Edit distance of two lists of words, a column of the table at a time: its steps up and down are two bit vectors."""
    n = len(reference)
    if not n:
        return len(hypothesis)
    where: dict[str, int] = {}
    for i, word in enumerate(reference):
        where[word] = where.get(word, 0) | 1 << i
    whole, top, edits = (1 << n) - 1, 1 << (n - 1), n
    up, down = whole, 0
    for word in hypothesis:
        same = where.get(word, 0)
        level = same | down
        across = (((same & up) + up) ^ up) | same
        right, left = down | ~(across | up) & whole, up & across
        edits += bool(right & top) - bool(left & top)
        right, left = right << 1 | 1, left << 1
        up, down = (left | ~(level | right)) & whole, right & level & whole
    return edits


def word_error_rate(reference: str, hypothesis: str) -> float:
    """H33 (WER): word edits over reference words."""
    ref, hyp = reference.lower().split(), hypothesis.lower().split()
    return word_edits(ref, hyp) / len(ref) if ref else float(bool(hyp))


def words_around(text: str, start: int, end: int, before: int = 1, after: int = 2) -> str:
    """Text from the word boundary ``before`` spaces back to ``after`` spaces on."""
    left = start
    for _ in range(before):
        space = text.rfind(" ", 0, left)
        left = space if space >= 0 else 0
        if space < 0:
            break
    if left > 0:
        left += 1
    right = end
    for _ in range(after):
        space = text.find(" ", right)
        right = space + 1 if space >= 0 else len(text)
    return text[left:right].strip()


_PLAIN = re.compile(r"[^a-z0-9]")


class Snippets:
    """Finds the passage of an answer that shows a concept."""

    def __init__(self, answer: str, synonyms: dict[str, list[str]], spelling: Spelling):
        self.spelling, self.numbers = spelling, None
        self.text = answer.lower()
        self.tokens = self.text.split()
        self.plain = [_PLAIN.sub("", t) for t in self.tokens]
        self.first = {}
        for at, token in enumerate(self.plain):
            self.first.setdefault(token, at)
        self.synonyms = synonyms

    def _tokens_around(self, at: int) -> str:
        return " ".join(self.tokens[max(0, at - 1) : at + 3])

    def find(self, term: str, confidence: float):
        """(snippet, confidence): whole phrase, then token, then synonym, then fuzzy token."""
        if " " in term and term in self.text:
            at = self.text.find(term)
            return words_around(self.text, at, at + len(term)), confidence
        if term in self.first:
            return self._tokens_around(self.first[term]), confidence
        for other in self.synonyms.get(term, ()):
            at = self.text.find(other)
            if at >= 0:
                return words_around(self.text, at, at + len(other)), round(confidence * 0.95, 2)
        if self.numbers is None:
            self.numbers = self.spelling.number(self.plain)
        for at in np.flatnonzero(self.spelling.possible(self.spelling.number([term]), self.numbers)[0]):
            token = self.plain[at]
            if len(token) >= 3 and (sure := ratio(term, token)) >= FUZZY_RATIO:
                return self._tokens_around(int(at)), round(sure, 2)
        return "", 0.0
