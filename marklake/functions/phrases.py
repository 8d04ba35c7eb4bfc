"""Phrase evidence (H8-H10) in the texts of one Arrow batch: folding in numpy, phrases and words by automata.

Texts are folded all at once by table look-ups per code point. A question's value points become three Aho-Corasick
automata, kept from row to row: folded phrases, the same run together, and content words; a text is read once by each
that is needed, and Python runs per hit, not per character. Nothing here knows Spark.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import numpy as np

_TOKEN = re.compile(r"\w+")
MIN_WORD_RATIO = 0.40
SCATTERED = "evidence scattered - no single supporting passage"
NOTHING = "no supporting evidence found in the answer"
_AT_ONCE = 1 << 18

Span = tuple[int, int]


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class Folding:
    """What every code point becomes: case, accents, punctuation and spacing removed; filled in as code points are met.

    `soft` ones become a space that is dropped behind another one and at both ends.
    """

    def __init__(self):
        self.size = np.full(0x110000, -1, np.int8)
        self.place = np.zeros(0x110000, np.uint32)
        self.soft = np.zeros(0x110000, bool)
        self.flat = np.zeros(0, np.uint32)

    def _learn(self, code: int) -> None:
        ch = chr(code)
        text = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c)).lower()
        if text.isspace() or len(text) == 1 and not _TOKEN.match(text):
            text = " "
        self.soft[code], self.size[code], self.place[code] = text == " ", len(text), len(self.flat)
        self.flat = np.append(self.flat, _code_points(text))

    def __call__(self, texts: list[str]) -> Iterator[tuple[str, np.ndarray]]:
        """Each text folded, with the place in the text that each folded character comes from."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        code = _code_points("".join(texts))
        for unknown in np.unique(code[self.size[code] < 0]):
            self._learn(int(unknown))
        many = self.size[code].astype(np.int64)
        at = np.repeat(np.arange(len(code)), many)
        within = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
        out = self.flat[self.place[code[at]] + within] if len(at) else np.zeros(0, np.uint32)
        owner = np.repeat(np.arange(len(texts)), lengths)[at]
        behind_space = np.ones(len(at), bool)
        behind_space[1:] = (out[:-1] == 32) | (owner[1:] != owner[:-1])
        keep = ~(self.soft[code[at]] & behind_space)
        out, at, owner = out[keep], at[keep], owner[keep]
        whole = out.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        for i, start in enumerate(np.cumsum(lengths) - lengths):
            folded = whole[bounds[i] : bounds[i + 1]].rstrip(" ")
            yield folded, at[bounds[i] : bounds[i] + len(folded)] - start


FOLDING = Folding()


def fold_all(texts: list[str]) -> Iterator[tuple[str, np.ndarray]]:
    """Folded texts, a quarter of a million characters at a time: their work arrays take some 60 bytes a character."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= _AT_ONCE:
            yield from FOLDING(held)
            held, size = [], 0
    yield from FOLDING(held)


@lru_cache(maxsize=65536)
def folded_phrase(phrase: str) -> str:
    return next(FOLDING([phrase]))[0]


class _Automaton:
    """Numbered strings, found in one pass over a text."""

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.built = None

    def add(self, text: str) -> int:
        return self.numbers.setdefault(text, len(self.numbers)) if text else -1

    def hits(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(number, start, end), by ascending end."""
        if self.built is None:
            self.built = ahocorasick.Automaton()
            for word, number in self.numbers.items():
                self.built.add_word(word, (number, len(word)))
            if self.numbers:
                self.built.make_automaton()
        if self.numbers:
            for last, (number, length) in self.built.iter(text):
                yield number, last - length + 1, last + 1

    def first(self, text: str) -> dict[int, Span]:
        found: dict[int, Span] = {}
        for number, start, end in self.hits(text):
            found.setdefault(number, (start, end))
        return found


class Option(NamedTuple):
    """A phrase that shows a value point."""

    folded: int
    run_together: int
    words: tuple[int, ...]
    n: int
    required: int
    limit: int


def candidates(text: str, variants) -> list[str]:
    """Longest first, given order on equal length, each once."""
    return sorted(dict.fromkeys([text, *(variants or ())]), key=len, reverse=True)


def densest_window(hits: list[tuple[int, int, int]], limit: int) -> tuple[int, Span | None]:
    """First window of at most ``limit`` characters holding the most distinct words.

    Hits (start, end, word) are sorted by start. For each left edge the right edge only moves forward,
    so counts are kept instead of recounted. Returns (distinct words, span).
    """
    count: dict[int, int] = {}
    best, best_left, right = 0, -1, 0
    for left, (start, _, word) in enumerate(hits):
        while right < len(hits) and hits[right][1] - start <= limit:
            count[hits[right][2]] = count.get(hits[right][2], 0) + 1
            right += 1
        if len(count) > best:
            best, best_left = len(count), left
        if right <= left:
            right = left + 1
            continue
        count[word] -= 1
        if not count[word]:
            del count[word]
    if not best:
        return 0, None
    seen: set[int] = set()
    for start, end, word in hits[best_left:]:
        seen.add(word)
        if len(seen) == best:
            return best, (hits[best_left][0], end)
    return 0, None


def _too_few(found: int, option: Option) -> str:
    return (
        f"insufficient evidence: matched {found} of {option.required} required content words "
        f"(N_vp={option.n}, M=ceil({option.n}*{MIN_WORD_RATIO}))"
    )


class Scheme:
    """The textual value points of one question, made ready for any number of answers."""

    def __init__(self, points: list[dict]):
        self.points = points
        self.phrases, self.squashed, self.words = _Automaton(), _Automaton(), _Automaton()
        self.options = [[self._option(o) for o in candidates(p["text"], p.get("acceptable_variants"))] for p in points]

    def _option(self, phrase: str) -> Option:
        content = [w for w in _TOKEN.findall(phrase) if len(w) > 1]
        wanted = sorted({w.lower() for w in content if _TOKEN.fullmatch(w.lower())})
        n, needle = len(content), folded_phrase(phrase)
        return Option(
            self.phrases.add(needle), self.squashed.add(needle.replace(" ", "")), tuple(self.words.add(w) for w in wanted), n,
            max(1, math.ceil(n * MIN_WORD_RATIO)) if n else 1, max(3 * len(phrase), 150),
        )

    def answered(self, text: str, folded: str, source: np.ndarray) -> list[tuple[Span | None, str | None]]:
        """For each value point the span that shows it, or why there is none."""
        phrases = self.phrases.first(folded)
        squashed, letters = None, None
        places: dict[int, list[Span]] = {}
        lower = text.lower()
        for word, start, end in self.words.hits(lower):
            if (not start or not _is_word(lower[start - 1])) and (end == len(lower) or not _is_word(lower[end])):
                places.setdefault(word, []).append((start, end))
        out: list[tuple[Span | None, str | None]] = []
        for options in self.options:
            span, reason = None, None
            for o in options:
                at, origin = phrases.get(o.folded), source
                if at is None and o.folded >= 0:
                    if squashed is None:
                        squashed = self.squashed.first(folded.replace(" ", ""))
                        letters = source[_code_points(folded) != 32]
                    at, origin = squashed.get(o.run_together), letters
                if at is None:
                    continue
                a, b = int(origin[at[0]]), int(origin[at[1] - 1]) + 1
                found = len(_TOKEN.findall(text[a:b]))
                if b - a > o.limit:
                    reason = SCATTERED
                elif found < o.required:
                    reason = _too_few(found, o)
                else:
                    span = (a, b)
                    break
            out.append((span, None) if span else self._gathered(options, places, reason))
        return out

    def _gathered(self, options: list[Option], places: dict[int, list[Span]], reason: str | None) -> tuple[Span | None, str | None]:
        """Enough content words of a phrase within its longest span."""
        for o in options:
            met = [w for w in o.words if w in places]
            if not met:
                continue
            best, span = densest_window(sorted((s, e, w) for w in met for s, e in places[w]), o.limit)
            if span is not None and best >= o.required:
                return span, None
            if len(met) >= o.required:
                reason = SCATTERED
            elif not reason:
                reason = _too_few(best, o)
        return None, reason or NOTHING


def _is_word(ch: str) -> bool:
    return ch.isalnum() or ch == "_"


@lru_cache(maxsize=4096)
def scheme(points: str) -> Scheme:
    """A question's value points from JSON."""
    return Scheme(json.loads(points))
