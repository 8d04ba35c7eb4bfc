"""Phrase and number evidence in plain Python, one character and one phrase after another: what the library is held against."""

from __future__ import annotations

import math
import re
import unicodedata

from marklake.functions.phrases import MIN_WORD_RATIO, NOTHING, SCATTERED, candidates, densest_window

_TOKEN = re.compile(r"\w+")
_NUMBER = re.compile(r"-?\d+(?:\.\d+)?")


def _folded_char(ch: str) -> str:
    plain = (c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
    text = "".join(plain).lower()
    if len(text) == 1 and not text.isspace() and not _TOKEN.match(text):
        return " "  # punctuation is a soft boundary
    return " " if text.isspace() else text


def fold(text: str) -> tuple[str, list[int]]:
    """Case, accents, punctuation and spacing removed; one source offset per folded character."""
    chars: list[str] = []
    source: list[int] = []
    for at, ch in enumerate(text):
        piece = _folded_char(ch)
        if piece == " " and (not chars or chars[-1] == " "):
            continue
        for c in piece:
            chars.append(c)
            source.append(at)
    while chars and chars[-1] == " ":
        chars.pop()
        source.pop()
    return "".join(chars), source


def folded_phrase(phrase: str) -> str:
    return fold(phrase)[0]


class Answer:
    """One answer, folded and tokenised on first use and then reused for every value point."""

    def __init__(self, text: str):
        self.text = text
        self._fold = None
        self._squash = None
        self._places = None

    @property
    def folded(self):
        if self._fold is None:
            self._fold = fold(self.text)
        return self._fold

    @property
    def squashed(self):
        if self._squash is None:
            text, source = self.folded
            self._squash = (text.replace(" ", ""), [s for c, s in zip(text, source) if c != " "])
        return self._squash

    @property
    def places(self) -> dict[str, list[tuple[int, int]]]:
        if self._places is None:
            found: dict[str, list[tuple[int, int]]] = {}
            for m in _TOKEN.finditer(self.text.lower()):
                found.setdefault(m.group(), []).append(m.span())
            self._places = found
        return self._places


def _span_of(answer: Answer, phrase: str):
    """Span of a phrase in the original text; run-together words still match."""
    needle = folded_phrase(phrase)
    if not needle:
        return None
    text, source = answer.folded
    at = text.find(needle)
    if at < 0:
        needle = needle.replace(" ", "")
        text, source = answer.squashed
        at = text.find(needle)
    return None if at < 0 else (source[at], source[at + len(needle) - 1] + 1)


def _demand(phrase: str) -> tuple[tuple[str, ...], int, int, int]:
    """(content words, their count, words required, longest span allowed)."""
    content = tuple(w for w in _TOKEN.findall(phrase) if len(w) > 1)
    n = len(content)
    required = max(1, math.ceil(n * MIN_WORD_RATIO)) if n else 1
    return content, n, required, max(3 * len(phrase), 150)


def _too_few(found: int, required: int, n: int) -> str:
    return (
        f"insufficient evidence: matched {found} of {required} required content words "
        f"(N_vp={n}, M=ceil({n}*{MIN_WORD_RATIO}))"
    )


def phrase_evidence(answer: Answer, text: str, variants):
    """EXACT and STEP evidence: (span or None, reason or None)."""
    reason = None
    options = candidates(text, variants)
    for phrase in options:
        span = _span_of(answer, phrase)
        if span is None:
            continue
        _, n, required, limit = _demand(phrase)
        found = len(_TOKEN.findall(answer.text[span[0] : span[1]]))
        if span[1] - span[0] > limit:
            reason = SCATTERED
        elif found < required:
            reason = _too_few(found, required, n)
        else:
            return span, None
    places = answer.places
    for phrase in options:
        content, n, required, limit = _demand(phrase)
        wanted = {w.lower() for w in content}
        hits = sorted((s, e, w) for w in wanted for s, e in places.get(w, ()))
        if not hits:
            continue
        best, span = densest_window(hits, limit)
        if span is not None and best >= required:
            return span, None
        if len({w for _, _, w in hits}) >= required:
            reason = SCATTERED
        elif not reason:
            reason = _too_few(best, required, n)
    return None, reason or NOTHING


def numeric_evidence(answer_text: str, text: str, expected: float, tolerance, unit):
    """Span of a number within tolerance, or None.

    A value point "x = 5" wants that subject's value; the subject has no left
    boundary, so "2x = 5" satisfies "x". A unit must follow within 12 characters.
    """
    slack = tolerance if tolerance is not None else 0.0
    subject = text.split("=", 1)[0].strip() if "=" in text else ""
    if subject:
        pattern, group = re.compile(re.escape(subject) + r"\s*=\s*(-?\d+(?:\.\d+)?)", re.IGNORECASE), 1
    else:
        pattern, group = _NUMBER, 0
    for m in pattern.finditer(answer_text):
        near = abs(float(m.group(group)) - expected) <= slack
        if near and (not unit or _span_of(Answer(answer_text[m.end() : m.end() + 12]), unit) is not None):
            return m.span()
    return None
