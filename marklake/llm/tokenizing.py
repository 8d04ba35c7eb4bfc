"""Token ids of whole texts from a cache of space-delimited pieces, for byte-level vocabularies split by the public pattern.

The pattern gives a word at most one space before it and never a space inside, so a text may be cut before each single
space and around each single line break that stand between other characters: the tokens stay the same. A worker keeps
the ids of the pieces it has met, as bytes; a text is then a join of cached bytes. Texts with other white space are
split by the pattern itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

import numpy as np
import public_tokenizers
import regex

_IRREGULAR = re.compile(r"[^\S \n]|\s\s|\s\Z")
_WORDS = regex.compile(public_tokenizers.PATTERN)


class _Cache(dict):
    """Pieces to values in two generations: at `most` entries the new one becomes the old one, so that frequent pieces
    stay and a worker's memory is bounded."""

    def __init__(self, make: Callable[[str], Any], most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> Any:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        self[key] = found
        return found


class PieceValues:
    """Values of whole texts, put together from those of the pattern's matches: `make` gives a match's, `join` joins."""

    def __init__(self, make: Callable[[str], Any], join: Callable[[list], Any], most: int = 300_000):
        self.join = join
        self.words = _Cache(make, most)
        self.first = _Cache(self._split, most)
        self.later = _Cache(lambda piece: self._split(" " + piece), most)

    def _split(self, text: str) -> Any:
        return self.join([self.words[w] for w in _WORDS.findall(text)])

    def __call__(self, text: str) -> Any:
        if _IRREGULAR.search(text):
            return self._split(text)
        out, later = [], self.later
        for i, line in enumerate(text.split("\n")):
            if i:
                out.append(self.words["\n"])
            head, *rest = line.split(" ")
            out.append(self.first[head])
            out += [later[piece] for piece in rest]
        return self.join(out)


def cached_encoder(encode_word: Callable[[str], bytes], most: int = 300_000) -> PieceValues:
    """Whole texts to little-endian 32-bit ids; `encode_word` gives those of one match of the pattern."""
    return PieceValues(encode_word, b"".join, most)


def printable() -> dict[int, str]:
    """The characters that stand for bytes in such vocabularies: printable Latin-1 as itself, all others from U+0100 on."""
    shown = [b for b in range(256) if chr(b).isprintable() and b != 32]
    return {b: chr(b) if b in shown else chr(256 + b - sum(x < b for x in shown)) for b in range(256)}


def library_ids(path: str, added: bool = True) -> Callable[[str], np.ndarray]:
    """Whole texts to the ids that the tokenizers library gives by its settings for a byte-level vocabulary file.

    The merges are done by rank, several times as fast. That is the same where every token, merged on its own, gives
    itself: merges come in rank order, so what lies in a token's bytes before its last merge is what lies there alone.
    Another vocabulary is refused. Added tokens are found in a text first, unless `added` is False. A text with a run of
    white space too long for the fast splitter is split by another one.
    """
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    byte, special = {c: b for b, c in printable().items()}, whole.get_added_tokens_decoder()
    vocabulary = {t: i for t, i in whole.get_vocab(with_added_tokens=False).items() if i not in special}
    if any([x.id for x in whole.model.tokenize(t)] != [i] for t, i in vocabulary.items()):
        raise ValueError(f"{path}: a token's own bytes merge into something else")
    if any(t.single_word or t.lstrip or t.rstrip for t in special.values()):
        raise ValueError("added tokens that take white space along or stand for whole words only are not supported")
    ids = {t.content: i for i, t in special.items()} if added else {}
    fast = tiktoken.Encoding(
        path, pat_str=public_tokenizers.PATTERN, special_tokens=ids,
        mergeable_ranks={bytes(byte[c] for c in t): i for t, i in vocabulary.items()},
    )
    find = re.compile("(" + "|".join(re.escape(c) for c in sorted(ids, key=len, reverse=True)) + ")") if ids else None

    def slow(text: str) -> np.ndarray:
        out: list[int] = []
        for i, part in enumerate(find.split(text) if find else [text]):
            if i % 2:
                out.append(ids[part])
            else:
                for match in _WORDS.finditer(part):
                    out += fast._core_bpe.encode_single_piece(match[0].encode())
        return np.array(out, np.uint32)

    def run(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all", disallowed_special=())
        except ValueError:
            return slow(text)

    return run
