"""Byte-level BPE by prefix dynamic programming.

Of a byte string's encoding, the last token is fixed by the string, and what precedes it is the encoding of the bytes
before. So one token per prefix describes every encoding at once: the token that ends prefix i is the one vocabulary
entry t ending there whose neighbour, the last token of the prefix before t, may stand beside it. Two tokens may stand
side by side if no merge across their border would have come before the merges that made them. Appending bytes only
adds prefixes; after an edit, prefixes are recomputed until as many in a row as the longest token agree with the old ones.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marklake.llm.common import begin_task, kept_by
from marklake.llm.tokenizing import PieceValues, cached_encoder


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int], remember: int = 1_000_000):
        self.ranks, self.tokens = ranks, {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.parts: dict[int, tuple[int, int]] = {}
        self.beside: dict[tuple[int, int], bool] = {}
        self.remember = remember

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; none for a single byte."""
        found = self.parts.get(token)
        if found is None:
            data = self.tokens[token]
            if len(data) == 1:
                return None
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                best = min(range(len(parts) - 1), key=lambda i: (self.ranks.get(parts[i] + parts[i + 1], token), i))
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            found = self.parts[token] = (self.ranks[parts[0]], self.ranks[parts[1]])
        return found

    def may_adjoin(self, left: int, right: int) -> bool:
        """Whether the encoding of both tokens' bytes is these two tokens.

        The tokens are taken apart from the latest merge backwards, always the later-made of the two at the border. If
        the two parts that then touch can merge, and that merge comes before the merge just undone, it would have
        happened first. Between equal ranks the left one comes first.
        """
        known = self.beside.get((left, right))
        if known is not None:
            return known
        a, b, undone, good = left, right, None, True
        while True:
            joined = self.ranks.get(self.tokens[a] + self.tokens[b])
            # A merge at the border lies right of everything inside the left token and left of everything inside the right one.
            if joined is not None and (undone is None or (joined, 1) < undone):
                good = False
                break
            inner_a, inner_b = self.halves(a), self.halves(b)
            if inner_a is None and inner_b is None:
                break
            if inner_b is None or inner_a is not None and a > b:
                a, undone = inner_a[1], (a, 0)
            else:
                b, undone = inner_b[0], (b, 2)
        if len(self.beside) >= self.remember:
            self.beside.clear()
        self.beside[left, right] = good
        return good


class PrefixEncoding:
    """One byte string's encoding, held as the last token of each prefix."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, data, [-1]
        self._extend(len(data))

    def _ending(self, i: int) -> int:
        get, data, last, adjoin = self.vocabulary.ranks.get, self.data, self.last, self.vocabulary.may_adjoin
        for j in range(max(0, i - self.vocabulary.longest), i):
            token = get(data[j:i])
            if token is not None and (not j or adjoin(last[j], token)):
                return token
        raise ValueError("the vocabulary lacks a byte of the text")

    def _extend(self, n: int) -> None:
        for i in range(len(self.last), n + 1):
            self.last.append(self._ending(i))

    def append(self, more: bytes) -> None:
        self.data += more
        self._extend(len(self.data))

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replace bytes start to end; returns how many prefixes were computed anew."""
        old, shift, n = self.last, len(new) - (end - start), len(self.data)
        self.data = self.data[:start] + new + self.data[end:]
        self.last = old[: start + 1]
        agreed = computed = 0
        for i in range(start + 1, n + shift + 1):
            self.last.append(self._ending(i))
            computed += 1
            agreed = agreed + 1 if i - shift > end and self.last[i] == old[i - shift] else 0
            if agreed >= self.vocabulary.longest:
                self.last += old[i - shift + 1 :]
                break
        return computed

    def ids(self) -> list[int]:
        out, i = [], len(self.data)
        while i:
            out.append(self.last[i])
            i -= len(self.vocabulary.tokens[self.last[i]])
        return out[::-1]


_WORKER: dict[str, tuple[Vocabulary, PieceValues]] = kept_by("byte pairs")


def encoder(name: str) -> tuple[Vocabulary, PieceValues]:
    """This worker's vocabulary and encoder for a file of ranks."""
    if name not in _WORKER:
        vocabulary = Vocabulary(read_ranks(public_tokenizers.path(name)))
        _WORKER[name] = vocabulary, cached_encoder(lambda word: np.array(PrefixEncoding(vocabulary, word.encode()).ids(), "<u4").tobytes())
    return _WORKER[name]


def decode(vocabulary: Vocabulary, ids: bytes) -> bytes:
    return b"".join(map(vocabulary.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _encoded(name: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task("byte pairs")
        vocabulary, encode = encoder(name)
        for batch in batches:
            counts, ids, texts = [], [], []
            for text in batch.column("text"):
                got = encode(text.as_py() or "")
                back = decode(vocabulary, got)
                counts.append(len(got) // 4)
                ids.append(hashlib.sha256(got).hexdigest() if digest else np.frombuffer(got, "<u4").astype(np.int32))
                texts.append(hashlib.sha256(back).hexdigest() if digest else back.decode())
            kind = pa.string() if digest else pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, kind), pa.array(texts, pa.string())],
                names=["doc_id", "n_tokens", "ids", "decoded"],
            )

    return run


def byte_pair_ids(docs: DataFrame, vocabulary: str = "byte_bpe_multi_50k.tiktoken", digest: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): each whole text's ids and what they decode to, or the SHA-256 of both.

    A null text is empty and has no ids. Special tokens' strings are ordinary text. Every row has its row, repeated and
    null ids too; other columns are not read; an empty table gives no rows.
    """
    kind = "string" if digest else "array<int>"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_encoded(vocabulary, digest), f"doc_id long, n_tokens long, ids {kind}, decoded string")
