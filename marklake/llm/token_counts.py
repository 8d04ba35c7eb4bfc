"""Token counts under a unigram model, by dynamic programming over a trie of distinct pre-tokens.

Each worker puts the distinct pre-tokens that it meets into a trie of bytes. A node holds the best score with which a
sequence of vocabulary tokens spells the bytes from the root to it, and how many tokens that takes; it is computed
once, from the nodes above it, and so serves every pre-token with that prefix. A pre-token's count is its last node's.
The scores are a unigram model over a given vocabulary; nothing is trained.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marklake.llm.byte_pairs import read_ranks
from marklake.llm.common import begin_task, kept_by
from marklake.llm.tokenizing import PieceValues


def rank_scores(ranks: dict[bytes, int]) -> dict[bytes, float]:
    """Log-probabilities by Zipf's law over a vocabulary's ranks."""
    total = math.log(sum(1 / (r + 1) for r in ranks.values()))
    return {token: -math.log(r + 1) - total for token, r in ranks.items()}


class Trie:
    """Nodes are numbers; 0 is the root."""

    def __init__(self, scores: dict[bytes, float]):
        self.scores, self.longest = scores, max(map(len, scores))
        self.child: dict[int, int] = {}
        self.best, self.count = [0.0], [0]

    def __len__(self) -> int:
        return len(self.best)

    def insert(self, word: bytes) -> int:
        """The word's last node; new nodes get their scores. Of equal scores the fewer tokens, then the longer last token."""
        path, get = [0], self.scores.get
        for i, byte in enumerate(word, 1):
            key = path[-1] << 8 | byte
            node = self.child.get(key)
            if node is None:
                found = None
                for j in range(max(0, i - self.longest), i):
                    score = get(word[j:i])
                    if score is not None and self.count[path[j]] >= 0:
                        offer = (self.best[path[j]] + score, -self.count[path[j]] - 1)
                        if found is None or offer > found:
                            found = offer
                node = self.child[key] = len(self.best)
                self.best.append(found[0] if found else -math.inf)
                self.count.append(-found[1] if found else -1)  # no sequence spells these bytes
            path.append(node)
        return path[-1]


class Counter:
    """Numbers of pre-tokens and tokens of whole texts. The trie starts anew at `most` nodes."""

    def __init__(self, scores: dict[bytes, float], most: int = 1_500_000):
        self.scores, self.most, self.trie = scores, most, Trie(scores)
        self.values = PieceValues(self._word, sum)

    def _word(self, word: str) -> int:
        if len(self.trie) > self.most:
            self.trie = Trie(self.scores)
        n = self.trie.count[self.trie.insert(word.encode())]
        if n < 0:
            raise ValueError("the vocabulary cannot spell a pre-token")
        return 1 << 40 | n  # both numbers in one, so that a text needs one sum

    def __call__(self, text: str) -> tuple[int, int]:
        both = self.values(text)
        return both >> 40, both & (1 << 40) - 1


_WORKER: dict[str, Counter] = kept_by("token counts")


def _counted(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task("token counts")
        if name not in _WORKER:
            _WORKER[name] = Counter(rank_scores(read_ranks(public_tokenizers.path(name))))
        count = _WORKER[name]
        for batch in batches:
            numbers = [count(text.as_py() or "") for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_chars"), *(pa.array([n[k] for n in numbers], pa.int64()) for k in (0, 1))],
                names=["doc_id", "n_chars", "n_pretokens", "n_tokens"],
            )

    return run


def token_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, n_chars, n_pretokens, n_tokens) of every whole text; a null text is empty and has none.

    Repeated and null ids have their rows, other columns are not read, an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
    return rows.mapInArrow(_counted(vocabulary), "doc_id long, n_chars long, n_pretokens long, n_tokens long")
