"""Counts from the trie against a plain search over each match of the pattern."""

import public_tokenizers
import regex

from marklake.llm.byte_pairs import read_ranks
from marklake.llm.token_counts import Counter, Trie, rank_scores, token_counts

RANKS = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def plain(word, scores):
    best = [(0.0, 0)] + [None] * len(word)
    for i in range(1, len(word) + 1):
        for j in range(i):
            s = scores.get(word[j:i])
            if s is not None and best[j] is not None:
                offer = (best[j][0] + s, best[j][1] - 1)
                if best[i] is None or offer > best[i]:
                    best[i] = offer
    return best[-1]


def test_trie_shares_prefixes_and_scores_like_a_plain_search():
    scores = rank_scores(RANKS)
    trie, words = Trie(scores), ["hello", "help", "hel", "thanking", "é中", "hello", "zzqqxx"]
    for w in words:
        node = trie.insert(w.encode())
        score, minus = plain(w.encode(), scores)
        assert trie.best[node] == score and trie.count[node] == -minus
    assert len(trie) == 1 + len("hello" + "p" + "thanking" + "é中".encode().decode("latin1") + "zzqqxx")


def test_given_and_odd_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(40).collect()]
    rows += [(None, None), (1, ""), (1, "a  b\n\nc "), (2, "word " * 20_000), (2, "x" * 3000)]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, n_chars string, n_tokens int")
    scores, memo = rank_scores(RANKS), {}

    def count(w):
        if w not in memo:
            memo[w] = -plain(w.encode(), {k: v for k, v in scores.items() if k in w.encode()} if len(w) > 200 else scores)[1]
        return memo[w]

    want = []
    for k, t in rows:
        words = regex.findall(public_tokenizers.PATTERN, t or "")
        want.append((k, len(t or ""), len(words), sum(map(count, words))))
    assert sorted(map(tuple, token_counts(df).collect()), key=str) == sorted(want, key=str)
    assert token_counts(df.limit(0)).count() == 0


def test_the_trie_starts_anew():
    small, large = Counter(rank_scores(RANKS), most=20), Counter(rank_scores(RANKS))
    text = "several words that together have more nodes than that"
    assert small(text) == large(text)
