"""Prefix encodings against the tiktoken library, appends and edits against encoding anew, round trips in Spark."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from marklake.llm.byte_pairs import PrefixEncoding, byte_pair_ids, encoder


def ids(encode, text):
    return np.frombuffer(encode(text), "<u4").tolist()


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def test_like_the_library(name):
    vocabulary, encode = encoder(name)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    draw = random.Random(1)
    texts = ["".join(draw.choice(" \n\tab'sZ09éß中文😀!  \r ") for _ in range(draw.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(draw.choice("aeiountsr") for _ in range(draw.randint(1, 40))) for _ in range(1500)]
    texts += ["a" * 3000, "-" * 2000, " " * 100, "it's  we'll\n\n x ", "x" * 50 + " \n", "<|endoftext|>", "\n", " ", "a\nb c\nd"]
    for text in texts:
        assert ids(encode, text) == library.encode_ordinary(text)


def test_appends_and_edits():
    vocabulary, _ = encoder("byte_bpe_50k.tiktoken")
    draw = random.Random(2)
    data = "".join(draw.choice("abcdehlnorst ") for _ in range(1500)).encode()
    p = PrefixEncoding(vocabulary, data[:700])
    p.append(data[700:])
    assert p.ids() == PrefixEncoding(vocabulary, data).ids()
    for _ in range(40):
        i = draw.randrange(len(p.data) + 1)
        j = min(len(p.data), i + draw.randint(0, 9))
        computed = p.edit(i, j, draw.choice([b"the", b"", b"zzz", b"longer than before"]))
        assert p.last == PrefixEncoding(vocabulary, p.data).last and len(p.last) == len(p.data) + 1
        assert computed <= 18 + 3 * vocabulary.longest


def test_rows(spark):
    rows = [(1, "Hello  world\n"), (1, "Hello  world\n"), (None, None), (2, ""), (3, "é" * 5000)]
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, ids int, decoded string")
    got = byte_pair_ids(df).collect()
    assert sorted(((r.doc_id, r.decoded) for r in got), key=str) == sorted(((k, t or "") for k, t in rows), key=str)
    assert all(r.n_tokens == len(r.ids) for r in got)
    assert byte_pair_ids(df.limit(0)).count() == 0
