"""Token files against the tokenizers library, and their boundaries against plain lists."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from marklake.llm.token_files import EliasFano, TokenFile, read_token_files, write_token_files
from marklake.llm.tokenizing import library_ids

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 50), st.integers(0, 2**20), st.integers(0, 2**64 - 1)), max_size=700))
def test_numbers_come_back(values):
    values = sorted(values)
    coded = EliasFano.from_bytes(EliasFano.of(np.array(values, np.uint64)).to_bytes())
    assert coded.between(0, len(values)).tolist() == values
    for i in range(0, len(values), 37):
        assert coded.select(i) == values[i]
        assert coded.below(values[i]) == values.index(values[i])
        assert coded.between(i, min(i + 70, len(values))).tolist() == values[i : i + 70]


def test_far_numbers_and_space():
    values = np.concatenate([np.arange(200_010), [2**40], np.arange(2**40, 2**40 + 300_000)]).astype(np.uint64)
    coded = EliasFano.of(values)
    assert len(coded.far) >= 1
    for i in (0, 63, 64, 200_009, 200_010, 200_011, 499_999):
        assert coded.select(i) == values[i]
    even = np.cumsum(np.random.default_rng(1).integers(1, 2000, 100_000)).astype(np.uint64)
    bits = 8 * len(EliasFano.of(even).to_bytes()) / len(even)
    assert bits < 2 + np.log2(float(even[-1]) / len(even)) + 1  # half a bit of samples; a table takes 64
    with pytest.raises(ValueError):
        EliasFano.of(np.array([2, 1], np.uint64))


def test_ids_of_the_library():
    encode = library_ids(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", " ", "a <|endoftext|> b", "<|endoftext|>" * 2, "\r\n \t x  ", "it's I'LL ١٢٣ ½", "é́ 🙂" * 9, "\x00퟿", "x" * 5000, " " * 300]
    for text in texts:
        assert encode(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    spaces = "<|endoftext|>" + " " * 1_000_000 + "x"  # too long for the fast splitter
    assert encode(spaces).tolist() == LIBRARY.encode(spaces, add_special_tokens=False).ids


def expected(rows):
    start, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_hold_whole_texts_in_order(spark):
    words = ["alpha", "beta", "<|endoftext|>", "\n", "gamma's", "  ", "世界"]
    draw = np.random.default_rng(3)
    rows = [(int(i) * 7 - 300, " ".join(draw.choice(words, draw.integers(0, 60)))) for i in draw.permutation(400)]
    rows += [(10**17, None), (-(2**62), ""), (5001, "long " * 30_000), (None, "without an id")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, start string, ids int").repartition(5)
    manifest = write_token_files(docs, most=2000)
    found = read_token_files(manifest, digest=True, piece=700).orderBy("start").collect()
    assert [tuple(r) for r in found] == expected(rows)
    whole = {r["start"]: r["ids"] for r in read_token_files(manifest).collect()}
    assert all(len(whole[r["start"]]) == r["n_tokens"] and whole[r["start"]][-1] == 0 for r in found)
    one = manifest.orderBy("start").collect()[1]
    file = TokenFile(one["file"])
    assert len(file) == one["docs"] and file.document(0).tolist() == whole[one["start"]]
    assert file.starting_before(0) == 0 and file.starting_before(1) == 1 and file.starting_before(one["tokens"]) == len(file)


def test_repeated_and_no_rows(spark):
    kind = "doc_id long, text string"
    rows = [(3, "same")] * 50 + [(3, "other"), (None, None), (None, None)]
    found = read_token_files(write_token_files(spark.createDataFrame(rows, kind), most=40), digest=True)
    assert sorted((r["start"], r["n_tokens"]) for r in found.collect())[-1][0] > 0
    assert sorted(r["n_tokens"] for r in found.collect()) == sorted(e[2] for e in expected(rows))
    assert read_token_files(write_token_files(spark.createDataFrame([], kind)), digest=True).count() == 0
