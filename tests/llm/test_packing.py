"""Plans by their properties, pieces against the tokenizers library."""

import random
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from marklake.llm.packing import packed_sequences, plan
from marklake.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, length long, piece string, _rank long"


def sequences(runs):
    out, seen = defaultdict(list), defaultdict(list)
    for length, first, n, sequence, offset in runs:
        seen[length].append((first, n))
        for k in range(n):
            out[sequence + k].append((offset, length))
    for runs_of in seen.values():
        end = 0
        for first, n in sorted(runs_of):
            assert first == end
            end += n
    return out, {x: sum(n for _, n in v) for x, v in seen.items()}


def test_plans_are_whole_gapless_and_tight():
    draw = random.Random(3)
    for n, capacity, groups, small in ((20_000, 2048, 512, 256), (3000, 2048, 16, 256), (400, 50, 4, 6), (3, 2048, 512, 256), (0, 2048, 512, 256)):
        histogram = defaultdict(int)
        for _ in range(n):
            histogram[min(capacity, max(1, int(draw.lognormvariate(np.log(capacity) - 1.4, 1))))] += 1
        bins, placed = sequences(plan(dict(histogram), capacity, groups, small))
        assert placed == dict(histogram)
        for items in bins.values():
            end = 0
            for offset, length in sorted(items):
                assert offset == end
                end += length
            assert end <= capacity
        bound = -(-sum(x * k for x, k in histogram.items()) // capacity)
        assert len(bins) <= bound * (1.01 if groups > 100 else 1.3) + 1


def test_given_and_odd_documents(spark):
    given = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(80).collect()]
    odd = [(None, None), (1, ""), (1, ""), (2, "<|endoftext|> a  b\n\n c\t"), (3, "long words here " * 3000), (4, "é 中文 😀")]
    rows = given + odd
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    model.encode_special_tokens = True
    got = packed_sequences(spark.createDataFrame([(k, t, 1, "x", 2) for k, t in rows], SCHEMA), added=False).collect()
    want = defaultdict(list)
    for k, t in rows:
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 0]
        head = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(head, len(ids) + 1, 2048)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[k, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())].append(1)
    mine = defaultdict(list)
    places = defaultdict(list)
    for r in got:
        mine[r.doc_id, r.piece, r.start, r.length, r.ids_crc32].append(1)
        places[r.sequence_id].append((r.offset, r.length))
    assert mine == want
    for items in places.values():
        end = 0
        for offset, length in sorted(items):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(places) <= -(-sum(r.length for r in got) // 2048) + 1
    assert packed_sequences(spark.createDataFrame([], SCHEMA)).count() == 0


def test_added_tokens_in_a_text_have_the_library_s_default_ids(spark, tmp_path):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|> \n\ny  ", "<|endoftext| <|<|endoftext|>|>", "plain  text\n", "", None]
    texts += [" 1 \t<|endoftext|>\n z", "w <|endoftext|> " * 900]
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in enumerate(texts)], SCHEMA)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = set()
    for k, t in enumerate(texts):
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
        want |= {(k, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))}
    for out in (corpus_pipeline.packed(spark, df, ""), QUERIES["op3_grouped_packing"](spark, str(tmp_path))):
        got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out.collect()]
        assert len(got) == len(want) and set(got) == want
