"""Shards: the closed form against the heap, groups, balance, slots."""

import heapq
import random
import zlib
from collections import Counter, defaultdict

from marklake.llm.sharding import fill, shard_documents

SCHEMA = "doc_id long, text string, shard int, _key string, size string"


def shards(spark, rows, **options):
    return shard_documents(spark.createDataFrame([(k, t, 9, "x", "y") for k, t in rows], SCHEMA), **options).collect()


def check(rows, got, n=8):
    want = Counter((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots, of_text, load = defaultdict(list), defaultdict(set), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        of_text[r.text_crc32, r.size].add(r.shard)
        load[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of_text.values())
    return [load[i] for i in range(n)]


def test_equal_items_fill_as_a_heap_does():
    draw = random.Random(1)
    for _ in range(300):
        loads, size, n = [draw.randint(0, 2000) for _ in range(draw.randint(1, 9))], draw.randint(1, 60), draw.randint(0, 400)
        heap = [(float(x), i) for i, x in enumerate(loads)]
        heapq.heapify(heap)
        for _ in range(n):
            x, i = heapq.heappop(heap)
            heapq.heappush(heap, (x + size, i))
        mine = [float(x) for x in loads]
        assert sum(fill(mine, size, n)) == n
        assert sorted(mine) == sorted(x for x, _ in heap)


def test_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    load = check(rows, shards(spark, rows))
    assert max(load) - min(load) <= 128


def test_groups_hot_rows_and_odd_rows(spark):
    rows = [(i, "same text") for i in range(400)] + [(i, "z" * (i % 97)) for i in range(600)] + [(None, None), (None, None), (7, ""), (8, "q" * 200_000)]
    load = check(rows, shards(spark, rows))
    assert max(load) >= 200_001 and sorted(load)[-2] < 20_000
    load = check(rows, shards(spark, rows, share=2, exact=16, ratio=1.1))
    assert len(load) == 8
    assert shards(spark, []) == []
