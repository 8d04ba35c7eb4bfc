"""Shards of near equal size by longest-processing-time scheduling; equal texts stay together.

Groups of equal texts are scheduled in descending size, each to the least-loaded shard through a heap. What the
driver schedules is bounded whatever the input: the groups that hold a notable share of all bytes or rows, of which
there can be only so many, one by one; all others as counts per size class. A class of n equal items is scheduled at
once: the heap's outcome for equal items is to fill the lowest shards to one level. A group then finds its shard from
its number within its class.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marklake.llm.common import forget, numbered, stored


def fill(loads: list[float], size: float, n: int) -> list[int]:
    """How many of n items of one size each shard gets when every item goes to the least-loaded shard. Updates the loads."""
    counts = [0] * len(loads)
    spare = len(loads) + 1
    if n > spare:
        order = sorted(range(len(loads)), key=loads.__getitem__)
        total, level = 0.0, 0.0
        for k, i in enumerate(order, 1):  # the level that (n - spare) items reach over the k lowest shards
            total += loads[i]
            level = ((n - spare) * size + total) / k
            if k == len(order) or level <= loads[order[k]]:
                break
        for i in order:
            counts[i] = max(0, int((level - loads[i]) // size))
            loads[i] += counts[i] * size
    heap = [(x, i) for i, x in enumerate(loads)]
    heapq.heapify(heap)
    for _ in range(n - sum(counts)):
        x, i = heapq.heappop(heap)
        counts[i] += 1
        loads[i] = x + size
        heapq.heappush(heap, (x + size, i))
    return counts


def shard_documents(docs: DataFrame, shards: int = 8, share: int = 1000, exact: int = 1 << 16, ratio: float = 1.001) -> DataFrame:
    """Put documents into shards of near equal bytes: (doc_id, size, text_crc32, shard, slot).

    A document's size is the UTF-8 bytes of its text and 1; a null text counts and groups as an empty one. Groups of
    over 1/(shards * share) of all bytes or 1/(shards * share) of all rows are scheduled one by one (at most
    2 * shards * share of them). Others fall in classes: one per size up to `exact` bytes, beyond that one per step of
    `ratio`, whose items count with their mean. A size is below 2**63, so there are fewer than exact + 33,000 classes.
    `slot` is a document's place in its shard, gapless from 0. Repeated rows are documents of their own; null ids are
    allowed; other columns are not read. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.unhex(F.md5(text)).alias("_key"),
        ),
        "shard-rows",
    )
    groups = stored(rows.groupBy("_key").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_n")), "shard-groups")
    all_bytes, all_rows = groups.agg(F.coalesce(F.sum("_bytes"), F.lit(0)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    notable = (F.col("_bytes") * shards * share > all_bytes) | (F.col("_n") * shards * share > all_rows)
    step = F.floor(F.log(F.col("_bytes") / exact) / F.log(F.lit(ratio)))
    kind = F.when(F.col("_bytes") <= exact, F.col("_bytes")).otherwise(exact + 1 + step).cast("long")
    large = groups.where(notable & (F.col("_n") > 1) | (F.col("_bytes") * shards * share > all_bytes))
    small = groups.join(F.broadcast(large.select("_key")), "_key", "left_anti").withColumn("_class", kind)

    items = [(r["_bytes"], 1, r["_key"], None) for r in large.select("_key", "_bytes").collect()]
    items += [(r["s"] / r["n"], r["n"], None, r["_class"]) for r in small.groupBy("_class").agg(F.count("*").alias("n"), F.sum("_bytes").alias("s")).collect()]
    items.sort(key=lambda x: (-x[0], x[3] is not None, x[3] or 0, x[2] or b""))
    loads, single, ends = [0.0] * shards, [], []
    for size, n, key, cls in items:
        counts = fill(loads, size, n)
        if cls is None:
            single.append((key, counts.index(1)))
        else:
            ends.append((cls, pd.Series(counts).cumsum().tolist()))

    spark = docs.sparkSession
    of_class = spark.createDataFrame(ends, "_class long, _ends array<long>")
    of_key = spark.createDataFrame([(bytearray(k), s) for k, s in single], "_key binary, _single int")
    ranked = numbered(small.select("_key", "_class"), ["_class"], ["_key"])
    placed = ranked.join(F.broadcast(of_class), "_class").select(
        "_key", F.size(F.filter("_ends", lambda e: e <= F.col("_rank"))).alias("_shard")
    )
    few = rows.join(F.broadcast(of_key), "_key").withColumnRenamed("_single", "shard")
    rest = rows.join(F.broadcast(of_key.select("_key")), "_key", "left_anti").join(placed, "_key").withColumnRenamed("_shard", "shard")
    result = stored(few.select("doc_id", "size", "text_crc32", "_key", "shard").unionByName(rest.select("doc_id", "size", "text_crc32", "_key", "shard")), "shards")
    forget(rows, groups)
    return numbered(result, ["shard"], ["doc_id", "_key"]).select(
        "doc_id", "size", "text_crc32", "shard", F.col("_rank").alias("slot")
    )
