"""The trie of conversation prefixes, grown from vertical bitmaps of shards and merged by prefix.

Conversations are range-partitioned by id, and cut into shards of a few thousand. Texts stay where they are: a turn
travels as a 128-bit digest of role and text, its number of words beside it. A shard indexes every (position, turn) by
the bitset of its conversations and grows its trie depth first: a node's bitset, intersected with the posting of the
turn that its smallest remaining member has at the next position, is a child; what is left gives the next one. Members
are popcounts, the members that end at a node are its end list.

Shards are merged by the 128-bit hash of a prefix with a number of shuffles that does not depend on the depth. Members
add up. A distinct node counts in the shard of its smallest member only, so that sums over subtrees of distinct nodes
are sums over shards of sums over their own subtrees. Ids of shards ascend, so a node's end lists, in the order of
their shards, are its members in ascending order: they are hashed as they stream by.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marklake.llm.common import begin_task, stored

WORDS = r"[^\x20\x09-\x0D]+"
ROOT = bytes(16)
_NODES = pa.schema([
    ("shard", pa.int64()), ("node", pa.int64()), ("parent", pa.int64()), ("depth", pa.int64()), ("key", pa.binary()), ("first", pa.int64()),
    ("n", pa.int64()), ("words", pa.int64()), ("inner", pa.bool_()), ("ended", pa.list_(pa.int64())),
])

Conversation = tuple[int, list[tuple[bytes, int]]]  # its id; each turn's digest and number of words


def grow(conversations: list[Conversation]) -> list[tuple]:
    """Nodes of one shard's trie in depth-first order: (parent, depth, key, smallest member, members, words of the last
    text, whether it has children, end list). Conversations come in ascending order of their ids."""
    postings: dict[tuple[int, bytes], int] = defaultdict(int)
    ending: dict[int, int] = defaultdict(int)
    for i, (_, turns) in enumerate(conversations):
        bit = 1 << i
        for at, (digest, _) in enumerate(turns):
            postings[at, digest] |= bit
        ending[len(turns)] |= bit
    out: list[tuple] = []
    stack = [((1 << len(conversations)) - 1, -1, 0, ROOT, 0)] if conversations else []
    while stack:
        members, parent, depth, key, words = stack.pop()
        me, ended = len(out), members & ending.get(depth, 0)
        rest, below = members ^ ended, []
        while rest:
            digest, count = conversations[(rest & -rest).bit_length() - 1][1][depth]
            child = rest & postings[depth, digest]
            below.append((child, me, depth + 1, hashlib.blake2b(key + digest, digest_size=16).digest(), count))
            rest ^= child
        stack += reversed(below)
        ends = []
        while ended:
            low = ended & -ended
            ends.append(conversations[low.bit_length() - 1][0])
            ended ^= low
        first = conversations[(members & -members).bit_length() - 1][0]
        out.append((parent, depth, key, first, members.bit_count(), words, bool(below), ends))
    return out


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[int, tuple[int, list]]]:
    """Conversations of one family, which arrive together: their heads and turns by id."""
    family, held = None, {}
    for batch in batches:
        for base, conv, head, digest, words in zip(*(batch.column(c).to_pylist() for c in ("base", "conv_id", "head", "digest", "words"))):
            if base != family:
                if held:
                    yield held
                family, held = base, {}
            held.setdefault(conv, (base, head, []))[2].append((digest, words))
    if held:
        yield held


def _sharded(size: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task("prefix-trie")
        shard, waiting, turns_waiting = TaskContext.get().partitionId() << 32, [], 0

        def grown() -> pa.RecordBatch:
            nodes = grow(waiting)
            parent, depth, key, first, n, words, inner, ended = zip(*nodes)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(([shard] * len(nodes), range(len(nodes)), parent, depth, key, first, n, words, inner, ended), _NODES)],
                schema=_NODES,
            )

        for family in _families(batches):
            for conv in sorted(family):
                base, head, own = family[conv]
                turns = family[base][2][:head] + own[head:] if base in family else own[head:]
                waiting.append((conv, turns))
                turns_waiting += len(turns)
            if len(waiting) >= size or turns_waiting >= most:
                yield grown()
                shard, waiting, turns_waiting = shard + 1, [], 0
        if waiting:
            yield grown()

    return run


def _subtrees(shard: pa.Table) -> pa.Table:
    """What each node of a shard adds to its prefix: sums over its subtree are differences of running sums."""
    order = np.argsort(shard.column("node").to_numpy(), kind="stable")
    column = {c: shard.column(c).to_numpy()[order] for c in ("parent", "depth", "first", "n", "words", "owner", "inner_anywhere")}
    count, parent = len(order), column["parent"]
    size = np.ones(count, np.int64)
    for i in range(count - 1, 0, -1):
        size[parent[i]] += size[i]
    own = column["first"] == column["owner"]

    def below(x: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(x)])
        return total[np.arange(count) + size] - total[:-1]

    children = np.bincount(parent[own & (parent >= 0)], minlength=count)
    above = np.where(parent >= 0, column["owner"][parent], 0)
    return pa.table({
        "key": shard.column("key").take(pa.array(order)), "depth": pa.array(column["depth"]), "conv_id": pa.array(column["owner"]),
        "parent_conv_id": pa.array(above, mask=parent < 0), "n_convs": pa.array(column["n"]), "n_children": pa.array(children),
        "n_leaves": pa.array(below((own & ~column["inner_anywhere"].astype(bool)).astype(np.int64))),
        "saved_tokens": pa.array(below((column["n"] - own) * column["words"])),
    })


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each prefix's end lists, which come in order, as comma-joined decimals."""
    key, digest, out = None, None, []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([d for _, d in out], pa.string())], names=["key", "ends_sha256"])

    for b in batches:
        for k, ids in zip(b.column("key").to_pylist(), b.column("ended").to_pylist()):
            text = ",".join(map(str, ids)).encode()
            if k == key:
                digest.update(b"," + text)
            else:
                if key is not None:
                    out.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256(text)
        if len(out) >= 10_000:
            yield batch()
            out.clear()
    if key is not None:
        out.append((key, digest.hexdigest()))
    yield batch()


def prefix_trie(conversations: DataFrame, family: int = 1, heads: int = 1, shard: int = 4096, most: int = 1 << 20) -> DataFrame:
    """One row per distinct prefix: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    Reads conv_id, turn, role and text. Turns are ordered by `turn`, null first, then by the MD5 of role and text; a null
    role or text is empty. With `family` and `heads` above 1 a conversation c starts with the first crc32(c) % heads
    turns of conversation c - c % family, if that exists, instead of its own. Rows of a null conv_id take no part; a
    repeated turn is a turn of its own; a conversation left without turns is a member of the root; an empty table gives
    no rows, not even the root. A very long text is read once, for its digest and its words. A shard holds about `shard`
    conversations or `most` turns; one family of conversations, 20 bytes a turn, must fit a task.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    conv = F.col("conv_id").cast("long")
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        (conv - conv % family).alias("base"), conv.alias("conv_id"), "turn", (F.crc32(conv.cast("string")) % heads).cast("int").alias("head"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("digest"),
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"),
    )
    placed = turns.repartitionByRange("base").sortWithinPartitions("base", "conv_id", F.col("turn").asc_nulls_first(), "digest").drop("turn")
    kinds = "shard long, node long, parent long, depth long, key binary, first long, n long, words long, inner boolean, ended array<long>"
    nodes = stored(placed.mapInArrow(_sharded(shard, most), kinds), "trie-nodes")

    owners = nodes.groupBy("key").agg(F.min("first").alias("owner"), F.max("inner").cast("int").alias("inner_anywhere"))
    known = nodes.select("shard", "node", "parent", "depth", "key", "first", "n", "words").join(owners, "key")
    parts = known.groupBy("shard").applyInArrow(
        _subtrees,
        "key binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long",
    )
    least, total = ("depth", "conv_id", "parent_conv_id"), ("n_convs", "n_children", "n_leaves", "saved_tokens")
    merged = parts.groupBy("key").agg(*(F.min(c).alias(c) for c in least), *(F.sum(c).alias(c) for c in total))
    ends = nodes.where(F.size("ended") > 0).select("key", F.col("ended")[0].alias("from"), "ended")
    ends = ends.repartition("key").sortWithinPartitions("key", "from").select("key", "ended").mapInArrow(_hashed, "key binary, ends_sha256 string")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return merged.join(ends, "key", "left").select(
        "conv_id", "depth", "parent_conv_id", *total, F.coalesce("ends_sha256", none).alias("ends_sha256")
    )
