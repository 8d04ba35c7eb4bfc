"""The trie of conversation prefixes against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

from marklake.llm.prefix_trie import prefix_trie
from marklake.llm.queries import ORACLES, QUERIES

KIND = "conv_id long, turn long, role string, text string, key int, base string"


def plain(rows, family, heads):
    """Every prefix as a tuple of turns; members, children and subtrees by going through all of them."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest(), (role or "", text or "")))
    own = {c: [t[-1] for t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = c - int(math.fmod(c, family))
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    out = []
    for node, convs in members.items():
        inside = [m for m in members if m[: len(node)] == node]
        ends = sorted(c for c in convs if len(built[c]) == len(node))
        out.append((
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), sum(len(m) == len(node) + 1 for m in inside),
            sum(not any(o != m and o[: len(m)] == m for o in inside) for m in inside),
            sum((len(members[m]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", m[-1][1])) for m in inside if m),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def got(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], KIND).repartition(3)


def test_shared_prefixes_across_shards(spark):
    draw = random.Random(5)
    says = ["hello there", "hi", "", None, "tell me  more\tplease", "no\x0bno"]
    rows = []
    for c in [*range(0, 130), -1, -7, -19, -20, -25, -40, 10**15]:
        for t in range(draw.randint(1, 5)):
            rows.append((c, t, draw.choice(["user", "assistant", None]), "open" if t == 0 and draw.random() < 0.6 else draw.choice(says)))
    rows += [(None, 0, "user", "nobody"), (3, None, "user", "first"), (3, 0, "user", "tie"), (3, 0, "user", "tie")]
    rows += [(200, t, "user", f"turn {t}") for t in range(300)] + [(201, 0, "user", "one turn"), (301, 0, "user", "w " * 50_000)]
    for family, heads, shard in ((20, 4, 16), (20, 4, 4096), (1, 1, 7)):
        assert got(prefix_trie(frame(spark, rows), family, heads, shard)) == plain(rows, family, heads)


def test_copies_turnless_and_none(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(1000, 1600) for t in range(3)]
    rows += [(c, 0, "user", "only") for c in range(2001, 2020)]  # no conversation 2000: some are left without turns
    assert got(prefix_trie(frame(spark, rows), 20, 4, 32)) == plain(rows, 20, 4)
    assert len({zlib.crc32(str(c).encode()) % 4 for c in range(2001, 2020)}) == 4
    assert prefix_trie(frame(spark, []), 20, 4).count() == 0
    assert prefix_trie(frame(spark, [(None, 1, None, None)])).count() == 0


def test_given_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(QUERIES["op12_prefix_trie"](spark, "/root/testdata/sf0.01")) == plain(rows, 20, 4)


def test_the_sql_says_the_same():
    import duckdb

    rows = [tuple(r) for r in duckdb.sql("SELECT conv_id, turn, role, text FROM '/root/testdata/sf0.001/conversations.parquet'").fetchall()]
    conversations = duckdb.sql("SELECT * FROM '/root/testdata/sf0.001/conversations.parquet'")
    found = duckdb.query_df(conversations.df(), "conversations", ORACLES["op12_prefix_trie"])
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(found.project(", ".join(names)).fetchall(), key=str) == plain(rows, 20, 4)
