"""The operators over their whole tables, with production parameters, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marklake.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_fingerprints(spark, sf_dir):
    from marklake.llm.fingerprints import fingerprints_with_edits

    return fingerprints_with_edits(table(spark, sf_dir, "documents"))


@query
def op2_lpt_shards(spark, sf_dir):
    from marklake.llm.sharding import shard_documents

    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op9_chosen_path(spark, sf_dir):
    from marklake.llm.near_duplicates import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


@query
def op3_grouped_packing(spark, sf_dir):
    from marklake.llm.packing import packed_sequences

    return packed_sequences(table(spark, sf_dir, "documents"), added=True)


@query
def op5_prefix_bpe(spark, sf_dir):
    from marklake.llm.byte_pairs import byte_pair_ids

    out = byte_pair_ids(table(spark, sf_dir, "documents"), digest=True)
    return out.withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})


@query
def op8_kneser_ney(spark, sf_dir):
    from marklake.llm.language_model import scored_documents

    return scored_documents(table(spark, sf_dir, "documents"))


@query
def op7_site_quality(spark, sf_dir):
    from marklake.llm.quality import quality

    out = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumn("kept", ~F.col("rejected"))


@query
def op10_toxicity_chain(spark, sf_dir):
    from marklake.llm.toxicity import toxicity

    out = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumnRenamed("rejected", "toxic")


@query
def op4_kmeans_tree(spark, sf_dir):
    from marklake.llm.neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


@query
def op6_trie_token_counts(spark, sf_dir):
    from marklake.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


@query
def op11_token_files(spark, sf_dir):
    from marklake.llm.token_files import read_token_files, write_token_files

    return read_token_files(write_token_files(table(spark, sf_dir, "documents")), digest=True)


@query
def op12_prefix_trie(spark, sf_dir):
    from marklake.llm.prefix_trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"), family=20, heads=4)


# The unsigned crc32 of a decimal: one digit after another, eight shifts each.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [1::BIGINT, 2, 3, 4, 5, 6, 7, 8]), lambda v, k: xor(v >> 1, 3988292384 * (v & 1)))))"""

ORACLES["op12_prefix_trie"] = f"""
WITH said AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), placed AS (
    SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role)::VARCHAR || ':' || role || text)) AS pos FROM said
), convs AS (
    SELECT conv_id, conv_id - conv_id % 20 AS base, {_CRC} % 4 AS h FROM (SELECT DISTINCT conv_id FROM placed)
), built AS (
    SELECT c.conv_id, coalesce(list({{'role': p.role, 'text': p.text}} ORDER BY p.pos) FILTER (WHERE p.pos IS NOT NULL), []) AS turns
    FROM convs c LEFT JOIN placed p ON (p.conv_id = c.base AND p.pos <= c.h) OR (p.conv_id = c.conv_id AND p.pos > c.h) GROUP BY c.conv_id
), prefixes AS (
    SELECT conv_id, len(turns) AS size, unnest(range(0, len(turns) + 1)) AS depth, turns FROM built
), nodes AS (
    SELECT turns[1:depth] AS prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE size = depth), '')) AS ends_sha256
    FROM prefixes GROUP BY 1, 2
), sized AS (
    SELECT n.*, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.prefix[1:n.depth] = n.prefix) AS n_children,
        CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(prefix[depth].text, '[^\x20\x09-\x0D]+')) END AS saved
    FROM nodes n
)
SELECT n.conv_id, n.depth, any_value(p.conv_id) AS parent_conv_id, any_value(n.n_convs) AS n_convs, any_value(n.n_children) AS n_children,
    count(*) FILTER (WHERE m.n_children = 0) AS n_leaves, sum(m.saved)::BIGINT AS saved_tokens, any_value(n.ends_sha256) AS ends_sha256
FROM sized n JOIN sized m ON m.depth >= n.depth AND m.prefix[1:n.depth] = n.prefix
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]
GROUP BY n.prefix, n.conv_id, n.depth
"""


@query
def op13_gnat_negatives(spark, sf_dir):
    from marklake.llm.hard_negatives import hard_negatives

    rows = table(spark, sf_dir, "embeddings")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    return hard_negatives(rows.where(finite).select("vec_id", shifted.alias("label"), whole.alias("v")), F.col("vec_id") % 50 == 0)


ORACLES["op13_gnat_negatives"] = """
WITH kept AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
    FROM kept a JOIN kept b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
    SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.other_id AS positive_id, (row_number() OVER w)::INT AS rank, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id)
QUALIFY row_number() OVER w <= 3
"""
