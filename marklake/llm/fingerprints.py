"""One-permutation MinHash fingerprints in expressions only: one hash per shingle, one bin per hash, packed low bits.

Every run of five words is hashed once. The top byte of a hash names its bin, and each of the 256 bins keeps its
smallest hash. An empty bin borrows from a bin that its own sequence of probes reaches first (optimal densification),
so the bins of like texts borrow alike. The low four bits of each bin's hash are packed, 64 to four longs; the chance
agreement of four bits, 1/16, is taken out of the likeness.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marklake.llm.common import forget, id_key, let, stored

BINS, BITS, PROBES = 256, 4, 16
_WORDS = r"[\x20\x09-\x0D]+"
_LOW = (1 << 56) - 1
_FLAGS = 0x1111111111111111


def _shingles(text: Column, width: int) -> Column:
    """One hash per run of `width` words; fewer words are one shingle together, none give none."""
    words = F.filter(F.split(F.lower(text), _WORDS), lambda w: w != "")

    def runs(h: Column) -> Column:
        last = F.size(h) - width
        return (
            F.when(F.size(h) == 0, F.array().cast("array<long>"))
            .when(last < 0, F.array(F.xxhash64(h)))
            .otherwise(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)])))
        )

    return let(F.transform(words, lambda w: F.xxhash64(w)), runs)


def _bin(x: Column) -> Column:
    return F.shiftright(x, 56) + 128


def _held(x: Column) -> Column:
    """Whether a bin holds a shingle: its mark is the largest hash that can fall in it."""
    return x.bitwiseAND(F.lit(_LOW)) != _LOW


def fingerprint(text: Column, width: int = 5) -> Column:
    """A text's packed bins as an array of longs; null for a text (or null) without words."""
    marks = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: F.shiftleft((j - 128).cast("long"), 56).bitwiseOR(F.lit(_LOW)))

    def smallest(hashes: Column) -> Column:
        return F.filter(hashes, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(hashes, i - 1))))

    def borrowed(bins: Column, held: Column, j: Column) -> Column:
        reached = F.filter(
            F.transform(F.sequence(F.lit(1), F.lit(PROBES)), lambda a: F.get(bins, F.pmod(F.xxhash64(j, a), F.lit(BINS)).cast("int"))), _held
        )
        nearest = F.array_min(F.transform(held, lambda x: F.struct(F.xxhash64(j, _bin(x)).alias("h"), x.alias("x"))))["x"]
        return let(reached, lambda found: F.when(F.size(found) > 0, F.get(found, F.lit(0))).otherwise(nearest))

    def dense(bins: Column) -> Column:
        return let(
            F.filter(bins, _held),
            lambda held: F.transform(bins, lambda x, j: F.when(_held(x), x).otherwise(borrowed(bins, held, j))),
        )

    def packed(bins: Column) -> Column:
        per = 64 // BITS
        return F.transform(
            F.sequence(F.lit(0), F.lit(BINS // per - 1)),
            lambda g: F.aggregate(
                F.slice(bins, g * per + 1, F.lit(per)),
                F.lit(0).cast("long"),
                lambda acc, x: F.shiftleft(acc, BITS).bitwiseOR(x.bitwiseAND(F.lit((1 << BITS) - 1))),
            ),
        )

    def whole(s: Column) -> Column:
        bins = let(F.sort_array(F.concat(s, marks)), smallest)
        return F.when(F.size(s) > 0, let(let(bins, dense), packed))

    return let(_shingles(F.coalesce(text, F.lit("")), width), whole)


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of shingles that two texts have in common, 0 to 1: agreeing bins without the agreement of chance.

    Two texts without words are alike; one without words is unlike any other.
    """

    def differing(x: Column, y: Column) -> Column:
        def flags(d: Column) -> Column:
            d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
            return d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(_FLAGS))

        return F.bit_count(let(x.bitwiseXOR(y), flags))

    # A nibble's upper neighbours are shifted into it only from its own four bits: the flag is its lowest bit.
    unequal = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda acc, n: acc + n)
    chance = 2.0**-BITS
    share = (1 - unequal / F.lit(float(BINS)) - chance) / (1 - chance)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(F.greatest(share, F.lit(0.0)))


def shown(packed: Column) -> Column:
    """A fingerprint as lowercase hex; empty for a text without words."""
    return F.coalesce(F.array_join(F.transform(packed, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), ""), F.lit(""))


def next_ids(ids: DataFrame) -> DataFrame:
    """(k, cut) with `next`, the next lower k, the highest again after the lowest; a range-partitioned table and one row per partition."""
    parts = stored(ids.repartitionByRange(F.desc("k")).withColumn("p", F.spark_partition_id()), "fingerprint-ids")
    down = Window.orderBy("p")
    heads = parts.groupBy("p").agg(F.max("k").alias("head"))
    heads = heads.select("p", F.coalesce(F.lead("head").over(down), F.first("head").over(down)).alias("after"))
    return parts.withColumn("lower", F.lead("k").over(Window.partitionBy("p").orderBy(F.desc("k")))).join(heads, "p").select(
        "k", "cut", F.coalesce("lower", "after").alias("next")
    )


def with_edits(docs: DataFrame) -> DataFrame:
    """(doc_id, text, k, next, edited): each text with its last third replaced by the start of the next document's."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), id_key().alias("k"), text.alias("text"))
    cut = F.floor(F.char_length("text") / 3).cast("int")
    ids = next_ids(rows.groupBy("k").agg(F.max(cut).alias("cut")))
    asked = ids.groupBy(F.col("next").alias("k")).agg(F.max("cut").alias("asked"), F.max(F.col("k")).alias("for"))
    here = rows.join(stored(ids.select("k", "next").join(asked, "k"), "fingerprint-links"), "k")
    # The id is carried along only so that both readers of `here` ask for the same columns and share one shuffle of the texts.
    start = F.struct(F.expr("substring(text, 1, asked)").alias("start"), "doc_id", "next")
    starts = here.groupBy(F.col("for").alias("k")).agg(F.min(start)["start"].alias("start"))
    kept = F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 3) as int))")
    return here.join(starts, "k").select("doc_id", "text", "k", "next", F.concat(kept, F.substring("start", F.lit(1), cut)).alias("edited"))


def fingerprints_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. A null text is
    empty; a text without words has the empty fingerprint. Documents are ordered by descending id, null ids last as
    one; the next document of repeated ids is the next lower id, whose least text stands for it. Every row of the
    table has its row. An empty table gives none. Other columns are not read.
    """
    own, edited = fingerprint(F.col("text")), fingerprint(F.col("edited"))
    rows = stored(
        with_edits(docs).select(
            "doc_id", "k", "next", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
            own.alias("a"), edited.alias("e"), F.md5("text").alias("_text"),
        ),
        "fingerprints",
    )
    following = rows.groupBy(F.col("k").alias("next")).agg(F.min_by("a", "_text").alias("b"))
    return rows.join(following, "next").select(
        "doc_id", "n_chars", "edited_sha256", shown(F.col("a")).alias("fingerprint"), shown(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("e")).alias("near_edited"), likeness(F.col("a"), F.col("b")).alias("near_next"),
    )
