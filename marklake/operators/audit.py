"""Agreement with human markers, outliers and ratchets."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marklake.functions import text as TX
from marklake.functions.numeric import round_even
from marklake.functions.scan import before, median_of_counts, null_safe_join, value_counts
from marklake.session import BROADCAST_LIMIT_BYTES, checkpointed

MARK_STEP = 0.5
EPS = 1e-9
_STATISTIC_ROW_BYTES = 256  # sixteen numbers and their row overhead
STATISTICS = ("exact_agreement", "within_one", "mae", "mae_fraction", "qwk", "directional_bias")


def _level(mark: Column) -> Column:
    return round_even(mark / MARK_STEP)


def pair_sums(human: Column, engine: Column, max_marks: Column) -> dict[str, Column]:
    """Sums that determine every agreement statistic; they add over any partition of rows."""
    both = human.isNotNull() & engine.isNotNull()
    gap = F.when(both, engine - human)
    h, e = F.when(both, _level(human)), F.when(both, _level(engine))
    scaled = both & (max_marks > 0)
    return {
        "n": F.count(gap),
        "n_exact": F.count_if(F.abs(gap) < EPS),
        "n_within": F.count_if(F.abs(gap) <= 1.0 + EPS),
        "s_abs": F.sum(F.abs(gap)),
        "s_gap": F.sum(gap),
        "n_frac": F.count_if(scaled),
        "s_frac": F.sum(F.when(scaled, F.abs(gap) / max_marks)),
        "s_h": F.sum(h),
        "s_e": F.sum(e),
        "s_hh": F.sum(h * h),
        "s_ee": F.sum(e * e),
        "s_he": F.sum(h * e),
        "lo": F.min(F.least(h, e)),
        "hi": F.max(F.greatest(h, e)),
    }


def merge_sums() -> dict[str, Column]:
    """Re-aggregate partial ``pair_sums`` rows."""
    low_high = {"lo": F.min("lo"), "hi": F.max("hi")}
    names = [n for n in pair_sums(F.lit(0.0), F.lit(0.0), F.lit(1.0)) if n not in low_high]
    return {**{n: F.sum(n) for n in names}, **low_high}


def statistics() -> dict[str, Column]:
    """Agreement statistics from summed columns; NULL, never 0, where not computable.

    Kappa in closed form: with quadratic weights the number of levels cancels, so
    1 - S(h-e)^2 / (Shh + See - 2 Sh Se / n) equals the confusion-matrix value.
    """
    c = F.col
    n = F.when(c("n") > 0, c("n"))
    disagreement = c("s_hh") + c("s_ee") - 2.0 * c("s_he")
    chance = c("s_hh") + c("s_ee") - 2.0 * c("s_h") * c("s_e") / n
    return {
        "exact_agreement": c("n_exact") / n,
        "within_one": c("n_within") / n,
        "mae": c("s_abs") / n,
        "mae_fraction": c("s_frac") / F.when(c("n_frac") > 0, c("n_frac")),
        "qwk": F.when((c("hi") > c("lo")) & (chance != 0), 1.0 - disagreement / chance),
        "directional_bias": c("s_gap") / n,
    }


def _arm(obs: DataFrame, engine: str) -> dict[str, Column]:
    return pair_sums(F.col("human_mark"), F.col(engine), F.col("max_marks"))


def agreement(obs: DataFrame, engine: str, keys: list[str] = ()) -> DataFrame:
    """D20 + D21, overall or by key."""
    sums = obs.groupBy(*keys).agg(*[x.alias(k) for k, x in _arm(obs, engine).items()])
    return sums.select(*keys, "n", *[x.alias(k) for k, x in statistics().items()])


def human_ceiling(obs: DataFrame) -> DataFrame:
    """The second marker in the place of the engine; no double marking gives NULLs."""
    return agreement(obs, "second_human_mark").drop("mae_fraction")


def decomposition(obs: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Only rows with both arms; OCR can add error, never take it away."""
    both = obs.filter(F.col("engine_mark_a").isNotNull() & F.col("engine_mark_b").isNotNull())
    h = F.col("human_mark")
    sums = both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.abs(h - F.col("engine_mark_a"))).alias("marking_error_marks"),
        F.sum(F.abs(h - F.col("engine_mark_b"))).alias("_b"),
    )
    ocr = F.when(F.col("_b").isNotNull(), F.greatest(F.lit(0.0), F.col("_b") - F.col("marking_error_marks")))
    total = F.col("marking_error_marks") + F.col("ocr_induced_marks")
    return (
        sums.withColumn("ocr_induced_marks", ocr)
        .withColumn("marking_share", F.when(total > 0, F.col("marking_error_marks") / total))
        .withColumn("ocr_share", F.when(total > 0, F.col("ocr_induced_marks") / total))
        .drop("_b")
    )


def mark_distribution(obs: DataFrame, engine: str) -> DataFrame:
    """Deciles of the maximum, human and engine side by side."""

    def decile(mark: Column) -> Column:
        f = F.greatest(F.lit(0.0), F.least(F.lit(1.0), mark / F.col("max_marks")))
        low = F.least(F.floor(f * 10) * 10, F.lit(90))
        return F.when(mark.isNotNull(), F.concat(low.cast("string"), F.lit("-"), (low + 10).cast("string"), F.lit("%")))

    marked = obs.filter(F.col("max_marks") > 0).select(
        F.explode(
            F.array(
                F.struct(F.lit("human").alias("marker"), decile(F.col("human_mark")).alias("decile")),
                F.struct(F.lit("engine").alias("marker"), decile(F.col(engine)).alias("decile")),
            )
        ).alias("_m")
    )
    return (
        marked.filter("_m.decile is not null")
        .groupBy(F.col("_m.decile").alias("decile"))
        .agg(
            F.count_if(F.col("_m.marker") == "human").alias("human"),
            F.count_if(F.col("_m.marker") == "engine").alias("engine"),
        )
    )


def breakdown(obs: DataFrame, engine: str) -> DataFrame:
    """Overall, by subject, by type and by question in one pass.

    Rows are summed by (subject, type, question) first, so the four grouping sets
    expand the few summed rows and not the observations.
    """
    dims = ["subject", "question_type", "question_number"]
    cells = obs.groupBy(*dims).agg(*[x.alias(k) for k, x in _arm(obs, engine).items()])
    sets = cells.groupingSets([[], ["subject"], ["question_type"], ["question_number"]], *dims).agg(
        F.grouping_id().alias("_level"), *[x.alias(k) for k, x in merge_sums().items()]
    )
    label = F.when(F.col("_level") == 7, "OVERALL").when(F.col("_level") == 3, "SUBJECT").when(F.col("_level") == 5, "TYPE").otherwise("QUESTION")
    return sets.select(label.alias("breakdown"), *dims, "n", *[x.alias(k) for k, x in statistics().items()])


def outliers(scores: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows beyond 3.5 modified z-scores; fewer than 3 scores or MAD 0 give none.

    Both medians come from one count of the scores; the scores are read again only to
    pick the outlying rows.
    """
    counts = value_counts(scores, keys, value)
    center = checkpointed(median_of_counts(counts, keys))
    deviations = null_safe_join(counts, center.select(*keys, "median"), keys).groupBy(*keys, F.abs(F.col("_v") - F.col("median")).alias("_d"))
    mad = median_of_counts(checkpointed(deviations.agg(F.sum("_c").alias("_c")).withColumnRenamed("_d", "_v")), keys)
    limits = null_safe_join(center, mad.select(*keys, F.col("median").alias("mad")), keys).filter((F.col("n") >= 3) & (F.col("mad") > 0))
    z = 0.6745 * F.abs(F.col(value) - F.col("median")) / F.col("mad")
    return null_safe_join(scores, limits, keys).withColumn("modified_z", z).filter(F.col("modified_z") > 3.5)


def history_consistency(history: DataFrame, keys: list[str], chunk: str, order: list, value: str) -> DataFrame:
    """A score against the population deviation of all earlier ones.

    The running count, sum and sum of squares are carried chunk by chunk, so a
    long history is not one task's work. They are taken of the distance from the key's
    first score, so that large scores that differ little do not cancel, and equal ones
    have no deviation at all. The distance from the mean and the deviation are taken n times, without a division
    before the last: on scores of halves, say, the result is rounded once.
    """
    told = F.when(F.col(value).isNotNull(), F.struct(*[F.col(c) if isinstance(c, str) else c for c in order], F.col(value).alias("_first")))
    centre = checkpointed(history.groupBy(*keys).agg(F.coalesce(F.min(told)["_first"], F.lit(0.0)).alias("_centre")))
    v = F.col(value) - F.col("_centre")
    ran = before(
        null_safe_join(history, centre, keys),
        keys,
        chunk,
        order,
        {
            "past_n": ("sum", F.when(v.isNotNull(), 1).otherwise(0)),
            "_s": ("sum", F.coalesce(v, F.lit(0.0))),
            "_ss": ("sum", F.coalesce(v * v, F.lit(0.0))),
        },
    )
    n = F.coalesce("past_n", F.lit(0))
    spread = F.greatest(F.lit(0.0), n * F.col("_ss") - F.col("_s") * F.col("_s"))
    z = F.when((n >= 3) & (spread > 0), F.abs(n * F.coalesce(v, -F.col("_centre")) - F.col("_s")) / F.sqrt(spread))
    return (
        ran.withColumn("past_n", n).withColumn("z_score", z).withColumn("consistent", F.coalesce(F.col("z_score") <= 3.0, F.lit(True))).drop("_s", "_ss", "_centre")
    )


def ratchet(failing: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """Failures that are new, and baselined ones that now pass."""
    f, b = failing.select(*keys).distinct(), baseline.select(*keys).distinct()
    new = f.join(b, keys, "left_anti").withColumn("change", F.lit("NEW_FAILURE"))
    fixed = b.join(f, keys, "left_anti").withColumn("change", F.lit("FIXED"))
    return new.unionByName(fixed)


# --- cluster bootstrap ------------------------------------------------------------


def dense_numbers(df: DataFrame, order: str) -> DataFrame:
    """Number rows 0..N-1 in the order of a unique column, without one sorting task.

    Rows are range-partitioned and written once; the offset of each partition is
    read from one count per partition.
    """
    placed = checkpointed(
        df.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id())
    )
    part, inner = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset")
    )
    return (
        placed.withColumn("_part", part)
        .withColumn("_inner", inner)
        .join(F.broadcast(offsets), "_part")  # one row per partition
        .withColumn("row_index", F.col("_offset") + F.col("_inner"))
        .drop("_at", "_part", "_inner", "_offset")
    )


def cluster_bootstrap(
    obs: DataFrame, engine: str, resamples: int = 1000, confidence: float = 0.95, seed: int = 20260815
) -> DataFrame:
    """Interval of every statistic, resampling whole scripts with a fixed seed.

    A script is reduced to its sums, numbered 0..N-1, and meets the draws by
    number. Draws are generated in place (resample b, draw i -> md5 of seed, b, i),
    carry two bytes each, and meet a block of scripts at a time: neither a draw nor
    an observation of a resample ever is a row.
    """
    spark = obs.sparkSession
    scripts = obs.groupBy("script_id").agg(*[x.alias(k) for k, x in _arm(obs, engine).items()], F.count(F.lit(1)).alias("_rows"))
    numbered = dense_numbers(scripts, "script_id")
    n_clusters = numbered.count()
    merged = merge_sums()
    point = numbered.agg(*[x.alias(k) for k, x in merged.items()], F.sum("_rows").alias("n_observations")).select(
        "n_observations", *[x.alias(k) for k, x in statistics().items()]
    )
    stack = F.explode(F.array(*[F.struct(F.lit(s).alias("statistic"), F.col(s).alias("value")) for s in STATISTICS])).alias("_s")
    points = point.select("n_observations", stack).select("n_observations", "_s.*")
    if n_clusters < 2:
        return points.select(
            "statistic", "value", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"),
            F.lit(n_clusters).cast("bigint").alias("n_clusters"), "n_observations",
        )
    # Draws fall evenly on the numbers, so neither way is skewed: small statistics go to every task, which adds up whole
    # resamples; larger ones are cut into blocks, each of which gets its draws of all resamples.
    if n_clusters * _STATISTIC_ROW_BYTES <= BROADCAST_LIMIT_BYTES:
        held = numbered.select("row_index", *[F.col(k).cast("double").alias(k) for k in merged]).toArrow()
        order = np.argsort(held.column("row_index").to_numpy())
        matrix = spark.sparkContext.broadcast(_matrix(held, list(merged))[order])
        types = "resample bigint, " + ", ".join(f"`{k}` double" for k in merged)
        drawn = spark.range(0, resamples, 1, min(resamples, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(_drawn(matrix, seed, list(merged)), types)
        per_resample = drawn.select(*[x.alias(k) for k, x in statistics().items()])
    else:
        per_resample = _blocked_draws(numbered, n_clusters, resamples, seed)
    values = per_resample.select(stack).select("_s.*").filter("value is not null")
    return points.join(_bounds(values, [], resamples, confidence), "statistic", "left").select(
        "statistic",
        "value",
        F.when(F.col("value").isNotNull(), F.col("low")).alias("low"),
        F.when(F.col("value").isNotNull(), F.col("high")).alias("high"),
        F.lit(n_clusters).cast("bigint").alias("n_clusters"),
        "n_observations",
    )


def _matrix(table: pa.Table | pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Rows of ``pair_sums``; what is not known adds nothing, and bounds nothing."""
    unknown = {"lo": np.inf, "hi": -np.inf}
    columns = [table.column(k).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(k).to_numpy() for k in names]
    return np.stack([np.where(np.isnan(c), unknown.get(k, 0.0), c) for k, c in zip(names, columns)], 1)


def _times(weights: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Weighted sums, one row per row of weights; the last two columns are the least and the largest of what weighs anything."""
    met = weights > 0
    low, high = np.where(met, sums[:, -2], np.inf).min(1), np.where(met, sums[:, -1], -np.inf).max(1)
    return np.column_stack([weights @ sums[:, :-2], low, high])


def _drawn(matrix, seed: int, names: list[str]):
    """Sums of whole resamples: how often each script was drawn, times its sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = matrix.value
        n = len(sums)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out = np.empty((len(ids), sums.shape[1]))
            for i, b in enumerate(ids):
                weights = np.bincount(first_words(f"{seed}-{b}-", 0, n) % np.uint32(n), minlength=n)
                out[i] = _times(weights[None, :], sums)[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(out[:, c])) for c in range(len(names)))], names=["resample", *names])

    return run


_MD5_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_MD5_ADDED = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_AT_ONCE = 1 << 14  # numbers whose work arrays stay in a core's cache


def first_words(head: str, low: int, high: int) -> np.ndarray:
    """The first four bytes of md5(head + decimal k), most significant first, for k from low to below high."""
    out = np.empty(high - low, np.uint32)
    while low < high:
        end = min(high, low + _AT_ONCE, 10 ** len(str(low)))  # numbers of as many digits
        text = head.encode() + str(low).encode()
        if len(text) <= 55:
            words = _one_block(head.encode(), np.arange(low, end), len(str(low)))
        else:  # more than one block of the digest
            words = [int.from_bytes(hashlib.md5(f"{head}{k}".encode()).digest()[:4]) for k in range(low, end)]
        out[len(out) - (high - low) :][: end - low] = words
        low = end
    return out


def _one_block(head: bytes, numbers: np.ndarray, digits: int) -> np.ndarray:
    """`first_words` of numbers of so many digits whose texts fill one block, one round after the other on all numbers."""
    size = len(head) + digits
    fixed = np.frombuffer(head + bytes(digits) + b"\x80" + bytes(55 - size) + (8 * size).to_bytes(8, "little"), "<u4")
    block: list = [int(w) for w in fixed]
    for i in range(digits):
        word, byte = divmod(size - 1 - i, 4)
        block[word] = block[word] + ((numbers // 10**i % 10 + 48).astype(np.uint32) << np.uint32(8 * byte))
    a, b, c, d = (np.full(len(numbers), x, np.uint32) for x in _MD5_START)
    for i in range(64):
        turn = i // 16
        if turn == 0:
            mixed, at = ((c ^ d) & b) ^ d, i
        elif turn == 1:
            mixed, at = ((b ^ c) & d) ^ c, (5 * i + 1) % 16
        elif turn == 2:
            mixed, at = b ^ c ^ d, (3 * i + 5) % 16
        else:
            mixed, at = (b | ~d) ^ c, 7 * i % 16
        mixed += a
        if isinstance(block[at], int):
            mixed += np.uint32((block[at] + _MD5_ADDED[i]) % 2**32)
        else:
            mixed += block[at]
            mixed += np.uint32(_MD5_ADDED[i])
        left = _MD5_SHIFTS[turn][i % 4]
        turned = mixed << np.uint32(left)
        mixed >>= np.uint32(32 - left)
        turned |= mixed
        turned += b
        a, d, c, b = d, c, b, turned
    return (a + np.uint32(_MD5_START[0])).byteswap()


_BLOCK = 1 << 16  # scripts that meet their draws in one task
_DRAWS = 1 << 22  # draws of one resample that a task makes at once


def packed_draws(spark, n_clusters: int, resamples: int, seed: int) -> DataFrame:
    """(block, resample, offsets): the numbers that were drawn, as two bytes each within a block of scripts."""
    parts = -(-n_clusters // _DRAWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.column(0).to_pylist():
                b, part = divmod(at, parts)
                drawn = first_words(f"{seed}-{b}-", part * _DRAWS, min((part + 1) * _DRAWS, n_clusters))
                drawn = drawn % np.uint32(n_clusters) if n_clusters < 2**32 else drawn
                block = (drawn >> np.uint32(16)).astype(np.uint16)
                offsets = drawn.astype(np.uint16)[np.argsort(block, kind="stable")]
                sizes = np.bincount(block)
                ends = np.append(0, np.cumsum(2 * sizes)).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(offsets.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sizes))), pa.array(np.full(len(sizes), b)), packed], names=["block", "resample", "offsets"])

    slices = min(resamples * parts, max(4 * spark.sparkContext.defaultParallelism, resamples * n_clusters // 50_000_000))
    return spark.range(0, resamples * parts, 1, slices).mapInArrow(run, "block bigint, resample bigint, offsets binary")


def _blocked_draws(numbered: DataFrame, n_clusters: int, resamples: int, seed: int) -> DataFrame:
    """Statistics of each resample; a block's sums and its draws of all resamples, two bytes each, meet in one task."""
    spark, merged = numbered.sparkSession, merge_sums()
    names = list(merged)

    def met(scripts: pa.Table, draws: pa.Table) -> pa.Table:
        sums = np.zeros((_BLOCK, len(names)))
        sums[:, -2], sums[:, -1] = np.inf, -np.inf
        sums[scripts.column("row_index").to_numpy() % _BLOCK] = _matrix(scripts, names)
        weights: dict[int, np.ndarray] = {}
        for b, offsets in zip(draws.column("resample").to_pylist(), draws.column("offsets")):
            more = np.bincount(np.frombuffer(offsets.as_buffer(), np.uint16), minlength=_BLOCK)
            weights[b] = weights[b] + more if b in weights else more
        out = np.array([_times(w[None, :], sums)[0] for w in weights.values()]).reshape(-1, len(names))
        return pa.table([pa.array(list(weights), pa.int64()), *(pa.array(np.ascontiguousarray(out[:, c])) for c in range(len(names)))], names=["resample", *names])

    scripts = numbered.select(F.shiftright("row_index", 16).alias("block"), "row_index", *[F.col(k).cast("double").alias(k) for k in names])
    draws = packed_draws(spark, n_clusters, resamples, seed)
    types = "resample bigint, " + ", ".join(f"`{k}` double" for k in names)
    sums = scripts.groupBy("block").cogroup(draws.groupBy("block")).applyInArrow(met, types)
    return sums.groupBy("resample").agg(*[x.alias(k) for k, x in merged.items()]).select(*[x.alias(k) for k, x in statistics().items()])


def _bounds(values: DataFrame, keys: list[str], resamples: int, confidence: float) -> DataFrame:
    """(keys, statistic, low, high) from the statistics of each resample; none where fewer than half of them have one."""
    of = [*keys, "statistic"]
    ranked = Window.partitionBy(*of).orderBy("value")  # at most `resamples` rows each
    placed = values.select(
        *of, "value", (F.row_number().over(ranked) - 1).alias("_i"), F.count(F.lit(1)).over(Window.partitionBy(*of)).alias("_valid")
    )
    alpha = (1.0 - confidence) / 2.0
    low_i = F.floor(F.lit(alpha) * F.col("_valid"))
    high_i = F.least(F.col("_valid") - 1, F.floor(F.lit(1 - alpha) * F.col("_valid")))
    usable = F.col("_valid") >= resamples * 0.5
    return placed.groupBy(*of).agg(
        F.max(F.when(usable & (F.col("_i") == low_i), F.col("value"))).alias("low"),
        F.max(F.when(usable & (F.col("_i") == high_i), F.col("value"))).alias("high"),
    )


_PRIME = 2**31 - 1
# A Poisson(1) weight is the number of these that a uniform number below the prime reaches.
_POISSON = [math.floor(_PRIME * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(9)]


def _weighted(resamples: int, names: list[str], keys_held: int = 64, step: int = 2048):
    """Per key the weights of scripts in all resamples times the scripts' sums: one row per resample leaves a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        number = np.arange(resamples, dtype=np.int64)

        def told() -> Iterator[pa.RecordBatch]:
            for key, total in held.values():
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([key] * resamples), pa.array(number), *(pa.array(np.ascontiguousarray(total[:, c])) for c in range(len(names)))],
                    names=["key", "resample", *names],
                )
            held.clear()

        for batch in batches:
            key = batch.column("key")
            seen: dict = {}
            for i, k in enumerate(map(str, key.to_pylist())):
                seen.setdefault(k, []).append(i)
            h, g = batch.column("_h").to_numpy(), batch.column("_g").to_numpy()
            sums = _matrix(batch, names)
            for k, rows in seen.items():
                if k not in held and len(held) >= keys_held:
                    yield from told()
                if k not in held:
                    held[k] = key.slice(rows[0], 1), np.column_stack([np.zeros((resamples, len(names) - 2)), np.full(resamples, np.inf), np.full(resamples, -np.inf)])
                total = held[k][1]
                for at in range(0, len(rows), step):
                    some = np.array(rows[at : at + step])
                    uniform = (h[some] + number[:, None] * g[some]) % _PRIME
                    more = _times(np.searchsorted(_POISSON, uniform.ravel(), "right").reshape(uniform.shape), sums[some])
                    total[:, :-2] += more[:, :-2]
                    total[:, -2], total[:, -1] = np.minimum(total[:, -2], more[:, -2]), np.maximum(total[:, -1], more[:, -1])
        yield from told()

    return run


def weighted_bootstrap(
    obs: DataFrame, engine: str, keys: list[str] | None = None, resamples: int = 1000, confidence: float = 0.95, seed: int = 20260815
) -> DataFrame:
    """D26 per key: every script weighs in each resample by its own Poisson(1) number, in place of a number of draws.

    The weight is a function of (seed, script, resample): two words of an md5 per script, then one product per resample.
    No script is numbered, drawn or joined, and no row made per script and resample: a task multiplies the matrix of
    weights with that of sums, and one row per key and resample leaves it.
    """
    keys = keys or []
    scripts = obs.groupBy(*keys, "script_id").agg(*[x.alias(k) for k, x in _arm(obs, engine).items()], F.count(F.lit(1)).alias("_rows"))
    merged = merge_sums()
    points = scripts.groupBy(*keys).agg(
        *[x.alias(k) for k, x in merged.items()], F.sum("_rows").alias("n_observations"), F.count(F.lit(1)).alias("n_clusters")
    )
    stack = F.explode(F.array(*[F.struct(F.lit(s).alias("statistic"), F.col(s).alias("value")) for s in STATISTICS])).alias("_s")
    points = points.select(*keys, "n_clusters", "n_observations", *[x.alias(k) for k, x in statistics().items()])
    points = points.select(*keys, "n_clusters", "n_observations", stack).select(*keys, "n_clusters", "n_observations", "_s.*")
    digest = F.md5(F.concat(F.lit(f"{seed}-"), F.col("script_id").cast("string")).cast("binary"))
    word = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint")
    hashed = TX.bind_columns(scripts, _h=word(1) % _PRIME, _g=word(9) % (_PRIME - 1) + 1)
    staged = hashed.select(F.struct(*keys).alias("key") if keys else F.lit(0).alias("key"), "_h", "_g", *[F.col(k).cast("double").alias(k) for k in merged])
    kind = staged.schema["key"].dataType.simpleString()
    types = f"key {kind}, resample bigint, " + ", ".join(f"`{k}` double" for k in merged)
    partial = staged.mapInArrow(_weighted(resamples, list(merged)), types)
    sums = partial.groupBy("key", "resample").agg(*[x.alias(k) for k, x in merged.items()])
    sums = sums.select("key.*", *[c for c in sums.columns if c != "key"]) if keys else sums
    values = sums.select(*keys, *[x.alias(k) for k, x in statistics().items()]).select(*keys, stack).select(*keys, "_s.*").filter("value is not null")
    bounds = _bounds(values, keys, resamples, confidence)
    known = (F.col("value").isNotNull()) & (F.col("n_clusters") >= 2)
    return null_safe_join(points, bounds, [*keys, "statistic"], "left").select(
        *keys, "statistic", "value", F.when(known, F.col("low")).alias("low"), F.when(known, F.col("high")).alias("high"), "n_clusters", "n_observations"
    )
