"""Structured Streaming jobs (S1-S4) and the rules they share with their batch twins."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import PySparkException, PythonException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marklake.functions.scan import null_safe_join
from marklake.operators import dashboards as D
from marklake.session import checkpointed
from marklake.streaming import commits

GENERIC_FAILURE = "Evaluation failed. Please try again."


def file_stream(spark: SparkSession, schema: T.StructType, folder: str, pattern: str, files_per_batch: int = 100) -> DataFrame:
    """Parquet files that arrive in a folder, a bounded number per micro-batch; `pattern` names files, or folders of files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/{pattern}")


def run_available(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process what has arrived, then stop; the same code runs with a timed trigger."""
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(handler)
        .start()
    )
    query.awaitTermination()


# --- S1: incremental grading -----------------------------------------------------------------


# Error conditions that a row's own content brings about. Anything else (a lost executor, a full disk) is
# not a submission's fault and stops the batch, which then runs again.
OF_THE_DATA = {
    "CAST_INVALID_INPUT", "CAST_OVERFLOW", "DIVIDE_BY_ZERO", "ARITHMETIC_OVERFLOW", "NUMERIC_VALUE_OUT_OF_RANGE", "INVALID_ARRAY_INDEX",
    "INVALID_ARRAY_INDEX_IN_ELEMENT_AT", "USER_RAISED_EXCEPTION", "CANNOT_PARSE_TIMESTAMP", "MALFORMED_RECORD_IN_PARSING",
}


def of_the_data(error: Exception) -> bool:
    if isinstance(error, PythonException):
        return "MemoryError" not in str(error)
    condition = error.getCondition() if isinstance(error, PySparkException) else None
    return (condition or "").split(".")[0] in OF_THE_DATA


def grade_increment(grade: Callable[[DataFrame], DataFrame], is_bad: Column, sink: str, key: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch handler: each submission is graded, or FAILED by itself, and counts once.

    Submissions that are unusable are FAILED at once. `grade` may catch what stops a row where it happens, and give it in
    a column `error_message`; such rows are FAILED with it. Where grading stops altogether on an error of the data, the
    rows are graded in halves, by a hash of `key`, until the submissions that stop it stand alone. Other errors stop the
    batch: the stream runs it again. Read the outcome with `graded`.
    """

    def put(rows: DataFrame, status: str | Column, message: Column, folder: str) -> None:
        rows.withColumn("status", F.lit(status) if isinstance(status, str) else status).withColumn("error_message", message).write.parquet(folder)

    def settle(rows: DataFrame, folder: str, part: str, parts: list[str]) -> None:
        where = f"{folder}/p{part}-{len(parts)}"
        try:
            out = grade(rows)
            said = F.col("error_message") if "error_message" in out.columns else F.lit(None).cast("string")
            put(out, F.when(said.isNull(), "COMPLETED").otherwise("FAILED"), said, where)
            parts.append(where)
        except Exception as error:
            if not of_the_data(error):
                raise
            if len(rows.select(key).distinct().take(2)) < 2:
                put(rows, "FAILED", F.lit(f"{GENERIC_FAILURE} {str(error)[:500]}"), f"{where}-failed")
                parts.append(f"{where}-failed")
                return
            half = F.pmod(F.xxhash64(F.lit(len(part)), F.col(key)), F.lit(2))
            for i in (0, 1):
                side = rows.filter(half == i)
                if not side.isEmpty():
                    settle(side, folder, f"{part}{i}", parts)

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if commits.known(spark, sink, number):
            return
        folder, kept = commits.attempt(sink), batch.persist()
        try:
            parts = [f"{folder}/unusable"]
            put(kept.filter(is_bad), "FAILED", F.lit(GENERIC_FAILURE), parts[0])
            settle(kept.filter(~F.coalesce(is_bad, F.lit(False))), folder, "", parts)
            commits.commit(spark, sink, number, {"parts": parts})
        finally:
            kept.unpersist()

    return handle


def graded(spark: SparkSession, sink: str) -> DataFrame:
    """All submissions of committed batches with their status and error_message."""
    return commits.read_parts(spark, [part for n in commits.numbers(spark, sink) for part in commits.manifest(spark, sink, n)["parts"]])


# --- S2: lifecycle ------------------------------------------------------------------------------

# The order of stages; FAILED may follow any stage but COMPLETED.
STAGES = ["UPLOADED", "PROCESSING", "OCR_COMPLETE", "EVALUATING", "COMPLETED"]
_TIMES = {"uploaded": "UPLOADED", "processing": "PROCESSING", "ocr": "OCR_COMPLETE", "evaluating": "EVALUATING", "completed": "COMPLETED", "failed": "FAILED"}


def stage_rank(status: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STAGES]), status)


def lifecycle_sums(events: DataFrame) -> DataFrame:
    """What is kept of each submission: the last time of every status and two counts. All of it merges in any order."""
    status = F.col("status")
    return events.groupBy("submission_id").agg(
        *[F.max(F.when(status == s, F.col("ts"))).alias(c) for c, s in _TIMES.items()],
        F.count_if(stage_rank(status) > 0).alias("n_stage_events"),
        F.count_if(status == "FAILED").alias("n_failures"),
    )


def merged_sums(sums: DataFrame) -> DataFrame:
    """Sums of the same submission from several sources as one."""
    counts = ("n_stage_events", "n_failures")
    return sums.groupBy("submission_id").agg(*[F.max(c).alias(c) for c in _TIMES], *[F.sum(c).alias(c) for c in counts])


def lifecycle_states(sums: DataFrame) -> DataFrame:
    """(submission_id, status, ocr_status, evaluation_status, furthest stage, stages seen, failures).

    A completed submission stays so; a failure stands unless a later stage event follows it. A stage's own status is that
    of its last event, so a second run of a stage shows as PROCESSING again. Late events cannot undo progress.
    """
    stages = list(_TIMES)[:5]
    furthest = F.coalesce(*[F.when(F.col(c).isNotNull(), i) for i, c in reversed(list(enumerate(stages, 1)))], F.lit(0))
    last_stage = F.greatest(*stages)
    failed = F.col("failed").isNotNull() & F.col("completed").isNull() & (last_stage.isNull() | (F.col("failed") >= last_stage))
    own = lambda begun, done: F.when(F.col(done).isNotNull() & (F.col(begun).isNull() | (F.col(done) >= F.col(begun))), "COMPLETED").when(F.col(begun).isNotNull(), "PROCESSING")
    return sums.select(
        "submission_id",
        F.when(failed, "FAILED").when(furthest > 0, F.element_at(F.array(*[F.lit(s) for s in STAGES]), F.greatest(furthest, F.lit(1)))).alias("status"),
        own("processing", "ocr").alias("ocr_status"), own("evaluating", "completed").alias("evaluation_status"),
        furthest.cast("bigint").alias("furthest_stage"), "n_stage_events", "n_failures",
    )


def lifecycle(events: DataFrame) -> DataFrame:
    """S2 over a stored log. ``events``: submission_id, status, ts."""
    return lifecycle_states(lifecycle_sums(events))


def _last_known(sums: DataFrame) -> DataFrame:
    """The last event of each submission as a row of its history."""
    times = F.array(*[F.struct(F.col(c).alias("ts"), F.lit(s).alias("status")) for c, s in _TIMES.items()])
    return sums.select("submission_id", F.array_max(F.filter(times, lambda t: t.ts.isNotNull())).alias("known"))


def illegal_transitions(events: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Events that no run of the pipeline brings about: (submission_id, event_id, ts, status, previous).

    A stage follows the one before it, or itself; the first event is UPLOADED; a failed submission starts again at
    PROCESSING or fails again; FAILED follows any stage but COMPLETED, and nothing follows that. Events are ordered by
    time, then event_id. ``before`` holds sums of earlier events.
    """
    order = Window.partitionBy("submission_id").orderBy("ts", "event_id")
    previous = F.lag("status").over(order)
    if before is not None:
        events = events.join(_last_known(before), "submission_id", "left")
        previous = F.coalesce(previous, F.col("known.status"))
    seen = events.withColumn("previous", previous)
    rank, last = stage_rank(F.col("status")), stage_rank(F.col("previous"))
    legal = (
        F.when(F.col("previous").isNull(), F.col("status") == "UPLOADED")
        .when(F.col("previous") == "COMPLETED", F.lit(False))
        .when(F.col("status") == "FAILED", F.lit(True))
        .when(F.col("previous") == "FAILED", F.col("status") == "PROCESSING")
        .otherwise((rank == last) | (rank == last + 1))
    )
    return seen.filter(~F.coalesce(legal, F.lit(False))).select("submission_id", "event_id", "ts", "status", "previous")


def once(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """A stream of events without what is delivered twice within `delay`; older ones are forgotten by the watermark."""
    timed = events.withColumn("_event_time", F.col("ts").cast("timestamp")).withWatermark("_event_time", delay)
    return timed.dropDuplicatesWithinWatermark(["event_id"]).drop("_event_time")


def merge_lifecycle(sink: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """foreachBatch handler that keeps each submission's sums in bucketed files and rewrites only the buckets that a
    micro-batch touches.

    The sums are the only state: Spark keeps none per submission. A batch's manifest names the current folder of every
    bucket and the folders of rejected events, so that a batch that runs again changes nothing.
    """

    def bucket() -> Column:
        return F.pmod(F.xxhash64("submission_id"), F.lit(buckets)).cast("int")

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if commits.known(spark, sink, number):
            return
        earlier = [n for n in commits.numbers(spark, sink) if n < number]
        state = commits.manifest(spark, sink, earlier[-1]) if earlier else {"buckets": {}, "rejected": []}
        folder, kept = commits.attempt(sink), batch.persist()
        try:
            sums = lifecycle_sums(kept).withColumn("bucket", bucket())
            touched = [r["bucket"] for r in sums.select("bucket").distinct().collect()]  # at most one row per bucket
            old = [state["buckets"][str(b)] for b in touched if str(b) in state["buckets"]]
            before = spark.read.schema(sums.drop("bucket").schema).parquet(*old) if old else None
            illegal_transitions(kept, before).write.parquet(f"{folder}/rejected")
            whole = merged_sums(sums.drop("bucket").unionByName(before)) if old else sums.drop("bucket")
            whole.withColumn("bucket", bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{folder}/sums")
            now = state["buckets"] | {str(b): f"{folder}/sums/bucket={b}" for b in touched}
            commits.commit(spark, sink, number, {"buckets": now, "rejected": [*state["rejected"], f"{folder}/rejected"]})
        finally:
            kept.unpersist()

    return handle


def current_lifecycle(spark: SparkSession, sink: str) -> DataFrame:
    """The states that the last committed batch left."""
    parts = commits.manifest(spark, sink, commits.numbers(spark, sink)[-1])["buckets"].values()
    return lifecycle_states(commits.read_parts(spark, list(parts)))


def rejected_events(spark: SparkSession, sink: str) -> DataFrame:
    return commits.read_parts(spark, commits.manifest(spark, sink, commits.numbers(spark, sink)[-1])["rejected"])


# --- S3: login lockout ------------------------------------------------------------------------------

MAX_FAILURES = 5
LOCK = pd.Timedelta(minutes=15)
LOCKOUT_SCHEMA = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("event_id", T.LongType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("failed_attempts", T.LongType()),
    ]
)
_STATE = T.StructType([T.StructField("failures", T.LongType()), T.StructField("locked_until", T.LongType())])


def _attempt(failures: int, locked_until: int, at: int, success: bool) -> tuple[int, int, str]:
    """One login attempt. The counter outlives the lock, so the next failure locks again."""
    if locked_until > at:
        return failures, locked_until, "LOCKED"
    if success:
        return 0, 0, "SUCCESS"
    failures += 1
    if failures >= MAX_FAILURES:
        return failures, at + LOCK.value, "WRONG_PASSWORD_LOCKS"
    return failures, locked_until, "WRONG_PASSWORD"


def _fold(at: list[int], success: list[bool], failures: int, locked_until: int) -> tuple[list[str], list[int], int, int]:
    outcomes, counts = [], []
    for t, ok in zip(at, success):
        failures, locked_until, outcome = _attempt(failures, locked_until, t, ok)
        outcomes.append(outcome)
        counts.append(failures)
    return outcomes, counts, failures, locked_until


def _attempts(events: DataFrame) -> DataFrame:
    """``events``: event_id, user_id, ts, success -> times in nanoseconds."""
    at = (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("at")
    return events.select("user_id", "event_id", at, "success")


# A run of attempts as a function of the state before it. A state is the number of failures and the end of a lock. From
# MAX_FAILURES - 1 failures on, every state without a lock acts alike but for its number, and a lock, which never lasts
# more than LOCK into a run, only skips attempts at its start. A way through a run ends in (number, end of the lock,
# whether the number counts on from the state before it).

_End = tuple[int, int, bool]


def transitions(at: list[int], success: list[bool]) -> tuple[list[int], list[_End], list[_End]]:
    """Times of the attempts at which a lock can end and one more; the end of the way from each of them with many
    failures; and from the start with 0, 1, ... failures."""
    n = len(at)
    after = np.searchsorted(np.array(at, np.int64), np.array(at, np.int64) + LOCK.value).tolist()
    many: list[_End] = [(0, 0, True)] * (n + 1)
    none: list[_End] = [(0, 0, False)] * (n + 1)

    def locked(i: int, number: int, on: bool) -> _End:
        """A failure at i locks; `number` failures then, counted on or not."""
        j = after[i]
        if j == n:
            return number, at[i] + LOCK.value, on
        end = many[j]
        return (number + end[0], end[1], on) if end[2] else end

    def few(i: int, failures: int) -> _End:
        while i < n:
            if success[i]:
                return none[i + 1]
            failures += 1
            if failures >= MAX_FAILURES:
                return locked(i, failures, False)
            i += 1
        return failures, 0, False

    for i in range(n - 1, -1, -1):
        many[i] = none[i + 1] if success[i] else locked(i, 1, True)
        none[i] = few(i, 0)
    head = int(np.searchsorted(np.array(at, np.int64), at[0] + LOCK.value)) if n else 0
    return at[:head], many[: head + 1], [few(0, k) for k in range(MAX_FAILURES - 1)]


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows of equal keys, which come together, as one table."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(k).to_pylist() for k in keys]
        rows = list(zip(*values))
        cuts = [0, *[i for i in range(1, len(rows)) if rows[i] != rows[i - 1]], len(rows)]
        for a, b in zip(cuts, cuts[1:]):
            if rows[a] != current:
                if held:
                    yield current, pa.Table.from_batches(held)
                current, held = rows[a], []
            held.append(batch.slice(a, b - a))
    if held:
        yield current, pa.Table.from_batches(held)


_ENDS = pa.list_(pa.struct([("number", pa.int64()), ("until", pa.int64()), ("on", pa.bool_())]))
_SUMMARY = pa.schema([("user_id", pa.int64()), ("chunk", pa.int64()), ("head", pa.list_(pa.int64())), ("many", _ENDS), ("few", _ENDS)])
_ENDS_DDL = "array<struct<number:bigint,until:bigint,on:boolean>>"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (user, chunk), rows in _runs(batches, ["user_id", "chunk"]):
        head, many, few = transitions(rows.column("at").to_pylist(), rows.column("success").to_pylist())
        each = lambda ends: [dict(zip(("number", "until", "on"), e)) for e in ends]
        yield pa.RecordBatch.from_pylist([{"user_id": user, "chunk": chunk, "head": head, "many": each(many), "few": each(few)}], schema=_SUMMARY)


_ENTRY = pa.schema([("user_id", pa.int64()), ("chunk", pa.int64()), ("failures", pa.int64()), ("locked_until", pa.int64())])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state before each chunk, from one chunk's function to the next."""
    current, failures, locked_until = None, 0, 0
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if current is None or row["user_id"] != current[0]:
                current, failures, locked_until = (row["user_id"],), 0, 0
            out.append({"user_id": row["user_id"], "chunk": row["chunk"], "failures": failures, "locked_until": locked_until})
            start = bisect_left(row["head"], locked_until)  # attempts while locked change nothing
            end = row["many"][start] if start or failures >= MAX_FAILURES - 1 else row["few"][failures]
            if end["on"]:
                failures, locked_until = failures + end["number"], max(locked_until, end["until"])
            else:
                failures, locked_until = end["number"], end["until"]
        yield pa.RecordBatch.from_pylist(out, schema=_ENTRY)


def _outcomes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by user, chunk and time, each with the state before its chunk; only a chunk's state is kept."""
    current, failures, locked_until = None, 0, 0
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("user_id", "chunk", "at", "success", "failures", "locked_until")]
        outcomes, counts = [], []
        for user, chunk, at, success, before, until in zip(*columns):
            if (user, chunk) != current:
                current, failures, locked_until = (user, chunk), before, until
            failures, locked_until, outcome = _attempt(failures, locked_until, at, success)
            outcomes.append(outcome)
            counts.append(failures)
        yield pa.RecordBatch.from_arrays(
            [batch.column("user_id"), batch.column("event_id"), pa.array(outcomes, pa.string()), pa.array(counts, pa.int64())],
            names=["user_id", "event_id", "outcome", "failed_attempts"],
        )


def lockout_batch(events: DataFrame, hours: int = 24) -> DataFrame:
    """S3 over a stored log. A user's attempts are cut into chunks of `hours`; each chunk becomes a function of the state
    before it, a user's functions are applied one after another, and then every chunk is played from its own state: a
    user who only ever fails is many tasks' work. A chunk's attempts must fit a task, and of its function there is one
    row per attempt of its first 15 minutes.
    """
    order = ["user_id", "chunk", "at", "event_id"]
    attempts = _attempts(events).withColumn("user_id", F.col("user_id").cast("bigint")).withColumn("success", F.coalesce("success", F.lit(False)))
    chunked = attempts.withColumn("chunk", F.floor(F.col("at") / (hours * 3_600_000_000_000)).cast("bigint"))
    sorted_chunks = chunked.repartition("user_id", "chunk").sortWithinPartitions(*order).select("user_id", "chunk", "at", "success")
    functions = sorted_chunks.mapInArrow(_summaries, f"user_id bigint, chunk bigint, head array<bigint>, many {_ENDS_DDL}, few {_ENDS_DDL}")
    entries = functions.repartition("user_id").sortWithinPartitions("user_id", "chunk").mapInArrow(
        _entries, "user_id bigint, chunk bigint, failures bigint, locked_until bigint"
    )
    played = null_safe_join(chunked, checkpointed(entries), ["user_id", "chunk"])
    placed = played.repartition("user_id", "chunk").sortWithinPartitions(*order)
    return placed.select(*order, "success", "failures", "locked_until").mapInArrow(_outcomes, LOCKOUT_SCHEMA)


def _stateful(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    failures, locked_until = state.get if state.exists else (0, 0)
    rows = pd.concat(batches).sort_values(["at", "event_id"], kind="stable")
    outcomes, counts, failures, locked_until = _fold(rows["at"].tolist(), rows["success"].tolist(), failures, locked_until)
    if failures:
        state.update((failures, locked_until))
    elif state.exists:
        state.remove()  # as if never seen
    yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"].to_numpy(), "outcome": outcomes, "failed_attempts": counts})


def lockout_stream(events: DataFrame) -> DataFrame:
    """S3 on an audit stream: per user the counter and the lock time are kept as state, while there are failures.

    The counter outlives the lock and has no end, so time alone frees no state; a success does. A micro-batch is ordered
    per user; how much of a user it can hold is bounded by the source's files per trigger.
    """
    return _attempts(events).groupBy("user_id").applyInPandasWithState(
        _stateful, LOCKOUT_SCHEMA, _STATE, "append", GroupStateTimeout.NoTimeout
    )


# --- S4: live dashboard ---------------------------------------------------------------------------------


def live_dashboard(submissions: DataFrame) -> DataFrame:
    """The monitoring aggregates per exam; as a stream, in update or complete mode."""
    return submissions.groupBy("exam_id").agg(*D.monitoring_aggregates())
