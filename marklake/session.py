"""Session set-up and the few runtime settings operators read."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# A side is broadcast by hint only when its measured size stays under this.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def build_session(app: str = "marklake", cpus: str | int = "*", shuffle: int = 8) -> SparkSession:
    """Local session for tests and the bench; a cluster passes its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared checkpoint folder; make one only where none is set."""
    jsc = spark.sparkContext._jsc.sc()
    current = jsc.getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    target = configured or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(target)
    return target


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder, so lost executors do not force a recompute.

    Written as a table: a reliable checkpoint of a frame would run its plan twice, and keep rows uncompressed.
    The files stay until the application's folder is removed (`remove_checkpoints`, once nothing reads them).
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_checkpoints(spark: SparkSession) -> None:
    """Remove all that this application has stored in the checkpoint folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(ensure_checkpoint_dir(spark))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(path, True)
    fs.mkdirs(path)


def importable(spark: SparkSession) -> None:
    """Let workers import this package from its folder, wherever the driver was started; see `ship_package` for a cluster."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


def ship_package(spark: SparkSession) -> None:
    """Give executors this package, where it is neither installed there nor on their PYTHONPATH."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/marklake", "zip", root, "marklake"))


def plan_size_bytes(df: DataFrame) -> int:
    """Catalyst's own size estimate of a frame (no job is run)."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))


SPREAD_BELOW_BYTES = 64 * 1024 * 1024


def spread(df: DataFrame) -> DataFrame:
    """Spread a small input over all cores before work that is heavy per row.

    A file of one row group is one task however many cores there are. The size estimate
    decides: an input that already fills the cluster is left where it is, unshuffled.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if plan_size_bytes(df) < n * SPREAD_BELOW_BYTES else df
