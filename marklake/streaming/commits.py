"""Micro-batches that count once.

A batch writes its files to a folder of its own attempt. Its manifest, a small file put in place by one rename, says
which files count; readers follow manifests only. A batch that runs again after its manifest is there does nothing, one
that runs again before leaves files that nobody reads. The sink's folder needs a file system whose rename is atomic.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _manifest(sink: str, number: int) -> str:
    return f"{sink}/_manifests/{number:020d}.json"


def attempt(sink: str) -> str:
    """A folder for the files of one attempt at a batch."""
    return f"{sink}/attempts/{uuid.uuid4().hex}"


def known(spark: SparkSession, sink: str, number: int) -> bool:
    path, fs = _path(spark, _manifest(sink, number))
    return fs.exists(path)


def commit(spark: SparkSession, sink: str, number: int, body: dict) -> bool:
    """Put a batch's manifest in place; False where another attempt has done so before."""
    final, fs = _path(spark, _manifest(sink, number))
    draft, _ = _path(spark, f"{sink}/_drafts/{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(body).encode()))
    out.close()
    fs.mkdirs(final.getParent())
    if fs.exists(final):
        fs.delete(draft, False)
        return False
    return fs.rename(draft, final)


def numbers(spark: SparkSession, sink: str) -> list[int]:
    path, fs = _path(spark, f"{sink}/_manifests")
    if not fs.exists(path):
        return []
    return sorted(int(f.getPath().getName().removesuffix(".json")) for f in fs.listStatus(path) if f.getPath().getName().endswith(".json"))


def manifest(spark: SparkSession, sink: str, number: int) -> dict:
    path, fs = _path(spark, _manifest(sink, number))
    stream = fs.open(path)
    body = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return json.loads(body)


def read_parts(spark: SparkSession, parts: list[str]) -> DataFrame:
    """The rows of the folders that count; parts may lack columns of others."""
    return spark.read.option("mergeSchema", True).parquet(*parts)
