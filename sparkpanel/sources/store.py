"""Versioned folders whose current version changes in one step (S4, M4), and append-only tables (M2).

``publish`` writes the parts of a new version into a folder of its own and then
renames a small manifest, through the session's Hadoop file system, over the
one that names the current version.  A job killed before that leaves the former
version as it was.  Older versions are removed afterwards.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MANIFEST = "CURRENT"


def _hadoop(spark: SparkSession, path: str):
    """(file system, file context, Path class) of a path."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(conf), jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), conf), jvm.org.apache.hadoop.fs.Path


def _read(spark: SparkSession, root: str) -> dict | None:
    fs, _, path = _hadoop(spark, root)
    at = path(f"{root}/{MANIFEST}")
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def publish(spark: SparkSession, root: str, write: Callable[[str], dict]) -> None:
    """``write(folder)`` writes the parts and returns what the manifest shall hold."""
    root = root.rstrip("/")
    fs, context, path = _hadoop(spark, root)
    version = uuid.uuid4().hex
    about = write(f"{root}/{version}")
    staged = path(f"{root}/.{MANIFEST}-{version}")
    stream = fs.create(staged, True)
    try:
        stream.write(bytearray(json.dumps({"version": version, **about}).encode()))
    finally:
        stream.close()
    over = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = over
    context.rename(staged, path(f"{root}/{MANIFEST}"), options)
    for status in fs.listStatus(path(root)):
        name = status.getPath().getName()
        if name not in (MANIFEST, f".{MANIFEST}.crc", version):
            fs.delete(status.getPath(), True)


def current(spark: SparkSession, root: str) -> tuple[str, dict] | None:
    """(folder, manifest) of the current version; None where nothing was published."""
    root = root.rstrip("/")
    about = _read(spark, root)
    return about and (f"{root}/{about['version']}", about)


def folders(spark: SparkSession, root: str) -> list[str]:
    """The parts of an append-only table, those that were written as a whole."""
    fs, _, path = _hadoop(spark, root)
    if not fs.exists(path(root)):
        return []
    return sorted(s.getPath().toString() for s in fs.listStatus(path(root)) if s.getPath().getName().startswith("part=") and fs.exists(path(s.getPath(), "_SUCCESS")))


def append(df: DataFrame, root: str) -> None:
    """One more part; it counts once Spark has committed it."""
    df.write.parquet(f"{root.rstrip('/')}/part={uuid.uuid4().hex}")
