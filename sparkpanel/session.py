"""Session helpers.

The cluster names a shared checkpoint folder in ``spark.checkpoint.dir``; we
read it from the session.  Where it is unset, a session without executors of
its own (``local`` master, as in tests) gets a scratch folder; any other one is
an error, because executors would write to their own disks.
"""

from __future__ import annotations

import gc
import itertools
import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "sparkpanel", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the library relies on."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            # local mode: the driver JVM is the only executor; applies at JVM launch
            builder = builder.config("spark.driver.memory", "16g")
    conf = dict(_DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; an error on a cluster that names none."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="sparkpanel-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


_scratch = itertools.count()
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to an application's Python workers, unless they find it by PYTHONPATH or working folder."""
    package = Path(__file__).resolve().parent
    places = [os.getcwd(), *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]
    app = spark.sparkContext.applicationId
    if app in _shipped or any(Path(p, package.name).is_dir() for p in places):
        return
    zipped = Path(tempfile.mkdtemp(prefix="sparkpanel-code-"), f"{package.name}.zip")
    with zipfile.ZipFile(zipped, "w") as z:
        for f in package.rglob("*.py"):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(zipped))
    _shipped.add(app)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{spark.sparkContext.applicationId}-{next(_scratch)}"


def cut_lineage(df):
    """Reliable checkpoint (survives executor loss), never a local one.

    The frame is persisted first: an eager checkpoint otherwise computes the
    plan twice (once for the action, once to write the checkpoint files).
    """
    from pyspark import StorageLevel
    checkpoint_dir(df.sparkSession)
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = kept.checkpoint(eager=True)
    kept.unpersist()
    return out


class Saved:
    """A frame written once as compressed Parquet into the shared checkpoint folder; ``frame`` reads it.

    It takes less disk than a checkpoint or a persisted frame, a pass reads only the columns it needs, and nothing refers
    any longer to the shuffles it was made with.  The files go with ``drop``, or else when the driver ends.
    """

    def __init__(self, df):
        from pyspark import StorageLevel
        self.spark, self.path = df.sparkSession, None
        if any(t in df.schema.simpleString() for t in ("void", "interval")):     # Parquet has no such types
            self.frame = df.persist(StorageLevel.MEMORY_AND_DISK)
            return
        self.path, self.schema = scratch_path(self.spark, "saved"), df.schema
        self._at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(self._at)
        df.write.option("compression", "zstd").parquet(self.path)
        self.frame = self._read([self.path])

    def _read(self, paths: list[str]):
        return self.spark.read.schema(self.schema).parquet(*paths)

    def slices(self, n: int) -> list[tuple]:
        """The rows in up to ``n`` frames of their own files: (frame, function that deletes these files)."""
        paths = sorted(x.getPath().toString() for x in self._fs.listStatus(self._at) if x.getPath().getName().startswith("part-")) if self.path else []
        if min(n, len(paths)) < 2:
            return [(self.frame, self.drop)]
        return [(self._read(paths[i::n]), lambda some=paths[i::n]: [self._delete(x) for x in some]) for i in range(min(n, len(paths)))]

    def _delete(self, path: str) -> None:
        self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), False)

    def drop(self) -> None:
        """No frame may read from it any more."""
        if self.path:
            self._fs.delete(self._at, True)
            self._fs.cancelDeleteOnExit(self._at)
        else:
            self.frame.unpersist()


def release_unused(spark: SparkSession) -> None:
    """Have shuffle, broadcast and checkpoint files removed that no frame refers to any longer.

    Spark removes them when the driver's JVM collects its garbage; a job of many steps otherwise fills the disks before.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def local_frame(spark: SparkSession, rows: list, schema: str):
    """A small result frame (coefficients, statistics) built through Arrow, so it
    is decoded in the JVM and needs no Python worker to evaluate."""
    import pandas as pd
    from pyspark.sql.types import _parse_datatype_string

    st = _parse_datatype_string(schema)
    names = [f.name for f in st.fields]
    pdf = pd.DataFrame([list(r) for r in rows], columns=names)
    if not rows:
        return spark.createDataFrame([], st)
    return spark.createDataFrame(pdf, schema=st)
