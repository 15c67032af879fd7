"""Incremental labelling / scoring of arriving texts (Structured Streaming).

The reference has no streaming operator; its per-row label functions and the
scorer are stateless, so they run unchanged on a streaming DataFrame.  This
helper wires a parquet folder source to a parquet sink with an
``availableNow`` trigger (process what is there, then stop) and a checkpoint
under the cluster's shared ``spark.checkpoint.dir``, so a restarted job resumes
exactly where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkpanel.session import checkpoint_dir


def stream_transform(spark: SparkSession, source_dir: str, schema, transform: Callable[[DataFrame], DataFrame],
                     sink_dir: str, name: str, max_files_per_trigger: int | None = None):
    """Run ``transform`` over every file in ``source_dir`` and append to ``sink_dir``."""
    reader = spark.readStream.schema(schema).format("parquet")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = transform(reader.load(source_dir))
    ckpt = f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}"
    q = (stream.writeStream.format("parquet").option("path", sink_dir).option("checkpointLocation", ckpt)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return q
