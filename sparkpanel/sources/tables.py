"""Sources and sinks.

Parquet is the native format: column pruning and filter pushdown reach the
scan.  CSV is supported for the reference's hand-off files: an explicit schema,
multi-line quoted fields read in many tasks a file (``split_csv``), and FAILFAST
so a malformed row stops the job rather than silently turning into NULLs.  Arrays do not exist in CSV, so the sink
writes them as JSON text and the reader can restore them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkpanel.sources.split_csv import read_split_csv

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> dict[str, DataFrame]:
    return {n: load_table(spark, sf_dir, n) for n in names}


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
               fmt: str = "parquet", array_cols: dict[str, str] | None = None) -> DataFrame:
    """Read one table.  ``array_cols`` maps column -> element DDL for JSON-encoded arrays."""
    if fmt == "parquet":
        reader = spark.read
        if schema is not None:
            reader = reader.schema(schema)
        df = reader.parquet(path)
    elif fmt == "csv" and schema is not None:
        df = read_split_csv(spark, path, schema)
    elif fmt == "csv":
        # inferring types: Spark's multi-line reader, one task a file
        reader = (spark.read.option("header", True).option("multiLine", True).option("inferSchema", True)
                  .option("quote", '"').option("escape", '"').option("mode", "FAILFAST"))
        df = reader.csv(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")
    for c, elem in (array_cols or {}).items():
        df = df.withColumn(c, F.from_json(F.col(c), f"ARRAY<{elem}>"))
    return df


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """Write without any index column; arrays become JSON text in CSV."""
    if fmt == "csv":
        for field in df.schema.fields:
            if isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
                df = df.withColumn(field.name, F.to_json(F.col(field.name)))
        writer = df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.csv(path)
    elif fmt == "parquet":
        writer = df.write.mode(mode)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")
