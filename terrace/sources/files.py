"""File sources and sinks: explicit schemas on reading, partitions and buckets on writing."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

FORMATS = ("parquet", "orc", "json", "csv", "xml", "text")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the session names in spark.checkpoint.dir; a local session without one gets a temporary folder."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='terrace-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/terrace-{name}-{uuid.uuid4().hex}"


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | str | None = None, **options: str) -> DataFrame:
    """A table of files; formats that don't carry a schema need one, so no scan is spent on inferring it."""
    if fmt not in FORMATS:
        raise ValueError(f"no such format: {fmt}")
    if schema is None and fmt in ("json", "csv", "xml"):
        raise ValueError(f"{fmt} needs a schema")
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None, mode: str = "errorifexists", **options: str) -> None:
    """One directory a partition value; rows are first gathered by it, so no task opens every directory.

    The rebalance splits large values over tasks again.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.format(fmt).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int, mode: str = "errorifexists") -> None:
    """A table whose later joins and aggregates on keys need no shuffle."""
    df.repartition(buckets, *keys).write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A database table read in parts ranges of a numeric column; the driver's jar must be on the class path."""
    return spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=parts, properties=options)
