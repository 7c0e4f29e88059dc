"""Event streams: watermarked windows, duplicates, interval joins and custom state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from terrace.sources.files import scratch


def read_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = 1) -> DataFrame:
    """The Parquet files called name below folder as a stream; an NTZ time becomes one that watermarks take."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", name).parquet(folder)
    times = [f.name for f in schema if f.dataType.typeName() == "timestamp_ntz"]
    return rows.withColumns({c: F.col(c).cast("timestamp") for c in times})


def run(stream: DataFrame, mode: str, checkpoint: str | None = None) -> DataFrame:
    """Everything the source has, in as many batches as it takes; the result as Parquet in the shared folder.

    Each batch writes its own folder, anew if it is repeated; complete mode overwrites the one before.
    """
    path = scratch(stream.sparkSession, "stream")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={0 if mode == 'complete' else number}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(put).trigger(availableNow=True)
    query = writer.option("checkpointLocation", checkpoint or scratch(stream.sparkSession, "progress")).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(path)


def tumbling(rows: DataFrame, at: str, size: str, keys: list[str], late: str, value: str) -> DataFrame:
    windows = rows.withWatermark(at, late).groupBy(F.window(at, size).alias("w"), *keys)
    return windows.agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sliding(rows: DataFrame, at: str, size: str, step: str, late: str, value: str) -> DataFrame:
    windows = rows.withWatermark(at, late).groupBy(F.window(at, size, step).alias("w"))
    return windows.agg(F.count("*").alias("n"), F.round(F.max(value), 4).alias("most")).select(F.col("w.start").alias("window_start"), "n", "most")


def sessions(rows: DataFrame, at: str, gap: str, keys: list[str], late: str) -> DataFrame:
    """Sessions that a pause of gap ends; in append mode each comes once, when the watermark has passed its end."""
    windows = rows.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), *keys)
    return windows.agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def unique(rows: DataFrame, at: str, keys: list[str], late: str) -> DataFrame:
    """Rows whose keys weren't seen within the watermark; state is dropped behind it."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def interval_join(left: DataFrame, right: DataFrame, key: str, at: str, within: str, late: str) -> DataFrame:
    """Pairs of one key in which right comes at most within after left; both sides' state is bounded by time."""
    a = left.withWatermark(at, late).alias("a")
    b = right.withWatermark(at, late).alias("b")
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col(f"b.{at}") >= F.col(f"a.{at}")) & (F.col(f"b.{at}") <= F.col(f"a.{at}") + F.expr(f"INTERVAL {within}")))


def running_totals(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Per key and batch the number of rows and the sum of value so far, by custom state."""

    def step(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for part in parts:
            n, total = n + len(part), total + float(part[value].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [group[0]], "n": [n], "total": [total]})

    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)
