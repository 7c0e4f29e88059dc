"""Streams on hand-made batches: late rows, duplicates, state that lives on."""

import datetime as dt

from pyspark.sql import functions as F

from terrace.streaming import events

SCHEMA = "id long, user_id long, ts timestamp, value double"


def at(minute: int) -> dt.datetime:
    return dt.datetime(2024, 1, 1, 12) + dt.timedelta(minutes=minute)


def batches(spark, folder, *parts):
    """One file a batch, in order of time of writing."""
    import os
    import shutil

    os.makedirs(f"{folder}/in", exist_ok=True)
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/part{i}")
        (name,) = [f for f in os.listdir(f"{folder}/part{i}") if f.endswith(".parquet")]
        shutil.move(f"{folder}/part{i}/{name}", f"{folder}/in/{i}.parquet")
        os.utime(f"{folder}/in/{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_late_rows_are_dropped_behind_the_watermark(spark, tmp_path):
    rows = batches(spark, tmp_path, [(1, 1, at(0), 1.0), (2, 1, at(30), 1.0)], [(4, 1, at(31), 1.0)], [(3, 1, at(1), 5.0)], [(5, 1, at(60), 1.0)])
    found = events.run(events.tumbling(rows, "ts", "10 minutes", ["user_id"], "5 minutes", "value"), "append").collect()
    assert {(r["window_start"], r["n"]) for r in found} == {(at(0), 1), (at(30), 2)}


def test_duplicates_within_the_watermark(spark, tmp_path):
    rows = batches(spark, tmp_path, [(1, 1, at(0), 1.0), (1, 1, at(0), 1.0)], [(1, 1, at(1), 1.0), (2, 1, at(2), 1.0)])
    found = events.run(events.unique(rows, "ts", ["id"], "10 minutes").select("id"), "append").collect()
    assert sorted(r["id"] for r in found) == [1, 2]


def test_totals_go_on_from_batch_to_batch(spark, tmp_path):
    rows = batches(spark, tmp_path, [(1, 7, at(0), 1.0), (2, 8, at(0), 2.0)], [(3, 7, at(1), 3.0)])
    found = events.run(events.running_totals(rows.select("user_id", "value"), "user_id", "value"), "update")
    assert {(r["user_id"], r["n"], r["total"]) for r in found.collect()} == {(7, 1, 1.0), (8, 1, 2.0), (7, 2, 4.0)}


def test_sliding_equals_batch(spark, tmp_path):
    rows = [(i, 1, at(7 * i), float(i)) for i in range(10)]
    found = events.run(events.sliding(batches(spark, tmp_path, rows), "ts", "20 minutes", "10 minutes", "1 hour", "value"), "complete")
    batch = spark.createDataFrame(rows, SCHEMA).groupBy(F.window("ts", "20 minutes", "10 minutes").alias("w")).agg(F.count("*").alias("n"), F.max("value").alias("most")).select(F.col("w.start").alias("window_start"), "n", "most")
    assert sorted(found.collect()) == sorted(batch.collect())
