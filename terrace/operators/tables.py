"""Merging changes into tables, row numbers over a whole table, and stratified samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], order: list[str], deleted: str | None = None) -> DataFrame:
    """target after the last change of each key (by order): changed rows replaced, new ones added, deleted ones gone.

    One shuffle on the keys; both sides meet in one aggregate, so it also merges into tables of formats
    without MERGE.  Keys match null-safely.
    """
    columns = target.columns
    row = lambda df: F.struct(*(df[c] for c in columns)).alias("__row")
    old = target.select(*keys, F.struct(F.lit(0).alias("s"), *(F.lit(None).cast(changes.schema[o].dataType).alias(f"o{i}") for i, o in enumerate(order))).alias("__at"), F.lit(False).alias("__gone"), row(target))
    new = changes.select(*keys, F.struct(F.lit(1).alias("s"), *(F.col(o).alias(f"o{i}") for i, o in enumerate(order))).alias("__at"), (F.col(deleted) if deleted else F.lit(False)).alias("__gone"), row(changes))
    last = old.unionByName(new).groupBy(*keys).agg(F.max_by(F.struct("__gone", "__row"), "__at").alias("__last"))
    return last.where(~F.coalesce(F.col("__last.__gone"), F.lit(False))).select("__last.__row.*")


def with_row_index(df: DataFrame, order: list[str], out: str, buckets: int = 64) -> DataFrame:
    """df with the place of each row in the total order, from 0, without gathering the rows in one task.

    Rows are ranged by the first column of order; each range is numbered on its own and shifted by the
    sizes of the ranges before it, which are as many numbers as there are ranges.
    """
    bounds = df.select(F.percentile_approx(F.col(order[0]).cast("double"), [i / buckets for i in range(1, buckets)]).alias("b"))
    edges = sorted({x for x in bounds.first()["b"] or []})
    part = F.size(F.filter(F.array(*(F.lit(float(x)) for x in edges)) if edges else F.array().cast("array<double>"), lambda x: x < F.col(order[0]).cast("double")))
    ranged = df.withColumn("__p", F.when(F.col(order[0]).isNull(), -1).otherwise(part))
    sizes = ranged.groupBy("__p").agg(F.count("*").alias("__n"))
    shift = sizes.select(F.col("__p").alias("__q"), (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__before"))
    numbered = ranged.withColumn("__i", F.row_number().over(Window.partitionBy("__p").orderBy(*(F.col(c).asc_nulls_first() for c in order))))
    joined = numbered.join(F.broadcast(shift), F.col("__p") == F.col("__q"))  # at most buckets + 1 rows
    return joined.withColumn(out, F.col("__before") + F.col("__i") - 1).drop("__p", "__q", "__i", "__before")


def hash_sample(df: DataFrame, key: list[str], share: float, seed: int = 0) -> DataFrame:
    """The rows whose key hashes below share: the same rows on every run and in every table with the key."""
    return df.where(F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 30)) < int(share * (1 << 30)))
