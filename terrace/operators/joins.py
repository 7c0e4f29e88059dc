"""As-of and range joins as equi-joins and windows, and joins with salted keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], columns: list[str]) -> DataFrame:
    """left, all columns, with the given columns of right's last row of the same by whose on is at most left's.

    One shuffle: both sides are united and a window carries right's values forward; rows of right stand
    before rows of left with the same on.  Rows of left without a match, or with a null on or key, have
    nulls.  Of right's rows with the same key and on the greatest by the given columns counts.
    """
    own = left.columns
    carried = F.struct(*columns)
    a = left.select(*by, F.col(on).alias("__on"), F.lit(1).alias("__side"), F.struct(*own).alias("__row"), F.lit(None).cast(right.select(carried.alias("x")).schema["x"].dataType).alias("__carried"))
    b = right.where(F.col(on).isNotNull()).select(*by, F.col(on).alias("__on"), F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), carried.alias("__carried"))
    w = Window.partitionBy(*by).orderBy(F.col("__on").asc_nulls_first(), "__side", F.col("__carried").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.when(F.col("__on").isNotNull() & F.coalesce(*(F.when(F.col(k).isNull(), F.lit(True)) for k in by), F.lit(False)).eqNullSafe(False), F.last("__carried", ignorenulls=True).over(w))
    return a.unionByName(b).withColumn("__found", last).where("__side = 1").select("__row.*", *(F.col(f"__found.{c}").alias(c) for c in columns))


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs of points and ranges with low <= at < high, by an equi-join on cells of the given width.

    A range is repeated for each cell that it touches, so width is best near the ranges' usual length; a
    point lies in one cell.  No nested loop, whatever the sizes.
    """
    cell = lambda c: F.floor(F.col(c) / width)
    cells = ranges.where(F.col(low) < F.col(high)).withColumn("__cell", F.explode(F.sequence(cell(low), cell(high))))
    joined = points.withColumn("__cell", cell(at)).join(cells, "__cell")
    return joined.where((F.col(low) <= F.col(at)) & (F.col(at) < F.col(high))).drop("__cell")


def salted_join(left: DataFrame, right: DataFrame, on: str, salts: int, spread: Column) -> DataFrame:
    """An inner equi-join in which each key of left is dealt over salts tasks by spread; right is repeated.

    For joins whose hot keys skew-join handling can't split, as below an aggregate on the same key.
    """
    a = left.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    b = right.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return a.join(b, [on, "__salt"]).drop("__salt")
