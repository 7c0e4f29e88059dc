"""User-defined functions of every kind that Spark has, registered by name on a session."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  makes pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType


@F.pandas_udf(DoubleType())
def log_scale(x: pd.Series) -> pd.Series:
    """Sign-preserving log1p, a batch at a time."""
    return np.sign(x) * np.log1p(x.abs())


class Spread:
    """A table function: the numbers from low to high."""

    def eval(self, low: int, high: int):
        for i in range(low, high + 1):
            yield (i,)


def register(spark: SparkSession) -> None:
    """log_scale (pandas), digit_sum (rows), spread (table) and discounted (SQL, inlined into the plan)."""
    spark.udf.register("log_scale", log_scale)
    spark.udf.register("digit_sum", lambda n: None if n is None else sum(map(int, str(abs(n)))), LongType())
    spark.udtf.register("spread", F.udtf(Spread, returnType="n: bigint"))
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION discounted(price DOUBLE, discount DOUBLE) RETURNS DOUBLE RETURN price * (1 - discount)")


def map_batches(df: DataFrame, column: str, out: str) -> DataFrame:
    """df with column's rank within its Arrow batch: an example of mapInArrow that keeps all other columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ranks = pa.compute.rank(b.column(b.schema.get_field_index(column)))
            yield b.append_column(out, ranks.cast(pa.int64()))

    return df.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{out}` long"]))


def cogroup_difference(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Per key the sum of a's values less that of b's, by cogrouped pandas frames."""

    def each(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        k = x[key].iloc[0] if len(x) else y[key].iloc[0]
        return pd.DataFrame({key: [k], "difference": [float(x[value].sum() - y[value].sum())]})

    kind = a.schema[key].dataType.simpleString()
    return a.groupBy(key).cogroup(b.groupBy(key)).applyInPandas(each, f"`{key}` {kind}, difference double")
