"""Functions over whole groups where built-in aggregates can't express them: Arrow batches, never rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def weighted_mean(value: pd.Series, weight: pd.Series) -> float:
    """A grouped aggregate: the weighted mean, null for no weight."""
    total = float(weight.sum())
    return float(np.dot(value, weight)) / total if total else None


def moments(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """Count, mean, sample-corrected skewness and population excess kurtosis by group, from power sums.

    One partial aggregate; four sums a group move.
    """
    x = F.col(column).cast("double")
    sums = df.where(x.isNotNull()).groupBy(*by).agg(F.count(x).cast("double").alias("n"), F.avg(x).alias("m1"), *(F.avg(x**k).alias(f"m{k}") for k in (2, 3, 4)))
    n, m1, m2, m3, m4 = (F.col(c) for c in ("n", "m1", "m2", "m3", "m4"))
    var = m2 - m1**2
    skew = (m3 - 3 * m1 * m2 + 2 * m1**3) / var**1.5 * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = (m4 - 4 * m1 * m3 + 6 * m1**2 * m2 - 3 * m1**4) / var**2 - 3
    return sums.select(*by, n.cast("long").alias("n"), m1.alias("mean"), F.when((var > 0) & (n > 2), skew).alias("skewness"), F.when(var > 0, kurt).alias("kurtosis"))
