"""What a DataFrame's physical plan does: its nodes, exchanges, pushed filters and read columns."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame


def plan_text(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df: DataFrame) -> str:
    """The plan with what each scan pushes down and reads, uncut."""
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def nodes(df: DataFrame) -> Counter:
    """How often each physical operator stands in the plan."""
    found = (re.match(r"[\s:|+*\-]*(?:\(\d+\)\s)?([A-Z]\w+)", line) for line in plan_text(df).splitlines())
    return Counter(m[1] for m in found if m)


def exchanges(df: DataFrame) -> int:
    """Shuffles, without broadcasts."""
    return nodes(df)["Exchange"]


def pushed_filters(df: DataFrame) -> list[str]:
    return [x for x in re.findall(r"PushedFilters: \[(.*)\]", formatted(df)) if x]


def read_columns(df: DataFrame) -> list[list[str]]:
    """The columns that each scan reads."""
    return [re.findall(r"(\w+):", x) for x in re.findall(r"ReadSchema: struct<(.*?)>$", formatted(df), re.M)]


def has_nested_loop(df: DataFrame) -> bool:
    return any(re.search("NestedLoop|CartesianProduct", n) for n in nodes(df))
