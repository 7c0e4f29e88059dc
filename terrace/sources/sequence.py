"""A Python data source: arithmetic sequences, generated by the executors, a partition a range."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.start, self.step, self.count = (int(options.get(k, d)) for k, d in (("start", 0), ("step", 1), ("count", 0)))
        self.parts = max(1, int(options.get("partitions", 4)))

    def partitions(self) -> list[InputPartition]:
        edges = [self.count * i // self.parts for i in range(self.parts + 1)]
        return [InputPartition(pair) for pair in zip(edges, edges[1:], strict=False)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for i in range(*partition.value):
            yield i, self.start + i * self.step


class Sequence(DataSource):
    """spark.read.format("sequence").option("start", 5).option("step", 2).option("count", 10).load()"""

    @classmethod
    def name(cls) -> str:
        return "sequence"

    def schema(self) -> str:
        return "i long, value long"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Sequence)
