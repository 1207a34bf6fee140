"""What batches leave behind, in levels of runs that are merged as they fill.

Batch n writes one run. As soon as `fan` runs of a level are complete they are merged into one
of the next level, so that a later batch reads at most (fan - 1) runs a level, however many
batches there were. Which runs there are follows from the number of batches alone, and a run is
written under its own name, so that a batch that is tried again leaves the same.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

FAN = 8


class Levels:
    """Runs under path. merge: what becomes of several runs' rows, by default all of them. files: of
    each run; by default as many as its size asks for, one if it is small."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, fan: int = FAN, merge: Callable[[DataFrame], DataFrame] = lambda rows: rows, files: int | None = None):
        self.spark, self.path, self.schema, self.fan, self.merge, self.files = spark, path, schema, fan, merge, files

    def runs(self, batches: int) -> list[str]:
        """The runs that hold the first so many batches, oldest first."""
        out, level, width = [], 0, 1
        while width * self.fan <= batches:
            level, width = level + 1, width * self.fan
        at = 0
        while width:
            while at + width <= batches:
                out.append(f"{self.path}/level={level}/run={at // width}")
                at += width
            level, width = level - 1, width // self.fan
        return out

    def read(self, batches: int) -> DataFrame:
        """What the first so many batches left."""
        names = self.runs(batches)
        rows = self.spark.read.schema(self.schema).option("basePath", self.path).parquet(*names).select(self.schema.names) if names else self.spark.createDataFrame([], self.schema)
        return self.merge(rows) if len(names) > 1 else rows

    def add(self, rows: DataFrame, batch: int) -> None:
        """Puts the rows of batch number `batch`, all earlier ones being there."""
        self._write(rows, 0, batch)
        level, width = 1, self.fan
        while (batch + 1) % width == 0:
            run = (batch + 1) // width - 1
            parts = [self.spark.read.schema(self.schema).parquet(f"{self.path}/level={level - 1}/run={run * self.fan + i}").select(self.schema.names) for i in range(self.fan)]
            self._write(self.merge(reduce(DataFrame.unionByName, parts)), level, run)
            level, width = level + 1, width * self.fan

    def _write(self, rows: DataFrame, level: int, run: int) -> None:
        rows.select(self.schema.names).repartition(*([self.files] if self.files else []), self.schema.names[0]).write.mode("overwrite").parquet(f"{self.path}/level={level}/run={run}")
