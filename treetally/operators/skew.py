"""Joins to a table with one row a key, where few keys hold very many rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

#: Rows of a key that one task may get, about. A key with more is spread.
SPLIT = 1_000_000
#: Ways in which rows without a key are dealt, as they would share one null key.
SPREAD = 1 << 12


def heavy_keys(counts: DataFrame, key: str, n: str = "n", split: int = SPLIT) -> DataFrame:
    """(key, ways) of the keys of over `split` rows, given the rows of each: a `split`th of all rows at most."""
    return counts.where(F.col(key).isNotNull() & (F.col(n) > split)).select(key, F.ceil(F.col(n) / split).cast("int").alias("_ways"))


def lookup(rows: DataFrame, table: DataFrame, key: str, by: Column, heavy: DataFrame | None = None, how: str = "left", split: int = SPLIT) -> DataFrame:
    """rows joined (left or inner) to table, which has one row a key at most. The rows of a heavy
    key are dealt to several tasks by a hash of `by` (a stored column in which they differ, so
    that a task that is run again deals alike), and the table's row is repeated for each; so no key's rows meet in one task.

    heavy: as heavy_keys gives it, by default from a count of rows. It is written first, so that
    its size is known when the joins with it are planned: small, it is broadcast and rows are
    shuffled once, by key and way."""
    heavy = heavy_keys(rows.groupBy(key).agg(F.count("*").alias("n")), key, split=split) if heavy is None else heavy
    heavy, ways = written(heavy, "heavy"), F.coalesce("_ways", F.lit(1))
    way = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(by), F.lit(SPREAD))).otherwise(F.pmod(F.xxhash64(by), ways)).cast("int")
    left = rows.join(heavy, key, "left").withColumn("_way", way).drop("_ways")
    right = table.join(heavy, key, "left").withColumn("_way", F.explode(F.sequence(F.lit(0), ways - 1))).drop("_ways")
    return left.join(right, [key, "_way"], how).drop("_way")
