"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import exists, made, new_path, temporary, written  # noqa: F401  for the operators here

#: What the text contracts call white space.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; lower() does just that where every character is ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def renamed(docs: DataFrame, *cols: str) -> tuple[DataFrame, list[str]]:
    """docs with columns c0, c1 ..., so that an operator's own columns clash with none, and what cols are called now."""
    names = docs.columns
    return docs.toDF(*[f"c{i}" for i in range(len(names))]), [f"c{names.index(c)}" for c in cols]


def hash_bound(n: int, k: int) -> int:
    """A bound that at least k of n hashes (long, evenly spread) lie at or below, and not many more."""
    return min((1 << 63) - 1, int((k + 6 * k**0.5 + 20) / max(1, n) * 2.0**64) - (1 << 63))


def smallest(rows: DataFrame, key: Column, n: int, k: int) -> DataFrame:
    """The k rows with the smallest key (long, evenly spread as hashes of distinct values are), of n.
    Only about k rows lie below a bound on the key, so no task sorts more."""
    return rows.where(key <= hash_bound(n, k)).orderBy(key).limit(k)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
