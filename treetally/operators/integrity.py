"""Counting violations of every declared constraint."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.schemas import FOREIGN_KEYS, TABLES


def integrity_report(tables: dict[str, DataFrame]) -> DataFrame:
    """(constraint, violations): keys held twice, references to nothing, nulls where none may
    be, and edges between organizations (allowed, but worth knowing)."""
    parts = []

    def put(name: str, count: DataFrame) -> None:
        parts.append(count.select(F.lit(name).alias("constraint"), F.coalesce(F.col("n").cast("long"), F.lit(0)).alias("violations")))

    for name, df in tables.items():
        if "external_id" in df.columns:
            put(f"{name}.external_id unique", df.where("external_id is not null").groupBy("external_id").count().where("count > 1").agg(F.count("*").alias("n")))
        required = [f.name for f in TABLES[name].fields if not f.nullable and f.name in df.columns]
        counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
        named = [F.struct(F.lit(f"{name}.{c} not null").alias("constraint"), F.col(c).alias("violations")) for c in required]
        if named:  # one scan a table
            parts.append(counts.select(F.inline(F.array(*named))))
    for name, df in tables.items():
        if "id" in df.columns or any(other == name for *_, other in FOREIGN_KEYS):
            parts.append(_by_key(tables, name))
    runs = tables["runs"]
    above = runs.select(F.col("id").alias("parent_run_id"), F.col("organization_id").alias("above"))
    put("runs.parent_run_id same organization", runs.join(above, "parent_run_id").where("above <> organization_id").agg(F.count("*").alias("n")))
    return reduce(DataFrame.unionByName, parts)


def _by_key(tables: dict[str, DataFrame], name: str) -> DataFrame:
    """Repeats of a table's key and references to keys that it lacks: its rows and all that refer to
    it are counted together by key, once, and added up before they are shuffled."""
    users = [(t, c) for t, c, other in FOREIGN_KEYS if other == name]
    rows = tables[name].select("id", F.lit(0).alias("kind"))
    for kind, (table, column) in enumerate(users, 1):
        rows = rows.unionByName(tables[table].select(F.col(column).alias("id"), F.lit(kind).alias("kind")))
    counts = rows.where("id is not null").groupBy("id").agg(*[F.count_if(F.col("kind") == k).alias(f"n{k}") for k in range(len(users) + 1)])
    lost = [F.coalesce(F.sum(F.when(F.col("n0") == 0, F.col(f"n{k}"))), F.lit(0)).alias(f"v{k}") for k in range(1, len(users) + 1)]
    sums = counts.agg(F.count_if(F.col("n0") > 1).alias("v0"), *lost)
    names = [f"{name}.id unique", *[f"{t}.{c} in {name}" for t, c in users]]
    return sums.select(F.inline(F.array(*[F.struct(F.lit(n).alias("constraint"), F.col(f"v{k}").alias("violations")) for k, n in enumerate(names)])))
