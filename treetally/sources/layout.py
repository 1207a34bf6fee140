"""Runs stored by tenant and month, so that a page of one tenant reads little else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import parse_bound_ts

#: Folders that tenants are dealt to; files of a folder and month, at most, for a tenant with very many runs.
TENANTS, FILES = 64, 64
#: Runs of a file, about.
ROWS = 2_000_000


def tenant_of(organization_id: Column, tenants: int = TENANTS) -> Column:
    return F.pmod(F.xxhash64(organization_id.cast("string")), F.lit(tenants)).cast("int")


def month_of(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM")


def store_runs(runs: DataFrame, path: str, tenants: int = TENANTS, rows: int = ROWS) -> None:
    """runs under path, in folders tenant=../month=.., each file sorted by organization and start,
    so that row groups can be skipped too. A folder with many runs has several files."""
    dealt = runs.withColumns({"tenant": tenant_of(F.col("organization_id"), tenants), "month": month_of(F.col("started_at"))})
    sizes = dealt.groupBy("tenant", "month").agg(F.least(F.lit(FILES), F.ceil(F.count(F.lit(1)) / rows)).cast("int").alias("_files"))
    dealt = dealt.join(F.broadcast(sizes), ["tenant", "month"]).withColumn("_file", F.pmod(F.xxhash64("id"), "_files"))  # a row a folder
    order = ["tenant", "month", "organization_id", F.desc("started_at")]
    dealt.repartition("tenant", "month", "_file").sortWithinPartitions(*order).drop("_files", "_file").write.partitionBy("tenant", "month").parquet(path)


def runs_of(spark: SparkSession, path: str, orgs: DataFrame, org_ext: str, started_after: str | None = None, started_before: str | None = None, tenants: int = TENANTS) -> DataFrame:
    """The stored runs of one organization and range of starts: only its folders of these months are read.
    Without such an organization, none."""
    found = orgs.where(F.col("external_id") == org_ext).select("id", tenant_of(F.col("id"), tenants).alias("tenant")).distinct().collect()  # external ids are unique
    rows = spark.read.parquet(path)
    rows = rows.where(F.col("tenant").isin([r["tenant"] for r in found]) & F.col("organization_id").isin([r["id"] for r in found]))
    for text, least in ((started_after, True), (started_before, False)):
        if text:
            bound, kind = parse_bound_ts(text), rows.schema["started_at"].dataType.simpleString()
            at, month = F.col("started_at"), month_of(F.lit(text).cast(kind))
            rows = rows.where((at >= bound) & (F.col("month") >= month) if least else (at <= bound) & (F.col("month") <= month))
    return rows.drop("tenant", "month")
