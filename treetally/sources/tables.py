"""Reading and writing ledger tables, requests, price lists and result documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import coerce_numeric
from .schemas import PRICE_LIST, REQUESTS, TABLES, UNIT_COST


def scan_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The four tables under folder, with their declared schemas."""
    return {name: spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in TABLES.items()}


def lookup_runs(runs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs whose id is in ids (a column id), and the ids that no run has."""
    ids = ids.select("id").where("id is not null").distinct()
    return runs.join(ids, "id", "left_semi"), ids.join(runs.select("id"), "id", "left_anti")


def _appended(rows: DataFrame, path: str) -> DataFrame:
    rows.write.mode("append").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def append_runs(accepted: DataFrame, path: str) -> DataFrame:
    """Appends accepted runs; returns the table. Rows with random ids should be written once."""
    return _appended(accepted, path)


def append_costs(priced: DataFrame, path: str) -> DataFrame:
    """Appends priced lines; whole requests were rejected before, so none is stored in part."""
    return _appended(priced, path)


def read_requests(spark: SparkSession, path: str, kind: str, stream: bool = False) -> DataFrame:
    """JSON requests of a kind: runs, costs or status."""
    return (spark.readStream if stream else spark.read).schema(REQUESTS[kind]).json(path)


def write_documents(docs: DataFrame, path: str) -> None:
    """Result documents as JSON lines; nulls are written."""
    docs.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def price_list(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cost_name, unit_cost) and rejected rows with a reason. A name that several rows price
    alike is kept once; one that they price differently is rejected, as is an unfit cost."""
    rows = raw.select(F.col("name").alias("cost_name"), F.col("costPerUnitInUsdCents").cast("string").alias("given"), coerce_numeric(F.col("costPerUnitInUsdCents"), 12, 10).cast(UNIT_COST).alias("unit_cost"))
    one = rows.groupBy("cost_name").agg(F.count_distinct("unit_cost").alias("n"), F.min("unit_cost").alias("unit_cost"), F.max(F.col("unit_cost").isNull()).alias("unfit"), F.min("given").alias("given"))
    reason = F.when(F.col("cost_name").isNull() | (F.length("cost_name") == 0), "no name").when(F.col("unfit"), "unit cost unfit").when(F.col("n") > 1, "several unit costs")
    one = one.withColumn("reason", reason)
    return one.where("reason is null").select("cost_name", "unit_cost"), one.where("reason is not null").select("cost_name", "given", "reason")


def read_price_list(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return price_list(spark.read.schema(PRICE_LIST).json(path))
