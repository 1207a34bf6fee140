"""The driver's tables seen as a ledger. Ids stay bigint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pricing import price_cost_items
from .schemas import LINE_TOTAL, QUANTITY

#: How parents follow from ids: a forest of depth 4, or chains of depth 127.
FOREST = "CASE WHEN o_orderkey % 16 = 0 THEN NULL ELSE o_orderkey & (o_orderkey - 1) END"
CHAIN = "CASE WHEN o_orderkey % 128 = 0 THEN NULL ELSE o_orderkey - 1 END"

#: Expressions that Spark and DuckDB read alike.
RUN_COLUMNS = {
    "organization_id": "c_nationkey", "user_id": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END", "app_id": "o_orderpriority",
    "brand_id": "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('brand-', CAST(o_orderkey % 7 AS STRING)) END",
    "campaign_id": "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat('campaign-', CAST(o_orderkey % 9 AS STRING)) END",
    "service_name": "concat('svc-', CAST(o_orderkey % 6 AS STRING))", "task_name": "concat('task-', CAST(o_orderkey % 11 AS STRING))",
    "status": "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'running' END", "started_at": "o_orderdate",
    "completed_at": "CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderdate + INTERVAL '1' HOUR END",
}
PRICE = "CAST(CAST(p_retailprice AS DECIMAL(10,2)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(12,10))"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def organizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("external_id"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("external_id"), F.col("c_nationkey").alias("organization_id"))


def runs(spark: SparkSession, sf_dir: str, parent: str = FOREST) -> DataFrame:
    rows = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.selectExpr("o_orderkey AS id", f"{parent} AS parent_run_id", *[f"{e} AS {c}" for c, e in RUN_COLUMNS.items()])


def price_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The priced names; those whose key 97 divides are unknown."""
    return read(spark, sf_dir, "part").where("p_partkey % 97 <> 0").selectExpr("concat('part-', CAST(p_partkey AS STRING)) AS cost_name", f"{PRICE} AS unit_cost")


def cost_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of requests; a request is a run's lines."""
    return read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS run_id", "concat('part-', CAST(l_partkey AS STRING)) AS cost_name", f"CAST(l_quantity AS {QUANTITY}) AS quantity")


def runs_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    priced, _ = price_cost_items(cost_items(spark, sf_dir), price_list(spark, sf_dir), "run_id")
    return priced.select("run_id", "cost_name", "quantity", F.col("unit_cost").alias("unit_cost_in_usd_cents"), F.col("total").cast(LINE_TOTAL).alias("total_cost_in_usd_cents"))


def status_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as updates; types other than purchase and error have a status that is rejected."""
    n = read(spark, sf_dir, "orders").count()
    return read(spark, sf_dir, "events").selectExpr(
        "event_id AS request_id", f"event_id % {n} AS run_id", "CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE event_type END AS status", "ts", "event_id AS seq")


def create_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as create-run requests: some lack an app or a task, some name an empty brand, some a parent."""
    rows = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.selectExpr(
        "o_orderkey AS request_id", "o_orderdate AS ts", "o_orderkey AS seq", "concat('org-', CAST(c_custkey % 40 AS STRING)) AS clerkOrgId",
        "CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN concat('guest-', CAST(c_custkey % 100 AS STRING)) ELSE c_name END AS clerkUserId", "CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE o_orderpriority END AS appId",
        "CASE WHEN o_orderkey % 17 = 0 THEN '' WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'brand' END AS brandId", "CAST(NULL AS STRING) AS campaignId",
        "concat('svc-', CAST(o_orderkey % 6 AS STRING)) AS serviceName", "CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE 'task' END AS taskName",
        "CASE WHEN o_orderkey % 7 = 0 THEN '00000000-0000-0000-0000-000000000000' WHEN o_orderkey % 23 = 0 THEN 'parent' END AS parentRunId")


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {"organizations": organizations(spark, sf_dir), "users": users(spark, sf_dir), "runs": runs(spark, sf_dir), "runs_costs": runs_costs(spark, sf_dir)}
