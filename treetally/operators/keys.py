"""Get-or-create of tenant keys and existence checks, as set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import null_if_empty
from .skew import SPLIT, heavy_keys, lookup


def _stamped(rows: DataFrame, new_id: Column | None) -> DataFrame:
    return rows.withColumns({"id": F.uuid() if new_id is None else new_id, "created_at": F.current_timestamp(), "updated_at": F.current_timestamp()})


def resolve_orgs(requests: DataFrame, orgs: DataFrame, new_id: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """requests with organization_id, and the organizations to add. Existing ones keep their id.

    A tenant with very many requests is dealt to several tasks. New ids are random unless new_id (of external_id) is given; write the second result before
    using both, or give new_id."""
    new = new_orgs(requests, orgs, new_id)
    keys = orgs.select("external_id", "id").unionByName(new.select("external_id", F.col("id").cast(orgs.schema["id"].dataType).alias("id")))
    return with_orgs(requests, keys), new


def new_orgs(requests: DataFrame, orgs: DataFrame, new_id: Column | None = None) -> DataFrame:
    """The organizations to add of requests."""
    wanted = requests.select(F.col("clerkOrgId").alias("external_id")).where("external_id is not null").distinct()
    return _stamped(wanted.join(orgs.select("external_id"), "external_id", "left_anti"), new_id).select("id", "external_id", "created_at", "updated_at")


def with_orgs(requests: DataFrame, orgs: DataFrame, heavy: DataFrame | None = None) -> DataFrame:
    """requests with organization_id, all organizations being known. heavy: of the tenants, as lookup takes it."""
    return lookup(requests, orgs.select(F.col("external_id").alias("clerkOrgId"), F.col("id").alias("organization_id")), "clerkOrgId", F.col("request_id"), heavy)


def resolve_users(requests: DataFrame, users: DataFrame, new_id: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """requests (with organization_id) with user_id, and the users to add. A user is known by
    external id alone; a new one belongs to the organization of its first request."""
    new = new_users(requests, users, new_id)
    keys = users.select("external_id", "id").unionByName(new.select("external_id", F.col("id").cast(users.schema["id"].dataType).alias("id")))
    return with_users(requests, keys), new


def new_users(requests: DataFrame, users: DataFrame, new_id: Column | None = None) -> DataFrame:
    """The users to add of requests (with organization_id)."""
    wanted = requests.where("clerkUserId is not null").groupBy(F.col("clerkUserId").alias("external_id")).agg(F.min_by("organization_id", F.struct("ts", "seq")).alias("organization_id"))
    return _stamped(wanted.join(users.select("external_id"), "external_id", "left_anti"), new_id).select("id", "external_id", "organization_id", "created_at", "updated_at")


def with_users(requests: DataFrame, users: DataFrame, heavy: DataFrame | None = None) -> DataFrame:
    """requests with user_id, all users being known. heavy: of the users, as lookup takes it."""
    return lookup(requests, users.select(F.col("external_id").alias("clerkUserId"), F.col("id").alias("user_id")), "clerkUserId", F.col("request_id"), heavy)


def _told(rows: DataFrame, runs: DataFrame, key: str, split: int) -> DataFrame:
    """rows with _there, true where key is a run and else null. Distinct keys are checked, with how
    many rows each has; rows are then joined to what was found, those of a key that over `split`
    rows have dealt to many tasks."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    there = counts.join(runs.select(F.col("id").alias(key)), key, "left_semi").select(key, F.lit(True).alias("_there"))
    return lookup(rows, there, key, F.xxhash64("request_id"), heavy_keys(counts, key, split=split))


def _exists(rows: DataFrame, runs: DataFrame, key: str, reason: Column, split: int) -> tuple[DataFrame, DataFrame]:
    told = _told(rows, runs, key, split)
    return told.where("_there").drop("_there"), told.where("_there is null").drop("_there").withColumn("reason", reason)


def check_parent_exists(requests: DataFrame, runs: DataFrame, split: int = SPLIT) -> tuple[DataFrame, DataFrame]:
    """A parent must be stored already; requests without one pass."""
    given = requests.where(F.col("parentRunId").isNotNull())
    good, bad = _exists(given, runs, "parentRunId", F.concat(F.lit("parentRunId "), F.col("parentRunId").cast("string"), F.lit(" does not exist")), split)
    return good.unionByName(requests.where(F.col("parentRunId").isNull())), bad


def check_run_exists(requests: DataFrame, runs: DataFrame, split: int = SPLIT) -> tuple[DataFrame, DataFrame]:
    return _exists(requests, runs, "run_id", F.lit("run not found"), split)


def judged_run_exists(requests: DataFrame, runs: DataFrame, split: int = SPLIT) -> DataFrame:
    """requests (with reason) with the reason of check_run_exists where they had none."""
    missing = F.when(F.col("_there").isNull(), "run not found")
    return _told(requests, runs, "run_id", split).withColumn("reason", F.coalesce("reason", missing)).drop("_there")


def update_target_exists(updates: DataFrame, runs: DataFrame, split: int = SPLIT) -> tuple[DataFrame, DataFrame]:
    return _exists(updates, runs, "run_id", F.lit("run not found"), split)


def apply_run_defaults(requests: DataFrame, new_id: Column | None = None) -> DataFrame:
    """Runs as stored: random id, status running, all times now, empty optional texts null."""
    now = F.current_timestamp()
    optional = {"brand_id": "brandId", "campaign_id": "campaignId", "parent_run_id": "parentRunId"}
    return requests.select(
        (F.uuid() if new_id is None else new_id).alias("id"), null_if_empty(F.col(optional["parent_run_id"])).alias("parent_run_id"), "organization_id", "user_id",
        F.col("appId").alias("app_id"), null_if_empty(F.col("brandId")).alias("brand_id"), null_if_empty(F.col("campaignId")).alias("campaign_id"),
        F.col("serviceName").alias("service_name"), F.col("taskName").alias("task_name"), F.lit("running").alias("status"), now.alias("started_at"),
        F.lit(None).cast("timestamp").alias("completed_at"), now.alias("created_at"), now.alias("updated_at"),
    )
