"""Splitting requests into accepted ones and rejected ones with their reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import UUID


def _marked(rows: DataFrame, problems: list[Column]) -> DataFrame:
    return rows.withColumn("errors", F.array_compact(F.array(*problems)))


def _split(rows: DataFrame, problems: list[Column]) -> tuple[DataFrame, DataFrame]:
    marked = _marked(rows, problems)
    good = marked.where(F.size("errors") == 0).drop("errors")
    return good, marked.where(F.size("errors") > 0).withColumn("reason", F.array_join("errors", "; ")).drop("errors")


def _judged(rows: DataFrame, problems: list[Column]) -> DataFrame:
    return _marked(rows, problems).withColumn("reason", F.when(F.size("errors") > 0, F.array_join("errors", "; "))).drop("errors")


def _run_problems() -> list[Column]:
    problems = [F.when(F.coalesce(F.length(c) < 1, F.lit(True)), f"{c} required") for c in ("clerkOrgId", "appId", "serviceName", "taskName")]
    problems += [F.when(F.length(c) < 1, f"{c} empty") for c in ("clerkUserId", "brandId", "campaignId")]
    return [*problems, F.when(~F.col("parentRunId").rlike(UUID), "parentRunId no UUID")]


def judged_runs(requests: DataFrame) -> DataFrame:
    """requests with reason, as validate_runs rejects them; null where a request is accepted."""
    return _judged(requests, _run_problems())


def validate_runs(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Required texts present and not empty, optional ones not empty, the parent a UUID."""
    return _split(requests, _run_problems())


def validate_status_updates(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """status is completed or failed."""
    return _split(requests, [F.when(~F.coalesce(F.col("status").isin("completed", "failed"), F.lit(False)), "status not allowed")])


def _batch_problems() -> list[Column]:
    fine = lambda x: F.coalesce((F.length(x["costName"]) >= 1) & (x["quantity"] > 0), F.lit(False))
    none = F.coalesce(F.size("items") < 1, F.lit(True))
    return [F.when(none, "items required"), F.when(~none & ~F.forall("items", fine), "bad item")]


def judged_cost_batches(requests: DataFrame) -> DataFrame:
    """requests with reason, as validate_cost_batches rejects them; null where a request is accepted."""
    return _judged(requests, _batch_problems())


def validate_cost_batches(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """At least one item, each with a name and a positive quantity; one bad item rejects its request."""
    return _split(requests, _batch_problems())
