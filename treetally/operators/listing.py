"""Listing runs: filters, own cost, order and pages."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import parse_bound_ts, zero_if_no_cost
from ..sources.shared import written

RUN_COLUMNS = (
    "id", "parent_run_id", "organization_id", "user_id", "app_id", "brand_id", "campaign_id", "service_name", "task_name", "status",
    "started_at", "completed_at", "created_at", "updated_at",
)
#: A decimal number as requests write it.
NUMBER = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]{1,2})?")
BASED = re.compile(r"0(?:[xX][0-9a-fA-F]+|[oO][0-7]+|[bB][01]+)")
#: As many rows as can be skipped or asked for.
LARGEST = (1 << 31) - 1
DIMENSIONS = ("app_id", "brand_id", "campaign_id", "service_name", "task_name", "status")


def filter_tenant(runs: DataFrame, orgs: DataFrame, org_ext: str) -> DataFrame:
    """Runs of the organization with this external id; none if there is no such."""
    keys = orgs.where(F.col("external_id") == org_ext).select(F.col("id").alias("organization_id"))
    return runs.join(keys, "organization_id", "left_semi")


def filter_user(runs: DataFrame, users: DataFrame, user_ext: str) -> DataFrame:
    """Runs of the user with this external id; none if there is no such."""
    keys = users.where(F.col("external_id") == user_ext).select(F.col("id").alias("user_id"))
    return runs.join(keys, "user_id", "left_semi")


def unknown_key_is_empty(runs: DataFrame, orgs: DataFrame, users: DataFrame, org_ext: str, user_ext: str | None = None) -> DataFrame:
    """Both key filters; an unknown key gives no rows and no error."""
    rows = filter_tenant(runs, orgs, org_ext)
    return filter_user(rows, users, user_ext) if user_ext else rows


def filter_dims(runs: DataFrame, **equal: str | None) -> DataFrame:
    return runs.where(compose_filters(**equal))


def filter_parent(runs: DataFrame, parent_id) -> DataFrame:
    """Direct children only."""
    return runs.where(F.col("parent_run_id") == parent_id)


def filter_started_range(runs: DataFrame, after: str | None = None, before: str | None = None) -> DataFrame:
    return runs.where(compose_filters(started_after=after, started_before=before))


def compose_filters(parent_run_id=None, started_after: str | None = None, started_before: str | None = None, **dims: str | None) -> Column:
    """All given conditions together; an empty text is as good as none. Bounds are inclusive. A filter
    of another name is an error: to leave it out silently would list what was not asked for."""
    if unknown := set(dims) - set(DIMENSIONS):
        raise ValueError(f"no such filter: {sorted(unknown)}")
    parts = [F.col(k) == v for k, v in dims.items() if v]
    if parent_run_id not in (None, ""):
        parts.append(F.col("parent_run_id") == parent_run_id)
    if started_after:
        parts.append(F.col("started_at") >= parse_bound_ts(started_after))
    if started_before:
        parts.append(F.col("started_at") <= parse_bound_ts(started_before))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def costs_total(costs: DataFrame) -> DataFrame:
    """(run_id, own): one row a run, before any join."""
    return costs.groupBy("run_id").agg(F.sum("total_cost_in_usd_cents").cast("decimal(26,10)").alias("own"))


def runs_with_costs_join(runs: DataFrame, costs: DataFrame) -> DataFrame:
    """runs with own, null where a run has no lines."""
    return runs.join(costs_total(costs).withColumnRenamed("run_id", "id"), "id", "left")


def own_cost_per_run(runs: DataFrame, costs: DataFrame) -> DataFrame:
    """(id, own_cost), 0 where a run has no lines."""
    return runs_with_costs_join(runs.select("id"), costs).select("id", zero_if_no_cost(F.col("own")).alias("own_cost"))


def own_total(costs: DataFrame, run_ids: DataFrame) -> DataFrame:
    """(id, own_cost) for the given ids."""
    wanted = run_ids.select("id").distinct()
    return own_cost_per_run(wanted, costs.join(wanted.withColumnRenamed("id", "run_id"), "run_id", "left_semi"))


def project_listing(rows: DataFrame) -> DataFrame:
    return rows.select(*[c for c in RUN_COLUMNS if c in rows.columns], zero_if_no_cost(F.col("own")).alias("own_cost"))


def latest_first(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("started_at"), F.asc("id"))


def page_limit(limit: int | str | None = None) -> int:
    """50 where there is none, at most 200."""
    n = _number(limit)
    if n < 0:
        raise ValueError("limit is negative")
    return min(n or 50, 200)


def page_offset(offset: int | str | None = None) -> int:
    if (n := _number(offset)) < 0:
        raise ValueError("offset is negative")
    return n


def _number(text: int | float | str | None) -> int:
    """0 for what is no number; "1e2" is 100, "0x10" is 16, "Infinity" and what is beyond LARGEST is
    LARGEST. A fraction raises."""
    given = "" if text is None else str(text).strip()
    if BASED.fullmatch(given):
        return min(int(given, 0), LARGEST)
    if given in ("Infinity", "+Infinity", "-Infinity"):
        return -LARGEST if given[0] == "-" else LARGEST
    if not NUMBER.fullmatch(given):
        return 0
    n = float(given)
    if abs(n) > LARGEST:
        return LARGEST if n > 0 else -LARGEST
    if n != n // 1:
        raise ValueError(f"no whole number: {given}")
    return int(n)


def list_runs(tables: dict[str, DataFrame], org_ext: str, user_ext: str | None = None, limit=None, offset=None, **filters) -> DataFrame:
    """One page of an organization's runs with their own cost, latest first.

    The page is cut and written before costs are joined: own cost plays no part in the order,
    so only lines of the page's runs are summed, and the runs are read once."""
    rows = unknown_key_is_empty(tables["runs"], tables["organizations"], tables["users"], org_ext, user_ext).where(compose_filters(**filters))
    page = written(latest_first(rows).offset(page_offset(offset)).limit(page_limit(limit)), "page")
    lines = tables["runs_costs"].join(F.broadcast(page.select(F.col("id").alias("run_id"))), "run_id", "left_semi")  # 200 ids at most
    return latest_first(project_listing(runs_with_costs_join(page, lines)))
