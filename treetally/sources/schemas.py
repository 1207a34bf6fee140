"""Declared schemas of the ledger's tables and requests. Nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

QUANTITY, UNIT_COST, LINE_TOTAL, AMOUNT = "decimal(20,6)", "decimal(12,10)", "decimal(16,10)", "decimal(26,10)"
#: A quantity before it is stored: its product with a unit cost is exact.
RAW_QUANTITY = "decimal(24,10)"


_TYPES = {"string": T.StringType(), "timestamp": T.TimestampType(), "long": T.LongType()}


def _type(text: str) -> T.DataType:
    if text.startswith("decimal"):
        return T.DecimalType(*map(int, text[8:-1].split(",")))
    return _TYPES[text]


def _schema(text: str, required: str = "") -> T.StructType:
    """From "name type, name type"; columns named in required have no nulls."""
    need = set(required.split())
    return T.StructType([T.StructField(name, _type(kind), name not in need) for name, kind in (x.split(" ") for x in text.split(", "))])


TABLES = {
    "organizations": _schema("id string, external_id string, created_at timestamp, updated_at timestamp", "id external_id created_at updated_at"),
    "users": _schema("id string, external_id string, organization_id string, created_at timestamp, updated_at timestamp", "id external_id organization_id created_at updated_at"),
    "runs": _schema(
        "id string, parent_run_id string, organization_id string, user_id string, app_id string, brand_id string, campaign_id string, service_name string, "
        "task_name string, status string, started_at timestamp, completed_at timestamp, created_at timestamp, updated_at timestamp",
        "id organization_id app_id service_name task_name status started_at created_at updated_at",
    ),
    "runs_costs": _schema(
        f"id string, run_id string, cost_name string, quantity {QUANTITY}, unit_cost_in_usd_cents {UNIT_COST}, total_cost_in_usd_cents {LINE_TOTAL}, created_at timestamp",
        "id run_id cost_name quantity unit_cost_in_usd_cents total_cost_in_usd_cents created_at",
    ),
}
PRICE_LIST = _schema("name string, costPerUnitInUsdCents string")

_ARRIVAL = "request_id string, ts timestamp, seq long"
REQUESTS = {
    "runs": _schema(f"{_ARRIVAL}, clerkOrgId string, clerkUserId string, appId string, brandId string, campaignId string, serviceName string, taskName string, parentRunId string"),
    "costs": _schema(f"{_ARRIVAL}, run_id string").add("items", T.ArrayType(_schema(f"costName string, quantity {RAW_QUANTITY}"))),
    "status": _schema(f"{_ARRIVAL}, run_id string, status string"),
}
#: The foreign keys: table, column, table it refers to.
FOREIGN_KEYS = (
    ("users", "organization_id", "organizations"), ("runs", "organization_id", "organizations"), ("runs", "user_id", "users"),
    ("runs", "parent_run_id", "runs"), ("runs_costs", "run_id", "runs"),
)
