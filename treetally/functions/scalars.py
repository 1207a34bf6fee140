"""Column functions of the ledger. ANSI mode is expected to be on, as it is by default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def null_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def line_total(quantity: Column, unit_cost: Column) -> Column:
    """Exact product, rounded half up to 10 places; an amount that doesn't fit is an error."""
    return (quantity * unit_cost).cast("decimal(16,10)")


def fixed10(amount: Column) -> Column:
    """Text with exactly 10 decimals."""
    return amount.cast("decimal(26,10)").cast("string")


def coerce_numeric(value: Column, precision: int, scale: int) -> Column:
    """value rounded to the scale; null where it is no number or doesn't fit."""
    return value.cast("string").try_cast(f"decimal({precision},{scale})")


def zero_if_no_cost(total: Column) -> Column:
    return F.coalesce(total.cast("decimal(26,10)"), F.lit(0).cast("decimal(26,10)"))


def parse_bound_ts(text: str | Column) -> Column:
    """An ISO-8601 instant; malformed text is an error."""
    return F.to_timestamp(F.lit(text) if isinstance(text, str) else text)
