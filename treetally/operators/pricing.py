"""Pricing cost lines against a price list; an unknown name rejects its whole request."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import line_total
from ..sources.schemas import QUANTITY, RAW_QUANTITY
from .skew import lookup


def distinct_cost_names(items: DataFrame) -> DataFrame:
    return items.select("cost_name").distinct()


def price_cost_items(items: DataFrame, prices: DataFrame, request: str = "request_id", split: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(lines with unit_cost and total, rejected requests with their unknown names).

    Lines are read and joined to the prices once, and a request's verdict is taken where its
    lines are dealt to. The join is planned from the price list's size: a small one is
    broadcast, a large one shuffled; with split, lines of a name that over `split` lines have are
    then dealt to many tasks. Totals come from the quantity as given; what is stored is
    rounded to 6 places. A request of any size is one group; it spills."""
    lines = items.withColumn("quantity", F.col("quantity").cast(RAW_QUANTITY))
    if split is None:
        lines = lines.join(prices, "cost_name", "left")
    else:
        lines = lookup(lines, prices, "cost_name", F.xxhash64(request, "quantity"), split=split)
    unknown = F.count_if(F.col("unit_cost").isNull()).over(Window.partitionBy(request))
    good = lines.withColumn("_unknown", unknown).where("_unknown = 0").drop("_unknown")
    bad = lines.where("unit_cost is null").groupBy(request).agg(F.sort_array(F.collect_set("cost_name")).alias("unknown_names"))
    total = line_total(F.col("quantity"), F.col("unit_cost"))
    return good.withColumn("total", total).withColumn("quantity", F.col("quantity").cast(QUANTITY)), bad
