"""Nested result documents of chosen runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import fixed10, zero_if_no_cost
from ..sources.shared import written
from .intervals import running_sums
from .skew import heavy_keys
from .tree import costs_of_descendants, descendants, union_all

#: Descendants of a document that are summed and sorted in one task; those of a larger one are dealt by ranges.
LARGE = 1 << 16


def costs_by_run(costs: DataFrame) -> DataFrame:
    """(run_id, costs): a run's lines in order of time and id, amounts as text."""
    return costs.groupBy("run_id").agg(F.sort_array(F.collect_list(_line())).alias("costs"))


def _line() -> Column:
    return F.struct(F.col("created_at").alias("createdAt"), "id", F.col("cost_name").alias("costName"), F.col("quantity").cast("string").alias("quantity"),
                    F.col("unit_cost_in_usd_cents").cast("string").alias("unitCostInUsdCents"), F.col("total_cost_in_usd_cents").cast("string").alias("totalCostInUsdCents"))


def attach_costs_to_descendants(desc: DataFrame, costs: DataFrame) -> DataFrame:
    """desc with costs, an empty array where a run has no lines."""
    by = costs_by_run(costs_of_descendants(desc, costs)).withColumnRenamed("run_id", "id")
    return desc.join(by, "id", "left").withColumn("costs", F.coalesce("costs", F.array().cast(by.schema["costs"].dataType)))


def project_descendant(rows: DataFrame) -> DataFrame:
    """The seven columns of a descendant, in the documents' names, after root and depth."""
    names = {"id": "id", "parent_run_id": "parentRunId", "service_name": "serviceName", "task_name": "taskName", "status": "status", "started_at": "startedAt", "completed_at": "completedAt"}
    return rows.select("root", "depth", *[F.col(a).alias(b) for a, b in names.items()])


def _heads(runs: DataFrame, roots: DataFrame) -> DataFrame:
    return runs.join(roots.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("root"), "id", F.lit(0).alias("depth"))


def _entries(every: DataFrame, runs: DataFrame, costs: DataFrame) -> DataFrame:
    """(root, depth, entry, own_cost, costs) for every (root, id, depth): one join to the runs and one
    to their lines, which are grouped once for list and sum."""
    lines = costs.groupBy("run_id").agg(F.sort_array(F.collect_list(_line())).alias("costs"), F.sum("total_cost_in_usd_cents").alias("own")).withColumnRenamed("run_id", "id")
    rows = project_descendant(every.join(runs, "id")).join(lines, "id", "left")
    rows = rows.withColumns({"costs": F.coalesce("costs", F.array().cast(lines.schema["costs"].dataType)), "own_cost": zero_if_no_cost(F.col("own"))})
    entry = F.struct("depth", "startedAt", "id", "parentRunId", "serviceName", "taskName", "status", "completedAt", "costs", fixed10(F.col("own_cost")).alias("ownCostInUsdCents"))
    return rows.select("root", "depth", "id", "startedAt", entry.alias("entry"), "own_cost", "costs")


def run_document(runs: DataFrame, costs: DataFrame, roots: DataFrame) -> DataFrame:
    """A document a root: its columns, costs, three totals and its descendants, flat with parent pointers.

    One row holds a whole tree, so roots are for the caller to choose; run_document_parts has
    documents of any size, in parts."""
    heads = _heads(runs, roots)
    rows = _entries(union_all(heads, descendants(runs, heads.select("id")).select("root", "id", "depth")), runs, costs)
    below = F.col("depth") > 0
    docs = rows.groupBy(F.col("root").alias("id")).agg(
        F.sort_array(F.collect_list(F.when(below, F.col("entry")))).alias("descendantRuns"), F.max(F.when(~below, F.struct("own_cost", "costs"))).alias("head"),
        F.coalesce(F.sum(F.when(below, F.col("own_cost"))), F.lit(0)).cast("decimal(26,10)").alias("children"))
    rows = runs.join(docs, "id")
    return rows.select(
        *runs.columns, F.col("head.costs").alias("costs"), fixed10(F.col("head.own_cost")).alias("ownCostInUsdCents"), fixed10(F.col("children")).alias("childrenCostInUsdCents"),
        fixed10(F.col("head.own_cost") + F.col("children")).alias("totalCostInUsdCents"), "descendantRuns",
    )


def run_document_parts(runs: DataFrame, costs: DataFrame, roots: DataFrame, limit: int = 1 << 24, large: int = LARGE) -> DataFrame:
    """(id, part, descendantRuns): the descendants of each document in parts, from 0, of about `limit`
    bytes as JSON and one entry at most. Parts in order have what run_document's list has.

    Entries are shuffled once, by document, and the bytes before each are summed there. Those of
    a document with over `large` entries are dealt by ranges of their order instead, so a tree
    of any size is no group of its own."""
    every = descendants(runs, _heads(runs, roots).select("id")).select("root", "id", "depth")
    heavy = written(heavy_keys(every.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "root", split=large).select("root"), "heavy")  # a `large`th of all at most
    order, at = ["root", "depth", "startedAt", "id"], F.call_function("div", F.col("_at"), F.lit(limit))

    def sized(some: DataFrame) -> DataFrame:
        return _entries(some, runs, costs).select(*order, "entry", F.octet_length(F.to_json("entry")).cast("long").alias("_bytes"))

    def cut(rows: DataFrame) -> DataFrame:
        parts = rows.groupBy("root", "_block").agg(F.sort_array(F.collect_list("entry")).alias("descendantRuns"))
        number = F.row_number().over(Window.partitionBy("root").orderBy("_block")) - 1  # parts of one document, not entries
        return parts.select(F.col("root").alias("id"), number.alias("part"), "descendantRuns")

    before = F.coalesce(F.sum("_bytes").over(Window.partitionBy("root").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if heavy.isEmpty():
        return cut(sized(every).withColumn("_at", before).withColumn("_block", at))
    small = cut(sized(every.join(heavy, "root", "left_anti")).withColumn("_at", before).withColumn("_block", at))
    ranged = written(sized(every.join(heavy, "root", "left_semi")), "entries")  # ranges are sampled: read twice
    return small.unionByName(cut(running_sums(ranged, order, "_bytes", "_at").withColumn("_block", at)))
