"""Runs labelled with intervals: a subtree is a range of numbers.

Each run gets a number `pre` and the last number of its subtree, `last`. A run is below another
if its number lies in the other's interval, so that descendants, and whether one run is below
another, take one join and no walk. Labels are made once and stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .skew import SPLIT, lookup
from .tree import CHAINS, RAKED, contraction, union_all

#: Numbers of a block, by which intervals are joined.
BLOCK = 1 << 12


def running_sums(rows: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """rows with the sum of value over all rows before, in the order of by (unique). Rows are dealt by
    ranges and summed within each; of a range only its total meets the others."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(rows.repartitionByRange(parts, *by).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = rows.groupBy("_part").agg(F.sum(value).alias("_total"))
    before = totals.withColumn("_before", F.sum("_total").over(Window.orderBy("_part")) - F.col("_total")).select("_part", "_before")  # a row a range
    within = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(before), "_part").withColumn(out, (within + F.col("_before")).cast("long")).drop("_part", "_before")


def labelled(runs: DataFrame, split: int = SPLIT) -> DataFrame:
    """(id, parent, pre, last, depth) for every run: depth 0 for a run without a parent, or whose parent
    isn't a run (parent is null then). Numbers are unique but may have gaps.

    The steps of one contraction are taken back, last first. A run that was raked gets its place
    behind its parent's number from the running sum of sizes in the order of parent and id, and a
    root a range of its own; what is left of a subtree when its top is in a chain comes after all
    that was raked into it, so that a run of a chain is just as many numbers before the run below
    the chain as the chain's sum says. Each run is joined to its parent's, or that run's, label
    once, however deep it lies. Children of a parent with over `split` are dealt to many tasks. A
    cycle is an error."""
    nodes = written(runs.select("id", F.col("parent_run_id").alias("parent")), "nodes")
    steps = contraction(nodes.select("id", "parent", F.col("parent").alias("given"), F.lit(1).cast("long").alias("value")), deep=True)
    raked = union_all(*[rows.select("id", "parent", "given", "total", "carry", "skip", (F.col("total") + F.col("carry")).alias("block"), F.lit(n).alias("step")) for n, (what, rows) in enumerate(steps) if what == RAKED])
    raked = running_sums(raked, ["parent", "id"], "block", "at")
    raked = written(raked.drop("block"), "places")
    first = raked.where("parent is not null").groupBy("parent").agg(F.min("at").alias("first"))
    raked = written(lookup(raked, first, "parent", F.col("id"), split=split), "places", by="step")
    done = []
    for n in range(len(steps) - 1, -1, -1):
        there = union_all(*done).select("id", F.col("pre").alias("base"), F.col("depth").alias("level"), F.col("total").alias("below")) if done else None
        if steps[n][0] == CHAINS:
            rows = steps[n][1].join(there.withColumnRenamed("id", "down"), "down")
            rows = rows.select("id", "given", (F.col("sum") + F.col("below")).alias("total"), (F.col("base") - F.col("sum")).alias("pre"), (F.col("level") - F.col("hops")).alias("depth"))
        else:
            rows = raked.where(F.col("step") == n)
            if there is None:
                rows = rows.withColumns({"base": F.lit(None).cast("long"), "level": F.lit(None).cast("int")})
            else:
                rows = lookup(rows, there.drop("below").withColumnRenamed("id", "parent"), "parent", F.col("id"), split=split)
            inner = F.col("base").isNotNull()
            pre = F.when(inner, F.col("base") + 1 + F.col("at") - F.col("first")).otherwise(F.col("at")) + F.col("carry")
            rows = rows.select("id", "given", "total", pre.alias("pre"), (F.when(inner, F.col("level") + 1).otherwise(0) + F.col("skip")).alias("depth"))
        done.append(written(rows, "labels") if n else rows)
    return union_all(*done).select("id", F.when(F.col("depth") > 0, F.col("given")).alias("parent"), "pre", (F.col("pre") + F.col("total") - 1).alias("last"), F.col("depth").cast("int").alias("depth"))


def descendants_within(labels: DataFrame, roots: DataFrame, block: int = BLOCK) -> DataFrame:
    """(root, id, depth) for all runs below each id of roots, from labels; an id that is no run has
    none. Intervals are cut into blocks of numbers and joined by these. A block has `block` runs at most, whatever the tree."""
    tops = labels.join(roots.select("id").distinct(), "id", "left_semi").where("last > pre")
    tops = tops.select(F.col("id").alias("root"), F.col("pre").alias("from"), F.col("last").alias("to"), F.col("depth").alias("top"))
    tops = tops.withColumn("_block", F.explode(F.sequence(F.call_function("div", F.col("from") + 1, F.lit(block)), F.call_function("div", F.col("to"), F.lit(block)))))
    inner = labels.where("depth > 0").select("id", "pre", "depth", F.call_function("div", F.col("pre"), F.lit(block)).alias("_block"))
    rows = tops.join(inner, "_block").where((F.col("pre") > F.col("from")) & (F.col("pre") <= F.col("to")))
    return rows.select("root", "id", (F.col("depth") - F.col("top")).alias("depth"))


def is_below(pairs: DataFrame, labels: DataFrame, split: int = SPLIT) -> DataFrame:
    """pairs (id, other) with below: whether run id is below run other; null where either isn't a run."""
    own = lookup(pairs, labels.select("id", "pre"), "id", F.xxhash64("other"), split=split)
    both = lookup(own, labels.select(F.col("id").alias("other"), F.col("pre").alias("from"), F.col("last").alias("to")), "other", F.xxhash64("id"), split=split)
    return both.withColumn("below", (F.col("pre") > F.col("from")) & (F.col("pre") <= F.col("to"))).drop("pre", "from", "to")
