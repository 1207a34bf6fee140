"""Status folds, cascading deletes and schema evolution over immutable tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_updates(log: DataFrame) -> DataFrame:
    """(run_id, status, ts, seq): the last update of each run. Itself a log, with the same fold: a
    snapshot of what went before, to which later updates are added."""
    last = F.max_by(F.struct("status", "ts", "seq"), F.struct("ts", "seq"))
    return log.groupBy("run_id").agg(last.alias("last")).select("run_id", "last.status", "last.ts", "last.seq")


def apply_status_updates(runs: DataFrame, log: DataFrame) -> DataFrame:
    """runs with the last update of the log (run_id, status, ts, seq) in place; any status may
    follow any other, and both times become the update's."""
    last = log.groupBy(F.col("run_id").alias("id")).agg(F.max_by("status", F.struct("ts", "seq")).alias("new_status"), F.max("ts").alias("at"))
    rows = runs.join(last, "id", "left")
    new = {"status": F.coalesce("new_status", "status"), "completed_at": F.coalesce("at", "completed_at")}
    if "updated_at" in runs.columns:
        new["updated_at"] = F.coalesce("at", "updated_at")
    return rows.withColumns(new).select(*runs.columns)


def delete_violations(runs: DataFrame, ids: DataFrame) -> DataFrame:
    """Runs that stay though their parent is to go; if there are any, nothing may be deleted."""
    gone = ids.select("id").distinct()
    return runs.join(gone, "id", "left_anti").join(gone.withColumnRenamed("id", "parent_run_id"), "parent_run_id", "left_semi")


def cascade_delete_runs(runs: DataFrame, costs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs and cost lines without those of ids; an error if a child would be left."""
    if not delete_violations(runs, ids).isEmpty():
        raise ValueError("a run that stays has a parent that would go")
    gone = ids.select("id").distinct()
    return runs.join(gone, "id", "left_anti"), costs.join(gone.withColumnRenamed("id", "run_id"), "run_id", "left_anti")


def evolve_add_dims(old_runs: DataFrame) -> DataFrame:
    """app_id (`unknown` where there is none), brand_id and campaign_id (null) added where missing."""
    have = set(old_runs.columns)
    app = F.coalesce("app_id", F.lit("unknown")) if "app_id" in have else F.lit("unknown")
    return old_runs.withColumns({"app_id": app} | {c: F.lit(None).cast("string") for c in ("brand_id", "campaign_id") if c not in have})
