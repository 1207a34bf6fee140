"""The write steps as Structured Streaming jobs.

Requests arrive as files; each micro-batch runs the batch operators and writes to folders
named by batch id, so that a batch that is tried again replaces what it wrote before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.keys import apply_run_defaults, check_parent_exists, judged_run_exists, new_orgs, new_users, update_target_exists, with_orgs, with_users
from ..operators.lifecycle import last_updates
from ..operators.pricing import price_cost_items
from ..operators.skew import heavy_keys
from ..operators.validate import judged_cost_batches, judged_runs, validate_status_updates
from ..sources.schemas import TABLES
from ..sources.shared import temporary, written
from .levels import FAN, Levels


def _store(rows: DataFrame, path: str, batch: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch}")


def _started(stream: DataFrame, step, paths: dict[str, str]) -> StreamingQuery:
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", paths["checkpoint"]).trigger(availableNow=True).start()


def stream_create_runs(stream: DataFrame, tables: dict[str, DataFrame], paths: dict[str, str], new_id=None, fan: int = FAN) -> StreamingQuery:
    """Validated requests become organizations, users and runs under paths. Keys persist though
    their run is then rejected for its parent. New ids are random unless new_id(kind) gives a
    column for organizations, users or runs.

    A batch is read and judged once; what that left goes when the batch ends. Parents are checked
    before organizations and users are joined, so that whole requests are shuffled once, for their
    user. Keys of earlier batches are kept beside each table (`..._keys`) in levels of merged runs, so
    that a batch reads few files and no other columns, however many batches went before."""
    make, spark = new_id or (lambda kind: None), stream.sparkSession

    def held(name: str) -> Levels:
        columns = ["id", *[c for c in ("external_id", "organization_id") if c in tables[name].columns]]
        return Levels(spark, f"{paths[name]}_keys", StructType([TABLES[name][c] for c in columns]), fan)

    keys = {name: held(name) for name in ("organizations", "users", "runs")}

    def known(name: str, batches: int) -> DataFrame:
        return tables[name].select(keys[name].schema.names).unionByName(keys[name].read(batches))

    def put(name: str, rows: DataFrame, n: int) -> None:
        _store(rows, paths[name], n)
        stored = spark.read.schema(rows.schema).parquet(f"{paths[name]}/batch_id={n}")  # random ids are those written
        keys[name].add(stored, n)

    def heavy(rows: DataFrame, key: str) -> DataFrame:
        return written(heavy_keys(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key), "heavy")

    def step(batch: DataFrame, n: int) -> None:
        with temporary(spark):
            judged = written(judged_runs(batch), "judged", session=spark)
            good = judged.where("reason is null").drop("reason")
            orgs, users = heavy(good, "clerkOrgId"), heavy(good, "clerkUserId")
            put("organizations", new_orgs(good, known("organizations", n), make("organizations")), n)
            put("users", new_users(with_orgs(good, known("organizations", n + 1), orgs), known("users", n), make("users")), n)
            parents = good.select(F.col("parentRunId").alias("id")).where("id is not null").distinct()
            fine, orphans = check_parent_exists(good, written(parents.join(known("runs", n), "id", "left_semi"), "parents"))
            put("runs", apply_run_defaults(with_users(with_orgs(fine, known("organizations", n + 1), orgs), known("users", n + 1), users), make("runs")), n)
            _store(judged.where("reason is not null").select("request_id", "reason").unionByName(orphans.select("request_id", "reason")), paths["rejects"], n)

    return _started(stream, step, paths)


def stream_price_costs(stream: DataFrame, runs: DataFrame, prices: DataFrame, paths: dict[str, str]) -> StreamingQuery:
    """Cost batches, each a row with its items, become priced lines and rejects with one reason each:
    invalid, then run not found, then unknown cost. A batch is judged and joined to the runs once;
    lines and rejects are read from what that left, which goes when the batch ends."""

    def step(batch: DataFrame, n: int) -> None:
        with temporary(batch.sparkSession):
            judged = judged_run_exists(judged_cost_batches(batch.select("request_id", "run_id", "items")), runs)
            judged = written(judged.select("request_id", "run_id", F.when(F.col("reason").isNull(), F.col("items")).alias("items"), "reason"), "judged")
            items = judged.where("reason is null").select("request_id", "run_id", F.posexplode("items").alias("pos", "item")).select("request_id", "run_id", "pos", F.col("item.costName").alias("cost_name"), F.col("item.quantity").alias("quantity"))
            priced, unknown = price_cost_items(items, prices)
            _store(priced, paths["costs"], n)
            rejects = judged.where("reason is not null").select("request_id", "reason")
            _store(rejects.unionByName(unknown.select("request_id", F.concat(F.lit("unknown cost: "), F.array_join("unknown_names", ", ")).alias("reason"))), paths["rejects"], n)

    return _started(stream, step, paths)


def status_levels(spark: SparkSession, path: str, log: StructType, fan: int = FAN) -> Levels:
    """The last update of each run, in levels whose merges keep one update a run. log: its schema."""
    return Levels(spark, path, StructType([log[c] for c in ("run_id", "status", "ts", "seq")]), fan, last_updates)


def stream_status_updates(stream: DataFrame, runs: DataFrame, paths: dict[str, str], fan: int = FAN) -> StreamingQuery:
    """Valid updates of known runs are appended to the log; the state is its fold. With a path for
    `snapshot`, the fold is also kept there in levels (status_levels), so that the state after any
    batch is read from few runs with one row for each run that changed, not from the log."""

    def step(batch: DataFrame, n: int) -> None:
        good, bad = validate_status_updates(batch)
        known, lost = update_target_exists(good, runs)
        log = known.select("request_id", "run_id", "status", "ts", "seq")
        _store(log, paths["log"], n)
        if "snapshot" in paths:
            status_levels(stream.sparkSession, paths["snapshot"], log.schema, fan).add(last_updates(log), n)
        _store(bad.select("request_id", "reason").unionByName(lost.select("request_id", "reason")), paths["rejects"], n)

    return _started(stream, step, paths)


def stream_own_cost(lines: DataFrame) -> DataFrame:
    """Running own cost per run, for output mode update or complete; the state is keyed by run."""
    return lines.groupBy("run_id").agg(F.sum("total_cost_in_usd_cents").cast("decimal(26,10)").alias("own_cost"))


def start_own_cost(lines: DataFrame, paths: dict[str, str]) -> StreamingQuery:
    """stream_own_cost into folders by batch under `costs`. State is in RocksDB, on the executors'
    disks and in the checkpoint, with changes alone written each batch; a query that is started again
    goes on from there."""
    spark = lines.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    write = stream_own_cost(lines).writeStream.outputMode("update").option("checkpointLocation", paths["checkpoint"]).trigger(availableNow=True)
    return write.foreachBatch(lambda rows, n: _store(rows, paths["costs"], n)).start()
