"""The registered queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import coerce_numeric, fixed10, null_if_empty, parse_bound_ts
from ..operators import document, integrity, intervals, keys, lifecycle, listing, pricing, tree, validate
from ..sources import fixtures as fx
from ..sources import layout
from ..sources import tables as io
from ..sources.schemas import TABLES
from ..sources.shared import new_path, written
from ..streaming import jobs

ORG = "NATION_6"
AFTER, BEFORE = "1994-01-01T00:00:00", "1996-12-31T00:00:00"
PAGE = {"limit": 50, "offset": 0}


def _runs(spark, d):
    return fx.runs(spark, d)


def _roots(runs: DataFrame) -> DataFrame:
    return runs.where("parent_run_id is null").select("id")


def _user(spark, d) -> str:
    """The external id of the smallest user."""
    return fx.users(spark, d).agg(F.min_by("external_id", "id").alias("u")).first()["u"]


def _items(spark, d) -> DataFrame:
    """Requests with their items: every run's lines, with a bad quantity or name in some."""
    lines = fx.cost_items(spark, d).withColumn("quantity", F.when(F.col("run_id") % 29 == 0, F.lit(0)).otherwise(F.col("quantity")).cast("decimal(24,10)"))
    lines = lines.withColumn("cost_name", F.when(F.col("run_id") % 31 == 0, "").otherwise(F.col("cost_name")))
    by = lines.groupBy("run_id").agg(F.collect_list(F.struct(F.col("cost_name").alias("costName"), "quantity")).alias("items"))
    return fx.read(spark, d, "orders").select(F.col("o_orderkey").alias("run_id")).join(by, "run_id", "left").withColumn("request_id", F.col("run_id"))


def list_runs(spark: SparkSession, d: str) -> DataFrame:
    return listing.list_runs(fx.tables(spark, d), ORG, **PAGE)


def list_runs_filtered(spark, d):
    return listing.list_runs(fx.tables(spark, d), ORG, limit="200", offset="2", status="completed", app_id="1-URGENT", brand_id="", started_after=AFTER, started_before=BEFORE)


def list_runs_stored(spark, d):
    """The same page from runs that are stored by tenant and month."""
    tables, path = fx.tables(spark, d), new_path(spark, "runs")
    layout.store_runs(tables["runs"], path, tenants=4)  # a few organizations
    runs = layout.runs_of(spark, path, tables["organizations"], ORG, AFTER, BEFORE, tenants=4)
    return listing.list_runs(tables | {"runs": runs}, ORG, limit="200", offset="2", status="completed", app_id="1-URGENT", started_after=AFTER, started_before=BEFORE)


def filter_tenant(spark, d):
    return listing.filter_tenant(_runs(spark, d), fx.organizations(spark, d), ORG)


def filter_user(spark, d):
    return listing.filter_user(_runs(spark, d), fx.users(spark, d), _user(spark, d))


def filter_dims(spark, d):
    return listing.filter_dims(_runs(spark, d), app_id="1-URGENT", brand_id="brand-2", status="running")


def filter_parent(spark, d):
    return listing.filter_parent(_runs(spark, d), 32)


def filter_started_range(spark, d):
    return listing.filter_started_range(_runs(spark, d), AFTER, BEFORE)


def unknown_key_is_empty(spark, d):
    return listing.unknown_key_is_empty(_runs(spark, d), fx.organizations(spark, d), fx.users(spark, d), "no such organization")


def page_second(spark, d):
    return listing.latest_first(_runs(spark, d)).offset(listing.page_offset("50")).limit(listing.page_limit("0")).select("id", "started_at")


def runs_with_costs_join(spark, d):
    return listing.runs_with_costs_join(_runs(spark, d).select("id"), fx.runs_costs(spark, d))


def own_cost_per_run(spark, d):
    return listing.own_cost_per_run(_runs(spark, d), fx.runs_costs(spark, d))


def own_total(spark, d):
    runs = _runs(spark, d)
    return listing.own_total(fx.runs_costs(spark, d), _roots(runs))


def price_cost_items(spark, d):
    return pricing.price_cost_items(fx.cost_items(spark, d), fx.price_list(spark, d), "run_id")[0]


def priced_rejects(spark, d):
    return pricing.price_cost_items(fx.cost_items(spark, d), fx.price_list(spark, d), "run_id")[1].select("run_id", F.array_join("unknown_names", ",").alias("unknown_names"))


def distinct_cost_names(spark, d):
    return pricing.distinct_cost_names(fx.cost_items(spark, d))


def read_price_list(spark, d):
    raw = fx.read(spark, d, "part").select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("name"), (F.col("p_retailprice") / 10).alias("costPerUnitInUsdCents"))
    good, bad = io.price_list(raw)
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad.select("cost_name", F.lit(None).cast("decimal(12,10)").alias("unit_cost"), "reason"))


def validate_runs(spark, d):
    good, bad = validate.validate_runs(fx.create_requests(spark, d))
    return good.select("request_id", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("request_id", "reason"))


def validate_status_updates(spark, d):
    good, bad = validate.validate_status_updates(fx.status_updates(spark, d))
    return good.select("request_id", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("request_id", "reason"))


def validate_cost_batches(spark, d):
    good, bad = validate.validate_cost_batches(_items(spark, d))
    return good.select("request_id", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("request_id", "reason"))


def lookup_runs(spark, d):
    ids = fx.read(spark, d, "events").select(F.col("user_id").alias("id"))
    found, missing = io.lookup_runs(_runs(spark, d), ids)
    return found.select("id", F.lit(True).alias("found")).unionByName(missing.select("id", F.lit(False).alias("found")))


def check_run_exists(spark, d):
    good, bad = keys.check_run_exists(fx.status_updates(spark, d).withColumn("run_id", F.col("seq") * 3), _runs(spark, d))
    return good.select("request_id", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("request_id", "reason"))


def update_target_exists(spark, d):
    good, bad = keys.update_target_exists(fx.status_updates(spark, d).withColumn("run_id", F.col("seq") * 5), _runs(spark, d))
    return good.select("request_id", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("request_id", "reason"))


def check_parent_exists(spark, d):
    requests = fx.create_requests(spark, d).withColumn("parentRunId", F.when(F.col("seq") % 7 != 0, F.col("seq") * 2))
    good, bad = keys.check_parent_exists(requests, _runs(spark, d))
    return good.select("request_id", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("request_id", "reason"))


def _nation_orgs(spark, d):
    return fx.organizations(spark, d).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("org-"), F.col("id").cast("string")).alias("external_id"))


def resolve_orgs(spark, d):
    rows, _ = keys.resolve_orgs(fx.create_requests(spark, d), _nation_orgs(spark, d), F.concat(F.lit("new-"), F.col("external_id")))
    return rows.groupBy("clerkOrgId", "organization_id").agg(F.count("*").alias("requests"))


def resolve_users(spark, d):
    requests = fx.create_requests(spark, d).withColumn("organization_id", F.col("clerkOrgId"))
    known = fx.users(spark, d).select(F.col("id").cast("string").alias("id"), "external_id")
    rows, new = keys.resolve_users(requests, known, F.concat(F.lit("new-"), F.col("external_id")))
    counted = rows.groupBy("clerkUserId", "user_id").agg(F.count("*").alias("requests"))
    return counted.join(new.select(F.col("id").alias("user_id"), F.col("organization_id").alias("first_organization")), "user_id", "left")


def apply_run_defaults(spark, d):
    requests = fx.create_requests(spark, d).withColumns({"organization_id": F.col("clerkOrgId"), "user_id": F.col("clerkUserId")})
    return keys.apply_run_defaults(requests, F.col("request_id").cast("string")).select("id", "parent_run_id", "organization_id", "user_id", "app_id", "brand_id", "campaign_id", "service_name", "task_name", "status", "completed_at")


def append_runs(spark, d):
    stored = io.append_runs(apply_run_defaults(spark, d).select("id", "status", "app_id"), new_path(spark, "runs"))
    return stored.groupBy("status", "app_id").agg(F.count("*").alias("n"))


def append_costs(spark, d):
    stored = io.append_costs(price_cost_items(spark, d), new_path(spark, "costs"))
    return stored.groupBy("run_id").agg(F.count("*").alias("lines"), F.sum("total").cast("decimal(26,10)").alias("total"))


def read_requests(spark, d):
    path = new_path(spark, "requests")
    fx.create_requests(spark, d).write.json(path)
    return io.read_requests(spark, path, "runs").groupBy("clerkOrgId", "appId").agg(F.count("*").alias("n"), F.count("parentRunId").alias("parents"))


def read_requests_costs(spark, d):
    """Cost batches from JSON, with what their validation says."""
    path = new_path(spark, "requests")
    _items(spark, d).withColumns({"request_id": F.col("request_id").cast("string"), "run_id": F.col("run_id").cast("string")}).write.json(path)
    good, bad = validate.validate_cost_batches(io.read_requests(spark, path, "costs"))
    rows = good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad, allowMissingColumns=True)
    quantity = F.aggregate("items", F.lit(0).cast("decimal(30,6)"), lambda s, x: (s + x["quantity"]).cast("decimal(30,6)"))
    return rows.select(F.col("request_id").cast("long").alias("request_id"), F.greatest(F.coalesce(F.size("items"), F.lit(0)), F.lit(0)).cast("long").alias("lines"), F.coalesce(quantity, F.lit(0).cast("decimal(30,6)")).alias("quantity"), "reason")


def read_price_list_json(spark, d):
    """A price list from JSON."""
    path = new_path(spark, "prices")
    fx.read(spark, d, "part").select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("name"), (F.col("p_retailprice") / 10).alias("costPerUnitInUsdCents")).write.json(path)
    good, bad = io.read_price_list(spark, path)
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad.select("cost_name", F.lit(None).cast("decimal(12,10)").alias("unit_cost"), "reason"))


def scan_tables(spark, d):
    """The stored ledger, as its declared schemas read it: rows, ids and amounts of each table."""
    folder, now = new_path(spark, "ledger"), F.col("_at")
    for name, df in fx.tables(spark, d).items():
        if name == "runs_costs":
            df = df.withColumn("id", F.concat_ws("/", "run_id", "cost_name", "quantity"))
        df = df.withColumn("_at", F.lit("2024-01-01").cast("timestamp")).withColumns({c: now for c in ("created_at", "updated_at")})
        have = [f for f in TABLES[name].fields if f.name in df.columns]
        df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in have]).write.parquet(f"{folder}/{name}")
    out = None
    for name, df in io.scan_tables(spark, folder).items():
        amount = F.sum("total_cost_in_usd_cents") if name == "runs_costs" else F.lit(0)
        one = df.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), amount.cast("decimal(26,10)").alias("amount"), F.count("user_id" if name == "runs" else "id").alias("known"))
        one = one.select(F.lit(name).alias("name"), "n", "ids", "amount", "known")
        out = one if out is None else out.unionByName(one)
    return out


def descendants(spark, d):
    runs = written(_runs(spark, d), "runs")
    return tree.descendants(runs, _roots(runs))


def descendants_chain(spark, d):
    """Chains of depth 127."""
    runs = written(fx.runs(spark, d, fx.CHAIN), "runs")
    return tree.descendants(runs, _roots(runs))


def descendants_by_interval(spark, d):
    """Descendants of all roots from stored labels."""
    labels = written(intervals.labelled(_runs(spark, d)), "labels")
    return intervals.descendants_within(labels, labels.where("depth = 0").select("id"))


def descendants_by_interval_chain(spark, d):
    labels = written(intervals.labelled(fx.runs(spark, d, fx.CHAIN)), "labels")
    return intervals.descendants_within(labels, labels.where("depth = 0").select("id"))


def is_below(spark, d):
    """For each event with a run, whether that is below the run whose number has its last 4 bits clear."""
    labels = written(intervals.labelled(_runs(spark, d)), "labels")
    pairs = fx.read(spark, d, "events").select("event_id", F.col("user_id").alias("id"), F.expr("user_id - user_id % 16").alias("other"))
    return intervals.is_below(pairs, labels)


def project_descendant(spark, d):
    runs = written(_runs(spark, d), "runs")
    return document.project_descendant(tree.descendants(runs, _roots(runs)).join(runs, "id"))


def costs_of_descendants(spark, d):
    runs = written(_runs(spark, d), "runs")
    return tree.costs_of_descendants(tree.descendants(runs, _roots(runs)), fx.runs_costs(spark, d))


def attach_costs_to_descendants(spark, d):
    runs = written(_runs(spark, d), "runs")
    costs = fx.runs_costs(spark, d).withColumns({"id": F.col("cost_name"), "created_at": F.lit(0)})
    rows = document.attach_costs_to_descendants(tree.descendants(runs, _roots(runs)), costs)
    return rows.select("root", "id", "depth", F.size("costs").alias("lines"), F.array_join(F.transform("costs", lambda c: c["costName"]), ",").alias("names"))


def descendant_own_totals(spark, d):
    runs = written(_runs(spark, d), "runs")
    return tree.descendant_own_totals(tree.descendants(runs, _roots(runs)), fx.runs_costs(spark, d))


def children_total(spark, d):
    runs = written(_runs(spark, d), "runs")
    return tree.children_total(tree.descendants(runs, _roots(runs)), fx.runs_costs(spark, d))


def run_cost_summary(spark, d):
    runs = written(_runs(spark, d), "runs")
    return tree.run_cost_summary(runs, fx.runs_costs(spark, d), _roots(runs))


def tree_rollup_all(spark, d):
    return tree.tree_rollup_all(_runs(spark, d), fx.runs_costs(spark, d))


def tree_rollup_chain(spark, d):
    return tree.tree_rollup_all(fx.runs(spark, d, fx.CHAIN), fx.runs_costs(spark, d))


def costs_by_run(spark, d):
    costs = fx.runs_costs(spark, d).withColumns({"id": F.col("cost_name"), "created_at": F.lit(0)})
    rows = document.costs_by_run(costs)
    return rows.select("run_id", F.size("costs").alias("lines"), F.array_join(F.transform("costs", lambda c: F.concat_ws("=", c["costName"], c["totalCostInUsdCents"])), ",").alias("lines_text"))


def run_document(spark, d):
    """Documents of all roots, their descendants one a row."""
    runs = written(_runs(spark, d), "runs")
    costs = fx.runs_costs(spark, d).withColumns({"id": F.col("cost_name"), "created_at": F.lit(0)})
    docs = document.run_document(runs, costs, _roots(runs))
    rows = docs.select("id", "ownCostInUsdCents", "childrenCostInUsdCents", "totalCostInUsdCents", F.size("costs").alias("lines"), F.explode_outer("descendantRuns").alias("d"))
    return rows.select("id", "ownCostInUsdCents", "childrenCostInUsdCents", "totalCostInUsdCents", "lines", F.col("d.id").alias("descendant"), F.col("d.ownCostInUsdCents").alias("descendant_own"))


def run_document_parts(spark, d):
    """The descendants in the parts of documents of at most 2 kB a part, one a row."""
    runs = written(_runs(spark, d), "runs")
    costs = fx.runs_costs(spark, d).withColumns({"id": F.col("cost_name"), "created_at": F.lit(0)})
    parts = document.run_document_parts(runs, costs, _roots(runs), limit=2000)
    return parts.select("id", F.explode("descendantRuns").alias("d")).select("id", F.col("d.id").alias("descendant"), F.col("d.ownCostInUsdCents").alias("descendant_own"), F.size("d.costs").alias("lines"))


def write_documents(spark, d):
    path = new_path(spark, "documents")
    totals = tree_rollup_all(spark, d).select("id", *[fixed10(F.col(c)).alias(c) for c in ("own_cost", "children_cost", "total_cost")])
    io.write_documents(totals, path)
    return spark.read.schema("id long, own_cost string, children_cost string, total_cost string").json(path)


def apply_status_updates(spark, d):
    log = validate.validate_status_updates(fx.status_updates(spark, d))[0]
    return lifecycle.apply_status_updates(_runs(spark, d), log).select("id", "status", "completed_at")


def cascade_delete_runs(spark, d):
    """Deletes the leaves: odd ids have no children in the forest."""
    runs = _runs(spark, d)
    left, costs = lifecycle.cascade_delete_runs(runs, fx.runs_costs(spark, d), runs.where("id % 2 = 1").select("id"))
    return left.select("id").join(listing.costs_total(costs).withColumnRenamed("run_id", "id"), "id", "full")


def evolve_add_dims(spark, d):
    old = _runs(spark, d).select("id", "status", F.when(F.col("id") % 2 == 0, F.col("app_id")).alias("app_id"))
    return lifecycle.evolve_add_dims(old)


def integrity_report(spark, d):
    t = fx.tables(spark, d)
    return integrity.integrity_report(t | {"runs": t["runs"].withColumn("created_at", F.col("started_at"))})


def scalar_functions(spark, d):
    rows = fx.read(spark, d, "part")
    return rows.select("p_partkey", null_if_empty(F.when(F.col("p_size") > 25, "").otherwise(F.col("p_brand"))).alias("brand"), fixed10(F.col("p_retailprice").cast("decimal(10,2)") * F.lit("0.333").cast("decimal(4,3)")).alias("third"),
                       coerce_numeric(F.col("p_size") * 7, 3, 1).alias("fits"), (parse_bound_ts(AFTER) <= F.lit("1995-01-01").cast("timestamp")).alias("before"))


def _drained(query) -> None:
    query.awaitTermination()


def stream_price_costs(spark, d):
    source, out = new_path(spark, "requests"), new_path(spark, "stream")
    _items(spark, d).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    _drained(jobs.stream_price_costs(stream, _runs(spark, d), fx.price_list(spark, d), {k: f"{out}/{k}" for k in ("costs", "rejects", "checkpoint")}))
    good = spark.read.parquet(f"{out}/costs").groupBy("request_id").agg(F.sum("total").cast("decimal(26,10)").alias("total"))
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(spark.read.parquet(f"{out}/rejects").select("request_id", F.lit(None).cast("decimal(26,10)").alias("total"), "reason"))


def stream_status_updates(spark, d):
    source, out = new_path(spark, "requests"), new_path(spark, "stream")
    fx.status_updates(spark, d).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    runs = _runs(spark, d)
    _drained(jobs.stream_status_updates(stream, runs, {k: f"{out}/{k}" for k in ("log", "rejects", "checkpoint")}))
    return lifecycle.apply_status_updates(runs, spark.read.parquet(f"{out}/log")).select("id", "status", "completed_at")


def stream_status_json(spark, d):
    """Status requests from JSON files, as a stream."""
    source, out = new_path(spark, "requests"), new_path(spark, "stream")
    fx.status_updates(spark, d).withColumns({"request_id": F.col("request_id").cast("string"), "run_id": F.col("run_id").cast("string")}).write.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(source)
    runs = _runs(spark, d).withColumn("id", F.col("id").cast("string"))
    _drained(jobs.stream_status_updates(io.read_requests(spark, source, "status", stream=True), runs, {k: f"{out}/{k}" for k in ("log", "rejects", "checkpoint")}))
    log = spark.read.parquet(f"{out}/log").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return lifecycle.apply_status_updates(runs, log).select(F.col("id").cast("long").alias("id"), "status", "completed_at")


def stream_status_snapshot(spark, d):
    """The state from the levels that a stream of small batches leaves, without the log."""
    source, out = new_path(spark, "requests"), new_path(spark, "stream")
    fx.status_updates(spark, d).repartition(5, "request_id").write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source)
    runs = _runs(spark, d)
    query = jobs.stream_status_updates(stream, runs, {k: f"{out}/{k}" for k in ("log", "rejects", "checkpoint", "snapshot")}, fan=2)
    _drained(query)
    held = jobs.status_levels(spark, f"{out}/snapshot", stream.schema, fan=2).read(query.lastProgress["batchId"] + 1)
    return lifecycle.apply_status_updates(runs, held).select("id", "status", "completed_at")


def stream_create_runs(spark, d):
    source, out = new_path(spark, "requests"), new_path(spark, "stream")
    fx.create_requests(spark, d).withColumn("request_id", F.col("request_id").cast("string")).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    tables = {"organizations": _nation_orgs(spark, d), "users": fx.users(spark, d).select(F.col("id").cast("string").alias("id"), "external_id", F.col("organization_id").cast("string").alias("organization_id")), "runs": _runs(spark, d).select(F.col("id").cast("string").alias("id"))}
    new = {"organizations": F.concat(F.lit("new-"), F.col("external_id")), "users": F.concat(F.lit("new-"), F.col("external_id")), "runs": F.col("request_id")}
    _drained(jobs.stream_create_runs(stream, tables, {k: f"{out}/{k}" for k in ("organizations", "users", "runs", "rejects", "checkpoint")}, new.get))
    good = spark.read.parquet(f"{out}/runs").select(F.col("id").alias("request_id"), "organization_id", "user_id", F.lit(None).cast("string").alias("reason"))
    bad = spark.read.parquet(f"{out}/rejects").select("request_id", F.lit(None).cast("string").alias("organization_id"), F.lit(None).cast("string").alias("user_id"), "reason")
    return good.unionByName(bad)


def stream_own_cost(spark, d):
    source, out = new_path(spark, "lines"), new_path(spark, "stream")
    fx.runs_costs(spark, d).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    _drained(jobs.start_own_cost(stream, {k: f"{out}/{k}" for k in ("costs", "checkpoint")}))
    return spark.read.parquet(f"{out}/costs").groupBy("run_id").agg(F.max_by("own_cost", "batch_id").alias("own_cost"))


QUERIES = {f.__name__: f for f in (
    list_runs, list_runs_filtered, list_runs_stored, filter_tenant, filter_user, filter_dims, filter_parent, filter_started_range, unknown_key_is_empty, page_second,
    runs_with_costs_join, own_cost_per_run, own_total, price_cost_items, priced_rejects, distinct_cost_names, read_price_list, validate_runs,
    validate_status_updates, validate_cost_batches, lookup_runs, check_run_exists, update_target_exists, check_parent_exists, resolve_orgs, resolve_users,
    apply_run_defaults, append_runs, append_costs, read_requests, read_requests_costs, read_price_list_json, scan_tables, descendants, descendants_chain, descendants_by_interval, descendants_by_interval_chain, is_below, project_descendant, costs_of_descendants, attach_costs_to_descendants,
    descendant_own_totals, children_total, run_cost_summary, tree_rollup_all, tree_rollup_chain, costs_by_run, run_document, run_document_parts, write_documents,
    apply_status_updates, cascade_delete_runs, evolve_add_dims, integrity_report, scalar_functions, stream_price_costs, stream_status_updates, stream_status_snapshot, stream_status_json,
    stream_create_runs, stream_own_cost,
)}
