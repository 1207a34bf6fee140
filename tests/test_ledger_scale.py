"""Structures that hold at scale: intervals, levels, parts, layouts, hot keys and plans."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from test_ledger import COST, RUN, grown, plain_descendants
from treetally.operators import document, integrity, intervals, keys, lifecycle, listing, pricing, tree
from treetally.plans import queries
from treetally.sources import layout, shared
from treetally.sources import fixtures as fx
from treetally.sources.shared import new_path
from treetally.streaming import jobs
from treetally.streaming.levels import Levels


def ids(spark, names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("shape", ["star", "chain", "random", "recent"])
def test_intervals_hold_descendants(spark, shape):
    rows = grown(shape, 150)
    labels = intervals.labelled(spark.createDataFrame(rows, RUN), split=20)
    labels.write.parquet(path := new_path(spark, "labels"))
    labels = spark.read.parquet(path)
    held = {r["id"]: r for r in labels.collect()}
    assert set(held) == {i for i, _ in rows} and len({r["pre"] for r in held.values()}) == len(rows)
    roots = ["n0", "n1", "n7", "n80", "lost", "nobody"]
    want = plain_descendants(rows, roots[:-1])  # an id that is no run has none
    got = intervals.descendants_within(labels, ids(spark, roots), block=16).collect()
    assert {(r["root"], r["id"]): r["depth"] for r in got} == want and len(got) == len(want)
    assert held["lost"]["parent"] is None and held["below"]["depth"] == 1
    pairs = [(a, b) for a in ("n5", "n149", "below", "gone") for b in ("n0", "n5", "lost", "gone")]
    below = intervals.is_below(spark.createDataFrame(pairs, "id string, other string"), labels, split=3).collect()
    known = set(held)
    assert {(r["id"], r["other"]): r["below"] for r in below} == {(a, b): (b, a) in plain_descendants(rows, [b]) if {a, b} <= known else None for a, b in pairs}


def test_labels_of_a_chain_take_no_rounds(spark, monkeypatch):
    """A chain of 200 with a leaf on each node: the steps of the contraction are taken back, each by
    one join, and no label is followed upwards round by round."""
    tables = []
    keep = lambda df, label, by=None: tables.append(label) or shared.written(df, label, **({"by": by} if by else {}))
    for module in (intervals, tree):
        monkeypatch.setattr(module, "written", keep)
    rows = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(200)] + [(f"leaf{i}", f"n{i}") for i in range(200)]
    labels = {r["id"]: r for r in intervals.labelled(spark.createDataFrame(rows, RUN)).collect()}
    assert all(labels[f"n{i}"]["depth"] == i and labels[f"leaf{i}"]["depth"] == i + 1 for i in range(200))
    assert all(labels[p]["pre"] < labels[i]["pre"] <= labels[i]["last"] <= labels[p]["last"] for i, p in rows if p)
    assert tables.count("labels") <= 3


def test_intervals_refuse_cycles(spark):
    with pytest.raises(ValueError, match="cycle"):
        intervals.labelled(spark.createDataFrame([("a", "b"), ("b", "a"), ("c", None)], RUN))


def test_running_sums(spark):
    rows = [(i % 7, i, i % 5) for i in range(500)]
    got = intervals.running_sums(spark.createDataFrame(rows, "k int, i int, v int").repartition(5), ["k", "i"], "v", "s").collect()
    total, want = 0, {}
    for k, i, v in sorted(rows):
        want[i], total = total, total + v
    assert {r["i"]: r["s"] for r in got} == want


def test_hot_name_and_plan_of_pricing(spark):
    """One name on most lines; lines are read and joined once."""
    items = [(str(i // 4), "hot" if i % 9 else f"n{i % 5}", Decimal(i % 7 + 1)) for i in range(900)] + [("odd", "hot", Decimal(1)), ("odd", "unknown", Decimal(1))]
    items = spark.createDataFrame(items, "request_id string, cost_name string, quantity decimal(20,6)")
    prices = spark.createDataFrame([("hot", Decimal("0.5")), *[(f"n{i}", Decimal("0.25")) for i in range(5)]], "cost_name string, unit_cost decimal(12,10)")
    text = lambda df: sorted(map(str, df.select("request_id", "cost_name", "quantity", "unit_cost", "total").collect()))
    plain, spread = pricing.price_cost_items(items, prices), pricing.price_cost_items(items, prices, split=50)
    assert text(plain[0]) == text(spread[0]) and len(text(plain[0])) == 900
    assert [r["request_id"] for r in plain[1].collect()] == [r["request_id"] for r in spread[1].collect()] == ["odd"]
    plan = planned(queries.price_cost_items(spark, "/root/testdata/sf0.001"))
    assert plan.count("FileScan") == 2 and plan.count("Join") == 1


def test_one_parent_on_all_requests(spark):
    runs = spark.createDataFrame([("P", None)], RUN)
    requests = spark.createDataFrame([(str(i), "P" if i % 10 else "Q" if i % 20 else None) for i in range(400)], "request_id string, parentRunId string")
    good, bad = keys.check_parent_exists(requests, runs, split=30)
    assert {r["request_id"] for r in good.collect()} == {str(i) for i in range(400) if i % 10 or i % 20 == 0}
    assert {r["request_id"] for r in bad.collect()} == {str(i) for i in range(400) if i % 10 == 0 and i % 20}
    updates = requests.withColumnRenamed("parentRunId", "run_id")
    good, bad = keys.check_run_exists(updates, runs, split=30)
    assert good.count() == 360 and bad.count() == 40  # one without a run is not found either


def test_document_parts_make_the_document(spark):
    full = "id string, parent_run_id string, service_name string, task_name string, status string, started_at int, completed_at int"
    runs = spark.createDataFrame([(i, p, "s", "t", "running", 1, None) for i, p in grown("recent", 120)], full)
    lines = spark.createDataFrame([(f"c{i}", f"n{i % 60}", "x", Decimal(1), Decimal(2), Decimal(i), 0) for i in range(100)],
                                  "id string, run_id string, cost_name string, quantity decimal(20,6), unit_cost_in_usd_cents decimal(12,10), total_cost_in_usd_cents decimal(16,10), created_at int")
    roots = ids(spark, ["n0", "n3", "lost", "below", "nobody"])
    docs = {r["id"]: r for r in document.run_document(runs, lines, roots).collect()}
    parts = document.run_document_parts(runs, lines, roots, limit=3000).collect()
    assert set(docs) == {"n0", "n3", "lost", "below"} and docs["below"]["descendantRuns"] == [] and max(r["part"] for r in parts) > 5
    for i, doc in docs.items():
        own = sorted((r for r in parts if r["id"] == i), key=lambda r: r["part"])
        assert [x for r in own for x in r["descendantRuns"]] == doc["descendantRuns"] and [r["part"] for r in own] == list(range(len(own)))
    assert Decimal(docs["n0"]["totalCostInUsdCents"]) == sum(range(100))


def test_levels_read_few_runs(spark):
    path = new_path(spark, "levels")
    levels = Levels(spark, path, spark.range(1).schema, fan=3)
    for n in range(14):
        rows = spark.range(n * 2, n * 2 + 2)
        levels.add(rows, n)
        if n in (4, 8):  # a batch that is tried again
            levels.add(rows, n)
        assert sorted(r["id"] for r in levels.read(n + 1).collect()) == list(range(2 * n + 2))
        assert len(levels.runs(n + 1)) <= 6
    assert len(levels.runs(81)) == 1 and len(levels.runs(10**6)) < 2 * 13 and levels.read(0).count() == 0


def test_snapshot_and_tail_fold_like_the_log(spark):
    rng = random.Random(4)
    log = [(str(rng.randrange(12)), rng.choice(["completed", "failed"]), rng.randrange(9), i) for i in range(200)]
    frame = lambda rows: spark.createDataFrame(rows, "run_id string, status string, ts int, seq int")
    runs = spark.createDataFrame([(str(i), "running", None) for i in range(15)], "id string, status string, completed_at int")
    snapshot = lifecycle.last_updates(frame(log[:150]))
    want = lifecycle.apply_status_updates(runs, frame(log)).collect()
    assert sorted(lifecycle.apply_status_updates(runs, snapshot.unionByName(frame(log[150:]))).collect()) == sorted(want)


def test_create_runs_in_many_batches(spark):
    """Keys of earlier batches are known in later ones, whichever level they are in."""
    source, out, d = new_path(spark, "requests"), new_path(spark, "stream"), "/root/testdata/sf0.001"
    requests = fx.create_requests(spark, d).withColumn("request_id", F.col("request_id").cast("string")).where("appId <> '' and taskName is not null and coalesce(brandId, 'x') <> ''")
    requests.repartition(7, "request_id").write.parquet(source)
    stream = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", 1).parquet(source)
    none = {"organizations": "id string, external_id string", "users": "id string, external_id string, organization_id string", "runs": "id string"}
    tables = {k: spark.createDataFrame([], s) for k, s in none.items()}
    jobs.stream_create_runs(stream, tables, {k: f"{out}/{k}" for k in ("organizations", "users", "runs", "rejects", "checkpoint")}, fan=2).awaitTermination()
    orgs, users = spark.read.parquet(f"{out}/organizations"), spark.read.parquet(f"{out}/users")
    assert orgs.select("batch_id").distinct().count() > 1 or orgs.count() > 0
    for df, column in ((orgs, "clerkOrgId"), (users, "clerkUserId")):
        assert df.count() == df.select("external_id").distinct().count() == requests.where(F.col(column).isNotNull() & ~F.coalesce(F.col("parentRunId") == "parent", F.lit(False))).select(column).distinct().count()
    runs = spark.read.parquet(f"{out}/runs")
    assert runs.join(orgs.select(F.col("id").alias("organization_id")), "organization_id", "left_anti").count() == 0


def test_create_runs_reads_a_batch_once(spark):
    """Each request is read and judged once, whatever is written of it."""
    source, out, d = new_path(spark, "requests"), new_path(spark, "stream"), "/root/testdata/sf0.001"
    requests = fx.create_requests(spark, d).withColumn("request_id", F.col("request_id").cast("string"))
    requests.write.parquet(source)
    reads = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: (reads.add(1), x)[1]).asNondeterministic()
    stream = spark.readStream.schema(requests.schema).parquet(source).withColumn("appId", seen("appId"))
    none = {"organizations": "id string, external_id string", "users": "id string, external_id string, organization_id string", "runs": "id string"}
    jobs.stream_create_runs(stream, {k: spark.createDataFrame([], s) for k, s in none.items()}, {k: f"{out}/{k}" for k in ("organizations", "users", "runs", "rejects", "checkpoint")}).awaitTermination()
    n = requests.count()
    assert reads.value == n
    assert spark.read.parquet(f"{out}/runs").count() + spark.read.parquet(f"{out}/rejects").count() == n


def test_own_cost_goes_on_after_a_restart(spark):
    source, out = new_path(spark, "lines"), new_path(spark, "stream")
    rows = [(f"r{i % 5}", Decimal(i)) for i in range(40)]
    frame = lambda part: spark.createDataFrame(part, COST)
    sums = lambda part: {k: sum(c for r, c in part if r == k) for k, _ in part}

    def drained():
        stream = spark.readStream.schema(frame(rows).schema).parquet(source)
        jobs.start_own_cost(stream, {k: f"{out}/{k}" for k in ("costs", "checkpoint")}).awaitTermination()
        rows_ = spark.read.parquet(f"{out}/costs").groupBy("run_id").agg(F.max_by("own_cost", "batch_id").alias("own")).collect()
        return {r["run_id"]: r["own"] for r in rows_}

    frame(rows[:25]).write.parquet(source)
    assert drained() == sums(rows[:25])
    frame(rows[25:]).write.mode("append").parquet(source)
    assert drained() == sums(rows)


def test_integrity_counts_and_exchanges(spark):
    tables = {
        "organizations": spark.createDataFrame([("o", "x"), ("o", "y"), ("p", "x")], "id string, external_id string"),
        "users": spark.createDataFrame([("u", "e", "o"), ("v", "f", "gone")], "id string, external_id string, organization_id string"),
        "runs": spark.createDataFrame([("a", None, "o", "u"), ("b", "a", "p", None), ("c", "lost", "gone", "w"), ("d", "lost", "o", "u")], "id string, parent_run_id string, organization_id string, user_id string"),
        "runs_costs": spark.createDataFrame([("1", "a"), ("2", "zz"), ("3", "zz"), ("4", None)], "id string, run_id string"),
    }
    report = integrity.integrity_report(tables)
    got = {r["constraint"]: r["violations"] for r in report.collect() if r["violations"]}
    assert got == {"organizations.id unique": 1, "organizations.external_id unique": 1, "users.organization_id in organizations": 1, "runs.organization_id in organizations": 1,
                   "runs.user_id in users": 1, "runs.parent_run_id in runs": 2, "runs_costs.run_id in runs": 2, "runs_costs.run_id not null": 1, "runs.parent_run_id same organization": 1}


def test_stored_runs_are_pruned(spark):
    d, path = "/root/testdata/sf0.001", new_path(spark, "runs")
    runs, orgs = fx.runs(spark, d), fx.organizations(spark, d)
    layout.store_runs(runs, path)
    some = layout.runs_of(spark, path, orgs, "NATION_6", "1994-02-03T00:00:00", "1994-04-30T00:00:00")
    want = listing.filter_started_range(listing.filter_tenant(runs, orgs, "NATION_6"), "1994-02-03T00:00:00", "1994-04-30T00:00:00")
    assert sorted(r["id"] for r in some.collect()) == sorted(r["id"] for r in want.collect())
    assert "tenant" in planned(some).split("PartitionFilters: [")[1].split("]")[0] and "month" in planned(some).split("PartitionFilters: [")[1].split("]")[0]
    files = {f.split("/month=")[0].split("tenant=")[1] for f in some.inputFiles()}
    assert layout.runs_of(spark, path, orgs, "nobody").count() == 0 and files


def test_numbers_of_pages():
    assert [listing.page_limit(x) for x in ("0x10", "Infinity", "1e30", "0b11", "nonsense")] == [16, 200, 200, 3, 50]
    assert listing.page_offset("1e30") == listing.LARGEST


def test_small_documents_are_cut_without_ranges(spark, monkeypatch):
    full = "id string, parent_run_id string, service_name string, task_name string, status string, started_at int, completed_at int"
    runs = spark.createDataFrame([(i, p, "s", "t", "running", 1, None) for i, p in grown("recent", 120)], full)
    lines = spark.createDataFrame([(f"c{i}", f"n{i % 60}", "x", Decimal(1), Decimal(2), Decimal(i), 0) for i in range(100)],
                                  "id string, run_id string, cost_name string, quantity decimal(20,6), unit_cost_in_usd_cents decimal(12,10), total_cost_in_usd_cents decimal(16,10), created_at int")
    roots = ids(spark, ["n0", "n3", "n60", "lost", "below", "nobody"])

    def listed(parts):
        rows = sorted(parts.collect(), key=lambda r: (r["id"], r["part"]))
        return {i: [x for r in rows if r["id"] == i for x in r["descendantRuns"]] for i in {r["id"] for r in rows}}

    ranged = listed(document.run_document_parts(runs, lines, roots, limit=3000, large=3))  # small and large documents
    monkeypatch.setattr(document, "running_sums", None)
    assert ranged == listed(document.run_document_parts(runs, lines, roots, limit=3000)) and len(ranged["n0"]) > 100


def test_cost_batches_are_joined_to_runs_once(spark, monkeypatch):
    """Each kind of reject, and a batch that is written once after its one check of runs."""
    source, out = new_path(spark, "requests"), new_path(spark, "stream")
    item = "items array<struct<costName: string, quantity: decimal(24,10)>>"
    rows = [("ok", "r1", [("a", Decimal(2))]), ("lost", "gone", [("a", Decimal(1))]), ("none", "gone", []), ("null", None, None), ("bad", "r1", [("a", Decimal(0))]), ("new", "r2", [("z", Decimal(1)), ("a", Decimal(1))])]
    spark.createDataFrame(rows, f"request_id string, run_id string, {item}").write.parquet(source)
    runs, prices = ids(spark, ["r1", "r2"]), spark.createDataFrame([("a", Decimal("0.5"))], "cost_name string, unit_cost decimal(12,10)")
    made, real = [], jobs.written
    monkeypatch.setattr(jobs, "written", lambda df, label: made.append(label) or real(df, label))
    jobs.stream_price_costs(spark.readStream.schema(spark.read.parquet(source).schema).parquet(source), runs, prices, {k: f"{out}/{k}" for k in ("costs", "rejects", "checkpoint")}).awaitTermination()
    assert made == ["judged"] and [r["request_id"] for r in spark.read.parquet(f"{out}/costs").collect()] == ["ok"]
    want = {"lost": "run not found", "none": "items required", "null": "items required", "bad": "bad item", "new": "unknown cost: z"}
    assert {r["request_id"]: r["reason"] for r in spark.read.parquet(f"{out}/rejects").collect()} == want
