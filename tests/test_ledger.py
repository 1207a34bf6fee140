"""Golden values of small ledgers, and trees against a plain walk."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from treetally.operators import keys, lifecycle, listing, pricing, skew, tree, validate
from treetally.sources import shared

RUN = "id string, parent_run_id string"
COST = "run_id string, total_cost_in_usd_cents decimal(16,10)"


def costs(spark, *rows):
    return spark.createDataFrame([(r, Decimal(str(c))) for r, c in rows], COST)


def test_parent_and_child(spark):
    runs = spark.createDataFrame([("P", None), ("C", "P")], RUN)
    row = tree.run_cost_summary(runs, costs(spark, ("P", 0.3), ("C", 0.15)), spark.createDataFrame([("P",)], "id string")).first()
    assert [str(row[c]) for c in ("own_cost", "children_cost", "total_cost")] == ["0.3000000000", "0.1500000000", "0.4500000000"]


def test_rollup_equals_walk_and_finds_cycles(spark):
    rows = [(str(i), None if i % 16 == 0 else str(i & (i - 1)) if i < 200 else str(i - 1)) for i in range(300)] + [("x", "missing")]
    runs = spark.createDataFrame(rows, RUN)
    got = {r["id"]: r["total_cost"] for r in tree.tree_rollup_all(runs, costs(spark, *[(i, 1) for i, _ in rows])).collect()}
    parent, want = dict(rows), dict.fromkeys(dict(rows), 0)
    for i in parent:
        at = i
        while at in parent:
            want[at] += 1
            at = parent[at]
    assert got == want
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], RUN)
    with pytest.raises(ValueError):
        tree.tree_rollup_all(loop, costs(spark, ("a", 1)))
    assert tree.descendants(loop, spark.createDataFrame([("a",)], "id string")).count() == 1


def test_unknown_cost_rejects_the_whole_request(spark):
    items = spark.createDataFrame([("1", "a", Decimal(1000)), ("1", "zz", Decimal(1)), ("2", "a", Decimal(1000))], "request_id string, cost_name string, quantity decimal(20,6)")
    prices = spark.createDataFrame([("a", Decimal("0.0003"))], "cost_name string, unit_cost decimal(12,10)")
    good, bad = pricing.price_cost_items(items, prices)
    assert [(r["request_id"], str(r["total"])) for r in good.collect()] == [("2", "0.3000000000")]
    assert [(r["request_id"], r["unknown_names"]) for r in bad.collect()] == [("1", ["zz"])]


def test_validation(spark):
    rows = spark.createDataFrame([("1", "completed"), ("2", "running"), ("3", None)], "request_id string, status string")
    good, bad = validate.validate_status_updates(rows)
    assert [r[0] for r in good.collect()] == ["1"] and bad.count() == 2
    items = "request_id string, items array<struct<costName:string,quantity:decimal(24,10)>>"
    rows = spark.createDataFrame([("1", [("a", Decimal(1))]), ("2", []), ("3", None), ("4", [("a", Decimal(0))]), ("5", [("", Decimal(1)), ("a", Decimal(1))])], items)
    good, bad = validate.validate_cost_batches(rows)
    assert [r[0] for r in good.collect()] == ["1"] and bad.count() == 4


def test_paging_and_filters():
    assert [listing.page_limit(x) for x in (None, "0", "x", 7, 999, "1e2", "7.0", " 9 ", "1_0")] == [50, 50, 50, 7, 200, 100, 7, 9, 50]
    with pytest.raises(ValueError):
        listing.page_limit("7.5")
    with pytest.raises(ValueError):
        listing.page_offset(-1)
    with pytest.raises(ValueError):
        listing.compose_filters(color="red")


def test_last_update_wins_and_delete_is_all_or_nothing(spark):
    runs = spark.createDataFrame([("P", None, "running", None), ("C", "P", "running", None)], RUN + ", status string, completed_at string")
    log = spark.createDataFrame([("P", "completed", "1", 1), ("P", "failed", "2", 2)], "run_id string, status string, ts string, seq int")
    assert {(r["id"], r["status"], r["completed_at"]) for r in lifecycle.apply_status_updates(runs, log).collect()} == {("P", "failed", "2"), ("C", "running", None)}
    with pytest.raises(ValueError):
        lifecycle.cascade_delete_runs(runs, costs(spark, ("P", 1)), spark.createDataFrame([("P",)], "id string"))
    left, lines = lifecycle.cascade_delete_runs(runs, costs(spark, ("P", 1), ("C", 1)), spark.createDataFrame([("C",)], "id string"))
    assert [r["id"] for r in left.collect()] == ["P"] and lines.count() == 1


def test_missing_parent_names_the_id(spark):
    runs = spark.createDataFrame([("P", None)], RUN)
    requests = spark.createDataFrame([("1", "P"), ("2", "Q"), ("3", None)], "request_id string, parentRunId string")
    good, bad = keys.check_parent_exists(requests, runs)
    assert {r["request_id"] for r in good.collect()} == {"1", "3"} and "Q" in bad.first()["reason"]
    assert lifecycle.evolve_add_dims(runs).select(F.first("app_id")).first()[0] == "unknown"


def plain_descendants(rows, roots):
    """(root, id): least depth, by a walk a root."""
    out = {}
    for root in roots:
        at, depth = {root}, 0
        while at:
            depth += 1
            at = {i for i, p in rows if p in at} - {i for r, i in out if r == root} - {root}
            out |= {(root, i): depth for i in at}
    return out


@pytest.mark.parametrize("shallow", [2, 8])
def test_descendants_of_deep_trees_stars_and_cycles(spark, shallow):
    chain = [("c0", None), *[(f"c{i}", f"c{i - 1}") for i in range(1, 40)]]
    star = [("s", None), *[(f"s{i}", "s") for i in range(200)], *[(f"t{i}", f"s{i}") for i in range(50)]]
    loop = [("a", "e"), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "d"), ("tail", "d")]
    rows, roots = chain + star + loop, ["c0", "c5", "s", "s1", "a", "nobody"]
    got = tree.descendants(spark.createDataFrame(rows, RUN), spark.createDataFrame([(r,) for r in roots], "id string"), shallow).collect()
    assert {(r["root"], r["id"]): r["depth"] for r in got} == plain_descendants(rows, roots)
    assert len(got) == len(plain_descendants(rows, roots))


def grown(shape, n=400, seed=2):
    """(id, parent) of trees of a shape."""
    rng = random.Random(seed)
    parent = {
        "star": lambda i: 0, "chain": lambda i: i - 1, "random": lambda i: rng.randrange(i), "caterpillar": lambda i: i - 1 if i % 2 else max(0, i - 2),
        "recent": lambda i: max(0, i - rng.choice([1, 1, 1, 2, 5])), "two chains over a fork": lambda i: max(0, i - 2) if i > 100 else i - 1,
    }[shape]
    return [("n0", None), *[(f"n{i}", f"n{parent(i)}") for i in range(1, n)], ("lost", "nobody"), ("below", "lost")]


@pytest.mark.parametrize("shape", ["star", "chain", "random", "caterpillar", "recent", "two chains over a fork"])
def test_rollup_by_contraction(spark, shape):
    rows = grown(shape)
    parent, want = dict(rows), dict.fromkeys(dict(rows), 0)
    for i in parent:
        at = i
        while at in parent:
            want[at] += 1
            at = parent[at]
    got = tree.tree_rollup_all(spark.createDataFrame(rows, RUN), costs(spark, *[(i, 1) for i, _ in rows])).collect()
    assert {r["id"]: (r["own_cost"], r["children_cost"], r["total_cost"]) for r in got} == {i: (1, n - 1, n) for i, n in want.items()} and len(got) == len(rows)


def test_rollup_state_shrinks(spark, monkeypatch):
    """What is written over all rounds of a bushy forest is a few times its rows, and for a chain the logarithm of its length."""
    sizes = []
    keep = tree.written
    monkeypatch.setattr(tree, "written", lambda df, label: (out := keep(df, label), sizes.append(out.count()))[0])
    rows = [(str(i), None if i % 64 == 0 else str(i & (i - 1))) for i in range(1, 1024)]
    tree.tree_rollup_all(spark.createDataFrame(rows, RUN), costs(spark, ("1", 1)))
    assert sum(sizes) < 2.5 * len(rows) and sizes == sorted(sizes, reverse=True)
    sizes.clear()
    tree.tree_rollup_all(spark.createDataFrame(grown("chain", 200), RUN), costs(spark, ("n1", 1)))
    assert len(sizes) <= 7


def test_rollup_with_a_cycle_below_trees(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("y", "x"), ("r", None), ("s", "r")]
    with pytest.raises(ValueError, match="cycle"):
        tree.tree_rollup_all(spark.createDataFrame(rows, RUN), costs(spark, ("a", 1)))
    assert tree.tree_rollup_all(spark.createDataFrame([], RUN), costs(spark, ("a", 1))).count() == 0


def test_lookup_spreads_heavy_keys_and_nulls(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 2 else None if i % 3 == 0 else str(i)) for i in range(600)], "id int, k string")
    table = spark.createDataFrame([("hot", 1), ("2", 2), ("unused", 3)], "k string, v int")
    got = {r["id"]: r["v"] for r in skew.lookup(rows, table, "k", F.col("id"), split=50).collect()}
    assert got == {i: 1 if i % 2 else 2 if i == 2 else None for i in range(600)}
    ways = {r["k"]: r["_ways"] for r in skew.heavy_keys(rows.groupBy("k").agg(F.count("*").alias("n")), "k", split=50).collect()}
    assert ways == {"hot": 6}


def test_temporary_tables_are_dropped(spark):
    with shared.temporary(spark):
        path = shared.new_path(spark, "kept")
        spark.range(3).write.parquet(path)
        assert shared.exists(spark, path)
    assert not shared.exists(spark, path)
    outside = shared.new_path(spark, "stays")
    spark.range(3).write.parquet(outside)
    with shared.temporary(spark):
        shared.written(spark.range(2), "goes")
    assert shared.exists(spark, outside)
