"""Descendants and cost roll-ups over the forest of runs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from ..functions.scalars import zero_if_no_cost
from ..sources.shared import written
from .listing import costs_total

#: Levels that are walked one by one; what lies deeper is reached by doubling steps.
SHALLOW = 8
#: Joins of one job that follows the pointers of a chain.
HOPS = 3
#: What a step of a contraction took away.
RAKED, CHAINS = "raked", "chains"


def descendants(runs: DataFrame, roots: DataFrame, shallow: int = SHALLOW) -> DataFrame:
    """(root, id, depth) for all runs below each id of roots.

    The first levels are frontier joins, one a level, which touch only what lies below the
    roots. Below them, a table of steps of length 1, 2, 4 ... is doubled until no step is
    left, and the frontier takes each length or not, from the longest: as many jobs as the
    logarithm of the depth. In a cycle each run counts once, at its least depth, and the root
    not at all. Organizations play no part."""
    edges = runs.select(F.col("parent_run_id").alias("at"), F.col("id").alias("next")).where(F.col("at").isNotNull())
    frontier = roots.select(F.col("id").alias("root")).distinct().select("root", F.col("root").alias("id"))
    levels, depth = [], 0
    seen = frontier
    while True:
        depth += 1
        step = frontier.withColumnRenamed("id", "at").join(edges, "at").select("root", F.col("next").alias("id"))
        frontier = written(step.join(seen, ["root", "id"], "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        levels.append(frontier.withColumn("depth", F.lit(depth)))
        seen = union_all(seen, frontier)
        if depth == shallow:
            levels.append(_deeper(levels.pop(), edges, seen.join(frontier, ["root", "id"], "left_anti")))
            break
    return union_all(*levels) if levels else frontier.withColumn("depth", F.lit(0))


def _deeper(frontier: DataFrame, edges: DataFrame, seen: DataFrame) -> DataFrame:
    """frontier (root, id, depth) and all below it but what was seen."""
    steps, most = [written(edges, "steps")], math.ceil(math.log2(max(2, edges.count()))) + 1
    while len(steps) <= most:
        far = steps[-1].select(F.col("at").alias("next"), F.col("next").alias("further"))
        longer = written(steps[-1].join(far, "next").select("at", F.col("further").alias("next")), "steps")
        if longer.isEmpty():
            break
        steps.append(longer)
    cyclic = len(steps) > most
    reached = frontier
    for k in range(len(steps) - 1, -1, -1):
        below = reached.withColumnRenamed("id", "at").join(steps[k], "at").select("root", F.col("next").alias("id"), (F.col("depth") + F.lit(1 << k)).cast("int").alias("depth"))
        reached = union_all(reached, below)
        if cyclic:
            reached = reached.groupBy("root", "id").agg(F.min("depth").alias("depth"))
        reached = written(reached, "reached")
    return reached.join(seen, ["root", "id"], "left_anti") if cyclic else reached


def union_all(first: DataFrame, *more: DataFrame) -> DataFrame:
    """All rows of all parts, repeats included."""
    for part in more:
        first = first.unionByName(part)
    return first


def costs_of_descendants(desc: DataFrame, costs: DataFrame) -> DataFrame:
    return costs.join(desc.select(F.col("id").alias("run_id")).distinct(), "run_id", "left_semi")


def descendant_own_totals(desc: DataFrame, costs: DataFrame) -> DataFrame:
    """(root, id, own_cost)."""
    return desc.select("root", "id").join(costs_total(costs).withColumnRenamed("run_id", "id"), "id", "left").select("root", "id", zero_if_no_cost(F.col("own")).alias("own_cost"))


def children_total(desc: DataFrame, costs: DataFrame) -> DataFrame:
    """(root, children_cost): over all descendants, not only children."""
    return summed_children(descendant_own_totals(desc, costs))


def summed_children(own_totals: DataFrame) -> DataFrame:
    """(root, children_cost) from (root, id, own_cost)."""
    return own_totals.groupBy("root").agg(F.sum("own_cost").cast("decimal(26,10)").alias("children_cost"))


def run_cost_summary(runs: DataFrame, costs: DataFrame, roots: DataFrame, own_totals: DataFrame | None = None) -> DataFrame:
    """(id, own_cost, children_cost, total_cost) for the ids of roots that are runs. own_totals: of
    the roots' descendants, where they are known already."""
    known = runs.join(roots.select("id").distinct(), "id", "left_semi").select("id")
    below = summed_children(descendant_own_totals(descendants(runs, known), costs) if own_totals is None else own_totals).withColumnRenamed("root", "id")
    rows = known.join(costs_total(costs).withColumnRenamed("run_id", "id"), "id", "left").join(below, "id", "left")
    rows = rows.select("id", zero_if_no_cost(F.col("own")).alias("own_cost"), zero_if_no_cost(F.col("children_cost")).alias("children_cost"))
    return rows.withColumn("total_cost", (F.col("own_cost") + F.col("children_cost")).cast("decimal(26,10)"))


def tree_rollup_all(runs: DataFrame, costs: DataFrame) -> DataFrame:
    """(id, own_cost, children_cost, total_cost) for every run at once.

    A parent that isn't a run counts as none. A cycle is an error."""
    own = costs_totalled(runs, costs).select("id", F.col("parent_run_id").alias("parent"), F.col("own_cost").alias("value"))
    rows = contracted(own)
    return rows.select("id", F.col("value").alias("own_cost"), (F.col("total") - F.col("value")).cast("decimal(26,10)").alias("children_cost"), F.col("total").cast("decimal(26,10)").alias("total_cost"))


def costs_totalled(runs: DataFrame, costs: DataFrame) -> DataFrame:
    """runs with own_cost, 0 where a run has no lines."""
    return runs.join(costs_total(costs).withColumnRenamed("run_id", "id"), "id", "left").withColumn("own_cost", zero_if_no_cost(F.col("own"))).drop("own")


def contracted(nodes: DataFrame) -> DataFrame:
    """(id, value, total): for each of nodes (id, parent, value) the sum of value over its subtree,
    by tree contraction; other columns of nodes come along."""
    kind = nodes.schema["value"].dataType
    total = f"decimal(38,{kind.scale})" if isinstance(kind, DecimalType) else kind.simpleString()
    known = ["id", *[c for c in nodes.columns if c not in ("id", "parent")]]
    steps = contraction(nodes)
    out = union_all(*[rows.select(*known, "total") for what, rows in steps if what == RAKED])
    aside = [rows for what, rows in steps if what == CHAINS]
    for n, chains in enumerate(reversed(aside), 1):
        below = out.select(F.col("id").alias("down"), F.col("total").alias("below"))
        given = chains.join(below, "down").select(*known, (F.col("sum") + F.col("below")).cast(total).alias("total"))
        out = union_all(out, given if n == len(aside) else written(given, "rollup"))
    return out


def contraction(nodes: DataFrame, deep: bool = False) -> list[tuple[str, DataFrame]]:
    """The steps in which nodes (id, parent, value) are taken away until none is left, each node in
    one of them; other columns of nodes come along.

    The state has the nodes that aren't done, and shrinks. Raking: nodes without open children
    are done, and their totals are added to their parents. Once that takes under a fifth of the
    state, chains of nodes with one open child are compressed: such nodes leave the state with
    the sum from there to the node below their chain, which takes the place of the chain and
    carries what it holds; when all else is done they are given their totals, last chains first.
    RAKED rows have `parent`, the node they were added to, `total` and `carry`, what chains between
    the two hold; CHAINS have `down` and `sum`. With deep, `skip` and `hops` count the nodes of
    chains that `carry` and `sum` pass.

    Children are added up before they are shuffled and no join has a parent as its key, so
    very many children of one parent never meet. A parent that isn't a node counts as none; a
    cycle is an error."""
    kind = nodes.schema["value"].dataType
    total = f"decimal(38,{kind.scale})" if isinstance(kind, DecimalType) else kind.simpleString()
    key, none = nodes.schema["id"].dataType.simpleString(), F.lit(0).cast(total)
    known = ["id", *[c for c in nodes.columns if c not in ("id", "parent")]]
    open_, carried = F.col("kids") > 0, {"carry": none} | ({"skip": F.lit(0)} if deep else {})

    def kept(rows: DataFrame) -> tuple[DataFrame, int, int]:
        seen = Observation()
        out = written(rows.observe(seen, F.count_if(open_).alias("open"), F.count_if(~open_).alias("done")), "rollup")
        return out, seen.get["open"], seen.get["done"]

    counts = nodes.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("kids"), F.min(F.struct("id", *[v.alias(c) for c, v in carried.items()])).alias("only"))
    rows = nodes.join(counts, "id", "left").withColumns({"kids": F.coalesce("kids", F.lit(0)), "total": F.col("value").cast(total)} | carried)
    state, left, done = kept(rows)
    steps = [(RAKED, state.where(~open_))]
    while left:
        if 4 * done < left:
            state, chains = _compressed(state, known, total, key, deep)
            state, left, done = kept(state)
            steps[-1:] = [(CHAINS, chains), (RAKED, state.where(~open_))]  # the same nodes, under the parents they have now
            if not left:
                break
            if not done:
                raise ValueError("runs.parent_run_id has a cycle")
        heard = state.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(
            F.sum(F.when(~open_, F.col("total") + F.col("carry"))).cast(total).alias("gain"), F.count_if(open_).alias("still"), F.min(F.when(open_, F.struct("id", *carried))).alias("only"))
        mine = state.where(open_).drop("only").join(heard, "id", "left")
        mine = mine.withColumns({"total": (F.col("total") + F.coalesce("gain", none)).cast(total), "kids": F.coalesce("still", F.lit(0))})
        state, left, done = kept(mine.drop("gain", "still"))
        steps.append((RAKED, state.where(~open_)))
    return steps


def _compressed(state: DataFrame, known: list[str], total: str, key: str, deep: bool) -> tuple[DataFrame, DataFrame]:
    """state without its chains, and their nodes with `down`, the node below the chain, and `sum`,
    what they have more than it (with deep also `hops`, how many nodes). Each job follows the pointers
    of the one before HOPS times, so a reach of r becomes (HOPS + 1) * r, and the pointers that are
    followed are shuffled once. A pointer that has left the chain looks up its own node from then on:
    no key has over two rows in a join, though all nodes of a chain end at one."""
    chain = F.col("kids") == 1
    sums = {"sum": (F.col("total"), "carry", total)} | ({"hops": (F.lit(1), "skip", "int")} if deep else {})
    steps = state.where(chain).select("id", F.col("only.id").cast(key).alias("down"), *[(own + F.col(f"only.{c}")).cast(t).alias(s) for s, (own, c, t) in sums.items()], F.lit(False).alias("fixed"))
    reach, most = 1, None
    while True:
        there = steps.select(F.col("id").alias("key"), F.col("down").alias("further"), *[F.col(s).alias(f"more_{s}") for s in sums], F.col("fixed").alias("ends"))
        moved = steps.where("not fixed")
        for _ in range(HOPS):
            goes = ~F.col("fixed")
            moved = moved.withColumn("key", F.when(goes, F.col("down")).otherwise(F.col("id"))).join(there, "key", "left").select(
                "id", F.when(goes, F.coalesce("further", "down")).otherwise(F.col("down")).alias("down"),
                *[(F.col(s) + F.when(goes, F.coalesce(f"more_{s}", F.lit(0).cast(t))).otherwise(F.lit(0).cast(t))).cast(t).alias(s) for s, (_, _, t) in sums.items()],
                (F.col("fixed") | F.coalesce("ends", F.lit(True))).alias("fixed"))
        seen = Observation()
        moving = F.count_if(~F.col("fixed")).alias("moving")
        steps = written((moved if reach == 1 else union_all(steps.where("fixed"), moved)).observe(seen, moving, F.count(F.lit(1)).alias("n")), "chains")
        if not seen.get["moving"]:
            break
        reach, most = (HOPS + 1) * reach, most or seen.get["n"]
        if reach > (HOPS + 1) * most:
            raise ValueError("runs.parent_run_id has a cycle")
    carried = [c for _, c, _ in sums.values()]
    held = state.where(chain).select(*known, "parent", *carried).join(steps.drop("fixed"), "id")
    inside = state.where(chain).select(F.col("only.id").cast(key).alias("id"))  # those whose parent is in a chain
    tops = held.join(inside, "id", "left_anti").select(F.col("down").alias("id"), F.col("parent").alias("above"), *[(F.col(s) + F.col(c)).cast(t).alias(f"new_{c}") for s, (_, c, t) in sums.items()], F.lit(True).alias("moves"))
    rest = state.where(~chain).join(tops, "id", "left")
    moves = F.coalesce("moves", F.lit(False))
    rest = rest.withColumns({"parent": F.when(moves, F.col("above")).otherwise(F.col("parent"))} | {c: F.when(moves, F.col(f"new_{c}")).otherwise(F.col(c)) for c in carried})
    return rest.drop("above", "moves", *[f"new_{c}" for c in carried]), held.select(*known, "down", *sums)
