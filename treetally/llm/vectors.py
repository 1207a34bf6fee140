"""Vectors as segments of rows, which searches pair with queries in tasks of bounded size."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Queries that one task holds at a time, at most about.
CHUNK = 32768
FOUND = ("query", "query_id", "vec_id", "score")


def clean(vectors: DataFrame, id_col: str, vec_col: str, nonzero: bool, component: Callable[[Column], Column] = lambda x: x, **kept: Column) -> DataFrame:
    """(row, vec_id, d, v), written: each row is a vector of its own, known by `row`, whatever
    rows share its id. v has component(x) of each x as double, d is its length. Rows with a
    null id, a null or empty vector, or a null or non-finite component go, and zero vectors if
    nonzero: they can't be named, or have no product. kept: further columns, none of them null."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    some = F.exists("v", lambda x: x != 0) if nonzero else F.lit(True)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), *[c.alias(n) for n, c in kept.items()]).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(fine & some).where(reduce(lambda a, n: a & F.col(n).isNotNull(), kept, F.lit(True)))
    return written(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.size("v").alias("d"), F.transform("v", component).alias("v"), *kept), "vectors")


def counted(rows: DataFrame) -> dict[int, int]:
    """How many rows each dimension has."""
    return {r["d"]: r["count"] for r in rows.groupBy("d").count().collect()}


def of(key: str, values: dict[int, int]) -> Column:
    """What a (small) dict has for a column."""
    return F.create_map(*map(F.lit, chain(*values.items())))[F.col(key)]


def matrix(column: pa.ChunkedArray | pa.Array, rows: int, kind: type) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat, kind).reshape(rows, -1)


def packed(arrays: dict[str, np.ndarray], seg: int) -> pa.Table:
    """One row: seg and each array's bytes."""
    return pa.table({"seg": pa.array([seg], pa.int32()), **{k: pa.array([a.tobytes()], pa.binary()) for k, a in arrays.items()}})


def search(segments: DataFrame, queries: DataFrame, found: Callable, k: int, score: str, parts: int) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the k best of what `found` yields.

    segments: one row a seg. queries: (seg, row, vec_id, v ...), a row for each segment that a
    query is to meet. found(segment row as dict, queries as a table, opened) gives arrays
    FOUND, at most k rows a query; opened is a dict to keep what found makes of the segment.
    Queries of a segment go in chunks of at most about CHUNK, with a copy of the segment
    each, so a task holds one segment and one chunk, and a copy serves very many queries."""
    chunks = queries.groupBy("seg").count().select("seg", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks"))
    left = segments.join(chunks, "seg").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    right = queries.join(chunks, "seg").withColumn("chunk", F.pmod(F.xxhash64("row"), F.col("chunks")).cast("int")).drop("chunks")
    kinds = dict(zip(FOUND, (pa.int64(), pa.int64(), pa.int64(), pa.float64() if score == "double" else pa.int64())))

    def run(one: pa.Table, many: pa.Table) -> pa.Table:
        if not one.num_rows or not many.num_rows:
            return pa.schema(list(kinds.items())).empty_table()
        out = found(one.to_pylist()[0], many, {})
        return pa.table({name: pa.array(a, kinds[name]) for name, a in zip(FOUND, out)})

    both = left.repartition(parts, "seg", "chunk").groupBy("seg", "chunk").cogroup(right.repartition(parts, "seg", "chunk").groupBy("seg", "chunk"))
    rows = both.applyInArrow(run, f"query long, query_id long, vec_id long, score {score}")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        at = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
        return at[np.lexsort((ids[at], -scores[at]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def is_query(every: int) -> Column:
    return F.col("vec_id") % every == 0
