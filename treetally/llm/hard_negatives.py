"""Hard negatives from lists that the anchors of a cluster share.

Anchors are clustered by direction. For a cluster with centre c, whose members lie within the
angle t of it, a candidate x at the angle f from c has an inner product with a member q of at
most |q| |x| cos(max(0, f - t)). Candidates are sorted by |x| cos(max(0, f - t)) once a
cluster, and every member walks that list block by block until nothing that follows can
enter its result.

Candidates lie in segments; a task holds one segment and whole clusters, and what members
find in each segment is merged by rank. One walk finds an anchor's positives, a second one
its negatives, as their bounds follow from the positives' scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import smallest, written
from .multi_index import kmeans, nearest
from .vectors import clean, counted, is_query, matrix, packed

#: Rows of a segment, anchors that a task holds at a time, rows of a list that are walked in one go, anchors of a cluster, about.
SEGMENT, CHUNK, BLOCK, MEMBERS = 65536, 8192, 512, 256
#: Clusters, at most, and anchors that their centres are fitted on.
CLUSTERS, SAMPLE = 1024, 50_000
#: What rounding may add to a bound, as a share of |q| |x|.
SLACK = 1e-6
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def units(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(norms(x), 1e-300)[:, None]


def shared_list(x: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, bounds): rows of x by falling bound on their product with any member of norm 1."""
    centre = units(units(members).sum(axis=0)[None, :])[0]
    angle = lambda v: np.arccos(np.clip(units(v) @ centre, -1, 1))
    bound = norms(x) * (np.cos(np.maximum(0, angle(x) - angle(members).max())) + SLACK)
    order = np.argsort(-bound, kind="stable")
    return order, bound[order]


def walk(x: np.ndarray, ids: np.ndarray, order: np.ndarray, bounds: np.ndarray, members: np.ndarray, fits: Callable, high: np.ndarray, low: np.ndarray, k: int) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """By member and window, (places, scores) of the k rows of highest product within [low, high], ties
    to smaller ids. high, low: a column a window; a window that is empty finds nothing.

    fits(members, places) says which rows may be found for which members. A member leaves the
    walk when for each window the bound of what follows is under its k-th score or under low."""
    n, windows = high.shape
    length, score = norms(members), np.full((n, windows, k), -np.inf)
    place = np.full((n, windows, k), -1)
    live = np.flatnonzero((low <= high).any(axis=1))
    for at in range(0, len(order), BLOCK):
        need = np.maximum(score[live, :, -1], np.where(low[live] <= high[live], low[live], np.inf))
        live = live[(length[live, None] * bounds[at] >= need).any(axis=1)]
        if not len(live):
            break
        here = order[at : at + BLOCK]
        s = members[live] @ x[here].T
        s[~fits(live, here)] = -np.inf
        for w in range(windows):
            inside = np.where((s <= high[live, w, None]) & (s >= low[live, w, None]), s, -np.inf)
            better = np.flatnonzero(inside.max(axis=1) >= np.maximum(score[live, w, -1], -1e300))
            if not len(better):
                continue
            rows = live[better]
            both = np.concatenate([score[rows, w], inside[better]], axis=1)
            where = np.concatenate([place[rows, w], np.broadcast_to(here, (len(rows), len(here)))], axis=1)
            keep = np.lexsort((ids[where], -both), axis=1)[:, :k]
            score[rows, w], place[rows, w] = np.take_along_axis(both, keep, 1), np.take_along_axis(where, keep, 1)
    return [[(place[m, w][ok], score[m, w][ok]) for w in range(windows) for ok in [score[m, w] > -np.inf]] for m in range(n)]


def clustered(anchors: DataFrame, members: int, sample: int) -> DataFrame:
    """anchors with their cluster and the batch that a task takes: whole clusters of one length of
    vectors, about CHUNK anchors together; a larger cluster has batches of its own."""
    lengths = counted(anchors)
    fitted = smallest(anchors, F.xxhash64("row"), sum(lengths.values()), sample).select("d", "v").toArrow()
    of, books, total = fitted.column("d").to_numpy(), {}, 0
    for d, n in sorted(lengths.items()):
        some = fitted.filter(pa.array(of == d)).column("v")
        k = max(1, min(CLUSTERS, n // members, len(some) // 2))
        books[d] = (units(kmeans(units(matrix(some, len(some), np.float64)), k)) if k > 1 else np.zeros((1, d)), total)
        total += k
    shared = anchors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, cluster = b.column(2).to_numpy(), np.empty(b.num_rows, np.int32)
            for length in np.unique(d):
                centres, first = shared.value[int(length)]
                own = b.filter(pa.array(d == length))
                cluster[d == length] = first + nearest(units(matrix(own.column(3), own.num_rows, np.float64)), centres)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cluster)], [*b.schema.names, "cluster"])

    rows = written(anchors.mapInArrow(run, "row long, vec_id long, d int, v array<double>, label int, cluster int"), "clusters")
    sizes = rows.groupBy("d", "cluster").count()
    before = F.sum("count").over(Window.partitionBy("d").orderBy("cluster")) - F.col("count")
    sizes = sizes.select("cluster", F.ceil(F.col("count") / CHUNK).alias("parts"), F.floor(before / CHUNK).alias("from"))
    batch = F.col("from") + F.pmod(F.xxhash64("row"), "parts")
    return rows.join(F.broadcast(sizes), "cluster").withColumn("batch", batch.cast("int")).drop("parts", "from")  # a row for each of CLUSTERS a length, at most


def _walked(segments: DataFrame, anchors: DataFrame, k: int, windows: int, parts: int) -> DataFrame:
    """(anchor, window, row, vec_id, score): what each anchor finds in each segment of its length.
    anchors: (row, seg, cluster, batch, v, label, high, low); windows: 0 for rows of the same label, else as many as high has."""
    met = anchors.select(F.col("seg").alias("_seg"), F.col("batch").alias("_batch")).distinct()
    left = segments.join(met, F.col("seg") == F.col("_seg")).withColumnRenamed("_batch", "batch").drop("_seg")
    names = ["anchor", "window", "row", "vec_id", "score"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(one: pa.Table, many: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in names]
        if one.num_rows and many.num_rows:
            seg = one.to_pylist()[0]
            row, ids, label = (np.frombuffer(seg[c], np.int64) for c in ("rows", "vec_ids", "labels"))
            x = np.frombuffer(seg["x"], np.float64).reshape(len(row), -1)
            for c in many.column("cluster").unique():
                some = many.filter(pc.equal(many.column("cluster"), c))
                v, own, kind = matrix(some.column("v"), some.num_rows, np.float64), some.column("row").to_numpy(), some.column("label").to_numpy()
                order, bounds = shared_list(x, v)
                if windows:
                    fits = lambda m, at, kind=kind: label[at][None, :] != kind[m][:, None]
                    high, low = (np.array([[*w, *[least] * (windows - len(w))] for w in some.column(n).to_pylist()], np.float64) for n, least in (("high", -np.inf), ("low", np.inf)))
                else:
                    fits = lambda m, at, kind=kind, own=own: (label[at][None, :] == kind[m][:, None]) & (row[at][None, :] != own[m][:, None])
                    high, low = (np.full((len(own), 1), b) for b in (np.inf, -np.inf))
                for anchor, found in zip(own, walk(x, ids, order, bounds, v, fits, high, low, k)):
                    for w, (at, scores) in enumerate(found):
                        for o, a in zip(out, (np.full(len(at), anchor), np.full(len(at), w), row[at], ids[at], scores.astype(np.int64))):
                            o.append(a)
        return pa.table({n: pa.array(np.concatenate(o) if o else [], t) for n, o, t in zip(names, out, kinds)})

    keys = ["seg", "batch"]
    both = left.repartition(parts, *keys).groupBy(*keys).cogroup(anchors.repartition(parts, *keys).groupBy(*keys))
    return both.applyInArrow(run, "anchor long, window int, row long, vec_id long, score long")


def hard_negatives(vectors: DataFrame, anchor_every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, shifted_every: int = 7, labels: int = 10,
                   id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", segment: int = SEGMENT, members: int = MEMBERS, sample: int = SAMPLE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each row whose id
    is divisible by anchor_every, exactly.

    Scores are inner products of floor(scale x component). Positives are the `positives` best
    other rows of the anchor's label; for each of them come the `negatives` best rows of other
    labels whose score is between low and high percent of the positive's (so none for a
    positive below zero); ties to the smaller id, all if there are fewer. Where shifted_every
    divides the id, the label counts as (label + 1) % labels.

    Rows that share an id are rows of their own; a vector meets those of its own length. Rows
    without an id or label take no part, nor those that vectors.clean leaves out. An anchor
    without positives has no rows. Scores must be below 2^53, else it is an error. Nothing to
    search: no rows. Other columns play no part.

    Only the centres of clusters are fitted, on `sample` anchors; bounds follow from all
    members, so results don't depend on them. segment, members: rows of a segment and anchors
    of a cluster, about; a cluster of more than CHUNK anchors has several lists a segment. Where directions are close to
    uniform, bounds stay above scores and members walk most of each list."""
    spark, label = vectors.sparkSession, F.col(label_col).cast("int")
    label = F.when(F.col(id_col) % shifted_every == 0, (label + 1) % labels).otherwise(label)
    rows = clean(vectors, id_col, vec_col, False, lambda x: F.floor(x * scale).cast("double"), label=label)
    lengths = counted(rows)
    if not lengths:
        return spark.createDataFrame([], RESULT)
    first, pieces = {}, {d: -(-n // segment) for d, n in lengths.items()}
    for d in sorted(pieces):
        first[d] = sum(pieces[x] for x in first)
    spans = spark.createDataFrame([(d, first[d], pieces[d]) for d in pieces], "d int, first int, pieces int")

    def build(t: pa.Table) -> pa.Table:
        x = matrix(t.column("v"), t.num_rows, np.float64)
        if (np.abs(x).max(initial=0) ** 2) * x.shape[1] >= 2.0**53:
            raise ValueError("components are too large: scores would not be exact")
        own = {n: t.column(c).to_numpy().astype(np.int64) for n, c in (("rows", "row"), ("vec_ids", "vec_id"), ("labels", "label"))}
        return packed(own | {"x": x}, t.column("seg")[0].as_py())

    dealt = rows.join(F.broadcast(spans), "d").withColumn("seg", (F.col("first") + F.pmod(F.xxhash64("row"), F.col("pieces"))).cast("int")).drop("first", "pieces")  # one row a length
    segments = written(dealt.groupBy("seg").applyInArrow(build, "seg int, rows binary, vec_ids binary, labels binary, x binary"), "segments")
    anchors = written(clustered(rows.where(is_query(anchor_every)), members, sample), "anchors")
    parts = max(8, 2 * spark.sparkContext.defaultParallelism, sum(pieces.values()))
    everywhere = lambda df: df.join(F.broadcast(spans), "d").withColumn("seg", F.explode(F.sequence("first", F.col("first") + F.col("pieces") - 1)))  # noqa: E731  a stated query set meets all rows, in segments

    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id", "row")
    merged = lambda df, k: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    near = written(merged(_walked(segments, everywhere(anchors), positives, 0, parts), positives), "positives")
    kept = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("found"))
    asked = written(anchors.join(kept.withColumnRenamed("anchor", "row"), "row"), "asked")
    hundredth = lambda n: F.call_function("div", n - F.pmod(n, F.lit(100)), F.lit(100))  # noqa: E731  rounded down
    bounds = {"high": F.transform("found", lambda p: hundredth(p["score"] * high)), "low": F.transform("found", lambda p: -hundredth(p["score"] * -low))}
    far = merged(_walked(segments, everywhere(asked.withColumns(bounds).drop("found", "vec_id")), negatives, positives, parts), negatives)
    pairs = asked.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), F.posexplode("found").alias("window", "p"))
    out = pairs.join(far, ["anchor", "window"])
    return out.select("anchor_id", F.col("p.vec_id").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))
