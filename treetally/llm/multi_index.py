"""Approximate nearest neighbours by an inverted multi-index.

Both halves of the vectors have their own centroids; a cell is a pair of them, and the index
lists entries by cell. A query sorts the centroids of each half by their inner product with its own
half and walks pairs in falling order of the sum, by a heap that holds the next pair of each
left centroid reached, until a budget of entries and as many as it is to return are met; the
entries of the cells met are reranked by their exact inner products.

The budget is learned: for a bounded sample of queries, exact neighbours over all rows tell
how many entries must be met for a wanted share of neighbours. Entries lie in segments by
their left centroid, and a query is sent only to segments with a cell that it meets.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import smallest, written
from .vectors import best, clean, counted, is_query, matrix, packed, search

#: Entries of a segment, at most about; centroids of a half, at most.
SEGMENT, CENTROIDS = 65536, 2048
#: Sampled rows that one centroid stands for, at least. Entries of an average cell, about: as many pairs are walked.
PER_CENTROID, PER_CELL = 4, 4


def kmeans(x: np.ndarray, k: int, rounds: int = 6, seed: int = 7) -> np.ndarray:
    x = x.astype(np.float32)
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        at = np.argsort(near, kind="stable")
        own, starts = np.unique(near[at], return_index=True)
        centres[own] = np.add.reduceat(x[at], starts, axis=0) / np.diff([*starts, len(x)])[:, None]
    return centres.astype(np.float64)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    c = centres.astype(np.float32)
    norms, out = (c**2).sum(axis=1), np.empty(len(x), np.int32)
    for a in range(0, len(x), 4096):
        out[a : a + 4096] = np.argmin(norms - 2 * x[a : a + 4096].astype(np.float32) @ c.T, axis=1)
    return out


@dataclass
class Codebooks:
    """The centroids of both halves of the vectors of one length, which cells hold how many
    entries (by left centroid, then right), and in which segments each left centroid's are.
    At most CENTROIDS^2 cells of 12 bytes, however many rows there are."""

    halves: tuple[np.ndarray, np.ndarray]
    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    right: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    first_seg: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    pieces: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    budget: int = 0

    def products(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = len(w) // 2
        return self.halves[0] @ w[:cut], self.halves[1] @ w[cut:]

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = x.shape[1] // 2
        return nearest(x[:, :cut], self.halves[0]), nearest(x[:, cut:], self.halves[1])

    def scores(self, w: np.ndarray) -> np.ndarray:
        """The summed product of each cell that holds anything."""
        left, right = self.products(w)
        return np.repeat(left, np.diff(self.starts)) + right[self.right]

    @cached_property
    def held(self) -> np.ndarray:
        """Entries by left and right centroid."""
        out = np.zeros((len(self.halves[0]), len(self.halves[1])), np.int32)
        out[np.repeat(np.arange(len(out)), np.diff(self.starts)), self.right] = self.counts
        return out

    def met(self, w: np.ndarray, k: int = 0) -> tuple[float, np.ndarray]:
        """The least summed product of the cells that are met, and the left centroids that have such
        cells with entries. The walk goes on until the budget and k + 1 entries are met (one may
        be the query's own row), or all."""
        products, total = self.products(w), int(self.counts.sum())
        (a, left), (b, right) = ((at, x[at].tolist()) for x in products for at in [np.argsort(-x, kind="stable")])
        want, seen, last, used = min(total, max(self.budget, k + 1)), 0, -math.inf, set()
        rows, heap = [self.held[a[0], b].tolist()], [(-(left[0] + right[0]), 0, 0)]
        while seen < want:
            last, i, j = heap[0]
            if n := rows[i][j]:
                seen += n
                used.add(i)
            if j + 1 < len(right):
                heapq.heapreplace(heap, (-(left[i] + right[j + 1]), i, j + 1))
            else:
                heapq.heappop(heap)
            if not j and i + 1 < len(left):
                rows.append(self.held[a[i + 1], b].tolist())
                heapq.heappush(heap, (-(left[i + 1] + right[0]), i + 1, 0))
        return -last, np.sort(a[list(used)])

    def before(self, w: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """How many entries lie in cells that are met before each given cell."""
        (a, b), scores = self.products(w), self.scores(w)
        by = np.argsort(-scores, kind="stable")
        total = np.concatenate([[0], np.cumsum(self.counts[by])])
        return total[np.searchsorted(-scores[by], -(a[left] + b[right]), "left")]


def reranked(v: np.ndarray, short: np.ndarray | None, at: np.ndarray, own: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places among `at` of the k highest exact products, and these; a pass in single precision
    leaves out rows that are too low by more than its error."""
    if short is not None and len(at) > 4 * k:
        rough = short[at] @ w.astype(np.float32)
        error = len(w) * 2.0**-22 * float(np.linalg.norm(w)) * float(np.abs(short).max()) * len(w) ** 0.5
        at = at[rough >= np.partition(rough, -k)[-k] - 2 * error]
    scores = np.einsum("ij,j->i", v[at], w)
    top = best(scores, own[at], k)
    return at[top], scores[top]


def codebooks_of(rows: DataFrame, sample: int, centroids: int) -> dict[int, Codebooks]:
    """By length of the vectors, from the `sample` rows with the smallest hash of their number; a
    length that has none of these has one cell, so that all of its entries are met. `centroids` a
    half at most, and so few that an average cell holds PER_CELL entries."""
    lengths = counted(rows)
    fitted, out = smallest(rows, F.xxhash64("row"), sum(lengths.values()), sample).select("d", "v").toArrow(), {}
    of = fitted.column("d").to_numpy()
    for d, n in lengths.items():
        some = fitted.filter(pa.array(of == d)).column("v")
        x = matrix(some, len(some), np.float64) if len(some) else np.zeros((1, d))
        k, cut = max(1, min(centroids, len(some) // PER_CENTROID, math.ceil((n / PER_CELL) ** 0.5))), d // 2
        out[d] = Codebooks(tuple(kmeans(h, k) if h.shape[1] else np.zeros((1, 0)) for h in (x[:, :cut], x[:, cut:])))
    return out


def assigned(rows: DataFrame, books: dict[int, Codebooks]) -> DataFrame:
    """rows with the centroids a and b of their halves; written."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.column(2).to_numpy()
            for length in np.unique(d):
                b = batch.filter(pa.array(d == length))
                left, right = shared.value[int(length)].cells(matrix(b.column(3), b.num_rows, np.float64))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(left), pa.array(right)], ["row", "vec_id", "d", "v", "a", "b"])

    return written(rows.mapInArrow(run, "row long, vec_id long, d int, v array<double>, a int, b int"), "cells")


def fill(books: dict[int, Codebooks], cells: DataFrame, size: int) -> int:
    """Puts counts and segments into the codebooks; how many segments there are. A left
    centroid of over `size` entries has several segments, small ones share one."""
    counts = cells.groupBy("d", "a", "b").count().toArrow().sort_by([("d", "ascending"), ("a", "ascending"), ("b", "ascending")])
    d, a, b, n = (counts.column(c).to_numpy() for c in ("d", "a", "b", "count"))
    segs = 0
    for length, book in books.items():
        own, k = d == length, len(book.halves[0])
        book.right, book.counts, book.starts = b[own], n[own], np.searchsorted(a[own], np.arange(k + 1))
        total = np.bincount(a[own], n[own], k).astype(np.int64)
        book.first_seg, book.pieces, room = np.zeros(k, np.int32), np.maximum(1, -(-total // size)).astype(np.int32), 0
        for i, x in enumerate(total.tolist()):
            if x > room or book.pieces[i] > 1:
                book.first_seg[i], segs, room = segs, segs + int(book.pieces[i]), 0 if book.pieces[i] > 1 else size - x
            else:  # into the segment that was opened last
                book.first_seg[i], room = segs - 1, room - x
    return segs


def exact(cells: DataFrame, queries: DataFrame, k: int) -> list:
    """(q, a, b) of the k best rows for each row of a bounded `queries` table (row, d, v), by all rows."""
    asked = queries.toArrow()
    shared = cells.sparkSession.sparkContext.broadcast(asked.to_pydict())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        kept: dict[int, tuple] = {}
        groups = {d: [q for q, x in enumerate(wanted["d"]) if x == d] for d in set(wanted["d"])}
        vectors = {d: np.array([wanted["v"][q] for q in qs], np.float64) for d, qs in groups.items()}
        for batch in batches:
            length = batch.column(1).to_numpy()
            for d, qs in groups.items():
                b = batch.filter(pa.array(length == d))
                if not b.num_rows:
                    continue
                row, left, right = (b.column(i).to_numpy() for i in (0, 3, 4))
                for q, scores in zip(qs, vectors[d] @ matrix(b.column(2), b.num_rows, np.float64).T):
                    at = np.flatnonzero(row != wanted["row"][q])
                    at = at[np.argsort(-scores[at], kind="stable")[:k]]
                    new = (scores[at], left[at], right[at])
                    if q in kept:
                        new = tuple(np.concatenate(x) for x in zip(kept[q], new))
                        top = np.argsort(-new[0], kind="stable")[:k]
                        new = tuple(x[top] for x in new)
                    kept[q] = new
        for q, (s, left, right) in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), q), pa.int32()), pa.array(s), pa.array(left), pa.array(right)], ["q", "score", "a", "b"])

    rows = cells.select("row", "d", "v", "a", "b").mapInArrow(run, "q int, score double, a int, b int")
    order = Window.partitionBy("q").orderBy(F.desc("score"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q", "a", "b").collect()


def learn_budgets(books: dict[int, Codebooks], cells: DataFrame, queries: DataFrame, k: int, recall: float, asked: int) -> None:
    """Sets each budget to what meets `recall` of the exact neighbours of the `asked` queries with
    the smallest hash; all entries where no such query has the length."""
    some = written(smallest(queries, F.xxhash64("row"), queries.count(), asked).select("row", "d", "v"), "asked")
    near: dict[int, list] = {}
    for r in exact(cells, some, k):
        near.setdefault(r["q"], []).append((r["a"], r["b"]))
    wanted, places = some.toArrow().to_pydict(), {}
    for q, found in near.items():
        d, (left, right) = wanted["d"][q], np.array(found).T
        places.setdefault(d, []).append(books[d].before(np.array(wanted["v"][q]), left, right))
    for d, book in books.items():
        before = np.sort(np.concatenate(places[d])) if d in places else None
        book.budget = int(book.counts.sum()) if before is None else int(before[math.ceil(recall * len(before)) - 1]) + 1


def neighbours(vectors: DataFrame, k: int = 20, query_every: int = 20, recall: float = 0.93, asked: int = 256, centroids: int = CENTROIDS, sample: int = 50_000, id_col: str = "vec_id", vec_col: str = "embedding", segment: int = SEGMENT) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by query_every, k near
    other rows by inner product, nearest first, ties to the smaller id.

    Centroids are fitted on `sample` rows, the budget on `asked` queries so that the `recall`
    of exact neighbours is met; every row is in the index. Rows that share an id are queries,
    and candidates for each other, one by one. A vector meets those of its own length. See
    vectors.clean for the rows that take part (zero vectors don't). Every query gets k rows, or
    all others where they are fewer. Nothing to search: no rows. Other columns play no part."""
    spark = vectors.sparkSession
    rows = clean(vectors, id_col, vec_col, True)
    books = codebooks_of(rows, sample, centroids)
    if not books:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    cells, queries = assigned(rows, books), rows.where(is_query(query_every))
    n = cells.count()
    size = max(1, min(segment, n // (2 * spark.sparkContext.defaultParallelism)))  # as many segments as tasks run, at least
    segs = fill(books, cells, size)
    learn_budgets(books, cells, queries, k, recall, asked)
    shared = spark.sparkContext.broadcast(books)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, d, a = (b.column(i).to_numpy() for i in (0, 2, 4))
            seg = np.empty(len(row), np.int32)
            for length in np.unique(d):
                book, at = shared.value[int(length)], d == length
                mixed = (row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                seg[at] = book.first_seg[a[at]] + (mixed % book.pieces[a[at]].astype(np.uint64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(seg)], ["row", "vec_id", "d", "v", "a", "b", "seg"])

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([("a", "ascending"), ("b", "ascending"), ("vec_id", "ascending")])
        arrays = {c: t.column(c).to_numpy() for c in ("row", "vec_id", "a", "b")}
        return packed(arrays | {"v": matrix(t.column("v"), t.num_rows, np.float64)}, t.column("seg")[0].as_py())

    index = cells.mapInArrow(placed, "row long, vec_id long, d int, v array<double>, a int, b int, seg int")
    index = written(index.groupBy("seg").applyInArrow(pack, "seg int, row binary, vec_id binary, a binary, b binary, v binary"), "segments")

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            least, segs_of = [], []
            for d, v in zip(b.column(2).to_pylist(), b.column(3)):
                book = shared.value[d]
                bound, left = book.met(np.array(v.as_py(), np.float64), k)
                least.append(bound - 1e-9 * abs(bound))  # another machine may add in another order
                spans = [np.arange(book.first_seg[x], book.first_seg[x] + book.pieces[x]) for x in left.tolist()]
                segs_of.append(np.unique(np.concatenate(spans)).tolist() if spans else [])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(least, pa.float64()), pa.array(segs_of, pa.list_(pa.int32()))], ["row", "vec_id", "d", "v", "least", "segs"])

    routed = written(queries.repartition(max(8, 2 * spark.sparkContext.defaultParallelism)).mapInArrow(sent, "row long, vec_id long, d int, v array<double>, least double, segs array<int>"), "routed")
    routed = routed.withColumn("seg", F.explode("segs")).drop("segs")

    def found(one: dict, many: pa.Table, opened: dict) -> tuple:
        row_of, own = np.frombuffer(one["row"], np.int64), np.frombuffer(one["vec_id"], np.int64)
        a, b = np.frombuffer(one["a"], np.int32), np.frombuffer(one["b"], np.int32)
        v = np.frombuffer(one["v"], np.float64).reshape(len(own), -1)
        short = v.astype(np.float32) if np.abs(v).max() < 1e15 else None
        begin = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        cell_a, cell_b, sizes = a[begin], b[begin], np.diff([*begin, len(a)])
        book, out = shared.value[v.shape[1]], []
        for q, i, w, least in zip(many.column("row").to_pylist(), many.column("vec_id").to_pylist(), matrix(many.column("v"), many.num_rows, np.float64), many.column("least").to_pylist()):
            left, right = book.products(w)
            at = np.flatnonzero(np.repeat(left[cell_a] + right[cell_b] >= least, sizes))
            at = at[row_of[at] != q]
            rows, scores = reranked(v, short, at, own, w, k)
            out.append((np.full(len(rows), q), np.full(len(rows), i), own[rows], scores))
        return tuple(np.concatenate(c) for c in zip(*out))

    return search(index, routed, found, k, "double", max(8, segs))
