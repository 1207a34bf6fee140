"""Exact top-k inner products over a bit-sliced index.

Attributes are integers. For each segment of rows and each attribute, less the segment's
minimum, the index holds one bitmap over rows for each bit above the lowest `dropped`. For a
query, bitmaps of all attributes are added, each at the places of its weight's one bits, by
carry-save adders over whole bitmaps (attributes of negative weight enter complemented); the
result is a bit-sliced sum that is at most a known margin below the true score. The k-th
largest sum is found from the most significant slice downward, rows within the margin of it
are the boundary, and these alone are scored exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .vectors import best, clean, counted, is_query, matrix, of, packed, search

SEGMENT = 8192


def pack_bits(rows: np.ndarray) -> np.ndarray:
    """bool (m, n) as uint64 words (m, ceil(n / 64))."""
    padded = np.zeros((rows.shape[0], -(-rows.shape[1] // 64) * 64), bool)
    padded[:, : rows.shape[1]] = rows
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def unpack_bits(words: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little")[:n])


class Slices:
    """The bit-sliced index of one segment: x is int64 (rows, attributes)."""

    def __init__(self, x: np.ndarray, dropped: int):
        self.x, self.n, self.dropped = x, len(x), dropped
        self.low = x.min(axis=0)
        u = x - self.low
        self.bits = int(u.max()).bit_length()
        self.kept = max(0, self.bits - dropped)
        slices = [pack_bits(((u.T >> b) & 1).astype(bool)) for b in range(dropped, self.bits)]
        self.slices = np.stack(slices, axis=1) if slices else np.zeros((x.shape[1], 0, -(-self.n // 64)), np.uint64)
        self.all = pack_bits(np.ones((1, self.n), bool))[0]

    def summed(self, q: np.ndarray) -> tuple[list[np.ndarray], int]:
        """The bit-sliced sum for weights q, and by how much (in its units) a row's true score may exceed it."""
        weight = np.abs(q)
        places: list[list[np.ndarray]] = [[] for _ in range(int(weight.max()).bit_length() + self.kept)]
        turned = np.where((q < 0)[:, None, None], ~self.slices & self.all, self.slices)
        for i in range(int(weight.max()).bit_length()):
            has = turned[(weight >> i) & 1 == 1]
            if len(has):
                for b in range(self.kept):
                    places[i + b].append(has[:, b])
        out, p, carried = [], 0, []
        while p < len(places) or carried:
            rows = carried + (places[p] if p < len(places) else [])
            column, carried = (np.concatenate(rows) if rows else np.zeros((1, len(self.all)), np.uint64)), []
            while len(column) > 1:
                if len(column) == 2:
                    carried.append((column[0] & column[1])[None])
                    column = (column[0] ^ column[1])[None]
                    break
                m = len(column) // 3
                a, b, c = column[:m], column[m : 2 * m], column[2 * m : 3 * m]
                half = a ^ b
                carried.append((a & b) | (half & c))
                column = np.concatenate([half ^ c, column[3 * m :]])
            out.append(column[0])
            p += 1
        # A true score is base + 2^dropped x sum + e, where 0 <= e <= sum of weights x (2^dropped - 1).
        return out, int(weight.sum())

    def top(self, q: np.ndarray, k: int, without: int | None) -> np.ndarray:
        """Rows that may be among the k best."""
        total, margin = self.summed(q)
        live = self.all.copy()
        if without is not None:
            live[without // 64] &= ~np.uint64(1 << (without % 64))
        need, value, left = k, 0, live
        if int(np.bitwise_count(live).sum()) <= k:
            return unpack_bits(live, self.n)
        for p in range(len(total) - 1, -1, -1):
            ones = left & total[p]
            n = int(np.bitwise_count(ones).sum())
            if n >= need:
                value, left = value | 1 << p, ones
            else:
                need, left = need - n, left & ~total[p]
        bound = max(0, value - margin)
        more, equal = np.zeros_like(live), live
        for p in range(len(total) - 1, -1, -1):
            if bound >> p & 1:
                equal = equal & total[p]
            else:
                more, equal = more | (equal & total[p]), equal & ~total[p]
        return unpack_bits(more | equal, self.n)


def top_products(vectors: DataFrame, k: int = 10, query_every: int = 100, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding", segment: int = SEGMENT, dropped: int = 4) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by query_every, the k
    other rows of highest inner product of floor(scale x component), ties to the smaller id.

    Rows that share an id are queries, and candidates for each other, one by one. A vector
    meets those of its own length. See vectors.clean for the rows that take part. Where
    length x (largest scaled component)^2 reaches 2^63, a sum might not fit a long: the job
    fails rather than wrap. Fewer than k others: all of them.
    Nothing to search: no rows. Other columns play no part."""
    rows = clean(vectors, id_col, vec_col, False, lambda x: F.floor(x * scale).cast("long"))
    parts, first = {d: -(-n // segment) for d, n in counted(rows).items()}, {}
    for d in sorted(parts):  # segments are numbered through all dimensions
        first[d] = sum(parts[x] for x in first)
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def build(t: pa.Table) -> pa.Table:
        x = matrix(t.column("v"), t.num_rows, np.int64)
        if x.shape[1] * max(int(x.max()), -int(x.min())) ** 2 >= 1 << 63:  # so for no pair, whatever its segments
            raise OverflowError("inner products of these components may not fit a long; take a smaller scale")
        return packed({"rows": t.column("row").to_numpy(), "vec_ids": t.column("vec_id").to_numpy(), "x": x}, t.column("seg")[0].as_py())

    dealt = rows.withColumn("seg", (of("d", first) + F.pmod(F.xxhash64("row"), of("d", parts))).cast("int"))
    index = written(dealt.groupBy("seg").applyInArrow(build, "seg int, rows binary, vec_ids binary, x binary"), "slices")

    def found(segment_row: dict, queries: pa.Table, opened: dict) -> tuple:
        row_of, own = np.frombuffer(segment_row["rows"], np.int64), np.frombuffer(segment_row["vec_ids"], np.int64)
        slices, place = Slices(np.frombuffer(segment_row["x"], np.int64).reshape(len(own), -1), dropped), dict(zip(row_of.tolist(), range(len(own))))
        out = []
        for q, i, w in zip(queries.column("row").to_pylist(), queries.column("vec_id").to_pylist(), matrix(queries.column("v"), queries.num_rows, np.int64)):
            at = slices.top(w, k, place.get(q))
            scores = slices.x[at] @ w
            top = best(scores, own[at], k)
            out.append((np.full(len(top), q), np.full(len(top), i), own[at][top], scores[top]))
        return tuple(np.concatenate(c) for c in zip(*out))

    queries = rows.where(is_query(query_every)).withColumn("seg", F.explode(F.sequence(of("d", first), of("d", first) + of("d", parts) - 1)))
    return search(index, queries, found, k, "long", max(8, sum(parts.values())))
