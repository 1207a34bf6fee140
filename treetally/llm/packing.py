"""Best-fit packing into bins of several permitted sizes.

Documents are cut into pieces of at most the largest size; pieces are dealt to shards of
bounded size by a hash, and each shard is packed on its own. Pieces come in falling length
and go to the open bin that they leave the least room in. If none has room, a new bin is
opened at the size that costs least per place it can hold, among those allowed by a
policy; the whole shard is packed under every policy (the smallest size that may be opened),
each bin is then downsized to the least size that holds its contents, and the policy of the
least total cost is taken.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, written

SIZES = (512, 1024, 2048, 4096)
#: Pieces a shard has, about.
SHARD = 20_000
#: Rows of equal content that one record of the shuffle may stand for.
COPIES = 1000


def cost(size: int) -> float:
    """Of a bin: its places, what attention adds at this length, and a fixed part."""
    return size * (1 + size / 16384) + 16


def pack(lengths: np.ndarray, sizes: tuple[int, ...] = SIZES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For lengths (0 to max(sizes)): bin of each piece, its place in it; size and content of each bin."""
    sizes = tuple(sorted(sizes))
    order = np.argsort(-lengths, kind="stable").tolist()
    known, best = lengths.tolist(), None
    for least in sizes:
        bins, at = np.empty(len(known), np.int64), np.empty(len(known), np.int64)
        filled: list[int] = []
        rooms: list[int] = []  # distinct room left, ascending
        by_room: dict[int, list[int]] = {}
        for i in order:
            n = known[i]
            x = bisect_left(rooms, n)
            if x < len(rooms):
                room = rooms[x]
                b = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop(x)
            else:
                size = min((s for s in sizes if s >= n and s >= least), key=lambda s: (cost(s) / s, s))
                b, room = len(filled), size
                filled.append(0)
            bins[i], at[i] = b, filled[b]
            filled[b] += n
            room -= n
            if room:
                if room not in by_room:
                    insort(rooms, room)
                by_room.setdefault(room, []).append(b)
        content = np.array(filled, np.int64)
        down = np.array(sizes, np.int64)[np.searchsorted(sizes, content)]
        total = sum(cost(int(s)) * int(n) for s, n in zip(*np.unique(down, return_counts=True)))
        if best is None or total < best[0]:
            best = (total, bins, at, down, content)
    return best[1:]


def words(text: Column) -> Column:
    """How many runs of characters other than ASCII white space a text has."""
    inner = F.btrim(text, F.lit(ASCII_SPACE))
    return F.when(F.length(inner) == 0, F.lit(0)).otherwise(F.size(F.split(inner, r"[\x20\x09-\x0D]+", -1)))


def pack_documents(docs: DataFrame, length: Column | None = None, id_col: str = "doc_id", text_col: str = "text", sizes: tuple[int, ...] = SIZES, shard: int = SHARD) -> DataFrame:
    """(doc_id, copy, piece, start, length, bin_id, bin_size, bin_offset).

    length is a document's number of units (by default of words, with one more for its
    end). Pieces of a document have start 0, max(sizes), 2 x max(sizes) ... and cover it.
    Every row of docs is packed, repeated rows as copies 1, 2 ...; a null text has length 1
    (its end), a null or negative length counts as 0 and still gets a place. bin_id is
    unique; no rows give no bins, a text of any length is cut into pieces, and other columns of
    docs play no part. A bin's pieces lie one after another from bin_offset 0 and fit bin_size. Shards
    follow from ids, texts and counts, not from how rows are stored."""
    sizes = tuple(sorted(sizes))
    text = F.coalesce(F.col(text_col), F.lit(""))
    length = words(text) + 1 if length is None else length
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.greatest(F.coalesce(length.cast("long"), F.lit(0)), F.lit(0)).alias("total"))
    rows = rows.groupBy("doc_id", "h", "total").count()
    # A row that repeats a million times becomes a thousand records first, then copies.
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("count") - 1) / COPIES))))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.col("part") * COPIES + 1, F.least(F.col("count"), (F.col("part") + 1) * COPIES))))
    pieces = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("total") / sizes[-1]), F.lit(1)) - 1)
    rows = rows.withColumn("piece", F.explode(pieces)).withColumn("start", F.col("piece") * sizes[-1])
    rows = written(rows.select("doc_id", "h", "copy", "piece", "start", F.least(F.lit(sizes[-1]), F.col("total") - F.col("start")).alias("length")), "pieces")
    shards = max(1, -(-rows.count() // shard))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "h", "copy", "piece"), F.lit(shards)).cast("long"))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("h", "ascending"), ("copy", "ascending"), ("piece", "ascending")])
        bins, at, down, _ = pack(t.column("length").to_numpy(), sizes)
        where = t.column("shard").to_numpy()
        return pa.table({**{c: t.column(c) for c in ("doc_id", "copy", "piece", "start", "length")}, "bin_id": pa.array((where << 32) | bins), "bin_size": pa.array(down[bins].astype(np.int32)), "bin_offset": pa.array(at.astype(np.int32))})

    return rows.groupBy("shard").applyInArrow(run, "doc_id long, copy long, piece long, start long, length long, bin_id long, bin_size int, bin_offset int")
