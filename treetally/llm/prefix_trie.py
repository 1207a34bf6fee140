"""The prefix trie of conversations, by range minima over sorted common prefixes.

Conversations are sorted by their turns over the whole cluster and lie in chunks, one a
partition. Neighbours in that order have a common prefix of so many turns (LCP), and the
members of a prefix of d turns are a run of rows between which every LCP is at least d. A
sparse table of minima of 1, 2, 4 ... LCPs lets each candidate prefix search the ends of its
run by halving, without a stack and without regard to other prefixes.

A prefix is a candidate of the first row that has it, so each node arises once, in the
order of a walk through the trie; sums over subtrees are differences of running sums.
Runs that reach over the end of a chunk are prefixes of its last row: what they have in
each chunk goes to the driver, two conversations' depth a chunk, is put together there and
comes back. No group of like conversations meets in one task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Turns and conversations of a chunk, about; ids in one piece of a long list; rows given out at a time.
CHUNK, PIECE, STEP = 1 << 19, 4096, 1 << 16
#: Bytes of a turn's digest.
WIDTH = 16
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_SCHEMA = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in NODE.split(", ")] + [("crossing", pa.int64()), ("chunk", pa.int32()), ("piece", pa.int32()), ("ids", pa.string())])


def sequences(turns: DataFrame, every: int = 5, heads: int = 9) -> DataFrame:
    """(conv_id, key, sizes), a row a conversation: the digests of its rebuilt turns in a row, and the bytes of their texts.

    Conversation c begins with the first h turns of conversation c - c % every (all if fewer,
    none if there is no such), h = crc32(decimal c) % heads, and goes on with its own turns
    after its first h. Turns are in order of turn, nulls first, and of equal turn in order of
    their digest. A null role or text is empty; rows without a conv_id take no part."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", digest.alias("digest"), F.octet_length(text).alias("bytes")).alias("t")).where("conv_id is not null")
    convs = rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes"))).alias("own"))
    convs = written(convs, "conversations")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    first = convs.select(F.col("conv_id").alias("base"), F.slice("own", 1, heads - 1).alias("head"))
    both = convs.withColumns({"base": F.col("conv_id") - F.col("conv_id") % every, "h": h}).join(first, "base", "left")
    head = F.coalesce("head", F.array().cast(convs.schema["own"].dataType))
    rest = F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0)))
    whole = both.withColumn("all", F.concat(F.slice(head, F.lit(1), F.col("h")), rest))
    return whole.select("conv_id", F.unhex(F.array_join(F.transform("all", lambda t: t["digest"]), "")).alias("key"), F.transform("all", lambda t: t["bytes"]).alias("sizes"))


def common_prefixes(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """How many turns each row has in common with the one before; -1 for the first."""
    lcp, d = np.zeros(len(lens), np.int32), 0
    rows = np.arange(1, len(lens))
    while len(rows):
        rows = rows[np.minimum(lens[rows], lens[rows - 1]) > d]
        rows = rows[(flat[starts[rows] + d] == flat[starts[rows - 1] + d]).all(axis=1)]
        d += 1
        lcp[rows] = d
    lcp[:1] = -1
    return lcp


class Minima:
    """The sparse table of minima over 1, 2, 4 ... neighbours."""

    def __init__(self, values: np.ndarray):
        self.n, self.levels = len(values), [values]
        while 2 << (len(self.levels) - 1) <= self.n:
            last, w = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-w], last[w:]))

    def right(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The last row that can be reached from `at` over values of at least `least`."""
        end = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            can = np.flatnonzero(end + (1 << k) < self.n)
            end[can[self.levels[k][end[can] + 1] >= least[can]]] += 1 << k
        return end

    def left(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first row from which `at` can be reached so."""
        end = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            can = np.flatnonzero(end >= 1 << k)
            end[can[self.levels[k][end[can] - (1 << k) + 1] >= least[can]]] -= 1 << k
        return end


def least_between(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least value from first to last, by two overlapping runs of a power of two; one level of the table at a time."""
    out, level, width = np.empty(len(first), values.dtype), values, last - first + 1
    k = 0
    while len(level):
        own = np.flatnonzero((width >= 1 << k) & (width < 2 << k))
        out[own] = np.minimum(level[first[own]], level[last[own] - (1 << k) + 1])
        level = np.minimum(level[: -(1 << k)], level[1 << k :]) if len(level) > 1 << k else level[:0]
        k += 1
    return out


class Chunk:
    """The candidate prefixes of a chunk's rows, in order of row and depth, and what each has in
    this chunk: `n` members, the `smallest` of them, `children`, and of the nodes below that
    lie wholly in the chunk the `leaves` and `saved`.

    before, after: turns that the first row shares with the row before the chunk, and the last
    with the row after it; -1 if there is none. `entering` prefixes come from before, `open` ones
    go on after."""

    def __init__(self, row: dict, before: int, after: int):
        self.ids, self.lens, lcp, sizes = (np.frombuffer(row[c], t) for c, t in (("ids", np.int64), ("lens", np.int32), ("lcp", np.int32), ("sizes", np.int32)))
        n, new = len(self.ids), (self.lens - lcp).astype(np.int64)
        start = np.concatenate([[0], np.cumsum(new)])
        self.at = np.repeat(np.arange(n), new)
        self.depth = np.arange(start[-1]) - start[self.at] + lcp[self.at] + 1
        table = Minima(lcp)
        right = table.right(self.at, self.depth)
        self.parent = np.arange(-1, start[-1] - 1)
        top = np.flatnonzero((self.depth == lcp[self.at] + 1) & (self.at > 0))
        up = table.left(self.at[top], self.depth[top] - 1)
        self.parent[top] = start[up] + self.depth[top] - 1 - (lcp[up] + 1)
        self.entering = (self.at == 0) & (self.depth <= before)
        self.open = (right == n - 1) & (self.depth <= after)
        self.n, self.smallest = right - self.at + 1, least_between(self.ids, self.at, right)
        self.children = np.bincount(self.parent[~self.entering & (self.parent >= 0)], minlength=start[-1])
        offsets = np.concatenate([[0], np.cumsum(self.lens, dtype=np.int64)])
        self.size = np.where(self.depth > 0, np.append(sizes, 0)[offsets[self.at] + self.depth - 1], 0).astype(np.int64)
        inside, here, end = ~self.entering & ~self.open, np.arange(start[-1]), start[right + 1]
        below = lambda x: (c := np.concatenate([[0], np.cumsum(np.where(inside, x, 0))]))[end] - c[here]
        self.leaves, self.saved = below(self.children == 0), below((self.n - 1) * self.size)
        self.runs = np.append(np.flatnonzero(lcp < self.lens), n)  # where rows differ from the one before

    def across(self, which: np.ndarray) -> list[list[int]]:
        """By depth, what the prefixes over an end of the chunk have here."""
        return [x[which].tolist() for x in (self.n, self.smallest, self.children, self.leaves, self.saved, self.size)]


@dataclass
class Crossing:
    """A node over the end of a chunk. down: leaves and saved of the crossing nodes below it."""

    number: int
    size: int
    n: int = 0
    smallest: int = (1 << 63) - 1
    children: int = 0
    leaves: int = 0
    saved: int = 0
    down: list[int] = field(default_factory=lambda: [0, 0])

    def add(self, n: int, smallest: int, children: int, leaves: int, saved: int) -> None:
        self.n, self.smallest = self.n + n, min(self.smallest, smallest)
        self.children, self.leaves, self.saved = self.children + children, self.leaves + leaves, self.saved + saved

    def close(self, parent: Crossing | None) -> None:
        self.down[0] += self.children == 0
        self.down[1] += (self.n - 1) * self.size
        self.leaves, self.saved = self.leaves + self.down[0], self.saved + self.down[1]
        if parent:
            parent.down[0] += self.down[0]
            parent.down[1] += self.down[1]


def put_together(parts: list[dict]) -> dict[int, tuple[list[Crossing], list[Crossing]]]:
    """By chunk: the nodes that enter it and those that are open at its end, by depth. parts: a
    chunk each, in order, with `enter` and `open` of Chunk.across and how many `stay` open."""
    path, out, made = [], {}, 0
    for part in parts:
        enter = path
        for node, own in zip(enter, zip(*part["enter"][:5])):
            node.add(*own)
        for d in range(len(enter) - 1, part["stay"] - 1, -1):
            enter[d].close(enter[d - 1] if d else None)
        path = enter[: part["stay"]]
        for *own, size in list(zip(*part["open"]))[part["stay"] :]:
            path.append(Crossing(made, size))
            path[-1].add(*own)
            made += 1
        out[part["chunk"]] = enter, list(path)
    return out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted partition as one row."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    t = pa.Table.from_batches(batches)
    keys = t.column("key").to_pylist()
    lens = np.fromiter((len(k) // WIDTH for k in keys), np.int32, len(keys))
    flat = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, WIDTH // 8)
    lcp = common_prefixes(flat, np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])[:-1], lens)
    sizes = t.column("sizes").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int32)
    held = [np.ascontiguousarray(x).tobytes() for x in (t.column("conv_id").to_numpy(), lens, lcp, sizes)]
    one = {"chunk": pa.array([t.column("chunk")[0].as_py()], pa.int32())} | {c: pa.array([x], pa.binary()) for c, x in zip(("first", "last", "ids", "lens", "lcp", "sizes"), (keys[0], keys[-1], *held))}
    yield pa.RecordBatch.from_pydict(one)


def shared_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b)) // WIDTH
    x, y = (np.frombuffer(k, f"V{WIDTH}", n) for k in (a, b))
    differ = np.flatnonzero(x != y)
    return int(differ[0]) if len(differ) else n


def _pieces(ids: np.ndarray) -> list[str]:
    return [",".join(map(str, ids[i : i + PIECE].tolist())) for i in range(0, len(ids), PIECE)]


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(crossing, ends_sha256) from pieces in order; one piece after the other, however many a node has."""
    now, state = None, None

    def given() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"crossing": [now], "ends_sha256": [state.hexdigest()]})

    for b in batches:
        for number, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if number != now:
                if state:
                    yield given()
                now, state = number, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if state:
        yield given()


def prefix_trie(seqs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """A row for each distinct prefix of the sequences (conv_id, key, sizes), the empty one included.

    conv_id is the smallest member, depth the turns, parent_conv_id the parent's conv_id (the
    root's is null); n_convs counts members, n_children the prefixes that are a turn longer,
    n_leaves the nodes without children in the subtree. saved_tokens sums (n_convs - 1) x bytes
    of the last text over the subtree, and ends_sha256 is the hash of the ids, joined by commas,
    of those that end here (of nothing if none does). Each conv_id is one row of seqs. No rows:
    no nodes.

    A conversation is one value of 16 bytes a turn (never its text), however long. chunk: turns
    and conversations of a chunk, about. For each chunk the driver holds its first and last
    conversation's digests and what the prefixes over its ends have, and nothing else."""
    spark = seqs.sparkSession
    seqs = written(seqs.select("conv_id", "key", "sizes"), "sequences")
    total = seqs.agg(F.sum(F.size("sizes") + F.lit(1).cast("long")).alias("n")).first()["n"] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / chunk))
    ranges = seqs.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id").withColumn("chunk", F.spark_partition_id())
    packed = written(ranges.mapInArrow(_packed, "chunk int, first binary, last binary, ids binary, lens binary, lcp binary, sizes binary"), "chunks")
    ends = sorted(packed.select("chunk", "first", "last").collect())
    meet = [-1, *(shared_turns(a["last"], b["first"]) for a, b in zip(ends, ends[1:])), -1]
    between = spark.sparkContext.broadcast({e["chunk"]: (meet[i], meet[i + 1]) for i, e in enumerate(ends)})

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Chunk]]:
        for b in batches:
            for row in b.to_pylist():
                yield row["chunk"], Chunk(row, *between.value[row["chunk"]])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("chunk", pa.int32()), ("enter", pa.list_(pa.list_(pa.int64()))), ("open", pa.list_(pa.list_(pa.int64()))), ("stay", pa.int32())])
        for number, c in opened(batches):
            yield pa.RecordBatch.from_pylist([{"chunk": number, "enter": c.across(c.entering), "open": c.across(c.open), "stay": int((c.entering & c.open).sum())}], kind)

    inner = packed.select("chunk", "ids", "lens", "lcp", "sizes")
    crossing = sorted(inner.mapInArrow(summed, "chunk int, enter array<array<long>>, open array<array<long>>, stay int").collect())
    known = spark.sparkContext.broadcast({k: ([x.smallest for x in enter], [x.number for x in enter], [[x.n, x.smallest, x.children, x.leaves, x.saved, x.number] for x in open_])
                                          for k, (enter, open_) in put_together([r.asDict() for r in crossing]).items()})

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, c in opened(batches):
            smallest, numbers, finals = known.value[number]
            own, pieces, node_of = np.flatnonzero(~c.entering), [], np.full(len(c.at), -1)
            out = [x.copy() for x in (c.n, c.smallest, c.children, c.leaves, c.saved)]
            if finals:
                for x, final in zip([*out, node_of], np.array(finals).T):
                    x[c.open] = final
            out[1][c.entering], node_of[c.entering] = smallest, numbers
            sha = np.full(len(c.at), EMPTY, object)
            whole = np.flatnonzero(c.depth == c.lens[c.at])  # the node in which a row ends
            owner = whole[np.searchsorted(c.at[whole], c.runs[:-1])]
            for i, first, last in zip(owner.tolist(), c.runs[:-1].tolist(), c.runs[1:].tolist()):
                if node_of[i] < 0:
                    sha[i] = hashlib.sha256(",".join(map(str, c.ids[first:last].tolist())).encode()).hexdigest()
                else:
                    pieces += [(int(node_of[i]), k, ids) for k, ids in enumerate(_pieces(c.ids[first:last]))]
            parent = np.where(c.parent >= 0, out[1][c.parent], -1)
            columns = [out[1], c.depth, parent, out[0], *out[2:], sha, node_of]
            for i in range(0, len(own), STEP):
                at = own[i : i + STEP]
                got = [x[at] for x in columns]
                arrays = [pa.array(x, f.type, mask=(c.parent[at] < 0) if f.name == "parent_conv_id" else (x < 0) if f.name == "crossing" else None) for x, f in zip(got, _SCHEMA)]
                yield pa.RecordBatch.from_arrays([*arrays, *(pa.nulls(len(at), _SCHEMA.field(f).type) for f in ("chunk", "piece", "ids"))], schema=_SCHEMA)
            if pieces:
                rows = {"crossing": [p[0] for p in pieces], "chunk": [number] * len(pieces), "piece": [p[1] for p in pieces], "ids": [p[2] for p in pieces]}
                yield pa.RecordBatch.from_arrays([pa.array(rows.get(f.name, [None] * len(pieces)), f.type) for f in _SCHEMA], schema=_SCHEMA)

    found = written(inner.mapInArrow(nodes, f"{NODE}, crossing long, chunk int, piece int, ids string"), "nodes")
    names = [f.name for f in _SCHEMA][:8]
    pieces = found.where("ids is not null").select("crossing", "chunk", "piece", "ids")
    ends = pieces.repartition(F.col("crossing")).sortWithinPartitions("crossing", "chunk", "piece").select("crossing", "ids").mapInArrow(_hashed, "crossing long, ends_sha256 string")
    over = found.where("ids is null and crossing is not null").drop("ends_sha256").join(ends, "crossing", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
    return found.where("crossing is null").select(names).unionByName(over.select(names))
