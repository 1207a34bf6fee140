"""SimHash near-dedup with anchor points of a covering code.

Fingerprints of 64 bits link at 3 or fewer differing bits. Of the two halves of 32 bits,
one then differs in at most 1. Anchors of a half are the words of the code that has a
Hamming (31, 26) word in its low 31 bits and any value in its top bit; its covering radius
is 1, so every half has its home anchor within 1, and whatever is within 1 of that half is
within 2 of the anchor. Each fingerprint is replicated to every anchor within 2 (at most 17
a half) and compared per anchor with those at home there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import heavy_keys, lookup
from .common import renamed, written
from .components import connected_components

SHINGLE, DISTANCE = 3, 3
#: Entries of an anchor that are compared in one go; larger anchors are cut into blocks.
BLOCK = 2048
#: Hashes counted, and rows compared, at a time.
STEP = 1 << 16


def fingerprint(text: str | None) -> int:
    """As a signed 64-bit number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n, ones, digest = max(1, len(words) - SHINGLE + 1), np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, STEP):
        part = words[at : min(at + STEP, n) + SHINGLE - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
        h = np.fromiter((digest(g, 42) for g in grams), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, text_hash), a row for each row. Null and empty texts have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps), b.column(2)], ["doc_id", "fp", "text_hash"])

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), text_hash(text_col))
    return rows.mapInArrow(run, "doc_id long, fp long, text_hash long")


def text_hash(text_col: str) -> Column:
    """Tells rows of one id, or of none, apart."""
    return F.xxhash64(F.col(text_col).cast("string"))


def anchors_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in fp, anchor, whether it is the home anchor) for uint64 fingerprints."""
    place, anchor, home = [], [], []

    def put(where: np.ndarray, half: int, word: np.ndarray, at_home: bool) -> None:
        place.append(where)
        anchor.append(word.astype(np.int64) | np.int64(half << 32))
        home.append(np.full(len(where), at_home))

    for half in (0, 1):
        v = ((fp >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        syndrome = np.zeros(len(v), np.uint32)
        for p in range(1, 32):
            syndrome ^= np.where((v >> np.uint32(p - 1)) & np.uint32(1), np.uint32(p), np.uint32(0))
        bit = lambda p: np.where(p > 0, np.uint32(1) << (np.maximum(p, 1) - np.uint32(1)).astype(np.uint32), np.uint32(0)).astype(np.uint32)
        word, every = v ^ bit(syndrome), np.arange(len(v))
        put(every, half, word, True)
        put(every, half, word ^ np.uint32(1 << 31), False)
        for i in range(1, 32):  # words two bits away: flip i and j where i xor j is the syndrome
            j = syndrome ^ np.uint32(i)
            at = np.flatnonzero((syndrome != 0) & (j > i))
            put(at, half, v[at] ^ np.uint32(1 << (i - 1)) ^ bit(j[at]), False)
    return np.concatenate(place), np.concatenate(anchor), np.concatenate(home)


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(fp), STEP):
            part = fp[at : at + STEP]
            place, anchor, home = anchors_of(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[place]), pa.array(home)], ["anchor", "fp", "home"])


def _linked(group: np.ndarray, fp: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the same components as all links within the runs of equal group."""
    lefts, rights = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    at, gap = np.arange(len(group) - 1), 1
    while len(at := at[at + gap < len(group)]):
        at = at[group[at] == group[at + gap]]
        near = at[(home[at] | home[at + gap]) & (np.bitwise_count(fp[at] ^ fp[at + gap]) <= DISTANCE)]
        lefts.append(near)
        rights.append(near + gap)
        if sum(map(len, lefts[-64:])) > 1 << 20:  # keep a spanning set only
            lefts, rights = ([x] for x in _spanning(np.concatenate(lefts), np.concatenate(rights), len(group)))
        gap += 1
    return _spanning(np.concatenate(lefts), np.concatenate(rights), len(group))


def _spanning(left: np.ndarray, right: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars with the components of the given links among n rows."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if np.array_equal(label, before):
            at = np.flatnonzero(label != np.arange(n))
            return at, label[at]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches: (anchor, low, high, fp, home), rows of one (anchor, low, high) together."""

    def links(rows: list[np.ndarray]) -> pa.RecordBatch:
        anchor, low, high, fp, home = rows
        new = np.concatenate([[False], (anchor[1:] != anchor[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
        a, b = _linked(np.cumsum(new), fp.view(np.uint64), home)
        a, b = fp[a], fp[b]
        differ = a != b
        return pa.RecordBatch.from_arrays([pa.array(a[differ]), pa.array(b[differ])], ["a", "b"])

    rest = None
    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(rows[0]):
            continue
        if rest is not None:
            rows = [np.concatenate(x) for x in zip(rest, rows)]
        last = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]) | (rows[2] != rows[2][-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield links([x[:cut] for x in rows])
        rest = [x[cut:] for x in rows]
    if rest is not None:
        yield links(rest)


def links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): links between the distinct values of fps.fp, enough to span the components of
    all pairs within 3 bits. An anchor with over `block` entries is cut into blocks, each
    pair of which is compared in a group of its own; no group has over about 2 x block rows
    and each gives fewer links than it has rows."""
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = fps.select("fp").where("fp is not null").distinct().repartition(parts, "fp").mapInArrow(_anchored, "anchor long, fp long, home boolean")
    entries = written(entries, "anchors")
    large = entries.groupBy("anchor").count().where(F.col("count") > block).select("anchor", F.ceil(F.col("count") / block).cast("int").alias("k"))
    cut = (entries.join(large, "anchor", "left").withColumn("own", F.coalesce(F.pmod(F.xxhash64("fp"), "k"), F.lit(0)).cast("int"))
           .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("k"), F.lit(1)) - 1)))
           .select("anchor", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp", "home"))
    return cut.repartition(parts, "anchor", "low", "high").sortWithinPartitions("anchor", "low", "high").mapInArrow(_compared, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of docs.

    component_id is the smallest id that can be reached over links. Null and empty texts
    have fingerprint zero and link like any other. A null id is never a component_id unless
    its whole component has null ids (then null). Rows that share an id are nodes of their
    own. Other columns of docs play no part. A text of any length counts whole; no rows give
    no rows. Copies share a fingerprint and are one node, so
    groups of copies of any size make no links among themselves."""
    rows = _in_components(docs, id_col, text_col, block)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _in_components(docs: DataFrame, id_col: str, text_col: str, block: int = BLOCK) -> DataFrame:
    """(doc_id, fp, text_hash, root, component_id), a row for each row of docs; root is the smallest fingerprint of the component."""
    fps = written(fingerprints(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    roots = connected_components(links(fps, block)).withColumnRenamed("node", "fp")
    nodes = written(nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "nodes")
    # A text that a third of the rows share, or a component of very many texts, is dealt to many tasks.
    ids = nodes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of = lookup(nodes.select("fp", "root"), ids, "root", F.col("fp"), how="inner").select("fp", "root", "component_id")
    return lookup(fps, of, "fp", F.col("row"), heavy_keys(nodes, "fp"), how="inner").select("doc_id", "fp", "text_hash", "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: of those with the smallest id (nulls last) the one
    with the smallest text hash. Rows are told apart by id and text hash, so rows that share
    an id, or have none, stay or go each by its own text; of rows equal in both one stays."""
    names = docs.columns
    docs, (id_col, text_col) = renamed(docs, id_col, text_col)
    found = _in_components(docs.select(id_col, text_col), id_col, text_col).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    each = found.groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("copies"))
    least = each.groupBy("root").agg(F.min(F.struct("text_hash", "doc_id", "copies")).alias("kept"))
    firsts = written(least.select(F.col("kept.doc_id").alias("_id"), F.col("kept.text_hash").alias("_hash"), F.col("kept.copies").alias("_copies")), "firsts")
    docs = docs.withColumn("_text_hash", text_hash(text_col))
    same = docs[id_col].cast("long").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash"))
    kept = docs.join(firsts.select("_id", "_hash"), same, "left_semi")
    if not firsts.where("_copies > 1").isEmpty():
        kept = kept.dropDuplicates([id_col, "_text_hash"])
    return kept.drop("_text_hash").toDF(*names)
