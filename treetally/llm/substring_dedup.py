"""Repeated passages of words, by compaction of a De Bruijn graph.

The edges of the graph are the windows of 35 words, from their first to their last 34. An
edge is repeated if its words start at two places. As in compaction by minimizers, each
window is filed under the least hash of its 6-word grams, so equal windows meet; a run of
windows of one document under one gram is a piece of a path, and most pieces are repeated, or
not, as a whole:

- grams that occur once file nothing that could be repeated, and their pieces go at once;
- a piece whose words occur twice is a repeated path;
- a piece that occurs once, though its gram occurs again, is taken apart into its windows,
  which are counted with those of the other pieces under that gram.

Repeated pieces that follow each other at every place where either occurs do not branch and
become one path. As its pieces lie side by side in their first source, paths are found there,
and their places are those of the first piece. Last, each text is read again at the
coordinates that came back: the pieces found there must hash to the path's, and their words go.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, renamed, temporary, written

WINDOW, GRAM = 35, 6
#: Bytes of a text that are split at a time; words that are hashed at a time; distinct words that a task remembers.
SLICE, BLOCK, REMEMBERED = 1 << 20, 1 << 18, 1 << 19
SPACE = re.compile(rb"[ \t-\r]")
#: The base of the rolling hash, odd, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words, a slice of the text at a time."""
    at = 0
    while at < len(text):
        cut = SPACE.search(text, at + SLICE)
        end = cut.start() if cut else len(text)
        yield text[at:end].split()
        at = end


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, text: bytes | None) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint64), *(np.fromiter(map(self.__getitem__, w), np.uint64, len(w)) for w in words_of(text or b""))])


def mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any runs of a block of words, by running sums."""

    ups = downs = np.ones(1, np.uint64)

    def __init__(self, words: np.ndarray):
        if len(Rolling.ups) <= len(words):
            n = max(len(words) + 1, BLOCK + WINDOW)
            Rolling.ups, Rolling.downs = (np.cumprod(np.append(np.ones(1, np.uint64), np.full(n, b, np.uint64))) for b in (BASE, INVERSE))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * self.ups[: len(words)])])

    def of(self, first: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mixed((self.sums[first + length] - self.sums[first]) * self.downs[first])


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the first least of each `width` values in a row."""
    at, have = np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        have += step
    return at


def blocks(hashes: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(words, unit, document, offset) of about BLOCK words: `unit` has the first place of each stretch of a document, and the end of all."""
    parts, doc, offset, size = [], [], [], 0

    def block() -> tuple:
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)]), np.array(doc), np.array(offset)

    for i, h in enumerate(hashes):
        for at in range(0, len(h) - WINDOW + 1, BLOCK):  # stretches share WINDOW - 1 words
            part = h[at : at + BLOCK + WINDOW - 1]
            parts.append(part)
            doc.append(i)
            offset.append(at)
            size += len(part)
            if size >= BLOCK:
                yield block()
                parts, doc, offset, size = [], [], [], 0
    if parts:
        yield block()


def pieces_of(hashes: list[np.ndarray]) -> Iterator[dict[str, np.ndarray]]:
    """doc (place in hashes), start (first window), n (windows), gram, content, and the contents of the
    pieces before and after in the same stretch (0: none)."""
    for words, unit, doc, offset in blocks(hashes):
        roll, places = Rolling(words), np.arange(len(words) - GRAM + 1)
        grams = roll.of(places, GRAM)
        least = leftmost_least(grams, WINDOW - GRAM + 1)
        of = np.repeat(np.arange(len(doc)), np.diff(unit))[: len(least)]
        window = np.flatnonzero(np.arange(len(least)) + WINDOW <= unit[of + 1])
        site = least[window]
        first = np.flatnonzero(np.concatenate([[True], site[1:] != site[:-1]]))
        start, n, own = window[first], np.diff([*first, len(window)]), of[window[first]]
        content = roll.of(start, n + WINDOW - 1) | np.uint64(1)
        same, none = own[1:] == own[:-1], np.zeros(1, np.uint64)
        yield {"doc": doc[own], "start": start - unit[own] + offset[own], "n": n, "gram": grams[site[first]], "content": content,
               "before": np.concatenate([none, np.where(same, content[:-1], 0)]), "after": np.concatenate([np.where(same, content[1:], 0), none])}


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, mark, text) to a row a piece."""
    cache = WordHashes()
    for b in batches:
        ids, marks = b.column(0).to_numpy(), b.column(1).to_numpy()
        for p in pieces_of([cache.of(t.as_py()) for t in b.column(2)]):
            longs = [ids[p["doc"]], marks[p["doc"]], *(p[c].astype(np.uint64).view(np.int64) for c in ("gram", "content", "before", "after"))]
            yield pa.RecordBatch.from_arrays([*map(pa.array, longs), pa.array(p["start"].astype(np.int32)), pa.array(p["n"].astype(np.int32))], ["id", "mark", "gram", "content", "before", "after", "start", "n"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, mark, text, wanted pieces) to a row a window of these."""
    cache = WordHashes()
    for b in batches:
        for i, mark, text, wanted in zip(*(c.to_pylist() for c in b.columns)):
            h = cache.of(text)
            roll = Rolling(h)
            n = np.array([w["n"] for w in wanted])
            at = np.repeat([w["start"] for w in wanted], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            gram, lone = (np.repeat([w[c] for w in wanted], n) for c in ("gram", "lone"))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i)), pa.array(np.full(len(at), mark)), pa.array(gram), pa.array(roll.of(at, WINDOW).view(np.int64)), pa.array(at.astype(np.int32)), pa.array(lone)], ["id", "mark", "gram", "window", "start", "lone"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with _id and _mark, which together tell texts apart: rows equal in both are equal, and lose the same words."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.withColumns({"_text": text.cast("binary"), "_id": F.coalesce(F.col(id_col).cast("long"), F.lit(0)), "_mark": F.xxhash64(F.col(id_col).cast("long"), text)})


def repeated_spans(keyed: DataFrame) -> DataFrame:
    """(_id, _mark, spans): for each text of _keyed with repeated windows, (start, n, check) of runs of them;
    written. check: the pieces' contents together where the run is a path, 0 where it is one window."""
    spark = keyed.sparkSession
    texts, path = keyed.select("_id", "_mark", "_text"), new_path(spark, "spans")
    with temporary(spark):
        held = new_path(spark, "pieces")
        with temporary(spark):  # all pieces, made in one reading of the texts; most go at once
            pieces = written(texts.mapInArrow(_pieces, "id long, mark long, gram long, content long, before long, after long, start int, n int"), "all")
            twice = written(pieces.groupBy("gram").count().where("count > 1").select("gram"), "grams")
            pieces = pieces.join(twice, "gram", "left_semi")
            pieces.write.parquet(held)
        pieces = spark.read.schema(pieces.schema).parquet(held)
        ends = [f(c).alias(f"{a}_{c}") for c in ("before", "after") for a, f in (("least", F.min), ("most", F.max))]
        kinds = pieces.groupBy("gram", "content").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("id", "mark", "start")).alias("source"), F.first("n").alias("n"), *ends)
        kinds = written(kinds.select("gram", "content", "times", "source.*", "n", *[f"{a}_{c}" for c in ("before", "after") for a in ("least", "most")]), "kinds")

        # Paths: pieces of one source that follow each other wherever either occurs.
        order = Window.partitionBy("id", "mark").orderBy("start")
        last = lambda c: F.lag(c).over(order)
        follows = ((last(F.col("start") + F.col("n")) == F.col("start")) & (last("times") == F.col("times")) & (last("least_after") == F.col("content")) & (last("most_after") == F.col("content"))
                   & (F.col("least_before") == last("content")) & (F.col("most_before") == last("content")))
        rows = kinds.where("times > 1").withColumn("new", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1))
        rows = rows.withColumn("path", F.sum("new").over(order))
        head = F.min_by(F.struct("gram", "content"), "start").alias("head")
        paths = rows.groupBy("id", "mark", "path").agg(head, F.sum("n").cast("int").alias("windows"), F.bit_xor("content").alias("check")).select("head.*", "windows", "check")
        whole = pieces.join(paths, ["gram", "content"]).select("id", "mark", "start", F.col("windows").alias("n"), "check")

        # Branches: pieces that occur once, beside others under their gram.
        some = kinds.where("times = 1").select("gram").distinct()
        wanted = kinds.join(some, "gram", "left_semi").groupBy(F.col("id").alias("_id"), F.col("mark").alias("_mark")).agg(F.collect_list(F.struct("start", "n", "gram", (F.col("times") == 1).alias("lone"))).alias("wanted"))
        windows = texts.join(wanted, ["_id", "_mark"]).select("_id", "_mark", "_text", "wanted").mapInArrow(_windows, "id long, mark long, gram long, window long, start int, lone boolean")
        windows = written(windows, "windows")
        again = windows.groupBy("gram", "window").agg(F.count(F.lit(1)).alias("times"), F.max("lone").alias("lone")).where("times > 1 and lone").select("gram", "window")
        single = windows.where("lone").join(again, ["gram", "window"], "left_semi").select("id", "mark", "start", F.lit(1).alias("n"), F.lit(0).cast("long").alias("check"))
        spans = whole.unionByName(single).groupBy(F.col("id").alias("_id"), F.col("mark").alias("_mark")).agg(F.collect_set(F.struct("start", "n", "check")).alias("spans"))
        spans.write.parquet(path)
    return spark.read.schema(spans.schema).parquet(path)


def covered(h: np.ndarray, spans: list[dict]) -> np.ndarray:
    """Which words lie in a repeated window. The text must have at each span of a path the pieces that the path has."""
    gone = np.zeros(len(h) + 1, np.int64)
    paths = [s for s in spans if s["check"]]
    if paths:
        own = list(pieces_of([h]))
        start = np.concatenate([p["start"] for p in own])
        xors = np.bitwise_xor.accumulate(np.concatenate([np.zeros(1, np.uint64), *(p["content"] for p in own)]))
        ends = np.append(start[1:], len(h) - WINDOW + 1)
        for s in paths:
            a, b = np.searchsorted(start, s["start"]), np.searchsorted(ends, s["start"] + s["n"])
            if start[a] != s["start"] or ends[b] != s["start"] + s["n"] or int((xors[b + 1] ^ xors[a]).view(np.int64)) != s["check"]:
                raise ValueError("two different passages have one hash")
    for s in spans:
        gone[s["start"]] += 1
        gone[s["start"] + s["n"] + WINDOW - 1] -= 1
    return np.cumsum(gone[:-1]) > 0


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(..., text, spans) to (..., kept text, n_words, n_removed)."""
    cache = WordHashes()
    for b in batches:
        texts, spans = b.column(b.num_columns - 2), b.column(b.num_columns - 1)
        out, n_words, n_removed = [], [], []
        for text, own in zip(texts, spans.to_pylist()):
            text, kept, at, removed = text.as_py(), [], 0, 0
            gone = covered(cache.of(text), own) if own else None
            for words in words_of(text):
                if own:
                    here = gone[at : at + len(words)]
                    removed += int(here.sum())
                    kept.append(b" ".join([w for w, g in zip(words, here.tolist()) if not g]))
                else:
                    kept.append(b" ".join(words))
                at += len(words)
            out.append(b" ".join([k for k in kept if k]))
            n_words.append(at)
            n_removed.append(removed)
        arrays = [*b.columns[:-2], pa.array(out, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, [*b.schema.names[:-2], "_kept", "n_words", "n_removed"])


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the words of repeated windows taken out of the text, and n_words (before) and n_removed.

    Words are runs without ASCII white space. A window of 35 words is repeated if its words
    also start at another place, of the same row or another; all places lose it, and windows are
    judged on the texts as given. The kept words are joined by single spaces. A null or empty
    text has no words and becomes empty; one of under 35 words stays. Rows that share an id, or have
    none, are documents of their own, and equal rows repeat each other. No rows: no rows. Other
    columns pass through, whatever their names; n_words and n_removed, if there, are replaced.

    A text may be of any length: words are hashed a slice at a time, 8 bytes a word."""
    docs = docs.drop("n_words", "n_removed")
    names = docs.columns
    docs, (id_col, text_col) = renamed(docs, id_col, text_col)
    keep = docs.columns
    keyed = _keyed(docs, id_col, text_col)
    rows = keyed.drop(text_col).join(repeated_spans(keyed), ["_id", "_mark"], "left")
    rest = [c for c in keep if c != text_col]
    rows = rows.select(*rest, "_text", "spans")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-2])
    out = rows.mapInArrow(_kept, f"{kinds + ', ' if kinds else ''}_kept string, n_words long, n_removed long")
    return out.select(*[F.col("_kept").alias(c) if c == text_col else F.col(c) for c in keep], "n_words", "n_removed").toDF(*names, "n_words", "n_removed")
