"""Sampled SentencePiece segmentations and lossless decoding.

A segmentation has a probability in proportion to the product of its pieces' weights. Per
chunk (spaces and the characters up to the next space; no piece of the vocabulary crosses
that border, so the chunks of a text are independent) the forward filter gives the total
weight of all ways to reach each place of the lattice. Sampling goes backwards from the end:
a piece that ends here is drawn by its share of that total. Draws come from a hash of row
key, chunk and step, so a row's segmentation depends on nothing but its key and text.

The filters of the distinct chunks of a batch are tables made together, place by place, and
all its chunks step back together; where few chunks are long enough, one by one. Weights are
added and multiplied as fractions with exponents of two, in one order, and shares are whole
numbers, so a draw is the same whatever other chunks are in the batch.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
CHUNK = re.compile(r" *[^ ]+| +")
#: Chunks that are filtered and sampled at a time.
TOGETHER = 1 << 19
#: So few chunks at a place are gone through one by one.
FEW = 16
#: Shares of a place's total are in units of 2 ** -BITS.
BITS = 32
MASK = (1 << 64) - 1
#: Stands for a U+2581 of the text itself, which no piece may take for a space.
OWN_MARK = 0x110000


def powers(logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp(logs) as (f, k): f * 2 ** k, f from 1 up to 2."""
    k = np.floor(logs / math.log(2))
    return np.exp2(logs / math.log(2) - k), k.astype(np.int64)


class Vocabulary:
    """Pieces of a SentencePiece model with byte fallback, as a trie. A piece of rank r (its
    place by score) weighs (r + 1) ** -sharpness, each byte as little as the last piece, squared."""

    def __init__(self, model: bytes, sharpness: float = 1.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.weights = np.zeros(n)
        for r, i in enumerate(sorted(plain, key=lambda i: (-sp.get_score(i), i))):
            self.weights[i] = -sharpness * math.log(r + 1)
        self.byte_weight = -2 * sharpness * math.log(len(plain) + 1)
        self.fractions, self.exponents = powers(self.weights)
        self.byte_fractions, self.byte_exponents = powers(self.byte_weight * np.arange(5))
        self.bytes, self.decoded = [0] * 256, [b""] * n
        for i in range(n):
            if sp.is_byte(i):
                x = int(sp.id_to_piece(i)[3:-1], 16)
                self.bytes[x], self.decoded[i] = i, bytes([x])
        for piece, i in self.ids.items():
            self.decoded[i] = piece.replace(SPACE, " ").encode()
        # Node 0 is the root; edges are sorted by (node, character).
        nodes, edges, ends = {"": 0}, {}, [-1]
        for piece in sorted(self.ids):
            for k in range(1, len(piece) + 1):
                if piece[:k] not in nodes:
                    nodes[piece[:k]] = len(ends)
                    edges[nodes[piece[: k - 1]] << 21 | ord(piece[k - 1])] = len(ends)
                    ends.append(self.ids.get(piece[:k], -1))
        self.edges = np.array(sorted(edges), np.int64)
        self.targets = np.array([edges[e] for e in self.edges.tolist()], np.int64)
        self.ends = np.array(ends, np.int64)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The nodes that characters lead to; -1: none."""
        key = node << 21 | char
        at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
        return np.where(self.edges[at] == key, self.targets[at], -1)

    def byte_ids(self, char: int) -> list[int]:
        return [self.bytes[x] for x in (SPACE if char == OWN_MARK else chr(char)).encode("utf-8", "surrogatepass")]


class Lattices:
    """Forward filters of distinct chunks, longest first.

    Place (j, r) is before character j of chunk r; places are numbered by j, then r. Edges
    are sorted by the place they end at: first[p] to first[p + 1]. cumulative[e] is p plus the share, up
    to and with e, of the total weight that reaches p, in units of 2 ** -BITS. A piece below 0 is
    character -1 - piece in bytes."""

    def __init__(self, vocabulary: Vocabulary, chunks: list[str]):
        n = len(chunks)
        self.sizes = sizes = np.fromiter(map(len, chunks), np.int64, n)
        columns = np.searchsorted(-sizes, -np.arange(int(sizes[0]) + 1), "right")  # chunks that reach j
        self.column = column = np.concatenate([[0], np.cumsum(columns)])
        chars = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        chars = np.where(chars == ord(SPACE), OWN_MARK, np.where(chars == 32, ord(SPACE), chars))
        row = np.repeat(np.arange(n), sizes)
        at = np.arange(len(chars)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        char = np.zeros(column[-1], np.int64)
        char[column[at + 1] + row] = chars  # each where the place after it is
        count, found = np.zeros(column[-1], np.int32), []
        node, length = np.zeros(len(row), np.int64), 0
        start = column[at] + row
        while len(row):
            length += 1
            end = column[at + length] + row
            node = vocabulary.step(node, char[end])
            piece = np.where(node < 0, -1, vocabulary.ends[node])
            fraction, exponent = vocabulary.fractions[piece], vocabulary.exponents[piece]
            if length == 1:
                lone = np.flatnonzero(piece < 0)
                known, where = np.unique(char[end[lone]], return_inverse=True)
                bytes_of = np.array([len(vocabulary.byte_ids(c)) for c in known.tolist()], np.int64)
                if len(lone):
                    fraction[lone], exponent[lone] = vocabulary.byte_fractions[bytes_of[where]], vocabulary.byte_exponents[bytes_of[where]]
                piece[lone] = -1 - char[end[lone]]
                new = slice(None)
            else:
                new = np.flatnonzero(piece >= 0)
            found.append((end[new], count[end[new]], start[new], piece[new], fraction[new], exponent[new]))
            count[end[new]] += 1
            on = np.flatnonzero((node >= 0) & (at + length < sizes[row]))
            row, at, node, start = row[on], at[on], node[on], start[on]
        self.first = first = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
        slot = np.concatenate([first[e] + k for e, k, *_ in found])
        put = lambda i: (out := np.empty(len(slot), found[0][i].dtype), out.__setitem__(slot, np.concatenate([f[i] for f in found])))[0]
        self.back, self.piece, fraction, exponent = put(2), put(3), put(4), put(5)
        total, power, share = np.ones(column[-1]), np.zeros(column[-1], np.int64), np.empty(len(slot))
        few = int(np.searchsorted(-columns, -FEW))  # from this column on
        for j in range(1, few):
            p, q = column[j], column[j + 1]
            a, b = first[p], first[q]
            back, n_edges = self.back[a:b], count[p:q]
            k = power[back] + exponent[a:b]
            top = np.maximum.reduceat(k, first[p:q] - a)
            x = np.ldexp(total[back] * fraction[a:b], k - np.repeat(top, n_edges))
            whole = np.bincount(np.repeat(np.arange(q - p), n_edges), x)  # adds in order
            total[p:q], up = np.frexp(whole)
            power[p:q] = top + up
            share[a:b] = x / np.repeat(whole, n_edges)
        self._one_by_one(int(column[max(few, 1)]) if few < len(columns) else len(total), fraction, exponent, total, power, share)
        for k in range(1, int(count.max())):
            at = first[np.flatnonzero(count > k)] + k
            share[at] += share[at - 1]
        has = np.flatnonzero(count)
        self.cumulative = np.floor(share * 2.0**BITS).astype(np.int64) + (np.repeat(has, count[has]) << BITS)
        self.cumulative[first[has + 1] - 1] = has + 1 << BITS

    def _one_by_one(self, start: int, fraction: np.ndarray, exponent: np.ndarray, total: np.ndarray, power: np.ndarray, share: np.ndarray) -> None:
        """The same sums for places from start on, whose columns are too short for arrays."""
        first, back, f, k, t, power, share = map(memoryview, (self.first, self.back, fraction, exponent, total, power, share))
        for p in range(start, len(t)):
            edges = range(first[p], first[p + 1])
            ks = [power[back[e]] + k[e] for e in edges]
            top = max(ks)
            xs = [math.ldexp(t[back[e]] * f[e], n - top) for e, n in zip(edges, ks)]
            whole = 0.0
            for x in xs:
                whole += x
            t[p], up = math.frexp(whole)
            power[p] = top + up
            for e, x in zip(edges, xs):
                share[e] = x / whole

    def ends(self, ranks: np.ndarray) -> np.ndarray:
        return self.column[self.sizes[ranks]] + ranks


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of uint64 values."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mixed_one(x: int) -> int:
    """mixed of one value."""
    x = x + 0x9E3779B97F4A7C15 & MASK
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def walked(lattices: Lattices, state: int, key: int, step: int, chunks: int) -> np.ndarray:
    """The pieces from place state back to the start of its chunk, last one first."""
    first, back, cumulative, piece = map(memoryview, (lattices.first, lattices.back, lattices.cumulative, lattices.piece))
    got = []
    while state >= chunks:
        a, b = first[state], first[state + 1]
        if b - a > 1:
            a = min(bisect_right(cumulative, (state << BITS) + (mixed_one(key ^ mixed_one(step)) >> 64 - BITS), a, b), b - 1)
        got.append(piece[a])
        state = back[a]
        step += 1
    return np.array(got, np.int64)


def sampled(vocabulary: Vocabulary, chunks: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all chunks in order, and how many each has. keys: a uint64 for each chunk."""
    distinct = sorted(dict.fromkeys(chunks), key=len, reverse=True)
    rank = dict(zip(distinct, range(len(distinct))))
    lattices = Lattices(vocabulary, distinct)
    first, back, cumulative = lattices.first, lattices.back, lattices.cumulative
    # Chunks go in the order of their lattices, so that neighbours read neighbouring entries.
    ranks = np.fromiter(map(rank.__getitem__, chunks), np.int64, len(chunks))
    order = np.argsort(ranks, kind="stable")
    state, keys = lattices.ends(ranks[order]), keys[order]
    live, step, got, steps = np.arange(len(chunks)), 0, [], np.zeros(len(chunks), np.int64)
    while len(live) > FEW:
        s = state[live]
        e = first[s]
        many = np.flatnonzero(first[s + 1] - e > 1)
        u = (mixed(keys[live[many]] ^ mixed(np.full(1, step, np.uint64))) >> np.uint64(64 - BITS)).astype(np.int64)
        e[many] = np.clip(np.searchsorted(cumulative, (s[many] << BITS) + u, "right"), e[many], first[s[many] + 1] - 1)
        got.append((live, lattices.piece[e]))
        steps[live] += 1
        state[live] = back[e]
        live = live[back[e] >= len(distinct)]
        step += 1
    rest = [(i, walked(lattices, int(state[i]), int(keys[i]), step, len(distinct))) for i in live.tolist()]
    for i, pieces in rest:
        steps[i] += len(pieces)
    in_order = np.empty_like(steps)
    in_order[order] = steps
    steps, stop = in_order, np.cumsum(in_order)
    last, ids = stop[order] - 1, np.empty(int(stop[-1]), np.int64)
    for k, (where, piece) in enumerate(got):
        ids[last[where] - k] = piece
    for i, pieces in rest:
        ids[last[i] - step - len(pieces) + 1 : last[i] - step + 1] = pieces[::-1]
    lone = np.flatnonzero(ids < 0)
    if not len(lone):
        return ids.astype(np.int32), steps
    known = {c: vocabulary.byte_ids(-1 - c) for c in np.unique(ids[lone]).tolist()}
    sizes = np.ones(len(ids), np.int64)
    sizes[lone] = [len(known[c]) for c in ids[lone].tolist()]
    flat = np.repeat(ids, sizes)
    flat[np.repeat(ids < 0, sizes)] = [x for c in ids[lone].tolist() for x in known[c]]
    return flat.astype(np.int32), np.add.reduceat(sizes, stop - steps)


def encode_batch(vocabulary: Vocabulary, texts: list[str], keys: list[int], together: int = TOGETHER) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in order, and how many each has. Chunks are worked on so many at a
    time, however they are dealt over texts; an id depends on its text and key only."""
    ids, counts = [], np.zeros(len(texts), np.int64)
    chunks: list[str] = []
    runs: list[tuple[int, int, int]] = []  # text, first place, chunks

    def flush() -> None:
        if not chunks:
            return
        own = np.repeat([r[0] for r in runs], [r[2] for r in runs])
        place = np.concatenate([np.arange(a, a + n, dtype=np.uint64) for _, a, n in runs])
        seeds = mixed(np.array([keys[r[0]] & MASK for r in runs], np.uint64))
        got, n = sampled(vocabulary, chunks, np.repeat(seeds, [r[2] for r in runs]) ^ mixed(place + np.uint64(1 << 40)))
        ids.append(got)
        np.add.at(counts, own, n)
        chunks.clear(), runs.clear()

    for t, text in enumerate(texts):
        new = CHUNK.findall(" " + text) if text else []
        for a in range(0, len(new), together):
            part = new[a : a + together]
            if len(chunks) + len(part) > together:
                flush()
            chunks += part
            runs.append((t, a, len(part)))
    flush()
    return np.concatenate(ids) if ids else np.empty(0, np.int32), counts


def decode(vocabulary: Vocabulary, ids) -> str:
    """The text that was encoded: pieces and bytes joined, less the leading space that encoding adds."""
    decoded = vocabulary.decoded
    text = b"".join([decoded[i] for i in ids]).decode("utf-8", "surrogatepass")
    return text[1:] if text[:1] == " " else text


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", sharpness: float = 1.0, seed: int = 0) -> DataFrame:
    """(doc_id, ids, n_pieces, lossless), a row for each row of docs.

    ids is a sampled segmentation of the whole text; equal (seed, id, text) give equal ids,
    wherever and in whatever order rows are read. lossless says that decoding ids gave the
    text back. A null text has null ids, an empty one no ids; both are lossless. A null id
    is a key like any other, and an empty table gives no rows. Other columns play no part. A
    text of any length is one row, in time proportional to its length, with spaces or without.
    The model's file is read once, by the driver."""
    with open(model_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary, not data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(shared.value, sharpness)
        decoded = vocabulary.decoded
        for whole in batches:
            for b in parts_of(whole):
                texts = b.column(1).to_pylist()
                ids, n = encode_batch(vocabulary, [t or "" for t in texts], [k.as_py() for k in b.column(2)])
                ends = np.concatenate([[0], np.cumsum(n)])
                flat, fine = ids.tolist(), []
                for t, x, y in zip(texts, ends[:-1].tolist(), ends[1:].tolist()):
                    back = b"".join([decoded[i] for i in flat[x:y]])
                    fine.append(back == ((" " + t).encode("utf-8", "surrogatepass") if t else b""))
                null = pa.array([t is None for t in texts])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()), mask=null)
                yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(n), pa.array(fine)], ["doc_id", "ids", "n_pieces", "lossless"])

    key = F.xxhash64(F.lit(seed), F.col(id_col))
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), key).mapInArrow(run, "doc_id long, ids array<int>, n_pieces long, lossless boolean")


def parts_of(b: pa.RecordBatch, characters: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """b in runs of rows with about so many bytes of text (in column 1) at most, or one row."""
    sizes, start, total = pa.compute.binary_length(b.column(1)).fill_null(0).to_numpy(), 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > characters:
            yield b.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < b.num_rows:
        yield b.slice(start)


def decoded(encoded: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """encoded with a column text: what was encoded. Null ids give a null text."""
    with open(model_path, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())
    names = [c for c in encoded.columns if c != "text"]
    schema = encoded.select(*names).schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, at = Vocabulary(shared.value), names.index(ids_col)
        for b in batches:
            texts = [None if x.as_py() is None else decode(v, x.as_py()) for x in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*names, "text"])

    return encoded.select(*names).mapInArrow(run, schema)
