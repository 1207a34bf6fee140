"""Document quality by a generalised additive model with pairwise interactions.

Features of the whole text are cut into bins at quantiles. Boosting goes round the features
in turn; each step fits a tree of few leaves on one feature's bins and adds a share of it to that
feature's table. Then pairs of features are ranked by how much of the residual a
table over both explains, and the best get tables of their own, boosted alike. A score is
the sigmoid of the sum of the table entries that a document's bins select.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_bound, written

FEATURES = (
    "log_words", "word_length", "letters", "upper", "digits", "marks", "odd_marks", "distinct_words", "top_word",
    "repeated_word", "distinct_pairs", "distinct_lines", "words_per_line", "short_words", "no_letter_words", "sentence_ends",
)
BINS, PAIR_BINS = 32, 8
#: Labelled ids (16 bytes each) that may be broadcast.
SMALL = 200_000

_KIND = np.zeros(256, np.uint8)  # 1 lower, 2 upper, 3 digit, 4 mark of prose, 5 odd mark, 6 space; other bytes are letters
_KIND[ord("a") : ord("z") + 1], _KIND[128:] = 1, 1
_KIND[ord("A") : ord("Z") + 1], _KIND[ord("0") : ord("9") + 1] = 2, 3
for _c in range(33, 127):
    if not _KIND[_c]:
        _KIND[_c] = 4 if chr(_c) in ".,;:'\"-()?" else 5
_KIND[:33] = 6


def features_of(text: str | None) -> list[float]:
    """FEATURES of a whole text; zeros for a null or blank one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n = len(words)
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=7)
    solid = max(1, len(raw) - int(kinds[6]))
    counts = Counter(words)
    lines = raw.split(b"\n")
    repeats = sum(map(bytes.__eq__, words[1:], words[:-1]))
    return [
        float(np.log1p(n)), solid / n, (kinds[1] + kinds[2]) / solid, kinds[2] / max(1, kinds[1] + kinds[2]), kinds[3] / solid, kinds[4] / n, kinds[5] / n,
        len(counts) / n, max(counts.values()) / n, repeats / n, len(set(zip(words, words[1:]))) / max(1, n - 1), len(set(lines)) / len(lines), n / len(lines),
        sum(c for w, c in counts.items() if len(w) <= 2) / n, sum(c for w, c in counts.items() if not w.upper() != w.lower()) / n, sum(c for w, c in counts.items() if w[-1] in b".!?") / n,
    ]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x), a row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features_of(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class AdditiveModel:
    bias: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for i, (e, t) in enumerate(zip(self.edges, self.tables)):
            z += t[np.searchsorted(e, x[:, i], "right")]
        for (i, j), t in zip(self.pairs, self.pair_tables):
            z += t[np.searchsorted(self.pair_edges[i], x[:, i], "right"), np.searchsorted(self.pair_edges[j], x[:, j], "right")]
        return z

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def quantile_edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)


def split(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, int]:
    """Gain and place of the best cut of bins with gradients g and weights h."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = gl**2 / (hl + l2) + (g.sum() - gl) ** 2 / (h.sum() - hl + l2) - g.sum() ** 2 / (h.sum() + l2)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def tree(g: np.ndarray, h: np.ndarray, leaves: int, l2: float) -> np.ndarray:
    """Values by bin of a tree with so many leaves at most."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        gain, at, k = max(((*split(g[a:b], h[a:b], l2), k) for k, (a, b) in enumerate(parts)), key=lambda s: s[0])
        if gain <= 1e-9:
            break
        a, b = parts[k]
        parts[k : k + 1] = [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + l2)
    return out


def first_cut(g: np.ndarray, h: np.ndarray, l2: float) -> int:
    """The cut of rows after which a cut of columns on both sides gains most: an interaction
    may show in neither feature alone."""
    def explained(a: int, b: int) -> float:
        u, v = g[a:b].sum(axis=0), h[a:b].sum(axis=0)
        return split(u, v, l2)[0] + u.sum() ** 2 / (v.sum() + l2)

    return max(range(1, len(g)), key=lambda at: explained(0, at) + explained(at, len(g)))


def fit_arrays(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 60, pairs: int = 6, rate: float = 0.15, leaves: int = 3, l2: float = 2.0) -> AdditiveModel:
    """y: 0 or 1. Without rows: the same score for all."""
    share = (y.sum() + 1) / (len(y) + 2)
    n = x.shape[1]
    edges = [quantile_edges(x[:, i], BINS) for i in range(n)]
    model = AdditiveModel(float(np.log(share / (1 - share))), edges, [np.zeros(len(e) + 1) for e in edges])
    if len(y) < 2 or y.min() == y.max():
        return model
    bins = [np.searchsorted(e, x[:, i], "right") for i, e in enumerate(edges)]
    z = model.raw(x)
    slopes = lambda: (y - (p := 1 / (1 + np.exp(-z))), p * (1 - p))
    for _ in range(rounds):
        for i in range(n):
            r, w = slopes()
            size = len(model.tables[i])
            step = rate * tree(np.bincount(bins[i], r, size), np.bincount(bins[i], w, size), leaves, l2)
            model.tables[i] += step
            z += step[bins[i]]
    model.pair_edges = [quantile_edges(x[:, i], PAIR_BINS) for i in range(n)]
    coarse = [np.searchsorted(e, x[:, i], "right") for i, e in enumerate(model.pair_edges)]
    sums = lambda i, j, v: np.bincount(coarse[i] * PAIR_BINS + coarse[j], v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
    r, w = slopes()
    gains = {(i, j): float((sums(i, j, r) ** 2 / (sums(i, j, w) + l2)).sum()) for i in range(n) for j in range(i)}
    model.pairs = sorted(gains, key=lambda p: (-gains[p], p))[:pairs]
    model.pair_tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), table in zip(model.pairs, model.pair_tables):
            r, w = slopes()
            g, h = sums(i, j, r), sums(i, j, w)
            at = first_cut(g, h, l2)
            step = np.zeros_like(table)
            for a, b in ((0, at), (at, PAIR_BINS)):
                if b > a:
                    step[a:b] = rate * tree(g[a:b].sum(axis=0), h[a:b].sum(axis=0), 2, l2)
            table += step
            z += step[coarse[i], coarse[j]]
    return model


def fit(feats: DataFrame, labels: DataFrame, trainable: Column, label_col: str = "quality", max_rows: int = 20_000) -> AdditiveModel:
    """Learns from rows of labels (doc_id, label_col) where trainable holds and the label isn't
    null. Of an id with several labels the larger share counts, ties as 1; of one with several
    texts the smallest features. max_rows bounds the labelled ids used: of those that have a text
    the ones with the smallest hash. Hashes are cut before texts are looked for, at a bound
    that rises until enough have one, so that only chosen ids' features are shuffled."""
    chosen = labels.where(trainable & F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg(label_col) >= 0.5).cast("int").alias("y"))
    chosen, key = written(chosen, "labels"), F.xxhash64("doc_id")
    n, k = chosen.count(), 2 * max_rows
    while True:
        low = chosen.where(key <= hash_bound(n, k))
        met = feats.join(F.broadcast(low) if k <= SMALL else low, "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.first("y").alias("y"))
        met = written(met, "labelled")
        if k >= n or met.count() >= max_rows:
            break
        k *= 8
    rows = met.orderBy(key).limit(max_rows).select("x", "y").toArrow()
    x = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, len(FEATURES))
    return fit_arrays(x, rows.column("y").to_numpy().astype(float))


def score(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 20_000) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of docs.

    held_out is an expression of doc_id; rows where it holds are never learned from. Null
    and empty texts have zero features and get a score as any other. Other columns of docs
    play no part. A text of any length counts whole. A score of 0.5 is predicted as 1. Without
    docs: no rows; without labels to learn from: 0.5 for all."""
    feats = written(features(docs, id_col, text_col), "features")
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    model = fit(feats, labels, ~held_out, "quality", max_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tables of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(FEATURES))
            s = shared.value.scores(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = feats.mapInArrow(run, "doc_id long, score double, predicted int")
    return rows.select("doc_id", held_out.alias("held_out"), "score", "predicted")
