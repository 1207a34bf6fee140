"""Packing against plain best fit, quality scores against plain sums, and their edges."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from treetally.llm import language, packing, quality

SIZES = (8, 16, 32)


def plain_pack(lengths, sizes):
    """Per policy: falling lengths, the fullest bin with room by looking at all bins; least cost wins."""
    best = None
    for least in sizes:
        bins = []  # (room, contents)
        for n in sorted(lengths, reverse=True):
            fits = [b for b in bins if b[0] >= n and b[0] > 0 or n == 0 and b[0] > 0]
            if fits:
                b = min(fits, key=lambda b: b[0])
            else:
                size = min((s for s in sizes if s >= n and s >= least), key=lambda s: (packing.cost(s) / s, s))
                bins.append(b := [size, []])
            b[0] -= n
            b[1].append(n)
        down = [min(s for s in sizes if s >= sum(c)) for _, c in bins]
        total = sum(map(packing.cost, down))
        if best is None or total < best[0]:
            best = (total, Counter(zip(down, (sum(c) for _, c in bins))))
    return best


def test_pack_equals_plain_best_fit():
    rnd = random.Random(1)
    for _ in range(200):
        lengths = [rnd.randint(0, 32) for _ in range(rnd.randint(1, 40))]
        bins, at, down, content = packing.pack(np.array(lengths), SIZES)
        total, want = plain_pack(lengths, SIZES)
        assert sum(packing.cost(int(s)) for s in down) == pytest.approx(total)
        assert Counter(zip(down.tolist(), content.tolist())) == want
        for b in range(len(down)):
            inside = sorted((at[i], lengths[i]) for i in np.flatnonzero(bins == b))
            assert [o for o, n in inside if n] == [x for x, n in zip(itertools.accumulate([0, *[n for _, n in inside]]), [n for _, n in inside]) if n]


def test_packing_edges(spark):
    rows = [(1, "a b c", -3, "x"), (1, "a b c", -3, "x"), (None, None, None, "x"), (2, "", 70, None), (3, "w " * 1000, 0, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, bin_id string")
    got = packing.pack_documents(docs, F.col("n"), sizes=SIZES).collect()
    assert Counter((r["doc_id"], r["copy"]) for r in got if r["start"] == 0) == Counter([(1, 1), (1, 2), (None, 1), (2, 1), (3, 1)])
    assert [(r["start"], r["length"]) for r in sorted(got, key=lambda r: r["start"]) if r["doc_id"] == 2] == [(0, 32), (32, 32), (64, 6)]
    assert packing.pack_documents(docs.where("false")).count() == 0
    same = [sorted(map(tuple, packing.pack_documents(d, sizes=SIZES).collect()), key=str) for d in (docs, docs.repartition(4))]
    assert same[0] == same[1]


def plain_score(model, x):
    z = model.bias
    for i, (edges, table) in enumerate(zip(model.edges, model.tables)):
        z += table[sum(x[i] >= e for e in edges)]
    for (i, j), table in zip(model.pairs, model.pair_tables):
        z += table[sum(x[i] >= e for e in model.pair_edges[i])][sum(x[j] >= e for e in model.pair_edges[j])]
    return 1 / (1 + np.exp(-z))


def test_scores_are_sums_of_looked_up_entries():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, len(quality.FEATURES))).round(1)
    model = quality.fit_arrays(x, (x[:, 0] * x[:, 1] > 0).astype(float), rounds=10, pair_rounds=10)
    assert len(model.pairs) == 6
    assert model.scores(x) == pytest.approx([plain_score(model, row) for row in x])


def test_tree_takes_the_best_cut():
    rng = np.random.default_rng(2)
    for _ in range(50):
        g, h = rng.normal(size=9), rng.uniform(0.1, 2, 9)
        gain = lambda cuts: sum(g[a:b].sum() ** 2 / (h[a:b].sum() + 2.0) for a, b in itertools.pairwise([0, *cuts, 9]))
        best = max(range(1, 9), key=lambda c: gain([c]))
        want = np.concatenate([np.full(b - a, g[a:b].sum() / (h[a:b].sum() + 2.0)) for a, b in ((0, best), (best, 9))])
        assert quality.tree(g, h, 2, 2.0) == pytest.approx(want if gain([best]) - gain([]) > 1e-9 else np.full(9, g.sum() / (h.sum() + 2.0)))


def test_quality_ties_and_repeats(spark):
    rows = [(i, t, "x", 1.0, True) for i, t in [(1, "good words here."), (1, "good words here."), (2, None), (3, ""), (None, "null id"), (4, "w " * 50_000)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, x string, score double, held_out boolean")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.score(docs, none, language.held_out("doc_id", 3, 1)).collect()
    assert len(got) == 6 and all(r["score"] == 0.5 and r["predicted"] == 1 for r in got)  # nothing learned: a tie counts as 1
    labels = spark.createDataFrame([(2, 0), (2, 0), (2, 1), (3, 1), (3, 1), (5, 1)], "doc_id long, quality int")
    got = quality.score(docs, labels, F.lit(False)).collect()
    assert len(got) == 6 and len({r["score"] for r in got if r["doc_id"] in (2, 3)}) == 1


def test_quality_sample_reaches_the_labelled_texts(spark, monkeypatch):
    """Most labelled ids have no text: the hash bound rises until max_rows have one, or none is left."""
    docs = spark.createDataFrame([(i, f"word {i} " * (i % 9 + 1), "clash") for i in range(0, 4000, 40)], "doc_id long, text string, y string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4000)] + [(None, 1), (3, None)], "doc_id long, quality int")
    feats = quality.features(docs)
    seen = []
    monkeypatch.setattr(quality, "fit_arrays", lambda x, y: seen.append((x.tolist(), y.tolist())))
    hashed = [r[0] for r in docs.select("doc_id").orderBy(F.xxhash64("doc_id")).collect()]
    of = {r["doc_id"]: list(r["x"]) for r in feats.collect()}
    for small in (200_000, 0):
        monkeypatch.setattr(quality, "SMALL", small)
        for k in (1, 7, 100, 500):
            quality.fit(feats, labels, F.lit(True), max_rows=k)
            assert seen.pop() == ([of[i] for i in hashed[:k]], [float(i % 2) for i in hashed[:k]])
