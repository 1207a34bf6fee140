"""Hard negatives against all pairs, and how far lists are walked."""

import numpy as np

from treetally.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, row int, d string, v double, seg int, cluster int, batch int, high int, found int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, c, 1, "x", 2.0, 3, 4, 5, 6, 7) for i, v, c in rows], SCHEMA).repartition(4)


def plain(rows, every=50, positives=5, negatives=3):
    rows = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v], (c + 1) % 10 if i % 7 == 0 else c) for i, v, c in rows]
    out = []
    for a, (i, v, c) in enumerate(rows):
        if i % every:
            continue
        by = sorted((-sum(x * y for x, y in zip(v, w)), j, k) for k, (j, w, _) in enumerate(rows) if k != a and len(w) == len(v))
        for s, j, k in [x for x in by if rows[x[2]][2] == c][:positives]:
            fits = [x for x in by if rows[x[2]][2] != c and -50 * s <= -100 * x[0] <= -95 * s]
            out += [(i, j, r, n, -s, -t) for r, (t, n, _) in enumerate(fits[:negatives], 1)]
    return sorted(out)


def test_equals_all_pairs(spark):
    """Two lengths, repeated ids and vectors, ties, zeros, few positives, rows that take no part."""
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(rng.normal(size=(300, 6)).astype(np.float32), rng.integers(0, 10, 300)))]
    rows += [(50, rows[10][1], 3), (50, rows[10][1], 3), (51, rows[10][1], 4), (400, [0.0] * 6, 5), (401, [0.0] * 6, 5), (450, rows[3][1], 77)]
    rows += [(i, v.tolist(), 1 + i // 25 % 2) for i, v in zip(range(500, 700, 5), rng.normal(size=(40, 3)).astype(np.float32))]
    odd = [(550, None, 1), (600, [1.0, None], 1), (650, [float("nan")] * 6, 1), (None, [1.0] * 6, 1), (700, [1.0] * 6, None), (750, [], 2)]
    want = plain(rows)
    for sizes in ({"segment": 40, "members": 2}, {"segment": 1000, "members": 100}):
        assert sorted(tuple(r) for r in hn.hard_negatives(frame(spark, rows + odd), **sizes).collect()) == want
    assert len(want) > 50
    assert hn.hard_negatives(frame(spark, odd)).count() == 0
    assert hn.hard_negatives(frame(spark, [(50, [1.0], 1)])).count() == 0


def test_walk_ends_early_where_directions_are_grouped(monkeypatch):
    rng = np.random.default_rng(8)
    centres = hn.units(rng.normal(size=(40, 32)))
    x = np.floor(256 * hn.units(centres[rng.integers(0, 40, 20_000)] + 0.03 * rng.normal(size=(20_000, 32))))
    ids = np.arange(len(x))
    members = x[hn.units(x) @ centres[0] > 0.9][:50]
    order, bounds = hn.shared_list(x, members)
    assert (hn.norms(members)[:, None] * bounds >= members @ x[order].T).all()
    seen = []
    inf = np.full((len(members), 1), np.inf)
    found = hn.walk(x, ids, order, bounds, members, lambda m, at: seen.append(len(m) * len(at)) or np.ones((len(m), len(at)), bool), inf, -inf, 5)
    for v, [(at, scores)] in zip(members, found):
        s = x @ v
        assert at.tolist() == np.lexsort((ids, -s))[:5].tolist() and scores.tolist() == s[at].tolist()
    assert sum(seen) < 0.1 * len(x) * len(members)


def test_large_components_raise(spark):
    import pytest

    with pytest.raises(Exception, match="too large"):
        hn.hard_negatives(frame(spark, [(50, [3e38, 1.0], 1), (51, [1.0, 1.0], 1)])).collect()
