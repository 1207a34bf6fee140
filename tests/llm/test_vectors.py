"""Exact and approximate search against all pairs, with the registered queries' settings."""

from collections import Counter

import numpy as np
import pytest

from treetally.llm import bit_sliced, multi_index, queries

SCHEMA = "vec_id long, embedding array<float>, row int, d string, v double, seg int, query long"


def rows_of(n=400, seed=1):
    """Two lengths, repeated ids, repeated vectors, and rows that take no part."""
    x = np.random.default_rng(seed).normal(size=(n, 8)).astype(np.float32)
    x[5] = x[6] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(40, (x[3] * 2).tolist()), (40, x[40].tolist()), (80, x[7].tolist()), (80, x[7].tolist())]
    rows += [(i, v.tolist()) for i, v in zip(range(0, 300, 10), np.random.default_rng(9).normal(size=(30, 3)).astype(np.float32))]
    return rows, [(900, None), (901, [1.0, None]), (902, [float("nan")] * 8), (None, [1.0] * 8), (904, [])]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2.0, 3, 4) for i, v in rows], SCHEMA).repartition(5)


def plain_top(rows, k, every, whole):
    """All (query_id, rank, vec_id, score), by all pairs of rows of equal length."""
    x = [np.floor(1024 * np.array(v, np.float64)).astype(np.int64) if whole else np.array(v, np.float64) for _, v in rows]
    out = Counter()
    for q, (i, v) in enumerate(rows):
        if i % every == 0:
            found = sorted((-float((x[q] * x[c]).sum()) if not whole else -int((x[q] * x[c]).sum()), j) for c, (j, w) in enumerate(rows) if c != q and len(w) == len(v))[:k]
            out.update((i, r, j, round(-s, 9)) for r, (s, j) in enumerate(found, 1))
    return out


def as_counter(df):
    return Counter((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in df.collect())


def test_bit_sliced_top(spark):
    rows, odd = rows_of()
    rows.append((903, [0.0] * 8))
    got = bit_sliced.top_products(frame(spark, rows + odd), segment=100, query_every=20)
    assert as_counter(got) == plain_top(rows, 10, 20, True)
    assert bit_sliced.top_products(frame(spark, odd)).count() == 0


def test_multi_index_that_sees_all(spark):
    rows, odd = rows_of()
    got = multi_index.neighbours(frame(spark, [*rows, *odd, (903, [0.0] * 8)]), recall=1.0, query_every=20, segment=50)
    assert as_counter(got) == plain_top(rows, 20, 20, False)
    assert multi_index.neighbours(frame(spark, odd)).count() == 0


def test_cells_are_met_in_order():
    rng = np.random.default_rng(2)
    book = multi_index.Codebooks((rng.normal(size=(7, 2)), rng.normal(size=(5, 3))))
    held = sorted({(int(a), int(b)) for a, b in zip(rng.integers(0, 7, 25), rng.integers(0, 5, 25))})
    book.right, book.counts = np.array([b for _, b in held], np.int32), rng.integers(1, 9, len(held))
    book.starts = np.searchsorted([a for a, _ in held], np.arange(8))
    for _ in range(20):
        w = rng.normal(size=5)
        left, right = book.products(w)
        order = sorted(((left[a] + right[b], a, n) for (a, b), n in zip(held, book.counts.tolist())), reverse=True)
        for book.budget, k in ((1, 0), (10, 0), (40, 0), (int(book.counts.sum()), 0), (1, 30), (0, 10**6)):
            seen, want = 0, []
            for s, a, n in order:
                if seen >= max(book.budget, k + 1):
                    break
                seen += n
                want.append((s, a))
            bound, rows = book.met(w, k)
            assert bound == want[-1][0] and set(rows.tolist()) == {a for _, a in want}
        before = book.before(w, np.array([a for a, _ in held]), np.array([b for _, b in held]))
        assert before.tolist() == [sum(n for s, _, n in order if s > left[a] + right[b]) for a, b in held]


def recall_and_share(spark, rows, monkeypatch):
    """What the default settings find, and the share of entries that their cells hold."""
    found = rows.collect()
    ids, v = np.array([r[0] for r in found]), np.array([r[1] for r in found], np.float64)
    budgets, learn = [], multi_index.learn_budgets

    def watched(books, *rest):
        learn(books, *rest)
        budgets.extend(b.budget for b in books.values())

    monkeypatch.setattr(multi_index, "learn_budgets", watched)
    got = Counter((r["query_id"], r["vec_id"]) for r in multi_index.neighbours(rows).collect())
    want = Counter()
    for q in np.flatnonzero(ids % 20 == 0):
        s = v @ v[q]
        want.update((int(ids[q]), int(ids[k])) for k in [k for k in np.lexsort((ids, -s)) if k != q][:20])
    return (got & want).total() / want.total(), budgets[0] / len(ids)


def uniform(spark, n, d=64, seed=6):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate((x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32))], "vec_id long, embedding array<float>")


def test_recall_while_pruning(spark, monkeypatch):
    """Uniform directions, the worst case: still only a part of the entries is met."""
    recall, share = recall_and_share(spark, uniform(spark, 12_000), monkeypatch)
    print("recall", recall, "share of entries met", share)
    assert recall >= 0.9 and share <= 0.5


@pytest.mark.parametrize("budget", [None, 1])
def test_every_query_gets_its_rows(spark, monkeypatch, budget):
    """Few vectors, and values that very many rows repeat: k rows a query, or all others."""
    if budget:
        learn = multi_index.learn_budgets

        def least(books, *rest):
            learn(books, *rest)
            for book in books.values():
                book.budget = budget

        monkeypatch.setattr(multi_index, "learn_budgets", least)
    few = uniform(spark, 21, 16)
    assert Counter(r["query_id"] for r in multi_index.neighbours(few).collect()) == Counter({0: 20, 20: 20})
    values = [r["embedding"] for r in uniform(spark, 160, 16, 9).collect()]
    rows = [values[i % 10] for i in range(5000)] + values[10:]
    many = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>")
    found = multi_index.neighbours(many).collect()
    assert Counter(r["query_id"] for r in found) == Counter(dict.fromkeys(range(0, 5150, 20), 20)) and all(r["query_id"] != r["vec_id"] for r in found)


def test_near_groups_need_few_entries(spark, monkeypatch):
    """Vectors in groups, as real ones are: far under a tenth of the entries is met."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(100, 16))
    x = (centres[rng.integers(0, 100, 6000)] + 0.15 * rng.normal(size=(6000, 16))).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    recall, share = recall_and_share(spark, rows, monkeypatch)
    print("recall", recall, "share", share)
    assert recall >= 0.9 and share < 0.1


def test_registered_query_recall(spark):
    d = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    found = queries.op9_multi_index(spark, d).collect()
    got, want = Counter((r["query_id"], r["vec_id"]) for r in found), Counter()
    for q in np.flatnonzero(ids % 20 == 0):
        s = v @ v[q]
        want.update((int(ids[q]), int(ids[k])) for k in [k for k in np.lexsort((ids, -s)) if k != q][:20])
    assert (got & want).total() >= 0.9 * want.total() and got.total() == want.total()
    at = dict(zip(ids.tolist(), v))
    assert all(abs(r["score"] - at[r["query_id"]] @ at[r["vec_id"]]) < 1e-12 for r in found)


def test_bit_sliced_fails_rather_than_wrap(spark):
    ok, large = [(0, [3e4, -3e4]), (1, [3e4, 3e4]), (2, [-2e4, 1.0])], [(0, [3e6, 1.0]), (100, [1.0, -3e6])]
    assert as_counter(bit_sliced.top_products(frame(spark, ok))) == plain_top(ok, 10, 100, True)
    with pytest.raises(Exception, match="may not fit a long"):
        bit_sliced.top_products(frame(spark, large)).collect()
