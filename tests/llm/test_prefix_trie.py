"""The trie against a plain one, with chunks of few conversations and with hostile rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np

from treetally.llm import prefix_trie
from treetally.llm.prefix_trie import Minima, least_between

SCHEMA = "conv_id long, turn long, role string, text string, key string, sizes int, base int, h string, own int"


def plain(rows, every=5, heads=9):
    """All nodes, from (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append(((t is not None, t or 0), hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).hexdigest(), (r, x)))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % heads
        whole[c] = tuple(own.get(c - int(np.fmod(c, every)), [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    below = defaultdict(list)
    for node in members:
        for d in range(len(node) + 1):
            below[node[:d]].append(node)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    out = []
    for node, ids in members.items():
        ends = ",".join(map(str, sorted(c for c in ids if len(whole[c]) == len(node))))
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below[node] if n)
        out.append((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), children[node], sum(not children[n] for n in below[node]), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1, 2, "y", 3) for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(prefix_trie.sequences(df), **more).collect()), key=str)


def test_equals_a_plain_trie_over_many_chunks(spark):
    """Hot first turns, whole conversations that repeat, nulls, ties of turn, empty and long texts, absent bases, negative ids."""
    rng, rows = random.Random(3), []
    for c in [*range(-12, 90), 10**12, 10**12 + 3]:
        if c % 11 == 4:
            continue  # some bases are absent
        kind = rng.random()
        turns = ["hot"] * 9 if kind < 0.4 else [rng.choice("ab") for _ in range(rng.randrange(1, 14))]
        rows += [(c, i, rng.choice(["user", "user", None]) if kind > 0.9 else "user", t) for i, t in enumerate(turns)]
    rows += [(50, None, "system", None), (50, 2, "x", "tie"), (50, 2, "x", "tie"), (51, 0, "user", "é" * 5000), (52, 7, None, ""), (None, 1, "user", "hot")]
    rows += [(60, i, "user", "hot") for i in range(200)]
    assert found(spark, rows, chunk=7) == found(spark, rows) == plain(rows)


def test_no_rows_and_one_row(spark):
    assert found(spark, []) == found(spark, [(None, 1, "a", "b")]) == []
    assert found(spark, [(3, None, None, None)]) == plain([(3, None, None, None)])


def test_long_list_of_ends_is_hashed_piece_by_piece(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    rows = [(5 * c, 0, "user", "same") for c in range(300)] + [(5 * c, 1, "user", "same") for c in range(0, 300, 7)]
    assert found(spark, rows, chunk=10) == plain(rows)


def test_long_conversation(spark):
    """20,000 turns, twice: as many nodes, without sums over pairs of them."""
    rows = [(c, i, "user", str(i)) for c in (5, 10) for i in range(20_000)]
    got = found(spark, rows)
    assert sorted(r[1] for r in got) == list(range(20_001)) and all(r[3] == 2 and r[5] == 1 for r in got)
    assert next(r for r in got if r[1] == 0)[6] == sum(len(str(i)) for i in range(20_000))


def test_minima_and_searches():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 17, 64, 100):
        v = rng.integers(0, 6, n).astype(np.int32)
        at, least = np.repeat(np.arange(n), 6), np.tile(np.arange(6), n)
        right, left = Minima(v).right(at, least), Minima(v).left(at, least)
        for i, d, r, l in zip(at, least, right, left):
            assert all(v[i + 1 : r + 1] >= d) and (r == n - 1 or v[r + 1] < d)
            assert all(v[l + 1 : i + 1] >= d) and (l == 0 or v[l] < d)
        a, b = np.sort(rng.integers(0, n, (2, 50)), axis=0)
        assert least_between(v, a, b).tolist() == [min(v[i : j + 1]) for i, j in zip(a, b)]
