"""Repeated windows against a plain count of all windows."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from treetally.llm import substring_dedup as sd

SCHEMA = "doc_id long, text string, _id string, _mark int, _text string, start int, spans string, n_words string, gram int, c0 double"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "a", 1, "b", 2, "c", "d", 3, 4.0) for i, t in rows], SCHEMA).repartition(3)


def plain(rows, width=35):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for p in range(len(w) - width + 1):
            if seen[tuple(w[p : p + width])] > 1:
                gone.update(range(p, p + width))
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=str)


def corpus(seed=1):
    rng = random.Random(seed)
    text = lambda n, vocab=5000: " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))
    shared = [text(n) for n in (34, 35, 36, 60, 200, 1000)]
    rows = [(i, text(rng.randrange(0, 120)) + rng.choice([" ", "\n", "\t\v "]) + rng.choice([*shared, ""]) + " " + text(rng.randrange(0, 80))) for i in range(120)]
    rows += [(200 + i, shared[4]) for i in range(40)]  # copies
    near = text(400).split()
    for i in range(30):  # near copies, each with a word of its own
        copy = list(near)
        copy[rng.randrange(400)] = f"own{i}"
        rows.append((300 + i, " ".join(copy)))
    rows += [(400, "a " * 300), (401, "a b " * 100), (402, "a b c d e f g " * 20 + "x"), (403, "a " * 34), (404, shared[3] + " " + shared[3])]
    rows += [(405, None), (406, ""), (407, " \n\t"), (None, shared[2]), (None, None), (None, text(50)), (408, " ".join(["é"] * 50)), (409, "\x1c ".join(["é"] * 50))]
    once = text(80)
    rows += [(410, once), (410, once), (410, text(60)), (None, "z " * 50), (None, "z " * 50)]
    rows += [(500, text(6000, 40)), (501, text(6000, 3))]
    return rows


def test_equals_a_count_of_all_windows(spark):
    rows = corpus()
    out = sd.remove_repeated(frame(spark, rows))
    assert out.columns == [c.split()[0] for c in SCHEMA.split(", ") if not c.startswith("n_words")] + ["n_words", "n_removed"]
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in out.collect()), key=str) == plain(rows)


def test_no_rows_and_short_texts(spark):
    assert sd.remove_repeated(frame(spark, [])).count() == 0
    assert [tuple(r)[-3:] for r in sd.remove_repeated(frame(spark, [(1, "a b"), (1, "a b")]).select("doc_id", "text")).collect()] == [("a b", 2, 0)] * 2


@pytest.mark.parametrize("block", [1, 7, 50])
def test_stretches_of_long_texts(block, monkeypatch):
    """Pieces tile the windows of each text, however it is cut; equal windows have equal grams."""
    monkeypatch.setattr(sd, "BLOCK", block)
    monkeypatch.setattr(sd, "SLICE", 40)
    texts = [(t or "").encode() for _, t in corpus(2)[:160]]
    cache = sd.WordHashes()
    hashes = [cache.of(t) for t in texts]
    assert [len(h) for h in hashes] == [len(t.split()) for t in texts]
    gram_of, covered = {}, Counter()
    for p in sd.pieces_of(hashes):
        for doc, start, n, gram in zip(p["doc"], p["start"], p["n"], p["gram"]):
            for i in range(start, start + n):
                covered[doc, i] += 1
                assert gram_of.setdefault(tuple(texts[doc].split()[i : i + 35]), gram) == gram
    assert covered == Counter({(d, i): 1 for d, h in enumerate(hashes) for i in range(len(h) - 34)})


def test_hashes_are_of_words_alone():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    roll, again = sd.Rolling(np.concatenate([words, words])), sd.Rolling(words)
    at = np.arange(300)
    assert (roll.of(at + 400, 35) == again.of(at, 35)).all() and len(np.unique(again.of(at, 35))) == 300
    least = sd.leftmost_least(np.array([3, 1, 1, 2, 1, 0, 0, 5]), 3)
    assert least.tolist() == [1, 1, 2, 5, 5, 5]


def test_a_span_that_does_not_fit_is_an_error():
    h = np.arange(200).astype(np.uint64)
    with pytest.raises(ValueError):
        sd.covered(h, [{"start": 0, "n": 166, "check": 5}])


def test_texts_are_read_three_times(spark, monkeypatch):
    """For pieces, for the windows of branches and for what is kept."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i % 3) * 7 + j}" for j in range(60))) for i in range(9)], "doc_id long, text string")
    calls, real = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, *a, **k: calls.append(f.__name__) or real(self, f, *a, **k))
    assert sd.remove_repeated(docs).where("n_removed > 0").count() == 9
    assert len(calls) == 3
