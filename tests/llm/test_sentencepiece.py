"""Sampled segmentations: what a draw may depend on, long texts, and odds against all ways."""

import itertools
import math
import random
import time
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest

from treetally.llm import queries
from treetally.llm import sentencepiece_sampling as sps


@pytest.fixture(scope="module")
def vocabulary():
    with open(queries.tokenizer_path(), "rb") as f:
        return sps.Vocabulary(f.read())


def each(vocabulary, texts, keys, **kw):
    ids, n = sps.encode_batch(vocabulary, texts, keys, **kw)
    return [ids[a:b].tolist() for a, b in pairwise([0, *np.cumsum(n).tolist()])]


def test_a_draw_depends_on_its_own_text_and_key_only(vocabulary, monkeypatch):
    rnd = random.Random(2)
    texts = ["".join(rnd.choices("the of and ing  é\U0001f600▁x", k=rnd.choice([0, 3, 40, 300]))) for _ in range(150)] + ["z" * 700]
    keys = [rnd.getrandbits(64) for _ in texts]
    want = each(vocabulary, texts, keys)
    assert [each(vocabulary, [t], [k])[0] for t, k in zip(texts, keys)] == want
    assert each(vocabulary, texts[::-1], keys[::-1], together=7)[::-1] == want
    for few in (0, 1, 1 << 30):  # all places by arrays, or one by one
        monkeypatch.setattr(sps, "FEW", few)
        assert each(vocabulary, texts, keys) == want
    assert [sps.decode(vocabulary, i) for i in want] == texts


def test_hashes_one_by_one_are_those_of_arrays():
    x = [0, 1, 2**63, 2**64 - 1, 0x123456789ABCDEF]
    assert [sps.mixed_one(v) for v in x] == sps.mixed(np.array(x, np.uint64)).tolist()


def test_a_long_text_without_spaces(vocabulary):
    rnd = random.Random(3)
    for text in ("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000)), "".join(chr(rnd.randrange(0x4E00, 0x9000)) for _ in range(300_000))):
        start = time.time()
        ids = each(vocabulary, [text], [5])[0]
        assert time.time() - start < 20
        assert sps.decode(vocabulary, ids) == text


@pytest.mark.parametrize("sharpness", [1.0, 0.2, 60.0])
def test_samples_of_several_chunks_and_bytes(sharpness):
    with open(queries.tokenizer_path(), "rb") as f:
        vocabulary = sps.Vocabulary(f.read(), sharpness)
    strange = next(c for c in map(chr, range(0x10000, 0x10400)) if c not in vocabulary.ids)
    text = f"an  to{strange}o"

    def ways(chunk):
        if not chunk:
            return {(): 0.0}
        out = {}
        for k in range(1, len(chunk) + 1):
            i = vocabulary.ids.get(chunk[:k])
            if i is None and k > 1:
                continue
            head = (i,) if i is not None else tuple(vocabulary.byte_ids(ord(chunk)) if len(chunk) == 1 else vocabulary.byte_ids(ord(chunk[0])))
            weight = vocabulary.weights[i] if i is not None else vocabulary.byte_weight * len(head)
            for rest, w in ways(chunk[k:]).items():
                out[head + rest] = weight + w
        return out

    chunks = [ways(c.replace(" ", sps.SPACE)) for c in sps.CHUNK.findall(" " + text)]
    assert len(chunks) == 2
    want = {}
    for parts in itertools.product(*(c.items() for c in chunks)):
        whole = tuple(itertools.chain(*(p for p, _ in parts)))
        want[whole] = want.get(whole, 0.0) + math.prod(math.exp(w - max(c.values())) for (_, w), c in zip(parts, chunks))
    n, total = 40_000, sum(want.values())
    got = Counter(map(tuple, each(vocabulary, [text] * n, list(range(n)))))
    assert set(got) <= set(want)
    assert all(abs(got[k] / n - p / total) < 0.012 for k, p in want.items())


def test_empty_table_and_other_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "x"), (1, "a b", 5, "x"), (None, None, 6, "y"), (3, "", 7, "z")], "doc_id long, text string, ids int, n_pieces string")
    rows = sps.encode(docs, queries.tokenizer_path()).collect()
    assert len(rows) == 4 and sorted(r["ids"] is None for r in rows) == [False] * 3 + [True] and len({tuple(r["ids"]) for r in rows if r["doc_id"] == 1}) == 1
    assert sps.encode(docs.where("false"), queries.tokenizer_path()).count() == 0
