"""Personal data: long texts, odd texts and the estimation against plain loops."""

import hashlib
import math
import random
import time

import pytest
from pyspark.sql import Row

from treetally.llm import pii

from test_operators import base_spans

#: Accepts what more labelers vote for than against.
PLAIN = pii.SpanClassifier(-0.5, [1.0] * len(pii.LABELERS) + [0.0] * (len(pii.EXTRA) + 5), {}, {})
PARTS = ["1", "22", "4111 1111 1111 1111", "378282246310005", "+1 234 567 8901", "+", "-", " ", "a@b.co", ".", "10.0.0.1", "256.1.1.1", "é", "﻿", "\U0001f600", "x", "@", "(", ")", "\n", "key=", "Mr. John Smith", "123-45-6789", "token: 9f86d081884c7d659a2feaa0c55ad015"]


def spans_of(text):
    return [(int(a), int(b), k) for k, a, b in (s.split(":") for s in text.split(",") if s)]


def redacted(text, spans):
    parts, end = [], 0
    for a, b, k in spans:
        if a >= end:
            parts += [text[end:a], f"[{k.upper()}]"]
        end = max(end, b)
    return "".join(parts) + text[end:]


def held_to_plain(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.detect(docs, PLAIN).collect()}
    new = {r["doc_id"]: r["text"] for r in pii.redact(docs, PLAIN).collect()}
    for i, t in enumerate(texts):
        spans = spans_of(found[i]["spans"])
        base = base_spans(t)
        assert found[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [s for s in spans if s[2] in pii.BASE] == spans_of(base)
        reach = 0  # added spans lie apart from base ones
        for a, b, k in spans:
            assert k in pii.BASE or a >= reach
            reach = max(reach, b) if k in pii.BASE else reach
        starts = sorted(a for a, _, k in spans if k in pii.BASE)
        assert all(not any(a <= x < b for x in starts) for a, b, k in spans if k not in pii.BASE) or len(spans) > 1000
        assert new[i] == redacted(t, spans)
    return found


def test_odd_texts(spark):
    rnd = random.Random(1)
    held_to_plain(spark, ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 40))) for _ in range(500)])


def test_long_texts_take_linear_time(spark):
    rnd = random.Random(2)
    texts = [",".join(str(rnd.randint(10, 99)) for _ in range(350_000)), " ".join(f"u{i}@example{i % 7}.com" for i in range(50_000)), "Mr. John Smith, 123-45-6789 é " * 30_000]
    began = time.time()
    found = held_to_plain(spark, texts)
    assert found[1]["n_email"] == 50_000 and time.time() - began < 120
    digits = spark.createDataFrame([(0, "".join(rnd.choice("0123456789") for _ in range(1_000_000)))], "doc_id long, text string")
    began = time.time()
    assert pii.detect(digits, PLAIN).first()["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.redact(digits, PLAIN).count() == 1 and time.time() - began < 60


def test_gazetteers_are_parameters(spark):
    docs = spark.createDataFrame([(1, "we met Mr. Qwerty today"), (2, "we met Mr. Asdfgh today"), (3, None)], "doc_id long, text string")
    listed = pii.Gazetteers(person_words=(), first_names=("qwerty",))
    found = {r["doc_id"]: r["n_added"] for r in pii.detect(docs, PLAIN, gazetteers=listed).collect()}
    assert found == {1: 1, 2: 0, 3: 0}


def plain_estimate(candidates, rounds):
    """Reliabilities by a loop over single candidates (kind, votes)."""
    sig = lambda z: 1 / (1 + math.exp(-z))
    likely, prior, rel = [sig(2.0 * sum(v) - 0.5) for _, v in candidates], {}, {}
    for _ in range(rounds):
        for k in pii.EXTRA:
            own = [p for (x, _), p in zip(candidates, likely) if x == k]
            prior[k] = (1 + sum(own)) / (2 + len(own))
        for j in range(len(pii.LABELERS)):
            for truth in (0, 1):
                seen = {v: 2.0 if v == 2 * truth - 1 else 1.0 for v in (-1, 0, 1)}
                for (_, votes), p in zip(candidates, likely):
                    seen[votes[j]] += p if truth else 1 - p
                rel[j, truth] = {v: x / sum(seen.values()) for v, x in seen.items()}
        likely = [sig(math.log(prior[k] / (1 - prior[k])) + sum(math.log(rel[j, 1][v] / rel[j, 0][v]) for j, v in enumerate(votes))) for k, votes in candidates]
    return prior, rel


def test_estimation_equals_a_loop_over_candidates():
    rnd = random.Random(3)
    patterns = [Row(kind=rnd.choice(pii.EXTRA), votes=[rnd.choice((-1, 0, 1)) for _ in pii.LABELERS], length=rnd.randint(0, 3), varied=rnd.randint(0, 1), n=rnd.randint(1, 9)) for _ in range(40)]
    rows = [{**r.asDict(), "count": r["n"]} for r in patterns]
    model = pii.fit_patterns(rows, rounds=15, steps=10)
    prior, rel = plain_estimate([(r["kind"], r["votes"]) for r in patterns for _ in range(r["n"])], 15)
    assert model.prior == pytest.approx(prior)
    for j, name in enumerate(pii.LABELERS):
        for truth in (0, 1):
            assert model.reliability[name][truth] == pytest.approx(rel[j, truth])


def test_gazetteers_from_a_table(spark):
    rows = [("First_Names ", " Xanthippe"), ("first_names", "xanthippe"), ("person_words", "Gezeichnet \t von"), ("other_words", None), (None, "x"), ("id_words", " ")]
    table = spark.createDataFrame([(*r, 1) for r in rows], "list string, entry string, kind int")
    alone, added = pii.read_gazetteers(table, base=None), pii.read_gazetteers(table)
    assert alone == pii.Gazetteers((), (), ("gezeichnet von",), (), ("xanthippe",))
    assert set(added.first_names) == {*pii.FIRST_NAMES, "xanthippe"} and set(added.id_words) == set(pii.ID_WORDS)
    assert pii.read_gazetteers(table.where("false"), base=None) == pii.Gazetteers((), (), (), (), ())
    docs = spark.createDataFrame([(1, "gezeichnet von Frau Xanthippe")], "doc_id long, text string")
    name = lambda g: [s[2] for s in spans_of(pii.detect(docs, PLAIN, gazetteers=g).first()["spans"])]
    assert name(alone) == ["name"] and name(pii.Gazetteers(first_names=(), person_words=())) == []
    for bad, why in (([("names", "x")], "no such lists"), ([("id_words", "x" * 25)], "longer than")):
        with pytest.raises(ValueError, match=why):
            pii.read_gazetteers(spark.createDataFrame(bad, "list string, entry string"))
    many = spark.range(pii.MAX_ENTRIES + 1).selectExpr("'first_names' AS list", "concat('n', id) AS entry")
    with pytest.raises(ValueError, match="more than"):
        pii.read_gazetteers(many)
