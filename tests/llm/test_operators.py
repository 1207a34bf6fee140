"""The ten operators against brute force, and their edge cases."""

import hashlib
import math
import re
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from treetally.llm import language, line_dedup, packing, pii, quality, queries, simhash, url_rules
from treetally.llm import sentencepiece_sampling as sps

DOC = "doc_id long, text string, lang string, source string, n_chars long, _text string, count long, spans string, _id string, dropped int, _lines int, key string"
CLASH = {"_text": "clash", "count": 7, "spans": "x", "_id": "y", "dropped": 3, "_lines": 4, "key": "z"}
LONG = "line one is here\n" * 3000
TEXTS = [
    (1, "Mail a.b@c.example.com or +1 (234) 555-7713.\nshared passage here"), (2, None), (3, ""), (None, "a null id 10.0.0.1 and 256.1.1.1"), (5, "  SHARED passage here \t\nown line of five"),
    (5, "  SHARED passage here \t\nown line of five"), (6, LONG + "x_y@d.e@f.g 4111 1111 1111 1111 4111111111111112"), (7, "une ligne française écrite ici"), (8, "1" * 5000 + " é" * 50), (9, "@ + ..."),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en" if i and i % 2 else None, "s", 0, *CLASH.values()) for i, t in TEXTS], DOC)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def unclashed(r):
    return {k: r[k] for k in CLASH} == CLASH


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    )
    found = [(m.start(), r, m.end(), k) for r, (k, p, ok) in enumerate(rules) for m in re.finditer(p, t or "") if ok(m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_pii(docs, empty):
    got = sorted((str(r["doc_id"]), r["base_sha256"]) for r in pii.detect(docs).collect())
    assert got == sorted((str(i), hashlib.sha256(base_spans(t).encode()).hexdigest()) for i, t in TEXTS)
    assert pii.detect(empty).count() == 0
    rows = pii.redact(docs).collect()
    assert all(unclashed(r) for r in rows)
    out = {r["doc_id"]: r["text"] for r in rows}
    assert "[EMAIL]" in out[1] and "[PHONE]" in out[1] and out[2] is None and "a.b@c" not in out[1]


def test_pii_learns_secrets(spark):
    rows = [(i, f"word token = \"{hashlib.sha1(str(i).encode()).hexdigest()}\" word" if i % 2 else f"commit {'ab' * 12}{i % 10} word") for i in range(60)]
    spans = {r["doc_id"]: r["spans"] for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(("secret" in s) == (i % 2 == 1) for i, s in spans.items())


def plain_line_dedup(texts):
    """(doc_id, text, n_lines, n_dropped) for each (doc_id, text)."""
    first, at = {}, lambda i: 1 << 62 if i is None else i
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    for i, t in texts:
        for k in map(key, (t or "").split("\n")):
            if len(k) >= 10:
                first[k] = min(first.get(k, 1 << 63), at(i))
    out = []
    for i, t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == at(i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_line_dedup(docs, empty):
    rows = line_dedup.dedup_lines(docs, batches=3, buckets=2, fan_out=2).collect()
    assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in rows) == Counter(plain_line_dedup(TEXTS))
    assert all(unclashed(r) for r in rows)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_rows_without_an_id_are_documents_of_their_own(spark):
    last = (1 << 63) - 1
    texts = [(3, "a line of three\nshort"), (last, "a line of the last"), (None, "A line of three \nnull line one"), (None, "null line one\nnull line two"), (None, "a line of the last\nnull line two"), *[(None, "copied line\nx")] * 3, (0, "zero's own line")]
    rows = line_dedup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), batches=2, buckets=2, fan_out=2).collect()
    kept = Counter(k for r in rows for x in r["text"].split("\n") if len(k := x.strip().lower()) >= 10)
    assert kept == {k: 1 for k in ("a line of three", "a line of the last", "null line one", "null line two", "copied line", "zero's own line")}
    assert {r["doc_id"]: r["text"] for r in rows if r["doc_id"] is not None} == {3: texts[0][1], last: texts[1][1], 0: texts[-1][1]}
    assert sum(r["n_lines"] - r["n_dropped"] for r in rows) == 10 and Counter(r["text"] for r in rows)["x"] == 2


def test_stored_runs_go_on(spark, tmp_path):
    """Three calls over one folder of runs: each document loses what an earlier call's documents have."""
    rows = [(i, "\n".join(f"line {k} of the text" for k in (i % 7, i % 5 + 10, i))) for i in range(60)]
    frame = lambda some: spark.createDataFrame(some, "doc_id long, text string")
    seen, out = set(), []
    for part in (rows[40:], rows[:20], rows[20:40], []):
        runs = line_dedup.LineRuns.stored(spark, str(tmp_path / "runs"), buckets=2, fan_out=2)
        found = line_dedup.dedup_lines(frame(part), batches=2, runs=runs).collect()
        runs.save()
        want = [(i, "\n".join(x for x in t.split("\n") if x not in seen)) for i, t in part]
        want = [(i, t) for i, t, _, _ in plain_line_dedup(want)]
        seen |= {x for _, t in part for x in t.split("\n")}
        assert Counter((r["doc_id"], r["text"]) for r in found if r["text"]) == Counter((i, t) for i, t in want if t)
        out += found
    assert sum(r["n_lines"] - r["n_dropped"] for r in out) == len(seen)
    assert spark.sql("show tables").where("tableName like 'line_run_%'").count() == len(runs.names())


def test_nothing_is_left_of_own_runs(spark):
    before = spark.sql("show tables").count()
    line_dedup.dedup_lines(spark.createDataFrame([(1, "one long line"), (2, "one long line")], "doc_id long, text string")).collect()
    assert spark.sql("show tables").count() == before


def plain_fingerprint(t):
    w = (t or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(near, nodes):
    """The smallest node that each can reach over the pairs near."""
    at, changed = {f: f for f in nodes}, True
    while changed:
        changed = False
        for a, b in near:
            low = min(at[a], at[b])
            changed |= (at[a], at[b]) != (low, low)
            at[a] = at[b] = low
    return at


def test_simhash(docs, empty):
    rows = simhash.near_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["fingerprint"]) for r in rows) == Counter((i, f"{plain_fingerprint(t):016x}") for i, t in TEXTS)
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(docs).collect()
    assert all(unclashed(r) for r in kept)
    assert sum(r[0] == 5 for r in kept) == 1 and sum(r[0] in (2, 3) for r in kept) == 1


def test_hot_texts_and_components_are_spread(spark, monkeypatch):
    """A third of the rows share a text, and one component has many texts."""
    words = [f"w{k}" for k in range(400)]
    rows = [(i, "the same text in very many rows") for i in range(100, 200)] + [(i, " ".join(words[:200] + words[200 + i % 90 :])) for i in range(100)] + [(None, "the same text in very many rows")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = Counter(map(tuple, simhash.near_duplicates(docs).collect()))
    lookup, heavy = simhash.lookup, simhash.heavy_keys
    monkeypatch.setattr(simhash, "lookup", lambda *a, **k: lookup(*a, **k | {"split": 10}))
    monkeypatch.setattr(simhash, "heavy_keys", lambda counts, key: heavy(counts, key, split=10))
    assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == plain
    assert sum(plain.values()) == 230


def test_simhash_links_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 20, dtype=np.int64)
    fps = sorted({int(c) ^ sum(1 << int(b) for b in rng.permutation(63)[: rng.integers(0, 5)]) for c in centres for _ in range(20)} | {0, 7})
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    near = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3]
    for block in (2048, 4):
        edges = [tuple(r) for r in simhash.links(frame, block).collect()]
        assert all((a ^ b).bit_count() <= 63 for a, b in edges) and plain_components(edges, fps) == plain_components(near, fps)


@pytest.fixture(scope="module")
def vocabulary():
    with open(queries.tokenizer_path(), "rb") as f:
        return sps.Vocabulary(f.read())


def test_sampled_segmentations(docs, empty, vocabulary):
    path = queries.tokenizer_path()
    once = {(r["doc_id"], r["n_pieces"]): r["ids"] for r in sps.encode(docs, path).collect()}
    again = {(r["doc_id"], r["n_pieces"]): r["ids"] for r in sps.encode(docs.repartition(5), path).collect()}
    assert once == again and sps.encode(empty, path).count() == 0
    back = sps.decoded(sps.encode(docs, path), path).collect()
    assert Counter((r["doc_id"], r["text"]) for r in back) == Counter(TEXTS) and all(r["lossless"] for r in back)
    odd = ["▁a ▁ b", "  two  spaces ", "\0�\U0001f600", " ", "▁"]
    ids, n = sps.encode_batch(vocabulary, odd, [1, 2, 3, 4, 5], together=3)
    ends = np.cumsum(n).tolist()
    assert [sps.decode(vocabulary, ids[a:b]) for a, b in pairwise([0, *ends])] == odd


def test_samples_follow_the_weights(vocabulary):
    def ways(text):
        if not text:
            return {(): 1.0}
        out = {}
        for k in range(1, len(text) + 1):
            i = vocabulary.ids.get(text[:k])
            if i is not None:
                for rest, p in ways(text[k:]).items():
                    out[(i, *rest)] = p * math.exp(vocabulary.weights[i])
        return out

    want, n = ways("▁then"), 40_000
    ids, counts = sps.encode_batch(vocabulary, ["then"] * n, list(range(n)))
    ends = np.cumsum(counts)
    got = Counter(tuple(ids[b - c : b].tolist()) for b, c in zip(ends, counts))
    total = sum(want.values())
    assert set(got) <= set(want)
    assert all(abs(got[k] / n - p / total) < 0.01 for k, p in want.items())


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://A.NET/x", "http://a.net", "http://example.net/en/1?q#f", "http://b.example.com/de/", "http://x.org/fr/a", "http://xnet/", "http://a.casino-win.example.com/", "ftp://z.org/q?utm_source=feed", "http://z.com/q?utm_source=feed&x=1", "http://z.com/q?utm_source=feeder"]
    rows = url_rules.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    got = [(r["rule"], r["verdict"]) for r in sorted(rows, key=lambda r: r["page_id"])]
    assert got == [(None, "allow")] * 3 + [("net/", "block"), (None, "allow"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), (None, "allow"), (None, "block"), (None, "allow"), (None, "block"), (None, "allow")]


def test_packing(docs, empty):
    rows = packing.pack_documents(docs, sizes=(64, 256, 1024), shard=5).collect()
    covered, bins = Counter(), {}
    for r in rows:
        covered[(r["doc_id"], r["copy"])] += r["length"]
        bins.setdefault((r["bin_id"], r["bin_size"]), []).append((r["bin_offset"], r["length"]))
    words = lambda t: len((t or "").encode().split())
    assert sum(covered.values()) == sum(words(t) + 1 for _, t in TEXTS)
    for (_, size), parts in bins.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= size and size == min(s for s in (64, 256, 1024) if s >= at)
    assert packing.pack_documents(empty).count() == 0


def test_quality_and_language_edges(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (5, 1), (6, 0), (8, 0), (None, 1), (7, None)], "doc_id long, quality int")
    rows = quality.score(docs, labels, language.held_out("doc_id", 3, 1)).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert quality.score(empty, labels.where("false"), language.held_out("doc_id", 3, 1)).count() == 0
    model = language.fit(docs, F.lit(True))
    found = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, model, keep=["doc_id"]).collect()}
    assert found[2] == found[3] == found[9] == "und" and found[1] == "en"
    assert language.fit(empty, F.lit(True)).predict("words here") == ("und", 0.0)


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit_arrays(x[:2000], y[:2000])
    assert ((model.scores(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.9


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    rows = queries.op10_language(spark, d).where("held_out").join(docs, "doc_id").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()
    assert rows[0] > 0.97
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = queries.op8_quality(spark, d).where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()
    assert rows[0] > 0.95
