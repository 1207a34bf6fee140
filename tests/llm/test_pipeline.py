"""Every stage of the pipeline against a plain version of it, each on its own input."""

import re
from collections import Counter

import regex

import corpus_pipeline
from treetally.llm import language, pii
from treetally.llm.common import written

from test_operators import TEXTS, base_spans, plain_components, plain_fingerprint, plain_line_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
D = "/root/testdata/sf0.001"


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages(spark, tmp_path):
    planted = spark.createDataFrame([(10_000 + k, t, "en", "s", len(t or "")) for k, (_, t) in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = spark.read.parquet(f"{D}/documents.parquet").select(*COLUMNS).unionByName(planted)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], str(tmp_path)), "stage"))
    assert all(x.columns == COLUMNS for x in out[:-1])
    start, with_lang, with_lines, single, redacted = map(pairs, out[:-1])

    # Language ID: what has a letter stays, with the language that the model finds.
    assert Counter(with_lang) == Counter((i, t) for i, t in start if regex.search(r"\p{L}", t or ""))
    model = language.fit(docs, ~language.held_out("doc_id", 5, 0))
    assert all(r["lang"] == model.predict(r["text"])[0] for r in out[1].collect())

    assert Counter(with_lines) == Counter((i, t) for i, t, _, _ in plain_line_dedup(with_lang))

    # Near-dedup: of each component of fingerprints the smallest id.
    fp = {i: plain_fingerprint(t) for i, t in with_lines}
    values = sorted(set(fp.values()))
    at = plain_components([(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 3], values)
    least = {}
    for i, f in fp.items():
        least[at[f]] = min(i, least.get(at[f], i))
    assert Counter(single) == Counter((i, t) for i, t in with_lines if least[at[fp[i]]] == i)

    # PII: every span, base ones among them, becomes its kind.
    spans = {r["doc_id"]: r["spans"] for r in pii.detect(out[3]).collect()}
    want = Counter()
    for i, t in single:
        found = [(int(a), int(b), k) for k, a, b in (s.split(":") for s in spans[i].split(",") if s)]
        assert set(base_spans(t).split(",")) - {""} <= set(spans[i].split(","))
        parts, end, kind = [], 0, None
        for a, b, k in found:
            if a >= end:
                parts += [t[end:a], f"[{k.upper()}]"]
            end = max(end, b)
        want[(i, "".join(parts) + t[end:])] += 1
    assert Counter(redacted) == want

    # Packing: every word of every document, and its end, has one place.
    places = Counter()
    for r in out[5].collect():
        places[r["doc_id"]] += r["length"]
    assert places == {i: len((t or "").encode().split()) + 1 for i, t in redacted}


def test_near_copies_are_dropped_by_row(spark):
    a, b, c, d = ("alpha beta gamma delta", "one two three four five", "red green blue white", "north south east west")
    rows = [(3, a), (5, a), (5, b), (None, c), (None, d), (None, d), (None, b), (7, None), (None, ""), (9, "x y z u"), (9, "p q r s t")]
    docs = spark.createDataFrame([(i, t, None, "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter(pairs(corpus_pipeline.drop_near_copies(spark, docs, "")))
    assert got == Counter([(3, a), (5, b), (None, c), (None, d), (7, None), (9, "x y z u"), (9, "p q r s t")])


def test_unlabelled_documents_stay(spark):
    held = next(i for i in range(100) if spark.range(i, i + 1).where(language.held_out("id", 5, 0)).count())
    texts = [(held, "words of a document"), (None, "слово"), (held + 1, "12 + ..."), (held + 2, None), (held + 3, "é")]
    for lang in (None, "en"):  # no label at all; the only label in the held-out fold
        rows = [(i, t, lang if i == held else None, "s", 1) for i, t in texts]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        got = corpus_pipeline.identify_language(spark, docs, "").collect()
        assert Counter(map(tuple, got)) == Counter(r for r in rows if regex.search(r"\p{L}", r[1] or ""))


def test_empty_and_clashing_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, lang_pred string, n_lines string, n_dropped string, _text string, _spans string, c0 string"
    extra = ("a", "b", "c", "d", "e", "f", "g")
    rows = [(i, t, "en" if i else None, "s", 1, *extra) for i, t in [(1, "first words of a text\nshared line of two"), (2, "other words\nshared line of two"), (2, "other words\nshared line of two"), (None, "no id, mail a@b.org"), (5, None), (6, ""), (7, "12")]]
    docs = spark.createDataFrame(rows, schema)
    for name, table in (("full", docs), ("empty", docs.where("false"))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = written(stage(spark, out, ""), "stage")
            assert out.columns == docs.columns and all(tuple(r)[5:] == extra for r in out.collect())
        places = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert {r["doc_id"] for r in places} == ({1, 2, None} if name == "full" else set())
