"""Language ID against a plain backoff scorer, and what fitting keeps."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from treetally.llm import language

SCHEMA = "doc_id long, text string, lang string, token string, n int, _text string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, x, "token", 1, "clash") for i, t, x in rows], SCHEMA).repartition(3)


class Plain:
    """Words first, then the mean of the longest n-grams of which any is known; plain dicts."""

    def __init__(self, rows):
        self.of = Counter(x for _, t, x in rows)
        words = defaultdict(Counter)
        for _, t, x in rows:
            words[x].update(regex.findall(r"\p{L}+", (t or "").lower()))
        self.langs = sorted(x for x in words if words[x])
        grams = {x: Counter(g for w in words[x] for n in range(1, 6) for g in self.grams(w, n)) for x in self.langs}
        self.words, self.pieces = self.logs(words), self.logs(grams)

    @staticmethod
    def grams(word, n):
        word = f"^{word}$"
        return [word[i : i + n] for i in range(len(word) - n + 1)]

    def logs(self, counts):
        total = {x: sum(counts[x].values()) for x in self.langs}
        added = {x: 0.5 * total[x] / max(total.values()) for x in self.langs}
        known = {t for x in self.langs for t in counts[x]}
        return {t: [math.log((counts[x][t] + added[x]) / (total[x] + added[x] * (len(known) + 1))) for x in self.langs] for t in known}

    def predict(self, text):
        words = regex.findall(r"\p{L}+", (text or "").lower())
        if not words:
            return "und", 0.0
        z = [math.log(self.of[x] / sum(self.of[y] for y in self.langs)) for x in self.langs]
        for w in words:
            if w in self.words:
                found = [self.words[w]]
            else:
                found = next((f for n in range(5, 0, -1) if (f := [self.pieces[g] for g in self.grams(w, n) if g in self.pieces])), [[0.0] * len(z)])
            z = [a + sum(f[i] for f in found) / len(found) for i, a in enumerate(z)]
        best = max(z)
        return self.langs[z.index(best)], 1 / sum(math.exp(a - best) for a in z)


TRAIN = [(1, "the cat and the dog ran", "en"), (2, "le chat et le chien", "fr"), (3, "der Hund und die Katze", "de"), (4, "the end of the day", "en"), (5, "12 + ...", "nul"), (6, None, "nul"), (7, "les chats noirs", "fr"), (7, "les chats noirs", "fr")]
ASKED = ["the cats", "chats", "Hunde und Katzen", "", None, "123", "zzz", "слово", "x" * 5000 + " the", "dogs chien", "THE dog " * 300]


@pytest.mark.parametrize("most,split", [(language.MAX_BROADCAST, 10**6), (0, 10**6), (0, 2)])
def test_equals_a_plain_scorer(spark, most, split):
    """Broadcast and joined models give the same."""
    model = language.fit(frame(spark, TRAIN), F.lit(True), max_broadcast=most)
    plain = Plain(TRAIN)
    assert model.langs == plain.langs
    asked = frame(spark, [*((i, t, None) for i, t in enumerate(ASKED)), (None, "the cats", None), (0, "the cats", None)])
    rows = language.identify(asked, model, max_broadcast=most, split=split).collect()
    assert len(rows) == len(ASKED) + 2 and all(r["token"] == "token" and r["_text"] == "clash" and r["n"] == 1 for r in rows)
    for r in rows:
        lang, score = plain.predict(r["text"])
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-9
    assert language.identify(asked.where("false"), model, max_broadcast=most).count() == 0


def test_ties_go_to_the_first_by_name(spark):
    model = language.fit(frame(spark, [(1, "same words", "bb"), (2, "same words", "aa")]), F.lit(True))
    assert model.predict("same") == ("aa", pytest.approx(0.5))


def test_three_hundred_languages(spark):
    rng = np.random.default_rng(6)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    words = {f"l{i:03}": ["".join(rng.choice(letters, 8)) for _ in range(12)] for i in range(300)}
    rows = [(i * 4 + j, " ".join(rng.choice(of, 6)), x) for i, (x, of) in enumerate(words.items()) for j in range(4)]
    docs = frame(spark, rows)
    model, plain = language.fit(docs, F.lit(True)), Plain(rows)
    assert model.langs == sorted(words)
    got = {(r["doc_id"]): (r["lang_pred"], r["score"]) for r in language.identify(docs, model, keep=["doc_id"]).collect()}
    assert all(got[i][0] == plain.predict(t)[0] and abs(got[i][1] - plain.predict(t)[1]) < 1e-9 for i, t, _ in rows[::20])
    assert sum(got[i][0] == x for i, _, x in rows) > 0.99 * len(rows)


def test_rare_languages_are_learned(spark):
    rng = np.random.default_rng(5)
    word = lambda letters: "".join(rng.choice(list(letters), 6))
    of = {x: [word(letters) for _ in range(300)] for x, letters in (("aa", "abcdef"), ("bb", "ghijkl"), ("zz", "mnopqr"))}
    rows = [(i, " ".join(rng.choice(of[x], 30)) if x in of else "12 + ...", x) for i, x in enumerate(["zz"] * 5 + ["aa"] * 600 + ["bb"] * 595 + ["un"] * 3)]
    docs = spark.createDataFrame([*rows, *[(None, t, x) for _, t, x in rows[:2]]], "doc_id long, text string, lang string")
    model = language.fit(docs, F.lit(True), max_docs=100)
    assert model.langs == ["aa", "bb", "zz"]
    zz = {w for _, t, x in rows if x == "zz" for w in t.split()}
    assert (model.words.found(sorted(zz)) >= 0).all()
    for x, words in of.items():  # of frequent and rare words, and words that were never seen
        assert {model.predict(" ".join(words[i : i + 5]))[0] for i in range(0, 300, 5)} == {x}
    unnamed = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert language.fit(unnamed, F.lit(True), max_docs=100).predict(" ".join(of["zz"][:5]))[0] == "zz"
    few = language.fit(docs.where("lang <> 'un'"), F.lit(True), max_docs=2)  # languages beyond the rows to use
    assert few.langs == ["aa", "bb"]
