"""Language ID by words first, then character n-grams.

A known word adds its log frequency in each language. A word that was never seen backs off
to its character n-grams: the longest n with any known n-gram decides, by their mean.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.skew import SPLIT, lookup
from .common import written

LONGEST = 5
LETTERS = regex.compile(r"\p{L}+")
#: Python's classes agree on these texts, and are faster.
PLAIN = re.compile(r"[a-zß-öø-ÿ]+")
PLAIN_TEXT = re.compile(r"[\x00-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-\xff]*")
UNDECIDED = "und"
#: Backed-off scores (of a word in a language) that a task makes at a time, and remembers, about.
ROOM = 1 << 20
#: Bytes of a (token, language) pair in a broadcast model, and how many bytes may be broadcast: each
#: Python worker of an executor holds a copy. A larger model is joined to the texts' tokens.
BYTES_A_PAIR, MAX_BROADCAST = 28, 64 << 20
HASH = xxhash.xxh64_intdigest


def words_of(text: str) -> list[str]:
    """Runs of letters (Unicode category L), lower-cased."""
    low = text.lower()
    return PLAIN.findall(low) if PLAIN_TEXT.fullmatch(low) else LETTERS.findall(low)


def grams_of(word: str, n: int) -> list[str]:
    word = f"^{word}$"
    return [word[i : i + n] for i in range(len(word) - n + 1)]


@dataclass
class Weights:
    """What tokens add in each language over a token that the language lacks, sparse: token hashes
    ascending, for each a run of (language, value). base: what a lacking token adds."""

    base: np.ndarray
    keys: np.ndarray
    starts: np.ndarray
    langs: np.ndarray
    values: np.ndarray

    def found(self, tokens: list[str]) -> np.ndarray:
        """The place of each token; -1: none."""
        if not len(self.keys):
            return np.full(len(tokens), -1)
        h = np.fromiter((HASH(t.encode(), 42) for t in tokens), np.uint64, len(tokens)).view(np.int64)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, at, -1)

    def summed(self, at: np.ndarray, times: np.ndarray, row: np.ndarray | None = None, rows: int = 1) -> np.ndarray:
        """(rows, languages): the sum of what the tokens at these places add, each so many times."""
        row = np.zeros(len(at), np.int64) if row is None else row
        n = self.starts[at + 1] - self.starts[at]
        flat = np.arange(n.sum()) + np.repeat(self.starts[at] - np.cumsum(n) + n, n)
        size = len(self.base)
        out = np.bincount(np.repeat(row, n) * size + self.langs[flat], self.values[flat] * np.repeat(times, n), rows * size)
        return out.reshape(rows, size) + np.bincount(row, times, rows)[:, None] * self.base


@dataclass
class LanguageModel:
    """Of all languages, words and n-grams of the rows it was fitted on. Its token tables have a
    row (token, lang, n) for each language that has the token, as does its broadcast form,
    which takes about BYTES_A_PAIR a row."""

    langs: list[str]
    prior: np.ndarray
    tables: dict[str, DataFrame] = field(default_factory=dict)
    pairs: int = 0
    words: Weights | None = None
    grams: Weights | None = None
    memory: dict = field(default_factory=dict)

    def backed_off(self, words: list[str]) -> np.ndarray:
        """(words, languages): the mean of the longest n-grams of which any is known."""
        out, left = np.zeros((len(words), len(self.langs))), np.arange(len(words))
        for n in range(LONGEST, 0, -1):
            each = [grams_of(words[i], n) for i in left.tolist()]
            at = self.grams.found([g for x in each for g in x])
            row = np.repeat(np.arange(len(each)), [len(x) for x in each])[at >= 0]
            n_found = np.bincount(row, minlength=len(each))
            some = np.flatnonzero(n_found)
            if len(some):
                out[left[some]] = (self.grams.summed(at[at >= 0], 1.0 / n_found[row], row, len(each)))[some]
            left = left[n_found == 0]
            if not len(left):
                break
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = Counter(words_of(text or ""))
        if not counts or not self.langs:
            return UNDECIDED, 0.0
        words, times = list(counts), np.fromiter(counts.values(), float, len(counts))
        at = self.words.found(words)
        z = self.prior + self.words.summed(at[at >= 0], times[at >= 0])[0]
        unknown = np.flatnonzero(at < 0).tolist()
        if unknown:
            memory, together = self.memory, ROOM // max(8, len(self.langs)) + 1
            for a in range(0, len(unknown), together):
                part = unknown[a : a + together]
                if len(memory) > together:
                    memory.clear()
                new = [words[i] for i in part if words[i] not in memory]
                memory.update(zip(new, self.backed_off(new)))
                for i in part:
                    z = z + times[i] * memory[words[i]]
        return self.decided(z)

    def decided(self, z: np.ndarray) -> tuple[str, float]:
        best = int(np.argmax(z))  # ties: the first by name
        return self.langs[best], float(1 / np.exp(z - z[best]).sum())


def shares(counts: dict[str, int], total: int) -> dict[str, int]:
    """At most total in all, dealt evenly: what one cannot use goes to the others."""
    out, left = {}, total
    for i, x in enumerate(sorted(counts, key=lambda x: (counts[x], x))):
        out[x] = min(counts[x], left // (len(counts) - i))
        left -= out[x]
    return out


def _sampled(rows: DataFrame, of: dict[str, int], max_docs: int) -> DataFrame:
    """Rows of (lang, hash, ...): of each language in `of` (rows of each) its share of max_docs,
    those with the smallest hash, and at least one hash's rows."""
    spark, share = rows.sparkSession, shares(of, max_docs)
    # About as many rows as wanted lie below this; what lies there is counted exactly.
    wanted = {x: (share[x] + 6 * share[x] ** 0.5 + 20) / of[x] for x in of}
    bound = [(x, min((1 << 63) - 1, int(w * 2.0**64) - (1 << 63))) for x, w in wanted.items()]
    low = rows.join(F.broadcast(spark.createDataFrame(bound, "lang string, bound long")), "lang")  # a row a language
    near = low.where("hash <= bound").groupBy("lang", "hash").count().collect()  # about max_docs rows
    found: dict[str, list] = {x: [] for x in of}
    for r in near:
        found[r["lang"]].append((r["hash"], r["count"]))
    if any(not found[x] for x in of):  # a few texts only, all of high hash
        for r in rows.where(F.col("lang").isin([x for x in of if not found[x]])).groupBy("lang").agg(F.min("hash").alias("hash")).collect():
            found[r["lang"]].append((r["hash"], 1))
    cuts = []
    for x, hashes in found.items():
        seen, cut = 0, None
        for h, n in sorted(hashes):
            if cut is not None and seen + n > share[x]:
                break
            seen, cut = seen + n, h
        cuts.append((x, cut))
    return rows.join(F.broadcast(spark.createDataFrame(cuts, "lang string, cut long")), "lang").where("hash <= cut")


def fit(docs: DataFrame, trainable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = 20_000, max_broadcast: int = MAX_BROADCAST) -> LanguageModel:
    """Learns from rows of docs where trainable holds and lang isn't null.

    max_docs bounds the labelled rows that are used, dealt evenly to the languages (and so the
    languages: the most frequent, where there are more than rows to use). All words and
    n-grams of these rows are kept. Languages without a word in the rows used are not
    learned. No words: a model without languages. A model of over max_broadcast bytes stays
    in tables."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).alias("lang")).where(trainable & F.col("lang").isNotNull()).withColumn("hash", F.xxhash64("doc_id", "text"))
    of = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_docs).collect()}
    if not of:
        return LanguageModel([], np.zeros(0))
    rows = _sampled(rows, of, max_docs)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Counted per batch already: what is shuffled is (token, language, count).
        for b in batches:
            found: dict[str, Counter] = {}
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found.setdefault(lang, Counter()).update(words_of(text))
            yield _listed((w, x, n) for x, c in found.items() for w, n in c.items())

    counted = rows.select("text", "lang").mapInArrow(tokens, TOKENS).groupBy("token", "lang").agg(F.sum("n").alias("n"))
    counted = written(counted, "tokens")  # texts are read once; words and n-grams come from the counts

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[str, Counter] = {}
            for w, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c = found.setdefault(lang, Counter())
                for n in range(1, LONGEST + 1):
                    c.update(grams_of(w, n))  # types, not tokens: frequent words are scored as words
            yield _listed((g, x, n) for x, c in found.items() for g, n in c.items())

    pieces = counted.select("token", "lang").mapInArrow(grams, TOKENS).groupBy("token", "lang").agg(F.sum("n").alias("n"))
    tables = {"words": counted, "grams": written(pieces, "pieces")}
    totals = {k: {r["lang"]: (r["n"], r["pairs"]) for r in t.groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("pairs")).collect()} for k, t in tables.items()}
    langs = sorted(totals["words"])
    if not langs:
        return LanguageModel([], np.zeros(0))
    prior = np.log([of[x] / sum(of[y] for y in langs) for x in langs])
    model = LanguageModel(langs, prior, tables, sum(n for t in totals.values() for _, n in t.values()))
    for k, t in tables.items():
        total = np.array([totals[k][x][0] for x in langs], float)
        added = 0.5 * total / total.max()  # a token that a language lacks weighs about the same in all
        base = np.log(added / (total + added * (t.select("token").distinct().count() + 1)))
        small = model.pairs * BYTES_A_PAIR <= max_broadcast
        setattr(model, k, _weights(t, langs, base, added) if small else Weights(base, *[np.zeros(0)] * 4))
        by = F.broadcast(t.sparkSession.createDataFrame([(x, i, float(y)) for i, (x, y) in enumerate(zip(langs, added))], "lang string, i int, added double"))  # a row a language
        tables[k] = t.join(by, "lang").select("token", "i", F.log1p(F.col("n") / F.col("added")).alias("v"))
    return model


TOKENS = "token string, lang string, n long"


def _listed(rows: Iterable[tuple[str, str, int]]) -> pa.RecordBatch:
    token, lang, n = zip(*rows) if (rows := list(rows)) else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(token, pa.string()), pa.array(lang, pa.string()), pa.array(n, pa.int64())], ["token", "lang", "n"])


def _weights(counted: DataFrame, langs: list[str], base: np.ndarray, added: np.ndarray) -> Weights:
    rows = counted.select(F.xxhash64("token").alias("key"), "lang", "n").toArrow()
    lang = pc.index_in(rows.column("lang"), value_set=pa.array(langs)).to_numpy()
    key, n = rows.column("key").to_numpy(), rows.column("n").to_numpy()
    order = np.lexsort((lang, key))
    keys, starts = np.unique(key[order], return_index=True)
    return Weights(base, keys, np.append(starts, len(key)), lang[order].astype(np.int32), np.log1p(n[order] / added[lang[order]]))


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: list[str] | None = None, max_broadcast: int = MAX_BROADCAST, split: int = SPLIT) -> DataFrame:
    """docs (or its columns `keep`) with lang_pred and score, the posterior of lang_pred.

    A text that is null or has no letter is `und` with score 0, as is any text if the model
    has no languages. Whole texts count. Ties go to the first language by name. Repeated rows
    are judged alike. Columns named lang_pred or score are replaced. A model of over
    max_broadcast bytes is joined to the tokens of the texts, with the same result; a token that
    over `split` texts have is dealt to many tasks."""
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    if model.pairs * BYTES_A_PAIR > max_broadcast:
        return _joined(docs, model, text_col, names, split)
    rows = docs.select(*names, F.col(text_col).cast("string")).toDF(*[f"c{i}" for i in range(len(names) + 1)])
    shared = docs.sparkSession.sparkContext.broadcast(LanguageModel(model.langs, model.prior, words=model.words, grams=model.grams))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            found = [m.predict(t.as_py()) for t in b.column(len(names))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], [*names, "lang_pred", "score"])

    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return rows.mapInArrow(run, T.StructType([*docs.select(*names).schema.fields, *added]))


def _joined(docs: DataFrame, model: LanguageModel, text_col: str, names: list[str], split: int) -> DataFrame:
    """identify by joins: (row, token, n) with the words; what is in no word, with its n-grams."""
    docs = docs.select(*names, F.col(text_col).cast("string").alias("_text")).toDF(*[f"c{i}" for i in range(len(names))], "_text")
    docs = written(docs.withColumn("_row", F.monotonically_increasing_id()), "texts")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c = Counter(words_of(text or ""))
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(c), pa.int64()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["_row", "token", "n"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [(w, n, g) for w in b.column(0).to_pylist() for n in range(1, LONGEST + 1) for g in grams_of(w, n)]
            word, size, gram = zip(*each) if each else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(size, pa.int32()), pa.array(gram, pa.string())], ["word", "size", "token"])

    listed = {k: t.groupBy("token").agg(F.collect_list(F.struct("i", "v")).alias("adds")) for k, t in model.tables.items()}  # at most a struct a language
    each = written(docs.select("_row", "_text").mapInArrow(tokens, "_row long, token string, n long"), "texts_tokens")
    found = written(lookup(each, listed["words"], "token", F.col("_row"), split=split), "found")
    grams = found.where("adds is null").select("token").distinct().mapInArrow(pieces, "word string, size int, token string")
    grams = written(grams.groupBy("word", "size", "token").agg(F.count("*").alias("times")).join(listed["grams"], "token"), "grams")
    longest = grams.groupBy("word", "size").agg(F.sum("times").alias("all")).groupBy("word").agg(F.max_by("all", "size").alias("all"), F.max("size").alias("size"))
    each = grams.join(longest, ["word", "size"]).select("word", "all", "times", F.explode("adds").alias("a"))
    unknown = each.groupBy("word", F.col("a.i").alias("i")).agg(F.sum(F.col("a.v") * F.col("times") / F.col("all")).alias("v"))
    unknown = unknown.groupBy(F.col("word").alias("token")).agg(F.collect_list(F.struct("i", "v")).alias("adds"))
    kinds = found.where("adds is not null").withColumn("word", F.lit(1)).unionByName(lookup(found.where("adds is null").drop("adds"), unknown, "token", F.col("_row"), how="inner", split=split).withColumn("word", F.lit(0)))
    sums = kinds.select("_row", F.explode("adds").alias("a"), "n").groupBy("_row", F.col("a.i").alias("i")).agg(F.sum(F.col("a.v") * F.col("n")).alias("s"))
    sums = sums.groupBy("_row").agg(F.collect_list("i").alias("i"), F.collect_list("s").alias("s"))
    counts = kinds.groupBy("_row").agg(F.sum(F.col("n") * F.col("word")).alias("words"), F.sum(F.col("n") * (1 - F.col("word"))).alias("grams"))
    some = found.select("_row").distinct()
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.prior, model.words.base, model.grams.base))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prior, of_word, of_gram = shared.value
        judge = LanguageModel(langs, prior)
        for b in batches:
            out = []
            for i, s, words, grams in zip(*(b.column(c).to_pylist() for c in range(1, 5))):
                z = prior + (words or 0) * of_word + (grams or 0) * of_gram
                z[np.array(i or [], np.int64)] += np.array(s or [], float)
                out.append(judge.decided(z))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], ["_row", "lang_pred", "score"])

    judged = some.join(sums, "_row", "left").join(counts, "_row", "left").select("_row", "i", "s", "words", "grams").mapInArrow(decide, "_row long, lang_pred string, score double")
    rows = docs.drop("_text").join(judged, "_row", "left").withColumns({"lang_pred": F.coalesce("lang_pred", F.lit(UNDECIDED)), "score": F.coalesce("score", F.lit(0.0))})
    return rows.drop("_row").toDF(*names, "lang_pred", "score")


def lettered(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text has a letter, as words_of sees it."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text_col)
        for b in batches:
            yield b.filter(pa.array([bool(words_of(t.as_py() or "")) for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str, folds: int, rest: int) -> Column:
    """Whether a row belongs to the held-out fold; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == rest, F.lit(False))
