"""A corpus from raw documents to packed sequences, one operator a stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treetally.llm import language, line_dedup, packing, pii, simhash
from treetally.llm.common import made, new_path, temporary


#: The columns of documents, which stages work on.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _renamed(docs: DataFrame) -> DataFrame:
    """docs with further columns under names that no operator uses."""
    return docs.toDF(*[c if c in COLUMNS else f"_extra_{i}" for i, c in enumerate(docs.columns)])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a letter; lang is what was found. Where no language could be
    learned, lang stays as it was.

    Null and empty texts go, as they have no letter; rows with a null or repeated id are
    judged by their text alone. Of equally likely languages the first by name is taken."""
    rows = _renamed(docs)
    model = language.fit(rows, ~language.held_out("doc_id", 5, 0))
    if not model.langs:
        return language.lettered(docs)
    found = language.identify(rows, model)  # only texts without a letter have score 0
    return found.where("score > 0").withColumn("lang", F.col("lang_pred")).select(*rows.columns).toDF(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document has; n_chars is the new length.

    Every row stays. A null text becomes an empty one. The smallest id keeps a line; rows that
    share an id are one document, and rows without an id follow all others, each by itself."""
    rows = _renamed(docs)
    kept = line_dedup.dedup_lines(rows)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*rows.columns).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, null ids last,
    and of equal ids the one with the smallest text hash.

    Null and empty texts are copies of one another. Rows that share an id, or have none, stay
    or go each by its own text; of rows equal in both one stays."""
    return simhash.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars is the new length.

    Every row stays, whatever its id. Null texts stay null (with null n_chars), empty ones
    empty. Of overlapping spans the first names the whole."""
    rows = _renamed(docs)
    return pii.redact(rows).withColumn("n_chars", F.length("text").cast("long")).toDF(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in a training sequence.

    A null or empty text has one place, its end; rows that are equal in id and text are
    copies 1, 2 ...; a text of over the largest size has several pieces."""
    return packing.pack_documents(docs.select("doc_id", "text"))


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("PII", redact_personal_data),
    ("best-fit packing", pack_sequences),
]

#: Trained models and fingerprints have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. Each stage's table and what it wrote on its way are dropped once the next one's
    table is written; those of the last stage, whose result is lazy, stay. Extra columns of
    documents, whatever their names, pass through all stages but the last."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, "stage")
        with temporary(spark):
            if before:
                made("path", before)
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs, before = spark.read.schema(out.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
