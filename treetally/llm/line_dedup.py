"""Line dedup over levelled sorted runs of line hashes.

A run is a table of (key, owner): the 128-bit hash of a line's key and the smallest id of a
document that holds it, bucketed and sorted by key. Each batch of documents, in id order,
merge-anti-joins the runs, and what is left becomes a new run of level 0. As soon as a
level has `fan_out` runs they are compacted into one run of the next level, so that a
batch meets at most (fan_out - 1) runs a level.

A line whose (key, document) is in no run is a repeat: an earlier document owns the key.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, ascii_lower, exists, made, new_path, renamed, temporary, written

MIN_KEY = 10
#: Lines of a batch that one bucket of a run holds, about; and how many buckets Spark allows.
BUCKET_LINES, MAX_BUCKETS = 4_000_000, 100_000


class LineRuns:
    """The levels of sorted runs. Every run has `buckets` buckets, so that a merge join with
    one moves only the batch.

    Runs are for one call, or with stored() kept in a folder of the caller: save() writes
    which runs there are, and a later call goes on from there."""

    def __init__(self, spark: SparkSession, buckets: int, fan_out: int = 3, folder: str | None = None):
        self.spark, self.buckets, self.fan_out = spark, buckets, fan_out
        self.folder, self.kept, self.version = folder or new_path(spark, "runs"), folder is not None, 0
        self.levels: list[list[str]] = []
        self.stale: list[str] = []

    @classmethod
    def stored(cls, spark: SparkSession, folder: str, buckets: int = 64, fan_out: int = 3) -> LineRuns:
        """The runs that were saved last in folder; none yet: no runs, with buckets and fan_out as given."""
        if not exists(spark, f"{folder}/manifest"):
            return cls(spark, buckets, fan_out, folder)
        last = spark.read.text(f"{folder}/manifest").orderBy(F.desc("version")).first()
        state = json.loads(last["value"])
        runs = cls(spark, state["buckets"], state["fan_out"], folder)
        runs.levels, runs.version = state["levels"], last["version"]
        for name in runs.names():
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (key BINARY, owner BIGINT) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {runs.buckets} BUCKETS LOCATION '{folder}/{name}'")
        return runs

    def save(self) -> None:
        """Writes the manifest's next version; runs that were compacted away go after it."""
        self.version += 1
        state = json.dumps({"buckets": self.buckets, "fan_out": self.fan_out, "levels": self.levels})
        self.spark.createDataFrame([(state,)], "value string").coalesce(1).write.text(f"{self.folder}/manifest/version={self.version}")
        with temporary(self.spark):
            for name in self.stale:
                made("table", name)
                made("path", f"{self.folder}/{name}")
        self.stale = []

    def _write(self, df: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (df.repartition(self.buckets, "key").write.bucketBy(self.buckets, "key").sortBy("key")
         .option("path", f"{self.folder}/{name}").format("parquet").saveAsTable(name))
        if not self.kept:
            made("table", name)
        return name

    def names(self) -> list[str]:
        return [x for level in self.levels for x in level]

    def owners(self) -> DataFrame:
        """All runs as one table; a key is in one run only."""
        out = self.spark.createDataFrame([], "key binary, owner long")
        for name in self.names():
            out = out.unionByName(self.spark.table(name))
        return out

    def fresh(self, batch: DataFrame) -> DataFrame:
        """(key, owner) of the keys that no run has. batch: (key, owner) with documents that follow those of all runs."""
        fresh = batch.groupBy("key").agg(F.min("owner").alias("owner"))
        for name in self.names():
            fresh = fresh.join(self.spark.table(name).select("key").hint("merge"), "key", "left_anti")
        return fresh

    def add(self, batch: DataFrame) -> None:
        self._put(self._write(self.fresh(batch)), 0)

    def _put(self, name: str, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fan_out:
            merged = None
            for x in self.levels[level]:
                merged = self.spark.table(x) if merged is None else merged.unionByName(self.spark.table(x))
            whole = self._write(merged)
            self.stale += self.levels[level]
            self.levels[level] = []
            self._put(whole, level + 1)


def line_key(lowered_line: Column) -> Column:
    return F.btrim(lowered_line, F.lit(ASCII_SPACE))


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with _id and _row, which tells rows of one id apart by their text; the text travels once, in _text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns({"_text": text, "_id": F.col(id_col).cast("long"), "_row": F.xxhash64(text)}).drop(text_col)


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows without an id, each a document of its own: _id numbers them in the order of _row,
    which no row with an id has. Copies of one text spread over all tasks."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumns({"_row": F.xxhash64(F.lit("no id"), F.col("_text")), "_salt": F.rand(0)})
    rows = rows.repartitionByRange(parts, "_row", "_salt").sortWithinPartitions("_row", "_salt")
    return written(rows.withColumn("_id", F.monotonically_increasing_id()).drop("_salt"), "numbered")


def _batch_of(docs: DataFrame, batches: int) -> Column:
    """The batch of _id: ranges of ids with about as many documents each."""
    at = [i / batches for i in range(1, batches)]
    cuts = docs.agg(F.percentile_approx("_id", at, 1000).alias("at")).first()["at"] if at else []
    out = F.lit(0)
    for cut in sorted(set(cuts or [])):
        out = out + (F.col("_id") > F.lit(cut)).cast("int")
    return out


def buckets_for(spark: SparkSession, lines: int, batches: int) -> int:
    """As many buckets as shuffles have partitions, so that a batch is dealt as the runs are; a
    multiple of that where buckets would outgrow BUCKET_LINES."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(parts * max(1, math.ceil(lines / batches / BUCKET_LINES / parts)), MAX_BUCKETS))


def repeated_lines(docs: DataFrame, batches: int = 4, buckets: int | None = None, fan_out: int = 3, later: DataFrame | None = None, runs: LineRuns | None = None) -> DataFrame:
    """(_id, _row, dropped): for each row of docs that loses lines, their places, ascending; written.

    docs needs _text, _id and _row. buckets: of each run, by default by the number of lines.
    later: documents that follow all of docs and have _ids of their own kind. runs: of
    earlier documents, which go before all of docs; docs' lines are added to them. Without,
    runs and lines are dropped once the result is written."""
    spark = docs.sparkSession
    line = F.posexplode(F.split(ascii_lower(F.col("_text")), "\n", -1)).alias("pos", "line")
    texts = docs.select("_id", "_row", "_text").withColumn("batch", _batch_of(docs, batches))
    if later is not None:
        texts = texts.unionByName(later.select("_id", "_row", "_text", F.lit(batches).alias("batch")))
    path = new_path(spark, "repeats")
    with temporary(spark):
        lines = (texts.select("batch", "_id", "_row", line)
                 .select("batch", "_id", "_row", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= MIN_KEY)
                 .withColumn("key", F.unhex(F.md5("key"))))
        place = new_path(spark, "lines")
        lines.write.partitionBy("batch").parquet(place)  # a batch reads its own lines alone
        lines = spark.read.schema(lines.schema).parquet(place)
        runs = runs or LineRuns(spark, buckets or buckets_for(spark, lines.count(), batches), fan_out)
        for b in range(batches):
            runs.add(lines.where(F.col("batch") == b).select("key", F.col("_id").alias("owner")))
        # Joined by key and document: a key that very many documents hold spreads over all tasks.
        def repeats(some: DataFrame, owners: DataFrame) -> DataFrame:
            return some.select("_id", "_row", "pos", "key").join(owners.withColumnRenamed("owner", "_id"), ["key", "_id"], "left_anti")

        if later is None:
            out = repeats(lines, runs.owners())
        else:
            last = lines.where(F.col("batch") == batches)
            owners = written(runs.fresh(last.select("key", F.col("_id").alias("owner"))), "owners")
            out = repeats(lines.where(F.col("batch") < batches), runs.owners()).unionByName(repeats(last, owners))
        out = out.groupBy("_id", "_row").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))
        out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def _kept(lines: Column, dropped: Column) -> tuple[Column, Callable[[Column], Column]]:
    """One flag a line, and from flags the lines whose place isn't in dropped (ascending)."""
    flags = F.flatten(F.transform(dropped, lambda p, i: F.concat(
        F.array_repeat(F.lit(True), p - F.when(i == 0, F.lit(-1)).otherwise(F.get(dropped, i - 1)) - 1), F.array(F.lit(False)))))
    return flags, lambda flag: F.filter(lines, lambda _, i: F.coalesce(F.get(flag, i), F.lit(True)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 4, buckets: int | None = None, fan_out: int = 3, runs: LineRuns | None = None) -> DataFrame:
    """docs with the text of repeated lines taken out, and n_lines (before) and n_dropped.

    A line's key is the line without white space at its ends, A-Z lower-cased. A key of at
    least 10 characters that two documents hold stays only in the smallest id. Null and
    empty texts are one empty line, and the result's text is never null. Rows with a null id
    follow all others, each a document of its own, in the order of their texts' hash. Rows
    that share an id are one document: none takes lines from another, and each keeps its own
    row. Other columns stay as they are; n_lines and n_dropped, if there, are replaced.

    runs: lines of documents of earlier calls, which own theirs whatever their ids; this
    call's are added, but for those of rows without an id. Save them once the result is
    written: a call that failed is then made again from the runs that were saved."""
    docs = docs.drop("n_lines", "n_dropped")
    names = docs.columns
    docs, (id_col, text_col) = renamed(docs, id_col, text_col)
    keep = docs.columns
    rows, later = _identified(docs, id_col, text_col), None
    if not rows.where("_id is null").isEmpty():
        rows, later = rows.where("_id is not null"), _numbered(rows.where("_id is null"))
    dropped = repeated_lines(rows.select("_text", "_id", "_row"), batches, buckets, fan_out, later, runs)
    rows = (rows if later is None else rows.unionByName(later)).join(dropped, ["_id", "_row"], "left")
    flags, kept = _kept(F.col("_lines"), F.col("dropped"))
    rows = rows.withColumn("_lines", F.split("_text", "\n", -1)).withColumn("_flags", flags)
    text = F.when(F.col("dropped").isNull(), F.col("_text")).otherwise(F.array_join(kept(F.col("_flags")), "\n"))
    rows = rows.withColumn(text_col, text)
    return rows.select(*keep, F.size("_lines").cast("long").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped")).toDF(*names, "n_lines", "n_dropped")
