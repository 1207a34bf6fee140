"""The folder that all executors share, and tables in it."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Folders and tables made in the open scope of temporary(), if any.
_made: contextvars.ContextVar[list[tuple[str, str]] | None] = contextvars.ContextVar("made", default=None)


def work_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where that is unset a local master gets a folder of its
    own (tests); a cluster has to name one that all executors see."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="treetally-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    made("path", path)
    return path


def made(kind: str, name: str) -> None:
    """Says that a path or a table (kind) is for the open scope to drop."""
    if (scope := _made.get()) is not None:
        scope.append((kind, name))


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _file_system(spark, path)
    return fs.exists(place)


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """A scope that drops every table written in it when it ends. What is to outlive it must have
    been written elsewhere by then: results that are still lazy read what is dropped."""
    own: list[tuple[str, str]] = []
    token = _made.set(own)
    try:
        yield
    finally:
        _made.reset(token)
        for kind, name in own:
            if kind == "table":
                spark.sql(f"DROP TABLE IF EXISTS {name}")
            else:
                fs, place = _file_system(spark, name)
                fs.delete(place, True)


def written(df: DataFrame, label: str, by: str | None = None, session: SparkSession | None = None) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives lost executors. by: a column
    of few values, by which its files are kept apart. session: that reads it, by default that of df."""
    session = session or df.sparkSession
    path = new_path(session, label)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return session.read.schema(df.schema).parquet(path)
