"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of a table that may be broadcast; beyond either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16_000_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, read from spark.checkpoint.dir; one of our own where all is one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not path:
        path = sc.getCheckpointDir()
        if not path:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
            sc.setCheckpointDir(path)
        return path
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def saved(df: DataFrame) -> DataFrame:
    """Cuts lineage with a Parquet table in the shared folder, which is smaller than a checkpoint and has true sizes.

    A lost executor costs nothing that was saved.  Tables stay until clear_saved(), as results may still read them.
    """
    path = f"{_tables(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SCOPES: list[str] = []


def _tables(spark: SparkSession) -> str:
    return "/".join([f"{shared_dir(spark)}/riskloom-{spark.sparkContext.applicationId}", *_SCOPES])


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables saved within at its end; nothing that reads them may be used after it."""
    _SCOPES.append(uuid.uuid4().hex)
    try:
        yield
        clear_saved(spark)
    finally:
        _SCOPES.pop()


def exists(spark: SparkSession, path: str) -> bool:
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(file)


def clear_saved(spark: SparkSession) -> None:
    """Deletes this application's saved tables; call it when no result that depends on them is read any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_tables(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def _bytes(value: Column, kind: T.DataType) -> Column:
    """About the bytes of a value, from below for nulls only."""
    if isinstance(kind, T.ArrayType):
        return F.aggregate(value, F.lit(16).cast("long"), lambda n, x: n + _bytes(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return sum((F.coalesce(_bytes(value[f.name], f.dataType), F.lit(8)) for f in kind), F.lit(8).cast("long"))
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.octet_length(value).cast("long") + 8
    return F.lit(8).cast("long")


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """A saved table as the build side of a join: broadcast if its counted rows and bytes are few, else merge join."""
    width = sum((F.coalesce(_bytes(F.col(f.name), f.dataType), F.lit(8)) for f in df.schema), F.lit(0).cast("long"))
    n, total = df.limit(rows + 1).agg(F.count("*"), F.sum(width)).first()
    return F.broadcast(df) if n <= rows and (total or 0) <= most else df.hint("merge")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, LOWER)


def text_key(text: Column) -> list[Column]:
    """Two 64-bit hashes that stand for a text in joins (128 bits together)."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
