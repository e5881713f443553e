"""Intermediate tables in the folder that every executor shares.

The folder is the session's ``spark.checkpoint.dir``. Only a local session,
where driver and executors are one machine, may fall back to a folder of its
own. Tables are Parquet, so a lost executor never takes one with it.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []
#: Rows of a few numbers that a task writes at least, if the table has so many.
FEW = 1 << 16


def root(spark: SparkSession) -> str:
    """The shared folder of this application."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="phasewise-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


def token() -> str:
    return uuid.uuid4().hex[:12]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{root(spark)}/{name}-{token()}"
    _made.append(path)
    return path


def keep(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back: its lineage ends there."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def narrow(df: DataFrame, most: int) -> DataFrame:
    """`df`, at most `most` rows of a few numbers behind a shuffle, in one partition for each FEW rows, or fewer.

    A small table else becomes a file for every shuffle partition, and each
    file costs a task, its commit and, where Hadoop has no native library and
    the folder is local, processes forked from the executor for permissions.
    """
    return df.coalesce(max(1, -(-most // FEW)))


def drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    if path in _made:
        _made.remove(path)


def forget(df: DataFrame) -> None:
    """Delete a table made by keep() that no plan reads any more."""
    drop(df.sparkSession, df.kept_at)


def clear(spark: SparkSession) -> None:
    """Delete all tables of this process; only for a caller whose results are written."""
    for path in list(_made):
        drop(spark, path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished queries.

    It does so when the driver's garbage has been collected, which may be long
    after; asked for between large steps, the disk holds one step's files only.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
