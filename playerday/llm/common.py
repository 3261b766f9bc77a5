"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only separator of words in every operator here.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read through Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset a temporary folder is taken, which is right only for a
    local master; on a cluster an unset folder is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _local
    if _local is None:
        _local = "file://" + tempfile.mkdtemp(prefix="spark-playerday-")
    return _local


_local: str | None = None


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back.

    It cuts the lineage (a lost executor costs no recomputation) and keeps a
    costly column from being computed by every later use.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.work_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove the table of a materialised df that nothing reads any more."""
    session = df.sparkSession
    path = session._jvm.org.apache.hadoop.fs.Path(df.work_path)
    path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out. A null id counts as fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5, F.lit(0))


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row, also inside nested lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
