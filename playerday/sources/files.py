"""Reading the source tables, writing results, and work tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playerday.sources.schemas import PLAYER_DAY, SOURCES

CORRUPT = "_corrupt_record"


def typed(df: DataFrame, schema: str) -> DataFrame:
    """df with the schema's columns in its order and types; a value that does not cast fails the job."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema)])


def load_sources(spark: SparkSession, path: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """The eight source tables under path, each <name> (a Parquet dataset) or <name>.csv with a header.

    Text sheets are read strictly: a row that does not fit the schema fails the
    job; load_text_sources sets such rows aside.
    """
    if fmt == "csv":
        tables, rejected = load_text_sources(spark, path)
        bad = {r["table"]: r["rows"] for r in rejected.groupBy("table").agg(F.count("*").alias("rows")).collect()}
        if bad:
            raise ValueError(f"rows that do not fit their schema: {bad}")
        return tables
    return {name: typed(spark.read.format(fmt).load(f"{path}/{name}"), schema) for name, schema in SOURCES.items()}


def read_sheet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A text sheet with a header, in the schema's types, and the text of each row that does not fit in CORRUPT.

    Columns are found by their names in the header, in any order; columns that
    the schema does not name are left out, a missing one raises an error.
    """
    wanted = T.StructType.fromDDL(schema)
    header = spark.read.csv(path, header=True).columns  # the first line only
    if missing := [f.name for f in wanted if f.name not in header]:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    kinds = {f.name: f.dataType for f in wanted}
    full = T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in header] + [T.StructField(CORRUPT, T.StringType())])
    reader = spark.read.schema(full).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("dateFormat", "yyyy-MM-dd")
    # without column pruning in the parser a row is judged whole, whatever a query asks for
    return reader.option("columnPruning", False).csv(path).select(*[f.name for f in wanted], CORRUPT)


def load_text_sources(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """(the eight tables from <name>.csv without the rows that do not fit, and those rows as (table, row)).

    A sheet is parsed once and kept as a work table, from which both are read.
    """
    tables, rejected = {}, None
    for name, schema in SOURCES.items():
        sheet = written(read_sheet(spark, f"{path}/{name}.csv", schema), name)
        tables[name] = sheet.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
        bad = sheet.where(F.col(CORRUPT).isNotNull()).select(F.lit(name).alias("table"), F.col(CORRUPT).alias("row"))
        rejected = bad if rejected is None else rejected.union(bad)
    return tables, rejected


def _months_only(writer):
    """A partitioned write that replaces the partitions it has rows for and leaves the others' files."""
    return writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")


def write_player_day(player_day: DataFrame, path: str, fmt: str = "parquet") -> None:
    """The 22 columns in their fixed order: Parquet by month, or CSV sorted by date and player.

    A Parquet write replaces the months that player_day has, so a rerun of one
    month leaves the rest as it is.
    """
    rows = player_day.select(*PLAYER_DAY)
    if fmt == "csv":
        rows.orderBy("ActivityDate", "UserID").write.mode("overwrite").csv(path, header=True)
    else:
        _months_only(rows.withColumn("Month", F.trunc("ActivityDate", "month")).write).partitionBy("Month").parquet(path)


def read_player_day(spark: SparkSession, path: str, fmt: str = "parquet", months: list | None = None) -> DataFrame:
    """A written player-day table; months (first days) reads the folders of those alone."""
    if fmt == "csv":
        return spark.read.csv(path, header=True)
    days = spark.read.parquet(path)
    return (days if months is None else days.where(F.col("Month").isin(months))).drop("Month")


def write_monthly(monthly: DataFrame, path: str, fmt: str = "csv") -> None:
    """The month by game type table: CSV whole, in order of month, or Parquet by month, of which a rerun replaces its own."""
    if fmt == "csv":
        monthly.orderBy("MonthDate", "GameType").write.mode("overwrite").csv(path, header=True)
    else:
        _months_only(monthly.withColumn("Month", F.col("MonthDate")).repartition("Month").sortWithinPartitions("GameType").write).partitionBy("Month").format(fmt).save(path)


def read_monthly(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("Month").orderBy("MonthDate", "GameType")


def write_tables(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """One dataset per result table."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(fmt).option("header", True).save(f"{path}/{name}")


def export_review_csv(review: DataFrame, path: str) -> None:
    """The review table with its dates as yyyy-MM-dd."""
    review.withColumn("Activity Date", F.date_format("Activity Date", "yyyy-MM-dd")).write.mode("overwrite").csv(path, header=True)


_local: str | None = None
#: Path -> name of the catalogue entry, if it has one, of the work tables that are still there.
_work: dict[str, str | None] = {}


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder spark.checkpoint.dir.

    Where the folder is unset, a temporary one serves a local master; on a cluster that is an error.
    """
    global _local
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if _local is None:
            folder = tempfile.mkdtemp(prefix="spark-playerday-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            _local = "file://" + folder
        root = _local
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back, for frames that several results use."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    _work[path] = None
    return spark.read.schema(df.schema).parquet(path)


def laid_out(df: DataFrame, name: str, key: str = "UserID", order: str = "ActivityDate") -> DataFrame:
    """df written as a table bucketed by key: what groups, windows or joins by key on it needs no exchange of its rows.

    A df that is partitioned by key already is written without another one.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    entry = f"playerday_{path[-32:]}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).sortBy(key, order).option("path", path).saveAsTable(entry)
    _work[path] = entry
    return spark.table(entry)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Remove work tables that nothing reads any more."""
    for path in paths:
        if entry := _work.pop(path, None):
            spark.sql(f"DROP TABLE IF EXISTS {entry}")
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class work_tables:
    """Within the block all work tables are noted; at its end they are removed, so results have to be written by then."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> work_tables:
        self.before = set(_work)
        return self

    def keep(self) -> None:
        """Leave the tables made so far in place."""
        self.before = set(_work)

    def __exit__(self, *_) -> None:
        discard(self.spark, [p for p in list(_work) if p not in self.before])


def fingerprint(spark: SparkSession, paths: list[str]) -> tuple:
    """Names, sizes and times of the files under paths, which change when a table is replaced."""
    found = []
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True)
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))
