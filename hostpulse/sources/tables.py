"""The engine's tables as Parquet folders."""

from __future__ import annotations

import re
import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostpulse import schemas as S
from hostpulse.operators.maintain import prune_history
from hostpulse.session import shared_dir


def folder_uri(spark: SparkSession, path: str) -> str:
    """A folder with the scheme that the cluster's file system gives it, so that Spark and Python workers mean the same one."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return re.sub("^file:/+", "file:///", files.makeQualified(folder).toString())


def stages_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/hostpulse-stages/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a stage to a table in the cluster's shared checkpoint folder and read it back.

    Cuts the lineage at a table boundary: later stages read only the columns they need, and a lost
    executor costs a re-read instead of a recomputation of everything before.  ``drop_stages``
    removes the stages of this application.
    """
    spark = df.sparkSession
    path = f"{stages_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stages(spark: SparkSession) -> None:
    """Remove the stage tables this application wrote, once no DataFrame needs them."""
    delete_folder(spark, stages_folder(spark))


def delete_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(folder, True)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a folder, sorted; empty when the folder does not exist."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    return sorted(entry.getPath().getName() for entry in files.listStatus(folder))


def by_day(dated: DataFrame) -> DataFrame:
    """Events gathered by date and sorted as the telemetry table keeps them."""
    return dated.hint("rebalance", "event_date").sortWithinPartitions("event_date", "host_id", "event_timestamp")


def append_telemetry(events: DataFrame, path: str, *, mode: str = "append") -> None:
    """Append accepted, new events, one folder per event date.

    Rows are gathered by date; adaptive execution cuts a large day into tasks of its advisory size and joins small
    ones, so the files follow the data.  They are sorted so that host and time predicates skip row groups.
    """
    dated = events.withColumn("event_date", F.to_date("event_timestamp"))
    columns = [f.name for f in S.TELEMETRY.fields if f.name in events.columns]
    by_day(dated.select(*columns, "event_date")).write.mode(mode).partitionBy("event_date").parquet(path)


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """The telemetry table; files older than a column read it as null."""
    schema = T.StructType(S.TELEMETRY.fields + [T.StructField("event_date", T.DateType())])
    return spark.read.schema(schema).parquet(path)


def append_deliveries(attempts: DataFrame, path: str, *, mode: str = "append") -> None:
    columns = [f.name for f in S.DELIVERIES.fields]
    dated = attempts.select(*columns).withColumn("event_date", F.to_date("attempted_at"))
    dated.write.mode(mode).partitionBy("event_date").parquet(path)


def read_deliveries(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType(S.DELIVERIES.fields + [T.StructField("event_date", T.DateType())])
    return spark.read.schema(schema).parquet(path)


def write_rejected(checked: DataFrame, path: str, *, mode: str = "append") -> None:
    """Keep permanently refused records aside with their reason, for inspection."""
    rejected = checked.where(F.col("reason").isNotNull())
    columns = [c for c in ("ingest_seq", "value", "received_at", "reason") if c in checked.columns]
    rejected.select(*columns).write.mode(mode).parquet(path)


def prune_table(
    spark: SparkSession,
    path: str,
    *,
    schema: T.StructType,
    time_col: str,
    now: datetime | Column,
    days: int = 30,
    versions: list[str] | None = None,
) -> int:
    """Retention on a table partitioned by ``event_date``, below ``version`` folders (all, or those named) or not; returns how many rows went.

    The boundary date's kept rows are written first and then replace their partitions; only after that do the
    partitions go that hold nothing to keep.  A run that breaks off leaves rows that should have gone, never loses
    rows that stay, and is put right by the next run.
    """
    if days <= 0:
        return 0
    below = [name for name in subfolders(spark, path) if name.startswith("version=")]
    if versions is not None:
        below = [name for name in below if name.removeprefix("version=") in set(versions)]
    layout = ["version", "event_date"] if below else ["event_date"]
    kinds = {"version": T.StringType(), "event_date": T.DateType()}
    parts = [T.StructField(name, kinds[name]) for name in layout]
    folders = [f"{path}/{name}" for name in below] or [path]
    table = spark.read.schema(T.StructType(schema.fields + parts)).option("basePath", path).parquet(*folders)
    at = now if isinstance(now, Column) else F.lit(now)
    boundary = F.to_date(at - F.expr(f"INTERVAL '{days}' DAY"))
    kept, removed = prune_history(table, time_col=time_col, now=now, days=days)
    count = removed.first()["removed"]
    if count == 0:
        return 0
    rewrite = materialize(kept.where(F.col("event_date") == boundary), "retention")
    full = {tuple(row) for row in rewrite.select(*layout).distinct().collect()}
    dated = {tuple(row) for row in table.where(F.col("event_date") <= boundary).select(*layout).distinct().collect()}
    if full:
        rewrite.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*layout).parquet(path)
    for values in sorted(dated - full):
        delete_folder(spark, "/".join([path, *(f"{k}={v}" for k, v in zip(layout, values))]))
    return count
