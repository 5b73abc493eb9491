"""Versioned writes: a new version beside the old ones, then a pointer; nothing that is being read is overwritten."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foretrace.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder beside the session's checkpoints, which all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


def hadoop_path(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    jpath, files = hadoop_path(spark, path)
    return files.exists(jpath)


def write_dataset(df: DataFrame, path: str, *, date: str = "game_date", files: int = 4, mode: str = "errorifexists") -> None:
    """The engineered table as parquet, partitioned by date, with at most ``files`` files for each date.

    Rows are dealt by date and by a hash of the row, so that a date with very many rows is no single task's work.
    """
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(files))
    df.repartition(F.col(date), salt).write.mode(mode).partitionBy(date).parquet(path)


def write_version(df: DataFrame, root: str, *, file_format: str = "parquet", version: int | None = None) -> int:
    """Write ``df`` as the next version below ``root`` and then point to it; returns the version."""
    spark = df.sparkSession
    number = version if version is not None else current_version(spark, root, default=0) + 1
    df.write.mode("overwrite").format(file_format).save(f"{root}/version={number}")
    spark.range(1).select(F.lit(number).alias("version")).coalesce(1).write.mode("overwrite").json(f"{root}/pointer/{number:012d}")
    return number


def current_version(spark: SparkSession, root: str, default: int | None = None) -> int:
    """The newest version whose pointer was written completely."""
    jpath, files = hadoop_path(spark, f"{root}/pointer")
    found = []
    if files.exists(jpath):
        for status in files.listStatus(jpath):
            done = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
            if files.exists(done):
                found.append(int(status.getPath().getName()))
    if found:
        return max(found)
    if default is None:
        raise FileNotFoundError(f"no version below {root}")
    return default


def read_version(spark: SparkSession, root: str, *, file_format: str = "parquet", version: int | None = None) -> DataFrame:
    number = version if version is not None else current_version(spark, root)
    return spark.read.format(file_format).load(f"{root}/version={number}")


def remove(spark: SparkSession, path: str) -> None:
    jpath, files = hadoop_path(spark, path)
    files.delete(jpath, True)


def drop_versions(spark: SparkSession, root: str, *, keep: Sequence[int]) -> None:
    """Delete the versions below ``root`` but for those to keep; pointers stay."""
    jpath, files = hadoop_path(spark, root)
    for status in files.listStatus(jpath):
        name = status.getPath().getName()
        if name.startswith("version=") and int(name.removeprefix("version=")) not in keep:
            files.delete(status.getPath(), True)


def write_board(df: DataFrame, root: str, *, order: Sequence[Column]) -> int:
    """A board as JSON lines in a fixed order, as a new version."""
    return write_version(df.orderBy(*order), root, file_format="json")


def write_baseline_once(df: DataFrame, root: str, *, date: str, day: str) -> bool:
    """Keep the first board of a day as its baseline: written only where no complete one exists."""
    path = f"{root}/{date}={day}"
    if exists(df.sparkSession, f"{path}/_SUCCESS"):
        return False
    df.where(F.col(date) == F.lit(day).cast("date")).drop(date).write.mode("overwrite").parquet(path)
    return True
