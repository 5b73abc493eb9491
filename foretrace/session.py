"""Session settings, the package for Python workers, and reliable lineage cuts."""

from __future__ import annotations

import os
import uuid
import zipfile

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession


def build_session(
    app: str = "foretrace", master: str | None = None, partitions: int | None = None, checkpoint: str | None = None
) -> SparkSession:
    """A session with UTC time and adaptive execution.

    ``checkpoint`` is the folder for intermediate tables where the settings name none; on a cluster name a shared one in
    ``spark.checkpoint.dir``.

    On a cluster leave ``master`` and ``partitions`` unset, so that spark-submit decides; adaptive execution
    then coalesces or splits shuffle partitions from their measured sizes.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master).config("spark.driver.memory", os.environ.get("FORETRACE_DRIVER_MEMORY", "8g"))
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    spark = builder.getOrCreate()
    if checkpoint and not named_checkpoint_dir(spark) and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(checkpoint)
    return ship_package(spark)


def ship_package(spark: SparkSession) -> SparkSession:
    """Give this package to the session's Python workers, once for each application.

    The driver's own import path does not reach the workers. The archive lies in the folder that Spark keeps for the
    application's files, on the driver, and is served from there; no data goes that way.
    """
    context = spark.sparkContext
    if getattr(context, "_foretrace_shipped", False):
        return spark
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(SparkFiles.getRootDirectory(), f"foretrace-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    context._foretrace_shipped = True
    return spark


def named_checkpoint_dir(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The application's own folder below the one that the session names for intermediate tables; no other is made up."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = named_checkpoint_dir(spark)
        if not named:
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def clean_up(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results that still read them must be written before."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        path = spark._jvm.org.apache.hadoop.fs.Path(current)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in files.listStatus(path):
            files.delete(status.getPath(), True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table beside the session's checkpoints, and go on from the written rows.

    Readers of the table take only the columns they need, and a lost executor costs a read instead of a computation.
    ``clean_up`` deletes the application's tables when their results are written.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the table that ``cut_lineage`` returned; nothing may read it any more."""
    spark = df.sparkSession
    for path in {spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(file)).getParent() for file in df.inputFiles()}:
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
