"""Streaming ingest, rollups, running history and settlement.

Each job reads a directory as a stream, keeps its offsets and state in a checkpoint folder, and writes what a batch
produced under the batch's number, so that a batch that is run again after a failure overwrites its own output.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from foretrace.functions.scalar import flag
from foretrace.operators.board import settle
from foretrace.sources import writers


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, *, glob: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream; the event time becomes a timestamp, as watermarks need one."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream = reader.parquet(folder)
    times = {f.name: F.col(f.name).cast("timestamp") for f in schema.fields if f.dataType == T.TimestampNTZType()}
    return stream.withColumns(times) if times else stream


def run_available(writer, checkpoint: str) -> list:
    """Process everything that is there, then stop; returns the progress of the batches that ran."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return list(query.recentProgress)


def write_batches(stream: DataFrame, root: str, *, mode: str) -> list:
    """Write each micro-batch to its own folder; returns the batches' progress."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    return run_available(stream.writeStream.outputMode(mode).foreachBatch(write), f"{root}/checkpoint")


def batch_numbers(spark: SparkSession, folder: str) -> list[int]:
    """The batches that were written completely, ascending."""
    path, files = writers.hadoop_path(spark, folder)
    if not files.exists(path):
        return []
    found = []
    for status in files.listStatus(path):
        name = status.getPath().getName()
        if name.startswith("batch=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found.append(int(name.removeprefix("batch=")))
    return sorted(found)


def streamed(spark: SparkSession, folder: str) -> DataFrame | None:
    """All rows that batches wrote, with their ``batch``: the folded ones from one table, the newer ones from their folders."""
    base = writers.current_version(spark, f"{folder}-folded", default=-1)
    newer = [n for n in batch_numbers(spark, folder) if n > base]
    parts = [writers.read_version(spark, f"{folder}-folded", version=base)] if base >= 0 else []
    if newer:
        parts.append(spark.read.option("basePath", folder).parquet(*[f"{folder}/batch={n}" for n in newer]))
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def compact(spark: SparkSession, folder: str, fold: Callable[[DataFrame], DataFrame], *, keep: int = 10) -> int | None:
    """Fold old batches into one table once more than ``keep`` are unfolded; the number of the last folded batch, or None.

    ``fold`` takes rows with their ``batch`` and returns fewer rows with the same columns; folding folded rows again must
    change nothing. The newest batch stays, as a stream may write it again. The table is a new version that a pointer
    names, so readers see the folders or the table, never half of each, and a run that broke off is simply run again.
    Folders and versions go one compaction after they were last named, when no reader that began before still needs them.
    """
    base = writers.current_version(spark, f"{folder}-folded", default=-1)
    numbers = batch_numbers(spark, folder)
    if len([n for n in numbers if n > base]) <= keep:
        return None
    last = numbers[-2]
    rows = streamed(spark, folder).where(F.col("batch") <= last)
    writers.write_version(fold(rows), f"{folder}-folded", version=last)
    for n in numbers:
        if n <= base:
            writers.remove(spark, f"{folder}/batch={n}")
    writers.drop_versions(spark, f"{folder}-folded", keep=[base, last])
    return last


def newest_by_key(keys: list[str]) -> Callable[[DataFrame], DataFrame]:
    """The row of the newest batch per key, as a fold."""
    newest = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return lambda rows: rows.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")


def latest_by_key(spark: SparkSession, root: str, keys: list[str]) -> DataFrame:
    """The row of the newest batch per key (for update mode)."""
    return newest_by_key(keys)(streamed(spark, f"{root}/out")).drop("batch")


def ingest(stream: DataFrame, root: str, *, time: str, keys: list[str], delay: str = "2 days") -> dict[str, int]:
    """Drop duplicate events that arrive within the delay and events later than it, and append the rest.

    Returns what this run read and dropped, as Spark's state operator counted it: input, duplicate and late rows.
    """
    unique = stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
    progress = write_batches(unique, root, mode="append")
    states = [state for batch in progress for state in batch["stateOperators"]]
    return {
        "input_rows": sum(batch["numInputRows"] for batch in progress),
        "duplicate_rows": sum(state["customMetrics"].get("numDroppedDuplicateRows", 0) for state in states),
        "late_rows": sum(state["numRowsDroppedByWatermark"] for state in states),
    }


def late_rows(stream: DataFrame, *, time: str, landed: Column, delay_days: int) -> DataFrame:
    """Rows that arrive more than the delay after their event time, per landing day."""
    late = F.datediff(landed, F.col(time)) > delay_days
    return stream.groupBy(landed.cast("date").alias("landed")).agg(F.sum(flag(late)).alias("late_rows"))


def tumbling(stream: DataFrame, *, time: str, keys: list[str], length: str, slide: str | None, delay: str, aggregates: dict[str, Column]) -> DataFrame:
    window = F.window(time, length, slide) if slide else F.window(time, length)
    grouped = stream.withWatermark(time, delay).groupBy(*keys, window.alias("w"))
    out = grouped.agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *aggregates)


def sessions(stream: DataFrame, *, time: str, keys: list[str], gap: str, delay: str, aggregates: dict[str, Column]) -> DataFrame:
    grouped = stream.withWatermark(time, delay).groupBy(*keys, F.session_window(time, gap).alias("w"))
    out = grouped.agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *aggregates)


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RunningTotals(StatefulProcessor):
    """Totals of an entity's closed days so far, before each of its new days, in one value state."""

    def __init__(self, entity: str, measures: list[str]):
        self.entity, self.measures = entity, measures

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", T.StructType([T.StructField(m, T.LongType()) for m in self.measures]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        totals = self.totals.get() or [0] * len(self.measures)
        days = pd.concat(list(rows)).sort_values("window_start")
        before = days[self.measures].cumsum().shift(1, fill_value=0) + list(totals)
        self.totals.update(tuple(int(t + s) for t, s in zip(totals, days[self.measures].sum())))
        out = pd.DataFrame({self.entity: key[0], "window_start": days["window_start"]})
        for m in self.measures:
            out[f"{m}_before"] = before[m].astype("int64")
        yield out

    def close(self) -> None:
        pass


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for the block; a dot in a name is written as two underscores."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def prefix(stream: DataFrame, root: str, *, time: str, entity: str, delay: str, aggregates: dict[str, Column]) -> None:
    """Write to-date totals per entity and closed day, in one stream with two stateful steps.

    The first aggregates closed days, with map-side combine; the second keeps the totals per entity in the RocksDB store,
    so state may exceed memory, and sees one row per entity and day however many events a hot entity has.
    """
    measures = list(aggregates)
    daily = tumbling(stream, time=time, keys=[entity], length="1 day", slide=None, delay=delay, aggregates=aggregates)
    daily = daily.select(entity, "window_start", *[F.col(m).cast("bigint").alias(m) for m in measures])
    kind = daily.schema[entity].dataType
    output = T.StructType(
        [T.StructField(entity, kind), T.StructField("window_start", T.TimestampType()), *[T.StructField(f"{m}_before", T.LongType()) for m in measures]]
    )
    totals = daily.groupBy(entity).transformWithStateInPandas(
        statefulProcessor=RunningTotals(entity, measures), outputStructType=output, outputMode="Append", timeMode="None"
    )
    with settings(stream.sparkSession, spark__sql__streaming__stateStore__providerClass=ROCKSDB):
        write_batches(totals, root, mode="append")


def settle_stream(outcomes: DataFrame, root: str, *, keys: tuple[str, str] = ("game_pk", "batter_id"), hit: str = "hit_hr") -> None:
    """Keep the outcome stream's best result per game and batter and batch, below ``root``.

    A batch writes what it has seen under its own number: a few narrow rows, combined map-side, and no part of the board.
    A batch that is run again overwrites just that. Results do not depend on how rows were dealt to batches, as the best
    result of all batches is taken when the board is read (``settled_board``).
    """

    def write(batch: DataFrame, number: int) -> None:
        best = batch.groupBy(*keys).agg(F.max(hit).alias(hit))
        best.write.mode("overwrite").parquet(f"{root}/outcomes/batch={number}")

    run_available(outcomes.writeStream.foreachBatch(write), f"{root}/checkpoint")


def best_outcomes(keys: tuple[str, str] = ("game_pk", "batter_id"), hit: str = "hit_hr") -> Callable[[DataFrame], DataFrame]:
    """The best result per game and batter, as a fold for ``compact``."""
    return lambda rows: rows.groupBy(*keys).agg(F.max(hit).alias(hit), F.max("batch").alias("batch"))


def settled_board(picks: DataFrame, root: str, *, keys: tuple[str, str] = ("game_pk", "batter_id"), hit: str = "hit_hr", **ladder) -> DataFrame:
    """The picks, settled by the outcomes streamed so far; ``ladder`` has the other inputs of ``board.settle``.

    A hit in any batch stays a hit, and rows without an outcome keep their label unless the ladder says otherwise.
    """
    found = streamed(picks.sparkSession, f"{root}/outcomes")
    if found is not None:
        outcomes = found.groupBy(*keys).agg(F.max(hit).alias("hit_hr"))
    else:
        outcomes = picks.select(*keys, F.lit(None).cast("int").alias("hit_hr")).limit(0)
    nothing = outcomes.select(*keys).limit(0)
    given = {"boxscores": nothing, "known_games": nothing.select("game_pk")} | ladder
    return settle(picks, outcomes=outcomes, outcome_key=keys, **given)
