"""Reading event chunks, tables, JSON records and landed feeds; schemas are declared, never inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foretrace.functions import fixed_values as fv

EVENTS_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def project_required(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Only the required columns; a missing one is an error."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"event data is missing required columns: {missing}")
    return df.select(*required)


def read_chunks(
    spark: SparkSession, path: str, schema: T.StructType, *, file_format: str = "parquet", header: bool = True
) -> DataFrame:
    """All chunk files below a folder as one table; an empty chunk adds no rows."""
    reader = spark.read.schema(schema)
    if file_format == "csv":
        reader = reader.option("header", header)
    return reader.format(file_format).load(path)


def union_chunks(chunks: Sequence[DataFrame]) -> DataFrame:
    out = chunks[0]
    for chunk in chunks[1:]:
        out = out.unionByName(chunk)
    return out


def date_chunks(bounds: DataFrame, *, start: str, end: str, days: int = 7) -> DataFrame:
    """Split each ``[start, end]`` into chunks of ``days`` days, the last one cut at the end."""
    step = F.expr(f"interval {days} days")
    chunk = F.explode(F.sequence(F.col(start), F.col(end), step))
    return bounds.select(chunk.alias("chunk_start"), F.col(end).alias("__end")).select(
        "chunk_start", F.least(F.date_add("chunk_start", days - 1), F.col("__end")).alias("chunk_end")
    )


def read_records(spark: SparkSession, path: str, schema: T.StructType, *, arrays: bool = False) -> DataFrame:
    """JSON records, one object per line, in files that tasks can split; a missing path gives an empty table.

    With ``arrays`` each file is one JSON array of records (or one record); such a file is read by one task.
    """
    probe = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = probe.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(probe):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", arrays).json(path)


LINEUP = T.ArrayType(
    T.StructType([T.StructField("batter_id", T.LongType()), T.StructField("batter_name", T.StringType())])
)
SIDE = T.StructType(
    [
        T.StructField("team", T.StringType()),
        T.StructField("pitcher_id", T.LongType()),
        T.StructField("lineup", LINEUP),
        T.StructField("confirmed", T.BooleanType()),
    ]
)
SCHEDULE_SCHEMA = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField(
            "games",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("game_pk", T.LongType()),
                        T.StructField("status", T.StringType()),
                        T.StructField("home", SIDE),
                        T.StructField("away", SIDE),
                    ]
                )
            ),
        ),
    ]
)


def flatten_schedule(landed: DataFrame) -> DataFrame:
    """Landed schedule days to one row per game, with numbered lineups and where they come from."""
    games = landed.select("date", F.explode("games").alias("g"))

    def numbered(side: str) -> Column:
        return F.transform(
            F.coalesce(F.col(f"g.{side}.lineup"), F.array().cast(LINEUP)),
            lambda hitter, i: F.struct(hitter["batter_id"], hitter["batter_name"], (i + 1).alias("batting_order")),
        )

    def source(side: str) -> Column:
        return F.when(F.coalesce(F.col(f"g.{side}.confirmed"), F.lit(False)), "confirmed").otherwise("projected")

    return games.select(
        F.col("g.game_pk").alias("game_pk"),
        F.col("date").alias("game_date"),
        F.col("g.status").alias("status"),
        *[
            c
            for side in ("home", "away")
            for c in (
                F.col(f"g.{side}.team").alias(f"{side}_team"),
                F.col(f"g.{side}.pitcher_id").alias(f"{side}_pitcher_id"),
                numbered(side).alias(f"{side}_lineup"),
                source(side).alias(f"{side}_lineup_source"),
            )
        ],
    )


BOXSCORE_SCHEMA = T.StructType(
    [
        T.StructField("game_pk", T.LongType()),
        T.StructField(
            "players",
            T.MapType(
                T.StringType(),
                T.StructType([T.StructField("id", T.LongType()), T.StructField("homeRuns", T.IntegerType())]),
            ),
        ),
    ]
)


def boxscore_hitters(landed: DataFrame) -> DataFrame:
    """Boxscore player maps to the distinct (game, batter) pairs with a home run."""
    players = landed.select("game_pk", F.explode("players").alias("key", "player"))
    return players.where("player.homeRuns > 0").select("game_pk", F.col("player.id").alias("batter_id")).distinct()


ROSTER_SCHEMA = T.StructType(
    [T.StructField("team", T.StringType()), T.StructField("roster", LINEUP)]
)


def roster_members(landed: DataFrame) -> DataFrame:
    """Landed rosters to one row per team and batter."""
    return (
        landed.select("team", F.explode("roster").alias("p"))
        .select("team", "p.batter_id", "p.batter_name")
        .where("batter_id is not null")
        .groupBy("team", "batter_id")
        .agg(F.min("batter_name").alias("batter_name"))
    )


PARK_SCHEMA = T.StructType(
    [
        T.StructField("team", T.StringType()),
        T.StructField("ballpark", T.StringType()),
        T.StructField("region_abbr", T.StringType()),
        T.StructField("field_bearing_deg", T.DoubleType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("tz", T.StringType()),
    ]
)


def _read_declared(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A landed CSV file whose header must name the schema's columns in order."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def read_parks(spark: SparkSession, path: str) -> DataFrame:
    """The landed park file: one row per team code, with place, bearing of the field and time zone."""
    return _read_declared(spark, path, PARK_SCHEMA)


PARK_FACTOR_SCHEMA = T.StructType(
    [
        T.StructField("venue_key", T.StringType()),
        T.StructField("park_name", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("park_factor_hr", T.DoubleType()),
        T.StructField("park_factor_hr_vs_lhb", T.DoubleType()),
        T.StructField("park_factor_hr_vs_rhb", T.DoubleType()),
        T.StructField("source_note", T.StringType()),
    ]
)


def read_park_factors(spark: SparkSession, path: str) -> DataFrame:
    """A landed park factor file."""
    return _read_declared(spark, path, PARK_FACTOR_SCHEMA)
