"""Queries of the streaming jobs, compared with what a batch query gives for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretrace.functions.scalar import flag
from foretrace.plans import tables as T
from foretrace.plans.registry import query
from foretrace.plans.tables import BOARD_SQL
from foretrace.sources import writers
from foretrace.sources.readers import EVENTS_SCHEMA, table
from foretrace.streaming import jobs as J


PARTS, FILES = 4, 8


def landed_events(spark: SparkSession, sf: str, *, disturbed: bool = False) -> str:
    """All events, landed in as many parts as days fall into, oldest first; returns the folder.

    ``disturbed`` adds to each part a second copy of every tenth event of it, and to the last part, under new ids, copies
    of the first part's events, which are far too late by then.
    """
    folder = writers.scratch_path(spark, "landed")
    events = table(spark, sf, "events")
    day = F.datediff(F.col("ts"), F.lit("1970-01-01").cast("date"))
    bounds = events.agg(F.min(day).alias("a"), F.max(day).alias("b")).first()
    part = F.least(F.floor((day - F.lit(bounds["a"])) * PARTS / F.lit(bounds["b"] - bounds["a"] + 1)), F.lit(PARTS - 1))
    events = events.withColumn("part", part)
    for number in range(PARTS):
        rows = events.where(F.col("part") == number)
        if disturbed:
            rows = rows.unionByName(rows.where(F.col("event_id") % 10 == 3))
            if number == PARTS - 1:
                rows = rows.unionByName(events.where("part = 0").withColumn("event_id", -1 - F.col("event_id")))
        # as many files for each part as a micro-batch takes
        rows.drop("part").repartition(FILES).write.mode("append").parquet(folder)
    return folder


def event_stream(spark: SparkSession, sf: str, *, disturbed: bool = False) -> DataFrame:
    """The landed events, one part for each micro-batch."""
    return J.read_stream(spark, landed_events(spark, sf, disturbed=disturbed), EVENTS_SCHEMA, files_per_batch=FILES)


def counts() -> dict:
    return {"n": F.count(F.lit(1)), "purchases": F.sum(flag(F.col("event_type") == "purchase"))}


@query("stream_ingest", "SELECT event_id, ts, user_id, value FROM events")
def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    root = writers.scratch_path(spark, "ingest")
    J.ingest(event_stream(spark, sf, disturbed=True), root, time="ts", keys=["event_id"])
    return spark.read.parquet(f"{root}/out").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "value")


@query(
    "stream_rollup",
    """SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS purchases FROM events GROUP BY 1, 2""",
)
def stream_rollup(spark: SparkSession, sf: str) -> DataFrame:
    root = writers.scratch_path(spark, "rollup")
    daily = J.tumbling(event_stream(spark, sf), time="ts", keys=["user_id"], length="1 day", slide=None, delay="2 days", aggregates=counts())
    J.write_batches(daily, root, mode="update")
    return J.latest_by_key(spark, root, ["user_id", "window_start"]).select(
        "user_id", F.col("window_start").cast("date").alias("day"), "n", "purchases"
    )


@query(
    "stream_sliding",
    """WITH d AS (SELECT user_id, CAST(ts AS DATE) - CAST(k AS INTEGER) AS first_day, event_type FROM events, (SELECT unnest(generate_series(0, 6)) AS k))
    SELECT user_id, CAST(first_day AS DATE) AS first_day, count(*) AS n, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS purchases FROM d GROUP BY 1, 2""",
)
def stream_sliding(spark: SparkSession, sf: str) -> DataFrame:
    root = writers.scratch_path(spark, "sliding")
    weekly = J.tumbling(event_stream(spark, sf), time="ts", keys=["user_id"], length="7 days", slide="1 day", delay="2 days", aggregates=counts())
    J.write_batches(weekly, root, mode="update")
    return J.latest_by_key(spark, root, ["user_id", "window_start"]).select(
        "user_id", F.col("window_start").cast("date").alias("first_day"), "n", "purchases"
    )


@query(
    "stream_session",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY""",
)
def stream_session(spark: SparkSession, sf: str) -> DataFrame:
    root = writers.scratch_path(spark, "session")
    closed = J.sessions(event_stream(spark, sf), time="ts", keys=["user_id"], gap="6 hours", delay="2 days", aggregates={"n": F.count(F.lit(1))})
    J.write_batches(closed, root, mode="append")
    return spark.read.parquet(f"{root}/out").select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


@query(
    "stream_prefix",
    """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS p FROM events GROUP BY 1, 2)
    SELECT user_id, day, n_before, purchases_before FROM (SELECT user_id, day, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS n_before, CAST(coalesce(sum(p) OVER w, 0) AS BIGINT) AS purchases_before FROM d
      WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY""",
)
def stream_prefix(spark: SparkSession, sf: str) -> DataFrame:
    root = writers.scratch_path(spark, "prefix")
    J.prefix(event_stream(spark, sf), root, time="ts", entity="user_id", delay="2 days", aggregates=counts())
    return spark.read.parquet(f"{root}/out").select(
        "user_id", F.col("window_start").cast("date").alias("day"), "n_before", "purchases_before"
    )


@query(
    "stream_ingest_counts",
    f"""WITH d AS (SELECT event_id, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS day FROM events), b AS (SELECT min(day) AS a, max(day) AS b FROM d),
    p AS (SELECT event_id, least(floor((day - a) * {PARTS} / (b - a + 1)::DOUBLE), {PARTS - 1}) AS part FROM d, b)
    SELECT CAST(count(*) + sum((event_id % 10 = 3)::INT) + sum((part = 0)::INT) AS BIGINT) AS input_rows, CAST(sum((event_id % 10 = 3)::INT) AS BIGINT) AS duplicate_rows, CAST(sum((part = 0)::INT) AS BIGINT) AS late_rows FROM p""",
)
def stream_ingest_counts(spark: SparkSession, sf: str) -> DataFrame:
    stream = event_stream(spark, sf, disturbed=True)
    counted = J.ingest(stream, writers.scratch_path(spark, "ingest"), time="ts", keys=["event_id"])
    return spark.range(1).select(*[F.lit(v).cast("bigint").alias(k) for k, v in counted.items()])


@query(
    "stream_settle",
    f"""WITH {BOARD_SQL} SELECT pick_id, CASE WHEN hit_hr = 1 THEN 'HR' ELSE 'No HR' END AS result_label, hit_hr AS actual_hit_hr FROM board""",
)
def stream_settle(spark: SparkSession, sf: str) -> DataFrame:
    root = writers.scratch_path(spark, "settle")
    board = T.board(spark, sf, shared=True)
    picks = board.select("pick_id", "game_pk", "game_date", "batter_id", "result_label", "actual_hit_hr", "game_status", F.lit("live").alias("game_state"))
    day = F.datediff(F.col("ts"), F.lit("1970-01-01").cast("date"))
    half = (F.hour("ts") >= 12).cast("int")
    outcomes = event_stream(spark, sf, disturbed=True).select(
        T.game_number(day, F.floor(F.col("user_id") / T.TEAM_SIZE), half).alias("game_pk"),
        F.col("user_id").alias("batter_id"),
        flag(F.col("event_type") == "purchase").alias("hit_hr"),
    )
    J.settle_stream(outcomes, root)
    settled = J.settled_board(picks, root, resolved_through=T.day_back(board, 0))
    return settled.select("pick_id", "result_label", "actual_hit_hr")
