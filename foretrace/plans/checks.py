"""Queries of the data-quality operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretrace.functions import scalar as S
from foretrace.operators import history as H
from foretrace.operators import quality as Q
from foretrace.operators import ranking as K
from foretrace.plans import tables as T
from foretrace.plans import windows as W
from foretrace.plans.registry import query
from foretrace.plans.tables import BG_SQL, BOARD_SQL, PA_SQL, RAW_SQL
from foretrace.plans.windows import round_doubles
from foretrace.sources.readers import table


@query(
    "unique_key_check",
    """SELECT CAST(sum(n) AS BIGINT) AS row_count, count(*) AS keys, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS offending_keys, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows
    FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)""",
)
def unique_key_check(spark: SparkSession, sf: str) -> DataFrame:
    return Q.unique_key_check(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


NAMED_SQL = f"""{RAW_SQL}, nm AS (SELECT batter_id, CASE WHEN event_id % 50 = 0 THEN NULL WHEN batter_id % 60 = 0 THEN 'batter_' || batter_id WHEN batter_id % 31 = 0 AND event_id % 2 = 0 THEN 'Other Name' ELSE player_name END AS nm FROM raw)"""


@query(
    "identity_audit",
    f"""WITH {NAMED_SQL}, i AS (SELECT batter_id, count(DISTINCT nm) AS k FROM nm GROUP BY 1)
    SELECT count(*) AS row_count, count(DISTINCT batter_id) AS distinct_ids, (SELECT count(*) FROM i WHERE k > 1) AS unstable_ids, CAST(sum(CASE WHEN nm IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_names,
      CAST(sum(CASE WHEN nm LIKE 'batter\\_%' ESCAPE '\\' THEN 1 ELSE 0 END) AS BIGINT) AS placeholder_names, round(CAST(sum(CASE WHEN nm LIKE 'batter\\_%' ESCAPE '\\' THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 6) AS placeholder_share,
      CAST(sum(CASE WHEN nm LIKE 'batter\\_%' ESCAPE '\\' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) <= 0.01 AS passes FROM nm""",
)
def identity_audit(spark: SparkSession, sf: str) -> DataFrame:
    name = (
        F.when(F.col("event_id") % 50 == 0, F.lit(None))
        .when(F.col("batter_id") % 60 == 0, F.concat(F.lit("batter_"), F.col("batter_id").cast("string")))
        .when((F.col("batter_id") % 31 == 0) & (F.col("event_id") % 2 == 0), "Other Name")
        .otherwise(F.col("player_name"))
    )
    return round_doubles(Q.identity_audit(T.raw_events(spark, sf).withColumn("nm", name), entity="batter_id", name="nm"))


EXPORT_SQL = f"""{BG_SQL}, ex AS (SELECT batter_id, game_date, game_pk, {W.rate("hr_count", "pa_count", W.days(30))} AS a, CASE WHEN game_pk % 3 = 0 THEN hr_count END AS b,
  round(CAST(sum(CASE WHEN pitcher_hand = 'L' THEN hr_count ELSE 0 END) OVER {W.PRE} AS DOUBLE) / nullif(CAST(sum(CASE WHEN pitcher_hand = 'L' THEN pa_count ELSE 0 END) OVER {W.PRE} AS DOUBLE), 0), 6) AS c, CAST(NULL AS DOUBLE) AS d FROM bg)"""


def export_table(spark: SparkSession, sf: str) -> DataFrame:
    bg = T.batter_counts(spark, sf)
    bg = H.attach_trailing(bg, keys=["batter_id"], date="game_date", days=[30], sums={"hr": "hr_count", "pa": "pa_count"})
    bg = H.split_to_date(bg, **W.BATTER, split="pitcher_hand", sides={"L": "lhp"}, rates={"batter_hr_per_pa_vs": ("hr_count", "pa_count")})
    return bg.withColumns(
        {
            "hr_per_pa_last_30d": S.safe_rate("hr_last_30d", "pa_last_30d"),
            "park_factor_hr": F.when(F.col("game_pk") % 3 == 0, F.col("hr_count")),
            "batter_hr_per_pa_vs_rhp": F.lit(None).cast("double"),
        }
    )


@query(
    "leakage_check",
    f"""WITH {EXPORT_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY batter_id ORDER BY game_date, game_pk) AS rn FROM ex)
    SELECT 'hr_per_pa_last_30d' AS feature, count(CASE WHEN rn = 1 THEN a END) AS leaked_first_rows, count(a) > 0 AS has_signal, count(CASE WHEN rn = 1 THEN a END) = 0 AS clean FROM r
    UNION ALL SELECT 'park_factor_hr', count(CASE WHEN rn = 1 THEN b END), count(b) > 0, count(CASE WHEN rn = 1 THEN b END) = 0 FROM r""",
)
def leakage_check(spark: SparkSession, sf: str) -> DataFrame:
    return Q.leakage_check(export_table(spark, sf), entity="batter_id", order=["game_date", "game_pk"], features=["hr_per_pa_last_30d", "park_factor_hr"])


@query(
    "overlap_check",
    f"""WITH {RAW_SQL}, o AS (SELECT batter_id, player_name, pitcher_id, CASE WHEN event_id % 4 = 0 THEN player_name WHEN event_id % 4 = 1 THEN NULL ELSE 'Pitcher ' || pitcher_id END AS pn FROM raw)
    SELECT CAST(sum(CASE WHEN batter_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_ids, CAST(sum(CASE WHEN player_name IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_names,
      round(CAST(sum(CASE WHEN player_name = pn THEN 1 ELSE 0 END) AS DOUBLE) / sum(CASE WHEN pn IS NOT NULL THEN 1 ELSE 0 END), 6) AS name_overlap, round(avg(CASE WHEN batter_id = pitcher_id THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS id_overlap,
      CAST(sum(CASE WHEN player_name = pn THEN 1 ELSE 0 END) AS DOUBLE) / sum(CASE WHEN pn IS NOT NULL THEN 1 ELSE 0 END) <= 0.25 AND avg(CASE WHEN batter_id = pitcher_id THEN CAST(1 AS DOUBLE) ELSE 0 END) <= 0.1 AS passes FROM o""",
)
def overlap_check(spark: SparkSession, sf: str) -> DataFrame:
    name = (
        F.when(F.col("event_id") % 4 == 0, F.col("player_name"))
        .when(F.col("event_id") % 4 == 1, F.lit(None))
        .otherwise(F.concat(F.lit("Pitcher "), F.col("pitcher_id").cast("string")))
    )
    rows = T.raw_events(spark, sf).withColumn("pitcher_name", name)
    return round_doubles(Q.overlap_check(rows, entity="batter_id", entity_name="player_name", opponent="pitcher_id", opponent_name="pitcher_name"))


@query(
    "contract_check",
    f"""WITH {BOARD_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY game_date ORDER BY predicted_hr_score DESC NULLS LAST, predicted_hr_probability DESC NULLS LAST, batter_name, pick_id) AS due FROM board)
    SELECT TRUE AS columns_match, count(*) AS row_count, CAST(0 AS BIGINT) AS duplicate_rows, CAST(sum(CASE WHEN game_date < (SELECT max(game_date) - 25 FROM board) THEN 1 ELSE 0 END) AS BIGINT) AS early_rows,
      CAST(sum(CASE WHEN rank IS NULL OR rank <> due THEN 1 ELSE 0 END) AS BIGINT) AS out_of_order_rows FROM r""",
)
def contract_check(spark: SparkSession, sf: str) -> DataFrame:
    columns = T.BOARD_COLUMNS.split(", ")
    board = T.board(spark, sf, shared=True).select(*columns)
    due = K.rerank(board, slate=["game_date"], score="predicted_hr_score", probability="predicted_hr_probability", name="batter_name", tie="pick_id")
    return Q.contract_check(board, due, columns=columns, key="pick_id", rank="rank", date="game_date", start=T.day_back(board, 25))


@query(
    "snapshot_health",
    f"""WITH {RAW_SQL}, c AS (SELECT game_date, home_team, avg(CASE WHEN events <> 'view' THEN value END) AS t, avg(CASE WHEN event_id % 40 = 0 THEN value END) AS h FROM (SELECT * REPLACE (CASE WHEN home_team = 3 THEN -3 ELSE home_team END AS home_team) FROM raw) GROUP BY 1, 2),
    d AS (SELECT DISTINCT game_date, CASE WHEN home_team = 5 THEN -5 ELSE home_team END AS home_team FROM raw)
    SELECT (SELECT count(*) FROM d LEFT JOIN c USING (game_date, home_team) WHERE c.game_date IS NULL OR c.home_team IS NULL OR (c.t IS NULL AND c.h IS NULL AND NOT EXISTS (SELECT 1 FROM c c2 WHERE c2.game_date = d.game_date AND c2.home_team = d.home_team))) AS missing_keys,
      (SELECT count(*) FROM c ANTI JOIN d USING (game_date, home_team)) AS extra_keys, round((SELECT greatest(1 - CAST(count(t) AS DOUBLE) / count(*), 1 - CAST(count(h) AS DOUBLE) / count(*)) FROM c), 6) AS worst_null_rate, FALSE AS healthy""",
)
def snapshot_health(spark: SparkSession, sf: str) -> DataFrame:
    raw = T.raw_events(spark, sf)
    moved = lambda team: F.when(F.col("home_team") == team, -team).otherwise(F.col("home_team"))
    cache = raw.withColumn("home_team", moved(3)).groupBy("game_date", "home_team").agg(
        F.avg(F.when(F.col("events") != "view", F.col("value"))).alias("temperature_f"), F.avg(F.when(F.col("event_id") % 40 == 0, F.col("value"))).alias("humidity_pct")
    )
    due = raw.withColumn("home_team", moved(5)).select("game_date", "home_team")
    return round_doubles(Q.snapshot_health(cache, due, on=["game_date", "home_team"], features=["temperature_f", "humidity_pct"]))
