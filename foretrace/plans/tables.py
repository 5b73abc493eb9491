"""The domain tables, derived from the given ones, in Spark and as SQL common table expressions.

An ``events`` row plays one plate appearance: the user is the batter, ``props.k`` the pitcher, a purchase a home run,
an error a strikeout, a signup a walk; clicks, views and purchases are batted balls with speed ``value``. A game is a
team-day half, so that a team can play twice a day.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foretrace.functions.scalar import batting_side, event_flags, tier_of
from foretrace.functions.text import pick_id, result_outcome
from foretrace.operators import rollup as R
from foretrace.operators.history import day_number
from foretrace.session import cut_lineage
from foretrace.sources.readers import table

ANALOGUE_RULES = {
    "outcome": "events",
    "hit": ("purchase",),
    "at_bat": ("purchase", "click", "view", "error"),
    "walk": ("signup",),
    "strikeout": ("error",),
}
# Players per team: teams grow in number with the data, their lineups do not grow.
TEAM_SIZE = 6
BATTED = ("click", "view", "purchase")
PITCH_CODES = ("FF", "SI", "SL", "CU", "CH", "FC")
DESCRIPTIONS = ("hit_into_play", "foul", "swinging_strike", "called_strike", "ball", "foul_tip")
BB_TYPES = ("fly_ball", "line_drive", "ground_ball", "popup")


def pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def player_name(user: Column) -> Column:
    return F.concat(F.lit("Player "), F.char(65 + user % 26), F.char(97 + F.floor(user / 26) % 26))


def game_number(day: Column, team: Column, half: Column) -> Column:
    return (day.cast("bigint") * 1000000 + team) * 2 + half


def raw_events(spark: SparkSession, sf: str) -> DataFrame:
    """``events`` with the domain's column names."""
    e = table(spark, sf, "events")
    batted = F.col("event_type").isin(*BATTED)
    k = F.get_json_object("props", "$.k").cast("bigint")
    out = e.select(
        "event_id",
        F.col("ts"),
        F.col("ts").cast("date").alias("game_date"),
        F.col("user_id").alias("batter_id"),
        k.alias("pitcher_id"),
        F.col("event_type").alias("events"),
        "value",
        F.floor(F.col("user_id") / TEAM_SIZE).cast("int").alias("team_no"),
        (F.hour("ts") >= 12).cast("int").alias("half"),
        F.when(batted, F.col("value")).alias("launch_speed"),
        F.when(batted, (F.col("event_id") % 60).cast("double") - 10).alias("launch_angle"),
        F.when(F.col("user_id") % 3 == 0, "L").otherwise("R").alias("stand"),
        F.when(k % 4 == 0, "L").otherwise("R").alias("p_throws"),
        pick(PITCH_CODES, k % 6).alias("pitch_type"),
        F.when(batted, pick(BB_TYPES, F.col("event_id") % 4)).alias("bb_type"),
        pick(DESCRIPTIONS, F.col("event_id") % 6).alias("description"),
        F.when(F.col("event_id") % 17 == 0, "n/a").otherwise((F.col("event_id") % 250).cast("string")).alias("hc_x"),
        (F.col("event_id") % 200).cast("string").alias("hc_y"),
        player_name(F.col("user_id")).alias("player_name"),
    )
    opponent = F.col("team_no") + 1 - F.col("team_no") % 2 * 2
    home_bats = (F.col("team_no") + F.col("half")) % 2 == 1
    day = day_number("game_date")
    out = out.withColumns(
        {
            "day_no": day.cast("bigint"),
            "game_pk": game_number(day, F.col("team_no"), F.col("half")),
            "at_bat_number": F.col("event_id"),
            "inning_topbot": F.when(home_bats, "Bot").otherwise("Top"),
            "home_team": F.when(home_bats, F.col("team_no")).otherwise(opponent),
            "away_team": F.when(home_bats, opponent).otherwise(F.col("team_no")),
        }
    )
    name = F.col("player_name")
    play = (
        F.when(F.col("event_id") % 5 == 0, F.lit(None))
        .when(F.col("events") == "purchase", F.concat(name, F.lit(" homers on a fly ball.")))
        .when(F.col("events") == "error", F.concat(F.lit(" "), name, F.lit(" strikes out swinging.")))
        .when(
            (F.col("events") == "signup") & (F.col("event_id") % 2 == 0),
            F.concat(F.lit("Reliever intentionally walks "), name, F.lit(".")),
        )
        .when(F.col("events") == "signup", F.concat(name, F.lit("  bunt walks.")))
        .when(F.col("events") == "click", F.concat(name, F.lit(" singles on a line drive.")))
        .otherwise(F.concat(F.lit("Mound visit by "), name))
    )
    return out.withColumn("des", play)


def plate_appearances(spark: SparkSession, sf: str, *, order: bool = True) -> DataFrame:
    """Events with sides, flags and (if asked) the capped batting order."""
    pa = raw_events(spark, sf)
    pa = pa.withColumns(batting_side("inning_topbot", "away_team", "home_team"))
    pa = pa.withColumns(event_flags(**ANALOGUE_RULES))
    if order:
        # Dealt by game once, for the order in each team and for rollups by game that follow
        pa = R.capped_dense_rank(
            pa.repartition("game_pk"), keys=["game_pk", "batting_team"], value="at_bat_number", cap=9, name="batting_order"
        )
    return pa


def stored(df: DataFrame, shared: bool) -> DataFrame:
    """A rollup that is read several times is written once: it is far smaller than the events behind it."""
    return cut_lineage(df) if shared else df


_kept: dict | None = None


@contextmanager
def kept_rollups() -> Iterator[None]:
    """Within the block the shared rollups of a folder are made once and used by every query that asks for them."""
    global _kept
    outer, _kept = _kept, {} if _kept is None else _kept
    try:
        yield
    finally:
        _kept = outer


def _once(name: str, sf: str, shared: bool, make: Callable[[], DataFrame]) -> DataFrame:
    if not shared or _kept is None:
        return stored(make(), shared)
    if (name, sf) not in _kept:
        _kept[name, sf] = stored(make(), shared)
    return _kept[name, sf]


def batter_games(spark: SparkSession, sf: str, *, shared: bool = True) -> DataFrame:
    return _once("batter_games", sf, shared, lambda: R.batter_games(plate_appearances(spark, sf), order=["at_bat_number"]))


def batter_counts(spark: SparkSession, sf: str, *, shared: bool = True) -> DataFrame:
    """The batter-game table without batting order (for windows that do not need it)."""

    def make() -> DataFrame:
        pa = plate_appearances(spark, sf, order=False).withColumn("batting_order", F.lit(None).cast("int"))
        return R.batter_games(pa, order=["at_bat_number"]).drop("batting_order")

    return _once("batter_counts", sf, shared, make)


def pitcher_games(spark: SparkSession, sf: str, *, shared: bool = True) -> DataFrame:
    return _once("pitcher_games", sf, shared, lambda: R.pitcher_games(plate_appearances(spark, sf, order=False), order=["at_bat_number"]))


def board(spark: SparkSession, sf: str, *, shared: bool = False) -> DataFrame:
    """One pick per batter-game: probability from the hardest hit, label from the outcome or the state of the game.

    ``shared`` writes it once, for queries that read it several times. Names come from the player, not from the rows.
    """
    b = (
        raw_events(spark, sf)
        .groupBy("game_pk", "game_date", "batter_id")
        .agg(
            F.min("pitcher_id").alias("pitcher_id"),
            F.max("team_no").alias("team"),
            (F.max("launch_speed") / 500).alias("predicted_hr_probability"),
            F.max((F.col("events") == "purchase").cast("int")).alias("hit_hr"),
            F.min("ts").alias("first_ts"),
        )
        .withColumn("batter_name", player_name(F.col("batter_id")))
    )
    status = (
        F.when(F.col("game_pk") % 11 == 0, "In Progress - Delayed")
        .when(F.col("game_pk") % 13 == 0, "Postponed: Rain")
        .when(F.col("game_pk") % 17 == 0, "Scheduled")
        .otherwise("Final")
    )
    label = (
        F.when(F.col("game_pk") % 11 == 0, "Pending")
        .when(F.col("game_pk") % 13 == 0, "Postponed")
        .when(F.col("game_pk") % 17 == 0, "Pending")
        .when(F.col("hit_hr") == 1, "HR")
        .otherwise("No HR")
    )
    b = b.withColumns(
        {
            "rank": F.when(F.col("batter_id") % 7 != 0, (F.col("batter_id") % 40 + 1).cast("int")),
            "predicted_hr_score": F.round(F.col("predicted_hr_probability") * 100, 4),
            "confidence_tier": tier_of(F.col("predicted_hr_probability") + 0.35),
            "game_status": status,
            "result_label": label,
        }
    )
    picks = b.withColumns(
        {
            "pick_id": pick_id("game_date", "game_pk", "batter_id", "batter_name", "pitcher_id", F.lit("")),
            "actual_hit_hr": result_outcome("result_label"),
        }
    )
    return stored(picks, shared)


def day_back(df: DataFrame, days: int, date: str = "game_date") -> Column:
    """The day so many days before the newest one of the table."""
    return F.date_sub(df.agg(F.max(date)).scalar(), days)


BOARD_COLUMNS = (
    "pick_id, game_pk, game_date, batter_id, pitcher_id, batter_name, team, rank, confidence_tier, "
    "predicted_hr_probability, predicted_hr_score, game_status, result_label, actual_hit_hr"
)

RAW_SQL = """
raw0 AS (
  SELECT event_id, ts, CAST(ts AS DATE) AS game_date, user_id AS batter_id,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS pitcher_id, event_type AS events, value,
    CAST(user_id // 6 AS INTEGER) AS team_no, CASE WHEN hour(ts) >= 12 THEN 1 ELSE 0 END AS half,
    event_type IN ('click', 'view', 'purchase') AS batted,
    date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS day_no,
    'Player ' || chr(CAST(65 + user_id % 26 AS INTEGER)) || chr(CAST(97 + (user_id // 26) % 26 AS INTEGER)) AS player_name
  FROM events),
raw AS (
  SELECT event_id, ts, game_date, batter_id, pitcher_id, events, value, team_no, half, day_no, player_name,
    CASE WHEN batted THEN value END AS launch_speed,
    CASE WHEN batted THEN CAST(event_id % 60 AS DOUBLE) - 10 END AS launch_angle,
    CASE WHEN batter_id % 3 = 0 THEN 'L' ELSE 'R' END AS stand,
    CASE WHEN pitcher_id % 4 = 0 THEN 'L' ELSE 'R' END AS p_throws,
    (['FF', 'SI', 'SL', 'CU', 'CH', 'FC'])[pitcher_id % 6 + 1] AS pitch_type,
    CASE WHEN batted THEN (['fly_ball', 'line_drive', 'ground_ball', 'popup'])[event_id % 4 + 1] END AS bb_type,
    (['hit_into_play', 'foul', 'swinging_strike', 'called_strike', 'ball', 'foul_tip'])[event_id % 6 + 1] AS description,
    CASE WHEN event_id % 17 = 0 THEN 'n/a' ELSE CAST(event_id % 250 AS VARCHAR) END AS hc_x,
    CAST(event_id % 200 AS VARCHAR) AS hc_y,
    CAST((day_no * 1000000 + team_no) * 2 + half AS BIGINT) AS game_pk, event_id AS at_bat_number,
    CASE WHEN (team_no + half) % 2 = 1 THEN 'Bot' ELSE 'Top' END AS inning_topbot,
    CASE WHEN (team_no + half) % 2 = 1 THEN team_no ELSE team_no + 1 - team_no % 2 * 2 END AS home_team,
    CASE WHEN (team_no + half) % 2 = 1 THEN team_no + 1 - team_no % 2 * 2 ELSE team_no END AS away_team,
    CASE WHEN event_id % 5 = 0 THEN NULL
      WHEN events = 'purchase' THEN player_name || ' homers on a fly ball.'
      WHEN events = 'error' THEN ' ' || player_name || ' strikes out swinging.'
      WHEN events = 'signup' AND event_id % 2 = 0 THEN 'Reliever intentionally walks ' || player_name || '.'
      WHEN events = 'signup' THEN player_name || '  bunt walks.'
      WHEN events = 'click' THEN player_name || ' singles on a line drive.'
      ELSE 'Mound visit by ' || player_name END AS des
  FROM raw0)"""

PA_SQL = (
    RAW_SQL
    + """,
pa0 AS (
  SELECT *, CASE WHEN inning_topbot = 'Top' THEN away_team ELSE home_team END AS batting_team,
    CASE WHEN inning_topbot = 'Top' THEN home_team ELSE away_team END AS fielding_team,
    degrees(atan2(TRY_CAST(hc_x AS DOUBLE) - 125.42, 198.27 - TRY_CAST(hc_y AS DOUBLE))) AS spray_angle
  FROM raw),
pa AS (
  SELECT *, CASE WHEN batting_team = home_team THEN 1 ELSE 0 END AS is_home, 1 AS pa_count,
    CASE WHEN events IN ('purchase', 'click', 'view', 'error') THEN 1 ELSE 0 END AS ab_count,
    CASE WHEN events = 'purchase' THEN 1 ELSE 0 END AS hr_count,
    CASE WHEN events = 'signup' THEN 1 ELSE 0 END AS is_bb,
    CASE WHEN events = 'error' THEN 1 ELSE 0 END AS is_k,
    CASE WHEN launch_speed IS NOT NULL THEN 1 ELSE 0 END AS bbe_count,
    CASE WHEN launch_speed >= 98 AND launch_angle >= 26 - 0.5 * greatest(launch_speed - 98, 0)
      AND launch_angle <= 30 + 0.5 * greatest(launch_speed - 98, 0) THEN 1 ELSE 0 END AS barrel_count,
    CASE WHEN launch_speed >= 95 THEN 1 ELSE 0 END AS hard_hit_bbe_count,
    CASE WHEN launch_speed >= 95 THEN 1 ELSE 0 END AS ev_95plus_bbe_count,
    CASE WHEN bb_type IN ('fly_ball', 'popup') THEN 1 ELSE 0 END AS fly_ball_bbe_count,
    CASE WHEN bb_type IN ('fly_ball', 'line_drive', 'popup')
      AND ((stand = 'R' AND spray_angle < -15) OR (stand = 'L' AND spray_angle > 15)) THEN 1 ELSE 0 END AS pull_air_bbe_count,
    CASE WHEN description IN ('foul', 'foul_tip', 'hit_into_play', 'hit_into_play_no_out', 'hit_into_play_score')
      THEN 1 ELSE 0 END AS contact_event_count,
    CASE WHEN description IN ('foul', 'foul_tip', 'hit_into_play', 'hit_into_play_no_out', 'hit_into_play_score',
      'swinging_strike', 'swinging_strike_blocked', 'foul_bunt', 'missed_bunt', 'foul_pitchout')
      THEN 1 ELSE 0 END AS swing_event_count,
    least(dense_rank() OVER (PARTITION BY game_pk, batting_team ORDER BY at_bat_number), 9) AS batting_order
  FROM pa0)"""
)

BOARD_SQL = (
    RAW_SQL
    + """,
b0 AS (
  SELECT game_pk, game_date, batter_id, min(pitcher_id) AS pitcher_id, max(player_name) AS batter_name, max(team_no) AS team,
    max(launch_speed) / 500 AS predicted_hr_probability, max(CASE WHEN events = 'purchase' THEN 1 ELSE 0 END) AS hit_hr,
    min(ts) AS first_ts
  FROM raw GROUP BY game_pk, game_date, batter_id),
b1 AS (
  SELECT *, CAST(CASE WHEN batter_id % 7 <> 0 THEN batter_id % 40 + 1 END AS INTEGER) AS rank,
    round(predicted_hr_probability * 100, 4) AS predicted_hr_score,
    CASE WHEN predicted_hr_probability + 0.35 >= 0.99 THEN 'elite' WHEN predicted_hr_probability + 0.35 >= 0.95 THEN 'strong'
      WHEN predicted_hr_probability + 0.35 >= 0.80 THEN 'watch' ELSE 'longshot' END AS confidence_tier,
    CASE WHEN game_pk % 11 = 0 THEN 'In Progress - Delayed' WHEN game_pk % 13 = 0 THEN 'Postponed: Rain'
      WHEN game_pk % 17 = 0 THEN 'Scheduled' ELSE 'Final' END AS game_status,
    CASE WHEN game_pk % 11 = 0 THEN 'Pending' WHEN game_pk % 13 = 0 THEN 'Postponed' WHEN game_pk % 17 = 0 THEN 'Pending'
      WHEN hit_hr = 1 THEN 'HR' ELSE 'No HR' END AS result_label
  FROM b0),
board AS (
  SELECT *, concat_ws(':', CAST(game_date AS VARCHAR), CAST(game_pk AS VARCHAR), CAST(batter_id AS VARCHAR),
      CAST(pitcher_id AS VARCHAR)) AS pick_id,
    CASE WHEN result_label = 'HR' THEN 1 WHEN result_label = 'No HR' THEN 0 END AS actual_hit_hr
  FROM b1)"""
)

BG_SQL = (
    PA_SQL
    + """,
bg AS (
  SELECT game_pk, game_date, batter_id, date_diff('day', DATE '1970-01-01', game_date) AS day_no,
    arg_min(batting_team, at_bat_number) AS team, arg_min(fielding_team, at_bat_number) AS opponent,
    max(is_home) AS is_home, arg_min(stand, at_bat_number) AS bat_side, arg_min(p_throws, at_bat_number) AS pitcher_hand,
    CAST(min(batting_order) AS INTEGER) AS batting_order, CAST(sum(pa_count) AS BIGINT) AS pa_count,
    CAST(sum(ab_count) AS BIGINT) AS ab_count, CAST(sum(hr_count) AS BIGINT) AS hr_count,
    CAST(sum(bbe_count) AS BIGINT) AS bbe_count, CAST(sum(barrel_count) AS BIGINT) AS barrel_count,
    CAST(sum(hard_hit_bbe_count) AS BIGINT) AS hard_hit_bbe_count, CAST(sum(is_k) AS BIGINT) AS batter_k_count,
    CAST(sum(is_bb) AS BIGINT) AS batter_bb_count, avg(launch_angle) AS avg_launch_angle,
    avg(launch_speed) AS avg_exit_velocity, max(launch_speed) AS max_exit_velocity,
    CAST(sum(ev_95plus_bbe_count) AS BIGINT) AS ev_95plus_bbe_count,
    CAST(sum(fly_ball_bbe_count) AS BIGINT) AS fly_ball_bbe_count,
    CAST(sum(pull_air_bbe_count) AS BIGINT) AS pull_air_bbe_count,
    CASE WHEN sum(hr_count) > 0 THEN 1 ELSE 0 END AS hit_hr
  FROM pa GROUP BY game_pk, game_date, batter_id)"""
)

HANDED_SQL = ", ".join(
    f"CAST(sum(CASE WHEN stand = '{side}' THEN {column} ELSE 0 END) AS BIGINT) AS {name}_{side.lower()}hb"
    for name, column in R.HANDED.items()
    for side in ("R", "L")
)
PG_SQL = (
    PA_SQL
    + f""",
pg AS (
  SELECT game_pk, game_date, date_diff('day', DATE '1970-01-01', game_date) AS day_no, batting_team AS team,
    fielding_team AS opponent, pitcher_id, arg_min(p_throws, at_bat_number) AS p_throws,
    CAST(sum(pa_count) AS BIGINT) AS pa_against, CAST(sum(hr_count) AS BIGINT) AS hr_allowed,
    CAST(sum(bbe_count) AS BIGINT) AS bbe_allowed, CAST(sum(barrel_count) AS BIGINT) AS barrels_allowed,
    CAST(sum(hard_hit_bbe_count) AS BIGINT) AS hard_hit_bbe_allowed,
    CAST(sum(ev_95plus_bbe_count) AS BIGINT) AS ev_95plus_bbe_allowed,
    CAST(sum(fly_ball_bbe_count) AS BIGINT) AS fb_allowed, CAST(sum(is_k) AS BIGINT) AS pitcher_k_count,
    CAST(sum(is_bb) AS BIGINT) AS pitcher_bb_count, CAST(sum(pa_count) AS BIGINT) AS batters_faced,
    CAST(sum(ab_count) AS BIGINT) AS outs_recorded, avg(launch_speed) AS avg_ev_allowed,
    max(launch_speed) AS max_ev_allowed, sum(ab_count) / CAST(3 AS DOUBLE) AS innings_pitched_est, {HANDED_SQL}
  FROM pa GROUP BY game_pk, game_date, batting_team, fielding_team, pitcher_id)"""
)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Round doubles for comparison, and turn -0.0 into 0.0."""
    return df.withColumns({c: F.round(F.col(c), 6) + F.lit(0.0) for c in columns})
