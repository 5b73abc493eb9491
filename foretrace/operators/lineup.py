"""Probable lineups and candidate tables, for all teams of a slate at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretrace.functions.scalar import slot_to_pa
from foretrace.operators.ranking import topk
from foretrace.operators.rollup import pool_summary

POOL_ORDER = ("recent_starts", "recent_games", "avg_recent_pa")


def eligible_games(
    history: DataFrame, *, target: Column, games: int = 3, lookback: int = 21, fallback: int = 210
) -> DataFrame:
    """Each team's last games before the target date: those within ``lookback`` days, else, if the team's last game is
    at most ``fallback`` days old, the last ones of the season before; else none."""
    played = history.where(F.col("game_date") < target).select("team", "game_date", "game_pk").distinct()
    last = topk(played, keys=["team"], order=[F.desc("game_date"), F.desc("game_pk")], k=games)
    newest = F.max("game_date").over(Window.partitionBy("team"))
    cutoff = F.date_sub(target, lookback)
    usable = F.when(F.col("__newest") >= cutoff, F.col("game_date") >= cutoff).otherwise(
        F.datediff(target, "__newest") <= fallback
    )
    return last.withColumn("__newest", newest).where(usable).drop("__newest")


def probable_lineups(
    history: DataFrame,
    *,
    target: Column,
    forms: Sequence[str] = (),
    name: str = "batter_name",
    projected: DataFrame | None = None,
    roster: DataFrame | None = None,
    hitters: int = 9,
    **games,
) -> DataFrame:
    """The ``hitters`` best-placed players per team, without filling up short lineups.

    ``projected`` (team, batter_id, batter_name, batting_order) restricts the teams it lists, ``roster`` (team,
    batter_id, batter_name) restricts all teams; names come from the lineup, else from the roster, else from history.
    """
    past = history.where(F.col("game_date") < target)
    if projected is not None:
        listed = projected.where(F.col("batter_id").isNotNull()).dropDuplicates(["team", "batter_id"])
        named = listed.select(
            "team", "batter_id", F.col(name).alias("__lineup_name"), "batting_order", F.lit(True).alias("__listed")
        )
        teams = listed.select("team").distinct().withColumn("__has_lineup", F.lit(True))
        past = past.drop("batting_order").join(teams, "team", "left").join(named, ["team", "batter_id"], "left")
        past = past.where(F.col("__has_lineup").isNull() | F.col("__listed"))
    else:
        past = past.drop("batting_order").withColumns(
            {"__lineup_name": F.lit(None).cast("string"), "batting_order": F.lit(None).cast("int"), "__has_lineup": F.lit(None).cast("boolean")}
        )
    if roster is not None:
        members = roster.where(F.col("batter_id").isNotNull()).groupBy("team", "batter_id").agg(F.max(name).alias("__roster_name"))
        past = past.join(members, ["team", "batter_id"], "inner")
    else:
        past = past.withColumn("__roster_name", F.lit(None).cast("string"))
    recent = past.join(eligible_games(history, target=target, **games), ["team", "game_date", "game_pk"], "left_semi")
    pool = pool_summary(
        recent,
        keys=["team", "batter_id"],
        order=["game_date", "game_pk"],
        date="game_date",
        game="game_pk",
        volume="pa_count",
        latest=[name, *forms, "__lineup_name", "__roster_name", "batting_order", "__has_lineup"],
    )
    order = [F.desc_nulls_last(c) for c in (*POOL_ORDER, *forms, "last_game_date")] + [F.asc(name), F.asc("batter_id")]
    ranked = topk(pool, keys=["team"], order=order, k=hitters, name="projected_lineup_rank")
    source = F.when(F.col("__has_lineup"), "confirmed").otherwise("projected")
    shown = F.coalesce(F.when(F.col("__has_lineup"), F.col("__lineup_name")).otherwise(F.col("__roster_name")), F.col(name))
    return ranked.withColumns({name: shown, "lineup_source": source}).drop("__lineup_name", "__roster_name", "__has_lineup")


def candidate_frame(sides: DataFrame, lineups: DataFrame, weather: DataFrame) -> DataFrame:
    """Slate sides with their lineups, the park's weather, the slot and the expected volume."""
    joined = sides.join(lineups, "team").join(weather, ["game_date", "home_team"], "left")
    slot = F.coalesce(F.col("batting_order"), F.col("projected_lineup_rank"))
    return joined.withColumn("batting_order_slot", slot).withColumn("expected_pa_today", slot_to_pa("batting_order_slot"))


def lineup_panels(
    lineups: DataFrame, *, keys: Sequence[str], rank: str, shown: Sequence[str], picks: DataFrame | None = None, player: str = "batter_id"
) -> DataFrame:
    """One ordered array of players per game side (a lineup is short), each with whether the board picked them.

    ``picks`` has (``game_pk``, ``player``) of the board; without it nobody is selected.
    """
    rows = lineups.withColumn("selected_for_pick", F.lit(False))
    if picks is not None:
        chosen = picks.select("game_pk", player).distinct().withColumn("__picked", F.lit(True))
        rows = lineups.join(chosen, ["game_pk", player], "left")
        rows = rows.withColumn("selected_for_pick", F.coalesce("__picked", F.lit(False))).drop("__picked")
    players = F.array_sort(F.collect_list(F.struct(rank, *shown, "selected_for_pick")))
    return rows.groupBy(*keys).agg(players.alias("players"))
