"""Boards of ranked picks: summaries, upserts, recovery, locked merges, settlement and archiving."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretrace.functions import fixed_values as fv
from foretrace.functions.scalar import flag, safe_rate, tier_value
from foretrace.functions.text import is_postponed
from foretrace.operators.ranking import rerank

RESOLVED = ("HR", "No HR", "Postponed")


def pending(label: str = "result_label") -> Column:
    return F.coalesce(F.col(label), F.lit("Pending")) == "Pending"


def tier_summary(df: DataFrame, *, tier: str, outcome: str, probability: str) -> DataFrame:
    """Picks, homers, hit rate and mean probability per tier, best tier first."""
    out = df.groupBy(F.coalesce(tier, F.lit("watch")).alias("confidence_tier")).agg(
        F.count(F.lit(1)).alias("picks"),
        F.coalesce(F.sum(outcome), F.lit(0)).alias("homers"),
        F.avg(probability).alias("avg_probability"),
    )
    out = out.withColumn("hit_rate", safe_rate("homers", "picks"))
    return out.orderBy(F.desc(tier_value("confidence_tier")), "confidence_tier")


def tier_evaluation(df: DataFrame, *, tier: str, outcome: str) -> DataFrame:
    """Per tier, also for tiers without rows: sample size, hits, precision and false positives."""
    spark = df.sparkSession
    tiers = spark.range(len(fv.TIER_ORDER)).select(
        F.element_at(F.array(*[F.lit(t) for t in fv.TIER_ORDER]), (F.col("id") + 1).cast("int")).alias("confidence_tier")
    )
    found = df.groupBy(F.col(tier).alias("confidence_tier")).agg(
        F.count(F.lit(1)).alias("__n"), F.coalesce(F.sum(outcome), F.lit(0)).alias("__hits")
    )
    zero = F.lit(0).cast("bigint")
    n, hits = F.coalesce("__n", zero), F.coalesce("__hits", zero)
    return tiers.join(found, "confidence_tier", "left").select(
        "confidence_tier",
        n.alias("sample_size"),
        hits.alias("hr_count"),
        F.coalesce(safe_rate(hits, n), F.lit(0.0)).alias("precision"),
        (n - hits).alias("false_positives"),
    )


def leaderboard(df: DataFrame, *, by: Sequence[str], outcome: str, minimum: int) -> DataFrame:
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("picks"), F.coalesce(F.sum(outcome), F.lit(0)).alias("homers"))
    out = out.where(F.col("picks") >= minimum).withColumn("hit_rate", safe_rate("homers", "picks"))
    return out.orderBy(F.desc("homers"), F.desc("picks"), *by)


def overview(df: DataFrame, *, date: str, outcome: str, latest: Column) -> DataFrame:
    """One row of counts over all tracked picks; ``latest`` is the current slate's date."""
    settled = F.col(outcome).isNotNull()
    return df.agg(
        F.sum(flag(F.col(date) == latest)).alias("latest_slate_size"),
        F.countDistinct(date).alias("tracked_dates"),
        F.count(F.lit(1)).alias("tracked_picks"),
        F.sum(flag(settled)).alias("settled_picks"),
        F.coalesce(F.sum(outcome), F.lit(0)).alias("tracked_homers"),
        safe_rate(F.sum(outcome), F.sum(flag(settled))).alias("tracked_hit_rate"),
        F.sum(flag(~settled)).alias("open_picks"),
    )


def date_options(df: DataFrame, *, date: str, as_of: Column) -> DataFrame:
    """Distinct dates, newest first; the default is the day before ``as_of`` if listed, else the newest."""
    dates = df.where(F.col(date).isNotNull()).select(date).distinct()
    yesterday = F.date_sub(as_of, 1)
    facts = dates.agg(F.max(date).alias("newest"), F.max(flag(F.col(date) == yesterday)).alias("listed"))
    default = F.when(facts.select("listed").scalar() == 1, yesterday).otherwise(facts.select("newest").scalar())
    return dates.withColumn("is_default", F.col(date) == default).orderBy(F.desc(date))


def slate_state(games: DataFrame, *, date: str, state: str, start: str) -> DataFrame:
    return games.groupBy(date).agg(
        F.min(start).alias("first_game"),
        F.max(start).alias("last_game"),
        F.bool_and(F.col(state) == "final").alias("all_final"),
        F.bool_or(F.col(state) == "live").alias("has_live"),
        F.sum(flag(F.col(state) != "pregame")).alias("locked_games"),
        F.count(F.lit(1)).alias("games"),
    )


def select_tiers(df: DataFrame, *, tier: str, minimum: str | None = None, tiers: Sequence[str] | None = None) -> DataFrame:
    out = df
    if minimum is not None:
        out = out.where(tier_value(tier) >= tier_value(F.lit(minimum)))
    if tiers is not None:
        out = out.where(F.lower(F.trim(F.col(tier))).isin(*tiers))
    return out


def latest_slice(df: DataFrame, *, date: str, label: str | None = None) -> DataFrame:
    """Rows of the newest date (of pending rows only, if a label column is given)."""
    rows = df.where(pending(label)) if label else df
    return rows.where(F.col(date) == rows.agg(F.max(date)).scalar())


def forward_only(df: DataFrame, *, date: str, start: Column, score: str, probability: str) -> DataFrame:
    """Rows from the tracking start on; a missing score is the probability in percent."""
    kept = df.where(F.col(date) >= start)
    return kept.withColumn(score, F.coalesce(F.col(score), F.col(probability) * 100.0))


# The columns of a pick record, their types and defaults.
PICK_CONTRACT: Mapping[str, tuple[str, object]] = {
    "pick_id": ("string", None),
    "published_at": ("string", ""),
    "game_pk": ("bigint", None),
    "game_date": ("date", None),
    "game_datetime": ("string", ""),
    "game_status": ("string", ""),
    "game_state": ("string", "pregame"),
    "rank": ("int", 999),
    "batter_id": ("bigint", None),
    "batter_name": ("string", "Unknown hitter"),
    "team": ("string", ""),
    "opponent_team": ("string", ""),
    "pitcher_id": ("bigint", None),
    "pitcher_name": ("string", ""),
    "lineup_source": ("string", "projected"),
    "batting_order": ("int", None),
    "ballpark_name": ("string", ""),
    "ballpark_region_abbr": ("string", ""),
    "weather_code": ("int", None),
    "weather_label": ("string", ""),
    "temperature_f": ("double", None),
    "wind_speed_mph": ("double", None),
    "wind_direction_deg": ("double", None),
    "field_bearing_deg": ("double", None),
    "confidence_tier": ("string", "watch"),
    "predicted_hr_probability": ("double", None),
    "predicted_hr_score": ("double", None),
    "top_reason_1": ("string", ""),
    "top_reason_2": ("string", ""),
    "top_reason_3": ("string", ""),
    "result": ("string", "Pending"),
}


def canonical_record(df: DataFrame, contract: Mapping[str, tuple[str, object]] = PICK_CONTRACT) -> DataFrame:
    """The contract's columns in order, parsed tolerantly, with defaults for missing, null or empty values."""
    out = []
    for name, (kind, default) in contract.items():
        value = F.col(name).try_cast(kind) if name in df.columns else F.lit(None).cast(kind)
        if kind == "string":
            value = F.when(F.length(value) > 0, value)
        if name == "rank":
            value = F.when(value != 0, value)
        out.append((value if default is None else F.coalesce(value, F.lit(default).cast(kind))).alias(name))
    return df.select(*out)


def upsert_history(
    history: DataFrame, incoming: DataFrame, *, key: str = "pick_id", date: str = "game_date", outcome: str = "actual_hit_hr"
) -> DataFrame:
    """History after a publish: pending rows of re-published dates go, new rows win, resolved results survive.

    Both sides are unique on the key, so the full join is one to one. Columns that only history has are kept.
    """
    dates = incoming.select(date).distinct()
    republished = history.where(pending()).join(dates, date, "left_semi").select(key)
    kept = history.join(republished, key, "left_anti")
    columns = [c for c in history.columns if c != key]
    old = kept.select(key, F.struct(*columns).alias("__old"))
    new = incoming.select(key, F.struct(*[c for c in columns if c in incoming.columns]).alias("__new"))
    both = old.join(new, key, "full")
    survives = (F.col("__old.result_label").isin(*RESOLVED)) & (F.col("__new.result_label") == "Pending")
    keep_old = F.col("__new").isNull() | F.coalesce(survives, F.lit(False))
    out = []
    for c in columns:
        if c in ("result_label", outcome):
            out.append(F.when(keep_old, F.col(f"__old.{c}")).otherwise(F.col(f"__new.{c}")).alias(c))
        elif c in incoming.columns:
            out.append(F.when(F.col("__new").isNull(), F.col(f"__old.{c}")).otherwise(F.col(f"__new.{c}")).alias(c))
        else:
            out.append(F.col(f"__old.{c}").alias(c))
    return both.select(key, *out)


def upsert_replace(history: DataFrame, archived: DataFrame, *, key: str = "pick_id") -> DataFrame:
    """Archived rows replace history rows of the same id; rows without id are ignored on both sides."""
    known = F.coalesce(F.length(F.col(key)) > 0, F.lit(False))
    new = archived.where(known)
    return history.where(known).join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def recover_pending(
    current: DataFrame, history: DataFrame, *, key: str = "pick_id", date: str = "game_date", other_dates_only: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Move pending history rows back to the current board; returns (current, history).

    With ``other_dates_only`` rows of dates on the current board stay out of it and current rows win. Where there is no
    such row both sides stay as they are; else history loses all its pending rows, and the board has rows with an id only.
    Without it all pending rows with an id are recovered and win.
    """
    named = F.coalesce(F.length(F.col(key)) > 0, F.lit(False))
    lost = history.where(pending())
    if other_dates_only:
        dates = current.where(F.col(date).isNotNull()).select(date).distinct()
        lost = lost.join(dates, date, "left_anti")
        any_lost = lost.select(F.count(F.lit(1)) > 0).scalar()
        back = lost.where(named).join(current.select(key), key, "left_anti")
        board = back.unionByName(current.where(named | ~any_lost), allowMissingColumns=True)
        return board, history.where(~pending() | ~any_lost)
    lost = lost.where(named)
    recovered_wins = current.join(lost.select(key), key, "left_anti").unionByName(lost, allowMissingColumns=True)
    return recovered_wins, history.where(~pending())


# What a locked row takes from a newer one, and what its game gives where the row has nothing.
REFRESHED = ("top_reason_1", "top_reason_2", "top_reason_3", "weather_label", "temperature_f", "ballpark_name")
GAME_META = (
    "ballpark_name",
    "ballpark_region_abbr",
    "field_bearing_deg",
    "weather_code",
    "weather_label",
    "temperature_f",
    "wind_speed_mph",
    "wind_direction_deg",
)


def _usable(column: Column, kind: str) -> Column:
    return F.when(F.length(column) > 0, column) if kind == "string" else column


def _fill(rows: DataFrame, source: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Fields that a row has no value for, from the one row of its key in ``source``."""
    kinds = dict(rows.dtypes) | dict(source.dtypes)
    found = source.select(key, F.struct(*fields).alias("__source"))
    out = rows.join(found, key, "left")
    given = {c: _usable(F.col(f"__source.{c}"), kinds[c]) for c in fields}
    own = {c: _usable(F.col(c), kinds[c]) if c in rows.columns else F.lit(None) for c in fields}
    return out.withColumns({c: F.coalesce(own[c], given[c]) for c in fields}).drop("__source")


def locked_merge(
    existing: DataFrame,
    refreshed: DataFrame,
    games: DataFrame,
    *,
    day: Column,
    max_picks: int | None = None,
    refresh: Sequence[str] = REFRESHED,
    game_meta: Sequence[str] = GAME_META,
    parks: DataFrame | None = None,
    score: str = "predicted_hr_score",
    probability: str = "predicted_hr_probability",
    name: str = "batter_name",
) -> DataFrame:
    """The board after a publish during a day: rows of other dates as they are, then the day's rows ranked anew.

    Rows of started games stay, all other games take the refreshed rows. ``games`` has one row per game with its
    ``game_state``, and ``home_team`` if ``parks`` (one row per ``home_team``) is given. A locked row keeps identity
    and score; the columns in ``refresh`` come from the refreshed row with its id, else with its (game, batter), where
    that has a value. ``game_meta`` columns still missing come from a refreshed row of the game, then from its park.
    Where any row is locked, the day keeps the best ``max_picks`` rows; else all refreshed rows stay.
    """
    today = F.coalesce(F.col("game_date") == day, F.lit(False))
    state = games.select("game_pk", F.col("game_state").alias("__state"))
    started = F.coalesce("__state", "game_state") != "pregame"
    locked = existing.where(today).join(state, "game_pk", "left").where(started).drop("__state")

    kinds = dict(refreshed.dtypes)
    fields = [c for c in refresh if c in kinds and c in existing.columns]
    values = F.struct(*[_usable(F.col(c), kinds[c]).alias(c) for c in fields])
    newest = F.struct(F.coalesce("rank", F.lit(0)), "pick_id")
    by_id = refreshed.where(F.length("pick_id") > 0).groupBy("pick_id").agg(F.max_by(values, newest).alias("__by_id"))
    by_pair = (
        refreshed.where(F.col("game_pk").isNotNull() & F.col("batter_id").isNotNull())
        .groupBy("game_pk", "batter_id")
        .agg(F.max_by(values, newest).alias("__by_pair"))
    )
    kept = locked.join(by_id, "pick_id", "left").join(by_pair, ["game_pk", "batter_id"], "left")
    match = F.coalesce("__by_id", "__by_pair")
    kept = kept.withColumns({c: F.coalesce(match[c], F.col(c)) for c in fields}).drop("__by_id", "__by_pair")
    meta = [c for c in game_meta if c in kinds]
    if meta:
        per_game = refreshed.where(F.col("game_pk").isNotNull()).groupBy("game_pk").agg(F.max_by(F.struct(*meta), newest).alias("__m"))
        kept = _fill(kept, per_game.select("game_pk", "__m.*"), "game_pk", meta)
    if parks is not None:
        homes = games.select("game_pk", F.col("home_team").alias("__home"))
        places = parks.select(F.col("home_team").alias("__home"), *[c for c in game_meta if c in parks.columns])
        kept = _fill(kept.join(homes, "game_pk", "left"), places, "__home", places.columns[1:]).drop("__home")
    fresh = refreshed.join(locked.select("game_pk").distinct(), "game_pk", "left_anti")
    rows = kept.unionByName(fresh, allowMissingColumns=True).withColumn("__slate", F.lit(1))
    ranked = rerank(rows, slate=["__slate"], score=score, probability=probability, name=name, tie="pick_id").drop("__slate")
    ranked = ranked.withColumn("rank", F.col("rank").cast(dict(existing.dtypes).get("rank", "int")))
    if max_picks is not None:
        any_locked = locked.agg(F.count(F.lit(1)) > 0).scalar()
        ranked = ranked.where((F.col("rank") <= max_picks) | ~any_locked)
    return existing.where(~today).unionByName(ranked, allowMissingColumns=True)


def settle(
    picks: DataFrame,
    *,
    outcomes: DataFrame,
    boxscores: DataFrame,
    known_games: DataFrame,
    resolved_through: Column,
    outcome_key: Sequence[str] = ("game_pk", "batter_id"),
    games: DataFrame | None = None,
) -> DataFrame:
    """Label picks: boxscore, then dataset, then status; see the ladder in the code, whose order matters.

    ``outcomes`` is unique on ``outcome_key`` with ``hit_hr``; ``boxscores`` holds (game, batter) pairs with a hit;
    ``known_games`` the games whose boxscore was read. Picks carry ``game_state`` and ``game_status``; those of
    ``games`` (one row per game of the schedule) replace them where the game is known.
    """
    status = F.col("game_status")
    columns = picks.columns
    if games is not None:
        schedule = games.select("game_pk", F.col("game_state").alias("__state"), F.col("game_status").alias("__status"))
        picks = picks.join(schedule, "game_pk", "left").withColumns(
            {"game_state": F.coalesce("__state", "game_state"), "__row_status": status, "game_status": F.coalesce("__status", "game_status")}
        )
        status = F.concat_ws(" ", "game_status", "__row_status")
    scored = boxscores.select("game_pk", "batter_id", F.lit(True).alias("__in_box"))
    read = known_games.select("game_pk", F.lit(True).alias("__box_known"))
    known = outcomes.select(*outcome_key, F.col("hit_hr").alias("__hit"))
    joined = (
        picks.join(scored, ["game_pk", "batter_id"], "left")
        .join(read, "game_pk", "left")
        .join(known, list(outcome_key), "left")
    )
    date, label = F.col("game_date"), F.coalesce(F.col("result_label"), F.lit("Pending"))
    in_box = F.coalesce("__in_box", F.lit(False))
    box_known = F.coalesce("__box_known", F.lit(False))
    final = F.coalesce(F.col("game_state") == "final", F.lit(False))
    resolved = F.coalesce(date <= resolved_through, F.lit(False))
    unchanged = (
        (date.isNull() & label.isin(*RESOLVED)) | date.isNull() | (~resolved & ~final & ~box_known)
    )
    new_label = (
        F.when(unchanged, label)
        .when(in_box, "HR")
        .when(F.col("__hit").isNotNull(), F.when(F.col("__hit") > 0, "HR").otherwise("No HR"))
        .when(is_postponed(status), "Postponed")
        .when(final, F.when(box_known | resolved, "No HR").otherwise("Pending"))
        .otherwise("Pending")
    )
    outcome = F.when(F.col("__label") == "HR", 1).when(F.col("__label") == "No HR", 0)
    keeps = F.col("__unchanged")
    return (
        joined.withColumns({"__label": new_label, "__unchanged": unchanged})
        .withColumn("actual_hit_hr", F.when(keeps, F.col("actual_hit_hr")).otherwise(outcome))
        .withColumn("result_label", F.col("__label"))
        .select(*columns)
    )


def archive_dates(settled: DataFrame, games: DataFrame) -> DataFrame:
    """Per date of the board, whether it moves to history: all rows terminal, and all its games final (or none known)."""
    rows = settled.groupBy("game_date").agg(
        F.bool_and(F.col("result_label").isin(*RESOLVED)).alias("__terminal"), F.count(F.lit(1)).alias("picks")
    )
    finals = games.groupBy("game_date").agg(F.bool_and(F.col("game_state") == "final").alias("__final"))
    out = rows.join(finals, "game_date", "left")
    return out.select(
        "game_date", "picks", (F.col("__terminal") & F.coalesce("__final", F.lit(True))).alias("archived")
    )


def freshness_gate(schedule_day: Column, dataset_max: Column, trained_through: Column, tolerance: int = 7) -> dict[str, Column]:
    """Lags of data and model behind the schedule, and whether both are within tolerance."""
    lag_data, lag_model = F.datediff(schedule_day, dataset_max), F.datediff(schedule_day, trained_through)
    stale_data = F.coalesce(lag_data > tolerance, F.lit(True))
    stale_model = F.coalesce(lag_model > tolerance, F.lit(True))
    return {
        "dataset_lag_days": lag_data,
        "metadata_lag_days": lag_model,
        "dataset_stale": stale_data,
        "metadata_stale": stale_model,
        "passed": ~stale_data & ~stale_model,
    }


def assert_fresh(row) -> None:
    if not row["passed"]:
        raise ValueError(
            f"stale inputs: dataset lags {row['dataset_lag_days']} days, model lags {row['metadata_lag_days']} days"
        )


