"""Event rollups: one row per entity and game, opponents, mixes, votes and summaries.

Every operator is a map-side combined ``groupBy``, or a ranking that keeps the first row (which Spark also limits
before the shuffle), so hot keys are reduced before they move.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretrace.functions import fixed_values as fv
from foretrace.functions.scalar import as_col, flag, safe_rate
from foretrace.operators.joins import attach_dim


def sort_key(order: Sequence[str]) -> Column:
    """One column stays plain, so that fixed-width values can be aggregated by hashing."""
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def first_known(value: str | Column, order: Sequence[str]) -> Column:
    """First non-null value in the given order."""
    c = as_col(value)
    return F.min_by(c, F.when(c.isNotNull(), sort_key(order)))


def last_known(value: str | Column, order: Sequence[str]) -> Column:
    c = as_col(value)
    return F.max_by(c, F.when(c.isNotNull(), sort_key(order)))


def rollup(
    df: DataFrame,
    *,
    keys: Sequence[str],
    order: Sequence[str],
    firsts: Mapping[str, str | Column] | None = None,
    sums: Mapping[str, str | Column] | None = None,
    means: Mapping[str, str | Column] | None = None,
    maxes: Mapping[str, str | Column] | None = None,
    mins: Mapping[str, str | Column] | None = None,
) -> DataFrame:
    """One row per key; sums of nothing are 0, means and extremes of nothing are null."""
    aggregates = [first_known(c, order).alias(n) for n, c in (firsts or {}).items()]
    aggregates += [F.coalesce(F.sum(as_col(c)), F.lit(0)).alias(n) for n, c in (sums or {}).items()]
    aggregates += [F.avg(as_col(c)).alias(n) for n, c in (means or {}).items()]
    aggregates += [F.max(as_col(c)).alias(n) for n, c in (maxes or {}).items()]
    aggregates += [F.min(as_col(c)).alias(n) for n, c in (mins or {}).items()]
    return df.groupBy(*keys).agg(*aggregates)


def side_code(side: str) -> Column:
    """A one-letter side as a number, so that the first one is found in a hash aggregate; null and empty have none."""
    return F.nullif(F.ascii(side), F.lit(0))


def batter_games(pa: DataFrame, *, order: Sequence[str]) -> DataFrame:
    """Plate appearances to one row per batter and game; sides are single letters."""
    out = rollup(
        pa,
        keys=["game_pk", "game_date", "batter_id"],
        order=order,
        firsts={
            "team": "batting_team",
            "opponent": "fielding_team",
            "bat_side": side_code("stand"),
            "pitcher_hand": side_code("p_throws"),
        },
        maxes={"is_home": "is_home", "max_exit_velocity": "launch_speed"},
        mins={"batting_order": "batting_order"},
        sums={
            "pa_count": "pa_count",
            "ab_count": "ab_count",
            "hr_count": "hr_count",
            "bbe_count": "bbe_count",
            "barrel_count": "barrel_count",
            "hard_hit_bbe_count": "hard_hit_bbe_count",
            "batter_k_count": "is_k",
            "batter_bb_count": "is_bb",
            "ev_95plus_bbe_count": "ev_95plus_bbe_count",
            "fly_ball_bbe_count": "fly_ball_bbe_count",
            "pull_air_bbe_count": "pull_air_bbe_count",
        },
        means={"avg_launch_angle": "launch_angle", "avg_exit_velocity": "launch_speed"},
    )
    sides = {c: F.char(c) for c in ("bat_side", "pitcher_hand")}
    return out.withColumns(sides | {"hit_hr": flag(F.col("hr_count") > 0)})


HANDED = {
    "pa_against": "pa_count",
    "hr_allowed": "hr_count",
    "bbe_allowed": "bbe_count",
    "barrels_allowed": "barrel_count",
    "hard_hit_bbe_allowed": "hard_hit_bbe_count",
    "ev_95plus_bbe_allowed": "ev_95plus_bbe_count",
}


def pitcher_games(pa: DataFrame, *, order: Sequence[str]) -> DataFrame:
    """Plate appearances to one row per pitcher and game, with the six counts also split by the batter's side."""
    handed = {
        f"{name}_{side.lower()}hb": F.when(F.col("stand") == side, F.col(c)).otherwise(0)
        for name, c in HANDED.items()
        for side in ("R", "L")
    }
    out = rollup(
        pa,
        keys=["game_pk", "game_date", "batting_team", "fielding_team", "pitcher_id"],
        order=order,
        firsts={"p_throws": side_code("p_throws")},
        sums={
            **HANDED,
            "fb_allowed": "fly_ball_bbe_count",
            "pitcher_k_count": "is_k",
            "pitcher_bb_count": "is_bb",
            "batters_faced": "pa_count",
            "outs_recorded": "ab_count",
            **handed,
        },
        means={"avg_ev_allowed": "launch_speed"},
        maxes={"max_ev_allowed": "launch_speed"},
    )
    out = out.withColumnsRenamed({"batting_team": "team", "fielding_team": "opponent"})
    return out.withColumns({"p_throws": F.char("p_throws"), "innings_pitched_est": F.col("outs_recorded") / F.lit(3.0)})


def most_frequent(
    df: DataFrame, *, keys: Sequence[str], value: str, count: str = "votes", weight: str | Column | None = None
) -> DataFrame:
    """Per key the value with most rows (or most weight); ties go to the smallest value."""
    votes = F.count(F.lit(1)) if weight is None else F.sum(as_col(weight))
    counted = df.groupBy(*keys, value).agg(votes.alias(count))
    best = Window.partitionBy(*keys).orderBy(F.desc(count), F.asc(value))
    return counted.withColumn("__rank", F.row_number().over(best)).where("__rank = 1").drop("__rank")


def primary_opponent(pitcher_game: DataFrame) -> DataFrame:
    """Per game and team the opposing pitcher who faced most batters; ties go to the smallest id."""
    best = Window.partitionBy("game_pk", "team").orderBy(F.desc("batters_faced"), F.asc("pitcher_id"))
    return (
        pitcher_game.withColumn("__rank", F.row_number().over(best))
        .where("__rank = 1")
        .select(
            "game_pk",
            "team",
            "opponent",
            F.col("pitcher_id").alias("opp_pitcher_id"),
            F.col("p_throws").alias("pitch_hand_primary"),
            F.col("batters_faced").alias("opp_pitcher_bf"),
        )
    )


def mix_counts(events: DataFrame, *, keys: Sequence[str], code: str) -> DataFrame:
    """Number of typed events per key, in total and per coarse and granular bucket."""
    buckets = {**fv.COARSE_BUCKETS, **fv.GRANULAR_BUCKETS}
    return (
        events.where(F.col(code).isNotNull())
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("total_pitches"),
            *[F.sum(flag(F.col(code).isin(*members))).alias(name) for name, members in buckets.items()],
        )
    )


def bucket_counts(pa: DataFrame, *, keys: Sequence[str], buckets: Sequence[Column], sums: Mapping[str, str]) -> DataFrame:
    """Counts per key and bucket, where one row may fall into several buckets."""
    exploded = pa.withColumn("bucket", F.explode(F.array_compact(F.array(*buckets))))
    return exploded.groupBy(*keys, "bucket").agg(*[F.sum(c).alias(n) for n, c in sums.items()])


def shrunk_index(
    pa: DataFrame, *, group: str, num: str, den: str, side: str, prior: float = 50.0, name: str = "park_factor_hr"
) -> DataFrame:
    """Index of a group's rate against the overall rate (100 = equal), shrunk by ``prior`` units; all, L and R."""
    measures = {f"{m}_{s}": F.when(F.col(side) == s, F.col(m)).otherwise(0) for m in (num, den) for s in ("L", "R")}
    sums = {num: F.col(num), den: F.col(den), **measures}
    groups = pa.groupBy(group).agg(*[F.sum(c).cast("double").alias(n) for n, c in sums.items()])
    league = pa.agg(safe_rate(F.sum(num), F.sum(den)).alias("rate")).scalar()

    def index(top: str, bottom: str) -> Column:
        rate = (F.col(top) + prior * F.col("__league")) / (F.col(bottom) + prior)
        return rate / F.nullif(F.col("__league"), F.lit(0.0)) * 100.0

    return groups.withColumn("__league", league).select(
        group,
        index(num, den).alias(name),
        index(f"{num}_L", f"{den}_L").alias(f"{name}_vs_lhb"),
        index(f"{num}_R", f"{den}_R").alias(f"{name}_vs_rhb"),
    )


def shrunk_index_as_of(
    pa: DataFrame, *, group: str, date: str, num: str, den: str, prior: float = 50.0, name: str = "park_factor_hr"
) -> DataFrame:
    """The same index per group and day from earlier days only (per-day totals are bounded by the calendar)."""
    daily = pa.groupBy(group, date).agg(F.sum(num).alias("__n"), F.sum(den).alias("__d"))
    overall = pa.groupBy(date).agg(F.sum(num).alias("__ln"), F.sum(den).alias("__ld"))
    before = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
    overall = overall.select(date, safe_rate(F.sum("__ln").over(before), F.sum("__ld").over(before)).alias("__league"))
    mine = Window.partitionBy(group).orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
    daily = daily.withColumns({c: F.coalesce(F.sum(c).over(mine), F.lit(0)).cast("double") for c in ("__n", "__d")})
    league = F.col("__league")
    rate = (F.col("__n") + prior * league) / (F.col("__d") + prior) / F.nullif(league, F.lit(0.0)) * 100.0
    return daily.join(overall, date).select(group, date, rate.alias(name))


def id_stability(df: DataFrame, *, entity: str, name: str, limit: int = 2) -> DataFrame:
    """One row: ids with a name, share of them with at most ``limit`` distinct names, ids with more than one."""
    known = df.where(F.col(entity).isNotNull() & F.col(name).isNotNull())
    per_id = known.groupBy(entity).agg(F.countDistinct(name).alias("names"))
    return per_id.agg(
        F.count(F.lit(1)).alias("ids"),
        F.avg((F.col("names") <= limit).cast("double")).alias("stable_share"),
        F.coalesce(F.sum(flag(F.col("names") > 1)), F.lit(0)).alias("unstable_ids"),
    )


def weighted_rollup(
    df: DataFrame, *, keys: Sequence[str], sums: Mapping[str, str], means: Mapping[str, tuple[str, str]]
) -> DataFrame:
    """Sums, and means weighted by a count column (rows without a value do not weigh)."""
    aggregates = [F.sum(c).alias(n) for n, c in sums.items()]
    for name, (value, weight) in means.items():
        known = F.col(value).isNotNull()
        top = F.sum(F.when(known, F.col(value) * F.col(weight)))
        bottom = F.sum(F.when(known, F.col(weight)))
        aggregates.append(safe_rate(top, bottom).alias(name))
    return df.groupBy(*keys).agg(*aggregates)


def pool_summary(
    df: DataFrame,
    *,
    keys: Sequence[str],
    order: Sequence[str],
    date: str,
    game: str,
    volume: str,
    latest: Sequence[str],
    start_at: int = 3,
) -> DataFrame:
    """Summary of each entity's recent games: latest known values, games, starts, mean volume, last date."""
    return df.groupBy(*keys).agg(
        *[last_known(c, order).alias(c) for c in latest],
        F.max(date).alias("last_game_date"),
        F.countDistinct(game).alias("recent_games"),
        F.sum(flag(F.col(volume) >= start_at)).alias("recent_starts"),
        F.avg(volume).alias("avg_recent_pa"),
    )


def season_leaders(
    df: DataFrame,
    *,
    entity: str,
    date: str,
    game: str,
    value: str,
    volume: str,
    order: Sequence[str],
    name: str,
    latest: Sequence[str] = (),
    year: int | Column,
    top: int = 5,
) -> DataFrame:
    """The ``top`` entities of a year by a summed value, then by volume, games and name."""
    first, after = (F.make_date(F.lit(year) + n, F.lit(1), F.lit(1)) for n in (0, 1))
    in_year = df.where((F.col(date) >= first) & (F.col(date) < after) & F.col(entity).isNotNull())
    totals = in_year.groupBy(entity).agg(
        F.coalesce(F.sum(value), F.lit(0)).alias("total"),
        F.coalesce(F.sum(volume), F.lit(0)).alias("volume"),
        F.countDistinct(game).alias("games"),
        *[last_known(c, order).alias(c) for c in (name, *latest)],
    )
    return totals.orderBy(F.desc("total"), F.desc("volume"), F.desc("games"), F.asc(name), F.asc(entity)).limit(top)


def source_profile(df: DataFrame, *, date: str, capabilities: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows, date range, and which uses the columns of the table allow."""
    able = [F.lit(all(c in df.columns for c in need)).alias(name) for name, need in capabilities.items()]
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.min(date).alias("date_min"), F.max(date).alias("date_max")).select(
        "*", *able
    )


def park_of(df: DataFrame, parks: DataFrame, *, team: str, opponent: str, is_home: str, key: str) -> DataFrame:
    """Attach the park of the home side."""
    home = df.withColumn(key, F.when(F.col(is_home) == 1, F.col(team)).otherwise(F.col(opponent)))
    return attach_dim(home, parks, on=[key])


def capped_dense_rank(df: DataFrame, *, keys: Sequence[str], value: str, cap: int, name: str) -> DataFrame:
    """``least(dense_rank, cap)`` within ``keys``, null where the value is null.

    One exchange and one window: the keys are a team in a game, whose plate appearances the rules of a game bound.
    """
    place = F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last(value)))
    return df.withColumn(name, F.when(F.col(value).isNotNull(), F.least(place, F.lit(cap))))
