"""Numeric and flag expressions. Comparisons with null give false, division by zero gives null."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretrace.functions import fixed_values as fv


def as_col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is unknown."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def safe_rate(num: str | Column, den: str | Column) -> Column:
    bottom = as_col(den).cast("double")
    return as_col(num).cast("double") / F.when(bottom != 0, bottom)


def clip(value: Column, low: float, high: float) -> Column:
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def no_nan(value: str | Column) -> Column:
    """NaN and infinities become null."""
    c = as_col(value)
    finite = ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    return F.when(finite, c)


def json_safe(value: str | Column) -> Column:
    return F.round(no_nan(value), 6)


def is_barrel(speed: str | Column, angle: str | Column) -> Column:
    ev, la = as_col(speed), as_col(angle)
    slack = 0.5 * F.greatest(ev - 98, F.lit(0.0))
    return flag((ev >= 98) & (la >= 26 - slack) & (la <= 30 + slack))


def spray_angle(x: str | Column, y: str | Column) -> Column:
    """Degrees from the centre line; coordinates may be text, and what does not parse gives null."""
    px, py = as_col(x).try_cast("double"), as_col(y).try_cast("double")
    return F.degrees(F.atan2(px - fv.SPRAY_CENTER_X, fv.SPRAY_HOME_Y - py))


def is_pull_air(bb_type: str | Column, stand: str | Column, spray: str | Column) -> Column:
    side, angle = as_col(stand), as_col(spray)
    pulled = ((side == "R") & (angle < -fv.PULL_DEGREES)) | ((side == "L") & (angle > fv.PULL_DEGREES))
    return flag(as_col(bb_type).isin(*fv.AIR_TYPES) & pulled)


def bucket_of(code: str | Column, buckets: Mapping[str, Sequence]) -> Column:
    """Name of the bucket that holds the upper-cased code, else null."""
    upper = F.upper(as_col(code))
    out = F.lit(None).cast("string")
    for name, members in reversed(list(buckets.items())):
        out = F.when(upper.isin(*members), F.lit(name)).otherwise(out)
    return out


def weather_label(code: str | Column) -> Column:
    value = as_col(code).try_cast("int")
    out = F.lit("Unknown")
    for name, members in reversed(list(fv.WEATHER_LABELS.items())):
        out = F.when(value.isin(*members), F.lit(name)).otherwise(out)
    return out


def batting_side(half: str | Column, away: str | Column, home: str | Column) -> dict[str, Column]:
    """Batting and fielding team of a half inning, and whether the home team bats."""
    top = F.coalesce(as_col(half) == "Top", F.lit(False))
    batting = F.when(top, as_col(away)).otherwise(as_col(home))
    fielding = F.when(top, as_col(home)).otherwise(as_col(away))
    return {"batting_team": batting, "fielding_team": fielding, "is_home": flag(batting == as_col(home))}


def event_flags(
    *,
    outcome: str = "events",
    hit: Sequence[str] = ("home_run",),
    at_bat: Sequence[str] = fv.AB_EVENTS,
    walk: Sequence[str] = fv.WALK_EVENTS,
    strikeout: Sequence[str] = fv.STRIKEOUT_EVENTS,
    speed: str = "launch_speed",
    angle: str = "launch_angle",
    bb_type: str = "bb_type",
    stand: str = "stand",
    x: str = "hc_x",
    y: str = "hc_y",
    description: str = "description",
) -> dict[str, Column]:
    """All 0/1 flags of one plate appearance; they sum to the counts of the rollups."""
    o, ev = F.col(outcome), F.col(speed)
    hard = flag(ev >= 95)
    return {
        "pa_count": F.lit(1),
        "ab_count": flag(o.isin(*at_bat)),
        "hr_count": flag(o.isin(*hit)),
        "is_bb": flag(o.isin(*walk)),
        "is_k": flag(o.isin(*strikeout)),
        "bbe_count": flag(ev.isNotNull()),
        "barrel_count": is_barrel(speed, angle),
        "hard_hit_bbe_count": hard,
        "ev_95plus_bbe_count": hard,
        "fly_ball_bbe_count": flag(F.col(bb_type).isin(*fv.FLY_TYPES)),
        "pull_air_bbe_count": is_pull_air(bb_type, stand, spray_angle(x, y)),
        "contact_event_count": flag(F.col(description).isin(*fv.CONTACT_DESCRIPTIONS)),
        "swing_event_count": flag(F.col(description).isin(*fv.SWING_DESCRIPTIONS)),
    }


def platoon_advantage(bat_side: str | Column, pitch_hand: str | Column) -> Column:
    return (as_col(bat_side) != as_col(pitch_hand)).cast("double")


def starter_proxy(batters_faced: str | Column) -> Column:
    return F.when(as_col(batters_faced) >= 12, "starter_like").otherwise("bullpen_like")


def by_hand(hand: str | Column, left: str | Column, right: str | Column) -> Column:
    """The left-hand column for hand L, the right-hand column for everything else."""
    return F.when(as_col(hand) == "L", as_col(left)).otherwise(as_col(right))


def interactions(pairs: Mapping[str, tuple[str, str]]) -> dict[str, Column]:
    return {name: F.col(a) * F.col(b) for name, (a, b) in pairs.items()}


def slot_to_pa(slot: str | Column) -> Column:
    return clip(4.65 - 0.08 * (as_col(slot).cast("double") - 1.0), 3.6, 4.8)


def pa_to_slot(expected: str | Column) -> Column:
    return clip(1.0 + (4.65 - as_col(expected).cast("double")) / 0.08, 1.0, 9.0)


def confirmation_score(count: str | Column, std: str | Column, source: str | Column | None = None) -> Column:
    """How sure a lineup slot is: 1 if confirmed, else from the length and the spread of the slot history."""
    n, spread = as_col(count).cast("double"), F.coalesce(as_col(std).cast("double"), F.lit(0.0))
    score = clip(0.35 + 0.65 * (n / (n + 2.0)) * (1.0 / (1.0 + spread)), 0.35, 1.0)
    out = F.when(n > 0, score).otherwise(0.35)
    if source is None:
        return out
    return F.when(F.lower(F.trim(as_col(source))) == "confirmed", 1.0).otherwise(out)


def projected_score(source: str | Column, projected: str | Column) -> Column:
    """The same score where no slot history exists."""
    confirmed = F.lower(F.trim(as_col(source))) == "confirmed"
    return F.when(confirmed, 1.0).when(as_col(projected), 0.75).otherwise(0.35)


def relative_sector(direction: str | Column, bearing: str | Column) -> Column:
    """Arrow of the direction the wind blows to, relative to the field, in 8 sectors of 45 degrees."""
    relative = F.pmod(as_col(direction).cast("double") + 180 - as_col(bearing).cast("double"), F.lit(360.0))
    sector = F.pmod(F.floor((relative + 22.5) / 45), F.lit(8)).cast("int")
    arrows = F.array(*[F.lit(a) for a in fv.WIND_ARROWS])
    return F.coalesce(F.element_at(arrows, sector + 1), F.lit(""))


def local_hour(utc: str | Column, zone: str | Column) -> Column:
    """Hour of the day at a place, from a UTC time; clock changes follow the zone's rules."""
    return F.hour(F.from_utc_timestamp(as_col(utc), as_col(zone)))


def local_day(utc: str | Column, zone: str | Column) -> Column:
    return F.from_utc_timestamp(as_col(utc), as_col(zone)).cast("date")


def local_to_utc(local: str | Column, zone: str | Column) -> Column:
    """UTC time of a wall-clock time: times that the clock skips move forward, doubled ones take standard time."""
    wall, place = as_col(local), as_col(zone)
    utc = F.to_utc_timestamp(wall, place)
    hour_later = utc + F.expr("interval 1 hour")
    return F.when(F.from_utc_timestamp(hour_later, place) == wall, hour_later).otherwise(utc)


def tier_value(tier: str | Column) -> Column:
    token = F.lower(F.trim(F.coalesce(as_col(tier), F.lit(""))))
    out = F.lit(-1)
    for rank, name in enumerate(fv.TIER_ORDER):
        out = F.when(token == name, rank).otherwise(out)
    return out


def tier_of(percentile: str | Column, floors: Mapping[str, float] | None = None, default: str = "longshot") -> Column:
    p = as_col(percentile)
    out = F.lit(default)
    for name, floor in sorted((floors or fv.TIER_FLOORS).items(), key=lambda item: item[1]):
        out = F.when(p >= floor, F.lit(name)).otherwise(out)
    return out


def select_present(df: DataFrame, profile: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """The columns of a named profile that the table has, in profile order."""
    return df.select(*extra, *[c for c in profile if c in df.columns and c not in extra])
