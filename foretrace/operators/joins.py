"""Joins with declared cardinality, dimension lookups, fallbacks and nearest observations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretrace.functions.scalar import flag


def attach_dim(df: DataFrame, dim: DataFrame, *, on: Sequence[str]) -> DataFrame:
    """Left join to a dimension. The join strategy follows the measured size of the dimension (adaptive execution):
    a small one is broadcast, a large one is shuffled with skewed partitions split."""
    return df.join(dim, list(on), "left")


def key_counts(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def join_audit(
    left: DataFrame, right: DataFrame, *, on: Sequence[str], tracked: Sequence[str] = (), how: str = "left"
) -> DataFrame:
    """One row about a join, from the row counts per key and without making its rows.

    Null keys match nothing. ``duplicates`` count rows beyond the first of each key. Counts are decimal(38, 0), as the rows
    of a join can outgrow a long.
    """
    keys = list(on)
    left_counts = key_counts(left, keys, "__l")
    known = [F.count(F.col(c)).alias(f"__known_{c}") for c in tracked]
    right_counts = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("__r"), *known)
    both = left_counts.join(right_counts, keys, "full")
    n_left, n_right = F.coalesce("__l", F.lit(0)).cast("decimal(19,0)"), F.coalesce("__r", F.lit(0)).cast("decimal(19,0)")
    rows = n_left * n_right
    if how in ("left", "outer", "full"):
        rows = F.when(n_right == 0, n_left).otherwise(rows)
    if how in ("outer", "full"):
        rows = F.when(n_left == 0, n_right).otherwise(rows)
    total = {
        "left_rows": F.sum(n_left),
        "right_rows": F.sum(n_right),
        "left_duplicates": F.sum(F.greatest(n_left - 1, F.lit(0))),
        "right_duplicates": F.sum(F.greatest(n_right - 1, F.lit(0))),
        "matched_rows": F.sum(F.when(n_right > 0, n_left).otherwise(0)),
        "unmatched_rows": F.sum(F.when(n_right == 0, n_left).otherwise(0)),
        "output_rows": F.sum(rows),
        **{f"non_null_{c}": F.sum(n_left * F.coalesce(f"__known_{c}", F.lit(0)).cast("decimal(19,0)")) for c in tracked},
    }
    return both.agg(*[F.coalesce(c, F.lit(0)).cast("decimal(38,0)").alias(n) for n, c in total.items()])


def require_unique(df: DataFrame, keys: Sequence[str], side: str) -> None:
    """Raise if a key has two rows."""
    offenders = key_counts(df, keys, "n").where("n > 1").orderBy(*keys).take(10)
    if offenders:
        raise ValueError(f"{side} side must be unique on {list(keys)}; offending keys: {[r.asDict() for r in offenders]}")


def audited_join(
    left: DataFrame,
    right: DataFrame,
    *,
    on: Sequence[str],
    how: str = "left",
    validate: str = "many_to_one",
    null_safe: bool = False,
) -> DataFrame:
    """Join after checking the declared cardinality with one aggregate per constrained side.

    ``null_safe`` lets null keys match each other (left and inner joins).
    """
    if validate not in ("one_to_one", "many_to_one", "one_to_many", "many_to_many"):
        raise ValueError(f"unknown cardinality {validate}")
    if validate.startswith("one_"):
        require_unique(left, on, "left")
    if validate.endswith("_one"):
        require_unique(right, on, "right")
    if not null_safe:
        return left.join(right, list(on), how)
    renamed = right.withColumnsRenamed({c: f"__right_{c}" for c in on})
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"__right_{c}"))
    return left.join(renamed, same, how).drop(*[f"__right_{c}" for c in on])


def coalesce_columns(df: DataFrame, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Replace suffixed pairs by one column: the right value, else the left one."""
    filled = df.withColumns({name: F.coalesce(F.col(right), F.col(left)) for name, (left, right) in pairs.items()})
    return filled.drop(*[c for pair in pairs.values() for c in pair if c not in pairs])


def outer_combine(blocks: Mapping[str, DataFrame], *, on: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Full outer combination of blocks with the same key, as one union and one aggregate instead of a join chain.

    Each block is unique on the key; measures come out as ``<measure>_<block>``.
    """
    tagged = [b.select(*on, *measures, F.lit(name).alias("__block")) for name, b in blocks.items()]
    stacked = tagged[0]
    for other in tagged[1:]:
        stacked = stacked.unionByName(other)
    return stacked.groupBy(*on).agg(
        *[
            F.max(F.when(F.col("__block") == name, F.col(m))).alias(f"{m}_{name}")
            for name in blocks
            for m in measures
        ]
    )


def nearest_hour(
    schedule: DataFrame, observations: DataFrame, *, on: Sequence[str], hour: str, values: Sequence[str], target: int = 19
) -> DataFrame:
    """Per scheduled key the observation whose hour is nearest to ``target`` (ties: the earlier hour), else nulls."""
    distance = F.struct(F.abs(F.col(hour) - target), F.col(hour))
    best = observations.groupBy(*on).agg(
        F.min_by(F.struct(hour, *values), distance).alias("__best"), F.count(F.lit(1)).alias("__n")
    )
    joined = schedule.join(best, list(on), "left")
    return joined.select(
        *schedule.columns, "__best.*", flag(F.col("__n").isNull()).alias("missing")
    )


def fallback_fill(
    fresh: DataFrame, cached: DataFrame, *, on: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """Fresh rows, their gaps filled per column from the cached row of the same key, with the source of the row."""
    old = cached.select(*on, *[F.col(c).alias(f"__old_{c}") for c in values], F.lit(True).alias("__cached"))
    joined = fresh.join(old, list(on), "left")
    any_fresh = F.lit(False)
    for c in values:
        any_fresh = any_fresh | F.col(c).isNotNull()
    filled = {c: F.coalesce(F.col(c), F.col(f"__old_{c}")) for c in values}
    source = F.when(any_fresh, "fresh").when(F.col("__cached"), "cached").otherwise("null")
    return joined.select(*on, source.alias("source"), *[c.alias(n) for n, c in filled.items()])


def snapshot_fill(df: DataFrame, snapshot: DataFrame, *, on: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Fill null features from the entity's snapshot row."""
    renamed = snapshot.select(*on, *[F.col(c).alias(f"__snap_{c}") for c in columns])
    joined = df.join(renamed, list(on), "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.col(f"__snap_{c}")) for c in columns}).drop(
        *[f"__snap_{c}" for c in columns]
    )


def recent_games(df: DataFrame, *, team: str, date: str, game: str, k: int = 3) -> DataFrame:
    """The rows of each team's last ``k`` distinct games."""
    newest = Window.partitionBy(team).orderBy(F.desc(date), F.desc(game))
    games = df.select(team, date, game).distinct().withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= k)
    return df.join(games.drop("__n"), [team, date, game], "left_semi")


def slate_sides(games: DataFrame, *, shared: Sequence[str], home: Mapping[str, str], away: Mapping[str, str]) -> DataFrame:
    """One row per game and side: ``home``/``away`` map output names to the columns of that side."""

    def side(label: int, columns: Mapping[str, str]) -> Column:
        return F.struct(F.lit(label).alias("is_home"), *[F.col(c).alias(n) for n, c in columns.items()])

    return games.select(*shared, F.explode(F.array(side(0, away), side(1, home))).alias("__side")).select(
        *shared, "__side.*"
    )


def rank_movement(
    board: DataFrame, baseline: DataFrame, *, keys: Sequence[str], name: str, rank: str
) -> DataFrame:
    """Current board with the baseline rank of the same game, entity and lower-cased name."""
    key = "__name_key"
    base = baseline.select(*keys, F.lower(name).alias(key), F.col(rank).alias("morning_rank"))
    out = board.withColumn(key, F.lower(name)).join(base, [*keys, key], "left").drop(key)
    return out.withColumn("movement", F.col("morning_rank") - F.col(rank))


def fill_alerts(filled: DataFrame, *, by: str, date: str, source: str = "source") -> DataFrame:
    """Of a filled table, per place and source other than fresh: how many dates reuse a cached value or have none, and
    between which days."""
    stale = filled.where(F.col(source) != "fresh")
    return stale.groupBy(by, source).agg(
        F.countDistinct(date).alias("dates"), F.min(date).alias("first_date"), F.max(date).alias("last_date")
    )
