"""Deterministic ranks, top-k, percentiles and capped selection."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foretrace.operators.scan import range_positions, ranks


def dedup(df: DataFrame, *, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key in the given order; Spark keeps one row per key and task before it shuffles."""
    return topk(df, keys=keys, order=order, k=1)


def topk(df: DataFrame, *, keys: Sequence[str], order: Sequence[Column], k: int, name: str | None = None) -> DataFrame:
    """The first ``k`` rows per key, limited per task before the shuffle; ``name`` keeps the rank."""
    rank = name or "__rank"
    out = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)
    return out if name else out.drop(rank)


def board_order(df: DataFrame, *, score: str, rank: str, name: str, date: str | None = None) -> DataFrame:
    """Board order: newest date first if asked, best score first with unknown scores last, then rank and name."""
    keys = [F.desc(date)] if date else []
    return df.orderBy(*keys, F.desc_nulls_last(score), F.asc_nulls_last(rank), F.asc(name))


def slate_percentile(df: DataFrame, *, slate: str, score: str, tie: str) -> DataFrame:
    """Rank (1 = best) and percentile ``position / count`` of each row among the scored rows of its slate.

    No slate is sorted in one task; equal scores keep the tie order in both directions; unknown scores get nulls.
    """
    out = ranks(df, keys=[slate], value=score, tie=tie, best="slate_rank", lowest="__up", total="__of")
    return out.withColumn("slate_percentile", F.col("__up").cast("double") / F.col("__of")).drop("__up", "__of")


def lineup_rank(
    df: DataFrame, *, keys: Sequence[str], expected: Column, score: Column, slot: Column, entity: str
) -> DataFrame:
    """Order of a lineup by expected volume, certainty, slot and id (a lineup has one row per player of one game)."""
    order = [expected.desc_nulls_last(), score.desc_nulls_last(), slot.asc_nulls_last(), F.asc(entity)]
    return df.withColumn("projected_lineup_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def rerank(df: DataFrame, *, slate: Sequence[str], score: str, probability: str, name: str, tie: str, rank: str = "rank") -> DataFrame:
    """Number a slate's rows 1..n by score, probability, name and tie key; unknown values come last.

    Rows are dealt by ranges of all of these, so neither a narrow range of scores nor rows without any crowd a task.
    """
    last = F.lit(float("inf"))
    down, down_probability = (F.coalesce(-F.col(c).cast("double"), last) for c in (score, probability))
    order = [down.asc(), down_probability.asc(), F.coalesce(F.col(name), F.lit("")).asc(), F.asc(tie)]
    return range_positions(df, keys=slate, order=order, name=rank)


def known(column: str, kind: str) -> Column:
    """The key, or null where it is unknown: null, or an empty text."""
    return F.when(F.length(column) > 0, F.col(column)) if kind == "string" else F.col(column)


def select_greedy(
    rows: pd.DataFrame, *, team: str, game: str, team_cap: int | None, game_cap: int | None, limit: int | None
) -> list[bool]:
    """Walk rows in order; take a row while its team, its game and the board have room. Unknown keys have no cap."""
    room = [({}, team, team_cap), ({}, game, game_cap)]
    taken, keep = 0, []
    for values in zip(rows[team], rows[game]):
        capped = [(used, v, cap) for (used, _, cap), v in zip(room, values) if cap is not None and not pd.isna(v) and v != ""]
        fits = (limit is None or taken < limit) and all(used.get(v, 0) < cap for used, v, cap in capped)
        keep.append(fits)
        if fits:
            taken += 1
            for used, v, _ in capped:
                used[v] = used.get(v, 0) + 1
    return keep


def selection_order(score: str, tie: str, probability: str | None = None, name: str | None = None) -> list[Column]:
    """Best score first, then probability, name and tie key; unknown scores last."""
    further = [F.desc_nulls_last(probability)] if probability else []
    return [F.desc_nulls_last(score), *further, *([F.asc_nulls_last(name)] if name else []), F.asc(tie)]


def _bounded(df: DataFrame, slate: str, team: Column, game: Column, order: list[Column], team_cap: int | None, game_cap: int | None, limit: int) -> DataFrame:
    """The rows of each slate that its walk can reach; the result of the walk does not change.

    Of the rows that share a team and a game (or whichever of them is known and capped) none beyond the smaller cap can
    be taken: either all before it were and reached the cap, or a cap refused one and stays reached. Of what is left, the
    walk sees the rows it takes and those it refuses; refused rows belong to teams or games that are full at its end,
    of which there are at most limit / cap, each with no more rows than the largest has.
    """
    marked = df.withColumns({"__team": team if team_cap is not None else F.lit(None), "__game": game if game_cap is not None else F.lit(None)})
    marked = marked.withColumns({"__team": F.col("__team").cast("string"), "__game": F.col("__game").cast("string")})
    own = F.least(F.when(F.col("__team").isNotNull(), team_cap), F.when(F.col("__game").isNotNull(), game_cap), F.lit(limit))
    most = max(limit, team_cap or 0, game_cap or 0)
    few = topk(marked, keys=[slate, "__team", "__game"], order=order, k=most, name="__place").where(F.col("__place") <= own)
    widest = []
    for key, cap in (("__team", team_cap), ("__game", game_cap)):
        if cap:
            sizes = few.where(F.col(key).isNotNull()).groupBy(slate, key).agg(F.count(F.lit(1)).alias("n"))
            widest.append(F.lit(limit // cap) * sizes.agg(F.coalesce(F.max("n"), F.lit(0))).scalar())
    reach = few.sparkSession.range(1).select(sum(widest, F.lit(limit)).alias("reach")).first()["reach"]
    return topk(few, keys=[slate], order=order, k=reach).drop("__place")


def greedy_caps(
    df: DataFrame,
    *,
    slate: str,
    team: str,
    game: str,
    score: str,
    tie: str,
    team_cap: int | None,
    game_cap: int | None,
    limit: int,
    probability: str | None = None,
    name: str | None = None,
) -> DataFrame:
    """Greedy selection per slate under a cap per team and per game, exact also when a team plays twice.

    A cap of None is no cap, and rows whose team or game is unknown (null or empty) are not held by that cap. Apply a
    minimum tier before. What one slate's walk sees is bounded by the caps and the limit (see ``_bounded``), which takes
    a count over the rows when this is called.
    """
    kinds = dict(df.dtypes)
    order = selection_order(score, tie, probability, name)
    few = _bounded(df, slate, known(team, kinds[team]), known(game, kinds[game]), order, team_cap, game_cap, limit)
    few = few.drop("__team", "__game")
    by = [c for c in (score, probability, name, tie) if c]
    up = [c in (name, tie) for c in by]

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values(by, ascending=up, na_position="last")
        keep = select_greedy(ordered, team=team, game=game, team_cap=team_cap, game_cap=game_cap, limit=limit)
        chosen = ordered[keep].copy()
        chosen["board_rank"] = range(1, len(chosen) + 1)
        return chosen

    schema = T.StructType([*few.schema.fields, T.StructField("board_rank", T.IntegerType())])
    return few.groupBy(slate).applyInPandas(walk, schema)


def nested_caps(
    df: DataFrame,
    *,
    slate: str,
    team: str,
    game: str,
    score: str,
    tie: str,
    team_cap: int | None,
    game_cap: int | None,
    limit: int,
    probability: str | None = None,
    name: str | None = None,
) -> DataFrame:
    """The same selection by ranks alone, for slates in which every team plays one game."""
    order, kinds, rows = selection_order(score, tie, probability, name), dict(df.dtypes), df
    for key, cap in ((team, team_cap), (game, game_cap)):
        if cap is not None:
            rows = rows.withColumn("__key", known(key, kinds[key]))
            held = topk(rows.where(F.col("__key").isNotNull()), keys=[slate, "__key"], order=order, k=cap)
            rows = held.unionByName(rows.where(F.col("__key").isNull())).drop("__key")
    return topk(rows, keys=[slate], order=order, k=limit, name="board_rank")


def recent_hits(df: DataFrame, *, date: str, day: Column, label: str, order: Sequence[Column], top: int = 25) -> DataFrame:
    return df.where((F.col(date) == day) & (F.col(label) == "HR")).orderBy(*order).limit(top)
