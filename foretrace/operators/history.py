"""Point-in-time history features: nothing a feature sees is later than, or equal to, its own row.

Day windows exclude the whole current day; to-date and previous-row features follow row position, so that the second
game of a day sees the first one. All of them pre-aggregate to one row per (entity, day), whose window size is bounded
by the calendar, instead of sorting all rows of an entity in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretrace.functions.scalar import as_col, safe_rate
from foretrace.operators.scan import all_present, prior_sums
from foretrace.session import cut_lineage


def day_number(date: str | Column) -> Column:
    return F.datediff(as_col(date), F.lit("1970-01-01").cast("date"))


def trailing_days(
    df: DataFrame,
    *,
    keys: Sequence[str],
    date: str,
    days: Sequence[int],
    sums: Mapping[str, str | Column],
    maxes: Mapping[str, str | Column] | None = None,
    running: Mapping[str, str | Column] | None = None,
) -> DataFrame:
    """One row per (keys, day) with ``<name>_last_<n>d`` over the days ``[day - n, day)``; null if none of them has rows.

    All measures and all window lengths come from one aggregate, one exchange and one sort. ``running`` sums come under their
    own names, over all days before, of which an unknown one is the first.
    """
    maxes, running = maxes or {}, running or {}
    daily = (
        df.where(all_present(keys if running else [*keys, date]))
        .groupBy(*keys, date)
        .agg(
            *[F.sum(as_col(c)).alias(n) for n, c in sums.items()],
            *[F.max(as_col(c)).alias(n) for n, c in maxes.items()],
            *[F.sum(as_col(c)).alias(n) for n, c in running.items()],
        )
        .withColumn("__day", day_number(date))
    )
    by_day = Window.partitionBy(*keys).orderBy("__day")
    features = {}
    for n_days in days:
        frame = by_day.rangeBetween(-n_days, -1)
        for name in sums:
            features[f"{name}_last_{n_days}d"] = F.sum(name).over(frame)
        for name in maxes:
            features[f"{name}_last_{n_days}d"] = F.max(name).over(frame)
    before = by_day.rowsBetween(Window.unboundedPreceding, -1)
    features |= {n: F.coalesce(F.sum(n).over(before), F.lit(0)) for n in running}
    return daily.withColumns(features).where(F.col(date).isNotNull()).select(*keys, date, *features)


def attach_trailing(
    df: DataFrame,
    *,
    keys: Sequence[str],
    date: str,
    order: Sequence[str] = (),
    totals: Mapping[str, str | Column] | None = None,
    **spec,
) -> DataFrame:
    """Rows of ``df`` with the day-window features of their entity and day.

    ``totals`` are added as ``to_date`` adds them, in a total ``order`` within the day; both come from one table of days, so the
    rows are aggregated, dealt and joined once.
    """
    if not totals:
        return df.join(trailing_days(df, keys=keys, date=date, **spec), [*keys, date], "left")
    sums = {**totals, "__seen": F.lit(1)}
    ins, starts = [f"__in{i}" for i in range(len(sums))], [f"__start{i}" for i in range(len(sums))]
    work = df.withColumns({n: F.coalesce(as_col(c), F.lit(0)) for n, c in zip(ins, sums.values())})
    out = work.join(trailing_days(work, keys=keys, date=date, running=dict(zip(starts, ins)), **spec), [*keys, date], "left")
    inside = Window.partitionBy(*keys, date).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = {n: F.coalesce(F.sum(i).over(inside), F.lit(0)) + F.col(s) for n, i, s in zip(sums, ins, starts)}
    out = out.withColumns(found).drop(*ins, *starts)
    return out.withColumns({n: F.when(F.col("__seen") > 0, F.col(n)) for n in totals}).drop("__seen")


def to_date(
    df: DataFrame,
    *,
    keys: Sequence[str],
    date: str,
    order: Sequence[str],
    sums: Mapping[str, str | Column],
    blocks: Sequence[str] | None = None,
) -> DataFrame:
    """Add running totals over all earlier rows of the entity; null on its first row."""
    seen = "__seen"
    out = prior_sums(df, keys=keys, blocks=list(blocks or [date]), order=order, sums={**sums, seen: F.lit(1)})
    return out.withColumns({n: F.when(F.col(seen) > 0, F.col(n)) for n in sums}).drop(seen)


def previous_row(
    df: DataFrame,
    *,
    keys: Sequence[str],
    date: str,
    order: Sequence[str],
    values: Mapping[str, str | Column],
    blocks: Sequence[str] | None = None,
) -> DataFrame:
    """Add the values of the entity's previous row (a ``lag`` that splits hot entities).

    ``blocks`` are columns, coarse to fine, that follow the order of an entity's rows; its days unless stated. The last row
    of each finest block is found map-side and handed to the next block, so only rows of one block are sorted together;
    where a day of an entity is too much for a task, add the columns of ``scan.border_blocks`` to the date.
    """
    blocks = list(blocks or [date])
    packed = F.struct(*[as_col(c).alias(n) for n, c in values.items()])
    work = df.withColumn("__packed", packed)
    last = work.groupBy(*keys, *blocks).agg(F.max_by("__packed", F.struct(*order)).alias("__last"))
    by_block = Window.partitionBy(*keys).orderBy(*blocks)
    last = last.select(*keys, *blocks, F.lag("__last").over(by_block).alias("__before_block"))
    inside = Window.partitionBy(*keys, *blocks).orderBy(*order)
    out = work.join(last, [*keys, *blocks], "left").withColumn(
        "__prior", F.coalesce(F.lag("__packed").over(inside), F.col("__before_block"))
    )
    return out.withColumns({n: F.col("__prior")[n] for n in values}).drop("__packed", "__before_block", "__prior")


def lagged_spread(
    df: DataFrame,
    *,
    keys: Sequence[str],
    date: str,
    order: Sequence[str],
    value: str,
    days: int,
    prefix: str,
    blocks: Sequence[str] | None = None,
) -> DataFrame:
    """Count and sample deviation, over a day window, of the *previous row's* value (deviation 0 below two values)."""
    lagged = previous_row(df, keys=keys, date=date, order=order, values={"__lagged": value}, blocks=blocks)
    out = attach_trailing(lagged, keys=keys, date=date, days=[days], sums=spread_sums("__lagged"))
    return with_spread(out, days=days, prefix=prefix).drop("__lagged")


def spread_sums(value: str) -> dict[str, Column]:
    """The day-window sums that ``with_spread`` reads."""
    v = F.col(value).cast("double")
    return {"__n": v.isNotNull().cast("double"), "__s": F.coalesce(v, F.lit(0.0)), "__ss": F.coalesce(v * v, F.lit(0.0))}


def with_spread(df: DataFrame, *, days: int, prefix: str) -> DataFrame:
    """Count and sample deviation in place of the sums of ``spread_sums`` over a day window."""
    n, s, ss = (F.col(f"{c}_last_{days}d") for c in ("__n", "__s", "__ss"))
    spread = F.when(n >= 2, F.sqrt(F.greatest((n * ss - s * s) / (n * (n - 1)), F.lit(0.0)))).otherwise(F.lit(0.0))
    out = df.withColumns({f"{prefix}_count_{days}d": n, f"{prefix}_std_{days}d": spread})
    return out.drop(f"__n_last_{days}d", f"__s_last_{days}d", f"__ss_last_{days}d")


def count_window(
    df: DataFrame,
    *,
    keys: Sequence[str],
    date: str,
    order: Sequence[str],
    count: str,
    numerators: Mapping[str, str | Column],
    size: int = 50,
    units_name: str = "units",
    span: int = 4096,
    blocks: Sequence[str] | None = None,
) -> DataFrame:
    """Rates over the entity's last ``size`` units before each row, taking a fraction of the oldest row.

    Each row with ``count > 0`` covers the unit positions ``[before, before + count)`` of its entity, so the sum over
    the last ``size`` units is the running sum now minus the running sum at position ``now - size``, interpolated in
    the row that covers this position. Positions are cut into spans: a row is copied to the spans it overlaps, a probe
    goes to one span, and a task sorts at most ``2 * span`` rows however large the entity is. Counts are integers.
    """
    units = F.coalesce(F.col(count).cast("long"), F.lit(0))
    names = list(numerators)
    work = df.withColumn("__units", F.greatest(units, F.lit(0)))
    work = work.withColumns(
        {
            f"__num{i}": F.when(F.col("__units") > 0, F.coalesce(as_col(c).cast("double"), F.lit(0.0))).otherwise(0.0)
            for i, c in enumerate(numerators.values())
        }
    )
    nums = [f"__num{i}" for i in range(len(names))]
    sums = {"__at": "__units", **{f"__cum{i}": n for i, n in enumerate(nums)}}
    cums = [f"__cum{i}" for i in range(len(names))]
    work = cut_lineage(prior_sums(work, keys=keys, blocks=list(blocks or [date]), order=order, sums=sums))

    covering = work.where((F.col("__units") > 0) & F.col("__at").isNotNull()).select(
        *keys,
        F.col("__at").alias("__pos"),
        F.lit(0).alias("__probe"),
        F.struct("__at", "__units", *cums, *nums).alias("__row"),
        F.explode(
            F.sequence(F.floor(F.col("__at") / span), F.floor((F.col("__at") + F.col("__units") - 1) / span))
        ).alias("__span"),
        F.lit(None).cast("long").alias("__now"),
        *[F.lit(None).cast("double").alias(c) for c in cums],
    )
    low = F.greatest(F.col("__at") - size, F.lit(0))
    probes = (
        work.where(F.col("__at") > 0)
        .groupBy(*keys, "__at")
        .agg(*[F.first(c).alias(c) for c in cums])
        .select(
            *keys,
            low.alias("__pos"),
            F.lit(1).alias("__probe"),
            F.lit(None).cast(covering.schema["__row"].dataType).alias("__row"),
            F.floor(low / span).alias("__span"),
            F.col("__at").alias("__now"),
            *cums,
        )
    )
    ordered = Window.partitionBy(*keys, "__span").orderBy("__pos", "__probe")
    found = (
        covering.unionByName(probes)
        .withColumn("__edge", F.last("__row", ignorenulls=True).over(ordered))
        .where("__probe = 1")
    )
    used = F.col("__now") - F.col("__pos")
    share = (F.col("__pos") - F.col("__edge.__at")) / F.col("__edge.__units")
    rates = {
        name: (F.col(f"__cum{i}") - F.col(f"__edge.__cum{i}") - share * F.col(f"__edge.__num{i}")) / used
        for i, name in enumerate(names)
    }
    result = found.select(
        *keys, F.col("__now").alias("__at"), used.alias(units_name), *[c.alias(n) for n, c in rates.items()]
    )
    return work.drop("__units", *nums, *cums).join(result, [*keys, "__at"], "left").drop("__at")


def batter_trailing_block(df: DataFrame, *, entity: str, date: str, **to_date) -> DataFrame:
    """The 10- and 30-day block of an entity-game table: counts, rates, weighted mean and maximum of speed.

    ``to_date`` takes the ``order`` and ``totals`` of ``attach_trailing``.
    """
    out = attach_trailing(
        df,
        keys=[entity],
        date=date,
        **to_date,
        days=[10, 30],
        sums={
            "hr_count": "hr_count",
            "pa": "pa_count",
            "barrels": "barrel_count",
            "__hard": "hard_hit_bbe_count",
            "__bbe": "bbe_count",
            "__ev95": "ev_95plus_bbe_count",
            "__evsum": F.coalesce("avg_exit_velocity", F.lit(0.0)) * F.coalesce("bbe_count", F.lit(0)),
        },
        maxes={"max_exit_velocity": "max_exit_velocity"},
    )
    rates = {}
    for d in (10, 30):
        rates[f"hr_per_pa_last_{d}d"] = safe_rate(f"hr_count_last_{d}d", f"pa_last_{d}d")
        rates[f"barrels_per_pa_last_{d}d"] = safe_rate(f"barrels_last_{d}d", f"pa_last_{d}d")
        rates[f"hard_hit_rate_last_{d}d"] = safe_rate(f"__hard_last_{d}d", f"__bbe_last_{d}d")
        rates[f"bbe_95plus_ev_rate_last_{d}d"] = safe_rate(f"__ev95_last_{d}d", f"__bbe_last_{d}d")
    rates["avg_exit_velocity_last_10d"] = safe_rate("__evsum_last_10d", "__bbe_last_10d")
    out = out.withColumns(rates)
    return out.drop(
        "max_exit_velocity_last_30d", *[f"{c}_last_{d}d" for c in ("__hard", "__bbe", "__ev95", "__evsum") for d in (10, 30)]
    )


def pitcher_trailing_block(df: DataFrame, *, entity: str, date: str, days: int = 30, **to_date) -> DataFrame:
    """The 30-day block of an opponent-game table (what the opponent allowed); ``to_date`` as for the batter's."""
    sums = {
        "hr_allowed": "hr_allowed",
        "pa_against": "pa_against",
        "barrels_allowed": "barrels_allowed",
        "hard_hit_allowed": "hard_hit_bbe_allowed",
        "bbe_allowed": "bbe_allowed",
        "__ev95": "ev_95plus_bbe_allowed",
        "__evsum": F.coalesce("avg_ev_allowed", F.lit(0.0)) * F.coalesce("bbe_allowed", F.lit(0)),
    }
    out = attach_trailing(df, keys=[entity], date=date, **to_date, days=[days], sums=sums)
    c = {n: F.col(f"{n}_last_{days}d") for n in sums}
    out = out.withColumns(
        {
            f"pitcher_hr_allowed_per_pa_last_{days}d": safe_rate(c["hr_allowed"], c["pa_against"]),
            f"pitcher_hr_allowed_last_{days}d": c["hr_allowed"],
            f"pitcher_barrels_allowed_per_bbe_last_{days}d": safe_rate(c["barrels_allowed"], c["bbe_allowed"]),
            f"pitcher_barrels_allowed_last_{days}d": c["barrels_allowed"],
            f"pitcher_hard_hit_allowed_rate_last_{days}d": safe_rate(c["hard_hit_allowed"], c["bbe_allowed"]),
            f"pitcher_hard_hit_allowed_last_{days}d": c["hard_hit_allowed"],
            f"pitcher_bbe_allowed_last_{days}d": c["bbe_allowed"],
            f"pitcher_avg_ev_allowed_last_{days}d": safe_rate(c["__evsum"], c["bbe_allowed"]),
            f"pitcher_95plus_ev_allowed_rate_last_{days}d": safe_rate(c["__ev95"], c["bbe_allowed"]),
        }
    )
    return out.drop(*[f"{n}_last_{days}d" for n in sums])


def split_to_date(
    df: DataFrame,
    *,
    keys: Sequence[str],
    date: str,
    order: Sequence[str],
    split: str,
    sides: Mapping[str, str],
    rates: Mapping[str, tuple[str, str]],
) -> DataFrame:
    """To-date rates per side of a split: ``sides`` maps a split value to a suffix, ``rates`` a prefix to (num, den)."""
    sums = split_sums(split, sides, rates)
    out = to_date(df, keys=keys, date=date, order=order, sums=sums)
    return out.withColumns(split_rates(sides, rates)).drop(*sums)


def split_sums(split: str, sides: Mapping[str, str], rates: Mapping[str, tuple[str, str]]) -> dict[str, Column]:
    """The measures of ``rates`` on each side, to be summed to date."""
    measures = dict.fromkeys(m for pair in rates.values() for m in pair)
    on_side = lambda value: F.coalesce(F.col(split) == value, F.lit(False))
    return {f"__{m}_{suffix}": F.when(on_side(value), F.col(m)).otherwise(0) for value, suffix in sides.items() for m in measures}


def split_rates(sides: Mapping[str, str], rates: Mapping[str, tuple[str, str]]) -> dict[str, Column]:
    """The rates from the summed measures of each side."""
    return {f"{n}_{s}": safe_rate(f"__{num}_{s}", f"__{den}_{s}") for s in sides.values() for n, (num, den) in rates.items()}


def latest_non_null(
    df: DataFrame, *, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Per entity the latest known value of each column; map-side combined aggregates for all columns together.

    Days and whole numbers are gone through from the finest to the coarsest, one plain column at a time, which Spark
    aggregates by hashing; an order of other types is one struct, for which rows are sorted. Nulls come first.
    """
    kinds, known = dict(df.dtypes), lambda c: F.col(c).isNotNull()
    latest = lambda when: [F.max_by(c, F.when(known(c), when)).alias(c) for c in columns]
    if any(kinds[c] not in LOWEST for c in order) or set(order) & {*keys, *columns}:
        return df.groupBy(*keys).agg(*latest(F.struct(*order)))
    out = df
    for i in reversed(range(len(order))):
        when = F.coalesce(order[i], F.lit(LOWEST[kinds[order[i]]]).cast(kinds[order[i]]))
        out = out.groupBy(*keys, *order[:i]).agg(*latest(when))
    return out


#: What stands for a null of an order: no value of the type is less.
LOWEST = {"int": -(2**31), "bigint": -(2**63), "date": "-5877641-06-23"}


def as_of_rows(
    history: DataFrame, candidates: DataFrame, *, flag: str = "is_candidate"
) -> DataFrame:
    """History plus candidate rows without outcomes, so that the same windows give features as of the candidate date."""
    tagged = candidates.withColumn(flag, F.lit(True))
    return history.withColumn(flag, F.lit(False)).unionByName(tagged, allowMissingColumns=True)
