"""Ordered running totals and positions that never gather one key in one task.

A plain window ``partitionBy(entity)`` sorts all rows of an entity in one task, which fails when one entity holds a
large share of the table. Here an order is given as a list of *blocks*, coarse to fine (for example date, game).
Totals per block are pre-aggregated map-side, the running total over blocks is a window whose partition holds one row
per distinct block of its parent, and only rows of the same finest block are sorted together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretrace.functions.scalar import as_col
from foretrace.session import cut_lineage


def all_present(names: Sequence[str]) -> Column:
    present = F.lit(True)
    for name in names:
        present = present & F.col(name).isNotNull()
    return present


def prior_sums(
    df: DataFrame,
    *,
    keys: Sequence[str],
    blocks: Sequence[str],
    order: Sequence[str | Column],
    sums: Mapping[str, str | Column],
) -> DataFrame:
    """Add, per row, each sum over the rows of the same ``keys`` that come strictly before it.

    Order is ``blocks`` ascending, then ``order``; together they must be total within ``keys``. The first row gets 0.
    Rows with a null key or block have no place in the order and get null.
    """
    inputs = {f"__in{i}": F.coalesce(as_col(c), F.lit(0)) for i, c in enumerate(sums.values())}
    work = df.withColumns(inputs)
    before = [f"__before{i}" for i in range(len(inputs))]
    finest = work.groupBy(*keys, *blocks).agg(*[F.sum(c).alias(n) for c, n in zip(inputs, before)])
    starts = finest
    for level, block in enumerate(blocks):
        # Totals of this level's blocks, then of those before each of them in its parent block.
        parent = [*keys, *blocks[:level]]
        earlier = Window.partitionBy(*parent).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
        names = [f"__level{level}_{i}" for i in range(len(inputs))]
        if level == len(blocks) - 1:
            starts = starts.withColumns({n: F.sum(c).over(earlier) for n, c in zip(names, before)})
        else:
            totals = finest.groupBy(*parent, block).agg(*[F.sum(c).alias(n) for c, n in zip(before, names)])
            totals = totals.withColumns({n: F.sum(n).over(earlier) for n in names})
            starts = starts.join(totals, [*parent, block])
    carried = []
    for i in range(len(inputs)):
        levels = [F.coalesce(F.col(f"__level{level}_{i}"), F.lit(0)) for level in range(len(blocks))]
        carried.append(sum(levels[1:], levels[0]).alias(f"__start{i}"))
    starts = starts.select(*keys, *blocks, *carried)
    inside = Window.partitionBy(*keys, *blocks).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    results = {
        name: F.when(
            all_present([*keys, *blocks]),
            F.coalesce(F.sum(f"__in{i}").over(inside), F.lit(0)) + F.coalesce(F.col(f"__start{i}"), F.lit(0)),
        )
        for i, name in enumerate(sums)
    }
    out = work.join(starts, [*keys, *blocks], "left").withColumns(results)
    return out.drop(*inputs, *[f"__start{i}" for i in range(len(inputs))])


def positions(
    df: DataFrame, *, keys: Sequence[str], blocks: Sequence[str], order: Sequence[str | Column], name: str
) -> DataFrame:
    """Add the 1-based position of each row within ``keys`` (a ``row_number`` that splits hot keys)."""
    out = prior_sums(df, keys=keys, blocks=blocks, order=order, sums={name: F.lit(1)})
    return out.withColumn(name, F.col(name) + 1)


BORDERS, STEP = 1024, 32


def border_blocks(
    df: DataFrame, by: str, *, keys: Sequence[str], name: str, borders: int = BORDERS, distinct: bool = True
) -> tuple[DataFrame, list[str]]:
    """Two block columns, coarse and fine, that follow the order of ``by``, a column of any type that can be ordered.

    The borders are values of the column itself: those ``borders`` distinct ones of each key whose hashes are least, in
    order. They are spread like the values are, so outliers, constants, NaN, hashed ids and texts make no block much
    larger than its share, and they are the same whenever they are computed again. They only cut the order; every row is
    placed by comparing its own value with them. ``distinct=False`` says that keys and values do not repeat.
    """
    keys, low = list(keys), f"__{name}_borders"
    values = df.where(F.col(by).isNotNull()).select(*keys, F.col(by).alias("__v"))
    values = (values.distinct() if distinct else values).withColumn("__h", F.xxhash64("__v"))
    if keys:
        least = Window.partitionBy(*keys).orderBy("__h", "__v")
        values = values.withColumn("__n", F.row_number().over(least)).where(F.col("__n") <= borders)
        out = df.join(values.groupBy(*keys).agg(F.array_sort(F.collect_list("__v")).alias(low)), keys, "left")
    else:
        picked = values.orderBy("__h", "__v").limit(borders)
        out = df.withColumn(low, picked.agg(F.array_sort(F.collect_list("__v"))).scalar())
    coarse, fine = f"__{name}_coarse", f"__{name}_fine"
    reached = lambda places: F.coalesce(F.size(F.filter(places, lambda x: x <= F.col(by))), F.lit(0))
    every = F.filter(F.col(low), lambda x, i: i % STEP == STEP - 1)
    out = out.withColumn(coarse, F.when(F.col(low).isNotNull(), reached(every)).otherwise(0))
    near = F.slice(low, F.col(coarse) * STEP + 1, F.lit(STEP))
    return out.withColumn(fine, F.when(F.col(low).isNotNull(), reached(near)).otherwise(0)).drop(low), [coarse, fine]


def ordered_values(
    df: DataFrame, *, keys: Sequence[str], value: str, counts: Mapping[str, Column], descending: bool = False
) -> DataFrame:
    """One row per key and distinct value with its counts, and ``<count>_before`` of all values before it.

    Rows with equal values are combined map-side. The table is read more than once, so it is written once.
    """
    distinct = cut_lineage(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(*[c.alias(n) for n, c in counts.items()]))
    order = (-1 if descending else 1) * F.col(value)
    return range_prior(distinct, keys=keys, order=[order.asc()], sums={f"{n}_before": n for n in counts})


def _ranged(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows dealt by ranges of (keys, order), sorted and numbered where they are (``__place``, ``__range``), written once.

    Ranges are as even as the order is total, whatever keys and values are. They are sampled, hence the write.
    """
    dealt = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = cut_lineage(dealt.withColumn("__place", F.monotonically_increasing_id()))
    return placed.withColumn("__range", F.shiftright("__place", 33))


def range_positions(
    df: DataFrame, *, keys: Sequence[str], order: Sequence[Column], name: str, value: str | None = None, total: str | None = None
) -> DataFrame:
    """Add the 1-based position of each row within ``keys`` in a total ``order``; ``total`` counts a key's known ``value``.

    A partition's rows are numbered as they come; a small table has how many rows of a key lie in earlier ranges. Rows
    with a null key get nulls.
    """
    keys = list(keys)
    placed = _ranged(df, keys, order)
    known = F.count(value) if value else F.count(F.lit(1))
    runs = placed.groupBy(*keys, "__range").agg(F.min("__place").alias("__first"), F.count(F.lit(1)).alias("__n"), known.alias("__known"))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    made = [(F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1).alias("__shift")]
    if total:
        made.append(F.sum("__known").over(Window.partitionBy(*keys)).alias(total))
    runs = runs.select(*keys, "__range", *made)
    out = placed.join(runs, [*keys, "__range"], "left")
    return out.withColumn(name, F.col("__place") + F.col("__shift")).drop("__place", "__range", "__shift")


def range_prior(df: DataFrame, *, keys: Sequence[str], order: Sequence[Column], sums: Mapping[str, str | Column]) -> DataFrame:
    """Add, per row, each sum over the rows of the same ``keys`` that come before it in a total ``order``; likewise."""
    keys, names = list(keys), list(sums)
    ins = [f"__in{i}" for i in range(len(names))]
    placed = _ranged(df.withColumns({n: F.coalesce(as_col(c), F.lit(0)) for n, c in zip(ins, sums.values())}), keys, order)
    runs = placed.groupBy(*keys, "__range").agg(*[F.sum(c).alias(c) for c in ins])
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*keys, "__range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_start") for c in ins])
    inside = Window.partitionBy(*keys, "__range").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumns({f"{c}_inside": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in ins}).join(runs, [*keys, "__range"], "left")
    found = {n: F.col(f"{c}_inside") + F.col(f"{c}_start") for n, c in zip(names, ins)}
    return out.withColumns(found).drop("__place", "__range", *ins, *[f"{c}_{part}" for c in ins for part in ("inside", "start")])


def ranks(
    df: DataFrame, *, keys: Sequence[str], value: str, tie: str, best: str = "rank", lowest: str | None = None, total: str = "of"
) -> DataFrame:
    """Add the position of each row from the highest value (``best``), from the lowest one if asked for, and the number
    of rows with a value.

    Equal values keep the tie order in both directions. Rows without a value, or without a key, get nulls. Positions come
    from ranges of (key, value, tie); the other direction needs ranges of its own.
    """
    keys = list(keys)
    out = range_positions(df, keys=keys, order=[F.col(value).desc_nulls_last(), F.asc(tie)], name=best, value=value, total=total)
    names = [best]
    if lowest:
        out = range_positions(out, keys=keys, order=[F.col(value).asc_nulls_last(), F.asc(tie)], name=lowest)
        names.append(lowest)
    known = all_present([*keys, value])
    return out.withColumns({c: F.when(known, F.col(c)) for c in (*names, total)})
