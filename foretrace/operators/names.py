"""Resolving entity names from several sources, with the source of each name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foretrace.functions.text import usable_name


def vote(candidates: DataFrame, *, entity: str, name: str) -> DataFrame:
    """The most frequent usable name per entity (ties: first in the alphabet)."""
    cleaned = candidates.where(F.col(entity).isNotNull()).select(entity, usable_name(name).alias("voted_name"))
    # The null name is dropped by its count: a filter on the name would make Spark evaluate its patterns twice.
    counted = cleaned.groupBy(entity, "voted_name").agg(F.count("voted_name").alias("votes")).where("votes > 0")
    best = Window.partitionBy(entity).orderBy(F.desc("votes"), F.asc("voted_name"))
    return counted.withColumn("__rank", F.row_number().over(best)).where("__rank = 1").drop("__rank")


def resolve(
    ids: DataFrame,
    *,
    entity: str,
    sources: Sequence[tuple[str, DataFrame]],
    prefix: str = "batter_",
    name: str = "batter_name",
) -> DataFrame:
    """Name per id from the first source that knows it, else a placeholder; sources are (label, table of id and name).

    Each source is reduced to one voted name per id before it is joined, so joins are one to one.
    """
    out = ids.select(entity).where(F.col(entity).isNotNull()).distinct()
    found, label = F.lit(None).cast("string"), F.lit(None).cast("string")
    temporary = []
    for i, (source, table) in enumerate(sources):
        column = f"__name{i}"
        known = vote(table, entity=entity, name=name).select(entity, F.col("voted_name").alias(column))
        out = out.join(known, entity, "left")
        label = F.coalesce(label, F.when(F.col(column).isNotNull(), F.lit(source)))
        found = F.coalesce(found, F.col(column))
        temporary.append(column)
    placeholder = F.concat(F.lit(prefix), F.col(entity).cast("string"))
    return out.select(
        entity, F.coalesce(found, placeholder).alias(name), F.coalesce(label, F.lit("placeholder")).alias("name_source")
    )
