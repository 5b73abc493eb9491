"""Data-quality operators: keys, identities, coverage, export decisions, leakage, contracts, readiness.

All of them are one or two map-side combined aggregates; reports have one row per feature.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretrace.functions import fixed_values as fv
from foretrace.functions.scalar import flag, safe_rate
from foretrace.functions.text import is_placeholder
from foretrace.operators.joins import key_counts
from foretrace.operators.ranking import topk


def unique_key_check(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows, keys, keys with several rows, rows beyond the first of their key."""
    return key_counts(df, keys, "n").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.count(F.lit(1)).alias("keys"),
        F.coalesce(F.sum(flag(F.col("n") > 1)), F.lit(0)).alias("offending_keys"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def offending_keys(df: DataFrame, keys: Sequence[str], sample: int = 10) -> DataFrame:
    return key_counts(df, keys, "n").where("n > 1").orderBy(*keys).limit(sample)


def require_events(df: DataFrame, *, required: Sequence[str], keys: Sequence[str]) -> None:
    """Raise on missing columns, on an empty table and on duplicate keys."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    row = unique_key_check(df, keys).first()
    if row["row_count"] == 0:
        raise ValueError("the table is empty")
    if row["duplicate_rows"]:
        sample = [r.asDict() for r in offending_keys(df, keys).collect()]
        raise ValueError(f"{row['duplicate_rows']} duplicate keys, such as {sample}")


def identity_audit(df: DataFrame, *, entity: str, name: str, limit: float = 0.01) -> DataFrame:
    """One row about names: ids with several names, null and placeholder names, and whether placeholders are too many."""
    pairs = df.groupBy(entity, name).agg(F.count(F.lit(1)).alias("n"))
    known = F.col(entity).isNotNull() & F.col(name).isNotNull()
    per_id = pairs.groupBy(entity).agg(
        F.sum(flag(known)).alias("names"),
        F.sum("n").alias("n"),
        F.sum(F.when(F.col(name).isNull(), F.col("n")).otherwise(0)).alias("nulls"),
        F.sum(F.when(is_placeholder(name), F.col("n")).otherwise(0)).alias("placeholders"),
    )
    totals = per_id.agg(
        F.sum("n").alias("row_count"),
        F.count(entity).alias("distinct_ids"),
        F.sum(flag(F.col("names") > 1)).alias("unstable_ids"),
        F.sum("nulls").alias("null_names"),
        F.sum("placeholders").alias("placeholder_names"),
    )
    share = F.coalesce(safe_rate("placeholder_names", "row_count"), F.lit(0.0))
    return totals.withColumns({"placeholder_share": share, "passes": share <= limit})


def coverage(df: DataFrame, features: Sequence[str], *, warn: float = 0.35) -> DataFrame:
    """One row per requested feature: present, non-null rows, null rate, status. One aggregate over the table."""
    present = [c for c in features if c in df.columns]
    counts = df.agg(
        F.count(F.lit(1)).alias("__rows"), *[F.count(F.col(c)).alias(c) for c in present],
    )
    missing = [F.lit(None).cast("bigint").alias(c) for c in features if c not in df.columns]
    wide = counts.select("__rows", *present, *missing)
    long = wide.unpivot(["__rows"], list(features), "feature", "non_null")
    rate = F.when(F.col("__rows") > 0, 1 - F.col("non_null") / F.col("__rows"))
    status = (
        F.when(F.col("non_null").isNull(), "missing")
        .when(F.col("non_null") == 0, "all null")
        .when(rate > warn, "warn")
        .otherwise("ok")
    )
    return long.select(
        "feature",
        F.col("non_null").isNotNull().alias("present"),
        F.coalesce("non_null", F.lit(0)).alias("non_null"),
        rate.alias("null_rate"),
        status.alias("status"),
    )


def require_coverage(report: DataFrame) -> None:
    bad = [r["feature"] for r in report.where(F.col("status").isin("missing", "all null")).select("feature").collect()]
    if bad:
        raise ValueError(f"features missing or without any value: {sorted(bad)}")


def family_of(families: Mapping[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(v) for item in families.items() for v in item])
    return F.try_element_at(pairs, F.col("feature"))


def export_decisions(
    df: DataFrame, families: Mapping[str, str], *, limits: Mapping[str, float] = fv.EXPORT_LIMITS, other: float = fv.EXPORT_LIMIT_OTHER
) -> DataFrame:
    """Per catalog feature whether it is exported, by the missing-share limit of its family."""
    report = coverage(df, list(families)).withColumn("family", family_of(families))
    limit = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for item in limits.items() for v in item]), "family"), F.lit(other))
    reason = (
        F.when(~F.col("present"), "feature not produced")
        .when(F.col("null_rate") >= 1.0, "100% missing")
        .when(F.col("null_rate") > limit, "missing share above family limit")
        .otherwise("feature passed coverage checks")
    )
    return report.select(
        "feature", "family", "null_rate", reason.alias("reason"), (reason == "feature passed coverage checks").alias("included")
    )


def catalog_report(before: DataFrame, after: DataFrame, families: Mapping[str, str]) -> DataFrame:
    """Per catalog feature the non-null counts before and after a step."""
    names = list(families)
    left = coverage(before, names).select("feature", F.col("non_null").alias("before_non_null"))
    right = coverage(after, names).select("feature", "present", F.col("non_null").alias("after_non_null"), "null_rate")
    return left.join(right, "feature").withColumn("family", family_of(families))


def leakage_check(df: DataFrame, *, entity: str, order: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Per history feature: first rows of entities that (wrongly) have a value, and whether any row has one."""
    first = topk(df, keys=[entity], order=[F.asc(c) for c in order], k=1)
    leaked = first.agg(*[F.count(c).alias(c) for c in features]).unpivot([], list(features), "feature", "leaked_first_rows")
    signal = df.agg(*[F.count(c).alias(c) for c in features]).unpivot([], list(features), "feature", "non_null")
    return leaked.join(signal, "feature").select(
        "feature", "leaked_first_rows", (F.col("non_null") > 0).alias("has_signal"), (F.col("leaked_first_rows") == 0).alias("clean")
    )


def overlap_check(
    df: DataFrame, *, entity: str, entity_name: str, opponent: str, opponent_name: str, name_limit: float = 0.25, id_limit: float = 0.10
) -> DataFrame:
    """One row: null identities, and how often entity and opponent have the same name or id."""
    both_named = F.col(entity_name).isNotNull() & F.col(opponent_name).isNotNull()
    same_name = F.sum(flag(F.col(entity_name) == F.col(opponent_name)))
    totals = df.agg(
        F.sum(flag(F.col(entity).isNull())).alias("null_ids"),
        F.sum(flag(F.col(entity_name).isNull())).alias("null_names"),
        F.coalesce(safe_rate(same_name, F.sum(flag(both_named))), F.lit(0.0)).alias("name_overlap"),
        F.avg(flag(F.col(entity) == F.col(opponent)).cast("double")).alias("id_overlap"),
    )
    return totals.withColumn(
        "passes",
        (F.col("null_ids") == 0) & (F.col("null_names") == 0) & (F.col("name_overlap") <= name_limit) & (F.col("id_overlap") <= id_limit),
    )


def contract_check(df: DataFrame, expected_rank: DataFrame, *, columns: Sequence[str], key: str, rank: str, date: str, start: Column) -> DataFrame:
    """One row: column contract, duplicate ids, rows before the start date, rows whose stored rank is not the order's rank."""
    keys = unique_key_check(df, [key]).select(F.col("row_count"), "duplicate_rows")
    early = df.select(F.sum(flag(F.col(date) < start)).alias("n")).scalar()
    order = df.select(key, F.col(rank).alias("__stored")).join(expected_rank.select(key, F.col(rank).alias("__due")), key)
    wrong = order.select(F.sum(flag(~F.col("__stored").eqNullSafe(F.col("__due")))).alias("n")).scalar()
    return keys.select(
        F.lit(list(df.columns) == list(columns)).alias("columns_match"),
        "row_count",
        "duplicate_rows",
        F.coalesce(early, F.lit(0)).alias("early_rows"),
        F.coalesce(wrong, F.lit(0)).alias("out_of_order_rows"),
    )


def snapshot_health(cache: DataFrame, expected: DataFrame, *, on: Sequence[str], features: Sequence[str], warn: float = 0.35) -> DataFrame:
    """One row: keys missing from the cache, keys it should not have, worst null rate, and whether it may be reused."""
    cached = cache.select(*on).distinct().withColumn("__cached", F.lit(1))
    due = expected.select(*on).distinct().withColumn("__due", F.lit(1))
    gaps = due.join(cached, list(on), "full").agg(
        F.sum(flag(F.col("__cached").isNull())).alias("missing_keys"), F.sum(flag(F.col("__due").isNull())).alias("extra_keys")
    )
    worst = coverage(cache, features, warn=warn).agg(F.max(F.coalesce("null_rate", F.lit(1.0)))).scalar()
    out = gaps.withColumn("worst_null_rate", worst)
    return out.withColumn("healthy", (F.col("missing_keys") == 0) & (F.col("extra_keys") == 0) & (F.col("worst_null_rate") <= warn))


def readiness(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Required features that stop scoring: missing from the table, or without any value."""
    return coverage(df, required).where(F.col("status").isin("missing", "all null")).select("feature", "status")
