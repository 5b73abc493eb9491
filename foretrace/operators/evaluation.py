"""Chronological evaluation: splits, folds, exact ranking metrics, threshold tables and policies.

Row positions come from blocked running counts (see ``scan``), and all tables that are sorted in one task are bounded
by construction: days of the calendar, thresholds, folds, policies, deciles.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretrace.functions.scalar import flag, safe_rate
from foretrace.operators.scan import ordered_values, positions, ranks
from foretrace.session import cut_lineage

# ---------------------------------------------------------------- splits


def split_cutoff(df: DataFrame, *, date: str, fraction: float = 0.67) -> Column:
    """The date of the row at ``fraction`` of the rows in date order, as a scalar (from counts per day)."""
    daily = df.groupBy(date).agg(F.count(F.lit(1)).alias("n"))
    through = F.sum("n").over(Window.orderBy(date).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.partitionBy())
    at = F.least(F.greatest(F.floor(F.col("total") * fraction), F.lit(1)), F.col("total") - 1)
    counted = daily.withColumns({"through": through, "total": total})
    return counted.where(F.col("through") > at).agg(F.min(date)).scalar()


def chronological_split(df: DataFrame, *, date: str, fraction: float = 0.67, name: str = "part") -> DataFrame:
    # One date, looked up once: rows are not written again for it, and readers can skip files by it.
    cutoff = F.lit(df.sparkSession.range(1).select(split_cutoff(df, date=date, fraction=fraction)).first()[0]).cast(df.schema[date].dataType)
    return df.withColumn(name, F.when(F.col(date) < cutoff, "train").otherwise("test"))


def split_integrity(df: DataFrame, *, date: str, part: str, keys: Sequence[str], required: Sequence[str]) -> DataFrame:
    """One row: last training day, first test day, duplicate keys, rows with a missing required value, and the verdict."""
    nulls = F.lit(False)
    for c in required:
        nulls = nulls | F.col(c).isNull()
    facts = df.agg(
        F.max(F.when(F.col(part) == "train", F.col(date))).alias("last_train"),
        F.min(F.when(F.col(part) == "test", F.col(date))).alias("first_test"),
        F.sum(flag(nulls)).alias("null_rows"),
    )
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    duplicates = per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).scalar()
    out = facts.withColumn("duplicate_rows", duplicates)
    ok = (F.col("last_train") < F.col("first_test")) & (F.col("duplicate_rows") == 0) & (F.col("null_rows") == 0)
    return out.withColumn("passes", F.coalesce(ok, F.lit(False)))


def expanding_folds(
    df: DataFrame, *, blocks: Sequence[str], order: Sequence[str], splits: int = 5, name: str = "fold"
) -> DataFrame:
    """Number each row with the fold that tests it (1..splits, 0 for rows that are only trained on).

    Fold ``f`` trains on all rows with a smaller number. Rows follow ``blocks`` (date, game), then ``order``.
    """
    placed = positions(df, keys=[], blocks=blocks, order=order, name="__pos")
    total = df.agg(F.count(F.lit(1))).scalar()
    size = F.floor(total / F.lit(splits + 1))
    from_end = total - F.col("__pos")
    fold = splits - F.floor(from_end / size)
    return placed.withColumn(name, F.greatest(fold, F.lit(0)).cast("int")).drop("__pos")


def rolling_windows(df: DataFrame, *, date: str, days: int = 28, windows: int = 6, attempts: int | None = None) -> DataFrame:
    """The newest non-empty holdout windows of ``days`` days, with the rows and dates before them; from counts per day.

    They are looked for in the newest ``attempts`` windows, eight times as many as are wanted unless stated.
    """
    attempts = 8 * windows if attempts is None else attempts
    daily = df.where(F.col(date).isNotNull()).groupBy(date).agg(F.count(F.lit(1)).alias("n"))
    newest = df.agg(F.max(date)).scalar()
    daily = daily.withColumn("__back", F.floor(F.datediff(newest, date) / F.lit(days)).cast("int"))
    per_window = daily.groupBy("__back").agg(F.sum("n").alias("holdout_rows"), F.min(date).alias("__first"), F.max(date).alias("__last"))
    older = Window.orderBy(F.desc("__back")).rowsBetween(Window.unboundedPreceding, -1)
    per_window = per_window.withColumns(
        {
            "train_rows": F.coalesce(F.sum("holdout_rows").over(older), F.lit(0)),
            "train_start": F.min("__first").over(older),
            "train_end": F.max("__last").over(older),
        }
    ).where(F.col("__back") < attempts)
    per_window = per_window.withColumn("window_index", F.row_number().over(Window.orderBy("__back")))
    end = F.date_sub(newest, F.col("__back") * days)
    return per_window.where(F.col("window_index") <= windows).select(
        "window_index",
        F.date_sub(end, days - 1).alias("holdout_start"),
        end.alias("holdout_end"),
        "train_start",
        "train_end",
        "train_rows",
        "holdout_rows",
    )


def missingness(df: DataFrame, features: Sequence[str], *, threshold: float) -> DataFrame:
    """Missing share per feature and whether the feature is kept (missing columns count as fully missing)."""
    shares = [
        (F.avg(F.col(c).isNull().cast("double")) if c in df.columns else F.lit(1.0)).alias(c) for c in features
    ]
    long = df.agg(*shares).unpivot([], list(features), "feature_name", "__share")
    keep = F.col("__share") <= threshold
    return long.select(
        "feature_name",
        (F.col("__share") * 100.0).alias("training_missing_pct"),
        F.when(keep, "yes").otherwise("no").alias("keep_for_model"),
    )


def fold_missingness(df: DataFrame, features: Sequence[str], *, fold: str = "fold") -> DataFrame:
    """Per fold and feature the missing share of its training rows (all rows of earlier folds)."""
    per_fold = df.groupBy(fold).agg(F.count(F.lit(1)).alias("__n"), *[F.sum(flag(F.col(c).isNull())).alias(c) for c in features])
    long = per_fold.unpivot([fold, "__n"], list(features), "feature_name", "__missing")
    before = Window.partitionBy("feature_name").orderBy(fold).rowsBetween(Window.unboundedPreceding, -1)
    rows, missing = F.sum("__n").over(before), F.sum("__missing").over(before)
    return (
        long.withColumns({"train_rows": rows, "__gone": missing, "valid_rows": F.col("__n")})
        .where(F.col(fold) > 0)
        .select(
            fold,
            "feature_name",
            "train_rows",
            "valid_rows",
            (safe_rate("__gone", "train_rows") * 100.0).alias("missing_pct"),
            (F.col("__gone") == F.col("train_rows")).alias("fully_missing"),
        )
    )


# ---------------------------------------------------------------- probability metrics

EPSILON = 2.220446049250313e-16


def score_table(df: DataFrame, *, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """One row per distinct score with its rows and positives, and those of all higher scores (exact, also with ties)."""
    counts = {"n": F.count(F.lit(1)), "pos": F.sum(F.col(label).cast("bigint"))}
    out = ordered_values(df, keys=list(keys), value=score, counts=counts, descending=True)
    return out.withColumnsRenamed({"n_before": "n_above", "pos_before": "pos_above"})


def probability_metrics(df: DataFrame, *, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Average precision, ROC-AUC, log loss and Brier score per key."""
    keys = list(keys)
    table = score_table(df, score=score, label=label, keys=keys)
    p = F.least(F.greatest(F.col(score), F.lit(EPSILON)), F.lit(1 - EPSILON))
    neg = F.col("n") - F.col("pos")
    through, pos_through = F.col("n_above") + F.col("n"), F.col("pos_above") + F.col("pos")
    sums = table.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"),
        F.sum("pos").alias("positives"),
        F.sum(F.col("pos") * (pos_through / through)).alias("__ap"),
        F.sum(neg.cast("double") * (F.col("pos_above") + F.col("pos") / 2)).alias("__auc"),
        F.sum(-(F.col("pos") * F.log(p) + neg * F.log(1 - p))).alias("__ll"),
        F.sum(F.col("pos") * (1 - F.col(score)) * (1 - F.col(score)) + neg * F.col(score) * F.col(score)).alias("__bs"),
    )
    pos, n = F.col("positives").cast("double"), F.col("n_rows").cast("double")
    return sums.select(
        *keys,
        "n_rows",
        "positives",
        safe_rate("__ap", pos).alias("pr_auc"),
        safe_rate("__auc", pos * (n - pos)).alias("roc_auc"),
        safe_rate("__ll", n).alias("log_loss"),
        safe_rate("__bs", n).alias("brier_score"),
    )


def confusion_rates(df: DataFrame) -> DataFrame:
    """Rates of rows that hold tp, fp, tn, fn; a zero denominator gives 0."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))

    def rate(num: Column, den: Column) -> Column:
        return F.when(den > 0, num / den).otherwise(0.0)

    precision, recall = rate(tp, tp + fp), rate(tp, tp + fn)
    return df.withColumns(
        {
            "precision": precision,
            "recall": recall,
            "f1": rate(2 * tp, 2 * tp + fp + fn),
            "f0_5": rate(1.25 * tp, 1.25 * tp + fp + 0.25 * fn),
            "balanced_accuracy": (
                F.when((tp + fn > 0) & (tn + fp > 0), (recall + rate(tn, tn + fp)) / 2)
                .when(tp + fn > 0, recall)
                .otherwise(rate(tn, tn + fp))
            ),
            "positive_rate": rate(tp + fp, tp + fp + tn + fn),
        }
    )


def threshold_sweep(
    df: DataFrame, *, score: str, label: str, low: int = 5, high: int = 50, per: int = 100, keys: Sequence[str] = ()
) -> DataFrame:
    """Confusion counts and rates at the thresholds low/per..high/per, from one histogram over threshold steps (per key).

    Keys without any score have no rows; without keys there always is a row for each threshold.
    """
    keys, s = list(keys), F.col(score)
    step = F.floor(s * per)
    step = step + flag(s >= (step + 1) / per) - flag(s < step / per)
    steps = F.least(F.greatest(step, F.lit(low - 1)), F.lit(high)).cast("bigint")
    histogram = (
        df.where(s.isNotNull())
        .groupBy(*keys, steps.alias("__step"))
        .agg(F.count(F.lit(1)).alias("__n"), F.sum(F.col(label).cast("bigint")).alias("__pos"))
    )
    every = F.explode(F.sequence(F.lit(low - 1).cast("bigint"), F.lit(high).cast("bigint"))).alias("__step")
    grid = histogram.select(*keys).distinct().select(*keys, every) if keys else df.sparkSession.range(1).select(every)
    filled = grid.join(histogram, [*keys, "__step"], "left")
    at_least = Window.partitionBy(*keys).orderBy(F.desc("__step")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    n, pos = F.coalesce("__n", F.lit(0)), F.coalesce("__pos", F.lit(0))
    counted = filled.select(
        *keys,
        "__step",
        F.sum(pos).over(at_least).alias("tp"),
        F.sum(n - pos).over(at_least).alias("fp"),
        F.sum(pos).over(whole).alias("__p"),
        F.sum(n - pos).over(whole).alias("__neg"),
    ).where(F.col("__step") >= low)
    out = counted.select(
        *keys,
        (F.col("__step") / per).alias("threshold"),
        "tp",
        "fp",
        (F.col("__neg") - F.col("fp")).alias("tn"),
        (F.col("__p") - F.col("tp")).alias("fn"),
    )
    return confusion_rates(out)


def distinct_threshold_sweep(df: DataFrame, *, score: str, label: str) -> DataFrame:
    """The same table with every distinct score as a threshold."""
    table = score_table(df, score=score, label=label)
    totals = df.where(F.col(score).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col(label).cast("bigint")), F.lit(0)).alias("pos")
    )
    n, pos = totals.select("n").scalar(), totals.select("pos").scalar()
    tp = F.col("pos_above") + F.col("pos")
    fp = F.col("n_above") + F.col("n") - tp
    counted = table.select(F.col(score).alias("threshold"), tp.alias("tp"), fp.alias("fp")).withColumns({"__n": n, "__pos": pos})
    out = counted.select(
        "threshold",
        "tp",
        "fp",
        (F.col("__n") - F.col("__pos") - F.col("fp")).alias("tn"),
        (F.col("__pos") - F.col("tp")).alias("fn"),
    )
    return confusion_rates(out)


OBJECTIVES = {"f1": "f1", "f0.5": "f0_5", "balanced_accuracy": "balanced_accuracy", "precision_at_min_recall": "precision"}


# The constraint stages' steps, ends and labels.
RATE_END, RECALL_END, STAGE_STEP = 0.25, 0.05, 0.02
STAGE_LABELS = {
    "asked": "requested_constraints",
    "rate": "relaxed_max_positive_rate_to_{:.2f}",
    "recall": "relaxed_min_recall_to_{:.2f}",
}


def _ladder(start: float, end: float) -> list[float]:
    """The values from ``start`` (excluded) to ``end`` in stage steps, counted in whole ten-thousandths; the last step
    may be shorter. Empty where ``start`` is at ``end`` or beyond."""
    first, last, step = (round(x * 10_000) for x in (start, end, STAGE_STEP))
    direction = 1 if end > start else -1
    return [x / 10_000 for x in (*range(first + direction * step, last, direction * step), last)] if first != last else []


def relaxation_stages(min_recall: float, max_rate: float) -> list[tuple[str, float, float]]:
    """The constraint stages: as asked, then all higher rate limits, then all lower recall floors at the last rate limit."""
    rates = _ladder(max_rate, RATE_END) if max_rate < RATE_END else []
    recalls = _ladder(min_recall, RECALL_END) if min_recall > RECALL_END else []
    widest = max([max_rate, *rates])
    return [
        (STAGE_LABELS["asked"], min_recall, max_rate),
        *[(STAGE_LABELS["rate"].format(rate), min_recall, rate) for rate in rates],
        *[(STAGE_LABELS["recall"].format(recall), recall, widest) for recall in recalls],
    ]


def select_threshold(
    sweep: DataFrame, *, objective: str = "f0.5", min_recall: float, max_rate: float, tolerance: float = 0.0
) -> DataFrame:
    """The chosen threshold row, with the stage it passed.

    Stages only relax, so a row's first stage says which ones it passes; the best stage is the smallest first stage.
    """
    stages = relaxation_stages(min_recall, max_rate)
    first = F.lit(len(stages))
    for i, (_, recall, rate) in reversed(list(enumerate(stages))):
        first = F.when((F.col("recall") >= recall) & (F.col("positive_rate") <= rate), i).otherwise(first)
    names = F.array(*[F.lit(name) for name, _, _ in stages], F.lit("unconstrained_best"))
    scored = sweep.withColumns({"__stage": first, "objective_score": F.col(OBJECTIVES[objective])})
    best_stage = scored.agg(F.min("__stage")).scalar()
    inside = scored.where(F.col("__stage") == best_stage)
    floor = inside.agg(F.max("objective_score") - tolerance).scalar()
    return (
        inside.where(F.col("objective_score") >= floor)
        .orderBy(F.desc("precision"), F.asc("positive_rate"), F.desc("threshold"))
        .limit(1)
        .withColumn("fallback_stage", F.get(names, F.col("__stage")))
        .drop("__stage")
    )


def constrained(sweep: DataFrame, min_recall: float, max_rate: float) -> Column:
    return (F.col("recall") >= min_recall) & (F.col("positive_rate") <= max_rate)


def best_by_metric(sweep: DataFrame, *, metric: str, min_recall: float, max_rate: float) -> DataFrame:
    """Best row by a metric within the constraints, or over all rows where none satisfies them."""
    marked = sweep.withColumn("within", constrained(sweep, min_recall, max_rate))
    order = [F.desc("within"), F.desc(metric), F.desc("precision"), F.asc("positive_rate"), F.desc("threshold")]
    return marked.orderBy(*order).limit(1)


def best_precision(sweep: DataFrame, *, min_recall: float, max_rate: float) -> DataFrame:
    """Best precision within recall and rate limits, else within the recall floor alone, else over all rows."""
    level = F.when(constrained(sweep, min_recall, max_rate), 0).when(F.col("recall") >= min_recall, 1).otherwise(2)
    order = [F.asc("fallback_level"), F.desc("precision"), F.desc("f0_5"), F.desc("threshold")]
    return sweep.withColumn("fallback_level", level).orderBy(*order).limit(1)


def recommended_band(sweep: DataFrame, *, min_recall: float, max_rate: float, tolerance: float = 0.005) -> DataFrame:
    inside = sweep.where(constrained(sweep, min_recall, max_rate))
    best = inside.agg(F.max("f0_5") - tolerance).scalar()
    return inside.where(F.col("f0_5") >= best)


# ---------------------------------------------------------------- ranking quality


def ranked_rows(df: DataFrame, *, score: str, tie: str, name: str = "position") -> DataFrame:
    """1-based position of each row by score, best first."""
    return ranks(df, keys=[], value=score, tie=tie, best=name, total="__of").drop("__of")


def top_lift(df: DataFrame, *, score: str, label: str, tie: str, shares: Sequence[float] = (0.01, 0.02, 0.05, 0.10, 0.20)) -> DataFrame:
    """Hit rate, lift and capture of the top shares of the ranking; one pass over the positions."""
    facts = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos"))
    total, positives = facts.select("n").scalar(), facts.select("pos").scalar()
    placed = ranked_rows(df, score=score, tie=tie).withColumns({"__total": total})
    hits = [
        F.coalesce(
            F.sum(F.when(F.col("position") <= F.greatest(F.ceil(F.col("__total") * s), F.lit(1)), F.col(label).cast("bigint"))),
            F.lit(0),
        )
        for s in shares
    ]
    found = F.array(*[F.struct(F.lit(s).alias("top_percent"), h.alias("hits")) for s, h in zip(shares, hits)])
    long = placed.agg(found.alias("found")).select(F.inline("found"))
    long = long.withColumns({"__total": total, "__pos": positives})
    rows = F.greatest(F.ceil(F.col("__total") * F.col("top_percent")), F.lit(1))
    rate, base = safe_rate("hits", rows), safe_rate("__pos", "__total")
    return long.select(
        "top_percent",
        rows.alias("bucket_rows"),
        "hits",
        rate.alias("bucket_rate"),
        base.alias("baseline_rate"),
        safe_rate(rate, base).alias("lift"),
        safe_rate("hits", "__pos").alias("capture"),
    )


def score_buckets(df: DataFrame, *, score: str, label: str, tie: str, bins: int = 10) -> DataFrame:
    """Equal-count buckets by score (1 = highest) with cumulative capture."""
    total = df.agg(F.count(F.lit(1))).scalar()
    placed = ranked_rows(df, score=score, tie=tie).withColumn("__total", total)
    q = F.least(F.lit(bins), F.col("__total"))
    last = F.greatest(F.col("__total") - 1, F.lit(1))
    bucket = F.greatest(F.ceil((F.col("position") - 1) * q / last), F.lit(1)).cast("int")
    grouped = placed.groupBy(bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("bucket_rows"),
        F.avg(score).alias("avg_score"),
        F.avg(F.col(label).cast("double")).alias("actual_rate"),
        F.sum(F.col(label).cast("bigint")).alias("hits"),
    )
    through = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    grouped = grouped.withColumns({"cumulative_hits": F.sum("hits").over(through), "__all": F.sum("hits").over(Window.partitionBy())})
    label_text = F.concat((F.lit(bins + 1) - F.col("bucket")).cast("string"), F.lit(f"/{bins} (high-to-low)"))
    return grouped.withColumns({"cumulative_capture": safe_rate("cumulative_hits", "__all"), "bucket_label": label_text}).drop("__all")


def reliability(df: DataFrame, *, score: str, label: str, bins: int = 5) -> DataFrame:
    """Mean score and hit rate per uniform score bin; a score on an edge belongs to the lower bin."""
    bin_no = F.lit(0)
    for i in range(1, bins):
        bin_no = bin_no + flag(F.col(score) > i / bins)
    return df.where(F.col(score).isNotNull()).groupBy(bin_no.alias("bin")).agg(
        F.count(F.lit(1)).alias("bin_rows"), F.avg(score).alias("mean_predicted"), F.avg(F.col(label).cast("double")).alias("fraction_positive")
    )


# ---------------------------------------------------------------- tiers and policies


def apply_policy(
    ranked: DataFrame,
    *,
    probability: str,
    percentile: str = "slate_percentile",
    rank: str = "slate_rank",
    floors: Mapping[str, float] | None = None,
    probability_floor: float | None = None,
    top_k: int | None = None,
    name: str = "confidence_tier",
) -> DataFrame:
    """Tiers by slate percentile; elite may also need a probability and a rank."""
    floor = {"elite": 0.99, "strong": 0.95, "watch": 0.80, **(floors or {})}
    elite = is_elite(percentile, probability, rank, floor["elite"], probability_floor, top_k)
    tier = (
        F.when(elite, "elite")
        .when(F.col(percentile) >= floor["strong"], "strong")
        .when(F.col(percentile) >= floor["watch"], "watch")
        .otherwise("longshot")
    )
    return ranked.withColumn(name, tier)


def is_elite(percentile: str, probability: str, rank: str, floor: float, probability_floor: float | None, top_k: int | None) -> Column:
    elite = F.col(percentile) >= floor
    if probability_floor is not None:
        elite = elite & (F.col(probability) >= probability_floor)
    if top_k is not None:
        elite = elite & (F.col(rank) <= top_k)
    return F.coalesce(elite, F.lit(False))


def policy_search(
    ranked: DataFrame,
    *,
    probability: str,
    label: str,
    percentile: str = "slate_percentile",
    rank: str = "slate_rank",
    floors: Sequence[float | None] = (None, 0.18, 0.19, 0.20, 0.21, 0.22),
    top_ks: Sequence[int | None] = (None, 3, 2, 1),
) -> DataFrame:
    """All elite policies with sample and precision, and the selected one; one aggregate holds all policies."""
    policies = [(k, f) for k in top_ks for f in floors]
    aggregates = []
    for i, (k, f) in enumerate(policies):
        elite = is_elite(percentile, probability, rank, 0.99, f, k)
        aggregates += [F.sum(flag(elite)).alias(f"n{i}"), F.sum(F.when(elite, F.col(label).cast("bigint")).otherwise(0)).alias(f"h{i}")]
    rows = F.array(
        *[
            F.struct(
                F.lit(k).cast("int").alias("elite_top_k"),
                F.lit(f).cast("double").alias("elite_probability_floor"),
                F.coalesce(f"n{i}", F.lit(0)).alias("sample_size"),
                F.coalesce(f"h{i}", F.lit(0)).alias("hits"),
            )
            for i, (k, f) in enumerate(policies)
        ]
    )
    table = ranked.agg(*aggregates).select(F.inline(rows))
    whole = Window.partitionBy()
    is_base = F.col("elite_top_k").isNull() & F.col("elite_probability_floor").isNull()
    precision = F.coalesce(safe_rate("hits", "sample_size"), F.lit(0.0))
    table = table.withColumn("precision", precision)
    table = table.withColumns(
        {
            "__base_n": F.max(F.when(is_base, F.col("sample_size"))).over(whole),
            "__base_p": F.max(F.when(is_base, F.col("precision"))).over(whole),
        }
    )
    needed = F.greatest(F.ceil(F.col("__base_n") * 0.75), F.lit(1))
    lift = F.when(F.col("__base_p") > 0, F.col("precision") / F.col("__base_p") - 1.0).otherwise(0.0)
    eligible = (
        (F.col("sample_size") > 0)
        & (F.col("precision") > F.col("__base_p") + 1e-12)
        & ((F.col("sample_size") >= needed) | (lift >= 0.15))
    )
    order = Window.orderBy(
        F.desc("__eligible"),
        F.desc(F.when(F.col("__eligible"), F.col("precision")).otherwise(flag(is_base).cast("double"))),
        F.desc("sample_size"),
        F.asc(F.coalesce("elite_probability_floor", F.lit(-1.0))),
        F.asc(F.coalesce("elite_top_k", F.lit(999))),
    )
    table = table.withColumns({"__eligible": eligible, "precision_lift": lift})
    return table.withColumn("selected", F.row_number().over(order) == 1).select(
        "elite_top_k", "elite_probability_floor", "sample_size", "hits", "precision", "precision_lift", "selected"
    )


def usability(df: DataFrame, *, base_rate: Column) -> DataFrame:
    """Gate of metric rows: precision, recall, and predicted positives against the actual rate; with the reasons."""
    limit = base_rate * 1.25
    failures = F.array_compact(
        F.array(
            F.when(F.col("precision") < 0.18, F.format_string("precision %.4f < 0.18", "precision")),
            F.when(F.col("positive_rate") > limit, F.format_string("positive_prediction_rate %.4f > %.4f", "positive_rate", limit)),
            F.when(F.col("recall") < 0.10, F.format_string("recall %.4f < 0.10", "recall")),
        )
    )
    out = df.withColumn("passes", F.size(failures) == 0)
    reason = F.when(F.col("passes"), "passes all operational usability checks").otherwise(F.array_join(failures, "; "))
    # against a base rate of zero any prediction is infinitely too many, and none is as many as there should be
    zero = F.when(F.col("positive_rate") > 0, F.lit(float("inf"))).when(F.col("positive_rate").isNotNull(), 1.0)
    ratio = F.when(base_rate > 0, F.col("positive_rate") / base_rate).when(base_rate <= 0, zero)
    return out.withColumns({"reason": reason, "rate_ratio": ratio})


def metrics_at(df: DataFrame, *, score: str, label: str, threshold: Column) -> DataFrame:
    """One row of confusion counts and rates at one threshold, over the rows with a score, with their actual rate."""
    known = df.where(F.col(score).isNotNull()).withColumn("__t", threshold)
    hit, above = F.col(label) == 1, F.col(score) >= F.col("__t")
    counted = known.agg(
        F.max("__t").alias("threshold"),
        F.sum(flag(above & hit)).alias("tp"),
        F.sum(flag(above & ~hit)).alias("fp"),
        F.sum(flag(~above & ~hit)).alias("tn"),
        F.sum(flag(~above & hit)).alias("fn"),
        F.avg(F.col(label).cast("double")).alias("base_rate"),
    )
    return confusion_rates(counted)


def baseline_feature(
    train: DataFrame, test: DataFrame, *, feature: str, label: str, objective: str = "f0.5", min_recall: float, max_rate: float, tolerance: float
) -> DataFrame:
    """A single feature as a model: the threshold comes from the distinct training values, the metrics from the test rows."""
    # The sweep has one row per distinct value and is read several times below: compute it once.
    sweep = cut_lineage(distinct_threshold_sweep(train, score=feature, label=label))
    chosen = select_threshold(
        sweep, objective=objective, min_recall=min_recall, max_rate=max_rate, tolerance=tolerance
    )
    return metrics_at(test, score=feature, label=label, threshold=chosen.select("threshold").scalar()).drop("base_rate")


def rank_candidates(df: DataFrame, *, score: str, log_loss: str, brier: str, priority: str) -> DataFrame:
    """Order of model candidates (a small table) by selection score, log loss, Brier score and family priority."""
    order = Window.orderBy(F.desc_nulls_last(score), F.asc_nulls_last(log_loss), F.asc_nulls_last(brier), F.asc(priority))
    return df.withColumn("candidate_rank", F.row_number().over(order))


def promotion(
    df: DataFrame,
    *,
    score: str,
    precision: str,
    usable: str,
    passes: str,
    baseline_score: Column,
    baseline_precision: Column,
    windows: int = 6,
    needed: int = 5,
    margin: float = 1e-12,
) -> DataFrame:
    """Whether a candidate replaces the model in use: it passes the usability gate and enough rolling windows, is more
    precise than the baseline, and its score is at least as good; with the reasons against it."""
    reasons = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col(usable), F.lit(False)), F.lit("fails the usability gate")),
            F.when(F.col(passes) < needed, F.concat(F.lit("passes "), F.col(passes).cast("string"), F.lit(f" of {windows} windows"))),
            F.when(~(F.col(precision) > baseline_precision + margin), F.lit("is not more precise than the baseline")),
            F.when(~(F.col(score) + margin >= baseline_score), F.lit("scores below the baseline")),
        )
    )
    return df.withColumns({"promoted": F.size(reasons) == 0, "promotion_reason": F.array_join(reasons, "; ")})


def ranked_output(df: DataFrame, *, probability: str, tie: str, keys: Sequence[str]) -> DataFrame:
    """Global rank, percentile, score (percent, one digit), tier letter; one row per key, the best one."""
    up = ranks(df, keys=[], value=probability, tie=tie, best="rank", lowest="__up", total="__n")
    percentile = F.col("__up") / F.col("__n")
    tenths = F.floor((F.col("__up") * 2000 + F.col("__n")) / (F.col("__n") * 2))
    tier = F.when(percentile >= 0.99, "A").when(percentile >= 0.95, "B").when(percentile >= 0.80, "C").otherwise("D")
    out = up.withColumns({"percentile": percentile, "predicted_score": tenths / F.lit(10.0), "confidence_tier": tier}).drop("__up", "__n")
    best = Window.partitionBy(*keys).orderBy("rank")
    return out.withColumn("__first", F.row_number().over(best)).where("__first = 1").drop("__first")
