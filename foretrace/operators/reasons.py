"""Explanations of ranked rows: which features stand out against a reference population."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretrace.operators.scan import range_prior
from foretrace.session import cut_lineage

QUANTILES = {"q60": 0.60, "q75": 0.75, "q85": 0.85, "q90": 0.90}
BUCKETS = ("batter", "pitcher", "context")
PRIORITY = {"batter": 3.0, "pitcher": 2.5, "context": 1.0}
FALLBACK = "No single feature stands out; the overall recent form and matchup profile is favourable."


# The word for a percentile from so much on, and who stands for an opponent without a name.
STRENGTHS = {0.90: "top-decile", 0.75: "top-quartile", 0.0: "above-baseline"}
UNNAMED = "the opposing pitcher"


@dataclass(frozen=True)
class ReasonRule:
    """How a feature explains a pick: its bucket, weight, and a template with ``%s`` for the formatted value.

    ``{strength}`` in a template becomes the word for the value's percentile, ``{opponent}`` the name of the opponent.
    """

    bucket: str
    weight: float
    template: str
    percent: bool = True
    binary: bool = False


# Features that describe the setting of a game.
CONTEXT_FEATURES = ("temperature_f", "wind_speed_mph", "humidity_pct", "platoon_advantage", "park_factor_hr_vs_batter_hand")


def reason_weights(coefficients: Mapping[str, float], features: Sequence[str]) -> dict[str, float]:
    """Positive coefficients as weights, also of a feature's shrunk form; 1 for every feature where none is positive."""
    if not any(c > 0 for c in coefficients.values()):
        return {f.removesuffix("_shrunk"): 1.0 for f in features}
    best: dict[str, float] = {}
    for feature in features:
        name = feature.removesuffix("_shrunk")
        best[name] = max(best.get(name, 0.0), coefficients.get(feature, 0.0))
    return {name: weight for name, weight in best.items() if weight > 0}


def rules_for(weights: Mapping[str, float]) -> dict[str, ReasonRule]:
    """Default rules: bucket from the feature's name, a plain sentence, percent for rates."""
    rules = {}
    for feature, weight in weights.items():
        bucket = "context" if feature in CONTEXT_FEATURES else "pitcher" if feature.startswith("pitcher_") else "batter"
        label = feature.replace("_", " ")
        if feature == "platoon_advantage":
            rules[feature] = ReasonRule(bucket, weight, "Has the platoon advantage.", binary=True)
        else:
            percent = any(part in feature for part in ("rate", "_per_", "_pct"))
            rules[feature] = ReasonRule(bucket, weight, f"{label[0].upper()}{label[1:]} is %s.", percent=percent)
    return rules


def unpivoted(df: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    doubles = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in features])
    return doubles.unpivot(list(ids), list(features), "feature", "value").where(F.col("value").isNotNull())


def value_positions(reference: DataFrame, candidates: DataFrame) -> DataFrame:
    """Rows of both in the order of (feature, value), references first, and for each the number of references before it
    (``below``): of a candidate, those with a smaller or an equal value.

    Rows are placed by ranges of their values, ties apart, so that a frequent value is no task's work and nothing is
    joined by value.
    """
    rows = reference.select("feature", "value", F.lit(0).alias("__candidate")).unionByName(
        candidates.withColumn("__candidate", F.lit(1)), allowMissingColumns=True
    )
    rows = rows.withColumn("__tie", F.monotonically_increasing_id())
    order = [F.asc("value"), F.asc("__candidate"), F.asc("__tie")]
    return range_prior(rows, keys=["feature"], order=order, sums={"below": 1 - F.col("__candidate")}).drop("__tie")


def feature_quantiles(positions: DataFrame) -> DataFrame:
    """Exact quantiles with linear interpolation, per feature, from value positions (no feature is gathered in one task)."""
    placed = positions.where("__candidate = 0")
    totals = placed.groupBy("feature").agg(F.count(F.lit(1)).alias("total"))
    placed = placed.join(F.broadcast(totals), "feature")  # a row for each feature
    aggregates = [F.max("total").alias("total")]
    for name, q in QUANTILES.items():
        at = q * (F.col("total") - 1)
        for part, index in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            aggregates.append(F.max(F.when(F.col("below") == index, F.col("value"))).alias(f"{name}_{part}"))
    found = placed.groupBy("feature").agg(*aggregates)

    def value(name: str, q: float) -> Column:
        at = q * (F.col("total") - 1)
        low, high = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        return (low + (high - low) * (at - F.floor(at))).alias(name)

    return found.select("feature", "total", *[value(n, q) for n, q in QUANTILES.items()])


def top_reasons(
    candidates: DataFrame, reference: DataFrame, *, key: str, rules: Mapping[str, ReasonRule], most: int = 3, opponent: str | None = None
) -> DataFrame:
    """Up to ``most`` reasons per candidate: the best of each bucket in order, then the best of the rest.

    ``opponent`` names the column with the opponent's name. Strong, medium and supporting signals follow the quantiles of the reference; a candidate without any signal gets
    its features by weight and percentile. A row has at most one entry per feature, so its array is short.
    """
    usable = {f: r for f, r in rules.items() if r.weight > 0 and f in candidates.columns and f in reference.columns}
    named = candidates.withColumn("__opponent", F.coalesce(F.col(opponent).cast("string") if opponent else F.lit(None), F.lit(UNNAMED)))
    positions = cut_lineage(value_positions(unpivoted(reference, [], list(usable)), unpivoted(named, [key, "__opponent"], list(usable))))
    quantiles = feature_quantiles(positions)
    joined = positions.where("__candidate = 1").join(F.broadcast(quantiles), "feature")  # a row for each feature

    def per_feature(values: Mapping[str, object]) -> Column:
        return F.try_element_at(F.create_map(*[F.lit(v) for item in values.items() for v in item]), F.col("feature"))

    binary = per_feature({f: r.binary for f, r in usable.items()})
    bucket = per_feature({f: r.bucket for f, r in usable.items()})
    weight = per_feature({f: float(r.weight) for f, r in usable.items()})
    place = per_feature({f: i for i, f in enumerate(usable)})
    shown = F.when(per_feature({f: r.percent for f, r in usable.items()}), F.format_string("%.1f%%", F.bround(F.col("value") * 100, 1))).otherwise(
        F.format_string("%.1f", F.bround("value", 1))
    )
    text = F.replace(per_feature({f: r.template for f, r in usable.items()}), F.lit("%s"), shown)
    percentile = F.when(binary, 1.0).otherwise(F.col("below") / F.col("total"))
    word = F.lit("")
    for floor, said in sorted(STRENGTHS.items()):
        word = F.when(percentile >= floor, said).otherwise(word)
    text = F.replace(F.replace(text, F.lit("{strength}"), word), F.lit("{opponent}"), F.col("__opponent"))
    joined = joined.withColumns(
        {
            "__bucket": bucket,
            "__place": place,
            "__text": text,
            "__on": binary & (F.col("value") >= 1),
            "__p": percentile,
            "__w": weight,
        }
    )
    context = F.col("__bucket") == "context"
    on = F.col("__on")
    level = (
        F.when(on | (F.col("value") >= F.col("q90")), 2.0)
        .when(F.col("value") >= F.when(context, F.col("q85")).otherwise(F.col("q75")), 1.0)
        .when(~context & (F.col("value") >= F.col("q60")), 0.5)
    )
    priority = F.lit(0.0)
    for name, points in PRIORITY.items():
        priority = F.when(F.col("__bucket") == name, points).otherwise(priority)
    joined = joined.withColumns({"__level": level, "__base": F.col("__w") + F.col("__p") + priority})
    # Sorting by (minus score, rule order) makes equal scores keep the order of the rules.
    item = F.struct(
        (-(F.coalesce("__level", F.lit(0.0)) + F.col("__base"))).alias("score"),
        F.col("__place").alias("place"),
        F.col("__bucket").alias("bucket"),
        F.col("__text").alias("text"),
        F.col("__level").isNotNull().alias("signal"),
    )
    gathered = joined.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("__all"))
    signals = F.filter("__all", lambda r: r["signal"])
    gathered = gathered.withColumn("__pool", F.when(F.size(signals) > 0, signals).otherwise(F.col("__all")))

    def best_of(bucket: str) -> Column:
        return F.get(F.filter("__pool", lambda r: r["bucket"] == bucket), F.lit(0))["text"]

    firsts = F.array_compact(F.array(*[best_of(b) for b in BUCKETS]))
    ordered = F.transform("__pool", lambda r: r["text"])
    chosen = F.slice(F.array_distinct(F.concat(firsts, ordered)), 1, most)
    reasons = gathered.select(key, chosen.alias("__reasons"))
    out = candidates.select(key).join(reasons, key, "left")
    texts = F.coalesce("__reasons", F.array(F.lit(FALLBACK)))
    return out.select(
        key, *[F.coalesce(F.get(texts, F.lit(i)), F.lit("")).alias(f"top_reason_{i + 1}") for i in range(most)]
    )
