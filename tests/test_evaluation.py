import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from foretrace.operators import evaluation as E
from foretrace.operators import ranking as K
from foretrace.operators import reasons as N

DAY0 = datetime.date(2024, 3, 1)


def scored(seed, n=200, ties=True):
    rng = random.Random(seed)
    return [(round(rng.random(), 1) if ties else rng.random(), int(rng.random() < 0.3), i) for i in range(n)]


@pytest.mark.parametrize("ties", [True, False])
def test_probability_metrics_equal_brute_force(spark, ties):
    rows = scored(1, ties=ties)
    row = E.probability_metrics(spark.createDataFrame(rows, "s double, y int, i int"), score="s", label="y").first()
    pos, neg = [s for s, y, _ in rows if y], [s for s, y, _ in rows if not y]
    auc = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    ap, last = 0.0, 0.0
    for t in sorted({s for s, _, _ in rows}, reverse=True):
        tp = sum(p >= t for p in pos)
        recall, precision = tp / len(pos), tp / sum(s >= t for s, _, _ in rows)
        ap, last = ap + (recall - last) * precision, recall
    clipped = [(min(max(s, E.EPSILON), 1 - E.EPSILON), y) for s, y, _ in rows]
    loss = -sum(math.log(s) if y else math.log(1 - s) for s, y in clipped) / len(rows)
    assert row.roc_auc == pytest.approx(auc) and row.pr_auc == pytest.approx(ap)
    assert row.log_loss == pytest.approx(loss)
    assert row.brier_score == pytest.approx(sum((s - y) ** 2 for s, y, _ in rows) / len(rows))


def test_sweep_counts_every_threshold(spark):
    rows = scored(2)
    df = spark.createDataFrame(rows, "s double, y int, i int")
    for r in E.threshold_sweep(df, score="s", label="y").collect():
        tp = sum(s >= r.threshold and y for s, y, _ in rows)
        fp = sum(s >= r.threshold and not y for s, y, _ in rows)
        assert (r.tp, r.fp, r.tp + r.fp + r.tn + r.fn) == (tp, fp, len(rows))
    distinct = E.distinct_threshold_sweep(df, score="s", label="y").collect()
    assert len(distinct) == len({s for s, _, _ in rows})
    assert all(r.tp == sum(s >= r.threshold and y for s, y, _ in rows) for r in distinct)


def test_threshold_stages_relax_in_order(spark):
    sweep = spark.createDataFrame(
        [(0.1, 0.5, 0.30, 0.30, 0.40), (0.2, 0.6, 0.08, 0.20, 0.24), (0.3, 0.9, 0.02, 0.10, 0.05)],
        "threshold double, precision double, recall double, f0_5 double, positive_rate double",
    ).withColumns({"f1": F.col("f0_5"), "balanced_accuracy": F.col("f0_5")})
    row = E.select_threshold(sweep, objective="f0.5", min_recall=0.10, max_rate=0.12).first()
    assert (row.threshold, row.fallback_stage) == (0.2, "relaxed_min_recall_to_0.08")
    assert E.relaxation_stages(0.10, 0.23) == [
        ("requested_constraints", 0.10, 0.23),
        ("relaxed_max_positive_rate_to_0.25", 0.10, 0.25),
        ("relaxed_min_recall_to_0.08", 0.08, 0.25),
        ("relaxed_min_recall_to_0.06", 0.06, 0.25),
        ("relaxed_min_recall_to_0.05", 0.05, 0.25),
    ]


def test_split_folds_and_windows(spark):
    rows = [(DAY0 + datetime.timedelta(days=i // 4), i // 2, i) for i in range(24)]
    df = spark.createDataFrame(rows, "d date, g int, p int")
    parts = E.chronological_split(df, date="d").groupBy("part").agg(F.min("d"), F.max("d"), F.count("*")).collect()
    train, test = sorted(parts, key=lambda r: r[1])
    assert train["part"] == "train" and train[2] < test[1] and train[3] == 16
    folds = {r.p: r.fold for r in E.expanding_folds(df, blocks=["d", "g"], order=["p"]).collect()}
    assert folds == {i: i // 4 for i in range(24)}


def test_rolling_windows_skip_the_off_season(spark):
    newest = datetime.date(2024, 9, 30)
    rows = [(newest - datetime.timedelta(days=d),) for d in [0, 5, 27, 28, 200, 201, 210]]
    got = E.rolling_windows(spark.createDataFrame(rows, "d date"), date="d").orderBy("window_index").collect()
    assert [(r.window_index, r.holdout_rows, r.train_rows) for r in got] == [(1, 3, 4), (2, 1, 3), (3, 3, 0)]
    assert got[0].holdout_start == newest - datetime.timedelta(days=27) and got[2].train_end is None


def test_tier_policy_with_floor_and_top_k(spark):
    df = spark.createDataFrame([("d", 0.21, 1, 1), ("d", 0.20, 0, 2), ("d", 0.18, 0, 3), ("d", 0.10, 0, 4)], "slate string, p double, y int, i int")
    ranked = K.slate_percentile(df, slate="slate", score="p", tie="i")
    got = {r.i: r.confidence_tier for r in E.apply_policy(ranked, probability="p", probability_floor=0.22, top_k=1).collect()}
    assert got == {1: "strong", 2: "longshot", 3: "longshot", 4: "longshot"}
    got = {r.i: r.confidence_tier for r in E.apply_policy(ranked, probability="p", probability_floor=0.19, top_k=1).collect()}
    assert got[1] == "elite"


def test_policy_search_prefers_the_floor_that_removes_misses(spark):
    rows = []
    for d in range(8):
        top = 0.195 + d * 0.002 if d % 2 == 0 else 0.185
        rows.append((f"d{d}", top, int(d % 2 == 0), 100 * d))
        rows += [(f"d{d}", 0.05 + i / 1000, 0, 100 * d + i + 1) for i in range(19)]
    ranked = K.slate_percentile(spark.createDataFrame(rows, "slate string, p double, y int, i int"), slate="slate", score="p", tie="i")
    table = E.policy_search(ranked, probability="p", label="y").collect()
    chosen = [r for r in table if r.selected]
    base = [r for r in table if r.elite_top_k is None and r.elite_probability_floor is None]
    assert len(table) == 24 and len(chosen) == 1 and base[0].sample_size == 8
    assert (chosen[0].elite_probability_floor, chosen[0].precision) == (0.19, 1.0)


def test_lift_and_buckets(spark):
    rows = [((100 - i) / 101, int(i < 10), i) for i in range(100)]
    df = spark.createDataFrame(rows, "s double, y int, i int")
    lift = {r.top_percent: (r.bucket_rows, r.hits, r.lift, r.capture) for r in E.top_lift(df, score="s", label="y", tie="i").collect()}
    assert lift[0.05] == pytest.approx((5, 5, 10.0, 0.5)) and lift[0.2] == pytest.approx((20, 10, 5.0, 1.0))
    buckets = E.score_buckets(df, score="s", label="y", tie="i").orderBy("bucket").collect()
    assert [b.bucket_rows for b in buckets] == [10] * 10 and buckets[0].hits == 10 and buckets[-1].cumulative_capture == 1.0


def test_reasons_take_the_best_of_each_bucket(spark):
    reference = spark.createDataFrame([(float(i), float(i), float(i)) for i in range(100)], "bat double, bat2 double, pitch double")
    rules = {
        "bat": N.ReasonRule("batter", 1.0, "bat %s", percent=False),
        "bat2": N.ReasonRule("batter", 0.5, "bat2 %s", percent=False),
        "pitch": N.ReasonRule("pitcher", 1.0, "pitch %s", percent=False),
        "absent": N.ReasonRule("context", 1.0, "absent %s"),
    }
    rows = spark.createDataFrame([("a", 95.0, 96.0, 97.0), ("b", 5.0, None, 10.0), ("c", None, None, None)], "id string, bat double, bat2 double, pitch double")
    got = {r.id: (r.top_reason_1, r.top_reason_2, r.top_reason_3) for r in N.top_reasons(rows, reference, key="id", rules=rules).collect()}
    assert got["a"] == ("bat 95.0", "pitch 97.0", "bat2 96.0")
    assert got["b"] == ("bat 5.0", "pitch 10.0", "")
    assert got["c"] == (N.FALLBACK, "", "")


def test_quantiles_are_exact(spark):
    values = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0]
    ref = spark.createDataFrame([("f", v) for v in values], "feature string, value double")
    row = N.feature_quantiles(N.value_positions(ref, ref.limit(0))).first()
    ordered = sorted(values)
    for name, q in N.QUANTILES.items():
        at = q * (len(ordered) - 1)
        low = int(at)
        high = min(low + 1, len(ordered) - 1)
        assert row[name] == pytest.approx(ordered[low] + (ordered[high] - ordered[low]) * (at - low))


def test_promotion_needs_all_four_gates(spark):
    rows = [("same score", 0.5, 0.4, True, 5), ("less precise", 0.9, 0.3, True, 6), ("unusable", 0.9, 0.4, False, 6), ("windows", 0.9, 0.4, True, 4), ("score", 0.49, 0.4, True, 6)]
    df = spark.createDataFrame(rows, "name string, pr_auc double, precision double, ok boolean, passed int")
    out = E.promotion(df, score="pr_auc", precision="precision", usable="ok", passes="passed", baseline_score=F.lit(0.5), baseline_precision=F.lit(0.3))
    got = {r.name: (r.promoted, r.promotion_reason) for r in out.collect()}
    assert got["same score"] == (True, "")
    assert [n for n, (p, _) in got.items() if p] == ["same score"]
    assert got["windows"][1] == "passes 4 of 6 windows"


def test_rate_ratio_of_a_zero_base(spark):
    df = spark.createDataFrame([(0.5, 0.5, 0.5), (0.5, 0.5, 0.0)], "precision double, recall double, positive_rate double")
    ratios = [r.rate_ratio for r in E.usability(df, base_rate=F.lit(0.0)).collect()]
    assert ratios == [float("inf"), 1.0]


def test_many_rows_do_not_overflow(spark):
    # four billion positives of eight billion rows, as two distinct scores
    table = spark.createDataFrame([(0.9, 4_000_000_000, 4_000_000_000), (0.1, 4_000_000_000, 0)], "score double, n long, pos long")
    from foretrace.operators import evaluation

    original = evaluation.score_table
    try:
        evaluation.score_table = lambda *_, **__: table.withColumns(
            {"n_above": F.when(F.col("score") > 0.5, 0).otherwise(4_000_000_000).cast("long"), "pos_above": F.when(F.col("score") > 0.5, 0).otherwise(4_000_000_000).cast("long")}
        )
        row = evaluation.probability_metrics(table, score="score", label="label").first()
    finally:
        evaluation.score_table = original
    assert row.roc_auc == 1.0 and row.n_rows == 8_000_000_000
