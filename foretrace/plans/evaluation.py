"""Queries of chronological evaluation, ranking metrics, policies and reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretrace.functions import scalar as S
from foretrace.operators import evaluation as E
from foretrace.operators import history as H
from foretrace.operators import ranking as K
from foretrace.operators import reasons as N
from foretrace.plans import tables as T
from foretrace.plans import windows as W
from foretrace.plans.registry import query
from foretrace.plans.tables import BG_SQL, PA_SQL
from foretrace.plans.windows import round_doubles
from foretrace.sources.readers import table

SCORED_SQL = """sc AS (SELECT event_id, user_id, CAST(ts AS DATE) AS slate, value / 500 AS score, floor(value / 10) / 50 AS tied,
  CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label FROM events)"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id",
        "user_id",
        F.col("ts").cast("date").alias("slate"),
        (F.col("value") / 500).alias("score"),
        (F.floor(F.col("value") / 10) / 50).alias("tied"),
        S.flag(F.col("event_type") == "purchase").alias("label"),
    )


# ---------------------------------------------------------------- splits

CUTOFF_SQL = """cut AS (SELECT slate AS cutoff FROM (SELECT slate, row_number() OVER (ORDER BY slate) - 1 AS i, count(*) OVER () AS n FROM sc)
  WHERE i = least(greatest(CAST(floor(n * CAST(0.67 AS DOUBLE)) AS BIGINT), 1), n - 1))"""


@query("chrono_split", f"WITH {SCORED_SQL}, {CUTOFF_SQL} SELECT event_id, CASE WHEN slate < cutoff THEN 'train' ELSE 'test' END AS part FROM sc, cut")
def chrono_split(spark: SparkSession, sf: str) -> DataFrame:
    return E.chronological_split(scored(spark, sf), date="slate").select("event_id", "part")


@query(
    "split_integrity",
    f"""WITH {SCORED_SQL}, {CUTOFF_SQL} SELECT max(CASE WHEN slate < cutoff THEN slate END) AS last_train, min(CASE WHEN slate >= cutoff THEN slate END) AS first_test,
      CAST(0 AS BIGINT) AS null_rows, count(*) - count(DISTINCT event_id) AS duplicate_rows,
      max(CASE WHEN slate < cutoff THEN slate END) < min(CASE WHEN slate >= cutoff THEN slate END) AND count(*) = count(DISTINCT event_id) AS passes FROM sc, cut""",
)
def split_integrity(spark: SparkSession, sf: str) -> DataFrame:
    parts = E.chronological_split(scored(spark, sf), date="slate")
    return E.split_integrity(parts, date="slate", part="part", keys=["event_id"], required=["slate", "user_id", "label"])


FOLD_SQL = f"""{PA_SQL}, pos AS (SELECT event_id, game_date, launch_speed, launch_angle, hc_x, row_number() OVER (ORDER BY game_date, game_pk, event_id) - 1 AS i, count(*) OVER () AS n FROM pa),
  folds AS (SELECT *, CAST(greatest(5 - ((n - 1 - i) // (n // 6)), 0) AS INTEGER) AS fold FROM pos)"""


def folded(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.raw_events(spark, sf).select("event_id", "game_date", "game_pk", "launch_speed", "launch_angle", F.col("hc_x").try_cast("double").alias("hc_x"))
    return E.expanding_folds(rows, blocks=["game_date", "game_pk"], order=["event_id"])


@query("expanding_folds", f"WITH {FOLD_SQL} SELECT event_id, fold FROM folds")
def expanding_folds(spark: SparkSession, sf: str) -> DataFrame:
    return folded(spark, sf).select("event_id", "fold")


@query(
    "fold_missingness",
    f"""WITH {FOLD_SQL}, f AS (SELECT unnest([1, 2, 3, 4, 5]) AS k), m AS (SELECT fold, CASE WHEN launch_speed IS NULL THEN 1 ELSE 0 END AS a, CASE WHEN TRY_CAST(hc_x AS DOUBLE) IS NULL THEN 1 ELSE 0 END AS b FROM folds),
    t AS (SELECT k AS fold, sum(CASE WHEN m.fold < k THEN 1 ELSE 0 END) AS train_rows, sum(CASE WHEN m.fold = k THEN 1 ELSE 0 END) AS valid_rows,
      sum(CASE WHEN m.fold < k THEN a END) AS ma, sum(CASE WHEN m.fold < k THEN b END) AS mb FROM m, f GROUP BY k)
    SELECT CAST(fold AS INTEGER) AS fold, 'launch_speed' AS feature_name, CAST(train_rows AS BIGINT) AS train_rows, CAST(valid_rows AS BIGINT) AS valid_rows, round(CAST(ma AS DOUBLE) / train_rows * 100, 6) AS missing_pct, ma = train_rows AS fully_missing FROM t
    UNION ALL SELECT CAST(fold AS INTEGER), 'hc_x', CAST(train_rows AS BIGINT), CAST(valid_rows AS BIGINT), round(CAST(mb AS DOUBLE) / train_rows * 100, 6), mb = train_rows FROM t""",
)
def fold_missingness(spark: SparkSession, sf: str) -> DataFrame:
    return round_doubles(E.fold_missingness(folded(spark, sf), ["launch_speed", "hc_x"]))


@query(
    "rolling_holdouts",
    """WITH d AS (SELECT CAST(o_orderdate AS DATE) AS d FROM orders), m AS (SELECT max(d) AS top FROM d), w AS (SELECT unnest(generate_series(0, 5)) AS k),
    b AS (SELECT k, top - CAST(28 * k AS INTEGER) AS e, top - CAST(28 * k + 27 AS INTEGER) AS s FROM w, m)
    SELECT CAST(k + 1 AS INTEGER) AS window_index, CAST(s AS DATE) AS holdout_start, CAST(e AS DATE) AS holdout_end, (SELECT min(d) FROM d WHERE d < s) AS train_start, (SELECT max(d) FROM d WHERE d < s) AS train_end,
      (SELECT count(*) FROM d WHERE d < s) AS train_rows, (SELECT count(*) FROM d WHERE d BETWEEN s AND e) AS holdout_rows FROM b""",
)
def rolling_holdouts(spark: SparkSession, sf: str) -> DataFrame:
    days = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("day"))
    return E.rolling_windows(days, date="day")


@query(
    "missingness_prune",
    f"""WITH {PA_SQL}, m AS (SELECT avg(CASE WHEN launch_speed IS NULL THEN CAST(1 AS DOUBLE) ELSE 0 END) AS a, avg(CASE WHEN des IS NULL THEN CAST(1 AS DOUBLE) ELSE 0 END) AS b FROM pa)
    SELECT 'launch_speed' AS feature_name, round(a * 100, 6) AS training_missing_pct, CASE WHEN a <= 0.35 THEN 'yes' ELSE 'no' END AS keep_for_model FROM m
    UNION ALL SELECT 'des', round(b * 100, 6), CASE WHEN b <= 0.35 THEN 'yes' ELSE 'no' END FROM m UNION ALL SELECT 'absent', CAST(100 AS DOUBLE), 'no'""",
)
def missingness_prune(spark: SparkSession, sf: str) -> DataFrame:
    return round_doubles(E.missingness(T.raw_events(spark, sf), ["launch_speed", "des", "absent"], threshold=0.35))


# ---------------------------------------------------------------- metrics


def metrics_sql(keys: str, score: str) -> str:
    group, part = (f"{keys}, ", f"PARTITION BY {keys} ") if keys else ("", "")
    tail = f"GROUP BY {keys}" if keys else ""
    return f"""ds AS (SELECT {group}{score} AS s, count(*) AS n, CAST(sum(label) AS BIGINT) AS p FROM sc GROUP BY {group}{score}),
    cu AS (SELECT *, sum(n) OVER w AS cn, sum(p) OVER w AS cp FROM ds WINDOW w AS ({part}ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
    me AS (SELECT {group}CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(p) AS BIGINT) AS positives, sum(p * (CAST(cp AS DOUBLE) / cn)) / nullif(sum(p), 0) AS pr_auc,
      sum((n - p) * (cp - p + CAST(p AS DOUBLE) / 2)) / nullif(CAST(sum(p) AS DOUBLE) * (sum(n) - sum(p)), 0) AS roc_auc,
      sum(-(p * ln(greatest(least(s, 1 - 2.220446049250313e-16), 2.220446049250313e-16)) + (n - p) * ln(1 - greatest(least(s, 1 - 2.220446049250313e-16), 2.220446049250313e-16)))) / sum(n) AS log_loss,
      sum(p * (1 - s) * (1 - s) + (n - p) * s * s) / sum(n) AS brier_score FROM cu {tail})"""


METRICS = "n_rows, positives, round(pr_auc, 6) AS pr_auc, round(roc_auc, 6) AS roc_auc, round(log_loss, 6) AS log_loss, round(brier_score, 6) AS brier_score"


@query("prob_metrics", f"WITH {SCORED_SQL}, {metrics_sql('', 'tied')} SELECT {METRICS} FROM me")
def prob_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return round_doubles(E.probability_metrics(scored(spark, sf), score="tied", label="label"))


@query("prob_metrics_untied", f"WITH {SCORED_SQL}, {metrics_sql('slate', 'score')} SELECT slate, {METRICS} FROM me")
def prob_metrics_untied(spark: SparkSession, sf: str) -> DataFrame:
    return round_doubles(E.probability_metrics(scored(spark, sf), score="score", label="label", keys=["slate"]))


RATES_SQL = """precision, recall, CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1, CASE WHEN tp = 0 THEN 0 ELSE 1.25 * tp / (1.25 * tp + fp + 0.25 * fn) END AS f0_5,
  (recall + CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END) / 2 AS balanced_accuracy, (tp + fp) / (tp + fp + tn + fn) AS positive_rate"""


def sweep_sql(points: str, score: str, source: str = "sc") -> str:
    """Confusion table at the thresholds that the subquery ``points`` lists in column ``t``."""
    return f"""cnt AS (SELECT t, CAST(sum(CASE WHEN {score} >= t AND label = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS tp, CAST(sum(CASE WHEN {score} >= t AND label = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
      CAST(sum(CASE WHEN {score} < t AND label = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS tn, CAST(sum(CASE WHEN {score} < t AND label = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS fn
      FROM {source}, ({points}) WHERE {score} IS NOT NULL GROUP BY t),
    pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM cnt),
    sw AS (SELECT t AS threshold, tp, fp, tn, fn, {RATES_SQL} FROM pr)"""


GRID = "SELECT unnest(generate_series(5, 50)) / CAST(100 AS DOUBLE) AS t"
SWEEP_OUT = """round(threshold, 6) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1, 6) AS f1, round(f0_5, 6) AS f0_5, round(balanced_accuracy, 6) AS balanced_accuracy, round(positive_rate, 6) AS positive_rate"""


@query("threshold_sweep", f"WITH {SCORED_SQL}, {sweep_sql(GRID, 'tied')} SELECT {SWEEP_OUT} FROM sw")
def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return round_doubles(E.threshold_sweep(scored(spark, sf), score="tied", label="label"))


def select_sql(objective: str, min_recall: float, max_rate: float, tolerance: float) -> str:
    stages = E.relaxation_stages(min_recall, max_rate)
    case = "CASE " + " ".join(f"WHEN recall >= {r} AND positive_rate <= {x} THEN {i}" for i, (_, r, x) in enumerate(stages)) + f" ELSE {len(stages)} END"
    names = "CASE st " + " ".join(f"WHEN {i} THEN '{n}'" for i, (n, _, _) in enumerate(stages)) + " ELSE 'unconstrained_best' END"
    return f"""sg AS (SELECT *, {case} AS st, {objective} AS objective_score FROM sw), bs AS (SELECT * FROM sg WHERE st = (SELECT min(st) FROM sg)),
    ch AS (SELECT *, {names} AS fallback_stage FROM bs WHERE objective_score >= (SELECT max(objective_score) FROM bs) - {tolerance} ORDER BY precision DESC, positive_rate, threshold DESC LIMIT 1)"""


@query(
    "threshold_select",
    f"WITH {SCORED_SQL}, {sweep_sql(GRID, 'tied')}, {select_sql('f0_5', 0.6, 0.12, 0.005)} SELECT {SWEEP_OUT}, fallback_stage, round(objective_score, 6) AS objective_score FROM ch",
)
def threshold_select(spark: SparkSession, sf: str) -> DataFrame:
    sweep = E.threshold_sweep(scored(spark, sf), score="tied", label="label")
    return round_doubles(E.select_threshold(sweep, objective="f0.5", min_recall=0.6, max_rate=0.12, tolerance=0.005))


@query(
    "threshold_band",
    f"""WITH {SCORED_SQL}, {sweep_sql(GRID, 'tied')}, c AS (SELECT * FROM sw WHERE recall >= 0.1 AND positive_rate <= 0.3)
    SELECT 'band' AS rule, round(threshold, 6) AS threshold FROM c WHERE f0_5 >= (SELECT max(f0_5) FROM c) - 0.005
    UNION ALL SELECT 'best f1', round(threshold, 6) FROM (SELECT threshold FROM sw ORDER BY recall >= 0.1 AND positive_rate <= 0.3 DESC, f1 DESC, precision DESC, positive_rate, threshold DESC LIMIT 1)
    UNION ALL SELECT 'best precision', round(threshold, 6) FROM (SELECT threshold FROM sw ORDER BY CASE WHEN recall >= 0.9 AND positive_rate <= 0.3 THEN 0 WHEN recall >= 0.9 THEN 1 ELSE 2 END, precision DESC, f0_5 DESC, threshold DESC LIMIT 1)""",
)
def threshold_band(spark: SparkSession, sf: str) -> DataFrame:
    sweep = E.threshold_sweep(scored(spark, sf), score="tied", label="label")
    rows = {
        "band": E.recommended_band(sweep, min_recall=0.1, max_rate=0.3),
        "best f1": E.best_by_metric(sweep, metric="f1", min_recall=0.1, max_rate=0.3),
        "best precision": E.best_precision(sweep, min_recall=0.9, max_rate=0.3),
    }
    out = None
    for rule, chosen in rows.items():
        part = chosen.select(F.lit(rule).alias("rule"), F.round("threshold", 6).alias("threshold"))
        out = part if out is None else out.unionByName(part)
    return out


RANKED_SQL = "rk AS (SELECT *, row_number() OVER (ORDER BY score DESC, event_id) AS pos, count(*) OVER () AS n FROM sc)"


@query(
    "top_lift",
    f"""WITH {SCORED_SQL}, {RANKED_SQL}, p AS (SELECT unnest([0.01, 0.02, 0.05, 0.1, 0.2]::DOUBLE[]) AS top_percent), b AS (SELECT top_percent, greatest(CAST(ceil(max(n) * top_percent) AS BIGINT), 1) AS bucket_rows,
      CAST(sum(CASE WHEN pos <= greatest(ceil(n * top_percent), 1) THEN label ELSE 0 END) AS BIGINT) AS hits, CAST(sum(label) AS DOUBLE) AS total, CAST(count(*) AS DOUBLE) AS n FROM rk, p GROUP BY top_percent)
    SELECT top_percent, bucket_rows, hits, round(CAST(hits AS DOUBLE) / bucket_rows, 6) AS bucket_rate, round(total / n, 6) AS baseline_rate, round((CAST(hits AS DOUBLE) / bucket_rows) / (total / n), 6) AS lift, round(hits / total, 6) AS capture FROM b""",
)
def top_lift(spark: SparkSession, sf: str) -> DataFrame:
    return round_doubles(E.top_lift(scored(spark, sf), score="score", label="label", tie="event_id"))


@query(
    "score_deciles",
    f"""WITH {SCORED_SQL}, {RANKED_SQL}, b AS (SELECT CAST(greatest(ceil(CAST((pos - 1) * 10 AS DOUBLE) / (n - 1)), 1) AS INTEGER) AS bucket, score, label FROM rk),
    g AS (SELECT bucket, count(*) AS bucket_rows, avg(score) AS avg_score, avg(CAST(label AS DOUBLE)) AS actual_rate, CAST(sum(label) AS BIGINT) AS hits FROM b GROUP BY bucket)
    SELECT bucket, bucket_rows, round(avg_score, 6) AS avg_score, round(actual_rate, 6) AS actual_rate, hits, CAST(sum(hits) OVER (ORDER BY bucket) AS BIGINT) AS cumulative_hits,
      round(CAST(sum(hits) OVER (ORDER BY bucket) AS DOUBLE) / sum(hits) OVER (), 6) AS cumulative_capture, (11 - bucket) || '/10 (high-to-low)' AS bucket_label FROM g""",
)
def score_deciles(spark: SparkSession, sf: str) -> DataFrame:
    return round_doubles(E.score_buckets(scored(spark, sf), score="score", label="label", tie="event_id"))


@query(
    "reliability_bins",
    f"""WITH {SCORED_SQL}, b AS (SELECT CASE WHEN tied > 0.8 THEN 4 WHEN tied > 0.6 THEN 3 WHEN tied > 0.4 THEN 2 WHEN tied > 0.2 THEN 1 ELSE 0 END AS bin, tied, label FROM sc)
    SELECT bin, count(*) AS bin_rows, round(avg(tied), 6) AS mean_predicted, round(avg(CAST(label AS DOUBLE)), 6) AS fraction_positive FROM b GROUP BY bin""",
)
def reliability_bins(spark: SparkSession, sf: str) -> DataFrame:
    return round_doubles(E.reliability(scored(spark, sf), score="tied", label="label"))


# ---------------------------------------------------------------- policies

SLATE_SQL = """sl AS (SELECT *, row_number() OVER (PARTITION BY slate ORDER BY score DESC, event_id) AS rk, CAST(row_number() OVER (PARTITION BY slate ORDER BY score, event_id) AS DOUBLE) / count(*) OVER (PARTITION BY slate) AS pct FROM sc)"""


def slated(spark: SparkSession, sf: str) -> DataFrame:
    return K.slate_percentile(scored(spark, sf), slate="slate", score="score", tie="event_id")


@query(
    "tier_policy",
    f"""WITH {SCORED_SQL}, {SLATE_SQL} SELECT event_id, CASE WHEN pct >= 0.99 AND score >= 0.96 AND rk <= 3 THEN 'elite' WHEN pct >= 0.95 THEN 'strong' WHEN pct >= 0.80 THEN 'watch' ELSE 'longshot' END AS confidence_tier FROM sl""",
)
def tier_policy(spark: SparkSession, sf: str) -> DataFrame:
    out = E.apply_policy(slated(spark, sf), probability="score", probability_floor=0.96, top_k=3)
    return out.select("event_id", "confidence_tier")


FLOORS = (None, 0.94, 0.95, 0.96, 0.97, 0.975)
POLICY_LIST = ", ".join(f"({'NULL' if k is None else k}, {'NULL' if f is None else f})" for k in (None, 3, 2, 1) for f in FLOORS)


@query(
    "policy_search",
    f"""WITH {SCORED_SQL}, {SLATE_SQL}, po AS (SELECT CAST(k AS INTEGER) AS k, CAST(f AS DOUBLE) AS f FROM (VALUES {POLICY_LIST}) AS t(k, f)),
    a AS (SELECT k, f, count(event_id) AS n, CAST(coalesce(sum(label), 0) AS BIGINT) AS h FROM po LEFT JOIN sl ON pct >= 0.99 AND (f IS NULL OR score >= f) AND (k IS NULL OR rk <= k) GROUP BY k, f),
    b AS (SELECT *, coalesce(CAST(h AS DOUBLE) / nullif(n, 0), 0) AS p FROM a), z AS (SELECT n AS bn, p AS bp FROM b WHERE k IS NULL AND f IS NULL),
    c AS (SELECT *, CASE WHEN bp > 0 THEN p / bp - 1 ELSE 0 END AS lift FROM b, z),
    d AS (SELECT *, n > 0 AND p > bp + 1e-12 AND (n >= greatest(ceil(bn * 0.75), 1) OR lift >= 0.15) AS el FROM c)
    SELECT k AS elite_top_k, f AS elite_probability_floor, n AS sample_size, h AS hits, round(p, 6) AS precision, round(lift, 6) AS precision_lift,
      row_number() OVER (ORDER BY el DESC, CASE WHEN el THEN p WHEN k IS NULL AND f IS NULL THEN 1 ELSE 0 END DESC, n DESC, coalesce(f, -1), coalesce(k, 999)) = 1 AS selected FROM d""",
)
def policy_search(spark: SparkSession, sf: str) -> DataFrame:
    return round_doubles(E.policy_search(slated(spark, sf), probability="score", label="label", floors=FLOORS))


@query(
    "baseline_feature",
    f"""WITH {SCORED_SQL}, {CUTOFF_SQL}, tr AS (SELECT sc.* FROM sc, cut WHERE slate < cutoff), te AS (SELECT sc.* FROM sc, cut WHERE slate >= cutoff),
    {sweep_sql('SELECT DISTINCT tied AS t FROM tr', 'tied', 'tr')}, {select_sql('f0_5', 0.1, 0.14, 0.002)}, ct AS (SELECT threshold AS t FROM ch),
    cnt2 AS (SELECT t, CAST(sum(CASE WHEN tied >= t AND label = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS tp, CAST(sum(CASE WHEN tied >= t AND label = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
      CAST(sum(CASE WHEN tied < t AND label = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS tn, CAST(sum(CASE WHEN tied < t AND label = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS fn FROM te, ct GROUP BY t),
    pr2 AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM cnt2),
    sw2 AS (SELECT t AS threshold, tp, fp, tn, fn, {RATES_SQL} FROM pr2) SELECT {SWEEP_OUT} FROM sw2""",
)
def baseline_feature(spark: SparkSession, sf: str) -> DataFrame:
    parts = E.chronological_split(scored(spark, sf), date="slate")
    out = E.baseline_feature(
        parts.where("part = 'train'"), parts.where("part = 'test'"), feature="tied", label="label", min_recall=0.1, max_rate=0.14, tolerance=0.002
    )
    return round_doubles(out)


@query(
    "usability_gate",
    f"""WITH {SCORED_SQL}, {sweep_sql(GRID, 'tied')}, r AS (SELECT avg(CAST(label AS DOUBLE)) AS base FROM sc), g AS (SELECT *, list_filter([CASE WHEN precision < 0.18 THEN printf('precision %.4f < 0.18', precision) END,
      CASE WHEN positive_rate > 1.25 * base THEN printf('positive_prediction_rate %.4f > %.4f', positive_rate, 1.25 * base) END, CASE WHEN recall < 0.10 THEN printf('recall %.4f < 0.10', recall) END], lambda x: x IS NOT NULL) AS f FROM sw, r)
    SELECT round(threshold, 6) AS threshold, len(f) = 0 AS passes, CASE WHEN len(f) = 0 THEN 'passes all operational usability checks' ELSE array_to_string(f, '; ') END AS reason, round(positive_rate / base, 6) AS rate_ratio FROM g""",
)
def usability_gate(spark: SparkSession, sf: str) -> DataFrame:
    rows = scored(spark, sf)
    sweep = E.threshold_sweep(rows, score="tied", label="label").withColumn("__base", rows.agg(F.avg(F.col("label").cast("double"))).scalar())
    return round_doubles(E.usability(sweep, base_rate=F.col("__base")).select("threshold", "passes", "reason", "rate_ratio"))


CANDIDATES = {"value": "score", "tied value": "tied", "inverse": "1 - score", "flat": "score / 10 + 0.15"}
STACKED_SQL = f"""sc AS (SELECT slate, candidate, s AS score, label FROM ({" UNION ALL ".join(f"SELECT slate, '{n}' AS candidate, {c} AS s, label FROM sc0" for n, c in CANDIDATES.items())}))"""


@query(
    "rank_candidates",
    f"""WITH {SCORED_SQL.replace("sc AS", "sc0 AS", 1)}, {STACKED_SQL}, {metrics_sql('candidate', 'score')}, q AS (SELECT *, CAST(CASE candidate WHEN 'value' THEN 0 WHEN 'tied value' THEN 1 WHEN 'inverse' THEN 2 ELSE 3 END AS INTEGER) AS priority,
      CAST(CASE candidate WHEN 'value' THEN 6 WHEN 'tied value' THEN 5 WHEN 'inverse' THEN 4 ELSE 6 END AS INTEGER) AS windows_passed FROM me), cnt AS (SELECT candidate, coalesce(sum(label) FILTER (WHERE score >= 0.5), 0) AS tp, count(*) FILTER (WHERE score >= 0.5) AS pp, sum(label) AS pos, count(*) AS n FROM sc GROUP BY 1),
    ra AS (SELECT candidate, CASE WHEN pp > 0 THEN CAST(tp AS DOUBLE) / pp ELSE 0 END AS precision, CAST(tp AS DOUBLE) / pos AS recall, CAST(pp AS DOUBLE) / n AS rate, CAST(pos AS DOUBLE) / n AS share FROM cnt),
    b AS (SELECT pr_auc AS base, precision AS base_precision FROM me JOIN ra USING (candidate) WHERE candidate = 'tied value')
    SELECT candidate, round(pr_auc, 6) AS pr_auc, round(log_loss, 6) AS log_loss, round(brier_score, 6) AS brier_score, CAST(row_number() OVER (ORDER BY round(pr_auc, 9) DESC, round(log_loss, 9), brier_score, priority) AS INTEGER) AS candidate_rank,
      windows_passed >= 5 AND round(pr_auc, 9) + 1e-12 >= round(base, 9) AND precision > base_precision + 1e-12 AND precision >= 0.18 AND rate <= 1.25 * share AND recall >= 0.10 AS promoted FROM q JOIN ra USING (candidate), b""",
)
def rank_candidates(spark: SparkSession, sf: str) -> DataFrame:
    rows = scored(spark, sf)
    stacked = rows.select("label", F.inline(F.array(*[F.struct(F.lit(n).alias("candidate"), F.expr(c).alias("score")) for n, c in CANDIDATES.items()])))
    metrics = E.probability_metrics(stacked, score="score", label="label", keys=["candidate"])
    metrics = metrics.withColumns(
        {
            "pr_auc": F.round("pr_auc", 9),
            "log_loss": F.round("log_loss", 9),
            "priority": F.when(F.col("candidate") == "value", 0).when(F.col("candidate") == "tied value", 1).when(F.col("candidate") == "inverse", 2).otherwise(3),
            "windows_passed": F.when(F.col("candidate") == "tied value", 5).when(F.col("candidate") == "inverse", 4).otherwise(6),
        }
    )
    above, hit = F.col("score") >= 0.5, F.col("label") == 1
    cells = {"tp": above & hit, "fp": above & ~hit, "tn": ~above & ~hit, "fn": ~above & hit}
    counted = stacked.groupBy("candidate").agg(
        *[F.sum(S.flag(c)).alias(n) for n, c in cells.items()], F.avg(F.col("label").cast("double")).alias("share")
    )
    gated = E.usability(E.confusion_rates(counted), base_rate=F.col("share")).select("candidate", "precision", "passes")
    metrics = metrics.join(gated, "candidate")
    baseline = metrics.where("candidate = 'tied value'")
    ranked = E.rank_candidates(metrics, score="pr_auc", log_loss="log_loss", brier="brier_score", priority="priority")
    out = E.promotion(
        ranked, score="pr_auc", precision="precision", usable="passes", passes="windows_passed",
        baseline_score=baseline.select("pr_auc").scalar(), baseline_precision=baseline.select("precision").scalar(),
    )
    return round_doubles(out.select("candidate", "pr_auc", "log_loss", "brier_score", "candidate_rank", "promoted"))


@query(
    "ranked_output",
    f"""WITH {SCORED_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, event_id) AS rank, row_number() OVER (ORDER BY score, event_id) AS up, count(*) OVER () AS n FROM sc),
    f AS (SELECT *, row_number() OVER (PARTITION BY user_id, slate ORDER BY rank) AS k FROM r)
    SELECT event_id, rank, round(CAST(up AS DOUBLE) / n, 6) AS percentile, round(floor(CAST(up * 2000 + n AS DOUBLE) / (n * 2)) / 10, 6) AS predicted_score,
      CASE WHEN CAST(up AS DOUBLE) / n >= 0.99 THEN 'A' WHEN CAST(up AS DOUBLE) / n >= 0.95 THEN 'B' WHEN CAST(up AS DOUBLE) / n >= 0.80 THEN 'C' ELSE 'D' END AS confidence_tier FROM f WHERE k = 1""",
)
def ranked_output(spark: SparkSession, sf: str) -> DataFrame:
    out = E.ranked_output(scored(spark, sf), probability="score", tie="event_id", keys=["user_id", "slate"])
    return round_doubles(out.select("event_id", "rank", "percentile", "predicted_score", "confidence_tier"))


# ---------------------------------------------------------------- reasons

RULES = {
    "hr_per_pa_last_7d": N.ReasonRule("batter", 1.0, "Homers in %s of recent appearances, a {strength} signal."),
    "hard_hit_rate_last_7d": N.ReasonRule("batter", 0.8, "Hits %s of recent balls hard."),
    "pitcher_load": N.ReasonRule("pitcher", 1.2, "The mark of {opponent} is %s.", percent=False),
    "platoon_advantage": N.ReasonRule("context", 0.5, "Has the platoon advantage.", binary=True),
}


def reason_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Batter-games with four features, keyed by a text id."""
    bg = T.batter_counts(spark, sf)
    bg = H.attach_trailing(
        bg, keys=["batter_id"], date="game_date", days=[7], sums={"hr": "hr_count", "pa": "pa_count", "hard": "hard_hit_bbe_count", "bbe": "bbe_count"}
    )
    return bg.select(
        F.concat_ws(":", "batter_id", "game_pk").alias("row_id"),
        F.col("game_date"),
        F.when(F.col("opponent") % 2 == 0, F.concat(F.lit("Team "), F.col("opponent").cast("string"))).alias("opponent_name"),
        F.round(S.safe_rate("hr_last_7d", "pa_last_7d"), 9).alias("hr_per_pa_last_7d"),
        F.round(S.safe_rate("hard_last_7d", "bbe_last_7d"), 9).alias("hard_hit_rate_last_7d"),
        ((F.col("game_pk") * 7 + F.col("batter_id")) % 101).cast("double").alias("pitcher_load"),
        S.platoon_advantage("bat_side", "pitcher_hand").alias("platoon_advantage"),
    )


def frame_rate(num: str, den: str) -> str:
    return f"round(CAST(sum({num}) OVER {W.days(7)} AS DOUBLE) / nullif(CAST(sum({den}) OVER {W.days(7)} AS DOUBLE), 0), 9)"


@query(
    "top_reasons",
    f"""WITH {BG_SQL}, fr AS (SELECT batter_id || ':' || game_pk AS row_id, game_date, CASE WHEN opponent % 2 = 0 THEN 'Team ' || opponent ELSE '{N.UNNAMED}' END AS opp, {frame_rate("hr_count", "pa_count")} AS f0, {frame_rate("hard_hit_bbe_count", "bbe_count")} AS f1,
      CAST((game_pk * 7 + batter_id) % 101 AS DOUBLE) AS f2, CASE WHEN bat_side <> pitcher_hand THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS f3 FROM bg),
    lg AS (SELECT row_id, game_date, opp, 0 AS f, f0 AS v FROM fr UNION ALL SELECT row_id, game_date, opp, 1, f1 FROM fr UNION ALL SELECT row_id, game_date, opp, 2, f2 FROM fr UNION ALL SELECT row_id, game_date, opp, 3, f3 FROM fr),
    rf AS (SELECT f, v FROM lg WHERE v IS NOT NULL AND game_date < (SELECT max(game_date) - 9 FROM fr)), cd AS (SELECT row_id, opp, f, v FROM lg WHERE v IS NOT NULL AND game_date >= (SELECT max(game_date) - 9 FROM fr)),
    qt AS (SELECT f, quantile_cont(v, 0.6) AS q60, quantile_cont(v, 0.75) AS q75, quantile_cont(v, 0.85) AS q85, quantile_cont(v, 0.9) AS q90, count(*) AS n FROM rf GROUP BY f),
    le AS (SELECT c.f, c.v, count(r.v) AS k FROM (SELECT DISTINCT f, v FROM cd) c LEFT JOIN rf r ON r.f = c.f AND r.v <= c.v GROUP BY c.f, c.v),
    j AS (SELECT cd.row_id, cd.f, CASE cd.f WHEN 2 THEN 'pitcher' WHEN 3 THEN 'context' ELSE 'batter' END AS bucket, CASE WHEN cd.f = 3 THEN CAST(1 AS DOUBLE) ELSE CAST(k AS DOUBLE) / n END AS p,
      CASE cd.f WHEN 0 THEN CAST(1.0 AS DOUBLE) WHEN 1 THEN CAST(0.8 AS DOUBLE) WHEN 2 THEN CAST(1.2 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS w,
      CASE cd.f WHEN 0 THEN printf('Homers in %.1f%% of recent appearances, a %s signal.', cd.v * 100, CASE WHEN CAST(k AS DOUBLE) / n >= 0.9 THEN 'top-decile' WHEN CAST(k AS DOUBLE) / n >= 0.75 THEN 'top-quartile' ELSE 'above-baseline' END) WHEN 1 THEN printf('Hits %.1f%% of recent balls hard.', cd.v * 100) WHEN 2 THEN printf('The mark of %s is %.1f.', opp, cd.v) ELSE 'Has the platoon advantage.' END AS txt,
      CASE WHEN (cd.f = 3 AND cd.v >= 1) OR cd.v >= q90 THEN 2 WHEN cd.v >= CASE WHEN cd.f = 3 THEN q85 ELSE q75 END THEN 1 WHEN cd.f <> 3 AND cd.v >= q60 THEN CAST(0.5 AS DOUBLE) END AS lv
      FROM cd JOIN qt ON qt.f = cd.f JOIN le ON le.f = cd.f AND le.v = cd.v),
    sc AS (SELECT *, coalesce(lv, 0) + w + p + CASE bucket WHEN 'batter' THEN 3.0 WHEN 'pitcher' THEN 2.5 ELSE 1.0 END AS s, max(CASE WHEN lv IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY row_id) AS anysig FROM j),
    pl AS (SELECT * FROM sc WHERE lv IS NOT NULL OR anysig = 0),
    bb AS (SELECT *, row_number() OVER (PARTITION BY row_id, bucket ORDER BY s DESC, f) AS b FROM pl),
    od AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY CASE WHEN b = 1 THEN 0 ELSE 1 END, CASE WHEN b = 1 THEN CASE bucket WHEN 'batter' THEN 0 WHEN 'pitcher' THEN 1 ELSE 2 END END, s DESC, f) AS r FROM bb)
    SELECT c.row_id, coalesce(max(CASE WHEN r = 1 THEN txt END), '{N.FALLBACK}') AS top_reason_1, coalesce(max(CASE WHEN r = 2 THEN txt END), '') AS top_reason_2, coalesce(max(CASE WHEN r = 3 THEN txt END), '') AS top_reason_3
    FROM (SELECT DISTINCT row_id FROM fr WHERE game_date >= (SELECT max(game_date) - 9 FROM fr)) c LEFT JOIN od ON od.row_id = c.row_id GROUP BY c.row_id""",
)
def top_reasons(spark: SparkSession, sf: str) -> DataFrame:
    rows = reason_rows(spark, sf)
    cut = T.day_back(rows, 9)
    return N.top_reasons(rows.where(F.col("game_date") >= cut), rows.where(F.col("game_date") < cut), key="row_id", rules=RULES, opponent="opponent_name")
