"""Queries of the model operators (compared by rows only, as fits have no SQL counterpart)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretrace.functions import scalar as S
from foretrace.functions.profiles import PROFILES
from foretrace.operators import evaluation as E
from foretrace.operators import history as H
from foretrace.operators import model as M
from foretrace.operators import ranking as K
from foretrace.operators import reasons as N
from foretrace.operators import rollup as R
from foretrace.plans import tables as T
from foretrace.plans import windows as W
from foretrace.plans.registry import query
from foretrace.session import cut_lineage
from foretrace.sources import writers

PROFILE = "live_usable_candidate_v1"
SETTINGS = {"C": 1.0, "max_iter": 25}


def opponent_features(spark: SparkSession, sf: str) -> DataFrame:
    """Per game and batting team the primary opposing pitcher's trailing block and to-date rates by the batter's side."""
    pg = T.pitcher_games(spark, sf)
    measures = [f"{m}_{s}" for m in R.HANDED for s in ("rhb", "lhb")]
    blocks = H.pitcher_trailing_block(pg, entity="pitcher_id", date="game_date", order=["game_pk", "team"], totals={f"__{m}": m for m in measures})
    rates = {f"{n}_{s}": S.safe_rate(f"__{a}_{s}", f"__{b}_{s}") for n, (a, b) in W.PITCHER_RATES.items() for s in ("rhb", "lhb")}
    features = blocks.select("game_pk", "team", F.col("pitcher_id").alias("opp_pitcher_id"), *W.OPPONENT, *[c.alias(n) for n, c in rates.items()])
    primary = R.primary_opponent(pg).select("game_pk", "team", "opp_pitcher_id")
    return primary.join(features, ["game_pk", "team", "opp_pitcher_id"]).drop("opp_pitcher_id")


def profile_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, tuple[str, ...]]:
    """Batter-games with the features of the profile that the tables give, and the names of these features.

    Windows end the day before; to-date rates and slots follow earlier rows. The pitcher of a game is the one who faced most
    batters in it. ``temperature_f`` is left out: in the given tables it is a mean over events of the day itself.
    """
    bg = K.lineup_rank(
        W.confirmed(spark, sf),
        keys=["game_pk", "team"],
        expected=F.round("expected_pa_today", 9),
        score=F.round("lineup_confirmation_score", 9),
        slot=F.round("batting_order_slot", 9),
        entity="batter_id",
    )
    totals = {"batter_pa_total_to_date": "pa_count", **H.split_sums("pitcher_hand", W.PITCHER_HANDS, W.BATTER_RATES)}
    bg = H.batter_trailing_block(cut_lineage(bg), entity="batter_id", date="game_date", order=["game_pk"], totals=totals)
    bg = bg.withColumns(H.split_rates(W.PITCHER_HANDS, W.BATTER_RATES))
    bg = bg.join(opponent_features(spark, sf), ["game_pk", "team"], "left")
    bg = bg.withColumns(
        {f"{n}_pitcher_hand": S.by_hand("pitcher_hand", f"{n}_lhp", f"{n}_rhp") for n in W.BATTER_RATES}
        | {f"{n}_batter_hand": S.by_hand("bat_side", f"{n}_lhb", f"{n}_rhb") for n in W.PITCHER_RATES}
        | {"platoon_advantage": S.platoon_advantage("bat_side", "pitcher_hand")}
    )
    products = {
        "split_matchup_hr": ("batter_hr_per_pa_vs_pitcher_hand", "pitcher_hr_allowed_per_pa_vs_batter_hand"),
        "split_matchup_barrel": ("batter_barrels_per_pa_vs_pitcher_hand", "pitcher_barrels_allowed_per_bbe_vs_batter_hand"),
        "split_matchup_hard_hit": ("batter_hard_hit_rate_vs_pitcher_hand", "pitcher_hard_hit_allowed_rate_vs_batter_hand"),
    }
    bg = bg.withColumns(S.interactions(products))
    features = tuple(c for c in PROFILES[PROFILE] if c in bg.columns)
    row_id = F.concat_ws(":", "batter_id", "game_pk").alias("row_id")
    rows = bg.select(row_id, "batter_id", "game_pk", "game_date", "team", "hit_hr", *[F.col(c).cast("double").alias(c) for c in features])
    return cut_lineage(rows), features


def folded_profile(spark: SparkSession, sf: str) -> tuple[DataFrame, tuple[str, ...]]:
    rows, features = profile_rows(spark, sf)
    return E.expanding_folds(rows, blocks=["game_date", "game_pk"], order=["batter_id"], splits=5), features


def split_table(spark: SparkSession, sf: str) -> tuple[DataFrame, M.ModelSpec]:
    """Rows of the profile with their part, and a plain logistic model of the features that are known in training."""
    rows, features = profile_rows(spark, sf)
    rows = E.chronological_split(rows, date="game_date")
    facts = rows.where("part = 'train'").agg(*[F.count(c).alias(c) for c in features]).first()
    return rows, M.ModelSpec("logistic", tuple(c for c in features if facts[c] > 0), SETTINGS)


def split_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, M.ModelSpec]:
    """Training and test rows of the profile, and the model."""
    rows, spec = split_table(spark, sf)
    return rows.where("part = 'train'"), rows.where("part = 'test'"), spec


@query("fit_logistic")
def fit_logistic(spark: SparkSession, sf: str) -> DataFrame:
    train, test, spec = split_rows(spark, sf)
    scored = M.score(M.fit(train, spec, label="hit_hr"), test, spec)
    return E.probability_metrics(scored, score="probability", label="hit_hr")


@query("fit_gbt")
def fit_gbt(spark: SparkSession, sf: str) -> DataFrame:
    train, test, plain = split_rows(spark, sf)
    spec = M.ModelSpec("gbt", plain.features)
    return E.probability_metrics(M.score(M.fit(train, spec, label="hit_hr"), test, spec), score="probability", label="hit_hr")


@query("param_search")
def param_search(spark: SparkSession, sf: str) -> DataFrame:
    """The whole logistic grid and all random tree settings over the features of the profile."""
    folded, features = folded_profile(spark, sf)
    specs = [*M.logistic_grid(features), *M.random_tree_specs(features)]
    found = M.search(folded, specs, label="hit_hr").withColumn("priority", F.lit(0))
    return E.rank_candidates(found, score="mean_cv_pr_auc", log_loss="mean_cv_log_loss", brier="mean_cv_brier_score", priority="priority")


@query("oof_scores")
def oof_scores(spark: SparkSession, sf: str) -> DataFrame:
    folded, features = folded_profile(spark, sf)
    return M.out_of_fold(cut_lineage(folded), M.ModelSpec("logistic", features, SETTINGS), label="hit_hr", keep=["row_id"])


@query("calibrate")
def calibrate(spark: SparkSession, sf: str) -> DataFrame:
    """Both methods, fitted on folds of the training rows and judged on the held-out rows: metrics, and whether to keep each."""
    train, test, spec = split_rows(spark, sf)
    folded = cut_lineage(E.expanding_folds(train, blocks=["game_date", "game_pk"], order=["batter_id"], splits=5))
    plain = cut_lineage(M.score(M.fit(train, spec, label="hit_hr"), test, spec).select("hit_hr", "probability"))
    out = E.probability_metrics(plain, score="probability", label="hit_hr").select(F.lit("none").alias("method"), "*", F.lit(True).alias("kept"))
    for method in ("sigmoid", "isotonic"):
        scored = cut_lineage(M.calibrate(folded, spec, label="hit_hr", method=method).score(test).select("hit_hr", "probability"))
        kept = F.lit(M.keep_calibration(plain, scored, label="hit_hr")).alias("kept")
        metrics = E.probability_metrics(scored, score="probability", label="hit_hr")
        out = out.unionByName(metrics.select(F.lit(method).alias("method"), "*", kept))
    return out


@query("backward_elim")
def backward_elim(spark: SparkSession, sf: str) -> DataFrame:
    folded, features = folded_profile(spark, sf)
    rows = M.backward_elimination(folded, M.ModelSpec("logistic", features), label="hit_hr")
    table = [(",".join(r["features"]), r["feature_count"], r["oof_precision"], r["oof_recall"], r["oof_positive_rate"], r["oof_pr_auc"]) for r in rows]
    return spark.createDataFrame(table, "features string, feature_count int, oof_precision double, oof_recall double, oof_positive_rate double, oof_pr_auc double")


@query("rolling_eval")
def rolling_eval(spark: SparkSession, sf: str) -> DataFrame:
    rows, features = profile_rows(spark, sf)
    spec = M.ModelSpec("logistic", features)
    return M.rolling_evaluation(rows, spec, label="hit_hr", date="game_date", blocks=["game_date", "game_pk"], order=["batter_id"])


@query("fast_refit")
def fast_refit(spark: SparkSession, sf: str) -> DataFrame:
    rows, spec = split_table(spark, sf)
    train, test = rows.where("part = 'train'"), rows.where("part = 'test'")
    path = writers.scratch_path(spark, "model")
    facts = train.agg(F.max("game_date").alias("d"), F.avg("hit_hr").alias("r"))
    M.save_model(
        M.fit(train, spec, label="hit_hr"), spec, path, spark, trained_through=facts.select("d").scalar(), base_rate=facts.select("r").scalar()
    )
    M.fast_refit(rows, path, label="hit_hr", date="game_date")
    model, spec, row = M.load_model(path, spark)
    scored = M.score(model, test, spec)
    return scored.select("row_id", "probability", F.lit(row["trained_through"]).alias("trained_through"))


@query("score_board")
def score_board(spark: SparkSession, sf: str) -> DataFrame:
    """Score the test rows, tier them, keep the capped best of each slate, and explain them."""
    train, test, spec = split_rows(spark, sf)
    model = M.fit(train, spec, label="hit_hr")
    scored = M.score(model, test, spec)
    ranked = K.slate_percentile(scored, slate="game_date", score="probability", tie="row_id")
    tiered = E.apply_policy(ranked, probability="probability")
    chosen = K.greedy_caps(
        tiered.select("row_id", "game_date", "team", "game_pk", "probability", "confidence_tier", "slate_rank"),
        slate="game_date",
        team="team",
        game="game_pk",
        score="probability",
        tie="row_id",
        team_cap=3,
        game_cap=4,
        limit=25,
    )
    rules = N.rules_for(N.reason_weights(dict(zip(spec.features, model.stages[-1].coefficients.tolist())), spec.features))
    reasons = N.top_reasons(test.join(chosen.select("row_id"), "row_id", "left_semi"), train, key="row_id", rules=rules)
    return chosen.join(reasons, "row_id").select(
        "row_id", "game_date", "board_rank", "slate_rank", "confidence_tier", "probability", "top_reason_1", "top_reason_2", "top_reason_3"
    )
