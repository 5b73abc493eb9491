"""Queries of boards: ranks, tiers, upserts, merges, lineups, settlement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foretrace.functions import scalar as S
from foretrace.functions import text as X
from foretrace.operators import board as B
from foretrace.operators import history as H
from foretrace.operators import joins as J
from foretrace.operators import lineup as L
from foretrace.operators import ranking as K
from foretrace.plans import evaluation  # noqa: F401  (its queries are parts of the dashboard)
from foretrace.plans import records as P
from foretrace.plans import tables as T
from foretrace.plans import windows as W
from foretrace.plans.registry import ORACLES, QUERIES, query
from foretrace.plans.tables import BG_SQL, BOARD_SQL, rounded
from foretrace.plans.windows import round_doubles
from foretrace.sources import writers
from foretrace.sources.readers import table


def stamp(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


SCORE_ORDER = "predicted_hr_score DESC NULLS LAST, predicted_hr_probability DESC NULLS LAST, batter_name, pick_id"

# ---------------------------------------------------------------- filters and summaries


@query(
    "forward_only",
    f"""WITH {BOARD_SQL} SELECT pick_id, round(coalesce(CASE WHEN batter_id % 2 = 1 THEN predicted_hr_score END, predicted_hr_probability * 100), 6) AS score
    FROM board WHERE game_date >= (SELECT max(game_date) - 20 FROM board)""",
)
def forward_only(spark: SparkSession, sf: str) -> DataFrame:
    board = T.board(spark, sf, shared=True).withColumn("score", F.when(F.col("batter_id") % 2 == 1, F.col("predicted_hr_score")))
    out = B.forward_only(board, date="game_date", start=T.day_back(board, 20), score="score", probability="predicted_hr_probability")
    return rounded(out.select("pick_id", "score"), "score")


@query("tier_filter", f"WITH {BOARD_SQL} SELECT pick_id, confidence_tier FROM board WHERE confidence_tier IN ('watch', 'strong', 'elite') AND confidence_tier IN ('strong', 'watch')")
def tier_filter(spark: SparkSession, sf: str) -> DataFrame:
    out = B.select_tiers(T.board(spark, sf), tier="confidence_tier", minimum="watch", tiers=["strong", "watch"])
    return out.select("pick_id", "confidence_tier")


@query(
    "latest_slice",
    f"WITH {BOARD_SQL} SELECT pick_id, game_date FROM board WHERE result_label = 'Pending' AND game_date = (SELECT max(game_date) FROM board WHERE result_label = 'Pending')",
)
def latest_slice(spark: SparkSession, sf: str) -> DataFrame:
    return B.latest_slice(T.board(spark, sf), date="game_date", label="result_label").select("pick_id", "game_date")


@query(
    "tier_summary",
    f"""WITH {BOARD_SQL} SELECT confidence_tier, count(*) AS picks, CAST(coalesce(sum(actual_hit_hr), 0) AS BIGINT) AS homers, round(avg(predicted_hr_probability), 6) AS avg_probability,
      round(CAST(coalesce(sum(actual_hit_hr), 0) AS DOUBLE) / count(*), 6) AS hit_rate FROM board WHERE actual_hit_hr IS NOT NULL GROUP BY confidence_tier""",
)
def tier_summary(spark: SparkSession, sf: str) -> DataFrame:
    settled = T.board(spark, sf).where("actual_hit_hr is not null")
    out = B.tier_summary(settled, tier="confidence_tier", outcome="actual_hit_hr", probability="predicted_hr_probability")
    return out.withColumns({c: S.json_safe(c) for c in ("avg_probability", "hit_rate")})


@query(
    "tier_eval",
    f"""WITH {BOARD_SQL}, b AS (SELECT * FROM board WHERE actual_hit_hr IS NOT NULL)
    SELECT t AS confidence_tier, count(b.pick_id) AS sample_size, CAST(coalesce(sum(actual_hit_hr), 0) AS BIGINT) AS hr_count,
      round(coalesce(CAST(sum(actual_hit_hr) AS DOUBLE) / nullif(count(b.pick_id), 0), 0), 6) AS precision,
      CAST(count(b.pick_id) - coalesce(sum(actual_hit_hr), 0) AS BIGINT) AS false_positives
    FROM (SELECT unnest(['elite', 'strong', 'watch', 'longshot']) AS t) LEFT JOIN b ON b.confidence_tier = t GROUP BY t""",
)
def tier_eval(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.board(spark, sf).where("actual_hit_hr is not null")
    return rounded(B.tier_evaluation(rows, tier="confidence_tier", outcome="actual_hit_hr"), "precision")


@query(
    "leaderboard",
    f"""WITH {BOARD_SQL} SELECT batter_name, team, count(*) AS picks, CAST(coalesce(sum(actual_hit_hr), 0) AS BIGINT) AS homers,
      round(CAST(coalesce(sum(actual_hit_hr), 0) AS DOUBLE) / count(*), 6) AS hit_rate FROM board WHERE actual_hit_hr IS NOT NULL GROUP BY batter_name, team HAVING count(*) >= 30""",
)
def leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    settled = T.board(spark, sf).where("actual_hit_hr is not null")
    return rounded(B.leaderboard(settled, by=["batter_name", "team"], outcome="actual_hit_hr", minimum=30), "hit_rate")


@query(
    "overview_kpis",
    f"""WITH {BOARD_SQL} SELECT CAST(sum(CASE WHEN game_date = (SELECT max(game_date) FROM board) THEN 1 ELSE 0 END) AS BIGINT) AS latest_slate_size, count(DISTINCT game_date) AS tracked_dates,
      count(*) AS tracked_picks, count(actual_hit_hr) AS settled_picks, CAST(sum(actual_hit_hr) AS BIGINT) AS tracked_homers,
      round(CAST(sum(actual_hit_hr) AS DOUBLE) / count(actual_hit_hr), 6) AS tracked_hit_rate, count(*) - count(actual_hit_hr) AS open_picks FROM board""",
)
def overview_kpis(spark: SparkSession, sf: str) -> DataFrame:
    board = T.board(spark, sf)
    latest = board.agg(F.max("game_date")).scalar()
    return rounded(B.overview(board, date="game_date", outcome="actual_hit_hr", latest=latest), "tracked_hit_rate")


@query("date_options", f"WITH {BOARD_SQL} SELECT DISTINCT game_date, game_date = (SELECT max(game_date) FROM board WHERE game_date < (SELECT max(game_date) - 10 FROM board)) AS is_default FROM board")
def date_options(spark: SparkSession, sf: str) -> DataFrame:
    board = T.board(spark, sf, shared=True)
    return B.date_options(board, date="game_date", as_of=T.day_back(board, 10))


STATE_SQL = """CASE WHEN regexp_matches(lower(game_status), 'final|game over|completed early|postponed|cancelled') THEN 'final'
  WHEN regexp_matches(lower(game_status), 'in progress|manager challenge|review|warmup|mid|delayed start|delayed|suspended') THEN 'live'
  WHEN first_ts <= (SELECT CAST(max(game_date) - 5 AS TIMESTAMP) + INTERVAL 12 HOUR FROM board) THEN 'live' ELSE 'pregame' END"""


def reference_time(board: DataFrame) -> Column:
    """Noon of the fifth day before the newest one."""
    return T.day_back(board, 5).cast("timestamp_ntz") + F.expr("INTERVAL 12 HOURS")


def board_with_state(spark: SparkSession, sf: str) -> DataFrame:
    board = T.board(spark, sf, shared=True)
    return board.withColumn("game_state", X.game_state("game_status", "first_ts", reference_time(board)))


def game_states(board: DataFrame) -> DataFrame:
    """One row per game of the board, from its first start."""
    games = board.groupBy("game_pk", "game_date").agg(F.max("game_status").alias("game_status"), F.min("first_ts").alias("first_ts"))
    return games.withColumn("game_state", X.game_state("game_status", "first_ts", reference_time(board)))


GAMES_SQL = f"""games AS (SELECT game_pk, game_date, game_status, first_ts, {STATE_SQL} AS game_state
  FROM (SELECT game_pk, game_date, max(game_status) AS game_status, min(first_ts) AS first_ts FROM board GROUP BY 1, 2))"""


@query(
    "slate_state",
    f"""WITH {BOARD_SQL}, {GAMES_SQL} SELECT game_date, min(first_ts) AS first_game, max(first_ts) AS last_game, bool_and(game_state = 'final') AS all_final, bool_or(game_state = 'live') AS has_live,
      CAST(sum(CASE WHEN game_state <> 'pregame' THEN 1 ELSE 0 END) AS BIGINT) AS locked_games, count(*) AS games FROM games GROUP BY game_date""",
)
def slate_state(spark: SparkSession, sf: str) -> DataFrame:
    return B.slate_state(game_states(T.board(spark, sf, shared=True)), date="game_date", state="game_state", start="first_ts")


# ---------------------------------------------------------------- ranks and selection


@query("board_order", f"WITH {BOARD_SQL} SELECT pick_id, game_date, predicted_hr_score, rank, batter_name FROM board")
def board_order(spark: SparkSession, sf: str) -> DataFrame:
    out = K.board_order(T.board(spark, sf), score="predicted_hr_score", rank="rank", name="batter_name", date="game_date")
    return out.select("pick_id", "game_date", "predicted_hr_score", "rank", "batter_name")


@query(
    "topk_per_group",
    f"WITH {BOARD_SQL} SELECT pick_id, game_date, rn AS place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY game_date ORDER BY {SCORE_ORDER}) AS INTEGER) AS rn FROM board) WHERE rn <= 10",
)
def topk_per_group(spark: SparkSession, sf: str) -> DataFrame:
    order = [F.desc_nulls_last("predicted_hr_score"), F.desc_nulls_last("predicted_hr_probability"), F.asc("batter_name"), F.asc("pick_id")]
    return K.topk(T.board(spark, sf), keys=["game_date"], order=order, k=10, name="place").select("pick_id", "game_date", "place")


POOL_KEYS = "recent_starts DESC NULLS LAST, recent_games DESC NULLS LAST, avg_recent_pa DESC NULLS LAST, max_exit_velocity DESC NULLS LAST, last_game_date DESC NULLS LAST"


def pool_sql(source: str, keys: str = "team, batter_id", extra: str = "") -> str:
    return f"""SELECT {keys}, arg_max(max_exit_velocity, struct_pack(a := game_date, b := game_pk)) FILTER (WHERE max_exit_velocity IS NOT NULL) AS max_exit_velocity,
      max(game_date) AS last_game_date, count(DISTINCT game_pk) AS recent_games, CAST(sum(CASE WHEN pa_count >= 3 THEN 1 ELSE 0 END) AS BIGINT) AS recent_starts,
      avg(pa_count) AS avg_recent_pa{extra} FROM {source} GROUP BY {keys}"""


@query(
    "topk_multi_key",
    f"""WITH {BG_SQL}, pool AS ({pool_sql("bg")}) SELECT team, batter_id, CAST(rn AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY {POOL_KEYS}, batter_id) AS rn FROM pool) WHERE rn <= 9""",
)
def topk_multi_key(spark: SparkSession, sf: str) -> DataFrame:
    from foretrace.operators.rollup import pool_summary

    pool = pool_summary(
        T.batter_counts(spark, sf, shared=False), keys=["team", "batter_id"], order=["game_date", "game_pk"], date="game_date", game="game_pk", volume="pa_count", latest=["max_exit_velocity"]
    )
    order = [F.desc_nulls_last(c) for c in ("recent_starts", "recent_games", "avg_recent_pa", "max_exit_velocity", "last_game_date")] + [F.asc("batter_id")]
    return K.topk(pool, keys=["team"], order=order, k=9, name="place").select("team", "batter_id", "place")


CAPS = {"slate": "game_date", "team": "team", "game": "slate_game", "score": "predicted_hr_probability", "tie": "pick_id", "team_cap": 2, "game_cap": 3, "limit": 20}


@query(
    "greedy_caps",
    f"""WITH {BOARD_SQL}, a AS (SELECT *, team // 2 AS slate_game, row_number() OVER (PARTITION BY game_date, team ORDER BY predicted_hr_probability DESC NULLS LAST, pick_id) AS r1 FROM board),
    b AS (SELECT *, row_number() OVER (PARTITION BY game_date, slate_game ORDER BY predicted_hr_probability DESC NULLS LAST, pick_id) AS r2 FROM a WHERE r1 <= 2),
    c AS (SELECT *, row_number() OVER (PARTITION BY game_date ORDER BY predicted_hr_probability DESC NULLS LAST, pick_id) AS r3 FROM b WHERE r2 <= 3)
    SELECT pick_id, game_date, CAST(r3 AS INTEGER) AS board_rank FROM c WHERE r3 <= 20""",
)
def greedy_caps(spark: SparkSession, sf: str) -> DataFrame:
    board = T.board(spark, sf).withColumn("slate_game", F.floor(F.col("team") / 2))
    few = board.select("pick_id", "game_date", "team", "slate_game", "predicted_hr_probability")
    return K.greedy_caps(few, **CAPS).select("pick_id", "game_date", "board_rank")


@query("nested_caps", ORACLES["greedy_caps"])
def nested_caps(spark: SparkSession, sf: str) -> DataFrame:
    board = T.board(spark, sf).withColumn("slate_game", F.floor(F.col("team") / 2))
    return K.nested_caps(board, **CAPS).select("pick_id", "game_date", "board_rank")


@query(
    "greedy_caps_doubleheader",
    f"""WITH RECURSIVE {BOARD_SQL}, o AS (SELECT pick_id, game_date, CAST(team AS BIGINT) AS team, game_pk, row_number() OVER (PARTITION BY game_date ORDER BY predicted_hr_probability DESC NULLS LAST, pick_id) AS i FROM board),
    walk AS (SELECT DISTINCT game_date, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS teams, CAST([] AS BIGINT[]) AS games, CAST(NULL AS VARCHAR) AS taken FROM o
      UNION ALL SELECT game_date, i, CASE WHEN fits THEN list_append(teams, team) ELSE teams END, CASE WHEN fits THEN list_append(games, game_pk) ELSE games END, CASE WHEN fits THEN pick_id END
      FROM (SELECT o.*, w.teams, w.games, len(w.teams) < 20 AND len(list_filter(w.teams, lambda x: x = o.team)) < 2 AND len(list_filter(w.games, lambda x: x = o.game_pk)) < 3 AS fits
        FROM walk w JOIN o ON o.game_date = w.game_date AND o.i = w.i + 1))
    SELECT taken AS pick_id, game_date, CAST(len(teams) AS INTEGER) AS board_rank FROM walk WHERE taken IS NOT NULL""",
)
def greedy_caps_doubleheader(spark: SparkSession, sf: str) -> DataFrame:
    few = T.board(spark, sf).select("pick_id", "game_date", "team", F.col("game_pk").alias("slate_game"), "predicted_hr_probability")
    return K.greedy_caps(few, **CAPS).select("pick_id", "game_date", "board_rank")


@query("rerank", f"WITH {BOARD_SQL} SELECT pick_id, row_number() OVER (PARTITION BY game_date ORDER BY {SCORE_ORDER}) AS rank FROM board")
def rerank(spark: SparkSession, sf: str) -> DataFrame:
    out = K.rerank(
        T.board(spark, sf), slate=["game_date"], score="predicted_hr_score", probability="predicted_hr_probability", name="batter_name", tie="pick_id"
    )
    return out.select("pick_id", "rank")


@query(
    "recent_hits",
    f"WITH {BOARD_SQL} SELECT pick_id, predicted_hr_score FROM board WHERE game_date = (SELECT max(game_date) - 11 FROM board) AND result_label = 'HR' ORDER BY predicted_hr_score DESC NULLS LAST, rank NULLS LAST, pick_id LIMIT 25",
)
def recent_hits(spark: SparkSession, sf: str) -> DataFrame:
    order = [F.desc_nulls_last("predicted_hr_score"), F.asc_nulls_last("rank"), F.asc("pick_id")]
    board = T.board(spark, sf, shared=True)
    return K.recent_hits(board, date="game_date", day=T.day_back(board, 11), label="result_label", order=order).select("pick_id", "predicted_hr_score")


# ---------------------------------------------------------------- upserts and merges

UPSERT = ("pick_id", "game_date", "predicted_hr_score", "result_label", "actual_hit_hr", "batter_name")
# Two versions of the whole board: each has ids that the other has not, and the older half of the incoming one is of
# later dates, so that history has dates that are not published again.
INCOMING_SQL = """h AS (SELECT CASE WHEN batter_id % 5 = 0 THEN pick_id || ':h' ELSE pick_id END AS pick_id, game_date, predicted_hr_score, result_label, actual_hit_hr, batter_name FROM board),
  n0 AS (SELECT CASE WHEN batter_id % 7 = 0 THEN pick_id || ':n' ELSE pick_id END AS pick_id, batter_name, predicted_hr_score + 1 AS predicted_hr_score,
    CASE WHEN game_date < (SELECT max(game_date) - 12 FROM board) THEN game_date + 100 ELSE game_date END AS game_date, CASE WHEN batter_id % 2 = 0 THEN 'Pending' ELSE result_label END AS result_label FROM board),
  n AS (SELECT pick_id, game_date, predicted_hr_score, result_label, CASE WHEN result_label = 'HR' THEN 1 WHEN result_label = 'No HR' THEN 0 END AS actual_hit_hr, batter_name FROM n0)"""


def marked_id(every: int, mark: str) -> Column:
    return F.when(F.col("batter_id") % every == 0, F.concat("pick_id", F.lit(mark))).otherwise(F.col("pick_id"))


def history_rows(board: DataFrame) -> DataFrame:
    return board.withColumn("pick_id", marked_id(5, ":h")).select(*UPSERT)


def incoming_rows(board: DataFrame) -> DataFrame:
    early = F.col("game_date") < T.day_back(board, 12)
    rows = board.withColumns(
        {
            "pick_id": marked_id(7, ":n"),
            "game_date": F.when(early, F.date_add("game_date", 100)).otherwise(F.col("game_date")),
            "result_label": F.when(F.col("batter_id") % 2 == 0, "Pending").otherwise(F.col("result_label")),
            "predicted_hr_score": F.col("predicted_hr_score") + 1,
        }
    )
    return rows.withColumn("actual_hit_hr", X.result_outcome("result_label")).select(*UPSERT)


@query(
    "upsert_history",
    f"""WITH {BOARD_SQL}, {INCOMING_SQL}, k AS (SELECT * FROM h WHERE NOT (result_label = 'Pending' AND game_date IN (SELECT game_date FROM n)))
    SELECT coalesce(n.pick_id, k.pick_id) AS pick_id, coalesce(n.game_date, k.game_date) AS game_date, CASE WHEN n.pick_id IS NULL THEN k.predicted_hr_score ELSE n.predicted_hr_score END AS predicted_hr_score,
      CASE WHEN n.pick_id IS NULL OR (k.result_label IN ('HR', 'No HR', 'Postponed') AND n.result_label = 'Pending') THEN k.result_label ELSE n.result_label END AS result_label,
      CASE WHEN n.pick_id IS NULL OR (k.result_label IN ('HR', 'No HR', 'Postponed') AND n.result_label = 'Pending') THEN k.actual_hit_hr ELSE n.actual_hit_hr END AS actual_hit_hr,
      coalesce(n.batter_name, k.batter_name) AS batter_name FROM k FULL JOIN n ON n.pick_id = k.pick_id""",
)
def upsert_history(spark: SparkSession, sf: str) -> DataFrame:
    board = T.board(spark, sf, shared=True)
    return B.upsert_history(history_rows(board), incoming_rows(board))


@query("upsert_replace", f"WITH {BOARD_SQL}, {INCOMING_SQL} SELECT * FROM h WHERE pick_id NOT IN (SELECT pick_id FROM n) UNION ALL SELECT * FROM n")
def upsert_replace(spark: SparkSession, sf: str) -> DataFrame:
    board = T.board(spark, sf, shared=True)
    return B.upsert_replace(history_rows(board), incoming_rows(board))


@query(
    "recover_pending",
    f"""WITH {BOARD_SQL}, {INCOMING_SQL}, lost AS (SELECT * FROM h WHERE result_label = 'Pending' AND game_date NOT IN (SELECT game_date FROM n))
    SELECT *, 'current' AS side FROM n UNION ALL SELECT *, 'current' FROM lost WHERE pick_id NOT IN (SELECT pick_id FROM n) UNION ALL SELECT *, 'history' FROM h WHERE result_label <> 'Pending'""",
)
def recover_pending(spark: SparkSession, sf: str) -> DataFrame:
    board = T.board(spark, sf, shared=True)
    current, history = B.recover_pending(incoming_rows(board), history_rows(board))
    return current.withColumn("side", F.lit("current")).unionByName(history.withColumn("side", F.lit("history")))


@query(
    "recover_pending_all",
    f"""WITH {BOARD_SQL}, {INCOMING_SQL}, lost AS (SELECT * FROM h WHERE result_label = 'Pending')
    SELECT *, 'current' AS side FROM lost UNION ALL SELECT *, 'current' FROM n WHERE pick_id NOT IN (SELECT pick_id FROM lost) UNION ALL SELECT *, 'history' FROM h WHERE result_label <> 'Pending'""",
)
def recover_pending_all(spark: SparkSession, sf: str) -> DataFrame:
    board = T.board(spark, sf, shared=True)
    current, history = B.recover_pending(incoming_rows(board), history_rows(board), other_dates_only=False)
    return current.withColumn("side", F.lit("current")).unionByName(history.withColumn("side", F.lit("history")))


MERGE_BACK, MAX_PICKS = 5, 60


@query(
    "locked_merge",
    f"""WITH {BOARD_SQL}, {GAMES_SQL}, today AS (SELECT max(game_date) - {MERGE_BACK} AS d FROM board),
    ex AS (SELECT *, 'old ' || batter_id AS top_reason_1 FROM board),
    re AS (SELECT CASE WHEN batter_id % 3 = 0 THEN pick_id || ':n' ELSE pick_id END AS pick_id, game_pk, batter_id, batter_name, predicted_hr_score + 5 AS predicted_hr_score, predicted_hr_probability,
      CASE WHEN batter_id % 4 <> 0 THEN 'new ' || batter_id ELSE '' END AS top_reason_1 FROM board WHERE game_date = (SELECT d FROM today)),
    locked AS (SELECT ex.pick_id, ex.game_pk, ex.batter_name, ex.predicted_hr_score, ex.predicted_hr_probability, coalesce(nullif(re.top_reason_1, ''), ex.top_reason_1) AS top_reason_1
      FROM ex JOIN games USING (game_pk) LEFT JOIN re ON re.game_pk = ex.game_pk AND re.batter_id = ex.batter_id WHERE game_state <> 'pregame' AND ex.game_date = (SELECT d FROM today)),
    al AS (SELECT pick_id, batter_name, predicted_hr_score, predicted_hr_probability, top_reason_1 FROM locked
      UNION ALL SELECT pick_id, batter_name, predicted_hr_score, predicted_hr_probability, top_reason_1 FROM re WHERE game_pk NOT IN (SELECT game_pk FROM locked)),
    ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY {SCORE_ORDER}) AS INTEGER) AS rank FROM al)
    SELECT pick_id, round(predicted_hr_score, 6) AS predicted_hr_score, top_reason_1, rank FROM ranked WHERE rank <= {MAX_PICKS} OR NOT EXISTS (SELECT 1 FROM locked)
    UNION ALL SELECT pick_id, round(predicted_hr_score, 6), top_reason_1, rank FROM ex WHERE game_date <> (SELECT d FROM today)""",
)
def locked_merge(spark: SparkSession, sf: str) -> DataFrame:
    board = board_with_state(spark, sf)
    batter = F.col("batter_id").cast("string")
    existing = board.withColumn("top_reason_1", F.concat(F.lit("old "), batter))
    today = T.day_back(board, MERGE_BACK)
    refreshed = board.where(F.col("game_date") == today).withColumns(
        {
            "pick_id": marked_id(3, ":n"),
            "top_reason_1": F.when(F.col("batter_id") % 4 != 0, F.concat(F.lit("new "), batter)).otherwise(""),
            "predicted_hr_score": F.col("predicted_hr_score") + 5,
        }
    )
    merged = B.locked_merge(existing, refreshed, game_states(board), day=today, max_picks=MAX_PICKS)
    return rounded(merged.select("pick_id", "predicted_hr_score", "top_reason_1", "rank"), "predicted_hr_score")


@query("baseline_once", f"WITH {BOARD_SQL} SELECT pick_id, predicted_hr_score FROM board WHERE game_date = (SELECT max(game_date) - 18 FROM board)")
def baseline_once(spark: SparkSession, sf: str) -> DataFrame:
    root = writers.scratch_path(spark, "baseline")
    board = T.board(spark, sf, shared=True).select("pick_id", "game_date", "predicted_hr_score")
    first = str(board.agg(F.date_sub(F.max("game_date"), 18)).first()[0])
    writers.write_baseline_once(board, root, date="game_date", day=first)
    later = board.withColumn("predicted_hr_score", F.lit(0.0))
    writers.write_baseline_once(later, root, date="game_date", day=first)
    return spark.read.parquet(root).select("pick_id", "predicted_hr_score")


@query("write_board", f"WITH {BOARD_SQL} SELECT pick_id, predicted_hr_score, rank, result_label FROM board")
def write_board(spark: SparkSession, sf: str) -> DataFrame:
    root = writers.scratch_path(spark, "board")
    board = T.board(spark, sf).select("pick_id", "predicted_hr_score", "rank", "result_label")
    writers.write_board(board, root, order=[F.desc_nulls_last("predicted_hr_score"), F.asc("pick_id")])
    version = writers.current_version(spark, root)
    return spark.read.schema(board.schema).json(f"{root}/version={version}")


@query("write_dataset", f"WITH {BG_SQL} SELECT game_date, batter_id, game_pk, hr_count FROM bg")
def write_dataset(spark: SparkSession, sf: str) -> DataFrame:
    path = writers.scratch_path(spark, "dataset")
    writers.write_dataset(T.batter_counts(spark, sf, shared=False).select("game_date", "batter_id", "game_pk", "hr_count"), path)
    return spark.read.parquet(path)


CONTRACT_SQL = """SELECT pick_id, '' AS published_at, game_pk, game_date, '' AS game_datetime, game_status, 'pregame' AS game_state, coalesce(rank, 999) AS rank, batter_id, batter_name, CAST(team AS VARCHAR) AS team,
  '' AS opponent_team, pitcher_id, '' AS pitcher_name, 'projected' AS lineup_source, CAST(NULL AS INTEGER) AS batting_order, CASE WHEN team % 2 = 0 THEN 'Park ' || team ELSE '' END AS ballpark_name, '' AS ballpark_region_abbr,
  CAST(team % 100 AS INTEGER) AS weather_code, '' AS weather_label, CASE WHEN batter_id % 2 = 0 THEN CAST(batter_id % 90 AS DOUBLE) END AS temperature_f, CAST(NULL AS DOUBLE) AS wind_speed_mph, CAST(NULL AS DOUBLE) AS wind_direction_deg,
  CAST(NULL AS DOUBLE) AS field_bearing_deg, confidence_tier, predicted_hr_probability, predicted_hr_score, '' AS top_reason_1, '' AS top_reason_2, '' AS top_reason_3, result_label AS result FROM board"""


@query("canonical_record", f"WITH {BOARD_SQL} {CONTRACT_SQL}")
def canonical_record(spark: SparkSession, sf: str) -> DataFrame:
    texts = T.board(spark, sf).withColumns({c: F.col(c).cast("string") for c in ("game_pk", "rank", "batter_id", "pitcher_id", "game_date", "team")})
    given = texts.withColumns(
        {
            "ballpark_name": F.when(F.col("team") % 2 == 0, F.concat(F.lit("Park "), "team")).otherwise(""),
            "weather_code": (F.col("team").cast("int") % 100).cast("string"),
            "temperature_f": F.when(F.col("batter_id").cast("bigint") % 2 == 0, (F.col("batter_id").cast("bigint") % 90).cast("string")).otherwise("n/a"),
            "result": F.col("result_label"),
        }
    )
    return B.canonical_record(given)


# ---------------------------------------------------------------- lineups, settlement

LINEUP_SQL = f"""aim AS (SELECT max(game_date) - 1 AS d FROM bg), played AS (SELECT team, game_date, game_pk, row_number() OVER (PARTITION BY team ORDER BY game_date DESC, game_pk DESC) AS rn, max(game_date) OVER (PARTITION BY team) AS newest
    FROM (SELECT DISTINCT team, game_date, game_pk FROM bg WHERE game_date < (SELECT d FROM aim))),
  elig AS (SELECT team, game_date, game_pk FROM played WHERE rn <= 3 AND CASE WHEN newest >= (SELECT d FROM aim) - 21 THEN game_date >= (SELECT d FROM aim) - 21 ELSE (SELECT d FROM aim) - newest <= 210 END),
  listed AS (SELECT DISTINCT team, batter_id, CAST(batter_id % 9 + 1 AS INTEGER) AS batting_order FROM bg WHERE team % 2 = 0),
  rows0 AS (SELECT bg.*, l.batting_order AS lineup_order, l.batter_id IS NOT NULL AS in_lineup FROM bg SEMI JOIN elig USING (team, game_date, game_pk)
    LEFT JOIN listed l ON l.team = bg.team AND l.batter_id = bg.batter_id),
  rows1 AS (SELECT * FROM rows0 SEMI JOIN elig USING (team, game_date, game_pk) WHERE team NOT IN (SELECT team FROM listed) OR in_lineup),
  pool AS ({pool_sql("rows1", "team, batter_id", ", max(lineup_order) AS batting_order")}),
  lineups AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY {POOL_KEYS}, 'Bat ' || batter_id, batter_id) AS rn FROM pool),
  lu AS (SELECT team, batter_id, CASE WHEN team % 2 = 0 THEN 'Lineup ' || batter_id ELSE 'Roster ' || batter_id END AS batter_name, batting_order, CAST(rn AS INTEGER) AS projected_lineup_rank,
    CASE WHEN team % 2 = 0 THEN 'confirmed' ELSE 'projected' END AS lineup_source FROM lineups WHERE rn <= 9)"""


def lineups(spark: SparkSession, sf: str) -> DataFrame:
    named = T.batter_counts(spark, sf).withColumn("batter_name", F.concat(F.lit("Bat "), F.col("batter_id").cast("string")))
    members = named.select("team", "batter_id").distinct()
    projected = members.where(F.col("team") % 2 == 0).select(
        "team",
        "batter_id",
        F.concat(F.lit("Lineup "), F.col("batter_id").cast("string")).alias("batter_name"),
        (F.col("batter_id") % 9 + 1).cast("int").alias("batting_order"),
    )
    roster = members.withColumn("batter_name", F.concat(F.lit("Roster "), F.col("batter_id").cast("string")))
    return L.probable_lineups(named, target=T.day_back(named, 1), forms=["max_exit_velocity"], projected=projected, roster=roster)


@query("probable_lineup", f"WITH {BG_SQL}, {LINEUP_SQL} SELECT * FROM lu")
def probable_lineup(spark: SparkSession, sf: str) -> DataFrame:
    return lineups(spark, sf).select("team", "batter_id", "batter_name", "batting_order", "projected_lineup_rank", "lineup_source")


WEATHER_TAIL = P.HOURLY_SQL[len(T.RAW_SQL) :]
CANDIDATE_SQL = f"""{BG_SQL}, {LINEUP_SQL}{WEATHER_TAIL},
  slate AS (SELECT DISTINCT game_date, game_pk, home_team, away_team FROM raw WHERE game_date = (SELECT d FROM aim)),
  sides AS (SELECT game_date, game_pk, home_team, 1 AS is_home, home_team AS team, away_team AS opponent FROM slate UNION ALL SELECT game_date, game_pk, home_team, 0, away_team, home_team FROM slate),
  cand AS (SELECT s.game_date, s.game_pk, s.team, s.opponent, s.is_home, lu.batter_id, lu.projected_lineup_rank, b.m.t AS temperature_f, coalesce(lu.batting_order, lu.projected_lineup_rank) AS slot
    FROM sides s JOIN lu ON lu.team = s.team LEFT JOIN best b ON b.game_date = s.game_date AND b.home_team = s.home_team)"""


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    raw = T.raw_events(spark, sf)
    games = raw.where(F.col("game_date") == T.day_back(raw, 1)).select("game_date", "game_pk", "home_team", "away_team").distinct()
    sides = J.slate_sides(
        games,
        shared=["game_date", "game_pk", "home_team"],
        home={"team": "home_team", "opponent": "away_team"},
        away={"team": "away_team", "opponent": "home_team"},
    )
    return L.candidate_frame(sides, lineups(spark, sf), P.weather(spark, sf).select("game_date", "home_team", "temperature_f"))


@query(
    "candidate_frame",
    f"""WITH {CANDIDATE_SQL} SELECT game_pk, team, opponent, is_home, batter_id, projected_lineup_rank, round(temperature_f, 6) AS temperature_f,
      round(least(greatest(4.65 - 0.08 * (slot - CAST(1 AS DOUBLE)), 3.6), 4.8), 6) AS expected_pa_today FROM cand""",
)
def candidate_frame(spark: SparkSession, sf: str) -> DataFrame:
    out = candidates(spark, sf).select("game_pk", "team", "opponent", "is_home", "batter_id", "projected_lineup_rank", "temperature_f", "expected_pa_today")
    return round_doubles(out)


@query(
    "lineup_panels",
    f"""WITH {CANDIDATE_SQL} SELECT c.game_pk, c.team, c.is_home, array_to_string(list(c.projected_lineup_rank || '. ' || lu.batter_name || CASE WHEN c.projected_lineup_rank <= 2 THEN '*' ELSE '' END
      ORDER BY c.projected_lineup_rank), '; ') AS players FROM cand c JOIN lu ON lu.team = c.team AND lu.batter_id = c.batter_id GROUP BY c.game_pk, c.team, c.is_home""",
)
def lineup_panels(spark: SparkSession, sf: str) -> DataFrame:
    rows = candidates(spark, sf)
    picks = rows.where("projected_lineup_rank <= 2").select("game_pk", "batter_id")
    panels = L.lineup_panels(rows, keys=["game_pk", "team", "is_home"], rank="projected_lineup_rank", shown=["batter_name"], picks=picks)
    star = lambda p: F.when(p["selected_for_pick"], "*").otherwise("")
    shown = F.transform("players", lambda p: F.concat(p["projected_lineup_rank"].cast("string"), F.lit(". "), p["batter_name"], star(p)))
    return panels.select("game_pk", "team", "is_home", F.array_join(shown, "; ").alias("players"))


SETTLE_SQL = f"""{BOARD_SQL}, picks AS (SELECT *, {STATE_SQL} AS game_state FROM board), through AS (SELECT max(game_date) - 8 AS d FROM board),
  outc AS (SELECT game_pk, batter_id, CASE WHEN game_pk % 5 <> 0 THEN hit_hr END AS hit_hr FROM board), box AS (SELECT game_pk, batter_id FROM board WHERE game_pk % 3 = 0 AND hit_hr = 1),
  st AS (SELECT p.pick_id, p.game_date, p.game_pk, CASE WHEN p.game_date > (SELECT d FROM through) AND p.game_state <> 'final' AND p.game_pk % 3 <> 0 THEN p.result_label
      WHEN b.game_pk IS NOT NULL THEN 'HR' WHEN o.hit_hr IS NOT NULL THEN CASE WHEN o.hit_hr > 0 THEN 'HR' ELSE 'No HR' END
      WHEN regexp_matches(lower(p.game_status), 'postponed|cancelled') THEN 'Postponed'
      WHEN p.game_state = 'final' THEN CASE WHEN p.game_pk % 3 = 0 OR p.game_date <= (SELECT d FROM through) THEN 'No HR' ELSE 'Pending' END ELSE 'Pending' END AS result_label
    FROM picks p LEFT JOIN box b ON b.game_pk = p.game_pk AND b.batter_id = p.batter_id LEFT JOIN outc o ON o.game_pk = p.game_pk AND o.batter_id = p.batter_id)"""


def settled(board: DataFrame) -> DataFrame:
    """All picks; the outcome of every fifth game is unknown, and boxscores are read under the ids of every third game."""
    picks = board.select(*T.BOARD_COLUMNS.split(", "), "game_state")
    box_pk = F.when(F.col("game_pk") % 3 == 0, F.col("game_pk")).otherwise(-F.col("game_pk"))
    boxscores = board.withColumn("game_pk", box_pk)
    return B.settle(
        picks,
        outcomes=board.select("game_pk", "batter_id", F.when(F.col("game_pk") % 5 != 0, F.col("hit_hr")).alias("hit_hr")),
        boxscores=boxscores.where("hit_hr = 1").select("game_pk", "batter_id"),
        known_games=boxscores.select("game_pk").distinct(),
        resolved_through=T.day_back(board, 8),
    )


@query("settle", f"WITH {SETTLE_SQL} SELECT pick_id, result_label, CASE WHEN result_label = 'HR' THEN 1 WHEN result_label = 'No HR' THEN 0 END AS actual_hit_hr FROM st")
def settle(spark: SparkSession, sf: str) -> DataFrame:
    return settled(board_with_state(spark, sf)).select("pick_id", "result_label", "actual_hit_hr")


@query(
    "archive_dates",
    f"""WITH {SETTLE_SQL}, {GAMES_SQL} SELECT s.game_date, s.picks, s.term AND coalesce(g.fin, TRUE) AS archived FROM (SELECT game_date, count(*) AS picks, bool_and(result_label <> 'Pending') AS term FROM st GROUP BY 1) s
    LEFT JOIN (SELECT game_date, bool_and(game_state = 'final' OR game_date < (SELECT max(game_date) - 10 FROM board)) AS fin FROM games GROUP BY 1) g USING (game_date)""",
)
def archive_dates(spark: SparkSession, sf: str) -> DataFrame:
    board = board_with_state(spark, sf)
    old = F.col("game_date") < T.day_back(board, 10)
    games = game_states(board).withColumn("game_state", F.when(old, "final").otherwise(F.col("game_state")))
    return B.archive_dates(settled(board), games)


@query(
    "freshness_gate",
    """WITH m AS (SELECT max(CAST(ts AS DATE)) AS now, max(CAST(ts AS DATE)) FILTER (WHERE event_type = 'purchase' AND user_id % 7 = 0) AS data, min(CAST(ts AS DATE)) AS first FROM events),
    l AS (SELECT CAST(date_diff('day', data, now) AS INTEGER) AS d, CAST(date_diff('day', CAST(now - CAST(floor(date_diff('day', first, now) / 3.0) AS INTEGER) AS DATE), now) AS INTEGER) AS t FROM m)
    SELECT d AS dataset_lag_days, t AS metadata_lag_days, coalesce(d > 7, TRUE) AS dataset_stale, coalesce(t > 7, TRUE) AS metadata_stale, coalesce(d <= 7, FALSE) AND coalesce(t <= 7, FALSE) AS passed FROM l""",
)
def freshness_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Against the newest day: the newest day with a home run of some players, and a model trained on two thirds of the days."""
    day = F.col("ts").cast("date")
    hits = (F.col("event_type") == "purchase") & (F.col("user_id") % 7 == 0)
    seen = table(spark, sf, "events").agg(F.max(day).alias("now"), F.max(F.when(hits, day)).alias("data"), F.min(day).alias("first"))
    trained = F.date_sub("now", F.floor(F.datediff("now", "first") / F.lit(3.0)).cast("int"))
    gate = B.freshness_gate(F.col("now"), F.col("data"), trained)
    return seen.select(*[c.alias(n) for n, c in gate.items()])


# ---------------------------------------------------------------- the dashboard

PAYLOAD_SQL = f"""{BOARD_SQL}, settled AS (SELECT * FROM board WHERE actual_hit_hr IS NOT NULL), newest AS (SELECT max(game_date) AS d FROM board),
  tiers AS (SELECT confidence_tier AS t, count(*) AS picks, sum(actual_hit_hr) AS homers FROM settled GROUP BY 1),
  leaders AS (SELECT batter_name || '/' || team AS t, count(*) AS picks, sum(actual_hit_hr) AS homers FROM settled GROUP BY 1 HAVING count(*) >= 2)
  SELECT 'overview' AS section, 'board' AS item, 'tracked_picks' AS name, CAST(count(*) AS DOUBLE) AS value FROM board
  UNION ALL SELECT 'overview', 'board', 'settled_picks', CAST(count(actual_hit_hr) AS DOUBLE) FROM board UNION ALL SELECT 'overview', 'board', 'tracked_homers', CAST(sum(actual_hit_hr) AS DOUBLE) FROM board
  UNION ALL SELECT 'overview', 'board', 'tracked_dates', CAST(count(DISTINCT game_date) AS DOUBLE) FROM board UNION ALL SELECT 'overview', 'board', 'open_picks', CAST(count(*) - count(actual_hit_hr) AS DOUBLE) FROM board
  UNION ALL SELECT 'overview', 'board', 'latest_slate_size', CAST(count(*) AS DOUBLE) FROM board WHERE game_date = (SELECT d FROM newest)
  UNION ALL SELECT 'confidence', t, 'picks', CAST(picks AS DOUBLE) FROM tiers UNION ALL SELECT 'confidence', t, 'homers', CAST(homers AS DOUBLE) FROM tiers
  UNION ALL SELECT 'leader', t, 'picks', CAST(picks AS DOUBLE) FROM leaders UNION ALL SELECT 'leader', t, 'homers', CAST(homers AS DOUBLE) FROM leaders
  UNION ALL SELECT DISTINCT 'date', CAST(game_date AS VARCHAR), 'is_default', CASE WHEN game_date = (SELECT max(game_date) FROM board WHERE game_date < (SELECT d FROM newest)) THEN CAST(1 AS DOUBLE) ELSE 0 END FROM board
  UNION ALL SELECT 'active', pick_id, 'score', round(predicted_hr_score, 6) FROM board WHERE game_date = (SELECT d FROM newest)
  UNION ALL SELECT 'history', pick_id, 'outcome', CAST(actual_hit_hr AS DOUBLE) FROM settled WHERE game_date <> (SELECT d FROM newest)
  UNION ALL SELECT 'season_leader', player_name || '/' || batter_id, n, CAST(v AS DOUBLE) FROM (UNPIVOT ({ORACLES["season_leaders"]}) ON total, volume, games INTO NAME n VALUE v)
  UNION ALL SELECT 'alert', home_team || '/' || source, 'dates', CAST(dates AS DOUBLE) FROM ({ORACLES["fill_alerts"]})
  UNION ALL SELECT 'movement', CAST(m.batter_id AS VARCHAR), CAST(m.game_pk AS VARCHAR), CAST(movement AS DOUBLE) FROM ({ORACLES["rank_movement"]}) m
    SEMI JOIN (SELECT * FROM board WHERE game_date = (SELECT d FROM newest)) b ON b.game_pk = m.game_pk AND b.batter_id = m.batter_id WHERE movement IS NOT NULL
  UNION ALL SELECT 'lineup', game_pk || '/' || team, players, CAST(is_home AS DOUBLE) FROM ({ORACLES["lineup_panels"]})
  UNION ALL SELECT 'policy', coalesce(CAST(elite_top_k AS VARCHAR), 'all') || '/' || coalesce(CAST(CAST(round(100 * elite_probability_floor) AS BIGINT) AS VARCHAR), 'none'), n, CAST(v AS DOUBLE)
    FROM (UNPIVOT (SELECT elite_top_k, elite_probability_floor, sample_size, hits, selected::BIGINT AS selected FROM ({ORACLES["policy_search"]})) ON sample_size, hits, selected INTO NAME n VALUE v)"""


def further_parts(spark: SparkSession, sf: str, *, active_games: DataFrame, part) -> list[DataFrame]:
    """Season leaders, alerts of filled weather, the morning's movement of active picks, lineups and the searched policies."""
    leaders = QUERIES["season_leaders"](spark, sf)
    alerts = QUERIES["fill_alerts"](spark, sf)
    moved = QUERIES["rank_movement"](spark, sf).where("movement is not null").join(active_games, ["game_pk", "batter_id"], "left_semi")
    panels = QUERIES["lineup_panels"](spark, sf)
    policies = QUERIES["policy_search"](spark, sf).withColumn("selected", F.col("selected").cast("int"))
    floor = F.round(100 * F.col("elite_probability_floor")).cast("bigint").cast("string")
    policy = F.concat_ws("/", F.coalesce(F.col("elite_top_k").cast("string"), F.lit("all")), F.coalesce(floor, F.lit("none")))
    shown = lambda df, section, item, name, value: df.select(
        F.lit(section).alias("section"), item.alias("item"), name.alias("name"), F.col(value).cast("double").alias("value")
    )
    text = lambda c: F.col(c).cast("string")
    return [
        part(leaders, "season_leader", F.concat_ws("/", "player_name", text("batter_id")), "total", "volume", "games"),
        part(alerts, "alert", F.concat_ws("/", text("home_team"), "source"), "dates"),
        shown(moved, "movement", text("batter_id"), text("game_pk"), "movement"),
        shown(panels, "lineup", F.concat_ws("/", text("game_pk"), text("team")), F.col("players"), "is_home"),
        part(policies, "policy", policy, "sample_size", "hits", "selected"),
    ]


@query("board_payload", f"WITH {PAYLOAD_SQL}")
def board_payload(spark: SparkSession, sf: str) -> DataFrame:
    """The dashboard's parts as one tall table (section, item, name, value): picks and history stay rows, never one cell."""
    board = T.board(spark, sf, shared=True)
    settled, newest = board.where("actual_hit_hr is not null"), T.day_back(board, 0)

    def part(df: DataFrame, section: str, item: Column, *names: str) -> DataFrame:
        rows = df.select(item.cast("string").alias("item"), *[F.col(n).cast("double").alias(n) for n in names])
        return rows.unpivot(["item"], list(names), "name", "value").select(F.lit(section).alias("section"), "item", "name", "value")

    overview = B.overview(board, date="game_date", outcome="actual_hit_hr", latest=newest)
    shown = ("tracked_picks", "settled_picks", "tracked_homers", "tracked_dates", "open_picks", "latest_slate_size")
    tiers = B.tier_summary(settled, tier="confidence_tier", outcome="actual_hit_hr", probability="predicted_hr_probability")
    leaders = B.leaderboard(settled, by=["batter_name", "team"], outcome="actual_hit_hr", minimum=2)
    dates = B.date_options(board, date="game_date", as_of=newest)
    active = board.where(F.col("game_date") == newest).select("pick_id", F.round("predicted_hr_score", 6).alias("score"))
    history = settled.where(F.col("game_date") != newest).select("pick_id", F.col("actual_hit_hr").alias("outcome"))
    parts = [
        part(overview, "overview", F.lit("board"), *shown),
        part(tiers, "confidence", F.col("confidence_tier"), "picks", "homers"),
        part(leaders, "leader", F.concat_ws("/", "batter_name", F.col("team").cast("string")), "picks", "homers"),
        part(dates.withColumn("is_default", F.col("is_default").cast("int")), "date", F.col("game_date"), "is_default"),
        part(active, "active", F.col("pick_id"), "score"),
        part(history, "history", F.col("pick_id"), "outcome"),
        *further_parts(spark, sf, active_games=board.where(F.col("game_date") == newest).select("game_pk", "batter_id"), part=part),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
