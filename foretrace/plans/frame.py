"""The wide feature frame: every feature of the catalog on batter-games, put together from the queries that produce them.

``BLOCKS`` says which query produces which features and by which columns it is joined. The audits of the whole catalog and
the matchup products read this frame, in Spark and in SQL, where each block is the SQL of its query.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretrace.catalog import FEATURES
from foretrace.functions import scalar as S
from foretrace.operators import history as H
from foretrace.operators import joins as J
from foretrace.operators import quality as Q
from foretrace.operators import rollup as R
from foretrace.plans import records as P
from foretrace.plans import tables as T
from foretrace.plans import windows as W
from foretrace.plans.registry import ORACLES, QUERIES, query
from foretrace.plans.tables import BG_SQL, PG_SQL, RAW_SQL
from foretrace.plans.windows import round_doubles
from foretrace.session import cut_lineage

# ---------------------------------------------------------------- blocks that no other query has

#: The suffix that a bucket has in the names of batter features, and whether it has a contact rate.
BUCKET_SUFFIX = {
    "fastball": ("fastballs", True),
    "breaking_ball": ("breaking", True),
    "offspeed": ("offspeed", True),
    "slider": ("slider", False),
    "changeup": ("changeup", False),
    "curveball": ("curveball", False),
}
BUCKET_FEATURES = {
    f"batter_{rate}_rate_vs_{suffix}": (bucket, f"{rate}_rate")
    for bucket, (suffix, contact) in BUCKET_SUFFIX.items()
    for rate in (("hard_hit", "barrel", "contact") if contact else ("hard_hit", "barrel"))
}


def bucket_columns(rates: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key with the rates of all buckets; a bucket that a key has not met gives nulls."""
    picked = [F.max(F.when(F.col("bucket") == b, F.col(c))).alias(name) for name, (b, c) in BUCKET_FEATURES.items()]
    return rates.groupBy(*keys).agg(*picked)


def bucket_columns_sql(source: str, keys: str) -> str:
    picked = ", ".join(f"max(CASE WHEN bucket = '{b}' THEN {c} END) AS {name}" for name, (b, c) in BUCKET_FEATURES.items())
    return f"SELECT {keys}, {picked} FROM ({source}) GROUP BY {keys}"


@query("bucket_rates", bucket_columns_sql(ORACLES["bucket_prefix"], "batter_id, game_pk"))
def bucket_rates(spark: SparkSession, sf: str) -> DataFrame:
    """To-date rates of a batter against every pitch bucket, side by side."""
    return bucket_columns(W.bucket_prefix(spark, sf), ["batter_id", "game_pk"])


@query(
    "starter_proxy",
    f"""WITH {PG_SQL} SELECT pitcher_id, game_pk, team, CASE WHEN batters_faced >= 12 THEN 'starter_like' ELSE 'bullpen_like' END AS starter_or_bullpen_proxy FROM pg""",
)
def starter_proxy(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.pitcher_games(spark, sf)
    return rows.select("pitcher_id", "game_pk", "team", S.starter_proxy("batters_faced").alias("starter_or_bullpen_proxy"))


# ---------------------------------------------------------------- the frame


@dataclass(frozen=True)
class Block:
    """Features of the catalog, the query that produces them and the columns that its rows are joined by."""
    query: str
    keys: tuple[str, ...]
    features: tuple[str, ...]


BATTER, PITCHER = ("batter_id", "game_pk"), ("pitcher_id", "game_pk", "team")
BLOCKS = (
    Block("prefix_rate", BATTER, ("hr_rate_season_to_date", "batter_k_rate_season_to_date", "batter_bb_rate_season_to_date")),
    Block("count_window", BATTER, tuple(W.LAST_50)),
    Block("day_window_rate", BATTER, ("recent_form_hr_last_7d", "recent_form_barrels_last_14d")),
    Block("lag_fallback", BATTER, ("expected_pa_proxy", "batting_order_slot", "expected_pa_today")),
    Block("days_since", BATTER, ("days_since_last_game",)),
    Block("confirm_score", BATTER, ("lineup_confirmation_score",)),
    Block("lineup_rank", BATTER, ("projected_lineup_rank",)),
    Block("trailing_block", BATTER, tuple(W.TRAILING)),
    Block("split_prefix", BATTER, tuple(W.BATTER_SPLITS)),
    Block("bucket_rates", BATTER, tuple(BUCKET_FEATURES)),
    Block("per9_rate", PITCHER, ("pitcher_hr9_season_to_date", "pitcher_k_rate_season_to_date", "pitcher_bb_rate_season_to_date")),
    Block("count_window_opponent", PITCHER, tuple(W.P_LAST_50)),
    Block("trailing_opponent", PITCHER, tuple(W.OPPONENT)),
    Block("split_prefix_opponent", PITCHER, tuple(W.PITCHER_SPLITS)),
    Block("starter_proxy", PITCHER, ("starter_or_bullpen_proxy",)),
    Block("mix_share", ("pitcher_id", "game_pk"), tuple(f"pitcher_{n}_pct" for n in W.BUCKETS)),
    Block("shrunk_index", ("home_team",), ("park_factor_hr", "park_factor_hr_vs_lhb", "park_factor_hr_vs_rhb")),
)
#: Columns picked by the opponent's hand, as (name for left, name for right): the last has the hand that decides.
BY_HAND = (
    {f"{n}_pitcher_hand": (f"{n}_lhp", f"{n}_rhp", "pitcher_hand") for n in W.BATTER_RATES}
    | {f"{n}_batter_hand": (f"{n}_lhb", f"{n}_rhb", "bat_side") for n in W.PITCHER_RATES}
    | {"park_factor_hr_vs_batter_hand": ("park_factor_hr_vs_lhb", "park_factor_hr_vs_rhb", "bat_side")}
)
SPLIT_PRODUCTS = {
    "split_matchup_hr": ("batter_hr_per_pa_vs_pitcher_hand", "pitcher_hr_allowed_per_pa_vs_batter_hand"),
    "split_matchup_barrel": ("batter_barrels_per_pa_vs_pitcher_hand", "pitcher_barrels_allowed_per_bbe_vs_batter_hand"),
    "split_matchup_hard_hit": ("batter_hard_hit_rate_vs_pitcher_hand", "pitcher_hard_hit_allowed_rate_vs_batter_hand"),
}
PITCH_PRODUCTS = {
    "fastball_matchup_hard_hit": ("pitcher_fastball_pct", "batter_hard_hit_rate_vs_fastballs"),
    "fastball_matchup_barrel": ("pitcher_fastball_pct", "batter_barrel_rate_vs_fastballs"),
    "breaking_matchup_hard_hit": ("pitcher_breaking_ball_pct", "batter_hard_hit_rate_vs_breaking"),
    "breaking_matchup_barrel": ("pitcher_breaking_ball_pct", "batter_barrel_rate_vs_breaking"),
    "offspeed_matchup_hard_hit": ("pitcher_offspeed_pct", "batter_hard_hit_rate_vs_offspeed"),
    "offspeed_matchup_barrel": ("pitcher_offspeed_pct", "batter_barrel_rate_vs_offspeed"),
    "slider_matchup_barrel": ("pitcher_slider_pct", "batter_barrel_rate_vs_slider"),
    "changeup_matchup_barrel": ("pitcher_changeup_pct", "batter_barrel_rate_vs_changeup"),
}
PRODUCTS = SPLIT_PRODUCTS | PITCH_PRODUCTS


def picked_by_hand() -> dict:
    return {name: S.by_hand(hand, left, right) for name, (left, right, hand) in BY_HAND.items()}


def picked_by_hand_sql(names=None) -> str:
    return ", ".join(f"CASE WHEN {h} = 'L' THEN {a} ELSE {b} END AS {n}" for n, (a, b, h) in BY_HAND.items() if names is None or n in names)


def products() -> dict:
    return {n: F.round(c, 5) for n, c in S.interactions(PRODUCTS).items()}


PRODUCTS_SQL = ", ".join(f"round({a} * {b}, 5) AS {n}" for n, (a, b) in PRODUCTS.items())
BASE_SQL = f"""{BG_SQL}, {P.MODE_SQL}, parks AS (SELECT game_pk, min(home_team) AS home_team FROM raw GROUP BY 1),
  base AS (SELECT bg.batter_id, bg.game_pk, bg.game_date, bg.team, bg.bat_side, bg.pitcher_hand, md.pitcher_id, parks.home_team
    FROM bg JOIN md USING (game_pk, batter_id) JOIN parks USING (game_pk))"""


def base_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Batter-games with the pitcher whom the batter faced most often and the team whose park it was."""
    rows = T.batter_counts(spark, sf).select("batter_id", "game_pk", "game_date", "team", "bat_side", "pitcher_hand")
    faced = P.mode_table(spark, sf).select("game_pk", "batter_id", "pitcher_id")
    parks = T.raw_events(spark, sf).groupBy("game_pk").agg(F.min("home_team").alias("home_team"))
    return rows.join(faced, ["game_pk", "batter_id"]).join(parks, "game_pk")


def frame(spark: SparkSession, sf: str, names=None) -> DataFrame:
    """The frame with all features, or the blocks that have any of ``names`` only; each block is joined many to one."""
    with T.kept_rollups():
        out = base_rows(spark, sf)
        for block in BLOCKS:
            if names is None or set(block.features) & set(names):
                made = QUERIES[block.query](spark, sf).select(*block.keys, *block.features)
                out = out.join(made, list(block.keys), "left")
        return out


def frame_sql(names=None) -> str:
    """The CTEs ``base`` and one for each block, and the frame itself as ``fr``."""
    used = [b for b in BLOCKS if names is None or set(b.features) & set(names)]
    parts = ", ".join(f"{b.query}_ AS ({ORACLES[b.query]})" for b in used)
    joins = " ".join(f"LEFT JOIN {b.query}_ USING ({', '.join(b.keys)})" for b in used)
    columns = ", ".join(f"{b.query}_.{c}" for b in used for c in b.features)
    return f"{BASE_SQL}, {parts}, fr AS (SELECT base.*, {columns} FROM base {joins})"


def whole_frame(spark: SparkSession, sf: str) -> DataFrame:
    """All features of the catalog, written once."""
    wide = frame(spark, sf).withColumns(picked_by_hand())
    return cut_lineage(wide.withColumns(products()))


WHOLE_SQL = f"{frame_sql()}, hands AS (SELECT *, {picked_by_hand_sql()} FROM fr), whole AS (SELECT *, {PRODUCTS_SQL} FROM hands)"
_PARTS = {c for pair in PRODUCTS.values() for c in pair} | {c for a, b, _ in BY_HAND.values() for c in (a, b)} - {
    "park_factor_hr_vs_lhb", "park_factor_hr_vs_rhb"
}
_HANDS = [n for n in BY_HAND if not n.startswith("park")]


@query(
    "interactions",
    f"WITH {frame_sql(_PARTS)}, hands AS (SELECT *, {picked_by_hand_sql(_HANDS)} FROM fr) SELECT batter_id, game_pk, {PRODUCTS_SQL} FROM hands",
)
def interactions(spark: SparkSession, sf: str) -> DataFrame:
    """All eleven products of a batter's and a pitcher's rates."""
    picked = {n: c for n, c in picked_by_hand().items() if n in _HANDS}
    return frame(spark, sf, _PARTS).withColumns(picked).select("batter_id", "game_pk", *[c.alias(n) for n, c in products().items()])


# ---------------------------------------------------------------- audits of the whole catalog

#: Features of the profiles that the given tables have no source for.
WITHOUT_SOURCE = ("temperature_f", "humidity_pct", "wind_speed_mph", "wind_direction_deg", "pressure_hpa")
FAMILIES = {name: f.family for name, f in FEATURES.items()} | {name: "context" for name in WITHOUT_SOURCE}


def counts_sql(where: str = "TRUE") -> str:
    """(feature, family, n, k): rows and known values of every feature of ``whole``."""
    packed = ", ".join(f"{{f: '{n}', y: '{FAMILIES[n]}', k: count({n}) FILTER (WHERE {where})}}" for n in FEATURES)
    return f"SELECT n, s.f AS feature, s.y AS family, s.k AS k FROM (SELECT n, unnest(l) AS s FROM (SELECT count(*) AS n, [{packed}] AS l FROM whole))"


def without_source_sql(columns: str) -> str:
    return " UNION ALL ".join(f"SELECT {columns.format(name=name, family=FAMILIES[name])}" for name in WITHOUT_SOURCE)


SHARE = "1 - CAST(k AS DOUBLE) / n"


@query(
    "coverage_audit",
    f"""WITH {WHOLE_SQL} SELECT feature, TRUE AS present, k AS non_null, round({SHARE}, 6) AS null_rate, CASE WHEN k = 0 THEN 'all null' WHEN {SHARE} > 0.35 THEN 'warn' ELSE 'ok' END AS status FROM ({counts_sql()})
    UNION ALL {without_source_sql("'{name}', FALSE, 0, NULL, 'missing'")}""",
)
def coverage_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Every feature of the catalog, and those that have no source here."""
    return round_doubles(Q.coverage(whole_frame(spark, sf), list(FAMILIES)))


LIMIT_SQL = "CASE family " + " ".join(f"WHEN '{f}' THEN {limit}" for f, limit in Q.fv.EXPORT_LIMITS.items()) + f" ELSE {Q.fv.EXPORT_LIMIT_OTHER} END"


@query(
    "export_decision",
    f"""WITH {WHOLE_SQL}, c AS (SELECT *, {SHARE} AS share, {LIMIT_SQL} AS most FROM ({counts_sql()}))
    SELECT feature, family, round(share, 6) AS null_rate, CASE WHEN share >= 1 THEN '100% missing' WHEN share > most THEN 'missing share above family limit' ELSE 'feature passed coverage checks' END AS reason,
      share < 1 AND share <= most AS included FROM c UNION ALL {without_source_sql("'{name}', '{family}', NULL, 'feature not produced', FALSE")}""",
)
def export_decision(spark: SparkSession, sf: str) -> DataFrame:
    return round_doubles(Q.export_decisions(whole_frame(spark, sf), FAMILIES))


EARLY = "game_date < (SELECT max(game_date) - 19 FROM base)"


@query(
    "catalog_report",
    f"""WITH {WHOLE_SQL}, a AS ({counts_sql()}), b AS ({counts_sql(EARLY)})
    SELECT feature, a.family, TRUE AS present, b.k AS before_non_null, a.k AS after_non_null, round(1 - CAST(a.k AS DOUBLE) / a.n, 6) AS null_rate FROM a JOIN b USING (feature)
    UNION ALL {without_source_sql("'{name}', '{family}', FALSE, 0, 0, NULL")}""",
)
def catalog_report(spark: SparkSession, sf: str) -> DataFrame:
    """Known values of every feature before the newest days came in, and after."""
    after = whole_frame(spark, sf)
    before = after.where(F.col("game_date") < T.day_back(after, 19))
    return round_doubles(Q.catalog_report(before, after, FAMILIES))


NEWEST = "game_date = (SELECT max(game_date) FROM base)"


@query(
    "readiness_check",
    f"""WITH {WHOLE_SQL} SELECT feature, 'all null' AS status FROM ({counts_sql(NEWEST)}) WHERE k = 0 UNION ALL {without_source_sql("'{name}', 'missing'")}""",
)
def readiness_check(spark: SparkSession, sf: str) -> DataFrame:
    """Features without any value on the newest day, and those that have no source here."""
    wide = whole_frame(spark, sf)
    return Q.readiness(wide.where(F.col("game_date") == T.day_back(wide, 0)), list(FAMILIES))


# ---------------------------------------------------------------- the frame of the next day

LIVE_BATTER = [*W.TRAILING, *W.BATTER_SPLITS]
LIVE_PITCHER = [*W.OPPONENT, *W.PITCHER_SPLITS]
MIX = [f"pitcher_{n}_pct" for n in W.BUCKETS]
PARK = ["park_factor_hr", "park_factor_hr_vs_lhb", "park_factor_hr_vs_rhb"]


def latest_sql(names) -> str:
    return ", ".join(f"arg_max({c}, struct_pack(a := game_date, b := game_pk)) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in names)


def live_sql(name: str, source: str, entity: str, columns) -> str:
    """CTEs: rows of ``source``, the newest known values, and the candidates with gaps filled from these."""
    filled = ", ".join(f"coalesce(l.{c}, s.{c}) AS {c}" for c in columns)
    return f"""{name}_rows AS ({source}), {name}_known AS (SELECT {entity}, {latest_sql(columns)} FROM {name}_rows WHERE NOT is_candidate GROUP BY {entity}),
  {name} AS (SELECT l.{entity}, {filled} FROM (SELECT * FROM {name}_rows WHERE is_candidate) l LEFT JOIN {name}_known s USING ({entity}))"""


def live_rows(rows: DataFrame, entity: str, columns) -> DataFrame:
    """The candidates of ``rows``, their gaps filled from the entity's newest known values."""
    known = H.latest_non_null(rows.where("not is_candidate"), keys=[entity], order=["game_date", "game_pk"], columns=list(columns))
    return J.snapshot_fill(rows.where("is_candidate"), known, on=[entity], columns=list(columns)).select(entity, *columns)


MIX_AS_OF_SQL = f"""{W.MIX_SQL}, mu AS (SELECT pitcher_id, game_date, day_no, game_pk, total_pitches, {", ".join(W.BUCKETS)}, FALSE AS is_candidate FROM mix UNION ALL
    SELECT DISTINCT pitcher_id, CAST((SELECT d FROM target) AS DATE), date_diff('day', DATE '1970-01-01', CAST((SELECT d FROM target) AS DATE)), CAST(-1 AS BIGINT), 0, {", ".join("0" for _ in W.BUCKETS)}, TRUE FROM mix)"""
MIX_ROWS_SQL = f"""SELECT pitcher_id, game_date, game_pk, is_candidate, {", ".join(f"{W.rate(n, 'total_pitches', W.P30)} AS pitcher_{n}_pct" for n in W.BUCKETS)} FROM mu"""
MEASURES = ("bbe", "hard_hit", "barrel", "contact", "swing")
BUCKET_AS_OF_SQL = f"""{W.BUCKET_SQL[len(T.PA_SQL) :]}, bu AS (SELECT batter_id, game_date, game_pk, bucket, {", ".join(MEASURES)}, FALSE AS is_candidate FROM bk UNION ALL
    SELECT DISTINCT batter_id, CAST((SELECT d FROM target) AS DATE), CAST(-1 AS BIGINT), bucket, {", ".join("0" for _ in MEASURES)}, TRUE FROM bk)"""
BUCKET_ROWS_SQL = f"""SELECT batter_id, game_date, game_pk, is_candidate, bucket, {W.rate("hard_hit", "bbe", W.BPRE)} AS hard_hit_rate,
      {W.rate("barrel", "bbe", W.BPRE)} AS barrel_rate, {W.rate("contact", "swing", W.BPRE)} AS contact_rate FROM bu"""


def as_of_mix(spark: SparkSession, sf: str) -> DataFrame:
    measures = ["total_pitches", *W.BUCKETS]
    counts = cut_lineage(R.mix_counts(T.raw_events(spark, sf), keys=["pitcher_id", "game_date", "game_pk"], code="pitch_type"))
    rows = H.as_of_rows(counts, as_of_day(spark, sf, counts, ["pitcher_id"], measures))
    out = H.attach_trailing(rows, keys=["pitcher_id"], date="game_date", days=[30], sums={m: m for m in measures})
    shares = [S.safe_rate(f"{n}_last_30d", "total_pitches_last_30d").alias(f"pitcher_{n}_pct") for n in W.BUCKETS]
    return round_doubles(out.select("pitcher_id", "game_date", "game_pk", "is_candidate", *shares))


def as_of_day(spark: SparkSession, sf: str, rows: DataFrame, keys: list[str], counts) -> DataFrame:
    """A row without counts of each key on the day after the newest game."""
    target = T.batter_counts(spark, sf).agg(F.date_add(F.max("game_date"), 1)).scalar()
    zeros = [F.lit(0).cast("bigint").alias(c) for c in counts]
    return rows.select(*keys).distinct().select(*keys, F.lit(-1).cast("bigint").alias("game_pk"), target.alias("game_date"), *zeros)


def as_of_buckets(spark: SparkSession, sf: str) -> DataFrame:
    counts = cut_lineage(W.bucket_table(spark, sf))
    rows = H.as_of_rows(counts, as_of_day(spark, sf, counts, ["batter_id", "bucket"], MEASURES))
    rows = H.to_date(rows, keys=["batter_id", "bucket"], date="game_date", order=["game_pk"], sums={f"__{m}": m for m in MEASURES})
    rates = rows.select(
        "batter_id", "game_date", "game_pk", "is_candidate", "bucket",
        S.safe_rate("__hard_hit", "__bbe").alias("hard_hit_rate"),
        S.safe_rate("__barrel", "__bbe").alias("barrel_rate"),
        S.safe_rate("__contact", "__swing").alias("contact_rate"),
    )
    return bucket_columns(round_doubles(rates), ["batter_id", "game_date", "game_pk", "is_candidate"])


PARK_SQL = f"""park_now AS ({ORACLES["shrunk_index"]}), park_then AS (SELECT home_team, arg_max(park_factor_hr, game_date) FILTER (WHERE park_factor_hr IS NOT NULL) AS then_hr FROM ({ORACLES["shrunk_index_as_of"]}) GROUP BY 1),
  park AS (SELECT home_team, coalesce(park_factor_hr, then_hr) AS park_factor_hr, coalesce(park_factor_hr_vs_lhb, then_hr) AS park_factor_hr_vs_lhb, coalesce(park_factor_hr_vs_rhb, then_hr) AS park_factor_hr_vs_rhb
    FROM park_now LEFT JOIN park_then USING (home_team))"""
LIVE_COLUMNS = [*LIVE_BATTER, *BUCKET_FEATURES, *LIVE_PITCHER, *MIX, *PARK]


@query(
    "live_features",
    f"""WITH {W.AS_OF_SQL}{W.PITCHER_AS_OF_SQL}, {MIX_AS_OF_SQL}{BUCKET_AS_OF_SQL},
  {live_sql("lb", W.AS_OF_BATTERS_SQL, "batter_id", LIVE_BATTER)}, {live_sql("lp", W.AS_OF_PITCHERS_SQL, "pitcher_id", LIVE_PITCHER)},
  {live_sql("lm", MIX_ROWS_SQL, "pitcher_id", MIX)}, {live_sql("lk", bucket_columns_sql(BUCKET_ROWS_SQL, "batter_id, game_date, game_pk, is_candidate"), "batter_id", BUCKET_FEATURES)},
  {PARK_SQL}, opp AS (SELECT batter_id, arg_max(pitcher_id, event_id) AS pitcher_id, arg_max(stand, event_id) AS bat_side, arg_max(p_throws, event_id) AS pitcher_hand, arg_max(home_team, event_id) AS home_team FROM raw GROUP BY 1),
  fr AS (SELECT * FROM lb JOIN opp USING (batter_id) LEFT JOIN lk USING (batter_id) LEFT JOIN lp USING (pitcher_id) LEFT JOIN lm USING (pitcher_id) LEFT JOIN park USING (home_team)),
  hands AS (SELECT *, {picked_by_hand_sql()}, CASE WHEN bat_side <> pitcher_hand THEN CAST(1 AS DOUBLE) ELSE 0 END AS platoon_advantage FROM fr)
    SELECT batter_id, pitcher_id, home_team, {", ".join(LIVE_COLUMNS)}, {", ".join(BY_HAND)}, platoon_advantage, {PRODUCTS_SQL} FROM hands""",
)
def live_features(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of the next day, each with the pitcher and in the park of the batter's newest row: windows, handed splits,
    pitch shares and bucket rates run again as of that day, gaps filled from the newest known values of the batter, the
    pitcher and the park, columns picked by the opponent's hand, the platoon flag and all eleven products."""
    with T.kept_rollups():
        batters = live_rows(W.as_of_batters(spark, sf), "batter_id", LIVE_BATTER)
        buckets = live_rows(as_of_buckets(spark, sf), "batter_id", list(BUCKET_FEATURES))
        pitchers = live_rows(W.as_of_pitchers(spark, sf), "pitcher_id", LIVE_PITCHER)
        mix = live_rows(as_of_mix(spark, sf), "pitcher_id", MIX)
        daily = P.shrunk_index_as_of(spark, sf)
        known = H.latest_non_null(daily, keys=["home_team"], order=["game_date"], columns=["park_factor_hr"])
        known = known.select("home_team", *[F.col("park_factor_hr").alias(c) for c in PARK])
        park = J.snapshot_fill(P.shrunk_index(spark, sf), known, on=["home_team"], columns=PARK)
        last = lambda c, name: F.max_by(c, "event_id").alias(name)
        raw = T.raw_events(spark, sf)
        opposed = raw.groupBy("batter_id").agg(
            last("pitcher_id", "pitcher_id"), last("stand", "bat_side"), last("p_throws", "pitcher_hand"), last("home_team", "home_team")
        )
        rows = batters.join(opposed, "batter_id").join(buckets, "batter_id", "left")
        rows = J.attach_dim(J.attach_dim(J.attach_dim(rows, pitchers, on=["pitcher_id"]), mix, on=["pitcher_id"]), park, on=["home_team"])
        rows = rows.withColumns(picked_by_hand())
        platoon = S.platoon_advantage("bat_side", "pitcher_hand").alias("platoon_advantage")
        made = [c.alias(n) for n, c in products().items()]
        return rows.select("batter_id", "pitcher_id", "home_team", *LIVE_COLUMNS, *BY_HAND, platoon, *made)
