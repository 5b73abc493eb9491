"""Queries of sources, projections, text functions, joins and rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foretrace.functions import fixed_values as fv
from foretrace.functions import scalar as S
from foretrace.functions import text as X
from foretrace.functions.profiles import PROFILES
from foretrace.operators import history as H
from foretrace.operators import joins as J
from foretrace.operators import names as N
from foretrace.operators import rollup as R
from foretrace.operators.model import encode_sides
from foretrace.plans import tables as T
from foretrace.plans import windows as W
from foretrace.plans.registry import query
from foretrace.plans.tables import BG_SQL, BOARD_SQL, PA_SQL, PG_SQL, RAW_SQL
from foretrace.plans.windows import in_list, round_doubles
from foretrace.sources import readers, writers
from foretrace.sources.readers import table

# ---------------------------------------------------------------- sources


@query("scan_project", "SELECT event_id, ts, user_id, event_type, value FROM events")
def scan_project(spark: SparkSession, sf: str) -> DataFrame:
    return readers.project_required(table(spark, sf, "events"), ["event_id", "ts", "user_id", "event_type", "value"])


@query(
    "scan_filter_union",
    """SELECT event_id, CAST(ts AS DATE) AS game_date, value FROM events WHERE event_type IN ('purchase', 'view') AND value >= 95""",
)
def scan_filter_union(spark: SparkSession, sf: str) -> DataFrame:
    events = readers.read_chunks(spark, f"{sf}/events.parquet", readers.EVENTS_SCHEMA)
    chunks = [events.where(F.col("event_type") == kind) for kind in ("purchase", "view")]
    both = readers.union_chunks(chunks).where(F.col("value") >= 95)
    return both.select("event_id", F.col("ts").cast("date").alias("game_date"), "value")


@query(
    "date_chunks",
    """WITH b AS (SELECT o_orderpriority, min(CAST(o_orderdate AS DATE)) AS d0, max(CAST(o_orderdate AS DATE)) AS d1 FROM orders GROUP BY 1),
    c AS (SELECT CAST(unnest(generate_series(CAST(d0 AS TIMESTAMP), CAST(d1 AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS chunk_start, d1 FROM b)
    SELECT chunk_start, least(CAST(chunk_start + INTERVAL 6 DAY AS DATE), d1) AS chunk_end FROM c""",
)
def date_chunks(spark: SparkSession, sf: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    bounds = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.min(day).alias("first"), F.max(day).alias("last"))
    return readers.date_chunks(bounds, start="first", end="last", days=7)


@query("json_records", "SELECT event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_records(spark: SparkSession, sf: str) -> DataFrame:
    path = writers.scratch_path(spark, "records")
    events = table(spark, sf, "events").select(
        "event_id", "event_type", "value", F.get_json_object("props", "$.k").cast("bigint").alias("k")
    )
    events.write.json(path)
    return readers.read_records(spark, path, events.schema)


LINEUPS_SQL = f"""{RAW_SQL}, sides AS (SELECT game_date, game_pk, home_team, away_team, team_no, max(pitcher_id) AS pitcher_id,
    list(DISTINCT batter_id ORDER BY batter_id) AS ids, max(value) > 250 AS confirmed
  FROM raw GROUP BY game_date, game_pk, home_team, away_team, team_no)"""


def landed_schedule(spark: SparkSession, sf: str) -> str:
    """Write the games of the events as nested schedule days, as a feed would land them; returns the folder."""
    raw = T.raw_events(spark, sf)
    members = raw.select("game_date", "game_pk", "home_team", "away_team", "team_no", "batter_id", "player_name").distinct()
    lineups = members.groupBy("game_date", "game_pk", "home_team", "away_team", "team_no").agg(
        F.array_sort(F.collect_list(F.struct("batter_id", F.col("player_name").alias("batter_name")))).alias("lineup")
    )
    facts = raw.groupBy("game_pk").agg(F.max("pitcher_id").alias("pitcher_id"), (F.max("value") > 250).alias("confirmed"))
    sides = lineups.join(facts, "game_pk")
    bats_home = F.col("team_no") == F.col("home_team")

    def side(team: str, here) -> F.Column:
        return F.struct(
            F.col(team).cast("string").alias("team"),
            F.when(~here, F.col("pitcher_id")).alias("pitcher_id"),
            F.when(here, F.col("lineup")).alias("lineup"),
            (F.col("confirmed") & here).alias("confirmed"),
        )

    game = F.struct("game_pk", F.lit("Final").alias("status"), side("home_team", bats_home).alias("home"), side("away_team", ~bats_home).alias("away"))
    path = writers.scratch_path(spark, "schedule")
    # A landed record holds a block of a day's games, which stays short however many teams there are.
    block = F.floor(F.col("team_no") / 16).alias("block")
    landed = sides.groupBy(F.col("game_date").alias("date"), block).agg(F.collect_list(game).alias("games"))
    landed.drop("block").write.json(path)
    return path


@query(
    "schedule_flatten",
    f"""WITH {LINEUPS_SQL} SELECT game_pk, game_date, CAST(home_team AS VARCHAR) AS home_team, CAST(away_team AS VARCHAR) AS away_team,
      CASE WHEN team_no = home_team THEN len(ids) ELSE 0 END AS home_hitters,
      CASE WHEN team_no = home_team THEN 0 ELSE len(ids) END AS away_hitters,
      CASE WHEN team_no = home_team THEN pitcher_id END AS away_pitcher_id,
      CASE WHEN team_no = home_team AND confirmed THEN 'confirmed' ELSE 'projected' END AS home_lineup_source,
      array_to_string(list_transform(ids, lambda x, i: i || '=' || x), ',') AS slots FROM sides""",
)
def schedule_flatten(spark: SparkSession, sf: str) -> DataFrame:
    landed = spark.read.schema(readers.SCHEDULE_SCHEMA).json(landed_schedule(spark, sf))
    games = readers.flatten_schedule(landed)
    hitters = F.concat("home_lineup", "away_lineup")
    slots = F.transform(hitters, lambda h: F.concat(h["batting_order"].cast("string"), F.lit("="), h["batter_id"].cast("string")))
    return games.select(
        "game_pk",
        "game_date",
        "home_team",
        "away_team",
        F.size("home_lineup").cast("bigint").alias("home_hitters"),
        F.size("away_lineup").cast("bigint").alias("away_hitters"),
        "away_pitcher_id",
        "home_lineup_source",
        F.array_join(slots, ",").alias("slots"),
    )


@query("boxscore_set", f"WITH {RAW_SQL} SELECT DISTINCT game_pk, batter_id FROM raw WHERE events = 'purchase'")
def boxscore_set(spark: SparkSession, sf: str) -> DataFrame:
    per_player = T.raw_events(spark, sf).groupBy("game_pk", "batter_id").agg(
        F.sum(S.flag(F.col("events") == "purchase")).cast("int").alias("homeRuns")
    )
    entry = F.struct(
        F.concat(F.lit("ID"), F.col("batter_id").cast("string")).alias("key"),
        F.struct(F.col("batter_id").alias("id"), "homeRuns").alias("value"),
    )
    landed = per_player.groupBy("game_pk").agg(F.map_from_entries(F.collect_list(entry)).alias("players"))
    path = writers.scratch_path(spark, "boxscores")
    landed.write.json(path)
    return readers.boxscore_hitters(spark.read.schema(readers.BOXSCORE_SCHEMA).json(path))


@query("roster_dim", f"WITH {RAW_SQL} SELECT CAST(team_no AS VARCHAR) AS team, batter_id, max(player_name) AS batter_name FROM raw GROUP BY team_no, batter_id")
def roster_dim(spark: SparkSession, sf: str) -> DataFrame:
    members = T.raw_events(spark, sf).select("team_no", "batter_id", "player_name").distinct()
    # One landed record per (team, block of players) keeps the arrays short however large a team is.
    landed = members.groupBy(F.col("team_no").cast("string").alias("team"), F.floor(F.col("batter_id") / 100).alias("block")).agg(
        F.collect_list(F.struct("batter_id", F.col("player_name").alias("batter_name"))).alias("roster")
    )
    path = writers.scratch_path(spark, "rosters")
    landed.drop("block").write.json(path)
    return readers.roster_members(spark.read.schema(readers.ROSTER_SCHEMA).json(path))


@query(
    "dim_lookup",
    """SELECT e.event_id, n.n_name AS park, r.r_name AS region FROM events e
    LEFT JOIN nation n ON n.n_nationkey = e.user_id % 25 LEFT JOIN region r ON r.r_regionkey = n.n_regionkey""",
)
def dim_lookup(spark: SparkSession, sf: str) -> DataFrame:
    parks = J.attach_dim(
        table(spark, sf, "nation").select((F.col("n_nationkey").cast("bigint")).alias("park_id"), F.col("n_name").alias("park"), F.col("n_regionkey").alias("r_regionkey")),
        table(spark, sf, "region").select("r_regionkey", F.col("r_name").alias("region")),
        on=["r_regionkey"],
    )
    events = table(spark, sf, "events").select("event_id", (F.col("user_id") % 25).alias("park_id"))
    return J.attach_dim(events, parks, on=["park_id"]).select("event_id", "park", "region")


# ---------------------------------------------------------------- projections


@query("pa_filter", "SELECT event_id, event_type FROM events WHERE event_type IN ('purchase', 'signup', 'error', 'click')")
def pa_filter(spark: SparkSession, sf: str) -> DataFrame:
    ending = F.col("event_type").isNotNull() & F.col("event_type").isin("purchase", "signup", "error", "click")
    return table(spark, sf, "events").where(ending).select("event_id", "event_type")


@query("team_side", f"WITH {PA_SQL} SELECT event_id, batting_team, fielding_team, is_home FROM pa")
def team_side(spark: SparkSession, sf: str) -> DataFrame:
    return T.plate_appearances(spark, sf, order=False).select("event_id", "batting_team", "fielding_team", "is_home")


FLAGS = ["pa_count", "ab_count", "hr_count", "is_bb", "is_k", "bbe_count", "hard_hit_bbe_count", "fly_ball_bbe_count", "contact_event_count", "swing_event_count"]


@query("event_flags", f"WITH {PA_SQL} SELECT event_id, {', '.join(FLAGS)} FROM pa")
def event_flags(spark: SparkSession, sf: str) -> DataFrame:
    return T.plate_appearances(spark, sf, order=False).select("event_id", *FLAGS)


@query("barrel_flag", f"WITH {PA_SQL} SELECT event_id, barrel_count FROM pa")
def barrel_flag(spark: SparkSession, sf: str) -> DataFrame:
    return T.raw_events(spark, sf).select("event_id", S.is_barrel("launch_speed", "launch_angle").alias("barrel_count"))


@query("pull_air", f"WITH {PA_SQL} SELECT event_id, pull_air_bbe_count FROM pa")
def pull_air(spark: SparkSession, sf: str) -> DataFrame:
    return T.raw_events(spark, sf).select(
        "event_id", S.is_pull_air("bb_type", "stand", S.spray_angle("hc_x", "hc_y")).alias("pull_air_bbe_count")
    )


@query("spray_angle", f"WITH {PA_SQL} SELECT event_id, round(spray_angle, 6) AS spray_angle FROM pa")
def spray_angle(spark: SparkSession, sf: str) -> DataFrame:
    return round_doubles(T.raw_events(spark, sf).select("event_id", S.spray_angle("hc_x", "hc_y").alias("spray_angle")))


def case_of(expression: str, groups) -> str:
    return "CASE " + " ".join(f"WHEN {expression} IN {in_list(m)} THEN '{n}'" for n, m in groups.items()) + " END"


@query(
    "bucket_map",
    f"""WITH {RAW_SQL} SELECT event_id, {case_of("pitch_type", fv.COARSE_BUCKETS)} AS coarse, {case_of("pitch_type", fv.GRANULAR_BUCKETS)} AS granular,
      CASE {" ".join(f"WHEN pitcher_id IN ({', '.join(map(str, m))}) THEN '{n}'" for n, m in fv.WEATHER_LABELS.items())} ELSE 'Unknown' END AS weather
    FROM raw""",
)
def bucket_map(spark: SparkSession, sf: str) -> DataFrame:
    return T.raw_events(spark, sf).select(
        "event_id",
        S.bucket_of(F.lower("pitch_type"), fv.COARSE_BUCKETS).alias("coarse"),
        S.bucket_of("pitch_type", fv.GRANULAR_BUCKETS).alias("granular"),
        S.weather_label(F.col("pitcher_id").cast("string")).alias("weather"),
    )


SPLIT = f"(SELECT bg.*, {W.SPLIT_SQL} FROM bg)"


@query(
    "matchup_select",
    f"""WITH {BG_SQL} SELECT batter_id, game_pk, {", ".join(
        f"CASE WHEN pitcher_hand = 'L' THEN {n}_lhp ELSE {n}_rhp END AS {n}_pitcher_hand" for n in W.BATTER_RATES)} FROM {SPLIT}""",
)
def matchup_select(spark: SparkSession, sf: str) -> DataFrame:
    out = H.split_to_date(T.batter_counts(spark, sf), **W.BATTER, split="pitcher_hand", sides={"R": "rhp", "L": "lhp"}, rates=W.BATTER_RATES)
    picked = [S.by_hand("pitcher_hand", f"{n}_lhp", f"{n}_rhp").alias(f"{n}_pitcher_hand") for n in W.BATTER_RATES]
    return round_doubles(out.select("batter_id", "game_pk", *picked))


MODE_SQL = f"""md AS (SELECT game_pk, batter_id, pitcher_id FROM (SELECT game_pk, batter_id, pitcher_id,
    row_number() OVER (PARTITION BY game_pk, batter_id ORDER BY count(*) DESC, pitcher_id) AS rn
  FROM raw GROUP BY game_pk, batter_id, pitcher_id) WHERE rn = 1)"""


@query(
    "platoon",
    f"""WITH {PG_SQL} SELECT pitcher_id, game_pk, team, CASE WHEN p_throws <> 'L' THEN CAST(1 AS DOUBLE) ELSE 0 END AS platoon_advantage,
      CASE WHEN batters_faced >= 12 THEN 'starter_like' ELSE 'bullpen_like' END AS proxy FROM pg""",
)
def platoon(spark: SparkSession, sf: str) -> DataFrame:
    return T.pitcher_games(spark, sf, shared=False).select(
        "pitcher_id",
        "game_pk",
        "team",
        S.platoon_advantage(F.lit("L"), "p_throws").alias("platoon_advantage"),
        S.starter_proxy("batters_faced").alias("proxy"),
    )


@query(
    "slot_to_pa",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, least(greatest(round(4.65 - 0.08 * (l_linenumber - CAST(1 AS DOUBLE)), 6), 3.6), 4.8) AS expected_pa,
      least(greatest(round(1 + (4.65 - l_quantity / 10) / 0.08, 6), 1), 9) AS slot FROM lineitem""",
)
def slot_to_pa(spark: SparkSession, sf: str) -> DataFrame:
    out = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        S.slot_to_pa("l_linenumber").alias("expected_pa"),
        S.pa_to_slot(F.col("l_quantity") / 10).alias("slot"),
    )
    return round_doubles(out)


@query(
    "safe_rate",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_tax / nullif(l_discount, 0), 6) AS tax_per_discount FROM lineitem",
)
def safe_rate(spark: SparkSession, sf: str) -> DataFrame:
    out = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", S.safe_rate("l_tax", "l_discount").alias("tax_per_discount")
    )
    return round_doubles(out)


@query(
    "coalesce_cols",
    """SELECT c.c_custkey, coalesce(s.s_nationkey, c.c_nationkey) AS nationkey, round(coalesce(s.s_acctbal, c.c_acctbal), 6) AS acctbal
    FROM customer c LEFT JOIN supplier s ON s.s_suppkey = c.c_custkey""",
)
def coalesce_cols(spark: SparkSession, sf: str) -> DataFrame:
    left = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nationkey_x"), F.col("c_acctbal").alias("acctbal_x"))
    right = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_nationkey").alias("nationkey_y"), F.col("s_acctbal").alias("acctbal_y"))
    joined = left.join(right, "c_custkey", "left")
    return J.coalesce_columns(joined, {c: (f"{c}_x", f"{c}_y") for c in ("nationkey", "acctbal")})


LIVE_SHOWN = [c for c in PROFILES["live"] if c in W.TRAILING]


@query("profile_select", f"WITH {BG_SQL}, tr AS ({W.TRAILING_SQL} FROM bg) SELECT batter_id, game_pk, {', '.join(LIVE_SHOWN)} FROM tr")
def profile_select(spark: SparkSession, sf: str) -> DataFrame:
    block = W.trailing_block(spark, sf)
    return S.select_present(block, PROFILES["live"], ["batter_id", "game_pk"])


@query(
    "side_encode",
    f"""WITH {BG_SQL} SELECT batter_id, game_pk, CASE bat_side WHEN 'R' THEN CAST(1 AS DOUBLE) WHEN 'L' THEN CAST(0 AS DOUBLE) END AS bat_side,
      CASE pitcher_hand WHEN 'R' THEN CAST(1 AS DOUBLE) WHEN 'L' THEN CAST(0 AS DOUBLE) END AS pitcher_hand, CAST(1 AS DOUBLE) - is_home AS proxy FROM bg""",
)
def side_encode(spark: SparkSession, sf: str) -> DataFrame:
    proxy = F.when(F.col("is_home") == 1, "bullpen_like").otherwise("starter_like")
    games = T.batter_counts(spark, sf, shared=False).withColumn("proxy", proxy)
    encoded = encode_sides(games, sides=("bat_side", "pitcher_hand"), proxy="proxy")
    return encoded.select("batter_id", "game_pk", "bat_side", "pitcher_hand", "proxy")


@query(
    "park_lookup",
    f"""WITH {BG_SQL} SELECT bg.batter_id, bg.game_pk, n.n_name AS ballpark, r.r_name AS region_abbr, CAST(n.n_nationkey * 10 AS DOUBLE) AS field_bearing_deg FROM bg
    LEFT JOIN nation n ON n.n_nationkey = CASE WHEN is_home = 1 THEN team ELSE opponent END LEFT JOIN region r ON r.r_regionkey = n.n_regionkey""",
)
def park_lookup(spark: SparkSession, sf: str) -> DataFrame:
    path = writers.scratch_path(spark, "parks")
    key = F.col("n_nationkey").cast("double")
    places = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    landed = places.select(
        F.col("n_nationkey").cast("string").alias("team"), F.col("n_name").alias("ballpark"), F.col("r_name").alias("region_abbr"),
        (key * 10).alias("field_bearing_deg"), key.alias("lat"), (-key).alias("lon"), F.lit("UTC").alias("tz"),
    )
    landed.write.option("header", True).csv(path)
    parks = readers.read_parks(spark, path).withColumnRenamed("team", "park_team")
    games = T.batter_counts(spark, sf, shared=False).withColumns({c: F.col(c).cast("string") for c in ("team", "opponent")})
    out = R.park_of(games, parks, team="team", opponent="opponent", is_home="is_home", key="park_team")
    return out.select("batter_id", "game_pk", "ballpark", "region_abbr", "field_bearing_deg")


@query(
    "fill_alerts",
    f"""WITH {RAW_SQL}, d AS (SELECT game_date, home_team, avg(CASE WHEN events = 'view' AND event_id % 3 = 0 THEN value END) AS fresh, avg(CASE WHEN events = 'click' AND event_id % 2 = 0 THEN value END) AS cached FROM raw GROUP BY 1, 2),
    s AS (SELECT *, CASE WHEN fresh IS NOT NULL THEN 'fresh' WHEN cached IS NOT NULL THEN 'cached' ELSE 'null' END AS source FROM d)
    SELECT home_team, source, count(*) AS dates, min(game_date) AS first_date, max(game_date) AS last_date FROM s WHERE source <> 'fresh' GROUP BY 1, 2""",
)
def fill_alerts(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["game_date", "home_team"]

    def mean_of(event: str, every: int) -> Column:
        return F.avg(F.when((F.col("events") == event) & (F.col("event_id") % every == 0), F.col("value"))).alias("temp")

    raw = T.raw_events(spark, sf)
    fresh = raw.groupBy(*keys).agg(mean_of("view", 3))
    cached = raw.groupBy(*keys).agg(mean_of("click", 2)).where("temp is not null")
    filled = J.fallback_fill(fresh, cached, on=keys, values=["temp"])
    return J.fill_alerts(filled, by="home_team", date="game_date")


# ---------------------------------------------------------------- joins


def line_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("lines"), F.sum("l_extendedprice").alias("revenue")
    )


@query(
    "audited_join",
    """SELECT o.o_orderkey, o.o_custkey, l.lines, round(l.revenue, 4) AS revenue FROM orders o
    LEFT JOIN (SELECT l_orderkey, count(*) AS lines, sum(l_extendedprice) AS revenue FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey""",
)
def audited_join(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    out = J.audited_join(orders, line_rollup(spark, sf), on=["o_orderkey"], validate="one_to_one")
    return out.withColumn("revenue", F.round("revenue", 4))


@query(
    "join_audit",
    """WITH l AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN -c_custkey ELSE c_custkey END AS k, count(*) AS n, count(c_name) AS known FROM customer GROUP BY 1)
    SELECT CAST(sum(coalesce(l.n, 0)) AS BIGINT) AS left_rows, CAST(sum(coalesce(r.n, 0)) AS BIGINT) AS right_rows,
      CAST(sum(greatest(coalesce(l.n, 0) - 1, 0)) AS BIGINT) AS left_duplicates, CAST(sum(greatest(coalesce(r.n, 0) - 1, 0)) AS BIGINT) AS right_duplicates,
      CAST(sum(CASE WHEN r.n > 0 THEN coalesce(l.n, 0) ELSE 0 END) AS BIGINT) AS matched_rows,
      CAST(sum(CASE WHEN r.n IS NULL THEN l.n ELSE 0 END) AS BIGINT) AS unmatched_rows,
      CAST(sum(CASE WHEN r.n IS NULL THEN l.n ELSE coalesce(l.n, 0) * r.n END) AS BIGINT) AS output_rows,
      CAST(sum(coalesce(l.n, 0) * coalesce(r.known, 0)) AS BIGINT) AS non_null_c_name
    FROM l FULL JOIN r USING (k)""",
)
def join_audit(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    key = F.when(F.col("c_custkey") % 3 == 0, -F.col("c_custkey")).otherwise(F.col("c_custkey"))
    customers = table(spark, sf, "customer").withColumn("c_custkey", key)
    audit = J.join_audit(orders, customers, on=["c_custkey"], tracked=["c_name"])
    return audit.select(*[F.col(c).cast("bigint").alias(c) for c in audit.columns])


def mode_table(spark: SparkSession, sf: str) -> DataFrame:
    return R.most_frequent(T.raw_events(spark, sf), keys=["game_pk", "batter_id"], value="pitcher_id", count="pa_vs_pitcher")


@query(
    "feature_attach",
    f"""WITH {PG_SQL}, {MODE_SQL}, pf AS (SELECT pitcher_id, game_pk, team, {W.rate("hr_allowed", "pa_against", W.P30)} AS pitcher_hr_allowed_per_pa_last_30d FROM pg)
    SELECT md.batter_id, md.game_pk, md.pitcher_id, pf.pitcher_hr_allowed_per_pa_last_30d FROM md LEFT JOIN pf USING (pitcher_id, game_pk)""",
)
def feature_attach(spark: SparkSession, sf: str) -> DataFrame:
    features = W.trailing_opponent(spark, sf).select("pitcher_id", "game_pk", "pitcher_hr_allowed_per_pa_last_30d")
    mode = mode_table(spark, sf).select("batter_id", "game_pk", "pitcher_id")
    return J.audited_join(mode, features, on=["pitcher_id", "game_pk"], validate="many_to_one")


@query(
    "dim_join",
    """SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, p.p_type, p.p_brand FROM lineitem l LEFT JOIN part p ON p.p_partkey = l.l_partkey""",
)
def dim_join(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_brand")
    return J.attach_dim(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), parts, on=["l_partkey"])


@query(
    "outer_combine",
    """SELECT l_suppkey, max(n) FILTER (WHERE b = 'A') AS lines_A, max(n) FILTER (WHERE b = 'N') AS lines_N, max(n) FILTER (WHERE b = 'R') AS lines_R
    FROM (SELECT l_suppkey, l_returnflag AS b, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY l_suppkey""",
)
def outer_combine(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("lines"))
    blocks = {b: counts.where(F.col("l_returnflag") == b) for b in ("A", "N", "R")}
    return J.outer_combine(blocks, on=["l_suppkey"], measures=["lines"])


@query("semi_join", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def semi_join(spark: SparkSession, sf: str) -> DataFrame:
    open_orders = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey", "c_name").join(open_orders, "c_custkey", "left_semi")


@query("anti_join", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_join(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey").join(lines, "o_orderkey", "left_anti")


HOURLY_SQL = f"""{RAW_SQL}, hours AS (SELECT game_date, home_team, hour(ts) AS hour_no, avg(value) AS temperature_f FROM raw WHERE events <> 'view' GROUP BY 1, 2, 3),
  sched AS (SELECT DISTINCT game_date, home_team FROM raw),
  best AS (SELECT game_date, home_team, arg_min(struct_pack(h := hour_no, t := temperature_f), struct_pack(a := abs(hour_no - 19), b := hour_no)) AS m
    FROM hours GROUP BY 1, 2)"""


def weather(spark: SparkSession, sf: str) -> DataFrame:
    raw = T.raw_events(spark, sf)
    hours = raw.where("events != 'view'").groupBy("game_date", "home_team", F.hour("ts").alias("hour_no")).agg(F.avg("value").alias("temperature_f"))
    schedule = raw.select("game_date", "home_team").distinct()
    return J.nearest_hour(schedule, hours, on=["game_date", "home_team"], hour="hour_no", values=["temperature_f"])


@query(
    "nearest_hour",
    f"""WITH {HOURLY_SQL} SELECT game_date, home_team, m.h AS hour_no, round(m.t, 6) AS temperature_f, CASE WHEN m IS NULL THEN 1 ELSE 0 END AS missing
    FROM sched LEFT JOIN best USING (game_date, home_team)""",
)
def nearest_hour(spark: SparkSession, sf: str) -> DataFrame:
    return round_doubles(weather(spark, sf))


@query(
    "fallback_fill",
    """WITH f AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice END AS price, CASE WHEN p_partkey % 5 = 0 THEN p_size END AS size FROM part),
    c AS (SELECT l_partkey, avg(l_extendedprice) AS price, max(CAST(l_quantity AS INTEGER)) AS size FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
    SELECT p_partkey, CASE WHEN f.price IS NOT NULL OR f.size IS NOT NULL THEN 'fresh' WHEN l_partkey IS NOT NULL THEN 'cached' ELSE 'null' END AS source,
      round(coalesce(f.price, c.price), 6) AS price, coalesce(f.size, c.size) AS size FROM f LEFT JOIN c ON l_partkey = p_partkey""",
)
def fallback_fill(spark: SparkSession, sf: str) -> DataFrame:
    fresh = table(spark, sf, "part").select(
        "p_partkey",
        F.when(F.col("p_partkey") % 3 == 0, F.col("p_retailprice")).alias("price"),
        F.when(F.col("p_partkey") % 5 == 0, F.col("p_size")).alias("size"),
    )
    cached = table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.avg("l_extendedprice").alias("price"), F.max(F.col("l_quantity").cast("int")).alias("size")
    )
    return round_doubles(J.fallback_fill(fresh, cached, on=["p_partkey"], values=["price", "size"]))


@query(
    "snapshot_fill",
    f"""WITH {BG_SQL}, s AS (SELECT batter_id, arg_max(avg_exit_velocity, struct_pack(a := game_date, b := game_pk)) FILTER (WHERE avg_exit_velocity IS NOT NULL) AS v FROM bg GROUP BY 1)
    SELECT bg.batter_id, game_pk, round(coalesce(avg_exit_velocity, s.v), 6) AS avg_exit_velocity FROM bg LEFT JOIN s USING (batter_id)""",
)
def snapshot_fill(spark: SparkSession, sf: str) -> DataFrame:
    bg = T.batter_counts(spark, sf).select("batter_id", "game_pk", "game_date", "avg_exit_velocity")
    snapshot = H.latest_non_null(bg, keys=["batter_id"], order=["game_date", "game_pk"], columns=["avg_exit_velocity"])
    return round_doubles(J.snapshot_fill(bg, snapshot, on=["batter_id"], columns=["avg_exit_velocity"]).drop("game_date"))


@query(
    "recent_games",
    f"""WITH {RAW_SQL}, g AS (SELECT team_no, game_date, game_pk, row_number() OVER (PARTITION BY team_no ORDER BY game_date DESC, game_pk DESC) AS n
      FROM (SELECT DISTINCT team_no, game_date, game_pk FROM raw))
    SELECT event_id, team_no, game_pk FROM raw SEMI JOIN (SELECT * FROM g WHERE n <= 3) r USING (team_no, game_date, game_pk)""",
)
def recent_games(spark: SparkSession, sf: str) -> DataFrame:
    return J.recent_games(T.raw_events(spark, sf), team="team_no", date="game_date", game="game_pk").select("event_id", "team_no", "game_pk")


@query(
    "slate_expand",
    f"""WITH {RAW_SQL}, g AS (SELECT DISTINCT game_date, game_pk, home_team, away_team FROM raw), m AS (SELECT DISTINCT team_no, batter_id FROM raw),
    s AS (SELECT game_date, game_pk, 1 AS is_home, home_team AS team, away_team AS opponent FROM g UNION ALL SELECT game_date, game_pk, 0, away_team, home_team FROM g)
    SELECT game_date, game_pk, is_home, team, opponent, batter_id FROM s JOIN m ON m.team_no = s.team""",
)
def slate_expand(spark: SparkSession, sf: str) -> DataFrame:
    raw = T.raw_events(spark, sf)
    games = raw.select("game_date", "game_pk", "home_team", "away_team").distinct()
    sides = J.slate_sides(
        games,
        shared=["game_date", "game_pk"],
        home={"team": "home_team", "opponent": "away_team"},
        away={"team": "away_team", "opponent": "home_team"},
    )
    members = raw.select(F.col("team_no").alias("team"), "batter_id").distinct()
    return sides.join(members, "team")


@query(
    "rank_movement",
    f"""WITH {BOARD_SQL}, cur AS (SELECT game_date, game_pk, batter_id, batter_name, row_number() OVER (PARTITION BY game_date ORDER BY predicted_hr_score DESC NULLS LAST, batter_name, pick_id) AS rank FROM board),
    base AS (SELECT game_pk, batter_id, CASE WHEN batter_id % 3 = 0 THEN 'someone else' ELSE lower(batter_name) END AS nm, row_number() OVER (PARTITION BY game_date ORDER BY pick_id) AS morning_rank FROM board)
    SELECT cur.game_pk, cur.batter_id, CAST(rank AS BIGINT) AS rank, CAST(morning_rank AS BIGINT) AS morning_rank, CAST(morning_rank - rank AS BIGINT) AS movement
    FROM cur LEFT JOIN base ON base.game_pk = cur.game_pk AND base.batter_id = cur.batter_id AND base.nm = lower(cur.batter_name)""",
)
def rank_movement(spark: SparkSession, sf: str) -> DataFrame:
    from foretrace.operators import ranking as K
    from foretrace.operators.scan import positions

    board = T.board(spark, sf, shared=True)
    current = K.rerank(board, slate=["game_date"], score="predicted_hr_score", probability="predicted_hr_score", name="batter_name", tie="pick_id")
    other = F.when(F.col("batter_id") % 3 == 0, "someone else").otherwise(F.col("batter_name"))
    early = board.withColumn("batter_name", other)
    baseline = positions(early, keys=["game_date"], blocks=["game_pk"], order=["pick_id"], name="rank")
    out = J.rank_movement(current, baseline, keys=["game_pk", "batter_id"], name="batter_name", rank="rank")
    return out.select("game_pk", "batter_id", "rank", "morning_rank", "movement")


# ---------------------------------------------------------------- rollups

BG_COLUMNS = (
    "game_pk, game_date, batter_id, team, opponent, is_home, bat_side, pitcher_hand, batting_order, pa_count, ab_count, hr_count, bbe_count, barrel_count, "
    "hard_hit_bbe_count, batter_k_count, batter_bb_count, round(avg_launch_angle, 6) AS avg_launch_angle, round(avg_exit_velocity, 6) AS avg_exit_velocity, "
    "round(max_exit_velocity, 6) AS max_exit_velocity, ev_95plus_bbe_count, fly_ball_bbe_count, pull_air_bbe_count, hit_hr"
)


@query("entity_game_rollup", f"WITH {BG_SQL} SELECT {BG_COLUMNS} FROM bg")
def entity_game_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return round_doubles(T.batter_games(spark, sf, shared=False))


@query(
    "mode_opponent",
    f"""WITH {RAW_SQL} SELECT game_pk, batter_id, pitcher_id, n AS pa_vs_pitcher FROM (SELECT game_pk, batter_id, pitcher_id, count(*) AS n,
      row_number() OVER (PARTITION BY game_pk, batter_id ORDER BY count(*) DESC, pitcher_id) AS rn FROM raw GROUP BY 1, 2, 3) WHERE rn = 1""",
)
def mode_opponent(spark: SparkSession, sf: str) -> DataFrame:
    return mode_table(spark, sf)


HANDED_NAMES = ", ".join(f"{n}_{s}" for n in R.HANDED for s in ("rhb", "lhb"))


@query(
    "opponent_rollup",
    f"""WITH {PG_SQL} SELECT game_pk, game_date, team, opponent, pitcher_id, p_throws, pa_against, hr_allowed, bbe_allowed, barrels_allowed, hard_hit_bbe_allowed,
      ev_95plus_bbe_allowed, fb_allowed, pitcher_k_count, pitcher_bb_count, batters_faced, outs_recorded, round(avg_ev_allowed, 6) AS avg_ev_allowed,
      round(max_ev_allowed, 6) AS max_ev_allowed, round(innings_pitched_est, 6) AS innings_pitched_est, {HANDED_NAMES} FROM pg""",
)
def opponent_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return round_doubles(T.pitcher_games(spark, sf, shared=False))


@query(
    "primary_pick",
    f"""WITH {PG_SQL} SELECT game_pk, team, opponent, pitcher_id AS opp_pitcher_id, p_throws AS pitch_hand_primary, batters_faced AS opp_pitcher_bf FROM (
      SELECT *, row_number() OVER (PARTITION BY game_pk, team ORDER BY batters_faced DESC, pitcher_id) AS rn FROM pg) WHERE rn = 1""",
)
def primary_pick(spark: SparkSession, sf: str) -> DataFrame:
    return R.primary_opponent(T.pitcher_games(spark, sf, shared=False))


def index_sql(side: str, name: str) -> str:
    hr, bbe = ("hr_count", "bbe_count") if side == "" else (f"CASE WHEN stand = '{side}' THEN hr_count ELSE 0 END", f"CASE WHEN stand = '{side}' THEN bbe_count ELSE 0 END")
    return f"round((sum({hr}) + 50 * max(lg)) / (sum({bbe}) + 50) / max(lg) * 100, 6) AS {name}"


@query(
    "shrunk_index",
    f"""WITH {PA_SQL}, lg AS (SELECT CAST(sum(hr_count) AS DOUBLE) / sum(bbe_count) AS lg FROM pa)
    SELECT home_team, {index_sql("", "park_factor_hr")}, {index_sql("L", "park_factor_hr_vs_lhb")}, {index_sql("R", "park_factor_hr_vs_rhb")} FROM pa, lg GROUP BY home_team""",
)
def shrunk_index(spark: SparkSession, sf: str) -> DataFrame:
    pa = T.plate_appearances(spark, sf, order=False)
    return round_doubles(R.shrunk_index(pa, group="home_team", num="hr_count", den="bbe_count", side="stand"))


@query(
    "shrunk_index_as_of",
    f"""WITH {PA_SQL}, d AS (SELECT home_team, game_date, sum(hr_count) AS n, sum(bbe_count) AS b FROM pa GROUP BY 1, 2),
    l AS (SELECT game_date, CAST(sum(sum(hr_count)) OVER w AS DOUBLE) / nullif(CAST(sum(sum(bbe_count)) OVER w AS DOUBLE), 0) AS lg FROM pa GROUP BY game_date
      WINDOW w AS (ORDER BY game_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    p AS (SELECT home_team, game_date, coalesce(sum(n) OVER w, 0) AS n, coalesce(sum(b) OVER w, 0) AS b FROM d
      WINDOW w AS (PARTITION BY home_team ORDER BY game_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT home_team, game_date, round((n + 50 * lg) / (b + 50) / nullif(lg, 0) * 100, 6) AS park_factor_hr FROM p JOIN l USING (game_date)""",
)
def shrunk_index_as_of(spark: SparkSession, sf: str) -> DataFrame:
    pa = T.plate_appearances(spark, sf, order=False)
    return round_doubles(R.shrunk_index_as_of(pa, group="home_team", date="game_date", num="hr_count", den="bbe_count"))


@query(
    "majority_vote",
    """SELECT conv_id, role, n AS votes FROM (SELECT conv_id, role, count(*) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY count(*) DESC, role) AS rn
      FROM conversations GROUP BY conv_id, role) WHERE rn = 1""",
)
def majority_vote(spark: SparkSession, sf: str) -> DataFrame:
    return R.most_frequent(table(spark, sf, "conversations"), keys=["conv_id"], value="role")


@query(
    "id_stability",
    """SELECT count(*) AS ids, round(avg(CASE WHEN n <= 2 THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS stable_share, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS unstable_ids
    FROM (SELECT conv_id, count(DISTINCT role) AS n FROM conversations WHERE conv_id IS NOT NULL AND role IS NOT NULL GROUP BY conv_id)""",
)
def id_stability(spark: SparkSession, sf: str) -> DataFrame:
    return round_doubles(R.id_stability(table(spark, sf, "conversations"), entity="conv_id", name="role"))


@query(
    "weighted_rollup",
    f"""WITH {BG_SQL} SELECT opponent, game_date, CAST(sum(pa_count) AS BIGINT) AS pa_against, CAST(sum(hr_count) AS BIGINT) AS hr_allowed,
      round(sum(avg_exit_velocity * bbe_count) / nullif(CAST(sum(CASE WHEN avg_exit_velocity IS NOT NULL THEN bbe_count END) AS DOUBLE), 0), 6) AS avg_ev_allowed FROM bg GROUP BY opponent, game_date""",
)
def weighted_rollup(spark: SparkSession, sf: str) -> DataFrame:
    out = R.weighted_rollup(
        T.batter_counts(spark, sf, shared=False),
        keys=["opponent", "game_date"],
        sums={"pa_against": "pa_count", "hr_allowed": "hr_count"},
        means={"avg_ev_allowed": ("avg_exit_velocity", "bbe_count")},
    )
    return round_doubles(out)


@query(
    "rebuilt_history",
    f"""WITH {BG_SQL}, r AS (SELECT opponent, game_date, day_no, sum(pa_count) AS pa, sum(hr_count) AS hr FROM bg GROUP BY 1, 2, 3),
    t AS (SELECT opponent, game_date, sum(hr) OVER w AS hr, sum(pa) OVER w AS pa FROM r WINDOW w AS (PARTITION BY opponent ORDER BY day_no RANGE BETWEEN 30 PRECEDING AND 1 PRECEDING))
    SELECT bg.batter_id, bg.game_pk, round(CASE WHEN t.pa > 0 THEN CAST(t.hr AS DOUBLE) / t.pa END, 6) AS opponent_hr_per_pa_last_30d FROM bg LEFT JOIN t ON t.opponent = bg.opponent AND t.game_date = bg.game_date""",
)
def rebuilt_history(spark: SparkSession, sf: str) -> DataFrame:
    """The opponents' history, rebuilt from the batters' frame and joined back to it as of each day."""
    games = T.batter_counts(spark, sf)
    rebuilt = R.weighted_rollup(games, keys=["opponent", "game_date"], sums={"pa_against": "pa_count", "hr_allowed": "hr_count"}, means={})
    trailing = H.trailing_days(rebuilt, keys=["opponent"], date="game_date", days=[30], sums={"hr": "hr_allowed", "pa": "pa_against"})
    joined = games.join(trailing, ["opponent", "game_date"], "left")
    rate = S.safe_rate("hr_last_30d", "pa_last_30d").alias("opponent_hr_per_pa_last_30d")
    return round_doubles(joined.select("batter_id", "game_pk", rate))


@query(
    "pool_summary",
    f"""WITH {BG_SQL} SELECT team, batter_id, arg_max(bat_side, struct_pack(a := game_date, b := game_pk)) AS bat_side, round(arg_max(max_exit_velocity, struct_pack(a := game_date, b := game_pk))
      FILTER (WHERE max_exit_velocity IS NOT NULL), 6) AS max_exit_velocity, max(game_date) AS last_game_date, count(DISTINCT game_pk) AS recent_games,
      CAST(sum(CASE WHEN pa_count >= 3 THEN 1 ELSE 0 END) AS BIGINT) AS recent_starts, round(avg(pa_count), 6) AS avg_recent_pa FROM bg GROUP BY team, batter_id""",
)
def pool_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = R.pool_summary(
        T.batter_counts(spark, sf, shared=False),
        keys=["team", "batter_id"],
        order=["game_date", "game_pk"],
        date="game_date",
        game="game_pk",
        volume="pa_count",
        latest=["bat_side", "max_exit_velocity"],
    )
    return round_doubles(out)


@query(
    "season_leaders",
    f"""WITH {RAW_SQL} SELECT batter_id, CAST(sum(CASE WHEN events = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS total, count(*) AS volume, count(DISTINCT game_pk) AS games,
      max(player_name) AS player_name, CAST(max(team_no) AS INTEGER) AS team_no FROM raw WHERE year(game_date) = (SELECT year(max(game_date)) FROM raw)
    GROUP BY batter_id ORDER BY total DESC, volume DESC, games DESC, player_name, batter_id LIMIT 5""",
)
def season_leaders(spark: SparkSession, sf: str) -> DataFrame:
    raw = T.raw_events(spark, sf).withColumns({"hr": S.flag(F.col("events") == "purchase"), "pa": F.lit(1)})
    return R.season_leaders(
        raw,
        entity="batter_id",
        date="game_date",
        game="game_pk",
        value="hr",
        volume="pa",
        order=["game_date", "game_pk", "event_id"],
        name="player_name",
        latest=["team_no"],
        year=F.year(T.day_back(raw, 0)),
    )


@query(
    "source_profile",
    """SELECT count(*) AS row_count, min(CAST(ts AS DATE)) AS date_min, max(CAST(ts AS DATE)) AS date_max, TRUE AS supports_rollup, FALSE AS supports_pitch_types FROM events""",
)
def source_profile(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").withColumn("game_date", F.col("ts").cast("date"))
    return R.source_profile(
        events,
        date="game_date",
        capabilities={"supports_rollup": ["game_date", "user_id", "event_type"], "supports_pitch_types": ["pitch_type", "value"]},
    )


# ---------------------------------------------------------------- set operations


@query("union_all", "SELECT s_suppkey AS id, s_nationkey AS nation, round(s_acctbal, 2) AS balance FROM supplier UNION ALL SELECT c_custkey, c_nationkey, round(c_acctbal, 2) FROM customer")
def union_all(spark: SparkSession, sf: str) -> DataFrame:
    frames = [
        table(spark, sf, name).select(F.col(k).alias("id"), F.col(n).alias("nation"), F.round(b, 2).alias("balance"))
        for name, k, n, b in (("supplier", "s_suppkey", "s_nationkey", "s_acctbal"), ("customer", "c_custkey", "c_nationkey", "c_acctbal"))
    ]
    return readers.union_chunks(frames)


@query("distinct_keys", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def distinct_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").dropDuplicates()


@query("except_ids", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def except_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id").subtract(table(spark, sf, "labels").select("doc_id"))


# ---------------------------------------------------------------- text

VERBS = X.SUBJECT_VERBS
SUBJECT_RE = "(?i)^([A-Za-zÀ-ÖØ-öø-ÿ''., -]+?) (?:" + VERBS + ")"


def canonical_sql(text: str) -> str:
    return rf"""nullif(trim(regexp_replace(regexp_replace(trim({text}), '\s+', ' ', 'g'), '(?i)\b(bunt|ground|fly|line|pop)\b$', '')), '')"""


SUBJECT_SQL = rf"""coalesce(nullif(trim(regexp_extract(trim(des), '(?i)intentionally walks ([^\\.]+)', 1)), ''),
  {canonical_sql(f"regexp_extract(trim(des), '{SUBJECT_RE}', 1)")})"""


@query("regex_subject", f"WITH {RAW_SQL} SELECT event_id, {SUBJECT_SQL} AS subject FROM raw")
def regex_subject(spark: SparkSession, sf: str) -> DataFrame:
    return T.raw_events(spark, sf).select("event_id", X.subject_name("des").alias("subject"))


@query("canonical_text", rf"SELECT conv_id, turn, {canonical_sql('text')} AS canonical FROM conversations")
def canonical_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", X.canonical_name("text").alias("canonical"))


@query(
    "name_cascade",
    rf"""WITH {RAW_SQL}, a AS (SELECT batter_id, {canonical_sql(f"CASE WHEN batter_id % 4 = 0 THEN {SUBJECT_SQL} END")} AS nm FROM raw),
    b AS (SELECT c_custkey AS batter_id, {canonical_sql("CASE WHEN c_custkey % 3 = 0 THEN c_name END")} AS nm FROM customer),
    v AS (SELECT 0 AS src, * FROM a UNION ALL SELECT 1, * FROM b),
    t AS (SELECT src, batter_id, nm, row_number() OVER (PARTITION BY src, batter_id ORDER BY count(*) DESC, nm) AS rn FROM v
      WHERE nm IS NOT NULL AND NOT regexp_matches(nm, '(?i)^batter_[0-9]+$') GROUP BY src, batter_id, nm)
    SELECT i.batter_id, coalesce(x.nm, y.nm, 'batter_' || i.batter_id) AS batter_name,
      CASE WHEN x.nm IS NOT NULL THEN 'play text' WHEN y.nm IS NOT NULL THEN 'people' ELSE 'placeholder' END AS name_source
    FROM (SELECT DISTINCT batter_id FROM raw) i LEFT JOIN (SELECT * FROM t WHERE rn = 1 AND src = 0) x USING (batter_id)
    LEFT JOIN (SELECT * FROM t WHERE rn = 1 AND src = 1) y ON y.batter_id = i.batter_id""",
)
def name_cascade(spark: SparkSession, sf: str) -> DataFrame:
    raw = T.raw_events(spark, sf)
    # a source knows no name for some ids: a null, not a missing row
    play = raw.select("batter_id", F.when(F.col("batter_id") % 4 == 0, X.subject_name("des")).alias("batter_name"))
    people = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("batter_id"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).alias("batter_name")
    )
    return N.resolve(raw, entity="batter_id", sources=[("play text", play), ("people", people)])


@query(
    "placeholder_share",
    """SELECT count(*) AS row_count, CAST(sum(CASE WHEN user_id % 10 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS placeholders,
      round(CAST(sum(CASE WHEN user_id % 10 = 0 THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 6) AS placeholder_share FROM events""",
)
def placeholder_share(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(F.col("user_id") % 10 == 0, F.concat(F.lit("Batter_"), F.col("user_id").cast("string"))).otherwise("Ann Batter_1")
    named = table(spark, sf, "events").select(S.flag(X.is_placeholder(name)).alias("p"))
    return named.agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("p").alias("placeholders"), F.round(F.avg(F.col("p").cast("double")), 6).alias("placeholder_share")
    )


CODES = ("ari", "chw", "KCR ", "oak", "ATH", "sf", "W.S.H", "San Diego", "12", "tb")
CODES_SQL = "([" + ", ".join(f"'{c}'" for c in CODES) + "])[user_id % 10 + 1]"


def alias_sql(expression: str, aliases) -> str:
    return f"CASE {expression} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in aliases.items()) + f" ELSE {expression} END"


@query(
    "alias_normalize",
    rf"""WITH c AS (SELECT event_id, {CODES_SQL} AS code FROM events), u AS (SELECT *, upper(trim(code)) AS up, regexp_replace(upper(trim(code)), '[[:punct:]\s]', '', 'g') AS st FROM c)
    SELECT event_id, {alias_sql("up", fv.LIVE_ALIASES)} AS live_code, {alias_sql("up", fv.WEATHER_ALIASES)} AS weather_code,
      {alias_sql("st", fv.VENUE_ALIASES)} AS venue_code, regexp_replace(lower(trim(code)), '[[:punct:]]', '', 'g') AS venue_key FROM u""",
)
def alias_normalize(spark: SparkSession, sf: str) -> DataFrame:
    coded = table(spark, sf, "events").select("event_id", T.pick(CODES, F.col("user_id") % 10).alias("code"))
    return coded.select(
        "event_id",
        X.team_code("code", fv.LIVE_ALIASES).alias("live_code"),
        X.team_code("code", fv.WEATHER_ALIASES).alias("weather_code"),
        X.team_venue_key("code").alias("venue_code"),
        X.venue_key("code").alias("venue_key"),
    )


@query(
    "composite_id",
    f"""WITH {RAW_SQL} SELECT event_id, concat_ws(':', CAST(game_date AS VARCHAR), CASE WHEN event_id % 3 <> 0 THEN CAST(game_pk AS VARCHAR) END,
      coalesce(CASE WHEN event_id % 4 <> 0 THEN CAST(batter_id AS VARCHAR) END, replace(lower(player_name), ' ', '-')), CAST(pitcher_id AS VARCHAR)) AS pick_id FROM raw""",
)
def composite_id(spark: SparkSession, sf: str) -> DataFrame:
    game = F.when(F.col("event_id") % 3 != 0, F.col("game_pk"))
    batter = F.when(F.col("event_id") % 4 != 0, F.col("batter_id"))
    return T.raw_events(spark, sf).select(
        "event_id", X.pick_id("game_date", game, batter, "player_name", "pitcher_id", F.lit("")).alias("pick_id")
    )


@query(
    "label_normalize",
    """WITH w AS (SELECT event_id, (['HR ', 'hit', '1', 'Home Run', 'miss', '0', 'no_hr', 'PPD', 'cancelled', 'later', NULL])[event_id % 11 + 1] AS word FROM events),
    l AS (SELECT *, CASE WHEN lower(trim(word)) IN ('1', 'hr', 'hit', 'home_run', 'home run', 'success') THEN 'HR' WHEN lower(trim(word)) IN ('0', 'miss', 'no hr', 'no_hr', 'failed', 'failure') THEN 'No HR'
      WHEN lower(trim(word)) IN ('postponed', 'cancelled', 'ppd') THEN 'Postponed' ELSE 'Pending' END AS label FROM w)
    SELECT event_id, label, CASE WHEN label = 'HR' THEN 1 WHEN label = 'No HR' THEN 0 END AS outcome FROM l""",
)
def label_normalize(spark: SparkSession, sf: str) -> DataFrame:
    words = ("HR ", "hit", "1", "Home Run", "miss", "0", "no_hr", "PPD", "cancelled", "later", None)
    worded = table(spark, sf, "events").select("event_id", X.result_label(T.pick(words, F.col("event_id") % 11)).alias("label"))
    return worded.withColumn("outcome", X.result_outcome("label"))


STATUSES = ("Final", "Game Over", "In Progress", "Delayed Start: Rain", "Scheduled", "Postponed", "Pre-Game", "Completed Early")
STATUS_SQL = "([" + ", ".join(f"'{s}'" for s in STATUSES) + "])[event_id % 8 + 1]"


@query(
    "game_state",
    f"""WITH g AS (SELECT event_id, ts, lower({STATUS_SQL}) AS st FROM events) SELECT event_id, CASE WHEN regexp_matches(st, '{"|".join(fv.FINAL_STATUS_PARTS)}') THEN 'final'
      WHEN regexp_matches(st, '{"|".join(fv.LIVE_STATUS_PARTS)}') THEN 'live' WHEN ts <= TIMESTAMP '2024-01-15 12:00:00' THEN 'live' ELSE 'pregame' END AS state,
      regexp_matches(st, 'postponed|cancelled') AS postponed FROM g""",
)
def game_state(spark: SparkSession, sf: str) -> DataFrame:
    status = T.pick(STATUSES, F.col("event_id") % 8)
    reference = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    return table(spark, sf, "events").select(
        "event_id", X.game_state(status, "ts", reference).alias("state"), X.is_postponed(status).alias("postponed")
    )


@query(
    "tolerant_cast",
    """SELECT doc_id, TRY_CAST(source AS BIGINT) AS source_int, TRY_CAST(substr(source, 4) AS BIGINT) AS number, TRY_CAST(substr(source, 4) || '.5' AS DOUBLE) AS number_half,
      TRY_CAST('2024-' || lpad(substr(source, 4), 2, '0') || '-01' AS DATE) AS day FROM documents""",
)
def tolerant_cast(spark: SparkSession, sf: str) -> DataFrame:
    tail = F.substring("source", 4, 10)
    return table(spark, sf, "documents").select(
        "doc_id",
        X.to_int("source").alias("source_int"),
        X.to_int(tail).alias("number"),
        X.to_float(F.concat(tail, F.lit(".5"))).alias("number_half"),
        X.to_day(F.concat(F.lit("2024-"), F.lpad(tail, 2, "0"), F.lit("-01"))).alias("day"),
    )


@query(
    "relative_sector",
    """WITH w AS (SELECT event_id, ((value + 180 - (user_id % 60)) % 360 + 360) % 360 AS rel FROM events)
    SELECT event_id, CASE WHEN rel < 22.5 OR rel >= 337.5 THEN '↑' WHEN rel < 67.5 THEN '↗' WHEN rel < 112.5 THEN '→' WHEN rel < 157.5 THEN '↘' WHEN rel < 202.5 THEN '↓'
      WHEN rel < 247.5 THEN '↙' WHEN rel < 292.5 THEN '←' ELSE '↖' END AS arrow FROM w""",
)
def relative_sector(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", S.relative_sector("value", F.col("user_id") % 60).alias("arrow"))
