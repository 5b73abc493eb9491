"""Queries of the history operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretrace.functions import fixed_values as fv
from foretrace.functions import scalar as S
from foretrace.operators import history as H
from foretrace.operators import ranking as K
from foretrace.operators import rollup as R
from foretrace.plans import tables as T
from foretrace.plans.registry import query
from foretrace.plans.tables import BG_SQL, PA_SQL, PG_SQL, RAW_SQL, rounded
from foretrace.sources.readers import table

BATTER = {"keys": ["batter_id"], "date": "game_date", "order": ["game_pk"]}
PITCHER = {"keys": ["pitcher_id"], "date": "game_date", "order": ["game_pk", "team"]}
PRE = "(PARTITION BY batter_id ORDER BY game_date, game_pk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
PPRE = "(PARTITION BY pitcher_id ORDER BY game_date, game_pk, team ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def days(n: int, entity: str = "batter_id") -> str:
    return f"(PARTITION BY {entity} ORDER BY day_no RANGE BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def rate(num: str, den: str, frame: str) -> str:
    return f"round(CAST(sum({num}) OVER {frame} AS DOUBLE) / nullif(CAST(sum({den}) OVER {frame} AS DOUBLE), 0), 6)"


def total(column: str, frame: str) -> str:
    return f"CAST(sum({column}) OVER {frame} AS BIGINT)"


@query(
    "flagship",
    f"""WITH {RAW_SQL}, ud AS (
      SELECT batter_id, game_date, day_no, CAST(count(*) AS BIGINT) AS events,
        CAST(sum(CASE WHEN events = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS purchases
      FROM raw GROUP BY batter_id, game_date, day_no)
    SELECT batter_id, game_date, events, purchases, {rate("purchases", "events", days(7))} AS purchase_rate_last_7d,
      round(CAST(sum(purchases) OVER p AS DOUBLE) / nullif(CAST(sum(events) OVER p AS DOUBLE), 0), 6) AS purchase_rate_to_date
    FROM ud WINDOW p AS (PARTITION BY batter_id ORDER BY game_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    user_days = (
        table(spark, sf, "events")
        .groupBy(F.col("user_id").alias("batter_id"), F.col("ts").cast("date").alias("game_date"))
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.sum(S.flag(F.col("event_type") == "purchase")).alias("purchases"),
        )
        .withColumn("__day", H.day_number("game_date"))
    )
    by_day = Window.partitionBy("batter_id").orderBy("__day")
    week, before = by_day.rangeBetween(-7, -1), by_day.rowsBetween(Window.unboundedPreceding, -1)
    out = user_days.select(
        "batter_id",
        "game_date",
        "events",
        "purchases",
        S.safe_rate(F.sum("purchases").over(week), F.sum("events").over(week)).alias("purchase_rate_last_7d"),
        S.safe_rate(F.sum("purchases").over(before), F.sum("events").over(before)).alias("purchase_rate_to_date"),
    )
    return rounded(out, "purchase_rate_last_7d", "purchase_rate_to_date")


@query(
    "prefix_rate",
    f"""WITH {BG_SQL} SELECT batter_id, game_pk, {rate("hr_count", "pa_count", PRE)} AS hr_rate_season_to_date,
      {rate("batter_k_count", "pa_count", PRE)} AS batter_k_rate_season_to_date,
      {rate("batter_bb_count", "pa_count", PRE)} AS batter_bb_rate_season_to_date FROM bg""",
)
def prefix_rate(spark: SparkSession, sf: str) -> DataFrame:
    bg = T.batter_counts(spark, sf)
    sums = {"__hr": "hr_count", "__k": "batter_k_count", "__bb": "batter_bb_count", "__pa": "pa_count"}
    out = H.to_date(bg, **BATTER, sums=sums).select(
        "batter_id",
        "game_pk",
        S.safe_rate("__hr", "__pa").alias("hr_rate_season_to_date"),
        S.safe_rate("__k", "__pa").alias("batter_k_rate_season_to_date"),
        S.safe_rate("__bb", "__pa").alias("batter_bb_rate_season_to_date"),
    )
    return rounded(out, *out.columns[2:])


@query(
    "per9_rate",
    f"""WITH {PG_SQL} SELECT pitcher_id, game_pk, team,
      round(CASE WHEN sum(innings_pitched_est) OVER {PPRE} > 0 THEN CAST(sum(hr_allowed) OVER {PPRE} AS DOUBLE) * 9
        / (sum(outs_recorded) OVER {PPRE} / CAST(3 AS DOUBLE)) END, 6) AS pitcher_hr9_season_to_date,
      {rate("pitcher_k_count", "batters_faced", PPRE)} AS pitcher_k_rate_season_to_date,
      {rate("pitcher_bb_count", "batters_faced", PPRE)} AS pitcher_bb_rate_season_to_date FROM pg""",
)
def per9_rate(spark: SparkSession, sf: str) -> DataFrame:
    sums = {"__hr": "hr_allowed", "__outs": "outs_recorded", "__k": "pitcher_k_count", "__bb": "pitcher_bb_count", "__bf": "batters_faced"}
    pg = H.to_date(T.pitcher_games(spark, sf), **PITCHER, sums=sums)
    innings = F.col("__outs") / F.lit(3.0)
    out = pg.select(
        "pitcher_id",
        "game_pk",
        "team",
        F.when(innings > 0, F.col("__hr") * 9.0 / innings).alias("pitcher_hr9_season_to_date"),
        S.safe_rate("__k", "__bf").alias("pitcher_k_rate_season_to_date"),
        S.safe_rate("__bb", "__bf").alias("pitcher_bb_rate_season_to_date"),
    )
    return rounded(out, *out.columns[3:])


@query(
    "day_window_rate",
    f"""WITH {BG_SQL} SELECT batter_id, game_pk, {total("hr_count", days(7))} AS recent_form_hr_last_7d,
      {total("barrel_count", days(14))} AS recent_form_barrels_last_14d, {rate("hr_count", "pa_count", days(30))} AS hr_per_pa_last_30d
    FROM bg""",
)
def day_window_rate(spark: SparkSession, sf: str) -> DataFrame:
    out = H.attach_trailing(
        T.batter_counts(spark, sf),
        keys=["batter_id"],
        date="game_date",
        days=[7, 14, 30],
        sums={"hr": "hr_count", "barrels": "barrel_count", "pa": "pa_count"},
    ).select(
        "batter_id",
        "game_pk",
        F.col("hr_last_7d").alias("recent_form_hr_last_7d"),
        F.col("barrels_last_14d").alias("recent_form_barrels_last_14d"),
        S.safe_rate("hr_last_30d", "pa_last_30d").alias("hr_per_pa_last_30d"),
    )
    return rounded(out, "hr_per_pa_last_30d")


BLOCK_SQL = ", ".join(
    f"""{total("hr_count", days(d))} AS hr_count_last_{d}d, {total("pa_count", days(d))} AS pa_last_{d}d,
    {total("barrel_count", days(d))} AS barrels_last_{d}d, {rate("hr_count", "pa_count", days(d))} AS hr_per_pa_last_{d}d,
    {rate("barrel_count", "pa_count", days(d))} AS barrels_per_pa_last_{d}d,
    {rate("hard_hit_bbe_count", "bbe_count", days(d))} AS hard_hit_rate_last_{d}d,
    {rate("ev_95plus_bbe_count", "bbe_count", days(d))} AS bbe_95plus_ev_rate_last_{d}d"""
    for d in (10, 30)
)
TRAILING_SQL = f"""SELECT batter_id, game_pk, {BLOCK_SQL},
  {rate("coalesce(avg_exit_velocity, 0) * bbe_count", "bbe_count", days(10))} AS avg_exit_velocity_last_10d,
  round(max(max_exit_velocity) OVER {days(10)}, 6) AS max_exit_velocity_last_10d"""
TRAILING = (
    [f"{c}_last_{d}d" for d in (10, 30) for c in ("hr_count", "pa", "barrels", "hr_per_pa", "barrels_per_pa", "hard_hit_rate", "bbe_95plus_ev_rate")]
    + ["avg_exit_velocity_last_10d", "max_exit_velocity_last_10d"]
)


def round_doubles(df: DataFrame) -> DataFrame:
    return rounded(df, *[name for name, kind in df.dtypes if kind == "double"])


@query("trailing_block", f"WITH {BG_SQL} {TRAILING_SQL} FROM bg")
def trailing_block(spark: SparkSession, sf: str) -> DataFrame:
    out = H.batter_trailing_block(T.batter_counts(spark, sf), entity="batter_id", date="game_date")
    return round_doubles(out.select("batter_id", "game_pk", *TRAILING))


P30 = days(30, "pitcher_id")


OPPONENT = {
    "pitcher_hr_allowed_per_pa_last_30d": rate("hr_allowed", "pa_against", P30),
    "pitcher_hr_allowed_last_30d": total("hr_allowed", P30),
    "pitcher_barrels_allowed_per_bbe_last_30d": rate("barrels_allowed", "bbe_allowed", P30),
    "pitcher_barrels_allowed_last_30d": total("barrels_allowed", P30),
    "pitcher_hard_hit_allowed_rate_last_30d": rate("hard_hit_bbe_allowed", "bbe_allowed", P30),
    "pitcher_hard_hit_allowed_last_30d": total("hard_hit_bbe_allowed", P30),
    "pitcher_bbe_allowed_last_30d": total("bbe_allowed", P30),
    "pitcher_avg_ev_allowed_last_30d": rate("coalesce(avg_ev_allowed, 0) * bbe_allowed", "bbe_allowed", P30),
    "pitcher_95plus_ev_allowed_rate_last_30d": rate("ev_95plus_bbe_allowed", "bbe_allowed", P30),
}
OPPONENT_SQL = ", ".join(f"{sql} AS {name}" for name, sql in OPPONENT.items())


@query("trailing_opponent", f"WITH {PG_SQL} SELECT pitcher_id, game_pk, team, {OPPONENT_SQL} FROM pg")
def trailing_opponent(spark: SparkSession, sf: str) -> DataFrame:
    out = H.pitcher_trailing_block(T.pitcher_games(spark, sf), entity="pitcher_id", date="game_date")
    return round_doubles(out.select("pitcher_id", "game_pk", "team", *OPPONENT))


def count_window_sql(source: str, keys: str, order: str, count: str, nums: dict[str, str], size: int, units: str, outer: str) -> str:
    """The last ``size`` units by one range frame over the running count."""
    masked = ", ".join(f"CASE WHEN {count} > 0 THEN CAST(coalesce({c}, 0) AS DOUBLE) ELSE 0 END AS n{i}" for i, c in enumerate(nums.values()))
    n = range(len(nums))
    pre = f"(PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    by = f"(PARTITION BY {keys} ORDER BY {order})"
    cums = ", ".join(f"coalesce(sum(n{i}) OVER {pre}, 0) AS c{i}, coalesce(lag(n{i}) OVER {by}, 0) AS p{i}" for i in n)
    packed = ", ".join([f"c{i} := c{i}" for i in n] + [f"p{i} := p{i}" for i in n])
    rates = ", ".join(
        f"""round((c{i} - m.c{i} + CASE WHEN m.pos > greatest(pos - {size}, 0) AND m.pn > 0
          THEN m.p{i} * (m.pos - greatest(pos - {size}, 0)) / m.pn ELSE 0 END) / nullif(CAST(pos - greatest(pos - {size}, 0) AS DOUBLE), 0), 6) AS {name}"""
        for i, name in enumerate(nums)
    )
    return f"""{source}, w0 AS (SELECT *, CAST(coalesce({count}, 0) AS BIGINT) AS n, {masked} FROM {outer}),
    w1 AS (SELECT *, CAST(coalesce(sum(n) OVER {pre}, 0) AS BIGINT) AS pos, coalesce(lag(n) OVER {by}, 0) AS pn, {cums},
      row_number() OVER {by} AS rn FROM w0),
    w2 AS (SELECT *, arg_min(struct_pack(pos := pos, pn := pn, {packed}), struct_pack(a := pos, b := rn))
      OVER (PARTITION BY {keys} ORDER BY pos RANGE BETWEEN {size} PRECEDING AND CURRENT ROW) AS m FROM w1)
    SELECT {{columns}}, nullif(pos - greatest(pos - {size}, 0), 0) AS {units}, {rates} FROM w2"""


LAST_50 = {
    "barrel_rate_last_50_bbe": "barrel_count",
    "hard_hit_rate_last_50_bbe": "hard_hit_bbe_count",
    "fly_ball_rate_last_50_bbe": "fly_ball_bbe_count",
    "pull_air_rate_last_50_bbe": "pull_air_bbe_count",
    "avg_exit_velocity_last_50_bbe": "coalesce(avg_exit_velocity, 0) * bbe_count",
    "avg_launch_angle_last_50_bbe": "coalesce(avg_launch_angle, 0) * bbe_count",
}


@query(
    "count_window",
    "WITH "
    + count_window_sql(BG_SQL, "batter_id", "game_date, game_pk", "bbe_count", LAST_50, 50, "bbe_count_last_50", "bg").format(
        columns="batter_id, game_pk"
    ),
)
def count_window(spark: SparkSession, sf: str) -> DataFrame:
    out = H.count_window(
        T.batter_counts(spark, sf),
        **BATTER,
        count="bbe_count",
        numerators={n: F.expr(c) for n, c in LAST_50.items()},
        size=50,
        units_name="bbe_count_last_50",
    )
    return round_doubles(out.select("batter_id", "game_pk", "bbe_count_last_50", *LAST_50))


P_LAST_50 = {
    "pitcher_barrel_rate_allowed_last_50_bbe": "barrels_allowed",
    "pitcher_hard_hit_rate_allowed_last_50_bbe": "hard_hit_bbe_allowed",
    "pitcher_fb_rate_allowed_last_50_bbe": "fb_allowed",
}


@query(
    "count_window_opponent",
    "WITH "
    + count_window_sql(PG_SQL, "pitcher_id", "game_date, game_pk, team", "bbe_allowed", P_LAST_50, 50, "bbe_allowed_last_50", "pg").format(
        columns="pitcher_id, game_pk, team"
    ),
)
def count_window_opponent(spark: SparkSession, sf: str) -> DataFrame:
    out = H.count_window(
        T.pitcher_games(spark, sf),
        **PITCHER,
        count="bbe_allowed",
        numerators=P_LAST_50,
        size=50,
        units_name="bbe_allowed_last_50",
        span=256,
    )
    return round_doubles(out.select("pitcher_id", "game_pk", "team", "bbe_allowed_last_50", *P_LAST_50))


SUPPLY_SQL = """supply AS (
  SELECT l_suppkey, CAST(l_shipdate AS DATE) AS ship_date, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS day_no,
    l_orderkey, CAST(count(*) AS BIGINT) AS lines, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returns,
    sum(l_extendedprice) AS revenue
  FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE), l_orderkey)"""


def supply_games(spark: SparkSession, sf: str) -> DataFrame:
    """Lines per supplier, day and order: the larger table in the role of the game table."""
    return (
        table(spark, sf, "lineitem")
        .groupBy("l_suppkey", F.col("l_shipdate").cast("date").alias("ship_date"), "l_orderkey")
        .agg(
            F.count(F.lit(1)).alias("lines"),
            F.sum(S.flag(F.col("l_returnflag") == "R")).alias("returns"),
            F.sum("l_extendedprice").alias("revenue"),
        )
    )


@query(
    "count_window_lineitem",
    "WITH "
    + count_window_sql(
        SUPPLY_SQL, "l_suppkey", "ship_date, l_orderkey", "lines", {"return_rate_last_50": "returns", "price_last_50": "revenue"}, 50, "lines_last_50", "supply"
    ).format(columns="l_suppkey, ship_date, l_orderkey"),
)
def count_window_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    out = H.count_window(
        supply_games(spark, sf),
        keys=["l_suppkey"],
        date="ship_date",
        order=["l_orderkey"],
        count="lines",
        numerators={"return_rate_last_50": "returns", "price_last_50": "revenue"},
        units_name="lines_last_50",
    )
    return round_doubles(out.select("l_suppkey", "ship_date", "l_orderkey", "lines_last_50", "return_rate_last_50", "price_last_50"))


S180 = "(PARTITION BY l_suppkey ORDER BY day_no RANGE BETWEEN 180 PRECEDING AND 1 PRECEDING)"
S365 = "(PARTITION BY l_suppkey ORDER BY day_no RANGE BETWEEN 365 PRECEDING AND 1 PRECEDING)"


@query(
    "day_window_lineitem",
    f"""WITH {SUPPLY_SQL} SELECT l_suppkey, ship_date, l_orderkey, {total("lines", S180)} AS lines_last_180d,
      {rate("returns", "lines", S180)} AS return_rate_last_180d, {rate("returns", "lines", S365)} AS return_rate_last_365d FROM supply""",
)
def day_window_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    out = H.attach_trailing(
        supply_games(spark, sf),
        keys=["l_suppkey"],
        date="ship_date",
        days=[180, 365],
        sums={"lines": "lines", "returns": "returns"},
    ).select(
        "l_suppkey",
        "ship_date",
        "l_orderkey",
        "lines_last_180d",
        S.safe_rate("returns_last_180d", "lines_last_180d").alias("return_rate_last_180d"),
        S.safe_rate("returns_last_365d", "lines_last_365d").alias("return_rate_last_365d"),
    )
    return round_doubles(out)


PITCHER_HANDS = {"R": "rhp", "L": "lhp"}
BATTER_RATES = {
    "batter_hr_per_pa_vs": ("hr_count", "pa_count"),
    "batter_barrels_per_pa_vs": ("barrel_count", "pa_count"),
    "batter_hard_hit_rate_vs": ("hard_hit_bbe_count", "bbe_count"),
    "batter_95plus_ev_rate_vs": ("ev_95plus_bbe_count", "bbe_count"),
}
PITCHER_RATES = {
    "pitcher_hr_allowed_per_pa_vs": ("hr_allowed", "pa_against"),
    "pitcher_barrels_allowed_per_bbe_vs": ("barrels_allowed", "bbe_allowed"),
    "pitcher_hard_hit_allowed_rate_vs": ("hard_hit_bbe_allowed", "bbe_allowed"),
    "pitcher_95plus_ev_allowed_rate_vs": ("ev_95plus_bbe_allowed", "bbe_allowed"),
}
SPLIT_SQL = ", ".join(
    f"""round(CAST(sum(CASE WHEN pitcher_hand = '{h}' THEN {num} ELSE 0 END) OVER {PRE} AS DOUBLE)
      / nullif(CAST(sum(CASE WHEN pitcher_hand = '{h}' THEN {den} ELSE 0 END) OVER {PRE} AS DOUBLE), 0), 6) AS {name}_{suffix}"""
    for name, (num, den) in BATTER_RATES.items()
    for h, suffix in (("R", "rhp"), ("L", "lhp"))
)


@query("split_prefix", f"WITH {BG_SQL} SELECT batter_id, game_pk, {SPLIT_SQL} FROM bg")
def split_prefix(spark: SparkSession, sf: str) -> DataFrame:
    out = H.split_to_date(
        T.batter_counts(spark, sf), **BATTER, split="pitcher_hand", sides={"R": "rhp", "L": "lhp"}, rates=BATTER_RATES
    )
    return round_doubles(out.select("batter_id", "game_pk", *[f"{n}_{s}" for n in BATTER_RATES for s in ("rhp", "lhp")]))


PSPLIT_SQL = ", ".join(
    f"{rate(f'{num}_{s}', f'{den}_{s}', PPRE)} AS {name}_{s}" for name, (num, den) in PITCHER_RATES.items() for s in ("rhb", "lhb")
)


@query("split_prefix_opponent", f"WITH {PG_SQL} SELECT pitcher_id, game_pk, team, {PSPLIT_SQL} FROM pg")
def split_prefix_opponent(spark: SparkSession, sf: str) -> DataFrame:
    measures = [f"{m}_{s}" for m in R.HANDED for s in ("rhb", "lhb")]
    out = H.to_date(T.pitcher_games(spark, sf), **PITCHER, sums={f"__{m}": m for m in measures})
    rates = {f"{n}_{s}": S.safe_rate(f"__{a}_{s}", f"__{b}_{s}") for n, (a, b) in PITCHER_RATES.items() for s in ("rhb", "lhb")}
    return round_doubles(out.select("pitcher_id", "game_pk", "team", *[c.alias(n) for n, c in rates.items()]))


BUCKETS = {**fv.COARSE_BUCKETS, **fv.GRANULAR_BUCKETS}


def in_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


MIX_SQL = f"""mix AS (SELECT pitcher_id, game_date, day_no, game_pk, CAST(count(*) AS BIGINT) AS total_pitches,
  {", ".join(f"CAST(sum(CASE WHEN pitch_type IN {in_list(m)} THEN 1 ELSE 0 END) AS BIGINT) AS {n}" for n, m in BUCKETS.items())}
  FROM raw WHERE pitch_type IS NOT NULL GROUP BY pitcher_id, game_date, day_no, game_pk)"""


@query("mix_counts", f"WITH {RAW_SQL}, {MIX_SQL} SELECT pitcher_id, game_pk, total_pitches, {', '.join(BUCKETS)} FROM mix")
def mix_counts(spark: SparkSession, sf: str) -> DataFrame:
    return R.mix_counts(T.raw_events(spark, sf), keys=["pitcher_id", "game_pk"], code="pitch_type")


@query(
    "mix_share",
    f"""WITH {RAW_SQL}, {MIX_SQL} SELECT pitcher_id, game_pk,
      {", ".join(f"{rate(n, 'total_pitches', P30)} AS pitcher_{n}_pct" for n in BUCKETS)} FROM mix""",
)
def mix_share(spark: SparkSession, sf: str) -> DataFrame:
    counts = R.mix_counts(T.raw_events(spark, sf), keys=["pitcher_id", "game_date", "game_pk"], code="pitch_type")
    measures = ["total_pitches", *BUCKETS]
    out = H.attach_trailing(counts, keys=["pitcher_id"], date="game_date", days=[30], sums={m: m for m in measures})
    shares = [S.safe_rate(f"{n}_last_30d", "total_pitches_last_30d").alias(f"pitcher_{n}_pct") for n in BUCKETS]
    return round_doubles(out.select("pitcher_id", "game_pk", *shares))


BUCKET_SQL = (
    PA_SQL
    + f""", pb AS (
  SELECT batter_id, game_date, game_pk, unnest([
    CASE {" ".join(f"WHEN pitch_type IN {in_list(m)} THEN '{n}'" for n, m in fv.COARSE_BUCKETS.items())} END,
    CASE {" ".join(f"WHEN pitch_type IN {in_list(m)} THEN '{n}'" for n, m in fv.GRANULAR_BUCKETS.items())} END]) AS bucket, bbe_count, hard_hit_bbe_count, barrel_count, contact_event_count, swing_event_count
  FROM pa), bk AS (
  SELECT batter_id, game_date, game_pk, bucket, CAST(sum(bbe_count) AS BIGINT) AS bbe, CAST(sum(hard_hit_bbe_count) AS BIGINT) AS hard_hit,
    CAST(sum(barrel_count) AS BIGINT) AS barrel, CAST(sum(contact_event_count) AS BIGINT) AS contact,
    CAST(sum(swing_event_count) AS BIGINT) AS swing
  FROM pb WHERE bucket IS NOT NULL GROUP BY batter_id, game_date, game_pk, bucket)"""
)


def bucket_table(spark: SparkSession, sf: str) -> DataFrame:
    return R.bucket_counts(
        T.plate_appearances(spark, sf, order=False),
        keys=["batter_id", "game_date", "game_pk"],
        buckets=[S.bucket_of("pitch_type", fv.COARSE_BUCKETS), S.bucket_of("pitch_type", fv.GRANULAR_BUCKETS)],
        sums={"bbe": "bbe_count", "hard_hit": "hard_hit_bbe_count", "barrel": "barrel_count", "contact": "contact_event_count", "swing": "swing_event_count"},
    )


@query("bucket_counts", f"WITH {BUCKET_SQL} SELECT batter_id, game_pk, bucket, bbe, hard_hit, barrel, contact, swing FROM bk")
def bucket_counts(spark: SparkSession, sf: str) -> DataFrame:
    return bucket_table(spark, sf).drop("game_date")


BPRE = "(PARTITION BY batter_id, bucket ORDER BY game_date, game_pk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(
    "bucket_prefix",
    f"""WITH {BUCKET_SQL} SELECT batter_id, game_pk, bucket, {rate("hard_hit", "bbe", BPRE)} AS hard_hit_rate,
      {rate("barrel", "bbe", BPRE)} AS barrel_rate, {rate("contact", "swing", BPRE)} AS contact_rate FROM bk""",
)
def bucket_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return round_doubles(bucket_rates(spark, sf).drop("game_date"))


def bucket_rates(spark: SparkSession, sf: str) -> DataFrame:
    measures = ("bbe", "hard_hit", "barrel", "contact", "swing")
    out = H.to_date(
        bucket_table(spark, sf), keys=["batter_id", "bucket"], date="game_date", order=["game_pk"], sums={f"__{m}": m for m in measures}
    )
    return out.select(
        "batter_id",
        "game_date",
        "game_pk",
        "bucket",
        S.safe_rate("__hard_hit", "__bbe").alias("hard_hit_rate"),
        S.safe_rate("__barrel", "__bbe").alias("barrel_rate"),
        S.safe_rate("__contact", "__swing").alias("contact_rate"),
    )


BY = "(PARTITION BY batter_id ORDER BY game_date, game_pk)"


@query(
    "days_since",
    f"WITH {BG_SQL} SELECT batter_id, game_pk, CAST(date_diff('day', lag(game_date) OVER {BY}, game_date) AS BIGINT) AS days_since_last_game FROM bg",
)
def days_since(spark: SparkSession, sf: str) -> DataFrame:
    out = H.previous_row(T.batter_counts(spark, sf), **BATTER, values={"__last": "game_date"})
    return out.select("batter_id", "game_pk", F.datediff("game_date", "__last").cast("bigint").alias("days_since_last_game"))


LAG_SQL = f"""lagged AS (SELECT *, lag(batting_order) OVER {BY} AS prior_slot, sum(pa_count) OVER {days(14)} AS pa14 FROM bg),
  proxied AS (SELECT *, coalesce(CAST(pa14 AS DOUBLE), CASE WHEN prior_slot IS NOT NULL
      THEN least(greatest(4.65 - 0.08 * (prior_slot - CAST(1 AS DOUBLE)), 3.6), 4.8) END) AS expected_pa_proxy
    FROM lagged),
  slotted AS (SELECT *, coalesce(CAST(prior_slot AS DOUBLE), CASE WHEN expected_pa_proxy IS NOT NULL
      THEN least(greatest(1 + (4.65 - expected_pa_proxy) / 0.08, CAST(1 AS DOUBLE)), CAST(9 AS DOUBLE)) END) AS batting_order_slot FROM proxied),
  spread AS (SELECT *, CASE WHEN batting_order_slot IS NOT NULL
      THEN least(greatest(4.65 - 0.08 * (batting_order_slot - CAST(1 AS DOUBLE)), 3.6), 4.8) ELSE expected_pa_proxy END AS expected_pa_today,
      CAST(sum(CASE WHEN prior_slot IS NULL THEN 0 ELSE 1 END) OVER {days(30)} AS DOUBLE) AS slot_count_30d,
      coalesce(stddev_samp(prior_slot) OVER {days(30)}, 0) AS slot_std_30d FROM slotted),
  opp AS (SELECT *, CASE WHEN slot_count_30d > 0 THEN least(greatest(0.35 + 0.65 * (slot_count_30d / (slot_count_30d + 2)) * (1 / (1 + slot_std_30d)),
      CAST(0.35 AS DOUBLE)), CAST(1 AS DOUBLE)) ELSE CAST(0.35 AS DOUBLE) END AS lineup_confirmation_score FROM spread)"""


def opportunity(spark: SparkSession, sf: str) -> DataFrame:
    bg = T.batter_games(spark, sf)
    bg = H.previous_row(bg, **BATTER, values={"prior_slot": "batting_order"})
    sums = {"pa": "pa_count", **H.spread_sums("prior_slot")}
    bg = H.attach_trailing(bg, keys=["batter_id"], date="game_date", days=[14, 30], sums=sums)
    proxy = F.coalesce(F.col("pa_last_14d").cast("double"), S.slot_to_pa("prior_slot"))
    bg = bg.withColumn("expected_pa_proxy", proxy).drop("pa_last_14d", "pa_last_30d", *[f"{c}_last_14d" for c in ("__n", "__s", "__ss")])
    slot = F.coalesce(F.col("prior_slot").cast("double"), S.pa_to_slot("expected_pa_proxy"))
    bg = H.with_spread(bg, days=30, prefix="slot").withColumn("batting_order_slot", slot)
    return bg.withColumn("expected_pa_today", F.coalesce(S.slot_to_pa("batting_order_slot"), F.col("expected_pa_proxy")))


@query(
    "lag_fallback",
    f"""WITH {BG_SQL}, {LAG_SQL} SELECT batter_id, game_pk, round(expected_pa_proxy, 6) AS expected_pa_proxy,
      round(batting_order_slot, 6) AS batting_order_slot, round(expected_pa_today, 6) AS expected_pa_today FROM opp""",
)
def lag_fallback(spark: SparkSession, sf: str) -> DataFrame:
    out = opportunity(spark, sf).select("batter_id", "game_pk", "expected_pa_proxy", "batting_order_slot", "expected_pa_today")
    return round_doubles(out)


def confirmed(spark: SparkSession, sf: str) -> DataFrame:
    return opportunity(spark, sf).withColumn("lineup_confirmation_score", S.confirmation_score("slot_count_30d", "slot_std_30d"))


@query(
    "lag_window_std",
    f"""WITH {BG_SQL}, {LAG_SQL} SELECT batter_id, game_pk, slot_count_30d, round(slot_std_30d, 6) AS slot_std_30d FROM opp""",
)
def lag_window_std(spark: SparkSession, sf: str) -> DataFrame:
    out = H.lagged_spread(T.batter_games(spark, sf), **BATTER, value="batting_order", days=30, prefix="slot")
    return round_doubles(out.select("batter_id", "game_pk", "slot_count_30d", "slot_std_30d"))


@query(
    "confirm_score",
    f"WITH {BG_SQL}, {LAG_SQL} SELECT batter_id, game_pk, round(lineup_confirmation_score, 6) AS lineup_confirmation_score FROM opp",
)
def confirm_score(spark: SparkSession, sf: str) -> DataFrame:
    return round_doubles(confirmed(spark, sf).select("batter_id", "game_pk", "lineup_confirmation_score"))


@query(
    "lineup_rank",
    f"""WITH {BG_SQL}, {LAG_SQL} SELECT batter_id, game_pk, CAST(row_number() OVER (PARTITION BY game_pk, team
      ORDER BY round(expected_pa_today, 9) DESC NULLS LAST, round(lineup_confirmation_score, 9) DESC NULLS LAST,
      round(batting_order_slot, 9) ASC NULLS LAST, batter_id) AS INTEGER) AS projected_lineup_rank FROM opp""",
)
def lineup_rank(spark: SparkSession, sf: str) -> DataFrame:
    ranked = K.lineup_rank(
        confirmed(spark, sf),
        keys=["game_pk", "team"],
        expected=F.round("expected_pa_today", 9),
        score=F.round("lineup_confirmation_score", 9),
        slot=F.round("batting_order_slot", 9),
        entity="batter_id",
    )
    return ranked.select("batter_id", "game_pk", "projected_lineup_rank")


@query("capped_dense_rank", f"WITH {PA_SQL} SELECT event_id, CAST(batting_order AS INTEGER) AS batting_order FROM pa")
def capped_dense_rank(spark: SparkSession, sf: str) -> DataFrame:
    return T.plate_appearances(spark, sf).select("event_id", "batting_order")


@query(
    "slate_percentile",
    """SELECT event_id, CAST(row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY value / 500 DESC, event_id) AS BIGINT) AS slate_rank,
      round(CAST(row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY value / 500, event_id) AS DOUBLE)
        / count(*) OVER (PARTITION BY CAST(ts AS DATE)), 6) AS slate_percentile FROM events""",
)
def slate_percentile(spark: SparkSession, sf: str) -> DataFrame:
    scored = table(spark, sf, "events").select(
        "event_id", F.col("ts").cast("date").alias("slate"), (F.col("value") / 500).alias("score")
    )
    out = K.slate_percentile(scored, slate="slate", score="score", tie="event_id")
    return rounded(out.select("event_id", "slate_rank", "slate_percentile"), "slate_percentile")


@query(
    "latest_non_null",
    f"""WITH {BG_SQL}, f AS (SELECT batter_id, game_date, game_pk, max_exit_velocity AS speed, avg_launch_angle AS angle,
      CASE WHEN hr_count > 0 THEN hr_count END AS hr FROM bg)
    SELECT batter_id, round(arg_max(speed, struct_pack(a := game_date, b := game_pk)) FILTER (WHERE speed IS NOT NULL), 6) AS speed,
      round(arg_max(angle, struct_pack(a := game_date, b := game_pk)) FILTER (WHERE angle IS NOT NULL), 6) AS angle,
      arg_max(hr, struct_pack(a := game_date, b := game_pk)) FILTER (WHERE hr IS NOT NULL) AS hr FROM f GROUP BY batter_id""",
)
def latest_non_null(spark: SparkSession, sf: str) -> DataFrame:
    f = T.batter_counts(spark, sf, shared=False).select(
        "batter_id",
        "game_date",
        "game_pk",
        F.col("max_exit_velocity").alias("speed"),
        F.col("avg_launch_angle").alias("angle"),
        F.when(F.col("hr_count") > 0, F.col("hr_count")).alias("hr"),
    )
    return round_doubles(H.latest_non_null(f, keys=["batter_id"], order=["game_date", "game_pk"], columns=["speed", "angle", "hr"]))


@query(
    "dedup_last",
    f"""WITH {RAW_SQL} SELECT batter_id, game_pk, event_id, events FROM (
      SELECT *, row_number() OVER (PARTITION BY batter_id, game_pk ORDER BY ts DESC, event_id DESC) AS rn FROM raw) WHERE rn = 1""",
)
def dedup_last(spark: SparkSession, sf: str) -> DataFrame:
    out = K.dedup(T.raw_events(spark, sf), keys=["batter_id", "game_pk"], order=[F.desc("ts"), F.desc("event_id")])
    return out.select("batter_id", "game_pk", "event_id", "events")


AS_OF_SQL = f"""{BG_SQL}, target AS (SELECT max(game_date) + INTERVAL 1 DAY AS d FROM bg),
  u AS (SELECT batter_id, game_pk, game_date, day_no, hr_count, pa_count, barrel_count, hard_hit_bbe_count, bbe_count, ev_95plus_bbe_count,
      avg_exit_velocity, max_exit_velocity, pitcher_hand, FALSE AS is_candidate FROM bg UNION ALL
    SELECT DISTINCT batter_id, CAST(-1 AS BIGINT), CAST((SELECT d FROM target) AS DATE),
      date_diff('day', DATE '1970-01-01', CAST((SELECT d FROM target) AS DATE)), 0, 0, 0, 0, 0, 0, NULL, NULL, NULL, TRUE FROM bg)"""
BATTER_SPLITS = [f"{n}_{s}" for n in BATTER_RATES for s in ("rhp", "lhp")]
PITCHER_SPLITS = [f"{n}_{s}" for n in PITCHER_RATES for s in ("rhb", "lhb")]
HANDED = [f"{m}_{s}" for m in R.HANDED for s in ("rhb", "lhb")]


def candidate_rows(history: DataFrame, entity: str, counts) -> DataFrame:
    """A row without counts of each entity on the day after the newest one."""
    target = history.agg(F.date_add(F.max("game_date"), 1)).scalar()
    zeros = [F.lit(0).cast("bigint").alias(c) for c in counts]
    return history.select(entity).distinct().select(entity, F.lit(-1).cast("bigint").alias("game_pk"), target.alias("game_date"), *zeros)


def as_of_table(spark: SparkSession, sf: str) -> DataFrame:
    history = T.batter_counts(spark, sf)
    counts = ["hr_count", "pa_count", "barrel_count", "hard_hit_bbe_count", "bbe_count", "ev_95plus_bbe_count"]
    return H.as_of_rows(history, candidate_rows(history, "batter_id", counts))


def as_of_batters(spark: SparkSession, sf: str) -> DataFrame:
    """Trailing block and handed splits of all batter rows, those of the next day among them."""
    out = H.batter_trailing_block(
        as_of_table(spark, sf), entity="batter_id", date="game_date", order=["game_pk"], totals=H.split_sums("pitcher_hand", PITCHER_HANDS, BATTER_RATES)
    ).withColumns(H.split_rates(PITCHER_HANDS, BATTER_RATES))
    return round_doubles(out.select("batter_id", "game_date", "game_pk", "is_candidate", *TRAILING, *BATTER_SPLITS))


PITCHER_COUNTS = ("hr_allowed", "pa_against", "barrels_allowed", "hard_hit_bbe_allowed", "bbe_allowed", "ev_95plus_bbe_allowed")
PITCHER_AS_OF_SQL = f"""{PG_SQL[len(PA_SQL) :]}, pu AS (SELECT pitcher_id, game_pk, team, game_date, day_no, {", ".join((*PITCHER_COUNTS, *HANDED))}, avg_ev_allowed, FALSE AS is_candidate FROM pg UNION ALL
    SELECT DISTINCT pitcher_id, CAST(-1 AS BIGINT), NULL, CAST((SELECT d FROM target) AS DATE), date_diff('day', DATE '1970-01-01', CAST((SELECT d FROM target) AS DATE)), {", ".join("0" for _ in (*PITCHER_COUNTS, *HANDED))}, NULL, TRUE FROM pg)"""


def as_of_pitchers(spark: SparkSession, sf: str) -> DataFrame:
    """The same of all pitcher rows."""
    counts = (*PITCHER_COUNTS, *HANDED)
    history = T.pitcher_games(spark, sf).select("pitcher_id", "game_pk", "game_date", "team", *counts, "avg_ev_allowed")
    rows = H.as_of_rows(history, candidate_rows(history, "pitcher_id", counts))
    out = H.pitcher_trailing_block(rows, entity="pitcher_id", date="game_date", order=["game_pk", "team"], totals={f"__{m}": m for m in HANDED})
    rates = {f"{n}_{s}": S.safe_rate(f"__{a}_{s}", f"__{b}_{s}") for n, (a, b) in PITCHER_RATES.items() for s in ("rhb", "lhb")}
    return round_doubles(out.withColumns(rates).select("pitcher_id", "game_date", "game_pk", "is_candidate", *OPPONENT, *PITCHER_SPLITS))


AS_OF_BATTERS_SQL = f"SELECT batter_id, game_date, game_pk, is_candidate, {TRAILING_SQL.split('game_pk, ', 1)[1]}, {SPLIT_SQL} FROM u"
AS_OF_PITCHERS_SQL = f"SELECT pitcher_id, game_date, game_pk, is_candidate, {OPPONENT_SQL}, {PSPLIT_SQL} FROM pu"


@query(
    "as_of_today",
    f"""WITH {AS_OF_SQL}{PITCHER_AS_OF_SQL}, b AS ({AS_OF_BATTERS_SQL}), p AS ({AS_OF_PITCHERS_SQL})
    SELECT 'batter' AS entity, batter_id AS entity_id, * EXCLUDE (batter_id, game_date, game_pk, is_candidate) FROM b WHERE is_candidate
    UNION ALL BY NAME SELECT 'pitcher' AS entity, pitcher_id AS entity_id, * EXCLUDE (pitcher_id, game_date, game_pk, is_candidate) FROM p WHERE is_candidate""",
)
def as_of_today(spark: SparkSession, sf: str) -> DataFrame:
    """Both trailing blocks and both sides' handed splits, run again with a row without counts on the next day."""

    def today(rows: DataFrame, entity: str) -> DataFrame:
        found = rows.where("is_candidate").drop("game_date", "game_pk", "is_candidate")
        return found.withColumnRenamed(f"{entity}_id", "entity_id").withColumn("entity", F.lit(entity))

    batters, pitchers = today(as_of_batters(spark, sf), "batter"), today(as_of_pitchers(spark, sf), "pitcher")
    return batters.unionByName(pitchers, allowMissingColumns=True)
