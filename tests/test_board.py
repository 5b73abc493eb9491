import datetime

import pytest
from pyspark.sql import functions as F

from foretrace.operators import board as B
from foretrace.operators import lineup as L

DAY = datetime.date(2024, 4, 10)


def day(n=0):
    return DAY + datetime.timedelta(days=n)


HISTORY = "pick_id string, game_date date, result_label string, actual_hit_hr int, predicted_hr_score double"


def test_history_upsert_rules(spark):
    history = spark.createDataFrame(
        [("a", day(), "HR", 1, 9.0), ("b", day(), "Pending", None, 8.0), ("c", day(-1), "Pending", None, 7.0), ("d", day(), "No HR", 0, 6.0)], HISTORY
    )
    incoming = spark.createDataFrame([("a", day(), "Pending", None, 5.0), ("d", day(), "HR", 1, 4.0), ("e", day(), "Pending", None, 3.0)], HISTORY)
    got = {r.pick_id: (r.result_label, r.actual_hit_hr, r.predicted_hr_score) for r in B.upsert_history(history, incoming).collect()}
    assert got == {"a": ("HR", 1, 5.0), "c": ("Pending", None, 7.0), "d": ("HR", 1, 4.0), "e": ("Pending", None, 3.0)}


def test_replace_ignores_rows_without_id(spark):
    old = spark.createDataFrame([("a", 1), ("", 2), (None, 3)], "pick_id string, v int")
    new = spark.createDataFrame([("a", 4), ("b", 5), ("", 6)], "pick_id string, v int")
    assert {(r.pick_id, r.v) for r in B.upsert_replace(old, new).collect()} == {("a", 4), ("b", 5)}


def test_recovery_variants(spark):
    schema = "pick_id string, game_date date, result_label string"
    current = spark.createDataFrame([("a", day(), "Pending")], schema)
    history = spark.createDataFrame([("a", day(), "Pending"), ("b", day(-1), "Pending"), ("c", day(-1), "HR")], schema)
    now, past = B.recover_pending(current, history)
    assert {r.pick_id for r in now.collect()} == {"a", "b"} and {r.pick_id for r in past.collect()} == {"c"}
    now, past = B.recover_pending(current, history.where("pick_id <> 'b'"))
    assert {r.pick_id for r in now.collect()} == {"a"} and {r.pick_id for r in past.collect()} == {"a", "c"}
    # rows without an id: lost rows clear the history and the board of them, else both stay
    nameless = current.unionByName(spark.createDataFrame([("", day(), "HR")], schema))
    only = history.where("pick_id = 'c'").unionByName(spark.createDataFrame([(None, day(-1), "Pending")], schema))
    now, past = B.recover_pending(nameless, only)
    assert {r.pick_id for r in now.collect()} == {"a"} and {r.pick_id for r in past.collect()} == {"c"}
    now, past = B.recover_pending(nameless, history.where("pick_id = 'a'"))
    assert {r.pick_id for r in now.collect()} == {"a", ""} and past.count() == 1


PICK = (
    "pick_id string, game_pk long, game_date date, batter_id long, batter_name string, rank int, predicted_hr_score double, "
    "predicted_hr_probability double, game_state string, top_reason_1 string, weather_label string, ballpark_name string"
)


def test_same_day_merge(spark):
    existing = spark.createDataFrame(
        [
            ("x1", 1, day(), 10, "A", 1, 98.0, 0.9, "pregame", "old", "", None),
            ("x3", 1, day(), 12, "A", 4, 97.0, 0.9, "pregame", "old", "", None),
            ("x2", 2, day(), 20, "B", 2, 50.0, 0.5, "pregame", "old", "", None),
            ("p", 9, day(-1), 30, "P", 7, 1.0, 0.1, "final", "kept", "", None),
            ("u", None, None, 31, "U", 8, 2.0, 0.1, "pregame", "kept", "", None),
        ],
        PICK,
    )
    refreshed = spark.createDataFrame(
        [
            ("x1", 1, day(), 10, "A", 1, 10.0, 0.1, "pregame", "new", "Rain", None),
            ("other", 1, day(), 12, "A", 5, 10.0, 0.1, "pregame", "by pair", "", None),
            ("y", 1, day(), 11, "C", 2, 99.0, 0.9, "pregame", "n", "", None),
            ("z", 2, day(), 21, "D", 3, 60.0, 0.6, "pregame", "n", "", None),
            ("w", None, day(), 22, "W", 3, None, None, "pregame", "n", "", None),
        ],
        PICK,
    )
    games = spark.createDataFrame([(1, "live", "HH"), (2, "pregame", "GG")], "game_pk long, game_state string, home_team string")
    parks = spark.createDataFrame([("HH", "Home Field")], "home_team string, ballpark_name string")

    def merged(**options):
        rows = B.locked_merge(existing, refreshed, games, day=F.lit(DAY), **options).collect()
        return {r.pick_id: (r["rank"], r.predicted_hr_score, r.top_reason_1, r.weather_label, r.ballpark_name) for r in rows}

    whole = {
        "x1": (1, 98.0, "new", "Rain", "Home Field"),
        "x3": (2, 97.0, "by pair", "Rain", "Home Field"),
        "z": (3, 60.0, "n", "", None),
        "w": (4, None, "n", "", None),
        "p": (7, 1.0, "kept", "", None),
        "u": (8, 2.0, "kept", "", None),
    }
    got = merged(parks=parks)
    got["x3"] = (*got["x3"][:3], "Rain", *got["x3"][4:])  # of several refreshed rows of a game any may give its weather
    assert got == whole
    assert set(merged(parks=parks, max_picks=3)) == {"x1", "x3", "z", "p", "u"}
    # nothing is locked: all refreshed rows, no limit
    free = games.withColumn("game_state", F.lit("pregame"))
    rows = B.locked_merge(existing, refreshed, free, day=F.lit(DAY), max_picks=2).collect()
    assert {r.pick_id: r["rank"] for r in rows if r.game_date == day()} == {"y": 1, "z": 2, "other": 3, "x1": 4, "w": 5}
    # another day: no row of it is on the board yet
    rows = B.locked_merge(existing, refreshed, games, day=F.lit(DAY) + F.expr("INTERVAL 1 DAY"), max_picks=2).collect()
    assert len(rows) == len(existing.collect()) + 5


def test_settlement_ladder(spark):
    picks = spark.createDataFrame(
        [
            ("hit", 1, day(), 1, "Pending", None, "final", "Final"),
            ("miss", 1, day(), 2, "Pending", None, "final", "Final"),
            ("data", 2, day(-3), 3, "Pending", None, "final", "Final"),
            ("rain", 3, day(), 4, "Pending", None, "final", "Postponed"),
            ("lag", 4, day(), 5, "Pending", None, "final", "Final"),
            ("future", 5, day(9), 6, "Pending", None, "pregame", "Scheduled"),
            ("undated", 6, None, 7, "HR", 1, "pregame", ""),
            ("moved", 2, day(-3), 8, "HR", 1, "final", "Final"),
        ],
        "pick_id string, game_pk long, game_date date, batter_id long, result_label string, actual_hit_hr int, game_state string, game_status string",
    )
    out = B.settle(
        picks,
        outcomes=spark.createDataFrame([(2, 3, 1), (2, 8, 0)], "game_pk long, batter_id long, hit_hr int"),
        boxscores=spark.createDataFrame([(1, 1)], "game_pk long, batter_id long"),
        known_games=spark.createDataFrame([(1,)], "game_pk long"),
        resolved_through=F.lit(day(-1)),
    )
    got = {r.pick_id: (r.result_label, r.actual_hit_hr) for r in out.collect()}
    assert got == {
        "hit": ("HR", 1),
        "miss": ("No HR", 0),
        "data": ("HR", 1),
        "rain": ("Postponed", None),
        "lag": ("Pending", None),
        "future": ("Pending", None),
        "undated": ("HR", 1),
        "moved": ("No HR", 0),
    }


def test_settlement_takes_the_schedule_where_it_knows_the_game(spark):
    picks = spark.createDataFrame(
        [("a", 1, day(), 1, "Pending", None, "pregame", "Scheduled"), ("b", 2, day(), 2, "Pending", None, "pregame", "Scheduled")],
        "pick_id string, game_pk long, game_date date, batter_id long, result_label string, actual_hit_hr int, game_state string, game_status string",
    )
    none = spark.createDataFrame([], "game_pk long, batter_id long, hit_hr int")
    out = B.settle(
        picks,
        outcomes=none,
        boxscores=none,
        known_games=none,
        resolved_through=F.lit(day(1)),
        games=spark.createDataFrame([(1, "final", "Final"), (2, "final", "Postponed")], "game_pk long, game_state string, game_status string"),
    )
    assert {(r.pick_id, r.result_label, r.game_status) for r in out.collect()} == {("a", "No HR", "Final"), ("b", "Postponed", "Postponed")}


def test_archive_needs_final_games_and_terminal_rows(spark):
    rows = spark.createDataFrame([(day(), "HR"), (day(), "Pending"), (day(1), "HR"), (day(2), "No HR"), (day(3), "HR")], "game_date date, result_label string")
    games = spark.createDataFrame([(day(), "final"), (day(1), "live"), (day(2), "final")], "game_date date, game_state string")
    got = {r.game_date: r.archived for r in B.archive_dates(rows, games).collect()}
    assert got == {day(): False, day(1): False, day(2): True, day(3): True}


def test_freshness(spark):
    def gate(data, model):
        row = spark.range(1).select(*[c.alias(n) for n, c in B.freshness_gate(F.lit(DAY), F.lit(data).cast("date"), F.lit(model).cast("date")).items()]).first()
        return row

    assert gate(day(-7), day(-3))["passed"]
    assert not gate(day(-7), None)["passed"]
    with pytest.raises(ValueError, match="stale"):
        B.assert_fresh(gate(day(-8), day(-1)))


def test_canonical_record_fills_defaults(spark):
    row = B.canonical_record(spark.createDataFrame([("p", "7", "0", "")], "pick_id string, game_pk string, rank string, confidence_tier string")).first()
    assert list(row.asDict()) == list(B.PICK_CONTRACT)
    assert (row.game_pk, row.rank, row.confidence_tier, row.batter_name, row.batting_order) == (7, 999, "watch", "Unknown hitter", None)


LINEUP = "game_pk long, game_date date, batter_id long, batter_name string, team string, pa_count int, form double"


def lineup_history(spark):
    rows = []
    for g, back in enumerate((30, 8, 6, 4, 2)):
        rows += [(g, day(-back), 10, "Ten", "A", 4, 0.1), (g, day(-back), 11, "Eleven", "A", 4, 0.2)]
    rows += [(0, day(-30), 12, "Twelve", "A", 4, 0.9), (9, day(-200), 20, "Twenty", "B", 4, 0.1), (8, day(-300), 30, "Thirty", "C", 4, 0.1), (50, day(), 13, "Today", "A", 4, 0.1)]
    return spark.createDataFrame(rows, LINEUP)


def ids(df):
    return [(r.team, r.batter_id) for r in df.orderBy("team", "projected_lineup_rank").collect()]


def test_lineups_follow_recent_games_and_opening_day_fallback(spark):
    out = L.probable_lineups(lineup_history(spark), target=F.lit(DAY), forms=["form"])
    assert ids(out) == [("A", 11), ("A", 10), ("B", 20)]


def test_lineup_filters_do_not_backfill(spark):
    projected = spark.createDataFrame([("A", 10, "Listed Ten", 3), ("A", 99, "New", 1)], "team string, batter_id long, batter_name string, batting_order int")
    out = L.probable_lineups(lineup_history(spark), target=F.lit(DAY), forms=["form"], projected=projected)
    row = out.where("team = 'A'").collect()
    assert [(r.batter_id, r.batter_name, r.batting_order, r.lineup_source) for r in row] == [(10, "Listed Ten", 3, "confirmed")]
    roster = spark.createDataFrame([("A", 11, "Roster Eleven")], "team string, batter_id long, batter_name string")
    out = L.probable_lineups(lineup_history(spark), target=F.lit(DAY), forms=["form"], roster=roster)
    assert [(r.team, r.batter_name, r.lineup_source) for r in out.collect()] == [("A", "Roster Eleven", "projected")]


def test_tier_tables(spark):
    df = spark.createDataFrame([("elite", 1, 0.3), ("elite", 0, 0.2), ("odd", 0, None), (None, 1, 0.1)], "t string, y int, p double")
    rows = B.tier_summary(df, tier="t", outcome="y", probability="p").collect()
    assert [(r.confidence_tier, r.picks, r.homers) for r in rows] == [("elite", 2, 1), ("watch", 1, 1), ("odd", 1, 0)]
    got = {r.confidence_tier: (r.sample_size, r.precision) for r in B.tier_evaluation(df, tier="t", outcome="y").collect()}
    assert got == {"elite": (2, 0.5), "strong": (0, 0.0), "watch": (0, 0.0), "longshot": (0, 0.0)}
