import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foretrace.catalog import FEATURES, PROFILES
from foretrace.functions import fixed_values as fv
from foretrace.functions import scalar as S
from foretrace.functions import text as X
from foretrace.operators import joins as J
from foretrace.operators import names as N
from foretrace.operators import quality as Q
from foretrace.operators import rollup as R
from foretrace.sources import readers, writers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(v, kind):
    return F.lit(v).cast(kind)


@pytest.mark.parametrize(
    "ev, la, want", [(98.0, 26.0, 1), (98.0, 25.9, 0), (100.0, 31.0, 1), (97.9, 28.0, 0), (None, 28.0, 0), (99.0, None, 0)]
)
def test_barrel(spark, ev, la, want):
    assert one(spark, S.is_barrel(lit(ev, "double"), lit(la, "double"))) == want


def test_scalars(spark):
    assert one(spark, S.safe_rate(lit(3, "int"), lit(0, "int"))) is None
    assert one(spark, S.safe_rate(lit(3, "int"), lit(None, "int"))) is None
    assert one(spark, S.spray_angle(F.lit("140.5"), F.lit("100"))) == pytest.approx(8.721, abs=0.01)
    assert one(spark, S.spray_angle(F.lit("x"), F.lit("100"))) is None
    assert one(spark, S.flag(lit(None, "int") > 3)) == 0
    assert one(spark, S.bucket_of(F.lit("ff"), fv.COARSE_BUCKETS)) == "fastball"
    assert one(spark, S.bucket_of(F.lit("ZZ"), fv.GRANULAR_BUCKETS)) is None
    assert one(spark, S.slot_to_pa(lit(1, "int"))) == pytest.approx(4.65)
    assert one(spark, S.slot_to_pa(lit(None, "int"))) is None
    assert one(spark, S.pa_to_slot(lit(17.0, "double"))) == 1.0
    assert one(spark, S.confirmation_score(lit(2, "int"), lit(None, "double"))) == pytest.approx(0.35 + 0.65 * 0.5)
    assert one(spark, S.confirmation_score(lit(None, "int"), lit(0.0, "double"))) == 0.35
    assert one(spark, S.confirmation_score(lit(0, "int"), lit(0.0, "double"), F.lit(" Confirmed "))) == 1.0
    assert one(spark, S.projected_score(F.lit("projected"), F.lit(True))) == 0.75
    assert one(spark, S.platoon_advantage(F.lit("L"), lit(None, "string"))) is None
    assert one(spark, S.starter_proxy(lit(None, "int"))) == "bullpen_like"
    assert one(spark, S.by_hand(lit(None, "string"), F.lit(1), F.lit(2))) == 2
    assert one(spark, S.json_safe(F.lit(float("nan")))) is None
    assert one(spark, S.relative_sector(lit(180, "double"), lit(0, "double"))) == "↑"
    assert one(spark, S.relative_sector(lit(337.4, "double"), lit(180, "double"))) == "↖"
    assert one(spark, S.relative_sector(lit(None, "double"), lit(0, "double"))) == ""
    assert one(spark, S.weather_label(F.lit("95"))) == "Storm" and one(spark, S.weather_label(F.lit("x"))) == "Unknown"
    assert one(spark, S.tier_value(F.lit(" Elite "))) == 3 and one(spark, S.tier_value(lit(None, "string"))) == -1


def test_text(spark):
    assert one(spark, X.subject_name(F.lit("José Ramírez homers (3) on a fly ball"))) == "José Ramírez"
    assert one(spark, X.subject_name(F.lit("Pitcher X intentionally walks Al Simmons."))) == "Al Simmons"
    assert one(spark, X.subject_name(F.lit("Coaching visit"))) is None
    assert one(spark, X.canonical_name(F.lit("  Al   Simmons bunt "))) == "Al Simmons"
    assert one(spark, X.canonical_name(F.lit("  "))) is None
    assert one(spark, X.team_code(F.lit(" chw "))) == "CWS" and one(spark, X.team_code(lit(None, "string"))) == ""
    assert one(spark, X.team_venue_key(F.lit("w.s.h"))) == "WSN" and one(spark, X.team_venue_key(F.lit("007"))) == "7"
    assert one(spark, X.venue_key(F.lit(" T-Mobile   Park "))) == "tmobile park"
    ids = [one(spark, X.pick_id(F.lit("2024-04-01"), lit(g, "long"), lit(5, "long"), F.lit("n"), lit(None, "long"), F.lit("Jim Doe"))) for g in (1, 2, None)]
    assert ids == ["2024-04-01:1:5:jim-doe", "2024-04-01:2:5:jim-doe", "2024-04-01:5:jim-doe"]
    assert [one(spark, X.result_label(F.lit(w))) for w in ("Success", "no_hr", "PPD", "?")] == ["HR", "No HR", "Postponed", "Pending"]
    now = F.lit("2024-04-01 12:00:00").cast("timestamp")
    state = [one(spark, X.game_state(F.lit(s), F.lit(t).cast("timestamp"), now)) for s, t in (("Game Over", None), ("Umpire review", None), ("", "2024-04-01 11:00:00"), ("Scheduled", None))]
    assert state == ["final", "live", "live", "pregame"]
    assert one(spark, X.to_int(F.lit("x"))) is None and one(spark, X.to_float(F.lit("NaN"))) is None
    assert one(spark, X.to_day(F.lit("2024-02-30"))) is None


def test_names_come_from_the_first_source_that_knows(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,), (None,)], "batter_id long")
    play = spark.createDataFrame([(1, "Ann"), (1, "Bea"), (1, "Bea"), (2, "batter_2"), (2, " ")], "batter_id long, batter_name string")
    people = spark.createDataFrame([(1, "No"), (2, "Cy")], "batter_id long, batter_name string")
    got = {r.batter_id: (r.batter_name, r.name_source) for r in N.resolve(ids, entity="batter_id", sources=[("play", play), ("people", people)]).collect()}
    assert got == {1: ("Bea", "play"), 2: ("Cy", "people"), 3: ("batter_3", "placeholder")}


def test_audited_join_checks_cardinality(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k int, l string")
    right = spark.createDataFrame([(1, "x"), (2, "y")], "k int, r string")
    assert J.audited_join(left, right, on=["k"]).count() == 3
    nulls = spark.createDataFrame([(1, "x"), (None, "z")], "k int, r string")
    got = {(r.l, r.r) for r in J.audited_join(left, nulls, on=["k"], null_safe=True).collect()}
    assert got == {("a", "x"), ("b", "x"), ("c", "z")}
    with pytest.raises(ValueError, match="left side"):
        J.audited_join(left, right, on=["k"], validate="one_to_one")
    audit = J.join_audit(left, right, on=["k"], tracked=["r"]).first()
    assert (audit.left_rows, audit.left_duplicates, audit.matched_rows, audit.unmatched_rows, audit.output_rows, audit.non_null_r) == (3, 1, 2, 1, 3, 2)


def test_nearest_hour_and_fallback(spark):
    d = datetime.date(2024, 4, 1)
    schedule = spark.createDataFrame([(d, "A"), (d, "B")], "game_date date, home_team string")
    seen = spark.createDataFrame([(d, "A", 17, 60.0), (d, "A", 21, 50.0), (d, "A", 3, 10.0)], "game_date date, home_team string, hour int, temp double")
    got = {r.home_team: (r.hour, r.temp, r.missing) for r in J.nearest_hour(schedule, seen, on=["game_date", "home_team"], hour="hour", values=["temp"]).collect()}
    assert got == {"A": (17, 60.0, 0), "B": (None, None, 1)}
    cached = spark.createDataFrame([("B", 72.0)], "home_team string, temp double")
    fresh = spark.createDataFrame([("A", 60.0), ("B", None), ("C", None)], "home_team string, temp double")
    got = {r.home_team: (r.source, r.temp) for r in J.fallback_fill(fresh, cached, on=["home_team"], values=["temp"]).collect()}
    assert got == {"A": ("fresh", 60.0), "B": ("cached", 72.0), "C": ("null", None)}


def test_outer_combine(spark):
    a = spark.createDataFrame([(1, 5)], "k int, n int")
    b = spark.createDataFrame([(1, 6), (2, 7)], "k int, n int")
    got = {r.k: (r.n_a, r.n_b) for r in J.outer_combine({"a": a, "b": b}, on=["k"], measures=["n"]).collect()}
    assert got == {1: (5, 6), 2: (None, 7)}


def test_capped_dense_rank(spark):
    df = spark.createDataFrame([("g", v) for v in [5, 5, 1, 9, 7, None]], "g string, v int")
    got = sorted(((r.v, r.r) for r in R.capped_dense_rank(df, keys=["g"], value="v", cap=3, name="r").collect()), key=str)
    assert got == [(1, 1), (5, 2), (5, 2), (7, 3), (9, 3), (None, None)]


def test_quality_reports(spark):
    df = spark.createDataFrame([(1, 1.0, None), (1, None, None), (2, 3.0, None)], "id int, a double, b double")
    rows = {r.feature: (r.present, r.non_null, r.status) for r in Q.coverage(df, ["a", "b", "c"], warn=0.3).collect()}
    assert rows == {"a": (True, 2, "warn"), "b": (True, 0, "all null"), "c": (False, 0, "missing")}
    with pytest.raises(ValueError, match="b.*c"):
        Q.require_coverage(Q.coverage(df, ["a", "b", "c"]))
    with pytest.raises(ValueError, match="duplicate"):
        Q.require_events(df, required=["id"], keys=["id"])
    with pytest.raises(ValueError, match="missing required"):
        Q.require_events(df, required=["zz"], keys=["id"])
    with pytest.raises(ValueError, match="empty"):
        Q.require_events(df.limit(0), required=["id"], keys=["id"])
    empty = Q.coverage(df.limit(0), ["a"]).first()
    assert (empty.non_null, empty.null_rate, empty.status) == (0, None, "all null")


def test_catalog_is_consistent():
    assert len(FEATURES) > 90
    assert FEATURES["hr_per_pa_last_30d"].family == "batter_trailing"
    assert not FEATURES["starter_or_bullpen_proxy"].point_in_time
    assert {k: len(v) for k, v in PROFILES.items() if k in ("stable", "live", "live_plus", "live_shrunk", "live_shrunk_precise")} == {
        "stable": 28, "live": 19, "live_plus": 27, "live_shrunk": 32, "live_shrunk_precise": 30,
    }
    assert all(len(set(v)) == len(v) for v in PROFILES.values())
    expanded = set(PROFILES["expanded"])
    assert set(PROFILES["live_plus"]) | set(PROFILES["live_shrunk"]) | set(PROFILES["live_shrunk_precise"]) <= expanded
    assert {"pitcher_slider_pct", "split_matchup_hr", "pressure_hpa"} <= expanded
    # the stable profile's own columns are no part of the expanded one
    assert not {"barrel_rate_last_50_bbe", "pitcher_hr9_season_to_date", "expected_pa_proxy", "days_since_last_game"} & expanded
    assert PROFILES["live_usable_candidate_v1"] == (*PROFILES["live_shrunk"], *PROFILES["opportunity"])


def test_local_time_follows_clock_changes(spark):
    zone = F.lit("America/New_York")

    def at(text, fn):
        return one(spark, fn(F.lit(text).cast("timestamp"), zone).cast("string"))

    assert at("2024-07-01 23:00:00", S.local_hour) == "19" and at("2024-01-01 23:00:00", S.local_hour) == "18"
    assert at("2024-07-02 02:00:00", S.local_day) == "2024-07-01"
    assert at("2024-07-01 19:00:00", S.local_to_utc) == "2024-07-01 23:00:00"
    assert at("2024-03-10 02:30:00", S.local_to_utc) == "2024-03-10 07:30:00"
    assert at("2024-11-03 01:30:00", S.local_to_utc) == "2024-11-03 06:30:00"


def test_park_dimension(spark, tmp_path):
    (tmp_path / "parks.csv").write_text(
        "team,ballpark,region_abbr,field_bearing_deg,lat,lon,tz\nAA,First Field,X,20.5,1.0,-2.0,America/Phoenix\nBB,Second Park,Y,,3.0,4.0,UTC\n"
    )
    parks = readers.read_parks(spark, str(tmp_path / "parks.csv"))
    assert [(r.team, r.field_bearing_deg, r.tz) for r in parks.orderBy("team").collect()] == [("AA", 20.5, "America/Phoenix"), ("BB", None, "UTC")]
    games = spark.createDataFrame([("AA", "BB", 1), ("AA", "BB", 0)], "team string, opponent string, is_home int")
    rows = parks.select(F.col("team").alias("park_team"), "ballpark")
    found = R.park_of(games, rows, team="team", opponent="opponent", is_home="is_home", key="park_team").collect()
    assert {r.ballpark for r in found} == {"First Field", "Second Park"}


def test_records_as_lines_and_as_arrays(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "x.json").write_text('{"a": 1}\n{"a": 2, "b": "y"}\n{"a": 3}\n')
    (tmp_path / "arrays").mkdir()
    (tmp_path / "arrays" / "x.json").write_text('[{"a": 1},\n {"a": 2, "b": "y"}]')
    lines = readers.read_records(spark, str(tmp_path / "lines"), schema).collect()
    assert sorted((r.a, r.b or "") for r in lines) == [(1, ""), (2, "y"), (3, "")]
    arrays = readers.read_records(spark, str(tmp_path / "arrays"), schema, arrays=True).collect()
    assert sorted((r.a, r.b or "") for r in arrays) == [(1, ""), (2, "y")]
    assert readers.read_records(spark, str(tmp_path / "none"), schema).count() == 0


def test_reason_rules():
    from foretrace.operators import reasons as N2

    assert N2.reason_weights({"a": -1.0}, ["a", "b_shrunk"]) == {"a": 1.0, "b": 1.0}
    assert N2.reason_weights({"a": 0.5, "a_shrunk": 0.7, "b": -1.0}, ["a", "a_shrunk", "b"]) == {"a": 0.7}
    rules = N2.rules_for({"pitcher_x_rate": 1.0, "platoon_advantage": 1.0, "hr_per_pa_last_10d": 2.0})
    assert [r.bucket for r in rules.values()] == ["pitcher", "context", "batter"] and rules["platoon_advantage"].binary


def test_sources(spark, tmp_path):
    schema = "a int, b string"
    from pyspark.sql import types as T

    struct = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    assert readers.read_records(spark, str(tmp_path / "none"), struct).count() == 0
    (tmp_path / "r.json").write_text('[{"a": 1, "b": "x"}, {"a": 2}]')
    assert [(r.a, r.b) for r in readers.read_records(spark, str(tmp_path / "r.json"), struct).orderBy("a").collect()] == [(1, "x"), (2, None)]
    with pytest.raises(ValueError, match="missing required columns"):
        readers.project_required(spark.createDataFrame([(1, "x")], schema), ["a", "zz"])
    root = str(tmp_path / "v")
    df = spark.createDataFrame([(1, "x")], schema)
    assert writers.write_version(df, root) == 1 and writers.write_version(df.union(df), root) == 2
    assert writers.read_version(spark, root).count() == 2 and writers.read_version(spark, root, version=1).count() == 1
    with pytest.raises(FileNotFoundError):
        writers.current_version(spark, str(tmp_path / "w"))


def test_intermediate_tables_have_an_owner(spark, tmp_path):
    from foretrace import session

    context = spark.sparkContext
    before = context.getCheckpointDir()
    context.setCheckpointDir(str(tmp_path))
    session.cut_lineage(spark.range(3)).count()
    folder = tmp_path / context.getCheckpointDir().rstrip("/").split("/")[-1]
    assert list(folder.iterdir())
    session.clean_up(spark)
    assert not list(folder.iterdir())
    context.setCheckpointDir(str(before or tmp_path))


def test_no_folder_is_made_up(monkeypatch):
    from types import SimpleNamespace

    from foretrace import session

    bare = SimpleNamespace(sparkContext=SimpleNamespace(getCheckpointDir=lambda: None), conf=SimpleNamespace(get=lambda *_: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(bare)


def test_datasets_are_dealt_by_date(spark, tmp_path):
    from foretrace.sources.writers import write_dataset

    df = spark.range(200).selectExpr("date_add(date'2024-01-01', cast(id % 3 as int)) AS game_date", "id").repartition(8)
    write_dataset(df, str(tmp_path / "d"), files=2)
    days = [p for p in (tmp_path / "d").iterdir() if p.name.startswith("game_date=")]
    assert len(days) == 3 and all(1 <= len(list(d.glob("*.parquet"))) <= 2 for d in days)
    assert spark.read.parquet(str(tmp_path / "d")).count() == 200
