import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foretrace.streaming import jobs as J

SCHEMA = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType())])


def land(spark, folder, name, rows):
    times = [(i, datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h), u) for i, h, u in rows]
    spark.createDataFrame(times, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def test_duplicates_are_dropped_across_files_and_runs(spark, tmp_path):
    folder, root = str(tmp_path / "in"), str(tmp_path / "out")
    land(spark, folder, "f", [(1, 0, 1), (2, 1, 1), (2, 1, 1)])
    J.ingest(J.read_stream(spark, f"{folder}/f", SCHEMA), root, time="ts", keys=["event_id"])
    land(spark, folder, "f", [(2, 1, 1), (3, 2, 2)])
    J.ingest(J.read_stream(spark, f"{folder}/f", SCHEMA), root, time="ts", keys=["event_id"])
    assert sorted(r.event_id for r in spark.read.parquet(f"{root}/out").collect()) == [1, 2, 3]


def test_running_totals_continue_in_the_next_run(spark, tmp_path):
    folder, root = str(tmp_path / "in"), str(tmp_path / "out")
    spec = {"time": "ts", "entity": "user_id", "delay": "1 hour", "aggregates": {"n": F.count(F.lit(1))}}
    land(spark, folder, "f", [(1, 0, 7), (2, 1, 7), (3, 30, 7), (4, 60, 8)])
    J.prefix(J.read_stream(spark, f"{folder}/f", SCHEMA), root, **spec)
    land(spark, folder, "f", [(5, 61, 7), (6, 100, 8)])
    J.prefix(J.read_stream(spark, f"{folder}/f", SCHEMA), root, **spec)
    rows = spark.read.parquet(f"{root}/out").where("user_id = 7").orderBy("window_start").collect()
    assert [(r.window_start.day, r.n_before) for r in rows] == [(1, 0), (2, 2), (3, 3)]


def test_late_rows_are_counted(spark):
    rows = [(datetime.date(2024, 1, 9), datetime.date(2024, 1, 1)), (datetime.date(2024, 1, 9), datetime.date(2024, 1, 8))]
    df = spark.createDataFrame(rows, "landed date, day date")
    assert J.late_rows(df, time="day", landed=F.col("landed"), delay_days=2).first().late_rows == 1


def test_ingest_counts_what_it_drops(spark, tmp_path):
    folder, root = str(tmp_path / "in"), str(tmp_path / "out")
    land(spark, folder, "f", [(1, 0, 1), (2, 1, 1), (2, 1, 1), (3, 200, 1)])
    first = J.ingest(J.read_stream(spark, f"{folder}/f", SCHEMA), root, time="ts", keys=["event_id"])
    land(spark, folder, "f", [(4, 2, 1), (5, 201, 1)])
    second = J.ingest(J.read_stream(spark, f"{folder}/f", SCHEMA), root, time="ts", keys=["event_id"])
    assert (first["input_rows"], first["duplicate_rows"], first["late_rows"]) == (4, 1, 0)
    assert (second["input_rows"], second["duplicate_rows"], second["late_rows"]) == (2, 0, 1)
    assert sorted(r.event_id for r in spark.read.parquet(f"{root}/out").collect()) == [1, 2, 3, 5]


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 0, 2)])
def test_settlement_does_not_depend_on_batches(spark, tmp_path, order):
    batches = [[(1, 1, 1), (1, 2, 0)], [(1, 1, 0), (1, 3, 0)], [(1, 3, 1), (1, 1, 0)]]
    schema, root = "game_pk long, batter_id long, hit_hr int", str(tmp_path / "s")
    names = [("a", 1, 1, "Pending"), ("b", 1, 2, "Pending"), ("c", 1, 3, "No HR"), ("d", 1, 4, "HR"), ("e", 2, 1, "Postponed")]
    day = datetime.date(2024, 1, 1)
    rows = [(i, g, b, label, None, day if i != "d" else None, "Postponed" if i == "e" else "", "live") for i, g, b, label in names]
    picks = spark.createDataFrame(rows, "pick_id string, game_pk long, batter_id long, result_label string, actual_hit_hr int, game_date date, game_status string, game_state string")
    through = F.lit(day)
    before = {r.pick_id: r.result_label for r in J.settled_board(picks, root, resolved_through=F.date_sub(through, 1)).collect()}
    assert before == {i: label for i, _, _, label in names}
    for i in order:
        spark.createDataFrame(batches[i], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "o"))
        J.settle_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "o")), root)
    got = {r.pick_id: (r.result_label, r.actual_hit_hr) for r in J.settled_board(picks, root, resolved_through=through).collect()}
    assert got == {"a": ("HR", 1), "b": ("No HR", 0), "c": ("HR", 1), "d": ("HR", None), "e": ("Postponed", None)}


def test_old_batches_are_folded_under_a_pointer(spark, tmp_path):
    """50 batches: readers never see more than a few folders, and always the same rows as without folding."""
    folder = str(tmp_path / "out")
    fold = J.newest_by_key(["k"])
    newest, compacted = {}, []
    for number in range(50):
        rows = [(k, number * 100 + k) for k in ({number % 7, number % 5})]
        newest |= dict(rows)
        spark.createDataFrame(rows, "k int, v int").coalesce(1).write.parquet(f"{folder}/batch={number}")
        last = J.compact(spark, folder, fold, keep=6)
        if last is not None:
            compacted.append(last)
            assert J.compact(spark, folder, fold, keep=6) is None
            assert {r.k: r.v for r in J.latest_by_key(spark, str(tmp_path), ["k"]).collect()} == newest
        assert len([n for n in J.batch_numbers(spark, folder) if not compacted or n > compacted[-1]]) <= 7
    assert {r.k: r.v for r in J.latest_by_key(spark, str(tmp_path), ["k"]).collect()} == newest
    assert len(compacted) >= 7 and J.batch_numbers(spark, folder)[0] > compacted[-3]


def test_a_broken_compaction_is_run_again(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "out")
    for number in range(5):
        spark.createDataFrame([(number, 1)], "k int, v int").coalesce(1).write.parquet(f"{folder}/batch={number}")

    def broken(df, root, **kwargs):
        df.write.mode("overwrite").parquet(f"{root}/version={kwargs['version']}")
        raise OSError("lost before the pointer")

    with monkeypatch.context() as m:
        m.setattr(J.writers, "write_version", broken)
        with pytest.raises(OSError):
            J.compact(spark, folder, J.newest_by_key(["k"]), keep=2)
    assert J.streamed(spark, folder).count() == 5
    assert J.compact(spark, folder, J.newest_by_key(["k"]), keep=2) == 3
    assert J.streamed(spark, folder).count() == 5


def test_folded_outcomes_settle_the_same(spark, tmp_path):
    root = str(tmp_path)
    picks = spark.createDataFrame([("a", 1, 1, datetime.date(2024, 1, 1)), ("b", 1, 2, datetime.date(2024, 1, 1))], "pick_id string, game_pk long, batter_id long, game_date date")
    picks = picks.withColumns({"result_label": F.lit("Pending"), "actual_hit_hr": F.lit(None).cast("int"), "game_status": F.lit("Final"), "game_state": F.lit("final")})
    for number, hit in enumerate((0, 1, 0, 0)):
        spark.createDataFrame([(1, 1, hit), (1, 2, 0)], "game_pk long, batter_id long, hit_hr int").coalesce(1).write.parquet(f"{root}/outcomes/batch={number}")
    settled = lambda: sorted((r.pick_id, r.result_label) for r in J.settled_board(picks, root, resolved_through=F.lit("2024-01-02").cast("date")).collect())
    before = settled()
    assert J.compact(spark, f"{root}/outcomes", J.best_outcomes(), keep=2) == 2
    assert settled() == before == [("a", "HR"), ("b", "No HR")]
