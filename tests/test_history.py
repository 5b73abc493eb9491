"""History operators against plain loops over random tables, with a hot entity, ties of days and zero counts."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from foretrace.operators import history as H
from foretrace.operators.scan import border_blocks, positions, prior_sums

DAY0 = datetime.date(2024, 1, 1)


def games(seed, n=160, entities=5):
    """Random entity-games: entity 0 holds a third of the rows; several games a day; some without units."""
    rng = random.Random(seed)
    rows = []
    for game in range(n):
        entity = 0 if rng.random() < 0.34 else rng.randrange(1, entities)
        day = rng.randrange(60)
        rows.append((entity, DAY0 + datetime.timedelta(days=day), day * 1000 + game, rng.choice([0, 0, 1, 2, 5, 30]), rng.randrange(4), rng.random()))
    return rows


SCHEMA = "entity long, day date, game long, units long, hits long, speed double"


def by_entity(rows):
    out = {}
    for row in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(row[0], []).append(row)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_day_windows_exclude_today_and_include_the_left_edge(spark, seed):
    rows = games(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {
        (r.entity, r.game): (r.hits_last_7d, r.speed_last_7d)
        for r in H.attach_trailing(df, keys=["entity"], date="day", days=[7], sums={"hits": "hits"}, maxes={"speed": "speed"}).collect()
    }
    for entity, history in by_entity(rows).items():
        for row in history:
            window = [r for r in history if 1 <= (row[1] - r[1]).days <= 7]
            want = (sum(r[4] for r in window), max(r[5] for r in window)) if window else (None, None)
            assert got[(entity, row[2])] == pytest.approx(want) if window else got[(entity, row[2])] == want


@pytest.mark.parametrize("blocks", [["day"], ["week", "day"]])
def test_to_date_sees_earlier_games_of_the_day(spark, blocks):
    rows = games(3)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("week", F.weekofyear("day"))
    out = H.to_date(df, keys=["entity"], date="day", order=["game"], sums={"before": "hits"}, blocks=blocks)
    got = {(r.entity, r.game): r.before for r in out.collect()}
    for entity, history in by_entity(rows).items():
        for i, row in enumerate(history):
            assert got[(entity, row[2])] == (sum(r[4] for r in history[:i]) if i else None)


def test_previous_row_and_lagged_spread(spark):
    rows = games(4)
    df = spark.createDataFrame(rows, SCHEMA)
    out = H.previous_row(df, keys=["entity"], date="day", order=["game"], values={"last_day": "day", "last_units": "units"})
    got = {(r.entity, r.game): (r.last_day, r.last_units) for r in out.collect()}
    spread = H.lagged_spread(df, keys=["entity"], date="day", order=["game"], value="units", days=30, prefix="u")
    spreads = {(r.entity, r.game): (r.u_count_30d, r.u_std_30d) for r in spread.collect()}
    for entity, history in by_entity(rows).items():
        lagged = [None] + [r[3] for r in history[:-1]]
        for i, row in enumerate(history):
            assert got[(entity, row[2])] == ((history[i - 1][1], history[i - 1][3]) if i else (None, None))
            inside = [v for r, v in zip(history, lagged) if 1 <= (row[1] - r[1]).days <= 30]
            values = [v for v in inside if v is not None]
            mean = sum(values) / len(values) if values else 0
            std = (sum((v - mean) ** 2 for v in values) / (len(values) - 1)) ** 0.5 if len(values) > 1 else 0.0
            count, got_std = spreads[(entity, row[2])]
            assert count == (len(values) if inside else None)
            assert got_std == pytest.approx(std, abs=1e-9)


@pytest.mark.parametrize("span", [1, 7, 4096])
def test_count_window_takes_a_fraction_of_the_oldest_row(spark, span):
    rows = games(5)
    df = spark.createDataFrame(rows, SCHEMA)
    out = H.count_window(
        df, keys=["entity"], date="day", order=["game"], count="units", numerators={"rate": "hits", "mean": F.col("speed") * F.col("units")}, size=50, span=span, units_name="used"
    )
    got = {(r.entity, r.game): (r["used"], r["rate"], r["mean"]) for r in out.collect()}
    for entity, history in by_entity(rows).items():
        for i, row in enumerate(history):
            left, hits, speed, used = 50.0, 0.0, 0.0, 0.0
            for r in reversed(history[:i]):
                if left <= 0:
                    break
                if r[3] > 0:
                    take = min(r[3], left)
                    used, left = used + take, left - take
                    hits += r[4] * take / r[3]
                    speed += r[5] * r[3] * take / r[3]
            units, rate, mean = got[(entity, row[2])]
            if used:
                assert units == used and rate == pytest.approx(hits / used) and mean == pytest.approx(speed / used)
            else:
                assert units is None and rate is None and mean is None


def test_rows_without_entity_have_no_history(spark):
    df = spark.createDataFrame([(None, DAY0, 1, 1, 1, 1.0), (1, DAY0, 2, 1, 1, 1.0), (1, DAY0, 3, 1, 1, None)], SCHEMA)
    out = {r.game: r.before for r in H.to_date(df, keys=["entity"], date="day", order=["game"], sums={"before": "hits"}).collect()}
    assert out == {1: None, 2: None, 3: 1}
    assert H.attach_trailing(df, keys=["entity"], date="day", days=[7], sums={"h": "hits"}).where("h_last_7d is not null").count() == 0


def test_blocked_positions_equal_row_numbers(spark):
    rows = [(k, random.Random(k * 7 + i).choice([0.1, 0.2, 5.0, -3.0]), i) for k in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, v double, i int")
    blocked, blocks = border_blocks(df, "v", keys=["k"], name="v")
    got = {(r.k, r.i): r.pos for r in positions(blocked, keys=["k"], blocks=blocks, order=["v", "i"], name="pos").collect()}
    for k in range(3):
        for place, (_, _, i) in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])), 1):
            assert got[(k, i)] == place


def test_prior_sums_without_keys(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, 7), (2, 1, 11)], "b int, o int, v int")
    out = prior_sums(df, keys=[], blocks=["b"], order=["o"], sums={"s": "v"})
    assert sorted((r.b, r.o, r.s) for r in out.collect()) == [(1, 1, 0), (1, 2, 5), (2, 1, 12)]


def test_latest_known_value(spark):
    df = spark.createDataFrame([(1, DAY0, 1, 3, None, 1.0), (1, DAY0, 2, None, None, 2.0)], SCHEMA)
    row = H.latest_non_null(df, keys=["entity"], order=["day", "game"], columns=["units", "hits", "speed"]).first()
    assert (row.units, row.hits, row.speed) == (3, None, 2.0)


@pytest.mark.parametrize("kind", ["outlier", "nan", "constant", "hashed", "text", "null"])
def test_blocks_stay_balanced(spark, kind):
    n = 20_000
    value = {
        "outlier": "CASE WHEN id = 7 THEN 1e12 ELSE (hash(id) % 100000) / 1e5 END",
        "nan": "CASE WHEN id % 2 = 0 THEN double('NaN') ELSE rand(1) END",
        "constant": "5.0",
        "hashed": "xxhash64(id)",
        "text": "concat('2024-01-01:', lpad(cast(hash(id) as string), 12, ' '))",
        "null": "CASE WHEN id % 2 = 0 THEN xxhash64(id) END",
    }[kind]
    df = spark.range(n).selectExpr("1 AS k", f"{value} AS v")
    blocked, blocks = border_blocks(df, "v", keys=["k"], name="v", borders=256)
    sizes = [r["count"] for r in blocked.where("v is not null").groupBy(*blocks).count().collect()]
    if kind == "constant":
        assert sizes == [n]  # one value is one block: ties are split by their tie key
    elif kind == "nan":
        assert sorted(sizes)[-2] < 600 and sorted(sizes)[-1] <= n // 2 + 600
    else:
        assert max(sizes) < 1200
    ordered = blocked.where("v is not null").groupBy(*blocks).agg(F.min("v").alias("a"), F.max("v").alias("b")).orderBy(*blocks).collect()
    assert all(x.b <= y.a or x.b != x.b or y.a != y.a for x, y in zip(ordered, ordered[1:]))


def test_blocks_without_keys_or_rows(spark):
    df = spark.createDataFrame([(3,), (1,), (None,)], "v int")
    blocked, blocks = border_blocks(df, "v", keys=[], name="v")
    assert [r.v for r in blocked.where("v is not null").orderBy(*blocks).collect()] == [1, 3]
    assert border_blocks(df.limit(0), "v", keys=[], name="v")[0].count() == 0


def test_previous_row_in_finer_blocks(spark):
    rows = [(1 + (i % 5 == 0), datetime.date(2024, 1, 1 + i // 30), i) for i in range(90)]
    df = spark.createDataFrame(rows, "k int, d date, i int")
    blocked, blocks = border_blocks(df, "i", keys=[], name="i", borders=8)
    got = {r.i: r.p for r in H.previous_row(blocked, keys=["k"], date="d", order=["i"], values={"p": "i"}, blocks=["d", *blocks]).collect()}
    last, want = {}, {}
    for k, _, i in rows:
        want[i], last[k] = last.get(k), i
    assert got == want


def test_totals_come_from_the_table_of_days(spark):
    day = datetime.date(2024, 5, 1)
    rows = [(1, day, 1, 2), (1, day, 2, 3), (1, day + datetime.timedelta(3), 3, 5), (1, None, 0, 7), (2, day, 1, None), (2, day, 4, 1), (None, day, 9, 4)]
    df = spark.createDataFrame(rows, "entity int, day date, game int, n int")
    spec = {"keys": ["entity"], "date": "day"}
    apart = H.to_date(H.attach_trailing(df, **spec, days=[2, 5], sums={"n": "n"}), **spec, order=["game"], sums={"t": "n", "rows": F.lit(1)})
    once = H.attach_trailing(df, **spec, days=[2, 5], sums={"n": "n"}, order=["game"], totals={"t": "n", "rows": F.lit(1)})
    assert sorted(map(str, once.select(*apart.columns).collect())) == sorted(map(str, apart.collect()))
    assert {r["game"]: r["t"] for r in once.where("entity = 1").collect()} == {0: None, 1: 7, 2: 9, 3: 12}
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert plan(once) < plan(apart)


def test_latest_known_values_need_no_sort(spark):
    day = datetime.date(2024, 5, 1)
    rows = [(1, day, 1, 1.0, 1), (1, day, 2, None, 2), (1, None, 7, 5.0, 3), (2, None, None, 2.0, None), (2, None, -3, 4.0, None), (3, day, None, 6.0, 8)]
    df = spark.createDataFrame(rows, "entity int, day date, game bigint, a double, b int")
    out = H.latest_non_null(df, keys=["entity"], order=["day", "game"], columns=["a", "b"])
    assert sorted(tuple(r) for r in out.collect()) == [(1, 1.0, 2), (2, 4.0, None), (3, 6.0, 8)]
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
