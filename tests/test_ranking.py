import random

import pandas as pd
import pytest

from foretrace.operators import ranking as K


@pytest.mark.parametrize("seed", range(3))
def test_greedy_caps_equal_the_plain_walk_with_doubleheaders(spark, seed):
    rng = random.Random(seed)
    rows = []
    for slate in ("a", "b"):
        for i in range(150):
            team = 0 if rng.random() < 0.34 else rng.randrange(8)
            rows.append((slate, team, team // 2 * 2 + rng.randrange(2), rng.choice([0.1, 0.2, 0.3, 0.4]), i))
    df = spark.createDataFrame(rows, "slate string, team int, game int, score double, id int")
    caps = {"team_cap": 3, "game_cap": 4, "limit": 12}
    got = {(r.slate, r.id, r.board_rank) for r in K.greedy_caps(df, slate="slate", team="team", game="game", score="score", tie="id", **caps).collect()}
    want = set()
    for slate in ("a", "b"):
        teams, games, taken = {}, {}, 0
        for _, team, game, _, i in sorted((r for r in rows if r[0] == slate), key=lambda r: (-r[3], r[4])):
            if taken < 12 and teams.get(team, 0) < 3 and games.get(game, 0) < 4:
                taken += 1
                teams[team], games[game] = teams.get(team, 0) + 1, games.get(game, 0) + 1
                want.add((slate, i, taken))
    assert got == want


def test_percentile_is_position_over_count(spark):
    df = spark.createDataFrame([("d", 0.5, 1), ("d", 0.5, 2), ("d", 0.1, 3), ("d", 0.9, 4)], "slate string, score double, id int")
    got = {r.id: (r.slate_rank, r.slate_percentile) for r in K.slate_percentile(df, slate="slate", score="score", tie="id").collect()}
    assert got == {1: (2, 0.5), 2: (3, 0.75), 3: (4, 0.25), 4: (1, 1.0)}


def test_rerank_puts_unknown_scores_last(spark):
    df = spark.createDataFrame(
        [("d", None, 0.9, "a", 1), ("d", 50.0, 0.1, "b", 2), ("d", 50.0, 0.2, "c", 3), ("d", -1.0, None, "d", 4)],
        "slate string, score double, prob double, name string, id int",
    )
    out = K.rerank(df, slate=["slate"], score="score", probability="prob", name="name", tie="id")
    assert [r.id for r in out.orderBy("rank").collect()] == [3, 2, 4, 1]


def test_select_greedy_helper():
    rows = pd.DataFrame({"t": [1, 1, 1, 2], "g": [1, 1, 1, 1]})
    assert K.select_greedy(rows, team="t", game="g", team_cap=2, game_cap=3, limit=9) == [True, True, False, True]


def test_topk_keeps_the_rank(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a", i) for i in range(20)], "k string, v int")
    assert [r.v for r in K.topk(df, keys=["k"], order=[F.desc("v")], k=3, name="r").orderBy("r").collect()] == [19, 18, 17]


@pytest.mark.parametrize("caps", [{"team_cap": 2, "game_cap": 2, "limit": 50}, {"team_cap": None, "game_cap": 3, "limit": 9}, {"team_cap": 2, "game_cap": None, "limit": 7}, {"team_cap": None, "game_cap": None, "limit": 5}])
def test_unknown_keys_and_missing_caps_hold_nothing_back(spark, caps):
    rng = random.Random(5)
    rows = [("s", rng.choice([None, "", "A", "B", "C"]), rng.choice([None, 1, 2, 3]), rng.choice([0.5, 0.6, None]), rng.random(), f"n{rng.randrange(3)}", i) for i in range(120)]
    df = spark.createDataFrame(rows, "slate string, team string, game int, score double, prob double, name string, id int")
    spec = {"slate": "slate", "team": "team", "game": "game", "score": "score", "tie": "id", "probability": "prob", "name": "name"}
    got = [r.id for r in K.greedy_caps(df, **spec, **caps).orderBy("board_rank").collect()]
    teams, games, want = {}, {}, []
    for _, team, game, _, _, _, i in sorted(rows, key=lambda r: (-(r[3] if r[3] is not None else -9), -r[4], r[5], r[6])):
        free = len(want) < caps["limit"]
        free &= not team or caps["team_cap"] is None or teams.get(team, 0) < caps["team_cap"]
        free &= game is None or caps["game_cap"] is None or games.get(game, 0) < caps["game_cap"]
        if free:
            want.append(i)
            teams[team], games[game] = teams.get(team, 0) + 1, games.get(game, 0) + 1
    assert got == want


def test_nested_caps_leave_unknown_keys(spark):
    rows = [("s", None, None, 0.1 * i, i) for i in range(6)] + [("s", "A", 1, 1.0 + i, 10 + i) for i in range(6)]
    df = spark.createDataFrame(rows, "slate string, team string, game int, score double, id int")
    spec = {"slate": "slate", "team": "team", "game": "game", "score": "score", "tie": "id", "team_cap": 2, "game_cap": 3, "limit": 99}
    assert {r.id for r in K.nested_caps(df, **spec).collect()} == {0, 1, 2, 3, 4, 5, 14, 15}
    assert {r.id for r in K.greedy_caps(df, **spec).collect()} == {0, 1, 2, 3, 4, 5, 14, 15}


def test_rerank_splits_rows_that_agree(spark):
    df = spark.range(3000).selectExpr("1 AS s", "CAST(NULL AS DOUBLE) AS score", "CAST(NULL AS DOUBLE) AS prob", "'x' AS name", "xxhash64(id) AS tie")
    out = K.rerank(df, slate=["s"], score="score", probability="prob", name="name", tie="tie").orderBy("tie").collect()
    assert [r["rank"] for r in out] == list(range(1, 3001))
