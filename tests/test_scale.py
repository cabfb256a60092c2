"""What keeps large inputs off the driver and small searches small, on rows made here."""

import random

from pyspark.sql import functions as F

from snapline.operators import joins
from snapline.plans import lineups, scoring, showdown, simulate

from test_lineups import SHOW


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_tables_that_grow_are_not_sent_through_the_driver(spark):
    feed = spark.createDataFrame(
        [("Ann", "WR", "A", "@ B", 5000, 3.0), ("Ann - CPTN", "CPTN", "A", "@ B", 5000, 3.0)],
        "player string, pos string, team string, opp string, salary int, my_proj double",
    )
    known = spark.createDataFrame(
        [("Ann", "A", "B", "WR", 10.0, None)],
        "name string, team string, opp string, position string, projection double, std_dev double",
    )
    assert "Broadcast" not in plan(showdown.convert_feed(feed, known))
    grid = spark.createDataFrame([(1, "Ann 12", None), (2, "Bob 20", "Ann 12")], "number int, qb string, dst string")
    players = spark.createDataFrame([("Ann", "QB", "A"), ("Bob", "QB", "B")], "player string, pos string, team string")
    read = scoring.read_grid(grid, players)
    assert "Broadcast" not in plan(read)
    draws = spark.createDataFrame([("Ann", "QB", 1, 2.0), ("Bob", "QB", 1, 3.0)], "player string, pos string, sim_num int, sim_proj double")
    assert "Broadcast" not in plan(scoring.grid_scores(draws, read))
    assert "Broadcast" not in plan(scoring.grid_scores_by_draw(draws, read))


def test_scores_by_draw_want_every_member(spark, rows):
    grid = spark.createDataFrame(
        [(1, "a", "QB"), (1, "b", "RB"), (2, "a", "QB"), (2, None, None), (None, "a", "QB"), (3, "a", "QB"), (3, "a", "QB")],
        "number int, player string, pos string",
    )
    draws = spark.createDataFrame(
        [("a", "QB", 1, 1.0), ("a", "QB", 2, 2.0), ("b", "RB", 1, 4.0), ("b", "RB", 2, None), ("b", "RB", 3, 5.0)],
        "player string, pos string, sim_num int, sim_proj double",
    )
    got = rows(scoring.grid_scores_by_draw(draws, grid), "sim_num", "number", "lineup_score")
    assert got == [(1, 1, 5.0), (1, 3, 2.0), (1, None, 1.0), (2, 3, 4.0), (2, None, 2.0)]


def test_few_rows_leave_the_detail_where_it_is(spark, rows, monkeypatch):
    big = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    small = spark.createDataFrame([(0, "x"), (1, "y"), (None, "z")], "k long, v string")
    few = joins.detail_join(big, small, ["k"], ["id"])
    assert "BroadcastHashJoin" in plan(few)
    monkeypatch.setattr(joins, "FEW_ROWS", 2)
    assert rows(joins.detail_join(big, small, ["k"], ["id"])) == rows(few)


def test_means_per_slate_are_made_where_a_player_is_drawn(spark, rows):
    made = [(f"n{i}", f"n{i}{end}", 5000, "AB"[i % 2], "BA"[i % 2], pos, "QB" if i < 2 else "WR", 10.0, 2.0)
            for i in range(6) for pos, end in (("CPTN", " - CPTN"), ("FLEX", ""))]
    made.append((None, None, 5000, "A", "B", "FLEX", "RB", 8.0, 1.0))
    converted = spark.createDataFrame(
        made, "player_id string, player string, salary int, team string, opp string, position string, pos string, fpts_proj double, std_dev double"
    )
    out = showdown.simulate_showdown(converted, 3, 7, 1.0)
    flex = converted.where("position = 'FLEX'").withColumnRenamed("fpts_proj", "projection")
    key = ("player_id", "team", "pos")
    drawn = simulate.draw_scores(showdown.matchup_of(flex), 3, 7, 1.0, simulate.SHOWDOWN_FLOOR, key=key)
    linked = simulate.link_to_passers(drawn, simulate.SHOWDOWN, key=key)
    assert rows(out.where("position = 'FLEX'"), "slate", "player_id", "fpts_proj") == rows(linked, "slate", "player_id", "new_proj")
    assert out.count() == 3 * len(made) and out.where("fpts_proj IS NULL").count() == 0
    assert "(slate" not in plan(out).split("SortMergeJoin", 1)[1].split("\n", 1)[0]


def test_a_team_far_ahead_does_not_swell_the_showdown_search(spark, monkeypatch):
    random.seed(5)
    pool = []
    for i in range(44):
        team, salary = "AB"[i % 2], random.randrange(30, 90) * 100
        score = round(random.uniform(0, 25), 3) + (1000 if team == "A" else 0)
        pool.append((1, "A-B", f"n{i} C", f"n{i}", team, "CPTN", int(salary * 1.5), 1.5 * score))
        pool.append((1, "A-B", f"n{i} F", f"n{i}", team, "FLEX", salary, score))
    sizes, cut = [], lineups.cut_lineage

    def noted(df):
        out = cut(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(lineups, "cut_lineage", noted)
    out = lineups.best_showdown_lineups(spark.createDataFrame(pool, SHOW), best=2)
    assert max(sizes) < 5000
    assert {r.team for r in out.where("lineup = 1").collect()} == {"A", "B"}


def test_a_closer_reach_only_rises(spark):
    known = spark.createDataFrame([(1, 10), (2, 30), (3, None), (4, 5)], "slate int, reach long")
    found = spark.createDataFrame(
        [(1, 12, ["a"]), (1, 15, ["b"]), (2, 20, ["a"]), (2, 20, ["b"]), (4, 9, ["a"])], "slate int, total long, members array<string>"
    )
    asked = []

    def search(some, width):
        asked.extend(r.slate for r in some.collect())
        return found

    got = {r.slate: r.reach for r in lineups._closer_reach(known, ["slate"], 2, search).collect()}
    assert got == {1: 12, 2: 30, 3: None, 4: 5} and sorted(asked) == [1, 2, 4]


def test_one_position_of_a_wide_range_does_not_set_the_price(spark):
    # Two of x and one of y under a cap of 10000; the last y is very far behind, as a defence is that faces many passers.
    x = [(c, 1000 * (c - 1000) ** 0.5) for c in range(1000, 9000, 500)]
    y = [(3000, 0.0), (3500, -1e10)]
    made = [(1, of, float(c), float(g)) for of, rows in (("x", x), ("y", y)) for c, g in rows]
    pool = spark.createDataFrame(made, "slate int, of string, cost double, gain double")

    def bounds(prices):
        worth = F.max(F.col("gain") - F.col("price") * F.col("cost")).alias("worth")
        tops = pool.join(prices, "slate").groupBy("slate", "price", "of").agg(worth)
        twice = F.when(F.col("of") == "x", 2 * F.col("worth")).otherwise(F.col("worth"))
        return tops.groupBy("slate", "price").agg((F.col("price") * 10000.0 + F.sum(twice)).alias("u"))

    def bound(price):
        return price * 10000 + 2 * max(g - price * c for c, g in x) + max(g - price * c for c, g in y)

    least = min(bound(i / 50) for i in range(5000))
    found = lineups._cheapest_bound(pool, ["slate"], 10000, bounds).first()
    assert found.price > 0 and bound(0) - least > 1000
    assert found.u - least < (bound(0) - least) / 50
