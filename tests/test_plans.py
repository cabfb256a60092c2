"""Analyses on small hand-made tables: ties, null keys, missing passers, floors, zero denominators."""

import pytest
from pyspark.sql import functions as F

from snapline.plans import blend, lineups, player_stats, plays, scoring, showdown, simulate
from snapline.sources import files

PLAY = (
    "game_id string, play_id int, season int, week int, season_type string, posteam string, qb_dropback int, "
    "passer_player_id string, passer_player_name string, epa double, score_differential int, play_type string, "
    "home_team string, away_team string, spread_line double, total_line double"
)


def play(game, pid, week, team, passer, epa=1.0, diff=0, kind="pass", drop=1):
    pid_name = (None, None) if passer is None else (passer, passer.upper())
    return (game, pid, 2020, week, "REG", team, drop, *pid_name, epa, diff, kind, "H", "A", 3.0, 44.0)


@pytest.fixture(scope="module")
def pbp(spark):
    data = [
        play("g1", 1, 1, "H", "p"), play("g1", 2, 1, "H", "q"), play("g1", 3, 1, "H", "p", epa=3.0),
        play("g1", 4, 1, "H", "q", kind="run"), play("g1", 5, 1, "A", "r", epa=None), play("g1", 6, 1, "A", "r", epa=2.0),
        play("g2", 1, 2, "H", "p", epa=5.0), play("g2", 2, 2, "H", None, diff=None), play("g2", 3, 2, "", "p"),
        play("g2", 4, 2, "A", None, kind="run"), play("g2", 5, 2, "A", None), play("g2", 6, 2, "A", "r", drop=0),
    ]
    return spark.createDataFrame(data, PLAY)


def test_two_passers_tie(pbp, rows):
    got = rows(plays.primary_passer(pbp), "game_id", "posteam", "primary_passer_id", "dropbacks")
    assert got == [("g1", "A", "r", 2), ("g1", "H", "p", 2), ("g1", "H", "q", 2), ("g2", "A", None, 2), ("g2", "H", "p", 1)]


def test_recency_counts_back_from_the_newest_game(pbp, rows):
    got = rows(plays.passer_recency(pbp), "primary_passer_id", "game_id", "primary_passer_game_recency")
    assert got == [("p", "g1", 2), ("p", "g2", 1), ("q", "g1", 1), ("r", "g1", 1), (None, "g2", 1)]


def test_rolling_is_at_the_last_play_of_the_game(pbp, rows):
    got = rows(plays.rolling_passer_epa(pbp), "primary_passer_id", "game_id", "play_id", "roll_5_epa")
    # Both tied passers of g1 carry all of the team's plays: newest first 5 | 1, 3, 1, 1 for p.
    assert got == [
        ("p", "g1", 4, pytest.approx((5 + 1 + 3 + 1) / 4)), ("p", "g2", 1, pytest.approx((5 + 1 + 3) / 3)),
        ("q", "g1", 4, pytest.approx((1 + 3 + 1) / 3)), ("r", "g1", 6, 2.0),
    ]


def test_literal_and_team_matched_game_rows(pbp):
    literal = plays.game_table_with_rolls(pbp)
    matched = plays.game_table_with_rolls(pbp, match_team=True)
    g1 = literal.where("game_id = 'g1'").groupBy("off_team").count().collect()
    assert {r.off_team: r["count"] for r in g1} == {"H": 3, "A": 3}
    g1 = matched.where("game_id = 'g1'").groupBy("off_team").count().collect()
    assert {r.off_team: r["count"] for r in g1} == {"H": 2, "A": 1}


def test_game_table(pbp, rows):
    got = rows(plays.game_table(pbp), "game_id", "posteam", "off_plays", "passes", "rushes", "off_spread", "off_implied")
    assert got[0] == ("g1", "A", 2, 2, 0, -3.0, 20.5)
    assert got[1] == ("g1", "H", 4, 3, 1, 3.0, 23.5)


def test_roster_repeats_count_the_plays_twice(spark, rows):
    data = [("x", 2020, 1, "REG", 1, 4.0, 1.0, 0.5, "g", i) for i in range(3)] + [(None, 2020, 2, "REG", 1, 8.0, 1.0, 0.5, "g", 9)] * 2
    p = spark.createDataFrame(
        data, "passer_id string, season int, week int, season_type string, qb_dropback int, yards_gained double, ep double, epa double, game_id string, play_id int"
    )
    roster = spark.createDataFrame([(2020, "x", "X"), (2020, "x", "X2")], "season int, gsis_id string, full_name string")
    got = plays.season_efficiency(p, roster, least=2).collect()[0]
    assert got.dropbacks == 3 * 2 + 2 and got.adj_passers == 2 / 2 * 18
    assert got.aya == pytest.approx((6 * 4 + 2 * 8) / 8)
    career = plays.career_efficiency(p, roster, least=2)
    assert rows(career, "full_name", "dropbacks", "season_sr") == [("X", 3, 0.0), ("X2", 3, 0.0)]


STAT = (
    "player_id string, player_name string, player_display_name string, position string, recent_team string, "
    "season_type string, season int, week int, targets int, carries int, attempts int, receiving_tds int, "
    "rushing_tds int, passing_tds int, passing_epa double, rushing_epa double, receiving_epa double"
)


def stat(pid, season, week, team, targets, carries=0, tds=1):
    return (pid, pid, pid.upper(), "WR", team, "REG", season, week, targets, carries, 0, tds, 0, 0, None, 1.0, None)


def test_rates(spark, rows):
    df = spark.createDataFrame(
        [stat("a", 2020, 1, "OLD", 4), stat("a", 2020, 2, "NEW", 6), stat("a", 2021, 1, "NEW", 10), stat("z", 2020, 1, "Z", 0),
         stat("n", 2020, 1, "N", None), stat("n", 2020, 2, "N", 3)],
        STAT,
    )
    rates = player_stats.per_game_rates(df)
    got = {(r.player_id, r.season): r for r in rates.collect()}
    assert (got["a", 2020].recent_team, got["a", 2020].games, got["a", 2020].opps) == ("NEW", 2, 5.0)
    assert got["a", 2020].tds_opp == pytest.approx(0.2) and got["a", 2020].epa == 1.0
    assert got["z", 2020].tds_opp is None
    assert got["n", 2020].opps is None and got["n", 2020].touchdowns == 1.0
    change = player_stats.next_season_change(rates, open_season=2021)
    assert rows(change.where("player_id = 'a'"), "range", "season_n_1_opp_diff") == [("2020-2021", 5.0), ("2021-", None)]


def test_pace_chart_exceptions(spark, rows):
    pace = spark.createDataFrame(
        [("1", "Starter", "WR", "T", 30, 0.1, 5.0, 2.0, 34.0), ("2", "Brock Purdy", "QB", "T", 5, 0.1, 5.0, 1.0, 17.0),
         ("3", "Drew Brees", "QB", "T", 30, 0.1, 5.0, 3.0, 51.0), ("4", None, "RB", "T", 30, 0.1, 5.0, 0.5, 8.5)],
        "player_id string, player_name string, position string, team string, games int, td_opp double, opps double, epa double, epa_17 double",
    )
    assert [r[0] for r in rows(player_stats.pace_chart(pace), "player_id")] == ["1", "2", "4"]
    assert [r[0] for r in rows(player_stats.pace_chart(pace, k=1), "player_id")] == ["1"]


PLAYER = "name string, team string, opp string, position string, salary int, projection double, std_dev double"


def linked(spark, data, rule=simulate.MAIN):
    df = spark.createDataFrame(data, "slate int, name string, team string, opp string, pos string, projection double")
    return {r.name: r.new_proj for r in simulate.link_to_passers(df, rule).collect()}


def test_main_link(spark):
    got = linked(spark, [
        (1, "qb", "X", "Y", "QB", 20.0), (1, "rb", "X", "Y", "RB", 10.0), (1, "wr", "X", "Y", "WR", 8.0),
        (1, "te", "X", "Y", "TE", 4.0), (1, "low", "X", "Y", "WR", -2.0), (1, "k", "X", "Y", "K", 5.0),
        (1, "dst", "Y", "X", "DST", 6.0), (1, "alone", "Z", "W", "WR", 9.0), (1, "fa", "FA", None, "WR", 9.0),
        (1, "fb", "FA", None, "RB", 3.0),
    ])
    positive, total = 10 + 8 + 4 + 5, 10 + 8 + 4 + 5 - 2
    assert got["qb"] == 20 and got["rb"] == 10 and got["fb"] == 3
    assert got["wr"] == pytest.approx(20 * 8 / positive * 0.64 + 8 * 0.36)
    assert got["te"] == pytest.approx(20 * 4 / total * 0.35 + 4 * 0.65)
    assert got["low"] == pytest.approx(20 * -2 / positive * 0.64 - 2 * 0.36)
    assert got["dst"] == pytest.approx(20 * -0.47 + 6 * 1.47)
    assert got["alone"] is None and "fa" not in got and "k" not in got


def test_link_with_no_positive_score_or_a_missing_one(spark):
    got = linked(spark, [
        (1, "qb", "X", "Y", "QB", -2.0), (1, "w1", "X", "Y", "WR", -1.0), (1, "w2", "X", "Y", "WR", 0.0),
        (2, "qc", "X", "Y", "QB", 5.0), (2, "w3", "X", "Y", "WR", 5.0), (2, "w4", "X", "Y", "WR", None),
    ])
    assert got["w1"] is None and got["w2"] is None
    assert got["w3"] is None and got["w4"] is None and got["qc"] == 5


def test_showdown_and_season_link(spark):
    got = linked(spark, [
        (1, "qb", "X", "Y", "QB", 20.0), (1, "k", "X", "Y", "K", 5.0), (1, "dst", "Y", "X", "DST", -1.0),
    ], simulate.SHOWDOWN)
    assert got["k"] == pytest.approx(20 * 0.1 + 5 * 0.9) and got["dst"] == pytest.approx(20 * -0.17)
    season = spark.createDataFrame(
        [("qb", "X", "QB", 1, 10.0, 20.0, 30.0), ("bad", "X", "QB", 1, 33.0, 9.0, 9.0), ("wr", "X", "WR", 1, 75.0, 4.0, 6.0),
         ("w2", "X", "WR", 1, 20.0, 12.0, 1.0), ("te", "X", "TE", 1, 41.0, 4.0, 6.0), ("old", "X", "WR", 2, 5.0, 4.0, 6.0)],
        "name string, team string, pos string, week int, ecr double, projection double, projected_score double",
    )
    got = {r.name: r.new_proj for r in simulate.season_projection(simulate.season_slice(season), ("name",)).collect()}
    assert got["qb"] == 20.0 and set(got) == {"qb", "wr", "w2"}
    assert got["wr"] == pytest.approx(30 * 4 / 16 * 0.64 + 6 * 0.36)


def test_draws_floor_and_missing_projection(spark):
    df = spark.createDataFrame([("a", -50.0, 0.1), ("b", None, 1.0), ("c", 10.0, 0.0)], "name string, projection double, std_dev double")
    got = {(r.slate, r.name): r.projection for r in simulate.draw_scores(df, 3, 1).collect()}
    assert len(got) == 9
    assert all(got[s, "a"] == -2 and got[s, "b"] is None and got[s, "c"] == 10 for s in (1, 2, 3))


def test_feed_conversion(spark):
    feed = spark.createDataFrame(
        [("Joe Fox - CPTN", "CPTN", "X", "vs YYY", 9000, 7.0), ("Joe Fox", "WR", "X", "vs YYY", 5001, 7.0),
         ("Al Bo\t- CPTN", "CPTN", "X", "@YYY", 1, 2.0), ("Al Bo", "K", "X", "@YYY", 3000, 2.0)],
        "player string, pos string, team string, opp string, salary int, my_proj double",
    )
    known = spark.createDataFrame([("Joe Fox", "X", "YYY", "WR", 10.0, 4.0)], "name string, team string, opp string, position string, projection double, std_dev double")
    out = showdown.convert_feed(feed, known)
    got = {(r.player_id, r.position): r for r in out.collect()}
    joe, captain = got["Joe Fox", "FLEX"], got["Joe Fox", "CPTN"]
    assert (captain.salary, captain.pos, captain.fpts_proj, captain.std_dev) == (7501, "WR", 15.0, 6.0)
    assert (joe.salary, joe.fpts_proj, joe.std_dev) == (5001, 10.0, 4.0)
    # The feed's own number is matched on the plain name, for the captain too, and not raised.
    assert got["Al Bo", "FLEX"].fpts_proj == 2.0 and got["Al Bo", "CPTN"].fpts_proj == 2.0
    assert (got["Al Bo", "FLEX"].std_dev, got["Al Bo", "CPTN"].std_dev) == (5.5, 8.25)
    assert showdown.unmatched(out).count() == 0
    numbered = {(r.player_id, r.position): r.row_id for r in showdown.number_feed(showdown.convert_feed(feed, known, True)).collect()}
    assert numbered["Joe Fox", "CPTN"] == 1 and sorted(numbered.values()) == [1, 2, 3, 4]
    sim = {(r.slate, r.player_id, r.position): r for r in showdown.simulate_showdown(out, 2, 5).collect()}
    assert sim[1, "Joe Fox", "CPTN"].fpts_proj is None  # no passer on the team
    assert len(sim) == 8 and sim[1, "Joe Fox", "CPTN"].matchup == "X-YYY"


def test_default_spread(spark):
    df = spark.createDataFrame(
        [("K", 3.0, 1.0), ("WR", 3.0, None), ("WR", 0.0, 2.0), ("WR", 3.0, 2.0), ("WR", None, None)],
        "pos string, projection double, std_dev double",
    )
    assert [r.std_dev for r in showdown.default_spread(df).collect()] == [5.5, 5.0, 0.0, 2.0, None]


def test_players_of_one_name_are_told_apart(spark):
    pool = [("Al Bo", "T1", "T2", "WR", 5000, 9.0, 3.0), ("Al Bo", "T2", "T1", "WR", 5000, 9.0, 3.0), ("Al Bo", "T1", "T2", "TE", 5000, 9.0, 3.0)]
    pool += [(f"{p} {i}", "T1", "T2", p, 4000, 5.0, 0.5) for p, n in (("QB", 1), ("RB", 2), ("WR", 2), ("DST", 1)) for i in range(n)]
    pool.append(("QB of T2", "T2", "T1", "QB", 4000, 5.0, 0.5))
    df = spark.createDataFrame(pool, "name string, team string, opp string, position string, salary int, projection double, std_dev double")
    draws = simulate.draw_scores(df, 1, 7, key=("name", "team", "position")).where("name = 'Al Bo'").collect()
    assert len({r["projection"] for r in draws}) == 3
    slates = simulate.simulate_main(df, 2, 7)
    assert slates.count() == 20
    best = lineups.best_lineups(slates).collect()
    assert len(best) == 18 and sum(r["player"] == "Al Bo" for r in best) == 6


def test_scores_with_and_without_missing_members(spark, rows):
    draws = spark.createDataFrame(
        [(1, "a", "T", "WR", 10, 1.006), (1, "b", "T", "WR", 10, 2.0), (2, "a", "T", "WR", 10, 3.0)],
        "sim int, player string, team string, position string, salary int, fpts_proj double",
    )
    members = spark.createDataFrame(
        [(1, 1, "a", "T", "WR", 10), (1, 1, "b", "T", "WR", 10), (1, 2, "z", "T", "WR", 10), (1, 3, "b", "T", "WR", 10)],
        "slate int, lineup int, player string, team string, position string, salary int",
    )
    scores = scoring.score_in_slates(draws, members, ["slate", "lineup"], 2)
    assert rows(scores, "sim", "lineup", "lineup_score") == [
        (1, 1, 3.01), (1, 2, 0.0), (1, 3, 2.0), (2, 1, 3.0), (2, 2, 0.0), (2, 3, 0.0)
    ]
    assert rows(scoring.mean_scores(scores, ["slate", "lineup"]), "lineup", "lineup_score") == [(1, 3.005), (2, 0.0), (3, 1.0)]


def test_grid(spark, rows):
    grid = spark.createDataFrame(
        [(1, "A.J. Dillon 12", "49ers 5", 7), (2, "A.J. Dillon 12", None, 7), (3, "Lost Man 3", "49ers 5", 7)],
        "number int, QB string, DST string, salary int",
    )
    players = spark.createDataFrame([("A.J. Dillon", "QB", "GB"), ("49ers", "DST", "SF")], "player string, pos string, team string")
    wide = spark.createDataFrame([("A.J. Dillon", "QB", 10.0, -9.0), ("49ers", "DST", 3.0, 5.0)], "player string, pos string, number1 double, number2 double")
    long = scoring.read_grid(grid, players)
    assert rows(long)[0] == (1, "49ers", "DST", "SF") and long.count() == 6
    draws = scoring.read_grid_draws(wide)
    assert rows(draws, "player", "sim_num", "sim_proj") == [("49ers", 1, 3.0), ("49ers", 2, 5.0), ("A.J. Dillon", 1, 10.0), ("A.J. Dillon", 2, -2.0)]
    scores = scoring.grid_scores(draws, long)
    assert rows(scores) == [(1, 8.0), (2, None), (3, None)]
    assert rows(scoring.grid_scores_by_draw(draws, long)) == [(1, 1, 13.0), (2, 1, 3.0)]
    # A player with two projection rows counts with both.
    twice = draws.unionByName(draws.where("player = '49ers'"))
    assert rows(scoring.grid_scores_by_draw(twice, long)) == [(1, 1, 16.0), (2, 1, 8.0)]
    assert rows(scoring.grid_scores(twice, long)) == [(1, 12.0), (2, None), (3, None)]
    assert rows(scoring.grid_exposure(scores, long, k=1)) == [("49ers", "DST", "SF", 1.0), ("A.J. Dillon", "QB", "GB", 1.0)]


def test_exposure(spark, rows):
    members = spark.createDataFrame(
        [("m", 1, "a", "a - CPTN", "WR", "CPTN"), ("m", 1, "b", "b", "QB", "FLEX"), ("m", 2, "a", "a", "WR", "FLEX"), ("m", 2, "b", "b", "QB", "FLEX")],
        "matchup string, lineup int, player_id string, player string, pos string, position string",
    )
    assert rows(scoring.showdown_players(members, 2), "player", "player_n", "player_pct") == [("a", 2, 1.0), ("b", 2, 1.0)]
    assert rows(scoring.showdown_plays(members, 2), "player", "position", "pct") == [("a", "FLEX", 0.5), ("a - CPTN", "CPTN", 0.5), ("b", "FLEX", 1.0)]
    assert rows(scoring.lineup_share(members), "player_id", "n", "pct") == [("a", 2, 1.0), ("b", 2, 1.0)]


def test_recent_points_rounds_half_even(spark, rows):
    data = [("2020", w, "p", "D.J. Moore", "WR", "LA" if w > 2 else "KC", 0.0, 0.0, 0.0, float(w), 1.0) for w in range(1, 9)]
    df = spark.createDataFrame(
        data, "season string, week int, player_id string, full_name string, position string, posteam string, pass_yards_gained_exp double, rec_yards_gained_exp double, rush_yards_gained_exp double, total_fantasy_points_exp double, total_fantasy_points_diff double"
    )
    assert rows(blend.recent_points(df)) == [("p", "DJ Moore", "LAR", "WR", 6.0)]  # mean 5.5
    assert blend.weekly_points(df).count() == 8


def test_slate_match_and_files(spark, tmp_path):
    (tmp_path / "bb.csv").write_text("Name,Team,Position,Slate,Salary,Projection,Std Dev,Extra Col\nA,X,WR,Main,5000,10.5,NA,q\nB,X,WR,Night,5000,1,1,q\nC,X,WR,Main,0,1,1,q\n")
    (tmp_path / "main.csv").write_text("Opponent,Team\nY,X\nY,X\n")
    boom = files.read_named_csv(spark, str(tmp_path / "bb.csv"), "boom_bust")
    main = files.read_named_csv(spark, str(tmp_path / "main.csv"), "main_projections")
    got = simulate.match_slate(boom, main).collect()
    assert len(got) == 1 and got[0].opp == "Y" and got[0].std_dev is None and got[0].salary == 5000
    with pytest.raises(ValueError):
        files.read_named_csv(spark, str(tmp_path / "main.csv"), "boom_bust")
    assert files.read_csv(spark, str(tmp_path / "bb.csv")).schema["salary"].dataType.typeName() == "integer"


def test_season_layout_prunes(spark, tmp_path):
    path = str(tmp_path / "plays")
    files.write_seasons(spark.range(10).selectExpr("id", "cast(2000 + id as int) as season"), path)
    df = files.read_seasons(spark, path, 2003, 2005)
    assert df.count() == 3
    scan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season" in scan


def test_grid_files_with_missing_values(spark, tmp_path):
    from snapline.plans import scoring
    from snapline.sources.files import read_csv, read_named_csv

    (tmp_path / "draws.csv").write_text("Player,Pos,number 1,number 2\nA Bee,QB,1.5,NA\nA Bee,QB,2,3\nC Dee,RB,NA,4\n")
    (tmp_path / "grid.csv").write_text("number,QB,RB 1\n1,A Bee 12,C Dee 7\n2,NA,A Bee 3\n")
    for draws in (read_csv(spark, str(tmp_path / "draws.csv")), read_named_csv(spark, str(tmp_path / "draws.csv"), "grid_projections")):
        long = scoring.read_grid_draws(draws)
        assert dict(long.dtypes)["sim_proj"] == "double"
        assert sorted((r.player, r.sim_num, r.sim_proj or -9.0) for r in long.collect()) == [
            ("A Bee", 1, 1.5), ("A Bee", 1, 2.0), ("A Bee", 2, -9.0), ("A Bee", 2, 3.0), ("C Dee", 1, -9.0), ("C Dee", 2, 4.0),
        ]
    grid = read_named_csv(spark, str(tmp_path / "grid.csv"), "lineup_grid")
    assert dict(grid.dtypes)["number"] == "int" and grid.where("qb is null").count() == 1


def test_two_rows_of_a_player_are_summed_per_draw(spark, rows):
    from snapline.plans import scoring

    draws = spark.createDataFrame(
        [("a", "QB", 1, 1.0), ("a", "QB", 1, 2.0), ("a", "QB", 2, 5.0), ("a", "QB", 2, 0.0), ("b", "RB", 1, 1.0), ("b", "RB", 2, 3.0)],
        "player string, pos string, sim_num int, sim_proj double",
    )
    grid = spark.createDataFrame([(1, "a", "QB", "x"), (1, "b", "RB", "x")], "number int, player string, pos string, team string")
    assert rows(scoring.grid_scores(draws, grid)) == [(1, 6.0)]


def test_rows_without_a_known_projection_are_numbered_last(spark, rows):
    from snapline.plans import showdown

    feed = spark.createDataFrame(
        [("p", "FLEX", "A", "B", 1.0, 9.0), ("q", "FLEX", "B", "A", 2.0, 2.0), ("r", "FLEX", "A", "B", None, 50.0)],
        "player_id string, position string, team string, opp string, known_proj double, fpts_proj double",
    )
    assert rows(showdown.number_feed(feed), "player_id", "row_id") == [("p", 2), ("q", 1), ("r", 3)]
