"""Lineup search against brute force, with score and salary ties."""

import itertools
import random

import pytest

from snapline.plans import lineups

MAIN = "slate int, player string, position string, team string, salary int, fpts_proj double"
SHOW = "slate int, matchup string, player string, player_id string, team string, position string, salary int, fpts_proj double"


def main_pool(seed):
    random.seed(seed)
    out = []
    for slate in (1, 2):
        i = 0
        for pos, n in {"QB": 3, "RB": 5, "WR": 6, "TE": 4, "DST": 3}.items():
            for _ in range(n):
                i += 1
                score = float(random.randrange(1, 12)) if seed % 2 else round(random.uniform(-2, 25), 3)
                out.append((slate, f"p{i:02d}", pos, "T", random.randrange(25, 80) * 100, score))
    out.append((1, "none", "QB", "T", 1000, None))
    return out


def brute_main(rows, slate, best):
    p = {}
    for r in rows:
        if r[0] == slate and r[5] is not None:
            p.setdefault(r[2], []).append(r)
    scores = []
    for rb, wr, te in ((3, 3, 1), (2, 4, 1), (2, 3, 2)):
        for core in itertools.product(
            itertools.combinations(p["RB"], rb), itertools.combinations(p["WR"], wr), itertools.combinations(p["TE"], te)
        ):
            flat = sum(core, ())
            cost, score = sum(r[4] for r in flat), sum(r[5] for r in flat)
            for q in p["QB"]:
                for d in p["DST"]:
                    if cost + q[4] + d[4] <= 50000:
                        scores.append(round(score + q[5] + d[5], 4))
    return sorted(scores, reverse=True)[:best]


@pytest.mark.parametrize("seed, best", [(2, 1), (3, 1), (4, 4), (5, 4)])
def test_main_lineups(spark, seed, best):
    rows = main_pool(seed)
    out = lineups.best_lineups(spark.createDataFrame(rows, MAIN), best=best).collect()
    for slate in (1, 2):
        mine = [r for r in out if r.slate == slate]
        assert sorted({(r.lineup, round(r.lineup_points, 4)) for r in mine}) == list(
            enumerate(brute_main(rows, slate, best), 1)
        )
        seen = set()
        for n in range(1, best + 1):
            team = [r for r in mine if r.lineup == n]
            assert len({r.player for r in team}) == 9 and sum(r.salary for r in team) == team[0].lineup_salary <= 50000
            assert team[0].lineup_points == pytest.approx(sum(r.fpts_proj for r in team))
            count = {pos: sum(r.position == pos for r in team) for pos in ("QB", "RB", "WR", "TE", "DST")}
            assert count["QB"] == count["DST"] == 1 and count["RB"] in (2, 3) and count["WR"] in (3, 4) and count["TE"] in (1, 2)
            seen.add(frozenset(r.player for r in team))
        assert len(seen) == best


def show_pool(seed):
    random.seed(seed)
    out = []
    for slate in (1, 2):
        for i in range(11):
            team, salary = "AB"[i % 2] if seed != 8 else ("A" if i < 8 else "B"), random.randrange(20, 110) * 100 + 50
            score = float(random.randrange(1, 9)) if seed % 2 else round(random.uniform(0, 25), 3)
            out.append((slate, "A-B", f"n{i} C", f"n{i}", team, "CPTN", int(salary * 1.5), 1.5 * score))
            out.append((slate, "A-B", f"n{i} F", f"n{i}", team, "FLEX", salary, score))
    return out


def brute_show(rows, slate, best):
    flex = [r for r in rows if r[0] == slate and r[5] == "FLEX"]
    captain = {r[3]: r for r in rows if r[0] == slate and r[5] == "CPTN"}
    scores = []
    for six in itertools.combinations(flex, 6):
        if len({r[4] for r in six}) < 2:
            continue
        for lead in six:
            cost = sum(r[6] for r in six) - lead[6] + captain[lead[3]][6]
            if cost <= 50000:
                scores.append(round(sum(r[7] for r in six) - lead[7] + captain[lead[3]][7], 3))
    return sorted(scores, reverse=True)[:best]


@pytest.mark.parametrize("seed, best", [(2, 1), (3, 1), (6, 5), (7, 5), (8, 3)])
def test_showdown_lineups(spark, seed, best):
    rows = show_pool(seed)
    out = lineups.best_showdown_lineups(spark.createDataFrame(rows, SHOW), best=best).collect()
    for slate in (1, 2):
        mine = [r for r in out if r.slate == slate]
        got = sorted({(r.lineup, r.lineup_points) for r in mine})
        assert [p for _, p in got] == pytest.approx(brute_show(rows, slate, best), abs=2e-3)
        for n in range(1, best + 1):
            team = [r for r in mine if r.lineup == n]
            assert len({r.player_id for r in team}) == 6 and sum(r.position == "CPTN" for r in team) == 1
            assert sum(r.salary for r in team) == team[0].lineup_salary <= 50000
            assert max(sum(r.team == t for r in team) for t in "AB") <= 5


def test_slots_are_read():
    assert lineups.read_slots(lineups.MAIN_SLOTS) == (
        {"QB": 1, "RB": 2, "WR": 3, "TE": 1, "DST": 1}, ("RB", "WR", "TE"), 1
    )
    with pytest.raises(ValueError):
        lineups.read_slots({"A": 1, "A/B": 1})
    with pytest.raises(ValueError):
        lineups.read_slots({"A": 1, "B": 1, "C": 1, "A/B": 1, "B/C": 1})


def test_other_slots_and_several_shared_places(spark):
    random.seed(9)
    rows = [(1, f"p{i}", "AB"[i % 2], "T", random.randrange(1, 30) * 100, round(random.uniform(0, 20), 2)) for i in range(12)]
    out = lineups.best_lineups(
        spark.createDataFrame(rows, MAIN), slots={"A": 1, "B": 1, "A/B": 2}, cap=6000, best=3
    ).collect()
    want = sorted(
        (
            round(sum(r[5] for r in four), 4)
            for four in itertools.combinations(rows, 4)
            if sum(r[4] for r in four) <= 6000 and len({r[2] for r in four}) == 2
        ),
        reverse=True,
    )[:3]
    assert [p for _, p in sorted({(r.lineup, round(r.lineup_points, 4)) for r in out})] == want


def test_salary_profile(spark):
    rows = [(1, 1, f"p{i}", 100 * i, float(i)) for i in range(1, 10)]
    df = spark.createDataFrame(rows, "slate int, lineup int, player string, salary int, fpts_proj double")
    got = lineups.salary_profile(df).collect()[0]
    assert (got.top_2_spend, got.top_3_score, got.mid_3_spend, got.lineup_score) == (1700, 24.0, 1500, 45.0)
