"""Queries over weekly player stats."""

from __future__ import annotations

import uuid

from ..operators.sorting import arrange
from ..plans import player_stats as P
from ..session import checkpoint_folder
from ..sources import standins as V
from ..sources.files import read_seasons, write_seasons
from .common import r6, tidy
from .games import density_sql

_QB = "l_suppkey % 4 = 3"
PLAYER_STATS = f"""player_stats AS (
  SELECT l_suppkey AS player_id, CASE WHEN l_suppkey % 23 <> 11 THEN 'S' || l_suppkey END AS player_name,
    'Supplier ' || l_suppkey AS player_display_name, ['WR', 'TE', 'RB', 'QB'][l_suppkey % 4 + 1] AS position,
    l_returnflag || l_linestatus AS recent_team, CASE WHEN l_linenumber = 7 THEN 'POST' ELSE 'REG' END AS season_type,
    CAST(year(l_shipdate) AS INT) AS season, CAST(floor((dayofyear(l_shipdate) - 1) / 21) + 1 AS INT) AS week,
    CAST(l_quantity % 11 AS INT) AS targets, CASE WHEN l_partkey % 997 <> 3 THEN l_linenumber % 4 END AS carries,
    CASE WHEN {_QB} THEN CAST(l_quantity AS INT) ELSE 0 END AS attempts,
    CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END AS receiving_tds,
    CASE WHEN l_partkey % 13 = 0 THEN 1 ELSE 0 END AS rushing_tds,
    CASE WHEN {_QB} AND l_discount > 0.075 THEN 2 ELSE 0 END AS passing_tds,
    CASE WHEN {_QB} THEN round(l_discount * 100 - 5, 2) END AS passing_epa,
    round(l_tax * 100 - 4, 2) AS rushing_epa,
    CASE WHEN l_linenumber % 5 <> 0 THEN l_quantity / 10 - 2.5 END AS receiving_epa,
    l_orderkey, l_linenumber, l_partkey, l_extendedprice
  FROM lineitem)"""

_NEWEST = "season DESC, week DESC, " + ", ".join(f"{c} DESC" for c in V.STAT_TIE)


def _na_sum(c: str) -> str:
    return f"CASE WHEN count(*) = count({c}) THEN CAST(sum({c}) AS BIGINT) END"


def _season_sums(name: str, where: str) -> str:
    epa = ", ".join(
        f"sum(coalesce({c}, 0)) AS {c}" for c in ("passing_epa", "rushing_epa", "receiving_epa")
    )
    return f"""{name}_sums AS (
  SELECT player_id, position, season, first(recent_team ORDER BY {_NEWEST}) AS recent_team,
    first(player_display_name ORDER BY {_NEWEST}) AS player_name, count(*) AS games,
    {_na_sum("targets")} AS s_targets, {_na_sum("carries")} AS s_rushes, {_na_sum("attempts")} AS s_passes,
    CAST(sum(receiving_tds) + sum(rushing_tds) + sum(passing_tds) AS BIGINT) AS s_tds, {epa}
  FROM player_stats WHERE player_name IS NOT NULL AND {where} GROUP BY player_id, position, season),
{name} AS (
  SELECT player_id, position, season, recent_team, player_name, games, s_targets / games AS targets,
    s_rushes / games AS rushes, s_passes / games AS passes, (passing_epa + rushing_epa + receiving_epa) / games AS epa,
    (s_targets + s_rushes + s_passes) / games AS opps,
    s_tds / nullif((s_targets / games + s_rushes / games + s_passes / games) * games, 0) AS tds_opp,
    s_tds / games AS touchdowns
  FROM {name}_sums)"""


RATES = f"{PLAYER_STATS}, {_season_sums('rates', chr(39).join(['season_type = ', 'REG', '']))}"
POST = f"""{PLAYER_STATS}, {_season_sums('post', "season_type = 'POST' AND season = 2000 AND recent_team IN ('AO', 'RF')")},
playoffs AS (SELECT *, epa / nullif(opps, 0) AS epa_play FROM post WHERE opps > 3)"""
LANDED_SEASONS = (1996, 1998)
LANDED = f"{PLAYER_STATS}, " + _season_sums("landed", "season_type = 'REG' AND season BETWEEN {} AND {}".format(*LANDED_SEASONS))
PACE = """pace AS (
  SELECT player_id, player_name, position, first(recent_team ORDER BY season DESC) AS team,
    CAST(sum(games) AS BIGINT) AS games,
    CASE WHEN count(*) = count(touchdowns) AND count(*) = count(opps) THEN sum(touchdowns) / nullif(sum(opps), 0) END AS td_opp,
    avg(opps) AS opps, avg(epa) AS epa, avg(epa) * 17 AS epa_17
  FROM rates WHERE season BETWEEN 2000 AND 2001 GROUP BY player_id, player_name, position)"""
CHANGES = """changes AS (
  SELECT a.player_id, a.player_name, a.position,
    CASE WHEN a.season = 2001 THEN a.season || '-' ELSE a.season || '-' || (a.season + 1) END AS range, a.season,
    a.games, a.targets, a.rushes, a.passes, a.opps, a.touchdowns, a.tds_opp, b.opps AS season_n_1_opps,
    b.tds_opp AS season_n_1_tds_opp, b.opps - a.opps AS season_n_1_opp_diff, b.tds_opp - a.tds_opp AS season_n_1_diff
  FROM rates a LEFT JOIN rates b ON a.player_id IS NOT DISTINCT FROM b.player_id
    AND a.position IS NOT DISTINCT FROM b.position AND a.player_name IS NOT DISTINCT FROM b.player_name
    AND b.season = a.season + 1)"""

_RATE_COLS = (
    "player_id, position, season, recent_team, player_name, games, "
    + r6("targets", "rushes", "passes", "epa", "opps", "tds_opp", "touchdowns")
)
_PACE_COLS = "player_id, player_name, position, team, games, " + r6("td_opp", "opps", "epa", "epa_17")
_RETIRED = ("Supplier 3", "Supplier 20")
_ALWAYS = ("Supplier 12",)


def _stats(s, d):
    return V.player_stats(s, d)


def _rates(s, d):
    return P.per_game_rates(_stats(s, d), V.STAT_TIE)


def _pace(s, d):
    return P.season_pace(_rates(s, d), 2000, 2001)


def _changes(s, d):
    return P.next_season_change(_rates(s, d), 2001)


def _playoffs(s, d):
    return P.playoff_rates(_stats(s, d), 2000, ("AO", "RF"), 3, V.STAT_TIE)


def _leaders(s, d):
    return P.touchdown_leaders(tidy(_rates(s, d)))


def _over(s, d):
    return P.over_achievers(
        tidy(_changes(s, d)), 1996, 2001, min_rate=0.03, min_opps=5, left_out=("Supplier 8",)
    )


def _pct(x: str) -> str:
    return f"coalesce(printf('%.1f%%', round({x} * 100, 1) + 0.0), '')"


def _landed(s, d):
    """Some seasons of a table that lies by season: other seasons' files are not opened."""
    path = f"{checkpoint_folder(s).rstrip('/')}/seasons-{uuid.uuid4().hex}"
    write_seasons(_stats(s, d), path)
    return read_seasons(s, path, *LANDED_SEASONS)


QUERIES = {
    "q10_per_game_rates": (
        lambda s, d: tidy(_rates(s, d)),
        f"WITH {RATES} SELECT {_RATE_COLS} FROM rates",
    ),
    "q10_touchdown_rates": (
        lambda s, d: tidy(P.touchdown_rates(_stats(s, d), V.STAT_TIE)),
        f"""WITH {RATES} SELECT player_id, position, season, recent_team, player_name, games, s_targets AS targets,
          s_rushes AS rushes, s_passes AS passes, s_targets + s_rushes + s_passes AS opps, s_tds AS touchdowns,
          round(s_tds / nullif(s_targets + s_rushes + s_passes, 0), 6) + 0.0 AS tds_opp FROM rates_sums""",
    ),
    "q10_landed_seasons": (
        lambda s, d: tidy(P.touchdown_rates(_landed(s, d), V.STAT_TIE)),
        f"""WITH {LANDED} SELECT player_id, position, season, recent_team, player_name, games, s_targets AS targets,
          s_rushes AS rushes, s_passes AS passes, s_targets + s_rushes + s_passes AS opps, s_tds AS touchdowns,
          round(s_tds / nullif(s_targets + s_rushes + s_passes, 0), 6) + 0.0 AS tds_opp FROM landed_sums""",
    ),
    "q10_playoff_rates": (
        lambda s, d: arrange(tidy(_playoffs(s, d)), "-epa_play", "player_id"),
        f"WITH {POST} SELECT {_RATE_COLS}, {r6('epa_play')} FROM playoffs",
    ),
    "q10_playoff_teams": (
        lambda s, d: tidy(P.team_rollup(_playoffs(s, d))),
        f"""WITH {POST} SELECT recent_team, round(sum(opps), 6) + 0.0 AS opps, round(sum(epa), 6) + 0.0 AS epa,
          round(avg(epa_play), 6) + 0.0 AS epa_play FROM playoffs GROUP BY recent_team""",
    ),
    "q11_two_season_pace": (
        lambda s, d: arrange(tidy(_pace(s, d)), "-epa_17", "player_id"),
        f"WITH {RATES}, {PACE} SELECT {_PACE_COLS} FROM pace",
    ),
    "q09_topk_pace": (
        lambda s, d: P.pace_chart(tidy(_pace(s, d)), 25, 20, 4, _RETIRED, _ALWAYS),
        f"""WITH {RATES}, {PACE}, p AS (SELECT {_PACE_COLS} FROM pace),
        kept AS (SELECT *, player_name || ' - ' || position AS player_label, epa_17 AS new_alpha FROM p
          WHERE ((games >= 20 AND opps >= 4) OR coalesce(player_name IN {_ALWAYS[0:1] + _ALWAYS[0:1]}, false))
            AND NOT coalesce(player_name IN {_RETIRED}, false))
        SELECT * FROM kept WHERE position IN ('TE', 'RB', 'WR', 'QB') AND epa > 0 AND epa_17 IS NOT NULL
        QUALIFY rank() OVER (ORDER BY epa_17 DESC) <= 25""",
    ),
    "q09_topk_passers": (
        lambda s, d: P.passer_rate_chart(tidy(_pace(s, d)), 25, 16, 5, _RETIRED),
        f"""WITH {RATES}, {PACE}, p AS (SELECT {_PACE_COLS} FROM pace),
        best AS (SELECT *, player_name || ' - ' || position AS player_label FROM p
          WHERE games >= 16 AND opps >= 5 AND position = 'QB' AND td_opp IS NOT NULL
          QUALIFY rank() OVER (ORDER BY td_opp DESC) <= 25)
        SELECT *, CASE WHEN player_name IN {_RETIRED} THEN max(td_opp) OVER () ELSE td_opp END AS new_alpha FROM best""",
    ),
    "q09_topk_ties": (
        _leaders,
        f"""WITH {RATES}, r AS (SELECT {_RATE_COLS} FROM rates),
        best AS (SELECT player_name, position, games, season, tds_opp FROM r
          WHERE opps > 5 AND position = 'WR' AND games > 2 AND tds_opp IS NOT NULL
          QUALIFY rank() OVER (ORDER BY tds_opp DESC) <= 25)
        SELECT *, {_pct("tds_opp")} AS tds_opp_text FROM best""",
    ),
    "q12_year_over_year": (
        lambda s, d: tidy(_changes(s, d)),
        f"""WITH {RATES}, {CHANGES} SELECT player_id, player_name, position, range, season, games,
          {r6("targets", "rushes", "passes", "opps", "touchdowns", "tds_opp", "season_n_1_opps", "season_n_1_tds_opp",
              "season_n_1_opp_diff", "season_n_1_diff")} FROM changes""",
    ),
    "q12_over_achievers": (
        lambda s, d: tidy(_over(s, d)),
        f"""WITH {RATES}, {CHANGES},
        kept AS (SELECT position, player_name, range, games, {r6("opps", "tds_opp", "season_n_1_opp_diff", "season_n_1_diff")}
          FROM changes WHERE position IN ('WR', 'TE', 'RB') AND player_name <> 'Supplier 8'
            AND season BETWEEN 1996 AND 2001 AND games > 1),
        picked AS (SELECT * FROM kept WHERE tds_opp >= 0.03 AND opps >= 5),
        both_kinds AS (
          SELECT CASE WHEN grouping(player_name) = 1 THEN 'mean' ELSE 'detail' END AS row_kind, position, player_name,
            range, games, opps, avg(tds_opp) AS tds_opp, avg(season_n_1_opp_diff) AS season_n_1_opp_diff,
            avg(season_n_1_diff) AS season_n_1_diff
          FROM picked GROUP BY GROUPING SETS ((position, player_name, range, games, opps), (position)))
        SELECT row_kind, position, player_name, range, games, opps,
          {r6("tds_opp", "season_n_1_opp_diff", "season_n_1_diff")}, {_pct("season_n_1_diff")} AS change_text,
          coalesce(printf('%.1f', round(opps, 1) + 0.0), '') AS opps_text, {_pct("tds_opp")} AS tds_opp_text,
          coalesce(printf('%.1f', round(season_n_1_opp_diff, 1) + 0.0), '') AS opp_change_text
        FROM both_kinds""",
    ),
    "q25_change_density": (
        lambda s, d: tidy(P.change_density(_changes(s, d), min_rate=0.02, min_opps=3, cell=0.001)),
        f"""WITH {RATES}, {CHANGES},
        kept AS (SELECT position, season_n_1_diff FROM changes WHERE games > 1 AND opps >= 3 AND tds_opp > 0.02),
        {density_sql("kept", "position", "season_n_1_diff", 256, 64)}
        SELECT k AS position, point, {r6("x", "density")}, n FROM curves""",
    ),
}
