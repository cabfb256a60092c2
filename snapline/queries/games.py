"""Queries over plays."""

from __future__ import annotations

from ..plans import plays as P
from ..operators.sorting import arrange
from ..sources import standins as V
from .common import r6, tidy

EVENT_PLAYS = """event_plays AS (
  SELECT strftime(ts, '%Y-%m-%d') AS game_id, event_id AS play_id, 2024 AS season,
    CAST(ceil(day(ts) / 7.0) AS INT) AS week,
    CASE WHEN day(ts) <= 28 THEN 'REG' ELSE 'POST' END AS season_type,
    CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS posteam,
    'view' AS home_team, 'click' AS away_team,
    CASE WHEN event_id % 3 = 0 THEN 'run' WHEN event_id % 7 = 1 THEN 'punt' ELSE 'pass' END AS play_type,
    CASE WHEN event_id % 4 <> 0 THEN 1 ELSE 0 END AS qb_dropback,
    CASE WHEN user_id % 10 <> 3 THEN user_id END AS passer_player_id,
    CASE WHEN user_id % 50 <> 7 THEN 'U' || user_id END AS passer_player_name,
    CASE WHEN event_id % 11 <> 5 THEN value - 20 END AS epa,
    nullif(CAST(floor(value) AS INT) % 57, 13) AS score_differential,
    CAST(day(ts) % 15 - 7 AS DOUBLE) AS spread_line, CAST(day(ts) % 11 + 40 AS DOUBLE) AS total_line
  FROM events),
scored AS (
  SELECT * FROM event_plays WHERE score_differential IS NOT NULL AND season_type = 'REG' AND posteam <> ''),
drop_backs AS (SELECT * FROM scored WHERE qb_dropback = 1)"""

PRIMARY = """counted AS (
  SELECT game_id, posteam, season, passer_player_name, passer_player_id, count(*) AS dropbacks
  FROM drop_backs GROUP BY ALL),
primary_passer AS (
  SELECT game_id, posteam, season, passer_player_name AS primary_passer_name,
    passer_player_id AS primary_passer_id, dropbacks
  FROM counted QUALIFY rank() OVER (PARTITION BY game_id, posteam, season ORDER BY dropbacks DESC) = 1)"""

RECENCY = """matched AS (
  SELECT DISTINCT d.game_id, d.posteam, d.season, d.week, p.primary_passer_name, p.primary_passer_id
  FROM drop_backs d LEFT JOIN primary_passer p ON d.game_id IS NOT DISTINCT FROM p.game_id
    AND d.posteam IS NOT DISTINCT FROM p.posteam AND d.season IS NOT DISTINCT FROM p.season),
recency AS (
  SELECT *, row_number() OVER (PARTITION BY primary_passer_name, primary_passer_id
    ORDER BY season DESC, week DESC, game_id DESC, posteam DESC) AS primary_passer_game_recency
  FROM matched)"""

_FRAMES = {5: (2, 2), 10: (4, 5), 25: (12, 12), 50: (24, 25)}
ROLLING = """known AS (
  SELECT d.game_id, d.posteam, d.season, d.week, d.play_id, d.epa, r.primary_passer_name, r.primary_passer_id,
    r.primary_passer_game_recency
  FROM drop_backs d LEFT JOIN recency r ON d.game_id = r.game_id AND d.posteam = r.posteam
    AND d.season = r.season AND d.week = r.week
  WHERE d.epa IS NOT NULL AND r.primary_passer_name IS NOT NULL),
rolled AS (
  SELECT *, """ + ", ".join(
    f"""avg(epa) OVER (PARTITION BY primary_passer_name, primary_passer_id
    ORDER BY season DESC, week DESC, play_id DESC, game_id DESC, posteam DESC
    ROWS BETWEEN {b} PRECEDING AND {a} FOLLOWING) AS roll_{k}_epa"""
    for k, (b, a) in _FRAMES.items()
) + """ FROM known),
rolling AS (
  SELECT game_id, primary_passer_name, primary_passer_id, primary_passer_game_recency, posteam, epa, play_id,
    roll_5_epa, roll_10_epa, roll_25_epa, roll_50_epa
  FROM rolled QUALIFY rank() OVER (PARTITION BY primary_passer_name, primary_passer_id, game_id
    ORDER BY play_id DESC) = 1)"""

GAMES = """games AS (
  SELECT game_id, posteam, season, min(home_team) AS home_team, min(away_team) AS away_team,
    min(spread_line) AS spread_line, min(total_line) AS total_line, count(*) AS off_plays,
    count(DISTINCT CASE WHEN play_type = 'pass' THEN play_id END) AS passes
  FROM scored WHERE play_type IN ('run', 'pass') GROUP BY game_id, posteam, season),
game_table AS (
  SELECT *, off_plays - passes AS rushes,
    CASE WHEN posteam = home_team THEN spread_line ELSE -spread_line END AS off_spread,
    total_line / 2 + (CASE WHEN posteam = home_team THEN spread_line ELSE -spread_line END) / 2 AS off_implied
  FROM games)"""

_GAME_COLUMNS = (
    "g.game_id, g.posteam AS off_team, g.season, home_team, away_team, total_line, off_plays, passes, rushes, "
    "off_spread + 0.0 AS off_spread, off_implied, primary_passer_name, primary_passer_id, "
    "primary_passer_game_recency, " + r6("epa") + ", play_id, "
    + r6("roll_5_epa", "roll_10_epa", "roll_25_epa", "roll_50_epa")
)
_ROLL_VARS = ["off_plays", "roll_5_epa", "roll_10_epa", "roll_25_epa", "roll_50_epa"]
_CHAIN = f"WITH {EVENT_PLAYS}, {PRIMARY}, {RECENCY}, {ROLLING}, {GAMES}"


def _correlation_sql() -> str:
    joined = "joined AS (SELECT g.*, r.* EXCLUDE (game_id, posteam) FROM game_table g LEFT JOIN rolling r ON g.game_id = r.game_id)"
    parts = [
        f"SELECT '{a}' AS var_x, '{b}' AS var_y, CASE WHEN count(*) = count({a}) AND count(*) = count({b}) "
        f"THEN round(corr({a}, {b}), 6) + 0.0 END AS corr FROM joined WHERE season > 2007"
        for a in _ROLL_VARS for b in _ROLL_VARS
    ]
    return f"{_CHAIN}, {joined} " + " UNION ALL ".join(parts)


ORDER_PLAYS = """order_plays AS (
  SELECT l_orderkey AS game_id, l_linenumber AS play_id, CAST(year(o_orderdate) AS INT) AS season,
    CAST(floor((dayofyear(o_orderdate) - 1) / 21) + 1 AS INT) AS week,
    CASE WHEN o_orderstatus = 'P' THEN 'POST' ELSE 'REG' END AS season_type,
    CAST(CASE WHEN l_linestatus = 'O' THEN o_custkey % 32
      ELSE (o_custkey % 32 + 1 + o_orderkey % 31) % 32 END AS VARCHAR) AS posteam,
    CAST(o_custkey % 32 AS VARCHAR) AS home_team,
    CAST((o_custkey % 32 + 1 + o_orderkey % 31) % 32 AS VARCHAR) AS away_team,
    CASE l_returnflag WHEN 'R' THEN 'run' WHEN 'A' THEN 'pass' ELSE 'field_goal' END AS play_type,
    CASE WHEN l_tax < 0.065 THEN 1 ELSE 0 END AS qb_dropback,
    CASE WHEN l_suppkey % 19 <> 5 THEN l_suppkey END AS passer_id,
    CAST(l_quantity AS INT) AS yardline_100, CAST(floor((l_linenumber - 1) / 2) AS INT) AS drive,
    l_quantity - 10 AS yards_gained, l_discount * 60 - 1 AS ep,
    l_extendedprice * (l_discount - 0.05) / 1000 AS epa,
    nullif(CAST(l_quantity - 25 AS INT), -20) AS score_differential,
    CAST(CAST(substr(o_orderpriority, 1, 1) AS INT) - 3 AS DOUBLE) AS spread_line,
    CAST(year(o_orderdate) % 4 * 5 + CAST(substr(o_orderpriority, 1, 1) AS INT) AS DOUBLE) AS total_line,
    CAST(floor(o_totalprice / 1000) AS INT) AS total, l_partkey, l_suppkey, l_extendedprice
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

ROSTERS = """rosters AS (
  SELECT season, s_suppkey AS gsis_id, s_name AS full_name
  FROM supplier, (SELECT unnest(range(1995, 2002)) AS season) WHERE s_suppkey % 7 <> 4)"""

QUALIFIED = """regular AS (
  SELECT p.*, r.full_name FROM order_plays p
  LEFT JOIN rosters r ON p.passer_id = r.gsis_id AND p.season = r.season
  WHERE p.season_type = 'REG' AND p.qb_dropback = 1),
qualified AS (
  SELECT * FROM regular QUALIFY count(*) OVER (PARTITION BY passer_id, season) >= 25),
season_eff AS (
  SELECT season, (count(DISTINCT passer_id) + max(CASE WHEN passer_id IS NULL THEN 1 ELSE 0 END))
      / count(DISTINCT week) * 18.0 AS adj_passers,
    count(*) AS dropbacks, avg(yards_gained) AS aya, avg(ep) AS ep, round(avg(epa), 3) AS epa
  FROM qualified GROUP BY season)"""

CLOSING = """closing AS (
  SELECT game_id, play_id, total, total_line FROM order_plays
  WHERE total_line IS NOT NULL AND season_type = 'REG'
  QUALIFY rank() OVER (PARTITION BY game_id ORDER BY play_id DESC) = 1)"""

_ORDER_GAMES = """SELECT game_id, posteam, season, first(home_team ORDER BY {tie}) AS home_team,
    first(away_team ORDER BY {tie}) AS away_team, first(spread_line ORDER BY {tie}) AS spread_line,
    first(total_line ORDER BY {tie}) AS total_line, count(*) AS off_plays,
    count(DISTINCT CASE WHEN play_type = 'pass' THEN play_id END) AS passes
  FROM order_plays WHERE score_differential IS NOT NULL AND season_type = 'REG' AND posteam <> ''
    AND play_type IN ('run', 'pass') GROUP BY game_id, posteam, season""".format(tie=", ".join(V.PLAY_TIE))


def density_sql(source: str, keys: str, value: str, bins: int, points: int) -> str:
    """CTEs for a binned Gaussian density; ends in ``curves``."""
    return f"""dvals AS (SELECT {keys} AS k, CAST({value} AS DOUBLE) AS v FROM {source} WHERE {value} IS NOT NULL),
dstats AS (
  SELECT k, count(*) AS n, stddev_samp(v) AS sd, min(v) AS lo, max(v) AS hi,
    quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM dvals GROUP BY k),
dband AS (
  SELECT *, (hi - lo) / {bins}.0 AS step, 0.9 * (CASE WHEN least(sd, iqr / 1.34) > 0 THEN least(sd, iqr / 1.34)
    WHEN sd > 0 THEN sd ELSE 1.0 END) * pow(n, -0.2) AS bw FROM dstats),
dbins AS (
  SELECT d.k, CASE WHEN step > 0 THEN least(floor((v - lo) / step), {bins} - 1) ELSE 0 END AS b, count(*) AS c
  FROM dvals d JOIN dband s ON d.k = s.k GROUP BY ALL),
dgrid AS (
  SELECT s.*, b.b, b.c, p.point, s.lo + (s.hi - s.lo) * p.point / {points - 1}.0 AS x
  FROM dbins b JOIN dband s ON b.k = s.k, (SELECT unnest(range(0, {points})) AS point) p),
curves AS (
  SELECT k, CAST(point AS INT) AS point, max(x) AS x,
    sum(c * exp(-0.5 * pow((x - (lo + (b + 0.5) * step)) / bw, 2))) / (max(n) * max(bw) * sqrt(2 * pi())) AS density,
    max(n) AS n
  FROM dgrid GROUP BY k, point)"""


QUERIES = {
    "q01_primary_by_group": (
        lambda s, d: P.primary_passer(V.event_plays(s, d)),
        f"WITH {EVENT_PLAYS}, {PRIMARY} SELECT * FROM primary_passer",
    ),
    "q02_recency_natural_join": (
        lambda s, d: P.passer_recency(V.event_plays(s, d)),
        f"WITH {EVENT_PLAYS}, {PRIMARY}, {RECENCY} SELECT * FROM recency",
    ),
    "q03_game_table": (
        lambda s, d: tidy(P.game_table(V.order_plays(s, d), V.PLAY_TIE)),
        f"""WITH {ORDER_PLAYS}, g AS ({_ORDER_GAMES})
        SELECT *, off_plays - passes AS rushes,
          CASE WHEN posteam = home_team THEN spread_line ELSE -spread_line END + 0.0 AS off_spread,
          total_line / 2 + (CASE WHEN posteam = home_team THEN spread_line ELSE -spread_line END) / 2 AS off_implied
        FROM g""",
    ),
    "q04_rolling": (
        lambda s, d: tidy(P.rolling_passer_epa(V.event_plays(s, d))),
        f"""WITH {EVENT_PLAYS}, {PRIMARY}, {RECENCY}, {ROLLING}
        SELECT game_id, primary_passer_name, primary_passer_id, primary_passer_game_recency, posteam, play_id,
          {r6("epa", "roll_5_epa", "roll_10_epa", "roll_25_epa", "roll_50_epa")} FROM rolling""",
    ),
    "q04_rolling_by_game": (
        lambda s, d: tidy(P.game_table_with_rolls(V.event_plays(s, d))),
        f"{_CHAIN} SELECT {_GAME_COLUMNS} FROM game_table g LEFT JOIN rolling r ON g.game_id = r.game_id",
    ),
    "q04_rolling_by_team": (
        lambda s, d: tidy(P.game_table_with_rolls(V.event_plays(s, d), match_team=True)),
        f"{_CHAIN} SELECT {_GAME_COLUMNS} FROM game_table g LEFT JOIN rolling r "
        "ON g.game_id = r.game_id AND g.posteam = r.posteam",
    ),
    "q04_correlations": (
        lambda s, d: P.play_correlations(P.game_table_with_rolls(V.event_plays(s, d)), digits=6),
        _correlation_sql(),
    ),
    "q05_season_efficiency": (
        lambda s, d: arrange(tidy(P.season_efficiency(V.order_plays(s, d), V.rosters(s, d))), "-aya", "season"),
        f"""WITH {ORDER_PLAYS}, {ROSTERS}, {QUALIFIED}
        SELECT season, {r6("adj_passers")}, dropbacks, {r6("aya", "ep", "epa")} FROM season_eff""",
    ),
    "q06_success_rate": (
        lambda s, d: tidy(
            P.career_efficiency(
                V.order_plays(s, d), V.rosters(s, d), play_key=("game_id", "play_id", "l_partkey", "l_extendedprice")
            )
        ),
        f"""WITH {ORDER_PLAYS}, {ROSTERS}, {QUALIFIED},
        bars AS (SELECT q.*, max(e.epa) OVER (PARTITION BY passer_id, full_name) AS bar
          FROM qualified q LEFT JOIN (SELECT season, epa FROM season_eff) e USING (season) WHERE full_name IS NOT NULL),
        career AS (SELECT passer_id, full_name, count(*) AS dropbacks,
          avg(CASE WHEN epa > bar THEN 1.0 ELSE 0.0 END) AS season_sr, avg(yards_gained) AS aya, avg(ep) AS ep_,
          round(avg(epa), 3) AS epa_ FROM (SELECT * EXCLUDE (epa), CAST(epa AS DOUBLE) AS epa FROM bars)
          GROUP BY passer_id, full_name)
        SELECT passer_id, full_name, dropbacks, {r6("season_sr", "aya")}, round(ep_, 6) + 0.0 AS ep,
          round(epa_, 6) + 0.0 AS epa FROM career""",
    ),
    "q07_drive_rollup": (
        lambda s, d: arrange(tidy(P.red_zone(V.order_plays(s, d), None)), "-ep", "posteam", "season"),
        f"""WITH {ORDER_PLAYS},
        drives AS (SELECT posteam, season, game_id, drive, count(*) AS plays, max(ep) AS ep, sum(epa) AS epa
          FROM order_plays WHERE yardline_100 <= 20 AND play_type IN ('pass', 'run', 'field_goal') GROUP BY ALL),
        teams AS (SELECT posteam, season, count(*) AS drives, CAST(sum(plays) AS BIGINT) AS plays, sum(epa) AS epa,
          sum(ep) AS ep FROM drives GROUP BY ALL)
        SELECT posteam, season, drives, plays, {r6("epa")}, round(epa / plays, 6) + 0.0 AS epa_play, {r6("ep")},
          round(ep / drives, 6) + 0.0 AS ep_rzdrive FROM teams""",
    ),
    "q07_red_zone_season": (
        lambda s, d: tidy(P.red_zone(V.order_plays(s, d), 2000).select("posteam", "season", "drives", "plays", "ep")),
        f"""WITH {ORDER_PLAYS},
        drives AS (SELECT posteam, season, game_id, drive, count(*) AS plays, max(ep) AS ep
          FROM order_plays WHERE season = 2000 AND yardline_100 <= 20 GROUP BY ALL)
        SELECT posteam, season, count(*) AS drives, CAST(sum(plays) AS BIGINT) AS plays, round(sum(ep), 6) + 0.0 AS ep
        FROM drives GROUP BY ALL""",
    ),
    "q08_last_row_share": (
        lambda s, d: arrange(P.score_differentials(V.order_plays(s, d)), "-n", "score_differential"),
        f"""WITH {ORDER_PLAYS}, last AS (
          SELECT game_id, play_id, score_differential FROM order_plays
          WHERE score_differential IS NOT NULL AND season_type = 'REG'
          QUALIFY rank() OVER (PARTITION BY game_id ORDER BY play_id DESC) = 1),
        counts AS (SELECT score_differential, count(*) AS n FROM last GROUP BY 1),
        shares AS (SELECT *, round(n / sum(n) OVER () * 100, 1) AS pct FROM counts)
        SELECT score_differential, n, pct, round(sum(pct) OVER (ORDER BY n DESC, score_differential
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) + 0.0 AS sum FROM shares""",
    ),
    "q08_quantile_bands": (
        lambda s, d: tidy(P.total_bands(V.order_plays(s, d), cell=4.0)),
        f"""WITH {ORDER_PLAYS}, {CLOSING}
        SELECT total_line, count(*) AS n, round(quantile_cont(total, 0.2), 6) + 0.0 AS lower,
          round(quantile_cont(total, 0.5), 6) + 0.0 AS median, round(quantile_cont(total, 0.8), 6) + 0.0 AS upper
        FROM closing GROUP BY total_line HAVING count(*) > 10""",
    ),
    "q25_band_per_row": (
        lambda s, d: tidy(P.total_outcomes(V.order_plays(s, d), cell=4.0)),
        f"""WITH {ORDER_PLAYS}, {CLOSING},
        b AS (SELECT *, count(*) OVER w AS n, quantile_cont(total, 0.5) OVER w AS med,
          quantile_cont(total, 0.975) OVER w AS upper, quantile_cont(total, 0.025) OVER w AS lower
          FROM closing WINDOW w AS (PARTITION BY total_line))
        SELECT game_id, play_id, total, total_line, n, {r6("med", "upper", "lower")} FROM b WHERE n > 10""",
    ),
    "q25_density": (
        lambda s, d: tidy(P.total_density(V.order_plays(s, d), cell=4.0)),
        f"""WITH {ORDER_PLAYS}, {CLOSING}, {density_sql("closing", "total_line", "total", 256, 64)}
        SELECT k AS total_line, point, {r6("x", "density")}, n FROM curves WHERE n > 10""",
    ),
}
