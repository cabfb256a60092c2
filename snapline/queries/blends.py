"""Queries over expected points, projection blends, stat tables and text rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.ordering import best_first
from ..plans import blend as B
from ..sources import standins as V
from .common import r6, tidy

POINTS = """points AS (
  SELECT CAST(year(ts) AS VARCHAR) AS season, CAST(ceil(day(ts) / 7.0) AS INT) AS week,
    CAST(user_id AS VARCHAR) AS player_id, 'Player ' || user_id AS full_name,
    ['WR', 'TE', 'RB', 'QB'][user_id % 4 + 1] AS position,
    CASE WHEN event_type = 'view' THEN 'LA' ELSE upper(event_type) END AS posteam,
    value * 3 / 300 * 3 + value / 100 * 3 + value / 2 / 100 * 3 AS bonus, value / 4 AS raw_points, event_id
  FROM events),
weekly AS (
  SELECT player_id, full_name AS name, position, CASE WHEN posteam = 'LA' THEN 'LAR' ELSE posteam END AS team,
    round_even(raw_points + bonus, 0) + 0.0 AS oep FROM points)"""

STATS = """keyed_orders AS (
  SELECT o_custkey AS k, CAST(count(*) AS DOUBLE) AS targets,
    CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS DOUBLE) AS catches,
    CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100000000 AS rec_yd,
    CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS DOUBLE) AS rec_td,
    CAST(sum(CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END) AS DOUBLE) AS fum_l
  FROM orders GROUP BY 1),
keyed_lines AS (
  SELECT l_suppkey AS k, CAST(count(*) AS DOUBLE) AS rush, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS rush_yd,
    CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS DOUBLE) AS rush_td,
    CAST(sum(CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END) AS DOUBLE) AS fum_l
  FROM lineitem GROUP BY 1),
keyed_parts AS (
  SELECT p_partkey AS k, CAST(p_size AS DOUBLE) AS attempts, p_retailprice AS pass_yd,
    CAST(p_size % 7 AS DOUBLE) AS touchdowns, CAST(p_size % 3 AS DOUBLE) AS fum_l FROM part)"""

_KEYS = """'P' || k AS name, CASE WHEN k % 17 <> 0 THEN 'T' || (k % 32) END AS team, 'T' || ((k + 5) % 32) AS opponent"""
_NUM = ["targets", "catches", "rec_yd", "rec_td", "rush", "rush_yd", "rush_td", "attempts", "pass_yd", "touchdowns"]
_FILLED = ", ".join(f"coalesce({c}, 0.0) AS {c}" for c in _NUM)
_TOTALS = "targets + rush AS opps, rec_yd + rush_yd + pass_yd AS yards, rec_td + rush_td + touchdowns AS tds"

BLENDED = f"""{STATS}, filled AS (
  SELECT coalesce(a.k, b.k, c.k) AS k, {_FILLED},
    coalesce(a.fum_l, 0) + coalesce(b.fum_l, 0) + coalesce(c.fum_l, 0) AS fum_l
  FROM keyed_orders a FULL JOIN keyed_lines b ON a.k = b.k FULL JOIN keyed_parts c ON coalesce(a.k, b.k) = c.k),
blended AS (SELECT {_KEYS}, k, *  EXCLUDE (k), {_TOTALS} FROM filled)"""

LITERAL = f"""{STATS}, two AS (
  SELECT coalesce(a.k, b.k) AS k, coalesce(a.fum_l, b.fum_l) AS fum_l, a.* EXCLUDE (k, fum_l), b.* EXCLUDE (k, fum_l)
  FROM keyed_orders a FULL JOIN keyed_lines b ON a.k = b.k AND a.fum_l = b.fum_l),
filled AS (
  SELECT coalesce(t.k, c.k) AS k, {_FILLED}, coalesce(t.fum_l, 0) + coalesce(c.fum_l, 0) AS fum_l
  FROM two t FULL JOIN keyed_parts c ON t.k = c.k),
blended AS (SELECT {_KEYS}, * EXCLUDE (k), {_TOTALS} FROM filled)"""

_STAT_COLS = "name, team, opponent, " + r6("opps", "yards", "tds", *_NUM, "fum_l")

# Rules of our own in the style of the name rules, for the words of part names.
PART_RULES = (
    ("red ring", "red ring II"),
    ("red ring II II", "red ring II"),
    ("b.ue bolt", "blue-bolt"),
    ("old gear", "new gear"),
    ("new gear", "new gear Jr."),
)


def _sql_rules(column: str, rules) -> str:
    for pattern, text in rules:
        column = f"regexp_replace({column}, '{pattern}', '{text}', 'g')"
    return column


# Names and what the rules are expected to make of them, written by hand.
_EXPECTED = (
    ("Allen Robinson", "Allen Robinson II"),
    ("Allen Robinson II", "Allen Robinson II"),
    ("Darrell Henderson", "Darrell Henderson Jr."),
    ("D.J. Moore", "DJ Moore"),
    ("D.J. Moore Sr", "DJ Moore Sr"),
    ("Robby Anderson", "Robbie Anderson"),
    ("Marvin Jones", "Marvin Jones Jr."),
    ("Marvin Jones Jr.", "Marvin Jones Jr. Jr."),
    ("D.J. Chark", "DJ Chark Jr."),
    ("Travis Etienne", "Travis Etienne Jr."),
    ("Melvin Gordon", "Melvin Gordon III"),
    ("Cedrick Wilson", "Cedrick Wilson Jr."),
    ("Jeffery Wilson", "Jeff Wilson Jr."),
    ("Jeffrey Wilson", "Jeff Wilson Jr."),
    ("Mark Ingram", "Mark Ingram II"),
    ("Mark Ingram II", "Mark Ingram II"),
    ("Richie James", "Richie James Jr."),
    ("Kenneth Walker", "Kenneth Walker III"),
    ("Kenneth Walker III", "Kenneth Walker III"),
    ("Taysom Hill", "Taysom Hill"),
)
_SAMPLES = [raw for raw, _ in _EXPECTED]
_SQL_EXPECTED = "[" + ", ".join(f"'{fixed}'" for _, fixed in _EXPECTED) + "]"


def _points(s, d):
    return V.expected_points(s, d)


def _blended(s, d):
    return B.blend_stats(*V.stat_tables(s, d))


def _name_rules(s, d):
    p = V.table(s, d, "part")
    n = len(_SAMPLES)
    names = F.element_at(F.array(*[F.lit(x) for x in _SAMPLES]), (F.col("p_partkey") % n + 1).cast("int"))
    base = p.select(
        "p_partkey", names.alias("name"), F.when(F.col("p_size") % 3 == 0, "LA").when(F.col("p_size") % 3 == 1, "KC").alias("team"),
        F.lit("WR").alias("position"), X.apply_rules("p_name", PART_RULES).alias("part_name"),
    )
    return X.standard_names(base)


def _slate_blend(s, d):
    return B.blend_projection(V.blend_slate(s, d), B.weekly_points(_points(s, d)), B.roster_names(V.blend_rosters(s, d)))


def _usage(s, d):
    return B.usage_per_salary(_blended(s, d), V.salaries(s, d))


_HIGH = ("Player 1", "Player 2", "Player 3")
_SECOND = ("Player 4",)
_OTHER = ("Player 5", "Player 6", "Player 7")

QUERIES = {
    "q13_full_outer_blend": (
        lambda s, d: tidy(_blended(s, d)),
        f"WITH {BLENDED} SELECT {_STAT_COLS} FROM blended",
    ),
    "q13_literal_key_blend": (
        lambda s, d: tidy(B.blend_stats(*V.stat_tables(s, d), literal_keys=True)),
        f"WITH {LITERAL} SELECT {_STAT_COLS} FROM blended",
    ),
    "q13_stat_charts": (
        lambda s, d: tidy(B.stat_charts(_blended(s, d), ("T3", "T4", "T20"))),
        f"""WITH {BLENDED}, t AS (SELECT * FROM blended WHERE team IN ('T3', 'T4', 'T20')), bars AS (
          SELECT name, team, 'opps' AS chart, opps AS shown FROM t
          UNION ALL SELECT name, team, 'rush_yd', rush_yd FROM t WHERE rush_yd > 0
          UNION ALL SELECT name, team, 'bad_yards', rush * 3 FROM t WHERE rush * 3 > 0
          UNION ALL SELECT name, team, 'rec_yd', rec_yd FROM t WHERE rec_yd > 0
          UNION ALL SELECT name, team, 'catches', catches FROM t WHERE catches > 0
          UNION ALL SELECT name, team, 'yards', yards FROM t WHERE rec_yd > 0)
        SELECT name, team, chart, round(shown, 6) + 0.0 AS shown,
          CAST(row_number() OVER (PARTITION BY chart ORDER BY shown NULLS LAST, name) AS INT) AS bar FROM bars""",
    ),
    "q13_usage_per_salary": (
        lambda s, d: tidy(
            best_first(_usage(s, d), [], "usg_1k", ["name", "team"], "place").select(
                "name", "team", "position", "opponent", "salary", "usg", "opps_1k", "usg_1k", "place"
            )
        ),
        f"""WITH {BLENDED}, used AS (SELECT name, team, ['WR', 'TE', 'RB', 'QB'][c_custkey % 4 + 1] AS position,
          CASE WHEN c_custkey IS NOT NULL THEN 'T' || ((c_custkey + 5) % 32) END AS opponent,
          CAST(sal AS INT) AS salary, opps + attempts AS usg, opps / (nullif(sal, 0) / 1000) AS opps_1k,
          (opps + attempts) / (nullif(sal, 0) / 1000) AS usg_1k
        FROM blended LEFT JOIN (SELECT c_custkey, CASE WHEN c_custkey % 29 = 0 THEN 0 ELSE 3000 + 100 * (c_custkey % 60)
          END AS sal FROM customer) ON k = c_custkey)
        SELECT name, team, position, opponent, salary, {r6("usg", "opps_1k", "usg_1k")},
          row_number() OVER (ORDER BY usg_1k DESC NULLS LAST, name NULLS LAST, team NULLS LAST) AS place FROM used""",
    ),
    "q14_last6_mean": (
        lambda s, d: B.recent_points(_points(s, d), 6, ("event_id",)),
        f"""WITH {POINTS}, recent AS (SELECT * FROM points
          QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY season DESC, week DESC, event_id DESC) <= 6),
        m AS (SELECT player_id, full_name AS name, position,
          first(posteam ORDER BY season DESC, week DESC, event_id DESC) AS team,
          round_even(avg(raw_points + bonus), 0) + 0.0 AS oep FROM recent GROUP BY player_id, full_name, position)
        SELECT player_id, name, CASE WHEN team = 'LA' THEN 'LAR' ELSE team END AS team, position, oep FROM m""",
    ),
    "q14_weekly_points": (
        lambda s, d: B.weekly_points(_points(s, d)),
        f"WITH {POINTS} SELECT player_id, name, position, team, oep FROM weekly",
    ),
    "q14_watched_players": (
        lambda s, d: tidy(B.watched_points(_points(s, d), _HIGH, _SECOND, _OTHER)),
        f"""WITH {POINTS} SELECT full_name, season, week, round(raw_points, 6) + 0.0 AS oep,
          CASE WHEN full_name IN {_HIGH} THEN 'gold' WHEN full_name = '{_SECOND[0]}' THEN 'black' ELSE 'green' END AS line_color
        FROM points WHERE full_name IN {_HIGH + _SECOND + _OTHER}""",
    ),
    "q15_blend_projection": (
        lambda s, d: tidy(_slate_blend(s, d)),
        f"""WITH {POINTS}, teams AS (SELECT ['LAR', 'CLICK', 'SIGNUP', 'PURCHASE', 'ERROR'] AS t),
        slate AS (SELECT p_partkey AS k, 'Player ' || p_partkey AS name, t[p_partkey % 5 + 1] AS team,
          t[(p_partkey + 1) % 5 + 1] AS opp, CAST(3000 + 100 * (p_partkey % 60) AS INT) AS salary,
          CASE WHEN p_type = 'PROMO' THEN 'DST' ELSE ['WR', 'TE', 'RB', 'QB'][p_partkey % 4 + 1] END AS position,
          p_size / 2 AS projection, p_size / 6 AS std_dev FROM part, teams),
        roster AS (SELECT 'R' || c_custkey AS player_id, 'Player ' || c_custkey AS name,
          ['WR', 'TE', 'RB', 'QB'][c_custkey % 4 + 1] AS position, t[c_custkey % 5 + 1] AS team FROM customer, teams),
        coded AS (SELECT s.*, w.oep AS points, coalesce(w.player_id, r.player_id) AS pid,
          dense_rank() OVER (ORDER BY s.name) AS code
          FROM slate s LEFT JOIN weekly w ON s.name = w.name AND s.team = w.team AND s.position = w.position
          LEFT JOIN roster r ON s.name = r.name AND s.team = r.team AND s.position = r.position)
        SELECT name, team, opp, salary, position,
          round(projection * 0.85 + coalesce(points, round_even(projection, 0)) * 0.15, 6) + 0.0 AS projection,
          {r6("std_dev")}, CASE WHEN position = 'DST' THEN '00-' || code ELSE pid END AS player_id,
          coalesce(points, round_even(projection, 0)) + 0.0 AS oep FROM coded""",
    ),
    "q16_name_rules": (
        _name_rules,
        f"""WITH n AS (SELECT p_partkey, {_SQL_EXPECTED}[p_partkey % {len(_SAMPLES)} + 1] AS name, p_name,
          CASE p_size % 3 WHEN 0 THEN 'LAR' WHEN 1 THEN 'KC' END AS team FROM part),
        f AS (SELECT p_partkey, name, team, {_sql_rules("p_name", PART_RULES)} AS part_name FROM n)
        SELECT p_partkey, name, team, CASE WHEN name = 'Taysom Hill' THEN 'TE' ELSE 'WR' END AS position, part_name FROM f""",
    ),
}
