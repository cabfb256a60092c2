"""Queries over simulated slates, lineups, exposure and the lineup grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.reshape import nest_rows
from ..plans import lineups as L
from ..plans import scoring as S
from ..plans import showdown as D
from ..plans import simulate as M
from ..sources import standins as V
from .common import r6, tidy

SEED = 20240101
LINEUP_SEED = 20240202
SLATES = 15
SHOWDOWN_SLATES = 25
SHOWDOWN_LINEUPS = 5
FEW, MANY = 3, 150
KEPT = 15
GRID_KEPT = 150

PLAYERS = """part_numbers AS (
  SELECT *, CAST(regexp_extract(p_brand, '[0-9]+') AS INT) AS num FROM part),
players AS (
  SELECT p_name || ' ' || translate(CAST(p_partkey AS VARCHAR), '0123456789', 'abcdefghij') AS name,
    CASE WHEN num = 25 THEN 'FA' ELSE 'B' || chr(num + 64) END AS team,
    CASE WHEN num = 25 THEN NULL WHEN num % 2 = 1 THEN 'B' || chr(num + 65) ELSE 'B' || chr(num + 63) END AS opp,
    CASE p_type WHEN 'ECONOMY' THEN 'QB' WHEN 'SMALL' THEN 'RB' WHEN 'MEDIUM' THEN 'WR' WHEN 'LARGE' THEN 'TE'
      WHEN 'PROMO' THEN 'DST' WHEN 'STANDARD' THEN 'K' END AS pos,
    CAST(3000 + 100 * (p_partkey * 7 % 60) AS INT) AS salary, p_size / 2 AS projection, p_size / 6 AS std_dev,
    p_partkey, p_size
  FROM part_numbers)"""


def _uniform(seed: int, key: str, salt: str) -> str:
    text = f"concat_ws('|', '{seed}', CAST(slate AS VARCHAR), {key}, '{salt}')"
    return f"((CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)"


def _normal(seed: int, key: str) -> str:
    return (
        f"sqrt(-2.0 * ln({_uniform(seed, key, 'u1')})) * cos(6.283185307179586 * {_uniform(seed, key, 'u2')})"
    )


def _slates(n: int) -> str:
    return f"(SELECT CAST(unnest(range(1, {n + 1})) AS INT) AS slate)"


def _draws(name: str, seed: int, randomness: float, source: str = "players", slates: int = SLATES) -> str:
    return f"""{name}_draws AS (
  SELECT *  EXCLUDE (projection), greatest(-2.0, projection + std_dev * {1 + randomness} * {_normal(seed, "name, team, pos")}) AS p
  FROM {source}, {_slates(slates)})"""


def _linked(name: str) -> str:
    """The passer link as separate branches per position, united."""
    d = f"{name}_draws"
    return f"""{name}_qb AS (SELECT slate, team, opp, sum(CASE WHEN p > 0 THEN p ELSE 0 END) AS qb
  FROM {d} WHERE pos = 'QB' GROUP BY ALL),
{name}_own AS (SELECT slate, team, sum(qb) AS qb FROM {name}_qb GROUP BY ALL),
{name}_opp AS (SELECT slate, opp AS team, sum(qb) AS qb FROM {name}_qb GROUP BY ALL),
{name}_rest AS (SELECT *, p / nullif(sum(CASE WHEN p > 0 THEN p ELSE 0 END) OVER w, 0) AS pos_share,
  p / nullif(sum(p) OVER w, 0) AS all_share FROM {d} WHERE pos <> 'QB' WINDOW w AS (PARTITION BY slate, team)),
{name} AS (
  SELECT slate, name, team, pos, salary, p AS score FROM {d} WHERE pos IN ('QB', 'RB')
  UNION ALL SELECT slate, name, team, pos, salary, qb * pos_share * 0.64 + p * (1 - 0.64)
    FROM {name}_rest LEFT JOIN {name}_own USING (slate, team) WHERE pos = 'WR' AND team <> 'FA'
  UNION ALL SELECT slate, name, team, pos, salary, qb * all_share * 0.35 + p * (1 - 0.35)
    FROM {name}_rest LEFT JOIN {name}_own USING (slate, team) WHERE pos = 'TE' AND team <> 'FA'
  UNION ALL SELECT slate, name, team, pos, salary, qb * -0.47 + p * 1.47
    FROM {name}_rest LEFT JOIN {name}_opp USING (slate, team) WHERE pos = 'DST' AND team <> 'FA')"""


SIMULATED = f"{PLAYERS}, {_draws('sim', SEED, 1.0)}, {_linked('sim')}"
PICKED = f"{_draws('pick', LINEUP_SEED, 0.0)}, {_linked('pick')}"


def _four_digits(millionths: str) -> str:
    """Whole millionths as a number of four digits, halves away from zero."""
    return f"sign({millionths}) * ((abs({millionths}) + 50) // 100) / 10000.0"


def _best_sql(name: str, source: str) -> str:
    """Best lineup per slate: pool cut by counting dominators pair by pair, then plain combinations."""
    need = {"QB": 1, "RB": 3, "WR": 4, "TE": 2, "DST": 1}
    depth = " ".join(f"WHEN '{p}' THEN {k}" for p, k in need.items())

    def combos(pos: str, k: int) -> str:
        a = [f"x{i}" for i in range(k)]
        tables = ", ".join(f"{name}_pool {x}" for x in a)
        same = " AND ".join([f"{x}.pos = '{pos}'" for x in a] + [f"{x}.slate = x0.slate" for x in a[1:]])
        order = " AND ".join(f"{x}.name < {y}.name" for x, y in zip(a, a[1:]))
        return (
            f"SELECT x0.slate, {' + '.join(x + '.salary' for x in a)} AS cost, {' + '.join(x + '.gain' for x in a)} AS total, "
            f"[{', '.join(x + '.name' for x in a)}] AS members FROM {tables} WHERE {same}{' AND ' + order if order else ''}"
        )

    def reduced(sql: str) -> str:
        return (
            f"SELECT slate, cost, max(total) AS total, arg_max(members, total) AS members FROM ({sql}) "
            "WHERE cost <= 50000 GROUP BY slate, cost"
        )

    def pair(a: str, b: str) -> str:
        return (
            f"SELECT a.slate, a.cost + b.cost AS cost, a.total + b.total AS total, a.members || b.members AS members "
            f"FROM {a} a JOIN {b} b ON a.slate = b.slate AND a.cost + b.cost <= 50000"
        )

    parts = [
        f"{name}_pool AS MATERIALIZED (SELECT * FROM (SELECT slate, name, pos, salary, round(score, 6) AS gain FROM {source} "
        f"WHERE score IS NOT NULL) x WHERE (SELECT count(*) FROM (SELECT slate, name, pos, salary, round(score, 6) AS gain "
        f"FROM {source}) y WHERE y.slate = x.slate AND y.pos = x.pos AND y.salary <= x.salary AND (y.gain > x.gain OR "
        f"(y.gain = x.gain AND (y.salary < x.salary OR (y.salary = x.salary AND y.name < x.name))))) < CASE x.pos {depth} END)"
    ]
    for pos, k in (("QB", 1), ("DST", 1), ("RB", 2), ("RB", 3), ("WR", 3), ("WR", 4), ("TE", 1), ("TE", 2)):
        parts.append(f"{name}_{pos}{k} AS MATERIALIZED ({reduced(combos(pos, k))})")
    shapes = []
    for rb, wr, te in ((3, 3, 1), (2, 4, 1), (2, 3, 2)):
        key = f"{name}_{rb}{wr}{te}"
        parts.append(f"{key}_a AS MATERIALIZED ({reduced(pair(f'{name}_RB{rb}', f'{name}_WR{wr}'))})")
        parts.append(f"{key} AS MATERIALIZED ({reduced(pair(key + '_a', f'{name}_TE{te}'))})")
        shapes.append(f"SELECT * FROM {key}")
    parts.append(f"{name}_core AS MATERIALIZED ({reduced(' UNION ALL '.join(shapes))})")
    parts.append(f"{name}_qd AS MATERIALIZED ({reduced(pair(f'{name}_QB1', f'{name}_DST1'))})")
    parts.append(
        f"{name}_best AS MATERIALIZED (SELECT slate, {_four_digits('CAST(round(max(total) * 1000000) AS BIGINT)')} AS lineup_points, arg_max(cost, total) AS lineup_salary, "
        f"arg_max(members, total) AS members FROM ({pair(f'{name}_core', f'{name}_qd')}) GROUP BY slate)"
    )
    parts.append(
        f"{name}_members AS MATERIALIZED (SELECT b.slate, 1 AS lineup, lineup_points, lineup_salary, s.name AS player, s.team, "
        f"s.pos AS position, s.salary, s.score AS fpts_proj FROM (SELECT slate, lineup_points, lineup_salary, "
        f"unnest(members) AS name FROM {name}_best) b JOIN {source} s ON b.slate = s.slate AND b.name = s.name)"
    )
    return ", ".join(parts)


# Bounds in SQL: a price for salary per slate, the smallest of a fixed list of multiples, and from it how far players
# and groups may fall behind the best ones.
_STEPS = "(SELECT unnest([0.0] || [pow(2.0, x / 8.0) FOR x IN range(-48, 49)]) AS step)"
_SPARE = 16.0


def _exact(score: str) -> str:
    """Millionths of a point, and among equals the cheaper first."""
    return f"CAST(round(round({score}, 6) * 1000000) AS BIGINT) * 65536 - salary AS gain"


_POINTS = f"{_four_digits('((total + cost) // 65536)')} AS lineup_points"


def _groups_sql(name: str, pool: str, key: str, part: str, n: int, room: str | None) -> str:
    """Groups of ``n`` rows of ``pool`` by rising rank; with ``room`` only while their loss leaves as much."""
    rows = [f"x{i}" for i in range(n)]
    tables = [f"{pool} x0"]
    for i, x in enumerate(rows[1:], 1):
        same = " AND ".join(f"{x}.{k} = x0.{k}" for k in key.split(", "))
        lost = " + ".join(f"({y}.s{j + 1} - {y}.worth)" for j, y in enumerate(rows[: i + 1]))
        bound = f" AND {lost} <= x0.{room} + {_SPARE}" if room else ""
        tables.append(f"JOIN {pool} {x} ON {same} AND {x}.rank > {rows[i - 1]}.rank AND {part.format(x)}{bound}")
    lost = " + ".join(f"(x0.s{j + 1} - {y}.worth)" for j, y in enumerate(rows))
    first = f" AND {lost} <= x0.{room} + {_SPARE}" if room else ""
    return (
        f"{name} AS MATERIALIZED (SELECT {', '.join('x0.' + k for k in key.split(', '))}, {lost} AS loss, "
        f"{' + '.join(x + '.salary' for x in rows)} AS cost, {' + '.join(x + '.gain' for x in rows)} AS total, "
        f"[{', '.join(x + '.name' for x in rows)}] AS members, [{', '.join(x + '.team' for x in rows)}] AS teams "
        f"FROM {' '.join(tables)} WHERE {part.format('x0')}{first})"
    )


def _some_best_sql(name: str, source: str, best: int) -> str:
    """The ``best`` lineups of every slate of ``source``: combinations within the bound, from a few lineups' reach."""
    most = {"QB": 1, "RB": 3, "WR": 4, "TE": 2, "DST": 1}
    shapes = {"a": (3, 3, 1), "b": (2, 4, 1), "c": (2, 3, 2)}
    need = " ".join(f"WHEN '{p}' THEN {n}" for p, n in most.items())

    def total(shape: tuple) -> str:
        sizes = zip(("RB", "WR", "TE", "QB", "DST"), (*shape, 1, 1), strict=True)
        return " + ".join(f"sum(CASE WHEN pos = '{p}' AND rank <= {n} THEN worth END)" for p, n in sizes)

    bounds = ", ".join(f"price * 50000 + {total(shape)} AS u_{j}" for j, shape in shapes.items())
    each = ", ".join(f"max(CASE WHEN rank = {j} THEN worth END) OVER (PARTITION BY slate, pos) AS s{j}" for j in (1, 2, 3, 4))
    parts = [
        f"{name}_pool AS MATERIALIZED (SELECT slate, name, team, pos, salary, {_exact('score')} FROM {source} "
        f"WHERE score IS NOT NULL AND pos IN ('QB', 'RB', 'WR', 'TE', 'DST') QUALIFY row_number() OVER (PARTITION BY slate, pos, salary "
        f"ORDER BY score DESC, name) < CASE pos {need} END + {best})",
        f"{name}_prices AS (SELECT DISTINCT slate, price FROM (SELECT slate, step * (max(gain) - min(gain)) / 50000 AS price "
        f"FROM {name}_pool, {_STEPS} GROUP BY slate, step))",
        f"{name}_tops AS (SELECT slate, price, pos, gain - price * salary AS worth, row_number() OVER (PARTITION BY slate, price, pos "
        f"ORDER BY gain - price * salary DESC) AS rank FROM {name}_pool JOIN {name}_prices USING (slate) QUALIFY rank <= 4)",
        f"{name}_bounds AS (SELECT slate, price, {bounds} FROM {name}_tops GROUP BY slate, price)",
        f"{name}_known AS MATERIALIZED (SELECT * FROM {name}_bounds QUALIFY row_number() OVER (PARTITION BY slate "
        f"ORDER BY greatest(u_a, u_b, u_c), price) = 1)",
        f"{name}_all AS MATERIALIZED (SELECT *, gain - price * salary AS worth, row_number() OVER (PARTITION BY slate, pos "
        f"ORDER BY gain - price * salary DESC, salary, name) AS rank FROM {name}_pool JOIN {name}_known USING (slate))",
        f"{name}_ranked AS MATERIALIZED (SELECT *, {each} FROM {name}_all)",
        f"{name}_first AS (SELECT * FROM {name}_ranked WHERE rank <= CASE pos {need} END + 2)",
    ]

    def lineups(out: str, pool: str, room: str | None) -> None:
        for pos, n in (("QB", 1), ("DST", 1), ("TE", 1), ("TE", 2), ("RB", 2), ("RB", 3), ("WR", 3), ("WR", 4)):
            parts.append(_groups_sql(f"{out}_{pos}{n}", pool, "slate", f"{{}}.pos = '{pos}'", n, room))
        ends = []
        for j, (rb, wr, te) in shapes.items():
            left = f"{out}_QB1"
            for i, right in enumerate((f"DST1", f"TE{te}", f"RB{rb}", f"WR{wr}")):
                to = f"{out}_{j}{i}"
                bound = f" AND a.loss + b.loss <= k.u_{j} - r.reach + {_SPARE}" if room else ""
                reach = f"JOIN {name}_reach r ON r.slate = a.slate " if room else ""
                parts.append(
                    f"{to} AS MATERIALIZED (SELECT a.slate, a.loss + b.loss AS loss, a.cost + b.cost AS cost, a.total + b.total AS total, "
                    f"a.members || b.members AS members FROM {left} a JOIN {name}_known k ON k.slate = a.slate {reach}"
                    f"JOIN {out}_{right} b ON b.slate = a.slate AND a.cost + b.cost <= 50000{bound})"
                )
                left = to
            ends.append(f"SELECT * FROM {left}")
        parts.append(f"{out}_whole AS MATERIALIZED ({' UNION ALL '.join(ends)})")

    lineups(f"{name}_f", f"{name}_first", None)
    parts.append(
        f"{name}_reach AS MATERIALIZED (SELECT slate, total AS reach FROM {name}_f_whole "
        f"QUALIFY row_number() OVER (PARTITION BY slate ORDER BY total DESC) = {best})"
    )
    parts.append(
        f"{name}_near AS MATERIALIZED (SELECT *, greatest(u_a, u_b, u_c) - reach AS room FROM {name}_ranked JOIN {name}_reach USING (slate) "
        f"WHERE worth >= CASE pos WHEN 'RB' THEN s3 WHEN 'WR' THEN s4 WHEN 'TE' THEN s2 ELSE s1 END - (greatest(u_a, u_b, u_c) - reach) - {_SPARE})"
    )
    lineups(f"{name}_g", f"{name}_near", "room")
    parts.append(
        f"{name}_best AS MATERIALIZED (SELECT slate, row_number() OVER (PARTITION BY slate ORDER BY total DESC, "
        f"list_sort(members)) AS lineup, {_POINTS}, cost AS lineup_salary, members FROM {name}_g_whole QUALIFY lineup <= {best})"
    )
    parts.append(
        f"{name}_members AS MATERIALIZED (SELECT b.slate, lineup, lineup_points, lineup_salary, s.name AS player, s.team, "
        f"s.pos AS position, s.salary, s.score AS fpts_proj FROM (SELECT slate, lineup, lineup_points, lineup_salary, "
        f"unnest(members) AS name FROM {name}_best) b JOIN {source} s ON b.slate = s.slate AND b.name = s.name)"
    )
    return ", ".join(parts)


def _showdown_best_sql(best: int) -> str:
    """The ``best`` showdown lineups of every slate and matchup of ``sd``, the flex players of each captain by themselves."""
    k = "slate, matchup"
    order = "gain - price * salary DESC, salary, name"
    bound = """price * 50000 + c.gain - price * c.salary + CASE WHEN f.rank <= 5 THEN s6 - f.worth ELSE s5 END"""
    parts = [
        f"c_pool AS MATERIALIZED (SELECT slate, matchup, player_id AS captain, team AS c_team, salary, {_exact('fpts_proj')} "
        "FROM sd WHERE position = 'CPTN' AND fpts_proj IS NOT NULL AND salary <= 50000)",
        f"f_pool AS MATERIALIZED (SELECT slate, matchup, player_id AS name, team, salary, {_exact('fpts_proj')} "
        "FROM sd WHERE position = 'FLEX' AND fpts_proj IS NOT NULL AND salary <= 50000)",
        f"sd_prices AS (SELECT DISTINCT {k}, price FROM (SELECT {k}, step * (max(gain) - min(gain)) / 50000 AS price "
        f"FROM f_pool, {_STEPS} GROUP BY {k}, step))",
        f"f_tops AS MATERIALIZED (SELECT {k}, price, name, gain - price * salary AS worth, row_number() OVER (PARTITION BY {k}, price "
        f"ORDER BY {order}) AS rank FROM f_pool JOIN sd_prices USING ({k}) QUALIFY rank <= 6)",
        f"f_sums AS (SELECT {k}, price, sum(CASE WHEN rank <= 5 THEN worth END) AS s5, sum(worth) AS s6, count(*) AS n FROM f_tops GROUP BY {k}, price)",
        f"c_bounds AS MATERIALIZED (SELECT c.*, price, {bound} AS u FROM c_pool c JOIN f_sums USING ({k}) LEFT JOIN f_tops f "
        f"USING ({k}, price) WHERE f.name = c.captain AND n = 6 UNION ALL SELECT c.*, price, price * 50000 + c.gain - price * c.salary + s5 "
        f"FROM c_pool c JOIN f_sums s USING ({k}) WHERE n >= 5 AND NOT EXISTS (SELECT 1 FROM f_tops f WHERE f.slate = c.slate AND "
        f"f.matchup = c.matchup AND f.price = s.price AND f.name = c.captain))",
        f"sd_known AS MATERIALIZED (SELECT {k}, price FROM (SELECT {k}, price, max(u) AS u FROM c_bounds GROUP BY {k}, price) "
        f"QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY u, price) = 1)",
        f"c_known AS MATERIALIZED (SELECT * FROM c_bounds JOIN sd_known USING ({k}, price))",
        f"f_known AS MATERIALIZED (SELECT *, gain - price * salary AS worth, row_number() OVER (PARTITION BY {k} ORDER BY {order}) AS of_all "
        f"FROM f_pool JOIN sd_known USING ({k}))",
    ]

    def lineups(out: str, captains: str, flexes: str, room: str | None, k: str = k) -> None:
        key = f"{k}, captain"
        parts.append(
            f"{out}_pool AS MATERIALIZED (SELECT {key}, f.name, f.team, f.salary, f.gain, f.worth{', room' if room else ''}, "
            f"row_number() OVER (PARTITION BY {key} ORDER BY f.worth DESC, f.salary, f.name) AS rank FROM {captains} c JOIN {flexes} f "
            f"USING ({k}) WHERE f.name <> c.captain{' AND f.lack <= room + 16' if room else ''})"
        )
        each = ", ".join(f"max(CASE WHEN rank = {j} THEN worth END) OVER (PARTITION BY {key}) AS s{j}" for j in range(1, 6))
        parts.append(f"{out}_ranked AS MATERIALIZED (SELECT *, {each} FROM {out}_pool)")
        parts.append(_groups_sql(f"{out}_five", f"{out}_ranked", key, "true", 5, room))
        parts.append(
            f"{out}_whole AS MATERIALIZED (SELECT DISTINCT slate, matchup, g.cost + c.salary AS cost, g.total + c.gain AS total, "
            f"['CPTN:' || captain] || list_sort(['FLEX:' || x FOR x IN members]) AS members FROM {out}_five g "
            f"JOIN c_known c USING (slate, matchup, captain) WHERE g.cost + c.salary <= 50000 AND len(list_distinct(teams || [c_team])) > 1)"
        )

    # First lineups at the best price and at dearer ones, where few of the others fit the cap, with some of each team.
    dear, order = "(SELECT unnest([1, 2, 4, 8, 16, 64]) AS m)", "gain - m * price * salary DESC"
    lineups(
        "h",
        f"(SELECT * FROM c_known, {dear} QUALIFY row_number() OVER (PARTITION BY {k}, m ORDER BY {order}) <= 6)",
        f"(SELECT * FROM f_known, {dear} QUALIFY row_number() OVER (PARTITION BY {k}, m ORDER BY {order}) <= 9 "
        f"OR row_number() OVER (PARTITION BY {k}, m, team ORDER BY {order}) <= 2)",
        None,
        f"{k}, m",
    )
    parts += [
        f"sd_reach AS MATERIALIZED (SELECT {k}, total AS reach FROM h_whole QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY total DESC) = {best})",
        f"c_near AS MATERIALIZED (SELECT c.*, u - coalesce(reach, '-inf'::DOUBLE) AS room FROM c_known c LEFT JOIN sd_reach USING ({k}) WHERE u >= coalesce(reach, '-inf'::DOUBLE) - 16)",
        f"f_near AS MATERIALIZED (SELECT f.*, last - f.worth AS lack FROM f_known f JOIN (SELECT {k}, min(worth) AS last FROM f_known WHERE of_all <= 6 GROUP BY {k}) USING ({k}))",
    ]
    lineups("i", "c_near", "f_near", "room")
    parts += [
        f"sd_best AS MATERIALIZED (SELECT {k}, row_number() OVER (PARTITION BY {k} ORDER BY total DESC, list_sort(members)) AS lineup, "
        f"{_POINTS}, cost AS lineup_salary, members FROM i_whole QUALIFY lineup <= {best})",
        f"sd_members AS MATERIALIZED (SELECT slate, matchup, lineup, lineup_points, lineup_salary, player_id, player, s.salary, team, position, pos, "
        f"fpts_proj FROM (SELECT * EXCLUDE (members), unnest(members) AS m FROM sd_best) b JOIN sd s USING ({k}) "
        f"WHERE s.position = substr(m, 1, 4) AND s.player_id = substr(m, 6))",
    ]
    return ", ".join(parts)


PICKED_BEST = f"{PICKED}, {_best_sql('pick', 'pick')}"
SAME_BEST = _best_sql("sim", "sim")
ONE_DRAWN = f"{_draws('one', SEED, 1.0, slates=1)}, {_linked('one')}"

SCORES = """scores AS (
  SELECT d.slate AS sim, m.slate, m.lineup, round(sum(d.score), 2) AS lineup_score
  FROM pick_members m JOIN sim d ON m.player = d.name AND m.team = d.team AND m.position = d.pos AND m.salary = d.salary
  GROUP BY ALL),
means AS (SELECT slate, lineup, round(avg(lineup_score), 6) + 0.0 AS lineup_score FROM scores GROUP BY ALL)"""

FEED = """feed AS (
  SELECT CASE WHEN role = 'CPTN' THEN name || ' - CPTN' ELSE name END AS player, name,
    CASE WHEN role = 'CPTN' THEN 'CPTN' ELSE pos END AS fpos, pos, team, opp, salary, p_size / 3 AS my_proj, p_partkey,
    role = 'CPTN' AS cpt FROM players, (SELECT unnest(['CPTN', 'FLEX']) AS role) WHERE opp IS NOT NULL),
converted AS (
  SELECT name AS player_id, player, CAST(trunc(salary * CASE WHEN cpt THEN 1.5 ELSE 1 END) AS INT) AS salary, f.team, f.opp,
    CASE WHEN cpt THEN 'CPTN' ELSE 'FLEX' END AS position, f.pos,
    k.projection * CASE WHEN cpt THEN 1.5 ELSE 1 END AS known_proj,
    coalesce(k.projection * CASE WHEN cpt THEN 1.5 ELSE 1 END, f.my_proj) AS fpts_proj,
    coalesce(k.std_dev, 5.5) * CASE WHEN cpt THEN 1.5 ELSE 1 END AS std_dev
  FROM feed f LEFT JOIN (SELECT name, projection, CASE WHEN p_partkey % 8 <> 5 THEN std_dev END AS std_dev
    FROM players WHERE p_partkey % 9 <> 4) k USING (name))"""

SHOWDOWN = f"""spread AS (
  SELECT * EXCLUDE (std_dev), least(team, opp) || '-' || greatest(team, opp) AS matchup,
    CASE WHEN pos = 'K' THEN 5.5 WHEN fpts_proj > 0 AND std_dev IS NULL THEN 5.0 WHEN fpts_proj <= 0 THEN 0.0
      ELSE std_dev END AS std_dev FROM converted),
flex AS (
  SELECT *, greatest(-1.0, fpts_proj + std_dev * 11.0 * {_normal(SEED, "player_id, team, pos")}) AS p
  FROM spread, {_slates(SHOWDOWN_SLATES)} WHERE position = 'FLEX'),
sd_qb AS (SELECT slate, team, opp, sum(CASE WHEN p > 0 THEN p ELSE 0 END) AS qb FROM flex WHERE pos = 'QB' GROUP BY ALL),
sd_own AS (SELECT slate, team, sum(qb) AS qb FROM sd_qb GROUP BY ALL),
sd_opp AS (SELECT slate, opp AS team, sum(qb) AS qb FROM sd_qb GROUP BY ALL),
sd_rest AS (SELECT *, p / nullif(sum(CASE WHEN p > 0 THEN p ELSE 0 END) OVER w, 0) AS pos_share,
  p / nullif(sum(p) OVER w, 0) AS all_share FROM flex WHERE pos <> 'QB' WINDOW w AS (PARTITION BY slate, team)),
sd_scored AS (
  SELECT slate, player_id, p AS score FROM flex WHERE pos IN ('QB', 'RB')
  UNION ALL SELECT slate, player_id, qb * pos_share * 0.64 + p * (1 - 0.64) FROM sd_rest LEFT JOIN sd_own USING (slate, team) WHERE pos = 'WR'
  UNION ALL SELECT slate, player_id, qb * all_share * 0.35 + p * (1 - 0.35) FROM sd_rest LEFT JOIN sd_own USING (slate, team) WHERE pos = 'TE'
  UNION ALL SELECT slate, player_id, qb * -0.17 + greatest(p, 0.0) * 1.17 FROM sd_rest LEFT JOIN sd_opp USING (slate, team) WHERE pos = 'DST'
  UNION ALL SELECT slate, player_id, qb * 0.1 + p * 0.9 FROM sd_rest LEFT JOIN sd_own USING (slate, team) WHERE pos = 'K'),
sd AS (
  SELECT n.slate, matchup, c.player_id, player, salary, team, position, pos,
    score * CASE WHEN position = 'CPTN' THEN 1.5 ELSE 1 END AS fpts_proj
  FROM spread c CROSS JOIN {_slates(SHOWDOWN_SLATES)} n LEFT JOIN sd_scored s ON s.slate = n.slate AND s.player_id = c.player_id)"""


SHOWDOWN_BEST = f"{PLAYERS}, {FEED}, {SHOWDOWN}, {_showdown_best_sql(SHOWDOWN_LINEUPS)}"


GRID = """lines AS (
  SELECT l_orderkey AS number, min(l_partkey) AS qb, max(l_partkey) AS rb_1,
    coalesce(min(CASE WHEN l_returnflag = 'R' THEN l_partkey END), min(l_partkey)) AS rb_2,
    coalesce(min(CASE WHEN l_returnflag = 'A' THEN l_partkey END), min(l_partkey)) AS wr_1,
    coalesce(min(CASE WHEN l_returnflag = 'N' THEN l_partkey END), min(l_partkey)) AS wr_2,
    coalesce(max(CASE WHEN l_returnflag = 'R' THEN l_partkey END), max(l_partkey)) AS wr_3,
    coalesce(max(CASE WHEN l_returnflag = 'A' THEN l_partkey END), max(l_partkey)) AS te,
    coalesce(max(CASE WHEN l_returnflag = 'N' THEN l_partkey END), max(l_partkey)) AS flex,
    CASE WHEN l_orderkey % 50 <> 0 THEN coalesce(min(CASE WHEN l_linestatus = 'O' THEN l_partkey END), min(l_partkey)) END AS dst
  FROM lineitem GROUP BY l_orderkey),
slots AS (
  SELECT * FROM lines UNPIVOT INCLUDE NULLS (k FOR slot IN (qb, rb_1, rb_2, wr_1, wr_2, wr_3, te, flex, dst))),
grid AS (
  SELECT number, CASE WHEN k = 49 THEN '49ers'
    WHEN k IS NOT NULL THEN 'Player ' || translate(CAST(k AS VARCHAR), '0123456789', 'abcdefghij') END AS player,
    pos, team, k FROM slots LEFT JOIN players ON k = p_partkey)"""
_GRID_DRAW = " UNION ALL ".join(
    f"SELECT p_partkey AS k, {i} AS sim_num, "
    + ("CASE WHEN p_partkey % 61 <> 7 THEN " if i == 3 else "")
    + f"greatest(-2.0, p_size / 2 + ((p_partkey * {i} * 37) % 101 - 50) / 10)"
    + (" END" if i == 3 else "")
    + " AS sim_proj FROM part"
    for i in range(1, 9)
)
GRID_SCORES = f"""gdraws AS ({_GRID_DRAW}),
gsim AS (SELECT s.sim_num, g.number, CASE WHEN count(*) = count(d.sim_proj) THEN sum(d.sim_proj) END AS lineup_score
  FROM grid g CROSS JOIN (SELECT unnest(range(1, 9)) AS sim_num) s LEFT JOIN gdraws d ON g.k = d.k AND s.sim_num = d.sim_num
  GROUP BY ALL),
gmean AS (SELECT number, CASE WHEN count(*) = count(lineup_score) THEN round(avg(lineup_score), 6) + 0.0 END AS lineup_score
  FROM gsim GROUP BY number)"""


def _slate_players(s, d):
    return M.match_slate(V.boom_bust(s, d), V.main_projections(s, d))


def _sim(s, d):
    return M.simulate_main(_slate_players(s, d), SLATES, SEED, 1.0)


def _picked(s, d):
    pool = M.simulate_main(_slate_players(s, d), SLATES, LINEUP_SEED, 0.0)
    return L.best_lineups(pool)


def _scores(s, d):
    draws = _sim(s, d).withColumnRenamed("slate", "sim")
    picked = _picked(s, d)
    return S.score_in_slates(draws, picked, ["slate", "lineup"], SLATES), picked


def _means(s, d):
    scores, picked = _scores(s, d)
    return tidy(S.mean_scores(scores, ["slate", "lineup"])), picked


def _kept(s, d):
    means, picked = _means(s, d)
    return S.keep_best(means, picked, KEPT, ["slate", "lineup"])


def _exposure(s, d):
    return S.exposure(_kept(s, d), KEPT)


def _final_form(s, d):
    """Each slate's own best lineup, scored in every slate."""
    draws = _sim(s, d)
    own = L.best_lineups(draws)
    return S.mean_scores(S.score_in_slates(draws.withColumnRenamed("slate", "sim"), own, ["slate"], SLATES), ["slate"])


def _final_exposure(s, d):
    """Players in the best of each slate's own lineups."""
    draws = _sim(s, d)
    own = L.best_lineups(draws)
    scores = S.score_in_slates(draws.withColumnRenamed("slate", "sim"), own, ["slate"], SLATES)
    return S.exposure(S.keep_best(tidy(S.mean_scores(scores, ["slate"])), own, KEPT, ["slate"]), KEPT)


def _converted(s, d, keep_known=False):
    return D.convert_feed(V.showdown_feed(s, d), V.known_projections(s, d), keep_known)


def _showdown(s, d, slates=SHOWDOWN_SLATES):
    return D.simulate_showdown(_converted(s, d), slates, SEED, 10.0)


def _showdown_best(s, d):
    return L.best_showdown_lineups(_showdown(s, d), best=SHOWDOWN_LINEUPS)


def _one_slate(s, d, best):
    """Several lineups of a single drawn slate."""
    return tidy(L.best_lineups(M.simulate_main(_slate_players(s, d), 1, SEED, 1.0), best=best), 4)


def _plain_best(s, d):
    """The best lineup by the projections themselves."""
    players = _slate_players(s, d).select(
        F.lit(1).alias("slate"), F.col("name").alias("player"), "team", "position",
        F.col("salary").cast("int").alias("salary"), F.col("projection").alias("fpts_proj"),
    )
    return tidy(L.best_lineups(players), 4)


def _members_nested(s, d):
    """Lineup members nested per lineup: how many, the first, and all names."""
    picked = _picked(s, d).select("slate", "lineup", "player", "position", "salary")
    nested = nest_rows(picked, ["slate", "lineup"], ["player", "position", "salary"], "data")
    first = F.element_at("data", 1)
    return nested.select(
        "slate", F.col("lineup").cast("int").alias("lineup"), F.size("data").cast("bigint").alias("members"),
        first["player"].alias("first_player"), first["salary"].cast("bigint").alias("first_salary"),
        F.array_join(F.transform("data", lambda m: m["player"]), ", ").alias("players"),
    )


def _grid(s, d):
    return S.read_grid(V.lineup_grid(s, d), V.grid_players(s, d))


def _grid_draws(s, d):
    return S.read_grid_draws(V.grid_projections(s, d))


def _grid_scores(s, d):
    return tidy(S.grid_scores(_grid_draws(s, d), _grid(s, d)))


_MEMBER_COLS = "slate, CAST(lineup AS INT) AS lineup, round(lineup_points, 4) + 0.0 AS lineup_points, CAST(lineup_salary AS BIGINT) AS lineup_salary, player, team, position, salary, round(fpts_proj, 4) + 0.0 AS fpts_proj"
_SD_LINEUPS = SHOWDOWN_SLATES * SHOWDOWN_LINEUPS

QUERIES = {
    "q17_unpivot_extract": (
        _grid,
        f"WITH {PLAYERS}, {GRID} SELECT number, player, pos, team FROM grid",
    ),
    "q18_slate_match": (
        lambda s, d: tidy(_slate_players(s, d)),
        f"WITH {PLAYERS} SELECT name, team, opp, pos AS position, salary, {r6('projection', 'std_dev')} FROM players",
    ),
    "q18_slate_draws": (
        lambda s, d: tidy(
            M.draw_scores(_slate_players(s, d), SLATES, SEED, 1.0, key=("name", "team", "position")).select(
                "slate", "name", "position", "projection"
            )
        ),
        f"""WITH {PLAYERS}, {_draws('sim', SEED, 1.0)}
        SELECT slate, name, pos AS position, round(p, 6) + 0.0 AS projection FROM sim_draws""",
    ),
    "q18_nested_members": (
        _members_nested,
        f"""WITH {PLAYERS}, {PICKED_BEST} SELECT slate, CAST(lineup AS INT) AS lineup, count(*) AS members,
          min(player) AS first_player, CAST(arg_min(salary, player) AS BIGINT) AS first_salary,
          string_agg(player, ', ' ORDER BY player) AS players FROM pick_members GROUP BY ALL""",
    ),
    "q19_qb_linked": (
        lambda s, d: tidy(_sim(s, d)),
        f"""WITH {SIMULATED} SELECT slate, name AS player, team, pos AS position, salary,
          round(score, 6) + 0.0 AS fpts_proj FROM sim""",
    ),
    "q19_ranked_slate": (
        lambda s, d: M.ranked_main(tidy(_sim(s, d))).select("slate", "player", "row_id", "player_id"),
        f"""WITH {SIMULATED}, r AS (SELECT slate, name AS player, row_number() OVER (PARTITION BY slate
          ORDER BY round(score, 6) + 0.0 DESC NULLS LAST, name) AS row_id FROM sim)
        SELECT slate, player, row_id, CAST(row_id AS VARCHAR) AS player_id FROM r""",
    ),
    "q19_season_linked": (
        lambda s, d: tidy(M.season_projection(M.season_slice(V.season_projections(s, d)), ("name",)).drop("opp")),
        f"""WITH {PLAYERS}, season AS (
          SELECT name, team, pos, 1 AS week, CAST(p_partkey % 90 + 1 AS DOUBLE) AS ecr, projection,
            projection * 0.9 - p_partkey % 5 AS projected_score FROM players),
        ranked AS (SELECT * FROM season WHERE (pos <> 'QB' OR ecr < 33) AND (pos <> 'TE' OR ecr <= 40) AND ecr <= 75),
        qb AS (SELECT team, sum(projected_score) AS qb FROM ranked WHERE pos = 'QB' GROUP BY team),
        rest AS (SELECT *, projection / nullif(sum(projection) OVER (PARTITION BY team), 0) AS share FROM ranked WHERE pos <> 'QB'),
        out AS (
          SELECT name, team, pos, week, ecr, projection, projected_score, projection AS new_proj FROM ranked WHERE pos IN ('QB', 'RB')
          UNION ALL SELECT name, team, pos, week, ecr, projection, projected_score,
            qb * share * CASE pos WHEN 'WR' THEN 0.64 ELSE 0.35 END + projected_score * CASE pos WHEN 'WR' THEN 1 - 0.64 ELSE 1 - 0.35 END
            FROM rest LEFT JOIN qb USING (team) WHERE pos IN ('WR', 'TE') AND team <> 'FA')
        SELECT name, team, pos, CAST(week AS INT) AS week, ecr, {r6("projection", "projected_score", "new_proj")} FROM out""",
    ),
    "q20_showdown_linked": (
        lambda s, d: tidy(_showdown(s, d).where(F.col("position") == "FLEX").drop("value", "new_pos")),
        f"""WITH {PLAYERS}, {FEED}, {SHOWDOWN} SELECT slate, matchup, player_id, player, salary, team, position, pos,
          {r6("fpts_proj")} FROM sd WHERE position = 'FLEX'""",
    ),
    "q22_feed_conversion": (
        lambda s, d: tidy(D.number_feed(_converted(s, d, True))),
        f"""WITH {PLAYERS}, {FEED} SELECT player_id, player, salary, team, opp, position, pos, {r6("fpts_proj", "std_dev")},
          row_number() OVER (PARTITION BY least(team, opp), greatest(team, opp)
            ORDER BY known_proj DESC NULLS LAST, player_id, position) AS row_id FROM converted""",
    ),
    "q22_captain_rows": (
        lambda s, d: D.numbered_showdown(tidy(_showdown(s, d))),
        f"""WITH {PLAYERS}, {FEED}, {SHOWDOWN}, v AS (SELECT *, CASE WHEN position = 'CPTN' THEN 'CPTN' ELSE pos END AS new_pos,
          round(fpts_proj / (nullif(salary, 0) / 1000), 6) + 0.0 AS value, round(fpts_proj, 6) + 0.0 AS f FROM sd)
        SELECT slate, matchup, player_id, player, salary, team, position, pos, f AS fpts_proj, new_pos, value,
          row_number() OVER (PARTITION BY slate, matchup ORDER BY CASE WHEN position = 'CPTN' THEN 1 ELSE 0 END,
            CASE WHEN position <> 'CPTN' THEN f END DESC NULLS LAST, player_id, player) AS row_id FROM v""",
    ),
    "q21_best_lineups": (
        lambda s, d: tidy(_picked(s, d), 4),
        f"WITH {PLAYERS}, {PICKED_BEST} SELECT {_MEMBER_COLS} FROM pick_members",
    ),
    "q21_few_lineups": (
        lambda s, d: _one_slate(s, d, FEW),
        f"WITH {PLAYERS}, {ONE_DRAWN}, {_some_best_sql('one', 'one', FEW)} SELECT {_MEMBER_COLS} FROM one_members",
    ),
    "q21_many_lineups": (
        lambda s, d: _one_slate(s, d, MANY),
        f"WITH {PLAYERS}, {ONE_DRAWN}, {_some_best_sql('one', 'one', MANY)} SELECT {_MEMBER_COLS} FROM one_members",
    ),
    "q21_plain_lineup": (
        _plain_best,
        f"""WITH {PLAYERS}, plain AS (SELECT 1 AS slate, *, projection AS score FROM players),
        {_some_best_sql('plain', 'plain', 1)} SELECT {_MEMBER_COLS} FROM plain_members""",
    ),
    "q21_showdown_lineups": (
        lambda s, d: tidy(_showdown_best(s, d), 4),
        f"""WITH {SHOWDOWN_BEST} SELECT slate, matchup, player_id, position, CAST(lineup AS INT) AS lineup,
          round(lineup_points, 4) + 0.0 AS lineup_points, CAST(lineup_salary AS BIGINT) AS lineup_salary, player, salary, team, pos,
          round(fpts_proj, 4) + 0.0 AS fpts_proj, CASE WHEN position = 'CPTN' THEN 'CPTN' ELSE pos END AS new_pos,
          round(fpts_proj / (nullif(salary, 0) / 1000), 4) + 0.0 AS value FROM sd_members""",
    ),
    "q23_score_lineups": (
        lambda s, d: tidy(_scores(s, d)[0]),
        f"WITH {SIMULATED}, {PICKED_BEST}, {SCORES} SELECT sim, slate, lineup, lineup_score FROM scores",
    ),
    "q23_mean_scores": (
        lambda s, d: _means(s, d)[0],
        f"WITH {SIMULATED}, {PICKED_BEST}, {SCORES} SELECT slate, lineup, lineup_score FROM means",
    ),
    "q23_final_form": (
        lambda s, d: tidy(_final_form(s, d)),
        f"""WITH {SIMULATED}, {SAME_BEST}, sc AS (
          SELECT d.slate AS sim, m.slate, round(sum(d.score), 2) AS lineup_score FROM sim_members m JOIN sim d ON m.player = d.name
          GROUP BY ALL)
        SELECT slate, round(avg(lineup_score), 6) + 0.0 AS lineup_score FROM sc GROUP BY slate""",
    ),
    "q24_exposure": (
        lambda s, d: S.exposure_table(tidy(_exposure(s, d))),
        f"""WITH {SIMULATED}, {PICKED_BEST}, {SCORES},
        best AS (SELECT * FROM means QUALIFY rank() OVER (ORDER BY lineup_score DESC) <= {KEPT}),
        e AS (SELECT player, position, salary, team, round(count(*) / {KEPT}.0, 6) AS exp
          FROM best JOIN pick_members USING (slate, lineup) GROUP BY ALL)
        SELECT *, printf('%.1f%%', round(exp * 100, 1)) AS exp_text FROM e""",
    ),
    "q24_top_exposure": (
        lambda s, d: S.exposure_table(tidy(_exposure(s, d)), 4),
        f"""WITH {SIMULATED}, {PICKED_BEST}, {SCORES},
        best AS (SELECT * FROM means QUALIFY rank() OVER (ORDER BY lineup_score DESC) <= {KEPT}),
        e AS (SELECT player, position, salary, team, round(count(*) / {KEPT}.0, 6) AS exp
          FROM best JOIN pick_members USING (slate, lineup) GROUP BY ALL)
        SELECT *, printf('%.1f%%', round(exp * 100, 1)) AS exp_text FROM e
        QUALIFY rank() OVER (PARTITION BY position ORDER BY exp DESC) <= 4""",
    ),
    "q24_salary_profile": (
        lambda s, d: tidy(L.salary_profile(_picked(s, d)), 4),
        f"""WITH {PLAYERS}, {PICKED_BEST}, r AS (SELECT *, row_number() OVER (PARTITION BY slate, lineup
          ORDER BY salary DESC, player) AS k FROM pick_members)
        SELECT slate, lineup, round(sum(fpts_proj), 4) + 0.0 AS lineup_score, """
        + ", ".join(
            f"CAST(sum(CASE WHEN k <= {k} THEN salary END) AS BIGINT) AS top_{k}_spend, "
            f"round(sum(CASE WHEN k <= {k} THEN fpts_proj END), 4) + 0.0 AS top_{k}_score"
            for k in (2, 3, 4, 5)
        )
        + """, CAST(sum(CASE WHEN k BETWEEN 4 AND 6 THEN salary END) AS BIGINT) AS mid_3_spend,
          round(sum(CASE WHEN k BETWEEN 4 AND 6 THEN fpts_proj END), 4) + 0.0 AS mid_3_score,
          string_agg(player, ', ' ORDER BY player) AS players FROM r GROUP BY slate, lineup""",
    ),
    "q24_showdown_players": (
        lambda s, d: tidy(S.showdown_players(_showdown_best(s, d), _SD_LINEUPS)),
        f"""WITH {SHOWDOWN_BEST}, plays AS (SELECT matchup, player_id, player, pos, position, count(*) AS n FROM sd_members GROUP BY ALL)
        SELECT matchup, player, pos, CAST(player_n AS BIGINT) AS player_n, round(player_n / {_SD_LINEUPS}.0, 6) + 0.0 AS player_pct
        FROM (SELECT *, sum(n) OVER (PARTITION BY matchup, player_id) AS player_n FROM plays) WHERE position <> 'CPTN'""",
    ),
    "q24_showdown_plays": (
        lambda s, d: tidy(S.showdown_plays(_showdown_best(s, d), _SD_LINEUPS)),
        f"""WITH {SHOWDOWN_BEST} SELECT matchup, player_id, player, pos, position, {_SD_LINEUPS} AS total, count(*) AS n,
          round(count(*) / {_SD_LINEUPS}.0, 6) + 0.0 AS pct FROM sd_members GROUP BY matchup, player_id, player, pos, position""",
    ),
    "q24_final_exposure": (
        lambda s, d: S.exposure_table(tidy(_final_exposure(s, d))),
        f"""WITH {SIMULATED}, {SAME_BEST}, sc AS (
          SELECT d.slate AS sim, m.slate, round(sum(d.score), 2) AS lineup_score FROM sim_members m JOIN sim d ON m.player = d.name
          GROUP BY ALL),
        means AS (SELECT slate, round(avg(lineup_score), 6) + 0.0 AS lineup_score FROM sc GROUP BY slate),
        best AS (SELECT * FROM means QUALIFY rank() OVER (ORDER BY lineup_score DESC) <= {KEPT}),
        e AS (SELECT player, position, salary, team, round(count(*) / {KEPT}.0, 6) AS exp
          FROM best JOIN sim_members USING (slate) GROUP BY ALL)
        SELECT *, printf('%.1f%%', round(exp * 100, 1)) AS exp_text FROM e""",
    ),
    "q24_showdown_share": (
        lambda s, d: tidy(S.lineup_share(_showdown_best(s, d), ("slate", "matchup"))),
        f"""WITH {SHOWDOWN_BEST} SELECT slate, matchup, player_id, pos, count(*) AS n,
          round(count(*) / max(lineup), 6) + 0.0 AS pct FROM sd_members GROUP BY slate, matchup, player_id, pos""",
    ),
    "q26_picked_draws": (
        lambda s, d: tidy(S.picked_draws(_grid_draws(s, d))),
        f"""WITH {PLAYERS}, gdraws AS ({_GRID_DRAW}), named AS (
          SELECT CASE WHEN k = 49 THEN '49ers' ELSE 'Player ' || translate(CAST(k AS VARCHAR), '0123456789', 'abcdefghij') END AS player,
            pos, CAST(sim_num AS INT) AS sim_num, sim_proj FROM gdraws JOIN players ON k = p_partkey)
        SELECT player, pos, sim_num, {r6("sim_proj")}, round(first_value(sim_proj) OVER (PARTITION BY player, pos ORDER BY sim_num), 6) + 0.0
          AS first_proj FROM named QUALIFY sim_num <= 2""",
    ),
    "q26_grid_scores": (
        _grid_scores,
        f"WITH {PLAYERS}, {GRID}, {GRID_SCORES} SELECT number, lineup_score FROM gmean",
    ),
    "q26_grid_scores_by_draw": (
        lambda s, d: tidy(S.grid_scores_by_draw(_grid_draws(s, d), _grid(s, d))),
        f"""WITH {PLAYERS}, {GRID}, {GRID_SCORES} SELECT CAST(sim_num AS INT) AS sim_num, number, {r6("lineup_score")}
        FROM gsim WHERE lineup_score IS NOT NULL""",
    ),
    "q26_grid_exposure": (
        lambda s, d: tidy(S.grid_exposure(_grid_scores(s, d), _grid(s, d), GRID_KEPT)),
        f"""WITH {PLAYERS}, {GRID}, {GRID_SCORES},
        best AS (SELECT * FROM gmean WHERE lineup_score IS NOT NULL QUALIFY rank() OVER (ORDER BY lineup_score DESC) <= {GRID_KEPT})
        SELECT player, pos, team, round(count(*) / {GRID_KEPT}.0, 6) + 0.0 AS exp FROM best JOIN grid USING (number) GROUP BY ALL""",
    ),
}
