"""Views that give the driver's tables the columns of the play, stat and slate inputs.

The tables hold no football data; these mappings only rename and derive, row by row or by grouping,
so every job runs over whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plays from events: a day is a game, an event type a team, a user a passer."""
    e = table(spark, sf_dir, "events")
    day = F.dayofmonth("ts")
    user = F.col("user_id")
    return e.select(
        F.date_format("ts", "yyyy-MM-dd").alias("game_id"), F.col("event_id").alias("play_id"),
        F.lit(2024).alias("season"), F.ceil(day / 7).cast("int").alias("week"),
        F.when(day <= 28, "REG").otherwise("POST").alias("season_type"),
        F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("posteam"),
        F.lit("view").alias("home_team"), F.lit("click").alias("away_team"),
        F.when(F.col("event_id") % 3 == 0, "run").when(F.col("event_id") % 7 == 1, "punt").otherwise("pass")
        .alias("play_type"),
        F.when(F.col("event_id") % 4 != 0, 1).otherwise(0).alias("qb_dropback"),
        F.when(user % 10 != 3, user).alias("passer_player_id"),
        F.when(user % 50 != 7, F.concat(F.lit("U"), user.cast("string"))).alias("passer_player_name"),
        F.when(F.col("event_id") % 11 != 5, F.col("value") - 20).alias("epa"),
        F.nullif((F.floor("value") % 57).cast("int"), F.lit(13)).alias("score_differential"),
        (day % 15 - 7).cast("double").alias("spread_line"), (day % 11 + 40).cast("double").alias("total_line"),
    )


def order_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plays from order lines: an order is a game, a line a play, a supplier a passer."""
    line = table(spark, sf_dir, "lineitem")
    order = table(spark, sf_dir, "orders")
    joined = line.join(order, line.l_orderkey == order.o_orderkey)
    home = F.col("o_custkey") % 32
    away = (home + 1 + F.col("o_orderkey") % 31) % 32
    return joined.select(
        F.col("l_orderkey").alias("game_id"), F.col("l_linenumber").alias("play_id"),
        F.year("o_orderdate").alias("season"), (F.floor((F.dayofyear("o_orderdate") - 1) / 21) + 1).cast("int").alias("week"),
        F.when(F.col("o_orderstatus") == "P", "POST").otherwise("REG").alias("season_type"),
        F.when(F.col("l_linestatus") == "O", home).otherwise(away).cast("string").alias("posteam"),
        home.cast("string").alias("home_team"), away.cast("string").alias("away_team"),
        F.when(F.col("l_returnflag") == "R", "run").when(F.col("l_returnflag") == "A", "pass").otherwise("field_goal")
        .alias("play_type"),
        F.when(F.col("l_tax") < 0.065, 1).otherwise(0).alias("qb_dropback"),
        F.when(F.col("l_suppkey") % 19 != 5, F.col("l_suppkey")).alias("passer_id"),
        F.col("l_quantity").cast("int").alias("yardline_100"),
        F.floor((F.col("l_linenumber") - 1) / 2).cast("int").alias("drive"),
        (F.col("l_quantity") - 10).alias("yards_gained"), (F.col("l_discount") * 60 - 1).alias("ep"),
        (F.col("l_extendedprice") * (F.col("l_discount") - 0.05) / 1000).alias("epa"),
        F.nullif((F.col("l_quantity") - 25).cast("int"), F.lit(-20)).alias("score_differential"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 3).cast("double").alias("spread_line"),
        (F.year("o_orderdate") % 4 * 5 + F.substring("o_orderpriority", 1, 1).cast("int")).cast("double").alias("total_line"),
        F.floor(F.col("o_totalprice") / 1000).cast("int").alias("total"),
        "l_partkey", "l_suppkey", "l_extendedprice",
    )


PLAY_TIE = ("play_id", "l_partkey", "l_suppkey", "l_extendedprice")


def rosters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rosters from suppliers for every season of the orders; one in seven has no name on the roster."""
    s = table(spark, sf_dir, "supplier")
    named = s.where(F.col("s_suppkey") % 7 != 4)
    return named.select(
        F.explode(F.sequence(F.lit(1995), F.lit(2001))).alias("season"), F.col("s_suppkey").alias("gsis_id"),
        F.col("s_name").alias("full_name"), F.element_at(_positions(), (F.col("s_suppkey") % 4 + 1).cast("int")).alias("position"),
        F.col("s_nationkey").cast("string").alias("team"), F.col("s_nationkey").alias("jersey_number"),
    )


def _positions():
    return F.array(*[F.lit(p) for p in ("WR", "TE", "RB", "QB")])


def player_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly player stats from order lines: a supplier is a player, a line a week's stats."""
    line = table(spark, sf_dir, "lineitem")
    p = F.col("l_suppkey")
    pos = F.element_at(_positions(), (p % 4 + 1).cast("int"))
    qb = pos == "QB"
    return line.select(
        p.alias("player_id"), F.when(p % 23 != 11, F.concat(F.lit("S"), p.cast("string"))).alias("player_name"),
        F.concat(F.lit("Supplier "), p.cast("string")).alias("player_display_name"), pos.alias("position"),
        F.concat(F.col("l_returnflag"), F.col("l_linestatus")).alias("recent_team"),
        F.when(F.col("l_linenumber") == 7, "POST").otherwise("REG").alias("season_type"),
        F.year("l_shipdate").alias("season"),
        (F.floor((F.dayofyear("l_shipdate") - 1) / 21) + 1).cast("int").alias("week"),
        (F.col("l_quantity") % 11).cast("int").alias("targets"), F.when(F.col("l_partkey") % 997 != 3, F.col("l_linenumber") % 4).alias("carries"),
        F.when(qb, F.col("l_quantity").cast("int")).otherwise(0).alias("attempts"),
        F.when(F.col("l_quantity") > 45, 1).otherwise(0).alias("receiving_tds"),
        F.when(F.col("l_partkey") % 13 == 0, 1).otherwise(0).alias("rushing_tds"),
        F.when(qb & (F.col("l_discount") > 0.075), 2).otherwise(0).alias("passing_tds"),
        F.when(qb, F.round(F.col("l_discount") * 100 - 5, 2)).alias("passing_epa"),
        F.round(F.col("l_tax") * 100 - 4, 2).alias("rushing_epa"),
        F.when(F.col("l_linenumber") % 5 != 0, F.col("l_quantity") / 10 - 2.5).alias("receiving_epa"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
    )


STAT_TIE = ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


def expected_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly expected points from events: a user is a player, an event a week's row."""
    e = table(spark, sf_dir, "events")
    u = F.col("user_id")
    day = F.dayofmonth("ts")
    return e.select(
        F.year("ts").cast("string").alias("season"), F.ceil(day / 7).cast("int").alias("week"),
        u.cast("string").alias("player_id"), F.concat(F.lit("Player "), u.cast("string")).alias("full_name"),
        F.element_at(_positions(), (u % 4 + 1).cast("int")).alias("position"),
        F.when(F.col("event_type") == "view", "LA").otherwise(F.upper("event_type")).alias("posteam"),
        (F.col("value") * 3).alias("pass_yards_gained_exp"), F.col("value").alias("rec_yards_gained_exp"),
        (F.col("value") / 2).alias("rush_yards_gained_exp"), (F.col("value") / 4).alias("total_fantasy_points_exp"),
        (F.col("value") / 8).alias("total_fantasy_points_exp_team"),
        (F.col("value") - 20).alias("total_fantasy_points_diff"), "event_id",
    )


def stat_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Receiving, rushing and passing tables from orders by customer, lines by supplier, and parts.

    Sums run over whole cents so that they do not depend on the order of addition.
    """
    def keyed(k: str):
        key = F.col(k)
        return [
            F.concat(F.lit("P"), key.cast("string")).alias("name"),
            F.when(key % 17 != 0, F.concat(F.lit("T"), (key % 32).cast("string"))).alias("team"),
            F.concat(F.lit("T"), ((key + 5) % 32).cast("string")).alias("opponent"),
        ]

    receiving = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).cast("double").alias("targets"),
        F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).cast("double").alias("catches"),
        (F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")) / 100000000).alias("rec_yd"),
        F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)).cast("double").alias("rec_td"),
        F.sum(F.when(F.col("o_orderpriority") == "5-LOW", 1).otherwise(0)).cast("double").alias("fum_l"),
    )
    rushing = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).cast("double").alias("rush"),
        F.sum(F.col("l_quantity").cast("bigint")).cast("double").alias("rush_yd"),
        F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).cast("double").alias("rush_td"),
        F.sum(F.when(F.col("l_linenumber") == 7, 1).otherwise(0)).cast("double").alias("fum_l"),
    )
    passing = table(spark, sf_dir, "part").select(
        *keyed("p_partkey"), F.col("p_size").cast("double").alias("attempts"),
        F.col("p_retailprice").alias("pass_yd"), (F.col("p_size") % 7).cast("double").alias("touchdowns"),
        (F.col("p_size") % 3).cast("double").alias("fum_l"),
    )
    return (
        receiving.select(*keyed("o_custkey"), "targets", "catches", "rec_yd", "rec_td", "fum_l"),
        rushing.select(*keyed("l_suppkey"), "rush", "rush_yd", "rush_td", "fum_l"),
        passing,
    )


# Part types standing in for positions.
TYPE_POSITIONS = {
    "ECONOMY": "QB",
    "SMALL": "RB",
    "MEDIUM": "WR",
    "LARGE": "TE",
    "PROMO": "DST",
    "STANDARD": "K",
}


def _brand(column: str = "p_brand"):
    return F.regexp_substr(F.col(column), F.lit("[0-9]+")).cast("int")


def _team_code(number):
    """Two letters per brand; brand 25 meets nobody and is the free-agent pool."""
    return F.when(number == 25, "FA").otherwise(F.concat(F.lit("B"), F.char(number + 64)))


def _player_columns(parts: DataFrame) -> DataFrame:
    number = _brand()
    rival = F.when(number != 25, F.when(number % 2 == 1, number + 1).otherwise(number - 1))
    position = F.lit(None).cast("string")
    for kind, pos in TYPE_POSITIONS.items():
        position = F.when(F.col("p_type") == kind, pos).otherwise(position)
    key = F.translate(F.col("p_partkey").cast("string"), "0123456789", "abcdefghij")
    return parts.select(
        F.concat_ws(" ", "p_name", key).alias("name"), _team_code(number).alias("team"),
        _team_code(rival).alias("opp"), position.alias("position"),
        (3000 + 100 * (F.col("p_partkey") * 7 % 60)).cast("int").alias("salary"),
        (F.col("p_size") / 2).alias("projection"), (F.col("p_size") / 6).alias("std_dev"), "p_partkey", "p_size",
    )


def boom_bust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Player projections from parts."""
    return _player_columns(table(spark, sf_dir, "part")).select(
        "name", "team", "position", F.lit("Main").alias("slate"), "salary", "projection", "std_dev"
    )


def main_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _player_columns(table(spark, sf_dir, "part")).select("team", F.col("opp").alias("opponent"))


def showdown_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captain and flex feed rows of every part; the feed's own number is a third of the size."""
    p = _player_columns(table(spark, sf_dir, "part")).where(F.col("opp").isNotNull())
    role = F.explode(F.array(F.lit("CPTN"), F.lit("FLEX"))).alias("role")
    both = p.select("*", role)
    captain = F.col("role") == "CPTN"
    return both.select(
        F.when(captain, F.concat(F.col("name"), F.lit(" - CPTN"))).otherwise(F.col("name")).alias("player"),
        F.when(captain, "CPTN").otherwise(F.col("position")).alias("pos"), "team",
        F.concat(F.lit("@ "), F.col("opp")).alias("opp"), "salary", (F.col("p_size") / 3).alias("my_proj"),
    )


def known_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projections with opponents in which one part in nine is missing and one in eight has no spread."""
    p = _player_columns(table(spark, sf_dir, "part")).where(F.col("p_partkey") % 9 != 4)
    return p.select(
        "name", "team", "opp", "position", "salary", "projection",
        F.when(F.col("p_partkey") % 8 != 5, F.col("std_dev")).alias("std_dev"),
    )


def salaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Salaries from customers, keyed like the stat tables; one in 29 costs nothing."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        F.concat(F.lit("P"), k.cast("string")).alias("name"),
        F.element_at(_positions(), (k % 4 + 1).cast("int")).alias("position"),
        F.when(k % 17 != 0, F.concat(F.lit("T"), (k % 32).cast("string"))).alias("team"),
        F.concat(F.lit("T"), ((k + 5) % 32).cast("string")).alias("opponent"),
        F.when(k % 29 == 0, 0).otherwise(3000 + 100 * (k % 60)).cast("int").alias("salary"),
    )


def _point_teams():
    return F.array(*[F.lit(t) for t in ("LAR", "CLICK", "SIGNUP", "PURCHASE", "ERROR")])


def blend_slate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slate from parts under the names and teams of the expected-points view."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        F.concat(F.lit("Player "), k.cast("string")).alias("name"),
        F.element_at(_point_teams(), (k % 5 + 1).cast("int")).alias("team"),
        F.element_at(_point_teams(), ((k + 1) % 5 + 1).cast("int")).alias("opp"),
        (3000 + 100 * (k % 60)).cast("int").alias("salary"),
        F.when(F.col("p_type") == "PROMO", "DST").otherwise(F.element_at(_positions(), (k % 4 + 1).cast("int"))).alias("position"),
        (F.col("p_size") / 2).alias("projection"), (F.col("p_size") / 6).alias("std_dev"),
    )


def blend_rosters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        F.concat(F.lit("R"), k.cast("string")).alias("gsis_id"),
        F.concat(F.lit("Player "), k.cast("string")).alias("full_name"),
        F.element_at(_positions(), (k % 4 + 1).cast("int")).alias("position"),
        F.when(k % 5 == 0, "LA").otherwise(F.element_at(_point_teams(), (k % 5 + 1).cast("int"))).alias("team"),
    )


def _grid_name(key):
    letters = F.translate(key.cast("string"), "0123456789", "abcdefghij")
    return F.when(key == 49, "49ers").otherwise(F.concat(F.lit("Player "), letters))


def lineup_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One lineup per order, its slots filled from the parts of the order's lines."""
    low, high = F.min("l_partkey"), F.max("l_partkey")

    def pick(agg, cond, other):
        return F.coalesce(agg(F.when(cond, F.col("l_partkey"))), other)

    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    slots = {
        "qb": low, "rb_1": high, "rb_2": pick(F.min, flag == "R", low), "wr_1": pick(F.min, flag == "A", low),
        "wr_2": pick(F.min, flag == "N", low), "wr_3": pick(F.max, flag == "R", high),
        "te": pick(F.max, flag == "A", high), "flex": pick(F.max, flag == "N", high),
        "dst": pick(F.min, status == "O", low),
    }
    keys = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("number")).agg(
        *[agg.alias(slot) for slot, agg in slots.items()]
    )
    labels = [
        F.concat_ws(" ", _grid_name(F.col(slot)), (F.col(slot) % 90 + 10).cast("string")).alias(slot) for slot in slots
        if slot != "dst"
    ]
    dst = F.when(
        F.col("number") % 50 != 0, F.concat_ws(" ", _grid_name(F.col("dst")), (F.col("dst") % 90 + 10).cast("string"))
    ).alias("dst")
    return keys.select("number", *labels, dst)


def grid_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _player_columns(table(spark, sf_dir, "part"))
    return p.select(_grid_name(F.col("p_partkey")).alias("player"), F.col("position").alias("pos"), "team")


def grid_projections(spark: SparkSession, sf_dir: str, draws: int = 8) -> DataFrame:
    """Wide table of simulated scores, one column per draw."""
    p = _player_columns(table(spark, sf_dir, "part"))
    key = F.col("p_partkey")

    def draw(k: int):
        x = F.col("p_size") / 2 + ((key * k * 37) % 101 - 50) / 10
        return (F.when(key % 61 != 7, x) if k == 3 else x).alias(f"number{k}")

    return p.select(
        _grid_name(key).alias("player"), F.col("position").alias("pos"), *[draw(k) for k in range(1, draws + 1)]
    )


def season_projections(spark: SparkSession, sf_dir: str, weeks: int = 4) -> DataFrame:
    """Ranked weekly projections from parts."""
    p = _player_columns(table(spark, sf_dir, "part"))
    week = F.explode(F.sequence(F.lit(1), F.lit(weeks))).alias("week")
    return p.select("name", "team", F.col("position").alias("pos"), "projection", "p_partkey", "p_size", week).select(
        "name", "team", "pos", "week", (F.col("p_partkey") % 90 + 1).cast("double").alias("ecr"), "projection",
        (F.col("projection") * (0.8 + 0.1 * F.col("week")) - F.col("p_partkey") % 5).alias("projected_score"),
    )
