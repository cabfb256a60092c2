"""Expected points, projection blends and stat-table blends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.na import fill_numeric, half_even, is_in, round_numeric, safe_ratio
from ..functions.text import columns_containing, standard_names
from ..operators.joins import left_join_detail, natural_join
from ..operators.ordering import desc_last, name_codes, sorted_positions
from ..operators.sorting import arrange
from ..operators.topn import first_rows

# The blend weights of the own projection and the expected points.
BLEND = (0.85, 0.15)


def with_bonus(points: DataFrame) -> DataFrame:
    """Add the expected yardage bonus to the expected points."""
    bonus = (
        F.col("pass_yards_gained_exp") / 300 * 3 + F.col("rec_yards_gained_exp") / 100 * 3
        + F.col("rush_yards_gained_exp") / 100 * 3
    )
    return points.withColumn("total_dk_bonus_fantasy_points_exp", bonus).withColumn(
        "total_fantasy_points_exp", F.col("total_fantasy_points_exp") + bonus
    )


def _point_columns(points: DataFrame) -> DataFrame:
    base = ["season", "week", "player_id", "full_name", "position", "posteam", "total_fantasy_points_diff"]
    more = columns_containing(points, "fantasy_points_exp", but_not="_exp_team")
    return points.select(*base, *[c for c in more if c not in base])


def recent_points(points: DataFrame, games: int = 6, tie=()) -> DataFrame:
    """Mean expected points over the last games of each player."""
    points = points.withColumn("season", F.col("season").try_cast("double"))
    recent = first_rows(points, games, desc_last("season", "week", *tie), ["player_id"])
    newest = F.struct("season", "week", *tie)
    recent = with_bonus(recent)
    means = recent.groupBy("player_id", "full_name", "position").agg(
        F.max_by("posteam", newest).alias("posteam"),
        F.avg("total_fantasy_points_exp").alias("oep"),
    )
    out = round_numeric(means).select(
        "player_id", F.col("full_name").alias("name"), F.col("posteam").alias("team"), "position", "oep"
    )
    return standard_names(out)


def weekly_points(points: DataFrame) -> DataFrame:
    """Expected points of every player-week, rounded to whole points."""
    rounded = round_numeric(_point_columns(with_bonus(points)))
    out = rounded.select(
        "player_id", F.col("full_name").alias("name"), "position", F.col("posteam").alias("team"),
        F.col("total_fantasy_points_exp").alias("oep"),
    )
    return standard_names(out)


def watched_points(points: DataFrame, highlight, second, others) -> DataFrame:
    """Weekly expected points of named players, with the colour class of each."""
    colour = (
        F.when(is_in("full_name", highlight), "gold").when(is_in("full_name", second), "black").otherwise("green")
    )
    return points.where(is_in("full_name", [*highlight, *second, *others])).select(
        "full_name", "season", "week", F.col("total_fantasy_points_exp").alias("oep"), colour.alias("line_color")
    )


def roster_names(rosters: DataFrame) -> DataFrame:
    return standard_names(
        rosters.select(F.col("gsis_id").alias("player_id"), F.col("full_name").alias("name"), "position", "team")
    )


def blend_projection(slate: DataFrame, points: DataFrame, rosters: DataFrame) -> DataFrame:
    """Mix a slate's projection with expected points; a player without any keeps the projection.

    A weekly points table matches a player once per week, and those repeats are kept.
    """
    keys = ["name", "team", "position"]
    joined = left_join_detail(slate, points.withColumnRenamed("player_id", "_points_id"), keys)
    joined = left_join_detail(joined, rosters.withColumnRenamed("player_id", "_roster_id"), keys)
    joined = joined.withColumn("player_id", F.coalesce("_points_id", "_roster_id"))
    coded = name_codes(joined, "name", "_code")
    unit_id = F.concat(F.lit("00-"), F.col("_code").cast("string"))
    own, other = BLEND
    return (
        coded.withColumn("player_id", F.when(F.col("position") == "DST", unit_id).otherwise(F.col("player_id")))
        .withColumn("oep", F.coalesce("oep", half_even("projection")))
        .withColumn("new_proj", F.col("projection") * own + F.col("oep") * other)
        .select(
            "name", "team", "opp", "salary", "position", F.col("new_proj").alias("projection"), "std_dev",
            "player_id", "oep",
        )
    )


STAT_KEYS = ["name", "team", "opponent"]


def blend_stats(receiving: DataFrame, rushing: DataFrame, passing: DataFrame, literal_keys: bool = False) -> DataFrame:
    """Full outer join of three stat tables, nulls to 0, and totals per player.

    The first two tables share a fumbles column. As written it is one more join key, so a player whose
    fumbles differ appears twice; by default the key is the player and the two columns are added.
    """
    if literal_keys:
        joined = natural_join(receiving, rushing, "full", [*STAT_KEYS, "fum_l"])
    else:
        joined = natural_join(receiving, rushing, "full", STAT_KEYS)
        both = F.coalesce(F.col("`fum_l.x`"), F.lit(0.0)) + F.coalesce(F.col("`fum_l.y`"), F.lit(0.0))
        joined = joined.withColumn("fum_l", both).drop("fum_l.x", "fum_l.y")
    joined = natural_join(joined, passing.withColumnRenamed("fum_l", "qb_fum_l"), "full", STAT_KEYS)
    filled = fill_numeric(joined)
    totals = (
        filled.withColumn("opps", F.col("targets") + F.col("rush"))
        .withColumn("yards", F.col("rec_yd") + F.col("rush_yd") + F.col("pass_yd"))
        .withColumn("tds", F.col("rec_td") + F.col("rush_td") + F.col("touchdowns"))
        .withColumn("fum_l", F.col("fum_l") + F.col("qb_fum_l"))
        .drop("qb_fum_l")
    )
    first = ["name", "team", "opps", "yards", "tds"]
    return totals.select(*first, *[c for c in totals.columns if c not in first])


def stat_chart(stats: DataFrame, metric: str, teams=None, shown=None) -> DataFrame:
    """Rows of a bar chart from the smallest bar up: the teams' players with a positive ``shown`` value.

    ``metric`` may be ``bad_yards``, three yards per rush.
    """
    stats = stats.withColumn("bad_yards", F.col("rush") * 3)
    if teams is not None:
        stats = stats.where(is_in("team", teams))
    if shown is not None:
        stats = stats.where(F.col(shown) > 0)
    return arrange(stats.select("name", "team", metric), metric, "name")


#: Bars of each chart, and the column that must be positive for a bar to be shown.
CHARTS = {
    "opps": ("opps", None),
    "rush_yd": ("rush_yd", "rush_yd"),
    "bad_yards": ("bad_yards", "bad_yards"),
    "rec_yd": ("rec_yd", "rec_yd"),
    "catches": ("catches", "catches"),
    "yards": ("yards", "rec_yd"),
}


def stat_charts(stats: DataFrame, teams) -> DataFrame:
    """The bars of all charts of the teams' players, numbered per chart from the smallest up."""
    stats = stats.where(is_in("team", teams)).withColumn("bad_yards", F.col("rush") * 3)
    bars = [
        F.struct(F.lit(chart).alias("chart"), F.col(bar).cast("double").alias("shown"), (F.col(shown) > 0 if shown else F.lit(True)).alias("ok"))
        for chart, (bar, shown) in CHARTS.items()
    ]
    each = stats.select("name", "team", F.explode(F.array(*bars)).alias("x")).where("x.ok")
    each = each.select("name", "team", "x.chart", "x.shown")
    return sorted_positions(each, ["chart"], [F.col("shown").asc_nulls_last(), F.col("name").asc()], "bar")


def usage_per_salary(stats: DataFrame, salaries: DataFrame, teams=None) -> DataFrame:
    """Opportunities and usage per 1000 of salary."""
    used = stats.drop("opponent").withColumn("usg", F.col("opps") + F.col("attempts"))
    if teams is not None:
        used = used.where(is_in("team", teams))
    joined = natural_join(
        used, salaries.select("name", "position", "team", "opponent", "salary"), "left", ["name", "team"]
    )
    thousands = F.col("salary") / 1000
    return joined.withColumn("opps_1k", safe_ratio("opps", thousands)).withColumn("usg_1k", safe_ratio("usg", thousands))
