"""Single-game contests: read the salary feed, draw flex scores, price captains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.na import is_in, safe_ratio
from ..functions.text import extract_first, remove_first, trim_space
from ..operators.joins import natural_join
from ..operators.ordering import best_first
from ..operators.reshape import with_keys
from ..session import cut_lineage, evenly
from .simulate import SHOWDOWN, SHOWDOWN_FLOOR, covered_by, draw_scores, link_to_passers

# Spreads used where the projections have none, and the captain's multiple.
SPREAD_UNMATCHED = 5.5
SPREAD_KICKER = 5.5
SPREAD_MISSING = 5.0
CAPTAIN = 1.5


def convert_feed(feed: DataFrame, boom_bust: DataFrame, keep_known: bool = False) -> DataFrame:
    """Salary feed to captain and flex rows with projections.

    A captain row takes position and salary from the player's flex row. A player without a projection
    falls back to the feed's own number, which is not raised for captains.
    """
    read = feed.withColumn("fc_name", F.col("player")).withColumn(
        "name", trim_space(remove_first("player", "- [A-z]+"))
    ).withColumn("opp", extract_first("opp", "[A-Z]+"))
    flex = read.where(F.col("pos") != "CPTN").select("name", "fc_name", "pos", "team", "opp", "salary")
    captain = natural_join(
        read.where(F.col("pos") == "CPTN").select("name", "fc_name", "team", "opp"), flex, "left",
        ["name", "team", "opp"], grows=True,
    ).select("name", F.col("`fc_name.x`").alias("fc_name"), "pos", "team", "opp", "salary")
    known = boom_bust.select(
        "name", "team", "opp", F.col("position").alias("pos"), F.col("projection").alias("fpts"), "std_dev"
    )
    both = natural_join(captain.unionByName(flex), known, "left", ["name", "team", "opp", "pos"], grows=True)
    is_cpt = F.col("fc_name").rlike("- CPTN")
    times = F.when(is_cpt, CAPTAIN).otherwise(1.0)
    priced = both.select(
        F.col("name").alias("player_id"), F.col("fc_name").alias("player"),
        (F.col("salary") * times).cast("int").alias("salary"), "team", "opp",
        F.when(is_cpt, "CPTN").otherwise("FLEX").alias("position"), "pos",
        (F.col("fpts") * times).alias("fpts_proj"),
        (F.coalesce("std_dev", F.lit(SPREAD_UNMATCHED)) * times).alias("std_dev"),
    )
    own = read.select(F.col("player").alias("player_id"), "team", "my_proj")
    out = natural_join(priced, own, "left", ["player_id", "team"], grows=True)
    filled = F.coalesce("fpts_proj", "my_proj")
    return out.withColumns({"known_proj": F.col("fpts_proj"), "fpts_proj": filled} if keep_known else {"fpts_proj": filled}).drop(
        "my_proj"
    )


def number_feed(converted: DataFrame) -> DataFrame:
    """Number a contest's rows from the best projection down.

    ``converted`` comes with known_proj: rows whose projection is only the feed's own come last.
    """
    contest = converted.withColumns({"_one": F.least("team", "opp"), "_two": F.greatest("team", "opp")})
    numbered = best_first(contest, ["_one", "_two"], "known_proj", ["player_id", "position"], "row_id")
    return numbered.drop("_one", "_two", "known_proj")


def unmatched(converted: DataFrame) -> DataFrame:
    """Rows that still have no spread."""
    return converted.where(F.col("std_dev").isNull())


def with_value(df: DataFrame) -> DataFrame:
    """Points per 1000 of salary."""
    return df.withColumn("value", safe_ratio("fpts_proj", F.col("salary") / 1000))


def default_spread(df: DataFrame, projection: str = "projection") -> DataFrame:
    spread = (
        F.when(F.col("pos") == "K", SPREAD_KICKER)
        .when((F.col(projection) > 0) & F.col("std_dev").isNull(), SPREAD_MISSING)
        .when(F.col(projection) <= 0, 0.0)
        .otherwise(F.col("std_dev"))
    )
    return df.withColumn("std_dev", spread)


def matchup_of(df: DataFrame) -> DataFrame:
    """Name the game of a team by its two teams in order."""
    return df.where(F.col("opp").isNotNull()).withColumn(
        "matchup", F.concat_ws("-", F.least("team", "opp"), F.greatest("team", "opp"))
    )


def simulate_showdown(
    converted: DataFrame, slates: int, seed: int, randomness: float = 0.0, teams=None
) -> DataFrame:
    """Flex draws linked to passers, and captains at 1.5 times the player's mean flex score.

    All matchups are simulated in one plan; ``teams`` keeps the ones of a single contest.
    """
    chosen = converted.withColumnRenamed("fpts_proj", "projection")
    if teams is not None:
        chosen = chosen.where(is_in("team", teams))
    # One row per player and role, read three times below; the simulated slates multiply it later. A player's rows are
    # drawn in one task, so that means per slate are made there; a null id is a player too.
    home = ["matchup", "_player", "_unknown"]
    chosen = matchup_of(default_spread(chosen)).withColumns(
        {"_player": F.coalesce("player_id", F.lit("")), "_unknown": F.col("player_id").isNull()}
    )
    chosen = cut_lineage(chosen)
    flex = chosen.where(F.col("position") != "CPTN")
    row = ("player_id", "team", "pos")
    drawn = draw_scores(flex, slates, seed, randomness, SHOWDOWN_FLOOR, key=row, home=home)
    linked = link_to_passers(drawn, SHOWDOWN, key=row)
    mean = linked.groupBy("slate", *home).agg(F.avg("new_proj").alias("_mean"))
    # Every player has all slates, so the sorted means are found by the slate's number.
    means = mean.groupBy(*home).agg(F.sort_array(F.collect_list(F.struct("slate", "_mean"))).alias("_means"))
    # Captain and flex rows never share all join columns, so joining them fully is a padded union: the
    # flex rows the link covers and every captain row. Both take the player's mean flex score.
    kept = chosen.where((F.col("position") == "CPTN") | covered_by(SHOWDOWN)).select(
        *home, "player_id", "player", "salary", "team", "position", "pos"
    )
    joined = with_keys(evenly(kept, *home).join(means.hint("merge"), home, "left"), "slate", slates).select(
        "slate", "matchup", "player_id", "player", "salary", "team", "position", "pos",
        F.get("_means", F.col("slate") - 1)["_mean"].alias("_mean"),
    )
    score = F.when(F.col("position") == "CPTN", F.col("_mean") * CAPTAIN).otherwise(F.col("_mean"))
    out = joined.withColumn("fpts_proj", score).drop("_mean")
    out = out.withColumn("new_pos", F.when(F.col("position") == "CPTN", "CPTN").otherwise(F.col("pos")))
    return with_value(out)


def numbered_showdown(draws: DataFrame) -> DataFrame:
    """Row number within a slate's matchup: flex rows from the best down, then captains by name."""
    cut = draws.withColumn("_role", F.when(F.col("position") == "CPTN", 1).otherwise(0))
    cut = cut.withColumn("_score", F.when(F.col("_role") == 0, F.col("fpts_proj")))
    return best_first(
        cut, ["slate", "matchup"], "_score", ["player_id", "player"], "row_id", lead=["_role"]
    ).drop("_role", "_score")
