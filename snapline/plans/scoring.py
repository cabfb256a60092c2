"""Score lineups in simulated slates, keep the best, count exposure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.na import floor_at, na_sum, percent_text
from ..functions.text import extract_first, player_from_label
from ..operators.joins import counted, natural_join, salted_join
from ..operators.reshape import nest_rows, unnest_rows, wide_to_long, with_keys
from ..operators.topn import top_n
from ..session import evenly
from .simulate import MAIN_FLOOR

MEMBER = ["player", "team", "position", "salary"]


def score_in_slates(
    draws: DataFrame, members: DataFrame, lineup, sims: int, sim: str = "sim", digits: int | None = 2
) -> DataFrame:
    """Score of every lineup in every simulated slate, numbered 1 to ``sims`` in column ``sim`` of the draws.

    Draws and members meet on the player. The draws of a player are spread by slate, so a popular player
    does not decide the run time; if the lineups hold few players, only their draws are taken, where they are made.
    A member without a draw adds nothing; the lineup stays. Lineups that hold no player
    drawn in every slate get a row of 0 per slate to add to; no others do.
    """
    lineup = list(lineup)
    drawn = draws.select(sim, *MEMBER, "fpts_proj")
    held = members.select(*lineup, *MEMBER)
    players, few = counted(held.select(*MEMBER).distinct())
    if few:
        drawn = natural_join(drawn, players, "inner", MEMBER)
    met = salted_join(drawn, held, MEMBER, [sim], "inner").select(sim, *lineup, "fpts_proj")
    always = drawn.groupBy(*MEMBER).agg(F.count_distinct(sim).alias("_sims")).where(F.col("_sims") == sims)
    sure = natural_join(held, always, "left", MEMBER).groupBy(*lineup).agg(F.max("_sims").alias("_sims"))
    zeros = with_keys(sure.where(F.col("_sims").isNull()).select(*lineup), sim, sims)
    zeros = zeros.select(F.col(sim).cast(dict(met.dtypes)[sim]).alias(sim), *lineup, F.lit(0.0).alias("fpts_proj"))
    score = F.coalesce(F.sum("fpts_proj"), F.lit(0.0))
    if digits is not None:
        score = F.round(score, digits)
    return met.unionByName(zeros).groupBy(sim, *lineup).agg(score.alias("lineup_score"))


def mean_scores(scores: DataFrame, lineup) -> DataFrame:
    return scores.groupBy(*lineup).agg(F.avg("lineup_score").alias("lineup_score"))


def keep_best(scores: DataFrame, members: DataFrame, k: int, lineup) -> DataFrame:
    """Members of the k best lineups, ties kept."""
    return natural_join(top_n(scores, k, "lineup_score"), members, "left", lineup)


def exposure(members: DataFrame, lineups: int, by=("player", "position", "salary", "team")) -> DataFrame:
    """Share of the kept lineups each player is in."""
    return members.groupBy(*by).agg((F.count(F.lit(1)) / F.lit(float(lineups))).alias("exp"))


def exposure_table(exposures: DataFrame, k: int | None = None, position: str = "position") -> DataFrame:
    """Exposure as text; with ``k`` the most used players of each position, ties kept."""
    table = exposures if k is None else top_n(exposures, k, "exp", [position])
    return table.withColumn("exp_text", percent_text("exp"))


def showdown_plays(members: DataFrame, lineups: int, contest=("matchup",)) -> DataFrame:
    """Share of the lineups in which a player fills a role."""
    return members.groupBy(*contest, "player_id", "player", "pos", "position").agg(
        F.lit(lineups).alias("total"), F.count(F.lit(1)).alias("n"),
        (F.count(F.lit(1)) / F.lit(float(lineups))).alias("pct"),
    )


def showdown_players(members: DataFrame, lineups: int, contest=("matchup",)) -> DataFrame:
    """Share of the lineups that hold a player in any role, shown on the flex rows."""
    plays = showdown_plays(members, lineups, contest)
    both = plays.groupBy(*contest, "player_id").agg(F.sum("n").alias("player_n"))
    both = both.withColumn("player_pct", F.col("player_n") / F.lit(float(lineups)))
    return natural_join(plays, both, "left", [*contest, "player_id"]).where(F.col("position") != "CPTN").select(
        *contest, "player", "pos", "player_n", "player_pct"
    )


def lineup_share(members: DataFrame, contest=()) -> DataFrame:
    """Appearances over the highest lineup number, per player and position."""
    return members.groupBy(*contest, "player_id", "pos").agg(
        F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / F.max("lineup")).alias("pct")
    )


# The slots' names in the headers of a lineup grid.
SLOT_NAMES = ("qb", "rb_", "wr_", "te", "flex", "dst")


def read_grid(grid: DataFrame, players: DataFrame) -> DataFrame:
    """Lineup grid, one slot per column, to (number, player, pos, team) rows."""
    long = wide_to_long(grid, SLOT_NAMES, "roster_pos", "player_label")
    named = long.select("number", player_from_label("player_label").alias("player"))
    return salted_join(named, players.select("player", "pos", "team"), ["player"], ["number"], salts=4, grows=True)


def read_grid_draws(projections: DataFrame, low: float = MAIN_FLOOR) -> DataFrame:
    """Wide simulated projections, one draw per column, to (player, pos, sim_num, sim_proj) rows."""
    long = wide_to_long(projections, "number", "sim_num", "sim_proj")
    return long.select(
        "player", "pos", extract_first("sim_num", "[0-9]+").cast("int").alias("sim_num"),
        floor_at(F.col("sim_proj").cast("double"), low).alias("sim_proj"),
    )


def picked_draws(draws: DataFrame, first: int = 1, last: int = 2) -> DataFrame:
    """The draws ``first`` to ``last`` of every player, picked from the player's nested draws.

    Draws are nested by player, as many as there are draws, and not by draw, where a row would hold all players.
    """
    nested = nest_rows(draws, ["player", "pos"], ["sim_num", "sim_proj"], "data")
    some = F.filter("data", lambda x: x["sim_num"].between(first, last))
    one = F.element_at(F.filter("data", lambda x: x["sim_num"] == first), 1)["sim_proj"]
    return unnest_rows(nested.select("player", "pos", one.alias("first_proj"), some.alias("data")), "data")


def grid_scores(draws: DataFrame, grid: DataFrame) -> DataFrame:
    """Mean score of every grid lineup over all draws; null when a member lacks any draw.

    The mean over draws of a sum over members equals the sum over members of the means over draws, so
    the draws are averaged per player first and the draws-by-lineups table is never formed.
    """
    sims = draws.agg(F.count_distinct("sim_num")).scalar()
    # A player with several rows has their sum in each draw.
    draws = draws.groupBy("player", "pos", "sim_num").agg(na_sum("sim_proj").alias("sim_proj"))
    player = draws.groupBy("player", "pos").agg(
        F.avg("sim_proj").alias("_mean"), F.count("sim_proj").alias("_have")
    )
    player = player.where(F.col("_have") == sims).select("player", "pos", "_mean")
    met = salted_join(grid, player, ["player", "pos"], ["number"], salts=4, grows=True)
    return met.groupBy("number").agg(na_sum("_mean").alias("lineup_score"))


def grid_scores_by_draw(draws: DataFrame, grid: DataFrame) -> DataFrame:
    """Score of every grid lineup in every draw, for the draws in which all its members appear."""
    # A player with several rows has their sum in each draw.
    draws = draws.groupBy("player", "pos", "sim_num").agg(na_sum("sim_proj").alias("sim_proj"))
    entry = F.struct("sim_num", "sim_proj", F.lit(False).alias("_member"))
    nested = draws.groupBy("player", "pos").agg(F.collect_list(entry).alias("_draws"))
    # Members meet their players' nested draws and are dealt out by lineup; only there the draws become rows. One more
    # row stands for the member itself, so that the lineup's size is counted along with its scores.
    met = salted_join(grid, nested, ["player", "pos"], ["number"], salts=4, grows=True).select("number", "_draws")
    kinds = dict(draws.dtypes)
    itself = F.struct(
        F.lit(None).cast(kinds["sim_num"]).alias("sim_num"), F.lit(None).cast(kinds["sim_proj"]).alias("sim_proj"),
        F.lit(True).alias("_member"),
    )
    rows = evenly(met, "number").select(
        "number", F.inline(F.when(F.col("_draws").isNull(), F.array(itself)).otherwise(F.array_append("_draws", itself)))
    )
    scores = rows.groupBy("number", "sim_num", "_member").agg(
        F.sum("sim_proj").alias("lineup_score"), F.count("sim_proj").alias("_have"), F.count(F.lit(1)).alias("_n")
    )
    size = F.max(F.when(F.col("_member"), F.col("_n"))).over(Window.partitionBy("number"))
    whole = scores.withColumn("_size", size).where(~F.col("_member") & (F.col("_have") == F.col("_size")))
    return whole.select("sim_num", "number", "lineup_score")


def grid_exposure(scores: DataFrame, grid: DataFrame, k: int = 150) -> DataFrame:
    """Exposure in the k best grid lineups."""
    best = keep_best(scores, grid, k, ["number"])
    return exposure(best, k, ("player", "pos", "team"))
