"""Slate simulation: draw each player's score, then tie pass catchers, defences and kickers to passers."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.na import floor_at, is_in, safe_ratio
from ..functions.rand import normal
from ..operators.joins import detail_join, natural_join
from ..operators.ordering import best_first
from ..operators.reshape import with_keys
from ..session import evenly

FREE_AGENT = "FA"


@dataclass(frozen=True)
class LinkRule:
    """How a position's score depends on the passer it plays with or against.

    ``share`` positions get ``passer * share * weight + own * (1 - weight)`` where share is the player's
    part of the team's non-passers; ``fixed`` positions get ``passer * a + own * b``; ``against`` ones
    take the opposing passer.
    """

    unchanged: tuple = ("QB", "RB")
    share_positive: dict = field(default_factory=dict)
    share_all: dict = field(default_factory=dict)
    fixed: dict = field(default_factory=dict)
    against: dict = field(default_factory=dict)
    own_floor: dict = field(default_factory=dict)
    passer_positive: bool = True


# Weights of the three contests.
MAIN = LinkRule(
    share_positive={"WR": 0.64}, share_all={"TE": 0.35}, against={"DST": (-0.47, 1.47)},
)
SHOWDOWN = LinkRule(
    share_positive={"WR": 0.64}, share_all={"TE": 0.35}, against={"DST": (-0.17, 1.17)},
    fixed={"K": (0.1, 0.9)}, own_floor={"DST": 0.0},
)
SEASON = LinkRule(share_all={"WR": 0.64, "TE": 0.35}, passer_positive=False)
MAIN_FLOOR = -2.0
SHOWDOWN_FLOOR = -1.0


def match_slate(boom_bust: DataFrame, main_projections: DataFrame, slate: str = "Main") -> DataFrame:
    """Attach each team's opponent and keep the priced players of one slate."""
    matchups = main_projections.select("team", F.col("opponent").alias("opp")).distinct()
    joined = natural_join(boom_bust, matchups, "left", ["team"])
    first = ["name", "team", "opp"]
    joined = joined.select(*first, *[c for c in joined.columns if c not in first])
    return joined.where((F.col("salary") > 0) & (F.col("slate") == slate)).drop("slate")


def draw_scores(
    players: DataFrame, slates: int, seed: int, randomness: float = 0.0, low: float = MAIN_FLOOR,
    key=("name",), value: str = "projection", home=(),
) -> DataFrame:
    """One normal draw per player and slate, raised to the floor; a player without a projection stays null.

    ``key`` tells the rows apart: rows that agree in it get the same random number. Rows that agree in ``home`` are drawn
    in the same task.
    """
    repeated = with_keys(evenly(players, *home), "slate", slates)
    drawn = normal(seed, ["slate", *key], value, F.col("std_dev") * (1.0 + randomness))
    return repeated.withColumn(value, floor_at(drawn, low))


def _team_sums(players: DataFrame, slate, own: str, base: str, passer_positive: bool) -> DataFrame:
    """Per team: its passers' total, the passers' total of the team it faces, and its other players' totals.

    One pass over the players: sums per (team, opponent) first, and each of those then counts once for its
    own team and once for the opponent. A total is null when any of its scores is missing; a team without
    passers has no passers' total.
    """
    is_qb = F.col("pos") == "QB"
    not_qb = F.col("pos") != "QB"

    def total(cond: Column, c: str, name: str) -> list[Column]:
        x = F.when(cond, F.col(c))
        return [
            F.sum(F.when(x > 0, x).otherwise(0.0)).alias(f"_{name}_positive"), F.sum(x).alias(f"_{name}_sum"),
            F.count(F.when(cond, 1)).alias(f"_{name}_n"), F.count(x).alias(f"_{name}_known"),
        ]

    sides = players.groupBy(*slate, "team", "opp").agg(*total(is_qb, base, "qb"), *total(not_qb, own, "rest"))
    own_side = F.struct(F.col("team").alias("_of"), F.lit(True).alias("_own"))
    other_side = F.struct(F.col("opp").alias("_of"), F.lit(False).alias("_own"))
    spread = sides.withColumn("_side", F.explode(F.array(own_side, other_side))).select(
        "*", "_side._of", "_side._own"
    )

    def gather(cond: Column, name: str, positive: bool) -> Column:
        summed = F.sum(F.when(cond, F.col(f"_{name}_{'positive' if positive else 'sum'}")))
        seen = F.sum(F.when(cond, F.col(f"_{name}_n")).otherwise(0))
        known = F.sum(F.when(cond, F.col(f"_{name}_known")).otherwise(0))
        return F.when((seen > 0) & (seen == known), summed)

    mine, theirs = F.col("_own"), ~F.col("_own")
    return spread.groupBy(*slate, F.col("_of").alias("team")).agg(
        gather(mine, "qb", passer_positive).alias("qb_proj"), gather(theirs, "qb", passer_positive).alias("_facing"),
        gather(mine, "rest", True).alias("_positive"), gather(mine, "rest", False).alias("_all"),
    )


def covered_by(rule: LinkRule) -> Column:
    """Players whose score the rule defines."""
    linked = [*rule.share_positive, *rule.share_all, *rule.fixed, *rule.against]
    hired = F.coalesce(F.col("team") != FREE_AGENT, F.lit(False))
    return is_in("pos", rule.unchanged) | (is_in("pos", linked) & hired)


def link_to_passers(
    players: DataFrame, rule: LinkRule, slate=("slate",), own: str = "projection",
    base: str | None = None, key=("name",),
) -> DataFrame:
    """Adjusted score ``new_proj`` of every player the rule covers; other positions are dropped.

    ``own`` sets the share of the team; ``base`` (the same by default) is the score that is blended and
    summed for the passers. Team sums are aggregated and joined back rather than windowed, so a team
    with most of the players does not sit in one task; they are made and counted first, and the draws stay where
    they are if these are few.
    """
    slate = list(slate)
    base = base or own
    if "opp" not in players.columns:
        players = players.withColumn("opp", F.lit(None).cast("string"))
    sums = _team_sums(players, slate, own, base, rule.passer_positive)
    joined = detail_join(players, sums, [*slate, "team"], list(key))
    score = F.col(base)

    def floored(pos: str) -> Column:
        return floor_at(score, rule.own_floor[pos]) if pos in rule.own_floor else score

    hired = F.col("team") != FREE_AGENT
    new = F.when(is_in("pos", rule.unchanged), F.col(own))
    for total, weights in (("_positive", rule.share_positive), ("_all", rule.share_all)):
        for pos, weight in weights.items():
            part = safe_ratio(own, total)
            new = new.when((F.col("pos") == pos) & hired, F.col("qb_proj") * part * weight + score * (1 - weight))
    for passer, weights in (("qb_proj", rule.fixed), ("_facing", rule.against)):
        for pos, (a, b) in weights.items():
            new = new.when((F.col("pos") == pos) & hired, F.col(passer) * a + floored(pos) * b)
    return joined.where(covered_by(rule)).withColumn("new_proj", new).drop("qb_proj", "_positive", "_all", "_facing")


def simulate_main(slate_players: DataFrame, slates: int, seed: int, randomness: float = 0.0) -> DataFrame:
    """Main-slate draws of every player, linked to passers, in every simulated slate."""
    players = slate_players.select(
        F.col("name"), "team", "opp", "salary", F.col("position").alias("pos"), "projection", "std_dev"
    )
    row = ("name", "team", "pos")
    drawn = draw_scores(players, slates, seed, randomness, key=row).drop("std_dev")
    linked = link_to_passers(drawn, MAIN, key=row)
    return linked.select(
        "slate", F.col("name").alias("player"), "team", F.col("pos").alias("position"),
        F.col("salary").cast("int").alias("salary"), F.col("new_proj").alias("fpts_proj"),
    )


def ranked_main(draws: DataFrame) -> DataFrame:
    """Draws with the row number and text id of each player within its slate."""
    out = best_first(draws, ["slate"], "fpts_proj", ["player"], "row_id")
    return out.withColumn("player_id", F.col("row_id").cast("string"))


def season_slice(projections: DataFrame, week: int = 1, qb_rank: float = 33, te_rank: float = 40, rank: float = 75):
    """The ranked players of one week."""
    return projections.where(F.col("week") == week).where(
        ((F.col("pos") != "QB") | (F.col("ecr") < qb_rank))
        & ((F.col("pos") != "TE") | (F.col("ecr") <= te_rank))
        & (F.col("ecr") <= rank)
    )


def season_projection(projections: DataFrame, key, slate=()) -> DataFrame:
    """Season form of the passer link: shares from the projection, scores from the simulated score."""
    return link_to_passers(
        projections, SEASON, slate=slate, own="projection", base="projected_score", key=key
    )
