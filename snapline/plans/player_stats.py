"""Weekly player stats: per-game rates, touchdown rates, season pace, year-over-year change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.na import fill_numeric, if_else, is_in, na_mean, na_sum, not_in, number_text, percent_text, safe_ratio
from ..operators.joins import natural_join
from ..operators.quantiles import density_curve
from ..operators.reshape import with_group_means
from ..operators.topn import top_n

PLAYER_SEASON = ["player_id", "position", "season"]
EPA = ["passing_epa", "rushing_epa", "receiving_epa"]

# Players left out of the pace chart.
RETIRED = (
    "Andrew Luck",
    "Drew Brees",
    "Philip Rivers",
    "Antonio Brown",
    "Rob Gronkowski",
    "Emmanuel Sanders",
)
ALWAYS_SHOWN = ("Brock Purdy",)
LEFT_OUT_OF_CHANGE = ("Tim Tebow",)


def _newest(c: str, tie) -> Column:
    """Value on the newest week; ``tie`` orders rows of one week."""
    return F.max_by(c, F.struct("season", "week", *tie))


def _season_sums(stats: DataFrame, tie) -> DataFrame:
    return stats.groupBy(*PLAYER_SEASON).agg(
        _newest("recent_team", tie).alias("recent_team"),
        _newest("player_display_name", tie).alias("player_name"),
        F.count(F.lit(1)).alias("games"),
        na_sum("targets").alias("_targets"), na_sum("carries").alias("_rushes"), na_sum("attempts").alias("_passes"),
        *[na_sum(c).alias(f"_{c}") for c in EPA],
        (na_sum("receiving_tds") + na_sum("rushing_tds") + na_sum("passing_tds")).alias("_tds"),
    )


def _named(stats: DataFrame, season_type: str) -> DataFrame:
    return stats.where(F.col("player_name").isNotNull() & (F.col("season_type") == season_type))


def _rates(sums: DataFrame) -> DataFrame:
    per_game = sums.select(
        *PLAYER_SEASON, "recent_team", "player_name", "games",
        *[safe_ratio(f"_{c}", "games").alias(c) for c in ("targets", "rushes", "passes")],
        safe_ratio(F.col("_passing_epa") + F.col("_rushing_epa") + F.col("_receiving_epa"), "games").alias("epa"),
        "_tds",
    ).withColumn("opps", F.col("targets") + F.col("rushes") + F.col("passes"))
    return (
        per_game.withColumn("tds_opp", safe_ratio("_tds", F.col("opps") * F.col("games")))
        .withColumn("touchdowns", safe_ratio("_tds", "games")).drop("_tds")
    )


def playoff_rates(
    stats: DataFrame, season: int = 2022, teams=("PHI", "KC"), min_opps: float = 3, tie=()
) -> DataFrame:
    """Per-game rates of two teams' players in the post-season."""
    chosen = _named(stats, "POST").where((F.col("season") == season) & is_in("recent_team", teams))
    rates = _rates(_season_sums(fill_numeric(chosen, 0, EPA), tie))
    return rates.withColumn("epa_play", safe_ratio("epa", "opps")).where(F.col("opps") > min_opps)


def team_rollup(rates: DataFrame) -> DataFrame:
    """Team totals of the post-season rates."""
    return rates.groupBy("recent_team").agg(
        na_sum("opps").alias("opps"), na_sum("epa").alias("epa"), na_mean("epa_play").alias("epa_play")
    )


def touchdown_rates(stats: DataFrame, tie=()) -> DataFrame:
    """Season totals and touchdowns per opportunity."""
    sums = _season_sums(_named(stats, "REG"), tie)
    out = sums.select(
        *PLAYER_SEASON, "recent_team", "player_name", "games",
        *[F.col(f"_{c}").alias(c) for c in ("targets", "rushes", "passes")],
        (F.col("_targets") + F.col("_rushes") + F.col("_passes")).alias("opps"), F.col("_tds").alias("touchdowns"),
    )
    return out.withColumn("tds_opp", safe_ratio("touchdowns", "opps"))


def per_game_rates(stats: DataFrame, tie=()) -> DataFrame:
    """Per-game season rates and touchdowns per opportunity."""
    return _rates(_season_sums(fill_numeric(_named(stats, "REG"), 0, EPA), tie))


def season_pace(rates: DataFrame, first: int = 2021, last: int = 2022, games: int = 17) -> DataFrame:
    """Two seasons of a player joined into a per-game pace and its full-season value."""
    recent = rates.where(F.col("season").between(first, last))
    out = recent.groupBy("player_id", "player_name", "position").agg(
        F.max_by("recent_team", "season").alias("team"), na_sum("games").alias("games"),
        na_sum("touchdowns").alias("_tds"), na_sum("opps").alias("_opps"),
        F.avg("opps").alias("opps"), F.avg("epa").alias("epa"),
    )
    return out.select(
        "player_id", "player_name", "position", "team", "games", safe_ratio("_tds", "_opps").alias("td_opp"),
        "opps", "epa", (F.col("epa") * games).alias(f"epa_{games}"),
    )


def pace_chart(
    pace: DataFrame, k: int = 25, min_games: int = 20, min_opps: float = 4, retired=RETIRED, always=ALWAYS_SHOWN,
    positions=("TE", "RB", "WR", "QB"),
) -> DataFrame:
    """The k players with the best full-season pace."""
    kept = pace.where(
        (((F.col("games") >= min_games) & (F.col("opps") >= min_opps)) | is_in("player_name", always))
        & not_in("player_name", retired)
    )
    # Shading marks the retired, who are not in the table, so it is the pace of all others.
    kept = kept.withColumn("player_label", F.concat_ws(" - ", "player_name", "position")).withColumn(
        "new_alpha", F.col("epa_17")
    )
    return top_n(kept.where(is_in("position", positions) & (F.col("epa") > 0)), k, "epa_17")


def passer_rate_chart(
    pace: DataFrame, k: int = 25, min_games: int = 16, min_opps: float = 5, retired=RETIRED
) -> DataFrame:
    """The k passers with the most touchdowns per opportunity."""
    kept = pace.where((F.col("games") >= min_games) & (F.col("opps") >= min_opps) & (F.col("position") == "QB"))
    best = top_n(kept.withColumn("player_label", F.concat_ws(" - ", "player_name", "position")), k, "td_opp")
    top = F.max("td_opp").over(Window.partitionBy())
    return best.withColumn("new_alpha", F.when(is_in("player_name", retired), top).otherwise(F.col("td_opp")))


def touchdown_leaders(rates: DataFrame, k: int = 25, position: str = "WR") -> DataFrame:
    """The k player-seasons with the highest touchdown rate."""
    kept = rates.where((F.col("opps") > 5) & (F.col("position") == position) & (F.col("games") > 2))
    best = top_n(kept, k, "tds_opp")
    return best.select(
        "player_name", "position", "games", "season", "tds_opp", percent_text("tds_opp").alias("tds_opp_text")
    )


def next_season_change(rates: DataFrame, open_season: int = 2022) -> DataFrame:
    """Each player-season with the same player's next season, and the change to it."""
    later = rates.select(
        "player_id", "position", "player_name", (F.col("season") - 1).alias("season"),
        F.col("opps").alias("season_n_1_opps"), F.col("tds_opp").alias("season_n_1_tds_opp"),
    )
    joined = natural_join(rates, later, "left", ["player_id", "position", "player_name", "season"])
    year = F.col("season").cast("int")
    span = if_else(
        year == open_season, F.concat(year.cast("string"), F.lit("-")),
        F.concat_ws("-", year.cast("string"), (year + 1).cast("string")),
    )
    return joined.select(
        "player_id", "player_name", "position", span.alias("range"), "season", "games", "targets", "rushes",
        "passes", "opps", "touchdowns", "tds_opp", "season_n_1_opps", "season_n_1_tds_opp",
        (F.col("season_n_1_opps") - F.col("opps")).alias("season_n_1_opp_diff"),
        (F.col("season_n_1_tds_opp") - F.col("tds_opp")).alias("season_n_1_diff"),
    )


def over_achievers(
    changes: DataFrame, first: int = 2015, last: int = 2022, min_rate: float = 0.10, min_opps: float = 5,
    positions=("WR", "TE", "RB"), left_out=LEFT_OUT_OF_CHANGE,
) -> DataFrame:
    """High touchdown rates with next season's change, and a mean row per position."""
    kept = changes.where(
        (F.col("tds_opp") >= min_rate) & is_in("position", positions) & not_in("player_name", left_out)
        & F.col("season").between(first, last) & (F.col("opps") >= min_opps) & (F.col("games") > 1)
    )
    table = with_group_means(
        kept, "position", ["player_name", "range", "games", "opps"],
        ["tds_opp", "season_n_1_opp_diff", "season_n_1_diff"],
    )
    return table.withColumns(
        {
            "opps_text": number_text("opps"), "tds_opp_text": percent_text("tds_opp"),
            "change_text": percent_text("season_n_1_diff"), "opp_change_text": number_text("season_n_1_opp_diff"),
        }
    )


def change_density(changes: DataFrame, min_rate: float = 0.1, min_opps: float = 3, cell: float = 0.01, **grid) -> DataFrame:
    """Density of next season's change in touchdown rate, per position."""
    kept = changes.where((F.col("games") > 1) & (F.col("opps") >= min_opps) & (F.col("tds_opp") > min_rate))
    return density_curve(kept, ["position"], "season_n_1_diff", cell, **grid)
