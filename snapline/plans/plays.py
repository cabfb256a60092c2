"""Play-level analyses: passers, rolling efficiency, game table, season and career rates, red zone, totals."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.na import if_else, is_in, n_distinct_na, na_corr, present, rounded, safe_ratio
from ..functions.text import columns_containing
from ..operators.joins import natural_join, salted_join
from ..operators.ordering import ID_BLOCK, desc_last, positions, rolling_mean, running_total
from ..operators.quantiles import density_curve, grouped_quantiles
from ..operators.topn import last_rows, top_n
from ..session import cut_lineage

GAME = ["game_id", "posteam", "season"]
PASSER = ["primary_passer_name", "primary_passer_id"]
ROLLS = {"roll_5_epa": 5, "roll_10_epa": 10, "roll_25_epa": 25, "roll_50_epa": 50}


def scored_plays(plays: DataFrame) -> DataFrame:
    """Regular-season plays with a known score and an offence."""
    return plays.where(
        F.col("score_differential").isNotNull() & (F.col("season_type") == "REG") & present("posteam")
    )


def dropbacks(plays: DataFrame) -> DataFrame:
    return scored_plays(plays).where(F.col("qb_dropback") == 1)


def primary_passer(plays: DataFrame) -> DataFrame:
    """The passer with the most dropbacks of each team-game; ties give several."""
    counts = dropbacks(plays).groupBy(*GAME, "passer_player_name", "passer_player_id").agg(
        F.count(F.lit(1)).alias("dropbacks")
    )
    return top_n(counts, 1, "dropbacks", GAME).select(
        *GAME, F.col("passer_player_name").alias(PASSER[0]), F.col("passer_player_id").alias(PASSER[1]), "dropbacks"
    )


def passer_recency(plays: DataFrame) -> DataFrame:
    """Primary passers of every team-game, numbered from the newest game of the passer backwards.

    The plays are reduced to their team-games before the join: the result is the distinct set anyway.
    Games of one week (a doubtful passer shared by two teams) are ordered by game and team.
    """
    games = dropbacks(plays).select(*GAME, "week").distinct()
    joined = natural_join(games, primary_passer(plays).drop("dropbacks"), "left", GAME)
    joined = joined.select(*GAME, "week", *PASSER).distinct()
    return positions(
        joined, PASSER, desc_last("season", "week", "game_id", "posteam"),
        ["season", "week"], desc_last("season", "week"), "primary_passer_game_recency",
    )


def rolling_passer_epa(plays: DataFrame, widths: dict[str, int] = ROLLS) -> DataFrame:
    """Rolling efficiency at the newest play of each passer-game.

    Frames are centred in newest-first order, so they reach into newer plays as well as older ones.
    """
    known = dropbacks(plays).where(F.col("epa").isNotNull()).select(*GAME, "week", "play_id", "epa")
    joined = salted_join(known, passer_recency(plays), [*GAME, "week"], ["play_id"])
    joined = joined.where(F.col(PASSER[0]).isNotNull())
    joined = joined.withColumn("_ids", F.floor(F.col("play_id") / ID_BLOCK))
    numbered = positions(
        joined, PASSER, desc_last("season", "week", "play_id", "game_id", "posteam"),
        ["season", "week", "_ids"], desc_last("season", "week", "_ids"), "_row",
    )
    rolled = rolling_mean(numbered, PASSER, "epa", widths, "_row")
    rolled = rolled.select("game_id", *PASSER, "primary_passer_game_recency", "posteam", "epa", "play_id", *widths)
    return last_rows(rolled, "play_id", [*PASSER, "game_id"])


def game_table(plays: DataFrame, tie=("play_id",)) -> DataFrame:
    """One row per team-game: line, implied total, pass and run counts.

    ``tie`` is the order that decides which play is the first of the game.
    """
    first = F.struct(*[F.col(c) for c in tie])
    counted = (
        scored_plays(plays).where(is_in("play_type", ["run", "pass"]))
        .groupBy(*GAME)
        .agg(
            *[F.min_by(c, first).alias(c) for c in ("home_team", "away_team", "spread_line", "total_line")],
            F.count(F.lit(1)).alias("off_plays"),
            F.count_distinct(F.when(F.col("play_type") == "pass", F.col("play_id"))).alias("passes"),
        )
    )
    return (
        counted.withColumn("rushes", F.col("off_plays") - F.col("passes"))
        .withColumn(
            "off_spread",
            if_else(F.col("posteam") == F.col("home_team"), F.col("spread_line"), F.col("spread_line") * -1),
        )
        .withColumn("off_implied", F.col("total_line") / 2 + F.col("off_spread") / 2)
    )


def game_table_with_rolls(plays: DataFrame, tie=("play_id",), match_team: bool = False) -> DataFrame:
    """Game table with the rolling efficiency of its passers.

    As written, only the game is matched, so each team row meets the passers of both teams;
    ``match_team`` gives each team its own passer.
    """
    rolls = rolling_passer_epa(plays)
    keys = ["game_id", "posteam"] if match_team else ["game_id"]
    if not match_team:
        rolls = rolls.drop("posteam")
    return (
        natural_join(game_table(plays, tie), rolls, "left", keys)
        .drop("spread_line").withColumnRenamed("posteam", "off_team")
    )


def correlations(df: DataFrame, columns, digits: int = 2) -> DataFrame:
    """Correlation of every pair of columns in long form, from one aggregation."""
    columns = list(columns)
    pairs = [(a, b) for a, b in combinations_with_replacement(columns, 2)]
    cells = {}
    row = df.agg(*[na_corr(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    for i, (a, b) in enumerate(pairs):
        cells[a, b] = cells[b, a] = F.col(f"_{i}")
    entries = [
        F.struct(F.lit(a).alias("var_x"), F.lit(b).alias("var_y"), rounded(cells[a, b], digits).alias("corr"))
        for a in columns for b in columns
    ]
    return row.select(F.inline(F.array(*entries)))


def play_correlations(games: DataFrame, after_season: int = 2007, digits: int = 2) -> DataFrame:
    """Correlation of play counts with the rolling means."""
    picked = games.where(F.col("season") > after_season)
    return correlations(picked, ["off_plays", *columns_containing(picked, "roll")], digits)


def _qualified(plays: DataFrame, rosters: DataFrame, least: int) -> DataFrame:
    """Dropback sums per (passer, season, week, roster name) of passers with enough dropbacks.

    The plays are summed first; a roster with several rows for a passer-season repeats the plays, which
    shows as ``copies``. After the sums a passer-season is a handful of weeks, so the window is small.
    """
    regular = plays.where((F.col("season_type") == "REG") & (F.col("qb_dropback") == 1))
    weekly = regular.groupBy("passer_id", "season", "week").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(c).alias(f"_s_{c}") for c in ("yards_gained", "ep", "epa")],
        *[F.count(c).alias(f"_c_{c}") for c in ("yards_gained", "ep", "epa")],
    )
    named = rosters.select(F.col("gsis_id").alias("passer_id"), "season", "full_name")
    named = named.groupBy("passer_id", "season", "full_name").agg(F.count(F.lit(1)).alias("_copies"))
    joined = natural_join(weekly, named, "left", ["passer_id", "season"]).fillna(1, subset=["_copies"])
    for c in joined.columns:
        if c.startswith(("_n", "_s_", "_c_")):
            joined = joined.withColumn(c, F.col(c) * F.col("_copies"))
    total = F.sum("_n").over(Window.partitionBy("passer_id", "season"))
    return joined.withColumn("passer_season_dropbacks", total).where(F.col("passer_season_dropbacks") >= least)


def _mean(c: str):
    return safe_ratio(F.sum(f"_s_{c}"), F.sum(f"_c_{c}"))


def season_efficiency(
    plays: DataFrame, rosters: DataFrame, least: int = 25, weeks: int = 18, digits: int = 3
) -> DataFrame:
    """Passing efficiency per season over passers with at least ``least`` dropbacks."""
    return _by_season(_qualified(plays, rosters, least), weeks, digits)


def _by_season(kept: DataFrame, weeks: int = 18, digits: int = 3) -> DataFrame:
    out = kept.groupBy("season").agg(
        n_distinct_na("passer_id").alias("_passers"), n_distinct_na("week").alias("_weeks"),
        F.sum("_n").alias("dropbacks"), _mean("yards_gained").alias("aya"), _mean("ep").alias("ep"),
        rounded(_mean("epa"), digits).alias("epa"),
    )
    return out.select(
        "season", (safe_ratio("_passers", "_weeks") * weeks).alias("adj_passers"), "dropbacks", "aya", "ep", "epa"
    )


def career_efficiency(
    plays: DataFrame, rosters: DataFrame, least: int = 25, digits: int = 3, play_key=("game_id", "play_id")
) -> DataFrame:
    """Passing efficiency per named passer, with the share of dropbacks above the best season mean met.

    The written form of that share answers a vector; this is the evident intent.
    """
    # Weekly sums, small beside the plays and read four times below.
    qualified = cut_lineage(_qualified(plays, rosters, least))
    kept = qualified.where(F.col("full_name").isNotNull())
    season_epa = _by_season(qualified, digits=digits).select("season", F.col("epa").alias("season_epa"))
    with_bar = natural_join(kept, season_epa, "left", ["season"])
    career = with_bar.groupBy("passer_id", "full_name").agg(
        F.sum("_n").alias("dropbacks"), F.max("season_epa").alias("best_season_epa"),
        _mean("yards_gained").alias("aya"), _mean("ep").alias("ep"), rounded(_mean("epa"), digits).alias("epa"),
    )
    seasons = kept.groupBy("passer_id", "season", "full_name").agg(F.max("_copies").alias("_copies"))
    bars = natural_join(
        seasons, career.select("passer_id", "full_name", "best_season_epa"), "inner", ["passer_id", "full_name"]
    )
    regular = plays.where((F.col("season_type") == "REG") & (F.col("qb_dropback") == 1)).select(
        "passer_id", "season", "epa", *play_key
    )
    hits = (
        salted_join(regular, bars, ["passer_id", "season"], list(play_key), "inner")
        .groupBy("passer_id", "full_name")
        .agg(F.sum(F.when(F.col("epa") > F.col("best_season_epa"), F.col("_copies")).otherwise(0)).alias("_hits"))
    )
    out = natural_join(career, hits, "left", ["passer_id", "full_name"])
    return out.select(
        "passer_id", "full_name", "dropbacks", safe_ratio("_hits", "dropbacks").alias("season_sr"), "aya", "ep", "epa"
    )


def red_zone(plays: DataFrame, season: int | None = 2022, inside: int = 20) -> DataFrame:
    """Expected points per red-zone drive of each team-season."""
    near = plays.where(
        (F.col("yardline_100") <= inside) & is_in("play_type", ["pass", "run", "field_goal"])
    )
    drives = near.groupBy("posteam", "season", "game_id", "drive").agg(
        F.count(F.lit(1)).alias("plays"), F.max("ep").alias("ep"), F.sum("epa").alias("epa")
    )
    teams = drives.withColumn("drives", F.lit(1)).groupBy("posteam", "season").agg(
        F.sum("drives").alias("drives"), F.sum("plays").alias("plays"),
        F.sum(F.coalesce("epa", F.lit(0.0))).alias("epa"), F.sum("ep").alias("ep"),
    )
    teams = teams.withColumn("epa_play", safe_ratio("epa", "plays")).withColumn(
        "ep_rzdrive", safe_ratio("ep", "drives")
    )
    if season is not None:
        teams = teams.where(F.col("season") == season)
    return teams.select("posteam", "season", "drives", "plays", "epa", "epa_play", "ep", "ep_rzdrive")


def score_differentials(plays: DataFrame) -> DataFrame:
    """Share and running share of each final score differential, the most common first."""
    last = last_rows(
        plays.where(F.col("score_differential").isNotNull() & (F.col("season_type") == "REG"))
        .select("game_id", "play_id", "score_differential"),
        "play_id", ["game_id"],
    )
    counts = last.groupBy("score_differential").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n")).scalar()
    shares = counts.withColumn("share", F.col("n") / whole)
    shares = shares.withColumn("pct", F.round(F.col("share") * 100, 1))
    shares = shares.withColumn("_near", F.floor(F.col("score_differential") / 1024))
    # The running share follows the exact count, ties by the differential.
    out = running_total(
        shares.withColumn("_negated", -F.col("n")), [],
        [F.col("_negated").asc(), F.col("score_differential").asc()],
        ["_negated", "_near"], [F.col("_negated").asc(), F.col("_near").asc()], "pct", "sum",
    )
    return out.select("score_differential", "n", "pct", rounded("sum", 1).alias("sum"))


def closing_plays(plays: DataFrame) -> DataFrame:
    """Last play of each regular-season game with a betting line."""
    lined = plays.where(F.col("total_line").isNotNull() & (F.col("season_type") == "REG"))
    return last_rows(lined.select("game_id", "play_id", "total", "total_line"), "play_id", ["game_id"])


def total_bands(plays: DataFrame, more_than: int = 10, cell: float = 1.0) -> DataFrame:
    """20, 50 and 80 percent quantiles of the points scored at each betting line."""
    probs = {"lower": 0.2, "median": 0.5, "upper": 0.8}
    bands = grouped_quantiles(closing_plays(plays), ["total_line"], "total", probs, cell)
    return bands.where(F.col("n") > more_than)


def total_outcomes(plays: DataFrame, more_than: int = 10, cell: float = 1.0) -> DataFrame:
    """Every game with the count, median and 95 percent range of its betting line."""
    last = closing_plays(plays)
    probs = {"med": 0.5, "upper": 0.975, "lower": 0.025}
    bands = grouped_quantiles(last, ["total_line"], "total", probs, cell).where(F.col("n") > more_than)
    return salted_join(last, bands, ["total_line"], ["game_id"], "inner")


def total_density(plays: DataFrame, more_than: int = 10, cell: float = 1.0, **grid) -> DataFrame:
    """Density of the points scored at each betting line."""
    curves = density_curve(closing_plays(plays), ["total_line"], "total", cell, **grid)
    return curves.where(F.col("n") > more_than)
