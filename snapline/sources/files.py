"""Inputs: landed Parquet partitioned by season, and CSV files with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_names

# Column types of the inputs; names are the normalised ones.
SCHEMAS = {
    "plays": (
        "game_id string, play_id int, season int, week int, season_type string, posteam string, "
        "home_team string, away_team string, play_type string, qb_dropback int, passer_id string, "
        "passer_player_id string, passer_player_name string, yardline_100 int, drive int, "
        "yards_gained double, ep double, epa double, score_differential int, spread_line double, "
        "total_line double, total int"
    ),
    "rosters": "season int, gsis_id string, full_name string, position string, team string, jersey_number int",
    "player_stats": (
        "player_id string, player_name string, player_display_name string, position string, "
        "recent_team string, season_type string, season int, week int, targets int, carries int, "
        "attempts int, receiving_tds int, rushing_tds int, passing_tds int, passing_epa double, "
        "rushing_epa double, receiving_epa double"
    ),
    "expected_points": (
        "season string, week int, player_id string, full_name string, position string, posteam string, "
        "pass_yards_gained_exp double, rec_yards_gained_exp double, rush_yards_gained_exp double, "
        "total_fantasy_points_exp double, total_fantasy_points_diff double"
    ),
    "boom_bust": (
        "name string, team string, position string, slate string, salary int, projection double, std_dev double"
    ),
    "main_projections": "team string, opponent string",
    "showdown_feed": "player string, pos string, team string, opp string, salary int, my_proj double",
    "grid_players": "player string, pos string, team string",
    "receiving_stats": (
        "name string, team string, opponent string, targets double, catches double, rec_yd double, "
        "rec_td double, fum_l double"
    ),
    "rushing_stats": (
        "name string, team string, opponent string, rush double, rush_yd double, rush_td double, fum_l double"
    ),
    "passing_stats": (
        "name string, team string, opponent string, attempts double, pass_yd double, touchdowns double, fum_l double"
    ),
    "dk_projections": "name string, position string, team string, opponent string, salary int",
    # Slot and draw columns beyond these are taken as they come.
    "lineup_grid": "number int",
    "grid_projections": "player string, pos string",
    "season_projections": (
        "name string, team string, pos string, week int, ecr double, projection double, projected_score double"
    ),
}


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header, names normalised to snake case.

    Columns are read as text, normalised by name, then cast: real files carry more columns than a
    schema names and in any order, and a positional schema would shift them. Columns outside the
    schema stay text; without a schema Spark infers the types. NA is how these files write a missing
    number or text.
    """
    if schema is None:
        return clean_names(spark.read.options(header=True, inferSchema=True, nullValue="NA").csv(path))
    df = clean_names(spark.read.options(header=True, nullValue="NA").csv(path))
    wanted = spark.createDataFrame([], schema).schema
    missing = [f.name for f in wanted if f.name not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks columns {missing}")
    types = {f.name: f.dataType for f in wanted}
    return df.select(*[F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns])


def read_named_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    return read_csv(spark, path, SCHEMAS[table])


def read_seasons(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Parquet of a range of seasons; with a ``season=`` layout other seasons are not opened."""
    return spark.read.parquet(path).where(F.col("season").cast("int").between(first, last))


def write_seasons(df: DataFrame, path: str) -> None:
    """Land a table in the layout ``read_seasons`` prunes by."""
    df.write.mode("errorifexists").partitionBy("season").parquet(path)
