"""Top-k with ties."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .joins import salted_join

#: Cells that a group's range of values is cut into per round.
CELLS = 256


def kth_largest(df: DataFrame, k: int, by: str, within) -> DataFrame:
    """Columns ``within`` and _kth: each group's k-th largest ``by``, or its smallest where it has fewer.

    Values are counted once. Each round cuts a group's range into cells, finds the cell with the wanted value from their
    counts and goes on with its range, so no task sees more than the cells of a group; a round makes the range 256 times
    smaller. Null and NaN don't count. Jobs run when this function is called.
    """
    within = list(within)
    value = F.col(by).cast("double")
    counts = df.where(value.isNotNull() & ~F.isnan(value)).groupBy(*within, value.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    counts = cut_lineage(counts)
    found = counts.groupBy(*within).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high")).withColumn("_need", F.lit(k).cast("long"))
    while True:
        near = salted_join(counts, found, within, ["_v"], "inner").where(F.col("_v").between(F.col("_low"), F.col("_high")))
        part = F.floor((F.col("_v") / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2) * CELLS)
        cell = F.when(F.col("_high") > F.col("_low"), F.least(F.lit(CELLS - 1), part)).otherwise(0)
        cells = near.withColumn("_cell", cell).groupBy(*within, "_cell").agg(
            F.sum("_n").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.first("_need").alias("_need")
        )
        down = Window.partitionBy(*within).orderBy(F.col("_cell").desc())
        cells = cells.withColumn("_upto", F.sum("_n").over(down.rowsBetween(Window.unboundedPreceding, 0)))
        # The cell that reaches the wanted place, or the last one.
        last = F.lead("_cell").over(down).isNull()
        hit = (F.col("_upto") - F.col("_n") < F.col("_need")) & ((F.col("_upto") >= F.col("_need")) | last)
        cells = cells.withColumn("_hit", hit).where("_hit")
        found = cut_lineage(cells.select(*within, "_low", "_high", (F.col("_need") - F.col("_upto") + F.col("_n")).alias("_need")))
        if found.where("_low < _high").isEmpty():
            return found.select(*within, F.col("_low").alias("_kth"))


def top_n(df: DataFrame, k: int, by: str, within=()) -> DataFrame:
    """Rows whose ``by`` is among the k largest of the group (or of the table), ties kept.

    A null never ranks. In a whole table the k-th value is found first, from each task's own k largest,
    and the rows are then filtered by it: they stay where they are, however many are tied. In groups Spark
    cuts each task's rows to its own first k before the shuffle, up to its group-limit threshold; for a larger k
    each group's k-th value is found by counting, and the rows are filtered by that.
    """
    if not within:
        largest = df.select(by).where(F.col(by).isNotNull()).orderBy(F.col(by).desc()).limit(k)
        return df.where(F.col(by) >= largest.agg(F.min(by)).scalar())
    if k > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        others = [c for c in df.columns if c not in within]
        met = salted_join(df, kth_largest(df, k, by, within), list(within), others, "inner")
        value = F.col(by).cast("double")
        return met.where((value >= F.col("_kth")) & ~F.isnan(value)).drop("_kth")
    rank = F.rank().over(Window.partitionBy(*within).orderBy(F.col(by).desc()))
    return df.where(F.col(by).isNotNull()).withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def first_rows(df: DataFrame, k: int, order, within) -> DataFrame:
    """The first k rows of each group in a total order."""
    number = F.row_number().over(Window.partitionBy(*within).orderBy(*order))
    return df.withColumn("_number", number).where(F.col("_number") <= k).drop("_number")


def last_rows(df: DataFrame, by: str, within) -> DataFrame:
    """The rows of each group that hold its largest ``by``, ties kept."""
    return top_n(df, 1, by, within)
