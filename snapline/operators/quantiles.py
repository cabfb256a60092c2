"""Exact interpolated quantiles and density curves per group, by counting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import natural_join, salted_join


def grouped_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], cell: float, weight: str | None = None
) -> DataFrame:
    """One row per group: the count ``n`` and the linearly interpolated quantiles of ``value``.

    Equal to an exact percentile, but no task ever holds the values of a whole group. Values are
    counted per cell of width ``cell``; the running cell counts tell which cells hold the wanted order
    statistics, and only the values of those cells are ranked. Choose ``cell`` so that a group has some
    hundreds of cells: both the cells of a group and the distinct values of a cell are sorted in one task.
    A row stands for as many values as its ``weight`` says, for one where none is named.
    """
    keys = list(keys)
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_n"))
        .withColumn("_cell", F.floor(F.col("_v") / F.lit(float(cell))))
    )
    by_cell = Window.partitionBy(*keys).orderBy("_cell")
    cells = (
        counts.groupBy(*keys, "_cell").agg(F.sum("_n").alias("_cell_n"))
        .withColumn("_upto", F.sum("_cell_n").over(by_cell.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("n", F.sum("_cell_n").over(Window.partitionBy(*keys)))
        .withColumn("_before", F.col("_upto") - F.col("_cell_n"))
    )

    def spot(p: float) -> Column:
        return (F.col("n") - 1) * F.lit(float(p))

    wanted = F.lit(False)
    for p in probs.values():
        for at in (F.floor(spot(p)), F.ceil(spot(p))):
            wanted = wanted | ((F.col("_before") <= at) & (at < F.col("_upto")))
    near = cells.where(wanted).select(*keys, "_cell", "_before", "n")
    inside = Window.partitionBy(*keys, "_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = natural_join(counts, near, "inner", [*keys, "_cell"]).withColumn(
        "_hi", F.col("_before") + F.sum("_n").over(inside)
    ).withColumn("_lo", F.col("_hi") - F.col("_n"))

    def order_stat(at: Column) -> Column:
        return F.max(F.when((F.col("_lo") <= at) & (at < F.col("_hi")), F.col("_v")))

    aggs = [F.max("n").alias("n")]
    for name, p in probs.items():
        aggs += [order_stat(F.floor(spot(p))).alias(f"_a_{name}"), order_stat(F.ceil(spot(p))).alias(f"_b_{name}")]
    found = ranked.groupBy(*keys).agg(*aggs)
    return found.select(
        *keys, "n",
        *[
            (
                F.col(f"_a_{name}")
                + (F.col(f"_b_{name}") - F.col(f"_a_{name}")) * (spot(p) - F.floor(spot(p)))
            ).alias(name)
            for name, p in probs.items()
        ],
    )


def density_curve(
    df: DataFrame, keys: Sequence[str], value: str, cell: float, bins: int = 256, points: int = 64
) -> DataFrame:
    """Gaussian kernel density of ``value`` per group on an even grid from its minimum to its maximum.

    Bandwidth is 0.9 * min(sd, iqr / 1.34) * n^(-1/5). Values are counted in ``bins`` even bins per
    group first, so the kernel sum runs over at most bins x points rows per group, whatever the data size.
    A value moves by half a bin at most: with d the bin's width over the bandwidth, the curve is off by at
    most 0.25 * d / bandwidth, and by about d^2 / 24 times its curvature in general.
    """
    keys = list(keys)
    df = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    # Each value of a group once; the quantiles and the bins are read from these counts.
    counts = df.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_w"))
    iqr = grouped_quantiles(counts, keys, "_v", {"_q1": 0.25, "_q3": 0.75}, cell, "_w").drop("n")
    stats = natural_join(
        df.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"), F.stddev_samp("_v").alias("_sd"),
            F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        ),
        iqr, "left", keys,
    )
    narrow = F.least(F.col("_sd"), (F.col("_q3") - F.col("_q1")) / 1.34)
    narrow = F.when(narrow > 0, narrow).when(F.col("_sd") > 0, F.col("_sd")).otherwise(F.lit(1.0))
    stats = stats.withColumn("bandwidth", F.lit(0.9) * narrow * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    stats = stats.withColumn("_step", (F.col("_max") - F.col("_min")) / F.lit(float(bins)))
    span = stats.select(*keys, "_min", "_step")
    bin_no = F.when(
        F.col("_step") > 0,
        F.least(F.floor((F.col("_v") - F.col("_min")) / F.col("_step")), F.lit(bins - 1)),
    ).otherwise(F.lit(0))
    binned = (
        salted_join(counts, span, keys, ["_v"]).withColumn("_bin", bin_no)
        .groupBy(*keys, "_bin").agg(F.sum("_w").alias("_c"))
    )
    center = F.col("_min") + (F.col("_bin") + 0.5) * F.col("_step")
    grid = (
        natural_join(binned, stats, "inner", keys)
        .withColumn("_mid", center)
        .withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .withColumn("x", F.col("_min") + (F.col("_max") - F.col("_min")) * F.col("point") / F.lit(float(points - 1)))
    )
    z = (F.col("x") - F.col("_mid")) / F.col("bandwidth")
    weight = F.col("_c") * F.exp(F.lit(-0.5) * z * z)
    scale = F.max("n") * F.max("bandwidth") * F.lit(2.5066282746310002)
    return grid.groupBy(*keys, "point").agg(
        F.max("x").alias("x"), (F.sum(weight) / scale).alias("density"), F.max("n").alias("n"),
    )
