"""Connected components of a table of links, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(links: DataFrame, small: bool, name: str) -> DataFrame:
    """One round over links (a, b), a > b: every node hands its lowest neighbour on to its neighbours.

    Large: to the higher ones; small: to the lower ones. The lowest neighbours are summed up before they are shuffled
    and written, so that a node with very many links meets them in a join that Spark can split.
    """
    if small:
        lowest = links.groupBy("a").agg(F.min("b").alias("low"))
        sides = links
    else:
        sides = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
        both = links.unionByName(sides)
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    lowest = written(lowest, f"{name}-lowest")
    met = sides.join(lowest, "a")
    out = met.select(F.col("b").alias("a"), F.col("low").alias("b"))
    if small:
        out = out.unionByName(lowest.select("a", F.col("low").alias("b")))
    return written(out.where("a != b").distinct(), name)


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """Columns node and root for every node of ``links`` (a, b): root is the lowest node that it reaches.

    Every round is written to the shared folder. The rounds grow with the logarithm of the longest chain.
    """
    links = links.where("a is not null and b is not null and a != b")
    links = written(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components"
    )
    before = _mark(links)
    while before[0]:
        large = _star(links, False, "components-large")
        links = _star(large, True, "components-small")
        after = _mark(links)
        if after == before:
            break
        before = after
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
