"""Row numbers, running totals and rolling means that do not put a whole group into one task.

A plain ordered window sorts every group inside one task, so one key with a third of the rows decides
the run time. Here the caller names ``chunk`` columns: coarse, order-preserving functions of the sort
order (a season, a week, a block of play ids). The counts or sums per chunk are small and are
accumulated first; the detail is then sorted per (group, chunk) only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .joins import natural_join, salted_join

ID_BLOCK = 1 << 20
ROLL_BLOCK = 1 << 16


def desc_last(*names: str) -> list[Column]:
    return [F.col(n).desc_nulls_last() for n in names]


def asc_last(*names: str) -> list[Column]:
    return [F.col(n).asc_nulls_last() for n in names]


def _plain(df: DataFrame, names: Sequence[str]) -> dict[str, Column]:
    """Columns without nulls that stand for ``names``: equal where those are equal or both missing.

    Windows and joins over these partition alike, so detail sorted for the one is in place for the other.
    """
    kinds, out = dict(df.dtypes), {}
    for i, name in enumerate(dict.fromkeys(names)):
        number = kinds[name] in ("tinyint", "smallint", "int", "bigint", "float", "double")
        value = F.col(name) if number else F.col(name).cast("string")
        out[f"_p{i}"] = F.coalesce(value, F.lit(0).cast(kinds[name]) if number else F.lit(""))
        out[f"_q{i}"] = F.col(name).isNull()
    return out


def _offsets(df: DataFrame, plain, keys, chunk, chunk_order, measure: Column) -> DataFrame:
    """Total of ``measure`` over the chunks that come before each chunk of the group."""
    before = Window.partitionBy(*keys).orderBy(*chunk_order).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*plain, *dict.fromkeys([*keys, *chunk])).agg(measure.alias("_total"))
    return totals.select(*plain, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))


def positions(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], chunk: Sequence[str],
    chunk_order: Sequence[Column], name: str,
) -> DataFrame:
    """Row number within each group in the given total order."""
    plain = _plain(df, [*keys, *chunk])
    rows = df.withColumns(plain)
    inside = F.row_number().over(Window.partitionBy(*plain).orderBy(*order))
    offsets = _offsets(rows, plain, keys, chunk, chunk_order, F.count(F.lit(1)))
    numbered = rows.withColumn("_inside", inside).join(offsets, list(plain), "left")
    number = (F.col("_inside") + F.col("_offset")).cast("bigint")
    return numbered.select(*[F.col(f"`{c}`") for c in df.columns if c != name], number.alias(name))


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], chunk: Sequence[str],
    chunk_order: Sequence[Column], value: str, name: str,
) -> DataFrame:
    """Cumulative sum of ``value`` within each group in the given total order."""
    plain = _plain(df, [*keys, *chunk])
    rows = df.withColumns(plain)
    upto = Window.partitionBy(*plain).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    offsets = _offsets(rows, plain, keys, chunk, chunk_order, F.sum(value))
    summed = rows.withColumn("_inside", F.sum(value).over(upto)).join(offsets, list(plain), "left")
    total = F.col("_inside") + F.col("_offset")
    return summed.select(*[F.col(f"`{c}`") for c in df.columns if c != name], total.alias(name))


def centered_frame(width: int) -> tuple[int, int]:
    """Row offsets of a centred window; an even one leans one row towards the later rows."""
    before = (width - 1) // 2
    return -before, width - 1 - before


def rolling_mean(
    df: DataFrame, keys: Sequence[str], value: str, widths: dict[str, int], position: str,
    block: int = ROLL_BLOCK,
) -> DataFrame:
    """Centred rolling means over rows numbered 1, 2, ... by ``position`` within each group.

    The frame shrinks at the ends of the group and skips nulls. The group is cut into blocks of
    ``block`` rows, and each block also gets the few rows beyond its edges that its frames reach.
    """
    halo = max(max(-lo, hi) for lo, hi in map(centered_frame, widths.values()))
    if halo >= block:
        raise ValueError("block must be longer than the widest frame")
    own = F.floor((F.col(position) - 1) / block)
    spot = F.pmod(F.col(position) - 1, F.lit(block))
    homes = F.array_compact(
        F.array(own, F.when((spot < halo) & (own > 0), own - 1), F.when(spot >= block - halo, own + 1))
    )
    spread = df.withColumn("_own", own).withColumn("_block", F.explode(homes))
    line = Window.partitionBy(*keys, "_block").orderBy(position)
    rolled = spread.select(
        "*", *[F.avg(value).over(line.rowsBetween(*centered_frame(w))).alias(n) for n, w in widths.items()]
    )
    return rolled.where(F.col("_block") == F.col("_own")).drop("_block", "_own")


def sorted_positions(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Row number within each group, whatever the values look like: one sort of the whole table over all tasks.

    Spark samples the splitters that deal the sorted rows to tasks. A row's place in its task is counted there, and how
    many rows of its group the tasks before hold comes from a small table of counts, a row per task and group. The sorted
    rows are checkpointed, as they are read twice and must not be dealt anew; that job runs at once.
    """
    keys = list(keys)
    ids = df.orderBy(*asc_last(*keys), *order).withColumn("_id", F.monotonically_increasing_id())
    # Such an id is the task's number above 33 bits and the row's place in the task below.
    rows = cut_lineage(ids.withColumn("_task", F.shiftright("_id", 33)))
    held = rows.groupBy(*keys, "_task").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    line = F.sort_array(F.collect_list(F.struct("_task", "_first", "_n")))
    before = F.transform(
        "_line",
        lambda x: F.struct(
            x["_task"].alias("_task"),
            (F.aggregate(F.filter("_line", lambda y: y["_task"] < x["_task"]), F.lit(0).cast("bigint"), lambda a, y: a + y["_n"])
             - x["_first"] + 1).alias("_offset"),
        ),
    )
    offsets = held.groupBy(*keys).agg(line.alias("_line")) if keys else held.agg(line.alias("_line"))
    offsets = offsets.select(*keys, F.inline(before))
    numbered = natural_join(rows, offsets, "left", [*keys, "_task"])
    return numbered.withColumn(name, F.col("_id") + F.col("_offset")).drop("_id", "_task", "_offset")


def name_codes(df: DataFrame, column: str, name: str) -> DataFrame:
    """Rank of each distinct text among all of them, in binary order, joined back to the rows."""
    distinct = df.select(column).where(F.col(column).isNotNull()).distinct()
    codes = sorted_positions(distinct, [], [F.col(column).asc()], name)
    return salted_join(df, codes.select(column, name), [column], df.columns)


def best_first(
    df: DataFrame, keys: Sequence[str], score: str, ties: Sequence[str], name: str, lead: Sequence[str] = (),
    steps: int = 8, prefix: int = 8,
) -> DataFrame:
    """Number the rows of a group by ``lead`` ascending, then score descending (null last), then ``ties``.

    Chunks are steps of 1/``steps`` of the score. Rows without a score, and rows exactly at the lower edge
    of their step (such as scores raised to a floor), may be very many; they only differ by the ties, so a
    prefix of the first tie column splits them further.
    """
    scaled = F.col(score) * steps
    edge = F.coalesce(scaled == F.floor(scaled), F.lit(True))
    cut = df.withColumns(
        {"_step": F.floor(scaled), "_edge": edge.cast("int"), "_head": F.when(edge, F.substring(F.col(ties[0]), 1, prefix))}
    )
    return positions(
        cut, list(keys), [*asc_last(*lead), *desc_last(score), *asc_last(*ties)], [*lead, "_step", "_edge", "_head"],
        [*asc_last(*lead), *desc_last("_step"), *asc_last("_edge", "_head")], name,
    ).drop("_step", "_edge", "_head")
