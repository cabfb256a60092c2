"""Joins whose keys are the common columns, with null keys that match each other."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Rows up to which a counted table is broadcast.
FEW_ROWS = 100_000


def common_columns(left: DataFrame, right: DataFrame) -> list[str]:
    there = set(right.columns)
    return [c for c in left.columns if c in there]


def _null_safe(left_alias: str, right_alias: str, keys) -> Column:
    return reduce(and_, [F.col(f"{left_alias}.{k}").eqNullSafe(F.col(f"{right_alias}.{k}")) for k in keys])


def natural_join(
    left: DataFrame, right: DataFrame, how: str = "left", keys=None, suffixes=(".x", ".y"), grows: bool = False
) -> DataFrame:
    """Join on the common columns, or on the pinned ``keys``.

    Null keys match null keys. Keys come out once (first non-null side for right and full joins);
    other columns present on both sides get the two suffixes. Spark still plans an equi-join.
    ``grows`` says that the right side grows with the input: it is sorted and merged. Spark guesses a table's size from its
    compressed files, and would send millions of rows through the driver where these are small.
    """
    right = right.hint("merge") if grows else right
    keys = common_columns(left, right) if keys is None else list(keys)
    if not keys:
        raise ValueError("no common columns to join on")
    clash = {c for c in common_columns(left, right) if c not in keys}

    def key(k: str) -> Column:
        if how in ("right", "right_outer"):
            return F.col(f"r.{k}").alias(k)
        if how in ("full", "full_outer", "outer"):
            return F.coalesce(F.col(f"l.{k}"), F.col(f"r.{k}")).alias(k)
        return F.col(f"l.{k}").alias(k)

    out = []
    for c in left.columns:
        out.append(key(c) if c in keys else F.col(f"l.`{c}`").alias(c + suffixes[0] if c in clash else c))
    for c in right.columns:
        if c not in keys:
            out.append(F.col(f"r.`{c}`").alias(c + suffixes[1] if c in clash else c))
    return left.alias("l").join(right.alias("r"), _null_safe("l", "r", keys), how).select(*out)


def salted_join(
    big: DataFrame, small: DataFrame, keys, spread, how: str = "left", salts: int = 16, grows: bool = False
) -> DataFrame:
    """Null-safe join of a detail table to a per-key table when a few keys hold most of the detail.

    Every detail row goes to one of ``salts`` shares of its key, by a hash of the ``spread`` columns;
    the per-key table is repeated once per share. A key with a third of all rows thus spreads over
    ``salts`` tasks, and no row is lost. When the per-key table turns out small, Spark replaces the
    shuffle by a broadcast from its measured size; not so where it ``grows`` with the input (see ``natural_join``).
    """
    if how not in ("left", "inner"):
        raise ValueError("only left and inner joins keep the detail side whole")
    share = F.pmod(F.xxhash64(*[F.col(c) for c in spread]), F.lit(salts)).cast("int")
    shares = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    return natural_join(
        big.withColumn("_share", share), small.withColumn("_share", shares), how, [*keys, "_share"], grows=grows
    ).drop("_share")


def counted(df: DataFrame) -> tuple[DataFrame, bool]:
    """The table, checkpointed and marked for broadcast where it has few rows, and whether it has. Its job runs at once."""
    df = cut_lineage(df)
    few = df.limit(FEW_ROWS + 1).count() <= FEW_ROWS
    return (F.broadcast(df) if few else df), few


def detail_join(detail: DataFrame, small: DataFrame, keys, spread, how: str = "left") -> DataFrame:
    """Null-safe join of a detail table to a per-key table that is made and counted first.

    With few rows it is broadcast, so the detail is neither moved nor sorted; with more the join is salted.
    """
    small, few = counted(small)
    return natural_join(detail, small, how, keys) if few else salted_join(detail, small, keys, spread, how)


def heavy_keys(detail: DataFrame, keys, support: float = 1 / 32) -> list[tuple]:
    """Keys that may hold more than ``support`` of the rows; at most 1 / ``support`` come to the driver.

    One pass over the key columns with a bounded sketch of counts. No key above the threshold is missed, some below it
    may be named; all named ones occur. The pass runs when this function is called.
    """
    found = detail.select(F.struct(*keys).alias("_key")).stat.freqItems(["_key"], support).first()[0]
    return [tuple(k) for k in found]


def left_join_detail(left: DataFrame, detail: DataFrame, keys, salts: int = 16) -> DataFrame:
    """Null-safe left join to a detail table with many rows per key, every match kept.

    Only keys that hold a large part of the detail are split: their detail rows are dealt to ``salts`` shares and the
    rows of ``left`` with such a key are repeated once per share. These keys do occur in the detail, so their rows of
    ``left`` that find nothing in a share are dropped; all other keys are joined plainly, in the same join, so each
    input is planned once.
    """
    keys = list(keys)
    heavy = heavy_keys(detail, keys)
    if not heavy:
        return natural_join(left, detail, "left", keys)

    def is_heavy() -> Column:
        return reduce(or_, [reduce(and_, [F.col(k).eqNullSafe(F.lit(v)) for k, v in zip(keys, key, strict=True)]) for key in heavy])

    others = [c for c in detail.columns if c not in keys]
    share = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in others]), F.lit(salts)).cast("int")
    shares = F.when(is_heavy(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    dealt = detail.withColumns({"_share": F.when(is_heavy(), share).otherwise(0), "_found": F.lit(True)})
    joined = natural_join(left.withColumn("_share", F.explode(shares)), dealt, "left", [*keys, "_share"])
    return joined.where(F.col("_found").isNotNull() | ~is_heavy()).drop("_share", "_found")
