"""Wide to long, nested rows, generated keys, detail with subtotals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import columns_containing


def wide_to_long(df: DataFrame, patterns, names_to: str, values_to: str) -> DataFrame:
    """Turn the columns whose name holds a pattern into (name, value) rows; nulls stay."""
    values = columns_containing(df, patterns)
    ids = [c for c in df.columns if c not in values]
    return df.unpivot(ids, values, names_to, values_to)


def with_keys(df: DataFrame, name: str, count: int) -> DataFrame:
    """Repeat every row for keys 1..count (one row per slate, for example)."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(1), F.lit(count))))


def nest_rows(df: DataFrame, keys, columns, name: str) -> DataFrame:
    """Rows of a group as one array, for groups of a fixed size such as the members of a lineup."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))


def unnest_rows(df: DataFrame, name: str) -> DataFrame:
    others = [c for c in df.columns if c != name]
    return df.select(*others, F.inline(name))


def with_group_means(df: DataFrame, group: str, labels, means) -> DataFrame:
    """Detail rows plus one mean row per group, told apart by ``row_kind``."""
    detail = df.select(F.lit("detail").alias("row_kind"), group, *labels, *means)
    average = df.groupBy(group).agg(*[F.avg(c).alias(c) for c in means])
    return detail.unionByName(average.withColumn("row_kind", F.lit("mean")), allowMissingColumns=True)
