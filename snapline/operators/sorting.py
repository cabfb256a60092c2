"""Report order: nulls last whichever way a column is sorted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def arrange(df: DataFrame, *columns: str) -> DataFrame:
    """Sort by the columns in turn; a leading minus means descending."""
    return df.orderBy(
        *[F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_last() for c in columns]
    )
