from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.na import rounded


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round floating columns: sums differ in the last bits between engines."""
    return df.select(
        *[rounded(f"`{c}`", digits).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes]
    )


def r6(*names: str) -> str:
    """SQL select list that rounds the named columns."""
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)
