"""Missing-value semantics of the source analyses, as Spark columns.

Aggregates here answer null when any input is null, unless they say otherwise;
Spark's own aggregates skip nulls and are used directly where skipping is wanted.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def na_sum(x: Column | str) -> Column:
    """Sum that is null when any value is null; 0 over no rows."""
    x = as_col(x)
    return F.when(F.count(F.lit(1)) == F.count(x), F.coalesce(F.sum(x), F.lit(0)))


def na_mean(x: Column | str) -> Column:
    x = as_col(x)
    return F.when(F.count(F.lit(1)) == F.count(x), F.avg(x))


def na_sum_positive(x: Column | str) -> Column:
    """Sum of the values above zero: 0 when there are none, null when any value is null."""
    x = as_col(x)
    total = F.coalesce(F.sum(F.when(x > 0, x)), F.lit(0.0))
    return F.when(F.count(F.lit(1)) == F.count(x), total)


def n_distinct_na(x: Column | str) -> Column:
    """Distinct count in which null is one value."""
    x = as_col(x)
    return F.count_distinct(x) + F.coalesce(F.max(F.when(x.isNull(), 1).otherwise(0)), F.lit(0))


def na_corr(x: Column | str, y: Column | str) -> Column:
    """Correlation, null when either column has a null."""
    x, y = as_col(x), as_col(y)
    whole = (F.count(F.lit(1)) == F.count(x)) & (F.count(F.lit(1)) == F.count(y))
    return F.when(whole, F.corr(x, y))


def safe_ratio(num: Column | str, den: Column | str) -> Column:
    """num / den, null where den is zero (no ANSI error, no infinity)."""
    return F.try_divide(as_col(num).cast("double"), as_col(den).cast("double"))


def floor_at(x: Column | str, low: float) -> Column:
    """Raise x to at least ``low``; a null stays null."""
    x = as_col(x)
    return F.when(x.isNotNull(), F.greatest(F.lit(float(low)), x))


def cap_at(x: Column | str, high: float) -> Column:
    x = as_col(x)
    return F.when(x.isNotNull(), F.least(F.lit(float(high)), x))


def if_else(cond: Column, yes, no) -> Column:
    """Two-way conditional that is null where the condition is null."""
    yes = yes if isinstance(yes, Column) else F.lit(yes)
    no = no if isinstance(no, Column) else F.lit(no)
    return F.when(cond, yes).when(~cond, no)


def is_in(x: Column | str, values) -> Column:
    """Membership test that is false, never null, for a null."""
    return F.coalesce(as_col(x).isin(list(values)), F.lit(False))


def not_in(x: Column | str, values) -> Column:
    return ~is_in(x, values)


def present(x: Column | str) -> Column:
    """Neither null nor the empty string."""
    x = as_col(x)
    return x.isNotNull() & (x != "")


def rounded(x: Column | str, digits: int = 6) -> Column:
    """Round, with minus zero folded into zero."""
    return F.round(as_col(x).cast("double"), digits) + F.lit(0.0)


def half_even(x: Column | str, digits: int = 0) -> Column:
    return F.bround(as_col(x).cast("double"), digits) + F.lit(0.0)


def fill_numeric(df, value=0, subset=None):
    """Replace null by ``value`` in every numeric column, or in the named ones."""
    numeric = {"int", "bigint", "double", "float", "smallint", "tinyint"}
    names = [c for c, t in df.dtypes if t in numeric or t.startswith("decimal")]
    if subset is not None:
        names = [c for c in names if c in set(subset)]
    return df.fillna(value, subset=names) if names else df


def round_numeric(df, digits: int = 0, skip=()):
    """Half-even rounding of every floating column (integers are left alone)."""
    return df.select(
        *[
            half_even(c, digits).alias(c) if t in ("double", "float") and c not in skip else F.col(c)
            for c, t in df.dtypes
        ]
    )


def percent_text(x: Column | str, digits: int = 1) -> Column:
    """'12.3%'; a blank for a null."""
    x = as_col(x)
    return F.when(x.isNull(), "").otherwise(F.format_string(f"%.{digits}f%%", rounded(x * 100, digits)))


def number_text(x: Column | str, digits: int = 1) -> Column:
    x = as_col(x)
    return F.when(x.isNull(), "").otherwise(F.format_string(f"%.{digits}f", rounded(x, digits)))
