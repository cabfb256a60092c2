"""Reproducible normal draws.

A draw is a function of its key columns alone (seed, slate, player, ...), so it does not change
with partitioning, with a retried task or with a recomputed stage.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .na import as_col


def uniform(seed: int, keys, salt: str) -> Column:
    """Uniform on (0, 1) from the first 52 bits of the md5 of the keys."""
    text = F.concat_ws("|", F.lit(str(seed)), *[as_col(k).cast("string") for k in keys], F.lit(salt))
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(2**52))


def std_normal(seed: int, keys) -> Column:
    """Box-Muller transform of two uniforms."""
    radius = F.sqrt(F.lit(-2.0) * F.ln(uniform(seed, keys, "u1")))
    return radius * F.cos(F.lit(6.283185307179586) * uniform(seed, keys, "u2"))


def normal(seed: int, keys, mean: Column | str, sd: Column | str) -> Column:
    return as_col(mean) + as_col(sd) * std_normal(seed, keys)
