"""Reproducible uniform and normal draws: a pure function of seed and key, equal in any SQL engine with md5."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(key) -> Column:
    return F.col(key) if isinstance(key, str) else key


def hash_uniform(seed, *keys, digits: int = 13) -> Column:
    """Uniform in [0, 1) from the first `digits` hex digits of md5('seed:key[:key…]').

    13 digits fill a double. A 32-bit draw would repeat values, and leave rows out of reach, in tables of billions of rows.
    """
    parts = [F.lit(str(seed))] + [_col(k).cast("string") for k in keys]
    digest = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("double") / F.lit(16.0 ** digits)


def positive_uniform(seed, *keys) -> Column:
    """As hash_uniform but never 0, for logarithms."""
    return F.greatest(hash_uniform(seed, *keys), F.lit(1e-16))


def hash_normal(seed, *keys) -> Column:
    """Standard normal by Box and Muller on two hash uniforms."""
    radius = F.sqrt(F.lit(-2.0) * F.log(positive_uniform(f"{seed}:a", *keys)))
    return radius * F.cos(F.lit(2 * math.pi) * hash_uniform(f"{seed}:b", *keys))


def race_key(seed, weight: Column, *keys) -> Column:
    """Exponential race time: the m smallest keys are a weighted draw without replacement.

    Rows with weight 0 get NULL and must be dropped.
    """
    return F.when(weight > 0, -F.log(positive_uniform(seed, *keys)) / weight)
