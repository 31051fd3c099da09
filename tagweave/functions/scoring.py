"""Scalar functions on scores and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clip_unit(p, eps: float) -> Column:
    """Limit to [eps, 1 - eps]."""
    return F.least(F.greatest(_c(p).cast("double"), F.lit(float(eps))), F.lit(1.0 - eps))


def rescale_unit(p, eps: float) -> Column:
    """Affine map of [0, 1] to [eps, 1 - eps]."""
    return _c(p).cast("double") * F.lit(1.0 - 2 * eps) + F.lit(float(eps))


def binary_entropy(p) -> Column:
    """Entropy in bits of one score, clipped to [1e-5, 1 - 1e-5]."""
    q = clip_unit(p, 1e-5)
    return -(q * F.log2(q) + (F.lit(1.0) - q) * F.log2(F.lit(1.0) - q))


def shannon_entropy(scores, how: str = "max") -> Column:
    """Entropy of a row of scores: the largest class entropy or the sum over classes."""
    terms = [binary_entropy(s) for s in scores]
    if how == "max":
        return terms[0] if len(terms) == 1 else F.greatest(*terms)
    if how == "sum":
        return reduce(lambda a, b: a + b, terms)
    raise ValueError(f"how must be 'max' or 'sum', not {how!r}")


def label_smoothing(y, eps: float) -> Column:
    return _c(y) * F.lit(1.0 - eps) + F.lit(0.5 * eps)


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


def binary_crossentropy(y, p, eps: float = 1e-7) -> Column:
    """Natural-log cross-entropy of a target in [0, 1]; NULL targets give NULL."""
    q = clip_unit(p, eps)
    return -(_c(y) * F.log(q) + (F.lit(1.0) - _c(y)) * F.log(F.lit(1.0) - q))


def row_error(y, p) -> Column:
    """Error in bits used to rank wrong validation rows."""
    y, p = _c(y), _c(p)
    return -y * F.log2(p + F.lit(1e-5)) - (F.lit(1.0) - y) * F.log2(F.lit(1.0) - p + F.lit(1e-5))
