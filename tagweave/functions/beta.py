"""Distribution of a share with a Beta posterior, for counts of any size."""

from __future__ import annotations

import math

LARGE = 1e6        # both parameters above this: expansion in place of the continued fraction
TERMS = 1_000_000  # of the continued fraction, which needs about the square root of the parameters


def stirling_rest(z: float) -> float:
    """log Gamma(z) less (z - 1/2) log z - z + log(2 pi) / 2."""
    if z < 16:
        return math.lgamma(z) - ((z - 0.5) * math.log(z) - z + 0.5 * math.log(2 * math.pi))
    w = 1.0 / (z * z)
    return (1 / 12 - w * (1 / 360 - w * (1 / 1260 - w / 1680))) / z


def deviance(seen: float, expected: float) -> float:
    """seen * log(seen / expected) - seen + expected, without cancellation where the two are close."""
    e = (seen - expected) / expected
    if abs(e) > 0.1:
        return seen * math.log(seen / expected) + expected - seen
    total, power, k = 0.0, e * e, 2
    while True:
        term = power / (k * (k - 1))
        total += term if k % 2 == 0 else -term
        if abs(term) <= 1e-18 * abs(total) or k > 60:
            return expected * total
        power, k = power * e, k + 1


def _fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, from the front with a numerator and a denominator in step."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, TERMS):
        step = 1.0
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            step = c * d
            value *= step
        if abs(step - 1.0) < 1e-14:
            break
    return value


def beta_cdf(x: float, a: float, b: float) -> float:
    """P(share <= x) for Beta(a, b), to about ten digits.

    With n = a + b and m = a / n, the density's exponent is n times the divergence of m from x, which `deviance` gives without the
    cancellation that differences of log Gamma have. Above LARGE the error function of the signed root of that divergence is
    exact but for a term of order 1 / sqrt(n), which is added; what remains is of order n ** -1.5.
    """
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    n = a + b
    exponent = deviance(a, n * x) + deviance(b, n * (1.0 - x))
    if min(a, b) > LARGE:
        mean = a / n
        gap = (n * x - a) / n
        eta = math.copysign(math.sqrt(2.0 * exponent / n), gap)
        spread = math.sqrt(mean * (1 - mean))
        # Close to the mean the difference of the two poles is replaced by its limit.
        pole = 1.0 / eta - spread / gap if abs(eta) > 1e-5 else (1.0 - 2.0 * mean) / (3.0 * spread)
        rest = math.exp(-exponent) / math.sqrt(2.0 * math.pi * n) * pole
        return min(1.0, max(0.0, 0.5 * math.erfc(-eta * math.sqrt(n / 2.0)) + rest))
    front = math.exp(-exponent + 0.5 * math.log(a * b / (2.0 * math.pi * n)) + stirling_rest(n) - stirling_rest(a) - stirling_rest(b))
    if x < (a + 1.0) / (n + 2.0):
        return front * _fraction(a, b, x) / a
    return 1.0 - front * _fraction(b, a, 1.0 - x) / b


def beta_quantile(q: float, a: float, b: float) -> float:
    """The x with beta_cdf(x, a, b) = q."""
    mean = a / (a + b)
    reach = 12.0 * math.sqrt(mean * (1 - mean) / (a + b))
    lo, hi = max(0.0, mean - reach), min(1.0, mean + reach)
    if beta_cdf(lo, a, b) >= q or beta_cdf(hi, a, b) < q:
        lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = 0.5 * (lo + hi)
        lo, hi = (mid, hi) if beta_cdf(mid, a, b) < q else (lo, mid)
    return 0.5 * (lo + hi)
