"""Column functions for exact tests: log-factorial, binomial / hypergeometric
log-probabilities and the chi-square upper tail (closed forms for even and
odd degrees of freedom).  Log-factorials of large numbers are differences of large logarithms:
above about 1e8 their error passes 1e-7."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusgauge.functions.text import _c

_EXACT_UPTO = 32
# ln(n!) for n < 32, computed here with math.lgamma (not copied values).
_LOG_FACT = [math.lgamma(n + 1) for n in range(_EXACT_UPTO)]


def log_factorial(col) -> Column:
    """ln(n!) -- exact table below 32, Stirling series (error < 1e-15) above."""
    n = _c(col).cast("double")
    table = F.array(*[F.lit(v) for v in _LOG_FACT])
    stirling = (n * F.log(n) - n + 0.5 * F.log(F.lit(2 * math.pi) * n)
                + 1 / (12 * n) - 1 / (360 * F.pow(n, 3)) + 1 / (1260 * F.pow(n, 5))
                - 1 / (1680 * F.pow(n, 7)))
    return F.when(n < _EXACT_UPTO, F.element_at(table, n.cast("int") + 1)).otherwise(stirling)


def log_choose(n, k) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(_c(n) - _c(k))


def log_erfc(z: float) -> float:
    """ln erfc(z) for z >= 0; the continued fraction where erfc itself is too small."""
    if z < 20:
        return math.log(math.erfc(z))
    f = z
    for k in range(60, 0, -1):
        f = z + k / 2 / f
    return -z * z - math.log(f * math.sqrt(math.pi))


def chi2_log_sf(x: float, dof: int) -> float:
    """ln P(X >= x) for a chi-square: the closed forms for even and odd ``dof``, summed in
    logarithms so that strong effects keep their order of magnitude.

    even: exp(-h) sum_{i<dof/2} h^i / i! with h = x/2;
    odd: erfc(sqrt(h)) + exp(-h) sum_{1<=j<=(dof-1)/2} h^(j-1/2) / Gamma(j + 1/2)."""
    if x <= 0:
        return 0.0
    h = x / 2
    if dof % 2 == 0:
        logs = [i * math.log(h) - math.lgamma(i + 1) - h for i in range(dof // 2)]
    else:
        logs = [log_erfc(math.sqrt(h))] + [(j - 0.5) * math.log(h) - math.lgamma(j + 0.5) - h
                                           for j in range(1, (dof - 1) // 2 + 1)]
    top = max(logs)
    return min(0.0, top + math.log(math.fsum(math.exp(v - top) for v in logs)))


def chi2_sf_even(x, dof) -> Column:
    """P(X >= x) for a chi-square with even ``dof``: exp(-x/2) * sum_{i<dof/2} (x/2)^i / i!."""
    h = _c(x) / 2
    m = (_c(dof) / 2).cast("int")
    terms = F.aggregate(
        F.sequence(F.lit(1), F.greatest(m - 1, F.lit(1))),
        F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
        lambda acc, i: F.struct((acc["t"] * h / i).alias("t"), (acc["s"] + acc["t"] * h / i).alias("s")))
    total = F.when(m <= 1, F.lit(1.0)).otherwise(terms["s"])
    return F.exp(-h) * total


def chi2_sf_odd(x: float, dof: int) -> float:
    """P(X >= x) for a chi-square with odd ``dof`` (a scalar, once per test):
    erfc(sqrt(x/2)) + sqrt(2x/pi) exp(-x/2) sum_{j<(dof+1)/2} x^(j-1) / (1*3*...*(2j-1))."""
    if x is None or x != x:
        return float("nan")
    if x <= 0:
        return 1.0
    p = math.erfc(math.sqrt(x / 2))
    term = math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for j in range(1, (dof - 1) // 2 + 1):
        p += term
        term *= x / (2 * j + 1)
    return min(1.0, p)
