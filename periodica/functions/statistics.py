"""Tails of distributions as native expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def ln_gamma(z: Column) -> Column:
    """Logarithm of the gamma function of z > 0: Stirling's series eight above, stepped down."""
    high = z + 8
    series = (high - 0.5) * F.ln(high) - high + 0.5 * math.log(2 * math.pi) + 1 / (12 * high) - 1 / (360 * high**3) + 1 / (1260 * high**5) - 1 / (1680 * high**7)
    return series - F.ln(reduce(lambda a, b: a * b, [z + i for i in range(8)]))


def incomplete_beta(x: Column, rest: Column, a: Column, b: Column, depth: int = 400) -> Column:
    """Regularized incomplete beta function at x, with rest = 1 - x, by its continued fraction from the inside out; x and rest are above 0."""
    near = x < (a + 1) / (a + b + 2)  # where the fraction converges fast; else the other tail
    pick = lambda u, v: F.when(near, u).otherwise(v)
    given = F.struct(near.alias("near"), pick(x, rest).alias("x"), pick(rest, x).alias("rest"), pick(a, b).alias("a"), pick(b, a).alias("b"))

    def tail(s: Column) -> Column:
        x, a, b = s["x"], s["a"], s["b"]

        def inward(value: Column, i: Column) -> Column:
            m = F.floor(i / 2).cast("double")
            return 1 + F.when(i % 2 == 0, m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))).otherwise(-(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))) / value

        front = F.exp(ln_gamma(a + b) - ln_gamma(a) - ln_gamma(b) + a * F.ln(x) + b * F.ln(s["rest"])) / a
        return F.struct(s["near"].alias("near"), (front / F.aggregate(F.sequence(F.lit(depth), F.lit(1), F.lit(-1)), F.lit(1.0), inward)).alias("value"))

    values = F.transform(F.array(given), tail)  # of one element: what a lambda takes is worked out once
    return F.get(F.transform(values, lambda s: F.when(s["near"], s["value"]).otherwise(1 - s["value"])), F.lit(0))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation r of n pairs by Student's distribution with n - 2 degrees of freedom; null for a null r and below 3 pairs."""
    square = F.least(r * r, F.lit(1.0))
    inner = F.when((square > 0) & (square < 1) & (n > 2), square)
    p = incomplete_beta(1 - inner, inner, (n - 2) / 2.0, F.lit(0.5))
    return F.when((n > 2) & r.isNotNull(), F.when(square == 0, 1.0).when(square >= 1, 0.0).otherwise(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))))
