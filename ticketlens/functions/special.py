"""Special functions as column expressions.

The sums and fractions run over a literal ``sequence`` inside one expression, so
they stay in the JVM and need no Python worker.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of Lanczos' approximation (g = 7, nine terms): fixed values.
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
            12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0, to about 1e-13 (Lanczos)."""
    z = x - 1.0
    a = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        a = a + F.lit(c) / (z + float(i))
    t = z + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (z + 0.5) * F.log(t) - t + F.log(a)


def gamma_tail(a: Column, x: Column, terms: int = 400) -> Column:
    """The regularised upper incomplete gamma function Q(a, x), a > 0, x >= 0: the
    series of P = 1 - Q below x = a + 1, the continued fraction (in Lentz's form) above."""
    steps = F.sequence(F.lit(1), F.lit(terms))
    front = F.exp(-x + a * F.log(x) - log_gamma(a))
    series = F.aggregate(
        steps, F.struct((F.lit(1.0) / a).alias("term"), (F.lit(1.0) / a).alias("sum")),
        lambda s, n: F.struct((s["term"] * x / (a + n)).alias("term"), (s["sum"] + s["term"] * x / (a + n)).alias("sum")),
        lambda s: s["sum"])
    tiny = F.lit(1e-300)

    def step(s, n):
        an = -n * (n - a)
        b = x + 1.0 - a + n * 2.0
        d = _away(an * s["d"] + b, tiny)
        c = _away(b + an / s["c"], tiny)
        d = F.lit(1.0) / d
        return F.struct(d.alias("d"), c.alias("c"), (s["h"] * d * c).alias("h"))

    b0 = x + 1.0 - a
    first = F.lit(1.0) / _away(b0, tiny)
    fraction = F.aggregate(F.transform(steps, lambda n: n.cast("double")),
                           F.struct(first.alias("d"), F.lit(1e300).alias("c"), first.alias("h")), step, lambda s: s["h"])
    q = F.when(x <= 0, F.lit(1.0)).when(x < a + 1.0, F.lit(1.0) - front * series).otherwise(front * fraction)
    return F.least(F.greatest(q, F.lit(0.0)), F.lit(1.0))


def _away(x: Column, tiny: Column) -> Column:
    return F.when(F.abs(x) < tiny, tiny).otherwise(x)


def chi2_tail(stat: Column, dof: Column) -> Column:
    """P(chi-square with ``dof`` degrees of freedom >= stat); 1 without a degree of
    freedom, null beyond 1,000 of them (the sums are too short)."""
    return F.when(dof <= 0, F.lit(1.0)).when(dof <= 1000, gamma_tail(F.greatest(dof, F.lit(1.0)) / 2.0, stat / 2.0))
