"""Normal and chi-squared tails as JVM-side series, for use on small final rows."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .distance import bind

# fixed values: coefficients of the published rational approximation of the normal quantile
A = [-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2, 1.383577518672690e2, -3.066479806614716e1, 2.506628277459239e0]
B = [-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2, 6.680131188771972e1, -1.328068155288572e1]
C = [-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838e0, -2.549732539343734e0, 4.374664141464968e0, 2.938163982698783e0]
D = [7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996e0, 3.754408661907416e0]
TAIL = 0.02425


def _poly(x: Column, coefficients: list[float]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_quantile(p: Column) -> Column:
    def tail(prob):
        r = F.sqrt(F.log(prob) * -2.0)
        return bind(r, lambda q: _poly(q, C) / _poly(q, [*D, 1.0]))

    mid = bind(p - 0.5, lambda q: _poly(q * q, A) * q / _poly(q * q, [*B, 1.0]))
    return (
        F.when(p <= 0, F.lit(-8.0)).when(p >= 1, F.lit(8.0))
        .when(p < TAIL, tail(p)).when(p <= 1.0 - TAIL, mid).otherwise(-tail(F.lit(1.0) - p))
    )


def normal_cdf(x: Column, terms: int = 200) -> Column:
    """0.5 + density(x) * sum of x^(2n+1) / (1 * 3 * ... * (2n+1)); saturates beyond 8."""
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.struct(x.cast("double").alias("t"), x.cast("double").alias("s")),
        lambda acc, n: bind(
            acc["t"] * x * x / (n * 2 + 1), lambda t: F.struct(t.alias("t"), (acc["s"] + t).alias("s"))
        ),
        lambda acc: acc["s"],
    )
    density = F.exp(-(x * x) / 2.0) / 2.5066282746310002
    return F.when(x <= -8, F.lit(0.0)).when(x >= 8, F.lit(1.0)).otherwise(F.lit(0.5) + density * series)


def _upper_normal(x: Column, levels: int = 120) -> Column:
    """P(|Z| > x) of a normal Z for x >= 0: one minus the series up to 2, a continued fraction beyond."""
    fraction = F.aggregate(
        F.sequence(F.lit(levels), F.lit(1), F.lit(-1)), x.cast("double"), lambda acc, n: x + n.cast("double") / acc
    )
    far = F.exp(-(x * x) / 2.0) * 0.7978845608028654 / fraction
    return F.when(x < 2.0, (F.lit(1.0) - normal_cdf(F.least(x, F.lit(2.0)))) * 2.0).otherwise(far)


def chi2_tail(x: Column, df: Column) -> Column:
    """Upper tail of the chi-squared distribution for a whole df.

    A finite sum of positive terms z^j / gamma(j + 1) e^-z, z = x / 2, over the whole j < df / 2
    for an even df and the half ones for an odd df, which also has the normal tail. Terms are
    carried as logarithms, so none overflows and nothing cancels.
    """

    def tail(z: Column) -> Column:
        odd = (df % 2) == 1
        first = F.when(odd, F.log(z) * 0.5 + 0.12078223763524522).otherwise(F.lit(0.0)) - z
        count = F.when(odd, F.floor((df - 1) / 2.0)).otherwise(F.floor(df / 2.0)).cast("int")
        shift = F.when(odd, F.lit(0.5)).otherwise(F.lit(0.0))
        steps = F.when(count > 1, F.sequence(F.lit(1), F.greatest(count - 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        total = F.aggregate(
            steps,
            F.struct(first.alias("t"), F.when(count > 0, F.exp(first)).otherwise(F.lit(0.0)).alias("s")),
            lambda acc, j: bind(acc["t"] + F.log(z) - F.log(j + shift), lambda t: F.struct(t.alias("t"), (acc["s"] + F.exp(t)).alias("s"))),
            lambda acc: acc["s"],
        )
        return F.least(F.lit(1.0), total + F.when(odd, _upper_normal(F.sqrt(z * 2.0))).otherwise(F.lit(0.0)))

    return F.when(x <= 0, F.lit(1.0)).when(df <= 0, F.lit(0.0)).otherwise(bind(F.greatest(x.cast("double"), F.lit(1e-300)) / 2.0, tail))


def normal_quantile_number(p: float) -> float:
    """The same approximation for one number, for use inside a kernel."""

    def poly(x, cs):
        out = cs[0]
        for c in cs[1:]:
            out = out * x + c
        return out

    if p <= 0 or p >= 1:
        return -8.0 if p <= 0 else 8.0
    if TAIL <= p <= 1.0 - TAIL:
        q = p - 0.5
        return poly(q * q, A) * q / poly(q * q, [*B, 1.0])
    q = math.sqrt(-2.0 * math.log(min(p, 1.0 - p)))
    x = poly(q, C) / poly(q, [*D, 1.0])
    return x if p < TAIL else -x


def normal_cdf_number(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))
