"""Distribution metrics as column expressions over aligned probability arrays.

A question row carries ``options`` and one probability array per side, aligned with
them. Each metric below is then a row-local expression: no explode, no join and no
shuffle, so scoring costs one pass over the question rows whatever the cluster size.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (a let-binding)."""
    return F.transform(F.array(value), body)[0]


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def clamped(values: Column) -> Column:
    return F.transform(values, lambda x: F.greatest(x, F.lit(0.0)))


def shares(values: Column) -> Column:
    """Negative weights become 0, the rest is divided by its sum; NULL for zero mass."""
    return bind(
        clamped(values),
        lambda v: bind(
            total(v), lambda s: F.when(s > 0, F.transform(v, lambda x: x / s))
        ),
    )


def shares_or_uniform(values: Column) -> Column:
    """Shares over the declared options; zero mass gives the uniform distribution."""
    return bind(
        values,
        lambda v: bind(
            F.struct(total(v).alias("s"), (F.lit(1.0) / F.size(v)).alias("u")),
            lambda r: F.transform(v, lambda x: F.when(r["s"] > 0, x / r["s"]).otherwise(r["u"])),
        ),
    )


def _half(x: Column, m: Column) -> Column:
    return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))


def jsd(p: Column, q: Column) -> Column:
    """Base-2 Jensen-Shannon divergence; 1.0 when either side has no mass.

    Both sides are bound first: inside a lambda an unbound expression would be evaluated
    again for every element. Nothing is bound per option, as that builds an array each time.
    """

    def term(x, y):
        # the shorter of two sides of unlike length is padded with NULL, which counts as 0
        m = (F.nvl(x, F.lit(0.0)) + F.nvl(y, F.lit(0.0))) / 2
        return _half(x, m) + _half(y, m)

    def divergence(r):
        # a side without mass has no shares; a missing one has neither
        sides = F.struct(shares(r["p"]).alias("a"), shares(r["q"]).alias("b"))
        return bind(
            sides,
            lambda s: F.when((r["p"].isNotNull() & s["a"].isNull()) | (r["q"].isNotNull() & s["b"].isNull()), F.lit(1.0)).otherwise(
                F.greatest(F.lit(0.0), total(F.zip_with(s["a"], s["b"], term)) / 2)
            ),
        )

    return bind(F.struct(p.alias("p"), q.alias("q")), divergence)


def tau_b(p: Column, q: Column) -> Column:
    """Kendall's tau-b of two aligned vectors; 0 for fewer than 2 options or a constant side.

    With s(x, y) the sign of the difference, tau-b is the correlation of the sign
    matrices of both sides, so one double fold over the row's own array yields it.
    """
    zero = F.struct(
        F.lit(0.0).alias("pq"), F.lit(0.0).alias("pp"), F.lit(0.0).alias("qq")
    )

    def correlation(pairs):
        def fold(outer, left):
            def step(acc, right):
                sp, sq = F.signum(left["p"] - right["p"]), F.signum(left["q"] - right["q"])
                return F.struct(
                    (acc["pq"] + sp * sq).alias("pq"),
                    (acc["pp"] + sp * sp).alias("pp"),
                    (acc["qq"] + sq * sq).alias("qq"),
                )

            return F.aggregate(pairs, outer, step)

        return F.aggregate(
            pairs,
            zero,
            fold,
            lambda s: F.when(s["pp"] * s["qq"] == 0, F.lit(0.0)).otherwise(
                s["pq"] / F.sqrt(s["pp"] * s["qq"])
            ),
        )

    return bind(F.arrays_zip(p.alias("p"), q.alias("q")), correlation)


def parity(jsd_col: Column, tau_col: Column, w_jsd: float = 0.5, w_tau: float = 0.5) -> Column:
    """Weighted mean of ``1 - jsd`` and ``(tau + 1) / 2``, both clamped."""
    dist = F.lit(1.0) - F.greatest(F.lit(0.0), F.least(F.lit(1.0), jsd_col))
    rank = (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), tau_col)) + 1.0) / 2.0
    return (F.lit(w_jsd) * dist + F.lit(w_tau) * rank) / F.lit(w_jsd + w_tau)


SCORE_COMPONENTS = ("p_dist", "p_rank", "p_cond", "p_sub", "p_refuse")


def sps(components: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Mean of the components that are not NULL, optionally weighted; 0 when none is."""
    picked = {k: c for k, c in components.items() if k in SCORE_COMPONENTS}
    num, den = F.lit(0.0), F.lit(0.0)
    for name, col in picked.items():
        w = 1.0 if weights is None else float(weights.get(name, 0.0))
        num = num + F.coalesce(col * w, F.lit(0.0))
        den = den + F.when(col.isNotNull(), F.lit(w)).otherwise(F.lit(0.0))
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def entropy(p: Column) -> Column:
    """Shannon entropy in bits."""
    return -total(F.transform(p, lambda x: F.when(x > 0, x * F.log2(x)).otherwise(0.0)))


def uniformity(p: Column) -> Column:
    """Largest absolute distance from 1/n; 1.0 for an empty distribution."""
    return F.when(F.coalesce(F.size(p), F.lit(0)) <= 0, F.lit(1.0)).otherwise(
        bind(
            F.struct(p.alias("p"), (F.lit(1.0) / F.size(p)).alias("u")),
            lambda r: F.array_max(F.transform(r["p"], lambda x: F.abs(x - r["u"]))),
        )
    )


def top_option(options: Column, p: Column) -> Column:
    """Option with the highest mass, the earliest on a tie; NULL without mass."""
    best = F.array_max(p)
    return F.when(best > 0, F.element_at(options, F.array_position(p, best).cast("int")))


def value_of(options: Column, p: Column, option: str) -> Column:
    """Probability of one option by exact name, 0 when it is not listed."""
    pos = F.array_position(options, option).cast("int")
    return F.when(pos > 0, F.element_at(p, F.when(pos > 0, pos))).otherwise(F.lit(0.0))


def align(options: Column, weights: Column) -> Column:
    """Values of a map laid out along ``options``, absent options as 0."""
    return bind(
        weights,
        lambda w: F.transform(options, lambda o: F.coalesce(F.try_element_at(w, o), F.lit(0.0)).cast("double")),
    )


def clean_round(x: Column, places: int = 6) -> Column:
    """NULL for NULL, NaN and infinities, else rounded."""
    x = x.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(F.round(x, places))
