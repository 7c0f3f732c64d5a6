"""Special functions as column expressions, so that they stay in generated JVM code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Lanczos approximation of the gamma function (g = 7, nine terms).
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
#: Numerator and denominator of Hart's rational approximation of the normal tail.
HART_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
HART_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def lgamma(x: Column) -> Column:
    """ln of the gamma function for x >= 0.5."""
    y = x.cast("double") - 1
    total = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        total = total + F.lit(c) / (y + i)
    t = y + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (y + 0.5) * F.log(t) - t + F.log(total)


def log_choose(n: Column, k: Column) -> Column:
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)


def hypergeometric_tail(hits: Column, members: Column, universe: Column, drawn: Column) -> Column:
    """P(X >= hits) for `drawn` of `universe` elements, `members` of which count; 1 for no hits."""
    first = F.exp(log_choose(members, hits) + log_choose(universe - members, drawn - hits) - log_choose(universe, drawn))
    n, m, k = universe.cast("double"), members.cast("double"), drawn.cast("double")

    def step(acc: Column, i: Column) -> Column:
        more = acc["term"] * (m - i) * (k - i) / ((i + 1) * (n - m - k + i + 1))
        return F.struct(more.alias("term"), (acc["sum"] + more).alias("sum"))

    last = F.least(members, drawn)
    steps = F.when(hits < last, F.sequence(hits.cast("long"), (last - 1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    total = F.aggregate(steps, F.struct(first.alias("term"), first.alias("sum")), step, lambda acc: acc["sum"])
    return F.when(hits <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), total))


def normal_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, to about 1e-8 of its value in the far tail."""
    x = F.abs(z.cast("double"))

    def poly(c: tuple[float, ...]) -> Column:
        out = F.lit(c[0])
        for v in c[1:]:
            out = out * x + v
        return out

    tail = F.exp(-x * x / 2)
    far = x + 0.65
    for i in (4, 3, 2, 1):
        far = x + i / far
    upper = F.when(x > 37, F.lit(0.0)).when(x < 7.07106781186547, tail * poly(HART_TOP) / poly(HART_BOTTOM)).otherwise(tail / far / 2.506628274631)
    return F.when(z >= 0, upper).otherwise(1 - upper)
