"""Statistics as column expressions of Spark's own functions."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normal_quantile(confidence: float) -> float:
    return NormalDist().inv_cdf(0.5 + confidence / 2)


def wilson(successes: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Wilson score interval; (0, 1) without trials, exact 0 and 1 at the edges."""
    z = normal_quantile(confidence)
    p = successes / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = (z / (1 + z * z / n)) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    lower = F.when((n == 0) | (successes == 0), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), centre - half))
    upper = F.when((n == 0) | (successes == n), F.lit(1.0)).otherwise(F.least(F.lit(1.0), centre + half))
    return lower, upper


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is worked out once however often it occurs there, and the expression stays small."""
    return F.element_at(F.transform(F.array(value), use), 1)


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0: Stirling's series eight above x, less the logs of what lies between."""
    return bound(x.cast("double"), _log_gamma)


def _log_gamma(x: Column) -> Column:
    z = x + 8
    between = x
    for k in range(1, 8):
        between = between * (x + k)
    inverse = 1 / (z * z)
    series = (1 / 12 - inverse * (1 / 360 - inverse * (1 / 1260 - inverse * (1 / 1680 - inverse / 1188)))) / z
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(between)


def erfc(x: Column) -> Column:
    """The complementary error function of x >= 0: below 2.5 one less a series of positive terms, from there on a continued fraction, from its end."""
    return bound(x.cast("double"), _erfc)


def _erfc(x: Column) -> Column:
    square = x * x
    first = F.struct(x.alias("term"), x.alias("total"))

    def step(s: Column, n: Column) -> Column:
        term = s["term"] * 2 * square / (2 * n + 1)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), first, step)["total"] * F.exp(-square) * (2 / math.sqrt(math.pi))
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), x, lambda t, k: x + k / 2 / t)
    return F.when(x < 2.5, 1 - series).otherwise(F.exp(-square) / math.sqrt(math.pi) / fraction)


def log_pmf(k: Column, n: Column, p: Column) -> Column:
    """ln P(X = k) of a binomial count; null for what cannot be at p = 0 or 1."""
    part = lambda count, chance: F.when(count == 0, F.lit(0.0)).when(chance > 0, count * F.log(chance))
    return log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + part(k, p) + part(n - k, 1 - p)


def _beta(v: Column) -> Column:
    """The incomplete beta function I_x(a, b) of a struct by its continued fraction, which is short where x is below the mean; its length grows with the root of a or b."""
    a, b, x = v["a"], v["b"], v["x"]

    def link(s: Column, factor: Column) -> Column:
        """One more term of the fraction: d and c are its two ends, h what it comes to."""
        solid = lambda t: F.when(F.abs(t) < 1e-300, F.lit(1e-300)).otherwise(t)
        ends = F.struct((1 / solid(1 + factor * s["d"])).alias("d"), solid(1 + factor / s["c"]).alias("c"))
        return bound(ends, lambda e: F.struct(e["d"].alias("d"), e["c"].alias("c"), (s["h"] * e["d"] * e["c"]).alias("h")))

    def step(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return bound(link(s, even), lambda t: link(t, odd))

    first = bound(1 / (1 - (a + b) * x / (a + 1)), lambda d: F.struct(d.alias("d"), F.lit(1.0).alias("c"), d.alias("h")))
    steps = F.sequence(F.lit(1).cast("long"), (40 + 4 * F.sqrt(F.greatest(a, b))).cast("long"))
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log1p(-x)) / a
    return front * F.aggregate(steps, first, lambda s, m: bound(m.cast("double"), lambda i: step(s, i)))["h"]


def binomial_cdf(k: Column, n: Column, p: Column) -> Column:
    """P(X <= k), by the incomplete beta function I_(1 - p)(n - k, k + 1); no list of outcomes."""
    given = F.struct(*(c.cast("double").alias(name) for c, name in ((k, "k"), (n, "n"), (p, "p"))))

    def found(v: Column) -> Column:
        k, n, p = v["k"], v["n"], v["p"]
        a, b = n - k, k + 1
        near = 1 - p < (a + 1) / (a + b + 2)
        part = F.struct(F.when(near, a).otherwise(b).alias("a"), F.when(near, b).otherwise(a).alias("b"), F.when(near, 1 - p).otherwise(p).alias("x"))
        inside = bound(bound(part, _beta), lambda i: F.when(near, i).otherwise(1 - i))
        return F.when(k < 0, F.lit(0.0)).when(k >= n, F.lit(1.0)).when(p <= 0, F.lit(1.0)).when(p >= 1, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), inside)))

    return bound(given, found)


def binomial_two_sided(k: Column, n: Column, p: Column) -> Column:
    """Exact two-sided test: the mass of all outcomes that are not likelier than k, up to rounding; 1 without trials.

    Chances rise to the mode and fall from it, so what counts on the other side begins at an outcome that bisection finds."""
    given = F.struct(k.cast("long").alias("k"), n.cast("long").alias("n"), p.cast("double").alias("p"), (log_pmf(k, n, p) + math.log1p(1e-7)).alias("bar"), F.least(F.floor((n + 1) * p), n).cast("long").alias("mode"))

    def test(v: Column) -> Column:
        k, n, p, mode = v["k"], v["n"], v["p"], v["mode"]
        counts = lambda j: F.coalesce(log_pmf(j, n, p) <= v["bar"], F.lit(True))
        below = k <= mode  # then the other side is above, and the first outcome there that counts is looked for

        def halve(s: Column, _: Column) -> Column:
            # above the mode low doesn't count and high does, or is out of range; below it is the other way round
            def narrow(middle: Column) -> Column:
                goes = counts(middle) == below
                return F.struct(F.when(goes, s["low"]).otherwise(middle).alias("low"), F.when(goes, middle).otherwise(s["high"]).alias("high"))

            return F.when(s["high"] - s["low"] <= 1, s).otherwise(bound(F.floor((s["low"] + s["high"]) / 2).cast("long"), narrow))

        first = F.struct(F.when(below, mode).otherwise(F.lit(-1)).cast("long").alias("low"), F.when(below, n + 1).otherwise(mode).cast("long").alias("high"))
        tails = lambda s: F.least(F.lit(1.0), binomial_cdf(F.when(below, k).otherwise(s["low"]), n, p) + 1 - binomial_cdf(F.when(below, s["high"]).otherwise(k) - 1, n, p))
        return F.when(counts(mode), F.lit(1.0)).otherwise(bound(F.aggregate(F.sequence(F.lit(1), F.lit(64)), first, halve), tails))

    sure = F.when(n == 0, F.lit(1.0)).when(p <= 0, F.when(k == 0, 1.0).otherwise(0.0)).when(p >= 1, F.when(k == n, 1.0).otherwise(0.0))
    return F.coalesce(sure, bound(given, test))


def binomial_lower_half(k: Column, n: Column) -> Column:
    """One-sided P(X <= k) at 1/2; 1 without trials."""
    return F.when(n == 0, F.lit(1.0)).otherwise(binomial_cdf(k, n, F.lit(0.5)))


def binomial_two_sided_half(k: Column, n: Column) -> Column:
    """Exact two-sided test against 1/2, whose sides mirror each other; 1 without trials."""
    return F.when((n == 0) | (k * 2 == n), F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * binomial_cdf(F.least(k, n - k), n, F.lit(0.5))))


def holm(df: DataFrame, p: str, tested: Column, out: str = "p_adjusted") -> DataFrame:
    """Holm-Bonferroni over the rows that are tested; the others get 1 and don't count. One row for each annotator."""
    flagged = df.withColumn("_tested", tested)
    rising = Window.partitionBy("_tested").orderBy(p, *[c for c in df.columns if c.endswith("_id")])
    m = F.count("*").over(Window.partitionBy("_tested"))
    step = F.least(F.lit(1.0), (m - F.row_number().over(rising) + 1) * F.col(p))
    stepped = flagged.withColumn("_step", step)
    running = F.max("_step").over(rising.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return stepped.withColumn(out, F.when(F.col("_tested"), running).otherwise(F.lit(1.0))).drop("_tested", "_step")


def chi2_survival(statistic: Column) -> Column:
    """Survival function of chi-square with one degree of freedom."""
    return erfc(F.sqrt(F.greatest(F.lit(0.0), statistic) / 2))


def normal_two_sided(z: Column) -> Column:
    """P(|Z| >= |z|) of a standard normal."""
    return erfc(F.abs(z) / math.sqrt(2))
