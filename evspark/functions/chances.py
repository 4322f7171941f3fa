"""Distribution functions as column expressions: normal, Student's t, chi-square and F, in folds of a fixed number of steps.

All arguments are columns of doubles; null gives null. Values are right to 1e-9 at least, for up to some 100,000 degrees of
freedom.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from evspark.functions.text import let


def _struct(**parts: Column) -> Column:
    return F.struct(*(v.cast("double").alias(k) for k, v in parts.items()))


def _upto(n: int) -> Column:
    return F.sequence(F.lit(1), F.lit(n))


def normal_density(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def normal_tail(x: Column) -> Column:
    """The chance of a larger value: by a series of odd powers below 3, by a continued fraction from there on."""

    def upper(v: Column) -> Column:
        near = F.aggregate(_upto(60), _struct(t=v, s=v), lambda a, k: _struct(t=a["t"] * v * v / (2 * k + 1), s=a["s"] + a["t"] * v * v / (2 * k + 1)), lambda a: 0.5 - normal_density(v) * a["s"])
        far = normal_density(v) / F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), v, lambda a, k: v + k / a)
        return F.when(v < 3, near).otherwise(far)

    return let(x.cast("double"), lambda v: F.when(v >= 0, let(v, upper)).otherwise(1 - let(-v, upper)))


def normal_cdf(x: Column) -> Column:
    return normal_tail(-x)


def normal_quantile(p: Column) -> Column:
    """The value that a normal number stays below with chance p, from 0 to 1 without the ends, by Newton's method on the
    logarithm of the tail; null elsewhere."""

    def root(q: Column) -> Column:
        def step(x: Column, _: Column) -> Column:
            return let(normal_tail(x), lambda t: x + t / normal_density(x) * (F.ln(t) - F.ln(q)))

        return F.aggregate(_upto(14), F.lit(0.0), step)

    return let(p.cast("double"), lambda v: F.when((v > 0) & (v < 1), F.when(v < 0.5, -let(v, root)).otherwise(let(1 - v, root))))


def log_gamma(x: Column) -> Column:
    """Of positive numbers, by Stirling's series ten places up."""

    def series(y: Column) -> Column:
        r = 1 / (y * y)
        return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / y

    return let(x.cast("double"), lambda v: let(v + 10, series) - F.aggregate(F.sequence(F.lit(0), F.lit(9)), F.lit(0.0), lambda a, k: a + F.ln(v + k)))


def _fraction(a: Column, b: Column, x: Column, steps: int = 300) -> Column:
    """Continued fraction of the incomplete beta function, by the modified Lentz method."""

    def part(s: Column, top: Column) -> Column:
        return let(_struct(c=1 + top / s["c"], d=1 / (1 + top * s["d"]), h=s["h"]), lambda n: _struct(c=n["c"], d=n["d"], h=n["h"] * n["c"] * n["d"]))

    def step(s: Column, k: Column) -> Column:
        m = k.cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return let(part(s, even), lambda n: part(n, odd))

    first = 1 / (1 - (a + b) * x / (a + 1))
    return F.aggregate(_upto(steps), _struct(c=F.lit(1.0), d=first, h=first), step, lambda s: s["h"])


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """Regularised."""

    def of(s: Column) -> Column:
        a, b, x = s["a"], s["b"], s["x"]
        front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.log1p(-x))
        inner = F.when(x < (a + 1) / (a + b + 2), front * _fraction(a, b, x) / a).otherwise(1 - front * _fraction(b, a, 1 - x) / b)
        return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inner)

    return let(_struct(a=a, b=b, x=x), of)


def t_tail(t: Column, df: Column) -> Column:
    """The chance of a larger value of Student's t."""
    half = incomplete_beta(df / 2, F.lit(0.5), df / (df + t * t)) / 2
    return F.when(t >= 0, half).otherwise(1 - half)


def t_two_sided(t: Column, df: Column) -> Column:
    return incomplete_beta(df / 2, F.lit(0.5), df / (df + t * t))


def t_quantile(p: Column, df: Column, steps: int = 60) -> Column:
    """The value that Student's t stays below with chance p, by halving on y = t / (1 + |t|), which is between -1 and 1."""

    def of(s: Column) -> Column:
        def step(r: Column, _: Column) -> Column:
            middle = (r["low"] + r["high"]) / 2
            above = t_tail(middle / (1 - F.abs(middle)), s["df"]) > 1 - s["p"]
            return _struct(low=F.when(above, middle).otherwise(r["low"]), high=F.when(above, r["high"]).otherwise(middle))

        return F.aggregate(_upto(steps), _struct(low=F.lit(-1.0), high=F.lit(1.0)), step, lambda r: let((r["low"] + r["high"]) / 2, lambda y: y / (1 - F.abs(y))))

    return let(_struct(p=p, df=df), of)


def incomplete_gamma(s: Column, x: Column, steps: int = 300) -> Column:
    """Regularised, lower: by its series below s + 1, by a continued fraction, folded from its end, from there on."""

    def of(r: Column) -> Column:
        s, x = r["s"], r["x"]
        front = F.exp(s * F.ln(x) - x - log_gamma(s))
        near = F.aggregate(_upto(steps), _struct(t=1 / s, v=1 / s), lambda a, k: _struct(t=a["t"] * x / (s + k), v=a["v"] + a["t"] * x / (s + k)), lambda a: a["v"])
        far = F.aggregate(F.sequence(F.lit(steps), F.lit(1), F.lit(-1)), x + 2 * steps + 1 - s, lambda v, k: x + 2 * k - 1 - s - k * (k - s) / v)
        return F.when(x <= 0, 0.0).when(x < s + 1, front * near).otherwise(1 - front / far)

    return let(_struct(s=s, x=x), of)


def chi2_cdf(x: Column, df: Column) -> Column:
    return incomplete_gamma(df / 2, x / 2)


def chi2_tail(x: Column, df: Column) -> Column:
    return 1 - chi2_cdf(x, df)


def f_tail(x: Column, df1: Column, df2: Column) -> Column:
    """The chance of a larger value of F."""
    return F.when(x > 0, incomplete_beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * x))).otherwise(F.when(x.isNotNull(), 1.0))
