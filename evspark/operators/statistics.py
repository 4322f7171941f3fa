"""Tests, effect sizes, corrections and agreement as aggregates and rank windows; power by Arrow UDFs."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from evspark.sources.stored import stored


def moments(rows: DataFrame, value: Column, first: Column, by: list[str] | None = None) -> DataFrame:
    """n, mean and variance of two samples in one pass: na, ma, va where `first`, nb, mb, vb elsewhere. Variances of one value are 0."""
    aggs = []
    for s, is_own in (("a", first), ("b", ~first)):
        own = F.when(is_own, value.cast("double"))
        aggs += [F.count(own).alias("n" + s), F.avg(own).alias("m" + s), F.coalesce(F.nanvl(F.var_samp(own), F.lit(0.0)), F.lit(0.0)).alias("v" + s)]
    return rows.groupBy(*(by or [])).agg(*aggs)


def welch(m: DataFrame) -> DataFrame:
    """t and df by Satterthwaite; t = 0 and df = na + nb - 2 without variance."""
    a, b = F.col("va") / F.col("na"), F.col("vb") / F.col("nb")
    pooled = F.when(a + b <= 0, F.lit(None)).otherwise(a + b)
    t = F.coalesce((F.col("ma") - F.col("mb")) / F.sqrt(pooled), F.lit(0.0))
    df = F.coalesce(pooled * pooled / (a * a / (F.col("na") - 1) + b * b / (F.col("nb") - 1)), (F.col("na") + F.col("nb") - 2).cast("double"))
    return m.withColumns({"t": t, "df": df})


def pooled_t(m: DataFrame) -> DataFrame:
    """Student's t with pooled variance, df = na + nb - 2, Cohen's d and Hedges' g."""
    df = F.col("na") + F.col("nb") - 2
    sd = F.sqrt(((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / df)
    d = F.when(sd <= 0, 0.0).otherwise((F.col("ma") - F.col("mb")) / sd)
    return m.withColumns({"df": df.cast("double"), "t": d / F.sqrt(1 / F.col("na") + 1 / F.col("nb")), "d": d, "g": d * (1 - 3 / (4 * df - 1))})


def paired_t(pairs: DataFrame, x: Column, y: Column) -> DataFrame:
    """n, t and df of paired differences."""
    d = x.cast("double") - y.cast("double")
    m = pairs.agg(F.count(d).alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("s"))
    return m.select("n", F.when(F.col("s") > 0, F.col("m") / (F.col("s") / F.sqrt("n"))).otherwise(0.0).alias("t"), (F.col("n") - 1).cast("double").alias("df"))


def ranged(rows: DataFrame, *order: str) -> DataFrame:
    """rows as a written table whose `_part` rises with the order: rows of a part are before those of the next. Equal
    keys share a part, so keys should be distinct."""
    return stored(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")


def with_sum_before(rows: DataFrame, by: list[str], value: str, n: str) -> DataFrame:
    """rows, distinct by group and value, with `before`: the sum of n over a group's smaller values. Sums run within ranges
    and are shifted by the sums of the ranges before, so no task holds a whole group."""
    parts = ranged(rows, *by, value)
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = parts.groupBy(*by, "_part").agg(F.sum(n).alias("_sum")).withColumn("_shift", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("_in", F.coalesce(F.sum(n).over(inside), F.lit(0))).join(shift, [*by, "_part"]).withColumn("before", F.col("_in") + F.col("_shift")).drop("_in", "_shift", "_part")


def mid_ranks(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Each distinct value of a group with its count (k) and mid-rank, from running sums over distinct values."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("k"))
    return with_sum_before(counts, by, value, "k").withColumn("mid_rank", F.col("before") + (F.col("k") + 1) / 2).drop("before")


def mann_whitney(rows: DataFrame, value: str, first: str, by: list[str]) -> DataFrame:
    """na, nb, u (the smaller U), z (of U_a, corrected for ties, no continuity correction), delta (Cliff's, 2 U_a / (na nb) - 1)."""
    ranks = mid_ranks(rows, value, by)
    ties = ranks.groupBy(*by).agg(F.sum(F.pow(F.col("k").cast("double"), 3) - F.col("k")).alias("ties"))
    each = rows.groupBy(*by, value).agg(F.count(F.when(F.col(first), 1)).alias("a"), F.count("*").alias("k2"))
    sums = each.join(ranks, [*by, value]).groupBy(*by).agg(F.sum("a").alias("na"), F.sum(F.col("k2") - F.col("a")).alias("nb"), F.sum(F.col("a") * F.col("mid_rank")).alias("ra"))
    s = sums.join(ties, by).withColumn("ua", F.col("ra") - F.col("na") * (F.col("na") + 1) / 2).withColumn("nn", F.col("na").cast("double") * F.col("nb")).withColumn("n", F.col("na") + F.col("nb"))
    var = F.col("nn") / 12 * (F.col("n") + 1 - F.col("ties") / (F.col("n") * (F.col("n") - 1)))
    z = F.when(var <= 0, 0.0).otherwise((F.col("ua") - F.col("nn") / 2) / F.sqrt(var))
    return s.select(*by, "na", "nb", F.least("ua", F.col("nn") - F.col("ua")).alias("u"), z.alias("z"), (2 * F.col("ua") / F.col("nn") - 1).alias("delta"))


def wilcoxon(pairs: DataFrame, d: Column) -> DataFrame:
    """n, w (the smaller signed rank sum) and z of non-zero differences d, corrected for ties."""
    rows = pairs.select(d.cast("double").alias("d")).filter("d <> 0").select(F.abs("d").alias("size"), (F.col("d") > 0).alias("up"), F.lit(0).alias("g"))
    ranks = mid_ranks(rows, "size", ["g"]).select("size", "mid_rank", "k")
    s = rows.join(ranks, "size").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("up"), F.col("mid_rank"))), F.lit(0.0)).alias("plus"), F.sum((F.col("k") * F.col("k") - 1).cast("double")).alias("ties"))
    n = F.col("n").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    return s.select("n", F.least("plus", n * (n + 1) / 2 - F.col("plus")).alias("w"), F.when(var <= 0, 0.0).otherwise((F.col("plus") - n * (n + 1) / 4) / F.sqrt(var)).alias("z"))


def chi_square(rows: DataFrame, r: str, c: str) -> DataFrame:
    """chi2, df and sparse (cells expected below 5) over the dense grid of two categories; an empty table has null, 0 and 0.
    Rows with a null in a category don't count."""
    rows = rows.filter(F.col(r).isNotNull() & F.col(c).isNotNull())
    cells = rows.groupBy(r, c).agg(F.count("*").alias("n"))
    by_r, by_c = cells.groupBy(r).agg(F.sum("n").alias("nr")), cells.groupBy(c).agg(F.sum("n").alias("nc"))
    total = cells.agg(F.sum("n").alias("total"))
    grid = by_r.join(by_c, how="cross").join(total, how="cross").join(cells, [r, c], "left")  # categories only
    expected = F.col("nr") * F.col("nc") / F.col("total")
    part = F.pow(F.coalesce("n", F.lit(0)) - expected, 2) / expected
    return grid.agg(F.sum(F.when(expected > 0, part)).alias("chi2"), (F.greatest(F.countDistinct(r) - 1, F.lit(0)) * F.greatest(F.countDistinct(c) - 1, F.lit(0))).alias("df"), F.count(F.when(expected < 5, 1)).alias("sparse"))


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """n, observed and expected agreement and Cohen's kappa of two raters; 1 or 0 where chance agrees always."""
    cells = rows.groupBy(a, b).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("total"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    both = cells.groupBy(F.col(a).alias("label")).agg(F.sum("n").alias("x")).join(cells.groupBy(F.col(b).alias("label")).agg(F.sum("n").alias("y")), "label")
    chance = both.agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("xy"))
    m = total.join(chance, how="cross").select(F.col("total").alias("n"), (F.col("same") / F.col("total")).alias("observed"), (F.col("xy") / (F.col("total") * F.col("total"))).alias("expected"))
    return m.withColumn("kappa", F.when(F.col("expected") >= 1, F.when(F.col("observed") >= 1, 1.0).otherwise(0.0)).otherwise((F.col("observed") - F.col("expected")) / (1 - F.col("expected"))))


def krippendorff(ratings: DataFrame, unit: str, label: str) -> DataFrame:
    """Nominal alpha over units of two ratings or more; null labels are missing ratings."""
    counts = ratings.filter(F.col(label).isNotNull()).groupBy(unit, label).agg(F.count("*").alias("c"))
    units = counts.groupBy(unit).agg(F.sum("c").alias("m")).filter("m >= 2")
    rows = counts.join(units, unit)
    by_label = rows.groupBy(label).agg(F.sum("c").alias("nc"))
    n = by_label.agg(F.sum("nc").alias("n"), F.sum(F.col("nc") * (F.col("nc") - 1)).alias("pairs"))
    same = rows.agg(F.sum(F.col("c") * (F.col("c") - 1) / (F.col("m") - 1)).alias("same"))
    m = n.join(same, how="cross")
    observed, expected = 1 - F.col("same") / F.col("n"), 1 - F.col("pairs") / (F.col("n") * (F.col("n") - 1))
    return m.select("n", observed.alias("observed"), expected.alias("expected"), F.when(expected <= 0, 1.0).otherwise(1 - observed / expected).alias("alpha"))


def multilabel(gold: DataFrame, predicted: DataFrame, item: str, label: str) -> DataFrame:
    """tp, fp, fn, f1 of each label and of all together ('*'); both are distinct (item, label)."""
    joined = gold.withColumn("g", F.lit(1)).join(predicted.withColumn("p", F.lit(1)), [item, label], "full")
    counts = [F.count(F.when(F.col("g").isNotNull() & F.col("p").isNotNull(), 1)).alias("tp"), F.count(F.when(F.col("g").isNull(), 1)).alias("fp"), F.count(F.when(F.col("p").isNull(), 1)).alias("fn")]
    each = joined.groupBy(label).agg(*counts).unionByName(joined.agg(*counts).withColumn(label, F.lit("*")))
    return each.withColumn("f1", F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)))


def ranked_tests(tests: DataFrame, p: str, label: str) -> DataFrame:
    """tests, distinct by p and label, with n (all of them) and rank, numbered range by range; _part is the range.
    Tests without p take no part."""
    parts = ranged(tests.filter(F.col(p).isNotNull()), p, label)
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each range
    every = Window.partitionBy(F.lit(0))
    sizes = sizes.withColumns({"n": F.sum("_n").over(every), "_shift": F.coalesce(F.sum("_n").over(every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))}).drop("_n")
    return parts.withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy(p, label))).join(F.broadcast(sizes), "_part").withColumn("rank", (F.col("_k") + F.col("_shift")).cast("int")).drop("_k", "_shift")


def holm(tests: DataFrame, p: str, label: str) -> DataFrame:
    """Step-down adjusted p-values: the running maximum of (n - rank + 1) p, over ranges and then within them."""
    rows = ranked_tests(tests, p, label).withColumn("_v", (F.col("n") - F.col("rank") + 1) * F.col(p))
    tops = rows.groupBy("_part").agg(F.max("_v").alias("_top")).withColumn("_top", F.max("_top").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.max("_v").over(Window.partitionBy("_part").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_in", inside).join(F.broadcast(tops), "_part").withColumn("adjusted", F.least(F.lit(1.0), F.greatest("_in", "_top"))).drop("n", "_v", "_in", "_top", "_part")


def benjamini_hochberg(tests: DataFrame, p: str, label: str) -> DataFrame:
    """Step-up adjusted p-values: the running minimum, from the largest on, of n p / rank, over ranges and then within them."""
    rows = ranked_tests(tests, p, label).withColumn("_v", F.col("n") * F.col(p) / F.col("rank"))
    lows = rows.groupBy("_part").agg(F.min("_v").alias("_low")).withColumn("_low", F.min("_low").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(1, Window.unboundedFollowing)))
    inside = F.min("_v").over(Window.partitionBy("_part").orderBy("rank").rowsBetween(0, Window.unboundedFollowing))
    return rows.withColumn("_in", inside).join(F.broadcast(lows), "_part").withColumn("adjusted", F.least(F.lit(1.0), F.least("_in", "_low"))).drop("n", "_v", "_in", "_low", "_part")


def lower_quantiles(rows: DataFrame, value: str, by: str, quantiles: tuple[float, ...]) -> DataFrame:
    """by, q, value at index floor(q (n - 1)), by ranks of distinct values."""
    counts = rows.groupBy(by, value).agg(F.count("*").alias("k"))
    sizes = counts.groupBy(by).agg(F.sum("k").alias("n"))
    asked = with_sum_before(counts, [by], value, "k").join(sizes, by).withColumn("q", F.explode(F.array(*map(F.lit, quantiles))))
    index = F.floor(F.col("q") * (F.col("n") - 1))
    return asked.filter((index < F.col("before") + F.col("k")) & (index >= F.col("before"))).select(by, "q", F.col(value).alias("value"))


def zscores(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """rows with z: the value's distance from its group's mean in population deviations; 0 where the group hardly varies."""
    m = rows.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return rows.join(m, by).withColumn("z", F.when(F.col("_s") < 1e-9, 0.0).otherwise((F.col(value) - F.col("_m")) / F.col("_s"))).drop("_m", "_s")


def histogram(rows: DataFrame, by: list[str], value: str, bins: int = 12) -> DataFrame:
    """by, bin, n of each bin of equal width between a group's least and largest value; one bin where those are equal."""
    ends = rows.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = F.col("_hi") - F.col("_lo")
    index = F.when(width <= 1e-12, 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("_lo")) / width * bins))).cast("int")
    return rows.filter(F.col(value).isNotNull()).join(ends, by).groupBy(*by, index.alias("bin")).agg(F.count("*").alias("n"))


def magnitude(effect: Column, bands: tuple[float, float, float]) -> Column:
    """negligible, small, medium or large, by the three limits."""
    size = F.abs(effect)
    return F.when(size < bands[0], "negligible").when(size < bands[1], "small").when(size < bands[2], "medium").otherwise("large")


#: Limits of the words for Cohen's d and for Cliff's delta.
D_BANDS, DELTA_BANDS = (0.2, 0.5, 0.8), (0.147, 0.33, 0.474)


def multilabel_totals(gold: DataFrame, predicted: DataFrame, item: str, label: str) -> DataFrame:
    """n, exact, hamming, precision, recall, micro_f1 and macro_f1 (over labels that gold has) over all items; both are
    distinct (item, label), and items are those of either."""
    joined = gold.withColumn("g", F.lit(1)).join(predicted.withColumn("p", F.lit(1)), [item, label], "full")
    wrong = F.col("g").isNull() | F.col("p").isNull()
    items = joined.groupBy(item).agg(F.count(F.when(wrong, 1)).alias("wrong"))
    of_items = items.agg(F.count("*").alias("n"), F.avg((F.col("wrong") == 0).cast("double")).alias("exact"), F.avg("wrong").alias("off"))
    each = multilabel(gold, predicted, item, label)
    labels = each.filter(F.col(label) != "*")
    of_labels = labels.agg(F.count("*").alias("labels"), F.avg(F.when(F.col("tp") + F.col("fn") > 0, F.col("f1"))).alias("macro_f1"))
    m = each.filter(F.col(label) == "*").join(of_items, how="cross").join(of_labels, how="cross")  # one row each
    return m.select("n", "exact", (1 - F.col("off") / F.col("labels")).alias("hamming"), F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"), F.col("f1").alias("micro_f1"), "macro_f1")


def required_n(d: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    """Cases in each of two groups that find an effect of d with the given power, by the normal approximation with its small-sample term."""
    a, b = NormalDist().inv_cdf(1 - alpha / 2), NormalDist().inv_cdf(power)
    return F.ceil(2 * F.pow((a + b) / F.abs(d), 2) + a * a / 4)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny, c = 1e-300, 1.0
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def incomplete_gamma(s: float, x: float) -> float:
    """Regularised, lower."""
    if x <= 0:
        return 0.0
    front = math.exp(s * math.log(x) - x - math.lgamma(s))
    if x < s + 1:
        term = total = 1 / s
        k = s
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return front * total
    b, c = x + 1 - s, 1e300
    d = 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - s)
        b += 2
        d, c = 1 / (an * d + b), b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return 1 - front * h


def t_upper(x: float, df: float) -> float:
    """The chance of a larger value of Student's t."""
    half = incomplete_beta(df / 2, 0.5, df / (df + x * x)) / 2
    return half if x >= 0 else 1 - half


def t_quantile(p: float, df: float) -> float:
    """The value that Student's t stays below with chance p, by halving."""
    low, high = -1.0, 1.0
    while t_upper(low, df) < 1 - p:
        low *= 2
    while t_upper(high, df) > 1 - p:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if t_upper(middle, df) > 1 - p else (low, middle)
    return (low + high) / 2


def power(effect: float, n: int, alpha: float = 0.05) -> float:
    """The chance that a two-sided test of two groups of n finds the effect, by the normal form of the shifted t."""
    if n < 2:
        return 0.0
    limit, shift, normal = t_quantile(1 - alpha / 2, 2 * n - 2), abs(effect) * math.sqrt(n / 2), NormalDist()
    return normal.cdf(shift - limit) + normal.cdf(-shift - limit)


def detectable(n: int, wanted: float = 0.8, alpha: float = 0.05) -> float:
    """The smallest effect, of up to 5, that two groups of n find with the wanted power."""
    if n < 2:
        return 5.0
    limit, normal, low, high = t_quantile(1 - alpha / 2, 2 * n - 2), NormalDist(), 0.0, 5.0
    for _ in range(60):
        middle = (low + high) / 2
        shift = middle * math.sqrt(n / 2)
        low, high = (middle, high) if normal.cdf(shift - limit) + normal.cdf(-shift - limit) < wanted else (low, middle)
    return (low + high) / 2


def cases_needed(effect: float, wanted: float = 0.8, alpha: float = 0.05, most: int = 100_000) -> int:
    """The smallest n of two groups that finds the effect with the wanted power; `most` where none up to it does."""
    if not effect or power(effect, most, alpha) < wanted:
        return most
    low, high = 2, most
    while low < high:
        middle = (low + high) // 2
        low, high = (middle + 1, high) if power(effect, middle, alpha) < wanted else (low, middle)
    return low


@F.pandas_udf(DoubleType())
def power_of(effect: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([power(d, int(k)) for d, k in zip(effect, n)])


@F.pandas_udf(DoubleType())
def detectable_of(n: pd.Series) -> pd.Series:
    return n.map(lambda k: detectable(int(k)))


@F.pandas_udf(LongType())
def cases_needed_of(effect: pd.Series) -> pd.Series:
    return effect.map(cases_needed)
