"""Bootstrap intervals of the difference of two samples, corrected for bias and acceleration (BCa; Efron, 1987).

Rows aren't drawn: in each replicate a row counts as often as a Poisson number of mean 1 that depends on its key and the
replicate alone, so one scan weighs all replicates and tasks hand on sums for each group and replicate. The same interval
comes out in every run and in any order of rows. What a statistic would be without one row follows from the sums and that
row, so the jackknife is a second scan against the groups' sums.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evspark.functions.chances import normal_cdf, normal_quantile
from evspark.sources.stored import stored

#: A prime: keys and replicates are mixed in its field.
PRIME = 2147483647
#: Chances that a Poisson number of mean 1 is at most 0, 1, 2...
STEPS = [sum(math.exp(-1) / math.factorial(k) for k in range(n + 1)) for n in range(9)]
#: Replicates that an interval takes at least; with fewer it is the value itself.
FEWEST = 20


def with_times(rows: DataFrame, key: str, replicate: str) -> DataFrame:
    """rows with `_w`: how often the row of a whole-numbered key counts in a replicate, 0 to 9, 1 on average. Each step is a
    column, so that what is used twice is worked out once."""
    rows = rows.withColumn("_x0", F.pmod(F.col(key).cast("long"), F.lit(PRIME)))
    rows = rows.withColumn("_y0", (F.col("_x0") * 48271 + F.col(replicate).cast("long") * 69621 + 1) % PRIME)
    rows = rows.withColumn("_z0", (F.col("_y0") * F.col("_y0") % PRIME + F.col("_x0")) % PRIME)
    rows = rows.withColumn("_u0", (F.col("_z0") * F.col("_z0") + F.col(replicate).cast("long") * 40692 + F.col("_y0")) % PRIME)
    least = [math.ceil(c * PRIME) for c in STEPS]
    return rows.withColumn("_w", sum((F.when(F.col("_u0") >= c, 1).otherwise(0) for c in least[1:]), F.when(F.col("_u0") >= least[0], 1).otherwise(0))).drop("_x0", "_y0", "_z0", "_u0")


def hedges_g(na: Column, sa: Column, qa: Column, nb: Column, sb: Column, qb: Column) -> Column:
    """Of counts, sums and sums of squares of two samples; null if one has fewer than two values, 0 without variance."""
    df = na + nb - 2
    pooled = (F.greatest(F.lit(0.0), qa - sa * sa / na) + F.greatest(F.lit(0.0), qb - sb * sb / nb)) / df
    g = F.when(pooled <= 0, 0.0).otherwise((sa / na - sb / nb) / F.sqrt(pooled) * (1 - 3 / (4 * df - 1)))
    return F.when((na >= 2) & (nb >= 2), g)


def mean_difference(na: Column, sa: Column, qa: Column, nb: Column, sb: Column, qb: Column) -> Column:
    return F.when((na >= 2) & (nb >= 2), sa / na - sb / nb)


def bca(rows: DataFrame, by: str, key: Column, value: Column, first: Column, statistic=hedges_g, replicates: int = 400, confidence: float = 0.95) -> DataFrame:
    """by, na, nb, value, low, high: the statistic of the values where `first` holds against the others, and its interval.

    Rows without value or side don't count. Where a sample has fewer than two values, or fewer than FEWEST replicates have a
    value, low and high are the value. Values are measured from their group's mean, so that sums of squares keep their
    digits; statistics shouldn't depend on where zero is. An empty table gives no rows.
    """
    plain = rows.select(F.col(by), key.alias("_k"), value.cast("double").alias("_x"), first.alias("_a")).filter("_x IS NOT NULL AND _a IS NOT NULL")
    centre = plain.groupBy(by).agg(F.avg("_x").alias("_c"))
    plain = plain.join(centre, by).withColumn("_x", F.col("_x") - F.col("_c")).drop("_c")

    def sums(frame: DataFrame, keys: list[str], weight: Column) -> DataFrame:
        aggs = []
        for side, own in (("a", F.col("_a")), ("b", ~F.col("_a"))):
            w = F.when(own, weight).otherwise(0)
            aggs += [F.sum(w).cast("double").alias(f"n{side}"), F.sum(w * F.col("_x")).alias(f"s{side}"), F.sum(w * F.col("_x") * F.col("_x")).alias(f"q{side}")]
        return frame.groupBy(*keys).agg(*aggs)

    parts = ["na", "sa", "qa", "nb", "sb", "qb"]
    whole = stored(sums(plain, [by], F.lit(1)).withColumn("value", statistic(*map(F.col, parts))), "observed")
    drawn = with_times(plain.withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(replicates)))), "_k", "_r")
    each = stored(sums(drawn, [by, "_r"], F.col("_w")).select(by, "_r", statistic(*map(F.col, parts)).alias("_v")).filter("_v IS NOT NULL"), "replicates")

    x, own = F.col("_x"), F.col("_a").cast("double")
    without = [F.col("na") - own, F.col("sa") - own * x, F.col("qa") - own * x * x, F.col("nb") - (1 - own), F.col("sb") - (1 - own) * x, F.col("qb") - (1 - own) * x * x]
    off = plain.join(whole.filter("value IS NOT NULL"), by).select(by, (statistic(*without) - F.col("value")).alias("_d")).filter("_d IS NOT NULL")
    m = off.groupBy(by).agg(F.count("*").alias("_m"), F.avg("_d").alias("_1"), F.avg(F.col("_d") * F.col("_d")).alias("_2"), F.avg(F.pow("_d", F.lit(3.0))).alias("_3"))
    second = F.col("_m") * (F.col("_2") - F.col("_1") * F.col("_1"))
    third = F.col("_m") * -(F.col("_3") - 3 * F.col("_1") * F.col("_2") + 2 * F.pow("_1", F.lit(3.0)))
    bend = m.select(by, F.when((F.col("_m") >= 3) & (6 * F.pow(F.greatest(second, F.lit(0.0)), F.lit(1.5)) > 1e-12), third / (6 * F.pow(second, F.lit(1.5)))).otherwise(0.0).alias("_bend"))

    below = each.join(whole.select(by, "value"), by).groupBy(by).agg(F.count("*").alias("_n"), F.avg((F.col("_v") < F.col("value")).cast("double")).alias("_p"))
    shift = normal_quantile(F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("_p"))))
    ends = below.join(bend, by, "left").withColumn("_z", shift).fillna(0.0, ["_bend"])

    def place(side: float) -> Column:
        top = F.col("_z") + NormalDist().inv_cdf(side)
        bottom = 1 - F.col("_bend") * top
        q = F.when(F.abs(bottom) < 1e-12, 0.5).otherwise(normal_cdf(F.col("_z") + top / bottom))
        return F.least(F.col("_n") - 1, F.greatest(F.lit(0), F.floor(q * F.col("_n"))))

    ends = ends.select(by, "_n", place((1 - confidence) / 2).alias("_lo"), place((1 + confidence) / 2).alias("_hi"))
    ranked = each.withColumn("_i", F.row_number().over(Window.partitionBy(by).orderBy("_v")) - 1).join(ends, by)  # `replicates` rows a group
    found = ranked.groupBy(by).agg(F.max(F.when(F.col("_i") == F.least("_lo", "_hi"), F.col("_v"))).alias("low"), F.max(F.when(F.col("_i") == F.greatest("_lo", "_hi"), F.col("_v"))).alias("high"), F.first("_n").alias("_n"))
    enough = (F.col("_n") >= FEWEST) & F.col("value").isNotNull()
    return whole.join(found, by, "left").select(by, F.col("na").cast("long").alias("na"), F.col("nb").cast("long").alias("nb"), "value", F.when(enough, F.col("low")).otherwise(F.col("value")).alias("low"), F.when(enough, F.col("high")).otherwise(F.col("value")).alias("high"))
