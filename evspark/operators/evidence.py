"""Fusion of evidence masses as product aggregates, and the combiners it is compared with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evspark.functions.text import let


def discounted(scores: DataFrame, group: str, source: str, hypothesis: str, score: str, reliability: float, cap: float = 0.98) -> DataFrame:
    """group, source, hypothesis, mass, theta. Of each source, positive scores are scaled to `cap` at most together and
    by its reliability; theta is what is left to ignorance."""
    own = Window.partitionBy(group, source)
    positive = scores.filter(F.col(score) > 0)
    total = F.sum(score).over(own)
    mass = F.col(score) * F.least(F.lit(1.0), cap / total) * min(max(reliability, 0.0), 1.0)
    return positive.select(group, source, hypothesis, mass.alias("mass")).withColumn("theta", 1 - F.sum("mass").over(own))


#: Masses and denominators up to this count as none.
NONE = 1e-12


def dempster(masses: DataFrame, group: str, source: str, hypothesis: str) -> DataFrame:
    """group, hypothesis, belief, theta of all of a group's sources.

    Over single hypotheses and ignorance, Dempster's rule multiplies commonalities: q(h) = product of mass + theta over
    sources, t = product of theta; belief(h) = (q(h) - t) / Z with Z = sum of (q(h) - t), plus t. A source silent on h gives
    theta. That holds in any order while every source leaves something to ignorance. Groups with a source that leaves
    nothing are folded source by source, as one that contradicts all before it is passed over then.
    """
    certain = masses.filter(F.col("theta") <= NONE).select(group).distinct()
    open_ = masses.join(certain, group, "left_anti")
    thetas = open_.groupBy(group, source).agg(F.max("theta").alias("theta"))
    whole = thetas.groupBy(group).agg(F.product("theta").alias("t"))
    ratios = open_.groupBy(group, hypothesis).agg(F.product((F.col("mass") + F.col("theta")) / F.col("theta")).alias("ratio"))
    q = ratios.join(whole, group).withColumn("q", F.col("ratio") * F.col("t"))
    z = F.sum(F.col("q") - F.col("t")).over(Window.partitionBy(group)) + F.col("t")
    multiplied = q.select(group, hypothesis, ((F.col("q") - F.col("t")) / z).alias("belief"), (F.col("t") / z).alias("theta"))
    return multiplied.unionByName(in_order(masses.join(certain, group, "left_semi"), group, source, hypothesis).select(group, hypothesis, "belief", "theta"))


def in_order(masses: DataFrame, group: str, source: str, hypothesis: str) -> DataFrame:
    """group, hypothesis, belief, theta, conflict: Dempster's rule source by source, in their order, over any hypotheses. A
    source in total conflict with those before it is passed over and counts as a conflict of 1; conflict is the largest met."""
    rows = masses.groupBy(group, source).agg(F.map_from_entries(F.collect_list(F.struct(F.col(hypothesis).alias("h"), "mass"))).alias("m"), F.max("theta").alias("t"))
    ordered = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(source, F.map_entries("m").alias("m"), "t"))).alias("s"))

    def total(m: Column) -> Column:
        return F.aggregate(F.map_values(m), F.lit(0.0), lambda a, v: a + v)

    def combine(left: Column, right: Column) -> Column:
        m2 = F.map_from_entries(right["m"])
        both = F.map_zip_with(left["m"], m2, lambda h, x, y: F.coalesce(x, F.lit(0.0)) * F.coalesce(y, F.lit(0.0)))
        k = total(left["m"]) * total(m2) - total(both)
        raw = F.map_zip_with(left["m"], m2, lambda h, x, y: F.coalesce(x, F.lit(0.0)) * F.coalesce(y, F.lit(0.0)) + F.coalesce(x, F.lit(0.0)) * right["t"] + left["t"] * F.coalesce(y, F.lit(0.0)))
        kept = F.transform_values(F.map_filter(raw, lambda h, v: v > NONE), lambda h, v: v / (1 - k))
        contradicts = 1 - k <= NONE
        return F.struct(F.when(contradicts, left["m"]).otherwise(kept).alias("m"), F.when(contradicts, left["t"]).otherwise(left["t"] * right["t"] / (1 - k)).alias("t"), F.greatest(left["k"], F.when(contradicts, 1.0).otherwise(k)).alias("k"))

    kind = masses.schema[hypothesis].dataType.simpleString()
    ignorance = F.struct(F.map_from_arrays(F.array().cast(f"array<{kind}>"), F.array().cast("array<double>")).alias("m"), F.lit(1.0).alias("t"), F.lit(0.0).alias("k"))
    folded = ordered.select(group, F.aggregate("s", ignorance, combine).alias("f"))
    return folded.select(group, F.explode(F.map_entries("f.m")).alias("e"), F.col("f.t").alias("theta"), F.col("f.k").alias("conflict")).select(group, F.col("e.key").alias(hypothesis), F.col("e.value").alias("belief"), "theta", "conflict")


def ranked(beliefs: DataFrame, group: str, hypothesis: str) -> DataFrame:
    """beliefs of dempster with plausibility (belief and theta), pignistic (theta split evenly over the group's hypotheses)
    and rank by belief, then by hypothesis."""
    own = Window.partitionBy(group)
    share = F.col("theta") / F.count("*").over(own)
    made = {"plausibility": F.col("belief") + F.col("theta"), "pignistic": F.col("belief") + share, "rank": F.row_number().over(own.orderBy(F.desc(F.round("belief", 9)), hypothesis))}
    return beliefs.withColumns(made)


def combined(scores: DataFrame, keys: list[str], score: Column) -> DataFrame:
    """The largest, mean and noisy-or of the scores of each key."""
    return scores.groupBy(*keys).agg(F.max(score).alias("largest"), F.avg(score).alias("mean"), (1 - F.product(1 - score)).alias("noisy_or"))


def max_conflict(masses: DataFrame, group: str, source: str, hypothesis: str, hypotheses: list) -> DataFrame:
    """group, conflict: the largest conflict met when a group's sources are combined one by one, in their order."""
    each = [F.coalesce(F.sum(F.when(F.col(hypothesis) == h, F.col("mass"))), F.lit(0.0)) for h in hypotheses]
    rows = masses.groupBy(group, source).agg(F.array(*each).alias("m"), F.max("theta").alias("t"))
    ordered = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(source, "m", "t"))).alias("s"))

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)

    def combine(left: Column, right: Column) -> Column:
        k = total(left["m"]) * total(right["m"]) - total(F.zip_with(left["m"], right["m"], lambda a, b: a * b))
        m = F.zip_with(left["m"], right["m"], lambda a, b: (a * b + a * right["t"] + left["t"] * b) / (1 - k))
        return F.struct(m.alias("m"), (left["t"] * right["t"] / (1 - k)).alias("t"), F.greatest(left["k"], k).alias("k"))

    ignorance = F.struct(F.array(*[F.lit(0.0)] * len(hypotheses)).alias("m"), F.lit(1.0).alias("t"), F.lit(0.0).alias("k"))
    return ordered.select(group, F.aggregate("s", ignorance, combine, lambda x: x["k"]).alias("conflict"))


#: The sources in the order in which they are combined, with what each is trusted, and what a passed search tells against a belief.
SOURCES = {"symbolic": 0.86, "dynamic": 0.92, "cost": 0.86 * 0.85, "model": 0.62}
REFUTATION = 0.55


def diagnosed(found: DataFrame, group: str, source: str, hypothesis: str, score: str, groups: DataFrame, correctness: Column, refutation: float = REFUTATION, least: float = 0.22, most: int = 5) -> DataFrame:
    """group, hypothesis, belief, theta, conflict, rank of the `most` beliefs of each group, `least` at least.

    Each hypothesis has a frame of its own, present or absent. A source supports it by its largest score; the dynamic one
    speaks against it by `refutation` where the group (groups: group, passed, failed) passed its tests and the hypothesis is one of
    correctness (a condition on the hypothesis). Sources are combined in their fixed order; one in total conflict with
    those before it is passed over, with a conflict of 1. Where a group failed, beliefs of correctness come first; then the
    larger belief, then the hypothesis. Unknown sources are symbolic; null scores count as 0.
    """
    of = F.when(F.col(source).isin(list(SOURCES)), F.col(source)).otherwise("symbolic")
    best = [F.coalesce(F.max(F.when(of == s, F.col(score))), F.lit(0.0)).alias(f"_{s}") for s in SOURCES]
    rows = found.filter(F.col(hypothesis).isNotNull()).groupBy(group, hypothesis).agg(*best).join(groups, group, "left").withColumn("_correctness", correctness)

    def double(**parts: Column) -> Column:
        return F.struct(*(v.cast("double").alias(k) for k, v in parts.items()))

    def one(name: str, trust: float) -> Column:
        against = F.when(F.col("passed") & F.col("_correctness"), refutation).otherwise(0.0) if name == "dynamic" else F.lit(0.0)
        return double(s=F.greatest(F.col(f"_{name}"), F.lit(0.0)), r=against, trust=F.lit(trust))

    def masses(x: Column) -> Column:
        """Present, absent, ignorance of one source."""
        scale = F.when(x["s"] + x["r"] > NONE, F.least(F.lit(1.0), 0.98 / (x["s"] + x["r"])) * x["trust"]).otherwise(0.0)
        return let(scale, lambda f: double(m=x["s"] * f, a=x["r"] * f, t=F.greatest(F.lit(0.0), 1 - x["s"] * f - x["r"] * f)))

    def combine(b: Column, x: Column) -> Column:
        def met(y: Column) -> Column:
            def over(left: Column) -> Column:
                def mixed(k: str) -> Column:
                    return let(b[k] * y[k] + b[k] * y["t"] + b["t"] * y[k], lambda raw: F.when(raw > NONE, raw / left).otherwise(0.0))

                return F.when(left <= NONE, double(m=b["m"], a=b["a"], t=b["t"], k=F.lit(1.0))).otherwise(double(m=mixed("m"), a=mixed("a"), t=b["t"] * y["t"] / left, k=F.greatest(b["k"], 1 - left)))

            return let(1 - (b["m"] * y["a"] + b["a"] * y["m"]), over)

        return let(masses(x), met)

    folded = F.aggregate(F.array(*(one(*x) for x in SOURCES.items())), double(m=F.lit(0.0), a=F.lit(0.0), t=F.lit(1.0), k=F.lit(0.0)), combine)
    rows = rows.withColumn("_f", folded).select(group, hypothesis, "failed", "_correctness", F.col("_f.m").alias("_m"), F.col("_f.t").alias("_t"), F.col("_f.k").alias("_k"))
    order = Window.partitionBy(group).orderBy(~F.coalesce(F.col("failed") & F.col("_correctness"), F.lit(False)), F.desc(F.round("_m", 9)), hypothesis)
    hits = rows.filter(F.col("_m") >= least).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return hits.select(group, hypothesis, F.col("_m").alias("belief"), F.col("_t").alias("theta"), F.col("_k").alias("conflict"), "rank")
