"""Operators on weighted particles: weights, resampling, joins, edits, and allocation of budgets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.series import bucketed_sum


def insert_component(theta: Column, at: int, value: Column) -> Column:
    """Position at (from 0) of an array gets a new value."""
    return F.concat(F.slice(theta, 1, at), F.array(value), F.slice(theta, at + 1, F.greatest(F.size(theta) - at, F.lit(0))))


def delete_component(theta: Column, at: int) -> Column:
    return F.concat(F.slice(theta, 1, at), F.slice(theta, at + 2, F.greatest(F.size(theta) - at - 1, F.lit(0))))


def change_component(theta: Column, at: int, value: Column) -> Column:
    return F.transform(theta, lambda x, i: F.when(i == at, value).otherwise(x))


def normalised(particles: DataFrame, keys: list[str], log_w: str = "log_w") -> DataFrame:
    """particles with w, their weights shifted by the largest and summing to one; a weight of zero is log -inf."""
    top = particles.groupBy(*keys).agg(F.max(log_w).alias("_top"))
    raised = particles.join(top, keys).withColumn("_e", F.when(F.col(log_w) == float("-inf"), 0.0).otherwise(F.exp(F.col(log_w) - F.col("_top"))))
    return raised.join(raised.groupBy(*keys).agg(F.sum("_e").alias("_sum")), keys).withColumn("w", F.col("_e") / F.col("_sum")).drop("_top", "_e", "_sum")


def effective_size(weighted: DataFrame, keys: list[str]) -> DataFrame:
    return weighted.groupBy(*keys).agg((F.sum("w") * F.sum("w") / F.sum(F.col("w") * F.col("w"))).alias("ess"), F.count(F.lit(1)).alias("n"), F.sum((F.col("w") == 0).cast("long")).alias("zero_weights"))


#: Weights are summed as whole numbers of this many parts of their sum, so that sums agree in any order. A long holds twice
#: as many; with fewer, what rounding does to each of a million equal weights adds up to whole points.
WEIGHT_PARTS = 2.0**62


def _buckets(order: list[str], bucket: Column | None) -> Column:
    return F.lit(0) if bucket is None else bucket


def systematic(weighted: DataFrame, keys: list[str], order: list[str], n: Column, u: float, bucket: Column | None = None) -> DataFrame:
    """weighted with offspring: how many of n evenly spaced points, shifted by u in [0, 1), fall in
    the particle's stretch of the cumulative weights. A closed form, no join with the points.

    bucket: ascends with the order; given, a key with many particles is many tasks."""
    parts = F.round(F.col("w") * WEIGHT_PARTS).cast("long")
    summed = bucketed_sum(weighted.withColumn("_w", parts), {"_before": F.col("_w")}, _buckets(order, bucket), keys, order, before=True)
    known = summed.join(weighted.groupBy(*keys).agg(F.sum(parts).alias("_all")), keys)
    points = lambda c: F.greatest(F.lit(0), F.ceil(n * (c / F.col("_all")) - u))
    return known.withColumn("offspring", (points(F.col("_before") + F.col("_w")) - points(F.col("_before"))).cast("long")).drop("_before", "_w", "_all")


def replicate(particles: DataFrame, times: str = "offspring") -> DataFrame:
    """Each particle as often as it has offspring, with a copy number from 1."""
    return particles.where(F.col(times) > 0).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))))


def zip_particles(a: DataFrame, b: DataFrame, keys: list[str], order_a: list[str], order_b: list[str], bucket: Column | None = None) -> DataFrame:
    """Pairs the i-th particles of both samples; the shorter one is gone through again.

    bucket: ascends with both orders; given, a key with many particles is many tasks."""
    slot = lambda df, order: bucketed_sum(df, {"slot": F.lit(1)}, _buckets(order, bucket), keys, order, before=True)
    size = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    sizes = size(a, "na").join(size(b, "nb"), keys).withColumn("n", F.greatest("na", "nb"))

    def spread(df: DataFrame, own: str) -> DataFrame:
        known = df.join(sizes.select(*keys, F.col(own).alias("_own"), "n"), keys)
        return known.withColumn("slot", F.explode(F.sequence(F.col("slot").cast("long"), F.col("n") - 1, F.col("_own")))).drop("_own", "n")

    left, right = spread(slot(a, order_a), "na"), spread(slot(b, order_b), "nb")
    renamed = right.select(*keys, "slot", *[F.col(c).alias(f"b_{c}") for c in right.columns if c not in (*keys, "slot")])
    return left.join(renamed, [*keys, "slot"])


def joined_weight(log_w: Column, joined_ll: Column, last_ll: Column, first_ll: Column, prior: Column | float = 0.0) -> Column:
    """Log weight after joining two particles: the joined segment replaces A's last and B's first one."""
    return log_w + joined_ll - last_ll - first_ll + prior


def spaced(last: Column, first: Column, space: float, log_w: Column) -> Column:
    """Zero weight (log -inf) where the joined changepoints lie closer than space."""
    return F.when(first.isNotNull() & (last + space > first), float("-inf")).otherwise(log_w)


def dimension_distribution(particles: DataFrame, keys: list[str], k: str = "k", weight: Column | None = None) -> DataFrame:
    """P(k)."""
    own = particles.groupBy(*keys, k).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n"))
    return own.join(own.groupBy(*keys).agg(F.sum("n").alias("_n")), keys).withColumn("p", F.col("n") / F.col("_n")).drop("_n")


def best_per_dimension(particles: DataFrame, keys: list[str], value: str, k: str = "k", tie: str = "particle") -> DataFrame:
    """The particle of largest value for each dimension; the first one wins ties."""
    best = F.max_by(F.struct(tie, value), F.struct(F.col(value), -F.col(tie))).alias("_best")
    return particles.groupBy(*keys, k).agg(best, F.count(F.lit(1)).alias("n")).select(*keys, k, f"_best.{tie}", f"_best.{value}", "n")


def greedy_allocation(scores: DataFrame, budget: int, keys: tuple[str, ...] = (), buckets: int = 4096) -> DataFrame:
    """How many extensions each process gets if one at a time goes to the largest score; of each of the
    keys' groups, if there are keys, with a budget each.

    scores: (keys, process, step, score), the score that a process has before its step-th extension. The
    greedy order is that of the running minimum of each process's scores, ties by process and step;
    so the choice is the ``budget`` largest of those. Counts by bucket of value say in which bucket the
    budget ends: what lies above is taken whole, and only that bucket's rows are ranked."""
    keys = list(keys)
    low = F.min("score").over(Window.partitionBy(*keys, "process").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    lo, hi = scores.agg(F.min("score"), F.max("score")).first()
    # Buckets of the logarithm, in twelve decades below the largest score: with buckets of equal width a few large
    # scores would leave nearly all rows to one.
    unit = max(abs(lo), abs(hi)) * 1e-12 if lo is not None and hi > lo else 1.0
    grown = lambda x: F.signum(x) * F.log1p(F.abs(x) / unit)
    bottom, top = (math.copysign(math.log1p(abs(v) / unit), v) for v in (lo, hi)) if lo is not None and hi > lo else (0.0, 0.0)
    share = (grown(F.col("low")) - bottom) / (top - bottom) if top > bottom else F.lit(0.0)
    known = scores.withColumn("low", low).withColumn("_b", F.greatest(F.lit(0), F.least(F.floor(share * buckets), F.lit(buckets - 1))).cast("int"))
    higher = Window.partitionBy(*keys).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    above = known.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_above", F.coalesce(F.sum("_n").over(higher), F.lit(0)))
    placed = known.join(above, [*keys, "_b"]).where(F.col("_above") < budget)
    whole = placed.where(F.col("_above") + F.col("_n") <= budget)
    rank = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(F.desc("low"), "process", "step"))
    last = placed.where(F.col("_above") + F.col("_n") > budget).withColumn("_r", rank).where(F.col("_above") + F.col("_r") <= budget)
    own = [*keys, "process"]
    chosen = whole.select(*own).unionByName(last.select(*own)).groupBy(*own).agg(F.count(F.lit(1)).alias("extensions"))
    return scores.select(*own).distinct().join(chosen, own, "left").fillna(0, ["extensions"])


def greedy_duplication(weighted: DataFrame, keys: list[str], extra: int, particle: str = "particle") -> DataFrame:
    """Copies of each particle after ``extra`` duplications, each where it lowers the variance most.

    The (m + 1)-th copy gains 2 log w - log m - log(m + 1), falling in m: the largest gains are taken,
    ties by particle and m. Each copy's log weight falls by the log of the copies."""
    # All gains of one copy or more are at most w^2 / 2 at m = 1, and a particle's m-th is w^2 / (m (m + 1)): what lies
    # under the best particle's last possible gain is never taken, so each explodes up to its own bound only.
    top = weighted.groupBy(*keys).agg(F.max("w").alias("_top"))
    bound = F.least(F.lit(max(extra, 1)), F.ceil(F.col("w") / F.col("_top") * (max(extra, 1) + 1))).cast("int")
    gains = weighted.where("w > 0").join(top, keys).withColumn("m", F.explode(F.sequence(F.lit(1), F.greatest(bound, F.lit(1))))).drop("_top").withColumn("gain", F.round(2 * F.log("w") - F.log("m") - F.log(F.col("m") + 1), 9))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("gain"), particle, "m"))
    more = gains.withColumn("_r", rank).where(F.col("_r") <= extra).groupBy(*keys, particle).agg(F.count(F.lit(1)).alias("_more"))
    return weighted.join(more, [*keys, particle], "left").withColumn("copies", F.coalesce("_more", F.lit(0)) + 1).withColumn("log_w", F.log("w") - F.log("copies")).drop("_more")


def concatenate(pairs: DataFrame, theta: str = "theta", log_w: str = "log_w", log_post: str | None = None) -> DataFrame:
    """Pairs of zip_particles as single particles: the positions of A, then those of B; weights and posteriors add up."""
    out = pairs.withColumns({theta: F.concat(theta, f"b_{theta}"), log_w: F.col(log_w) + F.col(f"b_{log_w}")})
    out = out.withColumn(log_post, F.col(log_post) + F.col(f"b_{log_post}")) if log_post else out
    return out.withColumn("k", F.size(theta)).drop(f"b_{theta}", f"b_{log_w}", *([f"b_{log_post}"] if log_post else []))


def existing(particles: DataFrame, others: DataFrame, keys: list[str], theta: str = "theta") -> DataFrame:
    """Particles whose positions equal those of one of the others."""
    return particles.join(others.select(*keys, theta).distinct(), [*keys, theta], "left_semi")


def monotone(means: Column, lengths: Column, decay_rate: float = 0.0) -> Column:
    """Whether no mean falls below the one before, decayed over its segment."""
    each = F.arrays_zip(F.slice(means, 2, F.size(means)).alias("next"), means.alias("own"), lengths.alias("length"))
    return F.forall(F.slice(each, 1, F.greatest(F.size(means) - 1, F.lit(0))), lambda x: x["next"] >= x["own"] * F.exp(-decay_rate * x["length"]))


def constrained(particles: DataFrame, means: str, lengths: str, decay_rate: float = 0.0) -> DataFrame:
    """Particles that keep the constraint of means that don't fall."""
    return particles.where(monotone(F.col(means), F.col(lengths), decay_rate))


def importance(particles: DataFrame, terms: str, log_w: str = "log_w") -> DataFrame:
    """Particles drawn from a model without the terms' factors, weighted towards the one with them."""
    return particles.withColumn(log_w, F.col(log_w) + F.aggregate(terms, F.lit(0.0), lambda a, x: a + x))
