"""Posterior summaries on a time grid.

A particle's segments are exploded into the grid points that they cover, so the join of grid and
segments is an equi-grouping, with a cost of the size of its output. Grid point g (from 0) lies at
start + (g + 1) * width, and belongs to the segment with tau_l < t <= tau_r.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def on_grid(segments: DataFrame, start: float, end: float, n: int) -> DataFrame:
    """segments (..., tau_l, tau_r) with a row for each grid point g, t that they cover."""
    width = (end - start) / n
    first = F.greatest(F.floor((F.col("tau_l") - start) / width), F.lit(0)).cast("int")
    last = F.least(F.floor((F.col("tau_r") - start) / width), F.lit(n)).cast("int") - 1
    return segments.withColumn("g", F.explode(F.when(first <= last, F.sequence(first, last)))).withColumn("t", F.lit(start) + (F.col("g") + 1) * width)


def prior_since(x: Column, nu: float) -> tuple[Column, Column]:
    """Mean and standard deviation, under a Poisson(nu) prior, of the time since the last changepoint at x."""
    mean = (1 - F.exp(-nu * x)) / nu
    second = 2 * (1 - F.exp(-nu * x) * (1 + nu * x)) / (nu * nu)
    return mean, F.sqrt(F.greatest(second - mean * mean, F.lit(0.0)))


def summarise(covered: DataFrame, keys: list[str], nu: float, start: float = 0.0, cap: float | None = None, decay_rate: float = 0.0) -> DataFrame:
    """Of covered grid points with weight w, rate ``mean`` and tau_l: mean intensity, mean, variance
    and standardised mean of the time since the last changepoint, and the chance that it is below
    its prior mean."""
    g = F.col("t") - F.col("tau_l")
    g = F.least(g, F.lit(cap)) if cap is not None else g
    mu, sd = prior_since(F.col("t") - start, nu)
    w, total = F.col("w"), F.sum("w")
    sums = covered.groupBy(*keys, "g", "t").agg(
        (F.sum(w * F.col("mean") * F.exp(-decay_rate * (F.col("t") - F.col("tau_l")))) / total).alias("intensity"),
        (F.sum(w * g) / total).alias("since_mean"),
        (F.sum(w * g * g) / total).alias("_second"),
        (F.sum(w * (g < mu).cast("double")) / total).alias("p_below"),
    )
    return sums.withColumns({"since_var": F.col("_second") - F.col("since_mean") * F.col("since_mean"), "since_std": (F.col("since_mean") - mu) / sd}).drop("_second")


def last_distance(particles: DataFrame, keys: list[str], end: Column) -> DataFrame:
    """Weighted mean distance from the last changepoint to the end, and the earliest last changepoint."""
    w = F.col("w")
    return particles.groupBy(*keys).agg((F.sum(w * (end - F.col("last_tau"))) / F.sum("w")).alias("mean_distance"), F.min(F.when(w > 0, F.col("last_tau"))).alias("min_last"))


def probability_variance(p: DataFrame, keys: list[str], n: int) -> DataFrame:
    return p.groupBy(*keys).agg(F.avg(F.col("p") * (1 - F.col("p")) / (n - 1)).alias("variance"))


def total_variance(values: DataFrame, keys: list[str], chain: str, value: str) -> DataFrame:
    """Mean variance within chains plus variance between their means."""
    each = values.groupBy(*keys, chain).agg(F.var_pop(value).alias("_in"), F.avg(value).alias("_mean"))
    return each.groupBy(*keys).agg((F.avg("_in") + F.var_pop("_mean")).alias("variance"))


def primary_points(n: int) -> list[float]:
    """Shares of the time range at which the primary function is evaluated."""
    return [(i + 1) / (n + 1) for i in range(n)] if n < 20 else [i / (n - 1) for i in range(n)]


def filtered(covered: DataFrame, interval: str, points: int) -> DataFrame:
    """Covered grid points that lie in the row's own interval, of so many points each: what a filter
    knew when that interval ended. Without this, all points are summarised anew in each interval."""
    return covered.where(F.floor(F.col("g") / points) == F.col(interval))


def primary(segments: DataFrame, keys: list[str], start: float, end: float, n: int, kind: str = "mean", decay_rate: float = 0.0) -> DataFrame:
    """Weighted mean and variance, at each primary point, of the segment's mean or of the distance to the
    nearest changepoint (kind "nearest") or to the one before (kind "since"), decayed from the segment's start.

    segments: (keys, w, tau_l, tau_r, mean). A point lies in the segment with tau_l < t <= tau_r, the first one in the first."""
    points = primary_points(n)
    # Around the segment's ends, a point more on either side, then the exact rule.
    step, first = (1 / (n + 1), 1) if n < 20 else (1 / (n - 1), 0)
    at = lambda tau: F.floor((F.col(tau) - start) / (end - start) / step).cast("int") - first
    some = F.sequence(F.greatest(at("tau_l") - 1, F.lit(0)), F.least(at("tau_r") + 1, F.lit(n - 1)))
    placed = segments.withColumn("i", F.explode(some)).withColumn("t", F.lit(start) + (end - start) * F.element_at(F.array(*map(F.lit, points)), F.col("i") + 1))
    inside = placed.where((F.col("t") <= F.col("tau_r")) & ((F.col("t") > F.col("tau_l")) | ((F.col("t") == start) & (F.col("tau_l") == start))))
    since = F.col("t") - F.col("tau_l")
    value = {"mean": F.col("mean"), "since": since, "nearest": F.least(since, F.col("tau_r") - F.col("t"))}[kind] * F.exp(-decay_rate * since)
    w = F.col("w")
    sums = inside.withColumn("_f", value).groupBy(*keys, "i", "t").agg((F.sum(w * F.col("_f")) / F.sum(w)).alias("mean"), (F.sum(w * F.col("_f") * F.col("_f")) / F.sum(w)).alias("_sq"))
    return sums.withColumn("variance", F.col("_sq") - F.col("mean") * F.col("mean")).drop("_sq")
