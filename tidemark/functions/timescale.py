"""Periodic step functions and decay functions of time.

A step function is a small table (knot, height) with its period; knots start at 0 and a knot's
height holds from the knot on. It is carried as arrays in a literal, bounded by the profile, so
values and integrals are Columns and need no join.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class StepFunction:
    knots: tuple[float, ...]
    heights: tuple[float, ...]
    period: float

    def __post_init__(self):
        if not self.knots or self.knots[0] != 0 or list(self.knots) != sorted(set(self.knots)) or len(self.knots) != len(self.heights) or self.period <= self.knots[-1]:
            raise ValueError("knots must start at 0, ascend, end before the period, and have a height each")

    @property
    def integrals(self) -> tuple[float, ...]:
        """Up to each knot, and to the period."""
        out, total = [], 0.0
        for i, k in enumerate(self.knots):
            total += self.heights[i - 1] * (k - self.knots[i - 1]) if i else 0.0
            out.append(total)
        return (*out, total + self.heights[-1] * (self.period - self.knots[-1]))

    def _folds(self, t: Column) -> tuple[Column, Column]:
        """Full periods before t, and t within its period; t at the first period's very end isn't folded."""
        n = F.when(t > self.period, F.floor(t / self.period)).otherwise(0)
        return n, t - n * self.period

    def _place(self, x: Column) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, self.knots)), lambda k: k <= x))

    def value(self, t: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, self.heights)), self._place(self._folds(t)[1]))

    def integral(self, t: Column, start: Column | None = None) -> Column:
        """From 0, or from start, to t."""
        n, x = self._folds(t)
        at = self._place(x)
        own = F.element_at(F.array(*map(F.lit, self.integrals)), at) + (x - F.element_at(F.array(*map(F.lit, self.knots)), at)) * F.element_at(F.array(*map(F.lit, self.heights)), at)
        whole = n * F.lit(self.integrals[-1]) + own
        return whole - self.integral(start) if start is not None else whole

    def scaled(self, by: float) -> StepFunction:
        return StepFunction(self.knots, tuple(h * by for h in self.heights), self.period)

    def standardised(self) -> StepFunction:
        """With an integral of one over the period."""
        return self.scaled(1 / self.integrals[-1])

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame(list(zip(self.knots, self.heights, strict=True)), "knot double, height double")


def prefix_integrals(steps: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, knot, height) with the integral up to each knot."""
    order = Window.partitionBy(*keys).orderBy("knot")
    width = F.lead("knot").over(order) - F.col("knot")
    return steps.withColumn("area", F.col("height") * width).withColumn("integral", F.coalesce(F.sum("area").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).drop("area")


def combine(first: DataFrame, second: DataFrame, end: float, period: float, multiply: bool = True, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sum or product of two step functions (keys, knot, height) on their merged knots; the second one repeats with its period up to end."""
    repeats = F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-int(end * 1_000_000) // int(period * 1_000_000)) - 1))))
    none = F.lit(None).cast("double")
    again = second.withColumn("n", repeats).select(*keys, (F.col("knot") + F.col("n") * period).alias("knot"), none.alias("a"), F.col("height").alias("b")).where(F.col("knot") < end)
    both = first.select(*keys, "knot", F.col("height").alias("a"), none.alias("b")).unionByName(again).groupBy(*keys, "knot").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    order = Window.partitionBy(*keys).orderBy("knot").rowsBetween(Window.unboundedPreceding, 0)
    a, b = F.last("a", ignorenulls=True).over(order), F.last("b", ignorenulls=True).over(order)
    return both.select(*keys, "knot", (a * b if multiply else a + b).alias("height"))


def decay(t: Column, rho: float) -> Column:
    return F.exp(-rho * t)


def decay_integral(t: Column, rho: float, start: Column | None = None) -> Column:
    """Of exp(-rho t) from 0, or start, to t; t itself where rho isn't positive."""
    if start is not None:
        return decay_integral(t, rho) - decay_integral(start, rho)
    return (1 - F.exp(-rho * t)) / rho if rho > 0 else t


def step_of_means(segments: DataFrame, keys: list[str], normalise: bool = False) -> DataFrame:
    """(keys, knot, height): the segments' means as a step function, with an integral of one if normalised.

    segments: (keys, tau_l, tau_r, mean)."""
    steps = segments.select(*keys, F.col("tau_l").alias("knot"), F.col("mean").alias("height"), (F.col("mean") * (F.col("tau_r") - F.col("tau_l"))).alias("_area"))
    if normalise:
        steps = steps.join(steps.groupBy(*keys).agg(F.sum("_area").alias("_whole")), keys).withColumn("height", F.col("height") / F.col("_whole"))
    return steps.select(*keys, "knot", "height")


def time_scale(trend: StepFunction | None, season: StepFunction | None, third: StepFunction | None = None) -> list[StepFunction]:
    """The factors of a time scale: those that are there; a missing trend leaves the season alone."""
    return [f for f in (trend, season, third) if f is not None]


def rate_factor(t: Column, factors: list[StepFunction]) -> Column:
    """The product of a time scale's factors at t; one where there are none."""
    return reduce(lambda product, f: product * f.value(t), factors, F.lit(1.0))


def profile_integral(rows: DataFrame, profiles: DataFrame, period: float, t: str = "t", out: str = "scaled") -> DataFrame:
    """rows (series, t) with the integral from 0 to t of each series' own periodic step function.

    profiles: (series, knot, height), with a knot at 0 for each series. A series' knots are one row, bounded by
    its profile; a series without a profile keeps its time as it is."""
    knots = profiles.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("knot", "height"))).alias("_k"))
    # Each knot with the integral up to it, and the whole period's.
    ends = F.concat(F.slice(F.transform("_k", lambda k: k["knot"]), F.lit(2), F.size("_k")), F.array(F.lit(period)))
    areas = F.transform(F.arrays_zip(F.col("_k").alias("k"), ends.alias("e")), lambda x: x["k"]["height"] * (x["e"] - x["k"]["knot"]))
    sums = F.aggregate(areas, F.array(F.lit(0.0)), lambda s, a: F.concat(s, F.array(F.element_at(s, -1) + a)))
    prepared = knots.select("series", "_k", sums.alias("_s"))
    n = F.when(F.col(t) > period, F.floor(F.col(t) / period)).otherwise(0)
    x = F.col(t) - n * period
    at = F.size(F.filter("_k", lambda k: k["knot"] <= x))
    own = F.element_at("_k", at)
    value = n * F.element_at("_s", -1) + F.element_at("_s", at) + (x - own["knot"]) * own["height"]
    return rows.join(prepared, "series", "left").withColumn(out, F.when(F.col("_k").isNull(), F.col(t)).otherwise(value)).drop("_k", "_s")
