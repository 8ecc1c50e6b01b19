"""Predictive monitoring: how surprising a window's events are, given all earlier ones."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.special import beta_inc, beta_inc_array, chi2_upper_even, lgamma
from tidemark.functions.timescale import StepFunction
from tidemark.operators.series import previous, running_sum


def log_pmf(r: Column, t: Column, shape: Column, rate: Column) -> Column:
    """Posterior predictive (negative binomial) log probability of r events in time t."""
    n = r.cast("double")
    return lgamma(shape + n) - lgamma(shape) - lgamma(n + 1) + shape * (F.log(rate) - F.log(rate + t)) + n * (F.log(t) - F.log(rate + t))


def cdf_below(r: Column, t: Column, shape: Column, rate: Column) -> tuple[Column, Column]:
    """P(X < r) and P(X = r); the first is an incomplete beta function, so a large r costs no more terms than its root."""
    n = r.cast("double")
    below = F.when(n > 0, beta_inc(shape, F.greatest(n, F.lit(1.0)), rate / (rate + t))).otherwise(0.0)
    return below, F.exp(log_pmf(r, t, shape, rate))


def tails(windows: DataFrame, r: str, t: str, shape: str, rate: str) -> DataFrame:
    """windows with p_lower and p_upper, mid-p values, and p_two, twice the smaller one."""
    below, at = cdf_below(F.col(r), F.col(t), F.col(shape), F.col(rate))
    out = windows.withColumn("_x", F.struct(below.alias("below"), at.alias("at")))
    lower = F.col("_x.below") + F.col("_x.at") / 2
    out = out.withColumns({"p_lower": lower, "p_upper": F.greatest(F.lit(0.0), 1 - lower)}).drop("_x")
    return out.withColumn("p_two", F.least(F.lit(1.0), 2 * F.least("p_lower", "p_upper")))


#: Tails that differ by this part of their size at most are equal ones.
SAME = 1e-10


def _matching(edge: np.ndarray, tail: Callable[[np.ndarray], np.ndarray], to: np.ndarray, sign: int) -> np.ndarray:
    """The first whole number from edge on, in the direction of sign, where the falling tail is at most ``to``;
    -1 where there is none on the way to 0."""
    step, at = np.ones_like(edge), edge.copy()
    inside = lambda i: np.where(i >= 0, tail(np.maximum(i, 0)), 0.0) <= to
    far = at + sign * step
    while not (done := inside(far)).all():
        step = np.where(done, step, 2 * step)
        far = np.where(done, far, at + sign * step)
    near = at
    while (np.abs(far - near) > 1).any():
        mid = near + np.trunc((far - near) / 2)
        ok = inside(mid)
        far, near = np.where(ok & (np.abs(far - near) > 1), mid, far), np.where(ok | (np.abs(far - near) <= 1), near, mid)
    return np.where(inside(near), near, np.maximum(far, -1))


def two_sided_masses(r: np.ndarray, t: np.ndarray, shape: np.ndarray, rate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(g < g_r) and P(g <= g_r) of the predictive distribution, g_i being the smaller of P(X <= i) and P(X >= i).

    P(X <= i) rises and P(X >= i) falls in i, so the numbers with a smaller g are those beyond r on its own
    side, and those from a matching point on the other side on, which is found by doubling and halving."""
    q = rate / (rate + t)
    up = lambda i: beta_inc_array(shape, i + 1, q)  # noqa: E731  P(X <= i)
    down = lambda i: np.where(i > 0, beta_inc_array(np.maximum(i, 1), shape, 1 - q), 1.0)  # noqa: E731  P(X >= i)
    r = r.astype(float)
    low, high = up(r), down(r)
    is_low = low <= high
    g = np.where(is_low, low, high)
    out = []
    for own, limit in ((np.where(is_low, np.where(r > 0, up(np.maximum(r - 1, 0)), 0.0), down(r + 1)), g * (1 - SAME)), (g, g * (1 + SAME))):
        above = _matching(r + 1, down, limit, 1)
        below = _matching(np.maximum(r - 1, -1), up, limit, -1)
        out.append(np.minimum(1.0, own + np.where(is_low, down(above), np.where(below >= 0, up(np.maximum(below, 0)), 0.0))))
    return out[0], out[1]


def two_sided(windows: DataFrame, r: str, t: str, shape: str, rate: str) -> DataFrame:
    """windows with p_less and p_most, the ends of the p-value's interval, and p_mid between them."""

    @F.pandas_udf("p_less double, p_most double")
    def masses(r: pd.Series, t: pd.Series, shape: pd.Series, rate: pd.Series) -> pd.DataFrame:
        less, most = two_sided_masses(*(x.to_numpy(float) for x in (r, t, shape, rate))) if len(r) else ([], [])
        return pd.DataFrame({"p_less": less, "p_most": most})

    found = windows.withColumn("_m", masses(*(F.col(c).cast("double") for c in (r, t, shape, rate))))
    return found.select(*windows.columns, "_m.p_less", "_m.p_most").withColumn("p_mid", (F.col("p_less") + F.col("p_most")) / 2)


def uniform(*names: Column) -> Column:
    """A number in (0, 1) that follows from the names alone: reproducible under any partitioning."""
    digits = F.substring(F.md5(F.concat_ws(":", *[n.cast("string") for n in names])), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / 2.0**52


def monte_carlo(intervals: DataFrame, keys: list[str], place: str, draws: int, low: str = "p_less", high: str = "p_most", seed: int = 1) -> DataFrame:
    """(keys, n, combined): Fisher's combination of p-values that are known as intervals, averaged over draws
    of one value from each. place: a column that tells a key's intervals apart."""
    each = intervals.withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    u = uniform(F.lit(seed), *[F.col(k) for k in keys], F.col(place), F.col("_draw"))
    drawn = each.withColumn("_p", F.col(low) + u * (F.col(high) - F.col(low)))
    return fisher(drawn, [*keys, "_draw"], "_p").groupBy(*keys).agg(F.first("n").alias("n"), F.avg("combined").alias("combined"))


def windows_of(events: DataFrame, series: DataFrame, start: float, n: int, width: float) -> DataFrame:
    """(series, win, r) of tumbling windows, those without events too."""
    all_windows = series.select("series").withColumn("win", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    seen = events.withColumn("win", F.floor((F.col("t") - start) / width).cast("int")).groupBy("series", "win").agg(F.count(F.lit(1)).alias("r"))
    return all_windows.join(seen, ["series", "win"], "left").fillna(0, ["r"])


def sequential(windows: DataFrame, width: float, alpha: float, beta: float) -> DataFrame:
    """windows (series, win, r) with the posterior of all earlier windows, and the tails of r."""
    before = Window.partitionBy("series").orderBy("win").rowsBetween(Window.unboundedPreceding, -1)
    known = windows.withColumns({"shape": F.lit(alpha) + F.coalesce(F.sum("r").over(before), F.lit(0)), "rate": F.lit(beta) + F.col("win") * width, "t": F.lit(width)})
    return tails(known, "r", "t", "shape", "rate")


def fisher(pvalues: DataFrame, keys: list[str], p: str = "p") -> DataFrame:
    """Combined p-value of independent ones: chi-squared with an even number of degrees, in closed form."""
    sums = pvalues.groupBy(*keys).agg((-2 * F.sum(F.log(F.col(p)))).alias("_x"), F.count(F.lit(1)).alias("n"), F.min(p).alias("_p"))
    return sums.withColumn("combined", F.when(F.col("n") == 1, F.col("_p")).otherwise(chi2_upper_even(F.col("_x"), F.col("n")))).drop("_x", "_p")


def waiting_times(events: DataFrame, start: float, width: float, bucket: float, alpha: float, beta: float) -> DataFrame:
    """Each event's gap to the event before (the first: to start), its survival probability given all
    earlier gaps, and the window that it ends in."""
    gaps = previous(events, "t", "_before", bucket, order=("t", "seq")).withColumn("gap", F.col("t") - F.coalesce("_before", F.lit(start))).drop("_before")
    counted = running_sum(gaps, {"_n": F.lit(1)}, bucket, order=("t", "seq"))
    shape, rate = F.lit(alpha) + F.col("_n") - 1, F.lit(beta) + F.col("t") - start - F.col("gap")
    return counted.withColumns({"win": F.floor((F.col("t") - start) / width).cast("int"), "p": F.exp(shape * (F.log(rate) - F.log(rate + F.col("gap"))))}).drop("_n")


def given_history(windows: DataFrame, r_before: str, t_before: str, r: str, t: str, alpha: float, beta: float) -> DataFrame:
    """windows with the tails of r events in time t, given r_before events in time t_before."""
    known = windows.withColumns({"shape": F.lit(alpha) + F.col(r_before), "rate": F.lit(beta) + F.col(t_before)})
    return tails(known, r, t, "shape", "rate")


def event_counts(windows: DataFrame, scale: StepFunction, width: float, alpha: float, beta: float) -> DataFrame:
    """windows (series, win, r) with the tails of r in scaled time, given all earlier windows. A window
    without scaled time can't be observed: its p-values are one half."""
    start = F.col("win") * width
    timed = windows.withColumn("t", scale.integral(start + width) - scale.integral(start))
    before = Window.partitionBy("series").orderBy("win").rowsBetween(Window.unboundedPreceding, -1)
    known = timed.withColumns({"shape": F.lit(alpha) + F.coalesce(F.sum("r").over(before), F.lit(0)), "rate": F.lit(beta) + F.coalesce(F.sum("t").over(before), F.lit(0.0)), "observable": F.col("t") > 0})
    half = lambda name: F.when(F.col("observable"), F.col(name)).otherwise(1.0 if name == "p_two" else 0.5).alias(name)
    scored = tails(known.withColumn("_t", F.when(F.col("observable"), F.col("t")).otherwise(1.0)), "r", "_t", "shape", "rate")
    return scored.select(*[half(c) if c.startswith("p_") else F.col(c) for c in scored.columns if c != "_t"])


def window_waiting_times(events: DataFrame, series: DataFrame, start: float, windows: int, width: float, bucket: float, alpha: float, beta: float) -> DataFrame:
    """Of each series and window: the combined p-value of its gaps (p_upper, p_lower, p_two) and their number n.

    A window's first gap begins with it, and its last one, censored by its end, counts with half its
    survival probability. A gap's survival is predicted from all events and time before it."""
    ends = series.select("series").withColumn("seq", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(windows - 1).cast("long"))))
    # An event at a window's end is in the next one.
    marks = ends.select("series", "seq", (F.lit(start) + (F.col("seq") + 1) * width).alias("t"), F.lit(0).alias("_event"))
    rows = events.where((F.col("t") >= start) & (F.col("t") < start + windows * width)).select("series", "seq", "t", F.lit(1).alias("_event")).unionByName(marks)
    order = ("t", "_event", "seq")
    gaps = running_sum(previous(rows, "t", "_before", bucket, order=order), {"_n": F.col("_event")}, bucket, order=order)
    since = F.coalesce("_before", F.lit(start))
    gaps = gaps.withColumns({"gap": F.col("t") - since, "_shape": F.lit(alpha) + F.col("_n") - F.col("_event"), "_rate": F.lit(beta) + since - start})
    survival = F.exp(F.col("_shape") * (F.log("_rate") - F.log(F.col("_rate") + F.col("gap"))))
    win = F.when(F.col("_event") == 1, F.floor((F.col("t") - start) / width)).otherwise(F.col("seq")).cast("long")
    each = gaps.where((F.col("_event") == 1) | (F.col("gap") > 0)).select("series", win.alias("win"), F.when(F.col("_event") == 1, survival).otherwise(survival / 2).alias("p"))
    upper = fisher(each, ["series", "win"]).withColumnRenamed("combined", "p_upper")
    lower = fisher(each.withColumn("p", 1 - F.col("p")), ["series", "win"]).select("series", "win", F.col("combined").alias("p_lower"))
    return upper.join(lower, ["series", "win"]).withColumn("p_two", 2 * F.least("p_upper", 1 - F.col("p_upper")))
