"""Closed-form segment models as Columns.

A segment has ``r`` events and length ``length`` (scaled by a time function where there is one);
segments are half-open, [left, right). Each function returns a Column, so a whole table of segments
is scored in one projection.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.special import lgamma


def c(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def poisson_loglik(r: Column, length: Column, alpha: Column | float, beta: Column | float) -> Column:
    """Log marginal likelihood of a Poisson process with a Gamma(alpha, beta) rate; 0 for an empty stretch of time."""
    a, b, n = c(alpha), c(beta), r.cast("double")
    seen = F.when(r > 0, lgamma(a + n) - lgamma(a)).otherwise(0.0)
    return F.when(length <= 0, 0.0).otherwise(a * F.log(b) + seen - (a + n) * F.log(b + length))


def poisson_interval_loglik(r: Column, left: Column, length: Column, alpha: float, beta: float, decay: float = 0.0) -> Column:
    """As poisson_loglik, with the term of exponentially decaying rates; a negative length is impossible."""
    return F.when(length < 0, -1e300).otherwise(poisson_loglik(r, length, alpha, beta) + decay * r * left)


def poisson_posterior(r: Column, length: Column, alpha: float, beta: float) -> dict[str, Column]:
    """Shape, rate, mean and variance of the rate, given the segment."""
    a, b = alpha + r, beta + length
    return {"post_shape": a.cast("double"), "post_rate": b, "post_mean": a / b, "post_var": a / (b * b)}


def gaussian_loglik(n: Column, s: Column, ss: Column, alpha: float, gamma: float, v: float) -> Column:
    """Normal values with unknown mean and variance, from count, sum and sum of squares.

    The constant is log(pi), not log(2 pi): it is the same for every segmentation."""
    n = n.cast("double")
    rest = gamma + 0.5 * (ss - s * s / (1 / v + n))
    value = -0.5 * math.log(v) + alpha * math.log(gamma) - math.lgamma(alpha) - 0.5 * F.log(1 / v + n) - n / 2 * math.log(math.pi) + lgamma(n / 2 + alpha) - (n / 2 + alpha) * F.log(rest)
    return F.when(n == 0, 0.0).otherwise(value)


def gaussian_posterior(n: Column, s: Column, ss: Column, alpha: float, gamma: float, v: float) -> dict[str, Column]:
    mean = s / (1 / v + n)
    var = (gamma + 0.5 * (ss - s * s / (1 / v + n))) / (alpha + n / 2 - 1)
    return {"post_mean": F.when(n == 0, 0.0).otherwise(mean), "post_var": F.when(n == 0, gamma / (alpha - 1)).otherwise(var)}


def shot_noise_loglik(r: Column, left: Column, length: Column, height: Column, kappa: float) -> Column:
    """A rate that starts at ``height`` and decays by kappa; without the part that all segmentations share."""
    return -(height / kappa) * (1 - F.exp(-kappa * length)) + r * F.log(height) + kappa * r * left


def adaptive_prior(r_before: Column, left: Column) -> dict[str, Column]:
    """Gamma prior of a segment from the events before it; the first segment has a fixed one."""
    rate = (r_before + 0.01) / (left + 0.1)
    first = left <= 0
    return {"alpha": F.when(first, 4.5).otherwise(rate * rate / 5), "beta": F.when(first, 1.5).otherwise(rate / 5)}


def alternate_loglik(r: Column, length: Column, rate: Column) -> Column:
    """Given the rate itself."""
    return r * F.log(rate) - rate * length


def log_gamma_pdf(x: Column, shape: Column | float, rate: Column | float) -> Column:
    a, b = c(shape), c(rate)
    return a * F.log(b) - lgamma(a) + (a - 1) * F.log(x) - b * x


def importance_term(rate: Column, before: Column, alpha: float, beta: float) -> Column:
    """Chain prior over independent prior, of one segment's rate given that of the segment before
    (null for the first): the sum over a particle's segments is its log weight."""
    shape = F.when(before.isNull(), 4.5).otherwise(before * before / 5)
    scale = F.when(before.isNull(), 1.5).otherwise(before / 5)
    return log_gamma_pdf(rate, shape, scale) - log_gamma_pdf(rate, alpha, beta)
