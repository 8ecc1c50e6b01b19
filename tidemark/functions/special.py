"""Special functions: as Columns where Spark has none, and in numpy for the sampling kernels."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lanczos coefficients for g = 7, n = 9.
LANCZOS_G = 7
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)
EULER = 0.57721566490153286


def lgamma(x: Column) -> Column:
    """Log-gamma for x > 0, relative error near 1e-15; stays in generated code."""
    up = F.when(x < 1, x + 1).otherwise(x)
    y = up - 1
    s = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        s = s + F.lit(c) / (y + i)
    t = y + (LANCZOS_G + 0.5)
    value = F.lit(0.5 * math.log(2 * math.pi)) + (y + 0.5) * F.log(t) - t + F.log(s)
    return F.when(x < 1, value - F.log(x)).otherwise(value)


def harmonic_digamma(n: int) -> float:
    """psi(n) for an integer n >= 1."""
    return sum(1 / i for i in range(1, n)) - EULER if n < 64 else math.log(n) - 1 / (2 * n) - 1 / (12 * n**2) + 1 / (120 * n**4) - 1 / (252 * n**6)


def digamma_integer(n: Column) -> Column:
    """psi(n) for integers n >= 1: shifted up to n + 8, then the asymptotic series."""
    x = n.cast("double") + 8
    shift = F.lit(0.0)
    for i in range(8):
        shift = shift + F.lit(1.0) / (n + i)
    series = F.log(x) - 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * F.pow(x, F.lit(4))) - 1 / (252 * F.pow(x, F.lit(6))) + 1 / (240 * F.pow(x, F.lit(8)))
    return series - shift


def chi2_upper_even(x: Column, half: Column) -> Column:
    """P(chi-squared with 2 * half degrees of freedom > x): a finite Poisson sum, in log space."""
    h = x / 2
    terms = F.transform(F.sequence(F.lit(0), F.greatest(half.cast("int") - 1, F.lit(0))), lambda i: -h + F.when(i == 0, 0.0).otherwise(i * F.log(h)) - lgamma(i.cast("double") + 1))
    top = F.array_max(terms)
    total = F.aggregate(terms, F.lit(0.0), lambda a, v: a + F.exp(v - top))
    return F.when(x <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.exp(top) * total))


def beta_inc(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta I_x(a, b) for a, b > 0 and 0 <= x <= 1, by its continued fraction.

    The fraction is run up from a depth that grows with the root of the larger parameter: 30 + 3 sqrt(max(a, b))
    steps give all digits."""

    def value(s: Column) -> Column:
        a, b, x = s["a"], s["b"], s["x"]

        def step(f: Column, k: Column) -> Column:
            m = F.floor(k / 2)
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            return 1 + F.when(k % 2 == 0, even).otherwise(odd) / f

        depth = (30 + 3 * F.sqrt(F.greatest(a, b))).cast("int")
        fraction = F.aggregate(F.sequence(depth, F.lit(1), F.lit(-1)), F.lit(1.0), step)
        front = a * F.log(x) + b * F.log1p(-x) + lgamma(a + b) - lgamma(a) - lgamma(b)
        low = F.exp(front) / (a * fraction)
        return F.when(s["flip"], 1 - low).otherwise(low)

    a, b, x = a.cast("double"), b.cast("double"), x.cast("double")
    flip = x >= (a + 1) / (a + b + 2)
    turned = F.struct(F.when(flip, b).otherwise(a).alias("a"), F.when(flip, a).otherwise(b).alias("b"), F.when(flip, 1 - x).otherwise(x).alias("x"), flip.alias("flip"))
    inside = F.element_at(F.transform(F.array(turned), value), 1)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inside)


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def beta_inc_array(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """beta_inc over arrays, for searches inside a batch."""
    flip = x >= (a + 1) / (a + b + 2)
    a, b, x = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    f = np.ones_like(x)
    for k in range(int(30 + 3 * math.sqrt(max(a.max(initial=0), b.max(initial=0)))), 0, -1):
        m = k // 2
        d = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if k % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        f = 1 + d / f
    with np.errstate(divide="ignore"):
        low = np.exp(a * np.log(x) + b * np.log1p(-x) + _lgamma(a + b) - _lgamma(a) - _lgamma(b)) / (a * f)
    return np.where(flip, 1 - low, low)


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma: series below a + 1, continued fraction above."""
    if x <= 0:
        return 0.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return min(1.0, total * front)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return max(0.0, 1 - front * h)


def gamma_p_inverse(a: float, p: float) -> float:
    """x with gamma_p(a, x) = p, by bisection on a bracket that grows from the mean."""
    if p <= 0:
        return 0.0
    lo, hi = 0.0, a + 1.0
    while gamma_p(a, hi) < p and hi < 1e300:
        lo, hi = hi, hi * 2
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if mid in (lo, hi):
            break
        lo, hi = (mid, hi) if gamma_p(a, mid) < p else (lo, mid)
    return 0.5 * (lo + hi)


def log_gamma_p(a: float, x: float) -> float:
    """Log of gamma_p, also where that underflows."""
    if x <= 0:
        return -math.inf
    if x >= a + 1:
        return math.log(gamma_p(a, x)) if x < math.inf else 0.0
    term = total = 1.0
    n = a
    while term > total * 1e-16:
        n += 1
        term *= x / n
        total += term
    return a * math.log(x) - x - math.lgamma(a + 1) + math.log(total)


def log_gammas(a: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(x) for x in a.tolist()])


def log_gamma_ps(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """log_gamma_p of arrays; x above 0. A value takes as many terms beside others as alone."""
    out, low = np.zeros(len(a)), np.flatnonzero(x < a + 1)
    own, at, left = a[low], x[low], np.arange(len(low))
    term, total, sums, n, y = np.ones(len(low)), np.ones(len(low)), np.ones(len(low)), own, at
    while len(left):
        for _ in range(8):
            n = n + 1
            term = term * y / n
            total = total + term
        sums[left] = total
        more = np.flatnonzero(term > total * 1e-16)
        left, term, total, n, y = left[more], term[more], total[more], n[more], y[more]
    out[low] = own * np.log(at) - at - log_gammas(own + 1) + np.log(sums)
    high = np.flatnonzero((x >= a + 1) & (x < np.inf))
    own, at, left, i = a[high], x[high], np.arange(len(high)), 0
    b, shape = at + 1 - own, own
    c, d = np.full(len(high), 1e300), 1 / b
    h, tails = d, d.copy()
    while len(left) and i < 10_000:
        for _ in range(8):
            i += 1
            an, b = -i * (i - shape), b + 2
            d = an * d + b
            d = 1 / np.where(d == 0, 1e-300, d)
            c = b + an / c
            c = np.where(c == 0, 1e-300, c)
            h = h * d * c
        tails[left] = h
        more = np.flatnonzero(np.abs(d * c - 1) >= 1e-15)
        left, b, shape, c, d, h = left[more], b[more], shape[more], c[more], d[more], h[more]
    out[high] = np.log1p(-np.minimum(tails * np.exp(-at + own * np.log(at) - log_gammas(own)), 1.0))
    return out


def truncated_gamma(a: float, rate: float, upper: float, rng: np.random.Generator) -> float:
    """A draw of the Gamma distribution below upper: by rejection where that is likely, by the inverse
    of the incomplete gamma function, in logs, in the far tail."""
    top = log_gamma_p(a, rate * upper)
    if top > -0.7:
        while True:
            x = rng.gamma(a) / rate
            if 0 < x < upper:
                return x
    target = math.log(1 - rng.random()) + top
    # In y = log(rate * x): Newton's steps, halved where they leave the bracket. For small x the function is a y - log(a!).
    hi = math.log(rate * upper)
    lo = y = min(hi, (target + math.lgamma(a + 1)) / a)
    for _ in range(100):
        x = math.exp(y)
        log_p = log_gamma_p(a, x)
        if abs(log_p - target) < 1e-12 * max(1.0, abs(target)) or hi - lo < 1e-14 * max(1.0, abs(y)):
            break
        lo, hi = (y, hi) if log_p < target else (lo, y)
        step = y - (log_p - target) / math.exp(a * y - x - math.lgamma(a) - log_p)
        y = step if lo < step < hi else (lo + hi) / 2
    return min(math.exp(y) / rate, upper * (1 - 1e-15))


def log_truncated_gamma_density(x: float, a: float, rate: float, upper: float) -> float:
    return a * math.log(rate) - math.lgamma(a) + (a - 1) * math.log(x) - rate * x - log_gamma_p(a, rate * upper)


def chi2_quantile(p: float, dof: float) -> float:
    return 2 * gamma_p_inverse(dof / 2, p)


def chi2_quantiles(dofs: DataFrame, p: float) -> DataFrame:
    """(dof, q) of the distinct degrees of freedom, 1 or more, in the only column."""

    def run(batches):
        for b in batches:
            yield b.assign(q=[chi2_quantile(p, k) for k in b["dof"]])

    return dofs.toDF("dof").where("dof >= 1").selectExpr("CAST(dof AS LONG) AS dof").distinct().mapInPandas(run, "dof long, q double")
