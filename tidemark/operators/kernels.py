"""Sampling kernels of one series: pure Python, no Spark.

A Markov chain is sequential, so one task runs one chain of one series; Spark deals out series,
chains and windows. Segment likelihoods come from prefix sums, so a proposal costs two bisections.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from tidemark.functions.special import log_truncated_gamma_density, truncated_gamma


@dataclass(frozen=True)
class SamplerConfig:
    """Options of the samplers; times are in the unit of the series."""

    iterations: int = 20_000
    burn_in: int = 2_000
    thinning: int = 10
    nu: float = 1 / 56
    move_width: float | None = None
    max_changepoints: int | None = None
    spacing: float = 0.0
    #: Where births are proposed: uniform, normal, mixture (half uniform, half normal) or histogram.
    proposal: str = "uniform"
    #: Centre and spread of the normal one; the histogram's weights over equal bins.
    proposal_normal: tuple[float, float] = (0.0, 1.0)
    proposal_bins: tuple[float, ...] = ()
    #: Changepoints at whole numbers only, each with probability nu.
    discrete: bool = False
    random_nu: tuple[float, float] | None = None
    hill_climbing: bool = False
    no_empty_neighbours: bool = False
    #: What jumps of shot noise are proposed from: gamma (fitted to the events, truncated) or prior.
    jumps: str = "gamma"
    seed: int = 1


@dataclass
class PoissonModel:
    """Poisson events with a Gamma rate for each segment; optionally a scaled time."""

    t: list[float]
    alpha: float = 0.1
    beta: float = 0.1
    scale: Callable[[float], float] | None = None

    def index(self, x: float) -> int:
        return bisect_left(self.t, x)

    def loglik(self, a: float, b: float) -> float:
        n = self.index(b) - self.index(a)
        length = self.scale(b) - self.scale(a) if self.scale else b - a
        if length <= 0:
            return 0.0
        return self.alpha * math.log(self.beta) + (math.lgamma(self.alpha + n) - math.lgamma(self.alpha) if n else 0.0) - (self.alpha + n) * math.log(self.beta + length)

    def draw(self, a: float, b: float, rng: np.random.Generator) -> float:
        """A rate of the segment's posterior."""
        length = self.scale(b) - self.scale(a) if self.scale else b - a
        return float(rng.gamma(self.alpha + self.index(b) - self.index(a), 1 / (self.beta + length)))

    def mean(self, a: float, b: float) -> float:
        length = self.scale(b) - self.scale(a) if self.scale else b - a
        return (self.alpha + self.index(b) - self.index(a)) / (self.beta + length)


@dataclass
class GaussianModel:
    """Values at 0, 1, 2, ... with unknown mean and variance for each segment."""

    y: list[float]
    alpha: float = 2.0
    gamma: float = 2.0
    v: float = 10.0
    s: list[float] = field(init=False)
    ss: list[float] = field(init=False)

    def __post_init__(self):
        self.s = [0.0, *np.cumsum(self.y).tolist()]
        self.ss = [0.0, *np.cumsum(np.square(self.y)).tolist()]

    def _sums(self, a: float, b: float) -> tuple[int, float, float]:
        i, j = (min(max(math.ceil(x), 0), len(self.y)) for x in (a, b))
        return j - i, self.s[j] - self.s[i], self.ss[j] - self.ss[i]

    def loglik(self, a: float, b: float) -> float:
        n, s, ss = self._sums(a, b)
        if n <= 0:
            return 0.0
        rest = self.gamma + 0.5 * (ss - s * s / (1 / self.v + n))
        return -0.5 * math.log(self.v) + self.alpha * math.log(self.gamma) - math.lgamma(self.alpha) - 0.5 * math.log(1 / self.v + n) - n / 2 * math.log(math.pi) + math.lgamma(n / 2 + self.alpha) - (n / 2 + self.alpha) * math.log(rest)

    def mean(self, a: float, b: float) -> float:
        n, s, _ = self._sums(a, b)
        return s / (1 / self.v + n) if n else 0.0

    def index(self, x: float) -> int:
        return min(max(math.ceil(x), 0), len(self.y))


@dataclass
class CountModel(PoissonModel):
    """Counts at 0, 1, 2, ... with a Gamma rate for each segment."""

    counts: list[int] = field(default_factory=list)

    def __post_init__(self):
        self.sums = [0, *np.cumsum(self.counts).tolist()]

    def index(self, x: float) -> int:
        return self.sums[min(max(math.ceil(x), 0), len(self.counts))]

    def loglik(self, a: float, b: float) -> float:
        return super().loglik(math.ceil(a), math.ceil(b))


def location(cfg: SamplerConfig, start: float, end: float, rng: np.random.Generator) -> tuple[Callable[[], float], Callable[[float], float]]:
    """How a birth's location is drawn, and the log density of a location."""
    length, (centre, sd) = end - start, cfg.proposal_normal
    flat = 1 / length

    def normal_density(x: float) -> float:
        # Draws beyond an end are reflected there, so their density is folded back.
        return sum(math.exp(-0.5 * ((y - centre) / sd) ** 2) for y in (x, 2 * start - x, 2 * end - x)) / (sd * math.sqrt(2 * math.pi))

    def normal_draw() -> float:
        while True:
            x = rng.normal(centre, sd)
            x = 2 * start - x if x < start else 2 * end - x if x > end else x
            if start < x < end:
                return x

    if cfg.proposal == "normal":
        return normal_draw, lambda x: math.log(normal_density(x))
    if cfg.proposal == "mixture":
        return lambda: normal_draw() if rng.random() < 0.5 else start + rng.random() * length, lambda x: math.log(0.5 * normal_density(x) + 0.5 * flat)
    if cfg.proposal == "histogram":
        share = np.asarray(cfg.proposal_bins, float) / sum(cfg.proposal_bins)
        width, cumulative = length / len(share), np.cumsum(share)
        pick = lambda: min(int(np.searchsorted(cumulative, rng.random(), side="right")), len(share) - 1)
        return lambda: start + (pick() + rng.random()) * width, lambda x: math.log(share[min(int((x - start) / width), len(share) - 1)] / width)
    return lambda: start + rng.random() * length, lambda x: -math.log(length)


def monotone(means: list[float]) -> bool:
    """Constraint of non-decreasing rates."""
    return all(a <= b for a, b in zip(means, means[1:], strict=False))


def _edge_birth(k: int, most: int | None) -> float:
    """Log ratio of the chances to propose the death back and the birth."""
    if k == 0:
        return -math.log(2) if most == 1 else -math.log(3)
    return math.log(1.5) if most is not None and k == most - 1 else 0.0


def run_chain(model, start: float, end: float, cfg: SamplerConfig, rng: np.random.Generator, data_start: float | None = None, theta: list[float] | None = None) -> tuple[list[tuple[int, list[float], float]], dict]:
    """Reversible-jump chain over changepoints in (start, end): kept states (iteration, positions,
    log posterior) and acceptance counts. data_start: where the first segment begins, if before start."""
    u = rng.random
    s0 = start if data_start is None else data_start
    ll, most, length = model.loglik, cfg.max_changepoints, end - start
    width = cfg.move_width or length / 20
    theta = list(theta or [])
    a_nu, b_nu = (cfg.random_nu[0] ** 2 / cfg.random_nu[1], cfg.random_nu[0] / cfg.random_nu[1]) if cfg.random_nu else (0.0, 0.0)
    ends = [s0, *theta, end]
    post = sum(ll(a, b) for a, b in zip(ends, ends[1:], strict=False)) + len(theta) * math.log(cfg.nu) - cfg.nu * length
    draw, log_q = location(cfg, start, end, rng)
    # Whole numbers inside, each a changepoint with probability nu.
    places = math.ceil(end) - math.floor(start) - 1
    if cfg.discrete:
        post += places * math.log1p(-cfg.nu) - len(theta) * math.log1p(-cfg.nu) + cfg.nu * length

    def unused() -> float | None:
        """A whole number inside that is no changepoint; None if all are."""
        while len(theta) < places:
            y = float(math.floor(start) + 1 + int(u() * places))
            i = bisect_left(theta, y)
            if i == len(theta) or theta[i] != y:
                return y
        return None
    kept, tried, taken = [], {"birth": 0, "death": 0, "move": 0}, {"birth": 0, "death": 0, "move": 0}

    def log_nu(k: int) -> float:
        if cfg.discrete:
            return math.log(cfg.nu) - math.log1p(-cfg.nu)
        return math.log((a_nu + k) / (b_nu + length)) if cfg.random_nu else math.log(cfg.nu)

    def too_close(x: float, lo: float, hi: float, first: bool, last: bool) -> bool:
        return cfg.spacing > 0 and ((not first and x - lo < cfg.spacing) or (not last and hi - x < cfg.spacing))

    def empty_pair(theta: list[float], i: int) -> bool:
        """Whether a segment next to position i, and the one next to it, hold no events."""
        if not cfg.no_empty_neighbours:
            return False
        at = [model.index(x) for x in [s0, *theta, end][max(0, i - 1) : i + 4]]
        return any(a == c for a, c in zip(at, at[2:], strict=False))

    for it in range(1, cfg.burn_in + cfg.iterations + 1):
        k, x = len(theta), u()
        kind = "birth" if k == 0 else ("death" if x < 0.5 else "move") if most is not None and k >= most else "birth" if x < 1 / 3 else "death" if x < 2 / 3 else "move"
        if most == 0:
            kind = "none"
        tried[kind] = tried.get(kind, 0) + 1
        new, change, ratio = None, 0.0, 0.0
        if kind == "birth":
            y = unused() if cfg.discrete else draw()
            i = bisect_left(theta, y) if y is not None else 0
            lo, hi = (theta[i - 1] if i else s0), (theta[i] if i < k else end)
            if y is not None and not too_close(y, lo, hi, i == 0, i == k) and not empty_pair([*theta[:i], y, *theta[i:]], i):
                gain = ll(lo, y) + ll(y, hi) - ll(lo, hi)
                change = gain + log_nu(k) + (cfg.nu * min(cfg.spacing, end - y) if cfg.spacing else 0.0)
                ratio = change - (-math.log(places - k) if cfg.discrete else log_q(y)) - math.log(k + 1) + _edge_birth(k, most)
                new = theta[:i] + [y] + theta[i:]
        elif kind == "death":
            i = int(u() * k)
            lo, hi = (theta[i - 1] if i else s0), (theta[i + 1] if i + 1 < k else end)
            gain = ll(lo, hi) - ll(lo, theta[i]) - ll(theta[i], hi)
            change = gain - log_nu(k - 1) - (cfg.nu * min(cfg.spacing, end - theta[i]) if cfg.spacing else 0.0)
            ratio = change + (-math.log(places - k + 1) if cfg.discrete else log_q(theta[i])) + math.log(k) - _edge_birth(k - 1, most)
            new = theta[:i] + theta[i + 1 :]
        elif kind == "move":
            i = int(u() * k)
            lo, hi = (theta[i - 1] if i else start), (theta[i + 1] if i + 1 < k else end)
            y = theta[i] + (2 * u() - 1) * width
            if cfg.discrete:
                y = float(math.floor(lo) + 1 + int(u() * (math.ceil(hi) - math.floor(lo) - 1)))
            while not lo < y < hi:  # reflected at the neighbours
                y = 2 * lo - y if y <= lo else 2 * hi - y
                if lo == hi:
                    break
            left = theta[i - 1] if i else s0
            if not too_close(y, lo, hi, i == 0, i + 1 == k) and not empty_pair([*theta[:i], y, *theta[i + 1 :]], i):
                change = ll(left, y) + ll(y, hi) - ll(left, theta[i]) - ll(theta[i], hi)
                if cfg.spacing:
                    change += cfg.nu * (min(cfg.spacing, end - y) - min(cfg.spacing, end - theta[i]))
                ratio = change
                new = theta[:i] + [y] + theta[i + 1 :]
        climbing = cfg.hill_climbing and it > cfg.burn_in
        if new is not None and (change > 0 if climbing else ratio >= 0 or u() < math.exp(ratio)):
            theta, post = new, post + change
            taken[kind] += 1
        if it > cfg.burn_in and (it - cfg.burn_in) % cfg.thinning == 0:
            kept.append((it - cfg.burn_in, theta, post))
    return kept, {f"{k}_rate": taken[k] / tried[k] if tried.get(k) else 0.0 for k in taken}


def chain_rates(segments: np.ndarray, first: tuple[float, float], variance: float, rng: np.random.Generator) -> list[list[float]]:
    """For each number of segments: their rates drawn from a chain, the first Gamma(first), each later one Gamma with the mean of the one before and a fixed variance."""
    rate = np.maximum(rng.gamma(first[0], 1 / first[1], len(segments)), 1e-100)
    rates = [rate]
    for _ in range(int(segments.max(initial=1)) - 1):
        # A rate that has come down to nothing stays there.
        rate = np.maximum(rng.gamma(np.maximum(rate * rate / variance, 1e-300)) * variance / rate, 1e-100)
        rates.append(rate)
    return [row[:k].tolist() for row, k in zip(np.stack(rates, axis=1), segments, strict=True)]


def draw_prior(start: float, end: float, nu: float, rng: np.random.Generator) -> list[float]:
    return sorted((start + rng.random(rng.poisson(nu * (end - start))) * (end - start)).tolist())


def rejection(model: PoissonModel, start: float, end: float, nu: float, n: int, rng: np.random.Generator) -> tuple[list[list[float]], int]:
    """n exact draws with one changepoint at most, and how many were tried: the first changepoint of
    the prior is accepted by its likelihood over the largest one, which lies just before or after an event. Tries are drawn in arrays."""
    t = np.asarray(model.t)
    t = t[(t >= start) & (t < end)]
    a, b = model.alpha, model.beta
    log_fact = np.array([math.lgamma(a + i) - math.lgamma(a) for i in range(len(t) + 1)])

    def part(count: np.ndarray, length: np.ndarray) -> np.ndarray:
        return np.where(length > 0, a * math.log(b) + log_fact[count] - (a + count) * np.log(b + np.maximum(length, 0)), 0.0)

    def value(x: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Log likelihood with a changepoint at x, which count events stand before."""
        return part(count, x - start) + part(len(t) - count, end - x)

    whole = float(part(np.array(len(t)), np.array(end - start)))
    places = np.arange(len(t))
    top = max(whole, *value(t, places), *value(np.nextafter(t, end), places + 1)) if len(t) else max(whole, float(value(np.array(start), np.array(0))))
    out, tried = [], 0
    while len(out) < n:
        x = start + rng.exponential(1 / nu, size=max(64, 2 * (n - len(out))))
        inside = x < end
        ll = np.where(inside, value(np.minimum(x, end), np.searchsorted(t, x)), whole)
        taken = np.flatnonzero(rng.random(len(x)) < np.exp(np.minimum(0.0, ll - top)))[: n - len(out)]
        out += [[float(x[i])] if inside[i] else [] for i in taken]
        tried += len(x) if len(out) < n else int(taken[-1]) + 1
    return out, tried


def systematic_counts(w: np.ndarray, n: int, u: float) -> np.ndarray:
    """Offspring of each particle among n evenly spaced points."""
    c = np.cumsum(w) / w.sum()
    c[-1] = 1.0
    return np.diff(np.ceil(n * c - u).clip(0), prepend=0).astype(int)


def shot_noise_loglik(r: int, left: float, length: float, height: float, kappa: float) -> float:
    return -(height / kappa) * -math.expm1(-kappa * length) + r * math.log(height) + kappa * r * left


def _jump_terms(t: list[float], y: float, h: float, end: float, after: float | None, alpha: float, kappa: float) -> tuple[Callable[[float], float], float, float, float]:
    """Of a jump at y, on a rate h, where the next height (at end) stays as it is: the log posterior's part that
    depends on it; and shape, rate and upper limit of the truncated Gamma distribution that it is proposed from."""
    length = end - y
    mass, left = -math.expm1(-kappa * length) / kappa, math.exp(-kappa * length)
    r = bisect_left(t, end) - bisect_left(t, y)
    # The next jump shrinks by what is left of this one.
    pull = -alpha - mass + (alpha * left if after is not None else 0.0)
    rate = -pull
    return lambda j: pull * j + (r * math.log(h + j) if r else 0.0), max(1.0, r + 1 - h * rate), rate, after / left - h if after is not None else math.inf


def shot_noise_moves(t: list[float], tau: list[float], heights: list[float], lo: float, end: float, cfg: SamplerConfig, alpha: float, kappa: float, rng: np.random.Generator, steps: int, kept: list | None = None, post: float = 0.0, counts: dict | None = None) -> tuple[list[float], list[float], float]:
    """Chain steps on the changepoints in (lo, end), which leave the rest as it is; returns positions, heights and log posterior.

    A state is its positions, tau[0] being where the rate begins, and the heights there. A move keeps all later heights, so it
    changes two segments only. Jumps are proposed from a Gamma distribution below what the next height allows (cfg.jumps
    "gamma"), or from their prior ("prior"). kept: gets (step, positions, heights, log posterior) of each thinned step."""
    u, length, first = rng.random, end - lo, max(1, bisect_right(tau, lo))
    tau, heights = list(tau), list(heights)
    counts = counts if counts is not None else {}

    def around(i: int, y: float) -> tuple[float, float, float | None]:
        """Rate before y, and the next position and height, for a changepoint at y between i - 1 and i."""
        h = heights[i - 1] * math.exp(-kappa * (y - tau[i - 1])) if i else 0.0
        return h, (tau[i] if i < len(tau) else end), (heights[i] if i < len(tau) else None)

    def proposal(a: float, rate: float, upper: float) -> tuple[float, float, float]:
        return (a, rate, upper) if cfg.jumps == "gamma" else (1.0, alpha, upper)

    for it in range(1, steps + 1):
        k, x, accepted = len(tau) - first, u(), False
        if x < 0.5:
            birth = x < 0.25
            if birth or k:
                i = None if birth else first + int(u() * k)
                if birth:
                    y = lo + u() * length
                    i = bisect_left(tau, y)
                    h, nxt, after = around(i, y)
                else:
                    y = tau[i]
                    h = heights[i - 1] * math.exp(-kappa * (y - tau[i - 1]))
                    nxt, after = (tau[i + 1], heights[i + 1]) if i + 1 < len(tau) else (end, None)
                part, *law = _jump_terms(t, y, h, nxt, after, alpha, kappa)
                law = proposal(*law)
                j = truncated_gamma(*law, rng) if birth else heights[i] - h
                if j > 0 and h > 0 and law[2] > 0:
                    change = part(j) - part(0.0) + math.log(alpha) + math.log(cfg.nu)
                    ratio = change + math.log(length) - math.log(k + birth) - log_truncated_gamma_density(j, *law)
                    change, ratio = (change, ratio) if birth else (-change, -ratio)
                    if ratio >= 0 or u() < math.exp(ratio):
                        accepted, post = True, post + change
                        if birth:
                            tau.insert(i, y)
                            heights.insert(i, h + j)
                        else:
                            del tau[i], heights[i]
            kind = "birth" if birth else "death"
        elif x < 0.75:
            kind = "move"
            if k:
                i = first + int(u() * k)
                y = tau[i] + (2 * u() - 1) * (cfg.move_width or length / 20)
                nxt = tau[i + 1] if i + 1 < len(tau) else end
                if max(lo, tau[i - 1]) < y < nxt:
                    at = tau[i - 1]
                    h_old, h = (heights[i - 1] * math.exp(-kappa * (v - at)) for v in (tau[i], y))
                    top = h + heights[i] - h_old
                    drop = (top * math.exp(-kappa * (nxt - y)) - heights[i] * math.exp(-kappa * (nxt - tau[i]))) if i + 1 < len(tau) else 0.0
                    if i + 1 == len(tau) or heights[i + 1] > top * math.exp(-kappa * (nxt - y)):
                        r = lambda a, b: bisect_left(t, b) - bisect_left(t, a)
                        change = alpha * drop + sum(sign * shot_noise_loglik(r(v, w), v, w - v, g, kappa) for sign, v, w, g in ((1, at, y, heights[i - 1]), (1, y, nxt, top), (-1, at, tau[i], heights[i - 1]), (-1, tau[i], nxt, heights[i])))
                        if change >= 0 or u() < math.exp(change):
                            accepted, post, tau[i], heights[i] = True, post + change, y, top
        else:
            kind = "height"
            here = ([0] if lo <= tau[0] else []) + list(range(first, len(tau)))
            if here:
                i = here[int(u() * len(here))]
                h = heights[i - 1] * math.exp(-kappa * (tau[i] - tau[i - 1])) if i else 0.0
                nxt, after = (tau[i + 1], heights[i + 1]) if i + 1 < len(tau) else (end, None)
                part, *law = _jump_terms(t, tau[i], h, nxt, after, alpha, kappa)
                j = heights[i] - h
                if x < 0.875:
                    law = proposal(*law)
                    new = truncated_gamma(*law, rng)
                    ratio = log_truncated_gamma_density(j, *law) - log_truncated_gamma_density(new, *law) if j > 0 and new > 0 else -math.inf
                else:
                    ratio = u() - 0.5
                    new = j * math.exp(ratio)
                if 0 < new < law[2]:
                    change = part(new) - part(j)
                    if change + ratio >= 0 or u() < math.exp(change + ratio):
                        accepted, post, heights[i] = True, post + change, h + new
        counts[kind] = counts.get(kind, 0) + 1
        counts[f"{kind}_taken"] = counts.get(f"{kind}_taken", 0) + accepted
        if kept is not None and it > cfg.burn_in and (it - cfg.burn_in) % cfg.thinning == 0:
            kept.append((it - cfg.burn_in, tau[1:], list(heights), post))
    return tau, heights, post


def run_shot_noise(t: list[float], start: float, end: float, cfg: SamplerConfig, alpha: float, kappa: float, rng: np.random.Generator, counts: dict | None = None) -> list[tuple[int, list[float], list[float], float]]:
    """Chain over changepoints and heights of a decaying rate with exponential upward jumps; kept states
    (iteration, positions, heights, log posterior)."""
    part, a, rate, _ = _jump_terms(t, start, 0.0, end, None, alpha, kappa)
    first = rng.gamma(a) / rate
    post = part(first) + math.log(alpha) + kappa * (bisect_left(t, end) - bisect_left(t, start)) * start
    kept: list = []
    shot_noise_moves(t, [start], [first], start, end, cfg, alpha, kappa, rng, cfg.burn_in + cfg.iterations, kept, post, counts)
    return kept


def _window_loglik(t: list[float], tau: list[float], end: float, e: np.ndarray, c: np.ndarray, first: np.ndarray, kappa: float) -> np.ndarray:
    """Log likelihood of a window's events for many heights at its beginning: the height at tau[i] is first * e[i] + c[i]."""
    out = np.zeros_like(first)
    for i, a in enumerate(tau):
        b = tau[i + 1] if i + 1 < len(tau) else end
        r, h = bisect_left(t, b) - bisect_left(t, a), first * e[i] + c[i]
        out += h / kappa * math.expm1(-kappa * (b - a)) + (r * np.log(h) if r else 0.0)
    return out


def shot_noise_window(t: list[float], past: list[tuple[list[float], list[float]]], log_w: np.ndarray, i: int, a: float, b: float, n: int, cfg: SamplerConfig, alpha: float, kappa: float, rng: np.random.Generator, threshold: float, moves: int) -> tuple[list[tuple[list[float], list[float]]], np.ndarray, bool]:
    """One window of sequential Monte Carlo for shot noise: particles (positions, heights), log weights, and whether they were resampled.

    A window's sample has a height of its own at the window's beginning. In the joined particle the past's rate goes on
    there, and what its heights differ by decays from there on, so that the window's jumps stay. The weight is the
    likelihood of the window with the past's rate over that with the window's own, integrated over its height."""
    window = SamplerConfig(**{**cfg.__dict__, "iterations": n * cfg.thinning, "move_width": cfg.move_width or (b - a) / 3})
    fresh = [([a, *theta], heights) for _, theta, heights, _ in run_shot_noise(t, a, b, window, alpha, kappa, rng)]
    if not i:
        return fresh, np.zeros(n), False
    order, out, log_w = rng.permutation(n), [], log_w.copy()
    r = bisect_left(t, b) - bisect_left(t, a)
    scale = (r + 1) / (alpha - math.expm1(-kappa * (b - a)) / kappa)
    grid = np.linspace(math.log(scale * 1e-6), math.log(scale * (1 + 12 / math.sqrt(r + 1))), 160)
    first = np.exp(grid)
    prior = math.log(alpha) - alpha * first + grid + math.log(grid[1] - grid[0])
    for p in range(n):
        (old_tau, old), (tau, heights) = past[p], fresh[order[p]]
        e = np.exp(-kappa * (np.array(tau) - a))
        c = np.maximum(np.array(heights) - heights[0] * e, 0.0)
        goes_on = old[-1] * math.exp(-kappa * (a - old_tau[-1]))
        value = _window_loglik(t, tau, b, e, c, first, kappa) + prior
        top = value.max()
        log_w[p] += float(_window_loglik(t, tau, b, e, c, np.array([goes_on]), kappa)[0]) - top - math.log(np.exp(value - top).sum())
        out.append((old_tau + tau[1:], old + (goes_on * e + c)[1:].tolist()))
    w = np.exp(log_w - log_w.max())
    if w.sum() ** 2 / (w * w).sum() >= threshold * n:
        return out, log_w, False
    lo, steps = max(out[0][0][0], b - 2 * (b - a)), SamplerConfig(**{**cfg.__dict__, "move_width": cfg.move_width or (b - a) / 3})
    again = [out[p] for p in np.repeat(np.arange(n), systematic_counts(w, n, rng.random()))]
    return [shot_noise_moves(t, *x, lo, b, steps, alpha, kappa, rng, moves)[:2] for x in again], np.zeros(n), True


@dataclass
class SeenModel(PoissonModel):
    """Events from some time on, and how many there were before: segments begin with the data or after that time."""

    before: int = 0
    begin: float = 0.0

    def index(self, x: float) -> int:
        return self.before + bisect_left(self.t, x) if x > self.begin else 0


def smc_window(model, past: list[list[float]], log_w: np.ndarray, i: int, a: float, b: float, begin: float, n: int, cfg: SamplerConfig, rng: np.random.Generator, threshold: float, moves: int, look_back: bool = True, fresh: list[list[float]] | None = None, source: str = "chain") -> tuple[list[list[float]], np.ndarray, bool]:
    """One window of sequential Monte Carlo: particles, log weights, and whether they were resampled.

    source: what the window's sample is drawn by: a chain; "rejection", exact draws with one changepoint at most; or "prior",
    whose draws take the window's whole likelihood as weight.

    begin: where the data begin; changepoints before it come from the prior alone. fresh: the window's sample, if it was drawn before."""
    ll, width = model.loglik, b - a
    since = lambda x: max(x, begin)
    if len(past) != n:
        w = np.exp(log_w - log_w.max())
        past = [past[p] for p in np.repeat(np.arange(len(past)), systematic_counts(w, n, rng.random()))]
        log_w = np.zeros(n)
    past, log_w, first_from = list(past), log_w.copy(), a
    if source == "prior" and fresh is None:
        k = rng.poisson(cfg.nu * (b - a), n)
        fresh = [np.sort(x).tolist() for x in np.split(a + rng.random(k.sum()) * (b - a), np.cumsum(k)[:-1])]
    elif source == "rejection" and fresh is None:
        fresh = rejection(model, a, b, cfg.nu, n, rng)[0]
    if a > begin and look_back and fresh is None:
        w = np.exp(log_w - log_w.max())
        first_from = max(begin, a - float((w * [a - since(x[-1] if x else begin) for x in past]).sum() / w.sum()))
    if fresh is None:
        window = SamplerConfig(**{**cfg.__dict__, "iterations": n * cfg.thinning, "move_width": cfg.move_width or width / 3})
        fresh = [theta for _, theta, _ in run_chain(model, a, b, window, rng, data_start=first_from)[0]]
    order = rng.permutation(n)
    for p in range(n):
        new, old = fresh[order[p]], past[p]
        last, first = since(old[-1] if old else begin), (new[0] if new else b)
        if a > begin:
            log_w[p] += ll(last, first) - ll(last, a) - ll(first_from, first)
        if source == "prior":
            log_w[p] += sum(ll(x, y) for x, y in zip([first_from, *new], [*new, b], strict=True))
        if cfg.spacing and old and new:
            # Joined changepoints that are too close have no weight; others make up for the prior's gap.
            log_w[p] += -np.inf if first - old[-1] < cfg.spacing else 0.0
        past[p] = old + new
    if np.isneginf(log_w).all():
        log_w = np.zeros(n)
    w = np.exp(log_w - log_w.max())
    if w.sum() ** 2 / (w * w).sum() >= threshold * n:
        return past, log_w, False
    times = systematic_counts(w, n, rng.random())
    steps = SamplerConfig(**{**cfg.__dict__, "iterations": moves, "burn_in": 0, "thinning": moves, "move_width": cfg.move_width or width / 3})
    # Moves stay in the last two windows, so that they cost the same in each window.
    lo, out = begin if cfg.spacing else moves_from(begin, a, b), []
    # Each particle has numbers of its own, so that particles can move side by side.
    plain = cfg.proposal == "uniform" and not cfg.discrete
    numbers = rng.random((n, MOST_DRAWS * moves)) if plain else [None] * n
    for p, own in zip(np.repeat(np.arange(n), times), numbers, strict=True):
        fixed = [x for x in past[p] if x <= lo]
        near = past[p][len(fixed) :]
        out.append(fixed + (run_chain(model, lo, b, steps, Numbers(own) if plain else rng, data_start=since(fixed[-1] if fixed else begin), theta=near)[0][-1][1] if moves else near))
    return out, np.zeros(n), True


#: How many numbers a chain's step takes at most, with uniform births.
MOST_DRAWS = 4


class Numbers:
    """Numbers drawn before, in place of a generator."""

    def __init__(self, numbers: np.ndarray):
        self.random = iter(numbers.tolist()).__next__


def moves_from(begin: float, a: float, b: float) -> float:
    """From here on changepoints may still move at the end of the window [a, b)."""
    return max(begin, b - 2 * (b - a))
