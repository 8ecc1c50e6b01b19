"""Shot noise of many series in step: the kernels' shot_noise_moves and shot_noise_window in arrays, one row for each chain.

Chains follow the same laws as the kernels' with numbers of their own: each has a SplitMix64 stream, whose beginning
depends on the seed, the series and the window alone, so that rows are the same beside any other series.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np

from tidemark.functions.special import log_gamma_ps, log_gammas
from tidemark.operators.kernels import SamplerConfig, systematic_counts
from tidemark.operators.lockstep import PoissonRows

#: Heights of a window's beginning that the weights are integrated over.
GRID = 160
#: Entries by heights that are summed at once.
AT_ONCE = 4000


class Streams:
    """Uniform numbers of many chains, as many as each asks for."""

    def __init__(self, keys: np.ndarray):
        self.state = keys.astype(np.uint64)

    def next(self, rows: np.ndarray) -> np.ndarray:
        z = self.state[rows] + np.uint64(0x9E3779B97F4A7C15)
        self.state[rows] = z
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53


def truncated_gammas(a: np.ndarray, rate: np.ndarray, upper: np.ndarray, rows: np.ndarray, draws: Streams) -> np.ndarray:
    """A draw of each Gamma distribution (shape 1 or more) below upper.

    By rejection: where upper is beyond the mean, of Marsaglia's and Tsang's draws of the whole distribution; else of a
    power of a uniform number whose density falls off, below upper, about as fast."""
    top, out, left = rate * upper, np.empty(len(a)), np.arange(len(a))
    d = a - 1 / 3
    s = np.maximum(a - np.minimum(top, a), np.sqrt(a))
    best = np.minimum(top, np.maximum(a - s, 1e-300))
    while len(left):
        whole = top[left] >= a[left]
        r, q = left[whole], left[~whole]
        u, v, w = (draws.next(rows[r]) for _ in range(3))
        z = np.sqrt(-2 * np.log1p(-u)) * np.cos(2 * math.pi * v)
        c = 1 + z / np.sqrt(9 * d[r])
        cube = np.where(c > 0, c, 1.0) ** 3
        x = d[r] * cube
        good = (c > 0) & (np.log1p(-w) < z * z / 2 + d[r] * (1 - cube + np.log(cube))) & (x < top[r]) & (x > 0)
        out[r[good]] = x[good]
        u, v = (draws.next(rows[q]) for _ in range(2))
        y = top[q] * (1 - u) ** (1 / s[q])
        fine = (np.log1p(-v) < (a[q] - s[q]) * np.log(y / best[q]) - (y - best[q])) & (y < top[q]) & (y > 0)
        out[q[fine]] = y[fine]
        left = np.concatenate([r[~good], q[~fine]])
    return np.minimum(out / rate, upper * (1 - 1e-15))


class Shots:
    """States of many chains: ``at`` has where a chain's rate begins, its changepoints and its end; ``h`` the heights there, ``index``
    the model's index of each, k the number of changepoints. Changepoints beyond lo may change.

    rows: the model's row of each chain."""

    def __init__(self, model: PoissonRows, rows: np.ndarray, at: np.ndarray, h: np.ndarray, k: np.ndarray, lo: np.ndarray, end: np.ndarray, cfg: SamplerConfig, width: float, alpha: float, kappa: float, draws: Streams):
        self.model, self.rows, self.lo, self.end, self.nu, self.width, self.alpha, self.kappa, self.draws = model, rows, lo, end, cfg.nu, width, alpha, kappa, draws
        room = ((0, 0), (0, 8))
        self.at, self.h, self.k = np.pad(at, room, constant_values=np.inf), np.pad(h, room), k.astype(np.int64)
        self.first = np.maximum(1, (at <= lo[:, None]).sum(axis=1))
        self.at[np.arange(len(k)), self.k + 1] = end
        self.index = np.zeros(self.at.shape, np.int64)
        for j in range(int(self.k.max(initial=0)) + 2):
            r = np.flatnonzero(self.k + 1 >= j)
            self.index[r, j] = model.index(rows[r], self.at[r, j])

    def step(self) -> None:
        if int(self.k.max(initial=0)) + 3 >= self.at.shape[1]:
            room = ((0, 0), (0, self.at.shape[1]))
            self.at, self.h, self.index = np.pad(self.at, room, constant_values=np.inf), np.pad(self.h, room), np.pad(self.index, room)
        x = self.draws.next(np.arange(len(self.k)))
        some = self.k + 1 > self.first
        self._birth(np.flatnonzero(x < 0.25))
        self._death(np.flatnonzero((0.25 <= x) & (x < 0.5) & some))
        self._move(np.flatnonzero((0.5 <= x) & (x < 0.75) & some))
        own = (self.lo <= self.at[:, 0]).astype(np.int64)
        r = np.flatnonzero((x >= 0.75) & (some | (own > 0)))
        self._height(r, own[r], x[r] < 0.875)

    def _terms(self, r: np.ndarray, y: np.ndarray, h: np.ndarray, i: np.ndarray, iy: np.ndarray) -> tuple[Callable[[np.ndarray], np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """kernels._jump_terms for a jump at y, whose index is iy, before the i-th position."""
        after = np.where(i <= self.k[r], self.h[r, i], np.inf)
        length, more = self.at[r, i] - y, np.isfinite(after)
        mass, left = -np.expm1(-self.kappa * length) / self.kappa, np.exp(-self.kappa * length)
        n = self.index[r, i] - iy
        rate = self.alpha + mass - np.where(more, self.alpha * left, 0.0)
        return lambda j: n * np.log(np.where(n > 0, h + j, 1.0)) - rate * j, np.maximum(1.0, n + 1 - h * rate), rate, after / left - h

    def _decayed(self, r: np.ndarray, i: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The rate at y, on from the i-th height."""
        return self.h[r, i] * np.exp(-self.kappa * (y - self.at[r, i]))

    def _taken(self, r: np.ndarray, ratio: np.ndarray) -> np.ndarray:
        return self.draws.next(r) < np.exp(np.minimum(ratio, 0.0))

    def _shift(self, r: np.ndarray, source: np.ndarray) -> None:
        for x in (self.at, self.h, self.index):
            x[r] = x[r[:, None], source]

    @staticmethod
    def _density(x: np.ndarray, a: np.ndarray, rate: np.ndarray, upper: np.ndarray) -> np.ndarray:
        return a * np.log(rate) - log_gammas(a) + (a - 1) * np.log(x) - rate * x - log_gamma_ps(a, rate * upper)

    def _birth(self, r: np.ndarray) -> None:
        y = self.lo[r] + self.draws.next(r) * (self.end[r] - self.lo[r])
        i = (self.at[r] < y[:, None]).sum(axis=1)
        h = self._decayed(r, i - 1, y)
        iy = self.model.index(self.rows[r], y)
        part, a, rate, upper = self._terms(r, y, h, i, iy)
        ok = np.flatnonzero((h > 0) & (upper > 0) & (y < self.end[r]) & (i >= self.first[r]))
        j = np.zeros(len(r))
        j[ok] = truncated_gammas(a[ok], rate[ok], upper[ok], r[ok], self.draws)
        ok = ok[j[ok] > 0]
        ratio = (part(j) - part(np.zeros(len(r))))[ok] + np.log(self.alpha * self.nu * (self.end[r] - self.lo[r]) / (self.k[r] + 2 - self.first[r]))[ok] - self._density(j[ok], a[ok], rate[ok], upper[ok])
        ok = ok[self._taken(r[ok], ratio)]
        r, i, columns = r[ok], i[ok], np.arange(self.at.shape[1])
        self._shift(r, columns - (columns > i[:, None]))
        self.at[r, i], self.h[r, i], self.index[r, i] = y[ok], h[ok] + j[ok], iy[ok]
        self.k[r] += 1

    def _death(self, r: np.ndarray) -> None:
        free = self.k[r] + 1 - self.first[r]
        i = self.first[r] + (self.draws.next(r) * free).astype(np.int64)
        y = self.at[r, i]
        h = self._decayed(r, i - 1, y)
        part, a, rate, upper = self._terms(r, y, h, i + 1, self.index[r, i])
        j = self.h[r, i] - h
        ok = np.flatnonzero((j > 0) & (h > 0) & (upper > 0))
        ratio = (part(np.zeros(len(r))) - part(j))[ok] - np.log(self.alpha * self.nu * (self.end[r] - self.lo[r]) / free)[ok] + self._density(j[ok], a[ok], rate[ok], upper[ok])
        ok = ok[self._taken(r[ok], ratio)]
        r, i, columns = r[ok], i[ok], np.arange(self.at.shape[1])
        self._shift(r, np.minimum(columns + (columns >= i[:, None]), len(columns) - 1))
        self.k[r] -= 1

    def _loglik(self, a: np.ndarray, b: np.ndarray, n: np.ndarray, h: np.ndarray) -> np.ndarray:
        return h / self.kappa * np.expm1(-self.kappa * (b - a)) + n * (np.log(h) + self.kappa * a)

    def _move(self, r: np.ndarray) -> None:
        i = self.first[r] + (self.draws.next(r) * (self.k[r] + 1 - self.first[r])).astype(np.int64)
        y = self.at[r, i] + (2 * self.draws.next(r) - 1) * self.width
        ok = (np.maximum(self.lo[r], self.at[r, i - 1]) < y) & (y < self.at[r, i + 1])
        r, i, y = r[ok], i[ok], y[ok]
        was, now, before, nxt = self.at[r, i], self.h[r, i], self.at[r, i - 1], self.at[r, i + 1]
        top = self._decayed(r, i - 1, y) + now - self._decayed(r, i - 1, was)
        falls, after = top * np.exp(-self.kappa * (nxt - y)), np.where(i < self.k[r], self.h[r, i + 1], np.inf)
        first, own, last, iy = self.index[r, i - 1], self.index[r, i], self.index[r, i + 1], self.model.index(self.rows[r], y)
        change = np.where(np.isfinite(after), self.alpha * (falls - now * np.exp(-self.kappa * (nxt - was))), 0.0)
        change += self._loglik(before, y, iy - first, self.h[r, i - 1]) + self._loglik(y, nxt, last - iy, top) - self._loglik(before, was, own - first, self.h[r, i - 1]) - self._loglik(was, nxt, last - own, now)
        good = (after > falls) & self._taken(r, change)
        r, i = r[good], i[good]
        self.at[r, i], self.h[r, i], self.index[r, i] = y[good], top[good], iy[good]

    def _height(self, r: np.ndarray, own: np.ndarray, drawn: np.ndarray) -> None:
        i = (self.draws.next(r) * (self.k[r] + 1 - self.first[r] + own)).astype(np.int64)
        i = np.where(own > 0, np.where(i > 0, i - 1 + self.first[r], 0), i + self.first[r])
        h = np.where(i > 0, self._decayed(r, np.maximum(i - 1, 0), self.at[r, i]), 0.0)
        part, a, rate, upper = self._terms(r, self.at[r, i], h, i + 1, self.index[r, i])
        j, new, ratio = self.h[r, i] - h, np.zeros(len(r)), np.full(len(r), -np.inf)
        q = np.flatnonzero(drawn & (j > 0) & (upper > 0))
        new[q] = truncated_gammas(a[q], rate[q], upper[q], r[q], self.draws)
        q = q[new[q] > 0]
        # The law's own factors cancel.
        ratio[q] = (a[q] - 1) * np.log(j[q] / new[q]) - rate[q] * (j[q] - new[q])
        q = np.flatnonzero(~drawn)
        ratio[q] = self.draws.next(r[q]) - 0.5
        new[q] = j[q] * np.exp(ratio[q])
        ok = np.flatnonzero((new > 0) & (new < upper))
        ratio = (part(np.where(new > 0, new, 1.0)) - part(np.maximum(j, 1e-300)))[ok] + ratio[ok]
        ok = ok[self._taken(r[ok], ratio)]
        self.h[r[ok], i[ok]] = h[ok] + new[ok]


def _weights(model: PoissonRows, at: np.ndarray, h: np.ndarray, k: np.ndarray, goes_on: np.ndarray, b: float, alpha: float, kappa: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log weights of particles whose past's rate goes on in a window's sample; and e and c: the height at a changepoint is e times that at the window's beginning, and c."""
    (m, n, most), a = at.shape, at[0, 0, 0]
    inside = np.arange(most) <= k[:, :, None]
    nxt = np.concatenate([at[:, :, 1:], np.full((m, n, 1), b)], axis=2)
    nxt = np.where(np.arange(most) < k[:, :, None], nxt, b)
    e = np.where(inside, np.exp(-kappa * (np.where(inside, at, a) - a)), 0.0)
    c = np.where(inside, np.maximum(h - h[:, :, :1] * e, 0.0), 0.0)
    s, p, q = np.nonzero(inside)
    left, right = at[s, p, q], nxt[s, p, q]
    r, falls = model.index(s, right) - model.index(s, left), np.expm1(-kappa * (right - left)) / kappa
    seen = model.index(np.arange(m), np.full(m, b)) - model.index(np.arange(m), np.full(m, a))
    scale = (seen + 1) / (alpha - math.expm1(-kappa * (b - a)) / kappa)
    grid = np.linspace(np.log(scale * 1e-6), np.log(scale * (1 + 12 / np.sqrt(seen + 1))), GRID, axis=1)
    first = np.exp(grid)
    prior = math.log(alpha) - alpha * first + grid + np.log(grid[:, 1] - grid[:, 0])[:, None]
    own, ee, cc = goes_on[s, p], e[s, p, q], c[s, p, q]
    begins = np.flatnonzero(q == 0)
    taken = np.add.reduceat((own * ee + cc) * falls + r * np.log(own * ee + cc), begins).reshape(m, n)
    out, each = np.empty((m, n)), max(1, AT_ONCE * m // len(s))
    cuts = np.append(begins[::n], len(s))
    for x in range(0, m, each):
        y = min(m, x + each)
        z = slice(cuts[x], cuts[y])
        height = first[s[z]] * ee[z, None] + cc[z, None]
        value = np.add.reduceat(height * falls[z, None] + r[z, None] * np.log(height), begins[x * n : y * n] - cuts[x], axis=0).reshape(y - x, n, GRID) + prior[x:y, None]
        top = value.max(axis=2)
        out[x:y] = top + np.log(np.exp(value - top[:, :, None]).sum(axis=2))
    return taken - out, e, c


def shot_windows(model: PoissonRows, start: float, width: float, intervals: int, n: int, cfg: SamplerConfig, alpha: float, kappa: float, rng: Callable[[int, int], np.random.Generator], threshold: float, moves: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """kernels.shot_noise_window for many series side by side, window after window: its number, positions (series by particles; the first is start), heights,
    numbers of changepoints, log weights, and which series were resampled. rng: begins the numbers of a series and window."""
    m, wide = len(model.first) - 1, cfg.move_width or width / 3
    past = heights = k = log_w = None
    for i in range(intervals):
        a, b = start + i * width, start + (i + 1) * width
        rngs, rows = [rng(s, i) for s in range(m)], np.arange(m)
        r = model.index(rows, np.full(m, b)) - model.index(rows, np.full(m, a))
        h = np.array([g.gamma(x + 1) for g, x in zip(rngs, r.tolist(), strict=True)]) / (alpha - math.expm1(-kappa * width) / kappa)
        now = Shots(model, rows, np.full((m, 1), a), h[:, None], np.zeros(m), np.full(m, a), np.full(m, b), cfg, wide, alpha, kappa, Streams(np.array([g.integers(2**64, dtype=np.uint64) for g in rngs])))
        kept = []
        for step in range(1, cfg.burn_in + n * cfg.thinning + 1):
            now.step()
            if step > cfg.burn_in and (step - cfg.burn_in) % cfg.thinning == 0:
                most = int(now.k.max()) + 1
                kept.append((now.at[:, :most].copy(), now.h[:, :most].copy(), now.k.copy()))
        fresh_k = np.stack([x for *_, x in kept], axis=1)
        most = int(fresh_k.max()) + 1
        fresh, fresh_h = np.full((m, n, most), np.inf), np.zeros((m, n, most))
        for p, (at, own, _) in enumerate(kept):
            fresh[:, p, : at.shape[1]], fresh_h[:, p, : at.shape[1]] = at, own
        inside = np.arange(most) <= fresh_k[:, :, None]
        fresh, fresh_h, again = np.where(inside, fresh, np.inf), np.where(inside, fresh_h, 0.0), np.zeros(m, bool)
        if past is None:
            past, heights, k, log_w = fresh, fresh_h, fresh_k, np.zeros((m, n))
            yield i, past, heights, k, log_w, again
            continue
        order = np.stack([g.permutation(n) for g in rngs])
        fresh, fresh_h, fresh_k = np.take_along_axis(fresh, order[:, :, None], 1), np.take_along_axis(fresh_h, order[:, :, None], 1), np.take_along_axis(fresh_k, order, 1)
        last, last_h = (np.take_along_axis(x, k[:, :, None], 2)[:, :, 0] for x in (past, heights))
        goes_on = last_h * np.exp(-kappa * (a - last))
        more, e, c = _weights(model, fresh, fresh_h, fresh_k, goes_on, b, alpha, kappa)
        log_w = log_w + more
        # Sorted, a window's changepoints follow those of the past.
        past = np.concatenate([past, fresh[:, :, 1:]], axis=2)
        heights = np.concatenate([heights, (goes_on[:, :, None] * e + c)[:, :, 1:]], axis=2)
        k, by = k + fresh_k, np.argsort(past, axis=2, kind="stable")
        most = int(k.max()) + 1
        past, heights = (np.take_along_axis(x, by, 2)[:, :, :most] for x in (past, heights))
        w = np.exp(log_w - log_w.max(axis=1, keepdims=True))
        again = ~(w.sum(axis=1) ** 2 / (w * w).sum(axis=1) >= threshold * n)
        s = np.flatnonzero(again)
        if len(s):
            parent = np.stack([np.repeat(np.arange(n), systematic_counts(w[x], n, rngs[x].random())) for x in s])
            at, own = (np.take_along_axis(x[s], parent[:, :, None], 1).reshape(len(s) * n, -1) for x in (past, heights))
            keys = np.concatenate([rngs[x].integers(2**64, size=n, dtype=np.uint64) for x in s])
            now = Shots(model, np.repeat(s, n), at, own, np.take_along_axis(k[s], parent, 1).ravel(), np.full(len(at), max(start, b - 2 * width)), np.full(len(at), b), cfg, wide, alpha, kappa, Streams(keys))
            for _ in range(moves):
                now.step()
            most = max(most, int(now.k.max()) + 1)
            room = ((0, 0), (0, 0), (0, most - past.shape[2]))
            past, heights, k, log_w = np.pad(past, room, constant_values=np.inf), np.pad(heights, room), k.copy(), log_w.copy()
            inside = np.arange(most) <= now.k[:, None]
            at, own = (np.pad(x, ((0, 0), (0, max(0, most - x.shape[1]))))[:, :most] for x in (now.at, now.h))
            past[s], heights[s] = np.where(inside, at, np.inf).reshape(len(s), n, most), np.where(inside, own, 0.0).reshape(len(s), n, most)
            k[s], log_w[s] = now.k.reshape(len(s), n), 0.0
        yield i, past, heights, k, log_w, again
