"""Reversible-jump chains of many series in step: the kernels' run_chain in arrays, one row for each chain.

A chain takes the same draws of its own generator, in the same order, as run_chain does, so a chain's states don't depend on
which others it runs beside. Chains have uniform births and neither spacing nor a limit on changepoints.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np

from tidemark.operators.kernels import MOST_DRAWS, PoissonModel, SamplerConfig, moves_from, rejection, systematic_counts

#: Steps between refills of the drawn numbers, and how many a step takes at most.
STEPS, DRAWS = 128, MOST_DRAWS


def plain(cfg: SamplerConfig) -> bool:
    """Whether run_chains has what the options ask for."""
    return cfg.proposal == "uniform" and not (cfg.discrete or cfg.spacing or cfg.random_nu or cfg.hill_climbing or cfg.no_empty_neighbours) and cfg.max_changepoints is None


class PoissonRows:
    """PoissonModel for many series: events of row i are t[first[i] : first[i + 1]], ascending."""

    def __init__(self, times: list[np.ndarray], alpha: float, beta: float, more: int = 0):
        """more: how many events a segment may have beyond those of t."""
        sizes = np.array([len(x) for x in times])
        self.t = np.concatenate([*times, [np.inf]]) if len(times) else np.array([np.inf])
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.halvings = int(sizes.max(initial=0)).bit_length()
        self.alpha, self.beta = alpha, beta
        self.log_fact = np.array([math.lgamma(alpha + n) - math.lgamma(alpha) for n in range(int(sizes.max(initial=0)) + more + 1)]) + alpha * math.log(beta)

    def index(self, rows: np.ndarray, x: np.ndarray) -> np.ndarray:
        lo, hi = self.first[rows], self.first[rows + 1]
        begin = lo
        for _ in range(self.halvings):
            mid = (lo + hi) >> 1
            below = (self.t[mid] < x) & (mid < hi)
            lo, hi = np.where(below, mid + 1, lo), np.where(below, hi, mid)
        return lo - begin

    def loglik(self, rows: np.ndarray, a: np.ndarray, ia: np.ndarray, b: np.ndarray, ib: np.ndarray) -> np.ndarray:
        n, length = ib - ia, b - a
        return np.where(length > 0, self.log_fact[n] - (self.alpha + n) * np.log(self.beta + np.maximum(length, 0.0)), 0.0)

    def mean(self, rows: np.ndarray, a: np.ndarray, ia: np.ndarray, b: np.ndarray, ib: np.ndarray) -> np.ndarray:
        return (self.alpha + ib - ia) / (self.beta + (b - a))


class SeenRows(PoissonRows):
    """SeenModel for many series: events from some time on, and how many each had ``before``; positions up to ``begin`` stand before all."""

    def __init__(self, times: list[np.ndarray], alpha: float, beta: float, begin: np.ndarray, before: np.ndarray):
        super().__init__(times, alpha, beta, int(before.max(initial=0)))
        self.begin, self.before = begin, before

    def index(self, rows: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.where(x > self.begin[rows], super().index(rows, x) + self.before[rows], 0)

    def gone(self, past: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """How many of its events no later segment of a series' particles can begin before, if changepoints may move after lo."""
        last = np.where(past <= lo[:, None, None], past, -np.inf).max(axis=2, initial=-np.inf)
        cut = np.where(last > self.begin[:, None], last, np.inf).min(axis=1)
        return super().index(np.arange(len(past)), np.where(np.isinf(cut), lo, cut))


class GaussianRows:
    """GaussianModel for many series."""

    def __init__(self, values: list[np.ndarray], alpha: float, gamma: float, v: float):
        self.sizes = np.array([len(x) for x in values])
        self.first = np.concatenate([[0], np.cumsum(self.sizes + 1)])
        self.s = np.concatenate([np.concatenate([[0.0], np.cumsum(y)]) for y in values])
        self.ss = np.concatenate([np.concatenate([[0.0], np.cumsum(np.square(y))]) for y in values])
        self.gamma, self.v, most = gamma, v, int(self.sizes.max(initial=0))
        self.shape = np.arange(most + 1) / 2 + alpha
        own = -0.5 * math.log(v) + alpha * math.log(gamma) - math.lgamma(alpha)
        self.known = np.array([own - 0.5 * math.log(1 / v + n) - n / 2 * math.log(math.pi) + math.lgamma(n / 2 + alpha) for n in range(most + 1)])

    def index(self, rows: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.minimum(np.maximum(np.ceil(x), 0), self.sizes[rows]).astype(np.int64)

    def loglik(self, rows: np.ndarray, a: np.ndarray, ia: np.ndarray, b: np.ndarray, ib: np.ndarray) -> np.ndarray:
        n, first = np.maximum(ib - ia, 0), self.first[rows]
        s, ss = self.s[first + ib] - self.s[first + ia], self.ss[first + ib] - self.ss[first + ia]
        rest = self.gamma + 0.5 * (ss - s * s / (1 / self.v + n))
        return np.where(n > 0, self.known[n] - self.shape[n] * np.log(np.where(n > 0, rest, 1.0)), 0.0)

    def mean(self, rows: np.ndarray, a: np.ndarray, ia: np.ndarray, b: np.ndarray, ib: np.ndarray) -> np.ndarray:
        first = self.first[rows]
        return np.where(ib > ia, (self.s[first + ib] - self.s[first + ia]) / (1 / self.v + (ib - ia)), 0.0)


class Draws:
    """Numbers of many generators, each in its own order."""

    def __init__(self, rngs: list[np.random.Generator], steps: int, given: np.ndarray | None = None):
        """given: each chain's numbers, if they were drawn before."""
        if given is not None:
            self.u, self.left, rngs = given, given.shape[1] // DRAWS, [None] * len(given)
            self.flat, self.base = self.u.reshape(-1), np.arange(len(rngs)) * self.u.shape[1]
            self.at, self.before = np.zeros(len(rngs), np.int64), np.zeros(len(rngs), np.int64)
            return
        self.rngs, self.each = rngs, min(STEPS, max(steps, 1))
        self.u = np.empty((len(rngs), self.each * DRAWS))
        self.flat, self.base = self.u.reshape(-1), np.arange(len(rngs)) * self.u.shape[1]
        self.at, self.before, self.left = np.zeros(len(rngs), np.int64), np.zeros(len(rngs), np.int64), self.each
        for row, rng in zip(self.u, rngs, strict=True):
            rng.random(out=row)

    def step(self, active: int) -> None:
        """Before each step of the first ``active`` chains: sees to it that each has enough numbers."""
        if not self.left:
            width = self.u.shape[1]
            for row, rng, at in zip(self.u[:active], self.rngs[:active], self.at[:active].tolist(), strict=True):
                row[: width - at] = row[at:].copy()
                rng.random(out=row[width - at :])
            self.before[:active] += self.at[:active]
            self.at[:active], self.left = 0, self.each
        self.left -= 1

    def next(self, rows: np.ndarray) -> np.ndarray:
        at = self.at[rows]
        self.at[rows] = at + 1
        return self.flat[self.base[rows] + at]

    def taken(self) -> np.ndarray:
        """How many numbers each chain has used."""
        return self.before + self.at


class Chains:
    """States of many chains: ``at`` has where a chain's first segment begins, its changepoints and its end; ``index`` the model's
    index of each, ``part`` the log likelihood of the segment from each to the next, k the number of changepoints.

    rows: the model's row of each chain. theta: its first changepoints, a row for each chain, and how many they are. begin: where first segments begin, if before start."""

    def __init__(self, model, rows: np.ndarray, start: np.ndarray, end: np.ndarray, cfg: SamplerConfig, draws: Draws, theta: tuple[np.ndarray, np.ndarray] | None = None, begin: np.ndarray | None = None):
        self.model, self.rows, self.start, self.end, self.cfg, self.draws = model, rows, start, end, cfg, draws
        self.k = np.zeros(len(rows), np.int64) if theta is None else theta[1].astype(np.int64)
        most = int(self.k.max(initial=0))
        self.at = np.full((len(rows), most + 8), np.inf)
        self.at[:, 0] = start if begin is None else begin
        if theta is not None:
            self.at[:, 1 : most + 1] = np.where(np.arange(most) < self.k[:, None], theta[0][:, :most], np.inf)
        every = np.arange(len(rows))
        self.at[every, self.k + 1] = end
        self.index, self.part = np.zeros(self.at.shape, np.int64), np.zeros(self.at.shape)
        self._base = every * self.at.shape[1]
        for j in range(most + 2):
            r = np.flatnonzero(self.k + 1 >= j)
            self.index[r, j] = model.index(rows[r], self.at[r, j])
        for j in range(most + 1):
            r = np.flatnonzero(self.k >= j)
            self.part[r, j] = model.loglik(rows[r], self.at[r, j], self.index[r, j], self.at[r, j + 1], self.index[r, j + 1])
        self.post = np.zeros(len(rows))
        for j in range(most + 1):
            self.post += np.where(self.k >= j, self.part[:, j], 0.0)
        self.post += self.k * math.log(cfg.nu) - cfg.nu * (end - start)
        self.width = np.broadcast_to(cfg.move_width, start.shape) if cfg.move_width else (end - start) / 20
        self.log_length = np.log(end - start)
        self.log_k = np.log(np.maximum(np.arange(self.at.shape[1] + 1), 1))

    def _room(self) -> None:
        if int(self.k.max(initial=0)) + 3 < self.at.shape[1]:
            return
        more = self.at.shape[1]
        self.at = np.pad(self.at, ((0, 0), (0, more)), constant_values=np.inf)
        self.index, self.part = (np.pad(x, ((0, 0), (0, more))) for x in (self.index, self.part))
        self._base = np.arange(len(self.k)) * self.at.shape[1]
        self.log_k = np.log(np.maximum(np.arange(self.at.shape[1] + 1), 1))

    def _shift(self, r: np.ndarray, source: np.ndarray) -> None:
        for x in (self.at, self.index, self.part):
            x[r] = x[r[:, None], source]

    def _accepted(self, r: np.ndarray, ratio: np.ndarray) -> np.ndarray:
        out = np.flatnonzero(ratio < 0)
        taken = np.ones(len(r), bool)
        taken[out] = self.draws.next(r[out]) < np.exp(ratio[out])
        return np.flatnonzero(taken)

    def step(self, active: int) -> None:
        """One step of each of the first ``active`` chains."""
        self._room()
        self.draws.step(active)
        x, k = self.draws.next(np.arange(active)), self.k[:active]
        birth = (k == 0) | (x < 1 / 3)
        death = ~birth & (x < 2 / 3)
        self._birth(np.flatnonzero(birth))
        self._death(np.flatnonzero(death))
        self._move(np.flatnonzero(~birth & ~death))

    def _birth(self, r: np.ndarray) -> None:
        if not len(r):
            return
        at, index, part, ll, rows = self.at.reshape(-1), self.index.reshape(-1), self.part.reshape(-1), self.model.loglik, self.rows[r]
        k, start = self.k[r], self.start[r]
        y = start + self.draws.next(r) * (self.end[r] - start)
        i = (self.at[r, 1 : int(k.max()) + 1] < y[:, None]).sum(axis=1)
        f = self._base[r] + i
        iy = self.model.index(rows, y)
        left, right = ll(rows, at[f], index[f], y, iy), ll(rows, y, iy, at[f + 1], index[f + 1])
        change = left + right - part[f] + math.log(self.cfg.nu)
        a = self._accepted(r, change + self.log_length[r] - self.log_k[k + 1] + np.where(k == 0, -math.log(3), 0.0))
        if len(a):
            r, i = r[a], i[a]
            columns = np.arange(self.at.shape[1])
            self._shift(r, columns - (columns > i[:, None]))
            self.at[r, i + 1], self.index[r, i + 1], self.part[r, i], self.part[r, i + 1] = y[a], iy[a], left[a], right[a]
            self.k[r] += 1
            self.post[r] += change[a]

    def _death(self, r: np.ndarray) -> None:
        if not len(r):
            return
        at, index, part, rows, k = self.at.reshape(-1), self.index.reshape(-1), self.part.reshape(-1), self.rows[r], self.k[r]
        i = (self.draws.next(r) * k).astype(np.int64)
        f = self._base[r] + i + 1
        both = self.model.loglik(rows, at[f - 1], index[f - 1], at[f + 1], index[f + 1])
        change = both - part[f - 1] - part[f] - math.log(self.cfg.nu)
        a = self._accepted(r, change - self.log_length[r] + self.log_k[k] - np.where(k == 1, -math.log(3), 0.0))
        if len(a):
            r, i = r[a], i[a]
            columns = np.arange(self.at.shape[1])
            self._shift(r, np.minimum(columns + (columns > i[:, None]), len(columns) - 1))
            self.part[r, i] = both[a]
            self.k[r] -= 1
            self.post[r] += change[a]

    def _move(self, r: np.ndarray) -> None:
        if not len(r):
            return
        at, index, part, ll, rows = self.at.reshape(-1), self.index.reshape(-1), self.part.reshape(-1), self.model.loglik, self.rows[r]
        i = (self.draws.next(r) * self.k[r]).astype(np.int64)
        f = self._base[r] + i + 1
        first, hi = at[f - 1], at[f + 1]
        lo = np.where(i > 0, first, self.start[r])
        y = at[f] + (2 * self.draws.next(r) - 1) * self.width[r]
        while True:  # reflected at the neighbours
            out = np.flatnonzero(~((lo < y) & (y < hi)) & (lo < hi))
            if not len(out):
                break
            y[out] = np.where(y[out] <= lo[out], 2 * lo[out], 2 * hi[out]) - y[out]
        iy = self.model.index(rows, y)
        left, right = ll(rows, first, index[f - 1], y, iy), ll(rows, y, iy, hi, index[f + 1])
        change = left + right - part[f - 1] - part[f]
        a = self._accepted(r, change)
        f = f[a]
        at[f], index[f], part[f - 1], part[f] = y[a], iy[a], left[a], right[a]
        self.post[r[a]] += change[a]

    def theta(self, active: int) -> np.ndarray:
        """Changepoints of the first ``active`` chains, one after the other."""
        most = int(self.k[:active].max(initial=0))
        return self.at[:active, 1 : most + 1][np.arange(most) < self.k[:active, None]]


def run_chains(model, rows: np.ndarray, start: np.ndarray, end: np.ndarray, cfg: SamplerConfig, rngs: list[np.random.Generator], iterations: np.ndarray | None = None, theta: tuple[np.ndarray, np.ndarray] | None = None, begin: np.ndarray | None = None) -> Iterator[tuple[int, int, Chains]]:
    """After each kept step: its number, how many chains take it, and the chains, whose arrays go on changing.

    iterations: of each chain, descending, in place of the common number."""
    most = cfg.iterations if iterations is None else int(iterations.max(initial=0))
    chains = Chains(model, rows, start, end, cfg, Draws(rngs, cfg.burn_in + most), theta, begin)
    active = np.full(most, len(rows)) if iterations is None else len(rows) - np.searchsorted(iterations[::-1], np.arange(1, most + 1))
    for _ in range(cfg.burn_in):
        chains.step(len(rows))
    for it in range(1, most + 1):
        chains.step(int(active[it - 1]))
        if it % cfg.thinning == 0:
            yield it, int(active[it - 1]), chains


def ragged(lengths: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Where the values of lists of these lengths stand, once the lists are taken in this order."""
    first, own = np.cumsum(lengths) - lengths, lengths[order]
    return np.repeat(first[order] - (np.cumsum(own) - own), own) + np.arange(own.sum())


def padded(lists: list, width: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Lists as rows filled up with infinity, and their lengths."""
    k = np.array([len(x) for x in lists], np.int64)
    out = np.full((len(lists), max(width, int(k.max(initial=0)))), np.inf)
    out[np.arange(out.shape[1]) < k[:, None]] = np.concatenate([*lists, np.zeros(0)])
    return out, k


def smc_windows(model: PoissonRows, rows: np.ndarray, times: list[np.ndarray], past: np.ndarray, k: np.ndarray, log_w: np.ndarray, a: float, b: float, begin: np.ndarray, cfg: SamplerConfig, rng: Callable[[int], np.random.Generator], threshold: float, moves: int, source: str = "chain") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """kernels.smc_window for many series side by side, with the same draws: particles, their lengths, log weights, and which series were resampled.

    past: series by particles by positions, ascending and then infinite; k, log_w: series by particles. rng: begins the numbers of a series."""
    (m, n), width = k.shape, b - a
    ends = lambda x: np.maximum(x, begin[:, None])
    last = np.where(k > 0, np.take_along_axis(past, np.maximum(k - 1, 0)[:, :, None], 2)[:, :, 0] if past.shape[2] else 0.0, -np.inf)
    last, late = ends(last), a > begin
    rngs, first_from = [rng(i) for i in range(m)], np.full(m, a)
    if source == "chain":
        w = np.exp(log_w - log_w.max(axis=1, keepdims=True))
        first_from = np.where(late, np.maximum(begin, a - (w * (a - last)).sum(axis=1) / w.sum(axis=1)), a)
        window, kept = SamplerConfig(**{**cfg.__dict__, "iterations": n * cfg.thinning, "move_width": cfg.move_width or width / 3}), []
        for _, _, now in run_chains(model, rows, np.full(m, a), np.full(m, b), window, rngs, begin=first_from):
            kept.append((now.at[:, 1:].copy(), now.k.copy()))
        most = max(int(x.max()) for _, x in kept)
        fresh = np.full((m, n, most), np.inf)
        for p, (at, own) in enumerate(kept):
            shown = min(most, at.shape[1])
            fresh[:, p, :shown] = np.where(np.arange(shown) < own[:, None], at[:, :shown], np.inf)
        fresh_k, rngs = np.stack([x for _, x in kept], axis=1), [rng(i) for i in range(m)]
        for own, taken in zip(rngs, now.draws.taken().tolist(), strict=True):
            own.bit_generator.advance(taken)
    else:
        drawn, ks = [], []
        for own, t in zip(rngs, times, strict=True):
            if source == "prior":
                ks.append(own.poisson(cfg.nu * width, n))
                drawn.append(a + own.random(ks[-1].sum()) * width)
            else:
                x = rejection(PoissonModel(t, model.alpha, model.beta), a, b, cfg.nu, n, own)[0]
                ks.append(np.array([len(y) for y in x]))
                drawn.append(np.array([z for y in x for z in y]))
        fresh_k = np.stack(ks).astype(np.int64)
        fresh = np.full((m, n, int(fresh_k.max())), np.inf)
        fresh[np.arange(fresh.shape[2]) < fresh_k[:, :, None]] = np.concatenate(drawn)
        fresh.sort(axis=2)
    order = np.stack([own.permutation(n) for own in rngs])
    fresh, fresh_k = np.take_along_axis(fresh, order[:, :, None], 1), np.take_along_axis(fresh_k, order, 1)
    row, from_ = np.repeat(rows, n), np.repeat(first_from, n)
    first = np.where(fresh_k > 0, fresh[:, :, 0] if fresh.shape[2] else b, b)

    def loglik(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return model.loglik(row, x, model.index(row, x), y, model.index(row, y)).reshape(m, n)

    at = np.full(m * n, a)
    log_w = log_w + np.where(late[:, None], loglik(last.ravel(), first.ravel()) - loglik(last.ravel(), at) - loglik(from_, first.ravel()), 0.0)
    if source == "prior":
        cuts = np.concatenate([from_[:, None], fresh.reshape(m * n, -1), np.full((m * n, 1), np.inf)], axis=1)
        cuts[np.arange(m * n), fresh_k.ravel() + 1] = b
        for j in range(cuts.shape[1] - 1):
            log_w = log_w + np.where(fresh_k >= j, loglik(np.minimum(cuts[:, j], b), np.minimum(cuts[:, j + 1], b)), 0.0)
    # Past positions all come before the window's, so sorting joins them.
    past, k = np.sort(np.concatenate([past, fresh], axis=2), axis=2), k + fresh_k
    past = past[:, :, : int(k.max())]
    w = np.exp(log_w - log_w.max(axis=1, keepdims=True))
    again = ~(w.sum(axis=1) ** 2 / (w * w).sum(axis=1) >= threshold * n)
    s = np.flatnonzero(again)
    if not len(s):
        return past, k, log_w, again
    parent = np.stack([np.repeat(np.arange(n), systematic_counts(w[i], n, rngs[i].random())) for i in s])
    moved, moved_k = np.take_along_axis(past[s], parent[:, :, None], 1).reshape(len(s) * n, -1), np.take_along_axis(k[s], parent, 1).ravel()
    if moves:
        numbers = np.concatenate([rngs[i].random((n, MOST_DRAWS * moves)) for i in s])
        lo = np.repeat(np.array([moves_from(x, a, b) for x in begin[s].tolist()]), n)
        fixed = (moved <= lo[:, None]).sum(axis=1)
        before = np.where(fixed > 0, moved[np.arange(len(moved)), np.maximum(fixed - 1, 0)] if moved.shape[1] else 0.0, -np.inf)
        near = np.sort(np.where(np.arange(moved.shape[1]) < fixed[:, None], np.inf, moved), axis=1)
        steps = SamplerConfig(**{**cfg.__dict__, "iterations": moves, "burn_in": 0, "thinning": moves, "move_width": cfg.move_width or width / 3})
        now = Chains(model, np.repeat(rows[s], n), lo, np.full(len(moved), b), steps, Draws([], 0, numbers), (near, moved_k - fixed), np.maximum(before, np.repeat(begin[s], n)))
        for _ in range(moves):
            now.step(len(moved))
        held = np.where(np.arange(moved.shape[1]) < fixed[:, None], moved, np.inf)
        most = int(now.k.max())
        moved = np.sort(np.concatenate([held, np.where(np.arange(most) < now.k[:, None], now.at[:, 1 : most + 1], np.inf)], axis=1), axis=1)
        moved_k = fixed + now.k
    past = np.pad(past, ((0, 0), (0, 0), (0, max(0, int(moved_k.max()) - past.shape[2]))), constant_values=np.inf)
    shown = min(past.shape[2], moved.shape[1])
    past[s], k, log_w = np.inf, k.copy(), log_w.copy()
    past[s, :, :shown] = moved[:, :shown].reshape(len(s), n, shown)
    k[s], log_w[s] = moved_k.reshape(len(s), n), 0.0
    return past, k, log_w, again
