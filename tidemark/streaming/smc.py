"""Sequential Monte Carlo on a stream of events.

A series' state is its particles, their weights, and the events that segments can still begin among. Series are dealt out over
groups by a hash, and a group's state is that of all its series, which are sampled side by side. Events wait until the
watermark passes the end of their window; then the window is sampled, joined and weighted, as in batch. So rows
that arrive in another order give the same particles, and those later than the watermark are dropped. A batch replay of the
same events gives the same rows: draws depend on the seed, the series and the window alone.

A series is observed from the first window that has an event of it: before, its changepoints come from the prior alone, and
nothing counts against the time that has passed.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.kernels import SamplerConfig, SeenModel, draw_prior, moves_from, smc_window
from tidemark.operators.lockstep import SeenRows, padded, plain, smc_windows
from tidemark.operators.samplers import gathered, generator, lists_of
from tidemark.sources.tables import series_of
from tidemark.streaming.pvalues import STATE_STORE

ROWS = "series string, interval long, n long, events long, ess double, e_k double, e_last_tau double, resampled boolean"
NAMES = [c.split()[0] for c in ROWS.split(", ")]
KINDS = {"interval": "int64", "n": "int64", "events": "int64", "ess": "float64", "e_k": "float64", "e_last_tau": "float64", "resampled": "bool"}
ROW_TYPES = pa.schema([("series", pa.string()), *((c, pa.from_numpy_dtype(np.dtype(k))) for c, k in KINDS.items())])
#: Series that are sampled side by side: of a replay, and of a group of a stream.
TOGETHER = 1000


@dataclass(frozen=True)
class Windows:
    """How a series is sampled: windows of ``width`` from 0, up to ``intervals`` of them, with n particles."""

    width: float
    intervals: int
    n: int
    cfg: SamplerConfig
    alpha: float = 0.1
    beta: float = 0.1
    threshold: float = 0.5
    moves: int = 5


class Filter:
    """The particles of one series, window by window."""

    def __init__(self, series: str, how: Windows, first: int):
        self.series, self.how, self.next = series, how, first
        self.begin = first * how.width
        rng = generator(how.cfg.seed, series, "before")
        self.past = [draw_prior(0.0, self.begin, how.cfg.nu, rng) for _ in range(how.n)]
        self.log_w = np.zeros(how.n)
        self.t: list[float] = []
        self.before = 0

    def advance(self, events: list[float]) -> tuple:
        """Takes the events of the next window, in any order; returns its row of ROWS."""
        how, i = self.how, self.next
        a, b = i * how.width, (i + 1) * how.width
        self.t += sorted(events)
        model = SeenModel(self.t, how.alpha, how.beta, before=self.before, begin=self.begin)
        self.past, self.log_w, resampled = smc_window(model, self.past, self.log_w, i, a, b, self.begin, how.n, how.cfg, generator(how.cfg.seed, self.series, i), how.threshold, how.moves)
        self.next += 1
        w = np.exp(self.log_w - self.log_w.max())
        w /= w.sum()
        # Rounded, as sums in arrays of another shape differ in the last bits.
        sums = 1 / (w * w).sum(), (w * [len(x) for x in self.past]).sum(), (w * [x[-1] if x else 0.0 for x in self.past]).sum()
        row = (self.series, i, how.n, len(events), *(round(float(x), 9) for x in sums), bool(resampled))
        self._forget(b)
        return row

    def _forget(self, b: float) -> None:
        """Drops events that no segment of a later window can begin before."""
        lo = self.begin if self.how.cfg.spacing else moves_from(self.begin, b, b + self.how.width)
        last = [max((x for x in p if x <= lo), default=self.begin) for p in self.past]
        gone = bisect_left(self.t, min((x for x in last if x > self.begin), default=lo))
        self.before, self.t = self.before + gone, self.t[gone:]


class Filters:
    """The particles of many series side by side, window by window, each series from its first event on."""

    def __init__(self, how: Windows):
        self.how, self.row, self.times = how, {}, []
        self.begin, self.before = np.zeros(0), np.zeros(0, np.int64)
        self.past, self.k, self.log_w = np.full((0, how.n, 0), np.inf), np.zeros((0, how.n), np.int64), np.zeros((0, how.n))

    def _observe(self, names: list[str], begin: float) -> None:
        """Series begin with this window: particles from the prior."""
        how = self.how
        rngs = [generator(how.cfg.seed, s, "before") for s in names]
        own, k = padded([draw_prior(0.0, begin, how.cfg.nu, rng) for rng in rngs for _ in range(how.n)], self.past.shape[2])
        past = np.pad(self.past, ((0, 0), (0, 0), (0, own.shape[1] - self.past.shape[2])), constant_values=np.inf)
        self.past = np.concatenate([past, own.reshape(len(names), how.n, -1)])
        self.k, self.log_w = np.concatenate([self.k, k.reshape(-1, how.n)]), np.concatenate([self.log_w, np.zeros((len(names), how.n))])
        self.begin, self.before = np.append(self.begin, np.full(len(names), begin)), np.append(self.before, np.zeros(len(names), np.int64))
        self.row |= {s: len(self.row) + i for i, s in enumerate(names)}
        self.times += [np.zeros(0)] * len(names)

    def advance(self, i: int, events: dict[str, np.ndarray]) -> pd.DataFrame:
        """Takes the events of window i, ascending, of the series that have any; returns rows of ROWS."""
        how, a, b = self.how, i * self.how.width, (i + 1) * self.how.width
        new = [s for s in events if s not in self.row]
        if new:
            self._observe(new, a)
        for s, t in events.items():
            self.times[self.row[s]] = np.append(self.times[self.row[s]], t)
        names, m = list(self.row), len(self.row)
        if not m:
            return pd.DataFrame(columns=NAMES)
        model = SeenRows(self.times, how.alpha, how.beta, self.begin, self.before)
        self.past, self.k, self.log_w, again = smc_windows(model, np.arange(m), self.times, self.past, self.k, self.log_w, a, b, self.begin, how.cfg, lambda s: generator(how.cfg.seed, names[s], i), how.threshold, how.moves)
        w = np.exp(self.log_w - self.log_w.max(axis=1, keepdims=True))
        w /= w.sum(axis=1, keepdims=True)
        last = np.take_along_axis(self.past, np.maximum(self.k - 1, 0)[:, :, None], 2)[:, :, 0] if self.past.shape[2] else np.zeros((m, how.n))
        e_last = (w * np.where(self.k > 0, last, 0.0)).sum(axis=1)
        gone = model.gone(self.past, np.array([moves_from(x, b, b + how.width) for x in self.begin.tolist()]))
        self.times, self.before = [t[g:] for t, g in zip(self.times, gone.tolist(), strict=True)], self.before + gone
        # Rounded, as sums in arrays of another shape differ in the last bits.
        return pd.DataFrame({"series": names, "interval": i, "n": how.n, "events": [len(events.get(s, ())) for s in names], "ess": np.round(1 / (w * w).sum(axis=1), 9), "e_k": np.round((w * self.k).sum(axis=1), 9), "e_last_tau": np.round(e_last, 9), "resampled": again})


class Apart:
    """Filters for options that have no form in arrays: each series has its Filter."""

    def __init__(self, how: Windows):
        self.how, self.own = how, {}

    def advance(self, i: int, events: dict[str, np.ndarray]) -> pd.DataFrame:
        self.own |= {s: Filter(s, self.how, i) for s in events if s not in self.own}
        return pd.DataFrame([f.advance(list(events.get(s, ()))) for s, f in self.own.items()], columns=NAMES)


def filters(how: Windows) -> Filters | Apart:
    return Filters(how) if plain(how.cfg) else Apart(how)


class Particles(StatefulProcessor):
    """State of a group of series: their filters and the next window, once one is observed, and the events of windows that haven't ended."""

    def __init__(self, how: Windows, origin_ms: int, unit_ms: int):
        self.how, self.origin_ms, self.unit_ms = how, origin_ms, unit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.filters = handle.getValueState("filters", "payload binary")
        self.waiting = handle.getListState("waiting", "payload binary")

    def _end(self, i: int) -> int:
        """When window i ends, in milliseconds, rounded up."""
        return self.origin_ms + int(-(-(i + 1) * self.how.width * self.unit_ms // 1))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for r in rows:
            r = r[["series", "t"]].dropna()
            r = r[(r["t"] >= 0) & (r["t"] < self.how.width * self.how.intervals)]
            if len(r):
                self.waiting.appendList([(pickle.dumps((r["series"].tolist(), r["t"].to_numpy())),)])
                if not self.filters.exists():
                    # The earliest event may still come; a window's timer finds what has waited.
                    self.handle.registerTimer(self._end(int(r["t"].min() // self.how.width)))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, how = timerValues.getCurrentWatermarkInMs(), self.how
        parts = [pickle.loads(x[0]) for x in self.waiting.get()] if self.waiting.exists() else []
        held = pd.DataFrame({"series": [s for names, _ in parts for s in names], "t": np.concatenate([*(t for _, t in parts), np.zeros(0)])}).sort_values("t")
        if self.filters.exists():
            own, i = pickle.loads(self.filters.get()[0])
        elif len(held):
            own, i = filters(how), int(held["t"].iloc[0] // how.width)
        else:
            return
        while i < how.intervals and self._end(i) <= now:
            ended = held["t"] < (i + 1) * how.width
            rows = own.advance(i, {s: t.to_numpy() for s, t in held[ended].groupby("series")["t"]})
            held, i = held[~ended], i + 1
            yield rows
        self.filters.update((pickle.dumps((own, i)),))
        self.waiting.clear()
        if len(held):
            self.waiting.put([(pickle.dumps((held["series"].tolist(), held["t"].to_numpy())),)])
        if i < how.intervals:
            self.handle.registerTimer(self._end(i))

    def close(self) -> None:
        pass


def particles(events: DataFrame, how: Windows, origin_ms: int, unit_ms: int = 86_400_000, delay: str = "1 hour", groups: int = 256) -> DataFrame:
    """(ROWS) of each window of a stream (series, ts, t); t counts units from the origin.

    groups: series are dealt out over as many, which the stream keeps; some TOGETHER series each work best."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    marked = events.select("series", "ts", "t", F.pmod(F.xxhash64("series"), F.lit(groups)).alias("part")).withWatermark("ts", delay)
    return marked.groupBy("part").transformWithStateInPandas(Particles(how, origin_ms, unit_ms), outputStructType=ROWS, outputMode="Append", timeMode="EventTime")


def replay(events: DataFrame, how: Windows) -> DataFrame:
    """The same rows in batch, from (series, t)."""

    def summed(names: list, times: list[np.ndarray]) -> pd.DataFrame:
        own, out = filters(how), []
        for i in range(how.intervals):
            cut = [(s, t[np.searchsorted(t, i * how.width) : np.searchsorted(t, (i + 1) * how.width)]) for s, t in zip(names, times, strict=True)]
            out.append(own.advance(i, {s: t for s, t in cut if len(t)}))
        out = [x for x in out if len(x)]
        return pd.concat(out) if out else pd.DataFrame(columns=NAMES)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(i, TOGETHER)
                yield pa.RecordBatch.from_pandas(summed(part.column("series").to_pylist(), lists_of(part.column("data"))).astype(KINDS), ROW_TYPES, preserve_index=False)

    known = events.where("series IS NOT NULL")
    return gathered(known, series_of(known), "poisson", together=TOGETHER).mapInArrow(run, ROWS)
