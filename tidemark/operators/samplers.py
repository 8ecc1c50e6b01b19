"""Posterior samplers over many series: one task of applyInPandas for each series and chain.

Every series of the dimension gets a sample, also one without events. Draws depend on the seed, the
series and the chain alone, so they are the same under any partitioning.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.kernels import CountModel, GaussianModel, PoissonModel, SamplerConfig, chain_rates, draw_prior, monotone, rejection, run_chain, run_shot_noise, shot_noise_window, smc_window
from tidemark.operators.lockstep import GaussianRows, PoissonRows, padded, plain, ragged, run_chains, smc_windows
from tidemark.operators.series import bucketed_sum
from tidemark.operators.shots import shot_windows
from tidemark.sources.tables import durable

#: What the models of each kind of series read.
COLUMNS = {"poisson": ["t"], "counts": ["seq", "n"], "gaussian": ["seq", "y"]}
PARTICLES = "series string, chain int, iteration long, k int, theta array<double>, means array<double>, log_post double"


def generator(seed: int, *names) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64(np.random.SeedSequence([seed, *(zlib.crc32(str(n).encode()) for n in names)])))


def _model(kind: str, pdf: pd.DataFrame, alpha: float, beta: float, v: float, scale):
    if kind == "gaussian":
        return GaussianModel(pdf.sort_values("seq")["y"].tolist(), alpha, beta, v)
    if kind == "counts":
        return CountModel([], alpha, beta, None, pdf.sort_values("seq")["n"].astype(int).tolist())
    return PoissonModel(sorted(pdf["t"].dropna().tolist()), alpha, beta, scale)


def _with_empty(events: DataFrame, series: DataFrame, columns: list[str]) -> DataFrame:
    return series.select("series", *[c for c in series.columns if c in ("end", "sizes")]).join(events.select("series", *columns), "series", "left")


def reversible_jump(events: DataFrame, series: DataFrame, start: float, end: float, cfg: SamplerConfig, kind: str = "poisson", chains: int = 1, alpha: float = 0.1, beta: float = 0.1, v: float = 10.0, scale=None, rising: bool = False) -> DataFrame:
    """Posterior changepoint samples (PARTICLES) of each series and chain.

    A column ``end`` of the series dimension is a series' own end, in place of the common one. kind: poisson (t), counts (seq, n) or gaussian (seq, y). scale: cumulative time scale, a function of t.
    rising: segments' rates are drawn from their posteriors (means holds them), and states are kept only
    where no rate falls below the one before."""
    if plain(cfg) and scale is None and kind != "counts":
        return _in_step(events, series, start, end, cfg, kind, chains, alpha, beta, v, rising)
    rows = _with_empty(events, series, COLUMNS[kind]).withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(chains - 1))))
    common = end

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        name, chain = key
        end = float(pdf["end"].iloc[0]) if "end" in pdf else common
        model = _model(kind, pdf.dropna(), alpha, beta, v, scale)
        rng = generator(cfg.seed, name, chain)
        kept, _ = run_chain(model, start, end, cfg, rng)
        out = []
        for it, theta, post in kept:
            ends = [start, *theta, end]
            means = [model.draw(a, b, rng) if rising else model.mean(a, b) for a, b in zip(ends, ends[1:], strict=False)]
            if not rising or monotone(means):
                out.append((name, chain, it, len(theta), theta, means, post))
        return pd.DataFrame(out, columns=["series", "chain", "iteration", "k", "theta", "means", "log_post"])

    return rows.groupBy("series", "chain").applyInPandas(run, PARTICLES)


#: Chains that run side by side; a step's cost is that of a few hundred array operations and of its chains.
TOGETHER = 2000


def tasks(n: int, cores: int, together: int = TOGETHER) -> int:
    """Partitions for n series or chains: a number of one's own, since small inputs would be put into one task."""
    return max(1, -(-n // together), min(cores, n // 100))


def gathered(events: DataFrame, series: DataFrame, kind: str, chains: int = 1, together: int = TOGETHER) -> DataFrame:
    """A row for each series: its name, ``data`` in order of time, and its own end, if any; dealt out over ``tasks``."""
    value = {"poisson": F.col("t"), "gaussian": F.struct("seq", "y"), "counts": F.struct("seq", "n")}[kind]
    known = {"poisson": "t IS NOT NULL AND NOT isnan(t)", "gaussian": "seq IS NOT NULL AND y IS NOT NULL AND NOT isnan(y)", "counts": "seq IS NOT NULL AND n IS NOT NULL"}[kind]
    own = [c for c in series.columns if c in ("end", "sizes")]
    lists = _with_empty(events, series, COLUMNS[kind]).groupBy("series").agg(F.sort_array(F.collect_list(F.when(F.expr(known), value))).alias("data"), *[F.first(c).alias(c) for c in own])
    lists = lists if kind == "poisson" else lists.withColumn("data", F.col("data.y" if kind == "gaussian" else "data.n"))
    # By a hash of the name: a partitioning by the name itself is one that lists have already, and may be put together.
    return lists.repartition(tasks(series.count() * chains, series.sparkSession.sparkContext.defaultParallelism, together), F.xxhash64("series"))


def lists_of(column: pa.Array) -> list[np.ndarray]:
    """The lists of an Arrow column as arrays."""
    column = column.fill_null([]) if column.null_count else column
    ends = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    return [values[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]


def _in_step(events: DataFrame, series: DataFrame, start: float, end: float, cfg: SamplerConfig, kind: str, chains: int, alpha: float, beta: float, v: float, rising: bool) -> DataFrame:
    """reversible_jump of many series and chains side by side, with the states that each has alone."""

    def sampled(batch: pa.RecordBatch) -> pa.RecordBatch:
        data = lists_of(batch.column("data"))
        model = PoissonRows(data, alpha, beta) if kind == "poisson" else GaussianRows(data, alpha, beta, v)
        names, n = batch.column("series").to_pylist(), len(data) * chains
        row, chain = np.repeat(np.arange(len(data)), chains), np.tile(np.arange(chains), len(data))
        ends = np.repeat(batch.column("end").to_numpy(zero_copy_only=False), chains) if "end" in batch.schema.names else np.full(n, float(end))
        rng = lambda i: generator(cfg.seed, names[row[i]], chain[i])
        kept, ks, posts, thetas, edges, last = [], [], [], [], [], None
        for it, _, now in run_chains(model, row, np.full(n, float(start)), ends, cfg, [rng(i) for i in range(n)]):
            k, last = now.k.copy(), now
            inside = np.arange(int(k.max()) + 1) <= k[:, None]
            of = np.repeat(np.arange(n), k + 1)
            a, b = (x[:, : inside.shape[1]][inside] for x in (now.at, now.at[:, 1:]))
            ia, ib = (x[:, : inside.shape[1]][inside] for x in (now.index, now.index[:, 1:]))
            kept.append(it), ks.append(k), posts.append(now.post.copy()), thetas.append(now.theta(n))
            edges.append((alpha + ib - ia, 1 / (beta + (b - a))) if rising else (model.mean(row[of], a, ia, b, ib),))
        # Rows come step by step; they go out chain by chain.
        order = np.arange(len(kept) * n).reshape(len(kept), n).T.ravel()
        k = np.concatenate([*ks, np.zeros(0, np.int64)])
        theta = np.concatenate([*thetas, np.zeros(0)])[ragged(k, order)]
        edge = [np.concatenate([*x, np.zeros(0)])[ragged(k + 1, order)] for x in zip(*edges, strict=True)] or [np.zeros(0)] * 2
        post, it, of, k = np.concatenate([*posts, np.zeros(0)])[order], np.tile(kept, n), np.repeat(np.arange(n), len(kept)), k[order]
        means = edge[0]
        if rising and len(k):
            # Rates are drawn after the chain, by what comes next in its numbers.
            cuts, taken = np.concatenate([[0], np.cumsum((k + 1).reshape(n, -1).sum(axis=1))]), last.draws.taken()
            means = np.empty(len(edge[0]))
            for i in range(n):
                own, here = rng(i), slice(cuts[i], cuts[i + 1])
                own.bit_generator.advance(int(taken[i]))
                means[here] = own.gamma(edge[0][here], edge[1][here])
            first = np.cumsum(k + 1) - (k + 1)
            falls = np.concatenate([means[1:] < means[:-1], [False]])
            falls[first + k] = False
            good = np.flatnonzero(np.add.reduceat(falls, first) == 0)
            theta, means = theta[ragged(k, good)], means[ragged(k + 1, good)]
            post, it, of, k = post[good], it[good], of[good], k[good]
        offsets = lambda x: pa.array(np.concatenate([[0], np.cumsum(x)]), pa.int32())
        columns = [
            pa.array(names, pa.string()).take(pa.array(row[of])),
            pa.array(chain[of], pa.int32()),
            pa.array(it, pa.int64()),
            pa.array(k, pa.int32()),
            pa.ListArray.from_arrays(offsets(k), pa.array(theta)),
            pa.ListArray.from_arrays(offsets(k + 1), pa.array(means)),
            pa.array(post),
        ]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PARTICLES.split(", ")])

    def run(batches):
        together = max(1, TOGETHER // chains)
        for batch in batches:
            for i in range(0, batch.num_rows, together):
                yield sampled(batch.slice(i, together))

    return gathered(events, series, kind, chains).mapInArrow(run, PARTICLES)


def acceptance_rates(events: DataFrame, series: DataFrame, start: float, end: float, cfg: SamplerConfig, chains: int = 1, alpha: float = 0.1, beta: float = 0.1) -> DataFrame:
    rows = _with_empty(events, series, ["t"]).withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(chains - 1))))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        _, rates = run_chain(_model("poisson", pdf.dropna(), alpha, beta, 0, None), start, end, cfg, generator(cfg.seed, *key))
        return pd.DataFrame([(*key, *(rates[f"{k}_rate"] for k in ("birth", "death", "move")))], columns=["series", "chain", "birth", "death", "move"])

    return rows.groupBy("series", "chain").applyInPandas(run, "series string, chain int, birth double, death double, move double")


def shot_noise(events: DataFrame, series: DataFrame, start: float, end: float, cfg: SamplerConfig, alpha: float, kappa: float) -> DataFrame:
    """Posterior samples of a decaying rate with jumps; means holds the heights after each jump."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        kept = run_shot_noise(sorted(pdf["t"].dropna().tolist()), start, end, cfg, alpha, kappa, generator(cfg.seed, *key))
        return pd.DataFrame([(key[0], 0, it, len(tau), tau, h, post) for it, tau, h, post in kept], columns=["series", "chain", "iteration", "k", "theta", "means", "log_post"])

    return _with_empty(events, series, ["t"]).groupBy("series").applyInPandas(run, PARTICLES)


def rejection_sample(events: DataFrame, series: DataFrame, start: float, end: float, nu: float, n: int, alpha: float = 0.1, beta: float = 0.1, seed: int = 1, together: int = 250) -> DataFrame:
    """n exact draws of each series, with one changepoint at most, and the acceptance rate. A task has many series, ``together`` at a time."""
    groups = max(1, -(-series.count() // together))
    rows = _with_empty(events, series, ["t"]).withColumn("_group", F.pmod(F.xxhash64("series"), F.lit(groups)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for name, own in pdf.groupby("series", sort=False)["t"]:
            draws, tried = rejection(PoissonModel(sorted(own.dropna().tolist()), alpha, beta), start, end, nu, n, generator(seed, name))
            out += [(name, i, len(x), x, n / tried) for i, x in enumerate(draws)]
        return pd.DataFrame(out, columns=["series", "particle", "k", "theta", "acceptance"])

    return rows.groupBy("_group").applyInPandas(run, "series string, particle long, k int, theta array<double>, acceptance double")


def prior_sample(series: DataFrame, start: float, end: float, nu: float, n: int, seed: int = 1) -> DataFrame:
    """n draws of the prior for each series."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        rng = generator(seed, *key)
        draws = [draw_prior(start, end, nu, rng) for _ in range(n)]
        return pd.DataFrame([(key[0], i, len(x), x) for i, x in enumerate(draws)], columns=["series", "particle", "k", "theta"])

    return series.groupBy("series").applyInPandas(run, "series string, particle long, k int, theta array<double>")


SMC = "series string, interval int, particle long, k int, theta array<double>, w double, ess double, resampled boolean"


def sequential_monte_carlo(events: DataFrame, series: DataFrame, start: float, end: float, intervals: int, n: int, cfg: SamplerConfig, alpha: float = 0.1, beta: float = 0.1, threshold: float = 0.5, moves: int = 5, full_history: bool = False, kind: str = "poisson", v: float = 10.0, sizes: DataFrame | None = None, look_back: bool = True, fresh: DataFrame | None = None, source: str = "chain") -> DataFrame:
    """Weighted particles of each series after each of consecutive windows.

    A window's changepoints are drawn by a chain on the window, whose first segment begins (with
    look_back) at the mean time since the last changepoint of the past; a particle of the past and
    one of the window are joined, and weighted by the likelihood of the joined segment over those of
    the two that it replaces. Where the effective size falls under threshold * n, particles are
    resampled systematically and moved by a few chain steps in the last two windows. With
    full_history, each window is instead sampled from the start, with equal weights. kind: as for
    reversible_jump. With cfg.spacing, particles whose joined changepoints lie closer lose their weight.
    sizes: (series, interval, n), the number of particles of each window in place of n; where it
    changes, particles are resampled to the new number. fresh: (series, interval, particle, theta), the windows' samples if they were drawn before.
    source: chain, rejection (one changepoint a window at most) or prior; the last two don't look back."""
    width, common = (end - start) / intervals, n
    if kind == "poisson" and sizes is None and fresh is None and not full_history and plain(cfg) and (look_back or source != "chain"):
        return _smc_in_step(events, series, start, end, intervals, n, cfg, alpha, beta, threshold, moves, source)
    if sizes is not None:
        # As many numbers as intervals for each series.
        lists = sizes.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("interval", "n"))).alias("_x")).select("series", F.col("_x.n").alias("sizes"))
        series = series.join(lists, "series", "left").withColumn("sizes", F.coalesce("sizes", F.array_repeat(F.lit(n).cast("long"), intervals)))

    def run(key, pdf: pd.DataFrame, drawn: pd.DataFrame | None = None) -> pd.DataFrame:
        name = key[0]
        model, out = _model(kind, pdf.drop(columns="sizes", errors="ignore").dropna(), alpha, beta, v, None), []
        past, log_w = [[] for _ in range(common)], np.zeros(common)
        own = pdf["sizes"].iloc[0] if "sizes" in pdf else None
        given = {int(i): [list(x) for x in g.sort_values("particle")["theta"]] for i, g in drawn.groupby("interval")} if drawn is not None else {}
        for i in range(intervals):
            a, b = start + i * width, start + (i + 1) * width
            rng, fresh, resampled = generator(cfg.seed, name, i), given.get(i), False
            n = len(fresh) if fresh else int(own[i]) if own is not None else common
            if full_history:
                window = SamplerConfig(**{**cfg.__dict__, "iterations": n * cfg.thinning, "move_width": cfg.move_width or width / 3})
                past, log_w = [theta for _, theta, _ in run_chain(model, start, b, window, rng)[0]], np.zeros(n)
            else:
                past, log_w, resampled = smc_window(model, past, log_w, i, a, b, start, n, cfg, rng, threshold, moves, look_back, fresh, source)
            w = np.exp(log_w - log_w.max())
            w /= w.sum()
            out += [(name, i, p, len(x), x, w[p], 1 / (w * w).sum(), resampled) for p, x in enumerate(past)]
        return pd.DataFrame(out, columns=["series", "interval", "particle", "k", "theta", "w", "ess", "resampled"])

    rows = _with_empty(events, series, COLUMNS[kind])
    if fresh is None:
        return rows.groupBy("series").applyInPandas(lambda key, pdf: run(key, pdf), SMC)
    both = rows.groupBy("series").cogroup(fresh.select("series", "interval", "particle", "theta").groupBy("series"))
    return both.applyInPandas(lambda key, pdf, drawn: run(key, pdf, drawn), SMC)


def _smc_in_step(events: DataFrame, series: DataFrame, start: float, end: float, intervals: int, n: int, cfg: SamplerConfig, alpha: float, beta: float, threshold: float, moves: int, source: str) -> DataFrame:
    """sequential_monte_carlo of many series side by side, with the draws that each has alone."""
    width = (end - start) / intervals

    def sampled(batch: pa.RecordBatch):
        names, times = batch.column("series").to_pylist(), lists_of(batch.column("data"))
        m, model = len(names), PoissonRows(times, alpha, beta)
        past, k, log_w = np.full((m, n, 0), np.inf), np.zeros((m, n), np.int64), np.zeros((m, n))
        for i in range(intervals):
            past, k, log_w, again = smc_windows(model, np.arange(m), times, past, k, log_w, start + i * width, start + (i + 1) * width, np.full(m, float(start)), cfg, lambda s: generator(cfg.seed, names[s], i), threshold, moves, source)  # noqa: B023
            w = np.exp(log_w - log_w.max(axis=1, keepdims=True))
            w /= w.sum(axis=1, keepdims=True)
            theta = past[np.arange(past.shape[2]) < k[:, :, None]]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(k.ravel())]), pa.int32()), pa.array(theta))
            every = lambda x: pa.array(np.repeat(x, n))
            columns = [pa.array(names, pa.string()).take(every(np.arange(m))), pa.array(np.full(m * n, i), pa.int32()), pa.array(np.tile(np.arange(n), m)), pa.array(k.ravel(), pa.int32()), lists, pa.array(w.ravel()), every(1 / (w * w).sum(axis=1)), every(again)]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SMC.split(", ")])

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, SMC_TOGETHER):
                yield from sampled(batch.slice(i, SMC_TOGETHER))

    return gathered(events, series, "poisson", together=SMC_TOGETHER).mapInArrow(run, SMC)


#: Series whose particles are sampled side by side.
SMC_TOGETHER = 1000
SHOTS = "series string, interval int, particle long, k int, theta array<double>, heights array<double>, w double, ess double, resampled boolean"


def shot_noise_smc(events: DataFrame, series: DataFrame, start: float, end: float, intervals: int, n: int, cfg: SamplerConfig, alpha: float, kappa: float, threshold: float = 0.5, moves: int = 5) -> DataFrame:
    """Weighted particles of a decaying rate with jumps after each of consecutive windows: sequential_monte_carlo for
    shot noise. heights has the rate at start and after each jump."""
    width = (end - start) / intervals
    if cfg.jumps == "gamma":
        return _shots_in_step(events, series, start, width, intervals, n, cfg, alpha, kappa, threshold, moves)

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        t, past, log_w, out = sorted(pdf["t"].dropna().tolist()), [], np.zeros(n), []
        for i in range(intervals):
            past, log_w, resampled = shot_noise_window(t, past, log_w, i, start + i * width, start + (i + 1) * width, n, cfg, alpha, kappa, generator(cfg.seed, key[0], i), threshold, moves)
            w = np.exp(log_w - log_w.max())
            w /= w.sum()
            out += [(key[0], i, p, len(tau) - 1, tau[1:], h, w[p], 1 / (w * w).sum(), resampled) for p, (tau, h) in enumerate(past)]
        return pd.DataFrame(out, columns=["series", "interval", "particle", "k", "theta", "heights", "w", "ess", "resampled"])

    return _with_empty(events, series, ["t"]).groupBy("series").applyInPandas(run, SHOTS)


def _shots_in_step(events: DataFrame, series: DataFrame, start: float, width: float, intervals: int, n: int, cfg: SamplerConfig, alpha: float, kappa: float, threshold: float, moves: int) -> DataFrame:
    """shot_noise_smc of many series side by side."""

    def sampled(batch: pa.RecordBatch):
        names, model = batch.column("series").to_pylist(), PoissonRows(lists_of(batch.column("data")), 1.0, 1.0)
        m, every = len(names), lambda x: pa.array(np.repeat(x, n))
        offsets = lambda x: pa.array(np.concatenate([[0], np.cumsum(x)]), pa.int32())
        for i, at, h, k, log_w, again in shot_windows(model, start, width, intervals, n, cfg, alpha, kappa, lambda s, i: generator(cfg.seed, names[s], i), threshold, moves):
            w = np.exp(log_w - log_w.max(axis=1, keepdims=True))
            w /= w.sum(axis=1, keepdims=True)
            inside, k = np.arange(at.shape[2]) <= k[:, :, None], k.ravel()
            theta = pa.ListArray.from_arrays(offsets(k), pa.array(at[:, :, 1:][inside[:, :, 1:]]))
            columns = [pa.array(names, pa.string()).take(every(np.arange(m))), pa.array(np.full(m * n, i), pa.int32()), pa.array(np.tile(np.arange(n), m)), pa.array(k, pa.int32()), theta, pa.ListArray.from_arrays(offsets(k + 1), pa.array(h[inside])), pa.array(w.ravel()), every(1 / (w * w).sum(axis=1)), every(again)]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SHOTS.split(", ")])

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, SMC_TOGETHER):
                yield from sampled(batch.slice(i, SMC_TOGETHER))

    return gathered(events, series, "poisson", together=SMC_TOGETHER).mapInArrow(run, SHOTS)


def water_level(scores: DataFrame, budget: int, bucket: Column | None = None) -> DataFrame:
    """(series, interval, more): how many of each interval's ``budget`` draws go to each of its series, when
    one at a time goes to the largest of extent / seen, seen growing by one with it.

    scores: (series, interval, extent, seen), seen being 1 or more. Those that get any end with extent / (seen + more) near a common
    level, which follows from sums over the series with larger scores: no loop. On average a series passes the level by
    half a draw, so seen counts half a draw less; fractions go, whole, to the largest ones."""
    scores = scores.withColumn("seen", F.col("seen") - 0.5)
    score = F.col("extent") / F.col("seen")
    # In buckets of the score's logarithm: scores are of the form exp(2 h) / n, so equal widths would put most in one.
    rows = scores.withColumn("_score", score).withColumn("_bucket", F.floor(-8 * F.log("_score")) if bucket is None else bucket)
    order = [F.col("_score").desc(), "series"]
    sums = bucketed_sum(rows, {"_e": F.col("extent"), "_i": F.col("seen")}, F.col("_bucket"), ["interval"], order)
    level = sums.where(F.col("_score") > F.col("_e") / (budget + F.col("_i"))).groupBy("interval").agg(F.max_by(F.col("_e") / (budget + F.col("_i")), "_i").alias("_level"))
    share = F.greatest(F.lit(0.0), F.col("extent") / F.col("_level") - F.col("seen"))
    given = rows.join(level, "interval").withColumns({"more": F.floor(share).cast("long"), "_part": share - F.floor(share)})
    lack = given.groupBy("interval").agg((F.lit(budget) - F.sum("more")).alias("_lack"))
    ranked = bucketed_sum(given, {"_rank": F.lit(1)}, F.floor(-64 * F.col("_part")), ["interval"], [F.col("_part").desc(), "series"])
    return ranked.join(lack, "interval").select("series", "interval", (F.col("more") + (F.col("_rank") <= F.col("_lack")).cast("long")).alias("more"))


DRAWN = "series string, interval int, particle long, theta array<double>"


def budgeted_windows(events: DataFrame, series: DataFrame, start: float, end: float, intervals: int, budget: int, least: int, cfg: SamplerConfig, bins: int = 50, rounds: int = 3, alpha: float = 0.1, beta: float = 0.1, together: int = 1000) -> DataFrame:
    """(DRAWN): each window's sample for each series, when the window's ``budget`` of draws over all series goes where the
    extent score of the draws so far is largest.

    Each series begins with ``least`` draws. Then rounds: scores from all draws so far, half of what is left of the budget (in the
    last round all of it) dealt out by them, and the chains go on from where they stopped. Rounds are written
    tables, so a lost executor costs a round's tasks at most. A window has least * series + budget draws."""
    width = (end - start) / intervals
    at = F.floor((F.col("t") - start) / width).cast("int")
    local = events.where((F.col("t") >= start) & (F.col("t") < end)).select("series", at.alias("interval"), "t")
    windows = series.select("series", F.explode(F.sequence(F.lit(0), F.lit(intervals - 1))).alias("interval"))
    groups = tasks(series.count() * intervals, series.sparkSession.sparkContext.defaultParallelism, together)

    def draw(state: DataFrame, number: int) -> DataFrame:
        """state: (series, interval, theta, seen, more)."""

        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            events = {k: np.sort(g.to_numpy()) for k, g in right.groupby(["series", "interval"])["t"]}
            # Chains side by side, the longest first; those that have had their draws stop.
            left = left.sort_values("more", ascending=False, kind="stable")
            keys, n = list(zip(left["series"], left["interval"], strict=True)), len(left)
            if not n:
                return pd.DataFrame(columns=["series", "interval", "particle", "theta"])
            model = PoissonRows([events.get(k, np.zeros(0)) for k in keys], alpha, beta)
            own = SamplerConfig(**{**cfg.__dict__, "burn_in": 0 if number else cfg.burn_in, "move_width": cfg.move_width or width / 3})
            a, more, seen, out = start + left["interval"].to_numpy() * width, left["more"].to_numpy(), left["seen"].to_numpy(), []
            for it, active, now in run_chains(model, np.arange(n), a, a + width, own, [generator(cfg.seed, *k, number) for k in keys], more * cfg.thinning, padded(left["theta"].tolist())):
                theta = np.split(now.theta(active), np.cumsum(now.k[:active])[:-1])
                out += [(*k, int(s) + it // cfg.thinning - 1, x) for k, s, x in zip(keys[:active], seen[:active], theta, strict=True)]
            return pd.DataFrame(out, columns=["series", "interval", "particle", "theta"])

        # Many windows to a task's call.
        group = F.pmod(F.xxhash64("series", "interval"), F.lit(groups)).alias("_group")
        dealt = lambda df: df.select(*df.columns, group).repartition(groups, "_group").groupBy("_group")
        both = dealt(state).cogroup(dealt(local))
        return durable(both.applyInPandas(run, DRAWN), f"round{number}")

    first = windows.select("series", "interval", F.array().cast("array<double>").alias("theta"), F.lit(0).cast("long").alias("seen"), F.lit(least).cast("long").alias("more"))
    drawn, left = draw(first, 0), budget
    for number in range(1, rounds + 1):
        part = left if number == rounds else left // 2
        left -= part
        if not part:
            continue
        own = F.col("interval") * F.lit(width) + start
        bin_of = F.concat_ws(",", F.transform("theta", lambda x: F.floor((x - own) / (width / bins)).cast("string")))
        cells = drawn.groupBy("series", "interval", bin_of.alias("bins")).agg(F.count(F.lit(1)).alias("c"))
        scored = cells.groupBy("series", "interval").agg(F.sum("c").alias("seen"), F.sum(F.col("c") * F.log("c")).alias("_x"))
        scored = scored.withColumn("extent", F.exp(2 * (F.log("seen") - F.col("_x") / F.col("seen"))))
        more = water_level(scored, part)
        last = drawn.groupBy("series", "interval").agg(F.max_by("theta", "particle").alias("theta"), F.count(F.lit(1)).alias("seen"))
        drawn = drawn.unionByName(draw(last.join(more.where("more > 0"), ["series", "interval"]), number))
    return drawn


def interval_summary(sample: DataFrame) -> DataFrame:
    """Of each series and interval: effective size, mean number and mean last position of changepoints."""
    last = F.coalesce(F.element_at("theta", F.when(F.size("theta") > 0, -1)), F.lit(0.0))
    w, total = F.col("w"), F.sum("w")
    return sample.groupBy("series", "interval").agg(F.count(F.lit(1)).alias("n"), F.first("ess").alias("ess"), (F.sum(w * F.col("k")) / total).alias("e_k"), (F.sum(w * last) / total).alias("e_last_tau"), F.sum((w == 0).cast("long")).alias("zero_weights"))


def score_trajectories(sample: DataFrame, start: float, end: float, bins: int, first: int, parts: int | None = None) -> DataFrame:
    """(process, step, score): the score that each series has before each sample beyond ``first``: its
    histogram's entropy, squared and exponentiated, over the number of samples so far (extent score).
    Feeds the greedy allocation; series are dealt out over ``parts`` tasks, if given."""
    width = (end - start) / bins

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        seen, out, total = {}, [], 0.0
        for i, theta in enumerate(pdf.sort_values("iteration")["theta"]):
            if i >= first:
                h = np.log(i) - total / i
                out.append((key[0], i - first, float(np.exp(2 * h) / i)))
            b = tuple(int((x - start) / width) for x in theta)
            c = seen.get(b, 0)
            total += (c + 1) * np.log(c + 1) - (c * np.log(c) if c else 0.0)
            seen[b] = c + 1
        return pd.DataFrame(out, columns=["process", "step", "score"])

    sample = sample.select("series", "iteration", "theta")
    sample = sample.repartition(parts, "series") if parts else sample
    return sample.groupBy("series").applyInPandas(run, "process string, step long, score double")


def mean_place(a: float, b: float, slope: float) -> float:
    """Mean of the density on [a, b] that grows as exp(slope * x)."""
    x = abs(slope) * (b - a)
    share = 0.5 + x / 12 if x < 1e-3 else -1 / math.expm1(-x) - 1 / x
    return a + (b - a) * (share if slope > 0 else 1 - share)


def polish_map(best: DataFrame, events: DataFrame, start: float, end: float, alpha: float = 0.1, beta: float = 0.1, smoothing: bool = False) -> DataFrame:
    """Each series' best particle with its positions moved to the edge of the gap between events that
    raises the likelihood most: just after the event before, or at the next one.

    smoothing: a position that was moved is then put at its mean over that gap, given the rates on both sides, which is
    less sharp than the likeliest edge. log_lik is that of the positions returned."""

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame(columns=["series", "theta", "log_lik"])
        model = PoissonModel(sorted(right["t"].tolist()), alpha, beta)
        ends = [start, *left["theta"].iloc[0], end]
        for i in range(1, len(ends) - 1):
            at = model.index(ends[i])
            around = [ends[i]] + ([float(np.nextafter(model.t[at - 1], end))] if at else []) + ([model.t[at]] if at < len(model.t) else [])
            near = [x for x in around if ends[i - 1] < x < ends[i + 1]] or [ends[i]]
            was, ends[i] = ends[i], max(near, key=lambda x: model.loglik(ends[i - 1], x) + model.loglik(x, ends[i + 1]))  # noqa: B023
            if smoothing and ends[i] != was:
                gap = max(model.t[at - 1] if at else start, ends[i - 1]), min(model.t[at] if at < len(model.t) else end, ends[i + 1])
                ends[i] = mean_place(*gap, model.mean(ends[i], ends[i + 1]) - model.mean(ends[i - 1], ends[i]))
        return pd.DataFrame([(key[0], ends[1:-1], sum(model.loglik(a, b) for a, b in zip(ends, ends[1:], strict=False)))], columns=["series", "theta", "log_lik"])

    return best.groupBy("series").cogroup(events.select("series", "t").groupBy("series")).applyInPandas(run, "series string, theta array<double>, log_lik double")


def draw_rates(segments: DataFrame, keys: list[str], r: str = "r", length: str = "length", alpha: float = 0.1, beta: float = 0.1, seed: int = 1, prior: bool = False) -> DataFrame:
    """segments with rate, drawn from the Gamma posterior of r events in length (or from the prior). A draw
    depends on the seed and the keys alone."""
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in segments.schema.fields) + ", rate double"

    def run(batches):
        for pdf in batches:
            own = [generator(seed, *k) for k in pdf[keys].itertuples(index=False, name=None)]
            shape, rate = (pdf[r] * 0 + alpha, pdf[length] * 0 + beta) if prior else (alpha + pdf[r], beta + pdf[length])
            yield pdf.assign(rate=[g.gamma(a, 1 / b) for g, a, b in zip(own, shape, rate, strict=True)])

    return segments.mapInPandas(run, out)


def chain_prior(particles: DataFrame, k: str = "k", first: tuple[float, float] = (4.5, 1.5), variance: float = 5.0, keys: tuple[str, ...] = ("series", "particle"), seed: int = 1) -> DataFrame:
    """particles with rates: those of their k + 1 segments, drawn from the chain prior. A draw depends on the seed and the keys alone."""
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in particles.schema.fields) + ", rates array<double>"

    def run(batches):
        for pdf in batches:
            own = [generator(seed, *x) for x in pdf[list(keys)].itertuples(index=False, name=None)]
            yield pdf.assign(rates=[chain_rates(np.array([n + 1]), first, variance, g)[0] for n, g in zip(pdf[k], own, strict=True)])

    return particles.mapInPandas(run, out)
