"""Work and precision on large series."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import kernels, lockstep, particles, samplers, series


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_reversed_sums_run_once_over_a_bucket(spark):
    df = spark.createDataFrame([("a", float(i // 2), i, float(i)) for i in range(40)] + [("b", 3.0, 0, 7.0)], "series string, t double, seq long, value double")
    out = series.running_sum(df, {"s": F.col("value")}, 5.0, order=("t", "seq"), reverse=True)
    # A frame up to the end costs the square of a bucket's rows.
    assert "unboundedfollowing" not in plan(out).lower()
    assert {(r["series"], r["seq"]): r["s"] for r in out.collect()} == {**{("a", i): float(sum(range(i, 40))) for i in range(40)}, ("b", 0): 7.0}


@pytest.mark.parametrize("kind", ["poisson", "gaussian"])
def test_chains_in_step_are_those_of_one_chain(kind):
    g = np.random.default_rng(3)
    data = [np.sort(g.random(n) * 30) if kind == "poisson" else g.normal(size=n) * 5 for n in (0, 1, 2, 60, 100)]
    ends = np.array([30.0 if kind == "poisson" else max(len(x), 1.0) for x in data])
    one = [kernels.PoissonModel(x.tolist()) if kind == "poisson" else kernels.GaussianModel(x.tolist()) for x in data]
    rows = lockstep.PoissonRows(data, 0.1, 0.1) if kind == "poisson" else lockstep.GaussianRows(data, 2.0, 2.0, 10.0)
    cfg = kernels.SamplerConfig(iterations=1500, burn_in=100, thinning=5, nu=0.4)
    got = [[] for _ in data]
    for it, _, now in lockstep.run_chains(rows, np.arange(5), np.zeros(5), ends, cfg, [samplers.generator(1, i) for i in range(5)]):
        for i, kept in enumerate(got):
            kept.append((it, now.at[i, 1 : now.k[i] + 1].tolist(), now.post[i]))
    for i, kept in enumerate(got):
        alone = kernels.run_chain(one[i], 0.0, ends[i], cfg, samplers.generator(1, i))[0]
        assert [x[:2] for x in kept] == [x[:2] for x in alone]
        assert np.allclose([x[2] for x in kept], [x[2] for x in alone])


@pytest.mark.parametrize("rising", [False, True])
def test_sample_is_that_of_chains_alone_and_in_many_tasks(spark, rising):
    g = np.random.default_rng(5)
    names = [f"s{i}" for i in range(260)]
    rows = [(n, float(x)) for i, n in enumerate(names[1:]) for x in g.random(i % 40) * 30]
    events, dim = spark.createDataFrame(rows, "series string, t double"), spark.createDataFrame([(n,) for n in names], "series string")
    cfg = kernels.SamplerConfig(iterations=60, burn_in=20, thinning=10, nu=0.1)
    out = samplers.reversible_jump(events, dim, 0.0, 30.0, cfg, chains=2, rising=rising)
    # Small inputs were put into one task.
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    got = sorted((r["series"], r["chain"], r["iteration"], list(r["theta"]), [round(x, 9) for x in r["means"]]) for r in out.collect())
    want = []
    for n in names:
        for chain in range(2):
            model, rng = kernels.PoissonModel(sorted(x for s, x in rows if s == n)), samplers.generator(1, n, chain)
            for it, theta, _ in kernels.run_chain(model, 0.0, 30.0, cfg, rng)[0]:
                ends = [0.0, *theta, 30.0]
                means = [model.draw(a, b, rng) if rising else model.mean(a, b) for a, b in zip(ends, ends[1:])]
                if not rising or kernels.monotone(means):
                    want.append((n, chain, it, theta, [round(x, 9) for x in means]))
    assert got == sorted(want)


@pytest.mark.parametrize("source", ["chain", "rejection", "prior"])
def test_windows_in_step_are_those_of_one_series(source):
    g = np.random.default_rng(7)
    times = [np.sort(g.random(n) * 20) for n in (0, 3, 40, 90)]
    cfg = kernels.SamplerConfig(burn_in=20, thinning=2, nu=0.2)
    rows, begin, n = lockstep.PoissonRows(times, 0.1, 0.1), np.zeros(4), 30
    past, k, log_w = np.full((4, n, 0), np.inf), np.zeros((4, n), np.int64), np.zeros((4, n))
    alone, seen = [([[]] * n, np.zeros(n)) for _ in times], 0
    for i in range(4):
        rng = lambda s: samplers.generator(1, s, i)  # noqa: B023, E731
        past, k, log_w, again = lockstep.smc_windows(rows, np.arange(4), times, past, k, log_w, i * 5.0, i * 5.0 + 5, begin, cfg, rng, 0.8, 5, source)
        for s, t in enumerate(times):
            own, w, resampled = kernels.smc_window(kernels.PoissonModel(t.tolist()), *alone[s], i, i * 5.0, i * 5.0 + 5, 0.0, n, cfg, rng(s), 0.8, 5, source=source)
            alone[s] = own, w
            assert [past[s, p, : k[s, p]].tolist() for p in range(n)] == own and resampled == again[s]
            assert np.allclose(log_w[s], w)
            seen += resampled
    assert seen


def test_resampling_is_exact_to_a_point_of_very_many(spark):
    w = np.exp(-(np.arange(50) % 7) / 7.0)
    w = (w / w.sum()).tolist()
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(w)], "series string, particle long, w double")
    n = 10**12
    got = [r["offspring"] for r in particles.systematic(df, ["series"], ["particle"], F.lit(n), 0.37).orderBy("particle").collect()]
    ends = [max(0, math.ceil(n * (sum(map(Fraction, w[:i])) / sum(map(Fraction, w))) - Fraction(37, 100))) for i in range(51)]
    assert got == [b - a for a, b in zip(ends, ends[1:])]
