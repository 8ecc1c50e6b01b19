"""Changepoints at whole numbers, samplers of windows, and the chain prior of rates."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import kernels, samplers

COUNTS = [0, 1, 0, 4, 5, 3, 1, 0]
EVENTS = [0.3, 0.5, 1.9, 2.1, 2.15, 2.2, 2.4, 2.8, 3.1, 3.3]


def test_discrete_chain_equals_enumeration():
    """All 128 sets of changepoints among 1 .. 7."""
    model, nu = kernels.CountModel([], 1.0, 1.0, None, COUNTS), 0.2
    p, at = np.zeros(8), np.zeros(8)
    for k in range(8):
        for theta in combinations(range(1, 8), k):
            cuts = [0, *theta, 8]
            x = np.exp(sum(model.loglik(a, b) for a, b in zip(cuts, cuts[1:], strict=False))) * nu**k * (1 - nu) ** (7 - k)
            p[k] += x
            at[list(theta)] += x
    cfg = kernels.SamplerConfig(iterations=200_000, burn_in=500, thinning=5, nu=nu, discrete=True)
    kept, _ = kernels.run_chain(model, 0.0, 8.0, cfg, np.random.default_rng(1))
    got = np.bincount([len(t) for _, t, _ in kept], minlength=8) / len(kept)
    assert np.abs(got - p / p.sum()).max() < 0.015
    seen = np.bincount([int(x) for _, t, _ in kept for x in t], minlength=8) / len(kept)
    assert np.abs(seen - at / p.sum()).max() < 0.02
    assert all(x == int(x) and 0 < x < 8 for _, t, _ in kept for x in t) and all(len(set(t)) == len(t) for _, t, _ in kept)


def test_discrete_chain_fills_all_places():
    kept, _ = kernels.run_chain(kernels.CountModel([], 1.0, 1.0, None, [1, 9, 1]), 0.0, 3.0, kernels.SamplerConfig(iterations=500, burn_in=0, thinning=1, nu=0.99, discrete=True), np.random.default_rng(2))
    assert max(len(t) for _, t, _ in kept) == 2


def test_discrete_log_posterior():
    model, cfg = kernels.CountModel([], 1.0, 1.0, None, COUNTS), kernels.SamplerConfig(iterations=300, burn_in=0, thinning=10, nu=0.3, discrete=True)
    for _, theta, post in kernels.run_chain(model, 0.0, 8.0, cfg, np.random.default_rng(3))[0]:
        cuts = [0.0, *theta, 8.0]
        assert post == pytest.approx(sum(model.loglik(a, b) for a, b in zip(cuts, cuts[1:], strict=False)) + len(theta) * np.log(0.3) + (7 - len(theta)) * np.log(0.7), abs=1e-9)


def test_prior_source_agrees_with_chain(spark):
    ev = spark.createDataFrame([("a", t) for t in EVENTS], "series string, t double")
    dim, cfg = ev.select("series").distinct(), kernels.SamplerConfig(nu=0.4)
    got = samplers.sequential_monte_carlo(ev, dim, 0.0, 4.0, 4, 6000, cfg, 1.0, 1.0, source="prior", threshold=0.0).where("interval = 3")
    k, n = got.agg(F.sum(F.col("w") * F.col("k")), F.first("ess")).first()
    kept, _ = kernels.run_chain(kernels.PoissonModel(EVENTS, 1.0, 1.0), 0.0, 4.0, kernels.SamplerConfig(iterations=60_000, burn_in=500, thinning=5, nu=0.4), np.random.default_rng(4))
    assert n > 100 and k == pytest.approx(np.mean([len(t) for _, t, _ in kept]), abs=0.15)


def test_rejection_source_has_one_changepoint_a_window(spark):
    """Windows short enough for one changepoint: the same posterior as the chain's."""
    ev = spark.createDataFrame([("a", t) for t in EVENTS], "series string, t double")
    dim = ev.select("series").distinct()
    got = samplers.sequential_monte_carlo(ev, dim, 0.0, 4.0, 16, 3000, kernels.SamplerConfig(nu=0.4), 1.0, 1.0, source="rejection", moves=0)
    last = got.where("interval = 15")
    k = last.agg(F.sum(F.col("w") * F.col("k"))).first()[0]
    kept, _ = kernels.run_chain(kernels.PoissonModel(EVENTS, 1.0, 1.0), 0.0, 4.0, kernels.SamplerConfig(iterations=60_000, burn_in=500, thinning=5, nu=0.4), np.random.default_rng(4))
    assert k == pytest.approx(np.mean([len(t) for _, t, _ in kept]), abs=0.25)
    assert all(len({int(x * 4) for x in r["theta"]}) == r["k"] for r in last.collect())


def test_rejection_of_many_series(spark):
    """Each series' draws are the same however series are put together, empty series too."""
    ev = spark.createDataFrame([(f"s{i}", t + i / 100) for i in range(6) for t in EVENTS], "series string, t double")
    dim = ev.select("series").distinct().union(spark.createDataFrame([("empty",)], "series string"))
    rows = [{(r["series"], r["particle"]): (tuple(r["theta"]), r["acceptance"]) for r in samplers.rejection_sample(ev, dim, 0.0, 4.0, 0.5, 25, together=n).collect()} for n in (1, 100)]
    assert rows[0] == rows[1] and len(rows[0]) == 175 and all(0 < a <= 1 for _, a in rows[0].values())


def test_chain_prior_moments(spark):
    """Each rate has the mean of the first, and its variance grows by the chain's with each step."""
    p = spark.range(20_000).selectExpr("'a' AS series", "id AS particle", "3 AS k")
    rates = np.array([r["rates"] for r in samplers.chain_prior(p, first=(90.0, 3.0)).collect()])
    assert rates.shape == (20_000, 4)
    for i in range(4):
        assert rates[:, i].mean() == pytest.approx(30, abs=0.15) and rates[:, i].var() == pytest.approx(10 + 5 * i, rel=0.06)


def test_mean_place():
    """Against a sum over the gap, for flat, gentle and steep slopes both ways."""
    x = np.linspace(2, 5, 200_001)
    for slope in (0.0, 1e-5, 3e-4, 0.5, -0.5, 40.0, -40.0):
        w = np.exp(slope * (x - (5 if slope > 0 else 2)))
        assert samplers.mean_place(2, 5, slope) == pytest.approx((w * x).sum() / w.sum(), abs=1e-4)
    assert samplers.mean_place(2, 5, 1e6) == pytest.approx(5) and samplers.mean_place(2, 5, -1e6) == pytest.approx(2)


def test_smoothed_map(spark):
    """A moved position lies inside the gap that the sharp one is at the edge of; one without a better edge stays."""
    times = [1.0, 1.1, 1.2, 1.3, 1.4, 1.5, 6.0, 9.0]
    ev = spark.createDataFrame([("a", t) for t in times] + [("empty", 20.0)], "series string, t double").where("t < 10")
    best = spark.createDataFrame([("a", [1.7]), ("empty", []), ("none", [5.0])], "series string, theta array<double>")
    sharp, smooth = ({r["series"]: r for r in samplers.polish_map(best, ev, 0.0, 10.0, smoothing=s).collect()} for s in (False, True))
    assert sharp["a"]["theta"][0] == pytest.approx(1.5) and 1.5 < smooth["a"]["theta"][0] < 6.0
    model = kernels.PoissonModel(times)
    at = sharp["a"]["theta"][0]
    assert smooth["a"]["theta"][0] == pytest.approx(samplers.mean_place(1.5, 6.0, model.mean(at, 10.0) - model.mean(0.0, at)))
    assert smooth["a"]["log_lik"] < sharp["a"]["log_lik"] and smooth["none"]["theta"] == sharp["none"]["theta"] == [5.0] and smooth["empty"]["theta"] == []


def test_no_empty_neighbours():
    """No sample holds two segments without events next to each other; without the filter some do."""
    t = [1.0, 1.1, 1.2, 8.0, 8.1]
    pairs = []
    for flag in (True, False):
        kept, _ = kernels.run_chain(kernels.PoissonModel(t), 0.0, 10.0, kernels.SamplerConfig(iterations=4000, burn_in=0, thinning=1, nu=0.6, no_empty_neighbours=flag), np.random.default_rng(1))
        ends = [[0.0, *theta, 10.0] for _, theta, _ in kept]
        n = [np.diff(np.searchsorted(t, e)) for e in ends]
        pairs.append(sum(bool(((c[1:] == 0) & (c[:-1] == 0)).any()) for c in n))
    assert pairs[0] == 0 < pairs[1]
