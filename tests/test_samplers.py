"""Laws of the samplers: against quadrature, the prior, and each other."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import special
from tidemark.operators import kernels, particles, samplers
from tidemark.sources import text

EVENTS = [0.3, 0.4, 0.55, 0.6, 0.7, 2.1, 3.3]
END, NU = 4.0, 0.3


def exact_pk(nu=NU):
    """P(k) for k <= 1, by quadrature."""
    m = kernels.PoissonModel(EVENTS, 1.0, 1.0)
    x = (np.arange(4000) + 0.5) / 4000 * END
    one = np.mean([math.exp(m.loglik(0, t) + m.loglik(t, END)) for t in x]) * END * nu
    zero = math.exp(m.loglik(0, END))
    return zero / (zero + one)


def test_chain_matches_quadrature():
    cfg = kernels.SamplerConfig(iterations=60_000, burn_in=1000, thinning=2, nu=NU, max_changepoints=1, move_width=0.5)
    kept, _ = kernels.run_chain(kernels.PoissonModel(EVENTS, 1.0, 1.0), 0.0, END, cfg, np.random.default_rng(1))
    assert abs(np.mean([not t for _, t, _ in kept]) - exact_pk()) < 0.02


@pytest.mark.parametrize("kind", ["normal", "mixture", "histogram"])
def test_location_proposals(kind):
    cfg = kernels.SamplerConfig(iterations=60_000, burn_in=1000, thinning=2, nu=NU, max_changepoints=1, move_width=0.5, proposal=kind, proposal_normal=(1.0, 1.0), proposal_bins=(3, 2, 1, 1))
    kept, _ = kernels.run_chain(kernels.PoissonModel(EVENTS, 1.0, 1.0), 0.0, END, cfg, np.random.default_rng(1))
    assert abs(np.mean([not t for _, t, _ in kept]) - exact_pk()) < 0.02


def test_monotone():
    assert kernels.monotone([1, 1, 2]) and not kernels.monotone([2, 1])


def test_rejection_matches_quadrature():
    # The sampler's prior keeps the first changepoint only: P(0) e^(-nu T), density nu e^(-nu t).
    m = kernels.PoissonModel(EVENTS, 1.0, 1.0)
    x = (np.arange(4000) + 0.5) / 4000 * END
    one = np.mean([NU * math.exp(-NU * t + m.loglik(0, t) + m.loglik(t, END)) for t in x]) * END
    zero = math.exp(-NU * END + m.loglik(0, END))
    draws, _ = kernels.rejection(m, 0.0, END, NU, 6000, np.random.default_rng(2))
    assert abs(np.mean([not d for d in draws]) - zero / (zero + one)) < 0.02


def test_flat_likelihood_gives_prior():
    cfg = kernels.SamplerConfig(iterations=60_000, burn_in=1000, thinning=3, nu=0.5)
    kept, _ = kernels.run_chain(kernels.PoissonModel([], 1e-9, 1.0), 0.0, 4.0, cfg, np.random.default_rng(3))
    assert abs(np.mean([len(t) for _, t, _ in kept]) - 2.0) < 0.1


def test_gaussian_recovers_changepoint(spark):
    y = text.simulate_gaussian(spark, 200, [100], [-5, 5], [1, 1], 7)
    s = samplers.reversible_jump(y, y.select("series").distinct(), 0.0, 200.0, kernels.SamplerConfig(iterations=4000, burn_in=1000, nu=0.01), "gaussian", alpha=2.0, beta=2.0)
    first = [r["theta"][0] for r in s.where("k >= 1").collect()]
    assert len(first) > 300 and abs(np.median(first) - 99.5) < 2


def test_same_rows_under_any_partitioning(spark):
    ev = spark.createDataFrame([(s, t + i) for i, s in enumerate("abc") for t in EVENTS], "series string, t double")
    dim = spark.createDataFrame([("a",), ("b",), ("c",), ("empty",)], "series string")
    cfg = kernels.SamplerConfig(iterations=200, burn_in=50, nu=NU)
    a, b = (sorted(map(str, samplers.reversible_jump(e, dim, 0.0, 6.0, cfg).collect())) for e in (ev.repartition(1), ev.repartition(7)))
    assert a == b and any("empty" in x for x in a)


def test_smc_agrees_with_chain(spark):
    ev = spark.createDataFrame([("a", t) for t in EVENTS], "series string, t double")
    dim = ev.select("series").distinct()
    cfg = kernels.SamplerConfig(iterations=40_000, burn_in=500, thinning=4, nu=NU)
    smc = samplers.sequential_monte_carlo(ev, dim, 0.0, END, 4, 2000, kernels.SamplerConfig(burn_in=200, thinning=3, nu=NU), 1.0, 1.0)
    k = smc.where("interval = 3").agg(F.sum(F.col("w") * F.col("k"))).first()[0]
    kept, _ = kernels.run_chain(kernels.PoissonModel(EVENTS, 1.0, 1.0), 0.0, END, cfg, np.random.default_rng(5))
    assert abs(k - np.mean([len(t) for _, t, _ in kept])) < 0.15
    s = samplers.interval_summary(smc).collect()
    assert all(1 <= r["ess"] <= 2000.001 for r in s)


@pytest.mark.parametrize("kind", ["gaussian", "counts"])
def test_smc_of_other_models_agrees_with_chain(spark, kind):
    rng = np.random.default_rng(8)
    values = np.r_[rng.normal(0, 1, 12), rng.normal(2.5, 1, 12)].round(2) if kind == "gaussian" else np.r_[rng.poisson(1, 12), rng.poisson(4, 12)]
    name = "y" if kind == "gaussian" else "n"
    rows = spark.createDataFrame([("a", i, float(v) if name == "y" else int(v)) for i, v in enumerate(values)], f"series string, seq long, {name} {'double' if name == 'y' else 'long'}")
    dim, prior = rows.select("series").distinct(), (2.0, 2.0) if kind == "gaussian" else (1.0, 1.0)
    smc = samplers.sequential_monte_carlo(rows, dim, 0.0, 24.0, 4, 1500, kernels.SamplerConfig(burn_in=200, thinning=3, nu=0.08), *prior, kind=kind, v=10.0)
    k = smc.where("interval = 3").agg(F.sum(F.col("w") * F.col("k"))).first()[0]
    model = kernels.GaussianModel(values.tolist(), *prior, 10.0) if kind == "gaussian" else kernels.CountModel([], *prior, None, values.tolist())
    kept, _ = kernels.run_chain(model, 0.0, 24.0, kernels.SamplerConfig(iterations=40_000, burn_in=500, thinning=4, nu=0.08), np.random.default_rng(5))
    assert abs(k - np.mean([len(t) for _, t, _ in kept])) < 0.25


def test_smc_spacing(spark):
    ev = spark.createDataFrame([("a", t) for t in EVENTS], "series string, t double")
    got = samplers.sequential_monte_carlo(ev, ev.select("series").distinct(), 0.0, END, 4, 300, kernels.SamplerConfig(burn_in=100, thinning=2, nu=2.0, spacing=0.4), 1.0, 1.0, moves=0, threshold=0.0)
    near = got.where("w > 0").collect()
    assert near and all(b - a >= 0.4 - 1e-12 for r in near for a, b in zip(r["theta"], r["theta"][1:], strict=False))


def test_rising_rates(spark):
    ev = spark.createDataFrame([("a", t) for t in EVENTS], "series string, t double")
    cfg = kernels.SamplerConfig(iterations=6000, burn_in=200, nu=NU)
    got = samplers.reversible_jump(ev, ev.select("series").distinct(), 0.0, END, cfg, alpha=1.0, beta=1.0, rising=True).collect()
    assert 50 < len(got) < 600 and all(a <= b for r in got for a, b in zip(r["means"], r["means"][1:], strict=False))


def test_smc_with_sizes(spark):
    ev = spark.createDataFrame([("busy", i / 20) for i in range(70)] + [("calm", 2.0)], "series string, t double")
    dim = spark.createDataFrame([("busy",), ("calm",), ("empty",)], "series string")
    sizes = spark.createDataFrame([("busy", 0, 30), ("busy", 1, 70), ("calm", 1, 25), ("calm", 0, 20)], "series string, interval int, n long")
    smc = samplers.sequential_monte_carlo(ev, dim, 0.0, END, 2, 50, kernels.SamplerConfig(burn_in=100, thinning=2, nu=0.5), 1.0, 1.0, sizes=sizes)
    n = {(r["series"], r["interval"]): r["count"] for r in smc.groupBy("series", "interval").count().collect()}
    assert n == {(r["series"], r["interval"]): r["n"] for r in sizes.collect()} | {("empty", 0): 50, ("empty", 1): 50}


def test_rate_draws(spark):
    seg = spark.range(4000).selectExpr("'a' AS series", "CAST(id AS INT) AS j", "7 AS r", "2.0D AS length")
    a, b = (sorted((r["j"], r["rate"]) for r in samplers.draw_rates(x, ["series", "j"], alpha=1.0, beta=1.0).collect()) for x in (seg, seg.repartition(7)))
    assert a == b
    rates = np.array([v for _, v in a])
    assert abs(rates.mean() - 8 / 3) < 0.06 and abs(rates.var() - 8 / 9) < 0.1
    drawn = [r["rate"] for r in samplers.draw_rates(seg, ["series", "j"], alpha=2.0, beta=4.0, prior=True).collect()]
    assert abs(np.mean(drawn) - 0.5) < 0.03


def test_chain_of_series_with_their_own_ends(spark):
    rows = spark.createDataFrame([(s, i, float(i)) for s, n in (("a", 10), ("b", 30)) for i in range(n)], "series string, seq long, y double")
    dim = spark.createDataFrame([("a", 10.0), ("b", 30.0)], "series string, end double")
    got = samplers.reversible_jump(rows, dim, 0.0, 0.0, kernels.SamplerConfig(iterations=2000, burn_in=100, nu=0.5), "gaussian", alpha=2.0, beta=2.0)
    top = {r[0]: r[1] for r in got.where("k > 0").groupBy("series").agg(F.max(F.element_at("theta", -1))).collect()}
    assert top["a"] < 10 < top["b"] < 30


def test_average_chi_square_follows_its_loop(spark):
    """The criterion kept up to date sample by sample."""
    from tidemark.operators import histogram

    bins = np.random.default_rng(4).integers(0, 12, 60).tolist()
    c = lambda k: special.chi2_quantile(0.95, k - 1) / 2 if k > 1 else 0.0
    seen, rate, initial = set(), 0.0, None
    for i, x in enumerate(bins, 1):
        seen.add(x)
        if i == 10:
            initial = len(seen)
        rate = (len(seen) - initial) / (i - 10) if i > 10 else 0.0
    want = (c(len(seen)) + 60 * rate * (c(len(seen) + 1) - c(len(seen)))) / 60 / 61
    scored = spark.createDataFrame([("a", len(seen), 60.0)], "series string, n_bins long, total double")
    early = spark.createDataFrame([("a", initial, 10.0)], "series string, bins_0 long, total_0 double")
    q = special.chi2_quantiles(spark.createDataFrame([(len(seen) - 1,), (len(seen),)], "dof long"), 0.95)
    assert histogram.chi_square_average(scored, early, ["series"], q).first()["chi_square_average"] == pytest.approx(want, rel=1e-9)


def test_greedy_duplication_equals_loop(spark):
    w = np.random.default_rng(7).random(12)
    w /= w.sum()
    copies = np.ones(12, int)
    for _ in range(25):
        copies[np.argmax(w * w / (copies * (copies + 1)))] += 1
    rows = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(w)], "series string, particle long, w double")
    got = {r["particle"]: r["copies"] for r in particles.greedy_duplication(rows, ["series"], 25).collect()}
    assert got == dict(enumerate(copies.tolist()))


def test_offspring_add_up():
    w = np.random.default_rng(4).random(50)
    assert kernels.systematic_counts(w, 200, 0.3).sum() == 200


def test_greedy_allocation_equals_loop(spark):
    rng = np.random.default_rng(6)
    d = {p: rng.random(30).round(3).tolist() for p in "abcd"}
    at, n = dict.fromkeys(d, 0), 40
    for _ in range(n):
        p = max((p for p in d if at[p] < 30), key=lambda p: (d[p][at[p]], -ord(p)))
        at[p] += 1
    rows = [(p, i, v) for p, vs in d.items() for i, v in enumerate(vs)]
    got = dict(particles.greedy_allocation(spark.createDataFrame(rows, "process string, step int, score double"), n).collect())
    assert got == at


def test_special_functions(spark):
    xs = [0.05, 0.5, 1.0, 2.5, 10.0, 1000.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(special.lgamma(F.col("x"))).collect()
    assert [r[0] for r in got] == pytest.approx([math.lgamma(x) for x in xs], rel=1e-12, abs=1e-12)
    assert special.gamma_p(2.0, special.gamma_p_inverse(2.0, 0.3)) == pytest.approx(0.3)
    assert special.chi2_quantile(0.95, 3) == pytest.approx(7.814728, abs=1e-5)
    assert special.harmonic_digamma(100) == pytest.approx(4.600161852738087)
