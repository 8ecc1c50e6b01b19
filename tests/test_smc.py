"""Sequential Monte Carlo: shot noise, streams, budgets; truncated Gamma jumps."""

import math
import pickle

import numpy as np
import pytest

from tidemark.functions import special
from tidemark.operators import kernels, samplers
from tidemark.operators import shots as shots_in_step
from tidemark.operators.lockstep import PoissonRows
from tidemark.plans import sampled
from tidemark.streaming import smc

CASES = [(3.5, 2.0, 0.8), (1.0, 2.0, 0.01), (60.0, 1.0, 5.0), (40.0, 3.0, 200.0), (400.0, 1.0, 1.0)]


@pytest.mark.parametrize(("a", "rate", "upper"), CASES)
def test_truncated_gamma(a, rate, upper):
    """The density integrates to one, also far out in the tail, and draws follow it."""
    x = np.linspace(0, min(upper, 5 * a / rate), 20_001)[1:]
    density = np.exp([special.log_truncated_gamma_density(v, a, rate, upper) for v in x])
    assert np.trapezoid(density, x) == pytest.approx(1, abs=1e-3)
    rng = np.random.default_rng(3)
    draws = np.array([special.truncated_gamma(a, rate, upper, rng) for _ in range(4000)])
    assert (draws > 0).all() and (draws < upper).all()
    assert draws.mean() == pytest.approx(np.trapezoid(x * density, x), abs=5 * draws.std() / 60)


def test_log_gamma_p_where_it_underflows():
    assert special.log_gamma_p(400.0, 1.0) == pytest.approx(-1 - math.lgamma(401) + math.log(sum(math.exp(-sum(math.log(400 + j) for j in range(1, k + 1))) for k in range(20))), rel=1e-12)
    assert math.exp(special.log_gamma_p(2.5, 3.0)) == pytest.approx(special.gamma_p(2.5, 3.0), rel=1e-12)


def shots(seed=4):
    """Events of a rate that decays with 0.4 and jumps to 6 at 0 and by 8 at 5."""
    rng = np.random.default_rng(seed)
    t = np.sort(rng.uniform(0, 10, 400))
    height = np.where(t < 5, 6 * np.exp(-0.4 * t), 6 * np.exp(-0.4 * t) + 8 * np.exp(-0.4 * (t - 5)))
    return t[rng.uniform(0, 20, 400) < height / 2].tolist()


def moments(kept):
    return np.mean([len(x[1]) for x in kept]), np.mean([x[2][0] for x in kept]), np.mean([x[2][-1] * math.exp(-0.4 * (10 - (x[1][-1] if x[1] else 0))) for x in kept])


def test_shot_noise_without_changepoints_is_exact():
    """With almost no changepoints the first height is Gamma(r + 1, alpha + (1 - exp(-kappa T)) / kappa)."""
    t = shots()[:25]
    kept = kernels.run_shot_noise(t, 0.0, 10.0, kernels.SamplerConfig(iterations=20_000, thinning=2, nu=1e-12), 0.5, 0.4, np.random.default_rng(1))
    rate = 0.5 + (1 - math.exp(-4)) / 0.4
    h = [x[2][0] for x in kept]
    assert np.mean(h) == pytest.approx(26 / rate, rel=0.02) and np.std(h) == pytest.approx(math.sqrt(26) / rate, rel=0.06)


def test_proposals_of_jumps_agree_and_gamma_heights_are_taken_more_often():
    t, got, taken = shots(), {}, {}
    for jumps in ("gamma", "prior"):
        counts = {}
        got[jumps] = moments(kernels.run_shot_noise(t, 0.0, 10.0, kernels.SamplerConfig(iterations=60_000, burn_in=2000, thinning=5, nu=0.2, jumps=jumps), 0.3, 0.4, np.random.default_rng(2), counts))
        taken[jumps] = counts["height_taken"] / counts["height"]
    assert got["gamma"] == pytest.approx(got["prior"], rel=0.12)
    assert taken["gamma"] > 1.3 * taken["prior"]


def test_shot_noise_moves_keep_the_log_posterior():
    """The running log posterior equals the one from the beginning."""
    t, cfg = shots(), kernels.SamplerConfig(iterations=3000, burn_in=0, thinning=50, nu=0.3)
    for _, tau, h, post in kernels.run_shot_noise(t, 0.0, 10.0, cfg, 0.3, 0.4, np.random.default_rng(7)):
        cuts, before = [0.0, *tau, 10.0], 0.0
        total = len(tau) * math.log(cfg.nu)
        for a, b, x in zip(cuts, cuts[1:], h, strict=False):
            total += kernels.shot_noise_loglik(sum(a <= v < b for v in t), a, b - a, x, 0.4) + math.log(0.3) - 0.3 * (x - before)
            assert x - before > 0
            before = x * math.exp(-0.4 * (b - a))
        assert total == pytest.approx(post, abs=1e-6)


@pytest.mark.parametrize(("a", "rate", "upper"), [*CASES, (60.0, 1.0, 59.0), (1.0, 2.0, math.inf)])
def test_truncated_gammas_in_arrays(a, rate, upper):
    x = np.linspace(0, min(upper, 20 * a / rate), 20_001)[1:]
    logs = (a - 1) * np.log(x) - rate * x
    density = np.exp(logs - logs.max())
    n = 20_000
    draws = shots_in_step.truncated_gammas(*(np.full(n, v) for v in (a, rate, upper)), np.arange(n), shots_in_step.Streams(np.arange(n, dtype=np.uint64) * np.uint64(2**40 + 1)))
    assert (draws > 0).all() and (draws < upper).all()
    assert draws.mean() == pytest.approx((x * density).sum() / density.sum(), abs=4 * draws.std() / math.sqrt(n))


def test_log_gamma_ps():
    g = np.random.default_rng(1)
    a, x = g.uniform(1, 90, 400), g.uniform(0.01, 200, 400)
    assert np.allclose(special.log_gamma_ps(a, x), [special.log_gamma_p(*v) for v in zip(a.tolist(), x.tolist(), strict=True)], rtol=1e-9, atol=1e-13)


def test_shots_in_step_follow_the_law_of_one_series():
    """Means over many series of equal events are those of shot_noise_window, and a series' rows are the same beside others as alone."""
    t, cfg, n = np.array(shots()[:60]), kernels.SamplerConfig(burn_in=50, thinning=3, nu=0.3), 40
    rng = lambda s, i: samplers.generator(1, s, i)
    run = lambda m, of: list(shots_in_step.shot_windows(PoissonRows([t[: len(t) - s % 2 * 20] for s in of], 1.0, 1.0), 0.0, 3.0, 3, n, cfg, 0.3, 0.4, lambda s, i: rng(of[s], i), 0.5, 5))
    many, alone = run(80, list(range(0, 160, 2)) + [1]), run(1, [1])
    for (_, at, h, k, w, again), (_, own, own_h, own_k, own_w, own_again) in zip(many, alone, strict=True):
        assert (k[-1] == own_k[0]).all() and again[-1] == own_again[0] and np.allclose(w[-1], own_w[0])
        inside = np.arange(own.shape[2]) <= own_k[0][:, None]
        assert np.allclose(at[-1, :, : own.shape[2]][inside], own[0][inside]) and np.allclose(h[-1, :, : own.shape[2]][inside], own_h[0][inside])
    _, at, h, k, w, _ = many[-1]
    w = np.exp(w - w.max(axis=1, keepdims=True))
    share = lambda x: ((w * x).sum(axis=1) / w.sum(axis=1))[:80]
    last = np.take_along_axis(h, k[:, :, None], 2)[:, :, 0] * np.exp(-0.4 * (9 - np.take_along_axis(at, k[:, :, None], 2)[:, :, 0]))
    got, want = [share(k), share(last)], [[], []]
    for s in range(80):
        past, v = [], np.zeros(n)
        for i in range(3):
            past, v, _ = kernels.shot_noise_window(t.tolist(), past, v, i, i * 3.0, i * 3.0 + 3, n, cfg, 0.3, 0.4, rng(1000 + s, i), 0.5, 5)
        v = np.exp(v - v.max())
        want[0].append((v * [len(x) - 1 for x, _ in past]).sum() / v.sum())
        want[1].append((v * [y[-1] * math.exp(-0.4 * (9 - x[-1])) for x, y in past]).sum() / v.sum())
    for a, b in zip(got, want, strict=True):
        assert np.mean(a) == pytest.approx(np.mean(b), abs=4 * math.hypot(np.std(a), np.std(b)) / math.sqrt(80))


def test_shot_noise_smc_agrees_with_chain(spark):
    t = shots()
    ev = spark.createDataFrame([("a", x) for x in t], "series string, t double")
    dim = spark.createDataFrame([("a",), ("empty",)], "series string")
    got = samplers.shot_noise_smc(ev, dim, 0.0, 10.0, 4, 1500, kernels.SamplerConfig(burn_in=500, thinning=4, nu=0.2), 0.3, 0.4, moves=30)
    assert got.groupBy("series", "interval").count().count() == 8
    rows = got.where("series = 'a' AND interval = 3").collect()
    smc_k = sum(r["w"] * r["k"] for r in rows)
    smc_end = sum(r["w"] * r["heights"][-1] * math.exp(-0.4 * (10 - (r["theta"][-1] if r["theta"] else 0))) for r in rows)
    k, _, end = moments(kernels.run_shot_noise(t, 0.0, 10.0, kernels.SamplerConfig(iterations=100_000, burn_in=2000, thinning=5, nu=0.2), 0.3, 0.4, np.random.default_rng(5)))
    assert smc_k == pytest.approx(k, abs=0.3) and smc_end == pytest.approx(end, rel=0.15)


def test_budget_is_spent_where_scores_are_large(spark):
    rng = np.random.default_rng(9)
    busy = [("busy", float(t)) for t in np.sort(np.r_[rng.uniform(0, 1, 40), rng.uniform(3, 4, 40)])]
    ev = spark.createDataFrame([*busy, ("calm", 2.0)], "series string, t double")
    dim = spark.createDataFrame([("busy",), ("calm",), ("empty",)], "series string")
    drawn = samplers.budgeted_windows(ev, dim, 0.0, 4.0, 2, 301, 20, kernels.SamplerConfig(burn_in=100, thinning=5, nu=0.5), 10, 3, 1.0, 1.0)
    n = {(r["series"], r["interval"]): r["count"] for r in drawn.groupBy("series", "interval").count().collect()}
    assert all(sum(n[s, i] for s in ("busy", "calm", "empty")) == 361 for i in (0, 1)) and min(n.values()) >= 20
    assert drawn.groupBy("series", "interval", "particle").count().where("count > 1").isEmpty()
    smc_rows = samplers.sequential_monte_carlo(ev, dim, 0.0, 4.0, 2, 50, kernels.SamplerConfig(burn_in=100, thinning=2, nu=0.5), 1.0, 1.0, fresh=drawn, threshold=0.0)
    assert {(r["series"], r["interval"]): r["count"] for r in smc_rows.groupBy("series", "interval").count().collect()} == n
    # Without resampling, the particles of the first window are the ones that were scored.
    first = lambda df: sorted(tuple(r["theta"]) for r in df.where("series = 'busy' AND interval = 0").collect())
    assert first(smc_rows) == first(drawn)


def test_water_level_equals_one_at_a_time(spark):
    rng = np.random.default_rng(3)
    extent, seen = 10 ** rng.uniform(0, 6, 60), rng.integers(1, 30, 60)
    rows = spark.createDataFrame([(f"s{i:02}", 0, float(e), int(n)) for i, (e, n) in enumerate(zip(extent, seen, strict=True))], "series string, interval int, extent double, seen long")
    got = {r["series"]: r["more"] for r in samplers.water_level(rows, 500).collect()}
    n = seen.astype(float)
    for _ in range(500):
        n[np.argmax(extent / n)] += 1
    assert sum(got.values()) == 500
    assert all(abs(got[f"s{i:02}"] - (n[i] - seen[i])) <= 1 for i in range(60))


HOW = smc.Windows(width=1.0, intervals=4, n=40, cfg=kernels.SamplerConfig(burn_in=50, thinning=2, nu=0.5), alpha=1.0, beta=1.0)


def test_filter_forgets_without_changing(monkeypatch):
    """Counts of forgotten events stand in for them."""
    t = sorted(np.random.default_rng(4).uniform(0, 4, 60).tolist())

    def rows():
        f = smc.Filter("a", HOW, 0)
        return [f.advance([x for x in t if i <= x < i + 1]) for i in range(4)], len(f.t)

    short, kept = rows()
    monkeypatch.setattr(smc.Filter, "_forget", lambda self, b: None)
    whole, all_kept = rows()
    assert short == whole and kept <= all_kept == 60


@pytest.mark.parametrize("spacing", [0.0, 0.05])
def test_series_of_a_group_are_sampled_side_by_side(spacing):
    """A stream's timer samples all series of its group at once; rows are those of each series alone."""
    how = smc.Windows(**{**HOW.__dict__, "cfg": kernels.SamplerConfig(burn_in=50, thinning=2, nu=0.5, spacing=spacing)})
    rng = np.random.default_rng(8)
    times = {f"s{i}": np.sort(rng.uniform(i % 4, 4, 1 + i * 7 % 40)) for i in range(20)}
    cut = lambda t, i: t[(t >= i) & (t < i + 1)]
    group, got = smc.filters(how), []
    assert isinstance(group, smc.Apart if spacing else smc.Filters)
    for i in range(4):
        group = pickle.loads(pickle.dumps(group))
        got += group.advance(i, {s: cut(t, i) for s, t in times.items() if len(cut(t, i))}).itertuples(index=False, name=None)
    want = []
    for s, t in times.items():
        own = smc.Filter(s, how, int(t[0]))
        want += [own.advance(cut(t, i).tolist()) for i in range(int(t[0]), 4)]
        assert spacing or len(group.times[group.row[s]]) == len(own.t)
    assert sorted(got) == sorted(want)


def test_late_series_is_observed_from_its_first_event():
    f = smc.Filter("late", HOW, 2)
    assert f.begin == 2.0 and all(x < 2 for p in f.past for x in p)
    row = f.advance([2.1, 2.2, 2.3])
    # The time before counts for nothing: all weights of the first window are equal.
    assert row[1] == 2 and row[4] == pytest.approx(HOW.n)


def test_stream_in_any_order_equals_replay(spark, tmp_path):
    """Two files, the second one with events from before the first one's last, within the delay; then one that is too late."""
    rng = np.random.default_rng(6)
    t = {s: np.sort(rng.uniform(lo, 4, 25)) for s, lo in (("a", 0.0), ("b", 1.4), ("c", 3.2))}
    every = [(s, float(x)) for s, v in t.items() for x in v]
    rng.shuffle(every)
    every = [(str(s), float(x)) for s, x in every]
    parts = [[e for e in every if e[1] < 1.5], [e for e in every if 1.5 <= e[1] < 3], [e for e in every if e[1] >= 3], [("a", 0.05)]]
    # An event of the first part comes with the second.
    parts[1].append(parts[0].pop())
    day = "timestamp_millis(CAST(t * 86400000 AS BIGINT) + 1704067200000)"
    for i, part in enumerate(parts):
        spark.createDataFrame(part, "series string, t double").selectExpr("series", f"{day} AS ts", "t").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    spark.sql("SELECT CAST(NULL AS STRING) AS series, TIMESTAMP'2024-02-02 00:00:00' AS ts, CAST(NULL AS DOUBLE) AS t").write.parquet(f"{tmp_path}/in/9")

    source = spark.readStream.schema("series string, ts timestamp, t double").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in/*")
    smc.particles(source, HOW, 1704067200000, delay="36 hours").writeStream.format("parquet").option("path", f"{tmp_path}/rows").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, spark.read.schema(smc.ROWS).parquet(f"{tmp_path}/rows").collect()))
    kept = spark.createDataFrame([e for p in parts[:3] for e in p], "series string, t double")
    assert got == sorted(map(tuple, smc.replay(kept, HOW).collect()))
    assert [r[1] for r in got if r[0] == "b"] == [1, 2, 3] and [r[1] for r in got if r[0] == "c"] == [3]


def test_registered_stream_equals_replay(spark):
    sf = "/root/testdata/sf0.001"
    assert sorted(map(tuple, sampled.smc_stream(spark, sf).collect())) == sorted(map(tuple, sampled.smc_replay(spark, sf).collect()))
