"""Closed-form tails and two-sided masses of the predictive distribution, against plain sums."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import special
from tidemark.functions import timescale as ts
from tidemark.operators import predictive


def pmf(r, t, shape, rate):
    return math.exp(math.lgamma(shape + r) - math.lgamma(shape) - math.lgamma(r + 1) + shape * math.log(rate / (rate + t)) + r * math.log(t / (rate + t)))


CASES = [(r, t, shape, rate) for r in (0, 1, 2, 7, 40, 300) for t, shape, rate in ((1.0, 1.0, 1.0), (3.0, 4.0, 2.0), (0.01, 0.1, 5.0), (50.0, 90.0, 20.0))]


def test_tails_equal_sums(spark):
    df = spark.createDataFrame(CASES, "r long, t double, shape double, rate double")
    for x in predictive.tails(df, "r", "t", "shape", "rate").collect():
        p = [pmf(i, x["t"], x["shape"], x["rate"]) for i in range(x["r"] + 1)]
        assert x["p_lower"] == pytest.approx(sum(p) - p[-1] / 2, abs=1e-11)


def test_tails_of_large_counts(spark):
    """A million events: the terms grow with the root of the count, and the median is near a half."""
    df = spark.createDataFrame([(10**6, 1.0, 1e6, 1.0), (10**6 + 4000, 1.0, 1e6, 1.0), (10**6 - 4000, 1.0, 1e6, 1.0)], "r long, t double, shape double, rate double")
    low = [x["p_lower"] for x in predictive.tails(df, "r", "t", "shape", "rate").orderBy("r").collect()]
    assert low[1] == pytest.approx(0.5, abs=1e-3) and low[0] == pytest.approx(0.00234, abs=2e-4) and low[2] == pytest.approx(1 - low[0], abs=1e-3)


def test_beta_column_equals_array(spark):
    rng = np.random.default_rng(2)
    a, b, x = 10 ** rng.uniform(-1, 4, 200), 10 ** rng.uniform(-1, 4, 200), rng.uniform(0, 1, 200)
    df = spark.createDataFrame([(float(i), float(j), float(k)) for i, j, k in zip(a, b, x, strict=True)], "a double, b double, x double")
    got = [r[0] for r in df.select(special.beta_inc(F.col("a"), F.col("b"), F.col("x"))).collect()]
    assert np.allclose(got, special.beta_inc_array(a, b, x), atol=1e-10)


def test_two_sided_masses_equal_sums():
    for r, t, shape, rate in CASES:
        p = np.array([pmf(i, t, shape, rate) for i in range(6000)])
        up, down = np.cumsum(p), np.cumsum(p[::-1])[::-1]
        g = np.minimum(up, down)
        less, most = predictive.two_sided_masses(*(np.array([v], float) for v in (r, t, shape, rate)))
        assert less[0] == pytest.approx(p[g < g[r] * (1 - 1e-9)].sum(), rel=1e-6, abs=1e-12)
        assert most[0] == pytest.approx(p[g <= g[r] * (1 + 1e-9)].sum(), rel=1e-6, abs=1e-12)


def test_monte_carlo_converges_and_repeats(spark):
    rows = [("a", i, 0.1 + i / 20, 0.1 + i / 20 + 1e-6) for i in range(5)] + [("b", 0, 0.2, 0.4)]
    df = spark.createDataFrame(rows, "series string, j long, p_less double, p_most double")
    mid = {x["series"]: x["combined"] for x in predictive.fisher(df.withColumn("p", (F.col("p_less") + F.col("p_most")) / 2), ["series"]).collect()}
    got = {x["series"]: x["combined"] for x in predictive.monte_carlo(df, ["series"], "j", 400).collect()}
    assert got["a"] == pytest.approx(mid["a"], abs=1e-5) and got["b"] == pytest.approx(0.3, abs=0.01)
    again = {x["series"]: x["combined"] for x in predictive.monte_carlo(df.repartition(7), ["series"], "j", 400).collect()}
    assert got == pytest.approx(again, rel=1e-12)


def test_profiles_of_each_series(spark):
    steps = {"a": ts.StepFunction((0.0, 0.3), (2.0, 1.0), 1.0), "b": ts.StepFunction((0.0,), (3.0,), 1.0)}
    table = spark.createDataFrame([(s, k, h) for s, f in steps.items() for k, h in zip(f.knots, f.heights, strict=True)], "series string, knot double, height double")
    rows = spark.createDataFrame([(s, t) for s in ("a", "b", "none") for t in (0.0, 0.3, 0.31, 1.0, 1.3, 2.0, 7.9)], "series string, t double")
    got = {(x["series"], x["t"]): x["scaled"] for x in ts.profile_integral(rows, table, 1.0).collect()}
    for s, f in steps.items():
        for x in rows.where(F.col("series") == s).select("t", f.integral(F.col("t")).alias("v")).collect():
            assert got[s, x["t"]] == pytest.approx(x["v"], abs=1e-12)
    assert got["none", 7.9] == 7.9 and len(got) == 21
