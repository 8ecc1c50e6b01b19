"""Registered queries: each applies an operator to the star-schema tables.

Doubles are rounded to six places and integers are longs, so that results compare by value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import models as m
from tidemark.functions import timescale as ts
from tidemark.functions.special import chi2_quantiles
from tidemark.operators import grid, histogram, particles, predictive, series
from tidemark.sources import text
from tidemark.sources.tables import event_series, order_counts, series_of

#: A season profile of one day, and the time range in days.
TREND = ts.StepFunction((0.0, 10.0, 20.0), (1.0, 1.5, 0.75), 40.0)
SEASON = ts.StepFunction((0.0, 0.3314, 0.765), (1.0, 5.2, 4.1), 1.0)
END, SEGMENTS = 30.0, 10
#: Days in a bucket of two-level running sums.
BUCKET = 1.0
ALPHA = BETA = 0.1
#: Digits that are rounded to before the ones that are shown.
FIRST_DIGITS = {6: 12}
#: Particle numbers in a bucket of two-level ranks.
PARTICLES = 1000


def final(df: DataFrame, digits: int = 6) -> DataFrame:
    def shown(name: str, kind: str):
        if kind in ("double", "float"):
            # More digits first: what is a tie but for the last bits rounds as the tie does.
            x = F.col(name).cast("double")
            return F.round(F.round(x, FIRST_DIGITS[digits]) if digits in FIRST_DIGITS else x, digits).alias(name)
        if kind in ("int", "smallint", "tinyint"):
            return F.col(name).cast("long").alias(name)
        if kind.startswith("array"):
            return F.array_join(F.col(name).cast("array<string>"), ",").alias(name)
        return F.col(name)

    return df.select(*[shown(n, k) for n, k in df.dtypes])


def segments(spark: SparkSession, d: str, key: str = "event_type") -> DataFrame:
    ev = event_series(spark, d, key)
    return series.segment_counts(ev, series.even_cuts(series_of(ev), 0.0, END, SEGMENTS), BUCKET)


def value_segments(spark: SparkSession, d: str) -> DataFrame:
    """Count, sum and sum of squares of the values in each segment."""
    ev = event_series(spark, d)
    return ev.withColumn("j", F.floor(F.col("t") / 3).cast("int")).groupBy("series", "j").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))


def pseudo_particles(spark: SparkSession, d: str) -> DataFrame:
    """The events of a user and three days as a particle on [0, 3), by event type, with a weight."""
    ev = event_series(spark, d).withColumn("block", F.floor(F.col("t") / 3))
    p = ev.groupBy("series", (F.col("user_id") * 100 + F.col("block")).cast("long").alias("particle")).agg(F.array_sort(F.collect_list(F.col("t") - F.col("block") * 3)).alias("theta"))
    return p.withColumns({"k": F.size("theta"), "log_w": -(F.col("particle") % 7) / 7.0})


def binned(spark: SparkSession, d: str, component: str = "all") -> DataFrame:
    return pseudo_particles(spark, d).withColumn("bins", histogram.particle_bins(F.col("theta"), 0.0, 3.0, 6, component))


def particle_segments(spark: SparkSession, d: str) -> DataFrame:
    """The particles' segments with normalised weights and a rate of (j + 1) / 2."""
    w = particles.normalised(pseudo_particles(spark, d), ["series"])
    ends = F.concat(F.array(F.lit(0.0)), F.col("theta"), F.array(F.lit(3.0)))
    s = w.withColumn("_e", ends).select("series", "particle", "w", "_e", F.posexplode(F.slice(F.col("_e"), 1, F.size("_e") - 1)).alias("j", "tau_l"))
    return s.select("series", "particle", "w", "j", "tau_l", F.element_at("_e", F.col("j") + 2).alias("tau_r"), ((F.col("j") + 1) / 2).alias("mean"))


# Data operators


def distinct_values(spark, d):
    return final(event_series(spark, d).groupBy("series").agg(F.countDistinct("value").alias("n_values"), F.min("t").alias("t_min"), F.max("t").alias("t_max")))


def prefix_sum(spark, d):
    ev = event_series(spark, d)
    out = series.running_sum(ev, {"s": F.col("value"), "ss": F.col("value") * F.col("value")}, BUCKET, order=("t", "seq"))
    return final(out.select("series", "seq", "s", "ss"), 4)


def undo_prefix_sum(spark, d):
    ev = event_series(spark, d)
    s = series.running_sum(ev, {"s": F.lit(1)}, BUCKET, order=("t", "seq"))
    back = series.previous(s, "s", "before", BUCKET, order=("t", "seq"))
    return final(back.select("series", "seq", (F.col("s") - F.coalesce("before", F.lit(0))).alias("x"), "s"))


def suffix_sum(spark, d):
    ev = event_series(spark, d)
    return final(series.running_sum(ev, {"s": F.col("value")}, BUCKET, order=("t", "seq"), reverse=True).select("series", "seq", "s"), 3)


def modulo_fold(spark, d):
    return final(series.unfold(series.fold(event_series(spark, d), 1.0), 1.0).select("series", "seq", "turn", "folded", F.col("t").alias("unfolded")))


def season_label(spark, d):
    f = series.fold(event_series(spark, d), 1.0)
    return final(f.select("series", "seq", series.season(F.col("folded"), SEASON.knots).alias("season")))


def season_partition(spark, d):
    f = series.fold(event_series(spark, d), 1.0).withColumn("season", series.season(F.col("folded"), SEASON.knots))
    return final(f.groupBy("series", "season").agg(F.count(F.lit(1)).alias("n"), F.min("folded").alias("first"), F.max("folded").alias("last")))


def collapse_to_seasons(spark, d):
    f = series.fold(event_series(spark, d), 1.0).select("series", "seq", F.col("folded").alias("t"))
    return final(series.argsort(f, 0.05).select("series", "seq", "t", "rank"))


def argsort(spark, d):
    return final(series.argsort(event_series(spark, d), BUCKET).select("series", "seq", "rank"))


def lower_bound_index(spark, d):
    ev = event_series(spark, d, "user_id")
    return final(series.count_before(ev, series.even_cuts(series_of(ev), 0.0, END, 20), BUCKET))


def upper_bound_index(spark, d):
    ev = event_series(spark, d)
    probes = ev.select("series", F.col("t"), "seq")
    return final(series.count_before(ev, probes, BUCKET, inclusive=True).select("series", "seq", "idx"))


def segment_counts(spark, d):
    return final(segments(spark, d, "user_id"))


def sliding_windows(spark, d):
    ranked = series.argsort(event_series(spark, d, "user_id"), BUCKET).select("series", F.col("rank").alias("seq"), "value")
    return final(series.sliding(ranked, 20, 10).groupBy("series", "window").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s")), 3)


def column_subset(spark, d):
    ranked = series.argsort(event_series(spark, d, "user_id"), BUCKET).select("series", F.col("rank").alias("seq"), "t")
    return final(series.column_subset(ranked, spark.range(0, 50, 7).withColumnRenamed("id", "seq")).select("series", "seq", "t"))


def first_argmax(spark, d):
    ev = event_series(spark, d)
    return final(ev.groupBy("series").agg(F.max_by("seq", F.struct("value", -F.col("seq"))).alias("seq"), F.max("value").alias("value")))


# Time functions


def step_value(spark, d):
    return final(event_series(spark, d).select("series", "seq", SEASON.value(F.col("t")).alias("height")))


def step_integral(spark, d):
    t = F.col("t")
    return final(event_series(spark, d).select("series", "seq", SEASON.integral(t).alias("whole"), SEASON.integral(t, t / 2).alias("part")))


def day_profile(ev: DataFrame) -> DataFrame:
    """(series, knot, height): one and how often a series is seen in each quarter of a day."""
    quarter = F.floor((F.col("t") - F.floor("t")) * 4)
    seen = ev.groupBy("series", (quarter / 4).alias("knot")).agg(F.count(F.lit(1)).alias("n"))
    all_knots = series_of(ev).withColumn("knot", F.explode(F.array(*[F.lit(i / 4) for i in range(4)])))
    return all_knots.join(seen, ["series", "knot"], "left").select("series", "knot", (F.coalesce("n", F.lit(0)) + 1.0).alias("height"))


def trend(ev: DataFrame) -> DataFrame:
    """(series, knot, height): one and how often a series is seen in each ten days."""
    seen = ev.groupBy("series", (F.floor(F.col("t") / 10) * 10.0).alias("knot")).agg(F.count(F.lit(1)).alias("n"))
    all_knots = series_of(ev).withColumn("knot", F.explode(F.array(*[F.lit(10.0 * i) for i in range(3)])))
    return all_knots.join(seen, ["series", "knot"], "left").select("series", "knot", (F.coalesce("n", F.lit(0)) + 1.0).alias("height"))


def step_prefix(spark, d):
    return final(ts.prefix_integrals(day_profile(event_series(spark, d, "user_id")), ("series",)))


def step_product(spark, d):
    ev = event_series(spark, d, "user_id")
    return final(ts.combine(trend(ev), day_profile(ev), END, 1.0, keys=("series",)))


def step_sum(spark, d):
    ev = event_series(spark, d, "user_id")
    return final(ts.combine(trend(ev), day_profile(ev), END, 1.0, multiply=False, keys=("series",)))


def step_standardise(spark, d):
    return final(event_series(spark, d).select("series", "seq", SEASON.standardised().value(F.col("t")).alias("height")))


def decay_integral(spark, d):
    t = F.col("t")
    return final(event_series(spark, d).select("series", "seq", ts.decay(t, 0.1).alias("value"), ts.decay_integral(t, 0.1).alias("whole"), ts.decay_integral(t, 0.1, t / 2).alias("part")))


# Segment models


def pp_loglik(spark, d):
    s = segments(spark, d, "user_id")
    return final(s.select("series", "j", "r", m.poisson_loglik(F.col("r"), F.col("length"), ALPHA, BETA).alias("loglik")))


def pp_posterior(spark, d):
    s, r, n = segments(spark, d), F.col("r"), F.col("length")
    return final(s.withColumn("loglik", m.poisson_loglik(r, n, ALPHA, BETA)).withColumns(m.poisson_posterior(r, n, ALPHA, BETA)))


def pp_loglik_season(spark, d):
    s = segments(spark, d).withColumn("scaled", SEASON.integral(F.col("tau_r"), F.col("tau_l")))
    return final(s.select("series", "j", "scaled", m.poisson_interval_loglik(F.col("r"), F.col("tau_l"), F.col("scaled"), ALPHA, BETA, 0.01).alias("loglik")))


def regime_loglik(spark, d):
    s = segments(spark, d).withColumn("regime", F.col("j") % 3).groupBy("series", "regime").agg(F.sum("r").alias("r"), F.sum("length").alias("length"))
    return final(s.select("series", "regime", "r", m.poisson_loglik(F.col("r"), F.col("length"), ALPHA, BETA).alias("loglik")))


def pregression_loglik(spark, d):
    o = order_counts(spark, d)
    s = o.withColumn("j", F.floor(F.col("seq") / 100)).groupBy("series", "j").agg(F.sum("n").alias("r"))
    return final(s.select("series", "j", "r", m.poisson_loglik(F.col("r"), F.lit(100.0), ALPHA, BETA).alias("loglik")))


def ur_loglik(spark, d):
    return final(value_segments(spark, d).select("series", "j", "n", m.gaussian_loglik(F.col("n"), F.col("s"), F.col("ss"), 2.0, 2.0, 10.0).alias("loglik")), 5)


def ur_posterior(spark, d):
    s = value_segments(spark, d)
    return final(s.select("series", "j", "n", *[c.alias(k) for k, c in m.gaussian_posterior(F.col("n"), F.col("s"), F.col("ss"), 2.0, 2.0, 10.0).items()]), 5)


def sncp_loglik(spark, d):
    s = segments(spark, d)
    return final(s.select("series", "j", m.shot_noise_loglik(F.col("r"), F.col("tau_l"), F.col("length"), (F.col("j") + 1) / 2, 0.01).alias("loglik")))


def empirical_prior(spark, d):
    ev = event_series(spark, d, "user_id")
    first = ev.groupBy("series").agg(F.sum((F.col("t") < 0.1 * END).cast("long")).alias("n"))
    return final(first.select("series", F.greatest(F.col("n"), F.lit(1)).cast("double").alias("alpha"), F.lit(0.1 * END).alias("beta")))


def adaptive_prior(spark, d):
    ev = event_series(spark, d, "user_id")
    cuts = series.count_before(ev, series.even_cuts(series_of(ev), 0.0, END, SEGMENTS), BUCKET)
    return final(cuts.select("series", F.col("t").alias("tau"), *[c.alias(k) for k, c in m.adaptive_prior(F.col("idx"), F.col("t")).items()]))


def alternate_loglik(spark, d):
    return final(segments(spark, d).select("series", "j", m.alternate_loglik(F.col("r"), F.col("length"), (F.col("j") + 1) / 2).alias("loglik")))


def importance_logweight(spark, d):
    s = particle_segments(spark, d)
    before = F.when(F.col("j") > 0, F.col("j") / 2)
    return final(s.withColumn("x", m.importance_term(F.col("mean"), before, ALPHA, BETA)).groupBy("series", "particle").agg(F.sum("x").alias("log_weight")))


def single_cp_scan(spark, d):
    """The likelihood of one changepoint just before and just after each event."""
    ev = event_series(spark, d, "user_id")
    ranked = series.argsort(ev, BUCKET)
    total = ev.groupBy("series").agg(F.count(F.lit(1)).alias("n"))
    t = F.col("t")
    two = lambda r: m.poisson_loglik(r, t, ALPHA, BETA) + m.poisson_loglik(F.col("n") - r, END - t, ALPHA, BETA)
    return ranked.join(total, "series").select("series", "seq", "t", two(F.col("rank")).alias("before"), two(F.col("rank") + 1).alias("after"))


def single_cp(spark, d):
    return final(single_cp_scan(spark, d).drop("t"))


def single_cp_map(spark, d):
    s = single_cp_scan(spark, d).withColumn("best", F.greatest("before", "after"))
    none = segments(spark, d, "user_id").groupBy("series").agg(F.sum("r").alias("n")).withColumn("none", m.poisson_loglik(F.col("n"), F.lit(END), ALPHA, BETA))
    top = s.groupBy("series").agg(F.max("best").alias("best"))
    return final(top.join(none, "series").select("series", "n", "best", "none", F.greatest("best", "none").alias("l_max")))


# Predictive monitoring


def _windows(spark, d):
    ev = event_series(spark, d)
    return predictive.windows_of(ev, series_of(ev), 0.0, 30, 1.0)


def nb_predictive_pmf(spark, d):
    s = segments(spark, d)
    return final(s.select("series", "j", predictive.log_pmf(F.col("r"), F.lit(3.0), F.lit(5.0), F.lit(0.2)).alias("log_pmf")))


def nb_predictive_tail(spark, d):
    s = segments(spark, d, "user_id").withColumns({"t": F.lit(3.0), "shape": F.lit(4.0), "rate": F.lit(2.0)})
    return final(predictive.tails(s, "r", "t", "shape", "rate").select("series", "j", "r", "p_lower", "p_upper", "p_two"))


def sequential_pvalues(spark, d):
    ev = event_series(spark, d, "user_id")
    w = predictive.windows_of(ev, series_of(ev), 0.0, 30, 1.0)
    return final(predictive.sequential(w, 1.0, 1.0, 1.0).select("series", "win", "r", "shape", "rate", "p_lower", "p_upper"))


def two_sided_pvalues(spark, d):
    s = segments(spark, d, "user_id").withColumns({"t": F.lit(3.0), "shape": F.lit(4.0), "rate": F.lit(2.0)})
    return final(predictive.two_sided(s, "r", "t", "shape", "rate").select("series", "j", "r", "p_less", "p_most", "p_mid"))


def monte_carlo_pvalues(spark, d):
    """Each user's two-sided p-values of all segments, combined by draws from their intervals."""
    s = segments(spark, d, "user_id").withColumns({"t": F.lit(3.0), "shape": F.lit(4.0), "rate": F.lit(2.0)})
    masses = predictive.two_sided(s, "r", "t", "shape", "rate")
    # From six digits, so that a draw doesn't hang on the last bits.
    return final(predictive.monte_carlo(masses.withColumns({c: F.round(F.round(c, 12), 6) for c in ("p_less", "p_most")}), ["series"], "j", 20))


def profile_integral(spark, d):
    """Scaled time of each event by its user's own profile: how often the user is seen in each quarter of a day."""
    ev = event_series(spark, d, "user_id")
    return final(ts.profile_integral(ev, day_profile(ev), 1.0).select("series", "seq", "t", "scaled"))


def pregression_exposure(spark, d):
    """Counts of each order status in a hundred days, the days' orders of all statuses being the multipliers of its rate."""
    o = order_counts(spark, d)
    every = o.groupBy("seq").agg(F.sum("n").alias("m"))
    whole = o.select("series").distinct().crossJoin(every).join(o, ["series", "seq"], "left")
    s = whole.withColumn("j", F.floor(F.col("seq") / 100)).groupBy("series", "j").agg(F.sum(F.coalesce("n", F.lit(0))).alias("r"), (F.sum("m") / 100.0).alias("length"))
    return final(s.select("series", "j", "r", "length", m.poisson_loglik(F.col("r"), F.col("length"), ALPHA, BETA).alias("loglik")))


def waiting_time_pvalues(spark, d):
    ev = event_series(spark, d, "user_id")
    return final(predictive.waiting_times(ev, 0.0, 3.0, BUCKET, 1.0, 1.0).select("series", "seq", "win", "gap", "p"))


def fisher_combined(spark, d):
    ev = event_series(spark, d, "user_id")
    return final(predictive.fisher(predictive.waiting_times(ev, 0.0, 3.0, BUCKET, 1.0, 1.0), ["series", "win"]).select("series", "win", "n", "combined"))


# Histograms and divergences


def hist_transdim(spark, d):
    return final(histogram.counts(binned(spark, d), ["series"]))


def hist_max_gap(spark, d):
    return final(histogram.counts(binned(spark, d, "max_gap"), ["series"]))


def hist_weighted(spark, d):
    return final(histogram.counts(binned(spark, d, "first_last"), ["series"], weight=F.exp("log_w")))


def hist_unbounded(spark, d):
    ev = event_series(spark, d)
    return final(ev.withColumn("bin", histogram.bin_of(F.col("t"), 5.0, 25.0, 10, bounded=False)).groupBy("series", "bin").agg(F.count(F.lit(1)).alias("n")))


def hist_1d(spark, d):
    return final(histogram.occupancy(binned(spark, d), ["series"]))


def hist_marginal(spark, d):
    return final(histogram.marginal(histogram.counts(binned(spark, d), ["series"]), ["series"], 2, 1))


def hist_merge(spark, d):
    b = binned(spark, d)
    halves = [histogram.counts(b.where(F.col("particle") % 2 == i), ["series"]) for i in (0, 1)]
    return final(histogram.merge(*halves))


def hist_normalised(spark, d):
    return final(histogram.normalise(histogram.counts(binned(spark, d), ["series"]), ["series"]).withColumn("density", histogram.density(F.col("p"), 0.5)))


def hist_draw(spark, d):
    return final(histogram.draw_bin(histogram.occupancy(binned(spark, d), ["series"]).select("series", "bin", "n"), ["series"], 0.4))


def shannon_entropy(spark, d):
    return final(histogram.entropy(histogram.counts(binned(spark, d), ["series"]), ["series"]))


def cross_entropy(spark, d):
    o = histogram.occupancy(binned(spark, d), ["series"]).select("series", "bin", "n")
    q = o.withColumn("n", F.col("n") + F.col("bin") + 1)
    return final(histogram.cross_entropy(o, q, ["series"], "bin"))


def jsd(spark, d):
    b = binned(spark, d).withColumn("run", F.col("particle") % 3)
    return final(histogram.jensen_shannon(histogram.counts(b, ["series", "run"]), ["series"], "run"))


def repeat_probability(spark, d):
    return final(histogram.repeat_probability(binned(spark, d, "first"), ["series"], ["particle"]))


def difference_softmax(spark, d):
    o = histogram.occupancy(binned(spark, d), ["series"]).select("series", "bin", (F.col("n") / 50).alias("n"))
    return final(histogram.difference_softmax(o, ["series"]))


def true_marginal(spark, d):
    """Bins of the exponential distribution with each user's mean value."""
    means = event_series(spark, d, "user_id").groupBy("series").agg((F.avg("value") / 100).alias("mean"))
    return final(histogram.true_marginal(means, 0.0, 3.0, 6, lambda x: 1 - F.exp(-x / F.col("mean"))).select("series", "bin", "p"))


def phi_table(spark, d):
    """At each number of events that a user has in a segment."""
    seen = segments(spark, d, "user_id").where("r > 0").select(F.col("r").alias("n")).distinct()
    return final(histogram.phi_differences(seen))


def divergence_scores(spark, d):
    return final(histogram.divergence(histogram.counts(binned(spark, d), ["series"]), ["series"]))


def divergence_chi_square(spark, d):
    scored = histogram.divergence(histogram.counts(binned(spark, d), ["series"]), ["series"]).select("series", "n_bins", "total")
    return final(histogram.chi_square_scores(scored, chi2_quantiles(scored.select(F.col("n_bins") - 1), 0.95)))


def divergence_jackknife(spark, d):
    return final(histogram.entropy_jackknife(binned(spark, d), ["series"], "particle"))


def dimension_distribution(spark, d):
    return final(particles.dimension_distribution(pseudo_particles(spark, d), ["series"]))


def map_per_dimension(spark, d):
    p = pseudo_particles(spark, d).withColumn("log_post", F.col("log_w") - F.col("k"))
    return final(particles.best_per_dimension(p, ["series"], "log_post"))


# Grids, weights, resampling, allocation


def grid_summary(spark, d):
    covered = grid.on_grid(particle_segments(spark, d), 0.0, 3.0, 12)
    return final(grid.summarise(covered, ["series"], 0.5))


def grid_capped(spark, d):
    covered = grid.on_grid(particle_segments(spark, d), 0.0, 3.0, 12)
    return final(grid.summarise(covered, ["series"], 0.5, cap=0.4, decay_rate=0.2).select("series", "g", "intensity", "since_mean", "p_below"))


def last_distance(spark, d):
    w = particles.normalised(pseudo_particles(spark, d), ["series"]).withColumn("last_tau", F.element_at("theta", -1))
    return final(grid.last_distance(w, ["series"], F.lit(3.0)))


def probability_variance(spark, d):
    return final(grid.probability_variance(histogram.occupancy(binned(spark, d), ["series"]), ["series"], 500), 9)


def total_variance(spark, d):
    p = pseudo_particles(spark, d).withColumn("chain", F.col("particle") % 4)
    return final(grid.total_variance(p, ["series"], "chain", "k"))


def normalised_weights(spark, d):
    return final(particles.normalised(pseudo_particles(spark, d), ["series"]).select("series", "particle", "w"), 9)


def ess(spark, d):
    return final(particles.effective_size(particles.normalised(pseudo_particles(spark, d), ["series"]), ["series"]), 4)


def systematic_resample(spark, d):
    w = particles.normalised(pseudo_particles(spark, d), ["series"])
    # Sums in another order differ in the last bits: an offset away from the steps' multiples keeps counts equal.
    return final(particles.systematic(w, ["series"], ["particle"], F.lit(1000), 0.37, F.floor(F.col("particle") / PARTICLES)).select("series", "particle", "offspring"))


def particle_edits(spark, d):
    p = pseudo_particles(spark, d)
    t = F.col("theta")
    shown = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s * 2 + x), 6)
    return p.select("series", "particle", shown(particles.insert_component(t, 1, F.lit(0.5))).alias("inserted"), shown(particles.delete_component(t, 0)).alias("deleted"), shown(particles.change_component(t, 0, F.lit(0.25))).alias("changed"))


def particle_join(spark, d):
    p = pseudo_particles(spark, d)
    a, b = p.where(F.col("particle") % 2 == 0).select("series", "particle", "k", "log_w"), p.where(F.col("particle") % 2 == 1).select("series", "particle", "k", "log_w")
    z = particles.zip_particles(a, b, ["series"], ["particle"], ["particle"], F.floor(F.col("particle") / PARTICLES))
    return final(z.select("series", "slot", "particle", "b_particle", (F.col("k") + F.col("b_k")).alias("k"), particles.joined_weight(F.col("log_w"), F.col("b_log_w"), F.lit(0.5), F.lit(0.25)).alias("log_w")))


def _scores(spark, d):
    """Score trajectories: users' values in order of time."""
    ranked = series.argsort(event_series(spark, d, "user_id"), BUCKET)
    return ranked.select(F.col("series").alias("process"), F.col("rank").alias("step"), F.col("value").alias("score"))


def greedy_allocation(spark, d):
    return final(particles.greedy_allocation(_scores(spark, d), 500))


def greedy_duplication(spark, d):
    w = particles.normalised(pseudo_particles(spark, d), ["series"])
    return final(particles.greedy_duplication(w, ["series"], 20).select("series", "particle", "copies"))


# Windows given history, intervals, constraints, draws

#: A profile with a quarter of a day in which nothing can be observed.
CLOSED = ts.StepFunction((0.0, 0.25, 0.5), (0.0, 2.0, 1.0), 1.0)


def window_given_history(spark, d):
    by_time = Window.partitionBy("series").orderBy("j")
    w = segments(spark, d, "user_id").withColumns({"r_before": F.lag("r").over(by_time), "t_before": F.lit(3.0)}).where("r_before IS NOT NULL")
    return final(predictive.given_history(w, "r_before", "t_before", "r", "length", 1.0, 1.0).select("series", "j", "r_before", "r", "p_lower", "p_upper", "p_two"))


def window_count_pvalues(spark, d):
    ev = event_series(spark, d, "user_id")
    w = predictive.windows_of(ev, series_of(ev), 0.0, 120, 0.25)
    return final(predictive.event_counts(w, CLOSED, 0.25, 1.0, 1.0).select("series", "win", "r", "t", F.col("observable").cast("long").alias("observable"), "p_lower", "p_upper", "p_two"))


def window_waiting_pvalues(spark, d):
    ev = event_series(spark, d, "user_id")
    return final(predictive.window_waiting_times(ev, series_of(ev), 0.0, 10, 3.0, BUCKET, 1.0, 1.0))


def _in_intervals(spark, d):
    return grid.on_grid(particle_segments(spark, d), 0.0, 3.0, 12).withColumn("interval", F.col("particle") % 3)


def grid_sequential(spark, d):
    return final(grid.summarise(_in_intervals(spark, d), ["series", "interval"], 0.5).select("series", "interval", "g", "intensity", "since_mean", "p_below"))


def grid_filtering(spark, d):
    return final(grid.summarise(grid.filtered(_in_intervals(spark, d), "interval", 4), ["series", "interval"], 0.5).select("series", "interval", "g", "intensity", "since_mean", "p_below"))


def primary_mean(spark, d):
    return final(grid.primary(particle_segments(spark, d), ["series"], 0.0, 3.0, 25, decay_rate=0.2))


def primary_nearest(spark, d):
    return final(grid.primary(particle_segments(spark, d), ["series"], 0.0, 3.0, 9, "nearest"))


def primary_since(spark, d):
    return final(grid.primary(particle_segments(spark, d), ["series"], 0.0, 3.0, 9, "since"))


def time_scale(spark, d):
    t = F.col("t")
    both, alone = ts.time_scale(TREND, SEASON), ts.time_scale(None, SEASON)
    return final(event_series(spark, d).select("series", "seq", ts.rate_factor(t, both).alias("factor"), ts.rate_factor(t, alone).alias("season")))


def thinned_sample(spark, d):
    p = pseudo_particles(spark, d).withColumn("iteration", F.col("particle"))
    return final(series.thin(p, 7, 1000).select("series", "particle", "k", "log_w"))


def window_lines(spark, d):
    ev = event_series(spark, d, "user_id")
    return text.lines(predictive.windows_of(ev, series_of(ev), 0.0, 30, 1.0).where("r > 0"), "series", "win", "r", 30)


def step_of_means(spark, d):
    s = segments(spark, d, "user_id").withColumn("mean", m.poisson_posterior(F.col("r"), F.col("length"), ALPHA, BETA)["post_mean"])
    plain, unit = ts.step_of_means(s, ["series"]), ts.step_of_means(s, ["series"], True).withColumnRenamed("height", "share")
    return final(plain.join(unit, ["series", "knot"]))


def particle_concat(spark, d):
    p = pseudo_particles(spark, d)
    a, b = (p.where(F.col("particle") % 2 == i).select("series", "particle", "theta", "log_w") for i in (0, 1))
    pairs = particles.zip_particles(a, b.withColumn("theta", F.transform("theta", lambda x: x + 3)), ["series"], ["particle"], ["particle"])
    sums = F.aggregate("theta", F.lit(0.0), lambda s, x: s / 2 + x)
    return final(particles.concatenate(pairs).select("series", "slot", "particle", "b_particle", "k", "log_w", sums.alias("folded")))


def particle_exists(spark, d):
    b = binned(spark, d)
    even, odd = b.where(F.col("particle") % 2 == 0), b.where(F.col("particle") % 2 == 1)
    return final(particles.existing(even, odd, ["series"], "bins").select("series", "particle", "k"))


def monotone_particles(spark, d):
    s = segments(spark, d, "user_id").withColumn("mean", m.poisson_posterior(F.col("r"), F.col("length"), ALPHA, BETA)["post_mean"]).where("j < 3")
    p = s.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("j", "mean", "length"))).alias("x")).select("series", F.col("x.mean").alias("means"), F.col("x.length").alias("lengths"))
    return final(particles.constrained(p, "means", "lengths", 0.05).select("series", F.element_at("means", 1).alias("first"), F.element_at("means", -1).alias("last")))


def importance_weights(spark, d):
    s = particle_segments(spark, d).withColumn("term", F.log1p("mean") - F.col("tau_l"))
    p = s.groupBy("series", "particle").agg(F.array_sort(F.collect_list(F.struct("j", "term"))).alias("x")).select("series", "particle", F.col("x.term").alias("terms"))
    w = particles.importance(p.join(pseudo_particles(spark, d).select("series", "particle", "log_w"), ["series", "particle"]), "terms")
    return final(particles.normalised(w, ["series"]).select("series", "particle", "w"), 9)


def bounded_histogram(spark, d):
    p = pseudo_particles(spark, d).withColumn("theta", histogram.within(F.col("theta"), 0.5, 2.5))
    return final(histogram.counts(p.withColumn("bins", histogram.particle_bins(F.col("theta"), 0.5, 2.5, 4)), ["series"]))


def hist_draws(spark, d):
    o = histogram.occupancy(binned(spark, d), ["series"]).select("series", "bin", "n")
    us = o.select("series").distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(39)))).withColumn("u", (F.col("draw") + 0.37) / 40)
    return final(histogram.draws(o, us, ["series"]).select("series", "draw", "bin"))


def difference_density(spark, d):
    o = histogram.occupancy(binned(spark, d), ["series"]).select("series", "bin", (F.col("n") / 50).alias("n"))
    return final(histogram.difference_density(o, ["series"], 0.5))


def divergence_function(spark, d):
    return final(histogram.function_variance(pseudo_particles(spark, d), ["series"], "k"), 9)


def divergence_chi_square_average(spark, d):
    b = binned(spark, d)
    scored = histogram.divergence(histogram.counts(b, ["series"]), ["series"]).select("series", "n_bins", "total")
    early = histogram.divergence(histogram.counts(b.where(F.col("particle") % 4 == 0), ["series"]), ["series"]).select("series", F.col("n_bins").alias("bins_0"), F.col("total").alias("total_0"))
    q = chi2_quantiles(scored.select(F.explode(F.array(F.col("n_bins") - 1, F.col("n_bins")))), 0.95)
    return final(histogram.chi_square_average(scored, early, ["series"], q), 9)


QUERIES = {
    f.__name__: f
    for f in (
        distinct_values, prefix_sum, undo_prefix_sum, suffix_sum, modulo_fold, season_label, season_partition, collapse_to_seasons, argsort, lower_bound_index,
        upper_bound_index, segment_counts, sliding_windows, column_subset, first_argmax, step_value, step_integral, step_prefix, step_product, step_sum,
        step_standardise, decay_integral, pp_loglik, pp_posterior, pp_loglik_season, regime_loglik, pregression_loglik, ur_loglik, ur_posterior, sncp_loglik,
        empirical_prior, adaptive_prior, alternate_loglik, importance_logweight, single_cp, single_cp_map, nb_predictive_pmf, nb_predictive_tail,
        sequential_pvalues, waiting_time_pvalues, fisher_combined, hist_transdim, hist_max_gap, hist_weighted, hist_unbounded, hist_1d, hist_marginal,
        hist_merge, hist_normalised, hist_draw, shannon_entropy, cross_entropy, jsd, repeat_probability, difference_softmax, true_marginal, phi_table,
        divergence_scores, divergence_chi_square, divergence_jackknife, dimension_distribution, map_per_dimension, grid_summary, grid_capped, last_distance,
        probability_variance, total_variance, normalised_weights, ess, systematic_resample, particle_edits, particle_join, greedy_allocation, greedy_duplication,
        window_given_history, window_count_pvalues, window_waiting_pvalues, grid_sequential, grid_filtering, primary_mean, primary_nearest, primary_since,
        time_scale, thinned_sample, window_lines, step_of_means, particle_concat, particle_exists, monotone_particles, importance_weights, bounded_histogram, hist_draws, difference_density,
        divergence_function, divergence_chi_square_average, two_sided_pvalues, monte_carlo_pvalues, profile_integral, pregression_exposure,
    )
}
