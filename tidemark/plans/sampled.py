"""Registered queries whose rows are drawn or streamed: they have no SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import particles, predictive, samplers, series
from tidemark.operators.kernels import SamplerConfig
from tidemark.plans.queries import final, pseudo_particles
from tidemark.sources.tables import days, durable, event_series, order_counts, series_of, shared_dir
from tidemark.streaming import pvalues, smc

END = 30.0
CFG = SamplerConfig(iterations=4000, burn_in=500, thinning=10, nu=1 / 15)


def rj_poisson(spark: SparkSession, d: str) -> DataFrame:
    ev = event_series(spark, d, "user_id")
    return samplers.reversible_jump(ev, series_of(ev), 0.0, END, CFG, chains=2)


def _values(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Each user's values in order of time, and the users with the number of theirs as end."""
    ranked = series.argsort(event_series(spark, d, "user_id"), 1.0)
    y = ranked.select("series", F.col("rank").alias("seq"), F.col("value").alias("y"))
    return y, y.groupBy("series").agg(F.count(F.lit(1)).cast("double").alias("end"))


def rj_gaussian(spark: SparkSession, d: str) -> DataFrame:
    y, users = _values(spark, d)
    return samplers.reversible_jump(y, users, 0.0, 0.0, CFG, "gaussian", alpha=2.0, beta=2.0)


def _daily(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders by status and day, numbered from the first, and the statuses with the number of days as end."""
    o = order_counts(spark, d)
    c = o.select("series", (F.row_number().over(Window.partitionBy("series").orderBy("seq")) - 1).alias("seq"), "n")
    return c, c.groupBy("series").agg(F.count(F.lit(1)).cast("double").alias("end"))


def rj_counts(spark: SparkSession, d: str) -> DataFrame:
    c, statuses = _daily(spark, d)
    return samplers.reversible_jump(c, statuses, 0.0, 0.0, SamplerConfig(iterations=2000, burn_in=500, thinning=10, nu=0.01), "counts")


def smc_gaussian(spark: SparkSession, d: str) -> DataFrame:
    """Over the longest user's number of values; shorter series add nothing beyond their end."""
    y, users = _values(spark, d)
    longest = users.agg(F.max("end")).first()[0] or 1.0
    return samplers.sequential_monte_carlo(y, users.drop("end"), 0.0, longest, 4, 50, SamplerConfig(burn_in=100, thinning=2, nu=1 / 30), 2.0, 2.0, kind="gaussian")


def smc_counts(spark: SparkSession, d: str) -> DataFrame:
    c, statuses = _daily(spark, d)
    longest = statuses.agg(F.max("end")).first()[0] or 1.0
    return samplers.sequential_monte_carlo(c, statuses.drop("end"), 0.0, longest, 6, 100, SamplerConfig(burn_in=200, thinning=2, nu=0.01, spacing=2.0), kind="counts")


def rate_draws(spark: SparkSession, d: str) -> DataFrame:
    ev = event_series(spark, d, "user_id")
    return samplers.draw_rates(series.segment_counts(ev, series.even_cuts(series_of(ev), 0.0, END, 10), 1.0), ["series", "j"])


def rj_shot_noise(spark: SparkSession, d: str) -> DataFrame:
    ev = event_series(spark, d, "user_id")
    return samplers.shot_noise(ev, series_of(ev), 0.0, END, SamplerConfig(iterations=500, burn_in=100, thinning=10, nu=0.2), 1.0, 0.1)


def rj_acceptance(spark: SparkSession, d: str) -> DataFrame:
    ev = event_series(spark, d)
    return samplers.acceptance_rates(ev, series_of(ev), 0.0, END, CFG)


def rejection_sample(spark: SparkSession, d: str) -> DataFrame:
    """Of each user and three days: exact draws with one changepoint at most."""
    ev = event_series(spark, d, "user_id")
    block = F.floor(F.col("t") / 3)
    name = F.concat_ws(":", "series", block.cast("int").cast("string"))
    windows = series_of(ev).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(9)))).select(F.concat_ws(":", "series", F.col("block").cast("string")).alias("series"))
    return samplers.rejection_sample(ev.select(name.alias("series"), (F.col("t") - block * 3).alias("t")), windows, 0.0, 3.0, 0.2, 20)


def rj_discrete(spark: SparkSession, d: str) -> DataFrame:
    """Daily orders with changepoints at whole days."""
    c, statuses = _daily(spark, d)
    return samplers.reversible_jump(c, statuses, 0.0, 0.0, SamplerConfig(iterations=2000, burn_in=500, thinning=10, nu=0.01, discrete=True), "counts")


def smc_rejection(spark: SparkSession, d: str) -> DataFrame:
    """Of each user: particles from exact draws of each window."""
    ev = event_series(spark, d, "user_id")
    return samplers.interval_summary(samplers.sequential_monte_carlo(ev, series_of(ev), 0.0, END, 10, 100, SamplerConfig(nu=1 / 10), source="rejection"))


def smc_prior(spark: SparkSession, d: str) -> DataFrame:
    """Of each user: particles from the prior, weighted by the likelihood."""
    ev = event_series(spark, d, "user_id")
    return samplers.interval_summary(samplers.sequential_monte_carlo(ev, series_of(ev), 0.0, END, 10, 100, SamplerConfig(nu=1 / 10), source="prior"))


def chain_prior_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates of the segments between each particle's changepoints, drawn from the chain prior."""
    return samplers.chain_prior(pseudo_particles(spark, d).select("series", "particle", "k"))


def prior_sample(spark: SparkSession, d: str) -> DataFrame:
    return samplers.prior_sample(series_of(event_series(spark, d)), 0.0, END, 0.2, 1000)


def smc_poisson(spark: SparkSession, d: str) -> DataFrame:
    ev = event_series(spark, d)
    return samplers.sequential_monte_carlo(ev, series_of(ev), 0.0, END, 6, 200, SamplerConfig(burn_in=200, thinning=2, nu=1 / 15))


def smc_full_history(spark: SparkSession, d: str) -> DataFrame:
    ev = event_series(spark, d)
    return samplers.sequential_monte_carlo(ev, series_of(ev), 0.0, END, 5, 100, SamplerConfig(burn_in=200, thinning=5, nu=1 / 15), full_history=True)


def smc_summary(spark: SparkSession, d: str) -> DataFrame:
    return samplers.interval_summary(smc_poisson(spark, d))


def smc_adaptive(spark: SparkSession, d: str) -> DataFrame:
    """Sample sizes of each series when one budget goes to the worst score, one sample at a time."""
    ev = event_series(spark, d, "user_id")
    users = series_of(ev)
    sample = samplers.reversible_jump(ev, users, 0.0, END, SamplerConfig(iterations=2000, burn_in=200, thinning=10, nu=1 / 10))
    # The allocation reads scores several times: chains run once.
    scores = durable(samplers.score_trajectories(sample, 0.0, END, 50, 50, samplers.tasks(users.count(), spark.sparkContext.defaultParallelism)), "scores")
    return particles.greedy_allocation(scores, 3000)


def smc_budgeted(spark: SparkSession, d: str) -> DataFrame:
    """Summaries of particles whose number in each window follows from one budget over all users."""
    ev = event_series(spark, d, "user_id")
    users = series_of(ev)
    budget = 20 * users.count()
    drawn = samplers.budgeted_windows(ev, users, 0.0, END, 5, budget, 20, SamplerConfig(burn_in=100, thinning=5, nu=1 / 10))
    return samplers.interval_summary(samplers.sequential_monte_carlo(ev, users, 0.0, END, 5, 20, SamplerConfig(burn_in=100, thinning=2, nu=1 / 10), fresh=drawn))


def window_sizes(spark: SparkSession, d: str) -> DataFrame:
    """How many draws each user has in each window under that budget."""
    ev = event_series(spark, d, "user_id")
    users = series_of(ev)
    drawn = samplers.budgeted_windows(ev, users, 0.0, END, 5, 20 * users.count(), 20, SamplerConfig(burn_in=100, thinning=5, nu=1 / 10))
    return drawn.groupBy("series", "interval").agg(F.count(F.lit(1)).alias("n"))


def smc_shot_noise(spark: SparkSession, d: str) -> DataFrame:
    """Of each user: particles of a decaying rate with jumps, window by window."""
    ev = event_series(spark, d, "user_id")
    return samplers.interval_summary(samplers.shot_noise_smc(ev, series_of(ev), 0.0, END, 5, 60, SamplerConfig(burn_in=100, thinning=4, nu=0.1), 1.0, 0.3))


STREAMED = smc.Windows(width=5.0, intervals=6, n=60, cfg=SamplerConfig(burn_in=100, thinning=2, nu=1 / 15))


def smc_stream(spark: SparkSession, d: str) -> DataFrame:
    """Of each user: particles after each window of a stream over the events table, collected into a table."""
    events = _stream(spark, d).selectExpr("CAST(user_id AS STRING) AS series", "CAST(ts AS TIMESTAMP) AS ts", f"{days('ts')} AS t")
    # The table says how many series will come: about as many groups of them as a replay has batches.
    groups = samplers.tasks(event_series(spark, d, "user_id").agg(F.count_distinct("series")).first()[0], spark.sparkContext.defaultParallelism, smc.TOGETHER)
    return _collected(spark, events, lambda marked: smc.particles(marked, STREAMED, FIRST_DAY * 86_400_000, groups=groups), smc.ROWS)


def smc_replay(spark: SparkSession, d: str) -> DataFrame:
    """smc_stream in batch."""
    return smc.replay(event_series(spark, d, "user_id"), STREAMED)


def rj_rising(spark: SparkSession, d: str) -> DataFrame:
    ev = event_series(spark, d, "user_id")
    return samplers.reversible_jump(ev, series_of(ev), 0.0, END, CFG, rising=True)


def map_polished(spark: SparkSession, d: str, smoothing: bool = False) -> DataFrame:
    ev = event_series(spark, d, "user_id")
    sample = samplers.reversible_jump(ev, series_of(ev), 0.0, END, CFG)
    best = sample.groupBy("series").agg(F.max_by("theta", F.struct("log_post", -F.col("iteration"))).alias("theta"))
    return samplers.polish_map(best, ev, 0.0, END, smoothing=smoothing)


def map_smoothed(spark: SparkSession, d: str) -> DataFrame:
    return map_polished(spark, d, True)


#: Days from 1970-01-01 to the origin.
FIRST_DAY = 19723


def _stream(spark: SparkSession, d: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")


def _collected(spark: SparkSession, events: DataFrame, scored: Callable[[DataFrame], DataFrame], rows: str) -> DataFrame:
    """The rows that a stream makes of all events (series, ts, ...) by the time it ends."""
    where = f"{shared_dir(spark)}/tidemark/stream-{uuid.uuid4().hex}"
    # The table ends, a stream doesn't: a mark after the last day closes its windows. The mark's own window never closes.
    names = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    mark = ", ".join("TIMESTAMP'2024-02-02 00:00:00' AS ts" if n == "ts" else f"CAST(NULL AS {kind}) AS {n}" for n, kind in names.items())
    spark.sql(f"SELECT {mark}").write.parquet(f"{where}/end")
    marked = events.unionByName(spark.readStream.schema(", ".join(f"{n} {kind}" for n, kind in names.items())).parquet(f"{where}/end*"))
    scored(marked).writeStream.format("parquet").option("path", f"{where}/rows").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows).parquet(f"{where}/rows")


def stream_pvalues(spark: SparkSession, d: str) -> DataFrame:
    """A stream over the events table, scored window by window, collected into a table."""
    events = _stream(spark, d).select(F.col("event_type").alias("series"), F.col("ts").cast("timestamp").alias("ts"))
    rows = _collected(spark, events, lambda marked: pvalues.posterior(pvalues.windowed(marked, 1.0), FIRST_DAY, 1.0, 1.0, 1.0), pvalues.SCORED)
    return final(predictive.tails(rows, "r", "t", "shape", "rate"))


QUERIES = {f.__name__: f for f in (rj_poisson, rj_gaussian, rj_counts, rj_shot_noise, rj_acceptance, rejection_sample, smc_gaussian, smc_counts, smc_budgeted, window_sizes, smc_shot_noise, smc_stream, smc_replay, rj_rising, rj_discrete, smc_rejection, smc_prior, chain_prior_rates, rate_draws, prior_sample, smc_poisson, smc_full_history, smc_summary, smc_adaptive, map_polished, map_smoothed, stream_pvalues)}
