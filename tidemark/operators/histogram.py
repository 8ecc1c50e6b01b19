"""Histograms of changepoint positions, entropies and Monte Carlo divergences.

A particle is a row with an array ``theta`` of ascending positions. All sums are grouped with
partial aggregation; one-dimensional counts come from exploded, distinct bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.special import digamma_integer
from tidemark.operators.series import bucketed_sum


def bin_of(v: Column, start: float, end: float, n: int, bounded: bool = True) -> Column:
    """Bin number; without bounds 0 lies below start, n + 1 at or above end, and bins count from 1."""
    width = (end - start) / n
    at = F.floor((v - start) / width).cast("int")
    return at if bounded else F.when(v < start, 0).when(v >= end, n + 1).otherwise(at + 1)


def particle_bins(theta: Column, start: float, end: float, n: int, component: str = "all") -> Column:
    """Bins of a particle's positions: all, the first, the last, both, or of its largest gap."""
    if component == "max_gap":
        ends = F.concat(F.array(F.lit(float(start))), theta, F.array(F.lit(float(end))))
        gaps = F.transform(F.sequence(F.lit(1), F.size(ends) - 1), lambda i: F.element_at(ends, i + 1) - F.element_at(ends, i))
        return F.array(bin_of(F.array_max(gaps), start, end, n))
    chosen = {
        "all": theta,
        "first": F.slice(theta, 1, 1),
        "last": F.slice(theta, -1, 1),
        "first_last": F.concat(F.slice(theta, 1, 1), F.slice(theta, -1, 1)),
    }[component]
    return F.when(F.size(theta) == 0, F.array().cast("array<int>")).otherwise(F.transform(chosen, lambda v: bin_of(v, start, end, n)))


def counts(particles: DataFrame, keys: list[str], bins: str = "bins", weight: Column | None = None) -> DataFrame:
    """Trans-dimensional histogram: how many particles, or which weight, for each vector of bins."""
    return particles.groupBy(*keys, bins).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n"))


def merge(*histograms: DataFrame) -> DataFrame:
    """Adds up histograms of the same columns."""
    whole = histograms[0]
    for h in histograms[1:]:
        whole = whole.unionByName(h)
    return whole.groupBy(*[c for c in whole.columns if c != "n"]).agg(F.sum("n").alias("n"))


def occupancy(particles: DataFrame, keys: list[str], bins: str = "bins") -> DataFrame:
    """Share of particles with at least one position in a bin."""
    size = particles.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hit = particles.select(*keys, F.explode(F.array_distinct(bins)).alias("bin")).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    return hit.join(size, keys).withColumn("p", F.col("n") / F.col("_n")).drop("_n")


def marginal(histogram: DataFrame, keys: list[str], dimension: int, component: int, bins: str = "bins") -> DataFrame:
    """Of one component (from 0), among particles of one dimension."""
    return histogram.where(F.size(bins) == dimension).groupBy(*keys, F.element_at(bins, component + 1).alias("bin")).agg(F.sum("n").alias("n"))


def normalise(histogram: DataFrame, keys: list[str]) -> DataFrame:
    return histogram.join(histogram.groupBy(*keys).agg(F.sum("n").alias("_n")), keys).withColumn("p", F.col("n") / F.col("_n")).drop("_n")


def density(p: Column, width: float) -> Column:
    return p / width


def entropy(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """Shannon entropy (nats) by the plug-in estimate, from counts or weights."""
    total = F.sum("n").cast("double")
    return histogram.where("n > 0").groupBy(*keys).agg((F.log(total) - F.sum(F.col("n") * F.log("n")) / total).alias("entropy"), total.alias("total"), F.count(F.lit(1)).alias("n_bins"))


def cross_entropy(p: DataFrame, q: DataFrame, keys: list[str], bins: str = "bins") -> DataFrame:
    """-sum p log q; infinite where q has nothing."""
    both = normalise(p, keys).select(*keys, bins, F.col("p")).join(normalise(q, keys).select(*keys, bins, F.col("p").alias("q")), [*keys, bins], "left")
    return both.groupBy(*keys).agg(F.sum(F.when(F.col("q").isNull(), float("inf")).otherwise(-F.col("p") * F.log("q"))).alias("cross_entropy"))


def jensen_shannon(histogram: DataFrame, keys: list[str], run: str, bins: str = "bins") -> DataFrame:
    """Entropy of the runs' mean distribution less the mean of their entropies."""
    each = entropy(histogram, [*keys, run])
    runs = each.groupBy(*keys).agg(F.avg("entropy").alias("_mean"), F.count(F.lit(1)).alias("_runs"))
    mixed = normalise(histogram, [*keys, run]).groupBy(*keys, bins).agg(F.sum("p").alias("n"))
    return entropy(mixed, keys).join(runs, keys).select(*keys, (F.col("entropy") - F.col("_mean")).alias("jsd"))


def repeat_probability(visits: DataFrame, keys: list[str], order: list[str], bins: str = "bins") -> DataFrame:
    """Share of consecutive samples in the same bin beyond what independent samples would show; 0 at least."""
    w = Window.partitionBy(*keys).orderBy(*order)
    same = visits.withColumn("_same", (F.col(bins) == F.lag(bins).over(w)).cast("int")).groupBy(*keys).agg(F.avg("_same").alias("observed"))
    chance = normalise(counts(visits, keys, bins), keys).groupBy(*keys).agg(F.sum(F.col("p") * F.col("p")).alias("chance"))
    rate = (F.col("observed") - F.col("chance")) / (1 - F.col("chance"))
    return same.join(chance, keys).withColumn("repeat", F.when(F.col("chance") >= 1, 0.0).otherwise(F.greatest(F.lit(0.0), rate)))


def difference_softmax(dense: DataFrame, keys: list[str], bin_col: str = "bin", n: str = "n") -> DataFrame:
    """Probability of each bin by the exponentiated difference to the bin before (the first: to 0)."""
    d = F.col(n) - F.coalesce(F.lag(n).over(Window.partitionBy(*keys).orderBy(bin_col)), F.lit(0))
    raised = dense.withColumn("_d", d)
    top = raised.join(raised.groupBy(*keys).agg(F.max("_d").alias("_top")), keys).withColumn("_e", F.exp(F.col("_d") - F.col("_top")))
    return top.join(top.groupBy(*keys).agg(F.sum("_e").alias("_sum")), keys).withColumn("p", F.col("_e") / F.col("_sum")).drop("_d", "_top", "_e", "_sum")


def draw_bin(histogram: DataFrame, keys: list[str], u: float, order: str = "bin") -> DataFrame:
    """The first bin whose cumulative share reaches u."""
    w = Window.partitionBy(*keys).orderBy(order)
    return histogram.withColumn("_c", F.sum("n").over(w)).join(histogram.groupBy(*keys).agg(F.sum("n").alias("_n")), keys).where(F.col("_c") >= F.lit(u) * F.col("_n")).groupBy(*keys).agg(F.min(order).alias(order))


def true_marginal(rows: DataFrame, start: float, end: float, n: int, cdf) -> DataFrame:
    """rows, each with the probability p of every bin under a distribution given by its CDF: a function of a Column, which may use the row's columns."""
    width = (end - start) / n
    edge = lambda i: F.lit(start) + i * width
    bins = rows.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return bins.withColumn("p", cdf(edge(F.col("bin") + 1)) - cdf(edge(F.col("bin"))))


# Divergences: how far a histogram still is from its limit.


def phi(n: Column) -> Column:
    """n (log n - psi(n)), the bias of a bin's entropy term."""
    return F.when(n <= 0, 0.0).otherwise(n * (F.log(n) - digamma_integer(n)))


def phi_differences(numbers: DataFrame, n: str = "n") -> DataFrame:
    """numbers with phi, phi1 and phi2: the function, and its first and second differences, at n >= 1."""
    at = lambda i: phi(F.col(n) + i)
    return numbers.withColumns({"phi": at(0), "phi1": at(1) - at(0), "phi2": at(2) - 2 * at(1) + at(0)})


def divergence(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """Of each group: bias (minimax), bias (average), entropy and extent scores, and none, from counts.

    The average bias is the expected first difference over the bins, a sample falling in proportion to counts."""
    n, total = F.col("n"), F.sum("n").cast("double")
    own = F.log(total) - F.sum(n * F.log(n)) / total
    # The average form's sum over a bin's visits m = 1 .. n of m times the second difference, summed by parts.
    one, two = phi(F.lit(1).cast("long")), phi(F.lit(2).cast("long"))
    visits = n * (phi(n + 1) - phi(n)) - 2 * (two - one) - (phi(n) - two)
    return histogram.where("n > 0").groupBy(*keys).agg(
        (F.sum(phi(n)) / total).alias("bias_minimax"),
        (-F.sum(visits) / total / (total + 1)).alias("bias_average"),
        own.alias("entropy_score"),
        (F.exp(2 * own) / total).alias("extent_score"),
        F.count(F.lit(1)).alias("n_bins"),
        total.alias("total"),
    )


def chi_square_scores(scored: DataFrame, quantile: DataFrame) -> DataFrame:
    """Half the chi-squared quantile at (number of bins - 1) degrees of freedom over the total.

    quantile: (dof, q), as many rows as there are different numbers of bins."""
    return scored.join(quantile, scored["n_bins"] - 1 == quantile["dof"], "left").withColumn("chi_square", F.coalesce(F.col("q"), F.lit(0.0)) / 2 / F.col("total")).drop("dof", "q")


def entropy_jackknife(visits: DataFrame, keys: list[str], place: str, bins: str = "bins", share: float = 0.5) -> DataFrame:
    """Entropy less ``share`` times the entropies of the odd and of the even half of the visits."""
    halves = entropy(counts(visits.withColumn("_odd", F.col(place) % 2), [*keys, "_odd"], bins), [*keys, "_odd"]).groupBy(*keys).agg(F.sum("entropy").alias("_halves"))
    return entropy(counts(visits, keys, bins), keys).join(halves, keys).select(*keys, (F.col("entropy") - share * F.col("_halves")).alias("score"))


def within(theta: Column, start: float, end: float) -> Column:
    """Positions in [start, end), in front of a bounded histogram."""
    return F.filter(theta, lambda v: (v >= start) & (v < end))


def draws(histogram: DataFrame, us: DataFrame, keys: list[str], order: str = "bin", bucket: int = 1024) -> DataFrame:
    """us (keys, draw, u) with the first bin whose cumulative share reaches u.

    Cells and draws stand on one line, at the cumulative counts and at u times the whole: as many cells as stand before a
    draw, so many bins are passed. Sums are taken in buckets, so that neither a key's bins nor its draws meet in one row."""
    cells = bucketed_sum(histogram, {"_at": F.col("n").cast("double"), "_place": F.lit(1)}, F.floor(F.col(order) / bucket), keys, [order])
    whole = histogram.groupBy(*keys).agg(F.sum("n").cast("double").alias("_n"), F.max(order).alias("_last"))
    marks = us.join(whole, keys).withColumn("_at", F.col("u") * F.col("_n"))
    line = marks.withColumns({"_cell": F.lit(0), "_place": F.lit(None).cast("int")}).unionByName(
        cells.join(whole, keys).select(*keys, "_at", "_n", "_last", F.lit(1).alias("_cell"), "_place"), allowMissingColumns=True
    )
    passed = bucketed_sum(line, {"_passed": F.col("_cell")}, F.floor(F.col("_at") / F.col("_n") * 256), keys, ["_at", "_cell"]).where("_cell = 0").withColumn("_place", F.col("_passed") + 1)
    found = passed.drop("_at", "_n", "_cell", "_passed").join(cells.select(*keys, "_place", order), [*keys, "_place"], "left")
    return found.select(*us.columns, F.coalesce(order, "_last").cast("int").alias(order))


def difference_density(dense: DataFrame, keys: list[str], width: float, bin_col: str = "bin", n: str = "n") -> DataFrame:
    """Of each cell between neighbouring bins: its probability by the exponentiated difference of their
    counts, and the log density when the cells share the bins' whole width."""
    cells = dense.withColumns({"_d": F.col(n) - F.lag(n).over(Window.partitionBy(*keys).orderBy(bin_col))}).where(F.col("_d").isNotNull())
    top = cells.groupBy(*keys).agg(F.max("_d").alias("_top"), F.count(F.lit(1)).alias("_cells"))
    raised = cells.join(top, keys).withColumn("_e", F.exp(F.col("_d") - F.col("_top")))
    whole = raised.groupBy(*keys).agg(F.sum("_e").alias("_sum"))
    p = F.col("_e") / F.col("_sum")
    cell_width = F.lit(width) * (F.col("_cells") + 1) / F.col("_cells")
    return raised.join(whole, keys).select(*keys, (F.col(bin_col) - 1).alias("cell"), p.alias("p"), (F.col("_d") - F.col("_top") - F.log("_sum") - F.log(cell_width)).alias("log_density"))


def chi_square_average(scored: DataFrame, initial: DataFrame, keys: list[str], quantile: DataFrame) -> DataFrame:
    """Average form of the chi-squared criterion: the criterion, and what another sample changes it by
    if it opens a bin, at the rate of new bins since the first ``initial`` (keys, bins_0, total_0) samples."""
    c = quantile.select((F.col("dof") + 1).alias("_bins"), (F.col("q") / 2).alias("_c"))
    own = scored.join(initial, keys).join(c, F.col("n_bins") == F.col("_bins"), "left").withColumn("_own", F.coalesce("_c", F.lit(0.0))).drop("_bins", "_c")
    both = own.join(c, F.col("n_bins") + 1 == F.col("_bins"), "left").withColumn("_more", F.coalesce("_c", F.lit(0.0)) - F.col("_own"))
    rate = F.when(F.col("total") > F.col("total_0"), (F.col("n_bins") - F.col("bins_0")) / (F.col("total") - F.col("total_0"))).otherwise(0.0)
    return both.select(*keys, ((F.col("_own") + F.col("total") * rate * F.col("_more")) / F.col("total") / (F.col("total") + 1)).alias("chi_square_average"))


def function_variance(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Divergence by the variance of a function of interest: its variance over the number of samples."""
    return values.groupBy(*keys).agg((F.var_pop(value) / F.count(F.lit(1))).alias("divergence"))
