"""Operators on event series: rows of (series, t, ...).

Running sums, lags and as-of counts are taken in two levels: rows are bucketed by time, a small
table of bucket totals gives what lies before each bucket, and only a bucket's rows are sorted
together. A series that holds a third of all rows is then many buckets, not one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucketed(df: DataFrame, width: float) -> DataFrame:
    return df.withColumn("_b", F.floor(F.col("t") / width))


def _within(keys: list[str], order: list[Column | str]):
    return Window.partitionBy(*keys, "_b").orderBy(*order)


def bucketed_sum(df: DataFrame, values: dict[str, Column], bucket: Column, keys: list[str], order: list[Column | str], reverse: bool = False, before: bool = False) -> DataFrame:
    """df with each named running sum of a value per key, in an order that the bucket follows: buckets
    ascend with it. before: what stands before the row, without its own value. reverse: sums from the end, order being columns' names or ascending."""
    named = {f"_v_{k}": v for k, v in values.items()}
    df = df.withColumns({**named, "_b": bucket})
    # A frame that reaches to the end is summed anew for each row: reversed sums run over the reversed order instead.
    turned = [F.desc(c) for c in order] if reverse else list(order)
    outer = Window.partitionBy(*keys).orderBy(F.desc("_b") if reverse else F.asc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, "_b").agg(*[F.sum(v).alias(v) for v in named])
    ahead = totals.select(*keys, "_b", *[F.coalesce(F.sum(v).over(outer), F.lit(0)).alias(f"_o{v}") for v in named])
    inner = _within(keys, turned).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    out = df.join(ahead, [*keys, "_b"])
    for k, v in zip(values, named, strict=True):
        out = out.withColumn(k, F.col(f"_o{v}") + F.coalesce(F.sum(v).over(inner), F.lit(0)))
    return out.drop("_b", *named, *[f"_o{v}" for v in named])


def running_sum(df: DataFrame, values: dict[str, Column], width: float, keys: tuple[str, ...] = ("series",), order: tuple[str, ...] = ("t",), reverse: bool = False) -> DataFrame:
    """df with each named running sum of a value, in order of t (ties by the rest of order), per series."""
    return bucketed_sum(df, values, F.floor(F.col("t") / width), list(keys), list(order), reverse)


def previous(df: DataFrame, value: str, out: str, width: float, keys: tuple[str, ...] = ("series",), order: tuple[str, ...] = ("t",)) -> DataFrame:
    """df with the value of the row before, in order of t; null for a series' first row."""
    keys = list(keys)
    df = _bucketed(df, width)
    place = F.struct(*[F.col(c) for c in order])
    lasts = df.groupBy(*keys, "_b").agg(F.max_by(F.struct(value), place).alias("_last"))
    carried = lasts.select(*keys, "_b", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_b")).alias("_carried"))
    inner = _within(keys, list(order))
    value_before = F.when(F.row_number().over(inner) == 1, F.col("_carried")[value]).otherwise(F.lag(value).over(inner))
    return df.join(carried, [*keys, "_b"]).withColumn(out, value_before).drop("_b", "_carried")


def argsort(df: DataFrame, width: float, keys: tuple[str, ...] = ("series",), ties: tuple[str, ...] = ("seq",)) -> DataFrame:
    """df with its rank (from 0) in order of t, ties by position."""
    return running_sum(df, {"rank": F.lit(1)}, width, keys, ("t", *ties)).withColumn("rank", F.col("rank") - 1)


def count_before(events: DataFrame, probes: DataFrame, width: float, keys: tuple[str, ...] = ("series",), inclusive: bool = False) -> DataFrame:
    """probes (keys, t, ...) with idx, the number of events with a smaller t (or at most t): an as-of
    count by union and running sum, without a range join. Every probe stays, also of an empty series."""
    keys = list(keys)
    extra = [c for c in probes.columns if c not in (*keys, "t")]
    own = probes.select(*keys, "t", F.struct(*[F.col(c) for c in extra] or [F.lit(1).alias("_")]).alias("_p"), F.lit(0).alias("_e"))
    both = own.unionByName(events.select(*keys, "t", F.lit(1).alias("_e")), allowMissingColumns=True)
    # At equal t, probes come before events, or after them if those count.
    turn = F.lit(1) - F.col("_e") if inclusive else F.col("_e")
    counted = running_sum(both.withColumn("_turn", turn), {"idx": F.col("_e")}, width, tuple(keys), ("t", "_turn"))
    return counted.where("_e = 0").select(*keys, "t", *[F.col(f"_p.{c}").alias(c) for c in extra], "idx")


def segment_counts(events: DataFrame, cuts: DataFrame, width: float, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """Segments between neighbouring cuts (keys, t): j, tau_l, tau_r, length and r, the events in [tau_l, tau_r)."""
    keys = list(keys)
    at = Window.partitionBy(*keys).orderBy("t")
    idx = count_before(events, cuts.select(*keys, "t"), width, tuple(keys))
    ends = idx.select(*keys, (F.row_number().over(at) - 1).alias("j"), F.col("t").alias("tau_l"), F.lead("t").over(at).alias("tau_r"), (F.lead("idx").over(at) - F.col("idx")).alias("r"))
    return ends.where(F.col("tau_r").isNotNull()).withColumn("length", F.col("tau_r") - F.col("tau_l"))


def even_cuts(series: DataFrame, start: float, end: float, n: int) -> DataFrame:
    """Cuts of n segments of equal width for each series of the dimension."""
    return series.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n)))).withColumn("t", F.lit(start) + F.col("i") * ((end - start) / n)).drop("i")


def fold(df: DataFrame, period: float) -> DataFrame:
    """df with t folded into the period, and the turn it was in, from which it can be undone."""
    turn = F.floor(F.col("t") / period)
    return df.withColumns({"turn": turn.cast("long"), "folded": F.col("t") - turn * period})


def unfold(df: DataFrame, period: float) -> DataFrame:
    return df.withColumn("t", F.col("folded") + F.col("turn") * period)


def season(folded: Column, knots: tuple[float, ...]) -> Column:
    """How many of the knots lie strictly before the folded time."""
    return F.size(F.filter(F.array(*map(F.lit, knots)), lambda k: k < folded))


def column_subset(df: DataFrame, columns: DataFrame) -> DataFrame:
    """Rows whose seq is in the given table."""
    return df.join(columns.select("seq"), "seq", "left_semi")


def sliding(df: DataFrame, size: int, slide: int) -> DataFrame:
    """Count windows of ``size`` consecutive seq, every ``slide``: a row for each window that holds it."""
    first = F.greatest(F.lit(0), F.ceil((F.col("seq") - size + 1) / slide)).cast("long")
    last = F.floor(F.col("seq") / slide).cast("long")
    return df.withColumn("window", F.explode(F.when(first <= last, F.sequence(first, last)))).where(F.col("seq") < F.col("window") * slide + size)


def thin(samples: DataFrame, every: int, burn_in: int = 0) -> DataFrame:
    """Of a chain's rows: those after the burn-in, each n-th."""
    return samples.where((F.col("iteration") > burn_in) & ((F.col("iteration") - burn_in) % every == 0))
