"""Mixing sources to target weights by systematic sampling.

Documents of a source are put in order of size, then of a seeded hash, in tables of any size; the
prefix sums of the expected copies, shifted by one random offset, cross integers, and a document is emitted once for
each integer that it crosses. The order by size keeps the words taken near the target.

Documents with over 1 / PARTS of a source's words (fewer than PARTS of them) are drawn first, from the largest down. Each
expects, from none to ``most`` copies, what the source still misses of its target over the words still to come, so
that each makes up for those before it, and no more than fit into that if the rest can make it up; all the others expect what is missing after them. So the words taken are within about
1 / PARTS of the source's size of its target; of a source of few documents, within about the size of its smallest one.

Targets: sources in code-point order, null last, weigh 5, 2, 1, 5, ...; they share the sum of all
sizes by weight, but none takes over ``most`` times its own size, and what is cut off goes to the
others by weight (water filling, solved in closed form over the sorted ratios of cap to weight).

No source is ranked in one task: rows are bucketed by size class; a class of many rows by size, and
a size of many rows by leading hash digits too. Buckets follow the order, so that they only spread
the work; small tables of counts give what stands before a bucket.

Edge cases: null is a source of its own; null and blank texts have size 0 and take part with their
copies, but take no words; sources without words have target 0; repeated rows are each sampled, in
any order among themselves; an empty table gives an empty result. Columns of the input named as an
output column are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import checked, durable, group_key, shuffle_key

OUT = ("size", "source_size", "target", "copies", "taken")
SEED = "mix-1"
WEIGHTS = (5, 2, 1)
MOST = 3
#: Sources, full classes and full sizes are broadcast up to so many, so that whole rows are shuffled once.
BROADCAST_ROWS = 200_000
#: A document with over 1 / PARTS of its source's words is drawn before the others.
PARTS = 100
#: Rows that should meet in a bucket at most.
BUCKET_ROWS = 20_000


def offset(seed: str) -> float:
    """The one random offset in [0, 1)."""
    return int(hashlib.md5(seed.encode()).hexdigest()[:8], 16) / 2**32


def size_key(size: Column) -> Column:
    """A string that grows with size: the number of its digits, then the digits, in base 16."""
    h = F.lower(F.hex(size))
    return F.concat(F.lpad(F.length(h).cast("string"), 2, "0"), h)


def size_class(size: Column) -> Column:
    """The start of size_key, in steps of a few percent: digits, then the two leading ones."""
    return F.substring(size_key(size), 1, 4)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(__tm_g, source, source_size) of each source, with target. As many rows as there are sources."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("__tm_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    whole, by_ratio = Window.partitionBy(), Window.orderBy("__tm_ratio", "__tm_g")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("source_size") * float(most)
    # If all sources of smaller ratio are capped, the others share the rest at this level per weight.
    level = weighed.withColumn("__tm_ratio", cap / F.col("__tm_w")).withColumn(
        "__tm_level",
        (F.sum(F.col("source_size").cast("double")).over(whole) - F.coalesce(F.sum(cap).over(before), F.lit(0.0)))
        / (F.sum("__tm_w").over(whole) - F.coalesce(F.sum("__tm_w").over(before), F.lit(0.0))),
    )
    first = F.min(F.when(F.col("__tm_level") <= F.col("__tm_ratio"), F.struct("__tm_ratio", "__tm_g", "__tm_level"))).over(whole)
    return level.withColumn("target", F.least(cap, first["__tm_level"] * F.col("__tm_w"))).select("__tm_g", "source_size", "target")


def _drawn(rank: Column, rate: Column, u: float) -> Column:
    """How many integers the expected copies of this rank cross."""
    return (F.floor(rank * rate + u) - F.floor((rank - 1) * rate + u)).cast("long")


def mix(docs: DataFrame, size: Column, identity: list[Column], source_col: str = "source", seed: str = SEED, bucket_rows: int = BUCKET_ROWS, most: int = MOST) -> DataFrame:
    """docs with size, source_size, target, copies (how often the mix has the row) and taken (copies * size)."""
    kept = [c for c in docs.columns if c.lower() not in OUT]
    u, g, n = offset(seed), F.col("__tm_g"), F.col("__tm_size")
    # Sizes and hashes are computed once and written: what follows reads them several times.
    keyed = docs.select(*kept, size.cast("long").alias("__tm_size"), group_key(F.col(source_col)).alias("__tm_g"), shuffle_key(seed, *identity).alias("__tm_h"), F.col(source_col).alias("__tm_source"))
    keyed = durable(keyed.withColumn("__tm_k", size_class(n)), "sized")
    sums = keyed.groupBy("__tm_g").agg(F.first("__tm_source").alias("source"), F.sum("__tm_size").alias("source_size"))
    sources = durable(targets(sums, most=most), "sources")
    keyed = keyed.drop("__tm_source").join(checked(sources, BROADCAST_ROWS), "__tm_g")
    is_large = n * PARTS > F.col("source_size")

    # The largest first, so that what they miss is made up for by smaller ones: fewer than PARTS of a source in all.
    ranked = keyed.where(is_large).withColumn("__tm_r", F.row_number().over(Window.partitionBy("__tm_g").orderBy(n.desc(), "__tm_h")))
    lists = ranked.groupBy("__tm_g").agg(F.array_sort(F.collect_list(F.struct("__tm_r", "__tm_size"))).alias("__tm_a"))

    def next_one(s: Column, x: Column) -> Column:
        size = x["__tm_size"]
        share = F.when(s["left"] > 0, F.least(F.lit(float(most)), F.greatest(F.lit(0.0), s["missing"] / s["left"]))).otherwise(0.0)
        fit = F.floor(F.greatest(F.lit(0.0), s["missing"]) / size).cast("double")
        expected = F.when((s["left"] - size) * most >= s["missing"] - fit * size, F.least(share, fit)).otherwise(share)
        copies = (F.floor(s["sum"] + expected + u) - F.floor(s["sum"] + u)).cast("long")
        return F.struct((s["missing"] - copies * x["__tm_size"]).alias("missing"), (s["left"] - x["__tm_size"]).alias("left"), (s["sum"] + expected).alias("sum"), F.concat(s["copies"], F.array(copies)).alias("copies"))

    begin = F.struct(F.col("target").alias("missing"), F.col("source_size").cast("double").alias("left"), F.lit(0.0).alias("sum"), F.array().cast("array<bigint>").alias("copies"))
    some = F.coalesce("__tm_a", F.array().cast("array<struct<__tm_r:int,__tm_size:bigint>>"))
    folded = durable(sources.join(lists, "__tm_g", "left").select("__tm_g", F.aggregate(some, begin, next_one).alias("__tm_s")), "large")
    large = ranked.join(checked(folded, BROADCAST_ROWS), "__tm_g").withColumn("copies", F.element_at("__tm_s.copies", F.col("__tm_r")))
    left, missing = F.col("__tm_s.left"), F.col("__tm_s.missing")
    rates = folded.select("__tm_g", F.when(left > 0, F.least(F.lit(float(most)), F.greatest(F.lit(0.0), missing / left))).otherwise(0.0).alias("__tm_rate"))

    # Few classes and sizes can have more rows than a bucket, so that these tables are small.
    rest = keyed.where(~is_large)
    sizes = rest.groupBy("__tm_g", "__tm_k", "__tm_size").agg(F.count(F.lit(1)).alias("__tm_n"))
    classes = sizes.groupBy("__tm_g", "__tm_k").agg(F.sum("__tm_n").alias("__tm_n")).where(F.col("__tm_n") > bucket_rows).select("__tm_g", "__tm_k", F.lit(True).alias("__tm_many"))
    # Digits as in hex_digits, for the rows of one size.
    digits = F.least(F.lit(6), F.greatest(F.lit(1), F.ceil(F.log(16.0, F.col("__tm_n") / bucket_rows)).cast("int")))
    heavy = sizes.where(F.col("__tm_n") > bucket_rows).select("__tm_g", "__tm_size", digits.alias("__tm_d"))
    bucket = F.when(F.col("__tm_many"), F.concat(size_key(n), F.lit(":"), F.when(F.col("__tm_d").isNull(), "").otherwise(F.substring(F.col("__tm_h"), F.lit(1), F.col("__tm_d"))))).otherwise(F.col("__tm_k"))
    classes, heavy = checked(durable(classes, "classes"), BROADCAST_ROWS), checked(durable(heavy, "heavy"), BROADCAST_ROWS)
    rest = rest.join(classes, ["__tm_g", "__tm_k"], "left").join(heavy, ["__tm_g", "__tm_size"], "left").withColumn("__tm_b", bucket)
    before = Window.partitionBy("__tm_g").orderBy("__tm_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = rest.groupBy("__tm_g", "__tm_b").agg(F.count(F.lit(1)).alias("__tm_n")).withColumn("__tm_before", F.coalesce(F.sum("__tm_n").over(before), F.lit(0))).drop("__tm_n").join(rates, "__tm_g")
    rank = F.col("__tm_before") + F.row_number().over(Window.partitionBy("__tm_g", "__tm_b").orderBy("__tm_size", "__tm_h"))
    rest = rest.join(starts, ["__tm_g", "__tm_b"]).withColumn("__tm_r", rank).withColumn("copies", _drawn(F.col("__tm_r"), F.col("__tm_rate"), u))

    out = [*kept, "__tm_size", "source_size", "target", "copies"]
    return rest.select(*out).unionByName(large.select(*out)).select(*kept, n.alias("size"), "source_size", "target", "copies", (F.col("copies") * n).alias("taken"))


def emit(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each row as often as it was drawn."""
    return mixed.where("copies > 0").withColumn("__tm_i", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*columns)
