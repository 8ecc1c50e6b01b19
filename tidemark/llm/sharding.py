"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source. Sorted by fractional rank
(rank - 1/2) / rows of the source, each stretch of the order holds the sources in the proportions of
the whole; cut into equal stretches, every shard matches the mixture, and shards differ by one row
at most (law ``rows``).

Neither rank is taken in one task. Within a source, rows are bucketed by the leading digits of
their hash: small tables of counts give what stands before a bucket, and only rows of a bucket are
sorted together. The global order is bucketed by fractional rank; what stands before such a bucket
follows from the sources' sizes alone, without a second pass over the rows.

Edge cases: null is a source of its own; null ids and texts are hashed as empty strings; repeated
rows are each placed, in any order among themselves; fewer rows than shards leave shards empty; an
empty table gives an empty result. Columns of the input named as an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import group_key, hex_digits, shuffle_key

OUT = ("shard", "slot")
SEED = "interleave-1"
#: Rows that should meet in a bucket.
BUCKET_ROWS = 2000
#: Stretches in a block, whose running sums are taken together.
BLOCK = 4096


def rows_ahead(sizes: DataFrame, stretches: int, block: int = BLOCK) -> DataFrame:
    """__tm_s, __tm_ahead: how many rows stand before each stretch that holds rows.

    sizes: one row per source, with its number of rows __tm_m. Sources of one size count together; a size
    yields a row per rank or per stretch, whichever are fewer, so that there are never more than rows of
    the input, however many sources there are. Running sums are taken within blocks and over the blocks."""
    items = F.least("__tm_m", F.lit(stretches))
    # Of a source with m rows, ranks r with (2r - 1) * stretches < 2m * s stand before stretch s.
    before = "(2 * __tm_m * {} + {}L) div {}L"
    upto = [before.format(s, stretches - 1, 2 * stretches) for s in ("__tm_i", "(__tm_i + 1)")]
    few = F.col("__tm_m") < stretches
    held = (
        sizes.groupBy("__tm_m").agg(F.count(F.lit(1)).alias("__tm_sources"))
        .withColumn("__tm_k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((items - 1) / block))))
        .repartition(max(1, stretches // block), "__tm_m", "__tm_k")
        .withColumn("__tm_i", F.explode(F.sequence(F.col("__tm_k") * block, F.least((F.col("__tm_k") + 1) * block, items) - 1)))
        .select(
            F.when(few, F.expr(f"((2 * __tm_i + 1) * {stretches}L) div (2 * __tm_m)")).otherwise(F.col("__tm_i")).alias("__tm_s"),
            (F.col("__tm_sources") * F.when(few, F.lit(1)).otherwise(F.expr(f"{upto[1]} - {upto[0]}"))).alias("__tm_n"),
        )
        .groupBy("__tm_s").agg(F.sum("__tm_n").alias("__tm_n"))
        .withColumn("__tm_k", F.expr(f"__tm_s div {block}L"))
    )

    def running(*by: str, order: str) -> Column:
        return F.coalesce(F.sum("__tm_n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    # At most 16^6 / BLOCK blocks.
    blocks = held.groupBy("__tm_k").agg(F.sum("__tm_n").alias("__tm_n")).withColumn("__tm_one", F.lit(0))
    blocks = blocks.select("__tm_k", running("__tm_one", order="__tm_k").alias("__tm_earlier"))
    return held.withColumn("__tm_within", running("__tm_k", order="__tm_s")).join(blocks, "__tm_k").select("__tm_s", (F.col("__tm_earlier") + F.col("__tm_within")).alias("__tm_ahead"))


def interleave(docs: DataFrame, n_shards: int, identity: list[Column], source_col: str = "source", seed: str = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """docs with shard (0 .. n_shards - 1) and slot (gapless from 0 in each shard).

    identity: columns or expressions that tell rows apart; the shuffle depends on them and the seed."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in OUT])
    n = docs.count()
    digits = hex_digits(n, bucket_rows)
    stretches = 16**digits
    kept = list(docs.columns)
    keyed = docs.withColumns({"__tm_g": group_key(F.col(source_col)), "__tm_h": shuffle_key(seed, *identity)}).withColumn("__tm_b", F.substring("__tm_h", 1, digits))

    # What stands before each bucket of a source, and how many rows the source has.
    by_source = Window.partitionBy("__tm_g")
    starts = (
        keyed.groupBy("__tm_g", "__tm_b").agg(F.count(F.lit(1)).alias("__tm_n"))
        .select("__tm_g", "__tm_b", F.coalesce(F.sum("__tm_n").over(by_source.orderBy("__tm_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__tm_before"), F.sum("__tm_n").over(by_source).alias("__tm_rows"))
    )
    ranked = keyed.join(starts, ["__tm_g", "__tm_b"]).withColumn("__tm_r", F.col("__tm_before") + F.row_number().over(Window.partitionBy("__tm_g", "__tm_b").orderBy("__tm_h")))
    ranked = ranked.withColumns({"__tm_f": (F.col("__tm_r") - 0.5) / F.col("__tm_rows"), "__tm_s": F.expr(f"((2 * __tm_r - 1) * {stretches}L) div (2 * __tm_rows)")})

    ahead = rows_ahead(keyed.groupBy("__tm_g").agg(F.count(F.lit(1)).alias("__tm_m")), stretches)
    placed = (
        ranked.join(ahead, "__tm_s")
        .withColumn("__tm_p", F.col("__tm_ahead") + F.row_number().over(Window.partitionBy("__tm_s").orderBy("__tm_f", "__tm_g", "__tm_h")) - 1)
        .withColumn("shard", F.expr(f"CAST((__tm_p * {n_shards}L) div {max(n, 1)}L AS INT)"))
    )
    return placed.withColumn("slot", F.expr(f"__tm_p - (shard * {max(n, 1)}L + {n_shards - 1}L) div {n_shards}L")).select(*kept, *OUT)
