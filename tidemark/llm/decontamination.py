"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short, documents long, so plain MinHash similarity between them says nothing; what
counts is which share of an item's shingles a document contains. Items are partitioned by size. An
item's sketch is the bottom-k of its shingle hashes (its k smallest), with k of its size class
chosen so that whoever contains the threshold's share of any item of that class must hold at least
one sketched hash: more than the 1 - threshold that may be missing. A document meeting a sketch,
and large enough to contain that item, is a candidate, and candidates are verified by the exact
containment of shingle strings. So no contaminated document is missed by the search.

Words are lower-cased runs of letters and digits (all beyond ASCII counts as letters), shingles are
five words. An item with fewer words is one shingle, the whole sequence, and is contained where that
stands; items and documents without words match nothing, as do null and empty texts.
Rows are told apart by id and text: null ids take part, repeated rows share their result. Repeated rows
of items report once. Ties don't arise: every pair that reaches the threshold is reported.

Sketches are broadcast only if there are fewer than BROADCAST_HASHES of them (16 bytes each);
otherwise the join shuffles by hash. Texts are read again only for candidates, whose keys are broadcast up to
BROADCAST_KEYS of them, so that the texts of other documents aren't shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ALNUM, durable, words

SHINGLE = 5
THRESHOLD = 0.8
#: Hashes with their item numbers that stay under 32 MB as a broadcast relation.
BROADCAST_HASHES = 200_000
#: Keys of candidate rows that stay under 40 MB as a broadcast relation.
BROADCAST_KEYS = 1_000_000


def _places(ws: Column, n: int) -> Column:
    """Where shingles of n words begin; empty for texts with too few words."""
    return F.when(F.size(ws) >= n, F.sequence(F.lit(1), F.size(ws) - n + 1)).otherwise(F.array().cast("array<int>"))


def word_hashes(ws: Column) -> Column:
    return F.transform(ws, lambda w: F.xxhash64(w))


def shingle_hashes(hs: Column, n: int = SHINGLE) -> Column:
    """Distinct hashes of each n word hashes in a row."""
    rows = F.slice(F.arrays_zip(*[F.slice(hs, k + 1, F.size(hs)).alias(f"w{k}") for k in range(n)]), 1, F.size(hs) - n + 1)
    return F.when(F.size(hs) >= n, F.array_distinct(F.transform(rows, lambda r: F.xxhash64(r)))).otherwise(F.array().cast("array<bigint>"))


def shingle_strings(ws: Column, n: int = SHINGLE) -> Column:
    return F.array_distinct(F.transform(_places(ws, n), lambda i: F.concat_ws(" ", *[F.element_at(ws, i + k) for k in range(n)])))


def _of_lengths(shingles, ws: Column, lengths: list[int]) -> Column:
    """Shingles of all these lengths."""
    return F.concat(*[shingles(ws, n) for n in lengths])


def _of_item(shingles, ws: Column) -> Column:
    """An item's shingles: one of the whole sequence where there are fewer words than SHINGLE."""
    out = shingles(ws, SHINGLE)
    for n in range(1, SHINGLE):
        out = F.when(F.size(ws) == n, shingles(ws, n)).otherwise(out)
    return out


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.coalesce(F.col(text_col), F.lit("")))


def sketches(items: DataFrame, threshold: float, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, n_item (shingles), n_words, least (shingles that a document must have), shingles, sketch."""
    known = items.select(F.col(id_col).alias("item_id"), words(F.col(text_col), ALNUM).alias("ws")).select("item_id", "ws", word_hashes(F.col("ws")).alias("hs")).select("item_id", F.size("ws").alias("n_words"), _of_item(shingle_hashes, F.col("hs")).alias("hashes"), _of_item(shingle_strings, F.col("ws")).alias("shingles"))
    # Written first: a filter on what is computed here would be pushed below and compute it again for each shingle.
    known = durable(known.withColumn("n_item", F.size("shingles")), "items").where("n_item > 0")
    # Size classes are powers of two; the class's largest size decides how much may be missing.
    upper = F.expr("CAST(pow(2, ceil(log2(n_item))) AS INT)")
    k = F.least(F.col("n_item"), F.floor(upper * F.lit(1 - threshold + 1e-9)).cast("int") + 1)
    least = F.ceil(F.col("n_item") * F.lit(threshold - 1e-9)).cast("int")
    return known.withColumns({"least": least, "sketch": F.slice(F.array_sort("hashes"), 1, k)}).drop("hashes")


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", broadcast_hashes: int = BROADCAST_HASHES, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Each pair of document and item whose containment reaches the threshold:
    __tm_key (of the row), the document's id, item_id, n_item, n_shared, containment."""
    known = sketches(items, threshold).withColumn("__tm_item", F.xxhash64("item_id", F.col("shingles")))
    lookup = known.select(F.explode_outer("sketch").alias("h"), "__tm_item", "least")
    sent = F.broadcast(lookup) if lookup.count() <= broadcast_hashes else lookup
    short = known.where(F.col("n_words") < SHINGLE).select("n_words").distinct().collect()
    lengths = [SHINGLE, *sorted(r["n_words"] for r in short)]

    keyed = docs.select(F.col(id_col).alias("__tm_id"), F.col(text_col).alias("__tm_text"), row_key(id_col, text_col).alias("__tm_key"))
    split = keyed.select("__tm_key", word_hashes(words(F.col("__tm_text"), ALNUM)).alias("ws"))
    # explode() would have the optimiser push a filter on the array's size, and with it a second
    # computation of words for each shingle, below the projection; explode_outer() doesn't.
    hashed = split.select("__tm_key", _of_lengths(shingle_hashes, F.col("ws"), lengths).alias("hs")).select("__tm_key", F.size("hs").alias("n_doc"), F.explode_outer("hs").alias("h"))
    candidates = durable(hashed.where(F.col("h").isNotNull()).join(sent, "h").where(F.col("n_doc") >= F.col("least")).select("__tm_key", "__tm_item").distinct(), "candidates")

    keys = candidates.select("__tm_key").distinct()
    keys = F.broadcast(keys) if keys.count() <= broadcast_keys else keys
    shared = F.size(F.array_intersect("shingles", "mine"))
    per_doc = candidates.join(known.select("__tm_item", "item_id", "n_item", "shingles"), "__tm_item")
    checked = durable(
        per_doc.join(keyed.join(keys, "__tm_key", "left_semi"), "__tm_key")
        .select("__tm_key", "__tm_id", "item_id", "n_item", "shingles", words(F.col("__tm_text"), ALNUM).alias("ws"))
        .select("__tm_key", "__tm_id", "item_id", "n_item", "shingles", _of_lengths(shingle_strings, F.col("ws"), lengths).alias("mine"))
        .select("__tm_key", F.col("__tm_id").alias(id_col), "item_id", F.col("n_item").cast("long").alias("n_item"), shared.cast("long").alias("n_shared")),
        "contained",
    )
    return checked.where(F.col("n_shared") >= F.ceil(F.col("n_item") * F.lit(threshold - 1e-9))).withColumn("containment", F.col("n_shared") / F.col("n_item")).distinct()


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that contain an item."""
    hit = contained(docs, items, threshold, id_col, text_col).select("__tm_key").distinct()
    return docs.withColumn("__tm_key", row_key(id_col, text_col)).join(hit, "__tm_key", "left_anti").drop("__tm_key")
