"""What several operators share: word rules, Arrow batches, durable tables, distributed ranks.

Conventions that hold for every operator here:

* a null text counts as an empty one;
* a row is a document: repeated rows, also with the same id, each get their own result row;
* columns that an operator doesn't name pass by untouched; where an input column has the name of
  an output column, the output column replaces it;
* internal columns start with ``__tm_``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.sources.tables import durable  # noqa: F401  used by the operators

#: Words between ASCII white space.
SPACED = r"[^\x20\x09-\x0D]+"
#: Runs of ASCII letters and digits (lower case) and everything beyond ASCII.
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(F.coalesce(c, F.lit("")), UPPER, LOWER)


def words(c: Column, pattern: str = SPACED) -> Column:
    """Array of the lower-cased words of a text; empty for null. The pattern is a negated class and "+"."""
    return F.array_remove(F.split(ascii_lower(c), pattern.replace("[^", "[", 1)), "")


def py_lower(text: str) -> str:
    """Lower-cases A-Z only, as ascii_lower does."""
    return text.encode().lower().decode()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checked(rows: DataFrame, most: int) -> DataFrame:
    """rows of a written table, marked for a broadcast if there are ``most`` of them at most."""
    return F.broadcast(rows) if rows.count() <= most else rows


def hidden(docs: DataFrame, *but: str) -> tuple[DataFrame, list[Column]]:
    """docs with all columns but some under internal names, which can't clash with an operator's; and
    the columns to select to have docs' own names back."""
    names = {c: c if c in but else f"__tm_in{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), [F.col(v).alias(c) for c, v in names.items()]


def sliced(batches: Iterator[pa.RecordBatch], text: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to about ``most`` bytes of text, so that long texts don't pile up in a worker."""
    for b in batches:
        if b.num_rows == 0:
            continue
        step = max(1, int(b.num_rows * most / max(1, b.column(b.schema.get_field_index(text)).nbytes)))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def map_texts(df: DataFrame, text: str, keep: Sequence[str], fn: Callable[[list[str]], dict], schema: str, most: int = 8 << 20) -> DataFrame:
    """Applies fn (texts -> columns of as many values) batch by batch; ``keep`` columns pass by.

    schema: the DDL of fn's columns, in order. most: bytes of text in a batch, beyond its first text."""
    keep = [c for c in dict.fromkeys(keep)]
    src = df.select(*[F.col(c) for c in keep], F.coalesce(F.col(text), F.lit("")).alias("__tm_text"))
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    out = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in src.schema.fields[:-1])}, {schema}" if keep else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "__tm_text", most):
            made = fn(b.column(b.num_columns - 1).to_pylist())
            arrays = [*(b.column(i) for i in range(len(keep))), *(pa.array(made[f.name], type=f.type) for f in arrow)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *(f.name for f in arrow)])

    return src.mapInArrow(run, out)


def group_key(c: Column) -> Column:
    """A key without nulls: equal for equal values, and one of its own for null."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def shuffle_key(seed: str, *cols: Column) -> Column:
    """A reproducible random string: md5 of the seed and the columns."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]))


def hex_digits(rows: int, each: int) -> int:
    """So many leading hex digits of a shuffle_key make buckets of about ``each`` rows."""
    k = 1
    while k < 6 and 16**k * each < rows:
        k += 1
    return k
