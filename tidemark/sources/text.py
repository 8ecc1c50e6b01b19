"""Text sources and sinks: series, step functions, manifests, histograms, sample sizes, simulations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.timescale import StepFunction

TOKENS = r"\s+"


def _name(path) -> F.Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def read_series(spark: SparkSession, paths: str | list[str], column: str = "t", kind: str = "double", line_per_series: bool = False, limit: int | None = None) -> DataFrame:
    """(series, seq, column) of files of values between white space.

    A file is a series named by its stem, or each of its non-empty lines is one (stem and line
    number in the file's order). A line ends at its first value that can't be parsed. ``limit`` keeps the
    first so many values of each series. Files without values give no rows: keep their names in a
    series dimension."""
    # whole files keep their lines' order; series files are small, and there is one task for each few of them
    whole = spark.read.text(paths, wholetext=True).select(_name(F.col("_metadata.file_path")).alias("series"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
    whole = whole.where(F.trim("text") != "")
    if line_per_series:
        whole = whole.withColumn("series", F.concat_ws("#", "series", F.col("line").cast("string")))
    parsed = whole.select("series", "line", F.posexplode(F.split(F.trim("text"), TOKENS)).alias("place", "word")).withColumn("v", F.expr(f"try_cast(word AS {kind})"))
    bad = parsed.where(F.col("v").isNull()).groupBy("series", "line").agg(F.min("place").alias("stop"))
    good = parsed.join(bad, ["series", "line"], "left").where(F.col("stop").isNull() | (F.col("place") < F.col("stop")))
    from pyspark.sql import Window

    seq = F.row_number().over(Window.partitionBy("series").orderBy("line", "place")) - 1
    out = good.select("series", seq.cast("long").alias("seq"), F.col("v").alias(column))
    return out.where(F.col("seq") < limit) if limit is not None else out


def read_matrix(spark: SparkSession, path: str, rows: int, cols: int) -> DataFrame:
    """(row, col, v) of exactly rows x cols values; fails where a file holds fewer."""
    flat = read_series(spark, path, "v", limit=rows * cols)
    got = flat.count()
    if got < rows * cols:
        raise ValueError(f"{path} holds {got} values, not {rows * cols}")
    return flat.selectExpr(f"seq div {cols} AS row", f"seq % {cols} AS col", "v")


def read_manifest(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """(series, path) of a file that lists one path a line; every listed series stays, also empty ones."""
    return spark.read.text(path).where(F.trim("value") != "").select(_name(F.trim("value")).alias("series"), F.concat(F.lit(folder.rstrip("/") + "/"), F.trim("value")).alias("path"))


def read_manifest_series(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(series, seq, t) of all files of a manifest. The paths are a bounded listing, read by the driver as any file listing."""
    return read_series(spark, [r["path"] for r in manifest.select("path").collect()])


def read_step_function(spark: SparkSession, path: str, period: float) -> StepFunction | None:
    """Lines of knot and height; none where the file has no values."""
    rows = spark.read.text(path).select(F.split(F.trim("value"), TOKENS).alias("v")).where(F.size("v") == 2).selectExpr("try_cast(v[0] AS DOUBLE) knot", "try_cast(v[1] AS DOUBLE) height").where("knot IS NOT NULL AND height IS NOT NULL").orderBy("knot").collect()
    return StepFunction(tuple(r["knot"] for r in rows), tuple(r["height"] for r in rows), period) if rows else None


def read_histogram(spark: SparkSession, path: str) -> DataFrame:
    """(bins, n): each line holds a count and the bins."""
    v = F.split(F.trim("value"), TOKENS)
    return spark.read.text(path).where(F.trim("value") != "").select(F.slice(v, 2, F.size(v)).cast("array<int>").alias("bins"), v[0].cast("double").alias("n"))


def read_dense_histogram(spark: SparkSession, path: str, bins: int, dim: int) -> DataFrame:
    """(bins, n) of a file that holds a count for each of bins ** dim cells, the first component's bin changing fastest; cells
    of no count give no rows, nor do cells that the file lacks."""
    cell = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: F.floor(F.col("seq") / F.pow(F.lit(float(bins)), d)).cast("long") % bins)
    return read_series(spark, path, "n", limit=bins**dim).where("n <> 0").select(cell.cast("array<int>").alias("bins"), "n")


def write_dense_histogram(histogram: DataFrame, path: str, bins: int, dim: int, n: str = "n") -> None:
    """The counts of all bins ** dim cells, a line each, in the order that read_dense_histogram takes in one file: part files
    follow each other by name. Rows outside of the cells are an error."""
    good = (F.size("bins") == dim) & F.forall("bins", lambda b: (b >= 0) & (b < bins))
    place = F.aggregate(F.reverse("bins"), F.lit(0).cast("long"), lambda a, b: a * bins + b)
    seen = histogram.select(F.when(good, place).otherwise(F.raise_error(F.lit("a row lies outside of the cells"))).cast("long").alias("id"), F.col(n).alias("n")).groupBy("id").agg(F.sum("n").alias("n"))
    cells = histogram.sparkSession.range(bins**dim).join(seen, "id", "left").orderBy("id")
    cells.select(F.coalesce("n", F.lit(0)).cast("string").alias("value")).write.text(path)


def read_sample_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(interval, size)."""
    return read_series(spark, path, "size", "bigint").select(F.col("seq").cast("int").alias("interval"), "size")


def write_text(df: DataFrame, path: str, digits: int = 8) -> None:
    """Rows as lines, values between blanks, numbers with so many decimals; arrays spread out."""
    def shown(name: str, kind: str):
        if kind in ("double", "float"):
            return F.format_string(f"%.{digits}f", F.col(name))
        if kind.startswith("array<double"):
            return F.concat_ws(" ", F.transform(name, lambda x: F.format_string(f"%.{digits}f", x)))
        if kind.startswith("array"):
            return F.concat_ws(" ", F.col(name).cast("array<string>"))
        return F.col(name).cast("string")

    df.select(F.concat_ws(" ", *[shown(n, k) for n, k in df.dtypes]).alias("value")).write.text(path)


def lines(df: DataFrame, row: str, place: str, value: str, n: int | None = None, digits: int = 8, missing: str = "0") -> DataFrame:
    """(row, line): a row's values between blanks, by place. With n the places are 0 to n - 1, and absent ones show ``missing``;
    of several values at a place, the largest stands there. A line is one row of the result, bounded by its places."""
    shown = F.when(F.col(value).isNotNull(), F.format_string(f"%.{digits}f", value)) if dict(df.dtypes)[value] in ("double", "float") else F.col(value).cast("string")
    cells = df.groupBy(row, F.col(place).cast("int").alias("_place")).agg(F.max(value).alias(value)).select(row, "_place", F.coalesce(shown, F.lit(missing)).alias("_shown"))
    if n is not None:
        cells = cells.where(F.col("_place").between(0, n - 1))
    made = cells.groupBy(row).agg(F.array_sort(F.collect_list(F.struct("_place", "_shown"))).alias("_cells"))
    if n is None:
        return made.select(row, F.array_join(F.col("_cells._shown"), " ").alias("line"))
    by_place = F.map_from_entries("_cells")
    return made.select(row, by_place.alias("_cells")).select(row, F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.element_at("_cells", i), F.lit(missing))), " ").alias("line"))


def write_lines(rows: DataFrame, path: str, row: str) -> None:
    """Lines as text, in order of their row: part files follow each other."""
    rows.orderBy(row).select("line").write.text(path)


def simulate_gaussian(spark: SparkSession, n: int, cuts: list[int], means: list[float], sds: list[float], seed: int) -> DataFrame:
    """(series, seq, y): normal values whose mean and spread change at cuts (the first seq of a new segment)."""
    j = F.size(F.filter(F.array(*map(F.lit, [0, *cuts])), lambda c: c <= F.col("id")))
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), j)
    return spark.range(n).select(F.lit("gaussian").alias("series"), F.col("id").alias("seq"), (pick(means) + pick(sds) * F.randn(seed)).alias("y"))


def simulate_counts(spark: SparkSession, n: int, cuts: list[int], means: list[float], seed: int) -> DataFrame:
    """(series, seq, n): Poisson counts by inverse distribution, with means that change at cuts."""
    j = F.size(F.filter(F.array(*map(F.lit, [0, *cuts])), lambda c: c <= F.col("id")))
    rows = spark.range(n).withColumns({"mu": F.element_at(F.array(*[F.lit(float(v)) for v in means]), j), "u": F.rand(seed)})
    most = int(max(means) + 20 * max(means) ** 0.5 + 30)
    walk = F.aggregate(F.sequence(F.lit(0), F.lit(most)), F.struct(F.lit(0).alias("k"), F.exp(-F.col("mu")).alias("p"), F.lit(0.0).alias("c")),
                       lambda a, i: F.when(a["c"] + a["p"] >= F.col("u"), a).otherwise(F.struct((a["k"] + 1).alias("k"), (a["p"] * F.col("mu") / (i + 1)).alias("p"), (a["c"] + a["p"]).alias("c"))))
    return rows.select(F.lit("counts").alias("series"), F.col("id").alias("seq"), walk["k"].cast("long").alias("n"))


def simulate_process(spark: SparkSession, end: float, rate: float, cuts: list[float], factors: list[float], seed: int) -> DataFrame:
    """(series, seq, t): a Poisson process by thinning, rate * factor between cuts."""
    top = max(factors)
    n = int(end * rate * top + 6 * (end * rate * top) ** 0.5 + 10)
    factor = F.element_at(F.array(*[F.lit(float(f)) for f in factors]), F.size(F.filter(F.array(*[F.lit(float(c)) for c in [0.0, *cuts]]), lambda c: c <= F.col("t"))))
    # Given their number, the events of a homogeneous process are uniform.
    return spark.range(n).select((F.rand(seed) * (n / (rate * top))).alias("t"), F.rand(seed + 1).alias("u")).where(F.col("t") < end).where(F.col("u") < factor / top).select(F.lit("process").alias("series"), F.monotonically_increasing_id().alias("seq"), "t")
