"""Event series from star-schema tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORIGIN = "2024-01-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def days(column: str) -> str:
    """SQL expression: days since the origin, as a double."""
    return f"timestampdiff(MICROSECOND, timestamp_ntz'{ORIGIN}', {column}) / 8.64e10D"


def event_series(spark: SparkSession, sf_dir: str, key: str = "event_type") -> DataFrame:
    """(series, seq, user_id, t, value) of the events table; t in days."""
    return read(spark, sf_dir, "events").selectExpr(f"CAST({key} AS STRING) AS series", "event_id AS seq", "user_id", f"{days('ts')} AS t", "value")


def series_of(events: DataFrame) -> DataFrame:
    """The series dimension."""
    return events.select("series").distinct()


def order_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, seq, n): orders by status and day."""
    o = read(spark, sf_dir, "orders").selectExpr("o_orderstatus AS series", "CAST(o_orderdate AS DATE) AS day")
    return o.groupBy("series", "day").agg(F.count(F.lit(1)).alias("n")).selectExpr("series", "CAST(datediff(day, DATE'1970-01-01') AS BIGINT) AS seq", "n")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is set, a new local one if all tasks run here."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def durable(df: DataFrame, tag: str) -> DataFrame:
    """Writes df into the shared folder and reads it again: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/tidemark/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
