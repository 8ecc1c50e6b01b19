"""Sequential predictive p-values on streams.

Tumbling windows are counted with a watermark (late events are dropped), and a stateful step keeps
each series' posterior. A batch replay over the same windows gives the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.predictive import sequential, tails

SCORED = "series string, win long, r long, shape double, rate double, t double"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def windowed(events: DataFrame, width_days: float, delay: str = "1 hour") -> DataFrame:
    """(series, win, r) of a stream of (series, ts): counts of tumbling windows, numbered from 1970-01-01."""
    seconds = int(width_days * 86_400)
    return (
        events.withWatermark("ts", delay).groupBy("series", F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("r"))
        .select("series", (F.unix_timestamp("w.start") / seconds).cast("long").alias("win"), "r")
    )


class RunningPosterior(StatefulProcessor):
    """State of a series: how many events all earlier windows had.

    Windows of a micro-batch are scored in order; windows without events count as time passed."""

    def __init__(self, first: int, width: float, alpha: float, beta: float):
        self.first, self.width, self.alpha, self.beta = first, width, alpha, beta

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = self.seen.get()[0] if self.seen.exists() else 0
        every, out = pd.concat(list(rows)).sort_values("win"), []
        for w, r in zip(every["win"], every["r"], strict=True):
            out.append((key[0], int(w) - self.first, int(r), self.alpha + seen, self.beta + (int(w) - self.first) * self.width, self.width))
            seen += int(r)
        self.seen.update((seen,))
        yield pd.DataFrame(out, columns=["series", "win", "r", "shape", "rate", "t"])

    def close(self) -> None:
        pass


def posterior(windows: DataFrame, first: int, width: float, alpha: float, beta: float) -> DataFrame:
    """(SCORED) of each window of a stream: shape and rate from all earlier windows; windows count from first."""
    windows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return windows.groupBy("series").transformWithStateInPandas(RunningPosterior(first, width, alpha, beta), outputStructType=SCORED, outputMode="Append", timeMode="None")


def score(windows: DataFrame, first: int, width: float, alpha: float, beta: float) -> DataFrame:
    """Stateful scores with the tails of each window's count."""
    return tails(posterior(windows, first, width, alpha, beta), "r", "t", "shape", "rate")


def replay(windows: DataFrame, width: float, alpha: float, beta: float) -> DataFrame:
    """The same scores in batch, from (series, win, r) with windows from 0."""
    return sequential(windows, width, alpha, beta)
