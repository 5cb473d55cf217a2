"""Streaming ingestion of events: deduplication, windowed thinning and online parent links.

The batch operators have no streaming counterpart of their own; these are the same rules over a stream
with a watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_events(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files that appear in *folder*."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def deduplicated(events: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """The first row of each key; state is kept for *delay* of event time."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def thinned(events: DataFrame, ts: str, window: str, cell: float, delay: str) -> DataFrame:
    """The largest event of each cell and time window, emitted once the watermark passes the window."""
    keyed = events.withWatermark(ts, delay).groupBy(
        F.window(ts, window), F.floor(F.col("x") / F.lit(float(cell))).alias("cx"), F.floor(F.col("y") / F.lit(float(cell))).alias("cy")
    )
    best = F.max(F.struct("mag", (-F.col("id")).alias("order"), "x", "y")).alias("b")
    return keyed.agg(best, F.count("*").alias("n")).select("window", "cx", "cy", (-F.col("b.order")).alias("id"), "b.mag", "n")


def parent_links(events: DataFrame, cell: float, keep: int = 64) -> DataFrame:
    """``(id, parent, log_eta)`` as events arrive, from the last *keep* earlier events of the same cell (a bounded state)."""

    def link(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        past = list(zip(*state.get, strict=True)) if state.exists else []
        rows = []
        for batch in batches:
            for e in batch.sort_values(["t", "id"]).itertuples():
                best = (None, None)
                if past:
                    p = np.array(past, float)
                    p = p[p[:, 3] < e.t]
                    if len(p):
                        d = np.maximum(np.hypot(p[:, 1] - e.x, p[:, 2] - e.y), 0.1)
                        eta = np.log10(np.maximum((e.t - p[:, 3]) / 86400, 1 / 86400)) + 1.6 * np.log10(d) - p[:, 4] / 100
                        i = int(np.lexsort((p[:, 0], np.round(eta, 9)))[0])
                        best = (int(p[i, 0]), float(eta[i]))
                rows.append((e.id, *best))
                past = [*past, (float(e.id), float(e.x), float(e.y), float(e.t), float(e.mag or 0))][-keep:]
        state.update(tuple(map(list, zip(*past, strict=True))))
        yield pd.DataFrame(rows, columns=["id", "parent", "log_eta"]).astype({"parent": "Int64"})

    rows = events.select(
        F.floor(F.col("x") / F.lit(float(cell))).alias("cx"), F.floor(F.col("y") / F.lit(float(cell))).alias("cy"), "id",
        F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), (F.unix_micros("ts") / 1e6).alias("t"), F.col("mag").cast("double").alias("mag"),
    )
    kept = "id array<double>, x array<double>, y array<double>, t array<double>, mag array<double>"
    return rows.groupBy("cx", "cy").applyInPandasWithState(link, "id long, parent long, log_eta double", kept, "append", "NoTimeout")
