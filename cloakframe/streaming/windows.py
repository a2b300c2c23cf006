"""Row-local operators run on streams as they are; these need windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_group_sizes(events: DataFrame, time: str, keys: Sequence[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """k of each group of quasi-identifiers in each window; batch or stream."""
    x = F.col(time).cast("timestamp")
    rows = events.withColumn("__t", x)
    if events.isStreaming:
        rows = rows.withWatermark("__t", late)
    return rows.groupBy(F.window("__t", width).alias("w"), *keys).agg(F.count("*").alias("k")).select(F.col("w.start").alias("start"), *keys, "k")
