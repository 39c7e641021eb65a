"""Quality of event streams while they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_quality(events: DataFrame, ts: str = "ts", key: str = "event_type", value: str = "value", late: str = "10 minutes", length: str = "1 hour") -> DataFrame:
    """Count, missing values, mean and spread of every key and window; events later than ``late`` are dropped, as the watermark says.

    Works on a stream and on a table alike.
    """
    stamped = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    out = stamped.groupBy(F.window("__ts", length), key).agg(F.count("*").alias("n"), F.count_if(F.col(value).isNull()).alias("n_missing"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("spread"))
    return out.select(F.col("window.start").alias("start"), key, "n", "n_missing", "mean", "spread")
