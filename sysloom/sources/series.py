"""Series that the given tables hold: one row per series and step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hour 0 of the hourly series.
START = "2024-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def exact_sum(c: Column, scale: int = 6) -> Column:
    """A sum that doesn't depend on the order of rows."""
    return F.sum(c.cast(f"decimal(24,{scale})")).cast("double")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``series_id, t, v, n``: summed values and counts of every event type in every hour from the first to the last of the table; ``v`` is null where nothing happened."""
    from pyspark.sql import Window

    events = table(spark, sf_dir, "events")
    start = F.unix_micros(F.lit(START).cast("timestamp"))
    seen = events.groupBy(F.col("event_type").alias("series_id"), F.floor((micros(F.col("ts")) - start) / 3_600_000_000).alias("t")).agg(exact_sum(F.col("value")).alias("v"), F.count("*").alias("n"))
    every = Window.partitionBy()  # over one row a series
    ends = seen.groupBy("series_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).select("series_id", F.min("lo").over(every).alias("lo"), F.max("hi").over(every).alias("hi"))
    grid = ends.select("series_id", F.explode(F.sequence("lo", "hi")).alias("t"))
    return grid.join(seen, ["series_id", "t"], "left").select("series_id", "t", "v", F.coalesce("n", F.lit(0)).cast("double").alias("n"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``series_id, t, u1, u2, y``: shipped quantity and lines (in tens), and price (in hundred thousands), of a return flag by day, centred.

    ``t`` numbers the days on which anything was shipped.
    """
    from pyspark.sql import Window

    days = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("series_id"), F.to_date("l_shipdate").alias("day")).agg(exact_sum(F.col("l_quantity")).alias("q"), F.count("*").cast("double").alias("c"), exact_sum(F.col("l_extendedprice")).alias("p"))
    w, own = Window.partitionBy("series_id").orderBy("day"), Window.partitionBy("series_id")
    centred = lambda c, s: F.round((F.col(c) - F.avg(c).over(own)) / s, 4)
    return days.select("series_id", (F.row_number().over(w) - 1).cast("long").alias("t"), centred("q", 10.0).alias("u1"), centred("c", 10.0).alias("u2"), centred("p", 100_000.0).alias("y"))


def per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``series_id, ord, ts, v``: a user's events in the order of the file, on whole minutes."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("series_id"), F.col("event_id").alias("ord"), F.floor(micros(F.col("ts")) / 60_000_000).alias("ts"), F.col("value").alias("v"))


def supplied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``series_id, t, u1, u2, y``: shipped quantity, lines and price (in thousands) of every supplier by day, ``t`` numbering the days."""
    from pyspark.sql import Window

    days = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("series_id"), F.to_date("l_shipdate").alias("day")).agg(exact_sum(F.col("l_quantity")).alias("u1"), F.count("*").cast("double").alias("u2"), (exact_sum(F.col("l_extendedprice")) / 1000).alias("y"))
    return days.select("series_id", (F.row_number().over(Window.partitionBy("series_id").orderBy("day")) - 1).cast("long").alias("t"), "u1", "u2", "y")
