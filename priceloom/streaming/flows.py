"""Structured Streaming twins of the vote tally and the service counters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_vote_tally(events: DataFrame, item: str = "item", user: str = "user", ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """Running votes per item, one per item and user within the watermark; for update or complete mode."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([item, user]).groupBy(item).agg(F.count(F.lit(1)).alias("votes"))


def stream_query_metrics(events: DataFrame, ts: str = "ts", width: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Requests, errors and mean latency per window; late events beyond the watermark are dropped."""
    return (
        events.withWatermark(ts, delay)
        .groupBy(F.window(ts, width).alias("w"))
        .agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("kind") == "error").alias("errors"), F.avg("latency").alias("mean_latency"))
        .select(F.col("w.start").alias("window_start"), "requests", "errors", "mean_latency")
    )


VOTERS = "item string, user string, ts timestamp, batch bigint, day date"
ADDED = "item string, added bigint, batch bigint"


def voter_merge(root: str, ttl_days: int) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that counts (item, user, ts) votes once for each item and user within ttl_days.

    Voters are a table under root, partitioned by batch and day; a batch is held against the days that its votes can
    repeat, so what is read is bounded by the time to live and not by a watermark's state. A batch writes its own
    partitions only, voters before counts, and doesn't read them: run again after a failure, it gives the same.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.where("item IS NOT NULL AND user IS NOT NULL AND ts IS NOT NULL").groupBy(F.col("item").cast("string").alias("item"), F.col("user").cast("string").alias("user"))
        new = new.agg(F.min("ts").alias("ts"))
        first = new.agg(F.to_date(F.min("ts"))).first()[0]
        if first is None:
            return
        # An empty table with the folder's columns, so that the first batch reads like any other.
        spark.createDataFrame([], VOTERS).write.mode("ignore").partitionBy("batch", "day").parquet(f"{root}/voters")
        known = spark.read.schema(VOTERS).parquet(f"{root}/voters").where((F.col("batch") != number) & (F.col("day") >= F.date_sub(F.lit(first), ttl_days)))
        known = known.groupBy("item", "user").agg(F.max("ts").alias("last"))
        seen = (new["item"] == known["item"]) & (new["user"] == known["user"]) & (known["last"] >= new["ts"] - F.make_dt_interval(F.lit(ttl_days)))
        fresh = new.join(known, seen, "left_anti").withColumns({"batch": F.lit(number).cast("bigint"), "day": F.to_date("ts")})
        replace = lambda df, name, *by: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{root}/{name}")
        replace(fresh, "voters", "batch", "day")
        counted = spark.read.schema(VOTERS).parquet(f"{root}/voters").where(F.col("batch") == number).groupBy("item", "batch").agg(F.count(F.lit(1)).alias("added"))
        replace(counted.select("item", "added", "batch"), "added", "batch")

    return merge


def voter_tally(spark: SparkSession, root: str) -> DataFrame:
    """(item, votes) of all batches that voter_merge has counted."""
    return spark.read.schema(ADDED).parquet(f"{root}/added").groupBy("item").agg(F.sum("added").alias("votes"))


def stream_voters(events: DataFrame, root: str, ttl_days: int):
    """The writer of a stream of (item, user, ts) votes into root; the caller sets its trigger and starts it."""
    return events.writeStream.foreachBatch(voter_merge(root, ttl_days)).option("checkpointLocation", f"{root}/checkpoint")
