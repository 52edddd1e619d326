"""foreachBatch sinks: upserts, conditional upserts and rollups that survive replays.

A table is a folder of Parquet partitioned by UTC day. A micro-batch rewrites the days that
it touches, from their rows and its own, so running a batch again gives the same files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.operators.authority import coalesce_performance
from gaugeworks.operators.metrics import all_or_null_sum
from gaugeworks.operators.rollups import day_start
from gaugeworks.schema import SECOND
from gaugeworks.sources.stores import exists, remove_folder


def _existing(path: str, like: DataFrame) -> DataFrame:
    return like.sparkSession.read.schema(like.schema).parquet(path) if exists(path) else like.limit(0)


def _remove_days(path: str, days: list[int]) -> None:
    """Drops day partitions that have no row any more (a dynamic overwrite leaves them)."""
    for day in days:
        remove_folder(f"{path.rstrip('/')}/day={day}")


def last_wins(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both; of equal keys the new one."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def prefer_performance(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both; of equal requests the preferred one."""
    return coalesce_performance(old.unionByName(new)).select(*new.columns)


def day_table(path: str, merge: Callable[[DataFrame, DataFrame], DataFrame], keys: list[str], time: str = "observed_us") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges a batch into the day partitions it touches: its own
    days, and those where rows of its keys stand, so that a row that moves to another day
    leaves no copy behind. To find those only keys and days of the table are read."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("day", day_start(time))
        there = _existing(path, rows)
        moved = there.select(*keys, "day").join(rows.select(*keys).distinct(), keys, "left_semi").select("day")
        days = rows.select("day").unionByName(moved).distinct()
        old = there.join(F.broadcast(days), "day", "left_semi")
        merged = merge(old, rows)
        # the files read are replaced below, so the merged days are held outside them first
        held = f"{path.rstrip('/')}__batch"
        merged.write.mode("overwrite").partitionBy("day").parquet(held)
        again = spark.read.schema(rows.schema).parquet(held)
        emptied = [r["day"] for r in days.join(again.select("day").distinct(), "day", "left_anti").collect()]
        again.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
        _remove_days(path, emptied)

    return write


def upsert_facts(path: str) -> Callable[[DataFrame, int], None]:
    """Last write wins per id; of a batch the newest row of an id."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        best = Window.partitionBy("id").orderBy(F.desc("observed_us"))
        return last_wins(old, new.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n"), ["id"])

    return day_table(path, merge, ["id"])


def upsert_performance(path: str) -> Callable[[DataFrame, int], None]:
    return day_table(path, prefer_performance, ["agent", "request_id", "granularity"])


def windowed(facts: DataFrame, width_s: int, late_s: int) -> DataFrame:
    """Sums per tumbling window and model of a stream, sent once a window is closed by the
    watermark; later rows stay raw and are for the batch rollup to mark."""
    timed = facts.withColumn("at", F.timestamp_micros("observed_us")).withWatermark("at", f"{late_s} seconds")
    sums = timed.groupBy(F.window("at", f"{width_s} seconds"), "model_raw").agg(F.sum("output_tokens").alias("output_tokens"), all_or_null_sum("burn_total").alias("burn_total"), F.count(F.lit(1)).alias("facts"))
    return sums.select((F.unix_micros("window.start") / SECOND * SECOND).cast("bigint").alias("bucket_us"), "model_raw", "output_tokens", "burn_total", "facts")
