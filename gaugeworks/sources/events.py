"""Usage and performance facts derived from the generic `events` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators.authority import burn_total
from gaugeworks.schema import DAY
from gaugeworks.sources import footers


def newest(spark: SparkSession, sf_dir: str) -> int:
    """Time of the newest event, from the table's footers."""
    return footers.newest(spark, f"{sf_dir}/events.parquet", "ts") or 0


def usage_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One usage fact per event; error events have no call id and no burn total."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    user, event = F.col("user_id"), F.col("event_id")
    observed = F.unix_micros(F.col("ts").cast("timestamp"))
    kind = F.col("event_type")
    capable = kind != "error"
    facts = e.select(
        F.concat(F.lit("ev-"), F.lpad(event.cast("string"), 9, "0")).alias("id"),
        F.when(user % 3 == 0, "src-a").when(user % 3 == 1, "src-b").otherwise("src-c").alias("source_id"),
        F.when(user % 2 == 0, "agent-a").otherwise("agent-b").alias("agent"),
        F.concat(F.lit("m"), (user % 7).cast("string")).alias("model_raw"),
        F.concat(F.lit("Model "), (user % 7 % 6).cast("string")).alias("model_display"),
        user.cast("string").alias("session_id"),
        observed.alias("observed_us"),
        F.floor("value").cast("bigint").alias("output_tokens"),
        F.when(capable, F.get_json_object("props", "$.k")).alias("call_id"),
        F.when(kind == "purchase", "enhanced").otherwise("fallback").alias("tier"),
        F.when(kind.isin("purchase", "click"), "auth-main").otherwise(F.concat(F.lit("auth-"), kind)).alias("authority"),
        F.when(kind == "purchase", "derived").when(kind == "signup", "estimated").when(kind == "error", "unavailable").otherwise("measured").alias("quality"),
        F.lit("call").alias("granularity"),
        (observed - F.pmod(observed, F.lit(DAY))).alias("range_start_us"),
        (observed - F.pmod(observed, F.lit(DAY)) + DAY).alias("range_end_us"),
        (event % 50).alias("input_uncached"),
        (event % 11).alias("cache_read"),
        F.when(event % 5 != 0, event % 7).alias("cache_write"),
        F.when(event % 3 != 0, event % 13).alias("output_visible"),
        (event % 4).alias("reasoning"),
        kind.alias("channel"),
    )
    return facts.withColumn("burn_total", F.when(F.col("channel") != "error", burn_total()))


def performance_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per event; requests of a user with the same number are retries or repeats."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(
        F.concat(F.col("user_id").cast("string"), F.lit("-"), k.cast("string")).alias("request_id"),
        F.when(F.col("user_id") % 2 == 0, "agent-a").otherwise("agent-b").alias("agent"),
        F.concat(F.lit("m"), (F.col("user_id") % 7).cast("string")).alias("model_raw"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("observed_us"),
        (F.floor("value") * 100 + 50).cast("double").alias("duration_ms"),
        k.cast("double").alias("ttft_ms"),
        (F.col("event_id") % 97).alias("output_total"),
        (F.col("event_type") == "error").alias("is_retry"),
        F.when(F.col("event_type") == "purchase", "enhanced").otherwise("fallback").alias("tier"),
        F.lit("request").alias("granularity"),
        F.when(F.col("event_type") == "signup", "unavailable").otherwise("measured").alias("quality"),
        F.when(F.col("user_id") % 3 == 0, "src-a").when(F.col("user_id") % 3 == 1, "src-b").otherwise("src-c").alias("source_id"),
        F.col("event_type").alias("channel"),
    )
