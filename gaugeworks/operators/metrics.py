"""Live figures with their quality, coverage, state and freshness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.schema import SECOND, TOKEN_PARTS


def all_or_null_sum(column: str) -> Column:
    """Null if any row lacks the value."""
    return F.when(F.count(column) == F.count(F.lit(1)), F.sum(column))


def beside(*rows: DataFrame) -> DataFrame:
    """One-row tables, of distinct columns, side by side: united with nulls where a table lacks
    a column, then each column's one value. Unlike cross joins, all of it is one job."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return every.coalesce(1).agg(*[F.first(c, ignorenulls=True).alias(c) for c in every.columns])


def combined_quality(derived_result: bool = False, column: str = "quality") -> Column:
    """empty -> unavailable; the worst of estimated, unavailable, derived; else measured."""
    has = lambda q: F.max(F.when(F.col(column) == q, 1).otherwise(0)) == 1
    derived = F.lit(True) if derived_result else has("derived")
    return F.when(F.count(F.lit(1)) == 0, "unavailable").when(has("estimated"), "estimated").when(has("unavailable"), "unavailable").when(derived, "derived").otherwise("measured")


def combined_authority(column: str = "authority") -> Column:
    """The one authority, mixed if there are several, null if none."""
    return F.when(F.min(column) == F.max(column), F.min(column)).when(F.count(column) > 0, "mixed")


def mixed_quality(column: str = "quality") -> Column:
    return F.coalesce(F.min(column) != F.max(column), F.lit(False))


def data_state(retained: Column, total: Column, rows: Column) -> Column:
    """absent without rows, stale if retained, zero if nothing was counted, else null (live)."""
    return F.when(rows == 0, "absent").when(retained, "stale").when(total == 0, "zero")


def throughput(facts: DataFrame, seconds: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Output tokens a second over a window's facts, and per active session."""
    sums = facts.groupBy(*keys).agg(
        F.sum("output_tokens").alias("output_tokens"), F.count_distinct("agent", "session_id").alias("sessions"), F.count(F.lit(1)).alias("facts"),
        combined_quality(True).alias("quality"), combined_authority().alias("authority"), mixed_quality().alias("mixed"),
        F.coalesce(F.bool_or(F.col("quality") == "unavailable"), F.lit(False)).alias("unavailable"),
    )
    rate = F.col("output_tokens").cast("double") / float(seconds)
    return sums.select(*keys, "output_tokens", "sessions", "facts", rate.alias("tokens_per_s"), F.when(F.col("sessions") > 0, rate / F.col("sessions")).alias("per_session"), "quality", "authority", F.when(F.col("mixed") | F.col("unavailable"), "partial").otherwise("complete").alias("coverage"))


def burn(facts: DataFrame, seconds: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Tokens of all kinds a minute over the facts that have a total; a part that any such
    fact lacks is null though the total still counts."""
    capable = F.col("burn_total").isNotNull()
    sums = facts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("facts"), F.count_if(capable).alias("capable"), F.sum("burn_total").alias("burn_total"),
        *[F.when(F.count_if(capable & F.col(p).isNull()) == 0, F.sum(F.when(capable, F.col(p)))).alias(p) for p in TOKEN_PARTS],
    )
    whole = F.col("facts") == F.col("capable")
    for p in TOKEN_PARTS:
        whole = whole & F.col(p).isNotNull()
    return sums.select(*keys, "facts", "capable", "burn_total", (F.col("burn_total").cast("double") / float(seconds) * 60.0).alias("tokens_per_min"), *TOKEN_PARTS, F.when(whole, "complete").otherwise("partial").alias("coverage"))


def calls(facts: DataFrame, seconds: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Distinct calls a minute; facts that authority leaves out count too."""
    known = (F.col("call_id").isNotNull()) & (F.col("call_id") != "")
    sums = facts.groupBy(*keys).agg(F.count_distinct(F.when(known, F.struct("agent", "call_id"))).alias("calls"), F.bool_and(known).alias("whole"))
    return sums.select(*keys, "calls", (F.col("calls").cast("double") / float(seconds) * 60.0).alias("calls_per_min"), F.when(F.col("whole"), "complete").otherwise("partial").alias("coverage"))


def freshness(facts: DataFrame, now_us: Column | int, keys: tuple[str, ...] = ("source_id",)) -> DataFrame:
    """Newest time of each source and its age, never below 0."""
    now = now_us if isinstance(now_us, Column) else F.lit(now_us)
    newest = facts.groupBy(*keys).agg(F.max("observed_us").alias("newest_us"))
    return newest.withColumn("age_s", F.greatest(F.lit(0.0), (now - F.col("newest_us")) / float(SECOND)))


def options(facts: DataFrame) -> DataFrame:
    """Models to choose from, by unfiltered facts: of each raw name the display that was
    seen first."""
    first = F.min(F.struct("observed_us", "id", "model_display")).alias("f")
    return facts.groupBy("model_raw").agg(first).select("model_raw", F.col("f.model_display").alias("model_display")).orderBy("model_display", "model_raw")
