"""Bucketed trends: a gap-filled grid of epoch-aligned buckets per ranked series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.operators.metrics import all_or_null_sum
from gaugeworks.schema import SECOND, TOKEN_PARTS

SERIES, POINTS = 5, 180
OTHER = "Other"


def span(now_us: int, width_s: int, window_s: int) -> tuple[int, int, int]:
    """Start and end of the completed buckets, and the last bucket start of the grid: the
    open bucket's if now lies inside one."""
    width = width_s * SECOND
    end = now_us // width * width
    return end - window_s * SECOND, end, end if now_us > end else end - width


def bucket_start(width_s: int, time: str = "observed_us") -> Column:
    return F.col(time) - F.pmod(F.col(time), F.lit(width_s * SECOND))


def bucketed(facts: DataFrame, now_us: int, width_s: int, window_s: int, keys: tuple[str, ...] = ("model_raw",)) -> DataFrame:
    """Sums of each completed bucket and key, combined before the shuffle."""
    start, end, _ = span(now_us, width_s, window_s)
    inside = facts.where((F.col("observed_us") >= start) & (F.col("observed_us") < end))
    return inside.groupBy(bucket_start(width_s).alias("bucket_us"), *keys).agg(
        F.sum("output_tokens").alias("output_tokens"), F.sum("burn_total").alias("burn_total"), F.count(F.lit(1)).alias("facts"),
        F.min("model_display").alias("model_display"), *[all_or_null_sum(p).alias(p) for p in TOKEN_PARTS],
    )


def first_calls(facts: DataFrame) -> DataFrame:
    """Of each (agent, call) the first fact in order of time and id."""
    known = facts.where("call_id IS NOT NULL AND call_id <> ''")
    rest = [c for c in facts.columns if c not in ("agent", "call_id", "observed_us", "id")]
    best = known.groupBy("agent", "call_id").agg(F.min(F.struct("observed_us", "id", *rest)).alias("f"))
    return best.select("agent", "call_id", *[F.col(f"f.{c}").alias(c) for c in ("observed_us", "id", *rest)]).select(*facts.columns)


def ranked(buckets: DataFrame, value: str = "output_tokens", series: int = SERIES) -> DataFrame:
    """Models by total (ties by display, then raw name), each with the series it belongs to:
    with more than `series` models all but the top series - 1 are Other; of the others, equal
    titles name the model too. One row a model, so the window that ranks them is small."""
    totals = buckets.groupBy("model_raw").agg(F.sum(value).alias("total"), F.min("model_display").alias("model_display"))
    by_total = Window.orderBy(F.desc("total"), "model_display", "model_raw")
    rank = totals.withColumn("rank", F.row_number().over(by_total)).withColumn("models", F.count("*").over(Window.partitionBy(F.lit(1))))
    hidden = (F.col("models") > series) & (F.col("rank") >= series)
    shared = F.count_if(~hidden).over(Window.partitionBy("model_display")) > 1
    own = F.when(shared, F.concat("model_display", F.lit(" ("), "model_raw", F.lit(")"))).otherwise(F.col("model_display"))
    return rank.withColumn("series", F.when(hidden, OTHER).otherwise(own)).withColumn("series_rank", F.least("rank", F.lit(series)))


def grid(names: DataFrame, now_us: int, width_s: int, window_s: int, points: int = POINTS) -> DataFrame:
    """The newest `points` bucket starts for each series; the open bucket is in it."""
    start, _, last = span(now_us, width_s, window_s)
    width = width_s * SECOND
    start = max(start, last - (points - 1) * width)
    return names.select("*", F.explode(F.sequence(F.lit(start).cast("bigint"), F.lit(last).cast("bigint"), F.lit(width).cast("bigint"))).alias("bucket_us"))


def trend(facts: DataFrame, now_us: int, width_s: int, window_s: int, value: str = "output_tokens", per_s: float = 1.0) -> DataFrame:
    """(series, series_rank, bucket_us, amount, rate, facts) for every series and bucket: a
    completed bucket without facts, like the open one, has a null amount, not 0. Facts of
    unavailable quality don't count; rate is the amount per `per_s` seconds. Charts that one
    measurement may enter but once are to be given the facts that authority selects."""
    buckets = bucketed(facts.where(F.col(value).isNotNull() & (F.col("quality") != "unavailable")), now_us, width_s, window_s)
    rank = ranked(buckets, value)
    merged = buckets.join(rank.select("model_raw", "series"), "model_raw").groupBy("series", "bucket_us").agg(F.sum(value).alias("amount"), F.sum("facts").alias("facts"))
    names = rank.groupBy("series").agg(F.min("series_rank").alias("series_rank"))
    full = grid(names, now_us, width_s, window_s).join(merged, ["series", "bucket_us"], "left")
    return full.withColumn("rate", F.col("amount").cast("double") / float(width_s) * per_s)


def calls_trend(facts: DataFrame, now_us: int, width_s: int, window_s: int) -> DataFrame:
    """Calls a minute in each bucket, every call counted where it was first seen."""
    start, end, _ = span(now_us, width_s, window_s)
    inside = first_calls(facts.where((F.col("observed_us") >= start) & (F.col("observed_us") < end)))
    counted = inside.groupBy(bucket_start(width_s).alias("bucket_us")).agg(F.count(F.lit(1)).alias("calls"))
    one = facts.sparkSession.range(1).select(F.lit("calls").alias("series"))
    full = grid(one, now_us, width_s, window_s).join(counted, "bucket_us", "left")
    return full.select("bucket_us", "calls", (F.col("calls").cast("double") / float(width_s) * 60.0).alias("calls_per_min"))


def parts_trend(facts: DataFrame, now_us: int, width_s: int, window_s: int) -> DataFrame:
    """(part, bucket_us, amount): what is there of each token part, over capable facts."""
    start, end, _ = span(now_us, width_s, window_s)
    capable = facts.where((F.col("observed_us") >= start) & (F.col("observed_us") < end) & F.col("burn_total").isNotNull() & (F.col("quality") != "unavailable"))
    sums = capable.groupBy(bucket_start(width_s).alias("bucket_us")).agg(*[F.sum(p).alias(p) for p in TOKEN_PARTS])
    return sums.unpivot("bucket_us", TOKEN_PARTS, "part", "amount").where("amount IS NOT NULL")


def table(points: DataFrame, series: list[str] | None = None, missing: str = "—") -> DataFrame:
    """A row per bucket and a column per series; what is missing is a dash."""
    cell = F.coalesce(F.first("amount", ignorenulls=True).cast("string"), F.lit(missing))
    wide = points.groupBy("bucket_us").pivot("series", series).agg(cell)
    return wide.select("bucket_us", *[F.coalesce(F.col(f"`{c}`"), F.lit(missing)).alias(c) for c in wide.columns[1:]])


def segments(points: DataFrame) -> DataFrame:
    """(series, segment, start_us, end_us, points): runs of buckets that have amounts."""
    order = Window.partitionBy("series").orderBy("bucket_us")
    gap = F.col("amount").isNull()
    islands = points.withColumn("segment", F.sum(F.when(gap, 1).otherwise(0)).over(order)).where(~gap)
    return islands.groupBy("series", "segment").agg(F.min("bucket_us").alias("start_us"), F.max("bucket_us").alias("end_us"), F.count(F.lit(1)).alias("points"))


def emphasis(other: Column | None = None) -> Column:
    """How a series is drawn: other, estimated, partial or normal; whether anything is
    estimated, and the coverage, are those of the whole chart."""
    return F.when(F.col("series") == OTHER if other is None else other, "other").when(F.col("estimated"), "estimated").when(F.col("coverage") == "partial", "partial").otherwise("normal")


def normalised(points: DataFrame) -> DataFrame:
    """x = i / max(n - 1, 1) for the buckets of each series, in order; those without an
    amount have places too, so a gap stays a gap."""
    own = Window.partitionBy("series")
    i, n = F.row_number().over(own.orderBy("bucket_us")) - 1, F.count("*").over(own)
    return points.withColumn("x", i / F.greatest(n - 1, F.lit(1)))


def stacked(parts: DataFrame) -> DataFrame:
    """Totals of the parts of each bucket, mergeable with any other such table."""
    return parts.groupBy("bucket_us").agg(F.sum("amount").alias("amount"))


def merged(tables: list[DataFrame], keys: list[str], values: list[str]) -> DataFrame:
    """Partial sums of several tables added up."""
    return reduce(DataFrame.unionByName, tables).groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])
