"""Latency distributions by exact nearest-rank quantiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOW_SAMPLES = 5


#: Cells for each doubling of a value in the coarse pass.
CELLS = 64


def nearest_ranks(facts: DataFrame, column: str, quantiles: dict[str, float], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, samples, a column per quantile): sorted[ceil(p n) - 1], exactly. A first pass
    counts cells of logarithmic width, which tells in which cell each rank lies; a second one
    counts the values of those cells alone. Both combine before their shuffle, windows run
    over one group's cells or the values of one cell, and no group is held in memory."""
    x = F.col(column).cast("double")
    cell = F.when(x > 0, F.floor(F.log2(x) * CELLS)).when(x < 0, -F.floor(F.log2(-x) * CELLS) - (1 << 40)).otherwise(-(1 << 39)).cast("bigint")
    rows = facts.where(F.col(column).isNotNull()).select(*keys, F.col(column).alias("value"), cell.alias("cell"))
    cells = rows.groupBy(*keys, "cell").agg(F.count(F.lit(1)).alias("n"))
    group = [F.col(k) for k in keys] or [F.lit(1)]
    upto = Window.partitionBy(*group).orderBy("cell")
    counted = cells.withColumn("upto", F.sum("n").over(upto)).withColumn("samples", F.sum("n").over(Window.partitionBy(*group)))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(p).alias("p")) for name, p in quantiles.items()])
    ranked = counted.select(*keys, "cell", "samples", (F.col("upto") - F.col("n")).alias("before"), "upto", F.inline(wanted)).withColumn("rank", F.greatest(F.ceil(F.col("p") * F.col("samples")), F.lit(1)))
    found = ranked.where((F.col("before") < F.col("rank")) & (F.col("rank") <= F.col("upto"))).select(*[F.col(k).alias(f"of_{k}") for k in keys], F.col("cell").alias("of_cell"), "samples", "name", (F.col("rank") - F.col("before")).alias("nth"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys], F.col("cell") == F.col("of_cell"))
    values = rows.join(found.select(*[c for c in found.columns if c.startswith("of_")]).distinct(), same, "left_semi").groupBy(*keys, "cell", "value").agg(F.count(F.lit(1)).alias("n"))
    running = values.withColumn("to", F.sum("n").over(Window.partitionBy(*group, "cell").orderBy("value")))
    hit = running.join(found, same).where((F.col("to") - F.col("n") < F.col("nth")) & (F.col("nth") <= F.col("to")))
    return hit.groupBy(*keys).agg(F.first("samples").alias("samples"), *[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in quantiles])


def normal(facts: DataFrame) -> DataFrame:
    """Requests that are no retries and whose quality is known."""
    return facts.where("NOT is_retry AND quality <> 'unavailable'")


def distribution(facts: DataFrame, column: str, quantiles: dict[str, float], keys: tuple[str, ...] = ()) -> DataFrame:
    """Number of samples and exact quantiles of each group that has any."""
    return nearest_ranks(facts, column, quantiles, keys).withColumn("low_sample", F.col("samples").between(1, LOW_SAMPLES - 1))


def decode_valid() -> Column:
    return (F.col("output_total") >= 2) & (F.col("duration_ms") > F.col("ttft_ms"))


def with_decode_tps(facts: DataFrame) -> DataFrame:
    """Valid requests with the speed at which they were decoded after the first token."""
    tps = (F.col("output_total") - 1) / ((F.col("duration_ms") - F.col("ttft_ms")) / 1000.0)
    return facts.where(decode_valid()).withColumn("decode_tps", tps)


def exclusions(facts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """How many requests are retries, and how many of the others can't be decoded."""
    usual = ~F.col("is_retry") & (F.col("quality") != "unavailable")
    return facts.groupBy(*keys).agg(F.count_if("is_retry").alias("retries"), F.count_if(usual & ~decode_valid()).alias("decode_invalid"), F.count_if(usual).alias("normal"))


def latency_stats(facts: DataFrame, column: str, reference: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """p50, p95, maximum, and whether p95 is under a reference; the maximum is the quantile 1."""
    out = nearest_ranks(facts, column, {"p50": 0.5, "p95": 0.95, "most": 1.0}, keys).drop("samples")
    return out.withColumn("verdict", F.when(F.col("p95") < reference, "MEET").otherwise("MISS"))
