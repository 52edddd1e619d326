"""Bounded working sets: a fair share of rows for each source, the newest first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.schema import DAY, SECOND


def source_counts(facts: DataFrame) -> DataFrame:
    return facts.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


def fair_budgets(counts: DataFrame, limit: int) -> DataFrame:
    """(source_id, n, budget) by max-min fairness: in order of size a source is kept whole
    while it needs no more than an equal share of what is left; the others share the rest
    equally, the first by id getting one more. Over one row a source."""
    by_size = Window.orderBy("n", "source_id")
    every = Window.partitionBy(F.lit(1))
    before = F.coalesce(F.sum("n").over(by_size.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.count("*").over(every) - F.row_number().over(by_size) + 1
    fits = counts.withColumn("fits", F.when(F.col("n") * left <= F.lit(limit) - before, 1).otherwise(0))
    whole = fits.withColumn("whole", F.min("fits").over(by_size.rowsBetween(Window.unboundedPreceding, 0)))
    kept = F.sum(F.when(F.col("whole") == 1, F.col("n")).otherwise(0)).over(every)
    rest = F.sum(1 - F.col("whole")).over(every)
    place = F.row_number().over(Window.partitionBy("whole").orderBy("source_id"))
    told = whole.select("source_id", "n", "whole", (F.lit(limit) - kept).alias("free"), rest.alias("rest"), place.alias("place"))
    share = ((F.col("free") - F.col("free") % F.greatest("rest", F.lit(1))) / F.greatest("rest", F.lit(1))).cast("bigint") + F.when(F.col("place") <= F.col("free") % F.greatest("rest", F.lit(1)), 1).otherwise(0)
    return told.select("source_id", "n", F.when(F.col("whole") == 1, F.col("n")).otherwise(share).cast("bigint").alias("budget"))


def newest(facts: DataFrame, limit: int, keys: tuple[str, ...] = ("source_id",), ties: tuple[str, ...] = ("id",)) -> DataFrame:
    """The newest `limit` rows of each key; Spark drops the others before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc("observed_us"), *[F.desc(t) for t in ties])
    return facts.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= limit).drop("__n")


def fair_window(facts: DataFrame, limit: int, ties: tuple[str, ...] = ("id",)) -> DataFrame:
    """The newest rows of each source within its budget, `limit` in all. No source has a
    budget above `limit`, so rows beyond that go before the shuffle."""
    budgets = fair_budgets(source_counts(facts), limit).select("source_id", "budget")
    order = Window.partitionBy("source_id").orderBy(F.desc("observed_us"), *[F.desc(t) for t in ties])
    top = facts.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= limit)
    return top.join(budgets, "source_id").where(F.col("__n") <= F.col("budget")).drop("__n", "budget")


def truncated_sources(facts: DataFrame, limit: int) -> DataFrame:
    """Sources that lose rows, with what overload reports of them."""
    lost = fair_budgets(source_counts(facts), limit).where("budget < n")
    seen = facts.groupBy("source_id").agg(F.sort_array(F.collect_set("agent")).alias("agents"), F.sort_array(F.collect_set("channel")).alias("channels"))
    return lost.join(seen, "source_id")


def without_first(rows: DataFrame, n: int, time: str = "observed_us", ties: tuple[str, ...] = ("id",)) -> DataFrame:
    """`rows` without the `n` oldest (ties by further columns). The time up to which all go is
    found by counts of days, then of the seconds of one day; only the rows of one second are
    ranked, so `n` rows never meet in one task."""
    if n <= 0:
        return rows
    inside, left, low = rows, n, None
    for width in (DAY, SECOND):
        start = F.col(time) - F.pmod(F.col(time), F.lit(width))
        counts = inside.groupBy(start.alias("start")).agg(F.count(F.lit(1)).alias("n"))
        upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy("start")))
        edge = upto.where(F.col("upto") > left).orderBy("start").first()
        if edge is None:
            return rows.limit(0)
        low, left = edge["start"], left - (edge["upto"] - edge["n"])
        inside = inside.where(F.col(time).between(low, low + width - 1))
    ranked = inside.withColumn("__n", F.row_number().over(Window.orderBy(time, *ties)))
    return rows.where(F.col(time) >= low + SECOND).unionByName(ranked.where(F.col("__n") > left).drop("__n"))


def without_oldest(facts: DataFrame, n: int, by: tuple[str, ...] = ("observed_us", "kind", "id")) -> DataFrame:
    return without_first(facts, n, by[0], by[1:])


def with_retained(current: DataFrame, facts: DataFrame, unhealthy: DataFrame, seconds: int, cap: int = 128) -> DataFrame:
    """The current rows, and of each unhealthy source without any the rows of its own last
    window, `cap` at most, unless they are there already."""
    from gaugeworks.operators.filters import in_closed_window, with_newest

    silent = unhealthy.select("source_id").distinct().join(current.select("source_id"), "source_id", "left_anti")
    own = with_newest(facts.join(silent, "source_id", "left_semi"), ["source_id"])
    kept = newest(own.where(in_closed_window(F.col("newest_us"), seconds)).drop("newest_us"), cap)
    return current.unionByName(kept.join(current.select("id"), "id", "left_anti").select(*current.columns))
