"""Daily rollups, late data, retention and reset."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.operators.bounded import without_first
from gaugeworks.operators.metrics import all_or_null_sum, combined_quality
from gaugeworks.schema import DAY, ROLLUP_COHORT, TOKEN_PARTS


def day_start(time: str = "observed_us") -> Column:
    return F.col(time) - F.pmod(F.col(time), F.lit(DAY))


def daily(facts: DataFrame) -> DataFrame:
    """A row per UTC day and cohort: sums, parts that every fact has, quality and count."""
    return facts.groupBy(day_start().alias("bucket_us"), *ROLLUP_COHORT).agg(
        F.sum("output_tokens").alias("output_tokens"), all_or_null_sum("burn_total").alias("burn_total"), *[all_or_null_sum(p).alias(p) for p in TOKEN_PARTS],
        combined_quality(True).alias("quality"), F.min("model_display").alias("model_display"), F.count(F.lit(1)).alias("samples"),
    )


def complete_days(facts: DataFrame, cutoff_us: int) -> DataFrame:
    """The full UTC days before a cutoff that have facts."""
    return facts.select(day_start().alias("bucket_us")).where(F.col("bucket_us") < cutoff_us // DAY * DAY).distinct()


def compact(facts: DataFrame, rollups: DataFrame, cutoff_us: int, pruned_before_us: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rollups, facts) after rolling up the full days before the cutoff. A day that was
    rolled up or pruned before is left alone: its late facts stay facts and its rollups
    become partial. `rollups` has a coverage column."""
    days = complete_days(facts, cutoff_us)
    known = rollups.select("bucket_us").distinct()
    old = F.lit(False) if pruned_before_us is None else F.col("bucket_us") < pruned_before_us
    fresh = days.join(known, "bucket_us", "left_anti").where(~old)
    of_day = facts.withColumn("bucket_us", day_start())
    added = daily(of_day.join(fresh, "bucket_us", "left_semi").drop("bucket_us")).withColumn("coverage", F.lit("complete"))
    late = days.join(known, "bucket_us", "left_semi").select("bucket_us", F.lit(True).alias("__late"))
    marked = rollups.join(late, "bucket_us", "left").withColumn("coverage", F.when(F.col("__late"), "partial").otherwise(F.col("coverage"))).drop("__late")
    return marked.unionByName(added.select(*rollups.columns)), of_day.join(fresh, "bucket_us", "left_anti").drop("bucket_us")


def coverage_since(start_us: int, pruned_before_us: int | None) -> str:
    """partial if anything from the start on may be gone."""
    return "partial" if pruned_before_us is not None and start_us <= pruned_before_us else "complete"


def earliest(*tables: DataFrame) -> DataFrame:
    """The least time over several tables (time_us), one partial minimum each."""
    every = tables[0].select("time_us")
    for t in tables[1:]:
        every = every.unionByName(t.select("time_us"))
    return every.agg(F.min("time_us").alias("earliest_us"))


@dataclass(frozen=True)
class RetentionPolicy:
    warn_bytes: int = 750 << 20
    hard_bytes: int = 1 << 30
    warn_rows: int = 1_500_000
    hard_rows: int = 2_000_000
    protected_days: int = 7
    rollup_days: int = 90

    def level(self, size: int, rows: int) -> str:
        if size >= self.hard_bytes or rows >= self.hard_rows:
            return "hardLimit"
        return "warning" if size >= self.warn_bytes or rows >= self.warn_rows else "normal"

    def batch(self, size: int, rows: int) -> int:
        """Rows that one transaction of a row store would evict: for information only."""
        return 10_000 if rows < self.hard_rows else min(100_000, max(1, rows - self.hard_rows + 1))

    def excess(self, size: int, rows: int) -> int:
        """Rows to evict until both limits hold; bytes are taken to be spread evenly."""
        by_rows = rows - self.hard_rows + 1
        by_bytes = math.ceil(rows * (size - self.hard_bytes + 1) / size) if size >= self.hard_bytes else 0
        return max(0, by_rows, by_bytes)


def retain(facts: DataFrame, rollups: DataFrame, now_us: int, policy: RetentionPolicy, rows: int, size: int = 0) -> tuple[DataFrame, DataFrame]:
    """What is left after the steps of the hard limit, each taken only while it is exceeded:
    superseded facts go, days past the rollup age are rolled up, the oldest rollups go,
    and then the oldest facts before the protected days, as many as there is excess."""
    if policy.level(size, rows) != "hardLimit":
        return facts, rollups
    facts = facts.where("superseded_by IS NULL")
    count, per_row = facts.count() + rollups.count(), size / max(rows, 1)
    over = lambda n: policy.level(int(n * per_row), n) == "hardLimit"
    if over(count):
        rollups, facts = compact(facts, rollups, now_us - policy.rollup_days * DAY)
        facts, rollups = evicted(facts, rollups, now_us, policy, per_row)
    return facts, rollups


def evicted(facts: DataFrame, rollups: DataFrame, now_us: int, policy: RetentionPolicy, per_row: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """What is left while the hard limit is exceeded: the oldest rollups go, and then the oldest
    facts before the protected days, as many as there is excess."""
    raw, rolled = facts.count(), rollups.count()
    rows, size = raw + rolled, int((raw + rolled) * per_row)
    excess = policy.excess(size, rows) if policy.level(size, rows) == "hardLimit" else 0
    rollups = without_first(rollups, min(excess, rolled), "bucket_us", (*ROLLUP_COHORT,))
    protected = now_us - policy.protected_days * DAY
    old = without_first(facts.where(F.col("observed_us") < protected), max(0, excess - rolled), "observed_us", ("id",))
    return old.unionByName(facts.where(F.col("observed_us") >= protected)), rollups


def capacity(usage: DataFrame, performance: DataFrame, rollups: DataFrame, protected_us: int) -> DataFrame:
    """One row: all rows, the facts from the protected time on, and what lies before it,
    rollups included."""
    kinds = [usage.select("observed_us", F.lit(True).alias("raw")), performance.select("observed_us", F.lit(True).alias("raw")), rollups.select(F.col("bucket_us").alias("observed_us"), F.lit(False).alias("raw"))]
    recent = F.col("raw") & (F.col("observed_us") >= protected_us)
    return reduce(DataFrame.unionByName, kinds).agg(F.count(F.lit(1)).alias("rows"), F.count_if(recent).alias("protected"), F.count_if(~recent).alias("unprotected"))


def pruning_boundary(known: DataFrame, pruned: DataFrame) -> DataFrame:
    """(pruned_before_us): the latest time before which anything was ever pruned, from what is
    known and the times (time_us) pruned now; it never moves back, and is null if nothing was."""
    return known.select(F.col("pruned_before_us").alias("t")).unionByName(pruned.select(F.col("time_us").alias("t"))).agg(F.max("t").alias("pruned_before_us"))


#: Values of a rollup whose sums are told only where every fact has them.
_SUMMED = ["burn_total", *TOKEN_PARTS]


def counted(facts: DataFrame) -> DataFrame:
    """Daily rollups that merge: beside the sums how many facts have each value, and how many
    are of each quality that weighs. Sums are of what is there."""
    has = lambda q: F.count_if(F.col("quality") == q)
    return facts.groupBy(day_start().alias("bucket_us"), *ROLLUP_COHORT).agg(
        F.sum("output_tokens").alias("output_tokens"), *[F.sum(c).alias(c) for c in _SUMMED], *[F.count(c).alias(f"n_{c}") for c in _SUMMED],
        has("estimated").alias("n_estimated"), has("unavailable").alias("n_unavailable"), F.min("model_display").alias("model_display"), F.count(F.lit(1)).alias("samples"),
    )


def with_late(rollups: DataFrame, facts: DataFrame) -> DataFrame:
    """Counted rollups with late facts merged in, their days' raw facts not being there any
    more. Of the rollups only the days that late facts touch are grouped anew; a table of
    them partitioned by bucket_us takes the result's touched days by dynamic overwrite."""
    late = counted(facts)
    days = late.select("bucket_us").distinct()
    touched = rollups.join(days, "bucket_us", "left_semi").unionByName(late)
    added = [c for c in rollups.columns if c.startswith("n_") or c in ("output_tokens", "samples", *_SUMMED)]
    merged = touched.groupBy("bucket_us", *ROLLUP_COHORT).agg(*[F.sum(c).alias(c) for c in added], F.min("model_display").alias("model_display"))
    return rollups.join(days, "bucket_us", "left_anti").unionByName(merged.select(*rollups.columns))


def told(rollups: DataFrame) -> DataFrame:
    """Counted rollups as `daily` gives them."""
    whole = lambda c: F.when(F.col(f"n_{c}") == F.col("samples"), F.col(c)).alias(c)
    quality = F.when(F.col("n_estimated") > 0, "estimated").when(F.col("n_unavailable") > 0, "unavailable").otherwise("derived")
    return rollups.select("bucket_us", *ROLLUP_COHORT, "output_tokens", *[whole(c) for c in _SUMMED], quality.alias("quality"), "model_display", "samples")
