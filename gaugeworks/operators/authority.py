"""Which of several measurements of the same thing counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.schema import COHORT, TOKEN_PARTS


def burn_total() -> Column:
    """Sum of the parts that are there, 0 if none is."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(p), F.lit(0)) for p in TOKEN_PARTS])


def _rank() -> Column:
    return F.when(F.col("tier") == "enhanced", 1).otherwise(0)


def cohorts(facts: DataFrame) -> DataFrame:
    """One row per cohort of facts with a call id: its representative's columns (least id of
    the top tier) and whether that tier has several authorities. One greatest-tier, least-id
    struct and the bounds of authority are combined before the shuffle, so a cohort's size
    doesn't matter."""
    known = facts.where("call_id IS NOT NULL AND call_id <> ''")
    rest = [c for c in facts.columns if c not in COHORT and c != "id"]
    best = F.min(F.struct("id", *rest)).alias("best")
    per_tier = known.groupBy(*COHORT, _rank().alias("rank")).agg(best, F.min("authority").alias("low"), F.max("authority").alias("high"), F.count("*").alias("n"))
    top = F.max(F.struct("rank", "best", "low", "high")).alias("top")
    told = per_tier.groupBy(*COHORT).agg(top, F.sum("n").alias("cohort_facts"))
    return told.select(*COHORT, *[F.col(f"top.best.{c}").alias(c) for c in ["id", *rest]], (F.col("top.low") != F.col("top.high")).alias("conflict"), "cohort_facts")


def select_authoritative(facts: DataFrame) -> DataFrame:
    """The facts that count: those without a call id, and the representative of each cohort
    whose top tier has one authority. A conflicting cohort is dropped. Representatives come
    out of the aggregate whole, so nothing is joined back."""
    alone = facts.where("call_id IS NULL OR call_id = ''")
    return alone.unionByName(cohorts(facts).where("NOT coalesce(conflict, false)").select(*facts.columns))


#: Cohorts of a window up to which their keys are broadcast.
BROADCAST_COHORTS = 200_000


def select_window(facts: DataFrame, inside: Column) -> DataFrame:
    """The facts `inside` a window that count, judged by all of history: the window's cohorts
    cut history down first, so only facts of those are shuffled. Their keys are broadcast
    where they are few by count, else joined."""
    current = facts.where(inside)
    known = "call_id IS NOT NULL AND call_id <> ''"
    keys = current.where(known).select(*[F.col(c).alias(f"k_{c}") for c in COHORT]).distinct()
    small = keys.limit(BROADCAST_COHORTS + 1).count() <= BROADCAST_COHORTS
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in COHORT])
    cut = facts.where(known).join(F.broadcast(keys) if small else keys, same, "left_semi")
    chosen = cohorts(cut).where("NOT coalesce(conflict, false)").select(*facts.columns).where(inside)
    return current.where(f"NOT coalesce({known}, false)").unionByName(chosen)


def has_conflict(facts: DataFrame) -> DataFrame:
    """One row (conflict): whether any cohort's top tier has several authorities. Only keys
    and bounds of authority go through the shuffle."""
    known = facts.where("call_id IS NOT NULL AND call_id <> ''")
    per = known.groupBy(*COHORT, _rank().alias("rank")).agg(F.min("authority").alias("low"), F.max("authority").alias("high"))
    top = per.groupBy(*COHORT).agg(F.max(F.struct("rank", "low", "high")).alias("top"))
    return top.agg(F.coalesce(F.bool_or(F.col("top.low") != F.col("top.high")), F.lit(False)).alias("conflict"))


def standing(facts: DataFrame) -> DataFrame:
    """One row on all of history: conflict (in any cohort), and of the facts that authority
    selects whether there are any, their bounds of authority, whether one has unavailable
    quality, and the newest usable time. Four columns a cohort are shuffled, no whole facts."""
    slim = facts.select(*COHORT, "id", "tier", "authority", "quality", "observed_us")
    alone = slim.where("NOT coalesce(call_id IS NOT NULL AND call_id <> '', false)").select("authority", "quality", "observed_us", F.lit(False).alias("conflict"))
    each = cohorts(slim).select("authority", "quality", "observed_us", F.coalesce("conflict", F.lit(False)).alias("conflict"))
    ours = lambda c: F.when(~F.col("conflict"), c)
    lacking = F.col("quality") == "unavailable"
    return alone.unionByName(each).agg(
        F.coalesce(F.bool_or("conflict"), F.lit(False)).alias("conflicting"), (F.count_if(~F.col("conflict")) == 0).alias("nothing"), F.min(ours(F.col("authority"))).alias("low"), F.max(ours(F.col("authority"))).alias("high"),
        F.coalesce(F.bool_or(ours(lacking)), F.lit(False)).alias("lacking"), F.max(ours(F.col("observed_us"))).alias("newest_us"),
    )


def mark_superseded(facts: DataFrame) -> DataFrame:
    """`facts` with superseded_by: of a fallback fact the least enhanced one with the same
    call and range (nulls equal each other), else null. Rows that nothing can supersede, such
    as those without a call, are set aside and meet in no key."""
    facts = facts.drop("superseded_by")
    may = F.coalesce((F.col("tier") == "fallback") & F.col("call_id").isNotNull(), F.lit(False))
    enhanced = facts.where("tier = 'enhanced' AND call_id IS NOT NULL").groupBy(*[F.col(c).alias(f"e_{c}") for c in COHORT]).agg(F.min("id").alias("superseded_by"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"e_{c}")) for c in COHORT])
    rows = facts.where(may).join(enhanced, same, "left").drop(*[f"e_{c}" for c in COHORT])
    return rows.unionByName(facts.where(~may).withColumn("superseded_by", F.lit(None).cast("string")))


def _shortest(number: str) -> Column:
    """A double as its shortest decimal text without an exponent, as in 17712.0."""
    x = F.col(number)
    plain = F.format_string("%.1f", x)
    return F.when(x == F.floor(x), plain).otherwise(F.regexp_replace(x.cast("decimal(38,9)").cast("string"), "0+$", ""))


def coalesce_performance(facts: DataFrame) -> DataFrame:
    """One request per (agent, request, granularity): enhanced first, then the least in the
    order of the fields' texts. A single least struct is kept, so nothing is sorted."""
    keys = ["agent", "request_id", "granularity"]
    rest = [c for c in facts.columns if c not in keys]
    text = [_shortest(c) if c in ("duration_ms", "ttft_ms") else F.col(c).cast("string") for c in rest]
    order = F.struct((1 - _rank()).alias("tier"), F.concat_ws("|", *[F.coalesce(t, F.lit("")) for t in text]).alias("text"))
    best = facts.groupBy(*keys).agg(F.min(F.struct(order.alias("order"), *rest)).alias("best"))
    return best.select(*keys, *[F.col(f"best.{c}").alias(c) for c in rest])
