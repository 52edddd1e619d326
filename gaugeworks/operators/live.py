"""The live figures whole: value, quality, coverage, state, authority, freshness and reason
from facts and source health. Each figure is one row, made of one-row aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.operators.authority import cohorts, select_authoritative, select_window, standing
from gaugeworks.operators.filters import MetricFilter, in_closed_window
from gaugeworks.operators.health import action_for, affecting, empty_reason, relevant
from gaugeworks.operators.metrics import beside, combined_authority, combined_quality, mixed_quality
from gaugeworks.schema import SECOND, TOKEN_PARTS

USABLE = "quality <> 'unavailable'"


def windowed(facts: DataFrame, now_us: int, seconds: int, usable: str = "true") -> tuple[DataFrame, bool]:
    """The facts of the window up to now or, if none of those is usable, of the window up to
    the newest fact (retained), and which of the two. The bounds are literals, so they reach
    the scan; the whole history is looked at only where the window has nothing."""
    current = facts.where(in_closed_window(now_us, seconds))
    newest = None if current.where(usable).head(1) else facts.agg(F.max("observed_us")).first()[0]
    return (current, False) if newest is None else (facts.where(in_closed_window(newest, seconds)), True)


def _standing(health: DataFrame) -> DataFrame:
    """One row: is any source sick, are all, and the first reason with its action."""
    first = F.min(F.when(F.expr("NOT is_healthy AND reason_code IS NOT NULL"), F.struct("ordinal", "reason_code", "action")))
    told = health.agg(F.count_if("is_healthy").alias("fine"), F.count_if(~F.col("is_healthy")).alias("ill"), first.alias("first"))
    return told.select((F.col("ill") > 0).alias("sick"), ((F.col("ill") > 0) & (F.col("fine") == 0)).alias("all_sick"), F.col("first.reason_code").alias("first_reason"), F.coalesce("first.action", action_for(F.col("first.reason_code"))).alias("first_action"))


def _updated(rows: DataFrame, health: DataFrame, retained: bool) -> DataFrame:
    """One row with the time the figure is from: the newest, of retained rows that of the
    sick source that is furthest behind. Sources are counted before they meet their health."""
    newest = rows.groupBy("source_id").agg(F.max("observed_us").alias("at"))
    if not retained:
        return newest.agg(F.max("at").alias("updated_us"))
    sick = affecting(health, rows).select("source_id").distinct().withColumn("ill", F.lit(True))
    return newest.join(sick, "source_id", "left").agg(F.coalesce(F.min(F.when(F.col("ill"), F.col("at"))), F.max("at")).alias("updated_us"))


def _conflict(facts: DataFrame) -> DataFrame:
    return cohorts(facts).agg(F.coalesce(F.bool_or("conflict"), F.lit(False)).alias("conflicting"))


def _empty(facts: DataFrame, kept: DataFrame, chosen: MetricFilter) -> DataFrame:
    """One row with the reason of an empty figure, null while the filter leaves facts."""
    n = lambda df, name: df.limit(1).agg(F.count(F.lit(1)).alias(name))
    return beside(n(facts, "n_all"), n(kept, "n_kept")).select(empty_reason(F.col("n_kept"), F.col("n_all"), F.lit(not chosen.is_all)).alias("none"))


def _row(parts: list[DataFrame], values: dict[str, Column], there: Column, state: Column, coverage: Column, authority: Column, missing: Column, now_us: int, retained: bool) -> DataFrame:
    """The figure's row of its one-row parts: `there` tells whether it has a value."""
    row = beside(*parts)
    reason = F.when(there, F.col("first_reason")).otherwise(missing)
    action = F.when(there, F.col("first_action")).otherwise(action_for(reason))
    age = F.greatest(F.lit(0.0), (F.lit(now_us) - F.col("updated_us")) / float(SECOND))
    return row.select(
        *[F.when(there, v).alias(k) for k, v in values.items()], F.when(there, F.col("quality")).otherwise("unavailable").alias("quality"), state.alias("state"), F.when(coverage, "partial").otherwise("complete").alias("coverage"),
        F.when(F.col("conflicting"), "mixed").otherwise(F.coalesce(authority, F.lit("unavailable"))).alias("authority"), reason.alias("reason"), action.alias("action"), "updated_us", age.alias("age_s"), (there & F.lit(retained)).alias("retained"),
    )


def output(facts: DataFrame, health: DataFrame, now_us: int, seconds: int = 180, chosen: MetricFilter | None = None) -> DataFrame:
    """Output tokens a second over the window's facts that authority selects, judged by the
    whole history; of that only one slim aggregate is shuffled, and the cohorts that the
    window has. An average per session is told of current facts only."""
    chosen = chosen or MetricFilter()
    kept, mine = chosen.apply(facts), relevant(health, facts, chosen)
    history = standing(kept)
    rows, retained = select_window(kept, in_closed_window(now_us, seconds)).where(USABLE), False
    if not rows.head(1):
        newest = history.first()["newest_us"]
        if newest is not None:
            rows, retained = select_window(kept, in_closed_window(newest, seconds)).where(USABLE), True
    sessions = F.lit(0).cast("bigint") if retained else F.count_distinct("agent", "session_id")
    own = rows.agg(F.sum("output_tokens").alias("tokens"), sessions.alias("sessions"), F.count(F.lit(1)).alias("n"), combined_quality(True).alias("quality"), combined_authority().alias("authority"), mixed_quality().alias("mixed"))
    any_authority = F.when(F.col("low") == F.col("high"), F.col("low")).when(F.col("low").isNotNull(), "mixed")
    every = history.select("conflicting", "nothing", "lacking", any_authority.alias("any_authority"))
    there, troubled = F.col("n") > 0, F.col("conflicting") | F.col("sick")
    rate = F.col("tokens").cast("double") / float(seconds)
    return _row(
        [own, every, _standing(mine), _updated(rows, mine, retained), _empty(facts, kept, chosen)],
        {"output_tokens": F.col("tokens"), "tokens_per_s": rate, "per_session": F.when(F.col("sessions") > 0, rate / F.col("sessions")), "sessions": F.col("sessions"), "samples": F.col("n")},
        there,
        F.when(~there, F.when(F.col("nothing") & ~F.col("all_sick"), "absent").otherwise("unavailable")).when(F.lit(retained), "stale").when(F.col("tokens") == 0, "zero"),
        troubled | (there & (F.col("mixed") | F.col("lacking"))),
        F.when(there, F.col("authority")).otherwise(F.col("any_authority")),
        F.when(F.col("conflicting"), "AUTHORITY_CONFLICT").otherwise(F.coalesce("first_reason", "none", F.lit("NO_OBSERVATIONS"))),
        now_us, retained,
    )


def burn(facts: DataFrame, health: DataFrame, now_us: int, seconds: int = 600, chosen: MetricFilter | None = None) -> DataFrame:
    """Tokens of all kinds a minute, over the selected facts of the window that have a total."""
    chosen = chosen or MetricFilter()
    kept, mine = chosen.apply(facts), relevant(health, facts, chosen)
    rows, retained = windowed(kept, now_us, seconds)
    picked = select_authoritative(rows)
    capable = picked.where(f"burn_total IS NOT NULL AND {USABLE}")
    whole = " AND ".join(f"{p} IS NOT NULL" for p in TOKEN_PARTS)
    sums = [F.when(F.count(p) == F.count(F.lit(1)), F.sum(p)).alias(p) for p in TOKEN_PARTS]
    own = capable.agg(F.sum("burn_total").alias("total"), F.count(F.lit(1)).alias("n"), combined_quality(True).alias("quality"), combined_authority().alias("authority"), mixed_quality().alias("mixed"), *sums)
    every = picked.agg(F.count(F.lit(1)).alias("picked"), F.count_if(F.expr(whole)).alias("whole"), combined_authority().alias("picked_authority"))
    seen = rows.agg((F.count(F.lit(1)) == 0).alias("nothing"), combined_authority().alias("any_authority"))
    there, troubled = F.col("n") > 0, F.col("conflicting") | F.col("sick")
    return _row(
        [own, every, seen, _standing(mine), _conflict(rows), _updated(capable, mine, retained), _empty(facts, kept, chosen)],
        {"burn_total": F.col("total"), "tokens_per_min": F.col("total").cast("double") / float(seconds) * 60.0, "samples": F.col("n"), **{p: F.col(p) for p in TOKEN_PARTS}},
        there,
        F.when(~there, F.when(F.col("nothing") & ~F.col("sick"), "absent").otherwise("unavailable")).when(F.lit(retained), "stale").when(F.col("total") == 0, "zero"),
        troubled | (there & (F.col("mixed") | (F.col("n") < F.col("picked")) | (F.col("whole") < F.col("picked")))),
        F.when(there, F.col("authority")).otherwise(F.coalesce("picked_authority", "any_authority")),
        F.when(F.col("conflicting"), "AUTHORITY_CONFLICT").otherwise(F.coalesce("first_reason", F.when(F.col("nothing"), F.coalesce("none", F.lit("NO_OBSERVATIONS"))), F.lit("UNSUPPORTED_CAPABILITY"))),
        now_us, retained,
    )


def calls(facts: DataFrame, health: DataFrame, now_us: int, seconds: int = 600, chosen: MetricFilter | None = None) -> DataFrame:
    """Distinct calls a minute over all facts of the window, those that authority leaves out
    too; without any call id there is no value."""
    chosen = chosen or MetricFilter()
    kept, mine = chosen.apply(facts), relevant(health, facts, chosen)
    rows, retained = windowed(kept, now_us, seconds)
    known = "coalesce(call_id, '') <> ''"
    usable = rows.where(f"{known} AND {USABLE}")
    own = usable.agg(F.count_distinct("agent", "call_id").alias("n"), combined_quality(True).alias("quality"), combined_authority().alias("authority"), mixed_quality().alias("mixed"))
    seen = rows.agg((F.count(F.lit(1)) == 0).alias("nothing"), F.count_if(F.expr(known)).alias("capable"), combined_authority().alias("any_authority"), F.coalesce(F.bool_or(F.expr(f"NOT ({known} AND {USABLE})")), F.lit(False)).alias("lacking"))
    times = _updated(usable, mine, retained).select(F.col("updated_us").alias("a"))
    times = beside(times, _updated(rows, mine, retained).select(F.col("updated_us").alias("b"))).select(F.coalesce("a", "b").alias("updated_us"))
    there, troubled = F.col("capable") > 0, F.col("conflicting") | F.col("sick")
    none = F.when(F.col("nothing"), F.coalesce("first_reason", "none", F.lit("NO_OBSERVATIONS"))).when(F.lit(retained), F.coalesce("first_reason", F.lit("STABLE_MODEL_CALL_ID_UNAVAILABLE")))
    return _row(
        [own, seen, _standing(mine), _conflict(rows), times, _empty(facts, kept, chosen)],
        {"calls": F.col("n"), "calls_per_min": F.col("n").cast("double") / float(seconds) * 60.0},
        there,
        F.when(F.col("nothing"), F.when(F.col("sick"), "unavailable").otherwise("absent")).when(F.lit(retained), "stale").when(~there, "unavailable").when(F.col("n") == 0, "zero"),
        troubled | (there & (F.col("mixed") | F.col("lacking"))),
        F.when(there, F.col("authority")).otherwise(F.col("any_authority")),
        F.coalesce(none, F.lit("STABLE_MODEL_CALL_ID_UNAVAILABLE")),
        now_us, retained,
    )


def light(facts: DataFrame, health: DataFrame, now_us: int, seconds: int = 180, long_seconds: int = 600, chosen: MetricFilter | None = None) -> DataFrame:
    """The three figures in one row of structs."""
    one = lambda df, name: df.select(F.struct(*df.columns).alias(name))
    figures = [one(output(facts, health, now_us, seconds, chosen), "throughput"), one(burn(facts, health, now_us, long_seconds, chosen), "burn"), one(calls(facts, health, now_us, long_seconds, chosen), "calls")]
    return beside(*figures)
