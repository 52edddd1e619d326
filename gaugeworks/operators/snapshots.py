"""Composite results: the performance snapshot with its state, and short texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.operators import live
from gaugeworks.operators.authority import coalesce_performance
from gaugeworks.operators.filters import MetricFilter, in_closed_window, with_newest
from gaugeworks.operators.health import LEGACY, action_for, relevant, relevant_performance
from gaugeworks.operators.metrics import beside, combined_authority, combined_quality, mixed_quality, options
from gaugeworks.operators.performance import decode_valid, nearest_ranks

#: Seconds of the ranges that latencies are shown for.
RANGES = {"15m": 900, "1h": 3_600, "24h": 86_400, "7d": 604_800}


def performance_rows(facts: DataFrame, health: DataFrame, now_us: int, seconds: int, chosen: MetricFilter) -> DataFrame:
    """The requests (coalesced ones) that a snapshot looks at: of the last window, and of each unhealthy source
    without any there those of its own last window, marked as retained."""
    every = chosen.apply(facts)
    current = every.where(in_closed_window(now_us, seconds)).withColumn("retained", F.lit(False))
    sick = relevant(health, every, chosen, "performance").where("NOT is_healthy").select("source_id").distinct()
    silent = sick.join(current.select("source_id"), "source_id", "left_anti")
    own = with_newest(every.join(silent, "source_id", "left_semi"), ["source_id"])
    kept = own.where(in_closed_window(F.col("newest_us"), seconds)).drop("newest_us").withColumn("retained", F.lit(True))
    return current.unionByName(kept.select(*current.columns))


def performance_snapshot(facts: DataFrame, health: DataFrame, now_us: int, seconds: int = RANGES["1h"], chosen: MetricFilter | None = None) -> DataFrame:
    """One row with the distributions of first token, whole request and decoding speed, the
    counts of retries and undecodable requests, and quality, coverage, state and authority.
    A sick source's requests make it stale, also those of the window.
    Coverage is partial with a relevant unhealthy source, mixed or unavailable quality; that
    of decoding also if any normal request can't be decoded."""
    chosen = chosen or MetricFilter()
    single = coalesce_performance(facts)
    rows = performance_rows(single, health, now_us, seconds, chosen)
    ill = relevant(health, single, chosen, "performance").where("NOT is_healthy")
    first = F.min(F.when(F.col("reason_code").isNotNull(), F.struct("ordinal", "reason_code")))["reason_code"], F.min(F.when(F.col("action").isNotNull(), F.struct("ordinal", "action")))["action"]
    sick = ill.agg((F.count(F.lit(1)) > 0).alias("sick"), first[0].alias("first_reason"), first[1].alias("first_action"))
    owners = rows.select("source_id").distinct().where(F.col("source_id") != LEGACY)
    owned = owners.join(ill.select("source_id").distinct(), "source_id").agg((F.count(F.lit(1)) > 0).alias("owned"))
    some = chosen.apply(single).limit(1).agg((F.count(F.lit(1)) > 0).alias("any_selected"))
    some = beside(some, facts.limit(1).agg((F.count(F.lit(1)) > 0).alias("any_facts")))
    usual = ~F.col("is_retry") & (F.col("quality") != "unavailable")
    counts = rows.agg(
        F.count_if("is_retry").alias("retries"), F.count_if(usual).alias("samples"), F.count_if(usual & decode_valid()).alias("decoded"),
        F.coalesce(F.bool_or("retained"), F.lit(False)).alias("retained"), F.coalesce(F.bool_or(F.col("quality") == "unavailable"), F.lit(False)).alias("unavailable"),
    )
    normal = rows.where(usual)
    tps = F.when(decode_valid(), (F.col("output_total") - 1) / ((F.col("duration_ms") - F.col("ttft_ms")) / 1000.0))
    figures = normal.agg(
        combined_quality().alias("quality"), combined_authority("channel" if "authority" not in rows.columns else "authority").alias("authority"), mixed_quality().alias("mixed"), F.max("observed_us").alias("updated_us"),
    )
    one, low = {"p50": 0.5, "p95": 0.95}, {"p50": 0.5, "p95": 0.95, "p10": 0.1}
    ranks = []
    for name, column, wanted in (("ttft", "ttft_ms", one), ("e2e", "duration_ms", one), ("decode", "tps", low)):
        ranks.append(nearest_ranks(normal.withColumn("tps", tps), column, wanted).select(F.struct(*wanted).alias(name)))
    both = beside(counts, figures, sick, owned, some, *ranks)
    partial = F.col("sick") | F.col("mixed") | F.col("unavailable")
    stale = F.col("retained") | F.col("owned")
    reason = F.coalesce("first_reason", F.when(F.col("samples") == 0, F.when(~F.col("any_selected") & F.col("any_facts"), "FILTER_EXCLUDES_OBSERVATIONS").otherwise("REQUEST_TIMING_UNAVAILABLE")))
    return both.select(
        "ttft", "e2e", "decode", "samples", "retries", (F.col("samples") - F.col("decoded")).alias("decode_invalid"), F.col("samples").between(1, 4).alias("low_sample"), "quality", "authority", "updated_us",
        F.when(F.col("samples") == 0, "unavailable").when(stale, "stale").alias("state"), F.when(partial, "partial").otherwise("complete").alias("coverage"),
        F.when(partial | (F.col("decoded") < F.col("samples")), "partial").otherwise("complete").alias("decode_coverage"),
        reason.alias("reason"), F.coalesce("first_action", action_for(reason)).alias("action"), stale.alias("retained"),
    )


def light_composite(facts: DataFrame, requests: DataFrame, health: DataFrame, now_us: int, seconds: int = 180, long_seconds: int = 600, performance_seconds: int = RANGES["1h"], chosen: MetricFilter | None = None) -> DataFrame:
    """Everything that is shown at a glance, in one row: throughput, burn, calls and
    performance (a struct each), coding_agents, models (of all facts, filtered or not), and
    source_health, with filter, scope and generated_us. No figure shuffles whole facts of
    history: each is bounded by its window, and what history has to say is one slim row."""
    chosen = chosen or MetricFilter()
    one = lambda df, name: df.select(F.struct(*df.columns).alias(name))
    timing = health.where("NOT array_contains(impacts, 'performance')").unionByName(relevant_performance(health, requests, chosen))
    agents = facts.select("agent").distinct().agg(F.sort_array(F.collect_list("agent")).alias("coding_agents"))
    models = options(facts).agg(F.sort_array(F.collect_list(F.struct("model_display", "model_raw"))).alias("models"))
    sources = health.agg(F.sort_array(F.collect_list(F.struct("ordinal", "source_id", "is_healthy", "reason_code"))).alias("source_health"))
    parts = [
        live.light(facts, health, now_us, seconds, long_seconds, chosen), one(performance_snapshot(requests, timing, now_us, performance_seconds, chosen), "performance"), agents, models, sources,
    ]
    row = beside(*parts)
    axis = lambda values: F.array(*[F.lit(v) for v in sorted(values)]).cast("array<string>")
    return row.select("*", F.struct(axis(chosen.agents).alias("agents"), axis(chosen.models).alias("models")).alias("filter"), F.lit("all" if chosen.is_all else "selected").alias("scope"), F.lit(now_us).alias("generated_us"))


def summary_status(state: Column, coverage: Column, sick: Column, live: Column) -> Column:
    return F.when(state == "stale", "stale").when(state.isin("absent", "unavailable"), "unavailable").when((coverage == "partial") | sick, "partial").when(live, "live").otherwise("unavailable")


def chip_titles(options: DataFrame, chosen: frozenset[str], id_col: str = "model_raw") -> DataFrame:
    """Options with whether each is selected; none selected means all."""
    return options.withColumn("selected", F.col(id_col).isin(*sorted(chosen)) if chosen else F.lit(False))
