"""Which sources' troubles matter to a figure, and diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.operators.filters import MetricFilter

#: Reason of a diagnostic code (others: SOURCE_UNAVAILABLE), and the action
#: that a reason recommends (others: none).
REASONS = {
    "SOURCE_FAILURE": "SOURCE_FAILURE",
    "SOURCE_UNAVAILABLE": "SOURCE_UNAVAILABLE",
    "SOURCE_OVERLOADED": "SOURCE_OVERLOADED",
    "OVERLOADED": "SOURCE_OVERLOADED",
    "UNKNOWN_SCHEMA": "UNSUPPORTED_SCHEMA",
    "PARSER_VERSION_CHANGED": "UNSUPPORTED_SCHEMA",
    "UNSUPPORTED_SCHEMA": "UNSUPPORTED_SCHEMA",
    "CAPACITY_PROTECTED_WINDOW": "CAPACITY_PROTECTED_WINDOW",
    "CAPACITY_HARD_LIMIT": "CAPACITY_HARD_LIMIT",
    "RETENTION_PRUNED": "RETENTION_PRUNED",
}
ACTIONS = {
    "NO_OBSERVATIONS": "WAIT_FOR_OBSERVATIONS",
    "FILTER_EXCLUDES_OBSERVATIONS": "REDUCE_FILTER",
    "SOURCE_UNAVAILABLE": "UPDATE_SOURCE",
    "SOURCE_FAILURE": "UPDATE_SOURCE",
    "SOURCE_OVERLOADED": "UPDATE_SOURCE",
    "UNSUPPORTED_SCHEMA": "UPDATE_SOURCE",
    "UNSUPPORTED_CAPABILITY": "ENABLE_ENHANCED_TELEMETRY",
    "STABLE_MODEL_CALL_ID_UNAVAILABLE": "ENABLE_ENHANCED_TELEMETRY",
    "REQUEST_TIMING_UNAVAILABLE": "ENABLE_ENHANCED_TELEMETRY",
    "CAPACITY_PROTECTED_WINDOW": "RESET_DATA",
    "CAPACITY_HARD_LIMIT": "RESET_DATA",
}
#: Bounds of the age classes in seconds.
AGES = [0, 60, 300, 3600, 86_400]


def reason_of(code: Column) -> Column:
    """Reason of a diagnostic code, null without a code."""
    table = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    return F.when(code.isNotNull(), F.coalesce(F.try_element_at(table, code), F.lit("SOURCE_UNAVAILABLE")))


def action_for(reason: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    return F.when(reason.isNotNull(), F.try_element_at(table, reason))


def empty_reason(filtered: Column, unfiltered: Column, selected: Column) -> Column:
    """Why a figure has no rows, from two counts."""
    return F.when(filtered == 0, F.when(selected & (unfiltered > 0), "FILTER_EXCLUDES_OBSERVATIONS").otherwise("NO_OBSERVATIONS"))


def relevant(health: DataFrame, facts: DataFrame, chosen: MetricFilter, impact: str = "usage") -> DataFrame:
    """Health rows with this impact that bear on a filtered figure: without a filter all; else
    sources that own a filtered fact; of the others, where impacted and selected agents are
    both known, those that overlap, and else any if models are selected and no fact is left."""
    return relevant_to(health, chosen.apply(facts).select("source_id").distinct(), chosen, impact)


def relevant_to(health: DataFrame, owners: DataFrame, chosen: MetricFilter, impact: str = "usage") -> DataFrame:
    """As relevant(), from the sources (source_id, a row each) of the filtered facts."""
    mine = health.where(F.array_contains("impacts", impact))
    if chosen.is_all:
        return mine
    some = owners.limit(1).agg((F.count("*") > 0).alias("some"))
    known = owners.where("source_id <> 'unknown'").select("source_id").withColumn("owns", F.lit(True))
    told = mine.join(known, "source_id", "left").crossJoin(some)
    owns = F.coalesce("owns", F.lit(False))
    others = F.lit(bool(chosen.models)) & ~F.col("some")
    if chosen.agents:
        selected = F.array(*[F.lit(a) for a in sorted(chosen.agents)])
        others = F.when(F.size("agents") > 0, F.arrays_overlap("agents", selected)).otherwise(others)
    return told.where(owns | others).select(*health.columns)


#: Source of performance facts that were taken over without one.
LEGACY = "legacy-performance"


def relevant_performance(health: DataFrame, facts: DataFrame, chosen: MetricFilter) -> DataFrame:
    """As relevant() for performance: beside a source that owns a filtered request, one whose
    impacted agents or channels meet those of a filtered legacy request counts as its owner.
    Each of the three ways is an equi-join; what they find is united and made distinct."""
    mine = health.where(F.array_contains("impacts", "performance"))
    if chosen.is_all:
        return mine
    kept = chosen.apply(facts)
    pairs = kept.select("source_id", "agent", "channel").distinct()
    legacy = pairs.where(F.col("source_id") == LEGACY)
    own = mine.select("ordinal", "source_id").join(pairs.select("source_id").distinct(), "source_id").select("ordinal")
    by_agent = mine.select("ordinal", F.explode("agents").alias("agent")).join(legacy.select("agent").distinct(), "agent").select("ordinal")
    by_channel = mine.select("ordinal", F.explode("channels").alias("channel")).join(legacy.select("channel").distinct(), "channel").select("ordinal")
    owners = own.unionByName(by_agent).unionByName(by_channel).distinct().withColumn("owns", F.lit(True))
    some = kept.limit(1).agg((F.count("*") > 0).alias("some"))
    others = F.lit(bool(chosen.models)) & ~F.col("some")
    if chosen.agents:
        selected = F.array(*[F.lit(a) for a in sorted(chosen.agents)])
        others = F.when(F.size("agents") > 0, F.arrays_overlap("agents", selected)).otherwise(others)
    told = mine.join(owners, "ordinal", "left").crossJoin(some)
    return told.where(F.coalesce("owns", F.lit(False)) | others).select(*health.columns)


def affecting(health: DataFrame, facts: DataFrame) -> DataFrame:
    """Unhealthy rows whose source owns one of the facts; without any fact, all of them."""
    sick = health.where("NOT is_healthy")
    owners = facts.where("source_id <> 'unknown'").select("source_id").distinct().withColumn("owns", F.lit(True))
    some = facts.limit(1).agg((F.count("*") > 0).alias("some"))
    return sick.join(owners, "source_id", "left").crossJoin(some).where("NOT some OR owns").select(*health.columns)


def numbered_sources(health: DataFrame) -> DataFrame:
    """(ordinal, health, reason_codes): sources without their names, numbered from 1 in order of
    health and reasons. One row a source."""
    each = health.groupBy("source_id").agg(F.when(F.bool_and("is_healthy"), "healthy").otherwise("unhealthy").alias("health"), F.sort_array(F.collect_set("reason_code")).alias("reason_codes"))
    order = Window.orderBy("health", F.array_join("reason_codes", "\0"))
    return each.select(F.row_number().over(order).cast("bigint").alias("ordinal"), "health", "reason_codes")


def version_changes(states: DataFrame, versions: DataFrame) -> DataFrame:
    """(source_id, code, rebuild): sources whose stored parser version (source_id,
    parser_version) isn't the current one; all they have is to be read anew."""
    now = versions.select("source_id", F.col("parser_version").alias("current"))
    return states.join(now, "source_id").where(~F.col("parser_version").eqNullSafe(F.col("current"))).select("source_id", F.lit("PARSER_VERSION_CHANGED").alias("code"), F.lit(True).alias("rebuild"))


#: How qualities, states and coverages are shown.
LABELS = {
    "measured": "Measured",
    "derived": "Derived",
    "estimated": "Estimated",
    "unavailable": "Unavailable",
    "zero": "Zero",
    "stale": "Stale",
    "absent": "No data",
    "complete": "Complete",
    "partial": "Partial",
}


def label(value: Column) -> Column:
    """The shown text of a quality, state or coverage."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair]), value)


def first_degradation(health: DataFrame) -> DataFrame:
    """The first unhealthy row in order that has a reason, with its action or that which the
    reason recommends."""
    sick = health.where("NOT is_healthy AND reason_code IS NOT NULL")
    first = sick.agg(F.min(F.struct("ordinal", "reason_code", "action")).alias("f")).select("f.reason_code", "f.action")
    return first.withColumn("action", F.coalesce("action", action_for(F.col("reason_code"))))


def silent_sources(health: DataFrame, current: DataFrame) -> DataFrame:
    """Unhealthy usage sources without a current fact."""
    return health.where("NOT is_healthy AND array_contains(impacts, 'usage')").join(current.select("source_id"), "source_id", "left_anti")


def with_overload(health: DataFrame, overload: DataFrame) -> DataFrame:
    """Health with the rows of overloaded sources, impact by impact, replaced."""
    o = overload.select(F.col("source_id").alias("o_id"), F.col("impacts").alias("o_impacts"))
    kept = health.join(o, (F.col("source_id") == F.col("o_id")) & F.arrays_overlap("impacts", "o_impacts"), "left_anti")
    return kept.unionByName(overload)


def age_class(age_s: Column) -> Column:
    names = [f"[{a},{b})" for a, b in zip(AGES, AGES[1:], strict=False)]
    out = F.when(age_s.isNull(), "unknown")
    for bound, name in zip(AGES[1:], names, strict=True):
        out = out.when(age_s < bound, name)
    return out.otherwise(f">={AGES[-1]}")


def chart_state(capable: Column, stale_owner: Column, unhealthy: Column, facts: Column) -> Column:
    """State of a trend chart from flags and counts."""
    none = F.when(stale_owner, "stale").when(unhealthy, "unavailable").when(facts == 0, "absent").otherwise("stale")
    return F.when(capable == 0, none).when(stale_owner, "stale")
