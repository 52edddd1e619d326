"""What scans say of their sources, and the diagnostic document made of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.operators.health import action_for, numbered_sources, reason_of

#: Codes that a scan gives, the gravest first.
CODES = ["SOURCE_UNAVAILABLE", "SOURCE_FAILURE", "PARSER_VERSION_CHANGED", "SOURCE_OVERLOADED", "SOURCE_LINE_TOO_LONG", "UNKNOWN_SCHEMA"]
#: Schemas that may be named in a document.
SCHEMAS = ["codex-rollout-v1", "claude-code-transcript-v1"]
QUALITIES, COVERAGES = ["derived", "estimated", "measured", "unavailable"], ["complete", "partial"]
#: Names of the classes of ages, and their upper bounds in seconds.
AGES = {"under_1m": 60, "1m_to_5m": 300, "5m_to_1h": 3_600, "1h_to_24h": 86_400}


def scan_codes(lines: DataFrame, known: DataFrame, found: DataFrame, truncated: DataFrame, versions: DataFrame, failed: DataFrame) -> DataFrame:
    """(source_id, code), each once: of `lines` (source_id, code) of classified lines; of known
    files (source_id, file) that were not found (source_id, file); of truncated listings,
    of changed parser versions and of failed scans (source_id each)."""
    missing = known.select("source_id", "file").join(found.select("source_id", "file"), ["source_id", "file"], "left_anti")
    coded = lambda df, code: df.select("source_id", F.lit(code).alias("code"))
    parts = [lines.select("source_id", "code"), coded(missing, "SOURCE_UNAVAILABLE"), coded(truncated, "SOURCE_OVERLOADED"), coded(versions, "PARSER_VERSION_CHANGED"), coded(failed, "SOURCE_FAILURE")]
    return reduce(DataFrame.unionByName, parts).where("code IS NOT NULL").distinct()


def source_health(sources: DataFrame, codes: DataFrame) -> DataFrame:
    """Health rows of `sources` (source_id, agents, channels): one for each code, the gravest
    first, and a healthy one of each source without codes; ordinals go by source. Rows are
    as many as sources and their codes."""
    rank = F.array_position(F.array(*[F.lit(c) for c in CODES]), F.col("code"))
    both = sources.join(codes, "source_id", "left").withColumn("rank", F.when(rank == 0, len(CODES) + 1).otherwise(rank))
    placed = both.withColumn("ordinal", F.row_number().over(Window.orderBy("source_id", "rank", "code")))
    reason = reason_of(F.col("code"))
    return placed.select(
        "ordinal", "source_id", F.col("code").isNull().alias("is_healthy"), F.col("code").alias("diagnostic_code"), F.array(F.lit("usage")).alias("impacts"), "agents", "channels", reason.alias("reason_code"), action_for(reason).alias("action"))


def semantic_version(text: Column) -> Column:
    """The text if it is a version: at most 64 digits, dots, hyphens and plus signs, a digit
    first, and a dot; else null."""
    return F.when(text.rlike(r"^[0-9][0-9.+-]{0,63}\z") & text.contains("."), text)


def build_number(text: Column) -> Column:
    """The text if it is 1 to 20 digits, else null."""
    return F.when(text.rlike(r"^[0-9]{1,20}\z"), text)


def _counts(values: list[str], column: str) -> Column:
    return F.struct(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def age_counts() -> Column:
    age = F.col("age_s")
    known = age.isNotNull() & (age >= 0) & (age < float("inf")) & ~F.isnan(age)
    low, out = 0, {"over_24h": known & (age >= 86_400), "unknown": ~F.coalesce(known, F.lit(False))}
    for name, high in AGES.items():
        out[name], low = known & (age >= low) & (age < high), high
    return F.struct(*[F.count_if(out[n]).alias(n) for n in sorted(out)])


def document(metrics: DataFrame, health: DataFrame, versions: dict[str, str], parsers: DataFrame, schemas: DataFrame, schema: str = "diagnostics-v1") -> DataFrame:
    """One row (document): JSON of counts, keys in order at every level and no identity in it,
    from `metrics` (quality, coverage, age_s, reason), health rows, versions (app, build),
    parser versions (version) and schemas (name). The schema's name is a parameter."""
    counted = metrics.agg(_counts(COVERAGES, "coverage").alias("coverage_counts"), F.count(F.lit(1)).alias("metric_count"), _counts(QUALITIES, "quality").alias("quality_counts"), age_counts().alias("relative_age_counts"))
    sources = numbered_sources(health)
    listed = sources.agg(F.sort_array(F.collect_list(F.struct(F.col("ordinal").alias("__o"), F.struct("health", "ordinal", "reason_codes").alias("s")))).alias("s"), F.count_if(F.col("health") == "healthy").alias("healthy"), F.count_if(F.col("health") == "unhealthy").alias("unhealthy"))
    own = sources.select(F.explode("reason_codes").alias("code")).unionByName(metrics.where("reason IS NOT NULL").select(F.col("reason").alias("code")))
    reasons = own.groupBy("code").agg(F.count(F.lit(1)).alias("count")).agg(F.sort_array(F.collect_list(F.struct("code", "count"))).alias("reason_counts"))
    kept = parsers.select(semantic_version(F.col("version")).alias("v")).where("v IS NOT NULL").distinct().agg(F.sort_array(F.collect_list("v")).alias("parsers"))
    named = schemas.where(F.col("name").isin(*SCHEMAS)).select("name").distinct().agg(F.sort_array(F.collect_list("name")).alias("schemas"))
    told = lambda check, key: F.coalesce(check(F.lit(versions.get(key, ""))), F.lit("unavailable")).alias(key)
    row = reduce(DataFrame.crossJoin, [counted, listed, reasons, kept, named])
    return row.select(F.to_json(F.struct(
        "coverage_counts", "metric_count", "quality_counts", "reason_counts", "relative_age_counts", F.lit(schema).alias("schema"), F.struct("healthy", "unhealthy").alias("source_health"), F.col("s.s").alias("sources"),
        F.struct(told(semantic_version, "app"), told(build_number, "build"), "parsers", "schemas").alias("versions"),
    )).alias("document"))


def capacity_text(level: Column, code: Column) -> Column:
    """What is shown of the store's level; null while it is normal."""
    hard = F.when(code == "CAPACITY_PROTECTED_WINDOW", "Ingestion paused: the protected seven-day window reached capacity. Reset Data to resume.")
    return F.when(level == "warning", "Capacity warning: telemetry storage is approaching its hard limit.").when(level == "hardLimit", hard.otherwise("Ingestion paused: telemetry storage reached its hard limit."))
