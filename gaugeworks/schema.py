"""Schemas of the telemetry relations. A null token part or total is unavailable, which
is not zero. Times are epoch microseconds in UTC."""

from __future__ import annotations

SCHEMA_VERSION = 1

#: The five disjoint parts of a call's tokens.
TOKEN_PARTS = ["input_uncached", "cache_read", "cache_write", "output_visible", "reasoning"]

USAGE_FACTS = (
    "id string, source_id string, agent string, model_raw string, model_display string, session_id string, turn_id string, observed_us bigint, "
    "output_tokens bigint, quality string, authority string, tier string, channel string, granularity string, call_id string, "
    "range_start_us bigint, range_end_us bigint, input_uncached bigint, cache_read bigint, cache_write bigint, output_visible bigint, reasoning bigint, "
    "burn_total bigint, superseded_by string"
)
PERFORMANCE_FACTS = (
    "request_id string, agent string, model_raw string, model_display string, observed_us bigint, duration_ms double, ttft_ms double, output_total bigint, "
    "is_retry boolean, channel string, tier string, granularity string, range_start_us bigint, range_end_us bigint, source_id string, quality string"
)
SOURCE_HEALTH = (
    "ordinal int, source_id string, is_healthy boolean, diagnostic_code string, impacts array<string>, agents array<string>, channels array<string>, "
    "reason_code string, action string"
)
#: What makes two facts measurements of the same thing.
COHORT = ["agent", "call_id", "granularity", "range_start_us", "range_end_us"]
ROLLUP_COHORT = ["agent", "model_raw", "session_id", "source_id", "authority", "tier", "granularity"]

SECOND = 1_000_000
DAY = 86_400 * SECOND
