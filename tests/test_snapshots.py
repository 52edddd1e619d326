from pyspark.sql import functions as F

from gaugeworks.operators import canonical, health, snapshots
from gaugeworks.operators.filters import MetricFilter
from gaugeworks.schema import SECOND

PERF = "agent string, request_id string, granularity string, model_raw string, observed_us bigint, duration_ms double, ttft_ms double, output_total bigint, is_retry boolean, quality string, source_id string, tier string, channel string"
HEALTH = "ordinal int, source_id string, is_healthy boolean, impacts array<string>, agents array<string>, reason_code string, action string"


def _request(i, t, source="s", **more):
    row = dict(agent="a", request_id=f"r{i}", granularity="request", model_raw="m", observed_us=t * SECOND, duration_ms=100.0 * i, ttft_ms=10.0 * i, output_total=11, is_retry=False, quality="measured", source_id=source, tier="fallback", channel="c") | more
    return tuple(row[c.split(" ")[0]] for c in PERF.split(", "))


def test_performance_snapshot(spark):
    rows = [_request(i, 5000 + i) for i in range(1, 6)] + [_request(9, 5000, is_retry=True), _request(7, 1000), _request(8, 900, "sick"), _request(6, 5000, output_total=1)]
    df = spark.createDataFrame(rows, PERF)
    fine = spark.createDataFrame([], HEALTH)
    r = snapshots.performance_snapshot(df, fine, 5005 * SECOND, 600).first()
    assert (r["e2e"]["p50"], r["e2e"]["p95"], r["ttft"]["p50"], r["retries"], r["decode_invalid"], r["state"], r["coverage"], r["decode_coverage"]) == (300, 600, 30, 1, 1, None, "complete", "partial")
    sick = spark.createDataFrame([(1, "sick", False, ["performance"], [], "SOURCE_FAILURE", "UPDATE_SOURCE")], HEALTH)
    r = snapshots.performance_snapshot(df, sick, 5005 * SECOND, 600).first()
    assert (r["samples"], r["state"], r["coverage"], r["e2e"]["p95"]) == (7, "stale", "partial", 800)
    r = snapshots.performance_snapshot(df, fine, 5005 * SECOND, 600, MetricFilter(frozenset({"none"}))).first()
    assert (r["samples"], r["state"]) == (0, "unavailable")


def test_canonical(spark):
    schema = "id string, n int, schema_version string, call_id string, source_id string, input_uncached bigint, cache_read bigint, cache_write bigint, output_visible bigint, reasoning bigint, burn_total bigint"
    rows = [("x", 1, "codex-rollout-v1", "", None, 1, 2, None, 3, None, None), ("x", 0, "claude-otel-request", "c", "", None, None, None, None, None, None), ("y", 2, "other", "d", "own", None, None, None, None, None, 7)]
    got = {r["id"]: r for r in canonical.canonical(spark.createDataFrame(rows, schema), ["n"]).collect()}
    assert (got["x"]["tier"], got["x"]["capability"], got["x"]["burn_total"]) == ("enhanced", "available", None)
    assert (got["y"]["channel"], got["y"]["authority"], got["y"]["burn_total"], got["y"]["quality"]) == ("unknown", "other", 7, "measured")
    filled = canonical.backfilled(spark.createDataFrame(rows, schema)).select("n", "source_id").collect()
    assert dict(filled) == {1: "codex", 0: "unknown", 2: "own"}
    assert canonical.upgraded(spark.createDataFrame([(1,)], "a int"), "a bigint, b string").first() == (1, None)
    assert canonical.without_scope(spark.createDataFrame(rows, schema), "other", "zz").count() == 2


def test_health(spark):
    df = spark.createDataFrame([("OVERLOADED",), ("WHAT",), (None,)], "code string")
    got = [tuple(r) for r in df.select(health.reason_of(F.col("code")).alias("r")).select("r", health.action_for(F.col("r"))).collect()]
    assert got == [("SOURCE_OVERLOADED", "UPDATE_SOURCE"), ("SOURCE_UNAVAILABLE", "UPDATE_SOURCE"), (None, None)]
    states = [(c, o, u, f, health.chart_state(*map(F.lit, (c, o, u, f)))) for c in (0, 1) for o in (True, False) for u in (True, False) for f in (0, 1)]
    got = spark.range(1).select(*[x[4].alias(str(i)) for i, x in enumerate(states)]).first()
    for (c, o, u, f, _), value in zip(states, got, strict=True):
        want = "stale" if o else None if c else "unavailable" if u else "absent" if f == 0 else "stale"
        assert value == want, (c, o, u, f)
    row = spark.range(1).select(*[snapshots.summary_status(F.lit(s).cast("string"), F.lit(c), F.lit(k), F.lit(live)) for s, c, k, live in (("stale", "complete", False, True), ("absent", "complete", False, True), (None, "partial", False, True), (None, "complete", True, True), (None, "complete", False, True), (None, "complete", False, False))]).first()
    assert list(row) == ["stale", "unavailable", "partial", "partial", "live", "unavailable"]
