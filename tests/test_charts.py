"""The trend charts, window-bounded authority, and the composite at a glance."""

import random

import pytest
from pyspark.sql import functions as F
from test_operators import facts
from test_snapshots import PERF, _request

from gaugeworks.operators import authority, charts, filters, health, snapshots
from gaugeworks.schema import SECOND

HEALTH = "ordinal int, source_id string, is_healthy boolean, impacts array<string>, agents array<string>, channels array<string>, reason_code string, action string"
NOW = 10_003 * SECOND
ILL = [(1, "s", False, ["usage", "performance"], [], [], "SOURCE_FAILURE", None)]


def at(seconds, **more):
    return {"observed_us": int(seconds * SECOND)} | more


def charted(spark, rows, ill=(), **more):
    df = facts(spark, *rows) if rows else facts(spark, {}).where("false")
    return {r["chart"]: r for r in charts.trend_snapshot(df, spark.createDataFrame(list(ill), HEALTH), NOW, **more).collect()}


@pytest.mark.parametrize(("rows", "ill", "state", "coverage", "authority", "reason", "retained"), [
    ([], [], "absent", "complete", "unavailable", "NO_OBSERVATIONS", False),
    ([], ILL, "unavailable", "partial", "unavailable", "SOURCE_FAILURE", False),
    ([at(9_990)], [], None, "complete", "x", None, False),
    ([at(5)], [], "stale", "complete", "x", "NO_OBSERVATIONS", True),
    ([at(9_990, source_id="s")], ILL, "stale", "partial", "x", "SOURCE_FAILURE", True),
    ([at(9_990), at(9_991, quality="estimated")], [], None, "partial", "x", None, False),
    ([at(9_990), at(9_991, quality="unavailable", authority="y")], [], None, "partial", "x", None, False),
    ([at(9_990, call_id="c"), at(9_991, call_id="c", authority="y")], [], "stale", "partial", "mixed", "AUTHORITY_CONFLICT", True),
    ([at(9_990), at(20, call_id="c"), at(21, call_id="c", authority="y")], [], None, "partial", "mixed", None, False),
])
def test_what_a_chart_says(spark, rows, ill, state, coverage, authority, reason, retained):
    r = charted(spark, rows, ill)["output"]
    assert (r["state"], r["coverage"], r["authority"], r["reason"], r["retained"]) == (state, coverage, authority, reason, retained)


def test_buckets(spark):
    """The open bucket is a placeholder, gaps stay null, both widths come of one selection."""
    r = charted(spark, [at(9_990, output_tokens=7, reasoning=None), at(9_999, output_tokens=8), at(10_001, output_tokens=100), at(9_500, output_tokens=3)])
    out = {b["bucket_us"] // SECOND: (b["complete"], b["amount"], b["value"]) for b in r["output"]["series"][0]["buckets"]}
    assert len(out) == 37
    assert (out[9_990], out[9_995], out[9_985], out[10_000]) == ((True, 7, 1.4), (True, 8, 1.6), (True, None, None), (False, None, None))
    assert (r["output"]["samples"], r["burn"]["samples"], r["calls"]["samples"], r["calls"]["series"]) == (2, 1, 0, [])
    burn = {b["bucket_us"] // SECOND: b for b in r["burn"]["series"][0]["buckets"]}
    assert len(burn) == 21
    assert burn[9_480]["amount"] is not None
    assert burn[9_990]["amount"] is None  # open
    assert [p["part"] for p in r["burn"]["part_series"]] == ["input_uncached", "cache_read", "cache_write", "output_visible", "reasoning"]
    row = next(t for t in r["output"]["table"] if t["bucket_us"] == 9_990 * SECOND)
    assert (row["cells"], row["complete"]) == (["7"], True)
    assert r["output"]["table"][-1]["complete"] is False
    assert r["calls"]["table"][0]["cells"] == []
    x = charts.chart_points(charts.trend_snapshot(facts(spark, at(9_990), at(9_999)), spark.createDataFrame([], HEALTH), NOW)).where("chart = 'output' AND amount IS NOT NULL").orderBy("bucket_us").collect()
    assert [round(p["x"] * 36) for p in x] == [34, 35]


def test_series(spark):
    """Of six models four are shown; a title is told apart only from others that are shown."""
    rows = [at(9_990, model_raw=f"m{i}", model_display="same" if i in (0, 1, 5) else f"d{i}", output_tokens=100 - i) for i in range(6)]
    got = charted(spark, rows)["output"]["series"]
    assert [(s["title"], s["role"], s["emphasis"]) for s in got] == [("same (m0)", "model", "normal"), ("same (m1)", "model", "normal"), ("d2", "model", "normal"), ("d3", "model", "normal"), ("Other", "other", "other")]
    assert sum(b["amount"] or 0 for b in got[-1]["buckets"]) == 96 + 95
    got = charted(spark, [*rows, at(9_991, model_raw="m2", quality="estimated")])["output"]["series"]
    assert [s["emphasis"] for s in got] == ["estimated"] * 4 + ["other"]


def test_calls_count_once_and_keep_conflicts(spark):
    rows = [at(9_900, call_id="c"), at(9_950, call_id="c", authority="y"), at(9_960, call_id="d", quality="unavailable"), at(9_961, call_id="d"), at(9_970, call_id="")]
    r = charted(spark, rows)["calls"]
    assert {b["bucket_us"] // SECOND: b["amount"] for b in r["series"][0]["buckets"] if b["amount"]} == {9_900: 1, 9_960: 1}
    assert (r["authority"], r["samples"]) == ("mixed", 2)


def test_filtered_out(spark):
    r = charted(spark, [at(9_990)], chosen=filters.MetricFilter(frozenset({"nobody"})))["output"]
    assert (r["state"], r["reason"], r["scope"], r["series"]) == ("absent", "FILTER_EXCLUDES_OBSERVATIONS", "selected", [])


@pytest.mark.parametrize("few", [200_000, 0])
def test_selection_of_a_window(spark, monkeypatch, few):
    """Equals the selection of all of history, cut to the window, whichever way keys are joined."""
    monkeypatch.setattr(authority, "BROADCAST_COHORTS", few)
    rng = random.Random(4)
    rows = [at(rng.randint(0, 100), id=f"i{i:03}", call_id=rng.choice([None, "", "a", "b", "c", "d", "e", "f"]), tier=rng.choice(["enhanced", "fallback", "fallback"]), authority=rng.choice("xxxxxy"), agent=rng.choice("ab"), range_start_us=rng.choice([None, 1])) for i in range(150)]
    df = facts(spark, *rows)
    inside = filters.in_half_open_window(30 * SECOND, 60 * SECOND)
    ids = lambda x: sorted(r["id"] for r in x.collect())
    assert ids(authority.select_window(df, inside)) == ids(authority.select_authoritative(df).where(inside))
    whole = authority.select_authoritative(df)
    r = authority.standing(df).first()
    assert r["conflicting"] == authority.cohorts(df).agg(F.bool_or("conflict")).first()[0] == authority.has_conflict(df).first()[0]
    assert (r["nothing"], r["lacking"], r["newest_us"], r["low"], r["high"]) == tuple(whole.agg(F.count("*") == 0, F.bool_or(F.col("quality") == "unavailable"), F.max("observed_us"), F.min("authority"), F.max("authority")).first())
    assert tuple(authority.standing(df.where("false")).first()) == (False, True, None, None, False, None)


def test_performance_of_a_sick_source_is_stale(spark):
    """Also where its requests are of the window; of a legacy request none is told."""
    sick = spark.createDataFrame(ILL, HEALTH)
    state = lambda *rows, h=sick, **more: snapshots.performance_snapshot(spark.createDataFrame(list(rows), PERF), h, 5005 * SECOND, 600, **more).first()
    r = state(_request(1, 5000), _request(2, 5001))
    assert (r["state"], r["reason"], r["action"], r["retained"]) == ("stale", "SOURCE_FAILURE", "UPDATE_SOURCE", True)
    assert state(_request(1, 5000, "t"))["state"] is None
    legacy = spark.createDataFrame([(1, health.LEGACY, False, ["performance"], [], [], None, None)], HEALTH)
    assert state(_request(1, 5000, health.LEGACY), h=legacy)["state"] is None
    r = state(_request(1, 5000), h=sick.where("false"), chosen=filters.MetricFilter(frozenset({"none"})))
    assert (r["state"], r["reason"]) == ("unavailable", "FILTER_EXCLUDES_OBSERVATIONS")
    assert state(_request(1, 5000, quality="unavailable"), h=sick.where("false"))["reason"] == "REQUEST_TIMING_UNAVAILABLE"


@pytest.mark.parametrize(("agents", "channels", "source", "kept"), [([], [], "s", True), ([], [], "other", False), (["a"], [], "other", True), ([], ["c"], "other", True), (["b"], ["d"], "other", False)])
def test_legacy_requests_have_owners_by_agent_or_channel(spark, agents, channels, source, kept):
    rows = spark.createDataFrame([_request(1, 5000, "s"), _request(2, 5000, health.LEGACY)], PERF)
    df = spark.createDataFrame([(1, source, False, ["performance"], agents, channels, None, None)], HEALTH)
    assert health.relevant_performance(df, rows, filters.MetricFilter(frozenset(), frozenset({"m"}))).count() == kept
    assert health.relevant_performance(df, rows, filters.MetricFilter()).count() == 1


def test_composite_of_nothing(spark):
    none = facts(spark, {}).where("false")
    r = snapshots.light_composite(none, spark.createDataFrame([], PERF), spark.createDataFrame([], HEALTH), NOW).collect()
    assert len(r) == 1
    assert (r[0]["throughput"]["state"], r[0]["performance"]["state"], r[0]["coding_agents"], r[0]["models"], r[0]["source_health"], r[0]["scope"]) == ("absent", "unavailable", [], [], [], "all")
