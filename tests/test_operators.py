"""Operators against small models of their meaning."""

from itertools import pairwise

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugeworks.functions import scalars
from gaugeworks.operators import authority, bounded, counters, filters, metrics, performance, rollups, trends
from gaugeworks.schema import DAY, SECOND, TOKEN_PARTS

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
FACT = "id string, source_id string, agent string, model_raw string, model_display string, session_id string, observed_us bigint, output_tokens bigint, quality string, authority string, tier string, channel string, granularity string, call_id string, range_start_us bigint, range_end_us bigint, input_uncached bigint, cache_read bigint, cache_write bigint, output_visible bigint, reasoning bigint, burn_total bigint"
BASE = dict(source_id="s", agent="a", model_raw="m", model_display="M", session_id="1", observed_us=0, output_tokens=10, quality="measured", authority="x", tier="fallback", channel="c", granularity="call", call_id=None, range_start_us=None, range_end_us=None, input_uncached=1, cache_read=1, cache_write=1, output_visible=1, reasoning=1, burn_total=100)


def facts(spark, *rows):
    names = [c.split(" ")[0] for c in FACT.split(", ")]
    return spark.createDataFrame([tuple((BASE | {"id": f"f{i}"} | r)[n] for n in names) for i, r in enumerate(rows)], FACT)


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


@pytest.mark.parametrize(("rows", "kept"), [
    ([{"call_id": "c", "tier": "fallback"}, {"call_id": "c", "tier": "enhanced", "authority": "y"}], ["f1"]),
    ([{"call_id": "c", "authority": "x"}, {"call_id": "c", "authority": "y"}], []),
    ([{"call_id": "c"}, {"call_id": "c"}], ["f0"]),
    ([{}, {}], ["f0", "f1"]),
    ([{"call_id": ""}, {"call_id": ""}], ["f0", "f1"]),
    ([{"call_id": "c", "range_start_us": 1}, {"call_id": "c", "range_start_us": 2, "tier": "enhanced"}], ["f0", "f1"]),
    ([{"call_id": "c", "authority": "x"}, {"call_id": "c", "authority": "y"}, {"call_id": "c", "authority": "z", "tier": "enhanced"}], ["f2"]),
])
def test_authority(spark, rows, kept):
    assert ids(authority.select_authoritative(facts(spark, *rows))) == kept


def test_superseded_matches_null_ranges(spark):
    df = facts(spark, {"call_id": "c"}, {"call_id": "c", "tier": "enhanced"}, {"call_id": "c", "tier": "enhanced"}, {"call_id": "d"})
    assert {r["id"]: r["superseded_by"] for r in authority.mark_superseded(df).collect()} == {"f0": "f1", "f1": None, "f2": None, "f3": None}


def test_windows_are_closed_or_half_open(spark):
    df = facts(spark, *[{"observed_us": t * SECOND} for t in (0, 100, 700, 701)])
    assert ids(df.where(filters.in_closed_window(700 * SECOND, 600))) == ["f1", "f2"]
    assert ids(df.where(filters.in_half_open_window(0, 700 * SECOND))) == ["f0", "f1"]
    got = filters.last_good(df, 5000 * SECOND, 600).collect()
    assert sorted((r["id"], r["retained"]) for r in got) == [("f2", True), ("f3", True)]


def test_filter_algebra():
    f = filters.MetricFilter().toggle("agents", "a")
    assert f.agents == {"a"}
    assert not f.is_all
    assert f.toggle("agents", "a").is_all
    assert f.toggle("models", "m").select_all("agents").models == {"m"}


def test_throughput_and_burn(spark):
    df = facts(spark, {"output_tokens": 1800, "session_id": "1"}, {"output_tokens": 1800, "session_id": "2", "cache_write": None})
    r = metrics.throughput(df, 180).first()
    assert (r["tokens_per_s"], r["sessions"], r["per_session"], r["coverage"]) == (20.0, 2, 10.0, "complete")
    b = metrics.burn(df, 600).first()
    assert (b["burn_total"], b["tokens_per_min"], b["cache_write"], b["reasoning"], b["coverage"]) == (200, 20.0, None, 2, "partial")
    assert metrics.throughput(df.where("false"), 180).first()["quality"] == "unavailable"


@FEW
@given(st.lists(st.integers(0, 50), min_size=1, max_size=40), st.sampled_from([0.1, 0.5, 0.95]))
def test_nearest_rank(spark, values, p):
    from decimal import Decimal
    from math import ceil

    got = performance.nearest_ranks(spark.createDataFrame([(float(v),) for v in values], "v double"), "v", {"q": p}).first()["q"]
    assert got == sorted(values)[max(0, ceil(Decimal(str(p)) * len(values)) - 1)]


def test_latency_example(spark):
    rows = [(f"r{i}", "m", float(100 * i), float(10 * i), 11, False, "measured") for i in range(1, 6)]
    df = spark.createDataFrame(rows, "request_id string, model_raw string, duration_ms double, ttft_ms double, output_total bigint, is_retry boolean, quality string")
    r = performance.distribution(performance.with_decode_tps(performance.normal(df)), "decode_tps", {"p50": 0.5, "p10": 0.1}).first()
    assert (r["p50"], r["p10"]) == (pytest.approx(100 / 2.7), pytest.approx(100 / 4.5))
    assert performance.distribution(df, "ttft_ms", {"p50": 0.5}).first()["p50"] == 30


def test_performance_preference_is_textual(spark):
    schema = "agent string, request_id string, granularity string, duration_ms double, ttft_ms double, tier string"
    df = spark.createDataFrame([("a", "r", "request", 9.0, 1.0, "fallback"), ("a", "r", "request", 10.0, 1.0, "fallback"), ("a", "q", "request", 9.5, 1.0, "fallback"), ("a", "q", "request", 99.0, 1.0, "enhanced")], schema)
    assert {r["request_id"]: r["duration_ms"] for r in authority.coalesce_performance(df).collect()} == {"r": 10.0, "q": 99.0}


def test_open_bucket_and_gaps(spark):
    now = 1_771_202 * SECOND
    df = facts(spark, *[{"observed_us": t * SECOND, "output_tokens": n} for t, n in ((1_771_197, 10), (1_771_200, 7), (1_771_201, 7))])
    points = {r["bucket_us"] // SECOND: r for r in trends.trend(df, now, 5, 180).collect()}
    assert len(points) == 37
    assert (points[1_771_195]["amount"], points[1_771_195]["rate"]) == (10, 2.0)
    assert points[1_771_200]["amount"] is None
    assert points[1_771_190]["amount"] is None


def test_top_four_and_other(spark):
    rows = [{"model_raw": f"m{i}", "model_display": f"M{i}", "output_tokens": 1000} for i in range(4)] + [{"model_raw": f"h{i}", "model_display": "H", "output_tokens": n} for i, n in enumerate((10, 20))]
    got = {r["model_raw"]: r["series"] for r in trends.ranked(trends.bucketed(facts(spark, *rows), 5 * SECOND, 5, 5)).collect()}
    assert got == {"m0": "M0", "m1": "M1", "m2": "M2", "m3": "M3", "h0": "Other", "h1": "Other"}


def test_calls_per_bucket(spark):
    df = facts(spark, {"call_id": "1"}, {"call_id": "1"}, {"call_id": "2"}, {})
    got = trends.calls_trend(df, 30 * SECOND, 30, 30).collect()
    assert [(r["calls"], r["calls_per_min"]) for r in got] == [(2, 4.0)]


def _budgets(counts, limit):
    """Max-min fairness by repeated equal shares."""
    left, out, rest = limit, {}, dict(counts)
    while rest:
        share = left // len(rest)
        small = [s for s, n in rest.items() if n <= share]
        if not small:
            for i, s in enumerate(sorted(rest)):
                out[s] = left // len(rest) + (i < left % len(rest))
            return out
        s = min(small, key=lambda s: (rest[s], s))
        out[s] = rest.pop(s)
        left -= out[s]
    return out


@FEW
@given(st.dictionaries(st.sampled_from("abcdefgh"), st.integers(1, 60), min_size=1), st.integers(0, 150))
def test_fair_budgets(spark, counts, limit):
    df = spark.createDataFrame(list(counts.items()), "source_id string, n bigint")
    assert {r["source_id"]: r["budget"] for r in bounded.fair_budgets(df, limit).collect()} == _budgets(counts, limit)


def _deltas(totals):
    last, out = 0, []
    for i, t in enumerate(totals):
        if t < last:
            last, out = 0, []
        if t > last:
            out.append((i, t - last))
        last = t
    return out


@FEW
@given(st.lists(st.lists(st.integers(0, 9), max_size=12), min_size=1, max_size=4))
def test_output_deltas(spark, files):
    rows = [(f"f{k}", i, t) for k, totals in enumerate(files) for i, t in enumerate(totals)]
    got = counters.output_deltas(spark.createDataFrame(rows, "file string, ordinal bigint, total bigint")).collect()
    want = sorted((f"f{k}", i, d) for k, totals in enumerate(files) for i, d in _deltas(totals))
    assert sorted((r["file"], r["ordinal"], r["delta"]) for r in got) == want


def test_validated_parts(spark):
    lines = [("f", 0, 5000, 6000, 300, 100), ("f", 1, 6000, 3000, 500, 100), ("g", 0, 100, 50, 80, 20), ("g", 1, 150, 70, 80, 20), ("g", 2, 200, 90, 70, 20)]
    got = counters.validated_part_deltas(spark.createDataFrame(lines, "file string, ordinal bigint, input bigint, cached bigint, output bigint, reasoning bigint"))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == [("f", 0, 300, None, None, None, None), ("f", 1, 200, 3000, 3000, 400, 100), ("g", 2, 70, 110, 90, 50, 20)]


def test_rollups_and_late_facts(spark):
    old = facts(spark, {"observed_us": 5}, {"observed_us": DAY - 1, "reasoning": None})
    none = rollups.daily(old.where("false")).withColumn("coverage", F.lit("complete"))
    done, left = rollups.compact(old, none, DAY + 7)
    r = done.first()
    assert (done.count(), r["output_tokens"], r["samples"], r["reasoning"], r["cache_read"], r["coverage"], left.count()) == (1, 20, 2, None, 2, "complete", 0)
    again, kept = rollups.compact(facts(spark, {"observed_us": 9}), done, DAY)
    assert (again.first()["output_tokens"], again.first()["coverage"], kept.count()) == (20, "partial", 1)
    assert rollups.coverage_since(5, 5) == "partial"
    assert rollups.coverage_since(6, 5) == rollups.coverage_since(0, None) == "complete"


def test_policy():
    p = rollups.RetentionPolicy()
    assert [p.level(b, r) for b, r in ((0, 0), (800 << 20, 0), (0, 2_000_000))] == ["normal", "warning", "hardLimit"]
    assert (p.batch(1 << 30, 0), p.batch(0, 2_000_010), p.batch(0, 9_000_000)) == (10_000, 11, 100_000)
    assert (p.excess(0, 2_000_010), p.excess(0, 5), p.excess(2 << 30, 100)) == (11, 0, 51)


def test_segments_table_and_points(spark):
    points = spark.createDataFrame([("a", i, None if i in (2, 3) else i) for i in range(6)] + [("b", 1, 5)], "series string, bucket_us bigint, amount bigint")
    assert sorted((r["series"], r["start_us"], r["end_us"], r["points"]) for r in trends.segments(points).collect()) == [("a", 0, 1, 2), ("a", 4, 5, 2), ("b", 1, 1, 1)]
    assert {r["bucket_us"]: (r["a"], r["b"]) for r in trends.table(points, ["a", "b"]).collect()}[1] == ("1", "5")
    x = sorted(r["x"] for r in trends.normalised(points.where("series = 'a'")).collect())
    assert all(b > a for a, b in pairwise(x))


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    strict = lambda text: one(scalars.strict_int(F.try_parse_json(F.lit(text)), "$.n"))
    assert [strict(f'{{"n": {v}}}') for v in ("12", "12.0", "1e3", "12.5", '"12"', "true", "null")] == [12, 12, 1000, None, None, None, None]
    assert strict("{") is None
    assert one(scalars.iso_micros(F.lit("2026-04-15T12:00:00.5Z"))) == 1776254400500000
    assert one(scalars.iso_micros(F.lit("2026-04-15"))) is None
    assert [one(scalars.number_text(F.lit(v))) for v in (3.0, 3.5)] == ["3", "3.5"]
    assert [one(scalars.age_text(F.lit(v))) for v in (59, 60, 7300)] == ["59s", "1m", "2h"]
    names = ("/x/rollout-2026-04-15T12-00-00-0190-ab.jsonl", "/y/0190.jsonl", "/y/0190.jsonl.", "/y/a.txt")
    assert [one(scalars.file_identity(F.lit(n))) for n in names] == ["0190-ab", "0190", None, None]
    slots = spark.createDataFrame([("gpt", 8), (None, 8)], "t string, n bigint").select(scalars.fnv_slot("t", "n").alias("s")).collect()
    h = scalars.FNV_BASIS
    for b in b"gpt":
        h = (h ^ b) * scalars.FNV_PRIME % 2**64
    assert [r["s"] for r in slots] == [h % 8, None]


def test_token_parts_are_all_there():
    assert len(TOKEN_PARTS) == 5
