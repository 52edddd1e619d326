"""States, coverage, freshness and reasons of the live figures."""

import pytest
from test_operators import facts
from test_snapshots import HEALTH

from gaugeworks.operators import health, live
from gaugeworks.operators.filters import MetricFilter
from gaugeworks.schema import SECOND

NOW = 10_000 * SECOND
OTHER = MetricFilter(frozenset({"none"}))
ILL = [(1, "s", False, ["usage"], [], "SOURCE_FAILURE", None)]
WELL = [(1, "s", True, ["usage"], [], None, None)]


def at(seconds, **more):
    return {"observed_us": seconds * SECOND} | more


@pytest.mark.parametrize(("rows", "sources", "chosen", "out", "burn", "calls"), [
    ([], [], None, ("absent", "complete", "NO_OBSERVATIONS"), ("absent", "complete", "NO_OBSERVATIONS"), ("absent", "complete", "NO_OBSERVATIONS")),
    ([], ILL, None, ("unavailable", "partial", "SOURCE_FAILURE"), ("unavailable", "partial", "SOURCE_FAILURE"), ("unavailable", "partial", "SOURCE_FAILURE")),
    ([], [*ILL, *WELL], None, ("absent", "partial", "SOURCE_FAILURE"), ("unavailable", "partial", "SOURCE_FAILURE"), ("unavailable", "partial", "SOURCE_FAILURE")),
    ([at(9_999)], WELL, OTHER, ("absent", "complete", "FILTER_EXCLUDES_OBSERVATIONS"), ("absent", "complete", "FILTER_EXCLUDES_OBSERVATIONS"), ("absent", "complete", "FILTER_EXCLUDES_OBSERVATIONS")),
    ([at(9_999, call_id="c")], WELL, None, (None, "complete", None), (None, "complete", None), (None, "complete", None)),
    ([at(9_999, call_id="c", output_tokens=0, burn_total=0)], WELL, None, ("zero", "complete", None), ("zero", "complete", None), (None, "complete", None)),
    ([at(9_999)], WELL, None, (None, "complete", None), (None, "complete", None), ("unavailable", "complete", "STABLE_MODEL_CALL_ID_UNAVAILABLE")),
    ([at(9_999, burn_total=None, call_id="c")], WELL, None, (None, "complete", None), ("unavailable", "complete", "UNSUPPORTED_CAPABILITY"), (None, "complete", None)),
    ([at(9_999, call_id="c"), at(9_998, call_id="c", authority="y")], WELL, None, ("absent", "partial", "AUTHORITY_CONFLICT"), ("unavailable", "partial", "AUTHORITY_CONFLICT"), (None, "partial", None)),
    ([at(9_999, call_id="c"), at(9_998, call_id="d", reasoning=None)], WELL, None, (None, "complete", None), (None, "partial", None), (None, "complete", None)),
    ([at(9_999, call_id="c"), at(9_998, quality="unavailable")], WELL, None, (None, "partial", None), (None, "partial", None), (None, "partial", None)),
    ([at(100, call_id="c")], ILL, None, ("stale", "partial", "SOURCE_FAILURE"), ("stale", "partial", "SOURCE_FAILURE"), ("stale", "partial", "SOURCE_FAILURE")),
])
def test_states(spark, rows, sources, chosen, out, burn, calls):
    df = facts(spark, *rows) if rows else facts(spark, {}).where("false")
    row = live.light(df, spark.createDataFrame(sources, HEALTH), NOW, chosen=chosen).first()
    assert [(f["state"], f["coverage"], f["reason"]) for f in (row["throughput"], row["burn"], row["calls"])] == [out, burn, calls]


def test_retained_figures_are_as_old_as_the_source_furthest_behind(spark):
    df = facts(spark, at(100, source_id="s"), at(160, source_id="t"), at(150, source_id="s"), at(161, source_id="u"))
    both = spark.createDataFrame([*ILL, (2, "t", False, ["usage"], [], None, None)], HEALTH)
    r = live.output(df, both, NOW).first()
    assert (r["output_tokens"], r["sessions"], r["per_session"], r["updated_us"], r["age_s"], r["retained"], r["action"]) == (40, 0, None, 150 * SECOND, 9_850.0, True, "UPDATE_SOURCE")
    r = live.output(df, both.where("false"), NOW).first()
    assert (r["state"], r["updated_us"], r["reason"]) == ("stale", 161 * SECOND, None)


@pytest.mark.parametrize(("agents", "models", "rows", "kept"), [
    ("", "", [{}], [1, 2, 3]),
    ("a", "", [{}], [1, 2]),  # 1 owns a fact, 2 has the agent
    ("b", "", [{}], []),
    ("a", "zz", [{}], [2, 3]),  # nothing left: of known agents those that overlap, of others any
    ("", "zz", [{}], [1, 2, 3]),
    ("", "m", [{}], [1]),
])
def test_relevant_sources(spark, agents, models, rows, kept):
    df = spark.createDataFrame([(1, "s", False, ["usage"], ["x"], None, None), (2, "t", False, ["usage"], ["a"], None, None), (3, "u", False, ["usage"], [], None, None)], HEALTH)
    got = health.relevant(df, facts(spark, *rows), MetricFilter(frozenset(agents), frozenset({models} - {""})))
    assert sorted(r["ordinal"] for r in got.collect()) == kept
