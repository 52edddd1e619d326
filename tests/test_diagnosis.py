"""Source health from scans, the diagnostic document, narration, and rollups that merge."""

import json

import pytest
from pyspark.sql import functions as F
from test_charts import HEALTH, NOW, at
from test_operators import facts

from gaugeworks.operators import charts, diagnosis, health, rollups
from gaugeworks.schema import DAY, SECOND


def _codes(spark, *rows):
    return spark.createDataFrame(list(rows), "source_id string, code string")


def test_scans_become_health(spark):
    of = lambda *names: spark.createDataFrame([(n,) for n in names], "source_id string")
    files = lambda *rows: spark.createDataFrame(list(rows), "source_id string, file string")
    codes = diagnosis.scan_codes(_codes(spark, ("a", "UNKNOWN_SCHEMA"), ("a", "UNKNOWN_SCHEMA"), ("b", None)), files(("a", "x"), ("b", "y"), ("b", "z")), files(("a", "x"), ("b", "y")), of("c"), of("a"), of("d"))
    assert sorted(map(tuple, codes.collect())) == [("a", "PARSER_VERSION_CHANGED"), ("a", "UNKNOWN_SCHEMA"), ("b", "SOURCE_UNAVAILABLE"), ("c", "SOURCE_OVERLOADED"), ("d", "SOURCE_FAILURE")]
    sources = of("e", "a", "b", "c", "d").selectExpr("source_id", "array('x') AS agents", "array('y') AS channels")
    got = diagnosis.source_health(sources, codes).orderBy("ordinal").collect()
    assert [(r["ordinal"], r["source_id"], r["is_healthy"], r["reason_code"]) for r in got] == [
        (1, "a", False, "UNSUPPORTED_SCHEMA"), (2, "a", False, "UNSUPPORTED_SCHEMA"), (3, "b", False, "SOURCE_UNAVAILABLE"), (4, "c", False, "SOURCE_OVERLOADED"), (5, "d", False, "SOURCE_FAILURE"), (6, "e", True, None)]
    assert [r["diagnostic_code"] for r in got[:2]] == ["PARSER_VERSION_CHANGED", "UNKNOWN_SCHEMA"]


def test_document(spark):
    metrics = spark.createDataFrame([("measured", "complete", 59.9, None), ("derived", "partial", 60.0, "X"), ("derived", "partial", 86_400.0, "X"), ("estimated", "complete", -1.0, None), ("unavailable", "complete", None, "A"), ("measured", "complete", float("nan"), None), ("measured", "complete", float("inf"), None)], "quality string, coverage string, age_s double, reason string")
    rows = spark.createDataFrame([(1, "secret/path", False, [], [], [], "X", None), (2, "other", True, [], [], [], None, None)], HEALTH)
    versions, names = spark.createDataFrame([("1.2",), ("1.2",), ("v1",)], "version string"), spark.createDataFrame([(diagnosis.SCHEMAS[0],), ("private",)], "name string")
    text = diagnosis.document(metrics, rows, {"app": "1.0", "build": "7"}, versions, names).first()["document"]
    assert json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == text
    assert "secret" not in text
    d = json.loads(text)
    assert d["relative_age_counts"] == {"under_1m": 1, "1m_to_5m": 1, "5m_to_1h": 0, "1h_to_24h": 0, "over_24h": 1, "unknown": 4}
    assert d["reason_counts"] == [{"code": "A", "count": 1}, {"code": "X", "count": 3}]
    assert d["sources"] == [{"health": "healthy", "ordinal": 1, "reason_codes": []}, {"health": "unhealthy", "ordinal": 2, "reason_codes": ["X"]}]
    assert d["versions"] == {"app": "1.0", "build": "7", "parsers": ["1.2"], "schemas": [diagnosis.SCHEMAS[0]]}
    none = json.loads(diagnosis.document(metrics.where("false"), rows.where("false"), {}, versions.where("false"), names.where("false")).first()["document"])
    assert (none["metric_count"], none["reason_counts"], none["sources"], none["versions"]["app"]) == (0, [], [], "unavailable")


@pytest.mark.parametrize(("text", "version", "build"), [("1.0", True, False), ("1", False, True), ("1.", True, False), (".1", False, False), ("v1.0", False, False), ("1.0\n", False, False), ("9" * 20, False, True), ("9" * 21, False, False), ("1." + "0" * 62, True, False), ("1." + "0" * 63, False, False), ("", False, False)])
def test_allowed_versions(spark, text, version, build):
    r = spark.range(1).select(diagnosis.semantic_version(F.lit(text)).isNotNull(), diagnosis.build_number(F.lit(text)).isNotNull()).first()
    assert tuple(r) == (version, build)


def test_capacity_text(spark):
    cases = [("normal", None), ("warning", None), ("hardLimit", "CAPACITY_PROTECTED_WINDOW"), ("hardLimit", "CAPACITY_HARD_LIMIT"), (None, None)]
    got = spark.range(1).select(*[diagnosis.capacity_text(F.lit(a), F.lit(b)).alias(str(i)) for i, (a, b) in enumerate(cases)]).first()
    assert [x and x.split(":")[0] + x[-5:] for x in got] == [None, "Capacity warningimit.", "Ingestion pausedsume.", "Ingestion pausedimit.", None]


def test_narration(spark):
    snapshot = charts.trend_snapshot(facts(spark, at(9_900, output_tokens=7)), spark.createDataFrame([], HEALTH), NOW)
    told = {(r["chart"], r["row"], r["column"]): r for r in charts.cell_narration(snapshot).collect()}
    spoken = told["output", 17, 0]["spoken"]
    assert spoken == "1970-01-01T02:45:05Z, 1970-01-01T02:45:10Z, M, m, —, Exact, ●, complete bucket, Quality Derived, State -, Coverage Complete"
    assert told["output", 16, 0]["label"] == "M, m, 1970-01-01T02:45:00Z to 1970-01-01T02:45:05Z"
    assert "open bucket" in told["output", 36, 0]["spoken"]
    assert told["burn", 17, 4]["spoken"].split(", ")[2:7] == ["Reasoning", "Reasoning", "1", "Reasoning", "●"]
    assert told["calls", 0, 0]["spoken"] == "No trend values. Quality Unavailable. State Stale. Coverage Partial."
    assert [k for k in told if k[0] == "calls"] == [("calls", 0, 0)]
    assert charts.clamped(-1, 9, 3, 4) == (0, 3)
    assert charts.clamped(5, 5, 0, 4) == (0, 0)


def test_late_facts_merge_into_rollups(spark):
    rows = [{"observed_us": d * DAY + i * SECOND, "id": f"{d}-{i}", "session_id": str(i % 3), "reasoning": None if (d, i) == (1, 2) else 1, "quality": "estimated" if (d, i) == (0, 1) else "measured", "burn_total": None if i == 4 else 5} for d in range(3) for i in range(6)]
    df = facts(spark, *rows)
    late = F.col("id").isin("1-2", "1-3", "0-1", "2-4")
    merged = rollups.with_late(rollups.counted(df.where(~late)), df.where(late))
    key = lambda x: sorted(map(repr, (tuple(r) for r in x.select(*sorted(x.columns)).collect())))
    assert key(rollups.told(merged)) == key(rollups.daily(df))
    untouched = rollups.with_late(rollups.counted(df), df.where("false"))
    assert key(rollups.told(untouched)) == key(rollups.daily(df))
    assert health.LEGACY
