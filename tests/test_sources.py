"""Logs, spans and their classification on small written inputs."""

import json

import pytest

from gaugeworks.sources import logs, spans
from gaugeworks.schema import SECOND


def _line(**fields):
    return json.dumps(fields)


def _usage(i, c, o, r):
    return {"info": {"total_token_usage": {"input_tokens": i, "cached_input_tokens": c, "output_tokens": o, "reasoning_output_tokens": r}}, "type": "token_count"}


def test_rollout(spark, tmp_path):
    t = "2026-04-15T12:00:0{}Z".format
    lines = [
        _line(type="session_meta", timestamp=t(0), payload={"id": "sess"}), _line(type="turn_context", timestamp=t(1), payload={"turn_id": "t1", "model": "m-1"}),
        _line(type="event_msg", timestamp=t(2), payload=_usage(5000, 3000, 1800, 400)), "", _line(type="event_msg", timestamp=t(3), payload=_usage(5000, 3000, 1800, 400)),
        _line(type="mystery"), _line(type="event_msg", timestamp=t(4), ordinal=70, payload=_usage(5000, 6000, 2000, 400)), "not json",
        _line(type="event_msg", timestamp=t(5), payload={"type": "user_message"}), _line(type="event_msg", timestamp=t(5), payload={"type": "other"}), _line(type="session_meta", payload={"id": ""}),
        _line(type="event_msg", timestamp="never", payload=_usage(1, 1, 9000, 1)), _line(type="event_msg", timestamp=t(6), payload={"type": "turn_started"}), _line(type="world_state"),
    ]
    (tmp_path / "rollout-2026-04-15T12-00-00-0190.jsonl").write_text("\n".join(lines) + "\n" + _line(type="event_msg", timestamp=t(7), payload=_usage(9000, 0, 9000, 0)))
    got = sorted(logs.rollout_observations(spark, str(tmp_path)).collect(), key=lambda r: r["observed_us"])
    assert [(r["session_id"], r["turn_id"], r["model_raw"], r["output_tokens"]) for r in got] == [("sess", "t1", "m-1", 1800), ("sess", "t1", "m-1", 200)]
    assert (got[0]["input_uncached"], got[0]["cache_read"], got[0]["cache_write"], got[0]["output_visible"], got[0]["reasoning"], got[0]["burn_total"]) == (2000, 3000, None, 1400, 400, 6800)
    assert got[1]["burn_total"] is None
    assert [r["id"] for r in got] == ["codex-rollout:0190:2", "codex-rollout:0190:70"]
    codes = logs.diagnostics(logs.rollout_lines(logs.lines(spark, str(tmp_path)))).collect()
    assert [(r["file"], r["code"], r["n"]) for r in codes] == [("0190", "UNKNOWN_SCHEMA", 5)]


def test_transcript(spark, tmp_path):
    def message(session, uuid, out, **more):
        usage = {"input_tokens": 2000, "cache_creation_input_tokens": 800, "cache_read_input_tokens": 3000, "output_tokens": out} | more
        return _line(type="assistant", uuid=uuid, sessionId=session, timestamp="2026-04-15T12:00:00Z", message={"role": "assistant", "model": "m-2", "usage": usage})

    def total(session, out):
        return _line(type="system", subtype="session_usage", sessionId=session, timestamp="2026-04-15T12:00:09Z", usage={"output_tokens": out})

    (tmp_path / "a.jsonl").write_text("\n".join([_line(type="user"), message("s1", "u1", 1800), message("s1", "u1", 1900, input_tokens=2010), total("s1", 99_999), total("s2", 50), total("s2", 70)]) + "\n")
    got = logs.transcript_observations(spark, str(tmp_path)).collect()
    assert sorted((r["session_id"], r["output_tokens"], r["burn_total"]) for r in got if r["burn_total"]) == [("s1", 100, 110), ("s1", 1800, 7600)]
    assert sorted((r["session_id"], r["output_tokens"]) for r in got if r["burn_total"] is None) == [("s2", 20), ("s2", 50)]


def test_synthetic(spark, tmp_path):
    line = dict(schema_version="v1", observation_identity="o", coding_agent="x", model_raw="m", model_display="M", session_id="s", turn_id="t", observed_offset_seconds=-10, usage={"output_tokens": 1800})
    (tmp_path / "f.jsonl").write_text(_line(**line))
    (r,) = logs.synthetic_observations(spark, str(tmp_path), 100 * SECOND, "v1", "x").collect()
    assert (r["observed_us"], r["output_tokens"]) == (90 * SECOND, 1800)
    with pytest.raises(Exception, match="unsupported schema"):
        logs.synthetic_observations(spark, str(tmp_path), 0, "v2", "x").collect()


def test_discovery(spark, tmp_path):
    for root, name in (("archived", "a"), ("archived", "b"), ("live", "a")):
        (tmp_path / root / "2026").mkdir(parents=True, exist_ok=True)
        (tmp_path / root / "2026" / f"{name}.jsonl").write_text("x\n" * (2 if root == "live" else 1))
    (tmp_path / "live" / "no.txt").write_text("")
    found = logs.discovered(spark, [str(tmp_path / "archived"), str(tmp_path / "live")])
    assert sorted((r["file"], r["length"]) for r in found.collect()) == [("a", 4), ("b", 2)]
    assert logs.discovered(spark, [str(tmp_path / "archived")], newest=1).count() == 1
    cursors = spark.createDataFrame([("a", 2, "p"), ("b", 9, "p"), ("gone", 1, "p")], "file string, length bigint, fingerprint string")
    stamped = found.selectExpr("*", "'p' AS fingerprint")
    with_time = cursors.join(found.select("file", "modified"), "file", "left")
    assert {r["file"]: r["action"] for r in logs.changed(stamped, with_time).collect()} == {"a": "append", "b": "rebuild"}
    assert [r["file"] for r in logs.missing(found, cursors).collect()] == ["gone"]


def test_landed_logs_are_files(spark, tmp_path):
    """A file a log, lines in order, in no more folders than there are tasks; nothing is left beside them."""
    texts = {f"rollout-2024-01-01T00-00-00-u{i}.jsonl": [f"é {i} {j}" for j in range(i % 5 + 1)] for i in range(300)}
    rows = spark.createDataFrame([(log, -j, x) for log, lines in texts.items() for j, x in reversed(list(enumerate(lines[::-1])))], "log string, place int, line string")
    logs.land(rows, str(tmp_path / "landed"))
    found = list((tmp_path / "landed").rglob("*"))
    assert {p.name: p.read_text() for p in found if p.is_file()} == {log: "".join(f"{x}\n" for x in lines) for log, lines in texts.items()}
    assert len([p for p in found if p.is_dir()]) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = logs.discovered(spark, [str(tmp_path / "landed")]).collect()
    assert {(r["file"], r["length"]) for r in got} == {(f"u{i}", sum(len(x.encode()) + 1 for x in texts[f"rollout-2024-01-01T00-00-00-u{i}.jsonl"])) for i in range(300)}


def test_discovery_lists_in_tasks(spark, tmp_path):
    """As Spark's own listing has it: path, time and length, hidden entries left out; once, without a file index."""
    for name in ["a.jsonl", "x/b.jsonl", "x/y/c.jsonl/part-0", "x/no.txt", "_x/d.jsonl", ".h/e.jsonl", "x/_f.jsonl", "x/.g.jsonl", "k=_/_z=1/i.jsonl"]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{*.jsonl,part-*}").load(str(tmp_path))
    want = {(r["path"], r["modificationTime"], r["length"]) for r in read.select("path", "modificationTime", "length").collect()}
    found = logs.discovered(spark, [str(tmp_path)])
    (tmp_path / "late.jsonl").write_text("")
    assert {(r["path"], r["modified"], r["length"]) for r in found.collect()} == want
    assert {r["file"] for r in found.collect()} == {"a", "b", "c", "i"}
    assert "binaryFile" not in found._jdf.queryExecution().toString()


def test_fingerprints_are_dealt_out(spark, tmp_path):
    for i in range(8):
        (tmp_path / f"{i}.jsonl").write_text("x\n" * i)
    found = logs.discovered(spark, [str(tmp_path)])
    got = logs.fingerprinted(found, found.selectExpr("file", "length"))
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len({r["fingerprint"] for r in got.collect()}) == 8


def _span(name=spans.SPAN, **attributes):
    value = lambda v: {"intValue": str(v)} if isinstance(v, int) else {"stringValue": v}
    return {"name": name, "endTimeUnixNano": "2000000000", "attributes": [{"key": k.replace("__", "."), "value": value(v)} for k, v in attributes.items()]}


def _body(*found):
    return json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": list(found)}]}]})


GOOD = dict(model="m", duration_ms=500, ttft_ms=100, output_tokens=11, request_id="r", attempt=2)


def test_spans(spark):
    aliased = {"gen_ai.request.model": "m2", "model": "other", "duration_ms": "500", "ttft_ms": 0, "client_request_id": "q", "gen_ai.usage.output_tokens": "7", "attempt": 1}
    aliased = {k.replace(".", "__"): v for k, v in aliased.items()}
    less = lambda *keys: {k: v for k, v in GOOD.items() if k not in keys}
    raw = json.loads(_body(_span(**GOOD)))
    odd = lambda change: json.dumps(change(json.loads(json.dumps(raw))) or raw)

    def attribute(extra):
        def change(x):
            x["resourceSpans"][0]["scopeSpans"][0]["spans"][0]["attributes"].append(extra)
            return x

        return odd(change)

    late = json.loads(_body(_span(**GOOD)))
    del late["resourceSpans"][0]["scopeSpans"][0]["spans"][0]["endTimeUnixNano"]
    nanos = json.loads(_body(_span(**GOOD)))
    nanos["resourceSpans"][0]["scopeSpans"][0]["spans"][0]["endTimeUnixNano"] = "1771200001000000999"
    deep = json.loads(_body(_span("other")))
    deep["resourceSpans"][0]["resource"] = {"attributes": [{"key": "user_prXmpt", "value": {"stringValue": "x"}}]}
    bodies = {
        "good": _body(_span(**GOOD), _span("other")),
        "aliases": _body(_span(**aliased)),
        "late": json.dumps(late),
        "nanos": json.dumps(nanos),
        "none": _body(_span("other")),
        "empty": json.dumps({"resourceSpans": []}),
        "said": _body(_span(**GOOD | {"request_id": '"key":"prompt"'})),
        "invalid": _body(_span(**GOOD), _span(**GOOD | {"ttft_ms": 600})),
        "no attempt": _body(_span(**less("attempt"))),
        "no output": _body(_span(**less("output_tokens"))),
        "no id": _body(_span(**GOOD | {"request_id": ""})),
        "twice": attribute({"key": "model", "value": {"stringValue": "again"}}),
        "two values": attribute({"key": "speed", "value": {"stringValue": "a", "intValue": "1"}}),
        "half": _body(_span(**GOOD | {"output_tokens": "1.5"})),
        "long": _body(_span(**GOOD | {"request_id": "r" * 257})),
        "secret": _body(_span(**GOOD | {"user_prompt": "hello"})),
        "escaped": json.dumps(deep).replace("prXmpt", "pr\\u006fmpt"),
        "unlisted": _body(_span(**GOOD | {"colour": "red"})),
        "third entry": attribute({"key": "speed", "value": {"stringValue": "a"}, "more": 1}),
        "no resources": json.dumps({"other": []}),
        "no scopes": json.dumps({"resourceSpans": [{}]}),
        "broken": "{",
        "many": _body(*[_span(**GOOD | {"request_id": f"r{i}"}) for i in range(33)]),
        "large": _body(_span(**GOOD)) + " " * (1 << 20),
    }
    df = spark.createDataFrame([(k, v, 77) for k, v in bodies.items()], "batch_id string, body string, received_us bigint")
    got = {r["batch_id"]: r for r in spans.decoded(df).collect()}
    assert sorted(got) == ["aliases", "good", "late", "nanos", "said"]
    assert (got["aliases"]["request_id"], got["aliases"]["model_raw"], got["aliases"]["output_total"], got["aliases"]["is_retry"]) == ("q", "m2", 7, False)
    good = got["good"]
    assert (good["observed_us"], good["range_start_us"], good["output_total"], good["is_retry"]) == (2 * SECOND, 1_500_000, 11, True)
    assert got["late"]["observed_us"] == 77
    assert got["nanos"]["observed_us"] == 1771200001000000
    codes = {r["batch_id"]: r["code"] for r in spans.rejections(df).collect()}
    fields = dict.fromkeys(["invalid", "no attempt", "no output", "no id", "twice", "two values", "half"], "INVALID_REQUEST_FIELDS")
    assert codes == fields | {
        "long": "REJECTED_FIELD_VALUE", "secret": "REJECTED_CONTENT_FIELD", "escaped": "REJECTED_CONTENT_FIELD", "unlisted": "REJECTED_UNALLOWLISTED_FIELD", "third entry": "REJECTED_UNALLOWLISTED_FIELD",
        "no resources": "INVALID_OTLP_JSON", "broken": "INVALID_OTLP_JSON", "no scopes": "UNSUPPORTED_REQUEST_TRACE", "many": "REJECTED_BATCH_SIZE", "large": "REJECTED_BATCH_SIZE",
    }


def test_rejections_read_attributes_once(spark):
    bodies = spark.createDataFrame([("b", "{}", 1)], "batch_id string, body string, received_us bigint")
    reads = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("variant_get")
    assert reads(spans.rejections(bodies)) <= reads(spans._judged(bodies))


def test_fields_are_read_before_the_shuffle(spark):
    """What is grouped by batch has numbers and texts, no VARIANT of a span."""
    bodies = spark.createDataFrame([("b", "{}", 1)], "batch_id string, body string, received_us bigint")
    for df in (spans._judged(bodies), spans.decoded(bodies)):
        plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        first = max(i for i, line in enumerate(plan) if "Window [" in line)
        assert not [line for line in plan[:first] if "variant_get" in line]


def test_packed_logs_read_like_files(spark, tmp_path):
    texts = {"rollout-2026-04-15T12-00-00-0190.jsonl": ['{"type":"world_state"}', "", "é not json", "x"], "b.jsonl": ["[1]", "y" * logs.LONGEST_LINE]}
    for log, lines in texts.items():
        (tmp_path / log).write_text("".join(f"{x}\n" for x in lines))
    rows = spark.createDataFrame([(log, 7 * i, x) for log, lines in texts.items() for i, x in reversed(list(enumerate(lines)))], "log string, place int, line string")
    logs.pack(rows, str(tmp_path / "packed"))
    told = lambda df: sorted(map(tuple, df.selectExpr("file", "ordinal", "end", "value", "to_json(json)", "too_long").collect()))
    assert told(logs.packed_lines(spark, str(tmp_path / "packed"))) == told(logs.lines(spark, str(tmp_path / "*.jsonl")))


def test_lines_are_parsed_once(spark, tmp_path):
    rows = spark.createDataFrame([("a.jsonl", 1, "{}")], "log string, place int, line string")
    logs.pack(rows, str(tmp_path / "packed"))
    read = logs.packed_lines(spark, str(tmp_path / "packed"))
    parses = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("parseJson")
    assert parses(logs.diagnostics(logs.rollout_lines(read))) == 1
    assert parses(logs.diagnostics(logs.transcript_lines(read))) == 1
    assert parses(logs.transcript_deltas(read)) == 3
