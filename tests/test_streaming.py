"""Streams give what the batch operators give, and replays change nothing."""

from pathlib import Path

from pyspark.sql import functions as F

from gaugeworks.operators.counters import output_deltas
from gaugeworks.streaming import counters, sinks, tail

LINE = "file string, ordinal bigint, total bigint"


def _run(stream, name, tmp_path, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"checkpoint-{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def test_deltas_equal_batch(spark, tmp_path):
    files = {"a": [5, 9, 9, 3, 4], "b": [1, 2, 30], "c": [8, 0, 0, 6]}
    parts = [[("a", 0, 5), ("b", 0, 1), ("a", 1, 9)], [("a", 2, 9), ("a", 3, 3), ("c", 0, 8), ("c", 1, 0)], [("a", 4, 4), ("b", 1, 2), ("b", 2, 30), ("c", 2, 0), ("c", 3, 6), ("a", 1, 9)]]
    src = tmp_path / "in"
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, LINE).coalesce(1).write.mode("append").parquet(str(src / f"p{i}"))
    stream = spark.readStream.schema(LINE).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(src))
    got = counters.newest_epochs(_run(counters.stream_deltas(stream), "deltas", tmp_path))
    lines = spark.createDataFrame([(f, i, t) for f, totals in files.items() for i, t in enumerate(totals)], LINE)
    want = output_deltas(lines)
    assert sorted(map(tuple, got.select("file", "ordinal", "delta").collect())) == sorted(map(tuple, want.select("file", "ordinal", "delta").collect()))


def test_upserts_survive_replay(spark, tmp_path):
    schema = "id string, observed_us bigint, output_tokens bigint"
    path = str(tmp_path / "facts")
    write = sinks.upsert_facts(path)
    batches = [[("a", 1, 10), ("b", 2, 20)], [("a", 1, 11), ("c", 86_400_000_001, 5)], [("c", 86_400_000_001, 6)]]
    for i, rows in [*enumerate(batches), (2, batches[2])]:
        write(spark.createDataFrame(rows, schema), i)
    got = spark.read.parquet(path).select("id", "output_tokens")
    assert sorted(map(tuple, got.collect())) == [("a", 11), ("b", 20), ("c", 6)]
    for _ in range(2):
        write(spark.createDataFrame([("c", 3, 7)], schema), 3)
    assert sorted(map(tuple, spark.read.parquet(path).select("id", "output_tokens").collect())) == [("a", 11), ("b", 20), ("c", 7)]


def test_performance_preference_in_a_stream(spark, tmp_path):
    schema = "agent string, request_id string, granularity string, observed_us bigint, duration_ms double, ttft_ms double, tier string"
    path = str(tmp_path / "perf")
    write = sinks.upsert_performance(path)
    for i, rows in enumerate([[("a", "r", "request", 1, 9.0, 1.0, "fallback")], [("a", "r", "request", 1, 20.0, 1.0, "enhanced")], [("a", "r", "request", 1, 1.0, 1.0, "fallback")]]):
        write(spark.createDataFrame(rows, schema), i)
    assert [r["duration_ms"] for r in spark.read.parquet(path).collect()] == [20.0]


def test_windows_close_by_watermark(spark, tmp_path):
    src = str(tmp_path / "win")
    rows = [(t * 1_000_000, "m", 10, None if t == 7 else 1) for t in (1, 2, 7, 11, 40)]
    spark.createDataFrame(rows, "observed_us bigint, model_raw string, output_tokens bigint, burn_total bigint").write.parquet(src)
    stream = spark.readStream.schema("observed_us bigint, model_raw string, output_tokens bigint, burn_total bigint").parquet(src)
    got = _run(sinks.windowed(stream, 5, 10), "windows", tmp_path)
    assert sorted((r["bucket_us"] // 1_000_000, r["output_tokens"], r["burn_total"]) for r in got.collect()) == [(0, 20, 2), (5, 10, None), (10, 10, 1)]


def test_tail_reads_whole_lines_once(spark, tmp_path):
    tail.register(spark)
    root = tmp_path / "logs"
    root.mkdir()
    (root / "a.jsonl").write_text("one\ntwo\npart")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "tail-checkpoint")

    def run():
        stream = spark.readStream.format("jsonl_tail").option("path", str(root)).load()
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return sorted((Path(r["path"]).name, r["ordinal"], r["value"]) for r in spark.read.parquet(out).collect())

    assert run() == [("a.jsonl", 0, "one"), ("a.jsonl", 4, "two")]
    with (root / "a.jsonl").open("a") as f:
        f.write("ial\n\n")
    (root / "b.jsonl").write_text("x\n")
    assert run() == [("a.jsonl", 0, "one"), ("a.jsonl", 4, "two"), ("a.jsonl", 8, "partial"), ("b.jsonl", 0, "x")]
    (root / "b.jsonl").write_text("new\n")
    assert ("b.jsonl", 0, "new") in run()
    assert spark.read.parquet(out).where(F.col("value").isNull()).count() == 0
