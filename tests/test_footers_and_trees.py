"""Footers, discovery by rules, line numbers without moving text, and digests of facts."""

import datetime as dt
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import digest
from gaugeworks.sources import discovery, footers, landing, logs


def _write(path, times, **more):
    pq.write_table(pa.table({"t": pa.array(times, pa.timestamp("us")), "n": list(range(len(times)))}), path, **more)


def test_capacity(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    base = 1_704_067_200_000_000
    _write(tmp_path / "a.parquet", [at(5), None, at(9)], row_group_size=1)
    _write(tmp_path / "b.parquet", [at(-3)])
    _write(tmp_path / "c.parquet", [None, None])
    _write(tmp_path / "d.parquet", [])
    (tmp_path / "_logs").mkdir()
    _write(tmp_path / "_logs/e.parquet", [at(99)])
    r = footers.capacity(spark, str(tmp_path), "t").first()
    size = sum(os.path.getsize(tmp_path / f"{x}.parquet") for x in "abcd")
    assert tuple(r) == (4, 6, size, base - 3_000_000, base + 9_000_000)
    assert footers.newest(spark, str(tmp_path), "t") == base + 9_000_000
    assert footers.capacity(spark, str(tmp_path)).select("files", "rows", "low").first() == (4, 6, None)


@pytest.mark.parametrize("few", [16, 0])
def test_newest_without_bounds(spark, tmp_path, monkeypatch, few):
    """Where a footer has no bounds, rows are read; a table without values has no newest."""
    monkeypatch.setattr(footers, "FEW", few)
    _write(tmp_path / "a.parquet", [dt.datetime(2024, 1, 1)])
    assert footers.newest(spark, str(tmp_path), "t") == 1_704_067_200_000_000
    _write(tmp_path / "b.parquet", [dt.datetime(2024, 1, 2)], write_statistics=False)
    assert not footers.footers(spark, str(tmp_path), "t").agg(F.bool_and("known")).first()[0]
    assert footers.newest(spark, str(tmp_path), "t") == 1_704_153_600_000_000
    (tmp_path / "none").mkdir()
    _write(tmp_path / "none/a.parquet", [None])
    assert footers.newest(spark, str(tmp_path / "none"), "t") is None


def _tree(top, *names):
    for n in names:
        (top / n).parent.mkdir(parents=True, exist_ok=True)
        (top / n).write_text("x\n")


def _codes(spark, top, **more):
    told = discovery.judged(discovery.entries(spark, str(top)), **more)
    return told, {(r["path"].removeprefix(f"{top}/"), r["code"]) for r in told.collect() if r["code"]}


def test_discovery(spark, tmp_path):
    top, outside = tmp_path / "root", tmp_path / "outside"
    _tree(top, "a.jsonl", "p/b.jsonl", "p/q/c.jsonl", "p/.hidden/d.jsonl", ".e.jsonl", "p/f.jsonl.old", "g.txt", ".jsonl")
    _tree(outside, "z.jsonl")
    _tree(top, "/".join(f"l{i}" for i in range(1, 12)) + "/in.jsonl", "/".join(f"m{i}" for i in range(1, 15)) + "/out.jsonl")
    os.symlink(outside / "z.jsonl", top / "z.jsonl")
    os.symlink(outside, top / "p/folder")
    for k, n in enumerate(["a.jsonl", "p/b.jsonl", "p/q/c.jsonl"]):
        os.utime(top / n, (100 + k // 2, 100 + k // 2))
    told, codes = _codes(spark, top)
    assert codes == {("z.jsonl", "SYMBOLIC_LINK"), ("p/folder", "SYMBOLIC_LINK"), ("/".join(f"m{i}" for i in range(1, 14)), "TOO_DEEP")}
    got = discovery.offered(told, 3).orderBy(F.desc("modified_us"), "file").collect()
    assert [(r["file"], r["truncated"]) for r in got] == [("in", True), ("c", True), ("a", True)]
    assert {(r["code"], r["n"]) for r in discovery.faults(told).collect()} == {("SYMBOLIC_LINK", 2), ("TOO_DEEP", 1)}


def test_fatal_faults(spark, tmp_path, monkeypatch):
    _tree(tmp_path, "one/a.jsonl", "two/a.jsonl", "two/b.jsonl")
    told, codes = _codes(spark, tmp_path)
    assert codes == {("one/a.jsonl", "IDENTITY_COLLISION"), ("two/a.jsonl", "IDENTITY_COLLISION")}
    assert discovery.offered(told).count() == 0
    _, codes = _codes(spark, tmp_path / "two", most_entries=1)
    assert {c for _, c in codes} == {"DISCOVERY_LIMIT_EXCEEDED"}
    assert _codes(spark, tmp_path / "two", most_entries=2)[1] == set()
    assert _codes(spark, tmp_path / "nowhere")[0].count() == 0
    real = os.path.realpath
    monkeypatch.setattr(os.path, "realpath", lambda p: "/elsewhere/b.jsonl" if p.endswith("two/b.jsonl") else real(p))
    assert discovery._entry(str(tmp_path), real(tmp_path), f"{tmp_path}/two/b.jsonl", 2, 12)[-1] == "PATH_ESCAPES_ROOT"


def test_trees_are_walked_once(spark, tmp_path):
    """What is judged of a tree is of one state, however often it is used."""
    _tree(tmp_path, "one/a.jsonl", "two/b.jsonl")
    told = discovery.judged(discovery.entries(spark, str(tmp_path)))
    _tree(tmp_path, "three/a.jsonl")
    assert discovery.faults(told).count() == 0
    assert {r["file"] for r in discovery.offered(told).collect()} == {"a", "b"}


def test_shares_of_a_root(tmp_path):
    """Each entry of a wide root is in one of a bounded number of shares."""
    names = {f"d{i}" for i in range(1500)} | {f"f{i}" for i in range(500)}
    for n in names:
        (tmp_path / n).mkdir() if n[0] == "d" else (tmp_path / n).touch()
    reader = discovery.TreeReader({"path": str(tmp_path)})
    shares = [[r[1].rpartition("/")[2] for r in reader.read(p)] for p in reader.partitions()]
    assert len(shares) == discovery.MOST_TASKS
    assert max(map(len, shares)) < 100
    assert sorted(n for s in shares for n in s) == sorted(names)
    assert [r[-1] for p in reader.partitions() for r in reader.read(p)] == [None] * len(names)


def test_work_is_dealt_out(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    told = landing.dealt(spark.range(50).distinct(), "id").mapInArrow(lambda batches: batches, "id bigint")
    assert told.rdd.getNumPartitions() == n


def test_line_numbers_over_blocks(spark, tmp_path):
    """Files of several blocks, two files in a task, blank and partial lines, long lines."""
    texts = {"a": "".join(f"line {i} {'é' * (i % 7)}\n" for i in range(400)) + "partial", "b": "\n\nx\n  \ny\n", "c": "z" * 3000 + "\nq\n", "d": ""}
    for n, t in texts.items():
        (tmp_path / f"{n}.jsonl").write_text(t)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
        read = logs.lines(spark, str(tmp_path))
        got = sorted((r["file"], r["ordinal"], r["end"], r["value"]) for r in read.collect())
        plan = read._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = []
    for n, t in texts.items():
        at = 0
        for i, line in enumerate(t.split("\n")[:-1]):
            at += len(line.encode()) + 1
            if line.strip():
                want.append((n, i, at, line))
    assert got == sorted(want)
    assert "broadcast" in plan.lower()


def test_no_text_is_shuffled(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("some text\n" * 100)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
        read = logs.lines(spark, str(tmp_path))
        assert len(read.collect()) == 100
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    plan = read._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    main, sent = plan.split("BroadcastExchange", 1)[0], plan.split("BroadcastExchange", 1)[-1]
    assert "BroadcastHashJoin" in main
    assert "value" not in "".join(x for x in sent.splitlines() if "Exchange" in x)
    assert main.count("ShuffleQueryStage") == 0


@pytest.fixture(scope="module")
def some(spark):
    rows = [(f"i{i}", i % 5, None if i % 3 else f"t\\{i}\n=") for i in range(200)]
    return spark.createDataFrame(rows, "id string, n int, t string")


def test_digests_merge_in_any_order(some):
    whole = digest.root(digest.ranges(some)).first()
    parts = digest.merged(digest.ranges(some.where("n < 2").orderBy("t")), digest.ranges(some.where("n >= 2").repartition(3)))
    assert digest.root(parts).first() == whole
    assert whole["rows"] == 200
    assert digest.root(digest.ranges(some), [("id-prefix", "x")]).first() != whole
    assert digest.root(digest.ranges(some), [("b", "y"), ("a", "x")]).first() == digest.root(digest.ranges(some), [("a", "x"), ("b", "y")]).first()
    assert digest.root(digest.ranges(some.where("false"))).first()["rows"] == 0


@pytest.mark.parametrize("change", ["n + 1", "n"])
def test_differences(some, change):
    other = some.withColumn("n", F.when(F.col("id") == "i7", F.expr(change)).otherwise(F.col("n")).cast("int"))
    found = digest.differing(digest.ranges(some), digest.ranges(other)).collect()
    assert len(found) == (change != "n")
    missing = digest.differing(digest.ranges(some), digest.ranges(some.where("id <> 'i7'"))).collect()
    assert [(r["rows_a"] - r["rows_b"]) for r in missing] == [1]


def test_texts_of_rows_differ(spark):
    """Nulls, empties, and values that look like other columns are told apart."""
    rows = [(None, "x"), ("", "x"), ("a\nb=x", "y"), ("a", "b=x"), ("\\n", "q"), ("\n", "q")]
    texts = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(digest.canonical(["b", "a"])).collect()]
    assert len(set(texts)) == len(rows)
