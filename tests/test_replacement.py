"""The tailing source's fingerprints, ranges and admission, and streams that take rows back."""

import json
import os

import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import scalars
from gaugeworks.streaming import replacement, tail


def _reader(root, **options):
    return tail.TailReader({"path": str(root), **options})


def _lines(reader, start, end):
    return sorted((r[0].rsplit("/", 1)[-1], *r[1:]) for p in reader.partitions(start, end) for r in reader.read(p))


def test_fingerprint(spark, tmp_path):
    """The first 64 KiB, and up to 64 KiB before the offset that don't overlap them."""
    import hashlib

    data = bytes(i * 7 % 251 for i in range(200_000))
    (tmp_path / "f").write_bytes(data)
    with (tmp_path / "f").open("rb") as f:
        for offset in (0, 10, 65_536, 65_537, 100_000, 131_072, 180_000):
            want = data[: min(offset, 65_536)] + (data[max(65_536, offset - 65_536) : offset] if offset > 65_536 else b"")
            assert tail.fingerprint(f, offset) == hashlib.sha256(want).hexdigest()
            shown = spark.createDataFrame([(data,)], "b binary").select(scalars.prefix_fingerprint(F.col("b"), F.lit(offset)))
            assert shown.first()[0] == hashlib.sha256(want).hexdigest()


@pytest.mark.parametrize("first", ["same first line", "x" * 5_000])
def test_rewritten_files(tmp_path, first):
    """A file that is replaced is read anew, also where its first line, however long, and its
    length stay."""
    a = tmp_path / "a.jsonl"
    a.write_text(f"{first}\none\n")
    reader = _reader(tmp_path)
    o1 = reader.latestOffset()
    assert [r[2] for r in _lines(reader, reader.initialOffset(), o1)] == [first, "one"]
    a.write_text(f"{first}\ntwo\nthree\n")
    o2 = reader.latestOffset()
    assert [(r[2], r[3]) for r in _lines(reader, o1, o2)] == [(first, 1), ("two", 1), ("three", 1)]
    assert reader.latestOffset() == o2
    with a.open("a") as f:
        f.write("four\npart")
    o3 = reader.latestOffset()
    assert [(r[2], r[3]) for r in _lines(reader, o2, o3)] == [("four", 1)]
    a.write_text("short\n")
    o4 = reader.latestOffset()
    assert [(r[2], r[3]) for r in _lines(reader, o3, o4)] == [("short", 2)]
    os.utime(a, (1, 1))
    assert [(r[2], r[3]) for r in _lines(reader, o4, reader.latestOffset())] == [("short", 3)]


def test_rewritten_between_runs(tmp_path):
    """A restarted stream sees it where it plans the batch; with a progress path the
    generation goes on from where it was."""
    a = tmp_path / "a.jsonl"
    a.write_text("one\ntwo\n")
    o1 = _reader(tmp_path).latestOffset()
    a.write_text("new\nlines\n")
    reader = _reader(tmp_path)
    o2 = reader.latestOffset()
    assert [(r[2], r[3]) for r in _lines(reader, o1, o2)] == [("new", 1), ("lines", 1)]
    assert [(r[2], r[3]) for r in _lines(_reader(tmp_path), o1, o2)] == [("new", 1), ("lines", 1)]  # run again
    with a.open("a") as f:
        f.write("more\n")
    assert [(r[2], r[3]) for r in _lines(reader, o2, reader.latestOffset())] == [("more", 1)]
    options = {"progressPath": str(tmp_path / "at")}
    o3 = _reader(tmp_path, **options).latestOffset()
    a.write_text("third\n")
    reader = _reader(tmp_path, **options)
    assert [(r[2], r[3]) for r in _lines(reader, o3, reader.latestOffset())] == [("third", 1)]
    assert _reader(tmp_path, **options).latestOffset()["files"].count(", 1, ") == 1


@pytest.mark.parametrize("size", [1, 2, 3, 5, 7, 11, 1000])
def test_ranges(tmp_path, monkeypatch, size):
    """However a file is cut, each line is read once, with its offset."""
    monkeypatch.setattr(tail, "RANGE", size)
    monkeypatch.setattr(tail, "BLOCK", 4)
    text = "ab\n\ncdefghij\nk\n \nlmn\n"
    (tmp_path / "a.jsonl").write_text(text + "rest")
    reader = _reader(tmp_path)
    got = _lines(reader, reader.initialOffset(), reader.latestOffset())
    assert [(r[1], r[2]) for r in got] == [(0, "ab"), (4, "cdefghij"), (13, "k"), (17, "lmn")]


def test_admission(tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "a.jsonl").write_text("".join(f"line{i}\n" for i in range(10)))
    (root / "b.jsonl").write_text("y" * 50 + "\nz\n")
    options = {"maxBytesPerTrigger": "20", "progressPath": str(tmp_path / "progress/at.json")}
    with pytest.raises(ValueError, match="progressPath"):
        _reader(root, maxBytesPerTrigger="20")
    at, seen, steps = _reader(root, **options).initialOffset(), [], 0
    while True:
        reader = _reader(root, **options)  # a restart before each batch
        end = reader.latestOffset()
        if end == at:
            break
        batch = _lines(reader, at, end)
        assert sum(len(r[2]) + 1 for r in batch) <= 20 + 51
        seen, at, steps = seen + batch, end, steps + 1
    assert [r[2] for r in sorted(seen)] == [f"line{i}" for i in range(10)] + ["y" * 50, "z"]
    assert steps >= 4
    assert set(json.loads(at["files"])) == {str(root / "a.jsonl"), str(root / "b.jsonl")}


LINES = "file string, generation bigint, ordinal bigint, observed_us bigint, total bigint"


def test_resets_between_crashes(spark, tmp_path):
    """A file is reset twice and replayed while the sink fails twice; the table ends as if
    nothing had failed, with the last epoch alone."""
    spark.conf.set(*replacement.STATE_STORE)
    day = 86_400_000_000
    parts = [
        [("a", 0, 0, 5, 10), ("a", 0, 1, day + 5, 30), ("b", 0, 0, 7, 4)],
        [("a", 0, 2, day + 6, 20), ("a", 0, 3, day + 7, 25)],  # a smaller total: reset
        [("a", 0, 2, day + 6, 20), ("a", 1, 0, 9, 3), ("a", 1, 1, 10, 8), ("b", 0, 1, 8, 9)],  # replayed, then rewritten
        [("b", 0, 1, 8, 9), ("c", 0, 0, 1, 0)],
    ]
    src, table, checkpoint = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "checkpoint")
    write, failures = replacement.apply_replacements(table), {1: 1, 2: 1}

    def sink(batch, batch_id):
        write(batch, batch_id)
        if failures.get(batch_id):
            failures[batch_id] -= 1
            raise RuntimeError("crash after the write")

    def run():
        stream = spark.readStream.schema(LINES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(src))
        replacement.replacing_deltas(stream).writeStream.foreachBatch(sink).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    crashes = 0
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, LINES).coalesce(1).write.parquet(str(src / f"p{i}"))
        for _ in range(3):
            try:
                run()
                break
            except Exception:
                crashes += 1
    assert crashes == 2
    got = replacement.current(spark.read.parquet(table)).orderBy("file", "ordinal").collect()
    assert [(r["file"], r["epoch"], r["ordinal"], r["delta"]) for r in got] == [("a", 2, 0, 3), ("a", 2, 1, 5), ("b", 0, 0, 4), ("b", 0, 1, 5)]
    assert spark.read.parquet(table).where(F.col("op") != replacement.INSERT).count() == 0
