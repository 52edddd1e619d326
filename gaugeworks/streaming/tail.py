"""A streaming source that tails append-only JSONL files by byte offset: a Python data
source whose offsets are, of each file, the bytes of whole lines read so far, a fingerprint
of what lies before them, a generation, and the size and time it was last seen with.

Only whole lines are read; a partial last line waits. A file that shrank, whose read part
has another fingerprint, or that has a new time but not a new size, was rewritten: it is
read anew, under the next generation. Files are cut into ranges that tasks read; a line
belongs to the range in which it starts.

With maxBytesPerTrigger a batch takes so many bytes (whole lines, at least one of some
file). A restarted stream asks for the end of its next batch before it tells where the last
ended, so what has been taken is then kept in progressPath too. Without that, rewritten
files are still seen after a restart, but generations may be numbered anew.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from gaugeworks.sources.stores import SAMPLE, fingerprint, opened, replace_text, text_of

#: Bytes that a task reads at once, and of a range.
BLOCK, RANGE = 4 << 20, 64 << 20


class FileRange(InputPartition):
    def __init__(self, path: str, start: int, stop: int, last: int, first: bool, generation: int):
        self.path, self.start, self.stop, self.last, self.first, self.generation = path, start, stop, last, first, generation


def line_end(f, low: int, high: int) -> int:
    """The end of the last whole line between two offsets, `low` if there is none."""
    while high > low:
        step = max(low, high - SAMPLE)
        f.seek(step)
        cut = f.read(high - step).rfind(b"\n")
        if cut >= 0:
            return step + cut + 1
        high = step
    return low


def next_line_end(f, low: int, high: int) -> int:
    """The end of the first whole line from an offset on, `low` if there is none before `high`."""
    f.seek(low)
    at = low
    while at < high:
        block = f.read(min(SAMPLE, high - at))
        cut = block.find(b"\n")
        if cut >= 0:
            return at + cut + 1
        at += len(block)
    return low


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.limit = int(options["maxBytesPerTrigger"]) if "maxBytesPerTrigger" in options else None
        self.progress, self.at = options.get("progressPath"), None
        if self.limit is not None and not self.progress:
            raise ValueError("maxBytesPerTrigger needs progressPath")

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def _known(self) -> dict:
        if self.at is None:
            self.at = json.loads((text_of(self.progress) if self.progress else None) or "{}")
        return self.at

    def latestOffset(self) -> dict:
        """Each file's [end of lines taken, fingerprint, generation, size, time]."""
        store, name = opened(self.root)
        known, out, left = self._known(), {}, self.limit
        for info in sorted(store.get_file_info(fs.FileSelector(name, recursive=True)), key=lambda i: i.path):
            if info.type != fs.FileType.File or not info.path.endswith(".jsonl"):
                continue
            stop, print_, generation, size, time = known.get(info.path, [0, None, 0, 0, 0])
            if info.path in known and (info.size, info.mtime_ns) == (size, time) and stop == size:
                out[info.path] = known[info.path]
                continue
            with store.open_input_file(info.path) as f:
                size_now = f.size()
                same_size = size_now == size and info.mtime_ns != time
                if info.path in known and (size_now < stop or same_size or fingerprint(f, stop) != print_):
                    stop, generation = 0, generation + 1
                end = size_now if left is None else min(size_now, stop + max(left, 0))
                end = line_end(f, stop, end)
                if end == stop and left is not None and left > 0:  # a line longer than what is left
                    end = next_line_end(f, stop, size_now)
                left = None if left is None else left - (end - stop)
                out[info.path] = [end, fingerprint(f, end), generation, size_now, info.mtime_ns]
        self.at = out
        self._keep()
        return {"files": json.dumps(out, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[FileRange]:
        old, new = json.loads(start["files"]), json.loads(end["files"])
        ranges = []
        for path, (stop, _, generation, size, time) in new.items():
            since, print_, known, size_then, time_then = old.get(path, [0, None, generation, size, time])
            if path in old and self._rewritten(path, since, print_, size_then, time_then, size, time):
                since = 0
                if generation == known:  # a restarted stream's first batch ends without knowing where it started
                    generation = known + 1
                    self.at = (self.at or {}) | {path: [stop, new[path][1], generation, size, time]}
                    self._keep()
            for a in range(since, stop, RANGE):
                ranges.append(FileRange(path, a, min(a + RANGE, stop), stop, a == since, generation))
        return ranges

    def _rewritten(self, path: str, since: int, print_: str | None, size_then: int, time_then: int, size: int, time: int) -> bool:
        if print_ is None or (size, time) == (size_then, time_then):
            return False
        store, _ = opened(self.root)
        with store.open_input_file(path) as f:
            return size < since or size == size_then or fingerprint(f, since) != print_

    def _keep(self) -> None:
        if self.progress:
            replace_text(self.progress, json.dumps(self.at, sort_keys=True))

    def read(self, partition: FileRange) -> Iterator[tuple]:
        p = partition
        store, _ = opened(self.root)
        with store.open_input_file(p.path) as f:
            at = p.start
            if not p.first:  # the line that the range starts in, unless it starts with the range
                at = next_line_end(f, p.start - 1, p.last)
                if at == p.start - 1:
                    return
            f.seek(at)
            read, held = at, b""
            while at < p.stop:
                block = f.read(min(BLOCK, p.last - read))
                if not block:
                    return
                read += len(block)
                *lines, held = (held + block).split(b"\n")
                for line in lines:
                    if at >= p.stop:
                        return
                    if line.strip():
                        try:
                            yield p.path, at, line.decode(), p.generation
                        except UnicodeDecodeError:
                            yield p.path, at, None, p.generation
                    at += len(line) + 1


class TailSource(DataSource):
    """(path, ordinal: byte offset of the line, value, generation: how often the file has been
    rewritten since the stream began). Options: path, maxBytesPerTrigger, progressPath."""

    @classmethod
    def name(cls) -> str:
        return "jsonl_tail"

    def schema(self) -> str:
        return "path string, ordinal bigint, value string, generation bigint"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes `spark.readStream.format("jsonl_tail")` known."""
    spark.dataSource.register(TailSource)
