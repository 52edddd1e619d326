"""Discovery of log files below a root, by rules: a batch Python data source that lists the
folders of the root in tasks, and gives a row an entry with what is wrong with it.

Hidden entries are no entries. Links are not followed and give no file. Folders below the
depth are counted, not entered. Whether too many entries lie below a root, or two files
share an identity, only all rows together tell: `judged` adds that."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gaugeworks.sources import landing

#: Most entries below a root, levels that are entered, and files offered.
MOST_ENTRIES, DEPTH, MOST_FILES = 4_096, 12, 256
#: Entries of the root that a task judges and walks, and the number of tasks from which on
#: they are more.
PER_TASK, MOST_TASKS = 16, 64
SCHEMA = "root string, path string, level int, kind string, modified_us bigint, length bigint, code string"
#: Codes of entries; those of FATAL leave a root without files.
LINK, DEEP, ESCAPE, COLLISION, LIMIT = "SYMBOLIC_LINK", "TOO_DEEP", "PATH_ESCAPES_ROOT", "IDENTITY_COLLISION", "DISCOVERY_LIMIT_EXCEEDED"
FATAL = [ESCAPE, COLLISION, LIMIT]


class Share(InputPartition):
    """Of the root's entries those whose name's checksum leaves `own` when divided by `shares`."""

    def __init__(self, own: int, shares: int):
        self.own, self.shares = own, shares

    def has(self, name: str) -> bool:
        return not name.startswith(".") and zlib.crc32(os.fsencode(name)) % self.shares == self.own


def _local(root: str) -> str:
    return root.removeprefix("file://").removeprefix("file:") if root.startswith("file:") else root


def _entry(root: str, real: str, path: str, level: int, depth: int) -> tuple:
    """(root, path, level, kind, modified_us, length, code)."""
    link = os.path.islink(path)
    folder = not link and os.path.isdir(path)
    code = None if os.path.realpath(path).startswith(f"{real}/") else ESCAPE
    code = LINK if link else DEEP if level > depth else code
    told = os.lstat(path)
    return root, path, level, "link" if link else "folder" if folder else "file" if os.path.isfile(path) else "other", told.st_mtime_ns // 1000, told.st_size, code


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.depth = options["path"], int(options.get("depth", DEPTH))

    def partitions(self) -> list[Share]:
        """Shares of the root's entries, which are counted here and named in the tasks."""
        top = _local(self.root)
        if not os.path.isdir(top):
            return [Share(0, 1)]
        with os.scandir(top) as found:
            shares = min(MOST_TASKS, sum(1 for _ in found) // PER_TASK + 1)
        return [Share(i, shares) for i in range(shares)]

    def read(self, partition: Share) -> Iterator[tuple]:
        top = _local(self.root)
        if not os.path.isdir(top):
            return
        real = os.path.realpath(top)
        with os.scandir(top) as found:
            own = sorted(e.name for e in found if partition.has(e.name))
        for name in own:
            held = [(f"{top}/{name}", 1)]
            while held:
                path, level = held.pop()
                row = _entry(self.root, real, path, level, self.depth)
                yield row
                if row[3] == "folder" and row[6] is None:
                    with os.scandir(path) as found:
                        held += [(e.path, level + 1) for e in sorted(found, key=lambda e: e.name) if not e.name.startswith(".")]


class TreeSource(DataSource):
    """Options: path, depth."""

    @classmethod
    def name(cls) -> str:
        return "log_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def entries(spark: SparkSession, root: str, depth: int = DEPTH) -> DataFrame:
    """(root, path, level, kind, modified_us, length, code), a row an entry. The tree is walked
    once, here, and its entries written out: all that is judged of them is of one state."""
    spark.dataSource.register(TreeSource)
    path = landing.new_folder(spark, "entries")
    spark.read.format("log_tree").option("depth", str(depth)).load(root).write.parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


def judged(found: DataFrame, most_entries: int = MOST_ENTRIES) -> DataFrame:
    """Entries with `file`, the identity of those that are logs, and codes of what only all
    entries tell: files that share an identity, and roots with too many entries."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    log = (F.col("kind") == "file") & F.col("code").isNull() & name.endswith(".jsonl") & ~name.contains(".jsonl.") & (name != ".jsonl")
    named = found.withColumn("file", F.when(log, F.regexp_replace(name, r"\.jsonl$", "")))
    counts = named.groupBy("root").agg(F.count(F.lit(1)).alias("entries"))
    shared = named.where("file IS NOT NULL").groupBy("root", "file").agg(F.count(F.lit(1)).alias("paths")).where("paths > 1")
    logs = named.where("file IS NOT NULL").join(shared, ["root", "file"], "left")
    others = named.where("file IS NULL").withColumn("paths", F.lit(None).cast("bigint"))  # apart: as nulls they would meet in one task
    told = logs.unionByName(others).join(F.broadcast(counts), "root")  # a row a root
    code = F.when(F.col("entries") > most_entries, LIMIT).when(F.col("paths") > 1, COLLISION).otherwise(F.col("code"))
    return told.withColumn("code", code).select(*found.columns, "file")


def faults(told: DataFrame) -> DataFrame:
    """(root, code, n) of what is wrong below each root."""
    return told.where("code IS NOT NULL").groupBy("root", "code").agg(F.count(F.lit(1)).alias("n"))


def offered(told: DataFrame, newest: int = MOST_FILES) -> DataFrame:
    """(root, file, path, modified_us, length, truncated): the newest logs of each root without
    a fatal fault, in order of time, identity and path; `truncated` if there are more."""
    bad = told.where(F.col("code").isin(*FATAL)).select("root").distinct()
    logs = told.where("file IS NOT NULL AND code IS NULL").join(F.broadcast(bad), "root", "left_anti")
    place = F.row_number().over(Window.partitionBy("root").orderBy(F.desc("modified_us"), "file", "path"))
    counts = logs.groupBy("root").agg(F.count(F.lit(1)).alias("logs"))
    first = logs.withColumn("place", place).where(F.col("place") <= newest).join(F.broadcast(counts), "root")
    return first.select("root", "file", "path", "modified_us", "length", (F.col("logs") > newest).alias("truncated"))
