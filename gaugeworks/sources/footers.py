"""Capacity and time bounds of Parquet tables from their footers: a batch Python data source
that gives a row a file and reads no data page. Files are listed once and dealt to tasks,
which read the footers."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gaugeworks.sources.stores import opened

#: Files a task reads the footers of; files up to which the driver itself asks them for a time.
PER_TASK, FEW = 64, 16
_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


def data_files(uri: str) -> list[str]:
    """The Parquet files of a table, without hidden ones."""
    store, name = opened(uri)
    if store.get_file_info(name).type == fs.FileType.File:
        return [name]
    found = store.get_file_info(fs.FileSelector(name, recursive=True))
    shown = lambda p: not any(x.startswith(("_", ".")) for x in p[len(name) :].split("/"))
    return sorted(i.path for i in found if i.type == fs.FileType.File and i.path.endswith(".parquet") and shown(i.path))


def _micros(value: object) -> int | None:
    """A bound of a column: times as epoch microseconds, whole numbers as they are."""
    if isinstance(value, dt.datetime):
        aware = value if value.tzinfo else value.replace(tzinfo=dt.timezone.utc)
        return (aware - _EPOCH) // dt.timedelta(microseconds=1)
    return value if isinstance(value, int) and not isinstance(value, bool) else None


def footer(store: fs.FileSystem, path: str, column: str | None) -> tuple:
    """(path, rows, bytes, row_groups, low, high, known) of one file: `known` tells whether
    every row group with values has bounds of the column."""
    with store.open_input_file(path) as f:
        size, meta = f.size(), pq.ParquetFile(f).metadata
    lows, highs, known = [], [], column is not None
    for g in range(meta.num_row_groups if column else 0):
        group = meta.row_group(g)
        chunk = next((c for c in map(group.column, range(group.num_columns)) if c.path_in_schema == column), None)
        stats = chunk.statistics if chunk else None
        if not group.num_rows or (stats and stats.has_null_count and stats.null_count == group.num_rows):
            continue
        low, high = (_micros(stats.min), _micros(stats.max)) if stats and stats.has_min_max else (None, None)
        known = known and low is not None and high is not None
        lows.append(low)
        highs.append(high)
    known = known and None not in lows + highs
    return path, meta.num_rows, size, meta.num_row_groups, min(lows) if known and lows else None, max(highs) if known and highs else None, known


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class FooterReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.column = options["path"], options.get("column")

    def partitions(self) -> list[Files]:
        paths = data_files(self.root)
        return [Files(paths[i : i + PER_TASK]) for i in range(0, len(paths), PER_TASK)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = opened(self.root)
        for path in partition.paths:
            yield footer(store, path, self.column)


class FooterSource(DataSource):
    """Options: path, column (whose bounds are wanted)."""

    @classmethod
    def name(cls) -> str:
        return "parquet_footers"

    def schema(self) -> str:
        return "path string, rows bigint, bytes bigint, row_groups int, low bigint, high bigint, known boolean"

    def reader(self, schema) -> FooterReader:
        return FooterReader(self.options)


def footers(spark: SparkSession, path: str, column: str | None = None) -> DataFrame:
    """(path, rows, bytes, row_groups, low, high, known), a row a file."""
    spark.dataSource.register(FooterSource)
    read = spark.read.format("parquet_footers")
    return (read.option("column", column) if column else read).load(path)


def capacity(spark: SparkSession, path: str, column: str | None = None) -> DataFrame:
    """One row: files, rows, bytes, and the column's bounds where every file knows them."""
    known = F.bool_and("known")
    return footers(spark, path, column).agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.when(known, F.min("low")).alias("low"), F.when(known, F.max("high")).alias("high"))


def newest(spark: SparkSession, path: str, column: str) -> int | None:
    """The column's greatest value (times in epoch microseconds), from footers; where those
    don't know it, or the store can't be opened but by Spark, from the rows. Null without
    values. A few files' footers are read here, those of more files in tasks."""
    try:
        files = data_files(path)
        if len(files) <= FEW:
            store, _ = opened(path)
            told = [footer(store, f, column) for f in files]
            if all(t[6] for t in told):
                return max((t[5] for t in told if t[5] is not None), default=None)
        else:
            r = footers(spark, path, column).agg(F.bool_and("known").alias("known"), F.max("high").alias("high")).first()
            if r["known"]:
                return r["high"]
    except (OSError, ValueError):  # not a store of this library's: Spark's own reader may know it
        pass
    rows = spark.read.parquet(path)
    value = F.unix_micros(F.col(column).cast("timestamp")) if rows.schema[column].dataType.typeName().startswith("timestamp") else F.col(column)
    return rows.agg(F.max(value)).first()[0]
