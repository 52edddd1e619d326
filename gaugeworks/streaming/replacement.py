"""Streams that take rows back: counters whose resets retract what a file gave before, and a
sink that applies the retractions and the new rows of a batch together.

Every row carries its file's epoch. A reset (a total below the last one, or a rewritten
file's next generation) starts a new epoch and sends a retraction of all older ones. The
sink drops what a batch's retractions name and what its rows replace, and keeps of each
file the newest epoch alone, so batches that are run again change nothing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gaugeworks.streaming.sinks import day_table, last_wins

INSERT, RETRACT = "insert", "retract"
OUTPUT = "op string, file string, epoch bigint, ordinal bigint, observed_us bigint, total bigint, delta bigint"
#: The provider that this kind of state needs: set it on the session before the stream starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Deltas(StatefulProcessor):
    """State of a file: generation, last ordinal and total, and epoch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("counter", "generation bigint, ordinal bigint, total bigint, epoch bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        """A micro-batch holds what the source admits of a file; its lines are put in order."""
        generation, last, total, epoch = self.state.get() if self.state.exists() else (0, -1, 0, 0)
        lines = pd.concat(list(rows)).sort_values(["generation", "ordinal"])
        out = []
        for now, ordinal, time, count in lines[["generation", "ordinal", "observed_us", "total"]].itertuples(index=False):
            if now < generation or (now == generation and ordinal <= last):
                continue
            if now > generation or count < total:
                generation, total, epoch = now, 0, epoch + 1
                out.append((RETRACT, key[0], epoch, ordinal, time, 0, 0))
            last = ordinal
            if count > total:
                out.append((INSERT, key[0], epoch, ordinal, time, count, count - total))
            total = count
        self.state.update((int(generation), int(last), int(total), int(epoch)))
        told = pd.DataFrame(out, columns=[c.split(" ")[0] for c in OUTPUT.split(", ")])
        yield told.astype({c: "int64" for c in ("epoch", "ordinal", "observed_us", "total", "delta")})

    def close(self) -> None:
        pass


def replacing_deltas(lines: DataFrame) -> DataFrame:
    """Inserts and retractions of a stream of lines (file, generation, ordinal, observed_us,
    total), in append mode. A retraction's epoch is the first that stays."""
    return lines.groupBy("file").transformWithStateInPandas(Deltas(), OUTPUT, "append", "none")


def apply_replacements(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes the inserts of a batch to a table by day, without
    what its retractions name; days in which a retracted file has rows are rewritten too."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        newest = new.groupBy("file").agg(F.max("epoch").alias("__epoch"))
        stays = lambda df: df.join(newest, "file", "left").where("__epoch IS NULL OR epoch >= __epoch").drop("__epoch")
        again = Window.partitionBy("file", "epoch", "ordinal").orderBy("observed_us")
        fresh = stays(new.where(F.col("op") == INSERT)).withColumn("__n", F.row_number().over(again)).where("__n = 1").drop("__n")
        return last_wins(stays(old), fresh, ["file", "epoch", "ordinal"])

    return day_table(path, merge, ["file"])


def current(rows: DataFrame) -> DataFrame:
    """What the table says: deltas of each file's newest epoch."""
    return rows.select("file", "epoch", "ordinal", "observed_us", "total", "delta")
