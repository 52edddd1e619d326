"""Streaming deltas of cumulative counters, keyed by file.

State is the last ordinal, the last total and an epoch that a reset starts anew. A stream
can't take rows back, so deltas carry their epoch and readers keep the newest one of each
file (`newest_epochs`), which gives what the batch operator gives. Lines that come again
(an ordinal not above the last) are dropped, whatever order files arrive in."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "file string, epoch bigint, ordinal bigint, total bigint, delta bigint"
STATE = "ordinal bigint, total bigint, epoch bigint"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, total, epoch = state.get if state.exists else (-1, 0, 0)
    lines = pd.concat(list(batches)).sort_values("ordinal")
    out = []
    for ordinal, now in lines[["ordinal", "total"]].itertuples(index=False):
        if ordinal <= last:
            continue
        last = ordinal
        if now < total:
            total, epoch = 0, epoch + 1
        if now > total:
            out.append((key[0], epoch, ordinal, now, now - total))
        total = now
    state.update((int(last), int(total), int(epoch)))
    told = pd.DataFrame(out, columns=["file", "epoch", "ordinal", "total", "delta"])
    yield told.astype({"epoch": "int64", "ordinal": "int64", "total": "int64", "delta": "int64"})


def stream_deltas(lines: DataFrame) -> DataFrame:
    """Deltas of a stream of lines (file, ordinal, total), in append mode. A micro-batch
    holds a file's new lines only, and those are what one call sees."""
    return lines.groupBy("file").applyInPandasWithState(_advance, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def newest_epochs(deltas: DataFrame) -> DataFrame:
    newest = F.max("epoch").over(Window.partitionBy("file"))
    return deltas.withColumn("__newest", newest).where("epoch = __newest").drop("epoch", "__newest")
