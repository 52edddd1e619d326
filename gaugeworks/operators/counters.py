"""Deltas of cumulative counters, with resets, and the context that lines carry on."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def output_deltas(lines: DataFrame, keys: tuple[str, ...] = ("file",), order: str = "ordinal", total: str = "total") -> DataFrame:
    """`lines` with delta: growth of a cumulative total in order of lines. A drop means that
    the counter began anew: what came before it is given up, and the total at the drop
    counts whole. Lines without growth are left out."""
    own = Window.partitionBy(*keys).orderBy(order)
    last = F.lag(total, 1, 0).over(own)
    seen = lines.withColumn("__last", last).withColumn("__reset", F.when(F.col(total) < F.col("__last"), F.col(order)))
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kept = seen.withColumn("__from", F.max("__reset").over(whole)).where(F.col("__from").isNull() | (F.col(order) >= F.col("__from")))
    delta = F.when(F.col(order) == F.col("__from"), F.col(total)).otherwise(F.col(total) - F.col("__last"))
    return kept.withColumn("delta", delta).where("delta > 0").drop("__last", "__reset", "__from")


def message_part_deltas(lines: DataFrame, parts: list[str], keys: tuple[str, ...] = ("file", "message"), order: str = "ordinal", total: str = "total") -> DataFrame:
    """Deltas of an output total (delta) and of its token parts and itself as one of them
    (<part>_delta, output_delta), message by message: a part's base is its value at the last
    changed line that had all parts, 0 on a line that starts anew, and its delta is never
    negative; a line that lacks a part has null deltas and moves no base."""
    own = Window.partitionBy(*keys).orderBy(order)
    complete = F.lit(True)
    for p in parts:
        complete = complete & F.col(p).isNotNull()
    changed = lines.withColumn("__last", F.lag(total, 1, 0).over(own)).where(F.col(total) != F.col("__last"))
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    anew = F.col(total) < F.col("__last")
    base = F.last(F.when(complete, F.struct(*parts, F.col(total).alias("output"))), ignorenulls=True).over(before)
    told = changed.withColumn("__base", F.when(~anew, base)).withColumn("__reset", F.sum(F.when(anew, 1).otherwise(0)).over(own))
    kept = told.withColumn("__newest", F.max("__reset").over(Window.partitionBy(*keys))).where("__reset = __newest")
    delta = F.when(anew, F.col(total)).otherwise(F.col(total) - F.col("__last")).alias("delta")
    grown = lambda now, name: F.when(complete, F.greatest(F.lit(0), F.col(now) - F.coalesce(F.col(f"__base.{name}"), F.lit(0)))).alias(f"{name}_delta")
    return kept.select(*lines.columns, delta, *[grown(p, p) for p in parts], grown(total, "output"))


def validated_part_deltas(lines: DataFrame) -> DataFrame:
    """(file, ordinal, delta, input_uncached, cache_read, output_visible, reasoning): deltas of
    four counters whose bases move only on lines that grow the output and make sense
    (cached within input, reasoning within output, nothing shrinks, parts within their
    wholes); other growing lines have null parts. A drop of the output gives up what came before it
    in the file and is measured from 0. Each step needs the last valid line, so
    a file's lines go through one task in order, batch by batch with a few numbers kept."""
    counters, parts = ["input", "cached", "output", "reasoning"], ["input_uncached", "cache_read", "output_visible", "reasoning"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, mark, base, epoch = None, 0, (0, 0, 0, 0), 0
        for batch in batches:
            out = []
            for file, ordinal, *now in batch[["file", "ordinal", *counters]].itertuples(index=False):
                if file != name:
                    name, mark, base, epoch = file, 0, (0, 0, 0, 0), 0
                known = [None if pd.isna(x) else int(x) for x in now]
                total = known[2]
                if total is None or total == mark:
                    continue
                since = base
                if total < mark:
                    mark, since, epoch = 0, (0, 0, 0, 0), epoch + 1
                delta, mark = total - mark, total
                own: tuple = (None,) * 4
                if delta and None not in known:
                    d = [x - y for x, y in zip(known, since, strict=True)]
                    if known[1] <= known[0] and known[3] <= known[2] and min(d) >= 0 and d[1] <= d[0] and d[3] <= d[2]:
                        own, base = (d[0] - d[1], d[1], d[2] - d[3], d[3]), tuple(known)
                out.append((file, epoch, ordinal, delta, *own))
            told = pd.DataFrame(out, columns=["file", "epoch", "ordinal", "delta", *parts])
            yield told.astype({"epoch": "int64", "ordinal": "int64", "delta": "int64"} | dict.fromkeys(parts, "Int64"))

    schema = "file string, epoch bigint, ordinal bigint, delta bigint, " + ", ".join(f"{p} bigint" for p in parts)
    every = lines.repartition("file").sortWithinPartitions("file", "ordinal").mapInPandas(run, schema)
    newest = F.max("epoch").over(Window.partitionBy("file"))
    return every.withColumn("__newest", newest).where("epoch = __newest AND delta > 0").drop("epoch", "__newest")


def carried(lines: DataFrame, columns: list[str], keys: tuple[str, ...] = ("file",), order: str = "ordinal", defaults: dict[str, str] | None = None) -> DataFrame:
    """`lines` with the last value of each column seen so far in its file."""
    own = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    seen = {c: F.last(c, ignorenulls=True).over(own) for c in columns}
    return lines.withColumns({c: F.coalesce(v, F.lit((defaults or {}).get(c))) for c, v in seen.items()})


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key the first row, kept as one least struct so a key's size doesn't matter."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    best = rows.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("f"))
    return best.select(*keys, *[F.col(f"f.{c}").alias(c) for c in [*order, *rest]]).select(*rows.columns)


def session_fallback(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Session totals of the sessions that have no message totals anywhere."""
    return sessions.join(messages.select("session_id").distinct(), "session_id", "left_anti")
