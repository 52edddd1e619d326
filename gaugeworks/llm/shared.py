"""Small helpers that the operators share: tables in the cluster's shared folder,
row keys, and Arrow slices of bounded size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python task handles at once (one longer text is taken alone).
SLICE_BYTES = 4 << 20
#: Places of a sieve.
SIEVE_BITS = 1 << 25


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session
    that runs on this machine alone (local tests) may do without that setting."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="gaugeworks-"))
    return sc.getCheckpointDir()


def reach_workers(spark: SparkSession) -> None:
    """Lets Python workers on this machine import this package from where the driver
    did; on a cluster it is shipped with --py-files."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH", "")]))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder as Parquet and read again: lineage ends
    here, and a lost executor costs only the tasks it was running."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where `df` has a column that is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session; shards are dealt to as many."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_key(text: str = "text") -> Column:
    """Hash of a text, which beside the id tells rows apart that share an id."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows of each batch whose `column` holds at most `limit` bytes (a
    single longer row stands alone), so memory doesn't follow the batch size."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        first, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += int(n)
        yield batch.slice(first)


def sieve(values: DataFrame) -> Broadcast:
    """A bitmap of fixed size over the one long column of `values`, sent to all tasks."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(SIEVE_BITS, bool)
        for b in batches:
            bits[b.column(0).drop_null().to_numpy() % SIEVE_BITS] = True
        yield pa.record_batch([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])

    bits = np.zeros(SIEVE_BITS // 8, np.uint8)
    for r in values.coalesce(8).mapInArrow(marked, "bits binary").toLocalIterator():
        bits |= np.frombuffer(r["bits"], np.uint8)
    return values.sparkSession.sparkContext.broadcast(bits.tobytes())


def sifted(bits: bytes, values: np.ndarray) -> np.ndarray:
    """Which of the values may be in the sieve: all that are, and few others."""
    at = values % SIEVE_BITS
    return (np.frombuffer(bits, np.uint8)[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)
