"""Small inputs written to the cluster's shared folder and read back by the sources."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


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


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody has used."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """`rows` dealt out by keys to as many tasks as the session shuffles to. For tasks that do
    far more for a row than its bytes tell: with no number given AQE makes one task of them,
    and by the bare keys the shuffle is left out where an earlier one, which AQE may coalesce,
    is by the same."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*keys))
