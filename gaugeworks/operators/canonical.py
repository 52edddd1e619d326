"""From raw observations to canonical facts, and what older rows lack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.operators.authority import burn_total
from gaugeworks.operators.counters import first_wins
from gaugeworks.schema import TOKEN_PARTS

#: What a schema version says about its rows (others: unknown), and the one
#: authority of the enhanced tier.
CHANNELS = {
    "codex-rollout-v1": "codexRollout",
    "claude-code-transcript-v1": "claudeTranscript",
    "synthetic-codex-token-count-v1": "synthetic",
    "synthetic-stable-call-v1": "synthetic",
}
SOURCES = {
    "codex-rollout-v1": "codex",
    "claude-code-transcript-v1": "claude-code",
    "synthetic-codex-token-count-v1": "synthetic-codex",
    "synthetic-stable-call-v1": "synthetic-codex",
}
ENHANCED = "claude-otel-request"


def looked_up(column: Column, table: dict[str, str], otherwise: str | Column) -> Column:
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(entries, column), otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def tier_of(authority: Column) -> Column:
    return F.when(authority == ENHANCED, "enhanced").otherwise("fallback")


def total_or_sum(total: str = "burn_total") -> Column:
    """The stated total, or the sum of the parts that are there."""
    return F.coalesce(F.col(total), burn_total())


def canonical(observations: DataFrame, order: list[str]) -> DataFrame:
    """A measured fact per observation id, the first in `order` of those that repeat. The
    authority is the schema version's name; an empty call id is none; without a range the
    fact stands for itself."""
    one = first_wins(observations, ["id"], order)
    authority = F.coalesce("authority", "schema_version") if "authority" in observations.columns else F.col("schema_version")
    call = F.when(F.col("call_id") != "", F.col("call_id"))
    capable = F.lit(False)
    for p in TOKEN_PARTS:
        capable = capable | F.col(p).isNotNull()
    return one.withColumns(
        {
            "quality": F.lit("measured"), "authority": authority, "tier": tier_of(authority), "channel": looked_up(F.col("schema_version"), CHANNELS, "unknown"),
            "call_id": call, "capability": F.when(call.isNotNull(), "available").otherwise("unavailable"), "burn_total": F.when(capable | F.col("burn_total").isNotNull(), total_or_sum()),
        }
    )


def backfilled(facts: DataFrame) -> DataFrame:
    """Rows written before sources were recorded get theirs from the schema version."""
    missing = F.col("source_id").isNull() | (F.col("source_id") == "")
    return facts.withColumn("source_id", F.when(missing, looked_up(F.col("schema_version"), SOURCES, "unknown")).otherwise(F.col("source_id")))


def upgraded(rows: DataFrame, schema: str) -> DataFrame:
    """Rows of an older schema with the columns that it lacks as nulls, in its order."""
    from pyspark.sql.types import StructType

    wanted = StructType.fromDDL(schema)
    have = set(rows.columns)
    return rows.select(*[F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted])


def without_scope(facts: DataFrame, schema_version: str | None = None, id_prefix: str | None = None) -> DataFrame:
    """Facts outside a rebuilt scope: a whole source or the rows of one file."""
    gone = F.lit(False)
    if schema_version is not None:
        gone = gone | (F.col("schema_version") == schema_version)
    if id_prefix is not None:
        gone = gone | F.col("id").startswith(id_prefix)
    return facts.where(~F.coalesce(gone, F.lit(False)))
