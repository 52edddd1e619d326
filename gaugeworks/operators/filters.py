"""Filters: two-axis selection, closed and half-open windows, last-good windows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.schema import SECOND


@dataclass(frozen=True)
class MetricFilter:
    """Agents and models to keep: any of an axis, both axes together; an empty axis is no
    constraint. Models go by their raw name."""

    agents: frozenset[str] = field(default_factory=frozenset)
    models: frozenset[str] = field(default_factory=frozenset)

    @property
    def is_all(self) -> bool:
        return not (self.agents or self.models)

    def toggle(self, axis: str, value: str) -> MetricFilter:
        """Adds or takes away a value; without the last one the axis is free again."""
        return MetricFilter(**{"agents": self.agents, "models": self.models} | {axis: getattr(self, axis) ^ {value}})

    def select_all(self, axis: str) -> MetricFilter:
        return MetricFilter(**{"agents": self.agents, "models": self.models} | {axis: frozenset()})

    def apply(self, facts: DataFrame) -> DataFrame:
        for column, values in (("agent", self.agents), ("model_raw", self.models)):
            if values:
                facts = facts.where(F.col(column).isin(*sorted(values)))
        return facts


def in_closed_window(now_us: Column | int, seconds: int, time: str = "observed_us") -> Column:
    """now - W <= t <= now: what a live figure looks at."""
    now = now_us if isinstance(now_us, Column) else F.lit(now_us)
    return F.col(time).between(now - seconds * SECOND, now)


def in_half_open_window(start_us: Column | int, end_us: Column | int, time: str = "observed_us") -> Column:
    """start <= t < end: what buckets and rollups look at."""
    return (F.col(time) >= start_us) & (F.col(time) < end_us)


def after_cutoff(cutoff_us: int | None, time: str = "observed_us") -> Column:
    """Facts strictly after a reset; no reset keeps all."""
    return F.lit(True) if cutoff_us is None else F.col(time) > cutoff_us


def without_prefix(prefix: str, column: str = "id") -> Column:
    return ~F.col(column).startswith(prefix)


#: Keys up to which their newest times are broadcast.
BROADCAST_KEYS = 100_000


def with_newest(facts: DataFrame, keys: list[str] | None = None, name: str = "newest_us") -> DataFrame:
    """`facts` with the newest time of all rows, or of their keys' rows: one row a key, sent to
    the rows where there are few by count, so that a hot key stays where it is, else joined."""
    newest = facts.groupBy(*(keys or [])).agg(F.max("observed_us").alias(name))
    if not keys:
        return facts.crossJoin(F.broadcast(newest))
    few = newest.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return facts.join(F.broadcast(newest) if few else newest, keys)


def last_good(facts: DataFrame, now_us: int, seconds: int) -> DataFrame:
    """Rows of the window up to now, or, if it has none, of the window up to the newest row,
    with `retained` telling which."""
    rows = with_newest(facts.where(F.col("observed_us") <= now_us))
    current = F.col("newest_us") >= now_us - seconds * SECOND
    end = F.when(current, now_us).otherwise(F.col("newest_us"))
    return rows.where(in_closed_window(end, seconds)).withColumn("retained", ~current).drop("newest_us")
