"""Digests of accepted facts that don't depend on their order, merge, and tell where two
sets of facts differ: a two-level tree of ranges of identities and one root."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Leading hexadecimal digits of an identity's hash that name its range.
DIGITS = 2
#: Sums of digests are kept modulo this.
MODULUS = 1 << 100
_SUMS = ["sum_a", "sum_b"]


def canonical(columns: list[str]) -> Column:
    """name=value of the columns in order of name, one a line; of a null only the name. Line
    feeds and backslashes in values are escaped, so different rows have different texts."""
    shown = lambda c: F.regexp_replace(F.regexp_replace(F.col(c).cast("string"), "\\\\", "\\\\\\\\"), "\n", "\\\\n")
    return F.concat_ws("\n", *[F.coalesce(F.concat(F.lit(f"{c}="), shown(c)), F.lit(c)) for c in sorted(columns)])


def _number(digest: Column, start: int) -> Column:
    """20 hexadecimal digits of a digest as a number."""
    part = lambda at: F.conv(F.substring(digest, at, 10), 16, 10).cast("decimal(38,0)")
    return (part(start).cast("decimal(16,0)") * F.lit(1 << 40).cast("decimal(16,0)") + part(start + 10)).cast("decimal(38,0)")


def ranges(facts: DataFrame, id_col: str = "id", digits: int = DIGITS) -> DataFrame:
    """(range, rows, sum_a, sum_b): of each range of hashed identities the number of rows and
    two sums of parts of their SHA-256. Sums combine before the shuffle."""
    row = F.sha2(canonical(facts.columns), 256)
    own = facts.select(F.substring(F.sha2(F.coalesce(F.col(id_col).cast("string"), F.lit("")), 256), 1, digits).alias("range"), row.alias("row"))
    each = own.select("range", _number(F.col("row"), 1).alias("a"), _number(F.col("row"), 21).alias("b"))
    wrapped = lambda c: (F.sum(c) % F.lit(str(MODULUS)).cast("decimal(38,0)")).cast("decimal(38,0)")
    return each.groupBy("range").agg(F.count(F.lit(1)).alias("rows"), wrapped("a").alias("sum_a"), wrapped("b").alias("sum_b"))


def merged(*tables: DataFrame) -> DataFrame:
    """Range tables of disjoint sets of facts added up: the table of all of them."""
    wrapped = lambda c: (F.sum(c) % F.lit(str(MODULUS)).cast("decimal(38,0)")).cast("decimal(38,0)")
    return reduce(DataFrame.unionByName, tables).groupBy("range").agg(F.sum("rows").alias("rows"), *[wrapped(c).alias(c) for c in _SUMS])


def root(table: DataFrame, deletions: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row (rows, digest): a SHA-256 of the ranges' digests in order, and of the scopes
    (kind, value) deleted with them. At most 16 ** digits ranges meet in it."""
    line = F.concat_ws(":", "range", F.col("rows").cast("string"), *[F.col(c).cast("string") for c in _SUMS])
    scopes = "".join(f"\n-{k}:{v}" for k, v in sorted(deletions or []))
    listed = F.array_join(F.sort_array(F.collect_list(line)), "\n")
    return table.agg(F.coalesce(F.sum("rows"), F.lit(0).cast("bigint")).alias("rows"), F.sha2(F.concat(listed, F.lit(scopes)), 256).alias("digest"))


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """(range, rows_a, rows_b) of the ranges in which two tables differ, in order."""
    theirs = b.select(F.col("range").alias("of"), F.col("rows").alias("rows_b"), *[F.col(c).alias(f"{c}_b") for c in _SUMS])
    both = a.join(theirs, F.col("range") == F.col("of"), "full")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"{c}_b")) for c in ("rows", *_SUMS)])
    rows = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    return both.where(~same).select(F.coalesce("range", "of").alias("range"), rows("rows").alias("rows_a"), rows("rows_b").alias("rows_b")).orderBy("range")
