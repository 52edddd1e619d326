"""Document fingerprints by winnowing, in DataFrame functions only.

A text falls into units: its words, and the characters of words of more than LONG_WORD
characters (scripts without blanks, encoded data), so that every text has runs to share.
Each unit is hashed once; the hash of a run of `k` units combines theirs. Of every `window` consecutive
hashes the least is chosen, of equal ones the rightmost. Hash and place are packed in
one number whose order is (hash, later place first), so a window's choice is a plain
minimum. Any run of window + k - 1 words that two texts share yields a fingerprint in
both, and the places kept with the hashes show where.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.quality import words
from gaugeworks.llm.shared import fresh

K, WINDOW = 5, 8
#: Characters up to which a word is one unit.
LONG_WORD = 20
#: Bits of a place and of a hash in the packed number.
PLACE, HASH = 31, 32
_LAST = (1 << PLACE) - 1


def units(text: Column) -> Column:
    """Words, long ones as their characters."""
    own = words(text)
    single = F.transform(own, lambda w: F.when(F.length(w) > LONG_WORD, F.split(w, "")).otherwise(F.array(w)))
    return F.when(F.exists(own, lambda w: F.length(w) > LONG_WORD), F.flatten(single)).otherwise(own)


def packed_hashes(unit_hashes: str, k: int) -> Column:
    """The packed number of every run of k units; a text of fewer units has one run."""
    n = F.size(unit_hashes)
    at = F.when(n >= 1, F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    run = lambda i: F.xxhash64(*[F.get(unit_hashes, i + (j - 1)) for j in range(k)])
    return F.transform(at, lambda i: F.shiftleft(F.shiftrightunsigned(run(i), 64 - HASH), PLACE).bitwiseOR(F.lit(_LAST) - i + 1))


def choose(packed_col: str, window: int) -> Column:
    """The packed numbers that are least in some window (in the only one, where there are
    fewer), in order of place and each once."""
    n = F.size(packed_col)
    at = F.when(n >= 1, F.sequence(F.lit(1), F.greatest(n - window + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.array_min(F.slice(packed_col, i, window))))


def hash_of(packed: Column) -> Column:
    return F.shiftright(packed, PLACE)


def place_of(packed: Column) -> Column:
    """The first unit of the run, counted from 0."""
    return F.lit(_LAST) - packed.bitwiseAND(F.lit(_LAST))


def with_fingerprints(df: DataFrame, texts: dict[str, str], k: int = K, window: int = WINDOW) -> DataFrame:
    """`df` with a column of packed numbers for each text column (result name -> text).
    A null text counts as empty and has none."""
    kept = df.columns
    names = {out: fresh(df, f"h_{out}")[0] for out in texts}
    hashed = df.select("*", *[F.transform(units(F.coalesce(F.col(t), F.lit(""))), lambda u: F.xxhash64(u)).alias(names[out]) for out, t in texts.items()])
    packed = hashed.select(*kept, *[packed_hashes(names[out], k).alias(names[out]) for out in texts])
    return packed.select(*kept, *[choose(names[out], window).alias(out) for out in texts])


def written(packed_col: str) -> Column:
    """hash@place of every fingerprint, hashes in hexadecimal, comma-joined."""
    return F.array_join(F.transform(packed_col, lambda x: F.concat(F.lpad(F.lower(F.hex(hash_of(x))), 8, "0"), F.lit("@"), place_of(x).cast("string"))), ",")


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two columns of hashes; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    all_of = F.size(a) + F.size(b) - both
    return F.when(all_of > 0, both / all_of).otherwise(1.0)


def hashes(packed_col: str) -> Column:
    return F.array_distinct(F.transform(packed_col, hash_of))


def _above(cuts: list, value: Column) -> Column:
    """How many of the sorted cuts are no less than a value, looked up in two steps: first
    among every so manieth, then among those that follow it."""
    if not cuts:
        return F.lit(0)
    step = max(1, math.isqrt(len(cuts)))
    parts = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    below = F.size(F.filter(F.array(*[F.lit(p[-1]) for p in parts]), lambda c: c < value))
    own = F.get(F.array(*[F.array(*map(F.lit, p)) for p in parts]), below)
    return F.lit(len(cuts)) - F.least(below * step, F.lit(len(cuts))) - F.coalesce(F.size(F.filter(own, lambda c: c < value)), F.lit(0))


def with_next(docs: DataFrame, id_col: str, columns: list[str], rows: int = 1_000, added: Callable[[DataFrame], DataFrame] = lambda df: df, carried: tuple[str, ...] = ()) -> DataFrame:
    """`added(docs)` with next_<column> (also of the `carried` columns that it adds): of the
    row that follows in descending order of id (nulls last, equal ids in order of the
    columns), after the last one the first.

    Ids are cut into ranges of about `rows` rows by approximate quantiles, 10,000 ranges at
    most; a range also gets a copy of the row that follows its last one, and a window reads
    the followers off. Rows that share one id, or have none, are in one range."""
    parts = max(1, min(10_000, docs.count() // rows))
    found = docs.select(F.percentile_approx(id_col, [i / parts for i in range(1, parts)], 10 * parts)).first()[0] if parts > 1 else None
    cuts = sorted(set(found or []))
    above = _above(cuts, F.col(id_col))
    part = F.when(F.isnull(id_col), len(cuts) + 1).otherwise(above)
    heads = sorted(docs.groupBy(part.alias("__part")).agg(F.max(id_col)).collect())
    dealt = added(docs).withColumn("__part", part).withColumn("__copy", F.lit(False))
    before = [(head[1], heads[i - 1][0]) for i, head in enumerate(heads)]
    head_ids = docs.sparkSession.createDataFrame(before, "__head long, __to int")
    tie = Window.partitionBy("__to").orderBy(*columns)
    copies = docs.join(F.broadcast(head_ids), F.col(id_col).eqNullSafe(F.col("__head"))).withColumn("__n", F.row_number().over(tie)).where("__n = 1")
    copies = added(copies.select(*docs.columns, F.col("__to").alias("__part"))).withColumn("__copy", F.lit(True))
    both = dealt.unionByName(copies)
    seen = [*columns, *carried]
    order = Window.partitionBy("__part").orderBy("__copy", F.col(id_col).desc_nulls_last(), *columns)
    followed = both.withColumn("__next", F.lead(F.struct(*seen)).over(order)).where(~F.col("__copy"))
    return followed.drop("__part", "__copy").select("*", *[F.col(f"__next.{c}").alias(f"next_{c}") for c in seen]).drop("__next")


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_chars, edited, fp, edited_fp, near_edited, near_next): each text's
    fingerprints, those of the text whose last half is replaced by the start of the next
    document, and how alike they are. A null text is empty, an empty text has no
    fingerprints, and two texts without any are alike; a single row follows itself. Rows that
    repeat follow each other, null ids come last, an empty table gives no rows, and other
    columns are not read."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = with_next(narrow, "doc_id", ["text"], added=lambda df: with_fingerprints(df, {"fp": "text"}, k, window), carried=("fp",))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = rows.withColumn("edited", F.concat(F.substring("text", 1, n - half), F.substring("next_text", F.lit(1), half)))
    both = with_fingerprints(edited.withColumn("n_chars", n.cast("long")), {"edited_fp": "edited"}, k, window)
    told = both.select("doc_id", "n_chars", "edited", "fp", "edited_fp", *[hashes(c).alias(f"__{c}") for c in ("fp", "edited_fp", "next_fp")])
    return told.select("doc_id", "n_chars", "edited", "fp", "edited_fp", likeness("__fp", "__edited_fp").alias("near_edited"), likeness("__fp", "__next_fp").alias("near_next"))
