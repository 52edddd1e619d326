"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Sources in order of code points (null last) take the weights in turn. Their targets share
the words of all documents by weight, but none is above `most` times its source's words;
what is cut there is shared by the others by weight (water filling, exact).

A source's documents lie in classes of size, eight to a doubling. From the class of the
longest documents down, a class gets its part of what the source has still to take: whole
copies for all of its documents as often as they fit, and then a fixed number n of its
documents once more. n is the expected number, rounded at random, but neither above what
is left nor so small that the shorter documents couldn't give the rest (where no number is
both, the nearer one). What rounding
adds or leaves is made up for twice: within the class, documents' inclusion probabilities
are tilted by their size, so that the expected words stay right although n is whole; and
what a tilt can't take goes on to the next class. So words taken come near the target
also where few documents are very long.

Which n documents: Pareto's order, the n least of (u / (1 - u)) / (p / (1 - p)), with p
the inclusion probability and u a document's random number, from a digest of seed, id,
text and place among equal rows; reruns and other partitionings agree. The n-th least is
found without sorting a class in one task: counts of 4,096 cells tell the cell that holds
it, and only that cell's documents are ranked.

Defined results: a null text has no words, and documents without words and sources of
such have targets and words of zero; repeated rows are documents of their own; null ids
and sources count as any others; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.shared import materialize

WEIGHTS, MOST, SEED = (5, 2, 1), 3, 42
#: Size classes in a doubling; cells of a class's order; classes up to which their table is broadcast.
STEPS, CELLS, BROADCAST_CLASSES = 8, 4096, 50_000
_BLANKS = " \t\n\x0b\x0c\r"


def n_words(text: Column) -> Column:
    """Number of runs outside space and 0x09-0x0D; each is replaced by one character, so
    that no array of words is made of a long text."""
    bare = F.ltrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(_BLANKS))
    return F.length(F.regexp_replace(bare, "[^\\x20\\x09-\\x0D]++[\\x20\\x09-\\x0D]*+", "x")).cast("long")


def uniform(digest: Column) -> Column:
    """A number in (0, 1) of a hexadecimal digest's first 52 bits."""
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value reckoned once."""
    return F.get(F.transform(F.array(value), use), 0)


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, lot: digest), a row a document. Equal rows are counted first
    and numbered then, so they get different lots."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(text).alias("size"), F.md5(text).alias("copy"))
    each = rows.groupBy("doc_id", "source", "size", "copy").agg(F.count("*").alias("rows")).withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    name = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "copy", F.col("row").cast("string"))
    return materialize(each.select("doc_id", "source", "size", F.md5(name).alias("lot")), "mixing-documents")


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) of sized rows. Its windows run over one row a source."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    turn = F.get(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights))
    placed = sums.withColumn("place", F.row_number().over(by_name)).withColumn("weight", turn.cast("long"))
    placed = placed.withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    cap = most * F.col("source_size")
    filled = Window.orderBy(cap / F.col("weight"), "place")
    held = F.coalesce(F.sum(cap).over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    level = (F.col("total") - held) / F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing))
    leveled = placed.withColumn("level", level)
    below = F.when(F.col("level") * F.col("weight") < cap, F.col("level"))
    leveled = leveled.withColumn("level", F.first(below, ignorenulls=True).over(filled.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return leveled.select("source", "source_size", F.least(cap.cast("double"), F.coalesce(F.col("level") * F.col("weight"), cap.cast("double"))).alias("target"))


def size_class(size: Column) -> Column:
    """Classes from 0 on, STEPS to a doubling; null for no words."""
    bits = F.length(F.bin(size))
    step = F.floor(size * STEPS / F.pow(F.lit(2.0), bits - 1)) - STEPS
    return F.when(size > 0, bits * STEPS + step).cast("long")


def _allotted(classes: Column, target: Column, size: Column, most: int) -> Column:
    """For a source's `classes`, from the longest documents down: whole copies, n, and the
    tilted inclusion probability's height and slope."""
    d = lambda c: c.cast("double")

    def step(state: Column, c: Column) -> Column:
        n_docs, words, left = d(c["docs"]), d(c["words"]), state["left"]
        want = F.greatest(F.lit(0.0), F.least(left - target / size * c["rest"], most * words))

        def with_copies(x: Column) -> Column:
            copies, open_words = x["copies"], x["want"] - x["copies"] * words
            spare = left - copies * words
            drawn = F.floor(open_words * n_docs / words + c["u"])
            fitting = F.floor(spare * n_docs / words + 1e-6)
            needed = F.ceil((spare - most * c["rest"]) * n_docs / words - 1e-6)
            nearer = F.when(needed * words / n_docs - spare < spare - most * c["rest"] - fitting * words / n_docs, needed).otherwise(fitting)
            chosen = F.when(needed > fitting, nearer).otherwise(F.greatest(F.least(drawn, fitting), needed))
            n = F.greatest(F.lit(0).cast("long"), F.least(chosen, F.when(copies < most, c["docs"]).otherwise(0)))
            return _let(n, lambda n: with_number(x, open_words, n))

        def with_number(x: Column, open_words: Column, n: Column) -> Column:
            mean, height = words / n_docs, n / n_docs
            spread = c["squares"] / n_docs - mean * mean
            most_tilt = F.least(height, 1 - height) / F.greatest(c["longest"] - mean, mean - c["shortest"])
            fitted = (open_words - height * words) / (n_docs * spread)
            tilt = F.when((spread > 1e-9 * mean * mean) & (n > 0) & (n < c["docs"]), F.greatest(-most_tilt, F.least(most_tilt, fitted))).otherwise(0.0)
            return _let(tilt, lambda tilt: F.struct(
                (left - x["copies"] * words - height * words - tilt * n_docs * spread).alias("left"),
                F.struct(c["class"].alias("class"), c["docs"].alias("docs"), x["copies"].cast("long").alias("copies"), n.alias("n"), height.alias("height"), tilt.alias("tilt"), mean.alias("mean")).alias("made"),
            ))

        made = _let(want, lambda want: _let(F.struct(want.alias("want"), d(F.floor(want / words)).alias("copies")), with_copies))
        return _let(made, lambda m: F.struct(m["left"].alias("left"), F.concat(state["made"], F.array(m["made"])).alias("made")))

    kind = "array<struct<class:bigint,docs:bigint,copies:bigint,n:bigint,height:double,tilt:double,mean:double>>"
    return F.aggregate(classes, F.struct(target.alias("left"), F.array().cast(kind).alias("made")), step, lambda s: s["made"])


def allotments(rows: DataFrame, goals: DataFrame, most: int = MOST, seed: int = SEED) -> DataFrame:
    """(source, class, docs, copies, n, height, tilt, mean), a row a class of a source."""
    size = F.col("size").cast("decimal(38,0)")
    by = rows.where("class IS NOT NULL").groupBy("source", "class").agg(F.count("*").alias("docs"), F.sum("size").alias("words"), F.sum(size * size).cast("double").alias("squares"), F.min("size").alias("shortest"), F.max("size").alias("longest"))
    later = Window.partitionBy("source").orderBy(F.desc("class")).rowsBetween(1, Window.unboundedFollowing)
    by = by.withColumn("rest", F.coalesce(F.sum("words").over(later), F.lit(0).cast("long")))
    u = uniform(F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce("source", F.lit("null")), F.col("class").cast("string"))))
    fields = ["class", "docs", "words", "squares", "shortest", "longest", "rest"]
    listed = by.groupBy("source").agg(F.sort_array(F.collect_list(F.struct(*fields, u.alias("u"))), asc=False).alias("classes"))
    both = listed.join(goals.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    return both.select("source", F.inline(_allotted(F.col("classes"), F.col("target"), F.col("source_size"), most)))


def order(lot: Column, p: Column) -> Column:
    """Random odds divided by inclusion odds; null where the document can't be included."""
    return _let(uniform(lot), lambda u: F.when(p > 0, u * (1 - p) / ((1 - u) * p)))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken: words), a row a document."""
    rows = sized(docs, id_col, text_col, source_col, seed).withColumn("class", size_class(F.col("size")))
    goals = materialize(targets(rows, weights, most), "mixing-targets")
    classes = materialize(allotments(rows, goals, most, seed), "mixing-classes")
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_CLASSES else df
    names = lambda df: df.withColumnsRenamed({"source": "of", "class": "in"})
    same = F.col("source").eqNullSafe(F.col("of"))
    chance = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("height") + F.col("tilt") * (F.col("size") - F.col("mean"))))

    def ranked(rows: DataFrame, classes: DataFrame, how: str = "inner") -> DataFrame:
        both = rows.join(small(names(classes)), same & (F.col("class") == F.col("in")), how).drop("of", "in")
        return both.withColumn("rank", order(F.col("lot"), chance))

    drawn = ranked(rows, classes.where("n > 0 AND n < docs")).where("rank IS NOT NULL")
    drawn = drawn.select("source", "class", "n", "lot", "rank", F.floor(F.col("rank") / (1 + F.col("rank")) * CELLS).alias("cell"))
    counts = drawn.groupBy("source", "class", "n", "cell").agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.partitionBy("source", "class").orderBy("cell"))
    last = materialize(counts.withColumn("upto", upto).where("upto >= n AND upto - k < n").selectExpr("source AS of", "class AS in", "cell AS at", "n - (upto - k) AS take"), "mixing-cells")
    inside = drawn.join(small(last), same & (F.col("class") == F.col("in")) & (F.col("cell") == F.col("at")))
    place = F.row_number().over(Window.partitionBy("source", "class").orderBy("rank", "lot"))
    cut = materialize(inside.withColumn("place", place).where("place = take").select(F.col("source").alias("of"), F.col("class").alias("in"), F.col("rank").alias("cut"), F.col("lot").alias("cut_lot")), "mixing-cuts")

    whole = ranked(rows, classes, "left").join(small(cut), same & (F.col("class") == F.col("in")), "left").drop("of", "in")
    once = (F.col("n") == F.col("docs")) | F.coalesce((F.col("rank") < F.col("cut")) | ((F.col("rank") == F.col("cut")) & (F.col("lot") <= F.col("cut_lot"))), F.lit(False))
    copies = F.coalesce(F.col("copies") + once.cast("long"), F.lit(0).cast("long"))
    out = whole.join(small(goals.withColumnRenamed("source", "of")), same)
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
