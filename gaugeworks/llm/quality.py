"""Risk-controlled quality rules, in DataFrame functions only.

Each rule compares one figure of a document with a cutoff. Labelled documents that pass
the base checks set the cutoffs, stratum by stratum; copies of one text count once. They
are split by the digest of their text. The smaller part chooses: of each rule the cutoff
with the best balance (share of low-quality labels rejected less `cost` times the share of
good ones, above zero; of equals the loosest), and the order of the rules, best balance
first. The larger part, which has had no say in that, tests the rules together: first the
best alone, then the two best, and so on, each set once, until an exact binomial test
fails to show at level delta / (number of strata) that the set rejects less than alpha of
the stratum's good documents. The last set that passed is in force. Testing in a fixed
order needs no correction within a stratum, and the strata share delta (Bonferroni), so
with probability 1 - delta no stratum loses more than alpha of its good documents. With
four strata a set that rejects no good document is admitted from 86 good ones on in the
testing part; a stratum with fewer loses nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.shared import materialize

ALPHA, DELTA, COST = 0.05, 0.05, 10.0
#: figure -> candidate cutoffs; a document is rejected if the figure is above the cutoff.
RULES: dict[str, list[float]] = {
    "symbols_per_word": [0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 1.0],
    "duplicate_line_share": [0.1, 0.2, 0.3, 0.4, 0.5, 0.7],
    "repeated_word_share": [0.05, 0.1, 0.15, 0.2, 0.25],
    "mean_word_length": [6.5, 7.0, 7.5, 8.0, 9.0, 10.0, 12.0],
}
#: Of the 16 first digits of a text's digest, those whose documents choose; the others test.
CHOOSING = 5
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Strata up to which the table of cutoffs is broadcast; beyond, it is joined.
BROADCAST_STRATA = 10_000
_BLANKS = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Words of a text: runs outside space and 0x09-0x0D."""
    bare = F.trim(text, F.lit(_BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+"))


def figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, `keep` columns, stratum, copy: digest of the text, n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words): one row per document. A null text counts as empty. Words that lie
    in an 8-word window found twice or more in their text are counted in place: the
    windows' hashes are sorted with their positions only where any hash repeats."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    stratum = F.col(stratum_col).cast("string") if stratum_col else F.lit(None).cast("string")
    lines = F.filter(F.split(F.translate(text, "\t\x0b\x0c\r ", ""), "\n"), lambda x: x != "")
    exact = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(_BLANKS)) != "")
    first = docs.select(
        F.col(id_col).alias("doc_id"), *keep, stratum.alias("stratum"), F.md5(text).alias("copy"), words(text).alias("words"),
        F.length(F.translate(text, _BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        F.when(F.instr(text, "\n") > 0, F.size(exact) - F.size(F.array_distinct(exact))).otherwise(0).cast("long").alias("n_dup_lines"),
    )
    n = F.size("words")
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    base = ["doc_id", *keep, "stratum", "copy", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    hashed = first.select(*base, n.cast("long").alias("n_words"), windows.alias("h"))
    pairs = F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    ordered = hashed.select(*base, "n_words", pairs.alias("s"))
    again = F.filter("s", lambda x, i: (F.get("s", i - 1)["h"] == x["h"]) | (F.get("s", i + 1)["h"] == x["h"]))
    places = F.sort_array(F.transform(again, lambda x: x["i"]))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("covered"))
    covered = F.aggregate(places, start, lambda a, p: F.struct(p.alias("last"), (a["covered"] + F.least(F.lit(WINDOW), p - a["last"])).alias("covered")), lambda a: a["covered"])
    return ordered.select(*base, "n_words", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def rates() -> dict[str, Column]:
    """The figure of each rule; every one is 0 without words or lines."""
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return {
        "symbols_per_word": over("n_symbols", "n_words"),
        "duplicate_line_share": over("n_dup_lines", "n_lines"),
        "repeated_word_share": over("n_repeat_words", "n_words"),
        "mean_word_length": over("word_chars", "n_words"),
    }


def log_binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """ln P(X <= k) for X ~ Binomial(n, p), summed term by term in logarithms; where k is
    no less than n p it is given as 0, an upper bound that no test admits."""
    odds = math.log(p / (1 - p))
    first = n * math.log1p(-p)
    start = F.struct(first.alias("term"), first.alias("top"), F.lit(1.0).alias("rest"))

    def add(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + 1) / i) + odds
        top = F.greatest(a["top"], term)
        return F.struct(term.alias("term"), top.alias("top"), (a["rest"] * F.exp(a["top"] - top) + F.exp(term - top)).alias("rest"))

    terms = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    summed = F.aggregate(terms, start, add, lambda a: a["top"] + F.log(a["rest"]))
    return F.when(k < n * p, summed).otherwise(0.0)


def cutoffs(rows: DataFrame, labels: DataFrame, rules: dict[str, list[float]] = RULES, alpha: float = ALPHA, delta: float = DELTA, cost: float = COST) -> DataFrame:
    """(stratum, cutoff_<rule>...) from figures and labels (doc_id, quality 0/1). An id or a
    text with several labels counts as low quality if any says so; null ids and labels count
    nothing. One row per stratum with a rule in force; of the other rules it has null."""
    told = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rate, names = rates(), list(rules)
    seen = rows.where(~base_failed()).select("doc_id", "stratum", "copy", *[rate[r].alias(r) for r in rules]).join(told, "doc_id")
    seen = materialize(seen.groupBy("stratum", "copy").agg(F.min("quality").alias("quality"), *[F.max(r).alias(r) for r in rules]), "quality-labelled")
    chooses = F.conv(F.substring("copy", 1, 1), 16, 10).cast("int") < CHOOSING

    grid = [(r, c) for r, cs in rules.items() for c in cs]
    counts = seen.where(chooses).groupBy("stratum").agg(
        F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"),
        *[F.count_if((F.col(r) > c) & (F.col("quality") == q)).alias(f"q{q}_{i}") for i, (r, c) in enumerate(grid) for q in (0, 1)],
    )
    tried = F.array(*[F.struct(F.lit(names.index(r)).alias("rule"), F.lit(float(c)).alias("cutoff"), F.col(f"q0_{i}").alias("k0"), F.col(f"q1_{i}").alias("k1")) for i, (r, c) in enumerate(grid)])
    each = counts.select("stratum", "good", "bad", F.inline(tried))
    balance = F.col("k0") / F.greatest("bad", F.lit(1)) - cost * F.col("k1") / F.greatest("good", F.lit(1))
    best = each.withColumn("balance", balance).where("balance > 0").groupBy("stratum", "rule").agg(F.max(F.struct("balance", "cutoff")).alias("best"))
    picked = best.groupBy("stratum").agg(F.sort_array(F.collect_list(F.struct((-F.col("best.balance")).alias("order"), "rule", F.col("best.cutoff").alias("cutoff")))).alias("picked"))
    picked = materialize(picked.withColumnRenamed("stratum", "of"), "quality-picked")

    strata = picked.count()
    level = math.log(delta / max(1, strata))
    value = F.array(*[F.col(r).cast("double") for r in names])
    good = seen.where(~chooses & (F.col("quality") == 1)).select("stratum", value.alias("value"))
    over = F.transform("picked", lambda x: F.get("value", x["rule"]) > x["cutoff"])
    meets = good.join(F.broadcast(picked) if strata <= BROADCAST_STRATA else picked, good.stratum.eqNullSafe(picked.of)).withColumn("first", F.array_position(over, True))
    tested = meets.groupBy("stratum").agg(F.count("*").alias("n"), F.first("picked").alias("picked"), *[F.count_if((F.col("first") > 0) & (F.col("first") <= j + 1)).alias(f"k_{j}") for j in range(len(names))])
    passed = F.array(*[log_binomial_cdf(F.col(f"k_{j}"), F.col("n"), alpha) <= level for j in range(len(names))])
    until = F.array_position(passed, False)
    held = tested.select("stratum", F.slice("picked", F.lit(1), F.when(until == 0, len(names)).otherwise(until - 1).cast("int")).alias("held"))
    cutoff = lambda i: F.get(F.filter("held", lambda x: x["rule"] == i), F.lit(0))["cutoff"]
    return held.where(F.size("held") > 0).select("stratum", *[cutoff(i).alias(f"cutoff_{r}") for i, r in enumerate(names)])


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang", keep: tuple[str, ...] = (), **settings) -> DataFrame:
    """The figures of every document with base_failed, rejected_by (rules, sorted as in
    RULES) and kept. Rows are kept apart even where ids repeat; a null stratum is a
    stratum of its own; an empty table, or one without labels, has base checks only."""
    rows = materialize(figures(docs, id_col, text_col, stratum_col, keep), "quality")
    rules = settings.get("rules", RULES)
    found = materialize(cutoffs(rows, labels, **settings), "quality-cutoffs").withColumnRenamed("stratum", "of")
    small = found.count() <= BROADCAST_STRATA
    both = rows.join(F.broadcast(found) if small else found, rows.stratum.eqNullSafe(found.of), "left")
    rate = rates()
    by = F.filter(F.array(*[F.when(rate[r] > F.col(f"cutoff_{r}"), F.lit(r)) for r in rules]), lambda x: x.isNotNull())
    return both.withColumn("base_failed", base_failed()).withColumn("rejected_by", by).withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop("of", *[f"cutoff_{r}" for r in rules])
