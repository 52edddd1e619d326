"""The three trend charts as one result: output, burn and calls, each with its series over a
grid of buckets, its parts, its table, and what it says of itself (quality, state, coverage,
authority, freshness, reason).

History is read for what only it can tell: whether any measurement is in conflict, and the
newest time and authority of each source; both combine before their shuffles. Of the facts
in the charts' windows one authority selection serves output and burn, and one aggregate by
grouping sets gives their cells at both bucket widths. All else is made of those cells:
at most a few hundred buckets for each model.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.scalars import utc_text
from gaugeworks.operators import authority
from gaugeworks.operators.filters import MetricFilter, in_half_open_window
from gaugeworks.operators.health import action_for, label, relevant_to
from gaugeworks.operators.metrics import beside
from gaugeworks.operators.trends import OTHER, POINTS, SERIES, bucket_start, emphasis, first_calls, span
from gaugeworks.schema import SECOND, TOKEN_PARTS


@dataclass(frozen=True)
class ChartSize:
    window_s: int
    width_s: int


#: Windows and buckets of the charts in seconds.
SIZES = {"output": ChartSize(180, 5), "burn": ChartSize(600, 30), "calls": ChartSize(600, 30)}
CALLS = "calls"
MISSING = "—"
_FLAGS = ["estimated", "lacking", "derived"]


def _measures(p: str, capable: Column, amount: Column) -> list[Column]:
    """Mergeable figures of the capable facts, and the authority of all."""
    mine = lambda c: F.when(capable, c)
    has = lambda q: F.coalesce(F.bool_or(mine(F.col("quality") == q)), F.lit(False))
    return [
        F.count_if(capable).alias(f"{p}capable"), F.sum(mine(amount)).alias(f"{p}amount"), F.min(mine(F.col("model_display"))).alias(f"{p}display"), F.max(mine(F.col("observed_us"))).alias(f"{p}newest"),
        has("estimated").alias(f"{p}estimated"), has("unavailable").alias(f"{p}lacking"), has("derived").alias(f"{p}derived"), F.min(mine(F.col("quality"))).alias(f"{p}low_quality"), F.max(mine(F.col("quality"))).alias(f"{p}high_quality"),
        F.min(mine(F.col("authority"))).alias(f"{p}low"), F.max(mine(F.col("authority"))).alias(f"{p}high"), F.min("authority").alias(f"{p}any_low"), F.max("authority").alias(f"{p}any_high"),
        *[F.sum(mine(F.col(t))).alias(f"{p}{t}") for t in TOKEN_PARTS], *[F.count(mine(F.col(t))).alias(f"{p}n_{t}") for t in TOKEN_PARTS],
    ]


def cells(kept: DataFrame, picked: DataFrame, now_us: int, sizes: dict[str, ChartSize] = SIZES) -> DataFrame:
    """(chart, model_raw, bucket_us, figures) of the completed buckets that have facts:
    output and burn of the picked facts, by grouping sets; calls of the kept ones, each
    where it was first seen, under one name."""
    ends = {k: span(now_us, s.width_s, s.window_s)[:2] for k, s in sizes.items()}
    inside = {k: in_half_open_window(*e) for k, e in ends.items()}
    fine = F.col("quality") != "unavailable"
    bucket = {k: F.when(inside[k], bucket_start(sizes[k].width_s)) for k in sizes}
    rows = picked.where(inside["output"] | inside["burn"]).withColumns({"b_output": bucket["output"], "b_burn": bucket["burn"]})
    figures = _measures("o_", fine, F.col("output_tokens")) + _measures("b_", fine & F.col("burn_total").isNotNull(), F.col("burn_total"))
    sets = rows.groupingSets([["model_raw", "b_output"], ["model_raw", "b_burn"]], "model_raw", "b_output", "b_burn").agg(F.grouping("b_output").alias("g"), *figures)
    names = [c[2:] for c in sets.columns if c.startswith("o_")]
    pick = lambda chart, p, g: sets.where((F.col("g") == g) & F.col(f"b_{chart}").isNotNull()).select(F.lit(chart).alias("chart"), "model_raw", F.col(f"b_{chart}").alias("bucket_us"), *[F.col(f"{p}{n}").alias(n) for n in names])
    seen = first_calls(kept.where(inside["calls"] & fine)).withColumn("bucket_us", bucket["calls"])
    calls = seen.groupBy("bucket_us").agg(*_measures("", F.lit(True), F.lit(1).cast("bigint"))).select(F.lit("calls").alias("chart"), F.lit(CALLS).alias("model_raw"), "bucket_us", *names)
    return pick("output", "o_", 0).unionByName(pick("burn", "b_", 1)).unionByName(calls)


def series_of(cells: DataFrame, series: int = SERIES) -> DataFrame:
    """(chart, model_raw, identity, title, role, place): with more than `series` models all but
    the top series - 1 are Other; equal titles among those shown name the model too."""
    totals = cells.where("capable > 0").groupBy("chart", "model_raw").agg(F.sum("amount").alias("total"), F.min("display").alias("display"))
    by_total = Window.partitionBy("chart").orderBy(F.desc("total"), "display", "model_raw")
    placed = totals.withColumn("place", F.row_number().over(by_total)).withColumn("models", F.count("*").over(Window.partitionBy("chart")))
    hidden = (F.col("models") > series) & (F.col("place") >= series)
    shared = F.count_if(~hidden).over(Window.partitionBy("chart", "display")) > 1
    own = F.when(F.col("chart") == "calls", "Calls").when(shared, F.concat("display", F.lit(" ("), "model_raw", F.lit(")"))).otherwise(F.col("display"))
    return placed.select("chart", "model_raw", F.when(hidden, OTHER).otherwise(F.col("model_raw")).alias("identity"), F.when(hidden, OTHER).otherwise(own).alias("title"), F.when(hidden, "other").otherwise("model").alias("role"), F.least("place", F.lit(series)).alias("place"))


def _grid(spark, now_us: int, sizes: dict[str, ChartSize], points: int) -> DataFrame:
    """(chart, bucket_us, complete): the newest `points` buckets, the open one last."""
    rows = []
    for chart, s in sizes.items():
        start, end, last = span(now_us, s.width_s, s.window_s)
        rows.append((chart, max(start, last - (points - 1) * s.width_s * SECOND), last, s.width_s * SECOND, end))
    given = spark.createDataFrame(rows, "chart string, a bigint, z bigint, w bigint, closed bigint")
    return given.coalesce(1).select("chart", "closed", F.explode(F.sequence("a", "z", "w")).alias("bucket_us")).select("chart", "bucket_us", (F.col("bucket_us") < F.col("closed")).alias("complete"))


def _value(amount: str = "amount") -> Column:
    return F.col(amount).cast("double") / F.col("width_s") * F.when(F.col("chart") == "output", 1.0).otherwise(60.0)


def _authority(low: str, high: str) -> Column:
    return F.when(F.col(low) == F.col(high), F.col(low)).when(F.col(low).isNotNull(), "mixed")


def _standing(kept: DataFrame, health: DataFrame, chosen: MetricFilter) -> DataFrame:
    """One row of what history and sources tell all charts."""
    own = kept.groupBy("source_id").agg(F.max("observed_us").alias("newest"), F.min("authority").alias("low"), F.max("authority").alias("high"))
    mine = relevant_to(health, own, chosen)
    sick = mine.where("NOT is_healthy")
    first = sick.agg((F.count(F.lit(1)) > 0).alias("sick"), F.min(F.struct("ordinal", "reason_code", "action")).alias("first"))
    owned = sick.select("source_id").distinct().join(own.where("source_id <> 'unknown'"), "source_id").agg((F.count(F.lit(1)) > 0).alias("owned"), F.min("newest").alias("owned_newest"))
    every = own.agg((F.count(F.lit(1)) > 0).alias("has_facts"), F.max("newest").alias("facts_newest"), F.min("low").alias("facts_low"), F.max("high").alias("facts_high"))
    conflict = authority.has_conflict(kept)
    return beside(every, owned, first, conflict)


def trend_snapshot(facts: DataFrame, health: DataFrame, now_us: int, sizes: dict[str, ChartSize] = SIZES, chosen: MetricFilter | None = None, points: int = POINTS, series: int = SERIES) -> DataFrame:
    """One row a chart: chart, window_s, bucket_s, scope, samples, quality, state (null:
    live), coverage, authority, reason, action, updated_us, age_s, retained, and the arrays
    `series` (place, identity, title, role, emphasis, buckets), `part_series` (burn only) and
    `table` (bucket_us, cells, complete). No facts give three charts without series."""
    chosen = chosen or MetricFilter()
    kept = chosen.apply(facts)
    ends = [span(now_us, s.width_s, s.window_s)[:2] for s in sizes.values()]
    whole = in_half_open_window(min(a for a, _ in ends), max(z for _, z in ends))
    made = cells(kept, authority.select_window(kept, whole), now_us, sizes).coalesce(1)  # a row a bucket and model
    spark = facts.sparkSession

    names = spark.createDataFrame([(k, s.window_s, s.width_s) for k, s in sizes.items()], "chart string, window_s int, width_s int").coalesce(1)
    own = made.groupBy("chart").agg(
        F.sum("capable").alias("samples"), F.max("newest").alias("newest"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("any_low").alias("any_low"), F.max("any_high").alias("any_high"),
        (F.min("low_quality") != F.max("high_quality")).alias("mixed"), *[F.bool_or(c).alias(c) for c in _FLAGS],
    )
    each = [F.struct(F.lit(k).alias("chart"), F.count_if(in_half_open_window(*e)).alias("original"), F.min(F.when(in_half_open_window(*e), F.col("authority"))).alias("o_low"), F.max(F.when(in_half_open_window(*e), F.col("authority"))).alias("o_high")) for k, e in zip(sizes, ends, strict=True)]
    original = kept.where(whole).agg(F.array(*each).alias("a")).select(F.inline("a"))
    excluded = facts.limit(1).agg((F.count(F.lit(1)) > 0).alias("unfiltered"))
    told = names.join(own, "chart", "left").join(original, "chart").crossJoin(beside(_standing(kept, health, chosen), excluded))

    samples = F.coalesce("samples", F.lit(0).cast("bigint"))
    none, flag = samples == 0, lambda c: F.coalesce(F.col(c), F.lit(False))
    partial = F.col("conflict") | F.col("sick") | flag("mixed") | ((F.col("original") > 0) & (samples != F.col("original")))
    empty = F.when(~F.col("has_facts") & F.col("unfiltered") & F.lit(not chosen.is_all), "FILTER_EXCLUDES_OBSERVATIONS").otherwise("NO_OBSERVATIONS")
    reason = F.when(none, F.when(F.col("conflict"), "AUTHORITY_CONFLICT").otherwise(F.coalesce("first.reason_code", empty))).otherwise(F.col("first.reason_code"))
    action = F.when(F.col("first.reason_code").isNotNull(), F.coalesce("first.action", action_for(F.col("first.reason_code"))))
    quality = F.when(none, "unavailable").when(F.col("estimated"), "estimated").when(F.col("lacking"), "unavailable").otherwise("derived")
    state = F.when(F.col("owned"), "stale").when(none, F.when(F.col("sick"), "unavailable").when(F.col("has_facts"), "stale").otherwise("absent"))
    owner = F.coalesce(_authority("low", "high"), _authority("any_low", "any_high"), _authority("o_low", "o_high"), _authority("facts_low", "facts_high"), F.lit("unavailable"))
    updated = F.coalesce("owned_newest", "newest", "facts_newest")
    charts = told.select(
        "chart", "window_s", F.col("width_s").alias("bucket_s"), F.lit("all" if chosen.is_all else "selected").alias("scope"), samples.alias("samples"), quality.alias("quality"), state.alias("state"), F.when(partial, "partial").otherwise("complete").alias("coverage"),
        F.when(F.col("conflict"), "mixed").otherwise(owner).alias("authority"), reason.alias("reason"), F.coalesce(action, action_for(reason)).alias("action"), updated.alias("updated_us"), F.greatest(F.lit(0.0), (F.lit(now_us) - updated) / float(SECOND)).alias("age_s"),
        (F.col("owned") | (none & F.col("has_facts"))).alias("retained"), flag("estimated").alias("estimated"),
    )

    shown = series_of(made, series)
    merged = made.where("capable > 0").join(shown.select("chart", "model_raw", "identity"), ["chart", "model_raw"]).groupBy("chart", "identity", "bucket_us").agg(
        F.sum("amount").alias("amount"), *[F.when(F.sum(f"n_{t}") == F.sum("capable"), F.sum(t)).alias(t) for t in TOKEN_PARTS])
    grid = _grid(spark, now_us, sizes, points).join(names.select("chart", "width_s"), "chart")
    titles = shown.groupBy("chart", "identity", "title", "role").agg(F.min("place").alias("place"))
    full = titles.join(grid, "chart").join(merged, ["chart", "identity", "bucket_us"], "left")
    parts = F.when(F.col("chart") == "burn", F.when(F.col("amount").isNotNull(), F.struct(*TOKEN_PARTS)))
    bucket = lambda *more: F.sort_array(F.collect_list(F.struct("bucket_us", "complete", "amount", _value().alias("value"), *more))).alias("buckets")
    lines = full.groupBy("chart", "place", "identity", "title", "role").agg(bucket(parts.alias("parts")))
    lines = lines.join(charts.select("chart", "estimated", "coverage"), "chart").select("chart", F.struct("place", "identity", "title", "role", emphasis(F.col("role") == "other").alias("emphasis"), "buckets").alias("line"))
    lines = lines.groupBy("chart").agg(F.sort_array(F.collect_list("line")).alias("series"))

    sums = made.where("chart = 'burn'").groupBy("bucket_us").agg(*[F.sum(t).alias(t) for t in TOKEN_PARTS])
    each_part = grid.where("chart = 'burn'").join(sums, "bucket_us", "left").select("chart", "bucket_us", "complete", "width_s", F.inline(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(t).alias("part"), F.col(t).alias("amount")) for i, t in enumerate(TOKEN_PARTS)])))
    by_part = each_part.groupBy("chart", "place", "part").agg(bucket()).groupBy("chart").agg(F.sort_array(F.collect_list(F.struct("place", "part", "buckets"))).alias("part_series"))

    both = charts.join(lines, "chart", "left").join(by_part, "chart", "left")
    starts = grid.groupBy("chart").agg(F.sort_array(F.collect_list(F.struct("bucket_us", "complete"))).alias("starts"))
    columns = F.coalesce(F.transform("part_series", lambda s: s["buckets"]), F.transform("series", lambda s: F.transform(s["buckets"], lambda b: F.struct(b["bucket_us"].alias("bucket_us"), b["complete"].alias("complete"), b["amount"].alias("amount"), b["value"].alias("value")))), F.array())
    row = lambda t, i: F.struct(t["bucket_us"].alias("bucket_us"), F.transform(columns, lambda c: F.coalesce(F.get(c, i)["amount"].cast("string"), F.lit(MISSING))).alias("cells"), F.exists(columns, lambda c: F.get(c, i)["complete"]).alias("complete"))
    table = F.transform("starts", row)
    return both.join(starts, "chart").withColumn("table", table).drop("starts", "estimated").withColumn("series", F.coalesce("series", F.array()))


def chart_points(snapshot: DataFrame) -> DataFrame:
    """(chart, identity, title, role, emphasis, bucket_us, complete, amount, value, token
    parts, x): the series' buckets one a row; x places a bucket among all of its series, from 0 to 1."""
    lines = snapshot.select("chart", F.inline("series"))
    x = F.col("i") / F.greatest(F.size("buckets") - 1, F.lit(1))
    b = F.col("b")
    each = lines.select("chart", "identity", "title", "role", "emphasis", "buckets", F.posexplode("buckets").alias("i", "b"))
    return each.select("chart", "identity", "title", "role", "emphasis", b["bucket_us"].alias("bucket_us"), b["complete"].alias("complete"), b["amount"].alias("amount"), b["value"].alias("value"), *[b["parts"][t].alias(t) for t in TOKEN_PARTS], x.alias("x"))



#: How parts and emphases are called and drawn.
PART_TITLES = {"input_uncached": ("Input uncached", "■"), "cache_read": ("Cache read", "▣"), "cache_write": ("Cache write", "▤"), "output_visible": ("Output visible", "▲"), "reasoning": ("Reasoning", "●")}
EMPHASES = {"normal": ("Exact", "●"), "estimated": ("Estimated", "┄"), "partial": ("Partial", "╌"), "other": ("Other", "◇")}


def cell_narration(snapshot: DataFrame) -> DataFrame:
    """(chart, row, column, label, spoken): the texts of each cell of the charts' tables; a
    table without cells has one row, at 0 and 0, that says so."""
    shown = lambda pairs, key, i: F.try_element_at(F.create_map(*[F.lit(x) for k, v in pairs.items() for x in (k, v[i])]), key)
    part = lambda s: F.struct(shown(PART_TITLES, s["part"], 0).alias("title"), shown(PART_TITLES, s["part"], 0).alias("name"), shown(PART_TITLES, s["part"], 0).alias("text"), shown(PART_TITLES, s["part"], 1).alias("symbol"))
    line = lambda s: F.struct(s["title"].alias("title"), F.when(s["role"] == "other", "Other models").otherwise(s["identity"]).alias("name"), shown(EMPHASES, s["emphasis"], 0).alias("text"), shown(EMPHASES, s["emphasis"], 1).alias("symbol"))
    kind = "array<struct<title:string,name:string,text:string,symbol:string>>"
    columns = F.coalesce(F.transform("part_series", part).cast(kind), F.transform("series", line).cast(kind))
    told = F.concat_ws(", ", F.concat(F.lit("Quality "), label(F.col("quality"))), F.concat(F.lit("State "), F.coalesce(label(F.col("state")), F.lit("-"))), F.concat(F.lit("Coverage "), label(F.col("coverage"))))
    rows = snapshot.select("chart", "bucket_s", columns.alias("columns"), told.alias("told"), F.regexp_replace(told, ", ", ". ").alias("sentences"), F.posexplode("table").alias("row", "line"))
    each = rows.select("*", F.posexplode_outer("line.cells").alias("column", "value")).withColumn("c", F.get("columns", F.col("column")))
    start, end = utc_text(F.col("line.bucket_us")), utc_text(F.col("line.bucket_us") + F.col("bucket_s").cast("bigint") * SECOND)
    whole = F.when(F.col("line.complete"), "complete bucket").otherwise("open bucket")
    label_text = F.concat_ws(", ", "c.title", "c.name", F.concat(start, F.lit(" to "), end))
    spoken = F.concat_ws(", ", start, end, "c.title", "c.name", "value", "c.text", "c.symbol", whole, "told")
    none = F.concat(F.lit("No trend values. "), F.col("sentences"), F.lit("."))
    empty = F.col("column").isNull()
    kept = each.where(~empty | (F.col("row") == 0))
    return kept.select("chart", "row", F.coalesce("column", F.lit(0)).alias("column"), F.when(empty, none).otherwise(label_text).alias("label"), F.when(empty, none).otherwise(spoken).alias("spoken"))


def clamped(row: int, column: int, rows: int, columns: int) -> tuple[int, int]:
    """A cursor moved into a table; (0, 0) where the table has no cell."""
    if not rows or not columns:
        return 0, 0
    return min(max(row, 0), rows - 1), min(max(column, 0), columns - 1)
