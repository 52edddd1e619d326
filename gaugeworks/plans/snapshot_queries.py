"""The composite at a glance as registered queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators import filters, health, snapshots
from gaugeworks.plans.facts_sql import CHOSEN, FACTS, PERFORMANCE
from gaugeworks.plans.queries import AUTHORITY, CALLS, HEALTH, IN_DAY, PICKED, QUALITY, WINDOW_S, _health, _now
from gaugeworks.plans.registry import query
from gaugeworks.schema import TOKEN_PARTS
from gaugeworks.sources.events import performance_facts, usage_facts

AGENT = filters.MetricFilter(frozenset({"agent-a"}), frozenset())
_WINDOW = CHOSEN.replace("k AS (", "k2 AS (").replace("FROM k ", "FROM k2 ").replace("\nt AS (", "\nt2 AS (").replace("FROM t ", "FROM t2 ").replace("sel AS (SELECT f.* FROM f ", "sel2 AS (SELECT fw.* FROM fw ").replace("FROM f WHERE call_id", "FROM fw WHERE call_id")
_OUT, _BURN, _CALL = f"(SELECT * FROM sel AS f WHERE {IN_DAY} AND quality <> 'unavailable')", "(SELECT * FROM sel2 WHERE burn_total IS NOT NULL AND quality <> 'unavailable')", "(SELECT * FROM fw WHERE call_id <> '' AND quality <> 'unavailable')"
_WHOLE = ", ".join(f"(SELECT CASE WHEN count({p}) = count(*) THEN sum({p})::BIGINT END FROM {_BURN}) AS {p}" for p in TOKEN_PARTS)


def _owner(conflict: str, rows: str) -> str:
    return f"CASE WHEN (SELECT coalesce(bool_or(conflict), false) FROM {conflict}) THEN 'mixed' ELSE (SELECT {AUTHORITY} FROM {rows}) END"


@query(f"""SELECT (SELECT sum(output_tokens)::BIGINT FROM {_OUT}) AS output_tokens, (SELECT sum(output_tokens)::DOUBLE / 86400.0::DOUBLE FROM {_OUT}) AS tokens_per_s, (SELECT count(DISTINCT (agent, session_id)) FROM {_OUT}) AS sessions, (SELECT {QUALITY} FROM {_OUT}) AS output_quality,
    {_owner('t', _OUT)} AS output_authority, 'partial' AS output_coverage, 'SOURCE_FAILURE' AS output_reason, (SELECT max(observed_us) FROM {_OUT}) AS output_us,
    (SELECT sum(burn_total)::BIGINT FROM {_BURN}) AS burn_total, (SELECT sum(burn_total)::DOUBLE / 86400.0::DOUBLE * 60.0::DOUBLE FROM {_BURN}) AS tokens_per_min, {_WHOLE}, {_owner('t2', _BURN)} AS burn_authority, 'partial' AS burn_coverage,
    (SELECT {CALLS} FROM {_CALL}) AS calls, (SELECT {QUALITY} FROM {_CALL}) AS calls_quality, (SELECT max(observed_us) FROM {_CALL}) AS calls_us,
    (SELECT quantile_disc(ttft_ms, 0.5) FROM za WHERE usual) AS ttft_p50, (SELECT quantile_disc(duration_ms, 0.95) FROM za WHERE usual) AS e2e_p95, (SELECT count(*) FROM za WHERE usual) AS samples, (SELECT count(*) FROM za WHERE is_retry) AS retries,
    'stale' AS performance_state, 'SOURCE_OVERLOADED' AS performance_reason, 'UPDATE_SOURCE' AS performance_action, 'agent-a,agent-b' AS coding_agents,
    (SELECT string_agg(d || '=' || model_raw, ',' ORDER BY d, model_raw) FROM (SELECT model_raw, arg_min(model_display, (observed_us, id)) AS d FROM f9 GROUP BY model_raw)) AS models, (SELECT count(*) FROM hl) AS sources, 'agent-a' AS agents, 'selected' AS scope, (SELECT now FROM clock) AS generated_us""",
    FACTS.replace("\nf AS", "\nf9 AS").replace("FROM f)", "FROM f9)"), "f AS (SELECT * FROM f9 WHERE agent = 'agent-a')", CHOSEN, f"fw AS (SELECT * FROM f WHERE {IN_DAY})", _WINDOW, HEALTH, PERFORMANCE, PICKED, "za AS (SELECT * FROM z WHERE agent = 'agent-a')")
def light_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven parts for one agent, while some of its sources are sick."""
    facts = usage_facts(spark, sf_dir)
    r = snapshots.light_composite(facts, performance_facts(spark, sf_dir), _health(spark), _now(spark, sf_dir), WINDOW_S, WINDOW_S, snapshots.RANGES["7d"], AGENT)
    o, b, c, p = (F.col(x) for x in ("throughput", "burn", "calls", "performance"))
    models = F.array_join(F.transform("models", lambda m: F.concat_ws("=", m["model_display"], m["model_raw"])), ",")
    return r.select(
        o["output_tokens"].alias("output_tokens"), o["tokens_per_s"].alias("tokens_per_s"), o["sessions"].alias("sessions"), o["quality"].alias("output_quality"), o["authority"].alias("output_authority"), o["coverage"].alias("output_coverage"), o["reason"].alias("output_reason"), o["updated_us"].alias("output_us"),
        b["burn_total"].alias("burn_total"), b["tokens_per_min"].alias("tokens_per_min"), *[b[t].alias(t) for t in TOKEN_PARTS], b["authority"].alias("burn_authority"), b["coverage"].alias("burn_coverage"), c["calls"].alias("calls"), c["quality"].alias("calls_quality"), c["updated_us"].alias("calls_us"),
        p["ttft"]["p50"].alias("ttft_p50"), p["e2e"]["p95"].alias("e2e_p95"), p["samples"].alias("samples"), p["retries"].alias("retries"), p["state"].alias("performance_state"), p["reason"].alias("performance_reason"), p["action"].alias("performance_action"),
        F.array_join("coding_agents", ",").alias("coding_agents"), models.alias("models"), F.size("source_health").cast("bigint").alias("sources"), F.array_join("filter.agents", ",").alias("agents"), "scope", "generated_us",
    )


_SOURCES = """
pl AS (SELECT * REPLACE (CASE source_id WHEN 'src-c' THEN 'legacy-performance' ELSE source_id END AS source_id) FROM p WHERE source_id <> 'src-b'),
hp AS (SELECT i AS ordinal, 'hs-' || i AS source_id, CASE WHEN i % 2 = 0 THEN ['agent-' || chr((97 + (i // 2) % 3)::INT)] ELSE CAST([] AS VARCHAR[]) END AS agents, CASE WHEN i % 3 = 0 THEN [CASE i % 4 WHEN 0 THEN 'click' WHEN 1 THEN 'error' ELSE 'other' END] ELSE CAST([] AS VARCHAR[]) END AS channels FROM range(1, 20) AS r(i)
       UNION ALL SELECT 20, 'src-a', [], []),
kp AS (SELECT * FROM pl WHERE model_raw = 'm1')"""


@query("""SELECT ordinal, source_id FROM hp WHERE EXISTS (SELECT 1 FROM kp WHERE kp.source_id = hp.source_id OR (kp.source_id = 'legacy-performance' AND (list_contains(hp.agents, kp.agent) OR list_contains(hp.channels, kp.channel))))""", PERFORMANCE, _SOURCES)
def performance_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that bear on one model's latencies, where requests taken over from an older
    store are matched by agent or channel."""
    p = performance_facts(spark, sf_dir).where("source_id <> 'src-b'").withColumn("source_id", F.when(F.col("source_id") == "src-c", health.LEGACY).otherwise(F.col("source_id")))
    none = F.array().cast("array<string>")
    i = F.col("id").cast("int")
    agents = F.when(i % 2 == 0, F.array(F.concat(F.lit("agent-"), F.char(F.lit(97) + F.floor(i / 2) % 3)))).otherwise(none)
    channels = F.when(i % 3 == 0, F.array(F.when(i % 4 == 0, "click").when(i % 4 == 1, "error").otherwise("other"))).otherwise(none)
    rows = spark.range(1, 20).select(i.alias("ordinal"), F.concat(F.lit("hs-"), i.cast("string")).alias("source_id"), agents.alias("agents"), channels.alias("channels"))
    rows = rows.unionByName(spark.range(1).select(F.lit(20).alias("ordinal"), F.lit("src-a").alias("source_id"), none.alias("agents"), none.alias("channels"))).withColumn("impacts", F.array(F.lit("performance")))
    chosen = filters.MetricFilter(frozenset(), frozenset({"m1"}))
    return health.relevant_performance(rows, p, chosen).select("ordinal", "source_id")
