"""The derived fact tables in DuckDB SQL, for the registered queries' own SQL."""

FACTS = """
f0 AS (SELECT 'ev-' || lpad(event_id::VARCHAR, 9, '0') AS id,
    CASE user_id % 3 WHEN 0 THEN 'src-a' WHEN 1 THEN 'src-b' ELSE 'src-c' END AS source_id,
    CASE user_id % 2 WHEN 0 THEN 'agent-a' ELSE 'agent-b' END AS agent,
    'm' || (user_id % 7)::VARCHAR AS model_raw, 'Model ' || (user_id % 7 % 6)::VARCHAR AS model_display,
    user_id::VARCHAR AS session_id, epoch_us(ts) AS observed_us, floor(value)::BIGINT AS output_tokens,
    CASE WHEN event_type <> 'error' THEN json_extract_string(props, '$.k') END AS call_id,
    CASE WHEN event_type = 'purchase' THEN 'enhanced' ELSE 'fallback' END AS tier,
    CASE WHEN event_type IN ('purchase', 'click') THEN 'auth-main' ELSE 'auth-' || event_type END AS authority,
    CASE event_type WHEN 'purchase' THEN 'derived' WHEN 'signup' THEN 'estimated' WHEN 'error' THEN 'unavailable' ELSE 'measured' END AS quality,
    'call' AS granularity, epoch_us(ts) // 86400000000 * 86400000000 AS range_start_us, (epoch_us(ts) // 86400000000 + 1) * 86400000000 AS range_end_us,
    event_id % 50 AS input_uncached, event_id % 11 AS cache_read, CASE WHEN event_id % 5 <> 0 THEN event_id % 7 END AS cache_write,
    CASE WHEN event_id % 3 <> 0 THEN event_id % 13 END AS output_visible, event_id % 4 AS reasoning, event_type AS channel FROM events),
f AS (SELECT *, CASE WHEN channel <> 'error' THEN input_uncached + cache_read + coalesce(cache_write, 0) + coalesce(output_visible, 0) + reasoning END AS burn_total FROM f0),
clock AS (SELECT max(observed_us) AS now FROM f)"""

PERFORMANCE = """
p AS (SELECT user_id::VARCHAR || '-' || json_extract_string(props, '$.k') AS request_id,
    CASE user_id % 2 WHEN 0 THEN 'agent-a' ELSE 'agent-b' END AS agent, 'm' || (user_id % 7)::VARCHAR AS model_raw, epoch_us(ts) AS observed_us,
    (floor(value) * 100 + 50)::DOUBLE AS duration_ms, json_extract_string(props, '$.k')::DOUBLE AS ttft_ms, event_id % 97 AS output_total,
    event_type = 'error' AS is_retry, CASE WHEN event_type = 'purchase' THEN 'enhanced' ELSE 'fallback' END AS tier, 'request' AS granularity,
    CASE WHEN event_type = 'signup' THEN 'unavailable' ELSE 'measured' END AS quality,
    CASE user_id % 3 WHEN 0 THEN 'src-a' WHEN 1 THEN 'src-b' ELSE 'src-c' END AS source_id, event_type AS channel FROM events)"""

#: Fixed values of the derived windows, in microseconds.
DAY, HOUR = 86_400_000_000, 3_600_000_000

COHORT = "agent, call_id, granularity, range_start_us, range_end_us"
CHOSEN = f"""
k AS (SELECT *, max(CASE tier WHEN 'enhanced' THEN 1 ELSE 0 END) OVER (PARTITION BY {COHORT}) AS top FROM f WHERE call_id <> ''),
t AS (SELECT {COHORT}, min(id) AS id, count(DISTINCT authority) > 1 AS conflict FROM k WHERE CASE tier WHEN 'enhanced' THEN 1 ELSE 0 END = top GROUP BY {COHORT}),
sel AS (SELECT f.* FROM f WHERE call_id IS NULL OR call_id = '' OR id IN (SELECT id FROM t WHERE NOT conflict))"""
