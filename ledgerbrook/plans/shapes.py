"""Event-log query shapes: counts, distincts, top-k, text filters and time buckets over events, documents and pages."""

from __future__ import annotations

from ..sources.tables import sql_query

SQL: dict[str, str] = {
    "c1_counts_and_lookup": """
SELECT 'all' AS what, count(*) AS n FROM events UNION ALL SELECT 'not_error', count(*) FROM events WHERE event_type <> 'error'
UNION ALL SELECT 'user_42', count(*) FROM events WHERE user_id = 42 UNION ALL SELECT 'url_page', count(*) FROM pages WHERE url LIKE '%page%'""",
    "c2_global_aggregates": """
SELECT round(sum(value), 6) AS total, count(*) AS n, round(avg(value), 6) AS mean, min(ts) AS first_ts, max(ts) AS last_ts FROM events""",
    "c3_global_distinct": "SELECT count(DISTINCT user_id) AS users, count(DISTINCT props) AS props FROM events",
    "c4_group_top_k": """
SELECT event_type, user_id, count(*) AS n FROM events GROUP BY event_type, user_id ORDER BY n DESC, event_type, user_id LIMIT 20""",
    "c5_distinct_users_top_k": """
SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type ORDER BY users DESC, event_type LIMIT 10""",
    "c6_user_minute": """
SELECT user_id, CAST(minute(ts) AS INT) AS m, event_type, count(*) AS n FROM events GROUP BY user_id, CAST(minute(ts) AS INT), event_type
ORDER BY n DESC, user_id, m, event_type LIMIT 20""",
    "c7_any_groups": "SELECT count(*) AS n FROM (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY user_id, event_type LIMIT 10) AS few",
    "c8_text_filters": """
SELECT lang, min(url) AS first_url, count(*) AS n, count(DISTINCT source) AS sources FROM documents JOIN pages ON page_id = doc_id
WHERE text LIKE '%the%' AND url NOT LIKE '%.com/%' GROUP BY lang""",
    "c9_top_rows": "SELECT event_id, ts, event_type, props FROM events WHERE event_type = 'click' ORDER BY ts, event_id LIMIT 25",
    "c10_hosts": """
SELECT host, round(avg(length(url)), 6) AS mean_length, count(*) AS n, min(url) AS first_url
FROM (SELECT url, parse_url(url, 'HOST') AS host FROM pages) AS p GROUP BY host HAVING count(*) > 1""",
    "c11_shifted_sums": "SELECT " + ", ".join(f"round(sum(l_quantity + {i}), 6) AS s{i}" for i in range(90)) + " FROM lineitem",
    "c12_computed_keys": """
SELECT user_id, user_id - 1 AS u1, user_id - 2 AS u2, user_id % 7 AS u7, count(*) AS n FROM events GROUP BY user_id, user_id - 1, user_id - 2, user_id % 7
ORDER BY n DESC, user_id LIMIT 10""",
    "c13_filtered_with_offset": """
SELECT user_id, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS band, count(*) AS n FROM events
WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00' AND event_type <> 'error'
GROUP BY user_id, CASE WHEN value > 50 THEN 'high' ELSE 'low' END ORDER BY n DESC, user_id, band LIMIT 10 OFFSET 20""",
    "c14_minutes_with_offset": """
SELECT date_trunc('minute', ts) AS m, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-08 00:00:00'
GROUP BY date_trunc('minute', ts) ORDER BY m LIMIT 10 OFFSET 100""",
}


def queries() -> dict:
    return {k: sql_query(v) for k, v in SQL.items()}


def oracle_sql() -> dict[str, str]:
    return SQL | {"c10_hosts": SQL["c10_hosts"].replace("parse_url(url, 'HOST')", "split_part(split_part(url, '//', 2), '/', 1)")}
