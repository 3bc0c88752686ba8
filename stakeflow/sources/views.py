"""Adapter views: betting entities expressed over the raw star-schema and event tables.

Each text is valid in Spark SQL and in ANSI engines; ``KVAL`` marks the one JSON lookup
that differs, see :func:`render`.
"""

from __future__ import annotations

VIEWS: dict[str, str] = {
    "v_bet": """
SELECT event_id AS bet_id, user_id, ts AS placed_at, event_type AS market,
       value AS stake, CAST(1.5 AS DOUBLE) + CAST(event_id % 20 AS DOUBLE) / 10 AS odds,
       CASE WHEN KVAL < 45 THEN 'won' WHEN KVAL < 90 THEN 'lost' WHEN KVAL < 93 THEN 'void'
            WHEN KVAL < 95 THEN 'cashed_out' ELSE 'pending' END AS status,
       CASE WHEN KVAL >= 93 AND KVAL < 95 THEN value * CAST(0.8 AS DOUBLE) END AS cashout_value,
       CASE event_id % 4 WHEN 0 THEN 'football' WHEN 1 THEN 'basketball'
                         WHEN 2 THEN 'tennis' ELSE 'esports' END AS sport,
       CASE event_id % 3 WHEN 0 THEN 'single' WHEN 1 THEN 'multiple' ELSE 'system' END AS bet_type
FROM events""",
    "v_prediction": """
SELECT o.o_custkey AS user_id, l.l_orderkey AS match_id, c.c_mktsegment AS sport,
       o.o_orderpriority AS market, l.l_quantity * 2 AS confidence,
       CAST(1.5 AS DOUBLE) + l.l_discount * 20 AS odds,
       CASE WHEN l.l_returnflag = 'A' THEN 'won' WHEN l.l_returnflag = 'R' THEN 'lost'
            WHEN l.l_linestatus = 'O' THEN 'pending' ELSE 'void' END AS status,
       o.o_orderdate AS created_at
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey""",
    "v_match": """
SELECT o.o_orderkey AS match_id, r.r_name AS league, h.n_name AS home_team, a.n_name AS away_team,
       o.o_orderdate AS match_date,
       CASE WHEN o.o_orderstatus = 'O' THEN 'scheduled' ELSE 'finished' END AS status,
       CAST(floor(o.o_totalprice) AS BIGINT) % 5 AS home_score,
       CAST(floor(o.o_totalprice / 7) AS BIGINT) % 4 AS away_score
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation h ON c.c_nationkey = h.n_nationkey
JOIN nation a ON a.n_nationkey = (h.n_nationkey + 1 + o.o_orderkey % 24) % 25
JOIN region r ON h.n_regionkey = r.r_regionkey""",
    "v_quote": """
SELECT l_orderkey AS match_id, l_suppkey AS bookmaker,
       CASE l_linenumber % 3 WHEN 0 THEN 'home' WHEN 1 THEN 'draw' ELSE 'away' END AS outcome,
       CAST(1.5 AS DOUBLE) + l_quantity / 10 AS odds, l_shipdate AS quoted_at
FROM lineitem""",
    "v_tick": """
SELECT event_id AS tick_id, user_id AS match_id, event_type AS bookmaker,
       CAST(1.01 AS DOUBLE) + value / 100 AS odds, ts
FROM events""",
    "v_prob": """
SELECT l_orderkey AS match_id, l_linenumber AS model,
       l_quantity / (l_quantity + 20 + 100 * l_discount + 100 * l_tax) AS p_home,
       (10 + 100 * l_discount) / (l_quantity + 20 + 100 * l_discount + 100 * l_tax) AS p_draw,
       (10 + 100 * l_tax) / (l_quantity + 20 + 100 * l_discount + 100 * l_tax) AS p_away
FROM lineitem""",
    # confidence history of one prediction per (user, event type)
    "v_update": """
SELECT event_id AS update_id, user_id AS prediction_id, event_type AS key_event,
       CAST(KVAL AS DOUBLE) AS confidence, ts
FROM events""",
    # requests of the access log: k stands for the status code class, value for latency
    "v_access": """
SELECT event_id AS request_id, user_id, ts,
       CASE event_type WHEN 'view' THEN '/health/live' WHEN 'click' THEN '/api/v1/bets'
            WHEN 'purchase' THEN '/api/v1/subscriptions' WHEN 'signup' THEN '/api/v1/users'
            ELSE '/api/v2/realtime' END AS path,
       CASE WHEN KVAL < 80 THEN 200 WHEN KVAL < 93 THEN 404 ELSE 503 END AS status_code,
       value * 10 AS duration_ms,
       CASE WHEN KVAL % 3 = 0 THEN concat('10.0.', CAST(user_id % 250 AS VARCHAR(20)), '.1, 172.16.0.1') END AS forwarded_for,
       CASE WHEN KVAL % 3 = 1 THEN concat('10.1.', CAST(user_id % 250 AS VARCHAR(20)), '.2') END AS real_ip,
       concat('10.2.', CAST(user_id % 250 AS VARCHAR(20)), '.3') AS host
FROM events""",
    # subscriptions of users; one row per customer
    "v_subscription": """
SELECT c_custkey AS user_id,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'free' WHEN 'MACHINERY' THEN 'premium' ELSE 'pro' END AS tier,
       CASE c_custkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'canceled' ELSE 'past_due' END AS status,
       c_acctbal AS balance, c_nationkey AS zone
FROM customer""",
}


def render(name: str, dialect: str) -> str:
    kval = {
        "spark": "CAST(get_json_object(props, '$.k') AS INT)",
        "oracle": "CAST(json_extract_string(props, '$.k') AS INT)",
    }[dialect]
    return VIEWS[name].replace("KVAL", kval)


def oracle(views: str, body: str) -> str:
    """Put the named views (space separated) as CTEs before ``body``."""
    ctes = [f"{name} AS ({render(name, 'oracle')}\n)" for name in views.split()]
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join([*ctes, body[5:]])
    return "WITH " + ",\n".join(ctes) + "\n" + body if ctes else body
