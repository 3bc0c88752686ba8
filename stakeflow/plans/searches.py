"""Searches, eligibility rules and admission checks."""

from pyspark.sql import functions as F

from stakeflow.functions.semantics import ntz, r6
from stakeflow.operators import filters as S
from stakeflow.plans.registry import query

NOW = "2024-01-31 00:00:00"
MATCH_NOW = "2000-03-15 09:30:00"


@query("period_filter", "v_bet", f"""SELECT bet_id, placed_at, stake FROM v_bet
  WHERE placed_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY""")
def _(t):
    return S.period_filter(t.bet, "placed_at", "7d", NOW).select("bet_id", "placed_at", "stake")


@query("admin_period_filter", "", f"""SELECT event_id, ts FROM events
  WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR""")
def _(t):
    return S.admin_period_filter(t.events, "ts", "24h", NOW).select("event_id", "ts")


@query("match_search", "v_match", """SELECT match_id, home_team, away_team, match_date FROM v_match m
  WHERE league = 'EUROPE' AND (home_team = 'NATION_3' OR away_team = 'NATION_3')
    AND match_date BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31' AND status = 'finished'
    AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = m.match_id)""")
def _(t):
    return S.match_search(
        t.match, league="EUROPE", team="NATION_3", date_from="1996-01-01", date_to="1999-12-31",
        status="finished", has_odds=True, odds=t.quote,
    ).select("match_id", "home_team", "away_team", "match_date")


@query("team_search", "", """SELECT n_nationkey AS team_id, n_name AS name, r_name AS league
  FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND contains(lower(n_name), 'tion_1')""")
def _(t):
    teams = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("team_id"), F.col("n_name").alias("name"), F.col("r_name").alias("league"))
    return S.team_search(teams, league="ASIA", search="TION_1")


@query("prediction_search", "v_prediction", """SELECT user_id, match_id, confidence, odds, created_at
  FROM v_prediction WHERE sport = 'BUILDING' AND status = 'won' AND confidence >= 60 AND confidence < 70
   AND created_at >= TIMESTAMP '1996-01-01' AND confidence / 100 * odds > 1""")
def _(t):
    return S.prediction_search(
        t.prediction, sport="BUILDING", status="won", level="medium", date_from="1996-01-01",
        value_bets_only=True, min_confidence=60.0,
    ).select("user_id", "match_id", "confidence", "odds", "created_at")


@query("bet_search", "v_bet", """SELECT bet_id, stake, odds, status FROM v_bet
  WHERE bet_type = 'single' AND sport = 'football' AND stake BETWEEN 5 AND 200 AND odds BETWEEN 1.6 AND 3.0
    AND placed_at <= TIMESTAMP '2024-01-20'""")
def _(t):
    return S.bet_search(t.bet, bet_type="single", sport="football", date_to="2024-01-20", min_stake=5.0,
                        max_stake=200.0, min_odds=1.6, max_odds=3.0).select("bet_id", "stake", "odds", "status")


@query("activity_log", "", """SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'
  ORDER BY ts DESC, event_id DESC LIMIT 100 OFFSET 20""")
def _(t):
    return S.activity_log(t.events, activity_type="click", limit=500, offset=20).select("event_id", "user_id", "ts")


ALERTS = """SELECT event_id AS alert_id, user_id, ts AS created_at,
  CASE WHEN value >= 200 THEN 'critical' WHEN value >= 50 THEN 'warning' ELSE 'info' END AS severity,
  event_id % 3 <> 0 AS is_active FROM {events} WHERE event_type = 'error'"""


@query("alerts", "", f"""WITH a AS ({ALERTS.format(events='events')})
  SELECT alert_id, user_id, severity FROM a WHERE is_active AND severity = 'critical'""")
def _(t):
    return S.alerts(t.spark.sql(ALERTS, events=t.events), severity="critical").select("alert_id", "user_id", "severity")


NOTES = """SELECT event_id AS notification_id, user_id, ts AS created_at, event_type AS type,
  event_id % 2 = 0 AS is_read FROM {events}"""


@query("notifications", "", f"""WITH n AS ({NOTES.format(events='events')})
  SELECT notification_id, created_at, type, (SELECT count(*) FROM n WHERE user_id = 8 AND NOT is_read) AS unread_count
  FROM n WHERE user_id = 8 AND NOT is_read ORDER BY created_at DESC, notification_id DESC LIMIT 20""")
def _(t):
    return S.notifications(t.spark.sql(NOTES, events=t.events), 8, limit=20, unread_only=True).select(
        "notification_id", "created_at", "type", "unread_count")


@query("upcoming_matches", "v_match", f"""SELECT match_id, match_date FROM v_match
  WHERE match_date BETWEEN TIMESTAMP '{MATCH_NOW}' AND TIMESTAMP '{MATCH_NOW}' + INTERVAL 24 HOUR""")
def _(t):
    return S.upcoming_matches(t.match, MATCH_NOW).select("match_id", "match_date")


@query("today_matches", "v_match", f"""SELECT match_id, home_team, away_team FROM v_match
  WHERE CAST(match_date AS DATE) = DATE '{MATCH_NOW[:10]}' AND status = 'scheduled'""")
def _(t):
    return S.today_matches(t.match, MATCH_NOW).select("match_id", "home_team", "away_team")


LIVE = """SELECT o_orderkey AS match_id, o_orderdate AS match_date,
  CASE o_orderstatus WHEN 'P' THEN 'live' WHEN 'O' THEN 'scheduled' ELSE 'finished' END AS status FROM {orders}"""


@query("live_matches", "", f"WITH m AS ({LIVE.format(orders='orders')}) SELECT match_id, match_date FROM m WHERE status = 'live'")
def _(t):
    return S.live_matches(t.spark.sql(LIVE, orders=t.orders)).select("match_id", "match_date")


@query("bet_admission", "v_bet", """WITH j AS (
    SELECT b.bet_id, CASE WHEN COALESCE(c.c_acctbal / 20, 0) < b.stake THEN 'insufficient_balance'
      WHEN o.o_orderkey IS NULL THEN 'prediction_not_found'
      WHEN o.o_orderdate + INTERVAL 9131 DAY <= b.placed_at THEN 'match_started' END AS reason
    FROM v_bet b LEFT JOIN customer c ON c.c_custkey = b.user_id
    LEFT JOIN orders o ON o.o_orderkey = b.bet_id * 2)
  SELECT bet_id, reason, reason IS NULL AS accepted FROM j""")
def _(t):
    bets = t.bet.withColumn("prediction_id", F.col("bet_id") * 2)
    balances = t.customer.select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") / 20).alias("balance"))
    known = t.orders.select(F.col("o_orderkey").alias("prediction_id"),
                            (F.col("o_orderdate") + F.expr("INTERVAL 9131 DAYS")).alias("match_date"))
    return S.bet_admission(bets, balances, known).select("bet_id", "reason", "accepted")


def _offers(t):
    return t.bet.withColumn("cashout_available", F.col("stake") > 20).withColumn("match_started", F.col("odds") > 2.5)


@query("cashout_eligible", "v_bet", """SELECT bet_id, status = 'pending' AND stake > 20 AS cashout_eligible,
   round(COALESCE(cashout_value, 0) - stake, 6) AS cashout_profit FROM v_bet""")
def _(t):
    return _offers(t).select("bet_id", S.cashout_eligible().alias("cashout_eligible"),
                             r6(F.coalesce("cashout_value", F.lit(0.0)) - F.col("stake")).alias("cashout_profit"))


@query("cancel_eligible", "v_bet", """SELECT bet_id, status = 'pending' AND NOT odds > 2.5 AS cancel_eligible,
   CASE WHEN status = 'pending' AND NOT odds > 2.5 THEN stake END AS refunded_amount FROM v_bet""")
def _(t):
    return _offers(t).select("bet_id", S.cancel_eligible().alias("cancel_eligible"),
                             F.when(S.cancel_eligible(), F.col("stake")).alias("refunded_amount"))


@query("subscription_rules", "", f"""SELECT event_id AS subscription_id,
   event_type = 'error' AND TIMESTAMP '{NOW}' <= ts + INTERVAL 14 DAY AS reactivable,
   event_id % 2 = 0 AND floor(date_diff('microsecond', ts, TIMESTAMP '{NOW}') / 86400000000.0) < 7 AS refund_eligible
  FROM events""")
def _(t):
    subs = t.events.select(
        F.col("event_id").alias("subscription_id"), F.col("ts").alias("period_start"),
        (F.col("ts") + F.expr("INTERVAL 14 DAYS")).alias("period_end"),
        F.when(F.col("event_type") == "error", "canceled").otherwise("active").alias("status"),
        (F.col("event_id") % 2 == 0).alias("immediate"))
    return S.subscription_rules(subs, NOW).select("subscription_id", "reactivable", "refund_eligible")


@query("public_profiles", "v_prediction", """WITH p AS (SELECT user_id, count(*) AS total_predictions,
    round(COALESCE(100.0 * count(*) FILTER (status = 'won') / nullif(count(*) FILTER (status IN ('won', 'lost')), 0), 0), 6) AS accuracy
    FROM v_prediction GROUP BY user_id)
  SELECT c_custkey AS user_id, c_name AS username, COALESCE(total_predictions, 0) AS total_predictions,
    COALESCE(accuracy, 0.0) AS accuracy
  FROM customer LEFT JOIN p ON p.user_id = c_custkey WHERE c_acctbal > 2000""")
def _(t):
    from stakeflow.operators.aggregates import prediction_aggs, prediction_report
    users = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"))
    prefs = t.customer.select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") > 2000).alias("public_profile"))
    stats = prediction_report(t.prediction.groupBy("user_id").agg(*prediction_aggs()), ["user_id"])
    return S.public_profiles(users, prefs).join(stats, "user_id", "left").select(
        "user_id", "username", F.coalesce("total", F.lit(0)).alias("total_predictions"),
        F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"))
