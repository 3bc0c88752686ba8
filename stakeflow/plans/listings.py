"""Pages, top lists, unions and merges."""

from pyspark.sql import functions as F

from stakeflow.functions.semantics import r6
from stakeflow.operators import ranking as R
from stakeflow.operators import sets as U
from stakeflow.operators.scan import time_block
from stakeflow.plans.registry import query


@query("paginate", "", """WITH n AS (SELECT count(*) AS total, CAST(ceil(count(*) / 25.0) AS BIGINT) AS total_pages FROM events),
   p AS (SELECT *, greatest(1, least(7, greatest(total_pages, 1))) AS page FROM n)
  SELECT event_id, ts, total, total_pages, CAST(page AS BIGINT) AS page, page > 1 AS has_prev, page < total_pages AS has_next,
     CASE WHEN page > 1 THEN page - 1 END AS prev_page, CASE WHEN page < total_pages THEN page + 1 END AS next_page, rn AS position
  FROM (SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) AS rn FROM events) e, p
  WHERE rn > (page - 1) * 25 AND rn <= page * 25""")
def _(t):
    return R.paginate(t.events.select("event_id", "ts"), ["ts", "event_id"], time_block("ts"), page=7, per_page=25)


# the schedule with one model confidence and the best price per match
RATED = """m AS (SELECT match_id, match_date, home_team, avg(confidence) AS confidence, max(q.odds) AS odds
    FROM v_match JOIN (SELECT l_orderkey AS match_id, l_quantity * 2 AS confidence, 1.5 + l_discount * 20 AS odds FROM lineitem) q USING (match_id)
    WHERE status = 'scheduled' AND match_date >= TIMESTAMP '2000-03-15' AND match_date <= TIMESTAMP '2000-03-16'
    GROUP BY match_id, match_date, home_team)"""


def _rated(t):
    from stakeflow.operators.filters import upcoming_matches
    sched = upcoming_matches(t.match.filter("status = 'scheduled'"), "2000-03-15")
    model = t.lineitem.select(F.col("l_orderkey").alias("match_id"), (F.col("l_quantity") * 2).alias("confidence"),
                              (F.col("l_discount") * 20 + 1.5).alias("odds"))
    return (sched.join(model, "match_id").groupBy("match_id", "match_date", "home_team")
            .agg(F.avg("confidence").alias("confidence"), F.max("odds").alias("odds"))
            .withColumn("value_bet", F.col("confidence") / 100 * F.col("odds") > 1))


@query("upcoming_ranked", "v_match", f"""WITH {RATED}, c AS (SELECT * FROM m ORDER BY match_date, match_id LIMIT 10)
   SELECT match_id, round(confidence, 6) AS confidence, confidence / 100 * odds > 1 AS value_bet FROM c""")
def _(t):
    return R.upcoming_ranked(_rated(t), 10).select("match_id", r6(F.col("confidence")).alias("confidence"), "value_bet")


@query("value_bets_today", "v_quote", """WITH p AS (SELECT match_id, bookmaker, outcome, max(odds) AS odds FROM v_quote
      WHERE quoted_at = TIMESTAMP '1998-06-15' GROUP BY 1, 2, 3),
    v AS (SELECT *, round(0.3 * odds - 1, 6) AS expected_value FROM p WHERE round(0.3 * odds - 1, 6) >= 0.05)
  SELECT match_id, bookmaker, outcome, odds, expected_value, (SELECT count(*) FROM v) AS total_found
  FROM v ORDER BY expected_value DESC, match_id, bookmaker, outcome LIMIT 20""")
def _(t):
    prices = t.quote.filter(F.col("quoted_at") == F.lit("1998-06-15").cast("timestamp_ntz")).groupBy(
        "match_id", "bookmaker", "outcome").agg(F.max("odds").alias("odds"))
    ev = r6(F.lit(0.3) * F.col("odds") - 1)
    found = prices.withColumn("expected_value", ev).filter(F.col("expected_value") >= 0.05)
    return R.value_bets_today(found, ["match_id", "bookmaker", "outcome"])


@query("top_features", "v_prediction", """WITH f AS (
    SELECT 'confidence' AS feature, abs(corr(confidence, CASE status WHEN 'won' THEN 1.0 ELSE 0.0 END)) AS importance FROM v_prediction WHERE status IN ('won', 'lost')
    UNION ALL SELECT 'odds', abs(corr(odds, CASE status WHEN 'won' THEN 1.0 ELSE 0.0 END)) FROM v_prediction WHERE status IN ('won', 'lost')
    UNION ALL SELECT 'value', abs(corr(confidence * odds, CASE status WHEN 'won' THEN 1.0 ELSE 0.0 END)) FROM v_prediction WHERE status IN ('won', 'lost'))
   SELECT feature, round(importance, 6) AS importance FROM f ORDER BY importance DESC, feature LIMIT 2""")
def _(t):
    y = F.when(F.col("status") == "won", 1.0).otherwise(0.0)
    one = t.prediction.filter(F.col("status").isin("won", "lost")).agg(
        F.abs(F.corr("confidence", y)).alias("confidence"), F.abs(F.corr("odds", y)).alias("odds"),
        F.abs(F.corr(F.col("confidence") * F.col("odds"), y)).alias("value"))
    scores = one.unpivot([], ["confidence", "odds", "value"], "feature", "importance")
    return R.top_features(scores, 2).select("feature", r6(F.col("importance")).alias("importance"))


@query("chunks", "", """SELECT event_id, CAST(floor((row_number() OVER (ORDER BY ts, event_id) - 1) / 50.0) AS BIGINT) AS chunk FROM events""")
def _(t):
    return R.chunks(t.events.select("event_id", "ts"), ["ts", "event_id"], 50).select("event_id", "chunk")


@query("union_value_bets", "v_quote", """SELECT match_id, bookmaker, odds, outcome FROM v_quote WHERE outcome = 'home' AND 0.25 * odds > 1
   UNION ALL SELECT match_id, bookmaker, odds, outcome FROM v_quote WHERE outcome = 'away' AND 0.2 * odds > 1""")
def _(t):
    q = t.quote.drop("quoted_at")
    return U.union_value_bets(q.filter("outcome = 'home' AND CAST(0.25 AS DOUBLE) * odds > 1"),
                              q.filter("outcome = 'away' AND CAST(0.2 AS DOUBLE) * odds > 1"))


@query("dedup_first", "", """SELECT user_id, event_type, event_id, value FROM events
   QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1""")
def _(t):
    return U.dedup_keep(t.events, ["user_id", "event_type"], ["ts", "event_id"]).select(
        "user_id", "event_type", "event_id", "value")


@query("merge_records", "", """WITH a AS (SELECT c_custkey AS id, CASE WHEN c_acctbal > 3000 THEN c_acctbal END AS balance, c_mktsegment AS segment FROM customer),
   b AS (SELECT o_custkey AS id, max(o_totalprice) AS balance, max(o_orderdate) AS last_seen FROM orders WHERE o_totalprice > 300000 GROUP BY o_custkey)
  SELECT id, COALESCE(a.balance, b.balance) AS balance, segment, last_seen FROM a FULL JOIN b USING (id)""")
def _(t):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") > 3000, F.col("c_acctbal")).alias("balance"),
                          F.col("c_mktsegment").alias("segment"))
    b = t.orders.filter("o_totalprice > 300000").groupBy(F.col("o_custkey").alias("id")).agg(
        F.max("o_totalprice").alias("balance"), F.max("o_orderdate").alias("last_seen"))
    return U.merge_records("id", a, b, priority="first")
