"""Reports over ledgers, predictions, matches and prices."""

from pyspark.sql import functions as F

from stakeflow.functions.semantics import r6
from stakeflow.operators import aggregates as A
from stakeflow.operators import reports as R
from stakeflow.operators import windows as W
from stakeflow.plans.ledger import LEDGER, NOW, SETTLED
from stakeflow.plans.registry import query
from stakeflow.plans.risk import DAILY, SIDES

TODAY = "2024-01-30 12:00:00"
PRED = """count(*) AS total, count(*) FILTER (status = 'won') AS correct, count(*) FILTER (status = 'lost') AS incorrect,
  count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'void') AS void,
  round(COALESCE(100.0 * count(*) FILTER (status = 'won') / nullif(count(*) FILTER (status IN ('won', 'lost')), 0), 0), 6) AS accuracy,
  round(sum(confidence) / count(*), 6) AS average_confidence"""
LEVEL = """CASE WHEN confidence >= 80 THEN 'very_high' WHEN confidence >= 70 THEN 'high' WHEN confidence >= 60 THEN 'medium' ELSE 'low' END"""


@query("prediction_stats", "v_prediction", f"""WITH p AS (SELECT *, {LEVEL} AS level FROM v_prediction),
  g AS (SELECT CASE grouping(sport, market, level) WHEN 3 THEN 'sport' WHEN 5 THEN 'market' WHEN 6 THEN 'level' ELSE 'total' END AS dimension,
     COALESCE(sport, market, level, 'all') AS member, {PRED} FROM p GROUP BY GROUPING SETS ((sport), (market), (level), ()))
  SELECT *, dimension = 'sport' AND member = arg_max(member, accuracy) OVER (PARTITION BY dimension) AS best,
     dimension = 'sport' AND member = arg_min(member, accuracy) OVER (PARTITION BY dimension) AS worst FROM g""")
def _(t):
    return R.prediction_stats(t.prediction)


def _overview(where_bets, where_predictions):
    sport = LEDGER.strip()
    return f"""WITH {SETTLED}, sb AS (SELECT * FROM s {where_bets}), d AS (SELECT user_id, CAST(placed_at AS DATE) AS day, round(sum(profit), 6) AS profit FROM s WHERE status <> 'pending' GROUP BY 1, 2),
  l AS (SELECT user_id, {LEDGER} FROM sb GROUP BY user_id),
  k AS (SELECT user_id, sport, {sport} FROM sb GROUP BY user_id, sport),
  ks AS (SELECT user_id, string_agg(concat_ws(':', sport, total_bets, won), ' ' ORDER BY sport) AS by_sport, arg_min(sport, (-roi, sport)) AS best_sport, arg_min(sport, (roi, sport)) AS worst_sport FROM k GROUP BY 1),
  pp AS (SELECT user_id, status, confidence, created_at + INTERVAL 8401 DAY AS created_at FROM v_prediction),
  p AS (SELECT user_id, {PRED} FROM pp {where_predictions} GROUP BY user_id),
  g AS (SELECT user_id, COALESCE(regr_slope(profit, date_diff('day', DATE '1970-01-01', day)), 0) AS s FROM d GROUP BY user_id)
  SELECT user_id, COALESCE(total_bets, 0) AS total_bets, COALESCE(won, 0) AS winning_bets, COALESCE(total, 0) AS total_predictions, COALESCE(correct, 0) AS correct_predictions,
    COALESCE(staked, 0) AS staked, COALESCE(profit, 0) AS profit, COALESCE(roi, 0) AS roi, COALESCE(win_rate, 0) AS win_rate, COALESCE(accuracy, 0) AS accuracy,
    by_sport, best_sport, worst_sport, CASE WHEN g.s > 0.5 THEN 'up' WHEN g.s < -0.5 THEN 'down' ELSE 'stable' END AS trend
  FROM l FULL JOIN p USING (user_id) LEFT JOIN ks USING (user_id) LEFT JOIN g USING (user_id)"""


def _overview_of(t, period):
    made = t.prediction.withColumn("created_at", F.col("created_at").cast("timestamp_ntz") + F.make_dt_interval(days=F.lit(8401)))
    out = R.analytics_overview(t.bet, made, W.profit_trend(t.bet), period, "2024-01-31 00:00:00")
    text = F.array_join(F.transform("by_sport", lambda x: F.concat_ws(":", x["sport"], x["total_bets"], x["won"])), " ")
    return out.withColumn("by_sport", text)


@query("analytics_overview", "v_bet v_prediction", _overview("", ""))
def _(t):
    return _overview_of(t, "all")


@query("analytics_overview_week", "v_bet v_prediction", _overview(
    "WHERE placed_at >= TIMESTAMP '2024-01-24'", "WHERE created_at >= TIMESTAMP '2024-01-24'"))
def _(t):
    return _overview_of(t, "7d")


def _perf(unit):
    return f"""WITH {SETTLED}, g AS (SELECT CAST(date_trunc('{unit}', placed_at) AS TIMESTAMP) AS period, {LEDGER} FROM s GROUP BY 1)
      SELECT period, total_bets, won, lost, win_rate, profit, roi FROM g"""


@query("performance_daily", "v_bet", _perf("day"))
def _(t):
    return R.performance_by(t.bet, "day")


@query("performance_monthly", "v_bet", _perf("month"))
def _(t):
    return R.performance_by(t.bet, "month")


@query("rollup_sport_league_market", "v_bet", f"""WITH {SETTLED}, g AS (SELECT CAST(grouping(sport, market, bet_type) AS INT) AS level, sport, market, bet_type, {LEDGER}
    FROM s GROUP BY ROLLUP (sport, market, bet_type)) SELECT level, sport, market, bet_type, total_bets, win_rate, profit, roi FROM g""")
def _(t):
    return R.rollup_report(t.bet, ["sport", "market", "bet_type"])


@query("admin_stats", "v_bet v_prediction", f"""WITH {SETTLED}, r AS (SELECT * FROM s WHERE placed_at >= TIMESTAMP '2024-01-23 12:00:00'),
   p AS (SELECT status, created_at + INTERVAL 8401 DAY AS made FROM v_prediction), u AS (SELECT TIMESTAMP '2024-01-30 09:00:00' - INTERVAL 1 HOUR * CAST(c_custkey * 7 % 1500 AS INT) AS made FROM customer)
  SELECT count(*) AS bets, count(*) FILTER (placed_at >= TIMESTAMP '2024-01-30') AS bets_today, count(DISTINCT user_id) AS active_users, round(sum(stake), 6) AS wagered, round(sum(profit), 6) AS user_profit,
   (SELECT count(*) FROM p WHERE made >= TIMESTAMP '2024-01-23 12:00:00') AS predictions, (SELECT count(*) FROM p WHERE made >= TIMESTAMP '2024-01-30') AS predictions_today,
   (SELECT round(COALESCE(100.0 * count(*) FILTER (status = 'won') / nullif(count(*) FILTER (status IN ('won', 'lost')), 0), 0), 6) FROM p WHERE made >= TIMESTAMP '2024-01-23 12:00:00') AS accuracy,
   (SELECT count(*) FROM u) AS total_users, (SELECT count(*) FROM u WHERE made >= TIMESTAMP '2024-01-30') AS new_users_today,
   (SELECT count(*) FROM u WHERE made >= TIMESTAMP '2024-01-23 12:00:00') AS new_users_week, (SELECT count(*) FROM u WHERE made >= TIMESTAMP '2023-12-31 12:00:00') AS new_users_month FROM r""")
def _(t):
    made = t.prediction.withColumn("created_at", F.col("created_at").cast("timestamp_ntz") + F.make_dt_interval(days=F.lit(8401)))
    joined = F.lit("2024-01-30 09:00:00").cast("timestamp_ntz") - F.make_dt_interval(hours=(F.col("c_custkey") * 7 % 1500).cast("int"))
    return R.admin_stats(t.bet, made, t.customer.select(joined.alias("created_at")), TODAY, 7)


@query("traffic_metrics", "v_access", """SELECT path, count(*) AS requests,
   round(count(*) / CAST(floor(date_diff('microsecond', min(ts), max(ts)) / 1000000.0) AS DOUBLE), 6) AS rps, round(sum(duration_ms) / count(*), 6) AS mean_ms,
   round(100.0 * count(*) FILTER (status_code >= 400) / count(*), 6) AS error_pct, count(*) FILTER (duration_ms <= 100) AS le_100,
   count(*) FILTER (duration_ms <= 500) AS le_500, count(*) FILTER (duration_ms <= 1000) AS le_1000, count(*) AS le_inf FROM v_access GROUP BY path""")
def _(t):
    return R.traffic_metrics(t.access, ["path"])


@query("batch_outcome", "v_access", """SELECT user_id, count(*) FILTER (status_code < 400) AS successful, count(*) FILTER (status_code >= 400) AS failed,
    CAST(70 AS INT) AS announced, count(*) = 70 AS consistent FROM v_access GROUP BY user_id""")
def _(t):
    res = t.access.withColumn("error", F.when(F.col("status_code") >= 400, F.col("path"))).withColumn("announced", F.lit(70))
    return R.batch_outcome(res, "user_id")


@query("value_bet_summary", "v_prediction", """WITH v AS (SELECT sport, confidence / 100 * odds - 1 AS edge FROM v_prediction WHERE confidence / 100 * odds - 1 > 0)
   SELECT sport, count(*) AS total_found, round(avg(edge), 6) AS average_edge, round(sum(edge * 10), 6) AS total_ev FROM v GROUP BY sport""")
def _(t):
    edge = F.col("confidence") / 100 * F.col("odds") - 1
    v = t.prediction.select("sport", edge.alias("edge"), (edge * 10).alias("expected_value")).filter(F.col("edge") > 0)
    return R.value_bet_summary(v, ["sport"])


@query("multi_sport_summary", "v_prediction", """WITH g AS (SELECT sport, count(DISTINCT match_id) AS events, count(*) AS predictions, round(avg(confidence), 6) AS mean_confidence,
    round(sum(CASE status WHEN 'won' THEN odds - 1 WHEN 'lost' THEN -1 END) * 100 / count(*) FILTER (status IN ('won', 'lost')), 6) AS roi FROM v_prediction GROUP BY sport)
   SELECT *, round((SELECT sum(roi * events) / sum(events) FROM g), 6) AS total_roi FROM g""")
def _(t):
    return R.multi_sport_summary(t.prediction)


@query("sport_correlation", "v_bet", f"""WITH {SETTLED}, d AS (SELECT sport, CAST(placed_at AS DATE) AS day, round(sum(profit) / sum(stake), 6) AS r FROM s WHERE settled GROUP BY 1, 2)
   SELECT a.sport AS sport_a, b.sport AS sport_b, round(corr(a.r, b.r), 6) AS correlation FROM d a JOIN d b ON a.day = b.day AND a.sport < b.sport GROUP BY 1, 2""")
def _(t):
    return R.sport_correlation(t.bet, ["football", "basketball", "tennis", "esports"])


@query("confidence_calibration", "v_prediction", """WITH d AS (SELECT *, least(floor(confidence / 10) * 10, 90) AS b, CASE status WHEN 'won' THEN 100.0 ELSE 0 END AS hit
     FROM v_prediction WHERE status IN ('won', 'lost') AND confidence >= 60),
   t AS (SELECT count(*) AS tn, avg(confidence) AS tc, avg(hit) AS th FROM d),
   g AS (SELECT CAST(b AS BIGINT) AS band, count(*) AS n, avg(confidence) AS c, avg(hit) AS h FROM d GROUP BY 1)
  SELECT band, n, round(c, 6) AS mean_confidence, round(h, 6) AS accuracy, round(abs(c - h), 6) AS gap, round(abs(c - h) * n / tn, 6) AS ece_part,
    round(abs(tc - th), 6) AS overall_error FROM g, t""")
def _(t):
    return A.calibration(t.prediction, low=60)


MODEL = """count(*) AS n, round(100.0 * count(*) FILTER ((confidence >= 50) = (status = 'won')) / count(*), 6) AS accuracy,
   round(COALESCE(CAST(count(*) FILTER (confidence >= 50 AND status = 'won') AS DOUBLE) / nullif(count(*) FILTER (confidence >= 50), 0), 0), 6) AS precision,
   round(COALESCE(CAST(count(*) FILTER (confidence >= 50 AND status = 'won') AS DOUBLE) / nullif(count(*) FILTER (status = 'won'), 0), 0), 6) AS recall,
   round(COALESCE(CAST(2 * count(*) FILTER (confidence >= 50 AND status = 'won') AS DOUBLE) / nullif(count(*) FILTER (confidence >= 50) + count(*) FILTER (status = 'won'), 0), 0), 6) AS f1,
   round(avg((confidence / 100 - CASE status WHEN 'won' THEN 1 ELSE 0 END) * (confidence / 100 - CASE status WHEN 'won' THEN 1 ELSE 0 END)), 6) AS brier,
   round(avg(-CASE status WHEN 'won' THEN ln(greatest(1e-15, least(1 - 1e-15, confidence / 100))) ELSE ln(1 - greatest(1e-15, least(1 - 1e-15, confidence / 100))) END), 6) AS log_loss,
   count(*) FILTER (confidence >= 80) AS very_high, count(*) FILTER (confidence >= 70 AND confidence < 80) AS high,
   count(*) FILTER (confidence >= 60 AND confidence < 70) AS medium, count(*) FILTER (confidence < 60) AS low"""


@query("model_performance", "v_prediction", f"SELECT market, {MODEL} FROM v_prediction WHERE status IN ('won', 'lost') GROUP BY market")
def _(t):
    return A.model_performance(t.prediction, ["market"])


@query("league_standings", "v_match", f"""WITH {SIDES}, g AS (SELECT league, team, count(*) AS played, count(*) FILTER (result = 'W') AS won, count(*) FILTER (result = 'D') AS drawn,
    count(*) FILTER (result = 'L') AS lost, CAST(sum(gf) AS BIGINT) AS goals_for, CAST(sum(ga) AS BIGINT) AS goals_against FROM sd GROUP BY 1, 2),
   p AS (SELECT *, goals_for - goals_against AS goal_difference, won * 3 + drawn AS points FROM g)
  SELECT *, row_number() OVER (PARTITION BY league ORDER BY points DESC, goal_difference DESC, goals_for DESC, team) AS position FROM p""")
def _(t):
    return R.league_standings(A.team_sides(t.match))


@query("team_stats", "v_match", f"""WITH {SIDES}, g AS (SELECT team, count(*) AS played, count(*) FILTER (result = 'W') AS won, count(*) FILTER (result = 'D') AS drawn,
    count(*) FILTER (result = 'L') AS lost, CAST(sum(gf) AS BIGINT) AS goals_for, CAST(sum(ga) AS BIGINT) AS goals_against,
    concat_ws('-', count(*) FILTER (result = 'W' AND side = 'home'), count(*) FILTER (result = 'D' AND side = 'home'), count(*) FILTER (result = 'L' AND side = 'home')) AS home_record,
    concat_ws('-', count(*) FILTER (result = 'W' AND side = 'away'), count(*) FILTER (result = 'D' AND side = 'away'), count(*) FILTER (result = 'L' AND side = 'away')) AS away_record
   FROM sd GROUP BY 1) SELECT *, round(100.0 * won / played, 6) AS win_percentage FROM g""")
def _(t):
    return R.team_stats(A.team_sides(t.match))


@query("head_to_head", "v_match", """WITH p AS (SELECT least(home_team, away_team) AS team_a, greatest(home_team, away_team) AS team_b, match_id, match_date,
     CASE WHEN home_team < away_team THEN home_score ELSE away_score END AS sa, CASE WHEN home_team < away_team THEN away_score ELSE home_score END AS sb
    FROM v_match WHERE status = 'finished'),
   r AS (SELECT *, row_number() OVER (PARTITION BY team_a, team_b ORDER BY match_date DESC, match_id DESC) AS rn FROM p)
  SELECT team_a, team_b, count(*) AS meetings, count(*) FILTER (sa > sb) AS a_wins, count(*) FILTER (sa = sb) AS draws, count(*) FILTER (sa < sb) AS b_wins,
    string_agg(concat(sa, '-', sb), ' ' ORDER BY rn) FILTER (rn <= 3) AS last_meetings FROM r GROUP BY 1, 2""")
def _(t):
    return R.head_to_head(t.match, 3)


@query("odds_comparison", "v_quote", """WITH g AS (SELECT match_id, outcome, max(odds) AS best_odds, avg(odds) AS average_odds FROM v_quote GROUP BY 1, 2),
   b AS (SELECT match_id, outcome, min(bookmaker) AS best_bookmaker FROM v_quote JOIN g USING (match_id, outcome) WHERE odds = best_odds GROUP BY 1, 2)
  SELECT match_id, outcome, bookmaker, odds, best_odds, best_bookmaker, round(average_odds, 6) AS average_odds, odds = best_odds AND bookmaker = best_bookmaker AS is_best
  FROM v_quote JOIN g USING (match_id, outcome) JOIN b USING (match_id, outcome)""")
def _(t):
    return R.odds_comparison(t.quote).select("match_id", "outcome", "bookmaker", "odds", "best_odds", "best_bookmaker",
                                             r6(F.col("average_odds")).alias("average_odds"), "is_best")


SHARES = """g AS (SELECT sport, market, count(*) AS tickets, sum(stake) AS m FROM v_bet GROUP BY 1, 2),
  h AS (SELECT sport, market, tickets, round(m, 6) AS money, round(100.0 * tickets / sum(tickets) OVER (PARTITION BY sport), 6) AS ticket_share,
    round(100.0 * m / sum(m) OVER (PARTITION BY sport), 6) AS money_share FROM g)"""


@query("public_vs_money", "v_bet", f"WITH {SHARES} SELECT * FROM h")
def _(t):
    return R.public_vs_money(t.bet, "sport", "market")


@query("contrarian_plays", "v_bet", f"WITH {SHARES} SELECT * FROM h WHERE ticket_share >= 20 AND money_share < ticket_share")
def _(t):
    return R.contrarian_plays(R.public_vs_money(t.bet, "sport", "market"), 20.0)


@query("exposure", "v_bet", """SELECT user_id, count(*) AS active_bets, round(sum(stake), 6) AS stake_at_risk, round(sum(stake) * 100 / 5000, 6) AS exposure_pct,
   round(sum(stake) * 100 / 5000, 6) <= 15 AS healthy FROM v_bet WHERE status = 'pending' GROUP BY user_id""")
def _(t):
    return R.exposure(t.bet, 5000.0)


@query("concentration_risk", "v_bet", """WITH g AS (SELECT user_id, 'sport' AS dimension, sport AS member, count(*) AS bets FROM v_bet GROUP BY 1, 3
    UNION ALL SELECT user_id, 'market', market, count(*) FROM v_bet GROUP BY 1, 3),
   h AS (SELECT *, round(bets / sum(bets) OVER (PARTITION BY user_id, dimension), 6) AS share FROM g)
  SELECT *, round(sum(share * share) OVER (PARTITION BY user_id, dimension), 8) AS hhi FROM h""")
def _(t):
    return R.concentration_risk(t.bet, ["sport", "market"])


@query("bankroll_report", "v_bet", f"""WITH {SETTLED}, g AS (SELECT user_id, sum(profit) AS p, count(*) FILTER (CAST(placed_at AS DATE) = DATE '{TODAY[:10]}') AS bets_today,
    COALESCE(sum(profit) FILTER (CAST(placed_at AS DATE) = DATE '{TODAY[:10]}'), 0) AS pt FROM s GROUP BY user_id)
   SELECT user_id, round(p + 10000, 6) AS current_bankroll, round(p, 6) AS profit_loss, round(p * 100 / 10000, 6) AS profit_loss_pct,
    round((p + 10000) * CAST(0.02 AS DOUBLE), 6) AS max_stake_per_bet, bets_today, round(pt, 6) AS profit_today, round(500 + least(pt, 0), 6) AS remaining_budget_today FROM g""")
def _(t):
    return R.bankroll_report(t.bet, 10000.0, 500.0, TODAY)


@query("pattern_mining", "v_bet", f"""WITH {SETTLED}, x AS (SELECT CASE WHEN isodow(placed_at) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_type, sport,
     CASE WHEN odds < 2 THEN 'favorite' ELSE 'underdog' END AS side, status, stake, profit FROM s WHERE status IN ('won', 'lost'))
  SELECT day_type, sport, side, count(*) AS n, round(100.0 * count(*) FILTER (status = 'won') / count(*), 6) AS win_rate, round(sum(profit) * 100 / sum(stake), 6) AS roi,
    CASE WHEN sum(profit) * 100 / sum(stake) > 0 THEN 'winning' ELSE 'losing' END AS pattern FROM x GROUP BY CUBE (day_type, sport, side) HAVING count(*) >= 300""")
def _(t):
    return R.pattern_mining(t.bet, 300)


@query("temporal_patterns", "v_bet", """WITH d AS (SELECT user_id, CAST(isodow(placed_at) AS INT) - 1 AS wd, CAST(floor(hour(placed_at) / 3.0) * 3 AS INT) AS slot, CASE status WHEN 'won' THEN 1 ELSE 0 END AS w
     FROM v_bet WHERE status IN ('won', 'lost')),
   a AS (SELECT user_id, wd, round(avg(w), 6) AS r FROM d GROUP BY 1, 2), b AS (SELECT user_id, slot, round(avg(w), 6) AS r FROM d GROUP BY 1, 2),
   a1 AS (SELECT user_id, wd AS best_weekday FROM a QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY r DESC, wd) = 1),
   b1 AS (SELECT user_id, slot AS best_slot FROM b QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY r DESC, slot) = 1),
   c AS (SELECT user_id, COALESCE(avg(w * 100) FILTER (wd >= 5), 0) AS we, COALESCE(avg(w * 100) FILTER (wd < 5), 0) AS wk FROM d GROUP BY 1)
  SELECT user_id, best_weekday, best_slot, round(we, 6) AS weekend_win_rate, round(wk, 6) AS weekday_win_rate, round(we - wk, 6) AS weekend_gap FROM a1 JOIN b1 USING (user_id) JOIN c USING (user_id)""")
def _(t):
    return R.temporal_patterns(t.bet)


@query("learning_insights", "v_bet", """WITH b AS (SELECT *, placed_at + INTERVAL 1 MINUTE * CAST(bet_id % 300 AS INT) AS match_date FROM v_bet WHERE status IN ('won', 'lost')),
   x AS (SELECT status, 'stake' AS dimension, CASE WHEN stake / 1000 < 0.02 THEN 'below 2%' WHEN stake / 1000 < 0.05 THEN '2-5%' ELSE '5% and more' END AS band FROM b
     UNION ALL SELECT status, 'market', market FROM b
     UNION ALL SELECT status, 'lead_time', CASE WHEN bet_id % 300 >= 120 THEN '2h and more' ELSE 'less than 2h' END FROM b)
  SELECT dimension, band, count(*) AS n, round(100.0 * count(*) FILTER (status = 'won') / count(*), 6) AS win_rate FROM x GROUP BY 1, 2""")
def _(t):
    lead = F.make_dt_interval(mins=(F.col("bet_id") % 300).cast("int"))
    return R.learning_insights(t.bet.withColumn("match_date", F.col("placed_at") + lead), 1000.0)


@query("longshot_bias", "v_bet", f"""WITH {SETTLED} SELECT CASE WHEN odds < 1.8 THEN '1 favorite' WHEN odds < 2.5 THEN '2 even' WHEN odds < 3.0 THEN '3 outsider' ELSE '4 longshot' END AS band,
   count(*) AS n, round(100.0 * count(*) FILTER (status = 'won') / count(*), 6) AS win_rate, round((sum(actual_return) - sum(stake)) * 100 / sum(stake), 6) AS roi,
   round(avg(1 / odds) * 100, 6) AS implied_pct, round((avg(CASE status WHEN 'won' THEN 1.0 ELSE 0 END) - avg(1 / odds)) * 100, 6) AS bias
   FROM s WHERE status IN ('won', 'lost') GROUP BY 1""")
def _(t):
    return R.longshot_bias(t.bet)


@query("similar_bets_evidence", "v_bet", f"""WITH {SETTLED}, p AS (SELECT user_id, sport, market, count(*) AS n, round(100.0 * count(*) FILTER (status = 'won') / count(*), 6) AS win_rate,
     round((sum(actual_return) - sum(stake)) * 100 / sum(stake), 6) AS roi FROM s WHERE status IN ('won', 'lost') GROUP BY 1, 2, 3)
  SELECT bet_id, user_id, sport, market, COALESCE(n, 0) AS n, win_rate, roi FROM v_bet LEFT JOIN p USING (user_id, sport, market) WHERE status = 'pending'""")
def _(t):
    return R.similar_bets_evidence(t.bet)


@query("live_dashboard", "v_bet", f"""WITH {SETTLED}, x AS (SELECT *, CAST(placed_at AS DATE) = DATE '{TODAY[:10]}' AS today FROM s)
   SELECT user_id, count(*) FILTER (status = 'pending') AS active_bets, round(COALESCE(sum(stake) FILTER (status = 'pending'), 0), 6) AS active_stake,
    round(COALESCE(sum(stake * odds) FILTER (status = 'pending'), 0), 6) AS potential_return, count(*) FILTER (today AND status = 'won') AS won_today,
    count(*) FILTER (today AND status = 'lost') AS lost_today, round(COALESCE(sum(profit) FILTER (today AND settled), 0), 6) AS profit_today,
    round(COALESCE(sum(profit) FILTER (today AND settled) * 100 / nullif(sum(stake) FILTER (today AND settled), 0), 0), 6) AS roi_today FROM x GROUP BY user_id""")
def _(t):
    return R.live_dashboard(t.bet, TODAY)


@query("daily_digest", "v_match v_quote", """WITH k AS (SELECT l_orderkey AS match_id, count(*) AS picks, max(l_quantity * 2) AS confidence FROM lineitem WHERE l_quantity * 2 >= 70 GROUP BY 1),
   v AS (SELECT match_id, count(*) AS n FROM v_quote WHERE 0.3 * odds > 1 GROUP BY 1),
   b AS (SELECT match_id, outcome, max(odds) AS o FROM v_quote GROUP BY 1, 2), a AS (SELECT match_id FROM b GROUP BY 1 HAVING count(*) = 3 AND sum(1 / o) < 0.7)
  SELECT CAST(match_date AS DATE) AS day, count(*) AS events, CAST(COALESCE(sum(picks), 0) AS BIGINT) AS picks, CAST(COALESCE(sum(v.n), 0) AS BIGINT) AS value_bets,
    count(a.match_id) AS arbitrages, arg_max(match_id, (confidence, -match_id)) FILTER (confidence IS NOT NULL) AS top_pick,
    array_to_string(list(concat(match_id, ':', CAST(confidence AS INT)) ORDER BY confidence DESC, match_id) FILTER (confidence IS NOT NULL)[1:3], ' ') AS top_picks
  FROM v_match LEFT JOIN k USING (match_id) LEFT JOIN v USING (match_id) LEFT JOIN a USING (match_id) GROUP BY 1""")
def _(t):
    from stakeflow.operators.betting import arbitrage_finder
    conf = t.lineitem.select(F.col("l_orderkey").alias("match_id"), (F.col("l_quantity") * 2).alias("confidence"))
    out = R.daily_digest(t.match, conf.filter("confidence >= 70"), t.quote.filter("CAST(0.3 AS DOUBLE) * odds > 1"),
                         arbitrage_finder(t.quote, outcomes=3, max_inverse=0.7))
    text = F.transform("top_picks", lambda x: F.concat(x["match_id"], F.lit(":"), x["confidence"].cast("int")))
    return out.withColumn("top_picks", F.array_join(text, " "))


@query("digest_performance", "v_bet", f"""WITH {SETTLED}, b AS (SELECT * FROM s WHERE placed_at < TIMESTAMP '2024-01-30'),
   w AS (SELECT user_id, round(COALESCE(sum(profit) FILTER (placed_at >= TIMESTAMP '2024-01-29') * 100 / nullif(sum(stake) FILTER (placed_at >= TIMESTAMP '2024-01-29'), 0), 0), 6) AS yesterday_roi,
     round(COALESCE(sum(profit) * 100 / nullif(sum(stake), 0), 0), 6) AS week_roi FROM b WHERE status <> 'pending' AND placed_at >= TIMESTAMP '2024-01-23' GROUP BY 1),
   x AS (SELECT user_id, status, row_number() OVER (PARTITION BY user_id ORDER BY placed_at DESC, bet_id DESC) AS rn FROM b WHERE status IN ('won', 'lost')),
   f AS (SELECT user_id, arg_min(status, rn) AS st FROM x GROUP BY 1),
   r AS (SELECT x.user_id, st, COALESCE(min(rn) FILTER (status <> st) - 1, max(rn)) AS n FROM x JOIN f USING (user_id) GROUP BY 1, 2)
  SELECT user_id, COALESCE(yesterday_roi, 0) AS yesterday_roi, COALESCE(week_roi, 0) AS week_roi, COALESCE(n, 0) AS current_streak,
    CASE st WHEN 'won' THEN 'winning' WHEN 'lost' THEN 'losing' ELSE 'none' END AS streak_type FROM r FULL JOIN w USING (user_id)""")
def _(t):
    return R.digest_performance(t.bet, TODAY)


@query("parlay_odds_of", "v_quote", "SELECT match_id AS parlay_id, round(ln(product(odds)), 6) AS log_odds FROM v_quote GROUP BY 1")
def _(t):
    slips = t.quote.groupBy(F.col("match_id").alias("parlay_id")).agg(F.collect_list(F.struct("odds")).alias("legs"))
    return slips.select("parlay_id", r6(F.ln(R.parlay_odds_of(F.col("legs")))).alias("log_odds"))


@query("parlay_odds", "v_quote", """SELECT match_id AS parlay_id, count(*) AS legs, round(ln(product(odds)), 6) AS log_odds,
    round(1 / product(odds), 9) AS implied_probability FROM v_quote GROUP BY 1""")
def _(t):
    p = R.parlay_odds(t.quote.withColumnRenamed("match_id", "parlay_id"), "parlay_id")
    return p.select("parlay_id", "legs", r6(F.ln("combined_odds")).alias("log_odds"),
                    F.round(1 / F.col("combined_odds"), 9).alias("implied_probability"))


@query("continuous_rollup", "v_tick", """SELECT bookmaker, time_bucket(INTERVAL 6 HOUR, ts) AS bucket, count(*) AS n, arg_min(odds, (ts, tick_id)) AS open, max(odds) AS high, min(odds) AS low,
   arg_max(odds, (ts, tick_id)) AS close, round(avg(odds), 6) AS mean FROM v_tick GROUP BY 1, 2""")
def _(t):
    return R.continuous_rollup(t.tick, "ts", "6 hours", ["bookmaker"], "odds")
