"""Ordered ledger analytics: streaks, drawdown, risk, rankings and price movement."""

from pyspark.sql import functions as F

from stakeflow.functions.semantics import r6
from stakeflow.operators import aggregates as A
from stakeflow.operators import windows as W
from stakeflow.plans.ledger import LEDGER, SETTLED
from stakeflow.plans.registry import query

DAILY = f"""{SETTLED}, d AS (SELECT user_id, CAST(placed_at AS DATE) AS day, round(sum(profit), 6) AS profit,
   round(sum(stake), 6) AS staked FROM s WHERE settled GROUP BY 1, 2)"""


@query("streaks", "v_bet", """WITH x AS (SELECT user_id, status, placed_at,
     row_number() OVER (PARTITION BY user_id ORDER BY placed_at, bet_id) AS a,
     row_number() OVER (PARTITION BY user_id, status ORDER BY placed_at, bet_id) AS b
   FROM v_bet WHERE status IN ('won', 'lost')),
  g AS (SELECT user_id, status, a - b AS island, count(*) AS n, max(a) AS last FROM x GROUP BY 1, 2, 3)
  SELECT user_id, COALESCE(max(n) FILTER (status = 'won'), 0) AS longest_win,
    COALESCE(max(n) FILTER (status = 'lost'), 0) AS longest_loss,
    arg_max(CASE WHEN status = 'won' THEN n ELSE -n END, last) AS current FROM g GROUP BY user_id""")
def _(t):
    return W.streaks(t.bet)


@query("profit_timeline", "v_bet", f"""WITH {SETTLED} SELECT bet_id, user_id, placed_at,
   round(sum(profit) OVER (PARTITION BY user_id ORDER BY placed_at, bet_id ROWS UNBOUNDED PRECEDING), 6) AS cumulative
   FROM s WHERE settled""")
def _(t):
    return W.profit_timeline(t.bet).select("bet_id", "user_id", "placed_at", r6(F.col("cumulative")).alias("cumulative"))


@query("max_drawdown", "v_bet", f"""WITH {SETTLED}, c AS (SELECT user_id, placed_at, bet_id,
    sum(profit) OVER (PARTITION BY user_id ORDER BY placed_at, bet_id ROWS UNBOUNDED PRECEDING) AS cum FROM s WHERE settled),
  p AS (SELECT *, greatest(0, max(cum) OVER (PARTITION BY user_id ORDER BY placed_at, bet_id ROWS UNBOUNDED PRECEDING)) AS peak FROM c)
  SELECT user_id, round(greatest(0, max(peak - cum)), 6) AS max_drawdown,
    round(greatest(0, max(peak - cum)) * 100 / (max(peak) + 1000), 6) AS max_drawdown_pct FROM p GROUP BY user_id""")
def _(t):
    return W.max_drawdown(t.bet)


@query("sharpe_sortino_volatility", "v_bet", f"""WITH {DAILY}, r AS (SELECT user_id, COALESCE(profit / nullif(staked, 0), 0) AS r FROM d)
  SELECT user_id, count(*) AS days, round(avg(r), 6) AS mean_return, round(stddev_samp(r), 6) AS volatility,
    round(avg(r) / nullif(stddev_samp(r), 0), 6) AS sharpe,
    round(avg(r) / nullif(sqrt(avg(least(r, 0) * least(r, 0))), 0), 6) AS sortino FROM r GROUP BY user_id""")
def _(t):
    return W.sharpe_sortino(t.bet)


@query("var_es", "v_bet", f"""WITH {DAILY}, q AS (SELECT user_id, round(quantile_cont(profit, 0.05), 6) AS q FROM d GROUP BY user_id)
  SELECT user_id, round(-max(q), 6) AS var, round(-avg(profit) FILTER (profit <= q), 6) AS es FROM d JOIN q USING (user_id) GROUP BY user_id""")
def _(t):
    return W.var_es(t.bet)


@query("win_loss_profile", "v_bet", f"""WITH {SETTLED} SELECT user_id, round(avg(profit) FILTER (profit > 0), 6) AS average_win,
   round(avg(profit) FILTER (profit < 0), 6) AS average_loss,
   round(COALESCE(sum(profit) FILTER (profit > 0), 0) / nullif(abs(sum(profit) FILTER (profit < 0)), 0), 6) AS profit_factor,
   round(max(profit) FILTER (profit > 0), 6) AS biggest_win, round(min(profit) FILTER (profit < 0), 6) AS biggest_loss
   FROM s WHERE settled GROUP BY user_id""")
def _(t):
    return W.win_loss_profile(t.bet)


USERS = f"{SETTLED}, u AS (SELECT user_id, {LEDGER} FROM s GROUP BY user_id)"


@query("leaderboard", "v_bet", f"""WITH {USERS}, r AS (SELECT user_id, roi, rank() OVER (ORDER BY roi DESC) AS rank FROM u)
   SELECT * FROM r WHERE rank <= 10 OR user_id = 8""")
def _(t):
    stats = A.bet_stats(t.bet, ["user_id"]).select("user_id", "roi")
    return W.leaderboard(stats, "roi", 10, me=8).select("user_id", "roi", "rank")


@query("performance_comparison", "v_bet", f"""WITH {USERS}, r AS (SELECT user_id, win_rate AS value, round(avg(win_rate) OVER (), 6) AS mean,
    percent_rank() OVER (ORDER BY win_rate) AS p FROM u)
   SELECT user_id, value, mean, round(p * 100, 6) AS percentile, p >= 0.9 AS top_performer FROM r""")
def _(t):
    return W.performance_comparison(A.bet_stats(t.bet, ["user_id"]), "win_rate")


SIDES = """sides AS (
  SELECT league, match_id, match_date, 'home' AS side, home_team AS team, away_team AS opponent, home_score AS gf, away_score AS ga FROM v_match WHERE status = 'finished'
  UNION ALL SELECT league, match_id, match_date, 'away', away_team, home_team, away_score, home_score FROM v_match WHERE status = 'finished'),
 sd AS (SELECT *, CASE WHEN gf > ga THEN 'W' WHEN gf = ga THEN 'D' ELSE 'L' END AS result FROM sides)"""


@query("recent_form", "v_match", f"""WITH {SIDES}, n AS (SELECT team, result, row_number() OVER (PARTITION BY team ORDER BY match_date DESC, match_id DESC) AS rn FROM sd)
   SELECT team, string_agg(result, '' ORDER BY rn) AS form FROM n WHERE rn <= 5 GROUP BY team""")
def _(t):
    return W.recent_form(A.team_sides(t.match), 5)


@query("odds_movement", "v_tick", """WITH x AS (SELECT tick_id, bookmaker, odds,
    lag(odds) OVER (PARTITION BY match_id, bookmaker ORDER BY ts, tick_id) AS previous_odds FROM v_tick),
   y AS (SELECT *, round(odds - previous_odds, 6) AS movement FROM x)
  SELECT tick_id, odds, previous_odds, movement, CASE WHEN movement < 0 THEN concat(bookmaker, '_shortening')
     WHEN movement > 0 THEN concat(bookmaker, '_drifting') ELSE 'stable' END AS trend FROM y""")
def _(t):
    return W.odds_movement(t.tick, ["match_id", "bookmaker"], "bookmaker", ["ts", "tick_id"]).select(
        "tick_id", "odds", "previous_odds", "movement", "trend")


@query("line_movement", "v_tick", """WITH h AS (SELECT *, max(odds) OVER (PARTITION BY match_id, bookmaker ORDER BY ts
      RANGE BETWEEN INTERVAL 21600 SECOND PRECEDING AND CURRENT ROW) AS high FROM v_tick),
   g AS (SELECT match_id, bookmaker, arg_min(odds, ts) AS opening, arg_max(odds, ts) AS current, count(*) AS tickets,
      max(round((high - odds) / high * 100, 6)) AS largest_drop_pct FROM h GROUP BY 1, 2),
   f AS (SELECT *, round(tickets / sum(tickets) OVER (PARTITION BY match_id), 6) AS ticket_share, round(current - opening, 6) AS movement FROM g)
  SELECT match_id, bookmaker, opening, current, tickets, largest_drop_pct, ticket_share, movement,
    movement < 0 AND ticket_share < 0.5 AS reverse_line, largest_drop_pct > 10 AS steam FROM f""")
def _(t):
    return W.line_movement(t.tick, steam_pct=10.0, steam_seconds=6 * 3600)


@query("profit_trend", "v_bet", f"""WITH {DAILY}, g AS (SELECT user_id, COALESCE(regr_slope(profit, date_diff('day', DATE '1970-01-01', day)), 0) AS s FROM d GROUP BY user_id)
  SELECT user_id, round(s, 6) AS slope, CASE WHEN s > 0.5 THEN 'up' WHEN s < -0.5 THEN 'down' ELSE 'stable' END AS trend FROM g""")
def _(t):
    return W.profit_trend(t.bet)


@query("prediction_updates", "v_update", """WITH x AS (SELECT *, lag(confidence) OVER w AS confidence_before, first_value(confidence) OVER w AS original
    FROM v_update WINDOW w AS (PARTITION BY prediction_id ORDER BY ts, update_id))
  SELECT update_id, prediction_id, confidence, confidence_before, confidence - confidence_before AS change, confidence - original AS since_original FROM x""")
def _(t):
    return W.prediction_updates(t.update).select(
        "update_id", "prediction_id", "confidence", "confidence_before", "change", "since_original")


@query("rolling_variance", "v_bet", f"""WITH {SETTLED}, d AS (SELECT user_id, CAST(placed_at AS DATE) AS day, round(sum(profit), 6) AS profit, var_samp(profit) AS v
     FROM s WHERE settled GROUP BY 1, 2)
  SELECT user_id, day, round(sqrt(v), 6) AS day_std, round(sqrt(var_samp(profit) OVER (PARTITION BY user_id ORDER BY day
     RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW)), 6) AS rolling_std FROM d""")
def _(t):
    v = W.rolling_variance(t.bet)
    return v.select("user_id", "day", r6(F.sqrt("day_variance")).alias("day_std"), r6(F.sqrt("rolling_variance")).alias("rolling_std"))


@query("rolling_team_features", "v_match", f"""WITH {SIDES}, x AS (SELECT team, match_id, match_date, count(*) OVER w AS last_n, avg(gf) OVER w AS a, avg(ga) OVER w AS b,
     avg(CASE WHEN result = 'W' THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY team, opponent ORDER BY match_date, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h,
     lag(match_date) OVER (PARTITION BY team ORDER BY match_date, match_id) AS prev
    FROM sd WINDOW w AS (PARTITION BY team ORDER BY match_date, match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
  SELECT team, match_id, last_n, round(a, 6) AS goals_for_avg, round(b, 6) AS goals_against_avg, round(h, 6) AS h2h_win_rate,
    date_diff('day', prev, match_date) AS rest_days FROM x""")
def _(t):
    return W.rolling_team_features(A.team_sides(t.match), 5)


@query("failed_login_run", "", """WITH e AS (SELECT *, count(*) FILTER (event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch FROM events)
  SELECT event_id, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id, epoch ORDER BY ts, event_id) AS failed_attempts FROM e""")
def _(t):
    return W.failed_login_run(t.events.select("event_id", "user_id", "ts", "event_type"), F.col("event_type") == "error",
                              F.col("event_type") == "signup").select("event_id", "failed_attempts")


@query("loss_chasing", "v_bet", f"""WITH {SETTLED}, x AS (SELECT user_id, stake, profit,
     lag(status) OVER (PARTITION BY user_id ORDER BY placed_at, bet_id) AS prev FROM s WHERE settled),
   m AS (SELECT user_id, round(avg(stake), 6) AS mean_stake FROM x GROUP BY user_id)
  SELECT user_id, max(mean_stake) AS mean_stake, round(avg(stake) FILTER (prev = 'lost'), 8) AS mean_stake_after_loss,
    count(*) FILTER (prev = 'lost' AND stake > mean_stake) AS chasing_bets,
    round(COALESCE(sum(profit) FILTER (prev = 'lost' AND stake > mean_stake), 0), 6) AS chasing_profit
  FROM x JOIN m USING (user_id) GROUP BY user_id""")
def _(t):
    return W.loss_chasing(t.bet)


@query("current_session", "", """SELECT event_id, user_id, ts, ts = max(ts) OVER (PARTITION BY user_id) AS is_current FROM events""")
def _(t):
    return W.current_session(t.events.select("event_id", "user_id", "ts"))


@query("live_probability_shift", "v_update", """WITH x AS (SELECT *, first_value(confidence) OVER w AS pre_match, lag(confidence) OVER w AS prev,
     row_number() OVER w AS rn FROM v_update WINDOW w AS (PARTITION BY prediction_id ORDER BY ts, update_id)),
   y AS (SELECT *, confidence - prev AS shift FROM x),
   z AS (SELECT *, sum(shift) OVER (PARTITION BY prediction_id ORDER BY rn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s FROM y)
  SELECT prediction_id, update_id, key_event, confidence, pre_match, confidence - pre_match AS change, shift,
    CAST(sign(s) AS DOUBLE) AS momentum FROM z""")
def _(t):
    return W.live_probability_shift(t.update, 3)
