"""Ledger statistics over bets."""

from pyspark.sql import functions as F

from stakeflow.functions.semantics import bet_return, r6, ratio
from stakeflow.operators import aggregates as A
from stakeflow.plans.registry import query

NOW = "2024-01-31 00:00:00"

# SQL pieces shared by the checks
SETTLED = """s AS (
  SELECT b.*, status <> 'pending' AS settled,
    CASE status WHEN 'won' THEN stake * odds WHEN 'void' THEN stake
         WHEN 'cashed_out' THEN COALESCE(cashout_value, 0) ELSE 0 END AS actual_return,
    CASE WHEN status = 'pending' THEN CAST(0 AS DOUBLE) ELSE
      CASE status WHEN 'won' THEN stake * odds WHEN 'void' THEN stake
         WHEN 'cashed_out' THEN COALESCE(cashout_value, 0) ELSE 0 END - stake END AS profit
  FROM v_bet b)"""
LEDGER = """count(*) AS total_bets, count(*) FILTER (status = 'won') AS won,
  count(*) FILTER (status = 'lost') AS lost, count(*) FILTER (status = 'void') AS void,
  count(*) FILTER (status = 'pending') AS pending,
  count(*) FILTER (status = 'cashed_out') AS cashed_out,
  round(sum(stake), 6) AS staked, round(sum(actual_return), 6) AS returned,
  round(sum(actual_return) - sum(stake), 6) AS profit,
  round(COALESCE(100.0 * count(*) FILTER (status = 'won')
    / nullif(count(*) FILTER (status IN ('won', 'lost')), 0), 0), 6) AS win_rate,
  round(COALESCE((sum(actual_return) - sum(stake)) * 100 / nullif(sum(stake), 0), 0), 6) AS roi,
  round(sum(odds) / count(*), 6) AS average_odds, round(sum(stake) / count(*), 6) AS average_stake,
  round(COALESCE(max(profit) FILTER (settled AND profit > 0), 0), 6) AS biggest_win,
  round(COALESCE(min(profit) FILTER (settled AND profit < 0), 0), 6) AS biggest_loss"""


@query("bet_stats_by_market", "v_bet", f"WITH {SETTLED} SELECT market, {LEDGER} FROM s GROUP BY market ORDER BY market")
def _(t):
    return A.bet_stats(t.bet, ["market"]).orderBy("market")


@query("bet_stats", "v_bet", f"""WITH {SETTLED} SELECT user_id, {LEDGER} FROM s
  WHERE placed_at >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY GROUP BY user_id""")
def _(t):
    from stakeflow.operators.filters import period_filter
    return A.bet_stats(period_filter(t.bet, "placed_at", "30d", NOW), ["user_id"])


@query("bet_breakdown", "v_bet", f"""WITH {SETTLED} SELECT
    CASE grouping(sport, market, bet_type) WHEN 3 THEN 'sport' WHEN 5 THEN 'market'
         WHEN 6 THEN 'bet_type' ELSE 'total' END AS dimension,
    COALESCE(sport, market, bet_type, 'all') AS member, {LEDGER}
  FROM s GROUP BY GROUPING SETS ((sport), (market), (bet_type), ())""")
def _(t):
    return A.bet_breakdown(t.bet, ["sport", "market", "bet_type"])


@query("settle_bets", "v_bet", f"""WITH {SETTLED} SELECT bet_id, status, settled,
    round(actual_return, 6) AS actual_return, round(profit, 6) AS profit FROM s""")
def _(t):
    return A.settle_bets(t.bet).select(
        "bet_id", "status", "settled", r6(F.col("actual_return")).alias("actual_return"),
        r6(F.col("profit")).alias("profit"))


@query("bet_list_totals", "v_bet", """WITH s AS (
    SELECT user_id, stake, CASE status WHEN 'won' THEN stake * odds WHEN 'void' THEN stake
      WHEN 'cashed_out' THEN cashout_value WHEN 'lost' THEN 0 END AS actual_return FROM v_bet),
  g AS (SELECT user_id, CAST(sum(stake) AS DECIMAL(28, 6)) AS st,
      CAST(sum(COALESCE(actual_return, 0)) AS DECIMAL(28, 6)) AS re, count(*) AS total FROM s GROUP BY user_id)
  SELECT user_id, CAST(round(st, 2) AS DOUBLE) AS total_staked, CAST(round(re, 2) AS DOUBLE) AS total_returns,
    CAST(round(re - st, 2) AS DOUBLE) AS total_profit, total FROM g""")
def _(t):
    back = bet_return(F.col("status"), F.col("stake"), F.col("odds"), F.col("cashout_value"))
    bets = t.bet.withColumn("actual_return", F.when(F.col("status") != "pending", back))
    return A.bet_list_totals(bets, ["user_id"])
