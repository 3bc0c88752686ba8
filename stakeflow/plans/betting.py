"""Betting mathematics over prices, probabilities and schedules."""

from pyspark.sql import functions as F

from stakeflow.functions.semantics import kelly, r6
from stakeflow.operators import aggregates as A
from stakeflow.operators import betting as B
from stakeflow.operators.reports import best_odds
from stakeflow.plans.ledger import LEDGER, SETTLED
from stakeflow.plans.registry import query
from stakeflow.plans.risk import SIDES

BEST = "b AS (SELECT match_id, outcome, max(odds) AS best_odds, arg_max(bookmaker, (odds, -bookmaker)) AS best_bookmaker FROM v_quote GROUP BY 1, 2)"


@query("implied_probability", "v_quote", "SELECT match_id, bookmaker, outcome, round(1 / odds, 6) AS implied FROM v_quote")
def _(t):
    return B.implied_probability(t.quote).select("match_id", "bookmaker", "outcome", r6(F.col("implied")).alias("implied"))


@query("overround", "v_quote", f"""WITH {BEST}, s AS (SELECT *, sum(1 / best_odds) OVER (PARTITION BY match_id) AS total FROM b)
   SELECT match_id, outcome, round(1 / best_odds, 6) AS implied, round(total - 1, 6) AS overround, round(1 / best_odds / total, 8) AS fair_probability FROM s""")
def _(t):
    return B.overround(t.quote)


MODEL = "p AS (SELECT match_id, outcome, avg(CASE outcome WHEN 'home' THEN p_home WHEN 'draw' THEN p_draw ELSE p_away END) * 100 AS confidence FROM v_prob, (VALUES ('home'), ('draw'), ('away')) o(outcome) GROUP BY 1, 2)"


def _model(t):
    vec = F.explode(F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(f"p_{o}").alias("p")) for o in B.OUTCOMES]))
    return t.prob.select("match_id", vec.alias("x")).groupBy("match_id", "x.outcome").agg((F.avg("x.p") * 100).alias("confidence"))


@query("value_bet_scan", "v_quote v_prob", f"""WITH {BEST}, {MODEL}, v AS (SELECT match_id, outcome, best_bookmaker, best_odds, confidence, round((confidence / 100 * best_odds - 1) * 100, 6) AS value_pct FROM p JOIN b USING (match_id, outcome) WHERE confidence >= 50)
   SELECT match_id, outcome, best_bookmaker, best_odds, value_pct, round(1 / (confidence / 100), 6) AS true_odds, round(50 * (confidence / 100 * best_odds - 1), 6) AS expected_value,
    round(greatest(0, (confidence / 100 * best_odds - 1) / (best_odds - 1)), 6) AS kelly FROM v WHERE value_pct >= 1""")
def _(t):
    best = best_odds(t.quote).select("match_id", "outcome", "best_odds", "best_bookmaker")
    return B.value_bet_scan(_model(t), best).drop("confidence")


@query("kelly", "v_prediction", "SELECT match_id, user_id, confidence, odds, round(greatest(0, (confidence / 100 * odds - 1) / (odds - 1)) * 0.5, 6) AS stake_share FROM v_prediction")
def _(t):
    return t.prediction.select("match_id", "user_id", "confidence", "odds", r6(kelly(F.col("confidence") / 100, F.col("odds")) * 0.5).alias("stake_share"))


@query("arbitrage_finder", "v_quote", """WITH b AS (SELECT match_id, outcome, max(odds) AS o FROM v_quote GROUP BY 1, 2),
   g AS (SELECT match_id, count(*) AS n, sum(1 / o) AS inv, max(o) FILTER (outcome = 'home') AS h, max(o) FILTER (outcome = 'draw') AS d, max(o) FILTER (outcome = 'away') AS a FROM b GROUP BY 1)
  SELECT match_id, round(inv, 6) AS inverse, round((1 / inv - 1) * 100, 6) AS profit_pct, round(1000 / h / inv, 6) AS stake_home, round(1000 / d / inv, 6) AS stake_draw, round(1000 / a / inv, 6) AS stake_away
  FROM g WHERE n = 3 AND inv < 1 AND (1 / inv - 1) * 100 >= 0.1""")
def _(t):
    return B.arbitrage_finder(t.quote)


@query("hedge_stakes", "v_quote", f"""WITH {BEST}, w AS (SELECT match_id, max(best_odds) FILTER (outcome = 'home') AS h, max(best_odds) FILTER (outcome = 'away') AS a FROM b GROUP BY 1)
   SELECT match_id, round(100.0 * h / a, 6) AS lay_stake, round(100.0 * h - 100.0 - 100.0 * h / a, 6) AS locked_profit FROM w WHERE h IS NOT NULL AND a IS NOT NULL""")
def _(t):
    w = best_odds(t.quote).groupBy("match_id").agg(
        F.max(F.when(F.col("outcome") == "home", F.col("best_odds"))).alias("h"), F.max(F.when(F.col("outcome") == "away", F.col("best_odds"))).alias("a"))
    lay, locked = B.hedge_stakes(F.lit(100.0), F.col("h"), F.col("a"))
    return w.filter("h IS NOT NULL AND a IS NOT NULL").select("match_id", lay.alias("lay_stake"), locked.alias("locked_profit"))


MEANS = """m AS (SELECT match_id, model, avg(p_home) AS h, avg(p_draw) AS d, avg(p_away) AS a FROM v_prob GROUP BY 1, 2),
  v AS (SELECT *, CASE WHEN h >= d AND h >= a THEN 'home' WHEN d >= a THEN 'draw' ELSE 'away' END AS vote, 1.0 / (1 + model) AS w FROM m)"""


def _ensemble(weight, score):
    return f"""WITH {MEANS}, g AS (SELECT match_id, count(*) AS models, round(sum(h * {weight}) / sum({weight}), 6) AS p_home, round(sum(d * {weight}) / sum({weight}), 6) AS p_draw,
      round(sum(a * {weight}) / sum({weight}), 6) AS p_away, count(*) FILTER (vote = 'home') AS v_home, count(*) FILTER (vote = 'draw') AS v_draw, count(*) FILTER (vote = 'away') AS v_away FROM v GROUP BY 1),
     t AS (SELECT *, CASE WHEN {score}_home >= {score}_draw AND {score}_home >= {score}_away THEN 'home' WHEN {score}_draw >= {score}_away THEN 'draw' ELSE 'away' END AS prediction FROM g)
    SELECT match_id, models, p_home, p_draw, p_away, prediction, CASE prediction WHEN 'home' THEN p_home WHEN 'draw' THEN p_draw ELSE p_away END AS confidence,
      round(CASE prediction WHEN 'home' THEN v_home WHEN 'draw' THEN v_draw ELSE v_away END / models, 6) AS agreement FROM t"""


@query("ensemble_simple", "v_prob", _ensemble("1.0", "v"))
def _(t):
    return B.ensemble(t.prob, "simple")


@query("ensemble_soft", "v_prob", _ensemble("1.0", "p"))
def _(t):
    return B.ensemble(t.prob, "soft")


@query("ensemble_weighted", "v_prob", _ensemble("w", "p"))
def _(t):
    return B.ensemble(t.prob, "weighted", F.lit(1.0) / (1 + F.col("model")))


SCEN = """m AS (SELECT match_id, model, round(avg(p_home), 9) AS p FROM v_prob GROUP BY 1, 2), b AS (SELECT match_id, p AS p_base FROM m WHERE model = 1),
  d AS (SELECT match_id, model AS factor, round(p - p_base, 9) AS delta FROM m JOIN b USING (match_id) WHERE model <> 1)"""


@query("scenario_delta", "v_prob", f"""WITH {SCEN}, e AS (SELECT match_id, arg_min(factor, (-abs(delta), factor)) AS most_sensitive, arg_min(factor, (abs(delta), factor)) AS least_sensitive FROM d GROUP BY 1)
   SELECT match_id, factor, delta, CASE WHEN abs(delta) >= 0.1 THEN 'high' WHEN abs(delta) >= 0.03 THEN 'medium' ELSE 'low' END AS severity, most_sensitive, least_sensitive FROM d JOIN e USING (match_id)""")
def _(t):
    m = t.prob.groupBy("match_id", F.col("model").alias("factor")).agg(F.round(F.avg("p_home"), 9).alias("p"))
    base = m.filter("factor = 1").select("match_id", F.col("p").alias("p_base"))
    return B.scenario_delta(m.filter("factor <> 1"), base)


@query("probability_interval", "v_prob", """WITH g AS (SELECT match_id, avg(p_home) AS p, count(*) AS n FROM v_prob GROUP BY 1)
   SELECT match_id, round(p, 6) AS p, round(greatest(0, p - 1.96 * sqrt(p * (1 - p) / n)), 6) AS low, round(least(1, p + 1.96 * sqrt(p * (1 - p) / n)), 6) AS high FROM g""")
def _(t):
    g = t.prob.groupBy("match_id").agg(F.avg("p_home").alias("p"), F.count("*").alias("n"))
    low, high = B.probability_interval(F.col("p"), F.col("n"))
    return g.select("match_id", r6(F.col("p")).alias("p"), low.alias("low"), high.alias("high"))


RATES = f"""{SIDES}, mu AS (SELECT avg(gf) AS mu FROM sd), st AS (SELECT team, avg(gf) / (SELECT mu FROM mu) AS att, avg(ga) / (SELECT mu FROM mu) AS def FROM sd GROUP BY 1),
  r AS (SELECT match_id, h.att * a.def * (SELECT mu FROM mu) AS lh, a.att * h.def * (SELECT mu FROM mu) AS la FROM v_match JOIN st h ON h.team = home_team JOIN st a ON a.team = away_team)"""


def _rates(t):
    return B.goal_rates(t.match, B.attack_defence(A.team_sides(t.match)))


@query("poisson_grid", "v_match", f"""WITH {RATES}, u AS (SELECT DISTINCT lh, la FROM r),
   x AS (SELECT lh, la, i, j, exp(-lh - la + i * ln(lh) + j * ln(la) - lgamma(i + 1) - lgamma(j + 1)) AS p
     FROM u, (SELECT unnest(range(40))::INT AS i) a, (SELECT unnest(range(40))::INT AS j) b),
   g AS (SELECT lh, la, sum(p) FILTER (i > j) AS ph, sum(p) FILTER (i = j) AS pd, sum(p) FILTER (i < j) AS pa FROM x GROUP BY 1, 2)
  SELECT match_id, round(ph, 6) AS p_home, round(pd, 6) AS p_draw, round(pa, 6) AS p_away,
    round(1 - exp(-lh - la) * (1 + lh + la + (lh + la) * (lh + la) / 2), 6) AS over_2_5, round((1 - exp(-lh)) * (1 - exp(-la)), 6) AS btts,
    round(lh + la, 6) AS goals_mean, round(sqrt(lh + la), 6) AS goals_std,
    round(greatest(0, lh + la - sqrt(lh + la)), 6) AS goals_low, round(lh + la + sqrt(lh + la), 6) AS goals_high FROM r JOIN g USING (lh, la)""")
def _(t):
    return B.poisson_grid(_rates(t))


@query("portfolio_allocation", "v_bet", f"""WITH {SETTLED}, d AS (SELECT market AS asset, CAST(placed_at AS DATE) AS day, round(sum(profit) / sum(stake), 6) AS r FROM s WHERE settled GROUP BY 1, 2),
   g AS (SELECT asset, avg(r) AS mu, var_samp(r) AS v, greatest(0, avg(r) / var_samp(r)) AS raw FROM d GROUP BY 1)
  SELECT asset, round(mu, 6) AS mean_return, round(v, 6) AS variance, round(least(0.15, raw / (SELECT sum(raw) FROM g)), 6) AS weight,
    round(least(0.15, raw / (SELECT sum(raw) FROM g)) * 1000, 6) AS stake FROM g""")
def _(t):
    done = A.settle_bets(t.bet).filter("settled")
    daily = done.groupBy(F.col("market").alias("asset"), F.to_date("placed_at").alias("day")).agg(r6(F.sum("profit") / F.sum("stake")).alias("r"))
    return B.portfolio_allocation(daily, 1000.0)


@query("stake_recommendation", "v_prediction", """WITH x AS (SELECT match_id, user_id, odds, round(least(greatest(0, (confidence / 100 * odds - 1) / (odds - 1)) * 0.25, 0.02) * 11250, 6) AS stake FROM v_prediction)
   SELECT match_id, user_id, odds, stake, round(stake * (odds - 1), 4) AS expected_profit FROM x""")
def _(t):
    s = B.stake_recommendation(F.col("confidence"), F.col("odds"), 11250.0)
    return t.prediction.select("match_id", "user_id", "odds", s.alias("stake")).withColumn(
        "expected_profit", F.round(F.col("stake") * (F.col("odds") - 1), 4))


@query("market_inefficiencies", "v_quote", """WITH g AS (SELECT match_id, outcome, avg(odds) AS m, stddev_samp(odds) AS sd, arg_max(bookmaker, (quoted_at, -bookmaker)) AS slow_book FROM v_quote GROUP BY 1, 2),
   x AS (SELECT *, round((odds - m) / nullif(sd, 0), 6) AS z FROM v_quote JOIN g USING (match_id, outcome))
  SELECT match_id, outcome, bookmaker, odds, round(m, 6) AS consensus, z, slow_book FROM x WHERE abs(z) > 1.1""")
def _(t):
    return B.market_inefficiencies(t.quote, 1.1)


BACKTEST = """WITH r0 AS (SELECT *, {stake} AS st FROM v_bet
     WHERE placed_at >= TIMESTAMP '2024-01-08' AND placed_at < TIMESTAMP '2024-01-29'),
   s AS (SELECT user_id, placed_at, bet_id, status, st AS stake, odds, CASE status WHEN 'won' THEN st * odds WHEN 'void' THEN st WHEN 'cashed_out' THEN st * 0.8 ELSE 0 END AS ret FROM r0 WHERE st > 0),
   g AS (SELECT user_id, count(*) AS total_bets, round(sum(stake), 6) AS staked, round(sum(ret) - sum(stake), 6) AS profit, round((sum(ret) - sum(stake)) * 100 / sum(stake), 6) AS roi,
     round(COALESCE(100.0 * count(*) FILTER (status = 'won') / nullif(count(*) FILTER (status IN ('won', 'lost')), 0), 0), 6) AS win_rate FROM s GROUP BY 1),
   c AS (SELECT user_id, placed_at, bet_id, sum(ret - stake) OVER (PARTITION BY user_id ORDER BY placed_at, bet_id ROWS UNBOUNDED PRECEDING) AS cum FROM s WHERE status <> 'pending'),
   p AS (SELECT *, greatest(0, max(cum) OVER (PARTITION BY user_id ORDER BY placed_at, bet_id ROWS UNBOUNDED PRECEDING)) AS peak FROM c),
   d AS (SELECT user_id, round(greatest(0, max(peak - cum)), 6) AS max_drawdown, round(greatest(0, max(peak - cum)) * 100 / (max(peak) + 1000), 6) AS max_drawdown_pct FROM p GROUP BY 1)
  SELECT * FROM g JOIN d USING (user_id)"""


def _backtest(t, strategy):
    return B.backtest(t.bet.withColumn("confidence", (F.col("bet_id") % 41 + 40).cast("double")), "2024-01-08", "2024-01-29", 1000.0, strategy)


@query("backtest", "v_bet", BACKTEST.format(stake="round(least(greatest(0, (CAST(40 + bet_id % 41 AS DOUBLE) / 100 * odds - 1) / (odds - 1)) * 0.25, 0.02) * 1000, 6)"))
def _(t):
    return _backtest(t, "kelly")


@query("backtest_value_only", "v_bet", BACKTEST.format(stake="CASE WHEN CAST(40 + bet_id % 41 AS DOUBLE) / 100 * odds > 1 THEN CAST(10 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"))
def _(t):
    return _backtest(t, "value_only")


@query("backtest_rule", "v_bet", BACKTEST.format(stake="CAST(40 + bet_id % 41 AS DOUBLE) / odds"))
def _(t):
    return _backtest(t, lambda confidence, odds, bankroll: confidence / odds)
