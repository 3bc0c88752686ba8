"""Betting mathematics as table operators."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stakeflow.functions.semantics import kelly, r6, ratio
from stakeflow.operators.reports import best_odds
from stakeflow.operators.scan import group_stats


def implied_probability(quotes: DataFrame) -> DataFrame:
    return quotes.withColumn("implied", 1 / F.col("odds"))


def overround(quotes: DataFrame) -> DataFrame:
    """Bookmaker margin over the best price of each outcome and the normalised probability."""
    best = best_odds(quotes).select("match_id", "outcome", "best_odds")
    w = Window.partitionBy("match_id")  # one row per outcome
    total = F.sum(1 / F.col("best_odds")).over(w)
    return best.select("match_id", "outcome", r6(1 / F.col("best_odds")).alias("implied"),
                       r6(total - 1).alias("overround"), F.round(1 / F.col("best_odds") / total, 8).alias("fair_probability"))


def value_bet_scan(predictions: DataFrame, best: DataFrame, stake: float = 50.0, min_value: float = 1.0,
                   min_confidence: float = 50.0, sports: list[str] | None = None) -> DataFrame:
    """Predictions whose probability beats the best price.

    ``predictions`` is (match_id, outcome, confidence[, sport]); ``min_value`` is in percent.
    """
    p = predictions.filter(F.col("confidence") >= min_confidence)
    if sports:
        p = p.filter(F.col("sport").isin(*sports))
    prob = F.col("confidence") / 100
    value = r6((prob * F.col("best_odds") - 1) * 100)
    return p.join(best, ["match_id", "outcome"]).withColumn("value_pct", value).filter(
        F.col("value_pct") >= min_value).withColumn("true_odds", r6(1 / prob)).withColumn(
        "expected_value", r6(F.lit(stake) * (prob * F.col("best_odds") - 1))).withColumn(
        "kelly", r6(kelly(prob, F.col("best_odds"))))


def arbitrage_finder(quotes: DataFrame, outcomes: int = 3, max_inverse: float = 1.0, min_profit: float = 0.1,
                     total: float = 1000.0) -> DataFrame:
    """Matches whose best prices leave a sure profit, with the stake of every outcome."""
    best = quotes.groupBy("match_id", "outcome").agg(F.max("odds").alias("odds"))
    g = best.groupBy("match_id").agg(
        F.count("*").alias("n"), F.sum(1 / F.col("odds")).alias("inverse"),
        *[F.max(F.when(F.col("outcome") == o, F.col("odds"))).alias(o) for o in ("home", "draw", "away")])
    inv = F.col("inverse")
    hit = g.filter((F.col("n") == outcomes) & (inv < max_inverse) & ((1 / inv - 1) * 100 >= min_profit))
    return hit.select("match_id", r6(inv).alias("inverse"), r6((1 / inv - 1) * 100).alias("profit_pct"),
                      *[r6(F.lit(total) / F.col(o) / inv).alias(f"stake_{o}") for o in ("home", "draw", "away")])


def hedge_stakes(stake: Column, odds: Column, other: Column) -> tuple[Column, Column]:
    """Stake on the other side that equalises both outcomes, and the locked profit."""
    lay = stake * odds / other
    return r6(lay), r6(stake * odds - stake - lay)


OUTCOMES = ("home", "draw", "away")


def model_means(probs: DataFrame) -> DataFrame:
    """One probability vector per (match, model): repeats are averaged."""
    return probs.groupBy("match_id", "model").agg(*[F.avg(f"p_{o}").alias(f"p_{o}") for o in OUTCOMES])


def ensemble(probs: DataFrame, method: str, weight: Column | None = None) -> DataFrame:
    """Combine models: ``simple`` majority vote, ``weighted`` mean or ``soft`` mean of vectors."""
    m = model_means(probs)
    vote = F.when((F.col("p_home") >= F.col("p_draw")) & (F.col("p_home") >= F.col("p_away")), "home").when(
        F.col("p_draw") >= F.col("p_away"), "draw").otherwise("away")
    m = m.withColumn("vote", vote).withColumn("w", weight if method == "weighted" else F.lit(1.0))
    g = m.groupBy("match_id").agg(
        F.count("*").alias("models"),
        *[r6(F.sum(F.col(f"p_{o}") * F.col("w")) / F.sum("w")).alias(f"p_{o}") for o in OUTCOMES],
        *[F.count_if(F.col("vote") == o).alias(f"v_{o}") for o in OUTCOMES])
    score = "v" if method == "simple" else "p"
    s = {o: F.col(f"{score}_{o}") for o in OUTCOMES}
    top = F.when((s["home"] >= s["draw"]) & (s["home"] >= s["away"]), "home").when(
        s["draw"] >= s["away"], "draw").otherwise("away")
    g = g.withColumn("prediction", top)

    def of_top(prefix: str) -> Column:
        return F.when(F.col("prediction") == "home", F.col(f"{prefix}_home")).when(
            F.col("prediction") == "draw", F.col(f"{prefix}_draw")).otherwise(F.col(f"{prefix}_away"))

    return g.select("match_id", "models", "p_home", "p_draw", "p_away", "prediction",
                    of_top("p").alias("confidence"), r6(of_top("v") / F.col("models")).alias("agreement"))


def scenario_delta(scenarios: DataFrame, baseline: DataFrame) -> DataFrame:
    """Change of home probability per scenario, and each match's most and least sensitive factor."""
    d = scenarios.join(baseline, "match_id").withColumn("delta", F.round(F.col("p") - F.col("p_base"), 9))
    size = F.abs("delta")
    severity = F.when(size >= 0.1, "high").when(size >= 0.03, "medium").otherwise("low")
    ends = d.groupBy("match_id").agg(
        F.min_by("factor", F.struct(-size, F.col("factor"))).alias("most_sensitive"),
        F.min_by("factor", F.struct(size, F.col("factor"))).alias("least_sensitive"))
    return d.withColumn("severity", severity).join(ends, "match_id").select(
        "match_id", "factor", "delta", "severity", "most_sensitive", "least_sensitive")


def probability_interval(p: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    half = F.sqrt(p * (1 - p) / n) * z
    return r6(F.greatest(F.lit(0.0), p - half)), r6(F.least(F.lit(1.0), p + half))


def attack_defence(sides: DataFrame) -> DataFrame:
    """Average goals for and against per team over the league average."""
    mean = sides.agg(F.avg("gf")).scalar()
    return sides.groupBy("team").agg(F.avg("gf").alias("gf"), F.avg("ga").alias("ga")).select(
        "team", (F.col("gf") / mean).alias("attack"), (F.col("ga") / mean).alias("defence"), mean.alias("league_mean"))


def goal_rates(matches: DataFrame, strength: DataFrame) -> DataFrame:
    """Expected goals of both sides from attack and defence strengths."""
    h = strength.select(F.col("team").alias("home_team"), F.col("attack").alias("ha"), F.col("defence").alias("hd"), "league_mean")
    a = strength.select(F.col("team").alias("away_team"), F.col("attack").alias("aa"), F.col("defence").alias("ad"))
    return matches.join(h, "home_team").join(a, "away_team").select(
        "match_id", "home_team", "away_team", (F.col("ha") * F.col("ad") * F.col("league_mean")).alias("lh"),
        (F.col("aa") * F.col("hd") * F.col("league_mean")).alias("la"))


# fixed values: ln k! for k below 8
LN_FACTORIALS = tuple(math.log(math.factorial(k)) for k in range(8))


def _ln_factorial(k: Column) -> Column:
    """ln k!, by Stirling's series from 8 on (error below 1e-10)."""
    x = k.cast("double")
    series = (x + 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    return F.when(k < 8, F.get(F.array(*[F.lit(v) for v in LN_FACTORIALS]), k.cast("int"))).otherwise(series)


def _poisson(rate: Column, k: Column) -> Column:
    """Poisson probability in log space, so that no rate is too high."""
    return F.when(rate == 0, F.when(k == 0, 1.0).otherwise(0.0)).otherwise(F.exp(k * F.ln(rate) - rate - _ln_factorial(k)))


def poisson_grid(rates: DataFrame) -> DataFrame:
    """Market probabilities of two independent Poisson scores.

    Totals and both-to-score have closed forms. The winner depends on the pair of rates alone: each distinct
    pair gets one row per score within nine deviations of either rate, and running sums over these
    give the three results. What is left of one goes to the side with the higher rate.
    """
    lh, la, k = F.col("lh"), F.col("la"), F.col("k")
    mean, sd = lh + la, F.sqrt(lh + la)
    low, high = F.least(lh, la), F.greatest(lh, la)
    scores = F.sequence(F.greatest(F.lit(0), F.floor(low - F.sqrt(low) * 9 - 20)).cast("long"), F.ceil(high + F.sqrt(high) * 9 + 20).cast("long"))
    grid = rates.filter(lh.isNotNull() & la.isNotNull()).select("lh", "la").distinct().withColumn("k", F.explode(scores)).select(
        "lh", "la", "k", _poisson(lh, k).alias("h"), _poisson(la, k).alias("a"))
    below = Window.partitionBy("lh", "la").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("ch", F.coalesce(F.sum("h").over(below), F.lit(0.0))).withColumn("ca", F.coalesce(F.sum("a").over(below), F.lit(0.0)))
    results = grid.groupBy("lh", "la").agg(
        F.sum(F.col("h") * F.col("ca")).alias("home"), F.sum(F.col("h") * F.col("a")).alias("draw"), F.sum(F.col("a") * F.col("ch")).alias("away"))
    rest = 1 - F.col("home") - F.col("draw") - F.col("away")
    return rates.join(results, ["lh", "la"], "left").select(
        "match_id", r6(F.col("home") + F.when(lh >= la, rest).otherwise(0.0)).alias("p_home"), r6(F.col("draw")).alias("p_draw"),
        r6(F.col("away") + F.when(lh < la, rest).otherwise(0.0)).alias("p_away"),
        r6(1 - F.exp(-mean) * (1 + mean + mean * mean / 2)).alias("over_2_5"), r6((1 - F.exp(-lh)) * (1 - F.exp(-la))).alias("btts"),
        r6(mean).alias("goals_mean"), r6(sd).alias("goals_std"), r6(F.greatest(F.lit(0.0), mean - sd)).alias("goals_low"), r6(mean + sd).alias("goals_high"))


def portfolio_allocation(daily: DataFrame, bankroll: float, cap: float = 0.15) -> DataFrame:
    """Long-only weights mu/sigma^2 over assets, clipped at zero, scaled to one and capped.

    This is the diagonal mean-variance case: assets are taken as uncorrelated.
    """
    g = daily.groupBy("asset").agg(F.avg("r").alias("mu"), F.var_samp("r").alias("var"))
    raw = g.withColumn("raw", F.greatest(F.lit(0.0), ratio(F.col("mu"), F.col("var"))))
    total = raw.agg(F.sum("raw")).scalar()
    share = F.least(F.lit(cap), F.coalesce(F.try_divide(F.col("raw"), total), F.lit(0.0)))
    return raw.select("asset", r6(F.col("mu")).alias("mean_return"), r6(F.col("var")).alias("variance"),
                      r6(share).alias("weight"), r6(share * bankroll).alias("stake"))


def stake_recommendation(confidence: Column, odds: Column, bankroll: float, fraction: float = 0.25, cap: float = 0.02) -> Column:
    """Fractional Kelly stake, at most ``cap`` of the bankroll."""
    return r6(F.least(kelly(confidence / 100, odds) * fraction, F.lit(cap)) * bankroll)


def market_inefficiencies(quotes: DataFrame, z: float) -> DataFrame:
    """Prices more than ``z`` deviations off the consensus, and the book that moved last."""
    j = group_stats(quotes, ["match_id", "outcome"], {
        "mean": F.avg("odds"), "sd": F.stddev_samp("odds"),
        "slow_book": F.max_by("bookmaker", F.struct(F.col("quoted_at"), -F.col("bookmaker")))})
    return j.withColumn("z", r6(F.try_divide(F.col("odds") - F.col("mean"), F.nullif(F.col("sd"), F.lit(0.0))))).filter(
        F.abs("z") > z).select("match_id", "outcome", "bookmaker", "odds", r6(F.col("mean")).alias("consensus"), "z", "slow_book")


#: Stake rules by name: columns (confidence, odds) and the bankroll to a stake.
STRATEGIES: dict[str, Callable[[Column, Column, float], Column]] = {
    "kelly": stake_recommendation,
    "flat": lambda confidence, odds, bankroll: F.lit(bankroll * 0.01),
    "confidence": lambda confidence, odds, bankroll: r6(F.lit(bankroll * 0.02) * confidence / 100),
    "value_only": lambda confidence, odds, bankroll: F.when(confidence / 100 * odds > 1, F.lit(bankroll * 0.01)).otherwise(0.0),
}


def backtest(bets: DataFrame, start, end, bankroll: float, strategy: str | Callable[[Column, Column, float], Column] = "kelly") -> DataFrame:
    """Replay a stake rule: per user the ledger totals and the largest drawdown.

    ``bets`` carries ``confidence``; ``strategy`` is a name of STRATEGIES or a rule of that form. Stakes are
    relative to the starting bankroll; bets without a stake are not placed.
    """
    if isinstance(strategy, str) and strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}, expected one of {sorted(STRATEGIES)}")
    from stakeflow.functions.semantics import ntz
    from stakeflow.operators.aggregates import bet_stats
    from stakeflow.operators.windows import max_drawdown

    rule = STRATEGIES[strategy] if isinstance(strategy, str) else strategy
    stake = rule(F.col("confidence"), F.col("odds"), bankroll)
    replay = bets.filter((F.col("placed_at") >= ntz(start)) & (F.col("placed_at") < ntz(end)))
    replay = replay.withColumn("cashout_value", F.when(F.col("cashout_value").isNotNull(), stake * 0.8)).withColumn(
        "stake", stake).filter("stake > 0")
    return bet_stats(replay, ["user_id"]).select("user_id", "total_bets", "staked", "profit", "roi", "win_rate").join(
        max_drawdown(replay, "user_id", bankroll), "user_id")
