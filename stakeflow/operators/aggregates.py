"""Ledger, prediction and match aggregations; all reduce map-side before the shuffle."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stakeflow.functions.semantics import as_time, bet_return, is_settled, ntz, r6, ratio, roi, win_rate


def settle_bets(bets: DataFrame) -> DataFrame:
    """Add actual_return, profit and the settled flag."""
    back = bet_return(F.col("status"), F.col("stake"), F.col("odds"), F.col("cashout_value"))
    return (
        bets.withColumn("settled", is_settled(F.col("status")))
        .withColumn("actual_return", back)
        .withColumn("profit", F.when(F.col("settled"), back - F.col("stake")).otherwise(F.lit(0.0)))
    )


def ledger_aggs() -> list[Column]:
    """Partial measures of a settled ledger."""
    def n(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    settled = F.col("settled")
    return [
        F.count("*").alias("total_bets"),
        n("won").alias("won"), n("lost").alias("lost"), n("void").alias("void"),
        n("pending").alias("pending"), n("cashed_out").alias("cashed_out"),
        F.sum("stake").alias("staked"),
        F.sum("actual_return").alias("returned"),
        F.sum("odds").alias("odds_sum"),
        F.max(F.when(settled & (F.col("profit") > 0), F.col("profit"))).alias("biggest_win"),
        F.min(F.when(settled & (F.col("profit") < 0), F.col("profit"))).alias("biggest_loss"),
    ]


LEDGER_COLUMNS = (
    "total_bets", "won", "lost", "void", "pending", "cashed_out", "staked", "returned", "profit",
    "win_rate", "roi", "average_odds", "average_stake", "biggest_win", "biggest_loss",
)


def ledger_report(grouped: DataFrame, keys: list[str]) -> DataFrame:
    c = F.col
    return grouped.select(
        *keys, "total_bets", "won", "lost", "void", "pending", "cashed_out",
        r6(c("staked")).alias("staked"), r6(c("returned")).alias("returned"),
        r6(c("returned") - c("staked")).alias("profit"),
        r6(win_rate(c("won"), c("lost"))).alias("win_rate"),
        r6(roi(c("returned"), c("staked"))).alias("roi"),
        r6(ratio(c("odds_sum"), c("total_bets"))).alias("average_odds"),
        r6(ratio(c("staked"), c("total_bets"))).alias("average_stake"),
        r6(F.coalesce(c("biggest_win"), F.lit(0.0))).alias("biggest_win"),
        r6(F.coalesce(c("biggest_loss"), F.lit(0.0))).alias("biggest_loss"),
    )


def bet_stats(bets: DataFrame, keys: list[str]) -> DataFrame:
    return ledger_report(settle_bets(bets).groupBy(*keys).agg(*ledger_aggs()), keys)


def bet_breakdown(bets: DataFrame, dims: list[str]) -> DataFrame:
    """Ledger report for each dimension and in total, from one aggregation."""
    settled = settle_bets(bets)
    sets = [[F.col(d)] for d in dims] + [[]]
    grouped = settled.groupingSets(sets, *[F.col(d) for d in dims]).agg(
        F.grouping_id().alias("gid"), *ledger_aggs())
    full = (1 << len(dims)) - 1
    name, key = F.lit("total"), F.lit("all")
    for i, d in enumerate(dims):
        hit = F.col("gid") == (full & ~(1 << (len(dims) - 1 - i)))
        name, key = F.when(hit, d).otherwise(name), F.when(hit, F.col(d)).otherwise(key)
    return ledger_report(
        grouped.withColumn("dimension", name).withColumn("member", key), ["dimension", "member"])


def bet_list_totals(bets: DataFrame, keys: list[str]) -> DataFrame:
    """Staked, returned and profit to 2 places; profit comes from the unrounded sums."""
    staked = F.round(F.sum("stake"), 6)
    returned = F.round(F.sum(F.coalesce(F.col("actual_return"), F.lit(0.0))), 6)
    return bets.groupBy(*keys).agg(
        F.round(staked, 2).alias("total_staked"),
        F.round(returned, 2).alias("total_returns"),
        F.round(F.round(returned - staked, 6), 2).alias("total_profit"),
        F.count("*").alias("total"),
    )


def prediction_aggs() -> list[Column]:
    s = F.col("status")
    return [
        F.count("*").alias("total"),
        F.count_if(s == "won").alias("correct"), F.count_if(s == "lost").alias("incorrect"),
        F.count_if(s == "pending").alias("pending"), F.count_if(s == "void").alias("void"),
        F.sum("confidence").alias("confidence_sum"),
    ]


def prediction_report(grouped: DataFrame, keys: list[str]) -> DataFrame:
    c = F.col
    return grouped.select(
        *keys, "total", "correct", "incorrect", "pending", "void",
        r6(ratio(c("correct"), c("correct") + c("incorrect"), 100)).alias("accuracy"),
        r6(ratio(c("confidence_sum"), c("total"))).alias("average_confidence"),
    )


def calibration(predictions: DataFrame, now=None, lookback_days: int | None = None, low: int = 0) -> DataFrame:
    """Per ten-point band: n, mean confidence, accuracy, gap and the band's share of ECE.

    ``lookback_days``, 7 to 365, keeps the predictions made since ``now`` less these days.
    """
    if lookback_days is not None:
        if not 7 <= lookback_days <= 365:
            raise ValueError("lookback_days must be between 7 and 365")
        predictions = predictions.filter(F.col("created_at") >= ntz(as_time(now) - dt.timedelta(days=lookback_days)))
    decided = predictions.filter(F.col("status").isin("won", "lost") & (F.col("confidence") >= low))
    bands = (
        decided.withColumn("band", F.least(F.floor(F.col("confidence") / 10) * 10, F.lit(90)))
        .groupBy("band")
        .agg(F.count("*").alias("n"), F.sum("confidence").alias("c"),
             F.count_if(F.col("status") == "won").alias("hits"))
    )
    totals = decided.agg(
        F.struct(F.count("*").alias("n"), F.sum("confidence").alias("c"),
                 F.count_if(F.col("status") == "won").alias("hits"))).scalar()
    gap = F.abs(ratio(F.col("c"), F.col("n")) - ratio(F.col("hits"), F.col("n"), 100))
    return bands.withColumn("t", totals).select(
        F.col("band").cast("long").alias("band"), "n",
        r6(ratio(F.col("c"), F.col("n"))).alias("mean_confidence"),
        r6(ratio(F.col("hits"), F.col("n"), 100)).alias("accuracy"),
        r6(gap).alias("gap"),
        r6(gap * ratio(F.col("n"), F.col("t.n"))).alias("ece_part"),
        r6(F.abs(ratio(F.col("t.c"), F.col("t.n")) - ratio(F.col("t.hits"), F.col("t.n"), 100)))
        .alias("overall_error"),
    )


def model_metrics() -> list[Column]:
    """Binary metrics of confidence/100 against won/lost at threshold 0.5."""
    y = F.when(F.col("status") == "won", 1.0).otherwise(0.0)
    p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col("confidence") / 100))
    hot = F.col("confidence") >= 50
    return [
        F.count("*").alias("n"),
        F.count_if(hot & (y == 1)).alias("tp"), F.count_if(hot & (y == 0)).alias("fp"),
        F.count_if(~hot & (y == 1)).alias("fn"), F.count_if(~hot & (y == 0)).alias("tn"),
        F.sum((p - y) * (p - y)).alias("se"),
        F.sum(-(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("ll"),
        F.count_if(F.col("confidence") >= 80).alias("very_high"),
        F.count_if((F.col("confidence") >= 70) & (F.col("confidence") < 80)).alias("high"),
        F.count_if((F.col("confidence") >= 60) & (F.col("confidence") < 70)).alias("medium"),
        F.count_if(F.col("confidence") < 60).alias("low"),
    ]


def model_performance(predictions: DataFrame, keys: list[str]) -> DataFrame:
    c = F.col
    m = predictions.filter(c("status").isin("won", "lost")).groupBy(*keys).agg(*model_metrics())
    return m.select(
        *keys, "n",
        r6(ratio(c("tp") + c("tn"), c("n"), 100)).alias("accuracy"),
        r6(ratio(c("tp"), c("tp") + c("fp"))).alias("precision"),
        r6(ratio(c("tp"), c("tp") + c("fn"))).alias("recall"),
        r6(ratio(c("tp") * 2, c("tp") * 2 + c("fp") + c("fn"))).alias("f1"),
        r6(ratio(c("se"), c("n"))).alias("brier"),
        r6(ratio(c("ll"), c("n"))).alias("log_loss"),
        "very_high", "high", "medium", "low",
    )


def team_sides(matches: DataFrame) -> DataFrame:
    """One row per team and finished match."""
    done = matches.filter(F.col("status") == "finished")
    side = F.array(
        F.struct(F.lit("home").alias("side"), F.col("home_team").alias("team"),
                 F.col("away_team").alias("opponent"), F.col("home_score").alias("gf"),
                 F.col("away_score").alias("ga")),
        F.struct(F.lit("away").alias("side"), F.col("away_team").alias("team"),
                 F.col("home_team").alias("opponent"), F.col("away_score").alias("gf"),
                 F.col("home_score").alias("ga")),
    )
    return (
        done.select("league", "match_id", "match_date", F.explode(side).alias("s"))
        .select("league", "match_id", "match_date", "s.*")
        .withColumn("result", F.when(F.col("gf") > F.col("ga"), "W")
                    .when(F.col("gf") == F.col("ga"), "D").otherwise("L"))
    )


def standings_aggs() -> list[Column]:
    r = F.col("result")
    return [
        F.count("*").alias("played"),
        F.count_if(r == "W").alias("won"), F.count_if(r == "D").alias("drawn"),
        F.count_if(r == "L").alias("lost"),
        F.sum("gf").alias("goals_for"), F.sum("ga").alias("goals_against"),
    ]


def today_flag(ts: str, now) -> Column:
    return F.to_date(ts) == F.to_date(ntz(now))
