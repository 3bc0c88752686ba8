"""Ledger, prediction and market reports composed of single-pass aggregations."""

from __future__ import annotations

import datetime as dt
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stakeflow.functions.semantics import as_time, confidence_level, ntz, r6, ratio, roi, win_rate
from stakeflow.operators.aggregates import (
    ledger_aggs, ledger_report, prediction_aggs, prediction_report, settle_bets, standings_aggs, today_flag,
)
from stakeflow.operators.filters import period_filter
from stakeflow.operators.scan import attach, group_stats, top_per_key


def prediction_stats(predictions: DataFrame) -> DataFrame:
    """Accuracy by sport, market, level and in total; flags the best and worst sport."""
    p = predictions.withColumn("level", confidence_level(F.col("confidence")))
    dims = ["sport", "market", "level"]
    g = p.groupingSets([[F.col(d)] for d in dims] + [[]], *[F.col(d) for d in dims]).agg(
        F.grouping_id().alias("gid"), *prediction_aggs())
    name = F.when(F.col("gid") == 3, "sport").when(F.col("gid") == 5, "market").when(
        F.col("gid") == 6, "level").otherwise("total")
    rep = prediction_report(
        g.withColumn("dimension", name).withColumn("member", F.coalesce("sport", "market", "level", F.lit("all"))),
        ["dimension", "member"])
    # a handful of rows: one per member of each dimension
    w = Window.partitionBy("dimension")
    sport = F.col("dimension") == "sport"
    return rep.withColumn("best", sport & (F.col("member") == F.max_by("member", F.col("accuracy")).over(w))
                          ).withColumn("worst", sport & (F.col("member") == F.min_by("member", F.col("accuracy")).over(w)))


def analytics_overview(bets: DataFrame, predictions: DataFrame, trend: DataFrame, period: str = "all", now=None) -> DataFrame:
    """Ledger, prediction and trend figures per user over a period, with a part per sport and the best and worst sport.

    Bets count by ``placed_at``, predictions by ``created_at``; the period is 7d, 30d, 90d, 1y or all. The
    sports of a user rank by return on investment, equal ones by name. Each side is reduced
    before the join; totals and sports come from one aggregation.
    """
    if period not in ("7d", "30d", "90d", "1y", "all"):
        raise ValueError(f"unknown period {period!r}")
    if period != "all":
        bets, predictions = period_filter(bets, "placed_at", period, now), period_filter(predictions, "created_at", period, now)
    user, sport = F.col("user_id"), F.col("sport")
    g = settle_bets(bets).groupingSets([[user], [user, sport]], user, sport).agg(F.grouping_id().alias("gid"), *ledger_aggs())
    rows = ledger_report(g, ["user_id", "sport", "gid"])
    whole, part = F.col("gid") == 1, F.col("gid") == 0
    kept = ["total_bets", "won", "staked", "profit", "roi", "win_rate"]
    by_sport = F.sort_array(F.collect_list(F.when(part, F.struct("sport", "total_bets", "won", "profit", "roi", "win_rate"))))
    ledger = rows.groupBy("user_id").agg(
        *[F.max(F.when(whole, F.col(c))).alias(c) for c in kept], by_sport.alias("by_sport"),
        F.min_by("sport", F.when(part, F.struct(-F.col("roi"), F.col("sport")))).alias("best_sport"),
        F.min_by("sport", F.when(part, F.struct(F.col("roi"), F.col("sport")))).alias("worst_sport"))
    preds = prediction_report(predictions.groupBy("user_id").agg(*prediction_aggs()), ["user_id"]).select(
        "user_id", F.col("total").alias("total_predictions"), F.col("correct").alias("correct_predictions"), "accuracy")
    out = ledger.join(preds, "user_id", "full").join(trend.select("user_id", "trend"), "user_id", "left")
    return out.select(
        "user_id", *[F.coalesce(c, F.lit(0)).alias(n) for c, n in (
            ("total_bets", "total_bets"), ("won", "winning_bets"), ("total_predictions", "total_predictions"), ("correct_predictions", "correct_predictions"))],
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("staked", "profit", "roi", "win_rate", "accuracy")],
        "by_sport", "best_sport", "worst_sport", F.coalesce("trend", F.lit("stable")).alias("trend"))


def performance_by(bets: DataFrame, unit: str) -> DataFrame:
    """Win rate and profit per day, week or month."""
    g = settle_bets(bets).groupBy(F.date_trunc(unit, "placed_at").cast("timestamp_ntz").alias("period")).agg(*ledger_aggs())
    return ledger_report(g, ["period"]).select("period", "total_bets", "won", "lost", "win_rate", "profit", "roi")


def rollup_report(bets: DataFrame, dims: list[str]) -> DataFrame:
    g = settle_bets(bets).rollup(*dims).agg(F.grouping_id().cast("int").alias("level"), *ledger_aggs())
    return ledger_report(g, ["level", *dims]).select("level", *dims, "total_bets", "win_rate", "profit", "roi")


def admin_stats(bets: DataFrame, predictions: DataFrame, users: DataFrame, now, days: int = 7) -> DataFrame:
    """Platform figures of the last ``days`` days and of today, as one row.

    New users are counted today and over the last 7 and 30 days; accuracy is that of the predictions
    of the period.
    """
    at = as_time(now)
    today = ntz(dt.datetime.combine(at.date(), dt.time()))

    def last(n: int) -> Column:
        return ntz(at - dt.timedelta(days=n))

    b = settle_bets(bets).filter(F.col("placed_at") >= F.least(last(days), today)).agg(*[a.alias(n) for n, a in {
        "bets": F.count_if(F.col("placed_at") >= last(days)), "bets_today": F.count_if(F.col("placed_at") >= today),
        "active_users": F.count_distinct(F.when(F.col("placed_at") >= last(days), F.col("user_id"))),
        "wagered": r6(F.coalesce(F.sum(F.when(F.col("placed_at") >= last(days), F.col("stake"))), F.lit(0.0))),
        "user_profit": r6(F.coalesce(F.sum(F.when(F.col("placed_at") >= last(days), F.col("profit"))), F.lit(0.0)))}.items()])
    p = predictions.filter(F.col("created_at") >= F.least(last(days), today))
    recent = F.col("created_at") >= last(days)
    won, lost = (F.count_if(recent & (F.col("status") == x)) for x in ("won", "lost"))
    p = p.agg(F.count_if(recent).alias("predictions"), F.count_if(F.col("created_at") >= today).alias("predictions_today"),
              r6(ratio(won, won + lost, 100)).alias("accuracy"))
    joined = F.col("created_at")
    u = users.agg(F.count("*").alias("total_users"), F.count_if(joined >= today).alias("new_users_today"),
                  F.count_if(joined >= last(7)).alias("new_users_week"), F.count_if(joined >= last(30)).alias("new_users_month"))
    # one row each
    return b.crossJoin(p).crossJoin(u)


# Upper bounds of the latency histogram in milliseconds.
LATENCY_BOUNDS_MS = (100, 500, 1000)


def traffic_metrics(logs: DataFrame, keys: list[str]) -> DataFrame:
    """Requests, rate, mean latency, error share and cumulative latency counts."""
    d = F.col("duration_ms")
    g = logs.groupBy(*keys).agg(
        F.count("*").alias("requests"), F.sum(d).alias("total_ms"),
        F.count_if(F.col("status_code") >= 400).alias("errors"),
        F.min("ts").alias("t0"), F.max("ts").alias("t1"),
        *[F.count_if(d <= b).alias(f"le_{b}") for b in LATENCY_BOUNDS_MS])
    secs = F.timestamp_diff("SECOND", F.col("t0"), F.col("t1"))
    return g.select(
        *keys, "requests", r6(ratio(F.col("requests"), secs)).alias("rps"),
        r6(ratio(F.col("total_ms"), F.col("requests"))).alias("mean_ms"),
        r6(ratio(F.col("errors"), F.col("requests"), 100)).alias("error_pct"),
        *[f"le_{b}" for b in LATENCY_BOUNDS_MS], F.col("requests").alias("le_inf"))


def batch_outcome(results: DataFrame, key: str) -> DataFrame:
    """Successful and failed items per batch and whether they add up to the announced total."""
    g = results.groupBy(key).agg(
        F.count_if(F.col("error").isNull()).alias("successful"), F.count_if(F.col("error").isNotNull()).alias("failed"),
        F.max("announced").alias("announced"))
    return g.withColumn("consistent", F.col("successful") + F.col("failed") == F.col("announced"))


def value_bet_summary(values: DataFrame, keys: list[str]) -> DataFrame:
    return values.groupBy(*keys).agg(
        F.count("*").alias("total_found"), r6(F.avg("edge")).alias("average_edge"),
        r6(F.sum("expected_value")).alias("total_ev"))


def multi_sport_summary(predictions: DataFrame) -> DataFrame:
    """Per sport events, predictions, mean confidence and flat-stake ROI; total ROI is event-weighted."""
    won = F.col("status") == "won"
    decided = F.col("status").isin("won", "lost")
    g = predictions.groupBy("sport").agg(
        F.count_distinct("match_id").alias("events"), F.count("*").alias("predictions"),
        F.avg("confidence").alias("c"),
        F.sum(F.when(won, F.col("odds") - 1).when(decided, F.lit(-1.0))).alias("gain"),
        F.count_if(decided).alias("decided"))
    g = g.withColumn("roi", r6(ratio(F.col("gain"), F.col("decided"), 100)))
    total = g.agg(F.sum(F.col("roi") * F.col("events")) / F.sum("events")).scalar()
    return g.select("sport", "events", "predictions", r6(F.col("c")).alias("mean_confidence"), "roi",
                    r6(total).alias("total_roi"))


def sport_correlation(bets: DataFrame, sports: list[str]) -> DataFrame:
    """Pearson correlation of daily ROI for each pair of the given sports."""
    done = settle_bets(bets).filter("settled")
    daily = done.groupBy(F.to_date("placed_at").alias("day")).pivot("sport", sports).agg(
        r6(F.sum("profit") / F.sum("stake")))
    pairs = list(combinations(sorted(sports), 2))
    one = daily.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    long = one.unpivot([], [f"`{c}`" for c in one.columns], "pair", "c")
    both = F.split("pair", r"\|")
    return long.select(both[0].alias("sport_a"), both[1].alias("sport_b"), r6(F.col("c")).alias("correlation"))


def league_standings(sides: DataFrame) -> DataFrame:
    """Points 3-1-0; position by points, goal difference, goals for, name."""
    c = F.col
    t = sides.groupBy("league", "team").agg(*standings_aggs())
    t = t.withColumn("goal_difference", c("goals_for") - c("goals_against")).withColumn(
        "points", c("won") * 3 + c("drawn"))
    # teams of one league: a short list
    w = Window.partitionBy("league").orderBy(F.desc("points"), F.desc("goal_difference"), F.desc("goals_for"), "team")
    return t.withColumn("position", F.row_number().over(w))


def team_stats(sides: DataFrame) -> DataFrame:
    def record(side: str) -> Column:
        n = [F.count_if((F.col("side") == side) & (F.col("result") == r)) for r in "WDL"]
        return F.concat_ws("-", *n).alias(f"{side}_record")

    g = sides.groupBy("team").agg(*standings_aggs(), record("home"), record("away"))
    return g.withColumn("win_percentage", r6(ratio(F.col("won"), F.col("played"), 100)))


def head_to_head(matches: DataFrame, last: int = 3) -> DataFrame:
    """Record and last meetings of each unordered pair of teams."""
    done = matches.filter("status = 'finished'").select(
        F.least("home_team", "away_team").alias("team_a"), F.greatest("home_team", "away_team").alias("team_b"),
        "match_id", "match_date",
        F.when(F.col("home_team") < F.col("away_team"), F.col("home_score")).otherwise(F.col("away_score")).alias("sa"),
        F.when(F.col("home_team") < F.col("away_team"), F.col("away_score")).otherwise(F.col("home_score")).alias("sb"))
    keys = ["team_a", "team_b"]
    rec = done.groupBy(*keys).agg(
        F.count("*").alias("meetings"), F.count_if(F.col("sa") > F.col("sb")).alias("a_wins"),
        F.count_if(F.col("sa") == F.col("sb")).alias("draws"), F.count_if(F.col("sa") < F.col("sb")).alias("b_wins"))
    top = top_per_key(done, keys, [F.desc("match_date"), F.desc("match_id")], last, F.col("match_id"), salts=16)
    scores = F.transform(F.sort_array(F.collect_list(F.struct("rn", "sa", "sb"))),
                         lambda x: F.concat_ws("-", x["sa"], x["sb"]))
    return rec.join(top.groupBy(*keys).agg(F.array_join(scores, " ").alias("last_meetings")), keys)


#: Best price of a match and outcome; ties go to the smallest bookmaker id.
BEST_ODDS = {
    "best_odds": lambda: F.max("odds"), "best_bookmaker": lambda: F.max_by("bookmaker", F.struct(F.col("odds"), -F.col("bookmaker"))),
    "average_odds": lambda: F.avg("odds"), "quotes": lambda: F.count("*"),
}


def best_odds(quotes: DataFrame) -> DataFrame:
    """Best price per match and outcome."""
    return quotes.groupBy("match_id", "outcome").agg(*[c().alias(n) for n, c in BEST_ODDS.items()])


def odds_comparison(quotes: DataFrame) -> DataFrame:
    """Every price beside the best of its match and outcome."""
    return group_stats(quotes, ["match_id", "outcome"], {n: c() for n, c in BEST_ODDS.items()}).withColumn(
        "is_best", (F.col("odds") == F.col("best_odds")) & (F.col("bookmaker") == F.col("best_bookmaker")))


def public_vs_money(bets: DataFrame, event: str, outcome: str) -> DataFrame:
    """Share of tickets and of stakes per outcome of an event."""
    g = bets.groupBy(event, outcome).agg(F.count("*").alias("tickets"), F.sum("stake").alias("money"))
    w = Window.partitionBy(event)
    return g.select(
        event, outcome, "tickets", r6(F.col("money")).alias("money"),
        r6(F.col("tickets") * 100 / F.sum("tickets").over(w)).alias("ticket_share"),
        r6(F.col("money") * 100 / F.sum("money").over(w)).alias("money_share"))


def contrarian_plays(shares: DataFrame, threshold: float) -> DataFrame:
    return shares.filter((F.col("ticket_share") >= threshold) & (F.col("money_share") < F.col("ticket_share")))


def exposure(bets: DataFrame, bankroll: float, limit_pct: float = 15.0) -> DataFrame:
    g = bets.filter("status = 'pending'").groupBy("user_id").agg(
        F.count("*").alias("active_bets"), F.sum("stake").alias("s"))
    pct = r6(F.col("s") * 100 / bankroll)
    return g.select("user_id", "active_bets", r6(F.col("s")).alias("stake_at_risk"), pct.alias("exposure_pct"),
                    (pct <= limit_pct).alias("healthy"))


def concentration_risk(bets: DataFrame, dims: list[str]) -> DataFrame:
    """Share of a user's bets per member of each dimension, and the Herfindahl index."""
    g = bets.groupingSets([[F.col("user_id"), F.col(d)] for d in dims], F.col("user_id"), *[F.col(d) for d in dims]).agg(
        F.grouping_id().alias("gid"), F.count("*").alias("bets"))
    name, member = F.lit(None).cast("string"), F.lit(None).cast("string")
    full = (1 << len(dims)) - 1
    for i, d in enumerate(dims):
        hit = F.col("gid") == (full & ~(1 << (len(dims) - 1 - i)))
        name, member = F.when(hit, d).otherwise(name), F.when(hit, F.col(d)).otherwise(member)
    g = g.select("user_id", name.alias("dimension"), member.alias("member"), "bets")
    w = Window.partitionBy("user_id", "dimension")
    g = g.withColumn("share", r6(F.col("bets") / F.sum("bets").over(w)))
    return g.withColumn("hhi", F.round(F.sum(F.col("share") * F.col("share")).over(w), 8))


def bankroll_report(bets: DataFrame, starting: float, max_daily_loss: float, now) -> DataFrame:
    """Profit, today's activity and remaining loss budget.

    The budget shrinks by today's loss only: max_daily_loss + min(profit_today, 0).
    """
    s = settle_bets(bets)
    today = today_flag("placed_at", now)
    g = s.groupBy("user_id").agg(
        F.sum("profit").alias("p"), F.count_if(today).alias("bets_today"),
        F.coalesce(F.sum(F.when(today, F.col("profit"))), F.lit(0.0)).alias("pt"))
    cur = F.col("p") + starting
    return g.select(
        "user_id", r6(cur).alias("current_bankroll"), r6(F.col("p")).alias("profit_loss"),
        r6(F.col("p") * 100 / starting).alias("profit_loss_pct"), r6(cur * F.lit(0.02)).alias("max_stake_per_bet"),
        "bets_today", r6(F.col("pt")).alias("profit_today"),
        r6(F.lit(max_daily_loss) + F.least(F.col("pt"), F.lit(0.0))).alias("remaining_budget_today"))


def pattern_mining(bets: DataFrame, min_n: int) -> DataFrame:
    """Segments over weekday type, sport and favourite or not that occur at least ``min_n`` times."""
    s = settle_bets(bets).filter(F.col("status").isin("won", "lost")).select(
        F.when(F.weekday("placed_at") >= 5, "weekend").otherwise("weekday").alias("day_type"), "sport",
        F.when(F.col("odds") < 2, "favorite").otherwise("underdog").alias("side"), "status", "stake", "profit")
    g = s.cube("day_type", "sport", "side").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "won").alias("w"),
        F.sum("stake").alias("st"), F.sum("profit").alias("p")).filter(F.col("n") >= min_n)
    rate = r6(F.col("p") * 100 / F.col("st"))
    return g.select("day_type", "sport", "side", "n", r6(F.col("w") * 100 / F.col("n")).alias("win_rate"),
                    rate.alias("roi"), F.when(rate > 0, "winning").otherwise("losing").alias("pattern"))


def temporal_patterns(bets: DataFrame) -> DataFrame:
    """Per user: best weekday, best three-hour slot, weekend minus weekday win rate."""
    d = bets.filter(F.col("status").isin("won", "lost")).select(
        "user_id", F.weekday("placed_at").alias("wd"), (F.floor(F.hour("placed_at") / 3) * 3).cast("int").alias("slot"),
        (F.col("status") == "won").cast("int").alias("w"))
    # one row per user, weekday and slot (56 at most), then small aggregations per user
    cell = d.groupBy("user_id", "wd", "slot").agg(F.count("*").alias("n"), F.sum("w").alias("w"))

    def best(col: str, name: str) -> DataFrame:
        g = cell.groupBy("user_id", col).agg(r6(F.sum("w") / F.sum("n")).alias("rate"))
        return g.groupBy("user_id").agg(F.max_by(col, F.struct(F.col("rate"), -F.col(col))).alias(name))

    end = F.col("wd") >= 5

    def rate(c: Column) -> Column:
        return ratio(F.sum(F.when(c, F.col("w"))), F.sum(F.when(c, F.col("n"))), 100)

    split = cell.groupBy("user_id").agg(
        r6(rate(end)).alias("weekend_win_rate"), r6(rate(~end)).alias("weekday_win_rate"),
        r6(rate(end) - rate(~end)).alias("weekend_gap"))
    return best("wd", "best_weekday").join(best("slot", "best_slot"), "user_id").join(split, "user_id")


def banded_report(bets: DataFrame, band: Column, extra: tuple[Column, ...] = ()) -> DataFrame:
    """Decided bets by band: n, win rate, ROI."""
    s = settle_bets(bets).filter(F.col("status").isin("won", "lost"))
    return s.groupBy(band.alias("band")).agg(
        F.count("*").alias("n"), r6(win_rate(F.count_if(F.col("status") == "won"), F.count_if(F.col("status") == "lost"))).alias("win_rate"),
        r6(roi(F.sum("actual_return"), F.sum("stake"))).alias("roi"), *extra)


def learning_insights(bets: DataFrame, bankroll: float) -> DataFrame:
    """Win rate by stake share of bankroll, by market and by lead time before the event."""
    share = F.col("stake") / bankroll
    lead = F.timestamp_diff("MINUTE", F.col("placed_at"), F.col("match_date"))
    parts = [
        ("stake", F.when(share < 0.02, "below 2%").when(share < 0.05, "2-5%").otherwise("5% and more")),
        ("market", F.col("market")),
        ("lead_time", F.when(lead >= 120, "2h and more").otherwise("less than 2h")),
    ]
    # one pass over the ledger: every bet counts once per dimension, reduced before the shuffle
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), c.alias("band")) for n, c in parts]))
    s = bets.filter(F.col("status").isin("won", "lost")).select("status", cells.alias("x")).select("status", "x.*")
    return s.groupBy("dimension", "band").agg(
        F.count("*").alias("n"),
        r6(win_rate(F.count_if(F.col("status") == "won"), F.count_if(F.col("status") == "lost"))).alias("win_rate"))


def longshot_bias(bets: DataFrame) -> DataFrame:
    """ROI and win rate minus implied probability by odds band."""
    o = F.col("odds")
    band = F.when(o < 1.8, "1 favorite").when(o < 2.5, "2 even").when(o < 3.0, "3 outsider").otherwise("4 longshot")
    won = F.sum(F.when(F.col("status") == "won", 1.0).otherwise(0.0))
    return banded_report(bets, band, (
        r6(F.avg(1 / o) * 100).alias("implied_pct"), r6((won / F.count("*") - F.avg(1 / o)) * 100).alias("bias")))


def similar_bets_evidence(bets: DataFrame) -> DataFrame:
    """For each pending bet: the user's decided bets of the same sport and market."""
    s = settle_bets(bets)
    keys = ["user_id", "sport", "market"]
    past = s.filter(F.col("status").isin("won", "lost")).groupBy(*keys).agg(
        F.count("*").alias("n"), r6(F.count_if(F.col("status") == "won") * 100 / F.count("*")).alias("win_rate"),
        r6(roi(F.sum("actual_return"), F.sum("stake"))).alias("roi"))
    return attach(bets.filter("status = 'pending'"), past, keys, F.col("bet_id"), how="left").select(
        "bet_id", *keys, F.coalesce("n", F.lit(0)).alias("n"), "win_rate", "roi")


def live_dashboard(bets: DataFrame, now) -> DataFrame:
    """Open position and today's results per user."""
    s = settle_bets(bets)
    open_, today = F.col("status") == "pending", today_flag("placed_at", now)
    done = today & F.col("settled")
    return s.groupBy("user_id").agg(
        F.count_if(open_).alias("active_bets"),
        r6(F.coalesce(F.sum(F.when(open_, F.col("stake"))), F.lit(0.0))).alias("active_stake"),
        r6(F.coalesce(F.sum(F.when(open_, F.col("stake") * F.col("odds"))), F.lit(0.0))).alias("potential_return"),
        F.count_if(today & (F.col("status") == "won")).alias("won_today"),
        F.count_if(today & (F.col("status") == "lost")).alias("lost_today"),
        r6(F.coalesce(F.sum(F.when(done, F.col("profit"))), F.lit(0.0))).alias("profit_today"),
        r6(ratio(F.sum(F.when(done, F.col("profit"))), F.sum(F.when(done, F.col("stake"))), 100)).alias("roi_today"))


def daily_digest(matches: DataFrame, picks: DataFrame, value_bets: DataFrame, arbs: DataFrame, top: int = 3) -> DataFrame:
    """Counts per day and the ``top`` picks, most confident first.

    ``picks`` has (match_id, confidence); ``value_bets`` and ``arbs`` have match_id. Each is
    reduced to one row per match before it meets the schedule.
    """
    best = picks.groupBy("match_id").agg(F.count("*").alias("picks"), F.max("confidence").alias("confidence"))
    val = value_bets.groupBy("match_id").agg(F.count("*").alias("value_bets"))
    arb = arbs.select("match_id").distinct().withColumn("arb", F.lit(1))
    m = matches.select("match_id", F.to_date("match_date").alias("day"))
    j = m.join(best, "match_id", "left").join(val, "match_id", "left").join(arb, "match_id", "left")
    counts = j.groupBy("day").agg(
        F.count("*").alias("events"), F.coalesce(F.sum("picks"), F.lit(0)).alias("picks"),
        F.coalesce(F.sum("value_bets"), F.lit(0)).alias("value_bets"), F.count("arb").alias("arbitrages"))
    listed = top_per_key(m.join(best, "match_id"), ["day"], [F.desc("confidence"), F.asc("match_id")], top, F.col("match_id"))
    lists = listed.groupBy("day").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("rn", "match_id", "confidence"))), lambda x: F.struct(x["match_id"], x["confidence"])).alias("top_picks"))
    return counts.join(lists, "day", "left").withColumn("top_pick", F.get("top_picks", F.lit(0))["match_id"])


def digest_performance(bets: DataFrame, now) -> DataFrame:
    """Per user: return on investment of yesterday and of the seven days before today, and the current streak."""
    from stakeflow.operators.windows import streaks

    today = dt.datetime.combine(as_time(now).date(), dt.time())
    earlier = lambda n: F.col("placed_at") >= ntz(today - dt.timedelta(days=n))
    before = bets.filter(F.col("placed_at") < ntz(today))
    done = settle_bets(before.filter(earlier(7))).filter("settled")

    def of(days: int) -> Column:
        return r6(ratio(F.sum(F.when(earlier(days), F.col("profit"))), F.sum(F.when(earlier(days), F.col("stake"))), 100))

    recent = done.groupBy("user_id").agg(of(1).alias("yesterday_roi"), of(7).alias("week_roi"))
    run = streaks(before).select("user_id", F.abs("current").alias("current_streak"), F.when(F.col("current") > 0, "winning").otherwise("losing").alias("streak_type"))
    return run.join(recent, "user_id", "full").select(
        "user_id", F.coalesce("yesterday_roi", F.lit(0.0)).alias("yesterday_roi"), F.coalesce("week_roi", F.lit(0.0)).alias("week_roi"),
        F.coalesce("current_streak", F.lit(0)).alias("current_streak"), F.coalesce("streak_type", F.lit("none")).alias("streak_type"))


def parlay_odds(legs: DataFrame, key: str) -> DataFrame:
    """Combined odds of grouped leg rows."""
    return legs.groupBy(key).agg(F.count("*").alias("legs"), F.product("odds").alias("combined_odds"))


def parlay_odds_of(legs: Column) -> Column:
    """Combined odds of an array of leg structs."""
    return F.aggregate(legs, F.lit(1.0), lambda acc, leg: acc * leg["odds"])


def continuous_rollup(ticks: DataFrame, ts: str, bucket: str, keys: list[str], value: str) -> DataFrame:
    """Open, high, low, close, mean and count per key and time bucket."""
    at = F.col(ts).cast("timestamp")
    order = F.struct(F.col(ts), F.col("tick_id"))
    g = ticks.groupBy(*keys, F.window(at, bucket).alias("w")).agg(
        F.count("*").alias("n"), F.min_by(value, order).alias("open"), F.max(value).alias("high"),
        F.min(value).alias("low"), F.max_by(value, order).alias("close"), r6(F.avg(value)).alias("mean"))
    return g.withColumn("bucket", F.col("w.start").cast("timestamp_ntz")).drop("w")
