"""Ordered ledger and price analytics, built on the blocked scans of :mod:`scan`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stakeflow.functions.semantics import r6, ratio
from stakeflow.operators.aggregates import settle_bets
from stakeflow.operators.scan import (
    BLOCK, PLACE, dense, group_stats, ranked, running, time_block, top_per_key, trailing_rows, trailing_time,
)
from stakeflow.session import written

BET_ORDER = ["placed_at", "bet_id"]


def daily_profit(bets: DataFrame, keys: list[str]) -> DataFrame:
    """Settled profit and stake per key and day."""
    done = settle_bets(bets).filter("settled")
    return done.groupBy(*keys, F.to_date("placed_at").alias("day")).agg(
        r6(F.sum("profit")).alias("profit"), r6(F.sum("stake")).alias("staked"), F.count("*").alias("bets"))


def streaks(bets: DataFrame, key: str = "user_id") -> DataFrame:
    """Longest winning and losing run and the signed current run; other states are skipped.

    A run of wins is the set of wins that share the number of losses before them, and vice
    versa, so one running count per row and two aggregations are enough.
    """
    decided = bets.filter(F.col("status").isin("won", "lost")).select(
        key, *BET_ORDER, (F.col("status") == "won").alias("win"))
    counted = running(decided, [key], BET_ORDER, time_block("placed_at"), {
        "_wins": ("sum", F.col("win").cast("long")), "_all": ("count", F.lit(1))})
    other = F.when(F.col("win"), F.col("_all") - F.col("_wins")).otherwise(F.col("_wins"))
    runs = counted.groupBy(key, "win", other.alias("run")).agg(
        F.count("*").alias("n"), F.max("_all").alias("last_pos"))
    return runs.groupBy(key).agg(
        F.coalesce(F.max(F.when(F.col("win"), F.col("n"))), F.lit(0)).alias("longest_win"),
        F.coalesce(F.max(F.when(~F.col("win"), F.col("n"))), F.lit(0)).alias("longest_loss"),
        F.max_by(F.when(F.col("win"), F.col("n")).otherwise(-F.col("n")), "last_pos").alias("current"),
    )


def profit_timeline(bets: DataFrame, key: str = "user_id") -> DataFrame:
    done = settle_bets(bets).filter("settled")
    return running(done, [key], BET_ORDER, time_block("placed_at"), {"cumulative": ("sum", F.col("profit"))})


def max_drawdown(bets: DataFrame, key: str = "user_id", bankroll: float = 1000.0) -> DataFrame:
    """Largest fall of cumulative profit from its peak (the peak starts at 0).

    Each block keeps its total, its extreme prefixes and its own drawdown; blocks are then
    combined in order. Rows are shuffled once.
    """
    done = settle_bets(bets).filter("settled").withColumn(BLOCK, time_block("placed_at"))
    inside = Window.partitionBy(key, BLOCK).orderBy(*BET_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    rows = done.select(key, BLOCK, *BET_ORDER, "profit", F.sum("profit").over(inside).alias("prefix"))
    rows = rows.withColumn("peak", F.max("prefix").over(inside))
    blocks = rows.groupBy(key, BLOCK).agg(
        F.sum("profit").alias("total"), F.max("prefix").alias("top"), F.min("prefix").alias("low"),
        F.max(F.col("peak") - F.col("prefix")).alias("fall"))
    before = Window.partitionBy(key).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("carry", F.coalesce(F.sum("total").over(before), F.lit(0.0)))
    blocks = blocks.withColumn("peak_before", F.greatest(
        F.lit(0.0), F.max(F.col("carry") + F.col("top")).over(before)))
    fall = F.greatest("fall", F.col("peak_before") - F.col("carry") - F.col("low"))
    out = blocks.groupBy(key).agg(
        F.greatest(F.lit(0.0), F.max(fall)).alias("d"),
        F.greatest(F.lit(0.0), F.max(F.col("carry") + F.col("top"))).alias("peak"))
    return out.select(key, r6(F.col("d")).alias("max_drawdown"),
                      r6(ratio(F.col("d"), F.col("peak") + bankroll, 100)).alias("max_drawdown_pct"))


def sharpe_sortino(bets: DataFrame, key: str = "user_id") -> DataFrame:
    daily = daily_profit(bets, [key]).withColumn("r", ratio(F.col("profit"), F.col("staked")))
    down = F.least(F.col("r"), F.lit(0.0))
    g = daily.groupBy(key).agg(F.count("*").alias("days"), F.avg("r").alias("m"), F.stddev_samp("r").alias("sd"),
                               F.sqrt(F.avg(down * down)).alias("dd"))
    return g.select(key, "days", r6(F.col("m")).alias("mean_return"), r6(F.col("sd")).alias("volatility"),
                    r6(F.try_divide("m", "sd")).alias("sharpe"), r6(F.try_divide("m", "dd")).alias("sortino"))


def var_es(bets: DataFrame, key: str = "user_id", alpha: float = 0.05) -> DataFrame:
    """Value at risk and expected shortfall of daily profit, as positive losses.

    A key holds at most one row per day of history here, so its exact percentile is small.
    """
    daily = daily_profit(bets, [key])
    q = daily.groupBy(key).agg(r6(F.percentile("profit", F.lit(alpha))).alias("q"))
    return daily.join(q, key).groupBy(key).agg(
        r6(-F.max("q")).alias("var"),
        r6(-F.avg(F.when(F.col("profit") <= F.col("q"), F.col("profit")))).alias("es"))


def win_loss_profile(bets: DataFrame, key: str = "user_id") -> DataFrame:
    p = F.col("profit")
    g = settle_bets(bets).filter("settled").groupBy(key).agg(
        F.avg(F.when(p > 0, p)).alias("aw"), F.avg(F.when(p < 0, p)).alias("al"),
        F.sum(F.when(p > 0, p)).alias("sw"), F.sum(F.when(p < 0, p)).alias("sl"),
        F.max(F.when(p > 0, p)).alias("bw"), F.min(F.when(p < 0, p)).alias("bl"))
    return g.select(
        key, r6(F.col("aw")).alias("average_win"), r6(F.col("al")).alias("average_loss"),
        r6(F.try_divide(F.coalesce("sw", F.lit(0.0)), F.abs("sl"))).alias("profit_factor"),
        r6(F.col("bw")).alias("biggest_win"), r6(F.col("bl")).alias("biggest_loss"))


METRICS = ("accuracy", "roi", "win_rate", "total_profit")


def leaderboard(stats: DataFrame, metric: str, limit: int, me=None) -> DataFrame:
    """Users up to rank ``limit`` (ties share a rank) and the asking user's own row."""
    metric = "total_profit" if metric == "profit" else metric
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    if not 5 <= limit <= 100:
        raise ValueError("limit must be between 5 and 100")
    stats = written(stats, "stats")  # one row per user, read three times
    value, own = F.col(metric), F.lit(False) if me is None else F.col("user_id") == me
    # the values of the first ``limit`` users, and the asking user's: at most ``limit`` + 1 rows
    shown = {r[0] for r in stats.filter(value.isNotNull()).orderBy(F.desc(metric)).limit(limit).select(metric).collect()}
    asked = {r[0] for r in stats.filter(own & value.isNotNull()).select(metric).limit(1).collect()}
    places = sorted(shown | asked, reverse=True)
    counts = stats.agg(F.count(metric), *[f(c) for v in places for f, c in ((F.count_if, value > v), (F.count_if, value < v))]).first()
    last = max(1, counts[0] - 1)
    table = [(v, counts[1 + 2 * i] + 1, counts[2 + 2 * i] / last if counts[0] > 1 else 0.0) for i, v in enumerate(places)]
    kind = stats.schema[metric].dataType.simpleString()
    ranks = stats.sparkSession.createDataFrame([*table, (None, counts[0] + 1, 0.0)], f"_value {kind}, rank long, percentile double")
    out = stats.join(F.broadcast(ranks), value.eqNullSafe(F.col("_value")))
    return out.filter((F.col("rank") <= limit) | own).drop("_value")


def performance_comparison(stats: DataFrame, metric: str) -> DataFrame:
    """Own value, mean of all users, percentile and whether the user is a top performer."""
    mean = stats.agg(F.avg(metric)).scalar()
    return ranked(stats, [], metric).select(
        "user_id", F.col(metric).alias("value"), r6(mean).alias("mean"),
        r6(F.col("percentile") * 100).alias("percentile"), (F.col("percentile") >= 0.9).alias("top_performer"))


def recent_form(sides: DataFrame, n: int = 5) -> DataFrame:
    """Last ``n`` results of each team, newest first."""
    if not 1 <= n <= 10:
        raise ValueError("n must be between 1 and 10")
    top = top_per_key(sides, ["team"], [F.desc("match_date"), F.desc("match_id")], n, F.col("match_id"))
    seq = F.sort_array(F.collect_list(F.struct("rn", "result")))
    return top.groupBy("team").agg(F.array_join(F.transform(seq, lambda x: x["result"]), "").alias("form"))


def odds_movement(ticks: DataFrame, keys: list[str], label: str, order: list[str]) -> DataFrame:
    """Previous price, movement and a label such as home_shortening."""
    out = running(ticks, keys, order, time_block(order[0]), {"previous_odds": ("lag", F.col("odds"))})
    move = r6(F.col("odds") - F.col("previous_odds"))
    return out.withColumn("movement", move).withColumn(
        "trend", F.when(F.col("movement") < 0, F.concat(F.col(label), F.lit("_shortening")))
        .when(F.col("movement") > 0, F.concat(F.col(label), F.lit("_drifting"))).otherwise("stable"))


def line_movement(ticks: DataFrame, steam_pct: float, steam_seconds: int) -> DataFrame:
    """Opening and current price per side, ticket share, reverse-line and steam flags."""
    keys = ["match_id", "bookmaker"]
    place = F.struct("ts", "tick_id")
    high = trailing_time(ticks, keys, "ts", steam_seconds, {"_high": F.max("odds")})
    drop = r6((F.col("_high") - F.col("odds")) / F.col("_high") * 100)
    sides = high.groupBy(*keys).agg(
        F.min_by("odds", place).alias("opening"), F.max_by("odds", place).alias("current"),
        F.count("*").alias("tickets"), F.max(drop).alias("largest_drop_pct"))
    # one row per side of a match, so this partition is small
    share = F.col("tickets") / F.sum("tickets").over(Window.partitionBy("match_id"))
    sides = sides.withColumn("ticket_share", r6(share))
    return sides.withColumn("movement", r6(F.col("current") - F.col("opening"))).withColumn(
        "reverse_line", (F.col("movement") < 0) & (F.col("ticket_share") < 0.5)
    ).withColumn("steam", F.col("largest_drop_pct") > steam_pct)


def profit_trend(bets: DataFrame, key: str = "user_id", tolerance: float = 0.5) -> DataFrame:
    """Direction of daily profit by its regression slope; flat within the tolerance per day."""
    daily = daily_profit(bets, [key]).withColumn("x", F.unix_date("day").cast("double"))
    g = daily.groupBy(key).agg(F.regr_slope("profit", "x").alias("s"))
    s = F.coalesce(F.col("s"), F.lit(0.0))
    return g.select(key, r6(s).alias("slope"), F.when(s > tolerance, "up").when(s < -tolerance, "down")
                    .otherwise("stable").alias("trend"))


def prediction_updates(updates: DataFrame) -> DataFrame:
    """Confidence before and after each update, its change and the change since the first."""
    out = running(updates, ["prediction_id"], ["ts", "update_id"], time_block("ts"), {
        "confidence_before": ("lag", F.col("confidence")), "original": ("first", F.col("confidence"))})
    return out.withColumn("change", F.col("confidence") - F.col("confidence_before")).withColumn(
        "since_original", F.col("confidence") - F.col("original"))


def rolling_variance(bets: DataFrame, key: str = "user_id", days: int = 30) -> DataFrame:
    """Variance of profit within the day and of daily profit over the trailing days.

    The window runs on one row per key and day.
    """
    done = settle_bets(bets).filter("settled")
    daily = done.groupBy(key, F.to_date("placed_at").alias("day")).agg(
        r6(F.sum("profit")).alias("profit"), F.var_samp("profit").alias("v"))
    w = Window.partitionBy(key).orderBy(F.unix_date("day")).rangeBetween(-(days - 1), 0)
    return daily.select(key, "day", F.col("v").alias("day_variance"),
                        F.var_samp("profit").over(w).alias("rolling_variance"))


def rolling_team_features(sides: DataFrame, n: int = 5) -> DataFrame:
    """Goals over the last ``n`` matches, head-to-head win rate and rest days, all before kick-off."""
    order = ["match_date", "match_id"]

    def features(rows: DataFrame, block: Column | None) -> DataFrame:
        goals = trailing_rows(rows, ["team"], order, block, n, {
            "gf_sum": F.sum("gf"), "ga_sum": F.sum("ga"), "last_n": F.count("*")}, also={"_previous": ("lag", F.col("match_date"))}, split=False)
        met = {"_met": ("sum_before", F.lit(1)), "_beat": ("sum_before", (F.col("result") == "W").cast("long"))}
        if block is None:  # pairs of a light team lie in its task
            return running(goals, ["team", "opponent"], order, None, met)
        # a pair meets rarely: wider blocks, fewer carried rows
        return running(written(goals.drop(PLACE), "goals"), ["team", "opponent"], order, time_block("match_date", "month"), met)

    return dense(sides.select("team", "opponent", "result", "gf", "ga", *order), ["team"], order, features, "sides").select(
        "team", "match_id", "last_n", r6(F.try_divide(F.col("gf_sum"), F.col("last_n"))).alias("goals_for_avg"),
        r6(F.try_divide(F.col("ga_sum"), F.col("last_n"))).alias("goals_against_avg"),
        r6(F.try_divide(F.col("_beat").cast("double"), F.col("_met"))).alias("h2h_win_rate"),
        F.datediff("match_date", "_previous").alias("rest_days"))


def failed_login_run(events: DataFrame, failure: Column, success: Column) -> DataFrame:
    """Failures since the user's last success, at each event."""
    order = ["ts", "event_id"]

    def since(rows: DataFrame, block: Column | None) -> DataFrame:
        counted = running(rows, ["user_id"], order, block, {"_fails": ("sum", F.col("_fail"))}, split=False)
        counted = counted if block is None else written(counted, "fails")
        out = running(counted, ["user_id"], order, block, {"_at": ("last", F.when(F.col("_reset"), F.col("_fails")))}, split=False)
        return out.drop(PLACE)

    reset = dense(events.withColumns({"_fail": failure.cast("long"), "_reset": success}), ["user_id"], order, since)
    return reset.withColumn("failed_attempts", F.col("_fails") - F.coalesce(F.col("_at"), F.lit(0))).select(*events.columns, "failed_attempts")


def loss_chasing(bets: DataFrame, key: str = "user_id") -> DataFrame:
    """Bets right after a loss with more than the user's mean stake: how many and their profit."""
    done = settle_bets(bets).filter("settled").select(key, *BET_ORDER, "status", "stake", "profit")
    prior = running(group_stats(done, [key], {"_mean": F.avg("stake")}), [key], BET_ORDER, time_block("placed_at"), {"_prev": ("lag", F.col("status"))})
    prior = prior.withColumn("mean_stake", r6(F.col("_mean")))
    after = F.col("_prev") == "lost"
    chase = after & (F.col("stake") > F.col("mean_stake"))
    return prior.groupBy(key).agg(
        F.max("mean_stake").alias("mean_stake"),
        F.round(F.avg(F.when(after, F.col("stake"))), 8).alias("mean_stake_after_loss"),
        F.count_if(chase).alias("chasing_bets"),
        r6(F.coalesce(F.sum(F.when(chase, F.col("profit"))), F.lit(0.0))).alias("chasing_profit"))


def current_session(activity: DataFrame) -> DataFrame:
    """Flag the user's latest activity as the current session."""
    return group_stats(activity, ["user_id"], {"_latest": F.max(F.struct("ts", "event_id"))}).withColumn(
        "is_current", F.col("event_id") == F.col("_latest")["event_id"]).drop("_latest")


def live_probability_shift(updates: DataFrame, n: int = 3) -> DataFrame:
    """Change since the pre-match confidence, shift per key event, sign of the last ``n`` shifts."""
    order, block = ["ts", "update_id"], time_block("ts")
    # the last n shifts add up to now minus the value n rows back
    out = trailing_rows(updates, ["prediction_id"], order, block, n, {"_back": F.first("confidence")}, also={
        "_prev": ("lag", F.col("confidence")), "pre_match": ("first", F.col("confidence"))})
    return out.select(
        "prediction_id", "update_id", "key_event", "confidence", "pre_match",
        (F.col("confidence") - F.col("pre_match")).alias("change"),
        (F.col("confidence") - F.col("_prev")).alias("shift"),
        F.signum(F.col("confidence") - F.col("_back")).alias("momentum"))
