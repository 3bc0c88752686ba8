"""Searches and predicates. A null argument means no filter; filters reach the file scan."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stakeflow.functions.semantics import ADMIN_PERIOD_HOURS, as_time, ntz, period_days


def period_start(period: str, now) -> dt.datetime:
    return as_time(now) - dt.timedelta(days=period_days(period))


def period_filter(df: DataFrame, ts: str, period: str, now) -> DataFrame:
    """Rows since now minus the period; unknown periods count as 30 days."""
    return df.filter(F.col(ts) >= ntz(period_start(period, now)))


def admin_period_filter(df: DataFrame, ts: str, period: str, now) -> DataFrame:
    """As :func:`period_filter`, with 24h and without a fallback."""
    if period not in ADMIN_PERIOD_HOURS:
        raise ValueError(f"unknown period {period!r}, expected one of {sorted(ADMIN_PERIOD_HOURS)}")
    start = as_time(now) - dt.timedelta(hours=ADMIN_PERIOD_HOURS[period])
    return df.filter(F.col(ts) >= ntz(start))


def where_all(df: DataFrame, *conditions: Column | None) -> DataFrame:
    for c in conditions:
        if c is not None:
            df = df.filter(c)
    return df


def equals(column: str, value) -> Column | None:
    return None if value is None else F.col(column) == value


def at_least(column: str, value) -> Column | None:
    return None if value is None else F.col(column) >= value


def at_most(column: str, value) -> Column | None:
    return None if value is None else F.col(column) <= value


def since(column: str, value) -> Column | None:
    return None if value is None else F.col(column) >= ntz(value)


def until(column: str, value) -> Column | None:
    return None if value is None else F.col(column) <= ntz(value)


def contains_ci(column: str, text: str | None) -> Column | None:
    return None if text is None else F.lower(column).contains(text.lower())


def match_search(matches: DataFrame, sport=None, league=None, team=None, date_from=None, date_to=None,
                 status=None, has_odds=None, important_only=False, odds: DataFrame | None = None) -> DataFrame:
    """Matches by any mix of criteria; a team matches on either side."""
    side = None if team is None else (F.col("home_team") == team) | (F.col("away_team") == team)
    out = where_all(
        matches, equals("sport", sport), equals("league", league), side, since("match_date", date_from),
        until("match_date", date_to), equals("status", status),
        F.col("is_important") if important_only else None)
    if has_odds is not None:
        if odds is None:
            raise ValueError("has_odds needs the quotes table")
        out = out.join(odds.select("match_id"), "match_id", "left_semi" if has_odds else "left_anti")
    return out


def team_search(teams: DataFrame, league=None, search=None) -> DataFrame:
    return where_all(teams, equals("league", league), contains_ci("name", search))


def prediction_search(predictions: DataFrame, sport=None, status=None, level=None, date_from=None,
                      date_to=None, value_bets_only=False, min_confidence=None) -> DataFrame:
    from stakeflow.functions.semantics import confidence_level
    value = F.col("confidence") / 100 * F.col("odds") > 1 if value_bets_only else None
    wanted = None if level is None else confidence_level(F.col("confidence")) == level
    return where_all(
        predictions, equals("sport", sport), equals("status", status), wanted, since("created_at", date_from),
        until("created_at", date_to), value, at_least("confidence", min_confidence))


def _check_range(name: str, low, high) -> None:
    if low is not None and high is not None and low > high:
        raise ValueError(f"{name}: minimum {low} is above maximum {high}")


def bet_search(bets: DataFrame, status=None, bet_type=None, sport=None, date_from=None, date_to=None,
               min_stake=None, max_stake=None, min_odds=None, max_odds=None) -> DataFrame:
    _check_range("stake", min_stake, max_stake)
    _check_range("odds", min_odds, max_odds)
    return where_all(
        bets, equals("status", status), equals("bet_type", bet_type), equals("sport", sport),
        since("placed_at", date_from), until("placed_at", date_to), at_least("stake", min_stake),
        at_most("stake", max_stake), at_least("odds", min_odds), at_most("odds", max_odds))


def activity_log(events: DataFrame, activity_type=None, user=None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest activities, one page of at most 100."""
    page = where_all(events, equals("event_type", activity_type), equals("user_id", user))
    return page.orderBy(F.desc("ts"), F.desc("event_id")).offset(offset).limit(min(limit, 100))


def alerts(events: DataFrame, active_only: bool = True, severity=None) -> DataFrame:
    return where_all(events, F.col("is_active") if active_only else None, equals("severity", severity))


def notifications(notes: DataFrame, user, limit: int = 50, unread_only: bool = False) -> DataFrame:
    """Newest notifications of a user with the unread count taken before the filter."""
    mine = notes.filter(F.col("user_id") == user)
    unread = mine.agg(F.count_if(~F.col("is_read"))).scalar()
    shown = where_all(mine, ~F.col("is_read") if unread_only else None)
    return (shown.orderBy(F.desc("created_at"), F.desc("notification_id")).limit(limit)
            .withColumn("unread_count", unread))


def upcoming_matches(matches: DataFrame, now, hours: int = 24) -> DataFrame:
    end = as_time(now) + dt.timedelta(hours=hours)
    return matches.filter((F.col("match_date") >= ntz(now)) & (F.col("match_date") <= ntz(end)))


def today_matches(matches: DataFrame, now) -> DataFrame:
    """Scheduled matches of the day, as a timestamp range so that it can be pushed down."""
    day = as_time(now).replace(hour=0, minute=0, second=0, microsecond=0)
    return matches.filter((F.col("match_date") >= ntz(day)) & (F.col("match_date") < ntz(day + dt.timedelta(days=1)))
                          & (F.col("status") == "scheduled"))


def live_matches(matches: DataFrame) -> DataFrame:
    return matches.filter(F.col("status") == "live")


def bet_admission(bets: DataFrame, balances: DataFrame, predictions: DataFrame) -> DataFrame:
    """Accept or reject requests: balance first, then a known prediction, then match not started.

    ``balances`` is (user_id, balance), ``predictions`` is (prediction_id, match_date); both unique.
    """
    joined = bets.join(balances, "user_id", "left").join(
        predictions.withColumn("_known", F.lit(True)), "prediction_id", "left")
    reason = (
        F.when(F.coalesce(F.col("balance"), F.lit(0.0)) < F.col("stake"), "insufficient_balance")
        .when(F.col("_known").isNull(), "prediction_not_found")
        .when(F.col("match_date") <= F.col("placed_at"), "match_started"))
    return joined.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull()).drop("_known")


def cashout_eligible() -> Column:
    return (F.col("status") == "pending") & F.coalesce(F.col("cashout_available"), F.lit(False))


def cancel_eligible() -> Column:
    return (F.col("status") == "pending") & ~F.coalesce(F.col("match_started"), F.lit(False))


def subscription_rules(subs: DataFrame, now) -> DataFrame:
    """Flags: can be reactivated, can be refunded on immediate cancellation."""
    days = F.floor(F.timestamp_diff("SECOND", F.col("period_start"), ntz(now)) / 86400)
    return subs.withColumn(
        "reactivable", (F.col("status") == "canceled") & (ntz(now) <= F.col("period_end"))
    ).withColumn("refund_eligible", F.col("immediate") & (days < 7))


def public_profiles(users: DataFrame, preferences: DataFrame) -> DataFrame:
    return users.join(preferences.filter("public_profile"), "user_id")
