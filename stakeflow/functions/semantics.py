"""Rules that every ledger and prediction operator shares, as Column functions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Report periods in days, by key; unknown keys fall back to 30 days.
PERIOD_DAYS = {"7d": 7, "30d": 30, "90d": 90, "1y": 365, "all": 3650}
ADMIN_PERIOD_HOURS = {"24h": 24, "7d": 7 * 24, "30d": 30 * 24, "90d": 90 * 24}

# Accepted entity states.
BET_STATUS = ("pending", "won", "lost", "void", "cashed_out")
MATCH_STATUS = ("scheduled", "live", "finished", "postponed", "cancelled")
SETTLED = ("won", "lost", "void", "cashed_out")

# Confidence thresholds, highest first.
CONFIDENCE_LEVELS = ((80.0, "very_high"), (70.0, "high"), (60.0, "medium"))


def r6(c: Column) -> Column:
    """Rounding used by every report column."""
    return F.round(c, 6)


def ratio(num: Column, den: Column, scale: float = 1.0) -> Column:
    """num / den * scale as double; 0.0 where the denominator is zero or null."""
    num, den = num.cast("double"), den.cast("double")
    return F.coalesce(F.try_divide(num * F.lit(float(scale)), den), F.lit(0.0))


def bet_return(status: Column, stake: Column, odds: Column, cashout: Column) -> Column:
    """Amount paid back: won stake*odds, void stake, cashed out its value, otherwise 0."""
    return (
        F.when(status == "won", stake * odds)
        .when(status == "void", stake)
        .when(status == "cashed_out", F.coalesce(cashout, F.lit(0.0)))
        .otherwise(F.lit(0.0))
    )


def is_settled(status: Column) -> Column:
    return status.isin(*SETTLED)


def confidence_level(conf: Column) -> Column:
    level = F.lit("low")
    for bound, name in reversed(CONFIDENCE_LEVELS):
        level = F.when(conf >= bound, name).otherwise(level)
    return level


def win_rate(won: Column, lost: Column) -> Column:
    return ratio(won, won + lost, 100)


def roi(returned: Column, staked: Column) -> Column:
    return ratio(returned - staked, staked, 100)


def period_days(period: str) -> int:
    return PERIOD_DAYS.get(period, 30)


def as_time(now: dt.datetime | str) -> dt.datetime:
    return dt.datetime.fromisoformat(now) if isinstance(now, str) else now


def ntz(value: dt.datetime | str) -> Column:
    """Literal without a time zone; it compares with either timestamp type."""
    return F.lit(as_time(value).isoformat(sep=" ")).cast("timestamp_ntz")


def kelly(p: Column, odds: Column) -> Column:
    """Full Kelly share (p*odds - 1) / (odds - 1), never below zero."""
    return F.greatest(F.lit(0.0), ratio(p * odds - 1, odds - 1))
