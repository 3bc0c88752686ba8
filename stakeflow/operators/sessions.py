"""Batch twins of the session and late-data streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stakeflow.operators.scan import PLACE, dense, placed, running
from stakeflow.session import written


def user_sessions(events: DataFrame, gap_seconds: int = 3600) -> DataFrame:
    """Sessions per user: a gap longer than ``gap_seconds`` starts a new one.

    Session numbers are running counts; a user with most of the events is spread over many tasks.
    """
    order = ["ts", "event_id"]

    def number(rows: DataFrame, block: Column | None) -> DataFrame:
        prev = running(rows, ["user_id"], order, block, {"_prev": ("lag", F.col("ts"))}, split=False)
        gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("_prev").cast("timestamp"))
        fresh = prev.withColumn("_new", (F.col("_prev").isNull() | (gap >= gap_seconds * 1_000_000)).cast("long"))
        fresh = fresh if block is None else written(fresh, "gaps")
        return running(fresh, ["user_id"], order, block, {"_no": ("sum", F.col("_new"))}, split=False).drop(PLACE)

    return dense(events.select("user_id", "ts", "event_id"), ["user_id"], order, number, "activity").groupBy("user_id", "_no").agg(
        F.min("ts").alias("start"), (F.max("ts") + F.make_dt_interval(secs=F.lit(gap_seconds))).alias("end"), F.count("*").alias("events")).drop("_no")


def late_data_report(arrivals: DataFrame, seconds: int) -> DataFrame:
    """Rows whose event time lies more than ``seconds`` behind the newest seen before their arrival."""
    order = ["arrived", "event_id"]
    out = running(placed(arrivals, [], order, "arrivals"), [], order, F.col(PLACE), {"_newest": ("max_before", F.col("ts"))})
    late = F.unix_micros(F.col("_newest").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return out.withColumn("late_seconds", F.floor(late / 1_000_000)).filter(late > seconds * 1_000_000).drop("_newest", PLACE)
