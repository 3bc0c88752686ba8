"""Scans, lake zones, star tables, exports, snapshots and retention."""

from pyspark.sql import functions as F

from stakeflow.functions.semantics import ntz, r6
from stakeflow.operators.reports import continuous_rollup
from stakeflow.plans.registry import query
from stakeflow.session import shared_dir
from stakeflow.sources import sinks as S
from stakeflow.sources.tables import scan_entity

NOW = "2024-01-31 00:00:00"


@query("scan_entity", "", "SELECT event_id, user_id, event_type, value FROM events WHERE value > 100 AND ts >= TIMESTAMP '2024-01-15'")
def _(t):
    rows = scan_entity(t.spark, t.file("events"), "event_row")
    return rows.filter((F.col("value") > 100) & (F.col("ts") >= ntz("2024-01-15"))).select("event_id", "user_id", "event_type", "value")


@query("export_report_csv", "v_bet", "SELECT 'csv' AS format, count(*) AS record_count FROM v_bet WHERE status = 'won'")
def _(t):
    out = S.export_report(t.bet.filter("status = 'won'"), shared_dir(t.spark, "export"), "csv")
    return out.select("format", "record_count")


@query("export_report_json", "v_bet", "SELECT 'json' AS format, count(*) AS record_count FROM v_bet WHERE status = 'lost'")
def _(t):
    out = S.export_report(t.bet.filter("status = 'lost'"), shared_dir(t.spark, "export"), "json")
    return out.select("format", "record_count")


@query("lake_refine", "", """SELECT CAST(ts AS DATE) AS day, event_id AS id, upper(event_type) AS kind, value AS amount FROM events
   WHERE value BETWEEN 1 AND 200 AND CAST(json_extract_string(props, '$.k') AS INT) < 95""")
def _(t):
    zones = S.lake_refine(
        t.events, shared_dir(t.spark, "lake"),
        clean={"event_type": F.upper(F.trim("event_type")), "k": F.get_json_object("props", "$.k").try_cast("int")},
        valid=F.col("value").between(1, 200) & (F.col("k") < 95),
        mapping={"event_id": "id", "event_type": "kind", "value": "amount"}, day=F.to_date("ts"))
    return zones["normalized"].select("day", "id", "kind", "amount")


@query("build_star", "", """SELECT c_mktsegment AS segment, CAST(year(o_orderdate) AS INT) AS year, count(*) AS orders, round(sum(o_totalprice), 2) AS total
   FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")
def _(t):
    fact = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", F.year("o_orderdate").alias("year"))
    star = S.build_star(shared_dir(t.spark, "star"), fact, {"customer": t.customer.select("c_custkey", "c_mktsegment")}, "year")
    return star["fact"].join(star["customer"], F.col("o_custkey") == F.col("c_custkey")).groupBy(
        F.col("c_mktsegment").alias("segment"), "year").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("snapshot_full", "", "SELECT o_orderkey, o_totalprice FROM orders")
def _(t):
    return S.snapshot(t.orders, shared_dir(t.spark, "snapshot"), "full").select("o_orderkey", "o_totalprice")


@query("snapshot_incremental", "", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate > TIMESTAMP '2000-06-01'")
def _(t):
    return S.snapshot(t.orders, shared_dir(t.spark, "snapshot"), "incremental", "o_orderdate", "2000-06-01").select("o_orderkey", "o_totalprice")


@query("retention", "", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-04-20 07:30:00' - INTERVAL 90 DAY")
def _(t):
    out = shared_dir(t.spark, "by-day")
    S.write_by_day(t.events, out, "ts")
    return S.retain(t.spark, out, "ts", "2024-04-20 07:30:00").select("event_id", "ts")


@query("continuous_rollup_refresh", "v_tick", """SELECT match_id, time_bucket(INTERVAL 1 DAY, ts) AS bucket, count(*) AS n, arg_min(odds, (ts, tick_id)) AS open, max(odds) AS high, min(odds) AS low,
   arg_max(odds, (ts, tick_id)) AS close, round(avg(odds), 6) AS mean FROM v_tick GROUP BY 1, 2""")
def _(t):
    since = "2024-01-20"
    out = shared_dir(t.spark, "rollup")

    def roll(rows):
        return continuous_rollup(rows, "ts", "1 day", ["match_id"], "odds")

    roll(t.tick.filter(F.col("ts") < ntz("2024-01-25"))).write.parquet(out)
    return S.refresh_rollup(t.spark.read.parquet(out), roll(t.tick.filter(F.col("ts") >= ntz(since))), "bucket", since)


@query("user_rule_scan", "", "SELECT 'value:even_cents' AS rule, count(*) FILTER (CAST(round(value * 100) AS BIGINT) % 2 = 0) AS passed, count(*) FILTER (CAST(round(value * 100) AS BIGINT) % 2 <> 0) AS failed FROM events")
def _(t):
    import pandas as pd

    from stakeflow.functions.udfs import register_pandas_rule
    from stakeflow.operators.quality import dq_rules

    def even_cents(v: pd.Series) -> pd.Series:
        return (v * 100).round() % 2 == 0

    register_pandas_rule(t.spark, "even_cents", even_cents)
    return dq_rules(t.events, {"value": "even_cents"})
