"""Row-level projections."""

from pyspark.sql import functions as F

from stakeflow.functions.semantics import confidence_level, r6
from stakeflow.operators import projections as P
from stakeflow.plans.registry import query


@query("confidence_level", "v_prediction", """SELECT match_id, confidence,
   CASE WHEN confidence >= 80 THEN 'very_high' WHEN confidence >= 70 THEN 'high'
        WHEN confidence >= 60 THEN 'medium' ELSE 'low' END AS level FROM v_prediction""")
def _(t):
    return t.prediction.select("match_id", "confidence", confidence_level(F.col("confidence")).alias("level"))


@query("user_profile_metrics", "v_bet", """WITH u AS (SELECT user_id, count(*) AS n,
      count(*) FILTER (status = 'won') AS w, sum(stake) AS p FROM v_bet GROUP BY user_id)
   SELECT user_id, round(100.0 * w / n, 6) AS accuracy, round(p * 100 / n, 6) AS roi,
     CASE WHEN user_id % 3 = 2 THEN concat(c_mktsegment, ' ', c_name)
          ELSE concat('user_', CAST(user_id AS VARCHAR)) END AS full_name
   FROM u JOIN customer ON c_custkey = user_id""")
def _(t):
    k = F.col("user_id") % 3
    counters = t.bet.groupBy("user_id").agg(
        F.count("*").alias("total_predictions"), F.count("*").alias("total_bets"),
        F.count_if(F.col("status") == "won").alias("correct_predictions"), F.sum("stake").alias("total_profit"))
    users = counters.join(t.customer, F.col("c_custkey") == F.col("user_id")).select(
        counters["*"], F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("username"),
        F.when(k == 2, F.col("c_mktsegment")).alias("first_name"), F.when(k != 0, F.col("c_name")).alias("last_name"))
    return P.user_profile_metrics(users).select(
        "user_id", r6(F.col("accuracy")).alias("accuracy"), r6(F.col("roi")).alias("roi"), "full_name")


@query("invoice_normalize", "", """SELECT o_orderkey AS invoice_id, CAST(floor(o_totalprice) AS BIGINT) / 100 AS amount,
   CASE o_orderkey % 2 WHEN 0 THEN 'EUR' ELSE 'USD' END AS currency, o_orderdate AS created_at,
   CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 1 DAY END AS paid_at FROM orders""")
def _(t):
    epoch = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    return P.invoice_normalize(t.orders.select(
        F.col("o_orderkey").alias("invoice_id"), F.floor("o_totalprice").alias("amount_cents"),
        F.when(F.col("o_orderkey") % 2 == 0, "eur").otherwise("usd").alias("currency"),
        epoch.alias("created_epoch"),
        F.when(F.col("o_orderstatus") == "F", epoch + 86400).when(F.col("o_orderstatus") == "P", F.lit(0)).alias("paid_epoch")))


ACCESS = """e AS (SELECT *, CASE WHEN forwarded_for IS NOT NULL THEN split_part(forwarded_for, ',', 1)
      WHEN real_ip IS NOT NULL THEN real_ip ELSE host END AS client_ip,
    CASE WHEN status_code >= 500 THEN 'error' WHEN status_code >= 400 THEN 'warning' ELSE 'info' END AS level,
    duration_ms > 1000 AS slow FROM v_access WHERE path NOT LIKE '/health%' AND path NOT LIKE '/metrics%')"""


@query("access_log_enrich", "v_access", f"WITH {ACCESS} SELECT request_id, client_ip, level, slow FROM e")
def _(t):
    return P.access_log_enrich(t.access).select("request_id", "client_ip", "level", "slow")


@query("remap", "", "SELECT event_id AS id, ts AS happened_at, event_type AS type FROM events")
def _(t):
    return P.remap(t.events, {"event_id": "id", "ts": "happened_at", "event_type": "type", "absent": "gone"})


@query("pick", "", "SELECT o_orderkey, o_orderdate FROM orders")
def _(t):
    return P.pick(t.orders, ["o_orderkey", "no_such_field", "o_orderdate"])


def _nested(t):
    return t.orders.select(
        F.col("o_orderkey").alias("match_id"),
        F.struct(F.col("o_orderdate").alias("kick_off"),
                 F.struct(F.col("o_totalprice").alias("total_price"), F.col("o_orderstatus").alias("order_status"))
                 .alias("price_info")).alias("match_info"))


@query("rename_columns", "", """SELECT o_orderkey AS "matchId", o_orderdate AS "kickOff",
   o_totalprice AS "totalPrice", o_orderstatus AS "orderStatus" FROM orders""")
def _(t):
    return P.rename_columns(_nested(t), "camel").select(
        "matchId", "matchInfo.kickOff", "matchInfo.priceInfo.totalPrice", "matchInfo.priceInfo.orderStatus")


def _mixed(t):
    return t.orders.select(F.col("o_orderkey").alias("_matchID"), F.struct(F.col("o_totalprice").alias("TotalPrice"), F.col("o_orderstatus").alias("order status")).alias("Price-Info"))


@query("rename_columns_snake", "", "SELECT o_orderkey AS _match_id, o_totalprice AS total_price, o_orderstatus AS order_status FROM orders")
def _(t):
    return P.rename_columns(_mixed(t), "snake").select("_match_id", "price__info.total_price", "price__info.order_status")


@query("rename_columns_kebab", "", """SELECT o_orderkey AS "-match-id", o_totalprice AS "total-price" FROM orders""")
def _(t):
    return P.rename_columns(_mixed(t), "kebab").select("`-match-id`", "`price--info`.`total-price`")


@query("rename_columns_pascal", "", """SELECT o_orderkey AS "Matchid", o_orderstatus AS "OrderStatus" FROM orders""")
def _(t):
    return P.rename_columns(_mixed(t), "pascal").select("Matchid", "PriceInfo.OrderStatus")


@query("flatten_df", "", """SELECT o_orderkey AS match_id, o_orderdate AS match_info_kick_off,
   o_totalprice AS match_info_price_info_total_price, o_orderstatus AS match_info_price_info_order_status FROM orders""")
def _(t):
    return P.flatten_df(_nested(t), sep="_")


@query("unflatten_df", "", "SELECT o_orderkey AS match_id, o_totalprice AS total_price, o_orderdate AS kick_off FROM orders")
def _(t):
    back = P.unflatten_df(P.flatten_df(_nested(t)))
    return back.select("match_id", "match_info.price_info.total_price", "match_info.kick_off")
