"""Streaming jobs drained over the event feed, and their batch twins."""

from pyspark.sql import functions as F

from stakeflow.functions.semantics import r6
from stakeflow.operators import fold as L
from stakeflow.operators import sessions as E
from stakeflow.plans.registry import query
from stakeflow.sources.views import render
from stakeflow.streaming import jobs as J


def _feed(t, view=None, path=None):
    # as a pattern the path may be one file or a folder of files
    feed = J.stream_source(t.spark, path or t.file("events")[:-1] + "[t]", max_files=1 if path else 1000)
    if view is None:
        return feed
    return t.spark.sql(render(view, "spark").replace("FROM events", "FROM {events}"), events=feed)


def _replayed(t, view=None):
    """The events in five files by an arrival up to 23 hours after their time: rows cross file borders out of order."""
    arrival = F.col("ts") + F.make_dt_interval(hours=(F.col("event_id") * 7 % 24).cast("int"))
    return _feed(t, view, J.replay(t.events, arrival, 5, "arrivals"))


# What a stream with a delay of one day and slices of one day has released at the end of the feed.
RELEASED = "ts < (SELECT time_bucket(INTERVAL 1 DAY, max(ts) - INTERVAL 1 DAY) FROM events)"


@query("stream_source_sink", "", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def _(t):
    return J.stream_to_table(_feed(t), "feed")


@query("live_match_state", "v_tick", """SELECT match_id, arg_max(odds, (ts, tick_id)) AS odds, arg_max(bookmaker, (ts, tick_id)) AS bookmaker, max(ts) AS ts FROM v_tick GROUP BY 1""")
def _(t):
    s = J.live_match_state(_replayed(t, "v_tick"), "match_id", "tick_id", ["odds", "bookmaker", "ts"])
    return J.stream_to_table(s, "match-state", "update", ["match_id"])


@query("odds_movement_stream", "v_tick", """WITH x AS (SELECT tick_id, odds, lag(odds) OVER (PARTITION BY match_id, bookmaker ORDER BY ts, tick_id) AS previous_odds FROM v_tick WHERE """ + RELEASED + """),
   y AS (SELECT *, round(odds - previous_odds, 6) AS movement FROM x)
  SELECT *, CASE WHEN movement < 0 THEN 'shortening' WHEN movement > 0 THEN 'drifting' ELSE 'stable' END AS trend FROM y""")
def _(t):
    return J.stream_to_table(J.odds_movement_stream(_replayed(t, "v_tick")), "odds-movement")


@query("prediction_update_stream", "v_update", """WITH x AS (SELECT update_id, confidence, confidence - lag(confidence) OVER (PARTITION BY prediction_id ORDER BY ts, update_id) AS change FROM v_update WHERE """ + RELEASED + """)
   SELECT *, CAST(sign(change) AS DOUBLE) AS direction FROM x""")
def _(t):
    return J.stream_to_table(J.prediction_update_stream(_replayed(t, "v_update")), "prediction-updates")


@query("alert_stream", "", """WITH s AS (SELECT c_custkey AS subscription_id, c_custkey % 150 AS match_id, c_acctbal / 50 AS min_value FROM customer)
  SELECT event_id, subscription_id FROM events JOIN s ON match_id = user_id WHERE value >= min_value AND event_type IN ('error', 'purchase')""")
def _(t):
    k = F.col("c_custkey")
    subs = t.customer.select(k.alias("subscription_id"), (k % 150).alias("match_id"), (F.col("c_acctbal") / 50).alias("min_value"),
                             F.array(F.lit("error"), F.lit("purchase")).alias("alert_types"))
    feed = _feed(t).select("event_id", "value", F.col("event_type").alias("alert_type"), F.col("user_id").alias("match_id"))
    return J.stream_to_table(J.alert_stream(feed, subs).select("event_id", "subscription_id"), "alerts")


BUCKET = """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) / 1000000.0::DOUBLE AS now, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events{released}),
   b AS (SELECT event_id, user_id, now, rn, CAST(2 AS DOUBLE) AS tokens, TRUE AS allowed, 0 AS retry FROM e WHERE rn = 1
     UNION ALL SELECT event_id, user_id, now, rn, CASE WHEN t >= 1 THEN t - 1 ELSE t END, t >= 1, CASE WHEN t >= 1 THEN 0 ELSE CAST(floor((1 - t) / (0.005 / 60)) AS INT) + 1 END
      FROM (SELECT e.event_id, e.user_id, e.now, e.rn, {refill} AS t FROM b JOIN e ON e.user_id = b.user_id AND e.rn = b.rn + 1) x)
  SELECT event_id AS request_id, allowed, CAST(floor(tokens) AS BIGINT) AS remaining, CAST(retry AS BIGINT) AS retry_after FROM b"""
REFILL = "least(CAST(3 AS DOUBLE), b.tokens + (e.now - b.now) * (0.005 / 60)::DOUBLE)"


@query("token_bucket", "", BUCKET.format(refill=REFILL, released=""))
def _(t):
    return L.token_bucket(t.events.withColumnRenamed("event_id", "request_id"), "user_id", L.TokenBucket(0.005, 3))


@query("token_bucket_stream", "", BUCKET.format(refill=REFILL, released=" WHERE " + RELEASED))
def _(t):
    feed = _replayed(t).select(F.col("event_id").alias("request_id"), "user_id", "ts", F.concat(F.lit("10.0.0."), (F.col("user_id") % 250).cast("string")).alias("ip"))
    return J.stream_to_table(J.token_bucket_stream(feed, L.TokenBucket(0.005, 3)), "token-bucket")


@query("token_bucket_idle", "", BUCKET.format(refill=f"CASE WHEN e.now - b.now > 36000 THEN CAST(3 AS DOUBLE) ELSE {REFILL} END", released=""))
def _(t):
    return L.token_bucket(t.events.withColumnRenamed("event_id", "request_id"), "user_id", L.TokenBucket(0.005, 3, idle_seconds=36000))


def _fixed(limits, where=""):
    ctes, joins, oks, waits = [], "", [], []
    for i, (n, s) in enumerate(limits):
        ctes.append(f"""w{i} AS (SELECT user_id, min(now) AS start FROM e GROUP BY 1
          UNION ALL SELECT e.user_id, min(e.now) FROM w{i} JOIN e ON e.user_id = w{i}.user_id AND e.now >= w{i}.start + {s} GROUP BY e.user_id),
         c{i} AS (SELECT e.event_id, s.start, row_number() OVER (PARTITION BY e.user_id, s.start ORDER BY e.now, e.event_id) AS n
          FROM e JOIN w{i} s ON s.user_id = e.user_id AND e.now >= s.start AND e.now < s.start + {s})""")
        joins += f" JOIN c{i} ON c{i}.event_id = e.event_id"
        oks.append(f"c{i}.n <= {n}")
        waits.append(f"CASE WHEN c{i}.n <= {n} THEN 0 ELSE greatest(1, CAST(floor(c{i}.start + {s} - e.now) AS BIGINT)) END")
    return f"""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) / 1000000.0::DOUBLE AS now FROM events{where}), {', '.join(ctes)}
      SELECT e.event_id AS request_id, {' AND '.join(oks)} AS allowed, CAST(greatest({', '.join(waits)}) AS BIGINT) AS retry_after FROM e{joins}"""


@query("fixed_window_limit", "", _fixed(((2, 86400), (5, 259200))))
def _(t):
    return L.fixed_window_limit(t.events.withColumnRenamed("event_id", "request_id"), "user_id", ((2, 86400), (5, 259200)))


ENDPOINT = """WITH RECURSIVE l AS (SELECT * FROM (VALUES ('click', 1, 86400), ('purchase', 2, 172800), ('error', 1, 43200)) v(event_type, n, s)),
   e AS (SELECT event_id, user_id, event_type, n, s, epoch_us(ts) / 1000000.0::DOUBLE AS now FROM events JOIN l USING (event_type){where}),
   w AS (SELECT user_id, event_type, min(now) AS start FROM e GROUP BY 1, 2
     UNION ALL SELECT e.user_id, e.event_type, min(e.now) FROM w JOIN e ON e.user_id = w.user_id AND e.event_type = w.event_type AND e.now >= w.start + e.s GROUP BY 1, 2, w.start),
   c AS (SELECT e.event_id, e.n AS lim, e.s, e.now, w.start, row_number() OVER (PARTITION BY e.user_id, e.event_type, w.start ORDER BY e.now, e.event_id) AS k
     FROM e JOIN w ON w.user_id = e.user_id AND w.event_type = e.event_type AND e.now >= w.start AND e.now < w.start + e.s)
  SELECT event_id AS request_id, k <= lim AS allowed, CASE WHEN k <= lim THEN 0 ELSE greatest(1, CAST(floor(start + s - now) AS BIGINT)) END AS retry_after FROM c"""


def _endpoints(t, events):
    limits = t.spark.createDataFrame(
        [("feed", "click", 1, 86400), ("feed", "purchase", 2, 172800), ("feed", "error", 1, 43200)], "area string, action string, requests int, seconds int")
    return events.select(F.col("event_id").alias("request_id"), "user_id", "ts", F.lit("feed").alias("area"), F.col("event_type").alias("action")), limits


@query("endpoint_limit", "", ENDPOINT.format(where=""))
def _(t):
    return L.endpoint_limit(*_endpoints(t, t.events))


@query("endpoint_limit_stream", "", ENDPOINT.format(where=" WHERE " + RELEASED))
def _(t):
    return J.stream_to_table(J.endpoint_limit_stream(*_endpoints(t, _replayed(t))), "endpoint-limit")


@query("fixed_window_stream", "", _fixed(((2, 86400), (5, 259200)), " WHERE " + RELEASED))
def _(t):
    feed = _replayed(t).select(F.col("event_id").alias("request_id"), "user_id", "ts", F.concat(F.lit("10.0.0."), (F.col("user_id") % 250).cast("string")).alias("ip"))
    return J.stream_to_table(J.fixed_window_stream(feed, [L.FixedWindow(2, 86400), L.FixedWindow(5, 259200)]), "fixed-window")


@query("idle_state_expiry", "", """WITH g AS (SELECT user_id, max(ts) AS last, count(*) AS requests FROM events GROUP BY 1)
  SELECT user_id, epoch_us(last) // 1000 AS last_ms, requests FROM g WHERE last + INTERVAL 6 HOUR < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def _(t):
    return J.stream_to_table(J.idle_state_expiry(_feed(t), 6 * 3600, "1 hour"), "idle")


WIN = "SELECT event_type, {start} AS start, {start} + INTERVAL {size} AS \"end\", count(*) AS n, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high FROM {src} GROUP BY 1, 2"


def _naive(df):
    return df.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query("tumbling_agg", "", WIN.format(start="time_bucket(INTERVAL 6 HOUR, ts)", size="6 HOUR", src="events"))
def _(t):
    s = J.windowed_stats(_feed(t), ["event_type"], "value", "6 hours")
    return _naive(J.stream_to_table(s, "tumbling", "update", ["event_type", "start", "end"]))


@query("sliding_agg", "", WIN.format(start="s", size="6 HOUR", src="(SELECT *, time_bucket(INTERVAL 2 HOUR, ts) - INTERVAL 2 HOUR * k AS s FROM events, (SELECT unnest(range(3))::INT AS k) r) x"))
def _(t):
    s = J.windowed_stats(_feed(t), ["event_type"], "value", "6 hours", "2 hours")
    return _naive(J.stream_to_table(s, "sliding", "update", ["event_type", "start", "end"]))


@query("user_sessions", "", """WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 14400 SECOND THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
   n AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM g)
  SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 14400 SECOND AS "end", count(*) AS events FROM n GROUP BY user_id, no""")
def _(t):
    return E.user_sessions(t.events, 14400)


@query("user_sessions_stream", "", """WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 14400 SECOND THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
   n AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM g),
   s AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 14400 SECOND AS "end", count(*) AS events FROM n GROUP BY user_id, no)
  SELECT * FROM s WHERE "end" <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""")
def _(t):
    return _naive(J.stream_to_table(J.user_sessions_stream(_replayed(t), "14400 seconds", "1 day"), "sessions"))


@query("late_split", "", """WITH a AS (SELECT *, event_id * 7 % 5 AS part FROM events),
   b AS (SELECT part, max(ts) AS newest FROM a GROUP BY 1)
  SELECT event_id, ts, user_id, event_type, value, props,
    coalesce(ts < (SELECT max(newest) FROM b WHERE b.part < a.part) - INTERVAL 10 DAY, FALSE) AS late FROM a""")
def _(t):
    # five files with rows of all times
    path = J.replay(t.events, F.timestamp_seconds(F.col("event_id") * 7 % 5), 5, "shuffled")
    return J.late_split(_feed(t, path=path), 10 * 86400, "late")


@query("webhook_dedup", "", "SELECT DISTINCT event_id // 3 AS webhook_id FROM events")
def _(t):
    feed = _feed(t).select(F.floor(F.col("event_id") / 3).alias("webhook_id"), "ts")
    return J.stream_to_table(J.webhook_dedup(feed, "webhook_id").select("webhook_id"), "webhooks")


@query("subscription_state", "", """WITH m AS (SELECT user_id AS subscription_id, arg_max(event_type, (ts, event_id)) AS e FROM events WHERE event_type <> 'view' GROUP BY 1)
  SELECT subscription_id, CASE e WHEN 'signup' THEN 'active' WHEN 'click' THEN 'updated' WHEN 'error' THEN 'past_due' ELSE 'active' END AS status,
    CASE e WHEN 'signup' THEN 'checkout.session.completed' WHEN 'click' THEN 'customer.subscription.updated' WHEN 'error' THEN 'invoice.payment_failed' ELSE 'invoice.payment_succeeded' END AS type FROM m""")
def _(t):
    e = F.col("event_type")
    kind = (F.when(e == "signup", "checkout.session.completed").when(e == "click", "customer.subscription.updated")
            .when(e == "error", "invoice.payment_failed").when(e == "purchase", "invoice.payment_succeeded").otherwise("ping"))
    s = J.subscription_state(_feed(t).select(F.col("user_id").alias("subscription_id"), "ts", "event_id", kind.alias("type")))
    return J.stream_to_table(s, "subscriptions", "update", ["subscription_id"])


@query("late_data_report", "v_update", """WITH a AS (SELECT update_id AS event_id, ts, ts + INTERVAL 1 MINUTE * CAST(confidence AS INT) AS arrived FROM v_update),
   w AS (SELECT *, max(ts) OVER (ORDER BY arrived, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM a)
  SELECT event_id, ts, arrived, CAST(floor(date_diff('microsecond', ts, newest) / 1000000.0) AS BIGINT) AS late_seconds FROM w WHERE date_diff('microsecond', ts, newest) > 1800000000""")
def _(t):
    arrived = F.col("ts") + F.make_dt_interval(mins=F.col("confidence").cast("int"))
    return E.late_data_report(t.update.select(F.col("update_id").alias("event_id"), "ts", arrived.alias("arrived")), 1800)


@query("rating_elo")
def _(t):
    return L.rating_elo(t.match).withColumn("rating", r6(F.col("rating")))
