"""Sequential folds per key, for rules where each row depends on the state the last one left."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stakeflow.operators.scan import PLACE, by_weight, placed, running
from stakeflow.session import written


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], new_state: Callable[[], dict],
                 step: Callable[[dict, object], tuple | None], schema: str,
                 finish: Callable[[tuple, dict], list[tuple]] | None = None) -> DataFrame:
    """Run ``step(state, row)`` over each key's rows in order and emit what it returns.

    Rows are partitioned by key and sorted by Spark (spilling), then streamed through in Arrow
    batches: a task holds one key's state, never a key's rows. ``finish(key, state)`` may emit
    rows when a key ends.
    """
    names = list(df.columns)
    ends = [names.index(k) for k in keys]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        cols = None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                now = tuple(row[i] for i in ends)
                if now != key:
                    if key is not None and finish:
                        out += finish(key, state)
                    key, state = now, new_state()
                made = step(state, row)
                if made is not None:
                    out.append(made)
            yield _frame(out, cols_of)
        if key is not None and finish:
            yield _frame(finish(key, state), cols_of)

    from pyspark.sql.types import StructType
    cols_of = [f.name for f in StructType.fromDDL(schema).fields]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def _frame(rows: list[tuple], cols: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=cols)


def rating_elo(matches: DataFrame, k: float = 20.0, home_advantage: float = 60.0, start: float = 1500.0,
               initial: DataFrame | None = None) -> DataFrame:
    """Elo ratings per league after all finished matches, in match order.

    Elo is sequential in a league. The fold keeps one rating per team; ``initial`` (league, team,
    rating) carries the ratings of earlier runs, so a run only has to read new matches.
    """
    m = matches.filter("status = 'finished'").select(
        "league", F.lit(1).alias("kind"), "match_date", F.col("match_id").cast("long").alias("match_id"), "home_team", "away_team",
        F.when(F.col("home_score") > F.col("away_score"), 1.0).when(F.col("home_score") == F.col("away_score"), 0.5)
        .otherwise(0.0).alias("x"))
    if initial is not None:
        m = m.unionByName(initial.select(
            "league", F.lit(0).alias("kind"), F.lit(None).cast("timestamp_ntz").alias("match_date"), F.lit(0).cast("long").alias("match_id"),
            F.col("team").alias("home_team"), F.lit(None).cast("string").alias("away_team"), F.col("rating").alias("x")))

    def step(state, row):
        if row.kind == 0:
            state[row.home_team] = row.x
            return None
        h, a = state.get(row.home_team, start), state.get(row.away_team, start)
        expected = 1.0 / (1.0 + 10.0 ** ((a - h - home_advantage) / 400.0))
        delta = k * (row.x - expected)
        state[row.home_team], state[row.away_team] = h + delta, a - delta
        return None

    return ordered_fold(m, ["league"], ["kind", "match_date", "match_id"], dict, step, "league string, team string, rating double",
                        lambda key, state: [(key[0], team, r) for team, r in state.items()])


class TokenBucket:
    """Token bucket in event time: refill at ``per_minute``/60 a second up to ``burst``."""

    def __init__(self, per_minute: float, burst: int, idle_seconds: float | None = None):
        self.rate, self.burst, self.idle = per_minute / 60.0, burst, idle_seconds

    def take(self, tokens: float | None, last: float | None, now: float) -> tuple[float, bool, int]:
        """Tokens left, whether the request passes, and the seconds to wait if not.

        A request older than the last one refills nothing; keep the later of both times.
        """
        idle = self.idle is not None and last is not None and now - last > self.idle
        if tokens is None or last is None or idle:
            tokens = float(self.burst)
        else:
            tokens = min(float(self.burst), tokens + max(0.0, now - last) * self.rate)
        if tokens >= 1:
            return tokens - 1, True, 0
        return tokens, False, int((1 - tokens) / self.rate) + 1


def token_bucket(requests: DataFrame, key: str, bucket: TokenBucket) -> DataFrame:
    """Decision per request of (key, ts, request_id), in time order per key."""
    r = requests.select(key, "request_id", "ts", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("now"))

    def step(state, row):
        left, ok, wait = bucket.take(state.get("tokens"), state.get("last"), row.now)
        state["tokens"], state["last"] = left, max(row.now, state.get("last", row.now))
        return row.request_id, ok, int(left), wait

    return ordered_fold(r, [key], ["ts", "request_id"], dict, step, "request_id bigint, allowed boolean, remaining bigint, retry_after bigint")


class FixedWindow:
    """At most ``limit`` requests in a window that starts at a key's first request."""

    def __init__(self, limit: int, seconds: int):
        self.limit, self.seconds = limit, seconds

    def hit(self, start: float | None, count: int, now: float) -> tuple[float, int, bool, int]:
        """New window start and count, whether the request passes, and the wait if not."""
        if start is None or now >= start + self.seconds:
            start, count = now, 0
        count += 1
        ok = count <= self.limit
        return start, count, ok, 0 if ok else max(1, int(start + self.seconds - now))


# Global limits (requests, seconds).
GLOBAL_LIMITS = ((100, 60), (1000, 3600), (10000, 86400))


def fixed_window_limit(requests: DataFrame, key: str, limits: tuple[tuple[int, int], ...] = GLOBAL_LIMITS) -> DataFrame:
    """Apply several windows at once; a request passes when every limit allows it.

    Light keys are folded in order; heavy ones get their windows by pointer doubling, see :func:`window_starts`.
    """
    r = requests.select(key, "request_id", "ts", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("now"))
    few, many = by_weight(r, [key])
    if many is None:
        return _fixed_fold(few, key, limits)
    rows = written(many, "requests")
    ok, wait = [], []
    for i, (n, s) in enumerate(limits):
        rows = _decided(rows, [key], F.lit(n), F.lit(s), f"_ok{i}", f"_wait{i}")
        ok.append(F.col(f"_ok{i}"))
        wait.append(F.col(f"_wait{i}"))
    heavy = rows.select("request_id", F.forall(F.array(*ok), lambda x: x).alias("allowed"), F.array_max(F.array(*wait)).alias("retry_after"))
    return _fixed_fold(few, key, limits).unionByName(heavy)


def window_starts(rows: DataFrame, keys: list[str], seconds: Column) -> DataFrame:
    """``rows`` (keys, now, request_id) with ``_n``, the number of the request, and ``_start``, whether it opens a window.

    A key's first request opens a window, and each window is followed by the first request at or after
    its end. So every request points to the first one a window later, and those that the first
    request reaches open the windows. Pointers are doubled: after k joins they span 2^k windows, so the
    orbit of a key of any length is found in a logarithmic number of joins over all tasks.
    """
    order = ["now", "_side", "request_id"]
    base = rows.select(*keys, "now", "request_id", seconds.cast("double").alias("_s"))
    both = base.select(*keys, "now", F.lit(1).alias("_side"), "request_id").unionByName(
        base.select(*keys, (F.col("now") + F.col("_s")).alias("now"), F.lit(0).alias("_side"), "request_id"))
    counted = running(placed(both, keys, order, "probes"), keys, order, F.col(PLACE), {"_c": ("count", F.when(F.col("_side") == 1, 1))}, split=False)
    pairs = written(counted.groupBy(*keys, "request_id").agg(
        F.max(F.when(F.col("_side") == 1, F.col("_c"))).alias("_n"), F.max(F.when(F.col("_side") == 0, F.col("_c") + 1)).alias("_next")), "numbered")
    size = pairs.groupBy(*keys).agg(F.max("_n").alias("_size"))
    hops = written(pairs.join(size, keys).filter("_next <= _size").select(*keys, F.col("_n").alias("_from"), F.col("_next").alias("_to")), "hops")
    reached = size.select(*keys, F.lit(1).cast("long").alias("_from"))
    while not hops.isEmpty():
        reached = written(reached.unionByName(reached.join(hops, [*keys, "_from"]).select(*keys, F.col("_to").alias("_from"))), "reached")
        again = hops.select(*keys, F.col("_from").alias("_to"), F.col("_to").alias("_end"))
        hops = written(hops.join(again, [*keys, "_to"]).select(*keys, "_from", F.col("_end").alias("_to")), "hops")
    opened = reached.select(*keys, F.col("_from").alias("_n"), F.lit(True).alias("_start"))
    numbered = pairs.drop("_next").join(opened, [*keys, "_n"], "left")
    return rows.join(numbered, [*keys, "request_id"])


def _decided(rows: DataFrame, keys: list[str], limit: Column, seconds: Column, ok: str, wait: str) -> DataFrame:
    """Add a window's decision and wait to rows of heavy keys; a null key is a key like any other."""
    names, keys, rows = rows.columns, ["_key"], rows.withColumn("_key", F.struct(*keys))
    order = ["now", "request_id"]
    opened = placed(window_starts(rows, keys, seconds), keys, order, "windows")
    inside = running(opened, keys, order, F.col(PLACE), {"_w": ("last", F.when(F.col("_start"), F.struct("now", "_n")))}, split=False)
    passes = F.col("_n") - F.col("_w._n") < limit
    left = F.greatest(F.lit(1), F.floor(F.col("_w.now") + seconds - F.col("now")))
    return inside.select(*names, passes.alias(ok), F.when(passes, 0).otherwise(left).cast("long").alias(wait))


def _fixed_fold(r: DataFrame, key: str, limits: tuple[tuple[int, int], ...]) -> DataFrame:
    windows = [FixedWindow(n, s) for n, s in limits]

    def step(state, row):
        ok, wait = True, 0
        for i, w in enumerate(windows):
            start, count = state.get(i, (None, 0))
            start, count, one, w8 = w.hit(start, count, row.now)
            state[i] = (start, count)
            ok, wait = ok and one, max(wait, w8)
        return row.request_id, ok, wait

    return ordered_fold(r, [key], ["ts", "request_id"], dict, step, "request_id bigint, allowed boolean, retry_after bigint")


# Limits by endpoint (requests, seconds).
ENDPOINT_LIMITS = (
    ("auth", "login", 5, 60), ("auth", "register", 3, 300), ("auth", "forgot_password", 3, 600),
    ("predictions", "get", 100, 60), ("predictions", "create", 50, 60), ("analytics", "get", 50, 60),
)


def endpoint_limit(requests: DataFrame, limits: DataFrame) -> DataFrame:
    """Per-endpoint windows: the limit of (area, action) comes from the table ``limits``."""
    r = requests.join(limits, ["area", "action"]).select(
        "user_id", "area", "action", "requests", "seconds", "request_id", "ts", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("now"))
    keys = ["user_id", "area", "action"]
    few, many = by_weight(r, keys)
    if many is None:
        return _endpoint_fold(few)
    heavy = _decided(written(many, "requests"), keys, F.col("requests"), F.col("seconds"), "allowed", "retry_after")
    return _endpoint_fold(few).unionByName(heavy.select("request_id", "allowed", "retry_after"))


def _endpoint_fold(r: DataFrame) -> DataFrame:
    def step(state, row):
        w = FixedWindow(row.requests, row.seconds)
        state["s"], state["c"], ok, wait = w.hit(state.get("s"), state.get("c", 0), row.now)
        return row.request_id, ok, wait

    return ordered_fold(r, ["user_id", "area", "action"], ["ts", "request_id"], dict, step, "request_id bigint, allowed boolean, retry_after bigint")
