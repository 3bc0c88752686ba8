"""Blocked scans equal plain windows, also when one key holds most rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stakeflow.operators import scan as S


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(3000):
        key = None if rnd.random() < 0.02 else ("hot" if rnd.random() < 0.5 else f"k{rnd.randrange(40)}")
        rows.append((i, key, rnd.randrange(0, 400_000), None if rnd.random() < 0.2 else round(rnd.uniform(-50, 50), 2)))
    return spark.createDataFrame(rows, "id long, k string, s long, v double").withColumn("ts", F.timestamp_seconds("s")).cache()


def rows(df):
    return sorted([tuple(None if x is None else (round(x, 6) if isinstance(x, float) else x) for x in r) for r in df.collect()], key=repr)


@pytest.mark.parametrize("keys", [["k"], []])
def test_running_equals_window(skewed, keys):
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("ts", "id")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    v = F.col("v")
    want = skewed.select("id", F.sum(v).over(upto), F.count(v).over(upto), F.max(v).over(upto), F.min(v).over(upto), F.sum(v).over(before),
                         F.max(v).over(before), F.last(v, True).over(upto), F.last(v, True).over(before), F.first(v, True).over(upto), F.lag(v).over(w))
    kinds = ["sum", "count", "max", "min", "sum_before", "max_before", "last", "last_before", "first", "lag"]
    got = S.running(skewed, keys, ["ts", "id"], S.time_block("ts"), {k: (k, v) for k in kinds}).select("id", *kinds)
    assert rows(got) == rows(want)


def test_running_descending(skewed):
    w = Window.partitionBy("k").orderBy(F.desc("ts"), F.desc("id"))
    want = skewed.select("id", F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lag("s").over(w))
    got = S.running(skewed, ["k"], ["ts", "id"], S.time_block("ts"), {"a": ("sum", F.col("s")), "b": ("lag", F.col("s"))}, descending=True)
    assert rows(got.select("id", "a", "b")) == rows(want)


def test_trailing_rows_crosses_chunks(skewed):
    w = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(-7, -1)
    want = skewed.select("id", F.sum("v").over(w), F.count("*").over(w))
    got = S.trailing_rows(skewed, ["k"], ["ts", "id"], S.time_block("ts"), 7, {"a": F.sum("v"), "b": F.count("*")}, chunk=10)
    assert rows(got.select("id", "a", "b")) == rows(want)


def test_trailing_time_crosses_blocks(skewed):
    w = Window.partitionBy("k").orderBy("s").rangeBetween(-900, 0)
    want = skewed.select("id", F.max("v").over(w), F.count("*").over(w))
    got = S.trailing_time(skewed, ["k"], "ts", 900, {"a": F.max("v"), "b": F.count("*")})
    assert rows(got.select("id", "a", "b")) == rows(want)


def test_ranks_and_quantiles(skewed):
    d = skewed.filter("k IS NOT NULL AND v IS NOT NULL").withColumn("v", F.round("v"))
    w = Window.partitionBy("k").orderBy(F.desc("v"))
    want = d.select("id", F.rank().over(w))
    assert rows(S.ranked(d, ["k"], "v").select("id", "rank")) == rows(want)
    pr = d.select("id", F.percent_rank().over(Window.partitionBy("k").orderBy("v")))
    assert rows(S.ranked(d, ["k"], "v").select("id", "percentile")) == rows(pr)
    q = d.groupBy("k").agg(F.percentile("v", F.lit(0.3)), F.percentile("v", F.lit(0.95)))
    assert rows(S.exact_quantiles(d, ["k"], "v", {"a": 0.3, "b": 0.95})) == rows(q)


def test_attach_equals_join(skewed):
    info = skewed.groupBy("k").agg(F.avg("v").alias("m"), F.count("*").alias("n"))
    # a null key is a key
    same = lambda right: skewed.k.eqNullSafe(right.k)
    want = skewed.join(info, same(info)).select("id", "m", "n")
    assert rows(S.attach(skewed, info, ["k"], F.col("id")).select("id", "m", "n")) == rows(want)
    part = info.filter("n > 100")
    left = skewed.join(part, same(part), "left").select("id", "n")
    assert rows(S.attach(skewed, part, ["k"], F.col("id"), how="left").select("id", "n")) == rows(left)


def test_value_block_is_monotone(spark):
    vals = sorted([-1e9, -3.5, -0.001, 0.0, 1e-9, 0.5, 1.0, 2.0, 2.0001, 7.5, 1e6, 1e12])
    d = spark.createDataFrame([(v,) for v in vals], "v double").select("v", S.value_block("v").alias("b"))
    b = [r.b for r in d.orderBy("v").collect()]
    assert b == sorted(b)


def test_top_per_key(skewed):
    w = Window.partitionBy("k").orderBy(F.desc("ts"), "id")
    want = skewed.withColumn("rn", F.row_number().over(w)).filter("rn <= 4").select("id", "rn")
    assert rows(S.top_per_key(skewed, ["k"], [F.desc("ts"), F.asc("id")], 4, F.col("id"), salts=8).select("id", "rn")) == rows(want)


def test_heavy_keys_are_found(spark, skewed):
    counts = {r.k: r.n for r in skewed.groupBy("k").agg(F.count("*").alias("n")).collect()}
    parts, total = int(spark.conf.get("spark.sql.shuffle.partitions")), sum(counts.values())
    heavy = {k for k, n in counts.items() if n * parts > total}
    named = {r.h: r.k for r in skewed.select("k", F.xxhash64("k").alias("h")).distinct().collect()}
    found = S.heavy_keys(skewed, ["k"])
    assert heavy and {named[h] for h in found} == heavy
    assert all(found[h] >= counts[named[h]] * parts / total for h in found)
    assert S.heavy_keys(skewed.limit(0), ["k"]) == {} and S.heavy_keys(spark.range(1000), ["id"]) == {}


def test_heavy_keys_are_dealt_over_tasks(skewed):
    out = S.attach(skewed, skewed.groupBy("k").agg(F.count("*").alias("n")), ["k"], F.col("id"))
    assert "_salt" in out._jdf.queryExecution().toString()
    even = skewed.filter(F.col("id") % 97 == 0).withColumn("k", F.col("id").cast("string"))
    plain = S.attach(even, even.groupBy("k").agg(F.count("*").alias("n")), ["k"], F.col("id"))
    assert "_salt" not in plain._jdf.queryExecution().toString()
    assert rows(plain.select("id", "n")) == rows(even.select("id", F.lit(1)))


def test_group_stats_equal_a_join(skewed):
    stats = {"m": F.max(F.struct("v", "id")), "n": F.count("*"), "lo": F.min("v")}
    info = skewed.groupBy("k").agg(*[c.alias(n) for n, c in stats.items()])
    want = skewed.join(info, skewed.k.eqNullSafe(info.k)).select("id", "m", "n", "lo")
    assert rows(S.group_stats(skewed, ["k"], stats).select("id", "m", "n", "lo")) == rows(want)


def test_placed_blocks_follow_density(spark, skewed):
    """One read of the source; the hot key spans partitions, and running values over them are those of a plain window."""
    order = ["ts", "id"]
    rows_ = S.placed(skewed, ["k"], order)
    sizes = [r["count"] for r in rows_.groupBy(S.PLACE).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 2.5 * sum(sizes) / len(sizes)
    got = S.running(rows_, ["k"], order, F.col(S.PLACE), {"upto": ("sum", F.col("id")), "prior": ("lag", F.col("id"))}, split=False).select("id", "upto", "prior")
    w = Window.partitionBy("k").orderBy(*order)
    want = skewed.select("id", F.sum("id").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lag("id").over(w))
    assert rows(got) == rows(want)


def test_numbered_rows(skewed):
    got = S.numbered(skewed, [F.desc("v"), F.asc("id")], "n").select("id", "n")
    want = skewed.select("id", F.row_number().over(Window.orderBy(F.desc("v"), F.asc("id"))).alias("n"))
    assert rows(got) == rows(want)
    assert S.numbered(skewed.limit(0), ["id"], "n").count() == 0


def test_light_keys_take_one_window(skewed):
    even = skewed.withColumn("k", F.col("id") % 97).drop("s")
    out = S.running(even, ["k"], ["ts", "id"], S.time_block("ts"), {"upto": ("sum", F.col("id"))})
    text = out._jdf.queryExecution().toString()
    assert S.BLOCK not in text and "Union" not in text
    w = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    assert rows(out.select("id", "upto")) == rows(even.select("id", F.sum("id").over(w)))


def test_steps_on_heavy_and_light_keys(skewed):
    """Both ways of ordered operators in several steps give the same sessions, runs and team features."""
    from stakeflow.operators import sessions as E
    from stakeflow.operators import windows as W

    def plain(run):
        found, S.heavy_keys = S.heavy_keys, lambda df, keys: {}
        try:
            return rows(run())
        finally:
            S.heavy_keys = found

    users = skewed.select(F.col("id").alias("event_id"), F.col("k").alias("user_id"), "ts", "v")
    for run in (lambda: E.user_sessions(users, 600), lambda: W.failed_login_run(users, F.col("v") < 0, F.col("v") > 30)):
        assert rows(run()) == plain(run)
    sides = skewed.select(
        F.col("k").alias("team"), (F.col("id") % 7).alias("opponent"), F.when(F.col("id") % 3 == 0, "W").otherwise("L").alias("result"),
        (F.col("id") % 5).alias("gf"), (F.col("id") % 4).alias("ga"), F.col("ts").alias("match_date"), F.col("id").alias("match_id"))
    assert rows(W.rolling_team_features(sides, 5)) == plain(lambda: W.rolling_team_features(sides, 5))
