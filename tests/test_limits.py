"""Windows of heavy keys by pointer doubling equal the ordered fold."""

import random

import pytest
from pyspark.sql import functions as F

from stakeflow.operators import fold as L
from stakeflow.operators import scan as S

from .test_scan import rows


@pytest.fixture(scope="module")
def requests(spark):
    """One user holds nine of ten requests; many share a second."""
    r = random.Random(2)
    data = []
    at = 0
    for i in range(3000):
        at += r.choice([0, 0, 1, 2, 5, 30, 400])
        user = None if r.random() < 0.01 else 0 if r.random() < 0.9 else r.randrange(1, 60)
        data.append((i, user, at + (0.25 if i % 3 else 0.0), r.choice(["login", "get"])))
    df = spark.createDataFrame(data, "request_id long, user_id long, at double, action string")
    return df.select("request_id", "user_id", "action", F.lit("auth").alias("area"), F.col("at").cast("timestamp").alias("ts")).cache()


def folded(run):
    """The same operator with every key taken as light."""
    found, S.heavy_keys = S.heavy_keys, lambda df, keys: {}
    try:
        return rows(run())
    finally:
        S.heavy_keys = found


@pytest.mark.parametrize("limits", [((3, 60),), ((2, 10), (20, 600), (100, 86400)), ((1, 10_000_000),)])
def test_fixed_windows_of_a_heavy_user(requests, limits):
    known = requests.filter("user_id IS NOT NULL")
    run = lambda: L.fixed_window_limit(known, "user_id", limits)
    assert S.heavy_keys(known, ["user_id"])
    assert rows(run()) == folded(run)


def test_no_python_on_heavy_keys(requests):
    heavy = L._decided(requests.filter("user_id = 0").withColumn("now", F.unix_micros("ts") / 1e6), ["user_id"], F.lit(3), F.lit(60), "ok", "wait")
    assert "InPandas" not in heavy._jdf.queryExecution().toString()


def test_endpoint_windows_of_a_heavy_user(spark, requests):
    limits = spark.createDataFrame([("auth", "login", 2, 45), ("auth", "get", 5, 300)], "area string, action string, requests int, seconds int")
    known = requests.filter("user_id IS NOT NULL")
    run = lambda: L.endpoint_limit(known, limits)
    assert rows(run()) == folded(run)
