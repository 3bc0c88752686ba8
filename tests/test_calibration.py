"""Calibration equals Spark's own isotonic fit, whatever the partitions hold."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from stakeflow.models import calibration as C


def spark_fit(df):
    pre = df.filter("p IS NOT NULL AND label IS NOT NULL").groupBy("p").agg(F.avg("label").alias("label"), F.count("*").cast("double").alias("weight"))
    data = VectorAssembler(inputCols=["p"], outputCol="features").transform(pre)
    model = IsotonicRegression(featuresCol="features", labelCol="label", weightCol="weight").fit(data)
    return {r.p: (r.label, r.prediction) for r in model.transform(data).collect()}


def cases():
    r = np.random.default_rng(3)
    n = 4000
    p = np.round(r.random(n), 3)
    yield "related", p, r.random(n) < p
    yield "unrelated", p, r.random(n) < 0.4
    yield "falling", p, r.random(n) < 1 - p
    yield "steps", p, (p * 7).astype(int) % 2 == 0
    yield "perfect", p, p > 0.5
    yield "dip", p, r.random(n) < np.abs(p - 0.7)
    yield "one score", np.full(50, 0.3), r.random(50) < 0.5
    fine = r.random(n)
    yield "no score twice", fine, r.random(n) < fine ** 2
    yield "reversed tail", p, np.where(p < 0.6, r.random(n) < p, r.random(n) < 0.05)


@pytest.mark.parametrize("name, p, y", list(cases()), ids=[c[0] for c in cases()])
def test_equals_sparks_fit(spark, name, p, y):
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(p, y)] + [(None, 1.0), (0.5, None)], "p double, label double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = {r.p: (r.observed, r.calibrated) for r in C.calibrate(df, "p", "label").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = spark_fit(df)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)


def test_empty_table(spark):
    assert C.calibrate(spark.createDataFrame([], "p double, label double"), "p", "label").count() == 0
