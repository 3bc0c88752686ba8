"""Holdout by time, rolling origin, neighbours."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stakeflow.models import neighbours
from stakeflow.models import training as M
from stakeflow.operators import aggregates as A
from stakeflow.session import written

from .test_scan import rows

CUT = "2000-01-01"


@pytest.fixture(scope="module")
def matches(tables):
    return written(M.training_set(tables.match, A.team_sides(tables.match)), "training-set")


@pytest.mark.parametrize("market, algo, params", [("match_winner", "logistic", {"maxIter": 5}), ("over_2_5", "random_forest", {"numTrees": 3, "maxDepth": 2})])
def test_models_score_the_holdout_only(matches, market, algo, params):
    got = M.train_predict(matches, market, algo, CUT, **params).collect()
    past = matches.filter(F.col("match_date") < F.lit(CUT).cast("timestamp_ntz")).withColumn("label", M.market_label(market))
    able = {r.league for r in past.groupBy("league").agg(F.count_distinct("label").alias("n")).filter("n > 1").collect()}
    want = {r.match_id for r in matches.filter(F.col("match_date") >= F.lit(CUT).cast("timestamp_ntz")).filter(F.col("league").isin(*able)).collect()}
    assert len(got) == len(want) and {r.match_id for r in got} == want and want
    classes = 3 if market == "match_winner" else 2
    assert all(len(r.probabilities) <= classes and abs(sum(r.probabilities) - 1) < 1e-5 and r.prediction < classes for r in got)
    assert {(r.league, r.market) for r in got} == {(sport, market) for sport in able}


def test_markets(spark, matches):
    d = spark.createDataFrame([(2, 1), (0, 0), (0, 3)], "home_score long, away_score long")
    assert [[r[0] for r in d.select(M.market_label(m)).collect()] for m in ("match_winner", "over_2_5", "both_score")] == [[0, 1, 2], [1, 0, 1], [1, 0, 0]]
    with pytest.raises(ValueError):
        M.market_label("corners")
    with pytest.raises(ValueError):
        M.train_predict(matches, "match_winner", "gbt", CUT)


def test_no_fold_is_scored_by_a_model_of_later_rows(matches, monkeypatch):
    data = written(M.time_folds(matches, "match_date", ["1997-01-01", "1999-01-01"]), "folds")
    seen = []

    def spy(past, *args, **kw):
        seen.append(past.agg(F.max("match_date"), F.max("fold")).first())
        return fit(past, *args, **kw)

    fit = M.train
    monkeypatch.setattr(M, "train", spy)
    got = M.tune(data, reg=(0.1,)).collect()
    starts = {r.fold: r.m for r in data.groupBy("fold").agg(F.min("match_date").alias("m")).collect()}
    assert [r.fold for r in got] == [f + 1 for _, f in seen]
    assert all(last < starts[r.fold] for r, (last, _) in zip(got, seen))
    assert all(0 <= r.auc <= 1 and r.mean_auc == pytest.approx(np.mean([x.auc for x in got]), abs=1e-6) for r in got)
    sizes = {r["fold"]: r["count"] for r in data.groupBy("fold").count().collect()}
    assert {(r.fold, r.train_rows, r.test_rows) for r in M.rolling_origin(data).collect()} == {(f, sum(sizes[g] for g in sizes if g < f), sizes[f]) for f in sizes if f}


def test_psi_shares_add_to_one(spark):
    import math
    a = spark.createDataFrame([(float(i % 10),) for i in range(100)], "v double")
    b = spark.createDataFrame([(float(i % 7),) for i in range(70)], "v double")
    got = M.drift_psi(a, b, "v", 0.0, 10.0, 5).first()
    ca, cb = [0, 20, 20, 20, 20, 20, 0], [0, 20, 20, 20, 10, 0, 0]
    p, q = [(x + 0.5) / (100 + 3.5) for x in ca], [(x + 0.5) / (70 + 3.5) for x in cb]
    assert abs(sum(p) - 1) < 1e-12 and abs(sum(q) - 1) < 1e-12
    want = sum((x - y) * math.log(x / y) for x, y, m, n in zip(p, q, ca, cb) if m + n)
    assert got.psi == pytest.approx(want, abs=1e-5)


@pytest.mark.parametrize("spread, share", [(0.05, 0.1), (3.0, None)])
def test_neighbours_are_exact(spark, spread, share):
    """On clustered vectors less than a tenth of the pairs is scored; without clusters the result is the same."""
    r = np.random.default_rng(1)
    centres = r.normal(size=(60, 16))
    points = centres[r.integers(0, 60, 6000)] + spread * r.normal(size=(6000, 16))
    points[5] = 0
    points[100:130] = points[99]  # ties
    asked = [(1000 + i, points[i].tolist()) for i in range(0, 300, 3)] + [(9, None), (10, [0.0] * 16), (11, [None] * 16)]
    c = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)] + [(7000, None)], "cid long, v array<double>").repartition(4)
    q = spark.createDataFrame(asked, "qid long, v array<double>")
    found, pairs = neighbours.nearest(q, c, "qid", "cid", "v", 5, pivots=128, block_rows=500)
    unit = points / np.maximum(np.linalg.norm(points, axis=1), 1e-300)[:, None]
    want = {}
    for qid, v in asked:
        if v and v[0]:
            s = np.round(unit @ (np.array(v) / np.linalg.norm(v)), 6)
            s[5] = -2
            want[qid] = [(int(i), float(s[i])) for i in np.lexsort((np.arange(len(s)), -s))[:5]]
    got = {}
    for x in sorted(found.collect(), key=lambda x: x.rn):
        got.setdefault(x.qid, []).append((x.cid, x.similarity))
    assert {i: [a for a, _ in v] for i, v in got.items()} == {i: [a for a, _ in v] for i, v in want.items()}
    assert all(a[1] == pytest.approx(b[1], abs=1.1e-6) for i in got for a, b in zip(got[i], want[i]))
    if share:
        assert pairs.first().pairs < share * len(want) * len(points)
    assert "CartesianProduct" not in found._jdf.queryExecution().toString()


def test_neighbours_of_empty_tables(spark):
    none = spark.createDataFrame([], "cid long, v array<double>")
    one = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, v array<double>")
    assert M.similar_matches(one, none, "qid", "cid", "v", 3).count() == 0
    assert M.similar_matches(one.limit(0), one.withColumnRenamed("qid", "cid"), "qid", "cid", "v", 3).count() == 0
    assert rows(M.similar_matches(one, one.withColumnRenamed("qid", "cid"), "qid", "cid", "v", 3)) == [(1, 1, 1.0, 1)]


def test_streamed_scores_equal_batch_scores(spark, matches):
    from stakeflow.session import shared_dir
    from stakeflow.streaming.jobs import stream_source, stream_to_table

    out = shared_dir(spark, "model")
    M.train(matches, "logistic", maxIter=5).write().save(f"{out}/m")
    model = M.PipelineModel.load(f"{out}/m")
    matches.repartition(4).write.parquet(f"{out}/rows")
    feed = stream_source(spark, f"{out}/rows", entity=matches.schema, max_files=1)
    scored = stream_to_table(M.predict(model, feed, ["match_id"]), "scores")
    assert rows(scored) == rows(M.predict(model, matches, ["match_id"])) and scored.count() == matches.count()


def test_importance_finds_the_feature_that_decides(spark):
    r = np.random.default_rng(2)
    data = [(*map(float, r.random(len(M.FEATURES))),) for _ in range(400)]
    df = spark.createDataFrame([(*v, float(v[3] > 0.5)) for v in data], ", ".join(f"{f} double" for f in M.FEATURES) + ", label double")
    got = {x.feature: x.importance for x in M.feature_importance(M.train(df, "random_forest", numTrees=10, maxDepth=4), spark).collect()}
    assert max(got, key=got.get) == M.FEATURES[3] and sum(got.values()) == pytest.approx(1.0)
    assert M.select_features(df, 1) == [M.FEATURES[3]]


def test_strengths_of_a_fold_are_fitted_together(matches, monkeypatch):
    import threading

    data = written(M.time_folds(matches, "match_date", ["1998-01-01"]), "folds")
    both = threading.Barrier(2, timeout=120)

    def spy(past, *args, **kw):
        both.wait()
        return fit(past, *args, **kw)

    fit = M.train
    monkeypatch.setattr(M, "train", spy)
    assert sorted((r.reg, r.fold) for r in M.tune(data, reg=(0.0, 0.1)).collect()) == [(0.0, 1), (0.1, 1)]
