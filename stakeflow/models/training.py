"""Training sets, Spark ML models, tuning, calibration and scoring."""

from __future__ import annotations

from functools import partial
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, UnivariateFeatureSelector, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stakeflow.functions.semantics import r6
from stakeflow.models.neighbours import nearest
from stakeflow.operators.windows import rolling_team_features
from stakeflow.session import shared_dir, written

FEATURES = ["home_gf", "home_ga", "away_gf", "away_ga", "home_rest", "away_rest", "h2h"]


def training_set(matches: DataFrame, sides: DataFrame, n: int = 5) -> DataFrame:
    """Pre-match features of both teams and the label 1.0 for a home win.

    Features only use earlier matches, so nothing of the match itself leaks in.
    """
    f = written(rolling_team_features(sides, n), "features")  # read for both teams
    home = f.select("match_id", F.col("team").alias("home_team"), F.col("goals_for_avg").alias("home_gf"),
                    F.col("goals_against_avg").alias("home_ga"), F.col("rest_days").cast("double").alias("home_rest"), F.col("h2h_win_rate").alias("h2h"))
    away = f.select("match_id", F.col("team").alias("away_team"), F.col("goals_for_avg").alias("away_gf"),
                    F.col("goals_against_avg").alias("away_ga"), F.col("rest_days").cast("double").alias("away_rest"))
    done = matches.filter("status = 'finished'").select(
        "match_id", "match_date", "league", "home_team", "away_team", "home_score", "away_score", (F.col("home_score") > F.col("away_score")).cast("double").alias("label"))
    return done.join(home, ["match_id", "home_team"]).join(away, ["match_id", "away_team"])


#: Labels by market: the three results (0 home, 1 draw, 2 away), and yes (1) or no (0).
MARKETS = {
    "match_winner": lambda: F.when(F.col("home_score") > F.col("away_score"), 0.0).when(F.col("home_score") == F.col("away_score"), 1.0).otherwise(2.0),
    "over_2_5": lambda: (F.col("home_score") + F.col("away_score") > 2).cast("double"),
    "both_score": lambda: ((F.col("home_score") > 0) & (F.col("away_score") > 0)).cast("double"),
}


def market_label(market: str) -> Column:
    if market not in MARKETS:
        raise ValueError(f"unknown market {market!r}, expected one of {sorted(MARKETS)}")
    return MARKETS[market]()


def algorithm(algo: str, **params):
    kinds = {"logistic": LogisticRegression, "random_forest": RandomForestClassifier, "gbt": GBTClassifier}
    if algo not in kinds:
        raise ValueError(f"unknown algorithm {algo!r}, expected one of {sorted(kinds)}")
    if algo != "logistic":
        params.setdefault("seed", 7)
    return kinds[algo](featuresCol="features", labelCol="label", **params)


def pipeline(algo: str, features: list[str] = FEATURES, **params) -> Pipeline:
    filled = [f"{c}_f" for c in features]
    return Pipeline(stages=[Imputer(inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="features"),
                            algorithm(algo, **params)])


def train(data: DataFrame, algo: str, features: list[str] = FEATURES, **params) -> PipelineModel:
    return pipeline(algo, features, **params).fit(data)


def predict(model: PipelineModel, data: DataFrame, keep: list[str]) -> DataFrame:
    """Probability of class 1, of all classes, and the likeliest class per row; also works on a stream."""
    p = model.transform(data).withColumn("_p", vector_to_array("probability"))
    return p.select(*keep, r6(F.col("_p")[1]).alias("p"), F.transform("_p", r6).alias("probabilities"), F.col("prediction").cast("int").alias("prediction"))


def train_predict(data: DataFrame, market: str, algo: str, cut: str, sport: str = "league", keep: tuple[str, ...] = ("match_id",),
                  features: list[str] = FEATURES, **params) -> DataFrame:
    """One model per sport for a market: fitted on the matches before ``cut``, scored on the matches from then on.

    The sports are a short list; a sport whose earlier matches show one result only has no model and
    no predictions. Gradient-boosted trees take markets of two results. A model is scored from its
    saved form.
    """
    label = market_label(market)
    if algo == "gbt" and market == "match_winner":
        raise ValueError("gbt takes markets with two results")
    spark, out = data.sparkSession, shared_dir(data.sparkSession, "models")
    labelled = written(data.withColumn("label", label), "labelled")
    past, later = F.col("match_date") < F.lit(cut).cast("timestamp_ntz"), F.col("match_date") >= F.lit(cut).cast("timestamp_ntz")
    able = labelled.filter(past).groupBy(sport).agg(F.count_distinct("label").alias("n")).filter("n > 1").select(sport).orderBy(sport)
    scores = None
    for n, row in enumerate(able.collect()):
        own = labelled.filter(F.col(sport).eqNullSafe(F.lit(row[0])))
        train(own.filter(past), algo, features, **params).write().save(f"{out}/{n}")
        scored = predict(PipelineModel.load(f"{out}/{n}"), own.filter(later), [*keep, sport])
        scores = scored if scores is None else scores.unionByName(scored)
    if scores is None:
        schema = labelled.select(*keep, sport).schema.add("p", "double").add("probabilities", "array<double>").add("prediction", "int")
        scores = spark.createDataFrame([], schema)
    return scores.withColumn("market", F.lit(market))


def time_folds(data: DataFrame, ts: str, bounds: list[str]) -> DataFrame:
    """Fold number from consecutive time bounds: rows before the first bound are fold 0, and so on."""
    fold = F.lit(0)
    for b in bounds:
        fold = fold + (F.col(ts) >= F.lit(b).cast("timestamp_ntz")).cast("int")
    return data.withColumn("fold", fold)


def rolling_origin(data: DataFrame) -> DataFrame:
    """Per fold from 1 on: the rows of the folds before it, which a model may see, and its own."""
    sizes = data.groupBy("fold").agg(F.count("*").alias("test_rows"))
    # one row per fold
    before = Window.orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("train_rows", F.sum("test_rows").over(before)).filter("train_rows IS NOT NULL").select("fold", "train_rows", "test_rows")


def tune(data: DataFrame, features: list[str] = FEATURES, reg: tuple[float, ...] = (0.0, 0.1), parallelism: int = 4) -> DataFrame:
    """Area under ROC per regularisation strength and fold, with the mean per strength.

    Rolling origin: fold k is scored by a model of the folds before k, so no model has seen later rows.
    Folds that hold one label only cannot be scored and are left out. Of a fold, up to ``parallelism`` strengths
    are fitted at a time: their many short passes fill each other's gaps.
    """
    score, inherit = BinaryClassificationEvaluator(), inheritable_thread_target(data.sparkSession)
    rows = []

    def auc(past, own, fold, r):
        return float(r), fold, float(score.evaluate(train(past, "logistic", features, regParam=r).transform(own)))

    with ThreadPool(max(1, min(parallelism, len(reg)))) as pool:
        for row in rolling_origin(data).orderBy("fold").collect():
            past, fold = data.filter(F.col("fold") < row["fold"]), data.filter(F.col("fold") == row["fold"])
            if min(d.agg(F.count_distinct("label")).first()[0] for d in (past, fold)) < 2:
                continue
            rows += pool.map(lambda task: task(), [inherit(partial(auc, past, fold, row["fold"], r)) for r in reg])
    scores = data.sparkSession.createDataFrame(rows, "reg double, fold int, auc double")
    return scores.select("reg", "fold", r6(F.col("auc")).alias("auc"), r6(F.avg("auc").over(Window.partitionBy("reg"))).alias("mean_auc"))


def feature_importance(model: PipelineModel, spark, features: list[str] = FEATURES) -> DataFrame:
    scores = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(f, float(s)) for f, s in zip(features, scores)], "feature string, importance double")


def select_features(data: DataFrame, k: int, features: list[str] = FEATURES) -> list[str]:
    """The ``k`` features with the strongest univariate relation to the label."""
    filled = [f"{c}_f" for c in features]
    stages = [Imputer(inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="all"),
              UnivariateFeatureSelector(featuresCol="all", labelCol="label", outputCol="features", selectionMode="numTopFeatures")
              .setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(k)]
    model = Pipeline(stages=stages).fit(data)
    return [features[i] for i in model.stages[-1].selectedFeatures]


def batch_predict(requests: DataFrame, scored: DataFrame, limit: int = 50) -> DataFrame:
    """Scores of a requested list of matches, with an error for ids that have none.

    ``requests`` is one call's list; more than ``limit`` ids are refused.
    """
    size = requests.agg(F.count("*")).scalar()
    ok = requests.filter(F.when(size <= limit, F.lit(True)).otherwise(F.raise_error(F.lit(f"at most {limit} matches per call")).cast("boolean")))
    found = ok.join(scored, "match_id", "left")
    return found.withColumn("error", F.when(F.col("p").isNull(), F.lit("match not found")))


def drift_psi(reference: DataFrame, current: DataFrame, value: str, low: float, high: float, bins: int = 10) -> DataFrame:
    """Population stability index over ``bins`` bins and one on either side; every count is smoothed by 0.5."""
    both = reference.select(value, F.lit(0).alias("side")).unionByName(current.select(value, F.lit(1).alias("side")))
    binned = both.groupBy(F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(
        F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    n = binned.agg(F.struct(F.sum("a").alias("a"), F.sum("b").alias("b"))).scalar()
    p = (F.col("a") + 0.5) / (F.col("n.a") + 0.5 * (bins + 2))
    q = (F.col("b") + 0.5) / (F.col("n.b") + 0.5 * (bins + 2))
    rows = binned.withColumn("n", n).withColumn("part", (p - q) * F.ln(p / q))
    return rows.groupBy().agg(r6(F.sum("part")).alias("psi"), F.count("*").alias("bins"))


def drift_ks(reference: DataFrame, current: DataFrame, value: str) -> DataFrame:
    """Largest distance of the two distribution functions, from counts per distinct value."""
    from stakeflow.operators.scan import running, value_block
    both = reference.select(value, F.lit(0).alias("side")).unionByName(current.select(value, F.lit(1).alias("side")))
    hist = both.groupBy(value).agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    n = hist.agg(F.struct(F.sum("a").alias("a"), F.sum("b").alias("b"))).scalar()
    cdf = running(hist, [], [value], value_block(value), {"ca": ("sum", F.col("a")), "cb": ("sum", F.col("b"))}).withColumn("n", n)
    return cdf.agg(r6(F.max(F.abs(F.col("ca") / F.col("n.a") - F.col("cb") / F.col("n.b")))).alias("ks"))


def bias_report(performance: DataFrame, overall: DataFrame, segment: str) -> DataFrame:
    """Model metrics per segment with the accuracy gap to the whole."""
    base = overall.agg(F.max("accuracy")).scalar()
    return performance.select(segment, "n", "accuracy", "brier", r6(F.col("accuracy") - base).alias("accuracy_gap"))


def centroids(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean vector per label, summed dimension by dimension."""
    dims = vectors.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return dims.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias(vector))


def similar_matches(queries: DataFrame, candidates: DataFrame, qid: str, cid: str, vector: str, k: int) -> DataFrame:
    """``k`` candidates with the highest cosine similarity for each query vector, exactly; see ``neighbours``."""
    return nearest(queries, candidates, qid, cid, vector, k)[0]
