"""Training, scoring, drift, bias and similarity."""

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from stakeflow.functions.semantics import r6
from stakeflow.models import training as M
from stakeflow.models.calibration import calibrate
from stakeflow.operators import aggregates as A
from stakeflow.plans.registry import query
from stakeflow.plans.reports import MODEL
from stakeflow.plans.risk import SIDES
from stakeflow.session import shared_dir, written


def _train_set(t):
    return M.training_set(t.match, A.team_sides(t.match))


TRAIN = f"""{SIDES}, x AS (SELECT team, match_id, avg(gf) OVER w AS a, avg(ga) OVER w AS b,
     avg(CASE WHEN result = 'W' THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY team, opponent ORDER BY match_date, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h,
     date_diff('day', lag(match_date) OVER (PARTITION BY team ORDER BY match_date, match_id), match_date) AS rest
    FROM sd WINDOW w AS (PARTITION BY team ORDER BY match_date, match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))"""


@query("training_set", "v_match", f"""WITH {TRAIN} SELECT m.match_id, round(h.a, 6) AS home_gf, round(h.b, 6) AS home_ga, round(a.a, 6) AS away_gf, round(a.b, 6) AS away_ga,
    CAST(h.rest AS DOUBLE) AS home_rest, CAST(a.rest AS DOUBLE) AS away_rest, round(h.h, 6) AS h2h, CASE WHEN home_score > away_score THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label
   FROM v_match m JOIN x h ON h.match_id = m.match_id AND h.team = home_team JOIN x a ON a.match_id = m.match_id AND a.team = away_team WHERE m.status = 'finished'""")
def _(t):
    return _train_set(t).select("match_id", *M.FEATURES, "label")


def _model(t, algo, **params):
    # the set is used by several fitting passes: written once instead of recomputed
    spark, out = t.spark, shared_dir(t.spark, "training-set")
    _train_set(t).write.parquet(out)
    data = spark.read.parquet(out)
    # scored from its saved form, which carries no training summary
    M.train(data, algo, **params).write().save(f"{out}-model")
    return PipelineModel.load(f"{out}-model"), data


#: Matches from here on are scored by models of the matches before.
HOLDOUT = "2000-01-01"


@query("train_predict_logistic")
def _(t):
    return M.train_predict(_train_set(t), "match_winner", "logistic", HOLDOUT, maxIter=20)


@query("train_predict_random_forest")
def _(t):
    return M.train_predict(_train_set(t), "over_2_5", "random_forest", HOLDOUT, numTrees=10, maxDepth=4)


@query("train_predict_gbt")
def _(t):
    return M.train_predict(_train_set(t), "both_score", "gbt", HOLDOUT, maxIter=3, maxDepth=3)


FOLDS = ["1996-09-01", "1998-05-01", "1999-12-01"]


@query("tune_folds", "v_match", """WITH f AS (SELECT CAST(match_date >= TIMESTAMP '1996-09-01' AS INT) + CAST(match_date >= TIMESTAMP '1998-05-01' AS INT) + CAST(match_date >= TIMESTAMP '1999-12-01' AS INT) AS fold
     FROM v_match WHERE status = 'finished'), s AS (SELECT fold, count(*) AS test_rows FROM f GROUP BY 1)
  SELECT a.fold, CAST(sum(b.test_rows) AS BIGINT) AS train_rows, any_value(a.test_rows) AS test_rows FROM s a JOIN s b ON b.fold < a.fold GROUP BY 1""")
def _(t):
    return M.rolling_origin(M.time_folds(t.match.filter("status = 'finished'"), "match_date", FOLDS))


@query("tune")
def _(t):
    return M.tune(written(M.time_folds(_train_set(t), "match_date", FOLDS), "training-set"))


@query("feature_importance")
def _(t):
    model, _data = _model(t, "random_forest", numTrees=10, maxDepth=4)
    return M.feature_importance(model, t.spark).orderBy(F.desc("importance"), "feature")


@query("calibrate", "v_prediction", """WITH g AS (SELECT confidence AS p, CAST(count(*) AS DOUBLE) AS w, CAST(count(*) FILTER (status = 'won') AS DOUBLE) AS s FROM v_prediction WHERE status IN ('won', 'lost') GROUP BY 1),
   c AS (SELECT p, s / w AS o, sum(w) OVER (ORDER BY p) AS cw, sum(s) OVER (ORDER BY p) AS cs, sum(w) OVER (ORDER BY p) - w AS bw, sum(s) OVER (ORDER BY p) - s AS bs FROM g),
   m AS (SELECT i.p, a.p AS first, min((b.cs - a.bs) / (b.cw - a.bw)) AS v FROM c i JOIN c a ON a.p <= i.p JOIN c b ON b.p >= i.p GROUP BY 1, 2)
  SELECT p, round(o, 6) AS observed, round(max(v), 6) AS calibrated FROM m JOIN c USING (p) GROUP BY p, o""")
def _(t):
    scored = t.prediction.filter(F.col("status").isin("won", "lost")).select(
        F.col("confidence").alias("p"), (F.col("status") == "won").cast("double").alias("label"))
    return calibrate(scored, "p", "label")


@query("stream_scoring")
def _(t):
    from stakeflow.streaming.jobs import stream_source, stream_to_table
    model, data = _model(t, "logistic", maxIter=20)
    live = shared_dir(t.spark, "live-rows")
    data.write.parquet(live)
    feed = stream_source(t.spark, live, entity=data.schema)
    return stream_to_table(M.predict(model, feed, ["match_id"]), "scores")


@query("batch_predict", "v_prediction", """WITH s AS (SELECT match_id, avg(confidence) / 100 AS p FROM v_prediction GROUP BY 1),
   r AS (SELECT o_orderkey * 2 AS match_id FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50)
  SELECT match_id, round(p, 6) AS p, CASE WHEN p IS NULL THEN 'match not found' END AS error FROM r LEFT JOIN s USING (match_id)""")
def _(t):
    # one call's list: the fifty most staked matches of the slip
    asked = t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select((F.col("o_orderkey") * 2).alias("match_id"))
    scored = t.prediction.groupBy("match_id").agg(r6(F.avg("confidence") / 100).alias("p"))
    return M.batch_predict(asked, scored)


SPLIT = "a AS (SELECT stake FROM v_bet WHERE placed_at < TIMESTAMP '2024-01-16'), b AS (SELECT stake FROM v_bet WHERE placed_at >= TIMESTAMP '2024-01-16')"


def _split(t):
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    return t.bet.filter(F.col("placed_at") < cut), t.bet.filter(F.col("placed_at") >= cut)


@query("drift_psi", "v_bet", f"""WITH {SPLIT}, u AS (SELECT stake, 0 AS side FROM a UNION ALL SELECT stake, 1 FROM b),
   h AS (SELECT CASE WHEN stake < 0 THEN 0 WHEN stake >= 250 THEN 11 ELSE floor(stake / 25) + 1 END AS bin, count(*) FILTER (side = 0) AS x, count(*) FILTER (side = 1) AS y FROM u GROUP BY 1),
   p AS (SELECT (x + 0.5::DOUBLE) / ((SELECT sum(x) FROM h) + 6) AS p, (y + 0.5::DOUBLE) / ((SELECT sum(y) FROM h) + 6) AS q FROM h)
  SELECT round(sum((p - q) * ln(p / q)), 6) AS psi, count(*) AS bins FROM p""")
def _(t):
    a, b = _split(t)
    return M.drift_psi(a, b, "stake", 0.0, 250.0, 10)


@query("drift_ks", "v_bet", f"""WITH {SPLIT}, v AS (SELECT DISTINCT stake FROM v_bet), u AS (SELECT stake, 0 AS side FROM a UNION ALL SELECT stake, 1 FROM b),
   c AS (SELECT stake, sum(count(*) FILTER (side = 0)) OVER (ORDER BY stake) AS x, sum(count(*) FILTER (side = 1)) OVER (ORDER BY stake) AS y FROM u GROUP BY stake)
  SELECT round(max(abs(x / (SELECT count(*) FROM a) - y / (SELECT count(*) FROM b))), 6) AS ks FROM c""")
def _(t):
    a, b = _split(t)
    return M.drift_ks(a, b, "stake")


@query("bias_report", "v_prediction", f"""WITH g AS (SELECT sport, {MODEL} FROM v_prediction WHERE status IN ('won', 'lost') GROUP BY sport),
   o AS (SELECT {MODEL} FROM v_prediction WHERE status IN ('won', 'lost'))
  SELECT sport, n, accuracy, brier, round(accuracy - (SELECT accuracy FROM o), 6) AS accuracy_gap FROM g""")
def _(t):
    return M.bias_report(A.model_performance(t.prediction, ["sport"]), A.model_performance(t.prediction, []), "sport")


@query("similar_matches", "", """WITH d AS (SELECT label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
   m AS (SELECT label, i, avg(x) AS x FROM d GROUP BY 1, 2), q AS (SELECT label, list(x ORDER BY i) AS v FROM m GROUP BY 1),
   s AS (SELECT q.label, vec_id, round(list_dot_product(v, CAST(embedding AS DOUBLE[])) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))), 6) AS similarity FROM q, embeddings)
  SELECT label, vec_id, similarity, CAST(row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS INT) AS rn FROM s QUALIFY rn <= 5""")
def _(t):
    e = t.embeddings
    return M.similar_matches(M.centroids(e, "label", "embedding"), e.select("vec_id", "embedding"), "label", "vec_id", "embedding", 5)
