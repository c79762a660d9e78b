"""Anomaly detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from doubtline.functions.prob import paired_probability
from doubtline.operators import detectors as T
from doubtline.operators import measures as M
from doubtline.queries import data as D
from doubtline.queries.data import certainty_sql, with_sql
from doubtline.queries.measuring import measured, one
from doubtline.queries.registry import query, rounded

_TAILS = (
    D.EVENTS_SQL,
    D.long_sql("long"),
    "m AS (SELECT j, avg(v) AS m FROM long GROUP BY j)",
    "s AS (SELECT j, sign(sum((v - m) * (v - m) * (v - m))) AS s FROM long JOIN m USING (j) GROUP BY j)",
    """t AS (SELECT row_id, j, -ln(count(*) OVER (PARTITION BY j ORDER BY v) / (SELECT count(*) FROM base)::DOUBLE) AS l,
  -ln(count(*) OVER (PARTITION BY j ORDER BY v DESC) / (SELECT count(*) FROM base)::DOUBLE) AS r FROM long)""",
    "u AS (SELECT row_id, l, r, CASE WHEN s > 0 THEN r WHEN s < 0 THEN l ELSE l + r END AS k FROM t JOIN s USING (j))",
)


def _scores(detector, df):
    return rounded(detector.learn(df).train_scores(df).select("row_id", "score"))


@query("d01_copod", with_sql(*_TAILS, select="SELECT row_id, round(sum(greatest(k, (l + r) / 2)), 6) AS score FROM u GROUP BY row_id"))
def copod(spark, sf):
    return _scores(T.TailDetector("COPOD"), D.events(spark, sf))


@query("d02_ecod", with_sql(*_TAILS, select="SELECT row_id, round(sum(greatest(k, l, r)), 6) AS score FROM u GROUP BY row_id"))
def ecod(spark, sf):
    return _scores(T.TailDetector("ECOD"), D.events(spark, sf))


_HBOS = (
    D.EVENTS_SQL,
    D.long_sql("long"),
    "b AS (SELECT j, min(v) AS lo, (max(v) - min(v)) / 30 AS step FROM long GROUP BY j)",
    "c AS (SELECT row_id, j, least(floor((v - lo) / step), 29) AS bin, step FROM long JOIN b USING (j))",
    "h AS (SELECT j, bin, -log2(count(*) / ((SELECT count(*) FROM base) * any_value(step)) + 0.1) AS u FROM c GROUP BY 1, 2)",
    "p AS (SELECT row_id, list(u ORDER BY j) AS u FROM c JOIN h USING (j, bin) GROUP BY row_id)",
    "hb AS (SELECT row_id, ((u[1] + u[2]) + u[3]) + u[4] AS score FROM p)",
)

_D0 = (
    "th AS (SELECT quantile_cont(score, 0.9) AS thr FROM hb)",
    "tt AS (SELECT row_id, score - thr AS t FROM hb, th)",
    "ex AS (SELECT min(t) AS lo, max(t) AS hi FROM tt)",
    "cc AS (SELECT row_id, t, CASE WHEN t > 0 THEN t / hi WHEN lo <> 0 THEN t / lo ELSE 0.2 END AS c FROM tt, ex)",
    """dp AS (SELECT row_id, CASE WHEN t > 0 THEN [0.5 - c / 2, 0.5 + c / 2] ELSE [0.5 + c / 2, 0.5 - c / 2] END AS prob,
  (t > 0 AND c > 0)::INTEGER AS pred FROM cc)""",
)


@query("d03_hbos", with_sql(*_HBOS, select="SELECT row_id, round(score, 6) AS score FROM hb"))
def hbos(spark, sf):
    return _scores(T.HistogramDetector(), D.events(spark, sf))


def _hbos(spark, sf):
    df = D.events(spark, sf)
    return T.HistogramDetector(0.1).fit(df).transform(df)


@query("d00_detector_probability", with_sql(*_HBOS, *_D0, select="SELECT row_id, round(prob[1], 6) AS p0, round(prob[2], 6) AS p1 FROM dp"))
def detector_probability(spark, sf):
    out = _hbos(spark, sf)
    return rounded(out.select("row_id", F.col("prob")[0].alias("p0"), F.col("prob")[1].alias("p1")))


@query("d00_detector_prediction", with_sql(*_HBOS, *_D0, select="SELECT row_id, pred FROM dp"))
def detector_prediction(spark, sf):
    return _hbos(spark, sf).select("row_id", "pred")


@query("w03_batch_range", with_sql(*_HBOS, *_D0, select="SELECT row_id, round((t - lo) / (hi - lo), 6) AS x FROM tt, ex"))
def batch_range(spark, sf):
    df = D.events(spark, sf)
    fitted = T.HistogramDetector(0.1).fit(df)
    span = fitted.high - fitted.low
    scaled = (F.col("score") - F.lit(fitted.threshold) - F.lit(fitted.low)) / F.lit(span)
    return rounded(fitted.score(df).select("row_id", scaled.alias("x")))


@query(
    "f10_paired_probability",
    with_sql(*_HBOS, *_D0, select="""SELECT row_id, round(CASE WHEN pred = 0 THEN list_max(prob) ELSE list_min(prob) END, 6) AS p0,
  round(CASE WHEN pred = 0 THEN list_min(prob) ELSE list_max(prob) END, 6) AS p1 FROM dp"""),
)
def paired(spark, sf):
    out = _hbos(spark, sf).select("row_id", paired_probability("prob", "pred").alias("q"))
    return rounded(out.select("row_id", F.col("q")[0].alias("p0"), F.col("q")[1].alias("p1")))


@query("u07_external_unsupervised", with_sql(*_HBOS, *_D0, select=f"SELECT row_id, round({certainty_sql('prob', 2)}, 6) AS um FROM dp"))
def external_unsupervised(spark, sf):
    return one(measured(spark, sf, D.events, [M.External(T.HistogramDetector(0.1), norm=2)], 5)[0], "um")


@query(
    "d05_principal_components",
    with_sql(
        D.ORDERS_SQL,
        "m AS (SELECT avg(f[1]) AS a, avg(f[2]) AS b, stddev_pop(f[1]) AS sa, stddev_pop(f[2]) AS sb, corr(f[1], f[2]) AS r FROM base)",
        "z AS (SELECT row_id, (f[1] - a) / sa AS x, (f[2] - b) / sb AS y, r FROM base, m)",
        select="""SELECT row_id, round(sqrt(greatest(x * x + y * y + 1 - 2 * abs(x + y) / sqrt(2), 0)) / ((1 + r) / 2)
  + sqrt(greatest(x * x + y * y + 1 - 2 * abs(x - y) / sqrt(2), 0)) / ((1 - r) / 2), 6) AS score FROM z""",
    ),
)
def principal_components(spark, sf):
    return _scores(T.PrincipalComponents(), D.orders(spark, sf))


def _judged(detector, df):
    """Score, probabilities and verdict of a detector on its own table."""
    fitted = detector.fit(df)
    out = fitted.transform(df)
    return rounded(out.select("row_id", F.col("prob")[1].alias("p1"), "pred"))


@query("d04_robust_covariance")
def robust_covariance(spark, sf):
    return _judged(T.RobustCovariance(0.1), D.orders(spark, sf))


@query("d06_clusters")
def clusters(spark, sf):
    return _judged(T.ClusterDetector(0.1), D.events(spark, sf))


@query("d09_isolating_spheres")
def isolating_spheres(spark, sf):
    return _judged(T.IsolatingSpheres(0.1), D.embeddings(spark, sf))


@query("d11_connectivity")
def connectivity(spark, sf):
    return _judged(T.ConnectivityDetector(0.1), D.embeddings(spark, sf))


@query("d12_isolation_forest")
def isolation_forest(spark, sf):
    return _judged(T.IsolationForest(0.1), D.events(spark, sf))


@query("d13_random_projections")
def random_projections(spark, sf):
    return _judged(T.RandomProjections(0.1), D.embeddings(spark, sf))


