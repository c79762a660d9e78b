"""Statistics, metrics, curves, joins of attributes."""

from __future__ import annotations

from pyspark.sql import functions as F

from doubtline.functions import vectors as V
from doubtline.functions.hashing import md5_uniform
from doubtline.functions.prob import certainty, confidence
from doubtline.operators import cleaning as K
from doubtline.operators import metrics as Q
from doubtline.operators import sampling as S
from doubtline.operators.interval import IntervalBounds
from doubtline.operators.stats import moments
from doubtline.queries import data as D
from doubtline.queries.data import certainty_sql, nb_sql, uniform_sql, with_sql
from doubtline.queries.registry import query, rounded
from doubtline.sources import tables as T

# normal quantiles the series starts from
Z = {0.9: 1.6448536269514722, 0.5: 0.6744897501960817}


def t_sql(level: float, nu: str) -> str:
    """Student-t quantile by its asymptotic series up to the fourth power of 1 / nu."""
    z = Z[level]
    terms = [
        z,
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    ]
    return "(" + " + ".join(f"({t!r}) / pow({nu}, {i})" for i, t in enumerate(terms)) + ")"


def bounds_sql(name: str, level: float, by_class: bool, scale: str = "sem", rows: str = "base") -> str:
    """CTEs ending in ``name([label,] j, lo, hi)``."""
    key = "label, " if by_class else ""
    width = "stddev_samp(v)" if scale == "sd" else "stddev_samp(v) / sqrt(count(*))"
    return f"""{D.long_sql(f'{name}_t', rows, ', label')},
{name}_s AS (SELECT {key}j, median(v) AS mid, {width} AS w, count(*) - 1.0 AS nu FROM {name}_t GROUP BY {key}j),
{name} AS (SELECT {key}j, mid - w * {t_sql(level, 'nu')} AS lo, mid + w * {t_sql(level, 'nu')} AS hi FROM {name}_s)"""


@query(
    "a01_interval_global",
    with_sql(D.EVENTS_SQL, bounds_sql("b", 0.9, False), select="SELECT (j - 1)::INTEGER AS fid, round(lo, 6) AS lo, round(hi, 6) AS hi FROM b"),
)
def interval_global(spark, sf):
    bounds = IntervalBounds.fit(D.events(spark, sf), 0.9)
    out = bounds.frame(spark).select(F.posexplode(F.arrays_zip("lo", "hi")).alias("fid", "b"))
    return rounded(out.select("fid", "b.lo", "b.hi"))


@query(
    "a02_interval_by_class",
    with_sql(D.EVENTS_SQL, bounds_sql("b", 0.9, True), select="SELECT label, (j - 1)::INTEGER AS fid, round(lo, 6) AS lo, round(hi, 6) AS hi FROM b"),
)
def interval_by_class(spark, sf):
    bounds = IntervalBounds.fit(D.events(spark, sf), 0.9, by="label")
    out = bounds.frame(spark).select("label", F.posexplode(F.arrays_zip("lo", "hi")).alias("fid", "b"))
    return rounded(out.select("label", "fid", "b.lo", "b.hi"))


_LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _line(spark, sf):
    return D.table(spark, sf, "lineitem").select(V.pack(_LINE_FEATURES))


def _line_sql(columns: str) -> str:
    parts = [
        f"SELECT {i} AS fid, {columns.format(c=c)} FROM lineitem" for i, c in enumerate(_LINE_FEATURES)
    ]
    return "\nUNION ALL ".join(parts)


@query("a03_deviation", _line_sql("round(stddev_pop({c}), 6) AS sd, round(avg({c}), 6) AS mean"))
def deviation(spark, sf):
    m = moments(_line(spark, sf))
    rows = [(i, float(m.var[0, i] ** 0.5), float(m.mean[0, i])) for i in range(m.width)]
    return rounded(spark.createDataFrame(rows, "fid int, sd double, mean double"))


@query("a04_min_max", _line_sql("min({c}) AS lo, max({c}) AS hi"))
def feature_range(spark, sf):
    m = moments(_line(spark, sf))
    rows = [(i, float(m.low[0, i]), float(m.high[0, i])) for i in range(m.width)]
    return spark.createDataFrame(rows, "fid int, lo double, hi double")


@query("a05_classes", "SELECT l_returnflag AS name, (row_number() OVER (ORDER BY l_returnflag) - 1)::INTEGER AS code FROM lineitem GROUP BY 1")
def classes(spark, sf):
    return K.label_classes(D.table(spark, sf, "lineitem"), "l_returnflag").select("name", "code")


_NB_ORDERS = (D.ORDERS_SQL, nb_sql("nb"))


@query(
    "a10_mean_of_measures",
    with_sql(*_NB_ORDERS, select=f"SELECT row_id, round((list_max(prob) + {certainty_sql('prob', 3)}) / 2, 6) AS um FROM nb"),
)
def mean_of_measures(spark, sf):
    scored, _ = D.scored(D.orders(spark, sf))
    return rounded(scored.select("row_id", ((confidence("prob") + certainty("prob", 3, 3)) / 2).alias("um")))


RATES = ["alpha", "eps", "phi", "alpha_w", "eps_w", "phi_c", "phi_m", "eps_gain", "phi_m_ratio", "overall"]


def omission_sql(rows: str, keys: str = "", wrapped: str = "wrapped_pred") -> str:
    k = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {k}round(alpha, 6) AS alpha, round(eps, 6) AS eps, round(phi, 6) AS phi, round(alpha_w, 6) AS alpha_w,
  round(eps_w, 6) AS eps_w, round(phi_c, 6) AS phi_c, round(phi_m, 6) AS phi_m, round(g, 6) AS eps_gain,
  round(p, 6) AS phi_m_ratio, round(CASE WHEN g + p = 0 THEN 0 ELSE 2 * g * p / (g + p) END, 6) AS overall
FROM (SELECT *, CASE WHEN eps = 0 THEN 0 ELSE (eps - eps_w) / eps END AS g,
             CASE WHEN phi = 0 THEN 0 ELSE phi_m / phi END AS p
FROM (SELECT {k}avg((label = pred)::INT) AS alpha, avg((label <> pred)::INT) AS eps, avg(({wrapped} IS NULL)::INT) AS phi,
  avg(coalesce({wrapped} = label, false)::INT) AS alpha_w, avg(coalesce({wrapped} <> label, false)::INT) AS eps_w,
  avg(({wrapped} IS NULL AND label = pred)::INT) AS phi_c, avg(({wrapped} IS NULL AND label <> pred)::INT) AS phi_m
  FROM {rows} {group}))"""


def _judged_orders(spark, sf, threshold=0.34):
    scored, _ = D.scored(D.orders(spark, sf))
    judged = scored.withColumn("um", confidence("prob"))
    judged = judged.withColumn("misc_pred", Q.threshold_judge("um", threshold))
    return judged.withColumn("wrapped_pred", K.rejected_to_null())


_JUDGED_SQL = "j AS (SELECT *, CASE WHEN list_max(prob) < 0.34 THEN NULL ELSE pred END AS wrapped_pred FROM nb)"


@query("a11_omission", with_sql(*_NB_ORDERS, _JUDGED_SQL, select=omission_sql("j", "o_orderpriority")))
def omission(spark, sf):
    return rounded(Q.omission_metrics(_judged_orders(spark, sf), by=["o_orderpriority"]))


_CONF_SQL = """c AS (SELECT source, count(*) FILTER (label = 1 AND hit = 1) AS tp, count(*) FILTER (label = 0 AND hit = 0) AS tn,
  count(*) FILTER (label = 0 AND hit = 1) AS fp, count(*) FILTER (label = 1 AND hit = 0) AS fn
  FROM (SELECT *, (f[1] > 1000)::INT AS hit FROM base) GROUP BY source)"""


def _hits(spark, sf):
    return D.documents(spark, sf).withColumn("hit", (V.item("features", 0) > 1000).cast("int"))


@query("a12_confusion", with_sql(D.DOCUMENTS_SQL, _CONF_SQL, select="SELECT source, tp, tn, fp, fn FROM c"))
def confusion(spark, sf):
    return Q.confusion(_hits(spark, sf), "label", "hit", ["source"])


def _div(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0.0 ELSE ({a}) * 1.0 / ({b}) END"


_MCC = _div("tp * 1.0 * tn - fp * 1.0 * fn", "sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn)")


@query(
    "a13_detection_scores",
    with_sql(D.DOCUMENTS_SQL, _CONF_SQL, select=f"""SELECT source, round({_div('tp + tn', 'tp + tn + fp + fn')}, 6) AS accuracy,
  round({_div('tp', 'tp + fp')}, 6) AS precision, round({_div('tp', 'tp + fn')}, 6) AS recall, round({_MCC}, 6) AS mcc FROM c"""),
)
def detection_scores(spark, sf):
    out = Q.detection_metrics(_hits(spark, sf), "label", "hit", ["source"])
    return rounded(out.select("source", "accuracy", "precision", "recall", "mcc"))


@query(
    "a14_auc_hard",
    with_sql(D.DOCUMENTS_SQL, _CONF_SQL, select=f"SELECT source, round(({_div('tp', 'tp + fn')} + {_div('tn', 'tn + fp')}) / 2, 6) AS auc_hard FROM c"),
)
def auc_hard(spark, sf):
    return rounded(Q.detection_metrics(_hits(spark, sf), "label", "hit", ["source"]).select("source", "auc_hard"))


def _lines(spark, sf):
    """Return flag R against the rest, scored by price: a curve over a large table."""
    return D.table(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("label")
    )


_LINES_SQL = "l AS (SELECT l_extendedprice AS score, (l_returnflag = 'R')::INT AS label FROM lineitem)"


@query(
    "a15_roc_curve",
    with_sql(
        _LINES_SQL,
        "g AS (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM l GROUP BY score)",
        "r AS (SELECT score, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM g WINDOW w AS (ORDER BY score DESC))",
        select="""SELECT score, tp::BIGINT AS tp, fp::BIGINT AS fp, round(tp / (SELECT sum(p) FROM g), 6) AS tpr,
       round(fp / (SELECT sum(n) FROM g), 6) AS fpr FROM r""",
    ),
)
def roc_curve(spark, sf):
    out = Q.roc_curve(_lines(spark, sf), "score")
    return out.select("score", "tp", "fp", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


@query(
    "a15_roc_area",
    with_sql(
        _LINES_SQL,
        "g AS (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM l GROUP BY score)",
        "r AS (SELECT p, n, sum(n) OVER (ORDER BY score) - n AS below FROM g)",
        select="SELECT round(sum(p * (below + n / 2.0)) / (sum(p)::DOUBLE * sum(n)), 6) AS auc FROM r",
    ),
)
def roc_area(spark, sf):
    return rounded(Q.roc_area(_lines(spark, sf), "score"))


@query("a16_error_rate", "SELECT round(avg(toxic), 6) AS error_rate, round(least(avg(toxic), 0.5), 6) AS contamination FROM labels")
def error_rate(spark, sf):
    return rounded(Q.error_rate(D.table(spark, sf, "labels"), "toxic"))


@query("a17_accuracy_by_table", with_sql(D.DOCUMENTS_SQL, select="SELECT source, round(1 - avg(label), 6) AS accuracy FROM base GROUP BY source"))
def accuracy_by_table(spark, sf):
    return rounded(Q.accuracy_by(D.documents(spark, sf), "source", "label"))


@query(
    "a19_split_summary",
    f"""SELECT CASE WHEN {uniform_sql('0', 'event_id')} < 0.3 THEN 'test' ELSE 'train' END AS split, count(*) AS items,
  count(DISTINCT event_type) AS labels, count(*) FILTER (event_type <> 'view') AS anomalies FROM events GROUP BY 1""",
)
def split_summary(spark, sf):
    e = S.two_way_split(D.table(spark, sf, "events").select("event_id", "event_type"), "event_id", 0.3)
    return Q.split_summary(e, "event_type", ["split"], "view")


THRESHOLDS = [round(0.33 + 0.002 * i, 3) for i in range(16)]


@query(
    "m15_risk_curve",
    with_sql(
        *_NB_ORDERS,
        f"t AS (SELECT unnest({THRESHOLDS}::DOUBLE[]) AS threshold)",
        "j AS (SELECT nb.*, threshold, CASE WHEN list_max(prob) < threshold THEN NULL ELSE pred END AS wrapped_pred FROM nb, t)",
        select=omission_sql("j", "threshold"),
    ),
)
def risk_curve(spark, sf):
    scored, _ = D.scored(D.orders(spark, sf))
    return rounded(Q.risk_curve(scored.withColumn("um", confidence("prob")), "um", THRESHOLDS))


_CUTS = [200, 500, 1000, 2000, 5000, 10000, 20000]


@query(
    "w11_best_candidate",
    with_sql(
        D.DOCUMENTS_SQL,
        f"t AS (SELECT unnest({_CUTS}) AS cut, unnest(range({len(_CUTS)})) AS candidate)",
        """c AS (SELECT candidate, cut, count(*) FILTER (label = 1 AND f[1] > cut) AS tp, count(*) FILTER (label = 0 AND f[1] <= cut) AS tn,
  count(*) FILTER (label = 0 AND f[1] > cut) AS fp, count(*) FILTER (label = 1 AND f[1] <= cut) AS fn FROM base, t GROUP BY 1, 2)""",
        select=f"SELECT candidate::INTEGER AS candidate, round({_MCC}, 6) AS mcc FROM c ORDER BY {_MCC} DESC, candidate LIMIT 1",
    ),
)
def best_candidate(spark, sf):
    df = D.documents(spark, sf)
    grid = F.array(*[F.struct(F.lit(i).alias("candidate"), F.lit(c).alias("cut")) for i, c in enumerate(_CUTS)])
    tried = df.select("label", V.item("features", 0).alias("chars"), F.explode(grid).alias("t"))
    tried = tried.select("label", F.col("t.candidate").alias("candidate"), (F.col("chars") > F.col("t.cut")).cast("int").alias("hit"))
    scores = Q.detection_metrics(tried, "label", "hit", ["candidate"])
    return rounded(Q.best_candidate(scores).select("candidate", "mcc"))


# --- joins of attributes --------------------------------------------------------------------


@query(
    "j06_accuracy_gate",
    with_sql(D.DOCUMENTS_SQL, "g AS (SELECT source FROM base GROUP BY source HAVING avg(quality) >= 0.85)",
             select="SELECT row_id, source FROM base WHERE source IN (SELECT source FROM g)"),
)
def accuracy_gate(spark, sf):
    df = D.documents(spark, sf).withColumn("wrong", F.lit(1) - F.col("quality"))
    return T.accuracy_gate(df, ["source"], 0.85, "wrong").select("row_id", "source")


@query(
    "j07_zip_scores",
    with_sql(*_NB_ORDERS, select="SELECT o_orderkey, o_orderdate::VARCHAR AS o_orderdate, pred, round(list_max(prob), 6) AS confidence FROM orders JOIN nb ON row_id = o_orderkey"),
)
def zip_scores(spark, sf):
    scored, _ = D.scored(D.orders(spark, sf))
    scores = scored.select(F.col("row_id").alias("o_orderkey"), "pred", confidence("prob").alias("confidence"))
    o = D.table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"))
    return rounded(o.join(scores, "o_orderkey").select("o_orderkey", "o_orderdate", "pred", "confidence"))


# --- vector functions -----------------------------------------------------------------------

_CENTROID_SQL = (
    D.EMBEDDINGS_SQL,
    D.long_sql("long", "base", ", label"),
    "m AS (SELECT label, j, avg(v) AS c FROM long GROUP BY 1, 2)",
)


def _with_centroid(spark, sf):
    df = D.embeddings(spark, sf)
    m = moments(df, by="label")
    centers = spark.createDataFrame(
        [(label, m.mean[i].tolist()) for i, label in enumerate(m.labels)], "label int, center array<double>"
    )
    return df.join(F.broadcast(centers), "label")


@query(
    "f04_euclidean",
    with_sql(*_CENTROID_SQL, select="SELECT row_id, round(sqrt(sum((v - c) * (v - c))), 6) AS dist FROM long JOIN m USING (label, j) GROUP BY row_id"),
)
def euclidean(spark, sf):
    return rounded(_with_centroid(spark, sf).select("row_id", V.euclidean("features", "center", 64).alias("dist")))


@query(
    "f05_mean_absolute_error",
    with_sql(*_CENTROID_SQL, select="SELECT row_id, round(avg(abs(v - c)), 6) AS mae FROM long JOIN m USING (label, j) GROUP BY row_id"),
)
def mean_absolute_error(spark, sf):
    return rounded(_with_centroid(spark, sf).select("row_id", V.mean_absolute_error("features", "center", 64).alias("mae")))


@query(
    "f08_keyed_uniform",
    f"SELECT l_orderkey, count(*) AS n, round(avg({uniform_sql('3', 'l_orderkey', 'l_partkey', 'l_suppkey')}), 6) AS u FROM lineitem GROUP BY 1",
)
def keyed_uniform(spark, sf):
    u = md5_uniform(3, F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"))
    out = D.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.avg(u).alias("u"))
    return rounded(out)
