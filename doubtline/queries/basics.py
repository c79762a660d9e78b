"""Sources, cleaning, projections, splits."""

from __future__ import annotations

import math
import os

from pyspark.sql import functions as F

from doubtline.functions import vectors as V
from doubtline.functions.hashing import md5_uniform
from doubtline.functions.prob import argmax, certainty, confidence
from doubtline.operators import cleaning as K
from doubtline.operators import sampling as S
from doubtline.operators.metrics import threshold_judge
from doubtline.operators.stats import moments
from doubtline.queries import data as D
from doubtline.queries.data import certainty_sql, nb_sql, uniform_sql, with_sql
from doubtline.queries.registry import query, rounded
from doubtline.session import work_path
from doubtline.sources import tables as T
from doubtline.sources.sinks import append_stats, write_measures

# --- sources --------------------------------------------------------------------------------


@query("s01_csv_scan", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_scan(spark, sf):
    path = work_path(spark, "csv")
    D.table(spark, sf, "customer").write.option("header", True).csv(path)
    schema = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    return T.read_csv(spark, path, schema)


@query(
    "s02_multi_dataset_scan",
    """SELECT 'customer' AS dataset, count(*) AS items, round(avg(c_acctbal), 6) AS balance FROM customer
UNION ALL SELECT 'supplier', count(*), round(avg(s_acctbal), 6) FROM supplier""",
)
def multi_dataset_scan(spark, sf):
    paths = ", ".join(os.path.join(sf, f"{n}.parquet") for n in ("customer", "supplier"))
    df = T.read_datasets(spark, paths, "c_acctbal double, s_acctbal double", "parquet")
    out = df.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("items"), F.avg(F.coalesce("c_acctbal", "s_acctbal")).alias("balance")
    )
    return rounded(out)


@query(
    "s03_vector_table",
    with_sql(
        D.EMBEDDINGS_SQL,
        D.long_sql("long", "base", ", label"),
        select="SELECT row_id, label, 'pixel_' || (j - 1) AS name, round(v, 6) AS value FROM long",
    ),
)
def vector_source(spark, sf):
    return rounded(T.long_pixels(D.embeddings(spark, sf)))


def _prob_measures(df, classes):
    """Row-local measures of a scored table, in the layout of a measure table."""
    return df.select(
        "row_id",
        K.misclassified().alias("is_misclassification"),
        confidence("prob").alias("um_max_prob"),
        certainty("prob", classes, classes).alias("um_entropy"),
    )


def _write_two(spark, sf, path):
    for name, build, classes in (("orders", D.orders, 3), ("events", D.events, 5)):
        scored, _ = D.scored(build(spark, sf))
        out = _prob_measures(scored, classes).withColumns({"dataset": F.lit(name), "clf": F.lit("GaussianNB")})
        write_measures(out, path)


def _um_sql(base, classes, dataset):
    return with_sql(
        base,
        nb_sql("nb"),
        select=f"""SELECT '{dataset}' AS dataset, row_id, (label <> pred)::INTEGER AS is_misclassification,
       round(list_max(prob), 6) AS um_max_prob, round({certainty_sql('prob', classes)}, 6) AS um_entropy FROM nb""",
    )


@query("s04_measure_table_scan", _um_sql(D.ORDERS_SQL, 3, "orders"))
def measure_table_scan(spark, sf):
    path = work_path(spark, "um-scan")
    _write_two(spark, sf, path)
    df = T.read_measure_tables(spark, path, avoid=["events"])
    return rounded(df.select("dataset", "row_id", "is_misclassification", "um_max_prob", "um_entropy"))


@query(
    "s05_measure_table_sink",
    f"SELECT * FROM ({_um_sql(D.ORDERS_SQL, 3, 'orders')}) UNION ALL SELECT * FROM ({_um_sql(D.EVENTS_SQL, 5, 'events')})",
)
def measure_table_sink(spark, sf):
    path = work_path(spark, "um-sink")
    _write_two(spark, sf, path)
    df = spark.read.parquet(path)
    return rounded(df.select("dataset", "row_id", "is_misclassification", "um_max_prob", "um_entropy"))


@query(
    "s10_grid_append",
    """SELECT o_orderstatus AS part, count(*) AS items, round(avg(o_totalprice), 6) AS price FROM orders GROUP BY 1
UNION ALL SELECT o_orderpriority, count(*), round(avg(o_totalprice), 6) FROM orders GROUP BY 1""",
)
def grid_append(spark, sf):
    path = work_path(spark, "grid")
    o = D.table(spark, sf, "orders")
    for column in ("o_orderstatus", "o_orderpriority"):
        stats = o.groupBy(F.col(column).alias("part")).agg(
            F.count(F.lit(1)).alias("items"), F.avg("o_totalprice").alias("price")
        )
        append_stats(rounded(stats), path)
    return spark.read.parquet(path)


# --- cleaning -------------------------------------------------------------------------------


@query(
    "p01_fill_missing",
    """SELECT doc_id, CASE WHEN lang = 'en' THEN '0' ELSE lang END AS lang,
       coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic
FROM documents LEFT JOIN labels USING (doc_id)""",
)
def fill_missing(spark, sf):
    d = D.table(spark, sf, "documents").select("doc_id", F.when(F.col("lang") == "en", "null").otherwise(F.col("lang")).alias("lang"))
    return K.fill_missing(d.join(D.table(spark, sf, "labels"), "doc_id", "left"))


@query("p02_numeric_columns", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def numeric_columns(spark, sf):
    return K.keep_numeric(D.table(spark, sf, "lineitem"))


@query(
    "p03_row_limit",
    f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {uniform_sql('0', 'o_orderkey')}, o_orderkey LIMIT 1000",
)
def row_limit(spark, sf):
    return S.random_limit(D.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 1000, "o_orderkey")


@query(
    "p04_factorize",
    """WITH c AS (SELECT event_type, (row_number() OVER (ORDER BY min(event_id)) - 1)::INTEGER AS label
           FROM events GROUP BY event_type)
SELECT event_id, label FROM events JOIN c USING (event_type)""",
)
def factorize(spark, sf):
    e = D.table(spark, sf, "events")
    classes = K.label_classes(e, "event_type", position="event_id")
    return K.encode_label(e, "event_type", classes).select("event_id", "label")


@query("p05_distinct_labels", "SELECT DISTINCT event_type FROM events")
def distinct_labels(spark, sf):
    return K.distinct_labels(D.table(spark, sf, "events"), "event_type")


@query("p06_binary_label", "SELECT event_id, CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS label FROM events")
def binary_label(spark, sf):
    return D.table(spark, sf, "events").select("event_id", K.binary_label("event_type", "view").alias("label"))


_NB_ORDERS = (D.ORDERS_SQL, nb_sql("nb"))


@query(
    "p07_decode_label",
    with_sql(*_NB_ORDERS, select="SELECT row_id, ['F', 'O', 'P'][label + 1] AS true_label, ['F', 'O', 'P'][pred + 1] AS predicted_label FROM nb"),
)
def decode_label(spark, sf):
    scored, _ = D.scored(D.orders(spark, sf))
    classes = K.label_classes(D.table(spark, sf, "orders"), "o_orderstatus")
    out = K.decode_label(scored.select("row_id", "label", "pred"), "label", classes, "true_label")
    return K.decode_label(out, "pred", classes, "predicted_label").select("row_id", "true_label", "predicted_label")


@query("p08_misclassified", with_sql(*_NB_ORDERS, select="SELECT row_id, (label <> pred)::INTEGER AS is_misclassification FROM nb"))
def misclassified(spark, sf):
    scored, _ = D.scored(D.orders(spark, sf))
    return scored.select("row_id", K.misclassified().alias("is_misclassification"))


@query(
    "p09_probability_text",
    with_sql(*_NB_ORDERS, select="SELECT row_id, '[' || array_to_string(list_transform(prob, lambda p : printf('%.6f', p)), ';') || ']' AS probabilities FROM nb"),
)
def probability_text(spark, sf):
    scored, _ = D.scored(D.orders(spark, sf))
    return scored.select("row_id", V.as_text("prob", 6).alias("probabilities"))


@query("p10_argmax", with_sql(D.EVENTS_SQL, nb_sql("nb"), select="SELECT row_id, pred FROM nb"))
def argmax_class(spark, sf):
    scored, _ = D.scored(D.events(spark, sf))
    return scored.select("row_id", argmax("prob").alias("pred"))


@query("p11_confidence", with_sql(D.EVENTS_SQL, nb_sql("nb"), select="SELECT row_id, round(list_max(prob), 6) AS confidence FROM nb"))
def predicted_confidence(spark, sf):
    scored, _ = D.scored(D.events(spark, sf))
    return rounded(scored.select("row_id", confidence("prob").alias("confidence")))


def _spoiled():
    """Prices, with a NaN, an infinity or a null planted by the last digit of the customer key."""
    digit = F.col("o_custkey") % 10
    return (
        F.when(digit == 0, F.lit(math.nan))
        .when(digit == 1, F.lit(math.inf))
        .when(digit == 2, F.lit(-math.inf))
        .when(digit == 3, F.lit(None).cast("double"))
        .otherwise(F.col("o_totalprice"))
    )


@query(
    "p12_clean_features",
    "SELECT o_orderkey, CASE WHEN o_custkey % 10 < 4 THEN 0.0 ELSE o_totalprice END AS price, o_custkey::DOUBLE AS other FROM orders",
)
def clean_features(spark, sf):
    o = D.table(spark, sf, "orders").select(
        "o_orderkey", V.vector(F.array(_spoiled(), F.col("o_custkey").cast("double")), 2, "features")
    )
    clean = K.clean_features(o)
    return clean.select("o_orderkey", V.item("features", 0).alias("price"), V.item("features", 1).alias("other"))


@query("p13_clean_measures", "SELECT o_orderkey, CASE WHEN o_custkey % 10 < 4 THEN -10.0 ELSE o_totalprice END AS um FROM orders")
def clean_measures(spark, sf):
    o = D.table(spark, sf, "orders")
    return o.select("o_orderkey", V.clean_measure(_spoiled()).alias("um"))


@query(
    "p14_clean_judge_inputs",
    """SELECT o_orderkey, CASE o_custkey % 10 WHEN 0 THEN 0.0 WHEN 1 THEN 1.7976931348623157e308
       WHEN 2 THEN -1.7976931348623157e308 WHEN 3 THEN 0.0 ELSE o_totalprice END AS um FROM orders""",
)
def clean_judge_inputs(spark, sf):
    o = D.table(spark, sf, "orders")
    return o.select("o_orderkey", V.clean_judge_input(_spoiled()).alias("um"))


@query(
    "p15_measure_subset",
    with_sql(*_NB_ORDERS, select=f"SELECT row_id, round(list_max(prob), 6) AS first, round({certainty_sql('prob', 3)}, 6) AS second FROM nb"),
)
def measure_subset(spark, sf):
    scored, _ = D.scored(D.orders(spark, sf))
    inputs = K.judge_inputs(_prob_measures(scored, 3), ["um_max_prob", "um_entropy"])
    return rounded(inputs.select("row_id", V.item("um_vector", 0).alias("first"), V.item("um_vector", 1).alias("second")))


@query(
    "p16_append_measures",
    with_sql(*_NB_ORDERS, select=f"""SELECT row_id, f[1] AS price, f[2] AS balance, label, pred,
       round(list_max(prob), 6) AS um_max_prob, round({certainty_sql('prob', 3)}, 6) AS um_entropy FROM nb"""),
)
def append_measures(spark, sf):
    scored, _ = D.scored(D.orders(spark, sf))
    out = scored.withColumns(
        {"um_max_prob": confidence("prob"), "um_entropy": certainty("prob", 3, 3)}
    )
    return rounded(
        out.select(
            "row_id", V.item("features", 0).alias("price"), V.item("features", 1).alias("balance"),
            "label", "pred", "um_max_prob", "um_entropy",
        )
    )


@query(
    "p17_min_max",
    with_sql(
        D.EVENTS_SQL,
        D.long_sql("long"),
        "b AS (SELECT j, min(v) AS lo, max(v) AS hi FROM long GROUP BY j)",
        select="SELECT row_id, (j - 1)::INTEGER AS fid, round((v - lo) / (hi - lo), 6) AS x FROM long JOIN b USING (j)",
    ),
)
def min_max(spark, sf):
    df = D.events(spark, sf)
    m = moments(df)
    scaled = df.withColumn("features", V.min_max("features", m.low[0], m.high[0]))
    return rounded(scaled.select("row_id", F.posexplode("features").alias("fid", "x")))


@query(
    "p18_rejection",
    with_sql(*_NB_ORDERS, select="SELECT row_id, CASE WHEN list_max(prob) < 0.34 THEN NULL ELSE pred END AS wrapped_pred FROM nb"),
)
def rejection(spark, sf):
    scored, _ = D.scored(D.orders(spark, sf))
    judged = scored.withColumn("um", confidence("prob")).withColumn("misc_pred", threshold_judge("um", 0.34))
    return judged.select("row_id", K.rejected_to_null().alias("wrapped_pred"))


@query(
    "p19_drop_non_measures",
    with_sql(*_NB_ORDERS, select="SELECT row_id, (label <> pred)::INTEGER AS is_misclassification, round(list_max(prob), 6) AS um_max_prob FROM nb"),
)
def drop_non_measures(spark, sf):
    scored, _ = D.scored(D.orders(spark, sf))
    full = scored.select(
        "row_id",
        F.col("label").cast("string").alias("true_label"),
        F.col("pred").cast("string").alias("predicted_label"),
        V.as_text("prob").alias("probabilities"),
        K.misclassified().alias("is_misclassification"),
        confidence("prob").alias("um_max_prob"),
    )
    return rounded(K.drop_non_measures(full))


# --- shuffles, splits, samples --------------------------------------------------------------


@query("w04_shuffle", f"SELECT o_orderkey, {uniform_sql('7', 'o_orderkey')} AS u FROM orders")
def shuffle(spark, sf):
    o = D.table(spark, sf, "orders").select("o_orderkey", md5_uniform(7, F.col("o_orderkey")).alias("u"))
    return S.shuffled(o, "o_orderkey", 7)


@query("w05_two_way_split", f"SELECT event_id, CASE WHEN {uniform_sql('0', 'event_id')} < 0.3 THEN 'test' ELSE 'train' END AS split FROM events")
def two_way_split(spark, sf):
    return S.two_way_split(D.table(spark, sf, "events").select("event_id"), "event_id", 0.3)


@query(
    "w06_three_way_split",
    f"""SELECT event_id, CASE WHEN {uniform_sql('0', 'event_id')} < 0.35 THEN 'test'
       WHEN {uniform_sql('0', 'event_id')} < 0.6 THEN 'val' ELSE 'train' END AS split FROM events""",
)
def three_way_split(spark, sf):
    return S.three_way_split(D.table(spark, sf, "events").select("event_id"), "event_id", 0.35, 0.25)


_DOWNSAMPLE_SQL = f"""WITH n AS (SELECT sum(toxic) AS misc, sum(1 - toxic) AS normal FROM labels),
s AS (SELECT CASE WHEN misc / normal < 0.3 THEN misc / normal / 0.6 ELSE 1 END AS share FROM n)
SELECT doc_id, toxic FROM labels, s WHERE toxic = 1 OR {uniform_sql('0', 'doc_id')} < share"""


@query("w07_downsample", _DOWNSAMPLE_SQL)
def downsample(spark, sf):
    return S.downsample(D.table(spark, sf, "labels").select("doc_id", "toxic"), 0.3, "doc_id", "toxic")


@query("w10_union_of_samples", _DOWNSAMPLE_SQL)
def union_of_samples(spark, sf):
    labels = D.table(spark, sf, "labels").select("doc_id", "toxic")
    share = S.downsample_share(*S.class_counts(labels, "toxic"), 0.3)
    normal = labels.filter((F.col("toxic") == 0) & (md5_uniform(0, F.col("doc_id")) < share))
    return normal.unionByName(labels.filter("toxic = 1"))


@query(
    "w08_feature_subsets",
    with_sql(
        D.EMBEDDINGS_SQL,
        D.long_sql("long"),
        "m AS (SELECT unnest(range(0, 10)) AS member)",
        "j AS (SELECT unnest(range(0, 64)) AS j)",
        """pick AS (SELECT member, j FROM m, j
          QUALIFY row_number() OVER (PARTITION BY member ORDER BY md5(concat_ws('_', 0, member, j))) <= 38)""",
        select="SELECT member, row_id, round(sum(v), 6) AS total FROM long JOIN pick ON pick.j + 1 = long.j GROUP BY 1, 2",
    ),
)
def feature_subsets(spark, sf):
    df = D.embeddings(spark, sf)
    subsets = S.feature_subsets(D.EMBEDDING_WIDTH, 10)
    sums = [V.total([V.item("features", j) for j in subset]) for subset in subsets]
    out = df.select("row_id", F.posexplode(F.array(*sums)).alias("member", "total"))
    return rounded(out.withColumn("member", F.col("member").cast("long")))


@query(
    "w09_union_by_name",
    f"""SELECT row_id, um_max_prob, um_entropy, 0.0 AS um_price FROM ({_um_sql(D.EVENTS_SQL, 5, 'events')})
UNION ALL SELECT row_id, um_max_prob, 0.0, um_price FROM ({with_sql(*_NB_ORDERS, select="SELECT row_id, round(list_max(prob), 6) AS um_max_prob, f[1] AS um_price FROM nb")})""",
)
def union_by_name(spark, sf):
    left = _prob_measures(D.scored(D.events(spark, sf))[0], 5).select("row_id", "um_max_prob", "um_entropy")
    right = D.scored(D.orders(spark, sf))[0].select(
        "row_id", confidence("prob").alias("um_max_prob"), V.item("features", 0).alias("um_price")
    )
    return rounded(T.union_tables([left, right]))
