"""Classifiers, adjudicators, stored monitors, batch jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from doubtline.functions import vectors as V
from doubtline.operators import sampling as S
from doubtline.operators.cleaning import misclassified
from doubtline.operators.metrics import roc_area
from doubtline.operators.models import GaussianBayes, LinearDiscriminant, evaluate, make_model
from doubtline.plans.jobs import ablation_grid, batch_measures, default_groups, learn_from_tables, measure_subsets
from doubtline.plans.monitor import Monitor, experiment, list_monitors, supervised_preset, unsupervised_preset, vector_preset
from doubtline.queries import data as D
from doubtline.queries.data import lda_sql, nb_sql, with_sql
from doubtline.queries.measuring import MONITOR_SQL, spec_monitor
from doubtline.queries.registry import query, rounded
from doubtline.session import materialize, work_path


def _fit_and_score(model, df):
    out = model.fit(df).transform(df)
    return rounded(out.select("row_id", "pred", F.array_max("prob").alias("confidence")))


@query("c05_lda", with_sql(D.ORDERS_SQL, lda_sql("m"), select="SELECT row_id, pred, round(list_max(prob), 6) AS confidence FROM m"))
def lda(spark, sf):
    return _fit_and_score(LinearDiscriminant(), D.orders(spark, sf))


@query(
    "c06_gaussian_nb",
    with_sql(D.EVENTS_SQL, nb_sql("m", scaled=True), select="SELECT row_id, pred, round(list_max(prob), 6) AS confidence FROM m"),
)
def gaussian_nb(spark, sf):
    return _fit_and_score(make_model("GNB"), D.events(spark, sf))


@query(
    "c14_accuracy",
    with_sql(D.EVENTS_SQL, nb_sql("m", scaled=True), select="SELECT 'GNB' AS model, round(avg((pred = label)::INT), 6) AS accuracy FROM m"),
)
def accuracy(spark, sf):
    df = D.events(spark, sf)
    return rounded(evaluate(make_model("GNB"), df, df)[2])


SCORED = "SELECT row_id, pred, round(list_max(prob), 6) AS confidence FROM m"


def _register_models():
    plans = {
        "c01_xgb": ("XGB", {}),
        "c02_decision_tree": ("DT", {}),
        "c04_linear_svm": ("SVM", {}),
        "c07_multinomial_nb": ("MNB", {}),
        "c08_bernoulli_nb": ("BNB", {}),
        "c08_complement_nb": ("CNB", {}),
        "c09_logistic_regression": ("LR", {}),
        "c10_random_forest": ("RF", {}),
        "c11_logit_boost": ("LB", {}),
        "c12_gradient_boosting": ("GBC", {}),
    }
    for key, (name, options) in plans.items():

        def plan(spark, sf, name=name, options=options):
            return _fit_and_score(make_model(name, **options), D.events(spark, sf))

        kind = {"MNB": "multinomial", "BNB": "bernoulli", "CNB": "complement"}.get(name)
        query(key, with_sql(D.EVENTS_SQL, D.counted_nb_sql("m", kind), select=SCORED) if kind else None)(plan)


_register_models()


@query("a18_importances")
def importances(spark, sf):
    df = D.events(spark, sf)
    weights = make_model("RF").fit(df).importances()
    names = ["value", "hour", "weekday", "number"]
    return rounded(spark.createDataFrame(list(zip(names, map(float, weights))), "feature string, weight double"))


# --- monitors -------------------------------------------------------------------------------


def _splits(df, written=True):
    """Training, validation and test rows. The table is read, joined and split once; each split is read alone from then on."""
    parts = S.three_way_split(df, "row_id", 0.35, 0.25)
    if written:
        parts = materialize(parts, "splits", by="split")
    return [parts.filter(F.col("split") == s).drop("split") for s in ("train", "val", "test")]


def _light_monitor():
    return spec_monitor()


def _trained(spark, sf, monitor=None, build=D.orders, names=None):
    df = build(spark, sf).select("row_id", "features", "label")
    # the last digits of sums depend on the order of rows, and reports have all digits of the probabilities: sums of the table's own rows
    main = GaussianBayes().fit(_splits(df, written=False)[0])
    train, val, test = _splits(df)
    monitor = monitor or _light_monitor()
    scored = main.transform(train)
    monitor.fit(scored, main, names=names or D.STATUS)
    monitor.train(scored, main.transform(val))
    return monitor, main.transform(test)


@query(
    "m02_measure_one",
    f"SELECT * REPLACE (0::BIGINT AS row_id) FROM ({MONITOR_SQL}) WHERE row_id = (SELECT min(o_orderkey) FROM orders JOIN customer ON o_custkey = c_custkey)",
)
def measure_one(spark, sf):
    """The order of the least key as a single data point."""
    df = D.orders(spark, sf)
    scored, model = D.scored(df)
    monitor = spec_monitor().fit(scored, model, 3, D.STATUS)
    point = df.groupBy().agg(F.min_by("features", "row_id").alias("x")).first().x
    return rounded(monitor.measure_one(spark, point).select("row_id", *monitor.um_columns))


@query("m04_train_adjudicator")
def train_monitor(spark, sf):
    monitor, _ = _trained(spark, sf)
    return rounded(monitor.adjudicator.summary(spark))


@query("m05_candidate_search")
def candidate_search(spark, sf):
    monitor, _ = _trained(spark, sf)
    return rounded(monitor.adjudicator.candidates(spark).drop("seconds"))


@query("m06_judge")
def judge(spark, sf):
    monitor, test = _trained(spark, sf)
    out = monitor.report_table(test)
    return out.withColumn("features", V.as_text("features"))


@query("m07_misclassifications")
def predicted_errors(spark, sf):
    monitor, test = _trained(spark, sf)
    return monitor.misclassifications(test)


@query("m08_experiment")
def run_experiment(spark, sf):
    train, val, test = _splits(D.orders(spark, sf).select("row_id", "features", "label"))
    report = experiment(_light_monitor(), GaussianBayes(), train, val, test, D.STATUS, "orders")
    return rounded(report.drop("train_ms", "test_ms", "monitor_ms"))


@query("m09_supervised_preset")
def supervised(spark, sf):
    scored, model = D.scored(D.documents(spark, sf).select("row_id", "features", "label"))
    scored = materialize(scored, "scored")
    monitor = supervised_preset().fit(scored, model, names=["clean", "toxic"])
    return rounded(monitor.measure(scored).select("row_id", *monitor.um_columns))


@query("m10_unsupervised_preset")
def unsupervised(spark, sf):
    df = D.document_sizes(spark, sf)
    main = make_model("HBOS", 0.1).fit(df)
    scored = materialize(main.transform(df), "scored")
    monitor = unsupervised_preset(0.1).fit(scored, main, names=["normal", "anomaly"])
    return rounded(monitor.measure(scored).select("row_id", *monitor.um_columns))


@query("m11_vector_preset")
def vectors(spark, sf):
    scored, model = D.scored(D.embeddings(spark, sf))
    scored = materialize(scored, "scored")
    monitor = vector_preset().fit(scored, model, classes=D.EMBEDDING_CLASSES)
    return rounded(monitor.measure(scored).select("row_id", *monitor.um_columns))


# --- stored monitors ------------------------------------------------------------------------


def _stored(spark, sf):
    scored, model = D.scored(D.orders(spark, sf))
    folder = work_path(spark, "monitors")
    spec_monitor().fit(scored, model, 3, D.STATUS).save(spark, folder, "orders")
    return scored, folder


@query("s06_save_monitor")
def save_monitor(spark, sf):
    _, folder = _stored(spark, sf)
    return spark.read.parquet(f"{folder}/orders/um/params")


@query("s07_load_monitor", MONITOR_SQL)
def load_monitor(spark, sf):
    scored, folder = _stored(spark, sf)
    monitor = Monitor.load(spark, folder, "orders")
    return rounded(monitor.measure(scored).select("row_id", *monitor.um_columns))


@query("s08_list_monitors")
def stored_monitors(spark, sf):
    _, folder = _stored(spark, sf)
    return list_monitors(spark, folder)


# --- jobs -----------------------------------------------------------------------------------


# fixed values: the classifiers with labels of the usual batch
BATCH_CLASSIFIERS = ("LDA", "DT", "LR", "RF", "XGB", "GBC", "GNB", "KNN", "SVM", "LB")


def _batch(spark, sf):
    path = work_path(spark, "um-batch")
    datasets = {
        "orders": D.orders(spark, sf).select("row_id", "features", "label"),
        "events": D.events(spark, sf).select("row_id", "features", "label"),
        "documents": D.documents(spark, sf).select("row_id", "features", "label"),
    }
    batch_measures(datasets, BATCH_CLASSIFIERS, lambda model: supervised_preset(), path)
    return path


@query("m12_batch_measures")
def batch(spark, sf):
    table = spark.read.parquet(_batch(spark, sf))
    return rounded(
        table.groupBy("dataset", "clf").agg(
            F.count(F.lit(1)).alias("items"), F.avg("is_misclassification").alias("error_rate"),
            F.avg("um_max_prob").alias("um_max_prob"), F.avg("um_entropy").alias("um_entropy"),
        )
    )


@query("m13_learn_from_tables")
def learn(spark, sf):
    judge = learn_from_tables(spark, _batch(spark, sf), min_accuracy=0.15)
    return rounded(judge.candidates(spark).drop("seconds"))


@query("s09_report_sink")
def report_sink(spark, sf):
    out = work_path(spark, "report")
    learn_from_tables(spark, _batch(spark, sf), out=out, min_accuracy=0.15)
    chosen = spark.read.parquet(f"{out}/metrics").select("model", "mcc", "train_rows")
    table = spark.read.parquet(f"{out}/importances")
    # a model without importances still has its row
    return rounded(chosen.join(table, F.lit(True), "left").select("um", "weight", "model", "mcc", "train_rows"))


def _ablation_monitor():
    """The supervised preset and both confidence ensembles: each group of the ablation has its measures."""
    monitor = supervised_preset()
    return monitor.add_confidence_bagging(GaussianBayes()).add_confidence_boosting(GaussianBayes())


@query("m14_ablation_grid")
def ablation(spark, sf):
    train, val, test = _splits(D.orders(spark, sf).select("row_id", "features", "label"))
    main = GaussianBayes().fit(train)
    monitor = _ablation_monitor().fit(materialize(main.transform(train), "scored"), main, names=D.STATUS)
    subsets = measure_subsets(monitor.um_columns, default_groups(monitor.um_columns))
    grid = ablation_grid(monitor.measure(main.transform(val)), monitor.measure(main.transform(test)), subsets, "orders", "GNB")
    return rounded(grid)


@query("c13_classifier_interface")
def classifier_interface(spark, sf):
    """Errors of a forest on held-out rows, ranked by its doubt: area under the curve."""
    train, val, test = _splits(D.events(spark, sf).select("row_id", "features", "label"))
    scored = make_model("RF").fit(train).transform(test)
    doubt = scored.select(misclassified().alias("label"), (1.0 - F.array_max("prob")).alias("doubt"))
    return rounded(roc_area(doubt, "doubt"))


