import numpy as np
import pytest
from helpers import vectors
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from doubtline.operators import cleaning as K
from doubtline.operators import metrics as Q
from doubtline.operators import sampling as S
from doubtline.operators.bounded import bounded_collect
from doubtline.operators.interval import IntervalBounds
from doubtline.operators.skew import lookup
from doubtline.operators.stats import covariance, exact_quantile, moments, running_totals
from doubtline.sources import tables as T

RATES = ["alpha", "eps", "phi", "alpha_w", "eps_w", "phi_c", "phi_m", "eps_gain", "phi_m_ratio", "overall"]


def judged(spark, rows):
    return spark.createDataFrame(rows, "label int, pred int, wrapped_pred int")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 2), st.booleans()), min_size=1, max_size=30))
def test_omission_metrics_are_a_confusion_matrix(spark, rows):
    data = [(y, p, None if reject else p) for y, p, reject in rows]
    m = Q.omission_metrics(judged(spark, data)).first()
    assert m.alpha_w + m.eps_w + m.phi == pytest.approx(1)
    assert m.phi_c + m.phi_m == pytest.approx(m.phi)
    tp = sum(y != p and r for y, p, r in rows)
    fp = sum(y == p and r for y, p, r in rows)
    fn = sum(y != p and not r for y, p, r in rows)
    assert m.eps_gain == pytest.approx(tp / (tp + fn) if tp + fn else 0)
    assert m.phi_m_ratio == pytest.approx(tp / (tp + fp) if tp + fp else 0)
    assert m.overall == pytest.approx(2 * tp / (2 * tp + fp + fn) if tp else 0)


def test_omission_metrics_edges(spark):
    none_rejected = Q.omission_metrics(judged(spark, [(0, 0, 0), (1, 0, 0)])).first()
    assert (none_rejected.phi, none_rejected.overall, none_rejected.eps_w) == (0, 0, 0.5)
    all_rejected = Q.omission_metrics(judged(spark, [(0, 0, None), (1, 0, None)])).first()
    assert (all_rejected.phi, all_rejected.eps_gain, all_rejected.phi_m_ratio) == (1, 1, 0.5)
    no_errors = Q.omission_metrics(judged(spark, [(0, 0, 0), (1, 1, 1)])).first()
    assert (no_errors.eps, no_errors.eps_gain, no_errors.overall) == (0, 0, 0)


def test_detection_scores_without_positives(spark):
    df = spark.createDataFrame([(0, 0), (0, 1)], "label int, pred int")
    row = Q.detection_metrics(df).first()
    assert (row.recall, row.precision, row.mcc, row.accuracy) == (0, 0, 0, 0.5)


def test_risk_curve_equals_one_threshold_at_a_time(spark):
    rng = np.random.default_rng(0)
    rows = [(int(a), int(b), float(u)) for a, b, u in zip(rng.integers(0, 2, 200), rng.integers(0, 2, 200), rng.random(200).round(2))]
    df = spark.createDataFrame(rows, "label int, pred int, um double").cache()
    curve = {r.threshold: r for r in Q.risk_curve(df, "um", [0.1, 0.5, 0.9]).collect()}
    for t in (0.1, 0.5, 0.9):
        one = df.withColumn("misc_pred", Q.threshold_judge("um", t)).withColumn("wrapped_pred", K.rejected_to_null())
        want = Q.omission_metrics(one).first()
        assert all(curve[t][c] == pytest.approx(want[c]) for c in RATES)


def test_best_candidate_takes_the_earliest_on_ties(spark):
    df = spark.createDataFrame([(2, 0.5), (1, 0.5), (0, 0.1)], "candidate int, mcc double")
    assert Q.best_candidate(df).first().candidate == 1


def test_roc_area_by_pairs(spark):
    rng = np.random.default_rng(1)
    score, label = rng.integers(0, 20, 300).astype(float), rng.integers(0, 2, 300)
    df = spark.createDataFrame(list(zip(score.tolist(), label.tolist())), "s double, label int")
    pos, neg = score[label == 1], score[label == 0]
    want = np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))
    assert Q.roc_area(df, "s").first().auc == pytest.approx(want)


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_with_a_hot_value(spark, descending):
    rng = np.random.default_rng(2)
    x = np.where(rng.random(900) < 1 / 3, 5.0, rng.normal(5, 3, 900).round(1))
    df = spark.createDataFrame([(float(v), 1) for v in x], "x double, c bigint")
    got = {r.x: r.cum_c for r in running_totals(df, "x", ["c"], descending=descending, buckets=6).collect()}
    values = np.unique(x)
    want = {v: int((x >= v).sum() if descending else (x <= v).sum()) for v in values}
    assert got == want


def test_running_totals_by_group(spark):
    rng = np.random.default_rng(3)
    rows = [(int(g), float(v), 1) for g, v in zip(rng.integers(0, 3, 600), rng.integers(0, 50, 600))]
    df = spark.createDataFrame(rows, "g int, x double, c bigint")
    for r in running_totals(df, "x", ["c"], by=["g"], buckets=4).collect():
        assert r.cum_c == sum(1 for g, v, _ in rows if g == r.g and v <= r.x)


@pytest.mark.parametrize("p", [0.0, 0.1, 0.5, 0.9, 0.999, 1.0])
def test_bracketed_quantile_is_exact(spark, p):
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.normal(size=3000), np.where(rng.random(3000) < 0.4, 7.0, rng.exponential(size=3000))])
    label = rng.integers(0, 2, 3000)
    df = vectors(spark, x, label)
    got = exact_quantile(df, p, by="label", small=40)
    for c in (0, 1):
        assert got[c] == pytest.approx(np.quantile(x[label == c], p, axis=0))
    assert exact_quantile(df, p)[None] == pytest.approx(np.quantile(x, p, axis=0))


def test_moments_narrow_and_wide(spark):
    rng = np.random.default_rng(5)
    for d in (3, 40):
        x, y = rng.normal(size=(200, d)), rng.integers(0, 3, 200)
        m = moments(vectors(spark, x, y), by="label")
        for i, c in enumerate(m.labels):
            assert m.mean[i] == pytest.approx(x[y == c].mean(axis=0))
            assert m.var[i] == pytest.approx(x[y == c].var(axis=0))
        whole = m.overall()
        assert whole.var[0] == pytest.approx(x.var(axis=0)) and whole.high[0] == pytest.approx(x.max(axis=0))


def test_covariance_far_from_zero(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 4)) @ rng.normal(size=(4, 4)) + 1e6
    _, mean, cov = covariance(vectors(spark, x).repartition(5))
    assert mean == pytest.approx(x.mean(axis=0)) and cov == pytest.approx(np.cov(x.T), rel=1e-8)


def test_interval_edges(spark):
    """A constant feature, a class of one row, a class without training rows."""
    x = [[1.0, 5.0], [2.0, 5.0], [3.0, 5.0], [9.0, 1.0]]
    df = vectors(spark, x, [0, 0, 0, 1])
    bounds = IntervalBounds.fit(df, 0.9, by="label")
    test = df.withColumn("pred", F.when(F.col("row_id") == 2, 2).otherwise(F.col("label")))
    got = {r.row_id: r.u for r in bounds.add_share(test, "u", width=2).collect()}
    assert got[1] == 0.5  # the median is inside, the constant feature counts as outside
    assert got[2] == 0.0 and got[3] == 0.0


def test_lookup_with_hot_key(spark):
    left = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    right = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = lookup(left, right, ["k"], hot_rows=10, hot_share=0.01)
    assert got.count() == 3000
    assert got.filter(F.col("v") != F.col("k") * 2).count() == 0


def test_bounded_collect_refuses(spark):
    with pytest.raises(ValueError):
        bounded_collect(spark.range(11), limit=10)


# --- cleaning and sampling ------------------------------------------------------------------


def test_factorize_and_fill(spark):
    df = spark.createDataFrame([(0, "b", None, "null"), (1, "a", 2.0, None), (2, "b", 3.0, "x")], "i int, y string, v double, t string")
    clean = K.fill_missing(df)
    assert [(r.v, r.t) for r in clean.orderBy("i").collect()] == [(0.0, "0"), (2.0, "0"), (3.0, "x")]
    assert [tuple(r) for r in K.label_classes(df, "y", "i").collect()] == [(0, "b"), (1, "a")]
    assert [tuple(r) for r in K.label_classes(df, "y").collect()] == [(0, "a"), (1, "b")]
    table, classes, names = T.tabular_dataset(df, "i", "y")
    assert names == ["v"] and classes.count() == 2 and table.columns == ["row_id", "features", "label"]


def test_downsampling_gives_twice_the_ratio(spark):
    df = spark.range(20000).select(F.col("id").alias("row_id"), (F.col("id") % 50 == 0).cast("int").alias("label"))
    out = S.downsample(df, 0.1, "row_id")
    misc, normal = S.class_counts(out, "label")
    assert misc == 400 and misc / normal == pytest.approx(0.2, rel=0.1)
    assert S.downsample(df, 0.001, "row_id").count() == 20000  # never thins out frequent errors
    assert S.downsample(df, None, "row_id").count() == 20000


def test_random_limit_is_exact_and_partition_invariant(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    picks = [{r.k for r in S.random_limit(df.repartition(n), 77, "k").collect()} for n in (1, 4, 16)]
    assert len(picks[0]) == 77 and picks[0] == picks[1] == picks[2]
    assert S.random_limit(df, float("nan"), "k").count() == 5000
    assert S.random_limit(df, 6000, "k").count() == 5000


def test_splits_do_not_depend_on_partitions(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    parts = [
        {(r.k, r.split) for r in S.three_way_split(df.repartition(n), "k", 0.35, 0.25).collect()} for n in (1, 4, 16)
    ]
    assert parts[0] == parts[1] == parts[2]
    shares = {s: sum(1 for _, x in parts[0] if x == s) / 2000 for s in ("train", "val", "test")}
    assert shares["test"] == pytest.approx(0.35, abs=0.04) and shares["val"] == pytest.approx(0.25, abs=0.04)


def test_bag_rates():
    assert [S.bag_rate(n) for n in (5, 20, 50, 100)] == [0.8, 0.7, 0.6, 0.5]
    subsets = S.feature_subsets(10, 5)
    assert all(len(s) == 8 and s == sorted(set(s)) for s in subsets)


def test_union_and_gate(spark, tmp_path):
    a = spark.createDataFrame([(0, 1.0)], "row_id int, um_a double")
    b = spark.createDataFrame([(1, 2.0)], "row_id int, um_b double")
    assert sorted(map(tuple, T.union_tables([a, b]).collect())) == [(0, 1.0, 0.0), (1, 0.0, 2.0)]
    rows = [("good", "m", 0, 0, 0.5)] * 9 + [("good", "m", 1, 1, 0.5)] + [("bad", "m", 2, 1, None)] * 5
    df = spark.createDataFrame(rows, "dataset string, clf string, row_id int, is_misclassification int, um_x double")
    df.write.partitionBy("dataset", "clf").parquet(str(tmp_path / "um"))
    kept = T.read_measure_tables(spark, str(tmp_path / "um"), min_accuracy=0.7)
    assert kept.count() == 10 and kept.select("dataset").distinct().first().dataset == "good"
    assert T.read_measure_tables(spark, str(tmp_path / "um"), avoid=["good"]).filter("um_x = 0").count() == 5


def test_dataset_scan_over_folder(spark, tmp_path):
    for name in ("one", "two", "skip_me"):
        spark.range(3).toPandas().to_csv(tmp_path / f"{name}.csv", index=False)
    df = T.read_datasets(spark, str(tmp_path), "id long", avoid=["skip"])
    assert {r.dataset: r["count"] for r in df.groupBy("dataset").count().collect()} == {"one": 3, "two": 3}
