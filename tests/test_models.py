import numpy as np
import pytest
from helpers import blobs, vectors
from pyspark.sql import functions as F

from doubtline.operators import detectors as T
from doubtline.operators.ensembles import ConfidenceBagging, ConfidenceBoosting, FeatureBags, FittedConfidenceBagging
from doubtline.operators.models import GaussianBayes, canonical, evaluate, load_fitted, make_model
from doubtline.operators.recon import Reconstructor, forward, gradient, initial, layer_sizes, parameter_count

NAMES = ["GNB", "LDA", "KNN", "SVM", "MNB", "BNB", "CNB", "LR", "RF", "DT", "GBC", "XGB", "LB"]
OPTIONS = {"GBC": {"rounds": 3}, "XGB": {"rounds": 3}, "LB": {"rounds": 3}}


@pytest.fixture(scope="module")
def three(spark):
    rng = np.random.default_rng(0)
    x, y = blobs(rng, 400, [[0, 0, 9], [9, 0, 0], [0, 9, 0]])
    return vectors(spark, x, y).cache()


@pytest.mark.parametrize("name", NAMES)
def test_every_classifier_learns_separated_classes(three, name):
    fitted, scored, report = evaluate(make_model(name, **OPTIONS.get(name, {})), three, three)
    rows = scored.select("prob", "pred").collect()
    assert all(sum(r.prob) == pytest.approx(1) and len(r.prob) == 3 for r in rows)
    # after min-max only the smallest value of a feature is 0, so 0/1 features say next to nothing
    assert report.first().accuracy > (0.3 if name == "BNB" else 0.95)
    weights = fitted.importances()
    assert weights is None or len(weights) == 3


@pytest.mark.parametrize("name", ["GNB", "SVM", "DT"])
def test_two_classes_and_reload(spark, tmp_path, name):
    rng = np.random.default_rng(1)
    x, y = blobs(rng, 300, [[0, 0], [6, 6]])
    df = vectors(spark, x, y)
    fitted = make_model(name).fit(df)
    fitted.save(spark, str(tmp_path / "m"))
    again = load_fitted(spark, str(tmp_path / "m"))
    a = {r.row_id: (r.pred, r.prob) for r in fitted.transform(df).collect()}
    b = {r.row_id: (r.pred, r.prob) for r in again.transform(df).collect()}
    assert a == b and all(len(p) == 2 for _, p in a.values())


def test_linear_svm_without_curvature_matrices(spark):
    """Conjugate gradients end at the weights that the matrices give."""
    rng = np.random.default_rng(11)
    x, y = blobs(rng, 900, [[0, 0, 3, 1], [3, 0, 0, 2], [0, 3, 0, 0]])
    df = vectors(spark, x, y)
    direct, wide = make_model("SVM", members=3, sample=0.4), make_model("SVM", members=3, sample=0.4)
    wide.curvature_numbers = 0
    a, b = direct.fit(df), wide.fit(df)
    assert np.abs(a.weights - b.weights).max() < 1e-6 and np.abs(a.scale - b.scale).max() < 1e-4
    # one label only, and two
    for one in (df.withColumn("label", F.lit(0)), df.filter("label < 2")):
        assert np.isfinite(wide.fit(one).weights).all()


def test_linear_svm_on_wide_vectors(spark):
    """Ten classes of 784 values: the curvatures of ten members would be 61.7 million numbers."""
    rng = np.random.default_rng(12)
    centres = rng.random((10, 784))
    y = np.arange(600) % 10
    df = vectors(spark, centres[y] + rng.normal(0, 0.3, (600, 784)), y).coalesce(1).cache()
    model = make_model("SVM")
    assert model.members * 10 * (785 * 786 + 1) > model.curvature_numbers
    report = evaluate(model, df, df)[2].first()
    assert report.accuracy > 0.95


def test_bayes_narrow_equals_wide(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(300, 5)), rng.integers(0, 3, 300)
    df = vectors(spark, x, y)
    fitted = GaussianBayes(scaled=True).fit(df)
    narrow = {r.row_id: r.prob for r in fitted.transform(df).collect()}
    import doubtline.operators.models as models

    limit, models.UNROLL_TERMS = models.UNROLL_TERMS, 0
    try:
        wide = {r.row_id: r.prob for r in fitted.transform(df).collect()}
    finally:
        models.UNROLL_TERMS = limit
    assert all(narrow[i] == pytest.approx(wide[i], abs=1e-9) for i in narrow)


def test_names():
    assert canonical("XGBoost") == "XGB" and canonical("IFOREST") == "IForest"
    with pytest.raises(ValueError):
        make_model("nothing")


# --- detectors ------------------------------------------------------------------------------

DETECTORS = ["COPOD", "ECOD", "HBOS", "MCD", "PCA", "CBLOF", "uKNN", "LOF", "INNE", "FastABOD", "COF", "IForest", "LODA"]


@pytest.mark.parametrize("name", DETECTORS)
def test_every_detector_finds_far_points(spark, tmp_path, name):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(190, 3)), rng.normal(size=(10, 3)) * 3 + rng.choice([-12, 12], (10, 3))])
    df = vectors(spark, x)
    options = {"IForest": {"trees": 50}}.get(name, {})
    fitted = make_model(name, 0.05, **options).fit(df)
    got = {r.row_id: r for r in fitted.transform(df).collect()}
    hits = sum(got[i].pred for i in range(190, 200))
    wrong = sum(got[i].pred for i in range(190))
    assert hits >= 5 and wrong <= 10
    assert all(sum(r.prob) == pytest.approx(1) and 0 <= min(r.prob) for r in got.values())
    if name not in ("COPOD", "LOF", "IForest"):
        return
    fitted.save(spark, str(tmp_path / "d"))
    again = {r.row_id: r.pred for r in load_fitted(spark, str(tmp_path / "d")).transform(df).collect()}
    assert again == {i: r.pred for i, r in got.items()}


def test_detector_probability_edges(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (5.0,)], "score double")

    def prob(threshold, low, high):
        cell = T.detector_probability(F.col("score"), threshold, low, high)
        return [r.prob for r in df.select(cell).collect()]

    # threshold 2: the farthest row on each side is certain, the row at the threshold undecided
    assert prob(2.0, -1.0, 3.0) == [[1.0, 0.0], [0.5, 0.5], [0.0, 1.0]]
    # all below: nothing is an anomaly
    assert all(p[0] >= 0.5 for p in prob(9.0, -8.0, -4.0))
    # the minimum is exactly at the threshold: strength 0.2 for the rows that are not above it
    assert prob(1.0, 0.0, 4.0)[0] == pytest.approx([0.6, 0.4])


def test_detector_on_new_rows_uses_training_bounds(spark):
    rng = np.random.default_rng(4)
    df = vectors(spark, rng.normal(size=(200, 2)))
    fitted = make_model("HBOS", 0.1).fit(df)
    one = vectors(spark, [[0.0, 0.0]], start=999)
    batch = fitted.transform(one).first().prob
    train = fitted.transform(one, bounds="train").first().prob
    assert batch == [1.0, 0.0] and 0.5 < train[0] <= 1.0


def test_large_clusters():
    assert T.large_clusters(np.array([50.0, 30, 10, 5, 5]), 0.75, 5) == [True, True, False, False, False]
    assert T.large_clusters(np.array([10.0, 90]), 0.75, 5) == [False, True]


def test_local_outlier_factor_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 2))
    k = 5
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :k]
    kd = np.take_along_axis(d, near, 1)[:, -1]
    lrd = 1 / (np.maximum(np.take_along_axis(d, near, 1), kd[near]).mean(axis=1) + 1e-10)
    want = lrd[near].mean(axis=1) / lrd
    df = vectors(spark, x)
    got = {r.row_id: r.score for r in T.LocalOutlierFactor(k=k).learn(df).train_scores(df).collect()}
    assert [got[i] for i in range(80)] == pytest.approx(want)


# --- ensembles ------------------------------------------------------------------------------


@pytest.mark.parametrize("build", [
    lambda b: FeatureBags(b, 4),
    lambda b: ConfidenceBagging(b, members=4, decisors=2),
    lambda b: ConfidenceBoosting(b, members=3),
])
def test_ensembles_learn_and_reload(spark, three, tmp_path, build):
    fitted = build(GaussianBayes()).fit(three)
    out = fitted.transform(three)
    assert out.filter("pred = label").count() / 400 > 0.9
    assert all(sum(r.prob) == pytest.approx(1) for r in out.select("prob").collect())
    if not isinstance(fitted, FittedConfidenceBagging):
        return
    fitted.save(spark, str(tmp_path / "e"))
    again = load_fitted(spark, str(tmp_path / "e"))
    again.load_members(spark, str(tmp_path / "e"))
    assert {(r.row_id, r.pred) for r in again.transform(three).collect()} == {(r.row_id, r.pred) for r in out.collect()}


# --- reconstruction -------------------------------------------------------------------------


def test_gradient_by_differences():
    rng = np.random.default_rng(6)
    sizes = layer_sizes(9, "deep")
    w, x = initial(sizes, 1) + 0.05, rng.random((5, 9))
    _, g = gradient(w, sizes, x, 0.0)
    for i in rng.choice(parameter_count(sizes), 12, replace=False):
        step = np.zeros_like(w)
        step[i] = 1e-6
        slope = (gradient(w + step, sizes, x, 0.0)[0] - gradient(w - step, sizes, x, 0.0)[0]) / 2e-6
        assert slope == pytest.approx(g[i], abs=1e-6)
    assert forward(w, sizes, x)[-1].shape == x.shape


@pytest.mark.parametrize("kind", ["simple", "sparse", "deep", "pca"])
def test_loss_falls_and_strange_rows_stand_out(spark, kind):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(600, 2)) @ rng.normal(size=(2, 6))
    x = np.concatenate([base, rng.uniform(base.min(), base.max(), (12, 6))])
    df = vectors(spark, x).repartition(2)
    coder = Reconstructor.fit(df, kind, epochs=12, batch=32)
    if kind != "pca":
        assert coder.history[-1] < coder.history[0]
    loss = {r.row_id: r.l for r in df.select("row_id", coder.loss().alias("l")).collect()}
    odd = np.mean([loss[i] for i in range(600, 612)])
    assert odd > np.mean([loss[i] for i in range(600)])


@pytest.mark.parametrize("name", ["ECOD", "COPOD"])
def test_rank_detectors_score_rows_and_not_ids(spark, name):
    """Rows that share an id or have none are scored as rows with ids of their own are."""
    rng = np.random.default_rng(4)
    train = vectors(spark, rng.normal(size=(200, 3)))
    fitted = make_model(name, 0.1).fit(train)
    x = rng.normal(size=(30, 3)).round(2)
    x[20:25] = x[0]
    apart = [(i, r.tolist()) for i, r in enumerate(x)]
    shared = [(None if i < 4 else 7 if i < 24 else i, r) for i, r in apart]
    schema = "row_id bigint, features array<double>"

    def scores(rows):
        from doubtline.functions.vectors import with_width

        df = with_width(spark.createDataFrame(rows, schema), "features", 3)
        return sorted((tuple(r.features), round(r.score, 9)) for r in fitted.score(df).collect())

    assert len(scores(apart)) == 30 and scores(shared) == scores(apart)


@pytest.mark.parametrize("kind", ["simple", "sparse", "deep"])
def test_autoencoder_does_not_depend_on_partitions(spark, monkeypatch, kind):
    from doubtline.operators import recon

    monkeypatch.setattr(recon, "SHARD_ROWS", 60)  # several shards of a small table
    rng = np.random.default_rng(12)
    x = rng.normal(size=(300, 6))
    x[::3] = x[0]  # a third of the rows are copies
    df = vectors(spark, x)
    fits = [recon.Reconstructor.fit(df.repartition(n), kind, epochs=6, batch=32) for n in (1, 3, 8)]
    for other in fits[1:]:
        np.testing.assert_allclose(other.weights, fits[0].weights, atol=1e-9)
        np.testing.assert_allclose(other.history, fits[0].history, atol=1e-9)


def test_one_shard_runs_its_epochs_in_a_row_with_the_result_of_a_plain_loop(spark):
    from doubtline.operators import recon

    rng = np.random.default_rng(13)
    df = vectors(spark, rng.uniform(size=(80, 4)))
    flat, sizes, history = recon.train_autoencoder(df, np.zeros(4), np.ones(4), "simple", 5, 16, train_split=2.0)
    assert len(history) == 5
    hashed = df.orderBy(F.xxhash64(F.col("row_id"), F.col("features").cast("array<double>"), F.lit(7)))
    x = np.array([r.features for r in hashed.collect()])
    size = parameter_count(sizes)
    state, step = np.concatenate([initial(sizes, 7), np.zeros(2 * size)]), 0
    for epoch in range(5):
        state, step, loss = recon.local_epoch(state, step, sizes, x, 16, 0.0, [7, epoch])
        assert abs(loss - history[epoch]) < 1e-12
    np.testing.assert_allclose(flat, state[:size], atol=1e-12)


def test_shards_of_the_autoencoder_follow_the_rows():
    from doubtline.operators.recon import shard_count

    assert [shard_count(n) for n in (0, 1, 8192, 8193, 10**7, 10**9, 10**10)] == [1, 1, 1, 2, 1024, 1024, 10_000]


def test_an_epoch_of_the_autoencoder_has_few_tasks(spark, monkeypatch):
    from doubtline.operators import recon

    assert [recon.task_count(n, 8) for n in (1, 7, 62, 640, 10_000)] == [1, 7, 8, 10, 157]
    monkeypatch.setattr(recon, "SHARD_ROWS", 20)
    monkeypatch.setattr(recon, "PIECE_BYTES", 100)  # several pieces in a shard
    df = vectors(spark, np.random.default_rng(14).normal(size=(300, 5)))
    fits = []
    for shards in (64, 2):
        monkeypatch.setattr(recon, "task_count", lambda n, cores, most=shards: min(n, most))
        fits.append(recon.Reconstructor.fit(df, "simple", epochs=4, batch=8))
    np.testing.assert_allclose(fits[0].weights, fits[1].weights, atol=1e-12)
    np.testing.assert_allclose(fits[0].history, fits[1].history, atol=1e-12)
