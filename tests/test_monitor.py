import numpy as np
import pytest
from helpers import blobs, vectors
from pyspark.sql import functions as F

from doubtline.operators import measures as M
from doubtline.operators.ensembles import ConfidenceBagging
from doubtline.operators.models import GaussianBayes, LinearDiscriminant, make_model
from doubtline.plans.adjudicator import train_adjudicator
from doubtline.plans.jobs import ablation_grid, batch_measures, default_groups, learn_from_tables, measure_subsets
from doubtline.plans.monitor import Monitor, experiment, list_monitors
from doubtline.streaming.judge import drain, judge_batches, judge_stream, row_local

RATES = ["alpha", "eps", "phi", "alpha_w", "eps_w", "phi_c", "phi_m", "eps_gain", "phi_m_ratio", "overall"]


@pytest.fixture(scope="module")
def overlap(spark):
    """Two overlapping classes: errors sit between them, which the measures can see."""
    rng = np.random.default_rng(0)
    x, y = blobs(rng, 900, [[0, 0], [2.5, 2.5]])
    return vectors(spark, x, y).cache()


def row_local_monitor():
    return Monitor().add_confidence(level=0.9).add_maxprob().add_entropy().add_bayes().add_combined("LDA")


def full_monitor():
    monitor = row_local_monitor().add_multicombined(["GNB", "LDA"]).add_agreement([GaussianBayes(), "GNB", "LDA"])
    return monitor.add_neighbour(5).add_knn_distance(9).add_proximity(6, 0.2).add_proximity(6, 0.2, True)


def as_dict(df, columns):
    return {r.row_id: tuple(r[c] for c in columns) for r in df.collect()}


@pytest.fixture(scope="module")
def fitted(overlap):
    main = GaussianBayes().fit(overlap)
    scored = main.transform(overlap).cache()
    return full_monitor().fit(scored, main, names=["low", "high"]), scored, main


def test_properties_of_the_measures(fitted):
    monitor, scored, _ = fitted
    out = monitor.measure(scored)
    rows = out.collect()
    assert len(rows) == 900
    for r in rows:
        assert -1 <= r.um_combined_lda <= 1 and -1 <= r.um_multicombined_gnb_lda <= 1
        assert (r.um_neighbour_agreement_5 * 5) == pytest.approx(round(r.um_neighbour_agreement_5 * 5))
        assert 0 <= r.um_proximity_6_0_2 <= 1 and 0 <= r.um_proximity_6_0_2_w <= 1 + 1e-9
        assert sum(e.n for e in r.neighbour_detail_5) == 5
        counts = [e.n for e in r.neighbour_detail_5]
        assert counts == sorted(counts, reverse=True)
    assert out.schema["um_entropy"].metadata["display"] == "Entropy Calculator"


def test_distance_grows_with_k(fitted):
    _, scored, main = fitted
    ctx = M.FitContext(scored, 2, main)
    three, nine = M.KnnDistance(3).fit(ctx), M.KnnDistance(9).fit(ctx)
    out = M.apply_measures(scored, [three, nine], reference=scored)
    assert out.filter(F.col(three.um) > F.col(nine.um)).count() == 0


def test_no_noise_means_full_agreement(fitted):
    _, scored, main = fitted
    still = M.Proximity(4, 0.0).fit(M.FitContext(scored, 2, main))
    weighted = M.Proximity(4, 0.0, True).fit(M.FitContext(scored, 2, main))
    out = M.apply_measures(scored, [still, weighted], scorer=main)
    row = out.agg(F.min(still.um), F.max(still.um), F.min(weighted.um), F.max(weighted.um)).first()
    assert tuple(row) == (1.0, 1.0, -10.0, -10.0)  # all copies at distance 0 have no weights


def test_partitions_do_not_matter(fitted):
    monitor, scored, _ = fitted
    columns = monitor.um_columns
    parts = [as_dict(monitor.measure(scored.repartition(n)), columns) for n in (1, 4, 16)]
    for other in parts[1:]:
        assert all(parts[0][i] == pytest.approx(other[i], abs=1e-9) for i in parts[0])


def test_row_local_measures_do_not_shuffle(fitted):
    _, scored, main = fitted
    monitor = row_local_monitor().fit(scored, main)
    plan = monitor.measure(scored)._jdf.queryExecution().executedPlan().toString()
    final = plan.split("InMemoryRelation")[0]
    assert "Exchange hashpartitioning" not in final and "SortMergeJoin" not in final


def test_save_and_load_give_the_same_measures(spark, fitted, tmp_path):
    monitor, scored, _ = fitted
    monitor.save(spark, str(tmp_path), "mine")
    again = Monitor.load(spark, str(tmp_path), "mine")
    assert [r.monitor for r in list_monitors(spark, str(tmp_path)).collect()] == ["mine"]
    a, b = as_dict(monitor.measure(scored), monitor.um_columns), as_dict(again.measure(scored), again.um_columns)
    assert again.um_columns == monitor.um_columns
    assert all(a[i] == pytest.approx(b[i], abs=1e-12) for i in a)


def test_one_point(spark, fitted):
    monitor, scored, _ = fitted
    row = scored.filter("row_id = 7").first()
    one = monitor.measure_one(spark, row.features).first()
    whole = monitor.measure(scored).filter("row_id = 7").first()
    assert one.um_entropy == pytest.approx(whole.um_entropy)
    assert one.um_neighbour_agreement_5 == whole.um_neighbour_agreement_5


def test_broken_checker_is_left_out_of_the_vote(spark, fitted):
    _, scored, main = fitted

    class Broken(GaussianBayes):
        def fit(self, train):
            raise RuntimeError("no luck")

    broken = Broken()
    broken.name = "broken"
    vote = M.Agreement([GaussianBayes(), broken, LinearDiscriminant()]).fit(M.FitContext(scored, 2, main))
    assert vote.names == ["GaussianNB", "LDA"] and "no luck" in vote.failures["broken"]


def test_missing_features_are_zero(spark, fitted):
    monitor, _, main = fitted
    bad = spark.createDataFrame([(1, [float("nan"), float("inf")])], "row_id bigint, features array<double>")
    zero = spark.createDataFrame([(1, [0.0, 0.0])], "row_id bigint, features array<double>")
    prob = F.array(F.lit(0.3), F.lit(0.7)).alias("prob")
    pred = F.lit(1).alias("pred")
    a, b = (monitor.measure(d.select("*", prob, pred)).first() for d in (bad, zero))
    assert a.um_external_gaussiannb_entropy == b.um_external_gaussiannb_entropy


def test_adjudicator_finds_planted_errors(spark, overlap, tmp_path):
    parts = [overlap.filter(F.col("row_id") % 3 == i) for i in range(3)]
    main = GaussianBayes().fit(parts[0])
    monitor = row_local_monitor()
    scored = [main.transform(p) for p in parts]
    light = [make_model("DT", depth=4), LinearDiscriminant(), GaussianBayes(), make_model("LR")]
    monitor.train(scored[0], scored[1], main, ["low", "high"], light, (None, 0.3))
    assert monitor.adjudicator.chosen["mcc"] > 0
    table = monitor.adjudicator.candidates(spark)
    assert table.count() == 8 and table.filter("error is not null").count() == 0
    assert table.agg(F.max("mcc")).first()[0] == pytest.approx(monitor.adjudicator.chosen["mcc"])
    judged = monitor.judge(scored[2])
    assert judged.filter("misc_pred = 1 and wrapped_pred is not null").count() == 0
    assert judged.filter("misc_pred = 0 and wrapped_pred <> pred").count() == 0
    wrong = judged.filter("misc_pred = 1").agg(F.avg((F.col("label") != F.col("pred")).cast("int"))).first()[0]
    kept = judged.filter("misc_pred = 0").agg(F.avg((F.col("label") != F.col("pred")).cast("int"))).first()[0]
    assert wrong > kept
    names = monitor.report_table(scored[2]).first()
    assert names.true_label in ("low", "high") and names.probabilities.startswith("[")
    monitor.save(spark, str(tmp_path), "m")
    again = Monitor.load(spark, str(tmp_path), "m").misclassifications(scored[2])
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in monitor.misclassifications(scored[2]).collect()}


def test_failing_candidate_is_reported(spark, overlap):
    main = GaussianBayes().fit(overlap)
    wrong = (F.col("label") != F.col("pred")).cast("int").alias("is_misclassification")
    um = main.transform(overlap).select("row_id", wrong, F.array_max("prob").alias("um_max_prob"))

    class Broken(GaussianBayes):
        def fit(self, train):
            raise RuntimeError("no luck")

    judge = train_adjudicator(um, um, ["um_max_prob"], candidates=[Broken(), GaussianBayes()], ratios=(None,))
    assert "no luck" in judge.report[0]["error"] and judge.chosen["candidate"] == 1


def test_experiment_report(overlap):
    parts = [overlap.filter(F.col("row_id") % 3 == i) for i in range(3)]
    monitor = Monitor().add_maxprob().add_entropy().add_neighbour(5)
    row = experiment(monitor, "GNB", *parts, candidates=[GaussianBayes()], ratios=(None,), tag="t").first()
    assert all(0 <= row[c] <= 1 for c in RATES) and row.clf == "GNB" and row.monitor == "t"
    again = experiment(monitor, "LDA", parts[0], None, parts[2], tag="reused").first()
    assert again.clf == "LDA"


def test_batch_learn_and_ablation(spark, overlap, tmp_path):
    path = str(tmp_path / "um")
    make = lambda model: Monitor().add_maxprob().add_entropy().add_confidence_bagging(model, members=3)
    batch_measures({"a": overlap, "skip": overlap}, ["GNB", "LDA"], make, path, avoid=["skip"])
    stored = spark.read.parquet(path)
    assert {tuple(r) for r in stored.select("dataset", "clf").distinct().collect()} == {("a", "GNB"), ("a", "LDA")}
    out = str(tmp_path / "out")
    judge = learn_from_tables(spark, path, out, 0.5, candidates=[GaussianBayes(), make_model("DT", depth=3)], ratios=(None, 0.2))
    assert spark.read.parquet(f"{out}/metrics").first().mcc == pytest.approx(judge.chosen["mcc"])
    assert spark.read.parquet(f"{out}/candidates").count() == 4
    main = GaussianBayes().fit(overlap)
    monitor = row_local_monitor().fit(main.transform(overlap), main)
    um = monitor.measure(main.transform(overlap))
    subsets = measure_subsets(monitor.um_columns, default_groups(monitor.um_columns))
    stats = str(tmp_path / "grid")
    grid = ablation_grid(um, um, subsets, "a", "GNB", make_model("DT", depth=3), stats)
    assert grid.count() == len(subsets) == spark.read.parquet(stats).count()


def test_spec_builds_the_same_measures():
    spec = [
        {"measure": "confidence", "level": 0.9}, {"measure": "combined", "model": {"name": "XGB", "rounds": 3}},
        {"measure": "agreement", "models": ["GNB", "LDA"]}, {"measure": "proximity", "points": 3, "weighted": False},
    ]
    monitor = Monitor.from_spec(spec)
    assert [type(m).__name__ for m in monitor.measures] == ["ConfidenceInterval", "Combined", "Agreement", "Proximity"]
    assert monitor.measures[3].weighted is False
    assert ConfidenceBagging(GaussianBayes()).decisors == 6


# --- streams --------------------------------------------------------------------------------


def test_stream_equals_batch(spark, overlap, fitted, tmp_path):
    _, scored, main = fitted
    source = str(tmp_path / "in")
    overlap.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(overlap.schema).option("maxFilesPerTrigger", 1).parquet(source)
    monitor = row_local_monitor().add_external(make_model("HBOS", 0.1), 2).fit(scored, main)
    assert row_local(monitor)
    out = drain(judge_stream(stream, monitor), str(tmp_path / "out"), str(tmp_path / "state"))
    want = as_dict(monitor.measure(scored, bounds="train"), monitor.um_columns)
    got = as_dict(out, monitor.um_columns)
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-12) for i in got)


def test_shuffling_measures_need_batches(spark, overlap, fitted, tmp_path):
    monitor, scored, _ = fitted
    source = str(tmp_path / "in")
    overlap.repartition(2).write.parquet(source)
    stream = spark.readStream.schema(overlap.schema).option("maxFilesPerTrigger", 1).parquet(source)
    with pytest.raises(ValueError):
        judge_stream(stream, monitor)
    path = str(tmp_path / "out")
    judge_batches(stream, monitor, path, str(tmp_path / "state")).awaitTermination()
    got = as_dict(spark.read.parquet(path), monitor.um_columns)
    want = as_dict(monitor.measure(scored), monitor.um_columns)
    assert all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)


def test_models_with_one_name_and_other_parameters_are_fitted_apart(overlap):
    ctx = M.FitContext(overlap, 2)
    one = ctx.fit_model(ConfidenceBagging(GaussianBayes(), members=3))
    two = ctx.fit_model(ConfidenceBagging(LinearDiscriminant(), members=3))
    assert one is not two and one.name != two.name
    assert ctx.fit_model(ConfidenceBagging(GaussianBayes(), members=3)) is one
    shallow, deep = ctx.fit_model(make_model("DT", depth=2)), ctx.fit_model(make_model("DT", depth=9))
    assert shallow is not deep and shallow.name != deep.name
    assert ctx.fit_model(make_model("HBOS", 0.1)) is not ctx.fit_model(make_model("HBOS", 0.4))
    monitor = Monitor([M.ConfidenceBaggingMeasure(GaussianBayes(), members=3), M.ConfidenceBaggingMeasure(LinearDiscriminant(), members=3)])
    main = GaussianBayes().fit(overlap)
    monitor.fit(main.transform(overlap), main)
    assert len(monitor.um_columns) == 2


@pytest.mark.parametrize("name", ["KNN", "GNB"])
@pytest.mark.parametrize("points", [4])
def test_copies_are_scored_one_by_one(spark, overlap, name, points):
    """The share over all copies equals scoring each noisy copy as a row of its own."""
    main = make_model(name).fit(overlap)
    few = overlap.orderBy("row_id").limit(40)
    scored = main.transform(few)
    measure = M.Proximity(points, 2.0).fit(M.FitContext(overlap, 2, main))
    got = {r.row_id: r.um_proximity_4_2_0 for r in M.apply_measures(scored, [measure], scorer=main).collect()}
    deviations = np.array(measure.deviations)
    share = {}
    for copy in range(1, points + 1):
        noisy = few.withColumn("__base", F.col("features")).withColumn("features", measure.noisy("row_id", f"{copy}"))
        noisy = noisy.withColumn("row_id", F.col("row_id") * 100 + copy).drop("__base")
        from doubtline.functions.vectors import with_width

        for r in main.transform(with_width(noisy, "features", len(deviations))).collect():
            share.setdefault(r.row_id // 100, []).append(r.pred)
    own = {r.row_id: r.pred for r in scored.collect()}
    assert got == {i: pytest.approx(np.mean([p == own[i] for p in preds])) for i, preds in share.items()}
    assert len(set(got.values())) > 1


def test_rank_detector_as_main_model(overlap):
    main = make_model("ECOD", 0.1).fit(overlap)
    scored = main.transform(overlap)
    measure = M.Proximity(5, 0.0).fit(M.FitContext(overlap, 2, main))
    copies = M.apply_measures(scored, [measure], scorer=main).collect()
    # without noise every copy is the row itself
    assert {r.um_proximity_5_0_0 for r in copies} == {1.0}


def test_black_box_is_saved_by_its_factory(spark, overlap, tmp_path):
    from doubtline.operators.models import BlackBox, black_box_factory

    @black_box_factory("test-threshold")
    def threshold(cut):
        return lambda x: F.array(F.when(x[0] > cut, 0.1).otherwise(0.9), F.when(x[0] > cut, 0.9).otherwise(0.1))

    box = BlackBox("cut", None, 2, "test-threshold", {"cut": 1.0})
    monitor = Monitor().add_maxprob().add_proximity(3, 0.5).fit(box.transform(overlap), box)
    monitor.save(spark, str(tmp_path), "box")
    again = Monitor.load(spark, str(tmp_path), "box")
    columns = monitor.um_columns
    assert as_dict(again.measure(again.scorer.transform(overlap)), columns) == as_dict(monitor.measure(box.transform(overlap)), columns)
    with pytest.raises(NotImplementedError):
        BlackBox("bare", lambda x: x, 2).state()


def test_contamination_sets_the_threshold_of_boosting(overlap):
    from doubtline.operators.ensembles import ConfidenceBoosting

    scored = GaussianBayes().fit(overlap).transform(overlap, "__p", "__y")
    boost = ConfidenceBoosting(GaussianBayes(), contamination=0.2)
    cut = boost.threshold(scored)
    share = np.mean([max(r["__p"]) < cut for r in scored.collect()])
    assert abs(share - 0.2) < 0.01 and ConfidenceBoosting(GaussianBayes()).threshold(scored) == 0.8


def test_groups_of_the_ablation_do_not_mix():
    columns = ["um_combined_lda", "um_combined_confidencebagger_10", "um_external_lda_entropy"]
    groups = default_groups(columns)
    assert groups["checkers"] == ["um_combined_lda", "um_external_lda_entropy"]
    assert groups["ensembles"] == ["um_combined_confidencebagger_10"]


@pytest.mark.parametrize("name", ["m04_train_adjudicator", "m05_candidate_search", "m06_judge", "m07_misclassifications", "m08_experiment", "m13_learn_from_tables", "s09_report_sink"])
def test_registered_searches_use_the_whole_grid(spark, sf, monkeypatch, name):
    """The candidates and ratios that reach the adjudicator's training are the engine's defaults."""
    from doubtline.plans import adjudicator, jobs, monitor
    from doubtline.queries import all_queries, learning

    class Reached(Exception):
        pass

    def stop(train, val, um_columns, *args, candidates=None, ratios=adjudicator.RATIOS, **options):
        models = adjudicator.search_candidates() if candidates is None else candidates
        raise Reached([m.name for m in models], tuple(ratios))

    monkeypatch.setattr(monitor, "train_adjudicator", stop)
    monkeypatch.setattr(jobs, "train_adjudicator", stop)
    monkeypatch.setattr(learning, "spec_monitor", lambda: Monitor().add_maxprob())
    few = spark.createDataFrame(
        [("a", "GNB", i, i % 4 == 0, i / 9) for i in range(9)],
        "dataset string, clf string, row_id bigint, is_misclassification boolean, um_max_prob double",
    ).withColumn("is_misclassification", F.col("is_misclassification").cast("int"))
    monkeypatch.setattr(learning, "_batch", lambda spark, sf: "")
    monkeypatch.setattr(jobs, "read_measure_tables", lambda *args: few)
    pooled = name.startswith(("m13", "s09"))
    with pytest.raises(Reached) as found:
        all_queries()[name](spark, sf)
    whole = adjudicator.pooled_candidates() if pooled else adjudicator.search_candidates()
    assert found.value.args == ([m.name for m in whole], adjudicator.RATIOS)


def test_registered_ablation_has_all_groups(spark, sf, monkeypatch):
    """The measures of every group are in the monitor, and the model is the default."""
    from doubtline.queries import all_queries, learning

    seen = {}

    def fit(self, *args, **options):
        seen["measures"] = {type(m) for m in self.measures}
        return self

    def grid(val, test, subsets, dataset, clf, model=None):
        seen["model"] = model
        return val

    monkeypatch.setattr(Monitor, "fit", fit)
    monkeypatch.setattr(Monitor, "measure", lambda self, scored: scored)
    monkeypatch.setattr(learning, "ablation_grid", grid)
    all_queries()["m14_ablation_grid"](spark, sf)
    groups = {
        M.ConfidenceInterval, M.ReconstructionLoss, M.MaxProb, M.Entropy, M.External, M.Combined, M.MultiCombined,
        M.Neighbours, M.Proximity, M.ConfidenceBaggingMeasure, M.ConfidenceBoostingMeasure,
    }
    assert groups <= seen["measures"] and seen["model"] is None


def test_registered_batch_and_boosting_are_whole(spark, sf, monkeypatch):
    """All classifiers under the preset, and the default rounds."""
    from doubtline.operators.models import make_model
    from doubtline.plans.monitor import supervised_preset
    from doubtline.queries import all_queries, learning

    seen = {}
    monkeypatch.setattr(learning, "_fit_and_score", lambda model, df: model.name)
    assert all_queries()["c01_xgb"](spark, sf) == make_model("XGB").name

    def stop(datasets, classifiers, monitor_for, path):
        seen.update(datasets=set(datasets), classifiers=set(classifiers), measures=[type(m) for m in monitor_for(None).measures])

    monkeypatch.setattr(learning, "batch_measures", stop)
    learning._batch(spark, sf)
    assert seen["datasets"] == {"orders", "events", "documents"}
    assert seen["classifiers"] == {"LDA", "DT", "LR", "RF", "XGB", "GBC", "GNB", "KNN", "SVM", "LB"}
    assert seen["measures"] == [type(m) for m in supervised_preset().measures]


def test_detectors_read_rows_without_the_neighbour_lists(spark, monkeypatch):
    """Copies and the neighbour join come after the checkers, which may read the rows several times."""
    from doubtline.operators import detectors as T
    from doubtline.operators import measures as M
    from doubtline.operators.models import GaussianBayes

    rows = [(i, [float(i % 7), float(i % 11)], i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "row_id bigint, features array<double>, label int")
    main = GaussianBayes().fit(df)
    scored = main.transform(df)
    seen = []
    score = T.FittedTails.score
    monkeypatch.setattr(T.FittedTails, "score", lambda self, rows, out="score": seen.extend(rows.columns) or score(self, rows, out))
    monitor = Monitor([M.Neighbours(3), M.Proximity(3), M.External(T.TailDetector("ECOD", 0.1), 2)]).fit(scored, main, 2)
    out = monitor.measure(scored)
    assert seen and not any(c == "nn" or c.startswith("um_") for c in seen)
    assert out.count() == 80 and all(r[c] is not None for r in out.collect() for c in monitor.um_columns)


def test_members_of_equal_subsets_are_fitted_and_scored_once(spark, monkeypatch):
    from doubtline.operators import detectors as T
    from doubtline.operators.ensembles import FeatureBags

    fits, scores = [], []
    learn, score = T.TailDetector.learn, T.FittedTails.score
    monkeypatch.setattr(T.TailDetector, "learn", lambda self, train: fits.append(1) or learn(self, train))
    monkeypatch.setattr(T.FittedTails, "score", lambda self, rows, out="score": scores.append(1) or score(self, rows, out))
    df = spark.createDataFrame([(i, [float(i), float(i * i % 17)]) for i in range(40)], "row_id bigint, features array<double>")
    bags = FeatureBags(T.TailDetector("COPOD", 0.1), 10).fit(df)
    own = len(set(map(tuple, bags.subsets)))
    out = bags.transform(df).collect()
    assert len(bags.members) == 10 and len(fits) == len(scores) == own < 10
    assert all(abs(sum(r.prob) - 1.0) < 1e-9 for r in out) and len(out) == 40
