"""Trees grown together: the same in both forms, prefixes of longer models, shared fits; proximity around models that move rows."""

import numpy as np
import pytest
from helpers import blobs, vectors
from pyspark.sql import functions as F

from doubtline.operators import measures as M
from doubtline.operators import trees as T
from doubtline.operators.models import GaussianBayes, load_fitted, make_model


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(3)
    x, y = blobs(rng, 500, [[0, 0, 1], [1.5, 1, 0]])
    return vectors(spark, x, y).cache()


def same(a, b):
    return all(np.array_equal(getattr(a, n), getattr(b, n)) for n in ("feature", "cut", "left", "right", "value", "roots")) and a.start == b.start


def test_both_forms_and_any_partitions_give_equal_trees(noisy):
    models = [make_model("XGB", rounds=4), make_model("GBC", rounds=12), make_model("RF", trees=3, depth=5), make_model("DT", depth=6)]
    shares, columns = [1.0, 0.5, 0.8, 1.0], [None, None, None, [0, 2]]
    here = T.fit_together(noisy, models, shares, columns)
    spread = T.fit_together(noisy.repartition(7), models, shares, columns, local_bytes=0)
    for a, b in zip(here, spread):
        assert all(same(p, q) for p, q in zip(a.trees, b.trees)), a.name
    assert set(here[3].trees[0].feature.tolist()) <= {0, 2}


def test_fewer_rounds_are_the_beginning_of_more(noisy, monkeypatch):
    names = [("XGB", "rounds", 3, 8), ("GBC", "rounds", 2, 5), ("RF", "trees", 3, 12)]
    for name, option, few, many in names:
        short, long = (make_model(name, **{option: n}) for n in (few, many))
        alone = short.fit(noisy).trees[0]
        grown = []
        real = T.grow_in_tasks
        monkeypatch.setattr(T, "grow_in_tasks", lambda table, plans, width: grown.extend(plans) or real(table, plans, width))
        together = T.fit_together(noisy, [short, long])
        monkeypatch.undo()
        assert len(grown) == 1 and grown[0].count == many
        x = np.random.default_rng(1).normal(size=(50, 3))
        bins = T.binned(x, together[0].cuts)
        assert np.array_equal(alone.total(bins), together[0].trees[0].total(bins))


def test_trees_survive_saving(spark, noisy, tmp_path):
    fitted = make_model("XGB", rounds=3).fit(noisy)
    fitted.save(spark, str(tmp_path / "m"))
    again = load_fitted(spark, str(tmp_path / "m"))
    x = np.random.default_rng(2).normal(size=(20, 3))
    assert np.array_equal(fitted.probabilities(x), again.probabilities(x))
    weights = fitted.importances()
    assert len(weights) == 3 and abs(sum(weights) - 1) < 1e-9


def test_a_store_fits_once(noisy):
    store = M.FitStore(noisy)
    for main in (GaussianBayes(), make_model("LDA")):
        scored = main.fit(noisy).transform(noisy)
        ctx = M.FitContext(scored, 2, store=store)
        store.together([make_model("DT", depth=3), make_model("RF", trees=2)])
        for recipe in (make_model("DT", depth=3), make_model("RF", trees=2), GaussianBayes()):
            ctx.fit_model(recipe)
        M.ConfidenceInterval(0.9).fit(ctx)
        M.Proximity().fit(ctx)
    assert len(store.fits) == 5 and set(store.fits.values()) == {1}


@pytest.mark.parametrize("name", ["ECOD", "KNN", "GNB", "DT"])
def test_proximity_of_copies_without_noise_is_whole(noisy, name):
    """Null and repeated ids, clashing names; models that move rows and models that don't."""
    main = make_model(name).fit(noisy)
    rows = noisy.limit(20).unionByName(noisy.limit(3)).withColumn("__row", F.lit(1)).withColumn("key", F.lit(2))
    if name != "KNN":
        rows = rows.unionByName(rows.limit(2).withColumn("row_id", F.lit(None).cast("long")))
    scored = main.transform(rows)
    fitted = M.Proximity(4, 0.0, seed=1).fit(M.FitContext(noisy, 2, main))
    got = M.apply_measures(scored, [fitted], scorer=main)
    assert got.columns == [*scored.columns, fitted.um]
    values = [r[0] for r in got.select(fitted.um).collect()]
    assert len(values) == rows.count() and (values == [1.0] * len(values) or name == "ECOD")


def test_rows_of_equal_bins_are_one_cell(spark, monkeypatch):
    """Many rows of few different vectors are grown in tasks, with the trees that passes over all rows give."""
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 4, (900, 3)).astype(float), rng.integers(0, 3, 900)
    rows = vectors(spark, x, y)
    models = [make_model("XGB", rounds=3), make_model("RF", trees=3), make_model("DT")]
    passes = T.fit_together(rows, models, [1.0, 0.7, 0.4], local_bytes=0)
    monkeypatch.setattr(T, "grow_on_spark", lambda *a: pytest.fail("passes over all rows"))
    cells = T.fit_together(rows, models, [1.0, 0.7, 0.4], local_bytes=64 * (3 + 24))
    for a, b in zip(passes, cells):
        assert all(same(p, q) for p, q in zip(a.trees, b.trees)), a.name


def test_verdicts_are_counted_on_cells(spark, noisy):
    """Each model scores rows of equal bins once; the counts are those of all rows, without labels other than 0 and 1."""
    from doubtline.plans.adjudicator import _confusions

    rng = np.random.default_rng(6)
    x, y = rng.integers(0, 4, (900, 3)).astype(float), rng.integers(0, 2, 900)
    rows = vectors(spark, x, y)
    models = T.fit_together(rows, [make_model("XGB", rounds=3), make_model("RF", trees=3), make_model("DT", depth=2)])
    odd = rows.limit(5)
    more = rows.repartition(5).unionByName(odd.withColumn("label", F.lit(None).cast("int"))).unionByName(odd.withColumn("label", F.lit(2)))
    scored = spark.sparkContext.accumulator(0)

    class Counting(T.FittedTrees):
        def of_bins(self, bins):
            scored.add(len(bins))
            return super().of_bins(bins)

    told = _confusions(more, [Counting(m.name, m.kind, m.classes, m.cuts, m.trees) for m in models])
    assert 0 < scored.value <= 3 * 2 * 4**3  # models, labels, vectors
    for model, counts in zip(models, told):
        said = np.array([r.pred for r in model.transform(rows).orderBy("row_id").collect()])
        assert counts == tuple(int(((y == a) & (said == b)).sum()) for a, b in ((1, 1), (0, 0), (0, 1), (1, 0)))
    assert _confusions(rows.limit(0), models) == [(0, 0, 0, 0)] * 3


def test_weights_of_a_forest_follow_the_law():
    """The table of first bits gives the numbers that the law's steps give, at its steps, too."""
    x = np.random.default_rng(7).integers(0, 2**63, 200_000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    steps = np.array([int(p * 2**53) + d for p in T.POISSON[:11] for d in (0, 1)], np.uint64) << np.uint64(11)
    for some in (x, steps):
        assert np.array_equal(T.poisson(some), np.searchsorted(T.POISSON, (some >> np.uint64(11)).astype(float) / float(1 << 53), side="right"))


def test_splits_are_read_alone(spark):
    """The table is split and written once; each split is then read from its own folder, without a shuffle."""
    from doubtline.queries.learning import _splits

    rows = vectors(spark, np.random.default_rng(8).normal(size=(400, 2)), np.arange(400) % 3)
    parts = _splits(rows)
    seen = [{r.row_id for r in p.collect()} for p in parts]
    assert sum(map(len, seen)) == 400 and set.union(*seen) == set(range(400)) and all(p.schema["features"].metadata == {"width": 2} for p in parts)
    for part in parts:
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert part.columns == ["row_id", "features", "label"] and "PartitionFilters: [isnotnull(split" in plan and "Exchange" not in plan


def test_checkers_are_fitted_side_by_side(noisy, monkeypatch):
    """A monitor fits checkers and bounds ahead, each once; one that fails is left to its measure."""
    from doubtline.plans.monitor import Monitor

    class Broken(GaussianBayes):
        def fit(self, train):
            raise RuntimeError("no")

    ahead = []
    real = M.FitStore.ahead
    monkeypatch.setattr(M.FitStore, "ahead", lambda self, jobs: (ahead.append(len(jobs)), real(self, jobs), ahead.append(dict(self.fits))))
    main = GaussianBayes().fit(noisy)
    monitor = Monitor([M.ConfidenceInterval(0.9), M.Combined(make_model("LDA")), M.Agreement([make_model("LDA"), GaussianBayes(), Broken()])])
    monitor.fit(main.transform(noisy), main, 2)
    assert ahead[0] == 5 and len(ahead[1]) == 3 and set(ahead[1].values()) == {1}
    assert list(monitor.fitted[2].failures) == ["GaussianNB"]


def test_few_votes_are_compared_one_by_one(spark):
    """The same share as that of the votes in an array, nulls included, without a function over arrays."""
    from doubtline.functions.prob import vote_share

    votes = [(1, 1, 2), (1, 2, 3), (None, 1, 1), (None, None, 4), (None, None, None)]
    df = spark.createDataFrame(votes, "a int, b int, c int")
    out = df.select(vote_share(F.array("a", "b", "c")).alias("x"), vote_share([F.col(c) for c in "abc"]).alias("y"), vote_share([F.col("a")]).alias("z"))
    rows = out.collect()
    assert [r.x for r in rows] == [r.y for r in rows] and [r.z for r in rows] == [1.0, 1.0, 0.0, 0.0, 0.0]
    assert "lambda" not in df.select(vote_share([F.col(c) for c in "abc"]))._jdf.queryExecution().executedPlan().toString()


def test_rows_of_equal_bins_are_scored_once_in_a_task(noisy, monkeypatch):
    fitted = T.fit_together(noisy, [make_model("XGB", rounds=4), make_model("RF", trees=3, depth=5)])
    x = np.array([r.features for r in noisy.limit(50).collect()], float)
    x = np.concatenate([x, x, np.full((1, 3), np.nan)])
    scored, of_bins = [], T.FittedTrees.of_bins
    monkeypatch.setattr(T.FittedTrees, "of_bins", lambda self, bins: scored.append(len(bins)) or of_bins(self, bins))
    for numbers in (T.CELL_NUMBERS, 0):
        monkeypatch.setattr(T, "CELL_NUMBERS", numbers)
        for model in fitted:
            want, by_cell = model.probabilities(x), model.by_cell()
            scored.clear()
            assert np.array_equal(by_cell(x), want) and np.array_equal(by_cell(x[::-1]), want[::-1])
            assert sum(scored) <= (51 if numbers else 102)
