"""Monitors: a set of measures, an adjudicator, and the plan that judges predictions."""

from __future__ import annotations

import os
import time
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doubtline.functions import vectors as V
from doubtline.operators import measures as M
from doubtline.operators.cleaning import misclassified, rejected_to_null
from doubtline.operators.metrics import omission_metrics
from doubtline.operators.models import Fitted, Model, load_fitted, make_model
from doubtline.operators.store import read_json, write_json
from doubtline.plans.adjudicator import RATIOS, Adjudicator, train_adjudicator

# measure names usable in a specification
SPEC = {
    "confidence": M.ConfidenceInterval,
    "entropy": M.Entropy,
    "maxprob": M.MaxProb,
    "bayes": M.Bayes,
    "external": M.External,
    "combined": M.Combined,
    "multicombined": M.MultiCombined,
    "neighbour": M.Neighbours,
    "knn_distance": M.KnnDistance,
    "agreement": M.Agreement,
    "proximity": M.Proximity,
    "recloss": M.ReconstructionLoss,
    "feature_bagging": M.FeatureBagging,
    "confidence_bagging": M.ConfidenceBaggingMeasure,
    "confidence_boosting": M.ConfidenceBoostingMeasure,
}


def _model(value) -> Model:
    if isinstance(value, Model):
        return value
    if isinstance(value, dict):
        options = dict(value)
        return make_model(options.pop("name"), **options)
    return make_model(value)


class Monitor:
    """Collects measures, fits them on scored training rows, and judges scored rows."""

    def __init__(self, measures: Sequence[M.Measure] = ()):
        self.measures: list[M.Measure] = list(measures)
        self.fitted: list[M.FittedMeasure] = []
        self.adjudicator: Adjudicator | None = None
        self.scorer: Fitted | None = None
        self.reference: DataFrame | None = None
        self.classes: int | None = None
        self.names: list[str] | None = None

    @classmethod
    def from_spec(cls, spec: Sequence[dict]) -> Monitor:
        """``[{"measure": "combined", "model": "LDA"}, ...]``; models by name or with options."""
        out = cls()
        for entry in spec:
            options = dict(entry)
            kind = options.pop("measure")
            for key in ("model", "base"):
                if key in options:
                    options[key] = _model(options[key])
            if "models" in options:
                options["models"] = [_model(m) for m in options["models"]]
            out.measures.append(SPEC[kind](**options))
        return out

    def add(self, measure: M.Measure) -> Monitor:
        self.measures.append(measure)
        return self

    def add_confidence(self, supervised=True, level=0.9999, scale="sem"):
        return self.add(M.ConfidenceInterval(level, supervised, scale))

    def add_entropy(self, classes=None):
        return self.add(M.Entropy(classes))

    def add_maxprob(self):
        return self.add(M.MaxProb())

    def add_bayes(self, classes=None):
        return self.add(M.Bayes(classes))

    def add_external(self, model, classes=None, measure="entropy"):
        return self.add(M.External(_model(model), classes, measure))

    def add_combined(self, model, classes=None):
        return self.add(M.Combined(_model(model), classes))

    def add_multicombined(self, models, classes=None):
        return self.add(M.MultiCombined([_model(m) for m in models], classes))

    def add_neighbour(self, k=19):
        return self.add(M.Neighbours(k))

    def add_knn_distance(self, k=19):
        return self.add(M.KnnDistance(k))

    def add_agreement(self, models):
        return self.add(M.Agreement([_model(m) for m in models]))

    def add_proximity(self, points=10, width=0.1, weighted=False, **options):
        return self.add(M.Proximity(points, width, weighted, **options))

    def add_recloss(self, kind="simple", **options):
        return self.add(M.ReconstructionLoss(kind, **options))

    def add_feature_bagging(self, members=10, kind="sup"):
        return self.add(M.FeatureBagging(members, kind))

    def add_confidence_bagging(self, base, classes=None, **options):
        return self.add(M.ConfidenceBaggingMeasure(_model(base), classes, **options))

    def add_confidence_boosting(self, base, classes=None, **options):
        return self.add(M.ConfidenceBoostingMeasure(_model(base), classes, **options))

    # --- fitting ---------------------------------------------------------------------------

    def fit(
        self,
        train: DataFrame,
        scorer: Fitted | None = None,
        classes: int | None = None,
        names: list[str] | None = None,
        store: M.FitStore | None = None,
    ) -> Monitor:
        """Fit all measures on scored training rows (``row_id, features, prob, pred[, label]``).

        ``store`` shares what doesn't depend on the main model with other monitors on the same rows; all trees of the
        checkers grow together, and other checkers and bounds are fitted side by side.
        """
        self.scorer, self.names = scorer, names
        self.classes = classes or (len(names) if names else V.width_of(train, "prob"))
        ctx = M.FitContext(train, self.classes, scorer, names, store=store)
        if "label" in train.columns:
            ctx.store.together([recipe for m in self.measures for recipe in m.recipes()])
            ctx.store.ahead([job for m in self.measures for job in m.asked(ctx.store)])
        self.fitted = [m.fit(ctx) for m in self.measures]
        if any(f.neighbours for f in self.fitted):
            self.reference = train.select("row_id", "features", "prob", "pred")
        return self

    @property
    def um_columns(self) -> list[str]:
        return M.measure_names(self.fitted)

    def measure(self, scored: DataFrame, exclude_self: bool = False, bounds: str = "batch") -> DataFrame:
        """All measures as columns of the scored rows."""
        return M.apply_measures(
            scored,
            self.fitted,
            scorer=self.scorer,
            reference=self.reference,
            exclude_self=exclude_self,
            bounds=bounds,
        )

    def measure_one(self, spark: SparkSession, features: Sequence[float]) -> DataFrame:
        """Score and measure a single data point."""
        if self.scorer is None:
            raise ValueError("a single point has to be scored first; fit with a scorer")
        width = len(features)
        row = spark.createDataFrame([(0, [float(x) for x in features])], "row_id bigint, features array<double>")
        return self.measure(self.scorer.transform(V.with_width(row, "features", width)), bounds="train")

    def train(
        self,
        train: DataFrame,
        val: DataFrame,
        scorer: Fitted | None = None,
        names: list[str] | None = None,
        candidates: Sequence[Model] | None = None,
        ratios: Sequence[float | None] = RATIOS,
        exclude_self: bool = False,
    ) -> Monitor:
        """Fit the measures on ``train`` and choose the adjudicator on ``val``."""
        if not self.fitted:
            self.fit(train, scorer, names=names)
        wrong = misclassified().alias("is_misclassification")
        own = self.measure(train, exclude_self=exclude_self).select("*", wrong)
        other = self.measure(val).select("*", wrong)
        self.adjudicator = train_adjudicator(own, other, self.um_columns, candidates=candidates, ratios=ratios)
        return self

    # --- judging ---------------------------------------------------------------------------

    def judge(self, scored: DataFrame, bounds: str = "batch") -> DataFrame:
        """Measures, verdict, and the prediction with rejected ones set to null."""
        if self.adjudicator is None:
            raise ValueError("the monitor has no adjudicator; train or load one")
        measured = self.measure(scored, bounds=bounds)
        return self.adjudicator.transform(measured).withColumn("wrapped_pred", rejected_to_null())

    def report_table(self, scored: DataFrame) -> DataFrame:
        """The judged table as it is exported: names, error flag, probabilities as text."""
        judged = self.judge(scored)
        names = self.names or [str(i) for i in range(self.classes or 2)]
        table = F.array(*[F.lit(str(n)) for n in names])
        out = judged
        if "label" in judged.columns:
            out = out.withColumn("true_label", F.get(table, "label"))
            out = out.withColumn("is_misclassification", misclassified())
        out = out.withColumn("predicted_label", F.get(table, "pred"))
        out = out.withColumn("probabilities", V.as_text("prob"))
        out = out.withColumn("wrapped_label", F.get(table, "wrapped_pred"))
        return out.drop("prob")

    def misclassifications(self, scored: DataFrame) -> DataFrame:
        """``row_id, misc_pred`` only."""
        return self.judge(scored).select("row_id", "misc_pred")

    # --- persistence -----------------------------------------------------------------------

    def save(self, spark: SparkSession, folder: str, tag: str) -> str:
        path = os.path.join(folder, tag)
        M.save_measures(spark, self.fitted, os.path.join(path, "um"))
        if self.adjudicator:
            self.adjudicator.save(spark, os.path.join(path, "adjudicator"))
        if self.scorer:
            self.scorer.save(spark, os.path.join(path, "scorer"))
        if self.reference is not None:
            self.reference.write.mode("overwrite").parquet(os.path.join(path, "reference"))
        head = {
            "classes": self.classes,
            "names": self.names,
            "adjudicator": self.adjudicator is not None,
            "scorer": self.scorer is not None,
            "widths": {c: V.known_width(self.reference, c) for c in ("features", "prob")}
            if self.reference is not None
            else None,
        }
        write_json(spark, os.path.join(path, "monitor"), head)
        return path

    @classmethod
    def load(cls, spark: SparkSession, folder: str, tag: str) -> Monitor:
        path = os.path.join(folder, tag)
        head = read_json(spark, os.path.join(path, "monitor"))
        out = cls()
        out.classes, out.names = head["classes"], head["names"]
        out.fitted = M.load_measures(spark, os.path.join(path, "um"))
        if head["adjudicator"]:
            out.adjudicator = Adjudicator.load(spark, os.path.join(path, "adjudicator"))
        if head["scorer"]:
            out.scorer = load_fitted(spark, os.path.join(path, "scorer"))
        if head["widths"]:
            out.reference = spark.read.parquet(os.path.join(path, "reference"))
            for column, width in head["widths"].items():
                if width:
                    out.reference = V.with_width(out.reference, column, width)
        return out


def list_monitors(spark: SparkSession, folder: str) -> DataFrame:
    """Stored monitors, found by their head files."""
    heads = spark.read.text(os.path.join(folder, "*", "monitor"), wholetext=True)
    tag = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/monitor/[^/]+$", 1)
    return heads.select(tag.alias("monitor")).distinct().orderBy("monitor")


# --- presets --------------------------------------------------------------------------------


def supervised_preset() -> Monitor:
    """For classifiers trained with labels."""
    monitor = Monitor().add_confidence(supervised=True, level=0.9).add_maxprob().add_entropy()
    monitor.add_external("MNB").add_combined({"name": "XGB", "rounds": 30})
    monitor.add_multicombined(["GNB", "LDA", "LR"])
    monitor.add_multicombined(["GNB", "BNB", "MNB", "CNB"])
    monitor.add_multicombined(["DT", {"name": "RF", "trees": 10}, {"name": "GBC", "rounds": 10}])
    monitor.add_neighbour().add_proximity(10, 0.1).add_proximity(20, 0.05)
    return monitor.add_recloss()


def unsupervised_preset(contamination: float) -> Monitor:
    """For anomaly detectors trained without labels."""
    share = min(contamination, 0.5)

    def detector(name: str, **options) -> Model:
        return make_model(name, share, **options)

    monitor = Monitor().add_confidence(supervised=False, level=0.5).add_maxprob().add_entropy(2)
    monitor.add_neighbour().add_proximity().add_combined(detector("PCA"), 2)
    monitor.add_multicombined([detector("COPOD"), detector("ECOD")], 2)
    monitor.add_multicombined([detector(n) for n in ("CBLOF", "PCA", "MCD", "HBOS")], 2)
    monitor.add_multicombined([detector("IForest", trees=100), detector("INNE")], 2)
    return monitor.add_recloss()


def vector_preset() -> Monitor:
    """For images and other long vectors."""
    return Monitor().add_confidence(supervised=True, level=0.9).add_maxprob().add_entropy().add_recloss()


# --- experiment -----------------------------------------------------------------------------


def experiment(
    monitor: Monitor,
    model: Model | str,
    train: DataFrame,
    val: DataFrame | None,
    test: DataFrame,
    names: list[str] | None = None,
    tag: str = "new",
    candidates: Sequence[Model] | None = None,
    ratios: Sequence[float | None] = RATIOS,
) -> DataFrame:
    """Fit a classifier, train the monitor unless it is ready, judge the test rows, report.

    One row: the omission metrics, the times in milliseconds, the classifier and the monitor tag.
    """
    spark = train.sparkSession
    model = _model(model)
    start = time.time()
    main = model.fit(train)
    fitted_at = time.time()
    scored_test = main.transform(test).persist(StorageLevel.MEMORY_AND_DISK)
    scored_train = main.transform(train).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        scored_test.count()
        scored_at = time.time()
        if monitor.adjudicator is None:
            if val is None:
                raise ValueError("a monitor without adjudicator needs validation rows")
            monitor.train(scored_train, main.transform(val), main, names, candidates, ratios)
        else:
            monitor.scorer = main
            if any(f.neighbours for f in monitor.fitted):
                monitor.reference = scored_train.select("row_id", "features", "prob", "pred")
        judged_from = time.time()
        row = omission_metrics(monitor.judge(scored_test)).first()
        done = time.time()
    finally:
        scored_test.unpersist()
        scored_train.unpersist()
    times = [
        ("train_ms", fitted_at - start),
        ("test_ms", scored_at - fitted_at),
        ("monitor_ms", done - judged_from),
    ]
    report = spark.createDataFrame([row])
    for name, value in times:
        report = report.withColumn(name, F.lit(int(value * 1000)))
    return report.withColumn("clf", F.lit(main.name)).withColumn("monitor", F.lit(tag))
