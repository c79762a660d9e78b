"""The second model: it reads the measures and says whether a prediction is wrong."""

from __future__ import annotations

import os
import time
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doubtline.functions import vectors as V
from doubtline.operators.cleaning import judge_inputs
from doubtline.operators.metrics import best_candidate, detection_scores
from doubtline.operators.models import (
    Fitted,
    GaussianBayes,
    LinearDiscriminant,
    Model,
    load_fitted,
    make_model,
    run_parallel,
)
from doubtline.operators.sampling import class_counts, downsample, downsample_share
from doubtline.operators.store import read_json, write_json
from doubtline.operators.trees import FittedTrees, TreeModel, count_verdicts, fit_together

# fixed values: error ratios tried when thinning out the right predictions
RATIOS = (None, 0.05, 0.1, 0.2, 0.3)

REPORT_SCHEMA = (
    "candidate int, model string, ratio double, tp bigint, tn bigint, fp bigint, fn bigint, "
    "accuracy double, precision double, recall double, mcc double, auc_hard double, error string, seconds double"
)


def search_candidates() -> list[Model]:
    """The full list, as used for a single dataset."""
    return [
        make_model("XGB", rounds=30),
        make_model("XGB", rounds=100),
        make_model("GBC", rounds=30),
        make_model("GBC", rounds=100),
        make_model("DT"),
        LinearDiscriminant(),
        make_model("RF", trees=30),
        make_model("RF", trees=100),
        GaussianBayes(),
        make_model("LR"),
    ]


def pooled_candidates() -> list[Model]:
    """The shorter list, as used for pooled measure tables."""
    return [
        make_model("GBC", rounds=10),
        make_model("GBC", rounds=20),
        make_model("DT"),
        LinearDiscriminant(),
        make_model("RF", trees=10),
        make_model("RF", trees=20),
        GaussianBayes(),
        make_model("LR"),
    ]


class Adjudicator:
    def __init__(self, fitted: Fitted, um_columns: list[str], report: list[dict], chosen: dict, train_rows: int):
        self.fitted, self.um_columns, self.report = fitted, um_columns, report
        self.chosen, self.train_rows = chosen, train_rows

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``misc_prob`` and ``misc_pred``; the row's own vectors stay as they are."""
        has = "features" in df.columns
        width = V.known_width(df, "features") if has else None
        if has:
            df = df.withColumnRenamed("features", "__features")
        df = judge_inputs(df, self.um_columns, "features")
        df = self.fitted.transform(df, "__misc", "misc_pred").drop("features")
        df = df.withColumn("misc_prob", V.item("__misc", 1)).drop("__misc")
        if has:
            df = df.withColumnRenamed("__features", "features")
            if width:
                df = V.with_width(df, "features", width)
        return df

    def candidates(self, spark: SparkSession) -> DataFrame:
        names = [c.split()[0] for c in REPORT_SCHEMA.split(", ")]
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in self.report], REPORT_SCHEMA)

    def importances(self, spark: SparkSession) -> DataFrame:
        weights = self.fitted.importances()
        rows = list(zip(self.um_columns, map(float, weights))) if weights is not None else []
        return spark.createDataFrame(rows, "um string, weight double").orderBy(F.col("weight").desc(), "um")

    def summary(self, spark: SparkSession) -> DataFrame:
        """One row about the chosen candidate."""
        c = self.chosen
        return spark.createDataFrame(
            [
                (
                    c["model"], self.train_rows, len(self.um_columns), c["ratio"], c["mcc"], c["accuracy"],
                    c["auc_hard"], c["precision"], c["recall"], c["tp"], c["tn"], c["fp"], c["fn"],
                )
            ],
            "model string, train_rows bigint, measures int, ratio double, mcc double, accuracy double, "
            "auc_hard double, precision double, recall double, tp bigint, tn bigint, fp bigint, fn bigint",
        )

    def save(self, spark: SparkSession, path: str) -> None:
        self.fitted.save(spark, os.path.join(path, "model"))
        state = {
            "um_columns": self.um_columns, "report": self.report, "chosen": self.chosen, "train_rows": self.train_rows,
        }
        write_json(spark, os.path.join(path, "state"), state)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Adjudicator:
        state = read_json(spark, os.path.join(path, "state"))
        return cls(load_fitted(spark, os.path.join(path, "model")), **state)


def _inputs(df: DataFrame, um_columns: list[str], wrong: str, key: str) -> DataFrame:
    frame = judge_inputs(df.select(key, wrong, *um_columns), um_columns, "features")
    return frame.select(F.col(key).alias("row_id"), "features", F.col(wrong).cast("int").alias("label"))


def _confusions(rows: DataFrame, models: Sequence[Fitted]) -> list[tuple[int, int, int, int]]:
    """True and false positives and negatives of all models, in one pass over the rows; trees are of one ``fit_together``."""
    if models and all(isinstance(m, FittedTrees) for m in models):
        return [(int(n[1, 1]), int(n[0, 0]), int(n[0, 1]), int(n[1, 0])) for n in count_verdicts(rows, models)]
    for i, model in enumerate(models):
        rows = model.transform(rows, "__misc", f"__{i}").drop("__misc")
    cells = [(1, 1), (0, 0), (0, 1), (1, 0)]
    sums = [
        F.coalesce(F.sum(((F.col("label") == actual) & (F.col(f"__{i}") == said)).cast("long")), F.lit(0)).alias(f"n{i}_{c}")
        for i in range(len(models))
        for c, (actual, said) in enumerate(cells)
    ]
    row = rows.agg(*sums).first()
    return [tuple(row[f"n{i}_{c}"] for c in range(4)) for i in range(len(models))]


def train_adjudicator(
    train: DataFrame,
    val: DataFrame,
    um_columns: Sequence[str],
    wrong: str = "is_misclassification",
    key: str = "row_id",
    candidates: Sequence[Model] | None = None,
    ratios: Sequence[float | None] = RATIOS,
    seed: int = 0,
    parallel: int = 4,
) -> Adjudicator:
    """Fit every candidate at every ratio, keep the one with the highest MCC on ``val``.

    All trees of the grid grow together from one binned table, and a model of fewer rounds or trees is the beginning of one
    of more. The other candidates are fitted a few at a time. All tree cells are counted on ``val`` in one pass, which scores
    rows of equal bins once, and those of another candidate in one pass each. A cell that fails is reported with its error
    instead of being dropped in silence; ``seconds`` is the time of a cell's fit, or its part of that of all trees.
    """
    um_columns = list(um_columns)
    candidates = search_candidates() if candidates is None else list(candidates)
    ratios = list(ratios or (None,))
    spark = train.sparkSession
    train_rows = _inputs(train, um_columns, wrong, key).persist(StorageLevel.MEMORY_AND_DISK)
    val_rows = _inputs(val, um_columns, wrong, key).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        counts = class_counts(train_rows, "label")
        grid = [(m, r) for m in candidates for r in ratios]
        # ratios that keep the same share of rows have the same sample, so their cells share a fit
        shares = [downsample_share(*counts, r) for _, r in grid]
        first: dict[tuple, int] = {}
        same = [first.setdefault((no // len(ratios), share), no) for no, share in enumerate(shares)]
        own = sorted(set(same))
        trees = [i for i in own if isinstance(grid[i][0], TreeModel)]

        def grown() -> dict[int, tuple]:
            start = time.time()
            try:
                found = fit_together(train_rows, [grid[i][0] for i in trees], [shares[i] for i in trees], seed=seed)
                return {i: (f, None, (time.time() - start) / len(trees)) for i, f in zip(trees, found)}
            except Exception as error:
                return dict.fromkeys(trees, (None, f"{type(error).__name__}: {error}"[:300], None))

        def fitted(i: int):
            def job() -> dict[int, tuple]:
                start = time.time()
                try:
                    sample = downsample(train_rows, grid[i][1], "row_id", seed=seed, counts=counts)
                    return {i: (grid[i][0].fit(sample), None, time.time() - start)}
                except Exception as error:
                    return {i: (None, f"{type(error).__name__}: {error}"[:300], None)}

            return job

        jobs = ([grown] if trees else []) + [fitted(i) for i in own if i not in trees]
        cells = {i: cell for part in run_parallel(jobs, parallel) for i, cell in part.items()}

        def counted(mine: list[int]):
            def job() -> dict[int, tuple]:
                try:
                    return dict(zip(mine, _confusions(val_rows, [cells[i][0] for i in mine])))
                except Exception as error:
                    return {i: f"{type(error).__name__}: {error}"[:300] for i in mine}

            return job

        fine = [i for i in own if cells[i][1] is None]
        groups = [[i for i in fine if i in trees]] + [[i for i in fine if i // len(ratios) == no and i not in trees] for no in range(len(candidates))]
        found = {i: c for part in run_parallel([counted(mine) for mine in groups if mine], parallel) for i, c in part.items()}
    finally:
        train_rows.unpersist()
        val_rows.unpersist()
    results = []
    for i, (model, ratio) in enumerate(grid):
        fit, error, seconds = cells[same[i]]
        scores = found.get(same[i])
        error = error or (scores if isinstance(scores, str) else None)
        entry = {"candidate": i, "model": model.name, "ratio": ratio, "error": error, "seconds": seconds}
        if error is None:
            entry.update(zip(("tp", "tn", "fp", "fn"), scores))
        results.append((entry, fit))
    counts_of = [(i, *(e[c] for c in ("tp", "tn", "fp", "fn"))) for i, (e, _) in enumerate(results) if e["error"] is None]
    sums = spark.createDataFrame(counts_of, "candidate int, tp long, tn long, fp long, fn long")
    for row in detection_scores(sums).collect():
        results[row.candidate][0].update(row.asDict())
    report = [entry for entry, _ in results]
    good = [e for e in report if e["error"] is None]
    if not good:
        raise ValueError(f"no candidate could be trained: {report[0]['error']}")
    rows = spark.createDataFrame([(e["candidate"], float(e["mcc"])) for e in good], "candidate int, mcc double")
    best = best_candidate(rows).first().candidate
    chosen = next(e for e in report if e["candidate"] == best)
    return Adjudicator(results[best][1], um_columns, report, chosen, sum(counts))
