"""Classifiers used as black box, checker or adjudicator, under their usual short names.

``model.fit(train)`` reads ``features array<double>`` and ``label`` codes 0..k-1 and returns a
fitted model; ``fitted.transform(df)`` adds ``prob array<double>`` and ``pred int`` without a
shuffle (neighbour votes excepted).
"""

from __future__ import annotations

import os
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml import classification as C
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doubtline.functions import vectors as V
from doubtline.functions.hashing import md5_uniform
from doubtline.functions.prob import argmax, softmax
from doubtline.operators.bounded import STATE_VALUES
from doubtline.operators.knn import knn_join
from doubtline.operators.stats import Moments, covariance, moments, task_partials
from doubtline.operators.store import read_json, write_json

UNROLL_TERMS = 256
FITTED: dict[str, type] = {}
PARALLEL_FITS = 4


def register(cls):
    FITTED[cls.__name__] = cls
    return cls


def run_parallel(jobs: list[Callable], width: int = PARALLEL_FITS) -> list:
    """Run independent Spark jobs from a few driver threads."""
    if len(jobs) <= 1 or width <= 1:
        return [job() for job in jobs]
    wrap = inheritable_thread_target(SparkSession.getActiveSession() or SparkSession.builder.getOrCreate())
    with ThreadPoolExecutor(width) as pool:
        return [f.result() for f in [pool.submit(wrap(job)) for job in jobs]]


def class_count(train: DataFrame, label: str = "label") -> int:
    top = train.agg(F.max(label).alias("m")).first().m
    if top is None:
        raise ValueError("no labelled rows to fit on")
    return int(top) + 1


class Model:
    """A recipe. ``name`` identifies it in reports; recipes with an equal ``key`` share one fit."""

    name = "model"
    is_detector = False

    def key(self) -> str:
        """The class and all parameters, those of inner models included."""

        def text(value) -> str:
            if isinstance(value, Model):
                return value.key()
            if isinstance(value, (list, tuple)):
                return "[" + ", ".join(map(text, value)) + "]"
            if callable(value):
                cells = [c.cell_contents for c in getattr(value, "__closure__", None) or ()]
                return f"{getattr(value, '__qualname__', value)}{text(cells)}"
            return repr(value)

        return f"{type(self).__name__}({', '.join(f'{k}={text(v)}' for k, v in sorted(vars(self).items()))})"

    def fit(self, train: DataFrame) -> Fitted:
        raise NotImplementedError


class Fitted:
    name = "model"
    is_detector = False
    #: ``transform`` keeps rows in their tasks and in order.
    row_local = True

    def transform(self, df: DataFrame, prob: str = "prob", pred: str = "pred") -> DataFrame:
        raise NotImplementedError

    def importances(self) -> list[float] | None:
        return None

    # persistence: a JSON state, plus Spark ML models and tables by name
    def state(self) -> dict:
        raise NotImplementedError

    def ml_parts(self) -> dict[str, object]:
        return {}

    def frames(self) -> dict[str, DataFrame]:
        return {}

    @classmethod
    def restore(cls, state: dict, ml: dict, frames: dict) -> Fitted:
        raise NotImplementedError

    def save(self, spark: SparkSession, path: str) -> None:
        parts, frames = self.ml_parts(), self.frames()
        widths = {n: {f.name: f.metadata for f in d.schema if f.metadata} for n, d in frames.items()}
        head = {
            "kind": type(self).__name__,
            "state": self.state(),
            "ml": sorted(parts),
            "frames": sorted(frames),
            "widths": widths,
        }
        write_json(spark, os.path.join(path, "head"), head)
        for key, part in parts.items():
            PipelineModel([part]).write().overwrite().save(os.path.join(path, f"ml-{key}"))
        for key, frame in frames.items():
            frame.write.mode("overwrite").parquet(os.path.join(path, f"frame-{key}"))


def load_fitted(spark: SparkSession, path: str) -> Fitted:
    head = read_json(spark, os.path.join(path, "head"))
    ml = {k: PipelineModel.load(os.path.join(path, f"ml-{k}")).stages[0] for k in head["ml"]}
    frames = {}
    for k in head["frames"]:
        frame = spark.read.parquet(os.path.join(path, f"frame-{k}"))
        for column, meta in head["widths"].get(k, {}).items():
            frame = frame.withColumn(column, F.col(column).alias(column, metadata=meta))
        frames[k] = frame
    return FITTED[head["kind"]].restore(head["state"], ml, frames)


def add_pred(df: DataFrame, prob: str, pred: str) -> DataFrame:
    return df.withColumn(pred, argmax(prob))


# --- models fitted by plain aggregates ------------------------------------------------------


class GaussianBayes(Model):
    """Gaussian naive Bayes: one grouped aggregate to fit, one projection to score."""

    def __init__(self, scaled: bool = False, smoothing: float = 1e-9):
        self.scaled, self.smoothing = scaled, smoothing
        self.name = "GNB" if scaled else "GaussianNB"

    def fit(self, train: DataFrame) -> FittedGaussianBayes:
        m = moments(train.filter(F.col("label").isNotNull()), by="label")
        return FittedGaussianBayes.from_moments(m, self.scaled, self.smoothing, self.name)


@register
class FittedGaussianBayes(Fitted):
    def __init__(self, name, labels, prior, mean, var, shift, scale):
        self.name, self.labels = name, [int(x) for x in labels]
        self.prior, self.mean, self.var = np.array(prior), np.array(mean), np.array(var)
        self.shift, self.scale = np.array(shift), np.array(scale)

    @classmethod
    def from_moments(cls, m: Moments, scaled: bool, smoothing: float, name: str):
        whole = m.overall()
        low, high = whole.low[0], whole.high[0]
        if scaled:
            scale = np.where(high > low, high - low, 1.0)
            shift = np.where(high > low, low, 0.0)
        else:
            scale, shift = np.ones(m.width), np.zeros(m.width)
        mean = (m.mean - shift) / scale
        floor = smoothing * (whole.var[0] / scale**2).max()
        var = m.var / scale**2 + floor
        return cls(name, m.labels, m.n / m.n.sum(), mean, var, shift, scale)

    @property
    def classes(self) -> int:
        return max(self.labels) + 1

    def transform(self, df, prob="prob", pred="pred"):
        k, d = self.mean.shape
        with np.errstate(divide="ignore"):
            const = np.log(self.prior) - 0.5 * np.log(2.0 * np.pi * self.var).sum(axis=1)
        dense = self.labels == list(range(k))
        if dense and k * d <= UNROLL_TERMS:
            lit = V.double_literal
            scores = []
            for c in range(k):
                terms = [f"({lit(const[c])})"]
                for j in range(d):
                    x = V.at("features", j)
                    if self.scale[j] != 1.0 or self.shift[j] != 0.0:
                        x = f"({x} - ({lit(self.shift[j])})) / {lit(self.scale[j])}"
                    gap = f"({x} - ({lit(self.mean[c, j])}))"
                    terms.append(f"{gap} * {gap} / {lit(-2.0 * self.var[c, j])}")
                scores.append(V.sum_text(terms))
            return add_pred(softmax(df, scores, prob), prob, pred)
        labels, size = self.labels, self.classes
        mean, var, shift, scale = self.mean, self.var, self.shift, self.scale

        def score(x: np.ndarray) -> np.ndarray:
            y = (x - shift) / scale
            s = np.empty((len(y), k))
            for c in range(k):
                s[:, c] = const[c] - ((y - mean[c]) ** 2 / (2.0 * var[c])).sum(axis=1)
            e = np.exp(s - s.max(axis=1, keepdims=True))
            out = np.zeros((len(y), size))
            out[:, labels] = e / e.sum(axis=1, keepdims=True)
            return out

        fn = V.matrix_to_matrix(score)
        df = df.withColumn(prob, V.vector(fn(F.col("features").cast("array<double>")), size, prob))
        return add_pred(df, prob, pred)

    def state(self):
        return {
            "name": self.name, "labels": self.labels, "prior": self.prior, "mean": self.mean,
            "var": self.var, "shift": self.shift, "scale": self.scale,
        }

    @classmethod
    def restore(cls, state, ml, frames):
        return cls(**state)


class LinearDiscriminant(Model):
    """Gaussian classes with one pooled covariance."""

    name = "LDA"

    def fit(self, train: DataFrame) -> FittedLinear:
        train = train.filter(F.col("label").isNotNull())
        m = moments(train, by="label")
        n, mean, total_cov = covariance(train, ddof=0, center=m.overall().mean[0])
        between = sum(
            (m.n[c] / n) * np.outer(m.mean[c] - mean, m.mean[c] - mean) for c in range(len(m.labels))
        )
        within = (total_cov - between) * n / max(n - len(m.labels), 1.0)
        inverse = np.linalg.pinv(within)
        weights = m.mean @ inverse
        bias = np.log(m.n / m.n.sum()) - 0.5 * np.einsum("cd,cd->c", weights, m.mean)
        return FittedLinear(self.name, m.labels, weights, bias)


@register
class FittedLinear(Fitted):
    """Softmax over linear scores."""

    def __init__(self, name, labels, weights, bias):
        self.name, self.labels = name, [int(x) for x in labels]
        self.weights, self.bias = np.array(weights), np.array(bias)

    def transform(self, df, prob="prob", pred="pred"):
        k, d = self.weights.shape
        size = max(self.labels) + 1
        if self.labels == list(range(k)) and k * d <= UNROLL_TERMS:
            scores = [
                V.sum_text(
                    [f"({V.double_literal(self.bias[c])})"]
                    + [f"{V.at('features', j)} * ({V.double_literal(self.weights[c, j])})" for j in range(d)]
                )
                for c in range(k)
            ]
            return add_pred(softmax(df, scores, prob), prob, pred)
        weights, bias, labels = self.weights, self.bias, self.labels

        def score(x):
            s = x @ weights.T + bias
            e = np.exp(s - s.max(axis=1, keepdims=True))
            out = np.zeros((len(x), size))
            out[:, labels] = e / e.sum(axis=1, keepdims=True)
            return out

        fn = V.matrix_to_matrix(score)
        df = df.withColumn(prob, V.vector(fn(F.col("features").cast("array<double>")), size, prob))
        return add_pred(df, prob, pred)

    def importances(self):
        return coefficient_shares(self.weights)

    def state(self):
        return {"name": self.name, "labels": self.labels, "weights": self.weights, "bias": self.bias}

    @classmethod
    def restore(cls, state, ml, frames):
        return cls(**state)


def coefficient_shares(weights: np.ndarray) -> list[float]:
    """Absolute coefficients of the first class (or of class 1 against 0), as shares."""
    weights = np.atleast_2d(weights)
    first = weights[1] - weights[0] if len(weights) == 2 else weights[0]
    size = np.abs(first)
    return list(size / size.sum()) if size.sum() > 0 else list(size)


class NeighbourVote(Model):
    """Class shares among the k nearest labelled rows."""

    def __init__(self, k: int = 11):
        self.k, self.name = k, f"KNN{k}"

    def fit(self, train: DataFrame) -> FittedNeighbourVote:
        train = train.filter(F.col("label").isNotNull())
        ref = train.select("row_id", "features", F.col("label").cast("int").alias("label"))
        return FittedNeighbourVote(self.name, self.k, class_count(train), ref)


@register
class FittedNeighbourVote(Fitted):
    row_local = False

    def __init__(self, name, k, classes, ref):
        self.name, self.k, self.classes, self.ref = name, k, classes, ref
        self._held: dict = {}  # the reference is collected once, however many tables are scored

    def transform(self, df, prob="prob", pred="pred"):
        keep = df.columns
        joined = knn_join(df, self.ref, self.k, carry=["label"], held=self._held)
        votes = F.transform("nn", lambda e: e["label"])
        share = [
            F.size(F.filter(votes, lambda v: v == c)).cast("double") / F.size("nn")
            for c in range(self.classes)
        ]
        joined = joined.withColumn(prob, V.vector(F.array(*share), self.classes, prob))
        out = [c for c in keep if c not in (prob, pred)]
        return add_pred(joined, prob, pred).select(*out, prob, pred)

    def state(self):
        return {"name": self.name, "k": self.k, "classes": self.classes}

    def frames(self):
        return {"ref": self.ref}

    @classmethod
    def restore(cls, state, ml, frames):
        return cls(**state, ref=frames["ref"])


# --- Spark ML -------------------------------------------------------------------------------


class MLModel(Model):
    """Any Spark ML probabilistic classifier.

    ``scale`` applies min-max with train bounds first, ``binarize`` maps to 0/1 after that;
    ``per_class`` fits one binary model per class and normalises, for binary-only learners.
    """

    def __init__(self, name: str, build: Callable[[], object], scale=False, binarize=False, per_class=False):
        self.name, self.build = name, build
        self.scale, self.binarize, self.per_class = scale, binarize, per_class

    def fit(self, train: DataFrame) -> FittedML:
        train = train.filter(F.col("label").isNotNull())
        prep = {"binarize": self.binarize, "low": None, "high": None}
        if self.scale:
            m = moments(train)
            prep["low"], prep["high"] = m.low[0].tolist(), m.high[0].tolist()
        frame = train.select(
            array_to_vector(prepared(prep)).alias("features"), F.col("label").cast("double").alias("label")
        ).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            row = frame.agg(F.max("label").alias("top")).first()
            if row.top is None:
                raise ValueError("no labelled rows to fit on")
            k = int(row.top) + 1
            data = frame
            if k <= 2 or not self.per_class:
                return FittedML(self.name, max(k, 2), prep, {"all": self.build().fit(data)})

            def one(c: int):
                target = F.when(F.col("label") == c, 1.0).otherwise(0.0)
                return lambda: self.build().fit(data.withColumn("label", target))

            models = run_parallel([one(c) for c in range(k)])
        finally:
            frame.unpersist()
        return FittedML(self.name, k, prep, {f"c{c}": m for c, m in enumerate(models)})


def prepared(prep: dict, features: str = "features") -> Column:
    if prep["low"] is not None:
        column = V.min_max(features, prep["low"], prep["high"])
        if prep["binarize"]:
            column = F.transform(column, lambda x: F.when(x > 0, 1.0).otherwise(0.0))
        else:
            column = F.transform(column, lambda x: F.greatest(x, F.lit(0.0)))
        return column
    return F.col(features).cast("array<double>")


def ml_probability(model, df: DataFrame, vec: str, out: str) -> DataFrame:
    """Add the probability vector only; the other outputs are switched off."""
    settings = {
        model.featuresCol: vec,
        model.predictionCol: "",
        model.rawPredictionCol: "",
        model.probabilityCol: out,
    }
    return model.copy(settings).transform(df)


@register
class FittedML(Fitted):
    def __init__(self, name, classes, prep, models):
        self.name, self.classes, self.prep, self.models = name, classes, prep, models

    def transform(self, df, prob="prob", pred="pred"):
        vec, raw = f"__{prob}_vec", f"__{prob}_ml"
        df = df.withColumn(vec, array_to_vector(prepared(self.prep)))
        if "all" in self.models:
            df = ml_probability(self.models["all"], df, vec, raw)
            df = df.withColumn(prob, V.vector(vector_to_array(raw), self.classes, prob))
            return add_pred(df, prob, pred).drop(vec, raw)
        parts = []
        for key, model in sorted(self.models.items(), key=lambda kv: int(kv[0][1:])):
            parts.append(f"{raw}_{key}")
            df = ml_probability(model, df, vec, parts[-1])
        df = df.withColumn(raw, F.array(*[F.get(vector_to_array(p), F.lit(1)) for p in parts]))
        mass, flat = V.sum_text([V.at(raw, c) for c in range(self.classes)]), 1.0 / self.classes
        cells = [f"CASE WHEN {mass} > 0 THEN {V.at(raw, c)} / {mass} ELSE {flat}D END" for c in range(self.classes)]
        df = df.withColumn(prob, V.vector(F.expr(f"array({', '.join(cells)})"), self.classes, prob))
        return add_pred(df, prob, pred).drop(vec, raw, *parts)

    def importances(self):
        total = None
        for model in self.models.values():
            if hasattr(model, "featureImportances"):
                part = model.featureImportances.toArray()
            elif hasattr(model, "coefficientMatrix"):
                return coefficient_shares(model.coefficientMatrix.toArray())
            else:
                return None
            total = part if total is None else total + part
        return list(total / len(self.models))

    def state(self):
        return {"name": self.name, "classes": self.classes, "prep": self.prep}

    def ml_parts(self):
        return self.models

    @classmethod
    def restore(cls, state, ml, frames):
        return cls(**state, models=ml)


class BaggedLinearSVM(Model):
    """Linear support vector machines (squared hinge) on hash samples, margins calibrated.

    All members and classes are solved together by Newton's method: a pass over the table sums
    the gradients and curvatures of every member at once, so the number of passes does not grow
    with the number of members or classes. Where the curvatures of wide vectors pass the limit of
    partial results, Newton's steps are found by conjugate gradients, whose passes sum products of
    the curvatures with a direction: as many numbers as weights. The calibration, a logistic curve
    per class on the mean margin, is fitted by Newton's method, too.
    """

    #: Curvature numbers of all members and classes that a pass may sum, and directions tried for a step beyond that.
    curvature_numbers, directions = STATE_VALUES, 60

    name = "SVM"

    def __init__(self, members: int = 10, sample: float = 0.1, seed: int = 0, passes: int = 12, ridge: float = 1e-3):
        self.members, self.sample, self.seed = members, sample, seed
        self.passes, self.ridge = passes, ridge

    def fit(self, train: DataFrame) -> FittedMargins:
        train = train.filter(F.col("label").isNotNull())
        k, m = class_count(train), moments(train)
        low, high, d = m.low[0].tolist(), m.high[0].tolist(), m.width
        drawn = [
            (md5_uniform(self.seed, b, F.col("row_id")) < self.sample).cast("double") for b in range(self.members)
        ]
        cells = F.concat(
            V.min_max("features", low, high, "x"), F.array(F.lit(1.0), F.col("label").cast("double"), *drawn)
        )
        packed = train.select(cells.alias("features")).persist(StorageLevel.MEMORY_AND_DISK)
        targets = [1] if k <= 2 else list(range(k))
        try:
            direct = self.members * len(targets) * ((d + 1) * (d + 2) + 1) <= self.curvature_numbers
            weights = (self._solve if direct else self._solve_wide)(packed, d + 1, targets)
            scale = self._calibrate(packed, weights, d + 1, targets)
        finally:
            packed.unpersist()
        return FittedMargins(self.name, max(k, 2), low, high, weights, scale)

    def _solve(self, packed: DataFrame, width: int, targets: list[int]) -> np.ndarray:
        """Mean weights of the members, one row per target."""
        members, cell = self.members, width + width * width + 1
        weights = np.zeros((members, len(targets), width))
        for _ in range(self.passes):
            current = weights

            def part(block: np.ndarray) -> np.ndarray:
                x, label, drawn = block[:, :width], block[:, width], block[:, width + 1 :] > 0
                out = np.zeros((members, len(targets), cell))
                for b in range(members):
                    xb, lb = x[drawn[:, b]], label[drawn[:, b]]
                    for i, c in enumerate(targets):
                        y = np.where(lb == c, 1.0, -1.0)
                        miss = 1.0 - y * (xb @ current[b, i])
                        hit = miss > 0
                        xa = xb[hit]
                        out[b, i, :width] = -(xa.T @ (y[hit] * miss[hit]))
                        out[b, i, width:-1] = (xa.T @ xa).ravel()
                        out[b, i, -1] = len(xb)
                return out.ravel()

            sums = task_partials(packed, part, members * len(targets) * cell).reshape(members, len(targets), cell)
            n = np.maximum(sums[..., -1], 1.0)[..., None]
            slope = sums[..., :width] / n + self.ridge * current
            curve = sums[..., width:-1].reshape(members, len(targets), width, width) / n[..., None]
            curve = curve + self.ridge * np.eye(width)
            step = np.linalg.solve(curve, slope[..., None])[..., 0]
            weights = current - step
            if np.abs(step).max() < 1e-8:
                break
        return weights.mean(axis=0)

    def _solve_wide(self, packed: DataFrame, width: int, targets: list[int]) -> np.ndarray:
        """The same minimum without curvature matrices."""
        members, cells = self.members, self.members * len(targets)

        def sums(current: np.ndarray, along: np.ndarray | None) -> np.ndarray:
            """Mean gradients of all members and targets, or their curvatures' products with a direction for each."""

            def part(block: np.ndarray) -> np.ndarray:
                x, label = block[:, :width], block[:, width]
                drawn = np.repeat(block[:, width + 1 :] > 0, len(targets), axis=1)
                y = np.tile(np.where(label[:, None] == np.array(targets), 1.0, -1.0), (1, members))
                miss = np.where(drawn, np.maximum(1.0 - y * (x @ current.T), 0.0), 0.0)
                pull = -y * miss if along is None else (miss > 0) * (x @ along.T)
                return np.hstack([pull.T @ x, drawn.sum(axis=0)[:, None]]).ravel()

            out = task_partials(packed, part, cells * (width + 1)).reshape(cells, width + 1)
            means = out[:, :width] / np.maximum(out[:, width:], 1.0)
            return means + self.ridge * (current if along is None else along)

        weights, start = np.zeros((cells, width)), None
        for _ in range(self.passes):
            left = sums(weights, None)
            size = np.linalg.norm(left, axis=1)
            start = np.maximum(size, 1e-300) if start is None else start
            if (size <= 1e-8 * start).all():
                break
            # the nearer the minimum, the more exact the step
            goal = (np.minimum(0.1, size / start) * size) ** 2
            step, along, rest = np.zeros_like(weights), left, size**2
            for _ in range(self.directions):
                going = rest > np.maximum(goal, 1e-300)
                if not going.any():
                    break
                curved = sums(weights, along)
                bend = (along * curved).sum(axis=1)
                far = np.where(going & (bend > 0), rest / np.where(bend > 0, bend, 1.0), 0.0)[:, None]
                step, left = step + far * along, left - far * curved
                now = (left * left).sum(axis=1)
                turn = np.where(going, now / np.where(going, rest, 1.0), 0.0)[:, None]
                along = np.where(going[:, None], left + turn * along, 0.0)
                rest = np.where(going, now, rest)
            weights = weights - step
        return weights.reshape(members, len(targets), width).mean(axis=0)

    def _calibrate(self, packed: DataFrame, weights: np.ndarray, width: int, targets: list[int]) -> np.ndarray:
        scale = np.tile([1.0, 0.0], (len(targets), 1))
        for _ in range(self.passes):
            current = scale

            def part(block: np.ndarray) -> np.ndarray:
                x, label = block[:, :width], block[:, width]
                out = np.zeros((len(targets), 6))
                for i, c in enumerate(targets):
                    z = np.column_stack([x @ weights[i], np.ones(len(x))])
                    p = 1.0 / (1.0 + np.exp(-np.clip(z @ current[i], -60, 60)))
                    out[i, :2] = z.T @ (p - (label == c))
                    out[i, 2:] = (z.T @ (z * (p * (1.0 - p))[:, None])).ravel()
                return out.ravel()

            sums = task_partials(packed, part, len(targets) * 6).reshape(len(targets), 6)
            curve = sums[:, 2:].reshape(-1, 2, 2) + 1e-6 * np.eye(2)
            step = np.linalg.solve(curve, sums[:, :2, None])[..., 0]
            scale = current - np.clip(step, -5.0, 5.0)
            if np.abs(step).max() < 1e-8:
                break
        return scale


@register
class FittedMargins(Fitted):
    def __init__(self, name, classes, low, high, weights, scale):
        self.name, self.classes, self.low, self.high = name, classes, list(low), list(high)
        self.weights, self.scale = np.array(weights), np.array(scale)

    def transform(self, df, prob="prob", pred="pred"):
        low, high = np.array(self.low), np.array(self.high)
        span = np.where(high > low, high - low, 1.0)
        shift = np.where(high > low, low, 0.0)
        weights, scale, k = self.weights, self.scale, self.classes

        def score(x):
            margin = ((x - shift) / span) @ weights[:, :-1].T + weights[:, -1]
            p = 1.0 / (1.0 + np.exp(-np.clip(margin * scale[:, 0] + scale[:, 1], -500, 500)))
            if p.shape[1] == 1:
                return np.hstack([1.0 - p, p])
            mass = p.sum(axis=1, keepdims=True)
            return np.where(mass > 0, p / np.where(mass > 0, mass, 1.0), 1.0 / k)

        fn = V.matrix_to_matrix(score)
        df = df.withColumn(prob, V.vector(fn(F.col("features").cast("array<double>")), k, prob))
        return add_pred(df, prob, pred)

    def state(self):
        return {
            "name": self.name, "classes": self.classes, "low": self.low, "high": self.high,
            "weights": self.weights, "scale": self.scale,
        }

    @classmethod
    def restore(cls, state, ml, frames):
        return cls(**state)


# --- black boxes from outside ---------------------------------------------------------------


#: Factories of column functions by name, so that a stored black box can be made again.
BLACK_BOXES: dict[str, Callable[..., Callable[[Column], Column]]] = {}


def black_box_factory(name: str):
    """Registers a function that makes a column function from plain arguments."""

    def add(fn):
        BLACK_BOXES[name] = fn
        return fn

    return add


@register
class BlackBox(Fitted):
    """A fitted classifier given as a column function ``features -> prob``.

    With ``factory``, the name of a registered factory, and its ``arguments`` (JSON types) it can be saved and
    loaded wherever the factory is registered; a bare function can only be used.
    """

    def __init__(self, name: str, fn: Callable[[Column], Column] | None, classes: int, factory: str | None = None, arguments: dict | None = None):
        if fn is None:
            if factory not in BLACK_BOXES:
                raise ValueError(f"no black box factory {factory!r} is registered")
            fn = BLACK_BOXES[factory](**(arguments or {}))
        self.name, self.fn, self.classes, self.factory, self.arguments = name, fn, classes, factory, arguments

    def state(self):
        if self.factory is None:
            raise NotImplementedError("a black box without a factory name can't be saved")
        return {"name": self.name, "classes": self.classes, "factory": self.factory, "arguments": self.arguments}

    @classmethod
    def restore(cls, state, ml, frames):
        return cls(fn=None, **state)

    def transform(self, df, prob="prob", pred="pred"):
        df = df.withColumn(prob, V.vector(self.fn(F.col("features")), self.classes, prob))
        return add_pred(df, prob, pred)


# --- names ----------------------------------------------------------------------------------


def tree_model(short: str, count: int | None = None, depth: int | None = None) -> Model:
    from doubtline.operators.trees import TreeModel

    if short == "XGB":
        return TreeModel(f"XGB{count or 100}", "boost", count or 100, depth or 6, step=0.3, ridge=1.0, least=1.0)
    if short == "GBC":
        return TreeModel(f"GBC{count or 50}", "boost", count or 50, depth or 3, step=0.1, ridge=0.0)
    if short == "LB":
        return TreeModel(f"LB{count or 10}", "boost", count or 10, depth or 3, step=1.0, ridge=0.01)
    if short == "DT":
        return TreeModel("DT", "forest", 1, depth or 30)
    return TreeModel(f"RF{count or 10}", "forest", count or 10, depth or 15, bagged=True, draw=True)


# fixed values: names a model is known by
ALIASES = {
    "XGB": ("XGB", "XGBoost"),
    "DT": ("DT", "DTree", "DecisionTree"),
    "KNN": ("KNN", "knn", "kNN", "KNeighbours"),
    "SVM": ("SVM",),
    "LDA": ("LDA",),
    "GNB": ("GNB", "GaussianNB"),
    "MNB": ("MNB", "MultinomialNB"),
    "BNB": ("BNB", "BernoulliNB"),
    "CNB": ("CNB", "ComplementNB"),
    "LR": ("Regression", "LogisticRegression", "LR"),
    "RF": ("RF", "RandomForest"),
    "LB": ("LB", "LogBoost", "LogitBoost"),
    "GBC": ("GBC", "GradientBoosting"),
    "COPOD": ("COPOD",),
    "ECOD": ("ECOD",),
    "HBOS": ("HBOS",),
    "MCD": ("MCD",),
    "PCA": ("PCA",),
    "CBLOF": ("CBLOF",),
    "uKNN": ("uKNN",),
    "LOF": ("LOF",),
    "INNE": ("INNE",),
    "FastABOD": ("FastABOD", "ABOD", "FABOD"),
    "COF": ("COF",),
    "IForest": ("IFOREST", "IForest"),
    "LODA": ("LODA",),
}


def canonical(name: str) -> str:
    for short, names in ALIASES.items():
        if name in names:
            return short
    raise ValueError(f"unknown model {name!r}")


def make_model(name: str, contamination: float | None = None, **options) -> Model:
    """A model by name. ``contamination`` (share of anomalies) goes to detectors, at most 0.5."""
    short = canonical(name)
    if short in ("XGB", "GBC", "LB", "DT", "RF"):
        return tree_model(short, options.get("rounds") or options.get("trees"), options.get("depth"))
    if short == "KNN":
        return NeighbourVote(options.get("k", 11))
    if short == "SVM":
        return BaggedLinearSVM(**options)
    if short == "LDA":
        return LinearDiscriminant()
    if short == "GNB":
        return GaussianBayes(scaled=options.get("scaled", True))
    if short == "MNB":
        return MLModel("MNB", lambda: C.NaiveBayes(modelType="multinomial"), scale=True)
    if short == "CNB":
        return MLModel("CNB", lambda: C.NaiveBayes(modelType="complement"), scale=True)
    if short == "BNB":
        return MLModel("BNB", lambda: C.NaiveBayes(modelType="bernoulli"), scale=True, binarize=True)
    if short == "LR":
        return MLModel("LR", lambda: C.LogisticRegression(maxIter=100), per_class=True)
    from doubtline.operators.detectors import make_detector

    return make_detector(short, contamination, **options)


def evaluate(model: Model, train: DataFrame, test: DataFrame) -> tuple[Fitted, DataFrame, DataFrame]:
    """Fit, score the test rows, and give a one-row accuracy report."""
    fitted = model.fit(train)
    scored = fitted.transform(test)
    hit = F.avg((F.col("label") == F.col("pred")).cast("double"))
    return fitted, scored, scored.agg(F.lit(fitted.name).alias("model"), hit.alias("accuracy"))
