"""Uncertainty measures: recipes that are fitted once and then add columns to scored rows.

``measure.fit(ctx)`` reads the scored training rows and returns a fitted measure. Fitted measures
are applied together by ``apply_measures``, which shares what several of them need: every checker
model scores once, one neighbour join serves all neighbour measures with the largest k, and one
expansion serves all stability measures.

Direction: for all measures a larger value means more trust, except for ``um_knn_distance_*``,
``um_neighbour_uncertainty_*`` and ``um_reconstruction_*``, where it means less.
"""

from __future__ import annotations

import contextlib
import copy
import hashlib
import os
import threading
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from doubtline.functions import vectors as V
from doubtline.functions.hashing import uniform_text
from doubtline.functions.prob import certainty, confidence, paired_probability, signed_mean, vote_share
from doubtline.operators.cleaning import clean_features
from doubtline.operators.ensembles import ConfidenceBagging, ConfidenceBoosting, FeatureBags
from doubtline.operators.interval import IntervalBounds
from doubtline.operators.knn import knn_join, valid_k
from doubtline.operators.models import Fitted, GaussianBayes, Model, load_fitted, make_model, run_parallel
from doubtline.operators.recon import Reconstructor
from doubtline.operators.stats import Moments, moments
from doubtline.operators.store import read_json, write_json
from doubtline.operators.trees import TreeModel, fit_together
from doubtline.session import hidden, materialize


class FitStore:
    """What was fitted on ``row_id, features, label`` of one training table, by recipe.

    Monitors of several main models on the same rows share a store: checkers, bounds, deviations and autoencoders don't read
    the main model's columns, so each is fitted once. ``fits`` counts how often a recipe was fitted.
    """

    def __init__(self, train: DataFrame):
        self.train = train
        self.held: dict[str, object] = {}
        self.fits: Counter = Counter()
        self._locks: dict[str, threading.Lock] = {}
        self._lock = threading.Lock()

    def get(self, key: str, fit: Callable[[], object]):
        with self._lock:
            own = self._locks.setdefault(key, threading.Lock())
        with own:
            if key not in self.held:
                self.held[key] = fit()
                self.fits[key] += 1
        return self.held[key]

    def model(self, model: Model) -> Fitted:
        return copy.copy(self.get(model.key(), lambda: model.fit(self.train)))

    def ahead(self, jobs: Sequence[Callable[[], object]]) -> None:
        """Run fits a few at a time. One that fails is left to whoever asks for it."""

        def tried(job):
            def run() -> None:
                with contextlib.suppress(Exception):
                    job()

            return run

        run_parallel([tried(job) for job in jobs])

    def together(self, models: Sequence[Model]) -> None:
        """Grow the trees of all tree models among ``models`` at once."""
        found = {m.key(): m for m in models if isinstance(m, TreeModel) and m.key() not in self.held}
        if len(found) < 2:
            return
        with self._lock:
            wanted = [self._locks.setdefault(key, threading.Lock()) for key in sorted(found)]
        for lock in wanted:
            lock.acquire()
        try:
            missing = [m for key, m in found.items() if key not in self.held]
            for model, fitted in zip(missing, fit_together(self.train, missing) if missing else ()):
                self.held[model.key()] = fitted
                self.fits[model.key()] += 1
        finally:
            for lock in wanted:
                lock.release()


@dataclass
class FitContext:
    """What measures are fitted on; checkers with equal parameters are fitted once."""

    train: DataFrame
    classes: int
    scorer: Fitted | None = None
    names: list[str] | None = None
    cache: dict[str, Fitted] = field(default_factory=dict)
    store: FitStore | None = None

    def __post_init__(self):
        self.store = self.store or FitStore(self.train)

    def fit_model(self, model: Model) -> Fitted:
        key = model.key()
        if key not in self.cache:
            fitted = self.store.model(model)
            if any(fitted.name == other.name for other in self.cache.values()):
                # another recipe has this name: columns and reports need one of its own
                fitted.name += "-" + hashlib.md5(key.encode()).hexdigest()[:6]
            self.cache[key] = fitted
        return self.cache[key]

    def moments(self) -> Moments:
        """Statistics of the features over the whole table."""
        return self.store.get("moments", lambda: moments(self.store.train))


@dataclass
class Env:
    """Columns shared by the measures of one pass."""

    prob_width: int | None
    width: int | None
    model_columns: dict[str, tuple[str, str]]
    scorer: Fitted | None
    main_is_detector: bool = False
    pending: dict[str, Column] = field(default_factory=dict)

    def own_certainty(self, norm: int) -> Column:
        """Certainty of the main model; computed once per norm."""
        name = f"__own_{norm}"
        self.pending.setdefault(name, certainty("prob", norm, self.prob_width))
        return F.col(name)

    def checker_certainty(self, fitted: Fitted, norm: int) -> Column:
        prob, _ = self.model_columns[fitted.name]
        name = f"{prob}_{norm}"
        self.pending.setdefault(name, certainty(prob, norm, getattr(fitted, "classes", None)))
        return F.col(name)


def slug(value) -> str:
    return "".join(ch if ch.isalnum() else "_" for ch in str(value)).strip("_").lower()


class Measure:
    """Subclass with ``fit`` to add a measure of your own."""

    def recipes(self) -> list[Model]:
        """The checkers that ``fit`` will ask for."""
        return [m for m in (getattr(self, "model", None), *(getattr(self, "checkers", None) or ())) if isinstance(m, Model)]

    def asked(self, store: FitStore) -> list[Callable[[], object]]:
        """What ``fit`` will take from the store; a monitor runs these fits side by side first."""
        return [partial(store.model, m) for m in self.recipes()]

    def fit(self, ctx: FitContext) -> FittedMeasure:
        raise NotImplementedError


class FittedMeasure:
    """``columns`` returns named expressions over a row that already carries what ``needs_*`` ask for."""

    neighbours: int | None = None  # needs column ``nn`` of at least this length
    copies: tuple | None = None  # needs a stability expansion

    def models(self) -> dict[str, Fitted]:
        return {}

    def prepare(self, df: DataFrame, env: Env) -> DataFrame:
        """Steps that are not one expression, such as a broadcast lookup."""
        return df

    def columns(self, env: Env) -> dict[str, Column]:
        return {}

    def displays(self) -> dict[str, str]:
        """Column to display name, in order."""
        raise NotImplementedError

    def params(self) -> dict:
        """Constructor arguments, JSON types only."""
        return {}


MEASURES: dict[str, type] = {}


def registered(cls):
    MEASURES[cls.__name__] = cls
    return cls


# --- from the probability vector ------------------------------------------------------------


class MaxProb(Measure):
    def fit(self, ctx):
        return FittedMaxProb()


@registered
class FittedMaxProb(FittedMeasure):
    def columns(self, env):
        return {"um_max_prob": confidence("prob")}

    def displays(self):
        return {"um_max_prob": "MaxProb Calculator"}


class Entropy(Measure):
    """``norm`` is the number of classes a flat vector is compared with; below the true number
    the value can fall below 0."""

    def __init__(self, norm: int | None = None):
        self.norm = norm

    def fit(self, ctx):
        return FittedEntropy(self.norm or ctx.classes)


@registered
class FittedEntropy(FittedMeasure):
    def __init__(self, norm: int):
        self.norm = norm

    def columns(self, env):
        return {"um_entropy": env.own_certainty(self.norm)}

    def displays(self):
        return {"um_entropy": "Entropy Calculator"}

    def params(self):
        return {"norm": self.norm}


# --- intervals ------------------------------------------------------------------------------


class ConfidenceInterval(Measure):
    def __init__(self, level: float = 0.9999, supervised: bool = True, scale: str = "sem"):
        try:
            self.level = float(level)
        except (TypeError, ValueError):
            self.level = 0.9999
        self.supervised, self.scale = supervised, scale

    def bounds(self, store: FitStore) -> IntervalBounds:
        options = (self.level, "label" if self.supervised else None, self.scale)
        return store.get(f"interval {options}", lambda: IntervalBounds.fit(store.train, *options))

    def asked(self, store):
        return [partial(self.bounds, store)]

    def fit(self, ctx):
        return FittedConfidenceInterval(self.level, self.supervised, self.scale, self.bounds(ctx.store).state())


@registered
class FittedConfidenceInterval(FittedMeasure):
    def __init__(self, level, supervised, scale, bounds):
        self.level, self.supervised, self.scale = level, supervised, scale
        self.bounds = IntervalBounds(**bounds)
        self.kind = "sup" if supervised else "uns"
        self.um = f"um_interval_{self.kind}_{slug(level)}" + ("_sd" if scale == "sd" else "")

    def prepare(self, df, env):
        return self.bounds.add_share(df, self.um, "pred", env.width)

    def displays(self):
        return {self.um: f"Confidence Interval ({self.level}/{self.kind})"}

    def params(self):
        return {
            "level": self.level, "supervised": self.supervised, "scale": self.scale, "bounds": self.bounds.state(),
        }


# --- checkers -------------------------------------------------------------------------------


class _CheckerMeasure(FittedMeasure):
    checkers: dict[str, Fitted]

    def models(self):
        return self.checkers


class External(Measure):
    """Certainty of another model, whatever the main model says.

    For a detector as checker, ``repair`` hands the larger probability to the predicted class; it
    is switched on when the main model is itself a detector.
    """

    def __init__(self, model: Model, norm: int | None = None, measure: str = "entropy"):
        self.model, self.norm = model, norm
        self.measure = "entropy" if measure == "entropy" else "max_prob"

    def fit(self, ctx):
        fitted = ctx.fit_model(self.model)
        return FittedExternal(fitted.name, self.norm or ctx.classes, self.measure, {fitted.name: fitted})


class Bayes(External):
    def __init__(self, norm: int | None = None, measure: str = "entropy"):
        super().__init__(GaussianBayes(), norm, measure)


@registered
class FittedExternal(_CheckerMeasure):
    def __init__(self, name, norm, measure, checkers):
        self.name, self.norm, self.measure, self.checkers = name, norm, measure, checkers
        self.um = f"um_external_{slug(name)}_{measure}"

    def columns(self, env):
        prob, pred = env.model_columns[self.name]
        checker = self.checkers[self.name]
        if self.measure == "max_prob":
            return {self.um: confidence(prob)}
        if checker.is_detector and env.main_is_detector:
            return {self.um: certainty(paired_probability(prob, pred), self.norm, 2)}
        return {self.um: env.checker_certainty(checker, self.norm)}

    def displays(self):
        kind = "Unsupervised" if self.checkers[self.name].is_detector else "Supervised"
        return {self.um: f"External {kind} Calculator ({self.name}/{self.measure})"}

    def params(self):
        return {"name": self.name, "norm": self.norm, "measure": self.measure}


class Combined(Measure):
    """Mean certainty of the main model and a checker, negative where they disagree."""

    def __init__(self, model: Model, norm: int | None = None):
        self.model, self.norm = model, norm

    def fit(self, ctx):
        fitted = ctx.fit_model(self.model)
        return FittedCombined([fitted.name], self.norm or ctx.classes, {fitted.name: fitted}, "combined")


class MultiCombined(Measure):
    """Mean of the combined measure over several checkers."""

    def __init__(self, models: list[Model], norm: int | None = None):
        self.checkers, self.norm = models, norm

    def fit(self, ctx):
        fitted = [ctx.fit_model(m) for m in self.checkers]
        return FittedCombined(
            [f.name for f in fitted], self.norm or ctx.classes, {f.name: f for f in fitted}, "multicombined"
        )


def _initials(names: list[str]) -> str:
    return f"{len(names)} - " + "".join(n[0] + n[-1] for n in names)


@registered
class FittedCombined(_CheckerMeasure):
    def __init__(self, names, norm, checkers, kind):
        self.names, self.norm, self.checkers, self.kind = names, norm, checkers, kind
        self.um = f"um_{kind}_" + "_".join(slug(n) for n in names)

    def columns(self, env):
        own = env.own_certainty(self.norm)
        parts = []
        for name in self.names:
            _, pred = env.model_columns[name]
            other = env.checker_certainty(self.checkers[name], self.norm)
            parts.append(signed_mean(own, other, F.col("pred") == F.col(pred)))
        return {self.um: V.total(parts) / F.lit(float(len(parts)))}

    def displays(self):
        if self.kind == "combined":
            return {self.um: f"Combined Calculator ({self.names[0]})"}
        return {self.um: f"Multiple Combined Calculator ({_initials(self.names)} classifiers)"}

    def params(self):
        return {"names": self.names, "norm": self.norm, "kind": self.kind}


class Agreement(Measure):
    """Share of the checkers that vote for their most frequent vote.

    The main model does not vote. A checker that fails to train is left out and reported in
    ``failures``.
    """

    def __init__(self, models: list[Model]):
        self.checkers = models

    def fit(self, ctx):
        fitted, failures = {}, {}
        for model in self.checkers:
            try:
                one = ctx.fit_model(model)
                fitted[one.name] = one
            except Exception as error:
                failures[model.name] = f"{type(error).__name__}: {error}"[:300]
        if not fitted:
            raise ValueError(f"no checker could be trained: {failures}")
        return FittedAgreement(list(fitted), fitted, failures)


@registered
class FittedAgreement(_CheckerMeasure):
    def __init__(self, names, checkers, failures=None):
        self.names, self.checkers, self.failures = names, checkers, failures or {}
        self.um = "um_agreement_" + "_".join(slug(n) for n in names)

    def columns(self, env):
        return {self.um: vote_share([F.col(env.model_columns[n][1]) for n in self.names])}

    def displays(self):
        return {self.um: f"Agreement Calculator ({_initials(self.names)} classifiers)"}

    def params(self):
        return {"names": self.names, "failures": self.failures}


# --- neighbours -----------------------------------------------------------------------------


def neighbour_agreement(nn: Column, pred="pred") -> Column:
    """Share of the neighbours that the main model puts into the row's predicted class."""
    same = F.filter(nn, lambda e: e["pred"] == F.col(pred))
    return F.size(same).cast("double") / F.size(nn)


def neighbour_variability(nn: Column, classes: int) -> Column:
    """Sum over the classes of the population deviation of the neighbours' probabilities."""
    size = F.size(nn).cast("double")

    def spread(c: int) -> Column:
        values = F.transform(nn, lambda e: F.get(e["prob"], F.lit(c)))
        mean = V.array_total(values) / size
        square = F.aggregate(values, F.lit(0.0), lambda acc, p: acc + (p - mean) * (p - mean))
        return F.sqrt(square / size)

    return V.total([spread(c) for c in range(classes)])


def neighbour_detail(nn: Column, names: list[str] | None = None) -> Column:
    """``array<struct<label, n>>``: predicted classes of the neighbours, the most frequent first;
    on ties the class whose first neighbour is nearest."""
    votes = F.transform(nn, lambda e: e["pred"])
    ranked = F.transform(
        F.array_distinct(votes),
        lambda v: F.struct(
            (-F.size(F.filter(votes, lambda x: x == v))).alias("less"),
            F.array_position(votes, v).alias("at"),
            v.alias("code"),
        ),
    )
    table = F.array(*[F.lit(str(n)) for n in names]) if names else None

    def label(code: Column) -> Column:
        return F.get(table, code) if table is not None else code.cast("string")

    return F.transform(
        F.array_sort(ranked), lambda s: F.struct(label(s["code"]).alias("label"), (-s["less"]).alias("n"))
    )


class Neighbours(Measure):
    def __init__(self, k=19):
        self.k = valid_k(k)

    def fit(self, ctx):
        return FittedNeighbours(self.k, ctx.classes, ctx.names)


@registered
class FittedNeighbours(FittedMeasure):
    def __init__(self, k, classes, names=None):
        self.k = self.neighbours = k
        self.classes, self.names = classes, names
        self.ums = [f"um_neighbour_{x}_{k}" for x in ("agreement", "uncertainty")]
        self.detail = f"neighbour_detail_{k}"

    def columns(self, env):
        nn = F.slice("nn", 1, self.k)
        return {
            self.ums[0]: neighbour_agreement(nn),
            self.ums[1]: neighbour_variability(nn, self.classes),
            self.detail: neighbour_detail(nn, self.names),
        }

    def displays(self):
        base = f"uncertainty calculator on {self.k} Neighbors"
        return {self.ums[0]: base + "_agreement", self.ums[1]: base + "_uncertainty", self.detail: base + "_Detail"}

    def params(self):
        return {"k": self.k, "classes": self.classes, "names": self.names}


class KnnDistance(Measure):
    def __init__(self, k=19):
        self.k = valid_k(k)

    def fit(self, ctx):
        return FittedKnnDistance(self.k)


@registered
class FittedKnnDistance(FittedMeasure):
    def __init__(self, k):
        self.k = self.neighbours = k
        self.um = f"um_knn_distance_{k}"

    def columns(self, env):
        return {self.um: F.array_max(F.transform(F.slice("nn", 1, self.k), lambda e: e["dist"]))}

    def displays(self):
        return {self.um: f"uncertainty calculator on {self.k}-NN distance"}

    def params(self):
        return {"k": self.k}


# --- stability under noise ------------------------------------------------------------------


class Proximity(Measure):
    """Share of noisy copies of a row that get the row's predicted class.

    Noise is uniform, ``+- width`` standard deviations per feature, drawn from a hash of (seed,
    row, copy, feature). ``weighted`` gives near copies more weight.
    """

    def __init__(self, points=10, width=0.1, weighted=False, seed=0, noise="xxhash"):
        self.points, self.width, self.weighted = int(points), float(width), bool(weighted)
        self.seed, self.noise = seed, noise

    def fit(self, ctx):
        deviations = np.sqrt(ctx.moments().overall().var[0])
        return FittedProximity(self.points, self.width, self.weighted, self.seed, self.noise, deviations.tolist())


@registered
class FittedProximity(FittedMeasure):
    def __init__(self, points, width, weighted, seed, noise, deviations):
        self.points, self.width, self.weighted = points, width, weighted
        self.seed, self.noise, self.deviations = seed, noise, list(deviations)
        self.um = f"um_proximity_{points}_{slug(width)}" + ("_w" if weighted else "")
        self.copies = (points, width, seed, noise)

    def displays(self):
        tail = "/W" if self.weighted else ""
        return {self.um: f"Proximity Uncertainty ({self.points}/{self.width}{tail})"}

    def params(self):
        return {
            "points": self.points, "width": self.width, "weighted": self.weighted, "seed": self.seed,
            "noise": self.noise, "deviations": self.deviations,
        }

    def noisy(self, row_id: str, copy: str, base: str = "__base") -> Column:
        """A noisy copy; ``row_id`` and ``copy`` are SQL expressions, ``base`` a column."""
        cells = []
        for j, sd in enumerate(self.deviations):
            u = uniform_text(self.noise, str(self.seed), row_id, copy, str(j))
            cells.append(f"{V.at(base, j)} + ({u} * 2D - 1D) * {V.double_literal(self.width * sd)}")
        return F.expr(f"array({', '.join(cells)})")


def apply_proximity(df: DataFrame, measures: list[FittedProximity], scorer: Fitted, width: int) -> DataFrame:
    """All stability measures in one expansion and one scoring pass.

    The copies of a row are made, scored and folded one after the other in the row's task, so for row-local scorers nothing
    is shuffled. A scorer that moves rows gets copies with keys of their own, which are folded by the row's key and joined.
    """
    if scorer is None:
        raise ValueError("stability measures have to call the main model; give a scorer")
    plans = list({m.copies: m for m in measures}.values())
    sizes = [m.points for m in plans]
    tag, copy_no, at, base, own, far, whole, key = (hidden(n) for n in ("tag", "copy", "at", "base", "own", "far", "whole", "key"))
    steps = [(t, c) for t, n in enumerate(sizes) for c in range(1, n + 1)]
    copies = F.array(*[F.struct(F.lit(i).alias(at), F.lit(t).alias(tag), F.lit(c).alias(copy_no)) for i, (t, c) in enumerate(steps)])
    names = df.columns
    if not scorer.row_local:
        # a written number is the same whenever it is read
        df = materialize(df.withColumn(key, F.monotonically_increasing_id()), "copied-rows")
        whole_row = F.lit(None).cast("int")
    else:
        df = df.withColumn(key, F.lit(0).cast("long"))
        whole_row = F.struct(*[F.col(f"`{n}`") for n in names])
    wide = df.select(key, "row_id", F.col("pred").alias(own), F.col("features").cast("array<double>").alias(base), whole_row.alias(whole), F.explode(copies).alias("e"))
    wide = wide.select(key, "row_id", own, base, F.when(F.col(f"e.{at}") == 0, F.col(whole)).alias(whole), "e.*")
    vector = None
    for t, m in enumerate(plans):
        cell = m.noisy("row_id", copy_no, base)
        vector = F.when(F.col(tag) == t, cell) if vector is None else vector.when(F.col(tag) == t, cell)
    wide = wide.withColumn("features", V.vector(vector, width, "features"))
    wide = wide.withColumn(far, V.euclidean("features", base, width)).drop(base)
    if not scorer.row_local:
        wide = wide.withColumn("row_id", F.concat_ws("|", F.col(key).cast("string"), F.col(at).cast("string")))
    prob, pred = hidden("prob"), hidden("pred")
    hit = F.coalesce(F.col(pred) == F.col(own), F.lit(False)).cast("double")
    scored = scorer.transform(wide, prob, pred).select(key, whole, at, tag, hit.alias("hit"), F.coalesce(F.col(far), F.lit(0.0)).alias("far"))
    place = {m.copies: t for t, m in enumerate(plans)}
    ums = {m.um: (place[m.copies], m.weighted) for m in measures}
    if scorer.row_local:
        return _folded_copies(scored, whole, at, df.select(*names).schema, sizes, ums)
    aggs = []
    for t, n in enumerate(sizes):
        mine = F.col(tag) == t
        sums = [F.sum(F.when(mine, x)) for x in (F.col("hit"), F.col("hit") * F.col("far"), F.col("far"))]
        hits, near, distance, top = *sums, F.max(F.when(mine, F.col("far")))
        for um, (plan, weighted) in ums.items():
            if plan == t:
                # weight of a copy: (top - far) + top / 10
                mass = F.lit(1.1 * n) * top - distance
                aggs.append((F.when(mass > 0, (F.lit(1.1) * top * hits - near) / mass) if weighted else hits / F.lit(float(n))).alias(um))
    folded = scored.groupBy(F.col(key).alias(f"{key}_2")).agg(*aggs)
    return df.join(folded, F.col(key) == F.col(f"{key}_2"), "left").drop(key, f"{key}_2")


def _folded_copies(scored: DataFrame, whole: str, at: str, schema: StructType, sizes: list[int], ums: dict[str, tuple[int, bool]]) -> DataFrame:
    """Rows with their stability measures, from copies that follow one another in their task."""
    count, ends = sum(sizes), np.cumsum(sizes)
    plain = StructType([StructField(f.name, f.dataType, True) for f in schema] + [StructField(um, DoubleType()) for um in ums])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            rows = held.num_rows // count
            if not rows:
                continue
            done, held = held.slice(0, rows * count), held.slice(rows * count)
            order = done.column(at).to_numpy().reshape(rows, count)
            if (order != np.arange(count)).any():
                raise ValueError("the main model moves rows; it has to say so by row_local = False")
            hit, far = (done.column(n).to_numpy().reshape(rows, count) for n in ("hit", "far"))
            first = done.column(whole).take(pa.array(np.arange(rows) * count)).combine_chunks()
            columns = first.flatten()
            for plan, weighted in ums.values():
                mine = slice(ends[plan] - sizes[plan], ends[plan])
                weight = 1.1 * far[:, mine].max(axis=1, keepdims=True) - far[:, mine] if weighted else np.ones((rows, sizes[plan]))
                mass = weight.sum(axis=1)
                share = (hit[:, mine] * weight).sum(axis=1) / np.where(mass > 0, mass, 1.0)
                columns.append(pa.array(share, pa.float64(), mask=mass <= 0))
            yield pa.RecordBatch.from_arrays(columns, names=plain.names)
        if held is not None and held.num_rows:
            raise ValueError("the main model loses rows; it has to say so by row_local = False")

    out = scored.select(whole, at, "hit", "far").mapInArrow(run, plain)
    return out.select(*[F.col(f"`{f.name}`").alias(f.name, metadata=f.metadata) for f in schema], *ums)


# --- bags and reconstruction ----------------------------------------------------------------


class FeatureBagging(Measure):
    """Share of models on random feature subsets that agree with the main prediction."""

    def __init__(self, members=10, kind="sup", seed=0):
        try:
            self.members = int(members)
        except (TypeError, ValueError):
            self.members = 10
        self.kind, self.seed = ("uns" if kind == "uns" else "sup"), seed

    def fit(self, ctx):
        base = make_model("COPOD") if self.kind == "uns" else make_model("DT")
        fitted = ctx.fit_model(FeatureBags(base, self.members, self.seed))
        return FittedFeatureBagging(fitted.name, self.members, self.kind, {fitted.name: fitted})


@registered
class FittedFeatureBagging(_CheckerMeasure):
    def __init__(self, name, members, kind, checkers):
        self.name, self.members, self.kind, self.checkers = name, members, kind, checkers
        self.um = f"um_feature_bagging_{members}_{kind}"

    def columns(self, env):
        prob, _ = env.model_columns[self.name]
        # the probability of a class is its share of the votes
        return {self.um: F.coalesce(F.get(F.col(prob), F.col("pred")), F.lit(0.0))}

    def displays(self):
        return {self.um: f"FeatureBagging Uncertainty ({self.members}/{self.kind})"}

    def params(self):
        return {"name": self.name, "members": self.members, "kind": self.kind}


class ConfidenceBaggingMeasure(Measure):
    """Combined measure with a confidence-bagging ensemble of the main algorithm as checker."""

    def __init__(self, base: Model, norm: int | None = None, **options):
        self.ensemble, self.norm = ConfidenceBagging(base, **options), norm

    def fit(self, ctx):
        return Combined(self.ensemble, self.norm).fit(ctx)


class ConfidenceBoostingMeasure(Measure):
    def __init__(self, base: Model, norm: int | None = None, **options):
        self.ensemble, self.norm = ConfidenceBoosting(base, **options), norm

    def fit(self, ctx):
        return Combined(self.ensemble, self.norm).fit(ctx)


class ReconstructionLoss(Measure):
    def __init__(self, kind: str = "simple", epochs: int = 50, batch: int = 256, seed: int = 7):
        self.kind = kind if kind in ("simple", "sparse", "deep", "pca") else "simple"
        self.epochs, self.batch, self.seed = epochs, batch, seed

    def fit(self, ctx):
        options = (self.kind, self.epochs, self.batch, self.seed)
        coder = ctx.store.get(f"reconstruction {options}", lambda: Reconstructor.fit(ctx.store.train, *options))
        return FittedReconstruction(coder.state())


@registered
class FittedReconstruction(FittedMeasure):
    def __init__(self, coder):
        self.coder = Reconstructor(**coder)
        self.um = f"um_reconstruction_{self.coder.kind}"

    def columns(self, env):
        return {self.um: self.coder.loss()}

    def displays(self):
        return {self.um: f"AutoEncoder Loss ({self.coder.kind})"}

    def params(self):
        return {"coder": self.coder.state()}


# --- applying -------------------------------------------------------------------------------


def apply_measures(
    df: DataFrame,
    fitted: list[FittedMeasure],
    *,
    scorer: Fitted | None = None,
    reference: DataFrame | None = None,
    exclude_self: bool = False,
    bounds: str = "batch",
    knn_options: dict | None = None,
) -> DataFrame:
    """Add all measures to scored rows (``row_id, features, prob, pred``), sanitised.

    Row-local measures end up in one projection; only the neighbour merge and the stability fold
    shuffle. Unusable values become -10.
    """
    keep = df.columns
    df = clean_features(df)
    slim = df.select("row_id", "features")
    width, prob_width = V.width_of(df, "features"), V.known_width(df, "prob")
    env = Env(prob_width, width, {}, scorer, bool(scorer is not None and scorer.is_detector))
    needed = [m.neighbours for m in fitted if m.neighbours]
    if needed and reference is None:
        raise ValueError("neighbour measures need the scored training rows as reference")
    shared: dict[str, Fitted] = {}
    for m in fitted:
        shared.update(m.models())
    temporary = []
    for i, (name, model) in enumerate(shared.items()):
        names = (f"__k{i}_prob", f"__k{i}_pred")
        env.model_columns[name] = names
        temporary += names
        if model.is_detector:
            df = model.transform(df, *names, bounds=bounds)
        else:
            df = model.transform(df, *names)
    # after the checkers: detectors read the rows several times, which must not repeat the copies and the join, nor move lists
    stable = [m for m in fitted if isinstance(m, FittedProximity)]
    if stable:
        df = apply_proximity(df, stable, scorer, width)
    if needed:
        df = knn_join(
            df, reference, max(needed), carry=["pred", "prob"], exclude_self=exclude_self, asked=slim, **(knn_options or {})
        )
    df = V.with_width(df, "features", width)
    if prob_width:
        df = V.with_width(df, "prob", prob_width)
    for m in fitted:
        df = m.prepare(df, env)
    out: dict[str, Column] = {}
    expressions = [m.columns(env) for m in fitted]
    if env.pending:
        df = df.withColumns(env.pending)
    for m, own in zip(fitted, expressions):
        for name, display in m.displays().items():
            column = own.get(name, F.col(name))
            if name.startswith("um_"):
                column = V.clean_measure(column)
            out[name] = column.alias(name, metadata={"display": display})
    return df.select(*[c for c in keep if c not in out], *out.values())


def measure_names(fitted: list[FittedMeasure]) -> list[str]:
    """Numeric measure columns, without duplicates."""
    return list(dict.fromkeys(c for m in fitted for c in m.displays() if c.startswith("um_")))


# --- persistence ----------------------------------------------------------------------------


def save_measures(spark: SparkSession, fitted: list[FittedMeasure], path: str) -> None:
    """One folder per checker, one JSON list of measures, one long table of parameters."""
    shared: dict[str, Fitted] = {}
    for m in fitted:
        shared.update(m.models())
    order = list(shared)
    for i, name in enumerate(order):
        shared[name].save(spark, os.path.join(path, f"checker-{i}"))
    body = [
        {"kind": type(m).__name__, "params": m.params(), "checkers": list(m.models())} for m in fitted
    ]
    write_json(spark, os.path.join(path, "measures"), {"measures": body, "checkers": order})
    rows = []
    for i, m in enumerate(fitted):
        um = f"uncertainty_calculator_{i + 1}"
        rows.append((um, "calculator_class", type(m).__name__))
        rows += [(um, k, str(v)) for k, v in m.params().items() if isinstance(v, (str, int, float, bool))]
    table = spark.createDataFrame(rows, "um_id string, name string, value string")
    table.coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "params"))


def load_measures(spark: SparkSession, path: str) -> list[FittedMeasure]:
    head = read_json(spark, os.path.join(path, "measures"))
    shared = {}
    for i, name in enumerate(head["checkers"]):
        checker = load_fitted(spark, os.path.join(path, f"checker-{i}"))
        if hasattr(checker, "load_members"):
            checker.load_members(spark, os.path.join(path, f"checker-{i}"))
        shared[name] = checker
    out = []
    for entry in head["measures"]:
        extra = {"checkers": {n: shared[n] for n in entry["checkers"]}} if entry["checkers"] else {}
        out.append(MEASURES[entry["kind"]](**entry["params"], **extra))
    return out

