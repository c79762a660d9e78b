"""Unsupervised anomaly detectors behind one contract.

``fit`` learns a score (larger = stranger) and the score threshold of the ``1 - contamination``
quantile of the training scores. ``transform`` turns scores into two-class probabilities: the
winner gets a half plus half its distance from the threshold, relative to the farthest row on its
side. That scale comes from the scored batch, or with ``bounds='train'`` from the training rows,
which makes the detector a row-local function, as streams need it.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doubtline.functions import vectors as V
from doubtline.functions.prob import argmax
from doubtline.operators.bounded import bounded_collect, check_values
from doubtline.operators.knn import knn_join, kth_distance
from doubtline.operators.models import Fitted, Model, canonical, register
from doubtline.operators.skew import lookup
from doubtline.operators.stats import (
    column_quantile,
    covariance,
    long_form,
    moments,
    task_partials,
)
from doubtline.session import hidden, materialize

DEFAULT_CONTAMINATION = 0.1


def detector_probability(score: Column, threshold: float, low: float, high: float, name: str = "prob") -> Column:
    """``low`` and ``high`` are the extremes of (score - threshold) over the batch."""
    t = score - F.lit(float(threshold))
    above = t / F.lit(float(high)) if high > 0 else F.lit(0.0)
    below = t / F.lit(float(low)) if low != 0 else F.lit(0.2)
    strength = F.when(t > 0, F.least(above, F.lit(1.0))).otherwise(F.least(below, F.lit(1.0)))
    win, lose = F.lit(0.5) + strength / 2.0, F.lit(0.5) - strength / 2.0
    return V.vector(F.when(t > 0, F.array(lose, win)).otherwise(F.array(win, lose)), 2, name)


class Detector(Model):
    is_detector = True

    def __init__(self, contamination: float | None = None):
        rate = DEFAULT_CONTAMINATION if contamination is None else contamination
        self.contamination = min(float(rate), 0.5)

    def learn(self, train: DataFrame) -> FittedDetector:
        raise NotImplementedError

    def fit(self, train: DataFrame) -> FittedDetector:
        fitted = self.learn(train)
        fitted.name, fitted.contamination = self.name, self.contamination
        scores = fitted.train_scores(train)
        if fitted.costly:
            scores = materialize(scores.select("score"), "detector-scores")
        row = scores.agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.count("score").alias("n")).first()
        if not row.n:
            raise ValueError("no rows to fit on")
        fitted.threshold = column_quantile(scores, "score", 1.0 - self.contamination, rows=row.n)
        fitted.low, fitted.high = row.lo - fitted.threshold, row.hi - fitted.threshold
        return fitted


class FittedDetector(Fitted):
    is_detector = True
    costly = False  # needs shuffles to score
    contamination = DEFAULT_CONTAMINATION
    threshold = low = high = 0.0
    classes = 2

    @property
    def row_local(self) -> bool:
        return not self.costly

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        raise NotImplementedError

    def train_scores(self, train: DataFrame) -> DataFrame:
        return self.score(train)

    def transform(self, df, prob="prob", pred="pred", bounds: str = "batch"):
        column = f"__{prob}_score"
        scored = self.score(df, column)
        low, high = self.low, self.high
        if bounds == "batch":
            if self.costly:
                scored = materialize(scored, "detector-batch")
            row = scored.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
            if row.lo is not None:
                low, high = row.lo - self.threshold, row.hi - self.threshold
        scored = scored.withColumn(prob, detector_probability(F.col(column), self.threshold, low, high, prob))
        return scored.withColumn(pred, argmax(prob)).drop(column)

    # persistence: subclasses give their parameters in ``params``
    def params(self) -> dict:
        return {}

    def state(self):
        common = ("name", "contamination", "threshold", "low", "high")
        return {"common": {c: getattr(self, c) for c in common}, "params": self.params()}

    @classmethod
    def restore(cls, state, ml, frames):
        out = cls(**state["params"], **frames)
        for key, value in state["common"].items():
            setattr(out, key, value)
        return out


def _vector_score(df: DataFrame, fn, out: str) -> DataFrame:
    return df.withColumn(out, V.matrix_to_scalar(fn)(F.col("features").cast("array<double>")))


# --- D1, D2: empirical tails ----------------------------------------------------------------


#: Cut points of a feature, from a sketch with this accuracy; a value at two of them is common.
TAIL_CUTS, TAIL_ACCURACY = 64, 2000


class TailDetector(Detector):
    """COPOD and ECOD: -log of the empirical tail probabilities, summed over the features."""

    def __init__(self, kind: str, contamination=None):
        super().__init__(contamination)
        self.kind = self.name = kind

    def learn(self, train):
        long = long_form(train, features="features")
        sums, cuts = _shape(long)
        return FittedTails(self.kind, sums, cuts, long.groupBy("fid", "x").agg(F.count(F.lit(1)).alias("c")))


def _shape(long: DataFrame) -> tuple[list, list]:
    """Of each feature: count, mean, second and third central sum; and its cut points."""
    shares = F.array(*[F.lit(i / TAIL_CUTS) for i in range(TAIL_CUTS + 1)])
    table = long.groupBy("fid").agg(
        F.count("x").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"), F.skewness("x").alias("s"),
        F.percentile_approx("x", shares, TAIL_ACCURACY).alias("cuts"),
    )
    rows = sorted(bounded_collect(table, what="features"), key=lambda r: r.fid)
    sums = []
    for r in rows:
        third = 0.0 if r.s is None or r.s != r.s else r.s * r.v**1.5 * r.n
        sums.append([float(r.n), r.m or 0.0, (r.v or 0.0) * r.n, third])
    return sums, [sorted(set(r.cuts or [])) for r in rows]


def _joined_sums(a: list, b: list) -> list:
    """Counts, means and central sums of two tables as one."""
    out = []
    for (n, m, s, t), (k, mean, second, third) in zip(a, b, strict=True):
        whole, gap = n + k, mean - m
        if not n or not k:
            out.append([n, m, s, t] if n else [k, mean, second, third])
            continue
        out.append([
            whole, m + gap * k / whole, s + second + gap**2 * n * k / whole,
            t + third + gap**3 * n * k * (n - k) / whole**2 + 3 * gap * (n * second - k * s) / whole,
        ])
    return out


@register
class FittedTails(FittedDetector):
    costly = True

    def __init__(self, kind, sums, cuts, values):
        self.kind, self.sums, self.cuts, self.values = kind, sums, cuts, values

    def train_scores(self, train):
        return self._score(train, "score", with_train=False)

    def score(self, df, out="score"):
        return self._score(df, out, with_train=True)

    def _score(self, df, out, with_train):
        """Tails over the rows to score, together with the training values.

        The cells of the rows go to ranges of their feature's values, between cut points or exactly at one. A range's rows
        and how many come before it are counted in the tasks first, so a cell at a cut point, as all those of a common value
        are, knows its tails without being moved; the others are ranked within their range. Cells know their row by a hash of
        all its columns, and one fold by it sums them up; the row itself travels with the cell of its first feature.
        """
        names = df.columns
        key, whole, copies = hidden("key"), hidden("row"), hidden("copies")
        every = [F.col(f"`{n}`") for n in names]
        hashed = F.struct(F.xxhash64(*every), F.xxhash64(F.lit(1), *every))
        row = df.select(hashed.alias(key), F.struct(*every).alias(whole), F.col("features").cast("array<double>").alias("x"))
        cells = row.select(key, F.posexplode("x").alias("fid", "x"), whole).withColumn(whole, F.when(F.col("fid") == 0, F.col(whole)))
        own_sums, own_cuts = _shape(long_form(df))
        sums, cuts = own_sums or self.sums, own_cuts or self.cuts
        if with_train and own_sums:
            sums = _joined_sums(self.sums, own_sums)
            cuts = [sorted({*a, *b}) for a, b in zip(self.cuts, own_cuts, strict=True)]
        check_values(sum(map(len, cuts)), "cut points")
        d, edges = len(sums), [np.array(c, float) for c in cuts]

        @F.arrow_udf("int")
        def place(fid: pa.Array, x: pa.Array) -> pa.Array:
            # even numbers between cut points, odd ones at them
            feature, value = fid.to_numpy(zero_copy_only=False), x.to_numpy(zero_copy_only=False).astype(float)
            found = np.zeros(len(feature), np.int32)
            for j in np.unique(feature):
                mine = feature == j
                right = np.searchsorted(edges[j], value[mine], side="right")
                found[mine] = np.searchsorted(edges[j], value[mine]) + right
            return pa.array(found)

        cells = cells.withColumn("c", F.lit(1).cast("long")).withColumn("part", place("fid", "x"))
        known = cells
        if with_train:
            old = self.values.select(F.lit(None).cast(cells.schema[key].dataType).alias(key), "fid", "x", F.lit(None).cast(cells.schema[whole].dataType).alias(whole), F.col("c").cast("long").alias("c"))
            known = cells.unionByName(old.withColumn("part", place("fid", "x")))
        ahead = Window.partitionBy("fid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        totals = known.groupBy("fid", "part").agg(F.sum("c").alias("inside"))  # at most two rows for each cut point
        totals = totals.select("fid", "part", "inside", F.coalesce(F.sum("inside").over(ahead), F.lit(0)).alias("before"))
        n = V.lit_vector([s[0] for s in sums])
        sign = V.lit_vector([float(np.sign(s[3])) for s in sums])

        def tails(below: Column, upto: Column) -> Column:
            size, skew = F.get(n, "fid"), F.get(sign, "fid")
            left, right = -F.ln(upto / size), -F.ln((size - below) / size)
            skewed = F.when(skew > 0, right).when(skew < 0, left).otherwise(left + right)
            return F.greatest(skewed, (left + right) / 2.0) if self.kind == "COPOD" else F.greatest(skewed, left, right)

        totals = F.broadcast(totals)
        at_cut = cells.filter(F.col("part") % 2 == 1).join(totals, ["fid", "part"])
        at_cut = at_cut.select(key, whole, "fid", tails(F.col("before"), F.col("before") + F.col("inside")).alias("u"))
        between = known.filter(F.col("part") % 2 == 0)
        order = Window.partitionBy("fid", "part").orderBy("x")
        ranked = between.withColumn("upto", F.sum("c").over(order)).withColumn("same", F.sum("c").over(Window.partitionBy("fid", "part", "x")))
        ranked = ranked.filter(F.col(key).isNotNull()).join(totals, ["fid", "part"])
        upto = F.col("before") + F.col("upto")
        ranked = ranked.select(key, whole, "fid", tails(upto - F.col("same"), upto).alias("u"))
        # rows that are equal in all columns fold into one and come out as often as they went in
        share = F.sum("u") * F.lit(float(d)) / F.count("u")
        folded = at_cut.unionByName(ranked).groupBy(key).agg(
            F.first(whole, ignorenulls=True).alias(whole), share.alias(out), F.sum(F.when(F.col("fid") == 0, 1)).alias(copies)
        )
        again = folded.select(whole, out, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))).alias(copies))
        fields = [F.col(whole)[f.name].alias(f.name, metadata=f.metadata) for f in df.schema]
        return again.select(*fields, out)

    def params(self):
        return {"kind": self.kind, "sums": self.sums, "cuts": self.cuts}

    def frames(self):
        return {"values": self.values}


# --- D3: histograms -------------------------------------------------------------------------


class HistogramDetector(Detector):
    name = "HBOS"

    def __init__(self, contamination=None, bins: int = 30, alpha: float = 0.1, tolerance: float = 0.5):
        super().__init__(contamination)
        self.bins, self.alpha, self.tolerance = bins, alpha, tolerance

    def learn(self, train):
        m = moments(train)
        low, high = m.low[0].copy(), m.high[0].copy()
        flat = low == high
        low[flat] -= 0.5
        high[flat] += 0.5
        step = (high - low) / self.bins
        lo, st = V.lit_vector(low), V.lit_vector(step)
        cell = F.floor((F.col("x") - F.get(lo, "fid")) / F.get(st, "fid"))
        counted = (
            long_form(train)
            .groupBy("fid", F.least(cell, F.lit(self.bins - 1)).cast("int").alias("bin"))
            .agg(F.count(F.lit(1)).alias("c"))
        )
        counts = np.zeros((m.width, self.bins))
        for r in bounded_collect(counted, limit=m.width * self.bins):
            counts[r.fid, max(r.bin, 0)] = r.c
        density = counts / (m.rows * step[:, None])
        return FittedHistograms(low, high, step, -np.log2(density + self.alpha), self.tolerance)


@register
class FittedHistograms(FittedDetector):
    def __init__(self, low, high, step, table, tolerance):
        self.low_edge, self.high_edge, self.step = np.array(low), np.array(high), np.array(step)
        self.table, self.tolerance = np.array(table), tolerance

    def score(self, df, out="score"):
        d, bins = self.table.shape
        if d * bins > 4096:
            return self._wide(df, out)
        terms = []
        for j in range(d):
            x, step = V.item("features", j), float(self.step[j])
            lo, hi = float(self.low_edge[j]), float(self.high_edge[j])
            values, worst = V.lit_vector(self.table[j]), F.lit(float(self.table[j].max()))
            cell = F.least(F.floor((x - F.lit(lo)) / F.lit(step)), F.lit(bins - 1)).cast("int")
            near_low = F.when(F.lit(lo) - x <= self.tolerance * step, F.lit(float(self.table[j, 0]))).otherwise(worst)
            near_high = F.when(x - F.lit(hi) <= self.tolerance * step, F.lit(float(self.table[j, -1]))).otherwise(worst)
            terms.append(F.when(x < lo, near_low).when(x > hi, near_high).otherwise(F.get(values, cell)))
        return df.withColumn(out, V.total(terms))

    def _wide(self, df, out):
        low, high, step, table, tol = self.low_edge, self.high_edge, self.step, self.table, self.tolerance
        bins, worst = table.shape[1], table.max(axis=1)

        def fn(x):
            cell = np.clip(np.floor((x - low) / step), 0, bins - 1).astype(int)
            u = table[np.arange(table.shape[0])[None, :], cell]
            far = (x < low - tol * step) | (x > high + tol * step)
            return np.where(far, worst, u).sum(axis=1)

        return _vector_score(df, fn, out)

    def params(self):
        return {
            "low": self.low_edge, "high": self.high_edge, "step": self.step,
            "table": self.table, "tolerance": self.tolerance,
        }


# --- D4, D5: second moments -----------------------------------------------------------------


@register
class FittedEllipse(FittedDetector):
    """Squared Mahalanobis distance."""

    def __init__(self, mean, inverse):
        self.mean, self.inverse = np.array(mean), np.array(inverse)

    def score(self, df, out="score"):
        mean, inverse = self.mean, self.inverse

        def fn(x):
            gap = x - mean
            return np.einsum("ij,jk,ik->i", gap, inverse, gap, optimize=True)

        return _vector_score(df, fn, out)

    def params(self):
        return {"mean": self.mean, "inverse": self.inverse}


class RobustCovariance(Detector):
    """Minimum covariance determinant by concentration steps: fit, keep the nearest, fit again.

    Every step is a function of the original table and a d x d matrix, so no lineage builds up.
    """

    name = "MCD"

    def __init__(self, contamination=None, support: float = 0.9, steps: int = 10):
        super().__init__(contamination)
        self.support, self.steps = support, steps

    def learn(self, train):
        rows = train.select("features").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            n, mean, cov = covariance(rows, ddof=1)
            last = math.inf
            for _ in range(self.steps):  # two passes each
                scored = FittedEllipse(mean, np.linalg.pinv(cov)).score(rows, "__d")
                cut = column_quantile(scored, "__d", self.support, rows=n)
                _, mean, cov = covariance(scored.filter(F.col("__d") <= cut), ddof=1, center=mean)
                size = np.linalg.slogdet(cov)[1]
                if not size < last - 1e-9:
                    break
                last = size
        finally:
            rows.unpersist()
        return FittedEllipse(mean, np.linalg.pinv(cov))


class PrincipalComponents(Detector):
    """Distances to the principal axes, each divided by its share of the variance."""

    name = "PCA"

    def learn(self, train):
        _, mean, cov = covariance(train, ddof=0)
        scale = np.sqrt(np.diag(cov))
        scale[scale == 0] = 1.0
        values, axes = np.linalg.eigh(cov / np.outer(scale, scale))
        share = values / values.sum()
        keep = share > 1e-12
        return FittedAxes(mean, scale, axes.T[keep], share[keep])


@register
class FittedAxes(FittedDetector):
    def __init__(self, mean, scale, axes, share):
        self.mean, self.scale = np.array(mean), np.array(scale)
        self.axes, self.share = np.array(axes), np.array(share)

    def score(self, df, out="score"):
        mean, scale, axes, share = self.mean, self.scale, self.axes, self.share

        def fn(x):
            z = (x - mean) / scale
            # axes have length 1; their sign is arbitrary, so both directions are measured
            square = (z * z).sum(axis=1, keepdims=True) + 1.0 - 2.0 * np.abs(z @ axes.T)
            return (np.sqrt(np.maximum(square, 0.0)) / share).sum(axis=1)

        return _vector_score(df, fn, out)

    def params(self):
        return {"mean": self.mean, "scale": self.scale, "axes": self.axes, "share": self.share}


# --- D6: clusters ---------------------------------------------------------------------------


class ClusterDetector(Detector):
    name = "CBLOF"

    def __init__(self, contamination=None, clusters: int = 8, alpha: float = 0.75, beta: float = 3.0, seed: int = 7):
        super().__init__(contamination)
        self.clusters, self.alpha, self.beta, self.seed = clusters, alpha, beta, seed

    def learn(self, train):
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        data = train.select(array_to_vector(F.col("features").cast("array<double>")).alias("features"))
        model = KMeans(k=self.clusters, seed=self.seed, initSteps=2).fit(data)
        centers = np.array(model.clusterCenters())
        sizes = np.array(model.summary.clusterSizes, float)
        return FittedClusters(centers, large_clusters(sizes, self.alpha, self.beta))


def large_clusters(sizes: np.ndarray, alpha: float, beta: float) -> list[bool]:
    """Which clusters are large: together ``alpha`` of the rows, or before a drop of ``beta``."""
    order = np.argsort(-sizes, kind="stable")
    held = np.cumsum(sizes[order]) >= alpha * sizes.sum()
    after = np.append(sizes[order][1:], 0.0)
    drop = sizes[order] >= beta * np.where(after > 0, after, np.inf)
    at = len(sizes) - 1
    for rule in (held & drop, held, drop):
        if rule[:-1].any():
            at = int(np.argmax(rule))
            break
    large = np.zeros(len(sizes), bool)
    large[order[: at + 1]] = True
    return large.tolist()


@register
class FittedClusters(FittedDetector):
    def __init__(self, centers, large):
        self.centers, self.large = np.array(centers), np.array(large, bool)

    def score(self, df, out="score"):
        centers, large = self.centers, self.large

        def fn(x):
            gaps = np.sqrt(((x[:, None, :] - centers[None, :, :]) ** 2).sum(axis=2))
            own = gaps.argmin(axis=1)
            return np.where(large[own], gaps[np.arange(len(x)), own], gaps[:, large].min(axis=1))

        return _vector_score(df, fn, out)

    def params(self):
        return {"centers": self.centers, "large": self.large}


# --- D7, D8, D10, D11: neighbours -----------------------------------------------------------


class NeighbourDistance(Detector):
    name = "uKNN"

    def __init__(self, contamination=None, k: int = 3):
        super().__init__(contamination)
        self.k = k

    def learn(self, train):
        return FittedNeighbourDistance(self.k, train.select("row_id", "features"))


@register
class FittedNeighbourDistance(FittedDetector):
    costly = True

    def __init__(self, k, ref):
        self.k, self.ref = k, ref

    def _score(self, df, out, own):
        keep = df.columns
        joined = knn_join(df, self.ref, self.k, exclude_self=own)
        return joined.withColumn(out, kth_distance("nn")).select(*keep, out)

    def score(self, df, out="score"):
        return self._score(df, out, False)

    def train_scores(self, train):
        return self._score(train, "score", True)

    def params(self):
        return {"k": self.k}

    def frames(self):
        return {"ref": self.ref}


def pair_table(joined: DataFrame) -> DataFrame:
    """``row_id, ref_id, dist`` of every neighbour list."""
    return joined.select("row_id", F.explode("nn").alias("e")).select(
        "row_id", F.col("e.ref_id").alias("ref_id"), F.col("e.dist").alias("dist")
    )


class LocalOutlierFactor(Detector):
    name = "LOF"

    def __init__(self, contamination=None, k: int = 5):
        super().__init__(contamination)
        self.k = k

    def learn(self, train):
        joined = knn_join(train.select("row_id", "features"), train, self.k, exclude_self=True)
        joined = materialize(joined.withColumn("kdist", kth_distance("nn")), "lof-neighbours")
        pairs = pair_table(joined)
        reach = joined.select(F.col("row_id").alias("ref_id"), "kdist")
        near = lookup(pairs, reach, ["ref_id"])
        mean = F.avg(F.greatest("dist", "kdist"))
        density = near.groupBy("row_id").agg((F.lit(1.0) / (mean + F.lit(1e-10))).alias("lrd"))
        profile = joined.select("row_id", "features", "kdist").join(density, "row_id")
        profile = materialize(profile, "lof-profile")
        others = lookup(pairs, profile.select(F.col("row_id").alias("ref_id"), "lrd"), ["ref_id"])
        around = others.groupBy("row_id").agg(F.avg("lrd").alias("around"))
        own = profile.select("row_id", "lrd").join(around, "row_id")
        own = own.select("row_id", (F.col("around") / F.col("lrd")).alias("score"))
        return FittedLocalOutlier(self.k, profile, materialize(own, "lof-scores"))


@register
class FittedLocalOutlier(FittedDetector):
    costly = True

    def __init__(self, k, profile, own=None):
        self.k, self.profile, self.own = k, profile, own

    def train_scores(self, train):
        return train.join(self.own, "row_id")

    def score(self, df, out="score"):
        keep = df.columns
        joined = knn_join(df, self.profile, self.k, carry=["kdist", "lrd"])
        size = F.size("nn").cast("double")
        reach = V.array_total(F.transform("nn", lambda e: F.greatest(e["dist"], e["kdist"]))) / size
        around = V.array_total(F.transform("nn", lambda e: e["lrd"])) / size
        return joined.withColumn(out, around * (reach + F.lit(1e-10))).select(*keep, out)

    def params(self):
        return {"k": self.k}

    def frames(self):
        return {"profile": self.profile, "own": self.own}


def neighbour_vectors(joined: DataFrame, out: str = "__near") -> DataFrame:
    return joined.withColumn(out, F.transform("nn", lambda e: e["features"]))


def _cube(near: pa.Array) -> np.ndarray:
    """Lists of k vectors to an (n, k, d) array."""
    rows = len(near)
    inner = near.flatten()
    flat = inner.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    k = len(inner) // rows
    return flat.reshape(rows, k, -1)


def angle_spread(x: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Negative variance of the distance-weighted cosines over pairs of neighbours."""
    gap = near - x[:, None, :]
    square = (gap * gap).sum(axis=2)
    i, j = np.triu_indices(near.shape[1], 1)
    dot = np.einsum("npd,npd->np", gap[:, i], gap[:, j])
    weight = square[:, i] * square[:, j]
    ok = weight > 0
    value = np.where(ok, dot / np.where(ok, weight, 1.0), 0.0)
    n = np.maximum(ok.sum(axis=1), 1)
    mean = value.sum(axis=1) / n
    return -(np.where(ok, (value - mean[:, None]) ** 2, 0.0).sum(axis=1) / n)


def chaining_distance(x: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Average chaining distance along the neighbours, nearest first."""
    k = near.shape[1]
    path = np.concatenate([x[:, None, :], near], axis=1)
    out = np.zeros(len(x))
    for j in range(1, k + 1):
        gap = path[:, :j, :] - path[:, j : j + 1, :]
        out += 2.0 * (k + 1 - j) / (k * (k + 1)) * np.sqrt((gap * gap).sum(axis=2)).min(axis=1)
    return out


def _pairwise_udf(fn):
    @F.arrow_udf("double")
    def apply(x: pa.Array, near: pa.Array) -> pa.Array:
        if len(x) == 0:
            return pa.array([], pa.float64())
        return pa.array(fn(V.to_matrix(x), _cube(near)))

    return apply


class AngleDetector(Detector):
    name = "FastABOD"

    def __init__(self, contamination=None, k: int = 7):
        super().__init__(contamination)
        self.k = k

    def learn(self, train):
        return FittedAngles(self.k, train.select("row_id", F.col("features").cast("array<double>").alias("features")))


@register
class FittedAngles(FittedDetector):
    costly = True

    def __init__(self, k, ref):
        self.k, self.ref = k, ref

    def _score(self, df, out, own):
        keep = df.columns
        joined = neighbour_vectors(knn_join(df, self.ref, self.k, carry=["features"], exclude_self=own))
        spread = _pairwise_udf(angle_spread)(F.col("features").cast("array<double>"), F.col("__near"))
        return joined.withColumn(out, spread).select(*keep, out)

    def score(self, df, out="score"):
        return self._score(df, out, False)

    def train_scores(self, train):
        return self._score(train, "score", True)

    def params(self):
        return {"k": self.k}

    def frames(self):
        return {"ref": self.ref}


class ConnectivityDetector(Detector):
    name = "COF"

    def __init__(self, contamination=None, k: int = 9):
        super().__init__(contamination)
        self.k = k

    def learn(self, train):
        base = train.select("row_id", F.col("features").cast("array<double>").alias("features"))
        joined = neighbour_vectors(knn_join(base, base, self.k, carry=["features"], exclude_self=True))
        chain = _pairwise_udf(chaining_distance)(F.col("features"), F.col("__near"))
        joined = joined.withColumn("chain", chain).drop("__near")
        slim = F.transform("nn", lambda e: F.struct(e["dist"].alias("dist"), e["ref_id"].alias("ref_id")))
        joined = materialize(joined.withColumn("nn", slim), "cof-neighbours")
        profile = joined.select("row_id", "features", "chain")
        others = lookup(pair_table(joined), profile.select(F.col("row_id").alias("ref_id"), "chain"), ["ref_id"])
        around = others.groupBy("row_id").agg(F.avg("chain").alias("around"))
        own = profile.select("row_id", "chain").join(around, "row_id")
        ratio = F.when(F.col("around") > 0, F.col("chain") / F.nullif(F.col("around"), F.lit(0.0))).otherwise(1.0)
        own = materialize(own.select("row_id", ratio.alias("score")), "cof-scores")
        return FittedConnectivity(self.k, profile, own)


@register
class FittedConnectivity(FittedDetector):
    costly = True

    def __init__(self, k, profile, own=None):
        self.k, self.profile, self.own = k, profile, own

    def train_scores(self, train):
        return train.join(self.own, "row_id")

    def score(self, df, out="score"):
        keep = df.columns
        joined = neighbour_vectors(knn_join(df, self.profile, self.k, carry=["features", "chain"]))
        own = _pairwise_udf(chaining_distance)(F.col("features").cast("array<double>"), F.col("__near"))
        around = V.array_total(F.transform("nn", lambda e: e["chain"])) / F.size("nn").cast("double")
        joined = joined.withColumn("__own", own).withColumn("__around", around)
        ratio = F.when(F.col("__around") > 0, F.col("__own") / F.nullif(F.col("__around"), F.lit(0.0))).otherwise(1.0)
        return joined.withColumn(out, ratio).select(*keep, out)

    def params(self):
        return {"k": self.k}

    def frames(self):
        return {"profile": self.profile, "own": self.own}


# --- D9, D12, D13: random ensembles ---------------------------------------------------------


def hash_sample(train: DataFrame, rows: int, seed: int) -> np.ndarray:
    """A reproducible sample of a fixed, small number of rows, in hash order."""
    order = F.xxhash64(F.col("row_id"), F.lit(seed))
    picked = train.select("row_id", F.col("features").cast("array<double>").alias("f"))
    table = picked.orderBy(order, "row_id").limit(rows).collect()
    return np.array([r.f for r in table], float)


class IsolatingSpheres(Detector):
    """INNE: spheres around a few sampled points, sized by their nearest sampled neighbour."""

    name = "INNE"

    def __init__(self, contamination=None, members: int = 200, sample: int = 8, seed: int = 7):
        super().__init__(contamination)
        self.members, self.sample, self.seed = members, sample, seed

    def learn(self, train):
        pool = hash_sample(train, self.members * self.sample, self.seed)
        check_values(pool.size, "sphere centres")
        rng = np.random.default_rng(self.seed)
        size = min(self.sample, len(pool))
        if len(pool) >= self.members * size:
            groups = rng.permutation(len(pool))[: self.members * size].reshape(self.members, size)
        else:
            groups = np.array([rng.choice(len(pool), size, replace=False) for _ in range(self.members)])
        centers = pool[groups]
        gaps = np.sqrt(((centers[:, :, None, :] - centers[:, None, :, :]) ** 2).sum(axis=3))
        gaps[:, np.arange(size), np.arange(size)] = np.inf
        near = gaps.argmin(axis=2)
        radius = gaps.min(axis=2)
        neighbour = np.take_along_axis(radius, near, axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(radius > 0, 1.0 - neighbour / radius, 0.0)
        return FittedSpheres(centers, radius, ratio)


@register
class FittedSpheres(FittedDetector):
    def __init__(self, centers, radius, ratio):
        self.centers, self.radius, self.ratio = np.array(centers), np.array(radius), np.array(ratio)

    def score(self, df, out="score"):
        centers, radius, ratio = self.centers, self.radius, self.ratio

        def fn(x):
            total = np.zeros(len(x))
            for c, r, q in zip(centers, radius, ratio):
                gaps = np.sqrt(((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2))
                covered = np.where(gaps <= r, r, np.inf)
                best = covered.argmin(axis=1)
                total += np.where(np.isfinite(covered.min(axis=1)), q[best], 1.0)
            return total / len(centers)

        return _vector_score(df, fn, out)

    def params(self):
        return {"centers": self.centers, "radius": self.radius, "ratio": self.ratio}


def average_path(n) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of n points."""
    n = np.asarray(n, float)
    deep = 2.0 * (np.log(np.maximum(n - 1.0, 1.0)) + np.euler_gamma) - 2.0 * (n - 1.0) / np.maximum(n, 1.0)
    return np.where(n > 2, deep, np.where(n == 2, 1.0, 0.0))


def grow_tree(x: np.ndarray, rng: np.random.Generator, depth: int) -> dict:
    """One isolation tree as parallel lists; leaves have feature -1 and their path length."""
    tree = {"feature": [], "cut": [], "left": [], "right": [], "depth": []}

    def node(rows, level):
        at = len(tree["feature"])
        for key, value in (("feature", -1), ("cut", 0.0), ("left", -1), ("right", -1)):
            tree[key].append(value)
        tree["depth"].append(float(level + average_path(len(rows))))
        spread = x[rows].max(axis=0) - x[rows].min(axis=0) if len(rows) else np.zeros(x.shape[1])
        open_features = np.nonzero(spread > 0)[0]
        if level >= depth or len(rows) <= 1 or len(open_features) == 0:
            return at
        j = int(rng.choice(open_features))
        cut = float(rng.uniform(x[rows, j].min(), x[rows, j].max()))
        go = x[rows, j] < cut
        tree["feature"][at], tree["cut"][at] = j, cut
        tree["left"][at] = node(rows[go], level + 1)
        tree["right"][at] = node(rows[~go], level + 1)
        return at

    node(np.arange(len(x)), 0)
    return tree


class IsolationForest(Detector):
    """Trees are grown on the executors, one small hash sample per tree."""

    name = "IForest"

    def __init__(self, contamination=None, trees: int = 10, sample: int = 256, seed: int = 7):
        super().__init__(contamination)
        self.trees, self.sample, self.seed = trees, sample, seed
        self.name = f"IForest{trees}"

    def learn(self, train):
        rows = train.count()
        sample, trees, seed = min(self.sample, rows), self.trees, self.seed
        # the share kept is twice what is needed; the rank then cuts it to the exact size
        share = min(1.0, 2.0 * sample / rows + 64.0 / rows)
        member = F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
        base = train.select("row_id", F.col("features").cast("array<double>").alias("features"))
        marked = base.withColumn("tree", member).withColumn(
            "__u", F.xxhash64("row_id", "tree", F.lit(seed)).cast("double") / F.lit(2.0**64) + F.lit(0.5)
        )
        rank = F.row_number().over(Window.partitionBy("tree").orderBy("__u", "row_id"))
        picked = marked.filter(F.col("__u") <= share).withColumn("__r", rank).filter(F.col("__r") <= sample)
        depth = int(math.ceil(math.log2(max(sample, 2))))

        def grow(key, pdf):
            import pandas as pd

            pdf = pdf.sort_values("row_id")
            rng = np.random.default_rng([seed, int(key[0])])
            tree = grow_tree(np.array(pdf["features"].tolist(), float), rng, depth)
            return pd.DataFrame({"tree": [int(key[0])], "body": [json.dumps(tree)]})

        grown = picked.select("tree", "row_id", "features").groupBy("tree").applyInPandas(grow, "tree int, body string")
        found = bounded_collect(grown, limit=trees, what="trees")
        forest = [json.loads(r.body) for r in sorted(found, key=lambda r: r.tree)]
        return FittedForest(forest, sample)


@register
class FittedForest(FittedDetector):
    def __init__(self, forest, sample):
        self.forest, self.sample = forest, sample

    def score(self, df, out="score"):
        forest = [{k: np.array(v) for k, v in tree.items()} for tree in self.forest]
        norm = float(max(average_path(self.sample), 1e-12))

        def fn(x):
            total = np.zeros(len(x))
            rows = np.arange(len(x))
            for tree in forest:
                at = np.zeros(len(x), int)
                while True:
                    feature = tree["feature"][at]
                    inner = feature >= 0
                    if not inner.any():
                        break
                    below = x[rows, np.maximum(feature, 0)] < tree["cut"][at]
                    step = np.where(below, tree["left"][at], tree["right"][at])
                    at = np.where(inner, step, at)
                total += tree["depth"][at]
            return 2.0 ** (-total / len(forest) / norm)

        return _vector_score(df, fn, out)

    def params(self):
        return {"forest": self.forest, "sample": self.sample}


class RandomProjections(Detector):
    """LODA: histograms of sparse random projections."""

    name = "LODA"

    def __init__(self, contamination=None, bins: int = 100, cuts: int = 100, seed: int = 7):
        super().__init__(contamination)
        self.bins, self.cuts, self.seed = bins, cuts, seed

    def learn(self, train):
        d = V.width_of(train, "features")
        rng = np.random.default_rng(self.seed)
        weights = np.zeros((self.cuts, d))
        for row in weights:
            picked = rng.permutation(d)[: max(1, int(math.sqrt(d)))]
            row[picked] = rng.standard_normal(len(picked))
        low = task_partials(train, lambda x: (x @ weights.T).min(axis=0), self.cuts, "min")
        high = task_partials(train, lambda x: (x @ weights.T).max(axis=0), self.cuts, "max")
        step = np.where(high > low, (high - low) / self.bins, 1.0)
        bins, cuts = self.bins, self.cuts

        def count(x):
            cell = np.clip(np.floor((x @ weights.T - low) / step), 0, bins - 1).astype(int)
            flat = (np.arange(cuts)[None, :] * bins + cell).ravel()
            return np.bincount(flat, minlength=cuts * bins)

        counts = task_partials(train, count, cuts * bins, "sum").reshape(cuts, bins)
        share = (counts + 1e-12) / (counts + 1e-12).sum(axis=1, keepdims=True)
        return FittedProjections(weights, low, step, -np.log(share))


@register
class FittedProjections(FittedDetector):
    def __init__(self, weights, low, step, table):
        self.weights, self.low_edge, self.step = np.array(weights), np.array(low), np.array(step)
        self.table = np.array(table)

    def score(self, df, out="score"):
        weights, low, step, table = self.weights, self.low_edge, self.step, self.table
        cuts, bins = table.shape

        def fn(x):
            cell = np.clip(np.floor((x @ weights.T - low) / step), 0, bins - 1).astype(int)
            return table[np.arange(cuts)[None, :], cell].mean(axis=1)

        return _vector_score(df, fn, out)

    def params(self):
        return {"weights": self.weights, "low": self.low_edge, "step": self.step, "table": self.table}


def make_detector(name: str, contamination: float | None = None, **options) -> Detector:
    short = canonical(name)
    if short in ("COPOD", "ECOD"):
        return TailDetector(short, contamination)
    kinds = {
        "HBOS": HistogramDetector, "MCD": RobustCovariance, "PCA": PrincipalComponents,
        "CBLOF": ClusterDetector, "uKNN": NeighbourDistance, "LOF": LocalOutlierFactor,
        "INNE": IsolatingSpheres, "FastABOD": AngleDetector, "COF": ConnectivityDetector,
        "IForest": IsolationForest, "LODA": RandomProjections,
    }
    return kinds[short](contamination, **options)

