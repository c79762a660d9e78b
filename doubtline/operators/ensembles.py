"""Ensembles over any base model: feature bags, confidence bagging, confidence boosting."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doubtline.functions import vectors as V
from doubtline.functions.hashing import md5_uniform
from doubtline.functions.prob import argmax, confidence
from doubtline.operators.models import Fitted, Model, add_pred, class_count, load_fitted, register, run_parallel
from doubtline.operators.sampling import feature_subsets, slice_features
from doubtline.operators.stats import column_quantile
from doubtline.session import materialize


def score_on(df: DataFrame, fitted: Fitted, subset: list[int] | None, prob: str, pred: str) -> DataFrame:
    """Score on a feature subset; the row keeps its full vector."""
    if subset is None:
        return fitted.transform(df, prob, pred)
    width = V.width_of(df, "features")
    kept = f"__{prob}_all"
    df = slice_features(df.withColumn(kept, V.vector(F.col("features"), width, kept)), subset)
    df = fitted.transform(df, prob, pred)
    return df.withColumn("features", V.vector(F.col(kept), width, "features")).drop(kept)


class Members(Fitted):
    """Fitted members with their feature subsets."""

    def __init__(self, name: str, classes: int, subsets: list, members: list[Fitted] | None = None):
        self.name, self.classes, self.subsets, self.members = name, classes, subsets, members or []

    @property
    def row_local(self) -> bool:
        return all(m.row_local for m in self.members)

    def extra(self) -> dict:
        return {}

    def state(self):
        return {"name": self.name, "classes": self.classes, "subsets": self.subsets, **self.extra()}

    def save(self, spark: SparkSession, path: str) -> None:
        super().save(spark, path)
        for i, member in enumerate(self.members):
            member.save(spark, os.path.join(path, f"member-{i}"))

    def load_members(self, spark: SparkSession, path: str) -> None:
        self.members = [load_fitted(spark, os.path.join(path, f"member-{i}")) for i in range(len(self.subsets))]

    @classmethod
    def restore(cls, state, ml, frames):
        return cls(**state)

    def member_columns(self, df: DataFrame, tag: str) -> tuple[DataFrame, list[tuple[str, str]]]:
        names = []
        for i, (member, subset) in enumerate(zip(self.members, self.subsets)):
            prob, pred = f"__{tag}{i}_prob", f"__{tag}{i}_pred"
            df = score_on(df, member, subset, prob, pred)
            names.append((prob, pred))
        return df, names


class FeatureBags(Model):
    """Members on random feature subsets; the probability of a class is its share of the votes."""

    def __init__(self, base: Model, members: int = 10, seed: int = 0):
        self.base, self.members, self.seed = base, members, seed
        self.name = f"Bags{members}-{base.name}"

    def fit(self, train: DataFrame) -> FittedFeatureBags:
        d = V.width_of(train, "features")
        subsets = feature_subsets(d, self.members, seed=self.seed)
        classes = 2 if self.base.is_detector else max(2, class_count(train))
        # members of equal subsets are one and the same model
        own = list(dict.fromkeys(map(tuple, subsets)))
        found = dict(zip(own, run_parallel([lambda s=s: self.base.fit(slice_features(train, list(s))) for s in own])))
        return FittedFeatureBags(self.name, classes, subsets, [found[tuple(s)] for s in subsets])


@register
class FittedFeatureBags(Members):
    def member_columns(self, df, tag):
        """Members of equal subsets score once; each has its vote."""
        names: dict[tuple, tuple[str, str]] = {}
        for member, subset in zip(self.members, self.subsets):
            if tuple(subset) not in names:
                prob, pred = names[tuple(subset)] = f"__{tag}{len(names)}_prob", f"__{tag}{len(names)}_pred"
                df = score_on(df, member, subset, prob, pred)
        return df, [names[tuple(s)] for s in self.subsets]

    def transform(self, df, prob="prob", pred="pred"):
        df, names = self.member_columns(df, f"{prob}_b")
        votes = F.array(*[F.col(p) for _, p in names])
        share = [
            F.size(F.filter(votes, lambda v: v == c)).cast("double") / F.lit(float(len(names)))
            for c in range(self.classes)
        ]
        df = df.withColumn(prob, V.vector(F.array(*share), self.classes, prob))
        return add_pred(df, prob, pred).drop(*[n for pair in names for n in pair])


class ConfidenceBagging(Model):
    """Members on feature subsets and row samples; the most confident members decide."""

    def __init__(
        self,
        base: Model,
        members: int = 10,
        max_features: float = 0.7,
        sampling_ratio: float = 0.7,
        decisors: int | None = None,
        decisor_share: float | None = None,
        seed: int = 0,
    ):
        self.base, self.members, self.seed = base, members, seed
        self.max_features, self.sampling_ratio = max_features, sampling_ratio
        if decisors is None:
            decisors = int(members * decisor_share) if decisor_share else members // 2 + 1
        self.decisors = max(1, min(decisors, members))
        self.name = f"ConfidenceBagger({members}-{self.decisors}-{max_features}-{sampling_ratio})"

    def fit(self, train: DataFrame) -> FittedConfidenceBagging:
        d = V.width_of(train, "features")
        subsets = feature_subsets(d, self.members, self.max_features, self.seed)
        classes = 2 if self.base.is_detector else max(2, class_count(train))

        def one(i: int, subset: list[int]):
            def job():
                rows = train.filter(md5_uniform(self.seed, i, F.col("row_id")) < self.sampling_ratio)
                return self.base.fit(slice_features(rows, subset))

            return job

        members = run_parallel([one(i, s) for i, s in enumerate(subsets)])
        return FittedConfidenceBagging(self.name, classes, subsets, members, self.decisors)


@register
class FittedConfidenceBagging(Members):
    def __init__(self, name, classes, subsets, members=None, decisors=1):
        super().__init__(name, classes, subsets, members)
        self.decisors = decisors

    def extra(self):
        return {"decisors": self.decisors}

    def transform(self, df, prob="prob", pred="pred"):
        df, names = self.member_columns(df, f"{prob}_c")
        cells = [
            F.struct(confidence(p).alias("conf"), F.lit(-i).alias("no"), F.col(p).alias("prob"))
            for i, (p, _) in enumerate(names)
        ]
        best = F.slice(F.sort_array(F.array(*cells), asc=False), 1, self.decisors)
        df = df.withColumn(f"__{prob}_best", best)
        mean = [
            V.array_total(F.transform(f"__{prob}_best", lambda s: F.get(s["prob"], F.lit(c))))
            / F.lit(float(self.decisors))
            for c in range(self.classes)
        ]
        df = df.withColumn(prob, V.vector(F.array(*mean), self.classes, prob))
        return add_pred(df, prob, pred).drop(f"__{prob}_best", *[n for pair in names for n in pair])


class ConfidenceBoosting(Model):
    """Members fitted in turn; rows on which a member is unsure are drawn more often by the next.

    The row weights are written to the shared folder after every member, which keeps the plan of
    the next fit flat and survives lost executors.
    """

    def __init__(
        self,
        base: Model,
        members: int = 10,
        learning_rate: float | None = None,
        sampling_ratio: float = 0.5,
        contamination: float | None = None,
        conf_thr: float = 0.8,
        seed: int = 0,
    ):
        self.base, self.members, self.seed = base, members, seed
        self.learning_rate = 2.0 if learning_rate is None else learning_rate
        self.sampling_ratio, self.contamination, self.conf_thr = sampling_ratio, contamination, conf_thr
        self.name = f"ConfidenceBooster({members}-{conf_thr}-{self.learning_rate}-{sampling_ratio})"

    def threshold(self, scored: DataFrame) -> float:
        """The confidence below which a row counts as unsure: fixed, or such that ``contamination`` of the rows are."""
        if not self.contamination:
            return self.conf_thr
        return column_quantile(scored.select(confidence("__p").alias("c")), "c", self.contamination)

    def fit(self, train: DataFrame) -> FittedConfidenceBoosting:
        classes = 2 if self.base.is_detector else max(2, class_count(train))
        keep = [c for c in ("row_id", "features", "label") if c in train.columns]
        rows = train.select(*keep).withColumn("__w", F.lit(1.0))
        members = []
        for i in range(self.members):
            mean = rows.agg(F.avg("__w").alias("m")).first().m or 1.0
            share = F.least(F.lit(1.0), F.col("__w") * F.lit(self.sampling_ratio / mean))
            drawn = rows.filter(md5_uniform(self.seed, i, F.col("row_id")) < share)
            member = self.base.fit(drawn.drop("__w"))
            members.append(member)
            if i + 1 < self.members:
                scored = member.transform(rows, "__p", "__y")
                unsure = confidence("__p") < F.lit(self.threshold(scored))
                weight = F.when(unsure, F.col("__w") * F.lit(self.learning_rate)).otherwise(F.col("__w"))
                rows = materialize(scored.select(*keep, weight.alias("__w")), "boost-weights")
        return FittedConfidenceBoosting(self.name, classes, [None] * len(members), members)


@register
class FittedConfidenceBoosting(Members):
    """Mean of the members' probabilities, each weighted by its confidence in the row."""

    def transform(self, df, prob="prob", pred="pred"):
        df, names = self.member_columns(df, f"{prob}_o")
        weights = [confidence(p) for p, _ in names]
        mass = V.total(weights)
        mean = [
            V.total([w * V.item(p, c) for w, (p, _) in zip(weights, names)]) / mass for c in range(self.classes)
        ]
        df = df.withColumn(prob, V.vector(F.array(*mean), self.classes, prob))
        return df.withColumn(pred, argmax(prob)).drop(*[n for pair in names for n in pair])
