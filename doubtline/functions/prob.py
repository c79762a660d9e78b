"""Expressions over class-probability vectors."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doubtline.functions.vectors import UNROLL_LIMIT, array_total, at, sum_text, vector


def _column(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def argmax(prob) -> Column:
    """Position of the largest entry, the first one on ties."""
    prob = _column(prob)
    return (F.array_position(prob, F.array_max(prob)) - F.lit(1)).cast("int")


def confidence(prob) -> Column:
    return F.array_max(_column(prob))


def max_entropy(classes: int) -> float:
    return math.log2(classes)


def entropy_bits(prob, width: int | None = None) -> Column:
    """Shannon entropy over the non-zero entries, renormalised to sum 1."""
    if isinstance(prob, str) and width is not None and width <= UNROLL_LIMIT:
        cells = [at(prob, i) for i in range(width)]
        mass = sum_text(cells)
        parts = [f"CASE WHEN {p} != 0D THEN -({p} / {mass}) * log2({p} / {mass}) ELSE 0D END" for p in cells]
        return F.expr(f"CASE WHEN {mass} != 0D THEN {sum_text(parts)} END")
    prob = _column(prob)
    mass = array_total(prob)
    kept = F.filter(prob, lambda p: p != 0.0)
    bits = F.transform(kept, lambda p: -(p / mass) * F.log2(p / mass))
    return F.when(mass != 0.0, array_total(bits))


def certainty(prob, classes: int, width: int | None = None) -> Column:
    """1 for a one-hot vector, 0 for a flat vector of ``classes`` entries."""
    top = max_entropy(classes)
    return (F.lit(top) - entropy_bits(prob, width)) / F.lit(top)


def signed_mean(own, other, agree) -> Column:
    """Mean certainty of two models, negative where their predictions differ."""
    mean = (_column(own) + _column(other)) / F.lit(2.0)
    return F.when(agree, mean).otherwise(-mean)


def vote_share(votes) -> Column:
    """Share of the votes that equal the most frequent vote; ``votes`` may be a list of few columns, which are compared one by one."""
    if isinstance(votes, list):
        if not 2 <= len(votes) <= UNROLL_LIMIT:
            return vote_share(F.array(*votes))
        counts = [sum((F.when(v == x, 1).otherwise(0) for x in votes), F.lit(0)) for v in votes]
        return F.greatest(*counts) / F.lit(float(len(votes)))
    votes = _column(votes)
    counts = F.transform(
        F.array_distinct(votes), lambda v: F.size(F.filter(votes, lambda x: x == v))
    )
    return F.array_max(counts) / F.size(votes).cast("double")


def modal_vote(votes) -> Column:
    """The most frequent vote, the smallest one on ties."""
    votes = _column(votes)
    ranked = F.transform(
        F.array_distinct(votes),
        lambda v: F.struct(F.size(F.filter(votes, lambda x: x == v)).alias("n"), (-v).alias("negative")),
    )
    return -F.array_max(ranked)["negative"]


def paired_probability(prob, pred) -> Column:
    """Two-class probabilities with the larger one given to the predicted class."""
    prob = _column(prob)
    high, low = F.array_max(prob), F.array_min(prob)
    return F.when(_column(pred) == 0, F.array(high, low)).otherwise(F.array(low, high))


def softmax(df: DataFrame, scores: Sequence[str], name: str = "prob") -> DataFrame:
    """Log scores (SQL text, one per class) to a probability vector column."""
    k = len(scores)
    s, e = f"__{name}_s", f"__{name}_e"
    df = df.withColumn(s, F.expr(f"array({', '.join(scores)})"))
    df = df.withColumn(e, F.expr("array(" + ", ".join(f"exp({at(s, i)} - array_max({s}))" for i in range(k)) + ")"))
    mass = sum_text([at(e, i) for i in range(k)])
    prob = F.expr("array(" + ", ".join(f"{at(e, i)} / {mass}" for i in range(k)) + ")")
    return df.withColumn(name, vector(prob, k, name)).drop(s, e)
