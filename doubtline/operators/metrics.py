"""Quality of predictions, of rejections and of error detectors, as grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doubtline.functions.vectors import lit_vector
from doubtline.operators.stats import running_totals


def _ratio(top: Column, bottom: Column) -> Column:
    """0 where the denominator is 0."""
    return F.when(bottom != 0, top / F.nullif(bottom, F.lit(0))).otherwise(F.lit(0.0))


def omission_sums(label: str, pred: str, wrapped: str) -> list[Column]:
    right = F.col(label) == F.col(pred)
    rejected = F.col(wrapped).isNull()

    def count(flag: Column) -> Column:
        return F.sum(F.when(flag, 1).otherwise(0))

    return [
        F.count(F.lit(1)).alias("n"),
        count(right).alias("right"),
        count(rejected).alias("rejected"),
        count(F.col(wrapped) == F.col(label)).alias("kept_right"),
        count(rejected & right).alias("rejected_right"),
        count(rejected & ~right).alias("rejected_wrong"),
    ]


def omission_ratios(sums: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """From raw counts to the ten rates. Separate, so that counts can be merged first."""
    n = F.col("n").cast("double")
    rates = sums.select(
        *keys,
        "n",
        _ratio(F.col("right").cast("double"), n).alias("alpha"),
        _ratio(F.col("rejected").cast("double"), n).alias("phi"),
        _ratio(F.col("kept_right").cast("double"), n).alias("alpha_w"),
        _ratio(F.col("rejected_right").cast("double"), n).alias("phi_c"),
        _ratio(F.col("rejected_wrong").cast("double"), n).alias("phi_m"),
        # wrong before, wrong after: counted, so that they are exact zeros when they are zero
        _ratio((F.col("n") - F.col("right")).cast("double"), n).alias("eps"),
        _ratio((F.col("n") - F.col("kept_right") - F.col("rejected")).cast("double"), n).alias("eps_w"),
    )
    rates = rates.withColumn("eps_gain", _ratio(F.col("eps") - F.col("eps_w"), F.col("eps")))
    rates = rates.withColumn("phi_m_ratio", _ratio(F.col("phi_m"), F.col("phi")))
    both = F.col("eps_gain") + F.col("phi_m_ratio")
    rates = rates.withColumn("overall", _ratio(2 * F.col("eps_gain") * F.col("phi_m_ratio"), both))
    return rates.select(
        *keys, "alpha", "eps", "phi", "alpha_w", "eps_w", "phi_c", "phi_m", "eps_gain", "phi_m_ratio", "overall"
    )


def omission_metrics(
    df: DataFrame,
    label: str = "label",
    pred: str = "pred",
    wrapped: str = "wrapped_pred",
    by: Sequence[str] = (),
) -> DataFrame:
    """Accuracy, residual error and rejection rates before and after rejecting."""
    return omission_ratios(df.groupBy(*by).agg(*omission_sums(label, pred, wrapped)), by)


def confusion(df: DataFrame, label: str = "label", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """Two-class confusion counts; 1 is the positive class."""

    def count(actual: int, predicted: int) -> Column:
        return F.sum(((F.col(label) == actual) & (F.col(pred) == predicted)).cast("long"))

    return df.groupBy(*by).agg(
        count(1, 1).alias("tp"), count(0, 0).alias("tn"), count(0, 1).alias("fp"), count(1, 0).alias("fn")
    )


def detection_scores(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, MCC and the AUC of hard predictions, from confusion counts."""
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    spread = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    recall, specificity = _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    return counts.select(
        "*",
        _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        recall.alias("recall"),
        _ratio(tp * tn - fp * fn, spread).alias("mcc"),
        ((recall + specificity) / 2).alias("auc_hard"),
    )


def detection_metrics(df: DataFrame, label: str = "label", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    return detection_scores(confusion(df, label, pred, by))


def accuracy_by(df: DataFrame, key: str, wrong: str = "is_misclassification") -> DataFrame:
    return df.groupBy(key).agg((F.lit(1.0) - F.avg(F.col(wrong))).alias("accuracy"))


def error_rate(df: DataFrame, wrong: str = "label") -> DataFrame:
    """Share of errors, and the same clamped to a half, as detectors expect it."""
    rate = F.avg(F.col(wrong).cast("double"))
    return df.agg(rate.alias("error_rate"), F.least(rate, F.lit(0.5)).alias("contamination"))


def split_summary(df: DataFrame, label: str, by: Sequence[str] = (), normal=0) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("items"),
        F.countDistinct(label).alias("labels"),
        F.sum((F.col(label) != normal).cast("long")).alias("anomalies"),
    )


def roc_curve(df: DataFrame, score: str, label: str = "label") -> DataFrame:
    """One point per distinct score, from the highest down: ``score, tp, fp, tpr, fpr``."""
    counts = df.select(
        F.col(score).cast("double").alias("score"),
        (F.col(label) == 1).cast("long").alias("tp"),
        (F.col(label) == 0).cast("long").alias("fp"),
    )
    whole = counts.agg(F.sum("tp").alias("p"), F.sum("fp").alias("n")).first()
    curve = running_totals(counts, "score", ["tp", "fp"], descending=True)
    return curve.select(
        "score",
        F.col("cum_tp").alias("tp"),
        F.col("cum_fp").alias("fp"),
        (F.col("cum_tp") / F.lit(float(whole.p or 1))).alias("tpr"),
        (F.col("cum_fp") / F.lit(float(whole.n or 1))).alias("fpr"),
    )


def roc_area(df: DataFrame, score: str, label: str = "label") -> DataFrame:
    """Area under the ROC curve = P(score of a positive > score of a negative), ties half."""
    counts = df.select(
        F.col(score).cast("double").alias("score"),
        (F.col(label) == 1).cast("long").alias("pos"),
        (F.col(label) == 0).cast("long").alias("neg"),
    )
    below = running_totals(counts, "score", ["pos", "neg"])
    wins = F.col("pos").cast("double") * ((F.col("cum_neg") - F.col("neg")) + F.col("neg") / F.lit(2.0))
    out = below.agg(F.sum(wins).alias("w"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return out.select(_ratio(F.col("w"), F.col("p").cast("double") * F.col("n")).alias("auc"))


def threshold_judge(um: str, threshold: float) -> Column:
    """1 (reject) where the measure is below the threshold."""
    return F.when(F.col(um) < F.lit(float(threshold)), 1).otherwise(0)


def risk_curve(
    df: DataFrame,
    um: str,
    thresholds: Sequence[float],
    label: str = "label",
    pred: str = "pred",
    by: Sequence[str] = (),
) -> DataFrame:
    """Omission metrics for every rejection threshold, in one pass.

    A row is rejected by all thresholds above its measure. Rows are therefore counted once, by
    the number of thresholds not above them, and the few counts are summed up afterwards.
    """
    cuts = sorted(float(t) for t in thresholds)
    right = (F.col(label) == F.col(pred)).cast("long")
    level = F.size(F.filter(lit_vector(cuts), lambda t: t <= F.col(um)))
    cells = df.groupBy(*by, level.alias("level")).agg(
        F.count(F.lit(1)).alias("c"), F.sum(right).alias("r")
    )
    # spread each cell over the thresholds; cells are at most (thresholds + 1) per group
    table = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("threshold")) for i, t in enumerate(cuts)])
    spread = cells.select(*by, "level", "c", "r", F.explode(table).alias("t"))
    out = F.col("t.i") >= F.col("level")
    sums = spread.groupBy(*by, F.col("t.threshold").alias("threshold")).agg(
        F.sum("c").alias("n"),
        F.sum("r").alias("right"),
        F.sum(F.when(out, F.col("c")).otherwise(0)).alias("rejected"),
        F.sum(F.when(out, 0).otherwise(F.col("r"))).alias("kept_right"),
        F.sum(F.when(out, F.col("r")).otherwise(0)).alias("rejected_right"),
        F.sum(F.when(out, F.col("c") - F.col("r")).otherwise(0)).alias("rejected_wrong"),
    )
    return omission_ratios(sums, [*by, "threshold"])


def best_candidate(candidates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Highest MCC, the earliest candidate on ties."""
    order = [F.col("mcc").desc(), F.col("candidate").asc()]
    if not by:
        return candidates.orderBy(*order).limit(1)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return candidates.withColumn("__r", rank).filter(F.col("__r") == 1).drop("__r")
