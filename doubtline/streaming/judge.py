"""Judge a stream of feature rows, and watch the quality of the judging over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doubtline.operators.metrics import omission_ratios, omission_sums
from doubtline.plans.monitor import Monitor


def row_local(monitor: Monitor) -> bool:
    """Can every measure be computed from the row alone?"""
    checkers = [c for f in monitor.fitted for c in f.models().values()]
    shuffles = any(f.neighbours or f.copies for f in monitor.fitted)
    return not shuffles and not any(getattr(c, "costly", False) for c in checkers)


def judge_stream(stream: DataFrame, monitor: Monitor) -> DataFrame:
    """The batch plan on a stream: score, measure, judge, reject; no state is kept.

    Detector probabilities use the extremes of the training rows, since a stream has no batch.
    """
    if not row_local(monitor):
        raise ValueError("neighbour, stability and rank measures need judge_batches")
    scored = monitor.scorer.transform(stream)
    if monitor.adjudicator is None:
        return monitor.measure(scored, bounds="train")
    return monitor.judge(scored, bounds="train")


def judge_batches(stream: DataFrame, monitor: Monitor, path: str, checkpoint: str, trigger: dict | None = None):
    """Judge micro-batch by micro-batch with the batch plan, for measures that shuffle.

    A batch is written under its own id with overwrite, so a repeated batch replaces itself.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        scored = monitor.scorer.transform(batch)
        # the extremes of training, so a row's verdict doesn't depend on the rows it comes with
        judge = monitor.measure if monitor.adjudicator is None else monitor.judge
        judged = judge(scored, bounds="train")
        judged.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def windowed_omission(
    judged: DataFrame,
    time: str,
    window: str = "1 day",
    late: str = "1 hour",
    slide: str | None = None,
    label: str = "label",
    pred: str = "pred",
    wrapped: str = "wrapped_pred",
) -> DataFrame:
    """Omission metrics per event-time window. Rows later than the watermark are dropped.

    The stream keeps six counters per window; the rates are a projection of them.
    """
    span = F.window(time, window, slide) if slide else F.window(time, window)
    if judged.isStreaming:
        judged = judged.withWatermark(time, late)
    sums = judged.groupBy(span.alias("w")).agg(*omission_sums(label, pred, wrapped))
    flat = sums.select(
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        "n", "right", "rejected", "kept_right", "rejected_right", "rejected_wrong",
    )
    return omission_ratios(flat, ["window_start", "window_end"])


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything available into a table, and read the table."""
    query = (
        df.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)
