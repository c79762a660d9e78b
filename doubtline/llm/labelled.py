"""Labelled documents to learn from: which rows may be learned, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doubtline.llm.common import id_and_text, least_by_hash
from doubtline.session import materialize


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text modulo ``parts``; null for a null id."""
    return (F.crc32(doc_id.cast("long").cast("string")) % parts).cast("int")


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.coalesce(remainder(doc_id, parts) == part, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, part: int, most: int, seed: str) -> DataFrame:
    """``doc_id, text, label`` of at most ``most`` labelled documents outside the held-out part.

    The labels are few and bounded before the join, by the least hashes of their ids, so the documents are filtered by a
    broadcast of at most ``most`` small rows and no text is shuffled. Null ids and labels other than 0 and 1 teach nothing;
    of repeated labels of one document the larger counts. Repeated documents are all taken, unless there are then more than
    ``most`` rows: of those, the rows of the least hashes of id and text. The sample is written to the shared folder once.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"), parts, part))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = least_by_hash(known, most, F.col("doc_id"), seed=seed)
    taken = materialize(id_and_text(docs, null_text="").join(F.broadcast(chosen), "doc_id"), "training_rows")
    if taken.count() <= most:
        return taken
    return materialize(least_by_hash(taken, most, F.col("doc_id"), F.col("text"), seed=seed), "training_rows")
