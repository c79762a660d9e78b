"""Quality classifier: averaged vectors of hashed words and character n-grams, softmax, stochastic gradient descent."""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doubtline.llm.common import frame_batch, id_and_text, map_batches
from doubtline.llm.labelled import held_out, training_sample

#: Labelled documents that are learned from at most (the bound of the training sample).
TRAIN_DOCS = 3000
#: Rows that predict label 1 have this score at least.
ACCEPT = 0.7
PARTS, HELD_OUT = 4, 2
#: Words a Python worker remembers before it starts anew, and the longest word it remembers.
CACHE_WORDS, CACHE_BYTES = 400_000, 48


@dataclass(frozen=True)
class Shape:
    """Size and training of the model."""

    bits: int = 17
    dim: int = 8
    grams: tuple[int, ...] = (3, 4)
    epochs: int = 8
    rate: float = 0.3
    seed: int = 11


def subword_ids(word: bytes, shape: Shape) -> list[int]:
    """The vector of a word itself and those of its character n-grams, with marks for its start and end.

    N-grams are taken of bytes; a letter of several bytes is covered by those that hold it.
    """
    mask, crc = (1 << shape.bits) - 1, zlib.crc32
    marked = b"<" + word + b">"
    ids = [crc(word, 7) & mask]
    for n in shape.grams:
        ids += [crc(marked[i : i + n], n) & mask for i in range(len(marked) - n + 1)]
    return ids


#: Words that stand for a repeat, as no word of a text holds a null byte next to white space: the word before once more, and
#: three words in a row that came earlier in the text.
SAME, AGAIN = b"\x00same", b"\x00again"


def repeats(words: list[bytes]) -> tuple[int, int]:
    """How often ``SAME`` and ``AGAIN`` hold in a text."""
    same = sum(map(eq, words, words[1:]))
    return same, max(0, len(words) - 2) - len(set(zip(words, words[1:], words[2:])))


def features(text: str, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids of a text and their shares of all."""
    words = text.encode().split()
    counts = Counter(words)
    counts += Counter(dict(zip((SAME, AGAIN), repeats(words), strict=True)))
    if not counts:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    lists = [subword_ids(w, shape) for w in counts]
    ids = np.fromiter((i for x in lists for i in x), np.int64)
    weight = np.repeat(np.fromiter(counts.values(), np.float64, len(counts)), [len(x) for x in lists])
    found, where = np.unique(ids, return_inverse=True)
    share = np.bincount(where, weights=weight)
    return found.astype(np.int32), (share / share.sum()).astype(np.float32)


@dataclass
class SubwordModel:
    """Vectors by hashed feature, and the softmax layer over the two labels."""

    shape: Shape
    vectors: np.ndarray
    layer: np.ndarray
    bias: np.ndarray

    def weights(self) -> tuple[np.ndarray, float]:
        """What each feature adds to the log odds of label 1, as the average and the layer are linear; and the rest."""
        return (self.vectors @ (self.layer[:, 1] - self.layer[:, 0])).astype(np.float32), float(self.bias[1] - self.bias[0])


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], shape: Shape) -> SubwordModel:
    """Stochastic gradient descent, one document at a time, with a rate that falls to 0."""
    rng = np.random.default_rng(shape.seed)
    vectors = ((rng.random((1 << shape.bits, shape.dim)) - 0.5) / shape.dim).astype(np.float32)
    layer, bias = np.zeros((shape.dim, 2), np.float32), np.zeros(2, np.float32)
    share = np.array([1.0 + sum(1 for r in rows if r[2] == y) for y in (0, 1)])
    bias += np.log(share / share.sum()).astype(np.float32)
    steps, done = max(1, shape.epochs * len(rows)), 0
    for _ in range(shape.epochs):
        for at in rng.permutation(len(rows)):
            ids, share_of, label = rows[at]
            rate = np.float32(shape.rate * (1 - done / steps))
            done += 1
            if not len(ids):
                continue
            own = vectors[ids]
            mean = share_of @ own
            logit = mean @ layer + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[label] -= 1
            back = layer @ p
            layer -= rate * np.outer(mean, p)
            bias -= np.float32(0.05) * rate * p
            # the mean itself moves by rate * back, however many features it has
            vectors[ids] = own - np.outer(share_of * (rate / (share_of @ share_of)), back)
    return SubwordModel(shape, vectors, layer, bias)


def train(docs: DataFrame, labels: DataFrame, shape: Shape = Shape(), most: int = TRAIN_DOCS) -> SubwordModel:  # noqa: B008
    """The model of ``labels.quality``, learned from at most ``most`` documents outside the held-out part.

    Features are made in the tasks; the driver gets distinct ids and shares of the sample alone. Without any label the model
    says 0.5 of everything.
    """
    schema = pa.schema([("label", pa.int32()), ("ids", pa.list_(pa.int32())), ("shares", pa.list_(pa.float32()))])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [features(t, shape) for t in batch.column("text").to_pylist()]
        return frame_batch(schema, label=batch.column("label"), ids=[f[0] for f in found], shares=[f[1] for f in found])

    sample = training_sample(docs, labels, "quality", PARTS, HELD_OUT, most, "quality")
    table = map_batches(sample.select("text", "label"), run, "label int, ids array<int>, shares array<float>").toArrow()
    ids, shares = (table.column(n).combine_chunks() for n in ("ids", "shares"))
    cuts = ids.offsets.to_numpy()
    flat, weight = ids.values.to_numpy(), shares.values.to_numpy()
    rows = [(flat[a:b], weight[a:b], y) for a, b, y in zip(cuts[:-1], cuts[1:], table.column("label").to_pylist(), strict=True)]
    rows.sort(key=lambda r: (r[2], len(r[0]), r[0].tobytes(), r[1].tobytes()))  # the order of rows from Spark isn't fixed
    return fit(rows, shape)


class _Memo(dict):
    """Word to what its features add (real part) and how many they are (imaginary part)."""

    def __init__(self, weights: np.ndarray, shape: Shape):
        super().__init__()
        self.weights, self.shape = weights, shape

    def __missing__(self, word: bytes) -> complex:
        ids = subword_ids(word, self.shape)
        value = complex(float(self.weights[ids].sum()), len(ids))
        if len(word) <= CACHE_BYTES:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = value
        return value


def scorer(model: SubwordModel):
    """A function of a list of texts that gives their scores; it works in tasks and keeps known words between batches."""
    weights, bias = model.weights()
    memo: list[_Memo] = []

    def score(texts: list[str | None]) -> np.ndarray:
        if not memo:
            memo.append(_Memo(weights, model_shape))
        known = memo[0].__getitem__
        sums = np.zeros(len(texts), np.complex128)
        for i, text in enumerate(texts):
            words = text.encode().split() if text else []
            same, again = repeats(words)
            sums[i] = sum(map(known, words), same * known(SAME) + again * known(AGAIN))
        logit = sums.real / np.maximum(sums.imag, 1) + bias
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))

    model_shape = model.shape
    return score


def score_quality(docs: DataFrame, model: SubwordModel, accept: float = ACCEPT) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row's whole text; no shuffle.

    The text alone decides the score. A null or empty text gets the score of the prior; a null doc_id stays null and isn't
    held out; repeated rows are all returned; further columns are ignored.
    """
    score = scorer(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return frame_batch(schema, doc_id=batch.column("doc_id"), score=score(batch.column("text").to_pylist()))

    out = map_batches(id_and_text(docs), run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), PARTS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: SubwordModel, accept: float = ACCEPT) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is accepted; those that the model rejects go. No shuffle."""
    score, names = scorer(model), docs.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column([n.lower() for n in names].index("text"))
        return batch.filter(pa.array(score(column.to_pylist()) >= accept))

    return map_batches(docs, run, docs.schema)
