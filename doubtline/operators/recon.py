"""Reconstruction loss of an autoencoder, trained data-parallel.

Rows are dealt to shards by a hash of their id, as many as the number of rows asks for, and ordered in them, by one
shuffle; a task holds several shards, packed. Each epoch every shard runs mini-batch Adam over its own rows, starting from
the common weights; weights and Adam moments are then averaged over the shards, weighted by rows: a task sums up its own.
Only the weights travel. Since neither shards nor order depend on how the table was partitioned, the weights don't either.
"""

from __future__ import annotations

import math
from itertools import groupby

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doubtline.functions import vectors as V
from doubtline.functions.hashing import hash_uniform
from doubtline.operators.bounded import check_values
from doubtline.operators.stats import covariance, fold_vectors, moments

SPARSE_PENALTY = 1e-4
SHARD_ROWS = 8192
SHARDS = 1024  # beyond, shards grow up to MOST_ROWS before more are made
MOST_ROWS = 1_000_000
#: Shards of one task, bytes of rows that are stored as one, rows an epoch permutes together, numbers that tasks send without a shuffle.
TASK_SHARDS, PIECE_BYTES, CHUNK_ROWS, DIRECT_NUMBERS = 64, 16_384, 70_000, 1_000_000


def shard_count(rows: int) -> int:
    return max(1, min(math.ceil(rows / SHARD_ROWS), max(SHARDS, math.ceil(rows / MOST_ROWS))))


def task_count(shards: int, cores: int) -> int:
    """Tasks of an epoch: as many as there are cores, as long as a task has few shards."""
    return min(shards, max(cores, math.ceil(shards / TASK_SHARDS)))


def bottleneck(d: int) -> int:
    return d // 4 if d > 8 else 2


def layer_sizes(d: int, kind: str) -> list[int]:
    narrow = bottleneck(d)
    if kind == "deep":
        wide, middle = max(narrow, d // 2), max(narrow, d // 3)
        return [d, wide, middle, narrow, middle, wide, d]
    return [d, narrow, d]


def shapes(sizes: list[int]) -> list[tuple[int, int]]:
    return list(zip(sizes[:-1], sizes[1:]))


def parameter_count(sizes: list[int]) -> int:
    return sum(a * b + b for a, b in shapes(sizes))


def unpack(flat: np.ndarray, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    layers, at = [], 0
    for a, b in shapes(sizes):
        layers.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
        at += a * b + b
    return layers


def initial(sizes: list[int], seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    parts = []
    for a, b in shapes(sizes):
        limit = np.sqrt(6.0 / (a + b))
        parts += [rng.uniform(-limit, limit, a * b), np.zeros(b)]
    return np.concatenate(parts)


def forward(flat: np.ndarray, sizes: list[int], x: np.ndarray) -> list[np.ndarray]:
    """Activations of every layer; ReLU inside, sigmoid at the end."""
    out = [x]
    layers = unpack(flat, sizes)
    for i, (w, b) in enumerate(layers):
        z = out[-1] @ w + b
        last = i == len(layers) - 1
        out.append(1.0 / (1.0 + np.exp(-np.clip(z, -60, 60))) if last else np.maximum(z, 0.0))
    return out


def gradient(flat: np.ndarray, sizes: list[int], x: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Binary cross-entropy against the input, plus an L1 penalty on the code."""
    acts = forward(flat, sizes, x)
    layers = unpack(flat, sizes)
    n, d = x.shape
    y = np.clip(acts[-1], 1e-7, 1 - 1e-7)
    loss = float(-(x * np.log(y) + (1 - x) * np.log(1 - y)).mean())
    code = len(layers) // 2
    delta = (acts[-1] - x) / (n * d)
    grads = []
    for i in range(len(layers) - 1, -1, -1):
        grads.append((acts[i].T @ delta, delta.sum(axis=0)))
        if i > 0:
            back = delta @ layers[i][0].T
            if penalty and i == code:
                back = back + penalty * np.sign(acts[i]) / n
            delta = back * (acts[i] > 0)
    flat_grad = np.concatenate([np.concatenate([w.ravel(), b]) for w, b in reversed(grads)])
    return loss, flat_grad


def local_epoch(state: np.ndarray, step: int, sizes, x, batch, penalty, seed, rate=1e-3):
    """One pass of mini-batch Adam; ``state`` holds weights, first and second moments."""
    size = parameter_count(sizes)
    w, m, v = state[:size].copy(), state[size : 2 * size].copy(), state[2 * size :].copy()
    order = np.random.default_rng(seed).permutation(len(x))
    losses = []
    for s in range(0, len(x), batch):
        loss, g = gradient(w, sizes, x[order[s : s + batch]], penalty)
        step += 1
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
        losses.append(loss)
    return np.concatenate([w, m, v]), step, float(np.mean(losses))


def train_autoencoder(
    train: DataFrame,
    low: np.ndarray,
    high: np.ndarray,
    kind: str,
    epochs: int = 50,
    batch: int = 256,
    train_split: float = 0.8,
    rate: float = 1e-3,
    seed: int = 7,
) -> tuple[np.ndarray, list[int], list[float]]:
    d = len(low)
    sizes = layer_sizes(d, kind)
    size = parameter_count(sizes)
    check_values(3 * size + 3, "autoencoder weights")
    penalty = SPARSE_PENALTY if kind == "sparse" else 0.0
    span = np.where(high > low, high - low, 1.0)
    shift = np.where(high > low, low, 0.0)
    rows = train.filter(hash_uniform(seed, F.col("row_id")) < train_split)
    shards = shard_count(rows.count())
    keyed = rows.select(F.col("features").cast("array<double>").alias("x"), F.col("row_id").alias("id"))
    # equal ids go by their vector, so that a hot id or none at all is spread, too
    key = F.xxhash64("id", "x", F.lit(seed))
    tasks = task_count(shards, train.sparkSession.sparkContext.defaultParallelism)
    dealt = keyed.withColumn("shard", F.pmod(key, F.lit(shards)).cast("int")).repartitionById(tasks, F.pmod("shard", F.lit(tasks)).cast("int"))

    def packed(batches):
        """Scaled rows of a shard, many in a piece: an epoch has few rows to read."""
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            x, shard = np.clip((V.to_matrix(b.column(0)) - shift) / span, 0.0, 1.0), b.column(1).to_numpy()
            most = max(1, PIECE_BYTES // (8 * d))
            edges = [0, *(np.flatnonzero(np.diff(shard)) + 1), len(x)]
            cuts = [(s, min(s + most, hi)) for lo, hi in zip(edges[:-1], edges[1:], strict=True) for s in range(lo, hi, most)]
            pieces = [x[s:e].tobytes() for s, e in cuts]
            yield pa.RecordBatch.from_arrays([pa.array(shard[[s for s, _ in cuts]], pa.int32()), pa.array(pieces, pa.binary())], ["shard", "x"])

    ordered = dealt.sortWithinPartitions("shard", key, "id", "x").select("x", "shard")
    rows = stored = ordered.mapInArrow(packed, "shard int, x binary").persist(StorageLevel.MEMORY_AND_DISK)
    chunk = max(batch, CHUNK_ROWS)
    state = np.concatenate([initial(sizes, seed), np.zeros(2 * size)])
    sc = train.sparkSession.sparkContext
    step, history = 0, []
    # a single shard has nothing to average: its task runs all epochs in a row, with the same result
    rounds = epochs if shards == 1 else 1
    try:
        for epoch in range(0, epochs, rounds):
            shared = sc.broadcast((state, step))

            def run(batches, shared=shared, epoch=epoch):
                import pyarrow as pa

                out = np.zeros(2 + rounds + 3 * size)

                def pieces():
                    for b in batches:
                        yield from zip(b.column(0).to_pylist(), b.column(1), strict=True)

                for _, own in groupby(pieces(), key=lambda p: p[0]):
                    local, at = shared.value
                    losses, n, pending, held = np.zeros(rounds), 0, [], 0

                    def flush():
                        nonlocal local, at, pending, held
                        x = np.concatenate(pending)
                        for i in range(rounds):
                            local, at, loss = local_epoch(local, at, sizes, x, batch, penalty, [seed, epoch + i], rate)
                            losses[i] += loss * len(x)
                        pending, held = [], 0

                    for _, cell in own:
                        x = np.frombuffer(cell.as_buffer(), float).reshape(-1, d)
                        while held + len(x) >= chunk:
                            pending.append(x[: chunk - held])
                            n, x = n + len(pending[-1]), x[chunk - held :]
                            flush()
                        if len(x):
                            pending.append(x)
                            held += len(x)
                            n += len(x)
                    if held:
                        flush()
                    out += np.concatenate([[n, (at - shared.value[1]) * n], losses, local * n])
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array([out], pa.list_(pa.float64()))], ["part"])

            parts = rows.mapInArrow(run, "part array<double>")
            width = 2 + rounds + 3 * size
            # short vectors of few tasks need no shuffle
            few = tasks * width <= DIRECT_NUMBERS
            flat = sum((np.array(r.part) for r in parts.collect()), np.zeros(width)) if few else fold_vectors(parts, width)
            shared.unpersist()
            if flat[0] == 0:
                raise ValueError("no rows to train the autoencoder on")
            state = flat[2 + rounds :] / flat[0]
            step += max(1, round(flat[1] / flat[0]))
            history += (flat[2 : 2 + rounds] / flat[0]).tolist()
    finally:
        stored.unpersist()
    return state[:size], sizes, history


class Reconstructor:
    """Min-max scaling, encoding, decoding, and the mean absolute error per row."""

    def __init__(self, kind, low, high, sizes=None, weights=None, mean=None, axes=None, history=None):
        self.kind, self.low, self.high = kind, np.array(low), np.array(high)
        self.sizes, self.history = sizes, history or []
        self.weights = None if weights is None else np.array(weights)
        self.mean = None if mean is None else np.array(mean)
        self.axes = None if axes is None else np.array(axes)

    @classmethod
    def fit(cls, train: DataFrame, kind: str = "simple", epochs: int = 50, batch: int = 256, seed: int = 7):
        m = moments(train)
        low, high = m.low[0], m.high[0]
        if kind == "pca":
            span = np.where(high > low, high - low, 1.0)
            shift = np.where(high > low, low, 0.0)
            _, mean, cov = covariance(train, ddof=0)
            cov = cov / np.outer(span, span)
            _, axes = np.linalg.eigh(cov)
            top = axes[:, ::-1][:, : bottleneck(m.width)]
            return cls(kind, low, high, mean=(mean - shift) / span, axes=top)
        if kind not in ("simple", "sparse", "deep"):
            kind = "simple"
        weights, sizes, history = train_autoencoder(train, low, high, kind, epochs, batch, seed=seed)
        return cls(kind, low, high, sizes, weights, history=history)

    def loss(self, features: str = "features"):
        low, high = self.low, self.high
        span = np.where(high > low, high - low, 1.0)
        shift = np.where(high > low, low, 0.0)
        kind, sizes, weights, mean, axes = self.kind, self.sizes, self.weights, self.mean, self.axes

        def fn(x):
            z = (x - shift) / span
            if kind == "pca":
                y = mean + ((z - mean) @ axes) @ axes.T
            else:
                y = forward(weights, sizes, z)[-1]
            return np.abs(y - z).mean(axis=1)

        return V.matrix_to_scalar(fn)(F.col(features).cast("array<double>"))

    def state(self) -> dict:
        return {
            "kind": self.kind, "low": self.low, "high": self.high, "sizes": self.sizes,
            "weights": self.weights, "mean": self.mean, "axes": self.axes, "history": self.history,
        }
