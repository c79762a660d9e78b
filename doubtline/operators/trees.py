"""Histogram trees: all trees of all models of a search grow together, level by level, from one binned table.

Features are binned once. A level needs, for each open node, sums of a few whole numbers by feature and bin: class counts,
or gradients and curvatures as multiples of 1 / ``FIXED``. Sums of whole numbers don't depend on their order, so the trees
don't depend on partitions, and a search may be run in either of two forms with equal results:

* ``grow_on_spark``: each level is one pass over the binned table for the nodes of all trees; tasks send partial sums, which
  are folded on executors, and the driver decides the splits. Nothing grows with the rows but the passes' work.
* ``grow_in_tasks``: rows of equal bins are one cell with summed numbers, as a tree can't tell them apart. Cells below
  ``LOCAL_BYTES`` are dealt to one task for each boosted model or run of a forest's trees, which grows them whole.

A model of fewer rounds or trees is the beginning of one of more (``Plan.stem``), so a search grows each stem once.
"""

from __future__ import annotations

import base64
import io
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doubtline.functions import vectors as V
from doubtline.functions.hashing import md5_uniform
from doubtline.functions.prob import argmax
from doubtline.operators.models import Fitted, Model, register
from doubtline.session import materialize

BINS, FIXED = 64, 1 << 20
#: Rows, chosen by a hash, whose quantiles are the cuts between bins.
CUT_ROWS = 20_000
#: Bytes of a binned table, equal bins counted once, that one task still holds whole.
LOCAL_BYTES = 32 << 20
#: Numbers that one step of a sum has in memory, and rows from which on each tree of a forest has a task of its own.
STEP_NUMBERS, LONE_ROWS = 4 << 20, 50_000
#: Numbers of one pass, trees of a forest that grow at once, and rounds after which margins are written.
PASS_NUMBERS, FOREST_TREES, MARGIN_ROUNDS = 1 << 20, 16, 10
#: Trees of a forest that one task grows.
TASK_TREES = 10
#: Probabilities of cells that a task remembers.
CELL_NUMBERS = 4 << 20
# fixed values: distribution function of the Poisson law of mean 1, for bootstrap weights
POISSON = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(12)])
POISSON_BITS = 12
#: The law's number by the first bits of a hash, -1 where those bits don't tell it.
POISSON_TABLE = np.searchsorted(POISSON, np.arange(1 << POISSON_BITS) / (1 << POISSON_BITS), side="right")
POISSON_TABLE[np.searchsorted(POISSON, np.arange(1, (1 << POISSON_BITS) + 1) / (1 << POISSON_BITS), side="right") != POISSON_TABLE] = -1


@dataclass(frozen=True)
class Plan:
    """What to grow: boosted trees for one class, or a forest, on some rows and columns of the table."""

    kind: str  # "boost" or "forest"
    count: int
    depth: int
    classes: int = 2
    target: int = 1  # boost: the class that is told from the others
    step: float = 0.1
    ridge: float = 1.0
    least: float = 0.0  # boost: curvature each side of a split needs
    bagged: bool = False
    draw: bool = False  # forest: a node sees the square root of the columns
    share: float = 1.0  # rows of class 0 that are kept, by their uniform number
    columns: tuple[int, ...] | None = None
    seed: int = 7

    @property
    def stem(self) -> Plan:
        return replace(self, count=0)

    @property
    def numbers(self) -> int:
        """Sums for each node, column and bin."""
        return 2 if self.kind == "boost" else self.classes


def mixed(*parts) -> np.ndarray:
    """64-bit hashes of integers and integer arrays."""
    x = np.zeros(1, np.uint64)
    for part in parts:
        x = x ^ np.asarray(part).astype(np.int64).astype(np.uint64)
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    return x


# --- the table ------------------------------------------------------------------------------


def bin_cuts(train: DataFrame, rows: int = CUT_ROWS) -> list[np.ndarray]:
    """At most ``BINS - 1`` cuts for each feature: quantiles of at most ``rows`` rows, those of the least hashes."""
    hashed = train.select(F.xxhash64("row_id", "features").alias("__h"), F.col("features").cast("array<double>").alias("x")).filter("x IS NOT NULL")
    total = hashed.count()
    if total > rows:
        share = min(1.0, (1.1 * rows + 100) / total)
        hashed = hashed.filter(F.col("__h") < int(-(2**63) + share * 2**64))
    sample = np.array([r.x for r in hashed.orderBy("__h").limit(rows).select("x").collect()], float)
    cuts = []
    for x in sample.T if len(sample) else np.zeros((0, 0)):
        values = np.unique(x[np.isfinite(x)])
        if len(values) > BINS:
            values = np.unique(np.quantile(x[np.isfinite(x)], np.linspace(0, 1, BINS), method="lower"))
        cuts.append((values[:-1] + values[1:]) / 2)
    return cuts


def binned(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Bin numbers; a value at a cut is below it, NaN is above all."""
    return np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], axis=1).astype(np.uint8) if len(x) else np.zeros((0, len(cuts)), np.uint8)


def cells_of(bins: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    n, width = bins.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(bins))])


def binned_table(train: DataFrame, cuts: Sequence[np.ndarray], seed: int = 0, thinned: bool = True) -> DataFrame:
    """``bins binary, label int, hash long, u double`` of the labelled rows. No shuffle. ``u`` is 0 where no plan thins out rows."""
    schema = pa.schema([("bins", pa.binary()), ("label", pa.int32()), ("hash", pa.int64()), ("u", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bins = binned(V.to_matrix(batch.column("x")), cuts)
                yield pa.RecordBatch.from_arrays([cells_of(bins), *(batch.column(n) for n in ("label", "hash", "u"))], schema=schema)

    rows = train.filter(F.col("label").isNotNull()).select(
        F.col("features").cast("array<double>").alias("x"),
        F.col("label").cast("int").alias("label"),
        F.xxhash64("row_id").alias("hash"),
        (md5_uniform(seed, F.col("row_id")) if thinned else F.lit(0.0)).alias("u"),
    )
    return rows.mapInArrow(run, "bins binary, label int, hash long, u double")


@dataclass
class Block:
    """Some rows of the table."""

    bins: np.ndarray
    label: np.ndarray
    hash: np.ndarray
    u: np.ndarray

    @staticmethod
    def of(batch: pa.RecordBatch | pa.Table, width: int) -> Block:
        cells = batch.column("bins")
        joined = b"".join(cells.to_pylist())
        arrays = [batch.column(n).to_numpy() if isinstance(batch, pa.Table) else batch.column(n).to_numpy(zero_copy_only=False) for n in ("label", "hash", "u")]
        return Block(np.frombuffer(joined, np.uint8).reshape(-1, width), *arrays)

    def kept(self, plan: Plan) -> np.ndarray:
        return (self.label != 0) | (self.u < plan.share)

    def stats(self, plan: Plan, tree: int, margin: np.ndarray | None) -> np.ndarray:
        """The whole numbers of each row: gradient and curvature, or its weight at its class."""
        if plan.kind == "boost":
            return slopes(margin, self.label == plan.target, self.label != plan.target) * self.kept(plan)[:, None]
        weight = self.weights(plan, tree)
        out = np.zeros((len(self.label), plan.classes))
        out[np.arange(len(self.label)), np.clip(self.label, 0, plan.classes - 1)] = weight
        return out

    def weights(self, plan: Plan, tree: int) -> np.ndarray:
        """Of each row, for a tree of a forest: how often it is drawn."""
        kept = self.kept(plan).astype(np.int64)
        return kept * poisson(mixed(plan.seed, tree, self.hash)) if plan.bagged else kept


def poisson(x: np.ndarray) -> np.ndarray:
    """Numbers of the Poisson law of mean 1 from 64-bit hashes: their first bits tell it but for the few at a step of the law."""
    out = POISSON_TABLE[x >> np.uint64(64 - POISSON_BITS)]
    edge = np.flatnonzero(out < 0)
    u = (x[edge] >> np.uint64(11)).astype(float) / float(1 << 53)
    out[edge] = np.searchsorted(POISSON, u, side="right")
    return out


def slopes(margin: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Gradient and curvature, as whole numbers, of so many rows of the class and of others."""
    p = 1.0 / (1.0 + np.exp(-margin))
    g = own * np.rint((p - 1.0) * FIXED) + other * np.rint(p * FIXED)
    h = (own + other) * np.maximum(np.rint(p * (1.0 - p) * FIXED), 1.0)
    return np.stack([g, h], axis=1)


# --- one tree -------------------------------------------------------------------------------


class Growth:
    """A tree that grows: its nodes so far, and the open ones of the deepest level."""

    def __init__(self, plan: Plan, tree: int, width: int):
        self.plan, self.tree = plan, tree
        self.columns = np.array(plan.columns if plan.columns is not None else range(width), np.int64)
        self.feature, self.cut, self.left, self.right = [0], [0], [0], [0]
        self.value: list[np.ndarray] = [np.zeros(1 if plan.kind == "boost" else plan.classes)]
        self.open, self.level = [0], 0
        self.next: list[int] = []  # children of open nodes that are split already
        self.gains = np.zeros(width)

    def candidates(self, nodes: Sequence[int]) -> np.ndarray:
        """The columns each open node may be split by."""
        if not self.plan.draw:
            return np.tile(self.columns, (len(nodes), 1))
        few = max(1, int(math.sqrt(len(self.columns))))
        keys = mixed(self.plan.seed, self.tree, np.array(nodes)[:, None], self.columns[None, :])
        return np.sort(self.columns[np.argsort(keys, axis=1)[:, :few]], axis=1)

    def per_node(self) -> int:
        few = max(1, int(math.sqrt(len(self.columns)))) if self.plan.draw else len(self.columns)
        return few * BINS * self.plan.numbers

    def _quality(self, sums: np.ndarray) -> np.ndarray:
        if self.plan.kind == "boost":
            g, h = sums[..., 0] / FIXED, sums[..., 1] / FIXED
            return g * g / (h + self.plan.ridge + 1e-12)
        whole = sums.sum(axis=-1)
        return (sums.astype(float) ** 2).sum(axis=-1) / np.maximum(whole, 1)

    def _value(self, sums: np.ndarray) -> np.ndarray:
        if self.plan.kind == "boost":
            return np.array([-sums[0] / FIXED / (sums[1] / FIXED + self.plan.ridge + 1e-12) * self.plan.step])
        whole = sums.sum()
        return sums / whole if whole else np.full(self.plan.classes, 1.0 / self.plan.classes)

    def split(self, nodes: Sequence[int], columns: np.ndarray, sums: np.ndarray) -> list[int]:
        """Values of some open nodes, from ``sums`` (nodes x columns x bins x numbers), and the children of those that split."""
        whole = sums[:, 0].sum(axis=1)
        left = np.cumsum(sums, axis=2)[:, :, :-1]
        right = whole[:, None, None] - left
        gain = self._quality(left) + self._quality(right) - self._quality(whole)[:, None, None]
        if self.plan.kind == "boost":
            least = max(self.plan.least * FIXED, 1)
            usable = (left[..., 1] >= least) & (right[..., 1] >= least)
        else:
            usable = (left.sum(axis=-1) > 0) & (right.sum(axis=-1) > 0)
        gain = np.where(usable, gain, -np.inf).reshape(len(nodes), -1)
        best = gain.argmax(axis=1)
        grown = []
        for k, node in enumerate(nodes):
            self.value[node] = self._value(whole[k])
            if self.level < self.plan.depth and gain[k, best[k]] > 1e-9:
                column, cut = divmod(int(best[k]), BINS - 1)
                self.gains[columns[k, column]] += gain[k, best[k]]
                self.feature[node], self.cut[node] = int(columns[k, column]), cut
                self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
                for child in (len(self.feature), len(self.feature) + 1):
                    self.feature.append(0)
                    self.cut.append(0)
                    self.left.append(child)
                    self.right.append(child)
                    self.value.append(self.value[0])
                    grown.append(child)
        return grown

    def walk(self, bins: np.ndarray) -> np.ndarray:
        """The deepest node of each row so far."""
        feature, cut, left, right = (np.array(a) for a in (self.feature, self.cut, self.left, self.right))
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(self.level):
            node = np.where(bins[rows, feature[node]] <= cut[node], left[node], right[node])
        return node


def level_sums(bins: np.ndarray, stats: np.ndarray, slot: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Sums of ``stats`` by slot, candidate column and bin, for rows of a slot of 0 or more."""
    rows, few = np.flatnonzero(slot >= 0), columns.shape[1]
    size = len(columns) * few * BINS
    out = np.zeros((size, stats.shape[1]))
    step = max(1, STEP_NUMBERS // few)
    for at in range(0, len(rows), step):
        some = rows[at : at + step]
        own = slot[some]
        cell = ((own[:, None] * few + np.arange(few)) * BINS + bins[some[:, None], columns[own]]).ravel()
        for k in range(stats.shape[1]):
            out[:, k] += np.bincount(cell, np.repeat(stats[some, k], few), size)
    return out.astype(np.int64).reshape(len(columns), few, BINS, stats.shape[1])


def slots(open_nodes: Sequence[int], node: np.ndarray, size: int) -> np.ndarray:
    place = np.full(size, -1)
    place[list(open_nodes)] = np.arange(len(open_nodes))
    return place[node]


@dataclass
class Trees:
    """Finished trees, packed: a leaf points to itself."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    gains: np.ndarray  # trees x columns
    start: float = 0.0

    @staticmethod
    def packed(grown: Sequence[Growth], start: float = 0.0) -> Trees:
        sizes = np.cumsum([0, *[len(g.feature) for g in grown]])
        glue = lambda name, shift=False: np.concatenate([np.array(getattr(g, name)) + (s if shift else 0) for g, s in zip(grown, sizes)]).astype(np.int32)
        value = np.concatenate([np.stack(g.value) for g in grown])
        return Trees(glue("feature"), glue("cut"), glue("left", True), glue("right", True), value, sizes[:-1].astype(np.int32), max(g.level for g in grown), np.stack([g.gains for g in grown]), start)

    def first(self, count: int) -> Trees:
        return replace(self, roots=self.roots[:count], gains=self.gains[:count])

    @staticmethod
    def joined(parts: Sequence[Trees]) -> Trees:
        sizes = np.cumsum([0, *[len(p.feature) for p in parts]])
        glue = lambda name, shift=False: np.concatenate([getattr(p, name) + (s if shift else 0) for p, s in zip(parts, sizes)]).astype(np.int32)
        return Trees(glue("feature"), glue("cut"), glue("left", True), glue("right", True), np.concatenate([p.value for p in parts]), glue("roots", True), max(p.depth for p in parts), np.concatenate([p.gains for p in parts]), parts[0].start)

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """rows x trees: the leaf of each row."""
        node, rows = np.tile(self.roots, (len(bins), 1)), np.arange(len(bins))[:, None]
        for _ in range(self.depth):
            node = np.where(bins[rows, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])
        return node

    def total(self, bins: np.ndarray) -> np.ndarray:
        """Sum of the trees' values, rows x values, and the start."""
        out = np.full((len(bins), self.value.shape[1]), self.start)
        for at in range(0, len(self.roots), 64):
            out += self.value[replace(self, roots=self.roots[at : at + 64]).leaves(bins)].sum(axis=1)
        return out

    def to_bytes(self) -> bytes:
        held = io.BytesIO()
        np.savez_compressed(held, feature=self.feature, cut=self.cut, left=self.left, right=self.right, value=self.value, roots=self.roots, depth=self.depth, gains=self.gains, start=self.start)
        return held.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> Trees:
        held = np.load(io.BytesIO(data))
        return Trees(*(held[n] for n in ("feature", "cut", "left", "right", "value", "roots")), int(held["depth"]), held["gains"], float(held["start"]))


def prior(plan: Plan, counts: np.ndarray) -> float:
    """Log odds of the class among the rows; ``counts`` are the kept rows of each class."""
    if plan.kind != "boost":
        return 0.0
    own = counts[plan.target] if plan.target < len(counts) else 0
    other = counts.sum() - own
    return float(math.log(own / other)) if own and other else (30.0 if own else -30.0)


# --- whole models in tasks ------------------------------------------------------------------


def grow_tree(plan: Plan, tree: int, bins: np.ndarray, stats: np.ndarray) -> tuple[Growth, np.ndarray]:
    """One tree from all cells and their sums, and the leaf of each cell."""
    growth = Growth(plan, tree, bins.shape[1])
    node = np.zeros(len(bins), np.int64)
    most = max(1, PASS_NUMBERS // max(growth.per_node(), 1))
    weighed = stats.any(axis=1)
    rows = np.arange(len(node))
    while growth.open:
        # the nodes of the deepest level are numbered one after the other: their cells in this order
        live = np.flatnonzero(weighed & (node >= growth.open[0]))
        live = live[np.argsort(node[live], kind="stable")]
        at_node, grown = node[live], []
        for at in range(0, len(growth.open), most):
            some = growth.open[at : at + most]
            mine = live[np.searchsorted(at_node, some[0]) : np.searchsorted(at_node, some[-1], side="right")]
            columns = growth.candidates(some)
            grown += growth.split(some, columns, level_sums(bins[mine], stats[mine], node[mine] - some[0], columns))
        if grown:
            growth.level += 1
            feature, cut, left, right = (np.array(a) for a in (growth.feature, growth.cut, growth.left, growth.right))
            node = np.where(bins[rows, feature[node]] <= cut[node], left[node], right[node])
        growth.open = grown
    return growth, node


def grow_locally(plan: Plan, first: int, last: int, bins: np.ndarray, numbers: np.ndarray) -> Trees:
    """Trees ``first`` to ``last`` of a plan from cells with their numbers (see ``Deal``); boosted ones start with the first."""
    if plan.kind != "boost":
        own = [numbers[:, j * plan.classes : (j + 1) * plan.classes].astype(float) for j in range(last - first)]
        return Trees.packed([grow_tree(plan, tree, bins, stats)[0] for tree, stats in zip(range(first, last), own)])
    counts = numbers.sum(axis=0)
    start = prior(replace(plan, target=1), counts[::-1])
    margin, grown = np.full(len(bins), start), []
    for tree in range(first, last):
        growth, node = grow_tree(plan, tree, bins, slopes(margin, numbers[:, 0], numbers[:, 1]))
        grown.append(growth)
        margin = margin + np.array([v[0] for v in growth.value])[node]
    return Trees.packed(grown, start)


@dataclass(frozen=True)
class Deal:
    """What one task grows: a boosted plan, or some trees of a forest."""

    plan: int
    first: int
    last: int

    def numbers(self, plan: Plan, block: Block, cell: np.ndarray, cells: int) -> np.ndarray:
        """Of each cell: kept rows of the class and of others, or the weights at the classes, tree by tree."""
        if plan.kind == "boost":
            kept = block.kept(plan)
            return np.bincount(2 * cell[kept] + (block.label[kept] != plan.target), minlength=2 * cells).reshape(cells, 2)
        trees = range(self.first, self.last) if plan.bagged else [self.first] * (self.last - self.first)
        place, size = plan.classes * cell + np.clip(block.label, 0, plan.classes - 1), plan.classes * cells
        sums = [np.bincount(place, block.weights(plan, tree), size).astype(np.int64) for tree in trees]
        return np.concatenate([s.reshape(cells, -1) for s in sums], axis=1)


def deals(plans: Sequence[Plan], rows: int) -> list[Deal]:
    out = []
    for k, plan in enumerate(plans):
        size = plan.count if plan.kind == "boost" else 1 if rows > LONE_ROWS else TASK_TREES
        out += [Deal(k, a, min(a + size, plan.count)) for a in range(0, plan.count, size)]
    return sorted(out, key=lambda j: (plans[j.plan].kind != "boost", -plans[j.plan].depth * (j.last - j.first), j.plan, j.first))  # the longest first


def grow_in_tasks(table: DataFrame, plans: Sequence[Plan], width: int) -> list[Trees]:
    """Each plan's trees, whole models or runs of a forest's trees in a task each, from the cells of the table."""
    known = list(plans)
    jobs = deals(known, table.count())

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells of each job; one that a batch ends in comes in two parts, whose numbers add up like those of two cells."""
        for batch in batches:
            if not batch.num_rows:
                continue
            block = Block.of(batch, width)
            starts = np.flatnonzero(np.r_[True, (block.bins[1:] != block.bins[:-1]).any(axis=1)])
            cells = batch.column("bins").take(pa.array(starts))
            cell = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(block.label)]))
            for no, job in enumerate(jobs):
                sums = job.numbers(known[job.plan], block, cell, len(starts))
                some = np.flatnonzero(sums.any(axis=1))
                numbers = cells_of(sums[some].astype(np.int32).view(np.uint8))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), no, np.int32)), cells.take(pa.array(some)), numbers], ["job", "bins", "numbers"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        for batch in batches:
            own = batch.column("job").to_numpy()
            for no in np.unique(own):
                mine = batch.filter(pa.array(own == no))
                bins, numbers = (np.frombuffer(b"".join(mine.column(n).to_pylist()), kind) for n, kind in (("bins", np.uint8), ("numbers", np.int32)))
                parts.setdefault(int(no), []).append((bins.reshape(-1, width), numbers.reshape(mine.num_rows, -1)))
        for no in list(parts):
            job, held = jobs[no], parts.pop(no)
            bins, numbers = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            del held
            packed = grow_locally(known[job.plan], job.first, job.last, bins, numbers).to_bytes()
            yield pa.RecordBatch.from_pydict({"job": pa.array([no], pa.int32()), "trees": pa.array([packed], pa.binary())})

    cells = table.repartition("bins").sortWithinPartitions("bins").mapInArrow(dealt, "job int, bins binary, numbers binary")
    found = cells.repartitionById(len(jobs), F.col("job")).mapInArrow(run, "job int, trees binary").collect()
    parts: list[dict[int, bytes]] = [{} for _ in plans]
    for r in found:
        parts[jobs[r.job].plan][jobs[r.job].first] = r.trees
    for job in jobs:  # a job without a cell: no row is kept
        if job.first not in parts[job.plan]:
            plan = known[job.plan]
            bins, numbers = np.zeros((0, width), np.uint8), np.zeros((0, 2 if plan.kind == "boost" else plan.classes * (job.last - job.first)), np.int64)
            parts[job.plan][job.first] = grow_locally(plan, job.first, job.last, bins, numbers).to_bytes()
    return [Trees.joined([Trees.from_bytes(p[a]) for a in sorted(p)]) for p in parts]


# --- level by level on Spark ----------------------------------------------------------------


def _folded(parts: DataFrame) -> np.ndarray:
    """The sum of int64 vectors, one for each task, as one: some tasks sum the vectors of many, one sums theirs."""

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            for cell in batch.column(0):
                part = np.frombuffer(cell.as_buffer(), np.int64)
                state = part.copy() if state is None else state + part
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([state.tobytes()], pa.binary())], ["part"])

    tasks = parts.rdd.getNumPartitions()
    if tasks > 16:
        parts = parts.repartition(math.ceil(math.sqrt(tasks))).mapInArrow(together, "part binary").repartition(1).mapInArrow(together, "part binary")
    return sum(np.frombuffer(bytes(r.part), np.int64) for r in parts.collect())


def grow_on_spark(table: DataFrame, plans: Sequence[Plan], width: int) -> list[Trees]:
    """Each plan's trees; a pass over the table serves the open nodes of all plans' trees, up to ``PASS_NUMBERS`` sums.

    Margins of boosted rows are those written last and the trees since then; they are written every ``MARGIN_ROUNDS`` rounds.
    """
    top = max(p.classes for p in plans)
    by_class = {(r.label, r.u): r.n for r in _kept_counts(table, plans)}
    starts = []
    for k, plan in enumerate(plans):
        counts = np.array([by_class.get((c, k), 0) for c in range(top)])
        starts.append(prior(plan, counts))
    boosts = [k for k, p in enumerate(plans) if p.kind == "boost"]
    table = materialize(table.withColumn("margins", F.array(*[F.lit(starts[k]) for k in boosts]).cast("array<double>")), "tree-rows")
    grown: list[list[Growth]] = [[] for _ in plans]
    live: dict[int, list[Growth]] = {k: [] for k in range(len(plans))}
    written = dict.fromkeys(boosts, 0)

    def refill() -> None:
        for k, plan in enumerate(plans):
            room = 1 if plan.kind == "boost" else FOREST_TREES
            started = len(grown[k]) + len(live[k])
            while len(live[k]) < room and started < plan.count:
                live[k].append(Growth(plan, started, width))
                started += 1

    refill()
    while any(live.values()):
        # nodes of this pass
        asked, size = [], 0
        for k, growths in live.items():
            for growth in growths:
                room = (PASS_NUMBERS - size) // growth.per_node()
                nodes = growth.open[: max(room, 1 if not asked else 0)]
                if nodes:
                    columns = growth.candidates(nodes)
                    asked.append((k, growth, nodes, columns, size, columns.size * BINS * growth.plan.numbers))
                    size += asked[-1][-1]
        sums = _folded(table.mapInArrow(_pass(asked, plans, boosts, grown, written, width, size), "part binary"))
        for k, growth, nodes, columns, at, length in asked:
            shaped = sums[at : at + length].reshape(len(nodes), columns.shape[1], BINS, growth.plan.numbers)
            growth.next += growth.split(nodes, columns, shaped)
            growth.open = growth.open[len(nodes) :]
            if not growth.open:
                growth.open, growth.next = growth.next, []
                if growth.open:
                    growth.level += 1
                else:
                    live[k].remove(growth)
                    grown[k].append(growth)
        refill()
        if boosts and any(live.values()) and max(len(grown[k]) - written[k] for k in boosts) >= MARGIN_ROUNDS:
            table = materialize(table.mapInArrow(_margins(boosts, grown, written, width), table.schema), "tree-rows")
            written = {k: len(grown[k]) for k in boosts}
    return [Trees.packed(sorted(g, key=lambda x: x.tree), s) for g, s in zip(grown, starts)]


def _kept_counts(table: DataFrame, plans: Sequence[Plan]) -> list:
    """Rows of each class that a plan keeps."""
    shares = F.array(*[F.lit(float(p.share)) for p in plans])
    each = table.select("label", F.col("u").alias("v"), F.posexplode(shares).alias("u", "share"))
    return each.filter((F.col("label") != 0) | (F.col("v") < F.col("share"))).groupBy("label", "u").agg(F.count(F.lit(1)).alias("n")).collect()


def _margin_of(block: Block, written: np.ndarray, trees: Sequence[Growth]) -> np.ndarray:
    for growth in trees:
        written = written + np.array([v[0] for v in growth.value])[growth.walk(block.bins)]
    return written


def _pass(asked, plans, boosts, grown, written, width, size):
    place = {k: j for j, k in enumerate(boosts)}
    since = {k: grown[k][written[k] :] for k in boosts}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = np.zeros(size, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            block = Block.of(batch, width)
            margins = V.to_matrix(batch.column("margins")) if boosts else None
            for k, growth, nodes, columns, at, length in asked:
                margin = _margin_of(block, margins[:, place[k]], since[k]) if k in place else None
                stats = block.stats(plans[k], growth.tree, margin)
                slot = np.where(stats.any(axis=1), slots(nodes, growth.walk(block.bins), len(growth.feature)), -1)
                state[at : at + length] += level_sums(block.bins, stats, slot, columns).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([state.tobytes()], pa.binary())], ["part"])

    return run


def _margins(boosts, grown, written, width):
    since = [grown[k][written[k] :] for k in boosts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                block, old = Block.of(batch, width), V.to_matrix(batch.column("margins"))
                new = np.stack([_margin_of(block, old[:, j], trees) for j, trees in enumerate(since)], axis=1)
                at = batch.schema.get_field_index("margins")
                yield batch.set_column(at, batch.schema.field(at).name, V.from_matrix(new))

    return run


# --- models ---------------------------------------------------------------------------------


def grow(table: DataFrame, plans: Sequence[Plan], width: int, local_bytes: int = LOCAL_BYTES) -> list[Trees]:
    """The trees of all plans; each stem is grown once, in the form that the table's size allows."""
    longest: dict[Plan, int] = {}
    for p in plans:
        longest[p.stem] = max(longest.get(p.stem, 0), p.count)
    stems = [replace(s, count=n) for s, n in longest.items()]
    small = table.select("bins").distinct().count() * (width + 24) <= local_bytes
    found = dict(zip(longest, (grow_in_tasks if small else grow_on_spark)(table, stems, width)))
    return [found[p.stem].first(p.count) for p in plans]


class TreeModel(Model):
    """Boosted trees (one model a class, probabilities normalised, for more than two classes), a tree, or a forest.

    Boosting is second-order on the logistic loss, from the log odds of the class on. A forest weighs rows by a hash of
    (tree, row) and draws columns by a hash of (tree, node), so it depends neither on the partitioning nor on its size.
    """

    def __init__(self, name: str, kind: str, count: int, depth: int, **options):
        self.name, self.kind, self.count, self.depth, self.options = name, kind, int(count), int(depth), options

    def plans(self, classes: int, share: float = 1.0, columns: Sequence[int] | None = None) -> list[Plan]:
        base = Plan(self.kind, self.count, self.depth, max(classes, 2), share=share, columns=None if columns is None else tuple(columns), **self.options)
        return [replace(base, target=c) for c in ([1] if classes <= 2 else range(classes))] if self.kind == "boost" else [base]

    def fit(self, train: DataFrame) -> FittedTrees:
        return fit_together(train, [self])[0]


def fit_together(train: DataFrame, models: Sequence[TreeModel], shares: Sequence[float] | None = None, columns: Sequence[Sequence[int] | None] | None = None, seed: int = 0, local_bytes: int = LOCAL_BYTES) -> list[FittedTrees]:
    """All models on one table; ``shares`` thin out its rows of class 0 by their uniform number, ``columns`` restrict its features."""
    shares, columns = shares or [1.0] * len(models), columns or [None] * len(models)
    known = train.filter(F.col("label").isNotNull() & F.col("features").isNotNull())
    top = known.agg(F.max("label")).first()[0]
    if top is None:
        raise ValueError("no labelled rows to fit on")
    classes = max(int(top) + 1, 2)
    cuts = bin_cuts(known)
    table = materialize(binned_table(known, cuts, seed, min(shares) < 1.0), "binned")
    asked = [m.plans(classes, s, c) for m, s, c in zip(models, shares, columns)]
    trees = iter(grow(table, [p for some in asked for p in some], len(cuts), local_bytes))
    return [FittedTrees(m.name, m.kind, classes, cuts, [next(trees) for _ in some]) for m, some in zip(models, asked)]


def count_verdicts(rows: DataFrame, models: Sequence[FittedTrees]) -> np.ndarray:
    """models x 2 x 2: rows by label and verdict, for models of one ``fit_together``; other labels and verdicts aren't counted.

    Rows of equal bins get equal verdicts, so each cell of the table is scored once, by all models, and counts for its rows.
    """
    cuts, size = models[0].cuts, 4 * len(models)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bins = binned(V.to_matrix(batch.column("x")), cuts)
                yield pa.RecordBatch.from_arrays([cells_of(bins), batch.column("label")], ["bins", "label"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = np.zeros(size, np.int64)
        for batch in batches:
            if batch.num_rows:
                bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, len(cuts))
                label, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "n"))
                for k, model in enumerate(models):
                    said = model.of_bins(bins).argmax(axis=1)
                    known = said < 2
                    np.add.at(state, 4 * k + 2 * label[known] + said[known], n[known])
        yield pa.RecordBatch.from_arrays([pa.array([state.tobytes()], pa.binary())], ["part"])

    known = rows.filter(F.col("label").isin(0, 1))
    table = known.select(F.coalesce(F.col("features").cast("array<double>"), F.array(*[F.lit(0.0)] * len(cuts))).alias("x"), F.col("label").cast("int").alias("label"))
    # as many tasks as the rows have: few cells are long work, too
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions())
    table = table.mapInArrow(cells, "bins binary, label int").groupBy("bins", "label").agg(F.count(F.lit(1)).alias("n")).repartition(tasks)
    return (np.zeros(size, np.int64) + _folded(table.mapInArrow(counted, "part binary"))).reshape(-1, 2, 2)


@register
class FittedTrees(Fitted):
    def __init__(self, name: str, kind: str, classes: int, cuts: Sequence, trees: Sequence[Trees]):
        self.name, self.kind, self.classes = name, kind, classes
        self.cuts, self.trees = [np.asarray(c, float) for c in cuts], list(trees)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self.of_bins(binned(x, self.cuts))

    def of_bins(self, bins: np.ndarray) -> np.ndarray:
        if self.kind == "forest":
            return self.trees[0].total(bins) / len(self.trees[0].roots)
        own = np.stack([1.0 / (1.0 + np.exp(-t.total(bins)[:, 0])) for t in self.trees], axis=1)
        if len(self.trees) == 1:
            return np.concatenate([1.0 - own, own], axis=1)
        mass = own.sum(axis=1, keepdims=True)
        return np.where(mass > 0, own / np.where(mass > 0, mass, 1.0), 1.0 / own.shape[1])

    def by_cell(self):
        """The same as ``probabilities``, but rows of equal bins are scored once: in a task, or in a batch where there are many cells."""
        sizes = [len(c) + 1 for c in self.cuts]
        cells, held = math.prod(sizes), {}

        def score(x: np.ndarray) -> np.ndarray:
            bins = binned(x, self.cuts)
            if not len(bins) or not sizes or cells >= 1 << 62:
                return self.of_bins(bins)
            cell = np.ravel_multi_index(tuple(bins.T.astype(np.int64)), sizes)
            some, first, back = np.unique(cell, return_index=True, return_inverse=True)
            if cells * self.classes > CELL_NUMBERS:
                return self.of_bins(bins[first])[back]
            if not held:
                held["known"], held["prob"] = np.zeros(cells, bool), np.empty((cells, self.classes))
            new = ~held["known"][some]
            if new.any():
                held["prob"][some[new]] = self.of_bins(bins[first[new]])
                held["known"][some[new]] = True
            return held["prob"][cell]

        return score

    def transform(self, df, prob="prob", pred="pred"):
        scored = V.matrix_to_matrix(self.by_cell())(F.coalesce(F.col("features").cast("array<double>"), F.array(*[F.lit(0.0)] * len(self.cuts))))
        df = df.withColumn(prob, V.vector(scored, self.classes, prob))
        return df.withColumn(pred, argmax(prob))

    def importances(self):
        total = sum(t.gains.sum(axis=0) for t in self.trees)
        return (total / total.sum()).tolist() if total.sum() > 0 else [0.0] * len(self.cuts)

    def state(self):
        packed = [base64.b64encode(t.to_bytes()).decode() for t in self.trees]
        return {"name": self.name, "kind": self.kind, "classes": self.classes, "cuts": [c.tolist() for c in self.cuts], "trees": packed}

    @classmethod
    def restore(cls, state, ml, frames):
        return cls(**{**state, "trees": [Trees.from_bytes(base64.b64decode(t)) for t in state["trees"]]})
