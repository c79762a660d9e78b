"""Exact nearest-neighbour join.

Contract: ``knn_join`` adds a column ``nn array<struct<dist, ref_id, carried...>>`` of length k,
ordered by (distance rounded to 9 digits, ref_id), so that ties are settled the same way for any
partitioning.

Three physical forms with equal results, chosen by measured figures:

* ``broadcast``: a reference below the broadcast bound goes to every task and each batch of queries
  is ranked in place: no shuffle at all;
* ``pivots``: the reference rows are assigned to pivots (a Voronoi partition), each cell is cut
  into rings by the distance from its pivot, and a ring of too many rows into blocks by hash. The
  triangle inequality tells which blocks can hold a neighbour of a query; queries go to those
  blocks only, each block yields its best k, and the partial lists are merged. Blocks with many
  queries are replicated, so neither side of a block grows with the data. No pruning ever drops a
  true neighbour;
* ``tiles``: where the inequality rules out little (many wide vectors), sending a query to each
  block is waste. Groups of queries then stay in a task, the reference passes by in tiles, and a
  running top-k is kept. A query row is shuffled once as long as the reference is one slice; a
  larger one is cut into slices of bounded size, and the lists of the slices are merged.

A hashed sample of queries gives the share of the reference that a query must be compared with, and
with it the bytes that ``pivots`` and ``tiles`` would shuffle (see ``choose_form``).

Copies of one vector beyond the first k ids can never be among anyone's k nearest, hence they are
removed first; a vector that makes up a third of the table costs k rows.
"""

from __future__ import annotations

import math
import threading
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from doubtline.functions.vectors import known_width, to_matrix, with_width
from doubtline.operators.bounded import BROADCAST_BYTES, bounded_collect, check_values
from doubtline.session import materialize

DIGITS = 9
WINDOW_LIMIT = 1000  # up to here Spark prunes row_number() <= k before the shuffle
SALTS = 64
RINGS = 64  # of one cell, at most
ROUTE_SAMPLE = 2000  # queries asked for the share of the reference they need
DENSE_SHARE = 0.5  # from here on ruling out blocks saves less work than it moves
SLICE_ROWS = 1_000_000
GROUP_BYTES = 64 * 1024 * 1024
# a row goes to about so many blocks, groups or slices, as long as those stay within the rows below or ``GROUP_BYTES``
COPIES, SLICES = 16, 8
BLOCK_ROWS, QUERY_ROWS = 20_000, 50_000
# rows of short vectors are met by leaves of neighbouring rows; so many queries go down the tree at once, with so many leaves and pairs of rows
LEAF_WIDTH, LEAF_ROWS, LEAF_QUERIES, LEAF_PAIRS = 8, 32, 2048, 1_000_000
LEAF_VISITS, PASS_PAIRS = 1_000_000, 100_000
# longer vectors are met in blocks of so many queries and rows, if there are many pairs and single precision holds their squares
WIDE_QUERIES, WIDE_ROWS, WIDE_PAIRS, WIDE_MOST = 256, 2048, 1_000_000, 1e15
_COLLECTING = threading.Lock()


def valid_k(k, default: int = 19) -> int:
    """``k`` as an int; anything that is not a number falls back to the default."""
    try:
        return int(k)
    except (TypeError, ValueError):
        return default


# --- numpy kernel ---------------------------------------------------------------------------


class Leaves:
    """Reference rows in the leaves of a tree, each node halved at the median of its widest feature, with the boxes of all nodes.

    ``order`` leads from places to the given rows. A level's nodes are numbered from the left; those below ``n`` are ``2 n`` and ``2 n + 1``.
    """

    def __init__(self, r: np.ndarray):
        self.levels = max(0, math.ceil(math.log2(max(len(r), 1) / LEAF_ROWS)))
        self.starts = [np.array([0, len(r)])]
        self.order = np.arange(len(r))
        for _ in range(self.levels):
            cuts = self.starts[-1]
            rows, sizes = r[self.order], np.diff(cuts)
            low, high = (f.reduceat(rows, cuts[:-1], axis=0) for f in (np.minimum, np.maximum))
            wide = (high - low).argmax(axis=1)
            # sizes of a level differ by one at most: a line for each node
            place = cuts[:-1, None] + np.arange(sizes.max())
            inside = place < cuts[1:, None]
            place = np.minimum(place, len(r) - 1)
            sorted_by = np.where(inside, rows[place, wide[:, None]], np.inf).argsort(axis=1, kind="stable")
            self.order = self.order[np.take_along_axis(place, sorted_by, axis=1)[inside]]
            self.starts.append(np.append(np.stack([cuts[:-1], cuts[:-1] + sizes // 2], axis=1).ravel(), len(r)))
        self.boxed(r[self.order])

    def boxed(self, rows: np.ndarray) -> None:
        self.rows = rows
        self.columns = np.ascontiguousarray(rows.T)
        self.low, self.high = ([f.reduceat(rows, cuts[:-1], axis=0).T.copy() for cuts in self.starts] for f in (np.minimum, np.maximum))

    @staticmethod
    def serve(r: np.ndarray) -> bool:
        return len(r) > 512 and 0 < r.shape[1] <= LEAF_WIDTH and bool(np.isfinite(r).all())

    def away(self, x: np.ndarray, level: int, node: np.ndarray) -> np.ndarray:
        """Squared distances of points, feature by feature, to the boxes of a level's nodes."""
        out = np.zeros(len(node))
        for own, low, high in zip(x, self.low[level], self.high[level], strict=True):
            gap = np.maximum(np.maximum(low[node] - own, own - high[node]), 0.0)
            out += gap * gap
        return out

    def home(self, x: np.ndarray, level: int) -> np.ndarray:
        """The node of a level that each point leads to."""
        node = np.zeros(x.shape[1], np.int64)
        for i in range(1, level + 1):
            node = 2 * node
            node += self.away(x, i, node + 1) < self.away(x, i, node)
        return node

    def squares(self, x: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Squared distances of each point to the rows of its line of places."""
        out = np.zeros(place.shape)
        for own, column in zip(x, self.columns, strict=True):
            gap = column[place]
            gap -= own[:, None]
            out += np.multiply(gap, gap, out=gap)
        return out

    def reached(self, x: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Points and leaves within the squared ``reach`` of a point, by point; None where these are too many at once."""
        qi, node = np.arange(x.shape[1]), np.zeros(x.shape[1], np.int64)
        for level in range(1, self.levels + 1):
            qi, node = np.repeat(qi, 2), np.repeat(2 * node, 2)
            node[1::2] += 1
            near = self.away(x[:, qi], level, node) <= reach[qi]
            qi, node = qi[near], node[near]
            if len(qi) > LEAF_VISITS and x.shape[1] > 1:
                return None
        return qi, node


def _ranked(qi: np.ndarray, ri: np.ndarray, dist: np.ndarray, r_ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    order = np.lexsort((r_ids[ri], np.round(dist, DIGITS), qi))
    qi, ri, dist = qi[order], ri[order], dist[order]
    best = np.arange(len(qi)) - np.searchsorted(qi, qi, side="left") < k
    return qi[best], ri[best], dist[best]


def _hits(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same as ``np.nonzero`` of a matrix, about ten times as fast where few are true."""
    return np.divmod(np.flatnonzero(keep), keep.shape[1])


def _square(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), len(r)))
    for j in range(x.shape[1]):
        gap = x[:, j, None] - r[None, :, j]
        out += np.multiply(gap, gap, out=gap)
    return out


def _nearest_by_leaves(q, leaves: Leaves, r_ids, k, q_ids, bound) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same as ``nearest``: a query meets the leaves whose box is as near as the k-th row of the node it leads to.

    Many queries go down the tree side by side, neighbours next to one another.
    """
    ids = r_ids[leaves.order]
    first, size = leaves.starts[-1][:-1], np.diff(leaves.starts[-1])
    across = np.arange(int(size.max()))
    # a node with k rows for each query, its own ones apart
    level = max(0, leaves.levels - max(1, math.ceil(math.log2((2 * k + 2) / LEAF_ROWS))))

    def best(parts: list, rows: int) -> tuple[np.ndarray, ...]:
        qi, place, dist = (np.concatenate(c) for c in zip(*parts, strict=True))
        count = np.bincount(qi, minlength=rows)
        if len(parts) == 1 and len(qi) > 2 * k * rows and count.max() * rows <= LEAF_VISITS:
            # most are farther than the k-th: they need no order
            near = np.round(dist, DIGITS)
            table = np.full((rows, int(count.max())), np.inf)
            table[qi, np.arange(len(qi)) - np.repeat(np.cumsum(count) - count, count)] = near
            keep = near <= np.partition(table, k - 1, axis=1)[qi, k - 1]
            qi, place, dist = qi[keep], place[keep], dist[keep]
        return _ranked(qi, place, dist, ids, k)

    def meet(mine: np.ndarray, x: np.ndarray, reach: np.ndarray) -> list:
        met = leaves.reached(x, reach * reach)
        if met is None:
            half = len(mine) // 2
            return meet(mine[:half], x[:, :half], reach[:half]) + meet(mine[half:], x[:, half:], reach[half:])
        held, n = [], 0
        step = max(1, PASS_PAIRS // len(across))
        for s in range(0, len(met[0]), step):
            qi, leaf = (m[s : s + step] for m in met)
            place = first[leaf][:, None] + across
            inside = np.minimum(place, len(ids) - 1)
            keep = leaves.squares(x[:, qi], inside) <= (reach[qi] ** 2)[:, None]
            keep &= across < size[leaf][:, None]
            if q_ids is not None:
                keep &= ids[inside] != q_ids[mine[qi]][:, None]
            at, column = _hits(keep)
            place, qi = place[at, column], qi[at]
            gap = q[mine[qi]] - leaves.rows[place]
            held.append((qi, place, np.sqrt(np.einsum("ij,ij->i", gap, gap))))
            n += len(qi)
            if n > 2_000_000:
                # many rows are as near: the best so far go on
                held = [best(held, len(mine))]
                n = len(held[0][0])
        if not n:
            return []
        qi, place, dist = best([tuple(np.concatenate(c) for c in zip(*held, strict=True))] if len(held) > 1 else held, len(mine))
        return [(mine[qi], leaves.order[place], dist)]

    columns = np.ascontiguousarray(q.T)
    home = leaves.home(columns, level)
    order = np.argsort(home, kind="stable")
    begin, least = leaves.starts[level][:-1], int(np.diff(leaves.starts[level]).min())
    step, done = max(1, min(LEAF_QUERIES, LEAF_VISITS // least)), []
    for s in range(0, len(q), step):
        mine = order[s : s + step]
        x = np.ascontiguousarray(columns[:, mine])
        reach = np.full(len(mine), np.inf) if bound is None else bound[mine].astype(float)
        if k <= least:
            place = begin[home[mine]][:, None] + np.arange(least)
            square = leaves.squares(x, place) if level else _square(x.T, leaves.rows)
            if q_ids is not None:
                square[ids[place] == q_ids[mine][:, None]] = np.inf
            reach = np.minimum(reach, np.sqrt(np.partition(square, k - 1, axis=1)[:, k - 1]))
        # ranks are by rounded distances
        done += meet(mine, x, reach + 4e-9 + 1e-9 * reach)
    if not done:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    qi, ri, dist = (np.concatenate(c) for c in zip(*done, strict=True))
    whole = np.argsort(qi, kind="stable")
    return qi[whole], ri[whole], dist[whole]


def _nearest_by_blocks(q, r, r_ids, k, q_ids, bound) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same as ``nearest``: blocks of pairs that stay in the cache are ruled out by single-precision products.

    A product takes its whole rounding error off, so no pair that is near enough is ruled out; pairs that are left are measured
    by differences. The bounds become tighter as the rows that were met double in number.
    """
    width, middle = q.shape[1], r.mean(axis=0)
    # of |x|^2 + |r|^2: at least the rounding of the centred numbers, their products and sums
    error = 4.0 * (width + 8) * 2.0**-24
    # rows in any order but that of the table, whose beginning may be all alike
    order = np.random.default_rng(len(r)).permutation(len(r))

    def sided(x: np.ndarray, factor: float, norm_first: bool) -> np.ndarray:
        x = x - middle
        norm, one = (1.0 - error) * np.einsum("ij,ij->i", x, x)[:, None], np.ones((len(x), 1))
        return np.hstack([factor * x, *((norm, one) if norm_first else (one, norm))]).astype(np.float32)

    rows, ids = sided(r, 1.0, False)[order], r_ids[order]
    held_squares = np.empty(WIDE_QUERIES * WIDE_ROWS, np.float32)
    done = []
    for start in range(0, len(q), WIDE_QUERIES):
        x = q[start : start + WIDE_QUERIES]
        asked, own = sided(x, -2.0, True), None if q_ids is None else q_ids[start : start + WIDE_QUERIES]
        reach = np.full(len(x), np.inf) if bound is None else bound[start : start + WIDE_QUERIES].astype(float)
        held, n, tightened = [], 0, 0

        def measured(qi: np.ndarray, place: np.ndarray, x=x) -> np.ndarray:
            dist, step = np.empty(len(qi)), max(1, 1_000_000 // max(width, 1))
            for s in range(0, len(qi), step):
                gap = x[qi[s : s + step]] - r[order[place[s : s + step]]]
                dist[s : s + step] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
            return dist

        at = 0
        while at < len(r):
            end = min(at + WIDE_ROWS, len(r))
            square = held_squares[: len(x) * (end - at)].reshape(len(x), end - at)
            np.matmul(asked, rows[at:end].T, out=square)
            if at == 0 and end >= k and np.count_nonzero(square <= (reach**2)[:, None]) > 8 * k * len(x):
                if own is not None:
                    square[own[:, None] == ids[None, :end]] = np.inf
                some = np.argpartition(square, k - 1, axis=1)[:, :k]
                ends = measured(np.repeat(np.arange(len(x)), k), some.ravel()).reshape(len(x), k).max(axis=1)
                # a row's own one isn't a neighbour
                ends[~np.isfinite(np.take_along_axis(square, some, axis=1)).all(axis=1)] = np.inf
                reach = np.minimum(reach, ends)
            most = reach**2 + 4e-9 * (1.0 + reach)
            qi, place = _hits(square <= (most * (1.0 + 1e-6)).astype(np.float32)[:, None])
            place += at
            if own is not None:
                other = own[qi] != ids[place]
                qi, place = qi[other], place[other]
            if len(qi):
                dist = measured(qi, place)
                near = dist * dist <= most[qi]
                held.append((qi[near], place[near], dist[near]))
                n += len(held[-1][0])
            at = end
            if held and (at >= 2 * tightened or n > 2_000_000):
                qi, place, dist = _ranked(*(np.concatenate(c) for c in zip(*held, strict=True)), ids, k)
                full = np.bincount(qi, minlength=len(x)) >= k
                last = np.cumsum(np.bincount(qi, minlength=len(x))) - 1
                reach[full] = np.minimum(reach[full], dist[last[full]])
                held, n, tightened = [(qi, place, dist)], len(qi), at
        if held:
            qi, place, dist = _ranked(*(np.concatenate(c) for c in zip(*held, strict=True)), ids, k)
            done.append((qi + start, order[place], dist))
    if not done:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*done, strict=True))


def nearest(
    q: np.ndarray,
    r: np.ndarray,
    r_ids: np.ndarray,
    k: int,
    q_ids: np.ndarray | None = None,
    bound: np.ndarray | None = None,
    leaves: Leaves | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query index, reference index, distance)`` of the k nearest, in rank order per query.

    Candidates are found by the matrix product and then measured again by differences, since the
    product loses digits for close points. Many short vectors are met by leaves instead (``leaves``: those of ``r``, if
    they are known), which rules out nearly all pairs, and many longer ones in blocks of single precision. With ``q_ids`` a row is not its own neighbour. With
    ``bound``, a distance for each query, rows farther than that may be left out.
    """
    if len(q) * len(r) > LEAF_PAIRS and q.shape[1] == r.shape[1] and np.isfinite(q).all() and (leaves or Leaves.serve(r)):
        return _nearest_by_leaves(q, leaves or Leaves(r), r_ids, k, q_ids, bound)
    if len(q) * len(r) > WIDE_PAIRS and len(r) > k and q.shape[1] == r.shape[1] and max(np.abs(q).max(), np.abs(r).max()) < WIDE_MOST:
        return _nearest_by_blocks(q, r, r_ids, k, q_ids, bound)
    out_q, out_r, out_d = [], [], []
    if len(q) == 0 or len(r) == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(0)
    r_norm = np.einsum("ij,ij->i", r, r)
    chunk = max(1, min(2048, 4_000_000 // max(len(r), 1)))
    for start in range(0, len(q), chunk):
        x = q[start : start + chunk]
        x_norm = np.einsum("ij,ij->i", x, x)
        square = x_norm[:, None] + r_norm[None, :] - 2.0 * (x @ r.T)
        if q_ids is not None:
            square[q_ids[start : start + chunk, None] == r_ids[None, :]] = np.inf
        kth = np.full(len(x), np.inf) if bound is None else bound[start : start + chunk] ** 2
        # bounds that leave few rows need no rank
        if k < len(r) and np.count_nonzero(square <= kth[:, None]) > 8 * k * len(x):
            kth = np.minimum(kth, np.partition(square, k - 1, axis=1)[:, k - 1])
        edge = np.sqrt(np.maximum(np.where(np.isfinite(kth), kth, 0.0), 0.0))
        slack = 1e-10 * (x_norm + r_norm.max()) + 4e-9 * (1.0 + edge)
        keep = square <= (kth + slack)[:, None]
        if q_ids is not None:
            keep &= np.isfinite(square)
        qi, ri = _hits(keep)
        dist = np.empty(len(qi))
        step = max(1, 4_000_000 // max(q.shape[1], 1))
        for s in range(0, len(qi), step):
            gap = x[qi[s : s + step]] - r[ri[s : s + step]]
            dist[s : s + step] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        qi, ri, dist = _ranked(qi, ri, dist, r_ids, k)
        out_q.append(qi + start)
        out_r.append(ri)
        out_d.append(dist)
    return np.concatenate(out_q), np.concatenate(out_r), np.concatenate(out_d)


# --- shared helpers -------------------------------------------------------------------------


def drop_surplus_copies(ref: DataFrame, k: int, ref_id: str, features: str) -> DataFrame:
    """Keep the k smallest ids of each distinct vector.

    Below ``WINDOW_LIMIT`` Spark cuts each task's part to k rows before the shuffle. Beyond it the copies
    are first cut in salted groups, so that a hot vector isn't ranked by one task.
    """
    if k >= WINDOW_LIMIT:
        salted = Window.partitionBy(features, F.pmod(F.xxhash64(ref_id), F.lit(SALTS))).orderBy(ref_id)
        ref = ref.withColumn("__copy", F.row_number().over(salted)).filter(F.col("__copy") <= k).drop("__copy")
    rank = F.row_number().over(Window.partitionBy(features).orderBy(ref_id))
    return ref.withColumn("__copy", rank).filter(F.col("__copy") <= k).drop("__copy")


def _nn_type(ref: DataFrame, ref_id: str, carry: Sequence[str]) -> T.ArrayType:
    fields = [T.StructField("dist", T.DoubleType()), T.StructField("ref_id", ref.schema[ref_id].dataType)]
    fields += [T.StructField(c, ref.schema[c].dataType) for c in carry]
    return T.ArrayType(T.StructType(fields))


def _reference(ref: DataFrame, ref_id: str, features: str, carry: Sequence[str]) -> DataFrame:
    vec = F.col(features).cast("array<double>").alias("__rf")
    return ref.select(F.col(ref_id).alias("__rid"), vec, *[F.col(c).alias(f"__c_{c}") for c in carry])


# --- form A: broadcast reference ------------------------------------------------------------


def _collected(ref: DataFrame, ref_id: str, features: str, carry: Sequence[str]) -> tuple:
    """Vectors, ids and carried columns of the reference, and the leaves in whose order they lie, if there are any."""
    table = _reference(ref, ref_id, features, carry).orderBy("__rid").toArrow()
    matrix = to_matrix(table.column("__rf"))
    ids = table.column("__rid").to_numpy()
    carried = pa.table({c: table.column(f"__c_{c}").combine_chunks() for c in carry}) if carry else None
    leaves = None
    if len(matrix) and Leaves.serve(matrix):
        # the rows lie in the order of their leaves, so that they are held once
        leaves = Leaves(matrix)
        order, leaves.order = leaves.order, np.arange(len(matrix))
        matrix, ids, carried = leaves.rows, ids[order], carried and carried.take(pa.array(order)).combine_chunks()
    return matrix, ids, carried, leaves


def _broadcast_join(query, ref, k, query_id, ref_id, features, carry, exclude_self, held=None):
    kind = _nn_type(ref, ref_id, carry)
    struct = to_arrow_type(kind.elementType)
    held = {} if held is None else held
    # joins that run side by side collect one after the other: the driver holds one reference
    with _COLLECTING:
        if "state" not in held:
            held["state"] = query.sparkSession.sparkContext.broadcast(_collected(ref, ref_id, features, carry))
    state = held["state"]

    def ranked(x: pa.Array, own: np.ndarray | None) -> pa.Array:
        r, r_ids, extra, parts = state.value
        q = to_matrix(x)
        qi, ri, dist = nearest(q, r, r_ids, k, own, leaves=parts)
        offsets = np.searchsorted(qi, np.arange(len(q) + 1)).astype(np.int32)
        pick = pa.array(ri)
        cells = [pa.array(dist), pa.array(r_ids[ri], struct.field(1).type)]
        for i, c in enumerate(carry):
            cells.append(extra.column(c).combine_chunks().take(pick).cast(struct.field(2 + i).type))
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(cells, fields=list(struct)))

    if exclude_self:

        @F.arrow_udf(kind)
        def neighbours(x: pa.Array, own: pa.Array) -> pa.Array:
            return ranked(x, own.to_numpy(zero_copy_only=False))

        return query.withColumn("nn", neighbours(F.col(features).cast("array<double>"), F.col(query_id)))

    @F.arrow_udf(kind)
    def neighbours(x: pa.Array) -> pa.Array:
        return ranked(x, None)

    return query.withColumn("nn", neighbours(F.col(features).cast("array<double>")))


# --- form B: pivots, bounded blocks, triangle inequality ------------------------------------


class _Cells:
    """Pivots and block summaries; small, broadcast."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        self.block_cell = np.zeros(0, int)
        self.block_low = np.zeros(0)
        self.block_high = np.zeros(0)
        self.block_ids = np.zeros(0, np.int64)
        self.kth_within = np.full(len(pivots), np.inf)
        self.cuts: dict[int, np.ndarray] = {}

    def distances(self, x: np.ndarray) -> np.ndarray:
        square = (
            np.einsum("ij,ij->i", x, x)[:, None]
            + np.einsum("ij,ij->i", self.pivots, self.pivots)[None, :]
            - 2.0 * (x @ self.pivots.T)
        )
        return np.sqrt(np.maximum(square, 0.0))

    def routes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(query index, block id)`` of every block that may hold a neighbour."""
        to_pivot = self.distances(x)
        scale = np.sqrt(np.abs(x).max(initial=0.0) ** 2 * x.shape[1] + np.abs(self.pivots).max() ** 2 * x.shape[1])
        tolerance = 1e-6 * (1.0 + scale)
        # a cell with k rows within t of its pivot has k rows within d(q, pivot) + t of q
        reach = (to_pivot + self.kth_within[None, :]).min(axis=1)
        at = to_pivot[:, self.block_cell]
        bound = np.maximum(at - self.block_high[None, :], self.block_low[None, :] - at)
        qi, bi = np.nonzero(bound <= (reach + tolerance)[:, None])
        return qi, self.block_ids[bi]


def pick_pivots(ref: DataFrame, count: int, id_col: str = "__rid", features: str = "__rf") -> np.ndarray:
    """A reproducible sample of distinct vectors."""
    order = F.xxhash64(F.col(id_col), F.lit(17))
    rows = ref.orderBy(order, id_col).select(features).limit(count).collect()
    return np.unique(np.array([r[0] for r in rows], float), axis=0)


def routing(query: DataFrame, cells: _Cells, block_sizes: np.ndarray, features: str) -> tuple[int, float, float]:
    """Queries, the mean share of the reference one must be compared with, and the mean number of blocks.

    The means are over at most ``ROUTE_SAMPLE`` queries, the first by a hash of their vectors.
    """
    vector = F.col(features).cast("array<double>")
    told = query.select(vector.alias("x"), F.xxhash64(vector, F.lit(29)).alias("h"))
    rows = told.filter("x is not null").orderBy("h").limit(ROUTE_SAMPLE).select("x").toArrow()
    asked = query.count()
    if not rows.num_rows:
        return asked, 0.0, 0.0
    qi, block = cells.routes(to_matrix(rows.column("x")))
    return asked, float(block_sizes[block].sum() / block_sizes.sum() / rows.num_rows), len(block) / rows.num_rows


def tiling(asked: int, rows: int, width: int, query_rows: int, tasks: int, slice_rows: int = SLICE_ROWS) -> tuple[int, int]:
    """Groups of queries and slices of the reference.

    A group's vectors and lists (``width`` numbers a query) stay within ``GROUP_BYTES``; few queries make more groups, as long as each has 256. A table of many times
    ``query_rows`` or ``slice_rows`` has larger groups and slices instead of ever more copies of its rows.
    """
    held = max(1, GROUP_BYTES // (8 * max(width, 1)))
    wanted = min(math.ceil(asked / query_rows), max(COPIES, math.ceil(asked / QUERY_ROWS)))
    groups = max(math.ceil(asked / held), wanted, min(tasks, COPIES, math.ceil(asked / 256)), 1)
    return groups, max(1, min(math.ceil(rows / slice_rows), SLICES), math.ceil(rows / max(slice_rows, SLICE_ROWS)))


def held_numbers(ref: DataFrame, width: int, k: int, features: str, carry: Sequence[str]) -> int:
    """Numbers that a group holds for a query: its vector, and k neighbours with what they carry."""
    carried = sum(width if c == features else known_width(ref, c) or 1 for c in carry)
    return width + k * (3 + carried)


def copies_of(asked: int, query_rows: int) -> int:
    """Copies of a block that so many queries meet."""
    return max(1, min(math.ceil(asked / query_rows), max(COPIES, math.ceil(asked / QUERY_ROWS))))


def choose_form(
    asked: int, share: float, visits: float, groups: int, slices: int, rows: int, width: int, k: int, carried: int, query_rows: int
) -> str:
    """``tiles`` where blocks rule out less than half of the work and the tiles move fewer bytes, else ``pivots``."""
    if share < DENSE_SHARE:
        return "pivots"
    vector, entry = 8 * width + 24, 8 * (3 + carried)
    replicas = min(max(1.0, share * asked / query_rows), max(COPIES, share * asked / QUERY_ROWS))
    by_pivots = asked * visits * (vector + k * entry) + rows * vector * replicas
    merged = 0 if slices == 1 else asked * slices * k * entry
    by_tiles = asked * vector * slices + rows * vector * groups + merged
    return "tiles" if by_tiles < by_pivots else "pivots"


def _pivot_join(
    query, ref, k, query_id, ref_id, features, carry, exclude_self, rows, pivots, block_rows, query_rows, form, slice_rows, slim=None
):
    slim = query if slim is None else slim
    spark = query.sparkSession
    sc = spark.sparkContext
    base = _reference(ref, ref_id, features, carry)
    need = k + 1 if exclude_self else k
    count = pivots or int(min(2048, max(8, math.sqrt(rows))))
    block_rows = max(block_rows, math.ceil(rows / 1_000_000))  # block summaries stay small
    block_rows = max(block_rows, min(math.ceil(rows / COPIES), BLOCK_ROWS))
    cells = _Cells(pick_pivots(base, count))
    check_values(cells.pivots.size, "pivots")
    pivot_state = sc.broadcast(cells)

    @F.arrow_udf("struct<cell int, away double>")
    def home(x: pa.Array) -> pa.Array:
        d = pivot_state.value.distances(to_matrix(x)) if len(x) else np.zeros((0, 1))
        cell = d.argmin(axis=1) if len(d) else np.zeros(0, int)
        away = d[np.arange(len(d)), cell]
        return pa.StructArray.from_arrays([pa.array(cell.astype(np.int32)), pa.array(away)], ["cell", "away"])

    placed = base.withColumn("__h", home("__rf"))
    placed = placed.withColumns({"__cell": F.col("__h.cell"), "__away": F.col("__h.away")}).drop("__h")
    placed = materialize(placed, "knn-cells")
    tail = [i / RINGS for i in range(1, RINGS)]
    measured = placed.groupBy("__cell").agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("__away", tail, 4 * RINGS).alias("cuts")
    )
    sizes = {}
    for r in bounded_collect(measured, what="cells"):
        sizes[r["__cell"]] = r.n
        rings = min(RINGS, math.ceil(r.n / block_rows))
        cells.cuts[r["__cell"]] = np.unique([r.cuts[RINGS * i // rings - 1] for i in range(1, rings)])
    cut_state = sc.broadcast(cells.cuts)

    @F.arrow_udf("int")
    def ring(cell: pa.Array, away: pa.Array) -> pa.Array:
        c, a = cell.to_numpy(), away.to_numpy()
        out = np.zeros(len(c), np.int32)
        for own in np.unique(c):
            out[c == own] = np.searchsorted(cut_state.value[own], a[c == own])
        return pa.array(out)

    ringed = placed.withColumn("__ring", ring("__cell", "__away"))
    counted = bounded_collect(
        ringed.groupBy("__cell", "__ring").agg(
            F.count(F.lit(1)).alias("n"), F.min("__away").alias("lo"), F.max("__away").alias("hi")
        ),
        what="rings",
    )
    split, total = [], 0
    for r in sorted(counted, key=lambda r: (r["__cell"], r["__ring"])):
        pieces = math.ceil(r.n / (2 * block_rows))
        split.append((r["__cell"], r["__ring"], total, pieces, r.lo, r.hi, r.n))
        total += pieces
    check_values(total * 4, "blocks")
    plan = spark.createDataFrame(
        [row[:4] for row in split], "__cell int, __ring int, __first int, __parts int"
    )
    blocks = ringed.join(F.broadcast(plan), ["__cell", "__ring"]).withColumn(
        "__block", F.col("__first") + F.pmod(F.xxhash64("__rid"), F.col("__parts")).cast("int")
    )
    pieces = np.array([row[3] for row in split], int)

    def per_block(i: int) -> np.ndarray:
        return np.repeat([row[i] for row in split], pieces)

    cells.block_ids = np.arange(total)
    cells.block_cell, cells.block_low, cells.block_high = per_block(0), per_block(4), per_block(5)
    block_sizes = per_block(6) / per_block(3)
    if need < WINDOW_LIMIT:
        inner = F.row_number().over(Window.partitionBy("__cell").orderBy("__away", "__rid"))
        kth = placed.select("__cell", "__away", "__rid").withColumn("__n", inner).filter(F.col("__n") <= need)
        kth = kth.filter(F.col("__n") == need).select("__cell", "__away")
    else:
        big = [c for c, n in sizes.items() if n >= need]
        kth = placed.filter(F.col("__cell").isin(big)).groupBy("__cell").agg(F.max("__away").alias("__away"))
    for r in bounded_collect(kth, what="cells"):
        cells.kth_within[r["__cell"]] = r["__away"]
    if form is None:
        asked, share, visits = routing(slim, cells, block_sizes, features)
        width = cells.pivots.shape[1]
        held = held_numbers(ref, width, k, features, carry)
        groups, slices = tiling(asked, int(block_sizes.sum()), held, query_rows, sc.defaultParallelism)
        form = choose_form(asked, share, visits, groups, slices, int(block_sizes.sum()), width, k, len(carry), query_rows)
    if form == "tiles":
        stored = placed.select("__rid", "__rf", *[f"__c_{c}" for c in carry])
        return _tiled_join(
            query, ref, stored, k, query_id, ref_id, features, carry, exclude_self,
            cells.pivots.shape[1], query_rows, slice_rows, block_rows, slim,
        )
    route_state = sc.broadcast(cells)

    @F.arrow_udf("array<int>")
    def routes(x: pa.Array) -> pa.Array:
        if len(x) == 0:
            return pa.array([], pa.list_(pa.int32()))
        q = to_matrix(x)
        found_q, found_b = [], []
        step = max(1, 8_000_000 // max(len(route_state.value.block_ids), 1))
        for s in range(0, len(q), step):
            qi, block = route_state.value.routes(q[s : s + step])
            found_q.append(qi + s)
            found_b.append(block)
        qi, block = np.concatenate(found_q), np.concatenate(found_b)
        offsets = np.searchsorted(qi, np.arange(len(q) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(block.astype(np.int32)))

    # an id may stand on several rows with vectors of their own: a row is known by both
    vector = F.col(features).cast("array<double>")
    asked = slim.select(F.col(query_id).alias("__qid"), F.xxhash64(vector).alias("__qk"), vector.alias("__qf"))
    sent = asked.select("__qid", "__qk", "__qf", F.explode(routes("__qf")).alias("__block"))
    load = bounded_collect(
        sent.groupBy("__block").agg(F.count(F.lit(1)).alias("n")), limit=2_000_000, what="blocks"
    )
    copies = F.broadcast(
        spark.createDataFrame(
            [(r["__block"], copies_of(r.n, query_rows)) for r in load], "__block int, __copies int"
        )
    )
    sent = sent.join(copies, "__block").withColumn(
        "__copy", F.pmod(F.xxhash64("__qid", "__qk"), F.col("__copies")).cast("int")
    )
    blocks = blocks.join(copies, "__block").withColumn(
        "__copy", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1))
    )
    carried = [f"__c_{c}" for c in carry]
    out_schema = T.StructType(
        [T.StructField("__qid", query.schema[query_id].dataType), T.StructField("__qk", T.LongType())]
        + [T.StructField("__dist", T.DoubleType())]
        + [T.StructField("__rid", ref.schema[ref_id].dataType)]
        + [T.StructField(f"__c_{c}", ref.schema[c].dataType) for c in carry]
    )

    def partial(q: pa.Table, r: pa.Table) -> pa.Table:
        # equal rows ask once; all of them are in this group
        asked_by = zip(q.column("__qid").to_pylist(), q.column("__qk").to_pylist(), strict=True)
        q = q.take(pa.array(list({t: i for i, t in enumerate(asked_by)}.values()), pa.int64()))
        q_ids, r_ids = q.column("__qid").to_numpy(), r.column("__rid").to_numpy()
        q_keys = q.column("__qk").to_numpy()
        names = out_schema.fieldNames()
        if len(q_ids) == 0 or len(r_ids) == 0:
            return pa.table([pa.array([], to_arrow_type(f.dataType)) for f in out_schema], names=names)
        qi, ri, dist = nearest(
            to_matrix(q.column("__qf")), to_matrix(r.column("__rf")), r_ids, k, q_ids if exclude_self else None
        )
        cells_out = [pa.array(q_ids[qi]), pa.array(q_keys[qi]), pa.array(dist), pa.array(r_ids[ri])]
        pick = pa.array(ri)
        cells_out += [r.column(c).combine_chunks().take(pick) for c in carried]
        return pa.table(cells_out, names=names)

    grouped = sent.select("__block", "__copy", "__qid", "__qk", "__qf").groupBy("__block", "__copy")
    stored = blocks.select("__block", "__copy", "__rid", "__rf", *carried).groupBy("__block", "__copy")
    partials = grouped.cogroup(stored).applyInArrow(partial, out_schema)
    order = Window.partitionBy("__qid", "__qk").orderBy(F.round("__dist", DIGITS), "__rid")
    best = partials.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= k)
    entry = F.struct(
        F.col("__dist").alias("dist"),
        F.col("__rid").alias("ref_id"),
        *[F.col(f"__c_{c}").alias(c) for c in carry],
    )
    lists = best.groupBy("__qid", "__qk").agg(F.collect_list(F.struct("__rank", entry.alias("e"))).alias("l"))
    ranked = F.transform(F.array_sort("l"), lambda s: s["e"])
    return _attach(query, lists.select("__qid", "__qk", ranked.alias("nn")), query_id, vector, _nn_type(ref, ref_id, carry))


def _attach(query: DataFrame, lists: DataFrame, query_id: str, vector: Column, kind: T.ArrayType) -> DataFrame:
    """Query rows with their lists; a row is known by its id and its vector."""
    mine = F.col(query_id).eqNullSafe(F.col("__qid")) & F.xxhash64(vector).eqNullSafe(F.col("__qk"))
    joined = query.join(lists, mine, "left").drop("__qid", "__qk")
    return joined.withColumn("nn", F.coalesce("nn", F.array().cast(kind)))


# --- form C: groups of queries, tiles of the reference ---------------------------------------


def _tiled_join(
    query, ref, stored, k, query_id, ref_id, features, carry, exclude_self, width, query_rows, slice_rows, tile_rows, slim=None
):
    sc = query.sparkSession.sparkContext
    query = query.drop("nn")
    slim = query if slim is None else slim
    held = held_numbers(ref, width, k, features, carry)
    groups, slices = tiling(slim.count(), stored.count(), held, query_rows, sc.defaultParallelism, slice_rows)
    kind = _nn_type(ref, ref_id, carry)
    struct = to_arrow_type(kind.elementType)
    vector = F.col(features).cast("array<double>")
    key = F.xxhash64(vector)
    # one slice: the whole row travels and comes back complete; several, or ids and vectors apart: its key, for the merge of the lists
    merged = slices > 1 or slim is not query
    rows = [F.col(query_id).alias("__qid"), key.alias("__qk")] if merged else [F.col(f"`{c}`") for c in query.columns]
    payload = slim.select(*rows).schema
    group = F.pmod(F.xxhash64(F.col(query_id), key), F.lit(groups))
    own = F.col(query_id).alias("__own")
    none = [F.lit(None).cast(ref.schema[c].dataType).alias(f"__c_{c}") for c in carry]
    asked = slim.select(
        F.explode(F.sequence((group * slices).cast("int"), (group * slices + slices - 1).cast("int"))).alias("__slot"),
        F.lit(0).alias("__side"), F.struct(*rows).alias("__row"), own, vector.alias("__vec"),
        F.lit(None).cast(ref.schema[ref_id].dataType).alias("__rid"), *none,
    )
    piece = F.pmod(F.xxhash64("__rid"), F.lit(slices))
    passing = stored.select(
        F.explode(F.sequence(piece.cast("int"), (piece + slices * (groups - 1)).cast("int"), F.lit(slices))).alias("__slot"),
        F.lit(1).alias("__side"), F.lit(None).cast(payload).alias("__row"),
        F.lit(None).cast(query.schema[query_id].dataType).alias("__own"),
        F.col("__rf").alias("__vec"), "__rid", *[f"__c_{c}" for c in carry],
    )
    met = asked.unionByName(passing).repartitionById(groups * slices, F.col("__slot"))
    met = met.sortWithinPartitions("__slot", "__side")
    out_schema = T.StructType([*payload.fields, T.StructField("nn", kind)])
    out_type = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in out_schema])

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        return np.zeros((len(column), width)) if column.null_count == len(column) else to_matrix(column)

    def best_of(queries: list, tiles) -> object:
        """The lists of one group, after all tiles of one slice have passed."""
        held = pa.Table.from_batches(queries)
        q = matrix(held.column("__vec"))
        ids = held.column("__own").to_numpy() if exclude_self else None
        names = [f.name for f in struct]
        state = pa.table([pa.array([], f.type) for f in struct], schema=pa.schema(list(struct)))
        at, bound = np.zeros(0, np.int64), np.full(len(q), np.inf)
        for tile in tiles:
            r_ids = tile.column("__rid").to_numpy()
            qi, ri, dist = nearest(q, matrix(tile.column("__vec")), r_ids, k, ids, bound)
            picked = tile.take(pa.array(ri))
            found = [pa.chunked_array([pa.array(dist)]), *[picked.column(c) for c in ["__rid", *[f"__c_{c}" for c in carry]]]]
            found = [c.cast(f.type) for c, f in zip(found, struct, strict=True)]
            state = pa.concat_tables([state, pa.table(found, schema=pa.schema(list(struct)))])
            at = np.concatenate([at, qi])
            away = state.column(0).to_numpy()
            order = np.lexsort((state.column(1).to_numpy(), np.round(away, DIGITS), at))
            at = at[order]
            keep = np.arange(len(at)) - np.searchsorted(at, at) < k
            order, at = order[keep], at[keep]
            state = state.take(pa.array(order)).combine_chunks()
            full = np.searchsorted(at, np.arange(len(q))) + k - 1
            has = np.bincount(at, minlength=len(q)) >= k
            bound[has] = state.column(0).to_numpy()[full[has]]
        offsets = np.searchsorted(at, np.arange(len(q) + 1)).astype(np.int32)
        cells = [state.column(n).combine_chunks() for n in names]
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(cells, fields=list(struct)))
        told = held.column("__row").combine_chunks()
        done = pa.table([*told.flatten(), lists], names=out_type.names).cast(out_type)
        return done.to_batches(max_chunksize=4096)

    def run(batches):
        def runs():
            """Pieces of equal slot and side, in their order."""
            for b in batches:
                s, side = b.column("__slot").to_numpy(), b.column("__side").to_numpy()
                edges = np.flatnonzero(np.diff(s.astype(np.int64) * 2 + side)) + 1
                for lo, hi in zip([0, *edges], [*edges, len(s)], strict=True):
                    if hi > lo:
                        yield int(s[lo]), int(side[lo]), b.slice(lo, hi - lo)

        pieces = runs()
        ahead = next(pieces, None)
        while ahead is not None:
            slot, queries = ahead[0], []
            while ahead is not None and ahead[0] == slot and ahead[1] == 0:
                queries.append(ahead[2])
                ahead = next(pieces, None)

            def tiles(slot=slot):
                nonlocal ahead
                tile, n = [], 0
                while ahead is not None and ahead[0] == slot:
                    tile.append(ahead[2])
                    n += ahead[2].num_rows
                    ahead = next(pieces, None)
                    if n >= tile_rows:
                        yield pa.Table.from_batches(tile)
                        tile, n = [], 0
                if n:
                    yield pa.Table.from_batches(tile)

            if queries:
                yield from best_of(queries, tiles())
            else:
                for _ in tiles():
                    pass

    found = met.mapInArrow(run, out_schema)
    if not merged:
        return found
    # equal rows of a group have equal lists; one of them goes on
    entry = F.transform("nn", lambda e: F.struct(F.round(e["dist"], DIGITS).alias("d"), e["ref_id"].alias("i"), e.alias("e")))
    lists = found.groupBy("__qid", "__qk").agg(F.array_distinct(F.flatten(F.collect_list(entry))).alias("l"))
    ranked = F.transform(F.slice(F.array_sort("l"), 1, k), lambda s: s["e"])
    return _attach(query, lists.select("__qid", "__qk", ranked.alias("nn")), query_id, vector, kind)


def column_bytes(name: str, kind: T.DataType) -> Column:
    """About the bytes of a value once it is on the driver and in every task."""
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.size(name).cast("long") * 8, F.lit(0)) + 24
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(name).cast("long"), F.lit(0)) + 16
    return F.lit(16).cast("long")


def reference_bytes(ref: DataFrame, *columns: str) -> tuple[int, int]:
    """Rows, and the bytes of the vectors and of everything carried with them."""
    size = sum((column_bytes(c, ref.schema[c].dataType) for c in columns), F.lit(16).cast("long"))
    row = ref.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b")).first()
    return row.n, row.b or 0


def knn_join(
    query: DataFrame,
    ref: DataFrame,
    k: int = 19,
    *,
    query_id: str = "row_id",
    ref_id: str = "row_id",
    features: str = "features",
    carry: Sequence[str] = (),
    exclude_self: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
    pivots: int | None = None,
    block_rows: int = 20_000,
    query_rows: int = 50_000,
    slice_rows: int = SLICE_ROWS,
    form: str | None = None,
    held: dict | None = None,
    asked: DataFrame | None = None,
) -> DataFrame:
    """Add the k nearest reference rows of every query row as column ``nn``.

    ``form`` (``pivots`` or ``tiles``) settles what else is measured beyond the broadcast bound. Joins with one reference,
    k and columns may share ``held``, a dictionary of the caller's: the reference is then measured and collected once.
    ``asked`` has ids and vectors of ``query``, for a query table that is long work: beyond the broadcast bound they are
    read several times, and ``query`` once.
    """
    k = valid_k(k)
    if k < 1:
        raise ValueError("k must be at least 1")
    ref = ref.select(*dict.fromkeys([ref_id, features, *carry]))
    slim = drop_surplus_copies(ref, k + 1 if exclude_self else k, ref_id, features)
    held = {} if held is None else held
    if "bytes" not in held:
        held["bytes"] = reference_bytes(ref, *dict.fromkeys([features, *carry]))
    rows, size = held["bytes"]
    if size <= broadcast_bytes:
        joined = _broadcast_join(query, ref, k, query_id, ref_id, features, carry, exclude_self, held)
    else:
        joined = _pivot_join(
            query, slim, k, query_id, ref_id, features, carry, exclude_self, rows, pivots, block_rows, query_rows, form, slice_rows, asked
        )
    width = known_width(query, features)
    return with_width(joined, features, width) if width else joined


def neighbour_pairs(joined: DataFrame, query_id: str = "row_id") -> DataFrame:
    """Long form: ``query_id, rank, ref_id, dist`` (narrow, no shuffle)."""
    return joined.select(query_id, F.posexplode("nn").alias("rank", "e")).select(
        query_id, (F.col("rank") + 1).alias("rank"), F.col("e.ref_id").alias("ref_id"), F.col("e.dist").alias("dist")
    )


def kth_distance(nn="nn"):
    """Distance of the farthest of the k neighbours."""
    return F.array_max(F.transform(nn, lambda e: e["dist"]))


# --- approximate form -----------------------------------------------------------------------


def first_met(q: np.ndarray, r: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Groups of queries, and the rows that share no earlier bucket with them. ``q`` and ``r`` are buckets in the earlier tables.

    Where nearly every query has buckets of its own, all are met at once: pairs that were met before are then found again.
    """
    group, of = np.unique(q, axis=0, return_inverse=True) if q.shape[1] else (q[:1], np.zeros(len(q), int))
    if len(group) > max(16, len(q) // WIDE_QUERIES):
        return [(np.arange(len(q)), np.arange(len(r)))]
    return [(np.flatnonzero(of.ravel() == i), np.flatnonzero(~(r == own).any(axis=1))) for i, own in enumerate(group)]


def lsh_neighbours(
    query: DataFrame,
    ref: DataFrame,
    k: int,
    radius: float,
    *,
    bucket_length: float,
    tables: int = 4,
    row_id: str = "row_id",
    features: str = "features",
    seed: int = 17,
) -> DataFrame:
    """Approximate neighbours within ``radius`` by random-projection hashing.

    Candidates are those sharing a bucket; the exact distance is then checked, in the first table in which a pair shares one.
    Misses are possible, false hits are not. Returns ``row_id, rank, ref_id, dist``.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    def prepared(df, name):
        vec = F.col(features).cast("array<double>")
        return df.select(F.col(row_id).alias(name), vec.alias("x"), array_to_vector(vec).alias("v"))

    lsh = BucketedRandomProjectionLSH(
        inputCol="v", outputCol="h", bucketLength=bucket_length, numHashTables=tables, seed=seed
    )
    reference = prepared(drop_surplus_copies(ref.select(row_id, features), k, row_id, features), "ref_id")
    model = lsh.fit(reference)

    def bucketed(df: DataFrame, name: str) -> DataFrame:
        buckets = F.array(*[F.get(vector_to_array(F.get("h", F.lit(i))), F.lit(0)) for i in range(tables)])
        return model.transform(df).select(name, "x", buckets.alias("all")).select(name, "x", "all", F.posexplode("all").alias("table", "bucket"))

    asked, kept = bucketed(prepared(query, "q"), "q"), bucketed(reference, "ref_id")
    # a bucket of many rows is met in pieces: queries by reference rows, each within a task's share
    cell = ["table", "bucket"]
    load = asked.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).join(kept.groupBy(*cell).agg(F.count(F.lit(1)).alias("m")), cell)
    pieces = load.select(
        *cell, F.ceil(F.col("n") / F.lit(float(QUERY_ROWS))).alias("groups"), F.ceil(F.col("m") / F.lit(float(2 * QUERY_ROWS))).alias("parts")
    )
    asked, kept = asked.join(pieces, cell), kept.join(pieces, cell)
    group, part = F.pmod(F.xxhash64("q", "x"), F.col("groups")), F.pmod(F.xxhash64("ref_id", "x"), F.col("parts"))
    asked = asked.select(*cell, group.alias("group"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "q", "x", "all")
    kept = kept.select(*cell, F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("group"), part.alias("part"), "ref_id", "x", "all")
    out_schema = T.StructType(
        [T.StructField("q", query.schema[row_id].dataType), T.StructField("ref_id", ref.schema[row_id].dataType), T.StructField("dist", T.DoubleType())]
    )
    kinds = [to_arrow_type(f.dataType) for f in out_schema]

    def met(q: pa.Table, r: pa.Table) -> pa.Table:
        names = out_schema.fieldNames()
        if not q.num_rows or not r.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        q_ids, r_ids = q.column("q").to_numpy(), r.column("ref_id").to_numpy()
        x, r_x = to_matrix(q.column("x")), to_matrix(r.column("x"))
        table = q.column("table")[0].as_py()
        found = []
        for mine, other in first_met(to_matrix(q.column("all"))[:, :table], to_matrix(r.column("all"))[:, :table]):
            bound = np.full(len(mine), float(radius))
            qi, ri, dist = nearest(x[mine], r_x[other], r_ids[other], k, bound=bound)
            near = dist < radius
            found.append((q_ids[mine[qi[near]]], r_ids[other[ri[near]]], dist[near]))
        return pa.table([pa.array(np.concatenate(c), t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

    slot = [*cell, "group", "part"]
    found = asked.groupBy(*slot).cogroup(kept.groupBy(*slot)).applyInArrow(met, out_schema)
    # a pair that shares several buckets is found in each
    entry = F.struct(F.round("dist", DIGITS).alias("dist"), "ref_id")
    lists = found.groupBy(F.col("q").alias(row_id)).agg(F.slice(F.array_sort(F.array_distinct(F.collect_list(entry))), 1, k).alias("l"))
    ranked = lists.select(row_id, F.posexplode("l").alias("rank", "e"))
    return ranked.select(row_id, (F.col("rank") + 1).alias("rank"), "e.ref_id", "e.dist")
