"""Ranked lexical search: dense tiles of item weights times document impacts, exact in float64, with a top-k of each tile."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doubtline.llm.common import frame_batch, id_and_text, map_batches
from doubtline.session import materialize

#: Maximal runs of ASCII letters and digits and of all characters beyond ASCII, over lower-cased bytes.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
TOP = 10
#: An impact is below this, so a partial sum of weights times impacts is below the weights' sum times this.
IMPACT = 10**6
EXACT = 2**53
#: Documents and terms of a tile, and cells of an item tile's weights.
TILE_DOCS, TILE_TERMS, TILE_CELLS = 1024, 1024, 1 << 21
#: Bytes of items searched in one pass over the documents; a larger table of items takes several.
PART_BYTES = 16 << 20
#: Groups that merge an item's lists of many tasks before the last merge.
MERGE_GROUPS = 64


def terms_of(text: str | None) -> list[bytes]:
    """All terms of a text in order, only A to Z lower-cased."""
    return TERM.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


class Items:
    """The terms of some items as numbers: each item's distinct terms, one item after the other."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        self.ids = [i for i, _ in rows]
        held = [sorted(set(terms_of(t))) for _, t in rows]
        self.term = {t: k for k, t in enumerate(sorted(set().union(*held)))}
        self.start = np.cumsum([0, *map(len, held)])
        self.terms = np.array([self.term[t] for terms in held for t in terms], np.int64)

    def tiles(self, cells: int = TILE_CELLS) -> Iterator[tuple[int, int, np.ndarray]]:
        """Runs of items with their own compact vocabulary, whose weight matrix has about ``cells`` cells at most."""
        first, vocabulary = 0, np.zeros(0, np.int64)
        for item in range(len(self.ids)):
            own = self.terms[self.start[item] : self.start[item + 1]]
            joined = np.union1d(vocabulary, own)
            if item > first and (item + 1 - first) * len(joined) > cells:
                yield first, item, vocabulary
                first, joined = item, own
            vocabulary = joined
        if len(self.ids):
            yield first, len(self.ids), vocabulary


def term_weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def impacts(tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """``(10**9 * tf) div (1000 * tf + 8 * m)`` in whole numbers, where m follows from a document's length."""
    if len(length) and 90 * int(length.max()) * n_docs >= 2**63:
        m = np.array([10 + 90 * int(n) * n_docs // n_terms for n in length.tolist()], np.int64)
    else:
        m = 10 + 90 * length * n_docs // n_terms
    return 10**9 * tf // (1000 * tf + 8 * m)


def vocabulary_tiles(weights: np.ndarray, most: int = TILE_TERMS) -> Iterator[tuple[int, int]]:
    """Runs of at most ``most`` terms, whose partial sums, whatever the item and the document, stay below 2**53."""
    start, total = 0, 0
    for k, w in enumerate(weights.tolist()):
        if k > start and (k - start >= most or (total + w) * IMPACT >= EXACT):
            yield start, k
            start, total = k, 0
        total += w
    if len(weights):
        yield start, len(weights)


class Best:
    """The best rows of each item so far: by score, then by id, null ids last."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.floor = np.ones(items, np.int64)  # the least score that can still enter; ties with it can
        self.item, self.score, self.doc, self.none = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))

    def add(self, first: int, scores: np.ndarray, doc: np.ndarray, none: np.ndarray) -> None:
        """A tile of scores, items from ``first`` on by documents. All ties with a tile's last place go on."""
        floor = self.floor[first : first + len(scores), None]
        if scores.shape[1] > self.top:
            floor = np.maximum(floor, np.partition(scores, -self.top, axis=1)[:, -self.top][:, None])
        item, place = np.nonzero(scores >= floor)
        if not len(item):
            return
        item_, score = np.concatenate([self.item, item + first]), np.concatenate([self.score, scores[item, place]])
        doc_, none_ = np.concatenate([self.doc, doc[place]]), np.concatenate([self.none, none[place]])
        order = np.lexsort((doc_, none_, -score, item_))
        sorted_item = item_[order]
        rank = np.arange(len(order)) - np.searchsorted(sorted_item, sorted_item)
        order = order[rank < self.top]
        self.item, self.score, self.doc, self.none = item_[order], score[order], doc_[order], none_[order]
        full = rank == self.top - 1
        self.floor[sorted_item[full]] = np.maximum(self.floor[sorted_item[full]], self.score[np.flatnonzero(rank[rank < self.top] == self.top - 1)])


def scores_of(items: Items, weights: np.ndarray, tile: tuple[int, int, np.ndarray], term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_docs: int) -> np.ndarray:
    """Items of a tile by documents: the sum over vocabulary tiles of dense weights times dense impacts.

    Each product is a float64 matrix product of whole numbers whose partial sums are all below 2**53, so it is exact in
    whatever order it adds; the tiles are then added as 64-bit integers.
    """
    first, last, vocabulary = tile
    scores = np.zeros((last - first, n_docs), np.int64)
    place = np.searchsorted(vocabulary, term)
    inside = np.flatnonzero(vocabulary[np.minimum(place, len(vocabulary) - 1)] == term) if len(vocabulary) else np.zeros(0, np.int64)
    if not len(inside):
        return scores
    # only the terms that some document of the tile has
    used, place = np.unique(place[inside], return_inverse=True)
    doc, impact = doc[inside], impact[inside].astype(np.float64)
    compact = np.full(len(vocabulary), -1)
    compact[used] = np.arange(len(used))
    own = items.terms[items.start[first] : items.start[last]]
    row = np.repeat(np.arange(last - first), np.diff(items.start[first : last + 1]))
    column = compact[np.searchsorted(vocabulary, own)]
    known = column >= 0
    dense = np.zeros((last - first, len(used)))
    dense[row[known], column[known]] = weights[own[known]]
    order = np.argsort(place, kind="stable")
    place, doc, impact = place[order], doc[order], impact[order]
    for a, b in vocabulary_tiles(weights[vocabulary[used]]):
        lo, hi = np.searchsorted(place, [a, b])
        block = np.zeros((b - a, n_docs))
        block[place[lo:hi] - a, doc[lo:hi]] = impact[lo:hi]
        scores += (dense[:, a:b] @ block).astype(np.int64)
    return scores


_COUNTED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("term", pa.list_(pa.int32())), ("tf", pa.list_(pa.int64()))])
_TOPS = pa.schema([("item", pa.int32()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def count_terms(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, term, tf`` of each row with a term: how many it has, and which of the vocabulary how often. No shuffle."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, sizes, terms, tfs = [], [], [], []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found = terms_of(text)
            if found:
                counts = Counter(map(vocabulary.get, found))
                counts.pop(None, None)
                ids.append(doc_id)
                sizes.append(len(found))
                terms.append(list(counts))
                tfs.append(list(counts.values()))
        return frame_batch(_COUNTED, doc_id=ids, n=sizes, term=terms, tf=tfs)

    return map_batches(id_and_text(docs), run, "doc_id long, n long, term array<int>, tf array<long>")


def _tile_tops(items: Items, weights: np.ndarray, n_docs: int, n_terms: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, tiles = Best(len(items.ids), top), list(items.tiles())
        for whole in batches:
            for at in range(0, whole.num_rows, TILE_DOCS):
                batch = whole.slice(at, TILE_DOCS)
                held = batch.column("term")
                sizes = held.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                doc = np.repeat(np.arange(batch.num_rows), sizes)
                term = held.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                tf = batch.column("tf").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                length = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
                impact = impacts(tf, length[doc], n_docs, n_terms)
                ids = batch.column("doc_id")
                none, number = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
                for tile in tiles:
                    best.add(tile[0], scores_of(items, weights, tile, term, doc, impact, batch.num_rows), number, none)
        if len(best.item):
            names = [items.ids[k] for k in best.item.tolist()]
            yield frame_batch(_TOPS, item=best.item.astype(np.int32), item_id=names, doc_id=pa.array(best.doc, pa.int64(), mask=best.none), score=best.score)

    return run


def _merged(tops: DataFrame, top: int, *keys) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return tops.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, part_bytes: int = PART_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` best documents of each item, equal scores by id, scores of 0 left out.

    ``docs`` has ``doc_id, text``, ``items`` has ``item_id, text``. The documents' terms are counted once for the items'
    vocabulary and written to the shared folder; from there come the numbers of all documents (with a term, their terms,
    document frequencies) and the tiles. A task multiplies tiles of documents with tiles of items and keeps the best of each
    item; the short lists of the tasks are merged in two steps. Items beyond ``part_bytes`` of text take one such pass for
    each part, with the same results.

    A null or empty text has no terms: such a document isn't counted, such an item finds nothing. Null doc_ids come after all
    numbers. Each row is a document, each row of ``items`` an item of its own, repeated or not; further columns are ignored.
    """
    named = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-int(size) // part_bytes))
    out = None
    for part in range(parts):
        rows = named.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").collect()
        here = Items([(r.item_id, r.text) for r in rows])
        counted = materialize(count_terms(docs, here.term), "term_counts")
        n_docs, n_terms = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
        df = np.zeros(len(here.term), np.int64)
        for r in counted.select(F.explode("term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect():
            df[r.term] = r.df
        found = counted.mapInArrow(_tile_tops(here, term_weights(df, n_docs), n_docs, n_terms or 1, top), "item int, item_id long, doc_id long, score long")
        tops = materialize(found, "tile_tops").withColumn("part", F.lit(part))
        out = tops if out is None else out.unionByName(tops)
    group = F.pmod(F.xxhash64("doc_id"), F.lit(MERGE_GROUPS))
    merged = _merged(_merged(out, top, "part", "item", group), top, "part", "item")
    return merged.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL),
q AS (
  SELECT i, item_id, unnest(list_distinct(terms)) AS t
  FROM (SELECT row_number() OVER () AS i, item_id,
               regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
        FROM benchmark WHERE text IS NOT NULL)),
total AS (SELECT count(*)::BIGINT AS n, sum(len(terms))::BIGINT AS l FROM d WHERE len(terms) > 0),
tf AS (SELECT r, doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS t FROM d) GROUP BY ALL),
weight AS (SELECT t, floor(1000 * ln((2 * total.n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY t, total.n),
scored AS (
  SELECT i, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * tf.n * total.n) // total.l))))::BIGINT AS score
  FROM q JOIN tf USING (t) JOIN weight USING (t), total GROUP BY i, item_id, r, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
