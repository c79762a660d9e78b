"""Benchmark decontamination: a BM25 index of test items that every training passage queries by block-max WAND."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doubtline.llm.common import frame_batch, id_and_text, map_batches

#: A passage retrieves an item from this share of the item's own score on.
THRESHOLD = 0.5
#: Shares of the question's and the answer's word triples that have to stand in the passage, or of both together.
OVERLAP, TOTAL_OVERLAP = 0.5, 0.5
K1, B = 1.2, 0.75
#: Items under one block maximum; terms in more than this share of the items aren't followed when blocks are ruled out.
BLOCK_ITEMS, COMMON = 2, 0.3
#: Words of a cell at least; a passage is two cells, and a cell is no shorter than the longest item.
CELL_WORDS = 64
#: Bytes of items in one index; a larger benchmark is dealt over several, each of which all passages query.
INDEX_BYTES = 16 << 20
CACHE_WORDS, CACHE_CHARS = 400_000, 48
GRAM = 3

EDGE = re.compile(r"^[\W_]+|[\W_]+$")
ANSWER = re.compile(r"(?:^|\n|\s)(?:answer|réponse|antwort|respuesta)\s*:|\n\s*A\s*:", re.I)
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def words_of(text: str) -> list[str]:
    """Words between white space, lower-cased, without signs at their ends; a word of signs alone is empty."""
    return [EDGE.sub("", w) for w in text.lower().split()]


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The words of the two parts of an item: cut at an answer mark, else before the last sentence, else in the middle."""
    found = [m for m in ANSWER.finditer(text)]
    if found and words_of(text[: found[-1].start()]) and words_of(text[found[-1].end() :]):
        parts = text[: found[-1].start()], text[found[-1].end() :]
    else:
        sentences = [s for s in SENTENCE.split(text) if any(words_of(s))]
        parts = (" ".join(sentences[:-1]), sentences[-1]) if len(sentences) > 1 else ("", "")
    question, answer = ([w for w in words_of(p) if w] for p in parts)
    if not question or not answer:
        both = [w for w in words_of(text) if w]
        question, answer = both[: (len(both) + 1) // 2], both[(len(both) + 1) // 2 :]
    return question, answer


def grams(words: list[str]) -> set[tuple[str, ...]]:
    size = min(GRAM, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if size else set()


@dataclass
class Corpus:
    """Numbers over all items: how many, their words, the longest one, and how many items have a word."""

    n: int
    words: int
    longest: int
    held: dict[str, int]

    @staticmethod
    def of(texts: Iterable[list[str]]) -> Corpus:
        sizes, held = [], Counter()
        for words in texts:
            sizes.append(len(words))
            held.update(set(words))
        return Corpus(len(sizes), sum(sizes), max(sizes, default=0), held)


class ItemIndex:
    """Postings of test items with impacts, their maxima by term and by block, and the items' parts.

    An impact is the BM25 weight of a term in an item, divided by the weight of the whole item, so an item that stands in a
    passage scores 1 whatever its length.
    """

    def __init__(self, items: list[tuple[int | None, str]], corpus: Corpus | None = None):
        texts = [(i, [w for w in words_of(t) if w], question_and_answer(t)) for i, t in items]
        texts = [x for x in texts if x[1]]
        self.ids = [x[0] for x in texts]
        self.parts = [(grams(q), grams(a), len(q), len(a)) for _, _, (q, a) in texts]
        n = len(texts)
        counts = [Counter(x[1]) for x in texts]
        corpus = corpus or Corpus.of(x[1] for x in texts)
        held = {w: corpus.held[w] for w in set().union(*counts)}
        mean, self.longest = corpus.words / max(corpus.n, 1), corpus.longest
        self.cell = max(CELL_WORDS, self.longest)
        idf = {w: math.log(1 + (corpus.n - d + 0.5) / (d + 0.5)) for w, d in held.items()}
        self.term = {w: k for k, w in enumerate(sorted(held))}
        postings: list[list[tuple[int, float]]] = [[] for _ in self.term]
        for item, c in enumerate(counts):
            norm = K1 * (1 - B + B * sum(c.values()) / mean)
            weight = {w: idf[w] * f * (K1 + 1) / (f + norm) for w, f in c.items()}
            whole = math.fsum(weight.values())
            for w in c:
                postings[self.term[w]].append((item, weight[w] / whole))
        self.postings = postings
        self.most = [max(x for _, x in p) for p in postings]
        self.blocks = -(-n // BLOCK_ITEMS)
        block_most: list[dict[int, float]] = []
        for p in postings:
            best: dict[int, float] = {}
            for item, x in p:
                best[item // BLOCK_ITEMS] = max(best.get(item // BLOCK_ITEMS, 0.0), x)
            block_most.append(best)
        self.block_most = block_most
        # common terms: what they can add to a block at most, whatever the passage
        common = [len(p) > max(2, COMMON * n) for p in postings]
        self.floor = np.zeros(self.blocks)
        for best, skip in zip(block_most, common, strict=True):
            if skip:
                for block, x in best.items():
                    self.floor[block] += x
        rare = [[] if skip else sorted(best.items()) for best, skip in zip(block_most, common, strict=True)]
        self.size = np.array([len(r) for r in rare], np.int64)
        self.start = np.cumsum(np.concatenate([[0], self.size]))[:-1] if len(rare) else np.zeros(0, np.int64)
        self.block = np.array([b for r in rare for b, _ in r], np.int64)
        self.bound = np.array([x for r in rare for _, x in r])

    def search(self, terms: list[int], threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """All items that score ``threshold`` or more for a set of terms, by block-max WAND.

        Cursors stand in order of their items. The pivot is the first item at which the greatest impacts of the terms so far
        add up to the threshold; if the block maxima at the pivot don't, all cursors before it pass the nearest block end;
        else the item is scored once every cursor up to the pivot has reached it.
        """
        threshold -= 1e-9
        found: list[tuple[int, float]] = []
        lists, at = [self.postings[t] for t in terms], [0] * len(terms)
        live = list(range(len(terms)))
        while True:
            live = [k for k in live if at[k] < len(lists[k])]
            live.sort(key=lambda k: lists[k][at[k]][0])
            reach, pivot = 0.0, -1
            for place, k in enumerate(live):
                reach += self.most[terms[k]]
                if reach >= threshold:
                    pivot = place
                    break
            if pivot < 0:
                return found
            item = lists[live[pivot]][at[live[pivot]]][0]
            while pivot + 1 < len(live) and lists[live[pivot + 1]][at[live[pivot + 1]]][0] == item:
                pivot += 1
            block = item // BLOCK_ITEMS
            if math.fsum(self.block_most[terms[k]].get(block, 0.0) for k in live[: pivot + 1]) < threshold:
                # up to the end of this block, or to the next item of a cursor that took no part
                target = (block + 1) * BLOCK_ITEMS
                if pivot + 1 < len(live):
                    target = min(target, lists[live[pivot + 1]][at[live[pivot + 1]]][0])
                for k in live[: pivot + 1]:
                    while at[k] < len(lists[k]) and lists[k][at[k]][0] < target:
                        at[k] += 1
            elif lists[live[0]][at[live[0]]][0] == item:
                score = math.fsum(lists[k][at[k]][1] for k in live[: pivot + 1])
                if score >= threshold:
                    found.append((item, score))
                for k in live[: pivot + 1]:
                    at[k] += 1
            else:
                for k in live[: pivot + 1]:
                    while at[k] < len(lists[k]) and lists[k][at[k]][0] < item:
                        at[k] += 1

    def verify(self, item: int, words: list[str]) -> tuple[float, float, bool]:
        """The shares of the question and the answer in a passage, and if they are enough."""
        question, answer, n, m = self.parts[item]
        sizes = {len(next(iter(g))) for g in (question, answer) if g}
        have = {size: {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} for size in sizes}
        q, a = (len(g & have[len(next(iter(g)))]) / len(g) if g else 0.0 for g in (question, answer))
        return q, a, (q >= OVERLAP and (a >= OVERLAP or not answer)) or (n * q + m * a) / (n + m) >= TOTAL_OVERLAP


class _Terms(dict):
    """Raw word to the number of its term, -1 for a word that no item has."""

    def __init__(self, index: ItemIndex):
        super().__init__()
        self.term = index.term

    def __missing__(self, raw: str) -> int:
        value = self.term.get(EDGE.sub("", raw.lower()), -1)
        if len(raw) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[raw] = value
        return value


def open_passages(index: ItemIndex, words: np.ndarray, cuts: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
    """(text, first word, end) of the passages with a block of items whose maxima can reach the threshold.

    ``words`` holds the terms of some texts one after the other, ``cuts`` their n + 1 bounds. Each text is dealt into cells;
    a passage is a cell and the next. Its distinct terms add their block maxima, and common terms their floor: no passage is
    left out that the search would find anything for.
    """
    sizes = np.diff(cuts)
    cells = -(-sizes // index.cell)
    first = np.cumsum(np.concatenate([[0], cells]))
    text = np.repeat(np.arange(len(sizes)), sizes)
    cell = first[text] + (np.arange(len(words)) - cuts[text]) // index.cell
    known = words >= 0
    vocabulary = max(len(index.term), 1)
    pairs = np.unique(cell[known] * vocabulary + words[known])
    ahead = np.searchsorted(pairs, pairs + vocabulary)
    again = pairs[np.minimum(ahead, len(pairs) - 1)] == pairs + vocabulary  # the next cell has the term, too
    cell, term = pairs // vocabulary, pairs % vocabulary
    total, out = int(first[-1]), []
    step = max(1, (1 << 22) // max(index.blocks, 1))
    owner = np.repeat(np.arange(len(sizes)), cells)
    for a in range(0, total, step):
        b = min(a + step + 1, total)  # one more, for the passage that starts with the last cell
        lo, hi = np.searchsorted(cell, [a, b])
        size = index.size[term[lo:hi]]
        place = np.repeat(index.start[term[lo:hi]] - np.cumsum(size) + size, size) + np.arange(size.sum())
        key = np.repeat(cell[lo:hi] - a, size) * index.blocks + index.block[place]
        reach = np.bincount(key, index.bound[place], (b - a) * index.blocks).reshape(b - a, index.blocks)
        paired = np.zeros(b - a, bool)
        paired[:-1] = owner[a + 1 : b] == owner[a : b - 1]
        twice = np.repeat(again[lo:hi], size)
        both = reach - np.bincount(key[twice], index.bound[place[twice]], (b - a) * index.blocks).reshape(b - a, index.blocks)
        both[:-1] += reach[1:]
        both = np.where(paired[:, None], both, reach)
        usable = paired | (cells[owner[a:b]] == 1)
        usable[step:] = False
        for c in np.flatnonzero(usable & (both + index.floor >= threshold - 1e-9).any(1)).tolist():
            k = int(owner[a + c])
            start = (a + c - int(first[k])) * index.cell
            out.append((k, start, min(start + 2 * index.cell, int(sizes[k]))))
    return out


def searcher(index: ItemIndex, threshold: float = THRESHOLD) -> Callable[[list[str | None]], list[dict[int, tuple[float, float, float, bool]]]]:
    """A function of texts that gives for each the items retrieved: number to (score, question, answer, verified), of its best passage."""
    memo: list[_Terms] = []

    def search(texts: list[str | None]) -> list[dict[int, tuple[float, float, float, bool]]]:
        found: list[dict[int, tuple[float, float, float, bool]]] = [{} for _ in texts]
        if not index.ids:
            return found
        if not memo:
            memo.append(_Terms(index))
        known = memo[0].__getitem__
        lists = [np.fromiter(map(known, raw), np.int64, len(raw)) for raw in ((t or "").split() for t in texts)]
        cuts = np.cumsum([0, *map(len, lists)])
        words = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        split: dict[int, list[str]] = {}
        for k, start, end in open_passages(index, words, cuts, threshold):
            inside = words[cuts[k] + start : cuts[k] + end]
            hits = index.search(np.unique(inside[inside >= 0]).tolist(), threshold)
            if not hits:
                continue
            if k not in split:
                split = {k: words_of(texts[k])}  # passages come text by text
            passage = [w for w in split[k][start:end] if w]
            for item, score in hits:
                q, a, ok = index.verify(item, passage)
                if item not in found[k] or (ok, q + a, score) > (found[k][item][3], found[k][item][1] + found[k][item][2], found[k][item][0]):
                    found[k][item] = (score, q, a, ok)
        return found

    return search


def indexes(items: DataFrame, index_bytes: int = INDEX_BYTES) -> list[ItemIndex]:
    """Indexes over all items (``item_id, text``), each of about ``index_bytes`` of text at most and of whole items.

    Items without words can't be found and are left out; null ids stay null. The items of a large benchmark are dealt by a
    hash; item count, lengths and document frequencies are those of all items, summed by Spark, so the parts don't show.
    """
    slim = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull())
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-int(size) // index_bytes)
    dealt = slim.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(parts, 1))))
    counted = map_batches(dealt.select("part", "text"), _counted, "part long, word string, n long, words long, longest long") if parts > 1 else None
    whole, held = None, None
    if counted is not None:
        # an empty word stands for the item itself
        whole = counted.filter("word = ''").agg(F.sum("n"), F.sum("words"), F.max("longest")).first()
        held = counted.filter("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))
    found = []
    for part in range(parts):
        rows = dealt.filter(F.col("part") == part).orderBy("item_id", "text").collect()
        corpus = None
        if whole is not None and whole[0]:
            here = counted.filter((F.col("part") == part) & (F.col("word") != "")).select("word").distinct()
            corpus = Corpus(whole[0], whole[1], whole[2], {r.word: r.n for r in held.join(here, "word").collect()})
        found.append(ItemIndex([(r.item_id, r.text) for r in rows], corpus))
    return found


def _counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """For each part: how many items have a word, and with an empty word how many items, their words and the longest."""
    seen: dict[tuple[int, str], list[int]] = {}
    for part, text in zip(batch.column("part").to_pylist(), batch.column("text").to_pylist(), strict=True):
        words = [w for w in words_of(text) if w]
        for word in ("", *set(words)) if words else ():
            row = seen.setdefault((part, word), [0, 0, 0])
            row[0] += 1
            if not word:
                row[1], row[2] = row[1] + len(words), max(row[2], len(words))
    schema = pa.schema([("part", pa.int64()), ("word", pa.string()), ("n", pa.int64()), ("words", pa.int64()), ("longest", pa.int64())])
    columns = {"part": [k[0] for k in seen], "word": [k[1] for k in seen]}
    return frame_batch(schema, **columns, **{name: [v[i] for v in seen.values()] for i, name in enumerate(("n", "words", "longest"))})


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """``doc_id, item_id, score, question_overlap, answer_overlap``: a row for each item that is verified in a row's text.

    Each whole text is dealt into overlapping passages, so that every item, whatever its place, lies in one. Passages whose
    BM25 score for an item reaches ``threshold`` of the item's own are compared with its question and its answer; the best
    passage of a text counts for each item. A null or empty text has no rows; null ids stay null; repeated rows and items are
    all reported; further columns are ignored. No shuffle; an index of bounded size goes to each task.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])
    slim, out = id_and_text(docs), None

    def mapper(index: ItemIndex):
        search = searcher(index, threshold)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [(d, index.ids[i], s, q, a) for d, hit in zip(batch.column("doc_id").to_pylist(), search(batch.column("text").to_pylist()), strict=True) for i, (s, q, a, ok) in sorted(hit.items()) if ok]
            return frame_batch(schema, **{f.name: [r[k] for r in rows] for k, f in enumerate(schema)})

        return run

    for index in indexes(items, index_bytes) or [ItemIndex([])]:
        part = map_batches(slim, mapper(index), "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")
        out = part if out is None else out.unionByName(part)
    return out


def uncontaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, in whose text no item is verified. No shuffle."""
    names = [n.lower() for n in docs.columns]

    def mapper(index: ItemIndex):
        search = searcher(index, threshold)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            hits = search(batch.column(names.index("text")).to_pylist())
            return batch.filter(pa.array([not any(h[3] for h in hit.values()) for hit in hits], pa.bool_()))

        return run

    for index in indexes(items, index_bytes):
        docs = map_batches(docs, mapper(index), docs.schema)
    return docs
