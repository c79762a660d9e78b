"""Quality rules by repetition coverage: the characters inside repeated n-grams of words and repeated lines."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doubtline.llm.common import RollingHash, chunks, frame_batch, id_and_text, map_batches, splitmix, utf8_slices

#: n-gram length in words to the largest share (in per cent) of a text's word characters inside n-grams found twice or more.
COVERAGE_LIMITS = {5: 40, 6: 36, 8: 30, 10: 26}
#: Largest share (in per cent) of a text's word characters in lines that repeat an earlier line.
LINE_LIMIT = 30
WINDOW = 8
CHUNK_BYTES = 1 << 21

SYMBOLS = b"#*$%&|<>"
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_chars long, covered array<long>"
ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars")] + [("covered", pa.list_(pa.int64()))])


def _flags(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


IS_SPACE, IS_SYMBOL = _flags(SPACE), _flags(SYMBOLS)
NEWLINE = 10


@lru_cache(1)
def _hashes() -> tuple[RollingHash, RollingHash]:
    return RollingHash(1), RollingHash(2)


def _per_doc(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, weights=values, minlength=n).astype(np.int64) if len(doc) else np.zeros(n, np.int64)


def _repeated(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value, if it occurs twice or more, and if an equal one stands before it."""
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    twice, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    twice[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return twice, later


def _measure(data: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """The counts of each text of a chunk; ``offsets`` start at 0."""
    n = len(offsets) - 1
    if not len(data):
        return {k: np.zeros((n, len(lengths)) if k == "covered" else n, np.int64) for k in ARROW.names if k != "doc_id"}
    space = IS_SPACE[data]
    breaks = np.zeros(len(data) + 1, bool)  # where a text starts
    breaks[offsets] = True
    word = ~space
    before = np.zeros(len(data), bool)
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | breaks[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | breaks[1:])) + 1
    doc = np.searchsorted(offsets, starts, side="right") - 1

    first = np.concatenate([[0], np.cumsum(word & ((data & 0xC0) != 0x80))])  # characters of words before each byte
    chars = first[ends] - first[starts]
    out = {"n_words": np.bincount(doc, minlength=n).astype(np.int64), "word_chars": first[offsets[1:]] - first[offsets[:-1]]}
    symbols = np.concatenate([[0], np.cumsum(IS_SYMBOL[data])])
    out["n_symbols"] = symbols[offsets[1:]] - symbols[offsets[:-1]]

    one, two = _hashes()
    sums = one.prefix(data)
    # lines: split at \n, counted if they hold a word
    newline = np.flatnonzero(data == NEWLINE)
    line_start = np.union1d(offsets[:-1], newline + 1)
    line_start = line_start[line_start < len(data)]
    line_end = np.append(line_start[1:], len(data))
    line_doc = np.searchsorted(offsets, line_start, side="right") - 1
    # a line before another line of the same text ends before its \n; an own \n at the end of a text starts an empty line
    line_end = line_end - ((line_end > line_start) & (data[np.maximum(line_end, 1) - 1] == NEWLINE))
    has_word = first[line_end] > first[line_start]
    line_start, line_end, line_doc = line_start[has_word], line_end[has_word], line_doc[has_word]
    key = splitmix(one.ranges(sums, line_start, line_end) + splitmix((line_end - line_start).astype(np.uint64))) ^ splitmix(line_doc.astype(np.uint64) + np.uint64(1 << 40))
    _, later = _repeated(key)
    out["n_dup_lines"] = _per_doc(later, line_doc, n)
    out["dup_line_chars"] = _per_doc((first[line_end] - first[line_start]) * later, line_doc, n)

    # n-grams: a second rolling hash, over the hashes of words
    words = splitmix(one.ranges(sums, starts, ends) + splitmix((ends - starts).astype(np.uint64)))
    base = np.uint64(two.base)
    salt = splitmix(doc.astype(np.uint64))
    covered, repeat = [], np.zeros(n, np.int64)
    rolled, length = np.zeros(len(words), np.uint64), 0
    for size in sorted({*lengths, WINDOW}):
        while length < size:  # rolled[i] covers words i .. i + length - 1
            tail = words[length:] if length else words
            rolled = (rolled[: len(tail)] if length else rolled) * base + tail
            length += 1
            if not len(rolled):
                break
        held = np.zeros(len(words), bool)
        if len(words) >= size:
            inside = doc[: len(words) - size + 1] == doc[size - 1 :]
            at = np.flatnonzero(inside)
            twice, _ = _repeated(splitmix(rolled[at]) ^ salt[at])
            edge = np.zeros(len(words) + 1, np.int64)
            edge[at[twice]] += 1
            edge[at[twice] + size] -= 1
            held = np.cumsum(edge)[:-1] > 0
        if size == WINDOW:
            repeat = _per_doc(held, doc, n)
        if size in lengths:
            covered.append(_per_doc(chars * held, doc, n))
        length = size
    out["n_repeat_words"] = repeat
    out["covered"] = np.stack(covered, 1) if covered else np.zeros((n, 0), np.int64)
    return out


def repetition_profile(docs: DataFrame, lengths: tuple[int, ...] = tuple(sorted(COVERAGE_LIMITS))) -> DataFrame:
    """Counts of each text; one row for each row of ``docs``, none dropped, no shuffle.

    ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, dup_line_chars, covered``. Words are runs
    without ASCII white space, compared as they are. ``covered`` holds, for each length in ``lengths`` (ascending), the
    characters of words inside n-grams found twice or more in the text. A null text counts as empty: all counts 0. A null
    doc_id stays null; repeated rows are measured each on its own; further columns are ignored. Memory follows the longest
    text, as about 2 MB of shorter ones are taken at a time.
    """
    lengths = tuple(sorted(lengths))

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = utf8_slices(batch.column("text"))
        parts = [_measure(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lengths) for a, b in chunks(offsets, CHUNK_BYTES)]
        whole = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        flat = whole.pop("covered")
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))
        return frame_batch(ARROW, doc_id=batch.column("doc_id"), covered=lists, **whole)

    return map_batches(id_and_text(docs), measure, SCHEMA)


def repetition_rules(docs: DataFrame, limits: dict[int, int] = COVERAGE_LIMITS, line_limit: int = LINE_LIMIT) -> DataFrame:
    """The profile with verdicts: ``base_failed``, and ``kept``, false for texts that repeat too much.

    ``base_failed``: fewer than 20 words, or over 30 per cent of the words inside repeated 8-word windows. ``kept`` is
    false then, and where ``100 * covered > limit * word_chars`` for a length of ``limits``, or where the characters of
    repeated lines pass ``line_limit`` per cent. An empty or null text fails the base rule.
    """
    sizes = sorted(limits)
    out = repetition_profile(docs, tuple(sizes))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    over = 100 * F.col("dup_line_chars") > line_limit * F.col("word_chars")
    for i, size in enumerate(sizes):
        over = over | (100 * F.col("covered")[i] > limits[size] * F.col("word_chars"))
    named = [F.col("covered")[i].alias(f"covered_chars_{size}") for i, size in enumerate(sizes)]
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~over).alias("kept"), "dup_line_chars", *named)


#: The same in SQL.
SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i
  FROM (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs) WHERE len(w) > 0),
grams AS (
  SELECT r, i, word, length(word) AS chars,
         {grams}
  FROM words WINDOW o AS (PARTITION BY r ORDER BY i)),
flagged AS (
  SELECT r, i, chars,
         {flags}
  FROM grams),
held AS (
  SELECT r, chars,
         {held}
  FROM flagged),
per_words AS (
  SELECT r, count(*) AS n_words, sum(chars) AS word_chars, count(*) FILTER (h8) AS n_repeat_words,
         {sums}
  FROM held GROUP BY r),
lines AS (
  SELECT r, line, count(*) AS c
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line),
per_lines AS (
  SELECT r, sum(c - 1) AS n_dup_lines,
         sum((c - 1) * length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS dup_line_chars
  FROM lines GROUP BY r),
counts AS (
  SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(dup_line_chars, 0)::BIGINT AS dup_line_chars, {columns}
  FROM docs d LEFT JOIN per_words USING (r) LEFT JOIN per_lines USING (r))
SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * dup_line_chars > {line_limit} * word_chars
            OR {over}) AS kept
FROM counts
"""


def rules_sql(limits: dict[int, int] = COVERAGE_LIMITS, line_limit: int = LINE_LIMIT) -> str:
    sizes, every = sorted(limits), sorted({*limits, WINDOW})
    return SQL.format(
        grams=",\n         ".join(f"CASE WHEN lead(i, {s - 1}) OVER o IS NOT NULL THEN {' || chr(32) || '.join(f'lead(word, {k}) OVER o' for k in range(s))} END AS g{s}" for s in every),
        flags=",\n         ".join(f"(g{s} IS NOT NULL AND count(*) OVER (PARTITION BY r, g{s}) > 1) AS f{s}" for s in every),
        held=",\n         ".join(f"bool_or(f{s}) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {s - 1} PRECEDING AND CURRENT ROW) AS h{s}" for s in every),
        sums=",\n         ".join(f"sum(chars) FILTER (h{s}) AS c{s}" for s in sizes),
        columns=", ".join(f"coalesce(c{s}, 0)::BIGINT AS covered_chars_{s}" for s in sizes),
        over=" OR ".join(f"100 * covered_chars_{s} > {limits[s]} * word_chars" for s in sizes),
        line_limit=line_limit,
    )
