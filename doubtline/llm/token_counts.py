"""Token counts of a byte-pair vocabulary by heap and linked list, without making identifiers."""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from doubtline.llm.common import frame_batch, id_and_text, map_batches

SCHEMA = "doc_id long, n_bytes long, n_tokens long"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
#: Distinct pieces a Python worker remembers before it starts anew, and the longest piece it remembers.
CACHE_PIECES, CACHE_CHARS = 400_000, 64

#: The pattern of byte-level vocabularies (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space besides space, tab, line feed and carriage return; texts that hold some are matched whole.
RARE_SPACE = re.compile("[" + "".join(map(chr, [0x0B, 0x0C, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF])) + "]")
#: Pieces between which the pattern always has a boundary: a space after anything else starts one.
PIECE = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")


def byte_letters() -> dict[str, int]:
    """The letters by which vocabulary files of this kind write bytes: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeCounter:
    """Counts tokens of a text under the ranked merges of a vocabulary file (JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        split, model = file.get("pre_tokenizer") or {}, file["model"]
        if model["type"] != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or file.get("normalizer"):
            raise ValueError(f"{path} is no plain byte-level byte-pair vocabulary")
        letters, number = byte_letters(), {}
        symbol = lambda s: number.setdefault(bytes(letters[c] for c in s), len(number))
        for letter in letters:
            symbol(letter)
        self.byte = [number[bytes([b])] for b in range(256)]
        #: pair of symbols to its rank and the symbol it becomes
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.merges.setdefault((symbol(left), symbol(right)), (rank, symbol(left + right)))
        special = sorted((t["content"] for t in file.get("added_tokens", [])), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.token = regex.compile(PATTERN)
        self.words: dict[str, int] = {}
        self.pieces: dict[str, int] = {}

    def merged(self, data: bytes) -> int:
        """Symbols that are left of one match: its bytes less the merges made.

        The symbols form a linked list; the heap holds adjacent pairs by rank, then place. A pair whose left symbol has
        changed meanwhile, or is gone, is skipped when it comes up.
        """
        n = len(data)
        if n < 2:
            return n
        merges, at = self.merges, [self.byte[b] for b in data]
        following, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(found[0], i, at[i], at[i + 1], found[1]) for i in range(n - 1) if (found := merges.get((at[i], at[i + 1])))]
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = following[i]
            if at[i] != a or j < 0 or at[j] != b:
                continue
            left -= 1
            at[i], at[j] = made, -1
            k = following[i] = following[j]
            if k >= 0:
                before[k] = i
                if found := merges.get((made, at[k])):
                    heapq.heappush(heap, (found[0], i, made, at[k], found[1]))
            if (h := before[i]) >= 0 and (found := merges.get((at[h], made))):
                heapq.heappush(heap, (found[0], h, at[h], made, found[1]))
        return left

    def _word(self, word: str) -> int:
        n = self.words.get(word)
        if n is None:
            n = self.merged(word.encode())
            if len(word) <= CACHE_CHARS:
                if len(self.words) >= CACHE_PIECES:
                    self.words.clear()
                self.words[word] = n
        return n

    def _part(self, text: str) -> int:
        """Tokens of a text without special strings."""
        if RARE_SPACE.search(text):
            return sum(map(self._word, self.token.findall(text)))
        total, known = 0, self.pieces
        for piece in PIECE.findall(text):
            n = known.get(piece)
            if n is None:
                n = sum(map(self._word, self.token.findall(piece)))
                if len(piece) <= CACHE_CHARS:
                    if len(known) >= CACHE_PIECES:
                        known.clear()
                    known[piece] = n
            total += n
        return total

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self._part(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._part, parts))


@lru_cache(2)
def merge_counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` for each row of ``docs``: UTF-8 bytes and tokens of the whole text; no shuffle.

    ``path`` names a byte-level BPE vocabulary (JSON) that every executor has. Special strings inside a text count as one
    token each. A null or empty text has 0 bytes and 0 tokens; a null doc_id stays null; repeated rows are counted each on
    their own; further columns are ignored. A single match of n bytes takes memory in proportion to n and time n log n.
    """

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        counter = merge_counter(path)
        texts = [t or "" for t in batch.column("text").to_pylist()]
        return frame_batch(ARROW, doc_id=batch.column("doc_id"), n_bytes=[len(t.encode()) for t in texts], n_tokens=[counter.count(t) for t in texts])

    return map_batches(id_and_text(docs), count, SCHEMA)
