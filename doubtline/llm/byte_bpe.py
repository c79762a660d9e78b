"""Byte-level BPE encoding and raw-byte decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doubtline.llm.common import frame_batch, id_and_text, map_batches

#: Texts above so many characters are encoded in parts of about that size.
PART_CHARS = 1 << 20
#: Places where the pattern always has a boundary and neither side can change the other: white space after a letter, digit
#: or sign; a digit or sign after a letter; a letter or sign after a digit. Only ASCII counts, which no version of Unicode moves.
SAFE = re.compile(r"(?<=[!-~])(?=[ \n\t])|(?<=[A-Za-z])(?=[!-@\[-`{-~])|(?<=[0-9])(?=[!-/:-~])")


@lru_cache(2)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The library's encoding of a rank file (a base64 token and its rank in each line), without special tokens."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """The text cut at safe boundaries after about ``size`` characters; a run without one stays whole."""
    start = 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(docs: DataFrame, path: str, pattern: str, part_chars: int = PART_CHARS) -> DataFrame:
    """``doc_id, ids array<int>``: the token ids of each row's whole text, in its order; no shuffle.

    ``path`` names a rank file that every executor has, ``pattern`` the split that goes with it. Strings of special tokens
    are ordinary text. A null or empty text gives an empty array; a null doc_id stays null; repeated rows are encoded each
    on their own; further columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = encoding(path, pattern)
        ids = [np.concatenate([own.encode_to_numpy(part, disallowed_special=()) for part in parts(t or "", part_chars)]) for t in batch.column("text").to_pylist()]
        return frame_batch(schema, doc_id=batch.column("doc_id"), ids=[x.astype(np.int32) for x in ids])

    return map_batches(id_and_text(docs), run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids, decoded binary``: the raw bytes of each row's ids, joined as they are, valid UTF-8 or not.

    A null or empty array gives no bytes. An id that the rank file lacks raises.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = encoding(path, pattern)
        ids = batch.column("ids")
        decoded = [own.decode_bytes(x.values.to_numpy().tolist()) if x.is_valid else b"" for x in ids]
        return frame_batch(schema, doc_id=batch.column("doc_id"), ids=ids, decoded=decoded)

    return map_batches(tokens.select("doc_id", "ids"), run, "doc_id long, ids array<int>, decoded binary")


def digests(decoded: DataFrame, keep_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``, and ``ids`` if asked for, of what ``decode`` returns."""
    ids = F.coalesce("ids", F.array().cast("array<int>"))
    return decoded.select(
        "doc_id",
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *([F.col("ids")] if keep_ids else []),
    )
