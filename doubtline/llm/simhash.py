"""SimHash near-duplicates by Golay-code fuzzy hashing."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doubtline.llm.common import frame_batch, id_and_text, map_batches
from doubtline.llm.components import connected_components
from doubtline.session import materialize

SHINGLE, SEED, MAX_BITS = 3, 42, 2
#: Bits of the three segments of a fingerprint; each is filled up with zeros to the 23 bits of a Golay word.
SEGMENTS = (22, 21, 21)
#: Keys with more fingerprints than this aren't paired but linked by their one-bit neighbours.
PAIR_LIMIT = 16
BLOCK = 1 << 16
#: The generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 (a fixed value).
GENERATOR = 0b110001110101


# --- fingerprints


def fingerprint(data: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits, each 1 if it is set in over half the hashes of a text's word shingles.

    Words are runs without ASCII white space, A-Z lower-cased; with fewer words than ``shingle`` they make one shingle, and a
    text without words gives 0.
    """
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    size = min(shingle, len(words))
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - size + 1]
    ends = ends[size - 1 :] - 1
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_digest
    for at in range(0, len(starts), BLOCK):
        spans = zip(starts[at : at + BLOCK].tolist(), ends[at : at + BLOCK].tolist(), strict=True)
        raw = np.frombuffer(b"".join([digest(joined[a:b], seed) for a, b in spans]), np.uint8)
        counts += np.unpackbits(raw).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp long`` (the 64 bits as a signed number) for each row; a null text counts as empty, fingerprint 0."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [fingerprint((t or "").encode(), shingle) for t in batch.column("text").to_pylist()]
        return frame_batch(schema, doc_id=batch.column("doc_id"), fp=np.array(found, np.uint64).view(np.int64))

    return map_batches(id_and_text(docs), run, "doc_id long, fp long")


# --- Golay words


def _syndrome(words: np.ndarray) -> np.ndarray:
    """The remainders of 23-bit words modulo the generator."""
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest = np.where((rest >> bit) & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


@lru_cache(1)
def _patterns() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error patterns of weight 4 or less (1 or 6 of them), the least first, and how many."""
    errors = np.array([sum(1 << b for b in c) for w in range(5) for c in combinations(range(23), w)], np.int64)
    rests = _syndrome(errors)
    table, count = np.zeros((2048, 6), np.int64), np.zeros(2048, np.int64)
    for error, rest in zip(errors.tolist(), rests.tolist(), strict=True):
        table[rest, count[rest]] = error
        count[rest] += 1
    return table, count


def near_codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For 23-bit words, the 12-bit indices of all codewords within 4 bits, as (place in ``words``, index).

    The code is perfect with radius 3. Two words within 2 bits have a word within 1 bit of both; its codeword is within 4
    bits of both. So words that differ in 2 bits or fewer share an index; a word has 1 index or 6.
    """
    table, count = _patterns()
    rest = _syndrome(words)
    place = np.repeat(np.arange(len(words)), count[rest])
    which = np.arange(len(place)) - np.repeat(np.cumsum(count[rest]) - count[rest], count[rest])
    return place, (words[place] ^ table[rest[place], which]) >> 11


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints (uint64) as (place, key): fingerprints within 2 bits share one at least.

    Of three segments one has no error, as there are 2 at most. Each family of keys takes one segment as it is and the
    index of a codeword near the segment before it, which absorbs up to 2 errors there; the third segment is left free.
    """
    cuts = np.cumsum((0, *SEGMENTS))
    parts = [((fp >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)).astype(np.int64) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    places, keys = [], []
    for family in range(3):
        place, index = near_codewords(parts[family])
        places.append(place)
        keys.append((np.int64(family) << 36) | (index << 23) | parts[(family + 1) % 3][place])
    return np.concatenate(places), np.concatenate(keys)


# --- links


def _keyed(fps: DataFrame) -> DataFrame:
    schema = pa.schema([("key", pa.int64()), ("fp", pa.int64())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = batch.column("fp").to_numpy()
        place, key = fuzzy_keys(fp.view(np.uint64))
        return frame_batch(schema, key=key, fp=fp[place])

    return map_batches(fps.select("fp"), run, "key long, fp long")


def _distance(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(fps: DataFrame, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """``u long, v long`` between distinct fingerprints (``fp long``): enough links of 2 bits or fewer to join all that are joined.

    Fingerprints meet under their fuzzy keys, and each pair that meets is verified. A key of more than ``pair_limit``
    fingerprints gives no pairs: all its fingerprints also stand under themselves and their 64 one-bit neighbours. Those
    that share such a neighbour are within 2 bits of each other, and those within 2 bits share one, so a link from each to
    the least under it says the same as all pairs would, with 65 rows for each fingerprint however large the group.
    """
    keyed = _keyed(fps)
    groups = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).filter("n > 1")
    groups = materialize(groups, "keys")
    two = groups.filter("n = 2").select("u", "v").filter(_distance("u", "v") <= MAX_BITS)
    few = keyed.join(groups.filter((F.col("n") > 2) & (F.col("n") <= pair_limit)).select("key"), "key")
    pairs = few.withColumnRenamed("fp", "u").join(few.withColumnRenamed("fp", "v"), "key").filter("u < v").filter(_distance("u", "v") <= MAX_BITS).select("u", "v")
    many = keyed.join(groups.filter(F.col("n") > pair_limit).select("key"), "key").select("fp").distinct()
    flips = F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))))
    near = many.select("fp", F.explode(flips).alias("near"))
    # a star has its least fingerprint as centre; the aggregate keeps one row of each neighbour, and singles drop out
    centre = near.groupBy("near").agg(F.min("fp").alias("v"), F.max("fp").alias("w")).filter("v < w").select("near", "v")
    stars = near.join(centre, "near").filter("fp <> v").select(F.col("fp").alias("u"), "v")
    return two.unionByName(pairs).unionByName(stars).distinct()


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """``doc_id, fp long, component_id, root``, one row for each row of ``docs``; ``root`` is the component's least fingerprint.

    Texts whose fingerprints differ in 2 bits or fewer are linked; ``component_id`` is the least doc_id that can be reached,
    the own one included. A null text counts as empty (fingerprint 0, linked like any other); rows with a null doc_id get
    the least doc_id of their component, null if it has none; repeated rows are all returned; further columns are ignored.
    Copies share a fingerprint and cost one row in the search. Fingerprints are written once to the shared folder.
    """
    marked = materialize(fingerprints(docs, shingle), "fingerprints")
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = connected_components(links(classes, pair_limit))
    member = classes.join(found, F.col("fp") == F.col("u"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    member = materialize(member, "classes")
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(member.select("fp", "root").join(least, "root"), "fp").select("doc_id", "fp", "component_id", "root")


def hex_digits(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def simhash_survivors(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs``, all columns, that stay when one document of each component does: the one of the least doc_id.

    Rows whose doc_id is null or repeats can't be told by it; they are looked at again by their fingerprint, and one row of
    each component that such an id stands for stays. A component without any id keeps one row.
    """
    found = materialize(simhash_components(docs, shingle), "components")
    own = F.col("doc_id").eqNullSafe(F.col("component_id"))
    chosen = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(own).alias("own")).filter("own")
    plain = F.col("doc_id").isNotNull() & (F.col("n") == 1)
    stay = docs.join(chosen.filter(plain).select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    unclear = chosen.filter(~plain).select(F.col("doc_id").alias("__id"))
    if unclear.isEmpty():
        return stay

    @F.pandas_udf("long")
    def fp_of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint((t or "").encode(), shingle) for t in texts], np.uint64).view(np.int64))

    again = docs.join(unclear, docs["doc_id"].eqNullSafe(F.col("__id")), "left_semi").withColumn("__fp", fp_of(F.col("text")))
    roots = found.filter(own).select(F.col("fp").alias("__fp"), F.col("root").alias("__root"), F.col("component_id").alias("__least")).distinct()
    more = again.join(roots, "__fp").filter(F.col("doc_id").eqNullSafe(F.col("__least"))).dropDuplicates(["__root"])
    return stay.unionByName(more.select(docs.columns))
