"""Removal of long repeated substrings: distributed q-gram buckets, refined by bucket pointers until strings are told apart.

Every window of ``length`` bytes is led by an anchor, its least q-gram by hash. Equal windows have equal anchors at equal
places, so they meet in the bucket of that q-gram; windows next to each other share an anchor and travel as one unit, about
70 bytes of text to a row. A bucket is refined in three steps, each on what the step before left open:

1. units of equal text are one class; a bucket with one member is unique, and a class of two or more is repeated;
2. in buckets of several classes, one unit of each class brings its text, and bucket pointer refinement tells its windows
   apart: 8-byte buckets, then pairs of bucket pointers at later offsets for 16, 32, 64, 128 and ``length`` bytes;
3. buckets of many classes are first split by the text around the anchor: by what 16 windows next to each other have in
   common, and beyond a second bound by hashes of whole windows, so that no task holds such a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doubtline.llm.common import RollingHash, frame_batch, map_batches, release_memory, splitmix, utf8_slices
from doubtline.session import hidden, materialize

LENGTH, GRAM = 200, 48
#: Classes of a bucket beyond which it is split by the text that neighbouring windows share, and by whole windows.
LARGE_BUCKET, HUGE_BUCKET = 2000, 20_000
#: Neighbouring windows that are split off together.
CHUNK = 16
#: Bytes of text that are refined together; larger buckets are taken whole.
REFINE_BYTES = 1 << 20
#: Windows that are searched for anchors at a time; a unit ends there, which refinement makes good.
BLOCK_BITS = 19


@lru_cache(1)
def _hashes() -> tuple[RollingHash, RollingHash, RollingHash]:
    return RollingHash(3), RollingHash(4), RollingHash(6)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, from running minima of blocks of that width in both directions."""
    n = len(values) - width + 1
    padded = np.concatenate([values, np.full(-len(values) % width, np.iinfo(np.uint64).max)]).reshape(-1, width)
    onward = np.minimum.accumulate(padded, 1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], onward[width - 1 : width - 1 + n])


def units(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """The units of a text: (bucket, class, first window, windows, span, count).

    Units that follow each other with equal text, as in a run of one short string, are one row with their ``count``;
    ``span`` covers all their windows.
    """
    out = []
    by_gram, by_text, _ = _hashes()
    block, low = 1 << BLOCK_BITS, np.uint64((1 << (BLOCK_BITS + 1)) - 1)
    for start in range(0, len(data) - length + 1, block):
        part = data[start : start + block + length - 1]
        sums = by_gram.prefix(part)
        at = np.arange(len(part) - gram + 1)
        hashed = splitmix(by_gram.ranges(sums, at, at + gram))
        # the place in the low bits: of equal q-grams the first leads
        least = _sliding_min(hashed & ~low | at.astype(np.uint64), length - gram + 1)
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        last = np.append(first[1:], len(least))
        bucket = hashed[(least[first] & low).astype(np.int64)]
        text = by_text.ranges(by_text.prefix(part), first, last - 1 + length)
        kind = splitmix(text ^ splitmix((last - first).astype(np.uint64)))
        lead = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (kind[1:] != kind[:-1])]))
        tail = np.append(lead[1:], len(first))
        out.append((bucket[lead], kind[lead], first[lead] + start, (last - first)[lead], last[tail - 1] - first[lead], tail - lead))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def refine(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Bucket pointers of all strings of ``length`` bytes in some texts: equal strings have equal pointers.

    ``data`` holds the texts one after the other, ``ends`` for each byte the end of its text. Positions whose string would
    pass that end have pointers without meaning. A pointer is the place of the bucket's first string in sorted order.
    Positions start in buckets by their first 8 bytes; a bucket with more than one string is sorted by the pointers that
    stand as many bytes later as its strings are known to agree, which doubles that depth; the new pointers serve in the
    same way at once, and buckets of one string are done.
    """
    n, depth = len(data), 8
    room = ends - np.arange(n)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i : i + n]
    pointer = np.arange(n, dtype=np.int64)
    active = np.flatnonzero(room >= depth)
    order = np.argsort(key[active], kind="stable")
    ranked = key[active[order]]
    base = np.zeros(len(active), np.int64)

    def point(active: np.ndarray, order: np.ndarray, new: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Sets the pointers of sorted positions, where ``new`` starts a bucket; returns those of buckets of several."""
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(order)))
        pointer[active[order]] = np.repeat(base[head], size)
        return active[order[np.repeat(size > 1, size)]]

    if len(active):
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        base = np.arange(len(active), dtype=np.int64)
        left = point(active, order, new, base)
        # positions that are too near to their end for a bucket keep numbers of their own beyond all others
        late = np.flatnonzero(room < depth)
        pointer[late] = n + late
        active = left
    while len(active) and depth < length:
        step = min(depth, length - depth)
        active = active[room[active] >= depth + step]
        later = pointer[active + step]
        own = pointer[active]
        order = np.lexsort((later, own))
        a, b = own[order], later[order]
        bucket = np.concatenate([[True], a[1:] != a[:-1]]) if len(a) else np.zeros(0, bool)
        new = bucket | np.concatenate([[True], b[1:] != b[:-1]]) if len(a) else bucket
        # place in the bucket, added to its pointer
        place = np.arange(len(a)) - np.maximum.accumulate(np.where(bucket, np.arange(len(a)), 0)) if len(a) else np.zeros(0, np.int64)
        dropped = active
        active = point(active, order, new, a + place) if len(a) else dropped
        depth += step
    return pointer


def repeated_windows(data: np.ndarray, cuts: np.ndarray, owned: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For texts of units (``cuts``: their n + 1 bounds in ``data``), the places of own windows that occur twice or more.

    A text's first ``owned`` windows are its own; the bytes after them only complete those, as they lead other units.
    """
    sizes = np.diff(cuts)
    pointer = refine(data, np.repeat(cuts[1:], sizes), length)
    within = np.arange(len(data)) - np.repeat(cuts[:-1], sizes)
    at = np.flatnonzero(within < np.repeat(owned, sizes))
    order = np.argsort(pointer[at], kind="stable")
    ranked = pointer[at[order]]
    same = np.zeros(len(at) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    return np.sort(at[order[same[1:] | same[:-1]]])


def _runs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending places as (start, length) of runs without gaps."""
    if not len(places):
        return places, places
    new = np.flatnonzero(np.concatenate([[True], np.diff(places) != 1]))
    return places[new], np.diff(np.append(new, len(places)))


# --- Spark

KEY = ["did", "tid"]


def _key() -> tuple[Column, Column]:
    """A row's key: 128 bits of its id and its whole text, from two hash functions. Only equal rows share one."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null"))
    return F.xxhash64(doc_id, text), F.conv(F.substring(F.md5(F.concat_ws("|", doc_id, text)), 1, 16), 16, -10).cast("long")


def _keyed(docs: DataFrame) -> DataFrame:
    """``did, tid, doc_id, text``: rows by their key; a null text is empty."""
    did, tid = _key()
    return docs.select(did.alias("did"), tid.alias("tid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


UNIT_SCHEMA = pa.schema([("did", pa.int64()), ("tid", pa.int64()), ("bucket", pa.int64()), ("kind", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("span", pa.int64()), ("c", pa.int64())])


def _unit_rows(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = utf8_slices(batch.column("text"))
        found = [units(data[a:b], length, gram) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        each = np.array([len(f[0]) for f in found])
        bucket, kind, *rest = (np.concatenate(x) for x in zip(*found, strict=True))
        did, tid = (np.repeat(batch.column(k).to_numpy(), each) for k in KEY)
        return frame_batch(UNIT_SCHEMA, did=did, tid=tid, bucket=bucket.view(np.int64), kind=kind.view(np.int64), **dict(zip(("start", "n", "span", "c"), rest, strict=True)))

    return map_batches(keyed, run, "did long, tid long, bucket long, kind long, start long, n long, span long, c long")


PIECE_SCHEMA = pa.schema([("slot", pa.int64()), ("key", pa.int64()), ("did", pa.int64()), ("tid", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("c", pa.int64()), ("piece", pa.binary())])
PIECES = "slot long, key long, did long, tid long, start long, n long, c long, piece binary"
RANGE_SCHEMA = pa.schema([("did", pa.int64()), ("tid", pa.int64()), ("start", pa.int64()), ("span", pa.int64())])


def _chunks_of(data: np.ndarray, sums: tuple[np.ndarray, np.ndarray], wanted: dict, length: int, gram: int) -> Iterator[tuple[int, int, int]]:
    """(slot, first window, windows) for the windows of a unit, dealt by their distance to the anchor.

    Windows of one chunk have all but the outermost bytes in common; the slot stands for those and the distance, so equal
    windows of other units share it.
    """
    start, n, bucket = wanted["start"], wanted["n"], np.int64(wanted["bucket"]).view(np.uint64)
    by_gram, by_text, _ = _hashes()
    at = np.arange(start + n - 1, start + length - gram + 1)
    anchor = int(at[np.flatnonzero(splitmix(by_gram.ranges(sums[0], at, at + gram)) == bucket)[0]])
    for chunk in range((anchor - start - n + 1) // CHUNK, (anchor - start) // CHUNK + 1):
        first, last = max(start, anchor - CHUNK * chunk - CHUNK + 1), min(start + n - 1, anchor - CHUNK * chunk)
        core = np.array([anchor - CHUNK * chunk]), np.array([max(anchor - CHUNK * chunk, anchor - CHUNK * chunk - CHUNK + 1 + length)])
        slot = splitmix(by_text.ranges(sums[1], *core) ^ splitmix(np.array([chunk], np.uint64)) ^ bucket)
        yield int(slot.view(np.int64)[0]), first, last - first + 1


def _piece_rows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """The text of each wanted unit or, of units of large buckets, of each chunk; of huge buckets the hashes of windows.

    Of equal windows of one batch one row goes on, with their count; the others are known to be repeated and go on as
    ranges (with count 0), so that a window costs a row in each batch at most.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {f.name: [] for f in PIECE_SCHEMA}
        keys, dids, tids, starts = [], [], [], []

        def add(**row) -> None:
            for name in out:
                out[name].append(row.get(name))

        hashes = _hashes()
        for did, tid, text, wanted in zip(*(batch.column(k).to_pylist() for k in ("did", "tid", "text", "wanted")), strict=True):
            raw = text.encode()
            data, sums = None, None
            for w in wanted:
                if data is None and w["large"]:
                    data = np.frombuffer(raw, np.uint8)
                    sums = tuple(h.prefix(data) for h in hashes)
                if w["large"] < 2:
                    dealt = _chunks_of(data, sums, w, length, gram) if w["large"] else [(w["bucket"], w["start"], w["n"])]
                    for slot, start, n in dealt:
                        add(slot=slot, key=0, did=did, tid=tid, start=start, n=n, c=w["c"], piece=raw[start : start + n - 1 + length])
                    continue
                at = np.arange(w["start"], w["start"] + w["n"])
                pair = (splitmix(h.ranges(s, at, at + length)) for h, s in zip(hashes[::2], sums[::2], strict=True))
                # a class of several has no window of its own to find; its windows count as two
                keys.append(np.stack([*pair, np.full(len(at), min(w["c"], 2), np.uint64)], 1))
                dids.append(np.full(len(at), did))
                tids.append(np.full(len(at), tid))
                starts.append(at)
        if keys:
            key, did, tid, start = np.concatenate(keys), np.concatenate(dids), np.concatenate(tids), np.concatenate(starts)
            order = np.lexsort((key[:, 1], key[:, 0]))
            key, did, tid, start = key[order], did[order], tid[order], start[order]
            new = np.concatenate([[True], (key[1:, :2] != key[:-1, :2]).any(1)])
            group = np.cumsum(new) - 1
            count = np.bincount(group, weights=key[:, 2].astype(np.float64)).astype(np.int64)
            for i in np.flatnonzero(new).tolist():
                add(slot=int(key[i, 0].view(np.int64)), key=int(key[i, 1].view(np.int64)), did=int(did[i]), tid=int(tid[i]), start=int(start[i]), n=1, c=int(count[group[i]]))
            several = np.flatnonzero(count[group] > 1)
            place = np.lexsort((start[several], tid[several], did[several]))
            did, tid, start = did[several][place], tid[several][place], start[several][place]
            lead = np.flatnonzero(np.concatenate([[True], (did[1:] != did[:-1]) | (tid[1:] != tid[:-1]) | (start[1:] != start[:-1] + 1)])) if len(start) else several
            for i, span in zip(lead.tolist(), np.diff(np.append(lead, len(start))).tolist(), strict=True):
                add(slot=int(did[i]) ^ int(start[i]), key=0, did=int(did[i]), tid=int(tid[i]), start=int(start[i]), n=span, c=0)
        return frame_batch(PIECE_SCHEMA, **out)

    return map_batches(texts, run, PIECES)


def _refined(pieces: DataFrame, length: int, most: int) -> DataFrame:
    """Ranges of repeated windows from pieces, which stand together by slot."""

    def settle(rows: pa.Table) -> pa.RecordBatch:
        """Of whole slots."""
        is_text = rows.column("piece").is_valid().to_numpy()
        found = []
        text = rows.filter(pa.array(is_text))
        if text.num_rows:
            data, cuts = utf8_slices(text.column("piece").combine_chunks())
            owned = text.column("n").to_numpy()
            places = repeated_windows(data, cuts, owned, length)
            which = np.searchsorted(cuts, places, side="right") - 1
            single = text.column("c").to_numpy()[which] == 1  # classes of several are known to be repeated
            places, which = places[single], which[single]
            # a run ends with its unit: a gap of one keeps the places of different units apart
            first, span = _runs(places + which)
            unit = which[np.searchsorted(places + which, first)]
            start = first - unit - cuts[unit] + text.column("start").to_numpy()[unit]
            found.append((*(text.column(k).to_numpy()[unit] for k in KEY), start, span))
        hashed = rows.filter(pa.array(~is_text))
        if hashed.num_rows:
            slot, key, c = (hashed.column(k).to_numpy() for k in ("slot", "key", "c"))
            order = np.lexsort((key, slot))
            new = np.concatenate([[True], (slot[order][1:] != slot[order][:-1]) | (key[order][1:] != key[order][:-1])])
            group = np.cumsum(new) - 1
            several = order[np.bincount(group, weights=c[order])[group] > 1]
            found.append((*(hashed.column(k).to_numpy()[several] for k in (*KEY, "start")), np.ones(len(several), np.int64)))
        return frame_batch(RANGE_SCHEMA, **{f.name: np.concatenate([x[i] for x in found]) if found else [] for i, f in enumerate(RANGE_SCHEMA)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            known = table.filter(pa.compute.equal(table.column("c"), 0))
            if known.num_rows:
                yield frame_batch(RANGE_SCHEMA, span=known.column("n").combine_chunks(), **{k: known.column(k).combine_chunks() for k in (*KEY, "start")})
            table = table.filter(pa.compute.not_equal(table.column("c"), 0))
            held.append(table)
            size += table.nbytes
            while size > most:
                # whole slots from the front, about ``most`` bytes of them; the last one may go on in the next batch
                whole = pa.concat_tables(held)
                slot = whole.column("slot").to_numpy()
                bounds = np.flatnonzero(slot[1:] != slot[:-1]) + 1
                if not len(bounds):
                    held = [whole]
                    break
                nbytes = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(whole.column("piece")), 0).to_numpy() + 64)
                cut = int(bounds[max(0, min(np.searchsorted(nbytes[bounds - 1], most), len(bounds)) - 1)])
                yield settle(whole.slice(0, cut))
                held = [whole.slice(cut)]
                size = int(nbytes[-1] - nbytes[cut - 1])
                if size > most and cut == int(bounds[-1]):
                    break
        if held and (rest := pa.concat_tables(held)).num_rows:
            yield settle(rest)
        held, batch, table, known, whole, rest = [], None, None, None, None, None
        release_memory()

    return pieces.repartition("slot").sortWithinPartitions("slot").mapInArrow(run, "did long, tid long, start long, span long")


def repeated_ranges(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM, large: int = LARGE_BUCKET, huge: int = HUGE_BUCKET, most: int = REFINE_BYTES) -> DataFrame:
    """``did, tid, start, span``: runs of positions where a repeated string of ``length`` bytes starts."""
    rows = _unit_rows(keyed, length, gram)
    stats = rows.groupBy("bucket").agg(F.sum("c").alias("members"), F.min("kind").alias("lo"), F.max("kind").alias("hi"))
    stats = stats.filter("members > 1").select("bucket", (F.col("lo") != F.col("hi")).alias("mixed"))
    shared = materialize(rows.join(stats, "bucket"), "units")
    mixed = shared.filter("mixed")
    classes = mixed.groupBy("bucket", "kind").agg(F.sum("c").alias("c"), F.min(F.struct("did", "tid", "start", "n")).alias("one"))
    classes = materialize(classes, "classes")
    plain = shared.filter("not mixed").select("did", "tid", "start", "span")
    several = mixed.drop("c").join(classes.filter("c > 1").select("bucket", "kind"), ["bucket", "kind"]).select("did", "tid", "start", "span")
    classes_of = F.count(F.lit(1))
    sizes = classes.groupBy("bucket").agg(((classes_of > large).cast("int") + (classes_of > huge).cast("int")).alias("large"))
    wanted = classes.join(sizes, "bucket").select("one.did", "one.tid", F.struct("bucket", "one.start", "one.n", "c", "large").alias("w"))
    wanted = wanted.groupBy("did", "tid").agg(F.collect_list("w").alias("wanted"))
    fine = _refined(_piece_rows(keyed.join(wanted, KEY), length, gram), length, most)
    return plain.unionByName(several).unionByName(fine)


def _marked(docs: DataFrame, length: int, gram: int, **limits) -> DataFrame:
    """``docs`` under ``d`` with the list of repeated starts of each row, null where it has none."""
    ranges = repeated_ranges(_keyed(docs), length, gram, **limits)
    # equal rows have equal ranges: a set of them, however often a row is repeated
    lists = ranges.groupBy(*KEY).agg(F.collect_set(F.struct("start", "span")).alias("ranges"))
    return lists


def removed_bytes(starts: list[int], spans: list[int], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the maximal runs of bytes that strings starting in these ranges cover."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(starts, kind="stable")
    a = np.asarray(starts, np.int64)[order]
    b = np.maximum.accumulate(a + np.asarray(spans, np.int64)[order] - 1 + length)
    new = np.concatenate([[True], a[1:] > b[:-1]])
    return a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)]


def _cut(raw: bytes, ranges: list[dict] | None, length: int) -> tuple[list[bytes], int, int]:
    """The pieces that are left, the bytes removed, and the number of runs removed."""
    if not ranges:
        return [raw], 0, 0
    first, end = removed_bytes([r["start"] for r in ranges], [r["span"] for r in ranges], length)
    kept = [raw[a:b] for a, b in zip([0, *end.tolist()], [*first.tolist(), len(raw)], strict=True)]
    return kept, int((end - first).sum()), len(first)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, **limits) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept binary``, one row for each row of ``docs``.

    Every byte covered by a string of ``length`` bytes that also starts anywhere else goes, in all places, the first one
    included; strings are judged on the input. Matches don't cross texts. A null or empty text has no bytes; rows with null
    ids and repeated rows are texts like others, so copies remove each other; further columns are ignored. Texts are
    shuffled once, by key.
    """
    keyed = _keyed(docs)
    lists = _marked(docs, length, gram, **limits)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [t.encode() for t in batch.column("text").to_pylist()]
        cut = [_cut(r, x, length) for r, x in zip(raw, batch.column("ranges").to_pylist(), strict=True)]
        return frame_batch(schema, doc_id=batch.column("doc_id"), n_bytes=[len(r) for r in raw], n_removed=[c[1] for c in cut], n_spans=[c[2] for c in cut], kept=[b"".join(c[0]) for c in cut])

    return map_batches(keyed.join(lists, KEY, "left"), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, **limits) -> DataFrame:
    """The rows of ``docs``, all columns, with the repeated bytes taken out of ``text``; rows that lose all their text go.

    Characters cut in two by that are dropped, too. ``n_chars``, where it exists, is the length of the new text.
    """
    lists = _marked(docs, length, gram, **limits)
    did, tid = _key()
    first, second, ranges = (hidden(n) for n in (*KEY, "ranges"))
    named = lists.select(F.col("did").alias(first), F.col("tid").alias(second), F.col("ranges").alias(ranges))
    joined = docs.join(named, (did == F.col(first)) & (tid == F.col(second)), "left")

    @F.pandas_udf("string")
    def left(texts, ranges):
        return texts.combine(ranges, lambda t, r: t if t is None or r is None else "".join(k.decode("utf-8", "ignore") for k in _cut(t.encode(), list(r), length)[0]))

    gone = F.col(ranges).isNotNull()
    out = joined.withColumn("text", F.when(gone, left(F.col("text"), F.col(ranges))).otherwise(F.col("text"))).filter(~gone | (F.trim(F.col("text")) != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(gone, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(docs.columns)

