"""SimHash groups, components and repeated substrings against plain versions."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from doubtline.llm import components, simhash, substrings


def plain_components(pairs):
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {a: find(a) for a in parent}


def test_connected_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(7, 7), (-5, 900)]
    pairs += pairs[:5]
    got = {r.u: r.root for r in components.connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    want = plain_components(p for p in pairs if p[0] != p[1])
    assert got == want
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
    assert components.connected_components(spark.createDataFrame([(None, 1), (2, 3)], "u long, v long")).count() == 2


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_golay_words_share_an_index_within_two_bits():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 400)
    for flips in (0, 1, 2):
        for word in words.tolist():
            other = word
            for b in rng.choice(23, flips, replace=False):
                other ^= 1 << int(b)
            own, theirs = (set(simhash.near_codewords(np.array([w]))[1].tolist()) for w in (word, other))
            assert own & theirs and len(own) in (1, 6)


def test_links_join_what_is_within_two_bits(spark):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 40).tolist()
    fps = set(base)
    for b in base[:20]:  # chains and balls around some fingerprints, one of them large
        for _ in range(200 if b == base[0] else 6):
            b ^= sum(1 << int(k) for k in rng.choice(63, int(rng.integers(1, 4)), replace=False)) if rng.random() < 0.5 or b != base[0] else 0
            near = base[0] ^ (1 << int(rng.integers(0, 63))) ^ (1 << int(rng.integers(0, 63)))
            fps |= {b, near} if b != base[0] else {near}
    fps = sorted(fps)
    want = plain_components((a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 2)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for limit in (2, 16, 10_000):
        links = simhash.links(df, limit)
        assert links.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) > 2).count() == 0
        assert {r.u: r.root for r in components.connected_components(links).collect()} == want


def test_simhash_components(spark, table, docs_of, odd):
    rows = table("documents", "doc_id, text")[:150]
    rows += [(1000 + i, t + " tail") for i, t in rows[:30]] + [(2000 + i, t) for i, t in rows[:10]]
    rows += [(3000, None), (3001, ""), (3002, "One"), (3003, "one"), (3004, "two words")]
    fps = {i: plain_fingerprint(t) for i, t in rows}
    ids = sorted(fps)
    want = plain_components([(i, i) for i in ids] + [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 2])
    got = simhash.simhash_components(docs_of(rows)).select("doc_id", simhash.hex_digits(F.col("fp")).alias("h"), "component_id").collect()
    assert {r.doc_id: (r.h, r.component_id) for r in got} == {i: (f"{fps[i]:016x}", want[i]) for i in ids}
    kept = sorted(r.doc_id for r in simhash.simhash_survivors(docs_of(rows)).collect())
    assert kept == sorted({want[i] for i in ids})
    assert simhash.simhash_components(odd.limit(0)).count() == 0


def test_simhash_survivors_of_odd_rows(odd):
    assert simhash.simhash_components(odd).count() == 9
    kept = simhash.simhash_survivors(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    # the texts without words are one group, known by the id 1; the other row without an id stands for itself
    assert Counter(r.doc_id for r in rows) == Counter({None: 1, 1: 1, 3: 1, 4: 1, 5: 1, 6: 1})


# --- repeated substrings


def plain_removal(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = {}
    for k, t in enumerate(raw):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(t) else 0
        edges = [0, *(np.flatnonzero(gone[1:] != gone[:-1]) + 1).tolist(), len(t)] if len(t) else [0, 0]
        pieces = [t[a:b] for a, b in zip(edges, edges[1:]) if a < b and not gone[a]]
        out[k] = (len(t), int(gone.sum()), runs, b"".join(pieces), "".join(p.decode("utf-8", "ignore") for p in pieces))
    return out


def test_refinement_tells_strings_apart():
    rng = random.Random(1)
    for _ in range(40):
        length, letters = rng.choice([8, 9, 16, 20, 33, 200]), rng.choice([b"ab", b"a", b"abcdefgh"])
        base = bytes(rng.choice(letters) for _ in range(300))
        texts = []
        for _ in range(6):
            start = rng.randrange(200)
            t = bytearray(base[start : start + rng.randrange(length, length + 150)])
            if t and rng.random() < 0.5:
                t[rng.randrange(len(t))] = 122
            texts.append(bytes(t))
        cuts = np.cumsum([0, *map(len, texts)])
        pointer = substrings.refine(np.frombuffer(b"".join(texts), np.uint8), np.repeat(cuts[1:], np.diff(cuts)), length)
        there, back = defaultdict(set), defaultdict(set)
        for k, t in enumerate(texts):
            for i in range(len(t) - length + 1):
                there[t[i : i + length]].add(int(pointer[cuts[k] + i]))
                back[int(pointer[cuts[k] + i])].add(t[i : i + length])
        assert all(len(v) == 1 for v in [*there.values(), *back.values()])


def test_removed_bytes_equal_a_plain_count(docs_of):
    rng = random.Random(6)
    for length, gram in ((20, 6), (30, 9)):
        base = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "é", "ab"]) for _ in range(200))
        texts = [None, "", "a" * 100, "a" * (length - 1), "a" * length, "abc" * 50]
        for _ in range(30):
            start = rng.randrange(600)
            t = base[start : start + rng.randrange(10, 200)]
            cut = rng.randrange(len(t) + 1)
            t = t[:cut] + rng.choice(["X", "yy", ""]) + t[cut:]
            texts.append("".join(rng.choice("abcdefgh ") for _ in range(rng.choice([0, 60]))) + t)
        texts += texts[8:12]
        want = {k: v[:4] for k, v in plain_removal(texts, length).items()}
        for limits in ({}, {"large": 2}, {"large": 1, "most": 10}, {"large": 1, "huge": 2}, {"large": 1, "huge": 1, "most": 10}, {"most": 50}):
            got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substrings.remove_repeats(docs_of(texts), length, gram, **limits).collect()}
            assert got == want, limits


def test_blocks_of_a_long_text(monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK_BITS", 6)
    data = np.frombuffer(bytes(random.Random(1).choice(b"abcd") for _ in range(1000)), np.uint8)
    _, _, first, n, span, count = substrings.units(data, 20, 5)
    covered = sorted(x for a, s in zip(first.tolist(), span.tolist(), strict=True) for x in range(a, a + s))
    assert covered == list(range(981))


def test_whole_tables_and_odd_rows(table, docs_of, odd):
    texts = [t for _, t in table("documents", "doc_id, text")[:200]]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substrings.remove_repeats(docs_of(texts)).collect()}
    assert got == {k: v[:4] for k, v in plain_removal(texts, 200).items()}
    rows = substrings.remove_repeats(odd).collect()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert len(rows) == 9 and by[5].n_removed == 60_000 and by[4].n_removed == 150_000 and by[1].n_bytes == 0
    # copies of one id: both rows lose what they share
    twice = docs_of([(1, "b" * 10 + "".join(chr(97 + i % 23) for i in range(300)))] * 2)
    assert [r.n_removed for r in substrings.remove_repeats(twice).collect()] == [310, 310]
    assert substrings.remove_repeats(odd.limit(0)).count() == 0


def test_texts_without_repeats(docs_of):
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    shared, one, two = words(60), words(30), words(30)
    # the letters around the shared part have one of their two bytes in common
    docs = docs_of([one + "é" + shared + "é" + two, two[::-1] + "ũ" + shared + "è", shared, None, ""])
    rows = {r.doc_id: r for r in substrings.without_repeats(docs).collect()}
    assert set(rows) == {0, 1, 3, 4} and rows[0].text == one + two and rows[0].n_chars == len(one + two)
    assert rows[1].text == two[::-1] and rows[3].text is None
