"""Repetition, token counts, byte BPE and sharding against plain versions."""

import base64
import hashlib
import random
import re
from collections import Counter

import pytest
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from doubtline.llm import byte_bpe, repetition, sharding, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


# --- repetition


def plain_profile(text, lengths):
    text = text or ""
    words = WORD.findall(text)
    lines = Counter(x for x in text.split("\n") if WORD.search(x))

    def held(size):
        seen = Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
        out = set()
        for i in range(len(words) - size + 1):
            if seen[tuple(words[i : i + size])] > 1:
                out.update(range(i, i + size))
        return out

    return (
        len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), sum(n - 1 for n in lines.values()), len(held(8)),
        sum((n - 1) * sum(map(len, WORD.findall(x))) for x, n in lines.items()), [sum(len(words[i]) for i in held(s)) for s in lengths],
    )


def test_repetition_profile(docs_of):
    rng = random.Random(4)
    texts = [None, "", " \n\n ", "a", "a\n", "\na\n\na", "x\n x\nx", "é é\r\né é\r\n", "\x0b\x1ca b\xa0c d"]
    for _ in range(60):
        few = [rng.choice(["a", "bb", "Ä#", "c|c", "<d>", "e"]) for _ in range(5)]
        texts.append("".join(rng.choice(few) + rng.choice([" ", " ", "  ", "\n", "\t"]) for _ in range(rng.randrange(120))))
    lengths = (2, 5, 8, 10)
    got = {r.doc_id: tuple(r)[1:] for r in repetition.repetition_profile(docs_of(texts), lengths).collect()}
    assert got == {i: plain_profile(t, lengths) for i, t in enumerate(texts)}


def test_repetition_rules_on_odd_rows(odd, docs_of):
    rows = repetition.repetition_rules(odd).collect()
    assert len(rows) == 9
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[1].n_words == 0 and by[1].base_failed and not by[1].kept
    assert by[4].n_words == 30_000 and by[4].n_repeat_words == 30_000 and not by[4].kept
    assert by[5].word_chars == 60_000
    clean = " ".join(f"word{i}" for i in range(200))
    assert repetition.repetition_rules(docs_of([clean])).first().kept
    assert repetition.repetition_rules(odd.limit(0)).count() == 0


# --- tokens


def noisy_texts(n=150):
    rng = random.Random(8)
    bits = [" ", "  ", "\n", "\t", "\r\n", "\xa0", " ", "\x1c", "\x85", "don't", "I'll", "'s", "hello", " world", "ünï", "漢字", "123", "½", "!!!", "...", "<|endoftext|>", "aaaaaaa", "é", "\U0001f600", "_", "a1b2", "\x00"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_token_counts_equal_the_library(docs_of):
    texts = [None, "", "x" * 5000, "<|endoftext|>", " <|endoftext|> ", "ab " * 3000, *noisy_texts(400)]
    own = Tokenizer.from_file(VOCABULARY)
    want = {i: (len((t or "").encode()), len(own.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)}
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs_of(texts), VOCABULARY).collect()} == want


def test_token_counts_on_odd_rows(odd):
    rows = token_counts.count_tokens(odd, VOCABULARY).collect()
    assert len(rows) == 9 and sum(r.doc_id is None for r in rows) == 2 and sum(r.doc_id == 3 for r in rows) == 2
    assert token_counts.count_tokens(odd.limit(0), VOCABULARY).count() == 0


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_equals_the_library_in_parts(docs_of):
    own = library()
    texts = [None, "", "ab cd" * 2000, "x" * 3000, "a1" * 2000, *noisy_texts()]
    for size in (1, 7, 1 << 20):
        rows = byte_bpe.decode(byte_bpe.encode(docs_of(texts), RANKS, PATTERN, size), RANKS, PATTERN).collect()
        assert {r.doc_id: list(r.ids) for r in rows} == {i: own.encode_ordinary(t or "") for i, t in enumerate(texts)}
        assert {r.doc_id: bytes(r.decoded) for r in rows} == {i: (t or "").encode() for i, t in enumerate(texts)}


def test_byte_bpe_digests(odd, spark):
    rows = byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(odd, RANKS, PATTERN), RANKS, PATTERN)).collect()
    own = library()
    want = sorted((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for t in [r.text or "" for r in odd.collect()] for ids in [own.encode_ordinary(t)])
    assert sorted(tuple(r)[1:] for r in rows) == want
    partial = spark.createDataFrame([(1, own.encode_ordinary("漢")[:1]), (2, None)], "doc_id long, ids array<int>")
    assert [bytes(r.decoded) for r in byte_bpe.decode(partial, RANKS, PATTERN).orderBy("doc_id").collect()] == [own.decode_bytes(own.encode_ordinary("漢")[:1]), b""]


# --- shards


def test_slots_have_no_gaps(odd, docs_of):
    many = docs_of([(i % 400, f"text {i % 7}") for i in range(3000)])
    for df, n in ((odd, 9), (many, 3000), (odd.limit(0), 0)):
        for slot_rows in (7, 100_000):
            rows = sharding.shard_documents(df, slot_rows=slot_rows).collect()
            assert len(rows) == n
            for shard in {r.shard for r in rows}:
                slots = sorted(r.slot for r in rows if r.shard == shard)
                assert slots == list(range(len(slots)))
    one = {(r.doc_id, r.shard) for r in sharding.shard_documents(many).collect()}
    assert len(one) == 400


def test_growth_moves_rows_only_into_the_new_shard(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id").withColumn("text", F.lit("t"))
    rows = sharding.shard_documents(ids).collect()
    moved = [r for r in rows if r.shard != r.grown_shard]
    assert {r.grown_shard for r in moved} == {24} and abs(len(moved) - 800) < 150
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(24)) and max(counts.values()) < 1.25 * min(counts.values())


def test_weight_confines_movement(spark):
    """A heavier shard takes rows from its rack, its rack from its region, its region from the others; nothing else moves."""
    base = sharding.tree(24)
    heavy = [sharding.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 5 else 1.0) for x in base]
    place = {x.shard: (x.region, x.rack) for x in base}
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    rows = sharding.assign_shards(ids, base, heavy).collect()
    home = place[5]
    for r in rows:
        if r.shard != r.grown_shard:
            before, after = place[r.shard], place[r.grown_shard]
            assert after[0] == home[0]
            if before[0] == after[0]:
                assert after == home
                if before == after:
                    assert r.grown_shard == 5
    share = Counter(r.grown_shard for r in rows)[5] / len(rows)
    assert abs(share - 3 / 26) < 0.02
    with pytest.raises(ValueError):
        sharding.assign_shards(ids, [])
