"""Ranked search, source mixing and conversation repair against plain versions and SQL."""

import hashlib
import heapq
import itertools
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from check import compare
from pyspark.sql import functions as F

from doubtline.llm import conversations, lexical, mixing

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- ranked search


def plain_search(docs, items, top=10):
    held = [(d, TERM.findall((t or "").translate(LOWER))) for d, t in docs]
    held = [(d, len(t), Counter(t)) for d, t in held if t]
    n_docs, n_terms = len(held), sum(n for _, n, _ in held)
    df = Counter(t for _, _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, n, c in held:
            m = 10 + 90 * n * n_docs // n_terms
            score = 0
            for t in set(TERM.findall((text or "").translate(LOWER))):
                if c[t]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(item, rank + 1, None if none else d, -s) for rank, (s, none, d) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def items_of(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id long, text string, score string")

    return make


def random_texts(rng, n, words):
    vocabulary = ["alpha", "Beta", "ÄB", "äb", "x1", "漢字", "e-f", "Z_z", "9", "ſ", "K", "no"]  # the Kelvin sign isn't k
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(words))) for _ in range(n)]


@pytest.mark.parametrize("part_bytes", [lexical.PART_BYTES, 150])
def test_search(docs_of, items_of, part_bytes):
    rng = random.Random(part_bytes)
    docs = list(enumerate(random_texts(rng, 150, 30))) + [(7, "alpha beta"), (7, "alpha beta"), (None, "alpha beta"), (None, None), (900, "long alpha " * 20_000)]
    items = list(enumerate(random_texts(rng, 25, 12))) + [(3, "alpha"), (None, "beta"), (60, None), (61, ""), (62, "unknown words")]
    got = lexical.search(docs_of(docs).repartition(5), items_of(items), part_bytes=part_bytes)
    assert sorted([tuple(r) for r in got.collect()], key=str) == plain_search(docs, items)


def test_search_on_odd_tables(odd, docs_of, items_of):
    assert lexical.search(odd, items_of([])).collect() == []
    assert lexical.search(docs_of([]), items_of([(1, "a")])).collect() == []
    rows = lexical.search(odd, items_of([(1, "same long")])).collect()
    assert {r.doc_id for r in rows} == {3, 4} and sorted(r["rank"] for r in rows) == [1, 2, 3]


def test_search_ties_go_by_id(docs_of, items_of):
    docs = [(i, "tie word") for i in range(3000, 0, -1)] + [(9999, "other")] * 900
    got = lexical.search(docs_of(docs).repartition(7), items_of([(1, "tie")])).collect()
    assert sorted((r["rank"], r.doc_id) for r in got) == [(i, i) for i in range(1, 11)]


def test_tiles_are_exact_and_small():
    rng = np.random.default_rng(3)
    # weights so great that one product's partial sums would pass 2**53 if the tiles weren't cut
    weights = rng.integers(2**31, 2**32, 300)
    cuts = list(lexical.vocabulary_tiles(weights))
    assert [a for a, _ in cuts] == [0, *[b for _, b in cuts[:-1]]] and cuts[-1][1] == 300 and len(cuts) > 50
    assert all(int(weights[a:b].sum()) * lexical.IMPACT < lexical.EXACT for a, b in cuts)
    items = lexical.Items([(k, " ".join(f"w{j}" for j in rng.choice(300, 100, replace=False))) for k in range(20)])
    weights = rng.integers(2**31, 2**32, len(items.term))
    term, doc = np.nonzero(rng.random((len(items.term), 40)) < 0.5)
    impact = rng.integers(1, 10**6, len(term))
    want = np.zeros((20, 40), object)
    for k in range(20):
        own = set(items.terms[items.start[k] : items.start[k + 1]].tolist())
        for t, d, x in zip(term.tolist(), doc.tolist(), impact.tolist()):
            if t in own:
                want[k, d] += int(weights[t]) * x
    for cells in (1, 700, lexical.TILE_CELLS):
        got = np.vstack([lexical.scores_of(items, weights, tile, term, doc, impact, 40) for tile in items.tiles(cells)])
        assert (got == want).all()


def test_impacts_beyond_64_bits():
    got = lexical.impacts(np.array([3]), np.array([10**7]), 10**12, 10**15)
    assert got.tolist() == [10**9 * 3 // (3000 + 8 * (10 + 90 * 10**7 * 10**12 // 10**15))]


# --- mixing


def plain_seats(weights, most, seats):
    given = [0] * len(weights)
    heap = [(-w, k) for k, w in enumerate(weights) if w > 0 and most[k] > 0]
    heapq.heapify(heap)
    while heap and seats:
        _, k = heapq.heappop(heap)
        given[k] += 1
        seats -= 1
        if given[k] < most[k]:
            heapq.heappush(heap, (-(weights[k] / (2 * given[k] + 1)), k))
    return given


def test_seats_go_to_the_highest_quotients(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for group in range(12):
        n = rng.randrange(1, 30)
        weights = [rng.choice([0.0, 1.0, 5.5, rng.random() * 100]) for _ in range(n)]
        most = [rng.randrange(40) for _ in range(n)] if group % 2 else [10**6] * n
        seats = rng.choice([0, 1, n, 7 * n, 500])
        for k, (w, m, x) in enumerate(zip(weights, most, plain_seats(weights, most, seats))):
            rows.append((group, k, w, m, seats))
            want[group, k] = x
    units = spark.createDataFrame(rows, "g int, k int, w double, most long, seats long")
    got = {(r.g, r.k): r.q for r in mixing.apportion(units, "g", "k", "w", "most", "seats", "q").collect()}
    assert {key: q for key, q in got.items() if q != want[key]} == {} and len(got) == len(want)


SMALL = dict(block_words=5, shard_words=300, copies=3)


@pytest.fixture(scope="module")
def sourced(spark):
    rng = random.Random(5)
    rows = []
    for k in range(400):
        source = rng.choice(["hot", "hot", "hot", "b", "é", "Z", None, "", "tiny"] if k < 390 else ["huge"])
        rows.append((k % 350, "w " * rng.choice([0, 1, 3, 20, 40, 700 if source == "huge" else 2]), source))
    rows += [(5, "a copy of one row", "hot")] * 100 + [(None, "no id", "b")] * 40 + [(None, None, None), (1, "", None), (2, "\n\t ", "blank only")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("taken", F.lit("clash")).withColumn("shard", F.lit("clash"))


def test_mix_against_sql(sourced):
    got = mixing.mix(sourced.repartition(6), **SMALL)
    rows = [tuple(r) for r in got.collect()]
    con = duckdb.connect()
    con.register("documents", sourced.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"}))
    cursor = con.execute(mixing.mix_sql(**SMALL))
    assert compare(rows, got.columns, cursor.fetchall(), [d[0] for d in cursor.description]) == "ok"
    assert len({r[2] for r in rows if r[1] == "hot"}) > 3
    size, taken, target, whole = Counter(), Counter(), {}, 0
    for _, source, _, n, source_size, aim, took in rows:
        assert 0 <= took <= 2 * n
        size[source] += n
        taken[source] += took
        target[source] = aim
        whole += n
    assert abs(sum(target.values()) - 1.5 * whole) < 1e-6
    for source, aim in target.items():
        assert aim <= 2 * size[source] + 1e-9 and abs(taken[source] - aim) <= 5
    again = sorted(map(str, mixing.mix(sourced, **SMALL).collect()))
    assert again == sorted(str(r) for r in got.collect())


def test_mix_of_no_words(docs_of):
    assert mixing.mix(docs_of([])).collect() == []
    rows = mixing.mix(docs_of([None, "", " \n"])).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in rows] == [(0, 0, 0.0, 0)] * 3


def test_mix_on_odd_rows(odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == 9
    total = sum(r.size for r in rows)
    assert abs(sum(r.taken for r in rows) - 1.5 * total) <= 40


# --- conversations


def plain_repair(rows):
    """The least (cost, initials) over all edits of the rows, and the result, by trying them all."""
    ok = re.compile(r"(s?(ua)+)?")
    best = None
    choices = []
    for role, text, fault in rows:
        some = [("D", None, 2)]
        if fault not in ("blank", "duplicate"):
            more = 5 if fault == "truncated" else 0
            some += [("K", (role, text), more), ("R", ("user", text), 1 + more), ("R", ("assistant", text), 1 + more)]
        choices.append(some)
    inserts = [()] + [((r, ""),) for r in ("user", "assistant")] + [(("user", ""), ("assistant", "")), (("assistant", ""), ("user", ""))]
    for picked in itertools.product(*choices):
        for put in itertools.product(inserts, repeat=len(rows) + 1):
            if sum(map(len, put)) > 2:
                continue
            out, audit, cost = [], "", 0
            for k in range(len(rows) + 1):
                out += put[k]
                audit += "I" * len(put[k])
                cost += 5 * len(put[k])
                if k < len(rows):
                    kind, row, price = picked[k]
                    audit, cost = audit + kind, cost + price
                    out += [row] if row else []
            if (best is None or (cost, audit) < best[:2]) and ok.fullmatch("".join(r[:1] or "-" for r, _ in out)):
                best = cost, audit, out
    return best


def searched(rows):
    edits = list(conversations.repair_turns(conversations.Turn(k, *row) for k, row in enumerate(rows)))
    price = {"K": 0, "R": 1, "D": 2, "I": 5}
    cost = sum(price[e.kind] + (5 if e.row and e.row.fault == "truncated" and e.kind != "D" else 0) for e in edits)
    return cost, "".join(e.kind for e in edits), [(e.role, e.row.text if e.row else "") for e in edits if e.kind != "D"]


def test_cheapest_edits_by_trying_all():
    rng = random.Random(2)
    for _ in range(150):
        n = rng.randrange(4)
        rows = [(rng.choice(["user", "assistant", "system", "tool", ""]), str(k), rng.choice(["", "", "", "blank", "duplicate", "truncated"])) for k in range(n)]
        assert searched(rows) == plain_repair(rows), rows


def plain_costs(rows):
    """Cost and initials by carrying whole strings, without dropping any state."""
    state = {0: (0, "")}
    for role, _, fault in rows:
        ways = dict(state)
        for target, sources in ((2, (0, 1, 3)), (3, (2,))):
            for s in sources:
                if s in ways:
                    ways[target] = min(ways.get(target, (10**9, "")), (ways[s][0] + 5, ways[s][1] + "I"))
        new = {}
        for s, (c, w) in ways.items():
            options = [(s, "D", 2)]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                if s == 0 and role[:1] == "s":
                    options.append((1, "K", more))
                if s != 2:
                    options += [(2, "R", 1 + more)] + ([(2, "K", more)] if role[:1] == "u" else [])
                else:
                    options += [(3, "R", 1 + more)] + ([(3, "K", more)] if role[:1] == "a" else [])
            for target, kind, price in options:
                new[target] = min(new.get(target, (10**9, "")), (c + price, w + kind))
        state = new
    ends = [state[s] for s in (0, 3) if s in state]
    ends += [(state[s][0] + 5, state[s][1] + "I") for s in (2,) if s in state] + [(state[s][0] + 10, state[s][1] + "II") for s in (1,) if s in state]
    return min(ends)


def test_long_conversations_and_their_memory():
    rng = random.Random(4)
    for n, roles in ((60, ["user", "assistant"]), (200, ["user"]), (200, ["assistant", "system"]), (150, ["user", "assistant", "system", "tool"])):
        for _ in range(25):
            rows = [(rng.choice(roles), str(k), rng.choice(["", "", "", "", "blank", "duplicate", "truncated"])) for k in range(n)]
            assert searched(rows)[:2] == plain_costs(rows)
    search, edits = conversations.Search(), 0
    for k in range(50_000):
        edits += sum(1 for _ in search.add(conversations.Turn(k, ("user", "assistant")[k % 2] if rng.random() < 0.9 else "user", "x", "")))
    assert search.most_held < 200 and edits + search.held >= 50_000
    # nothing but rows to delete: the start must not hold the tree open
    search = conversations.Search()
    for k in range(5000):
        list(search.add(conversations.Turn(k, "user", "", "blank")))
    assert search.most_held < 50


def test_repair_on_odd_conversations(spark):
    schema = "conv_id long, turn long, role string, text string, edit string, fault string, same string"
    rows = [
        (1, 2, "assistant", "Second.", "x", "x", "x"), (1, 1, "user", "First?", "x", "x", "x"), (1, None, "system", "Rules.", "x", "x", "x"),
        (2, 1, None, None, "x", "x", "x"), (None, 1, "user", "No id.", "x", "x", "x"), (None, None, "assistant", "Sure.", "x", "x", "x"),
        (3, 1, "user", "Same.", "x", "x", "x"), (3, 1, "user", "Same.", "x", "x", "x"), (3, 9, "assistant", "Same.", "x", "x", "x"), (3, 10, "user", "Same.", "x", "x", "x"),
        (4, 1, "user", "long " * 100_000 + ".", "x", "x", "x"), (4, 2, "assistant", "漢" * 50_000 + "!", "x", "x", "x"),
    ]
    table = spark.createDataFrame(rows, schema)
    edits = conversations.repair(table)
    by = {r.conv_id: r for r in conversations.digests(edits).collect()}
    assert (by[1].audit, by[1].cost, by[1].gaps, by[1].illegal) == ("KKK", 0, 0, 0)
    assert by[1].repaired_sha256 == hashlib.sha256(b"system:Rules.\nuser:First?\nassistant:Second.").hexdigest()
    assert (by[2].audit, by[2].blank, by[2].cost, by[2].repaired_sha256) == ("D", 1, 2, hashlib.sha256(b"").hexdigest())
    assert (by[3].audit, by[3].duplicate, by[3].gaps, by[3].illegal) == ("KDKD", 2, 7, 1)
    assert by[4].audit == "KK" and by[4].repaired_sha256 == hashlib.sha256(("user:" + "long " * 100_000 + ".\nassistant:" + "漢" * 50_000 + "!").encode()).hexdigest()
    assert (by[None].audit, by[None].cost) == ("RR", 2)  # the row without a turn comes first
    assert conversations.digests(conversations.repair(table.limit(0))).collect() == []
    gone = conversations.repair(table.withColumn("dropped", F.lit(True)))
    assert {(r.audit, r.cost, r.repaired_sha256) for r in conversations.digests(gone).collect()} == {("", 0, hashlib.sha256(b"").hexdigest())}


def test_damage(spark):
    rows = [(c, t, "assistant", "Yes. No! Why?") for c in range(30) for t in range(10)] + [(None, None, None, None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    import zlib

    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if kind == 1 else "Yes No Why" if kind == 2 and text != " " else text
        want += [(c, t, "user" if kind == 4 else role, text, kind == 0)] * (2 if kind == 3 else 1)
    assert sorted(map(tuple, conversations.damage(table).collect()), key=str) == sorted(want, key=str)
