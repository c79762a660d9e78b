"""Classifiers, page extraction and decontamination."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from doubtline.llm import decontaminate, html_text, labelled, quality, toxicity


# --- quality


def test_held_out_part(spark):
    import zlib

    rows = spark.range(50).select(labelled.held_out(F.col("id"), 4, 2).alias("h"), "id").collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)
    assert not spark.sql("select cast(null as long) id").select(labelled.held_out(F.col("id"), 4, 2)).first()[0]


def test_quality_on_held_out_labels(spark, table):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    model = quality.train(docs, labels)
    rows = quality.score_quality(docs, model).join(labels, "doc_id").collect()
    right = [(r.predicted == r.quality) for r in rows if r.held_out]
    assert np.mean(right) > 0.95
    kept = {r.doc_id for r in quality.accepted(docs, model).collect()}
    assert all((r.doc_id in kept) == (r.predicted == 1) for r in rows)
    # scores are those of the averaged vectors and the softmax themselves
    for r in docs.limit(5).collect():
        ids, shares = quality.features(r.text, model.shape)
        logit = (shares @ model.vectors[ids]) @ model.layer + model.bias
        p = np.exp(logit - logit.max())
        assert quality.scorer(model)([r.text])[0] == pytest.approx((p / p.sum())[1], abs=1e-4)


def test_quality_without_labels_and_on_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.train(odd, none)
    rows = quality.score_quality(odd, model).collect()
    assert len(rows) == 9 and all(0 <= r.score <= 1 for r in rows)
    assert quality.score_quality(odd.limit(0), model).count() == 0
    labels = spark.createDataFrame([(1, 0, 0), (3, 1, 0), (3, 0, 1), (4, None, None), (None, 1, 1), (5, 7, 7)], "doc_id long, quality int, toxic int")
    assert quality.accepted(odd, quality.train(odd, labels)).columns == odd.columns


# --- toxicity


@pytest.fixture(scope="module")
def toxic(spark):
    rng = random.Random(5)
    clean, bad = ["river", "stone", "market", "window", "garden", "paper", "letter", "summer"], ["idiot", "moron", "stupid"]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(clean) for _ in range(30)]
        if i % 4 == 0:
            words[rng.randrange(30)] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    char = toxicity.char_model(docs)
    return docs, char, toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), char)


@pytest.mark.parametrize("noisy", ["1d10t", "i.d.i.o.t", "idiooooot", "m0r0n", "$tup1d", "stuuupid", "!d!ot", "m_o_r_o_n", "ssttuuppiidd", "i d i o t", "M O R O N", "IDIOT!!", "5tup!d"])
def test_noise_is_undone(spark, toxic, noisy):
    _, _, model = toxic
    docs = spark.createDataFrame([(0, f"river stone {noisy} garden paper"), (1, "river stone garden paper"), (2, "12 3 4 a 5 $ 6")], "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs, model).collect()}
    assert got == {0: 1, 1: 0, 2: 0}


@pytest.mark.parametrize("noisy", ["stuupid", "sstupid", "moorron", "iddiot", "stu pid", "id iot", "mor on", "st up id", "stu p1d"])
def test_light_noise_is_undone(spark, toxic, noisy):
    """One or two doubled letters, and words in a few pieces."""
    _, _, model = toxic
    docs = spark.createDataFrame([(0, f"river stone {noisy} garden paper"), (1, "river stone garden paper")], "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs, model).collect()}
    assert got == {0: 1, 1: 0}


@pytest.mark.parametrize("noisy", ["asparag us", "aspara gus", "asparagu s", "a s p a r a g u s", "asp4ra gus", "aspara-gus", "asspar aagus"])
def test_pieces_of_any_length_are_joined(spark, toxic, noisy):
    """Words in pieces of 6 and more letters, and words of any length."""
    docs, char, _ = toxic
    rows = [(i, f"river stone {'asparagus' if i % 3 == 0 else 'window'} garden paper market") for i in range(90)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(90)], "doc_id long, quality int, toxic int")
    own = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(own, labels, toxicity.char_model(docs.unionByName(own)))
    asked = spark.createDataFrame([(0, f"river stone {noisy} garden paper"), (1, "river stone garden paper"), (2, "paper summer window letter")], "doc_id long, text string")
    assert {r.doc_id: r.predicted for r in toxicity.score_toxicity(asked, model).collect()} == {0: 1, 1: 0, 2: 0}


def test_walks_lose_no_reading():
    """Every way to noise a word is walked to its beginning."""
    heads = toxicity.Heads(["letter", "idiot"])
    for noisy in ("letter", "le7ter", "let7er", "l3tteerr", "l.e.t.t.e.r", "1d10t", "iddiot", "!d!o+", "i-d-i-o-t", "idio7t"):
        assert heads.walk((0,), noisy)[1], noisy
    nodes, passed = heads.walk((0,), "let")
    assert not passed and heads.walk(nodes, "7er")[1] and not heads.walk(nodes, "idiot")[1]
    assert heads.walk((0,), "paper") == ((), False)


def test_all_states_are_kept(toxic):
    """Many signs in a row: the least cost over all of their letters."""
    _, char, _ = toxic
    import itertools

    noisy = "1|1|1|1|"
    best = min(
        (sum(float(char.cost[a, b, c]) for a, b, c in zip(m, m[1:], m[2:])) + spent, text)
        for picks in itertools.product(*[[("i", toxicity.SWAP), ("l", toxicity.SWAP), ("", toxicity.DROP)]] * len(noisy))
        if (text := "".join(x for x, _ in picks))
        for m in [[0, 0, *map(toxicity._symbol, text), 0]]
        for spent in [sum(x for _, x in picks)]
    )
    assert toxicity.decode(noisy, char)[0] == best[1]


def test_very_long_and_repeated_training_rows(spark, toxic):
    docs, char, model = toxic
    asked = spark.createDataFrame([(0, "river stone " * 20_000 + "1d10t"), (1, "river stone " * 20_000)], "doc_id long, text string")
    assert {r.doc_id: r.predicted for r in toxicity.score_toxicity(asked, model).collect()}[1] == 0
    many = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    sample = labelled.training_sample(many, labels, "toxic", 10**6, 10**6, 50, "x")
    assert sample.count() <= 50


def test_restored_text(toxic):
    _, char, _ = toxic
    assert toxicity.restore("You i d i o t and m0r0n.", char).split()[1:] == ["idiot", "and", "moron"]
    assert toxicity.decode("stone", char)[0] == "stone"


def test_viterbi_finds_the_least_cost(toxic):
    """All paths of a small lattice, one after the other."""
    _, char, _ = toxic
    options = {"1": ["i", "l"], "0": ["o"], "3": ["e"]}

    def best(noisy):
        paths = [(0.0, "")]
        for i, c in enumerate(noisy):
            steps = [(c, 0.0)] if c.isalpha() else [(x, toxicity.SWAP) for x in options.get(c, [])]
            if not c.isalpha():
                steps.append(("", toxicity.SEPARATE if c in toxicity.SEPARATORS else toxicity.DROP))
            if i and noisy[i - 1] == c:
                steps.append(("", toxicity.REPEAT))
            paths = [(s + k, t + x) for s, t in paths for x, k in steps]

        def cost(text):
            marks = [0, 0, *map(toxicity._symbol, text), 0]
            return sum(float(char.cost[a, b, c]) for a, b, c in zip(marks, marks[1:], marks[2:]))

        return min((s + cost(t), t) for s, t in paths if t)[1]

    for noisy in ("1d10t", "m0r0n", "r1ver", "stt0ne", "w1nd0w", "l3tt3r", "g.a.r"):
        assert toxicity.decode(noisy, char)[0] == best(noisy)


def test_char_counts_cover_all_texts(spark):
    docs = spark.createDataFrame([("ab",), ("ab",), (None,), ("",), ("Äb1",)], "text string")
    cost = toxicity.char_model(docs).cost
    a, b, ae = 1, 2, toxicity._symbol("ä")
    assert cost[0, a, b] < cost[0, a, a] and cost[0, ae, b] < cost[0, ae, a]


def test_toxicity_on_tables_and_odd_rows(spark, odd):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    char = toxicity.char_model(docs)
    model = toxicity.train(docs, labels, char)
    rows = toxicity.score_toxicity(docs, model).join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.toxic for r in rows if r.held_out]) > 0.9
    assert len(toxicity.score_toxicity(odd, model).collect()) == 9
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    empty = toxicity.train(odd, none, toxicity.char_model(odd.limit(0)))
    assert toxicity.score_toxicity(odd, empty).count() == 9 and toxicity.score_toxicity(odd.limit(0), empty).count() == 0


# --- pages


PROSE = "<p>A long paragraph of prose, with commas, and words that say things about the matter at hand.</p>"


@pytest.fixture(scope="module")
def pages_model(spark):
    return html_text.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("", ""),
        ("<html><body><nav><a href=x>A</a></nav></body></html>", ""),
        ("<article><p>Hi &lt;b&gt; th&eacute;re&nbsp;you <b>bo</b>ld</p><div class='ad'>Buy</div></article>", "Hi <b> thére you bold"),
        ("<article><p>one<br>two<p>three<script>var x = '<p>no</p>';</script><!-- no --><style>p{}</style></article><footer>&copy; me</footer>", "one two three"),
        ("<article><h1>T</h1>" + PROSE + "<p>cut off mid wor", None),
        ("<article><p>unquoted <a href=x>link</a> &amp tail</p></article", "unquoted link & tail"),
    ],
)
def test_pages(pages_model, source, want):
    got = html_text.extract_pages([source], pages_model)[0]
    if want is None:
        assert got.startswith("T A long") and got.endswith("cut off mid wor")
    else:
        assert got == want


def test_pages_without_the_usual_elements(pages_model):
    source = '<div class="menu"><a href=x>A</a> <a href=y>B</a></div><div class="content"><h1>Title</h1>' + PROSE * 3 + '<p>Short.</p></div><section id="comments"><div class="comment"><p>I liked it very much.</p></div></section><div class="footer">&copy; 2024</div>'
    got = html_text.extract_pages([source], pages_model)[0]
    assert got.startswith("Title A long") and got.endswith("Short.")


def test_articles_of_the_tables(spark, sf, table, pages_model):
    import html as lib
    import re

    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(spark.read.parquet(f"{sf}/pages.parquet"), pages_model).collect()}
    for page_id, source in table("pages", "page_id, html"):
        inside = re.sub(r"<[a-zA-Z!/][^>]*\Z", "", re.search(r"<article>(.*?)(</article>|\Z)", source, re.S)[1])
        want = " ".join(lib.unescape(re.sub(r"</?b>", "", re.sub(r"<(?!/?b>)[^>]*>", " ", inside))).split())
        assert got[page_id] == (want, len(want))


def test_decoding_never_contradicts(pages_model):
    rng = np.random.default_rng(3)
    page = html_text.parse("<div><ul><li>a<li>b<ul><li>c</ul></ul><p>d<div><p>e<p>f</div></div><p>g")
    batch = html_text.Batch([page, page])
    n = len(batch.parent)
    for _ in range(50):
        odds = rng.normal(0, 2, n)
        kept = html_text.decode(batch, odds)
        below = batch.parent >= 0
        assert not (kept[below] & ~kept[batch.parent[below]]).any()
        if _ < 3:  # the best of all consistent choices of one page
            half = n // 2
            gain = odds[:half]
            best = -1e9
            for mask in range(1 << half):
                chosen = np.array([(mask >> i) & 1 for i in range(half)], bool)
                if all(chosen[batch.parent[i]] or not chosen[i] for i in range(1, half)):
                    best = max(best, gain[chosen].sum())
            assert gain[kept[:half]].sum() == pytest.approx(best)


def test_pages_odd_rows(spark, pages_model):
    rows = [(None, None, None), (1, "u", ""), (1, "u", "<article><p>x</p></article>"), (2, None, "<p" * 2000 + "<div>" * 500 + "&#x;&bad;<a b='>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit(2))
    out = html_text.extract(df, pages_model).collect()
    assert len(out) == 4 and {r.text for r in out if r.page_id == 1} == {"", "x"}
    assert html_text.extract(df.limit(0), html_text.train(df.limit(0))).count() == 0


# --- decontamination


@pytest.fixture(scope="module")
def items():
    rng = random.Random(9)
    common = ["the", "of", "and", "to"]
    word = lambda: rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 5)))
    return [(i, " ".join(word() for _ in range(rng.randrange(5, 60))) + ". " + " ".join(word() for _ in range(8)) + ".") for i in range(60)], word


def test_wand_finds_all_that_scoring_every_item_finds(items):
    rows, word = items
    index = decontaminate.ItemIndex(rows)
    rng = random.Random(1)
    for _ in range(150):
        passage = [word() for _ in range(100)] + (rng.choice(rows)[1].split()[: rng.randrange(60)])
        terms = sorted({t for w in passage if (t := index.term.get(decontaminate.EDGE.sub("", w), -1)) >= 0})
        scores = np.zeros(len(index.ids))
        for t in terms:
            for item, x in index.postings[t]:
                scores[item] += x
        for threshold in (0.1, 0.3, 0.5, 0.9):
            got = dict(index.search(terms, threshold))
            assert set(got) == set(np.flatnonzero(scores >= threshold - 1e-9).tolist())
            assert all(abs(scores[i] - s) < 1e-9 for i, s in got.items())


def test_no_passage_is_ruled_out_wrongly(items):
    rows, word = items
    index = decontaminate.ItemIndex(rows)
    rng = random.Random(2)
    for _ in range(30):
        raw = [word() for _ in range(rng.randrange(0, 500))]
        at = rng.randrange(len(raw) + 1)
        raw[at:at] = rng.choice(rows)[1].split()[: rng.randrange(60)]
        words = np.array([index.term.get(decontaminate.EDGE.sub("", w), -1) for w in raw], np.int64)
        for threshold in (0.2, 0.5):
            opened = {(a, b) for _, a, b in decontaminate.open_passages(index, words, np.array([0, len(words)]), threshold)}
            cells = -(-len(words) // index.cell)
            for c in range(max(1, cells - 1) if cells else 0):
                a, b = c * index.cell, min((c + 2) * index.cell, len(words))
                if index.search(np.unique(words[a:b][words[a:b] >= 0]).tolist(), threshold):
                    assert (a, b) in opened


def test_leaks_are_found_and_clean_texts_left(spark, items, docs_of):
    rows, word = items
    bench = spark.createDataFrame([*rows, (None, None), (99, ""), (98, "...")], "item_id long, text string")
    texts = [" ".join(word() for _ in range(300)) for _ in range(40)]
    for k in range(10):
        texts[k] += " " + rows[k][1].upper() + " " + " ".join(word() for _ in range(k * 20))
    docs = docs_of([*texts, None, ""])
    for size in (1 << 20, 2000):  # one index, and several
        got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench, index_bytes=size).collect()}
        assert {(k, k) for k in range(10)} == got
        left = decontaminate.uncontaminated(docs, bench, index_bytes=size)
        assert {r.doc_id for r in left.collect()} == set(range(10, 42)) and left.columns == docs.columns


def test_scores_do_not_depend_on_the_parts(spark, items, docs_of):
    """Several indexes give the rows of one, to the last column, partial leaks included."""
    rows, word = items
    bench = spark.createDataFrame([*rows, (99, "...")], "item_id long, text string")
    docs = docs_of([" ".join(word() for _ in range(100)) + " " + " ".join(r[1].split()[: 3 + len(r[1].split()) * 2 // 3]) for r in rows])
    one, many = (sorted((r.doc_id, r.item_id, round(r.score, 9), r.question_overlap, r.answer_overlap) for r in decontaminate.contaminated(docs, bench, index_bytes=size).collect()) for size in (1 << 20, 2000))
    assert one and one == many


def test_every_verbatim_item_of_the_tables(spark, sf, table):
    docs, bench = table("documents", "doc_id, text"), table("benchmark", "item_id, text")
    want = {(d, i) for d, t in docs for i, x in bench if x in t}
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert want <= got and len(got - want) <= 0.1 * len(want) + 2


def test_decontamination_of_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "same row"), (2, None)], "item_id long, text string")
    rows = decontaminate.contaminated(odd, bench).collect()
    assert {r.doc_id for r in rows} == {3} and len(rows) == 2
    assert decontaminate.contaminated(odd.limit(0), bench).count() == 0
    assert decontaminate.contaminated(odd, bench.limit(0)).count() == 0
    assert decontaminate.uncontaminated(odd, bench.limit(0)).count() == 9
