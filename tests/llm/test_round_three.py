"""Keys of rows in the repeat search, and pages whose elements aren't closed or marked."""

import numpy as np
from pyspark.sql import functions as F

from doubtline.llm import html_text, substrings, toxicity

PROSE = "<p>A long paragraph of prose, with commas, and words that say things about the matter at hand.</p>"


def test_rows_of_equal_short_hashes_keep_their_own_ranges(spark):
    """Texts of one id, or none, with the same 32-bit hash: what repeats in one doesn't go from the other."""
    text = F.concat(*[F.sha2(F.concat(F.col("id").cast("string"), F.lit(s)), 512) for s in "abc"])
    hashed = spark.range(300_000).select(text.alias("text"), F.hash(text).alias("h"))
    pairs = hashed.groupBy("h").agg(F.collect_list("text").alias("t")).filter(F.size("t") > 1).limit(3).collect()
    assert pairs
    rows = []
    for r in pairs:
        a, b = r.t[:2]
        rows += [(None, a), (None, b), (1, a), (2, b), (2, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substrings.remove_repeats(docs).collect()
    assert len(got) == len(rows)
    once = spark.createDataFrame([(None, r.t[0]) for r in pairs] + [(None, r.t[1]) for r in pairs] + [(1, r.t[0]) for r in pairs], "doc_id long, text string")
    kept = {bytes(r.kept).decode() for r in substrings.remove_repeats(once).collect() if r.n_removed == 0}
    assert kept == {r.t[1] for r in pairs}


def test_a_row_repeated_very_often(spark):
    text = "".join(np.random.default_rng(1).choice(list("abcdefgh"), 400))
    docs = spark.createDataFrame([(7, text)] * 3000 + [(8, "x" + text[:150])], "doc_id long, text string")
    got = substrings.remove_repeats(docs).groupBy("doc_id", "n_removed", "n_spans").count().collect()
    assert {tuple(r) for r in got} == {(7, 400, 1, 3000), (8, 0, 0, 1)}
    left = substrings.without_repeats(docs.withColumn("__ranges", F.lit("clash")).withColumn("ranges", F.lit("clash"))).collect()
    assert [(r.doc_id, r["__ranges"], r.ranges) for r in left] == [(8, "clash", "clash")]


def test_widgets_that_are_not_closed():
    for tag in ("button", "select", "svg", "object", "noscript"):
        page = html_text.parse(f"<article><p>one</p><{tag}>go<p>rest</p></article><p>after</p>")
        assert [t for t in page.text if t and ("one" in t or "rest" in t or "after" in t)] == ["one", "rest", "after"], tag
        page = html_text.parse(f"<article><p>one</p><{tag}>go</{tag}><p>rest</p></article>")
        assert [t for t in page.text if t] == ["one", "rest"], tag
        page = html_text.parse(f"<article><{tag}><p>one</p></article><div><{tag}>go</{tag}></div><p>rest</p>")
        assert [t for t in page.text if t] == ["one", "rest"], tag
    assert " ".join(t for t in html_text.parse("<p>if <math><mi>x</mi><mo>=</mo><mn>2</mn></math> then</p>").text if t) == "if x=2 then"
    assert [t for t in html_text.parse("<p>one</p><script>var x = '<p>two</p>'").text if t] == ["one"]


def test_pages_without_a_marked_article_teach_nothing():
    rng = np.random.default_rng(3)
    plain = "<html><body><div class='content'>" + PROSE * 3 + "</div></body></html>"
    marked = "<html><body><nav><a href='/'>Home</a></nav><article>" + PROSE * 3 + "</article><footer>Contact</footer></body></html>"
    assert html_text.variants(plain, marked, rng) == [] and len(html_text.variants(marked, plain, rng)) > 1
    alone, with_plain = html_text.fit([marked] * 12), html_text.fit([marked] * 12 + [plain] * 60)
    for model in (alone, with_plain):
        assert "A long paragraph" in html_text.extract_pages([plain], model)[0]
    assert html_text.extract_pages([plain], html_text.fit([plain] * 5)) is not None


def test_a_token_said_over_and_over_is_walked_once():
    char = toxicity.CharModel(np.ones((toxicity.SYMBOLS,) * 3, np.float32))
    memo = toxicity._Memo(char, {"=idiot": 0, "idio": 1})
    assert memo.windows(["i"] * 200_000) == []
    assert memo.windows(["x", "i", "i", "d", "i", "o", "t", "y"]) == [(1, 7)]


def plain_walk(heads, nodes, token):
    """All that walks over a token can do, one character after the other."""
    now, passed = {(n, "") for n in nodes}, False
    for c in token:
        letters, step = c if c.isalpha() else toxicity.LEET.get(c, ""), set() if c.isalpha() else set(now)
        for node, last in now:
            if c == last or (node and heads.letter[node] in letters):
                step.add((node, c))
            for found in [heads.next[node][x] for x in letters if x in heads.next[node]]:
                step.add((found, c))
                passed |= found in heads.ends
        now = step
    return tuple(sorted({n for n, _ in now})), passed


def test_short_ways_lose_nothing():
    """Letters ahead, leading letters and cached tokens against walks and readings without any of these."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abco"), rng.integers(2, 7))) for _ in range(25)]
    char = toxicity.CharModel(rng.random((toxicity.SYMBOLS,) * 3).astype(np.float32))
    memo = toxicity._Memo(char, {b: i for i, b in enumerate(dict.fromkeys(b for w in words for b in toxicity.bases_of(w)))})
    heads, rejected = memo.heads, 0
    for _ in range(6000):
        token = "".join(rng.choice(list("abcoabcoabco0(.!-\u00b2"), rng.integers(1, 8)))
        nodes = tuple(sorted(set(rng.integers(0, len(heads.next), rng.integers(1, 3)).tolist())))
        want = plain_walk(heads, nodes, token)
        assert heads.walk(nodes, token) == want
        got = memo._step(nodes, token)
        assert got[1] == want[1] and {n for n in got[0]} == {n for n in want[0]}
        rejected += got == ((), False)
        assert set(memo[token][0]) == set(memo.bases(toxicity.restore_word(token, char))), token
        end = tuple(n for n in plain_walk(heads, (0,), token)[0] if n and heads.next[n])
        assert memo[token][1] == end, token
    assert 500 < rejected < 5500
    text = " ".join(words).upper()
    assert sorted(memo.of(text)) == sorted(memo.of(text.lower()))
